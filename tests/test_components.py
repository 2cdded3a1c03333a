import random

import pytest

from asterweave.operators.components import component_labels


def union_find(edges):
    parent = {}

    def root(a):
        parent.setdefault(a, a)
        while parent[a] != a:
            parent[a] = parent[parent[a]]
            a = parent[a]
        return a

    for a, b in edges:
        a, b = root(a), root(b)
        parent[max(a, b)] = min(a, b)
    return {a: root(a) for a in parent}


@pytest.mark.parametrize("seed", [1, 2])
def test_random_graphs(spark, seed):
    rnd = random.Random(seed)
    edges = [(rnd.randrange(120), rnd.randrange(120)) for _ in range(80)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(edges, "a long, b long")).collect()}
    want = union_find([e for e in edges if e[0] != e[1]])
    assert got == want


def test_long_chain_and_hub(spark):
    chain = [(i, i + 1) for i in range(100, 160)]
    hub = [(500, i) for i in range(501, 560)]
    got = {r.node: r.label for r in component_labels(spark.createDataFrame(chain + hub, "a long, b long")).collect()}
    assert all(v == (100 if k <= 160 else 500) for k, v in got.items()) and len(got) == 61 + 60


def test_nothing_to_link(spark):
    empty = spark.createDataFrame([], "a long, b long")
    assert component_labels(empty).count() == 0
    odd = spark.createDataFrame([(1, 1), (None, 2), (3, None)], "a long, b long")
    assert component_labels(odd).count() == 0
