import math
import random

import pytest

from asterweave.llm.groups import matched_groups, tolerance_groups


def brute(points, arcmin):
    def u(ra, dec):
        a, d = math.radians(ra % 360), math.radians(dec)
        return (math.cos(d) * math.cos(a), math.cos(d) * math.sin(a), math.sin(d))

    r2 = (2 * math.sin(math.radians(arcmin / 60) / 2)) ** 2
    us = {i: u(a, d) for i, a, d in points}
    parent = {i: i for i in us}

    def root(i):
        while parent[i] != i:
            parent[i] = parent[parent[i]]
            i = parent[i]
        return i

    ids = sorted(us)
    for n, i in enumerate(ids):
        for j in ids[n + 1 :]:
            if sum((p - q) ** 2 for p, q in zip(us[i], us[j], strict=True)) <= r2:
                a, b = root(i), root(j)
                parent[max(a, b)] = min(a, b)
    groups = {i: root(i) for i in ids}
    sizes = {}
    for g in groups.values():
        sizes[g] = sizes.get(g, 0) + 1
    return {i: g for i, g in groups.items() if sizes[g] > 1}


def got(spark, points, arcmin=0.6):
    df = spark.createDataFrame(points, "row_id long, ra double, dec double").selectExpr("*", "1 as group_id", "2 as cell", "'c' as root")
    return {r.row_id: r.group_id for r in tolerance_groups(df, arcmin).collect()}


@pytest.mark.parametrize("dec", [0.0, 60.0, 89.99, -89.995])
def test_dense_patch(spark, dec):
    rnd = random.Random(dec)
    points = [(i, rnd.uniform(-0.15, 0.15) / max(0.01, math.cos(math.radians(dec))), max(-90.0, min(90.0, dec + rnd.uniform(-0.1, 0.1)))) for i in range(300)]
    points += [(1000 + i, *p[1:]) for i, p in enumerate(points[:20])]
    assert got(spark, points) == brute(points, 0.6)


def test_crowded_cells_across_a_gap(spark):
    # two clouds of many distinct positions, just within and just beyond the tolerance
    rnd = random.Random(1)
    arc = 1 / 60
    for gap in (0.598, 0.602):
        left = [(i, 10.0 - rnd.uniform(0, 0.3) * arc, rnd.uniform(0, 0.001) * arc) for i in range(150)]
        right = [(500 + i, 10.0 + (gap + rnd.uniform(0.0001, 0.3)) * arc, rnd.uniform(0, 0.001) * arc) for i in range(150)]
        points = [*left, *right, (900, 10.0, 0.0), (901, 10.0 + gap * arc, 0.0)]
        assert got(spark, points) == brute(points, 0.6)


def test_chain_is_one_group_and_copies_cost_one_place(spark):
    chain = [(i, 50.0 + i * 0.59 / 60, 0.0) for i in range(40)]
    copies = [(1000 + i, 200.0, 10.0) for i in range(2000)]
    result = got(spark, chain + copies)
    assert all(result[i] == 0 for i in range(40)) and all(result[1000 + i] == 1000 for i in range(2000))


def test_modulo_and_dirt(spark):
    nan = float("nan")
    points = [(1, 359.999, 0.0), (2, 720.001, 0.0), (3, None, 0.0), (4, nan, 0.0), (5, 0.0, 90.5), (6, 100.0, 0.0), (None, 100.0, 0.0)]
    assert got(spark, points) == {1: 1, 2: 1}
    assert got(spark, []) == {}
    assert got(spark, [(1, 5.0, 5.0)]) == {}


def test_groups_of_matches(spark):
    rows = [(5, 9), (9, 2), (2, 5), (2, 5), (7, 8), (4, 4), (None, 3), (6, None)]
    df = spark.createDataFrame(rows, "row_id_a long, row_id_b long").selectExpr("*", "1 as node", "'x' as label")
    assert {(r.row_id, r.group_id) for r in matched_groups(df).collect()} == {(2, 2), (5, 2), (9, 2), (7, 7), (8, 7)}
    assert matched_groups(df.limit(0)).count() == 0
