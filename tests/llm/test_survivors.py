import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from asterweave.llm.survivors import dominance_layers, surviving_cells, surviving_records

D = dt.datetime
SCHEMA = "row_id long, group_id long, priority int, updated_at timestamp, a boolean, b boolean, c boolean"


def stated():
    return {"mag": F.col("a"), "size": F.col("b"), "names": F.col("c")}


def made(seed, n=600, groups=60):
    rnd = random.Random(seed)
    dates = [None, *(D(2020, m, 1) for m in range(1, 6))]
    return [(i, rnd.randrange(groups), rnd.choice([None, 1, 2, 3, 3]), rnd.choice(dates), *(rnd.random() < s for s in (0.6, 0.3, 0.2))) for i in range(n)]


def policy(r):
    return (10**9 if r[2] is None else r[2], -r[3].timestamp() if r[3] else 1e18, r[0])


def complete(d, r, by_count):
    return sum(d[4:7]) >= sum(r[4:7]) if by_count else all(x or not y for x, y in zip(d[4:7], r[4:7], strict=True))


def brute_layers(rows, by_count):
    """Peeled one by one, after superseded records are set aside."""
    out = {}
    for g in {r[1] for r in rows}:
        best = {}
        for r in rows:
            if r[1] == g and ((k := (r[2], r[4:7])) not in best or policy(r) < policy(best[k])):
                best[k] = r
        left, layer = list(best.values()), 0
        while left:
            layer += 1
            top = [r for r in left if not any(d is not r and policy(d)[0] <= policy(r)[0] and policy(d)[1:] < policy(r)[1:] and complete(d, r, by_count) for d in left)]
            out |= {r[0]: layer for r in top}
            left = [r for r in left if r not in top]
    return out


def test_policy_against_brute_force(spark):
    rows = made(4)
    got = {(r.group_id, r.field): r.row_id for r in surviving_cells(spark.createDataFrame(rows, SCHEMA), stated()).collect()}
    want = {}
    for g in range(60):
        for name, i in (("mag", 4), ("size", 5), ("names", 6)):
            own = [r for r in rows if r[1] == g and r[i]]
            if own:
                want[g, name] = min(own, key=policy)[0]
    assert got == want


@pytest.mark.parametrize("by_count", [False, True])
def test_layers_and_fills_against_brute_force(spark, by_count):
    rows = made(7)
    df = spark.createDataFrame(rows, SCHEMA)
    layer = brute_layers(rows, by_count)
    assert {r.row_id: r.layer for r in dominance_layers(df, stated(), by_count).collect()} == layer
    got = surviving_records(df.selectExpr("*", "row_id * 2 as twice"), stated(), ["twice"], by_count).collect()
    deeper = 0
    for best in got:
        own = sorted((r for r in rows if r[1] == best.group_id and r[0] in layer), key=lambda r: (layer[r[0]], policy(r)))
        assert best.row_id == own[0][0] and best.twice == 2 * best.row_id
        for name, i in (("mag", 4), ("size", 5), ("names", 6)):
            first = next((r for r in own if r[i]), None)
            assert best[f"{name}_row"] == (first and first[0]) and (first is None or best[f"{name}_from"].twice == 2 * first[0])
            deeper += first is not None and layer[first[0]] > 1
    assert len(got) == 60 and (deeper > 0) == by_count


def test_deeper_layers_fill_what_the_first_lacks(spark):
    # the newest record of the most trusted source states two fields; the third is stated by a record that it dominates
    rows = [(1, 1, 1, D(2022, 1, 1), True, True, False), (2, 1, 2, D(2021, 1, 1), False, False, True), (3, 1, 3, D(2020, 1, 1), False, False, True)]
    best = surviving_records(spark.createDataFrame(rows, SCHEMA), stated(), by_count=True).first()
    assert (best.row_id, best.mag_row, best.size_row, best.names_row) == (1, 1, 1, 2)
    assert (best.mag_layer, best.names_layer) == (1, 2)


def test_edges(spark):
    empty = spark.createDataFrame([], SCHEMA)
    assert surviving_cells(empty, stated()).count() == 0 and surviving_records(empty, stated()).count() == 0
    rows = [(None, 1, 1, None, True, True, True), (5, 1, None, None, None, False, False), (5, 1, None, None, None, False, False)]
    best = surviving_records(spark.createDataFrame(rows, SCHEMA).selectExpr("*", "'x' as carried", "1 as mask", "2 as ladder"), stated(), ["carried"]).collect()
    assert [(b.row_id, b.carried, b.mag_row, b.size_layer) for b in best] == [(5, "x", None, None)]
