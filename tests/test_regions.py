import math
import random

import pytest

from asterweave.operators import regions
from asterweave.operators.regions import near_pairs, regions_of_points

FIELD = "field_id string, shape string, ra double, dec double, radius_arcmin double, ra_min double, ra_max double, dec_min double, dec_max double"


def apart(a1, d1, a2, d2):
    a1, d1, a2, d2 = map(math.radians, (a1, d1, a2, d2))
    h = math.sin((d2 - d1) / 2) ** 2 + math.cos(d1) * math.cos(d2) * math.sin((a2 - a1) / 2) ** 2
    return math.degrees(2 * math.asin(min(1, math.sqrt(h))))


def contains(f, ra, dec):
    _, shape, cra, cdec, radius, a0, a1, d0, d1 = f
    if shape == "circle":
        return apart(cra, cdec, ra, dec) * 60 <= radius
    return d0 <= dec <= d1 and (a0 <= ra <= a1 if a0 <= a1 else ra >= a0 or ra <= a1)


def test_against_brute_force(spark):
    rnd = random.Random(5)
    fields = [("C%d" % i, "circle", rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-1, 1))), 10 ** rnd.uniform(0.5, 3.3), None, None, None, None) for i in range(25)]
    fields += [("P1", "circle", 40.0, 89.9, 200.0, None, None, None, None), ("P2", "circle", 1.0, -89.95, 30.0, None, None, None, None)]
    for i in range(15):
        a, d = rnd.uniform(0, 360), rnd.uniform(-88, 80)
        fields.append(("B%d" % i, "box", None, None, None, a, (a + rnd.uniform(0.1, 30)) % 360, d, d + rnd.uniform(0.1, 10)))
    fields.append(("B_all", "box", None, None, None, 0.0, 360.0, 80.0, 90.0))
    points = [(i, rnd.uniform(0, 360), math.degrees(math.asin(rnd.uniform(-1, 1)))) for i in range(3000)]
    points += [(5000 + i, rnd.uniform(0, 360), s * rnd.uniform(88, 90)) for i in range(200) for s in (1, -1)]
    points += [(9000, 0.0, 0.0), (9001, 359.999999, 0.0), (9002, 123.0, 90.0), (9003, 10.0, -90.0)]
    got = {(r.row_id, r.field_id) for r in regions_of_points(spark.createDataFrame(points, "row_id long, ra double, dec double"), spark.createDataFrame(fields, FIELD)).collect()}
    assert got == {(p, f[0]) for p, ra, dec in points for f in fields if contains(f, ra, dec)}


def test_modulo_edges_and_dirt(spark):
    fields = [
        ("W", "box", None, None, None, 350.0, 10.0, -5.0, 5.0), ("E", "Circle ", 0.0, 0.0, 60.0, None, None, None, None),
        ("N", "circle", None, 0.0, 60.0, None, None, None, None), ("R", "circle", 0.0, 0.0, -1.0, None, None, None, None),
        (None, "circle", 0.0, 0.0, 60.0, None, None, None, None), ("X", "blob", 0.0, 0.0, 60.0, 0.0, 1.0, 0.0, 1.0),
    ]
    points = [(1, 360.0 * 2, 0.0), (2, -10.0, 5.0), (3, None, 0.0), (4, float("nan"), 0.0), (5, 0.0, 91.0), (6, 10.0, -5.0), (1, 0.0, 0.0), (7, 0.0, 1.0)]
    rows = spark.createDataFrame([p + ("x",) for p in points], "row_id long, ra double, dec double, field_id string")
    got = sorted((r.row_id, r.field_id) for r in regions_of_points(rows, spark.createDataFrame(fields, FIELD)).collect())
    assert [g for g in got if g[1] == "W"] == [(1, "W"), (2, "W"), (6, "W"), (7, "W")]
    assert [g for g in got if g[1] == "E"] == [(1, "E"), (7, "E")] and len(got) == 6


def test_empty(spark):
    none = spark.createDataFrame([], FIELD)
    points = spark.createDataFrame([(1, 0.0, 0.0)], "row_id long, ra double, dec double")
    assert regions_of_points(points, none).count() == 0
    some = spark.createDataFrame([("E", "circle", 0.0, 0.0, 60.0, None, None, None, None)], FIELD)
    assert regions_of_points(points.limit(0), some).count() == 0


def test_cover_separates_inside_from_edge():
    found = list(regions.cover({"shape": "circle", "ra": 100.0, "dec": 30.0, "radius": 2.0}))
    inside = sum(i for _, i in found)
    assert 0 < inside < len(found) < 3000


@pytest.mark.parametrize("strict", [False, True])
def test_near_pairs(spark, strict):
    rnd = random.Random(3)
    points = [(i, rnd.uniform(359.5, 360.5) % 360, s * rnd.uniform(89, 90)) for i in range(60) for s in (1,)]
    points += [(100 + i, rnd.uniform(359.8, 360.2), rnd.uniform(-0.2, 0.2)) for i in range(60)]
    df = spark.createDataFrame(points, "row_id long, ra double, dec double")
    got = {(r.a, r.b) for r in near_pairs(df, 6.0, strict=strict).collect()}
    assert got == {(p[0], q[0]) for p in points for q in points if p[0] < q[0] and apart(*p[1:], *q[1:]) * 60 <= 6.0}
