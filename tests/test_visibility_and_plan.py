import datetime as dt
import itertools
import random

import pytest
from pyspark.sql import functions as F

from asterweave.functions import ephem
from asterweave.functions.sky import separation
from asterweave.operators import plan, runs, visibility
from asterweave.operators.visibility import STEP, Site

SITE = Site()


def value(spark, column):
    return spark.range(1).select(column.alias("v")).first().v


def test_sidereal_time_and_bodies(spark):
    assert value(spark, ephem.gmst(F.lit(2461041.5))) == pytest.approx(100.660859, abs=1e-5)
    # almanac: Sun on 1992-10-13 0 h at 198.378, -7.785; Moon on 1992-04-12 0 h at 134.688, 13.768
    ra, dec = ephem.sun(F.lit(2448908.5))
    assert value(spark, ra) == pytest.approx(198.378, abs=0.02) and value(spark, dec) == pytest.approx(-7.785, abs=0.02)
    ra, dec = ephem.moon(F.lit(2448724.5))
    assert value(spark, separation(ra, dec, F.lit(134.688), F.lit(13.768))) < 0.4
    # almanac: theta Persei carried to 2028-11-13.19, proper motion included in the start
    ra, dec = ephem.precessed(F.lit(41.054063), F.lit(49.227750), F.lit(2462088.69))
    assert value(spark, ra) == pytest.approx(41.547214, abs=1e-4) and value(spark, dec) == pytest.approx(49.348483, abs=1e-4)


def test_small_formulas(spark):
    fov = ephem.field_of_view(F.lit(300.0), F.lit(23.5), F.lit(15.7))
    want = {"fov_w": 4.4885, "fov_h": 2.9987, "diagonal": 323.61964, "title_w": 4.488173, "title_h": 2.998482}
    assert {n: pytest.approx(value(spark, c), abs=1e-4) for n, c in fov.items()} == want
    assert value(spark, ephem.smallest_size(F.lit(300.0), F.lit(23.5), F.lit(15.7), F.lit(10.0))) == pytest.approx(17.9922)
    days = spark.sql("select explode(array(date'2026-03-29', date'2026-03-30', date'2026-10-25', date'2026-10-26')) d")
    assert [r.v for r in days.select(ephem.utc_offset_hours(F.col("d"), "Europe/Warsaw").alias("v")).collect()] == [1, 2, 2, 1]
    assert visibility.days_of_year(spark, 2026).count() == 365 and visibility.days_of_year(spark, 2028).count() == 366


@pytest.mark.parametrize(("true_at", "want"), [(range(10, 22), [(0.833333, 1.833333)]), (range(204), [(0, 17)]), ([203], [(16.916667, 17)]), ([], [])])
def test_segments(spark, true_at, want):
    df = spark.createDataFrame([([i in true_at for i in range(204)],)], "m array<boolean>")
    got = df.select(runs.segments(F.col("m"), STEP).alias("s")).first().s
    assert [(pytest.approx(s.start, abs=1e-5), pytest.approx(s.end, abs=1e-5)) for s in got] == want


def test_segments_of_nothing(spark):
    df = spark.createDataFrame([([],), (None,), ([None, True, None],)], "m array<boolean>")
    got = [r.s for r in df.select(runs.segments(F.col("m"), 1.0).alias("s")).collect()]
    assert [len(s or []) for s in got] == [0, 0, 1]


def test_crossing_is_interpolated(spark):
    df = spark.createDataFrame([([-2.0 if i <= 5 else 6.0 for i in range(204)],)], "y array<double>")
    got = df.select(runs.crossings(F.col("y"), lambda x: 14 + x * visibility.SPACING).alias("c")).first().c
    assert got == [pytest.approx(14.439655, abs=1e-5)]


@pytest.mark.parametrize("site", [SITE, Site(lat=-33.0, lon=150.0, min_alt=10.0), Site(lat=69.0, lon=20.0, min_alt=-5.0, sun_limit=-6.0)])
def test_records_equal_the_sampled_year(spark, site):
    rnd = random.Random(site.lat)
    rows = [(f"o{i}", rnd.uniform(0, 360), d) for i, d in enumerate([-89.0, -60.0, -20.0, 0.0, 30.0, 64.9, 80.0, 90.0])]
    objects = spark.createDataFrame(rows, "id string, ra double, dec double")
    raw = visibility.raw_visibility(objects, site)
    shape = lambda df: {
        (r.obj_id, r.day): (round(r.transit_rel, 6), round(r.q_hours, 6), round(r.m_hours, 6), [(round(s.start, 6), round(s.end, 6)) for s in r.qual_segments], r.sun_pts, r.obj_pts, r.tz_offset)
        for r in df.where(F.dayofyear("day") % 7 == 1).collect()
    }
    fast, slow = shape(visibility.daily_records(objects, site)), shape(visibility.daily_visibility(raw, site))
    assert fast == slow and len(fast) == 8 * 53
    assert all(abs(sum(e - s for s, e in v[3]) - v[1]) < 1e-4 for v in fast.values())


def test_solver_against_brute_force():
    rnd = random.Random(6)
    for _ in range(60):
        n, months, room = rnd.randint(1, 5), rnd.randint(1, 3), rnd.randint(1, 2)
        edges = [(f"o{i}", m, i % 2 == 0, round(rnd.uniform(1, 100), 3)) for i in range(n) for m in range(1, months + 1) if rnd.random() < 0.7]
        by = {(i, m): (1, int(e), v) for i, m, e, v in edges}
        best = (0, 0, 0.0)
        for choice in itertools.product([None, *range(1, months + 1)], repeat=n):
            pairs = [(f"o{i}", m) for i, m in enumerate(choice) if m]
            if all(p in by for p in pairs) and all(choice.count(m) <= room for m in range(1, months + 1)):
                best = max(best, tuple(sum(by[p][k] for p in pairs) for k in range(3)))
        got = plan.solve(edges, room)
        assert tuple(sum(by[p][k] for p in got.items()) for k in range(3)) == pytest.approx(best)


def test_cardinality_beats_quality():
    assert plan.solve([("o1", 1, True, 1.0), ("o1", 2, True, 0.8), ("o2", 1, False, 90_000.0)], 1) == {"o1": 2, "o2": 1}


def test_assignment_and_annotation(spark):
    objects = spark.createDataFrame([(f"NGC{i}", f"NGC{i}", None, "M3" if i == 1 else "", float(i)) for i in range(60)], "id string, name string, common_names string, extra_info string, score double")
    best = spark.createDataFrame([(f"NGC{i}", m, 3.0 + (i * m) % 5) for i in range(60) for m in (1, 2, 3)], "id string, month int, best_q_hours double")
    chosen = plan.assigned(plan.cost_relation(objects, best, 3.0), capacity=3)
    rows = chosen.collect()
    assert len(rows) == 27 and len({r.id for r in rows}) == 27 and {r.variant for r in rows} == {"A", "B", "C"}
    now = dt.datetime(2026, 1, 1)
    done = plan.annotated(objects, chosen, now).collect()
    assert sum(r.selected is not None for r in done) == 27 and len(done) == 60
    assert [r.n for r in plan.month_load(chosen).orderBy("month").collect()] == [9, 9, 9] + [0] * 9
    assert plan.assigned(plan.cost_relation(objects.limit(0), best, 3.0)).count() == 0


def test_first_best_night_and_pages(spark):
    d = lambda n: dt.date(2026, 1, n)
    daily = spark.createDataFrame([("a", d(1), 5.0), ("a", d(2), 5.0), ("a", d(3), 4.0)], "obj_id string, day date, m_hours double")
    assert plan.best_night(daily).first().day == d(1)
    ids = spark.createDataFrame([("b", "B"), ("a", "c"), ("c", "A")], "id string, name string")
    assert {r.id: r.page for r in plan.numbered_pages(ids).collect()} == {"a": 16, "b": 18, "c": 20}
    assert {r.id: (r.side, r.line) for r in plan.two_columns(ids).collect()} == {"c": ("left", 1), "b": ("left", 2), "a": ("right", 1)}


@pytest.mark.parametrize(("ratio", "grade"), [(0.9, "WYBITNA"), (0.8, "BARDZO DOBRA"), (0.7, "DOBRA"), (0.69, "KOMPROMISOWA")])
def test_grades(spark, ratio, grade):
    assert plan.quality_grade(spark.createDataFrame([(ratio,)], "ratio double")).first().grade == grade


def test_chart(spark):
    df = spark.createDataFrame([([(1.0, 2.0), (16.5, 17.0)], 2.0), ([(0.5, 1.0)], 0.0)], "s array<struct<start:double,end:double>>, tz double")
    got = [[(x.start, x.end) for x in r.v] for r in df.select(plan.shifted_segments(F.col("s"), F.col("tz")).alias("v")).collect()]
    assert got == [[(2.0, 3.0)], []]
    assert value(spark, plan.chart_offset(F.lit(3.5))) == 13.5 and value(spark, plan.chart_offset(F.lit(12.5))) == 0.0
