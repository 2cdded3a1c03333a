from pyspark.sql import functions as F

from asterweave.operators import choose, resolve
from asterweave.operators.regions import near_pairs

NAN = float("nan")


def test_limits_and_chart_rules(spark):
    rows = [("b", 5.0, 9.0, "G", 15.9, "NGC 7"), ("a", 5.0, 9.0, " ocl ", None, "x"), ("c", 7.0, NAN, "Gx", 10.0, "IC3"), ("d", None, None, None, NAN, None), ("e", 1.0, 4000.0, "PN", 16.0, "")]
    df = spark.createDataFrame(rows, "id string, score double, size double, type string, mag double, label string")
    assert {r.id for r in choose.large_enough(df, 9.0).collect()} == {"a", "b", "e"}
    assert [r.id for r in choose.first_objects(df, 3).collect()] == ["c", "a", "b"] and choose.first_objects(df).count() == 5
    got = df.select("id", choose.drawn(F.col("type"), F.col("mag")), choose.true_size(F.col("size")), choose.outlined(F.col("size")), choose.drawn_stars(F.col("mag"))).collect()
    assert {tuple(r) for r in got} == {
        ("b", True, True, True, False), ("a", True, True, True, False), ("c", False, False, False, True), ("d", False, False, False, False), ("e", False, True, False, False)
    }


def test_labels_marks_and_months(spark):
    df = spark.createDataFrame([(" Rose , Tulip", "NGC1", "n"), (None, " ngc 12 ", "n"), ("", "B33", " dark "), (None, None, "")], "names string, id string, name string")
    assert [r[0] for r in df.select(choose.chart_label(F.col("names"), F.col("id"), F.col("name"))).collect()] == ["Rose", "NGC12", "dark", None]
    df = spark.createDataFrame([(8.0, True), (2.25, False), (None, True)], "x double, e boolean")
    assert [r[0] for r in df.select(choose.marked(F.col("x"), F.col("e"), "m")).collect()] == ["○8.0m", "●2.3m", None]
    df = spark.createDataFrame([("a", 1, 3.0), ("a", 2, 2.9), ("b", 1, None)], "id string, month int, best_q_hours double")
    assert {(r.id, r.months) for r in choose.good_months(df, 3.0).collect()} == {("a", 1), ("b", 0)}


def test_pairs_and_components_agree_over_edges(spark):
    import random

    rnd = random.Random(8)
    rows = [(i, rnd.uniform(0, 2) % 360, rnd.choice([89.0, 0.0, -89.5]) + rnd.uniform(-0.4, 0.4)) for i in range(300)] + [(900, 0.0, 0.0), (901, 360.0, 0.0), (902, None, 1.0)]
    df = spark.createDataFrame(rows, "row_id long, ra double, dec double")
    pairs = [(r.a, r.b) for r in near_pairs(df, 4.0).collect()]
    assert len(pairs) == len(set(pairs)) > 100 and (900, 901) in pairs and all(a < b for a, b in pairs)
    up = {i: i for i, *_ in rows}

    def root(i):
        return i if up[i] == i else root(up[i])

    for a, b in pairs:
        x, y = sorted((root(a), root(b)))
        up[y] = x
    assert {(r.row_id, r.component) for r in resolve.with_component(df, 4.0).collect()} == {(i, root(i)) for i, *_ in rows}
