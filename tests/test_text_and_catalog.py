import pytest
from pyspark.sql import functions as F

from asterweave.functions import lookups, text
from asterweave.operators import catalog, score


def one(spark, value, **columns):
    schema = ", ".join(f"{n} {'string' if isinstance(v, (str, type(None))) else 'array<string>' if isinstance(v, list) else 'double'}" for n, v in columns.items())
    return spark.createDataFrame([tuple(columns.values())], schema).select(value.alias("v")).first().v


@pytest.mark.parametrize(
    ("raw", "ra", "want"),
    [
        ("05:34:31.94", True, 83.633083), ("-00:30:00", False, -0.5), ("+22:00:52.2", False, 22.0145), ("12:30", True, None), ("", True, None),
        ("aa:00:00", True, None), (None, True, None), ("-05:00:00", True, 75.0), (" 1 0:0:0", False, 10.0),
    ],
)
def test_sexagesimal(spark, raw, ra, want):
    got = one(spark, catalog.sexagesimal(F.col("x"), ra), x=raw)
    assert got == (pytest.approx(want, abs=1e-6) if want is not None else None)


@pytest.mark.parametrize(
    ("bands", "want"),
    [(("9.1", "8", "", "", "", "", "PN"), 9.1), (("", "14", "", "", "", "22.5", "G"), 22.5), (("", "14", "11", "", "", "", "G"), 11.0),
     (("n/a", "12", "", "", "10.5", "", "PN"), 10.5), (("", "", "", "", "", "", ""), None), (("nan", None, None, None, None, None, None), None)],
)
def test_magnitude(spark, bands, want):
    names = ("v", "b", "j", "h", "k", "s", "t")
    assert one(spark, catalog.preferred_magnitude(*(F.col(n) for n in names)), **dict(zip(names, bands, strict=True))) == want


@pytest.mark.parametrize(
    ("name", "m", "ngc", "ic", "want"),
    [("NGC0040", "", "", "", "H1,C2"), ("NGC0779", "", "", "", ""), ("NGC1952", "1", "", "", "M1"), ("IC0342", None, None, None, "C5"),
     ("X", "", "40", "", "H1,C2"), ("NGC7000", "", "", "1", ""), ("NGC12345", "", "12345", "", "")],
)
def test_famous_designations(spark, name, m, ngc, ic, want):
    got = one(spark, catalog.famous_designations(*(F.col(c) for c in ("name", "m", "ngc", "ic"))), name=name, m=m, ngc=ngc, ic=ic)
    assert got == want


def test_normalizers(spark):
    ced = spark.createDataFrame([(361.0, 1.0, "5", "nan", 10.0, 20.0, None), (2.0, 1.0, "6", "a", 10.0, 0.0, 8.0), (None, 1.0, "7", None, 1.0, None, None)], "raj2000 double, dej2000 double, ced string, m_ced string, dim1 double, dim2 double, vmag double")
    got = [(r.id, r.ra, r.size, r.mag) for r in catalog.normal_ced(ced).collect()]
    assert got == [("Ced5", 1.0, 15.0, None), ("Ced6a", 2.0, 10.0, 8.0)]
    rows = lambda s, schema: spark.createDataFrame([s], f"raj2000 double, dej2000 double, {schema}")
    assert catalog.normal_ldn(rows((1.0, 2.0, 9, 0.25), "ldn int, area double")).first().size == 30
    assert catalog.normal_pgc(rows((1.0, 2.0, 9, 90.0, 12.0), "pgc int, majaxis double, btot double")).first().size == 1.5
    sh2 = catalog.normal_sh2(rows((1.0, 2.0, 155, 50.0), "sh2 int, diam double")).first()
    assert (sh2.id, sh2.common_names, sh2.priority) == ("Sh2-155", "Cave Nebula", 2)
    parts = {"lbn": rows((1.0, 2.0, 3, 4.0), "seq int, diam1 double"), "rcw": rows((1.0, 2.0, "7", 4.0), "rcw string, majaxis double"), "barn": rows((1.0, 2.0, "33", 4.0), "barn string, diam double")}
    assert sorted(r.id for r in catalog.unified(parts).collect()) == ["B33", "LBN3", "RCW7"]


def test_filters_keep_the_unknown(spark):
    df = spark.createDataFrame([(1, 18.1, None), (2, 18.0, 0.9), (3, None, 0.89), (4, None, None), (5, float("nan"), 5.0)], "row_id int, mag double, size double")
    assert [r.row_id for r in catalog.without_trash(df).collect()] == [2, 4, 5]
    assert [r.row_id for r in catalog.targets(df).collect()] == [4, 5]


def test_names(spark):
    got = one(spark, text.distinct_names(F.col("x")), x=["The Orion Nebula", "Great Orion Nebula, orion nebula", "Trapezium", "nan", None])
    assert got == "Great Orion Nebula, Trapezium"
    assert one(spark, text.distinct_names(F.col("x")), x=[]) == ""


@pytest.mark.parametrize(("token", "loose", "strict"), [("M 33", "M", None), ("m111", None, None), ("C109", "C", "C"), ("Ced5", None, None), ("H401", None, None), ("NGC1", None, None), ("H400", "H", "H")])
def test_fame(spark, token, loose, strict):
    assert one(spark, text.fame_of(F.col("x")), x=token) == loose
    assert one(spark, text.fame_of(F.col("x"), strict=True), x=token) == strict


def test_labels_are_added_once(spark):
    labels = text.famous_labels(F.col("e"))
    named = text.name_with_labels(F.col("n"), F.col("i"), labels)
    first = one(spark, named, e="M 33, c20, H400, NGC598, M33", n="NGC0598", i="NGC0598")
    assert first == "NGC0598 (M33, C20, H400)"
    assert one(spark, named, e="M 33, c20, H400", n=first, i="NGC0598") == first


def test_best_id_and_weight(spark):
    assert one(spark, text.best_id(F.col("i"), F.col("o")), i="B33", o=["LDN1630", "Sh2-277"]) == "Sh2-277"
    for i, n, w in (("B33", "Horsehead Nebula", 10), ("LDN1", "Iceberg Cloud", 90), ("Sh2-155", "", 80)):
        assert one(spark, text.plan_weight(F.col("i"), F.col("n")), i=i, n=n) == w


def test_printed_lists(spark):
    lines = one(spark, text.designation_lines(F.col("x")), x="LDN1, M33, NGC7, Sh2-1, IC5, Zzz")
    assert lines == "NGC7, IC5, Sh2-1, LDN1, Zzz"
    many = one(spark, text.designation_lines(F.col("x")), x=", ".join(f"NGC{i:03}" for i in range(40)))
    assert len(many.split("\n")) == 3 and many.startswith("NGC000, ") and "NGC024" not in many
    assert one(spark, text.designation_lines(F.col("x")), x="") == "brak"
    assert one(spark, text.cut(F.col("x"), 12), x="abcdefghijklmnop") == "abcdefghi..."
    assert one(spark, text.whole_number(F.col("x")), x="24.0") == "24" and one(spark, text.whole_number(F.col("x")), x="x") == ""


def test_hashes(spark):
    assert one(spark, text.params_hash(F.lit(52.4095), F.lit(16.9319), year=F.lit(2026)), x="") == "ac206b38bec58b658f5c332b0a77d319"
    final = text.params_hash(F.lit(25), F.lit(-12), F.lit(52.4095), F.lit(16.9319), year=F.lit(2026))
    assert one(spark, final, x="") == "579ea8a1801a912108cc797938d33f1d"
    assert one(spark, text.params_hash(F.lit(25), F.lit(-12)), x="") == "19dd163d20f130fa481735688fb5ccf5"


def test_imputation_and_score(spark):
    df = spark.createDataFrame([("DrkN", None, None, ""), ("PN", None, 0.0, ""), ("DN", None, -1.0, ""), ("NB", 9.0, 30.0, "M1")], "type string, mag double, size double, extra_info string")
    got = [(r.mag, r.size) for r in score.imputed(df).collect()]
    assert got[:3] == [(12.0, 10.0), (11.0, 1.0), (99.0, 20.0)]
    assert [r.final_score for r in score.scored(df, narrowband=True).collect()][3] == 105
    dark = spark.createDataFrame([("DN", None, 5.0, ""), ("DrkN", None, None, "")], df.schema)
    assert [r.final_score for r in score.scored(dark).collect()] == [15.0, 20.0]
    assert score.scored(dark, bortle=5).first().final_score == 45.0


def test_soft_cut(spark):
    rows = lambda scores: spark.createDataFrame([(float(s),) for s in scores], "final_score double")
    assert score.soft_cut(rows([20] * 499)).count() == 499
    assert score.soft_cut(rows([20] * 500)).count() == 0
    assert score.soft_cut(rows([10, 10.5])).count() == 1


def test_empty_profile(spark):
    empty = spark.createDataFrame([], "id string, ra double, dec double, mag double, size double, type string, extra_info string")
    assert score.profile(empty).first().n_rows == 0
    assert [r.n for r in score.histogram(empty, "mag", score.MAG_BORDERS).collect()] == [0, 0, 0, 0]


def test_lookup_default(spark):
    assert one(spark, lookups.lookup({"a": 1}, F.col("x"), 7), x="b") == 7
