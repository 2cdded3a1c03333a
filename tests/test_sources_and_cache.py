import json

from pyspark.sql import functions as F

from asterweave.operators.cache import HashedStore, upsert
from asterweave.sources import io
from asterweave.streaming.refresh import refresh_stream


def counted(calls):
    def compute(df):
        calls.append(sorted(r.id for r in df.collect()))
        return df.withColumn("y", F.col("x") * 2)

    return compute


def test_store_computes_what_is_missing(spark, tmp_path):
    rows = lambda ids: spark.createDataFrame([(i, float(ord(i))) for i in ids], "id string, x double")
    calls = []
    path = str(tmp_path / "store")
    store = HashedStore(spark, path, "h1", ["id", "x"])
    assert store.refreshed(rows("ab"), counted(calls)).count() == 2
    assert sorted(r.id for r in store.refreshed(rows("bc"), counted(calls)).collect()) == ["b", "c"]
    assert calls == [["a", "b"], ["c"]] and store.read().count() == 3
    moved = spark.createDataFrame([("a", 1.0)], "id string, x double")
    assert store.refreshed(moved, counted(calls)).first().y == 2.0 and calls[-1] == ["a"]
    other = HashedStore(spark, path, "h2", ["id", "x"])
    assert other.refreshed(rows("bc"), counted(calls)).count() == 2 and store.read().count() == 4
    other.drop_others()
    assert store.read() is None and other.read().count() == 2
    assert other.refreshed(rows("b"), counted(calls), force=True).count() == 1 and other.read().count() == 1


def test_upsert(spark):
    old = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string")
    new = spark.createDataFrame([(2, "c"), (3, "d")], "k int, v string")
    assert sorted(tuple(r) for r in upsert(old, new, ["k"]).collect()) == [(1, "a"), (2, "c"), (3, "d")]


def test_stream_adds_only_new_objects(spark, tmp_path):
    calls = []
    store = HashedStore(spark, str(tmp_path / "store"), "h", ["id", "x"])
    source = str(tmp_path / "in")
    for batch in ("ab", "bc"):
        spark.createDataFrame([(i, float(ord(i))) for i in batch], "id string, x double").write.mode("append").parquet(source)
        stream = spark.readStream.schema("id string, x double").parquet(source)
        refresh_stream(stream, store, counted(calls), str(tmp_path / "checkpoint")).awaitTermination(60)
    assert sorted(r.id for r in store.read().collect()) == ["a", "b", "c"] and calls == [["a", "b"], ["c"]]


def test_files(spark, tmp_path):
    (tmp_path / "ngc.csv").write_text("Name;V-Mag;Common names\nNGC1;9.5;Łódka\n;;\n", encoding="utf-8")
    raw = io.read_raw_csv(spark, str(tmp_path / "ngc.csv"))
    assert raw.columns == ["name", "v_mag", "common_names"] and raw.first().common_names == "Łódka"
    df = spark.createDataFrame([("a", 1.0, float("nan"), "x, y"), ("b", 2.0, 3.0, None)], "id string, ra double, mag double, extra_info string")
    io.write_csv(df, str(tmp_path / "full"), ["id", "ra", "mag", "extra_info"])
    back = {r.id: r for r in io.read_full_catalog(spark, str(tmp_path / "full")).collect()}
    assert back["a"].mag is None and back["b"].mag == 3.0 and back["a"].extra_info == "x, y" and back["a"].dec is None
    assert io.read_optional(spark, str(tmp_path / "absent"), io.FULL_CATALOG).count() == 0


def test_document(spark, tmp_path):
    path = str(tmp_path / "vis.json")
    objects = spark.createDataFrame([("NGC1", "Żuraw", 10.0, None)], "id string, name string, ra double, selected struct<variant:string,month:int,assignment_date:string>")
    io.write_vis_document({"year": 2026, "location": {"lat": 52.0, "lon": 17.0, "tz": "Europe/Warsaw", "name": "P"}}, objects, path)
    assert "Żuraw" in open(path, encoding="utf-8").read() and json.load(open(path))["objects"][0]["selected"] is None
    config, back = io.read_vis_document(spark, path)
    assert config.first().location.lat == 52.0 and back.first().name == "Żuraw" and back.first().selected is None


def test_rendered_files_are_skipped(spark, tmp_path):
    (tmp_path / "a.png").write_bytes(b"x")
    tasks = spark.createDataFrame([("a.png",), ("b.png",)], "name string")
    assert [r.name for r in io.not_rendered(tasks, io.listed_files(spark, str(tmp_path), "*.png")).collect()] == ["b.png"]
    places = spark.createDataFrame([("Kraków", 50.06, 19.94, None)], "name string, lat double, lon double, tz string")
    assert tuple(io.location(spark, places, " kraków ").first())[1:] == (50.06, 19.94, "Europe/Warsaw")
    assert io.location(spark, places, "Nowhere").first().lat == 52.4064
