"""Scans and sinks: delimited catalogues, JSON documents, sets of files."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.utils import AnalysisException

RAW_NGC_COLUMNS = ("name", "type", "ra", "dec", "v_mag", "b_mag", "j_mag", "h_mag", "k_mag", "surfbr", "majax", "m", "ngc", "ic", "common_names")

FULL_CATALOG = T.StructType(
    [T.StructField(c, T.DoubleType() if c in ("ra", "dec", "mag", "size") else T.StringType()) for c in ("id", "extra_info", "type", "ra", "dec", "mag", "size", "common_names")]
)

VIS_DOCUMENT = (
    "location struct<lat:double,lon:double,tz:string,name:string>, year int, parameters struct<minalt:double,sunlimit:double,minhours:double,"
    "minsizearcmin:double,bortle_range:array<int>,has_narrowband:boolean,prefer_famous:boolean,camera:struct<lens_focal_length:double,"
    "sensor_pitch:double,sensor_rows:int,sensor_cols:int,sensor_width:double,sensor_height:double>>, parameters_hash string, "
    "objects array<struct<id:string,name:string,common_names:string,extra_info:string,type:string,ra:double,dec:double,mag:double,size:double,"
    "score:double,max_altitude_year:double,is_messier:boolean,is_caldwell:boolean,is_herschel:boolean,is_catalog_famous:boolean,"
    "selected:struct<variant:string,month:int,assignment_date:string>>>"
)


def snake(name: str) -> str:
    """A column name in lower case with underscores."""
    return name.strip().lower().replace("-", "_").replace(" ", "_")


def read_raw_csv(spark: SparkSession, path: str, sep: str = ";") -> DataFrame:
    """A delimited file with a header as strings, with plain column names."""
    df = spark.read.option("sep", sep).option("header", True).option("encoding", "UTF-8").csv(path)
    return df.toDF(*(snake(c) for c in df.columns))


def read_full_catalog(spark: SparkSession, path: str) -> DataFrame:
    """A unified catalogue written by ``write_csv``: typed, empty fields and NaN as null."""
    df = spark.read.option("header", True).csv(path)
    have = set(df.columns)
    cols = [(F.col(f.name) if f.name in have else F.lit(None)).cast("string").alias(f.name) for f in FULL_CATALOG]
    df = df.select(*cols)
    typed = [F.expr(f"try_cast(`{f.name}` as double)") if isinstance(f.dataType, T.DoubleType) else F.col(f.name) for f in FULL_CATALOG]
    named = [c.alias(f.name) for c, f in zip(typed, FULL_CATALOG, strict=True)]
    return df.select(*named).replace(float("nan"), None)


def read_optional(spark: SparkSession, path: str, schema: T.StructType) -> DataFrame:
    """A Parquet table, or an empty one of the schema if it can't be found."""
    try:
        return spark.read.schema(schema).parquet(path)
    except AnalysisException:
        return spark.createDataFrame([], schema)


def read_vis_document(spark: SparkSession, path: str) -> tuple[DataFrame, DataFrame]:
    """(configuration, objects) of a whole JSON document."""
    doc = spark.read.schema(VIS_DOCUMENT).option("multiLine", True).json(path)
    return doc.drop("objects"), doc.select(F.explode("objects").alias("o")).select("o.*")


def write_csv(df: DataFrame, path: str, columns: list[str]) -> None:
    """Columns in order, with a header."""
    df.select(*columns).write.mode("overwrite").option("header", True).csv(path)


def write_vis_document(config: dict, objects: DataFrame, path: str, most: int = 100_000) -> None:
    """One JSON document with non-ASCII text kept. A document is read whole, so at most ``most`` objects go into it."""
    rows = objects.select(F.to_json(F.struct("*"), {"ignoreNullFields": "false"}).alias("j")).limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} objects belong in a table, not in a document")
    with open(path, "w", encoding="utf-8") as file:
        json.dump(config | {"objects": [json.loads(r.j) for r in rows]}, file, ensure_ascii=False, indent=2)


def listed_files(spark: SparkSession, folder: str, pattern: str) -> DataFrame:
    """(name, length) of the files in a folder; an empty table if there are none."""
    try:
        files = spark.read.format("binaryFile").option("pathGlobFilter", pattern).load(folder)
        return files.select(F.element_at(F.split("path", "/"), -1).alias("name"), "length")
    except AnalysisException:
        return spark.createDataFrame([], "name string, length long")


def not_rendered(tasks: DataFrame, done: DataFrame, name: str = "name") -> DataFrame:
    """Tasks whose file is not there yet."""
    return tasks.join(done.select(F.col("name").alias(name)).distinct(), name, "left_anti")


def location(spark: SparkSession, table: DataFrame, city: str, default: tuple[float, float, str] = (52.4064, 16.9252, "Europe/Warsaw")) -> DataFrame:
    """(name, lat, lon, tz) of a city in a table of places; the default where it is not listed or has no zone."""
    found = table.where(F.lower(F.trim("name")) == city.strip().lower()).limit(1)
    one = spark.createDataFrame([(city,)], "asked string").join(found, F.lit(True), "left")
    lat, lon, tz = default
    known = F.col("lat").isNotNull() & F.col("lon").isNotNull()
    return one.select(
        F.col("asked").alias("name"), F.when(known, F.col("lat")).otherwise(lat).alias("lat"), F.when(known, F.col("lon")).otherwise(lon).alias("lon"),
        F.coalesce("tz", F.lit(tz)).alias("tz"),
    )
