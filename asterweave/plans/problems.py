"""Queries of the general problems: filling, regions, packed fields."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterweave.operators.impute import fill_missing, filled_cells
from asterweave.operators.regions import regions_of_points
from asterweave.operators.unpack import unpack_fields


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table of the given scale."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return filled_cells(fill_missing(table(spark, sf_dir, "katalog_astro_full")))


def p4_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fill_missing(table(spark, sf_dir, "katalog_astro_full"))


def p4_clamped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stays as observed in the filled table, with the flags of what was filled."""
    filled = p4_filled(spark, sf_dir)
    kept = (F.when(~F.col(f"{c}_filled"), F.round(c, 6) if c != "type" else F.col(c)).alias(c) for c in ("mag", "size", "type"))
    return filled.select("row_id", *kept, "mag_filled", "size_filled", "type_filled")


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return regions_of_points(table(spark, sf_dir, "katalog_astro_full"), table(spark, sf_dir, "sky_field"))


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return unpack_fields(table(spark, sf_dir, "katalog_astro_full"), ["extra_info", "common_names"], at_least=2)


QUERIES = {"p4_found": p4_found, "p4_filled": p4_filled, "p4_clamped": p4_clamped, "p5_found": p5_found, "p6_found": p6_found}

# Written out here, not taken from the code under test.
_LACKS_MAG = "mag IS NULL OR isnan(mag) OR NOT mag BETWEEN -30 AND 40"
_LACKS_SIZE = "size IS NULL OR isnan(size) OR size <= 0 OR size > 10800 OR size = 9999"
_LACKS_TYPE = """type IS NULL OR upper(trim(type)) NOT IN ('*', '**', '*ASS', 'OCL', 'GCL', 'CL+N', 'G', 'GPAIR', 'GTRPL', 'GGROUP',
    'PN', 'HII', 'DRKN', 'EMN', 'NEB', 'RFN', 'SNR', 'NOVA', 'NONEX', 'DUP', 'OTHER', 'GX', 'NB', 'DN', 'LDN', 'RCW', 'GXYP')
  AND (NOT regexp_matches(type, '[a-zA-Z0-9*]') OR lower(trim(type)) IN ('nan', 'none', 'null', 'n/a', 'unk'))"""

ORACLES = {
    "p4_found": f"""
        SELECT row_id, 'mag' AS field FROM katalog_astro_full WHERE {_LACKS_MAG}
        UNION ALL SELECT row_id, 'size' FROM katalog_astro_full WHERE {_LACKS_SIZE}
        UNION ALL SELECT row_id, 'type' FROM katalog_astro_full WHERE {_LACKS_TYPE}""",
    "p4_clamped": f"""
        SELECT row_id, CASE WHEN NOT ({_LACKS_MAG}) THEN round(mag, 6) END AS mag, CASE WHEN NOT ({_LACKS_SIZE}) THEN round(size, 6) END AS size,
          CASE WHEN NOT ({_LACKS_TYPE}) THEN upper(trim(type)) END AS type,
          ({_LACKS_MAG}) AS mag_filled, ({_LACKS_SIZE}) AS size_filled, ({_LACKS_TYPE}) AS type_filled
        FROM katalog_astro_full""",
    "p5_found": """
        WITH k AS (
          SELECT row_id, ((ra % 360) + 360) % 360 AS ra, dec FROM katalog_astro_full
          WHERE ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec) AND abs(dec) <= 90)
        SELECT row_id, field_id FROM k, sky_field f
        WHERE CASE WHEN shape = 'circle' THEN
            degrees(2 * asin(least(1, sqrt(pow(sin(radians(k.dec - f.dec) / 2), 2)
              + cos(radians(k.dec)) * cos(radians(f.dec)) * pow(sin(radians(k.ra - f.ra) / 2), 2))))) * 60 <= radius_arcmin
          ELSE k.dec BETWEEN dec_min AND dec_max AND
            CASE WHEN ra_min <= ra_max THEN k.ra BETWEEN ra_min AND ra_max ELSE k.ra >= ra_min OR k.ra <= ra_max END END""",
    "p6_found": r"""
        WITH f AS (
          SELECT row_id, 'extra_info' AS field, extra_info AS t FROM katalog_astro_full
          UNION ALL SELECT row_id, 'common_names', common_names FROM katalog_astro_full),
        s AS (SELECT row_id, field, string_split(t, '"') AS q FROM f WHERE t IS NOT NULL),
        m AS (SELECT row_id, field, array_to_string(list_transform(q, lambda x, i: CASE WHEN i % 2 = 1
            THEN regexp_replace(replace(x, ' / ', chr(1)), '[,;|\t]', chr(1), 'g') ELSE x END), '"') AS t FROM s),
        v AS (SELECT row_id, field, list_filter(list_transform(string_split(t, chr(1)), lambda x: trim(x)), lambda x: x <> '') AS v FROM m),
        c AS (SELECT row_id, field, list_transform(v, lambda x:
            CASE WHEN x[1] = '"' THEN replace(x[2:-2], '""', '"') ELSE x END) AS v FROM v)
        SELECT row_id, field, CAST(unnest(generate_series(1, len(v))) AS INTEGER) AS pos, unnest(v) AS item
        FROM c WHERE len(v) >= 2""",
}
