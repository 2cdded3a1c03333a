"""Queries of this subpackage, and SQL where it can express them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from asterweave.functions.stated import size_fillers, stated_mag, stated_size
from asterweave.llm.groups import matched_groups, tolerance_groups
from asterweave.llm.match import matched_pairs
from asterweave.llm.mixing import marginals_reached, mixed, shares_reached
from asterweave.llm.subjects import subject_shares, subjects_of
from asterweave.llm.survivors import surviving_cells, surviving_records
from asterweave.llm.tokens import counter, token_ids
from asterweave.operators.unpack import holds_value
from asterweave.runtime import materialize, small_side


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p1_matches(spark, sf_dir).select("row_id_a", "row_id_b")


def p1_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matched_pairs(_table(spark, sf_dir, "katalog_astro_full"))


FIELDS = ("mag", "size", "common_names")


def _members(spark: SparkSession, sf_dir: str, carry: tuple[str, ...] = ()) -> tuple[DataFrame, dict[str, Column]]:
    """The rows in groups, and whether each states a field."""
    rows = _table(spark, sf_dir, "katalog_astro_full")
    flags = (stated_mag(F.col("mag")).isNotNull(), stated_size(F.col("size"), size_fillers(rows)).isNotNull(), holds_value(F.col("common_names")))
    kept = [F.col(c) for c in ("priority", "updated_at", *carry)] + [flag.alias(f"has_{f}") for f, flag in zip(FIELDS, flags, strict=True)]
    return tolerance_groups(rows, carry=kept), {f: F.col(f"has_{f}") for f in FIELDS}


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surviving_cells(*_members(spark, sf_dir))


def _survivors(spark: SparkSession, sf_dir: str, by_count: bool) -> DataFrame:
    own = ("id", "catalog", "type", "ra", "dec", *FIELDS)
    best = surviving_records(*_members(spark, sf_dir, own), own, by_count)
    values = [x for f in FIELDS for x in (F.col(f"{f}_from")[f].alias(f), F.concat_ws("/", f"{f}_row", f"{f}_layer").alias(f"{f}_origin"))]
    return best.select("group_id", "row_id", *own[:5], *values)


def p2_survivors(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One surviving record for each group as the statement prefers them, with the origin of each value (row/layer, empty if none)."""
    return _survivors(spark, sf_dir, by_count=False)


def p2_layers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same with completeness by the number of fields, where deeper layers fill what the first lacks."""
    return _survivors(spark, sf_dir, by_count=True)


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tolerance_groups(_table(spark, sf_dir, "katalog_astro_full")).select("row_id", "group_id")


def p3_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The groups that the matches of problem 1 form."""
    return matched_groups(p1_matches(spark, sf_dir))


def p7_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_ids(_table(spark, sf_dir, "documents"))


def _shares(spark: SparkSession, sf_dir: str, **more: object) -> DataFrame:
    names = ("documents", "subject_label", "subject_area")
    return subject_shares(*(_table(spark, sf_dir, n) for n in names), **more)


def _labelled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return small_side(_table(spark, sf_dir, "subject_label").select("doc_id").distinct())


def p9_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p9_subjects(spark, sf_dir).join(_labelled(spark, sf_dir), "doc_id", "left_anti").drop("confidence")


def p9_subjects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The subjects of every document, with how probable they are."""
    return subjects_of(_shares(spark, sf_dir))


def p9_corpus(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The composition of the corpus: documents of each subject, labels included."""
    return subjects_of(_shares(spark, sf_dir)).groupBy("subject").agg(F.count("*").alias("docs"))


def _measured(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents with their tokens and their main subject, from one pass over the texts."""
    main = F.array_max(F.transform("shares", lambda s: F.struct(s["share"], s["subject"])))["subject"]
    each = _shares(spark, sf_dir, keep=("source", "lang"), measure=counter)
    return materialize(each.select("doc_id", "source", "lang", F.col("measured").alias("tokens"), main.alias("topic")), "measured")


def p8_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixed(_measured(spark, sf_dir), _table(spark, sf_dir, "mix_target"))


def p8_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs, targets = _measured(spark, sf_dir), _table(spark, sf_dir, "mix_target")
    return shares_reached(mixed(docs, targets), docs, targets)


def p8_marginals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The shares of languages and topics before and after the mix."""
    docs = _measured(spark, sf_dir)
    return marginals_reached(mixed(docs, _table(spark, sf_dir, "mix_target")), docs)


QUERIES = {
    "p1_found": p1_found,
    "p1_matches": p1_matches,
    "p2_found": p2_found,
    "p2_survivors": p2_survivors,
    "p2_layers": p2_layers,
    "p3_found": p3_found,
    "p3_matches": p3_matches,
    "p7_ids": p7_ids,
    "p8_mix": p8_mix,
    "p8_shares": p8_shares,
    "p8_marginals": p8_marginals,
    "p9_found": p9_found,
    "p9_subjects": p9_subjects,
    "p9_corpus": p9_corpus,
}

_GROUPS = """
    WITH RECURSIVE k AS (
      SELECT row_id, radians(((ra % 360) + 360) % 360) AS a, radians(dec) AS d FROM katalog_astro_full
      WHERE ra IS NOT NULL AND dec IS NOT NULL AND NOT isnan(ra) AND NOT isnan(dec) AND abs(dec) <= 90),
    u AS (SELECT row_id, cos(d) * cos(a) AS x, cos(d) * sin(a) AS y, sin(d) AS z FROM k),
    e AS (SELECT p.row_id AS a, q.row_id AS b FROM u p JOIN u q
          ON q.z BETWEEN p.z - 0.0002 AND p.z + 0.0002 AND p.row_id <> q.row_id
          WHERE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= pow(2 * sin(radians(0.6 / 60) / 2), 2)),
    reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    g AS (SELECT a AS row_id, least(a, min(b)) AS group_id FROM reach GROUP BY a)"""

# Written out here, not taken from the code under test.
_STATED = r"""
    , v AS (
      SELECT g.group_id, k.*, coalesce(k.priority, 2147483647) AS p, epoch_us(k.updated_at) AS since,
        coalesce(NOT isnan(k.mag) AND k.mag BETWEEN -30 AND 40, false) AS has_mag,
        coalesce(NOT isnan(k.size) AND k.size > 0 AND k.size <= 10800 AND k.size <> 9999, false) AS has_size,
        coalesce(regexp_matches(k.common_names, '\w') AND lower(trim(k.common_names)) NOT IN ('nan', 'none', 'null'), false) AS has_common_names
      FROM g JOIN katalog_astro_full k USING (row_id))"""


def _survivor_sql(source: str, layer: str) -> str:
    """One row for each group of ``source``: the first record by policy, and the first that states each field."""
    by = f"{layer}, " if layer != "1" else ""
    order = f"{by}p, since DESC NULLS LAST, row_id"
    fields = ", ".join(
        f"first({f} ORDER BY {order}) FILTER (has_{f}) AS {f}, "
        f"coalesce(first(row_id || '/' || {layer} ORDER BY {order}) FILTER (has_{f}), '') AS {f}_origin"
        for f in FIELDS
    )
    own = ", ".join(f"first({c} ORDER BY {order}) AS {c}" for c in ("row_id", "id", "catalog", "type", "ra", "dec"))
    return f"SELECT group_id, {own}, {fields} FROM {source} GROUP BY group_id"


_LAYERS = """
    , n AS (SELECT *, has_mag::INT + has_size::INT + has_common_names::INT AS stated,
        row_number() OVER (PARTITION BY group_id, p, has_mag, has_size, has_common_names ORDER BY since DESC NULLS LAST, row_id) AS version FROM v),
    r AS (SELECT * FROM n WHERE version = 1),
    dom AS (SELECT a.row_id AS above, b.row_id AS below FROM r a JOIN r b ON a.group_id = b.group_id AND a.row_id <> b.row_id
      AND a.p <= b.p AND a.stated >= b.stated
      AND (coalesce(a.since, -1e18) > coalesce(b.since, -1e18) OR coalesce(a.since, -1e18) = coalesce(b.since, -1e18) AND a.row_id < b.row_id)),
    chain AS (SELECT row_id, 1 AS layer FROM r UNION SELECT below, layer + 1 FROM chain JOIN dom ON above = row_id),
    depth AS (SELECT row_id, max(layer) AS layer FROM chain GROUP BY row_id),
    d AS (SELECT r.*, depth.layer FROM r JOIN depth USING (row_id))"""

ORACLES = {
    "p3_found": f"{_GROUPS} SELECT row_id, group_id FROM g",
    "p2_found": f"""{_GROUPS} {_STATED}
    , s AS (SELECT v.*, f.field FROM v, (VALUES ('mag'), ('size'), ('common_names')) f(field)
      WHERE CASE f.field WHEN 'mag' THEN has_mag WHEN 'size' THEN has_size ELSE has_common_names END),
    n AS (SELECT *, row_number() OVER (PARTITION BY group_id, field ORDER BY p, updated_at DESC NULLS LAST, row_id) AS rn FROM s)
    SELECT group_id, field, row_id FROM n WHERE rn = 1""",
    "p2_survivors": f"{_GROUPS} {_STATED} {_survivor_sql('v', '1')}",
    "p2_layers": f"{_GROUPS} {_STATED} {_LAYERS} {_survivor_sql('d', 'layer')}",
}
