"""Queries of the catalogue steps: parsing, tokens, merging, scoring, profile; with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterweave.functions import lookups, text
from asterweave.functions.stated import type_code
from asterweave.operators import catalog, resolve, score
from asterweave.operators.regions import near_pairs
from asterweave.plans.problems import table
from asterweave.runtime import number

QUERIES: dict = {}
ORACLES: dict[str, str] = {}


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def values(table_: dict) -> str:
    """A dictionary as rows of SQL."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)
    return ", ".join(f"({', '.join(quoted(x) for x in (k, *(v if isinstance(v, tuple) else (v,))))})" for k, v in table_.items())


def num(x: str) -> str:
    """A finite number of a text or double column in SQL."""
    return f"(CASE WHEN isfinite(try_cast({x} AS DOUBLE)) THEN try_cast({x} AS DOUBLE) END)"


def toks(x: str) -> str:
    """The tokens of a comma list in SQL."""
    return f"list_filter(list_transform(string_split(coalesce({x}, ''), ','), lambda t: trim(t)), lambda t: t <> '')"


_SEXA = r"""
    WITH p AS (SELECT *, regexp_replace(ra, '\s+', '', 'g') AS r_, regexp_replace(dec, '\s+', '', 'g') AS d_ FROM raw_ngc),
    q AS (SELECT *, string_split(regexp_replace(r_, '^[+-]', ''), ':') AS rs, string_split(regexp_replace(d_, '^[+-]', ''), ':') AS ds FROM p),
    s AS (SELECT *,
      CASE WHEN len(rs) = 3 THEN (try_cast(rs[1] AS DOUBLE) + try_cast(rs[2] AS DOUBLE) / 60 + try_cast(rs[3] AS DOUBLE) / 3600) * 15 END AS ra_deg,
      CASE WHEN len(ds) = 3 THEN (try_cast(ds[1] AS DOUBLE) + try_cast(ds[2] AS DOUBLE) / 60 + try_cast(ds[3] AS DOUBLE) / 3600)
        * CASE WHEN d_[1] = '-' THEN -1 ELSE 1 END END AS dec_deg FROM q)"""


@query(f"{_SEXA} SELECT name, round(ra_deg, 6) AS ra_deg, round(dec_deg, 6) AS dec_deg FROM s")
def q_parse_sexagesimal(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = table(spark, sf_dir, "raw_ngc")
    ra, dec = catalog.sexagesimal(F.col("ra"), True), catalog.sexagesimal(F.col("dec"), False)
    return raw.select("name", F.round(ra, 6).alias("ra_deg"), F.round(dec, 6).alias("dec_deg"))


_BANDS = ("v_mag", "b_mag", "j_mag", "h_mag", "k_mag", "surfbr")
_MAG = f"""coalesce({num('trim(v_mag)')}, CASE WHEN trim(type) = 'G' THEN {num('trim(surfbr)')} END,
      least({', '.join(num(f'trim({b})') for b in _BANDS[1:5])}))"""


@query(f"SELECT name, round({_MAG}, 4) AS mag FROM raw_ngc")
def q_magnitude_priority(spark: SparkSession, sf_dir: str) -> DataFrame:
    mag = catalog.preferred_magnitude(*(F.col(c) for c in (*_BANDS, "type")))
    return table(spark, sf_dir, "raw_ngc").select("name", F.round(mag, 4).alias("mag"))


_PAD = "CASE WHEN length({0}) < 4 THEN lpad({0}, 4, '0') ELSE {0} END"
_FAMOUS = f"""
    f AS (SELECT row_number() OVER () AS rn, *, nullif(trim(coalesce(ngc, '')), '') AS n_, nullif(trim(coalesce(ic, '')), '') AS i_,
        nullif(trim(coalesce(name, '')), '') AS o_ FROM s),
    g AS (SELECT *, coalesce('NGC' || {_PAD.format('n_')}, o_) AS hk, coalesce('NGC' || {_PAD.format('n_')}, 'IC' || {_PAD.format('i_')}, o_) AS ck FROM f),
    x AS (SELECT g.*, array_to_string(list_filter([
        'M' || CAST(CAST(trunc({num('trim(m)')}) AS INTEGER) AS VARCHAR), 'H' || CAST(h.v AS VARCHAR), 'C' || CAST(c.v AS VARCHAR)], lambda t: t IS NOT NULL), ',') AS extra
      FROM g LEFT JOIN (VALUES {values(lookups.HERSCHEL_SAMPLE)}) h(k, v) ON g.hk = h.k LEFT JOIN (VALUES {values(lookups.CALDWELL)}) c(k, v) ON g.ck = c.k)"""


@query(
    f"""{_SEXA}, {_FAMOUS}
    SELECT trim(name) AS id, extra AS extra_info, trim(type) AS type, round(ra_deg, 5) AS ra, round(dec_deg, 5) AS dec,
      round({_MAG}, 2) AS mag, round({num('trim(majax)')}, 1) AS size, '' AS base_score, trim(common_names) AS common_names
    FROM x WHERE trim(coalesce(name, '')) <> ''"""
)
def q_ngc_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.ngc_catalog(table(spark, sf_dir, "raw_ngc"))


_CED = f"""
    SELECT 'Ced' || trim(ced) || CASE WHEN lower(trim(coalesce(m_ced, ''))) IN ('nan', 'none', 'null', '-') THEN '' ELSE trim(coalesce(m_ced, '')) END AS id,
      round(((raj2000 % 360) + 360) % 360, 5) AS ra, round(dej2000, 5) AS dec,
      CASE WHEN {num('dim2')} > 0 THEN ({num('dim1')} + {num('dim2')}) / 2 ELSE {num('dim1')} END AS size, {num('vmag')} AS mag, 'NB' AS type,
      5 AS priority, 'ced' AS catalog
    FROM raw_ced WHERE isfinite(raj2000) AND isfinite(dej2000)"""
_NGC_NORMAL = f"""
    SELECT trim(name) AS id, round(((round(ra_deg, 5) % 360) + 360) % 360, 5) AS ra, round(dec_deg, 5) AS dec, round({num('trim(majax)')}, 1) AS size,
      round({_MAG}, 2) AS mag, trim(type) AS type, 1 AS priority, 'ngc' AS catalog
    FROM s WHERE trim(coalesce(name, '')) <> '' AND ra_deg IS NOT NULL AND dec_deg IS NOT NULL"""


@query(f"{_SEXA} {_NGC_NORMAL} UNION ALL {_CED}")
def q_unified_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = {"ngc": catalog.ngc_catalog(table(spark, sf_dir, "raw_ngc")), "ced": table(spark, sf_dir, "raw_ced")}
    return catalog.unified(raw).select("id", "ra", "dec", "size", "mag", "type", "priority", "catalog")


@query(f"SELECT catalog, count(*) AS n FROM ({_SEXA} {_NGC_NORMAL} UNION ALL {_CED}) GROUP BY ROLLUP (catalog)")
def q_source_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return q_unified_catalog(spark, sf_dir).rollup("catalog").agg(F.count("*").alias("n"))


@query(
    f"""SELECT row_id FROM katalog_astro_full WHERE NOT (coalesce({num('mag')} > 18, false) OR coalesce({num('size')} < 0.9, false))
      AND ({num('size')} IS NULL OR {num('size')} >= 5) AND ({num('mag')} IS NULL OR {num('mag')} <= 17)"""
)
def q_trash_target_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return catalog.targets(catalog.without_trash(table(spark, sf_dir, "katalog_astro_full"))).select("row_id")


@query(
    f"""SELECT r.name, coalesce(m.v, r.m) AS m, coalesce(c.v, r.common_names) AS common_names FROM raw_ngc r
      LEFT JOIN (VALUES {values(lookups.NAME_PATCH)}) c(k, v) ON r.name = c.k LEFT JOIN (VALUES {values(lookups.MESSIER_PATCH)}) m(k, v) ON r.name = m.k"""
)
def q_patch_by_key(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = sorted({*lookups.NAME_PATCH, *lookups.MESSIER_PATCH})
    rows = [(n, lookups.NAME_PATCH.get(n), lookups.MESSIER_PATCH.get(n)) for n in names]
    patch = spark.createDataFrame(rows, "name string, common_names string, m string")
    return catalog.patched(table(spark, sf_dir, "raw_ngc"), "name", patch, ["common_names", "m"]).select("name", "m", "common_names")


_IDS = f"list_distinct(list_filter(list_concat({toks('id')}, {toks('extra_info')}), lambda t: lower(t) <> 'nan'))"


@query(f"SELECT row_id, array_to_string(list_sort({_IDS}), ', ') AS ids FROM katalog_astro_full")
def q_tokens_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    ids = text.joined_sorted(text.id_tokens(F.array("id", "extra_info")))
    return table(spark, sf_dir, "katalog_astro_full").select("row_id", ids.alias("ids"))


def kept_names(source: str) -> str:
    """SQL for the names kept of an array of tokens."""
    bare = f"list_filter(list_transform(list_filter({source}, lambda t: lower(t) NOT IN ('nan', 'none')), lambda t: CASE WHEN starts_with(lower(t), 'the ') THEN trim(t[5:]) ELSE t END), lambda t: t <> '')"
    return f"""list_sort(list_filter(list_distinct({bare}), lambda x: len(list_filter(list_distinct({bare}),
      lambda y: y <> x AND (length(y) > length(x) OR length(y) = length(x) AND y < x) AND contains(lower(y), lower(x)))) = 0))"""


@query(f"SELECT row_id, array_to_string({kept_names(toks('common_names'))}, ', ') AS names FROM katalog_astro_full")
def q_names_dedupe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "katalog_astro_full").select("row_id", text.distinct_names(F.array("common_names")).alias("names"))


def has_famous(x: str, letter: str, strict: bool = False) -> str:
    """SQL for a token of one of the famous lists."""
    up, space = ("t", "") if strict else ("upper(t)", r"\s*")
    return rf"""len(list_filter({toks(x)}, lambda t: regexp_full_match({up}, '{letter}{space}[0-9]+')
      AND try_cast(regexp_extract(t, '([0-9]+)$', 1) AS INTEGER) BETWEEN 1 AND {lookups.FAMOUS_RANGES[letter]})) > 0"""


_FLAGS = ", ".join(f"{has_famous('extra_info', letter)} AS is_{n}" for n, letter in (("messier", "M"), ("caldwell", "C"), ("herschel", "H")))


@query(f"SELECT row_id, {_FLAGS} FROM katalog_astro_full")
def q_famous_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = text.fame_flags(F.col("extra_info"))
    return table(spark, sf_dir, "katalog_astro_full").select("row_id", *(c.alias(n) for n, c in flags.items()))


def _last(letter: str) -> str:
    own = rf"list_filter({toks('extra_info')}, lambda t: regexp_full_match(t, '{letter}[0-9]+') AND try_cast(t[2:] AS INTEGER) BETWEEN 1 AND {lookups.FAMOUS_RANGES[letter]})"
    return f"try_cast({own}[-1][2:] AS INTEGER)"


@query(f"SELECT row_id, {_last('M')} AS messier_num, {_last('C')} AS caldwell_num, {has_famous('extra_info', 'H', True)} AS has_herschel FROM katalog_astro_full")
def q_parse_extra_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = F.col("extra_info")
    return table(spark, sf_dir, "katalog_astro_full").select(
        "row_id", text.last_number(e, "M").alias("messier_num"), text.last_number(e, "C").alias("caldwell_num"),
        text.fame_flags(e, strict=True)["is_herschel"].alias("has_herschel"),
    )


_LABELS = rf"""list_filter(list_transform({toks('extra_info')}, lambda t: upper(t)), lambda t: regexp_full_match(t, '[MCH]\s*[0-9]+'))"""
_PLAIN = rf"list_transform({_LABELS}, lambda t: t[1] || regexp_replace(regexp_extract(t, '([0-9]+)$', 1), '^0+(.)', '\1'))"
_ORDERED = f"list_filter({_PLAIN}, lambda t, i: list_position({_PLAIN}, t) = i)"


@query(
    rf"""SELECT id, array_to_string({_ORDERED}, ', ') AS labels,
      CASE WHEN selected IS NULL OR len({_LABELS}) = 0 THEN name ELSE trim(coalesce(name, id)) || ' (' || array_to_string({_ORDERED}, ', ') || ')' END AS name
    FROM vis_objects"""
)
def q_append_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    labels = text.famous_labels(F.col("extra_info"))
    named = text.name_with_labels(F.col("name"), F.col("id"), labels)
    name = F.when(F.col("selected").isNotNull(), named).otherwise(F.col("name"))
    return table(spark, sf_dir, "vis_objects").select("id", F.array_join(labels, ", ").alias("labels"), name.alias("name"))


def _rank(x: str) -> str:
    cases = " ".join(f"WHEN starts_with(lower({x}), '{p}') THEN {i}" for i, p in enumerate(lookups.CATALOG_ORDER))
    return f"CASE {cases} ELSE 99 END"


@query(
    f"""SELECT row_id, (list_sort(list_transform(list_concat([trim(id)], {toks('extra_info')}), lambda t: {{'r': {_rank('t')}, 't': t}}))[1]).t AS best
    FROM katalog_astro_full WHERE id IS NOT NULL"""
)
def q_best_catalog_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "katalog_astro_full").where("id is not null")
    return rows.select("row_id", text.best_id(F.col("id"), text.tokens(F.col("extra_info"))).alias("best"))


def plan_weight_sql(ident: str, names: str) -> str:
    """SQL for the weight of an object in the plan."""
    cases = " ".join(f"WHEN starts_with(b, '{p}') THEN {w}" for p, w in lookups.PLAN_WEIGHTS.items())
    bare = f"list_transform(list_concat([coalesce({ident}, '')], string_split(regexp_replace(coalesce({names}, ''), '[()]', '', 'g'), ',')), lambda t: regexp_replace(lower(trim(t)), '[ -]', '', 'g'))"
    return f"list_max(list_transform({bare}, lambda b: CASE {cases} ELSE {lookups.PLAN_WEIGHT_OTHER} END))"


@query(f"SELECT id, {plan_weight_sql('id', 'common_names')} AS weight FROM vis_objects")
def q_catalog_weight(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vis_objects").select("id", text.plan_weight(F.col("id"), F.col("common_names")).alias("weight"))


@query()
def q_designation_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vis_objects").select("id", text.designation_lines(F.col("extra_info")).alias("designations"))


_KIND = "trim(coalesce(type, 'Other'))"


def _default(table_: dict, other: float) -> str:
    cases = " ".join(f"WHEN '{k}' THEN {v}" for k, v in table_.items())
    return f"CASE {_KIND} {cases} ELSE {other} END"


_SIZE = f"CASE WHEN {num('size')} > 0 THEN {num('size')} END"
_IMPUTED = f"""
    SELECT row_id, type, extra_info, coalesce({num('mag')}, {_default(lookups.DEFAULT_MAG, lookups.DEFAULT_MAG_OTHER)}) AS mag,
      coalesce({_SIZE}, {_default(lookups.DEFAULT_SIZE, lookups.DEFAULT_SIZE_OTHER)}) AS size,
      CASE WHEN {num('mag')} IS NULL THEN 'estimated' ELSE 'measured' END AS mag_source,
      CASE WHEN {_SIZE} IS NULL THEN 'estimated' ELSE 'measured' END AS size_source
    FROM katalog_astro_full"""


@query(f"SELECT row_id, mag, size, mag_source, size_source FROM ({_IMPUTED})")
def q_impute_provenance(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.imputed(table(spark, sf_dir, "katalog_astro_full"))
    return rows.select("row_id", "mag", "size", "mag_source", "size_source")


@query(
    f"""SELECT count(*) AS n_rows, n_mag, round(100.0 * n_mag / count(*), 4) AS pct_mag, n_size, round(100.0 * n_size / count(*), 4) AS pct_size,
      n_both, round(100.0 * n_both / count(*), 4) AS pct_both
    FROM (SELECT *, count_if(m) OVER () AS n_mag, count_if(s) OVER () AS n_size, count_if(m AND s) OVER () AS n_both
      FROM (SELECT mag_source = 'measured' AS m, size_source = 'measured' AS s FROM ({_IMPUTED}))) GROUP BY n_mag, n_size, n_both"""
)
def q_impute_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.imputation_stats(score.imputed(table(spark, sf_dir, "katalog_astro_full")))


_CODE = "upper(trim(coalesce(type, 'Other')))"
_SCORED = f"""
    SELECT i.row_id, CASE WHEN is_messier THEN 25 WHEN is_caldwell THEN 20 WHEN is_herschel THEN 15 ELSE 0 END
      + coalesce(c.f, 10) + coalesce(c.b, 10) + CASE mag_source WHEN 'measured' THEN 15 ELSE 0 END + CASE size_source WHEN 'measured' THEN 15 ELSE 0 END AS final_score
    FROM (SELECT *, {_CODE} AS code, {_FLAGS} FROM ({_IMPUTED})) i
    LEFT JOIN (VALUES {values({k: (v[0], v[3]) for k, v in lookups.SCORECARD.items()})}) c(k, f, b) ON i.code = c.k"""


@query(f"SELECT row_id, CAST(final_score AS DOUBLE) AS final_score FROM ({_SCORED})")
def q_scorecard(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.scored(table(spark, sf_dir, "katalog_astro_full")).select("row_id", "final_score")


@query(
    f"""WITH s AS (SELECT row_id, CAST(final_score AS DOUBLE) AS final_score FROM ({_SCORED}) WHERE final_score > 10)
    SELECT * FROM s WHERE (SELECT count(*) FROM s) < 500 OR final_score > (SELECT quantile_cont(final_score, 0.3) FROM s)"""
)
def q_soft_cut(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.soft_cut(q_scorecard(spark, sf_dir))


@query(
    f"""SELECT plate, row_id FROM (SELECT plate, row_id, row_number() OVER (PARTITION BY plate ORDER BY priority, {num('size')} DESC NULLS LAST, row_id) AS rn
      FROM katalog_astro_full) WHERE rn = 1"""
)
def q_leader_pick(spark: SparkSession, sf_dir: str) -> DataFrame:
    size = number(F.col("size"))
    order = F.struct("priority", size.isNull(), -size, "row_id")
    return table(spark, sf_dir, "katalog_astro_full").groupBy("plate").agg(F.min_by("row_id", order).alias("row_id"))


@query(
    f"""SELECT l_suppkey, coalesce(max(CASE WHEN x <= 300 THEN x END), CASE WHEN count(x) > 0 THEN 300 END) AS size
    FROM (SELECT l_suppkey, l_quantity * 10 + 150 AS x FROM lineitem) GROUP BY l_suppkey"""
)
def q_capped_max(spark: SparkSession, sf_dir: str) -> DataFrame:
    x = F.col("l_quantity") * 10 + 150
    return table(spark, sf_dir, "lineitem").groupBy("l_suppkey").agg(resolve.capped_size(x, F.lit(None).cast("double")).alias("size"))


def near_sql(arcmin: float) -> str:
    """SQL for pairs of rows within a distance, as CTEs ending in e(a, b)."""
    reach = 2.0 * arcmin / 3437.0
    return f"""k AS (
      SELECT row_id, radians(((ra % 360) + 360) % 360) AS a, radians(dec) AS d FROM katalog_astro_full
      WHERE isfinite(ra) AND isfinite(dec) AND abs(dec) <= 90),
    u AS (SELECT row_id, cos(d) * cos(a) AS x, cos(d) * sin(a) AS y, sin(d) AS z FROM k),
    e AS (SELECT p.row_id AS a, q.row_id AS b, pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) AS d2 FROM u p JOIN u q
          ON q.z BETWEEN p.z - {reach} AND p.z + {reach} AND p.row_id <> q.row_id
          WHERE pow(p.x - q.x, 2) + pow(p.y - q.y, 2) + pow(p.z - q.z, 2) <= pow(2 * sin(radians({arcmin} / 60) / 2), 2))"""


@query(f"WITH {near_sql(1.5)} SELECT a, b, round(degrees(2 * asin(sqrt(d2) / 2)) * 60, 6) AS sep_arcmin FROM e WHERE a < b")
def q_spatial_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    pairs = near_pairs(table(spark, sf_dir, "katalog_astro_full"), 1.5)
    return pairs.select("a", "b", F.round("sep_arcmin", 6).alias("sep_arcmin"))


_COMPONENTS = f"""WITH RECURSIVE {near_sql(1.5)},
    reach AS (SELECT a, b FROM e UNION SELECT r.a, e.b FROM reach r JOIN e ON r.b = e.a),
    l AS (SELECT a AS row_id, least(a, min(b)) AS component FROM reach GROUP BY a),
    c AS (SELECT k.*, coalesce(l.component, k.row_id) AS component FROM katalog_astro_full k LEFT JOIN l USING (row_id))"""


@query(f"{_COMPONENTS} SELECT row_id, component FROM c")
def q_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return resolve.with_component(table(spark, sf_dir, "katalog_astro_full"), 1.5).select("row_id", "component")


@query(
    f"""{_COMPONENTS},
    r AS (SELECT *, {num('size')} AS s, row_number() OVER (PARTITION BY component ORDER BY priority, {num('size')} DESC NULLS LAST, row_id) AS rn FROM c),
    a AS (SELECT component, max(CASE WHEN s <= 300 THEN s END) AS small, count(s) AS n_s, count(*) AS members,
        flatten(list({toks('id')})) AS ids, flatten(list({toks('extra_info')})) AS extras, flatten(list({toks('common_names')})) AS names FROM r GROUP BY component),
    j AS (SELECT a.*, trim(l.id) AS lead, l.s AS own, l.mag, l.type FROM a JOIN r l ON a.component = l.component AND l.rn = 1)
    SELECT component, lead AS id, coalesce(small, CASE WHEN n_s > 0 THEN 300 END, own) AS size, type, members,
      array_to_string(list_sort(list_distinct(list_concat(list_filter(ids, lambda t: lower(t) <> 'nan' AND t IS DISTINCT FROM lead),
        list_filter(extras, lambda t: lower(t) <> 'nan')))), ', ') AS extra_info,
      array_to_string({kept_names('names')}, ', ') AS common_names FROM j"""
)
def q_smart_merge(spark: SparkSession, sf_dir: str) -> DataFrame:
    merged = resolve.smart_merge(table(spark, sf_dir, "katalog_astro_full"), 1.5)
    return merged.select("component", "id", "size", "type", "members", "extra_info", "common_names")


@query()
def q_greedy_cover(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = score.scored(table(spark, sf_dir, "katalog_astro_full")).where(number(F.col("ra")).isNotNull() & number(F.col("dec")).isNotNull())
    return resolve.atlas_frames(rows.select("row_id", "id", "ra", "dec", "size", "extra_info", "common_names", "final_score"))


_M, _S = num("mag"), num("size")


def _stats(name: str, x: str) -> str:
    return f"""count({x}) AS {name}_present, count(*) - count({x}) AS {name}_missing, round(100.0 * count({x}) / count(*), 4) AS {name}_present_pct,
      min({x}) AS {name}_min, max({x}) AS {name}_max, round(avg({x}), 6) AS {name}_mean, median({x}) AS {name}_median"""


@query(
    f"""SELECT count(*) AS n_rows, {_stats('mag', _M)}, {_stats('size', _S)},
      {', '.join(f'round(quantile_cont({_S}, {q / 100}), 6) AS size_p{q}' for q in (25, 50, 75, 90))},
      count_if({num('ra')} IS NOT NULL AND {num('dec')} IS NOT NULL) AS positioned,
      count_if({_M} IS NOT NULL AND {_S} IS NOT NULL) AS complete, count_if({_M} IS NOT NULL AND {_S} IS NULL) AS mag_without_size,
      count_if({_M} IS NULL AND {_S} IS NOT NULL) AS size_without_mag, count_if({_S} > 10 AND {_M} IS NULL) AS large_without_mag,
      count_if({_M} < 10 AND {_S} IS NULL) AS bright_without_size, count_if(nullif(trim(type), '') IS NULL) AS without_type,
      round(100.0 * count_if({_S} < 18) / count({_S}), 4) AS too_small_pct FROM katalog_astro_full"""
)
def q_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.profile(table(spark, sf_dir, "katalog_astro_full"))


def _histogram_sql(x: str, borders: tuple[float, ...]) -> str:
    bucket = " + ".join(f"CASE WHEN x >= {b} THEN 1 ELSE 0 END" for b in borders)
    return f"""WITH v AS (SELECT {x} AS x FROM katalog_astro_full), c AS (SELECT {bucket} AS bucket, count(*) AS n FROM v WHERE x IS NOT NULL GROUP BY 1)
      SELECT CAST(g.b AS INTEGER) AS bucket, coalesce(n, 0) AS n, round(100.0 * coalesce(n, 0) / (SELECT sum(n) FROM c), 4) AS pct
      FROM generate_series(0, {len(borders)}) g(b) LEFT JOIN c ON c.bucket = g.b"""


@query(_histogram_sql(_M, score.MAG_BORDERS))
def q_histogram_mag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.histogram(table(spark, sf_dir, "katalog_astro_full"), "mag", score.MAG_BORDERS)


@query(_histogram_sql(_S, score.SIZE_BORDERS))
def q_histogram_size(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.histogram(table(spark, sf_dir, "katalog_astro_full"), "size", score.SIZE_BORDERS)


@query("SELECT type AS value, count(*) AS n FROM katalog_astro_full WHERE type IS NOT NULL GROUP BY type ORDER BY n DESC, value LIMIT 20")
def q_value_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.value_counts(table(spark, sf_dir, "katalog_astro_full"), "type")


@query(
    f"""SELECT {', '.join(f"count_if({has_famous('extra_info', x, True)}) AS n_{n}" for n, x in (('messier', 'M'), ('caldwell', 'C'), ('herschel', 'H')))}
    FROM katalog_astro_full"""
)
def q_famous_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score.famous_counts(table(spark, sf_dir, "katalog_astro_full"))


_LABEL = " ".join(f"WHEN '{k}' THEN '{v}'" for k, v in lookups.TYPE_LABELS.items())
_NONBLANK = "coalesce(nullif(trim(common_names), ''), nullif(trim(name), ''), nullif(trim(id), ''))"


@query(
    f"""SELECT id, {_NONBLANK} AS shown, CASE WHEN length({_NONBLANK}) > 40 THEN left({_NONBLANK}, 37) || '...' ELSE {_NONBLANK} END AS short,
      coalesce(CASE trim(type) {_LABEL} END, type, 'Inny') AS type_label FROM vis_objects"""
)
def q_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    shown = text.display_name(F.col("common_names"), F.col("name"), F.col("id"))
    label = F.coalesce(lookups.lookup(lookups.TYPE_LABELS, F.trim("type")), F.col("type"), F.lit("Inny"))
    return table(spark, sf_dir, "vis_objects").select("id", shown.alias("shown"), text.cut(shown, 40).alias("short"), label.alias("type_label"))


@query("SELECT o_orderkey, replace(printf('%,d', CAST(o_orderkey * 977 AS BIGINT)), ',', ' ') AS shown FROM orders")
def q_thousands(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").select("o_orderkey", text.thousands(F.col("o_orderkey") * 977).alias("shown"))


@query("SELECT name, coalesce(CAST(CAST(trunc(CASE WHEN isfinite(try_cast(trim(m) AS DOUBLE)) THEN try_cast(trim(m) AS DOUBLE) END) AS INTEGER) AS VARCHAR), '') AS m FROM raw_ngc")
def q_messier_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "raw_ngc").select("name", text.whole_number(F.col("m")).alias("m"))


@query(
    """SELECT o_orderkey, md5(printf('%.6f', o_totalprice) || '|' || printf('%.6f', CAST(o_custkey AS DOUBLE)) || '|2026') AS hash
    FROM orders"""
)
def q_params_hash(spark: SparkSession, sf_dir: str) -> DataFrame:
    h = text.params_hash(F.col("o_totalprice"), F.col("o_custkey"), year=F.lit(2026))
    return table(spark, sf_dir, "orders").select("o_orderkey", h.alias("hash"))


@query(
    """SELECT upper(trim(type)) AS code, count(*) AS n FROM katalog_astro_full
    WHERE regexp_matches(type, '[a-zA-Z0-9*]') AND lower(trim(type)) NOT IN ('nan', 'none', 'null', 'n/a', 'unk') GROUP BY 1"""
)
def q_type_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    code = type_code(F.col("type")).alias("code")
    return table(spark, sf_dir, "katalog_astro_full").groupBy(code).agg(F.count("*").alias("n")).where("code is not null")
