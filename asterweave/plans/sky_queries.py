"""Queries of the visibility, plan and page steps, and of relational building blocks; with equivalent SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from asterweave.functions import ephem
from asterweave.operators import cache, choose, pages, plan, runs, visibility
from asterweave.operators.visibility import SAMPLES, SPACING, STEP, Site
from asterweave.plans.catalog_queries import plan_weight_sql
from asterweave.plans.problems import table
from asterweave.runtime import materialize

QUERIES: dict = {}
ORACLES: dict[str, str] = {}
SITE = Site()


def query(sql: str | None = None):
    """Register a query under its function's name, with its SQL if it has one."""

    def add(f):
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLES[f.__name__] = sql
        return f

    return add


def mod360(x: str) -> str:
    """A number modulo 360 in SQL."""
    return f"(((({x}) % 360) + 360) % 360)"


def gmst_sql(jd: str) -> str:
    """Sidereal time in SQL."""
    d, t = f"({jd} - 2451545.0)", f"(({jd} - 2451545.0) / 36525.0)"
    return mod360(f"280.46061837 + 360.98564736629 * {d} + 0.000387933 * {t} * {t} - {t} * {t} * {t} / 38710000.0")


def sun_sql(jd: str) -> tuple[str, str]:
    """Right ascension and declination of the Sun in SQL."""
    n = f"({jd} - 2451545.0)"
    g = f"radians({mod360(f'357.528 + 0.9856003 * {n}')})"
    lam = f"radians({mod360(f'280.460 + 0.9856474 * {n}')} + 1.915 * sin({g}) + 0.020 * sin(2 * {g}))"
    return _equatorial_sql(lam, "0.0", n)


def moon_sql(jd: str) -> tuple[str, str]:
    """Right ascension and declination of the Moon in SQL."""
    n, t = f"({jd} - 2451545.0)", f"(({jd} - 2451545.0) / 36525.0)"
    s = lambda a, b: f"sin(radians({a} + {b} * {t}))"
    lam = (
        f"218.32 + 481267.881 * {t} + 6.29 * {s(135.0, 477198.87)} - 1.27 * {s(259.3, -413335.36)} + 0.66 * {s(235.7, 890534.22)}"
        f" + 0.21 * {s(269.9, 954397.74)} - 0.19 * {s(357.5, 35999.05)} - 0.11 * {s(186.5, 966404.03)}"
    )
    beta = f"5.13 * {s(93.3, 483202.02)} + 0.28 * {s(228.2, 960400.89)} - 0.28 * {s(318.3, 6003.15)} - 0.17 * {s(217.6, -407332.21)}"
    return _equatorial_sql(f"radians({mod360(lam)})", f"radians({beta})", n)


def _equatorial_sql(lam: str, beta: str, n: str) -> tuple[str, str]:
    eps = f"radians(23.439 - 0.0000004 * {n})"
    y = f"cos({eps}) * cos({beta}) * sin({lam}) - sin({eps}) * sin({beta})"
    z = f"sin({eps}) * cos({beta}) * sin({lam}) + cos({eps}) * sin({beta})"
    return mod360(f"degrees(atan2({y}, cos({beta}) * cos({lam})))"), f"degrees(asin({z}))"


def alt_sql(lst: str, ra: str, dec: str, lat: float = SITE.lat) -> str:
    """Altitude in SQL."""
    return f"degrees(asin(greatest(-1, least(1, sin(radians({dec})) * sin(radians({lat})) + cos(radians({dec})) * cos(radians({lat})) * cos(radians({lst} - {ra}))))))"


_JD = "(epoch_us(ts) / 86400000000.0 + 2440587.5)"


@query(
    f"""WITH j AS (SELECT event_id, {_JD} AS jd FROM events)
    SELECT event_id, round({gmst_sql('jd')}, 5) AS gmst, round({sun_sql('jd')[0]}, 5) AS sun_ra, round({sun_sql('jd')[1]}, 5) AS sun_dec,
      round({moon_sql('jd')[0]}, 5) AS moon_ra, round({moon_sql('jd')[1]}, 5) AS moon_dec FROM j"""
)
def q_ephemeris(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", ephem.julian_date(F.col("ts")).alias("jd"))
    jd = F.col("jd")
    (sa, sd), (ma, md) = ephem.sun(jd), ephem.moon(jd)
    named = {"gmst": ephem.gmst(jd), "sun_ra": sa, "sun_dec": sd, "moon_ra": ma, "moon_dec": md}
    return e.select("event_id", *(F.round(c, 5).alias(n) for n, c in named.items()))


@query(
    f"""WITH j AS (SELECT event_id, {_JD} AS jd FROM events), a AS (SELECT event_id,
      {alt_sql(f"{mod360(gmst_sql('jd') + f' + {SITE.lon}')}", sun_sql('jd')[0], sun_sql('jd')[1])} AS h FROM j)
    SELECT event_id, round(h, 5) AS sun_alt, CASE WHEN h > 0 THEN 'day' WHEN h > -6 THEN 'civil' WHEN h > -12 THEN 'nautical' WHEN h > -18 THEN 'astronomical' ELSE 'night' END AS band
    FROM a"""
)
def q_twilight(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("event_id", ephem.julian_date(F.col("ts")).alias("jd"))
    ra, dec = ephem.sun(F.col("jd"))
    h = ephem.altitude(ephem.local_sidereal(F.col("jd"), SITE.lon), ra, dec, SITE.lat)
    return e.select("event_id", F.round(h, 5).alias("sun_alt"), ephem.twilight(h).alias("band"))


@query(f"SELECT id, round(90 - abs({SITE.lat} - dec), 6) AS max_alt FROM vis_objects WHERE abs(dec - {SITE.lat}) <= 90 - {SITE.min_alt}")
def q_geometric_prefilter(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = visibility.reachable(table(spark, sf_dir, "vis_objects"), SITE)
    return rows.select("id", F.round(ephem.highest_altitude(F.col("dec"), SITE.lat), 6).alias("max_alt"))


_NIGHTS = f"""
    days AS (SELECT unnest(generate_series(DATE '{SITE.year}-01-01', DATE '{SITE.year}-12-31', INTERVAL 1 DAY))::DATE AS day),
    noon AS (SELECT day, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) + 2440588.0 AS noon FROM days),
    scan AS (SELECT day, noon, i, noon + i * (2 / 1440.0::DOUBLE) AS jd FROM noon, generate_series(0, 1440) g(i)),
    h AS (SELECT day, noon, i, {alt_sql(f"{mod360(gmst_sql('jd') + f' + {SITE.lon}')}", sun_sql('jd')[0], sun_sql('jd')[1])} - ({SITE.sun_limit}) AS y0 FROM scan),
    p AS (SELECT *, lead(y0) OVER (PARTITION BY day ORDER BY i) AS y1 FROM h),
    x AS (SELECT *, noon + (i + y0 / (y0 - y1)) * (2 / 1440.0::DOUBLE) AS jd FROM p WHERE y1 IS NOT NULL AND (y0 < 0) <> (y1 < 0)),
    dusk AS (SELECT day, min(i) AS i, arg_min(jd, i) AS dusk FROM x WHERE y0 >= 0 GROUP BY day),
    dawn AS (SELECT d.day, d.dusk, arg_min(x.jd, x.i) AS dawn FROM dusk d JOIN x ON x.day = d.day AND x.i > d.i AND x.y0 < 0 GROUP BY d.day, d.dusk),
    nights AS (SELECT row_number() OVER (ORDER BY day) - 1 AS night_id, dusk, dawn FROM dawn),
    grid AS (SELECT night_id, dusk + i * (15 / 1440.0::DOUBLE) AS jd FROM nights, generate_series(0, 100) g(i)
      WHERE i < ceil((dawn - dusk) / (15 / 1440.0::DOUBLE) - 1e-9)),
    lst AS (SELECT night_id, jd, month(make_timestamp(CAST(trunc((jd - 2440587.5) * 86400000000.0) AS BIGINT))) - 1 AS month,
      {mod360(gmst_sql('jd') + f' + {SITE.lon}')} AS lst FROM grid)"""


@query(f"WITH {_NIGHTS} SELECT CAST(night_id AS INTEGER) AS night_id, round(jd, 5) AS jd, CAST(month AS INTEGER) AS month, round(lst, 3) AS lst FROM lst")
def q_night_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.night_grid(spark, SITE).select("night_id", F.round("jd", 5).alias("jd"), "month", F.round("lst", 3).alias("lst"))


_SEEN = f"""
    v AS (SELECT id, night_id, month, count(*) * 0.25 AS hours FROM vis_objects, lst
      WHERE abs(dec - {SITE.lat}) <= 90 - {SITE.min_alt} AND {alt_sql('lst', 'ra', 'dec')} >= {SITE.min_alt} GROUP BY ALL)"""


@query(f"WITH {_NIGHTS}, {_SEEN} SELECT id, CAST(night_id AS INTEGER) AS night_id, CAST(month AS INTEGER) AS month, CAST(hours AS DOUBLE) AS hours FROM v")
def q_hours_by_night(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = visibility.reachable(table(spark, sf_dir, "vis_objects"), SITE)
    return visibility.hours_by_night(objects, visibility.night_grid(spark, SITE), SITE)


@query(
    f"""WITH {_NIGHTS}, {_SEEN}, n AS (SELECT id, night_id, sum(hours) AS hours FROM v GROUP BY ALL),
    k AS (SELECT id, count_if(hours >= {SITE.min_hours}) AS nights FROM n GROUP BY id),
    m AS (SELECT id, {', '.join(f'CAST(coalesce(sum(hours) FILTER (month = {m}), 0) AS DOUBLE) AS m{m}' for m in range(12))} FROM v GROUP BY id)
    SELECT k.id, nights, m.* EXCLUDE (id) FROM k JOIN m USING (id) WHERE nights > 0"""
)
def q_yearly_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = visibility.reachable(table(spark, sf_dir, "vis_objects"), SITE)
    return visibility.yearly_visibility(objects, visibility.night_grid(spark, SITE), SITE)


@query()
def q_raw_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = visibility.raw_visibility(table(spark, sf_dir, "vis_objects"), SITE)
    return raw.select("obj_id", "day", F.round(F.array_max("alt"), 4).alias("max_alt"), F.size("obj_pts").alias("crossings"))


_T = "((noon - 2451545.0) / 36525.0)"
_ZETA = f"radians((2306.2181 * {_T} + 0.30188 * {_T} * {_T} + 0.017998 * {_T} * {_T} * {_T}) / 3600.0)"
_ZED = f"radians((2306.2181 * {_T} + 1.09468 * {_T} * {_T} + 0.018203 * {_T} * {_T} * {_T}) / 3600.0)"
_THETA = f"radians((2004.3109 * {_T} - 0.42665 * {_T} * {_T} - 0.041833 * {_T} * {_T} * {_T}) / 3600.0)"
_DAILY = f"""
    days AS (SELECT unnest(generate_series(DATE '{SITE.year}-01-01', DATE '{SITE.year}-12-31', INTERVAL 1 DAY))::DATE AS day),
    noon AS (SELECT day, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) + 2440588.0 AS noon FROM days),
    g AS (SELECT day, noon, i, noon + (2.0::DOUBLE + i * {SPACING!r}::DOUBLE) / 24.0::DOUBLE AS jd FROM noon, generate_series(0, {SAMPLES - 1}) s(i)),
    sky AS (SELECT day, i, {mod360(gmst_sql('jd') + f' + {SITE.lon}')} AS lst,
      {alt_sql(f"{mod360(gmst_sql('jd') + f' + {SITE.lon}')}", sun_sql('jd')[0], sun_sql('jd')[1])} AS sun,
      {alt_sql(f"{mod360(gmst_sql('jd') + f' + {SITE.lon}')}", moon_sql('jd')[0], moon_sql('jd')[1])} AS moon FROM g),
    o AS (SELECT id, day, {_ZED} AS z, cos(radians(dec)) * sin(radians(ra) + {_ZETA}) AS p,
      cos({_THETA}) * cos(radians(dec)) * cos(radians(ra) + {_ZETA}) - sin({_THETA}) * sin(radians(dec)) AS q,
      sin({_THETA}) * cos(radians(dec)) * cos(radians(ra) + {_ZETA}) + cos({_THETA}) * sin(radians(dec)) AS r FROM vis_objects, noon),
    c AS (SELECT id, day, {mod360('degrees(atan2(p, q) + z)')} AS ra, degrees(asin(greatest(-1, least(1, r)))) AS dec FROM o),
    a AS (SELECT id, day, i, {alt_sql('lst', 'ra', 'dec')} AS alt, sun, moon FROM c JOIN sky USING (day)),
    d AS (SELECT id, day, arg_max(i, (alt, -i)) * {STEP!r}::DOUBLE AS transit_rel, count_if(alt > {SITE.min_alt} AND sun < {SITE.sun_limit}) * {STEP!r}::DOUBLE AS q_hours,
      count_if(alt > {SITE.min_alt} AND sun < {SITE.sun_limit} AND moon < 0) * {STEP!r}::DOUBLE AS m_hours FROM a GROUP BY id, day)"""


@query(f"WITH {_DAILY} SELECT id AS obj_id, day, round(transit_rel, 6) AS transit_rel, round(q_hours, 6) AS q_hours, round(m_hours, 6) AS m_hours FROM d")
def q_daily_visibility(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = visibility.daily_records(table(spark, sf_dir, "vis_objects"), SITE)
    return daily.select("obj_id", "day", *(F.round(c, 6).alias(c) for c in ("transit_rel", "q_hours", "m_hours")))


@query(
    f"""WITH {_DAILY}, best AS (SELECT id, month(day) AS month, max(q_hours) AS q FROM d GROUP BY ALL)
    SELECT id, CAST(month AS INTEGER) AS month, round(q, 6) AS best_q_hours FROM best"""
)
def q_monthly_best(spark: SparkSession, sf_dir: str) -> DataFrame:
    daily = visibility.daily_records(table(spark, sf_dir, "vis_objects"), SITE)
    return plan.monthly_best(daily).select("id", "month", F.round("best_q_hours", 6).alias("best_q_hours"))


@query(
    f"""WITH days AS (SELECT unnest(generate_series(DATE '{SITE.year}-01-01', DATE '{SITE.year}-12-31', INTERVAL 1 DAY))::DATE AS day),
    n AS (SELECT day, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) + 2440588.0 AS jd FROM days WHERE day(day) <= 28),
    p AS (SELECT day, radians({sun_sql('jd')[0]}) AS a1, radians({sun_sql('jd')[1]}) AS d1, radians({moon_sql('jd')[0]}) AS a2, radians({moon_sql('jd')[1]}) AS d2 FROM n),
    s AS (SELECT day, degrees(2 * asin(least(1, sqrt(pow(sin((d2 - d1) / 2), 2) + cos(d1) * cos(d2) * pow(sin((a2 - a1) / 2), 2))))) AS sep FROM p)
    SELECT CAST(month(day) AS INTEGER) AS month, arg_min(day, (sep, day)) AS day, round(min(sep), 3) AS separation FROM s GROUP BY 1"""
)
def q_darkest_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.darkest_day(spark, SITE.year).select("month", "day", F.round("separation", 3).alias("separation"))


@query(
    f"""WITH days AS (SELECT unnest(generate_series(DATE '{SITE.year}-01-01', DATE '{SITE.year}-12-31', INTERVAL 1 DAY))::DATE AS day),
    s AS (SELECT day, CAST(date_diff('day', DATE '1970-01-01', day) AS DOUBLE) + 2440587.5 + i * (5.0::DOUBLE / 1440) AS jd FROM days, generate_series(0, 287) g(i)),
    n AS (SELECT day, count_if({alt_sql(f"{mod360(gmst_sql('jd') + f' + {SITE.lon}')}", sun_sql('jd')[0], sun_sql('jd')[1])} < {SITE.sun_limit}) * 5 AS n FROM s GROUP BY day)
    SELECT day, CAST(n // 60 AS INTEGER) AS hours, CAST(n % 60 AS INTEGER) AS minutes FROM n"""
)
def q_night_lengths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.night_lengths(spark, SITE)


_VALUE_STEP = 0.5


@query(
    f"""WITH e AS (SELECT user_id, event_id, value > 15 AS m, lag(value > 15) OVER (PARTITION BY user_id ORDER BY event_id) AS before FROM events),
    r AS (SELECT *, sum(CASE WHEN m AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY event_id) AS run FROM e)
    SELECT user_id, min(event_id) AS "start", max(event_id) AS "end", count(*) AS n FROM r WHERE m GROUP BY user_id, run"""
)
def q_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return runs.row_segments(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value") > 15)


@query(
    """WITH e AS (SELECT user_id, CAST(event_id AS DOUBLE) AS o, value - 15.005 AS y, lead(CAST(event_id AS DOUBLE)) OVER w AS o2, lead(value - 15.005) OVER w AS y2
      FROM events WINDOW w AS (PARTITION BY user_id ORDER BY event_id))
    SELECT user_id, round(o + y / (y - y2) * (o2 - o), 4) AS at FROM e WHERE (y < 0) <> (y2 < 0)"""
)
def q_crossings(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = runs.row_crossings(table(spark, sf_dir, "events"), ["user_id"], "event_id", F.col("value"), 15.005)
    return found.select("user_id", F.round("at", 4).alias("at"))


@query(
    """WITH e AS (SELECT user_id, list(value > 15 ORDER BY event_id) AS m FROM events GROUP BY user_id)
    SELECT user_id, len(list_filter(m, lambda x: x)) * 0.5::DOUBLE AS total FROM e"""
)
def q_array_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    lists = table(spark, sf_dir, "events").groupBy("user_id").agg(F.array_sort(F.collect_list(F.struct("event_id", "value"))).alias("s"))
    lists = materialize(lists.select("user_id", F.transform("s", lambda x: x["value"] > 15).alias("mask")), "masks")
    found = runs.segments(F.col("mask"), _VALUE_STEP)
    total = F.aggregate(found, F.lit(0.0), lambda a, s: a + s["end"] - s["start"])
    return lists.select("user_id", total.alias("total"))


_LATEST = """b AS (SELECT id, month, arg_max(best_q_hours, (computed_at, best_q_hours)) AS best_q_hours FROM monthly_best
      WHERE best_q_hours IS NOT NULL AND NOT isnan(best_q_hours) GROUP BY ALL)"""


@query(f"WITH {_LATEST} SELECT * FROM b")
def q_latest_monthly(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.latest_monthly(table(spark, sf_dir, "monthly_best"))


_COST = f"""{_LATEST},
    m AS (SELECT median(coalesce(score, 0)) AS median FROM vis_objects),
    t AS (SELECT id, max(best_q_hours) AS top FROM b GROUP BY id),
    c AS (SELECT b.id, month, best_q_hours AS hours, best_q_hours / top AS ratio, coalesce(score, 0) > median AS elite, coalesce(score, 0) AS score,
        CASE WHEN coalesce(score, 0) > median THEN pow(coalesce(score, 0), 3) * (best_q_hours / top)
          ELSE {plan_weight_sql('o.id', 'common_names')} * 1000.0 + best_q_hours / top * 100 END AS value
      FROM b JOIN t USING (id) JOIN vis_objects o USING (id), m WHERE best_q_hours >= {SITE.min_hours} AND top > 0)"""


@query(f"WITH {_COST} SELECT id, month, hours, round(ratio, 6) AS ratio, elite, round(CAST(value AS DOUBLE), 4) AS value, score FROM c")
def q_cost_relation(spark: SparkSession, sf_dir: str) -> DataFrame:
    cost = _cost(spark, sf_dir)
    return cost.select("id", "month", "hours", F.round("ratio", 6).alias("ratio"), "elite", F.round("value", 4).alias("value"), "score")


def _cost(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.cost_relation(table(spark, sf_dir, "vis_objects"), plan.latest_monthly(table(spark, sf_dir, "monthly_best")), SITE.min_hours)


@query()
def q_assignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.assigned(_cost(spark, sf_dir))


@query()
def q_month_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.month_load(plan.assigned(_cost(spark, sf_dir)))


@query()
def q_quality_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.quality_grade(plan.assigned(_cost(spark, sf_dir)))


def _planned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stored plan: month and score of each planned object, with what its month has of its best hours."""
    rows = table(spark, sf_dir, "vis_objects").where("selected is not null")
    hours = plan.latest_monthly(table(spark, sf_dir, "monthly_best"))
    most = hours.groupBy("id").agg(F.max("best_q_hours").alias("most"))
    own = rows.select("id", F.col("selected.variant").alias("variant"), F.col("selected.month").alias("month"), "score")
    ratio = F.col("best_q_hours") / F.nullif(F.col("most"), F.lit(0.0))
    return own.join(hours, ["id", "month"]).join(most, "id").select("variant", "month", "id", ratio.alias("ratio"), "score")


_PLANNED = f"""WITH {_LATEST}, m AS (SELECT id, max(best_q_hours) AS most FROM b GROUP BY id),
    p AS (SELECT v.selected.variant AS variant, v.selected.month AS month, v.id, b.best_q_hours / nullif(m.most, 0) AS ratio, v.score
      FROM vis_objects v JOIN b ON b.id = v.id AND b.month = v.selected.month JOIN m ON m.id = v.id WHERE v.selected IS NOT NULL)"""


@query(
    f"""{_PLANNED}, s AS (SELECT month, count(*) AS n, avg(score) AS mean FROM p GROUP BY month)
    SELECT CAST(i AS INTEGER) AS month, coalesce(n, 0) AS n, round(coalesce(mean, 0), 6) AS mean_score,
      CASE WHEN mean >= 80 THEN 'excellent' WHEN mean >= 60 THEN 'good' WHEN mean > 0 THEN 'fair' ELSE 'empty' END AS status
    FROM range(1, 13) r(i) LEFT JOIN s ON s.month = i"""
)
def q_planned_load(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.month_load(_planned(spark, sf_dir))


@query(
    f"""{_PLANNED} SELECT round(avg(ratio) * 100, 6) AS quality, CASE WHEN avg(ratio) >= 0.9 THEN 'WYBITNA' WHEN avg(ratio) >= 0.8 THEN 'BARDZO DOBRA'
      WHEN avg(ratio) >= 0.7 THEN 'DOBRA' ELSE 'KOMPROMISOWA' END AS grade FROM p"""
)
def q_planned_grade(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.quality_grade(_planned(spark, sf_dir))


@query(f"{_PLANNED} SELECT variant, month, id, round(ratio, 6) AS ratio, score FROM p WHERE score >= 80 AND ratio < 0.7")
def q_gems(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.gems(_planned(spark, sf_dir)).withColumn("ratio", F.round("ratio", 6))


@query("SELECT id, name, size, score FROM vis_objects WHERE size >= 10")
def q_large_enough(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.large_enough(table(spark, sf_dir, "vis_objects"), 10.0).select("id", "name", "size", "score")


@query("SELECT id, score, size FROM vis_objects ORDER BY score DESC NULLS LAST, size DESC NULLS LAST, id LIMIT 108")
def q_first_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.first_objects(table(spark, sf_dir, "vis_objects"), 108).select("id", "score", "size")


@query(
    """SELECT row_id, coalesce(upper(trim(type)) IN ('OCL', 'G', 'GPAIR', 'GTRPL', 'GGROUP', 'GCL', 'NEB', 'EMN', 'RFN', 'PN', 'HII', 'CL+N', 'DRKN'), false)
        AND (mag IS NULL OR isnan(mag) OR mag < 16) AS drawn,
      coalesce(NOT isnan(size) AND size > 1, false) AS true_size, coalesce(NOT isnan(size) AND size > 0 AND size < 3000, false) AS outlined,
      coalesce(NOT isnan(mag) AND mag < 12, false) AS bright
    FROM katalog_astro_full"""
)
def q_chart_objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "katalog_astro_full").select(
        "row_id", choose.drawn(F.col("type"), F.col("mag")).alias("drawn"), choose.true_size(F.col("size")).alias("true_size"),
        choose.outlined(F.col("size")).alias("outlined"), choose.drawn_stars(F.col("mag")).alias("bright"),
    )


@query(
    r"""-- rounded half up on the decimal value, as Spark does
    SELECT id, coalesce(nullif(trim(string_split(coalesce(common_names, ''), ',')[1]), ''),
        CASE WHEN regexp_matches(upper(trim(id)), '^(NGC|IC)\s*\d') THEN regexp_replace(upper(trim(id)), '\s+', '', 'g') END, nullif(trim(name), '')) AS label,
      (CASE WHEN mag > 12 THEN '○' ELSE '●' END) || CAST(round(CAST(mag AS DECIMAL(12, 4)), 1) AS VARCHAR) AS mag_mark, '●' || CAST(round(CAST(size AS DECIMAL(12, 4)), 1) AS VARCHAR) || chr(39) AS size_mark
    FROM vis_objects"""
)
def q_chart_labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "vis_objects").select(
        "id", choose.chart_label(F.col("common_names"), F.col("id"), F.col("name")).alias("label"),
        choose.marked(F.col("mag"), F.col("mag") > 12).alias("mag_mark"), choose.marked(F.col("size"), F.lit(False), "'").alias("size_mark"),
    )


@query(f"WITH {_LATEST} SELECT id, count(*) FILTER (best_q_hours >= 3) AS months FROM b GROUP BY id")
def q_good_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return choose.good_months(plan.latest_monthly(table(spark, sf_dir, "monthly_best")), 3.0)


@query(
    """SELECT id, i AS point, round(ra + size / 60 * cos(i * 2 * pi() / 100) / greatest(abs(cos(radians(dec))), 0.001), 6) AS ra,
      round(greatest(-90, least(90, dec + size / 60 * sin(i * 2 * pi() / 100))), 6) AS dec
    FROM vis_objects, range(0, 101) r(i) WHERE size > 0 AND size < 3000"""
)
def q_outlines(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "vis_objects").where(choose.outlined(F.col("size")))
    points = F.posexplode(ephem.circle(F.col("ra"), F.col("dec"), F.col("size") / 60)).alias("point", "p")
    return rows.select("id", points).select("id", F.col("point").cast("long").alias("point"), F.round("p.ra", 6).alias("ra"), F.round("p.dec", 6).alias("dec"))


@query("SELECT selected.variant AS variant, count(*) AS n FROM vis_objects WHERE selected IS NOT NULL GROUP BY ROLLUP (selected.variant)")
def q_plan_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.plan_totals(table(spark, sf_dir, "vis_objects"))


@query(
    """WITH t AS (SELECT * FROM vis_objects ORDER BY score DESC, id LIMIT 100)
    SELECT count(*) AS n_top, count_if(selected IS NOT NULL) AS n_assigned, count(*) - count_if(selected IS NOT NULL) AS n_unassigned,
      round(100.0 * count_if(selected IS NOT NULL) / count(*), 4) AS pct FROM t"""
)
def q_plan_kpis(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.plan_kpis(table(spark, sf_dir, "vis_objects"))


@query(
    f"""WITH {_LATEST}, r AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY best_q_hours DESC, month) AS place FROM b)
    SELECT id, CAST(place AS INTEGER) AS place, month, best_q_hours FROM r WHERE place <= 3"""
)
def q_top3_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.best_months(plan.latest_monthly(table(spark, sf_dir, "monthly_best")))


@query("SELECT id, 16 + 2 * (row_number() OVER (ORDER BY id) - 1) AS page FROM vis_objects")
def q_page_numbers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.numbered_pages(table(spark, sf_dir, "vis_objects"))


@query(
    """WITH s AS (SELECT id, name, row_number() OVER (ORDER BY lower(name), id) AS p, ceil(count(*) OVER () / 2) AS h FROM vis_objects WHERE selected IS NOT NULL)
    SELECT id, name, CASE WHEN p <= h THEN 'left' ELSE 'right' END AS side, CAST(CASE WHEN p <= h THEN p ELSE p - h END AS INTEGER) AS line FROM s"""
)
def q_two_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return plan.two_columns(table(spark, sf_dir, "vis_objects").where("selected is not null"))


@query(
    """SELECT user_id AS obj_id, CAST(arg_max(d, (v, -epoch(d))) AS DATE) AS day, max(v) AS m_hours
    FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY ALL) GROUP BY user_id"""
)
def q_argmax_day_first(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("obj_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("m_hours"))
    return plan.best_night(per_day)


@query("SELECT user_id AS id, count_if(v > 3) AS nights FROM (SELECT user_id, CAST(ts AS DATE) AS d, count(*) AS v FROM events GROUP BY ALL) GROUP BY user_id")
def q_nights_over(spark: SparkSession, sf_dir: str) -> DataFrame:
    per_day = table(spark, sf_dir, "events").groupBy(F.col("user_id").alias("obj_id"), F.to_date("ts").alias("day")).agg(F.count("*").alias("q_hours"))
    return plan.nights_over(per_day, 3)


@query("SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT')")
def q_anti_missing(spark: SparkSession, sf_dir: str) -> DataFrame:
    done = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").withColumnRenamed("o_custkey", "c_custkey")
    return cache.missing_keys(table(spark, sf_dir, "customer"), done, ["c_custkey"]).select("c_custkey")


@query("SELECT c_custkey, c_name FROM customer WHERE c_custkey IN (SELECT o_custkey FROM orders WHERE o_orderstatus = 'F')")
def q_semi_targets(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders").where("o_orderstatus = 'F'")
    return table(spark, sf_dir, "customer").join(orders, F.col("c_custkey") == F.col("o_custkey"), "left_semi").select("c_custkey", "c_name")


@query(
    """WITH n AS (SELECT o_custkey AS k, max(o_totalprice) AS v FROM orders GROUP BY 1)
    SELECT k, v FROM n UNION ALL SELECT c_custkey, c_acctbal FROM customer WHERE c_custkey NOT IN (SELECT k FROM n)"""
)
def q_upsert(spark: SparkSession, sf_dir: str) -> DataFrame:
    old = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("k"), F.col("c_acctbal").alias("v"))
    new = table(spark, sf_dir, "orders").groupBy(F.col("o_custkey").alias("k")).agg(F.max("o_totalprice").alias("v"))
    return cache.upsert(old, new, ["k"])


@query(
    """WITH t AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY 1 HAVING count(*) > 15)
    SELECT o_orderkey, t.o_custkey IS NOT NULL AS frequent, round(t.total, 2) AS total FROM orders LEFT JOIN t USING (o_custkey)"""
)
def q_left_annotation(spark: SparkSession, sf_dir: str) -> DataFrame:
    orders = table(spark, sf_dir, "orders")
    top = orders.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum("o_totalprice").alias("total")).where("n > 15")
    joined = orders.join(top, "o_custkey", "left")
    return joined.select("o_orderkey", F.col("n").isNotNull().alias("frequent"), F.round("total", 2).alias("total"))


@query("SELECT round(median(o_totalprice), 4) AS median, round(quantile_cont(o_totalprice, 0.3), 4) AS p30 FROM orders")
def q_median_percentile(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = F.percentile("o_totalprice", F.lit(0.3))
    return table(spark, sf_dir, "orders").agg(F.round(F.median("o_totalprice"), 4).alias("median"), F.round(p, 4).alias("p30"))


@query(
    """SELECT o_custkey, arg_max(o_orderkey, (o_totalprice, -o_orderkey)) AS o_orderkey, count(*) AS n,
      CAST(count(DISTINCT o_orderpriority) AS BIGINT) AS priorities FROM orders GROUP BY o_custkey"""
)
def q_group_leaders(spark: SparkSession, sf_dir: str) -> DataFrame:
    first = F.struct("o_totalprice", -F.col("o_orderkey"))
    return table(spark, sf_dir, "orders").groupBy("o_custkey").agg(
        F.max_by("o_orderkey", first).alias("o_orderkey"), F.count("*").alias("n"), F.countDistinct("o_orderpriority").alias("priorities")
    )


@query(
    """SELECT v.id, f.field_id, CASE WHEN abs(v.dec) <= 60 THEN 'Mercator' WHEN abs(v.dec) <= 75 THEN 'Miller' ELSE 'Lambert' END AS projection
    FROM vis_objects v, sky_field f WHERE f.shape = 'circle' AND abs((((v.ra - f.ra + 180) % 360) + 360) % 360 - 180) <= 10
      AND v.dec BETWEEN greatest(-90, f.dec - 10) AND least(90, f.dec + 10)"""
)
def q_sky_box(spark: SparkSession, sf_dir: str) -> DataFrame:
    fields = table(spark, sf_dir, "sky_field").where("shape = 'circle'").select("field_id", F.col("ra").alias("f_ra"), F.col("dec").alias("f_dec"))
    # 180 fields at every scale
    met = table(spark, sf_dir, "vis_objects").crossJoin(F.broadcast(fields)).where(ephem.sky_box(F.col("ra"), F.col("dec"), F.col("f_ra"), F.col("f_dec")))
    return met.select("id", "field_id", ephem.projection(F.col("dec")).alias("projection"))


_FOV = "57.3 * (p_size + 10.0) / p_retailprice, 57.3 * (p_size + 5.0) / p_retailprice"


@query(
    """SELECT p_partkey, round(57.3 * (p_size + 10.0) / p_retailprice, 6) AS fov_w, round(57.3 * (p_size + 5.0) / p_retailprice, 6) AS fov_h,
      round(2 * atan(sqrt(pow(p_size + 10.0, 2) + pow(p_size + 5.0, 2)) / (2 * p_retailprice)) * 3437.75, 6) AS diagonal,
      round(2 * 180 / 3.14159 * ((p_size + 10.0) / 2) / p_retailprice, 6) AS title_w, round(2 * 180 / 3.14159 * ((p_size + 5.0) / 2) / p_retailprice, 6) AS title_h,
      round(57.3 * (p_size + 5.0) / p_retailprice * 10 / 100 * 60, 6) AS smallest FROM part"""
)
def q_field_of_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, w, h = F.col("p_retailprice"), F.col("p_size") + 10.0, F.col("p_size") + 5.0
    named = ephem.field_of_view(f, w, h) | {"smallest": ephem.smallest_size(f, w, h, F.lit(10.0))}
    return table(spark, sf_dir, "part").select("p_partkey", *(F.round(c, 6).alias(n) for n, c in named.items()))


@query(
    """SELECT id, round(ra - 0.15 / greatest(abs(cos(radians(dec))), 0.01), 6) AS "left", round(ra + 0.15 / greatest(abs(cos(radians(dec))), 0.01), 6) AS "right",
      round(CASE WHEN size <= 0 THEN 99 ELSE mag + 2.5 * log10(pi() * pow(size / 2, 2)) END, 6) AS surface FROM vis_objects"""
)
def q_geometry(spark: SparkSession, sf_dir: str) -> DataFrame:
    cross = ephem.crosshair(F.col("ra"), F.col("dec"))
    surface = ephem.surface_brightness(F.col("mag"), F.col("size"))
    return table(spark, sf_dir, "vis_objects").select("id", F.round(cross["left"], 6).alias("left"), F.round(cross["right"], 6).alias("right"), F.round(surface, 6).alias("surface"))


@query(
    f"""SELECT day::DATE AS day, date_diff('hour', timezone('{SITE.tz}', day), timezone('UTC', day)) * 1.0::DOUBLE AS tz_offset
    FROM generate_series(TIMESTAMP '{SITE.year}-01-01', TIMESTAMP '{SITE.year}-12-31', INTERVAL 1 DAY) g(day)"""
)
def q_tz_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    return visibility.days_of_year(spark, SITE.year).select("day", ephem.utc_offset_hours(F.col("day"), SITE.tz).alias("tz_offset"))


@query()
def q_object_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    objects = table(spark, sf_dir, "vis_objects").where("selected is not null")
    return pages.object_pages(objects, visibility.daily_records(objects, SITE)).select(
        "id", "page", "title", "type_label", "designations", F.col("month_best.day").alias("month_day"), F.col("year_best.day").alias("year_day"),
        F.round("year_best.m_hours", 6).alias("m_hours"), F.size("year_best.segments").alias("segments"),
    )
