"""Records of different sources that describe the same thing, without a common key.

Candidates come from blocks: grid cells of the sky, each record being copied over
the edge as far as positions may differ, and MinHash bands over names and
designations, which reach farther. A logistic classifier judges each pair by
distance, magnitudes and sizes. It learns from weak labels: pairs that
share a name or designation against distinct objects of one source. How much
names, designations and the types of both sources tell is then learned over all
candidates by expectation maximization, together with the share of matches, which
calibrates the odds. Third records bear witness for or against a pair.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import sky
from asterweave.functions.stated import TYPE_CODES, catalog_code, is_nothing, size_fillers, stated_mag, stated_size, type_code
from asterweave.operators.unpack import finest_dialect, parse, unquoted
from asterweave.runtime import discard, materialize, small_side

#: Positions of one object differ by at most so many arcmin, unless names agree.
REACH_ARCMIN = 1.6
#: MinHash bands over names and designations, and how far they reach in multiples of the above.
BANDS, BAND_REACH = 4, 3
#: At most so many weakly labelled pairs fit the classifier, the first by a hash.
TRAIN_PAIRS = 60_000
#: Logarithm of the factor between a size in arcseconds and in arcmin, a wrong unit.
UNIT = float(np.log(60.0))
#: The least squared error of a position, in arcmin.
LEAST_VARIANCE = 0.03**2
#: Pairs below this probability count as this probability when third records are asked.
UNLIKELY = 0.001
#: Pairs of kinds (catalogue and type) are believed to be like all others with the weight of so many pairs.
KIND_BELIEF = 20.0
#: Log odds from which a pair counts as a sure match, and the usual size of what words take off the odds of a kind.
SURE_ODDS, OFFSET_BELIEF = 4.0, 2.0
FEATURES = 18


def _texts(column: str, dialect: Column, kept: str) -> Column:
    """The normal forms of the values packed in a field, without those that are no values."""
    values = F.transform(parse(F.col(column), dialect), lambda v: F.regexp_replace(F.lower(unquoted(v, dialect)), kept, ""))
    values = F.transform(values, lambda v: F.regexp_replace(v, r"^the\s+", ""))
    return F.coalesce(F.array_distinct(F.filter(values, lambda v: (v != "") & ~is_nothing(v))), F.array().cast("array<string>"))


def records(df: DataFrame) -> DataFrame:
    """What the operator uses of each row with a usable position."""
    ident = F.regexp_replace(F.regexp_replace(F.lower("id"), r"[^\p{L}\p{N}]", ""), r"(?<=\p{L})0+(?=\d)", "")
    fillers = size_fillers(df)
    # what is used more than once below is computed first, and so once
    rows = df.where("row_id is not null").select(
        "row_id", "catalog", "id", "mag", "size", "common_names", "extra_info", type_code(F.col("type")).alias("kind"),
        sky.usable_ra(F.col("ra")).alias("ra"), sky.usable_dec(F.col("dec")).alias("dec"),
        finest_dialect(F.col("common_names")).alias("__names"), finest_dialect(F.col("extra_info")).alias("__marks"),
    ).where("ra is not null and dec is not null")
    x, y, z = sky.unit_vector(F.col("ra"), F.col("dec"))
    return rows.select(
        "row_id",
        F.coalesce(catalog_code(F.col("catalog")), F.lit("")).alias("cat"),
        F.when(~is_nothing(F.col("id")), ident).alias("ident"),
        x.alias("x"), y.alias("y"), z.alias("z"),
        stated_mag(F.col("mag")).alias("mag"),
        F.log(stated_size(F.col("size"), fillers)).alias("size"),
        F.when(F.col("kind").isin(*{c.upper() for c in TYPE_CODES}), F.col("kind")).otherwise("").alias("kind"),
        _texts("common_names", F.col("__names"), '"').alias("names"),
        _texts("extra_info", F.col("__marks"), r'[\s"]').alias("marks"),
    )


def copies_folded(rows: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(one record of each set of equal ones, (row_id, copy) of those with copies): copies are judged once.

    Position, source and all that is compared are equal among copies, so they
    match the same records. The smallest row_id stands for them. ``rows`` is
    read twice and should be materialized.
    """
    same = [c for c in rows.columns if c != "row_id"]
    groups = rows.groupBy(*same).agg(F.min("row_id").alias("row_id"), F.count("*").alias("n"))
    single = materialize(groups.select("row_id", *same, "n"), "records")
    several = single.where("n > 1").select(*same, F.col("row_id").alias("first"))
    equal = [F.col(f"r.{c}").eqNullSafe(F.col(f"s.{c}")) for c in same]
    keys = [(F.col(f"r.{c}") == F.col(f"s.{c}")) for c in ("x", "y", "z")]
    members = rows.alias("r").join(several.alias("s"), keys + equal).select(F.col("s.first").alias("row_id"), F.col("r.row_id").alias("copy"))
    return single.drop("n"), materialize(members, "members")


def candidate_pairs(rows: DataFrame, reach: float = REACH_ARCMIN) -> DataFrame:
    """(row_id_a, row_id_b, sep): pairs from all blocks, each once, row_id_a < row_id_b.

    Only ids and positions go through the blocks.
    """
    r = sky.chord(reach)
    side = 4 * r
    own = sky.cell_of(F.col("x"), F.col("y"), F.col("z"), side)
    corners = [sky.cell_of(F.col("x") + i * r, F.col("y") + j * r, F.col("z") + k * r, side) for i in (-1, 1) for j in (-1, 1) for k in (-1, 1)]
    # Copies go to cells of lower number only, so that each pair meets once.
    near = F.filter(F.array_distinct(F.array(own, *corners)), lambda c: c <= own)
    place = ["row_id", "x", "y", "z"]
    left = rows.select(own.alias("block"), *(F.col(c).alias(f"{c}_p") for c in place))
    right = rows.select(F.explode(near).alias("block"), own.alias("from"), *(F.col(c).alias(f"{c}_q") for c in place))
    d2 = sum(((F.col(f"{c}_p") - F.col(f"{c}_q")) * (F.col(f"{c}_p") - F.col(f"{c}_q")) for c in "xyz"), F.lit(0.0))
    # the block of a row that is not copied is its own cell
    once = (F.col("from") != F.col("block")) | (F.col("row_id_p") < F.col("row_id_q"))
    ends = [F.least("row_id_p", "row_id_q").alias("row_id_a"), F.greatest("row_id_p", "row_id_q").alias("row_id_b"), d2.alias("d2")]
    by_cell = left.join(right, "block").where(once & (d2 <= r * r)).select(*ends)

    tokens = F.concat("names", "marks")
    hashes = F.array(*(F.array_min(F.transform(tokens, lambda t, s=s: F.xxhash64(F.lit(s), t))) for s in range(BANDS)))
    wide = sky.cell_of(F.col("x"), F.col("y"), F.col("z"), 4 * BAND_REACH * r)
    banded = rows.where(F.size(tokens) > 0).select(*place, F.posexplode(hashes).alias("band", "least"), wide.alias("wide"))
    banded = banded.select(F.xxhash64("wide", "band", "least").alias("block"), *place)
    p, q = (banded.select("block", *(F.col(c).alias(f"{c}_{n}") for c in place)) for n in "pq")
    far = (d2 > r * r) & (d2 <= (BAND_REACH * r) ** 2)
    by_band = p.join(q, "block").where((F.col("row_id_p") < F.col("row_id_q")) & far).select(*ends).distinct()
    sep = F.degrees(2 * F.asin(F.least(F.lit(1.0), F.sqrt("d2") / 2))) * 60
    return by_cell.union(by_band).select("row_id_a", "row_id_b", sep.alias("sep"))


def _agreement(column: str) -> Column:
    """0: one of two records states none, 1: both do and share none, 2: they share one."""
    a, b = F.col(f"a.{column}"), F.col(f"b.{column}")
    return F.when((F.size(a) == 0) | (F.size(b) == 0), 0).when(F.arrays_overlap(a, b), 2).otherwise(1)


def compared(pairs: DataFrame, rows: DataFrame) -> DataFrame:
    """One flat row for each pair of ``candidate_pairs``: ids, sources, distance and the differences of what both state."""
    told = F.struct("cat", "ident", "kind", "mag", "size", "names", "marks")
    for end in ("a", "b"):
        pairs = pairs.join(rows.select(F.col("row_id").alias(f"row_id_{end}"), told.alias(end)), f"row_id_{end}")
    ds = F.abs(F.col("a.size") - F.col("b.size"))
    kinds = F.array_join(F.array_sort(F.array(*(F.concat_ws(" ", f"{p}.cat", f"{p}.kind") for p in "ab"))), " | ")
    return pairs.select(
        "row_id_a", "row_id_b", F.col("a.cat").alias("cat_a"), F.col("b.cat").alias("cat_b"),
        F.col("a.ident").alias("ident_a"), F.col("b.ident").alias("ident_b"), "sep",
        F.abs(F.col("a.mag") - F.col("b.mag")).alias("dm"), F.least(ds, F.abs(ds - UNIT)).alias("ds"),
        _agreement("names").alias("names"), _agreement("marks").alias("marks"), kinds.alias("kinds"),
    )


def features(variance: Column) -> list[Column]:
    """The classifier's inputs for a row of ``compared``."""
    z2 = F.col("sep") * F.col("sep") / variance
    sep = F.least(F.col("sep"), F.lit(2.0))
    no_m, no_s = F.col("dm").isNull(), F.col("ds").isNull()
    dm, ds = F.coalesce("dm", F.lit(0.0)), F.coalesce("ds", F.lit(0.0))
    columns = [
        F.lit(1.0), F.least(z2, F.lit(25.0)), F.least(F.sqrt(z2), F.lit(5.0)), F.log(variance), sep, sep * sep,
        no_m, F.least(dm, F.lit(3.0)), dm > 0.5, dm > 0.8, dm > 1.2,
        no_s, F.least(ds, F.lit(2.5)), ds > 0.45, ds > 0.7, ds > 1.0,
        no_m & no_s, ~no_m & ~no_s & (dm < 0.8) & (ds < 0.7),
    ]
    return [c.cast("double") for c in columns]


def fit_logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.5, rounds: int = 60) -> np.ndarray:
    """Ridge logistic regression by Newton steps."""
    b = np.zeros(x.shape[1])
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(x @ b, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(b)), x.T @ (y - p) - ridge * b)
        b += step
        if np.abs(step).max() < 1e-8:
            break
    return b


@dataclass
class Evidence:
    """Log odds: a shift for the share of matches, and what names, designations and kinds add by their agreement."""

    shift: float
    names: list[float]
    marks: list[float]
    kinds: dict[str, float]


def kind_offsets(odds: np.ndarray, count: np.ndarray, names: np.ndarray, marks: np.ndarray, place: np.ndarray, kinds: int, chance: float) -> np.ndarray:
    """What to take off the log odds of each pair of kinds, given log odds without words.

    Things of unlike kinds may lie close together and be alike in size, as
    matches are. Words then tell them apart as a whole: if pairs of a kind were
    matches as often as their odds say, so many of those that state words on
    both sides would share one. The rate at which matches do is taken from sure
    pairs, low among the kinds, as sources differ; ``chance`` is that of others.
    The offset of greatest posterior probability is searched, by a belief in
    small ones; it never raises odds.
    """
    stated, shared = (names > 0) | (marks > 0), (names == 2) | (marks == 2)
    sure = stated & (odds >= SURE_ODDS)
    n, g = (np.bincount(place[w], count[w], kinds) for w in (sure, sure & shared))
    enough = np.flatnonzero(n >= KIND_BELIEF)
    if not enough.size:
        return np.zeros(kinds)
    rate, weight = g[enough] / n[enough], n[enough]
    order = np.argsort(rate)
    rate, weight = rate[order], weight[order]
    # a kind with far fewer shared words than the best ones is not of matches, however sure it looks
    high = rate[np.searchsorted(np.cumsum(weight), 0.9 * weight.sum())]
    rate, weight = rate[rate >= high / 3], weight[rate >= high / 3]
    low = float(rate[np.searchsorted(np.cumsum(weight), 0.1 * weight.sum())])
    if low <= chance:
        return np.zeros(kinds)
    steps = np.arange(0.0, -8.01, -0.1)
    told = np.zeros((len(steps), kinds))
    for i, step in enumerate(steps):
        p = 1 / (1 + np.exp(-np.clip(odds[stated] + step, -30, 30)))
        agree = np.clip(low * p + chance * (1 - p), 1e-6, 1 - 1e-6)
        told[i] = np.bincount(place[stated], count[stated] * np.where(shared[stated], np.log(agree), np.log(1 - agree)), kinds) - step**2 / (2 * OFFSET_BELIEF**2)
    return steps[told.argmax(axis=0)]


def fit_evidence(bins: pd.DataFrame, trained_share: float, rounds: int = 25) -> Evidence:
    """Expectation maximization over a histogram of candidates (logit, names, marks, kinds, n)."""
    logit, count = bins["logit"].to_numpy(float), bins["n"].to_numpy(float)
    states = {c: bins[c].to_numpy(int) for c in ("names", "marks")}
    place, kinds = pd.factorize(bins["kinds"])
    tables, by_kind, shift = {"names": [0.0] * 3, "marks": [0.0] * 3}, np.zeros(len(kinds)), 0.0
    if not count.sum():
        return Evidence(shift, tables["names"], tables["marks"], {})
    usual = np.bincount(place, count, len(kinds)) / count.sum()
    for _ in range(rounds):
        total = logit + shift + by_kind[place] + sum(np.array(tables[c])[states[c]] for c in states)
        p = 1 / (1 + np.exp(-np.clip(total, -30, 30)))
        share = np.clip((p * count).sum() / count.sum(), 0.01, 0.99)
        shift = float(np.log(share / (1 - share)) - np.log(trained_share / (1 - trained_share)))
        for c, state in states.items():
            both, shared = state > 0, state == 2
            m = ((p * count)[shared].sum() + 1) / ((p * count)[both].sum() + 2)
            u = (((1 - p) * count)[shared].sum() + 1) / (((1 - p) * count)[both].sum() + 2)
            tables[c], chance = [0.0, float(np.log((1 - m) / (1 - u))), float(np.log(m / u))], float(u)
        m, u = (np.bincount(place, w * count, len(kinds)) for w in (p, 1 - p))
        by_kind = np.log((m + KIND_BELIEF * usual + 1e-9) / (m.sum() + KIND_BELIEF)) - np.log((u + KIND_BELIEF * usual + 1e-9) / (u.sum() + KIND_BELIEF))
    by_kind += kind_offsets(logit + shift + by_kind[place], count, states["names"], states["marks"], place, len(kinds), chance)
    return Evidence(shift, tables["names"], tables["marks"], dict(zip(kinds, by_kind.tolist(), strict=True)))


def consistent(scored: DataFrame) -> DataFrame:
    """``scored`` with odds revised by third records, since being the same object is transitive.

    Given that a third record c is like a with probability p and like b with q,
    a and b agree with the odds of both or neither being so against exactly one
    or neither. The strongest witness for a pair and the strongest against it
    count. A record of the catalogue of a or b is no witness, as it is not
    compared with its own.
    """
    # the strongest witness multiplies odds by about 1 / (2 UNLIKELY): no pair it can lift over even odds is left out
    likely = scored.where(F.col("odds") > float(np.log(UNLIKELY)))
    p = F.greatest(F.lit(UNLIKELY), F.least(F.lit(1 - UNLIKELY), 1 / (1 + F.exp(-F.col("odds")))))
    one = likely.select(F.col("row_id_a").alias("x"), F.col("row_id_b").alias("c"), F.col("cat_b").alias("cat_c"), p.alias("p"))
    other = likely.select(F.col("row_id_b").alias("x"), F.col("row_id_a").alias("c"), F.col("cat_a").alias("cat_c"), p.alias("p"))
    beside = one.union(other)
    asked = likely.select("row_id_a", "row_id_b", "cat_a", "cat_b")
    told = None
    for me in ("a", "b"):
        seen = asked.join(beside.withColumnRenamed("x", f"row_id_{me}"), f"row_id_{me}")
        seen = seen.where((F.col("cat_c") != F.col("cat_a")) & (F.col("cat_c") != F.col("cat_b")))
        seen = seen.select("row_id_a", "row_id_b", "c", F.when(F.lit(me == "a"), F.col("p")).alias("p"), F.when(F.lit(me == "b"), F.col("p")).alias("q"))
        told = seen if told is None else told.union(seen)
    pair = ["row_id_a", "row_id_b"]
    met = told.groupBy(*pair, "c").agg(F.coalesce(F.max("p"), F.lit(UNLIKELY)).alias("p"), F.coalesce(F.max("q"), F.lit(UNLIKELY)).alias("q"))
    both, neither = F.col("p") * F.col("q"), (1 - F.col("p")) * (1 - F.col("q"))
    said = F.log((both + neither) / (1 - both))
    words = met.groupBy(*pair).agg((F.greatest(F.max(said), F.lit(0.0)) + F.least(F.min(said), F.lit(0.0))).alias("witness"))
    return scored.join(words, pair, "left").withColumn("odds", F.col("odds") + F.coalesce("witness", F.lit(0.0))).drop("witness")


def matched_pairs(df: DataFrame, reach: float = REACH_ARCMIN, at_least: float = 0.5, train_pairs: int = TRAIN_PAIRS) -> DataFrame:
    """(row_id_a, row_id_b, confidence): pairs of rows of different catalogues that record one object.

    ``row_id_a`` < ``row_id_b``; every row counts, repeated deliveries too, which are
    judged once and written out at the end. The
    confidence is a calibrated probability of ``at_least`` or more. Of several
    designations of one catalogue that a row matches only the likeliest stays,
    since a catalogue lists an object once.

    Rows without a usable position or row_id match nothing; a missing magnitude,
    size, name or designation just gives no evidence, and a blank catalogue is a
    catalogue of its own. ``train_pairs`` bounds the weakly labelled pairs that
    fit the classifier; errors of positions, evidence and calibration come from
    all candidates. Without weak labels of both kinds distance alone decides.
    Other columns are ignored.
    """
    spark = df.sparkSession
    raw = materialize(records(df), "raw")
    rows, copies = copies_folded(raw)
    discard(spark, raw)
    pairs = materialize(compared(candidate_pairs(rows, reach), rows), "pairs")
    discard(spark, rows)
    cross = F.col("cat_a") != F.col("cat_b")
    agrees = (F.col("names") == 2) | (F.col("marks") == 2)
    plausible = ~F.coalesce(F.col("dm") > 1.2, F.lit(False)) & ~F.coalesce(F.col("ds") > 0.8, F.lit(False))

    # The squared error of each catalogue's positions, from pairs that agree: one row for two catalogues.
    spread = pairs.where(cross & agrees & plausible & (F.col("sep") <= reach)).groupBy("cat_a", "cat_b").agg(
        F.avg(F.col("sep") * F.col("sep") / 2).alias("v"), F.count("*").alias("n")
    ).toPandas()
    cats = sorted(r[0] for r in pairs.select("cat_a").union(pairs.select("cat_b")).distinct().collect())
    place = {c: i for i, c in enumerate(cats)}
    design = np.zeros((len(spread) + len(cats), len(cats)))
    goal = np.full(len(design), 0.0)
    for i, row in enumerate(spread.itertuples(index=False)):
        design[i, place[row.cat_a]] += np.sqrt(row.n)
        design[i, place[row.cat_b]] += np.sqrt(row.n)
        goal[i] = row.v * np.sqrt(row.n)
    usual = float((spread.v * spread.n).sum() / spread.n.sum() / 2) if len(spread) else (reach / 8) ** 2
    for i in range(len(cats)):  # a weak belief in the usual error, for catalogues with few pairs
        design[len(spread) + i, i] = 1.0
        goal[len(spread) + i] = usual
    errors = np.maximum(np.linalg.lstsq(design, goal, rcond=None)[0], LEAST_VARIANCE) if cats else np.zeros(0)
    known = spark.createDataFrame([(c, float(e)) for c, e in zip(cats, errors, strict=True)], "cat string, error double")
    known = small_side(known)
    variance = pairs.join(known.toDF("cat_a", "error_a"), "cat_a").join(known.toDF("cat_b", "error_b"), "cat_b")
    told = variance.withColumn("v", F.col("error_a") + F.col("error_b"))

    distinct = ~cross & (F.col("ident_a") != F.col("ident_b"))
    label = F.when(cross & agrees, 1.0).when(distinct, 0.0)
    taught = told.select(F.array(*features(F.col("v"))).alias("x"), label.alias("y"), F.xxhash64("row_id_a", "row_id_b").alias("h")).where("y is not null")
    sample = taught.orderBy("h").limit(train_pairs).select("x", "y").toPandas()
    y = sample["y"].to_numpy(float)
    if len(y) and 0 < y.sum() < len(y):
        weights = fit_logistic(np.stack(sample["x"].to_numpy()).astype(float), y)
    else:
        weights = np.array([4.0, -0.5] + [0.0] * (FEATURES - 2))
        y = np.array([0.0, 1.0])
    terms = [c * F.lit(float(w)) for c, w in zip(features(F.col("v")), weights, strict=True)]
    logit = sum(terms[1:], terms[0])
    kept = ["row_id_a", "row_id_b", "cat_a", "cat_b", "ident_a", "ident_b", "names", "marks", "kinds"]
    judged = told.where(cross).select(*kept, F.greatest(F.lit(-20.0), F.least(logit, F.lit(20.0))).alias("logit"))

    # as many rows as a histogram has bins: of log odds, agreements, and pairs of known kinds
    bins = judged.groupBy((F.round(F.col("logit") * 2) / 2).alias("logit"), "names", "marks", "kinds").agg(F.count("*").alias("n")).toPandas()
    seen = fit_evidence(bins, float(np.clip(y.mean(), 0.01, 0.99)))
    kinds = spark.createDataFrame(list(seen.kinds.items()), "kinds string, by_kind double")

    def told_by(column: str, table: list[float]) -> Column:
        return F.when(F.col(column) == 1, table[1]).when(F.col(column) == 2, table[2]).otherwise(0.0)

    odds = F.col("logit") + seen.shift + told_by("names", seen.names) + told_by("marks", seen.marks) + F.coalesce("by_kind", F.lit(0.0))
    judged = judged.join(small_side(kinds), "kinds", "left")
    scored = materialize(judged.select(*kept[:6], odds.alias("odds")), "scored")
    discard(spark, pairs)
    first_odds, scored = scored, consistent(scored)
    scored = scored.withColumn("confidence", 1 / (1 + F.exp(-F.col("odds"))))
    accepted = materialize(scored.where(F.col("confidence") >= at_least), "accepted")
    discard(spark, first_odds)
    out = accepted
    for me, other in (("a", "b"), ("b", "a")):
        best = accepted.where(F.col(f"ident_{other}").isNotNull()).groupBy(f"row_id_{me}", f"cat_{other}").agg(
            F.max_by(f"ident_{other}", F.struct("odds", f"ident_{other}")).alias("best")
        )
        out = out.join(best, [f"row_id_{me}", f"cat_{other}"], "left").where(F.coalesce(F.col(f"ident_{other}") == F.col("best"), F.lit(True))).drop("best")
    for end in ("a", "b"):
        of = copies.select(F.col("row_id").alias(f"row_id_{end}"), F.col("copy").alias(f"copy_{end}"))
        out = out.join(of, f"row_id_{end}", "left").withColumn(f"id_{end}", F.coalesce(f"copy_{end}", f"row_id_{end}"))
    return out.select(F.least("id_a", "id_b").alias("row_id_a"), F.greatest("id_a", "id_b").alias("row_id_b"), "confidence")
