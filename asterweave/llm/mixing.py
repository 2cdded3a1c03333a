"""A mix of sources whose token sizes stand in given shares.

Token weights are raked: iterative proportional fitting scales them to the
marginals of source, language and topic, with the weight of a document at most
its source's cap. Documents are then drawn by their weights: as often as its
whole part says, and once more by order sampling on the rest until each source
has its tokens.
"""

from __future__ import annotations

import logging
from collections.abc import Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterweave.functions.stated import blank_trim
from asterweave.runtime import materialize, small_side

#: Buckets of draw order in which the tokens of a source are summed before its cut is set, twice.
BUCKETS = 4096
#: More combinations of source, language and topic are an error: the driver rakes them.
MOST_CELLS = 2_000_000

LOG = logging.getLogger(__name__)


def rake(
    tokens: np.ndarray, axes: list[np.ndarray], wanted: list[np.ndarray], caps: np.ndarray, tolerance: float = 1e-4, rounds: int = 1000
) -> tuple[np.ndarray, list[float]]:
    """(weights, residuals) of cells with ``tokens`` so that sums along each axis come near ``wanted``.

    ``axes`` gives each cell's place on each axis, the first being the one to be
    met exactly where its caps allow: it is fitted last, the rest that capped
    cells can't take going to those below their caps. Fitting ends when no
    weight changes by more than ``tolerance`` of its cap. The residual of an axis
    is the sum of what its places miss, relative to all that is wanted; caps and
    marginals that contradict each other leave one.
    """
    weights = np.minimum(np.ones(len(tokens)), caps)
    usable = (tokens > 0) & (caps > 0)

    def scale(axis: np.ndarray, goal: np.ndarray) -> None:
        now = np.bincount(axis, weights * tokens, len(goal))
        factor = np.divide(goal, now, out=np.ones(len(goal)), where=now > 0)
        weights[usable] = np.minimum(caps, weights * factor[axis])[usable]

    def fit(axis: np.ndarray, goal: np.ndarray) -> None:
        weights[usable] = np.maximum(weights[usable], 1e-12)
        for _ in range(60):
            full = usable & (weights >= caps)
            left = np.maximum(goal - np.bincount(axis[full], (caps * tokens)[full], len(goal)), 0.0)
            free = usable & ~full
            now = np.bincount(axis[free], (weights * tokens)[free], len(goal))
            if np.all((now <= 0) | (np.abs(now - left) <= 1e-9 * np.maximum(1.0, goal))):
                break
            factor = np.divide(left, now, out=np.ones(len(goal)), where=now > 0)
            weights[free] = np.minimum(caps, weights * factor[axis])[free]

    for n in range(rounds):
        before = weights.copy()
        for axis, goal in zip(axes[1:], wanted[1:], strict=True):
            scale(axis, goal)
        fit(axes[0], wanted[0])
        change = float((np.abs(weights - before) / np.maximum(caps, 1e-12)).max(initial=0.0))
        if change <= tolerance:
            break
    missed = [float(np.abs(np.bincount(x, weights * tokens, len(g)) - g).sum() / max(g.sum(), 1e-12)) for x, g in zip(axes, wanted, strict=True)]
    LOG.info("raked in %d rounds, last change %g, residuals %s", n + 1, change, missed)
    return weights, missed


def normal_lang(lang: Column) -> Column:
    """The letters that a language tag begins with, in lower case; "und" if it has none, "none" if it is null."""
    return F.coalesce(F.nullif(F.regexp_extract(F.lower(F.trim(lang)), "^([a-z]+)", 1), F.lit("und")), F.lit("none"))


def _goals(sums: pd.Series, targets: Mapping[str, float] | None) -> dict[str, float]:
    """The share wanted of each value: its target, relative to all targets that have tokens, or else the share it has."""
    wanted = {v: max(0.0, targets.get(v, 0.0)) for v in sums.index} if targets else sums.to_dict()
    total = sum(wanted.values())
    return {v: w / total for v, w in wanted.items()} if total > 0 else (sums / sums.sum()).to_dict()


def mixed(
    docs: DataFrame, targets: DataFrame, budget: int | None = None, seed: int = 0,
    langs: Mapping[str, float] | None = None, topics: Mapping[str, float] | None = None,
) -> DataFrame:
    """(doc_id, source, tokens, copies) of every document that is drawn.

    ``docs`` has (doc_id, source, lang, topic, tokens); ``targets`` has (source,
    target_share, max_repeat). Sources are compared without case and outer white
    space; target shares count relative to their sum over the sources that have
    tokens, and repeated target rows add up their shares with the lowest cap. A
    null share is 0, a null ``max_repeat`` means that nothing is repeated.
    ``langs`` and ``topics`` are target shares of languages and topics; without
    them the shares that these have among the target sources are kept. All are
    raked, however small; sources come first where they contradict each other.
    ``budget`` is the number of tokens to draw; without it, the most for which
    every such source can reach its share within its cap. With a larger budget a
    source gives at most its tokens times ``max_repeat`` and falls short.
    Documents without tokens, or of a source that is null or has no target, are
    not drawn; the same seed draws the same documents.
    """
    name = F.lower(blank_trim(F.col("source")))
    t = targets.where(name.isNotNull()).groupBy(name.alias("s")).agg(
        F.sum(F.greatest(F.col("target_share"), F.lit(0.0))).alias("share"), F.min(F.greatest(F.coalesce("max_repeat", F.lit(1)), F.lit(0))).alias("cap")
    )
    known = docs.where("tokens > 0").select(
        "doc_id", "source", name.alias("s"), "tokens", normal_lang(F.col("lang")).alias("lang"), F.coalesce(F.col("topic"), F.lit("none")).alias("topic")
    )
    known = known.join(small_side(t.where("share > 0 and cap > 0")), "s")
    cells = known.groupBy("s", "lang", "topic").agg(F.sum("tokens").alias("tokens"), F.first("cap").alias("cap"), F.first("share").alias("share"))
    cells = cells.limit(MOST_CELLS + 1).toPandas().sort_values(["s", "lang", "topic"]).reset_index(drop=True)
    if len(cells) > MOST_CELLS:
        raise ValueError(f"more than {MOST_CELLS} combinations of source, language and topic")
    if cells.empty:
        return known.select("doc_id", "source", "tokens", F.lit(0).alias("copies"))
    sources = cells.groupby("s").agg(tokens=("tokens", "sum"), cap=("cap", "first"), share=("share", "first"))
    sources["share"] /= sources["share"].sum()
    reach = sources["cap"] * sources["tokens"]
    size = float(budget) if budget is not None else float((reach / sources["share"]).min())
    sources["want"] = np.minimum(reach, size * sources["share"])
    all_wanted = sources["want"].sum()

    def axis(column: str, goals: Mapping[str, float]) -> tuple[np.ndarray, np.ndarray]:
        values = sorted(goals)
        place = {v: i for i, v in enumerate(values)}
        return cells[column].map(place).to_numpy(), np.array([goals[v] for v in values])

    parts = [axis("s", sources["want"].to_dict())]
    for column, wanted in (("lang", langs), ("topic", topics)):
        parts.append(axis(column, {v: g * all_wanted for v, g in _goals(cells.groupby(column)["tokens"].sum(), wanted).items()}))
    cells["weight"], _ = rake(cells["tokens"].to_numpy(float), [p[0] for p in parts], [p[1] for p in parts], cells["cap"].to_numpy(float))
    spark = docs.sparkSession
    weights = spark.createDataFrame(cells[["s", "lang", "topic", "weight"]], "s string, lang string, topic string, weight double")
    wants = spark.createDataFrame([(s, float(w)) for s, w in sources["want"].items()], "s string, want double")
    drawn = known.join(small_side(weights), ["s", "lang", "topic"])
    u = (F.pmod(F.xxhash64(F.lit(seed), "doc_id"), F.lit(1 << 40)).cast("double") + 0.5) / float(1 << 40)
    whole = F.floor(F.col("weight") + 1e-9)
    rest = F.greatest(F.col("weight") - whole, F.lit(0.0))
    # Order sampling: the lowest u / rest go first. The order is squeezed into [0, 1).
    order = F.when((rest > 1e-9) & (whole < F.col("cap")), u / rest / (1 + u / rest))
    drawn = materialize(drawn.select("doc_id", "source", "s", "tokens", whole.cast("int").alias("whole"), order.alias("turn")), "weights")

    fixed = drawn.groupBy("s").agg(F.sum(F.col("tokens") * F.col("whole")).alias("fixed"))
    need = F.broadcast(wants).join(fixed, "s").select("s", (F.col("want") - F.col("fixed")).alias("need"))
    done, open_rows = drawn.where("turn is null").select("doc_id", "source", "tokens", "whole", F.lit(0).alias("extra")), drawn.where("turn is not null")
    for level in (1, 2):
        # the second time the bucket that the cut falls into is cut up itself
        scale = float(BUCKETS**level)
        bucket = F.floor(F.col("turn") * scale)
        sums = open_rows.groupBy("s", bucket.alias("bucket")).agg(F.sum("tokens").alias("t"))
        # at most BUCKETS + 1 rows for each target source
        upto = F.coalesce(F.sum("t").over(Window.partitionBy("s").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
        placed = materialize(sums.select("s", "bucket", "t", upto.alias("upto")).join(need, "s"), "cut")
        judged = open_rows.withColumn("bucket", bucket).join(small_side(placed), ["s", "bucket"])
        sure = F.col("upto") + F.col("t") <= F.col("need")
        border = ~sure & (F.col("upto") < F.col("need"))
        done = done.union(judged.where(~border).select("doc_id", "source", "tokens", "whole", F.when(sure, 1).otherwise(0).alias("extra")))
        need = placed.where(border).select("s", (F.col("need") - F.col("upto")).alias("need"))
        open_rows = judged.where(border).select("doc_id", "source", "s", "tokens", "whole", "turn", (F.col("need") - F.col("upto")).alias("left"))
        if level == 1:
            open_rows = open_rows.drop("left")
    # inside the last bucket documents go in order; the one over the edge is drawn if that comes nearer to the need
    before = F.coalesce(F.sum("tokens").over(Window.partitionBy("s").orderBy("turn", "doc_id").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    split = open_rows.select("doc_id", "source", "tokens", "whole", F.when(before + F.col("tokens") / 2.0 <= F.col("left"), 1).otherwise(0).alias("extra"))
    out = done.union(split).select("doc_id", "source", "tokens", (F.col("whole") + F.col("extra")).alias("copies"))
    return out.where("copies > 0")


def shares_reached(drawn: DataFrame, docs: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target source: its target share, what it has, what was drawn of it, and the share reached.

    (source, target_share, docs, tokens, drawn_docs, drawn_tokens, share, most_copies).
    ``target_share`` is relative to the sum of all targets; a source without
    documents reaches 0.
    """
    name = F.lower(blank_trim(F.col("source")))
    t = targets.where(name.isNotNull()).groupBy(name.alias("s")).agg(F.sum(F.greatest("target_share", F.lit(0.0))).alias("want"))
    everything = t.agg(F.sum("want").alias("all_want"))
    has = docs.groupBy(name.alias("s")).agg(F.count("*").alias("docs"), F.sum("tokens").alias("tokens"))
    got = drawn.groupBy(name.alias("s")).agg(
        F.count("*").alias("drawn_docs"), F.sum(F.col("tokens") * F.col("copies")).alias("drawn_tokens"), F.max("copies").alias("most_copies")
    )
    whole = got.agg(F.sum("drawn_tokens").alias("all_drawn"))
    joined = t.join(has, "s", "left").join(got, "s", "left").crossJoin(F.broadcast(everything)).crossJoin(F.broadcast(whole))
    zero = F.lit(0).cast("long")
    return joined.select(
        F.col("s").alias("source"), (F.col("want") / F.col("all_want")).alias("target_share"),
        *(F.coalesce(c, zero).alias(c) for c in ("docs", "tokens", "drawn_docs", "drawn_tokens")),
        F.coalesce(F.col("drawn_tokens") / F.col("all_drawn"), F.lit(0.0)).alias("share"),
        F.coalesce("most_copies", F.lit(0)).alias("most_copies"),
    )



def marginals_reached(drawn: DataFrame, docs: DataFrame) -> DataFrame:
    """(axis, value, share_before, share): the shares of each language and topic in the documents and in what was drawn.

    ``docs`` has (doc_id, lang, topic, tokens) with unique ids; ``drawn`` is a
    result of ``mixed``.
    """
    both = docs.join(drawn.select("doc_id", "copies"), "doc_id", "left")
    each = F.array(
        F.struct(F.lit("lang").alias("axis"), normal_lang(F.col("lang")).alias("value")),
        F.struct(F.lit("topic").alias("axis"), F.coalesce(F.col("topic"), F.lit("none")).alias("value")),
    )
    sums = both.select(F.explode(each).alias("e"), "tokens", (F.col("tokens") * F.coalesce("copies", F.lit(0))).alias("got")).groupBy("e.axis", "e.value")
    sums = sums.agg(F.sum("tokens").alias("tokens"), F.sum("got").alias("got"))
    whole = F.sum("tokens").over(Window.partitionBy("axis")), F.sum("got").over(Window.partitionBy("axis"))
    shares = [F.coalesce(F.col(c) / F.nullif(w, F.lit(0)), F.lit(0.0)) for c, w in zip(("tokens", "got"), whole, strict=True)]
    return sums.select("axis", "value", shares[0].alias("share_before"), shares[1].alias("share"))
