"""Missing values filled from similar records, by label propagation.

Rows are linked to the groups they belong to: the patch of sky, kind and plate,
kind and time, kind. Patches are cells of four grids, shifted by half a
cell, so that rows up to half a cell apart share one wherever edges lie. Values
spread over these links: a group's value is the mean (of types: the
distribution) over its other rows, a missing cell's the weighted mean over its
groups; observed cells stay as they are. This equals spreading over all pairs of
rows within a group, without forming a pair, and goes on until it comes to rest.
Estimates weigh less than what is observed; they spread over patches, and over
the groups of rows for which no group states anything. Only rows that estimates
reach take part in the rounds.

Types come first: a row without one has no kind, so they spread over the
catalogue, with plate and with time, and between catalogues by what a type of
one is called in the other. Numbers then spread over the kind, stated or filled.
"""

from __future__ import annotations

import logging
import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import sky
from asterweave.functions.stated import catalog_code, size_fillers, stated_mag, stated_size, type_code
from asterweave.runtime import discard, materialize, small_side

LOG = logging.getLogger(__name__)

#: Groups in the order of their likeness, with the weight of a link and the rows at which it has half of it.
FAMILIES = {"patch": (16.0, 0.2), "plate": (2.0, 4.0), "month": (1.0, 8.0), "kind": (0.5, 16.0)}
#: The families of few groups.
WIDE = ("plate", "month", "kind")
NUMBERS = ("mag", "size")
#: Side of a patch of sky, in arcmin. Rows within half of it are always linked.
PATCH_ARCMIN = 1.5
#: Grids of patches; each has an equal part of the family's weight.
GRIDS = 4
#: Weight of an estimated value against an observed one, and the most that all estimated ones weigh
#: against all observed ones: each round lessens the changes by this.
ESTIMATED, MOST_ESTIMATED = 0.25, 0.25
#: Spreading ends when no magnitude, logarithm of a size or share of a type changes by more.
TOLERANCE = 0.02
#: More rounds are an error.
MOST_ROUNDS = 100
#: A table of groups is broadcast up to so many rows.
WIDE_ROWS = 100_000


def _bands(dec: Column) -> dict[str, Column]:
    """Of the two grids of bands the band of a declination, and its number of cells.

    A band has a whole number of cells, so that shifted ones wrap around; they
    are so wide that rows half a side apart are at most half a cell apart, at the
    poles too.
    """
    side, out = PATCH_ARCMIN / 60.0, {}
    for g, up in enumerate((0.0, 0.5)):
        band = F.floor((dec + 90.0) / side + up)
        # the end of the band that is nearer to a pole is narrower
        edge = F.greatest(F.abs((band - up) * side - 90.0), F.abs((band + 1 - up) * side - 90.0))
        narrow = F.greatest(F.cos(F.radians(edge)), F.lit(1e-9))
        width = F.degrees(4 * F.asin(F.least(F.lit(1.0), math.sin(math.radians(side / 4)) / narrow)))
        out |= {f"band_{g}": band, f"cells_{g}": F.greatest(F.floor(360.0 / width), F.lit(1))}
    return out


def _patches(ra: Column) -> Column:
    """The cell of a position in each grid, given its bands: two grids of bands, cells of each shifted by half a cell."""
    cells = []
    for g in (0, 1):
        band, n = F.col(f"band_{g}"), F.col(f"cells_{g}")
        cells += [F.xxhash64(F.lit(2 * g + i), band, F.pmod(F.floor(ra / 360.0 * n + along), n)) for i, along in enumerate((0.0, 0.5))]
    return F.array(*cells)


def _rows(df: DataFrame) -> DataFrame:
    """What the operator uses of each row: its patches, catalogue, plate, month, and what it states."""
    # positions are used many times below: computed first, they are computed once
    at = df.select(
        "row_id", "catalog", "plate", "updated_at", "mag", "size", "type",
        sky.usable_ra(F.col("ra")).alias("ra"), sky.usable_dec(F.col("dec")).alias("dec"),
    ).withColumns(_bands(F.col("dec")))
    return at.select(
        "row_id",
        F.when(F.col("ra").isNotNull() & F.col("dec").isNotNull(), _patches(F.col("ra"))).alias("patch"),
        F.coalesce(catalog_code(F.col("catalog")), F.lit("")).alias("cat"),
        "plate",
        F.date_format(F.col("updated_at"), "yyyy-MM").alias("month"),
        stated_mag(F.col("mag")).alias("mag"),
        # sizes spread over orders of magnitude: their mean is geometric
        F.log(stated_size(F.col("size"), size_fillers(df))).alias("size"),
        type_code(F.col("type")).alias("type"),
    )


def _wide(kind: Column) -> list[Column]:
    """The key of a row in each wide family; a null key links to nothing."""
    plate, month = F.col("plate"), F.col("month")
    return [F.when(plate.isNotNull(), F.xxhash64(F.lit(1), kind, plate)), F.when(month.isNotNull(), F.xxhash64(F.lit(2), kind, month)), F.xxhash64(F.lit(3), kind)]


def _weight(family: str, rows: Column) -> Column:
    most, half = FAMILIES[family]
    most = most / GRIDS if family == "patch" else most
    return F.when(rows > 0, most * rows / (rows + half)).otherwise(0.0)


def _settled(what: str, rounds: int, change: float | None, tolerance: float) -> bool:
    """Whether spreading has come to rest; logs the round's largest change (None: no row takes part)."""
    LOG.info("%s: round %d, largest change %s", what, rounds, change)
    if rounds > MOST_ROUNDS:
        raise RuntimeError(f"filled {what} still change by {change} after {rounds} rounds")
    return change is None or change <= tolerance


def _with_wide(df: DataFrame, groups: DataFrame, told: Column) -> DataFrame:
    """``df`` with ``of_plate``, ...: what ``groups`` (key, ...) tell of the row's group in each wide family."""
    few = groups.limit(WIDE_ROWS + 1).count() <= WIDE_ROWS
    for f in WIDE:
        side = groups.select(F.col("key").alias(f"w_{f}"), told.alias(f"of_{f}"))
        df = df.join(F.broadcast(side) if few else side, f"w_{f}", "left")
    return df


def _estimate(w: Column, m: Column, ew: Column, em: Column) -> Column:
    """The estimate of a row from observed values (weight, weighted sum) and estimated ones."""
    ew, em = F.coalesce(ew, F.lit(0.0)), F.coalesce(em, F.lit(0.0))
    share = F.when((w > 0) & (ew > MOST_ESTIMATED * w), MOST_ESTIMATED * w / F.nullif(ew, F.lit(0.0))).otherwise(1.0)
    return F.when(w + ew > 0, (m + share * em) / F.nullif(w + share * ew, F.lit(0.0)))


def _numbers(rows: DataFrame, tolerance: float) -> DataFrame:
    """(row_id, mag_fill, size_fill) of the rows of (row_id, patch, w_plate, ..., mag, size) that lack a number."""
    spark, keys, zero = rows.sparkSession, [f"w_{f}" for f in WIDE], F.lit(0.0)
    names = [f"{c}_{n}" for c in NUMBERS for n in "sn"]
    sums = [f(c).cast("double").alias(f"{c}_{n}") for c in NUMBERS for f, n in ((F.sum, "s"), (F.count, "n"))]
    weighed = [f"{c}_{n}" for c in NUMBERS for n in "wm"]
    lacks = F.col("mag").isNull() | F.col("size").isNull()
    wide = rows.where("mag is not null or size is not null").select(F.explode(F.array(*keys)).alias("key"), *NUMBERS)
    wide = materialize(wide.where("key is not null").groupBy("key").agg(*sums), "wide")
    open_rows = materialize(rows.where(lacks).select("row_id", "patch", *keys, *NUMBERS), "open")
    # only a patch with a row to fill and another one tells anything
    opens = [F.count_if(F.col(c).isNull()).alias(f"{c}_open") for c in NUMBERS]
    met = rows.select(F.explode("patch").alias("key"), *NUMBERS).groupBy("key").agg(*sums, F.count("*").alias("rows"), *opens)
    met = met.where("rows > 1 and (mag_open > 0 or size_open > 0)").drop("rows")
    links = materialize(open_rows.select("row_id", F.explode("patch").alias("key")).join(met, "key").fillna(0.0, names), "links")

    def told(n: dict[str, Column], s: dict[str, Column], family: str, fold: bool) -> list[Column]:
        """Weights and weighted sums of means, of a row's groups of one family; folded over several groups."""
        parts = []
        for c in NUMBERS:
            w = _weight(family, n[c])
            m = F.when(n[c] > 0, w * s[c] / n[c]).otherwise(zero)
            parts += [(F.sum(x) if fold else x).alias(f"{c}_{k}") for x, k in ((w, "w"), (m, "m"))]
        return parts

    def of_groups(df: DataFrame, groups: DataFrame, prefix: str) -> DataFrame:
        """``df`` with the sums over its wide families of what ``groups`` (key, mag_s, mag_n, ...) tell."""
        df = _with_wide(df, groups, F.struct(*names))
        parts = []
        for f in WIDE:
            n = {c: F.coalesce(F.col(f"of_{f}.{c}_n"), zero) for c in NUMBERS}
            parts.append(told(n, {c: F.coalesce(F.col(f"of_{f}.{c}_s"), zero) for c in NUMBERS}, f, fold=False))
        summed = {f"{prefix}_{name}": sum((p[i] for p in parts), zero) for i, name in enumerate(weighed)}
        return df.withColumns(summed).drop(*(f"of_{f}" for f in WIDE))

    columns = {c: F.col(f"{c}_n") for c in NUMBERS}, {c: F.col(f"{c}_s") for c in NUMBERS}
    near = links.groupBy("row_id").agg(*told(*columns, "patch", fold=True)).select("row_id", F.struct(*weighed).alias("near"))
    base = of_groups(open_rows.join(near, "row_id", "left"), wide, "wide")
    # a bare row states no number that any wide group of it states
    bare = [F.col(c).isNull() & (F.col(f"wide_{c}_w") == 0) for c in NUMBERS]
    base = base.select(
        "row_id", *keys, *NUMBERS, (bare[0] | bare[1]).alias("bare"), F.col("near").isNotNull().alias("told"),
        *((F.coalesce(F.col(f"near.{n}"), zero) + F.col(f"wide_{n}")).alias(n) for n in weighed),
    )
    base = materialize(base, "base")

    def filled(df: DataFrame, ew: str | None) -> list[Column]:
        """Observed cells are clamped: only missing ones take an estimate."""
        return [
            F.when(F.col(c).isNull(), _estimate(F.col(f"{c}_w"), F.col(f"{c}_m"), *(F.col(f"{ew}_{c}_{n}") if ew else zero for n in "wm"))).alias(f"{c}_fill")
            for c in NUMBERS
        ]

    live = links.where("mag_open > 1 or size_open > 1").select("row_id", "key")
    moving = materialize(base.join(live.select("row_id").distinct().withColumn("live", F.lit(True)), "row_id", "left").where("live or bare").drop("live"), "moving")
    rest = base.join(moving.select("row_id"), "row_id", "left_anti")

    def said(state: DataFrame) -> DataFrame:
        """What rows that heard from neighbours tell the wide groups."""
        each = state.where("told").select(F.explode(F.array(*keys)).alias("key"), *(F.col(f"{c}_fill").alias(c) for c in NUMBERS))
        return each.where("key is not null").groupBy("key").agg(*sums).select("key", *((ESTIMATED * F.col(n)).alias(n) for n in names))

    state = materialize(moving.select("row_id", *keys, "told", *filled(moving, None)), "numbers")
    any_bare = not moving.where("bare").isEmpty()
    fixed = materialize(said(rest.select(*keys, "told", *filled(rest, None))), "said") if any_bare else None
    rounds, change = 0, None if state.isEmpty() else math.inf
    while not _settled("numbers", rounds, change, tolerance):
        rounds += 1
        each = live.join(state.select("row_id", *(f"{c}_fill" for c in NUMBERS)), "row_id")
        est = each.groupBy("key").agg(*(f(f"{c}_fill").alias(f"{c}_e{n}") for c in NUMBERS for f, n in ((F.sum, "s"), (F.count, "n"))))
        fills = {c: F.col(f"{c}_fill") for c in NUMBERS}
        # what the others of a patch are estimated at
        others = each.join(est, "key").select(
            "row_id",
            *((ESTIMATED * (F.coalesce(f"{c}_es", zero) - F.coalesce(fills[c], zero))).alias(f"{c}_s") for c in NUMBERS),
            *((ESTIMATED * (F.col(f"{c}_en") - fills[c].isNotNull().cast("int"))).alias(f"{c}_n") for c in NUMBERS),
        )
        heard = others.groupBy("row_id").agg(*told(*columns, "patch", fold=True)).select("row_id", F.struct(*weighed).alias("est"))
        linked = moving.join(heard, "row_id", "left")
        groups = None
        if any_bare:
            groups = materialize(fixed.union(said(state)).groupBy("key").agg(*(F.sum(n).alias(n) for n in names)), "said")
            linked = of_groups(linked, groups, "group")
        of_group = {n: F.when(F.col("bare"), F.col(f"group_{n}")).otherwise(zero) if any_bare else zero for n in weighed}
        linked = linked.withColumns({f"est_{n}": F.coalesce(F.col(f"est.{n}"), zero) + of_group[n] for n in weighed})
        after = materialize(linked.select("row_id", *keys, "told", *filled(linked, "est")), "numbers")
        was = state.select("row_id", *(F.col(f"{c}_fill").alias(f"{c}_was") for c in NUMBERS))
        moved = [F.when(fills[c].isNotNull(), F.coalesce(F.abs(fills[c] - F.col(f"{c}_was")), F.lit(math.inf))).otherwise(zero) for c in NUMBERS]
        change = after.join(was, "row_id").agg(F.max(F.greatest(*moved))).first()[0]
        discard(spark, state)
        if groups is not None:
            discard(spark, groups)
        state = after
    # where no group tells anything the whole table does
    whole = rows.agg(*(F.avg(c).alias(f"all_{c}") for c in NUMBERS))
    out = rest.select("row_id", *NUMBERS, *filled(rest, None)).union(state.join(moving.select("row_id", *NUMBERS), "row_id").select("row_id", *NUMBERS, "mag_fill", "size_fill"))
    out = out.crossJoin(F.broadcast(whole)).select("row_id", *(F.when(F.col(c).isNull(), F.coalesce(f"{c}_fill", f"all_{c}")).alias(f"{c}_fill") for c in NUMBERS))
    out = materialize(out, "number-fills")
    for table in (wide, open_rows, links, base, moving, state, fixed):
        if table is not None:
            discard(spark, table)
    return out


def _names_between(typed: DataFrame) -> DataFrame:
    """(cat, cat_2, type_2, names): what rows of ``cat`` near rows of ``cat_2`` and ``type_2`` are called, with shares.

    Counted once for each patch of one grid and each pair of its kinds, however
    many rows are of a kind.
    """
    kinds = typed.where("patch is not null").groupBy(F.col("patch")[0].alias("key"), "cat", "type").agg(F.lit(1).alias("one"))
    kinds = kinds.groupBy("key").agg(F.collect_list(F.struct("cat", "type")).alias("kinds")).where(F.size("kinds") > 1)
    pairs = kinds.select(F.explode("kinds").alias("p"), "kinds").select("p", F.explode("kinds").alias("q")).where("p.cat <> q.cat")
    met = pairs.groupBy(F.col("p.cat").alias("cat"), F.col("q.cat").alias("cat_2"), F.col("q.type").alias("type_2"), F.col("p.type").alias("type")).agg(
        F.count("*").cast("double").alias("n")
    )
    return met.groupBy("cat", "cat_2", "type_2").agg(F.sum("n").alias("n"), F.map_from_entries(F.collect_list(F.struct("type", "n"))).alias("names")).select(
        "cat", "cat_2", "type_2", F.transform_values("names", lambda _, n: n / F.col("n")).alias("names")
    )


def _types(rows: DataFrame, tolerance: float) -> DataFrame:
    """(row_id, type_fill, type_share) of the rows that lack a type: the likeliest one and its share.

    ``rows`` are those of ``_rows`` with the keys of the wide families by
    catalogue. A row of the same catalogue votes for its type, one of another for
    what that type is called in the row's own.
    """
    spark, keys, zero = rows.sparkSession, [f"w_{f}" for f in WIDE], F.lit(0.0)
    typed = rows.where("type is not null")
    open_rows = materialize(rows.where("type is null").select("row_id", "cat", "patch", *keys), "open")
    wide = typed.select(F.explode(F.array(*keys)).alias("key"), "type").where("key is not null").groupBy("key", "type").agg(F.count("*").cast("double").alias("n"))
    links = materialize(open_rows.select("row_id", "cat", F.explode("patch").alias("key")), "links")
    asked = materialize(links.groupBy("key").agg(F.count("*").alias("open")), "asked")
    seen = typed.select(F.explode("patch").alias("key"), "cat", "type").join(small_side(asked.select("key")), "key", "left_semi")
    seen = seen.groupBy("key", F.col("cat").alias("cat_2"), F.col("type").alias("type_2")).agg(F.count("*").cast("double").alias("n"))
    between = materialize(_names_between(typed), "names")
    names = small_side(between)

    def near(met: DataFrame) -> DataFrame:
        """(row_id, type, w): votes of the rows of each patch, given (row_id, cat, key, cat_2, type_2, n)."""
        as_is = F.create_map("type_2", F.lit(1.0))
        called = F.when(F.col("cat") == F.col("cat_2"), as_is).otherwise(F.coalesce("names", as_is))
        votes = met.join(names, ["cat", "cat_2", "type_2"], "left").select("row_id", "key", "n", F.explode(called).alias("type", "share"))
        votes = votes.groupBy("row_id", "key", "type").agg(F.sum(F.col("n") * F.col("share")).alias("n"))
        # as many entries as there are types
        votes = votes.groupBy("row_id", "key").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("type", "n")).alias("dist"))
        votes = votes.select("row_id", F.col("rows"), _weight("patch", F.col("rows")).alias("w"), F.explode("dist").alias("d"))
        return votes.select("row_id", F.col("d.type").alias("type"), (F.col("w") * F.col("d.n") / F.col("rows")).alias("w"))

    def common(df: DataFrame, groups: DataFrame) -> DataFrame:
        """(row_id, type, w): votes of the wide groups of each row of ``df``, given (key, type, n)."""
        dist = groups.groupBy("key").agg(F.sum("n").alias("rows"), F.collect_list(F.struct("type", "n")).alias("dist"))
        linked = _with_wide(df.select("row_id", *keys), materialize(dist, "dist"), F.struct("rows", "dist"))
        each = F.array(*(F.struct(F.col(f"of_{f}.rows").alias("rows"), _weight(f, F.col(f"of_{f}.rows")).alias("w"), F.col(f"of_{f}.dist").alias("dist")) for f in WIDE))
        votes = linked.select("row_id", F.explode(each).alias("g")).select("row_id", "g.rows", "g.w", F.explode("g.dist").alias("d"))
        return votes.select("row_id", F.col("d.type").alias("type"), (F.col("w") * F.col("d.n") / F.col("rows")).alias("w"))

    def voted(votes: DataFrame, to: str) -> DataFrame:
        """(row_id, {to}_w, {to}): the summed weight of a row's votes, and that of each type."""
        return votes.groupBy("row_id", "type").agg(F.sum("w").alias("w")).groupBy("row_id").agg(
            F.sum("w").alias(f"{to}_w"), F.map_from_entries(F.collect_list(F.struct("type", "w"))).alias(to)
        )

    nearby = materialize(near(links.join(seen, "key")), "votes")
    by_group = materialize(common(open_rows, wide), "votes")
    base = open_rows.join(voted(nearby.union(by_group), "obs"), "row_id", "left")
    base = base.join(nearby.select("row_id").distinct().withColumn("told", F.lit(True)), "row_id", "left")
    base = base.join(by_group.select("row_id").distinct().withColumn("grouped", F.lit(True)), "row_id", "left")
    many = links.join(asked.where("open > 1"), "key", "left_semi")
    base = base.join(many.select("row_id").distinct().withColumn("live", F.lit(True)), "row_id", "left")
    base = materialize(base.select("row_id", "cat", *keys, F.coalesce("told", F.lit(False)).alias("told"), F.col("grouped").isNull().alias("bare"), F.coalesce("live", F.lit(False)).alias("live"), "obs_w", "obs"), "base")
    moving, rest = base.where("live or bare"), base.where("not live and not bare")

    def mixed(est: bool) -> Column:
        """A row's shares of types, from what is observed and estimated."""
        w = F.coalesce("obs_w", zero)
        ew = F.coalesce("est_w", zero) if est else zero
        share = F.when((w > 0) & (ew > MOST_ESTIMATED * w), MOST_ESTIMATED * w / F.nullif(ew, zero)).otherwise(1.0)
        nothing = F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<double>"))
        obs, far = F.coalesce("obs", nothing), F.coalesce("est", nothing) if est else nothing
        total = F.nullif(w + share * ew, zero)
        return F.map_zip_with(obs, far, lambda _, a, b: (F.coalesce(a, zero) + share * F.coalesce(b, zero)) / total).alias("shares")

    def said(state: DataFrame) -> DataFrame:
        """What rows that heard from neighbours tell the wide groups."""
        each = state.where("told").select(F.explode(F.array(*keys)).alias("key"), "shares").where("key is not null").select("key", F.explode("shares").alias("type", "share"))
        return each.groupBy("key", "type").agg(F.sum(ESTIMATED * F.col("share")).alias("n"))

    state = materialize(moving.select("row_id", "cat", *keys, "told", mixed(False)), "types")
    bare = moving.where("bare")
    any_bare = not bare.isEmpty()
    fixed = materialize(said(rest.select(*keys, "told", mixed(False))), "said") if any_bare else None
    rounds, change = 0, None if state.isEmpty() else math.inf
    while not _settled("types", rounds, change, tolerance):
        rounds += 1
        own = many.join(state.select("row_id", "shares"), "row_id")
        est = own.select("key", F.col("cat").alias("cat_2"), F.explode("shares").alias("type_2", "share")).groupBy("key", "cat_2", "type_2").agg(F.sum("share").alias("n"))
        self_said = F.when(F.col("cat") == F.col("cat_2"), F.coalesce(F.col("shares")[F.col("type_2")], zero)).otherwise(zero)
        others = own.join(est, "key").withColumn("n", ESTIMATED * (F.col("n") - self_said)).where("n > 1e-9").drop("shares")
        votes = near(others)
        if any_bare:
            votes = votes.union(common(bare, fixed.union(said(state)).groupBy("key", "type").agg(F.sum("n").alias("n"))))
        votes = voted(votes, "est")
        after = materialize(moving.join(votes, "row_id", "left").select("row_id", "cat", *keys, "told", mixed(True)), "types")
        moved = F.array_max(F.transform(F.map_entries("shares"), lambda e: F.abs(e["value"] - F.coalesce(F.col("was")[e["key"]], zero))))
        change = after.join(state.select("row_id", F.col("shares").alias("was")), "row_id").agg(F.coalesce(F.max(moved), zero)).first()[0]
        discard(spark, state)
        state = after
    # where no group tells anything the whole table does
    most = typed.groupBy("type").agg(F.count("*").alias("n")).agg(F.max_by("type", F.struct("n", "type")).alias("most"), (F.max("n") / F.sum("n")).alias("most_share"))
    best = F.array_max(F.transform(F.map_entries("shares"), lambda e: F.struct(F.round(e["value"], 9).alias("share"), e["key"].alias("type"))))
    out = rest.select("row_id", mixed(False)).union(state.select("row_id", "shares")).withColumn("best", best).crossJoin(F.broadcast(most))
    out = materialize(out.select("row_id", F.coalesce("best.type", "most").alias("type_fill"), F.coalesce("best.share", "most_share").alias("type_share")), "type-fills")
    for table in (open_rows, links, asked, between, nearby, by_group, base, state, fixed):
        if table is not None:
            discard(spark, table)
    return out


def fill_missing(df: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """(row_id, mag, size, type, mag_filled, size_filled, type_filled, type_share) of every row.

    Observed numbers come back as stated, observed types as their upper-case
    code. A missing cell is flagged and filled; it stays null only if no row at
    all states the field. Values spread until none changes by more than
    ``tolerance``. ``row_id`` must be unique and not null. Rows without position,
    plate or date are filled from the groups that they do have. Other columns
    are ignored; an empty table gives an empty result.
    """
    rows = materialize(_rows(df), "impute")
    by_cat = rows.withColumns({f"w_{f}": k for f, k in zip(WIDE, _wide(F.col("cat")), strict=True)})
    types = _types(by_cat, tolerance)
    kind = F.coalesce("type", "type_fill", F.concat(F.lit("?"), "cat"))
    kinds = rows.join(types, "row_id", "left").withColumn("kind", kind)
    kinds = kinds.select("row_id", "patch", "mag", "size", *(k.alias(f"w_{f}") for f, k in zip(WIDE, _wide(F.col("kind")), strict=True)))
    numbers = _numbers(materialize(kinds, "kinds"), tolerance)
    out = rows.select("row_id", "mag", F.exp("size").alias("size"), "type").join(numbers, "row_id", "left").join(types, "row_id", "left")
    return out.select(
        "row_id",
        F.coalesce("mag", "mag_fill").alias("mag"),
        F.coalesce("size", F.exp("size_fill")).alias("size"),
        F.coalesce("type", "type_fill").alias("type"),
        *(F.col(c).isNull().alias(f"{c}_filled") for c in ("mag", "size", "type")),
        "type_share",
    )


def filled_cells(filled: DataFrame) -> DataFrame:
    """(row_id, field) of each flagged cell of a result of ``fill_missing``."""
    flags = F.array(*(F.when(F.col(f"{c}_filled"), F.lit(c)) for c in ("mag", "size", "type")))
    return filled.select("row_id", F.explode(F.array_compact(flags)).alias("field"))
