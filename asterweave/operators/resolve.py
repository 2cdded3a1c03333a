"""Entity resolution of catalogue rows: merging neighbours and covering frames."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import sky, text
from asterweave.operators.groups import tolerance_groups
from asterweave.runtime import BROADCAST_ROWS, discard, materialize, number, small_side

#: Sizes above this many arcmin don't count as the size of a cluster.
SIZE_CAP = 300.0


def capped_size(size: Column, leader: Column, cap: float = SIZE_CAP) -> Column:
    """Aggregate: the largest size up to the cap, the cap if all are larger, the leader's own if none is known."""
    return F.coalesce(F.max(F.when(size <= cap, size)), F.when(F.count(size) > 0, F.lit(cap)), leader)


def with_component(df: DataFrame, arcmin: float, key: str = "row_id") -> DataFrame:
    """``df`` with ``component``: the smallest key among all rows linked within ``arcmin``, directly or not. No pair is formed."""
    labels = tolerance_groups(df, arcmin, key=key)
    joined = df.join(labels.select(F.col(key).alias("__node"), F.col("group_id").alias("__label")), F.col(key) == F.col("__node"), "left")
    kept = [c for c in df.columns if c != "component"]
    return joined.select(*kept, F.coalesce("__label", key).alias("component"))


def smart_merge(df: DataFrame, arcmin: float = 3.0, key: str = "row_id", groups: DataFrame | None = None) -> DataFrame:
    """One row for each chain of neighbours (id, ra, dec, size, mag, type, extra_info, common_names, priority, catalog, members).

    The leader has the lowest priority, then the largest size (unknown last),
    then the lowest key. Position, magnitude and type are the leader's; the size
    is the capped largest one; ``extra_info`` are all other designations;
    ``common_names`` all names without those contained in longer ones. A group's
    texts are gathered as sets, distinct ones only. Rows without a usable
    position stay for themselves. ``groups`` (key, component) may replace the
    search for neighbours.
    """
    rows = with_component(df, arcmin, key) if groups is None else df.drop("component").join(groups, key, "left").withColumn("component", F.coalesce("component", key))
    size = number(F.col("size"))
    order = F.struct(F.coalesce(F.col("priority"), F.lit(2**31 - 1)), size.isNull(), -size, F.col(key))
    lead = F.min_by(F.struct("id", "ra", "dec", "size", "mag", "type", "priority", "catalog"), order)
    merged = rows.groupBy("component").agg(
        lead.alias("l"),
        capped_size(size, number(lead["size"])).alias("size"),
        F.collect_set("id").alias("ids"),
        F.collect_set("extra_info").alias("extras"),
        F.collect_set("common_names").alias("names"),
        F.count("*").alias("members"),
    )
    others = F.array_except(text.id_tokens(F.col("ids")), F.array(F.trim(F.col("l.id"))))
    extra = F.array_distinct(F.concat(others, text.id_tokens(F.col("extras"))))
    return merged.select(
        "component", F.trim("l.id").alias("id"), "l.ra", "l.dec", "size", "l.mag", "l.type",
        text.joined_sorted(extra).alias("extra_info"), text.distinct_names(F.col("names")).alias("common_names"),
        "l.priority", "l.catalog", "members",
    )


def _reached(df: DataFrame, side: float, r: float) -> DataFrame:
    """``df`` (with x, y, z) once for each ``cell`` of ``side`` of which some place may be within ``r`` of the position."""
    far, apart = math.ceil(r / side), F.lit(0.0)
    for c in "xyz":
        own = F.floor(F.col(c) / side)
        df = df.withColumn(f"__{c}", F.explode(F.sequence(own - far, own + far)))
        low = F.col(f"__{c}") * side
        gap = F.greatest(low - F.col(c), F.col(c) - low - side, F.lit(0.0))
        apart = apart + gap * gap
        df = df.where(apart <= r * r * (1 + 1e-6))
    return df.withColumn("cell", sky.packed(*(F.col(f"__{c}") for c in "xyz"))).drop(*(f"__{c}" for c in "xyz"))


def _placed(df: DataFrame, side: float) -> DataFrame:
    """``df`` with x, y, z and the ``cell`` of ``side`` that holds them, of the position in its ``place``."""
    x, y, z = sky.unit_vector(F.col("place.ra"), F.col("place.dec"))
    return df.withColumns({"x": x, "y": y, "z": z}).withColumn("cell", sky.cell_of(F.col("x"), F.col("y"), F.col("z"), side))


def _distance2(p: Callable[[str], Column], q: Callable[[str], Column]) -> Column:
    return sum(((p(c) - q(c)) * (p(c) - q(c)) for c in "xyz"), F.lit(0.0))


def cover_leaders(rows: DataFrame, degrees: float) -> DataFrame:
    """``rows`` with ``leader`` of a greedy cover: in the order of ``place``, each uncovered row leads and covers its uncovered neighbours.

    ``place`` is a struct that orders the rows and ends with usable ``ra`` and
    ``dec``; ``leader`` is that of the leading row. Neighbours are less than
    ``degrees`` apart. Rows without a usable position lead themselves.

    The same result as the sequential loop, in rounds, and no pair of rows is
    formed: of each cell only the first undecided row may lead; it does if no
    cell within reach has an earlier one. What new leaders reach is decided and
    leaves the rounds. Cells are so small that each has one leader at most. At
    the end each row joins the first leader that reaches it; leaders lie
    ``degrees`` apart, so that few reach a cell. ``rows`` are read in each of
    the first steps and should be materialized.
    """
    spark, r = rows.sparkSession, sky.chord(degrees * 60.0)
    if degrees <= 0:
        return rows.withColumn("leader", F.col("place"))
    least = 4.0 / (1 << sky.AXIS_BITS)
    fine, wide = max(r / math.sqrt(3.0) * (1.0 - 1e-9), least), max(r, least)
    first_of, col = F.min(F.struct("place", "x", "y", "z")).alias("f"), F.col
    live, leading = rows.where("place.ra is not null and place.dec is not null").select("place"), None
    whole = live
    while True:
        firsts = materialize(_placed(live, fine).groupBy("cell").agg(first_of).select("f.*", col("cell").alias("home")), "firsts")
        n = firsts.count()
        if leading is not None and not n:
            break
        others = firsts.select(col("home").alias("cell"), col("place").alias("other"))
        others = F.broadcast(others) if n <= BROADCAST_ROWS else others
        waits = _reached(firsts, fine, r).join(others, "cell").where("other < place").select("home").distinct()
        new = materialize(firsts.join(waits, "home", "left_anti").select("place", "x", "y", "z"), "leaders")
        discard(spark, firsts)
        leading = new if leading is None else leading.union(new)
        near = _reached(new, wide, r).select("cell", *(col(c).alias(f"{c}2") for c in "xyz"))
        near = F.broadcast(near) if new.count() * 27 <= BROADCAST_ROWS else near  # a cell and its 26 neighbours
        met = (col("l.cell") == col("n.cell")) & (_distance2(lambda c: col(f"l.{c}"), lambda c: col(f"n.{c}2")) < r * r)
        rest = materialize(_placed(live, wide).alias("l").join(near.alias("n"), met, "left_anti").select("place"), "live")
        if live is not whole:
            discard(spark, live)
        live = rest
    each = F.struct("place", "x", "y", "z")
    near = materialize(_reached(leading, wide, r).groupBy("cell").agg(F.array_sort(F.collect_list(each)).alias("near")), "near")
    reaching = F.filter("near", lambda q: _distance2(col, lambda c: q[c]) < r * r)
    found = _placed(rows, wide).join(small_side(near), "cell", "left").withColumn("leader", F.coalesce(F.get(reaching, F.lit(0))["place"], "place"))
    return found.select(*rows.columns, "leader")


def atlas_frames(df: DataFrame, degrees: float = 2.0, key: str = "row_id") -> DataFrame:
    """One row for each frame of a greedy cover by score: the leader with what its frame holds.

    ``df`` has (key, id, ra, dec, size, extra_info, common_names, final_score) and
    usable positions. The size is the capped largest one of the frame. A leader
    of the NGC, IC or Sh2 catalogues keeps its id; any other takes the preferred
    designation of the frame, and the position of the frame's row of that id.
    Whole name texts are joined in rank order, each once. Type, magnitude and
    score stay the leader's.
    """
    first = [F.coalesce(F.nanvl(-F.col("final_score"), F.lit(math.inf)), F.lit(math.inf)), F.coalesce(-number(F.col("size")), F.lit(math.inf)), F.col(key)]
    place = F.struct(*(c.alias(n) for c, n in zip(first, ("score", "size", "key"), strict=True)), sky.usable_ra(F.col("ra")).alias("ra"), sky.usable_dec(F.col("dec")).alias("dec"))
    rows = df.select(key, "id", "ra", "dec", "size", "extra_info", "common_names", "final_score", place.alias("place"))
    cover = cover_leaders(materialize(rows, "cover-rows"), degrees)
    size = number(F.col("size"))
    rank = F.struct("place.score", "place.size", "place.key").alias("rank")
    frame = F.struct(rank, "id", "ra", "dec")
    names = F.struct(rank, F.trim("common_names").alias("n"))
    lead = F.min_by(F.struct("id", "ra", "dec", "size", "final_score", key), "place")
    groups = cover.groupBy("leader").agg(
        lead.alias("l"), capped_size(size, number(lead["size"])).alias("size"),
        F.array_sort(F.collect_list(frame)).alias("frame"), F.collect_set("extra_info").alias("extras"),
        F.array_sort(F.collect_list(F.when(F.trim("common_names") != "", names))).alias("names"), F.count("*").alias("members"),
    )
    own = F.trim(F.col("l.id"))
    ids = F.filter(F.transform("frame", lambda r: r["id"]), lambda t: t.isNotNull())
    known = F.filter(F.array_distinct(F.concat(ids, F.flatten(F.transform("extras", text.tokens)))), lambda t: (t != "") & (F.lower(t) != "nan"))
    keeps = F.upper(own).rlike("^(NGC|IC|SH2-)")
    best = F.when(keeps, own).otherwise(text.best_id(own, F.filter("known", lambda t: t != own)))
    here = F.filter("frame", lambda r: r["id"] == F.col("best"))
    moved = (F.col("best") != own) & (F.size(here) > 0)
    out = groups.withColumn("known", known).withColumn("best", best)
    return out.select(
        F.col("l")[key].alias(key), F.col("best").alias("id"),
        F.when(moved, F.element_at(here, 1)["ra"]).otherwise(F.col("l.ra")).alias("ra"),
        F.when(moved, F.element_at(here, 1)["dec"]).otherwise(F.col("l.dec")).alias("dec"),
        "size", F.col("l.final_score").alias("final_score"),
        text.joined_sorted(F.array_distinct(F.filter("known", lambda t: t != F.col("best")))).alias("extra_info"),
        F.array_join(F.array_distinct(F.transform("names", lambda n: n["n"])), ", ").alias("common_names"), "members",
    )
