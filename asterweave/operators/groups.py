"""Records within a tolerance of each other, consolidated into groups.

Positions fall into cubic cells so small that all rows of a cell are linked;
only links between cells remain to be found. Cells meet their neighbours by an
equi-join on larger bins. The bounding boxes of two cells' positions accept or
reject most pairs; positions are compared only where the boxes leave it open,
and crowded cells are first split further, so that no cell's rows are ever
paired in full. Links between cells then go to the component operator.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import sky
from asterweave.operators.components import component_labels
from asterweave.runtime import materialize

#: Cells along the edge of a bin.
BIN_CELLS = 8
#: Cells reach so many cells far: the side is the tolerance by the root of three.
REACH = 2
#: Two cells with at most so many pairs of positions are compared position by position.
EXACT_PAIRS = 4096
#: Each finer level splits a side into so many.
SPLIT = 4


def _index(side: float) -> list[Column]:
    return [F.floor(F.col(c) / side) for c in "xyz"]


def _box() -> list[Column]:
    return [f(c).alias(f"{c}{n}") for c in "xyz" for f, n in ((F.min, "0"), (F.max, "1"))]


def _bounds(p: str, q: str) -> tuple[Column, Column]:
    """Squares of the least and the greatest distance of two boxes."""
    least = most = F.lit(0.0)
    for c in "xyz":
        a0, a1, b0, b1 = (F.col(f"{s}.{c}{n}") for s in (p, q) for n in "01")
        gap = F.greatest(a0 - b1, b0 - a1, F.lit(0.0))
        span = F.greatest(a1 - b0, b1 - a0)
        least, most = least + gap * gap, most + span * span
    return least, most


def _decide(pairs: DataFrame, r2: float) -> tuple[DataFrame, DataFrame]:
    """(accepted, open) of pairs of nodes ``p`` and ``q``."""
    least, most = _bounds("p", "q")
    judged = materialize(pairs.withColumn("most", most).where(least <= r2), "judged")
    return judged.where(F.col("most") <= r2).select("a", "b").distinct(), judged.where(F.col("most") > r2)


def _links(places: DataFrame, cells: DataFrame, side: float, r2: float) -> DataFrame:
    """(a, b): linked cells, by the roots of both."""
    node = F.struct("root", "m", *(f"{c}{n}" for c in "xyz" for n in "01"))
    ids = [F.col("i"), F.col("j"), F.col("k")]

    def bin_of(shift: Sequence[int]) -> Column:
        return sky.packed(*(F.floor((i + s) / BIN_CELLS) for i, s in zip(ids, shift, strict=True)))

    own = bin_of((0, 0, 0))
    ends = (-REACH, REACH)
    bins = F.array_distinct(F.array(own, *(bin_of((a, b, c)) for a in ends for b in ends for c in ends)))
    left = cells.select(own.alias("bin"), own.alias("home"), node.alias("p"), *(i.alias(f"p{n}") for n, i in enumerate(ids)))
    # Copies go to bins of lower number only, so that each pair meets once.
    right = cells.select(F.explode(F.filter(bins, lambda x: x <= own)).alias("bin"), own.alias("from"), node.alias("q"), *(i.alias(f"q{n}") for n, i in enumerate(ids)))
    met = left.join(right, "bin").where((F.col("from") != F.col("home")) | (F.col("p.root") < F.col("q.root")))
    for n in range(3):
        met = met.where(F.abs(F.col(f"p{n}") - F.col(f"q{n}")) <= REACH)
    pairs = met.select(F.col("p.root").alias("a"), F.col("q.root").alias("b"), "p", "q")
    links, live = _decide(pairs, r2)

    def compared(pairs: DataFrame, of: DataFrame, keys: list[str]) -> DataFrame:
        """Linked cells among pairs of nodes, by comparing their positions."""
        pa = of.select(*(F.col(k).alias(f"a_{k}") for k in keys), *(F.col(c).alias(f"{c}1") for c in "xyz"))
        pb = of.select(*(F.col(k).alias(f"b_{k}") for k in keys), *(F.col(c).alias(f"{c}2") for c in "xyz"))
        d2 = sum(((F.col(f"{c}1") - F.col(f"{c}2")) * (F.col(f"{c}1") - F.col(f"{c}2")) for c in "xyz"), F.lit(0.0))
        met = pairs.join(pa, [f"a_{k}" for k in keys]).join(pb, [f"b_{k}" for k in keys])
        return met.where(d2 <= r2).select("a", "b").distinct()

    few = F.col("p.m").cast("double") * F.col("q.m") <= EXACT_PAIRS
    by_root = places.select("root", "x", "y", "z")
    open_pairs = live.select("a", "b", "p", "q")
    links = links.union(compared(open_pairs.where(few).select("a", "b", F.col("a").alias("a_root"), F.col("b").alias("b_root")), by_root, ["root"]))
    crowded = open_pairs.where(~few).select("a", "b", F.lit(0).cast("long").alias("a_node"), F.lit(0).cast("long").alias("b_node"))
    node_of, level = F.lit(0).cast("long"), 0
    while not crowded.isEmpty():
        crowded = crowded.join(links, ["a", "b"], "left_anti")
        level += 1
        finer = F.xxhash64(*_index(side / SPLIT**level))
        inside = crowded.select(F.col("a").alias("root")).union(crowded.select("b")).distinct()
        at = materialize(places.join(inside, "root", "left_semi").select("root", "x", "y", "z", node_of.alias("up"), finer.alias("node")), "finer")
        nodes = at.groupBy("root", "up", "node").agg(F.count("*").alias("m"), *_box())
        shape = F.struct("node", "m", *(f"{c}{n}" for c in "xyz" for n in "01"))
        pa = nodes.select(F.col("root").alias("a"), F.col("up").alias("a_node"), shape.alias("p"))
        pb = nodes.select(F.col("root").alias("b"), F.col("up").alias("b_node"), shape.alias("q"))
        sub = crowded.join(pa, ["a", "a_node"]).join(pb, ["b", "b_node"]).select("a", "b", "p", "q")
        sure, live = _decide(sub, r2)
        left_open = live.join(sure, ["a", "b"], "left_anti")
        pairs = left_open.select("a", "b", F.col("a").alias("a_root"), F.col("p.node").alias("a_node"), F.col("b").alias("b_root"), F.col("q.node").alias("b_node"), few.alias("few"))
        links = links.union(sure).union(compared(pairs.where("few"), at, ["root", "node"]))
        crowded = materialize(pairs.where("not few").select("a", "b", "a_node", "b_node"), "crowded")
        node_of = finer
    return links


def tolerance_groups(df: DataFrame, arcmin: float = 0.6, carry: Sequence[Column] = (), key: str = "row_id") -> DataFrame:
    """(key, group_id, and the columns of ``carry``) of every row in a group of two or more.

    Rows at most ``arcmin`` of great-circle distance apart are linked; a group
    holds all rows linked directly or through others, and its id is its smallest
    ``key``. Rows without a usable position, a null key, and rows alone are in no
    group. Rows of one position, however many, cost one position. Right ascension
    counts modulo 360. ``carry`` are expressions on the input, computed along.
    """
    r = sky.chord(arcmin)
    r2, side = r * r, r / math.sqrt(3.0) * (1.0 - 1e-9)
    if side < 2.5 / (1 << sky.AXIS_BITS):
        raise ValueError("a tolerance this small cannot be gridded")
    ra, dec = sky.usable_ra(F.col("ra")), sky.usable_dec(F.col("dec"))
    x, y, z = sky.unit_vector(ra, dec)
    rows = df.where(F.col(key).isNotNull() & ra.isNotNull() & dec.isNotNull()).select(
        F.col(key).alias("__key"), x.alias("x"), y.alias("y"), z.alias("z"), F.struct(F.lit(0).alias("__"), *carry).alias("__carry")
    )
    i, j, k = _index(side)
    places = materialize(rows.groupBy("x", "y", "z").agg(F.min("__key").alias("root"), F.count("*").alias("rows")), "places")
    cells = materialize(
        places.groupBy(i.alias("i"), j.alias("j"), k.alias("k")).agg(
            F.min("root").alias("root"), F.sum("rows").alias("rows"), F.count("*").alias("m"), *_box()
        ),
        "cells",
    )
    cell = sky.packed(F.col("i"), F.col("j"), F.col("k"))
    # A cell of one position is its own box.
    alone = cells.where("m = 1").select("root", *(F.col(f"{c}0").alias(c) for c in "xyz"))
    shared = places.select("x", "y", "z", sky.packed(i, j, k).alias("cell")).join(cells.where("m > 1").select(cell.alias("cell"), "root"), "cell")
    links = _links(shared.select("root", "x", "y", "z").union(alone), cells, side, r2)
    labels = component_labels(links)
    grouped = cells.select(cell.alias("cell"), "root", "rows").join(labels.withColumnRenamed("node", "root"), "root", "left")
    grouped = grouped.where("label is not null or rows > 1").select("cell", F.coalesce("label", "root").alias("group_id"))
    met = rows.select("__key", "__carry", sky.packed(i, j, k).alias("cell")).join(grouped, "cell")
    named = [F.col(f"__carry.{c}") for c in met.select("__carry.*").columns if c != "__"]
    return met.select(F.col("__key").alias(key), "group_id", *named)
