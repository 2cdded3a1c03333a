"""Connected components of an edge table by minimum labels and pointer jumping."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from asterweave.runtime import discard, materialize


def component_labels(edges: DataFrame, a: str = "a", b: str = "b", jumps: int = 2) -> DataFrame:
    """(node, label) for every node of ``edges``: the smallest node linked to it directly or through others.

    Each round hooks every root onto the smallest root beside it, shortens the
    resulting pointers by pointer jumping, and contracts the edges onto the new
    roots; it is written to shared storage and the loop ends when no edge joins
    two labels. Roots at least halve in each round, so rounds grow with the
    logarithm of the longest chain. Aggregations are minima with map-side
    combination, so that a hub with many links costs its mapper, not one task.

    Self links, repeated links and links with a null end change nothing; an
    empty edge table gives an empty result.
    """
    spark = edges.sparkSession
    ends = edges.select(F.col(a).alias("u"), F.col(b).alias("v")).where("u <> v")
    live = materialize(ends.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "edges")
    hooks: list[DataFrame] = []
    while not live.isEmpty():
        # for each root its smallest neighbour; a root without a smaller one keeps itself
        beside = live.select(F.col("v").alias("node"), F.col("u").alias("near")).union(
            live.select(F.col("u").alias("node"), F.col("u").alias("near"))
        )
        parent = materialize(beside.groupBy("node").agg(F.min("near").alias("parent")), "hooks")
        for _ in range(jumps):
            up = parent.select(F.col("node").alias("parent"), F.col("parent").alias("grand"))
            shorter = materialize(parent.join(up, "parent").select("node", F.col("grand").alias("parent")), "hooks")
            discard(spark, parent)
            parent = shorter
        hooks.append(parent)
        pu = parent.select(F.col("node").alias("u"), F.col("parent").alias("pu"))
        pv = parent.select(F.col("node").alias("v"), F.col("parent").alias("pv"))
        moved = (
            live.join(pu, "u").join(pv, "v").where("pu <> pv")
            .select(F.least("pu", "pv").alias("u"), F.greatest("pu", "pv").alias("v")).distinct()
        )
        contracted = materialize(moved, "edges")
        discard(spark, live)
        live = contracted
    if not hooks:
        return live.select(F.col("u").alias("node"), F.col("v").alias("label"))
    labels = hooks[0].select("node", F.col("parent").alias("label"))
    for later in hooks[1:]:
        step = later.select(F.col("node").alias("label"), F.col("parent").alias("next"))
        labels = labels.join(step, "label", "left").select("node", F.coalesce("next", "label").alias("label"))
    return materialize(labels, "labels") if len(hooks) > 1 else labels
