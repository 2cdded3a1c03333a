"""The best representative of each group of duplicate records.

A record dominates another if it is at least as complete, at least as recent and
at least as trusted. The undominated records of a group form the first layer (its
skyline), those undominated without it the second, and so on. The first layer's
record of best policy survives; what it does not state is filled from the rest
of the first layer, then from the next layers, by the same policy in each: the
lowest priority, then the latest date, then the smallest row_id.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Trust of a record without a priority: below all others.
NO_PRIORITY = 2**31 - 1


def _versions(members: DataFrame, stated: Sequence[Column], carry: Sequence[str]) -> DataFrame:
    """(group_id, ladder): of each group the records that can matter, by policy.

    Of the records of one priority that state the same fields only the latest,
    then that of the smallest row_id, stays, by a map-side combined maximum: the
    others are superseded by it in all they state. So a group of any size
    reaches a task as one record for each level of trust and set of fields.
    """
    mask = sum((F.when(s, 1 << i).otherwise(0) for i, s in enumerate(stated)), F.lit(0))
    rows = members.where("row_id is not null").select(
        "group_id", F.coalesce(F.col("priority"), F.lit(NO_PRIORITY)).alias("priority"), mask.alias("mask"),
        F.unix_micros(F.col("updated_at").cast("timestamp")).alias("at"), "row_id", F.struct(F.lit(0).alias("__"), *carry).alias("carried"),
    )
    latest = F.struct(F.coalesce("at", F.lit(-(2**63))), -F.col("row_id"))
    kept = rows.groupBy("group_id", "priority", "mask").agg(F.max_by(F.struct("at", "row_id", "carried"), latest).alias("r"))
    # struct order is the policy: a null date comes last
    record = F.struct("priority", -F.coalesce("r.at", F.lit(-(2**63) + 1)), "r.row_id", "mask", "r.carried")
    named = record.cast(f"struct<priority:int,minus_at:bigint,row_id:bigint,mask:int,carried:{kept.select('r.carried').schema[0].dataType.simpleString()}>")
    return kept.groupBy("group_id").agg(F.sort_array(F.collect_list(named)).alias("ladder"))


def _layered(ladder: Column, kind: str, by_count: bool) -> Column:
    """The ladder's records with their dominance layer, from 1."""

    def dominates(d: Column, r: Column) -> Column:
        # d comes earlier in the ladder, so that it is at least as trusted; of one date the smaller row_id counts as the more recent
        recent = (d["minus_at"] < r["minus_at"]) | ((d["minus_at"] == r["minus_at"]) & (d["row_id"] < r["row_id"]))
        complete = F.bit_count(d["mask"]) >= F.bit_count(r["mask"]) if by_count else d["mask"].bitwiseAND(r["mask"]) == r["mask"]
        return recent & complete

    def place(done: Column, r: Column) -> Column:
        above = F.transform(F.filter(done, lambda d: dominates(d["r"], r)), lambda d: d["layer"])
        return F.array_append(done, F.struct((F.coalesce(F.array_max(above), F.lit(0)) + 1).alias("layer"), r.alias("r")))

    return F.aggregate(ladder, F.array().cast(f"array<struct<layer:int,r:{kind}>>"), place)


def dominance_layers(members: DataFrame, stated: Mapping[str, Column], by_count: bool = False) -> DataFrame:
    """(group_id, row_id, layer) of every record that is not superseded by one of its trust that states the same fields."""
    versions = _versions(members, list(stated.values()), [])
    kind = versions.schema["ladder"].dataType.elementType.simpleString()
    placed = versions.select("group_id", F.explode(_layered(F.col("ladder"), kind, by_count)).alias("p"))
    return placed.select("group_id", F.col("p.r.row_id").alias("row_id"), "p.layer")


def surviving_records(members: DataFrame, stated: Mapping[str, Column], carry: Sequence[str] = (), by_count: bool = False) -> DataFrame:
    """(group_id, row_id, the columns of ``carry``, and for each field {field}_row, {field}_layer, {field}_from) of each group.

    ``members`` has (row_id, group_id, priority, updated_at), the columns of
    ``carry``, and what the expressions of ``stated`` need, which are true where
    a record states the field. ``row_id`` is the surviving record and the carried
    columns are its own. A field's origin is the surviving record if it states
    it, or else the record that fills it: {field}_row, {field}_layer its layer,
    and {field}_from its carried columns; all null if no record states it.

    By default a record is as complete as another if it states all fields that
    that one states. Then the record preferred by policy for a field is never
    dominated, by anything, and each field has its value from the first layer.
    With ``by_count`` a record is as complete as another if it states as many
    fields; a preferred record may then lie in a deeper layer, and a less
    trusted but undominated one go first. A null priority is least trusted, a
    null date oldest. Rows with a null ``row_id`` are ignored, and an empty
    table gives an empty result.
    """
    versions = _versions(members, list(stated.values()), carry)
    kind = versions.schema["ladder"].dataType.elementType.simpleString()
    # by layer, and in each by the ladder's order, which is the policy
    layered = F.transform(_layered(F.col("ladder"), kind, by_count), lambda p, i: F.struct(p["layer"].alias("layer"), i.alias("i"), p["r"].alias("r")))
    placed = versions.select("group_id", F.array_sort(layered).alias("placed"))
    columns = [F.col("first")["r"]["row_id"].alias("row_id"), *(F.col("first")["r"]["carried"][c].alias(c) for c in carry)]

    def states(bit: int) -> Callable[[Column], Column]:
        return lambda p: p["r"]["mask"].bitwiseAND(bit) > 0

    for i, field in enumerate(stated):
        own = F.get(F.filter("placed", states(1 << i)), 0)
        columns += [own["r"]["row_id"].alias(f"{field}_row"), own["layer"].alias(f"{field}_layer"), own["r"]["carried"].alias(f"{field}_from")]
    return placed.withColumn("first", F.get("placed", 0)).select("group_id", *columns)


def surviving_cells(members: DataFrame, stated: Mapping[str, Column]) -> DataFrame:
    """(group_id, field, row_id): the record that each group's field takes its value from; fields that none states give no row."""
    best = surviving_records(members, stated)
    cells = F.array(*(F.struct(F.lit(f).alias("field"), F.col(f"{f}_row").alias("row_id")) for f in stated))
    return best.select("group_id", F.explode(cells).alias("c")).select("group_id", "c.*").where("row_id is not null")
