"""The yearly plan: objects assigned to months by global optimisation, and reports on it."""

from __future__ import annotations

from collections import defaultdict
from datetime import datetime

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from asterweave.functions import text
from asterweave.runtime import materialize

VARIANTS = ("A", "B", "C")


def monthly_best(daily: DataFrame) -> DataFrame:
    """(id, month, best_q_hours) of daily records."""
    return daily.groupBy(F.col("obj_id").alias("id"), F.month("day").alias("month")).agg(F.max("q_hours").alias("best_q_hours"))


def latest_monthly(best: DataFrame) -> DataFrame:
    """One row for each id and month: the latest computed that has hours, the larger hours on a tie."""
    known = best.where("best_q_hours is not null and not isnan(best_q_hours)")
    return known.groupBy("id", "month").agg(F.max_by("best_q_hours", F.struct("computed_at", "best_q_hours")).alias("best_q_hours"))


def nights_over(daily: DataFrame, min_hours: float) -> DataFrame:
    """(id, nights) with more than ``min_hours`` of quality."""
    return daily.groupBy(F.col("obj_id").alias("id")).agg(F.count_if(F.col("q_hours") > min_hours).alias("nights"))


def cost_relation(objects: DataFrame, best: DataFrame, min_hours: float) -> DataFrame:
    """(id, month, hours, ratio, elite, value) of every object and month with enough hours.

    ``ratio`` is to the object's best month. An object scoring above the median
    of all objects is elite and worth score³ times the ratio; any other a
    thousand times its catalogue's weight and a hundred times the ratio.
    """
    scores = objects.groupBy("id").agg(F.max("score").alias("score"), F.max_by("common_names", F.struct("score", "common_names")).alias("common_names"))
    median = scores.agg(F.median(F.coalesce("score", F.lit(0.0))).alias("median"))
    top = best.groupBy("id").agg(F.max("best_q_hours").alias("top")).where("top > 0")
    rows = best.join(top, "id").where(F.col("best_q_hours") >= min_hours).join(scores, "id").crossJoin(F.broadcast(median))
    score, ratio = F.coalesce("score", F.lit(0.0)), F.col("best_q_hours") / F.col("top")
    elite = score > F.col("median")
    rest = text.plan_weight(F.col("id"), F.col("common_names")) * 1000.0 + ratio * 100.0
    return rows.select(
        "id", "month", F.col("best_q_hours").alias("hours"), ratio.alias("ratio"), elite.alias("elite"),
        F.when(elite, F.pow(score, F.lit(3.0)) * ratio).otherwise(rest).alias("value"), score.alias("score"),
    )


def solve(edges: list[tuple[str, int, bool, float]], room: int) -> dict[str, int]:
    """The best assignment of objects to months, ``room`` of them to each.

    Best is: the most objects, then the most elite ones, then the greatest sum of
    values. Successive best augmenting paths over the months: an object enters a
    month, may push another on to a further month, and so on to a month with
    room. Each step is optimal for its number of objects.
    """
    options: dict[str, dict[int, tuple[int, int, float]]] = defaultdict(dict)
    for ident, month, elite, value in edges:
        options[ident][month] = (1, int(elite), value)
    months = sorted({m for own in options.values() for m in own})
    at: dict[str, int] = {}
    load = dict.fromkeys(months, 0)
    while True:
        gain: dict[int, tuple] = {}
        came: dict[int, tuple[str, int | None]] = {}
        for ident in sorted(options):
            if ident not in at:
                for m, w in options[ident].items():
                    if m not in gain or w > gain[m]:
                        gain[m], came[m] = w, (ident, None)
        moves: dict[tuple[int, int], tuple[tuple, str]] = {}
        for ident, m in at.items():
            for to, w in options[ident].items():
                if to != m:
                    d = tuple(a - b for a, b in zip(w, options[ident][m], strict=True))
                    if (m, to) not in moves or d > moves[m, to][0]:
                        moves[m, to] = (d, ident)
        for _ in months:
            changed = False
            for (m, to), (d, ident) in moves.items():
                if m in gain:
                    reached = tuple(a + b for a, b in zip(gain[m], d, strict=True))
                    if to not in gain or (reached[:2], reached[2] - 1e-9) > (gain[to][:2], gain[to][2]):
                        if not _on_path(came, m, to):
                            gain[to], came[to], changed = reached, (ident, m), True
            if not changed:
                break
        free = [m for m in gain if load[m] < room]
        if not free:
            return at
        end = max(free, key=lambda m: (gain[m], -m))
        load[end] += 1
        while end is not None:
            ident, before = came[end]
            at[ident] = end
            end = before


def _on_path(came: dict[int, tuple[str, int | None]], month: int, target: int) -> bool:
    at: int | None = month
    while at is not None:
        if at == target:
            return True
        at = came[at][1]
    return False


def assigned(cost: DataFrame, capacity: int = 3) -> DataFrame:
    """(variant, month, id, ratio, hours, score): the plan of three variants with ``capacity`` objects a month each.

    A cost depends on object and month only, so the slots of a month are one bin.
    At most as many objects as there are slots can be planned, so of each month
    only so many of the best matter; these rows, at most 12 times the slots,
    reach one task. In a month variants take turns by score, then id.
    """
    slots = 12 * capacity * len(VARIANTS)
    order = Window.partitionBy("month").orderBy(F.desc("elite"), F.desc("value"), "id")
    edges = cost.withColumn("__n", F.row_number().over(order)).where(F.col("__n") <= slots).drop("__n")
    room = capacity * len(VARIANTS)

    def plan(pdf: pd.DataFrame) -> pd.DataFrame:
        where = solve(list(zip(pdf["id"], pdf["month"], pdf["elite"], pdf["value"], strict=True)), room)
        keep = pdf[[where.get(i) == m for i, m in zip(pdf["id"], pdf["month"], strict=True)]]
        return keep[["month", "id", "ratio", "hours", "score"]]

    chosen = edges.groupBy(F.lit(0).alias("one")).applyInPandas(plan, "month int, id string, ratio double, hours double, score double")
    turn = (F.row_number().over(Window.partitionBy("month").orderBy(F.desc("score"), "id")) - 1) % len(VARIANTS)
    return chosen.select(F.get(F.array(*(F.lit(v) for v in VARIANTS)), turn).alias("variant"), "month", "id", "ratio", "hours", "score")


def annotated(objects: DataFrame, plan: DataFrame, now: datetime) -> DataFrame:
    """Objects with ``selected`` (variant, month, assignment_date), null where not planned, and labels in the names of planned ones."""
    chosen = plan.select(F.col("id").alias("__id"), F.struct("variant", "month", F.lit(now).cast("timestamp").alias("assignment_date")).alias("__s"))
    rows = objects.drop("selected").join(chosen, F.col("id") == F.col("__id"), "left")
    named = text.name_with_labels(F.col("name"), F.col("id"), text.famous_labels(F.col("extra_info")))
    rows = rows.withColumn("name", F.when(F.col("__s").isNotNull(), named).otherwise(F.col("name")))
    return rows.withColumn("selected", F.col("__s")).drop("__id", "__s")


def best_months(best: DataFrame, n: int = 3) -> DataFrame:
    """(id, place, month, best_q_hours): the ``n`` best months of each object, the earlier first on a tie."""
    w = Window.partitionBy("id").orderBy(F.desc("best_q_hours"), "month")
    return best.withColumn("place", F.row_number().over(w)).where(F.col("place") <= n).select("id", "place", "month", "best_q_hours")


def month_load(plan: DataFrame) -> DataFrame:
    """(month, n, mean_score, status) of all twelve months, empty ones too."""
    months = plan.sparkSession.range(1, 13).select(F.col("id").cast("int").alias("month"))
    sums = plan.groupBy("month").agg(F.count("*").alias("n"), F.avg("score").alias("mean_score"))
    mean = F.coalesce("mean_score", F.lit(0.0))
    status = F.when(mean >= 80, "excellent").when(mean >= 60, "good").when(mean > 0, "fair").otherwise("empty")
    return months.join(F.broadcast(sums), "month", "left").select("month", F.coalesce("n", F.lit(0).cast("long")).alias("n"), F.round(mean, 6).alias("mean_score"), status.alias("status"))


# The words of the grades from 90, 80, 70 percent, and below.
GRADES = ("WYBITNA", "BARDZO DOBRA", "DOBRA", "KOMPROMISOWA")


def quality_grade(plan: DataFrame) -> DataFrame:
    """(quality, grade): the mean ratio as a percentage, and its grade."""
    q = F.avg("ratio") * 100
    grade = F.when(q >= 90, GRADES[0]).when(q >= 80, GRADES[1]).when(q >= 70, GRADES[2]).otherwise(GRADES[3])
    return plan.agg(F.round(q, 6).alias("quality"), grade.alias("grade"))


def gems(plan: DataFrame, min_score: float = 80.0, below: float = 0.7) -> DataFrame:
    """Planned objects of a high score outside their best time."""
    return plan.where((F.col("score") >= min_score) & (F.col("ratio") < below))


def plan_totals(objects: DataFrame) -> DataFrame:
    """(variant, n): planned objects of each variant, and of all under null."""
    return objects.where("selected is not null").rollup(F.col("selected.variant").alias("variant")).agg(F.count("*").alias("n"))


def plan_kpis(objects: DataFrame, top: int = 100) -> DataFrame:
    """(n_top, n_assigned, n_unassigned, pct): how many of the ``top`` objects by score are planned."""
    best = objects.orderBy(F.desc("score"), "id").limit(top)
    n, done = F.count("*"), F.count_if(F.col("selected").isNotNull())
    return best.agg(n.alias("n_top"), done.alias("n_assigned"), (n - done).alias("n_unassigned"), F.round(100.0 * done / n, 4).alias("pct"))


def best_night(daily: DataFrame, month: Column | None = None) -> DataFrame:
    """(obj_id, day, m_hours): the day with the most hours without Moon, the first on a tie; within ``month`` if given."""
    rows = daily if month is None else daily.where(F.month("day") == month)
    first = F.struct("m_hours", -F.unix_date("day"))
    return rows.groupBy("obj_id").agg(F.max_by("day", first).alias("day"), F.max("m_hours").alias("m_hours"))


def numbered_pages(objects: DataFrame, first: int = 16, step: int = 2) -> DataFrame:
    """(id, page): pages by id, two for each object. Range-partitioned: only counts of partitions meet in one task."""
    rows = materialize(objects.select("id").repartitionByRange("id").withColumn("__part", F.spark_partition_id()), "pages")
    counts = rows.groupBy("__part").agg(F.count("*").alias("n"))
    before = counts.select("__part", (F.sum("n").over(Window.orderBy("__part")) - F.col("n")).alias("before"))
    place = F.row_number().over(Window.partitionBy("__part").orderBy("id"))
    return rows.withColumn("__i", place).join(F.broadcast(before), "__part").select("id", (first + step * (F.col("before") + F.col("__i") - 1)).alias("page"))


def two_columns(planned: DataFrame) -> DataFrame:
    """(id, name, side, line): planned objects by lower-case name, the first half left. The list of a printed page."""
    order = Window.orderBy(F.lower("name"), "id")
    n = F.count("*").over(Window.partitionBy())
    place = F.row_number().over(order)
    half = F.ceil(n / 2)
    return planned.select(
        "id", "name", F.when(place <= half, "left").otherwise("right").alias("side"), F.when(place <= half, place).otherwise(place - half).cast("int").alias("line")
    )


def shifted_segments(segments: Column, tz_offset: Column, hours: float = 17.0) -> Column:
    """Segments moved from the printed reference zone to local time, without those outside the chart."""
    by = tz_offset - 1.0
    moved = F.transform(segments, lambda s: F.struct((s["start"] + by).alias("start"), (s["end"] + by).alias("end")))
    return F.filter(moved, lambda s: (s["end"] > 0) & (s["start"] < hours))


def chart_offset(local_hour: Column, hours: float = 17.0) -> Column:
    """Offset of a local hour from 14:00 on the chart: hours before noon belong to the next day; kept within the chart."""
    h = F.when(local_hour < 12, local_hour + 24).otherwise(local_hour) - 14.0
    return F.greatest(F.lit(0.0), F.least(F.lit(hours), h))
