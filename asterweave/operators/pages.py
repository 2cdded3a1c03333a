"""Data of the printed pages: one row for each planned object, and the facts of the title page."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from asterweave.functions import ephem, lookups, text
from asterweave.operators.plan import chart_offset, numbered_pages, shifted_segments


def night_span(sun_pts: Column, tz_offset: Column, hours: float = 17.0) -> Column:
    """Where dusk and dawn lie on the chart, in hours from 14:00 local time; the whole chart with fewer than two points."""

    def offset(ts: Column) -> Column:
        local = (F.unix_micros(ts) / 3.6e9 + tz_offset) % 24
        return chart_offset(local, hours)

    whole = F.struct(F.lit(0.0).alias("dusk"), F.lit(hours).alias("dawn"))
    known = F.struct(offset(F.get(sun_pts, F.lit(0))).alias("dusk"), offset(F.get(sun_pts, F.size(sun_pts) - 1)).alias("dawn"))
    return F.when(F.size(sun_pts) >= 2, known).otherwise(whole)


def object_pages(objects: DataFrame, daily: DataFrame, first: int = 16, width: int = 66) -> DataFrame:
    """One row for each planned object with daily records: page, labels, and its best nights.

    The best nights, of the assigned month and of the year, have the most hours
    without Moon, the first on a tie; with them come their hours, the segments
    moved to local time, and dusk and dawn on the chart. ``objects`` has id,
    name, type, extra_info, common_names and selected.
    """
    planned = objects.where("selected is not null")
    own = planned.select(F.col("id").alias("obj_id"), F.col("selected.month").alias("month"))
    record = F.struct("day", "q_hours", "m_hours", shifted_segments(F.col("qual_segments"), F.col("tz_offset")).alias("segments"), night_span(F.col("sun_pts"), F.col("tz_offset")).alias("night"))
    rows = daily.join(own, "obj_id").select("obj_id", "month", "day", "m_hours", record.alias("r"))
    order = F.struct("m_hours", -F.unix_date("day"))
    in_month = F.when(F.month("day") == F.col("month"), order)
    best = rows.groupBy("obj_id").agg(F.max_by("r", in_month).alias("month_best"), F.max_by("r", order).alias("year_best"))
    label = F.coalesce(lookups.lookup(lookups.TYPE_LABELS, F.trim("type")), F.col("type"), F.lit("Inny"))
    return planned.join(best, F.col("id") == F.col("obj_id")).join(numbered_pages(planned, first), "id").select(
        "id", "page", text.display_name(F.col("common_names"), F.col("name"), F.col("id")).alias("title"), label.alias("type_label"),
        text.cut(text.designation_lines(F.col("extra_info")), width).alias("designations"), "selected", "month_best", "year_best",
    )


def title_facts(config: DataFrame, objects: DataFrame) -> DataFrame:
    """The facts of the title page: place, year, limits, field of view of the camera and the number of planned objects."""
    planned = objects.agg(F.count_if(F.col("selected").isNotNull()).alias("n_selected"))
    c = F.col("parameters.camera")
    fov = ephem.field_of_view(c["lens_focal_length"], c["sensor_width"], c["sensor_height"])
    return config.crossJoin(F.broadcast(planned)).select(
        F.trim(F.split_part(F.col("location.name"), F.lit(","), F.lit(1))).alias("place"), "year", F.col("parameters.minalt").alias("minalt"),
        F.col("parameters.sunlimit").alias("sunlimit"), F.col("parameters.minhours").alias("minhours"), F.col("parameters.prefer_famous").alias("prefer_famous"),
        F.round(fov["title_w"], 6).alias("fov_w"), F.round(fov["title_h"], 6).alias("fov_h"), "n_selected",
    )
