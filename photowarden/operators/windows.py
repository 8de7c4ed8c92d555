"""The one window order that all frame operators share: by video, then by frame number."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F


def by_frame() -> WindowSpec:
    return Window.partitionBy("video_id").orderBy("frame_idx")


def last_rows(k: int) -> WindowSpec:
    """This row and the k-1 before it."""
    return by_frame().rowsBetween(-(k - 1), 0)


def so_far() -> WindowSpec:
    return by_frame().rowsBetween(Window.unboundedPreceding, 0)


def before() -> WindowSpec:
    return by_frame().rowsBetween(Window.unboundedPreceding, -1)


def within_seconds(aggregate: str, seconds: float, *also_by: str) -> Column:
    """A SQL aggregate over this row and those of at most so many seconds before it."""
    by = ", ".join(("video_id", *also_by))
    return F.expr(f"{aggregate} OVER (PARTITION BY {by} ORDER BY ts RANGE BETWEEN {float(seconds)!r}D PRECEDING AND CURRENT ROW)")


def restarted(rows: DataFrame, segment: Column) -> DataFrame:
    """Videos cut where the segment (a number that grows in the order of frames) changes, so that every state begins anew:
    video_id becomes <video>#<segment>, frames count from 1, and of_video and segment keep what was there. A null video or
    segment is the empty string or 0.

    `levels_carried` gives back a state that a restart leaves alone.
    """
    whole, part = F.coalesce(F.col("video_id").cast("string"), F.lit("")), F.coalesce(segment.cast("long"), F.lit(0))
    cut = rows.withColumns({"of_video": whole, "segment": part}).withColumn("video_id", F.concat("of_video", F.lit("#"), F.col("segment").cast("string")))
    return cut.withColumn("frame_idx", F.row_number().over(by_frame()))


def levels_carried(levels: list[str], column: str = "risk_level") -> Column:
    """The highest level so far of a whole video, through its segments; levels from low to high."""
    rank = F.array_position(F.array(*map(F.lit, levels)), F.col(column))
    order = Window.partitionBy("of_video").orderBy("segment", "frame_idx").rowsBetween(Window.unboundedPreceding, 0)
    return F.element_at(F.array(*map(F.lit, levels)), F.max(rank).over(order).cast("int"))
