"""Incremental accumulation over Structured Streaming: points that arrive add to cells' sums."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from celestrum.functions import cells


def cell_totals(points: DataFrame, resolution: int, event_time: str | None = None, window: str | None = None, delay: str = "10 minutes") -> DataFrame:
    """n_points and weight by cell of a (streaming) catalog with ux, uy, uz, weight; state is one row a cell.

    With event_time and window, totals are by window too, and rows later than `delay` behind the newest are dropped.
    """
    keyed = cells.with_cell(points, resolution)
    by = ["x", "y"]
    if event_time:
        keyed = keyed.withWatermark(event_time, delay)
        by = [F.window(event_time, window or "1 hour"), *by]
    return keyed.groupBy(*by).agg(F.count("*").alias("n_points"), F.sum("weight").alias("weight"))


def into_map(points: DataFrame, area: DataFrame, level: int) -> DataFrame:
    """Totals of the points that fall on a static map's cells of one level: a stream-static join."""
    inside = area.where(F.col("level") == level).select("x", "y")
    return cells.with_cell(points, 1 << level).join(inside, ["x", "y"]).groupBy("x", "y").agg(F.count("*").alias("n_points"), F.sum("weight").alias("intensity"))
