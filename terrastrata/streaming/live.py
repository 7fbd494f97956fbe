"""Operators that run unchanged on streams, and density bins over event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators.joins import point_in_parts


def binned(points: DataFrame, cell_deg: float, window: str, late: str | None = None) -> DataFrame:
    """Counts of (ts, x, y) by window and cell; with late (a stream's watermark) windows close and late rows are dropped."""
    if late:
        points = points.withWatermark("ts", late)
    cell = lambda c: F.floor(F.col(c) / cell_deg)
    out = points.groupBy(F.window("ts", window).alias("w"), cell("x").alias("gx"), cell("y").alias("gy")).agg(F.count(F.lit(1)).alias("n"))
    return out.select(F.col("w.start").alias("start"), "gx", "gy", "n")


def located(points: DataFrame, shapes: DataFrame) -> DataFrame:
    """A stream's points joined to the polygons of a static layer that hold them."""
    return point_in_parts(points, shapes, F.col("x"), F.col("y"))
