"""Heatmaps over streams: the same bins, kept up to date by event time."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.functions import grid
from quadrille.operators.tiling import BIN


def windowed_heatmap(stream: DataFrame, x: str, y: str, time: str, projection, levels: list[int], bins: int, width: str, late: str, value: str | None = None, slide: str | None = None, tms: bool = True) -> DataFrame:
    """(start, end, z, tx, ty, bin_x, bin_y, value) for each window of event time; what comes later than the watermark allows is dropped."""
    at = stream.withColumn("_at", F.col(time).cast("timestamp")).withWatermark("_at", late)
    _v = F.lit(1.0) if value is None else grid.number(value)
    rows = grid.point(at.withColumn("_v", _v), projection, x, y, levels, bins, tms)
    window = F.window("_at", width, slide) if slide else F.window("_at", width)
    return rows.groupBy(window.alias("w"), *BIN).agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value")).select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), *BIN, "value")
