"""From rows to bins to tiles.

A bin is a row (z, tx, ty, bin_x, bin_y[, bin_t], ...): populated bins only. Everything is one
aggregation by bin, which Spark does partly before its only shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import grid
from quadrille.functions.grid import TimeRange

TILE = ["z", "tx", "ty"]
BIN = [*TILE, "bin_x", "bin_y"]


def bounds(df: DataFrame, *columns: str) -> DataFrame:
    """One row with the least and the largest value of each column, as doubles: min_c and max_c."""
    return df.agg(*[f(grid.number(c)).alias(f"{n}_{c}") for c in columns for n, f in (("min", F.min), ("max", F.max))])


def binned(df: DataFrame, projection, x: str, y: str, levels: list[int], bins: int, aggregates: list[Column], keys: list[str] | None = None, tms: bool = True) -> DataFrame:
    """The general operator: rows projected to bins at each level, and any aggregates by bin and further keys.

    A projection of one's own, with a method places(), may send a row to any number of bins; x and y are then not read.
    """
    if hasattr(projection, "places"):
        return grid.project(df, projection, levels, bins, tms).groupBy(*BIN, *(keys or [])).agg(*aggregates)
    return grid.point(df, projection, x, y, levels, bins, tms).groupBy(*BIN, *(keys or [])).agg(*aggregates)


def tiles(cells: DataFrame, aggregates: list[Column]) -> DataFrame:
    """Any aggregates of bins by tile."""
    return cells.groupBy(*TILE).agg(*aggregates)


def value_column(df: DataFrame, value: str | None) -> tuple[DataFrame, Column]:
    """The value as a double; without a column every row counts 1."""
    return df, (F.lit(1.0) if value is None else grid.number(value))


def rolls_up(levels: list[int], bins: int) -> bool:
    """Whether each level's bins are unions of the deepest level's, to the bit."""
    return len(levels) > 1 and bins & (bins - 1) == 0


def rolled_up(cells: DataFrame, levels: list[int], bins: int, aggregates: list[Column], keys: list[str] | None = None, tms: bool = True) -> DataFrame:
    """Bins of the deepest level aggregated again to all levels: the scan and the large aggregation are for one level only."""
    keys = keys or []
    deepest = max(levels)
    ux, uy = grid.universal(F.col("z"), F.col("tx"), F.col("ty"), F.col("bin_x"), F.col("bin_y"), bins, tms)
    flat = cells.withColumns({"_x": ux, "_y": uy}).drop(*BIN)
    up = grid.at_levels(flat, levels)
    step = F.expr(f"CAST(shiftleft(1L, {deepest} - z) AS BIGINT)")
    up = up.withColumns({"_x": F.call_function("div", F.col("_x"), step), "_y": F.call_function("div", F.col("_y"), step)})
    return up.groupBy("z", "_x", "_y", *keys).agg(*aggregates).withColumns(grid.tiled(F.col("z"), F.col("_x"), F.col("_y"), bins, tms)).drop("_x", "_y")


def heatmap(df: DataFrame, x: str, y: str, projection, levels: list[int], bins: int = 256, value: str | None = None, tms: bool = True, rollup: bool | None = None) -> DataFrame:
    """(z, tx, ty, bin_x, bin_y, value): the sum of a column, or the number of rows, in each bin.

    Rows without a coordinate or outside the bounds go; null values count nothing, and a bin of nothing but these is 0.
    """
    rollup = rolls_up(levels, bins) if rollup is None else rollup
    _, v = value_column(df, value)
    total = F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value")
    cells = binned(df.withColumn("_v", v), projection, x, y, [max(levels)] if rollup else levels, bins, [total], tms=tms)
    if rollup:
        cells = rolled_up(cells, levels, bins, [F.sum("value").alias("value")], tms=tms)
    return cells.select(*BIN, "value")


def time_heatmap(df: DataFrame, x: str, y: str, time: str, projection, times: TimeRange, levels: list[int], bins: int = 256, value: str | None = None, tms: bool = True, rollup: bool | None = None) -> DataFrame:
    """(z, tx, ty, bin_x, bin_y, bin_t, value): a heatmap for each bucket of time; rows outside the range go."""
    rollup = rolls_up(levels, bins) if rollup is None else rollup
    _, v = value_column(df, value)
    ms = grid.millis(df, time)
    rows = df.where(times.inside(ms)).withColumns({"_v": v, "bin_t": times.bucket(ms)})
    cells = binned(rows, projection, x, y, [max(levels)] if rollup else levels, bins, [F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value")], ["bin_t"], tms)
    if rollup:
        cells = rolled_up(cells, levels, bins, [F.sum("value").alias("value")], ["bin_t"], tms)
    return cells.select(*BIN, "bin_t", "value")


def tile_range(cells: DataFrame, bins: int | None = None, include_empty: bool = False, value: str = "value") -> DataFrame:
    """(z, tx, ty, min, max, n_bins) of a tile's bins; include_empty: where some are not populated, these count as 0."""
    out = tiles(cells, [F.min(value).alias("min"), F.max(value).alias("max"), F.count("*").alias("n_bins")])
    if include_empty and bins is not None:
        some = F.col("n_bins") < bins * bins
        out = out.withColumns({"min": F.when(some, F.least("min", F.lit(0.0))).otherwise(F.col("min")), "max": F.when(some, F.greatest("max", F.lit(0.0))).otherwise(F.col("max"))})
    return out


def level_range(cells: DataFrame, value: str = "value") -> DataFrame:
    """(z, min, max) over all bins of a level."""
    return cells.groupBy("z").agg(F.min(value).alias("min"), F.max(value).alias("max"))


def ip_heatmap(df: DataFrame, address: str, levels: list[int], bins: int = 256, value: str | None = None, tms: bool = True) -> DataFrame:
    """A heatmap of addresses along a Z-order curve; what is no address goes."""
    from quadrille.functions import ip

    placed = ip.with_points(df, _ip=address).withColumns({"_ip_x": F.col("_ip.x"), "_ip_y": F.col("_ip.y")})
    return heatmap(placed, "_ip_x", "_ip_y", grid.Cartesian(), levels, bins, value, tms)
