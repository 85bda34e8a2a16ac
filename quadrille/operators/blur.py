"""Gaussian blur of bins, across the edges of tiles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import grid
from quadrille.operators.tiling import BIN


def kernel(radius: int, sigma: float) -> list[tuple[int, int, float]]:
    """Offsets and weights, which add up to 1."""
    cells = [(u, v, math.exp(-(u * u + v * v) / (2 * sigma * sigma))) for v in range(-radius, radius + 1) for u in range(-radius, radius + 1)]
    total = sum(w for *_, w in cells)
    return [(u, v, w / total) for u, v, w in cells]


def spread(cells: DataFrame, shares: Column, bins: int, tms: bool = True) -> DataFrame:
    """Each bin's value passed on, within its bucket of time if it has one; what meets in a bin is added up.

    shares: an array of structs (dx, dy, value), how far from the bin, to the right and down, which value goes; made of any of the bin's columns. Null and
    empty arrays pass nothing on. Bins beyond the edge of the level come out in tiles beyond it.
    """
    keys = ["bin_t"] if "bin_t" in cells.columns else []
    ux, uy = grid.universal(F.col("z"), F.col("tx"), F.col("ty"), F.col("bin_x"), F.col("bin_y"), bins, tms)
    passed = cells.select("z", *keys, ux.alias("x"), uy.alias("y"), F.explode(shares).alias("k"))
    sums = passed.groupBy("z", *keys, (F.col("x") + F.col("k.dx")).alias("x"), (F.col("y") + F.col("k.dy")).alias("y")).agg(F.sum("k.value").alias("value"))
    return sums.withColumns(grid.tiled(F.col("z"), F.col("x"), F.col("y"), bins, tms)).select(*BIN, *keys, "value")


def blur(cells: DataFrame, radius: int, sigma: float, bins: int, tms: bool = True) -> DataFrame:
    """Spreads each bin's value over its neighbours, within its bucket of time if it has one; a null value counts 1.

    Bins beyond the edge of the level come out in tiles beyond it.
    """
    value = F.coalesce("value", F.lit(1.0))
    return spread(cells, F.array(*[F.struct(F.lit(u).alias("dx"), F.lit(v).alias("dy"), (value * w).alias("value")) for u, v, w in kernel(radius, sigma)]), bins, tms)
