"""Heatmaps of segments: lines and arcs between two points."""

from __future__ import annotations

import enum

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import grid, ip, lines
from quadrille.functions.geometry import THIRD
from quadrille.functions.grid import Cartesian, Mercator
from quadrille.operators.tiling import BIN, TILE, value_column


class Shape(enum.Enum):
    FULL_LINE = "fullline"
    LEADER_LINE = "leaderline"
    FULL_ARC = "fullarc"
    LEADER_ARC = "leaderarc"

    @classmethod
    def of(cls, name: str | Shape) -> Shape:
        return name if isinstance(name, cls) else cls(name.lower().replace("_", "").replace("-", ""))


def points(df: DataFrame, columns: tuple[str, str, str, str], projection, levels: list[int], bins: int = 256, shape: str | Shape = Shape.FULL_LINE, low: float | None = None, high: float | None = None, leader: float = lines.LEADER, angle: float = THIRD) -> DataFrame:
    """Each row once for each bin of its segment at each level, in columns z, ux and uy; low and high: lengths in bins of those to keep."""
    shape = Shape.of(shape)
    mercator = isinstance(projection, Mercator)
    found = lines.ends(grid.at_levels(df, levels), projection, columns, bins, mercator).where(lines.length_between(low, high))
    if shape in (Shape.FULL_ARC, Shape.LEADER_ARC):
        return lines.arc_points(found, angle, leader if shape is Shape.LEADER_ARC else None)
    found = lines.bresenham(found)
    return found.where(lines.near_ends(leader)) if shape is Shape.LEADER_LINE else found


def tiled(found: DataFrame, bins: int, tms: bool = True, clip: bool = False) -> DataFrame:
    """Adds tiles and bins; clip: what lies beyond the edge of its level goes."""
    out = found.withColumns(grid.tiled(F.col("z"), F.col("ux"), F.col("uy"), bins, tms))
    n = grid.side(F.col("z"))
    return out.where((F.col("tx") >= 0) & (F.col("tx") < n) & (F.col("ty") >= 0) & (F.col("ty") < n)) if clip else out


def segment_heatmap(df: DataFrame, columns: tuple[str, str, str, str], levels: list[int], projection=Cartesian(), bins: int = 256, value: str | None = None, shape: str | Shape = Shape.FULL_LINE, low: float | None = None, high: float | None = None, leader: float = lines.LEADER, tms: bool = True, clip: bool = False) -> DataFrame:
    """(z, tx, ty, bin_x, bin_y, value): the sum, or the number, of the segments that cross each bin.

    Segments with a null end go; on the Mercator map, those with an end outside the bounds too.
    """
    _, v = value_column(df, value)
    found = points(df.select(v.alias("_v"), *[F.col(c).alias(f"_c{i}") for i, c in enumerate(columns)]), ("_c0", "_c1", "_c2", "_c3"), projection, levels, bins, shape, low, high, leader)
    # Added up by universal bin: fewer keys to shuffle than tiles and bins.
    sums = found.groupBy("z", "ux", "uy").agg(F.coalesce(F.sum("_v"), F.lit(0.0)).alias("value"))
    return tiled(sums, bins, tms, clip).select(*BIN, "value")


def ip_segments(df: DataFrame, start: str, end: str, levels: list[int], bins: int = 256, value: str | None = None, shape: str | Shape = Shape.FULL_LINE, low: float | None = None, high: float | None = None, tms: bool = True) -> DataFrame:
    """A heatmap of segments between addresses along a Z-order curve; rows without two addresses go."""
    made = ip.with_points(df, _a=start, _b=end)
    made = made.withColumns({"_x1": F.col("_a.x"), "_y1": F.col("_a.y"), "_x2": F.col("_b.x"), "_y2": F.col("_b.y")})
    return segment_heatmap(made, ("_x1", "_y1", "_x2", "_y2"), levels, Cartesian(), bins, value, shape, low, high, tms=tms)


def segment_tiles(df: DataFrame, columns: tuple[str, str, str, str], levels: list[int], projection=Cartesian(), bins: int = 256, keep: list[str] | None = None, leader: float = lines.LEADER, tms: bool = True) -> DataFrame:
    """Stage one of two: the tiles that each segment touches near its ends, with its ends in universal bins. Equal segments stay as many as they are."""
    found = points(df.withColumn("_row", F.monotonically_increasing_id()), columns, projection, levels, bins, Shape.LEADER_LINE, leader=leader)
    return tiled(found, bins, tms).select("_row", *(keep or []), *TILE, "ux1", "uy1", "ux2", "uy2").distinct().drop("_row")


def within_tiles(stage: DataFrame, bins: int = 256, leader: float = lines.LEADER, value: Column | None = None, tms: bool = True) -> DataFrame:
    """Stage two: the bins of each segment inside each tile, with a value that may depend on k, n and the ends."""
    spread = lines.bresenham(stage.withColumnsRenamed({c: f"_{c}" for c in ("tx", "ty")})).where(lines.near_ends(leader))
    found = tiled(spread, bins, tms).where((F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty"))).drop("_tx", "_ty")
    return found.withColumn("value", F.lit(1.0) if value is None else value)


def fading_segments(df: DataFrame, columns: tuple[str, str, str, str], levels: list[int], projection=Cartesian(), bins: int = 256, leader: int = lines.LEADER, keep: list[str] | None = None, tms: bool = True) -> DataFrame:
    """Leader lines whose values fade towards the middle: (keep..., z, tx, ty, bin_x, bin_y, share)."""
    found = points(df.withColumn("_row", F.monotonically_increasing_id()), columns, projection, levels, bins, Shape.LEADER_LINE, leader=leader)
    # The numbers of the bins that are left follow from those of the gap, which is one run in the middle.
    ends_ = ["_row", *(keep or []), "z", "ux1", "uy1", "ux2", "uy2"]
    listed = found.groupBy(*ends_).agg(F.sort_array(F.collect_set(F.struct("k", "ux", "uy"))).alias("p"))
    count = F.size("p").cast("long")
    middle = F.call_function("div", count, F.lit(2).cast("long")).cast("int")
    gap = F.coalesce(F.when(count > 1, F.get(F.col("p.k"), middle) - F.get(F.col("p.k"), middle - 1) > 1), F.lit(False))
    out = listed.withColumns({"c": count, "g": gap}).select(*ends_, "c", "g", F.posexplode("p").alias("i", "q"))
    out = out.select(*(keep or []), "z", F.col("q.ux").alias("ux"), F.col("q.uy").alias("uy"), lines.fading(F.col("i").cast("long"), F.col("c"), leader, F.col("g")).alias("share"))
    return tiled(out, bins, tms).select(*(keep or []), *BIN, "share")
