"""Tiles and bins as column expressions.

A level z has 2**z by 2**z tiles, each of bins by bins bins. Tile rows count from
the south (tms) or from the north; bin rows always count from the top of their tile. Universal
bins number the bins of a whole level from its upper left corner.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from typing import Protocol

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Latitude at which the square Mercator map ends.
MERCATOR_LATITUDE = 85.05112878


def number(column: str | Column) -> Column:
    """As a double; what is no number becomes null instead of an error."""
    return (F.col(column) if isinstance(column, str) else column).try_cast("double")


def side(z: Column) -> Column:
    """Tiles on a side of level z, as a double."""
    return F.pow(F.lit(2.0), z)


def at_levels(df: DataFrame, levels: list[int]) -> DataFrame:
    """Each row once for each level, in a column z."""
    return df.withColumn("z", F.explode(F.array(*[F.lit(int(z)) for z in levels])))


@dataclass(frozen=True)
class Cartesian:
    """Scales (min x, min y, max x, max y) to the unit square; lower bounds are inside, upper ones outside."""

    bounds: tuple[float, float, float, float] = (0.0, 0.0, 1.0, 1.0)

    def inside(self, x: Column, y: Column) -> Column:
        a, b, c, d = map(float, self.bounds)
        return (x >= a) & (x < c) & (y >= b) & (y < d)

    def unit(self, x: Column, y: Column) -> tuple[Column, Column]:
        a, b, c, d = map(float, self.bounds)
        return (x - a) / (c - a), (y - b) / (d - b)


@dataclass(frozen=True)
class Mercator:
    """Longitude and latitude to the Web Mercator square; bounds filter, all of them outside, and do not rescale."""

    bounds: tuple[float, float, float, float] = (-180.0, -MERCATOR_LATITUDE, 180.0, MERCATOR_LATITUDE)

    def inside(self, x: Column, y: Column) -> Column:
        a, b, c, d = map(float, self.bounds)
        return (x > a) & (x < c) & (y > b) & (y < d)

    def unit(self, x: Column, y: Column) -> tuple[Column, Column]:
        phi = F.radians(y)
        return (x + 180.0) / 360.0, (1.0 + F.log(F.tan(phi) + 1.0 / F.cos(phi)) / math.pi) / 2.0


def point(df: DataFrame, projection, x: str, y: str, levels: list[int], bins: int, tms: bool = True) -> DataFrame:
    """Adds z, tx, ty, bin_x and bin_y, one row a level; rows outside the bounds or with a null coordinate go."""
    px, py = number(x), number(y)
    u, v = projection.unit(px, py)
    kept = df.where(px.isNotNull() & py.isNotNull() & projection.inside(px, py)).withColumns({"__u": u, "__v": v})
    fx, fy = F.col("__u") * side(F.col("z")), F.col("__v") * side(F.col("z"))
    tiled = at_levels(kept, levels).withColumns({"__u": fx, "__v": fy, "tx": F.floor(fx).cast("int"), "ty": F.floor(fy).cast("int")})
    binned = tiled.withColumns({"bin_x": F.floor((F.col("__u") - F.col("tx")) * bins).cast("int"), "bin_y": (bins - 1 - F.floor((F.col("__v") - F.col("ty")) * bins)).cast("int")}).drop("__u", "__v")
    return binned if tms else binned.withColumn("ty", flipped(F.col("z"), F.col("ty")))


class Projection(Protocol):
    """What a projection of one's own has: to how many places a row goes, and to which, is up to it.

    places: an array of structs (tx, ty, bin_x, bin_y), with tile rows from the south, and any further fields, made of the row's columns and its level; null or
    empty where the row is outside.
    """

    def places(self, z: Column, bins: int) -> Column: ...


def project(df: DataFrame, projection: Projection, levels: list[int], bins: int, tms: bool = True) -> DataFrame:
    """Adds z and the fields of the projection's places, a row for each of them at each level."""
    made = at_levels(df, levels).withColumn("_place", F.explode(projection.places(F.col("z"), bins)))
    fields = made.schema["_place"].dataType.names
    out = made.withColumns({f: F.col("_place")[f] for f in fields}).drop("_place")
    return out if tms else out.withColumn("ty", flipped(F.col("z"), F.col("ty")))


def flipped(z: Column, ty: Column) -> Column:
    """The tile row counted from the other side."""
    return (side(z) - 1 - ty).cast("int")


def universal(z: Column, tx: Column, ty: Column, bin_x: Column, bin_y: Column, bins: int, tms: bool = True) -> tuple[Column, Column]:
    """The universal bin of a bin of a tile."""
    row = (side(z) - 1 - ty).cast("long") if tms else ty.cast("long")
    return tx.cast("long") * bins + bin_x, row * bins + bin_y


def tiled(z: Column, ux: Column, uy: Column, bins: int, tms: bool = True) -> dict[str, Column]:
    """tx, ty, bin_x and bin_y of a universal bin; bins beyond the level's edge fall into tiles beyond it."""
    row = F.floor(uy / bins)
    return {
        "tx": F.floor(ux / bins).cast("int"),
        "ty": ((side(z) - 1 - row) if tms else row).cast("int"),
        "bin_x": F.pmod(ux, F.lit(bins)).cast("int"),
        "bin_y": F.pmod(uy, F.lit(bins)).cast("int"),
    }


def linear(bin_x: Column, bin_y: Column, bins: int, bin_t: Column | None = None) -> Column:
    """The place of a bin in its tile's array: rows of x, then y, then time."""
    flat = bin_x + bin_y * bins
    return flat if bin_t is None else flat + bin_t * (bins * bins)


def from_linear(index: Column, bins: int) -> dict[str, Column]:
    """bin_x, bin_y and bin_t of a place."""
    return {"bin_x": F.pmod(index, F.lit(bins)).cast("int"), "bin_y": F.pmod(F.floor(index / bins), F.lit(bins)).cast("int"), "bin_t": F.floor(index / (bins * bins)).cast("int")}


@dataclass(frozen=True)
class TimeRange:
    """Buckets of equal width in epoch milliseconds; what would be in a bucket beyond the last is outside."""

    start: int
    end: int
    count: int

    @classmethod
    def of_step(cls, start: int, step: int, count: int) -> TimeRange:
        return cls(start, start + step * count, count)

    @property
    def step(self) -> int:
        return (self.end - self.start) // self.count

    def bucket(self, ms: Column) -> Column:
        return F.floor((ms - F.lit(self.start)) / F.lit(self.step)).cast("int") if self.step < 1 else F.call_function("div", ms - F.lit(self.start).cast("long"), F.lit(self.step).cast("long")).cast("int")

    def inside(self, ms: Column) -> Column:
        return (ms >= self.start) & (ms <= self.end) & (self.bucket(ms) < self.count)


def millis(df: DataFrame, column: str) -> Column:
    """Epoch milliseconds of a timestamp, date or number column."""
    kind = dict(df.dtypes)[column]
    if kind.startswith("timestamp") or kind == "date":
        return F.unix_millis(F.col(column).cast("timestamp"))
    return F.col(column).try_cast("long")


def row_id(z: Column, tx: Column, ty: Column, prefix: str = "", separator: str = "/", suffix: str = "") -> Column:
    """A tile's name: level, column and row, padded with zeros to the width of the level's largest."""
    width = F.length(F.floor(side(z)).cast("long").cast("string"))
    pad = lambda c: F.lpad(c.cast("string"), width, "0")
    return F.concat(F.lit(prefix), F.lpad(z.cast("string"), 2, "0"), F.lit(separator), pad(tx), F.lit(separator), pad(ty), F.lit(suffix))
