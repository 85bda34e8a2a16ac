"""Segments as bins: Bresenham's line in closed form, arcs in numpy.

Every bin of a line follows from its number alone, so a line is an exploded sequence.
An arc depends on its own last step; all arcs of an Arrow batch take each step together.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions.geometry import THIRD, distance_squared
from quadrille.functions.grid import number, side

#: Bins from an end that leader segments show.
LEADER = 1024


def ends(df: DataFrame, projection, columns: tuple[str, str, str, str], bins: int, point_bins: bool = False) -> DataFrame:
    """Adds the universal bins ux1, uy1, ux2 and uy2 of a segment's ends at the row's level z.

    point_bins: as the ends would be binned as points, and only with both ends inside the bounds. Otherwise nothing is
    outside, and an end on the boundary of two rows of bins is in the lower one. Null ends go.
    """
    x1, y1, x2, y2 = map(number, columns)
    some = x1.isNotNull() & y1.isNotNull() & x2.isNotNull() & y2.isNotNull()
    if point_bins:
        some &= projection.inside(x1, y1) & projection.inside(x2, y2)
    made = {}
    for k, (x, y) in enumerate(((x1, y1), (x2, y2)), 1):
        u, v = projection.unit(x, y)
        n = side(F.col("z"))
        if point_bins:
            fx, fy = u * n, v * n
            tx, ty = F.floor(fx), F.floor(fy)
            made[f"ux{k}"] = (tx * bins + F.floor((fx - tx) * bins)).cast("long")
            made[f"uy{k}"] = ((n - 1 - ty) * bins + bins - 1 - F.floor((fy - ty) * bins)).cast("long")
        else:
            made[f"ux{k}"] = (u * n * bins).cast("long")
            made[f"uy{k}"] = (n * bins - v * n * bins).cast("long")
    return df.where(some).withColumns(made)


def length_between(low: float | None, high: float | None) -> Column:
    """Whether the segment is neither shorter nor longer than that, in bins of its level."""
    squared = distance_squared(F.col("ux1"), F.col("uy1"), F.col("ux2"), F.col("uy2"))
    keep = F.lit(True)
    if low is not None:
        keep &= squared >= float(low) ** 2
    if high is not None:
        keep &= squared <= float(high) ** 2
    return keep


def bresenham(df: DataFrame) -> DataFrame:
    """Each row once for each bin of its line, in columns ux and uy, with k, its number from the start, and n, their number less one."""
    dx, dy = F.col("ux2") - F.col("ux1"), F.col("uy2") - F.col("uy1")
    steep = F.abs(dy) > F.abs(dx)
    long, short = F.when(steep, dy).otherwise(dx), F.when(steep, dx).otherwise(dy)
    made = df.withColumns({"_steep": steep, "_long": long, "_short": short})
    made = made.withColumn("n", F.abs(F.col("_long"))).withColumn("k", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n"))))
    half = F.shiftright("n", 1)
    off = F.when(F.col("n") == 0, 0).otherwise(F.call_function("div", F.when(F.col("_long") > 0, F.col("n") - 1 - half).otherwise(half) + F.col("k") * F.abs("_short"), F.when(F.col("n") == 0, 1).otherwise(F.col("n"))))
    along, across = F.col("k") * F.signum("_long").cast("long"), (off * F.signum("_short")).cast("long")
    ux = F.col("ux1") + F.when(F.col("_steep"), across).otherwise(along)
    uy = F.col("uy1") + F.when(F.col("_steep"), along).otherwise(across)
    return made.withColumns({"ux": ux, "uy": uy}).drop("_steep", "_long", "_short")


def near_ends(length: float = LEADER) -> Column:
    """Whether a bin is within that many bins of an end."""
    limit = float(length) ** 2
    return (distance_squared(F.col("ux"), F.col("uy"), F.col("ux1"), F.col("uy1")) <= limit) | (distance_squared(F.col("ux"), F.col("uy"), F.col("ux2"), F.col("uy2")) <= limit)


def _octant(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    out = np.where(x > -y, 7, 6)
    out = np.where((x <= 0) & (y < 0), np.where(-y > -x, 5, 4), out)
    out = np.where((x < 0) & (y >= 0), np.where(-x > y, 3, 2), out)
    out = np.where((x >= 0) & (y > 0), np.where(y > x, 1, 0), out)
    return np.where((x == 0) & (y == 0), 0, out)


def arcs(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, angle: float, backward: bool = False, within: float | None = None) -> list[np.ndarray]:
    """The bins of clockwise arcs, as rows of x and y from the start, or backward from the end; within: up to the first that is so far from where it began."""
    x1, y1, x2, y2 = (np.asarray(c, np.float64) for c in (x1, y1, x2, y2))
    rise = 2.0 * math.tan(angle / 2.0)
    cx, cy = (x1 + x2) / 2.0 + (y2 - y1) / rise, (y1 + y2) / 2.0 - (x2 - x1) / rise
    with np.errstate(divide="ignore", invalid="ignore"):
        first, last = _octant(x1 - cx, y1 - cy), _octant(x2 - cx, y2 - cy)
        slope1, slope2 = (y1 - cy) / (x1 - cx), (y2 - cy) / (x2 - cx)
        ahead = (first - last) % 8
        full = (ahead == 0) & ~(slope1 < slope2)
        ahead = np.where(full, 8, ahead)
        most = (np.ceil(8 * np.hypot(x1 - cx, y1 - cy)) + 16).astype(np.int64)
        x, y = (x2.copy(), y2.copy()) if backward else (x1.copy(), y1.copy())
        from_x, from_y = x.copy(), y.copy()
        # Lower bound, value and upper bound of the squared distance across, kept while steps go the same way.
        bound, kept = np.zeros((3, len(x))), np.full(len(x), -1)
        # Of each step, which arcs take it and where they are then.
        taken: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []
        live = np.flatnonzero(np.isfinite(cx) & np.isfinite(cy))
        step = 0
        while len(live):
            if within is not None:
                live = live[np.hypot(x[live] - from_x[live], y[live] - from_y[live]) < within]
            taken.append((live, x[live], y[live]))
            step += 1
            live = live[step < most[live]]
            if not len(live):
                break
            oct_ = _octant(x[live] - cx[live], y[live] - cy[live])
            along_x = np.isin(oct_, (1, 2, 5, 6))
            # Clockwise: down on the right, left at the bottom, up on the left, right at the top.
            sign = np.where(np.isin(oct_, (1, 2, 3, 4)), 1.0, -1.0) * (-1.0 if backward else 1.0)
            for axis, rows in ((0, live[along_x]), (1, live[~along_x])):
                if not len(rows):
                    continue
                s = sign[along_x] if axis == 0 else sign[~along_x]
                main, cross, mc, cc = (x, y, cx, cy) if axis == 0 else (y, x, cy, cx)
                fresh = rows[kept[rows] != axis]
                c = cross[fresh] - cc[fresh]
                a, b = (c - 0.5) ** 2, (c + 0.5) ** 2
                bound[:, fresh] = np.minimum(a, b), c * c, np.maximum(a, b)
                low, mid, high = bound[:, rows]
                mid = mid - s * 2.0 * (main[rows] - mc[rows]) - 1.0
                main[rows] += s
                c = cross[rows] - cc[rows]
                out_ = np.where(c > 0, 1.0, -1.0)
                inward, outward = mid < low, ~(mid < low) & (mid >= high)
                c_in, c_out = c - out_, c + out_
                new_low = np.where(inward, (c_in - 0.5 * out_) ** 2, np.where(outward, high, low))
                new_high = np.where(inward, low, np.where(outward, (c_out + 0.5 * out_) ** 2, high))
                cross[rows] += np.where(inward, -out_, np.where(outward, out_, 0.0))
                if axis == 1:
                    new_low, new_high = np.minimum(new_low, new_high), np.maximum(new_low, new_high)
                bound[:, rows] = new_low, mid, new_high
                kept[rows] = axis
            oct_ = _octant(x[live] - cx[live], y[live] - cy[live])
            slope = (y[live] - cy[live]) / (x[live] - cx[live])
            f, l_, s1, s2 = first[live], last[live], slope1[live], slope2[live]
            on_way = (f - oct_) % 8 <= ahead[live]
            ok = np.where(f == l_, (oct_ == f) & (s2 <= slope) & (slope <= s1), np.where(oct_ == f, slope <= s1, np.where(oct_ == l_, s2 <= slope, on_way)))
            live = live[ok]
    which, *at = (np.concatenate(c) if taken else np.zeros(0, np.int64) for c in (list(zip(*taken)) or [()] * 3))
    points = np.stack(at, axis=1).astype(np.int64)[np.argsort(which, kind="stable")]
    return np.split(points, np.cumsum(np.bincount(which, minlength=len(x1)))[:-1]) if len(x1) else []


def leader_arcs(x1: np.ndarray, y1: np.ndarray, x2: np.ndarray, y2: np.ndarray, angle: float, leader: float) -> list[np.ndarray]:
    """The bins of arcs that are closer than that to an end; all of them where both leaders meet."""
    chord = np.hypot(np.asarray(x2, np.float64) - x1, np.asarray(y2, np.float64) - y1)
    radius = chord / 2.0 / math.sin(angle / 2.0)
    with np.errstate(divide="ignore", invalid="ignore"):
        whole = ~(angle > 2.0 * 2.0 * np.arcsin(leader / (2.0 * radius)))
    out: list[np.ndarray] = [np.zeros((0, 2), np.int64)] * len(chord)
    for rows, make in ((np.flatnonzero(whole), lambda *p: arcs(*p, angle)), (np.flatnonzero(~whole), lambda *p: [np.concatenate(q) for q in zip(arcs(*p, angle, within=leader), arcs(*p, angle, backward=True, within=leader))])):
        if len(rows):
            for i, p in zip(rows, make(*(np.asarray(c)[rows] for c in (x1, y1, x2, y2)))):
                out[i] = p
    return out


def arc_points(df: DataFrame, angle: float = THIRD, leader: float | None = None) -> DataFrame:
    """Each row once for each bin of its clockwise arc, in columns ux and uy."""

    @F.arrow_udf("array<struct<ux: long, uy: long>>")
    def walked(x1: pa.Array, y1: pa.Array, x2: pa.Array, y2: pa.Array) -> pa.Array:
        points = [c.to_numpy(zero_copy_only=False) for c in (x1, y1, x2, y2)]
        made = arcs(*points, angle) if leader is None else leader_arcs(*points, angle, leader)
        flat = np.concatenate(made) if made else np.zeros((0, 2), np.int64)
        ends_ = np.cumsum([0, *map(len, made)])
        return pa.ListArray.from_arrays(pa.array(ends_, pa.int32()), pa.StructArray.from_arrays([pa.array(flat[:, 0]), pa.array(flat[:, 1])], ["ux", "uy"]))

    out = df.withColumn("_p", F.explode(walked("ux1", "uy1", "ux2", "uy2")))
    return out.withColumns({"ux": F.col("_p.ux"), "uy": F.col("_p.uy")}).drop("_p")


def fading(k: Column, count: Column, leader: int, gap: Column) -> Column:
    """The share of its value that point k of count keeps: less towards the middle, where two leaders with a gap between them end."""
    half = F.call_function("div", count, F.lit(2).cast("long"))
    share = F.when(k < half, (half - k) / half).otherwise((k - half + 1) / half)
    return F.when((count < 2 * leader) | ~gap, F.lit(1.0)).otherwise(share)
