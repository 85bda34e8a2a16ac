import itertools
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrille.functions import lines
from quadrille.functions.geometry import THIRD
from quadrille.functions.grid import Cartesian, Mercator
from quadrille.operators import segments
from quadrille.operators.tiling import BIN


def stepped(x1, y1, x2, y2):
    """The line by steps with a running error, the textbook way."""
    steep = abs(y2 - y1) > abs(x2 - x1)
    a1, b1, a2, b2 = (y1, x1, y2, x2) if steep else (x1, y1, x2, y2)
    da, db = a2 - a1, b2 - b1
    n = abs(da)
    error = (n - 1 - (n >> 1)) if da > 0 else n >> 1
    b, out = b1, []
    for k in range(n + 1):
        a = a1 + k * (1 if da > 0 else -1)
        out.append((b, a) if steep else (a, b))
        error += abs(db)
        if n and error >= n:
            error -= n
            b += 1 if db > 0 else -1
    return out


def walked(spark, ends):
    df = spark.createDataFrame([(i, *e) for i, e in enumerate(ends)], "i int, ux1 long, uy1 long, ux2 long, uy2 long")
    out = {}
    for r in lines.bresenham(df).orderBy("i", "k").collect():
        out.setdefault(r["i"], []).append((r["ux"], r["uy"]))
    return [out[i] for i in range(len(ends))]


def test_lines_are_bresenhams(spark):
    ends = [(a, b, c, d) for a, b in ((0, 0), (3, -2)) for c, d in itertools.product(range(-6, 7, 3), range(-5, 8, 2))]
    got = walked(spark, ends)
    assert got == [stepped(*e) for e in ends]
    assert [len(g) - 1 for g in got] == [max(abs(e[2] - e[0]), abs(e[3] - e[1])) for e in ends]


def test_reversed_lines_have_the_same_bins(spark):
    forth, back = walked(spark, [(4, 2, 20, 8), (20, 8, 4, 2)])
    assert len(forth) == 17 and forth == back[::-1]


def test_leaders_by_brute_force(spark):
    df = spark.createDataFrame([(1, 1, 30, 17), (1, 1, 6, 4)], "ux1 long, uy1 long, ux2 long, uy2 long")
    got = {(r["ux2"], r["ux"], r["uy"]) for r in lines.bresenham(df).where(lines.near_ends(5)).collect()}
    exp = {(e[2], x, y) for e in ((1, 1, 30, 17), (1, 1, 6, 4)) for x, y in stepped(*e) if math.hypot(x - e[0], y - e[1]) <= 5 or math.hypot(x - e[2], y - e[3]) <= 5}
    assert got == exp


def test_arc_of_sixteen_points():
    # An angle of 8 is more than a turn; the center is as if it were what is left.
    (points,) = lines.arcs(*np.array([[24.0], [40.0], [36.0], [31.0]]), 8.0)
    assert [tuple(p) for p in points.tolist()] == [(24, 40), (25, 40), (26, 40), (27, 40), (28, 40), (29, 40), (30, 39), (31, 39), (32, 38), (33, 37), (34, 36), (34, 35), (35, 34), (35, 33), (36, 32), (36, 31)]


def test_arcs_stay_on_their_circle():
    rng = np.random.default_rng(0)
    ends = rng.integers(0, 200, (4, 50)).astype(float)
    for a, points in enumerate(lines.arcs(*ends, THIRD)):
        x1, y1, x2, y2 = ends[:, a]
        if (x1, y1) == (x2, y2):
            continue
        r = math.hypot(x2 - x1, y2 - y1) / 2 / math.sin(THIRD / 2)
        rise = 2 * math.tan(THIRD / 2)
        cx, cy = (x1 + x2) / 2 + (y2 - y1) / rise, (y1 + y2) / 2 - (x2 - x1) / rise
        far = np.abs(np.hypot(points[:, 0] - cx, points[:, 1] - cy) - r)
        assert far.max() <= 1.0
        steps = np.abs(np.diff(points, axis=0)).max(axis=1)
        assert tuple(points[0]) == (x1, y1) and (steps == 1).all()


def test_leader_arcs_are_ends_of_arcs():
    ends = [np.array([v]) for v in (10.0, 10.0, 90.0, 30.0)]
    (whole,), (ends_,) = lines.arcs(*ends, THIRD), lines.leader_arcs(*ends, THIRD, 12)
    near = {tuple(p) for p in whole.tolist() if math.hypot(p[0] - 10, p[1] - 10) < 12}
    assert near <= {tuple(p) for p in ends_.tolist()} and len(ends_) < len(whole)
    (short,) = lines.leader_arcs(*ends, THIRD, 1000)
    assert short.tolist() == whole.tolist()


def test_lengths_and_shapes(spark):
    df = spark.createDataFrame([(0.05, 0.05, 0.95, 0.55, 2.0), (0.1, 0.1, 0.12, 0.1, 5.0), (None, 0.0, 0.0, 0.0, 1.0)], "a double, b double, c double, d double, v double")
    ends = ("a", "b", "c", "d")
    full = segments.segment_heatmap(df, ends, [1], Cartesian(), 16, "v", low=4, high=1024)
    assert {r["value"] for r in full.collect()} == {2.0}
    for shape in segments.Shape:
        assert segments.segment_heatmap(df, ends, [1], Cartesian(), 16, shape=shape, low=4, leader=5).count() > 0
    assert segments.segment_heatmap(df, ends, [0, 1], Cartesian(), 16).where("z = 0").count() > 0


def test_addresses_as_segments(spark):
    df = spark.createDataFrame([("24.42.0.0", "24.90.0.0", 1.0), ("24.42.0.0", "x", 1.0)], "a string, b string, v double")
    got = sorted(tuple(r)[1:5] for r in segments.ip_segments(df, "a", "b", [4], 4).collect())
    assert got == [(4, 2, 0, 2), (4, 2, 1, 2), (4, 2, 2, 3), (4, 2, 3, 3)]


def test_mercator_needs_both_ends_inside(spark):
    df = spark.createDataFrame([(-10.0, 10.0, 20.0, 30.0), (-10.0, 10.0, 20.0, 89.0)], "a double, b double, c double, d double")
    out = segments.segment_heatmap(df, ("a", "b", "c", "d"), [3], Mercator(), 16)
    assert {r["value"] for r in out.collect()} == {1.0}


def test_two_stages_are_one(spark):
    df = spark.createDataFrame([(0.05, 0.05, 0.95, 0.55)], "a double, b double, c double, d double")
    ends = ("a", "b", "c", "d")
    spread = segments.within_tiles(segments.segment_tiles(df, ends, [2], Cartesian(), 8, leader=9), 8, 9)
    whole = segments.segment_heatmap(df, ends, [2], Cartesian(), 8, shape="leaderline", leader=9)
    assert sorted(tuple(r) for r in spread.select(*BIN).collect()) == sorted(tuple(r) for r in whole.select(*BIN).collect())


@pytest.mark.parametrize("gap,expected", [(True, [1.0, 0.75, 0.5, 0.25, 0.25, 0.5, 0.75, 1.0]), (False, [1.0] * 8)])
def test_fading(spark, gap, expected):
    df = spark.range(8).select(lines.fading(F.col("id"), F.lit(8).cast("long"), 4, F.lit(gap)).alias("s"), "id").orderBy("id")
    assert [r["s"] for r in df.collect()] == expected


def test_equal_segments_stay_two(spark):
    df = spark.createDataFrame([(0.05, 0.05, 0.95, 0.55)] * 2, "a double, b double, c double, d double")
    ends = ("a", "b", "c", "d")
    once, twice = df.limit(1), df
    for f in (lambda x: segments.segment_tiles(x, ends, [2], Cartesian(), 8, leader=9), lambda x: segments.fading_segments(x, ends, [2], Cartesian(), 8, 9)):
        assert sorted(map(tuple, f(twice).collect())) == sorted([tuple(r) for r in f(once).collect()] * 2)
    # A number of the caller's own is kept.
    kept = segments.segment_tiles(twice.selectExpr("*", "7 AS mine"), ends, [2], Cartesian(), 8, ["mine"], 9)
    assert kept.columns[0] == "mine" and kept.count() == 2 * segments.segment_tiles(once, ends, [2], Cartesian(), 8, leader=9).count()
