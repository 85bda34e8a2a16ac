import math
import struct

import pytest
from pyspark.sql import functions as F

from quadrille.functions import geometry, grid, ip
from quadrille.functions.grid import Cartesian, Mercator, TimeRange
from quadrille.operators import codec, tiling
from quadrille.operators import blur as blur_module
from quadrille.operators.blur import blur, kernel


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def one(spark, *columns):
    return tuple(spark.range(1).select(*columns).first())


def test_points_of_a_level(spark):
    df = spark.createDataFrame([(0.0, 0.0), (0.25, 0.7), (0.999, 0.999), (1.0, 0.5), (None, 0.5), (-0.1, 0.5)], "x double, y double")
    got = rows(grid.point(df, Cartesian(), "x", "y", [0, 1], 10), "z", "tx", "ty", "bin_x", "bin_y")
    assert got == [(0, 0, 0, 0, 9), (0, 0, 0, 2, 2), (0, 0, 0, 9, 0), (1, 0, 0, 0, 9), (1, 0, 1, 5, 6), (1, 1, 1, 9, 0)]
    north = rows(grid.point(df, Cartesian(), "x", "y", [1], 10, tms=False), "tx", "ty")
    assert north == [(0, 0), (0, 1), (1, 0)]


def test_mercator_bounds_are_outside(spark):
    df = spark.createDataFrame([(-99.0, 40.0), (10.0, 67.0), (0.0, 0.0), (179.0, 85.2)], "x double, y double")
    assert rows(grid.point(df, Mercator((-180.0, -67.0, 180.0, 67.0)), "x", "y", [1], 4), "tx", "ty") == [(0, 1), (1, 1)]


def test_no_numbers_are_dropped(spark):
    df = spark.createDataFrame([("0.5", "0.5"), ("a", "0.5"), ("", "0.1")], "x string, y string")
    assert grid.point(df, Cartesian(), "x", "y", [0], 4).count() == 1


@pytest.mark.parametrize("bins", [8, 16])
@pytest.mark.parametrize("tms", [True, False])
def test_rollup_is_exact(spark, bins, tms):
    df = spark.range(500).select((F.rand(1) * 3 - 1).alias("x"), (F.rand(2) * 3 - 1).alias("y"), F.pmod("id", F.lit(7)).alias("v"))
    box = Cartesian((-0.7, -0.3, 1.3, 1.9))
    for levels in ([0, 1, 2, 5], [2, 4]):
        a = tiling.heatmap(df, "x", "y", box, levels, bins, "v", tms, rollup=True)
        b = tiling.heatmap(df, "x", "y", box, levels, bins, "v", tms, rollup=False)
        assert rows(a, *a.columns) == rows(b, *a.columns)


def test_null_values_count_nothing_but_fill_bins(spark):
    df = spark.createDataFrame([(0.1, 0.1, None), (0.9, 0.9, 2.0), (0.9, 0.9, None)], "x double, y double, v double")
    assert rows(tiling.heatmap(df, "x", "y", Cartesian(), [0], 2, "v"), "bin_x", "bin_y", "value") == [(0, 1, 0.0), (1, 0, 2.0)]
    assert tiling.heatmap(df.limit(0), "x", "y", Cartesian(), [0, 1], 2).count() == 0


def test_clashing_names(spark):
    df = spark.createDataFrame([(0.1, 0.2, 9, "q", 3.0)], "x double, y double, z int, tx string, value double")
    assert rows(tiling.heatmap(df, "x", "y", Cartesian(), [0], 2, "value"), "z", "tx", "value") == [(0, 0, 3.0)]


def test_time_buckets(spark):
    times = TimeRange(10, 210, 10)
    assert times.step == 20
    df = spark.createDataFrame([(t,) for t in (9, 10, 53, 209, 210, 211)], "t long")
    got = df.where(times.inside(F.col("t"))).select("t", times.bucket(F.col("t")).alias("b"))
    assert rows(got, "t", "b") == [(10, 0), (53, 2), (209, 9)]
    assert TimeRange.of_step(10, 20, 10) == times
    assert rows(grid.point(spark.createDataFrame([(0.0, 0.0)], "x double, y double"), Cartesian((0.0, 0.0, 1.0, 1.0)), "x", "y", [0], 101), "bin_x", "bin_y") == [(0, 100)]


def test_linear_places(spark):
    # Bins of 31 by 31, so that (4, 8, 12) is 12 * 961 + 8 * 31 + 4.
    place = grid.linear(F.lit(4), F.lit(8), 31, F.lit(12))
    back = grid.from_linear(place, 31)
    assert one(spark, place, back["bin_x"], back["bin_y"], back["bin_t"]) == (12 * 961 + 8 * 31 + 4, 4, 8, 12)


def test_row_ids(spark):
    name = lambda z, x, y, s: one(spark, grid.row_id(F.lit(z), F.lit(x), F.lit(y), "", s, ""))[0]
    assert name(4, 7, 3, ",") == "04,07,03"
    assert name(3, 1, 3, ":") == "03:1:3"
    assert name(10, 45, 110, "--") == "10--0045--0110"


@pytest.mark.parametrize("tms", [True, False])
def test_universal_bins_round_trip(spark, tms):
    df = spark.range(256).select(F.lit(2).alias("z"), F.pmod(F.floor(F.col("id") / 64), F.lit(4)).cast("int").alias("tx"), F.pmod(F.floor(F.col("id") / 16), F.lit(4)).cast("int").alias("ty"), F.pmod(F.floor(F.col("id") / 4), F.lit(4)).cast("int").alias("bin_x"), F.pmod("id", F.lit(4)).cast("int").alias("bin_y"))
    ux, uy = grid.universal(F.col("z"), F.col("tx"), F.col("ty"), F.col("bin_x"), F.col("bin_y"), 4, tms)
    again = df.select("z", ux.alias("ux"), uy.alias("uy")).withColumns(grid.tiled(F.col("z"), F.col("ux"), F.col("uy"), 4, tms))
    assert again.select("ux", "uy").distinct().count() == 256
    assert rows(again, *df.columns) == rows(df, *df.columns)


V6 = {
    "::": [0] * 6,
    "0::": [0] * 6,
    "a0f::": [0xA0F, 0, 0, 0, 0, 0],
    "ffff:ffff:ffff::": [0xFFFF, 0xFFFF, 0xFFFF, 0, 0, 0],
    "abcd:::12:12aa:ffff": [0xABCD, 0, 0, 0x12, 0x12AA, 0xFFFF],
    "FFFF:ffff:FFFF:ffff:FFFF:ffff": [0xFFFF] * 6,
    "FFFF:ffff:FFFF:ffff:FFFF:ffff:ffff": None,
    "a0g::": None,
    "ffff:ffff": None,
    None: None,
}
V4 = {"172.168.0.1": [172, 168, 0, 1], "172.168.0.a": None, "172.168.0.1.0": None, "172.168.0": None, "bad man": None, "256.1.1.1": None, "": None, None: None}


def test_addresses(spark):
    for cases, f in ((V6, ip.v6), (V4, ip.v4)):
        df = spark.createDataFrame([(a,) for a in cases], "a string")
        assert {r[0]: r[1] for r in df.select("a", f(F.col("a"))).collect()} == cases


def test_z_order(spark):
    def halves(value):
        bits = f"{value:016b}"[::-1]
        return int(bits[0::2][::-1], 2), int(bits[1::2][::-1], 2)

    df = spark.createDataFrame([(v,) for v in (0, 1, 2, 3, 5, 170, 255)], "v int")
    for r in df.select("v", *ip.z_order(F.col("v"), 8), *ip.z_order(F.col("v") * 257, 16)).collect():
        assert (r[1], r[2]) == halves(r[0]) and (r[3], r[4]) == halves(r[0] * 257)


def test_address_on_the_map(spark):
    df = spark.createDataFrame([("172.168.0.1",), (None,), ("x",), ("::",)], "a string")
    assert rows(tiling.ip_heatmap(df, "a", [4], 4), *tiling.BIN, "value") == [(4, 0, 0, 0, 3, 1.0), (4, 2, 14, 0, 0, 1.0)]


def test_blur(spark):
    weights = {(u, v): w for u, v, w in kernel(1, 3.0)}
    assert math.isclose(sum(weights.values()), 1.0)
    cells = spark.createDataFrame([(1, 0, 1, 3, 3, 2.0), (1, 0, 1, 0, 0, None)], "z int, tx int, ty int, bin_x int, bin_y int, value double")
    for tms, below in ((True, 0), (False, 2)):
        got = {tuple(r)[:5]: r[5] for r in blur(cells, 1, 3.0, 4, tms).collect()}
        # The corner of a tile reaches three others, and the edge of the world tiles beyond.
        assert math.isclose(got[(1, 0, 1, 3, 3)], 2 * weights[(0, 0)])
        assert math.isclose(got[(1, 1, below, 0, 0)], 2 * weights[(1, 1)])
        assert math.isclose(got[(1, -1, 2 if tms else 0, 3, 3)], weights[(-1, -1)])
        assert math.isclose(sum(got.values()), 3.0)


def test_dense_bytes(spark):
    cells = spark.createDataFrame([(0, 0, 0, 1, 0, 1.0), (0, 0, 0, 0, 1, 2.0), (0, 0, 0, 1, 1, 3.0), (1, 0, 0, 0, 0, 0.0)], "z int, tx int, ty int, bin_x int, bin_y int, value double")
    out = codec.dense(cells, 2).collect()
    assert [(r["z"], bytes(r["payload"])) for r in out] == [(0, struct.pack("<4d", 0, 1, 2, 3))]
    assert rows(codec.from_dense(codec.dense(cells, 2), 2), "bin_x", "bin_y", "bin_t", "value") == [(0, 1, 0, 2.0), (1, 0, 0, 1.0), (1, 1, 0, 3.0)]


def test_score_json(spark):
    schema = "z int, tx int, ty int, bin_x int, bin_y int, topics array<struct<term: string, n: int>>"
    cells = spark.createDataFrame([(0, 0, 0, 3, 2, [("a", 3)]), (0, 0, 0, 3, 3, [("b", 3), ("c", 2), ('d"', 1)]), (0, 0, 0, 0, 0, [])], schema)
    out = codec.scores(cells, 4)
    assert out.first()["payload"] == '[{"binIndex": 11, "topics": {"a": 3}},{"binIndex": 15, "topics": {"b": 3, "c": 2, "d\\"": 1}}]'
    assert rows(codec.from_scores(out, 4), "bin", "term", "n") == [(11, "a", 3), (15, "b", 3), (15, "c", 2), (15, 'd"', 1)]
    ranked = spark.createDataFrame([(0, 0, 0, "t", 0.5, 1), (0, 0, 0, "u", 0.25, 2)], "z int, tx int, ty int, term string, score double, rank int")
    made = codec.tile_scores(ranked)
    assert made.first()["payload"] == '{"t": 0.5, "u": 0.25}'
    assert rows(codec.from_tile_scores(made), "term", "score") == [("t", 0.5), ("u", 0.25)]


def test_lines_and_circles(spark):
    L, lit = geometry.Line.through, F.lit
    a, b = L(0, 0, 2, 2), L(0, 2, 2, 0)
    circle = geometry.Circle(lit(0.0), lit(0.0), lit(5.0))
    got = one(spark, *a.meets(b), *a.meets(L(0, 1, 1, 2)), a.y_of(lit(3.0)), L(1, 0, 1, 5).y_of(lit(1.0)), L(0, 3, 1, 3).to_point(lit(9.0), lit(0.0)), L(0, 9, 1, 9).to_circle(circle), *L(3, 0, 3, 1).crosses(circle), L(6, 0, 6, 1).crosses(circle)[0], a.same(L(5, 5, 1, 1)))
    assert got[:2] == (1.0, 1.0) and got[2:4] == (None, None) and got[4] == 3.0 and got[5] is None and got[6] == 3.0 and got[7] == 4.0
    assert sorted([got[8:10], got[10:12]]) == [(3.0, -4.0), (3.0, 4.0)] and got[12] is None and got[13]


def test_arc_geometry(spark):
    x1, y1, x2, y2 = (F.lit(float(v)) for v in (24, 24, 36, 33))
    cx, cy = geometry.arc_center(x1, y1, x2, y2, geometry.THIRD)
    r = geometry.arc_radius(x1, y1, x2, y2, geometry.THIRD)
    got = one(spark, geometry.distance(cx, cy, x1, y1), geometry.distance(cx, cy, x2, y2), r, geometry.arc_angle(r, F.lit(15.0)), geometry.closest_modulus(F.lit(0.0), F.lit(7.0), F.lit(4.0)))
    assert all(math.isclose(g, 15.0) for g in got[:3]) and math.isclose(got[3], geometry.THIRD) and got[4] == -1.0
    assert geometry.sectors(1, 0.5, 3, 0.5, 8, True) == [1, 2, 3]
    assert geometry.sectors(1, 0.5, 6, 0.5, 8, False) == [1, 0, 7, 6]
    assert geometry.sectors(2, 0.5, 2, 0.7, 8, True) == [2, 3, 4, 5, 6, 7, 0, 1, 2]


class Halves:
    """A point in its bin of level z and, from level 1 on, in the bin across the middle."""

    def places(self, z, bins):
        at = lambda x: F.struct(F.floor(x * F.pow(F.lit(2), z)).cast("int").alias("tx"), F.lit(0).alias("ty"), F.lit(0).alias("bin_x"), F.lit(0).alias("bin_y"), x.alias("from"))
        return F.when(F.col("a") < 0, F.lit(None)).when(z == 0, F.array(at(F.col("a")))).otherwise(F.array(at(F.col("a")), at(1 - F.col("a"))))


def test_a_projection_of_ones_own(spark):
    df = spark.createDataFrame([(0.2,), (0.7,), (-1.0,), (None,)], "a double").where("a IS NOT NULL")
    for tms in (True, False):
        got = tiling.binned(df, Halves(), "a", "a", [0, 1], 1, [F.count("*").alias("n"), F.max("from").alias("m")], tms=tms)
        exp = [(0, 0, 0, 0, 0, 2, 0.7), (1, 0, 0 if tms else 1, 0, 0, 2, 0.3), (1, 1, 0 if tms else 1, 0, 0, 2, 0.8)]
        assert [(*r[:6], round(r[6], 9)) for r in sorted(map(tuple, got.collect()))] == exp


def test_spreading_of_ones_own(spark):
    cells = spark.createDataFrame([(0, 0, 0, 0, 0, 2.0, 1), (0, 0, 0, 1, 0, 3.0, 1), (0, 0, 0, 1, 1, None, 1)], "z int, tx int, ty int, bin_x int, bin_y int, value double, bin_t int")
    to_right = F.when(F.col("value") > 0, F.array(F.struct(F.lit(0).alias("dx"), F.lit(0).alias("dy"), F.col("value").alias("value")), F.struct(F.lit(1).alias("dx"), F.lit(0).alias("dy"), (F.col("value") * 10).alias("value"))))
    got = sorted(map(tuple, blur_module.spread(cells, to_right, 2).collect()))
    assert got == [(0, 0, 0, 0, 0, 1, 2.0), (0, 0, 0, 1, 0, 1, 23.0), (0, 1, 0, 0, 0, 1, 30.0)]


def test_addresses_step_by_step(spark):
    cases = [*V4, *V6, "0.0.0.0", "255.255.255.255", "1.2.3.4", "+1.2.3.4", "-1.2.3.4", "1..3.4", "1.2.3.4.", "1.2.3.99999999999", "00001.2.3.4", "1.2.3.4 "]
    df = spark.createDataFrame([(a,) for a in cases], "a string")
    got = ip.with_points(df, _p="a").select("a", "_p", ip.place(F.col("a")).alias("q")).collect()
    assert len(got) == len(cases) and all(r["_p"] == r["q"] for r in got) and sum(r["q"] is not None for r in got) > 8
