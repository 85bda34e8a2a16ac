"""The queries of this package, and SQL that says the same about the same tables."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.functions import geometry, grid, ip
from quadrille.functions.grid import Cartesian, Mercator, TimeRange
from quadrille.operators import blur, codec, lda, segments, tiling, topics
from quadrille.operators.tiling import BIN, TILE
from quadrille.sources import schema as schemas
from quadrille.sources import tables

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None, name: str | None = None):
    """Registers a query with its SQL."""

    def register(f):
        QUERIES[name or f.__name__] = f
        if sql is not None:
            ORACLE_SQL[name or f.__name__] = sql
        return f

    return register


def _t(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


# Tables with coordinates: prices and quantities, vectors as places, days and amounts, documents on a grid by their number.

PRICES = Cartesian((900.0, 1.0, 105000.0, 51.0))
AMOUNTS = Cartesian((0.0, 0.0, 500.0, 1000.0))
GRID = Cartesian((0.0, 0.0, 32.0, 32.0))
JANUARY = TimeRange(1704067200000, 1706659200000, 10)


def prices(spark, sf):
    return _t(spark, sf, "lineitem").select("l_extendedprice", "l_quantity")


def places(spark, sf):
    e = F.col("embedding")
    d = lambda i, k: e[i].cast("double") * k
    return _t(spark, sf, "embeddings").select("vec_id", "label", d(0, 450.0).alias("lon"), d(1, 200.0).alias("lat"), *[d(i, 1.0).alias(f"e{i}") for i in range(4)])


def events(spark, sf):
    return _t(spark, sf, "events").withColumn("spot", F.pmod("event_id", F.lit(1000)).cast("double"))


def texts(spark, sf):
    return _t(spark, sf, "documents").select("doc_id", "text", F.pmod("doc_id", F.lit(32)).cast("double").alias("x"), F.pmod(F.floor(F.col("doc_id") / 32), F.lit(32)).cast("double").alias("y"))


PLACES_SQL = "(SELECT vec_id, label, embedding[1]::DOUBLE * 450.0 AS lon, embedding[2]::DOUBLE * 200.0 AS lat, embedding[1]::DOUBLE AS e0, embedding[2]::DOUBLE AS e1, embedding[3]::DOUBLE AS e2, embedding[4]::DOUBLE AS e3 FROM embeddings)"
EVENTS_SQL = "(SELECT *, (event_id % 1000)::DOUBLE AS spot, (epoch_us(ts) // 1000) AS ms FROM events)"
TEXTS_SQL = "(SELECT doc_id, text, (doc_id % 32)::DOUBLE AS x, ((doc_id // 32) % 32)::DOUBLE AS y FROM documents)"
WORDS_SQL = r"list_filter(list_transform(regexp_split_to_array(text, '(''$|^''|''[^a-zA-Z_0-9'']+|[^a-zA-Z_0-9'']+''|[^a-zA-Z_0-9''])+'), lambda w: trim(lower(w))), lambda w: w <> '')"


def points_sql(source: str, x: str, y: str, levels: list[int], bins: int, projection=None, extra: str = "") -> str:
    """A subquery of tiles and bins of points."""
    if isinstance(projection, Mercator):
        a, b, c, d = projection.bounds
        where, u, v = f"{x} > {a!r}::DOUBLE AND {x} < {c!r}::DOUBLE AND {y} > {b!r}::DOUBLE AND {y} < {d!r}::DOUBLE", f"({x} + 180.0::DOUBLE) / 360.0::DOUBLE", f"(1.0::DOUBLE + ln(tan(radians({y})) + 1.0::DOUBLE / cos(radians({y}))) / pi()) / 2.0::DOUBLE"
    else:
        a, b, c, d = projection.bounds
        where, u, v = f"{x} >= {a!r}::DOUBLE AND {x} < {c!r}::DOUBLE AND {y} >= {b!r}::DOUBLE AND {y} < {d!r}::DOUBLE", f"({x} - {a!r}::DOUBLE) / {c - a!r}::DOUBLE", f"({y} - {b!r}::DOUBLE) / {d - b!r}::DOUBLE"
    more = f", {extra}" if extra else ""
    return f"""(
SELECT *, floor((fx - tx) * {bins})::INT AS bin_x, ({bins - 1} - floor((fy - ty) * {bins}))::INT AS bin_y
FROM (SELECT *, floor(fx)::INT AS tx, floor(fy)::INT AS ty
      FROM (SELECT z, ({u}) * pow(2.0::DOUBLE, z) AS fx, ({v}) * pow(2.0::DOUBLE, z) AS fy{more}
            FROM {source}, (SELECT unnest({levels}) AS z) WHERE {where})))"""


def cells_sql(points: str, value: str = "count(*)::DOUBLE", keys: str = "") -> str:
    return f"SELECT z, tx, ty, bin_x, bin_y{keys}, {value} AS value FROM {points} GROUP BY z, tx, ty, bin_x, bin_y{keys}"


PRICE_POINTS = points_sql("lineitem", "l_extendedprice", "l_quantity", [0, 1, 2, 3, 4], 16, PRICES, "l_quantity, l_discount")
PLACE_POINTS = points_sql(PLACES_SQL, "lon", "lat", [0, 1, 2], 32, Mercator(), "label")
EVENT_POINTS = points_sql(EVENTS_SQL, "value", "spot", [0, 1, 2], 8, AMOUNTS, "event_type, value, (ms - 1704067200000) // 259200000 AS bin_t, ms")
IN_JANUARY = "ms >= 1704067200000 AND ms <= 1706659200000 AND bin_t < 10"
TEXT_POINTS = points_sql(TEXTS_SQL, "x", "y", [0, 1, 2], 1, GRID, f"{WORDS_SQL} AS w")


@query(cells_sql(PRICE_POINTS))
def heatmap_cartesian(spark, sf):
    return tiling.heatmap(prices(spark, sf), "l_extendedprice", "l_quantity", PRICES, [0, 1, 2, 3, 4], 16)


@query(cells_sql(PRICE_POINTS))
def heatmap_no_rollup(spark, sf):
    return tiling.heatmap(prices(spark, sf), "l_extendedprice", "l_quantity", PRICES, [0, 1, 2, 3, 4], 16, rollup=False)


@query(cells_sql(PRICE_POINTS, "sum(l_quantity)::DOUBLE"))
def heatmap_value_sum(spark, sf):
    return tiling.heatmap(prices(spark, sf), "l_extendedprice", "l_quantity", PRICES, [0, 1, 2, 3, 4], 16, "l_quantity")


@query(cells_sql(PLACE_POINTS))
def heatmap_mercator(spark, sf):
    return tiling.heatmap(places(spark, sf), "lon", "lat", Mercator(), [0, 1, 2], 32)


@query(cells_sql(points_sql(PLACES_SQL, "lon", "lat", [0, 1, 2], 10, Mercator((-90.0, -67.0, 90.0, 67.0)))))
def heatmap_mercator_bounds(spark, sf):
    return tiling.heatmap(places(spark, sf), "lon", "lat", Mercator((-90.0, -67.0, 90.0, 67.0)), [0, 1, 2], 10)


@query(f"SELECT z, tx, ty, min(value) AS min, max(value) AS max, count(*) AS n_bins FROM ({cells_sql(PRICE_POINTS)}) GROUP BY z, tx, ty")
def tile_minmax(spark, sf):
    return tiling.tile_range(heatmap_cartesian(spark, sf))


@query(f"SELECT z, tx, ty, CASE WHEN count(*) < 256 THEN least(min(value), 0) ELSE min(value) END AS min, max(value) AS max, count(*) AS n_bins FROM ({cells_sql(PRICE_POINTS)}) GROUP BY z, tx, ty")
def tile_minmax_with_empty(spark, sf):
    return tiling.tile_range(heatmap_cartesian(spark, sf), 16, include_empty=True)


@query("SELECT min(l_quantity)::DOUBLE AS min_l_quantity, max(l_quantity)::DOUBLE AS max_l_quantity, min(l_extendedprice)::DOUBLE AS min_l_extendedprice, max(l_extendedprice)::DOUBLE AS max_l_extendedprice, min(l_orderkey)::DOUBLE AS min_l_orderkey, max(l_orderkey)::DOUBLE AS max_l_orderkey FROM lineitem")
def get_bounds(spark, sf):
    return tiling.bounds(_t(spark, sf, "lineitem"), "l_quantity", "l_extendedprice", "l_orderkey")


@query(f"SELECT z, tx, ty, bin_x, bin_y, count(*) AS n, count(DISTINCT label) AS labels, max(label)::INT AS top FROM {PLACE_POINTS} GROUP BY z, tx, ty, bin_x, bin_y")
def generic_tiling(spark, sf):
    return tiling.binned(places(spark, sf), Mercator(), "lon", "lat", [0, 1, 2], 32, [F.count("*").alias("n"), F.countDistinct("label").alias("labels"), F.max("label").alias("top")])


@query(cells_sql(f"(SELECT * FROM {EVENT_POINTS} WHERE {IN_JANUARY})", keys=", bin_t").replace(", bin_t, count", ", bin_t::INT AS bin_t, count"))
def time_heatmap(spark, sf):
    return tiling.time_heatmap(events(spark, sf), "value", "spot", "ts", AMOUNTS, JANUARY, [0, 1, 2], 8)


@query("SELECT (((epoch_us(ts) // 1000) - 1704067200000) // 259200000)::INT AS bin_t, count(*) AS n, min((epoch_us(ts) // 1000)) AS first_ms FROM events WHERE (epoch_us(ts) // 1000) BETWEEN 1704067200000 AND 1706659200000 AND ((epoch_us(ts) // 1000) - 1704067200000) // 259200000 < 10 GROUP BY 1")
def time_buckets(spark, sf):
    e = events(spark, sf)
    ms = grid.millis(e, "ts")
    return e.where(JANUARY.inside(ms)).groupBy(JANUARY.bucket(ms).alias("bin_t")).agg(F.count("*").alias("n"), F.min(ms).alias("first_ms"))


def _flat(cells: DataFrame, keys: list[str] = BIN) -> DataFrame:
    return cells.select(*keys, F.array_join(F.transform("topics", lambda t: F.concat_ws(":", t["term"], t["n"].cast("string"))), "|").alias("topics"))


def topics_sql(points: str, keys: str, limit: int) -> str:
    """points: with a column term."""
    return f"""SELECT {keys}, string_agg(term || ':' || n, '|' ORDER BY n DESC, term) AS topics
FROM (SELECT *, row_number() OVER (PARTITION BY {keys} ORDER BY n DESC, term) AS r FROM (SELECT {keys}, term, count(*) AS n FROM {points} GROUP BY {keys}, term))
WHERE r <= {limit} GROUP BY {keys}"""


TERMS, STOP = ["the", "die", "les", "que"], ["the", "of", "and", "der", "de", "la"]
_STOP_SQL = ", ".join(f"'{w}'" for w in STOP)
_BIN_SQL = "z, tx, ty, bin_x, bin_y"


@query(topics_sql(f"(SELECT {_BIN_SQL}, unnest(w) AS term FROM {TEXT_POINTS})", _BIN_SQL, 15))
def topics_topn(spark, sf):
    return _flat(topics.topics(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2], words=True))


@query(topics_sql(f"(SELECT {_BIN_SQL}, unnest(w) AS term FROM {TEXT_POINTS} WHERE list_has_any(w, {TERMS}))", _BIN_SQL, 5))
def topics_term_filter(spark, sf):
    return _flat(topics.topics(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2], 5, terms=TERMS, words=True))


@query(topics_sql(f"(SELECT * FROM (SELECT {_BIN_SQL}, unnest(w) AS term FROM {TEXT_POINTS}) WHERE term NOT IN ({_STOP_SQL}))", _BIN_SQL, 10))
def topics_stopwords(spark, sf):
    return _flat(topics.topics(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2], 10, stop=STOP, words=True))


@query(topics_sql(f"(SELECT z, tx, ty, bin_x, bin_y, bin_t::INT AS bin_t, event_type AS term FROM {EVENT_POINTS} WHERE {IN_JANUARY})", f"{_BIN_SQL}, bin_t", 3))
def time_topics_topn(spark, sf):
    rows = events(spark, sf).withColumn("tokens", F.array("event_type"))
    return _flat(topics.time_topics(rows, "value", "spot", "ts", "tokens", AMOUNTS, JANUARY, [0, 1, 2], 3, 8), [*BIN, "bin_t"])


_COUNTS_SQL = f"(SELECT z, tx, ty, term, count(*) AS n FROM (SELECT z, tx, ty, unnest(w) AS term FROM {TEXT_POINTS}) GROUP BY z, tx, ty, term)"


def _counted(spark, sf):
    return topics.term_counts(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2])


@query(f"SELECT * FROM {_COUNTS_SQL}")
def termfreq_tile(spark, sf):
    return _counted(spark, sf)


@query(f"SELECT z, tx, ty, count(*) AS n_terms, sum(n)::BIGINT AS n_words, max(n)::BIGINT AS most FROM {_COUNTS_SQL} GROUP BY z, tx, ty")
def word_bags_tile(spark, sf):
    bags = topics.word_bags(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2])
    return bags.select(*TILE, F.size("words").cast("long").alias("n_terms"), F.aggregate(F.map_values("words"), F.lit(0).cast("long"), lambda a, b: a + b).alias("n_words"), F.array_max(F.map_values("words")).alias("most"))


def dictionary_sql(where: str = "true", having: str = "true", features: int | None = None) -> str:
    docs = f"(SELECT z, count(*) AS docs FROM (SELECT DISTINCT z, tx, ty FROM {_COUNTS_SQL}) GROUP BY z)"
    body = f"SELECT z, term, count(*) AS df, any_value(docs) AS docs FROM {_COUNTS_SQL} JOIN {docs} USING (z) WHERE {where} GROUP BY z, term HAVING {having}"
    return body if features is None else f"SELECT z, term, df, docs FROM (SELECT *, row_number() OVER (PARTITION BY z ORDER BY df DESC, term) AS r FROM ({body})) WHERE r <= {features}"


@query(dictionary_sql(f"term NOT IN ({_STOP_SQL})", "count(*) >= 0.2::DOUBLE * any_value(docs) AND count(*) <= 0.9::DOUBLE * any_value(docs)", 300))
def dictionary_df_filters(spark, sf):
    return topics.dictionary(_counted(spark, sf), stop=STOP, least=0.2, most=90.0, features=300)


_TF_SQL = {"raw": "n::DOUBLE", "sublinear": "1.0::DOUBLE + ln(n)", "normalized": "n::DOUBLE / total", "double-normalized": "0.4::DOUBLE + 0.6::DOUBLE * n / most", "binary": "1.0::DOUBLE"}
_IDF_SQL = {"unary": "1.0::DOUBLE", "linear": "docs::DOUBLE / df", "log": "ln(docs::DOUBLE / df)", "log-smooth": "ln(1.0::DOUBLE + docs::DOUBLE / df)", "probabilistic": "CASE WHEN docs > df THEN ln((docs - df)::DOUBLE / df) END"}


def _register_tfidf(tf: str, idf: str) -> None:
    # Scores are compared rounded, and so are ranked.
    sql = f"""
WITH known AS (
    SELECT c.*, df, docs, sum(n) OVER (PARTITION BY c.z, tx, ty) AS total, max(n) OVER (PARTITION BY c.z, tx, ty) AS most
    FROM {_COUNTS_SQL} c JOIN ({dictionary_sql()}) d ON c.z = d.z AND c.term = d.term
)
SELECT z, tx, ty, count(*) AS terms, round(min(score), 5) AS low, round(max(score), 5) AS high, round(sum(score), 3) AS total
FROM (SELECT *, ({_TF_SQL[tf]}) * ({_IDF_SQL[idf]}) AS score, row_number() OVER (PARTITION BY z, tx, ty ORDER BY ({_TF_SQL[tf]}) * ({_IDF_SQL[idf]}) DESC NULLS LAST, term) AS r FROM known)
WHERE r <= 12 GROUP BY z, tx, ty"""

    @query(sql, f"tfidf_{tf.replace('-', '_')}_{idf.replace('-', '_')}")
    def run(spark, sf):
        ranked = topics.tfidf(_counted(spark, sf), 12, tf, idf, 0.4)
        return ranked.groupBy(*TILE).agg(F.count("*").alias("terms"), F.round(F.min("score"), 5).alias("low"), F.round(F.max("score"), 5).alias("high"), F.round(F.sum("score"), 3).alias("total"))


for _tf, _idf in (("raw", "log"), ("sublinear", "log-smooth"), ("normalized", "linear"), ("double-normalized", "unary"), ("binary", "probabilistic")):
    _register_tfidf(_tf, _idf)


# Segments between the first and the last two components of a vector.

BOX = Cartesian((-0.5, -0.5, 0.5, 0.5))
ENDS = ("e0", "e1", "e2", "e3")


def ends_sql(source: str, levels: list[int], bins: int, x1: str = "e0", y1: str = "e1", x2: str = "e2", y2: str = "e3", low: float = -0.5, width: float = 1.0, extra: str = "") -> str:
    """Universal bins of segments' ends; truncated as casts to integers do."""
    u = lambda c: f"trunc(({c} - {low!r}::DOUBLE) / {width!r}::DOUBLE * pow(2.0::DOUBLE, z) * {bins})::BIGINT"
    v = lambda c: f"trunc(pow(2.0::DOUBLE, z) * {bins} - ({c} - {low!r}::DOUBLE) / {width!r}::DOUBLE * pow(2.0::DOUBLE, z) * {bins})::BIGINT"
    return f"(SELECT z, {u(x1)} AS ux1, {v(y1)} AS uy1, {u(x2)} AS ux2, {v(y2)} AS uy2{', ' + extra if extra else ''} FROM {source}, (SELECT unnest({levels}) AS z))"


def walk_sql(ends: str, keep: str = "true") -> str:
    """Bins of the lines."""
    return f"""(
SELECT *, ux1 + CASE WHEN steep THEN across ELSE along END AS ux, uy1 + CASE WHEN steep THEN along ELSE across END AS uy
FROM (SELECT *, k * sign(long)::BIGINT AS along,
             sign(short)::BIGINT * (CASE WHEN n = 0 THEN 0 ELSE ((CASE WHEN long > 0 THEN n - 1 - (n >> 1) ELSE n >> 1 END) + k * abs(short)) // greatest(n, 1) END) AS across
      FROM (SELECT *, unnest(range(0, n + 1)) AS k
            FROM (SELECT *, abs(long) AS n
                  FROM (SELECT *, CASE WHEN steep THEN uy2 - uy1 ELSE ux2 - ux1 END AS long, CASE WHEN steep THEN ux2 - ux1 ELSE uy2 - uy1 END AS short
                        FROM (SELECT *, abs(uy2 - uy1) > abs(ux2 - ux1) AS steep FROM {ends}) WHERE {keep})))))"""


def tiles_sql(walk: str, bins: int, value: str = "count(*)::DOUBLE AS value", where: str = "true") -> str:
    return f"""SELECT z, floor(ux::DOUBLE / {bins})::INT AS tx, (pow(2, z) - 1 - floor(uy::DOUBLE / {bins}))::INT AS ty, (((ux % {bins}) + {bins}) % {bins})::INT AS bin_x, (((uy % {bins}) + {bins}) % {bins})::INT AS bin_y, {value}
FROM {walk} WHERE {where} GROUP BY z, ux, uy"""


_LENGTH = "(ux2 - ux1) * (ux2 - ux1) + (uy2 - uy1) * (uy2 - uy1)"
_NEAR = "((ux - ux1) * (ux - ux1) + (uy - uy1) * (uy - uy1) <= {0} OR (ux - ux2) * (ux - ux2) + (uy - uy2) * (uy - uy2) <= {0})"
_ENDS = ends_sql(PLACES_SQL, [0, 2], 32, extra="vec_id, label")


@query(tiles_sql(walk_sql(_ENDS), 32))
def segment_line(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32)


@query(tiles_sql(walk_sql(_ENDS), 32, "sum(label)::DOUBLE AS value"))
def segment_value_sum(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32, "label")


@query(tiles_sql(walk_sql(_ENDS, f"{_LENGTH} BETWEEN 16 AND 2500"), 32))
def segment_length_filter(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32, low=4, high=50)


@query(tiles_sql(walk_sql(_ENDS), 32, where=_NEAR.format(64)))
def segment_leader(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32, shape="leaderline", leader=8)


def _mercator_ends(levels: list[int], bins: int) -> str:
    fx = lambda c: f"({c} + 180.0::DOUBLE) / 360.0::DOUBLE * pow(2.0::DOUBLE, z)"
    fy = lambda c: f"(1.0::DOUBLE + ln(tan(radians({c})) + 1.0::DOUBLE / cos(radians({c}))) / pi()) / 2.0::DOUBLE * pow(2.0::DOUBLE, z)"
    x = lambda f: f"(floor({f}) * {bins} + floor(({f} - floor({f})) * {bins}))::BIGINT"
    y = lambda f: f"((pow(2.0::DOUBLE, z) - 1 - floor({f})) * {bins} + {bins - 1} - floor(({f} - floor({f})) * {bins}))::BIGINT"
    inside = "abs(lon) < 180 AND abs(lat) < 85.05112878 AND abs(lon2) < 180 AND abs(lat2) < 85.05112878"
    source = f"(SELECT *, e2 * 450.0::DOUBLE AS lon2, e3 * 200.0::DOUBLE AS lat2 FROM {PLACES_SQL})"
    return f"(SELECT z, {x(fx('lon'))} AS ux1, {y(fy('lat'))} AS uy1, {x(fx('lon2'))} AS ux2, {y(fy('lat2'))} AS uy2 FROM {source}, (SELECT unnest({levels}) AS z) WHERE {inside})"


@query(tiles_sql(walk_sql(_mercator_ends([1, 3], 16)), 16))
def segment_mercator(spark, sf):
    rows = places(spark, sf).withColumns({"lon2": F.col("e2") * 450.0, "lat2": F.col("e3") * 200.0})
    return segments.segment_heatmap(rows, ("lon", "lat", "lon2", "lat2"), [1, 3], Mercator(), 16)


@query(f"SELECT z, min(value) AS min, max(value) AS max FROM ({tiles_sql(walk_sql(_ENDS), 32)}) GROUP BY z")
def segment_level_minmax(spark, sf):
    return tiling.level_range(segment_line(spark, sf))


@query(f"SELECT DISTINCT vec_id, z, floor(ux::DOUBLE / 32)::INT AS tx, (pow(2, z) - 1 - floor(uy::DOUBLE / 32))::INT AS ty, ux1, uy1, ux2, uy2 FROM {walk_sql(_ENDS)} WHERE {_NEAR.format(64)}")
def segment_tiles_stage1(spark, sf):
    return segments.segment_tiles(places(spark, sf), ENDS, [0, 2], BOX, 32, ["vec_id"], 8)


@query(tiles_sql(walk_sql(_ENDS), 32, where=_NEAR.format(64)))
def segment_tiles_stage2(spark, sf):
    spread = segments.within_tiles(segments.segment_tiles(places(spark, sf), ENDS, [0, 2], BOX, 32, ["vec_id"], 8), 32, 8)
    return spread.groupBy(*BIN).agg(F.sum("value").alias("value"))


@query(
    f"""WITH near AS (
    SELECT vec_id, z, ux, uy, k, row_number() OVER w - 1 AS i, count(*) OVER (PARTITION BY vec_id, z) AS c, list(k) OVER (PARTITION BY vec_id, z ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS ks
    FROM {walk_sql(_ENDS)} WHERE {_NEAR.format(64)} WINDOW w AS (PARTITION BY vec_id, z ORDER BY k)
)
SELECT vec_id, z, floor(ux::DOUBLE / 32)::INT AS tx, (pow(2, z) - 1 - floor(uy::DOUBLE / 32))::INT AS ty, (((ux % 32) + 32) % 32)::INT AS bin_x, (((uy % 32) + 32) % 32)::INT AS bin_y,
       CASE WHEN c < 16 OR c < 2 OR ks[c // 2 + 1] - ks[c // 2] <= 1 THEN 1.0 WHEN i < c // 2 THEN (c // 2 - i)::DOUBLE / (c // 2) ELSE (i - c // 2 + 1)::DOUBLE / (c // 2) END::DOUBLE AS share
FROM near"""
)
def fading_line(spark, sf):
    return segments.fading_segments(places(spark, sf), ENDS, [0, 2], BOX, 32, 8, ["vec_id"])


def arcs_sql(ends: str, keep: str, leader: float | None = None, angle: float = geometry.THIRD) -> str:
    """Bins of clockwise arcs, one recursive step a bin; leader: from both ends where these do not meet."""
    octant = lambda x, y: f"CASE WHEN {x} = 0 AND {y} = 0 THEN 0 WHEN {x} >= 0 AND {y} > 0 THEN (CASE WHEN {y} > {x} THEN 1 ELSE 0 END) WHEN {x} < 0 AND {y} >= 0 THEN (CASE WHEN -{x} > {y} THEN 3 ELSE 2 END) WHEN {x} <= 0 AND {y} < 0 THEN (CASE WHEN -{y} > -{x} THEN 5 ELSE 4 END) WHEN {x} > -{y} THEN 7 ELSE 6 END"
    rise = 2.0 * math.tan(angle / 2.0)
    whole = "true" if leader is None else f"NOT ({angle!r}::DOUBLE > 4.0::DOUBLE * asin(least(1.0::DOUBLE, {float(leader)!r}::DOUBLE / (chord / {math.sin(angle / 2.0)!r}::DOUBLE))) AND {float(leader)!r}::DOUBLE <= chord / {math.sin(angle / 2.0)!r}::DOUBLE)"
    back = "SELECT false AS back" if leader is None else "SELECT unnest([false, true]) AS back"
    return f"""(
WITH RECURSIVE centers AS (
    SELECT *, (x1 + x2) / 2.0::DOUBLE + (y2 - y1) / {rise!r}::DOUBLE AS cx, (y1 + y2) / 2.0::DOUBLE - (x2 - x1) / {rise!r}::DOUBLE AS cy, sqrt((x2 - x1) * (x2 - x1) + (y2 - y1) * (y2 - y1)) AS chord
    FROM (SELECT *, ux1::DOUBLE AS x1, uy1::DOUBLE AS y1, ux2::DOUBLE AS x2, uy2::DOUBLE AS y2 FROM {ends}) WHERE {keep}
), octants AS (
    SELECT *, {octant("(x1 - cx)", "(y1 - cy)")} AS f, {octant("(x2 - cx)", "(y2 - cy)")} AS l, (y1 - cy) / (x1 - cx) AS s1, (y2 - cy) / (x2 - cx) AS s2, ceil(8 * sqrt((x1 - cx) * (x1 - cx) + (y1 - cy) * (y1 - cy))) + 16 AS most, {whole} AS entire
    FROM centers
), begun AS (
    SELECT z, cx, cy, f, l, s1, s2, most, back, CASE WHEN f = l AND NOT s1 < s2 THEN 8 ELSE (f - l + 8) % 8 END AS ahead, CASE WHEN back THEN x2 ELSE x1 END AS x, CASE WHEN back THEN y2 ELSE y1 END AS y,
           CASE WHEN entire THEN 1e300::DOUBLE ELSE {float(leader or 0)!r}::DOUBLE END AS within
    FROM octants, ({back}) WHERE NOT (entire AND back)
), walk AS (
    SELECT *, x AS fx, y AS fy, 0.0::DOUBLE AS lo, 0.0::DOUBLE AS mid, 0.0::DOUBLE AS hi, -1 AS kept, 0 AS step FROM begun WHERE within > 0
    UNION ALL
    SELECT z, cx, cy, f, l, s1, s2, most, back, ahead, x, y, within, fx, fy, lo, mid, hi, axis, step
    FROM (SELECT *, {octant("(x - cx)", "(y - cy)")} AS o, (y - cy) / (x - cx) AS slope FROM (
        SELECT * REPLACE (CASE WHEN axis = 0 THEN m + s ELSE c0 + turn END AS x, CASE WHEN axis = 0 THEN c0 + turn ELSE m + s END AS y,
                          CASE WHEN axis = 1 THEN least(low, high) ELSE low END AS lo, CASE WHEN axis = 1 THEN greatest(low, high) ELSE high END AS hi, now AS mid, step + 1 AS step)
        FROM (SELECT *, CASE WHEN now < lo THEN -side WHEN now >= hi THEN side ELSE 0 END AS turn,
                     CASE WHEN now < lo THEN (c - side - 0.5::DOUBLE * side) * (c - side - 0.5::DOUBLE * side) WHEN now >= hi THEN hi ELSE lo END AS low,
                     CASE WHEN now < lo THEN lo WHEN now >= hi THEN (c + side + 0.5::DOUBLE * side) * (c + side + 0.5::DOUBLE * side) ELSE hi END AS high
              FROM (SELECT *, mid - s * 2.0::DOUBLE * (m - mc) - 1.0::DOUBLE AS now, CASE WHEN c > 0 THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END AS side
                    FROM (SELECT * REPLACE (CASE WHEN kept = axis THEN lo ELSE least((c - 0.5::DOUBLE) * (c - 0.5::DOUBLE), (c + 0.5::DOUBLE) * (c + 0.5::DOUBLE)) END AS lo, CASE WHEN kept = axis THEN mid ELSE c * c END AS mid,
                                            CASE WHEN kept = axis THEN hi ELSE greatest((c - 0.5::DOUBLE) * (c - 0.5::DOUBLE), (c + 0.5::DOUBLE) * (c + 0.5::DOUBLE)) END AS hi)
                          FROM (SELECT *, c0 - cc AS c FROM (
                              SELECT *, CASE WHEN axis = 0 THEN x ELSE y END AS m, CASE WHEN axis = 0 THEN y ELSE x END AS c0, CASE WHEN axis = 0 THEN cx ELSE cy END AS mc, CASE WHEN axis = 0 THEN cy ELSE cx END AS cc
                              FROM (SELECT *, CASE WHEN oct IN (1, 2, 5, 6) THEN 0 ELSE 1 END AS axis, (CASE WHEN oct IN (1, 2, 3, 4) THEN 1.0::DOUBLE ELSE -1.0::DOUBLE END) * (CASE WHEN back THEN -1.0::DOUBLE ELSE 1.0::DOUBLE END) AS s
                                    FROM (SELECT *, {octant("(x - cx)", "(y - cy)")} AS oct FROM walk WHERE step + 1 < most)))))))))
    WHERE (CASE WHEN f = l THEN o = f AND s2 <= slope AND slope <= s1 WHEN o = f THEN slope <= s1 WHEN o = l THEN s2 <= slope ELSE (f - o + 8) % 8 <= ahead END)
      AND sqrt((x - fx) * (x - fx) + (y - fy) * (y - fy)) < within
)
SELECT z, x::BIGINT AS ux, y::BIGINT AS uy FROM walk)"""


@query(tiles_sql(arcs_sql(_ENDS, f"{_LENGTH} BETWEEN 16 AND 1048576"), 32))
def segment_arc(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32, shape="fullarc", low=4, high=1024)


@query(tiles_sql(arcs_sql(_ENDS, f"{_LENGTH} BETWEEN 16 AND 1048576", 8), 32))
def segment_leader_arc(spark, sf):
    return segments.segment_heatmap(places(spark, sf), ENDS, [0, 2], BOX, 32, shape="leaderarc", low=4, high=1024, leader=8)


@query(
    "SELECT vec_id, round(sqrt((e2 - e0) * (e2 - e0) + (e3 - e1) * (e3 - e1)), 9) AS chord, round(abs((e3 - e1) * 0.0 + (e0 - e2) * 0.0 - (e0 * e3 - e2 * e1)) / sqrt((e3 - e1) * (e3 - e1) + (e0 - e2) * (e0 - e2)), 9) AS to_origin, "
    "CASE WHEN e0 = 0 AND e1 = 0 THEN 0 WHEN e0 >= 0 AND e1 > 0 THEN CASE WHEN e1 > e0 THEN 1 ELSE 0 END WHEN e0 < 0 AND e1 >= 0 THEN CASE WHEN -e0 > e1 THEN 3 ELSE 2 END WHEN e0 <= 0 AND e1 < 0 THEN CASE WHEN -e1 > -e0 THEN 5 ELSE 4 END WHEN e0 > -e1 THEN 7 ELSE 6 END AS octant, "
    f"round(sqrt((e2 - e0) * (e2 - e0) + (e3 - e1) * (e3 - e1)) / 2 / sin(pi() / 6), 9) AS radius FROM {PLACES_SQL}"
)
def geometry_functions(spark, sf):
    p = places(spark, sf)
    x1, y1, x2, y2 = (F.col(c) for c in ENDS)
    line = geometry.Line.through(x1, y1, x2, y2)
    return p.select("vec_id", F.round(geometry.distance(x1, y1, x2, y2), 9).alias("chord"), F.round(line.to_point(F.lit(0.0), F.lit(0.0)), 9).alias("to_origin"), geometry.octant(x1, y1).alias("octant"), F.round(geometry.arc_radius(x1, y1, x2, y2, geometry.THIRD), 9).alias("radius"))


# Addresses made of numbers.


def _address(key: Column) -> Column:
    return F.concat_ws(".", *[F.pmod(F.floor(key * k), F.lit(256)).cast("string") for k in (7, 13, 29, 101)])


def _address_sql(key: str) -> str:
    return "concat_ws('.', " + ", ".join(f"(({key} * {k}) % 256)::VARCHAR" for k in (7, 13, 29, 101)) + ")"


def _z_sql(key: str, odd: int) -> str:
    parts = [f"(({key} * {k}) % 256)" for k in (7, 13, 29, 101)]
    half = lambda p: "(" + " + ".join(f"((({p} >> {2 * i + odd}) & 1) << {i})" for i in range(4)) + ")"
    return "(" + " + ".join(f"{half(p)} * {16 ** (3 - i)}" for i, p in enumerate(parts)) + ")::DOUBLE / 65536"


@query(f"SELECT o_orderkey, {_address_sql('o_orderkey')} AS address, {_z_sql('o_orderkey', 0)} AS x, {_z_sql('o_orderkey', 1)} AS y FROM orders")
def zorder(spark, sf):
    o = _t(spark, sf, "orders").select("o_orderkey", _address(F.col("o_orderkey")).alias("address"))
    x, y = ip.to_point(F.col("address"))
    return o.select("o_orderkey", "address", x.alias("x"), y.alias("y"))


@query(cells_sql(points_sql(f"(SELECT {_z_sql('o_orderkey', 0)} AS x, {_z_sql('o_orderkey', 1)} AS y FROM orders)", "x", "y", [0, 2, 4], 16, Cartesian())))
def ip_heatmap(spark, sf):
    o = _t(spark, sf, "orders").select(_address(F.col("o_orderkey")).alias("address"))
    return tiling.ip_heatmap(o, "address", [0, 2, 4], 16)


_IP_ENDS = ends_sql(f"(SELECT {_z_sql('o_orderkey', 0)} AS x1, {_z_sql('o_orderkey', 1)} AS y1, {_z_sql('o_custkey', 0)} AS x2, {_z_sql('o_custkey', 1)} AS y2 FROM orders)", [0, 1], 32, "x1", "y1", "x2", "y2", 0.0, 1.0)


@query(tiles_sql(walk_sql(_IP_ENDS, f"{_LENGTH} BETWEEN 16 AND 1048576"), 32))
def ip_segment(spark, sf):
    o = _t(spark, sf, "orders").select(_address(F.col("o_orderkey")).alias("a"), _address(F.col("o_custkey")).alias("b"))
    return segments.ip_segments(o, "a", "b", [0, 1], 32, low=4, high=1024)


@query("SELECT c_custkey, to_hex(c_custkey % 4096) || ':' || to_hex((c_custkey * 31) % 65536) || CASE WHEN c_custkey % 3 = 0 THEN ':1:2:3:4' WHEN c_custkey % 3 = 1 THEN '::' ELSE ':1:2' END AS address, CASE WHEN c_custkey % 3 < 2 THEN (c_custkey % 4096)::BIGINT ELSE -1 END AS first, CASE WHEN c_custkey % 3 < 2 THEN ((c_custkey * 31) % 65536)::BIGINT ELSE -1 END AS second, CASE c_custkey % 3 WHEN 0 THEN 4 WHEN 1 THEN 0 ELSE -1 END::BIGINT AS last FROM customer")
def ipv6_parse(spark, sf):
    c = F.col("c_custkey")
    tail = F.when(c % 3 == 0, ":1:2:3:4").when(c % 3 == 1, "::").otherwise(":1:2")
    a = _t(spark, sf, "customer").select("c_custkey", F.concat(F.hex(c % 4096), F.lit(":"), F.hex((c * 31) % 65536), tail).alias("address"))
    six = ip.v6(F.col("address"))
    part = lambda i, name: F.coalesce(F.element_at(six, i), F.lit(-1).cast("long")).alias(name)
    return a.select("c_custkey", "address", part(1, "first"), part(2, "second"), part(6, "last"))


# Values of bins spread and encoded.


def blur_sql(cells: str, radius: int, sigma: float, bins: int, time: str = "") -> str:
    weights = ", ".join(f"({u}, {v}, {w!r}::DOUBLE)" for u, v, w in blur.kernel(radius, sigma))
    return f"""SELECT z, floor(x::DOUBLE / {bins})::INT AS tx, (pow(2, z) - 1 - floor(y::DOUBLE / {bins}))::INT AS ty, (((x % {bins}) + {bins}) % {bins})::INT AS bin_x, (((y % {bins}) + {bins}) % {bins})::INT AS bin_y{time}, round(sum(value), 6) AS value
FROM (SELECT z{time}, tx::BIGINT * {bins} + bin_x + u AS x, (pow(2, z)::BIGINT - 1 - ty) * {bins} + bin_y + v AS y, value * w AS value FROM ({cells}), (VALUES {weights}) k(u, v, w))
GROUP BY z{time}, x, y"""


@query(blur_sql(cells_sql(PLACE_POINTS), 1, 3.0, 32))
def blur2d(spark, sf):
    return blur.blur(heatmap_mercator(spark, sf), 1, 3.0, 32).withColumn("value", F.round("value", 6))


@query(blur_sql(ORACLE_SQL["time_heatmap"], 2, 1.5, 8, ", bin_t"))
def blur3d(spark, sf):
    return blur.blur(time_heatmap(spark, sf), 2, 1.5, 8).withColumn("value", F.round("value", 6))


@query(f"SELECT DISTINCT z, tx, ty, lpad(z::VARCHAR, 2, '0') || '/' || lpad(tx::VARCHAR, length(pow(2, z)::BIGINT::VARCHAR)::INT, '0') || '/' || lpad(ty::VARCHAR, length(pow(2, z)::BIGINT::VARCHAR)::INT, '0') || '.bin' AS name FROM {PRICE_POINTS}")
def row_id(spark, sf):
    return heatmap_cartesian(spark, sf).select(*TILE).distinct().withColumn("name", grid.row_id(F.col("z"), F.col("tx"), F.col("ty"), "", "/", ".bin"))


@query(
    f"""SELECT z, tx, ty, '[' || string_agg('{{"binIndex": ' || p || ', "topics": {{' || o || '}}}}', ',' ORDER BY p) || ']' AS payload
FROM (SELECT z, tx, ty, bin_x + bin_y * 1 AS p, string_agg('"' || term || '": ' || n, ', ' ORDER BY n DESC, term) AS o
      FROM (SELECT *, row_number() OVER (PARTITION BY z, tx, ty, bin_x, bin_y ORDER BY n DESC, term) AS r FROM (SELECT z, tx, ty, bin_x, bin_y, term, count(*) AS n FROM (SELECT {_BIN_SQL}, unnest(w) AS term FROM {TEXT_POINTS}) GROUP BY ALL)) WHERE r <= 5 GROUP BY z, tx, ty, bin_x, bin_y)
GROUP BY z, tx, ty"""
)
def encode_scores_json(spark, sf):
    return codec.scores(topics.topics(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2], 5, words=True), 1)


@query(f"SELECT z, tx, ty, 0 AS bin, term, n::INT AS n FROM (SELECT *, row_number() OVER (PARTITION BY z, tx, ty ORDER BY n DESC, term) AS r FROM {_COUNTS_SQL}) WHERE r <= 5")
def decode_scores_json(spark, sf):
    return codec.from_scores(encode_scores_json(spark, sf), 1)


def _tfidf(spark, sf):
    return topics.tfidf(_counted(spark, sf), 5).withColumn("score", F.round("score", 3))


_TFIDF_SQL = f"""(
SELECT z, tx, ty, term, round(score, 3) AS score, r FROM (
    SELECT c.z, tx, ty, c.term, (1.0::DOUBLE + ln(n)) * ln(1.0::DOUBLE + docs::DOUBLE / df) AS score, row_number() OVER (PARTITION BY c.z, tx, ty ORDER BY (1.0::DOUBLE + ln(n)) * ln(1.0::DOUBLE + docs::DOUBLE / df) DESC, c.term) AS r
    FROM {_COUNTS_SQL} c JOIN ({dictionary_sql()}) d ON c.z = d.z AND c.term = d.term)
WHERE r <= 5)"""


@query(f"""SELECT z, tx, ty, '{{' || string_agg('"' || term || '": ' || score, ', ' ORDER BY r) || '}}' AS payload FROM {_TFIDF_SQL} GROUP BY z, tx, ty""")
def encode_tile_scores(spark, sf):
    return codec.tile_scores(_tfidf(spark, sf))


@query(f"SELECT z, tx, ty, term, score FROM {_TFIDF_SQL}")
def decode_tile_scores(spark, sf):
    return codec.from_tile_scores(codec.tile_scores(_tfidf(spark, sf)))


# A whole number as the eight bytes of a double, the last ones first.
_BYTES_SQL = " || ".join(f"substr(h, {k}, 2)" for k in range(15, 0, -2))


@query(
    f"""WITH cells AS (SELECT z, tx, ty, bin_x + bin_y * 16 AS p, value::BIGINT AS v, length(ltrim(bin(value::BIGINT), '0')) - 1 AS e FROM ({cells_sql(PRICE_POINTS)})),
coded AS (SELECT z, tx, ty, p, lpad(upper(to_hex(((e + 1023)::BIGINT << 52) + ((v - (1::BIGINT << e)) << (52 - e)))), 16, '0') AS h FROM cells),
every AS (SELECT * FROM (SELECT DISTINCT z, tx, ty FROM cells), (SELECT unnest(range(256)) AS p))
SELECT z, tx, ty, string_agg(coalesce({_BYTES_SQL}, repeat('0', 16)), '' ORDER BY p) AS payload FROM every LEFT JOIN coded USING (z, tx, ty, p) GROUP BY z, tx, ty"""
)
def encode_dense(spark, sf):
    return codec.dense(heatmap_cartesian(spark, sf), 16).withColumn("payload", F.hex("payload"))


@query(f"SELECT z, tx, ty, bin_x, bin_y, 0 AS bin_t, value FROM ({cells_sql(PRICE_POINTS)})")
def decode_dense(spark, sf):
    return codec.from_dense(codec.dense(heatmap_cartesian(spark, sf), 16), 16)


@query(f"SELECT z, tx, ty, bin_x, bin_y, tx::BIGINT * 16 + bin_x AS ux, (pow(2, z)::BIGINT - 1 - ty) * 16 + bin_y AS uy FROM ({cells_sql(PRICE_POINTS)})")
def universal_bin_roundtrip(spark, sf):
    ux, uy = grid.universal(F.col("z"), F.col("tx"), F.col("ty"), F.col("bin_x"), F.col("bin_y"), 16)
    flat = heatmap_cartesian(spark, sf).select("z", ux.alias("ux"), uy.alias("uy"))
    return flat.withColumns(grid.tiled(F.col("z"), F.col("ux"), F.col("uy"), 16))


@query("SELECT o_orderkey::INT AS key, o_totalprice::DOUBLE AS price, 'order ' || o_orderkey AS name FROM orders WHERE o_orderkey % 5 > 1")
def csv_parse_drop_malformed(spark, sf):
    key = F.col("o_orderkey")
    line = F.concat_ws(",", F.when(key % 5 == 0, "x").otherwise(key.cast("string")), F.col("o_totalprice").cast("string"), F.concat(F.lit('" order '), key.cast("string"), F.lit(' "')), F.when(key % 5 == 1, "more"))
    declared = schemas.schema({"key": {"type": "int", "index": 0}, "price": {"type": "double", "index": 1}, "name": {"type": "string", "index": 2}})
    out = tables.parse_lines(_t(spark, sf, "orders").select(line.alias("value")), declared)
    return out.withColumn("name", F.trim("name"))


@query()
def lda_topics_tile(spark, sf):
    return lda.topics(_counted(spark, sf), 4, 5, 2, iterations=5)


@query()
def lda_words_tile(spark, sf):
    return lda.words(_counted(spark, sf), 4, 5, 2, iterations=5)


@query(f"SELECT z, tx, ty, bin_x, bin_y, round(ln(1.0::DOUBLE + value) + z, 6) AS value FROM ({cells_sql(PRICE_POINTS)})")
def tile_transformation(spark, sf):
    return topics.transformed(heatmap_cartesian(spark, sf), F.round(F.log(1.0 + F.col("value")) + F.col("z"), 6))


@query(f"SELECT z, tx, ty, 2::BIGINT AS topics, true AS falling, true AS shares FROM (SELECT DISTINCT z, tx, ty FROM {_COUNTS_SQL})")
def lda_topics_invariants(spark, sf):
    """Of every tile: as many topics as asked for, the strongest first, with shares that are no more than a whole."""
    per = lda_topics_tile(spark, sf).groupBy(*TILE).agg(F.count("*").alias("topics"), F.sort_array(F.collect_list(F.struct("rank", "score"))).alias("s"), F.sum("score").alias("total"), F.min("score").alias("least"))
    return per.select(*TILE, "topics", (F.element_at("s.score", 1) >= F.element_at("s.score", 2)).alias("falling"), ((F.col("total") <= 1 + 1e-9) & (F.col("least") > 0)).alias("shares"))


# Projections and spreading of one's own.


class Crosses:
    """A point on a grid, and its neighbours to the right and above with half its weight, where the level has them."""

    def places(self, z: Column, bins: int) -> Column:
        x, y, side = F.col("cx"), F.col("cy"), F.call_function("shiftleft", F.lit(1), z) * bins
        shifted = lambda c: F.shiftright(F.least(c * side, F.lit(1023 * 64)), 10)
        at = lambda dx, dy, w: F.struct(*[f.alias(n) for n, f in zip(("ux", "uy"), (shifted(x) + dx, shifted(y) + dy))], F.lit(w).alias("share"))
        inside = F.filter(F.array(at(0, 0, 1.0), at(1, 0, 0.5), at(0, 1, 0.5)), lambda p: (p["ux"] < side) & (p["uy"] < side))
        whole = lambda c: F.call_function("div", c, F.lit(bins)).cast("int")
        rest = lambda c: F.pmod(c, F.lit(bins)).cast("int")
        return F.transform(inside, lambda p: F.struct(whole(p["ux"]).alias("tx"), whole(p["uy"]).alias("ty"), rest(p["ux"]).alias("bin_x"), (bins - 1 - rest(p["uy"])).cast("int").alias("bin_y"), p["share"].alias("share")))


@query(
    """SELECT z, (ux // 8)::INT AS tx, (uy // 8)::INT AS ty, (ux % 8)::INT AS bin_x, (7 - uy % 8)::INT AS bin_y, sum(w) AS value
FROM (SELECT z, (least((o_custkey % 1024) * (1 << z) * 8, 65472) >> 10) + dx AS ux, (least((o_orderkey % 1024) * (1 << z) * 8, 65472) >> 10) + dy AS uy, w
      FROM orders, (SELECT unnest([0, 1, 2]) AS z), (VALUES (0, 0, 1.0::DOUBLE), (1, 0, 0.5::DOUBLE), (0, 1, 0.5::DOUBLE)) k(dx, dy, w))
WHERE ux < (1 << z) * 8 AND uy < (1 << z) * 8 GROUP BY ALL"""
)
def projection_one_to_many(spark, sf):
    rows = _t(spark, sf, "orders").select(F.pmod("o_custkey", F.lit(1024)).alias("cx"), F.pmod("o_orderkey", F.lit(1024)).alias("cy"))
    return tiling.binned(rows, Crosses(), "cx", "cy", [0, 1, 2], 8, [F.sum("share").alias("value")])


@query(
    f"""SELECT z, floor(x::DOUBLE / 32)::INT AS tx, (pow(2, z) - 1 - floor(y::DOUBLE / 32))::INT AS ty, (((x % 32) + 32) % 32)::INT AS bin_x, (((y % 32) + 32) % 32)::INT AS bin_y, sum(value) AS value
FROM (SELECT z, tx::BIGINT * 32 + bin_x + u AS x, (pow(2, z)::BIGINT - 1 - ty) * 32 + bin_y AS y, value / 2 AS value FROM ({cells_sql(PLACE_POINTS)}), (SELECT unnest([0, 1, 2]) AS u) WHERE u < 1 + value)
GROUP BY z, x, y"""
)
def spread_by_value(spark, sf):
    """Half a bin's value to itself and to the right, the farther the larger it is."""
    reach = F.transform(F.sequence(F.lit(0), F.least(F.col("value"), F.lit(2.0)).cast("int")), lambda u: F.struct(u.alias("dx"), F.lit(0).alias("dy"), (F.col("value") / 2).alias("value")))
    return blur.spread(heatmap_mercator(spark, sf), reach, 32)


@query(
    f"""SELECT z, tx, ty, bin_x, bin_y, string_agg(term || '=' || n, '|' ORDER BY r) AS topics
FROM (SELECT *, row_number() OVER (PARTITION BY z, tx, ty, bin_x, bin_y ORDER BY n DESC, term) AS r FROM (SELECT z, tx, ty, bin_x, bin_y, term, count(*) AS n FROM (SELECT {_BIN_SQL}, unnest(w) AS term FROM {points_sql(TEXTS_SQL, "x", "y", [0, 1, 2], 1, GRID, "list_filter(list_transform(regexp_extract_all(text, '[\\p{L}\\p{Nd}_]+|[^\\p{L}\\p{Nd}_]+'), lambda t: trim(t)), lambda t: t <> '') AS w")}) GROUP BY ALL))
WHERE r <= 8 GROUP BY z, tx, ty, bin_x, bin_y"""
)
def topics_of_texts(spark, sf):
    """Terms by splitting at the edges of words."""
    found = topics.topics(texts(spark, sf), "x", "y", "text", GRID, [0, 1, 2], 8)
    return found.select(*BIN, F.array_join(F.transform("topics", lambda t: F.concat(t["term"], F.lit("="), t["n"].cast("string"))), "|").alias("topics"))
