"""Tiles as bytes, and back."""

from __future__ import annotations

import json
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrille.functions import grid
from quadrille.operators.tiling import TILE


def _place(cells: DataFrame, bins: int) -> Column:
    return grid.linear(F.col("bin_x"), F.col("bin_y"), bins, F.col("bin_t") if "bin_t" in cells.columns else None)


#: Bytes of tiles that are made at once.
_AT_ONCE = 16 << 20


def _packed(batches: Iterator[pa.RecordBatch], size: int) -> Iterator[pa.RecordBatch]:
    for whole in batches:
        step = max(1, _AT_ONCE // (8 * size))
        for lo in range(0, whole.num_rows, step):
            batch = whole.slice(lo, step)
            lists = batch.column(3)
            at = lists.offsets.to_numpy()
            places, values = (lists.values.field(k).to_numpy()[at[0] : at[-1]] for k in range(2))
            tiles = np.zeros((batch.num_rows, size), "<f8")
            tiles[np.repeat(np.arange(batch.num_rows), np.diff(at)), places] = values
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array([t.tobytes() for t in tiles], pa.binary())], [*TILE, "payload"])


def dense(cells: DataFrame, bins: int, buckets: int = 1) -> DataFrame:
    """(z, tx, ty, payload): every bin of a tile as a little-endian double, rows of x, then y, then time; tiles of nothing but zeros go."""
    size = bins * bins * buckets
    listed = cells.where(F.col("value") != 0).select(*TILE, _place(cells, bins).cast("int").alias("p"), "value").groupBy(*TILE).agg(F.collect_list(F.struct("p", "value")).alias("c"))
    return listed.mapInArrow(lambda b: _packed(b, size), "z int, tx int, ty int, payload binary")


def _unpacked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for i, raw in enumerate(batch.column(3).to_pylist()):
            tile = np.frombuffer(raw or b"", "<f8")
            at = np.flatnonzero(tile)
            if len(at):
                yield pa.RecordBatch.from_arrays([*(pa.repeat(batch.column(k)[i], len(at)) for k in range(3)), pa.array(at, pa.int32()), pa.array(tile[at])], [*TILE, "p", "value"])


def from_dense(tiles: DataFrame, bins: int, payload: str = "payload") -> DataFrame:
    """(z, tx, ty, bin_x, bin_y, bin_t, value) of the bins that are not zero."""
    rows = tiles.select(*TILE, payload).mapInArrow(_unpacked, "z int, tx int, ty int, p int, value double")
    return rows.withColumns(grid.from_linear(F.col("p"), bins)).select(*TILE, "bin_x", "bin_y", "bin_t", "value")


def _text(term: Column) -> Column:
    """A JSON string."""
    return F.regexp_extract(F.to_json(F.struct(term.alias("t"))), r'(?s)^\{"t":(.*)\}$', 1)


def _object(entries: Column, name: str, score: str) -> Column:
    return F.concat(F.lit("{"), F.array_join(F.transform(entries, lambda e: F.concat(_text(e[name]), F.lit(": "), e[score].cast("string"))), ", "), F.lit("}"))


def scores(cells: DataFrame, bins: int, column: str = "topics", name: str = "term", score: str = "n") -> DataFrame:
    """(z, tx, ty, payload): a JSON list of the bins that have any terms, each with its place and its terms with counts, in the order of the list. Terms are escaped."""
    some = cells.where(F.size(column) > 0).select(*TILE, _place(cells, bins).alias("p"), _object(F.col(column), name, score).alias("o"))
    listed = some.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("p", "o"))).alias("b"))
    each = F.transform("b", lambda b: F.concat(F.lit('{"binIndex": '), b["p"].cast("string"), F.lit(', "topics": '), b["o"], F.lit("}")))
    return listed.select(*TILE, F.concat(F.lit("["), F.array_join(each, ","), F.lit("]")).alias("payload"))


def from_scores(tiles: DataFrame, bins: int, payload: str = "payload") -> DataFrame:
    """(z, tx, ty, bin, term, n) of what scores() wrote."""
    rows = tiles.select(*TILE, F.explode(F.from_json(F.col(payload).cast("string"), "array<struct<binIndex: int, topics: map<string, int>>>")).alias("b"))
    return rows.select(*TILE, F.col("b.binIndex").alias("bin"), F.explode("b.topics").alias("term", "n"))


def tile_scores(ranked: DataFrame, score: str = "score") -> DataFrame:
    """(z, tx, ty, payload): a JSON object of the terms of a tile with their scores, in the order of rank."""
    listed = ranked.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.struct("rank", "term", score))).alias("t"))
    return listed.select(*TILE, _object(F.col("t"), "term", score).alias("payload"))


def from_tile_scores(tiles: DataFrame, payload: str = "payload") -> DataFrame:
    """(z, tx, ty, term, score) of what tile_scores() wrote."""
    return tiles.select(*TILE, F.explode(F.from_json(F.col(payload).cast("string"), "map<string, double>")).alias("term", "score"))


def metadata(**entries) -> bytes:
    """JSON without the entries that are None."""
    return json.dumps({k: v for k, v in entries.items() if v is not None}).encode()
