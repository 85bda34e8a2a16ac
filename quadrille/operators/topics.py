"""Words of tiles and bins: counts, the most frequent ones, and TF-IDF."""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import LongType, StringType

from quadrille.functions import grid, text
from quadrille.functions.grid import TimeRange
from quadrille.operators.tiling import BIN, TILE, rolled_up, rolls_up
from quadrille.shelf import batches

#: Counts that a task holds before it passes them on.
_HELD = 1 << 18


def _listed(counters: dict[tuple, Counter], schema: pa.Schema) -> pa.RecordBatch:
    of = pa.array(np.repeat(np.arange(len(counters)), [len(c) for c in counters.values()]))
    keys = [pa.array(k, schema.field(i).type).take(of) for i, k in enumerate(zip(*counters))]
    terms = pa.array([t for c in counters.values() for t in c], pa.string())
    return pa.RecordBatch.from_arrays([*keys, terms, pa.array([n for c in counters.values() for n in c.values()], pa.int64())], schema=schema)


def _tallied(arrived: Iterator[pa.RecordBatch], terms: list[str], stop: list[str]) -> Iterator[pa.RecordBatch]:
    """The counts of a task's words by the columns before the text. What is more than _HELD of them goes on in parts."""
    some, without, counters, schema = {t.encode() for t in terms}, [t.encode() for t in stop], {}, None

    def flushed() -> Iterator[pa.RecordBatch]:
        for c in counters.values():
            for t in without:
                c.pop(t, None)
        if any(counters.values()):
            yield _listed({k: c for k, c in counters.items() if c}, schema)
        counters.clear()

    for batch in arrived:
        *keys, texts = batch.columns
        schema = pa.schema([*[pa.field(batch.schema.names[i], k.type) for i, k in enumerate(keys)], ("term", pa.string()), ("n", pa.int64())])
        last, words = None, []
        for key, value in zip(zip(*(k.to_pylist() for k in keys)), texts.cast(pa.binary()).to_pylist()):
            if value is None:
                continue
            if value != last:  # a text comes once for each level
                last, words = value, text.found(value)
            if not some or not some.isdisjoint(words):
                counters.setdefault(key, Counter()).update(words)
        if sum(len(c) + 1 for c in counters.values()) > _HELD:
            yield from flushed()
    yield from flushed()


def _word_counts(df: DataFrame, x: str, y: str, column: str, projection, levels: list[int], bins: int, keys: list[str], tms: bool, terms: list[str] | None = None, stop: list[str] | None = None) -> DataFrame:
    """_counts of the words of texts. A task counts them as it splits the texts, so that there is a row for each of its bins and words, and none for each word of a text."""
    batches(df.sparkSession)
    rollup = rolls_up(levels, bins)
    rows = grid.point(df.withColumn("_text", F.col(column).cast("string")), projection, x, y, [max(levels)] if rollup else levels, bins, tms).select(*BIN, *keys, "_text")
    schema = rows.drop("_text").schema.add("term", StringType()).add("n", LongType())
    parts = rows.mapInArrow(lambda b: _tallied(b, terms or [], stop or []), schema)
    cells = parts.groupBy(*BIN, *keys, "term").agg(F.sum("n").alias("n"))
    return rolled_up(cells, levels, bins, [F.sum("n").alias("n")], [*keys, "term"], tms) if rollup else cells


def _counts(df: DataFrame, x: str, y: str, tokens: Column, projection, levels: list[int], bins: int, keys: list[str], tms: bool, stop: list[str] | None = None) -> DataFrame:
    """How often each term is in each bin. Counted first at the deepest level, so that few rows reach the crowded ones."""
    rollup = rolls_up(levels, bins)
    counts = lambda t: ~t.isin(stop) if stop else t.isNotNull()
    # Terms are told apart as rows: filters of array elements are not compiled. Where a row has one bin only, it is found before that.
    if rollup or len(levels) == 1:
        rows = grid.point(df, projection, x, y, [max(levels)], bins, tms).select(*BIN, *keys, F.explode(tokens).alias("term")).where(counts(F.col("term")))
    else:
        rows = grid.point(df.withColumn("term", F.explode(tokens)).where(counts(F.col("term"))), projection, x, y, levels, bins, tms)
    cells = rows.groupBy(*BIN, *keys, "term").agg(F.count("*").alias("n"))
    return rolled_up(cells, levels, bins, [F.sum("n").alias("n")], [*keys, "term"], tms) if rollup else cells


def _top(counted: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """The most frequent terms of each bin, of equally frequent ones the first in the alphabet, as lists in that order."""
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("n"), "term"))
    best = counted.withColumn("rank", rank).where(F.col("rank") <= limit)
    listed = best.groupBy(*keys).agg(F.sort_array(F.collect_list(F.struct("rank", "term", "n"))).alias("t"))
    return listed.select(*keys, F.transform("t", lambda t: F.struct(t["term"].alias("term"), t["n"].cast("int").alias("n"))).alias("topics"))


def _tokens(df: DataFrame, column: str) -> Column:
    return F.col(column) if dict(df.dtypes)[column].startswith("array") else text.split(F.col(column))


def topics(df: DataFrame, x: str, y: str, tokens: str, projection, levels: list[int], limit: int = 15, bins: int = 1, terms: list[str] | None = None, stop: list[str] | None = None, tms: bool = True, words: bool = False) -> DataFrame:
    """(z, tx, ty, bin_x, bin_y, topics): the most frequent terms of each bin.

    tokens: a list of terms, or a text. terms: only rows with one of these; stop: terms that do not count. Null
    lists and null terms count nothing. words: of a text, its words in lower case instead of what is between the edges of words.
    """
    if words:
        return _top(_word_counts(df, x, y, tokens, projection, levels, bins, [], tms, terms, stop), BIN, limit)
    has = _tokens(df, tokens)
    rows = df.where(text.has_any(has, terms or []))
    return _top(_counts(rows, x, y, has, projection, levels, bins, [], tms, stop), BIN, limit)


def time_topics(df: DataFrame, x: str, y: str, time: str, tokens: str, projection, times: TimeRange, levels: list[int], limit: int = 15, bins: int = 1, terms: list[str] | None = None, stop: list[str] | None = None, tms: bool = True) -> DataFrame:
    """As topics, for each bucket of time bin_t."""
    has, ms = _tokens(df, tokens), grid.millis(df, time)
    rows = df.where(times.inside(ms) & text.has_any(has, terms or [])).withColumn("bin_t", times.bucket(ms))
    return _top(_counts(rows, x, y, has, projection, levels, bins, ["bin_t"], tms, stop), [*BIN, "bin_t"], limit)


def term_counts(df: DataFrame, x: str, y: str, column: str, projection, levels: list[int], tms: bool = True) -> DataFrame:
    """(z, tx, ty, term, n): the words of the texts in each tile, in lower case, and how often they occur."""
    return _word_counts(df, x, y, column, projection, levels, 1, [], tms).select(*TILE, "term", "n")


def word_bags(df: DataFrame, x: str, y: str, column: str, projection, levels: list[int], tms: bool = True) -> DataFrame:
    """(z, tx, ty, words): the same as one map a tile."""
    return term_counts(df, x, y, column, projection, levels, tms).groupBy(*TILE).agg(F.map_from_entries(F.collect_list(F.struct("term", "n"))).alias("words"))


def _alike(counted: DataFrame, term: Column) -> DataFrame:
    """Conditions that always hold for counts. With them all that reads these has the same columns and filters, and so reads the same exchange."""
    return counted.where(term.isNotNull() & (F.col("n") > 0)) if "n" in counted.columns else counted.where(term.isNotNull())


def dictionary(counted: DataFrame, keys: list[str] | None = None, stop: list[str] | None = None, predefined: list[str] | None = None, least: float | None = None, most: float | None = None, features: int | None = None, case_sensitive: bool = False) -> DataFrame:
    """(keys..., term, df, docs): in how many documents, which are the tiles, each term is, and how many there are.

    least and most: shares of the documents, where they are at most 1, and else percentages; features: so many
    of the most frequent terms, of equally frequent ones the first in the alphabet.
    """
    keys = ["z"] if keys is None else keys
    term = F.col("term") if case_sensitive else F.lower("term")
    counted = _alike(counted, term)
    seen = counted.select(*keys, *[c for c in TILE if c not in keys], term.alias("term")).distinct()
    docs = seen.select(*keys, *[c for c in TILE if c not in keys]).distinct().groupBy(*keys).agg(F.count("*").alias("docs"))
    # These look at df, so that they stay above the exchange that docs reads as well.
    counts = F.lit(True)
    if stop:
        counts = counts & ~F.col("term").isin([s if case_sensitive else s.lower() for s in stop])
    if predefined is not None:
        counts = counts & F.col("term").isin([s if case_sensitive else s.lower() for s in predefined])
    # One row a level: the docs side has as many rows as there are levels, whatever the data.
    out = seen.groupBy(*keys, "term").agg(F.count("*").alias("df"))
    if stop or predefined is not None:
        out = out.where(F.when(F.col("df") > 0, counts))
    out = out.join(F.broadcast(docs), keys or None)
    share = lambda v: v if v <= 1 else v / 100.0
    if least is not None:
        out = out.where(F.col("df") >= F.lit(share(float(least))) * F.col("docs"))
    if most is not None:
        out = out.where(F.col("df") <= F.lit(share(float(most))) * F.col("docs"))
    if features is not None:
        rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("df"), "term"))
        out = out.withColumn("_r", rank).where(F.col("_r") <= features).drop("_r")
    return out


def tf(kind: str = "sublinear", k: float = 0.5) -> Column:
    """Term frequency of columns n, total and most: the term's count, and the sum and the largest of its document's."""
    n = F.col("n").cast("double")
    return {
        "binary": F.lit(1.0),
        "raw": n,
        "normalized": n / F.col("total"),
        "sublinear": 1.0 + F.log(n),
        "double-normalized": k + (1.0 - k) * n / F.col("most"),
    }[kind]


def idf(kind: str = "log-smooth") -> Column:
    """Inverse document frequency of columns docs and df."""
    n, df = F.col("docs").cast("double"), F.col("df").cast("double")
    return {
        "unary": F.lit(1.0),
        "linear": n / df,
        "log": F.log(n / df),
        "log-smooth": F.log(1.0 + n / df),
        "probabilistic": F.when(n > df, F.log((n - df) / df)),
    }[kind]


def tfidf(counted: DataFrame, words: int, tf_kind: str = "sublinear", idf_kind: str = "log-smooth", k: float = 0.5, descending: bool = True, **options) -> DataFrame:
    """(z, tx, ty, term, score, rank): the best terms of each tile, all levels at once.

    options: of dictionary(). Terms outside the dictionary do not count. A term with no probabilistic value has no score
    and comes last. descending=False keeps the lowest scores instead.
    """
    # The tile's own numbers come from a window over what the dictionary leaves; the dictionary is joined by level and term, as large as it may be.
    case = options.get("case_sensitive", False)
    if not case:  # once for all that reads the counts
        options |= {"case_sensitive": True} | {k: [w.lower() for w in options[k]] for k in ("stop", "predefined") if options.get(k) is not None}
    counted = counted.withColumn("term", F.col("term") if case else F.lower("term")).groupBy(*TILE, "term").agg(F.sum("n").alias("n"))
    counted = _alike(counted, F.col("term"))
    known = counted.join(dictionary(counted, **options), ["z", "term"])
    tile = Window.partitionBy(*TILE)
    scored = known.withColumns({"total": F.sum("n").over(tile), "most": F.max("n").over(tile)}).withColumn("score", tf(tf_kind, k) * idf(idf_kind))
    order = F.desc_nulls_last("score") if descending else F.asc_nulls_last("score")
    return scored.withColumn("rank", F.row_number().over(tile.orderBy(order, "term"))).where(F.col("rank") <= words).select(*TILE, "term", "score", "rank")


def transformed(cells: DataFrame, value: Column, name: str = "value") -> DataFrame:
    """Every bin's value replaced by an expression, which may use its tile and bin."""
    return cells.withColumn(name, value)
