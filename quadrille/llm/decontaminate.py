"""Benchmark decontamination: which documents hold a passage of a test item, be it edited.

Every word n-gram of the test items is a seed, however many documents have it. A pass over
the corpus finds the seeds, puts those of one item that are close to each other
together, leaves out passages whose words cannot reach the least score in any order, and
aligns the others with the item by Smith-Waterman. The score is the share of what a
full match would get.

The benchmark is the small side: it goes to the executors in slices of at most SLICE
bytes, each of which costs a pass over the corpus. No text is shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.cluster import batches, slim

U64 = np.uint64
#: Words of a seed.
N = 3
MATCH, MISMATCH, GAP = 2, -1, -1
#: The least score of a leak.
LEAST = 0.5
#: Bytes of benchmark text that are broadcast at once.
SLICE = 32 << 20
#: Cells of the tables that are filled at once.
CELLS = 1 << 22
#: Hits of seeds that are put together at once, or those of one document.
HITS = 1 << 21

_FOUND = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("score", pa.float64()), ("start_word", pa.int64()), ("end_word", pa.int64())])


class Index:
    """Words of the items, and for each of their n-grams, in ascending order, where it is."""

    def __init__(self, texts: pa.Array, n: int):
        owner, _, _, self.word = X.words(*X.utf8(texts))
        self.edge = np.searchsorted(owner, np.arange(len(texts) + 1))
        # An item of fewer than n words has no seeds of n words; its whole is matched by its first word.
        where, gram = X.grams(owner, self.word, n)
        at = np.argsort(gram, kind="stable")
        self.item, self.offset = owner[where[at]], where[at] - self.edge[owner[where[at]]]
        self.gram, self.first = np.unique(gram[at], return_index=True)
        self.first = np.append(self.first, len(at))
        self.bits = np.zeros(1 << 20, bool)
        self.bits[self.gram >> U64(44)] = True

    def find(self, gram: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Which of the n-grams are the benchmark's, and which ones these are."""
        near = np.flatnonzero(self.bits[gram >> U64(44)])
        place = np.searchsorted(self.gram, gram[near])
        hit = np.zeros(len(near), bool)
        inside = place < len(self.gram)
        hit[inside] = self.gram[place[inside]] == gram[near[inside]]
        return near[hit], place[hit]


def align(item: np.ndarray, passages: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Best local alignment of the item with each row of passages, and where it ends; zeros are no words."""
    rows, width = passages.shape
    slope = np.arange(width + 1, dtype=np.int32) * -GAP
    before = np.zeros((rows, width + 1), np.int32)
    best, end = np.zeros(rows, np.int32), np.zeros(rows, np.int64)
    for word in item:
        now = np.zeros_like(before)
        now[:, 1:] = before[:, :-1] + np.where(passages == word, MATCH, MISMATCH)
        np.maximum(now, before + GAP, out=now)
        np.maximum(now, 0, out=now)
        # A gap in the item may be of any length: a running maximum along the passage.
        now = np.maximum.accumulate(now + slope, axis=1) - slope
        at = now.argmax(axis=1)
        top = now[np.arange(rows), at]
        better = top > best
        best[better], end[better] = top[better], at[better]
        before = now
    return best, end


def bound(item: np.ndarray, passages: np.ndarray) -> np.ndarray:
    """At least the score that align() finds: words of the item that the passage has match, and each of the others between them costs one."""
    own, which = np.unique(item, return_inverse=True)
    place = np.minimum(np.searchsorted(own, passages), len(own) - 1)
    has = np.zeros((len(passages), len(own)), bool)
    row, column = np.nonzero(own[place] == passages)
    has[row, place[row, column]] = True
    total = np.zeros((len(passages), len(item) + 1), np.int64)
    np.cumsum(np.where(has[:, which], MATCH, max(MISMATCH, GAP)), axis=1, out=total[:, 1:])
    return (total - np.minimum.accumulate(total, axis=1)).max(axis=1)


def clusters(doc: np.ndarray, pos: np.ndarray, item: np.ndarray, offset: np.ndarray, length: np.ndarray, least: float) -> tuple[np.ndarray, ...]:
    """Document, item, first and last possible word of the passages around hits; hits of an item closer than it is long are of one passage."""
    start = pos - offset
    at = np.lexsort((start, item, doc))
    doc, item, start = doc[at], item[at], start[at]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (item[1:] != item[:-1]) | (start[1:] - start[:-1] > length[item[1:]])
    head = np.flatnonzero(new)
    tail = np.append(head[1:], len(doc)) - 1
    # A match of the least score has at most so many gaps.
    slack = np.ceil(length[item[head]] * MATCH * (1 - least) / -GAP).astype(np.int64)
    return doc[head], item[head], start[head] - slack, start[tail] + length[item[head]] + slack


def _parts(doc: np.ndarray, many: np.ndarray, most: int) -> Iterator[slice]:
    """Runs of n-grams of whole documents with at most so many hits, or of one document."""
    edge = np.append(np.flatnonzero(np.diff(doc, prepend=-1)), len(doc))
    upto = np.append(0, np.cumsum(many))[edge]
    i = 0
    while i < len(edge) - 1:
        j = max(i + 1, int(np.searchsorted(upto, upto[i] + most, side="right")) - 1)
        yield slice(edge[i], edge[j])
        i = j


def _pairs(texts: pa.Array, index: Index, n: int, least: float) -> Iterator[tuple[np.ndarray, ...]]:
    """Rows of texts, items, scores, first and last words of the best passages."""
    length = np.diff(index.edge)
    for lo, _, data, at in X.chunks(texts):
        doc, _, _, word = X.words(data, at)
        where, gram = X.grams(doc, word, n)
        near, place = index.find(gram)
        edge = np.searchsorted(doc, np.arange(len(at)))
        for part in _parts(doc[where[near]], index.first[place + 1] - index.first[place], HITS):
            own = index.first[place[part]]
            many = index.first[place[part] + 1] - own
            hit = np.repeat(where[near[part]], many)
            which = np.repeat(own - (np.cumsum(many) - many), many) + np.arange(many.sum())
            d, item, first, last = clusters(doc[hit], hit, index.item[which], index.offset[which], length, least)
            first, last = np.maximum(first, edge[d]), np.minimum(last, edge[d + 1])
            score, start, end = np.zeros(len(d)), np.zeros(len(d), np.int64), np.zeros(len(d), np.int64)
            by = np.lexsort((last - first, item))
            i = 0
            while i < len(by):
                of, j = item[by[i]], i + 1
                width = last[by[i]] - first[by[i]]
                while j < len(by) and item[by[j]] == of and (last[by[j]] - first[by[j]]) * (j + 1 - i) <= CELLS:
                    width = last[by[j]] - first[by[j]]
                    j += 1
                group = by[i:j]
                places = first[group][:, None] + np.arange(width)
                passages = np.where(places < last[group][:, None], word[np.minimum(places, len(word) - 1)], U64(0))
                words, full = index.word[index.edge[of] : index.edge[of + 1]], MATCH * length[of]
                able = bound(words, passages) / full >= least
                group, passages = group[able], passages[able]
                if len(group):
                    best, stop = align(words, passages)
                    # A match of this score spans no more words than the item and what it lost of the full score.
                    score[group], end[group] = best / full, first[group] + stop
                    start[group] = np.maximum(first[group], end[group] - length[of] - (full - best))
                i = j
            good = np.flatnonzero(score >= least)
            # The best passage of each document and item.
            good = good[np.lexsort((start[good], -score[good], item[good], d[good]))]
            one = np.ones(len(good), bool)
            one[1:] = (d[good][1:] != d[good][:-1]) | (item[good][1:] != item[good][:-1])
            good = good[one]
            begin = edge[d[good]]
            yield d[good] + lo, item[good], score[good], start[good] - begin, end[good] - begin


def _leaks(batches_: Iterator[pa.RecordBatch], index: Index, numbers: pa.Array, n: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        for row, item, score, start, end in _pairs(batch.column("text"), index, n, least):
            yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(row)), numbers.take(pa.array(item)), pa.array(np.round(score, 6)), pa.array(start, pa.int64()), pa.array(end, pa.int64())], schema=_FOUND)


def _clean(batches_: Iterator[pa.RecordBatch], text: int, index: Index, n: int, least: float) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        keep = np.ones(batch.num_rows, bool)
        for row, *_ in _pairs(batch.column(text), index, n, least):
            keep[row] = False
        yield batch.filter(pa.array(keep))


def _slices(benchmark: DataFrame, size: int) -> Iterator[DataFrame]:
    total = benchmark.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    count = -(-total // size)
    for i in range(count):
        yield benchmark.where(F.pmod(F.xxhash64("doc_id", "text"), F.lit(count)) == i) if count > 1 else benchmark


def _prepared(docs: DataFrame, items: DataFrame, n: int, slice_bytes: int) -> Iterator[tuple]:
    """For each slice of the items: the broadcast index, and the items' ids."""
    spark = docs.sparkSession
    batches(spark)
    for part in _slices(items.where("text IS NOT NULL"), slice_bytes):
        rows = part.orderBy("doc_id", "text").toArrow()
        yield spark.sparkContext.broadcast(Index(rows.column("text"), n)), rows.column("doc_id").combine_chunks()


def leaks(df: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, least: float = LEAST, slice_bytes: int = SLICE) -> DataFrame:
    """(doc_id, item_id, score, start_word, end_word): documents that hold an item, or an edited copy of it, with the best passage.

    score is the Smith-Waterman score (2 for equal words, -1 for different ones and for gaps) as a share of the
    item's full match; pairs below ``least`` are left out. The passage lies among the words from start_word on and
    ends before end_word. A word is a run of ASCII letters and digits or non-ASCII characters, ASCII letters in
    lower case. All pairs are found whose match has n words of the item together as they are, however many documents
    have them; edits that leave no n words together hide an item. Null and empty texts and items have no pairs, and
    neither do items of fewer than n words, for which a match would say nothing. Of equally good passages of an item the first counts. Null ids stay null; every row is a
    document, and every row of the benchmark an item, so repeated ones give repeated pairs. Empty tables give no rows.
    Other columns are not read.
    """
    docs = slim(df, id_col, text_col)
    schema = "doc_id long, item_id long, score double, start_word long, end_word long"
    found = []
    for index, ids in _prepared(docs, slim(benchmark, item_col, item_text), n, slice_bytes):
        found.append(docs.where("text IS NOT NULL").mapInArrow(lambda b, i=index, k=ids: _leaks(b, i.value, k, n, least), schema))
    return reduce(DataFrame.unionByName, found) if found else df.sparkSession.createDataFrame([], schema)


def clean(df: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text: str = "text", n: int = N, least: float = LEAST, slice_bytes: int = SLICE) -> DataFrame:
    """The rows of df, with all their columns, that leaks() finds no item in; rows with a null text stay."""
    docs = df.select(F.lit(None).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    at = df.columns.index(text_col)
    for index, _ in _prepared(docs, slim(benchmark, item_col, item_text), n, slice_bytes):
        df = df.mapInArrow(lambda b, i=index: _clean(b, at, i.value, n, least), df.schema)
    return df
