"""Line dedup: which lines of each text are the first of their kind in the corpus.

Every line has a 128-bit fingerprint. A map task sends one row for each
distinct line of a chunk, its first there, so that a line which fills the
corpus costs a row a chunk. The rows are range-partitioned by fingerprint,
whose ranges are known beforehand because fingerprints are uniform, and sorted
by fingerprint, document and position; one streaming pass then keeps the first
row of every run. Only (document, position) travels back, sorted by document,
to become a run-length coded bitmap of the lines to keep as it passes: the
texts are never shuffled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.cluster import batches, partitions, slim, text_key

_BLANK = np.zeros(256, bool)
_BLANK[[9, 13, 32]] = True

#: A row that stands for a whole document: its position is -1 - its number of lines.
_LINES = pa.schema([("part", pa.int32()), ("h1", pa.int64()), ("h2", pa.int64()), ("always", pa.bool_()), ("doc_id", pa.int64()), ("key", pa.int64()), ("pos", pa.int32())])


def split(data: np.ndarray, at: np.ndarray, null: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of each line, and the number of lines of each text; a null text has none."""
    breaks = np.flatnonzero(data == 10)
    some = ~null
    starts = np.sort(np.concatenate((at[:-1][some], breaks + 1)))
    ends = np.sort(np.concatenate((at[1:][some], breaks)))
    count = np.bincount(np.searchsorted(at, breaks, side="right") - 1, minlength=len(null)) + some
    return np.repeat(np.arange(len(null)), count), starts, ends, count


def _candidates(batches_: Iterator[pa.RecordBatch], parts: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        ids, keys, texts = batch.column(0), batch.column(1), batch.column(2)
        key_all, null_all = keys.to_numpy(zero_copy_only=False), texts.is_null().to_numpy(zero_copy_only=False)
        id_all, no_id = ids.fill_null(0).to_numpy(zero_copy_only=False), ids.is_null().to_numpy(zero_copy_only=False)
        for lo, hi, data, at in X.chunks(texts):
            owner, start, end, count = split(data, at, null_all[lo:hi])
            pos = np.arange(len(owner)) - np.repeat(np.cumsum(count) - count, count)
            filled = np.concatenate(([0], np.cumsum(~_BLANK[data])))
            blank = filled[end] == filled[start]
            h1, h2 = X.fingerprints(data, start, end, lower=False), X.fingerprints(data, start, end, lower=False, second=True)
            number, key, missing = id_all[lo:hi], key_all[lo:hi], no_id[lo:hi]
            line = np.flatnonzero(~blank)
            o = owner[line]
            line = line[np.lexsort((pos[line], key[o], number[o], ~missing[o], h2[line], h1[line]))]
            new = np.ones(len(line), bool)
            new[1:] = (h1[line][1:] != h1[line][:-1]) | (h2[line][1:] != h2[line][:-1])
            line = line[new]
            bare = np.flatnonzero(blank)
            docs = np.arange(hi - lo)
            whole = X.mix(key[docs].view(X.U64) ^ X.mix(number[docs].view(X.U64)))
            a = np.concatenate((h1[line], whole[owner[bare]], whole))
            b = np.concatenate((h2[line], np.zeros(len(bare) + len(docs), X.U64)))
            who = np.concatenate((owner[line], owner[bare], docs))
            where = np.concatenate((pos[line], pos[bare], -1 - count))
            always = np.repeat([False, True], [len(line), len(bare) + len(docs)])
            part = ((a >> X.U64(32)) * X.U64(parts)) >> X.U64(32)
            # As signed numbers in the order of the unsigned ones, so that ranges of the one are ranges of the other.
            flip = X.U64(1 << 63)
            yield pa.RecordBatch.from_arrays(
                [pa.array(part.astype(np.int32)), pa.array((a ^ flip).view(np.int64)), pa.array((b ^ flip).view(np.int64)), pa.array(always), pa.array(number[who], mask=missing[who]), pa.array(key[who]), pa.array(where.astype(np.int32))],
                schema=_LINES,
            )


def _firsts(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    last = None
    for batch in batches_:
        h1, h2, always = batch.column(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy(zero_copy_only=False)
        keep, line = always.copy(), np.flatnonzero(~always)
        if len(line):
            a, b = h1[line], h2[line]
            new = np.ones(len(line), bool)
            new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
            new[0] = last != (a[0], b[0])
            last = (a[-1], b[-1])
            keep[line] = new
        yield batch.select([3, 4, 5]).filter(pa.array(keep))


def encode(flags: np.ndarray) -> str:
    """Lengths of the runs of kept and dropped lines by turns, kept first."""
    if not len(flags):
        return ""
    edges = np.flatnonzero(np.diff(flags.astype(np.int8))) + 1
    lengths = np.diff(np.concatenate(([0], edges, [len(flags)])))
    return ",".join(map(str, lengths if flags[0] else [0, *lengths]))


def decode(keep: str) -> np.ndarray:
    """The flags that encode() was given."""
    lengths = [int(x) for x in keep.split(",")] if keep else []
    return np.repeat(np.arange(len(lengths)) % 2 == 0, lengths)


def _bitmaps(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The bitmap of each document, of rows in the order of documents; one may have rows in several batches."""
    held: list[pa.RecordBatch] = []

    def bitmap(positions: list[np.ndarray]) -> tuple[int, int, str]:
        # The row that stands for the whole document may be there more than once.
        flags = np.zeros(-1 - min(int(p.min()) for p in positions), bool)
        for p in positions:
            flags[p[p >= 0]] = True
        return len(flags), int(flags.sum()), encode(flags)

    def coded(docs: list[pa.RecordBatch], bitmaps: list[tuple[int, int, str]]) -> pa.RecordBatch:
        ids, keys = (pa.concat_arrays([d.column(c) for d in docs]) for c in (0, 1))
        total, kept, keep = zip(*bitmaps)
        return pa.RecordBatch.from_arrays([ids, keys, pa.array(total, pa.int64()), pa.array(kept, pa.int64()), pa.array(keep, pa.string())], ["doc_id", "key", "n_lines", "n_kept", "keep"])

    def ended() -> pa.RecordBatch:
        return coded([held[0].slice(0, 1)], [bitmap([x.column(2).to_numpy() for x in held])])

    for batch in batches_:
        if not batch.num_rows:
            continue
        missing, number, key, pos = batch.column(0).is_null().to_numpy(zero_copy_only=False), batch.column(0).fill_null(0).to_numpy(), batch.column(1).to_numpy(), batch.column(2).to_numpy()
        if held and any(held[-1].column(c)[0] != batch.column(c)[0] for c in (0, 1)):
            yield ended()
            held = []
        cuts = np.flatnonzero((missing[1:] != missing[:-1]) | (number[1:] != number[:-1]) | (key[1:] != key[:-1])) + 1
        if not len(cuts):
            held.append(batch)
            continue
        first = 0
        if held:
            held.append(batch.slice(0, cuts[0]))
            yield ended()
            first, cuts = cuts[0], cuts[1:]
        starts = np.concatenate(([first], cuts))
        if len(starts) > 1:
            yield coded([batch.take(pa.array(starts[:-1]))], [bitmap([pos[lo:hi]]) for lo, hi in zip(starts[:-1], starts[1:])])
        held = [batch.slice(starts[-1])]
    if held:
        yield ended()


def _keyed(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    return slim(df, id_col, text_col).select("doc_id", text_key().alias("key"), "text")


def _kept(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    spark = df.sparkSession
    batches(spark)
    parts = partitions(spark)
    rows = _keyed(df, id_col, text_col).mapInArrow(lambda b: _candidates(b, parts), "part int, h1 long, h2 long, always boolean, doc_id long, key long, pos int")
    ordered = rows.repartitionById(parts, "part").sortWithinPartitions("h1", "h2", F.col("doc_id").asc_nulls_first(), "key", "pos")
    firsts = ordered.select("h1", "h2", "always", "doc_id", "key", "pos").mapInArrow(_firsts, "doc_id long, key long, pos int")
    # Sorted and not collected: lists of positions, built as objects, fill an executor's heap.
    return firsts.repartition("doc_id", "key").sortWithinPartitions("doc_id", "key").mapInArrow(_bitmaps, "doc_id long, key long, n_lines long, n_kept long, keep string")


def keep_bitmaps(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """For each document (doc_id, n_lines, n_kept, keep): keep is the run-length coded bitmap of its lines.

    Lines end at newlines and are compared byte by byte. The first occurrence, by document id and position, is
    kept; lines of nothing but spaces, tabs and carriage returns are always kept. A null text has no lines and
    an empty keep; an empty text has one blank line. A null id comes before all others; different texts under
    one id, or under none, are different documents, in the order of a hash of their text, and have a row each.
    Rows equal in id and text are one document, with one row. An empty table gives no rows. Other columns are
    not read.
    """
    return _kept(df, id_col, text_col).drop("key")


def _applied(batches_: Iterator[pa.RecordBatch], text: int, chars: int) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        own = batch.column(0)
        columns, names = own.flatten(), own.type.names
        texts, some = [], []
        for whole, coded in zip(columns[text].to_pylist(), batch.column(1).to_pylist()):
            left = [x for x, f in zip((whole or "").split("\n"), decode(coded or "")) if f]
            texts.append("\n".join(left))
            some.append(any(x.strip(" \t\r") for x in left))
        columns[text] = pa.array(texts, pa.string())
        if chars >= 0:
            columns[chars] = pa.array([len(x) for x in texts], pa.int64()).cast(columns[chars].type)
        yield pa.RecordBatch.from_arrays(columns, names).filter(pa.array(some))


def without_repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", chars_col: str | None = "n_chars") -> DataFrame:
    """The rows of df, whose texts have only their kept lines; rows left without any but blank lines go.

    chars_col, if df has it, gets the number of characters of the new text. Rows with a null text go. Rows equal
    in id and text keep the same lines.
    """
    names = df.columns
    side = _kept(df, id_col, text_col).select("doc_id", "key", "keep")
    own = df.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("own_id"), text_key(text_col).alias("own_key"))
    joined = own.join(side, F.col("own_id").eqNullSafe(F.col("doc_id")) & (F.col("own_key") == F.col("key"))).select("own", "keep")
    chars = names.index(chars_col) if chars_col in names else -1
    return joined.mapInArrow(lambda b: _applied(b, names.index(text_col), chars), df.schema)
