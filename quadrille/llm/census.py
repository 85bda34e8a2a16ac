"""A census: in how many documents of the corpus each name of each document occurs, told to the document.

Names are 64-bit hashes that texts are given chunk by chunk. A chunk's names are
sorted, cut by ranges of the name space and sent as packed differences, about
four bytes a name; a range holds all occurrences of its names, counts them and
answers with one byte for each, in the order in which they came. The chunk,
whose texts travel along compressed, makes its names anew and lines the answers
up with them. So nothing but the answers has to name a document, and no step
needs a table of the corpus's names.

Two names count as one if they agree in their first 48 bits; what relies on a
name that it is not unique verifies that otherwise.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.cluster import batches, partitions

#: Bytes of text in a chunk, unless a single text is longer.
CHUNK = 4 << 20
#: Bytes of input whose names are counted together in one worker.
RANGE = 4 << 20
#: Counts above this are told as this.
MOST = 255

U64 = np.uint64
#: part -1 - i: texts of a chunk, on their way; part i: names of the range i.
_SENT = pa.schema([("part", pa.int32()), ("chunk", pa.int64()), ("range", pa.int32()), ("payload", pa.binary())])
SENT = "part int, chunk long, range int, payload binary"
TOLD = "chunk long, range int, payload binary"

#: Takes the bytes and offsets of the texts and returns text numbers and names, each pair once.
Namer = Callable[[np.ndarray, np.ndarray], tuple[np.ndarray, np.ndarray]]


def pack(values: np.ndarray) -> bytes:
    """Ascending 48-bit numbers as compressed differences."""
    steps = np.diff(values, prepend=U64(0)).astype("<u8")
    planes = np.ascontiguousarray(steps.view(np.uint8).reshape(-1, 8)[:, :6].T)
    return zstandard.compress(planes.tobytes(), 1)


def unpack(payload: bytes) -> np.ndarray:
    planes = np.frombuffer(zstandard.decompress(payload), np.uint8).reshape(6, -1)
    steps = np.zeros((planes.shape[1], 8), np.uint8)
    steps[:, :6] = planes.T
    return np.cumsum(steps.reshape(-1).view("<u8"), dtype=U64)


def order(name: np.ndarray) -> np.ndarray:
    """The order in which a chunk sends its names and gets the answers."""
    return np.argsort(name >> U64(16), kind="stable")


def ranges(name: np.ndarray, at: np.ndarray, chunk: int, parts: int) -> Iterator[tuple[int, int, int, bytes]]:
    """The rows that send the names, in the given order."""
    value = name[at] >> U64(16)
    part = (((value >> U64(16)) * U64(parts)) >> U64(32)).astype(np.int64)
    cut = np.searchsorted(part, np.arange(parts + 1))
    for p in range(parts):
        if cut[p] < cut[p + 1]:
            yield p, chunk, p, pack(value[cut[p] : cut[p + 1]])


def batch_of(rows: list[tuple], schema: pa.Schema = _SENT) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows) if rows else [[]] * len(schema), schema)], schema=schema)


def freeze(batch: pa.RecordBatch) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, batch.schema, options=pa.ipc.IpcWriteOptions(compression="zstd")) as out:
        out.write_batch(batch)
    return sink.getvalue().to_pybytes()


def thaw(payload: bytes) -> pa.Table:
    with pa.ipc.open_stream(payload) as stream:
        return stream.read_all()


def _send(batches_: Iterator[pa.RecordBatch], names: Namer, parts: int) -> Iterator[pa.RecordBatch]:
    task, seq = TaskContext.get().partitionId(), 0
    for chunk in gathered(batches_):
        key = (task << 32) | seq
        seq += 1
        _, name = names(*X.utf8(chunk.column("text")))
        rows = [(-1 - key % parts, key, -1, freeze(chunk))]
        rows += ranges(name, order(name), key, parts)
        for i in range(0, len(rows), 64):
            yield batch_of(rows[i : i + 64])


def gathered(batches_: Iterator[pa.RecordBatch], size: int = CHUNK) -> Iterator[pa.RecordBatch]:
    """The rows of the batches in runs of about the given number of bytes of text."""
    held: list[pa.RecordBatch] = []
    bytes_ = 0
    for batch in batches_:
        column = batch.schema.get_field_index("text")
        for lo, hi, data, _ in X.chunks(batch.column(column), size):
            if held and bytes_ + len(data) > size:
                yield _joined(held)
                held, bytes_ = [], 0
            held.append(batch.slice(lo, hi - lo))
            bytes_ += len(data)
    if held:
        yield _joined(held)


def _joined(held: list[pa.RecordBatch]) -> pa.RecordBatch:
    return pa.Table.from_batches(held).combine_chunks().to_batches()[0]


def tally(table: pa.Table) -> pa.Table:
    """Answers the rows of one range; rows with texts pass."""
    chunk, rng, payload = (table.column(c).to_pylist() for c in ("chunk", "range", "payload"))
    if rng and rng[0] >= 0:
        values = [unpack(p) for p in payload]
        every = np.concatenate(values)
        at = np.argsort(every)
        ordered = every[at]
        starts = np.flatnonzero(np.concatenate(([True], ordered[1:] != ordered[:-1])))
        size = np.diff(np.append(starts, len(ordered)))
        count = np.empty(len(every), np.uint8)
        count[at] = np.repeat(np.minimum(size, MOST).astype(np.uint8), size)
        payload = [zstandard.compress(c.tobytes(), 1) for c in np.split(count, np.cumsum([len(v) for v in values])[:-1])]
    return pa.table({"chunk": pa.array(chunk, pa.int64()), "range": pa.array(rng, pa.int32()), "payload": pa.array(payload, pa.binary())})


def answers(table: pa.Table) -> tuple[bytes, np.ndarray]:
    """The frozen texts of a chunk and the counts of its names, in order()."""
    found = sorted(zip(table.column("range").to_pylist(), table.column("payload").to_pylist()))
    counts = [np.frombuffer(zstandard.decompress(p), np.uint8) for r, p in found if r >= 0]
    return found[0][1], np.concatenate(counts) if counts else np.zeros(0, np.uint8)


def parts_for(df: DataFrame) -> int:
    """Into how many ranges names are cut: as many as the session has partitions, and so many more that a range's share of the input, by Spark's estimate, is no larger than RANGE bytes."""
    size = int(str(df._jdf.queryExecution().optimizedPlan().stats().sizeInBytes()))
    # What Spark cannot estimate counts as larger than anything.
    return max(partitions(df.sparkSession), -(-size // RANGE) if size < 1 << 60 else 1)


def sent(df: DataFrame, names: Namer, parts: int) -> DataFrame:
    """The rows of df, which has a column text without nulls, on their way to the count."""
    batches(df.sparkSession)
    return df.mapInArrow(lambda b: _send(b, names, parts), SENT)


def _tallied(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """tally() of each range, in the order of ranges; texts come first and pass."""
    held: list[pa.RecordBatch] = []
    now = -1
    for batch in batches_:
        part = batch.column(0).to_numpy()
        cuts = np.flatnonzero(np.diff(part)) + 1
        for lo, hi in zip([0, *cuts], [*cuts, len(part)]):
            own = batch.slice(lo, hi - lo)
            if hi == lo or part[lo] < 0:
                yield own.select([1, 2, 3])
                continue
            if held and part[lo] != now:
                yield from tally(pa.Table.from_batches(held)).to_batches()
                held = []
            held.append(own)
            now = part[lo]
    if held:
        yield from tally(pa.Table.from_batches(held)).to_batches()


def told(rows: DataFrame) -> DataFrame:
    """The answers to what was sent, to be grouped by chunk. Ranges are dealt to tasks by turns, so that none gets more than another."""
    tasks = partitions(rows.sparkSession)
    slot = F.pmod(F.when(F.col("part") >= 0, F.col("part")).otherwise(-1 - F.col("part")), F.lit(tasks)).cast("int")
    return rows.repartitionById(tasks, slot).sortWithinPartitions("part").mapInArrow(_tallied, TOLD)
