"""N-gram Jaccard join: documents whose sets of word n-grams are similar enough.

Prefixes in order of rarity. A census tells each document how many documents
hold each of its n-grams. A document is similar to another only if they share one of
its rarest n-grams: as many as its size lets differ, and one more. Those that
nobody else has come first, so that most documents are done with here. What is
left is collapsed into one representative of each distinct set.

Then token combinations: n-grams in up to RARE documents are indexed one
by one; the more frequent ones fall into classes by their hash and are indexed
as pairs within a class, for which the prefix is extended by one n-gram for
each class that it touches. A document with n n-grams covers
(rare ones) + sum over classes of max(0, (its n-grams there) - 1)
differences with a prefix, and the prefix ends once these exceed the number of
n-grams that may be missing from a similar document. The number of classes
follows the size of the smaller document of a pair, so that it stays far
below the size. Of two similar documents, the one whose prefix ends first finds
at least one rare n-gram or one pair of its prefix within the other's.

Two documents that meet in a rare n-gram are candidates if what both have after it
still suffices; their first common one never rules them out. Candidates
are verified where blocks of documents meet: representatives are numbered so that
near copies are neighbours, and a list of n-grams travels once for each block that has
candidates of its own, not once for each candidate.

Documents that are indexed under pairs of n-grams are called dense: what they have
is frequent, so that their candidates would grow with the square of the input.
They have blocks of their own, and a block is indexed as if it were one document,
once for each pair of n-grams that any of its documents has. Where two blocks meet
all their documents are compared at once, by a product of two matrices of zeros and
ones, and what is passed on is the number of links of each document and a forest that
connects the same, unless the pairs themselves are asked for.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import census
from quadrille.llm import text as X
from quadrille.llm.cluster import Shelf, partitions, slim, text_key

U64 = np.uint64
#: Words of an n-gram, and the least Jaccard similarity.
N, LEAST = 3, 0.5
#: Documents that may hold an n-gram which is indexed by itself; at most what a census tells apart.
RARE = 64
#: N-grams of a document per class of frequent n-grams, k, or up to twice as many: with the least similarity 1/2 a document of n frequent ones has
#: about n (1/2 + 1/k)^2 k / 2 pairs in each of the one or two divisions into classes that its size takes: n for 2, 1.1 n for 4, 1.6 n for 8 and
#: 8.5 n for 64, with a prefix that is n / k longer.
PER_CLASS = 4
#: Pairs that are made at once, and pairs that a task holds to find each once.
SLICE, HELD = 1 << 19, 1 << 21
#: Documents of one signature that are paired in one task; more are paired block by block, in a task for each two blocks.
HOT = 1 << 13
#: Documents of a block of neighbours, and their n-grams.
BLOCK, BLOCK_GRAMS = 128, 1 << 20
#: Set in the place of a dense document. The place of a dense block as a whole ends in WHOLE, which is no document's.
DENSE, WHOLE = 1 << 62, 255
#: N-grams of the documents of a dense block. 1 << SITE such blocks, or fewer with so many n-grams, travel together.
DENSE_GRAMS, SITE, SITE_GRAMS = 1 << 17, 4, 1 << 21
#: Columns of a matrix.
WIDE = 1 << 13

_LEFT = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n", pa.int32()), ("f1", pa.int64()), ("f2", pa.int64()), ("home", pa.int64()), ("dense", pa.bool_()), ("grams", pa.list_(pa.int64())), ("counts", pa.binary())])
_SIGNED = pa.schema([("sig", pa.int64()), ("before", pa.int64()), ("rid", pa.int64()), ("n", pa.int32()), ("pos", pa.int32())])
#: A pair of documents, or, with a block, a row of a signature with too many.
_MET = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("sig", pa.int64()), ("before", pa.int64()), ("n", pa.int32()), ("pos", pa.int32()), ("block", pa.int64())])
#: A dense block: its documents, with their n-grams as numbers, the n-grams that are numbered, and what the block is indexed under.
_TILE = pa.schema([("block", pa.int64()), ("docs", pa.binary()), ("names", pa.binary()), ("sigs", pa.list_(pa.int64()))])
#: A similar pair of dense documents; without similarity, an edge of a forest; without b, some of the links of a.
_LINKED = pa.schema([("a", pa.int64()), ("b", pa.int64()), ("jaccard", pa.float64()), ("near", pa.int64())])


def _sql(schema: pa.Schema) -> str:
    names = {pa.int64(): "long", pa.int32(): "int", pa.float64(): "double", pa.binary(): "binary", pa.bool_(): "boolean", pa.list_(pa.int64()): "array<long>"}
    return ", ".join(f"{f.name} {names[f.type]}" for f in schema)


def may_differ(n: np.ndarray | int, least: float) -> np.ndarray:
    """The most n-grams of n that a similar document may lack."""
    return (n - np.ceil(n * least - 1e-9)).astype(np.int64) if isinstance(n, np.ndarray) else n - math.ceil(n * least - 1e-9)


def _small(n: np.ndarray, least: float) -> np.ndarray:
    """So small that a single shared n-gram can be enough."""
    return (n * least <= 2) & (n - may_differ(n, least) < 2) | (n <= 2 / least)


def _left(table: pa.Table, n: int, least: float, rare: int) -> pa.Table:
    """The documents of a chunk; those that may be similar to another with their set's name and the n-grams that others share."""
    frozen, count = census.answers(table)
    texts = census.thaw(frozen)
    owner, gram = X.shingles(*X.utf8(texts.column("text")), n)
    df = np.empty(len(gram), np.uint8)
    df[census.order(gram)] = count
    docs = texts.num_rows
    size = np.bincount(owner, minlength=docs)
    alone = np.bincount(owner[df == 1], minlength=docs)
    stays = (size > 0) & (alone <= may_differ(size, least))
    names = []
    edge = np.searchsorted(owner, np.arange(docs + 1))
    for salt in (0x1234567, 0x89ABCDEF):
        total = np.concatenate((np.zeros(1, U64), np.cumsum(X.mix(gram ^ U64(salt)), dtype=U64)))
        names.append(pa.array(X.mix((total[edge[1:]] - total[edge[:-1]]) ^ X.mix(size.astype(U64))).view(np.int64), mask=~stays))
    keep = stays[owner] & (df > 1)
    shared = np.bincount(owner[keep], minlength=docs)
    few = np.bincount(owner[keep & (df <= rare)], minlength=docs)
    dense = _small(size, least) | (may_differ(size, least) + 1 - alone > few)
    at = np.concatenate(([0], np.cumsum(shared)))
    home = np.zeros(docs, U64)
    if stays.any():
        home[stays] = np.minimum.reduceat(X.mix(gram[keep]), at[:-1][stays])
    # As signed numbers in the order of the unsigned ones.
    home = pa.array((home ^ U64(1 << 63)).view(np.int64), mask=~stays)
    offsets = pa.array(at, pa.int32())
    lists = pa.ListArray.from_arrays(offsets, pa.array(gram[keep].view(np.int64)))
    counts = pa.Array.from_buffers(pa.binary(), docs, [None, offsets.buffers()[1], pa.py_buffer(df[keep].tobytes())])
    return pa.Table.from_arrays([texts.column("doc_id"), texts.column("key"), pa.array(size, pa.int32()), *names, home, pa.array(dense), lists, counts], schema=_LEFT)


def _single(gram: np.ndarray, salt: int) -> np.ndarray:
    return X.mix(gram ^ X.mix(np.array([salt], U64)))


def _combined(n: int, frequent: np.ndarray, need: int, least: float, per_class: int) -> np.ndarray:
    """The pairs of frequent n-grams, in the order of the prefix, that cover so many differences."""
    out = []
    for scheme in range(max(0, math.floor(math.log2(max(1, math.ceil(n * least - 1e-9))))), math.floor(math.log2(n)) + 1):
        classes = max(1, (1 << scheme) // per_class)
        of = X.mix(frequent ^ U64(0xC1A55 + scheme)) % U64(classes)
        by = np.argsort(of, kind="stable")
        first = np.zeros(len(frequent), bool)
        first[by[np.concatenate(([True], of[by][1:] != of[by][:-1]))]] = True
        end = int(np.searchsorted(np.cumsum(~first), need)) + 1
        for c in np.unique(of[:end]):
            own = np.sort(frequent[:end][of[:end] == c])
            i, j = np.triu_indices(len(own), 1)
            out.append(X.mix(_single(own, 3 + scheme)[i] * U64(3) + own[j]))
    return np.unique(np.concatenate(out))


def indexed(n: np.ndarray, at: np.ndarray, gram: np.ndarray, count: np.ndarray, least: float, rare: int, per_class: int = PER_CLASS, single: bool = True, other: bool = True) -> tuple[np.ndarray, ...]:
    """What documents of n n-grams are indexed under, given those that others share and by how many: document, signature,
    whether it is the first of its kind there, and, of a single n-gram, how many of the document's come before it, else -1. Without ``single`` or ``other``, only the ones or the others of these."""
    size = np.diff(at)
    owner = np.repeat(np.arange(len(n)), size)
    order = np.lexsort((gram, count, owner))
    gram, few = gram[order], count[order] <= rare
    differ = may_differ(n, least)
    # N-grams that nobody else has come first.
    pos = np.arange(len(gram)) - at[owner] + (n - size)[owner]
    singles = few & (pos <= differ[owner]) & single
    kinds = [(owner[singles], _single(gram[singles], 1), pos[singles])]
    # All of them, for documents that are small.
    every = (_small(n, least) & (n - size <= differ) & other)[owner]
    kinds.append((owner[every], _single(gram[every], 2), np.full(every.sum(), -1)))
    many = np.bincount(owner[few], minlength=len(n))
    need = differ + 1 - (n - size)
    for d in np.flatnonzero(need > many) if other else ():
        pairs = _combined(int(n[d]), gram[at[d] + many[d] : at[d + 1]], int(need[d] - many[d]), least, per_class)
        kinds.append((np.full(len(pairs), d), pairs, np.full(len(pairs), -1)))
    first = [np.concatenate((np.ones(min(1, len(d)), bool), d[1:] != d[:-1])) for d, _, _ in kinds]
    doc, sig, pos = (np.concatenate(x) for x in zip(*kinds))
    return doc, sig, np.concatenate(first), pos


def signatures(n: int, gram: np.ndarray, df: np.ndarray, least: float, rare: int, per_class: int = PER_CLASS) -> np.ndarray:
    """What one document is indexed under."""
    return np.unique(indexed(np.array([n]), np.array([0, len(gram)]), gram, df, least, rare, per_class)[1])


def _signed(batches_: Iterator[pa.RecordBatch], least: float, rare: int) -> Iterator[pa.RecordBatch]:
    """The single n-grams that documents are indexed under."""
    for whole in batches_:
        for lo in range(0, whole.num_rows, 256):
            batch = whole.slice(lo, 256)
            rid, size = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.int64)
            lists, told = batch.column(2), batch.column(3)
            at = lists.offsets.to_numpy().astype(np.int64)
            gram = lists.values.to_numpy().view(U64)[at[0] : at[-1]]
            count = np.frombuffer(b"".join(told.to_pylist()), np.uint8)
            doc, sig, first, pos = indexed(size, at - at[0], gram, count, least, rare, other=False)
            # The document's signature before this one; before the first, something that no other document has.
            before = np.empty(len(sig), U64)
            before[1:] = sig[:-1]
            before[first] = X.mix(rid[doc[first]].view(U64) + U64(1))
            yield pa.RecordBatch.from_arrays([pa.array(sig.view(np.int64)), pa.array(before.view(np.int64)), pa.array(rid[doc]), pa.array(size[doc], pa.int32()), pa.array(pos, pa.int32())], schema=_SIGNED)


def _tile(table: pa.Table, least: float, rare: int) -> pa.Table:
    """A dense block, of its documents."""
    table = table.sort_by("place").combine_chunks()
    size, told, lists = table.column("n").to_numpy().astype(np.int64), table.column("counts").to_pylist(), table.column("grams").combine_chunks()
    at = lists.offsets.to_numpy().astype(np.int64)
    gram = lists.values.to_numpy().view(U64)[at[0] : at[-1]]
    at -= at[0]
    sigs = np.unique(indexed(size, at, gram, np.frombuffer(b"".join(told), np.uint8), least, rare, single=False)[1])
    names, number = np.unique(gram, return_inverse=True)
    docs = pa.table({"place": table.column("place"), "n": table.column("n"), "weight": table.column("weight"), "number": pa.ListArray.from_arrays(pa.array(at, pa.int32()), pa.array(number, pa.int32()))})
    row = [[table.column("block")[0].as_py()], [census.freeze(docs.combine_chunks().to_batches()[0])], [zstandard.compress(names.tobytes(), 1)], [sigs.view(np.int64)]]
    return pa.Table.from_arrays([pa.array(c, f.type) for c, f in zip(row, _TILE)], schema=_TILE)


def _tiles_signed(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """What dense blocks are indexed under, as _signed() has it of a document that is as large as any other."""
    for batch in batches_:
        for block, own in zip(batch.column("block").to_pylist(), batch.column("sigs")):
            sig, rid = own.values.to_numpy(), block << 8 | WHOLE
            before = np.concatenate((X.mix(np.array([rid + 1], U64)).view(np.int64), sig))[: len(sig)]
            same = lambda value, kind: pa.array(np.full(len(sig), value), kind)  # noqa: E731, B023
            yield pa.RecordBatch.from_arrays([pa.array(sig), pa.array(before), same(rid, pa.int64()), same(1, pa.int32()), same(-1, pa.int32())], schema=_SIGNED)


Rows = tuple[np.ndarray, ...]


def _near(rows: Rows, i: np.ndarray, j: np.ndarray, least: float) -> tuple[np.ndarray, np.ndarray]:
    """Of pairs that meet, those whose sizes and whose n-grams from the meeting on let them be similar."""
    _, _, rid, n, pos = rows
    a, b = n[i].astype(np.int64), n[j].astype(np.int64)
    enough = np.minimum(a, b) >= np.maximum(a, b) * least - 1e-9
    most = np.minimum(a - pos[i], b - pos[j])
    enough &= (pos[i] < 0) | (most * (1 + least) >= (a + b) * least - 1e-9)
    i, j = rid[i[enough]], rid[j[enough]]
    return np.minimum(i, j), np.maximum(i, j)


def _distinct(pairs: list[tuple[np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray]:
    a, b = (np.concatenate(x) for x in zip(*pairs)) if pairs else (np.zeros(0, np.int64), np.zeros(0, np.int64))
    order = np.lexsort((b, a))
    a, b = a[order], b[order]
    new = np.ones(len(a), bool)
    new[1:] = (a[1:] != a[:-1]) | (b[1:] != b[:-1])
    return a[new], b[new]


class _Pairs:
    """The pairs that a task finds, each once as long as there are not too many."""

    def __init__(self) -> None:
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.rows, self.most = 0, HELD

    def add(self, pairs: Iterator[tuple[np.ndarray, np.ndarray]]) -> Iterator[pa.RecordBatch]:
        for a, b in pairs:
            self.held.append((a, b))
            self.rows += len(a)
            if self.rows > self.most:
                a, b = _distinct(self.held)
                self.held, self.rows = [(a, b)], len(a)
                if 2 * self.rows > self.most:
                    yield from self.left()

    def left(self) -> Iterator[pa.RecordBatch]:
        a, b = _distinct(self.held)
        self.held, self.rows = [], 0
        for lo in range(0, len(a), 1 << 16):
            own = a[lo : lo + (1 << 16)]
            yield pa.RecordBatch.from_arrays([pa.array(own), pa.array(b[lo : lo + len(own)]), *(pa.nulls(len(own), f.type) for f in list(_MET)[2:])], schema=_MET)


def _meetings(rows: Rows, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The pairs of documents that meet in a signature, in the order of signatures and those before them.

    Two documents that have the same signature before this one have met there already, so documents are paired only
    with those of other predecessors: where many near copies meet again and again, this costs next to nothing. Single
    n-grams follow each other in one order for all, so that the first that two documents share is never passed over.
    """
    sig, before = rows[:2]
    new = np.concatenate(([True], sig[1:] != sig[:-1]))
    inner = new | np.concatenate(([True], before[1:] != before[:-1]))
    ends = lambda first: np.repeat(np.append(np.flatnonzero(first)[1:], len(sig)), np.diff(np.append(np.flatnonzero(first), len(sig))))
    start, stop = ends(inner), ends(new)
    count = stop - start
    upto = np.cumsum(count)
    lo = 0
    while lo < len(sig):
        hi = max(lo + 1, int(np.searchsorted(upto, (upto[lo - 1] if lo else 0) + SLICE, side="right")))
        own = count[lo:hi]
        i = np.repeat(np.arange(lo, hi), own)
        j = np.repeat(start[lo:hi] - (np.cumsum(own) - own), own) + np.arange(own.sum())
        yield _distinct([_near(rows, i, j, least)])
        lo = hi


def _met(batches_: Iterator[pa.RecordBatch], least: float, hot: int) -> Iterator[pa.RecordBatch]:
    """Pairs by signature; a signature with more than ``hot`` documents is passed on in blocks of as many."""
    held: list[pa.RecordBatch] = []
    rows = sent = 0
    found = _Pairs()

    def blocks(own: list[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        nonlocal sent
        for batch in own:
            block = (sent + np.arange(batch.num_rows)) // hot
            sent += batch.num_rows
            yield pa.RecordBatch.from_arrays([batch.column(2), pa.nulls(batch.num_rows, pa.int64()), batch.column(0), batch.column(1), batch.column(3), batch.column(4), pa.array(block)], schema=_MET)

    def ended() -> Iterator[pa.RecordBatch]:
        nonlocal held, rows, sent
        if sent or rows > hot:
            yield from blocks(held)
        elif rows > 1:
            table = pa.Table.from_batches(held)
            yield from found.add(_meetings(tuple(c.to_numpy() for c in table.columns), least))
        held, rows, sent = [], 0, 0

    for batch in batches_:
        if not batch.num_rows:
            continue
        sig = batch.column(0).to_numpy()
        if held or sent:
            last = held[-1].column(0)[-1].as_py() if held else last
            cut = int(np.searchsorted(sig, last, side="right"))
            held.append(batch.slice(0, cut))
            rows += cut
            if cut == len(sig):
                held = [x for x in held if x.num_rows]
                if sent or rows > hot:
                    yield from blocks(held)
                    held, rows = [], 0
                continue
            held = [x for x in held if x.num_rows]
            yield from ended()
            batch, sig = batch.slice(cut), sig[cut:]
        cut = int(np.searchsorted(sig, sig[-1]))
        if cut:
            # Long signatures within a batch are no longer than the batch.
            yield from found.add(_meetings(tuple(c.to_numpy() for c in batch.slice(0, cut).columns), least))
        held, rows, last = [batch.slice(cut)], batch.num_rows - cut, sig[-1]
    if held or sent:
        yield from ended()
    yield from found.left()


def _across(table: pa.Table, least: float) -> pa.Table:
    """The pairs of two blocks of a signature, or within one."""
    table = table.sort_by([("block", "ascending"), ("before", "ascending")])
    block = table.column("block").to_numpy()
    rows = tuple(table.column(c).to_numpy() for c in ("sig", "before", "rid", "n", "pos"))
    cut = int(np.searchsorted(block, block[-1]))
    if not cut:
        out = list(_meetings(rows, least))
    else:
        out, right = [], np.arange(cut, len(block))
        step = max(1, SLICE // len(right))
        for lo in range(0, cut, step):
            left = np.arange(lo, min(cut, lo + step))
            i, j = np.repeat(left, len(right)), np.tile(right, len(left))
            other = rows[1][i] != rows[1][j]
            out.append(_near(rows, i[other], j[other], least))
    return pa.table(dict(zip("ab", map(pa.array, _distinct(out)))))


def _numbered(batches_: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Representatives in blocks: a place is the number of its block and a place of less than WHOLE there. Dense ones, which come last, have blocks of their own."""
    block, slot, grams, site, now = (TaskContext.get().partitionId() << 36), 0, 0, 0, False
    for batch in batches_:
        place = []
        for n, dense in zip(batch.column("n").to_pylist(), batch.column("dense").to_pylist()):
            if slot == BLOCK or slot and (dense != now or grams + n > (DENSE_GRAMS if dense else BLOCK_GRAMS)):
                if dense != now or dense and site + n > SITE_GRAMS:
                    block |= (1 << SITE) - 1
                block, slot, grams = block + 1, 0, 0
                site *= bool(block % (1 << SITE))
            now = dense
            place.append(dense * DENSE | block << 8 | slot)
            slot, grams, site = slot + 1, grams + n, site + n
        yield batch.append_column("place", pa.array(place, pa.int64()))


def _similar(sa: np.ndarray, sb: np.ndarray, a: np.ndarray, b: np.ndarray, n: np.ndarray, at: np.ndarray, gram: np.ndarray, least: float) -> pa.RecordBatch:
    """The pairs (rows with b >= 0) of sites whose lists (the other rows) are similar enough."""
    site = np.cumsum(np.concatenate(([0], (sa[1:] != sa[:-1]) | (sb[1:] != sb[:-1]))))
    known = np.unique(np.concatenate((a, b)))
    name = lambda s, x: s * len(known) + np.searchsorted(known, x)
    pair = np.flatnonzero(b >= 0)
    lists = np.flatnonzero(b < 0)
    own = name(site[lists], a[lists])
    order = np.argsort(own)
    lists, own = lists[order], own[order]
    x, y = (lists[np.searchsorted(own, name(site[pair], side[pair]))] for side in (a, b))
    _, number = np.unique(gram, return_inverse=True)
    mark = np.zeros(number.max(initial=-1) + 1, bool)
    order = np.argsort(x, kind="stable")
    x, y, pair = x[order], y[order], pair[order]
    edge = np.flatnonzero(np.concatenate((np.ones(min(1, len(x)), bool), x[1:] != x[:-1])))
    shared = np.zeros(len(x), np.int64)
    for lo, hi in zip(edge, np.append(edge[1:], len(x))):
        mine = number[at[x[lo]] : at[x[lo] + 1]]
        mark[mine] = True
        size = at[y[lo:hi] + 1] - at[y[lo:hi]]
        ends = np.cumsum(size)
        hit = mark[number[np.repeat(at[y[lo:hi]] - (ends - size), size) + np.arange(ends[-1])]]
        total = np.concatenate(([0], np.cumsum(hit)))
        shared[lo:hi] = total[ends] - total[ends - size]
        mark[mine] = False
    jaccard = shared / np.maximum(1, n[x].astype(np.int64) + n[y] - shared)
    good = jaccard >= least
    return pa.RecordBatch.from_arrays([pa.array(a[pair[good]]), pa.array(b[pair[good]]), pa.array(jaccard[good])], ["a", "b", "jaccard"])


def _verified(batches_: Iterator[pa.RecordBatch], least: float) -> Iterator[pa.RecordBatch]:
    """Rows in the order of sites, each with its lists and its pairs: whole sites are taken together up to BLOCK_GRAMS n-grams, or one."""

    def taken(own: list[pa.RecordBatch]) -> pa.RecordBatch:
        table = pa.Table.from_batches(own).combine_chunks()
        lists = table.column("grams").combine_chunks()
        at = lists.offsets.to_numpy().astype(np.int64)
        columns = [table.column(c).to_numpy() for c in ("sa", "sb", "a", "b", "n")]
        return _similar(*columns, at - at[0], lists.values.to_numpy()[at[0] : at[-1]], least)

    held: list[pa.RecordBatch] = []
    grams = 0
    for batch in batches_:
        if not batch.num_rows:
            continue
        held.append(batch)
        grams += len(batch.column("grams").flatten())
        if grams > BLOCK_GRAMS:
            sa, sb = (batch.column(c).to_numpy() for c in ("sa", "sb"))
            cut = int(np.flatnonzero((sa == sa[-1]) & (sb == sb[-1]))[0])
            if cut or len(held) > 1 and any(held[-2].column(c)[-1].as_py() != s[0] for c, s in (("sa", sa), ("sb", sb))):
                held[-1] = batch.slice(0, cut)
                yield taken(held)
                held = [batch.slice(cut)]
                grams = len(held[0].column("grams").flatten())
    if held:
        yield taken(held)


def _whole(batches_: Iterator[pa.RecordBatch], keys: tuple[str, ...]) -> Iterator[pa.Table]:
    """The runs of rows that are equal in the keys."""
    held: list[pa.RecordBatch] = []
    for batch in batches_:
        values = [batch.column(k).to_numpy() for k in keys]
        cuts = np.flatnonzero(np.any([v[1:] != v[:-1] for v in values], axis=0)) + 1 if batch.num_rows > 1 else []
        for lo, hi in zip([0, *cuts], [*cuts, batch.num_rows]):
            own = batch.slice(lo, hi - lo)
            if held and hi > lo and any(held[-1].column(k)[0] != own.column(k)[0] for k in keys):
                yield pa.Table.from_batches(held)
                held = []
            if hi > lo:
                held.append(own)
    if held:
        yield pa.Table.from_batches(held)


class _Dense:
    """A dense block at a site: entries are the row and the n-gram of each one in its matrix, known the n-grams it has, first the number of its first document."""

    def __init__(self, docs: bytes, number: np.ndarray, first: int):
        table = census.thaw(docs)
        lists = table.column("number").combine_chunks()
        at = lists.offsets.to_numpy()
        self.place, self.weight = table.column("place").to_numpy(), table.column("weight").to_numpy()
        self.n, self.known, self.own = table.column("n").to_numpy().astype(np.int64), number, slice(first, first + table.num_rows)
        self.entries = np.repeat(np.arange(table.num_rows), np.diff(at)), number[lists.values.to_numpy()[at[0] : at[-1]]]

    def matrix(self, column: np.ndarray, width: int) -> np.ndarray:
        row, gram = self.entries
        at = column[gram]
        out = np.zeros((len(self.n), width), np.float32)
        out[row[at >= 0], at[at >= 0]] = 1
        return out


def _shared(x: _Dense, y: _Dense, column: np.ndarray) -> np.ndarray:
    """How many n-grams each document of a block shares with each of another. column: -1 for every n-gram of the site."""
    column[x.known] = 0
    both = y.known[column[y.known] == 0]
    column[x.known] = -1
    total = np.zeros((len(x.n), len(y.n)))
    for lo in range(0, len(both), WIDE):
        own = both[lo : lo + WIDE]
        column[own] = np.arange(len(own))
        left = x.matrix(column, len(own))
        total += left @ (left if x is y else y.matrix(column, len(own))).T
        column[own] = -1
    return total


def _linked(batches_: Iterator[pa.RecordBatch], least: float, pairs: bool) -> Iterator[pa.RecordBatch]:
    """The similar pairs of the dense blocks that meet at a site, or the links and a forest of its documents."""

    def batch(a: np.ndarray, b: np.ndarray | None = None, jaccard: np.ndarray | None = None, near: np.ndarray | None = None) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.nulls(len(a), f.type) if c is None else pa.array(c, f.type) for c, f in zip((a, b, jaccard, near), _LINKED)], schema=_LINKED)

    for table in _whole(batches_, ("sa", "sb")):
        x, y, docs, names = (table.column(c).to_pylist() for c in ("x", "y", "docs", "names"))
        sent = [i for i, d in enumerate(docs) if d is not None]
        each = [np.frombuffer(zstandard.decompress(names[i]), U64) for i in sent]
        every, number = np.unique(np.concatenate(each), return_inverse=True)
        blocks: dict[int, _Dense] = {}
        first = 0
        for i, own in zip(sent, np.split(number, np.cumsum([len(v) for v in each])[:-1])):
            blocks[x[i]] = _Dense(docs[i], own, first)
            first += len(blocks[x[i]].n)
        column, near, tree = np.full(len(every), -1), np.zeros(first, np.int64), np.arange(first)
        for p, q in sorted((p, q) for p, q, d in zip(x, y, docs) if d is None):
            a, b = blocks[p], blocks[q]
            shared = _shared(a, b, column)
            jaccard = shared / np.maximum(1, a.n[:, None] + b.n - shared)
            good = (shared > 0) & (jaccard >= least)
            if p == q:
                good = np.triu(good, 1)
            if pairs:
                i, j = np.nonzero(good)
                yield batch(a.place[i], b.place[j], jaccard[i, j])
                continue
            near[a.own] += good @ b.weight
            near[b.own] += good.T @ a.weight
            while (apart := good & (tree[a.own][:, None] != tree[b.own])).any():
                i = int(np.argmax(apart.any(axis=1)))
                j = np.flatnonzero(apart[i])
                others, at = np.unique(tree[b.own][j], return_index=True)
                tree[np.isin(tree, others)] = tree[a.own][i]
                yield batch(np.full(len(at), a.place[i]), b.place[j[at]])
        if near.any():
            yield batch(np.concatenate([b.place for b in blocks.values()])[near > 0], near=near[near > 0])


def _forest(batches_: Iterator[pa.RecordBatch], most: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """Fewer edges that connect the same: of up to ``most`` of a task's at once, those that join two trees."""
    held: list[pa.RecordBatch] = []
    rows = 0

    def joined() -> pa.RecordBatch:
        table = pa.Table.from_batches(held)
        a, b = table.column("a").to_numpy(), table.column("b").to_numpy()
        known, place = np.unique(np.concatenate((a, b)), return_inverse=True)
        parent = list(range(len(known)))
        keep = np.zeros(len(a), bool)
        for i, (x, y) in enumerate(zip(place[: len(a)].tolist(), place[len(a) :].tolist())):
            while parent[x] != x:
                parent[x] = x = parent[parent[x]]
            while parent[y] != y:
                parent[y] = y = parent[parent[y]]
            if x != y:
                parent[max(x, y)] = min(x, y)
                keep[i] = True
        return pa.RecordBatch.from_arrays([pa.array(a[keep]), pa.array(b[keep])], ["a", "b"])

    for batch in batches_:
        held.append(batch)
        rows += batch.num_rows
        if rows > most:
            yield joined()
            held, rows = [], 0
    if rows:
        yield joined()


class Join:
    """The tables of a join on a shelf.

    members: (doc_id, key, f1, f2), a row for each row with an id and a text; f1 and f2 name the set of those that may be similar to others.
    reps: (place, doc_id, key, f1, f2, weight), the first document of each such set, and how many documents have it.
    edges: (a, b, jaccard), the places of similar representatives, without those of two dense ones unless ``pairs`` is set.
    trees: (a, b), edges that connect what these would.
    near: (place, near), of a dense one, parts of the number of dense documents that are similar.
    """

    def __init__(self, df: DataFrame, id_col: str, text_col: str, n: int, least: float, rare: int, hot: int = HOT, *, pairs: bool = False):
        self.shelf = shelf = Shelf(df.sparkSession)
        rare = min(rare, census.MOST - 1)
        docs = slim(df, id_col, text_col).where("doc_id IS NOT NULL AND text IS NOT NULL").select("doc_id", text_key().alias("key"), "text")
        told = census.told(census.sent(docs, lambda data, at: X.shingles(data, at, n), census.parts_for(docs)))
        left = told.groupBy("chunk").applyInArrow(lambda t: _left(t, n, least, rare), _sql(_LEFT))
        left = shelf.keep(left.withColumn("rid", F.monotonically_increasing_id()))
        self.members = shelf.keep(left.select("doc_id", "key", "f1", "f2"))
        open_ = left.where("f1 IS NOT NULL")
        own = open_.groupBy("f1", "f2", "doc_id", "key").agg(F.min("rid").alias("rid"), F.first("n").alias("n"), F.first("home").alias("home"), F.first("dense").alias("dense"))
        sets = own.groupBy("f1", "f2").agg(F.min(F.struct("doc_id", "key", "rid")).alias("rep"), F.first("n").alias("n"), F.first("home").alias("home"), F.first("dense").alias("dense"), F.count("*").alias("weight"))
        sets = shelf.keep(sets.select("rep.*", "f1", "f2", "n", "home", "dense", "weight"))
        numbered = sets.repartitionByRange("dense", "home", "rid").sortWithinPartitions("dense", "home", "rid")
        self.reps = shelf.keep(numbered.mapInArrow(_numbered, "doc_id long, key long, rid long, f1 long, f2 long, n int, home long, dense boolean, weight long, place long"))
        # merge: lists travel by the same plan at every size; Spark would send the other side of a small input to all instead.
        lists = shelf.keep(open_.select("rid", "grams", "counts").hint("merge").join(self.reps.select("rid", "place", "n", "weight"), "rid").select("place", "n", "grams", "counts", "weight"))
        shelf.drop(left, sets)
        block = lambda c: F.shiftright(c, 8)
        tiles = lists.where(F.col("place") >= DENSE).withColumn("block", block("place"))
        tiles = shelf.keep(tiles.repartition(partitions(df.sparkSession), "block").groupBy("block").applyInArrow(lambda t: _tile(t, least, rare), _sql(_TILE)))
        signed = lists.mapInArrow(lambda b: _signed(b, least, rare), _sql(_SIGNED)).union(tiles.select("block", "sigs").mapInArrow(_tiles_signed, _sql(_SIGNED)))
        met = shelf.keep(signed.repartition("sig").sortWithinPartitions("sig", "before").mapInArrow(lambda b: _met(b, least, hot), _sql(_MET)))
        found = met.where("block IS NULL").select("a", "b")
        many = met.where("block IS NOT NULL").select(F.col("a").alias("rid"), "sig", "before", "n", "pos", "block")
        if many.limit(1).count():
            blocks = many.groupBy("sig").agg(F.max("block").alias("last"))
            both = many.join(blocks, "sig").withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), "last"))).withColumns({"x": F.least("block", "other"), "y": F.greatest("block", "other")})
            # A block is paired with itself once.
            found = found.union(both.groupBy("sig", "x", "y").applyInArrow(lambda t: _across(t, least), "a long, b long"))
        # a is not above b.
        candidates = shelf.keep(found.where(F.col("a") < DENSE).distinct().select("a", "b", block("a").alias("sa"), block("b").alias("sb")))
        meet = found.where(F.col("a") >= DENSE).select(block("a").alias("x"), block("b").alias("y")).union(tiles.select("block", "block")).distinct()
        meet = shelf.keep(meet.select(F.shiftright("x", SITE).alias("sa"), F.shiftright("y", SITE).alias("sb"), "x", "y"))
        shelf.drop(met)
        asked = candidates.select("sa", "sb", F.col("a").alias("place")).union(candidates.select("sa", "sb", F.col("b").alias("place"))).distinct()
        rows = asked.join(lists.select("place", "n", "grams").hint("merge"), "place").select("sa", "sb", F.lit(0).alias("kind"), F.col("place").alias("a"), F.lit(-1).cast("long").alias("b"), "n", "grams")
        rows = rows.union(candidates.select("sa", "sb", F.lit(1).alias("kind"), "a", "b", F.lit(0), F.array().cast("array<long>")))
        edges = shelf.keep(rows.repartition("sa", "sb").sortWithinPartitions("sa", "sb", "kind").mapInArrow(lambda b: _verified(b, least), "a long, b long, jaccard double"))
        shelf.drop(candidates, lists)
        asked = meet.select("sa", "sb", F.col("x").alias("block")).union(meet.select("sa", "sb", F.col("y").alias("block"))).distinct()
        rows = asked.join(tiles, "block").select("sa", "sb", F.col("block").alias("x"), F.lit(None).cast("long").alias("y"), "docs", "names")
        rows = rows.union(meet.select("sa", "sb", "x", "y", F.lit(None).cast("binary"), F.lit(None).cast("binary")))
        dense = shelf.keep(rows.repartition(partitions(df.sparkSession), "sa", "sb").sortWithinPartitions("sa", "sb").mapInArrow(lambda b: _linked(b, least, pairs), _sql(_LINKED)))
        shelf.drop(meet, tiles)
        self.edges = edges.union(dense.where("jaccard IS NOT NULL").select("a", "b", "jaccard"))
        self.trees = dense.where("b IS NOT NULL AND jaccard IS NULL").select("a", "b")
        self.near = dense.where("near IS NOT NULL").select(F.col("a").alias("place"), "near")

    def copies(self) -> DataFrame:
        """(id_a, key_a, id_b, key_b): each first document of a set with the others that have it."""
        first = self.reps.where("weight > 1").select("f1", "f2", F.col("doc_id").alias("id_a"), F.col("key").alias("key_a"))
        joined = self.members.where("f1 IS NOT NULL").join(first, ["f1", "f2"]).where("doc_id <> id_a OR key <> key_a")
        return joined.select("id_a", "key_a", F.col("doc_id").alias("id_b"), F.col("key").alias("key_b")).distinct()

    def named(self, edges: DataFrame, *more: str) -> DataFrame:
        """(id_a, key_a, id_b, key_b) of edges, the smaller first."""
        side = lambda s: self.reps.select(F.col("place").alias(s), F.struct(F.col("doc_id").alias("id"), "key").alias(f"n{s}"))
        both = edges.join(side("a"), "a").join(side("b"), "b").withColumns({"lo": F.least("na", "nb"), "hi": F.greatest("na", "nb")})
        return both.select(F.col("lo.id").alias("id_a"), F.col("lo.key").alias("key_a"), F.col("hi.id").alias("id_b"), F.col("hi.key").alias("key_b"), *more)

    def all_edges(self) -> DataFrame:
        """(id_a, key_a, id_b, key_b, jaccard) between representatives, and from each to its copies, where ``pairs`` was set."""
        return self.copies().withColumn("jaccard", F.lit(1.0)).union(self.named(self.edges, "jaccard"))

    def classes(self) -> DataFrame:
        """(doc_id, key, root_id, root_key, n_links) of each member: the smallest document it is connected with, and how many are similar to it."""
        node = lambda s: F.struct(F.col(f"id_{s}").alias("id"), F.col(f"key_{s}").alias("key")).alias(s)
        forest = self.edges.select("a", "b").union(self.trees).mapInArrow(_forest, "a long, b long")
        label = components(self.named(forest).select(node("a"), node("b")), self.shelf)
        weight = lambda x, y: self.edges.select(F.col(x).alias("place"), F.col(y).alias("other"))
        both = weight("a", "b").union(weight("b", "a")).join(self.reps.select(F.col("place").alias("other"), "weight"), "other")
        links = both.select("place", F.col("weight").alias("near")).union(self.near).groupBy("place").agg(F.sum("near").alias("near"))
        sets = self.reps.join(links, "place", "left").join(label.select(F.col("node.id").alias("doc_id"), F.col("node.key").alias("key"), "root"), ["doc_id", "key"], "left")
        root = F.coalesce("root", F.struct(F.col("doc_id").alias("id"), "key"))
        sets = self.shelf.keep(sets.select("f1", "f2", root.getField("id").alias("root_id"), root.getField("key").alias("root_key"), (F.coalesce("near", F.lit(0)) + F.col("weight") - 1).alias("n_links")))
        linked = self.members.where("f1 IS NOT NULL").distinct().join(sets, ["f1", "f2"]).select("doc_id", "key", "root_id", "root_key", "n_links")
        return linked.union(self.members.where("f1 IS NULL").distinct().select("doc_id", "key", "doc_id", "key", F.lit(0).cast("long")))


def similar_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: float = LEAST, rare: int = RARE) -> DataFrame:
    """(id_a, id_b, jaccard): the pairs of documents with a Jaccard similarity of n-gram sets of at least ``least``, factored by copies.

    Documents with equal sets are copies: the one with the smallest id represents them, is paired with each of
    them, and alone is paired with documents of other sets, so that a group of k copies gives k - 1 rows and not
    k * (k - 1) / 2, and no pair is lost: two documents are similar if their representatives are. id_a is not
    above id_b. A word is a run of ASCII letters and digits or non-ASCII characters, ASCII letters in lower case;
    a text of fewer than n words has these as its only n-gram. Rows with a null id, a null text or no words
    have no pairs. Rows equal in id and text are one document; different texts under one id are different
    documents. An empty table gives no rows. Other columns are not read. Exact: every pair is found and
    verified. df has to be a scan or otherwise give the same rows when a task runs again.
    """
    return Join(df, id_col, text_col, n, least, rare, pairs=True).all_edges().select("id_a", "id_b", "jaccard")


def classes(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: float = LEAST, rare: int = RARE) -> DataFrame:
    """(doc_id, class_id, n_links) for each document: the smallest id that it is connected with by similar pairs, its own if there is none, and to how many other documents it is similar itself.

    Similar, words, and what counts as one document are as for similar_pairs(). Copies count as links, each, without being
    expanded into pairs. A null or empty text, or one without words, has no links, a null id a null class. An
    empty table gives no rows. Other columns are not read.
    """
    join = Join(df, id_col, text_col, n, least, rare)
    found = join.classes().select("doc_id", F.col("root_id").alias("class_id"), "n_links")
    docs = slim(df, id_col, text_col)
    bare = docs.where("doc_id IS NULL OR text IS NULL").select("doc_id", text_key().alias("key")).distinct()
    return found.union(bare.select("doc_id", "doc_id", F.lit(0).cast("long")))


def all_pairs(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: float = LEAST, rare: int = RARE) -> DataFrame:
    """(id_a, id_b, jaccard): what similar_pairs() has, expanded to every pair, copies with each other and with what is near to them.

    A group of k copies gives k * (k - 1) / 2 rows, and two that are similar the product of their sizes besides.
    """
    join = Join(df, id_col, text_col, n, least, rare, pairs=True)
    edges = join.shelf.keep(join.all_edges())
    node = lambda s: F.struct(F.col(f"id_{s}").alias("id"), F.col(f"key_{s}").alias("key"))
    edges = edges.select(node("a").alias("a"), node("b").alias("b"), "jaccard")
    # Different sets are never of similarity 1.
    copies, near = edges.where("jaccard = 1"), edges.where("jaccard < 1")
    reps = edges.select(F.col("a").alias("rep")).union(near.select("b")).distinct()
    members = reps.select("rep", F.col("rep").alias("own")).union(copies.select("a", "b"))
    side = lambda s: members.select(F.col("rep").alias(s), F.col("own").alias(f"own_{s}"))
    equal = side("a").join(members.select(F.col("rep").alias("a"), F.col("own").alias("own_b")), "a").where("own_a < own_b").select("own_a", "own_b", F.lit(1.0).alias("jaccard"))
    other = near.join(side("a"), "a").join(side("b"), "b").select(F.least("own_a", "own_b").alias("own_a"), F.greatest("own_a", "own_b").alias("own_b"), "jaccard")
    return equal.union(other).select(F.col("own_a.id").alias("id_a"), F.col("own_b.id").alias("id_b"), "jaccard")


def components(edges: DataFrame, shelf: Shelf | None = None) -> DataFrame:
    """(node, root) for each node of the edges (a, b); root is the smallest node that it is connected with."""
    shelf = shelf or Shelf(edges.sparkSession)
    both = shelf.keep(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    label = shelf.keep(both.groupBy(F.col("a").alias("node")).agg(F.min("b").alias("root")).select("node", F.least("node", "root").alias("root")))
    while True:
        near = both.join(label.select(F.col("node").alias("b"), "root"), "b").groupBy(F.col("a").alias("node")).agg(F.min("root").alias("best"))
        step = label.join(near, "node").select("node", F.least("root", "best").alias("next"), F.col("root").alias("was"))
        jump = label.select(F.col("node").alias("next"), F.col("root").alias("far"))
        step = shelf.keep(step.join(jump, "next").select("node", F.least("next", "far").alias("root"), "was"))
        shelf.drop(label)
        if not step.where("root <> was").limit(1).count():
            shelf.drop(both)
            return step.select("node", "root")
        label = step


def one_of_each(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = N, least: float = LEAST, rare: int = RARE) -> DataFrame:
    """The rows of df without those that are connected, by similar pairs, with a document of smaller id.

    Rows without a pair stay, so rows with a null id or text do. Rows equal in id and text stay or go together.
    """
    found = Join(df, id_col, text_col, n, least, rare).classes()
    gone = found.where("doc_id <> root_id OR key <> root_key").select(F.col("doc_id").alias("gone_id"), F.col("key").alias("gone_key"))
    own = df.select(F.struct("*").alias("own"), F.col(id_col).cast("long").alias("own_id"), text_key(text_col).alias("own_key"))
    return own.join(gone, (F.col("own_id") == F.col("gone_id")) & (F.col("own_key") == F.col("gone_key")), "left_anti").select("own.*")
