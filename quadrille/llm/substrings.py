"""Substring dedup: passages of many words that occur in more than one document.

Recompression: rounds replace runs of equal symbols, and then pairs of a left
and a right symbol, by names for them; which symbols are left and which right
is drawn anew each round from the symbols themselves. A name is a fingerprint
of what it stands for, so all executors give equal things equal names without
asking each other. Symbols of a level's size take no further part in it; the
next level goes on from there to larger ones.

Every symbol knows on which words around it the rounds that made it depended. Where a
window of n words holds them all, each of its equals holds the same symbol. A
census of the symbols tells which are in one document only, and rules out
every window that holds all that such a symbol depended on. What is left, windows without
any such symbol among them, goes into a second census, which verifies them: a window
counts if another document has it too. The unions are the repeats, exact to
the word, and none is missed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from quadrille.llm import census
from quadrille.llm import text as X
from quadrille.llm.cluster import slim

U64 = np.uint64
#: Words of the shortest repeat.
WORDS = 50
#: The levels: symbols of this share of a window's words are left alone.
LEVELS = (1 / 12, 1 / 4)

_SPANS = pa.schema([("doc_id", pa.int64()), ("start_word", pa.int64()), ("end_word", pa.int64()), ("n_words", pa.int64())])


Symbols = tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]


def _round(owner: np.ndarray, edge: np.ndarray, state: Symbols, frozen: int, salt: int) -> Symbols:
    """Runs, then pairs, of the symbols of fewer than ``frozen`` words."""
    name, start, size, lo, hi = state

    def sides(lo: np.ndarray, hi: np.ndarray) -> tuple[np.ndarray, ...]:
        """What the left and the right neighbours depend on; beside a text's end it is a place that no window has."""
        of = owner[start]
        ends = np.flatnonzero(of[1:] != of[:-1])
        a, b, c, d = (np.empty_like(lo) for _ in range(4))
        a[1:], b[1:], c[:-1], d[:-1] = lo[:-1], hi[:-1], lo[1:], hi[1:]
        left, right = np.append(0, ends + 1), np.append(ends, len(of) - 1)
        a[left], b[left] = edge[of[left]] - 1, hi[left]
        c[right], d[right] = lo[right], edge[of[right] + 1] + 1
        return a, b, c, d

    together = owner[start[1:]] == owner[start[:-1]]
    open_ = size < frozen
    a, b, c, d = sides(lo, hi)
    # An open symbol has looked for its equal on both sides; in a run, at the whole run.
    lo = np.where(open_, np.minimum(np.minimum(lo, a), c), lo)
    hi = np.where(open_, np.maximum(np.maximum(hi, b), d), hi)
    joined = together & (name[1:] == name[:-1]) & open_[1:]
    if joined.any():
        head = np.flatnonzero(np.concatenate(([True], ~joined)))
        long = np.diff(np.append(head, len(name)))
        place = np.arange(len(name)) - np.repeat(head, long)
        first = np.flatnonzero(place % -(-frozen // size) == 0)
        count = np.diff(np.append(first, len(name))).astype(np.int32)
        lo, hi = (np.repeat(f.reduceat(x, head), long)[first] for f, x in ((np.minimum, lo), (np.maximum, hi)))
        name, start, size = name[first], start[first], size[first] * count
        many = count > 1
        name[many] = X.mix(name[many] * U64(0xD6E8FEB86659FD93) + count[many].astype(U64))
        together = owner[start[1:]] == owner[start[:-1]]
        open_ = size < frozen
    else:
        name, size = name.copy(), size.copy()
    right = (X.mix(name ^ U64(0x5851F42D4C957F2D * (salt + 1) & 0xFFFFFFFFFFFFFFFF)) >> U64(63)).astype(bool)
    pair = np.flatnonzero(together & open_[:-1] & open_[1:] & ~right[:-1] & right[1:])
    # A left symbol has looked to its right, a right one to its left; of a pair, at each other.
    a, b, c, d = sides(lo, hi)
    lo = np.where(open_, np.minimum(lo, np.where(right, a, c)), lo)
    hi = np.where(open_, np.maximum(hi, np.where(right, b, d)), hi)
    name[pair] = X.mix(name[pair] * U64(0x9FB21C651E98DF25) + X.mix(name[pair + 1]))
    lo[pair], hi[pair] = np.minimum(lo[pair], lo[pair + 1]), np.maximum(hi[pair], hi[pair + 1])
    size[pair] += size[pair + 1]
    stays = np.ones(len(name), bool)
    stays[pair + 1] = False
    return tuple(x[stays] for x in (name, start, size, lo, hi))


def symbols(owner: np.ndarray, edge: np.ndarray, word: np.ndarray, n: int) -> Symbols:
    """Names, first words, lengths, and first and end of the words that they depend on, of the symbols that windows of n words can hold with all these."""
    every = np.arange(len(word) + 1, dtype=np.int32)
    state: Symbols = (word, every[:-1], np.ones(len(word), np.int32), every[:-1], every[1:])
    shown: list[Symbols] = []
    salt = 0
    for share in LEVELS:
        frozen = max(2, int(n * share))
        before = state[1], state[2]
        for _ in range(frozen.bit_length() + 1):
            if len(state[0]) > 1:
                state = _round(owner, edge, state, frozen, salt)
            salt += 1
        new = state[4] - state[3] <= n
        if shown:
            at = np.searchsorted(before[0], state[1])
            new &= before[1][at] != state[2]
        shown.append(tuple(x[new] for x in state))
    return tuple(np.concatenate(x) for x in zip(*shown))


def distinct(owner: np.ndarray, name: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each pair of a text and a name once, and for every given pair its place there."""
    if not len(name):
        return owner, name, np.zeros(0, np.int64)
    at = np.lexsort((name, owner))
    o, v = owner[at], name[at]
    new = np.concatenate(([True], (o[1:] != o[:-1]) | (v[1:] != v[:-1])))
    place = np.empty(len(name), np.int64)
    place[at] = np.cumsum(new) - 1
    return o[new], v[new], place


def _shown(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts of the words, where each text's words start, and text, name, and first and last window that a symbol rules out of each symbol."""
    owner, _, _, word = X.words(data, at)
    edge = np.searchsorted(owner, np.arange(len(at)))
    name, start, _, lo, hi = symbols(owner, edge, word, n)
    of = owner[start]
    first, last = np.maximum(hi - n, edge[of]), np.minimum(lo, edge[of + 1] - n)
    some = first <= last
    return owner, edge, of[some], name[some], np.stack((first[some], last[some]))


def _names(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    _, _, of, name, _ = _shown(data, at, n)
    return distinct(of, name)[:2]


def windows(word: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    """Fingerprints of the n words from each of the given words on."""
    total = np.zeros(len(word) + 1, U64)
    np.cumsum(word * X.powers(len(word)), out=total[1:])
    return X.mix((total[at + n] - total[at]) * X.powers(len(word) + 1, inverse=True)[at])


def _suspects(table: pa.Table, parts: int, n: int) -> pa.Table:
    """The windows of a chunk that no symbol rules out, sent to be counted, with the texts that have any."""
    key = table.column("chunk")[0].as_py()
    frozen, count = census.answers(table)
    texts = census.thaw(frozen)
    owner, edge, of, name, (first, last) = _shown(*X.utf8(texts.column("text")), n)
    docs = texts.num_rows
    _, once, place = distinct(of, name)
    counts = np.empty(len(once), np.uint8)
    counts[census.order(once)] = count
    alone = counts[place] == 1
    steps = np.bincount(first[alone], minlength=len(owner) + 1) - np.bincount(last[alone] + 1, minlength=len(owner) + 1)
    whole = np.arange(len(owner)) + n <= edge[owner + 1]
    suspect = np.flatnonzero((np.cumsum(steps)[: len(owner)] == 0) & whole)
    if not len(suspect):
        return pa.Table.from_batches([census.batch_of([])])
    # The windows of a text as first ones and lengths of runs, counted from the text's own first word.
    head = np.flatnonzero(np.concatenate(([True], (np.diff(suspect) > 1) | (owner[suspect][1:] != owner[suspect][:-1]))))
    long = np.diff(np.append(head, len(suspect)))
    of = owner[suspect[head]]
    runs = np.stack((suspect[head] - edge[of], long), axis=1).astype(np.int32)
    at = np.searchsorted(of, np.arange(docs + 1))
    has = np.diff(at) > 0
    lists = pa.ListArray.from_arrays(pa.array(2 * np.append(at[:-1][has], at[-1]), pa.int32()), pa.array(runs.reshape(-1)))
    left = pa.RecordBatch.from_arrays([*[texts.column(c).filter(pa.array(has)).combine_chunks() for c in ("doc_id", "text")], lists], ["doc_id", "text", "runs"])
    *_, once, _ = _windowed(left, n)
    rows = [(-1 - key % parts, key, -1, census.freeze(left)), *census.ranges(once, census.order(once), key, parts)]
    return pa.Table.from_batches([census.batch_of(rows)])


def _windowed(left: pa.RecordBatch | pa.Table, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Words by text, first words of the windows, their distinct names, and the place of each among these."""
    column = left.column("text")
    owner, _, _, word = X.words(*X.utf8(column))
    runs = left.column("runs")
    runs = runs.combine_chunks() if isinstance(runs, pa.ChunkedArray) else runs
    at, flat = runs.offsets.to_numpy(), runs.values.to_numpy().reshape(-1, 2).astype(np.int64)
    edge = np.searchsorted(owner, np.arange(len(runs) + 1))
    first = flat[:, 0] + edge[np.repeat(np.arange(len(runs)), np.diff(at) // 2)]
    long = flat[:, 1]
    suspect = np.repeat(first - (np.cumsum(long) - long), long) + np.arange(long.sum())
    _, once, place = distinct(owner[suspect], windows(word, suspect, n))
    return owner, suspect, once, place


def _repeats(table: pa.Table, n: int) -> pa.Table:
    frozen, count = census.answers(table)
    left = census.thaw(frozen)
    owner, suspect, once, place = _windowed(left, n)
    counts = np.empty(len(once), np.uint8)
    counts[census.order(once)] = count
    found = suspect[counts[place] > 1]
    steps = np.bincount(found, minlength=len(owner) + 1) - np.bincount(found + n, minlength=len(owner) + 1)
    inside = np.cumsum(steps)[: len(owner)] > 0
    # Two texts that meet inside repeats are still two.
    edge = np.searchsorted(owner, np.arange(left.num_rows + 1))
    start, end = X.runs(inside)
    cut = edge[1:-1]
    cut = np.unique(cut[(cut > 0) & (cut < len(owner))])
    cut = cut[inside[cut - 1] & inside[cut]] if len(cut) else cut
    start, end = np.sort(np.concatenate((start, cut))), np.sort(np.concatenate((end, cut)))
    of = owner[start] if len(start) else np.zeros(0, np.int64)
    ids = left.column("doc_id").combine_chunks().take(pa.array(of))
    return pa.Table.from_arrays([ids, pa.array(start - edge[of], pa.int64()), pa.array(end - edge[of], pa.int64()), pa.array((edge[of + 1] - edge[of]), pa.int64())], schema=_SPANS)


def repeats(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", n: int = WORDS) -> DataFrame:
    """(doc_id, start_word, end_word, n_words): the maximal spans of words inside windows of n words that another document has too.

    A word is a run of ASCII letters and digits or non-ASCII characters, ASCII letters in lower case; n_words is
    the number of words of the document, and a span ends before end_word. What only repeats inside one document does not
    count. Every row is a document: rows equal in id and text repeat each other, and a null id stays null. A null or
    empty text, and one of fewer than n words, has no spans. An empty table gives no rows. Other columns are
    not read. Exact: spans are verified and none is missed.
    df has to be a scan or otherwise give the same rows
    when a task runs again.
    """
    docs = slim(df, id_col, text_col).where("text IS NOT NULL")
    parts = census.parts_for(docs)
    revealed = census.told(census.sent(docs, lambda data, at: _names(data, at, n), parts))
    suspects = revealed.groupBy("chunk").applyInArrow(lambda t: _suspects(t, parts, n), census.SENT)
    verified = census.told(suspects)
    return verified.groupBy("chunk").applyInArrow(lambda t: _repeats(t, n), "doc_id long, start_word long, end_word long, n_words long")
