"""Arrow text batches as flat numpy arrays: chunks, words, hashes, n-grams.

A word is a maximal run of ASCII letters and digits or bytes of non-ASCII
characters; ASCII letters count as lower case. Nulls are empty texts. Word
hashes are polynomial fingerprints modulo 2**64, finished with a mixer; equal
words have equal hashes everywhere, so the hashes are names that all executors
agree on without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that one chunk holds, unless a single text is longer.
CHUNK = 1 << 20

U64 = np.uint64
_BASE = U64(0x9E3779B97F4A7C15)
_INV = U64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))

_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_WORD = np.zeros(256, dtype=bool)
for _a, _b in ((48, 58), (65, 91), (97, 123), (128, 256)):
    _WORD[_a:_b] = True
_SPACE = np.zeros(256, dtype=bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True

_powers: dict[str, np.ndarray] = {}


def powers(n: int, inverse: bool = False) -> np.ndarray:
    """The first n powers of the base or of its inverse, modulo 2**64."""
    key = "inverse" if inverse else "base"
    kept = _powers.get(key)
    if kept is None or len(kept) < n:
        size = max(CHUNK + 65536, n)
        steps = np.full(size, _INV if inverse else _BASE, dtype=U64)
        steps[0] = 1
        made = np.cumprod(steps, dtype=U64)
        if size > 4 * CHUNK:
            return made
        kept = _powers[key] = made
    return kept[:n]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x ^= x >> U64(27)
    x *= U64(0x94D049BB133111EB)
    x ^= x >> U64(31)
    return x


_SCRAMBLED = mix(np.arange(1, 257, dtype=U64) * _BASE)


def utf8(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a string column and the n + 1 offsets into them."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if not pa.types.is_large_string(column.type):
        column = column.cast(pa.large_string())
    if column.null_count:
        column = pc.fill_null(column, "")
    n = len(column)
    _, offsets, values = column.buffers()
    if not n or offsets is None:
        return np.zeros(0, np.uint8), np.zeros(n + 1, np.int64)
    at = np.frombuffer(offsets, dtype=np.int64)[column.offset : column.offset + n + 1]
    data = np.frombuffer(values, dtype=np.uint8) if values is not None and values.size else np.zeros(0, np.uint8)
    return data[at[0] : at[-1]], at - at[0]


def chunks(column: pa.Array, size: int = CHUNK, rows: int = 1 << 20) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Runs of whole texts of about the given number of bytes, and at most so many rows: first, end, bytes, offsets."""
    data, at = utf8(column)
    lo, n = 0, len(at) - 1
    while lo < n:
        hi = min(lo + rows, max(lo + 1, int(np.searchsorted(at, at[lo] + size, side="right")) - 1))
        yield lo, hi, data[at[lo] : at[hi]], at[lo : hi + 1] - at[lo]
        lo = hi


def runs(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the runs of true values."""
    edges = np.flatnonzero(np.diff(np.concatenate(([False], flags, [False])).view(np.int8)))
    return edges[::2], edges[1::2]


def spans(data: np.ndarray, at: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start and end of each word; spaced: of each run of non-space bytes."""
    inside = ~_SPACE[data] if spaced else _WORD[data]
    cut = at[1:-1]
    cut = cut[(cut > 0) & (cut < len(data))]
    if len(cut) and len(data):
        # A word never runs over the end of a text: split those that touch one.
        touching = np.unique(cut[inside[cut - 1] & inside[cut]])
    else:
        touching = cut[:0]
    start, end = runs(inside)
    if len(touching):
        start, end = np.sort(np.concatenate((start, touching))), np.sort(np.concatenate((end, touching)))
    return np.searchsorted(at, start, side="right") - 1, start, end


def fingerprints(data: np.ndarray, start: np.ndarray, end: np.ndarray, lower: bool = True, second: bool = False) -> np.ndarray:
    """A 64-bit fingerprint of each span of bytes; second: another one, independent of the first."""
    if not len(start):
        return np.zeros(0, U64)
    total = np.zeros(len(data) + 1, U64)
    # Every byte counts by one more, so that leading zero bytes matter too.
    value = _LOWER[data] if lower else data
    np.cumsum((_SCRAMBLED[value] if second else value.astype(U64) + U64(1)) * powers(len(data)), out=total[1:])
    return mix((total[end] - total[start]) * powers(len(data) + 1, inverse=True)[start])


def words(data: np.ndarray, at: np.ndarray, spaced: bool = False) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Text number, start, end and fingerprint of each word."""
    doc, start, end = spans(data, at, spaced)
    return doc, start, end, fingerprints(data, start, end)


def grams(doc: np.ndarray, word: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Where an n-gram within one text starts, as positions among the words, and its hash."""
    m = len(word) - n + 1
    if m <= 0:
        return np.zeros(0, np.int64), np.zeros(0, U64)
    where = np.flatnonzero(doc[:m] == doc[n - 1 :])
    return where, rolled(word, where, n)


def longer(total: np.ndarray, word: np.ndarray) -> np.ndarray:
    """n-grams with a word more, before they are mixed."""
    return total * _BASE + word


def rolled(word: np.ndarray, where: np.ndarray, n: int) -> np.ndarray:
    """The hashes of the n-grams that start at the given words."""
    total = word[where]
    for k in range(1, n):
        total = longer(total, word[where + k])
    return mix(total)


def shingles(data: np.ndarray, at: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """The distinct word n-grams of each text: text numbers, in order, and hashes, ascending within each text.

    A text of fewer than n words, but at least one, has all its words together as its single n-gram.
    """
    doc, _, _, word = words(data, at)
    where, gram = grams(doc, word, n)
    owner = doc[where]
    count = np.bincount(doc, minlength=len(at) - 1)
    short = np.flatnonzero((count > 0) & (count < n))
    if len(short):
        first = np.searchsorted(doc, short)
        extra = np.zeros(len(short), U64)
        for k in range(n - 1):
            more = count[short] > k
            extra = np.where(more, extra * _BASE + word[np.minimum(first + k, len(word) - 1)], extra)
        owner, gram = np.concatenate((owner, short)), np.concatenate((gram, mix(extra + U64(n))))
    order = np.lexsort((gram, owner))
    owner, gram = owner[order], gram[order]
    new = np.ones(len(gram), bool)
    new[1:] = (gram[1:] != gram[:-1]) | (owner[1:] != owner[:-1])
    return owner[new], gram[new]
