"""SentencePiece encoding and decoding for merge-type vocabularies.

A text's characters are merged pair by pair, the pair whose piece has the highest
score first and the leftmost of equal ones. The agenda of pairs is kept per unit,
and units are cut wherever two characters stand next to each other that do so in no
piece, across which nothing can merge. Each distinct unit of an Arrow batch is encoded
once: short ones side by side, with the agendas of all of them in one array of
which every round takes each unit's best pair, and long ones with a heap of their
own. The sentencepiece library encodes the same texts whole, batch by batch, and each
text says whether both agree.
"""

from __future__ import annotations

import heapq
from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.census import gathered
from quadrille.llm.cluster import batches, slim

U64 = np.uint64
#: Where the vocabulary lies unless told otherwise.
MODEL = "/opt/tokenizers/piece_bpe_32k.model"
#: Symbols of the longest unit that is encoded side by side with others.
SHORT = 48
_SPACE = 0x2581
_NEVER = np.iinfo(np.int64).max

_CODES = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("agrees", pa.bool_()), ("round_trip", pa.bool_())])


class Vocabulary:
    """The pieces of a model file, as tables."""

    def __init__(self, model: bytes):
        self.library = sentencepiece.SentencePieceProcessor(model_proto=model)
        if self.library.encode("ﬁ  x ") != self.library.encode("ﬁ  x ", add_bos=False) or self.library.decode(self.library.encode(" ﬁ  x ")) != " ﬁ  x ":
            raise ValueError("only vocabularies that keep the text as it is are supported")
        n = self.library.get_piece_size()
        pieces = [self.library.id_to_piece(i) for i in range(n)]
        kind = [(self.library.is_control(i), self.library.is_byte(i), self.library.is_unknown(i), self.library.is_unused(i)) for i in range(n)]
        normal = [i for i in range(n) if not any(kind[i])]
        self.unknown = self.library.unk_id()
        number = {pieces[i]: i for i in normal}
        # Characters that are parts of pieces but no pieces themselves get numbers beyond.
        for c in sorted({c for i in normal for c in pieces[i]} - number.keys()):
            number[c] = max(n, len(number) - len(normal) + n)
        self.size = max(number.values()) + 1
        self.char = np.full(0x110000, -1, np.int32)
        for text, i in number.items():
            if len(text) == 1:
                self.char[ord(text)] = i
        pairs = {}
        for i in normal:
            for k in range(1, len(pieces[i])):
                a, b = number.get(pieces[i][:k]), number.get(pieces[i][k:])
                if a is not None and b is not None:
                    pairs[a * self.size + b] = i
        self.pair = np.array(sorted(pairs), np.int64)
        self.merged = np.array([pairs[p] for p in self.pair.tolist()], np.int64)
        score = np.array([self.library.get_score(i) for i in self.merged.tolist()])
        self.rank = np.unique(-score, return_inverse=True)[1].astype(np.int64)
        self.table = dict(zip(self.pair.tolist(), zip(self.rank.tolist(), self.merged.tolist())))
        inner = sorted({c for i in normal if len(pieces[i]) > 1 for c in pieces[i]})
        self.kind = np.zeros(0x110000, np.int16)
        self.kind[[ord(c) for c in inner]] = np.arange(1, len(inner) + 1)
        self.beside = np.zeros((len(inner) + 1, len(inner) + 1), bool)
        for i in normal:
            k = self.kind[[ord(c) for c in pieces[i]]]
            self.beside[k[:-1], k[1:]] = True
        self.byte = np.zeros(256, np.int32)
        out = []
        for i in range(n):
            if kind[i][1]:
                self.byte[int(pieces[i][3:-1], 16)] = i
                out.append(bytes([int(pieces[i][3:-1], 16)]))
            else:
                out.append(b"" if kind[i][0] else " ⁇ ".encode() if kind[i][2] else pieces[i].replace("▁", " ").encode())
        self.fallback = any(k[1] for k in kind)
        self.bytes = np.frombuffer(b"".join(out), np.uint8)
        self.at = np.concatenate(([0], np.cumsum([len(x) for x in out])))

    def _rest(self, symbol: int, code: int) -> list[int]:
        """The ids of a symbol that may be no piece."""
        if 0 <= symbol < len(self.at) - 1:
            return [symbol]
        return [int(self.byte[b]) for b in chr(code).encode()] if self.fallback else [self.unknown]

    def agenda(self, symbols: list[int]) -> list[tuple[int, int]]:
        """Places and symbols that a unit's symbols are merged to, with a heap of pairs."""
        n, symbols = len(symbols), list(symbols)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int, int]] = []

        def offer(i: int, j: int) -> None:
            if i >= 0 and j < n and symbols[i] >= 0 and symbols[j] >= 0 and (found := self.table.get(symbols[i] * self.size + symbols[j])):
                heapq.heappush(heap, (found[0], i, j, symbols[i], symbols[j]))

        for i in range(n - 1):
            offer(i, i + 1)
        while heap:
            _, i, j, a, b = heapq.heappop(heap)
            if symbols[i] != a or symbols[j] != b or after[i] != j:
                continue
            symbols[i], symbols[j] = self.table[a * self.size + b][1], -2
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i], i)
            offer(i, after[i])
        return [(i, s) for i, s in enumerate(symbols) if s != -2]

    def _together(self, symbol: np.ndarray, unit: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places and symbols that the symbols of short units are merged to."""
        place = np.arange(len(symbol))
        done: list[tuple[np.ndarray, np.ndarray]] = []
        while len(symbol):
            key = symbol[:-1].astype(np.int64) * self.size + symbol[1:]
            key[(unit[:-1] != unit[1:]) | (symbol[:-1] < 0) | (symbol[1:] < 0)] = -1
            at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
            value = np.full(len(symbol), _NEVER)
            hit = np.flatnonzero(self.pair[at] == key)
            value[hit] = (self.rank[at[hit]] << 32) | hit
            head = np.flatnonzero(np.concatenate(([True], unit[1:] != unit[:-1])))
            best = np.minimum.reduceat(value, head)
            open_ = best != _NEVER
            left = (best[open_] & 0xFFFFFFFF).astype(np.int64)
            symbol[left] = self.merged[at[left]]
            stays = np.repeat(open_, np.diff(np.append(head, len(symbol))))
            done.append((place[~stays], symbol[~stays]))
            stays[left + 1] = False
            place, symbol, unit = place[stays], symbol[stays], unit[stays]
        if not done:
            return place, symbol
        where, what = np.concatenate([d[0] for d in done]), np.concatenate([d[1] for d in done])
        order = np.argsort(where)
        return where[order], what[order]

    def units(self, codes: np.ndarray, start: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of units of characters, one after another, and the number of ids of each."""
        size = end - start
        where: list[np.ndarray] = []
        what: list[np.ndarray] = []
        short = np.flatnonzero(size <= SHORT)
        if len(short):
            n = size[short]
            place = np.repeat(start[short] - (np.cumsum(n) - n), n) + np.arange(n.sum())
            at, symbol = self._together(self.char[codes[place]].copy(), np.repeat(short, n))
            where.append(place[at])
            what.append(symbol)
        for u in np.flatnonzero(size > SHORT):
            found = self.agenda(self.char[codes[start[u] : end[u]]].tolist())
            where.append(np.array([i for i, _ in found]) + start[u])
            what.append(np.array([s for _, s in found], np.int32))
        if not where:
            return np.zeros(0, np.int32), np.zeros(len(start), np.int64)
        place, symbol = np.concatenate(where), np.concatenate(what).astype(np.int32)
        order = np.argsort(place)
        place, symbol = place[order], symbol[order]
        count = np.ones(len(place), np.int64)
        odd = np.flatnonzero((symbol < 0) | (symbol >= len(self.at) - 1))
        if len(odd):
            rest = [self._rest(int(symbol[i]), int(codes[place[i]])) for i in odd]
            count[odd] = [len(r) for r in rest]
            ids = np.repeat(symbol, count)
            first = np.cumsum(count) - count
            for i, r in zip(odd, rest):
                ids[first[i] : first[i] + len(r)] = r
        else:
            ids = symbol
        of = np.searchsorted(start, place, side="right") - 1
        return ids, np.bincount(of, weights=count, minlength=len(start)).astype(np.int64)

    def encode(self, texts: list[str], check: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, the number of ids of each, and whether the library agrees."""
        size = np.array([len(t) + 1 if t else 0 for t in texts], np.int64)
        whole = "".join("▁" + t for t in texts if t)
        if not whole:
            return np.zeros(0, np.int32), np.zeros(len(texts), np.int64), np.ones(len(texts), bool)
        codes = np.frombuffer(whole.encode("utf-32-le"), np.uint32).copy()
        codes[codes == 32] = _SPACE
        kind = self.kind[codes]
        cut = np.concatenate(([True], ~self.beside[kind[:-1], kind[1:]]))
        first = np.cumsum(size) - size
        cut[first[size > 0]] = True
        start = np.flatnonzero(cut)
        end = np.append(start[1:], len(codes))
        total = np.zeros(len(codes) + 1, U64)
        np.cumsum((codes.astype(U64) + U64(1)) * X.powers(len(codes)), out=total[1:])
        name = X.mix((total[end] - total[start]) * X.powers(len(codes) + 1, inverse=True)[start])
        _, one, which = np.unique(name, return_index=True, return_inverse=True)
        order = np.argsort(one)
        back = np.empty(len(one), np.int64)
        back[order] = np.arange(len(one))
        one, which = one[order], back[which]
        ids, count = self.units(codes, start[one], end[one])
        offset = np.concatenate(([0], np.cumsum(count)))
        each = count[which]
        out = ids[np.repeat(offset[which] - (np.cumsum(each) - each), each) + np.arange(each.sum())]
        of = np.searchsorted(first + size, start, side="right")
        of = np.bincount(of, weights=each, minlength=len(texts)).astype(np.int64)
        return out, of, self.agrees(texts, out, of) if check else np.ones(len(texts), bool)

    def agrees(self, texts: list[str], ids: np.ndarray, count: np.ndarray) -> np.ndarray:
        """Whether the library gives each text, as a whole, these ids."""
        theirs = self.library.encode(texts, out_type=int, num_threads=1)
        same = np.array([len(t) for t in theirs], np.int64) == count
        at = np.concatenate(([0], np.cumsum(count)))
        if same.all():
            differs = np.flatnonzero(np.fromiter(chain.from_iterable(theirs), np.int32, len(ids)) != ids)
            same[np.searchsorted(at, differs, side="right") - 1] = False
            return same
        return np.array([t == ids[at[i] : at[i + 1]].tolist() for i, t in enumerate(theirs)], bool)

    def decode(self, ids: np.ndarray, count: np.ndarray) -> list[bytes]:
        """The bytes of texts, given their ids one after another."""
        size = (self.at[1:] - self.at[:-1])[ids]
        flat = self.bytes[np.repeat(self.at[ids] - (np.cumsum(size) - size), size) + np.arange(size.sum())].tobytes()
        ends = np.concatenate(([0], np.cumsum(size)))[np.concatenate(([0], np.cumsum(count)))]
        # The space that encoding puts before a text goes.
        return [x[1:] if (x := flat[a:b])[:1] == b" " else x for a, b in zip(ends[:-1].tolist(), ends[1:].tolist())]


_kept: dict[int, Vocabulary] = {}


def vocabulary(model: bytes) -> Vocabulary:
    """The tables of a model, made once in a process."""
    key = hash(model)
    if key not in _kept:
        _kept.clear()
        _kept[key] = Vocabulary(model)
    return _kept[key]


def _encoded(batches_: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model)
    for batch in gathered(batches_, 2 << 20):
        column = batch.column("text")
        null = column.is_null().to_numpy(zero_copy_only=False)
        texts = [t or "" for t in column.to_pylist()]
        ids, count, agrees = v.encode(texts)
        trip = np.array([a == b.encode() for a, b in zip(v.decode(ids, count), texts)], bool)
        lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(count))), pa.int32()), pa.array(ids, pa.int32()), mask=pa.array(null))
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(count, mask=null), lists, pa.array(agrees, mask=null), pa.array(trip, mask=null)], schema=_CODES)


def encode(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", model: str = MODEL) -> DataFrame:
    """One row for each row of df: (doc_id, n_tokens, ids, agrees, round_trip).

    agrees: the library gives the text, encoded as a whole, the same ids. round_trip: decoding gives the text back,
    which only a text with the character U+2581, which stands for spaces, lacks. An empty text has no ids. A null
    text has nulls. Null and repeated ids stay. An empty table gives no rows. Other columns are not read. The model
    file is read on the driver and sent to the executors, being of fixed size.
    """
    spark = df.sparkSession
    batches(spark)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    return slim(df, id_col, text_col).mapInArrow(lambda b: _encoded(b, shared.value), "doc_id long, n_tokens long, ids array<int>, agrees boolean, round_trip boolean")


def _decoded(batches_: Iterator[pa.RecordBatch], model: bytes) -> Iterator[pa.RecordBatch]:
    v = vocabulary(model)
    for batch in batches_:
        lists = batch.column("ids")
        null = lists.is_null().to_numpy(zero_copy_only=False)
        count = lists.value_lengths().fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
        # flatten() leaves out what lies under nulls.
        ids = lists.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        texts = [None if n else t.decode(errors="replace") for t, n in zip(v.decode(ids, count), null)]
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])


def decode(df: DataFrame, id_col: str = "doc_id", ids_col: str = "ids", model: str = MODEL) -> DataFrame:
    """(doc_id, text) for each row of df, from its ids; bytes that are no UTF-8 become U+FFFD, null ids a null text."""
    spark = df.sparkSession
    batches(spark)
    with open(model, "rb") as f:
        shared = spark.sparkContext.broadcast(f.read())
    slim_ = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(ids_col).cast("array<int>").alias("ids"))
    return slim_.mapInArrow(lambda b: _decoded(b, shared.value), "doc_id long, text string")
