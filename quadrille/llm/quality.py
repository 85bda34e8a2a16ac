"""Quality rules: how much of a text lies in repeated n-grams and lines.

Rolling hashes over the words give every n-gram of several lengths, each length's from
those of the length before by one word more; an
occurrence is a duplicate if the same n-gram has started earlier in the same
text. The rules compare the share of characters inside duplicates with
limits that get stricter as the n-grams get longer. One pass, no shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.cluster import batches

#: Largest share of a text's word characters inside duplicate n-grams, by length.
DUPLICATE = {5: 0.15, 6: 0.14, 7: 0.13, 8: 0.12, 9: 0.11, 10: 0.10}
#: Largest share inside the most frequent n-gram, if it occurs more than once.
TOP = {2: 0.20, 3: 0.18, 4: 0.16}
#: Largest shares of lines, and of their characters, that repeat an earlier line.
LINES, LINE_CHARS = 0.30, 0.20
#: Largest share of characters that are neither letters, digits nor white space.
SYMBOLS = 0.25
#: Largest mean word length, in characters, and least number of words.
LONG_WORD, FEW_WORDS = 25.0, 1
#: The rules on top n-grams hold only from this number of words on; in shorter texts any two equal pairs would pass the limit.
TOP_FROM = 20

_SYMBOL = np.zeros(256, bool)
for _a, _b in ((33, 48), (58, 65), (91, 97), (123, 127)):
    _SYMBOL[_a:_b] = True

MEASURES = [f"dup_{n}" for n in DUPLICATE] + [f"top_{n}" for n in TOP] + ["dup_lines", "dup_line_chars", "symbols", "word_length"]


def _earlier(doc: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each item, whether the same value is earlier in its text, and the number of its equals there."""
    if not len(value):
        return np.zeros(0, bool), np.zeros(0, np.int64)
    key = value ^ X.mix(doc.astype(X.U64) + X.U64(1))
    order = np.argsort(key)
    key = key[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    starts = np.flatnonzero(new)
    count = np.diff(np.append(starts, len(key)))
    seen, equal = np.empty(len(key), bool), np.empty(len(key), np.int64)
    seen[order] = order != np.repeat(np.minimum.reduceat(order, starts), count)
    equal[order] = np.repeat(count, count)
    return seen, equal


def measure(data: np.ndarray, at: np.ndarray) -> dict[str, np.ndarray]:
    """The measures of each text of a chunk."""
    n = len(at) - 1
    doc, start, end = X.spans(data, at, spaced=True)
    # Characters before each byte: bytes that do not continue a character.
    before = np.concatenate(([0], np.cumsum((data & 0xC0) != 0x80)))
    length = before[end] - before[start]
    word = X.fingerprints(data, start, end)
    count = np.bincount(doc, minlength=n)
    chars = np.bincount(doc, weights=length, minlength=n)
    per = np.maximum(chars, 1)
    out = {"n_words": count, "word_length": chars / np.maximum(count, 1)}
    upto = np.concatenate(([0], np.cumsum(length)))
    # An n-gram can only be repeated where its first n - 1 words are, so each length looks at what the one before left.
    where, rolled = np.arange(len(word)), word
    for k in range(2, max(*DUPLICATE, *TOP) + 1):
        inside = where + k <= len(word)
        inside[inside] = doc[where[inside]] == doc[where[inside] + k - 1]
        where = where[inside]
        rolled = X.longer(rolled[inside], word[where + k - 1])
        owner = doc[where]
        seen, equal = _earlier(owner, X.mix(rolled))
        if k in DUPLICATE:
            later = where[seen]
            step = np.bincount(later, minlength=len(word) + 1) - np.bincount(later + k, minlength=len(word) + 1)
            inside = np.cumsum(step[:-1]) > 0
            out[f"dup_{k}"] = np.bincount(doc[inside], weights=length[inside], minlength=n) / per
        if k in TOP:
            # The n-gram that fills the most characters among those that occur most often.
            size = (upto[where + k] - upto[where]) * equal
            best, most = np.zeros(n, np.int64), np.zeros(n, np.int64)
            many = equal > 1
            np.maximum.at(most, owner[many], equal[many])
            top = many & (equal == most[owner])
            np.maximum.at(best, owner[top], size[top])
            out[f"top_{k}"] = np.minimum(1.0, best / per)
        again = equal > 1
        where, rolled = where[again], rolled[again]
    line = data == 10
    bounds = np.unique(np.concatenate((at, np.flatnonzero(line), np.flatnonzero(line) + 1)))
    first, last = bounds[:-1], bounds[1:]
    some = ~line[first] if len(first) else np.zeros(0, bool)
    first, last = first[some], last[some]
    owner = np.searchsorted(at, first, side="right") - 1
    size = before[last] - before[first]
    seen, _ = _earlier(owner, X.fingerprints(data, first, last, lower=False))
    total = np.maximum(np.bincount(owner, minlength=n), 1)
    all_chars = np.maximum(np.bincount(owner, weights=size, minlength=n), 1)
    out["dup_lines"] = np.bincount(owner[seen], minlength=n) / total
    out["dup_line_chars"] = np.bincount(owner[seen], weights=size[seen], minlength=n) / all_chars
    mark = np.concatenate(([0], np.cumsum(_SYMBOL[data])))
    out["symbols"] = (mark[at[1:]] - mark[at[:-1]]) / np.maximum(before[at[1:]] - before[at[:-1]], 1)
    return out


def verdict(m: dict[str, np.ndarray]) -> list[np.ndarray]:
    """The broken rules of each text: (name, where it is broken)."""
    rules = [(f"dup_{k}", m[f"dup_{k}"] > most) for k, most in DUPLICATE.items()]
    rules += [(f"top_{k}", (m[f"top_{k}"] > most) & (m["n_words"] >= TOP_FROM)) for k, most in TOP.items()]
    rules += [("dup_lines", m["dup_lines"] > LINES), ("dup_line_chars", m["dup_line_chars"] > LINE_CHARS), ("symbols", m["symbols"] > SYMBOLS), ("word_length", m["word_length"] > LONG_WORD), ("few_words", m["n_words"] < FEW_WORDS)]
    return rules


def _rows(batches_: Iterator[pa.RecordBatch], id_col: str, text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        ids = batch.column(batch.schema.get_field_index(id_col))
        for lo, hi, data, at in X.chunks(batch.column(batch.schema.get_field_index(text_col))):
            m = measure(data, at)
            rules = verdict(m)
            broken = np.array([bad for _, bad in rules])
            names = np.array([name for name, _ in rules])
            reasons = ["|".join(names[broken[:, i]]) if broken[:, i].any() else "" for i in range(hi - lo)]
            columns = [ids[lo:hi], pa.array(m["n_words"].astype(np.int64))] + [pa.array(m[k].astype(np.float64)) for k in MEASURES] + [pa.array(~broken.any(axis=0)), pa.array(reasons)]
            yield pa.RecordBatch.from_arrays(columns, ["doc_id", "n_words", *MEASURES, "keep", "reasons"])


def repetition(df: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row of df: its id, its measures, keep, and the broken rules, joined by ``|``.

    A null, empty or blank text has no words and is rejected as ``few_words``, with all measures 0. A null id
    stays null. Repeated ids give repeated rows. An empty table gives no rows. Other columns are not read, so
    their names cannot clash. Texts are measured whole, whatever their length; the rules on top_2 to top_4, and
    these alone, hold from TOP_FROM words on. Of n-grams that are equally frequent the one with the most characters counts.
    """
    batches(df.sparkSession)
    schema = ", ".join(["doc_id long", "n_words long", *(f"{k} double" for k in MEASURES), "keep boolean", "reasons string"])
    slim = df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return slim.mapInArrow(lambda b: _rows(b, "doc_id", "text"), schema)


def _passing(batches_: Iterator[pa.RecordBatch], text_col: str) -> Iterator[pa.RecordBatch]:
    for batch in batches_:
        column = batch.column(batch.schema.get_field_index(text_col))
        keep = [~np.array([bad for _, bad in verdict(measure(data, at))]).any(axis=0) for _, _, data, at in X.chunks(column)]
        if keep:
            yield batch.filter(pa.array(np.concatenate(keep)))


def passing(df: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of df whose text breaks no rule, with all their columns; null and blank texts go."""
    batches(df.sparkSession)
    return df.mapInArrow(lambda b: _passing(b, text_col), df.schema)
