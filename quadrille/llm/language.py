"""Language ID by string kernels.

The kernel of two texts is the blended spectrum of their n-grams of one to three
bytes: how many of each length both have, over the geometric mean of how many
each has, averaged over the lengths. N-grams count once a text. Nyström: texts are described by their
kernels with a set of landmark texts, whitened by the landmarks' own kernels; on that, ridge regressions of one language against the rest are fitted. Scoring
a batch is one product of its n-gram presence with the landmarks' and one with the weights.

Fitting takes a bounded sample; everything else is done in one pass without a shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrille.llm import text as X
from quadrille.llm.cluster import batches, slim

#: Labelled rows that are fitted on, at most about so many of each language, and landmarks among them; EACH of each language at least.
PER_LANGUAGE, LANDMARKS, EACH = 400, 128, 2
#: Languages with fewer labelled rows are left out, unless told otherwise.
FEWEST = 5
RIDGE = 1e-2
LENGTHS = (1, 2, 3)

#: Letters in lower case, bytes of non-ASCII characters, and 0 for all others.
_CODE = np.zeros(256, np.int64)
_CODE[97:123] = np.arange(1, 27)
_CODE[65:91] = np.arange(1, 27)
_CODE[128:] = np.arange(27, 155)
_BASE = 155
#: Numbers in the presence of the texts that are scored at once.
_CELLS = 1 << 24


def codes(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Text number and code of each letter; what lies between words counts as one."""
    code = _CODE[data]
    owner = np.repeat(np.arange(len(at) - 1), np.diff(at))
    keep = np.ones(len(code), bool)
    keep[1:] = (code[1:] != 0) | (code[:-1] != 0) | (owner[1:] != owner[:-1])
    return owner[keep], code[keep]


def grams(owner: np.ndarray, code: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Text number and n-gram at each place; n-grams of nothing but a gap are none."""
    total = np.zeros(max(0, len(code) - n + 1), np.int64)
    for k in range(n):
        total = total * _BASE + code[k : len(code) - n + 1 + k]
    inside = (owner[: len(total)] == owner[n - 1 :]) & (total > 0)
    return owner[: len(total)][inside], total[inside]


@dataclass
class Model:
    """known: the n-grams of each length that some landmark has; landmarks: their presence, scaled; weights and bias of each language."""

    languages: list[str]
    known: list[np.ndarray]
    landmarks: list[np.ndarray]
    weights: np.ndarray
    bias: np.ndarray

    def rows(self) -> int:
        """Texts that are scored at once."""
        return max(1, _CELLS // max(1, sum(map(len, self.known))))

    def tables(self) -> list[np.ndarray]:
        out = []
        for n, known in zip(LENGTHS, self.known):
            table = np.full(_BASE**n, -1, np.int32)
            table[known] = np.arange(len(known))
            out.append(table)
        return out


def presence(data: np.ndarray, at: np.ndarray, tables: list[np.ndarray], known: list[np.ndarray]) -> list[np.ndarray]:
    """For each length, which known n-grams each text has, over the root of how many n-grams, known or not, it has."""
    owner, code = codes(data, at)
    out = []
    for n, table, own in zip(LENGTHS, tables, known):
        o, g = grams(owner, code, n)
        o, g = np.divmod(np.unique(o * _BASE**n + g), _BASE**n)
        place = table[g]
        p = np.zeros((len(at) - 1, len(own)), np.float32)
        p[o[place >= 0], place[place >= 0]] = 1
        p /= np.sqrt(np.maximum(np.bincount(o, minlength=len(at) - 1), 1)).astype(np.float32)[:, None]
        out.append(p)
    return out


def kernel(a: list[np.ndarray], b: list[np.ndarray]) -> np.ndarray:
    return sum(x @ y.T for x, y in zip(a, b)) / len(LENGTHS)


def fit(texts: pa.Array, labels: np.ndarray, landmarks: int = LANDMARKS, ridge: float = RIDGE) -> Model:
    """Landmarks are taken from all languages by turns, in the order of the rows, at least EACH from each."""
    languages, which = np.unique(labels, return_inverse=True)
    rank = np.zeros(len(which), np.int64)
    for c in range(len(languages)):
        rank[which == c] = np.arange((which == c).sum())
    chosen = np.lexsort((which, rank))[: max(landmarks, EACH * len(languages))]
    data, at = X.utf8(texts.take(pa.array(chosen)))
    owner, code = codes(data, at)
    known = [np.unique(grams(owner, code, n)[1]) for n in LENGTHS]
    model = Model(languages.tolist(), known, [], np.zeros(0), np.zeros(0))
    tables = model.tables()
    model.landmarks = presence(data, at, tables, known)
    own = kernel(model.landmarks, model.landmarks).astype(np.float64)
    value, vector = np.linalg.eigh(own)
    good = value > 1e-6 * max(value.max(), 1e-12) if len(value) else value > 0
    white = vector[:, good] / np.sqrt(value[good])
    rows = [kernel(presence(d, a, tables, known), model.landmarks) for _, _, d, a in X.chunks(texts, rows=model.rows())]
    feature = np.concatenate(rows).astype(np.float64) @ white
    target = np.where(which[:, None] == np.arange(len(languages)), 1.0, -1.0)
    # Every language weighs the same.
    weight = 1.0 / np.bincount(which)[which]
    weight /= weight.sum()
    mean, middle = weight @ feature, weight @ target
    f, t = feature - mean, target - middle
    beta = np.linalg.solve((f * weight[:, None]).T @ f + ridge / max(1, len(f)) * np.eye(f.shape[1]), (f * weight[:, None]).T @ t)
    model.weights = (white @ beta).astype(np.float32)
    model.bias = (middle - mean @ beta).astype(np.float32)
    return model


def score(model: Model, tables: list[np.ndarray], data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The score of each language for each text, and whether the text has a known n-gram."""
    p = presence(data, at, tables, model.known)
    return kernel(p, model.landmarks) @ model.weights + model.bias, sum(x.any(axis=1) for x in p) > 0


def _identified(batches_: Iterator[pa.RecordBatch], model: Model) -> Iterator[pa.RecordBatch]:
    tables, names = model.tables(), np.array(model.languages, object)
    for batch in batches_:
        ids = batch.column("doc_id")
        for lo, hi, data, at in X.chunks(batch.column("text"), rows=model.rows()):
            s, known = score(model, tables, data, at)
            order = np.sort(s, axis=1)
            best = s.argmax(axis=1)
            margin = order[:, -1] - order[:, -2] if s.shape[1] > 1 else order[:, -1]
            columns = [pa.array(names[best], pa.string(), mask=~known), *[pa.array(np.round(x.astype(np.float64), 4), mask=~known) for x in (order[:, -1], margin)]]
            yield pa.RecordBatch.from_arrays([ids[lo:hi], *columns], ["doc_id", "language", "score", "margin"])


def sample(df: DataFrame, text_col: str, label_col: str, per_language: int, fewest: int = FEWEST) -> pa.Table:
    """Texts and labels of about per_language rows of each language, by a hash of the text, in an order that depends on nothing else."""
    rows = df.select(F.col(text_col).cast("string").alias("text"), F.col(label_col).cast("string").alias("label")).where("text IS NOT NULL AND label IS NOT NULL")
    counts = rows.groupBy("label").count().where(F.col("count") >= fewest).orderBy(F.desc("count"), "label").collect()
    if not counts:
        return pa.table({"text": pa.array([], pa.string()), "label": pa.array([], pa.string())})
    share = F.create_map(*[x for r in counts for x in (F.lit(r["label"]), F.lit(min(1.0, per_language / r["count"])))])
    part = F.pmod(F.xxhash64("text"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    chosen = rows.where(part < F.element_at(share, F.col("label")))
    return chosen.orderBy(F.xxhash64("text", F.lit(1)), "label").toArrow()


def identify(df: DataFrame, labelled: DataFrame | None = None, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang", per_language: int = PER_LANGUAGE, landmarks: int = LANDMARKS, fewest: int = FEWEST) -> DataFrame:
    """One row for each row of df: (doc_id, language, score, margin), by a classifier fitted on labelled, or on df itself.

    margin is how far the score is above the second best; of equal scores the first language by name counts. A text without any letter that the landmarks know, a
    null and an empty text have a null language. Fitting uses about per_language rows of each label, chosen by a
    hash of their texts; rows with a null text or label are not among them, and labels of fewer than ``fewest`` rows are
    not learned. All other labels are, however many: there are ``landmarks`` landmarks, or EACH for each label if that is
    more, and the driver's memory grows with labels times landmarks. Without any label to learn all languages are null. Null and repeated ids stay. An empty table gives
    no rows. Other columns are not read.
    """
    spark = df.sparkSession
    batches(spark)
    docs = slim(df, id_col, text_col)
    rows = sample(labelled if labelled is not None else df, text_col, label_col, per_language, fewest)
    if not rows.num_rows:
        return docs.select("doc_id", F.lit(None).cast("string").alias("language"), F.lit(None).cast("double").alias("score"), F.lit(None).cast("double").alias("margin"))
    model = spark.sparkContext.broadcast(fit(rows.column("text").combine_chunks(), np.array(rows.column("label").to_pylist(), object), landmarks))
    return docs.mapInArrow(lambda b: _identified(b, model.value), "doc_id long, language string, score double, margin double")
