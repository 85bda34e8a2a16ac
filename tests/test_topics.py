import math
import random

import pytest
from pyspark.sql import functions as F

from quadrille.functions import text
from quadrille.functions.grid import Cartesian, TimeRange
from quadrille.operators import lda, topics
from quadrille.operators.tiling import BIN

SCHEMA = "x double, y double, t long, words array<string>"


def listed(df, keys=BIN):
    return {tuple(r)[: len(keys)]: [(t["term"], t["n"]) for t in r["topics"]] for r in df.collect()}


def test_most_frequent_terms(spark):
    df = spark.createDataFrame([(0.1, 0.1, 0, ["b", "b", "c", None]), (0.1, 0.1, 5, ["b", "c", "d", "a"]), (0.9, 0.9, 5, ["z"]), (None, 0.9, 5, ["z"]), (0.9, 0.9, 5, None)], SCHEMA)
    got = listed(topics.topics(df, "x", "y", "words", Cartesian(), [0, 1], 3))
    assert got[(1, 0, 0, 0, 0)] == [("b", 3), ("c", 2), ("a", 1)]
    assert got[(0, 0, 0, 0, 0)] == [("b", 3), ("c", 2), ("a", 1)]
    assert listed(topics.topics(df, "x", "y", "words", Cartesian(), [1], 3, terms=["z"]))[(1, 1, 1, 0, 0)] == [("z", 1)]
    assert (1, 1, 1, 0, 0) not in listed(topics.topics(df, "x", "y", "words", Cartesian(), [1], 3, stop=["z"]))
    times = TimeRange(0, 10, 2)
    got = listed(topics.time_topics(df, "x", "y", "t", "words", Cartesian(), times, [0], 2), [*BIN, "bin_t"])
    assert got == {(0, 0, 0, 0, 0, 0): [("b", 2), ("c", 1)], (0, 0, 0, 0, 0, 1): [("a", 1), ("b", 1)]}
    assert topics.topics(df.limit(0), "x", "y", "words", Cartesian(), [0], 3).count() == 0


def test_texts_are_split(spark):
    df = spark.createDataFrame([("a a  b, c",), ("",), (None,)], "s string")
    assert [r[0] for r in df.select(text.split(F.col("s"))).collect()] == [["a", "a", "b", ",", "c"], [], None]
    poem = "Not, I'll not, carrion comfort, Despair, not feast on thee; 'Tis my my MY o'er"
    df = spark.createDataFrame([(poem,)], "s string")
    words = df.select(text.words(F.col("s"))).first()[0]
    assert words.count("my") == 3 and words.count("not") == 3 and "i'll" in words and "o'er" in words and "tis" in words
    assert df.select(text.without(text.words(F.col("s")), ["not"])).first()[0].count("my") == 3
    assert df.select(text.has_any(text.words(F.col("s")), ["thee"]), text.has_any(text.words(F.col("s")), ["x"]), text.has_any(text.words(F.col("s")), [])).first()[:] == (True, False, True)


@pytest.fixture(scope="module")
def counted(spark):
    rows = [(0.1, 0.1, "common one one"), (0.9, 0.1, "common two"), (0.1, 0.9, "common three three three two"), (0.9, 0.9, "Common")]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    return topics.term_counts(df, "x", "y", "s", Cartesian(), [0, 1]).cache()


def test_dictionary(counted):
    got = {(r["z"], r["term"]): (r["df"], r["docs"]) for r in topics.dictionary(counted).collect()}
    assert got[(1, "common")] == (4, 4) and got[(1, "two")] == (2, 4) and got[(0, "two")] == (1, 1)
    kept = lambda **o: sorted(r["term"] for r in topics.dictionary(counted, **o).where("z = 1").collect())
    assert kept(stop=["Common"]) == ["one", "three", "two"]
    assert kept(least=0.5) == ["common", "two"] and kept(most=50.0) == ["one", "three", "two"]
    assert kept(features=2) == ["common", "two"] and kept(predefined=["one", "x"]) == ["one"]


@pytest.mark.parametrize("tf", ["binary", "raw", "normalized", "sublinear", "double-normalized"])
@pytest.mark.parametrize("idf", ["unary", "linear", "log", "log-smooth", "probabilistic"])
def test_tfidf_by_hand(counted, tf, idf):
    n, total, most, df, docs = 3.0, 5.0, 3.0, 1.0, 4.0
    t = {"binary": 1.0, "raw": n, "normalized": n / total, "sublinear": 1 + math.log(n), "double-normalized": 0.3 + 0.7 * n / most}[tf]
    i = {"unary": 1.0, "linear": docs / df, "log": math.log(docs / df), "log-smooth": math.log(1 + docs / df), "probabilistic": math.log((docs - df) / df)}[idf]
    got = {(r["z"], r["tx"], r["ty"], r["term"]): r["score"] for r in topics.tfidf(counted, 10, tf, idf, 0.3).collect()}
    assert math.isclose(got[(1, 0, 1, "three")], t * i)
    if idf == "log":
        assert all(v == 0 for k, v in got.items() if k[0] == 0)


def test_tfidf_order(counted):
    best = {(r["tx"], r["ty"]): r["term"] for r in topics.tfidf(counted, 1, "raw", "log").where("z = 1").collect()}
    assert best == {(0, 0): "one", (1, 0): "two", (0, 1): "three", (1, 1): "common"}
    worst = {(r["tx"], r["ty"]): r["term"] for r in topics.tfidf(counted, 1, "raw", "log", descending=False).where("z = 1").collect()}
    assert set(worst.values()) == {"common"}


def test_lda(counted):
    made = lda.topics(counted, 2, 3, 1, iterations=3).collect()
    assert len(made) == 5 and all(r["topic"].count("|") == 2 and r["topic"].count("=") == 3 and 0 < r["score"] <= 1 for r in made)
    words = lda.words(counted, 2, 3, 2, iterations=3).collect()
    assert {r["rank"] for r in words} <= {1, 2, 3} and all(r["score"] > 0 for r in words)


def test_lda_of_large_counts(spark):
    """A tile is a vector, whatever its counts: as a list of its words this one had five billion."""
    rows = [(1, x, y, t, n) for x in (0, 1) for y in (0, 1) for t, n in (("a", 3_000_000_000), ("b", 2_000_000_000), (f"only{x}{y}", 1))]
    counted = spark.createDataFrame(rows, "z int, tx int, ty int, term string, n long")
    made = lda.topics(counted, 2, 3, 2, iterations=2).collect()
    assert len(made) == 8 and all(abs(sum(r["score"] for r in made if (r["tx"], r["ty"]) == at) - 1) < 1e-6 for at in ((0, 0), (1, 1)))
    assert {t.partition("=")[0] for r in lda.topics(counted, 2, 3, 1, iterations=2, vocabulary=2).collect() for t in r["topic"].split("|")} == {"a", "b"}
    assert {r["term"] for r in lda.words(counted, 2, 2, 2, iterations=2, stop=["a", "b"]).collect()} <= {"only00", "only01", "only10", "only11"}


def test_lda_vectors(spark):
    """Every tile has its counts by the vocabulary's numbers, also one that has none of its terms."""
    counted = spark.createDataFrame([(1, 0, 0, "b", 2), (1, 0, 0, "a", 5), (1, 0, 0, "x", 1), (1, 1, 0, "x", 3)], "z int, tx int, ty int, term string, n long")
    known = spark.createDataFrame([("a", 0), ("b", 1)], "term string, i int")
    got = {(r["tx"], r["ty"]): (r["features"]["size"], r["features"]["indices"], r["features"]["values"]) for r in lda._bags(counted, known, 2).collect()}
    assert got == {(0, 0): (2, [0, 1], [5.0, 2.0]), (1, 0): (2, [], [])}


def _odd_texts(count):
    rng = random.Random(3)
    some = ["".join(rng.choice("aB'' \n-_9\u0130\u212a\u00e9\u2028\u00c5\U0001f600") for _ in range(rng.randint(0, 14))) for _ in range(count)]
    return [*some, "'", "''", "'''", "a'\n", "a' 'b", "a ''' b'' c", "'Tis o'er", "\ufb01\u0131\u1e9e", "\t\x1c\x85a\x0bb"]


def test_words_in_python(spark):
    """The words that a task counts are those of the expression."""
    some = _odd_texts(3000)
    rows = spark.createDataFrame([(t,) for t in some], "s string").select("s", text.words(F.col("s")).alias("w")).collect()
    assert [(r["s"], r["w"]) for r in rows] == [(r["s"], [w.decode() for w in text.found(r["s"].encode())]) for r in rows]


@pytest.mark.parametrize("levels, bins, held", [([0, 1, 2], 1, 1 << 19), ([0, 1], 3, 8), ([2], 4, 0)])
def test_words_are_counted_by_the_task(spark, monkeypatch, levels, bins, held):
    """As the list of words gives them, in rows of bins and words and not of words of texts."""
    rng = random.Random(4)
    rows = [(rng.choice([None, 0.1, 0.3, 0.6, 0.9, 1.5]), rng.random(), rng.choice([t, None])) for t in _odd_texts(400)] + [(0.1, 0.1, "a b9 " * 500), (0.1, 0.1, "a " * 500)]
    df = spark.createDataFrame(rows, "x double, y double, s string")
    monkeypatch.setattr(topics, "_HELD", held)
    by_list = df.withColumn("w", text.words(F.col("s")))
    for o in ({}, {"terms": ["b9", "B"]}, {"stop": ["a", "b"]}, {"terms": ["a"], "stop": ["a"]}):
        assert listed(topics.topics(df, "x", "y", "s", Cartesian(), levels, 20, bins, words=True, **o)) == listed(topics.topics(by_list, "x", "y", "w", Cartesian(), levels, 20, bins, **o))
    assert topics.topics(df.limit(0), "x", "y", "s", Cartesian(), levels, words=True).count() == 0
    batch = topics.pa.RecordBatch.from_arrays([topics.pa.array([7, 7, 7]), topics.pa.array(["a a a", None, "a B"])], ["z", "s"])
    assert [r for b in topics._tallied(iter([batch]), [], []) for r in b.to_pylist()] == [{"z": 7, "term": "a", "n": 4}, {"z": 7, "term": "b", "n": 1}]


@pytest.mark.parametrize("made", [lambda c: topics.tfidf(c, 3, "binary", "probabilistic"), lambda c: topics.tfidf(c, 3, "normalized", "linear", stop=["The"]), lambda c: topics.dictionary(c, stop=["the"], least=0.2, most=90.0, features=300)])
def test_texts_are_read_once(spark, made):
    """Terms, dictionary and number of documents come from one exchange of counts."""
    df = spark.createDataFrame([(0.1, 0.1, "The one"), (0.9, 0.9, "the two two")], "x double, y double, s string")
    out = made(topics.term_counts(df, "x", "y", "s", Cartesian(), [0, 1]))
    out.collect()
    final = out._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]
    assert final.count("MapInArrow") == 1
