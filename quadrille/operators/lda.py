"""Topics of tiles by latent Dirichlet allocation."""

from __future__ import annotations

from pyspark.ml.clustering import LDA
from pyspark.ml.functions import vector_to_array
from pyspark.ml.linalg import VectorUDT
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from quadrille.operators.tiling import TILE
from quadrille.operators.topics import dictionary
from quadrille.shelf import Shelf

#: Terms of the vocabulary, which is one array on every executor.
VOCABULARY = 1 << 18


def _bags(counted: DataFrame, known: DataFrame, size: int) -> DataFrame:
    """(z, tx, ty, features): a sparse vector of each tile's counts. A tile's entries are as many as the vocabulary's at most, however long its texts are."""
    rows = counted.join(F.broadcast(known), "term", "left")
    listed = rows.groupBy(*TILE).agg(F.sort_array(F.collect_list(F.when(F.col("i").isNotNull(), F.struct("i", F.col("n").cast("double").alias("n"))))).alias("b"))
    # What a sparse vector is stored as.
    return listed.select(*TILE, F.struct(F.lit(0).cast("tinyint").alias("type"), F.lit(size).alias("size"), F.col("b.i").alias("indices"), F.col("b.n").alias("values")).alias("features"))


def _fitted(counted: DataFrame, topics: int, terms: int, iterations: int, checkpoint: int, seed: int, vocabulary: int, options: dict):
    """Topic shares of each tile, and the heaviest terms of each topic."""
    spark, shelf = counted.sparkSession, Shelf(counted.sparkSession)
    known = dictionary(counted, [], **options).select("term") if options else None
    # Counts and vectors are kept: the vocabulary, the vectors and every iteration would count the texts again.
    kept = shelf.keep(counted.join(known, "term", "left_semi") if known is not None else counted)
    words = [r["term"] for r in kept.groupBy("term").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "term").limit(vocabulary).select("term").toLocalIterator()]
    bags = shelf.keep(_bags(kept.select(*TILE, "term", "n"), spark.createDataFrame(list(zip(words, range(len(words)))), "term string, i int"), len(words)))
    # Parquet has the parts of a vector, which are read as one.
    vectors = spark.read.schema(StructType([*[bags.schema[c] for c in TILE], StructField("features", VectorUDT())])).parquet(shelf.held[id(bags)][1])
    shelf.drop(kept)
    model = LDA(k=topics, maxIter=iterations, checkpointInterval=checkpoint, seed=seed, featuresCol="features").fit(vectors)
    shares = model.transform(vectors).select(*TILE, F.posexplode(vector_to_array("topicDistribution")).alias("topic", "share"))
    # As many rows as there are topics, whatever the data.
    heaviest = [(r["topic"], words[i], float(w)) for r in model.describeTopics(terms).collect() for i, w in zip(r["termIndices"], r["termWeights"])]
    weights = spark.createDataFrame(heaviest, "topic int, term string, weight double")
    return shares, weights


def _best(weights: DataFrame, words: int) -> DataFrame:
    rank = F.row_number().over(Window.partitionBy("topic").orderBy(F.desc("weight"), "term"))
    return weights.withColumn("rank", rank).where(F.col("rank") <= words)


def topics(counted: DataFrame, count: int, words: int, per_tile: int, iterations: int = 20, checkpoint: int = 10, seed: int = 0, vocabulary: int = VOCABULARY, word_separator: str = "|", score_separator: str = "=", **options) -> DataFrame:
    """(z, tx, ty, topic, score, rank): each tile's strongest topics, written as their heaviest terms with weights."""
    shares, weights = _fitted(counted, count, words, iterations, checkpoint, seed, vocabulary, options)
    written = _best(weights, words).groupBy("topic").agg(F.sort_array(F.collect_list(F.struct("rank", "term", "weight"))).alias("t"))
    text = F.array_join(F.transform("t", lambda t: F.concat(t["term"], F.lit(score_separator), t["weight"].cast("string"))), word_separator)
    rank = F.row_number().over(Window.partitionBy(*TILE).orderBy(F.desc("share"), "topic"))
    top = shares.withColumn("rank", rank).where(F.col("rank") <= per_tile)
    return top.join(written.select("topic", text.alias("text")), "topic").select(*TILE, F.col("text").alias("topic"), F.col("share").alias("score"), "rank")


def words(counted: DataFrame, count: int, words: int, per_tile: int, iterations: int = 20, checkpoint: int = 10, seed: int = 0, vocabulary: int = VOCABULARY, **options) -> DataFrame:
    """(z, tx, ty, term, score, rank): each tile's terms by the sum over its strongest topics of topic share times term weight."""
    shares, weights = _fitted(counted, count, words, iterations, checkpoint, seed, vocabulary, options)
    strongest = F.row_number().over(Window.partitionBy(*TILE).orderBy(F.desc("share"), "topic"))
    top = shares.withColumn("r", strongest).where(F.col("r") <= per_tile)
    scored = top.join(_best(weights, words).drop("rank"), "topic").groupBy(*TILE, "term").agg(F.sum(F.col("share") * F.col("weight")).alias("score"))
    rank = F.row_number().over(Window.partitionBy(*TILE).orderBy(F.desc("score"), "term"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= words)
