"""python -m tests.llm.figures [FOLDER]: the measured figures that the README gives."""

from __future__ import annotations

import re
import sys
from collections import Counter
from html import unescape

from pyspark.sql import SparkSession
from pyspark.sql import functions as F

from quadrille.llm import html_text, language, shards


def languages(spark: SparkSession, folder: str) -> float:
    """The share of right languages of documents of 20 characters or more whose text is not among those fitted on, which are half of all."""
    docs = spark.read.parquet(f"{folder}/documents.parquet").where("lang IS NOT NULL AND length(text) >= 20")
    half = F.pmod(F.xxhash64("text", F.lit(5)), F.lit(2)) == 0
    named = language.identify(docs.where(~half), docs.where(half)).join(docs.select("doc_id", "lang"), "doc_id")
    return named.agg(F.avg((F.col("language") == F.col("lang")).cast("double"))).first()[0]


def balance(spark: SparkSession, folder: str) -> tuple[int, int, int]:
    """Bytes of the largest and the smallest shard, and shards."""
    placed = shards.shards(spark.read.parquet(f"{folder}/documents.parquet"))
    sums = [r["n_bytes"] for r in shards.balance(spark, placed).collect()]
    return max(sums), min(sums), len(sums)


def content(spark: SparkSession, folder: str) -> tuple[float, float]:
    """Precision and recall of the words of a page's article, by word counts."""
    right = found = true = 0
    pages = spark.read.parquet(f"{folder}/pages.parquet")
    for r in html_text.extracted(pages).join(pages.select("page_id", "html"), "page_id").where("html LIKE '%<article>%'").toLocalIterator():
        article = re.search(r"<article>(.*?)</article>", r["html"], re.S)
        if article:
            gold = Counter(unescape(re.sub(r"<script.*?</script>|<style.*?</style>|<!--.*?-->|<[^>]*>", " ", article[1], flags=re.S)).split())
            got = Counter(r["text"].split())
            right, found, true = right + (gold & got).total(), found + got.total(), true + gold.total()
    return right / max(1, found), right / max(1, true)


def main() -> None:
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.1"
    spark = SparkSession.builder.master("local[8]").config(map={"spark.sql.shuffle.partitions": "8", "spark.ui.enabled": "false", "spark.driver.memory": "8g"}).getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    print(f"languages held out: {languages(spark, folder):.4f}")
    print("shards, largest, smallest, number: {} {} {}".format(*balance(spark, folder)))
    print("content of pages, precision, recall: {:.3f} {:.3f}".format(*content(spark, folder)))


if __name__ == "__main__":
    main()
