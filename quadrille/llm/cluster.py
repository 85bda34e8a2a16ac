"""What the operators need from the session."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrille.shelf import _CLEANUP, Shelf, _cleared, batches, removed, shared_folder  # noqa: F401


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def slim(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Only the id and the text, as doc_id and text; other columns cannot clash."""
    return df.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))


def text_key(text: str | Column = "text") -> Column:
    """Tells apart different texts under one id, or under a null id; 0 for a null text."""
    column = F.col(text) if isinstance(text, str) else text
    return F.when(column.isNull(), F.lit(0).cast("long")).otherwise(F.xxhash64(column))
