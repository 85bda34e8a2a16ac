"""Sessions with the settings that the operators are written for."""

from __future__ import annotations

from pyspark.sql import SparkSession


def session(name: str = "quadrille", **conf: str) -> SparkSession:
    """A session in UTC with ANSI casts and adaptive execution; conf, with _ for ., goes on top."""
    builder = SparkSession.builder.appName(name)
    settings = {"spark.sql.session.timeZone": "UTC", "spark.sql.ansi.enabled": "true", "spark.sql.adaptive.enabled": "true"}
    return builder.config(map=settings | {k.replace("_", "."): v for k, v in conf.items()}).getOrCreate()
