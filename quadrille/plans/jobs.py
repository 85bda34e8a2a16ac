"""The nine jobs: a configured source, an analytic, a sink.

run(spark, config) takes a parsed configuration. The sections are those of the job and source, columns, tiling and an output.
"""

from __future__ import annotations

import json
import sys
from collections.abc import Callable
from dataclasses import dataclass

from pyspark import StorageLevel
from pyspark.sql import DataFrame, SparkSession

from quadrille import sinks
from quadrille.functions.grid import Cartesian, Mercator, TimeRange
from quadrille.operators import codec, lda, segments, tiling, topics
from quadrille.plans.config import ConfigError, Section, flat, load
from quadrille.sources import schema as schemas
from quadrille.sources import tables


@dataclass(frozen=True)
class Tiling:
    levels: list[int]
    source: str
    bins: int | None


def tiling_of(config: Section) -> Tiling:
    part = config.section("tiling")
    return Tiling(part.many(int, "levels"), part.text("source"), part.whole("bins", default=None))


def projection_of(part: Section):
    kind, bounds = part.text("projection").lower(), part.many(float, "xyBounds", default=None)
    if bounds is not None and len(bounds) != 4:
        raise ConfigError(f"{part.name}xyBounds needs four numbers")
    if kind == "mercator":
        return Mercator(tuple(bounds)) if bounds else Mercator()
    if kind == "cartesian":
        if not bounds:
            raise ConfigError(f"{part.name}xyBounds is needed for a cartesian projection")
        return Cartesian(tuple(bounds))
    raise ConfigError(f"{part.name}projection is {kind}")


def sink_of(config: Section) -> sinks.Sink:
    """The first of fileOutput, s3Output and hbaseOutput that is there."""
    if config.find("fileOutput") is not None:
        part = config.section("fileOutput")
        return sinks.files(part.text("dest"), part.text("layer"), part.text("ext", default=".bin"))
    if config.find("s3Output") is not None:
        part = config.section("s3Output")
        suffix = "." + part.text("ext", default="bin").lstrip(".")
        return sinks.s3(part.text("bucket"), part.text("layer"), part.text("awsAccessKey", default=None), part.text("awsSecretKey", default=None), suffix)
    if config.find("hbaseOutput") is not None:
        part = config.section("hbaseOutput")
        return sinks.hbase(part.text("host", "configFiles"), part.text("layer"), part.text("qualifier", default=""))
    raise ConfigError("there is no output section")


def session_of(config: Section, name: str = "quadrille") -> SparkSession:
    """A session with the settings of the section spark, and its checkpoint folder."""
    builder = SparkSession.builder.appName(name)
    given = config.find("spark") or {}
    for key, value in flat(given).items():
        if key != "checkpoint-directory":
            builder = builder.config(f"spark.{key}", str(value))
    spark = builder.getOrCreate()
    if "checkpoint-directory" in given:
        spark.sparkContext.setCheckpointDir(str(given["checkpoint-directory"]))
    return spark


def source_of(spark: SparkSession, config: Section) -> DataFrame:
    """The declared columns of the source."""
    declared = config.section("columns").config if config.find("columns") is not None else config.section("schema").config
    width = declared.get("rowSize", config.find("rowSize"))
    fields = {k: v for k, v in declared.items() if isinstance(v, dict)}
    options = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in flat(config.find("sparkCsv") or {}).items()}
    return tables.read_csv(spark, tiling_of(config).source, schemas.schema(fields, None if width is None else int(width)), options)


def _terms(spark: SparkSession, part: Section, key: str) -> list[str] | None:
    path = part.text(key, default=None)
    return tables.terms(spark, path) if path else None


def _times(part: Section) -> TimeRange:
    return TimeRange.of_step(part.whole("min"), part.whole("step"), part.whole("count"))


def _range(times: TimeRange) -> dict:
    return {"start": times.start, "count": times.count, "step": times.step}


def heatmap(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("xyHeatmap"), tiling_of(config), sink_of(config)
    bins = t.bins or 256
    cells = tiling.heatmap(source_of(spark, config), part.text("xColumn"), part.text("yColumn"), projection_of(part), t.levels, bins, part.text("valueColumn", default=None))
    out = sink.write(codec.dense(cells, bins))
    sink.write_bytes("metadata.json", codec.metadata(bins=bins))
    return out


def time_heatmap(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("xyTimeHeatmap"), tiling_of(config), sink_of(config)
    bins, times = t.bins or 256, _times(part)
    cells = tiling.time_heatmap(source_of(spark, config), part.text("xColumn"), part.text("yColumn"), part.text("timeColumn"), projection_of(part), times, t.levels, bins, part.text("valueColumn", default=None))
    out = sink.write(codec.dense(cells, bins, times.count))
    sink.write_bytes("metadata.json", codec.metadata(bins=bins, range=_range(times)))
    return out


def segment(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("xySegment"), tiling_of(config), sink_of(config)
    bins = t.bins or 256
    columns = tuple(part.text(c) for c in ("x1Column", "y1Column", "x2Column", "y2Column"))
    cells = segments.segment_heatmap(source_of(spark, config), columns, t.levels, projection_of(part), bins, part.text("valueColumn", default=None), part.text("arcType"), part.whole("minSegLen", default=None), part.whole("maxSegLen", default=1024))
    # Both the tiles and the levels' ranges are of these.
    cells = cells.persist(StorageLevel.DISK_ONLY)
    out = sink.write(codec.dense(cells, bins))
    # One row a level.
    levels = {str(r["z"]): {"min": r["min"], "max": r["max"]} for r in tiling.level_range(cells).collect()}
    sink.write_bytes("metadata.json", json.dumps({"bins": bins, **levels}).encode())
    return out


def xy_topics(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("xyTopics"), tiling_of(config), sink_of(config)
    bins, terms = t.bins or 1, _terms(spark, part, "terms")
    cells = topics.topics(source_of(spark, config), part.text("xColumn"), part.text("yColumn"), part.text("textColumn"), projection_of(part), t.levels, part.whole("topicLimit", default=15), bins, terms, _terms(spark, part, "stopWords"))
    out = sink.write(codec.scores(cells, bins))
    sink.write_bytes("metadata.json", codec.metadata(bins=t.bins))
    sink.write_bytes("terms.json", json.dumps(terms or []).encode())
    return out


def xy_time_topics(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("xyTimeTopics"), tiling_of(config), sink_of(config)
    bins, terms, times = t.bins or 1, _terms(spark, part, "terms"), _times(part)
    cells = topics.time_topics(source_of(spark, config), part.text("xColumn"), part.text("yColumn"), part.text("timeColumn"), part.text("textColumn"), projection_of(part), times, t.levels, part.whole("topicLimit"), bins, terms, _terms(spark, part, "stopWords"))
    out = sink.write(codec.scores(cells, bins))
    sink.write_bytes("metadata.json", codec.metadata(bins=bins, range=_range(times)))
    sink.write_bytes("terms.json", json.dumps(terms or []).encode())
    return out


def _counted(spark: SparkSession, config: Section) -> DataFrame:
    part = config.section("topics")
    return topics.term_counts(source_of(spark, config), part.text("xColumn"), part.text("yColumn"), part.text("textColumn"), projection_of(part), tiling_of(config).levels)


def _dictionary(spark: SparkSession, part: Section) -> dict:
    if part.find("dictionary") is None:
        return {}
    d = part.section("dictionary")
    return {
        "case_sensitive": d.truth("caseSensitive", "case-sensitive", default=False),
        "predefined": _terms(spark, d, "dictionary"),
        "stop": _terms(spark, d, "stopwords"),
        "most": d.real("maxDF", "max-df", default=None),
        "least": d.real("minDF", "min-df", default=None),
        "features": d.whole("maxFeatures", "max-features", default=None),
    }


def tile_tfidf(spark: SparkSession, config: Section) -> DataFrame:
    part, sink = config.section("tf-idf"), sink_of(config)
    idf = part.text("idf", default="log-smooth").lower().replace("probabalistic", "probabilistic")
    ranked = topics.tfidf(_counted(spark, config), part.whole("words"), part.text("tf", "type", default="sublinear").lower(), idf, part.real("k", default=0.5), **_dictionary(spark, part))
    return sink.write(codec.tile_scores(ranked))


def tile_lda(spark: SparkSession, config: Section) -> DataFrame:
    part, sink = config.section("lda"), sink_of(config)
    ranked = lda.words(_counted(spark, config), part.whole("topics"), part.whole("wordsPerTopic"), part.whole("topicsPerDocument"), part.whole("maximumIterations", default=20), part.whole("checkpointInterval", default=10), **_dictionary(spark, config))
    return sink.write(codec.tile_scores(ranked))


def ip_heatmap(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("ipHeatmap"), tiling_of(config), sink_of(config)
    bins = t.bins or 256
    return sink.write(codec.dense(tiling.ip_heatmap(source_of(spark, config), part.text("ipColumn"), t.levels, bins, part.text("valueColumn", default=None)), bins))


def ip_segment(spark: SparkSession, config: Section) -> DataFrame:
    part, t, sink = config.section("ipSegment"), tiling_of(config), sink_of(config)
    bins = t.bins or 256
    cells = segments.ip_segments(source_of(spark, config), part.text("ipFromColumn"), part.text("ipToColumn"), t.levels, bins, part.text("valueColumn", default=None), part.text("arcType"), part.whole("minSegLen", default=None), part.whole("maxSegLen", default=None))
    return sink.write(codec.dense(cells, bins))


JOBS: dict[str, Callable[[SparkSession, Section], DataFrame]] = {
    "xyHeatmap": heatmap,
    "xyTimeHeatmap": time_heatmap,
    "xySegment": segment,
    "xyTopics": xy_topics,
    "xyTimeTopics": xy_time_topics,
    "tf-idf": tile_tfidf,
    "lda": tile_lda,
    "ipHeatmap": ip_heatmap,
    "ipSegment": ip_segment,
}


def run(job: str, spark: SparkSession, config: dict) -> DataFrame:
    """Runs a job and returns the tiles that it wrote."""
    return JOBS[job](spark, Section(config))


def main(arguments: list[str]) -> None:
    """JOB FILE...: earlier files win, and the environment over all of them."""
    job, *paths = [a for a in arguments if a != "debug"]
    config = load(*paths)
    if "debug" in arguments:
        print(json.dumps(config, indent=2, default=str))
    spark = session_of(Section(config), job)
    try:
        run(job, spark, config)
    finally:
        spark.stop()


if __name__ == "__main__":
    main(sys.argv[1:])
