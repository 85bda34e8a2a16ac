"""Reading delimited text and lists of terms."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Settings of a parser of single lines, and Spark's names for them.
SETTINGS = {
    "ignoreLeadingWhiteSpaces": ("ignoreLeadingWhiteSpace", "true"),
    "ignoreTrailingWhiteSpaces": ("ignoreTrailingWhiteSpace", "true"),
    "sep": ("sep", ","),
    "quote": ("quote", '"'),
    "escape": ("escape", "\\"),
    "comment": ("comment", "\x00"),
    "header": ("header", "false"),
}


def read_csv(spark: SparkSession, path: str | list[str], schema: T.StructType, options: Mapping[str, str] | None = None) -> DataFrame:
    """Any delimited files of a declared schema; short rows are filled up with nulls."""
    return spark.read.format("csv").options(**{k: str(v) for k, v in (options or {}).items()}).schema(schema).load(path)


def cast(value: Column, kind: T.DataType) -> Column:
    """A string as a value of the type; null if it is none."""
    if isinstance(kind, T.StringType):
        return value
    if isinstance(kind, T.TimestampType):
        return F.try_to_timestamp(value)
    return value.try_cast(kind)


def parse_lines(lines: DataFrame, schema: T.StructType, settings: Mapping[str, object] | None = None, column: str = "value") -> DataFrame:
    """Rows of the lines of text in a column, without those with another number of fields or a field of another type.

    Settings are those of SETTINGS. A field that is the word null is null in a string column and invalid in others; with
    header=true, lines equal to the row of column names go.
    """
    given = {k: str(v).lower() if isinstance(v, bool) else str(v) for k, v in (settings or {}).items()}
    unknown = given.keys() - SETTINGS.keys()
    if unknown:
        raise ValueError(f"unknown settings {sorted(unknown)}")
    chosen = {k: given.get(k, default) for k, (_, default) in SETTINGS.items()}
    options = {SETTINGS[k][0]: v for k, v in chosen.items() if k not in ("header", "comment")}
    names = [f"_f{i}" for i in range(len(schema) + 1)]
    raw = T.StructType([T.StructField(n, T.StringType()) for n in names] + [T.StructField("_bad", T.StringType())])
    text = lines.select(F.col(column).cast("string").alias("_line")).where("_line IS NOT NULL")
    if chosen["comment"] != "\x00":
        text = text.where(~F.ltrim("_line").startswith(chosen["comment"]))
    # One field more than there should be tells longer rows, and its marker tells shorter ones.
    row = F.from_csv(F.concat("_line", F.lit(options["sep"] + "\ue000")), raw.simpleString().removeprefix("struct<").removesuffix(">").replace(":", " "), {**options, "mode": "PERMISSIVE", "columnNameOfCorruptRecord": "_bad", "nullValue": "\ue001", "emptyValue": ""})
    parsed = text.select(row.alias("r")).where(F.col(f"r.{names[-1]}") == "\ue000")
    fields = [F.col(f"r.{n}") for n in names[:-1]]
    if chosen["header"] == "true" and fields:
        is_header = F.lit(True)
        for f, field in zip(fields, schema):
            is_header &= F.coalesce(f == field.name, F.lit(False))
        parsed = parsed.where(~is_header)
    made = [cast(f, field.dataType) for f, field in zip(fields, schema)]
    ok = F.lit(True)
    for f, m, field in zip(fields, made, schema):
        ok &= F.lit(True) if isinstance(field.dataType, T.StringType) else m.isNotNull()
    values = [F.when(f != "null", f).alias(field.name) if isinstance(field.dataType, T.StringType) else m.alias(field.name) for f, m, field in zip(fields, made, schema)]
    return parsed.where(ok).select(*values)


def terms(spark: SparkSession, path: str) -> list[str]:
    """The lines of a short file, without blank ones."""
    return [t for r in spark.read.text(path).collect() if (t := r[0].strip())]
