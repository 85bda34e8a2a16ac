"""The queries of this subpackage and the SQL that says the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from quadrille.llm import decontaminate, html_text, language, lines, ngram_join, pieces, quality, secret_scan, shards, substrings


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.classes(_table(spark, sf_dir, "documents"))


def quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.repetition(_table(spark, sf_dir, "documents"))


def secret_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return secret_scan.secrets(_table(spark, sf_dir, "documents"))


def sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards.shards(_table(spark, sf_dir, "documents"))


def language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(_table(spark, sf_dir, "documents"))


def html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return html_text.extracted(_table(spark, sf_dir, "pages"))


def substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return substrings.repeats(_table(spark, sf_dir, "documents"))


def sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pieces.encode(_table(spark, sf_dir, "documents"))


def decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.leaks(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


def line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.keep_bitmaps(_table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_ngram_jaccard_join": ngram_jaccard_join,
    "op2_quality_rules": quality_rules,
    "op3_secret_scans": secret_scans,
    "op4_language_id": language_id,
    "op5_substring_dedup": substring_dedup,
    "op6_html_extraction": html_extraction,
    "op7_sentencepiece": sentencepiece,
    "op8_sharding": sharding,
    "op9_benchmark_decontamination": decontamination,
    "op10_line_dedup": line_dedup,
}

#: The words of a text, as a list.
_WORDS = r"regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[0-9a-z\x{80}-\x{10FFFF}]+')"



def _quality_sql() -> str:
    """Repetition measures of one window function for each length."""
    lower = "translate(w, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    gram = lambda n: " || ' ' || ".join(["w", *[f"lead(w, {k}) OVER d" for k in range(1, n)]])
    parts = []
    for n in quality.DUPLICATE:
        parts.append(f"""dup_{n} AS (
    SELECT doc, sum(size) FILTER (inside) AS chars FROM (
        SELECT doc, size, coalesce(max(again) OVER (PARTITION BY doc ORDER BY i ROWS BETWEEN {n - 1} PRECEDING AND CURRENT ROW), 0) = 1 AS inside FROM (
            SELECT doc, i, size, (g IS NOT NULL AND row_number() OVER (PARTITION BY doc, g ORDER BY i) > 1)::INT AS again
            FROM (SELECT doc, i, size, {gram(n)} AS g FROM words WINDOW d AS (PARTITION BY doc ORDER BY i))))
    GROUP BY doc)""")
    for n in quality.TOP:
        size = " + ".join(["size", *[f"lead(size, {k}) OVER d" for k in range(1, n)]])
        parts.append(f"""top_{n} AS (
    SELECT doc, max(c * s) AS chars FROM (
        SELECT doc, c, s, max(c) OVER (PARTITION BY doc) AS most FROM (
            SELECT doc, g, count(*) AS c, max(s) AS s
            FROM (SELECT doc, {gram(n)} AS g, {size} AS s FROM words WINDOW d AS (PARTITION BY doc ORDER BY i)) WHERE g IS NOT NULL GROUP BY doc, g))
    WHERE c = most AND c > 1 GROUP BY doc)""")
    measures = [f"coalesce(dup_{n}.chars, 0)::DOUBLE / greatest(docs.chars, 1) AS dup_{n}" for n in quality.DUPLICATE]
    measures += [f"least(1.0::DOUBLE, coalesce(top_{n}.chars, 0)::DOUBLE / greatest(docs.chars, 1)) AS top_{n}" for n in quality.TOP]
    rules = [(f"dup_{n}", f"dup_{n} > {v}::DOUBLE") for n, v in quality.DUPLICATE.items()] + [(f"top_{n}", f"n_words >= {quality.TOP_FROM} AND top_{n} > {v}::DOUBLE") for n, v in quality.TOP.items()]
    rules += [(k, f"{k} > {v}::DOUBLE") for k, v in (("dup_lines", quality.LINES), ("dup_line_chars", quality.LINE_CHARS), ("symbols", quality.SYMBOLS), ("word_length", quality.LONG_WORD))]
    rules.append(("few_words", f"n_words < {quality.FEW_WORDS}"))
    reasons = ", ".join(f"CASE WHEN {test} THEN '{name}' END" for name, test in rules)
    joins = " ".join(f"LEFT JOIN {k} ON {k}.doc = docs.doc" for k in [f"dup_{n}" for n in quality.DUPLICATE] + [f"top_{n}" for n in quality.TOP] + ["sums", "lines"])
    return f"""
WITH docs AS (SELECT row_number() OVER () AS doc, doc_id, coalesce(text, '') AS text FROM documents),
listed AS (SELECT doc, regexp_extract_all(text, '[^ \\t\\n\\r\\x0b\\x0c]+') AS l FROM docs),
words AS (SELECT doc, i, {lower} AS w, len(w) AS size FROM (SELECT doc, unnest(l) AS w, generate_subscripts(l, 1) AS i FROM listed)),
sums AS (SELECT doc, count(*) AS n_words, sum(size) AS chars FROM words GROUP BY doc),
lines AS (
    SELECT doc, count(*) FILTER (r > 1)::DOUBLE / count(*) AS dup_lines, coalesce(sum(len(line)) FILTER (r > 1), 0)::DOUBLE / sum(len(line)) AS dup_line_chars
    FROM (SELECT doc, line, row_number() OVER (PARTITION BY doc, line) AS r FROM (SELECT doc, unnest(string_split(text, chr(10))) AS line FROM docs) WHERE line <> '')
    GROUP BY doc),
{", ".join(parts)},
measured AS (
    SELECT doc_id, coalesce(n_words, 0)::BIGINT AS n_words, {", ".join(measures)}, coalesce(dup_lines, 0.0)::DOUBLE AS dup_lines, coalesce(dup_line_chars, 0.0)::DOUBLE AS dup_line_chars,
           len(regexp_replace(text, '[^!-/:-@\\[-`{{-~]', '', 'g'))::DOUBLE / greatest(len(text), 1) AS symbols, coalesce(docs.chars, 0)::DOUBLE / greatest(coalesce(n_words, 0), 1) AS word_length
    FROM (SELECT docs.*, {", ".join(f"{k}" for k in ["sums.n_words", "sums.chars", "lines.dup_lines", "lines.dup_line_chars"])} FROM docs LEFT JOIN sums ON sums.doc = docs.doc LEFT JOIN lines ON lines.doc = docs.doc) docs {joins.replace(" LEFT JOIN sums ON sums.doc = docs.doc", "").replace(" LEFT JOIN lines ON lines.doc = docs.doc", "")})
SELECT doc_id, n_words, {", ".join(quality.MEASURES)}, concat_ws('|', {reasons}) = '' AS keep, concat_ws('|', {reasons}) AS reasons
FROM measured
"""


ORACLE_SQL: dict[str, str] = {
    "op2_quality_rules": _quality_sql(),
    "op1_ngram_jaccard_join": f"""
WITH RECURSIVE words AS (
    SELECT doc_id, {_WORDS} AS w FROM documents WHERE doc_id IS NOT NULL AND text IS NOT NULL
), grams AS (
    SELECT DISTINCT doc_id, unnest(CASE WHEN len(w) < 3 THEN [array_to_string(w, ' ')] ELSE list_transform(range(1, len(w) - 1), lambda i: w[i] || ' ' || w[i + 1] || ' ' || w[i + 2]) END) AS g
    FROM words WHERE len(w) > 0
), sizes AS (
    SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
    SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS o FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY 1, 2
), pairs AS (
    SELECT a, b FROM shared JOIN sizes x ON a = x.doc_id JOIN sizes y ON b = y.doc_id WHERE o::DOUBLE / (x.n + y.n - o) >= 0.5
), links AS (
    SELECT a, b FROM pairs UNION ALL SELECT b, a FROM pairs
), reached AS (
    SELECT a AS doc_id, b AS other FROM links UNION SELECT reached.doc_id, links.b FROM reached JOIN links ON reached.other = links.a
)
SELECT doc_id, least(doc_id, coalesce(r.class_id, doc_id)) AS class_id, coalesce(l.n, 0)::BIGINT AS n_links
FROM documents LEFT JOIN (SELECT a AS doc_id, count(*) AS n FROM links GROUP BY a) l USING (doc_id)
LEFT JOIN (SELECT doc_id, min(other) AS class_id FROM reached GROUP BY doc_id) r USING (doc_id)
""",
    "op5_substring_dedup": f"""
WITH words AS (
    SELECT row_number() OVER () AS doc, doc_id, {_WORDS} AS w FROM documents WHERE text IS NOT NULL
), windows AS (
    SELECT doc, unnest(range(0, len(w) - 49)) AS s, unnest(list_transform(range(1, len(w) - 48), lambda i: md5(array_to_string(w[i:i + 49], ' ')))) AS h
    FROM words WHERE len(w) >= 50
), found AS (
    SELECT doc, s FROM windows WHERE h IN (SELECT h FROM windows GROUP BY h HAVING count(DISTINCT doc) > 1)
), marked AS (
    SELECT doc, s, (s > coalesce(lag(s) OVER (PARTITION BY doc ORDER BY s), -1000) + 50)::INT AS turn FROM found
), spans AS (
    SELECT doc, min(s) AS a, max(s) + 50 AS b
    FROM (SELECT doc, s, sum(turn) OVER (PARTITION BY doc ORDER BY s) AS span FROM marked)
    GROUP BY doc, span
)
SELECT doc_id, a::BIGINT AS start_word, b::BIGINT AS end_word, len(w)::BIGINT AS n_words FROM spans JOIN words USING (doc)
""",
    "op10_line_dedup": r"""
WITH lines AS (
    SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos
    FROM documents
), flagged AS (
    SELECT doc_id, pos,
           trim(line, ' ' || chr(9) || chr(13)) = '' OR row_number() OVER (PARTITION BY line ORDER BY doc_id NULLS FIRST, pos) = 1 AS kept
    FROM lines
), edges AS (
    SELECT doc_id, pos, kept, kept IS DISTINCT FROM coalesce(lag(kept) OVER (PARTITION BY doc_id ORDER BY pos), true) AS turn
    FROM flagged
), runs AS (
    SELECT doc_id, kept, run, count(*) AS n
    FROM (SELECT doc_id, pos, kept, sum(turn::INT) OVER (PARTITION BY doc_id ORDER BY pos) AS run FROM edges)
    GROUP BY doc_id, kept, run
)
SELECT d.doc_id, coalesce(sum(n), 0)::BIGINT AS n_lines, coalesce(sum(n) FILTER (kept), 0)::BIGINT AS n_kept,
       CASE WHEN min(run) = 1 THEN '0,' ELSE '' END || coalesce(string_agg(n::VARCHAR, ',' ORDER BY run), '') AS keep
FROM documents d LEFT JOIN runs r ON d.doc_id IS NOT DISTINCT FROM r.doc_id
GROUP BY d.doc_id
""",
}
