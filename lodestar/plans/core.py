"""Queries of the general data-processing operators, with the SQL they are checked against."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestar.operators import records, skew
from lodestar.storage import table

KEYS = ["partition_no", "term"]
PERCENTS = (25, 50, 99)


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return skew.wrong_counts(table(spark, sf, "lexicon"), table(spark, sf, "postings"), KEYS, "df", "docid")


def p1_quantiles(spark: SparkSession, sf: str) -> DataFrame:
    found = skew.exact_quantiles(table(spark, sf, "postings"), KEYS, "docid", PERCENTS)
    return found.select(*KEYS, F.col("percent").cast("bigint").alias("percent"), F.col("value").alias("docid"))


def _parsed(spark: SparkSession, sf: str) -> DataFrame:
    return records.parse_records(table(spark, sf, "collection_lines"), "line", records.COLLECTION)


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("reason").isNotNull()).select("line_no", "reason")


def p2_records(spark: SparkSession, sf: str) -> DataFrame:
    return _parsed(spark, sf).where(F.col("reason").isNull()).select("line_no", F.col("pid").cast("bigint").alias("pid"), "text")


def p2_fields(spark: SparkSession, sf: str) -> DataFrame:
    bad = _parsed(spark, sf).where(F.col("reason").isNotNull())
    return bad.groupBy("reason", F.coalesce("broken_field", F.lit("-")).alias("field")).agg(F.count("*").alias("n_lines"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "p1_found": p1_found,
    "p1_quantiles": p1_quantiles,
    "p2_found": p2_found,
    "p2_records": p2_records,
    "p2_fields": p2_fields,
}

_ANY = r'("[^"]*(""[^"]*)*"|[^"\t][^\t]*|)'
_SPACE = "[\\t-\\r\\x1c-\\x20\\x{85}\\x{a0}\\x{1680}\\x{2000}-\\x{200a}\\x{2028}\\x{2029}\\x{202f}\\x{205f}\\x{3000}]"
#: Written from the definition, not from the operator's patterns: fields are cut out first and judged one by one.
_LINES = rf"""
lines AS (
  SELECT line_no, line,
    line IS NULL OR regexp_full_match(line, '{_SPACE}*') AS is_empty,
    regexp_full_match(line, '{_ANY}(\t{_ANY})*', 's') AS closed
  FROM collection_lines),
fields AS (
  SELECT *, CASE WHEN closed AND NOT is_empty THEN regexp_full_match(line, '{_ANY}\t{_ANY}', 's') END AS two,
    regexp_extract(line, '^{_ANY}(?:\t|$)', 1, 's') AS f1,
    regexp_extract(line, '^(?:{_ANY})\t({_ANY})$', 3, 's') AS f2
  FROM lines),
clean AS (
  SELECT line_no, line, is_empty, closed, two,
    CASE WHEN f1 LIKE '"%' THEN replace(f1[2:len(f1) - 1], '""', '"') ELSE f1 END AS pid,
    CASE WHEN f2 LIKE '"%' THEN replace(f2[2:len(f2) - 1], '""', '"') ELSE f2 END AS text
  FROM fields),
judged AS (
  SELECT *, regexp_full_match(pid, '[0-9]+') AND coalesce(try_cast(pid AS HUGEINT) <= 2147483647, false) AS good_pid,
    NOT regexp_full_match(text, '{_SPACE}*', 's') AS good_text
  FROM clean),
reasons AS (
  SELECT *, CASE WHEN is_empty THEN 'empty' WHEN NOT closed THEN 'quoting' WHEN NOT two THEN 'columns'
    WHEN NOT (good_pid AND good_text) THEN 'value' END AS reason
  FROM judged)
"""

ORACLES: dict[str, str] = {
    "p1_found": """
        WITH d AS (SELECT partition_no, term, count(DISTINCT docid) AS n FROM postings GROUP BY ALL)
        SELECT DISTINCT l.partition_no, l.term FROM lexicon l
        LEFT JOIN d ON l.partition_no IS NOT DISTINCT FROM d.partition_no AND l.term IS NOT DISTINCT FROM d.term
        WHERE l.df IS NULL OR l.df <> coalesce(d.n, 0)""",
    "p1_quantiles": f"""
        WITH r AS (SELECT partition_no, term, docid, count(*) OVER (PARTITION BY partition_no, term) AS n,
            row_number() OVER (PARTITION BY partition_no, term ORDER BY docid) AS r FROM postings WHERE docid IS NOT NULL)
        SELECT partition_no, term, CAST(p AS BIGINT) AS percent, docid FROM r, (SELECT unnest([{', '.join(map(str, PERCENTS))}]) AS p)
        WHERE r = greatest(1, (n * p + 99) // 100)""",
    "p2_found": f"WITH {_LINES} SELECT line_no, reason FROM reasons WHERE reason IS NOT NULL",
    "p2_fields": rf"""WITH {_LINES}, broken AS (SELECT reason,
            coalesce(good_pid, false) AND regexp_matches(line, '^{_ANY}(\t|$)', 's') AS first,
            regexp_extract(line, '^(?:{_ANY})\t({_ANY})(?:\t|$)', 3, 's') AS f2
            FROM reasons WHERE reason IS NOT NULL)
        SELECT reason, CASE WHEN NOT coalesce(first, false) THEN 'pid'
            WHEN regexp_full_match(CASE WHEN f2 LIKE '"%' THEN replace(f2[2:len(f2) - 1], '""', '"') ELSE f2 END, '{_SPACE}*', 's') THEN 'text'
            ELSE '-' END AS field, count(*) AS n_lines FROM broken GROUP BY ALL""",
    "p2_records": f"WITH {_LINES} SELECT line_no, CAST(pid AS BIGINT) AS pid, text FROM reasons WHERE reason IS NULL",
}
