"""Run files for external evaluation: `qid Q0 docno rank score tag`."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def run_lines(results: DataFrame, tag: str) -> DataFrame:
    """line: one for each result, fields parted by single spaces, scores with 6 digits."""
    score = F.format_string("%.6f", F.col("score"))
    return results.select(F.concat_ws(" ", F.col("qid").cast("string"), F.lit("Q0"), F.col("doc_id").cast("string"), F.col("rank").cast("string"), score, F.lit(tag)).alias("line"))


def write_run(results: DataFrame, path: str, tag: str) -> None:
    """A run in order of query and rank; its size is k lines a query."""
    ordered = results.repartitionByRange("qid").sortWithinPartitions("qid", "rank")
    run_lines(ordered, tag).write.mode("overwrite").text(path)
