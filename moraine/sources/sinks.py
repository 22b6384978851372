"""Writers of the file formats of retrieval collections."""

from __future__ import annotations

import json

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import single_line
from ..runtime import put_text


def trec_line(run: Column) -> Column:
    """``qid Q0 pid rank score run`` with tabs, the score with six decimals."""
    return F.concat_ws("\t", "qid", F.lit("Q0"), "pid", F.col("rank").cast("string"), F.format_string("%.6f", F.col("score").cast("double")), run)


def write_run(ranking: DataFrame, path: str, run_name: str) -> None:
    """A TREC run, ordered by query and rank. ``ranking``: qid, pid, score, rank."""
    ranking.orderBy("qid", "rank").select(trec_line(F.lit(run_name)).alias("value")).write.mode("overwrite").text(path)


def write_tsv(df: DataFrame, path: str, *cols: str) -> None:
    df.select(F.concat_ws("\t", *[single_line(F.col(c)) for c in cols]).alias("value")).write.mode("overwrite").text(path)


def write_tuples(tuples: DataFrame, path: str) -> None:
    tuples.select("qid", "query", "pids", "scores", "positive_idx").write.mode("overwrite").json(path)


def write_metrics(metrics: dict, path: str) -> None:
    """A small JSON file, put in place in one step."""
    put_text(SparkSession.active(), path, json.dumps(metrics, indent=2, sort_keys=True))


def write_lines(df: DataFrame, path: str, line: Column, *order: str) -> None:
    """Lines of text, in the order of columns where any are named."""
    (df.orderBy(*order) if order else df).select(line.alias("value")).write.mode("overwrite").text(path)
