"""Readers of the file formats of retrieval collections.

Text files are split at line feeds only and one trailing carriage return is
dropped, so a bare carriage return never splits a row. Invalid UTF-8 becomes
U+FFFD. Malformed rows are dropped unless a reader says otherwise.
"""

from __future__ import annotations

from pathlib import PurePosixPath

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..functions.text import filled, single_line, strip
from ..operators.ordinals import with_line_no
from ..runtime import exists

TUPLE_SCHEMA = T.StructType(
    [
        T.StructField("qid", T.StringType()),
        T.StructField("query", T.StringType()),
        T.StructField("pids", T.ArrayType(T.StringType())),
        T.StructField("scores", T.ArrayType(T.DoubleType())),
        T.StructField("positive_idx", T.IntegerType()),
    ]
)


def lines(spark: SparkSession, path: str) -> DataFrame:
    """``line_no`` and ``value`` of a text file."""
    df = with_line_no(spark.read.option("lineSep", "\n").text(path))
    return df.withColumn("value", F.regexp_replace("value", "\r$", ""))


def _fields(n: int = -1) -> Column:
    return F.split("value", "\t", n)


def _ws() -> Column:
    return F.split(strip(F.col("value")), r"\s+")


def _last(df: DataFrame, keys: list[str], *values: str) -> DataFrame:
    """Of rows with equal keys the values of the last line."""
    return df.groupBy(*keys).agg(*[F.max_by(v, "line_no").alias(v) for v in values], F.min("line_no").alias("ordinal"))


def read_collection(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, pid, text)`` of ``pid <tab> text``; the text may hold tabs. Empty pids are dropped, of repeated ones the last text counts."""
    df = lines(spark, path).where(F.instr("value", "\t") > 1)
    df = df.select("line_no", F.get(_fields(2), F.lit(0)).alias("pid"), F.get(_fields(2), F.lit(1)).alias("text"))
    return _last(df, ["pid"], "text")


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    """``(ordinal, qid, text)`` of ``qid <tab> text``; the qid may be empty. Repeated qids keep the first place and the last text."""
    df = lines(spark, path).where(F.instr("value", "\t") > 0)
    df = df.select("line_no", F.get(_fields(2), F.lit(0)).alias("qid"), F.get(_fields(2), F.lit(1)).alias("text"))
    return _last(df, ["qid"], "text")


def read_qrels(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, docid, rel)``: three columns, or four and more with the second ignored; rows without an integer are dropped, the last of equal pairs counts."""
    w = lines(spark, path).withColumn("w", _ws()).where(F.size("w") >= 3)
    four = F.size("w") >= 4
    df = w.select("line_no", F.get("w", F.lit(0)).alias("qid"), F.when(four, F.get("w", F.lit(2))).otherwise(F.get("w", F.lit(1))).alias("docid"), F.when(four, F.get("w", F.lit(3))).otherwise(F.get("w", F.lit(2))).try_cast("int").alias("rel"))
    return _last(df.where(F.col("rel").isNotNull()), ["qid", "docid"], "rel").drop("ordinal")


def read_train_queries(spark: SparkSession, path: str) -> DataFrame:
    """As :func:`read_queries`; a file that is not there holds none."""
    return read_queries(spark, path) if exists(spark, path) else spark.createDataFrame([], "qid string, text string, ordinal long")


def read_train_positives(spark: SparkSession, path: str) -> DataFrame:
    """Distinct ``(qid, docid)`` with a positive judgement; only rows of four columns or more count."""
    w = lines(spark, path).withColumn("w", _ws()).where(F.size("w") >= 4)
    return w.where(F.get("w", F.lit(3)).try_cast("int") > 0).select(F.get("w", F.lit(0)).alias("qid"), F.get("w", F.lit(2)).alias("docid")).distinct()


def read_run(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, qid, docid)`` of a TREC run in file order; rank and score are not used."""
    w = lines(spark, path).withColumn("w", _ws()).where(F.size("w") >= 3)
    return w.select("line_no", F.get("w", F.lit(0)).alias("qid"), F.get("w", F.lit(2)).alias("docid"))


def read_triples(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, query, pos, neg)``; only rows of exactly three fields."""
    df = lines(spark, path).withColumn("f", _fields()).where(F.size("f") == 3)
    return df.select("line_no", *[F.get("f", F.lit(k)).alias(c) for k, c in enumerate(("query", "pos", "neg"))])


def read_tuples(spark: SparkSession, path: str, nway: int | None = None) -> DataFrame:
    """Distillation tuples of a JSON-lines file; an empty file is an error, and so, with ``nway``, is a tuple of another size."""
    df = spark.read.schema(TUPLE_SCHEMA).json(path).where(F.col("qid").isNotNull())
    if df.isEmpty():
        raise ValueError(f"{path} holds no tuples")
    if nway is not None:
        fits = (F.size("pids") == nway) & (F.size("scores") == nway)
        df = df.where(F.assert_true(F.coalesce(fits, F.lit(False)), F.concat(F.lit(f"not a tuple of {nway}: query "), F.col("qid"))).isNull())
    return df


def read_passage_map(spark: SparkSession, path: str) -> DataFrame:
    """``(pid, docid)``, the last of equal pids; a line without a tab is an error."""
    df = lines(spark, path)
    df = df.withColumn("ok", F.assert_true(F.instr("value", "\t") > 0, F.concat(F.lit("no tab in line "), F.col("line_no")))).where(F.col("ok").isNull())
    df = df.select("line_no", F.get(_fields(2), F.lit(0)).alias("pid"), F.get(_fields(2), F.lit(1)).alias("docid"))
    return _last(df, ["pid"], "docid").drop("ordinal")


def read_documents(spark: SparkSession, path: str) -> DataFrame:
    """``(line_no, docid, url, title, body)``; blank lines are skipped, missing fields are empty, the body keeps further tabs."""
    df = lines(spark, path).where(strip(F.col("value")) != "").withColumn("f", _fields(4))
    return df.select("line_no", *[filled(F.get("f", F.lit(k))).alias(c) for k, c in enumerate(("docid", "url", "title", "body"))])


def read_beir_corpus(spark: SparkSession, path: str) -> DataFrame:
    """``(pid, text)`` of a BEIR corpus file: title and text, on one line."""
    df = spark.read.schema("_id string, title string, text string").json(path)
    return df.select(F.col("_id").alias("pid"), strip(single_line(F.concat(filled(F.col("title")), F.lit(" "), filled(F.col("text"))))).alias("text"))


def read_beir_queries(spark: SparkSession, path: str) -> DataFrame:
    df = spark.read.schema("_id string, text string").json(path)
    return df.select(F.col("_id").alias("qid"), strip(single_line(F.col("text"))).alias("text"))


def lotte_paths(root: str, topic: str, split: str, kind: str) -> dict[str, str]:
    """Files of one LoTTE topic; ``kind`` is search or forum."""
    if kind not in ("search", "forum"):
        raise ValueError("search or forum")
    at = PurePosixPath(root) / topic / split
    return {"collection": str(at / "collection.tsv"), "queries": str(at / f"questions.{kind}.tsv"), "qrels": str(at / f"qrels.{kind}.tsv"), "qas": str(at / f"qas.{kind}.jsonl")}


def read_lotte_qas(spark: SparkSession, path: str) -> DataFrame:
    """``(qid, docid, rel)`` of a LoTTE answer file: every listed passage is relevant."""
    df = spark.read.schema("qid string, answer_pids array<string>").json(path)
    return df.where(F.col("qid").isNotNull()).select("qid", F.explode("answer_pids").alias("docid"), F.lit(1).alias("rel")).where(F.col("docid").isNotNull()).distinct()


def count_lines(spark: SparkSession, path: str) -> int:
    """Number of lines, with or without a line feed at the end."""
    return spark.read.option("lineSep", "\n").text(path).count()


def head(df: DataFrame, n: int = 5) -> DataFrame:
    return df.orderBy("line_no").limit(n)


def shard_rows(collection: DataFrame, rank: int, shards: int, start: int = 0) -> DataFrame:
    """The rows of one contiguous, balanced shard of a collection from its ``start``-th row on."""
    from ..operators.ordinals import balanced_shard, dense_ordinal

    dense = dense_ordinal(collection.select("ordinal", "pid", "text"), ["ordinal"], "row")
    n = F.lit(collection.count())
    mine = dense.withColumn("shard", balanced_shard(F.col("row"), n, shards)).where(F.col("shard") == rank)
    return mine.where(F.col("row") >= mine.agg(F.min("row")).scalar() + start).select("ordinal", "pid", "text")
