"""Inputs the queries share, as DataFrames and as SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.text import words
from ..operators import metrics
from ..runtime import table

_SPACE = r"\s\x0b\x1c-\x1f\x{85}\x{a0}\x{1680}\x{2000}-\x{200a}\x{2028}\x{2029}\x{202f}\x{205f}\x{3000}"


def documents_once(spark: SparkSession, d: str) -> DataFrame:
    """Raw documents, one row per docid."""
    return table(spark, d, "msmarco_docs").where(F.col("docid").isNotNull()).groupBy("docid").agg(*[F.max(c).alias(c) for c in ("url", "title", "body")])


DOCS = "docs AS (SELECT docid, max(url) AS url, max(title) AS title, max(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY docid)"


def sql_strip(c: str) -> str:
    return f"regexp_replace({c}, '^[{_SPACE}]+|[{_SPACE}]+$', '', 'g')"


def sql_words(c: str) -> str:
    return f"regexp_extract_all(coalesce({c}, ''), '[^{_SPACE}]+')"


def queries_once(spark: SparkSession, d: str) -> DataFrame:
    """Queries, one text per qid (the greatest, as row order carries no meaning)."""
    return table(spark, d, "queries").where(F.col("qid").isNotNull()).groupBy("qid").agg(F.max("text").alias("text"))


QUERIES_ONCE = "qs AS (SELECT qid, max(text) AS text FROM queries WHERE qid IS NOT NULL GROUP BY qid)"


def qrels(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clean_qrels(table(spark, d, "qrels"))


QRELS = "qr AS (SELECT qid, docid AS pid, rel FROM (SELECT *, row_number() OVER (PARTITION BY qid, docid ORDER BY loaded_at DESC NULLS LAST, rel DESC) AS n FROM qrels WHERE qid IS NOT NULL AND docid IS NOT NULL AND rel IS NOT NULL) WHERE n = 1)"


def runs(spark: SparkSession, d: str) -> DataFrame:
    return metrics.clean_runs(table(spark, d, "top100"))


RUNS = "rn AS (SELECT run, qid, pid, CAST(row_number() OVER (PARTITION BY run, qid ORDER BY given ASC NULLS LAST, pid) AS INTEGER) AS rank FROM (SELECT DISTINCT run, qid, docid AS pid, rank AS given FROM top100 WHERE qid IS NOT NULL AND docid IS NOT NULL))"


def token_ids(text: Column) -> Column:
    """Ids of white-space words by hash: a tokenizer both engines know."""
    return F.transform(words(text), lambda w: (F.conv(F.substring(F.md5(w), 1, 6), 16, 10).cast("int") % 30000 + 10).cast("int"))


def sql_token_ids(c: str) -> str:
    return f"list_transform({sql_words(c)}, lambda w: CAST(CAST('0x' || substr(md5(w), 1, 6) AS INTEGER) % 30000 + 10 AS INTEGER))"


def joined(ids: Column) -> Column:
    """An array of numbers or truth values as text, for comparison across engines."""
    return F.array_join(F.transform(ids, lambda x: x.cast("string")), ",")


def token_vectors(spark: SparkSession, d: str) -> DataFrame:
    """The embeddings as token vectors: eight to a document."""
    e = table(spark, d, "embeddings").where(F.col("vec_id").isNotNull() & F.col("embedding").isNotNull())
    return e.select("vec_id", F.floor(F.col("vec_id") / 8).cast("long").alias("doc_idx"), F.pmod("vec_id", F.lit(8)).cast("int").alias("pos"), F.transform("embedding", lambda x: x.cast("double")).alias("vec"), F.col("label").alias("label"))


E = "e AS (SELECT vec_id, CAST(floor(vec_id / 8) AS BIGINT) AS doc_idx, CAST(vec_id % 8 AS INTEGER) AS pos, CAST(embedding AS DOUBLE[]) AS v, label FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL)"


def query_vectors(vecs: DataFrame) -> DataFrame:
    """The stated query set: the tokens of every document whose number is divisible by 50."""
    return vecs.where(F.pmod("doc_idx", F.lit(50)) == 0).select(F.col("doc_idx").alias("qid"), F.col("pos").alias("qpos"), F.col("vec").alias("qvec"))


Q = "q AS (SELECT doc_idx AS qid, pos AS qpos, v AS qv FROM e WHERE doc_idx % 50 = 0)"
CEN = "cm AS (SELECT label AS cid, d, round(avg(x), 6) AS m FROM (SELECT label, unnest(range(1, len(v) + 1)) AS d, unnest(v) AS x FROM e) GROUP BY label, d), cen AS (SELECT cid, list(m ORDER BY d) AS c FROM cm GROUP BY cid)"
NEAR = "near AS (SELECT vec_id, doc_idx, pos, v, cid, c, sim FROM (SELECT *, row_number() OVER (PARTITION BY vec_id ORDER BY sim DESC, cid) AS r FROM (SELECT e.*, cen.*, round(list_dot_product(v, c), 6) AS sim FROM e, cen)) WHERE r = 1)"
RES = "res AS (SELECT vec_id, unnest(range(0, len(v))) AS d, unnest(v) - unnest(c) AS x FROM near)"
#: Two bits, four buckets a dimension.
PAR = """sr AS (SELECT d, x, row_number() OVER (PARTITION BY d ORDER BY x) - 1 AS r, count(*) OVER (PARTITION BY d) AS n FROM res),
bk AS (SELECT sr.*, b, CAST(floor(b * n / 4) AS BIGINT) AS lo, CASE WHEN b = 3 THEN n ELSE CAST(floor((b + 1) * n / 4) AS BIGINT) END AS hi FROM sr, (SELECT unnest(range(0, 4)) AS b)),
par AS (SELECT d, b, max(CASE WHEN b < 3 AND r = least(hi, n - 1) THEN x END) AS boundary, round(avg(CASE WHEN r >= lo AND r < hi THEN x END), 6) AS val FROM bk GROUP BY d, b)"""
CODES = "codes AS (SELECT vec_id, res.d, CAST(sum(CASE WHEN x > boundary THEN 1 ELSE 0 END) AS INTEGER) AS code FROM res JOIN par ON res.d = par.d AND b < 3 GROUP BY vec_id, res.d)"


def with_(*parts: str) -> str:
    return "WITH " + ",\n".join(parts) + "\n"
