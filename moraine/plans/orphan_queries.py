"""Queries on orphan references, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ..operators import orphans
from ..runtime import table


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    refs = orphans.retrieval_references(table(spark, d, "qrels"), table(spark, d, "tuples"))
    return orphans.orphan_references(refs, table(spark, d, "passage_to_doc"), table(spark, d, "msmarco_docs"), table(spark, d, "doc_removals"))


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    return orphans.orphan_counts(p3_found(spark, d))


QUERIES = {"p3_found": p3_found, "p3_report": p3_report}

_FOUND = """
WITH refs AS (
  SELECT 'qrels' AS tbl, qid, docid AS ref_key, judged_at AS ts, docid FROM qrels WHERE docid IS NOT NULL
  UNION
  SELECT 'tuples', qid, u.pid, built_at, p.docid FROM (SELECT qid, built_at, unnest(pids) AS pid FROM tuples) u LEFT JOIN passage_to_doc p ON u.pid = p.pid WHERE u.pid IS NOT NULL),
born AS (SELECT docid, min(ingested_at) AS born FROM msmarco_docs GROUP BY docid),
gone AS (SELECT docid, min(removed_at) AS gone FROM doc_removals GROUP BY docid),
judged AS (
  SELECT tbl, strftime(ts AT TIME ZONE 'UTC', '%Y-%m') AS ref_month, qid, ref_key,
    CASE WHEN r.docid IS NULL THEN 'missing' WHEN gone <= ts THEN 'deleted' WHEN b.docid IS NULL THEN 'missing' WHEN born > ts THEN 'late' END AS kind
  FROM refs r LEFT JOIN born b ON r.docid = b.docid LEFT JOIN gone g ON r.docid = g.docid)
SELECT DISTINCT * FROM judged WHERE kind IS NOT NULL"""

SQL = {"p3_found": _FOUND, "p3_report": f"SELECT tbl, ref_month, kind, count(*) AS n_refs, count(DISTINCT ref_key) AS n_keys FROM ({_FOUND}) GROUP BY ALL"}
