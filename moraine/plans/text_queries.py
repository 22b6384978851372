"""Scans, formatting and segmentation, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..operators.ordinals import balanced_shard, dense_ordinal, modular_shard, sample_exact
from ..runtime import table
from . import common as C


def _formatted(strategy: str):
    def run(spark: SparkSession, d: str) -> DataFrame:
        return C.documents_once(spark, d).select("docid", X.format_document(strategy).alias("text"))

    return run


def tsv_safe(spark, d):
    return C.documents_once(spark, d).select("docid", X.single_line(F.col("title")).alias("title"), X.single_line(F.col("body")).alias("body"))


def collection_scan(spark, d):
    return table(spark, d, "documents").where(F.col("doc_id").isNotNull()).select(F.col("doc_id").cast("string").alias("pid"), X.single_line(F.col("text")).alias("text"))


def _ordered(spark, d):
    return dense_ordinal(table(spark, d, "documents").select("doc_id"), ["doc_id"])


def collection_shard(spark, d):
    o = _ordered(spark, d)
    n = F.lit(table(spark, d, "documents").count())
    return o.select("doc_id", "ordinal", balanced_shard(F.col("ordinal"), n, 7).alias("shard"), modular_shard(F.col("ordinal"), 4).alias("line_shard"))


def collection_lookup(spark, d):
    """Bulk lookup of judged documents; a judgement without a document has no text."""
    keys = table(spark, d, "qrels").where(F.col("docid").isNotNull()).select("docid").distinct()
    return keys.join(C.documents_once(spark, d).select("docid", F.lit(True).alias("found"), "body"), "docid", "left").select("docid", F.coalesce("found", F.lit(False)).alias("found"), "body")


def queries_dedupe(spark, d):
    return C.queries_once(spark, d)


def qrels_normalize(spark, d):
    return C.qrels(spark, d)


def qrels_positive(spark, d):
    """Every judged query with the number of its relevant documents, 0 for those without any."""
    return C.qrels(spark, d).groupBy("qid").agg(F.sum(F.when(F.col("rel") > 0, 1).otherwise(0)).cast("long").alias("n_positive"))


def passage_map(spark, d):
    return table(spark, d, "passage_to_doc").where(F.col("pid").isNotNull()).groupBy("pid").agg(F.max("docid").alias("docid"))


def _segments(spark, d):
    return X.segment(C.documents_once(spark, d).select("docid", X.format_document("title_body").alias("text")), "text", 180, 90)


def segment_passages(spark, d):
    return _segments(spark, d).select("docid", "passage_idx", F.concat("docid", F.lit("_p"), F.col("passage_idx")).alias("pid"), "passage")


def segment_tokenizer(spark, d):
    """The same windows with an injected tokenizer."""
    t = C.documents_once(spark, d).select("docid", X.format_document("title_body").alias("text"))
    return X.segment_with(t, "text", lambda text: text.split(), " ".join, 180, 90).select("docid", "passage_idx", "passage")


def segment_counts(spark, d):
    t = C.documents_once(spark, d).select("docid", F.size(X.words(X.format_document("title_body"))).alias("n_words"))
    return t.select("docid", "n_words", X.n_windows(F.col("n_words"), 180, 90).alias("n_passages"))


def segment_map_check(spark, d):
    """Passages made here that the stored map lacks, and the other way round."""
    made = _segments(spark, d).select(F.concat("docid", F.lit("_p"), F.col("passage_idx")).alias("pid"), F.lit(1).alias("made"))
    both = made.join(passage_map(spark, d).select("pid", F.lit(1).alias("stored")), "pid", "full")
    return both.groupBy(F.coalesce("made", F.lit(0)).alias("made"), F.coalesce("stored", F.lit(0)).alias("stored")).agg(F.count("*").alias("n"))


def sample_documents(spark, d):
    """An exact sample by hash (the operator's size is its parameter)."""
    return sample_exact(table(spark, d, "documents").select("doc_id"), "doc_id", 50)


QUERIES = {f"format_{s}": _formatted(s) for s in X.STRATEGIES} | {f.__name__: f for f in (tsv_safe, collection_scan, collection_shard, collection_lookup, queries_dedupe, qrels_normalize, qrels_positive, passage_map, segment_passages, segment_tokenizer, segment_counts, segment_map_check, sample_documents)}

_S = C.sql_strip
_TB = _S(f"concat_ws(' ', {_S("coalesce(title, '')")}, {_S("coalesce(body, '')")})")
_ONE = "translate(coalesce({}, ''), chr(9) || chr(13) || chr(10), '   ')"
SEG = f"w AS (SELECT docid, {C.sql_words(_TB)} AS ws FROM docs), n AS (SELECT *, CASE WHEN len(ws) <= 180 THEN 1 ELSE CAST(ceil((len(ws) - 180) / 90.0) AS INTEGER) + 1 END AS k FROM w), seg AS (SELECT docid, ws, CAST(unnest(range(0, k)) AS INTEGER) AS passage_idx FROM n)"
SQL = {
    "format_body_only": C.with_(C.DOCS) + f"SELECT docid, {_S("coalesce(body, '')")} AS text FROM docs",
    "format_title_body": C.with_(C.DOCS) + f"SELECT docid, {_TB} AS text FROM docs",
    "format_url_title_body": C.with_(C.DOCS) + f"SELECT docid, {_S(f"concat_ws(' ', {_S("coalesce(url, '')")}, {_S("coalesce(title, '')")}, {_S("coalesce(body, '')")})")} AS text FROM docs",
    "format_tagged": C.with_(C.DOCS) + f"SELECT docid, '<title>' || {_S("coalesce(title, '')")} || '</title><body>' || {_S("coalesce(body, '')")} || '</body>' AS text FROM docs",
    "tsv_safe": C.with_(C.DOCS) + f"SELECT docid, {_ONE.format('title')} AS title, {_ONE.format('body')} AS body FROM docs",
    "collection_scan": f"SELECT CAST(doc_id AS VARCHAR) AS pid, {_ONE.format('text')} AS text FROM documents WHERE doc_id IS NOT NULL",
    "collection_shard": """
WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, count(*) OVER () AS n FROM documents),
b AS (SELECT *, CAST(floor(n / 7) AS BIGINT) AS base, n % 7 AS rest FROM o)
SELECT doc_id, CAST(ordinal AS BIGINT) AS ordinal, CAST(CASE WHEN ordinal < rest * (base + 1) THEN floor(ordinal / (base + 1)) ELSE rest + floor((ordinal - rest * (base + 1)) / greatest(base, 1)) END AS INTEGER) AS shard, CAST(ordinal % 4 AS INTEGER) AS line_shard FROM b""",
    "collection_lookup": C.with_(C.DOCS) + "SELECT k.docid, d.docid IS NOT NULL AS found, d.body FROM (SELECT DISTINCT docid FROM qrels WHERE docid IS NOT NULL) k LEFT JOIN docs d USING (docid)",
    "queries_dedupe": C.with_(C.QUERIES_ONCE) + "SELECT * FROM qs",
    "qrels_normalize": C.with_(C.QRELS) + "SELECT * FROM qr",
    "qrels_positive": C.with_(C.QRELS) + "SELECT qid, CAST(count(*) FILTER (rel > 0) AS BIGINT) AS n_positive FROM qr GROUP BY qid",
    "passage_map": "SELECT pid, max(docid) AS docid FROM passage_to_doc WHERE pid IS NOT NULL GROUP BY pid",
    "segment_passages": C.with_(C.DOCS, SEG) + "SELECT docid, passage_idx, docid || '_p' || passage_idx AS pid, array_to_string(ws[passage_idx * 90 + 1 : passage_idx * 90 + 180], ' ') AS passage FROM seg",
    "segment_tokenizer": C.with_(C.DOCS, SEG) + "SELECT docid, passage_idx, array_to_string(ws[passage_idx * 90 + 1 : passage_idx * 90 + 180], ' ') AS passage FROM seg",
    "segment_counts": C.with_(C.DOCS, SEG) + "SELECT docid, CAST(len(ws) AS INTEGER) AS n_words, CAST(k AS INTEGER) AS n_passages FROM n",
    "segment_map_check": C.with_(C.DOCS, SEG) + "SELECT CAST(m.pid IS NOT NULL AS INTEGER) AS made, CAST(s.pid IS NOT NULL AS INTEGER) AS stored, count(*) AS n FROM (SELECT docid || '_p' || passage_idx AS pid FROM seg) m FULL JOIN (SELECT DISTINCT pid FROM passage_to_doc WHERE pid IS NOT NULL) s USING (pid) GROUP BY 1, 2",
    "sample_documents": "SELECT doc_id FROM documents ORDER BY md5(concat_ws('|', '42', CAST(doc_id AS VARCHAR))), doc_id LIMIT 50",
}
