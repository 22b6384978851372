"""Readers, writers and file pipelines, with their SQL.

Each query writes a whole table in a file format into the shared folder, reads
it back with the reader at hand, or sends it through a pipeline first.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..config import Config
from ..functions.text import filled, single_line, strip
from ..operators import metrics as M
from ..runtime import shared_dir, table
from ..sources import readers as S
from ..sources import sinks as K
from . import common as C
from . import pipelines as P
from .mining_queries import SQL as MINING
from .mining_queries import _candidates, triples_hash_sampled
from .metric_queries import SQL as METRICS
from .text_queries import SEG


def _at(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/files-{uuid.uuid4().hex}/{name}"


def _collection(spark: SparkSession, d: str) -> str:
    path = _at(spark, "collection.tsv")
    docs = table(spark, d, "documents").where(F.col("doc_id").isNotNull())
    K.write_lines(docs, path, F.concat_ws("\t", F.col("doc_id").cast("string"), single_line(F.col("text"))), "doc_id")
    return path


def read_collection(spark, d):
    return S.read_collection(spark, _collection(spark, d)).select("ordinal", "pid", "text")


def read_shard(spark, d):
    """The third of seven shards of the collection, from its fourth row on."""
    return S.shard_rows(S.read_collection(spark, _collection(spark, d)), 2, 7, 3).select("pid")


def count_lines(spark, d):
    return spark.createDataFrame([(S.count_lines(spark, _collection(spark, d)),)], "n long")


def _queries(spark: SparkSession, d: str) -> str:
    """All rows of the queries, a qid's greatest text last."""
    path = _at(spark, "queries.tsv")
    K.write_lines(table(spark, d, "queries").where(F.col("qid").isNotNull()).select("qid", single_line(F.col("text")).alias("text")), path, F.concat_ws("\t", "qid", "text"), "qid", "text")
    return path


def read_queries(spark, d):
    return S.read_train_queries(spark, _queries(spark, d)).select("qid", "text")


def copy_queries(spark, d):
    source, out = _queries(spark, d), _at(spark, "copy.tsv")
    P.copy_queries(spark, source, out)
    return S.lines(spark, out).select(F.col("value").alias("line"))


def _qrels(spark: SparkSession, d: str) -> str:
    """All judgements in four columns, which hold no blanks at their ends; a pair's highest last; those without a number say so."""
    path = _at(spark, "qrels.tsv")
    q = table(spark, d, "qrels").where(F.col("qid").isNotNull() & F.col("docid").isNotNull()).withColumn("docid", strip(F.col("docid")))
    K.write_lines(q, path, F.concat_ws(" ", "qid", F.lit("0"), "docid", F.coalesce(F.col("rel").cast("string"), F.lit("none"))), "qid", "docid", "rel")
    return path


def read_qrels(spark, d):
    return S.read_qrels(spark, _qrels(spark, d))


def read_train_positives(spark, d):
    return S.read_train_positives(spark, _qrels(spark, d))


def normalize_qrels(spark, d):
    """Four columns to three, unchecked and undeduplicated."""
    out = _at(spark, "qrels3.tsv")
    P.normalize_qrels(spark, _qrels(spark, d), out)
    return S.lines(spark, out).select(F.col("value").alias("line"))


def _run(spark: SparkSession, d: str) -> str:
    """The candidates of all runs as one run, with their places as ranks."""
    path = _at(spark, "run.trec")
    c = _candidates(spark, d).select("qid", F.col("docid").alias("pid"), F.row_number().over(Window.partitionBy("qid").orderBy("ord", "docid")).alias("rank"))
    K.write_run(c.withColumn("score", F.lit(1.0) / F.col("rank")), path, "all")
    return path


def read_run(spark, d):
    run = S.read_run(spark, _run(spark, d))
    return run.select("qid", "docid", F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).alias("place"))


def read_tuples(spark, d):
    path = _at(spark, "tuples.jsonl")
    K.write_tuples(table(spark, d, "tuples").where(F.col("qid").isNotNull()), path)
    t = S.read_tuples(spark, path)
    return t.select("qid", "query", F.array_join("pids", ",", "-").alias("pids"), F.array_join(F.transform("scores", lambda s: F.when(s.isNotNull(), F.format_string("%.6f", s))), ",", "-").alias("scores"), "positive_idx")


def _triples(spark: SparkSession, d: str) -> str:
    path = _at(spark, "triples.tsv")
    t = triples_hash_sampled(spark, d).join(C.queries_once(spark, d).select("qid", single_line(F.col("text")).alias("query")), "qid")
    K.write_lines(t, path, F.concat_ws("\t", "query", "pos", "neg"), "query", "pos", "neg")
    return path


def read_triples(spark, d):
    return S.read_triples(spark, _triples(spark, d)).select("query", "pos", "neg")


def head_triples(spark, d):
    return S.head(S.read_triples(spark, _triples(spark, d)), 5).select("query", "pos", "neg")


def _map(spark: SparkSession, d: str) -> str:
    path = _at(spark, "passage_to_doc.tsv")
    K.write_tsv(table(spark, d, "passage_to_doc").where(F.col("pid").isNotNull()), path, "pid", "docid")
    return path


def read_passage_map(spark, d):
    return S.read_passage_map(spark, _map(spark, d))


def _documents(spark: SparkSession, d: str) -> str:
    path = _at(spark, "docs.tsv")
    K.write_tsv(C.documents_once(spark, d), path, "docid", "url", "title", "body")
    return path


def read_documents(spark, d):
    return S.read_documents(spark, _documents(spark, d)).select("docid", "url", "title", "body")


def read_beir_corpus(spark, d):
    path = _at(spark, "corpus.jsonl")
    C.documents_once(spark, d).select(F.col("docid").alias("_id"), "title", F.col("body").alias("text")).write.json(path)
    return S.read_beir_corpus(spark, path)


def read_beir_queries(spark, d):
    path = _at(spark, "queries.jsonl")
    C.queries_once(spark, d).select(F.col("qid").alias("_id"), "text").write.json(path)
    return S.read_beir_queries(spark, path).select("qid", filled(F.col("text")).alias("text"))


def read_lotte_qas(spark, d):
    path = _at(spark, "qas.search.jsonl")
    C.qrels(spark, d).where("rel > 0").groupBy("qid").agg(F.collect_list("pid").alias("answer_pids")).write.json(path)  # the judged documents of a query
    return S.read_lotte_qas(spark, path)


def metrics_file(spark, d):
    """The metrics of every run through a JSON file."""
    path = _at(spark, "metrics.json")
    got = {r["run"]: {k: v for k, v in r.asDict().items() if k != "run"} for r in M.evaluate(C.runs(spark, d), C.qrels(spark, d)).collect()}  # a row a run
    K.write_metrics(got, path)
    kinds = "map<string,struct<mrr_10:double,recall_50:double,recall_1000:double,ndcg_10:double,success_5:double>>"
    back = spark.read.text(path, wholetext=True).select(F.explode(F.from_json("value", kinds)).alias("run", "m"))
    return back.select("run", "m.*")


def preprocess_documents(spark, d):
    """Raw documents through the pipeline to a collection of whole texts."""
    out = _at(spark, "out")
    P.preprocess(spark, _documents(spark, d), out, Config())
    return S.read_collection(spark, f"{out}/collection.docs.tsv").select("pid", "text")


def preprocess_passages(spark, d):
    """The same to passages, joined with their map."""
    out = _at(spark, "out")
    P.preprocess(spark, _documents(spark, d), out, Config(), passages=True)
    return S.read_collection(spark, f"{out}/collection.passages.tsv").select("pid", "text").join(S.read_passage_map(spark, f"{out}/passage_to_doc.tsv"), "pid").select("pid", "docid", "text")


def build_triples(spark, d):
    """Judgements, a run and queries from files to triples in a file."""
    out = _at(spark, "triples.tsv")
    P.build_triples(spark, _queries(spark, d), _qrels(spark, d), _run(spark, d), out, 2)
    return S.read_triples(spark, out).select("query", "pos", "neg")


def distill_file(spark, d):
    """A run from a file, scored by an injected stand-in, to tuples in a file."""

    def predict(pairs):
        import hashlib

        return [int(hashlib.md5(f"{q}|{t}".encode()).hexdigest()[:6], 16) / 1e6 for q, t in pairs]

    texts, out = _at(spark, "texts.tsv"), _at(spark, "tuples.jsonl")
    P.preprocess(spark, _documents(spark, d), texts, Config())
    run = S.read_run(spark, _run(spark, d)).select("qid", F.col("docid").alias("pid"), F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).alias("rank"))
    P.distill(spark, f"{texts}/collection.docs.tsv", _queries(spark, d), _qrels(spark, d), run, predict, out, Config(nway=4, top_k_distill=10))
    t = S.read_tuples(spark, out, 4)
    return t.select("qid", F.array_join("pids", ",").alias("pids"), F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",").alias("scores"), "positive_idx")


QUERIES = {f.__name__: f for f in (read_collection, read_shard, count_lines, read_queries, copy_queries, read_qrels, read_train_positives, normalize_qrels, read_run, read_tuples, read_triples, head_triples, read_passage_map, read_documents, read_beir_corpus, read_beir_queries, read_lotte_qas, metrics_file, preprocess_documents, preprocess_passages, build_triples, distill_file)}

_ONE = "translate(coalesce({}, ''), chr(9) || chr(13) || chr(10), '   ')"
_RAW = f"docs AS (SELECT docid, {_ONE.format('max(url)')} AS url, {_ONE.format('max(title)')} AS title, {_ONE.format('max(body)')} AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY docid)"
_TEXT = C.sql_strip(f"concat_ws(' ', {C.sql_strip('title')}, {C.sql_strip('body')})")
_QS = f"qs AS (SELECT qid, max({_ONE.format('text')}) AS text FROM queries WHERE qid IS NOT NULL GROUP BY qid)"
_FILE = "f AS (SELECT hs.qid, text AS query, pos, neg FROM hs JOIN qs USING (qid))"
_HS = MINING["triples_hash_sampled"].removesuffix("SELECT * FROM hs")
_DOCID = C.sql_strip("docid")
_FPS = f"ps AS (SELECT DISTINCT qid, {_DOCID} AS docid FROM qrels WHERE qid IS NOT NULL AND docid IS NOT NULL AND rel > 0)"
_LAST = f"qr AS (SELECT qid, {_DOCID} AS pid, max(rel) AS rel FROM qrels WHERE qid IS NOT NULL AND docid IS NOT NULL AND rel IS NOT NULL GROUP BY 1, 2)"
_SCORED = MINING["distill_scored"]
SQL = {
    "read_collection": f"SELECT row_number() OVER (ORDER BY doc_id) - 1 AS ordinal, CAST(doc_id AS VARCHAR) AS pid, {_ONE.format('text')} AS text FROM documents WHERE doc_id IS NOT NULL",
    "read_shard": "WITH o AS (SELECT doc_id, row_number() OVER (ORDER BY doc_id) - 1 AS r, count(*) OVER () AS n FROM documents WHERE doc_id IS NOT NULL) SELECT CAST(doc_id AS VARCHAR) AS pid FROM o WHERE r >= 2 * (n // 7) + least(2, n % 7) + 3 AND r < 3 * (n // 7) + least(3, n % 7)",
    "count_lines": "SELECT count(*) AS n FROM documents WHERE doc_id IS NOT NULL",
    "read_queries": C.with_(_QS) + "SELECT * FROM qs",
    "copy_queries": f"SELECT qid || chr(9) || {_ONE.format('text')} AS line FROM queries WHERE qid IS NOT NULL",
    "read_qrels": C.with_(_LAST) + "SELECT qid, pid AS docid, rel FROM qr",
    "read_train_positives": C.with_(_FPS) + "SELECT * FROM ps",
    "normalize_qrels": f"SELECT concat_ws(chr(9), qid, {_DOCID}, coalesce(CAST(rel AS VARCHAR), 'none')) AS line FROM qrels WHERE qid IS NOT NULL AND docid IS NOT NULL",
    "read_run": C.with_(C.RUNS) + "SELECT qid, docid, CAST(row_number() OVER (PARTITION BY qid ORDER BY ord, docid) AS INTEGER) AS place FROM (SELECT qid, pid AS docid, min(rank) AS ord FROM rn GROUP BY ALL)",
    "read_tuples": "SELECT qid, query, array_to_string(list_transform(pids, lambda p: coalesce(p, '-')), ',') AS pids, array_to_string(list_transform(scores, lambda s: coalesce(format('{:.6f}', s), '-')), ',') AS scores, positive_idx FROM tuples WHERE qid IS NOT NULL",
    "read_triples": _HS.rstrip() + ",\n" + _QS + ",\n" + _FILE + " SELECT query, pos, neg FROM f",
    "head_triples": _HS.rstrip() + ",\n" + _QS + ",\n" + _FILE + " SELECT query, pos, neg FROM f ORDER BY query, pos, neg LIMIT 5",
    "read_passage_map": "SELECT pid, max(docid) AS docid FROM passage_to_doc WHERE pid IS NOT NULL GROUP BY pid",
    "read_documents": C.with_(_RAW) + "SELECT * FROM docs",
    "read_beir_corpus": C.with_(C.DOCS) + f"SELECT docid AS pid, {C.sql_strip(_ONE.format("(coalesce(title, '') || ' ' || coalesce(body, ''))"))} AS text FROM docs",
    "read_beir_queries": C.with_(C.QUERIES_ONCE) + f"SELECT qid, {C.sql_strip(_ONE.format('text'))} AS text FROM qs",
    "read_lotte_qas": C.with_(C.QRELS) + "SELECT qid, pid AS docid, CAST(1 AS INTEGER) AS rel FROM qr WHERE rel > 0",
    "metrics_file": METRICS["evaluate_ranking"],
    "preprocess_documents": C.with_(_RAW) + f"SELECT docid AS pid, {_TEXT} AS text FROM docs",
    "preprocess_passages": C.with_(_RAW, SEG) + "SELECT docid || '_p' || passage_idx AS pid, docid, array_to_string(ws[passage_idx * 90 + 1 : passage_idx * 90 + 180], ' ') AS text FROM seg",
    "build_triples": _HS.rstrip().replace("ps AS (SELECT qid, pid AS docid FROM qr WHERE rel > 0)", _FPS) + ",\n" + _QS + ",\n" + _FILE + " SELECT query, pos, neg FROM f",
    "distill_file": _SCORED.replace(C.DOCS, _RAW).replace(C.QUERIES_ONCE, _QS).replace(C.QRELS, _LAST),
}
