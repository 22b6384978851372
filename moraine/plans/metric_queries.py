"""Metrics of all runs in top100 against the judgements, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import metrics as M
from ..sources.sinks import trec_line
from . import common as C


def mrr_at_10(spark, d):
    return M.mrr_at(C.runs(spark, d), C.qrels(spark, d), 10)


def recall_at_50(spark, d):
    return M.recall_at(C.runs(spark, d), C.qrels(spark, d), 50)


def recall_at_1000(spark, d):
    return M.recall_at(C.runs(spark, d), C.qrels(spark, d), 1000)


def success_at_5(spark, d):
    return M.success_at(C.runs(spark, d), C.qrels(spark, d), 5)


def ndcg_at_10(spark, d):
    return M.ndcg_at(C.runs(spark, d), C.qrels(spark, d), 10)


def evaluate_ranking(spark, d):
    return M.evaluate(C.runs(spark, d), C.qrels(spark, d))


def macro_average(spark, d):
    per = M.ndcg_at(C.runs(spark, d), C.qrels(spark, d), 10, digits=12)
    return M.macro_average(per, F.regexp_extract("run", "^([^_]+)", 1).alias("family"), "ndcg")


def run_ranking(spark, d):
    return C.runs(spark, d)


def trec_lines(spark, d):
    """Every run in TREC form, scored by 1 / rank where the run gives none."""
    return C.runs(spark, d).withColumn("score", F.lit(1.0) / F.col("rank")).select(trec_line(F.col("run")).alias("line"))


QUERIES = {f.__name__: f for f in (mrr_at_10, recall_at_50, recall_at_1000, success_at_5, ndcg_at_10, evaluate_ranking, macro_average, run_ranking, trec_lines)}

_POS = "ps AS (SELECT qid, count(*) AS n FROM qr WHERE rel > 0 GROUP BY qid)"
_J = "j AS (SELECT rn.run, rn.qid, rn.pid, rn.rank, qr.rel FROM rn LEFT JOIN qr ON rn.qid = qr.qid AND rn.pid = qr.pid)"
_BASE = (C.QRELS, C.RUNS, _POS, _J)
_MRR = "mrr AS (SELECT run, round(sum(coalesce(1.0 / r, 0.0)) / (SELECT greatest(count(DISTINCT qid), 1) FROM qr), 6) AS mrr FROM (SELECT run, qid, min(CASE WHEN rel > 0 THEN rank END) AS r FROM j WHERE rank <= 10 AND qid IN (SELECT qid FROM qr) GROUP BY run, qid) GROUP BY run)"
_REC = "rec{k} AS (SELECT run, round(sum(h / n) / (SELECT greatest(count(*), 1) FROM ps), 6) AS recall FROM (SELECT run, qid, count(DISTINCT CASE WHEN rel > 0 THEN pid END) AS h FROM j WHERE rank <= {k} GROUP BY run, qid) JOIN ps USING (qid) GROUP BY run)"
_SUC = "suc AS (SELECT run, round(sum(h) / (SELECT greatest(count(*), 1) FROM ps), 6) AS success FROM (SELECT run, qid, max(CASE WHEN rel > 0 THEN 1.0 ELSE 0.0 END)::DOUBLE AS h FROM j WHERE rank <= 5 GROUP BY run, qid) JOIN ps USING (qid) GROUP BY run)"
_NDCG = """ideal AS (SELECT qid, sum(CASE WHEN rel > 0 THEN (pow(2.0, rel) - 1) / log2(r + 1.0) ELSE 0.0 END)::DOUBLE AS idcg FROM (SELECT qid, rel, row_number() OVER (PARTITION BY qid ORDER BY rel DESC) AS r FROM qr) WHERE r <= 10 GROUP BY qid),
dcg AS (SELECT run, qid, sum(CASE WHEN rel > 0 THEN (pow(2.0, rel) - 1) / log2(rank + 1.0) ELSE 0.0 END)::DOUBLE AS dcg FROM j WHERE rank <= 10 GROUP BY run, qid),
ndcg AS (SELECT run, round(sum(CASE WHEN idcg > 0 THEN dcg / idcg ELSE 0.0 END)::DOUBLE / (SELECT greatest(count(DISTINCT qid), 1) FROM qr), 6) AS ndcg FROM dcg JOIN ideal USING (qid) GROUP BY run)"""
SQL = {
    "mrr_at_10": C.with_(*_BASE, _MRR) + "SELECT * FROM mrr",
    "recall_at_50": C.with_(*_BASE, _REC.format(k=50)) + "SELECT * FROM rec50",
    "recall_at_1000": C.with_(*_BASE, _REC.format(k=1000)) + "SELECT * FROM rec1000",
    "success_at_5": C.with_(*_BASE, _SUC) + "SELECT * FROM suc",
    "ndcg_at_10": C.with_(*_BASE, _NDCG) + "SELECT * FROM ndcg",
    "evaluate_ranking": C.with_(*_BASE, _MRR, _REC.format(k=50), _REC.format(k=1000), _SUC, _NDCG) + "SELECT run, coalesce(mrr, 0.0) AS mrr_10, coalesce(rec50.recall, 0.0) AS recall_50, coalesce(rec1000.recall, 0.0) AS recall_1000, coalesce(ndcg, 0.0) AS ndcg_10, coalesce(success, 0.0) AS success_5 FROM (SELECT DISTINCT run FROM rn) LEFT JOIN mrr USING (run) LEFT JOIN rec50 USING (run) LEFT JOIN rec1000 USING (run) LEFT JOIN ndcg USING (run) LEFT JOIN suc USING (run)",
    "macro_average": C.with_(*_BASE, _NDCG.replace(", 6)", ", 12)")) + "SELECT regexp_extract(run, '^([^_]+)', 1) AS family, round(avg(ndcg), 6) AS mean_ndcg, count(*) AS n_runs FROM ndcg GROUP BY 1",
    "run_ranking": C.with_(C.RUNS) + "SELECT * FROM rn",
    "trec_lines": C.with_(C.RUNS) + "SELECT concat_ws(chr(9), qid, 'Q0', pid, CAST(rank AS VARCHAR), format('{:.6f}', 1.0::DOUBLE / rank), run) AS line FROM rn",
}
