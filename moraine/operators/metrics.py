"""Retrieval metrics of runs against judgements.

``runs``: run, qid, pid, rank (1-based, unique within run and query).
``qrels``: qid, pid, rel, unique per (qid, pid). Every metric is one row per
run. Sums over the queries of a run are divided by the number of queries that
count, so queries a run does not answer count as 0 without being listed.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def clean_qrels(raw: DataFrame, docid: str = "docid") -> DataFrame:
    """One judgement per (qid, docid): that loaded last, among equals the highest; nulls are dropped."""
    kept = raw.where(F.col("qid").isNotNull() & F.col(docid).isNotNull() & F.col("rel").isNotNull())
    return kept.groupBy("qid", F.col(docid).alias("pid")).agg(F.max(F.struct("loaded_at", "rel"))["rel"].alias("rel"))


def clean_runs(raw: DataFrame) -> DataFrame:
    """Runs without exact repeats, ranked anew from 1 by the rank given, ties by document."""
    once = raw.where(F.col("qid").isNotNull() & F.col("docid").isNotNull()).select("run", "qid", F.col("docid").alias("pid"), F.col("rank").alias("given")).distinct()
    return once.select("run", "qid", "pid", F.row_number().over(Window.partitionBy("run", "qid").orderBy(F.col("given").asc_nulls_last(), "pid")).alias("rank"))


def _n(df: DataFrame):
    """Number of queries, at least one, as a scalar subquery."""
    return df.agg(F.greatest(F.count_distinct("qid"), F.lit(1))).scalar()


def judged(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """The first ``k`` of each ranking with their judgements (null where unjudged)."""
    return runs.where(F.col("rank") <= k).join(qrels.withColumnRenamed("pid", "p"), (runs["qid"] == qrels["qid"]) & (runs["pid"] == F.col("p")), "left").select("run", runs["qid"].alias("qid"), "pid", "rank", "rel")


def mrr_at(runs: DataFrame, qrels: DataFrame, k: int = 10) -> DataFrame:
    """Mean of 1 / rank of the first relevant document within ``k``, over all judged queries."""
    first = judged(runs, qrels, k).groupBy("run", "qid").agg(F.min(F.when(F.col("rel") > 0, F.col("rank"))).alias("r"))
    judged_qids = qrels.select("qid").distinct()
    return first.join(judged_qids, "qid", "left_semi").groupBy("run").agg(F.sum(F.coalesce(1.0 / F.col("r"), F.lit(0.0))).alias("s")).select("run", F.round(F.col("s") / _n(qrels), 6).alias("mrr"))


def _positives(qrels: DataFrame) -> DataFrame:
    return qrels.where(F.col("rel") > 0).groupBy("qid").agg(F.count("*").alias("positives"))


def recall_at(runs: DataFrame, qrels: DataFrame, k: int) -> DataFrame:
    """Mean share of a query's relevant documents within ``k``, over queries that have any."""
    pos = _positives(qrels)
    hits = judged(runs, qrels, k).groupBy("run", "qid").agg(F.count_distinct(F.when(F.col("rel") > 0, F.col("pid"))).alias("hits"))
    return hits.join(pos, "qid").groupBy("run").agg(F.sum(F.col("hits") / F.col("positives")).alias("s")).select("run", F.round(F.col("s") / _n(pos), 6).alias("recall"))


def success_at(runs: DataFrame, qrels: DataFrame, k: int = 5) -> DataFrame:
    """Share of the queries with relevant documents that find one within ``k``."""
    pos = _positives(qrels)
    hit = judged(runs, qrels, k).groupBy("run", "qid").agg(F.max(F.when(F.col("rel") > 0, 1.0).otherwise(0.0)).alias("hit"))
    return hit.join(pos, "qid").groupBy("run").agg(F.sum("hit").alias("s")).select("run", F.round(F.col("s") / _n(pos), 6).alias("success"))


def _gain(rel: str, rank: str):
    return F.when(F.col(rel) > 0, (F.pow(F.lit(2.0), F.col(rel)) - 1) / F.log2(F.col(rank) + 1.0)).otherwise(0.0)


def ndcg_at(runs: DataFrame, qrels: DataFrame, k: int = 10, digits: int = 6) -> DataFrame:
    """Mean of DCG over the ideal DCG, over all judged queries; those without gain count as 0."""
    order = qrels.select("qid", "rel", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("rel"))).alias("ideal_rank")).where(F.col("ideal_rank") <= k)
    ideal = order.groupBy("qid").agg(F.sum(_gain("rel", "ideal_rank")).alias("idcg"))
    dcg = judged(runs, qrels, k).groupBy("run", "qid").agg(F.sum(_gain("rel", "rank")).alias("dcg"))
    return dcg.join(ideal, "qid").groupBy("run").agg(F.sum(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg")).otherwise(0.0)).alias("s")).select("run", F.round(F.col("s") / _n(qrels), digits).alias("ndcg"))


def evaluate(runs: DataFrame, qrels: DataFrame) -> DataFrame:
    """MRR@10, Recall@50, Recall@1000, nDCG@10 and Success@5 of every run.

    Runs meet the judgements once; all metrics are sums over the same rows. The
    ideal gain comes from the counts of each relevance, of which there are few.
    """
    rel, rank = F.col("rel") > 0, F.col("rank")
    per = judged(runs, qrels, 1000).groupBy("run", "qid").agg(
        F.min(F.when(rel & (rank <= 10), rank)).alias("first"),
        F.max(F.when(rel & (rank <= 5), 1.0).otherwise(0.0)).alias("hit"),
        *[F.count_if(rel & (rank <= k)).alias(f"hits_{k}") for k in (50, 1000)],
        F.sum(F.when(rank <= 10, _gain("rel", "rank")).otherwise(0.0)).alias("dcg"),
    )
    levels = qrels.groupBy("qid", "rel").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("qid").orderBy(F.desc("rel"))) - F.col("n")  # a row per relevance
    seats = F.when((before < 10) & rel, F.sequence(before + 1, F.least(before + F.col("n"), F.lit(10)))).otherwise(F.array())
    ideal = F.aggregate(seats, F.lit(0.0), lambda s, r: s + (F.pow(F.lit(2.0), F.col("rel")) - 1) / F.log2(r + 1.0))
    own = levels.select("qid", "rel", "n", ideal.alias("gain")).groupBy("qid").agg(F.sum("gain").alias("idcg"), F.sum(F.when(rel, F.col("n")).otherwise(0)).alias("positives"))
    n_judged, n_positive = (F.greatest(F.count_if(c), F.lit(1)) for c in (F.lit(True), F.col("positives") > 0))
    sizes = own.agg(n_judged.alias("n_judged"), n_positive.alias("n_positive"))
    some = F.col("positives") > 0
    sums = per.join(own, "qid", "left").groupBy("run").agg(
        F.sum(F.when(F.col("positives").isNotNull(), F.coalesce(1.0 / F.col("first"), F.lit(0.0)))).alias("mrr_10"),
        *[F.sum(F.when(some, F.col(f"hits_{k}") / F.col("positives"))).alias(f"recall_{k}") for k in (50, 1000)],
        F.sum(F.when(F.col("idcg") > 0, F.col("dcg") / F.col("idcg"))).alias("ndcg_10"),
        F.sum(F.when(some, F.col("hit"))).alias("success_5"),
    )
    over = {"mrr_10": "n_judged", "recall_50": "n_positive", "recall_1000": "n_positive", "ndcg_10": "n_judged", "success_5": "n_positive"}
    return sums.select("run", *[F.round(F.coalesce(F.col(m) / sizes.select(n).scalar(), F.lit(0.0)), 6).alias(m) for m, n in over.items()])


def macro_average(per_run: DataFrame, group, metric: str) -> DataFrame:
    return per_run.groupBy(group).agg(F.round(F.avg(metric), 6).alias(f"mean_{metric}"), F.count("*").alias("n_runs"))
