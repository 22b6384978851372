"""Closed forms of the training losses, for offline evaluation of scores."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def pairwise_ce(pairs: DataFrame, pos: str = "pos_score", neg: str = "neg_score") -> DataFrame:
    """Mean of ln(1 + exp(neg - pos)), computed without overflow."""
    d = F.col(neg) - F.col(pos)
    return pairs.where(F.col(pos).isNotNull() & F.col(neg).isNotNull()).agg(F.avg(F.greatest(d, F.lit(0.0)) + F.log1p(F.exp(-F.abs(d)))).alias("loss"), F.count("*").alias("n"))


def log_softmax(df: DataFrame, group: list[str], score: str, out: str) -> DataFrame:
    """``df`` with the log of the softmax of ``score`` within each group."""
    top = df.groupBy(*group).agg(F.max(score).alias("_top"))
    den = df.join(top, group).groupBy(*group).agg(F.first("_top").alias("_t"), F.log(F.sum(F.exp(F.col(score) - F.col("_top")))).alias("_ln"))
    return df.join(den, group).withColumn(out, F.col(score) - F.col("_t") - F.col("_ln")).drop("_t", "_ln")


def kl_distillation(rows: DataFrame, group: list[str], teacher: str, student: str) -> DataFrame:
    """Kullback-Leibler divergence of the student's softmax from the teacher's, summed within and averaged over groups."""
    both = log_softmax(log_softmax(rows, group, teacher, "_lt"), group, student, "_ls")
    return both.groupBy(*group).agg(F.sum(F.exp("_lt") * (F.col("_lt") - F.col("_ls"))).alias("kl")).agg(F.avg("kl").alias("loss"), F.count("*").alias("n"))


def in_batch_ce(scores: DataFrame) -> DataFrame:
    """Mean cross-entropy of each query's own document among all documents of the batch. ``scores``: batch, q, d, score."""
    return log_softmax(scores, ["batch", "q"], "score", "_l").where(F.col("q") == F.col("d")).agg(F.avg(-F.col("_l")).alias("loss"), F.count("*").alias("n"))


def rate_share(step: Column, warmup: int, total: Column) -> Column:
    """Share of the peak learning rate at a step: rising to it over the warm-up, then falling to nothing at the last step."""
    rising = step / F.lit(float(max(1, warmup)))
    falling = (total - step) / F.greatest(F.lit(1), total - warmup)
    return F.when(step < warmup, rising).otherwise(F.greatest(F.lit(0.0), falling))
