"""Training data from judgements and runs: triples and n-way tuples."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.text import filled
from ..runtime import materialize


def negative_pool(run: DataFrame, positives: DataFrame) -> DataFrame:
    """Candidates of a run without the positives, in their order. ``run``: qid, docid, ord."""
    return run.join(positives, ["qid", "docid"], "left_anti")


def _placed(pool: DataFrame, seed: int, spread: int = 256) -> DataFrame:
    """``(qid, neg, place, n)``: each query's pool in the order of a hash, with its size.

    Pools are numbered in ranges of the hash, so a query with a large pool is
    the work of ``spread`` tasks.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", "neg"))
    p = pool.select("qid", F.col("docid").alias("neg")).distinct().withColumn("h", h).withColumn("part", (F.conv(F.substring("h", 1, 4), 16, 10).cast("long") * spread / 65536).cast("int"))
    parts = p.groupBy("qid", "part").agg(F.count("*").alias("c"))
    whole = Window.partitionBy("qid")
    parts = parts.select("qid", "part", (F.sum("c").over(whole.orderBy("part")) - F.col("c")).alias("before"), F.sum("c").over(whole).alias("n"))  # at most `spread` rows a query
    inside = F.row_number().over(Window.partitionBy("qid", "part").orderBy("h", "neg")) - 1
    return p.withColumn("inside", inside).join(parts, ["qid", "part"]).select("qid", "neg", (F.col("before") + F.col("inside")).alias("place"), "n")


def triples(positives: DataFrame, pool: DataFrame, per_positive: int = 1, strategy: str = "random", seed: int = 12345) -> DataFrame:
    """``(qid, pos, neg, k)``: each positive with ``per_positive`` negatives of its query, all different, or all there are.

    ``top`` takes the first of the pool, the same for every positive of a query;
    ``random`` draws: the pool stands in the order of a hash, and a positive
    takes the ones from a place that its own hash gives, round the end. Only
    the drawn places are joined, never a query's positives with its whole pool.
    """
    if strategy == "top":
        near = pool.withColumn("k", F.row_number().over(Window.partitionBy("qid").orderBy("ord", "docid"))).where(F.col("k") <= per_positive)
        return positives.select("qid", F.col("docid").alias("pos")).join(near.select("qid", F.col("docid").alias("neg"), "k"), "qid")
    if strategy != "random":
        raise ValueError("top or random")
    placed = materialize(_placed(pool, seed), "pool")
    sizes = placed.groupBy("qid").agg(F.max("n").alias("n"))
    start = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), "qid", "pos")), 1, 12), 16, 10).cast("long")
    drawn = positives.select("qid", F.col("docid").alias("pos")).join(sizes, "qid")
    drawn = drawn.select("qid", "pos", "n", start.alias("start"), F.explode(F.sequence(F.lit(1), F.least(F.lit(per_positive), F.col("n").cast("int")))).alias("k"))
    drawn = drawn.select("qid", "pos", "k", F.pmod(F.col("start") + F.col("k") - 1, F.col("n")).alias("place"))
    return drawn.join(placed.select("qid", "place", "neg"), ["qid", "place"]).select("qid", "pos", "neg", "k")


def to_passages(t: DataFrame, first: DataFrame) -> DataFrame:
    """Triples of first passages instead of documents; rows without one are dropped. ``first``: docid, pid."""
    p, n = first.select(F.col("docid").alias("pos"), F.col("pid").alias("pos_pid")), first.select(F.col("docid").alias("neg"), F.col("pid").alias("neg_pid"))
    return t.join(p, "pos").join(n, "neg").select("qid", "k", F.col("pos_pid").alias("pos"), F.col("neg_pid").alias("neg"))


def resolve_texts(t: DataFrame, queries: DataFrame, collection: DataFrame) -> DataFrame:
    """``(query, pos_text, neg_text)`` with ids; rows with an unknown id are dropped."""
    p, n = collection.select(F.col("pid").alias("pos"), F.col("text").alias("pos_text")), collection.select(F.col("pid").alias("neg"), F.col("text").alias("neg_text"))
    return t.join(queries.select("qid", F.col("text").alias("query")), "qid").join(p, "pos").join(n, "neg").select("qid", "pos", "neg", "query", "pos_text", "neg_text")


def pairs_to_score(run: DataFrame, queries: DataFrame, collection: DataFrame, top_k: int) -> DataFrame:
    """``(qid, pid, rank, query, text)`` of the first ``top_k`` of each ranking, for a cross-encoder."""
    top = run.where(F.col("rank") <= top_k)
    return top.join(queries.select("qid", F.col("text").alias("query")), "qid").join(collection.select("pid", "text"), "pid")


def score_pairs(pairs: DataFrame, predict, batch: int = 128) -> DataFrame:
    """Pairs with the ``score`` an injected ``predict(list of (query, text)) -> floats`` gives, batch by batch."""

    @F.pandas_udf("double")
    def score(q: pd.Series, t: pd.Series) -> pd.Series:
        both = list(zip(q, t))
        out: list[float] = []
        for lo in range(0, len(both), batch):
            out += [float(x) for x in predict(both[lo : lo + batch])]
        return pd.Series(out, dtype=float)

    return pairs.withColumn("score", score("query", "text"))


def nway_tuples(scored: DataFrame, positives: DataFrame, nway: int) -> DataFrame:
    """``(qid, pids, scores, positive_idx)``: the best labelled positive (else the best of all) and the next ``nway - 1``.

    ``scored``: qid, pid, score, rank; ``positives``: qid, pid. Other labelled
    positives may stand among the rest; queries that cannot fill the tuple are
    dropped; the positive always comes first.
    """
    s = scored.join(positives.select("qid", "pid", F.lit(True).alias("is_pos")).distinct(), ["qid", "pid"], "left").withColumn("is_pos", F.coalesce("is_pos", F.lit(False)))
    by = Window.partitionBy("qid").orderBy(F.desc("is_pos"), F.desc("score"), "rank", "pid")
    best = s.withColumn("n", F.row_number().over(by)).where("n = 1").select("qid", F.col("pid").alias("pos"), F.col("score").alias("pos_score"))
    rest = s.join(best, "qid").where(F.col("pid") != F.col("pos"))
    rest = rest.withColumn("n", F.row_number().over(Window.partitionBy("qid").orderBy(F.desc("score"), "rank", "pid"))).where(F.col("n") <= nway - 1)
    got = rest.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("n", "pid", "score"))).alias("r")).where(F.size("r") == nway - 1)  # nway rows a query
    return got.join(best, "qid").select("qid", F.concat(F.array("pos"), F.col("r.pid")).alias("pids"), F.concat(F.array("pos_score"), F.col("r.score")).alias("scores"), F.lit(0).alias("positive_idx"))


def tuple_texts(tuples: DataFrame, collection: DataFrame, strict: bool = True) -> DataFrame:
    """``(qid, n, pid, text)`` of the tuples' passages in order; with ``strict`` an unknown passage is an error."""
    t = tuples.select("qid", F.posexplode("pids").alias("n", "pid"))
    out = t.join(collection.select("pid", "text"), "pid", "left")
    if strict:
        out = out.where(F.assert_true(F.col("text").isNotNull(), F.concat(F.lit("unknown passage "), filled(F.col("pid")))).isNull())
    return out.select("qid", "n", "pid", "text")
