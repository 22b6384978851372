"""Late-interaction retrieval: probing, approximate and exact MaxSim, top-k.

The score of a document is, summed over the query's tokens, the largest dot
product with any of the document's tokens. All queries are answered at once.
Two physical forms of the exact round exist: joins and aggregates (for oracle
checks and small candidate sets), and matrix products over Arrow batches of
whole documents, with the query set sent to every task in blocks of bounded
size (for large ones). Scores are rounded to six places before ranking and ties
go to the lower document.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vectors
from ..runtime import materialize
from .index import BUCKETS, decode, ranked_centroids, read_codes


#: Keys that are pushed into a scan as a filter at most.
MOST_PUSHED = 2_000


def top(scored: DataFrame, k: int, by: list[str] | None = None, *order) -> DataFrame:
    """The best ``k`` per query with ``rank``."""
    w = Window.partitionBy(*(by or ["qid"])).orderBy(*(order or (F.desc("score"), F.asc("doc_idx"))))
    return scored.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def maxsim(q: DataFrame, d: DataFrame) -> DataFrame:
    """``(qid, doc_idx, score)`` of the candidate documents of each query.

    ``q``: qid, qpos, qvec; ``d``: qid, doc_idx, pos, vec - a query's candidates.
    Against all documents see :func:`exact_topk`.
    """
    pairs = q.join(d, "qid")
    best = pairs.groupBy("qid", "doc_idx", "qpos").agg(F.max(vectors.dot(F.col("qvec"), F.col("vec"))).alias("m"))
    return best.groupBy("qid", "doc_idx").agg(F.round(F.sum("m"), 6).alias("score"))


def probes(q: DataFrame, centroids: DataFrame, nprobe: int) -> DataFrame:
    """``(qid, qpos, cid, sim, probe)``: the nearest centroids of each query token."""
    return ranked_centroids(q, centroids, nprobe, ["qid", "qpos"], "qvec", with_centroid=False).select("qid", "qpos", "cid", "sim", "probe")


def candidates(probed: DataFrame, codes: DataFrame) -> DataFrame:
    """Code rows of the probed centroids, once per query: each code has one centroid, so distinct (qid, cid) suffices."""
    return probed.select("qid", "cid").distinct().join(codes, "cid")


def retrieve(q: DataFrame, centroids: DataFrame, codes: DataFrame, nprobe: int = 2, n_candidates: int = 20, k: int = 10) -> DataFrame:
    """Two rounds: documents ranked by their probed tokens, the best of them by all their tokens. ``codes``: doc_idx, pos, cid, vec."""
    near = top(maxsim(q, candidates(probes(q, centroids, nprobe), codes).select("qid", "doc_idx", "pos", "vec")), n_candidates)
    chosen = near.select("qid", "doc_idx", F.col("score").alias("approx"))
    exact = maxsim(q, codes.select("doc_idx", "pos", "vec").join(chosen.select("qid", "doc_idx"), "doc_idx"))
    both = exact.join(chosen, ["qid", "doc_idx"])
    return top(both, k, ["qid"], F.desc("score"), F.desc("approx"), F.asc("doc_idx"))


def _few(keys: DataFrame, name: str) -> list | None:
    """Distinct keys where they are few enough to be pushed into a scan, else none."""
    got = [r[0] for r in keys.select(name).distinct().limit(MOST_PUSHED + 1).collect()]
    return got if len(got) <= MOST_PUSHED else None


def search_index(q: DataFrame, path: str, nbits: int, nprobe: int = 2, n_candidates: int = 8192, k: int = 1000) -> DataFrame:
    """``(qid, doc_idx, score, approx, rank)`` from the compressed index at ``path``.

    Both rounds score what the codes give back. The first reads the folders of
    the probed centroids only, the second the codes of the documents it chose;
    packed codes are joined, and decoded only where they are wanted, once.
    Centroids and documents that are few go into the scans as filters.
    """
    spark = q.sparkSession
    cen, par = spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/parameters")
    probed = materialize(probes(q, cen, nprobe).select("qid", "cid").distinct(), "probed")
    buckets = [r[0] for r in probed.select(F.pmod("cid", F.lit(BUCKETS))).distinct().collect()]  # BUCKETS rows at most
    codes = read_codes(spark, path).where(F.col("bucket").isin(buckets))
    cids = _few(probed, "cid")
    codes = codes.where(F.col("cid").isin(cids)) if cids is not None else codes.join(probed.select("cid").distinct(), "cid", "left_semi")
    seen = decode(codes.select(F.col("ordinal").alias("doc_idx"), "pos", "cid", "packed"), cen, par, nbits)
    near = top(maxsim(q, candidates(probed, seen).select("qid", "doc_idx", "pos", "vec")), n_candidates)
    chosen = materialize(near.select("qid", "doc_idx", F.col("score").alias("approx")), "chosen")
    whole = spark.read.parquet(f"{path}/by_doc").select(F.col("ordinal").alias("doc_idx"), "pos", "cid", "packed")
    docs = _few(chosen, "doc_idx")
    whole = whole.where(F.col("doc_idx").isin(docs)) if docs is not None else whole.join(chosen.select("doc_idx").distinct(), "doc_idx", "left_semi")
    vecs = decode(whole, cen, par, nbits).select("doc_idx", "pos", "vec")
    exact = maxsim(q, vecs.join(chosen.select("qid", "doc_idx"), "doc_idx"))
    return top(exact.join(chosen, ["qid", "doc_idx"]), k, ["qid"], F.desc("score"), F.desc("approx"), F.asc("doc_idx"))


def exact_topk(q: DataFrame, d: DataFrame, k: int, block: int = 4096) -> DataFrame:
    """``(qid, doc_idx, score, rank)`` of every query against all documents, by matrix products.

    Documents are brought together by one shuffle on ``doc_idx``; each task
    keeps its best ``k`` per query, so what is merged is tasks x queries x k.
    ``q`` is the stated query set; its tokens are sent in blocks of ``block``.
    """
    spark = q.sparkSession
    rows = q.select("qid", "qpos", "qvec").orderBy("qid", "qpos").toLocalIterator()
    docs = d.select("doc_idx", "pos", "vec").repartition("doc_idx").sortWithinPartitions("doc_idx")
    kind = q.schema["qid"].dataType.simpleString()
    out, ids, vecs = None, [], []

    def scored() -> DataFrame:
        held = spark.sparkContext.broadcast((np.array(ids), np.array(vecs, np.float64)))  # at most one block of tokens and the rest of a query

        def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, mat = held.value
            start = np.flatnonzero(np.r_[True, qid[1:] != qid[:-1]])
            best_s = np.full((len(start), 0), -np.inf)
            best_d = np.zeros((len(start), 0), np.int64)
            rest: pd.DataFrame | None = None

            def fold(part: pd.DataFrame) -> None:
                nonlocal best_s, best_d
                doc = part["doc_idx"].to_numpy()
                edge = np.flatnonzero(np.r_[True, doc[1:] != doc[:-1]])
                sims = mat @ np.array(part["vec"].tolist(), np.float64).T
                s = np.round(np.add.reduceat(np.maximum.reduceat(sims, edge, axis=1), start, axis=0), 6)
                best_s, best_d = np.hstack([best_s, s]), np.hstack([best_d, np.tile(doc[edge], (len(start), 1))])
                if best_s.shape[1] > 4 * k:
                    keep = np.lexsort((best_d, -best_s), axis=1)[:, :k]
                    best_s, best_d = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_d, keep, 1)

            for pdf in batches:
                pdf = pdf if rest is None else pd.concat([rest, pdf], ignore_index=True)
                last = pdf["doc_idx"].to_numpy() == pdf["doc_idx"].iloc[-1]
                rest = pdf[last]
                if not last.all():
                    fold(pdf[~last])
            if rest is not None and len(rest):
                fold(rest)
            keep = np.lexsort((best_d, -best_s), axis=1)[:, :k]
            best_s, best_d = np.take_along_axis(best_s, keep, 1), np.take_along_axis(best_d, keep, 1)
            yield pd.DataFrame({"qid": np.repeat(qid[start], best_s.shape[1]), "doc_idx": best_d.ravel(), "score": best_s.ravel()})

        return docs.mapInPandas(run, f"qid {kind}, doc_idx long, score double")

    for r in rows:
        if len(ids) >= block and r["qid"] != ids[-1]:
            out = scored() if out is None else out.unionByName(scored())
            ids, vecs = [], []
        ids.append(r["qid"])
        vecs.append(r["qvec"])
    if ids:
        out = scored() if out is None else out.unionByName(scored())
    if out is None:
        return spark.createDataFrame([], f"qid {kind}, doc_idx long, score double, rank int")
    return top(out, k)


def max_passage(ranking: DataFrame, mapping: DataFrame, k: int) -> DataFrame:
    """Documents by their best passage: ``(qid, docid, score, rank)``; unknown passages are skipped, ties go to the passage ranked first.

    ``ranking``: qid, pid, score, rank; ``mapping``: pid, docid.
    """
    best = ranking.join(mapping, "pid").groupBy("qid", "docid").agg(F.max("score").alias("score"), F.min("rank").alias("first"))
    return top(best, k, ["qid"], F.desc("score"), F.asc("first"), F.asc("docid")).drop("first")
