"""Retrieval over all token vectors, with its SQL.

The stated query set is every document whose number is divisible by 50,
against all documents. Queries of two rounds stand twice: with the 20 candidates
that their SQL fixes, which loses documents, and as ``*_full`` with the
candidates of production. ``retrieve_recall`` measures both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..config import Config
from ..functions import codec
from ..operators import index as I
from ..operators import retrieval as R
from ..runtime import materialize, shared_dir
from ..sources.sinks import trec_line
from . import common as C

NPROBE, NCAND, K = 2, 20, 10
#: Documents a query keeps for the exact round in production.
FULL = Config().n_candidates


def _parts(spark, d):
    e = C.token_vectors(spark, d)
    cen = materialize(I.mean_centroids(e), "centroids")
    codes = I.ranked_centroids(e, cen, 1, ["vec_id"], with_centroid=False).select("doc_idx", "pos", "cid", "vec")
    return C.query_vectors(e), cen, materialize(codes, "codes")


def maxsim_exact_topk(spark, d):
    e = C.token_vectors(spark, d)
    return R.exact_topk(C.query_vectors(e), e, K).select("qid", "doc_idx", "score", "rank")


def maxsim_candidates(spark, d):
    """Exact scores of each query's candidates by joins: all documents of a probed centroid."""
    q, cen, codes = _parts(spark, d)
    chosen = R.candidates(R.probes(q, cen, 1), codes).select("qid", "doc_idx").distinct()
    return R.maxsim(q, codes.join(chosen, "doc_idx").select("qid", "doc_idx", "pos", "vec"))


def probe_centroids(spark, d):
    q, cen, _ = _parts(spark, d)
    return R.probes(q, cen, NPROBE)


def candidate_generation(spark, d):
    q, cen, codes = _parts(spark, d)
    return R.candidates(R.probes(q, cen, NPROBE), codes).groupBy("qid", "doc_idx").agg(F.count("*").alias("n_tokens"))


def approx_maxsim(spark, d):
    q, cen, codes = _parts(spark, d)
    return R.maxsim(q, R.candidates(R.probes(q, cen, NPROBE), codes).select("qid", "doc_idx", "pos", "vec"))


def _retrieved(spark, d, n=NCAND):
    return R.retrieve(*_parts(spark, d), NPROBE, n, K)


def rerank_exact(spark, d, n=NCAND):
    return _retrieved(spark, d, n).select("qid", "doc_idx", "score", "approx")


def rerank_full(spark, d):
    return rerank_exact(spark, d, FULL)


def retrieve_topk(spark, d, n=NCAND):
    return _retrieved(spark, d, n).select("qid", "doc_idx", "score", "rank")


def retrieve_full(spark, d):
    return retrieve_topk(spark, d, FULL)


def search_topk(spark, d):
    """The two rounds over an index of codes written from all embeddings: what the codes give back is scored."""
    from .index_queries import _parameters

    path = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}"
    e = C.token_vectors(spark, d)
    I.mean_centroids(e).write.parquet(f"{path}/centroids")
    codec.as_arrays(_parameters(spark, d)).write.parquet(f"{path}/parameters")
    vecs = e.select(F.col("doc_idx").alias("ordinal"), F.col("doc_idx").cast("string").alias("pid"), "pos", "vec")
    I.write_codes(vecs, path, 2)
    I.write_lists(vecs.select("ordinal", "pid").distinct(), path)
    return R.search_index(C.query_vectors(e), path, 2, NPROBE, FULL, K).select("qid", "doc_idx", "score", "approx", "rank")


def retrieve_recall(spark, d):
    """Share of each query's exact best that two rounds find, by number of candidates."""
    exact = maxsim_exact_topk(spark, d).select("qid", "doc_idx")
    found = [retrieve_topk(spark, d, n).select(F.lit(n).alias("n_candidates"), "qid", "doc_idx", F.lit(1).alias("found")) for n in (NCAND, FULL)]
    wanted = exact.withColumn("n_candidates", F.explode(F.array(F.lit(NCAND), F.lit(FULL))))
    return wanted.join(found[0].unionByName(found[1]), ["n_candidates", "qid", "doc_idx"], "left").groupBy("n_candidates", "qid").agg(F.round(F.count("found") / F.count("*"), 6).alias("recall"))


def retrieve_maxp(spark, d, n=NCAND):
    """Four of the retrieved units make a document."""
    r = _retrieved(spark, d, n).select("qid", F.col("doc_idx").alias("pid"), "score", "rank")
    m = C.token_vectors(spark, d).select(F.col("doc_idx").alias("pid"), F.floor(F.col("doc_idx") / 4).cast("long").alias("docid")).distinct()
    return R.max_passage(r, m, 5)


def retrieve_maxp_full(spark, d):
    return retrieve_maxp(spark, d, FULL)


def run_maxp(spark, d):
    """Documents of the stored tuples' passages by their best score."""
    from ..plans.text_queries import passage_map
    from ..runtime import table

    t = table(spark, d, "tuples").where(F.col("qid").isNotNull()).select("qid", F.explode(F.arrays_zip("pids", "scores")).alias("z")).select("qid", F.col("z.pids").alias("pid"), F.col("z.scores").alias("score")).where(F.col("pid").isNotNull() & F.col("score").isNotNull())
    t = t.groupBy("qid", "pid").agg(F.max("score").alias("score"))
    ranked = R.top(t, 1 << 30, ["qid"], F.desc("score"), F.asc("pid"))
    return R.max_passage(ranked, passage_map(spark, d), 5)


def trec_run(spark, d, n=NCAND):
    r = _retrieved(spark, d, n)
    return r.select(F.col("qid").cast("string").alias("qid"), F.col("doc_idx").cast("string").alias("pid"), "rank", "score").select(trec_line(F.lit("two_round")).alias("line"))


def trec_run_full(spark, d):
    return trec_run(spark, d, FULL)


QUERIES = {f.__name__: f for f in (maxsim_exact_topk, maxsim_candidates, probe_centroids, candidate_generation, approx_maxsim, rerank_exact, rerank_full, retrieve_topk, retrieve_full, search_topk, retrieve_recall, retrieve_maxp, retrieve_maxp_full, run_maxp, trec_run, trec_run_full)}

_EXACT = "mx AS (SELECT qid, doc_idx, round(sum(m), 6) AS score FROM (SELECT qid, qpos, doc_idx, max(list_dot_product(qv, v)) AS m FROM q, e GROUP BY ALL) GROUP BY qid, doc_idx), tk AS (SELECT qid, doc_idx, score, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, doc_idx) AS INTEGER) AS rank FROM mx)"
_PROBE = f"pr AS (SELECT qid, qpos, cid, sim, CAST(r AS INTEGER) AS probe FROM (SELECT *, row_number() OVER (PARTITION BY qid, qpos ORDER BY sim DESC, cid) AS r FROM (SELECT qid, qpos, cid, round(list_dot_product(qv, c), 6) AS sim FROM q, cen)) WHERE r <= {NPROBE})"
_CAND = "ca AS (SELECT qid, doc_idx, pos, v FROM (SELECT DISTINCT qid, cid FROM pr) JOIN near USING (cid))"
_APP = "ap AS (SELECT qid, doc_idx, round(sum(m), 6) AS approx FROM (SELECT q.qid, q.qpos, doc_idx, max(list_dot_product(qv, v)) AS m FROM ca JOIN q ON q.qid = ca.qid GROUP BY ALL) GROUP BY qid, doc_idx)"
_TWO = f"ch AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY approx DESC, doc_idx) AS r FROM ap) WHERE r <= {NCAND}), ex AS (SELECT qid, doc_idx, round(sum(m), 6) AS score FROM (SELECT q.qid, q.qpos, e.doc_idx, max(list_dot_product(qv, v)) AS m FROM ch JOIN e ON e.doc_idx = ch.doc_idx JOIN q ON q.qid = ch.qid GROUP BY ALL) GROUP BY qid, doc_idx), rk AS (SELECT * FROM (SELECT qid, doc_idx, score, approx, CAST(row_number() OVER (PARTITION BY qid ORDER BY score DESC, approx DESC, doc_idx) AS INTEGER) AS rank FROM ex JOIN ch USING (qid, doc_idx)) WHERE rank <= {K})"
_ALL = (C.E, C.CEN, C.NEAR, C.Q, _PROBE, _CAND, _APP, _TWO)
_MAXP = "SELECT qid, docid, score, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, f, docid) AS rank FROM (SELECT qid, docid, max(score) AS score, min(rank) AS f FROM {} GROUP BY 1, 2)) WHERE rank <= 5"
SQL = {
    "maxsim_exact_topk": C.with_(C.E, C.Q, _EXACT) + f"SELECT * FROM tk WHERE rank <= {K}",
    "maxsim_candidates": C.with_(C.E, C.CEN, C.NEAR, C.Q, _PROBE, "cd AS (SELECT DISTINCT qid, doc_idx FROM (SELECT DISTINCT qid, cid FROM pr WHERE probe = 1) JOIN near USING (cid))") + "SELECT qid, doc_idx, round(sum(m), 6) AS score FROM (SELECT cd.qid, q.qpos, cd.doc_idx, max(list_dot_product(qv, v)) AS m FROM cd JOIN e USING (doc_idx) JOIN q ON q.qid = cd.qid GROUP BY ALL) GROUP BY qid, doc_idx",
    "probe_centroids": C.with_(C.E, C.CEN, C.Q, _PROBE) + "SELECT * FROM pr",
    "candidate_generation": C.with_(*_ALL[:6]) + "SELECT qid, doc_idx, count(*) AS n_tokens FROM ca GROUP BY ALL",
    "approx_maxsim": C.with_(*_ALL[:7]) + "SELECT qid, doc_idx, approx AS score FROM ap",
    "rerank_exact": C.with_(*_ALL) + "SELECT qid, doc_idx, score, approx FROM rk",
    "retrieve_topk": C.with_(*_ALL) + "SELECT qid, doc_idx, score, rank FROM rk",
    "retrieve_maxp": C.with_(*_ALL) + _MAXP.format("(SELECT qid, CAST(floor(doc_idx / 4) AS BIGINT) AS docid, score, rank FROM rk)"),
    "run_maxp": C.with_(
        "tp AS (SELECT qid, pid, max(score) AS score FROM (SELECT qid, unnest(pids) AS pid, unnest(scores) AS score FROM tuples WHERE qid IS NOT NULL) WHERE pid IS NOT NULL AND score IS NOT NULL GROUP BY ALL)",
        "tr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM tp)",
        "pm AS (SELECT pid, max(docid) AS docid FROM passage_to_doc WHERE pid IS NOT NULL GROUP BY pid)",
    )
    + _MAXP.format("(SELECT qid, docid, score, rank FROM tr JOIN pm USING (pid))"),
    "trec_run": C.with_(*_ALL) + "SELECT concat_ws(chr(9), CAST(qid AS VARCHAR), 'Q0', CAST(doc_idx AS VARCHAR), CAST(rank AS VARCHAR), format('{:.6f}', score), 'two_round') AS line FROM rk",
}
# The same with the candidates of production.
_FULL = (*_ALL[:7], _TWO.replace(f"r <= {NCAND})", f"r <= {FULL})"))
SQL |= {full: SQL[name].replace(C.with_(*_ALL), C.with_(*_FULL)) for full, name in (("rerank_full", "rerank_exact"), ("retrieve_full", "retrieve_topk"), ("retrieve_maxp_full", "retrieve_maxp"), ("trec_run_full", "trec_run"))}
_TOP = "(SELECT qid, doc_idx FROM {} WHERE rank <= " + f"{K})"
SQL["retrieve_recall"] = " UNION ALL ".join(f"SELECT * FROM ({C.with_(*parts, _EXACT)} SELECT CAST({n} AS INTEGER) AS n_candidates, t.qid, round(count(r.doc_idx) / count(*), 6) AS recall FROM {_TOP.format('tk')} t LEFT JOIN {_TOP.format('rk')} r USING (qid, doc_idx) GROUP BY t.qid)" for n, parts in ((NCAND, _ALL), (FULL, _FULL)))
# Over codes: both rounds score the vectors that they give back.
_DV = "dv AS (SELECT vec_id, any_value(near.doc_idx) AS doc_idx, any_value(pos) AS pos, any_value(cid) AS cid, list(c[codes.d + 1] + val ORDER BY codes.d) AS v FROM codes JOIN near USING (vec_id) JOIN par ON par.d = codes.d AND par.b = codes.code GROUP BY vec_id)"
SQL["search_topk"] = C.with_(C.E, C.CEN, C.NEAR, C.RES, C.PAR, C.CODES, C.Q, _DV, _PROBE, _CAND.replace("JOIN near", "JOIN dv"), _APP, _TWO.replace(f"r <= {NCAND})", f"r <= {FULL})").replace("JOIN e ON e.doc_idx", "JOIN dv e ON e.doc_idx")) + "SELECT qid, doc_idx, score, approx, rank FROM rk"
