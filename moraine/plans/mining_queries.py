"""Training-data mining over judgements, runs and stored tuples, with its SQL."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.text import format_document
from ..operators import losses as L
from ..operators import mining as M
from ..operators import retrieval as R
from ..runtime import table
from . import common as C
from ..operators.ordinals import shuffled
from .text_queries import SEG, passage_map, segment_passages


def _positives(spark: SparkSession, d: str) -> DataFrame:
    return C.qrels(spark, d).where(F.col("rel") > 0).select("qid", F.col("pid").alias("docid"))


def _candidates(spark, d):
    """The best rank of each document over all runs of its query."""
    return C.runs(spark, d).groupBy("qid", F.col("pid").alias("docid")).agg(F.min("rank").alias("ord"))


def _pool(spark, d):
    return M.negative_pool(_candidates(spark, d), _positives(spark, d))


def negative_pool_anti(spark, d):
    return _pool(spark, d)


def triples_top_negatives(spark, d):
    return M.triples(_positives(spark, d), _pool(spark, d), 2, "top").select("qid", "pos", "neg", "k")


def triples_hash_sampled(spark, d):
    return M.triples(_positives(spark, d), _pool(spark, d), 2, "random").select("qid", "pos", "neg", "k")


def _first(spark, d):
    return passage_map(spark, d).where(F.col("pid") == F.concat("docid", F.lit("_p0"))).select("docid", "pid")


def triples_first_passage(spark, d):
    return M.to_passages(triples_hash_sampled(spark, d), _first(spark, d)).select("qid", "k", "pos", "neg")


def triples_resolve_text(spark, d):
    docs = C.documents_once(spark, d).select(F.col("docid").alias("pid"), format_document("title_body").alias("text"))
    t = M.resolve_texts(triples_hash_sampled(spark, d), C.queries_once(spark, d), docs)
    return t.select("qid", "pos", "neg", "query", F.md5("pos_text").alias("pos_md5"), F.md5("neg_text").alias("neg_md5"))


def distill_pairs(spark, d):
    docs = C.documents_once(spark, d).select(F.col("docid").alias("pid"), format_document("title_body").alias("text"))
    run = _candidates(spark, d).select("qid", F.col("docid").alias("pid"), F.row_number().over(Window.partitionBy("qid").orderBy("ord", "docid")).alias("rank"))
    return M.pairs_to_score(run, C.queries_once(spark, d), docs, 10).select("qid", "pid", "rank", "query", "text")


def _scored(spark, d):
    """A stand-in for a cross-encoder: a score from the hash of the pair."""
    c = _candidates(spark, d).select("qid", F.col("docid").alias("pid"), F.col("ord").alias("rank"))
    return c.withColumn("score", F.conv(F.substring(F.md5(F.concat_ws("|", "qid", "pid")), 1, 6), 16, 10).cast("double") / 1e6)


def distill_tuples(spark, d):
    t = M.nway_tuples(_scored(spark, d), _positives(spark, d).withColumnRenamed("docid", "pid"), 8)
    return t.select("qid", F.array_join("pids", ",").alias("pids"), F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",").alias("scores"), "positive_idx")


def distill_tuples_maxp(spark, d):
    """The same over passages: a passage is positive if its document is judged relevant."""
    t = table(spark, d, "tuples").where(F.col("qid").isNotNull()).select("qid", F.explode(F.arrays_zip("pids", "scores")).alias("z")).select("qid", F.col("z.pids").alias("pid"), F.col("z.scores").alias("score")).where(F.col("pid").isNotNull() & F.col("score").isNotNull()).groupBy("qid", "pid").agg(F.max("score").alias("score"))
    s = R.top(t, 1 << 30, ["qid"], F.desc("score"), F.asc("pid"))
    pos = s.join(passage_map(spark, d), "pid").join(_positives(spark, d), ["qid", "docid"], "left_semi").select("qid", "pid")
    n = M.nway_tuples(s, pos, 4)
    return n.select("qid", F.array_join("pids", ",").alias("pids"), "positive_idx")


def tuple_passages(spark, d):
    """Texts of the passages of stored tuples, in order; of the tuples all of whose passages exist, so that the strict check holds."""
    p = segment_passages(spark, d).select("pid", F.col("passage").alias("text"))
    t = table(spark, d, "tuples").where(F.col("qid").isNotNull() & (F.size("pids") > 0)).select("qid", "built_at", "pids").distinct()
    t = t.withColumn("tuple", F.md5(F.concat_ws("|", "qid", F.array_join("pids", ",", "-"), F.date_format("built_at", "yyyyMMddHHmmss"))))
    lost = t.select("tuple", F.explode("pids").alias("pid")).join(p.select("pid"), "pid", "left_anti").select("tuple").distinct()
    whole = t.join(lost, "tuple", "left_anti").select(F.col("tuple").alias("qid"), "pids")
    return M.tuple_texts(whole, p).select(F.col("qid").alias("tuple"), "n", "pid", "text").distinct()


def distill_scored(spark, d):
    """Tuples from the pairs as a cross-encoder scores them: a stand-in is injected, batch by batch."""

    def predict(pairs):
        return [int(hashlib.md5(f"{q}|{t}".encode()).hexdigest()[:6], 16) / 1e6 for q, t in pairs]

    pairs = distill_pairs(spark, d).withColumn("query", F.coalesce("query", F.lit("")))
    n = M.nway_tuples(M.score_pairs(pairs, predict), _positives(spark, d).withColumnRenamed("docid", "pid"), 4)
    return n.select("qid", F.array_join("pids", ",").alias("pids"), F.array_join(F.transform("scores", lambda s: F.format_string("%.6f", s)), ",").alias("scores"), "positive_idx")


def triples_shuffled(spark, d):
    """Triples in the order of a seeded shuffle, with their place in it."""
    t = triples_hash_sampled(spark, d).select(F.concat_ws("|", "qid", "pos", "neg").alias("key"))
    return shuffled(t, "key", 42, 3)


def _tuple_scores(spark, d):
    t = table(spark, d, "tuples").where(F.col("qid").isNotNull() & F.col("pids").isNotNull()).select("qid", "pids", "scores", "positive_idx", "built_at").distinct()
    t = t.withColumn("tuple", F.md5(F.concat_ws("|", "qid", F.array_join("pids", ",", "-"), F.date_format("built_at", "yyyyMMddHHmmss"))))
    return t.select("tuple", "positive_idx", F.posexplode("scores").alias("n", "score")).where(F.col("score").isNotNull()).groupBy("tuple", "n").agg(F.max("score").alias("score"), F.max("positive_idx").alias("positive_idx"))


def pairwise_ce(spark, d):
    s = _tuple_scores(spark, d)
    pos = s.where(F.col("n") == F.col("positive_idx")).select("tuple", F.col("score").alias("pos_score"))
    neg = s.where(F.col("n") != F.col("positive_idx")).select("tuple", F.col("score").alias("neg_score"))
    return L.pairwise_ce(neg.join(pos, "tuple")).select(F.round("loss", 6).alias("loss"), "n")


def kl_distillation(spark, d):
    """The stored scores as teacher, the order in the tuple as student."""
    s = _tuple_scores(spark, d).withColumn("student", -F.col("n").cast("double"))
    return L.kl_distillation(s, ["tuple"], "score", "student").select(F.round("loss", 6).alias("loss"), "n")


def learning_rates(spark, d):
    """The schedule over as many steps as there are triples, and some beyond."""
    n = triples_hash_sampled(spark, d).agg(F.count("*")).scalar()
    steps = spark.range(1).select(n.alias("total")).select("total", F.explode(F.sequence(F.lit(0), F.col("total") + 10)).alias("step"))
    return steps.select("step", F.round(L.rate_share(F.col("step"), 100, F.col("total")), 9).alias("share"))


def in_batch_ce(spark, d):
    """Batches of eight documents; each document's even tokens are the query of its odd ones."""
    e = C.token_vectors(spark, d).withColumn("batch", F.floor(F.col("doc_idx") / 8).cast("long"))
    q = e.where("pos % 2 = 0").select("batch", F.col("doc_idx").alias("q"), F.col("pos").alias("qpos"), F.col("vec").alias("qvec"))
    k = e.where("pos % 2 = 1").select("batch", F.col("doc_idx").alias("d"), "vec")
    from ..functions.vectors import dot

    m = q.join(k, "batch").groupBy("batch", "q", "d", "qpos").agg(F.max(dot(F.col("qvec"), F.col("vec"))).alias("m")).groupBy("batch", "q", "d").agg(F.sum("m").alias("score"))
    return L.in_batch_ce(m).select(F.round("loss", 6).alias("loss"), "n")


QUERIES = {f.__name__: f for f in (negative_pool_anti, triples_top_negatives, triples_hash_sampled, triples_first_passage, triples_resolve_text, distill_pairs, distill_tuples, distill_tuples_maxp, distill_scored, triples_shuffled, tuple_passages, pairwise_ce, kl_distillation, learning_rates, in_batch_ce)}

_POS = "ps AS (SELECT qid, pid AS docid FROM qr WHERE rel > 0)"
_CA = "ca AS (SELECT qid, pid AS docid, min(rank) AS ord FROM rn GROUP BY ALL)"
_POOL = "po AS (SELECT ca.* FROM ca LEFT JOIN ps USING (qid, docid) WHERE ps.qid IS NULL)"
_BASE = (C.QRELS, C.RUNS, _POS, _CA, _POOL)
#: The pool in the order of a hash; a positive takes two places from one that its own hash gives.
_HS = """pl AS (SELECT qid, docid AS neg, row_number() OVER (PARTITION BY qid ORDER BY md5(concat_ws('|', '12345', qid, docid)), docid) - 1 AS place, count(*) OVER (PARTITION BY qid) AS n FROM (SELECT DISTINCT qid, docid FROM po)),
dr AS (SELECT qid, docid AS pos, CAST('0x' || substr(md5(concat_ws('|', '12345', qid, docid)), 1, 12) AS BIGINT) AS start, unnest(range(1, least(2, n) + 1)) AS k, n FROM ps JOIN (SELECT DISTINCT qid, n FROM pl) USING (qid)),
hs AS (SELECT dr.qid, pos, neg, CAST(k AS INTEGER) AS k FROM dr JOIN pl ON pl.qid = dr.qid AND pl.place = (start + k - 1) % dr.n)"""
_PM = "pm AS (SELECT pid, max(docid) AS docid FROM passage_to_doc WHERE pid IS NOT NULL GROUP BY pid)"
_TB = C.sql_strip(f"concat_ws(' ', {C.sql_strip("coalesce(title, '')")}, {C.sql_strip("coalesce(body, '')")})")
_SC = "sc AS (SELECT qid, docid AS pid, ord AS rank, CAST(CAST('0x' || substr(md5(concat_ws('|', qid, docid)), 1, 6) AS INTEGER) AS DOUBLE) / 1e6 AS score FROM ca)"
_NWAY = """fl AS (SELECT {s}.*, {p}.pid IS NOT NULL AS is_pos FROM {s} LEFT JOIN (SELECT DISTINCT qid, pid FROM {p}) {p} ON {s}.qid = {p}.qid AND {s}.pid = {p}.pid),
be AS (SELECT * FROM (SELECT qid, pid AS pos, score AS pos_score, row_number() OVER (PARTITION BY qid ORDER BY is_pos DESC, score DESC, rank, pid) AS r FROM fl) WHERE r = 1),
re AS (SELECT * FROM (SELECT fl.qid, fl.pid, fl.score, row_number() OVER (PARTITION BY fl.qid ORDER BY fl.score DESC, fl.rank, fl.pid) AS r FROM fl JOIN be USING (qid) WHERE fl.pid <> be.pos) WHERE r < {n}),
nw AS (SELECT be.qid, pos || ',' || string_agg(pid, ',' ORDER BY re.r) AS pids, format('{{:.6f}}', any_value(pos_score)) || ',' || string_agg(format('{{:.6f}}', score), ',' ORDER BY re.r) AS scores FROM be JOIN re ON be.qid = re.qid GROUP BY be.qid, pos HAVING count(*) = {n} - 1)"""
_TS = """tt AS (SELECT DISTINCT qid, pids, scores, positive_idx, built_at FROM tuples WHERE qid IS NOT NULL AND pids IS NOT NULL),
ts AS (SELECT tuple, n, max(score) AS score, max(positive_idx) AS positive_idx FROM (SELECT md5(concat_ws('|', qid, array_to_string(list_transform(pids, lambda p: coalesce(p, '-')), ','), strftime(built_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S'))) AS tuple, positive_idx, unnest(range(0, len(scores))) AS n, unnest(scores) AS score FROM tt) WHERE score IS NOT NULL GROUP BY tuple, n)"""
_LSM = "{s} - max({s}) OVER (PARTITION BY {g}) - ln(sum(exp({s} - mx)) OVER (PARTITION BY {g}))"
SQL = {
    "negative_pool_anti": C.with_(*_BASE) + "SELECT * FROM po",
    "triples_top_negatives": C.with_(*_BASE) + "SELECT ps.qid, ps.docid AS pos, n.docid AS neg, CAST(n.k AS INTEGER) AS k FROM ps JOIN (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY ord, docid) AS k FROM po) n ON n.qid = ps.qid AND n.k <= 2",
    "triples_hash_sampled": C.with_(*_BASE, _HS) + "SELECT * FROM hs",
    "triples_first_passage": C.with_(*_BASE, _HS, _PM, "fp AS (SELECT docid, pid FROM pm WHERE pid = docid || '_p0')") + "SELECT qid, k, p.pid AS pos, n.pid AS neg FROM hs JOIN fp p ON p.docid = hs.pos JOIN fp n ON n.docid = hs.neg",
    "triples_resolve_text": C.with_(*_BASE, _HS, C.DOCS, C.QUERIES_ONCE, f"dt AS (SELECT docid, {_TB} AS text FROM docs)") + "SELECT hs.qid, pos, neg, qs.text AS query, md5(p.text) AS pos_md5, md5(n.text) AS neg_md5 FROM hs JOIN qs USING (qid) JOIN dt p ON p.docid = pos JOIN dt n ON n.docid = neg",
    "distill_pairs": C.with_(*_BASE, C.DOCS, C.QUERIES_ONCE, "rk AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY ord, docid) AS rank FROM ca)") + "SELECT rk.qid, rk.docid AS pid, CAST(rank AS INTEGER) AS rank, qs.text AS query, " + _TB + " AS text FROM rk JOIN qs USING (qid) JOIN docs ON docs.docid = rk.docid WHERE rank <= 10",
    "distill_tuples": C.with_(*_BASE, _SC, "pp AS (SELECT qid, docid AS pid FROM ps)", _NWAY.format(s="sc", p="pp", n=8)) + "SELECT qid, pids, scores, CAST(0 AS INTEGER) AS positive_idx FROM nw",
    "distill_tuples_maxp": C.with_(
        C.QRELS,
        _POS,
        _PM,
        "tp AS (SELECT qid, pid, max(score) AS score FROM (SELECT qid, unnest(pids) AS pid, unnest(scores) AS score FROM tuples WHERE qid IS NOT NULL) WHERE pid IS NOT NULL AND score IS NOT NULL GROUP BY ALL)",
        "tr AS (SELECT *, row_number() OVER (PARTITION BY qid ORDER BY score DESC, pid) AS rank FROM tp)",
        "pp AS (SELECT tr.qid, tr.pid FROM tr JOIN pm USING (pid) JOIN ps ON ps.qid = tr.qid AND ps.docid = pm.docid)",
        _NWAY.format(s="tr", p="pp", n=4),
    )
    + "SELECT qid, pids, CAST(0 AS INTEGER) AS positive_idx FROM nw",
    "tuple_passages": C.with_(C.DOCS, SEG, "pt AS (SELECT docid || '_p' || passage_idx AS pid, array_to_string(ws[passage_idx * 90 + 1 : passage_idx * 90 + 180], ' ') AS text FROM seg)", "tt AS (SELECT DISTINCT qid, pids, built_at FROM tuples WHERE qid IS NOT NULL AND len(pids) > 0)", "tp AS (SELECT md5(concat_ws('|', qid, array_to_string(list_transform(pids, lambda p: coalesce(p, '-')), ','), strftime(built_at AT TIME ZONE 'UTC', '%Y%m%d%H%M%S'))) AS tuple, unnest(range(0, len(pids))) AS n, unnest(pids) AS pid FROM tt)")
    + "SELECT DISTINCT tuple, CAST(n AS INTEGER) AS n, tp.pid, text FROM tp JOIN pt USING (pid) WHERE tuple NOT IN (SELECT tuple FROM tp LEFT JOIN pt USING (pid) WHERE pt.pid IS NULL)",
    "distill_scored": C.with_(*_BASE, C.DOCS, C.QUERIES_ONCE, "rk AS (SELECT qid, docid, row_number() OVER (PARTITION BY qid ORDER BY ord, docid) AS rank FROM ca)", f"sp AS (SELECT rk.qid, rk.docid AS pid, rank, CAST(CAST('0x' || substr(md5(coalesce(qs.text, '') || '|' || {_TB}), 1, 6) AS INTEGER) AS DOUBLE) / 1e6 AS score FROM rk JOIN qs USING (qid) JOIN docs ON docs.docid = rk.docid WHERE rank <= 10)", "pp AS (SELECT qid, docid AS pid FROM ps)", _NWAY.format(s="sp", p="pp", n=4)) + "SELECT qid, pids, scores, CAST(0 AS INTEGER) AS positive_idx FROM nw",
    "triples_shuffled": C.with_(*_BASE, _HS) + "SELECT key, row_number() OVER (ORDER BY md5(concat_ws('|', '42', '3', key)), key) - 1 AS place FROM (SELECT concat_ws('|', qid, pos, neg) AS key FROM hs)",
    "pairwise_ce": C.with_(_TS) + "SELECT round(avg(greatest(g.score - p.score, 0) + ln(1 + exp(-abs(g.score - p.score)))), 6) AS loss, count(*) AS n FROM ts g JOIN ts p ON g.tuple = p.tuple AND p.n = p.positive_idx AND g.n <> g.positive_idx",
    "kl_distillation": C.with_(_TS, "a AS (SELECT *, -CAST(n AS DOUBLE) AS st, max(score) OVER (PARTITION BY tuple) AS mt, max(-n) OVER (PARTITION BY tuple) AS ms FROM ts), b AS (SELECT tuple, score - mt - ln(sum(exp(score - mt)) OVER (PARTITION BY tuple)) AS lt, st - ms - ln(sum(exp(st - ms)) OVER (PARTITION BY tuple)) AS ls FROM a)") + "SELECT round(avg(kl), 6) AS loss, count(*) AS n FROM (SELECT tuple, sum(exp(lt) * (lt - ls)) AS kl FROM b GROUP BY tuple)",
    "learning_rates": C.with_(*_BASE, _HS, "t AS (SELECT count(*) AS n FROM hs)") + "SELECT step, round(CASE WHEN step < 100 THEN step / 100.0 ELSE greatest(0.0, (n - step) / greatest(1, n - 100)) END, 9) AS share FROM (SELECT n, unnest(range(0, n + 11)) AS step FROM t)",
    "in_batch_ce": C.with_(C.E, "m AS (SELECT x.doc_idx // 8 AS batch, x.doc_idx AS q, y.doc_idx AS d, x.pos, max(list_dot_product(x.v, y.v)) AS m FROM e x JOIN e y ON x.doc_idx // 8 = y.doc_idx // 8 AND x.pos % 2 = 0 AND y.pos % 2 = 1 GROUP BY ALL), s AS (SELECT batch, q, d, sum(m) AS score FROM m GROUP BY ALL), t AS (SELECT *, max(score) OVER (PARTITION BY q) AS mx FROM s), l AS (SELECT q, d, score - mx - ln(sum(exp(score - mx)) OVER (PARTITION BY q)) AS lp FROM t)") + "SELECT round(avg(-lp), 6) AS loss, count(*) AS n FROM l WHERE q = d",
}
