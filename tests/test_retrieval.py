import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from moraine.functions.encoders import encoder, hashed_words
from moraine.operators import index as I
from moraine.operators import retrieval as R


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)

    def unit():
        v = rng.normal(size=8)
        return (v / np.linalg.norm(v)).tolist()

    docs = [(i, p, unit()) for i in range(40) for p in range(3 + i % 9)]
    q = [(i, p, unit()) for i in range(5) for p in range(4)]
    return docs, q, spark.createDataFrame(docs, "doc_idx long, pos int, vec array<double>"), spark.createDataFrame(q, "qid long, qpos int, qvec array<double>")


def brute(docs, q, k):
    out = []
    for i in sorted({x[0] for x in q}):
        Q = np.array([x[2] for x in q if x[0] == i])
        s = [(-round(float((Q @ np.array([x[2] for x in docs if x[0] == d]).T).max(1).sum()), 6), d) for d in sorted({x[0] for x in docs})]
        out += [(i, d, n + 1) for n, (_, d) in enumerate(sorted(s)[:k])]
    return out


def test_exact_paths_agree_with_brute_force(spark, data):
    docs, q, D, Q = data
    want = brute(docs, q, 7)
    every = Q.select("qid").distinct().withColumn("one", F.lit(1)).join(D.withColumn("one", F.lit(1)), "one").drop("one")
    assert rows(R.top(R.maxsim(Q, every), 7).select("qid", "doc_idx", "rank")) == sorted(want)
    assert rows(R.exact_topk(Q, D, 7).select("qid", "doc_idx", "rank")) == sorted(want)
    assert rows(R.exact_topk(Q, D, 7, block=4).select("qid", "doc_idx", "rank")) == sorted(want)


def test_two_rounds_with_every_centroid_probed_is_exact(spark, data):
    docs, q, D, Q = data
    cen = I.mean_centroids(D.withColumn("label", F.col("doc_idx") % 6))
    codes = I.ranked_centroids(D, cen, 1, ["doc_idx", "pos"]).select("doc_idx", "pos", "cid", "vec")
    assert rows(R.retrieve(Q, cen, codes, 6, 40, 7).select("qid", "doc_idx", "rank")) == sorted(brute(docs, q, 7))
    few = R.retrieve(Q, cen, codes, 1, 3, 7).groupBy("qid").count().collect()
    assert {r["count"] for r in few} == {3}


def test_all_negative_scores_are_kept(spark):
    q = spark.createDataFrame([(1, 0, [1.0, 0.0])], "qid long, qpos int, qvec array<double>")
    d = spark.createDataFrame([(1, 0, [-1.0, 0.0]), (2, 0, [-0.5, 0.0])], "doc_idx long, pos int, vec array<double>")
    assert [(r.doc_idx, r.score) for r in R.top(R.maxsim(q, d.withColumn("qid", F.lit(1))), 2).orderBy("rank").collect()] == [(2, -0.5), (1, -1.0)]


def test_empty_query_set(spark, data):
    _, _, D, Q = data
    assert R.exact_topk(Q.limit(0), D, 3).count() == 0
    assert R.exact_topk(Q, D.limit(0), 3).count() == 0


def test_max_passage(spark):
    run = spark.createDataFrame([(1, "D1_p0", 0.9, 1), (1, "D3_p1", 0.8, 2), (1, "D1_p1", 0.7, 3), (1, "D3_p0", 0.6, 4), (1, "D2_p0", 0.5, 5), (1, "none", 9.0, 6), (2, "none", 1.0, 1)], "qid int, pid string, score double, rank int")
    m = spark.createDataFrame([("D1_p0", "D1"), ("D1_p1", "D1"), ("D2_p0", "D2"), ("D3_p0", "D3"), ("D3_p1", "D3")], "pid string, docid string")
    got = R.max_passage(run, m, 2).orderBy("rank").collect()
    assert [(r.qid, r.docid, r.score, r["rank"]) for r in got] == [(1, "D1", 0.9, 1), (1, "D3", 0.8, 2)]


def test_build_resumes_and_refuses_other_data(spark, tmp_path):
    col = spark.createDataFrame([(i, f"D{i}", " ".join(f"w{(i * 7 + j) % 50}" for j in range(20 + i % 5))) for i in range(30)] + [(30, "D30", "")], "ordinal long, pid string, text string")
    path = str(tmp_path / "index")
    enc = encoder(hashed_words(16))
    meta = I.build_index(spark, col, enc, path, iterations=2)
    assert meta["n_docs"] == 31 and meta["n_embeddings"] == sum(20 + i % 5 for i in range(30)) and meta["bytes_per_vector"] == 8
    assert spark.read.parquet(path + "/docs").where("doclen = 0").count() == 1
    codes = rows(spark.read.parquet(path + "/by_doc").select("pid", "pos", "cid", "packed"))

    def broken(df):
        raise AssertionError("a finished index is not encoded again")

    assert I.build_index(spark, col, broken, path, iterations=2) == meta
    with pytest.raises(ValueError):
        I.build_index(spark, col.limit(5), enc, path)
    state = I._state(path)
    I._set_state(path, fingerprint=state["fingerprint"], stage="centroids")
    assert I.build_index(spark, col, enc, path, iterations=2) == meta
    assert rows(spark.read.parquet(path + "/by_doc").select("pid", "pos", "cid", "packed")) == codes


def test_sample_size():
    assert I.n_sampled_docs(10) == 10 and I.n_sampled_docs(10**6) == 128_996 and I.n_sampled_docs(10, 0.01) == 1


def test_recall_of_the_registered_retrieval(spark, tmp_path):
    from moraine.config import Config
    from moraine.plans import retrieval_queries as Q

    rng = np.random.default_rng(5)
    vecs = [(i, [float(x) for x in rng.normal(size=8)], int(rng.integers(4))) for i in range(8 * 200)]
    spark.createDataFrame(vecs, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    assert Config().n_candidates == Q.FULL
    exact = set(rows(Q.maxsim_exact_topk(spark, str(tmp_path)).select("qid", "doc_idx")))
    found = set(rows(Q.retrieve_full(spark, str(tmp_path)).select("qid", "doc_idx")))
    assert len(exact & found) >= 0.9 * len(exact)
    few = set(rows(Q.retrieve_topk(spark, str(tmp_path)).select("qid", "doc_idx")))
    got = Q.retrieve_recall(spark, str(tmp_path)).groupBy("n_candidates").agg(F.avg("recall").alias("recall")).collect()
    assert {r.n_candidates: round(r.recall, 6) for r in got} == {20: len(exact & few) / len(exact), Q.FULL: len(exact & found) / len(exact)}


def _index(spark, path, n_docs=40, seed=3):
    """Vectors of documents with their index under 12 centroids."""
    rng = np.random.default_rng(seed)
    vecs = rng.normal(size=(n_docs * 5, 16))
    vecs /= np.linalg.norm(vecs, axis=1, keepdims=True)
    D = spark.createDataFrame([(i // 5, f"D{i // 5}", i % 5, v.tolist()) for i, v in enumerate(vecs)], "ordinal long, pid string, pos int, vec array<double>")
    I.learn(D, 12, 4, path, 5)
    I.write_codes(D, path, 4)
    I.write_lists(D.select("ordinal", "pid").distinct(), path)
    return vecs, D


def test_search_scores_what_the_codes_give_back(spark, tmp_path):
    path = str(tmp_path / "index")
    vecs, _ = _index(spark, path)
    cen, par = spark.read.parquet(path + "/centroids"), spark.read.parquet(path + "/parameters")
    back = {(r.ordinal, r.pos): np.array(r.vec) for r in I.decode(spark.read.parquet(path + "/by_doc"), cen, par, 4).collect()}
    q = {7: vecs[[3, 11]], 8: vecs[[50]]}
    Q = spark.createDataFrame([(k, i, v.tolist()) for k, m in q.items() for i, v in enumerate(m)], "qid long, qpos int, qvec array<double>")
    got = R.search_index(Q, path, 4, nprobe=12, n_candidates=1000, k=5).collect()
    for k, m in q.items():
        score = {d: round(sum(max(v @ back[d, p] for p in range(5)) for v in m), 6) for d in range(40)}
        best = sorted(score, key=lambda d: (-score[d], d))[:5]
        assert [(r.doc_idx, pytest.approx(r.score, abs=1e-5)) for r in sorted((r for r in got if r.qid == k), key=lambda r: r["rank"])] == [(d, score[d]) for d in best]


def test_search_reads_the_probed_folders_only(spark, tmp_path):
    path = str(tmp_path / "index")
    vecs, _ = _index(spark, path)
    Q = spark.createDataFrame([(1, 0, vecs[0].tolist())], "qid long, qpos int, qvec array<double>")
    one = R.search_index(Q, path, 4, nprobe=1, n_candidates=1000, k=1000)
    assert one.where("rank = 1").first().doc_idx == 0
    few = R.probes(Q, spark.read.parquet(path + "/centroids"), 1).first().cid
    wanted = {r.ordinal for r in spark.read.parquet(path + "/codes").where(F.col("cid") == few).collect()}
    assert {r.doc_idx for r in one.collect()} == wanted and len(wanted) < 40
    lists = spark.read.parquet(path + "/lists").collect()
    assert sorted(e for r in lists for e in r.emb_ids) == list(range(200)) and all(r.emb_ids == sorted(r.emb_ids) for r in lists)


def test_search_beyond_what_is_pushed_into_scans(spark, tmp_path, monkeypatch):
    path = str(tmp_path / "index")
    vecs, _ = _index(spark, path)
    Q = spark.createDataFrame([(i, 0, v.tolist()) for i, v in enumerate(vecs[::20])], "qid long, qpos int, qvec array<double>")
    want = rows(R.search_index(Q, path, 4, 2, 10, 5))
    monkeypatch.setattr(R, "MOST_PUSHED", 0)
    assert rows(R.search_index(Q, path, 4, 2, 10, 5)) == want


def test_centroids_in_blocks_are_as_in_one(spark, tmp_path, monkeypatch):
    _, D = _index(spark, str(tmp_path / "index"))
    cen, par = spark.read.parquet(str(tmp_path / "index/centroids")), spark.read.parquet(str(tmp_path / "index/parameters"))
    take = lambda: (rows(I.ranked_centroids(D, cen, 3, ["ordinal", "pos"]).select("ordinal", "pos", "cid", "probe")), rows(I.encode(D, cen, par, 4)))
    want = take()
    monkeypatch.setattr(I, "MOST_CENTROIDS", 5)
    assert I.centroid_blocks(cen) == 3 and take() == want


def test_two_levels_of_centroids(spark):
    rng = np.random.default_rng(4)
    middle = rng.normal(size=(32, 8)) * 4
    x = np.repeat(middle, 20, axis=0) + rng.normal(size=(640, 8)) * 0.1
    S = spark.createDataFrame([(v.tolist(),) for v in x], "vec array<double>")
    c = np.array([r.centroid for r in I.kmeans_centroids(S, 64, 10, direct=16).collect()])
    assert 40 <= len(c) <= 64
    lost = ((x[:, None] - c[None]) ** 2).sum(2).min(1).mean()
    assert lost < 0.1 * ((x - x.mean(0)) ** 2).sum(1).mean()


def test_texts_without_tokens_have_an_index(spark, tmp_path):
    col = spark.createDataFrame([(0, "a", ""), (1, "b", None)], "ordinal long, pid string, text string")
    meta = I.build_index(spark, col, encoder(hashed_words(16)), str(tmp_path / "none"), settings={"dim": 16})
    assert meta["n_docs"] == 2 and meta["n_embeddings"] == 0 and meta["n_centroids"] == 1 and meta["dim"] == 16
