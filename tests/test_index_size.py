"""Work that is done once for equal vectors, and tokens that move as byte strings."""

import numpy as np
from conftest import rows
from pyspark.sql import functions as F

from moraine.functions import vectors
from moraine.functions.encoders import encoder, hashed_words
from moraine.operators import index as I


def _collection(spark, n=60):
    rng = np.random.default_rng(6)
    return spark.createDataFrame([(i, f"D{i}", " ".join(f"w{int(j)}" for j in rng.zipf(1.3, 30) % 200)) for i in range(n)], "ordinal long, pid string, text string")


def test_equal_words_are_drawn_once(monkeypatch):
    drawn, generator = [], np.random.PCG64
    monkeypatch.setattr(np.random, "PCG64", lambda seed: drawn.append(seed) or generator(seed))
    got = hashed_words(4)(["a b a", "b a"])
    assert len(drawn) == 2 and np.array_equal(got[0], got[1][[1, 0, 1]])


def test_nearest_is_that_of_rounded_products():
    rng = np.random.default_rng(2)
    mat = rng.normal(size=(300, 6))
    mat = np.concatenate([mat, mat + 3e-7, mat - 8e-7])
    x = np.concatenate([rng.normal(size=(200, 6))] * 3)
    sim = np.round(x @ mat.T, 6)
    best, top = I.nearest_once(x, mat, 1)
    assert np.array_equal(best[:, 0], sim.argmax(1)) and np.array_equal(top[:, 0], sim.max(1))


def test_centroids_of_fewer_different_vectors_are_these(spark):
    vec = [[float(i % 20), float(i % 20) + 0.5] for i in range(400)]
    S = spark.createDataFrame([(v,) for v in vec], "vec array<float>")
    got = I.kmeans_centroids(S, 64, 3, direct=16).collect()
    assert sorted(r.cid for r in got) == list(range(20))
    assert sorted(r.centroid for r in got) == sorted(v for v in vec[:20])


def test_index_of_repeated_words(spark, tmp_path):
    col, path, encode = _collection(spark), str(tmp_path / "index"), hashed_words(8)
    meta = I.build_index(spark, col, encoder(encode), path, iterations=2)
    assert meta["n_embeddings"] == 1800
    by_doc, cen, par = (spark.read.parquet(f"{path}/{t}") for t in ("by_doc", "centroids", "parameters"))
    start = {r.ordinal: r.emb_start for r in spark.read.parquet(path + "/docs").collect()}
    own = {(r.ordinal, r.pos, r.cid, bytes(r.packed), start[r.ordinal] + r.pos, r.cid % I.BUCKETS) for r in by_doc.collect()}
    codes = I.read_codes(spark, path).select("ordinal", "pos", "cid", "packed", "emb_id", "bucket").collect()
    assert len(codes) == 1800 and {(*r[:3], bytes(r[3]), *r[4:]) for r in codes} == own
    back = I.decode(by_doc, cen, par, 2).select("pid", "pos", F.col("vec").alias("decoded"))
    want = encoder(encode)(col).join(back, ["pid", "pos"]).select("pid", "pos", F.round(vectors.cosine(F.col("vec"), F.col("decoded")), 5))
    got = I.code_cosines(col, by_doc, encode, cen, par, 2).select("pid", "pos", F.round("cosine", 5))
    assert [r[:2] for r in rows(got)] == [r[:2] for r in rows(want)]
    assert np.allclose([r[2] for r in rows(got)], [r[2] for r in rows(want)], atol=2e-5)


def test_two_texts_of_one_name_are_compared_by_place(spark, tmp_path):
    col, path, encode = spark.createDataFrame([(1, "D", "a b c d"), (1, "D", "a e"), (2, "E", "")], "ordinal long, pid string, text string"), str(tmp_path / "index"), hashed_words(8)
    I.build_index(spark, col, encoder(encode), path, iterations=2)
    by_doc, cen, par = (spark.read.parquet(f"{path}/{t}") for t in ("by_doc", "centroids", "parameters"))
    got = rows(I.code_cosines(col, by_doc, encode, cen, par, 2).select("pid", "pos"))
    assert got == rows(encoder(encode)(col).join(by_doc.select("pid", "pos"), ["pid", "pos"]).select("pid", "pos")) and len(got) == 10


def test_totals_of_lists(spark):
    lists = [[3, 5, 9], [9, 5], [], [1 << 40, (1 << 40) + 1], [7], [6, 8, 7], [9]]
    got = I.list_totals(spark.createDataFrame([(x,) for x in lists], "emb_ids array<long>"), span=64, most=1).first()
    assert tuple(got) == (12, 8, 3, (1 << 40) + 1, 2)
    assert tuple(I.list_totals(spark.createDataFrame([], "emb_ids array<long>")).first())[:4] == (0, 0, None, None)


def test_stream_draws_words_once_and_codes_as_the_index(spark, tmp_path):
    from moraine.streaming.ingest import as_collection, ingest

    docs = spark.createDataFrame([(str(i), "a b a c " * 5) for i in range(12)], "qid string, text string")
    docs.coalesce(1).write.parquet(str(tmp_path / "in"))
    col, path, enc = as_collection(docs, "qid"), str(tmp_path / "index"), encoder(hashed_words(8))
    I.build_index(spark, col, enc, path, iterations=2)
    ingest(spark, str(tmp_path / "in"), docs.schema, lambda df: as_collection(df, "qid"), enc, spark.read.parquet(path + "/centroids"), spark.read.parquet(path + "/parameters"), 2, str(tmp_path / "out"), str(tmp_path / "cp"))
    take = lambda p: rows(spark.read.parquet(p).select("pid", "pos", "cid", "packed"))
    assert take(str(tmp_path / "out")) == take(path + "/by_doc")
