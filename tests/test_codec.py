import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from moraine.functions import codec, vectors
from moraine.operators import index as I


def test_bytes_per_vector():
    assert codec.bytes_per_vector(128, 2) == 36 and codec.bytes_per_vector(128, 1) == 20 and codec.bytes_per_vector(5, 4) == 7
    with pytest.raises(ValueError):
        codec.bytes_per_vector(128, 3)


def test_pack_known(spark):
    df = spark.createDataFrame([([3, 1, 0, 2],), ([1],), ([],)], "c array<int>")
    assert [r[0] for r in df.select(codec.pack(F.col("c"), 2)).collect()] == [[135], [1], []]
    assert spark.createDataFrame([([141],)], "p array<int>").select(codec.unpack(F.col("p"), 2, 4)).first()[0] == [1, 3, 0, 2]


@pytest.mark.parametrize("nbits", [1, 2, 4, 8])
def test_pack_roundtrip(spark, nbits):
    rng = np.random.default_rng(nbits)
    data = [(rng.integers(0, 1 << nbits, n).tolist(),) for n in (1, 7, 8, 9, 64)]
    df = spark.createDataFrame(data, "c array<int>")
    for n in (1, 7, 8, 9, 64):
        got = df.where(F.size("c") == n).select("c", codec.unpack(codec.pack(F.col("c"), nbits), nbits, n)).first()
        assert got[0] == got[1]


def test_quantize_is_strict(spark):
    df = spark.createDataFrame([([0.0, 0.1, -5.0], [[-0.1, 0.0, 0.1]] * 3)], "r array<double>, b array<array<double>>")
    assert df.select(codec.quantize(F.col("r"), F.col("b"))).first()[0] == [1, 2, 0]


def test_quantile_parameters_by_the_index_rule(spark):
    x = np.random.default_rng(1).normal(size=(101, 3))
    df = spark.createDataFrame([(r.tolist(),) for r in x], "residual array<double>")
    got = {(r.d, r.bucket): (r.boundary, r.value) for r in codec.quantile_parameters(df, 2).collect()}
    for d in range(3):
        s, n = np.sort(x[:, d]), 101
        for b in range(4):
            lo, hi = int(b / 4 * n), n if b == 3 else int((b + 1) / 4 * n)
            assert got[d, b][1] == pytest.approx(s[lo:hi].mean())
            if b < 3:
                assert got[d, b][0] == s[min(int((b + 1) / 4 * n), n - 1)]


def test_encode_decode(spark):
    rng = np.random.default_rng(2)
    cen = rng.normal(size=(16, 12))
    cen /= np.linalg.norm(cen, axis=1, keepdims=True)
    vec = cen[rng.integers(0, 16, 200)] + rng.normal(0, 0.1, (200, 12))
    v = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(vec)], "emb_id long, vec array<double>")
    c = spark.createDataFrame([(i, x.tolist()) for i, x in enumerate(cen)], "cid int, centroid array<double>")
    near = I.ranked_centroids(v, c, 1, ["emb_id"])
    p = codec.as_arrays(codec.quantile_parameters(near.select(vectors.minus(F.col("vec"), F.col("centroid")).alias("residual")), 2))
    codes = I.encode(v, c, p, 2)
    assert {r.emb_id: r.cid for r in codes.collect()} == {r.emb_id: r.cid for r in near.collect()}
    assert {len(r.packed) for r in codes.collect()} == {3}
    back = {r.emb_id: np.array(r.vec) for r in I.decode(codes, c, p, 2).collect()}
    cos = [back[i] @ vec[i] / np.linalg.norm(back[i]) / np.linalg.norm(vec[i]) for i in range(200)]
    assert min(cos) > 0.9


def test_every_embedding_is_in_one_list(spark):
    df = spark.createDataFrame([(i, i % 7) for i in range(100)], "emb_id long, cid int")
    lists = I.inverted_lists(df, 40).collect()
    assert sorted(e for r in lists for e in r.emb_ids) == list(range(100))
    assert all(list(r.emb_ids) == sorted(r.emb_ids) for r in lists)


@pytest.mark.parametrize("shards", [1, 2, 3, 8])
def test_shard_edges(spark, shards):
    lens = [5, 1, 8, 3, 2, 7, 4, 6]
    off = I.doc_offsets(spark.createDataFrame(list(enumerate(lens)), "doc_idx long, doclen long"))
    starts = np.cumsum([0, *lens])[:-1]
    assert [r.emb_start for r in off.orderBy("doc_idx").collect()] == starts.tolist()
    got = [r.first_doc for r in I.shard_edges(off, shards).orderBy("shard").collect()]
    assert got == [int(np.searchsorted(starts, g * sum(lens) // shards)) for g in range(shards)]


@given(st.integers(1, 10**9))
@settings(max_examples=50, deadline=None)
def test_n_centroids_is_a_power_of_two(n):
    k = I.n_centroids(n)
    assert k & (k - 1) == 0 and k <= 16 * n**0.5 < 2 * k


def test_uniform_parameters():
    b, v = codec.uniform_parameters(2, 2)
    assert b[0] == [-0.5, 0.0, 0.5] and v[1] == [-0.75, -0.25, 0.25, 0.75]
