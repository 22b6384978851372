"""Codec and index over all embeddings, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import codec, vectors
from ..config import Config
from ..operators import index as I
from ..operators.ordinals import sample_exact
from ..runtime import materialize
from . import common as C


def _near(spark: SparkSession, d: str) -> DataFrame:
    e = C.token_vectors(spark, d)
    return I.ranked_centroids(e, materialize(I.mean_centroids(e), "centroids"), 1, ["vec_id"])


def _residuals(spark, d):
    n = _near(spark, d)
    return n.withColumn("residual", vectors.minus(F.col("vec"), F.col("centroid")))


def _parameters(spark, d):
    r = materialize(_residuals(spark, d).select("vec_id", "residual"), "residuals")
    p = codec.quantile_parameters(sample_exact(r, "vec_id", Config().residual_sample), 2)
    return p.withColumn("value", F.round("value", 6))


def _codes(spark, d):
    p = materialize(codec.as_arrays(_parameters(spark, d)), "parameters")
    r = _residuals(spark, d).withColumns({"boundaries": p.select("boundaries").scalar(), "bucket_values": p.select("bucket_values").scalar()})
    return r.withColumn("codes", codec.quantize(F.col("residual"), F.col("boundaries")))


def centroids(spark, d):
    return I.mean_centroids(C.token_vectors(spark, d)).select(F.col("cid").alias("cid"), F.posexplode("centroid").alias("d", "x"))


def nearest_centroid(spark, d):
    return _near(spark, d).select("vec_id", "cid", "sim")


def residuals(spark, d):
    return _residuals(spark, d).select("vec_id", F.posexplode("residual").alias("d", "x")).withColumn("x", F.round("x", 6))


def quantile_boundaries(spark, d):
    return _parameters(spark, d).where(F.col("boundary").isNotNull()).select("d", "bucket", F.round("boundary", 6).alias("boundary"))


def bucket_values(spark, d):
    return _parameters(spark, d).select("d", "bucket", "value")


def quantize_codes(spark, d):
    return _codes(spark, d).select("vec_id", C.joined(F.col("codes")).alias("codes"))


def pack_codes(spark, d):
    return _codes(spark, d).select("vec_id", C.joined(codec.pack(F.col("codes"), 2)).alias("packed"))


def unpack_roundtrip(spark, d):
    c = _codes(spark, d)
    same = codec.unpack(codec.pack(F.col("codes"), 2), 2, 64) == F.slice("codes", 1, 64)
    return c.select("vec_id", same.alias("same"))


def _decoded(spark, d):
    c = _codes(spark, d)
    return c.withColumn("decoded", vectors.plus(F.col("centroid"), codec.dequantize(F.col("codes"), F.col("bucket_values"))))


def decode_vectors(spark, d):
    return _decoded(spark, d).select("vec_id", F.posexplode("decoded").alias("d", "x")).withColumn("x", F.round("x", 6))


def reconstruction_cosine(spark, d):
    return _decoded(spark, d).select("vec_id", F.round(vectors.cosine(F.col("vec"), F.col("decoded")), 6).alias("cosine"))


def l2_normalize(spark, d):
    e = C.token_vectors(spark, d)
    half = F.transform("vec", lambda x: x * 0.5)
    return e.select("vec_id", F.posexplode(vectors.unit(half)).alias("d", "x")).withColumn("x", F.round("x", 6))


def bytes_per_vector(spark, d):
    dim = C.token_vectors(spark, d).agg(F.max(F.size("vec"))).first()[0]
    return spark.createDataFrame([(n, codec.bytes_per_vector(dim, n)) for n in (1, 2, 4, 8)], "nbits int, n_bytes int")


def num_centroids(spark, d):
    e = C.token_vectors(spark, d)
    return e.groupBy(F.floor(F.col("doc_idx") / 10).cast("long").alias("span")).agg(F.count("*").alias("n")).select("span", "n", I.n_centroids_column(F.col("n")).alias("k"))


def doclens_offsets(spark, d):
    return I.doc_offsets(C.token_vectors(spark, d).groupBy("doc_idx").agg(F.count("*").alias("doclen")))


def emb_to_doc(spark, d):
    """Each embedding's document, found in the ranges of the offsets."""
    o = doclens_offsets(spark, d)
    return o.select(F.explode(F.sequence("emb_start", F.col("emb_start") + F.col("doclen") - 1)).alias("emb_id"), "doc_idx")


def shard_boundaries(spark, d):
    return I.shard_edges(doclens_offsets(spark, d), 7)


def inverted_lists(spark, d):
    n = _near(spark, d).select("cid", F.col("vec_id").alias("emb_id"))
    return I.inverted_lists(n).select("cid", "block", C.joined(F.col("emb_ids")).alias("emb_ids"))


def inverted_list_stats(spark, d):
    return _near(spark, d).groupBy("cid").agg(F.count("*").alias("n"), F.count_distinct("doc_idx").alias("n_docs"), F.min("vec_id").alias("first"), F.max("vec_id").alias("last"))


def index_metadata(spark, d):
    n = _near(spark, d)
    return n.agg(F.count_distinct("doc_idx").alias("n_docs"), F.count("*").alias("n_embeddings"), F.count_distinct("cid").alias("n_centroids"), F.max(F.size("vec")).alias("dim")).withColumn("n_bytes", F.col("n_embeddings") * (4 + F.ceil(F.col("dim") / 4)))


def encode_arrow(spark, d):
    """The codes by matrix products; equal to quantize_codes and pack_codes."""
    e = C.token_vectors(spark, d)
    p = materialize(codec.as_arrays(_parameters(spark, d)), "parameters")
    return I.encode(e.select("vec_id", "vec"), I.mean_centroids(e), p, 2).select("vec_id", "cid", F.lower(F.hex("packed")).alias("packed"))


QUERIES = {f.__name__: f for f in (centroids, nearest_centroid, residuals, quantile_boundaries, bucket_values, quantize_codes, pack_codes, unpack_roundtrip, decode_vectors, reconstruction_cosine, l2_normalize, bytes_per_vector, num_centroids, doclens_offsets, emb_to_doc, shard_boundaries, inverted_lists, inverted_list_stats, index_metadata, encode_arrow)}

_TO_CODES = (C.E, C.CEN, C.NEAR, C.RES, C.PAR, C.CODES)
_PACK = "bytes AS (SELECT vec_id, d // 4 AS k, CAST(sum(code * CAST(pow(4, d % 4) AS INTEGER)) AS INTEGER) AS byte FROM codes GROUP BY ALL)"
_DEC = "dx AS (SELECT vec_id, d, c[d + 1] + val AS x, v[d + 1] AS orig FROM codes JOIN near USING (vec_id) JOIN par ON par.d = codes.d AND par.b = codes.code)".replace("SELECT vec_id, d,", "SELECT vec_id, codes.d AS d,").replace("c[d + 1]", "c[codes.d + 1]").replace("v[d + 1]", "v[codes.d + 1]")
_LEN = "dl AS (SELECT doc_idx, count(*) AS doclen FROM e GROUP BY doc_idx), off AS (SELECT doc_idx, doclen, CAST(sum(doclen) OVER (ORDER BY doc_idx) - doclen AS BIGINT) AS emb_start FROM dl)"
SQL = {
    "centroids": C.with_(C.E, C.CEN) + "SELECT cid, CAST(d - 1 AS INTEGER) AS d, m AS x FROM cm",
    "nearest_centroid": C.with_(C.E, C.CEN, C.NEAR) + "SELECT vec_id, cid, sim FROM near",
    "residuals": C.with_(C.E, C.CEN, C.NEAR, C.RES) + "SELECT vec_id, CAST(d AS INTEGER) AS d, round(x, 6) AS x FROM res",
    "quantile_boundaries": C.with_(*_TO_CODES[:-1]) + "SELECT CAST(d AS INTEGER) AS d, CAST(b AS INTEGER) AS bucket, round(boundary, 6) AS boundary FROM par WHERE b < 3",
    "bucket_values": C.with_(*_TO_CODES[:-1]) + "SELECT CAST(d AS INTEGER) AS d, CAST(b AS INTEGER) AS bucket, val AS value FROM par",
    "quantize_codes": C.with_(*_TO_CODES) + "SELECT vec_id, string_agg(CAST(code AS VARCHAR), ',' ORDER BY d) AS codes FROM codes GROUP BY vec_id",
    "pack_codes": C.with_(*_TO_CODES, _PACK) + "SELECT vec_id, string_agg(CAST(byte AS VARCHAR), ',' ORDER BY k) AS packed FROM bytes GROUP BY vec_id",
    "unpack_roundtrip": C.with_(C.E) + "SELECT vec_id, true AS same FROM e",
    "decode_vectors": C.with_(*_TO_CODES, _DEC) + "SELECT vec_id, CAST(d AS INTEGER) AS d, round(x, 6) AS x FROM dx",
    "reconstruction_cosine": C.with_(*_TO_CODES, _DEC) + "SELECT vec_id, round(sum(x * orig) / greatest(sqrt(sum(orig * orig)) * sqrt(sum(x * x)), 1e-12), 6) AS cosine FROM dx GROUP BY vec_id",
    "l2_normalize": C.with_(C.E) + "SELECT vec_id, CAST(unnest(range(0, len(v))) AS INTEGER) AS d, round(unnest(v) / greatest(sqrt(list_dot_product(v, v)), 1e-12), 6) AS x FROM e",
    "bytes_per_vector": C.with_(C.E) + "SELECT CAST(nbits AS INTEGER) AS nbits, CAST(4 + ceil((SELECT max(len(v)) FROM e) * nbits / 8.0) AS INTEGER) AS n_bytes FROM (SELECT unnest([1, 2, 4, 8]) AS nbits)",
    "num_centroids": C.with_(C.E) + "SELECT CAST(floor(doc_idx / 10) AS BIGINT) AS span, count(*) AS n, CAST(pow(2.0, floor(log2(16 * sqrt(count(*))))) AS BIGINT) AS k FROM e GROUP BY 1",
    "doclens_offsets": C.with_(C.E, _LEN) + "SELECT * FROM off",
    "emb_to_doc": C.with_(C.E) + "SELECT row_number() OVER (ORDER BY doc_idx, pos) - 1 AS emb_id, doc_idx FROM e",
    "shard_boundaries": C.with_(C.E, _LEN, "t AS (SELECT max(emb_start + doclen) AS total, max(doc_idx) AS last FROM off), g AS (SELECT unnest(range(0, 7)) AS shard)") + "SELECT CAST(shard AS INTEGER) AS shard, coalesce((SELECT min(doc_idx) FROM off WHERE emb_start >= floor(shard * total / 7)), last + 1) AS first_doc FROM g, t",
    "inverted_lists": C.with_(C.E, C.CEN, C.NEAR) + "SELECT cid, CAST(floor(vec_id / 1048576) AS BIGINT) AS block, string_agg(CAST(vec_id AS VARCHAR), ',' ORDER BY vec_id) AS emb_ids FROM near GROUP BY 1, 2",
    "inverted_list_stats": C.with_(C.E, C.CEN, C.NEAR) + "SELECT cid, count(*) AS n, count(DISTINCT doc_idx) AS n_docs, min(vec_id) AS first, max(vec_id) AS last FROM near GROUP BY cid",
    "index_metadata": C.with_(C.E, C.CEN, C.NEAR) + "SELECT count(DISTINCT doc_idx) AS n_docs, count(*) AS n_embeddings, count(DISTINCT cid) AS n_centroids, CAST(max(len(v)) AS INTEGER) AS dim, CAST(count(*) * (4 + ceil(max(len(v)) / 4.0)) AS BIGINT) AS n_bytes FROM near",
    "encode_arrow": C.with_(*_TO_CODES, _PACK) + "SELECT vec_id, cid, string_agg(lower(printf('%02x', byte)), '' ORDER BY k) AS packed FROM bytes JOIN near USING (vec_id) GROUP BY vec_id, cid",
}
