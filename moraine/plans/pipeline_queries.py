"""Queries of the index build and of incremental encoding over all documents."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import vectors
from ..functions.encoders import encoder, hashed_words
from ..operators import index as I
from ..runtime import materialize, shared_dir, table
from ..streaming.ingest import as_collection, ingest
from . import common as C


#: Indexes built in this process: session and data to path.
_PATHS: dict[tuple[str, str], str] = {}


def kmeans_centroids(spark: SparkSession, d: str) -> DataFrame:
    """Centroids of all embeddings, with all components and the number of vectors nearest to each."""
    e = C.token_vectors(spark, d)
    cen = materialize(I.kmeans_centroids(e, 16, 5), "centroids")
    near = I.ranked_centroids(e, cen, 1, ["vec_id"], with_centroid=False)
    out = cen.join(near.groupBy("cid").agg(F.count("*").alias("n")), "cid", "left")
    return out.select("cid", F.coalesce("n", F.lit(0)).alias("n"), F.posexplode("centroid").alias("d", "x")).withColumn("x", F.round("x", 6))


def _collection(spark: SparkSession, d: str) -> DataFrame:
    return as_collection(table(spark, d, "documents"), "doc_id")


def _built(spark: SparkSession, d: str) -> str:
    """An index of all documents, with the settings of production but for the encoder, which is the stand-in."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _PATHS:
        path, c = f"{shared_dir(spark)}/index-{uuid.uuid4().hex}", Config()
        I.build_index(spark, _collection(spark, d), encoder(hashed_words(longest=c.doc_maxlen)), path, c.nbits, seed=c.seed, iterations=c.kmeans_iterations, residual_sample=c.residual_sample)
        _PATHS[key] = path
    return _PATHS[key]


def index_build(spark: SparkSession, d: str) -> DataFrame:
    """Documents of a staged index build with their lengths."""
    return spark.read.parquet(_built(spark, d) + "/docs").select("pid", "doclen")


def index_lists(spark: SparkSession, d: str) -> DataFrame:
    """What the inverted lists hold: entries, different ones, the least and the greatest, and lists out of order."""
    return I.list_totals(spark.read.parquet(_built(spark, d) + "/lists"))


def index_decode(spark: SparkSession, d: str) -> DataFrame:
    """Cosine of each encoded token with what the codes give back."""
    path = _built(spark, d)
    cen, par = spark.read.parquet(path + "/centroids"), spark.read.parquet(path + "/parameters")
    by_doc, encode = spark.read.parquet(path + "/by_doc"), hashed_words(longest=Config().doc_maxlen)
    if I.centroid_blocks(cen) == 1:
        return I.code_cosines(_collection(spark, d), by_doc, encode, cen, par, 2)
    back = I.decode(by_doc, cen, par, 2).select("pid", "pos", F.col("vec").alias("decoded"))
    own = encoder(encode)(_collection(spark, d))
    return own.join(back, ["pid", "pos"]).select("pid", "pos", F.round(vectors.cosine(F.col("vec"), F.col("decoded")), 6).alias("cosine"))


def stream_ingest(spark: SparkSession, d: str) -> DataFrame:
    """Lengths of the documents, encoded against the index's centroids by a stream that stops when all files are done."""
    base, path = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}", _built(spark, d)
    cen, par = spark.read.parquet(path + "/centroids"), spark.read.parquet(path + "/parameters")
    schema = table(spark, d, "documents").schema
    ingest(spark, f"{d}/documents.parquet", schema, lambda df: as_collection(df, "doc_id"), encoder(hashed_words(longest=Config().doc_maxlen)), cen, par, 2, base + "/codes", base + "/checkpoint")
    return spark.read.parquet(base + "/codes").groupBy("pid").agg(F.count("*").alias("doclen"))


QUERIES = {f.__name__: f for f in (kmeans_centroids, index_build, index_lists, index_decode, stream_ingest)}
_LEN = f"dl AS (SELECT CAST(doc_id AS VARCHAR) AS pid, CAST(least({Config().doc_maxlen}, len({C.sql_words('text')})) AS BIGINT) AS doclen FROM documents WHERE doc_id IS NOT NULL)"
SQL = {
    "index_build": C.with_(_LEN) + "SELECT * FROM dl",
    "index_lists": C.with_(_LEN) + "SELECT CAST(sum(doclen) AS BIGINT) AS n, CAST(sum(doclen) AS BIGINT) AS n_different, CAST(0 AS BIGINT) AS least, CAST(sum(doclen) - 1 AS BIGINT) AS greatest, CAST(0 AS BIGINT) AS n_unsorted FROM dl",
    "stream_ingest": C.with_(_LEN) + "SELECT * FROM dl WHERE doclen > 0",
}
