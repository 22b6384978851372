from pyspark.sql import functions as F

from moraine.functions import codec, vectors
from moraine.functions.encoders import encoder, hashed_words
from moraine.operators import index as I
from moraine.streaming.ingest import as_collection, ingest


def test_each_file_is_encoded_once(spark, tmp_path):
    src, sink, cp = (str(tmp_path / n) for n in ("in", "out", "cp"))
    docs = spark.createDataFrame([(str(i), f"w{i} w{i + 1} w{i % 3}") for i in range(20)], "qid string, text string")
    enc = encoder(hashed_words(8))
    sample = enc(as_collection(docs, "qid"))
    cen = I.kmeans_centroids(sample, 4, 2)
    near = I.ranked_centroids(sample, cen, 1, ["pid", "pos"])
    par = codec.as_arrays(codec.quantile_parameters(near.select(vectors.minus(F.col("vec"), F.col("centroid")).alias("residual")), 2))

    def go():
        ingest(spark, src, docs.schema, lambda df: as_collection(df, "qid"), enc, cen, par, 2, sink, cp)
        return spark.read.parquet(sink).count()

    docs.limit(10).coalesce(1).write.parquet(src)
    assert go() == 30
    assert go() == 30
    docs.where(F.col("qid").cast("int") >= 10).coalesce(1).write.mode("append").parquet(src)
    assert go() == 60
