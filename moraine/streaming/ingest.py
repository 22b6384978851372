"""Incremental encoding of a growing collection, exactly once."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from ..operators.index import DENSE, encode_texts
from ..runtime import file_system


def ingest(spark: SparkSession, source: str, schema: StructType, to_collection: Callable[[DataFrame], DataFrame], encoder: Callable[[DataFrame], DataFrame], centroids: DataFrame, parameters: DataFrame, nbits: int, sink: str, checkpoint: str) -> int:
    """Encode the files of ``source`` that were not encoded before into ``sink``; returns the rows of the last run.

    A file source with ``availableNow`` works off what is there and stops. The
    checkpoint holds which files are done; the sink's log makes the append of a
    batch atomic, so a run that is killed and started again neither loses nor
    repeats rows.
    """
    reader = spark.readStream.schema(schema)
    head, name = source.rstrip("/").rsplit("/", 1)
    # A file stream watches a folder; a table in one file is a folder with a filter.
    fs, at = file_system(spark, source)
    stream = reader.parquet(source) if fs.getFileStatus(at).isDirectory() else reader.option("pathGlobFilter", name).parquet(head)
    codes = encode_texts(to_collection(stream), encoder, centroids, parameters, nbits)
    run = codes.writeStream.format("parquet").options(**DENSE).option("path", sink).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
    run.awaitTermination()
    return sum(int(p["numInputRows"]) for p in run.recentProgress)


def as_collection(df: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """``(ordinal, pid, text)`` of any table with ids; the ordinal of ids that are no numbers is their hash."""
    return df.where(F.col(id_col).isNotNull()).select(F.coalesce(F.col(id_col).try_cast("long"), F.xxhash64(id_col)).alias("ordinal"), F.col(id_col).cast("string").alias("pid"), F.col(text_col).alias("text"))
