"""Dense row numbers without a single-task window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, width


def dense_ordinal(df: DataFrame, by: list[str], name: str = "ordinal", parts: int | None = None) -> DataFrame:
    """``df`` with a row number from 0 in the order of ``by`` (which must be unique for a defined result).

    Rows are range-partitioned and numbered within their range; the counts of
    the ranges - one row each - give the offsets.
    """
    placed = materialize(df.repartitionByRange(parts or width(df.sparkSession), *by).withColumn("_part", F.spark_partition_id()), "ranges")
    counts = placed.groupBy("_part").agg(F.count("*").alias("_n"))
    offsets = counts.select("_part", (F.sum("_n").over(Window.orderBy("_part")) - F.col("_n")).alias("_before"))  # one row per range
    inside = F.row_number().over(Window.partitionBy("_part").orderBy(*by)) - 1
    return placed.join(F.broadcast(offsets), "_part").withColumn(name, (F.col("_before") + inside).cast("long")).drop("_part", "_before")


def with_line_no(lines: DataFrame, name: str = "line_no") -> DataFrame:
    """Lines of a text source with their number from 0, in the order of path and position.

    ``lines`` comes straight from ``spark.read.text``. Within a block the order
    of rows is that of the file; the counts of the blocks give the offsets.
    """
    cols = lines.columns
    block = lines.select(*cols, F.col("_metadata.file_path").alias("_file"), F.col("_metadata.file_block_start").alias("_start"), F.monotonically_increasing_id().alias("_row"))
    w = Window.partitionBy("_file", "_start").orderBy("_row")
    counts = block.groupBy("_file", "_start").agg(F.count("*").alias("_n"))
    offsets = counts.select("_file", "_start", (F.sum("_n").over(Window.orderBy("_file", "_start")) - F.col("_n")).alias("_before"))  # one row per block
    return block.withColumn("_inside", F.row_number().over(w) - 1).join(offsets, ["_file", "_start"]).select((F.col("_before") + F.col("_inside")).cast("long").alias(name), *cols)


def balanced_shard(ordinal: Column, n: Column, shards: int) -> Column:
    """Shard of a row when ``n`` rows are cut into contiguous shards, the first ``n % shards`` of which hold one more."""
    base, rest = F.floor(n / shards), n % shards
    big = rest * (base + 1)
    return F.when(ordinal < big, F.floor(ordinal / (base + 1))).otherwise(rest + F.floor((ordinal - big) / F.greatest(base, F.lit(1)))).cast("int")


def modular_shard(line_no: Column, shards: int) -> Column:
    return F.pmod(line_no, F.lit(shards)).cast("int")


def shuffled(df: DataFrame, key: str, seed: int, epoch: int = 0) -> DataFrame:
    """``df`` with its ``place`` from 0 in a reproducible global shuffle, another one each epoch; equal keys are rows of their own."""
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.lit(str(epoch)), F.col(key)))
    return dense_ordinal(df.withColumn("_hash", h), ["_hash", key], "place").drop("_hash")


def sample_exact(df: DataFrame, key: str, n: int, seed: int = 42) -> DataFrame:
    """Exactly ``n`` rows (or all) without replacement: those first by the hash of seed and key.

    Rows are not sorted: where the hash of the n-th row lies is found by counts
    of hash prefixes of 16 and then 32 bits (65,536 counts at most each time);
    rows under it are taken, and only those that share its prefix are put in
    order.
    """
    h = F.md5(F.concat_ws("|", F.lit(str(seed)), F.col(key).cast("string")))
    cut, rest = "", n
    for _ in range(2):
        prefix = F.substring(h, 1, len(cut) + 4)
        counts = df.where(h.startswith(cut)).groupBy(prefix.alias("p")).count().orderBy("p").collect()
        for r in counts:
            if rest <= r["count"]:
                cut = r["p"]
                break
            rest -= r["count"]
        else:
            return df
    under = F.substring(h, 1, len(cut)) < cut
    edge = df.where(h.startswith(cut)).orderBy(h, key).limit(rest)
    return df.where(under).unionByName(edge)
