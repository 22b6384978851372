"""Residual codec: quantile buckets per dimension, codes packed into bytes."""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def check_bits(nbits: int) -> int:
    if nbits not in (1, 2, 4, 8):
        raise ValueError("1, 2, 4 or 8 bits a dimension")
    return nbits


def bytes_per_vector(dim: int, nbits: int) -> int:
    """Four bytes of centroid id, and the packed codes."""
    per = 8 // check_bits(nbits)
    return 4 + -(-dim // per)


def quantize(residual: Column, boundaries: Column) -> Column:
    """Per dimension the number of boundaries strictly below the value. ``boundaries``: array of arrays."""
    return F.zip_with(residual, boundaries, lambda r, b: F.size(F.filter(b, lambda t: r > t)))


def pack(codes: Column, nbits: int) -> Column:
    """Codes as bytes (ints of 0-255): code j of a byte at bit ``j * nbits``, the tail filled with zeros."""
    per = 8 // check_bits(nbits)
    starts = F.sequence(F.lit(0), F.ceil(F.size(codes) / F.lit(per)).cast("int") - 1)

    def byte(k: Column) -> Column:
        part = F.slice(codes, k * per + 1, F.lit(per))
        placed = F.transform(part, lambda c, i: c * F.element_at(F.array(*[F.lit(1 << (j * nbits)) for j in range(per)]), i + 1))
        return F.aggregate(placed, F.lit(0), lambda s, x: s + x)

    return F.when(F.size(codes) == 0, F.expr("CAST(array() AS array<int>)")).otherwise(F.transform(starts, byte))


def unpack(packed: Column, nbits: int, dim: int) -> Column:
    """The first ``dim`` codes of packed bytes."""
    per = 8 // check_bits(nbits)
    codes = F.flatten(F.transform(packed, lambda b: F.array(*[F.shiftright(b, j * nbits).bitwiseAND((1 << nbits) - 1) for j in range(per)])))
    return F.slice(codes, 1, dim)


def dequantize(codes: Column, values: Column) -> Column:
    """Per dimension the value of the code. ``values``: array of arrays."""
    return F.zip_with(codes, values, lambda c, v: F.element_at(v, c + 1))


def uniform_parameters(dim: int, nbits: int) -> tuple[list[list[float]], list[list[float]]]:
    """Boundaries and values spread evenly over -1 to 1, where there are no residuals to learn from."""
    n = 1 << check_bits(nbits)
    edges = [-1 + 2 * (k + 1) / n for k in range(n - 1)]
    mids = [-1 + (2 * k + 1) / n for k in range(n)]
    return [edges] * dim, [mids] * dim


def quantile_parameters(residuals: DataFrame, nbits: int, vec: str = "residual") -> DataFrame:
    """``(d, bucket, boundary, value)``: for each dimension the quantile buckets of its sorted values.

    Bucket ``b`` of ``L`` holds the sorted positions from ``int(b / L * n)`` to
    ``int((b + 1) / L * n)``; its value is their mean and its boundary (but for
    the last) the value at the upper position, at most ``n - 1``. Callers pass
    a bounded sample: one dimension is sorted in one task.
    """
    level = 1 << check_bits(nbits)

    def spread(batches):
        for batch in batches:
            lists = batch.column(vec)
            at = np.concatenate([np.empty(0, np.int64), *[np.arange(n) for n in lists.value_lengths().to_numpy()]])
            order, flat = np.argsort(at, kind="stable"), lists.flatten().to_numpy(zero_copy_only=False)
            edge = np.append(0, np.cumsum(np.bincount(at)))
            flat = flat[order].astype(np.float64)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(len(edge) - 1, dtype=np.int32)), pa.array([flat[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])], pa.binary())], ["d", "x"])

    def buckets(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        x = np.sort(np.frombuffer(b"".join(pdf["x"]), np.float64))
        n = len(x)
        ends = [b * n // level for b in range(level)] + [n]
        parts = [x[lo:hi] for lo, hi in zip(ends[:-1], ends[1:])]
        edges = [x[min(hi, n - 1)] for hi in ends[1:-1]] + [None]
        out = pd.DataFrame({"d": np.int32(key[0]), "bucket": np.arange(level, dtype=np.int32), "boundary": pd.array(edges, "Float64"), "value": pd.array([p.mean() if len(p) else None for p in parts], "Float64")})
        return out[out["boundary"].notna() | out["value"].notna()]

    x = residuals.where(F.col(vec).isNotNull()).select(vec).mapInArrow(spread, "d int, x binary")
    return x.groupBy("d").applyInPandas(buckets, "d int, bucket int, boundary double, value double")


def as_arrays(parameters: DataFrame) -> DataFrame:
    """One row ``(boundaries, bucket_values)``, each an array over dimensions of arrays over buckets."""
    per = parameters.groupBy("d").agg(F.array_sort(F.collect_list(F.when(F.col("boundary").isNotNull(), F.struct("bucket", "boundary")))).alias("b"), F.array_sort(F.collect_list(F.struct("bucket", "value"))).alias("v"))
    per = per.select("d", F.col("b.boundary").alias("b"), F.col("v.value").alias("v"))
    return per.agg(F.array_sort(F.collect_list(F.struct("d", "b"))).alias("b"), F.array_sort(F.collect_list(F.struct("d", "v"))).alias("v")).select(F.col("b.b").alias("boundaries"), F.col("v.v").alias("bucket_values"))
