"""Plug-in boundary for text encoders, with a deterministic stand-in.

An encoder maps a DataFrame (ordinal, pid, text) to (ordinal, pid, pos, vec),
one row per kept token. Real models are injected as a function over a list of
texts; it runs once per Arrow batch.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

#: Words whose vectors the stand-in remembers at most.
MOST_WORDS = 1 << 18

Encode = Callable[[list[str]], list[np.ndarray]]


def hashed_words(dim: int = 16, longest: int = 180) -> Encode:
    """A stand-in without a model: each word's vector is drawn from a generator seeded by the word."""
    import zlib

    at: dict[str, int] = {}
    held = [np.empty((1024, dim), np.float32)]

    def place(w: str) -> int:
        k = at.get(w)
        if k is None:
            k = at[w] = len(at)
            if k == len(held[0]):
                held[0] = np.concatenate([held[0], np.empty_like(held[0])])
            v = np.random.Generator(np.random.PCG64(zlib.crc32(w.encode()))).standard_normal(dim)
            held[0][k] = v / np.linalg.norm(v)
        return k

    def encode(texts: list[str]) -> list[np.ndarray]:
        if len(at) > MOST_WORDS:
            at.clear()
        places = [np.array([place(w) for w in t.split(None, longest)[:longest]], np.int64) for t in texts]
        return [held[0][k] for k in places]

    encode.most_tokens = 512
    return encode


def encoder(encode: Encode, batch: int = 32) -> Callable[[DataFrame], DataFrame]:
    """The DataFrame form of a function from texts to matrices; ``run`` is what it does to Arrow batches."""

    def run(batches):
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                mats = [np.asarray(m, np.float32) for m in encode([t or "" for t in part.column("text").to_pylist()])]
                n = [len(m) for m in mats]
                if not sum(n):
                    continue
                vecs = np.concatenate([m for m in mats if len(m)])
                doc = pa.array(np.repeat(np.arange(len(n)), n))
                pos = np.concatenate([np.arange(k) for k in n]).astype(np.int32)
                edges = np.arange(len(vecs) + 1, dtype=np.int32) * vecs.shape[1]
                yield pa.RecordBatch.from_arrays([part.column("ordinal").take(doc), part.column("pid").take(doc), pa.array(pos), pa.ListArray.from_arrays(edges, vecs.ravel())], ["ordinal", "pid", "pos", "vec"])

    def apply(collection: DataFrame) -> DataFrame:
        return collection.select("ordinal", "pid", "text").mapInArrow(run, "ordinal long, pid string, pos int, vec array<float>")

    apply.run = run
    return apply
