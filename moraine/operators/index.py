"""Compressed multi-vector index: sampling, centroids, codes, inversion, stages.

An index directory, on any file system Hadoop knows, holds Parquet tables that
are written stage by stage - ``centroids`` and ``parameters``; ``by_doc``, the
codes in the order of the documents; ``docs`` with lengths and first embeddings,
``codes``, the same codes in folders by ``cid`` modulo ``BUCKETS`` and sorted by
``cid`` there, and ``lists``, the inverted lists - and small JSON files with
fingerprint and last finished stage, one put in place after each stage. A build
with the same fingerprint goes on after its last stage; a finished one is left
alone; another fingerprint is an error unless the build starts afresh.

Centroids are sent to tasks in blocks of a checked size; with more than one
block the best of each are compared, so any number of centroids will do. Beyond
``DIRECT`` of them they are learned in two levels.
"""

from __future__ import annotations

import hashlib
import json
import math
from collections.abc import Callable

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import codec, vectors
from ..runtime import discard, file_system, materialize, put_text, width

STAGES = ("centroids", "codes", "lists", "complete")
#: Centroids are sent to every task in blocks: so many at most, and so many bytes of them.
MOST_CENTROIDS, MOST_CENTROID_BYTES = 1 << 19, 256 << 20
#: So many centroids are one block whatever their dimension (up to 4,096).
FEW = 8_192
#: Centroids learned by one model on the driver at most; more are learned in two levels.
DIRECT = 1 << 10
#: Folders of the codes by centroid.
BUCKETS = 64
#: Different vectors whose codes a task remembers at most.
MOST_HELD = 1 << 17
#: How tables of a row a token are written: sorted numbers by their differences, few values by their places.
DENSE = {"compression": "zstd", "parquet.writer.version": "v2", "parquet.dictionary.page.size": str(8 << 20)}


def n_centroids(n_vectors: float) -> int:
    """The power of two at or under 16 times the root of the number of vectors."""
    return 1 << max(0, int(math.floor(math.log2(16 * math.sqrt(n_vectors))))) if n_vectors > 0 else 1


def n_centroids_column(n: Column) -> Column:
    return F.pow(F.lit(2.0), F.floor(F.log2(16 * F.sqrt(n)))).cast("long")


def n_sampled_docs(n_docs: int, fraction: float | None = None) -> int:
    """How many documents the centroids are learned from."""
    if fraction is not None:
        return max(1, int(n_docs * fraction))
    return min(n_docs, int(16 * math.sqrt(65 * n_docs)))


def mean_centroids(vecs: DataFrame, label: str = "label", vec: str = "vec") -> DataFrame:
    """``(cid, centroid)``: the mean vector of each label, rounded to six places."""
    m = vecs.select(F.col(label).alias("cid"), F.posexplode(vec).alias("d", "x")).groupBy("cid", "d").agg(F.round(F.avg(F.col("x").cast("double")), 6).alias("m"))
    return m.groupBy("cid").agg(F.array_sort(F.collect_list(F.struct("d", "m")))["m"].alias("centroid"))  # one entry per dimension


def _means(sample: DataFrame, k: int, iterations: int, seed: int, vec: str, weight: str | None = None) -> list[tuple[int, list[float]]]:
    from pyspark.ml.clustering import KMeans
    from pyspark.ml.functions import array_to_vector

    rows = sample.select(array_to_vector(F.transform(vec, lambda x: x.cast("double"))).alias("features"), *([F.col(weight).cast("double").alias("weight")] if weight else []))
    means = KMeans(k=k, maxIter=iterations, seed=seed, initMode="k-means||", **({"weightCol": "weight"} if weight else {}))
    return [(i, [float(x) for x in c]) for i, c in enumerate(means.fit(rows).clusterCenters())]


def lloyd(x: np.ndarray, k: int, iterations: int, seed: int, weights: np.ndarray | None = None) -> np.ndarray:
    """Plain k-means of a matrix whose rows stand for so many vectors, started at distinct rows; at most as many centroids as rows."""
    rng = np.random.default_rng(seed)
    w = np.ones(len(x)) if weights is None else np.asarray(weights, np.float64)
    first = rng.permutation(len(x))[:k] if weights is None else np.argsort(rng.exponential(size=len(x)) / w)[:k]
    c = x[np.sort(first)].astype(np.float64)
    if weights is not None and len(x) <= k:
        return c  # different rows, each its own mean
    for _ in range(iterations):
        near = np.concatenate([(((c * c).sum(1)[None] - 2 * x[lo : lo + 4096] @ c.T).argmin(1)) for lo in range(0, len(x), 4096)])
        n = np.bincount(near, w, minlength=len(c))
        total = np.stack([np.bincount(near, x[:, d] * w, len(c)) for d in range(x.shape[1])], 1)
        c = np.where(n[:, None] > 0, total / np.where(n > 0, n, 1)[:, None], c)
    return c


def kmeans_centroids(sample: DataFrame, k: int, iterations: int = 10, seed: int = 42, vec: str = "vec", direct: int = DIRECT) -> DataFrame:
    """``(cid, centroid)`` by distributed k-means over a sample; at most as many as there are different vectors.

    Where there are no more different vectors than centroids, they are the
    centroids. Beyond ``direct`` centroids equal vectors are counted once, with
    their number as weight; they are cut into about as many clusters as the root of
    ``k``, and each of these is cut again in a task of its own, which holds the
    cluster's share of the different vectors.
    """
    from .ordinals import dense_ordinal

    spark = sample.sparkSession
    if k <= direct and sample.select(vec).distinct().limit(k + 1).count() > k:
        return spark.createDataFrame(_means(sample, k, iterations, seed, vec), "cid int, centroid array<double>")
    counts = materialize(sample.groupBy(F.col(vec).alias("vec")).agg(F.count("*").alias("weight")), "different", options=DENSE)
    if counts.count() <= k:
        return dense_ordinal(counts, ["vec"], "cid").select(F.col("cid").cast("int").alias("cid"), F.col("vec").cast("array<double>").alias("centroid"))
    coarse = 1 << math.ceil(math.log2(math.sqrt(k)))
    fine = -(-k // coarse)
    top = spark.createDataFrame(_means(counts, coarse, iterations, seed, "vec", "weight"), "cid int, centroid array<double>")
    placed = ranked_centroids(counts, top, 1, ["vec"], with_centroid=False).select("cid", "vec", "weight")

    def cut(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        c = lloyd(np.array(pdf["vec"].tolist(), np.float64), fine, iterations, seed + int(key[0]), pdf["weight"].to_numpy())
        return pd.DataFrame({"cid": int(key[0]) * fine + np.arange(len(c)), "centroid": list(c)})

    return placed.groupBy("cid").applyInPandas(cut, "cid int, centroid array<double>")


def centroid_blocks(centroids: DataFrame) -> int:
    """Blocks in which the centroids are sent to tasks."""
    n, dim = centroids.agg(F.count("*"), F.max(F.size("centroid"))).first()
    return max(1, -(-n // MOST_CENTROIDS), -(-n * (dim or 0) * 8 // MOST_CENTROID_BYTES))


def held_centroids(centroids: DataFrame, block: int = 0, blocks: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Ids and matrix of one block of the centroids, in order of id."""
    return _matrix(centroids.where(F.pmod("cid", F.lit(blocks)) == block).select("cid", "centroid").toArrow())  # blocks are made such that this is bounded


def _matrix(c: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    c = c.sort_by("cid").combine_chunks()
    return c["cid"].to_numpy().astype(np.int64), matrix(c["centroid"].combine_chunks()).astype(np.float64)


def matrix(lists: pa.Array) -> np.ndarray:
    """The rows of an array of lists of one length."""
    if isinstance(lists, pa.ChunkedArray):
        lists = pa.concat_arrays(lists.chunks) if lists.num_chunks else pa.array([], lists.type)
    if not len(lists):
        return np.empty((0, 0))
    sizes = lists.value_lengths()
    if lists.null_count or len(sizes.unique()) > 1:
        raise ValueError("vectors must be there and of one length")
    return lists.flatten().to_numpy(zero_copy_only=False).reshape(len(lists), -1)


def byte_rows(column: pa.Array) -> np.ndarray:
    """The rows of an array of byte strings of one length."""
    if not len(column):
        return np.empty((0, 0), np.uint8)
    edges = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    if len(np.unique(np.diff(edges))) > 1:
        raise ValueError("codes must be of one length")
    return np.frombuffer(column.buffers()[2] or b"", np.uint8)[edges[0] : edges[-1]].reshape(len(column), -1)


def as_bytes(rows: np.ndarray) -> pa.Array:
    """Byte strings from the rows of a matrix."""
    rows = np.ascontiguousarray(rows, np.uint8)
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer(np.arange(len(rows) + 1, dtype=np.int32) * rows.shape[1]), pa.py_buffer(rows.tobytes())])


def different(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of the first of each different row, and which of these each row is like, bit by bit."""
    bits = np.ascontiguousarray(x)
    bits = bits.view(np.uint32 if bits.itemsize == 4 else np.uint64)
    odd = np.random.default_rng(1).integers(1 << 63, size=bits.shape[1], dtype=np.uint64) * np.uint64(2) + np.uint64(1)
    which, _ = pd.factorize((bits.astype(np.uint64) * odd).sum(1, dtype=np.uint64))
    first = np.empty(which.max(initial=-1) + 1, np.int64)
    first[which[::-1]] = np.arange(len(x))[::-1]
    if not np.array_equal(bits[first][which], bits):  # two that share a hash
        _, first, which = np.unique(bits, axis=0, return_index=True, return_inverse=True)
    return first, which.ravel()


def few_centroids(centroids: DataFrame) -> tuple[np.ndarray, np.ndarray] | None:
    """Ids and matrix where there are ``FEW`` centroids at most, read by one job; else none, and they are counted first."""
    few = min(FEW, MOST_CENTROIDS)
    c = centroids.select("cid", "centroid").limit(few + 1).toArrow()
    return _matrix(c) if c.num_rows <= few else None


def tile(mat: np.ndarray) -> int:
    """Vectors a product is taken of at a time, such that it has a million cells at most."""
    return max(1, 1_000_000 // max(1, len(mat)))


def nearest(x: np.ndarray, mat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Rows of ``mat`` with the largest products with each row of ``x``, and the products; of equal ones the lower row comes first."""
    sim = x @ mat.T
    if k == 1:
        top = sim.max(1)
        # The first within a rounding of the best; where it is rounded to less, all are rounded.
        best = (sim >= (top - 2e-6)[:, None]).argmax(1)
        top = np.round(top, 6)
        for i in np.flatnonzero(np.round(sim[np.arange(len(sim)), best], 6) != top):
            best[i] = np.round(sim[i], 6).argmax()
        return best[:, None], top[:, None]
    sim = np.round(sim, 6)
    best = np.argsort(-sim, axis=1, kind="stable")[:, :k]
    return best, np.take_along_axis(sim, best, 1)


def nearest_once(x: np.ndarray, mat: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """``nearest``, looked for once for equal rows and by tiles."""
    first, which = different(x)
    x, step = x[first].astype(np.float64), tile(mat)
    got = [nearest(x[lo : lo + step], mat, k) for lo in range(0, len(x), step)]
    return np.concatenate([b for b, _ in got])[which], np.concatenate([s for _, s in got])[which]


def ranked_centroids(vecs: DataFrame, centroids: DataFrame, keep: int, by: list[str], vec: str = "vec", with_centroid: bool = True) -> DataFrame:
    """``vecs`` with the ``keep`` centroids of largest dot product with each vector (cid, sim, probe, centroid), ties to the lower id.

    Matrix products over Arrow batches; one narrow pass for each block of
    centroids. ``by`` names a vector.
    """
    cols = [f for f in vecs.schema.fields if f.name not in ("cid", "sim", "probe", "centroid")]
    names = [f.name for f in cols]
    if not set(by) <= set(names):
        raise ValueError(f"{by} must name columns of the vectors")
    kind = centroids.schema["cid"].dataType.simpleString()
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in cols) + f", cid {kind}, sim double, probe int" + ", centroid array<double>" * with_centroid
    number = {"tinyint": pa.int8(), "smallint": pa.int16(), "int": pa.int32()}.get(kind, pa.int64())
    small = few_centroids(centroids)
    blocks = 1 if small else centroid_blocks(centroids)

    def one(block: int) -> DataFrame:
        held = vecs.sparkSession.sparkContext.broadcast(small or held_centroids(centroids, block, blocks))

        def run(batches):
            ids, mat = held.value
            k, step = min(keep, len(ids)), max(1, 4_000_000 // max(1, mat.size))
            for batch in batches:
                if not k or not batch.num_rows:
                    continue
                all_best, all_sim = nearest_once(matrix(batch.column(vec)).astype(np.float64), mat, k)
                for lo in range(0, batch.num_rows, step):
                    part, best, sim = batch.slice(lo, step), all_best[lo : lo + step].ravel(), all_sim[lo : lo + step].ravel()
                    row = pa.array(np.repeat(np.arange(part.num_rows), k))
                    out = [part.column(n).take(row) for n in names] + [pa.array(ids[best]).cast(number), pa.array(sim), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), part.num_rows))]
                    if with_centroid:
                        out.append(pa.ListArray.from_arrays(np.arange(len(best) + 1, dtype=np.int32) * mat.shape[1], mat[best].ravel()))
                    yield pa.RecordBatch.from_arrays(out, [*names, "cid", "sim", "probe", "centroid"][: len(out)])

        return vecs.select(*names).mapInArrow(run, schema)

    out = one(0)
    for block in range(1, blocks):
        out = out.unionByName(one(block))
    if blocks > 1:
        w = Window.partitionBy(*by).orderBy(F.desc("sim"), "cid")
        out = out.withColumn("probe", F.row_number().over(w)).where(F.col("probe") <= keep)
    return out


def encode(vecs: DataFrame, centroids: DataFrame, parameters: DataFrame, nbits: int, vec: str = "vec") -> DataFrame:
    """``vecs`` with ``cid`` and ``packed``, by matrix products over Arrow batches.

    A vector that a task has met before keeps its code. Centroids and codec
    parameters go to every task; where the centroids are
    more than one block, the nearest are found block by block and the codes by
    column expressions. The other columns must then name a vector.
    """
    codec.check_bits(nbits)
    cols = [f for f in vecs.schema.fields if f.name != vec]
    small = few_centroids(centroids)
    if not small and centroid_blocks(centroids) > 1:
        near = ranked_centroids(vecs, centroids, 1, [f.name for f in cols], vec)
        near = near.withColumn("boundaries", parameters.select("boundaries").scalar())
        codes = codec.quantize(vectors.minus(F.col(vec), F.col("centroid")), F.col("boundaries"))
        packed = F.unhex(F.array_join(F.transform(codec.pack(codes, nbits), lambda x: F.lpad(F.hex(x), 2, "0")), ""))
        return near.select(*[f.name for f in cols], F.col("cid").cast("int").alias("cid"), packed.alias("packed"))
    schema = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in cols) + ", cid int, packed binary"
    return vecs.mapInArrow(_encoding(vecs.sparkSession, small or held_centroids(centroids), parameters, nbits, [f.name for f in cols], vec), schema)


def encode_texts(collection: DataFrame, encoder: Callable[[DataFrame], DataFrame], centroids: DataFrame, parameters: DataFrame, nbits: int) -> DataFrame:
    """Codes (ordinal, pid, pos, cid, packed) of texts (ordinal, pid, text); vectors stay in the task's Python where the encoder has a ``run``."""
    small = few_centroids(centroids) if hasattr(encoder, "run") else None
    if not hasattr(encoder, "run") or not small and centroid_blocks(centroids) > 1:
        return encode(encoder(collection), centroids, parameters, nbits)
    code, make = _encoding(collection.sparkSession, small or held_centroids(centroids), parameters, nbits, ["ordinal", "pid", "pos"], "vec"), encoder.run
    return collection.select("ordinal", "pid", "text").mapInArrow(lambda batches: code(make(batches)), "ordinal long, pid string, pos int, cid int, packed binary")


def _encoding(spark: SparkSession, centroids: tuple[np.ndarray, np.ndarray], parameters: DataFrame, nbits: int, cols: list[str], vec: str) -> Callable:
    """From Arrow batches of vectors to such of their codes."""
    per = 8 // codec.check_bits(nbits)
    p = parameters.select("boundaries").first()
    held = spark.sparkContext.broadcast((*centroids, np.array(p["boundaries"], np.float64)))

    def codes_of(x: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids, mat, edges = held.value
        cids, packs = [], []
        for lo in range(0, len(x), step := tile(mat)):
            part = x[lo : lo + step].astype(np.float64)
            best = nearest(part, mat, 1)[0][:, 0]
            codes = ((part - mat[best])[:, :, None] > edges[None]).sum(2)
            codes = np.pad(codes, ((0, 0), (0, -codes.shape[1] % per)))
            shift = (np.arange(per) * nbits)[None, None]
            cids.append(ids[best])
            packs.append((codes.reshape(len(part), -1, per) << shift).sum(2).astype(np.uint8))
        return np.concatenate(cids).astype(np.int32), np.concatenate(packs)

    def run(batches):
        at: dict[bytes, int] = {}
        for batch in batches:
            if not batch.num_rows:
                continue
            x = matrix(batch.column(vec))
            first, which = different(x)
            keys = [r.tobytes() for r in x[first]]
            if not at or len(at) > MOST_HELD:
                at, cids, packs = {}, np.empty(0, np.int32), None
            new = [i for i, key in enumerate(keys) if key not in at]
            if new:
                base = len(at)
                at.update((keys[i], base + n) for n, i in enumerate(new))
                c, p = codes_of(x[first[new]])
                cids, packs = np.concatenate([cids, c]), p if packs is None else np.concatenate([packs, p])
            own = np.array([at[key] for key in keys])[which]
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in cols], pa.array(cids[own]), as_bytes(packs[own])], [*cols, "cid", "packed"])

    return run


def decode(codes: DataFrame, centroids: DataFrame, parameters: DataFrame, nbits: int) -> DataFrame:
    """``codes`` with ``vec``: centroid plus the values of the codes, not scaled again."""
    dim = F.size("centroid")
    per = 8 // codec.check_bits(nbits)
    byte = F.transform(F.sequence(F.lit(1), F.length("packed")), lambda k: F.conv(F.hex(F.substring("packed", k, F.lit(1))), 16, 10).cast("int"))
    unpacked = F.flatten(F.transform(byte, lambda b: F.array(*[F.shiftright(b, j * nbits).bitwiseAND((1 << nbits) - 1) for j in range(per)])))
    j = codes.join(centroids, "cid").withColumn("bucket_values", parameters.select("bucket_values").scalar())
    value = codec.dequantize(F.slice(unpacked, F.lit(1), dim), F.col("bucket_values"))
    return j.withColumn("vec", vectors.plus(F.col("centroid"), value)).drop("centroid", "bucket_values")


def code_cosines(collection: DataFrame, by_doc: DataFrame, encode: Callable[[list[str]], list[np.ndarray]], centroids: DataFrame, parameters: DataFrame, nbits: int, batch: int = 32) -> DataFrame:
    """``(pid, pos, cosine)``: cosine of each token's vector, encoded again, with what the codes by document give back.

    ``collection``: ordinal, pid, text. The codes of a document move to its
    text as byte strings; vectors never leave the task that makes them.
    """
    per = 8 // codec.check_bits(nbits)
    values = parameters.select("bucket_values").first()[0]
    held = collection.sparkSession.sparkContext.broadcast((*held_centroids(centroids), np.array(values, np.float64)))

    def run(batches):
        ids, mat, values = held.value
        dim = np.arange(mat.shape[1])
        for whole in batches:
            for lo in range(0, whole.num_rows, batch):
                part = whole.slice(lo, batch)
                mats = [np.asarray(m, np.float64).reshape(-1, len(dim)) for m in encode([t or "" for t in part.column("text").to_pylist()])]
                # A row of codes may hold a part of its document, or belong to another text of its name.
                pos = [np.frombuffer(b, np.int32) for b in part.column("pos").to_pylist()]
                there = np.concatenate([p < len(m) for m, p in zip(mats, pos)])
                pos = [p[p < len(m)] for m, p in zip(mats, pos)]
                n = [len(p) for p in pos]
                own = np.concatenate([m[p] for m, p in zip(mats, pos)])
                cid = np.searchsorted(ids, np.frombuffer(b"".join(part.column("cid").to_pylist()), np.int32))
                packed = np.frombuffer(b"".join(part.column("packed").to_pylist()), np.uint8).reshape(len(cid), -1)
                cid, packed = cid[there], packed[there]
                codes = ((packed[:, :, None] >> (np.arange(per) * nbits)[None, None]) & ((1 << nbits) - 1)).reshape(len(cid), packed.shape[1] * per)[:, : len(dim)]
                back = mat[cid] + values[dim[None], codes]
                size = np.sqrt((own * own).sum(1)) * np.sqrt((back * back).sum(1))
                cosine = np.round((own * back).sum(1) / np.maximum(size, 1e-12), 6)
                yield pa.RecordBatch.from_arrays([part.column("pid").take(pa.array(np.repeat(np.arange(len(n)), n))), pa.array(np.concatenate(pos)), pa.array(cosine)], ["pid", "pos", "cosine"])

    runs = doc_runs(by_doc).drop("ordinal")
    return collection.select("pid", "text").join(runs, "pid").select("pid", "text", "pos", "cid", "packed").mapInArrow(run, "pid string, pos int, cosine double")


def inverted_lists(codes: DataFrame, per_block: int = 1 << 20) -> DataFrame:
    """``(cid, block, emb_ids)``: ascending embedding ids by centroid, in blocks of bounded size."""
    kinds = {f.name: f.dataType.simpleString() for f in codes.schema.fields}

    def gather(batches):
        for batch in batches:
            cid, emb = (batch.column(c).to_numpy() for c in ("cid", "emb_id"))
            order = np.lexsort((emb, cid))
            cid, emb = cid[order], emb[order]
            block = emb // per_block
            edge = np.append(np.flatnonzero(np.append(True, (np.diff(cid) != 0) | (np.diff(block) != 0))), len(cid)) if len(cid) else np.zeros(1, np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(cid[edge[:-1]]), pa.array(block[edge[:-1]].astype(np.int64)), pa.ListArray.from_arrays(edge.astype(np.int32), emb)], ["cid", "block", "emb_ids"])

    some = codes.select("cid", "emb_id").where(F.col("cid").isNotNull() & F.col("emb_id").isNotNull()).mapInArrow(gather, f"cid {kinds['cid']}, block long, emb_ids array<{kinds['emb_id']}>")
    return some.groupBy("cid", "block").agg(F.array_sort(F.flatten(F.collect_list("emb_ids"))).alias("emb_ids"))


def list_totals(lists: DataFrame, span: int = 1 << 20, most: int = 64) -> DataFrame:
    """One row ``(n, n_different, least, greatest, n_unsorted)`` of inverted lists (emb_ids): entries, different ones, the least and the greatest, and lists out of order.

    Different entries are counted as bits, ``span`` entries to a string, which
    tasks put together for at most ``most`` spans at a time.
    """

    def mark(batches):
        bits: dict[int, np.ndarray] = {}
        n = unsorted = 0
        ends: list[int] = []
        sums = lambda: pa.RecordBatch.from_arrays([pa.array([None], pa.int64()), pa.array([None], pa.binary()), pa.array([n]), pa.array([min(ends, default=None)], pa.int64()), pa.array([max(ends, default=None)], pa.int64()), pa.array([unsorted])], names)
        names = ["span", "bits", "n", "least", "greatest", "n_unsorted"]

        def flush():
            none = pa.nulls(len(bits), pa.int64())
            out = pa.RecordBatch.from_arrays([pa.array(list(bits), pa.int64()), pa.array([pa.compress(np.packbits(b).tobytes(), codec="zstd", asbytes=True) for b in bits.values()], pa.binary()), none, none, none, none], names)
            bits.clear()
            return out

        for batch in batches:
            lists = batch.column("emb_ids")
            e = lists.flatten().to_numpy().astype(np.int64)
            edge = np.append(0, np.cumsum(lists.value_lengths().fill_null(0).to_numpy()))
            n += len(e)
            if not len(e):
                continue
            ends[:] = [min([*ends, int(e.min())]), max([*ends, int(e.max())])]
            falls = np.append(0, np.cumsum(np.append(False, np.diff(e) < 0)))
            full = np.diff(edge) > 0
            unsorted += int((falls[edge[1:][full]] - falls[edge[:-1][full] + 1] > 0).sum())
            place = e // span
            order = np.argsort(place, kind="stable")
            e, place = e[order], place[order]
            cut = np.append(np.flatnonzero(np.append(True, np.diff(place) != 0)), len(e))
            for lo, hi in zip(cut[:-1], cut[1:]):
                k = int(place[lo])
                if k not in bits:
                    if len(bits) >= most:
                        yield flush()
                    bits[k] = np.zeros(span, bool)
                bits[k][e[lo:hi] - k * span] = True
        if bits:
            yield flush()
        yield sums()

    def count(pdf: pd.DataFrame) -> pd.DataFrame:
        have = np.zeros(span // 8, np.uint8)
        for b in pdf["bits"]:
            have |= np.frombuffer(pa.decompress(b, span // 8, "zstd", asbytes=True), np.uint8)
        return pd.DataFrame({"n_different": [int(np.unpackbits(have).sum())]})

    marks = materialize(lists.select("emb_ids").mapInArrow(mark, "span long, bits binary, n long, least long, greatest long, n_unsorted long"), "marks")
    each = marks.where("span IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("n"), F.min("least").alias("least"), F.max("greatest").alias("greatest"), F.sum("n_unsorted").alias("n_unsorted"))
    apart = marks.where("span IS NOT NULL").select("span", "bits").groupBy("span").applyInPandas(count, "n_different long")
    return each.crossJoin(F.broadcast(apart.agg(F.coalesce(F.sum("n_different"), F.lit(0)).alias("n_different")))).select("n", "n_different", "least", "greatest", "n_unsorted")  # one row


def doc_offsets(docs: DataFrame) -> DataFrame:
    """``(doc_idx, doclen, emb_start)``; running sums are taken over ranges of documents, then within each."""
    span = F.floor(F.col("doc_idx") / 100_000).cast("long")
    d = docs.select("doc_idx", "doclen").withColumn("span", span)
    before = d.groupBy("span").agg(F.sum("doclen").alias("n")).select("span", (F.sum("n").over(Window.orderBy("span")) - F.col("n")).alias("before"))  # a row per 100,000 documents
    w = Window.partitionBy("span").orderBy("doc_idx").rowsBetween(Window.unboundedPreceding, 0)
    return d.withColumn("upto", F.sum("doclen").over(w)).join(before, "span").select("doc_idx", "doclen", (F.col("before") + F.col("upto") - F.col("doclen")).alias("emb_start"))


def shard_edges(offsets: DataFrame, shards: int) -> DataFrame:
    """``(shard, first_doc)``: for each shard the first document that begins at or after its share of all embeddings.

    ``offsets``: dense doc_idx, doclen, emb_start. Shard k wants embedding
    floor(k total / shards). A document knows from where it begins and ends
    which shards' wishes fall between, and that these begin at the next one.
    """
    total = offsets.agg(F.coalesce(F.max(F.col("emb_start") + F.col("doclen")), F.lit(0)).alias("total"), F.min("doc_idx").alias("least"))

    def wishes_upto(at: Column) -> Column:
        """The last shard whose wish is at or before an embedding."""
        return F.least(F.lit(shards - 1), F.ceil((at + 1) * shards / F.greatest(F.col("total"), F.lit(1))).cast("long") - 1)

    o = offsets.crossJoin(F.broadcast(total))  # one row
    ends = o.select("doc_idx", wishes_upto(F.col("emb_start")).alias("a"), wishes_upto(F.col("emb_start") + F.col("doclen")).alias("b")).where("b > a")
    inner = ends.select(F.explode(F.sequence((F.col("a") + 1).cast("int"), F.col("b").cast("int"))).alias("shard"), (F.col("doc_idx") + 1).alias("first_doc"))
    start = total.where(F.col("least").isNotNull()).select(F.explode(F.sequence(F.lit(0), F.least(F.lit(shards - 1), F.ceil(F.lit(shards) / F.greatest(F.col("total"), F.lit(1))).cast("int") - 1))).alias("shard"), F.col("least").alias("first_doc"))
    return start.unionByName(inner)


def fingerprint(settings: dict, collection: DataFrame) -> str:
    """Hash of settings and content: the number of rows and the sum of their hashes."""
    n, s = collection.agg(F.count("*"), F.sum(F.pmod(F.xxhash64("pid", "text"), F.lit(1 << 31)))).first()
    return hashlib.sha256(json.dumps({**settings, "rows": n, "content": s}, sort_keys=True).encode()).hexdigest()


def _state(path: str) -> dict:
    """The last state put in place, or none."""
    spark = SparkSession.active()
    fs, at = file_system(spark, path)
    if not fs.exists(at):
        return {}
    names = sorted(n for f in fs.listStatus(at) if (n := f.getPath().getName()).startswith("state-") and n.endswith(".json"))
    return json.loads(spark.read.text(f"{path}/{names[-1]}", wholetext=True).first()[0]) if names else {}


def _set_state(path: str, **state) -> None:
    """Put a new state in place: files are numbered and get their names when complete."""
    spark = SparkSession.active()
    fs, at = file_system(spark, path)
    fs.mkdirs(at)
    last = max([int(n[6:-5]) for f in fs.listStatus(at) if (n := f.getPath().getName()).startswith("state-") and n.endswith(".json")], default=0)
    put_text(spark, f"{path}/state-{last + 1:08d}.json", json.dumps(state))


def learn(vecs: DataFrame, k: int, nbits: int, path: str, iterations: int = 10, seed: int = 42, residual_sample: int = 100_000, dim: int = 1, trainer: Callable[..., DataFrame] = kmeans_centroids) -> None:
    """Write ``centroids`` and ``parameters`` learned from sampled vectors (pid, pos, vec)."""
    from .ordinals import sample_exact

    spark = vecs.sparkSession
    if vecs.isEmpty():
        spark.createDataFrame([(0, [0.0] * dim)], "cid int, centroid array<double>").write.mode("overwrite").parquet(f"{path}/centroids")
        parameters = spark.createDataFrame([codec.uniform_parameters(dim, nbits)], "boundaries array<array<double>>, bucket_values array<array<double>>")
    else:
        trainer(vecs, k, iterations, seed).write.mode("overwrite").parquet(f"{path}/centroids")
        few = sample_exact(vecs.withColumn("key", F.concat_ws("#", "pid", "pos")), "key", residual_sample, seed)
        near = ranked_centroids(few, spark.read.parquet(f"{path}/centroids"), 1, ["key"])
        parameters = codec.as_arrays(codec.quantile_parameters(near.select(vectors.minus(F.col("vec"), F.col("centroid")).alias("residual")), nbits))
    parameters.write.mode("overwrite").parquet(f"{path}/parameters")


def write_codes(vecs: DataFrame, path: str, nbits: int) -> None:
    """Write ``by_doc`` from vectors (ordinal, pid, pos, vec), in one narrow pass; positions count from 0."""
    spark = vecs.sparkSession
    _write_codes(encode(vecs, spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/parameters"), nbits), path)


def _write_codes(codes: DataFrame, path: str) -> None:
    codes.write.mode("overwrite").options(**DENSE).parquet(f"{path}/by_doc")


def doc_runs(by_doc: DataFrame) -> DataFrame:
    """``(ordinal, pid, pos, cid, packed)``: a row for tokens of a document that follow one another in the codes by document, with byte strings of their positions, centroids and codes."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            ordinal = batch.column("ordinal").to_numpy()
            pos, cid = (batch.column(c).to_numpy().astype(np.int32) for c in ("pos", "cid"))
            packed = byte_rows(batch.column("packed"))
            edge = np.append(np.flatnonzero(np.append(True, np.diff(ordinal) != 0)), len(ordinal))
            parts = [[a[lo:hi].tobytes() for lo, hi in zip(edge[:-1], edge[1:])] for a in (pos, cid, packed)]
            yield pa.RecordBatch.from_arrays([batch.column("ordinal").take(pa.array(edge[:-1])), batch.column("pid").take(pa.array(edge[:-1])), *[pa.array(p, pa.binary()) for p in parts]], ["ordinal", "pid", "pos", "cid", "packed"])

    return by_doc.select("ordinal", "pid", "pos", "cid", "packed").mapInArrow(run, "ordinal long, pid string, pos binary, cid binary, packed binary")


def _squeezed(a: np.ndarray) -> bytes:
    """Numbers as compressed bytes, the first bytes of all before the second ones."""
    return pa.compress(a.view(np.uint8).reshape(len(a), -1).T.tobytes(), codec="zstd", asbytes=True)


def _loosened(b: bytes, n: int, kind: type) -> np.ndarray:
    size = np.dtype(kind).itemsize
    return np.frombuffer(pa.decompress(b, n * size, "zstd", asbytes=True), np.uint8).reshape(size, n).T.copy().view(kind).ravel()


def _by_centroid(runs: DataFrame, salts: int) -> DataFrame:
    """Tokens of runs of documents (ordinal, emb_start, pos, cid, packed) put together by centroid, batch by batch."""

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            pos, cid = (np.frombuffer(b"".join(batch.column(c).to_pylist()), np.int32) for c in ("pos", "cid"))
            n = np.array([len(x) // 4 for x in batch.column("pos").to_pylist()])
            packed = np.frombuffer(b"".join(batch.column("packed").to_pylist()), np.uint8).reshape(len(pos), -1)
            ordinal, start = (np.repeat(batch.column(c).to_numpy(), n) for c in ("ordinal", "emb_start"))
            emb = start + pos
            order = np.lexsort((emb, cid))
            ordinal, emb, pos, cid, packed = ordinal[order], emb[order], pos[order], cid[order], packed[order]
            edge = np.append(np.flatnonzero(np.append(True, np.diff(cid) != 0)), len(cid))
            at = cid[edge[:-1]]
            cols = [[_squeezed(a[lo:hi]) for lo, hi in zip(edge[:-1], edge[1:])] for a in (ordinal, emb, pos)]
            codes = [pa.compress(np.ascontiguousarray(packed[lo:hi].T).tobytes(), codec="zstd", asbytes=True) for lo, hi in zip(edge[:-1], edge[1:])]
            salt = ((emb[edge[:-1]].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(33)).astype(np.int64) % salts
            yield pa.RecordBatch.from_arrays([pa.array((at % BUCKETS).astype(np.int32)), pa.array(salt.astype(np.int32)), pa.array(at), pa.array(np.diff(edge).astype(np.int32)), pa.array(np.full(len(at), packed.shape[1], np.int32)), *[pa.array(c, pa.binary()) for c in (*cols, codes)]], ["bucket", "salt", "cid", "n", "width", "ordinal", "emb_id", "pos", "packed"])

    return runs.select("ordinal", "emb_start", "pos", "cid", "packed").mapInArrow(run, "bucket int, salt int, cid int, n int, width int, ordinal binary, emb_id binary, pos binary, packed binary")


def _tokens(chunks: DataFrame) -> DataFrame:
    """What ``_by_centroid`` put together, a row a token again, in the same order."""

    def run(batches):
        for batch in batches:
            rows, lo = batch.to_pylist(), 0
            while lo < len(rows):
                hi, size = lo, 0
                while hi < len(rows) and (hi == lo or size + rows[hi]["n"] <= 100_000):
                    size, hi = size + rows[hi]["n"], hi + 1
                part, lo = rows[lo:hi], hi
                n = [r["n"] for r in part]
                ordinal, emb, pos = (np.concatenate([_loosened(r[c], r["n"], kind) for r in part]) for c, kind in (("ordinal", np.int64), ("emb_id", np.int64), ("pos", np.int32)))
                packed = np.concatenate([np.frombuffer(pa.decompress(r["packed"], r["n"] * r["width"], "zstd", asbytes=True), np.uint8).reshape(r["width"], r["n"]).T for r in part])
                cid, bucket = (np.repeat(np.array([r[c] for r in part], np.int32), n) for c in ("cid", "bucket"))
                yield pa.RecordBatch.from_arrays([pa.array(ordinal), pa.array(pos), pa.array(cid), as_bytes(packed), pa.array(emb), pa.array(bucket)], ["ordinal", "pos", "cid", "packed", "emb_id", "bucket"])

    return chunks.mapInArrow(run, "ordinal long, pos int, cid int, packed binary, emb_id long, bucket int")


def write_lists(collection: DataFrame, path: str) -> None:
    """Write ``docs``, ``codes`` and ``lists`` from ``by_doc``. ``collection``: ordinal, pid.

    Tokens move as byte strings, by document to their first embedding and by
    centroid to their folder.
    """
    spark = collection.sparkSession
    by_doc = spark.read.parquet(f"{path}/by_doc")
    lens = by_doc.groupBy("ordinal").agg(F.count("*").alias("doclen"))
    docs = collection.select("ordinal", "pid").join(lens, "ordinal", "left").select("ordinal", "pid", F.coalesce("doclen", F.lit(0)).alias("doclen"))
    starts = doc_offsets(docs.select(F.col("ordinal").alias("doc_idx"), "doclen")).select(F.col("doc_idx").alias("ordinal"), "emb_start")
    docs.join(starts, "ordinal").write.mode("overwrite").parquet(f"{path}/docs")
    starts = spark.read.parquet(f"{path}/docs").select("ordinal", "emb_start")
    # As many files of a bucket as the shuffle is wide, so that no task writes a whole bucket of a large index.
    placed = _by_centroid(doc_runs(by_doc).join(starts, "ordinal"), max(1, width(spark) // BUCKETS))
    placed = placed.repartition("bucket", "salt").sortWithinPartitions("bucket", "cid")
    _tokens(placed).sortWithinPartitions("bucket", "cid", "ordinal", "pos").write.mode("overwrite").options(**DENSE).partitionBy("bucket").parquet(f"{path}/codes")
    inverted_lists(read_codes(spark, path).select("cid", "emb_id")).write.mode("overwrite").options(**DENSE).parquet(f"{path}/lists")


def read_codes(spark: SparkSession, path: str) -> DataFrame:
    """``codes`` of an index, which has no folder at all where there are no tokens."""
    return spark.read.schema("ordinal long, pos int, cid int, packed binary, emb_id long, bucket int").parquet(f"{path}/codes")


def build_index(spark: SparkSession, collection: DataFrame, encoder: Callable[[DataFrame], DataFrame], path: str, nbits: int = 2, fraction: float | None = None, seed: int = 42, iterations: int = 10, residual_sample: int = 100_000, resume: bool = True, settings: dict | None = None, trainer: Callable[..., DataFrame] = kmeans_centroids) -> dict:
    """Build (or go on building) the index of a collection in a shared directory.

    ``collection``: ordinal, pid, text. ``encoder`` maps it to ordinal, pid,
    pos, vec - one row per kept token; ``trainer(vectors, k, iterations, seed)``
    gives the centroids. Returns the index's metadata.
    """
    from .ordinals import sample_exact

    mark = fingerprint({"nbits": nbits, "seed": seed, "fraction": fraction, **(settings or {})}, collection)
    state = _state(path)
    if resume and state and state["fingerprint"] != mark:
        raise ValueError("the directory holds an index of other data or settings; build afresh with resume=False")
    done = state.get("stage") if resume else None
    if done == "complete":
        return state["metadata"]
    if done is None:
        n = collection.count()
        few = n_sampled_docs(n, fraction)
        sample = materialize(encoder(sample_exact(collection, "pid", few, seed)).select("pid", "pos", "vec"), "sample", options=DENSE)
        rows = sample.count()
        k = max(1, min(n_centroids(max(1, rows) / max(1, min(n, few)) * n), rows))
        learn(sample, k, nbits, path, iterations, seed, residual_sample, int((settings or {}).get("dim", 1)), trainer)
        discard(sample)
        _set_state(path, fingerprint=mark, stage="centroids")
        done = "centroids"
    if done == "centroids":
        _write_codes(encode_texts(collection, encoder, spark.read.parquet(f"{path}/centroids"), spark.read.parquet(f"{path}/parameters"), nbits), path)
        _set_state(path, fingerprint=mark, stage="codes")
        done = "codes"
    if done == "codes":
        write_lists(collection, path)
        _set_state(path, fingerprint=mark, stage="lists")
    n_emb, n_docs = spark.read.parquet(f"{path}/by_doc").count(), spark.read.parquet(f"{path}/docs").count()
    k, dim = spark.read.parquet(f"{path}/centroids").agg(F.count("*"), F.max(F.size("centroid"))).first()
    meta = {"n_docs": n_docs, "n_embeddings": n_emb, "n_centroids": k, "dim": dim, "nbits": nbits, "bytes_per_vector": codec.bytes_per_vector(dim, nbits)}
    _set_state(path, fingerprint=mark, stage="complete", metadata=meta)
    return meta
