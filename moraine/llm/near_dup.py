"""Near-duplicate texts (problem 1).

Each distinct set of word shingles gets a fingerprint of 128 bits, one bit of
each of 128 minima, such that two texts of similarity J differ in about
``(1 - J) / 2`` of the bits. Close fingerprints are found by a binary trie
self-join: the trie of all fingerprints is traversed in pairs of nodes, each
step down adds the differing bit to the pair's errors, and a pair of nodes is
pruned as soon as its errors exceed the Hamming budget of its depth (what a pair
at the least similarity has there, with ``SPARE`` deviations to spare). Paths
without branches are compressed: two single leaves are compared by what is left
of their bits at once. Pairs that survive are verified on the shingles.

The trie is cut for distribution by a prefix with no error to spend: the first
``GROUP`` of the minima themselves, in ``TABLES`` rotations (each with minima of
its own), so that every pair of texts that shares a root is met in the trie
under it and nowhere else. A pair of similarity 0.6 shares some root with
probability 0.9971, of 0.65 with 0.9995, of 0.75 with 0.999998. Roots holding
more than ``most`` texts are split into blocks and every pair of blocks becomes
a task of its own, so no root is ever gathered in one task, and nothing is
dropped.

Verification compares the sets of shingles as 32-bit hashes inside the JVM, off
by n / 2^32 at most. Each text's set is computed once; of a pair the text with
more partners stays where it is and the other one is sent to it, so a text with
many partners is not copied for each.

Equal shingle sets are one text to the join; membership in such classes is
kept aside, and copies are never compared.

Defined cases: null texts and texts of fewer words than a shingle have no
shingles and are in no pair; identical texts under several ids form one class;
repeated rows count once, and of an id
delivered with different texts one (of the least hash); words are case-folded runs of letters and digits; an
empty table gives an empty result.
"""

from __future__ import annotations

import itertools
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import discard, materialize, width
from .text import WORD, HashOf, hashes, mix

BITS, GROUP, TABLES = 128, 3, 24
#: Deviations beyond the mean number of differing bits at the least similarity, at which a pair is pruned.
SPARE = 3.6
_RNG = np.random.Generator(np.random.PCG64(20240229))
_A = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_B = _RNG.integers(0, 1 << 63, BITS, dtype=np.uint64)
_K = [np.uint64(k) for k in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)]
_SHIFT = np.arange(64, dtype=np.uint64)[::-1]


def budgets(least: float) -> np.ndarray:
    """Differing bits at which a pair is pruned, after each number of bits from 0 to all."""
    p = (1 - least) / 2
    d = np.arange(BITS + 1)
    return np.ceil(d * p + SPARE * np.sqrt(d * p * (1 - p))).astype(np.int64)


def budget(least: float) -> int:
    """Differing bits of all at which a pair is pruned: 42 for a similarity of 0.6, where the mean is 25.6."""
    return int(budgets(least)[BITS])


def shingles(text: str, known: HashOf, size: int = 3) -> np.ndarray:
    """Distinct hashes of all runs of ``size`` words, rising."""
    words = WORD.findall(text.lower())
    if len(words) < size:
        return np.zeros(0, np.uint64)
    h = hashes(words, known)
    n = len(h) - size + 1
    s = np.zeros(n, np.uint64)
    for k in range(size):
        s = mix((s ^ h[k : k + n]) * _K[0] + _K[1])
    return np.unique(s)


def signature(s: np.ndarray) -> tuple[np.ndarray, int, int]:
    """The minima of a set of hashes under the fixed functions, and the fingerprint in two halves."""
    least = np.full(BITS, ~np.uint64(0))
    for lo in range(0, len(s), 8192):
        least = np.minimum(least, (_A[:, None] * s[None, lo : lo + 8192] + _B[:, None]).min(1))
    m = mix(least)
    bits = m >> np.uint64(63)
    half = [(bits[k : k + 64] << _SHIFT).sum(dtype=np.uint64) for k in (0, 64)]
    return m, half[0], half[1]


def names(s: np.ndarray) -> tuple[np.uint64, np.uint64, np.uint64]:
    """Two hashes that name a set of hashes, and one of both."""
    c1, c2 = s.sum(dtype=np.uint64) + np.uint64(len(s)), np.bitwise_xor.reduce(mix(s ^ _K[0]))
    return c1, c2, mix(np.array([c1]) ^ mix(np.array([c2])))[0]


def signed(docs: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(id, c1, c2, key, f1, f2, roots)`` per row with shingles; c1 and c2 name the shingle set, key is their hash."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.col("id").isNotNull() & (F.length("text") > 0))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = HashOf()
        table = np.arange(TABLES, dtype=np.uint64)
        for pdf in batches:
            rows = []
            for key, text in zip(pdf["id"], pdf["text"]):
                s = shingles(text, known, size)
                if not len(s):
                    continue
                m, f1, f2 = signature(s)
                roots = table
                for k in range(GROUP):
                    roots = mix(roots * _K[2] ^ m[k : GROUP * TABLES : GROUP])
                c = np.array([*names(s), f1, f2]).astype(np.int64)
                rows.append((key, *c.tolist(), roots.view(np.int64)))
            yield pd.DataFrame(rows, columns=["id", "c1", "c2", "key", "f1", "f2", "roots"])

    return src.mapInPandas(run, f"id {kind}, c1 long, c2 long, key long, f1 long, f2 long, roots array<long>")


def trie_pairs(root: np.ndarray, side: np.ndarray, fp: np.ndarray, most: int | np.ndarray, direct: int = 1) -> tuple[np.ndarray, np.ndarray]:
    """Row pairs of equal root whose fingerprints differ in at most ``most`` bits (at every depth, if an array of budgets).

    ``side`` is 0 for rows of a root that is joined with itself; in a root of
    two blocks rows have side 1 and 2 and only pairs across are wanted.
    ``fp``: (n, 2) unsigned halves. Node pairs with at most ``direct`` leaf
    pairs, by default one, are finished by counting bits.
    """
    most = np.full(BITS + 1, most) if np.ndim(most) == 0 else most
    order = np.lexsort((fp[:, 1], fp[:, 0], side, root))
    root, side, fp = root[order], side[order], fp[order]
    n = len(root)
    first = np.flatnonzero(np.r_[True, (root[1:] != root[:-1]) | (side[1:] != side[:-1])]) if n else np.zeros(0, np.int64)
    last = np.r_[first[1:], n].astype(np.int64)
    own = side[first] == 0
    two = np.flatnonzero((side[first[:-1]] == 1) & (side[first[1:]] == 2) & (root[first[:-1]] == root[first[1:]])) if len(first) > 1 else np.zeros(0, np.int64)
    lo = np.r_[first[own], first[two]]
    hi = np.r_[last[own], last[two]]
    lo2 = np.r_[first[own], first[two + 1]] if len(two) else first[own]
    hi2 = np.r_[last[own], last[two + 1]] if len(two) else last[own]
    err = np.zeros(len(lo), np.int64)
    found_a, found_b = [], []

    def finish(lo, hi, lo2, hi2) -> None:
        w, h = hi - lo, hi2 - lo2
        count = w * h
        start = 0
        while start < len(count):
            stop = max(start + 1, int(np.searchsorted(np.cumsum(count[start:]), 1_000_000)) + start)
            c = count[start:stop]
            k = np.repeat(np.arange(start, stop), c)
            at = np.arange(c.sum()) - np.repeat(np.cumsum(c) - c, c)
            a, b = lo[k] + at // h[k], lo2[k] + at % h[k]
            keep = a < b
            a, b = a[keep], b[keep]
            near = np.bitwise_count(fp[a] ^ fp[b]).sum(1, dtype=np.int64) <= most[BITS]
            found_a.append(order[a[near]])
            found_b.append(order[b[near]])
            start = stop

    for depth in range(BITS):
        alive = (hi > lo) & (hi2 > lo2) & (err <= most[depth]) & ~((lo == lo2) & (hi - lo < 2))
        lo, hi, lo2, hi2, err = (x[alive] for x in (lo, hi, lo2, hi2, err))
        small = ((hi - lo) * (hi2 - lo2) <= direct) | ((lo == lo2) & (hi - lo == 2))
        finish(*(x[small] for x in (lo, hi, lo2, hi2)))
        lo, hi, lo2, hi2, err = (x[~small] for x in (lo, hi, lo2, hi2, err))
        if not len(lo):
            break
        bit = (fp[:, depth // 64] >> np.uint64(63 - depth % 64)) & np.uint64(1)
        ones = np.r_[0, np.cumsum(bit.astype(np.int64))]
        mid, mid2 = hi - (ones[hi] - ones[lo]), hi2 - (ones[hi2] - ones[lo2])
        other = lo != lo2
        lo, hi, lo2, hi2, err = (
            np.r_[lo, mid, lo, mid[other]],
            np.r_[mid, hi, mid, hi[other]],
            np.r_[lo2, mid2, mid2, lo2[other]],
            np.r_[mid2, hi2, hi2, mid2[other]],
            np.r_[err, err, err + 1, err[other] + 1],
        )
    else:
        alive = (hi > lo) & (hi2 > lo2) & (err <= most[BITS])
        finish(*(x[alive] for x in (lo, hi, lo2, hi2)))
    if not found_a:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    return np.concatenate(found_a), np.concatenate(found_b)


def _join_roots(batches: Iterator[pd.DataFrame], errors: int | np.ndarray, rows: int = 50_000) -> Iterator[pd.DataFrame]:
    """Trie joins of a partition sorted by root, so many rows at a time; the last root of them may go on in the next."""
    held: list[pd.DataFrame] = []
    for pdf in itertools.chain(batches, [None]):
        if pdf is not None:
            held.append(pdf)
            if sum(map(len, held)) < rows:
                continue
        if not held:
            continue
        now = pd.concat(held, ignore_index=True)
        root = now["root"].to_numpy()
        held = []
        if pdf is not None:
            last = root == root[-1]
            held, now, root = [now[last]], now[~last], root[~last]
        # Alone under a root there is nothing to join.
        same = root[1:] == root[:-1]
        now = now[np.r_[same, False] | np.r_[False, same]] if len(root) else now
        if not len(now):
            continue
        ids = now["id"].to_numpy()
        side = now["side"].to_numpy() if "side" in now else np.zeros(len(now), np.int64)
        a, b = trie_pairs(now["root"].to_numpy(), side, now[["f1", "f2"]].to_numpy().view(np.uint64), errors)
        a, b = ids[a], ids[b]
        swap = a > b
        yield pd.DataFrame({"a": np.where(swap, b, a), "b": np.where(swap, a, b)})


def _blocks(rows: DataFrame, hot: DataFrame) -> DataFrame:
    """Rows with the hot roots (root, blocks) split: a text of block i goes to every pair of blocks that has i."""
    rows = rows.join(hot, "root", "left").withColumn("blocks", F.coalesce("blocks", F.lit(1)))
    plain = rows.where("blocks = 1").select("root", F.lit(0).alias("side"), "id", "f1", "f2")
    split = rows.where("blocks > 1").withColumn("mine", F.pmod(F.xxhash64("id"), F.col("blocks")).cast("int"))
    pairs = F.transform(F.sequence(F.lit(0), F.col("blocks") - 1), lambda j: F.struct(F.xxhash64("root", F.least(F.col("mine"), j), F.greatest(F.col("mine"), j)).alias("root"), F.when(F.col("mine") == j, 0).when(F.col("mine") < j, 1).otherwise(2).cast("int").alias("side")))
    split = split.select(F.explode(pairs).alias("p"), "id", "f1", "f2").select("p.root", "p.side", "id", "f1", "f2")
    return plain.unionByName(split)


def candidate_pairs(texts: DataFrame, errors: int | np.ndarray, most: int = 4096) -> DataFrame:
    """Distinct id pairs ``(a, b)``, a < b, of texts close by fingerprint. ``texts``: id, f1, f2, roots."""
    kind = texts.schema["id"].dataType.simpleString()
    rows = texts.select("id", "f1", "f2", F.explode("roots").alias("root"))
    hot = materialize(rows.groupBy("root").count().where(F.col("count") > most).select("root", F.ceil(F.col("count") / most).cast("int").alias("blocks")), "hot")
    placed = rows if hot.isEmpty() else _blocks(rows, hot)
    placed = placed.repartition(width(texts.sparkSession), "root").sortWithinPartitions("root")
    return placed.mapInPandas(lambda batches: _join_roots(batches, errors), f"a {kind}, b {kind}").distinct()


def shingle_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str, size: int) -> DataFrame:
    """``(key, class, own)``: the 32-bit shingle hashes of the wanted texts (key, class), each once.

    A document is delivered again at times, perhaps with another text, so the
    key is taken from the text at hand.
    """
    src = docs.select(F.col(id_col).alias("class"), F.col(text_col).alias("text")).where(F.length("text") > 0).join(wanted.select("class"), "class", "left_semi")
    kind = src.schema["class"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = HashOf()
        for pdf in batches:
            rows = []
            for one, text in zip(pdf["class"], pdf["text"]):
                s = shingles(text, known, size)
                if len(s):
                    rows.append((np.int64(names(s)[2].astype(np.int64)), one, np.unique((s >> np.uint64(32)).astype(np.uint32)).view(np.int32)))
            yield pd.DataFrame(rows, columns=["key", "class", "own"])

    sets = src.mapInPandas(run, f"key long, class {kind}, own array<int>")
    return sets.join(wanted, ["key", "class"], "left_semi").dropDuplicates(["key"])


def verified(pairs: DataFrame, texts: DataFrame, docs: DataFrame, id_col: str, text_col: str, size: int, least: float) -> DataFrame:
    """``(a, b, similarity)``: classes of the candidate pairs (of keys) that hold on the shingles. ``texts``: key, class."""
    ends = pairs.select(F.col("a").alias("key")).union(pairs.select("b")).groupBy("key").agg(F.count("*").alias("partners"))
    ends = materialize(ends.join(texts.select("key", "class"), "key"), "ends")
    sets = shingle_sets(docs, ends.select("key", "class"), id_col, text_col, size)
    more = ends.select("key", "partners").dropDuplicates(["key"])
    p = pairs.join(more.toDF("a", "pa"), "a").join(more.toDF("b", "pb"), "b")
    first = F.col("pa") >= F.col("pb")
    p = p.select(F.when(first, F.col("a")).otherwise(F.col("b")).alias("stays"), F.when(first, F.col("b")).otherwise(F.col("a")).alias("goes"))
    both = p.join(sets.toDF("goes", "y", "sy"), "goes").join(sets.toDF("stays", "x", "sx"), "stays")
    common = F.size(F.array_intersect("sx", "sy"))
    both = both.select("x", "y", common.alias("common"), (F.size("sx") + F.size("sy")).alias("sizes"))
    similarity = F.col("common") / (F.col("sizes") - F.col("common"))
    return both.select(F.least("x", "y").alias("a"), F.greatest("x", "y").alias("b"), similarity.alias("similarity")).where(F.col("similarity") >= least)


def near_duplicates(docs: DataFrame, id_col: str = "docid", text_col: str = "body", size: int = 3, least: float = 0.6) -> tuple[DataFrame, DataFrame]:
    """Membership ``(id, class)`` and links ``(a, b, similarity)`` between classes; a class is named by its least id."""
    rows = materialize(signed(docs, id_col, text_col, size), "signed")
    one = rows.groupBy("id").agg(F.min(F.struct("c1", "c2")).alias("c")).select("id", "c.c1", "c.c2")
    one = materialize(one, "one")
    named = one.groupBy("c1", "c2").agg(F.min("id").alias("class"))
    texts = rows.groupBy("c1", "c2").agg(*[F.first(c).alias(c) for c in ("key", "f1", "f2", "roots")])
    texts = materialize(texts.join(named, ["c1", "c2"]), "classes")
    members = one.join(texts.select("c1", "c2", "class"), ["c1", "c2"]).select("id", "class")
    pairs = materialize(candidate_pairs(texts.select(F.col("key").alias("id"), "f1", "f2", "roots"), budgets(least)), "candidates")
    return members, verified(pairs, texts, docs, id_col, text_col, size, least)


def all_pairs(members: DataFrame, links: DataFrame) -> DataFrame:
    """Every pair of ids: within classes, and across linked classes."""
    m1, m2 = members.select(F.col("id").alias("x"), F.col("class").alias("a")), members.select(F.col("id").alias("y"), F.col("class").alias("b"))
    same = m1.join(m2, F.col("a") == F.col("b")).where(F.col("x") < F.col("y")).select("x", "y")
    across = links.join(m1, "a").join(m2, "b").where(F.col("x") != F.col("y")).select(F.least("x", "y").alias("x"), F.greatest("x", "y").alias("y"))
    return same.union(across).distinct()


def groups(members: DataFrame, links: DataFrame, rounds: int = 40) -> DataFrame:
    """``(id, group_id, links)``: each id with the least id of its connected group and the links of its class.

    Minimum labels spread over the links and jump along the labels already
    found; every round is written, so neither lineage nor driver grows, and
    removed when the next one is.
    """
    links = materialize(links.select("a", "b"), "links")
    edges = links.unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    label = written = materialize(edges.select(F.col("a").alias("node")).distinct().withColumn("label", F.col("node")), "label")
    for _ in range(rounds):
        near = edges.join(label, F.col("b") == F.col("node")).groupBy("a").agg(F.min("label").alias("near"))
        step = label.join(near, label["node"] == near["a"], "left").select("node", F.least("label", F.coalesce("near", "label")).alias("new"), "label")
        jump = label.select(F.col("node").alias("new"), F.col("label").alias("jump"))
        last, written = written, materialize(step.join(jump, "new", "left").select("node", F.least("new", F.coalesce("jump", "new")).alias("label"), (F.least("new", F.coalesce("jump", "new")) < F.col("label")).alias("moved")), "label")
        label = written.select("node", "label")
        discard(last)
        if written.where("moved").limit(1).count() == 0:
            break
    else:
        raise RuntimeError("groups did not settle; raise `rounds`")
    degree = edges.groupBy("a").agg(F.count("*").alias("links"))
    out = members.join(label.withColumnRenamed("node", "class"), "class", "left").join(degree.withColumnRenamed("a", "class"), "class", "left")
    return out.select("id", F.coalesce("label", "class").alias("group_id"), F.coalesce("links", F.lit(0)).alias("links"))
