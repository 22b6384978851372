"""Evaluation items that leaked into training documents (problem 7).

Spaced-seed hashing: fixed masks over consecutive words, some of whose
positions are ignored, are hashed over every position of the items and of the
documents; the two tables of hashes are joined, and equal hashes give a
document, an item and an offset between them. Around each such hit the words
are compared position by position and the longest stretch with at most
``replaced`` of its words different is measured.

The masks are lossless: any stretch of ``n`` words with ``floor(n / 10)`` of them
replaced is hit by one of them, wherever the replaced words stand (see
:func:`least_blocking`). For items whose half has 20 words or more they compare
nine words, for 6 or more six; runs of nine or six words alone would miss
stretches with a word replaced in every seven (or one in the middle of ten).
Items with a shorter half use runs of as many words.

The corpus is read once for any number of items. A sieve of the items' seeds (a
bitmap of at most ``1 << SIEVE[1]`` bits, three to a seed) goes to every task, so
that of the documents' seeds only those that items hold, and few others, are
joined; of documents without any nothing is written. A sieve that is full lets
more through and loses nothing.

Defined cases: null and blank texts on either side match nothing; items with
the same words are each reported; repeated words and ties are harmless as all
offsets are verified; repeated rows are reported once; an empty table gives an
empty result.
"""

from __future__ import annotations

import html
import re
from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .text import WORD, HashOf, chunks, hashes, mix

_QUOTES = re.compile("['’‘ʼ′`´＇]")
_ENTITY = re.compile(r"&(?:#\d+|#[xX][0-9a-fA-F]+|[A-Za-z]\w*);")

#: Masks by the least stretch they serve: 1 for words compared, 0 for words ignored.
LONG = ("111111111", "11011101111")
MIDDLE = ("111111", "11110011")
#: Words of the least stretch from which they serve.
FROM_LONG, FROM_MIDDLE = 20, 6
#: Share of replaced words up to which the masks are lossless.
MOST_REPLACED = 0.1
#: Least and greatest log2 of the bits of the sieve; bits set for a seed.
SIEVE, PROBES = (20, 27), (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9)
_P = np.uint64(0xD6E8FEB86659FD93)


def words_of(text: str) -> list[str]:
    """Words without regard to case, punctuation, quote marks and entities."""
    if "&" in text:
        text = _ENTITY.sub(lambda m: html.unescape(m.group()), text)
    return WORD.findall(_QUOTES.sub("", text.lower()))


def masks_for(least: int) -> tuple[str, ...]:
    """Masks for items of which at least so many words must stand in a document."""
    return LONG if least >= FROM_LONG else MIDDLE if least >= FROM_MIDDLE else ("1" * max(1, least),)


def least_blocking(masks: tuple[str, ...], most: int) -> list[int]:
    """For each length up to ``most`` the fewest replaced words with which no mask fits anywhere.

    By dynamic programming over what the last words are. The masks are lossless
    for a length if it is more than the words that may be replaced in it.
    """
    span = max(map(len, masks))
    state = np.arange(1 << span)
    cost = np.where(state == 0, 0, most + 1)
    out = [0]
    for n in range(1, most + 1):
        new = np.full(1 << span, most + 1)
        for bit in (0, 1):
            to = ((state << 1) | bit) & ((1 << span) - 1)
            blocked = np.all([(to & int(m, 2)) != 0 for m in masks if n >= len(m)], axis=0) if n >= min(map(len, masks)) else np.ones(len(to), bool)
            np.minimum.at(new, to, np.where(blocked, cost + bit, most + 1))
        cost = new
        out.append(int(cost.min()))
    return out


def seeds(words: np.ndarray, mask: str) -> np.ndarray:
    """Hash of the masked words at every position at which the mask fits."""
    n = len(words) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    h = np.zeros(n, np.uint64)
    for k, on in enumerate(mask):
        if on == "1":
            h = h * _P + words[k : k + n]
    return mix(h ^ np.uint64(int("1" + mask, 2)))


def stretch(same: np.ndarray, replaced: int) -> int:
    """Length of the longest run from a match to a match with at most ``replaced`` words in a thousand different."""
    at = np.flatnonzero(same)
    if not len(at):
        return 0
    # The run from match a to match b counts if gain[b] <= gain[a] + replaced; the first such a is found on the running maximum.
    gain = (1000 - replaced) * at - 1000 * np.arange(len(at))
    first = np.searchsorted(np.maximum.accumulate(gain), gain - replaced)
    return int((at - at[first]).max()) + 1


def item_words(items: DataFrame, item_id: str, item_text: str) -> DataFrame:
    """``(item, name, words)``: word hashes of the items; equal texts have one name."""
    src = items.select(F.col(item_id).alias("item"), F.col(item_text).alias("text")).where(F.col("item").isNotNull() & (F.length("text") > 0)).distinct()
    kind = src.schema["item"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = HashOf()
        for pdf in batches:
            w = [hashes(words_of(t), known) for t in pdf["text"]]
            out = pd.DataFrame({"item": pdf["item"], "name": [xxhash.xxh3_128_hexdigest(x.tobytes()) for x in w], "words": [x.view(np.int64) for x in w]})
            yield out[[len(x) > 0 for x in w]]

    return src.mapInPandas(run, f"item {kind}, name string, words array<long>")


def seed_table(texts: DataFrame, share: float, masks: Callable[[int], tuple[str, ...]] = masks_for) -> DataFrame:
    """``(name, mask, seed, item_at)`` of texts (name, words)."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            for name, words in zip(pdf["name"], pdf["words"]):
                w = np.asarray(words, np.int64).view(np.uint64)
                for mask in masks(int(-(-len(w) * share // 1))):
                    s = seeds(w, mask)
                    yield pd.DataFrame({"name": name, "mask": mask, "seed": s.view(np.int64), "item_at": np.arange(len(s), dtype=np.int32)})

    return texts.select("name", "words").mapInPandas(run, "name string, mask string, seed long, item_at int")


def _bits(s: np.ndarray, probe: int, bits: int) -> np.ndarray:
    return mix(s ^ np.uint64(PROBES[probe])) >> np.uint64(64 - bits)


def sieve_of(table: DataFrame) -> tuple[int, np.ndarray]:
    """Size (log2) and words of the bitmap of all seeds."""
    bits = min(SIEVE[1], max(SIEVE[0], int(table.count() * 256).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = batch.column("seed").to_numpy().view(np.uint64)
            i = np.unique(np.concatenate([_bits(s, k, bits) for k in range(len(PROBES))])).astype(np.int64)
            yield pa.RecordBatch.from_arrays([pa.array(i >> 6), pa.array(np.left_shift(np.uint64(1), (i & 63).astype(np.uint64)).view(np.int64))], names=["at", "bit"])

    got = table.select("seed").mapInArrow(run, "at long, bit long").groupBy("at").agg(F.bit_or("bit").alias("bit")).toPandas()  # at most 1 << (SIEVE[1] - 6) rows
    out = np.zeros(1 << (bits - 6), np.uint64)
    out[got["at"].to_numpy(np.int64)] = got["bit"].to_numpy(np.int64).view(np.uint64)
    return bits, out


def _sieved(s: np.ndarray, bits: int, sieve: np.ndarray) -> np.ndarray:
    """Positions of the seeds that the sieve lets through."""
    at = np.arange(len(s))
    for k in range(len(PROBES)):
        i = _bits(s[at], k, bits)
        at = at[(sieve[i >> np.uint64(6)] >> (i & np.uint64(63)) & np.uint64(1)).astype(bool)]
    return at


def marked_documents(docs: DataFrame, masks: list[str], sieve: tuple[int, np.ndarray], id_col: str, text_col: str) -> DataFrame:
    """``(doc, words, hits)`` of the documents with seeds that items may hold; hits are (seed, doc_at)."""
    src = docs.select(F.col(id_col).alias("doc"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = src.schema["doc"].dataType.simpleString()
    held = docs.sparkSession.sparkContext.broadcast(sieve)  # at most 1 << SIEVE[1] bits

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = HashOf()
        for pdf in batches:
            keys, body = pdf["doc"].to_numpy(), list(pdf["text"])
            for lo, hi in chunks(body, 1_500_000):
                found = [hashes(words_of(t), known) for t in body[lo:hi]]
                edge = np.cumsum([0, *map(len, found)])
                flat = np.concatenate(found)
                at, seed = [], []
                for mask in masks:
                    s = seeds(flat, mask)
                    p = _sieved(s, *held.value)
                    # The documents of a batch stand one after the other.
                    p = p[p + len(mask) <= edge[np.searchsorted(edge, p, "right")]] if len(p) else p
                    at.append(p)
                    seed.append(s[p])
                at, seed = np.concatenate(at), np.concatenate(seed)
                doc = np.searchsorted(edge, at, "right") - 1
                rows = []
                for d in np.unique(doc).tolist():
                    mine = doc == d
                    hits = list(zip(seed[mine].view(np.int64).tolist(), (at[mine] - edge[d]).tolist()))
                    rows.append((keys[lo + d], found[d].view(np.int64), hits))
                if rows:
                    yield pd.DataFrame(rows, columns=["doc", "words", "hits"])

    return src.mapInPandas(run, f"doc {kind}, words array<long>, hits array<struct<seed: long, doc_at: int>>")


def _measured(batches: Iterator[pa.RecordBatch], replaced: int) -> Iterator[pa.RecordBatch]:
    """Longest stretches of rows (row, name, least, a, b): words of the document and of the item, side by side."""
    for batch in batches:
        a, b = batch.column("a"), batch.column("b")
        size = np.diff(a.offsets.to_numpy())
        same = a.flatten().to_numpy() == b.flatten().to_numpy()
        edge = np.cumsum([0, *size])
        least = batch.column("least").to_numpy()
        best = np.zeros(len(size), np.int32)
        # Enough words must agree at all before the stretch itself is measured.
        n = np.diff(np.r_[0, np.cumsum(same)][edge])
        for r in np.flatnonzero(1000 * n >= (1000 - replaced) * least).tolist():
            best[r] = stretch(same[edge[r] : edge[r + 1]], replaced)
        keep = pa.array(best >= least)
        yield pa.RecordBatch.from_arrays([batch.column("row"), batch.column("name"), pa.array(best)], names=["row", "name", "stretch"]).filter(keep)


def leaks(docs: DataFrame, items: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_id: str = "item_id", item_text: str = "text", share: float = 0.5, replaced: float = 0.1, masks: Callable[[int], tuple[str, ...]] = masks_for) -> DataFrame:
    """``(doc id, item id, stretch, item_words)`` of every item that stands in a document in a stretch of at least ``share`` of its words."""
    if not 0 <= replaced <= MOST_REPLACED:
        raise ValueError(f"the masks are lossless up to a share of {MOST_REPLACED} replaced words")
    own = materialize(item_words(items, item_id, item_text), "items")
    texts = materialize(own.groupBy("name").agg(F.first("words").alias("words")), "item-texts")
    table = materialize(seed_table(texts, share, masks), "seeds")
    used = [r[0] for r in table.select("mask").distinct().orderBy("mask").collect()]  # nine at most
    marked = materialize(marked_documents(docs, used or ["1"], sieve_of(table), id_col, text_col).withColumn("row", F.monotonically_increasing_id()), "marked")
    hits = marked.select("row", F.inline("hits")).join(table.select("name", "seed", "item_at"), "seed")
    places = hits.select("row", "name", (F.col("doc_at") - F.col("item_at")).alias("off")).distinct()
    n = F.size("item")
    pairs = places.join(texts.select("name", F.col("words").alias("item")), "name").join(marked.select("row", "words"), "row")
    pairs = pairs.withColumn("least", F.ceil(n * F.lit(share)).cast("int")).withColumn("lo", F.greatest("off", F.lit(0)))
    pairs = pairs.withColumn("span", F.least(F.col("off") + n, F.size("words")) - F.col("lo")).where("span >= least")
    sides = pairs.select("row", "name", "least", F.slice("words", F.col("lo") + 1, F.col("span")).alias("a"), F.slice("item", F.col("lo") - F.col("off") + 1, F.col("span")).alias("b"))
    thousandths = round(1000 * replaced)
    found = sides.mapInArrow(lambda batches: _measured(batches, thousandths), "row long, name string, stretch int")
    found = found.join(marked.select("row", "doc"), "row").join(own.select("item", "name", F.size("words").alias("item_words")), "name")
    return found.groupBy(F.col("doc").alias(id_col), F.col("item").alias(item_id)).agg(F.max("stretch").alias("stretch"), F.max("item_words").alias("item_words"))
