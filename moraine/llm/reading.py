"""Reading band of each English document (problem 9).

A Rasch-style latent difficulty model: a document has a level, a word has a
difficulty and a spread, and the log-odds of meeting one word rather than
another is linear in the document's level with the difference of their
difficulties as slope (an occurrence of word w has the weight
exp(-(level - difficulty_w)^2 / 2 spread_w) at a level). The joint likelihood of
levels and words is raised by alternating optimisation over the whole corpus,
each step taking the most likely values given the others:

* given levels, a word's difficulty and spread are the mean and the variance of
  the levels at its occurrences - one distributed sum per round;
* given words, a document's level is the mean difficulty of its words, weighted
  by 1 / spread - one narrow pass, which also sums the likelihood.

Rounds end when the mean log-likelihood of an occurrence stops rising (by more
than ``tolerance``). A human band counts in its document's level as much as all
its words in every round; a line fitted to all labelled documents fixes the
scale after each, and the labels set the four cut points between bands.

Word parameters live in ``1 << BITS`` hashed slots, so what is gathered and
sent out has a fixed size whatever the corpus; words that share a slot share
parameters.

English is known by the words that stand in most labelled documents, all of
which are English: a document must reach half the median share that those
words have in labelled ones. No list of words of any language is needed.

Defined cases: null texts, texts under ``min_words`` white-space words and texts
not in English get no band; null bands and labels of unknown documents are
ignored, repeated labels count once, several labels of a document are averaged;
without any labels, or with one band only, the result is empty; words in one
document only carry little weight by the prior spread.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..runtime import materialize
from .text import HashOf, hashes

BITS = 18
#: Prior: occurrences it counts for, and its variance of levels.
PRIOR_N, PRIOR_VAR, FLOOR = 2.0, 2.0, 0.03
CELLS = 2000
_WORD = re.compile(r"[^\W\d_]+")
#: Commonest words of the labelled documents that English is known by, and the share of their median that a document must reach.
COMMON_WORDS, COMMON_SHARE = 50, 0.5


def labelled(labels: DataFrame, id_col: str, band_col: str) -> DataFrame:
    """``(id, y)``: mean band of each labelled document, repeated labels counted once."""
    y = labels.where(F.col(band_col).isNotNull()).select(F.col(id_col).alias("id"), *[c for c in labels.columns if c not in (id_col, band_col)], F.col(band_col).alias("band")).distinct()
    return y.groupBy("id").agg(F.avg("band").cast("double").alias("y"))


def common_words(docs: DataFrame, y: DataFrame, id_col: str, text_col: str, bits: int) -> np.ndarray:
    """Slots of the words that stand in most labelled documents, all of which are English."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0).join(y.select("id"), "id", "left_semi")

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known, n = HashOf(), Counter()
        for pdf in batches:
            for text in pdf["text"]:
                n.update(known[w] & ((1 << bits) - 1) for w in set(_WORD.findall(text.lower())))
        yield pd.DataFrame({"slot": list(n.keys()), "n": list(n.values())})

    got = src.select("text").mapInPandas(run, "slot int, n long").groupBy("slot").agg(F.sum("n").alias("n")).orderBy(F.desc("n"), "slot").limit(COMMON_WORDS)
    return np.array([r["slot"] for r in got.collect()], np.int64)  # COMMON_WORDS rows


def features(docs: DataFrame, common: np.ndarray, id_col: str = "doc_id", text_col: str = "text", min_words: int = 50, bits: int = BITS) -> DataFrame:
    """``(id, slots, counts, share)`` of the documents with enough words; ``share`` is that of the common words."""
    src = docs.select(F.col(id_col).alias("id"), F.col(text_col).alias("text")).where(F.length("text") > 0)
    kind = src.schema["id"].dataType.simpleString()
    common = np.bincount(common, minlength=1 << bits) > 0

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = HashOf()
        for pdf in batches:
            keys, slots, counts, share = [], [], [], []
            for key, text in zip(pdf["id"], pdf["text"]):
                if len(text.split(None, min_words)) < min_words:
                    continue
                words = _WORD.findall(text.lower())
                n = Counter(words)
                # Words of one slot stay apart; all that is done with them are sums.
                slot = (hashes(list(n), known) & np.uint64((1 << bits) - 1)).astype(np.int32)
                count = np.fromiter(n.values(), np.int32, len(n))
                keys.append(key)
                slots.append(slot)
                counts.append(count)
                share.append(float(count[common[slot]].sum()) / max(1, len(words)))
            if keys:
                yield pd.DataFrame({"id": keys, "slots": slots, "counts": counts, "share": share})

    return src.mapInPandas(run, f"id {kind}, slots array<int>, counts array<int>, share double")


def _flat(batch: pa.RecordBatch):
    """Row of each slot, slots and counts of a batch."""
    slots = batch.column("slots")
    sizes = np.diff(slots.offsets.to_numpy())
    return np.repeat(np.arange(len(sizes)), sizes), slots.flatten().to_numpy(), batch.column("counts").flatten().to_numpy().astype(float)


class Words:
    """Difficulty and weight (1 / spread) per slot."""

    def __init__(self, difficulty: np.ndarray, weight: np.ndarray, a: float = 1.0, b: float = 0.0) -> None:
        self.difficulty, self.weight, self.a, self.b = difficulty, weight, a, b

    def levels(self, batch: pa.RecordBatch) -> np.ndarray:
        row, slot, n = _flat(batch)
        w = n * self.weight[slot]
        top = np.bincount(row, w * self.difficulty[slot], batch.num_rows)
        return self.a * top / np.maximum(np.bincount(row, w, batch.num_rows), 1e-12) + self.b

    def likelihood(self, level: np.ndarray, slot: np.ndarray, n: np.ndarray) -> float:
        """Log-likelihood of the levels at occurrences, up to a constant; words met twice or less say nothing."""
        w = self.weight[slot] / self.a**2
        each = 0.5 * (np.log(np.maximum(w, 1e-12)) - w * (level - self.a * self.difficulty[slot] - self.b) ** 2)
        return float((n * each)[self.weight[slot] > 1e-5].sum())


def _sums(rows: DataFrame, words: Words | None, bits: int) -> tuple[Words, float]:
    """New word parameters from the levels of all rows, and the mean log-likelihood of an occurrence under the old ones.

    A row's level is the most likely one under the words as they are; where
    there is a label, it counts as much as all words of the document. Without
    words the labels alone are the levels.
    """
    spark = rows.sparkSession
    held = spark.sparkContext.broadcast(words)  # 1 << bits slots

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((3, 1 << bits))
        likely = np.zeros(2)
        for batch in batches:
            y = batch.column("y").to_numpy(zero_copy_only=False).astype(float)
            row, slot, n = _flat(batch)
            if held.value is None:
                level = y
            else:
                level = held.value.levels(batch)
                level = np.where(np.isnan(y), level, (level + y) / 2)
                likely += held.value.likelihood(level[row], slot, n), n.sum()
            for k in range(3):
                total[k] += np.bincount(slot, n * level[row] ** k, 1 << bits)
        at = np.flatnonzero(total[0])
        # The likelihood travels in a slot of its own.
        columns = [np.r_[at, -1].astype(np.int32), np.r_[total[0][at], likely[1]], np.r_[total[1][at], likely[0]], np.r_[total[2][at], 0.0]]
        yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["slot", "n", "s", "q"])

    part = rows.mapInArrow(run, "slot int, n double, s double, q double")
    got = part.groupBy("slot").agg(F.sum("n").alias("n"), F.sum("s").alias("s"), F.sum("q").alias("q")).toPandas()  # at most 1 + (1 << bits) rows
    own = got[got["slot"] < 0]
    got = got[got["slot"] >= 0]
    n, s, q = np.zeros((3, 1 << bits))
    n[got["slot"]], s[got["slot"]], q[got["slot"]] = got["n"], got["s"], got["q"]
    mean = s.sum() / max(n.sum(), 1)
    difficulty = (s + mean) / (n + 1)
    raw = np.maximum(q / np.maximum(n, 1) - (s / np.maximum(n, 1)) ** 2, 0)
    spread = (raw * n + PRIOR_VAR * PRIOR_N) / (n + PRIOR_N)
    likelihood = float(own["s"].sum() / max(own["n"].sum(), 1)) if words is not None else -np.inf
    return Words(difficulty, np.where(n > 2, 1 / (spread + FLOOR), 1e-6)), likelihood


def _labelled(rows: DataFrame, words: Words) -> pd.DataFrame:
    """Counts of labelled documents by level (in cells) and label."""
    held = rows.sparkSession.sparkContext.broadcast(words)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cell = np.clip(np.floor((held.value.levels(batch) + 2) / 10 * CELLS), 0, CELLS - 1).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(cell), batch.column("y")], names=["cell", "y"])

    got = rows.mapInArrow(run, "cell int, y double").groupBy("cell", F.round("y", 1).alias("y")).count().toPandas()  # at most CELLS * 41 rows
    return got.assign(level=(got["cell"] + 0.5) / CELLS * 10 - 2)


def _anchored(rows: DataFrame, words: Words) -> Words:
    """The same words with the scale fixed: the line that brings levels to labels."""
    got = _labelled(rows, words)
    w, x, y = got["count"].to_numpy(float), got["level"].to_numpy(float), got["y"].to_numpy(float)
    mx, my = np.average(x, weights=w), np.average(y, weights=w)
    var = np.average((x - mx) ** 2, weights=w)
    a = np.average((x - mx) * (y - my), weights=w) / var if var > 0 else 1.0
    return Words(words.difficulty, words.weight, a, my - a * mx)


def _cuts(rows: DataFrame, words: Words) -> list[float]:
    """The four cut points that part the labelled documents with the fewest errors."""
    got = _labelled(rows, words).sort_values("level")
    out = []
    for k in range(1, 5):
        near = got[(got["y"] > k - 1) & (got["y"] < k + 2)]
        under = near["y"] <= k + 0.5
        if not under.any() or under.all():
            out.append(k + 0.5)
            continue
        w, x = near["count"].to_numpy(float), near["level"].to_numpy(float)
        wrong = (w * ~under).cumsum() + (w * under).sum() - (w * under).cumsum()  # with the cut above x
        least = wrong.to_numpy() == wrong.min()
        out.append(float(np.median(x[least])) + 5 / CELLS)
    return list(np.maximum.accumulate(out))


def fitted(rows: DataFrame, known: DataFrame, tolerance: float = 0.01, most: int = 20, bits: int = BITS) -> tuple[Words, list[float]]:
    """Word parameters on the scale of the labels, and the mean log-likelihood after each round.

    Rounds end when the likelihood of an occurrence has risen by less than
    ``tolerance``, or after ``most`` of them, with the words of the last step. ``rows``: slots, counts, y;
    ``known``: those with a label.
    """
    words = _anchored(known, _sums(known, None, bits)[0])
    course: list[float] = []
    while True:
        new, likelihood = _sums(rows, words, bits)
        course.append(likelihood)
        words = _anchored(known, new)
        if len(course) > 1 and (course[-1] - course[-2] < tolerance or len(course) >= most):
            return words, course


def reading_bands(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", band_col: str = "band", min_words: int = 50, bits: int = BITS) -> DataFrame:
    """``(id, level, band)`` of every English document with enough words."""
    spark = docs.sparkSession
    y = materialize(labelled(labels, id_col, band_col), "labels")
    common = common_words(docs, y, id_col, text_col, bits)
    rows = materialize(features(docs, common, id_col, text_col, min_words, bits).join(y, "id", "left"), "words")
    known = rows.where(F.col("y").isNotNull())
    kind = rows.schema["id"].dataType.simpleString()
    if len(known.select("y").distinct().take(2)) < 2:
        return spark.createDataFrame([], f"{id_col} {kind}, level double, band int")
    least = COMMON_SHARE * known.agg(F.percentile_approx("share", 0.5, F.lit(10_000))).first()[0]
    rows, known = rows.where(F.col("share") >= least), materialize(known.where(F.col("share") >= least), "known")
    words, _ = fitted(rows, known, bits=bits)
    cuts = _cuts(known, words)
    held = spark.sparkContext.broadcast((words, np.array(cuts)))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            level = held.value[0].levels(batch)
            band = 1 + (level[:, None] > held.value[1]).sum(1)
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(level), pa.array(band.astype(np.int32))], names=["id", "level", "band"])

    return rows.mapInArrow(run, f"id {kind}, level double, band int").withColumnRenamed("id", id_col)
