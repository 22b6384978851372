"""Cut oversized items at natural boundaries, with overlap (problem 6).

Every candidate boundary of a text has a penalty (paragraph < line < sentence
< clause < word < any character). A dynamic programme over the boundary
positions picks the cuts with the least sum of penalties and of squared
deviations from the balanced piece size, such that no piece exceeds the limit
and each piece starts about ``overlap`` characters before the end of the one
before. Rows are independent, so the operator is one narrow stage.

Defined cases: null parts count as empty; an item within the limit yields no
row from :func:`split_oversized`; texts without any white space are cut between
characters; repeated items yield repeated pieces; an empty table yields an
empty result.
"""

from __future__ import annotations

import re
from bisect import bisect_left
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Penalties of cut positions by kind of boundary.
PARAGRAPH, LINE, SENTENCE, CLAUSE, WORD, HARD = 0.0, 0.15, 0.3, 0.8, 1.5, 6.0
IMBALANCE = 2.0
_STRONG = re.compile(r"(?:[.!?…。！？][\"'”’»)\]]*+|(?<![^\S\n]))[^\S\n]*+(?:(?P<p>\n[^\S\n]*+\n\s*)|(?P<l>\n\s*))|(?P<s>[.!?…。！？][\"'”’»)\]]*+\s+)")
_CLAUSE = re.compile(r"[,;:–—，；：][\"'”’»)\]]*\s*")
_WORD = re.compile(r"\s+")


def boundaries(text: str, gap: int) -> tuple[list[int], list[float]]:
    """Cut positions with penalties, rising; no two further apart than ``gap``.

    A cut at ``i`` ends a piece before ``text[i]``. Weaker kinds are listed
    only inside stretches longer than ``gap`` without a stronger one.
    """
    pos, pen = [0], [0.0]

    def weaker(lo: int, hi: int) -> None:
        for pattern, cost in ((_CLAUSE, CLAUSE), (_WORD, WORD)):
            if hi - lo <= gap:
                return
            found = [m.end() for m in pattern.finditer(text, lo, hi) if lo < m.end() < hi]
            if found:
                last = lo
                for e in [*found, hi]:
                    if e - last > gap and pattern is _CLAUSE:
                        words(last, e)
                    elif e - last > gap:
                        hard(last, e)
                    if e < hi:
                        pos.append(e)
                        pen.append(cost)
                    last = e
                return
        hard(lo, hi)

    def words(lo: int, hi: int) -> None:
        last = lo
        for m in _WORD.finditer(text, lo, hi):
            if last < m.end() < hi:
                if m.end() - last > gap:
                    hard(last, m.end())
                pos.append(m.end())
                pen.append(WORD)
                last = m.end()
        if hi - last > gap:
            hard(last, hi)

    def hard(lo: int, hi: int) -> None:
        for e in range(lo + gap, hi, gap):
            pos.append(e)
            pen.append(HARD)

    for m in _STRONG.finditer(text):
        e = m.end()
        if e >= len(text):
            break
        if e - pos[-1] > gap:
            weaker(pos[-1], e)
        pos.append(e)
        pen.append(PARAGRAPH if m["p"] is not None else LINE if m["l"] is not None else SENTENCE)
    if len(text) - pos[-1] > gap:
        weaker(pos[-1], len(text))
    pos.append(len(text))
    pen.append(0.0)
    return pos, pen


def _word_near(text: str, want: int, slack: int) -> int:
    """The beginning of a word nearest to a position, or the position itself."""
    ends = [m.end() for m in _WORD.finditer(text, max(0, want - slack), want + slack)]
    return min(ends, key=lambda e: abs(e - want), default=want)


def spans(text: str, limit: int = 2000, overlap: int = 200) -> list[tuple[int, int]]:
    """Start and end of each piece; one span if the text is within the limit."""
    n = len(text)
    if n <= limit:
        return [(0, n)]
    gap = max(1, min(overlap, limit // 8) or limit // 8)
    pos, pen = boundaries(text, gap)
    m = len(pos)
    # Where the piece after a cut at pos[j] begins: the best boundary about `overlap` before it.
    start = [0] * m
    slack = overlap // 4
    for j in range(1, m):
        want = pos[j] - overlap
        if overlap <= 0 or want <= 0:
            start[j] = pos[j] if overlap <= 0 else 0
            continue
        lo, hi = bisect_left(pos, want - slack), bisect_left(pos, want + slack + 1)
        near = [(pen[i] + 2.0 * abs(pos[i] - want) / overlap, -pos[i]) for i in range(lo, min(hi, j)) if pos[i] > 0]
        start[j] = -min(near)[1] if near else _word_near(text, want, slack)
    pieces = -(-(n - overlap) // (limit - overlap))
    target = (n + (pieces - 1) * overlap) / pieces
    best, back = [float("inf")] * m, [0] * m
    best[0] = 0.0
    lo = 0
    for j in range(1, m):
        end = pos[j]
        while end - start[lo] > limit:
            lo += 1
        top, at = float("inf"), lo
        for i in range(lo, j):
            off = (end - start[i]) / target - 1.0
            c = best[i] + IMBALANCE * off * off
            if c < top:
                top, at = c, i
        best[j], back[j] = top + pen[j] + 0.2, at
    out, j = [], m - 1
    while j:
        i = back[j]
        out.append((start[i] if i else 0, pos[j]))
        j = i
    return out[::-1]


def split_oversized(df: DataFrame, id_col: str, parts: list[str], limit: int = 2000, overlap: int = 200, with_text: bool = True) -> DataFrame:
    """Pieces ``(id, piece_no, n_pieces, start, end[, piece])`` of items over the limit.

    The item is the stripped ``parts`` joined by one blank and stripped again.
    Items that cannot exceed the limit are dropped before Python sees them.
    """
    if not 0 <= overlap < limit // 2:
        raise ValueError("overlap must be at least 0 and under half of the limit")
    lengths = sum((F.length(F.coalesce(F.col(p), F.lit(""))) for p in parts), F.lit(len(parts) - 1))
    src = df.select(F.col(id_col).alias("id"), *[F.col(p).alias(f"part{k}") for k, p in enumerate(parts)], lengths.alias("len")).where(F.col("len") > limit).drop("len")
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, *cells in pdf.itertuples(index=False, name=None):
                text = " ".join((c or "").strip() for c in cells).strip()
                if len(text) <= limit:
                    continue
                cut = spans(text, limit, overlap)
                for k, (s, e) in enumerate(cut):
                    rows.append((key, k + 1, len(cut), s, e, text[s:e]) if with_text else (key, k + 1, len(cut), s, e))
            yield pd.DataFrame(rows, columns=["id", "piece_no", "n_pieces", "start", "end", *["piece"] * with_text])

    return src.mapInPandas(run, f"id {kind}, piece_no int, n_pieces int, start int, end int" + ", piece string" * with_text).withColumnRenamed("id", id_col)
