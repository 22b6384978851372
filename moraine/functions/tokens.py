"""Token arrays: markers, padding, masks.

Token ids are arrays of int per row; the tokenizer is any expression or
function that yields them.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

PAD, CLS, SEP, Q, D, MASK = 0, 1, 2, 3, 4, 5


def special_ids(vocab: dict[str, int], query: str = "[unused0]", doc: str = "[unused1]", fields: dict[str, tuple[str, str]] | None = None) -> dict[str, int]:
    """Ids of the query and document markers and of each field's begin and end marker; unknown ones are added to ``vocab``."""
    wanted = [query, doc, *[m for pair in (fields or {}).values() for m in pair]]
    if len(set(wanted)) < len(wanted):
        raise ValueError("markers must be distinct")
    for m in wanted:
        vocab.setdefault(m, max(vocab.values(), default=-1) + 1)
    return {m: vocab[m] for m in wanted}


def query_ids(tokens: Column, maxlen: int = 32) -> Column:
    """``[CLS] [Q] tokens [SEP]`` of exactly ``maxlen``, padded with MASK; the marker shifts the rest right and the last slot drops."""
    if maxlen < 3:
        raise ValueError("maxlen must leave room for three special tokens")
    body = F.slice(tokens, 1, maxlen - 2)
    plain = F.concat(F.array(F.lit(CLS)), body, F.array(F.lit(SEP)))
    padded = F.concat(plain, F.array_repeat(F.lit(PAD), F.greatest(F.lit(maxlen) - F.size(plain), F.lit(0))))
    marked = F.concat(F.slice(padded, 1, 1), F.array(F.lit(Q)), F.slice(padded, 2, maxlen - 2))
    return F.transform(marked, lambda x: F.when(x == PAD, MASK).otherwise(x))


def doc_ids(tokens: Column, maxlen: int = 180) -> Column:
    """``[CLS] [D] tokens [SEP]``, tokens cut such that the rest always fits; independent of any batch."""
    if maxlen < 4:
        raise ValueError("maxlen must leave room for three special tokens and a word")
    return F.concat(F.array(F.lit(CLS), F.lit(D)), F.slice(tokens, 1, maxlen - 3), F.array(F.lit(SEP)))


def skip_mask(ids: Column, skipped: list[int]) -> Column:
    """True where the token is neither skipped (punctuation) nor padding."""
    return F.transform(ids, lambda x: ~x.isin([PAD, *skipped]))


def field_mask(ids: Column, fields: list[tuple[int, int]], keep_markers: bool = False, keep_special: list[int] | None = None) -> Column:
    """True inside the given ``(begin, end)`` marker pairs.

    A token is inside a field while the running count of begins over ends is
    above its lowest point so far, so an end without a begin is ignored and a
    field that never ends runs to the end. No fields: all true.
    """
    if any(b == e for b, e in fields):
        raise ValueError("a field needs two different markers")
    if not fields:
        return F.transform(ids, lambda x: F.lit(True))
    out = F.transform(ids, lambda x: x.isin(keep_special or [-1]))
    for b, e in fields:
        out = F.zip_with(out, _inside(ids, b, e, keep_markers), lambda x, y: x | y)
    return out


def _inside(ids: Column, b: int, e: int, keep_markers: bool) -> Column:
    """The mask of one field, from the spans its few markers enclose."""
    marks = F.filter(F.transform(ids, lambda x, i: F.struct(i.alias("i"), x.alias("x"))), lambda z: z["x"].isin(b, e))
    none = F.expr("CAST(array() AS array<struct<lo:int,hi:int>>)")

    def step(acc: Column, z: Column) -> Column:
        depth = acc["depth"]
        opens, closes = (z["x"] == b) & (depth == 0), (z["x"] == e) & (depth == 1)
        span = F.array(F.struct(acc["lo"].alias("lo"), z["i"].alias("hi")))
        return F.struct(
            F.when(z["x"] == b, depth + 1).when(depth > 0, depth - 1).otherwise(depth).alias("depth"),
            F.when(opens, z["i"]).otherwise(acc["lo"]).alias("lo"),
            F.when(closes, F.concat(acc["spans"], span)).otherwise(acc["spans"]).alias("spans"),
        )

    def closed(last: Column) -> Column:
        return F.when(last["depth"] > 0, F.concat(last["spans"], F.array(F.struct(last["lo"].alias("lo"), F.lit(1 << 30).alias("hi"))))).otherwise(last["spans"])

    spans = F.aggregate(marks, F.struct(F.lit(0).alias("depth"), F.lit(0).alias("lo"), none.alias("spans")), step, closed)
    # An array of one binds the spans to a name, so that they are not computed again for every token.
    inside = F.transform(F.array(spans), lambda own: F.transform(ids, lambda x, i: F.exists(own, lambda s: (s["lo"] <= i) & (i <= s["hi"])) & (F.lit(keep_markers) | ~x.isin(b, e))))
    return F.element_at(inside, 1)


def kept(ids: Column, *masks: Column) -> Column:
    """Tokens for which every mask is true, in order."""
    every = masks[0]
    for m in masks[1:]:
        every = F.zip_with(every, m, lambda x, y: x & y)
    return F.transform(F.filter(F.arrays_zip(ids.alias("i"), every.alias("m")), lambda z: z["m"]), lambda z: z["i"])
