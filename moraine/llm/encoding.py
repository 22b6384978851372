"""Text decoded with the wrong encoding: find it and restore it (problem 5).

Round-trip repair. Two kinds of damage are undone:

* UTF-8 read as a one-byte encoding. Every run of non-ASCII characters is
  encoded back under each candidate legacy encoding and strictly decoded as
  UTF-8; the result is treated again, so that nested layers come off one by
  one, each perhaps under another encoding.
* One Cyrillic one-byte encoding read as another. Each line's Cyrillic words are
  encoded back under one and decoded under the other.

A candidate is accepted when the garbling cost drops. Any script is cheap as
long as it is coherent: a letter costs one, whatever its script, beginning a
word of another script than Latin costs more, so a stray
letter of such a script costs more than the accents and marks it may come from;
controls, unassigned characters, box drawings and odd symbols are dear. Once a
script has been restored in a value, its stray letters there cost no more than
others. Russian letters cost by their frequency, and a change from small to
capital letter within a word costs extra. Reading a Cyrillic line under another
encoding must pay by its letters taken together, so a short line needs as much
evidence as a long one, unless other lines of the value give it. Multi-byte encodings other than UTF-8 (Shift-JIS, GB18030
and the like) are not tried.

U+FFFD marks bytes that are lost: the value is reported, and text around it is
restored as far as it goes. A garbled sequence that stands alone between quote
marks is a quotation of garbling, not damage.

Defined cases: null and empty values are never cases; ASCII text is never a
case; every line is handled alone, so very long texts cost in proportion;
repeated rows are reported once; an empty table gives an empty result.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache
from math import log

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: One-byte encodings text is taken to have been misread in, most likely first.
LEGACY = ("cp1252", "latin-1", "cp437", "mac_roman", "cp1251", "cp850", "koi8-r", "cp866", "cp1250", "cp1254", "iso8859-15", "mac_cyrillic")
#: Pairs (written as, read as) of Cyrillic encodings.
CYRILLIC = (("koi8-r", "cp1251"), ("cp1251", "koi8-r"), ("cp866", "cp1251"), ("cp1251", "cp866"), ("cp1251", "mac_cyrillic"), ("cp1251", "cp1252"), ("koi8-r", "cp1252"), ("cp866", "cp1252"))
#: Per cent of each letter in Russian text (public letter frequencies, fixed values), in order of the alphabet.
RUSSIAN = dict(zip("абвгдежзийклмнопрстуфхцчшщъыьэюяё", (8.0, 1.6, 4.5, 1.7, 3.0, 8.4, 0.9, 1.6, 7.4, 1.2, 3.5, 4.4, 3.2, 6.7, 11.0, 2.8, 4.7, 5.5, 6.3, 2.6, 0.3, 1.0, 0.5, 1.4, 0.7, 0.4, 0.04, 1.9, 1.7, 0.3, 0.6, 2.0, 0.3)))
#: Non-ASCII characters that ordinary text in western languages holds.
COMMON = frozenset("àáâãäåæçèéêëìíîïðñòóôõöøùúûüýþÿœšžßÀÁÂÃÄÅÆÇÈÉÊËÌÍÎÏÐÑÒÓÔÕÖØÙÚÛÜÝÞŒŠŽŸẞąćęłńśźżĄĆĘŁŃŚŹŻčďěňřťůČĎĚŇŘŤŮőűŐŰğışĞİŞ" "“”‘’„‚«»‹›–—…•·°©®™€£¥¢§¶¡¿½¼¾×÷±²³µªº ­→←−≈≤≥☰★✓ﬁﬂ")
#: Scripts written without blanks, which stand in one text.
EAST = frozenset(("CJK", "HIRAGANA", "KATAKANA", "HANGUL", "IDEOGRAPHIC", "BOPOMOFO", "KATAKANA-HIRAGANA"))
DEPTH = 4

#: What reading a Cyrillic line anew must gain, over all its letters.
SWAP_GAIN = 4.0

_RUN = re.compile(r"[^\x00-\x7f]+")
#: Strictly valid multi-byte characters of UTF-8.
_UTF8 = re.compile(rb"(?:[\xc2-\xdf][\x80-\xbf]|\xe0[\xa0-\xbf][\x80-\xbf]|[\xe1-\xec\xee\xef][\x80-\xbf]{2}|\xed[\x80-\x9f][\x80-\xbf]|\xf0[\x90-\xbf][\x80-\xbf]{2}|[\xf1-\xf3][\x80-\xbf]{3}|\xf4[\x80-\x8f][\x80-\xbf]{2})+")
_OPEN, _CLOSE = "“\"'‘«„‹(`", "”\"'’»“›)`"
#: A lead byte of two whose follower became a plain blank or was stripped.
_STRAY = re.compile(r"(?<![A-ZÀ-ÖØ-Þ])[ÃÂ](?=[ \t\r]|$)|(?<=[a-zà-ÿ])[ÃÂ](?=[a-z])|â[¦¬¢]|(?<=\s)â(?=\s)")
#: A Russian word as it is written.
_PLAIN = re.compile("[А-ЯЁ]?[а-яё]+")
_LOST = re.compile("�+")
_CYR_LIKE = re.compile(r"[Ѐ-џÀ-ÿ─-▟\u0080-¿]{2,}")


def _table(enc: str) -> dict[str, int]:
    """Character -> byte; bytes without a character stand for the control character of that number."""
    out = {}
    for b in range(0x80, 0x100):
        try:
            out[bytes([b]).decode(enc)] = b
        except UnicodeDecodeError:
            out[chr(b)] = b
    if enc in ("cp1252", "cp1254", "cp1250", "cp1251"):
        for b in range(0x80, 0xA0):
            out.setdefault(chr(b), b)
    return out


_BYTES = {enc: _table(enc) for enc in LEGACY}


@lru_cache(100_000)
def _class(ch: str) -> tuple[float, str]:
    """Cost of a character and, for letters and their marks, its script."""
    if ch in COMMON:
        return 1.0, "LATIN" if ch.isalpha() else ""
    if "\u0300" <= ch <= "\u036f":
        return 1.0, ""
    kind = unicodedata.category(ch)
    if kind[0] in "LM" and not "\ufe00" <= ch <= "\ufe0f":
        script = unicodedata.name(ch, "?").split(" ")[0]
        if script == "LATIN":
            # Vietnamese and the like; the phonetic letters are no text.
            return (1.0, "LATIN-MORE") if ch <= "\u017f" or "\u1e00" <= ch <= "\u1eff" or ch in "ơưƠƯșțȘȚ" else (2.5, "LATIN")
        return 1.0, "EAST" if script in EAST else script
    if kind == "Cc" or ch == "\ufffd":
        return 4.0, ""
    if kind in ("Cn", "Co", "Cs"):
        return 6.0, ""
    if kind == "Cf" or "\ufe00" <= ch <= "\ufe0f":
        return 1.0, ""
    if "\u2010" <= ch <= "\u22ff" or "\u2600" <= ch <= "\u27bf" or "\U0001f000" <= ch <= "\U0001faff":
        return 1.5, ""
    if "\u3000" <= ch <= "\u303f" or "\uff00" <= ch <= "\uffef":
        return 1.0, ""
    return (2.0 if kind == "Nd" else 3.0), ""


def cost(text: str, found: frozenset | None = None) -> float:
    """Garbling cost of a run of non-ASCII characters; ``found`` names scripts the value is known to hold, none given all."""
    total, last = 0.0, ""
    for ch in text:
        c, script = _class(ch)
        total += c
        if found is not None and script not in ("", "LATIN", last) and script not in found:
            # A stray letter of three bytes comes from a letter and two marks, of two from a letter and one.
            total += 0.4 if script == "GREEK" else 0.6 if script == "LATIN-MORE" else 2.0 if ch >= "\u0800" else 1.0
        last = script
    return total


@lru_cache(200_000)
def unwrap(run: str, depth: int = DEPTH, found: frozenset = frozenset()) -> str | None:
    """The run with its layers taken off, or None if no reading costs less."""
    if run.isalpha() and run.islower() or _PLAIN.fullmatch(run):
        return None  # a plain word; lead bytes never look like that throughout
    best, least = None, cost(run) - 0.5
    for enc in LEGACY:
        table = _BYTES[enc]
        try:
            raw = bytes([table[ch] for ch in run])
            text = raw.decode("utf-8")
        except (KeyError, UnicodeDecodeError):
            continue
        if depth > 1:
            text = _RUN.sub(lambda m: unwrap(m.group(), depth - 1, found) or m.group(), text)
        c = cost(text, found)
        # A reading must give characters that text holds, not merely fewer.
        if c < least and all(_class(ch)[0] < 2.5 for ch in text if ch >= "\x80"):
            best, least = text, c
    return best


@lru_cache(200_000)
def _pieces(run: str, found: frozenset = frozenset()) -> str | None:
    """A run in which damage and sound text touch: the parts that are valid UTF-8 under an encoding are undone."""
    whole = unwrap(run, DEPTH, found)
    if whole is not None or len(run) < 3:
        return whole
    for enc in LEGACY:
        table = _BYTES[enc]
        raw = bytes([table.get(ch, 0) for ch in run])
        out, at = [], 0
        for m in _UTF8.finditer(raw):
            lo, hi = m.span()
            if hi - lo < len(run) and (got := unwrap(run[lo:hi], DEPTH, found)) is not None:
                rest = run[at:lo]
                out += [_pieces(rest, found) or rest, got]
                at = hi
        if out:
            rest = run[at:]
            return "".join([*out, _pieces(rest, found) or rest])
    return None


def scripts_of(text: str) -> set[str]:
    """Scripts of the letters of a text that single letters do not prove."""
    return {script for ch in text if ch >= "\x80" and (script := _class(ch)[1]) and script != "LATIN"}


def _russian(text: str) -> float:
    """Mean cost per letter as Russian; change of case within a word costs extra."""
    total, n, last = 0.0, 0, ""
    for ch in text:
        low = ch.lower()
        if "Ѐ" <= low <= "џ":
            total += log(11 / RUSSIAN.get(low, 0.01))
            if last and last.islower() and ch.isupper():
                total += 2.0
            n += 1
            last = ch
        elif ch.isalpha() or "─" <= ch <= "▟":
            total += 5.0 if ord(ch) > 127 else 0.0
            n += ord(ch) > 127
            last = ""
        else:
            last = ""
    return total / n if n else 9.0


def _swap(line: str, found: frozenset) -> tuple[str, str] | None:
    """A line whose Cyrillic was read in another Cyrillic (or a western) encoding, and the name of the pair.

    A letter as it stands (marks prove nothing) counts for one unit of evidence at
    most; where the value holds
    lines of the same pair, none is asked for.
    """
    words = _CYR_LIKE.findall(line)
    letters = "".join(words)
    if not letters or len(letters) * 3 < sum(map(str.isalpha, line)):
        return None
    joined = " ".join(words)
    now = _russian(joined)
    if now < 1.2:
        return None
    best, least, which = None, now - 0.5, None
    for wrote, read in CYRILLIC:
        try:
            text = joined.encode(read).decode(wrote)
        except (UnicodeEncodeError, UnicodeDecodeError):
            continue
        c = _russian(text)
        if c < least and c < 1.7 and (f"{wrote}>{read}" in found or sum(map(str.isalpha, letters)) * min(now - c, 1.0) >= SWAP_GAIN):
            best, least, which = text, c, (wrote, read)
    if best is None:
        return None
    wrote, read = which

    def back(m: re.Match) -> str:
        try:
            return m.group().encode(read).decode(wrote)
        except (UnicodeEncodeError, UnicodeDecodeError):
            return m.group()

    return re.sub(r"[^\x00-\x7f]+", back, line), f"{wrote}>{read}"


def _quoted(line: str, lo: int, hi: int) -> bool:
    return lo > 0 and hi < len(line) and line[lo - 1] in _OPEN and line[hi] in _CLOSE


def _fix_line(line: str, found: frozenset, gained: set[str]) -> tuple[str, bool, bool]:
    """Restored line, whether it was damaged, and whether all of it could be restored; scripts restored are added to ``gained``."""
    if line.isascii():
        return line, False, True
    hurt, whole = False, True
    lost = any(not _quoted(line, *m.span()) for m in _LOST.finditer(line))
    swap = _swap(line, found)
    if swap is not None:
        runs = _RUN.findall(line)
        if sum(unwrap(r, DEPTH, found) is not None for r in runs) * 2 < len(runs):
            gained.add(swap[1])
            return swap[0], True, not lost
    out, at = [], 0
    for m in _RUN.finditer(line):
        lo, hi = m.span()
        run = m.group()
        # Quote marks that belong to the sentence, not to the run.
        a, b = 0, len(run)
        while a < b and run[a] in "“‘«„‹":
            a += 1
        while b > a and run[b - 1] in "”’»›":
            b -= 1
        got = None
        full = unwrap(run, DEPTH, found)
        if full is not None:
            if not _quoted(line, lo, hi):
                got = full
        elif (a or b < len(run)) and a < b:
            inner = run[a:b]
            fixed = _pieces(inner, found)
            if fixed is not None and not (a and b < len(run)):
                got = run[:a] + fixed + run[b:]
        else:
            got = _pieces(run, found)
        if got is not None:
            out += [line[at:lo], got]
            at, hurt = hi, True
            gained |= scripts_of(got)
    line = "".join(out) + line[at:]
    if not line.isascii() and _STRAY.search(line):
        hurt, whole = True, False
    if lost:
        hurt, whole = True, False
    return line, hurt, whole


def repair(text: str | None) -> tuple[str | None, bool, bool]:
    """Restored text, whether it was damaged, whether it is restored in full."""
    if not text or text.isascii():
        return text, False, True
    found: frozenset = frozenset()
    while True:
        gained: set[str] = set()
        fixed = [_fix_line(line, found, gained) for line in text.split("\n")]
        if gained <= found:
            break
        found |= gained
    hurt = any(f[1] for f in fixed)
    return ("\n".join(f[0] for f in fixed) if hurt else text), hurt, all(f[2] for f in fixed)


def garbled(df: DataFrame, id_col: str, fields: list[str], with_text: bool = True) -> DataFrame:
    """``(id, field, whole[, restored])`` of the values that hold wrongly decoded text."""
    src = df.select(F.col(id_col).alias("id"), F.explode(F.array(*[F.struct(F.lit(f).alias("field"), F.col(f).alias("value")) for f in fields])).alias("x")).select("id", "x.field", "x.value").where(F.col("value").rlike(r"[^\x00-\x7f]"))
    kind = src.schema["id"].dataType.simpleString()

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for pdf in batches:
            rows = []
            for key, field, value in pdf.itertuples(index=False, name=None):
                text, hurt, whole = repair(value)
                if hurt:
                    rows.append((key, field, whole, text) if with_text else (key, field, whole))
            yield pd.DataFrame(rows, columns=["id", "field", "whole", *["restored"] * with_text])

    return src.mapInPandas(run, f"id {kind}, field string, whole boolean" + ", restored string" * with_text).withColumnRenamed("id", id_col)
