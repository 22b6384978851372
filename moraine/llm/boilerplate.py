"""Page boilerplate mixed with main content (problem 2).

Host suffix array. The pages of a host are concatenated into one stream of
tokens, with tokens of their own for the ends of lines and of pages (numbers and
the site's own name are placeholders), and the suffixes of the stream that begin
at a line are sorted, as are those of the reversed stream that begin at a line's
end. Neighbours in that order share their longest runs, which gives for every
line the longest run from its beginning, on over the following lines, and from
its end backwards, that stands in several distinct pages of the host. Copies of
a page within a host, whole or reworked, count as one page. Hosts of many pages
are cut into shards of bounded size, each of which has a suffix array of its own.

Runs are then weighed. A block of two lines or more that several pages repeat
line by line is boilerplate, and so is a line that stands on more of a host's
pages, added up over its shards, than the share of other hosts' pages explains:
it is cut on that host, and everywhere only once it belongs to several hosts, or
if its share of a language's pages differs from host to host far more than
chance allows, or is large altogether. Headings that a host repeats on some
pages are thus kept on all others. Openings (or closings) of short lines are
weighed over all hosts alike: article text draws on the same stock everywhere,
templates belong to hosts. A line is boilerplate if such a run covers it; if it
leads the page's own title in a path; or if it belongs to a list of titles
introduced by a boilerplate line of a kind that usually introduces such lists.
Everything else is kept as main content.

The page's own title is never boilerplate. Shares are taken per language, as
pages of a language gather on few hosts.

Defined cases: null and blank bodies have no lines; pages without a url share
no host with others but are matched against the runs of all hosts; a page
delivered twice counts once; very long lines are compared as a whole; an empty
table gives an empty result; blank lines are never reported.
"""

from __future__ import annotations

import itertools
import re
from collections import Counter, defaultdict
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..runtime import materialize, width
from .encoding import repair
from .site_lines import site_of
from .text import mix

#: Tokens compared from a line's beginning or end; lines of more tokens are only compared as a whole.
DEPTH, SHORT = 24, 22
#: Of lists with more lines than these only the head holds the lines; those within point to it.
LIST = 12
#: Pages of a host, over all its shards, from which a whole line may be its own, and how far (minus log of the chance) beyond other hosts.
HOST_PAGES, HOST_CHANCE = 3, 10.0
#: The same for lines of ``LONG`` tokens or more: the pages of one text, whose copies stand in several shards, share such lines, too.
LONG_PAGES = 5
#: Hosts a whole line must belong to before it is cut on all.
HOSTS = 3
#: Copies are looked for among pages that share a line of so many tokens.
LONG = 30
#: Of the tokens of lines that stand on few pages, and of all tokens, copies share at least so much.
COPY_FEW, COPY_ALL = 0.25, 0.9
#: Lines on more pages than these, and on more than this share of them, stand on many.
MANY, MANY_SHARE = 4, 0.1
#: Lengths of opening and closing runs that are weighed.
OPEN, CLOSE = (2, 3, 4), (4, 6)
#: Marks that part the fields of a line; a run of three tokens from one of them is weighed, too.
MARKS = frozenset("|·»›>/")
STOPS = frozenset(".!?")
#: Function words by language (fixed values), for a rough grouping of pages.
FUNCTION = {
    "en": "the of and to in is a that for it with as on are be this by from at or an was we my has can you your how i if when because before each must only such both whose upon their which not into than may will our do no all some most more",
    "de": "der die das und ist ein eine einen nicht zu den dem mit für auf im von es sei wer sich auch als",
    "fr": "le la les et est une un de des du à pour dans que qui en il on se sur plus depuis",
    "es": "el la los las y es un una de que en por para con del se al lo más como",
    "pt": "o a os as e é um uma de que em por para com do da não no na mais há",
}
_SETS = {k: frozenset(v.split()) for k, v in FUNCTION.items()}
LINE_END = "\n"
_TOKEN, _NUMBER = re.compile(r"[^\W\d_]+|[^\w\s]|[\d_]"), re.compile(r"\d[\d.,]*")
_DAMAGED = re.compile("[\x80-\x9fÃÂâ├┬Γ√¬Ð�Г]|[РВ][^\\sа-яА-ЯёЁa-zA-Z.,]")
#: Marks around a title, and marks before a site's name in it.
_AROUND, _BARS = frozenset("“”\"'«»‹›….*"), frozenset("–—-|·")
_CYRILLIC = re.compile("[Ѐ-ӿ]")
_LEADER = re.compile(r"[>»/|:›·→-]$")


def tokens(line: str) -> list[str]:
    """Lower-case words, marks, and ``#`` for numbers; a closing arrow is dropped."""
    out = _TOKEN.findall(_NUMBER.sub("#", line.lower()))
    while out and out[-1] in "»›→":
        out.pop()
    return out


def site_name(site: str | None) -> list[str]:
    """The words a site calls itself by: the first label of its host."""
    return _TOKEN.findall((site or "").split(".")[0].replace("-", " "))


def title_forms(title: str | None) -> list[list[str]]:
    """A title as lines of the page may show it: without quote marks and dots around it, with and without what follows its last dash or bar."""
    toks = tokens(title or "")
    while toks and toks[-1] in _AROUND:
        toks.pop()
    while toks and toks[0] in _AROUND:
        toks = toks[1:]
    forms = [toks] if toks else []
    bars = [k for k, t in enumerate(toks) if t in _BARS]
    if bars and 0 < bars[-1] and len(toks) - bars[-1] <= 5:
        forms.append(toks[: bars[-1]])
    return forms


def _placed(toks: list[str], name: list[str]) -> list[str]:
    """Tokens with the site's name replaced."""
    if not name or name[0] not in toks:
        return toks
    out, i, n = [], 0, len(name)
    while i < len(toks):
        if toks[i : i + n] == name:
            out.append("@")
            i += n
        else:
            out.append(toks[i])
            i += 1
    return out


def language(toks: list[str], cyrillic: bool = True) -> str:
    """A rough language of a page's tokens: that of the most function words."""
    n = Counter(toks)
    if cyrillic and sum(k for w, k in n.items() if "Ѐ" <= w[0] <= "ӿ") * 2 > sum(k for w, k in n.items() if w[0].isalpha()):
        return "ru"
    score = {k: sum(n[w] for w in s if w in n) for k, s in _SETS.items()}
    best = max(score, key=score.get)
    return best if score[best] else "?"


def run_lengths(windows: np.ndarray, page: np.ndarray, most: int) -> np.ndarray:
    """For each suffix (row of token numbers) its longest prefix that stands in ``most`` distinct pages.

    In the order of the suffix array the suffixes sharing a prefix are
    neighbours; of each such stretch the distinct pages are the suffixes whose
    page does not stand before in the stretch.
    """
    n, depth = windows.shape
    out = np.zeros(n, np.int64)
    if n < most:
        return out
    rows = np.ascontiguousarray(windows.astype(">u4")).view(f"V{4 * depth}").ravel()
    order = np.argsort(rows, kind="stable")
    w, own = windows[order], page[order]
    differ = w[1:] != w[:-1]
    lcp = np.r_[0, np.where(differ.any(1), differ.argmax(1), depth)]
    by_page = np.argsort(own, kind="stable")
    before = np.full(n, -1)
    again = own[by_page[1:]] == own[by_page[:-1]]
    before[by_page[1:][again]] = by_page[:-1][again]
    length = np.zeros(n, np.int64)
    for k in range(1, depth + 1):
        start = np.flatnonzero(lcp < k)
        size = np.diff(np.r_[start, n])
        fresh = before < np.repeat(start, size)
        enough = np.add.reduceat(fresh.astype(np.int64), start) >= most
        if not enough.any():
            break
        length[np.repeat(enough, size)] = k
    out[order] = length
    return out


def copies(held: list[dict[int, int]]) -> list[int]:
    """For each page (the keys of its lines with their tokens) the first page it is a copy of, else itself.

    Lines that stand on many pages say little about what else the pages hold,
    so a quarter of the rest must agree line by line (reworked copies keep
    little more), or else nearly everything. A copy is compared with the first
    of its kind only, so likeness does not chain.
    """
    first = list(range(len(held)))
    long_on = Counter(key for page in held for key, n in page.items() if n >= LONG)
    shared = {key for key, n in long_on.items() if n > 1}
    some = [p for p, page in enumerate(held) if not shared.isdisjoint(page)]
    if len(some) < 2:
        return first
    on = Counter(key for page in held for key in page)
    column: dict[int, int] = {}
    for p in some:
        for key in held[p]:
            if on[key] > 1:
                column.setdefault(key, len(column))
    has = np.zeros((len(some), len(column)), np.float32)
    weight = np.zeros(len(column), np.float32)
    for i, p in enumerate(some):
        for key, n in held[p].items():
            if (c := column.get(key)) is not None:
                has[i, c], weight[c] = 1, n
    many = max(MANY, MANY_SHARE * len(held))
    few = np.array([on[key] <= many for key in column])
    total = np.array([sum(held[p].values()) for p in some])
    rest = np.array([sum(n for key, n in held[p].items() if on[key] <= many) for p in some])
    long = has[:, weight >= LONG]
    both, both_few = (has * weight) @ has.T, (has[:, few] * weight[few]) @ has[:, few].T
    agree = (both >= COPY_ALL * np.maximum.outer(total, total)) | ((both_few > 0) & (both_few >= COPY_FEW * np.maximum.outer(rest, rest)))
    agree &= long @ long.T > 0
    for i, p in enumerate(some):
        for j in np.flatnonzero(agree[i, :i]).tolist():
            if first[some[j]] == some[j]:
                first[p] = some[j]
                break
    return first


def _key(kind: int, toks: list[str]) -> int:
    return xxhash.xxh3_64_intdigest(" ".join(toks).encode("utf-8", "surrogatepass"), kind) - (1 << 63)


class _Line:
    __slots__ = ("page", "no", "toks", "whole", "open", "close", "inner", "title", "own", "path")


def _sound(line: str, mended: dict[str, str]) -> str:
    """A line with wrongly decoded text restored; template lines are looked up."""
    if line.isascii():
        return line
    if line not in mended:
        mended[line] = repair(line)[0]
    return mended[line]


def _like_title(raw: str, toks: list[str]) -> bool:
    return 2 <= len(toks) <= 16 and raw[-1:] not in ".:;," and toks[0] not in ("*", "-", "•", "–")


def _read(raw: str, name: list[str]) -> tuple:
    """Tokens of a line, the same with the site's name replaced, the keys of its runs, and whether it looks like a title."""
    toks = tokens(raw)
    if not toks:
        if not raw.strip():
            return ([],)
        toks = [raw.strip()[:1]]
    placed = _placed(toks, name)
    short = len(placed) <= SHORT
    return (
        toks,
        placed,
        _key(0, placed),
        [_key(k, placed[:k]) for k in OPEN if len(placed) >= k] if short else [],
        [_key(10 + k, placed[-k:]) for k in CLOSE if len(placed) >= k] if short else [],
        [_key(20, placed[k : k + 3]) for k in range(1, len(placed) - 2) if placed[k] in MARKS] if short else [],
        _like_title(raw.strip(), placed),
    )


def weigh(site: str | None, pages: list[tuple[str, str | None, str]], strict: float = 0.03) -> tuple[list[tuple], list[tuple], dict[str, int]]:
    """Lines with their keys, runs with their counts, and pages by language, of one shard.

    Line: (page id, line number, keys, numbers of the title-like lines that follow, path, language, whether it is the first such line of its page and copies, line number of the head of the long list it stands in).
    Run: (language, key, kind, pages with it, pages in all, pages in which a list of titles follows, pages in which it opens a sentence within a line).
    Kinds: 0 whole lines, 2 openings, 3 endings, 4 from a mark.
    """
    name = site_name(site)
    lines: list[_Line] = []
    langs: list[str] = []
    read: dict[str, tuple] = {}
    held: list[dict[int, int]] = []
    mended: dict[str, str] = {}
    for p, (_, title, body) in enumerate(pages):
        if _DAMAGED.search(body):
            body = "\n".join(_sound(line, mended) for line in body.split("\n"))
            title = repair(title)[0]
        own = title_forms(title)
        last_of = {f[-1] for f in own if len(f) > 2}
        words: list[str] = []
        held.append({})
        for no, raw in enumerate(body.split("\n"), 1):
            known = read.get(raw)
            if known is None:
                known = _read(raw, name)
                if len(raw) < 200:
                    read[raw] = known
            toks = known[0]
            if not toks:
                continue
            words += toks
            x = _Line()
            x.page, x.no = p, no
            x.own = toks in own
            # A path: the page's own title after something else.
            x.path = toks[-1] in last_of and any(len(f) > 2 and len(toks) > len(f) and toks[-len(f) :] == f and bool(_LEADER.search(toks[-len(f) - 1])) for f in own)
            _, x.toks, x.whole, x.open, x.close, x.inner, x.title = known
            if x.own:
                x.open, x.close, x.inner = [], [], []
            held[p][x.whole] = len(x.toks)
            lines.append(x)
        langs.append(language(words, bool(_CYRILLIC.search(body))))
    if not lines:
        return [], [], {}

    # Copies are one page to the counts.
    first = copies(held)
    page = np.array([first[x.page] for x in lines])
    n_pages = len(set(page.tolist()))
    # The stream of the host: lines end in a token of their own, pages in one that no other page has.
    number: dict[str, int] = defaultdict(itertools.count(2).__next__)
    number[LINE_END] = 1
    numbered: dict[int, list[int]] = {}
    stream: list[int] = []
    ends = [0]
    for r, x in enumerate(lines):
        ids = numbered.get(x.whole)
        if ids is None:
            # Beyond the windows' depth nothing of a line is compared from its ends.
            toks = x.toks if len(x.toks) <= 2 * DEPTH else x.toks[:DEPTH] + x.toks[-DEPTH:]
            ids = numbered[x.whole] = [*map(number.__getitem__, toks), 1]
        stream += ids
        ends.append(len(stream))
        if r + 1 == len(lines) or lines[r + 1].page != x.page:
            stream[-1] = (1 << 32) - 1 - x.page
    start = np.array(ends)
    flat = np.array([0] * DEPTH + stream + [0] * DEPTH, np.uint32)
    ahead, back = np.arange(DEPTH), -np.arange(DEPTH)
    forward = flat[(start[:-1] + DEPTH)[:, None] + ahead]
    backward = flat[(start[1:] + DEPTH - 2)[:, None] + back]
    # The last line of a page ends as any other.
    size = np.diff(start) - 1
    last = np.flatnonzero(flat[start[1:] + DEPTH - 1] != 1)
    inside = size[last] < DEPTH
    forward[last[inside], size[last[inside]]] = 1
    inside = size[last] + 1 < DEPTH
    forward[last[inside], size[last[inside]] + 1] = flat[start[last[inside] + 1] + DEPTH - 1]
    least = max(3, int(np.ceil(strict * n_pages)))
    loose = run_lengths(forward, page, 3)
    from_start = loose if least == 3 else run_lengths(forward, page, least)
    from_end = run_lengths(backward, page, 3).tolist()
    # Blocks: runs over the ends of lines, which several pages hold line by line.
    block = np.zeros(len(lines) + 1, np.int64)
    past = np.searchsorted(start[1:], start[:-1] + loose, "right")
    many = past - np.arange(len(lines)) >= 2
    np.add.at(block, np.flatnonzero(many), 1)
    np.subtract.at(block, past[many], 1)
    block = (np.cumsum(block)[:-1] > 0).tolist()
    from_start, loose = from_start.tolist(), loose.tolist()
    page = page.tolist()

    certain = [False] * len(lines)
    count: dict[tuple[str, int, int], set] = {}
    lists: dict[tuple[str, int], set] = {}
    within: dict[tuple[str, int], set] = {}
    heads: set[tuple[str, str]] = set()
    follow: list[list[int]] = [[] for _ in lines]
    # Beyond the windows' depth lines are compared as a whole.
    long: dict[int, set] = {}
    for r, x in enumerate(lines):
        if len(x.toks) >= DEPTH and loose[r] >= DEPTH and from_end[r] >= DEPTH:
            long.setdefault(x.whole, set()).add(page[r])
    for r, x in enumerate(lines):
        certain[r] = not x.own and (from_start[r] > len(x.toks) if len(x.toks) < DEPTH else len(long.get(x.whole, ())) >= least)
    entries = [0] * (len(lines) + 1)
    for r in range(len(lines) - 2, -1, -1):
        y = lines[r + 1]
        if y.page == lines[r].page and y.title and not certain[r + 1] and not y.own and not y.path:
            entries[r] = entries[r + 1] + 1
            if entries[r] <= LIST:
                follow[r] = [y.no, *follow[r + 1]]
    head: list[int | None] = [None] * len(lines)
    top = 0
    for r, n in enumerate(entries[:-1]):
        if not r or entries[r - 1] == 0:
            top = r
        if n > LIST:
            head[r] = lines[top].no
            if top == r:
                follow[r] = [lines[k].no for k in range(r + 1, r + n + 1)]
    out = []
    seen: set[tuple[int, int]] = set()
    for r, x in enumerate(lines):
        lang = langs[x.page]
        if not x.own and (loose[r] > len(x.toks) if len(x.toks) < DEPTH else len(long.get(x.whole, ())) >= 3):
            count.setdefault((lang, x.whole, 0), set()).add(page[r])
        # A line known as a whole speaks for its opening only if it has a slot to fill.
        for k, key in zip(OPEN, x.open):
            if loose[r] >= k and (not certain[r] or "@" in x.toks or "#" in x.toks):
                count.setdefault((lang, key, 2), set()).add(page[r])
                heads.add((x.toks[0], x.toks[1]))
        for k, key in zip(CLOSE, x.close):
            if from_end[r] >= k:
                count.setdefault((lang, key, 3), set()).add(page[r])
        for key in x.inner:
            count.setdefault((lang, key, 4), set()).add(page[r])
        if entries[r] and len(x.toks) <= SHORT:
            for key in (x.whole, *x.open):
                lists.setdefault((lang, key), set()).add(page[r])
        if not x.own:
            fresh = (x.whole, page[r]) not in seen
            seen.add((x.whole, page[r]))
            out.append((pages[x.page][0], x.no, [x.whole, *x.open, *x.close, *x.inner] if len(x.toks) <= SHORT else [x.whole], follow[r], bool(x.path) or block[r], lang, fresh, head[r], len(x.toks)))
    # Of the counted openings: the pages in which they open a sentence within a line.
    sentences: dict[int, list[int]] = {}
    for r, x in enumerate(lines):
        toks = x.toks
        if len(toks) < 4:
            continue
        keys = sentences.get(x.whole)
        if keys is None:
            stops = [i for i, t in enumerate(toks[:-3], 1) if t in STOPS and (toks[i], toks[i + 1]) in heads]
            keys = sentences[x.whole] = [_key(k, toks[at : at + k]) for at in stops for k in OPEN if at + k <= len(toks)]
        for key in keys:
            within.setdefault((langs[x.page], key), set()).add(page[r])
    size: dict[str, set] = {}
    for p, lang in enumerate(langs):
        size.setdefault(lang, set()).add(first[p])
    size = {k: len(v) for k, v in size.items()}
    runs = [(lang, key, kind, len(v), size[lang], len(v & lists.get((lang, key), set())), len(within.get((lang, key), ())) if kind == 2 else 0) for (lang, key, kind), v in count.items()]
    return out, runs, size


_SCHEMA = "id string, line_no int, keys array<long>, follow array<int>, path boolean, lang string, fresh boolean, head int, n_toks int, host long, key long, kind int, k int, n int, lists int, inside int, what string"


def _shard_pass(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows of a partition sorted by shard, taken shard by shard; out come lines, and runs and page counts."""

    def shards() -> Iterator[tuple[str | None, list]]:
        at, site, pages = None, None, {}
        for batch in batches:
            for shard, s, key, title, body in zip(*[batch.column(c).to_pylist() for c in ("shard", "site", "id", "title", "body")]):
                if shard != at and at is not None:
                    yield site, pages
                    pages = {}
                at, site = shard, s
                pages.setdefault(key, (key, title, body))
        if pages:
            yield site, pages

    lines: list[tuple] = []
    runs: list[tuple] = []
    for site, pages in shards():
        found, counted, size = weigh(site, [p for _, p in sorted(pages.items())])
        host = None if site is None else xxhash.xxh3_64_intdigest(site.encode("utf-8", "surrogatepass")) - (1 << 63)
        lines += [(*x, host) for x in found]
        runs += [(lang, host, *x) for lang, *x in counted]
        runs += [(lang, host, None, -1, None, n, None, None) for lang, n in size.items()]
        if len(lines) > 20_000:
            yield from _batches(lines, runs)
            lines, runs = [], []
    yield from _batches(lines, runs)


_TYPES = [("id", pa.string()), ("line_no", pa.int32()), ("keys", pa.list_(pa.int64())), ("follow", pa.list_(pa.int32())), ("path", pa.bool_()), ("lang", pa.string()), ("fresh", pa.bool_()), ("head", pa.int32()), ("n_toks", pa.int32()), ("host", pa.int64()), ("key", pa.int64()), ("kind", pa.int32()), ("k", pa.int32()), ("n", pa.int32()), ("lists", pa.int32()), ("inside", pa.int32()), ("what", pa.string())]
_OF_LINES = ("id", "line_no", "keys", "follow", "path", "lang", "fresh", "head", "n_toks", "host")
_OF_RUNS = ("lang", "host", "key", "kind", "k", "n", "lists", "inside")


def _lists(values: tuple[list[int], ...], kind: pa.DataType) -> pa.ListArray:
    flat = np.fromiter(itertools.chain.from_iterable(values), kind.to_pandas_dtype())
    return pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, values)]).astype(np.int32)), pa.array(flat, kind))


def _batches(lines: list[tuple], runs: list[tuple]) -> Iterator[pa.RecordBatch]:
    """One batch of lines and one of runs and page counts, each with nulls for what the other has."""
    for rows, own in ((lines, _OF_LINES), (runs, _OF_RUNS)):
        if rows:
            columns = dict(zip(own, zip(*rows)))
            arrays = []
            for name, kind in _TYPES:
                if name == "what":
                    arrays.append(pa.array(["line" if own is _OF_LINES else "run"] * len(rows)))
                elif name not in columns:
                    arrays.append(pa.nulls(len(rows), kind))
                elif pa.types.is_list(kind):
                    arrays.append(_lists(columns[name], kind.value_type))
                else:
                    arrays.append(pa.array(columns[name], kind))
            yield pa.RecordBatch.from_arrays(arrays, names=[n for n, _ in _TYPES])


def host_lines(rows: DataFrame) -> DataFrame:
    """``(host, lang, key, pages, leads)``: whole lines on more pages of a host, over all its shards, than other hosts' share of such pages explains.

    The chance of so many pages is bounded by that of a Poisson number
    (Chernoff); half a page stands in for lines that no other host has.
    """
    pages = rows.where("what = 'run' AND kind = -1 AND host IS NOT NULL").groupBy("host", "lang").agg(F.sum("n").alias("host_pages"))
    world = pages.groupBy("lang").agg(F.sum("host_pages").alias("world_pages"))
    lines = rows.where("what = 'line' AND fresh AND host IS NOT NULL").select("host", "lang", F.element_at("keys", 1).alias("key"), ((F.size("follow") > 0) | F.col("head").isNotNull()).cast("int").alias("leads"), (F.col("n_toks") >= LONG).alias("long"))
    # One exchange serves both sums.
    per = lines.repartition("key").groupBy("key", "lang", "host").agg(F.count("*").alias("pages"), F.sum("leads").alias("leads"), F.max("long").alias("long"))
    each = per.withColumn("all", F.sum("pages").over(Window.partitionBy("key", "lang")))  # a row per host with the line
    each = each.where(F.col("pages") >= F.when(F.col("long"), LONG_PAGES).otherwise(HOST_PAGES)).join(pages, ["host", "lang"]).join(world, "lang")
    expected = F.col("host_pages") * (F.col("all") - F.col("pages") + 0.5) / F.greatest(F.col("world_pages") - F.col("host_pages"), F.col("host_pages"))
    beyond = F.col("pages") * F.log(F.col("pages") / expected) - F.col("pages") + expected
    return each.where((F.col("pages") > expected) & (beyond >= HOST_CHANCE)).select("host", "lang", "key", "pages", "leads")


def boilerplate_lines(docs: DataFrame, id_col: str = "docid", url_col: str = "url", title_col: str = "title", body_col: str = "body", pages_per_shard: int = 400, spread: float = 4.0, host_share: float = 0.2, world_share: float = 0.08, introduces: float = 0.5) -> DataFrame:
    """``(id, line_no)`` of the non-blank lines that are not main content."""
    spark = docs.sparkSession
    d = docs.select(F.col(id_col).cast("string").alias("id"), site_of(F.col(url_col)).alias("site"), F.col(title_col).alias("title"), F.col(body_col).alias("body")).where(F.col("id").isNotNull() & (F.length("body") > 0))
    # Only hosts of more than one shard; all others are one.
    sizes = docs.select(site_of(F.col(url_col)).alias("of")).groupBy("of").agg(F.ceil(F.count("*") / pages_per_shard).alias("shards")).where(F.col("shards") > 1)
    d = d.join(sizes, F.col("site").eqNullSafe(F.col("of")), "left")
    shard = F.xxhash64("site", F.pmod(F.xxhash64("id"), F.greatest(F.coalesce("shards", F.lit(1)), F.lit(1))))
    d = d.select("id", "site", "title", "body", shard.alias("shard")).repartition(4 * width(spark), "shard").sortWithinPartitions("shard")
    rows = materialize(d.mapInArrow(_shard_pass, _SCHEMA), "lines", by="what")

    world = rows.where("what = 'run' AND kind = -1").groupBy("lang").agg(F.sum("n").alias("all_pages"), F.count("*").alias("shards"))
    runs = rows.where("what = 'run' AND kind >= 0").groupBy("lang", "key", "kind").agg(F.sum("k").alias("pages"), F.sum("lists").alias("lists"), F.sum("inside").alias("inside"), F.sum(F.col("k") * F.col("k") / F.col("n")).alias("square"), F.max(F.when(F.col("k") >= 4, F.col("k") / F.col("n")).otherwise(0)).alias("most"))
    runs = runs.join(world, "lang")
    p = F.col("pages") / F.col("all_pages")
    # Ratio of the variance of a run's share over hosts to what chance allows.
    ratio = F.try_divide(F.col("square") - p * F.col("pages"), p * (1 - p) * F.greatest(F.col("shards") - 1, F.lit(1)))
    anchored = F.col("inside") <= 0.1 * F.col("pages")
    opens = F.col("kind").isin(2, 3, 4) & anchored & (((ratio >= spread) & (F.col("most") >= host_share)) | (F.col("kind").eqNullSafe(2) & (p >= world_share) & (F.col("pages") >= 20)))
    # Whole lines of a language: of some hosts far more than of others, or of many pages whatever the host.
    lines_of_all = (F.col("kind") == 0) & (((ratio >= spread) & (F.col("most") >= host_share)) | ((p >= world_share) & (F.col("pages") >= 20)))
    chosen = runs.where(lines_of_all | opens).groupBy("key").agg((F.sum("lists") >= introduces * F.sum("pages")).alias("intro"))
    own = materialize(host_lines(rows), "host-lines")
    intro = (F.sum("leads") >= introduces * F.sum("pages")).alias("intro")
    # A whole line is cut on the hosts it belongs to, and everywhere once it belongs to several.
    shared = own.groupBy("key").agg(F.count_distinct("host").alias("hosts"), intro).where(F.col("hosts") >= HOSTS).select("key", "intro")
    chosen = materialize(chosen.unionByName(shared).groupBy("key").agg(F.max("intro").alias("intro")), "runs")

    lines = rows.where("what = 'line'")
    hit = lines.select("id", "line_no", "follow", "head", F.explode("keys").alias("key")).join(chosen, "key")
    whole = lines.where("host IS NOT NULL").select("id", "line_no", "follow", "head", "host", F.element_at("keys", 1).alias("key"))
    hit = hit.unionByName(whole.join(own.groupBy("host", "key").agg(intro), ["host", "key"]).select(*hit.columns))
    direct = hit.select("id", "line_no")
    listed = hit.where("intro").select("id", F.explode("follow").alias("line_no"))
    # From within a long list: what its head holds beyond the line.
    inner = hit.where("intro AND head < line_no").select("id", "head", "line_no").groupBy("id", "head").agg(F.min("line_no").alias("after"))
    long = lines.where("head = line_no").select("id", "head", F.explode("follow").alias("line_no"))
    listed = listed.unionByName(long.join(inner, ["id", "head"]).where("line_no > after").select("id", "line_no"))
    paths = lines.where("path").select("id", "line_no")
    kind = docs.schema[id_col].dataType
    return direct.unionByName(listed).unionByName(paths).distinct().select(F.col("id").cast(kind).alias(id_col), "line_no")
