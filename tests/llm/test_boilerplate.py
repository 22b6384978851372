import random

import numpy as np
from conftest import rows

from moraine.llm import boilerplate as B

SCHEMA = "docid string, url string, title string, body string"


def corpus(n_hosts=6, pages=30, seed=3):
    r = random.Random(seed)
    words = [a + b for a in ("bar", "tel", "mon", "sil", "cor", "ven") for b in ("a", "eno", "ica", "or", "um", "ist", "aly")]
    sentence = lambda: "The " + " ".join(r.choice(words) for _ in range(12)) + f" number {r.randrange(999)}."
    docs, want = [], set()
    for h in range(n_hosts):
        for p in range(pages):
            title = f"{r.choice(words)} {r.choice(words)} and {r.choice(words)} {p}"
            lines = [f"Home | Host{h} | Contact", title]
            bad = {1}
            for _ in range(r.randrange(3, 6)):
                lines += ["", " ".join(sentence() for _ in range(3))]
            lines += [" ".join(r.choice(words) for _ in range(6)) + "."]
            for extra in (f"Tags: {r.choice(words)}, {r.choice(words)}" if h % 2 else f"Filed under {r.choice(words)}", f"{r.randrange(50)} comments", f"© {2000 + p % 20} Host{h}. All rights reserved."):
                lines.append(extra)
                bad.add(len(lines))
            key = f"h{h}p{p:02}"
            docs.append((key, f"https://www.host{h}.example/{p}", title, "\n".join(lines)))
            want |= {(key, k) for k in bad}
    return docs, want


def test_planted_boilerplate(spark):
    docs, want = corpus()
    got = set(rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA))))
    assert len(got & want) >= 0.98 * len(want)
    assert len(got - want) <= 0.01 * len(want)


def test_shards_of_a_large_host_agree(spark):
    docs, want = corpus(3, 60)
    got = set(rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA), pages_per_shard=20)))
    assert len(got & want) >= 0.97 * len(want)


def test_edge_cases(spark):
    docs = [("a", None, None, None), ("b", "http://x.example", "t", ""), ("c", "http://x.example", None, " \n\n "), (None, "u", "t", "x"), ("d", None, "t", "only line"), ("d", None, "t", "only line"), ("e", "http://x.example", "t", "word " * 30_000)]
    assert rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA))) == []
    assert rows(B.boilerplate_lines(spark.createDataFrame([], SCHEMA))) == []


def test_clashing_columns(spark):
    docs, _ = corpus(2, 8)
    df = spark.createDataFrame([(*d, 1, 2, 3, "x") for d in docs], SCHEMA + ", id int, shard int, site int, key string")
    plain = spark.createDataFrame(docs, SCHEMA)
    assert rows(B.boilerplate_lines(df)) == rows(B.boilerplate_lines(plain))


def test_run_lengths_against_brute_force():
    rng = np.random.default_rng(1)
    w = rng.integers(1, 4, (80, 6)).astype(np.uint32)
    page = rng.integers(0, 25, 80)
    got = B.run_lengths(w, page, 3)
    for i in range(80):
        want = 0
        for k in range(1, 7):
            if len({page[j] for j in range(80) if (w[j, :k] == w[i, :k]).all()}) >= 3:
                want = k
        assert got[i] == want


def test_title_forms():
    assert B.title_forms("“How to knit?” ") == [["how", "to", "knit", "?"]]
    assert B.title_forms("How to knit – My Site") == [["how", "to", "knit", "–", "my", "site"], ["how", "to", "knit"]]
    assert B.title_forms("How to knit…") == [["how", "to", "knit"]] and B.title_forms(None) == [] and B.title_forms("…") == []


def test_notice_on_all_pages_does_not_unite_them(spark):
    docs, want = corpus(1)
    notice = "This site uses cookies " + " ".join(f"and{chr(97 + k % 26)}{chr(97 + k // 26)}" for k in range(36)) + "."
    assert len(B.tokens(notice)) >= 40
    docs = [(key, url, title, body + "\n" + notice) for key, url, title, body in docs]
    want |= {(key, body.count("\n") + 1) for key, _, _, body in docs}
    got = set(rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA))))
    assert {(key, body.count("\n") + 1) for key, _, _, body in docs} <= got
    assert len(got & want) >= 0.8 * len(want)


def test_copies_share_most_of_their_text():
    page = lambda *own, text=100: {0: 40, 1: 5, **{k: text for k in own}}
    assert B.copies([page(10 + p) for p in range(20)]) == list(range(20))
    assert B.copies([page(10 + p, text=31) for p in range(20)]) == list(range(20))
    assert B.copies([page(10, 11, 12), page(10, 11, 13), *[page(20 + p) for p in range(8)]])[:3] == [0, 0, 2]
    assert B.copies([page(10, 11), page(11, 12), page(12, 13)]) == [0, 0, 2] and B.copies([page(*range(10 * p, 10 * p + 10), 99) for p in range(3)]) == [0, 1, 2]
    assert B.copies([{}, {1: 3}]) == [0, 1]


def test_whole_lines_of_a_large_host_add_up_over_its_shards(spark):
    docs, _ = corpus(2, 400)
    own, stock = "Sign up to our weekly letter today.", "More about this in what follows below."
    docs = [(key, url, title, "\n".join([body, *[own] * (key[:2] == "h0" and k % 50 == 0), *[stock] * (k % 50 == 1)])) for k, (key, url, title, body) in enumerate(docs)]
    for per_shard in (400, 200):
        got = set(rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA), pages_per_shard=per_shard)))
        at = lambda line: {(key, no) for key, _, _, body in docs for no, x in enumerate(body.split("\n"), 1) if x == line}  # noqa: E731, B023
        assert len(at(own)) == 8 and at(own) <= got
        assert len(at(stock)) == 16 and not at(stock) & got


def test_long_lists_are_cut_as_short_ones(spark):
    docs, _ = corpus(3, 20)
    r = random.Random(4)
    name = lambda: "".join(r.choice("bdfgklmnprst") + r.choice("aeiou") for _ in range(4))
    listed, kept, out = set(), set(), []
    for key, url, title, body in docs:
        # A poem has no leader; the list of related titles has one on every page.
        lines = [*body.split("\n"), f"{name()} wrote what {name()} had said to {name()}.", *[f"{name()} {name()}" for _ in range(15)], "It ended there.", "Related articles", *[f"{name()} {name()} {name()}" for _ in range(20)]]
        n = len(lines)
        listed |= {(key, k) for k in range(n - 19, n + 1)}
        kept |= {(key, k) for k in range(n - 36, n - 21)}
        out.append((key, url, title, "\n".join(lines)))
    got = set(rows(B.boilerplate_lines(spark.createDataFrame(out, SCHEMA))))
    assert listed <= got
    assert len(kept) == 15 * 60 and not kept & got


def test_a_heading_one_host_repeats_is_kept_on_the_others(spark):
    docs, _ = corpus(4, 40)
    heads = ("Introduction", "Materials and methods")
    plain = []
    for k, (key, url, title, body) in enumerate(docs):
        host, lines = key[:2], body.split("\n")
        if host == "h0":  # no template at all
            lines = [x for x in lines[1:-3] if x]
        if k % 40 < (4 if host == "h0" else 2):
            lines[2:2] = [heads[0]]
            lines[4:4] = [heads[1]]
        plain.append((key, url, title, "\n".join(lines)))
    got = set(rows(B.boilerplate_lines(spark.createDataFrame(plain, SCHEMA))))
    at = {(key, no) for key, _, _, body in plain for no, x in enumerate(body.split("\n"), 1) if x in heads}
    assert len(at) == 2 * (4 + 3 * 2) and not {x for x in at if x[0][:2] != "h0"} & got


def test_one_shard_or_ten_give_the_same_verdict(spark):
    docs, _ = corpus(2, 200)
    foot = "Read our rules before you write to us."
    docs = [(key, url, title, "\n".join([body, *[foot] * (key[:2] == "h1" and k % 25 == 3)])) for k, (key, url, title, body) in enumerate(docs)]
    at = {(key, no) for key, _, _, body in docs for no, x in enumerate(body.split("\n"), 1) if x == foot}
    assert len(at) == 8
    for per_shard in (200, 20):
        assert at <= set(rows(B.boilerplate_lines(spark.createDataFrame(docs, SCHEMA), pages_per_shard=per_shard)))


def test_runs_go_on_over_the_ends_of_lines():
    """A block that three pages share is found as a block; its lines apart are not."""
    own = lambda p: [f"{chr(97 + p % 26)}{chr(97 + p // 26)}x stands alone here."]
    block = ["Read on", "Write to us"]
    pages = [(f"p{p}", None, "\n".join([*own(p), *(block if p < 3 else block[:1] if p < 5 else []), *own(p + 50)])) for p in range(200)]
    lines, _, _ = B.weigh("x.example", pages)
    assert {(x[0], x[1]) for x in lines if x[4]} == {(f"p{p}", no) for p in range(3) for no in (2, 3)}
