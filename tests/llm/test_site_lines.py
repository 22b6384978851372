from collections import defaultdict

from conftest import rows
from pyspark.sql import functions as F

from moraine.llm import site_lines as S

SCHEMA = "docid string, url string, body string"


def test_site_of(spark):
    urls = {
        "https://www.Shop.Example:8080/a?b#c": "shop.example",
        "http://m.shop.example": "shop.example",
        "HTTP://SHOP.EXAMPLE/": "shop.example",
        "//user@shop.example/x": "shop.example",
        "shop.example/x": "shop.example",
        "https://www.m.shop.example": "m.shop.example",
        "": None,
        None: None,
    }
    df = spark.createDataFrame([(u,) for u in urls], "url string")
    assert {r[0]: r[1] for r in df.select("url", S.site_of(F.col("url"))).collect()} == urls


def corpus():
    docs = []
    for site, n in (("a.example", 40), ("b.example", 120), ("c.example", 6)):
        for i in range(n):
            lines = ["  Share THIS, now! 7", f"own text {site} {chr(97 + i % 26)}{chr(97 + i // 26)}", ""]
            if site == "b.example" and i < 4:
                lines.append("rare line")
            if site == "b.example" and i % 20 == 0:
                lines.append("five or six 6")
            docs.append((f"{site}{i}", f"https://www.{site}:80/{i}", "\n".join(lines)))
    return docs


def brute(docs):
    import re

    n, c = defaultdict(set), defaultdict(set)
    host = lambda u: re.sub(r"^(www|m)\.", "", re.match(r"https?://([^/:]+)", u)[1])
    key = lambda s: "".join(ch for ch in s.lower() if ch.isalpha())
    for d, u, b in docs:
        if not u:
            continue
        n[host(u)].add(d)
        for line in (b or "").split("\n"):
            if key(line):
                c[host(u), key(line)].add(d)
    return sorted({(d, i) for d, u, b in docs if u for i, line in enumerate((b or "").split("\n"), 1) if key(line) and len(c[host(u), key(line)]) >= max(5, 0.02 * len(n[host(u)]))})


def test_against_brute_force(spark):
    docs = corpus() + [("a.example0", "https://a.example", corpus()[0][2]), ("x", None, "share this now"), ("y", "http://b.example", None)]
    extra = [(None, "https://a.example", "share this now")]
    assert rows(S.repeated_lines(spark.createDataFrame(docs + extra, SCHEMA))) == brute(docs)
    got = rows(S.repeated_lines(spark.createDataFrame(docs, SCHEMA)))
    assert got == brute(docs) and ("b.example0", 4) not in got


def test_one_site_and_empty(spark):
    docs = [d for d in corpus() if "a.example" in d[0]]
    assert rows(S.repeated_lines(spark.createDataFrame(docs, SCHEMA))) == brute(docs)
    assert rows(S.repeated_lines(spark.createDataFrame([], SCHEMA))) == []
    assert rows(S.repeated_lines(spark.createDataFrame([("a", None, None), ("b", "u.example", "1\n2\n" * 5)], SCHEMA))) == []


def test_clashing_columns_and_reassembly(spark):
    df = spark.createDataFrame([(*d, "s", "k", 1) for d in corpus()], SCHEMA + ", site string, key string, id int")
    bad = S.repeated_lines(df)
    assert rows(bad) == brute(corpus())
    clean = {r.docid: r for r in S.without_lines(df, bad).collect()}
    assert clean["b.example0"].body == "own text b.example aa\n\n" and clean["b.example0"].lines_cut == 2 or clean["b.example0"].body.startswith("own text")
    assert len(clean) == len(corpus())
    whole = S.without_lines(spark.createDataFrame([("z", None), ("y", "")], "docid string, body string"), bad)
    assert {r.docid: (r.body, r.lines_cut) for r in whole.collect()} == {"z": (None, 0), "y": ("", 0)}


def test_the_test_decides(spark):
    """A phrase as frequent elsewhere as here stays, though it recurs here; one that is only this site's goes."""
    docs = []
    for site in range(41):
        for i in range(200):
            lines = [f"text {chr(97 + site % 26)}{chr(98 + site // 26)} {chr(97 + i % 26)}{chr(98 + i // 26)}"]
            if i < (5 if site == 0 else 4):
                lines.append("a common saying")
            if site == 0 and i < 5:
                lines.append("our own notice")
            docs.append((f"{site}-{i}", f"http://s{site}.example/{i}", "\n".join(lines)))
    df = spark.createDataFrame(docs, SCHEMA)
    want = {f"0-{i}" for i in range(5)}
    got = rows(S.repeated_lines(df))
    assert got == sorted((d, 3) for d in want)
    assert {(d, 2) for d in want} | set(got) == set(brute(docs))  # the bare rule would take both
    lines = S.site_lines(df)
    t = {r.score > 3: r for r in S.line_tests(lines, S.site_sizes(df)).collect()}
    assert t[False].outside_docs == 160 and t[False].outside == 8000 and t[True].outside_docs == 0
