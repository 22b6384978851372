from conftest import rows
from hypothesis import given, settings
from hypothesis import strategies as st

from moraine.llm import splitter as S


def check(text, limit, overlap):
    cut = S.spans(text, limit, overlap)
    if len(text) <= limit:
        assert cut == [(0, len(text))]
        return cut
    assert cut[0][0] == 0 and cut[-1][1] == len(text) and len(cut) > 1
    for s, e in cut:
        assert 0 < e - s <= limit
    for (a, b), (c, d) in zip(cut, cut[1:]):
        assert a < c <= b < d and abs((b - c) - overlap) <= overlap / 4 + 1
    return cut


@given(st.text(alphabet="ab .,\n!é", max_size=900), st.integers(40, 200))
@settings(max_examples=150, deadline=None)
def test_pieces_are_within_limits(text, limit):
    check(text, limit, limit // 10)


def test_cuts_at_paragraphs():
    text = "\n\n".join("A sentence of words. Another one, with a comma; and more of it." * 10 for _ in range(5))
    cut = check(text, 2000, 200)
    assert all(text[:e].rstrip() + "\n\n" == text[:e] for _, e in cut[:-1])


def test_without_any_boundary_and_very_long():
    assert len(check("x" * 100_000, 2000, 200)) == 56
    check("word " * 20_000, 2000, 200)
    check("é" * 2001, 2000, 200)
    check("." + " " * 100_000 + "x", 2000, 200)
    check("a" + "\n" * 100_000 + "x" + " \n" * 50_000 + "x", 2000, 200)
    assert S.spans("", 2000, 200) == [(0, 0)] and len(S.spans("y" * 2001, 2000, 0)) == 2


def test_operator(spark):
    long = "Words and words. " * 200
    df = spark.createDataFrame([("a", None, long), ("b", "t", "short"), ("c", None, None), ("d", " " * 3000, "x"), ("a", None, long)], "docid string, title string, body string").selectExpr("*", "1 AS id", "2 AS part0", "'z' AS text")
    got = S.split_oversized(df, "docid", ["title", "body"])
    assert {r.docid for r in got.collect()} == {"a"}
    text = long.strip()
    for r in got.collect():
        assert r.piece == text[r.start : r.end] and len(r.piece) <= 2000
    assert rows(S.split_oversized(df.limit(0), "docid", ["title", "body"], with_text=False)) == []


def test_arguments():
    import pytest

    with pytest.raises(ValueError):
        S.split_oversized(None, "docid", [], 100, 60)
