import pytest
from conftest import rows
from pyspark.sql import functions as F

from moraine.functions import text as X

DOC = [("D42", "https://example.com/x", "Example title", "Body text goes here.")]
SCHEMA = "docid string, url string, title string, body string"


def one(spark, strategy, data=DOC, **kw):
    return spark.createDataFrame(data, SCHEMA).select(X.format_document(strategy, **kw)).first()[0]


def test_formats(spark):
    assert one(spark, "body_only") == "Body text goes here."
    assert one(spark, "title_body") == "Example title Body text goes here."
    assert one(spark, "url_title_body") == "https://example.com/x Example title Body text goes here."
    assert one(spark, "tagged") == "<title>Example title</title><body>Body text goes here.</body>"
    assert one(spark, "tagged", template="{{{docid}}} {title}") == "{D42} Example title"


def test_format_strips_and_takes_nulls(spark):
    assert one(spark, "title_body", [("D", None, "  hello  ", "\n\nworld\n")]) == "hello world"
    assert one(spark, "title_body", [("D", None, None, None)]) == ""
    assert one(spark, "tagged", [("D", "u", "{body}", "x")]) == "<title>{body}</title><body>x</body>"


@pytest.mark.parametrize("kw", [{"strategy": "other"}, {"strategy": "tagged", "template": ""}, {"strategy": "tagged", "template": "{nothing}"}])
def test_format_errors(spark, kw):
    with pytest.raises(ValueError):
        X.format_document(**kw)


def test_strip_unicode(spark):
    s = " \t\x1c x　y  \n"
    assert spark.createDataFrame([(s,)], "t string").select(X.strip(F.col("t"))).first()[0] == "x　y" == s.strip()


def test_single_line(spark):
    assert rows(spark.createDataFrame([("a\tb\r\nc",), (None,)], "t string").select(X.single_line(F.col("t")))) == [("",), ("a b  c",)]


@pytest.mark.parametrize("n,size,stride,want", [(10, 5, 5, 2), (10, 4, 2, 4), (0, 4, 2, 1), (4, 4, 4, 1), (5, 4, 4, 2), (3, 4, 1, 1)])
def test_segment_counts(spark, n, size, stride, want):
    df = spark.createDataFrame([(" ".join(map(str, range(n))),)], "t string")
    got = X.segment(df, "t", size, stride).orderBy("passage_idx").collect()
    assert len(got) == want == df.select(X.n_windows(F.lit(n), size, stride)).first()[0]
    covered = {w for r in got for w in r.passage.split()}
    assert covered == set(map(str, range(n)))


def test_segment_errors_and_nulls(spark):
    df = spark.createDataFrame([(None,)], "t string")
    assert [r.passage for r in X.segment(df, "t", 4, 2).collect()] == [""]
    with pytest.raises(ValueError):
        X.segment(df, "t", 4, 5)


def test_windows_of_an_injected_tokenizer(spark):
    from moraine.functions import text as X

    df = spark.createDataFrame([("a", "abcdefgh", 1), ("b", "", 2), ("c", None, 3)], "docid string, body string, passage_idx int")
    got = X.segment_with(df, "body", list, "".join, 4, 3).orderBy("docid", "passage_idx").collect()
    assert [(r.docid, r.passage_idx, r.passage) for r in got] == [("a", 0, "abcd"), ("a", 1, "defg"), ("a", 2, "gh"), ("b", 0, ""), ("c", 0, "")]
