import pytest
from conftest import rows
from pyspark.sql import functions as F

from moraine.llm import mixing as M

TARGETS = "source string, target_share double, max_repeats int"


@pytest.fixture(scope="module")
def docs(spark):
    data = [(i, "word " * (20 + i % 17), "big" if i % 3 == 0 else "mid" if i % 3 == 1 else "small") for i in range(600)]
    data += [(9000 + i, "one two three four five " * 10, "tiny") for i in range(5)]
    data += [(9100, None, "big"), (9101, "", "big"), (9102, "   ", "other"), (9103, "text", None)]
    return spark.createDataFrame([(*d, "x", 1) for d in data], "doc_id long, text string, source string, id string, tokens int")


def test_shares_and_caps(spark, docs):
    t = spark.createDataFrame([("big", 0.5, 2), ("mid", 0.2, 1), ("tiny", 0.3, 3), ("none", 0.0, 1), ("gone", 0.1, 9), ("big", 0.5, 2)], TARGETS)
    chosen, report = M.mix(docs, t)
    total = report.first()
    got = {r.source: r for r in report.collect()}
    assert {k for k, r in got.items() if not r.reachable} == {"tiny", "gone"}
    for k in ("big", "mid"):
        r = got[k]
        assert r.used_tokens <= r.budget < r.used_tokens + 60
        assert r.most_repeats <= r.max_repeats
    assert got["tiny"].used_tokens == 3 * got["tiny"].own_tokens and got["tiny"].epochs == 3
    c = chosen.collect()
    assert max(x.repeats for x in c) <= 3 and {x.source for x in c} == {"big", "mid", "tiny"}
    assert len({x.doc_id for x in c}) == len(c) and total is not None
    for k in ("big", "mid"):  # complete epochs come first: repeats differ by at most one
        n = [x.repeats for x in c if x.source == k]
        assert max(n) - min(n) <= 1


def test_ranges_do_not_change_the_choice(spark, docs):
    t = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.8, 2)], TARGETS)
    r = M.measured(docs, t)
    p = M.plan(r, t)
    assert rows(M.choose(r, p)) == rows(M.choose(r, p, ranges=1)) == rows(M.choose(r, p, ranges=40))


def test_weights_prefer_heavier_records(spark):
    d = spark.createDataFrame([(i, "a b c d e f g h i j", "s", 20.0 if i % 2 else 1.0) for i in range(2000)], "doc_id long, text string, source string, w double")
    t = spark.createDataFrame([("s", 0.25, 1)], TARGETS)
    c, _ = M.mix(d, t, weight=F.col("w"))
    odd = [x.doc_id % 2 for x in c.collect()]
    assert len(odd) == 500 and sum(odd) > 430


@pytest.mark.parametrize("scale", [1e-6, 1.0, 1000.0])
def test_scale_of_weights_is_harmless(spark, docs, scale):
    t = spark.createDataFrame([("big", 0.2, 1), ("mid", 0.8, 2)], TARGETS)
    r = M.measured(docs, t, weight=F.lit(scale))
    got = [tuple(x)[::3] for x in rows(M.choose(r, M.plan(r, t)))]
    one = M.measured(docs, t, weight=F.lit(1.0))
    assert got == [tuple(x)[::3] for x in rows(M.choose(one, M.plan(one, t)))]
    assert r.where("tokens > 0").count() == 400


def test_empty_tables(spark, docs):
    t = spark.createDataFrame([("big", 0.5, 1)], TARGETS)
    chosen, report = M.mix(docs.limit(0), t)
    assert rows(chosen) == [] and report.first().share_of_total is None
    assert rows(M.mix(docs, t.limit(0))[1]) == []
    null = spark.createDataFrame([(None, 0.5, 1), ("big", None, None)], TARGETS)
    assert [(r.source, r.used_tokens) for r in M.mix(docs, null)[1].collect()] == [("big", 0)]


def test_token_count(spark):
    df = spark.createDataFrame([("Hello world",), (None,), ("",), ("<|endoftext|>",)], "t string")
    n = [r[0] for r in df.select(M.token_count("t")).collect()]
    assert n[:3] == [2, 0, 0] and n[3] > 1
