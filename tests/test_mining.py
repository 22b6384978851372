import pytest
from conftest import rows

from moraine.operators import mining as M


def test_triples(spark):
    run = spark.createDataFrame([("q", d, i) for i, d in enumerate("abcdef")], "qid string, docid string, ord int")
    pos = spark.createDataFrame([("q", "b"), ("q", "z"), ("r", "a")], "qid string, docid string")
    pool = M.negative_pool(run, pos)
    assert [r.docid for r in pool.orderBy("ord").collect()] == list("acdef")
    assert rows(M.triples(pos, pool, 2, "top").select("pos", "neg", "k")) == [("b", "a", 1), ("b", "c", 2), ("z", "a", 1), ("z", "c", 2)]
    got = rows(M.triples(pos, pool, 3))
    assert got == rows(M.triples(pos, pool, 3)) and len(got) == 6 and not {r[2] for r in got} & {"b"}
    with pytest.raises(ValueError):
        M.triples(pos, pool, 1, "other")
    first = spark.createDataFrame([("b", "b_p0"), ("a", "a_p0")], "docid string, pid string")
    assert rows(M.to_passages(M.triples(pos, pool, 2, "top"), first).select("pos", "neg")) == [("b_p0", "a_p0")]


def test_nway(spark):
    s = spark.createDataFrame([("q", "a", 3.0, 1), ("q", "b", 2.0, 2), ("q", "c", 2.0, 3), ("q", "d", 1.0, 4), ("p", "a", 1.0, 1), ("p", "b", 0.5, 2), ("p", "c", 0.1, 3), ("few", "a", 1.0, 1)], "qid string, pid string, score double, rank int")
    pos = spark.createDataFrame([("q", "c"), ("q", "d")], "qid string, pid string")
    got = {r.qid: (r.pids, r.scores, r.positive_idx) for r in M.nway_tuples(s, pos, 3).collect()}
    assert got == {"q": (["c", "a", "b"], [2.0, 3.0, 2.0], 0), "p": (["a", "b", "c"], [1.0, 0.5, 0.1], 0)}


def test_score_pairs_in_batches(spark):
    df = spark.createDataFrame([(str(i), "t" * i) for i in range(10)], "query string, text string")
    got = M.score_pairs(df, lambda pairs: [len(t) for _, t in pairs], 3)
    assert sorted(r.score for r in got.collect()) == [float(i) for i in range(10)]


def test_tuple_texts_strict(spark):
    t = spark.createDataFrame([("q", ["b", "a"])], "qid string, pids array<string>")
    c = spark.createDataFrame([("a", "A"), ("b", "B")], "pid string, text string")
    assert [(r.n, r.text) for r in M.tuple_texts(t, c).orderBy("n").collect()] == [(0, "B"), (1, "A")]
    with pytest.raises(Exception, match="unknown passage"):
        M.tuple_texts(t, c.where("pid = 'a'")).collect()


def test_drawn_negatives_are_different_and_from_the_pool(spark):
    pos = spark.createDataFrame([("q", f"p{i}") for i in range(40)] + [("few", "p0"), ("none", "p0")], "qid string, docid string")
    pool = spark.createDataFrame([("q", f"n{i:03}", i) for i in range(300)] + [("few", "a", 0), ("few", "b", 1)], "qid string, docid string, ord int")
    t = M.triples(pos, pool, 5, "random").collect()
    by = {}
    for r in t:
        by.setdefault((r.qid, r.pos), []).append(r.neg)
    assert all(len(v) == len(set(v)) == 5 for (q, _), v in by.items() if q == "q") and len(by) == 41
    assert sorted(by["few", "p0"]) == ["a", "b"]
    assert len({n for (q, _), v in by.items() if q == "q" for n in v}) > 100
    assert sorted(map(tuple, t)) == sorted(map(tuple, M.triples(pos.repartition(7), pool.repartition(5), 5, "random").collect()))
