import pytest

from moraine.operators import losses as L
from moraine.operators import metrics as M

RUN = [("r", "q1", d, n + 1) for n, d in enumerate(["10", "20", "30", "40"])] + [("r", "q2", d, n + 1) for n, d in enumerate(["50", "60", "70"])] + [("r", "q3", d, n + 1) for n, d in enumerate(["80", "90"])]
QRELS = [("q1", "10", 1), ("q1", "30", 1), ("q2", "60", 1), ("q3", "100", 1)]


@pytest.fixture(scope="module")
def data(spark):
    return spark.createDataFrame(RUN, "run string, qid string, pid string, rank int"), spark.createDataFrame(QRELS, "qid string, pid string, rel int")


def val(df):
    return df.first()[1]


def test_golden(data):
    run, qrels = data
    assert val(M.mrr_at(run, qrels, 10)) == 0.5
    assert val(M.recall_at(run, qrels, 4)) == 0.666667
    assert val(M.success_at(run, qrels, 4)) == 0.666667
    e = M.evaluate(run, qrels).first()
    assert e.mrr_10 == 0.5 and e.success_5 == 0.666667


def test_ndcg(spark):
    q = spark.createDataFrame([("q", "10", 2), ("q", "20", 1), ("n", "5", 0)], "qid string, pid string, rel int")
    run = lambda a, b: spark.createDataFrame([("r", "q", a, 1), ("r", "q", b, 2)], "run string, qid string, pid string, rank int")
    assert val(M.ndcg_at(run("10", "20"), q)) == 0.5  # the query without gain counts as 0
    assert 0 < val(M.ndcg_at(run("20", "10"), q)) < 0.5


def test_queries_without_positives(spark):
    q = spark.createDataFrame([("a", "1", 1), ("b", "2", 0)], "qid string, pid string, rel int")
    run = spark.createDataFrame([("r", "a", "1", 1), ("r", "b", "2", 1)], "run string, qid string, pid string, rank int")
    assert val(M.mrr_at(run, q)) == 0.5  # counts every judged query
    assert val(M.recall_at(run, q, 5)) == 1.0 and val(M.success_at(run, q)) == 1.0  # count those with positives


def test_no_judgements(spark, data):
    run, qrels = data
    e = M.evaluate(run, qrels.limit(0)).first()
    assert (e.mrr_10, e.recall_50, e.ndcg_10, e.success_5) == (0.0, 0.0, 0.0, 0.0)


def test_losses(spark):
    import math

    p = spark.createDataFrame([(1.0, 0.0), (0.0, 1000.0)], "pos_score double, neg_score double")
    assert L.pairwise_ce(p).first().loss == pytest.approx((math.log1p(math.exp(-1)) + 1000) / 2)
    k = spark.createDataFrame([("t", 1.0, 1.0), ("t", 2.0, 2.0)], "g string, a double, b double")
    assert L.kl_distillation(k, ["g"], "a", "b").first().loss == pytest.approx(0.0)
    s = spark.createDataFrame([(0, 1, 1, 5.0), (0, 1, 2, 5.0)], "batch int, q int, d int, score double")
    assert L.in_batch_ce(s).first().loss == pytest.approx(math.log(2))


def test_one_pass_equals_the_metrics_apart(spark):
    import random

    r = random.Random(2)
    qrels = spark.createDataFrame([(f"q{q}", f"d{d}", r.choice([-1, 0, 0, 1, 2, 3])) for q in range(30) for d in r.sample(range(60), 15)] + [("dry", "d1", 0)], "qid string, pid string, rel int")
    runs = spark.createDataFrame([(f"r{k}", f"q{q}", f"d{d}", n + 1) for k in range(3) for q in range(5, 35) for n, d in enumerate(r.sample(range(60), 25))] + [("lost", "elsewhere", "d1", 1)], "run string, qid string, pid string, rank int")
    got = {x.run: x for x in M.evaluate(runs, qrels).collect()}
    parts = {"mrr_10": M.mrr_at(runs, qrels, 10), "recall_50": M.recall_at(runs, qrels, 50), "recall_1000": M.recall_at(runs, qrels, 1000), "ndcg_10": M.ndcg_at(runs, qrels, 10), "success_5": M.success_at(runs, qrels, 5)}
    assert set(got) == {"r0", "r1", "r2", "lost"} and got["lost"].ndcg_10 == 0.0
    for name, df in parts.items():
        for x in df.collect():
            assert abs(got[x.run][name] - x[df.columns[1]]) < 2e-6
