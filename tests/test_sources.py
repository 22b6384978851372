import pytest
from conftest import rows

from moraine.config import Config
from moraine.operators import ordinals as O
from moraine.sources import readers as S
from moraine.sources import sinks as K


@pytest.fixture
def file(tmp_path):
    def make(content, name="f.tsv"):
        p = tmp_path / name
        p.write_bytes(content if isinstance(content, bytes) else content.encode())
        return str(p)

    return make


def test_collection(spark, file):
    df = S.read_collection(spark, file("1\ta\tb\n\tno pid\nno tab\n2\tx\ry\r\n1\tagain\n3\t"))
    assert [(r.pid, r.text) for r in df.orderBy("ordinal").collect()] == [("1", "again"), ("2", "x\ry"), ("3", "")]
    assert rows(S.read_collection(spark, file(b"1\t\xff\n")).select("text")) == [("�",)]
    assert S.read_collection(spark, file("")).count() == 0


def test_collection_of_several_blocks(spark, file):
    path = file("".join(f"{i}\ttext {i}\n" for i in range(3000)))
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "9000")
    try:
        got = S.read_collection(spark, path).orderBy("ordinal").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert [(r.ordinal, r.pid) for r in got] == [(i, str(i)) for i in range(3000)]


def test_queries(spark, file):
    df = S.read_queries(spark, file("q1\told\n\tempty id\nq2\tb\nq1\tnew\nbad\n"))
    assert [(r.qid, r.text) for r in df.orderBy("ordinal").collect()] == [("q1", "new"), ("", "empty id"), ("q2", "b")]


def test_qrels(spark, file):
    p = file("q1 d1 1\nq1 0 d2 -1\nq1 0 d2 2 x\nq2 d1 x\n  q3\td9\t0\nq4 d\nq5 0 d1 1.0\n")
    assert rows(S.read_qrels(spark, p)) == [("q1", "d1", 1), ("q1", "d2", 2), ("q3", "d9", 0)]
    assert rows(S.read_train_positives(spark, p)) == [("q1", "d2")]


def test_triples_and_run(spark, file):
    assert rows(S.read_triples(spark, file("q\tp\tn\nq\tp\nq\tp\tn\tx\n")).select("query", "pos", "neg")) == [("q", "p", "n")]
    run = S.read_run(spark, file("q Q0 d2 9 1.0 r\nq Q0 d1 1 2.0 r\nbad\n"))
    assert [(r.qid, r.docid) for r in run.orderBy("line_no").collect()] == [("q", "d2"), ("q", "d1")]


def test_passage_map(spark, file):
    assert rows(S.read_passage_map(spark, file("p1\td1\np1\td2\n"))) == [("p1", "d2")]
    with pytest.raises(Exception, match="no tab"):
        S.read_passage_map(spark, file("p1\td1\nbroken\n", "g.tsv")).collect()


def test_documents(spark, file):
    df = S.read_documents(spark, file("D1\tu\tt\tb\tmore\n\n  \nD2\tu\n"))
    assert [tuple(r)[1:] for r in df.orderBy("line_no").collect()] == [("D1", "u", "t", "b\tmore"), ("D2", "u", "", "")]


def test_tuples(spark, file, tmp_path):
    df = S.read_tuples(spark, file('{"qid":"1","query":"q","pids":["a"],"scores":[1.5],"positive_idx":0}\n\n'))
    assert df.count() == 1
    K.write_tuples(df, str(tmp_path / "out"))
    assert rows(S.read_tuples(spark, str(tmp_path / "out"))) == rows(df)
    with pytest.raises(ValueError):
        S.read_tuples(spark, file("", "e.jsonl"))


def test_beir_and_lotte(spark, file):
    assert rows(S.read_beir_corpus(spark, file('{"_id":"1","title":"T","text":"a\\tb\\n"}\n'))) == [("1", "T a b")]
    assert S.lotte_paths("/r", "writing", "dev", "forum")["queries"] == "/r/writing/dev/questions.forum.tsv"


def test_run_roundtrip(spark, tmp_path):
    df = spark.createDataFrame([("q", "p2", 0.5, 2), ("q", "p1", 0.75, 1)], "qid string, pid string, score double, rank int")
    K.write_run(df, str(tmp_path / "run"), "mine")
    assert [r.value for r in spark.read.text(str(tmp_path / "run")).collect()] == ["q\tQ0\tp1\t1\t0.750000\tmine", "q\tQ0\tp2\t2\t0.500000\tmine"]


@pytest.mark.parametrize("n,shards", [(10, 3), (2, 5), (9, 3)])
def test_balanced_shards(spark, n, shards):
    from pyspark.sql import functions as F

    got = [r[0] for r in spark.range(n).orderBy("id").select(O.balanced_shard(F.col("id"), F.lit(n), shards)).collect()]
    sizes = [got.count(k) for k in range(shards)]
    assert got == sorted(got) and sizes == [n // shards + (k < n % shards) for k in range(shards)]


def test_dense_ordinal_and_sample(spark):
    df = spark.range(0, 1000, 3).withColumnRenamed("id", "key")
    assert [r.ordinal for r in O.dense_ordinal(df, ["key"]).orderBy("key").collect()] == list(range(334))
    assert O.sample_exact(df, "key", 10).count() == 10 and rows(O.sample_exact(df, "key", 10)) == rows(O.sample_exact(df, "key", 10))


def test_shard_rows(spark):
    df = spark.createDataFrame([(i * 2, str(i), "t") for i in range(10)], "ordinal long, pid string, text string")
    assert [r.pid for r in S.shard_rows(df, 1, 3, 1).orderBy("ordinal").collect()] == ["5", "6"]


def test_config(tmp_path):
    c = Config().override(nbits=1)
    c.save(str(tmp_path / "c.yaml"))
    assert Config.load(str(tmp_path / "c.yaml")) == c and c.n_candidates == 8192
    with pytest.raises(ValueError):
        Config(nbits=3)


def test_sample_is_the_first_by_hash(spark):
    import hashlib

    df = spark.range(3000).withColumnRenamed("id", "key")
    order = sorted(range(3000), key=lambda k: hashlib.md5(f"7|{k}".encode()).hexdigest())
    for n in (1, 50, 2999, 3000, 9000):
        assert [r.key for r in O.sample_exact(df, "key", n, 7).orderBy("key").collect()] == sorted(order[:n])
    assert O.sample_exact(df, "key", 0).count() == 0 and O.sample_exact(df.limit(0), "key", 3).count() == 0


def test_shuffle_is_another_each_epoch(spark):
    df = spark.createDataFrame([(str(i),) for i in range(50)] + [("7",)], "key string")
    a, b = (rows(O.shuffled(df, "key", 1, e).select("place", "key")) for e in (0, 1))
    assert [p for p, _ in a] == list(range(51)) and sorted(k for _, k in a) == sorted(k for _, k in b) and a != b


def test_missing_files_and_tuple_sizes(spark, file, tmp_path):
    from moraine.plans import pipelines as P

    assert rows(S.read_train_queries(spark, str(tmp_path / "none.tsv"))) == []
    with pytest.warns(UserWarning):
        assert P.normalize_qrels(spark, str(tmp_path / "none.tsv"), str(tmp_path / "out")) is False
    P.normalize_qrels(spark, file("q 0 d x\nq d 1\nq 0 d x\n"), str(tmp_path / "out"))
    assert [r.value for r in S.lines(spark, str(tmp_path / "out")).collect()] == ["q\td\tx", "q\td\tx"]
    two = file('{"qid":"1","query":"q","pids":["a","b"],"scores":[1.5,1],"positive_idx":0}\n{"qid":"2","query":"q","pids":["a"],"scores":[1],"positive_idx":0}\n', "t.jsonl")
    assert S.read_tuples(spark, two).count() == 2
    with pytest.raises(Exception, match="not a tuple of 2"):
        S.read_tuples(spark, two, 2).collect()
    assert rows(S.read_lotte_qas(spark, file('{"qid":"1","answer_pids":["a","b","a"]}\n{"qid":"2"}\n', "qas.jsonl"))) == [("1", "a", 1), ("1", "b", 1)]


def test_metrics_file_is_replaced(spark, tmp_path):
    path = str(tmp_path / "m.json")
    for v in (1.0, 0.5):
        K.write_metrics({"a": {"mrr": v}}, path)
    assert '"mrr": 0.5' in open(path).read()


def test_settings_under_other_names(tmp_path):
    p = tmp_path / "c.json"
    p.write_text('{"field_format": "tagged", "retrieve_top_k": 7, "lr": 1e-5, "kmeans_niters": 3}')
    c = Config.load(str(p))
    assert (c.format_strategy, c.top_k, c.kmeans_iterations) == ("tagged", 7, 3)
