import pytest
from conftest import rows

from moraine.config import Config
from moraine.functions.encoders import hashed_words
from moraine.plans import pipelines as P
from moraine.sources import readers as S

ENCODE = hashed_words(16)


@pytest.fixture
def files(tmp_path):
    docs = "".join(f"D{i}\thttp://x/{i}\ttitle {i}\t" + " ".join(f"w{(i * 5 + j) % 40}" for j in range(30)) + "\n" for i in range(12))
    (tmp_path / "docs.tsv").write_text(docs)
    (tmp_path / "queries.tsv").write_text("q1\ttitle 3 w15 w16\nq2\ttitle 7 w35 w36\n")
    (tmp_path / "qrels.txt").write_text("q1 0 D3 1\nq2 0 D7 1\nq2 0 D1 0\n")
    (tmp_path / "run.txt").write_text("".join(f"{q} Q0 D{i} {i} 1.0 r\n" for q in ("q1", "q2") for i in range(12)))
    return tmp_path


def test_end_to_end(spark, files):
    at = lambda n: str(files / n)
    config = Config(dim=16, passage_window=20, passage_stride=10, nprobe=4, top_k=5, kmeans_iterations=2, candidate_factor=50)
    P.preprocess(spark, at("docs.tsv"), at("out"), config)
    col = S.read_collection(spark, at("out") + "/collection.docs.tsv")
    assert col.count() == 12 and col.where("pid = 'D3'").first().text.startswith("title 3 w15")
    P.preprocess(spark, at("docs.tsv"), at("out"), config, passages=True)
    assert S.read_passage_map(spark, at("out") + "/passage_to_doc.tsv").count() == 12 * 3

    P.build_triples(spark, at("queries.tsv"), at("qrels.txt"), at("run.txt"), at("triples"), 2, "top", passage_map=at("out") + "/passage_to_doc.tsv")
    assert rows(S.read_triples(spark, at("triples")).select("pos", "neg")) == [("D3_p0", "D0_p0"), ("D3_p0", "D1_p0"), ("D7_p0", "D0_p0"), ("D7_p0", "D1_p0")]
    P.normalize_qrels(spark, at("qrels.txt"), at("qrels3"))
    assert S.read_qrels(spark, at("qrels3")).count() == 3

    meta = P.index(spark, at("out") + "/collection.docs.tsv", at("index"), ENCODE, config)
    assert meta["n_docs"] == 12
    run = P.search(spark, S.read_queries(spark, at("queries.tsv")), at("index"), ENCODE, config)
    best = {r.qid: r.pid for r in run.where("rank = 1").collect()}
    assert best == {"q1": "D3", "q2": "D7"}
    got = P.evaluate_datasets(spark, {"mine": {"qrels": at("qrels.txt")}, "broken": {"qrels": at("none")}}, lambda *_: run)
    assert got["mine"]["mrr_10"] == 1.0 and "error" in got["broken"] and got["average"]["success_5"] == 1.0


def test_command_line(spark, files):
    from moraine.__main__ import main

    main(["preprocess", str(files / "docs.tsv"), str(files / "cli")])
    assert S.read_collection(spark, str(files / "cli") + "/collection.docs.tsv").count() == 12
    with pytest.raises(SystemExit):
        main(["unknown"])


def _lengths(maxlen):
    return hashed_words(16, maxlen)


def test_distillation(spark, files):
    at = lambda n: str(files / n)
    config = Config(dim=16, nway=3, top_k_distill=12)

    def predict(pairs):
        return [float(len(set(q.split()) & set(t.split()))) for q, t in pairs]

    P.preprocess(spark, at("docs.tsv"), at("out"), config)
    run = S.read_run(spark, at("run.txt")).select("qid", "docid", "line_no").selectExpr("qid", "docid AS pid", "CAST(line_no % 12 + 1 AS INT) AS rank")
    P.distill(spark, at("out") + "/collection.docs.tsv", at("queries.tsv"), at("qrels.txt"), run, predict, at("tuples"), config)
    got = {r.qid: r for r in S.read_tuples(spark, at("tuples"), 3).collect()}
    assert got["q1"].pids[0] == "D3" and got["q2"].pids[0] == "D7" and got["q1"].query.startswith("title 3")


def test_benchmarks(spark, files):
    """Two datasets with an index each, one of them broken; one topic of the other benchmark."""
    beir = files / "beir" / "nfcorpus"
    beir.mkdir(parents=True)
    words = lambda i: " ".join(f"w{(i * 5 + j) % 40}" for j in range(30))
    (beir / "corpus.jsonl").write_text("".join(f'{{"_id": "D{i}", "title": "t{i}", "text": "{words(i)}"}}\n' for i in range(12)))
    (beir / "queries.jsonl").write_text('{"_id": "q1", "text": "t3 w15"}\n{"_id": "q2", "text": "t7 w35"}\n')
    (beir / "qrels.tsv").write_text("q1\t0\tD3\t1\nq2\t0\tD7\t1\n")
    topic = files / "lotte" / "writing" / "test"
    topic.mkdir(parents=True)
    (topic / "collection.tsv").write_text("".join(f"D{i}\tt{i} {words(i)}\n" for i in range(12)))
    (topic / "questions.search.tsv").write_text("q1\tt3 w15\n")
    (topic / "qas.search.jsonl").write_text('{"qid": "q1", "answer_pids": ["D3"]}\n')
    config = Config(dim=16, nprobe=4, candidate_factor=50, kmeans_iterations=2, beir_data_dir=str(files / "beir"), lotte_data_dir=str(files / "lotte"), output_dir=str(files / "exp"))
    got = P.evaluate_beir(spark, _lengths, config, ["nfcorpus", "fiqa"])
    assert got["nfcorpus"]["mrr_10"] == 1.0 and "error" in got["fiqa"] and got["average"]["ndcg_10"] == 1.0
    got = P.evaluate_lotte(spark, _lengths, config)
    assert got == {"writing/search": {"success_5": 1.0}, "average/search": {"success_5": 1.0}}


def test_documents_by_their_best_passage(spark, files):
    at = lambda n: str(files / n)
    config = Config(dim=16, passage_window=20, passage_stride=10, nprobe=4, top_k=2, kmeans_iterations=2, candidate_factor=50, passages_per_doc=3)
    P.preprocess(spark, at("docs.tsv"), at("out"), config, passages=True)
    P.index(spark, at("out") + "/collection.passages.tsv", at("pindex"), ENCODE, config)
    q, m = S.read_queries(spark, at("queries.tsv")), S.read_passage_map(spark, at("out") + "/passage_to_doc.tsv")
    run = P.search_documents(spark, q, at("pindex"), m, ENCODE, config)
    assert {r.qid: r.docid for r in run.where("rank = 1").collect()} == {"q1": "D3", "q2": "D7"} and run.count() == 4
    with pytest.raises(ValueError):
        P.index(spark, at("out") + "/collection.passages.tsv", at("other"), ENCODE, config.override(doc_maxlen=4000))
