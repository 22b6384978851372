"""Whole pipelines over files: preprocessing, mining, indexing, search, evaluation."""

from __future__ import annotations

import traceback
import warnings
from collections.abc import Callable

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..config import Config
from ..functions import text as X
from ..functions.encoders import Encode, encoder
from ..operators import index as I
from ..operators import metrics as M
from ..operators import mining as N
from ..operators import retrieval as R
from ..runtime import exists, materialize
from ..sources import readers as S
from ..sources import sinks as K


#: Datasets of the two collections of benchmarks (fixed names), and the query lengths some of them need.
BEIR = ("dbpedia-entity", "fiqa", "nq", "hotpotqa", "nfcorpus", "trec-covid", "touche-2020", "arguana", "climate-fever", "fever", "quora", "scidocs", "scifact")
QUERY_MAXLEN = {"arguana": 300, "climate-fever": 64}
LOTTE = ("writing", "recreation", "science", "technology", "lifestyle", "pooled")


def preprocess(spark: SparkSession, docs: str, out: str, config: Config, passages: bool = False) -> None:
    """Raw documents to a collection of whole texts, or of passages with their map."""
    d = S.read_documents(spark, docs).withColumn("text", X.format_document(config.format_strategy, config.format_template))
    if not passages:
        K.write_tsv(d, f"{out}/collection.docs.tsv", "docid", "text")
        return
    p = X.segment(d.select("docid", "text"), "text", config.passage_window, config.passage_stride)
    p = materialize(p.select("docid", F.concat("docid", F.lit("_p"), "passage_idx").alias("pid"), "passage"), "passages")
    K.write_tsv(p, f"{out}/collection.passages.tsv", "pid", "passage")
    K.write_tsv(p, f"{out}/passage_to_doc.tsv", "pid", "docid")


def normalize_qrels(spark: SparkSession, source: str, out: str) -> bool:
    """Judgements of four columns or more to three, row by row and unchecked; a source that is not there is left out (false)."""
    if not exists(spark, source):
        warnings.warn(f"{source} is not there; no judgements are written", stacklevel=2)
        return False
    w = F.split(X.strip(F.col("value")), r"\s+")
    rows = S.lines(spark, source).where(F.size(w) >= 4)
    K.write_lines(rows, out, F.concat_ws("\t", F.get(w, F.lit(0)), F.get(w, F.lit(2)), F.get(w, F.lit(3))), "line_no")
    return True


def copy_queries(spark: SparkSession, source: str, out: str) -> None:
    """Queries as they are, line by line; nothing is done where both are one path."""
    if source.rstrip("/") != out.rstrip("/"):
        K.write_lines(S.lines(spark, source), out, F.col("value"), "line_no")


def build_triples(spark: SparkSession, queries: str, qrels: str, run: str, out: str, per_positive: int = 1, strategy: str = "random", seed: int = 12345, passage_map: str | None = None) -> None:
    """Triples ``query <tab> positive <tab> negative`` from judgements and a candidate run, in documents or their first passages."""
    pos = S.read_train_positives(spark, qrels)
    pool = N.negative_pool(S.read_run(spark, run).withColumnRenamed("line_no", "ord"), pos)
    t = N.triples(pos, pool, per_positive, strategy, seed)
    if passage_map:
        first = S.read_passage_map(spark, passage_map).where(F.col("pid") == F.concat("docid", F.lit("_p0")))
        t = N.to_passages(t, first)
    t = t.join(S.read_queries(spark, queries).select("qid", F.col("text").alias("query")), "qid")
    K.write_tsv(t, out, "query", "pos", "neg")


def index(spark: SparkSession, collection: str, out: str, encode: Encode, config: Config, resume: bool = True) -> dict:
    if (most := getattr(encode, "most_tokens", None)) is not None:
        config.check_model(most)
    return I.build_index(spark, S.read_collection(spark, collection), encoder(encode), out, config.nbits, seed=config.seed, iterations=config.kmeans_iterations, residual_sample=config.residual_sample, resume=resume, settings={"dim": config.dim, "doc_maxlen": config.doc_maxlen})


def encode_queries(spark: SparkSession, queries: DataFrame, encode: Encode) -> DataFrame:
    """``(qid, qpos, qvec)``: every position of every query."""

    def run(batches):
        for pdf in batches:
            mats = encode([t or "" for t in pdf["text"]])
            n = [len(m) for m in mats]
            yield pd.DataFrame({"qid": pdf["qid"].repeat(n).to_numpy(), "qpos": [k for x in n for k in range(x)], "qvec": [v.astype("float64") for m in mats for v in m]})

    return queries.select("qid", "text").mapInPandas(run, "qid string, qpos int, qvec array<double>")


def search(spark: SparkSession, queries: DataFrame, path: str, encode: Encode, config: Config, top_k: int = 0) -> DataFrame:
    """``(qid, pid, score, rank)`` of a finished index, in two rounds over its codes; ``top_k`` 0 stands for that of the settings."""
    q = materialize(encode_queries(spark, queries, encode), "queries")
    got = R.search_index(q, path, config.nbits, config.nprobe, config.n_candidates, top_k or config.top_k)
    return got.join(spark.read.parquet(f"{path}/docs").select(F.col("ordinal").alias("doc_idx"), "pid"), "doc_idx").select("qid", "pid", "score", "rank")


def search_documents(spark: SparkSession, queries: DataFrame, path: str, passage_map: DataFrame, encode: Encode, config: Config, top_k: int = 0) -> DataFrame:
    """``(qid, docid, score, rank)``: documents by their best passage, of ``passages_per_doc`` times as many passages."""
    k = top_k or config.top_k
    run = search(spark, queries, path, encode, config, k * max(1, config.passages_per_doc))
    return R.max_passage(run, passage_map, k)


def distill(spark: SparkSession, collection: str, queries: str, qrels: str, run: DataFrame, predict: Callable, out: str, config: Config) -> None:
    """Tuples of ``nway`` passages from a ranking (qid, pid, rank), scored by an injected cross-encoder, written as JSON lines."""
    texts, asked = S.read_collection(spark, collection), S.read_train_queries(spark, queries).select("qid", "text")
    scored = N.score_pairs(N.pairs_to_score(run, asked, texts, config.top_k_distill), predict)
    tuples = N.nway_tuples(materialize(scored, "scored"), S.read_qrels(spark, qrels).where("rel > 0").select("qid", F.col("docid").alias("pid")), config.nway)
    K.write_tuples(tuples.join(asked.withColumnRenamed("text", "query"), "qid"), out)


def evaluate_beir(spark: SparkSession, encode: Callable[[int], Encode], config: Config, datasets: list[str] | None = None) -> dict[str, dict]:
    """Metrics of each dataset under ``beir_data_dir`` (``<name>/corpus.jsonl``, ``queries.jsonl``, ``qrels.tsv``) and their averages.

    ``encode(maxlen)`` gives the encoder for texts of that length; each dataset
    has an index of its own, and some ask for longer queries. One that fails is
    reported and left out of the averages.
    """
    docs = config.override(doc_maxlen=config.beir_doc_maxlen)

    def answer(name: str, data: dict) -> DataFrame:
        root, out = data["root"], f"{config.output_dir}/beir/{name}"
        K.write_tsv(S.read_beir_corpus(spark, f"{root}/corpus.jsonl"), f"{out}/collection.tsv", "pid", "text")
        index(spark, f"{out}/collection.tsv", f"{out}/index", encode(docs.doc_maxlen), docs)
        asked = S.read_beir_queries(spark, f"{root}/queries.jsonl")
        return search(spark, asked, f"{out}/index", encode(QUERY_MAXLEN.get(name, config.query_maxlen)), docs, 1000)

    roots = {name: f"{config.beir_data_dir}/{name}" for name in datasets or BEIR}
    return evaluate_datasets(spark, {name: {"root": root, "qrels": f"{root}/qrels.tsv"} for name, root in roots.items()}, answer)


def evaluate_lotte(spark: SparkSession, encode: Callable[[int], Encode], config: Config, topics: list[str] | None = None, kinds: tuple[str, ...] = ("search", "forum"), split: str = "test") -> dict[str, dict]:
    """Success@5 of each topic and kind of query under ``lotte_data_dir``, and the average of each kind; one index a topic.

    A topic without a collection, or a kind without queries or judgements
    (``qrels`` or, where that is missing, ``qas``), is left out.
    """
    docs = config.override(doc_maxlen=config.lotte_doc_maxlen)
    out: dict[str, dict] = {}
    for topic in topics or LOTTE:
        paths = {kind: S.lotte_paths(config.lotte_data_dir, topic, split, kind) for kind in kinds}
        source, at = paths[kinds[0]]["collection"], f"{config.output_dir}/lotte/{topic}/{split}"
        if not exists(spark, source):
            continue
        index(spark, source, at, encode(docs.doc_maxlen), docs)
        for kind, p in paths.items():
            judged = next((k for k in ("qrels", "qas") if exists(spark, p[k])), None)
            if judged is None or not exists(spark, p["queries"]):
                continue
            qrels = S.read_qrels(spark, p["qrels"]) if judged == "qrels" else S.read_lotte_qas(spark, p["qas"])
            run = search(spark, S.read_queries(spark, p["queries"]), at, encode(config.query_maxlen), docs, 5)
            row = M.success_at(run.withColumn("run", F.lit(topic)).select("run", "qid", "pid", "rank"), qrels.withColumnRenamed("docid", "pid"), 5).first()
            out[f"{topic}/{kind}"] = {"success_5": row["success"] if row else 0.0}
    for kind in kinds:
        of = [v["success_5"] for name, v in out.items() if name.endswith(f"/{kind}")]
        if of:
            out[f"average/{kind}"] = {"success_5": sum(of) / len(of)}
    return out


def evaluate_datasets(spark: SparkSession, datasets: dict[str, dict], answer: Callable[[str, dict], DataFrame]) -> dict[str, dict]:
    """Metrics of each named dataset and their macro averages; a dataset that fails is reported and left out.

    Each dataset has a ``qrels`` path; ``answer(name, dataset)`` gives its run (qid, pid, score, rank).
    """
    out: dict[str, dict] = {}
    for name, data in datasets.items():
        try:
            qrels = S.read_qrels(spark, data["qrels"]).withColumnRenamed("docid", "pid")
            row = M.evaluate(answer(name, data).withColumn("run", F.lit(name)).select("run", "qid", "pid", "rank"), qrels).first()
            out[name] = {k: v for k, v in row.asDict().items() if k != "run"} if row else {}
        except Exception:
            out[name] = {"error": traceback.format_exc(limit=1)}
    good = [v for v in out.values() if v and "error" not in v]
    if good:
        out["average"] = {k: sum(v[k] for v in good) / len(good) for k in good[0]}
    return out
