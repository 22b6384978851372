"""Command line: python -m moraine COMMAND ..."""

from __future__ import annotations

import argparse
import importlib
import json

from .config import Config


def _function(name: str):
    module, _, attribute = name.partition(":")
    return getattr(importlib.import_module(module), attribute)


def main(argv: list[str] | None = None) -> None:
    p = argparse.ArgumentParser(prog="moraine")
    p.add_argument("--config", help="settings file")
    sub = p.add_subparsers(dest="command", required=True)
    a = sub.add_parser("preprocess", help="raw documents to a collection")
    a.add_argument("docs")
    a.add_argument("out")
    a.add_argument("--passages", action="store_true")
    a = sub.add_parser("qrels", help="judgements to three columns")
    a.add_argument("source")
    a.add_argument("out")
    a = sub.add_parser("triples", help="mine training triples")
    for name in ("queries", "qrels", "run", "out"):
        a.add_argument(name)
    a.add_argument("--per-positive", type=int, default=1)
    a.add_argument("--strategy", choices=("random", "top"), default="random")
    a.add_argument("--passage-map")
    encode = "module:function from a list of texts to a list of matrices"
    a = sub.add_parser("index", help="build or go on building an index")
    a.add_argument("collection")
    a.add_argument("out")
    a.add_argument("--encode", required=True, help=encode)
    a.add_argument("--afresh", action="store_true")
    a = sub.add_parser("search", help="answer queries; with judgements also evaluate")
    a.add_argument("queries")
    a.add_argument("index")
    a.add_argument("out")
    a.add_argument("--encode", required=True, help=encode)
    a.add_argument("--qrels")
    a = sub.add_parser("distill", help="score a run with a cross-encoder and write tuples")
    for name in ("collection", "queries", "qrels", "run", "out"):
        a.add_argument(name)
    a.add_argument("--predict", required=True, help="module:function from a list of (query, text) to a list of scores")
    for name in ("evaluate-beir", "evaluate-lotte"):
        a = sub.add_parser(name, help="index, search and score the datasets of a benchmark")
        a.add_argument("--encode", required=True, help="module:function from a length to such a function")
        a.add_argument("--only", nargs="*", help="datasets or topics")
        a.add_argument("--out", help="file for the metrics")
    x = p.parse_args(argv)

    from pyspark.sql import SparkSession, Window
    from pyspark.sql import functions as F

    from .plans import pipelines as P
    from .sources import readers, sinks

    spark = SparkSession.builder.config("spark.sql.session.timeZone", "UTC").getOrCreate()
    config = Config.load(x.config) if x.config else Config()
    if x.command == "preprocess":
        P.preprocess(spark, x.docs, x.out, config, x.passages)
    elif x.command == "qrels":
        P.normalize_qrels(spark, x.source, x.out)
    elif x.command == "triples":
        P.build_triples(spark, x.queries, x.qrels, x.run, x.out, x.per_positive, x.strategy, config.seed, x.passage_map)
    elif x.command == "index":
        print(json.dumps(P.index(spark, x.collection, x.out, _function(x.encode), config, not x.afresh)))
    elif x.command == "distill":
        run = readers.read_run(spark, x.run).select("qid", F.col("docid").alias("pid"), F.row_number().over(Window.partitionBy("qid").orderBy("line_no")).alias("rank"))
        P.distill(spark, x.collection, x.queries, x.qrels, run, _function(x.predict), x.out, config)
    elif x.command in ("evaluate-beir", "evaluate-lotte"):
        got = (P.evaluate_beir if x.command == "evaluate-beir" else P.evaluate_lotte)(spark, _function(x.encode), config, x.only)
        print(json.dumps(got))
        if x.out:
            sinks.write_metrics(got, x.out)
    else:
        run = P.search(spark, readers.read_queries(spark, x.queries), x.index, _function(x.encode), config)
        sinks.write_run(run, x.out, "moraine")
        if x.qrels:
            print(json.dumps(P.evaluate_datasets(spark, {"run": {"qrels": x.qrels}}, lambda *_: run)))


if __name__ == "__main__":
    main()
