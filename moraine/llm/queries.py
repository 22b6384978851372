"""The queries of this package, by name."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..runtime import table
from . import boilerplate, encoding, leakage, mixing, near_dup, reading, site_lines, splitter


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_dup.near_duplicates(table(spark, d, "msmarco_docs"))
    return near_dup.all_pairs(members, links).toDF("docid_a", "docid_b")


def p1_groups(spark: SparkSession, d: str) -> DataFrame:
    members, links = near_dup.near_duplicates(table(spark, d, "msmarco_docs"))
    return near_dup.groups(members, links).withColumnRenamed("id", "docid")


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return boilerplate.boilerplate_lines(table(spark, d, "msmarco_docs"))


def p2_main(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "msmarco_docs")
    return site_lines.without_lines(docs, boilerplate.boilerplate_lines(docs))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return site_lines.repeated_lines(table(spark, d, "msmarco_docs"))


def p4_clean(spark: SparkSession, d: str) -> DataFrame:
    docs = table(spark, d, "msmarco_docs")
    return site_lines.without_lines(docs, site_lines.repeated_lines(docs))


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "msmarco_docs"), "docid", ["title", "body"], with_text=False).select("docid", "field").distinct()


def p5_restored(spark: SparkSession, d: str) -> DataFrame:
    return encoding.garbled(table(spark, d, "msmarco_docs"), "docid", ["title", "body"]).dropDuplicates(["docid", "field"])


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    pieces = splitter.split_oversized(table(spark, d, "msmarco_docs"), "docid", ["title", "body"], with_text=False)
    return pieces.where("piece_no = 1").select("docid").distinct()


def p6_pieces(spark: SparkSession, d: str) -> DataFrame:
    return splitter.split_oversized(table(spark, d, "msmarco_docs"), "docid", ["title", "body"]).dropDuplicates(["docid", "piece_no"])


def p6_check(spark: SparkSession, d: str) -> DataFrame:
    """What the pieces of each item add up to: the text put together again without the overlaps, and the limits kept."""
    p = p6_pieces(spark, d).groupBy("docid").agg(F.array_sort(F.collect_list(F.struct("piece_no", "start", "end", "piece", "n_pieces"))).alias("p"))  # the pieces of one item
    after = F.slice("p", 2, F.size("p"))
    pairs = F.zip_with(F.slice("p", 1, F.size("p") - 1), after, lambda a, b: F.struct(a["end"].alias("end"), b["start"].alias("start"), b["piece"].alias("piece")))
    whole = F.concat(F.element_at("p", 1)["piece"], F.array_join(F.transform(pairs, lambda x: F.substr(x["piece"], x["end"] - x["start"] + 1)), ""))
    return p.select(
        "docid",
        F.md5(whole).alias("whole"),
        F.forall("p", lambda x: (x["end"] - x["start"] <= 2000) & (F.length(x["piece"]) == x["end"] - x["start"])).alias("limit_kept"),
        F.forall(pairs, lambda x: F.abs(x["end"] - x["start"] - 200) <= 50).alias("overlap_kept"),
        F.forall("p", lambda x: x["n_pieces"] == F.size("p")).alias("counted"),
    )


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.leaks(table(spark, d, "documents"), table(spark, d, "benchmark")).select("doc_id", "item_id")


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    _, report = mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))
    return report.where(~F.col("reachable")).select("source")


def p8_mix(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[0]


def p8_shares(spark: SparkSession, d: str) -> DataFrame:
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"))[1]


def _mixed_words(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """The mix with sizes in white-space words, which SQL can count, too."""
    size = F.coalesce(F.regexp_count("text", F.lit(r"[\x21-\x7e]+")), F.lit(0))
    return mixing.mix(table(spark, d, "documents"), table(spark, d, "mix_targets"), size=size.cast("long"))


def p8_mix_words(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_words(spark, d)[0]


def p8_shares_words(spark: SparkSession, d: str) -> DataFrame:
    return _mixed_words(spark, d)[1].select("source", "own_tokens", "epochs", "records", "used_tokens", F.round("share_of_mix", 9).alias("share_of_mix"), "reachable")


def p9_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_bands(table(spark, d, "documents"), table(spark, d, "reading_labels")).select("doc_id", "band")


def p9_profile(spark: SparkSession, d: str) -> DataFrame:
    bands = reading.reading_bands(table(spark, d, "documents"), table(spark, d, "reading_labels"))
    return bands.groupBy("band").agg(F.count("*").alias("documents"), F.round(F.avg("level"), 3).alias("mean_level"))


QUERIES = {f.__name__: f for f in (p1_found, p1_groups, p2_found, p2_main, p4_found, p4_clean, p5_found, p5_restored, p6_found, p6_pieces, p6_check, p7_found, p8_found, p8_mix, p8_shares, p8_mix_words, p8_shares_words, p9_found, p9_profile)}
