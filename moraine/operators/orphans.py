"""References to records that do not exist, by table and period (problem 3).

Keys are hashed into key ranges. Within one range every key gets a small
integer (its place in the range's sorted dictionary); the references of each
period and the parents that hold throughout that period become compressed
bitmaps, and ``references AND NOT parents`` leaves the suspects, which are
decoded back to keys. A parent that begins or ends inside a period is not
counted as holding throughout, so the suspects are a superset; the exact time
of each suspect's references decides in a join over the suspects only.

Both inputs are reduced to distinct (key, period) and one row per parent before
they are shuffled, so a key that holds a third of all references costs one row
per period. The number of ranges follows the row counts, which bounds the rows
of a task.

Defined cases: null keys and references without a time are no references;
exact repeats count once; a parent repeated with several times begins at its
first and ends at its first end; ends or beginnings without a time are ignored
(a parent with no known beginning always existed); empty tables on either side
are allowed: without parents every reference is missing.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.bitmap import Bitmap
from ..runtime import width

#: Period of a parent without beginning, and of one without end.
FIRST, LAST = -(1 << 30), 1 << 30


def month_index(ts: Column) -> Column:
    """Months since year 0, an integer period."""
    return (F.year(ts) * 12 + F.month(ts) - 1).cast("int")


def suspects(refs: DataFrame, parents: DataFrame, ranges: int) -> DataFrame:
    """Distinct ``(key, period)`` of ``refs`` without a parent holding throughout the period.

    ``refs``: key string, period int. ``parents``: key string, first int, last
    int - the first and last whole period in which it holds.
    """

    def run(r: pd.DataFrame, p: pd.DataFrame) -> pd.DataFrame:
        if not len(r):
            return pd.DataFrame({"key": [], "period": []}).astype({"key": object, "period": "int32"})
        # Keys stay Python strings, so a long one costs its own length only and none loses its end.
        dictionary = np.array(sorted(set(r["key"])), object)
        place = {key: k for k, key in enumerate(dictionary)}
        code = np.fromiter(map(place.__getitem__, r["key"]), np.int64, len(r))
        own = np.fromiter((place.get(key, -1) for key in p["key"]), np.int64, len(p))
        known = own >= 0
        own, first, last = own[known], p["first"].to_numpy()[known], p["last"].to_numpy()[known]
        period = r["period"].to_numpy()
        keys, periods = [], []
        for m in np.unique(period):
            left = Bitmap.of(code[period == m]).andnot(Bitmap.of(own[(first <= m) & (last >= m)])).values()
            keys.append(dictionary[left])
            periods.append(np.full(len(left), m, np.int32))
        return pd.DataFrame({"key": np.concatenate(keys).astype(object), "period": np.concatenate(periods)})

    spread = F.pmod(F.xxhash64("key"), F.lit(ranges)).cast("int")
    r = refs.where(F.col("key").isNotNull() & F.col("period").isNotNull()).select("key", "period").distinct().withColumn("range", spread)
    p = parents.where(F.col("key").isNotNull()).groupBy("key").agg(F.min("first").alias("first"), F.max("last").alias("last")).withColumn("range", spread)
    return r.groupBy("range").cogroup(p.groupBy("range")).applyInPandas(run, "key string, period int")


def orphan_references(refs: DataFrame, links: DataFrame, docs: DataFrame, removals: DataFrame, keys_per_range: int = 50_000) -> DataFrame:
    """Orphan references ``(tbl, ref_month, qid, ref_key, kind)``.

    ``refs``: tbl, qid, ref_key, at, via - ``via`` tells whether the key names a
    document itself or goes through ``links`` (pid -> docid).
    """
    refs = refs.where(F.col("ref_key").isNotNull() & F.col("at").isNotNull())
    # Row counts bound the distinct keys of either side.
    ranges = max(width(docs.sparkSession), 1 + (docs.count() + links.count() + refs.count()) // keys_per_range)
    refs = refs.distinct()
    links = links.select(F.col("pid").alias("ref_key"), "docid").where(F.col("ref_key").isNotNull() & F.col("docid").isNotNull()).distinct()
    born = docs.where(F.col("docid").isNotNull()).groupBy("docid").agg(F.min("ingested_at").alias("born"))
    gone = removals.where(F.col("docid").isNotNull() & F.col("removed_at").isNotNull()).groupBy("docid").agg(F.min("removed_at").alias("gone"))
    life = born.withColumn("is", F.lit(True)).join(gone, "docid", "full")

    via = refs.where("via")
    lost = suspects(via.select(F.col("ref_key").alias("key"), month_index(F.col("at")).alias("period")), links.select(F.col("ref_key").alias("key"), F.lit(FIRST).alias("first"), F.lit(LAST).alias("last")), ranges)
    unlinked = via.join(lost.select(F.col("key").alias("ref_key")).distinct(), "ref_key", "left_semi").withColumn("kind", F.lit("missing"))

    aimed = refs.where(~F.col("via")).withColumn("docid", F.col("ref_key")).unionByName(via.join(links, "ref_key"))
    aimed = aimed.withColumn("period", month_index(F.col("at")))
    begin = F.when(F.col("born").isNull(), F.lit(FIRST)).otherwise(month_index(F.col("born")) + 1)
    end = F.when(F.col("gone").isNull(), F.lit(LAST)).otherwise(month_index(F.col("gone")) - 1)
    doubtful = suspects(aimed.select(F.col("docid").alias("key"), "period"), life.where("is").select(F.col("docid").alias("key"), begin.alias("first"), end.alias("last")), ranges)
    doubtful = doubtful.select(F.col("key").alias("docid"), "period")
    kind = F.when(F.col("gone") <= F.col("at"), "deleted").when(F.col("is").isNull(), "missing").when(F.col("born") > F.col("at"), "late")
    judged = aimed.join(doubtful, ["docid", "period"], "left_semi").join(life, "docid", "left").withColumn("kind", kind)

    shape = ["tbl", F.date_format("at", "yyyy-MM").alias("ref_month"), "qid", "ref_key", "kind"]
    return judged.where(F.col("kind").isNotNull()).select(*shape).unionByName(unlinked.select(*shape)).distinct()


def retrieval_references(qrels: DataFrame, tuples: DataFrame) -> DataFrame:
    """The references of the judgement and tuple tables in one form."""
    q = qrels.select(F.lit("qrels").alias("tbl"), "qid", F.col("docid").alias("ref_key"), F.col("judged_at").alias("at"), F.lit(False).alias("via"))
    t = tuples.select(F.lit("tuples").alias("tbl"), "qid", F.explode("pids").alias("ref_key"), F.col("built_at").alias("at"), F.lit(True).alias("via"))
    return q.unionByName(t)


def orphan_counts(orphans: DataFrame) -> DataFrame:
    """Orphans per table, month and kind."""
    return orphans.groupBy("tbl", "ref_month", "kind").agg(F.count("*").alias("n_refs"), F.count_distinct("ref_key").alias("n_keys"))
