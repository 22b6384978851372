"""Mix sources to target shares of the total token count (problem 8).

Efraimidis-Spirakis sampling: each record gets the exponential key
``-ln(u) / weight`` (``u`` from a hash of its id and the seed). A source whose
budget is ``target_share x total`` runs through ``floor(budget / own tokens)``
complete epochs, at most ``max_repeats``; what then remains of the budget is
filled by the records with the smallest keys, up to the prefix sum that still
fits. The prefix sum is taken in two levels: rows are cut into ranges of source
and key at sampled quantiles, whatever the scale of the weights, and the sums
of the ranges (a row each) give what comes before; so no task ever holds a
whole source. Whether a source reaches its target is read off what was chosen.

Defined cases: null or blank texts have no tokens and are never chosen; records
of sources without a target, or with a null source, take no part; a source with
a target but without tokens is reported with share 0 and cannot reach it;
repeated target rows count once, null shares or repeats as 0; an empty table
gives shares of 0 (null where the total is 0).
"""

from __future__ import annotations

import base64
import os

import numpy as np
import pandas as pd
from pyspark import SparkFiles
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..runtime import materialize, width

#: Up to so many targets, what is known of a source is sent to every task; beyond, joins shuffle.
MOST_SENT = 10_000
TOKENIZER = "/opt/tokenizers/byte_bpe_50k.tiktoken"
#: How the byte-level vocabulary splits a text before merging (public, fixed).
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
_LOADED: dict = {}


def encoding(path: str):
    """The tokenizer at ``path``, loaded once per worker."""
    if path not in _LOADED:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        _LOADED[path] = tiktoken.Encoding("file", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
    return _LOADED[path]


def token_count(col, path: str = TOKENIZER):
    """Number of tokens of a text column; 0 for null. The vocabulary file goes to the workers with the job."""
    SparkSession.active().sparkContext.addFile(path)
    name = os.path.basename(path)

    @F.pandas_udf("long")
    def count(texts: pd.Series) -> pd.Series:
        enc = encoding(SparkFiles.get(name))
        return pd.Series(np.fromiter((len(enc.encode_ordinary(t)) if t else 0 for t in texts), np.int64, len(texts)))

    return count(F.col(col) if isinstance(col, str) else col)


def quality_weight(text):
    """Default document weight in (0, 1]: share of letters, damped for short texts."""
    t = F.coalesce(text, F.lit(""))
    n = F.length(t)
    letters = n - F.length(F.translate(t, "0123456789.,;:!?()[]{}<>|/\\*#@&%$_=+~^\"'", ""))
    return F.greatest(F.lit(0.05), (F.lit(1.0) - letters / F.greatest(n, F.lit(1))) * F.least(F.lit(1.0), n / F.lit(400.0)))


def _unit(id_col, seed: int):
    """A uniform number in (0, 1] from the id: the first 48 bits of a hash."""
    h = F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), id_col.cast("string"))), 1, 12), 16, 10).cast("long")
    return (h + F.lit(1)) / F.lit(float(1 << 48))


def _sent(df: DataFrame, targets: DataFrame) -> DataFrame:
    """``df`` (at most a row for each target), marked for broadcast where the targets are few."""
    return F.broadcast(df) if targets.count() <= MOST_SENT else df


def measured(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight=None, seed: int = 7, tokenizer: str = TOKENIZER, size=None) -> DataFrame:
    """``(id, source, tokens, key)`` of the records whose source has a target, written once. ``size``: a column of ``text`` to count by instead of the tokenizer."""
    own = docs.select(F.col(id_col).alias("id"), F.col(source_col).alias("source"), F.col(text_col).alias("text"), (weight if weight is not None else quality_weight(F.col(text_col))).alias("weight"))
    named = targets.select("source").where(F.col("source").isNotNull()).distinct()
    rows = own.join(_sent(named, targets), "source", "left_semi")
    rows = rows.select("id", "source", (token_count("text", tokenizer) if size is None else size).alias("tokens"), (-F.log(_unit(F.col("id"), seed)) / F.greatest(F.col("weight"), F.lit(1e-6))).alias("key"))
    return materialize(rows, "tokens")


def plan(rows: DataFrame, targets: DataFrame) -> DataFrame:
    """Per target source: own tokens, budget, complete epochs, rest of the budget."""
    t = targets.where(F.col("source").isNotNull()).groupBy("source").agg(F.max(F.coalesce("target_share", F.lit(0.0))).alias("target_share"), F.max(F.coalesce("max_repeats", F.lit(0))).cast("long").alias("max_repeats"))
    own = rows.groupBy("source").agg(F.sum("tokens").alias("own_tokens"), F.count("*").alias("n_records"))
    p = t.join(own, "source", "left").withColumn("total_tokens", own.agg(F.coalesce(F.sum("own_tokens"), F.lit(0))).scalar())
    p = p.withColumns({"own_tokens": F.coalesce("own_tokens", F.lit(0)), "n_records": F.coalesce("n_records", F.lit(0))})
    p = p.withColumn("budget", F.col("target_share") * F.col("total_tokens"))
    p = p.withColumn("epochs", F.when(F.col("own_tokens") > 0, F.least(F.col("max_repeats"), F.floor(F.col("budget") / F.col("own_tokens")))).otherwise(F.lit(0)).cast("long"))
    return p.withColumn("rest", F.when(F.col("epochs") < F.col("max_repeats"), F.col("budget") - F.col("epochs") * F.col("own_tokens")).otherwise(F.lit(0.0)))


def choose(rows: DataFrame, planned: DataFrame, ranges: int | None = None) -> DataFrame:
    """``(id, source, tokens, repeats)`` of the records used at least once."""
    p = planned.select("source", "epochs", "rest")
    r = rows.where("tokens > 0").join(_sent(p, planned), "source")
    whole = r.where("rest <= 0").select("id", "source", "tokens", F.col("epochs").alias("repeats"))
    # Only sources with a fractional rest are put in order of their keys.
    part = materialize(r.where("rest > 0").repartitionByRange(ranges or width(rows.sparkSession), "source", "key", "id").withColumn("part", F.spark_partition_id()), "ranges")
    before = part.groupBy("source", "part").agg(F.sum("tokens").alias("n")).select("source", "part", (F.sum("n").over(Window.partitionBy("source").orderBy("part")) - F.col("n")).alias("before"))  # a row per range
    w = Window.partitionBy("source", "part").orderBy("key", "id").rowsBetween(Window.unboundedPreceding, 0)
    part = part.withColumn("inside", F.sum("tokens").over(w)).join(before, ["source", "part"])
    extra = (F.col("before") + F.col("inside") <= F.col("rest")).cast("long")
    return whole.unionByName(part.select("id", "source", "tokens", (F.col("epochs") + extra).alias("repeats"))).where(F.col("repeats") > 0)


def shares(chosen: DataFrame, planned: DataFrame) -> DataFrame:
    """Shares reached per target source, with what stood in the way.

    ``reachable`` is false where the chosen records, all repeated as often as
    they may be, still leave a part of the budget.
    """
    used = chosen.groupBy("source").agg(F.sum(F.col("tokens") * F.col("repeats")).alias("used_tokens"), F.max("repeats").alias("most_repeats"), F.count("*").alias("records"))
    out = planned.join(used, "source", "left").withColumns({c: F.coalesce(c, F.lit(0)) for c in ("used_tokens", "most_repeats", "records")})
    exhausted = F.col("used_tokens") >= F.col("max_repeats") * F.col("own_tokens")
    out = out.withColumn("reachable", ~(exhausted & (F.col("used_tokens") < F.col("budget"))))
    return out.withColumn("mixed_tokens", out.agg(F.sum("used_tokens")).scalar()).select("source", "target_share", "max_repeats", "own_tokens", "budget", "epochs", "most_repeats", "records", "used_tokens", F.try_divide(F.col("used_tokens"), F.col("total_tokens")).alias("share_of_total"), F.try_divide(F.col("used_tokens"), F.col("mixed_tokens")).alias("share_of_mix"), "reachable")


def mix(docs: DataFrame, targets: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", weight=None, seed: int = 7, tokenizer: str = TOKENIZER, size=None) -> tuple[DataFrame, DataFrame]:
    """The chosen records and the report of shares reached."""
    rows = measured(docs, targets, id_col, text_col, source_col, weight, seed, tokenizer, size)
    planned = materialize(plan(rows, targets), "plan")
    chosen = materialize(choose(rows, planned), "chosen")
    return chosen.withColumnRenamed("id", id_col), shares(chosen, planned)
