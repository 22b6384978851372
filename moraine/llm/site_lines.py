"""Lines repeated across the documents of one site (problem 4).

A line's key is its letters in lower case. For every (site, key) the number of
documents of the site holding it is compared with its frequency outside the
site by the log-likelihood ratio; the excess lines are those whose p-value
passes the Benjamini-Hochberg procedure over all (site, key) pairs. Outside are
the documents of the sites in which the key itself does not recur (at least
``min_docs`` documents and ``min_share`` of the site), counted as they are, with
half a document in one as prior: a phrase that many sites repeat is no evidence
against itself, while a phrase that stands scattered over all sites about as
often as here is none of this site's and stays. Lines that are in excess and
recur are removed and the body is put together again by position. Lines are
split and keyed once, into a written step that counting and removal share.

The p-values are ranked by a histogram of their logarithm (fixed width), so
nothing that grows with the data reaches the driver. Counting is a map-side
combined aggregation over 64-bit hashes of site and key; documents delivered
twice count once.

Defined cases: rows without an id are left out; rows without a url belong to no
site; null and empty bodies
count as documents of the site without lines; lines without letters are never
cases; a line that no document outside holds (or with no outside at all: a single
site, or a key recurring in every site) has nothing to compare with, and its
recurring decides; an empty table gives an empty result.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..runtime import materialize

#: Histogram of -log10(p): cells of 1/CELL, up to MOST.
CELL, MOST = 50, 400
#: Documents added to those holding a line outside, of twice as many added to all outside.
PRIOR = 0.5


def site_of(url: Column) -> Column:
    """Host of a url in lower case, without port and one leading ``www.`` or ``m.``; null without a host."""
    host = F.regexp_extract(F.lower(url), r"^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/:?#\s]+)", 1)
    return F.nullif(F.regexp_replace(host, r"^(?:www\.|m\.)", ""), F.lit(""))


def letters_of(line: Column) -> Column:
    return F.regexp_replace(F.lower(line), r"[^\p{L}]+", "")


@F.pandas_udf(T.DoubleType())
def _minus_log10_p(k1: pd.Series, n1: pd.Series, k2: pd.Series, n2: pd.Series) -> pd.Series:
    """-log10 of the one-sided p-value of the log-likelihood ratio for k1 of n1 against k2 of n2."""
    a, b, c, d = (np.asarray(x, float) for x in (k1, n1, k2, n2))
    pool = (a + c) / (b + d)
    with np.errstate(divide="ignore", invalid="ignore"):

        def ll(k, n, p):
            return np.where(k > 0, k * np.log(np.maximum(p, 1e-300)), 0) + np.where(n - k > 0, (n - k) * np.log(np.maximum(1 - p, 1e-300)), 0)

        g = 2 * (ll(a, b, a / b) + ll(c, d, c / d) - ll(a, b, pool) - ll(c, d, pool))
    g = np.where(a / b > c / d, np.maximum(g, 0), 0)
    z = np.sqrt(g)
    # log of the normal tail: exact for small z, the asymptotic series beyond
    small = np.array([math.erfc(min(x, 8.0) / math.sqrt(2)) / 2 for x in z])
    big = -(z * z) / 2 - np.log(np.maximum(z, 1) * math.sqrt(2 * math.pi)) - np.log1p(1 / np.maximum(z, 1) ** 2)
    return pd.Series(-np.where(z < 8, np.log(np.maximum(small, 1e-300)), big) / math.log(10))


def site_lines(docs: DataFrame, id_col: str = "docid", url_col: str = "url", body_col: str = "body") -> DataFrame:
    """``(id, line_no, site, key)`` with 64-bit hashes of site and key, for lines with letters."""
    d = docs.select(F.col(id_col).alias("id"), site_of(F.col(url_col)).alias("site"), F.col(body_col).alias("body")).where(F.col("id").isNotNull() & F.col("site").isNotNull() & F.col("body").isNotNull())
    lines = d.select("id", F.xxhash64("site").alias("site"), F.posexplode(F.split("body", "\n")).alias("pos", "line"))
    return lines.select("id", (F.col("pos") + 1).alias("line_no"), "site", letters_of(F.col("line")).alias("letters")).where(F.col("letters") != "").select("id", "line_no", "site", F.xxhash64("letters").alias("key"))


def site_sizes(docs: DataFrame, id_col: str = "docid", url_col: str = "url") -> DataFrame:
    """``(site, site_docs)``: documents of each site, with or without lines."""
    d = docs.select(site_of(F.col(url_col)).alias("host"), F.col(id_col).alias("id")).where(F.col("host").isNotNull())
    return d.groupBy(F.xxhash64("host").alias("site")).agg(F.count_distinct("id").alias("site_docs"))


def line_tests(lines: DataFrame, sizes: DataFrame, min_docs: int = 5, min_share: float = 0.02) -> DataFrame:
    """Recurring (site, key) pairs with counts inside and outside, and -log10 of the p-value; ``tested`` is the number of pairs.

    ``lines``: id, site, key; ``sizes``: site, site_docs.
    """
    inside = lines.select("site", "key", "id").distinct().groupBy("site", "key").agg(F.count("*").alias("docs"))
    pairs = materialize(inside.join(sizes, "site"), "pairs")
    recurs = (F.col("docs") >= min_docs) & (F.col("docs") >= min_share * F.col("site_docs"))
    cases = pairs.where(recurs)
    world = sizes.agg(F.coalesce(F.sum("site_docs"), F.lit(0))).scalar()
    keys = cases.select("key").distinct()
    # Of each key that recurs anywhere: documents holding it elsewhere, and documents of the sites in which it recurs.
    outside = pairs.join(keys, "key", "left_semi").groupBy("key").agg(F.sum(F.when(~recurs, F.col("docs")).otherwise(0)).alias("outside_docs"), F.sum(F.when(recurs, F.col("site_docs")).otherwise(0)).alias("used"))
    t = cases.join(outside, "key").withColumns({"all_docs": world, "tested": pairs.agg(F.count("*")).scalar()})
    t = t.withColumn("outside", F.col("all_docs") - F.col("used"))
    score = _minus_log10_p(F.col("docs").cast("double"), F.col("site_docs").cast("double"), F.col("outside_docs") + PRIOR, F.col("outside") + 2 * PRIOR)
    return t.select("site", "key", "docs", "site_docs", "outside_docs", "outside", "tested", F.when(F.col("outside_docs") > 0, score).otherwise(F.lit(float(MOST))).alias("score"))


def excess_lines(tests: DataFrame, rate: float = 0.05) -> DataFrame:
    """The pairs that pass the Benjamini-Hochberg procedure at the given false-discovery rate."""
    cells = tests.groupBy(F.least(F.floor(F.col("score") * CELL), F.lit(MOST * CELL)).alias("cell")).agg(F.count("*").alias("n"), F.max("tested").alias("tested")).toPandas()  # at most MOST * CELL rows
    if cells.empty:
        return tests.limit(0)
    cells = cells.sort_values("cell", ascending=False)
    rank = cells["n"].cumsum()
    passed = 10.0 ** (-cells["cell"] / CELL) <= rate * rank / cells["tested"]
    least = float(cells.loc[passed, "cell"].min()) / CELL if passed.any() else float("inf")
    return tests.where(F.col("score") >= F.lit(least))


def repeated_lines(docs: DataFrame, id_col: str = "docid", url_col: str = "url", body_col: str = "body", min_docs: int = 5, min_share: float = 0.02, rate: float = 0.05) -> DataFrame:
    """``(id, line_no)`` of the lines to remove."""
    lines = materialize(site_lines(docs, id_col, url_col, body_col), "site-lines")
    tests = materialize(line_tests(lines, site_sizes(docs, id_col, url_col), min_docs, min_share), "tests")
    bad = excess_lines(tests, rate).select("site", "key")
    return lines.join(bad, ["site", "key"], "left_semi").select(F.col("id").alias(id_col), "line_no").distinct()


def without_lines(docs: DataFrame, bad: DataFrame, id_col: str = "docid", body_col: str = "body") -> DataFrame:
    """One row per document: the body without the given lines, and how many were cut. Of repeated deliveries any one is kept."""
    d = docs.select(F.col(id_col).alias("id"), F.col(body_col).alias("body")).where(F.col("id").isNotNull())
    cut = bad.select(F.col(id_col).alias("id"), "line_no").groupBy("id").agg(F.collect_set("line_no").alias("cut"))  # bounded by the lines of one document
    d = d.join(cut, "id", "left").groupBy("id").agg(F.max_by("body", F.length("body")).alias("body"), F.first("cut").alias("cut"))
    kept = F.filter(F.split("body", "\n"), lambda line, k: ~F.array_contains(F.col("cut"), k + 1))
    return d.select(F.col("id").alias(id_col), F.when(F.col("cut").isNull(), F.col("body")).otherwise(F.array_join(kept, "\n")).alias(body_col), F.coalesce(F.size("cut"), F.lit(0)).alias("lines_cut"))
