"""Token arrays and masks over whole documents, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import tokens as K
from ..functions.text import filled
from ..runtime import table
from . import common as C

#: Markers of the title and the body field.
TITLE, BODY = (100, 101), (200, 201)
#: Ids taken for punctuation: those divisible by 23.
SKIPPED = list(range(23, 30010, 23))


def query_tokens(spark, d):
    q = C.queries_once(spark, d)
    return q.select("qid", C.joined(K.query_ids(C.token_ids(F.col("text")), 32)).alias("ids"))


def doc_tokens(spark, d):
    t = table(spark, d, "documents")
    return t.select("doc_id", C.joined(K.doc_ids(C.token_ids(F.col("text")), 180)).alias("ids"))


def punctuation_mask(spark, d):
    t = table(spark, d, "documents").select("doc_id", K.doc_ids(C.token_ids(F.col("text")), 180).alias("ids"))
    m = K.skip_mask(F.col("ids"), SKIPPED)
    return t.select("doc_id", F.size(F.filter(m, lambda x: x)).alias("n_kept"), F.size("ids").alias("n"))


def _marked(spark, d):
    """``[CLS] title markers body markers`` of every raw document, all tokens."""
    t = C.documents_once(spark, d)
    parts = [F.array(F.lit(K.CLS)), F.array(F.lit(TITLE[0])), C.token_ids(filled(F.col("title"))), F.array(F.lit(TITLE[1])), F.array(F.lit(BODY[0])), C.token_ids(filled(F.col("body"))), F.array(F.lit(BODY[1])), F.array(F.lit(K.SEP))]
    return t.select("docid", F.concat(*parts).alias("ids"))


def field_mask_title(spark, d):
    m = _marked(spark, d).select("docid", "ids", K.field_mask(F.col("ids"), [TITLE]).alias("m"))
    return m.select("docid", F.size(F.filter("m", lambda x: x)).alias("n_inside"), C.joined(K.kept(F.col("ids"), F.col("m"))).alias("kept"))


def field_mask_markers(spark, d):
    m = _marked(spark, d).select("docid", K.field_mask(F.col("ids"), [TITLE, BODY], keep_markers=True).alias("m"))
    return m.select("docid", F.size(F.filter("m", lambda x: x)).alias("n_inside"))


def doc_keep_mask(spark, d):
    m = _marked(spark, d)
    inside = K.field_mask(F.col("ids"), [TITLE, BODY])
    return m.select("docid", F.size(K.kept(F.col("ids"), inside, K.skip_mask(F.col("ids"), SKIPPED))).alias("doclen"))


QUERIES = {f.__name__: f for f in (query_tokens, doc_tokens, punctuation_mask, field_mask_title, field_mask_markers, doc_keep_mask)}

_T = C.sql_token_ids
_DOC = f"t AS (SELECT doc_id, [1, 4] || ({_T('text')})[1:177] || [2] AS ids FROM documents)"
# Running depth by window; inside where it stands above its lowest point so far.
_FLAT = f"m AS (SELECT docid, [1, 100] || {_T('title')} || [101, 200] || {_T('body')} || [201, 2] AS ids FROM docs), x AS (SELECT docid, unnest(range(1, len(ids) + 1)) AS i, unnest(ids) AS id FROM m)"


def _depth(name: str, b: int, e: int) -> str:
    return f"""{name}0 AS (SELECT *, sum(CASE id WHEN {b} THEN 1 WHEN {e} THEN -1 ELSE 0 END) OVER (PARTITION BY docid ORDER BY i) AS s FROM x),
{name}1 AS (SELECT *, s - least(0, min(s) OVER (PARTITION BY docid ORDER BY i)) AS depth FROM {name}0),
{name} AS (SELECT docid, i, id, depth > 0 AND id NOT IN ({b}, {e}) AS inside, (id = {b}) OR (id = {e} AND coalesce(lag(depth) OVER (PARTITION BY docid ORDER BY i), 0) > 0) AS marker FROM {name}1)"""


SQL = {
    "query_tokens": C.with_(C.QUERIES_ONCE, f"p AS (SELECT qid, [1] || ({_T('text')})[1:30] || [2] AS a FROM qs), r AS (SELECT qid, a || list_transform(range(0, greatest(32 - len(a), 0)), lambda i: 5) AS a FROM p)") + "SELECT qid, array_to_string(a[1:1] || [3] || a[2:31], ',') AS ids FROM r",
    "doc_tokens": C.with_(_DOC) + "SELECT doc_id, array_to_string(ids, ',') AS ids FROM t",
    "punctuation_mask": C.with_(_DOC) + "SELECT doc_id, CAST(len(list_filter(ids, lambda x: x <> 0 AND x % 23 <> 0)) AS INTEGER) AS n_kept, CAST(len(ids) AS INTEGER) AS n FROM t",
    "field_mask_title": C.with_(C.DOCS, _FLAT, _depth("a", *TITLE)) + "SELECT docid, CAST(count(*) FILTER (inside) AS INTEGER) AS n_inside, coalesce(string_agg(CAST(id AS VARCHAR), ',' ORDER BY i) FILTER (inside), '') AS kept FROM a GROUP BY docid",
    "field_mask_markers": C.with_(C.DOCS, _FLAT, _depth("a", *TITLE), _depth("b", *BODY)) + "SELECT docid, CAST(count(*) FILTER (a.inside OR a.marker OR b.inside OR b.marker) AS INTEGER) AS n_inside FROM a JOIN b USING (docid, i) GROUP BY docid",
    "doc_keep_mask": C.with_(C.DOCS, _FLAT, _depth("a", *TITLE), _depth("b", *BODY)) + "SELECT docid, CAST(count(*) FILTER ((a.inside OR b.inside) AND a.id <> 0 AND a.id % 23 <> 0) AS INTEGER) AS doclen FROM a JOIN b USING (docid, i) GROUP BY docid",
}
