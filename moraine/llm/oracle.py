"""SQL with the same results, for the queries that SQL can express."""

SITE = r"""regexp_replace(regexp_extract(lower(url), '^\s*(?:[a-z][a-z0-9+.\-]*:)?(?://)?(?:[^/?#@\s]*@)?([^/:?#\s]+)', 1), '^(?:www\.|m\.)', '')"""
STRIP = r"regexp_replace(regexp_replace(coalesce({c}, ''), '^[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+', ''), '[\s\x0b\x1c-\x1f\x{{85}}\x{{a0}}\x{{1680}}\x{{2000}}-\x{{200a}}\x{{2028}}\x{{2029}}\x{{202f}}\x{{205f}}\x{{3000}}]+$', '')"
_JOINED = STRIP.format(c="concat(" + STRIP.format(c="title") + ", ' ', " + STRIP.format(c="body") + ")")

SQL = {
    "p4_found": f"""
WITH d AS (SELECT DISTINCT docid, nullif({SITE}, '') AS site, body FROM msmarco_docs WHERE url IS NOT NULL),
sizes AS (SELECT site, count(DISTINCT docid) AS n FROM d WHERE site IS NOT NULL GROUP BY site),
parts AS (SELECT docid, site, string_split(body, chr(10)) AS ls FROM d WHERE site IS NOT NULL AND body IS NOT NULL),
lines AS (SELECT docid, site, unnest(range(1, len(ls) + 1)) AS line_no, unnest(ls) AS line FROM parts),
keyed AS (SELECT docid, site, CAST(line_no AS INTEGER) AS line_no, regexp_replace(lower(line), '[^\\p{{L}}]+', '', 'g') AS k FROM lines),
counts AS (SELECT site, k, count(DISTINCT docid) AS c FROM keyed WHERE k <> '' GROUP BY site, k)
SELECT DISTINCT docid, line_no FROM keyed JOIN counts USING (site, k) JOIN sizes USING (site) WHERE c >= 5 AND c >= 0.02 * n""",
    "p6_found": f"SELECT DISTINCT docid FROM msmarco_docs WHERE length({_JOINED}) > 2000",
    "p6_check": f"SELECT docid, md5(any_value({_JOINED})) AS whole, true AS limit_kept, true AS overlap_kept, true AS counted FROM msmarco_docs WHERE length({_JOINED}) > 2000 GROUP BY docid",
    "p8_found": """
WITH n AS (SELECT source, sum(len(regexp_extract_all(coalesce(text, ''), '\\w+|[^\\w\\s]'))) AS own FROM documents WHERE source IN (SELECT source FROM mix_targets) GROUP BY source),
t AS (SELECT sum(own) AS total FROM n)
SELECT DISTINCT m.source FROM mix_targets m LEFT JOIN n USING (source), t WHERE m.target_share * total > m.max_repeats * coalesce(own, 0)""",
    "p1_found": """
WITH d AS (SELECT docid, max(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL AND body IS NOT NULL GROUP BY docid),
w AS (SELECT docid, regexp_extract_all(lower(body), '[\\p{L}\\p{N}]+') AS ws FROM d),
s AS (SELECT DISTINCT docid, concat_ws(' ', ws[i], ws[i + 1], ws[i + 2]) AS g FROM (SELECT docid, ws, unnest(range(1, len(ws) - 1)) AS i FROM w)),
n AS (SELECT docid, count(*) AS c FROM s GROUP BY docid),
p AS (SELECT a.docid AS x, b.docid AS y, count(*) AS k FROM s a JOIN s b ON a.g = b.g AND a.docid < b.docid GROUP BY 1, 2)
SELECT x AS docid_a, y AS docid_b FROM p JOIN n a ON a.docid = x JOIN n b ON b.docid = y WHERE k >= 0.6 * (a.c + b.c - k)""",
    "p7_found": """
WITH norm AS (SELECT 'd' AS t, doc_id AS id, text FROM documents WHERE text IS NOT NULL UNION ALL SELECT 'i', item_id, text FROM benchmark WHERE text IS NOT NULL),
w AS (SELECT t, id, regexp_extract_all(regexp_replace(regexp_replace(regexp_replace(lower(text), '&(rsquo|lsquo|apos|#39|#8217|#8216);', '', 'g'), '&#?\\w+;', ' ', 'g'), '[''’‘ʼ′`´＇]', '', 'g'), '[\\p{L}\\p{N}]+') AS ws FROM norm),
x AS (SELECT DISTINCT t, id, unnest(range(0, len(ws))) AS pos, unnest(ws) AS word, len(ws) AS n FROM w),
m AS (SELECT d.id AS doc_id, i.id AS item_id, d.pos - i.pos AS off, i.n, list(i.pos ORDER BY i.pos) AS hit FROM x d JOIN x i ON d.t = 'd' AND i.t = 'i' AND d.word = i.word GROUP BY ALL HAVING count(*) >= 0.9 * ceil(0.5 * i.n)),
r AS (SELECT doc_id, item_id, n, hit, unnest(range(1, len(hit) + 1)) AS a FROM m),
b AS (SELECT doc_id, item_id, n, hit, a, unnest(range(a, len(hit) + 1)) AS b FROM r)
SELECT DISTINCT doc_id, item_id FROM b WHERE hit[b] - hit[a] + 1 >= ceil(0.5 * n) AND (hit[b] - hit[a] + 1) - (b - a + 1) <= 0.1 * (hit[b] - hit[a] + 1)""",
}
_CUT = f"cut AS (SELECT docid, list(line_no) AS nos FROM ({SQL['p4_found']}) GROUP BY docid)"
SQL["p4_clean"] = f"""
WITH {_CUT}, d AS (SELECT docid, max(body) AS body FROM msmarco_docs WHERE docid IS NOT NULL GROUP BY docid)
SELECT docid, CASE WHEN nos IS NULL THEN body ELSE array_to_string(list_filter(string_split(body, chr(10)), lambda x, i: NOT list_contains(nos, CAST(i AS INTEGER))), chr(10)) END AS body,
  CAST(coalesce(len(nos), 0) AS INTEGER) AS lines_cut FROM d LEFT JOIN cut USING (docid)"""
_PAIRS = SQL["p1_found"].rsplit("SELECT x AS", 1)[0]
SQL["p1_groups"] = _PAIRS.replace("WITH d AS", "WITH RECURSIVE d AS") + """,
l AS (SELECT x, y, k = a.c AND k = b.c AS same FROM p JOIN n a ON a.docid = x JOIN n b ON b.docid = y WHERE k >= 0.6 * (a.c + b.c - k)),
e AS (SELECT x, y, same FROM l UNION ALL SELECT y, x, same FROM l),
r AS (SELECT docid AS id, docid AS other FROM n UNION SELECT r.id, e.y FROM r JOIN e ON e.x = r.other),
g AS (SELECT id, min(other) AS group_id FROM r GROUP BY id),
c AS (SELECT n.docid, least(n.docid, coalesce(min(e.y), n.docid)) AS class FROM n LEFT JOIN e ON e.x = n.docid AND same GROUP BY n.docid),
m AS (SELECT a.class, count(DISTINCT b.class) AS links FROM e JOIN c a ON a.docid = x JOIN c b ON b.docid = y WHERE a.class <> b.class GROUP BY a.class)
SELECT g.id AS docid, group_id, coalesce(links, 0) AS links FROM g JOIN c ON c.docid = g.id LEFT JOIN m USING (class)"""

# The mix with sizes in white-space words: the same keys, epochs and prefix sums by windows over whole sources.
_W8 = """
WITH t AS (SELECT source, max(coalesce(target_share, 0.0)) AS share, max(coalesce(max_repeats, 0)) AS most FROM mix_targets WHERE source IS NOT NULL GROUP BY source),
r AS (SELECT doc_id, source, coalesce(text, '') AS x, len(regexp_extract_all(coalesce(text, ''), '[\\x21-\\x7e]+')) AS tokens FROM documents WHERE source IN (SELECT source FROM t)),
k AS (SELECT *, -ln((CAST('0x' || substr(md5('7|' || CAST(doc_id AS VARCHAR)), 1, 12) AS BIGINT) + 1) / 281474976710656.0::DOUBLE) / greatest(greatest(0.05::DOUBLE, (1.0::DOUBLE - CAST(length(x) - length(translate(x, '0123456789.,;:!?()[]{}<>|/\\*#@&%$_=+~^"''', '')) AS DOUBLE) / greatest(length(x), 1)) * least(1.0::DOUBLE, length(x) / 400.0::DOUBLE)), 1e-6::DOUBLE) AS key FROM r),
o AS (SELECT source, sum(tokens) AS own FROM r GROUP BY source),
p AS (SELECT t.source, share, most, CAST(coalesce(own, 0) AS BIGINT) AS own, share * (SELECT sum(own) FROM o) AS budget FROM t LEFT JOIN o USING (source)),
q AS (SELECT *, CASE WHEN own > 0 THEN least(most, CAST(floor(budget / own) AS BIGINT)) ELSE 0 END AS epochs FROM p),
c AS (SELECT k.doc_id, source, tokens, epochs, epochs < most AND sum(tokens) OVER (PARTITION BY source ORDER BY key, doc_id ROWS UNBOUNDED PRECEDING) <= budget - epochs * own AS extra FROM k JOIN q USING (source) WHERE tokens > 0),
m AS (SELECT doc_id, source, CAST(tokens AS BIGINT) AS tokens, CAST(epochs + CASE WHEN extra THEN 1 ELSE 0 END AS BIGINT) AS repeats FROM c)"""
SQL["p8_mix_words"] = _W8 + " SELECT * FROM m WHERE repeats > 0"
SQL["p8_shares_words"] = _W8 + """,
u AS (SELECT source, CAST(sum(tokens * repeats) AS BIGINT) AS used, count(*) AS records FROM m WHERE repeats > 0 GROUP BY source)
SELECT source, own AS own_tokens, CAST(epochs AS BIGINT) AS epochs, coalesce(records, 0) AS records, coalesce(used, 0) AS used_tokens, round(coalesce(used, 0) / (SELECT sum(used) FROM u), 9) AS share_of_mix, budget <= most * own AS reachable FROM q LEFT JOIN u USING (source)"""
