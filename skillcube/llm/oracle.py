"""SQL (DuckDB) of the operators' queries that SQL can say, over the whole tables."""

from __future__ import annotations

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS payload, strlen(coalesce(html, '')) AS n FROM pages),
f AS (SELECT *, CASE WHEN n >= 100 THEN min(page_id) OVER (PARTITION BY payload) END AS first FROM p)
SELECT page_id, n::BIGINT AS payload_bytes, sha256(payload) AS payload_digest, CASE WHEN page_id <> first THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN page_id <> first THEN first END AS refers_to FROM f
"""

TOPK = """
WITH v AS (SELECT vec_id, list_transform(embedding, lambda x: floor(1024 * x::DOUBLE)) AS v FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.v, c.v)::BIGINT AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id AND len(q.v) = len(c.v) WHERE q.vec_id % 100 = 0)
SELECT query_id, rank, vec_id, score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id)::INTEGER AS rank FROM s) WHERE rank <= 10
"""

_WORDS = rf"regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_WINDOWS = rf"""i AS (SELECT item_id::VARCHAR AS item, {_WORDS} AS w FROM benchmark WHERE item_id IS NOT NULL),
ws AS (SELECT DISTINCT item, array_to_string(w[k : k + least(10, len(w)) - 1], ' ') AS win, least(10, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 9, CASE WHEN len(w) > 0 THEN 1 ELSE 0 END) + 1)) AS k FROM i)),"""

# A window's term that fewest words of documents are gives the places to look at; a span has the window's words and two more.
_NEAR = """
dp AS (SELECT r, p, w[p] AS x FROM (SELECT r, w, unnest(range(1, len(w) + 1)) AS p FROM d)),
wt AS (SELECT win, n, list_distinct(string_split(win, ' ')) AS need FROM (SELECT DISTINCT win, n FROM ws)),
df AS (SELECT x, count(*) AS k FROM dp GROUP BY x),
rare AS (SELECT win, any_value(n) AS n, any_value(need) AS need, arg_min(x, (k, x)) AS x FROM (SELECT win, n, need, unnest(need) AS x FROM wt) JOIN df USING (x) GROUP BY win HAVING count(*) = len(any_value(need))),
nw AS (SELECT DISTINCT r, win FROM (SELECT r, win, need, w[s : s + n + 1] AS part FROM (SELECT dp.r, rare.win, rare.n, rare.need, unnest(range(greatest(1, p - rare.n - 1), p + 1)) AS s FROM dp JOIN rare USING (x)) JOIN d USING (r))
  WHERE list_has_all(part, need)),
nr AS (SELECT r, count(*) AS n_near, string_agg(item, ',' ORDER BY item) AS near FROM (SELECT DISTINCT r, item FROM nw JOIN ws USING (win)) GROUP BY r)
"""

DECONTAM = rf"""
WITH {_WINDOWS}
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT r, n, k, array_to_string(w[k : k + n - 1], ' ') AS win FROM (SELECT r, w, n, unnest(range(1, len(w) - n + 2)) AS k FROM d CROSS JOIN (SELECT DISTINCT n FROM ws) WHERE len(w) >= n)),
h AS (SELECT r, k, dw.n AS n, item FROM dw JOIN ws ON dw.win = ws.win AND dw.n = ws.n),
c AS (SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + n)) AS p FROM h) GROUP BY r),
t AS (SELECT r, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT r, item FROM h) GROUP BY r),
{_NEAR}
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated,
  coalesce(n_near, 0)::BIGINT AS n_near, sha256(coalesce(near, '')) AS near_sha256
FROM d LEFT JOIN c USING (r) LEFT JOIN t USING (r) LEFT JOIN nr USING (r)
"""

PROXIMITY = rf"""
WITH {_WINDOWS}
d AS (SELECT row_number() OVER () AS r, doc_id, {_WORDS} AS w FROM documents),
{_NEAR}
SELECT doc_id, near AS items FROM d JOIN nr USING (r)
"""

JACCARD = rf"""
WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all({_LOW}, '[^\x20\x09-\x0D]+') AS w FROM documents),
s AS (SELECT doc_id, CASE WHEN len(w) >= 3 THEN list_distinct(list_transform(range(1, len(w) - 1), lambda k: w[k] || ' ' || w[k + 1] || ' ' || w[k + 2])) WHEN len(w) > 0 THEN [array_to_string(w, ' ')] ELSE [] END AS sh FROM w),
u AS (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
l AS (SELECT a.doc_id AS a, b.doc_id AS b FROM u a JOIN u b ON a.x = b.x AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
r AS (SELECT doc_id, doc_id AS root FROM s UNION SELECT l.b, r.root FROM r JOIN l ON r.doc_id = l.a)
SELECT doc_id, len(any_value(sh))::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN r USING (doc_id) GROUP BY doc_id
"""

EXACT = f"""
WITH d AS (SELECT doc_id, {_LOW} AS low FROM documents)
SELECT doc_id, max(doc_id) OVER w AS keep_id, count(*) OVER w AS group_size, doc_id = max(doc_id) OVER w AS kept, sha256(low) AS text_sha256 FROM d WINDOW w AS (PARTITION BY low)
"""

# Every order is applied to every document: the first filter of the order that it fails removes it.
AUDIT = r"""
WITH t AS (SELECT doc_id, coalesce(source, '') AS part, coalesce(text, '') AS x FROM documents),
w AS (SELECT *, regexp_extract_all(x, '[^\x20\x09-\x0D]+') AS w FROM t),
l AS (SELECT doc_id, max(CASE WHEN quality = 1 THEN 1 ELSE 0 END) AS good, max(CASE WHEN toxic = 1 THEN 1 ELSE 0 END) AS toxic FROM labels GROUP BY doc_id),
f AS (SELECT part, coalesce(good, 0) AS good, coalesce(toxic, 0) AS toxic,
  CASE WHEN len(w) < 50 THEN 'A' ELSE '' END || CASE WHEN 100 * len(list_distinct(w)) < 65 * len(w) THEN 'B' ELSE '' END
  || CASE WHEN 100 * len(regexp_replace(x, '[^A-Z]+', '', 'g')) > 5 * len(x) THEN 'C' ELSE '' END || CASE WHEN regexp_matches(x, '[#$%&*|]') THEN 'D' ELSE '' END
  || CASE WHEN coalesce(doc_id > min(doc_id) OVER (PARTITION BY x), false) THEN 'E' ELSE '' END AS fails FROM w LEFT JOIN l USING (doc_id)),
s AS (SELECT unnest(['A', 'B', 'C', 'D', 'E']) AS k),
o AS (SELECT a.k || b.k || c.k || d.k || e.k AS ord FROM s a JOIN s b ON b.k <> a.k JOIN s c ON c.k NOT IN (a.k, b.k) JOIN s d ON d.k NOT IN (a.k, b.k, c.k) JOIN s e ON e.k NOT IN (a.k, b.k, c.k, d.k)),
c AS (SELECT part, fails, count(*) AS n, sum(good) AS good, sum(toxic) AS toxic FROM f GROUP BY part, fails),
r AS (SELECT part, ord, n, good, toxic, fails, CASE WHEN fails = '' THEN 6 ELSE list_min(list_transform(range(1, len(fails) + 1), lambda i: instr(ord, fails[i]))) END AS gone FROM c CROSS JOIN o),
p AS (SELECT part, ord, step, substr(ord, step, 1) AS k, sum(CASE WHEN gone > step THEN n ELSE 0 END) AS kept, sum(CASE WHEN gone = step THEN n ELSE 0 END) AS removed,
  sum(CASE WHEN gone < step AND contains(fails, substr(ord, step, 1)) THEN n ELSE 0 END) AS redundant, sum(CASE WHEN fails = substr(ord, step, 1) THEN n ELSE 0 END) AS unique_fails,
  sum(CASE WHEN gone = step THEN good ELSE 0 END) AS good_lost, sum(CASE WHEN gone = step THEN toxic ELSE 0 END) AS toxic_lost
  FROM r CROSS JOIN (SELECT unnest(range(1, 6)) AS step) GROUP BY part, ord, step)
SELECT part, ord AS filter_order, step::INTEGER AS step, kept::BIGINT AS kept, removed::BIGINT AS removed, redundant::BIGINT AS redundant, unique_fails::BIGINT AS unique_fails, good_lost::BIGINT AS good_lost,
  toxic_lost::BIGINT AS toxic_lost, (sum(removed) OVER (PARTITION BY part, k))::BIGINT AS shapley FROM p
"""

# Every term of every pair is looked at.
SOURCES = rf"""
WITH d AS (SELECT row_number() OVER () AS r, coalesce(lang, '') AS lang, coalesce(source, '') AS source, regexp_extract_all({_LOW}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
t AS (SELECT r, lang, source, unnest(w) AS term FROM d),
v AS (SELECT lang, term, count(*)::HUGEINT AS lang_n FROM t GROUP BY lang, term HAVING count(DISTINCT r) >= 3),
c AS (SELECT lang, source, term, count(*) AS n FROM t GROUP BY ALL),
k AS (SELECT g.lang, g.source, v.term, lang_n, coalesce(n, 0)::HUGEINT AS n FROM g JOIN v USING (lang) LEFT JOIN c ON c.lang = g.lang AND c.source = g.source AND c.term = v.term),
p AS (SELECT lang, source, term, n, 1 + 1000000000 * (n + 1) // (sum(n) OVER w + count(*) OVER w)::HUGEINT AS p, 1 + 1000000000 * (lang_n + 1) // (sum(lang_n) OVER w + count(*) OVER w)::HUGEINT AS q FROM k WINDOW w AS (PARTITION BY lang, source)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p)::HUGEINT AS value FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pa AS (SELECT a.lang, a.source, b.source AS item, coalesce(value, 0)::BIGINT AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
te AS (SELECT lang, source, term AS item, ((p - q) * (p - q) // q)::BIGINT AS value FROM p WHERE n > 0 AND p > q),
u AS (SELECT 'pair' AS part, * FROM pa UNION ALL SELECT 'term', * FROM te),
r AS (SELECT lang, source, part, item, value, row_number() OVER (PARTITION BY part, lang, source ORDER BY value DESC, item)::INTEGER AS rank FROM u)
SELECT * FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLE_SQL = {
    "op4_warc": WARC, "op5_topk": TOPK, "op6_decontam": DECONTAM, "op10_jaccard_join": JACCARD, "op11_exact_dedup": EXACT, "op12_filter_audit": AUDIT, "op13_source_audit": SOURCES, "proximity_matches": PROXIMITY,
}
