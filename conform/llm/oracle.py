"""DuckDB SQL with the same results as the registered queries, written without their methods."""

from __future__ import annotations

from collections.abc import Mapping

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

WARC = """
WITH p AS (SELECT page_id, coalesce(html, '') AS h FROM pages),
d AS (SELECT page_id, strlen(h) AS payload_bytes, sha1(h) AS hex, max(page_id) OVER (PARTITION BY h) AS keeper FROM p)
SELECT page_id, CAST(payload_bytes AS BIGINT) AS payload_bytes,
  list_aggregate(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST((('0x' || substr(hex, (i // 4) * 5 + 1, 5))::INT >> (15 - 5 * (i % 4))) & 31 AS INT) + 1, 1)), 'string_agg', '') AS payload_digest,
  CASE WHEN page_id = keeper THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN page_id <> keeper THEN keeper END AS refers_to
FROM d
"""

REPEATS = r"""
WITH t AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
starts AS (SELECT doc_id, w, unnest(range(0, len(w) - 19)) AS s FROM t WHERE len(w) >= 20),
win AS (SELECT doc_id, s, array_to_string(w[s + 1:s + 20], ' ') AS k FROM starts),
later AS (SELECT doc_id, s FROM (SELECT doc_id, s, row_number() OVER (PARTITION BY k ORDER BY doc_id, s) AS n FROM win) WHERE n > 1),
gone AS (SELECT DISTINCT doc_id, s + unnest(range(0, 20)) AS i FROM later),
words AS (SELECT doc_id, unnest(range(0, len(w))) AS i, unnest(w) AS word FROM t WHERE len(w) > 0),
kept AS (SELECT doc_id, count(*) AS n_kept, string_agg(word, ' ' ORDER BY i) AS k FROM words ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT t.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(len(w) - coalesce(n_kept, 0) AS BIGINT) AS n_removed, sha256(coalesce(k, '')) AS kept_sha256
FROM t LEFT JOIN kept USING (doc_id)
"""

OVERLAP = rf"""
WITH d AS (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
b AS (SELECT item_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark),
bw AS (SELECT DISTINCT item_id, least(13, len(w)) AS n, array_to_string(w[s + 1:s + 13], ' ') AS k
       FROM (SELECT item_id, w, unnest(range(0, greatest(1, len(w) - 12))) AS s FROM b WHERE len(w) > 0)),
ds AS (SELECT doc_id, w, n, unnest(range(0, len(w) - n + 1)) AS s FROM d, (SELECT DISTINCT n FROM bw) WHERE len(w) >= n),
hit AS (SELECT doc_id, s, bw.n, item_id FROM (SELECT doc_id, s, n, array_to_string(w[s + 1:s + n], ' ') AS k FROM ds) x JOIN bw USING (n, k)),
words AS (SELECT doc_id, count(DISTINCT i) AS n_hit FROM (SELECT doc_id, s + unnest(range(0, n)) AS i FROM hit) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(i, ',' ORDER BY i) AS l FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS i FROM hit) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(l, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated
FROM d LEFT JOIN words USING (doc_id) LEFT JOIN items USING (doc_id)
"""


def mix(weights: Mapping[str, int], other: int, block: int) -> str:
    """The schedule slot by slot: of the released blocks the one with the earliest deadline."""
    streams = {f"={s}": w for s, w in weights.items()} | {"*": other}
    total = sum(streams.values())
    values = ", ".join(f"('{s}', {w})" for s, w in streams.items())
    known = ", ".join(f"'{s}'" for s in weights)
    return f"""
WITH RECURSIVE wt(s, w) AS (VALUES {values}),
sub AS (SELECT s, i, (i * {total}) // w AS rel, ((i + 1) * {total} + w - 1) // w AS due, s || '#' || i AS k FROM wt, range(0, {total}) r(i) WHERE i < w),
plan(slot, done) AS (SELECT 0, []::VARCHAR[] UNION ALL
  SELECT slot + 1, list_append(done, (SELECT arg_min(k, row(due, s)) FROM sub WHERE rel <= slot AND NOT list_contains(done, k))) FROM plan WHERE slot < {total}),
placed AS (SELECT unnest(range(0, {total})) AS slot, unnest(done) AS k FROM plan WHERE slot = {total}),
d AS (SELECT doc_id, source, CASE WHEN source IN ({known}) THEN source END AS stream FROM documents),
n AS (SELECT *, row_number() OVER (PARTITION BY stream ORDER BY doc_id NULLS FIRST) - 1 AS pos FROM d),
x AS (SELECT n.*, pos // {block} AS block, pos % {block} AS place, coalesce('=' || stream, '*') AS s FROM n)
SELECT doc_id, source, stream, CAST(block AS BIGINT) AS block, CAST((block * {total}) // w AS BIGINT) AS release,
  CAST(((block + 1) * {total} + w - 1) // w AS BIGINT) AS deadline, CAST((block // w) * {total} + slot AS BIGINT) AS slot, CAST(place AS INTEGER) AS place
FROM x JOIN wt USING (s) JOIN placed ON placed.k = x.s || '#' || (block % w)
"""


URLS = rf"""
WITH RECURSIVE r(host, path, verdict) AS (VALUES ('com', '/', 'allow'), ('example.com', '/en/', 'block'), ('www.example.com', '/en/', 'allow'),
  ('net', '/es/', 'block'), ('net', '/fr/', 'block')),
p AS (SELECT page_id, coalesce({LOWER.format("regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1)")}, '') AS host, coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') AS path, coalesce(regexp_extract(url, '(?s)^.*?://[^?#]*(\?[^#]*)', 1), '') AS query, html FROM pages),
tag AS (SELECT host || path || query AS a, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)\b[^>]*>')) AS t FROM p WHERE host <> ''),
target AS (SELECT a, CASE WHEN regexp_matches(t, '(?i)^<link') AND regexp_matches(t, '(?i)\brel\s*=\s*["'']?canonical\b') THEN regexp_extract(t, '(?i)\bhref\s*=\s*["'']?([^"''\s>]+)', 1)
  WHEN regexp_matches(t, '(?i)^<meta') AND regexp_matches(t, '(?i)\bhttp-equiv\s*=\s*["'']?refresh\b') THEN regexp_extract(t, '(?i)\burl\s*=\s*["'']?([^"''\s>]+)', 1) END AS u FROM tag),
edge AS (SELECT a, {LOWER.format("regexp_extract(u, '(?s)^.*?://([^/?#]*)', 1)")} || regexp_extract(u, '(?s)^.*?://[^/?#]*([^#]*)', 1) AS b FROM target WHERE u LIKE '%://%'),
both_ways AS (SELECT a, b FROM edge WHERE a <> b UNION SELECT b, a FROM edge WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM both_ways UNION SELECT reach.a, both_ways.b FROM reach JOIN both_ways ON reach.b = both_ways.a),
addr AS (SELECT host || path || query AS k, host, path FROM p WHERE host <> '' UNION SELECT b, regexp_extract(b, '^[^/?]*'), regexp_extract(b, '(?s)^[^/?]*([^?]*)', 1) FROM reach),
ruled AS (SELECT k, arg_max(r.host || r.path, length(r.host || r.path)) AS rule, arg_max(verdict, length(r.host || r.path)) AS v
  FROM addr JOIN r ON (addr.host = r.host OR addr.host LIKE '%.' || r.host) AND starts_with(addr.path, r.path) GROUP BY k),
alias AS (SELECT reach.a AS k, bool_or(v = 'block') AND NOT bool_or(v = 'allow') AS blocked FROM reach JOIN ruled ON ruled.k = reach.b GROUP BY reach.a)
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN blocked THEN 'block' ELSE 'allow' END) AS verdict
FROM p LEFT JOIN ruled ON host <> '' AND ruled.k = host || path || query LEFT JOIN alias ON host <> '' AND alias.k = host || path || query
"""


def divergence(least: int, top: int) -> str:
    """Every two sources over every kept term, one by one."""
    share = "1 + (1000000000::HUGEINT * ({n} + 5)) // ({total}::HUGEINT + 5 * v)"
    return rf"""
WITH d AS (SELECT row_number() OVER () AS id, coalesce(text, '') AS text, coalesce(lang, '') AS lang, coalesce(source, '') AS source FROM documents),
g AS (SELECT DISTINCT lang, source FROM d),
w AS (SELECT id, lang, source, unnest(regexp_extract_all({LOWER.format("text")}, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n_lang FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= {least}),
lt AS (SELECT lang, count(*) AS v, sum(n_lang) AS total_lang FROM kept GROUP BY lang),
own AS (SELECT lang, source, term, count(*) AS n FROM w JOIN kept USING (lang, term) GROUP BY lang, source, term),
cell AS (SELECT g.lang, g.source, term, coalesce(n, 0) AS n, n_lang FROM g JOIN kept USING (lang) LEFT JOIN own USING (lang, source, term)),
tot AS (SELECT lang, source, sum(n) AS total FROM cell GROUP BY lang, source),
s AS (SELECT lang, source, term, n, {share.format(n="n", total="total")} AS p, {share.format(n="n_lang", total="total_lang")} AS q FROM cell JOIN tot USING (lang, source) JOIN lt USING (lang)),
pv AS (SELECT a.lang, a.source, b.source AS item, sum(abs(a.p - b.p)) AS value FROM s a JOIN s b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY ALL),
pairs AS (SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(value, 0) AS value FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN pv ON pv.lang = a.lang AND pv.source = a.source AND pv.item = b.source),
rest AS (SELECT lang, source, 'term' AS part, term AS item, p - q AS value FROM s WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS rank FROM (SELECT * FROM pairs UNION ALL SELECT * FROM rest))
SELECT lang, source, part, item, CAST(value AS BIGINT) AS value, CAST(rank AS INTEGER) AS rank FROM ranked WHERE part = 'pair' OR rank <= {top}
"""
