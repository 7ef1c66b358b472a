"""DuckDB SQL with the same rows as the registered queries that SQL can express."""

from __future__ import annotations

#: Word rule of the size columns.
_WORDS = r"len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))"

_MIX = rf"""
WITH docs AS (
  SELECT doc_id, source, {_WORDS}::BIGINT AS size, md5('7:' || coalesce(doc_id::VARCHAR, 'null')) AS key FROM documents
),
sizes AS (SELECT source, sum(size)::BIGINT AS source_size FROM docs GROUP BY source),
sources AS (
  SELECT source, source_size, source_size * 3 AS cap,
    [5.0::DOUBLE, 2.0::DOUBLE, 1.0::DOUBLE][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight
  FROM sizes
),
filled AS (
  SELECT *, row_number() OVER low AS place,
    sum(source_size) OVER () AS total,
    coalesce(sum(cap) OVER low, 0) AS clamped,
    sum(weight) OVER () - coalesce(sum(weight) OVER low, 0) AS open_weight
  FROM sources
  WINDOW low AS (ORDER BY cap / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)
),
levels AS (SELECT *, (total - clamped)::DOUBLE / open_weight AS height FROM filled),
level AS (SELECT arg_min(height, place) FILTER (weight * height <= cap) AS height FROM levels),
targets AS (
  SELECT source, source_size, least(cap::DOUBLE, weight * height) AS target FROM sources, level
),
shares AS (
  SELECT *, CASE WHEN source_size > 0 THEN floor(target / source_size) ELSE 0 END AS whole FROM targets
),
running AS (
  SELECT doc_id, source, size,
    coalesce(sum(size) OVER (PARTITION BY source ORDER BY key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM docs
)
SELECT r.doc_id, r.size, s.source_size, s.target,
  (r.size * (s.whole + CASE WHEN s.target - s.whole * s.source_size > 0
    AND r.before * 2 + r.size <= (s.target - s.whole * s.source_size) * 2 THEN 1 ELSE 0 END))::BIGINT AS taken
FROM running r JOIN shares s ON r.source IS NOT DISTINCT FROM s.source
"""

_SHARDS = """
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
),
docs AS (
  SELECT doc_id, source, strlen(coalesce(text, '')) + 16 AS size, hex(encode(coalesce(text, ''))) AS hx,
    md5('11:' || coalesce(doc_id::VARCHAR, 'null')) AS key
  FROM documents
),
summed AS (
  SELECT doc_id, source, size, key,
    xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(hx) // 2),
      lambda i: (('0x' || substr(hx, (2 * i + 1)::INT, 2))::INT)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT)::BIGINT AS text_crc32
  FROM docs, crc_table
),
ranked AS (
  SELECT *, row_number() OVER (PARTITION BY source ORDER BY key, doc_id, size, text_crc32) - 1 AS r,
    count(*) OVER (PARTITION BY source) AS n, count(*) OVER () AS total
  FROM summed
),
mixed AS (
  SELECT *, row_number() OVER (ORDER BY (r + 0.5::DOUBLE) / n, key, doc_id, size, text_crc32) - 1 AS g FROM ranked
)
SELECT doc_id, size::BIGINT AS size, text_crc32, 'rows' AS law, (g * 40 // total)::INT AS shard,
  (g - ((g * 40 // total) * total + 39) // 40)::BIGINT AS slot, NULL::INT AS grown_shard
FROM mixed
"""

_WARC = """
WITH captured AS (
  SELECT page_id, strlen(coalesce(html, ''))::BIGINT AS payload_bytes, sha256(coalesce(html, '')) AS payload_digest FROM pages
),
firsts AS (
  SELECT *, first_value(page_id) OVER own AS first_id, row_number() OVER own > 1 AS again FROM captured
  WINDOW own AS (PARTITION BY payload_digest ORDER BY page_id NULLS LAST)
)
SELECT page_id, payload_bytes, payload_digest,
  CASE WHEN payload_bytes >= 100 AND again THEN 'revisit' ELSE 'response' END AS record_type,
  CASE WHEN payload_bytes >= 100 AND again THEN first_id END AS refers_to
FROM firsts
"""

_NEAR = r"""
WITH RECURSIVE split AS MATERIALIZED (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[^\x20\x09-\x0D]+') AS w FROM documents
),
shingles AS MATERIALIZED (
  SELECT DISTINCT doc_id, unnest(CASE
    WHEN len(w) = 0 THEN []
    WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END) AS s
  FROM split
),
sizes AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
links AS MATERIALIZED (
  SELECT x.a, x.b FROM (
    SELECT l.doc_id AS a, r.doc_id AS b, count(*) AS both_n
    FROM shingles l JOIN shingles r ON l.s = r.s AND l.doc_id <> r.doc_id GROUP BY ALL) x
  JOIN sizes p ON p.doc_id = x.a JOIN sizes q ON q.doc_id = x.b
  WHERE 100 * both_n >= 75 * (p.n + q.n - both_n)
),
reach AS (
  SELECT doc_id, doc_id AS seen FROM documents
  UNION
  SELECT r.doc_id, l.b FROM reach r JOIN links l ON l.a = r.seen
),
firsts AS (SELECT doc_id, min(seen) AS component_id FROM reach GROUP BY doc_id)
SELECT d.doc_id, coalesce(n, 0)::BIGINT AS n_shingles, component_id, d.doc_id = component_id AS kept
FROM documents d JOIN firsts f ON f.doc_id = d.doc_id LEFT JOIN sizes s ON s.doc_id = d.doc_id
"""

_LOWER = r"translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_TERMS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')"

_RANKED = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS r, doc_id, {_TERMS} AS w FROM documents),
sizes AS MATERIALIZED (SELECT r, doc_id, len(w)::BIGINT AS n FROM docs WHERE len(w) > 0),
totals AS MATERIALIZED (SELECT count(*)::BIGINT AS n_docs, sum(n)::BIGINT AS n_terms FROM sizes),
items AS MATERIALIZED (
  SELECT DISTINCT i, item_id, unnest(w) AS t FROM (SELECT row_number() OVER () AS i, item_id, {_TERMS} AS w FROM benchmark)
),
held AS MATERIALIZED (
  SELECT r, t, count(*)::BIGINT AS tf FROM (SELECT r, unnest(w) AS t FROM docs)
  WHERE t IN (SELECT t FROM items) GROUP BY ALL
),
weights AS MATERIALIZED (
  SELECT t, floor(1000 * ln((2 * n_docs + 2)::DOUBLE / (2 * count(*) + 1)))::BIGINT AS weight
  FROM held, totals GROUP BY t, n_docs
),
scores AS (
  SELECT i, item_id, doc_id,
    sum(weight * ((1000000000 * tf) // (1000 * tf + 20 * (50 + (50 * n * n_docs) // n_terms))))::BIGINT AS score
  FROM items JOIN held USING (t) JOIN weights USING (t) JOIN sizes USING (r), totals GROUP BY i, item_id, r, doc_id
)
SELECT item_id, row_number() OVER (PARTITION BY i ORDER BY score DESC, doc_id NULLS FIRST)::INT AS rank, doc_id, score
FROM scores WHERE score > 0 QUALIFY rank <= 50
"""

_TRIE = """
WITH crc_table AS MATERIALIZED (
  SELECT list_transform(range(256), lambda n: list_reduce(
    list_prepend(n::UBIGINT, list_transform(range(8), lambda k: 0::UBIGINT)),
    lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384::UBIGINT) ELSE c >> 1 END)) AS t
),
said AS MATERIALIZED (
  SELECT conv_id, hex(encode(conv_id::VARCHAR)) AS hx, list({'r': coalesce(role, ''), 't': coalesce(text, '')}
    ORDER BY turn NULLS FIRST, coalesce(role, ''), coalesce(text, '')) AS s
  FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id
),
wanted AS (
  SELECT conv_id, s, (xor(list_reduce(list_prepend(4294967295::UBIGINT, list_transform(range(strlen(hx) // 2),
      lambda i: (('0x' || substr(hx, (2 * i + 1)::INT, 2))::INT)::UBIGINT)),
      lambda c, b: xor(c >> 8, t[(xor(c, b) & 255)::INT + 1])), 4294967295::UBIGINT) % 6)::INT AS h
  FROM said, crc_table
),
whole AS MATERIALIZED (
  SELECT w.conv_id, list_concat(CASE WHEN b.conv_id IS NULL THEN [] ELSE b.s[1:w.h] END, w.s[w.h + 1:]) AS s
  FROM wanted w LEFT JOIN said b ON b.conv_id = w.conv_id - w.conv_id % 100
),
places AS (SELECT conv_id, s, unnest(range(0, len(s) + 1)) AS depth FROM whole),
members AS MATERIALIZED (
  SELECT conv_id, depth, len(s) = depth AS last, coalesce(length(s[depth].t), 0) AS chars,
    array_to_string(list_transform(s[1:depth], lambda x: length(x.r) || ':' || length(x.t) || ':' || x.r || x.t), '') AS path,
    array_to_string(list_transform(s[1:depth - 1], lambda x: length(x.r) || ':' || length(x.t) || ':' || x.r || x.t), '') AS above
  FROM places
),
nodes AS MATERIALIZED (
  SELECT depth, path, min(above) AS above, min(conv_id) AS conv_id, count(*) AS n_convs, max(chars) AS chars,
    sha256(coalesce(string_agg(conv_id::VARCHAR, ',' ORDER BY conv_id) FILTER (WHERE last), '')) AS ends_sha256
  FROM members GROUP BY depth, path
),
children AS MATERIALIZED (SELECT depth - 1 AS depth, above AS path, count(*) AS n FROM nodes WHERE depth > 0 GROUP BY ALL),
sums AS (
  SELECT m.depth, m.path, count(*) FILTER (WHERE c.n IS NULL) AS n_leaves, sum((n.n_convs - 1) * n.chars) AS saved
  FROM nodes n LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
  JOIN members m ON m.conv_id = n.conv_id AND m.depth <= n.depth GROUP BY ALL
)
SELECT n.conv_id, n.depth::BIGINT AS depth, p.conv_id AS parent_conv_id, n.n_convs::BIGINT AS n_convs,
  coalesce(c.n, 0)::BIGINT AS n_children, s.n_leaves::BIGINT AS n_leaves, s.saved::BIGINT AS saved_tokens, n.ends_sha256
FROM nodes n JOIN sums s ON s.depth = n.depth AND s.path = n.path
LEFT JOIN nodes p ON p.depth = n.depth - 1 AND p.path = n.above
LEFT JOIN children c ON c.depth = n.depth AND c.path = n.path
"""

_KEYWORDS = "|".join(
    "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word) for word in ("password", "passwd", "secret", "token", "api_?key")
)
_SECRET_PATTERNS = {
    "assign": rf"""({_KEYWORDS})["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)""",
    "access": "AKIA[A-Z0-9]+",
    "hex": "[0-9a-f]+",
    "random": "[A-Za-z0-9+/_-]{16,}={0,2}",
}
_SECRET_MATCHES = " UNION ALL ".join(
    f"SELECT rid, '{kind}' AS kind, {place} AS place, regexp_extract_all(text, '{pattern}') AS h, "
    f"string_split_regex(text, '{pattern}') AS g FROM docs"
    for place, (kind, pattern) in enumerate(_SECRET_PATTERNS.items())
)
_IDENTIFIER = "^[+/_=-]*(?:(?:[A-Z]?[a-z]{2,}(?:[A-Z][a-z]{2,})*|[A-Z]{2,}|[0-9]+)(?:[+/_=-]+|$))+$"
_STATES = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-="

_SECRETS = rf"""
WITH docs AS MATERIALIZED (SELECT row_number() OVER () AS rid, doc_id, coalesce(text, '') AS text FROM documents),
matches AS ({_SECRET_MATCHES}),
places AS (SELECT rid, kind, place, h, g, unnest(range(1, len(h) + 1)) AS i FROM matches),
located AS (
  SELECT rid, kind, place, h[i] AS hit, (list_sum(list_transform(g[1:i], lambda x: length(x)))
    + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0))::BIGINT AS s
  FROM places
),
spans AS MATERIALIZED (
  SELECT *, s + length(hit) AS e FROM located WHERE CASE kind
    WHEN 'assign' THEN length(regexp_extract(hit, '{_SECRET_PATTERNS["assign"]}', 2)) >= 8
    WHEN 'access' THEN length(hit) >= 16 WHEN 'hex' THEN length(hit) >= 32 ELSE true END
),
touched AS MATERIALIZED (
  SELECT *, EXISTS (SELECT 1 FROM spans b WHERE b.rid = r.rid AND b.kind <> 'random' AND b.s < r.e AND r.s < b.e) AS inside
  FROM spans r WHERE kind = 'random'
),
made AS (
  SELECT unnest([left(sha256('hex:' || i), 40), left(upper(sha256('upper:' || i)), 40),
    left(base64(unhex(sha256('base64:' || i))), 40), left(translate(base64(unhex(sha256('address:' || i))), '+/', '-_'), 40)]) AS hit
  FROM range(4000) t(i)
),
samples AS MATERIALIZED (
  SELECT *, ('0x' || substr(md5(hit), 1, 8))::BIGINT % 5 = 0 AS held FROM (
    SELECT DISTINCT hit, inside AS random FROM touched
    WHERE length(hit) <= 128 AND inside <> regexp_matches(hit, '{_IDENTIFIER}')
    UNION ALL SELECT hit, true FROM made)
),
coded AS MATERIALIZED (
  SELECT hit, list_transform(string_split(hit, ''), lambda c: instr('{_STATES}', c)) AS c
  FROM (SELECT hit FROM samples UNION SELECT hit FROM touched)
),
pairs AS MATERIALIZED (
  SELECT hit, unnest(list_transform(range(1, len(c) + 1), lambda i: CASE WHEN i = 1 THEN 0 ELSE c[i - 1] END * 68 + c[i])) AS pair
  FROM coded
),
counts AS MATERIALIZED (
  SELECT random, pair, count(*) AS n FROM samples JOIN pairs USING (hit) WHERE NOT held GROUP BY ALL
),
grid AS (
  SELECT p.pair, coalesce(a.n, 0) AS a, coalesce(b.n, 0) AS b FROM range(68 * 68) p(pair)
  LEFT JOIN counts a ON a.random AND a.pair = p.pair LEFT JOIN counts b ON NOT b.random AND b.pair = p.pair
),
weights AS MATERIALIZED (
  SELECT pair, round(1000 * ln(((a + 0.5::DOUBLE) / (sum(a) OVER own + 34.0::DOUBLE))
    / ((b + 0.5::DOUBLE) / (sum(b) OVER own + 34.0::DOUBLE))))::BIGINT AS weight
  FROM grid WINDOW own AS (PARTITION BY pair // 68)
),
scores AS MATERIALIZED (SELECT hit, sum(weight)::BIGINT AS score FROM pairs JOIN weights USING (pair) GROUP BY hit),
steps AS (
  SELECT floor(score / 1000)::BIGINT AS step, count(*) AS n FROM samples JOIN scores USING (hit)
  WHERE held AND NOT random GROUP BY ALL
),
passing AS (SELECT step, sum(n) OVER (ORDER BY step DESC) AS n, sum(n) OVER () AS total FROM steps),
least AS (SELECT greatest(6908, coalesce((max(step) FILTER (WHERE n > 0.001::DOUBLE * total) + 1) * 1000, 0)) AS score FROM passing),
kept AS (
  SELECT rid, kind, place, s, e FROM spans WHERE kind <> 'random'
  UNION ALL
  SELECT rid, kind, place, s, e FROM touched JOIN scores USING (hit) JOIN least ON scores.score >= least.score WHERE NOT inside
),
lists AS (
  SELECT rid, count(*) FILTER (WHERE kind = 'assign') AS n_assign, count(*) FILTER (WHERE kind = 'access') AS n_access,
    count(*) FILTER (WHERE kind = 'hex') AS n_hex, count(*) FILTER (WHERE kind = 'random') AS n_random,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) FILTER (WHERE kind <> 'random') AS base,
    string_agg(kind || ':' || s || ':' || e, ',' ORDER BY s, place, e) AS spans
  FROM kept GROUP BY rid
)
SELECT doc_id, coalesce(n_assign, 0)::BIGINT AS n_assign, coalesce(n_access, 0)::BIGINT AS n_access,
  coalesce(n_hex, 0)::BIGINT AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans,
  coalesce(n_random, 0)::BIGINT AS n_random
FROM docs LEFT JOIN lists USING (rid)
"""

ORACLE: dict[str, str] = {
    "op11_markov_secrets": _SECRETS,
    "op12_prefix_trie": _TRIE,
    "op13_pair_bound_search": _RANKED,
    "op8_superminhash_groups": _NEAR,
    "op2_warc_transactions": _WARC,
    "op7_source_mix": _MIX,
    "op10_interleaved_shards": _SHARDS,
}
