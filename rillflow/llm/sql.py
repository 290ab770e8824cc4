"""DuckDB SQL of the corpus queries that SQL can express on whole tables."""

OP1 = """
WITH d AS (
  SELECT doc_id, sha256(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')) AS text_sha256
  FROM documents),
g AS (SELECT text_sha256, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY text_sha256)
SELECT d.doc_id, g.keep_id, g.group_size, d.doc_id IS NOT DISTINCT FROM g.keep_id AS kept, d.text_sha256
FROM d JOIN g USING (text_sha256)
"""

OP6 = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         md5('mix-1:' || coalesce(CAST(doc_id AS VARCHAR), ':' || md5(coalesce(text, '')))) AS mix_key
  FROM documents),
p AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, row_number() OVER (ORDER BY source NULLS LAST) AS place
  FROM d GROUP BY source),
r AS (SELECT *, (place - 1) % 3 + 1 AS weight, 3 * source_size AS most, source_size / ((place - 1) % 3 + 1) AS ratio FROM p),
s AS (
  SELECT *,
    CAST(sum(source_size) OVER () - coalesce(sum(most) OVER (ORDER BY ratio, place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS DOUBLE)
    / CAST(sum(weight) OVER (ORDER BY ratio, place ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS DOUBLE) AS share
  FROM r),
f AS (SELECT ratio, place, share FROM s WHERE share * weight < most ORDER BY ratio, place LIMIT 1),
t AS (
  SELECT s.source, s.source_size,
    CASE WHEN f.place IS NULL OR s.ratio < f.ratio OR (s.ratio = f.ratio AND s.place < f.place) THEN CAST(most AS DOUBLE) ELSE f.share * weight END AS target
  FROM s LEFT JOIN f ON true),
e AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS epochs FROM t),
x AS (
  SELECT d.*, e.source_size, e.target, e.epochs, CAST(floor(target - epochs * source_size + 0.5) AS BIGINT) AS budget,
    coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY mix_key, doc_id, size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
  FROM d JOIN e ON d.source IS NOT DISTINCT FROM e.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(epochs * size + greatest(0, least(size, budget - before)) AS BIGINT) AS taken, mix_key
FROM x
"""

OP4 = """
WITH d AS (SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
w AS (SELECT r, i, md5(substr(h, 2 * i + 1, 400)) AS s FROM (SELECT r, h, unnest(generate_series(0, length(h) // 2 - 200)) AS i FROM d WHERE length(h) >= 400)),
again AS (SELECT r, i FROM w JOIN (SELECT s FROM w GROUP BY s HAVING count(*) > 1) USING (s)),
opened AS (SELECT r, i, CASE WHEN i > lag(i) OVER (PARTITION BY r ORDER BY i) + 200 THEN 1 ELSE 0 END AS o FROM again),
spans AS (SELECT r, min(i) AS lo, max(i) + 200 AS hi FROM (SELECT *, sum(o) OVER (PARTITION BY r ORDER BY i ROWS UNBOUNDED PRECEDING) AS g FROM opened) GROUP BY r, g),
gaps AS (SELECT r, lo, hi, coalesce(lag(hi) OVER (PARTITION BY r ORDER BY lo), 0) AS prev FROM spans),
kept AS (
  SELECT r, count(*) AS n_spans, sum(hi - lo) AS n_removed, string_agg(substr(h, 2 * prev + 1, 2 * (lo - prev)), '' ORDER BY lo) || substr(any_value(h), 2 * max(hi) + 1) AS k FROM gaps JOIN d USING (r) GROUP BY r)
SELECT doc_id, length(h) // 2 AS n_bytes, CAST(coalesce(n_removed, 0) AS BIGINT) AS n_removed, coalesce(n_spans, 0) AS n_spans, sha256(unhex(coalesce(k, h))) AS kept_sha256
FROM d LEFT JOIN kept USING (r)
"""

#: (kind, pattern) with the least length inside the pattern where that finds the same matches.
_KINDS = (
    ("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""),
    ("access", r"AKIA[A-Z0-9]{12,}"),
    ("hex", r"[0-9a-f]{32,}"),
    ("bearer", r"\bBearer\x20+[A-Za-z0-9._~+/-]+=*"),
    ("ghtoken", r"\bgh[pousr]_[A-Za-z0-9]+"),
    ("jwt", r"\beyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+"),
    ("pem", r"-----BEGIN [A-Z ]*PRIVATE KEY-----"),
)
_LEAST = {"assign": 8, "bearer": 27, "ghtoken": 36, "jwt": 20, "pem": 27}


def _matches(no: int, kind: str, pattern: str) -> str:
    quoted = pattern.replace("'", "''")
    part = f"length(regexp_extract_all(t, '{quoted}', 1)[k])" if kind == "assign" else "length(hit[k])"
    return (
        f"SELECT r, {no} AS kind_no, '{kind}' AS kind, CAST(coalesce(list_sum(list_transform(gap[1:k], lambda x: length(x))), 0) + coalesce(list_sum(list_transform(hit[1:k - 1], lambda x: length(x))), 0) AS BIGINT) AS lo, length(hit[k]) AS n "
        f"FROM (SELECT r, t, gap, hit, unnest(generate_series(1, len(hit))) AS k FROM (SELECT r, t, string_split_regex(t, '{quoted}') AS gap, regexp_extract_all(t, '{quoted}') AS hit FROM d) WHERE len(hit) > 0) WHERE {part} >= {_LEAST.get(kind, 0)}"
    )


OP5 = (
    "WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),\nm AS ("
    + "\nUNION ALL ".join(_matches(k, *rule) for k, rule in enumerate(_KINDS))
    + """),
f AS (
  SELECT r, count(*) FILTER (kind_no = 0) AS n_assign, count(*) FILTER (kind_no = 1) AS n_access, count(*) FILTER (kind_no = 2) AS n_hex,
    coalesce(string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, kind_no) FILTER (kind_no < 3), '') AS base, string_agg(kind || ':' || lo || ':' || (lo + n), ',' ORDER BY lo, kind_no) AS spans
  FROM m GROUP BY r)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex, sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans FROM d LEFT JOIN f USING (r)
"""
)

OP8 = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(text, '') AS t FROM documents),
l AS (SELECT r, regexp_extract_all(t, '[^\x20\x09-\x0D]+') AS ws, string_split_regex(t, '[^\x20\x09-\x0D]+') AS gaps FROM d),
w AS (SELECT r, k, ws[k] AS word, gaps[k] AS gap, contains(gaps[k + 1], chr(10)) AS hard FROM (SELECT *, unnest(generate_series(1, len(ws))) AS k FROM l)),
m AS (
  SELECT *, translate(word, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS x,
    hard OR regexp_matches(CASE WHEN length(word) > 1 THEN regexp_replace(word, '["''\)\]}]$', '') ELSE word END, '[.!?]$') AS stop,
    sum(length(gap)) OVER (PARTITION BY r ORDER BY k) + coalesce(sum(length(word)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS start
  FROM w),
b AS (SELECT *, coalesce(sum(CAST(stop AS INT)) OVER (PARTITION BY r ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS whole FROM m),
c AS (
  SELECT r, whole, count(*) OVER q AS seen, min(md5(x) || lpad(CAST(1000000000 - k AS VARCHAR), 10, '0')) OVER q AS low
  FROM b WINDOW q AS (PARTITION BY r, whole ORDER BY k ROWS BETWEEN CURRENT ROW AND 7 FOLLOWING)),
cuts AS (SELECT DISTINCT r, 1000000000 - CAST(substr(low, 33) AS BIGINT) AS k FROM c WHERE seen = 8),
o AS (SELECT b.*, cuts.k IS NOT NULL OR row_number() OVER (PARTITION BY b.r, whole ORDER BY b.k) = 1 AS opening FROM b LEFT JOIN cuts ON b.r = cuts.r AND b.k = cuts.k),
n AS (SELECT *, sum(CAST(opening AS INT)) OVER (PARTITION BY r ORDER BY k) - 1 AS sno FROM o),
s AS (SELECT r, sno, min(start) AS start, count(*) AS n_words, string_agg(x, ' ' ORDER BY k) AS x FROM n GROUP BY r, sno),
a AS (SELECT r, list(x ORDER BY sno) AS xs, list(n_words ORDER BY sno) AS ns FROM s GROUP BY r),
e AS (
  SELECT r, k, xs, list_filter(generate_series(k + 2, least(k + 15, len(xs))), lambda j: list_sum(ns[k:j]) >= 16)[1] AS last
  FROM (SELECT *, unnest(generate_series(1, len(xs))) AS k FROM a)),
f AS (
  SELECT r, k, last FROM (
    SELECT e.r, k, last, row_number() OVER (PARTITION BY md5(array_to_string(xs[k:last], ' ')) ORDER BY doc_id NULLS LAST, md5(t), k) AS place
    FROM e JOIN d USING (r) WHERE last IS NOT NULL) WHERE place > 1),
g AS (SELECT DISTINCT r, unnest(generate_series(k, last)) - 1 AS sno FROM f),
i AS (SELECT r, min(sno) AS lo, max(sno) AS hi FROM (SELECT *, sno - row_number() OVER (PARTITION BY r ORDER BY sno) AS island FROM g) GROUP BY r, island),
z AS (SELECT r, string_agg(lo || '-' || hi, ',' ORDER BY lo) AS removed FROM i GROUP BY r),
p AS (SELECT r, sno, start, lead(start) OVER (PARTITION BY r ORDER BY sno) AS until FROM s),
kept AS (
  SELECT p.r, count(*) AS n_sentences, count(g.sno) AS n_removed, min(p.start) AS first,
    coalesce(string_agg(substr(d.t, CAST(p.start AS BIGINT) + 1, CAST(coalesce(p.until, length(d.t)) - p.start AS BIGINT)), '' ORDER BY p.sno) FILTER (g.sno IS NULL), '') AS rest
  FROM p JOIN d USING (r) LEFT JOIN g ON g.r = p.r AND g.sno = p.sno GROUP BY p.r)
SELECT doc_id, coalesce(n_sentences, 0) AS n_sentences, coalesce(n_removed, 0) AS n_removed, coalesce(removed, '') AS removed, CASE WHEN n_sentences IS NULL THEN t ELSE substr(t, 1, CAST(first AS BIGINT)) || rest END AS text
FROM d LEFT JOIN kept USING (r) LEFT JOIN z USING (r)
"""

OP9 = r"""
WITH RECURSIVE w AS (
  SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (
  SELECT doc_id, CASE WHEN len(ws) >= 5 THEN list_distinct(list_transform(generate_series(1, len(ws) - 4), lambda k: array_to_string(ws[k:k + 4], ' '))) WHEN len(ws) > 0 THEN [array_to_string(ws, ' ')] ELSE [] END AS sh FROM w),
e AS (SELECT doc_id, len(sh) AS n, md5_number(unnest(sh)) AS g FROM s),
p AS (SELECT a.doc_id AS x, b.doc_id AS y FROM e a JOIN e b ON a.g = b.g AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= 85 * (a.n + b.n - count(*))),
pairs AS (SELECT x, y FROM p UNION ALL SELECT y, x FROM p),
reach AS (SELECT x, y FROM pairs UNION SELECT r.x, b.y FROM reach r JOIN pairs b ON r.y = b.x),
c AS (SELECT x AS doc_id, min(y) AS low FROM reach GROUP BY x)
SELECT doc_id, CAST(len(sh) AS BIGINT) AS n_shingles, least(doc_id, coalesce(low, doc_id)) AS component_id, least(doc_id, coalesce(low, doc_id)) = doc_id AS kept FROM s LEFT JOIN c USING (doc_id)
"""

OP11 = r"""
WITH d AS (
  SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents),
w AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM d),
t AS (SELECT lang, CAST(sum(len(ws)) AS BIGINT) AS n FROM w GROUP BY lang),
p AS (SELECT lang, ws, unnest(generate_series(1, len(ws))) AS k FROM w),
q AS (SELECT lang, ws, k, unnest(generate_series(1, least(5, len(ws) - k + 1))) AS size FROM p),
f AS (SELECT lang, array_to_string(ws[k:k + size - 1], ' ') AS phrase, size, count(*) AS a FROM q GROUP BY ALL HAVING count(*) >= 100),
c AS (SELECT lang, phrase, size, a, string_split(phrase, ' ') AS ws FROM f WHERE size > 1),
k AS (SELECT *, unnest(generate_series(1, size - 1)) AS k FROM c),
s AS (
  SELECT k.lang, k.phrase, k.a, l.a AS l, r.a AS r, t.n, CAST((1000::HUGEINT * k.a * t.n) // (l.a::HUGEINT * r.a) AS BIGINT) AS score,
    row_number() OVER (PARTITION BY k.lang, k.phrase ORDER BY (1000::HUGEINT * k.a * t.n) // (l.a::HUGEINT * r.a), k.k) AS place
  FROM k JOIN f l ON l.lang = k.lang AND l.phrase = array_to_string(k.ws[1:k.k], ' ') JOIN f r ON r.lang = k.lang AND r.phrase = array_to_string(k.ws[k.k + 1:], ' ') JOIN t ON t.lang = k.lang),
g AS (SELECT * FROM s WHERE place = 1 AND NOT EXISTS (SELECT 1 FROM c o WHERE o.lang = s.lang AND len(o.phrase) > len(s.phrase) AND contains(' ' || o.phrase || ' ', ' ' || s.phrase || ' ') AND 100 * o.a >= 100 * s.a)),
z AS (SELECT lang, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank, phrase, a, l, r, n, score FROM g)
SELECT * FROM z WHERE rank <= 2000
"""

OP12 = """
WITH RECURSIVE e AS (
  SELECT vec_id, row_number() OVER () AS k, label, CAST(embedding AS DOUBLE[]) AS v,
    label IS NOT NULL AND embedding IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR isnan(x) OR isinf(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0 AS usable
  FROM embeddings),
g AS (SELECT * FROM e WHERE usable),
p AS (SELECT a.vec_id AS x, b.vec_id AS y FROM g a JOIN g b ON a.label = b.label AND a.k <> b.k AND len(a.v) = len(b.v) WHERE list_cosine_similarity(a.v, b.v) >= 0.93),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM p GROUP BY x),
reach AS (SELECT x, y FROM p UNION SELECT r.x, p.y FROM reach r JOIN p ON r.y = p.x),
c AS (SELECT x AS vec_id, min(y) AS low FROM reach GROUP BY x)
SELECT vec_id, coalesce(n_links, 0) AS n_links, least(vec_id, coalesce(low, vec_id)) AS component_id, least(vec_id, coalesce(low, vec_id)) = vec_id AS kept
FROM e LEFT JOIN n USING (vec_id) LEFT JOIN c USING (vec_id)
"""

OP13 = """
WITH t AS (
  SELECT conv_id, coalesce(role, '') AS role, coalesce(text, '') AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn NULLS FIRST, sha256(length(coalesce(role, '')) || ':' || coalesce(role, '') || coalesce(text, ''))) AS k
  FROM conversations WHERE conv_id IS NOT NULL),
b AS (SELECT range AS n, list_reduce(list_prepend(n, generate_series(1, 8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END) AS v FROM range(256)),
bs AS (SELECT list(v ORDER BY n) AS vs FROM b),
c AS (SELECT DISTINCT conv_id, conv_id - conv_id % 100 AS base FROM t),
h AS (SELECT conv_id, base, xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(conv_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))), lambda r, x: xor(r >> 8, vs[xor(r & 255, x) + 1])), 4294967295) % 6 AS h FROM c, bs),
r AS (
  SELECT h.conv_id, 0 AS part, t.k, t.role, t.text FROM h JOIN t ON t.conv_id = h.base AND t.k <= h.h
  UNION ALL SELECT h.conv_id, 1, t.k, t.role, t.text FROM h JOIN t ON t.conv_id = h.conv_id AND t.k > h.h),
d AS (SELECT conv_id, row_number() OVER w AS depth, length(text) AS n_chars, list(md5(length(role) || ':' || role || text)) OVER w AS path FROM r WINDOW w AS (PARTITION BY conv_id ORDER BY part, k)),
o AS (SELECT conv_id, depth, n_chars, path FROM d UNION ALL SELECT conv_id, 0, 0, [] FROM h),
m AS (SELECT *, max(depth) OVER (PARTITION BY conv_id) = depth AS ends FROM o),
n AS (SELECT array_to_string(path, '') AS name, depth, min(conv_id) AS conv_id, count(*) AS n_convs, any_value(n_chars) AS n_chars, sha256(coalesce(string_agg(CAST(conv_id AS VARCHAR), ',' ORDER BY conv_id) FILTER (ends), '')) AS ends_sha256 FROM m GROUP BY 1, 2),
p AS (SELECT n.*, left(name, 32 * (depth - 1)) AS above FROM n),
k AS (SELECT above, count(*) AS n_children FROM p WHERE depth > 0 GROUP BY above),
q AS (SELECT p.*, coalesce(k.n_children, 0) AS n_children FROM p LEFT JOIN k ON k.above = p.name),
u AS (SELECT left(name, 32 * d) AS name, sum((n_convs - 1) * n_chars) AS saved, count(*) FILTER (n_children = 0) AS n_leaves FROM (SELECT *, unnest(generate_series(0, depth)) AS d FROM q) GROUP BY 1)
SELECT q.conv_id, q.depth, a.conv_id AS parent_conv_id, q.n_convs, q.n_children, u.n_leaves, CAST(u.saved AS BIGINT) AS saved_tokens, q.ends_sha256
FROM q JOIN u USING (name) LEFT JOIN n a ON q.depth > 0 AND a.name = q.above
"""

ORACLE_SQL = {"op1_exact_dedup": OP1, "op4_repeated_bytes": OP4, "op5_secret_scan": OP5, "op6_mix_sources": OP6, "op8_sentence_spans": OP8, "op9_near_duplicates": OP9, "op11_collocations": OP11, "op12_near_vectors": OP12, "op13_prefix_trie": OP13}
