"""DuckDB SQL of the queries that SQL can express; the others are tested against brute force."""

from __future__ import annotations

from .quality import BOUNDS, STOP_WORDS

_WORD = r"[^\x20\x09-\x0D]+"

OP1 = rf"""WITH RECURSIVE w AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{_WORD}') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, md5(array_to_string(w[i:least(i + 3, len(w))], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 3, 1) + 1)) AS i FROM w WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY ALL),
e AS (SELECT p.a, p.b FROM p JOIN n x ON x.doc_id = p.a JOIN n y ON y.doc_id = p.b WHERE 100 * c >= 80 * (x.n + y.n - c)),
u AS (SELECT a, b FROM e UNION ALL SELECT b, a FROM e),
r AS (SELECT a, b FROM u UNION SELECT r.a, u.b FROM r JOIN u ON r.b = u.a),
k AS (SELECT doc_id, md5(string_agg(x, '' ORDER BY x)) AS x FROM s GROUP BY doc_id),
m AS (SELECT a AS doc_id, min(b) AS low FROM r GROUP BY a)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, least(coalesce(m.low, w.doc_id), w.doc_id) AS component_id, least(coalesce(m.low, w.doc_id), w.doc_id) = w.doc_id AS kept,
  coalesce(first_k.doc_id, w.doc_id) AS class_id
FROM w LEFT JOIN n USING (doc_id) LEFT JOIN m USING (doc_id) LEFT JOIN k USING (doc_id) LEFT JOIN (SELECT x, min(doc_id) AS doc_id FROM k GROUP BY x) first_k ON first_k.x = k.x"""


def _verdict() -> str:
    rules = []
    for name, (low, high) in BOUNDS.items():
        broken = " OR ".join([f"{name} < {low}"] * (low is not None) + [f"{name} > {high}"] * (high is not None))
        rules.append(f"CASE WHEN {broken} THEN '{name}' END")
    return f"coalesce(array_to_string([{', '.join(rules)}], ','), '')"


_STOP = ", ".join(f"'{w}'" for w in STOP_WORDS)
OP3 = rf"""WITH d AS (SELECT doc_id, coalesce(text, '') AS t, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
l AS (SELECT *, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '{_WORD}')) AS lines FROM d),
g AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 2], chr(10))) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 1)) AS i FROM d WHERE len(w) > 2)),
h AS (SELECT DISTINCT doc_id, i + unnest([0, 1, 2]) AS i FROM (SELECT doc_id, i FROM g QUALIFY count(*) OVER (PARTITION BY doc_id, x) > 1)),
r AS (SELECT doc_id, count(*) AS n FROM h GROUP BY doc_id),
c AS (SELECT doc_id, len(w) AS n_words, length(array_to_string(w, '')) AS word_chars, length(regexp_replace(t, '[^#*$%&|<>]+', '', 'g')) AS n_symbols, len(lines) AS n_lines, len(lines) - len(list_distinct(lines)) AS n_dup_lines, coalesce(r.n, 0) AS n_repeat_words,
  len(list_filter(w, lambda x: lower(x) IN ({_STOP}))) AS stop_word_count, len(list_filter(lines, lambda x: regexp_matches(x, '^[\x20\x09-\x0D]*[-*•][\x20\x09-\x0D]'))) AS bullets, len(list_filter(lines, lambda x: regexp_matches(x, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) AS dots FROM l LEFT JOIN r USING (doc_id)),
m AS (SELECT *, coalesce(word_chars / nullif(n_words, 0), 0) AS mean_word_length, coalesce(n_symbols / nullif(n_words, 0), 0) AS symbol_word_ratio, coalesce(bullets / nullif(n_lines, 0), 0) AS bullet_line_ratio, coalesce(dots / nullif(n_lines, 0), 0) AS ellipsis_line_ratio,
  coalesce(n_dup_lines / nullif(n_lines, 0), 0) AS dup_line_ratio, coalesce(n_repeat_words / nullif(n_words, 0), 0) AS repeat_word_ratio FROM c),
v AS (SELECT *, n_words < 50 OR 100 * n_repeat_words > 50 * n_words AS base_failed, {_verdict()} AS failed FROM m)
SELECT doc_id, CAST(n_words AS BIGINT) AS n_words, CAST(word_chars AS BIGINT) AS word_chars, CAST(n_symbols AS BIGINT) AS n_symbols, CAST(n_dup_lines AS BIGINT) AS n_dup_lines, CAST(n_repeat_words AS BIGINT) AS n_repeat_words, base_failed, NOT base_failed AND failed = '' AS kept, failed FROM v"""

OP5 = """WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS h FROM documents),
p AS (SELECT doc_id, unnest(range(0, length(h) // 2 - 99)) AS i, h FROM d WHERE length(h) >= 200),
k AS (SELECT doc_id, i, row_number() OVER (PARTITION BY substr(h, 2 * i + 1, 200) ORDER BY doc_id, i) AS n FROM p),
b AS (SELECT doc_id, i, lag(i) OVER (PARTITION BY doc_id ORDER BY i) AS before FROM k WHERE n > 1),
g AS (SELECT doc_id, i, sum(CASE WHEN before IS NULL OR i > before + 100 THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY i) AS run FROM b),
r AS (SELECT doc_id, run, min(i) AS s, max(i) + 100 AS e FROM g GROUP BY doc_id, run),
q AS (SELECT doc_id, run, s, e, coalesce(lag(e) OVER (PARTITION BY doc_id ORDER BY s), 0) AS last_e FROM r),
t AS (SELECT doc_id, count(*) AS n, sum(e - s) AS gone, max(e) AS e, string_agg(substr(h, 2 * last_e + 1, 2 * (s - last_e)), '' ORDER BY s) AS kept FROM q JOIN d USING (doc_id) GROUP BY doc_id)
SELECT doc_id, CAST(length(h) // 2 AS BIGINT) AS n_bytes, CAST(coalesce(gone, 0) AS BIGINT) AS n_removed, coalesce(n, 0) AS n_spans, sha256(unhex(CASE WHEN n IS NULL THEN h ELSE kept || substr(h, 2 * e + 1) END)) AS kept_sha256 FROM d LEFT JOIN t USING (doc_id)"""

_WHITE = "' ' || chr(9) || chr(11) || chr(12) || chr(13)"
OP6 = rf"""WITH d AS (SELECT doc_id, text, string_split(text, chr(10)) AS ls FROM documents WHERE text IS NOT NULL),
l AS (SELECT doc_id, unnest(range(0, len(ls))) AS i, unnest(ls) AS raw FROM d),
n AS (SELECT *, trim(raw, {_WHITE}) AS line, len(regexp_extract_all(raw, '{_WORD}')) AS w FROM l),
c AS (SELECT *, sum(w) OVER (PARTITION BY doc_id ORDER BY i) AS upto FROM n),
fit AS (SELECT a.doc_id, a.i, b.i AS j FROM c a JOIN c b ON a.doc_id = b.doc_id AND b.i >= a.i AND b.upto - a.upto + a.w >= 50 WHERE a.w > 0 AND b.w > 0),
worded AS (SELECT doc_id, i, w, lead(i) OVER v AS j, lead(w) OVER v AS next_w FROM c WHERE w > 0 WINDOW v AS (PARTITION BY doc_id ORDER BY i)),
win AS (SELECT doc_id, i, min(j) AS j FROM fit GROUP BY doc_id, i UNION SELECT doc_id, max(i), j FROM fit GROUP BY doc_id, j UNION SELECT doc_id, i, j FROM worded WHERE j > i + 1 AND w >= 50 AND next_w >= 50),
key AS (SELECT win.doc_id, win.i, win.j, md5(string_agg(n.line, chr(10) ORDER BY n.i)) AS x FROM win JOIN n ON n.doc_id = win.doc_id AND n.i BETWEEN win.i AND win.j GROUP BY win.doc_id, win.i, win.j),
hit AS (SELECT *, row_number() OVER (PARTITION BY x ORDER BY doc_id, i) AS r FROM key),
gone AS (SELECT DISTINCT doc_id, unnest(range(i, j + 1)) AS i FROM hit WHERE r > 1),
t AS (SELECT l.doc_id, count(*) AS n_lines, count(gone.i) AS n_removed, coalesce(string_agg(raw, chr(10) ORDER BY l.i) FILTER (WHERE gone.i IS NULL), '') AS kept FROM l LEFT JOIN gone ON gone.doc_id = l.doc_id AND gone.i = l.i GROUP BY l.doc_id)
SELECT doc_id, coalesce(n_lines, 0) AS n_lines, coalesce(n_removed, 0) AS n_removed, CAST(length(coalesce(kept, '')) AS BIGINT) AS n_chars_kept, sha256(coalesce(kept, '')) AS kept_sha256 FROM documents LEFT JOIN t USING (doc_id)"""

_TERM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
OP7 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
b AS (SELECT CAST(item_id AS VARCHAR) AS item, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM benchmark),
q AS (SELECT DISTINCT item, least(13, len(w)) AS n, array_to_string(w[i:i + 12], ' ') AS x FROM (SELECT item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) AS i FROM b WHERE len(w) > 0)),
z AS (SELECT DISTINCT n FROM q),
p AS (SELECT doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') AS x FROM (SELECT doc_id, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM d, z WHERE len(w) >= n)),
h AS (SELECT p.doc_id, p.i, p.n, q.item FROM p JOIN q ON p.n = q.n AND p.x = q.x),
a AS (SELECT doc_id, count(*) AS n_hit FROM (SELECT DISTINCT doc_id, unnest(range(i, i + n)) AS i FROM h) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT doc_id, item FROM h) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, coalesce(n_hit, 0) AS n_hit, coalesce(n_items, 0) AS n_items, sha256(coalesce(items, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(w) AS contaminated FROM d LEFT JOIN a USING (doc_id) LEFT JOIN t USING (doc_id)"""

OP11 = rf"""WITH tab AS (SELECT list(c ORDER BY i) AS t FROM (SELECT i, list_reduce(range(8), lambda a, k: CASE WHEN a % 2 = 1 THEN xor(a >> 1, 3988292384) ELSE a >> 1 END, i) AS c FROM range(256) r(i))),
d AS (SELECT row_number() OVER () AS id, doc_id, regexp_extract_all({_LOWER}, '{_TERM}') AS w FROM documents),
g AS (SELECT id, unnest(w) AS w FROM d), k AS (SELECT unnest(regexp_extract_all({_LOWER}, '{_TERM}')) AS w FROM benchmark),
v AS (SELECT w, hex(encode(w)) AS h FROM (SELECT w FROM g UNION SELECT w FROM k)),
b AS (SELECT w, xor(list_reduce(list_transform(range(length(h) // 2), lambda i: CAST('0x' || substr(h, 2 * i + 1, 2) AS BIGINT)), lambda a, x: xor(a >> 8, t[1 + xor(a & 255, x)]), 4294967295), 4294967295) % 10000 AS b FROM v, tab),
s AS (SELECT b, count(*) AS s FROM g JOIN b USING (w) GROUP BY b), t AS (SELECT b, count(*) AS t FROM k JOIN b USING (w) GROUP BY b),
n AS (SELECT (SELECT count(*) FROM g) AS s, (SELECT count(*) FROM k) AS t),
gain AS (SELECT s.b, CAST(floor(1000 * ln((coalesce(t.t, 0) + 1)::DOUBLE * (n.s + 10000)::DOUBLE / ((s.s + 1)::DOUBLE * (n.t + 10000)::DOUBLE))) AS BIGINT) AS gain FROM s LEFT JOIN t USING (b), n),
m AS (SELECT id, CAST(sum(gain) AS BIGINT) AS total FROM g JOIN b USING (w) JOIN gain USING (b) GROUP BY id),
x AS (SELECT id, doc_id, CAST(len(w) AS BIGINT) AS n_features, CAST(coalesce(total // len(w) - CASE WHEN total % len(w) < 0 THEN 1 ELSE 0 END, 0) AS BIGINT) AS weight, CAST('0x' || substr(sha256('2024:' || doc_id), 1, 8) AS BIGINT) AS h FROM d LEFT JOIN m USING (id)),
y AS (SELECT *, weight + CAST(floor(-1000 * ln(-ln((h + 0.5::DOUBLE) / 4294967296::DOUBLE))) AS BIGINT) AS score FROM x),
r AS (SELECT id, row_number() OVER (ORDER BY score DESC, doc_id) AS r, count(*) OVER () * 10 // 100 AS most FROM y WHERE n_features >= 20 AND score IS NOT NULL)
SELECT doc_id, n_features, weight, score, CASE WHEN r <= most THEN r END AS rank FROM y LEFT JOIN r USING (id)"""

OP12 = rf"""WITH d AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '{_WORD}') AS w FROM documents),
p AS (SELECT doc_id, i, md5(array_to_string(w[i:i + 12], ' ')) AS x FROM (SELECT doc_id, w, unnest(range(1, len(w) - 11)) AS i FROM d WHERE len(w) > 12)),
h AS (SELECT doc_id, i FROM (SELECT *, min(doc_id) OVER (PARTITION BY x) AS low FROM p) WHERE low < doc_id),
g AS (SELECT doc_id, list_distinct(flatten(list(range(i, i + 13)))) AS gone FROM h GROUP BY doc_id),
k AS (SELECT doc_id, w, coalesce(len(gone), 0) AS n, CASE WHEN gone IS NULL THEN w ELSE list_transform(list_sort(list_filter(range(1, len(w) + 1), lambda i: NOT list_contains(gone, i))), lambda i: w[i]) END AS kept FROM d LEFT JOIN g USING (doc_id))
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(n AS BIGINT) AS n_removed, sha256(coalesce(array_to_string(kept, ' '), '')) AS kept_sha256 FROM k"""

ORACLES = {
    "op1_minhash_near_dedup": OP1,
    "op3_quality_rules": OP3,
    "op5_suffix_dedup": OP5,
    "op6_line_dedup": OP6,
    "op7_decontamination": OP7,
    "op11_importance_resampling": OP11,
    "op12_passage_dedup": OP12,
}
