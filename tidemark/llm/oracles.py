"""DuckDB SQL for the operators that SQL can express."""

from __future__ import annotations

from .common import Words
from .licenses import PHRASES, SPREAD, TEMPLATES
from .lines import NEAR_CHARS

VECTORS = """
WITH RECURSIVE v AS (
  SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
pairs AS (SELECT a.vec_id AS a, b.vec_id AS b FROM v a JOIN v b ON a.vec_id <> b.vec_id AND len(a.e) = len(b.e) WHERE list_cosine_similarity(a.e, b.e) >= 0.9),
reach AS (SELECT vec_id AS id, vec_id AS r FROM embeddings UNION SELECT reach.id, pairs.b FROM reach JOIN pairs ON reach.r = pairs.a),
comp AS (SELECT id, min(r) AS component_id FROM reach GROUP BY id),
links AS (SELECT a, count(*) AS n FROM pairs GROUP BY a)
SELECT vec_id, coalesce(n, 0) AS n_links, component_id, vec_id = component_id AS kept
FROM embeddings JOIN comp ON id = vec_id LEFT JOIN links ON a = vec_id"""

LINES = f"""
WITH split AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS l FROM documents),
rows AS (SELECT doc_id, i, l[i] AS raw, trim(regexp_replace(l[i], chr(13) || '$', ''), ' ') AS line FROM split, unnest(range(1, len(l) + 1)) AS t(i)),
firsts AS (SELECT line, min((doc_id, i)) AS p, length(line) AS n FROM rows WHERE line <> '' GROUP BY line),
halves AS (SELECT line, p, n, c, left(line, c // 2) AS h, 0 AS side FROM firsts, unnest([n, n - 1]) AS t(c) WHERE n >= {NEAR_CHARS}
           UNION ALL SELECT line, p, n, c, right(line, c // 2), 1 FROM firsts, unnest([n, n - 1]) AS t(c) WHERE n >= {NEAR_CHARS}),
cand AS (SELECT DISTINCT x.line AS x, y.line AS y, x.p AS p, x.n AS n, y.n AS m FROM halves x JOIN halves y ON x.c = y.c AND x.side = y.side AND x.h = y.h AND x.p > y.p),
near AS (SELECT DISTINCT p FROM cand WHERE
  CASE WHEN n = m THEN len(list_filter(range(1, n + 1), lambda i: x[i] <> y[i])) <= 1
       WHEN n = m + 1 THEN list_contains(list_transform(range(0, n), lambda i: left(x, i) || substr(x, i + 2)), y)
       WHEN m = n + 1 THEN list_contains(list_transform(range(0, m), lambda i: left(y, i) || substr(y, i + 2)), x) ELSE false END),
stay AS (SELECT p FROM firsts ANTI JOIN near USING (p)),
marked AS (SELECT doc_id, i, raw, line = '' OR (doc_id, i) IN (SELECT p FROM stay) AS keep FROM rows)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (NOT keep) AS n_removed, sha256(coalesce(string_agg(raw, chr(10) ORDER BY i) FILTER (keep), '')) AS kept_sha256
FROM marked GROUP BY doc_id"""


def _list(words: list[str]) -> str:
    return "[" + ", ".join(f"'{w}'" for w in words) + "]"


def _words(text: str) -> list[str]:
    w = Words([text])
    return [w.word(i).decode() for i in range(len(w.start))]


def licenses() -> str:
    word = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    hits = " UNION ALL ".join(f"SELECT doc_id, i - 1 AS pos, '{label}' AS label FROM w, unnest(range(1, len(words) - {len(p.split()) - 2})) AS t(i) WHERE words[i:i + {len(p.split()) - 1}] = {_list(p.split())}" for p, label in PHRASES.items())
    templates = ", ".join(f"('{label}', {_list(sorted(set(_words(t))))}, {n})" for n, (label, t) in enumerate((label, t) for label, ts in TEMPLATES.items() for t in ts))
    return f"""
WITH w AS (SELECT doc_id, regexp_extract_all({lower}, '{word}') AS words FROM documents),
hits AS ({hits}),
lines AS (SELECT doc_id, list_distinct(regexp_extract_all(unnest(string_split({lower}, chr(10))), '{word}')) AS s FROM documents),
tpl AS (SELECT * FROM (VALUES {templates}) t(label, s, tid)),
numbered AS (SELECT doc_id, no, regexp_extract_all(line, '{word}') AS ws FROM (SELECT doc_id, unnest(string_split({lower}, chr(10))) AS line, generate_subscripts(string_split({lower}, chr(10)), 1) AS no FROM documents)),
ranked AS (SELECT doc_id, no, ws, row_number() OVER w AS r, sum(len(ws)) OVER w AS upto FROM numbered WHERE len(ws) > 0 WINDOW w AS (PARTITION BY doc_id ORDER BY no)),
common AS (SELECT DISTINCT doc_id, r, tid, word FROM (SELECT doc_id, r, unnest(ws) AS word FROM ranked) JOIN (SELECT tid, unnest(s) AS word FROM tpl) USING (word)),
ends AS (SELECT DISTINCT c.doc_id, c.tid, c.r, no, upto, len(ws) AS n FROM common c JOIN ranked k ON c.doc_id = k.doc_id AND c.r = k.r),
runs AS (SELECT a.doc_id, a.tid, a.r AS lo, b.r AS hi FROM ends a JOIN ends b ON a.doc_id = b.doc_id AND a.tid = b.tid AND b.r > a.r AND b.r <= a.r + 200 AND b.no - a.no = b.r - a.r JOIN tpl ON tpl.tid = a.tid WHERE b.upto - a.upto + a.n <= {SPREAD} * len(tpl.s)),
wide AS (SELECT runs.doc_id, runs.tid, lo, hi, count(DISTINCT word) AS c FROM runs JOIN common ON common.doc_id = runs.doc_id AND common.tid = runs.tid AND common.r BETWEEN lo AND hi GROUP BY ALL),
own AS (SELECT wide.doc_id, tpl.label, c / len(tpl.s) AS c FROM wide JOIN tpl ON tpl.tid = wide.tid WHERE c >= 0.8 * len(tpl.s) - 1e-9 UNION ALL SELECT doc_id, label, len(list_intersect(lines.s, tpl.s)) / len(tpl.s) AS c FROM lines, tpl WHERE len(lines.s) > 0 AND len(list_intersect(lines.s, tpl.s)) >= 0.8 * len(tpl.s) - 1e-9),
h AS (SELECT doc_id, count(*) AS n, min(pos) AS lo, max(pos) AS hi, list_sort(list(DISTINCT label)) AS labels FROM hits GROUP BY doc_id),
o AS (SELECT doc_id, list(DISTINCT label) AS labels, max(c) AS c FROM own GROUP BY doc_id)
SELECT w.doc_id, len(words) AS n_words, coalesce(n, 0) AS n_base, lo AS first_word, hi AS last_word, coalesce(array_to_string(h.labels, ','), '') AS base_labels,
  array_to_string(list_sort(list_distinct(coalesce(h.labels, []) || coalesce(o.labels, []))), ',') AS labels, CASE WHEN n > 0 THEN 1.0::DOUBLE ELSE coalesce(c, 0.0)::DOUBLE END AS score
FROM w LEFT JOIN h USING (doc_id) LEFT JOIN o USING (doc_id)"""


#: CRC-32 of the bytes in hex text h of a column, with the table t of the reflected polynomial 0xEDB88320, made by its rule.
_CRC_TABLE = "tab AS (SELECT list(x ORDER BY i) AS t FROM (SELECT i, list_reduce([i::BIGINT, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) AS x FROM range(256) r(i)))"

SHARDS = f"""
WITH {_CRC_TABLE},
d AS (SELECT doc_id, strlen(coalesce(text, '')) AS n, hex(encode(coalesce(text, ''))) AS h FROM documents),
c AS (SELECT doc_id, n + 16 AS size, xor(list_reduce([4294967295] || list_transform(range(0, n), lambda i: ('0x' || h[2 * i + 1:2 * i + 2])::BIGINT), lambda c, x: xor(c >> 8, t[(xor(c, x) & 255) + 1])), 4294967295) AS crc FROM d, tab),
p AS (SELECT *, sum(size) OVER w - size AS before, sum(size) OVER () AS total FROM c WINDOW w AS (ORDER BY doc_id NULLS FIRST, crc, size ROWS UNBOUNDED PRECEDING)),
s AS (SELECT *, least(39, (2 * before + size) * 40 // (2 * total))::INT AS shard FROM p)
SELECT doc_id, size::BIGINT AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, crc, size) - 1 AS slot, NULL::INT AS grown_shard FROM s"""

#: Strings are compared by their 128-bit hashes; places are counted in bytes, so two hex digits each.
REPEATS = """
WITH d AS (SELECT row_number() OVER () AS u, doc_id, hex(encode(coalesce(text, ''))) AS h, strlen(coalesce(text, '')) AS n FROM documents),
s AS (SELECT u, i, md5(substr(h, 2 * i + 1, 800)) AS k FROM (SELECT u, h, unnest(range(0, n - 399)) AS i FROM d WHERE n >= 400)),
twice AS (SELECT k FROM s GROUP BY k HAVING count(*) > 1),
hit AS (SELECT u, i, lag(i) OVER (PARTITION BY u ORDER BY i) AS before FROM s WHERE k IN (SELECT k FROM twice)),
run AS (SELECT u, i, sum(CASE WHEN i - before <= 400 THEN 0 ELSE 1 END) OVER (PARTITION BY u ORDER BY i) AS r FROM hit),
cut AS (SELECT u, r, min(i) AS a, max(i) + 400 AS b FROM run GROUP BY u, r),
gap AS (SELECT u, a, b, coalesce(lag(b) OVER (PARTITION BY u ORDER BY a), 0) AS from_ FROM cut),
kept AS (SELECT u, sum(b - a) AS gone, count(*) AS spans, max(b) AS last, string_agg(substr(h, 2 * from_ + 1, 2 * (a - from_)), '' ORDER BY a) AS text FROM gap JOIN d USING (u) GROUP BY u)
SELECT doc_id, n AS n_bytes, coalesce(gone, 0)::BIGINT AS n_removed, coalesce(spans, 0)::BIGINT AS n_spans, sha256(unhex(CASE WHEN gone IS NULL THEN h ELSE text || substr(h, 2 * last + 1) END)) AS kept_sha256 FROM d LEFT JOIN kept USING (u)"""
