"""DuckDB SQL for the corpus queries that SQL can express."""

from tidewatch.llm.secrets import RULES

OP1 = """
WITH RECURSIVE v AS (
  SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS e FROM embeddings
  WHERE label IS NOT NULL AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
    AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
l AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM v a JOIN v b ON a.label = b.label AND a.vec_id <> b.vec_id AND len(a.e) = len(b.e)
  WHERE list_cosine_similarity(a.e, b.e) >= 0.93),
r AS (SELECT vec_id AS s, vec_id AS t FROM embeddings UNION SELECT r.s, l.y FROM r JOIN l ON l.x = r.t),
c AS (SELECT s AS vec_id, min(t) AS component_id FROM r GROUP BY s),
n AS (SELECT x AS vec_id, count(*) AS n_links FROM l GROUP BY x)
SELECT c.vec_id, coalesce(n.n_links, 0) AS n_links, c.component_id, c.vec_id = c.component_id AS kept
FROM c LEFT JOIN n ON c.vec_id = n.vec_id
"""

OP7 = """
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) q(i)),
d AS (SELECT doc_id, coalesce(text, '') AS text, strlen(coalesce(text, '')) + 1 AS size, hex(encode(coalesce(text, ''))) AS h FROM documents),
k AS (
  SELECT doc_id, size,
         xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))),
                         lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT)) AS text_crc32
  FROM d, tab),
p AS (
  SELECT *, sum(size) OVER (ORDER BY doc_id NULLS FIRST, text_crc32, size ROWS UNBOUNDED PRECEDING) - size AS before, sum(size) OVER () AS total FROM k),
s AS (SELECT *, CAST(before * 16 // total AS INT) AS shard FROM p)
SELECT doc_id, size, text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY doc_id NULLS FIRST, text_crc32, size) - 1 AS slot,
       CAST(NULL AS INT) AS grown_shard
FROM s
"""

OP9 = r"""
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS BIGINT) AS size
  FROM documents),
s AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size,
         (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1 AS w
  FROM d GROUP BY source),
l AS (
  SELECT *, 3 * source_size AS cap, sum(source_size) OVER () AS total FROM s),
f AS (
  SELECT a.source, a.source_size, a.cap, a.w, a.k,
         (any_value(a.total) - coalesce(sum(b.cap) FILTER (b.cap / b.w < a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.k < a.k)), 0))
         / sum(b.w) FILTER (b.cap / b.w > a.cap / a.w OR (b.cap / b.w = a.cap / a.w AND b.k >= a.k)) AS lev
  FROM (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM l) a,
       (SELECT *, row_number() OVER (ORDER BY source NULLS LAST) AS k FROM l) b
  GROUP BY a.source, a.source_size, a.cap, a.w, a.k),
t AS (
  SELECT source, source_size,
         least(CAST(cap AS DOUBLE), coalesce((SELECT g.lev FROM f g WHERE g.cap > g.lev * g.w ORDER BY g.cap / g.w, g.k LIMIT 1) * w, cap)) AS target
  FROM f),
o AS (
  SELECT d.doc_id, d.size, t.source_size, t.target,
         CASE WHEN t.source_size > 0 THEN t.target / t.source_size ELSE 0 END AS r,
         CAST(CAST('0x' || substr(md5('mix-1/' || coalesce(d.source, '')), 1, 8) AS BIGINT) AS DOUBLE) / 4294967296.0 AS u,
         row_number() OVER (PARTITION BY d.source ORDER BY d.size, md5('mix-1:' || coalesce(CAST(d.doc_id AS VARCHAR), '')), d.doc_id) - 1 AS i
  FROM d JOIN t ON d.source IS NOT DISTINCT FROM t.source)
SELECT doc_id, size, source_size, target,
       CAST(size * (floor(r) + floor((i + 1) * (r - floor(r)) + u) - floor(i * (r - floor(r)) + u)) AS BIGINT) AS taken
FROM o
"""



def _op6() -> str:
    def quoted(x: str) -> str:
        return "'" + x.replace("'", "''") + "'"

    parts = [
        f"SELECT doc_id, {k} AS k, '{r.kind}' AS kind, {r.least} AS least, string_split_regex(t, {quoted(r.pattern)}) AS g, "
        f"regexp_extract_all(t, {quoted(r.pattern)}, 0) AS h, regexp_extract_all(t, {quoted(r.pattern)}, {r.group}) AS v "
        f"FROM d WHERE regexp_matches(t, {quoted(r.screen or r.pattern)})"
        for k, r in enumerate(RULES)
    ]
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS t FROM documents),
m AS ({" UNION ALL ".join(parts)}),
i AS (SELECT *, unnest(range(1, len(h) + 1)) AS i FROM m),
s AS (SELECT doc_id, k, kind, length(h[i]) AS n,
             list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(h[1:i - 1], lambda x: length(x))), 0) AS a
      FROM i WHERE length(v[i]) >= least),
f AS (SELECT doc_id, count(*) FILTER (k = 0) AS n_assign, count(*) FILTER (k = 1) AS n_access, count(*) FILTER (k = 2) AS n_hex,
             string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR), ',' ORDER BY a, k) FILTER (k < 3) AS base,
             string_agg(kind || ':' || CAST(CAST(a AS BIGINT) AS VARCHAR) || ':' || CAST(CAST(a + n AS BIGINT) AS VARCHAR), ',' ORDER BY a, k) AS spans
      FROM s GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
       sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans
FROM d LEFT JOIN f ON d.doc_id IS NOT DISTINCT FROM f.doc_id
"""


LOWER = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"


def _op11(levels: int = 5) -> str:
    """Level by level up to 16 ** levels leaves, first in each source, then over the sources."""
    field = lambda c: f"coalesce(CAST(strlen(CAST({c} AS VARCHAR)) AS VARCHAR) || ':' || CAST({c} AS VARCHAR), '-')"
    leaf = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    crc = """xor(list_reduce(list_prepend(CAST(4294967295 AS BIGINT), list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda ch: CAST(ascii(ch) AS BIGINT))),
             lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), CAST(4294967295 AS BIGINT))"""
    parts, folds = [], ["f0 AS (SELECT *, coalesce(alt, leaf) AS x, '' AS proof FROM d)"]
    for tree, first in (("s", "SELECT source, r, leaf AS h, n AS c, source AS g FROM d"), ("z", f"SELECT source, row_number() OVER (ORDER BY source NULLS FIRST) - 1 AS r, h, count(*) OVER () AS c, 0 AS g FROM s{levels}")):
        parts.append(f"{tree}0 AS ({first})")
        for k in range(levels):
            beside = lambda frame: f"coalesce(string_agg(h, '') OVER (PARTITION BY g, r // 16 ORDER BY r ROWS BETWEEN {frame}), '')"
            parts.append(f"{tree}b{k} AS (SELECT source, g, r, c, {beside('UNBOUNDED PRECEDING AND 1 PRECEDING')} AS b, {beside('1 FOLLOWING AND UNBOUNDED FOLLOWING')} AS a FROM {tree}{k})")
            parts.append(f"{tree}{k + 1} AS (SELECT any_value(source) AS source, r // 16 AS r, CASE WHEN any_value(c) > 1 THEN sha256(string_agg(h, '' ORDER BY r)) ELSE any_value(h) END AS h, (any_value(c) + 15) // 16 AS c, g FROM {tree}{k} GROUP BY g, r // 16)")
            at = len(folds) - 1
            place = f"f.source IS NOT DISTINCT FROM s.g AND f.r // {16**k} = s.r" if tree == "s" else f"(SELECT r FROM z0 WHERE z0.source IS NOT DISTINCT FROM f.source) // {16**k} = s.r"
            folds.append(f"f{at + 1} AS (SELECT f.* EXCLUDE (x, proof), CASE WHEN s.c > 1 THEN sha256(s.b || f.x || s.a) ELSE f.x END AS x, f.proof || CASE WHEN s.c > 1 THEN s.b || s.a ELSE '' END AS proof FROM f{at} f JOIN {tree}b{k} s ON {place})")
    return f"""
WITH tab AS (
  SELECT list(list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY i) AS t
  FROM range(256) q(i)),
e AS (SELECT doc_id, source, {leaf('text')} AS leaf, CASE WHEN {crc} % 5 = 0 THEN {leaf(f'translate(text, {LOWER})')} END AS alt FROM documents, tab),
d AS (SELECT *, row_number() OVER (PARTITION BY source ORDER BY doc_id NULLS FIRST, leaf) - 1 AS r, count(*) OVER (PARTITION BY source) AS n FROM e),
{", ".join(parts)},
{", ".join(folds)}
SELECT doc_id, leaf, s.h AS subroot, z.h AS root, sha256(proof) AS proof_sha256, x AS folded_root, x = z.h AS verified
FROM f{len(folds) - 1} f JOIN s{levels} s ON f.source IS NOT DISTINCT FROM s.source, z{levels} z
"""


OP12 = rf"""
WITH d AS (
  SELECT row_number() OVER () AS id, coalesce(lang, '') AS lang, coalesce(source, '') AS source, translate(coalesce(text, ''), {LOWER}) AS t FROM documents),
w AS (SELECT id, lang, source, unnest(regexp_extract_all(t, '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
k AS (SELECT lang, term FROM w GROUP BY lang, term HAVING count(DISTINCT id) >= 3),
v AS (SELECT lang, count(*) AS v FROM k GROUP BY lang),
g AS (SELECT DISTINCT lang, source FROM d),
n AS (SELECT lang, source, term, count(*) AS c FROM w GROUP BY lang, source, term),
x AS (
  SELECT g.lang, g.source, k.term, coalesce(n.c, 0) AS c, sum(coalesce(n.c, 0)) OVER (PARTITION BY g.lang, g.source) AS size, v.v
  FROM g JOIN k ON g.lang = k.lang JOIN v ON v.lang = g.lang LEFT JOIN n ON n.lang = g.lang AND n.source = g.source AND n.term = k.term),
p AS (SELECT lang, source, term, c, 1 + CAST(1000000000 AS HUGEINT) * CAST(c + 1 AS HUGEINT) // CAST(size + v AS HUGEINT) AS p FROM x),
l AS (SELECT lang, term, sum(c) AS c, any_value(v) AS v FROM x GROUP BY lang, term),
q AS (SELECT lang, term, 1 + CAST(1000000000 AS HUGEINT) * CAST(c + 1 AS HUGEINT) // CAST(sum(c) OVER (PARTITION BY lang) + v AS HUGEINT) AS q FROM l),
s AS (
  SELECT a.lang, a.source, b.source AS item, sum((a.p - b.p) * (a.p - b.p) // b.p) AS value
  FROM p a JOIN p b ON a.lang = b.lang AND a.term = b.term AND a.source <> b.source GROUP BY a.lang, a.source, b.source),
o AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, CAST(coalesce(s.value, 0) AS BIGINT) AS value
  FROM g a JOIN g b ON a.lang = b.lang AND a.source <> b.source LEFT JOIN s ON s.lang = a.lang AND s.source = a.source AND s.item = b.source
  UNION ALL
  SELECT p.lang, p.source, 'term', p.term, CAST((p.p - q.q) * (p.p - q.q) // q.q AS BIGINT) FROM p JOIN q ON p.lang = q.lang AND p.term = q.term WHERE p.c > 0 AND p.p > q.q),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, item) AS INT) AS rank FROM o)
SELECT lang, source, part, item, value, rank FROM r WHERE part = 'pair' OR rank <= 200
"""

ORACLES = {"op1_spherical_caps": OP1, "op7_sharding": OP7, "op6_secret_scans": _op6(), "op9_mixing": OP9, "op11_merkle": _op11(), "op12_divergence": OP12}
