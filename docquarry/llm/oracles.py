"""SQL (DuckDB) for the queries of this subpackage that SQL can express on the small tables: the exact neighbours that
``op3_nn_descent`` approximates, the two models of byte strings (as long as their sample is every document), the Jaccard join
and the shards."""

from __future__ import annotations

#: The bits of CRC-32's polynomial, lowest power first.
POLYNOMIAL = 0xEDB88320


def crc32_sql(blob: str) -> str:
    """CRC-32 of a BLOB expression, four bits a step; ``nibbles`` is a table with the list ``t`` of 16 remainders."""
    digits = f"regexp_extract_all(regexp_replace(hex({blob}), '(.)(.)', '\\2\\1', 'g'), '.')"
    values = f"list_transform({digits}, lambda c: CAST(strpos('0123456789ABCDEF', c) - 1 AS BIGINT))"
    step = "xor(a >> 4, t[(xor(a, b) & 15) + 1])"
    return f"xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], {values}), lambda a, b: {step}), 4294967295)"


_BIT = f"CASE WHEN a & 1 = 1 THEN xor(a >> 1, {POLYNOMIAL}) ELSE a >> 1 END"
NIBBLES = f"nibbles AS (SELECT list_transform(range(16), lambda n: list_reduce([n, 0, 0, 0, 0], lambda a, k: {_BIT})) AS t)"

_NEAREST = """WITH v AS (SELECT vec_id, CAST(embedding AS DOUBLE[]) AS e FROM embeddings WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(embedding) > 0 AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
s AS (SELECT q.vec_id AS query_id, c.vec_id, list_inner_product(q.e, c.e) AS score FROM v q JOIN v c ON q.vec_id <> c.vec_id WHERE q.vec_id % 20 = 0)
SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s QUALIFY rank <= 20"""

_WORDS = "list_filter(regexp_split_to_array(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\\x20\\x09-\\x0D]+'), lambda x: x <> '')"
_JACCARD = f"""WITH RECURSIVE w AS MATERIALIZED (SELECT doc_id, CASE WHEN text IS NULL THEN [] ELSE {_WORDS} END AS ws FROM documents WHERE doc_id IS NOT NULL),
s AS MATERIALIZED (SELECT DISTINCT doc_id, unnest(CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')]
    ELSE list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' ')) END) AS sh FROM w),
n AS MATERIALIZED (SELECT doc_id, count(*) AS n FROM s GROUP BY 1),
p AS MATERIALIZED (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS c FROM s a JOIN s b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p JOIN n x ON x.doc_id = a JOIN n y ON y.doc_id = b WHERE 100 * c >= 85 * (x.n + y.n - c)),
e AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id AS node, doc_id AS m FROM w UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.node)
SELECT w.doc_id, coalesce(n.n, 0) AS n_shingles, (SELECT min(m) FROM r WHERE node = w.doc_id) AS component_id FROM w LEFT JOIN n USING (doc_id)"""

_SHARDS = f"""WITH {NIBBLES},
d AS (SELECT doc_id, strlen(coalesce(text, '')) + 1 AS size, CAST({crc32_sql("encode(coalesce(text, ''))")} AS BIGINT) AS crc FROM documents, nibbles),
p AS (SELECT *, sum(size) OVER (ORDER BY crc, size, doc_id ROWS UNBOUNDED PRECEDING) AS upto, sum(size) OVER () AS total FROM d),
c AS (SELECT *, CAST(least((2 * upto - size) * 16 // (2 * total), 15) AS INTEGER) AS shard FROM p)
SELECT doc_id, CAST(size AS BIGINT) AS size, crc AS text_crc32, 'bytes' AS law, shard, row_number() OVER (PARTITION BY shard ORDER BY crc, size, doc_id) - 1 AS slot, CAST(NULL AS INTEGER) AS grown_shard FROM c"""


def _strings(text: str, marks: str) -> str:
    """``g``: the five bytes, in hexadecimal, that end at each byte of a text that begins after line ends; with ``marks``."""
    return f"""h AS (SELECT doc_id, {marks}, regexp_extract_all(repeat('0A', 4) || hex(encode({text})), '..') AS h FROM documents WHERE text IS NOT NULL AND text <> ''),
b AS (SELECT doc_id, {marks}, unnest(h) AS x, generate_subscripts(h, 1) AS i FROM h),
g AS MATERIALIZED (SELECT doc_id, {marks}, lag(x, 4) OVER o || lag(x, 3) OVER o || lag(x, 2) OVER o || lag(x, 1) OVER o || x AS k FROM b WINDOW o AS (PARTITION BY doc_id ORDER BY i) QUALIFY i > 4)"""


def _costs(counts: str) -> str:
    """``cost``: bits of the last byte of each string of ``g`` after the others, by side. ``c`` (``counts``): side, k, n, and
    whether the string counts at full length."""
    levels = []
    for d in range(5, 0, -1):
        full = " WHERE full_length" if d == 5 else ""
        levels.append(f"l{d} AS MATERIALIZED (SELECT side, right(k, {2 * d}) AS k, sum(n) AS n FROM c{full} GROUP BY 1, 2 HAVING sum(n) > 0)")
        levels.append(f"a{d} AS MATERIALIZED (SELECT side, left(k, {2 * d - 2}) AS k, sum(n) AS total, count(*) AS kinds FROM l{d} GROUP BY 1, 2)")
    cost = "CAST(8 AS DOUBLE)"
    for d in range(1, 6):
        leave = f"coalesce(-log2(a{d}.kinds / (a{d}.total + a{d}.kinds)), 0)"
        cost = f"CASE WHEN l{d}.n > 0 THEN -log2(l{d}.n / (a{d}.total + a{d}.kinds)) ELSE {leave} + {cost} END"
    joins = " ".join(f"LEFT JOIN l{d} ON l{d}.side = s.side AND l{d}.k = right(u.k, {2 * d}) LEFT JOIN a{d} ON a{d}.side = s.side AND a{d}.k = left(right(u.k, {2 * d}), {2 * d - 2})" for d in range(5, 0, -1))
    return f"""c AS MATERIALIZED ({counts}), {", ".join(levels)}, u AS (SELECT DISTINCT k FROM g), s AS (SELECT DISTINCT side FROM c),
cost AS MATERIALIZED (SELECT s.side, u.k, {cost} AS bits FROM u CROSS JOIN s {joins})"""


_ENTROPY = f"""WITH {_strings("text", "good")}, {{costs}},
m AS (SELECT doc_id, count(*) FILTER (side = 'background') AS n, avg(bits) FILTER (side = 'target') AS t, avg(bits) FILTER (side = 'background') AS b FROM g JOIN cost USING (k) GROUP BY 1)
SELECT d.doc_id, coalesce(m.n, 0) AS n_tokens, round(m.t, 6) AS target_loss, round(m.b, 6) AS background_loss, round(m.t - m.b, 6) AS score FROM documents d LEFT JOIN m USING (doc_id)""".replace(
    "FROM documents WHERE text IS NOT NULL", "FROM (SELECT *, doc_id IN (SELECT doc_id FROM labels WHERE quality = 1) AS good FROM documents) WHERE text IS NOT NULL"
).format(costs=_costs("SELECT 'target' AS side, k, count(*) AS n, true AS full_length FROM g WHERE good GROUP BY k UNION ALL SELECT 'background', k, count(*), true FROM g GROUP BY k"))

_LANGUAGES = f"""WITH {NIBBLES}, held AS (SELECT doc_id, {crc32_sql("encode(coalesce(CAST(doc_id AS VARCHAR), ''))")} % 3 = 1 AS held_out FROM documents, nibbles),
{{strings}}, f AS (SELECT k, count(*) >= 2 AS full_length FROM g WHERE teaches GROUP BY k), {{costs}},
m AS (SELECT doc_id, side, sum(bits) / count(*) AS mean, count(*) AS n FROM g JOIN cost USING (k) GROUP BY 1, 2),
t AS (SELECT doc_id, arg_min(side, (mean, side)) AS best, min(mean) AS low, any_value(n) AS n FROM m GROUP BY 1),
r AS (SELECT t.doc_id, best, low, 1 / sum(pow(2, -(m.mean - low) * least(t.n, 50))) AS score FROM t JOIN m USING (doc_id) GROUP BY 1, 2, 3)
SELECT d.doc_id, held.held_out, CASE WHEN letter THEN best ELSE 'und' END AS lang_pred, CASE WHEN letter THEN round(score, 6) ELSE 0.0 END AS score, CASE WHEN letter THEN round(low, 6) END AS bits_per_byte
FROM (SELECT doc_id, coalesce(regexp_matches(text, '\\p{{{{L}}}}'), false) AS letter FROM documents) d JOIN held USING (doc_id) LEFT JOIN r USING (doc_id)""".format(
    strings=_strings("lower(text)", "teaches, lang").replace("FROM documents WHERE text IS NOT NULL", "FROM (SELECT documents.*, NOT held_out AND lang IS NOT NULL AS teaches FROM documents JOIN held USING (doc_id)) WHERE text IS NOT NULL"),
    costs=_costs("SELECT lang AS side, k, count(*) AS n, any_value(full_length) AS full_length FROM g JOIN f USING (k) WHERE teaches GROUP BY lang, k"),
)

ORACLE_SQL: dict[str, str] = {
    "op2_ppm_language": _LANGUAGES.replace("{{L}}", "{L}"),
    "op3_nn_descent": _NEAREST,
    "op5_cross_entropy": _ENTROPY,
    "op9_jaccard_join": _JACCARD,
    "op10_byte_shards": _SHARDS,
}
