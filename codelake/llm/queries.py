"""The numbered queries of this package, with production parameters over whole tables, and the SQL of those that SQL can express."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from codelake.llm import bpe_stream, byte_cnn, cross_polytope, importance, jaccard_join, license_scan, line_dedup, merkle_manifest, packing, prefix_forest, suffix_dedup, url_filter, vector_codes
from codelake.llm.common import table


def op1_prefix_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return prefix_forest.search(vectors.where(F.col("vec_id") % 50 == 0), vectors)


def op2_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    return url_filter.judge(table(spark, sf_dir, "pages")).drop("n_tried")


def op3_cross_polytope(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cross_polytope.near_duplicates(table(spark, sf_dir, "embeddings"))


def op4_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join.jaccard_join(table(spark, sf_dir, "documents"))


def op5_bpe_stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe_stream.digests(table(spark, sf_dir, "documents"))


def op6_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.digests(table(spark, sf_dir, "documents"), words=suffix_dedup.PASSAGE_WORDS)


def op7_importance(spark: SparkSession, sf_dir: str) -> DataFrame:
    return importance.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


def op8_license_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    scans = license_scan.scans(table(spark, sf_dir, "documents"))
    return scans.withColumn("spans", F.to_json("spans"))


def op9_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


def op10_byte_cnn(spark: SparkSession, sf_dir: str) -> DataFrame:
    return byte_cnn.identify(table(spark, sf_dir, "documents"))


def op11_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return line_dedup.digests(table(spark, sf_dir, "documents"))


def op12_vector_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return vector_codes.codes(table(spark, sf_dir, "embeddings"))


def op13_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle_manifest.manifest(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f for f in (op1_prefix_forest, op2_url_filter, op3_cross_polytope, op4_jaccard_join, op5_bpe_stream, op6_suffix_dedup, op7_importance, op8_license_scan, op9_packing, op10_byte_cnn, op11_line_dedup, op12_vector_codes, op13_merkle_manifest)
}

URL_SQL = r"""
WITH after AS (
  SELECT page_id, CASE WHEN instr(url, '://') > 0 THEN substr(url, instr(url, '://') + 3) END AS rest FROM pages
), parts AS (
  SELECT page_id,
         coalesce(translate(regexp_extract(rest, '(?s)^([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
         coalesce(regexp_extract(rest, '(?s)^[^/?#]*([^?#]*)', 1), '') AS path
  FROM after
), rules(action, rule, rule_host, rule_path) AS (
  VALUES ('block', 'com/en/', 'com', '/en/'), ('allow', 'example.com/en/7', 'example.com', '/en/7'),
         ('block', 'net/de/', 'net', '/de/'), ('allow', 'example.net/de/8', 'example.net', '/de/8'), ('block', 'org/es/', 'org', '/es/')
), best AS (
  SELECT page_id, host, path, arg_max(rule, length(rule)) AS rule, arg_max(action, length(rule)) AS action
  FROM parts LEFT JOIN rules ON (host = rule_host OR ends_with(host, '.' || rule_host)) AND starts_with(path, rule_path)
  GROUP BY page_id, host, path
), own AS (
  SELECT *, CASE WHEN regexp_matches(host || path, '(?:^|\.)cheap-pills\.') THEN '(?:^|\.)cheap-pills\.'
                 WHEN regexp_matches(host || path, '(?:^|\.)spam-farm\.') THEN '(?:^|\.)spam-farm\.'
                 WHEN regexp_matches(host || path, '(?:^|\.)casino\.') THEN '(?:^|\.)casino\.'
                 WHEN regexp_matches(host || path, '/adserver/') THEN '/adserver/'
                 WHEN regexp_matches(host || path, '/tracker\.gif$') THEN '/tracker\.gif$' END AS pattern
  FROM best
)
SELECT page_id, host, path, rule, coalesce(action, CASE WHEN pattern IS NULL THEN 'allow' ELSE 'block' END) AS verdict, pattern
FROM own
"""

#: All pairs: an oracle for small tables. Vectors that take part, and their cosines.
VECTORS_SQL = """
WITH RECURSIVE good AS (
  SELECT row_number() OVER () AS rid, vec_id, embedding::DOUBLE[] AS v, len(embedding) AS dim FROM embeddings
  WHERE vec_id IS NOT NULL AND len(embedding) > 0 AND list_count(embedding) = len(embedding)
    AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0 AND len(list_filter(embedding, lambda x: x <> 0)) > 0
)"""

NEAREST_SQL = f"""{VECTORS_SQL}
, pairs AS (
  SELECT q.rid, q.vec_id AS query_id, c.vec_id, list_cosine_similarity(q.v, c.v) AS score
  FROM good q JOIN good c ON q.dim = c.dim AND q.rid <> c.rid WHERE q.vec_id % 50 = 0
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY rid ORDER BY score DESC, vec_id) AS INT) AS rank, vec_id, score FROM pairs
)
SELECT * FROM ranked WHERE rank <= 5
"""

#: What both joins have in common, once links(x, y) are known: counts, the smallest id within reach, and who stays.
LINKED_SQL = """
, reach(node, r) AS (
  SELECT x, y FROM links UNION SELECT reach.node, links.y FROM reach JOIN links ON reach.r = links.x
), low AS (SELECT node, min(r) AS r FROM reach GROUP BY node), counted AS (SELECT x, count(*) AS n FROM links GROUP BY x)
SELECT {id}, CAST(coalesce(n, 0) AS BIGINT) AS n_links, least({id}, coalesce(r, {id})) AS component_id, least({id}, coalesce(r, {id})) = {id} AS kept
FROM {table} LEFT JOIN low ON node = {id} LEFT JOIN counted ON x = {id}
"""

NEAR_VECTORS_SQL = f"""{VECTORS_SQL}
, links AS (
  SELECT a.vec_id AS x, b.vec_id AS y FROM good a JOIN good b ON a.dim = b.dim AND a.vec_id <> b.vec_id
  WHERE list_cosine_similarity(a.v, b.v) >= 0.95
)""" + LINKED_SQL.format(id="vec_id", table="embeddings")

JACCARD_SQL = r"""
WITH RECURSIVE words AS (
  SELECT doc_id, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS w FROM documents WHERE doc_id IS NOT NULL
), grams AS (
  SELECT doc_id, unnest(list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < 5 THEN [array_to_string(w, ' ')]
    ELSE list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i + 4], ' ')) END)) AS g FROM words
), sizes AS (SELECT doc_id, count(*) AS n FROM grams GROUP BY doc_id
), shared AS (
  SELECT a.doc_id AS x, b.doc_id AS y, count(*) AS n FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id GROUP BY a.doc_id, b.doc_id
), links AS (
  SELECT x, y FROM shared JOIN sizes a ON a.doc_id = x JOIN sizes b ON b.doc_id = y WHERE shared.n::DOUBLE / (a.n + b.n - shared.n) >= 0.8
)""" + LINKED_SQL.format(id="doc_id", table="documents")


COMMON_LINES_SQL = r"""
WITH numbered AS (SELECT row_number() OVER () AS rid, doc_id, string_split(coalesce(text, ''), chr(10)) AS a FROM documents),
lines AS (SELECT rid, doc_id, unnest(a) AS line, generate_subscripts(a, 1) AS i FROM numbered),
keyed AS (SELECT *, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM lines),
common AS (SELECT key FROM keyed WHERE key <> '' GROUP BY key HAVING count(DISTINCT rid) >= 10)
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, count(common.key) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY i) FILTER (common.key IS NULL), '')) AS kept_sha256
FROM keyed LEFT JOIN common ON keyed.key = common.key GROUP BY rid
"""


def codes_sql(parts: int = 8, entries: int = 16, rounds: int = 6) -> str:
    """Lloyd's rounds one by one, with the distances of all parts to all entries; a distance and its index in one number."""
    out = [
        f"""good AS MATERIALIZED (SELECT row_number() OVER (ORDER BY vec_id) AS r, vec_id, label, list_transform(embedding, lambda x: floor(4096 * x::DOUBLE)::BIGINT) AS v FROM embeddings
  WHERE embedding IS NOT NULL AND list_count(embedding) = len(embedding) AND len(list_filter(embedding, lambda x: NOT isfinite(x))) = 0)""",
        f"pieces AS MATERIALIZED (SELECT r, p, v[p * len(v) // {parts} + 1 : (p + 1) * len(v) // {parts}] AS x FROM good, range({parts}) t(p))",
        f"c0 AS MATERIALIZED (SELECT p, r - 1 AS e, x AS c FROM pieces WHERE r <= {entries})",
    ]
    for k in range(rounds + 1):
        out.append(f"a{k} AS MATERIALIZED (SELECT r, p, any_value(x) AS x, min(list_sum(list_transform(list_zip(x, c), lambda z: (z[1] - z[2]) * (z[1] - z[2])))::BIGINT * {entries} + e) AS m FROM pieces JOIN c{k} USING (p) GROUP BY r, p)")
        if k < rounds:
            out.append(f"""c{k + 1} AS MATERIALIZED (SELECT p, e, coalesce(m, c) AS c FROM c{k} LEFT JOIN (
  SELECT p, e, list(((s - ((s % n) + n) % n) // n)::BIGINT ORDER BY i) AS m FROM (SELECT p, m % {entries} AS e, i, sum(y) AS s, count(*) AS n FROM (SELECT p, m, unnest(x) AS y, generate_subscripts(x, 1) AS i FROM a{k}) GROUP BY ALL) GROUP BY p, e) USING (p, e))""")
    return f"""WITH {", ".join(out)},
coded AS (SELECT r, string_agg(printf('%02x', m % {entries}), '' ORDER BY p) AS code, sum(m // {entries})::BIGINT AS error FROM a{rounds} GROUP BY r),
book AS (SELECT sha256(string_agg(array_to_string(c, ','), ',' ORDER BY p, e)) AS codebooks_sha256 FROM c{rounds})
SELECT vec_id, code, error, (sum(error) OVER (PARTITION BY label))::BIGINT AS label_error, codebooks_sha256 FROM good JOIN coded USING (r), book"""


def merkle_sql(levels: int = 6) -> str:
    """The manifest for sources of up to 16 ** levels rows, level by level; CRC-32 by a table that its polynomial gives."""
    field = lambda c: f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, '-')"
    record = lambda text: "sha256(" + " || ".join(field(c) for c in ("doc_id", "source", "lang", "n_chars", text)) + ")"
    out = [
        """crc0(i, c, k) AS (SELECT range, range, 0 FROM range(256) UNION ALL SELECT i, CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END, k + 1 FROM crc0 WHERE k < 8),
crc AS (SELECT list(c ORDER BY i) AS t FROM crc0 WHERE k = 8)""",
        f"""rows AS MATERIALIZED (SELECT doc_id, coalesce(':' || source, '') AS tree, {record("text")} AS leaf,
  CASE WHEN xor(list_reduce(list_prepend(4294967295, list_transform(string_split(doc_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)), lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295) % 5 = 0
       THEN {record("translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')")} END AS other FROM documents, crc)""",
        "s0 AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY tree ORDER BY doc_id NULLS FIRST, leaf) - 1 AS i FROM rows)",
        "a0 AS MATERIALIZED (SELECT tree, i AS pos, leaf AS d, count(*) OVER (PARTITION BY tree) AS n FROM s0)",
        "p0 AS MATERIALIZED (SELECT tree, i, doc_id, leaf, '' AS seen, coalesce(other, leaf) AS f FROM s0)",
    ]

    def grow(a: str, p: str) -> None:
        for k in range(levels):
            out.append(f"{a}{k + 1} AS MATERIALIZED (SELECT tree, pos // 16 AS pos, CASE WHEN max(n) > 1 THEN sha256(string_agg(d, '' ORDER BY pos)) ELSE max(d) END AS d, (max(n) + 15) // 16 AS n FROM {a}{k} GROUP BY tree, pos // 16)")
            step = 16**k
            out.append(f"""{p}{k + 1} AS MATERIALIZED (SELECT p.* REPLACE (seen || coalesce(l, '') || coalesce(r, '') AS seen, CASE WHEN n > 1 THEN sha256(coalesce(l, '') || f || coalesce(r, '')) ELSE f END AS f)
  FROM {p}{k} p JOIN (SELECT x.tree AS t, x.pos AS at, any_value(x.n) AS n, string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos < x.pos) AS l, string_agg(y.d, '' ORDER BY y.pos) FILTER (y.pos > x.pos) AS r
    FROM {a}{k} x JOIN {a}{k} y ON x.tree = y.tree AND x.pos // 16 = y.pos // 16 GROUP BY x.tree, x.pos) s ON p.tree = s.t AND p.i // {step} = s.at)""")

    grow("a", "p")
    out += [
        f"b0 AS MATERIALIZED (SELECT '' AS tree, row_number() OVER (ORDER BY tree) - 1 AS pos, d, count(*) OVER () AS n, tree AS source FROM a{levels})",
        f"q0 AS MATERIALIZED (SELECT '' AS tree, pos AS i, doc_id, leaf, d AS subroot, seen, f FROM p{levels} p JOIN b0 ON p.tree = b0.source)",
    ]
    grow("b", "q")
    return f"""WITH RECURSIVE {", ".join(out)}
SELECT doc_id, leaf, subroot, d AS root, sha256(seen) AS proof_sha256, f AS folded_root, f = d AS verified FROM q{levels}, b{levels}"""


ORACLE_SQL: dict[str, str] = {"op1_prefix_forest": NEAREST_SQL, "op2_url_filter": URL_SQL, "op3_cross_polytope": NEAR_VECTORS_SQL, "op4_jaccard_join": JACCARD_SQL, "op11_line_dedup": COMMON_LINES_SQL, "op12_vector_codes": codes_sql(), "op13_merkle_manifest": merkle_sql()}
