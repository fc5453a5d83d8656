"""Registered queries of the training-data operators and, where SQL can say it, their DuckDB statements."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

import corpus_pipeline
from chatlens.llm import bpe, decontaminate, jaccard, langid, licenses, lm, merkle, neighbours, packing, quality, resample, url_filter, warc
from chatlens.llm.base import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}

URL_RULES = [("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow")]


def query(fn: Callable[[SparkSession, str], DataFrame]):
    QUERIES[fn.__name__] = fn
    return fn


@query
def op1_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return licenses.document_licenses(table(spark, sf_dir, "documents"))


@query
def op2_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lm.score_documents(table(spark, sf_dir, "documents"))


@query
def op3_benchmark_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return decontaminate.contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query
def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.score_documents(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query
def op5_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return neighbours.nearest(vectors, vectors.where("vec_id % 50 = 0").select(F.col("vec_id").alias("query_id")))


@query
def op6_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    index = warc.archive_and_index(table(spark, sf_dir, "pages"))
    return index.select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


@query
def op7_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"))


@query
def op8_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    return url_filter.judge_urls(table(spark, sf_dir, "pages"), rules)


@query
def op9_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard.similar_documents(table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "class_id")


@query
def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return langid.identify_pages(table(spark, sf_dir, "pages"))


@query
def op11_importance_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    drawn = resample.resample(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"), percent=5, min_words=20, seed=42)
    return drawn.select("doc_id", "n_features", "weight", "score", "rank")


@query
def op12_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.verify(table(spark, sf_dir, "documents"))


@query
def op13_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers
    return bpe.digest(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


QUERIES["pipeline"] = corpus_pipeline.run
if corpus_pipeline.ORACLE_SQL:
    ORACLE["pipeline"] = corpus_pipeline.ORACLE_SQL

ORACLE["op3_benchmark_decontamination"] = r"""
WITH split AS (
  SELECT doc_id, row_number() OVER () AS r, regexp_extract_all(
    translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
item AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id, regexp_extract_all(
    translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark WHERE text IS NOT NULL),
windows AS (
  SELECT DISTINCT item_id, least(len(w), 10) AS m, array_to_string(w[i:i + least(len(w), 10) - 1], ' ') AS g
  FROM (SELECT item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) AS i FROM item WHERE len(w) > 0)),
lengths AS (SELECT DISTINCT m FROM windows),
found AS (
  SELECT d.r, d.i, d.m, x.item_id
  FROM (SELECT r, m, i, array_to_string(w[i:i + m - 1], ' ') AS g
        FROM (SELECT r, w, m, unnest(range(1, len(w) - m + 2)) AS i FROM split, lengths WHERE len(w) >= m)) d
  JOIN windows x ON x.m = d.m AND x.g = d.g),
hits AS (SELECT r, count(DISTINCT p) AS n FROM (SELECT r, unnest(range(i, i + m)) AS p FROM found) GROUP BY r),
items AS (SELECT r, count(*) AS n, string_agg(item_id, ',' ORDER BY item_id) AS l FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT s.doc_id, CAST(len(s.w) AS BIGINT) AS n_words, coalesce(h.n, 0) AS n_hit, coalesce(i.n, 0) AS n_items,
  sha256(coalesce(i.l, '')) AS items_sha256, coalesce(h.n, 0) > 0 AS contaminated
FROM split s LEFT JOIN hits h ON h.r = s.r LEFT JOIN items i ON i.r = s.r
"""

ORACLE["op8_url_filters"] = r"""
WITH parts AS (
  SELECT page_id, coalesce(translate(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '') AS host,
    coalesce(regexp_extract(url, '^(?s:.*?)://([^/?#]*)([^?#]*)', 2), '') AS path
  FROM pages),
rules(rhost, rpath, verdict) AS (VALUES ('net', '/', 'block'), ('example.net', '/en/', 'allow'), ('example.com', '/de/', 'block'), ('org', '/fr/', 'allow')),
fits AS (
  SELECT page_id, host, path, rhost || rpath AS rule, verdict, row_number() OVER (PARTITION BY page_id ORDER BY length(rhost) DESC, length(rpath) DESC) AS k
  FROM parts JOIN rules ON (host = rhost OR ends_with(host, '.' || rhost)) AND starts_with(path, rpath))
SELECT p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, 'allow') AS verdict
FROM parts p LEFT JOIN fits f ON f.page_id = p.page_id AND f.k = 1
"""

ORACLE["op9_ngram_jaccard_join"] = r"""
WITH RECURSIVE split AS (
  SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') AS w
  FROM documents),
shingles AS (
  SELECT DISTINCT doc_id, array_to_string(w[i:i + 4], ' ') AS s
  FROM (SELECT doc_id, w, unnest(range(1, greatest(len(w) - 4, 1) + 1)) AS i FROM split WHERE len(w) > 0)),
sizes AS (SELECT doc_id, count(*) AS n FROM shingles GROUP BY doc_id),
common AS (SELECT a.doc_id AS a, b.doc_id AS b, count(*) AS k FROM shingles a JOIN shingles b ON a.s = b.s AND a.doc_id < b.doc_id GROUP BY a.doc_id, b.doc_id),
links AS (SELECT a, b FROM common JOIN sizes x ON x.doc_id = a JOIN sizes y ON y.doc_id = b WHERE 100 * k >= 75 * (x.n + y.n - k)),
both_ways AS (SELECT a AS u, b AS v FROM links UNION SELECT b, a FROM links),
reach(d, r) AS (SELECT DISTINCT doc_id, doc_id FROM documents UNION SELECT reach.d, v FROM reach JOIN both_ways ON u = r),
whole AS (SELECT d, min(r) AS component_id FROM reach GROUP BY d),
equal_sets AS (SELECT doc_id, min(doc_id) OVER (PARTITION BY f) AS class_id FROM (SELECT doc_id, string_agg(s, chr(10) ORDER BY s) AS f FROM shingles GROUP BY doc_id))
SELECT DISTINCT s.doc_id, coalesce(z.n, 0) AS n_shingles, w.component_id, coalesce(e.class_id, s.doc_id) AS class_id
FROM split s LEFT JOIN sizes z ON z.doc_id = s.doc_id JOIN whole w ON w.d = s.doc_id LEFT JOIN equal_sets e ON e.doc_id = s.doc_id
"""

QUOTED = ", ".join("(" + ", ".join("'" + x.replace("'", "''") + "'" for x in t) + ")" for t in licenses.TEMPLATES)
ORACLE["op1_license_scans"] = rf"""
WITH lower_text AS (
  SELECT row_number() OVER () AS r, doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
pieces AS (
  SELECT r, unnest(string_split(t, chr(10))) AS p FROM lower_text
  UNION ALL SELECT r, unnest(string_split_regex(t, '\n[\x00-\x2F\x3A-\x60\x7B-\x7F]*\n')) FROM lower_text
  UNION ALL SELECT r, t FROM lower_text),
words AS (SELECT r, row_number() OVER () AS k, regexp_extract_all(p, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM (SELECT DISTINCT r, p FROM pieces)),
grams AS (SELECT DISTINCT r, k, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT r, k, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM words WHERE len(w) > 0)),
templates AS (
  SELECT name, row_number() OVER () AS q, regexp_extract_all(translate(body, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM (VALUES {QUOTED}) AS v(name, body)),
template_grams AS (SELECT DISTINCT name, q, array_to_string(w[i:i + 1], ' ') AS g FROM (SELECT name, q, w, unnest(range(1, greatest(len(w) - 1, 1) + 1)) AS i FROM templates)),
piece_sizes AS (SELECT k, count(*) AS n FROM grams GROUP BY k),
template_sizes AS (SELECT q, count(*) AS n FROM template_grams GROUP BY q),
fits AS (
  SELECT c.r, c.name, 2.0::DOUBLE * c.n / (x.n + y.n) AS dice
  FROM (SELECT a.r, a.k, b.q, b.name, count(*) AS n FROM grams a JOIN template_grams b ON a.g = b.g GROUP BY a.r, a.k, b.q, b.name) c
  JOIN piece_sizes x ON x.k = c.k JOIN template_sizes y ON y.q = c.q WHERE 2.0::DOUBLE * c.n / (x.n + y.n) >= {licenses.THRESHOLD}::DOUBLE),
best AS (SELECT r, name, max(dice) AS dice, row_number() OVER (PARTITION BY r ORDER BY max(dice) DESC, name) AS k FROM fits GROUP BY r, name)
SELECT doc_id, count(name) AS n_licenses, min(name) FILTER (k = 1) AS license, min(dice) FILTER (k = 1) AS dice,
  coalesce(string_agg(name, ',' ORDER BY name), '') AS licenses
FROM lower_text LEFT JOIN best USING (r) GROUP BY r, doc_id
"""

ORACLE["op6_warc"] = """
WITH p AS (
  SELECT page_id, strlen(coalesce(html, '')) AS payload_bytes, sha1(coalesce(html, '')) AS h FROM pages),
f AS (SELECT *, min(page_id) OVER (PARTITION BY h) AS one FROM p)
SELECT page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
    CAST(((CAST('0x' || substr(h, CAST(5 * (i // 4) + 1 AS BIGINT), 5) AS BIGINT) >> CAST(15 - 5 * (i % 4) AS BIGINT)) & 31) + 1 AS BIGINT), 1)), '') AS payload_digest,
  CASE WHEN page_id = one THEN 'response' ELSE 'revisit' END AS record_type, CASE WHEN page_id <> one THEN one END AS refers_to
FROM f
"""

LOWER = "translate({}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
# CRC-32 by its table, which the polynomial's rule gives; the argument is a list of bytes and ``crc_table`` holds the table.
CRC_TABLE = """crc_table AS (
  SELECT list(v ORDER BY i) AS crcs FROM (SELECT i, list_reduce(list_prepend(i, range(8)), lambda c, k: CASE WHEN (c & 1) = 1 THEN xor(3988292384, c >> 1) ELSE c >> 1 END) AS v
  FROM range(256) AS n(i)))"""
CRC = "xor(list_reduce(list_prepend(4294967295, {}), lambda c, b: xor(c >> 8, crcs[(xor(c, b) & 255) + 1])), 4294967295)"


def sql_leaf(text: str) -> str:
    fields = ["CAST(doc_id AS VARCHAR)", "source", "lang", "CAST(n_chars AS VARCHAR)", text]
    return "sha256(" + " || ".join(f"coalesce(strlen({f}) || ':' || {f}, '-')" for f in fields) + ")"


ORACLE["op12_merkle_manifest"] = f"""
WITH RECURSIVE {CRC_TABLE},
documents_hashed AS (
  SELECT row_number() OVER () AS r, doc_id, coalesce('=' || lang, '') AS grp, {sql_leaf('text')} AS leaf, {sql_leaf(LOWER.format('text'))} AS lower_leaf,
    coalesce({CRC.format("list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))")} % 3 = 0, false) AS tampered
  FROM documents, crc_table),
placed AS (
  SELECT r, doc_id, grp, leaf, CASE WHEN tampered THEN lower_leaf ELSE leaf END AS found,
    row_number() OVER (PARTITION BY grp ORDER BY doc_id NULLS FIRST, leaf) - 1 AS pos, count(*) OVER (PARTITION BY grp) AS total
  FROM documents_hashed),
up AS (
  SELECT 0 AS k, grp, pos, leaf AS node, total FROM placed
  UNION ALL
  SELECT k + 1, grp, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (total + 7) // 8 FROM up WHERE total > 1 GROUP BY k, grp, pos // 8, total),
heights AS (SELECT grp, max(k) AS h FROM up GROUP BY grp),
subroots AS (SELECT grp, h, node AS subroot, row_number() OVER (ORDER BY grp) - 1 AS pos, count(*) OVER () AS total FROM up JOIN heights USING (grp) WHERE total = 1),
top AS (
  SELECT 0 AS k, pos, subroot AS node, total FROM subroots
  UNION ALL
  SELECT k + 1, pos // 8, sha256(string_agg(node, '' ORDER BY pos)), (total + 7) // 8 FROM top WHERE total > 1 GROUP BY k, pos // 8, total),
in_group AS (SELECT r, p.grp, k, pos >> (3 * k) AS place FROM placed p JOIN (SELECT DISTINCT grp, k FROM up WHERE total > 1) l ON l.grp = p.grp),
above_group AS (SELECT r, h, k, s.pos >> (3 * k) AS place FROM placed p JOIN subroots s ON s.grp = p.grp, (SELECT DISTINCT k FROM top WHERE total > 1)),
steps AS (
  SELECT r, i.k AS step, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < place), '') AS l, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > place), '') AS g
  FROM in_group i JOIN up u ON u.grp = i.grp AND u.k = i.k AND u.pos // 8 = i.place // 8 GROUP BY r, i.k
  UNION ALL
  SELECT r, h + a.k, coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos < place), ''), coalesce(string_agg(node, '' ORDER BY pos) FILTER (pos > place), '')
  FROM above_group a JOIN top t ON t.k = a.k AND t.pos // 8 = a.place // 8 GROUP BY r, h + a.k),
folded AS (
  SELECT r, 0 AS step, found AS node FROM placed
  UNION ALL
  SELECT f.r, f.step + 1, sha256(l || node || g) FROM folded f JOIN steps s ON s.r = f.r AND s.step = f.step),
proofs AS (SELECT r, string_agg(l || g, '' ORDER BY step) AS proof FROM steps GROUP BY r),
ends AS (SELECT r, arg_max(node, step) AS folded_root FROM folded GROUP BY r)
SELECT p.doc_id, p.leaf, s.subroot, t.node AS root, sha256(coalesce(x.proof, '')) AS proof_sha256, e.folded_root, e.folded_root = t.node AS verified
FROM placed p JOIN subroots s ON s.grp = p.grp JOIN ends e ON e.r = p.r LEFT JOIN proofs x ON x.r = p.r, (SELECT node FROM top WHERE total = 1) t
"""

ORACLE["op11_importance_resampling"] = rf"""
WITH {CRC_TABLE},
texts AS (
  SELECT row_number() OVER () AS r, doc_id, w, false AS target
  FROM (SELECT doc_id, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents)
  UNION ALL
  SELECT -row_number() OVER (), NULL, regexp_extract_all({LOWER.format("coalesce(text, '')")}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+'), true FROM benchmark),
runs AS (
  SELECT r, target, array_to_string(w[i:i + n - 1], ' ') AS f
  FROM (SELECT r, target, w, n, unnest(range(1, len(w) - n + 2)) AS i FROM texts, (VALUES (1), (2), (3)) AS lengths(n) WHERE len(w) >= n)),
hashed AS (
  SELECT f, {CRC.format("list_transform(range(0, len(h) // 2), lambda i: CAST('0x' || h[2 * i + 1:2 * i + 2] AS BIGINT))")} % 10000 AS bucket
  FROM (SELECT f, hex(encode(f)) AS h FROM (SELECT DISTINCT f FROM runs)), crc_table),
counted AS (SELECT bucket, count(*) FILTER (NOT target) AS s, count(*) FILTER (target) AS t FROM runs JOIN hashed USING (f) GROUP BY bucket),
gains AS (
  SELECT bucket, CAST(floor(1000 * ln(CAST(t + 1 AS DOUBLE) * CAST(all_s + 10000 AS DOUBLE) / (CAST(s + 1 AS DOUBLE) * CAST(all_t + 10000 AS DOUBLE)))) AS BIGINT) AS gain
  FROM counted, (SELECT sum(s) AS all_s, sum(t) AS all_t FROM counted)),
weighed AS (SELECT r, count(*) AS n, CAST(sum(gain) AS BIGINT) AS weight FROM runs JOIN hashed USING (f) JOIN gains USING (bucket) WHERE NOT target GROUP BY r),
scored AS (
  SELECT r, doc_id, len(w) AS n_words, coalesce(n, 0) AS n_features, coalesce(weight, 0) AS weight,
    coalesce(weight, 0) + CAST(floor(-1000 * ln(-ln((CAST('0x' || substr(sha256('42:' || coalesce(CAST(doc_id AS VARCHAR), '')), 1, 8) AS BIGINT) + 0.5::DOUBLE) / 4294967296.0::DOUBLE))) AS BIGINT) AS score
  FROM texts LEFT JOIN weighed USING (r) WHERE NOT target),
drawn AS (
  SELECT r, row_number() OVER (ORDER BY score DESC, doc_id NULLS FIRST, weight, n_features) AS rank, count(*) OVER () AS n FROM scored WHERE n_words >= 20)
SELECT doc_id, n_features, weight, score, rank FROM scored LEFT JOIN (SELECT r, rank FROM drawn WHERE rank <= 5 * n // 100) USING (r)
"""
