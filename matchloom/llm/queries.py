"""The named queries of the training-data operators, and SQL twins where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.llm.fingerprint import compare_edited
from matchloom.llm.license_scan import NOTICES, PHRASES, scan_licenses
from matchloom.llm.mixing import mix_sources
from matchloom.llm.neardup import near_duplicates
from matchloom.llm.packing import harmonic_pack
from matchloom.llm.pii import find_pii, train_pii
from matchloom.llm.topk import exact_topk
from matchloom.llm.toxicity import score_toxicity, train_toxicity
from matchloom.llm.urlfilter import judge_urls
from matchloom.llm.warc import audit, manifest, places, warc_record

#: The public vocabulary that the packing query counts tokens with.
TOKENIZER = public_tokenizers.path("word_bpe_49k.json")

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(f: Callable[[SparkSession, str], DataFrame]) -> Callable[[SparkSession, str], DataFrame]:
    QUERIES[f.__name__] = f
    return f


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


@query
def op10_superminhash_neardup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Four-word shingles; links at 100 * intersection >= 80 * union."""
    return near_duplicates(table(spark, sf_dir, "documents"), width=4, num=80, den=100)


@query
def op5_harmonic_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sequences of at most 2048 tokens; an id 1 ends each document."""
    return harmonic_pack(table(spark, sf_dir, "documents"), TOKENIZER)


@query
def op7_bottom_k_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return compare_edited(table(spark, sf_dir, "documents"))


@query
def op1_ball_tree_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Components become floor(256 * x); every fiftieth vector asks for its 5 best."""
    raw = table(spark, sf_dir, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    sound = F.forall("e", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    vectors = raw.where(sound).select("vec_id", F.transform("e", lambda x: F.floor(x * 256).cast("double")).alias("v"))
    return exact_topk(vectors, vectors.where("vec_id % 50 = 0"), k=5)


ORACLE["op1_ball_tree_topk"] = """
WITH v AS (
  SELECT vec_id, list_transform(embedding, lambda x: floor(256 * x::DOUBLE)) AS e FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 50 = 0 GROUP BY vec_id),
s AS (
  SELECT q.vec_id AS query_id, c.vec_id, CAST(list_dot_product(q.e, c.e) AS BIGINT) AS score
  FROM q JOIN v c ON c.vec_id <> q.vec_id AND len(c.e) = len(q.e)),
r AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""


@query
def op6_hash_threshold_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Weights 5, 2, 1 in turn share 150 % of all words; no source over twice its size."""
    return mix_sources(table(spark, sf_dir, "documents"), 1.5, 2.0, [5, 2, 1]).select("doc_id", "size", "source_size", "target", "taken")


ORACLE["op6_hash_threshold_mix"] = r"""
WITH d AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) AS size,
         substr(md5(coalesce(CAST(doc_id AS VARCHAR), '')), 1, 15) AS h FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (
  SELECT *, CAST([5, 2, 1][1 + (row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3] AS DOUBLE) AS weight FROM s),
r AS (SELECT *, source_size * 2.0::DOUBLE / weight AS ratio FROM w),
l AS (
  SELECT *, (sum(source_size) OVER () * 1.5::DOUBLE
      - coalesce(sum(source_size) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) * 2.0::DOUBLE)
    / (sum(weight) OVER () - coalesce(sum(weight) OVER (ORDER BY ratio, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS level FROM r),
t AS (
  SELECT source, source_size,
    least(coalesce((SELECT level FROM l WHERE level <= ratio ORDER BY ratio, source NULLS LAST LIMIT 1) * weight, source_size * 2.0::DOUBLE), source_size * 2.0::DOUBLE) AS target FROM l),
f AS (
  SELECT *, CAST(floor(target) AS BIGINT) AS budget, CASE WHEN source_size = 0 THEN 0 ELSE CAST(floor(target) AS BIGINT) // source_size END AS full_times FROM t),
b AS (
  SELECT d.doc_id, d.size, f.source_size, f.target, f.full_times, f.budget - f.full_times * f.source_size AS rest,
    CAST(sum(d.size) OVER (PARTITION BY d.source ORDER BY d.h) AS BIGINT) AS upto,
    CAST(sum(d.size) OVER (PARTITION BY d.source, d.h) AS BIGINT) AS same
  FROM d JOIN f ON d.source IS NOT DISTINCT FROM f.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, source_size, target,
  CAST(full_times * size + CASE WHEN upto <= rest THEN size WHEN upto - same >= rest THEN 0 ELSE size * (rest - upto + same) // same END AS BIGINT) AS taken
FROM b
"""


@query
def op9_license_diagonals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return scan_licenses(table(spark, sf_dir, "documents"))


def _templates_sql() -> str:
    rows = [("base", *p) for p in PHRASES] + [("notice", *n) for n in NOTICES]
    return ", ".join(f"({i}, '{kind}', '{label}', '{text}')" for i, (kind, text, label) in enumerate(rows))


ORACLE["op9_license_diagonals"] = rf"""
WITH t AS (SELECT *, string_split(text, ' ') AS tw FROM (VALUES {_templates_sql()}) x(template, kind, label, text)),
tg AS (SELECT template, kind, label, len(tw) - 1 AS n_grams, q - 1 AS q, tw[q] || ' ' || tw[q + 1] AS gram FROM t, unnest(range(1, len(tw))) r(q)),
d AS (SELECT row_number() OVER () AS k, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
g AS (SELECT k, p - 1 AS p, w[p] || ' ' || w[p + 1] AS gram FROM d, unnest(range(1, len(w))) r(p)),
h AS (SELECT DISTINCT k, template, kind, label, n_grams, p - q AS diagonal, q FROM g JOIN tg USING (gram)),
v AS (SELECT k, template, kind, label, n_grams, diagonal, list(q) AS qs FROM h GROUP BY ALL),
i AS (
  SELECT *, sum(CASE WHEN diagonal - before <= 2 THEN 0 ELSE 1 END) OVER (PARTITION BY k, template ORDER BY diagonal) AS island
  FROM (SELECT *, lag(diagonal) OVER (PARTITION BY k, template ORDER BY diagonal) AS before FROM v)),
s AS (
  SELECT k, template, kind, label, n_grams, island, len(list_distinct(flatten(list(qs)))) / n_grams AS share,
    list(diagonal) FILTER (len(qs) = n_grams) AS exact FROM i GROUP BY k, template, kind, label, n_grams, island),
f AS (
  SELECT k, flatten(list(exact) FILTER (kind = 'base' AND exact IS NOT NULL)) AS places, max(share) AS score,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (kind = 'base' AND exact IS NOT NULL) AS own,
    string_agg(DISTINCT label, ',' ORDER BY label) FILTER (exact IS NOT NULL OR kind = 'notice' AND share >= 0.75) AS every FROM s GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(len(places), 0) AS BIGINT) AS n_base,
  CAST(list_min(places) AS BIGINT) AS first_word, CAST(list_max(places) AS BIGINT) AS last_word,
  coalesce(own, '') AS base_labels, coalesce(every, '') AS labels, CAST(coalesce(score, 0) AS DOUBLE) AS score
FROM d LEFT JOIN f USING (k)
"""


#: (host, path, verdict) of the url query.
URL_RULES = [("org", "/", "allow"), ("example.org", "/es/", "block"), ("example.org", "/en/1", "block"), ("com", "/fr/", "allow"), ("com", "/de/", "block")]


@query
def op4_blocked_bloom_urls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five rules, then a list of reported URLs.

    No list comes with the tables. Reported is every URL whose md5 begins with a zero, about one in sixteen, in a spelling that no page
    has: another scheme, without its fragment, with a tracking parameter more. So only canonical forms meet, and a host says nothing.
    """
    pages = table(spark, sf_dir, "pages")
    rules = spark.createDataFrame(URL_RULES, "host string, path string, verdict string")
    bare = F.regexp_replace(F.regexp_replace("url", r"(?s)#.*$", ""), r"(?s)^.*?://", "reported://")
    reported = pages.where(F.md5(F.col("url").cast("binary")).startswith("0")).select(F.concat(bare, F.when(bare.contains("?"), "&").otherwise("?"), F.lit("utm_campaign=report")).alias("url"))
    return judge_urls(pages, rules, reported).select("page_id", "host", "path", "rule", "verdict", "listed")


ORACLE["op4_blocked_bloom_urls"] = rf"""
WITH u AS (
  SELECT row_number() OVER () AS k, page_id, url,
    translate(regexp_extract(coalesce(url, ''), '^(?s:.*?)://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*([^?#]*)', 1) AS path,
    regexp_extract(coalesce(url, ''), '^(?s:.*?)://[^/?#]*[^?#]*\?([^#]*)', 1) AS query FROM pages),
c AS (
  SELECT *, regexp_replace(regexp_replace(host, ':(80|443)$', ''), '^www\.', '') || regexp_replace(regexp_replace(path, '/+', '/', 'g'), '/$', '')
    || CASE WHEN len(kept) = 0 THEN '' ELSE '?' || array_to_string(list_sort(kept), '&') END AS canonical_url
  FROM (SELECT *, list_filter(string_split(query, '&'), lambda p: p <> '' AND NOT regexp_matches(p, '^(?:utm_[^=&]*|gclid|fbclid|ref)(=|$)')) AS kept FROM u)),
listed AS (SELECT DISTINCT canonical_url FROM c WHERE starts_with(md5(url), '0') AND contains(url, '://') AND canonical_url <> ''),
r AS (SELECT * FROM (VALUES {", ".join(str(r) for r in URL_RULES)}) x(h, p, v)),
fit AS (
  SELECT k, h || p AS rule, v, row_number() OVER (PARTITION BY k ORDER BY len(h || p) DESC, len(h) DESC) AS n
  FROM c JOIN r ON (c.host = r.h OR ends_with(c.host, '.' || r.h)) AND starts_with(c.path, r.p))
SELECT page_id, host, path, rule, coalesce(v, CASE WHEN l.canonical_url IS NOT NULL THEN 'block' ELSE 'allow' END) AS verdict,
  l.canonical_url IS NOT NULL AS listed
FROM c LEFT JOIN (SELECT * FROM fit WHERE n = 1) USING (k) LEFT JOIN listed l ON l.canonical_url = c.canonical_url AND c.host <> ''
"""


@query
def op3_merkle_fixity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Audit a replica of the archive of all pages, in which about 3 records in 256 have been damaged.

    A digest of the id says which: the last character is gone, a space was added, or the record is missing. One row a
    record of the primary, with its place and hash, what the audit found, and the primary's root.
    """
    pages = table(spark, sf_dir, "pages")
    record = warc_record(F.col("page_id"), F.col("url"), F.col("html"))
    lot = F.substring(F.md5(F.coalesce(F.col("page_id").cast("string"), F.lit("")).cast("binary")), 1, 2)
    hurt = F.when(lot == "0f", F.expr("left(html, greatest(0, length(html) - 1))")).when(lot == "1e", F.concat(F.coalesce("html", F.lit("")), F.lit(" "))).otherwise(F.col("html"))
    replica = pages.where(lot != "2d").withColumn("html", hurt)
    primary = manifest(pages, "page_id", record)
    found, roots = audit(primary, manifest(replica, "page_id", record))
    lost = found.where("lost > 0").select(F.col("key").alias("k"), F.col("hash").alias("h"), "status")
    root = roots.where("side = 'primary'").first()  # one row
    return places(primary).join(lost, F.col("key").eqNullSafe(F.col("k")) & (F.col("hash") == F.col("h")), "left").select(
        F.col("key").alias("page_id"), "file_no", F.col("offset").alias("record_offset"), F.col("length").alias("record_length"), F.col("hash").alias("record_sha256"),
        F.coalesce("status", F.lit("intact")).alias("status"), F.lit(root["hash"] if root else None).cast("string").alias("root_sha256"))


_MERKLE_LEVELS = 10
ORACLE["op3_merkle_fixity"] = r"""
WITH p AS (
  SELECT page_id AS key, html, substr(md5(coalesce(CAST(page_id AS VARCHAR), '')), 1, 2) AS lot,
    'WARC/1.1' || chr(13) || chr(10) || 'WARC-Type: resource' || chr(13) || chr(10) || 'WARC-Record-ID: <urn:record:' || coalesce(CAST(page_id AS VARCHAR), '')
      || '>' || chr(13) || chr(10) || 'WARC-Target-URI: ' || coalesce(url, '') || chr(13) || chr(10) || 'Content-Type: text/html' || chr(13) || chr(10)
      || 'Content-Length: ' || strlen(coalesce(html, '')) || chr(13) || chr(10) || chr(13) || chr(10) || coalesce(html, '') AS record FROM pages),
h AS (SELECT key, CAST(strlen(record) AS BIGINT) AS length, sha256(record) AS hash,
    CASE lot WHEN '0f' THEN CASE WHEN len(html) > 0 THEN 'changed' ELSE 'intact' END WHEN '1e' THEN 'changed' WHEN '2d' THEN 'missing' ELSE 'intact' END AS status FROM p),
m AS (SELECT *, row_number() OVER (ORDER BY key NULLS FIRST, hash) - 1 AS place FROM h),
f AS (SELECT *, place // 4096 AS file_no FROM m),
e AS (SELECT key, length, hash, count(*) AS n, min(place) AS place FROM m GROUP BY key, length, hash),
l1 AS (
  SELECT place // 16 AS node, sha256(sha256(string_agg(coalesce(CAST(key AS VARCHAR), '') || ':' || length || ':' || hash || ':' || n, ',' ORDER BY key NULLS FIRST, hash))) AS hash,
    CAST(sum(length * n) AS BIGINT) AS length FROM e GROUP BY 1),
""" + ",\n".join(f"""l{i + 1} AS (SELECT node // 16 AS node, sha256(string_agg(node || ':' || length || ':' || hash, ',' ORDER BY node)) AS hash, CAST(sum(length) AS BIGINT) AS length FROM l{i} GROUP BY 1)""" for i in range(1, _MERKLE_LEVELS)) + """,
tops AS (""" + " UNION ALL ".join(f"SELECT {i} AS level, count(*) AS n, min(hash) AS hash FROM l{i}" for i in range(1, _MERKLE_LEVELS + 1)) + """)
SELECT key AS page_id, CAST(file_no AS BIGINT) AS file_no,
  CAST(coalesce(sum(length + 4) OVER (PARTITION BY file_no ORDER BY place ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS record_offset,
  length AS record_length, hash AS record_sha256, status, (SELECT hash FROM tops WHERE n = 1 ORDER BY level LIMIT 1) AS root_sha256
FROM f
"""


@query
def op2_ordinal_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train on a bounded sample of ``labels``, score all documents; ``toxic`` marks grade 1 and above."""
    documents = table(spark, sf_dir, "documents")
    model = train_toxicity(documents, table(spark, sf_dir, "labels"))
    return score_toxicity(documents, model).withColumn("toxic", (F.col("grade") >= 1).cast("int"))


@query
def op8_skip_chain_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Train the field on a bounded sample, run it over all documents."""
    documents = table(spark, sf_dir, "documents")
    return find_pii(documents, train_pii(documents))
