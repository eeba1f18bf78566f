"""Queries on tokens, token sets and text assembly."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.plans.base import PAIRS, criteria, jac, own_items, query, requirements, rounded, share, table, tset, toks


@query(f"SELECT doc_id, CAST(len(t) AS BIGINT) AS n_tokens, CAST(len(list_distinct(t)) AS BIGINT) AS n_distinct FROM (SELECT doc_id, {toks('text')} AS t FROM documents)")
def token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    return tokens.select("doc_id", F.size("t").cast("long").alias("n_tokens"), F.size(F.array_distinct("t")).cast("long").alias("n_distinct"))


@query(f"WITH {PAIRS}, s AS (SELECT doc_id, item_id, {tset('text')} AS a, {tset('jd')} AS b FROM pairs) SELECT doc_id, item_id, round({jac('a', 'b')}, 6) AS jaccard FROM s")
def jaccard_own_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    s = own_items(spark, sf_dir, table(spark, sf_dir, "documents").select("doc_id", T.token_set(F.col("text")).alias("a")), items)
    return s.select("doc_id", "item_id", rounded(T.jaccard(F.col("a"), F.col("b"))).alias("jaccard"))


#: Components of the knowledge score in SQL; the weights of null and 0 are 1 already.
_PARTS = f"""{PAIRS},
i AS (
  SELECT item_id, jd, {tset('jd')} AS b, list_filter(list_transform(regexp_split_to_array(jd, '[.]\\s*'), lambda x: {tset('x')}), lambda s: len(s) > 0) AS req,
    list_sort({tset('jd')})[1:5] AS keys FROM (SELECT item_id, text AS jd FROM benchmark)),
w AS (SELECT *, list_transform([60.0::DOUBLE, 1.0, 1.0, 40.0, 10.0][1:len(keys)], lambda x: x) AS weights FROM i),
s AS (SELECT p.doc_id, p.lang, {tset('p.text')} AS a, {tset("concat_ws(chr(10), p.text, p.jd)")} AS ab, {tset("coalesce(p.source, '') || ' ' || coalesce(p.lang, '')")} AS extra, w.* FROM pairs p JOIN w USING (item_id)),
c AS (
  SELECT doc_id, item_id, {jac('a', 'b')} AS jaccard,
    {share("coalesce(list_sum(list_transform(req, lambda r: len(list_intersect(a, r))::DOUBLE / len(r))), 0)", "len(req)")} AS requirement,
    {jac('a', 'extra')} AS additional,
    {share("coalesce(list_sum(list_transform(range(1, len(keys) + 1), lambda k: CASE WHEN list_contains(ab, keys[k]) THEN weights[k] ELSE 0 END)), 0)", "coalesce(list_sum(weights), 0)")} AS criteria_all,
    {share("coalesce(list_sum(list_transform(range(1, len(keys) + 1), lambda k: CASE WHEN list_contains(a, keys[k]) THEN weights[k] ELSE 0 END)), 0)", "coalesce(list_sum(weights), 0)")} AS criteria_own
  FROM s)"""


def components(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Parts of the knowledge score. Each text is tokenised once, items before they meet documents."""
    jd = F.col("text")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(jd).alias("job"), T.item_sets(requirements(jd)).alias("needs"), T.criteria_sets(criteria(jd)).alias("criteria"))
    extra = F.concat_ws(" ", F.coalesce("source", F.lit("")), F.coalesce("lang", F.lit("")))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.token_set(F.col("text")).alias("own"), T.token_set(extra).alias("extra"))
    p = own_items(spark, sf_dir, docs, items)
    parts = T.knowledge_components(F.col("own"), F.col("job"), F.col("needs"), F.col("extra"), F.col("criteria"))
    return p.select("doc_id", "item_id", *(c.alias(n) for n, c in parts.items()), T.criteria_of_sets(F.col("own"), F.col("criteria")).alias("criteria_own"))


@query(f"WITH {_PARTS} SELECT doc_id, item_id, round(requirement, 6) AS requirement_coverage FROM c")
def requirement_coverage(spark: SparkSession, sf_dir: str) -> DataFrame:
    return components(spark, sf_dir).select("doc_id", "item_id", rounded(F.col("requirement")).alias("requirement_coverage"))


@query(f"WITH {_PARTS} SELECT doc_id, item_id, round(criteria_own, 6) AS criteria, round(criteria_all, 6) AS criteria_with_job FROM c")
def criteria_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """In the candidate's text, and in candidate and job together, where it is always 1 as the job holds its own criteria."""
    return components(spark, sf_dir).select("doc_id", "item_id", rounded(F.col("criteria_own")).alias("criteria"), rounded(F.col("criteria")).alias("criteria_with_job"))


@query(f"WITH {_PARTS} SELECT doc_id, item_id, round(0.45 * jaccard + 0.2 * requirement + 0.1 * additional + 0.25 * criteria_all, 6) AS overall, round(jaccard, 6) AS jaccard, round(requirement, 6) AS requirement, round(additional, 6) AS additional FROM c")
def kg_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = components(spark, sf_dir)
    parts = {n: F.col(n) for n in T.OVERALL_WEIGHTS}
    return c.select("doc_id", "item_id", rounded(T.weighted(parts, T.OVERALL_WEIGHTS)).alias("overall"), *(rounded(F.col(n)).alias(n) for n in ("jaccard", "requirement", "additional")))


@query(f"WITH {_PARTS} SELECT doc_id, item_id, round(0.45 * jaccard + 0.25 * requirement + 0.15 * additional + 0.15 * criteria_all, 6) AS consistency FROM c")
def explanation_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = {n: F.col(n) for n in T.CONSISTENCY_WEIGHTS}
    return components(spark, sf_dir).select("doc_id", "item_id", rounded(T.weighted(parts, T.CONSISTENCY_WEIGHTS)).alias("consistency"))


@query(f"""WITH {PAIRS}, s AS (SELECT doc_id, item_id, {toks('text')} AS ra, {toks('jd')} AS ca, {tset("regexp_replace(jd, '[.].*', '', 's')")} AS q FROM pairs),
t AS (SELECT *, list_distinct(ra) AS r, list_distinct(ca) AS c FROM s)
SELECT doc_id, item_id, round({share('len(list_intersect(r, c))', 'len(c)')}, 6) AS kg_skill_coverage, len(list_intersect(r, c))::DOUBLE AS skill_overlap_count,
  round(CASE WHEN len(c) = 0 THEN 0.0 ELSE 1.0 - {share('len(list_intersect(r, c))', 'len(c)')} END, 6) AS missing_skill_ratio,
  round({share('len(list_intersect(r, q))', 'len(q)')}, 6) AS requirement_coverage, CAST(len(ra) AS BIGINT) AS resume_length, CAST(len(ca) AS BIGINT) AS jd_length FROM t""")
def token_pair_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coverage features; the requirement is the item's first sentence."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("c"), F.size(T.tokenize(F.col("text"))).cast("long").alias("jd_length"), T.token_set(F.regexp_replace("text", r"(?s)[.].*", "")).alias("q"))
    docs = table(spark, sf_dir, "documents").select("doc_id", T.tokenize(F.col("text")).alias("t"))
    p = own_items(spark, sf_dir, docs.select("doc_id", F.array_distinct("t").alias("r"), F.size("t").cast("long").alias("resume_length")), items)
    found = T.pair_features(F.col("r"), F.col("c"), F.col("q"))
    return p.select("doc_id", "item_id", "resume_length", "jd_length", *((rounded(c) if n in ("kg_skill_coverage", "missing_skill_ratio", "requirement_coverage") else c).alias(n) for n, c in found.items()))


_SAID = ", ".join(f"max(CASE WHEN turn = {i} THEN text END) AS t{i}" for i in range(6))
_PART = "CASE WHEN trim({t}, ' ') <> '' THEN {t} END"


@query(f"""WITH r AS (SELECT conv_id, {_SAID}, list(role ORDER BY turn, role) AS roles, max(turn) AS last FROM conversations GROUP BY conv_id)
SELECT conv_id, concat_ws(chr(10) || chr(10), {', '.join(_PART.format(t=f't{i}') for i in range(6))}) AS body,
  concat_ws(chr(10) || chr(10), {_PART.format(t='t0')}, CASE WHEN len(list_filter(roles, lambda x: x IS NOT NULL)) > 0 THEN array_to_string(list_filter(roles, lambda x: x IS NOT NULL), chr(10)) END,
    CASE WHEN last % 2 = 0 THEN 'True' ELSE 'False' END) AS summary FROM r""")
def text_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first turns of a conversation that aren't blank; and its opening with its roles, a list, and a flag."""
    turns = [F.max(F.when(F.col("turn") == i, F.col("text"))).alias(f"t{i}") for i in range(6)]
    rows = table(spark, sf_dir, "conversations").groupBy("conv_id").agg(*turns, F.array_sort(F.collect_list(F.struct("turn", "role"))).alias("x"), F.max("turn").alias("last"))
    roles = F.transform("x", lambda t: t["role"])
    return rows.select("conv_id", T.assemble(*(F.col(f"t{i}") for i in range(6))).alias("body"), T.assemble(F.col("t0"), T.safe_text(roles, "array<string>"), T.safe_text(F.col("last") % 2 == 0, "boolean")).alias("summary"))


@query("""SELECT event_id, coalesce(event_type, '') AS as_text, CASE WHEN value > 50 THEN 'True' WHEN value <= 50 THEN 'False' ELSE '' END AS as_flag,
  concat_ws(chr(10), event_type, props) AS as_lines, CASE WHEN event_type IS NULL THEN 0 ELSE 1 END AS list_size FROM events""")
def safe_values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values of several kinds as text and as lists."""
    e = table(spark, sf_dir, "events")
    return e.select("event_id", T.safe_text(F.col("event_type"), "string").alias("as_text"), T.safe_text(F.col("value") > 50, "boolean").alias("as_flag"),
                    T.safe_text(F.array("event_type", "props"), "array<string>").alias("as_lines"), F.size(T.safe_list(F.col("event_type"), "string")).alias("list_size"))


@query("""SELECT regexp_extract(coalesce(url, ''), '://([^/?#]*)', 1) AS host, count(*) AS pages, count(DISTINCT regexp_extract(coalesce(url, ''), '://[^/?#]*/([a-z]+)/', 1)) AS sections FROM pages GROUP BY 1""")
def host_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = table(spark, sf_dir, "pages").select(F.coalesce("url", F.lit("")).alias("url"))
    return p.groupBy(F.regexp_extract("url", "://([^/?#]*)", 1).alias("host")).agg(F.count("*").alias("pages"), F.count_distinct(F.regexp_extract("url", "://[^/?#]*/([a-z]+)/", 1)).alias("sections"))
