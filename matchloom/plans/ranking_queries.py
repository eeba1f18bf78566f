"""Queries on folds, pools and rankings."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.operators import fusion, lexical, matrices, pools, retrieval, splits
from matchloom.operators.embedding import nearest
from matchloom.operators.postings import hashed
from matchloom.operators.storage import stored
from matchloom.plans.base import PAIRS, jac, own_items, query, requirements, rounded, share, table, toks, tset
from matchloom.plans.score_queries import _ITEMS, _STOP, _bm25_sql
from matchloom.plans.vector_queries import _E, embeddings


@query("""WITH s AS (SELECT doc_id, quality, seed, md5(seed || '|' || doc_id) AS h FROM labels, (VALUES (3407), (42), (2026)) s(seed))
SELECT doc_id, quality, seed, CAST((row_number() OVER (PARTITION BY seed, quality ORDER BY h, doc_id) - 1) % 5 AS INTEGER) AS fold FROM s""")
def stratified_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_folds(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "quality", "seed", "fold")


@query("""WITH s AS (SELECT doc_id, quality, seed, md5('holdout|' || seed || '|' || doc_id) AS h FROM labels, (VALUES (3407), (42), (2026), (2027), (2028)) s(seed)),
r AS (SELECT *, row_number() OVER (PARTITION BY seed, quality ORDER BY h, doc_id) AS n, count(*) OVER (PARTITION BY seed, quality) AS c FROM s)
SELECT doc_id, quality, seed, n <= floor(c * 0.2 + 0.5) AS is_test FROM r""")
def holdout_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return splits.stratified_holdout(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id", "quality").select("doc_id", "quality", "seed", "is_test")


@query()
def group_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Folds that keep a source together. Largest first to the emptiest fold: a loop that SQL doesn't have."""
    found = splits.group_folds(table(spark, sf_dir, "documents").select("doc_id", "source"), "source")
    return found.select("doc_id", "source", "fold")


_RANDOM = """ord AS (SELECT doc_id AS cand, row_number() OVER (ORDER BY md5('3407|' || doc_id), doc_id) - 1 AS place FROM labels WHERE toxic <> 1),
qs AS (SELECT doc_id AS query, ('0x' || substr(md5('start|3407|' || doc_id), 1, 8))::UBIGINT::BIGINT AS start FROM labels WHERE toxic = 1),
pool AS (SELECT query, 0 AS pos, query AS cand FROM qs UNION ALL
  SELECT query, i + 1, cand FROM (SELECT query, i, (start + i) % (SELECT count(*) FROM ord) AS place FROM qs, range(19) r(i)) JOIN ord USING (place))"""


def labelled_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pools.random_pools(table(spark, sf_dir, "labels").select("doc_id", "toxic"), "doc_id", "toxic", 3407)


@query(f"WITH {_RANDOM} SELECT query, CAST(pos AS INTEGER) AS pos, cand FROM pool")
def random_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A toxic document as the positive, 19 others without repeats."""
    return labelled_pool(spark, sf_dir)


_HARD = f"""{_E}, u AS (SELECT vec_id, label, list_transform(v, lambda x: x / CASE WHEN len = 0 THEN 1 ELSE len END) AS u FROM n JOIN (SELECT vec_id, label FROM embeddings) USING (vec_id)),
sim AS (SELECT a.vec_id AS query, b.vec_id AS cand, round(list_dot_product(a.u, b.u), 9) AS similarity FROM u a JOIN u b ON a.label = 1 AND b.label = 0),
hard AS (SELECT query, row_number() OVER (PARTITION BY query ORDER BY similarity DESC, cand) AS pos, cand FROM sim)"""


@query(f"WITH {_HARD} SELECT query, CAST(pos AS INTEGER) AS pos, cand FROM hard WHERE pos <= 19 UNION ALL SELECT vec_id, 0, vec_id FROM embeddings WHERE label = 1")
def hard_pools(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 19 vectors of class 0 nearest to each of class 1."""
    e = embeddings(spark, sf_dir)
    of = lambda c: e.where(F.col("label") == c).select(F.col("vec_id").alias("id"), "v")
    found = nearest(of(1), of(0), 19).select(F.col("id").alias("query"), F.col("other").alias("cand"), F.col("cosine").alias("similarity"))
    return pools.hard_pools(of(1).select(F.col("id").alias("query")), found)


_POOLED = f"""WITH {PAIRS}, {_RANDOM},
t AS (SELECT doc_id, {tset('text')} AS a, {tset('jd')} AS b FROM pairs),
ps AS (SELECT query, pos, cand, round({jac('x.a', 'y.b')}, 9) AS jaccard, round({share('len(list_intersect(x.a, y.b))', 'len(y.b)')}, 9) AS kg FROM pool JOIN t x ON x.doc_id = query JOIN t y ON y.doc_id = cand),
pl AS (UNPIVOT ps ON jaccard, kg INTO NAME method VALUE score),
rk AS (SELECT method, query, pos, row_number() OVER (PARTITION BY method, query ORDER BY score DESC, pos) AS rank, score, max(CASE WHEN pos = 0 THEN score END) OVER (PARTITION BY method, query) AS own FROM pl)"""


def pool_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``method, query, pos, cand, score`` of random pools: a query's text against each candidate's own item."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    docs = table(spark, sf_dir, "documents")
    pool = labelled_pool(spark, sf_dir)
    asked = docs.join(pool.select(F.col("query").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("query"), T.token_set(F.col("text")).alias("a"))
    cands = own_items(spark, sf_dir, docs.select("doc_id"), items).select(F.col("doc_id").alias("cand"), "b")
    p = pool.join(cands, "cand").join(asked, "query")
    s = p.select("query", "pos", "cand", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"), F.round(T.overlap(F.col("a"), F.col("b")), 9).alias("kg"))
    return s.unpivot(["query", "pos", "cand"], ["jaccard", "kg"], "method", "score")


@query(f"""{_POOLED} SELECT method, round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_at_5,
  round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, count(*) AS queries FROM rk WHERE pos = 0 GROUP BY method""")
def rank_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of the own item in its pool; the own one wins ties."""
    ranks = pools.rank_of_own(pool_scores(spark, sf_dir), ["method", "query"])
    found = pools.mean_rank_metrics(ranks, ["method"])
    return found.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in found.dtypes))


@query(f"""{_POOLED}, pe AS (SELECT method, query, 1 + count(*) FILTER (pos <> 0 AND score >= own) AS rank FROM rk GROUP BY ALL)
SELECT method, round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(rank), 6) AS mean_rank FROM pe GROUP BY method""")
def rank_metrics_pessimistic(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same ranks where the own item loses ties, so that a constant score ranks it last."""
    ranks = pools.rank_of_own(pool_scores(spark, sf_dir), ["method", "query"], ties="pessimistic")
    return ranks.groupBy("method").agg(rounded(F.avg(1.0 / F.col("rank"))).alias("mrr"), rounded(F.avg("rank")).alias("mean_rank"))


@query(f"""WITH {PAIRS}, {_RANDOM}, pt AS (SELECT query, pos, cand, {toks('jd')} AS tokens FROM pool JOIN pairs ON doc_id = cand),
{_bm25_sql('query', 'SELECT query, cand AS item, tokens FROM pt', 'plus_one')},
bq AS (SELECT query, unnest({toks('text')}) AS term FROM (SELECT DISTINCT query FROM pool) JOIN pairs ON doc_id = query),
bs AS (SELECT query, item AS cand, sum(weight) AS bm25 FROM bq JOIN post USING (query, term) GROUP BY ALL)
SELECT query, CAST(pos AS INTEGER) AS pos, cand, round(coalesce(bm25, 0), 6) AS bm25 FROM pool LEFT JOIN bs USING (query, cand)""")
def bm25_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """BM25 with statistics of each pool of its own."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    pool = labelled_pool(spark, sf_dir)
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("jd"))
    cands = own_items(spark, sf_dir, docs.select("doc_id"), items).select(F.col("doc_id").alias("cand"), F.col("jd").alias("text"))
    postings, _ = lexical.bm25_index(pool.join(cands, "cand").select("query", "cand", "text"), ["query"], "cand")
    asked = pool.select("query").distinct().join(docs.withColumnRenamed("doc_id", "query"), "query")
    # Query and scope are the same column here.
    found = asked.select("query", F.explode(T.tokenize(F.col("text"))).alias("term")).select("query", F.xxhash64("term").alias("term")).join(postings, ["query", "term"]).groupBy("query", "cand").agg(F.sum("weight").alias("bm25"))
    return pool.join(found, ["query", "cand"], "left").select("query", "pos", "cand", rounded(F.coalesce("bm25", F.lit(0.0))).alias("bm25"))


# --- full retrieval: each labelled document against all items --------------------------------------

_FULL = f"""{PAIRS}, q AS (SELECT doc_id, item_id AS own, quality, {tset('text')} AS a FROM lp), i AS (SELECT item_id, {tset('text')} AS b FROM benchmark),
grid AS (SELECT doc_id, own, quality, item_id, round({jac('a', 'b')}, 9) AS score FROM q, i),
rf AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, item_id) AS rank FROM grid)"""


def overlaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, own, quality, n_items, item_id, jaccard`` of labelled documents and the items that share a token with them.

    An inverted index instead of all pairs: tokens of documents meet those of items, and pairs without a common token never arise.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    labelled = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    docs = labelled.withColumn("own", F.pmod("doc_id", F.lit(items.count()))).select("doc_id", "own", "quality", T.token_set(F.col("text")).alias("a"))
    none = F.array().cast("array<string>")
    left = docs.select("doc_id", "own", "quality", F.size("a").alias("na"), F.explode(F.coalesce("a", none)).alias("t"))
    right = items.select("item_id", F.size("b").alias("nb"), F.explode(F.coalesce("b", none)).alias("t"))
    both = left.join(right, "t").groupBy("doc_id", "own", "quality", "na", "item_id", "nb").agg(F.count("*").alias("c"))
    return both.select("doc_id", "own", "quality", "item_id", F.round(F.col("c") / (F.col("na") + F.col("nb") - F.col("c")), 9).alias("jaccard"))


@query(f"""WITH {_FULL} SELECT round(avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END), 6) AS recall_at_5, round(avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END), 6) AS ndcg_at_5,
  round(avg(1.0::DOUBLE / rank), 6) AS mrr, round(avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END), 6) AS hit_at_1, count(*) AS queries FROM rf WHERE item_id = own AND quality = 1""")
def full_retrieval_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rank of each positive document's own item among all items, ties to the smaller item; items without a common token score 0."""
    o = overlaps(spark, sf_dir).where("quality = 1")
    labels = table(spark, sf_dir, "labels").where("quality = 1")
    n = table(spark, sf_dir, "benchmark").count()
    queries = table(spark, sf_dir, "documents").select("doc_id").join(labels.select("doc_id"), "doc_id").withColumn("own", F.pmod("doc_id", F.lit(n)))
    own = o.where("item_id = own").select("doc_id", F.col("jaccard").alias("s"))
    scored = queries.join(own, "doc_id", "left").withColumn("s", F.coalesce("s", F.lit(0.0)))
    above = scored.join(o.select("doc_id", "item_id", "jaccard"), "doc_id", "left").groupBy("doc_id", "own", "s").agg(
        F.count_if((F.col("jaccard") > F.col("s")) | ((F.col("jaccard") == F.col("s")) & (F.col("item_id") < F.col("own")))).alias("above"), F.count_if(F.col("item_id") < F.col("own")).alias("held_below"))
    # Items without a common token tie with an own score of 0; those of smaller ids come first.
    rank = (1 + F.col("above") + F.when(F.col("s") == 0, F.col("own") - F.col("held_below")).otherwise(0)).cast("int")
    found = pools.mean_rank_metrics(above.select(rank.alias("rank")), [])
    return found.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in found.dtypes))


_TOP = f"""top AS (SELECT doc_id, item_id FROM rf WHERE rank = 1),
tc AS (SELECT t.doc_id, t.item_id, {tset('d.text')} AS a, {tset('b.text')} AS b FROM top t JOIN documents d USING (doc_id) JOIN benchmark b USING (item_id))"""


@query(f"WITH {_FULL}, {_TOP} SELECT count(*) AS queries, round(avg({jac('a', 'b')}), 6) AS mean_jaccard, round(avg({share('len(list_intersect(a, b))', 'len(b)')}), 6) AS mean_coverage FROM tc")
def top1_consistency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """How well the top item of every labelled document explains itself; without any common token it is the first item."""
    o = overlaps(spark, sf_dir)
    best = lexical.first_by(o, ["doc_id"], [F.desc("jaccard"), F.col("item_id")], 1).select("doc_id", "item_id")
    first = table(spark, sf_dir, "benchmark").agg(F.min("item_id").alias("m")).first()["m"]
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id")
    top = docs.join(best, "doc_id", "left").withColumn("item_id", F.coalesce("item_id", F.lit(first))).select("doc_id", "item_id", T.token_set(F.col("text")).alias("a"))
    found = top.join(table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b")), "item_id")
    return found.agg(F.count("*").alias("queries"), rounded(F.avg(T.jaccard(F.col("a"), F.col("b")))).alias("mean_jaccard"), rounded(F.avg(T.overlap(F.col("a"), F.col("b")))).alias("mean_coverage"))


# --- pools and the whole matrix by several methods ---------------------------------------------------

_POOL_TFIDF = rf"""{PAIRS}, {_RANDOM},
pr AS MATERIALIZED (SELECT DISTINCT query FROM pool),
tx AS MATERIALIZED (SELECT query, 0 AS side, query AS id, text FROM pr JOIN documents ON doc_id = query UNION ALL SELECT query, 1, cand, jd FROM pool JOIN pairs ON doc_id = cand),
tw AS (SELECT query, side, id, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM tx),
ttf AS MATERIALIZED (SELECT query, side, id, term, count(*) AS tf FROM (SELECT query, side, id, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM tw) GROUP BY ALL),
tn AS (SELECT query, count(*)::DOUBLE AS n FROM tx GROUP BY query),
tdf AS (SELECT query, term, count(*) AS df FROM ttf GROUP BY ALL),
twt AS MATERIALIZED (SELECT query, side, id, term, tf * (ln((1.0::DOUBLE + n) / (1.0 + df)) + 1.0) AS w FROM ttf JOIN tdf USING (query, term) JOIN tn USING (query)),
tln AS (SELECT query, side, id, sqrt(sum(w * w)) AS len FROM twt GROUP BY ALL),
tdt AS (SELECT c.query, c.id, sum(c.w * q.w) AS dot FROM twt c JOIN twt q ON q.query = c.query AND q.term = c.term AND q.side = 0 WHERE c.side = 1 GROUP BY ALL),
tfidf_in AS MATERIALIZED (SELECT p.query, p.pos, p.cand, coalesce(dot / (a.len * b.len), 0) AS tfidf FROM pool p LEFT JOIN tdt d ON d.query = p.query AND d.id = p.cand
  LEFT JOIN tln a ON a.query = p.query AND a.side = 0 LEFT JOIN tln b ON b.query = p.query AND b.side = 1 AND b.id = p.cand)"""


def pool_tfidf(spark: SparkSession, sf_dir: str, pool: DataFrame) -> DataFrame:
    """``query, cand, tfidf`` from the corpus of each pool alone: the query's text and its candidates' items."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    items = table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("jd"))
    cands = own_items(spark, sf_dir, docs.select("doc_id"), items).select(F.col("doc_id").alias("cand"), F.col("jd").alias("text"))
    asked = pool.select("query").distinct().join(docs.withColumnRenamed("doc_id", "query"), "query")
    corpus = asked.select("query", F.lit(0).alias("side"), F.col("query").alias("id"), "text").unionByName(pool.join(cands, "cand").select("query", F.lit(1).alias("side"), F.col("cand").alias("id"), "text"))
    return lexical.tfidf_scoped(corpus, ["query"]).withColumnRenamed("id", "cand")


@query(f"WITH {_POOL_TFIDF} SELECT query, CAST(pos AS INTEGER) AS pos, cand, round(tfidf, 6) AS tfidf FROM tfidf_in")
def tfidf_pool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF fitted anew on each pool."""
    pool = stored(labelled_pool(spark, sf_dir), "pool")
    return pool.join(pool_tfidf(spark, sf_dir, pool), ["query", "cand"]).select("query", "pos", "cand", rounded(F.col("tfidf")).alias("tfidf"))


def _scaled_in(x: str) -> str:
    lo, hi = f"min({x}) OVER (PARTITION BY query)", f"max({x}) OVER (PARTITION BY query)"
    return f"CASE WHEN abs({hi} - {lo}) <= 1e-8 + 1e-5 * abs({hi}) THEN 0.0::DOUBLE ELSE ({x} - {lo}) / ({hi} - {lo}) END"


_DIRECTED = ["tfidf", "jaccard", "kg", "fused"]


@query(f"""WITH {_POOL_TFIDF},
t AS MATERIALIZED (SELECT doc_id, {tset('text')} AS a, {tset('jd')} AS b FROM pairs),
ps AS MATERIALIZED (SELECT query, pos, cand, tfidf, {jac('x.a', 'y.b')} AS jaccard, {share('len(list_intersect(x.a, y.b))', 'len(y.b)')} AS kg FROM tfidf_in JOIN t x ON x.doc_id = query JOIN t y ON y.doc_id = cand),
fp AS MATERIALIZED (SELECT *, 0.45 * {_scaled_in('tfidf')} + 0.45 * {_scaled_in('kg')} + 0.1 * {_scaled_in('jaccard')} AS fused FROM ps),
lg AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{m}' AS method, query, pos, jaccard, round({m}, 9) AS score FROM fp" for m in _DIRECTED)}),
g AS (SELECT method, score, count(*) FILTER (pos = 0) AS p, count(*) FILTER (pos <> 0) AS n FROM lg GROUP BY ALL),
b AS (SELECT *, sum(n) OVER (PARTITION BY method ORDER BY score) - n AS before FROM g),
au AS (SELECT method, sum(p * (before + n / 2.0))::DOUBLE / (sum(p) * sum(n)) AS auc FROM b GROUP BY method),
tu AS MATERIALIZED (SELECT method, query, pos, jaccard, score * CASE WHEN auc < 0.5 THEN -1 ELSE 1 END AS score FROM lg JOIN au USING (method)),
rk AS (SELECT *, row_number() OVER (PARTITION BY method, query ORDER BY score DESC, pos) AS rank FROM tu),
rm AS (SELECT method, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS ndcg_at_5, avg(1.0::DOUBLE / rank) AS mrr, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS hit_at_1, count(*) AS queries FROM rk WHERE pos = 0 GROUP BY method),
tp AS (SELECT method, avg(jaccard) AS consistency FROM rk WHERE rank = 1 GROUP BY method)
SELECT method, round(recall_at_5, 6) AS recall_at_5, round(ndcg_at_5, 6) AS ndcg_at_5, round(mrr, 6) AS mrr, round(hit_at_1, 6) AS hit_at_1, queries, round(consistency, 6) AS consistency, CASE WHEN auc < 0.5 THEN -1 ELSE 1 END AS direction FROM rm JOIN tp USING (method) JOIN au USING (method)""")
def pool_ranking_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Pools ranked by each method: TF-IDF of the pool's own corpus, fusion scaled within the pool, scores turned by direction; and how well the first job explains itself."""
    pool = stored(labelled_pool(spark, sf_dir), "pool")
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    docs = table(spark, sf_dir, "documents")
    asked = docs.join(pool.select(F.col("query").alias("doc_id")).distinct(), "doc_id").select(F.col("doc_id").alias("query"), T.token_set(F.col("text")).alias("a"))
    cands = own_items(spark, sf_dir, docs.select("doc_id"), items).select(F.col("doc_id").alias("cand"), "b")
    p = pool.join(pool_tfidf(spark, sf_dir, pool), ["query", "cand"]).join(cands, "cand").join(asked, "query")
    s = stored(p.select("query", "pos", "cand", "tfidf", T.jaccard(F.col("a"), F.col("b")).alias("jaccard"), T.overlap(F.col("a"), F.col("b")).alias("kg")), "pool_scores")
    fused = stored(fusion.fuse(s, {"tfidf": 0.45, "kg": 0.45, "jaccard": 0.1}, "fused", ["query"]), "pool_fused")
    long = fusion.to_long(fused, ["query", "pos", "cand"], _DIRECTED).withColumns({"score": F.round("score", 9), "label": (F.col("pos") == 0).cast("int")})
    report = stored(fusion.directions(long, ["method"]), "directions")
    turned = stored(fusion.oriented(long, report, ["method"]), "turned")
    ranks = pools.mean_rank_metrics(pools.rank_of_own(turned, ["method", "query"]), ["method"])
    top = pools.top_of_pool(turned, ["method", "query"]).join(fused.select("query", F.col("cand").alias("top"), "jaccard"), ["query", "top"])
    found = ranks.join(top.groupBy("method").agg(F.avg("jaccard").alias("consistency")), "method").join(report.select("method", "direction"), "method")
    return found.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in found.dtypes))


def _mm_all(x: str) -> str:
    return f"CASE WHEN abs(max({x}) OVER () - min({x}) OVER ()) <= 1e-8 + 1e-5 * abs(max({x}) OVER ()) THEN 0.0::DOUBLE ELSE ({x} - min({x}) OVER ()) / (max({x}) OVER () - min({x}) OVER ()) END"


_BY_METHOD = ["bm25", "kg", "jaccard", "retrieval_fusion"]


@query(f"""WITH {PAIRS}, {_bm25_sql('', _ITEMS, 'plus_one')},
q AS MATERIALIZED (SELECT doc_id, item_id AS own, quality, {tset('text')} AS a FROM lp), i AS MATERIALIZED (SELECT item_id, {tset('text')} AS b FROM benchmark),
qt AS (SELECT doc_id, unnest({toks('text')}) AS term FROM lp),
bg AS MATERIALIZED (SELECT doc_id, item AS item_id, sum(weight) AS bm25 FROM qt JOIN post USING (term) GROUP BY ALL),
gr AS MATERIALIZED (SELECT doc_id, own, quality, item_id, {jac('a', 'b')} AS jaccard, {share('len(list_intersect(a, b))', 'len(b)')} AS kg FROM q, i),
gb AS MATERIALIZED (SELECT gr.*, coalesce(bm25, 0) AS bm25 FROM gr LEFT JOIN bg USING (doc_id, item_id)),
gf AS MATERIALIZED (SELECT *, 0.55 * {_mm_all('bm25')} + 0.45 * {_mm_all('kg')} AS retrieval_fusion FROM gb),
lg AS MATERIALIZED ({' UNION ALL '.join(f"SELECT '{m}' AS method, doc_id, own, quality, item_id, jaccard, round({m}, 9) AS score FROM gf" for m in _BY_METHOD)}),
rk AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY method, doc_id ORDER BY score DESC, item_id) AS rank FROM lg),
rm AS (SELECT method, avg(CASE WHEN rank <= 5 THEN 1.0 ELSE 0.0 END) AS recall_at_5, avg(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1.0::DOUBLE) ELSE 0 END) AS ndcg_at_5, avg(1.0::DOUBLE / rank) AS mrr, avg(CASE WHEN rank = 1 THEN 1.0 ELSE 0.0 END) AS hit_at_1, count(*) AS queries FROM rk WHERE item_id = own AND quality = 1 GROUP BY method),
tp AS (SELECT method, avg(jaccard) AS consistency FROM rk WHERE rank = 1 GROUP BY method),
sp AS (SELECT method, avg(score) AS score_mean, stddev_pop(score) AS score_std FROM lg GROUP BY method)
SELECT method, round(recall_at_5, 6) AS recall_at_5, round(ndcg_at_5, 6) AS ndcg_at_5, round(mrr, 6) AS mrr, round(hit_at_1, 6) AS hit_at_1, queries, round(consistency, 6) AS consistency, round(score_mean, 6) AS score_mean, round(score_std, 6) AS score_std
FROM rm JOIN tp USING (method) JOIN sp USING (method)""")
def retrieval_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents against all items by several methods, fusion scaled over the whole matrix: ranks of positives, consistency of every document's first item, spread of the scores."""
    items = table(spark, sf_dir, "benchmark")
    n = items.count()
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id", "quality"), "doc_id")
    asked = stored(docs.select(F.col("doc_id").alias("query"), "quality", F.pmod("doc_id", F.lit(n)).alias("own"), hashed(T.tokenize(F.col("text"))).alias("tokens")), "labelled")
    postings, _ = lexical.bm25_index(items.select(F.col("item_id").alias("cand"), "text"), [], "cand")
    sets = items.select(F.col("item_id").alias("cand"), hashed(T.token_set(F.col("text"))).alias("b"))
    found = retrieval.judged(asked, sets, postings, {"bm25": 0.55, "kg": 0.45})
    return found.select(*(rounded(F.col(c)).alias(c) if t == "double" else c for c, t in found.dtypes))


_KNOWN = f"""{PAIRS},
ki AS MATERIALIZED (SELECT item_id, {tset('text')} AS b, list_filter(list_transform(regexp_split_to_array(text, '[.]\\s*'), lambda x: {tset('x')}), lambda s: len(s) > 0) AS req FROM benchmark),
kq AS MATERIALIZED (SELECT doc_id, {tset('text')} AS a FROM lp)"""


@query(f"""WITH {_KNOWN}, kc AS (SELECT doc_id, item_id, {jac('a', 'b')} AS jaccard, {share("coalesce(list_sum(list_transform(req, lambda r: len(list_intersect(a, r))::DOUBLE / len(r))), 0)", "len(req)")} AS requirement, CASE WHEN len(a) = 0 THEN 1.0::DOUBLE ELSE 0.0 END AS additional FROM kq, ki)
SELECT doc_id AS query, item_id AS cand, round(0.45 * jaccard + 0.2 * requirement + 0.1 * additional + 1e-10, 6) AS overall, round(0.45 * jaccard + 0.25 * requirement + 0.15 * additional + 1e-10, 6) AS consistency FROM kc""")
def knowledge_matrix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The knowledge score of all pairs of labelled documents and items; an item's sentences are its requirements, and it has no criteria."""
    docs = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels").select("doc_id"), "doc_id").select(F.col("doc_id").alias("idx"), F.col("text").alias("resume_text"))
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("idx"), F.col("text").alias("job_text"), requirements(F.col("text")).alias("minimum_requirements"))
    found = matrices.knowledge_matrix(docs, items)
    # A little more, so that no engine finds a tie to round.
    return found.select("query", "cand", rounded(F.col("overall") + 1e-10).alias("overall"), rounded(F.col("consistency") + 1e-10).alias("consistency"))
