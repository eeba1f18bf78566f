"""Queries on lexical scores, fusion, direction, metrics and sweeps."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from matchloom.functions import text as T
from matchloom.functions import vectors as V
from matchloom.operators import fusion, lexical, metrics
from matchloom.operators.lexical import STOP_WORDS
from matchloom.operators.storage import stored
from matchloom.plans.base import PAIRS, jac, own_items, query, rounded, share, table, toks, tset
from matchloom.plans.vector_queries import _NOISY, _SIGMA, _cos, noisy_products, private_cosine

# --- lexical --------------------------------------------------------------------------------

_STOP = "[" + ", ".join(f"'{w}'" for w in STOP_WORDS) + "]"
_TFIDF = rf"""{PAIRS},
corpus AS MATERIALIZED (SELECT 0 AS side, doc_id AS id, item_id AS mate, text FROM pairs UNION ALL SELECT 1, item_id, item_id, text FROM benchmark),
ws AS (SELECT side, id, mate, list_filter(regexp_extract_all(lower(coalesce(text, '')), '[\p{{L}}\p{{N}}_]{{2,}}'), lambda w: NOT list_contains({_STOP}, w)) AS w FROM corpus),
tf AS MATERIALIZED (SELECT side, id, mate, term, count(*) AS tf FROM (SELECT side, id, mate, unnest(list_concat(w, list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1]))) AS term FROM ws) GROUP BY ALL)"""
_WEIGHTED = """df AS (SELECT term, count(*) AS df FROM tf GROUP BY term),
wt AS MATERIALIZED (SELECT side, id, mate, term, tf * (ln((1.0::DOUBLE + (SELECT count(*) FROM corpus)) / (1.0 + df)) + 1.0) AS w FROM tf JOIN df USING (term)),
norms AS (SELECT side, id, sqrt(sum(w * w)) AS len FROM wt GROUP BY ALL),
dots AS (SELECT a.id AS doc_id, sum(a.w * b.w) AS dot FROM wt a JOIN wt b ON a.side = 0 AND b.side = 1 AND a.mate = b.id AND a.term = b.term GROUP BY ALL),
tfidf AS (SELECT p.doc_id, p.item_id, coalesce(dot / (na.len * nb.len), 0) AS tfidf FROM pairs p LEFT JOIN dots USING (doc_id) LEFT JOIN norms na ON na.side = 0 AND na.id = p.doc_id LEFT JOIN norms nb ON nb.side = 1 AND nb.id = p.item_id)"""


def _texts(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    items = table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("r"), "text")
    docs = table(spark, sf_dir, "documents")
    pairs = own_items(spark, sf_dir, docs.select("doc_id"), items.select(F.col("r").alias("item_id"))).select(F.col("doc_id").alias("l"), F.col("item_id").alias("r"))
    return docs.select(F.col("doc_id").alias("l"), "text"), items, pairs


@query(f"WITH {_TFIDF}, {_WEIGHTED} SELECT doc_id, item_id, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_own_pair(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Unigrams and bigrams over documents and items together."""
    return lexical.tfidf_pairs(*_texts(spark, sf_dir)).select(F.col("l").alias("doc_id"), F.col("r").alias("item_id"), rounded(F.col("tfidf")).alias("tfidf"))


@query(f"WITH {_TFIDF} SELECT term, CAST(sum(tf) AS BIGINT) AS tf FROM tf GROUP BY term ORDER BY 2 DESC, 1 LIMIT 4000")
def tfidf_vocab_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 4000 commonest terms (a bounded vocabulary is the feature), ties by term."""
    left, right, _ = _texts(spark, sf_dir)
    # Corpus counts need no counts of single documents.
    terms = lexical.with_terms(left.select("text").unionByName(right.select("text"))).select(F.explode(F.coalesce("_t", F.array().cast("array<string>"))).alias("term"))
    return lexical.vocabulary(terms.withColumn("tf", F.lit(1)), 4000)


_VOCAB = f"""{_TFIDF.replace('tf AS MATERIALIZED (', 'tf0 AS MATERIALIZED (')},
vocab AS (SELECT term FROM tf0 GROUP BY term ORDER BY sum(tf) DESC, term LIMIT 4000),
tf AS MATERIALIZED (SELECT * FROM tf0 SEMI JOIN vocab USING (term))"""


@query(f"WITH {_VOCAB}, {_WEIGHTED} SELECT doc_id, item_id, round(tfidf, 6) AS tfidf FROM tfidf")
def tfidf_capped_vocabulary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """TF-IDF over the 4000 commonest terms only."""
    return lexical.tfidf_pairs(*_texts(spark, sf_dir), cap=4000).select(F.col("l").alias("doc_id"), F.col("r").alias("item_id"), rounded(F.col("tfidf")).alias("tfidf"))


def _bm25_sql(scope: str, corpus: str, idf_mode: str) -> str:
    """CTEs up to ``post``: (scope, item, term, weight) from ``corpus``: (scope, item, tokens)."""
    on = f"{scope}, " if scope else ""
    using = f" JOIN st USING ({scope})" if scope else ", st"
    if idf_mode == "plus_one":
        idf = f"idf AS (SELECT {on}term, ln(1 + (n - df + 0.5) / (df + 0.5)) AS idf FROM bdf{using})"
    else:
        idf = f"""raw AS (SELECT {on}term, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM bdf{using}),
idf AS (SELECT {on}term, CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER ({f'PARTITION BY {scope}' if scope else ''}) ELSE raw END AS idf FROM raw)"""
    return f"""bc AS ({corpus}),
st AS (SELECT {on}count(*)::DOUBLE AS n, avg(len(tokens)) AS avgdl FROM bc {f'GROUP BY {scope}' if scope else ''}),
btf AS (SELECT {on}item, term, count(*) AS tf FROM (SELECT {on}item, unnest(tokens) AS term FROM bc) GROUP BY ALL),
bdf AS (SELECT {on}term, count(*)::DOUBLE AS df FROM btf GROUP BY ALL),
{idf},
post AS (SELECT {', '.join(f'btf.{c}' for c in ([scope] if scope else []) + ['item', 'term'])}, idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * CASE WHEN len(tokens) = 0 THEN 1 ELSE len(tokens) END / CASE WHEN avgdl = 0 THEN 1 ELSE avgdl END)) AS weight
  FROM btf JOIN idf USING ({on}term) JOIN bc USING ({on}item){using})"""


_ITEMS = f"SELECT item_id AS item, {toks('text')} AS tokens FROM benchmark"
_OWN_BM25 = f"""qt AS (SELECT doc_id, item_id AS item, unnest({toks('text')}) AS term FROM pairs),
bm AS (SELECT doc_id, sum(weight) AS bm25 FROM qt JOIN post USING (item, term) GROUP BY doc_id)"""


def own_bm25(spark: SparkSession, sf_dir: str, idf_mode: str = "plus_one", docs: DataFrame | None = None) -> DataFrame:
    """``doc_id, item_id, bm25`` of each document (or of some: ``doc_id, text``) and its own item, over all items; 0 without a common token."""
    items = table(spark, sf_dir, "benchmark").select("item_id", "text")
    postings, _ = lexical.bm25_index(items, [], "item_id", idf_mode)
    docs = own_items(spark, sf_dir, docs if docs is not None else table(spark, sf_dir, "documents").select("doc_id", "text"), items.select("item_id"))
    found = lexical.bm25_scores(docs, "doc_id", postings, [], "item_id", paired=True)
    return docs.select("doc_id", "item_id").join(found, ["doc_id", "item_id"], "left").withColumn("bm25", F.coalesce("bm25", F.lit(0.0)))


for _name, _mode in (("bm25_own_pair", "plus_one"), ("bm25_okapi_floor", "okapi_floor")):
    def _bm25(spark: SparkSession, sf_dir: str, mode: str = _mode) -> DataFrame:
        return own_bm25(spark, sf_dir, mode).withColumn("bm25", rounded(F.col("bm25")))

    _bm25.__name__ = _name
    query(f"WITH {PAIRS}, {_bm25_sql('', _ITEMS, _mode)}, {_OWN_BM25} SELECT p.doc_id, p.item_id, round(coalesce(bm25, 0), 6) AS bm25 FROM pairs p LEFT JOIN bm USING (doc_id)")(_bm25)


# --- light features of labelled pairs -----------------------------------------------------------

_FEATURES = f"""{PAIRS}, {_bm25_sql('', _ITEMS, 'plus_one')}, {_OWN_BM25.replace('FROM pairs)', 'FROM lp)')},
{_NOISY.replace('e AS (', 've AS (', 1).replace('FROM e)', 'FROM ve)').replace('n AS (SELECT *', 'vn AS (SELECT *', 1).replace('FROM n) a JOIN n b', 'FROM vn) a JOIN vn b').replace('p AS (SELECT *', 'vp AS (SELECT *', 1).replace('(VALUES (3407), (42), (2026))', '(VALUES (3407))')},
dpc AS MATERIALIZED (SELECT vec_id, max(CASE WHEN seed = 3407 THEN cc / CASE WHEN sqrt(aa) * sqrt(bb) = 0 THEN 1 ELSE sqrt(aa) * sqrt(bb) END END) AS emb, max(CASE WHEN seed = 3407 THEN {_cos('(' + _SIGMA.format(e='2.0::DOUBLE') + ')')} END) AS dp FROM vp GROUP BY vec_id),
ts AS MATERIALIZED (SELECT doc_id % (SELECT count(*) FROM embeddings) AS vec_id, doc_id, item_id, toxic, quality, raw_score, lang, {tset('text')} AS a, {tset('jd')} AS b, {tset("regexp_replace(jd, '[.].*', '', 's')")} AS q FROM lp),
sc AS MATERIALIZED (
  SELECT ts.doc_id, ts.item_id, ts.toxic, ts.quality, ts.raw_score, ts.lang, round({jac('a', 'b')}, 9) AS jaccard, round({share('len(list_intersect(a, b))', 'len(b)')}, 9) AS kg, round({share('len(list_intersect(a, q))', 'len(q)')}, 9) AS requirement,
    round(coalesce(bm25, 0), 9) AS bm25, round(emb, 9) AS embedding, round(dp, 9) AS dp
  FROM ts LEFT JOIN bm USING (doc_id) JOIN dpc ON dpc.vec_id = ts.vec_id)"""

METHODS = ["jaccard", "kg", "requirement", "bm25", "embedding", "dp"]
_LONG = "long AS MATERIALIZED (" + " UNION ALL ".join(f"SELECT doc_id, item_id, toxic, quality, raw_score, lang, '{m}' AS method, {m} AS score FROM sc" for m in METHODS) + ")"


def light_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of labelled documents against their items: token sets, BM25, and vectors (a document takes the vector of its number).

    Written as a table: metrics read scores many times, and texts once.
    """
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"), T.token_set(F.regexp_replace("text", r"(?s)[.].*", "")).alias("q"))
    labelled = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    docs = labelled.select("doc_id", "lang", "toxic", "quality", F.least(F.lit(10.0), F.col("n_chars") / 1000.0).alias("raw_score"), T.token_set(F.col("text")).alias("a"))
    p = own_items(spark, sf_dir, docs, items)
    pair = T.pair_features(F.col("a"), F.col("b"), F.col("q"))
    scored = p.select("doc_id", "item_id", "toxic", "quality", "raw_score", "lang", F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("jaccard"),
                      F.round(pair["kg_skill_coverage"], 9).alias("kg"), F.round(pair["requirement_coverage"], 9).alias("requirement"))
    n = table(spark, sf_dir, "embeddings").count()
    v = noisy_products(spark, sf_dir, seeds=[3407]).select(F.col("vec_id").alias("vec"), F.round(V.cosine_of(F.col("cc"), F.sqrt("aa"), F.sqrt("bb")), 9).alias("embedding"), F.round(private_cosine(F.lit(V.gaussian_sigma(2.0))), 9).alias("dp"))
    b = own_bm25(spark, sf_dir, docs=labelled.select("doc_id", "text")).select("doc_id", F.round("bm25", 9).alias("bm25"))
    return stored(scored.join(b, "doc_id").join(v, F.pmod("doc_id", F.lit(n)) == F.col("vec")).drop("vec"), "light_features")


def long_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``doc_id, toxic, quality, raw_score, lang, method, score``: the label to find is ``toxic``."""
    return fusion.to_long(light_features(spark, sf_dir), ["doc_id", "item_id", "toxic", "quality", "raw_score", "lang"], METHODS).withColumn("label", F.col("toxic"))


def _mm(x: str, over: str = "") -> str:
    """Scaling to [0, 1] in SQL."""
    lo, hi = f"min({x}) OVER ({over})", f"max({x}) OVER ({over})"
    return f"CASE WHEN abs({hi} - {lo}) <= 1e-8 + 1e-5 * abs({hi}) THEN 0.0::DOUBLE ELSE ({x} - {lo}) / ({hi} - {lo}) END"


_AUC = """SELECT {keys}, CASE WHEN sum(p) * sum(n) = 0 THEN NULL ELSE sum(p * (before + n / 2.0))::DOUBLE / (sum(p) * sum(n)) END AS auc, sum(p) AS positives, sum(n) AS negatives
  FROM (SELECT *, sum(n) OVER (PARTITION BY {keys} ORDER BY score) - n AS before FROM (SELECT {keys}, score, count(*) FILTER (label = 1) AS p, count(*) FILTER (label <> 1) AS n FROM {rows} GROUP BY ALL)) GROUP BY {keys}"""


@query(f"WITH {_FEATURES}, {_LONG}, l AS (SELECT *, toxic AS label FROM long), a AS ({_AUC.format(keys='method', rows='l')}) SELECT method, round(auc, 6) AS auc, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives FROM a")
def roc_auc_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.roc_auc(long_scores(spark, sf_dir), ["method"]).withColumn("auc", rounded(F.col("auc")))


@query(f"""WITH {_FEATURES}, {_LONG}, g AS (SELECT method, score, count(*) FILTER (toxic = 1) AS p, count(*) FILTER (toxic <> 1) AS n FROM long GROUP BY ALL),
c AS (SELECT *, sum(p) OVER w AS cp, sum(n) OVER w AS cn FROM g WINDOW w AS (PARTITION BY method ORDER BY score DESC))
SELECT method, round(sum(p * cp::DOUBLE / (cp + cn)) / sum(p), 6) AS average_precision FROM c GROUP BY method""")
def average_precision_by_method(spark: SparkSession, sf_dir: str) -> DataFrame:
    return metrics.average_precision(long_scores(spark, sf_dir), ["method"]).withColumn("average_precision", rounded(F.col("average_precision")))


_CONFUSION = """SELECT {keys}, tp, fp, tn, fn, round((tp + tn)::DOUBLE / (tp + fp + tn + fn), 6) AS accuracy, round(CASE WHEN tp + fp = 0 THEN 0 ELSE tp::DOUBLE / (tp + fp) END, 6) AS precision,
  round(CASE WHEN tp + fn = 0 THEN 0 ELSE tp::DOUBLE / (tp + fn) END, 6) AS recall, round(CASE WHEN 2 * tp + fp + fn = 0 THEN 0 ELSE 2.0 * tp / (2 * tp + fp + fn) END, 6) AS f1,
  round(list_avg(list_filter([CASE WHEN tp + fn > 0 THEN tp::DOUBLE / (tp + fn) END, CASE WHEN tn + fp > 0 THEN tn::DOUBLE / (tn + fp) END], lambda x: x IS NOT NULL)), 6) AS balanced_accuracy
FROM (SELECT {keys}, count(*) FILTER (predicted = 1 AND label = 1) AS tp, count(*) FILTER (predicted = 1 AND label = 0) AS fp, count(*) FILTER (predicted = 0 AND label = 0) AS tn, count(*) FILTER (predicted = 0 AND label = 1) AS fn FROM {rows} GROUP BY {keys})"""


def _rounded_all(df: DataFrame, *skip: str) -> DataFrame:
    return df.select(*(rounded(F.col(c)).alias(c) if t == "double" and c not in skip else F.col(c) for c, t in df.dtypes))


@query(f"WITH {_FEATURES}, {_LONG}, p AS (SELECT method, toxic AS label, CASE WHEN {_mm('score', 'PARTITION BY method')} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM long) {_CONFUSION.format(keys='method', rows='p')}")
def confusion_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded_all(metrics.confusion(fusion.predicted(long_scores(spark, sf_dir), ["method"]), ["method"]))


@query(f"WITH {_FEATURES}, {_LONG}, s AS (SELECT method, raw_score, score, {_mm('score', 'PARTITION BY method')} AS scaled FROM long) SELECT method, round(avg(abs(score - raw_score)), 6) AS mae, round(sqrt(avg((score - raw_score) ** 2)), 6) AS rmse, round(avg(abs(scaled - raw_score / 10)), 6) AS mae_scaled, round(sqrt(avg((scaled - raw_score / 10) ** 2)), 6) AS rmse_scaled FROM s GROUP BY method")
def regression_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Errors of raw scores, and of scaled ones against a tenth of the target."""
    s = metrics.minmax(long_scores(spark, sf_dir), ["method"], "score", "scaled").withColumn("target", F.col("raw_score") / 10)
    raw, scaled = metrics.errors(s, ["method"], "score", "raw_score"), metrics.errors(s, ["method"], "scaled", "target")
    return _rounded_all(raw.join(scaled.select("method", F.col("mae").alias("mae_scaled"), F.col("rmse").alias("rmse_scaled")), "method"))


_CORR = """(CASE WHEN count(*) * sum({x} * {x}) - sum({x}) ** 2 <= 1e-12 * count(*) * sum({x} * {x}) OR count(*) * sum({y} * {y}) - sum({y}) ** 2 <= 1e-12 * count(*) * sum({y} * {y}) THEN NULL
  ELSE (count(*) * sum({x} * {y}) - sum({x}) * sum({y})) / (sqrt(count(*) * sum({x} * {x}) - sum({x}) ** 2) * sqrt(count(*) * sum({y} * {y}) - sum({y}) ** 2)) END)"""


@query(f"""WITH {_FEATURES}, {_LONG}, r AS (SELECT method, score, raw_score, toxic::DOUBLE AS y,
  rank() OVER (PARTITION BY method ORDER BY score) + (count(*) OVER (PARTITION BY method, score) - 1) / 2.0::DOUBLE AS rs, rank() OVER (PARTITION BY method ORDER BY raw_score) + (count(*) OVER (PARTITION BY method, raw_score) - 1) / 2.0::DOUBLE AS rr FROM long)
SELECT method AS feature, round({_CORR.format(x='score', y='raw_score')}, 6) AS pearson, round({_CORR.format(x='rs', y='rr')}, 6) AS spearman, round({_CORR.format(x='score', y='y')}, 6) AS pearson_label FROM r GROUP BY method""")
def feature_correlation(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = long_scores(spark, sf_dir)
    with_raw = metrics.correlations(s, ["method"], "score", "raw_score")
    with_label = s.groupBy("method").agg(metrics.pearson_of(F.col("score"), F.col("toxic").cast("double")).alias("pearson_label"))
    return _rounded_all(with_raw.join(with_label, "method").withColumnRenamed("method", "feature"))


_BY_LANG = f"WITH {_FEATURES}, {_LONG}, l AS (SELECT *, toxic AS label FROM long), a AS ({_AUC.format(keys='lang, method', rows='l')})"


@query(f"{_BY_LANG} SELECT method, round(avg(auc), 6) AS auc_mean, round(stddev_pop(auc), 6) AS auc_std, count(*) AS runs FROM a GROUP BY method")
def metric_mean_std(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and spread of the AUC over languages; undefined ones are left out."""
    return _rounded_all(metrics.mean_std(metrics.roc_auc(long_scores(spark, sf_dir), ["lang", "method"]), ["method"], ["auc"]))


# --- fusion, direction, sweeps ------------------------------------------------------------------

_FUSED = f"fu AS (SELECT *, 0.45 * {_mm('dp')} + 0.45 * {_mm('kg')} + 0.1 * {_mm('bm25')} AS fused, greatest({_mm('dp')}, {_mm('kg')}, {_mm('bm25')}) AS largest, 0.45 * dp + 0.45 * kg + 0.1 * bm25 AS unscaled FROM sc)"


@query(f"WITH {_FEATURES}, {_FUSED} SELECT doc_id, round(fused, 6) AS fused, round(unscaled, 6) AS unscaled FROM fu")
def minmax_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The pair fusion, on scaled scores and on scores as they are."""
    f = fusion.fuse(fusion.fuse(light_features(spark, sf_dir), fusion.PAIR_WEIGHTS, "fused"), fusion.PAIR_WEIGHTS, "unscaled", scale=False)
    return f.select("doc_id", rounded(F.col("fused")).alias("fused"), rounded(F.col("unscaled")).alias("unscaled"))


@query(f"WITH {_FEATURES}, {_FUSED} SELECT doc_id, round(largest, 6) AS largest FROM fu")
def max_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.largest(light_features(spark, sf_dir), ["dp", "kg", "bm25"], "largest").select("doc_id", rounded(F.col("largest")).alias("largest"))


@query(f"WITH {_FEATURES}, f AS (SELECT doc_id, 0.35 * {_mm('jaccard')} + 0.25 * {_mm('bm25')} + 0.2 * {_mm('embedding')} + 0.2 * {_mm('kg')} AS rag, 0.55 * {_mm('dp')} + 0.45 * {_mm('kg')} AS retrieval_dp FROM sc) SELECT doc_id, round(rag, 6) AS rag, round(retrieval_dp, 6) AS retrieval_dp FROM f")
def retrieval_fusion(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two fusions of full retrieval; token overlap stands in for TF-IDF."""
    f = fusion.scaled_all(light_features(spark, sf_dir).withColumn("tfidf", F.col("jaccard")), ["tfidf", "bm25", "embedding", "kg", "dp"])
    return f.select("doc_id", rounded(fusion.weighted_sum(fusion.RAG_WEIGHTS, "_scaled")).alias("rag"), rounded(fusion.weighted_sum(fusion.RETRIEVAL_DP_WEIGHTS, "_scaled")).alias("retrieval_dp"))


@query(f"WITH {_FEATURES}, {_LONG}, l AS (SELECT *, toxic AS label FROM long), a AS ({_AUC.format(keys='method', rows='l')}) SELECT method, round(auc, 6) AS auc, round(1 - auc, 6) AS auc_negated, CASE WHEN auc < 0.5 THEN -1 ELSE 1 END AS direction FROM a")
def orient_in_sample(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The direction audit on all labels: an AUC of 0.5 at least by construction."""
    return _rounded_all(fusion.directions(long_scores(spark, sf_dir), ["method"]))


_FOLD = "SELECT *, (row_number() OVER (PARTITION BY {label} ORDER BY md5('3407|' || doc_id), doc_id) - 1) % 5 AS fold FROM {rows}"
_BY_TRAIN = f"""fd AS MATERIALIZED ({_FOLD.format(label='toxic', rows='sc')}),
fl AS MATERIALIZED ({' UNION ALL '.join(f"SELECT doc_id, toxic, fold, '{m}' AS method, {m} AS score FROM fd" for m in METHODS)}),
tr AS (SELECT k.fold, l.method, l.score, l.toxic AS label FROM fl l JOIN (SELECT DISTINCT fold FROM fd) k ON l.fold <> k.fold),
au AS ({_AUC.format(keys='fold, method', rows='tr')}),
ot AS (SELECT l.fold, l.method, l.toxic AS label, l.score * CASE WHEN au.auc < 0.5 THEN -1 ELSE 1 END AS score FROM fl l JOIN au USING (fold, method)),
ev AS ({_AUC.format(keys='fold, method', rows='ot')})"""


def folded(df: DataFrame, row_id: str, label: str) -> DataFrame:
    from matchloom.operators.splits import stratified_folds

    return stratified_folds(df, row_id, label, 5, [3407]).drop("seed")


def oriented_by_train(features: DataFrame) -> DataFrame:
    """``fold, method, label, score``: test scores of each fold, turned by the direction on its training part."""
    held = folded(features, "doc_id", "toxic")
    scores = fusion.to_long(held, ["doc_id", "toxic", "fold"], METHODS).withColumn("label", F.col("toxic"))
    # Each row trains the folds that it isn't in.
    train = scores.withColumn("own", F.col("fold")).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(4)))).where("fold <> own")
    return fusion.oriented(scores, fusion.directions(train, ["fold", "method"]), ["fold", "method"])


@query(f"WITH {_FEATURES}, {_BY_TRAIN} SELECT CAST(fold AS INTEGER) AS fold, method, round(auc, 6) AS auc FROM ev")
def orient_by_train(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five folds; every method's direction is learned on the other four."""
    return _rounded_all(metrics.roc_auc(oriented_by_train(light_features(spark, sf_dir)), ["fold", "method"]).select("fold", "method", "auc"))


_SWEEP = """tl AS (SELECT method, threshold, score, CAST(raw_score >= threshold AS INTEGER) AS label FROM long, (VALUES (1.0::DOUBLE), (2.0), (4.0)) t(threshold))"""


@query(f"""WITH {_FEATURES}, {_LONG}, {_SWEEP}, a AS ({_AUC.format(keys='threshold, method', rows='tl')}),
p AS (SELECT threshold, method, label, CASE WHEN {_mm('score', 'PARTITION BY threshold, method')} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM tl), c AS ({_CONFUSION.format(keys='threshold, method', rows='p')})
SELECT threshold, method, round(auc, 6) AS auc, f1, accuracy, CAST(positives AS BIGINT) AS positives, CAST(negatives AS BIGINT) AS negatives FROM a JOIN c USING (threshold, method)""")
def threshold_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labels by three thresholds of the raw score: one job, the threshold is a column."""
    s = long_scores(spark, sf_dir).withColumn("threshold", F.explode(F.array(F.lit(1.0), F.lit(2.0), F.lit(4.0))))
    s = s.withColumn("label", fusion.label_of(F.col("raw_score"), F.col("threshold")))
    keys = ["threshold", "method"]
    found = metrics.roc_auc(s, keys).join(metrics.confusion(fusion.predicted(s, keys), keys).select(*keys, "f1", "accuracy"), keys)
    return _rounded_all(found, "threshold")


_ABLATION = f"""ab AS (
  SELECT doc_id, toxic, 0.45 * {_mm('dp')} + 0.45 * {_mm('kg')} + 0.1 * {_mm('bm25')} AS full, 0.45 * {_mm('embedding')} + 0.45 * {_mm('kg')} + 0.1 * {_mm('bm25')} AS without_dp, {_mm('dp')} AS without_knowledge,
    greatest({_mm('dp')}, {_mm('kg')}, {_mm('bm25')}) AS without_ranking_fusion, bm25 AS retrieval_only FROM sc),
al AS (SELECT setting, round(score, 9) AS score, toxic AS label FROM (UNPIVOT ab ON "full", without_dp, without_knowledge, without_ranking_fusion, retrieval_only INTO NAME setting VALUE score)),
aa2 AS ({_AUC.format(keys='setting', rows='al')})"""


@query(f"WITH {_FEATURES}, {_ABLATION} SELECT setting, round(auc, 6) AS auc FROM aa2")
def ablation_sweep(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The fusion with each of its parts left out or replaced."""
    f = fusion.scaled_all(light_features(spark, sf_dir), ["dp", "kg", "bm25", "embedding"])
    f = f.select("doc_id", "toxic", fusion.weighted_sum(fusion.PAIR_WEIGHTS, "_scaled").alias("full"), fusion.weighted_sum({"embedding": 0.45, "kg": 0.45, "bm25": 0.10}, "_scaled").alias("without_dp"),
                 F.col("dp_scaled").alias("without_knowledge"), F.greatest("dp_scaled", "kg_scaled", "bm25_scaled").alias("without_ranking_fusion"), F.col("bm25").alias("retrieval_only"))
    names = ["full", "without_dp", "without_knowledge", "without_ranking_fusion", "retrieval_only"]
    long = fusion.to_long(f, ["doc_id", "toxic"], names, "setting").withColumn("score", F.round("score", 9))
    return _rounded_all(metrics.roc_auc(long, ["setting"], "score", "toxic").select("setting", "auc"))


@query(f"WITH {PAIRS}, s AS (SELECT doc_id, quality, round({jac(tset('text'), tset('jd'))}, 9) AS score FROM lp), l AS (SELECT 'jaccard' AS method, score, quality AS label FROM s), a AS ({_AUC.format(keys='method', rows='l')}), p AS (SELECT 'jaccard' AS method, quality AS label, CASE WHEN {_mm('score')} >= 0.5 THEN 1 ELSE 0 END AS predicted FROM s), c AS ({_CONFUSION.format(keys='method', rows='p')}) SELECT c.*, round(auc, 6) AS auc FROM c JOIN a USING (method)")
def match_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """From text to metrics in one plan: token overlap of labelled documents and their items, scaled, cut, and judged."""
    items = table(spark, sf_dir, "benchmark").select("item_id", T.token_set(F.col("text")).alias("b"))
    docs = table(spark, sf_dir, "documents").select("doc_id", "text").join(table(spark, sf_dir, "labels").select("doc_id", F.col("quality").alias("label")), "doc_id")
    p = own_items(spark, sf_dir, docs.select("doc_id", "label", T.token_set(F.col("text")).alias("a")), items)
    s = stored(p.select("doc_id", "label", F.lit("jaccard").alias("method"), F.round(T.jaccard(F.col("a"), F.col("b")), 9).alias("score")), "scores")
    found = metrics.confusion(fusion.predicted(s, ["method"]), ["method"]).join(metrics.roc_auc(s, ["method"]).select("method", "auc"), "method")
    return _rounded_all(found)
