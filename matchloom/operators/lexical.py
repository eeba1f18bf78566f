"""TF-IDF and BM25 as posting tables: one row for each (document, term), terms as 64-bit hashes.

Hashed terms are counted where a document lies, without an exchange. Counts are written, so texts are
cut into terms once. Only pairs that share a term are ever joined, and the terms that many documents have meet
their postings in a broadcast: no key gathers a share of all documents in one task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from matchloom.functions.text import tokenize
from matchloom.operators.postings import lists
from matchloom.operators.storage import stored

#: Fixed value: what a word is, for TF-IDF.
WORD = r"[\p{L}\p{N}_]{2,}"
#: Fixed value: English stop words.
STOP_WORDS = ("about above after again all also am an and any are as at be because been before being below between both but by can could did do does doing down during "
              "each few for from further had has have having he her here hers him his how if in into is it its just me more most my no nor not now of off on once only or "
              "other our out over own same she should so some such than that the their them then there these they this those through to too under until up very was we were "
              "what when where which while who whom why will with would you your").split()

K1, B = 1.5, 0.75
#: A term is hot if more than one document in so many has it; there are at most so many times a document's terms of them.
HOT = 64
#: Documents whose terms a worker counts at once.
ROWS_AT_ONCE = 256


def words(text: Column, stop_words: list[str] | None = None) -> Column:
    """Words that aren't stop words; ``stop_words`` is another list than the one above (a library's, say)."""
    found = F.regexp_extract_all(F.lower(F.coalesce(text, F.lit(""))), F.lit(WORD), F.lit(0))
    return F.filter(found, lambda w: ~w.isin(STOP_WORDS if stop_words is None else stop_words))


def with_terms(docs: DataFrame, text: str = "text", out: str = "_t", stop_words: list[str] | None = None) -> DataFrame:
    """``docs`` with all unigrams and bigrams of a text: words that aren't stop words, and each two that follow each other without them.

    The lambda names no column: an expression from outside would be worked out once for each element wherever the optimizer
    puts it in place of its name.
    """
    w = F.col("_w")
    bigrams = F.array_compact(F.zip_with(w, F.slice(w, 2, F.greatest(F.size(w), F.lit(1))), lambda a, b: F.concat(a, F.lit(" "), b)))
    return docs.withColumn("_w", words(F.col(text), stop_words)).withColumn(out, F.concat(w, bigrams)).drop("_w")


def with_tokens(docs: DataFrame, text: str = "text", out: str = "_t") -> DataFrame:
    return docs.withColumn(out, tokenize(F.col(text)))


def term_counts(docs: DataFrame, keys: list[str], hashed: bool = True) -> DataFrame:
    """``keys, term, tf`` of each document (a row of ``docs``), from its terms in ``_t``.

    Hashed terms are counted where the document lies: neither texts nor terms are shuffled.
    """
    # Of a plain column Spark would first filter by its size, and work the terms out twice.
    terms = F.coalesce("_t", F.array().cast("array<string>"))
    if not hashed:
        own = docs.select(*keys, "_t").repartition(*keys)
        return own.select(*keys, F.explode(terms).alias("term")).groupBy(*keys, "term").agg(F.count("*").alias("tf"))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(0, batch.num_rows, ROWS_AT_ONCE):
                piece = batch.slice(i, ROWS_AT_ONCE)
                tokens, ends = lists(piece, "term")
                row = np.repeat(np.arange(piece.num_rows), np.diff(ends))
                order = np.lexsort((tokens, row))
                t, r = tokens[order], row[order]
                new = np.ones(len(t), dtype=bool)
                new[1:] = (t[1:] != t[:-1]) | (r[1:] != r[:-1])
                first = np.flatnonzero(new)
                held = pa.array(r[first])
                yield pa.RecordBatch.from_arrays([*(piece.column(k).take(held) for k in keys), pa.array(t[first]), pa.array(np.diff(np.append(first, len(t))))], names=[*keys, "term", "tf"])

    own = docs.select(*keys, F.transform(terms, lambda t: F.xxhash64(t)).alias("term"))
    kinds = dict(own.dtypes)
    return own.mapInArrow(counted, ", ".join([*(f"`{k}` {kinds[k]}" for k in keys), "term long", "tf long"]))


def idf_weights(counts: DataFrame, keys: list[str], n_docs: Column | int) -> DataFrame:
    """``counts`` (a stored table) with ``w = tf * (ln((1 + N) / (1 + df)) + 1)``."""
    n = n_docs if isinstance(n_docs, Column) else F.lit(float(n_docs))
    df = stored(counts.groupBy("term").agg(F.count("*").alias("df")), "document_frequencies")
    hot = F.broadcast(df.where(F.col("df") * HOT > n).select("term", F.col("df").alias("_hot")))
    known = counts.join(hot, "term", "left")
    common = known.where("_hot is not null").withColumnRenamed("_hot", "df")
    rare = known.where("_hot is null").drop("_hot").join(df.where(F.col("df") * HOT <= n), "term")
    weight = F.col("tf") * (F.ln((1.0 + n) / (1.0 + F.col("df"))) + 1.0)
    return common.select(*keys, "term", weight.alias("w")).unionByName(rare.select(*keys, "term", weight.alias("w")))


def vocabulary(counts: DataFrame, k: int) -> DataFrame:
    """The ``k`` terms with the largest counts in the corpus, ties by term: ``term, tf``. Spark keeps ``k`` a task and merges."""
    return counts.groupBy("term").agg(F.sum("tf").alias("tf")).orderBy(F.desc("tf"), "term").limit(k)


def tfidf_pairs(left: DataFrame, right: DataFrame, pairs: DataFrame, cap: int | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """TF-IDF cosine of the texts of each pair; the corpus is all of ``left`` and ``right``.

    ``left`` is ``l, text``, ``right`` is ``r, text`` and ``pairs`` is ``l, r`` with one ``r`` for each ``l``. Returns ``l, r, tfidf``: 0 for a pair
    without a common term. ``stop_words`` replaces the own list. Each posting of a left text meets its right text's postings once, and norm and
    product are summed in the same aggregation. ``cap`` keeps the commonest terms only.
    """
    corpus = left.join(pairs, "l", "left").select(F.lit(0).alias("side"), F.col("l").alias("id"), F.col("r").alias("mate"), "text") \
        .unionByName(right.select(F.lit(1).alias("side"), F.col("r").alias("id"), F.col("r").alias("mate"), "text"))
    n = left.count() + right.count()
    counts = stored(term_counts(with_terms(corpus, stop_words=stop_words), ["side", "id", "mate"], hashed=cap is None), "term_counts")
    if cap is not None:
        counts = counts.join(F.broadcast(vocabulary(counts, cap).select("term")), "term", "left_semi")  # cap rows
    weights = idf_weights(counts, ["side", "id", "mate"], n)
    theirs = weights.where("side = 1").select("mate", "term", F.col("w").alias("wr"))
    products = weights.where("side = 0").join(theirs, ["mate", "term"], "left").groupBy("mate", F.col("id").alias("l")).agg(
        F.sum(F.col("w") * F.coalesce("wr", F.lit(0.0))).alias("dot"), F.sum(F.col("w") * F.col("w")).alias("ll"))
    norms = weights.where("side = 1").groupBy(F.col("id").alias("r")).agg(F.sum(F.col("w") * F.col("w")).alias("rr"))
    found = products.withColumnRenamed("mate", "r").join(norms, "r").select("l", "r", F.coalesce(F.try_divide(F.col("dot"), F.sqrt("ll") * F.sqrt("rr")), F.lit(0.0)).alias("tfidf"))
    return pairs.select("l", "r").join(found, ["l", "r"], "left").select("l", "r", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def tfidf_scores(left: DataFrame, right: DataFrame, pairs: DataFrame, cap: int | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """As ``tfidf_pairs``, for any distinct pairs: an ``l`` may meet many ``r``. The weights are the same."""
    corpus = left.select(F.lit(0).alias("side"), F.col("l").alias("id"), "text").unionByName(right.select(F.lit(1).alias("side"), F.col("r").alias("id"), "text"))
    n = left.count() + right.count()
    counts = stored(term_counts(with_terms(corpus, stop_words=stop_words), ["side", "id"], hashed=cap is None), "term_counts")
    if cap is not None:
        counts = counts.join(F.broadcast(vocabulary(counts, cap).select("term")), "term", "left_semi")  # cap rows
    weights = idf_weights(counts, ["side", "id"], n)
    side = lambda i, key: weights.where(F.col("side") == i).select(F.col("id").alias(key), "term", F.col("w").alias(f"w{key}"))
    length = lambda i, key: side(i, key).groupBy(key).agg(F.sqrt(F.sum(F.col(f"w{key}") * F.col(f"w{key}"))).alias(f"n{key}"))
    dots = pairs.select("l", "r").join(side(0, "l"), "l").join(side(1, "r"), ["r", "term"]).groupBy("l", "r").agg(F.sum(F.col("wl") * F.col("wr")).alias("dot"))
    found = dots.join(length(0, "l"), "l").join(length(1, "r"), "r").select("l", "r", F.coalesce(F.try_divide(F.col("dot"), F.col("nl") * F.col("nr")), F.lit(0.0)).alias("tfidf"))
    return pairs.select("l", "r").join(found, ["l", "r"], "left").select("l", "r", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def tfidf_scoped(rows: DataFrame, scope: list[str], cap: int | None = None, stop_words: list[str] | None = None) -> DataFrame:
    """``scope, id, tfidf``: TF-IDF cosine of each scope's one query text with its candidates, from a corpus of that scope alone.

    ``rows`` is ``scope, side, id, text``, side 0 the query and 1 a candidate. 0 where they share no term.
    """
    counts = stored(term_counts(with_terms(rows, stop_words=stop_words), [*scope, "side", "id"], hashed=cap is None), "term_counts")
    if cap is not None:
        total = counts.groupBy(*scope, "term").agg(F.sum("tf").alias("tf"))
        counts = counts.join(first_by(total, scope, [F.desc("tf"), F.col("term")], cap).select(*scope, "term"), [*scope, "term"], "left_semi")
    sizes = rows.groupBy(*scope).agg(F.count("*").cast("double").alias("n"))
    df = counts.groupBy(*scope, "term").agg(F.count("*").alias("df")).join(sizes, scope)
    weights = counts.join(df, [*scope, "term"]).withColumn("w", F.col("tf") * (F.ln((1.0 + F.col("n")) / (1.0 + F.col("df"))) + 1.0))
    asked = weights.where("side = 0").select(*scope, "term", F.col("w").alias("wq"))
    length = asked.groupBy(*scope).agg(F.sqrt(F.sum(F.col("wq") * F.col("wq"))).alias("nq"))
    theirs = weights.where("side = 1").join(asked, [*scope, "term"], "left").groupBy(*scope, "id").agg(F.sum(F.col("w") * F.col("wq")).alias("dot"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("nc"))
    found = theirs.join(length, scope).select(*scope, "id", F.coalesce(F.try_divide(F.col("dot"), F.col("nq") * F.col("nc")), F.lit(0.0)).alias("tfidf"))
    ids = rows.where("side = 1").select(*scope, "id")
    return ids.join(found, [*scope, "id"], "left").select(*scope, "id", F.coalesce("tfidf", F.lit(0.0)).alias("tfidf"))


def bm25_index(docs: DataFrame, scope: list[str], doc: str, idf_mode: str = "plus_one") -> tuple[DataFrame, DataFrame]:
    """Postings ``scope, doc, term, tf, weight`` and lengths, for a corpus (column ``text``) in each ``scope``.

    ``plus_one``: idf = ln(1 + (N - df + 0.5) / (df + 0.5)). ``okapi_floor``: idf = ln(N - df + 0.5) - ln(df + 0.5), and a negative one
    becomes a quarter of the mean idf of the scope's terms.
    """
    held = with_tokens(docs)
    lengths = held.select(*scope, doc, F.size("_t").alias("len"))
    stats = lengths.groupBy(*scope).agg(F.count("*").alias("n"), F.avg("len").alias("avgdl"))
    counts = stored(term_counts(held, [*scope, doc]), "term_counts")
    df = counts.groupBy(*scope, "term").agg(F.count("*").cast("double").alias("df"))
    df = df.join(stats, scope) if scope else df.crossJoin(F.broadcast(stats))  # without a scope, one row
    if idf_mode == "plus_one":
        idf = df.withColumn("idf", F.ln(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)))
    elif idf_mode == "okapi_floor":
        raw = df.withColumn("raw", F.ln(F.col("n") - F.col("df") + 0.5) - F.ln(F.col("df") + 0.5))
        means = raw.groupBy(*scope).agg(F.avg("raw").alias("mean"))
        idf = (raw.join(means, scope) if scope else raw.crossJoin(F.broadcast(means))).withColumn("idf", F.when(F.col("raw") < 0, 0.25 * F.col("mean")).otherwise(F.col("raw")))
    else:
        raise ValueError(f"unknown idf mode: {idf_mode}")
    length = F.when(F.col("len") == 0, 1).otherwise(F.col("len"))
    mean_length = F.when(F.col("avgdl") == 0, 1.0).otherwise(F.col("avgdl"))
    denominator = F.col("tf") + K1 * (1 - B + B * length / mean_length)
    postings = counts.join(idf, [*scope, "term"]).join(lengths, [*scope, doc]).withColumn("weight", F.col("idf") * F.col("tf") * (K1 + 1) / denominator)
    return postings.select(*scope, doc, "term", "tf", "weight"), lengths


def bm25_scores(queries: DataFrame, query: str, postings: DataFrame, scope: list[str], doc: str, paired: bool = False) -> DataFrame:
    """``query, scope, doc, bm25`` of pairs that share a term; repeated query tokens count repeatedly.

    ``paired`` queries name the one document that they are scored against in their column ``doc``. Every token meets its
    postings at once, so what is summed, and shuffled, is hits only.
    """
    keys = [*scope, query] + [doc] * paired
    asked = queries.select(*keys, F.explode(tokenize(F.col("text"))).alias("term")).select(*keys, F.xxhash64("term").alias("term"))
    joined = asked.join(postings.select(*scope, doc, "term", "weight"), [*scope, "term"] + [doc] * paired)
    return joined.groupBy(*scope, query, doc).agg(F.sum("weight").alias("bm25"))


def first_by(df: DataFrame, keys: list[str], order: list[Column], k: int, out: str = "rank") -> DataFrame:
    """The first ``k`` rows of each ``keys`` in an order, numbered from 1; Spark cuts groups before it shuffles them."""
    return df.withColumn(out, F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where(F.col(out) <= k)
