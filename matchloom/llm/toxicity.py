"""Toxicity severity by cumulative-link ordinal regression on sparse text features.

P(grade >= k) = sigmoid(w . x - theta_k) for k = 1 .. K: the thresholds theta_1 <= .. <= theta_K share the weights w. The
expected severity is the sum of these probabilities.

Features of a text are its lower-cased words and the openings of its longer words (3 to 8 letters, since compounds carry
their meaning in front), each as log(1 + count), and the logarithm of the text's length.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from matchloom.llm.common import materialize, small_batches

_WORD = re.compile(r"[^\W\d_]+")
_OPENINGS = range(3, 9)
#: Bound of the training sample: about so many labelled rows of each class, those with the smallest hashes.
ROWS_PER_CLASS = 3_000
#: Size of a model: the features that tell the classes apart best. On the sample above far fewer pass the test of significance.
MAX_FEATURES = 20_000


def word_features(word: str) -> list[str]:
    """The word itself, and its openings if it goes on after them (marked by a hyphen)."""
    return [word] + [word[:n] + "-" for n in _OPENINGS if len(word) > n]


def words(text: str | None) -> list[str]:
    return _WORD.findall((text or "").lower())


@dataclass
class OrdinalModel:
    """``weights`` of features, of log(1 + words) under the empty name, and ascending ``thresholds``."""

    weights: dict[str, float]
    thresholds: list[float]

    def __post_init__(self) -> None:
        self.cache: dict[str, tuple[str, ...]] = {}

    def __getstate__(self) -> dict:
        return {"weights": self.weights, "thresholds": self.thresholds, "cache": {}}

    def _known(self, word: str) -> tuple[str, ...]:
        found = self.cache.get(word)
        if found is None:
            if len(self.cache) >= 150_000:
                self.cache.clear()
            found = self.cache[word] = tuple(f for f in word_features(word) if f in self.weights)
        return found

    def score(self, text: str | None) -> tuple[int, list[float]]:
        """Number of words, and P(grade >= k) for each k."""
        own = words(text)
        counts = Counter(f for w in own for f in self._known(w))
        z = self.weights.get("", 0.0) * math.log1p(len(own)) + sum(self.weights[f] * math.log1p(c) for f, c in sorted(counts.items()))
        return len(own), [1 / (1 + math.exp(min(700.0, t - z))) for t in self.thresholds]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_cumulative_link(row: np.ndarray, col: np.ndarray, value: np.ndarray, grade: np.ndarray, weight: np.ndarray, n_features: int, n_thresholds: int, l2: float = 1e-3, steps: int = 400, rate: float = 0.1) -> tuple[np.ndarray, np.ndarray]:
    """Weights and thresholds that maximise the penalised likelihood, by Adam on the whole (sparse) sample.

    Thresholds are theta_1 and positive gaps, so they stay in order.
    """
    n = len(grade)
    weight = weight / weight.sum()
    share = np.array([max(1e-6, (weight * (grade >= k)).sum()) for k in range(1, n_thresholds + 1)])
    start = -np.log(np.clip(share, 1e-6, 1 - 1e-6) / (1 - np.clip(share, 1e-6, 1 - 1e-6)))
    params = np.concatenate([np.zeros(n_features), start[:1], np.log(np.maximum(1e-2, np.diff(start)))])
    m, v = np.zeros_like(params), np.zeros_like(params)
    for step in range(1, steps + 1):
        w, gaps = params[:n_features], np.exp(params[n_features + 1 :])
        theta = params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])
        z = np.bincount(row, weights=value * w[col], minlength=n)
        # Upper and lower cumulative probabilities of each row's own grade.
        edges = np.concatenate([[np.inf], -theta, [-np.inf]])
        hi, lo = _sigmoid(z + edges[grade]), _sigmoid(z + edges[grade + 1])
        hi, lo = np.where(grade == 0, 1.0, hi), np.where(grade == n_thresholds, 0.0, lo)
        p = np.maximum(hi - lo, 1e-12)
        d_hi, d_lo = hi * (1 - hi) / p * weight, lo * (1 - lo) / p * weight
        g_theta = np.zeros(n_thresholds)
        np.add.at(g_theta, np.maximum(grade - 1, 0), np.where(grade > 0, d_hi, 0.0))
        np.add.at(g_theta, np.minimum(grade, n_thresholds - 1), np.where(grade < n_thresholds, -d_lo, 0.0))
        g_w = np.bincount(col, weights=value * (d_lo - d_hi)[row], minlength=n_features) + l2 * w / 10
        g = np.concatenate([g_w, [g_theta.sum()], g_theta[::-1].cumsum()[::-1][1:] * gaps])
        m, v = 0.9 * m + 0.1 * g, 0.999 * v + 0.001 * g * g
        params = params - rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
    gaps = np.exp(params[n_features + 1 :])
    return params[:n_features], params[n_features] + np.concatenate([[0.0], np.cumsum(gaps)])


def _grade(cues: int) -> int:
    """Severity of a toxic text by its number of cue words: 1, 2 or 3."""
    return 1 if cues <= 2 else 2 if cues <= 5 else 3


def train_toxicity(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic", rows_per_class: int = ROWS_PER_CLASS,
                   max_features: int = MAX_FEATURES) -> OrdinalModel:
    """Fit a model on a bounded sample of labelled rows, weighted back to all of them.

    ``label_col`` above 0 says toxic. Labels of only two values give no severity, so a toxic text's grade is
    the number of its words that carry a cue (a feature far commoner in toxic texts): up to 2, up to 5, more. Labels
    with values above 1 are grades themselves.

    * labels with nulls, and rows whose text is null, teach nothing; a label given twice counts as its larger value, one below 0 as 0;
    * of repeated rows of an id the smallest text teaches, so the sample is bounded whatever repeats;
    * without any toxic or any clean labelled text nothing can be learned: every text gets grade 0.
    """
    small_batches(docs.sparkSession)
    named = labels.select(F.col(id_col).cast("long").alias("doc_id"), F.greatest(F.col(label_col).cast("int"), F.lit(0)).alias("y"), F.col(label_col).alias("given")).dropna().groupBy("doc_id").agg(F.max("y").alias("y"))
    named = named.withColumn("c", (F.col("y") > 0).cast("int"))
    totals = {r["c"]: r["n"] for r in named.groupBy("c").agg(F.count("*").alias("n")).collect()}
    if len(totals) < 2:
        return OrdinalModel({}, [700.0])
    unit = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
    share = F.when(F.col("c") == 1, min(1.0, rows_per_class / totals[1])).otherwise(min(1.0, rows_per_class / totals[0]))
    chosen = named.where(unit < share).withColumn("weight", 1 / share)  # about 2 * rows_per_class rows
    sample = materialize(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).dropna().join(F.broadcast(chosen), "doc_id")
                         .groupBy("doc_id", "c", "y", "weight").agg(F.min("text").alias("text")), "toxicity-sample")
    schema = pa.schema([("doc_id", pa.int64()), ("c", pa.int32()), ("feature", pa.string()), ("n", pa.int32())])

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for doc, c, text in zip(*(x.to_pylist() for x in batch.columns), strict=True):
                counts = Counter(f for w in words(text) for f in word_features(w))
                yield pa.RecordBatch.from_arrays([pa.array([doc] * len(counts), pa.int64()), pa.array([c] * len(counts), pa.int32()), pa.array(list(counts), pa.string()), pa.array(list(counts.values()), pa.int32())], schema=schema)

    entries = sample.select("doc_id", "c", "text").mapInArrow(emit, "doc_id long, c int, feature string, n int")
    in_sample = {r["c"]: r["n"] for r in sample.groupBy("c").agg(F.count("*").alias("n")).collect()}
    n1, n0 = in_sample.get(1, 0), in_sample.get(0, 0)
    if not n1 or not n0:
        return OrdinalModel({}, [700.0])
    # Log-odds of a feature between the classes, over its standard error.
    odds = lambda k, n: F.log((F.col(k) + 0.5) / (float(n) + 0.5 - F.col(k)))
    seen = entries.groupBy("feature").agg(F.sum("c").cast("double").alias("k1"), F.sum(1 - F.col("c")).cast("double").alias("k0")).where("k1 + k0 >= 5")
    z = (odds("k1", n1) - odds("k0", n0)) / F.sqrt(1 / (F.col("k1") + 0.5) + 1 / (F.col("k0") + 0.5))
    picked = [(r["feature"], r["z"], r["k1"], r["k0"]) for r in seen.withColumn("z", z).where(F.abs("z") >= 4).orderBy(F.desc(F.abs("z")), "feature").limit(max_features).collect()]
    index = {f: i + 1 for i, (f, _, _, _) in enumerate(picked)}
    cues = {f for f, score, k1, k0 in picked if score >= 4 and k1 / n1 >= 10 * k0 / n0}
    known = OrdinalModel(dict.fromkeys(index, 0.0), [])
    encoded_schema = pa.schema([("doc_id", pa.int64()), ("y", pa.int32()), ("weight", pa.float64()), ("n_words", pa.int64()), ("cues", pa.int64()), ("at", pa.list_(pa.int32())), ("n", pa.list_(pa.int32()))])

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text in batch.column(3).to_pylist():
                own = words(text)
                counts = Counter(f for w in own for f in known._known(w))
                kept = sorted((index[f], c) for f, c in counts.items())
                out.append((len(own), sum(1 for w in own if any(f in cues for f in known._known(w))), [i for i, _ in kept], [c for _, c in kept]))
            yield pa.RecordBatch.from_arrays([*batch.columns[:3], *(pa.array([r[i] for r in out], encoded_schema.types[3 + i]) for i in range(4))], schema=encoded_schema)

    # The driver gets counts of known features, never texts.
    encoded = sample.select("doc_id", "y", "weight", "text").mapInArrow(encode, "doc_id long, y int, weight double, n_words long, cues long, at array<int>, n array<int>")
    grades, weights, r_, c_, v_ = [], [], [], [], []
    graded = named.agg(F.max("y")).first()[0] > 1
    for i, row in enumerate(sorted(encoded.collect(), key=lambda r: (r["doc_id"], r["n_words"], r["at"], r["n"]))):
        grades.append(row["y"] if graded else _grade(row["cues"]) if row["y"] > 0 else 0)
        weights.append(row["weight"])
        r_ += [i] * (len(row["at"]) + 1)
        c_ += [0, *row["at"]]
        v_ += [math.log1p(row["n_words"]), *map(math.log1p, row["n"])]
    top = max(grades)
    w, theta = fit_cumulative_link(np.array(r_), np.array(c_), np.array(v_), np.array(grades), np.array(weights), len(index) + 1, top)
    return OrdinalModel({"": float(w[0])} | {f: float(w[i]) for f, i in index.items() if abs(w[i]) > 1e-6}, [float(t) for t in theta])


def score_toxicity(docs: DataFrame, model: OrdinalModel, id_col: str = "doc_id", text_col: str = "text", keep: list[str] | None = None) -> DataFrame:
    """Score every whole text: ``doc_id, n_words, p_toxic, severity, grade`` and the columns named in ``keep``.

    ``p_toxic`` is P(grade >= 1), ``severity`` the expected grade, ``grade`` the number of thresholds passed with a
    probability of one half at least. Null and empty texts have no features and get what the thresholds alone say;
    repeated rows and null ids: a row each; empty table: no rows. One pass, no shuffle.
    """
    small_batches(docs.sparkSession)
    keep = keep or []
    source = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("_scored"), *([F.struct(*keep).alias("_kept")] if keep else []))
    fields = [pa.field("n_words", pa.int64()), pa.field("p_toxic", pa.float64()), pa.field("severity", pa.float64()), pa.field("grade", pa.int32())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            scored = [model.score(t) for t in batch.column(1).to_pylist()]
            new = [pa.array([n for n, _ in scored], pa.int64()), pa.array([p[0] for _, p in scored], pa.float64()), pa.array([sum(p) for _, p in scored], pa.float64()), pa.array([sum(x >= 0.5 for x in p) for _, p in scored], pa.int32())]
            old = [batch.column(0), *(batch.column(i) for i in range(2, batch.num_columns))]
            yield pa.RecordBatch.from_arrays([*old, *new], names=["doc_id", *(["_kept"] if keep else []), *(f.name for f in fields)])

    types = dict(source.dtypes)
    ddl = f"doc_id {types['doc_id']}, " + (f"_kept {types['_kept']}, " if keep else "") + "n_words long, p_toxic double, severity double, grade int"
    out = source.mapInArrow(run, ddl)
    return out.select("doc_id", *(F.col("_kept")[k].alias(k) for k in keep), "n_words", "p_toxic", "severity", "grade")


def drop_toxic(docs: DataFrame, model: OrdinalModel, text_col: str = "text", grade: int = 1) -> DataFrame:
    """``docs`` without the rows whose text reaches ``grade`` with a probability of one half; all columns stay, in order.

    Null and empty texts have no features and go or stay as the thresholds alone say; repeated rows and null ids are judged row by row;
    empty table: no rows. One pass, no shuffle; a batch's memory follows its longest text.
    """
    small_batches(docs.sparkSession)
    at = docs.columns.index(text_col)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kept = [sum(x >= 0.5 for x in model.score(t)[1]) < grade for t in batch.column(at).to_pylist()]
            yield batch.filter(pa.array(kept, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)
