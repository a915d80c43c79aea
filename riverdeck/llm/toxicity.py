"""Toxicity: maximum-scoring segments of token log-odds, aggregated by extreme-value statistics.

Tokens are words (A-Z lower-cased; letters, digits, non-ASCII) and, as further features, their beginnings of four to eight characters.
The log-odds of a feature between toxic and clean training documents has a Dirichlet prior in proportion to its
frequency in both; features whose z-score passes ``z_min`` and whose log-odds pass ``odds_min`` score their log-odds, every other token scores
``background``.  In each document all maximal scoring segments are found in one linear scan.  With
the constants lambda and K of the extreme-value distribution that the best segments of clean training documents follow, a segment of score S in n tokens has
the expected count E = K n exp(-lambda S); segments with E below ``e_max`` are significant, and the evidence of a document is their
summed normalised score less ln(K n), in which a toxic word counts once a document.  A logistic curve of the evidence, fitted on the training sample, is the score.

Learning uses at most ``sample`` labelled documents (the first by a hash of the id), exact copies once; every feature of theirs that passes both
thresholds is kept.  A z-score of 3 takes some nine toxic documents, so there are at most a ninth as many features as different words in all toxic documents
of the sample.  Every document is scored whole.

Defined cases: a null or empty text has no tokens and gets the score of no evidence; repeated rows are scored alike; without
toxic or clean training documents the score is 0 throughout; an empty table gives an empty result; extra columns are carried and never
read, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import math
from collections import Counter
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F, types as T

from .common import add_columns, alnum_words, cut, labelled_sample, texts

FIELDS = [
    T.StructField("n_tokens", T.LongType()),
    T.StructField("max_segment", T.DoubleType()),
    T.StructField("evidence", T.DoubleType()),
    T.StructField("segments", T.ArrayType(T.LongType())),
    T.StructField("score", T.DoubleType()),
]


@dataclass(frozen=True)
class ToxicityParams:
    """sample: most labelled documents learnt from (bounds what is broadcast)."""

    sample: int = 32768
    z_min: float = 3.0
    odds_min: float = 2.0
    prior: float = 200.0
    background: float = -0.7
    e_max: float = 0.05


@dataclass(frozen=True)
class ToxicityModel:
    params: ToxicityParams
    features: dict[bytes, float] = field(repr=False)
    lam: float = 1.0
    k: float = 0.1
    slope: float = 0.0
    bias: float = -50.0


def features_of(word: bytes) -> list[bytes]:
    """The word, and its beginnings of four to eight characters if it is longer, marked by a sign that no word has."""
    text = word.decode("utf-8", "replace")
    return [word, *(f"{text[:k]}*".encode() for k in range(4, min(9, len(text))))]


def segments(scores: np.ndarray) -> list[tuple[int, int, float]]:
    """All maximal scoring segments (start, end, score) in one scan; only runs of positive scores enter the list of candidates."""
    total = np.cumsum(scores)
    found: list[tuple[int, int, float, float, int]] = []  # start, end, sum before, sum at end, nearest earlier with a smaller sum before
    for i in np.flatnonzero(scores > 0).tolist():
        start, end, left, right = i, i + 1, float(total[i] - scores[i]), float(total[i])
        while True:
            j = len(found) - 1
            while j >= 0 and found[j][2] >= left:
                j = found[j][4]
            if j < 0 or found[j][3] >= right:
                found.append((start, end, left, right, j))
                break
            start, left = found[j][0], found[j][2]
            del found[j:]
    return [(a, b, r - l) for a, b, l, r, _ in found]


class _Scores(dict):
    """Scores of words, worked out when first seen."""

    def __init__(self, model: ToxicityModel):
        super().__init__()
        self.features, self.rest = model.features, model.params.background

    def __missing__(self, word: bytes) -> float:
        found = [self.features[f] for f in features_of(word) if f in self.features]
        self[word] = s = max(found) if found else self.rest
        return s


def _measure(model: ToxicityModel, cache: _Scores, text: bytes) -> tuple[int, float, float, list[int]]:
    words = alnum_words(text)
    n = len(words)
    size = math.log(max(model.k * max(n, 1), 1e-9))
    if not n:
        return 0, 0.0, -size, []
    scores = np.fromiter(map(cache.__getitem__, words), np.float64, n)
    found = segments(scores)
    limit = (size - math.log(model.params.e_max)) / model.lam
    good = [(a, b, s) for a, b, s in found if s >= limit]
    # Repeats make segments but no further evidence: a toxic word counts where it first stands in a significant segment.
    seen, total = set(), 0.0
    for a, b, s in good:
        for i in (a + np.flatnonzero(scores[a:b] > 0)).tolist():
            if words[i] in seen:
                s -= scores[i]
            seen.add(words[i])
        total += max(0.0, float(s))
    return n, max((s for *_, s in found), default=0.0), model.lam * total - size, [x for a, b, _ in good for x in (a, b)]


def _select(counts: DataFrame, n1: float, n0: float, p: ToxicityParams) -> DataFrame:
    """(feature, odds) of the features whose log-odds and z-score under the Dirichlet prior pass the thresholds."""
    y1, y0 = F.col("y1"), F.col("y0")
    a = F.lit(p.prior) * (y1 + y0) / F.lit(n1 + n0)
    ratio = lambda y, n: F.log(F.try_divide(y + a, F.lit(n + p.prior) - y - a))
    odds = ratio(y1, n1) - ratio(y0, n0)
    z = F.col("odds") / F.sqrt(1 / (y1 + a) + 1 / (y0 + a))
    # A feature of every document tells nothing: its odds are null, and it goes.
    return counts.where("feature is not null").withColumn("odds", odds).where((F.col("odds") >= p.odds_min) & (z >= p.z_min)).select("feature", "odds")


def extreme_value(n: np.ndarray, best: np.ndarray, least: float) -> tuple[float, float]:
    """lambda and K by maximum likelihood, if the best segment of n tokens is below x with the chance exp(-K n exp(-lambda x)).

    A best score below ``least``, the smallest that a segment can have, says only that there is none.  For each lambda the best K is known in closed
    form; lambda is found on a grid between 0.02 and 20, finer than one percent.
    """
    if not len(n):
        return 1.0, 0.1
    there = best >= least
    at = np.where(there, best, least)
    found, total = max(1, int(there.sum())), float(best[there].sum())
    likely = []
    for lam in np.exp(np.linspace(math.log(0.02), math.log(20), 800)):
        k = found / float((n * np.exp(-lam * at)).sum())
        likely.append((found * math.log(k * lam) - lam * total, lam, k))
    _, lam, k = max(likely)
    return float(lam), float(min(1.0, max(k, 1e-9)))


def _logistic(x: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """Slope and bias by Newton's method with a light penalty."""
    center, spread = x.mean(), x.std() + 1e-9
    design = np.stack([(x - center) / spread, np.ones(len(x))], 1)
    w = np.zeros(2)
    for _ in range(50):
        p = 1 / (1 + np.exp(-np.clip(design @ w, -30, 30)))
        gradient = design.T @ (p - y) + 0.01 * w
        hessian = (design * (p * (1 - p))[:, None]).T @ design + 0.01 * np.eye(2)
        step = np.linalg.solve(hessian, gradient)
        w -= step
        if np.abs(step).max() < 1e-9:
            break
    return float(w[0] / spread), float(w[1] - w[0] * center / spread)


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, train: Column | None = None, params: ToxicityParams = ToxicityParams()) -> ToxicityModel:
    """Learn from labelled documents where ``train`` (a condition on doc_id) holds."""
    sample = F.broadcast(labelled_sample(spark, labels, "toxic", params.sample, train))
    found = docs.select("doc_id", "text").join(sample, "doc_id").select("text", "label", F.monotonically_increasing_id().alias("row"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("same"))
    found = cut(found, "toxicity-sample")
    keep = cut(found.groupBy("same", "label").agg(F.min("row").alias("row")).select("row"), "toxicity-rows")
    # One row for a labelled document, unless documents share ids: broadcast if that holds, so that no text is shuffled.
    keep = F.broadcast(keep) if keep.count() <= params.sample else keep
    rows = found.join(keep, "row", "left_semi").select("text", "label")

    def count(batches):
        toxic, clean, docs_, tokens = Counter(), Counter(), [0, 0], 0
        parts: dict[bytes, list[bytes]] = {}
        for batch in batches:
            for text, label in zip(texts(batch), batch.column(1).to_pylist()):
                seen = set(alnum_words(text))
                found = set()
                for w in seen:
                    if (f := parts.get(w)) is None:
                        f = parts[w] = features_of(w)
                    found.update(f)
                (toxic if label == 1 else clean).update(found)
                docs_[label == 1] += 1
            if len(parts) > 1 << 19:
                parts.clear()
        keys = [*toxic.keys(), *(x for x in clean if x not in toxic)]
        # Two rows without feature: the numbers of documents.
        yield pa.RecordBatch.from_arrays([pa.array([None, *keys], pa.binary()), pa.array([docs_[1], *(toxic[x] for x in keys)], pa.int64()), pa.array([docs_[0], *(clean[x] for x in keys)], pa.int64())], names=["feature", "toxic", "clean"])

    counts = rows.mapInArrow(count, "feature binary, toxic long, clean long").groupBy("feature").agg(F.sum("toxic").alias("y1"), F.sum("clean").alias("y0"))
    counts = cut(counts, "toxicity-counts")
    sizes = counts.where("feature is null").first()
    n1, n0 = (float(sizes[1]), float(sizes[2])) if sizes else (0.0, 0.0)
    if not n1 or not n0:
        return ToxicityModel(params, {})
    model = ToxicityModel(params, {bytes(f): x for f, x in _select(counts, n1, n0, params).sort("feature").toLocalIterator()})

    best = score(rows, model).select("label", "n_tokens", "max_segment").where("label = 0 and n_tokens > 0").collect()  # ``sample`` rows at most
    lam, k = extreme_value(np.array([x[1] for x in best], float), np.array([x[2] for x in best], float), min(model.features.values(), default=params.odds_min))
    model = ToxicityModel(params, model.features, lam, k)
    measured = score(rows, model).select("label", "evidence").collect()
    slope, bias = _logistic(np.array([x[1] for x in measured]), np.array([x[0] for x in measured], float))
    return ToxicityModel(params, model.features, model.lam, model.k, slope, bias)


def score(docs: DataFrame, model: ToxicityModel, text: str = "text") -> DataFrame:
    """``docs`` with the tokens, best segment, evidence, significant segments (start and end token, in turns) and score of every row."""
    shared = docs.sparkSession.sparkContext.broadcast(model)  # bounded by the labelled sample, see above

    def make():
        m = shared.value
        state = [_Scores(m)]

        def work(batch):
            if len(state[0]) > 1 << 19:
                state[0] = _Scores(m)
            rows = [_measure(m, state[0], t) for t in texts(batch, text)]
            cols = [list(x) for x in zip(*rows)]
            x = np.array(cols[2])
            return [*cols[:2], np.round(x, 9), cols[3], np.round(1 / (1 + np.exp(-np.clip(m.slope * x + m.bias, -30, 30))), 9)]

        return work

    return add_columns(docs, make, FIELDS, text)
