"""Quality rules: hashed n-gram log-likelihood ratio between a trusted target and the raw corpus.

Two multinomials over hashed n-gram buckets are estimated: one from all documents (raw), one from
documents labelled good (target; one half of all labelled documents, by a hash of the id).  A
document's score is the mean over its n-grams of ``log(p_target / p_raw)``.  The threshold is set on
the other half, which the target has not seen: the low quantile of the good documents' scores or, where the documents labelled bad score lower still,
half-way down to their high quantile.  So each document gets one deterministic verdict.
N-grams are lower-cased words, pairs of words and pairs of word shapes (letter case, digits and punctuation runs).

Defined cases: a null text has no words and fails the base rule; texts of any length are read
whole; repeated rows are scored alike, one result each; an empty table gives an empty result; a null doc_id stays null;
other columns are carried along and never read, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import functools
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from .common import Numbering, add_columns, cut, mix64, released, slices, texts

FIELDS = [
    *[T.StructField(n, T.LongType()) for n in ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")],
    T.StructField("base_failed", T.BooleanType()),
    T.StructField("llr", T.DoubleType()),
    T.StructField("kept", T.BooleanType()),
]

_SYMBOL = np.zeros(256, bool)
_SYMBOL[list(b"#*$%&|<>")] = True
_SPACE = np.zeros(256, bool)
_SPACE[list(b" \t\n\r\x0b\x0c")] = True
_SHAPE = bytes(97 if 97 <= c <= 122 or c >= 128 else 65 if 65 <= c <= 90 else 48 if 48 <= c <= 57 else c for c in range(256))
#: Different words whose hashes a task keeps, of some 300 bytes each.
SEEN = 1 << 18
#: Labelled ids that are broadcast at once, of some 50 bytes each.
IDS = 1 << 20
_RUNS = re.compile(rb"(.)\1+", re.DOTALL)


@dataclass(frozen=True)
class QualityParams:
    """buckets: n-gram hash buckets.
    quantile: share of good labelled documents left aside at the low end.  junk_quantile: share of bad ones below the high end.  prior: pseudo-count mass of the raw multinomial given to the target.
    """

    buckets: int = 1 << 16
    quantile: float = 0.002
    junk_quantile: float = 0.95
    prior: float = 1.0
    min_words: int = 50
    max_repeat_percent: int = 50


@dataclass(frozen=True)
class QualityModel:
    params: QualityParams
    weights: np.ndarray = field(repr=False)
    threshold: float


def _shape(word: bytes) -> bytes:
    return _RUNS.sub(rb"\1", word.translate(_SHAPE))


class _Grams:
    """Hash buckets of a slice's n-grams, with the row each belongs to; word hashes are kept between slices."""

    def __init__(self, buckets: int):
        self.buckets = buckets
        self.seen = Numbering()
        self.lower = np.zeros(0, np.uint64)
        self.shape = np.zeros(0, np.uint64)

    def __call__(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers, their rows, and the buckets as rows of three (words, pairs, shape pairs)."""
        if len(self.seen) > SEEN:
            self.__init__(self.buckets)
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        ids = np.fromiter((n for d in docs for n in map(self.seen.__getitem__, d)), np.int64, int(counts.sum()))
        if len(self.seen) > len(self.lower):
            new = list(self.seen)[len(self.lower) :]
            self.lower = np.append(self.lower, mix64(np.array([zlib.crc32(w.lower()) for w in new], np.uint64)))
            self.shape = np.append(self.shape, mix64(np.array([zlib.crc32(_shape(w)) + (1 << 40) for w in new], np.uint64)))
        row = np.repeat(np.arange(len(docs)), counts)
        a, s = self.lower[ids], self.shape[ids]
        first = np.ones(len(ids), bool)
        first[1:] = row[1:] != row[:-1]
        before = np.roll(a, 1)
        before[first] = np.uint64(1)
        shape_before = np.roll(s, 1)
        shape_before[first] = np.uint64(2)
        k = np.uint64(0x9E3779B97F4A7C15)
        mask, shift = np.uint64(self.buckets - 1), np.uint64(40)
        pair, shapes = (before * k + a) * k, (shape_before * k + s) * k
        return ids, row, np.stack([a & mask, (pair >> shift) & mask, (shapes >> shift) & mask]).astype(np.int64)


def _repeats(ids: np.ndarray, row: np.ndarray, rows: int) -> np.ndarray:
    """Words that stand in a 3-word window found twice or more in the same text."""
    out = np.zeros(rows, np.int64)
    if len(ids) < 3:
        return out
    at = np.flatnonzero(row[2:] == row[:-2])
    a, b, c, r = ids[at], ids[at + 1], ids[at + 2], row[at]
    k = np.uint64(0x9E3779B97F4A7C15)
    h = mix64(((a.astype(np.uint64) * k + b.astype(np.uint64)) * k + c.astype(np.uint64)) * k + r.astype(np.uint64))
    order = np.argsort(h, kind="stable")
    x, y = order[1:], order[:-1]
    same = (h[x] == h[y]) & (a[x] == a[y]) & (b[x] == b[y]) & (c[x] == c[y]) & (r[x] == r[y])
    again = np.zeros(len(at), bool)
    again[x[same]] = True
    again[y[same]] = True
    hit = np.zeros(len(ids), bool)
    for d in range(3):
        hit[at[again] + d] = True
    return np.bincount(row[hit], minlength=rows)


def base_counts(raw: list[bytes], ids: np.ndarray, row: np.ndarray) -> list[np.ndarray]:
    """word_chars, n_symbols, n_dup_lines and n_repeat_words of each text."""
    sizes = np.fromiter(map(len, raw), np.int64, len(raw))
    buffer = np.frombuffer(b"".join(raw), np.uint8)
    of = np.repeat(np.arange(len(raw)), sizes)
    chars = ((buffer & 0xC0) != 0x80) & ~_SPACE[buffer]
    dup = np.zeros(len(raw), np.int64)
    for i, text in enumerate(raw):
        lines = [x for x in text.split(b"\n") if x and not x.isspace()]
        dup[i] = len(lines) - len(set(lines))
    count = lambda flags: np.bincount(of[flags], minlength=len(raw))
    return [count(chars), count(_SYMBOL[buffer]), dup, _repeats(ids, row, len(raw))]


def _gram_counts(rows: DataFrame, n: int) -> np.ndarray:
    """How often each bucket occurs in the texts of all rows."""

    def count(batches):
        grams, total = _Grams(n), np.zeros(n, np.int64)
        for whole in batches:
            for batch in slices(whole, "text"):
                for b in grams([x.split() for x in texts(batch)])[2]:
                    total += np.bincount(b, minlength=n)
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(at), pa.array(total[at])], names=["bucket", "n"])

    out = np.zeros(n)
    for b, x in rows.select("text").mapInArrow(released(count), "bucket long, n long").groupBy("bucket").agg(F.sum("n")).collect():  # one row a bucket at most
        out[b] = x
    return out


def ranked(df: DataFrame, column: str, rank: int, most: int = 10_000) -> float:
    """The value at a place (from 0) of the column's values in order, exactly: ranges of values are counted and narrowed until few different values are left."""
    while True:
        low, high, values = df.agg(F.min(column), F.max(column), F.approx_count_distinct(column)).first()
        if values <= most or low == high:
            break
        bin_ = F.least(F.floor((F.col(column) - low) / (high - low) * 1024), F.lit(1023)).cast("int")
        for b, n in sorted(df.groupBy(bin_.alias("b")).count().collect()):  # 1,024 rows at most
            if rank < n:
                df = df.where(bin_ == b)
                break
            rank -= n
    for value, n in sorted(df.groupBy(column).count().collect()):
        if rank < n:
            return float(value)
        rank -= n
    raise IndexError("fewer values than the rank")


def labelled(rows: DataFrame, known: DataFrame, each: int = IDS) -> Iterator[DataFrame]:
    """``rows`` joined to their labels, one after another in parts of about ``each`` ids, which are broadcast: no text moves, and each labelled row is in one part."""
    parts = max(1, -(-known.count() // each))
    part = F.pmod(F.xxhash64(F.lit("part"), "doc_id"), F.lit(parts))
    for i in range(parts):
        yield rows.join(F.broadcast(known.where(part == i)), "doc_id")


def fit(spark: SparkSession, docs: DataFrame, labels: DataFrame, params: QualityParams = QualityParams(), each: int = IDS) -> QualityModel:
    """The raw multinomial from all documents, the target from all good ones of one half of the labels, the threshold from the scores of all documents of the other half.

    Each labelled text is joined to its label once, where it lies; more labels than ``each`` take several passes, each over texts that no other pass works on.
    """
    known = labels.where(F.col("doc_id").isNotNull() & F.col("quality").isNotNull()).groupBy("doc_id").agg(F.max("quality").cast("int").alias("label"))
    known = cut(known.withColumn("half", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2))), "quality-labels")
    rows, n = docs.select("doc_id", "text"), params.buckets
    raw = _gram_counts(rows, n)
    target = sum(_gram_counts(part, n) for part in labelled(rows, known.where("half = 0 and label = 1").select("doc_id"), each))
    p_raw = (raw + 1) / (raw.sum() + n)
    p_target = (target + params.prior * n * p_raw) / (target.sum() + params.prior * n)
    weights = np.log(p_target / p_raw).astype(np.float32)
    model = QualityModel(params, weights, -np.inf)
    parts = [cut(score(part, model).where("not base_failed").select("label", "llr"), "quality-scores") for part in labelled(rows, known.where("half = 1").select("doc_id", "label"), each)]
    scores = functools.reduce(DataFrame.union, parts)
    counts = dict(scores.groupBy("label").count().collect())  # a row a label
    good, bad = counts.get(1, 0), counts.get(0, 0)
    threshold = -np.inf
    if good:
        threshold = low = ranked(scores.where("label = 1"), "llr", int(params.quantile * good))
        if bad and (high := ranked(scores.where("label = 0"), "llr", min(bad - 1, int(params.junk_quantile * bad)))) < low:
            threshold = (low + high) / 2
    return QualityModel(params, weights, threshold)


def score(docs: DataFrame, model: QualityModel, text: str = "text") -> DataFrame:
    """``docs`` with the counts, the mean log-likelihood ratio and the verdict of every row."""
    params, threshold = model.params, model.threshold
    shared = docs.sparkSession.sparkContext.broadcast(model.weights)  # 4 bytes a bucket

    def make():
        grams, weights = _Grams(params.buckets), shared.value

        def work(batch):
            raw = texts(batch, text)
            docs_ = [x.split() for x in raw]
            n = np.fromiter(map(len, docs_), np.int64, len(docs_))
            ids, row, buckets = grams(docs_)
            total = np.bincount(row, weights[buckets].sum(0, dtype=np.float64), minlength=len(raw))
            llr = np.round(total / np.maximum(1, 3 * n), 9)
            base = base_counts(raw, ids, row)
            failed = (n < params.min_words) | (100 * base[3] > params.max_repeat_percent * n)
            return [n, *base, failed, llr, ~failed & (llr >= threshold)]

        return work

    return add_columns(docs, make, FIELDS, text)
