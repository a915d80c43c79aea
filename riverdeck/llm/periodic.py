"""Periodic runs of words: heavy and light lag counting, island scans, collapsed texts.

A run is a stretch of consecutive words with smallest period q (words q apart are identical) and a length of at least max(``least``, 2 * q), which no neighbouring
word extends keeping period q.  A text's runs are found by lag: the number of places where words q apart are identical is counted for all lags
at once, by one exact autocorrelation (FFT, rounded to whole numbers) over the frequent words and by pair differences over the rare ones.  A run of
period q holds max(``least`` - q, q) matches at least, so only lags with as many, beyond those that runs of a divisor of q explain, are scanned for islands.

A word is dropped if any run contains it after that run's first q words.  Each text is worked through in its own task, whole, in memory of some
hundred bytes a word and in about n**1.5 steps; nothing is shuffled.

Defined cases: a null text has no words and no runs; an empty table gives an empty result; repeated rows are worked out each for itself; columns
of ``docs`` with the names of new ones are replaced, all others stay.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import DataFrame, types as T

from .common import add_columns, texts, words

LEAST = 12
#: A lag below this is scanned without looking at samples first.
NARROW = 16
#: Matching words by which a sample is told from chance before its lag is scanned.
SAMPLE = 12

RUN = T.StructType([T.StructField(n, T.LongType()) for n in ("start", "length", "period")])
FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_runs", T.LongType()),
    *[T.StructField(n, T.LongType()) for n in ("start", "length", "period", "exponent_milli")],
    T.StructField("runs", T.ArrayType(RUN)),
    T.StructField("collapsed", T.StringType()),
]


def numbered(found: list[bytes]) -> np.ndarray:
    """The words as numbers, equal where the words are."""
    names = dict.fromkeys(found)
    names = dict(zip(names, range(len(names))))
    return np.fromiter(map(names.__getitem__, found), np.int64, len(found))


def lag_counts(ids: np.ndarray, most: int, heavy: int | None = None) -> np.ndarray:
    """For each lag up to ``most``, the number of places i with ids[i] == ids[i + lag].

    Words of more than ``heavy`` occurrences go through the Fourier transform, n log n steps each; all others through their pairs.
    """
    n = len(ids)
    if heavy is None:
        heavy = max(32, math.isqrt(n * max(1, n.bit_length())))
    out = np.zeros(most + 1, np.int64)
    counts = np.bincount(ids)
    frequent = np.flatnonzero(counts > heavy)
    at = np.argsort(ids, kind="stable")
    if len(frequent):
        size = 1 << (n + most).bit_length()
        power = np.zeros(size // 2 + 1)
        for word in frequent.tolist():
            wave = np.fft.rfft(ids == word, size)
            power += wave.real**2 + wave.imag**2
        out += np.rint(np.fft.irfft(power, size)[: most + 1]).astype(np.int64)
        at = at[counts[ids[at]] <= heavy]
    word = ids[at]
    live = np.arange(len(at))
    for k in range(1, int(counts.max()) if len(counts) else 0):
        # Places are sorted by word, then position: those k apart of the same word are among those k - 1 apart.
        live = live[: np.searchsorted(live, len(at) - k)]
        live = live[word[live + k] == word[live]]
        if not len(live):
            break
        lags = at[live + k] - at[live]
        out += np.bincount(lags[lags <= most], minlength=most + 1)
    out[0] = 0
    return out


def islands(ids: np.ndarray, lag: int, need: int) -> tuple[np.ndarray, np.ndarray]:
    """Maximal stretches of at least ``need`` places whose word is repeated ``lag`` words later: (first places, numbers of places)."""
    m = len(ids) - lag
    if lag >= NARROW:
        # Every such stretch holds a whole block of half its least size.
        half = (need + 1) // 2
        block = np.arange(0, m - half + 1, half)
        for d in range(min(half, SAMPLE)):
            block = block[ids[block + d] == ids[block + d + lag]]
            if not len(block):
                return block, block
    same = np.zeros(m + 2, np.int8)
    same[1:-1] = ids[lag:] == ids[:-lag]
    edge = np.diff(same)
    first, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
    long = end - first >= need
    return first[long], (end - first)[long]


def find(ids: np.ndarray, least: int = LEAST) -> list[tuple[int, int, int]]:
    """All runs (start, length, period) of a text, by start and period."""
    n = len(ids)
    if n < least:
        return []
    most = n // 2
    lags = np.arange(most + 1)
    need = np.maximum(least - lags, lags)
    counts = lag_counts(ids, most)
    explained = np.zeros(most + 1, np.int64)
    seen: dict[tuple[int, int], int] = {}
    for q in (1 + np.flatnonzero(counts[1:] >= need[1:])).tolist():
        if counts[q] - explained[q] < need[q]:
            continue
        for start, matches in zip(*(x.tolist() for x in islands(ids, q, int(need[q])))):
            length = matches + q
            # A stretch found by a smaller period has that for its smallest.
            if (start, length) in seen:
                continue
            seen[start, length] = q
            multiples = np.arange(2 * q, min(length, most + 1), q)
            explained[multiples] += length - multiples
    return sorted(((s, l, q) for (s, l), q in seen.items()), key=lambda r: (r[0], r[2]))


def kept(n: int, runs: list[tuple[int, int, int]]) -> np.ndarray:
    """For each of n words, whether no run contains it after its first period."""
    change = np.zeros(n + 1, np.int64)
    for start, length, period in runs:
        change[start + period] += 1
        change[start + length] -= 1
    return np.cumsum(change[:n]) == 0


def with_runs(docs: DataFrame, least: int = LEAST, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_runs, the longest run (ties: smallest start, then period; null without runs), all ``runs`` and the ``collapsed`` text (kept words joined by one space)."""

    def make():
        def work(batch):
            columns = [[] for _ in FIELDS]
            for raw in texts(batch, text):
                found = words(raw)
                runs = find(numbered(found), least)
                best = min(runs, key=lambda r: (-r[1], r[0], r[2]), default=None)
                if runs:
                    stay = kept(len(found), runs).tolist()
                    left = [w for w, k in zip(found, stay) if k]
                else:
                    left = found
                row = (len(found), len(runs), *(best or (None,) * 3), 1000 * best[1] // best[2] if best else None, [dict(zip(RUN.names, r)) for r in runs], b" ".join(left).decode())
                for column, value in zip(columns, row):
                    column.append(value)
            return columns

        return work

    return add_columns(docs, make, FIELDS, text)
