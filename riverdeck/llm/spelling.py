"""Spelling variants: words one edit apart, found by rolling-hash deletion keys, and the form each belongs to.

Two words are near if they differ by exactly one inserted, deleted or replaced code point.  For a word of L code points, prefix and suffix polynomial hashes (modulo
2**64) give the L keys of the word with one code point deleted, and the key of the word itself, as NumPy integers.  Rows are dealt by the upper bits of the
key and sorted by it; words that share a key and, compared as strings, the remaining text are near: at the same place they replace
each other, and a whole word is near those that a deletion turns into it.  A group of one remaining text holds at most as many words as the
alphabet has letters (times the places), so no group is unbounded; groups are added up (how many, and the most frequent other) and never listed as pairs.

A word's form is its near word of largest count (ties: smallest in code-point order) if that is at least ``ratio`` times the word's own; its root is the last
form that following forms leads to.  Counts grow ``ratio`` times a step, so chains have at most 27 steps and five doublings reach every root.

Words over ``LONG`` bytes travel as digests and the rest of them as digests, so that a very long word costs its length and not its square.

Defined cases: a null text has no words; a null key of a document is an empty text; an empty table gives an empty result; repeated rows count each; other
columns are ignored.
"""

from __future__ import annotations

import hashlib
import re
from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut, mix64, slices, texts

LETTERS = "A-Za-zÀ-ÿ"
LEAST_LENGTH = 6
LEAST_COUNT = 5
RATIO = 5
#: Different words counted in a task before they are sent on.
HELD = 1 << 18
#: Bytes of a word that travels as it is.
LONG = 48
#: Code points whose keys are worked out at once.
CELLS = 1 << 20
#: Upper bits of a key by which rows are dealt.
RADIX_BITS = 16
BASE = np.uint64(0x9E3779B97F4A7C15)
INVERSE = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))
DOUBLINGS = 5


def word_counts(docs: DataFrame, edit: Callable[[str, str], str] | None = None, key: str = "doc_id", text: str = "text", least: int = LEAST_LENGTH) -> DataFrame:
    """(word, n): the maximal runs of ``LETTERS`` in all texts, A-Z lower-cased, of at least ``least`` code points.

    ``edit(document key, word)``, if given, changes a word before it is counted.  Counts are added up in the tasks first.
    """
    docs = docs.select(F.coalesce(F.col(f"`{key}`").cast("string"), F.lit("")).alias("key"), F.col(f"`{text}`").alias("text"))
    pattern = re.compile(f"[{LETTERS}]{{{least},}}")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter[str] = Counter()

        def out():
            yield pa.RecordBatch.from_arrays([pa.array(held.keys(), pa.string()), pa.array(held.values(), pa.int64())], names=["word", "n"])
            held.clear()

        for whole in batches:
            for batch in slices(whole, "text"):
                for doc, raw in zip(batch.column(0).to_pylist(), texts(batch)):
                    found = pattern.findall(raw.lower().decode())
                    if edit is None:
                        held.update(found)
                        continue
                    for word, n in Counter(found).items():
                        word = edit(doc, word)
                        if len(word) >= least:
                            held[word] += n
                if len(held) >= HELD:
                    yield from out()
        yield from out()

    return docs.mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def deletion_keys(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For words of one length as rows of code points: the keys with each code point deleted, and those of the words."""
    length = codes.shape[1]
    powers = np.cumprod(np.concatenate([[np.uint64(1)], np.full(length - 1, BASE)]))
    prefix = np.cumsum(mix64(codes + np.uint64(1)) * powers, axis=1)
    whole = prefix[:, -1:]
    before = np.concatenate([np.zeros_like(whole), prefix[:, :-1]], axis=1)
    return mix64(before + (whole - prefix) * INVERSE), mix64(whole[:, 0])


def name_of(word: str) -> str:
    """The word, or where it is long a digest that no word equals."""
    raw = word.encode()
    return word if len(raw) <= LONG else f"\0{hashlib.md5(raw).hexdigest()}"


def _keyed(vocabulary: DataFrame) -> DataFrame:
    """(radix, key, place, name, rest, n): a row for each deletion of each word, and one of place -1 for the word; ``rest`` only where the name doesn't tell it."""
    names = ["key", "place", "name", "rest", "n"]

    def rows(block: list[tuple[str, int]], length: int) -> pa.RecordBatch:
        words = [w for w, _ in block]
        codes = np.array(words, dtype=f"<U{length}").view(np.uint32).reshape(len(block), length).astype(np.uint64)
        keys, whole = deletion_keys(codes)
        key = np.concatenate([whole[:, None], keys], axis=1).view(np.int64).ravel()
        called = np.repeat(np.array([name_of(w) for w in words], object), length + 1)
        rest = None
        if any(len(w.encode()) > LONG for w in words):
            rest = [None if len(w.encode()) <= LONG else name_of(w if i < 0 else w[:i] + w[i + 1 :]) for w in words for i in range(-1, length)]
        columns = [
            pa.array(key),
            pa.array(np.tile(np.arange(-1, length, dtype=np.int32), len(block))),
            pa.array(called, pa.string()),
            pa.nulls(len(key), pa.string()) if rest is None else pa.array(rest, pa.string()),
            pa.array(np.repeat(np.array([n for _, n in block], np.int64), length + 1)),
        ]
        return pa.RecordBatch.from_arrays(columns, names=names)

    def run(batches):
        for batch in batches:
            by: dict[int, list] = {}
            for word, n in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                by.setdefault(len(word), []).append((word, n))
            for length, group in by.items():
                step = max(1, CELLS // (length + 1) // 4)
                for a in range(0, len(group), step):
                    whole = rows(group[a : a + step], length)
                    for b in range(0, whole.num_rows, CELLS):
                        yield whole.slice(b, CELLS)

    made = vocabulary.mapInArrow(run, "key long, place int, name string, rest string, n long")
    return made.withColumn("radix", F.shiftrightunsigned("key", 64 - RADIX_BITS).cast("int"))


def _rest(name: str, place: int, rest: str | None) -> str:
    """What is left of a word, of a long one its digest."""
    return rest if rest is not None else name if place < 0 else name[:place] + name[place + 1 :]


def _group(members: list[tuple[int, str, int]]) -> Iterator[tuple[str, int, int, str]]:
    """(name, near words, the largest count among them, one with that count) for the words of one remaining text; digests that tie come in rows of their own."""
    whole = [(-n, name) for place, name, n in members if place < 0]
    places: dict[int, list] = {}
    longer: dict[str, int] = {}
    for place, name, n in members:
        if place >= 0:
            places.setdefault(place, []).append((-n, name))
            longer[name] = -n
    told = [(same, same) for same in places.values() if len(same) > 1]
    if whole and longer:
        longs = [(n, name) for name, n in longer.items()]
        told += [(whole, longs), (longs, whole)]
    for asking, answers in told:
        ranked = sorted(answers)
        digests = any(name.startswith("\0") for _, name in ranked)
        for own in asking:
            first = ranked[0] if ranked[0] != own else ranked[1]
            yield own[1], len(ranked) - (asking is answers), -first[0], first[1]
            if digests:  # which of equally frequent digests is first, only their words tell
                yield from ((own[1], 0, -r[0], r[1]) for r in ranked if r[0] == first[0] and r not in (own, first))


def _near(keyed: DataFrame) -> DataFrame:
    """(name, near, best_n, best): for each word and each group, how many near words and the most frequent."""

    def run(batches):
        open_, last = [], None

        def done():
            by: dict[str, list] = {}
            for place, name, rest, n in open_:
                by.setdefault(_rest(name, place, rest), []).append((place, name, n))
            for members in by.values():
                if len(members) > 1:
                    yield from _group(members)

        def pack(rows):
            return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows), (pa.string(), pa.int64(), pa.int64(), pa.string()))], names=["name", "near", "best_n", "best"])

        for batch in batches:
            if not batch.num_rows:
                continue
            keys = batch.column(0).to_numpy()
            # A key is shared with the row before or after, or with rows of the next batch.
            same = np.concatenate([keys[1:] == keys[:-1], [True]])
            same[1:] |= keys[1:] == keys[:-1]
            same[0] = True
            shared = np.flatnonzero(same)
            part = batch.take(pa.array(shared))
            found = []
            for key, *row in zip(keys[shared].tolist(), *(part.column(i).to_pylist() for i in range(1, 5))):
                if key != last:
                    if len(open_) > 1:
                        found.extend(done())
                    open_, last = [], key
                open_.append(row)
            if found:
                yield pack(found)
        found = list(done()) if len(open_) > 1 else []
        if found:
            yield pack(found)

    dealt = keyed.repartition("radix").sortWithinPartitions("key").select("key", "place", "name", "rest", "n")
    return dealt.mapInArrow(run, "name string, near long, best_n long, best string")


def variants(counts: DataFrame, least_count: int = LEAST_COUNT, ratio: int = RATIO, least: int = LEAST_LENGTH) -> DataFrame:
    """(word, form, root, n, n_near, form_n) for the words of (word, n) with at least ``least_count`` occurrences and ``least`` code points."""
    short = F.octet_length("word") <= LONG
    vocabulary = cut(counts.where((F.col("n") >= least_count) & (F.length("word") >= least)).select("word", "n"), "vocabulary")
    named = vocabulary.withColumn("name", F.when(short, F.col("word")).otherwise(F.concat(F.lit("\0"), F.md5(F.col("word").cast("binary")))))
    long = named.where(~short).select(F.col("name").alias("best"), "word")
    rows = cut(_near(_keyed(vocabulary)), "near")
    digest = F.col("best").startswith("\0")
    rows = rows.where(~digest).withColumn("word", F.col("best")).unionByName(rows.where(digest).join(long, "best")).withColumnRenamed("word", "best_word")
    near = rows.groupBy("name").agg(F.sum("near").alias("n_near"), F.min(F.struct((-F.col("best_n")).alias("minus"), F.col("best_word").alias("form"))).alias("best"))
    joined = named.join(near, "name", "left")
    form_n = -F.col("best.minus")
    enough = form_n >= ratio * F.col("n")
    known = joined.select("word", F.when(enough, F.col("best.form")).alias("form"), "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(enough, form_n).alias("form_n"))
    known = cut(known, "forms")
    reach = known.where("form is not null").select("word", F.col("form").alias("root"))
    for _ in range(DOUBLINGS):
        further = reach.select(F.col("word").alias("root"), F.col("root").alias("next"))
        step = cut(reach.join(further, "root", "left").select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        reach = step.select("word", "root")
        if step.where("moved").isEmpty():
            break
    return known.join(reach, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")
