"""Substring dedup: passages of words that an earlier document has, found by suffix trees over prefix groups.

A window is ``WINDOW`` consecutive words of one document; a word goes if a window that covers it also starts in a document with a smaller doc_id.

Each window is dealt to a group by a prefix of the suffix that starts at its anchor: the leftmost of the ``PREFIX``-word prefixes with the least hash in it. Equal windows have
equal anchors, so they meet in one group, and neighbouring windows share an anchor, so that a group gets them as one stretch of words.

1. The prefixes that start at anchors are counted with the smallest and largest doc_id; those of one document alone are left out (most of a corpus).
2. Stretches are cut around the remaining anchors.  A prefix with more than ``most`` occurrences is lengthened to all the words of a window, each window by itself, so no group outgrows memory; equal stretches
   are put together in the tasks before they are shuffled, so copies weigh little.
3. Each group is a generalised suffix tree of its stretches, as sorted suffixes and common prefix lengths down to the depth of a window: its deep internal nodes are the repeats,
   and the smallest doc_id below a node answers for all its leaves.
4. The answers go back to the documents by stretch, and windows whose answer is a smaller doc_id are cut out.

Prefixes and stretches are named by 64-bit hashes (stretches by two of them, the prefix's included); words in the trees are compared as text.

Defined cases: a null text has no words; a row without doc_id neither loses words nor makes others lose any; rows that share a doc_id don't make each other lose words; an empty
table gives an empty result; a doc_id may be of any type that has an order; columns with the names of new ones are replaced, all others stay.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import chain

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_columns, cut, fresh, mix64, released, slices, texts

WINDOW = 13
PREFIX = 6
#: Occurrences of a prefix beyond which it is lengthened.
MOST = 1 << 16
#: Bytes of text that a task turns into numbers at once; these take some 80 times as many.
SLICE = 1 << 19
#: Bytes of stretches that a task holds to put equal ones together, and of what Python keeps beside each.
HELD, BESIDE = 32 << 20, 400
#: Stretches whose trees are built at once, whole groups.
BUILT = 1 << 14
#: Bytes of found places up to which they are broadcast to the texts; beyond, both are shuffled.
BROADCAST = 64 << 20
BASE = 0x9E3779B97F4A7C15

_CODES = mix64(np.arange(1, 257, dtype=np.uint64))


class _Powers:
    """Powers of BASE and of its inverse modulo 2**64, as many as were asked for."""

    def __init__(self):
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(self.up) < n:
            size = max(n, 2 * len(self.up))
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b, np.uint64)])) for b in (BASE, pow(BASE, -1, 1 << 64)))
        return self.up[:n], self.down[:n]


class Words:
    """The words of some texts as bytes with one space after each, their hashes, and the text each belongs to."""

    def __init__(self, raw: list[bytes], powers: _Powers):
        a = np.frombuffer(b" ".join(raw) + b" ", np.uint8)
        inside = ~((a == 32) | ((a >= 9) & (a <= 13)))
        edge = np.diff(np.concatenate([[0], inside.view(np.int8)]))
        starts, ends = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
        self.doc = np.searchsorted(np.cumsum([len(t) + 1 for t in raw]), starts, "right")
        up, down = powers.get(len(a))
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(_CODES[a] * up)])
        self.hash = mix64((total[ends] - total[starts]) * down[starts])
        # One space after each word, whatever was there.
        single = inside.copy()
        single[1:] |= inside[:-1]
        self.bytes = np.where(inside, a, 32).astype(np.uint8)[single].tobytes()
        after = np.cumsum(ends - starts + 1)
        self.starts, self.ends = after - (ends - starts + 1), after - 1
        self.first = np.searchsorted(self.doc, np.arange(len(raw)))

    def grams(self, size: int) -> np.ndarray:
        """Hashes of ``size`` words from each on; as many as windows of the whole reach."""
        n = max(0, len(self.hash) - size + 1)
        h = np.zeros(n, np.uint64)
        for j in range(size):
            h = h * np.uint64(BASE) + self.hash[j : j + n]
        return mix64(h)

    def anchors(self, window: int, prefix: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Windows (by their first word) that lie in one text, the anchor of each, and the prefix hashes of all words."""
        grams = self.grams(prefix)
        n = max(0, len(self.hash) - window + 1)
        if not n:
            return np.zeros(0, np.int64), np.zeros(0, np.int64), grams
        span = window - prefix + 1
        least = grams[:n].copy()
        at = np.arange(n)
        for j in range(1, span):
            other = grams[j : j + n]
            less = other < least
            least = np.where(less, other, least)
            at[less] = np.flatnonzero(less) + j
        whole = np.flatnonzero(self.doc[:n] == self.doc[window - 1 :])
        return whole, at[whole], grams

    def cut(self, first: int, words: int) -> bytes:
        return self.bytes[self.starts[first] : self.ends[first + words - 1]]


def _slices(batches, text: str) -> Iterator[tuple[pa.RecordBatch, Words]]:
    powers = _Powers()
    for whole in batches:
        for batch in slices(whole, text, SLICE):
            yield batch, Words(texts(batch, text), powers)


def _tag(text: str = "text"):
    """32 bits of the text's hash: rows that share a doc_id but not their text are told apart by it."""
    return F.xxhash64(text).bitwiseAND(F.lit(0xFFFFFFFF)).alias("tag")


def _places(docs: DataFrame, kind: T.DataType, window: int, prefix: int) -> DataFrame:
    """(key, doc_id, at): the anchors of each text; ``at`` is the word's number, shifted by the tag's 32 bits."""

    def run(batches):
        for batch, words in _slices(batches, "text"):
            _, at, grams = words.anchors(window, prefix)
            at = at[np.diff(at, prepend=-1) != 0]
            doc = words.doc[at]
            place = (at - words.first[doc]) << 32 | batch.column(1).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(grams[at].view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(place)], names=["key", "doc_id", "at"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("doc_id", kind), T.StructField("at", T.LongType())])
    return docs.select("doc_id", "tag", "text").mapInArrow(released(run), schema)


def _stretches(words: Words, found: list, window: int, prefix: int):
    """(key, first word, windows) for each stretch around the anchors that ``found`` gives for each text (2 * word's number, plus 1 where the prefix is to be lengthened)."""
    start, at, grams = words.anchors(window, prefix)
    mode = np.zeros(len(words.hash) + 1, np.int8)
    for doc, places in enumerate(found):
        if places is not None and len(places):
            places = np.asarray(places)
            mode[words.first[doc] + (places >> 1)] = 1 + (places & 1)
    mode = mode[at]
    short = mode == 1
    s, a = start[short], at[short]
    head = np.flatnonzero(np.diff(a, prepend=-1) != 0)
    count = np.diff(np.append(head, len(a)))
    long = start[mode == 2]
    whole = mix64(words.grams(window)[long] ^ np.uint64(window)) if len(long) else np.zeros(0, np.uint64)
    key = np.concatenate([grams[a[head]], whole]).view(np.int64)
    return key, np.concatenate([s[head], long]), np.concatenate([count, np.ones(len(long), np.int64)])


def _sent(chosen: DataFrame, kind: T.DataType, window: int, prefix: int) -> DataFrame:
    """(key, stretch, lo, hi): the different stretches of a task, with the smallest and largest doc_id that has them."""

    def run(batches):
        held, size = {}, 0

        def out():
            if held:
                yield pa.RecordBatch.from_arrays(
                    [pa.array([k for k, _ in held], pa.int64()), pa.array([s for _, s in held], pa.binary()), *(pa.array([v[i] for v in held.values()], ids) for i in (0, 1))], names=["key", "stretch", "lo", "hi"]
                )

        for batch, words in _slices(batches, "text"):
            ids = batch.schema.field(0).type
            doc_ids = batch.column(0).to_pylist()
            key, first, count = _stretches(words, batch.column(1).to_pylist(), window, prefix)
            docs = words.doc[first].tolist()
            for k, f, c, d in zip(key.tolist(), first.tolist(), count.tolist(), docs):
                name, doc = (k, words.cut(f, c + window - 1)), doc_ids[d]
                was = held.get(name)
                if was is None:
                    held[name] = (doc, doc)
                    size += len(name[1]) + BESIDE
                elif doc < was[0] or doc > was[1]:
                    held[name] = (min(doc, was[0]), max(doc, was[1]))
            if size > HELD:
                yield from out()
                held, size = {}, 0
        yield from out()

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("stretch", T.BinaryType()), T.StructField("lo", kind), T.StructField("hi", kind)])
    return chosen.select("doc_id", "found", "text").mapInArrow(released(run), schema)


def _asked(chosen: DataFrame, kind: T.DataType, window: int, prefix: int) -> DataFrame:
    """(key, stretch_id, doc_id, at): each stretch of each text."""

    def run(batches):
        for batch, words in _slices(batches, "text"):
            key, first, count = _stretches(words, batch.column(2).to_pylist(), window, prefix)
            names = [xxhash.xxh64_intdigest(words.cut(f, c + window - 1)) for f, c in zip(first.tolist(), count.tolist())]
            doc = words.doc[first]
            place = (first - words.first[doc]) << 32 | batch.column(1).to_numpy()[doc]
            yield pa.RecordBatch.from_arrays([pa.array(key), pa.array(np.array(names, np.uint64).view(np.int64)), batch.column(0).take(pa.array(doc)), pa.array(place)], names=["key", "stretch_id", "doc_id", "at"])

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("stretch_id", T.LongType()), T.StructField("doc_id", kind), T.StructField("at", T.LongType())])
    return chosen.select("doc_id", "tag", "found", "text").mapInArrow(released(run), schema)


def deep_nodes(groups: np.ndarray, suffixes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The suffix trees of groups of suffixes, down to the depth of their columns: (suffixes in the order of leaves, first leaf of each node at that depth).

    ``suffixes`` has a row of numbered words for each suffix.  Leaves below one deep node are neighbours whose common prefix reaches the depth.
    """
    bits = max(1, int(suffixes.max(initial=0)).bit_length())
    each = 63 // bits
    # Neighbouring words as one number, as many as fit.
    packed = []
    for a in range(0, suffixes.shape[1], each):
        number = np.zeros(len(suffixes), np.int64)
        for column in suffixes.T[a : a + each]:
            number = number << bits | column
        packed.append(number)
    order = np.lexsort([*packed[::-1], groups])
    rows, group = np.stack(packed, axis=1)[order], groups[order]
    common = (rows[1:] == rows[:-1]).all(1) & (group[1:] == group[:-1])
    return order, np.flatnonzero(np.concatenate([[True], ~common])) if len(order) else np.zeros(0, np.int64)


def _answers(sent: DataFrame, kind: T.DataType, window: int) -> DataFrame:
    """(key, stretch_id, los): for each stretch that may lose words, the smallest doc_id with each of its windows."""

    def build(keys, stretches, lo, hi, ids):
        split = [s.split(b" ") for s in stretches]
        number = dict.fromkeys(chain.from_iterable(split))
        number = dict(zip(number, range(len(number))))
        sizes = np.fromiter(map(len, split), np.int64, len(split))
        flat = np.fromiter(map(number.__getitem__, chain.from_iterable(split)), np.int64, int(sizes.sum()))
        windows = sizes - window + 1
        owner = np.repeat(np.arange(len(split)), windows)
        ends = np.cumsum(windows)
        first = np.cumsum(sizes) - sizes
        start = first[owner] + np.arange(ends[-1]) - (ends - windows)[owner]
        order, nodes = deep_nodes(np.asarray(keys)[owner], np.stack([flat[start + j] for j in range(window)], axis=1))
        values, rank = np.unique(np.array(lo + hi, dtype=object if not isinstance(lo[0], int) else np.int64), return_inverse=True)
        low, high = rank[: len(lo)], rank[len(lo) :]
        least = np.empty(len(owner), np.int64)
        least[order] = np.repeat(np.minimum.reduceat(low[owner[order]], nodes), np.diff(np.append(nodes, len(order))))
        # One answer for each different stretch, and only where a document after the first has it.
        once = {}
        for i, name in enumerate(zip(keys, stretches)):
            j = once.setdefault(name, i)
            high[j] = max(high[j], high[i])
        pick = np.fromiter(once.values(), np.int64)
        pick = pick[np.minimum.reduceat(least, ends - windows)[pick] < high[pick]]
        los = [values[least[ends[i] - windows[i] : ends[i]]].tolist() for i in pick.tolist()]
        names = np.array([xxhash.xxh64_intdigest(stretches[i]) for i in pick.tolist()], np.uint64).view(np.int64)
        return pa.RecordBatch.from_arrays([pa.array([keys[i] for i in pick.tolist()], pa.int64()), pa.array(names), pa.array(los, pa.list_(ids))], names=["key", "stretch_id", "los"])

    def run(batches):
        held = [[], [], [], []]
        for batch in batches:
            ids = batch.schema.field(2).type
            for column, values in zip(held, batch.columns):
                column.extend(values.to_pylist())
            n = len(held[0])
            if n >= BUILT:
                # Whole groups; the last one may go on.
                end = n
                while end and held[0][end - 1] == held[0][-1]:
                    end -= 1
                if end:
                    yield build(*(c[:end] for c in held), ids)
                    held = [c[end:] for c in held]
        if held[0]:
            yield build(*held, ids)

    schema = T.StructType([T.StructField("key", T.LongType()), T.StructField("stretch_id", T.LongType()), T.StructField("los", T.ArrayType(kind))])
    return sent.repartition("key").sortWithinPartitions("key").mapInArrow(released(run), schema)


def _beside(docs: DataFrame, found: DataFrame, how: str) -> DataFrame:
    """Texts with what was found in them (two key columns, then an array); ``found`` is broadcast if its measured bytes allow it."""
    *keys, column = found.columns
    each = 4 if isinstance(found.schema[column].dataType.elementType, T.IntegerType) else 8
    size = found.agg(F.coalesce(F.sum(F.size(column) * each + 48), F.lit(0))).first()[0]
    return docs.join(F.broadcast(found) if size <= BROADCAST else found, keys, how)


def cuts(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, most: int = MOST) -> DataFrame:
    """(doc_id, tag, cuts) for (doc_id, tag, text): the windows whose words also start in a document with a smaller doc_id.

    A cut packs the number of a word and one bit for each window that starts there or shortly after: 2**16 * number + bits.
    """
    kind = docs.schema["doc_id"].dataType
    docs = docs.where(F.col("doc_id").isNotNull() & F.col("text").isNotNull())
    places = _places(docs, kind, window, prefix)
    shared = places.groupBy("key").agg(F.min("doc_id").alias("lo"), F.max("doc_id").alias("hi"), F.count("*").alias("n")).where("lo < hi")
    shared = cut(shared.select("key", (F.col("n") > most).cast("int").alias("wide")), "shared-prefixes")
    tag, number = F.col("at").bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftright("at", 32)
    found = places.join(shared.hint("shuffle_hash"), "key").groupBy("doc_id", tag.alias("tag")).agg(F.collect_list((number * 2 + F.col("wide")).cast("int")).alias("found"))
    chosen = _beside(docs, cut(found, "anchors"), "inner")
    answers = _answers(_sent(chosen, kind, window, prefix), kind, window)
    asked = _asked(chosen, kind, window, prefix)
    both = asked.join(answers.hint("shuffle_hash"), ["key", "stretch_id"])
    bits = F.aggregate(F.reverse(F.transform("los", lambda x: (x < F.col("doc_id")).cast("long"))), F.lit(0).cast("long"), lambda acc, x: acc * 2 + x)
    hit = both.select("doc_id", tag.alias("tag"), number.alias("number"), bits.alias("bits")).where("bits > 0")
    return cut(hit.groupBy("doc_id", "tag").agg(F.collect_list(F.col("number") * (1 << 16) + F.col("bits")).alias("cuts")), "cuts")


FIELDS = [
    T.StructField("n_words", T.LongType()),
    T.StructField("n_removed", T.LongType()),
    T.StructField("passages", T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("length", T.LongType())]))),
    T.StructField("kept", T.StringType()),
]


def remove(docs: DataFrame, window: int = WINDOW, prefix: int = PREFIX, most: int = MOST, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_removed, the ``passages`` that are removed (start, length, in words) and the ``kept`` words, joined by one space."""
    if window - prefix >= 16:
        raise ValueError("a stretch holds at most 16 windows: lengthen the prefix")
    own = docs.select("doc_id", F.col(f"`{text}`").alias("text"), _tag(f"`{text}`"))
    found = cuts(own, window, prefix, most)
    mark, tag, of = fresh(docs, "_cuts"), fresh(docs, "_tag"), fresh(docs, "_of")
    rows = docs.withColumn(tag, _tag(f"`{text}`")).withColumn(of, F.col("doc_id"))
    rows = _beside(rows, found.select(F.col("doc_id").alias(of), F.col("tag").alias(tag), F.col("cuts").alias(mark)), "left").drop(of, tag)

    def make():
        def work(batch):
            columns = [[] for _ in FIELDS]
            marks = batch.column(batch.schema.get_field_index(mark))
            for raw, packed in zip(texts(batch, text), marks):
                words = raw.split()
                passages = []
                if packed.is_valid:
                    packed = np.array(packed.values.to_numpy())
                    bit = packed[:, None] >> np.arange(16) & 1
                    start = ((packed >> 16)[:, None] + np.arange(16))[bit == 1]
                    gone = np.zeros(len(words) + 1, np.int64)
                    np.add.at(gone, start, 1)
                    np.add.at(gone, start + window, -1)
                    gone = np.cumsum(gone) > 0
                    edge = np.diff(np.concatenate([[0], gone.view(np.int8)]))
                    begin, end = np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)
                    passages = [{"start": s, "length": e - s} for s, e in zip(begin.tolist(), end.tolist())]
                    left = [w for w, g in zip(words, gone.tolist()) if not g]
                else:
                    left = words
                for column, value in zip(columns, (len(words), len(words) - len(left), passages, b" ".join(left).decode())):
                    column.append(value)
            return columns

        return work

    return add_columns(rows, make, FIELDS, text).drop(mark)
