"""Near copies by SimHash trees and the exact Jaccard similarity of word shingles.

A text's set holds the hashes of its shingles of ``SIZE`` words (bytes lower-cased, split at ASCII white space; a text of fewer words is one
shingle).  Two texts are near copies if the Jaccard similarity of their sets is at least ``AT_LEAST``; classes are the connected components.

At that similarity SimHash fingerprints differ by some ten bits, which is too many for shards named by parts of the fingerprint; here shards are named by
``BANDS`` bands of ``ROWS`` smallest hashes, one of which near copies share but for a chance of (1 - 0.8**5)**32, about 3 in a million.  Within a shard a BK-tree of the
fingerprints, taken of the sets and not of the texts with their repeats, is searched for others within ``RADIUS`` bits; the pairs found must also have sizes that allow the similarity, and an estimated similarity (one byte of each of the
160 smallest hashes, in the second round of 1,024 others) of at least ``MAYBE`` or ``LONG_MAYBE``.  What is left is checked exactly by joining the sets.  First only as many pairs as there are members, twice at most, are tried: edges of an estimate of ``LIKELY`` that
span each shard's groups, and stars around hubs, which a family of copies of one text has; then all pairs found whose texts are still in different classes.  No pair below the similarity is linked; one exactly at it is missed
with a chance of some 1 in 1,000.

Equal sets share a 64-bit name and need no check.  Defined cases: null, empty and blank texts have the empty set and are equal to each other;
repeated rows are equal; an empty table gives an empty result.
"""

from __future__ import annotations

from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from . import simhash
from .common import add_columns, cut, mix64, released, texts

SIZE = 5
#: The least similarity, as a fraction, so that the check is in whole numbers.
AT_LEAST = (4, 5)
BANDS = 32
ROWS = 5
SEED = 43
#: SimHash bits by which candidates may differ (mean 9.7, deviation 2.9 at the least similarity; sets of four and five shingles: 12 and 3.1); estimates that are tried first, and at all (deviation 0.032).
RADIUS = 24
LIKELY = 0.87
MAYBE = 0.69
#: Bytes of the longer sketch by which the second round estimates, and its least estimate (deviation 0.0125).
LONG_SKETCH = 1024
LONG_MAYBE = 0.755
#: Hashes whose bits are counted at once.
BITS = 1 << 14
#: Rows of a shard in one task; a larger shard is split, and each two parts meet.
MOST = 4096
FIELDS = [T.StructField("_set", T.LongType()), T.StructField("_bands", T.ArrayType(T.LongType())), T.StructField("_fp", T.LongType()), T.StructField("_size", T.IntegerType()), T.StructField("_sketch", T.BinaryType())]


def shingles(text: bytes, size: int = SIZE) -> np.ndarray:
    """The sorted distinct hashes of the text's shingles."""
    w = text.lower().split()
    if not w:
        return np.zeros(0, np.uint64)
    n = max(1, len(w) - size + 1)
    parts = map(b" ".join, zip(*[w[k:] for k in range(size)])) if n > 1 else [b" ".join(w)]
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, parts, repeat(SEED)), np.uint64, n))


def bands(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """For each set, none of them empty, a hash of each band's smallest hashes, and one byte of each; bands never share a value by their place."""
    if not sets:
        return np.zeros((0, BANDS), np.uint64), np.zeros((0, BANDS * ROWS), np.uint8)
    flat = np.concatenate(sets)
    starts = np.cumsum([0, *map(len, sets[:-1])])
    turns = mix64(np.arange(1, 2 * BANDS * ROWS + 1, dtype=np.uint64)).reshape(BANDS, ROWS, 2)
    out, sketch = np.empty((len(sets), BANDS), np.uint64), np.empty((len(sets), BANDS, ROWS), np.uint8)
    for b in range(BANDS):
        key = np.full(len(sets), b + 1, np.uint64)
        for r, (flip, factor) in enumerate(turns[b]):
            least = mix64(np.minimum.reduceat((flat ^ flip) * (factor | np.uint64(1)), starts))
            sketch[:, b, r] = least & np.uint64(255)
            key = mix64(key ^ least)
        out[:, b] = key
    return out, sketch.reshape(len(sets), -1)


def majorities(sets: list[np.ndarray]) -> np.ndarray:
    """The SimHash fingerprint of each set, none of them empty: per bit, the majority over its different shingles.

    A passage that a text repeats counts once, as in the similarity.
    """
    sizes = np.array([len(x) for x in sets], np.int64)
    ones = np.zeros((len(sets), 64), np.int64)
    flat, ends = np.concatenate([np.zeros(0, np.uint64), *sets]), np.cumsum(sizes)
    starts = ends - sizes
    for a in range(0, len(flat), BITS):
        part = flat[a : a + BITS]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part), "left")
        ones[lo:hi] += np.add.reduceat(bits, np.maximum(starts[lo:hi] - a, 0), axis=0, dtype=np.int64)
    return np.packbits((2 * ones > sizes[:, None]).astype(np.uint8), axis=1, bitorder="little").view(np.uint64).ravel()


def long_sketch(own: np.ndarray) -> bytes:
    """One byte of each of LONG_SKETCH smallest hashes of a set that is not empty."""
    turns = mix64(np.arange(1, 2 * LONG_SKETCH + 1, dtype=np.uint64) ^ np.uint64(SEED << 32)).reshape(-1, 2)
    least = np.full(LONG_SKETCH, np.iinfo(np.uint64).max, np.uint64)
    for a in range(0, len(own), 256):
        part = own[a : a + 256]
        np.minimum(least, ((part[None, :] ^ turns[:, :1]) * (turns[:, 1:] | np.uint64(1))).min(1), out=least)
    return (mix64(least) & np.uint64(255)).astype(np.uint8).tobytes()


def tagged(docs: DataFrame, text: str = "text") -> DataFrame:
    """``docs``, written once, with a key of each row (_row), the name of its set and its bands."""

    def make():
        def work(batch):
            raw = texts(batch, text)
            sets = [shingles(t) for t in raw]
            full = [i for i, s in enumerate(sets) if len(s)]
            names = np.zeros(len(sets), np.uint64)
            names[full] = [xxhash.xxh64_intdigest(sets[i].tobytes(), SEED) for i in full]
            made, sketches = [[]] * len(sets), [b""] * len(sets)
            filled = [sets[i] for i in full]
            keys, bytes_ = bands(filled)
            prints = np.zeros(len(sets), np.uint64)
            prints[full] = majorities(filled)
            for i, row, sketch in zip(full, keys.view(np.int64), bytes_):
                made[i], sketches[i] = row, sketch.tobytes()
            return [names.view(np.int64), made, prints.view(np.int64), list(map(len, sets)), sketches]

        return work

    return cut(add_columns(docs.withColumn("_row", F.monotonically_increasing_id()), make, FIELDS, text), "tagged")


def _checked(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (a, b) whose sets are similar enough."""
    x, y = (sets.select(F.col("_set").alias(n), F.col("_shingles").alias(s)) for n, s in (("a", "x"), ("b", "y")))
    counted = pairs.join(x, "a").join(y, "b").select("a", "b", F.size(F.array_intersect("x", "y")).alias("both"), (F.size("x") + F.size("y")).alias("sum"))
    over, under = AT_LEAST
    return cut(counted.where(F.lit(under) * F.col("both") >= F.lit(over) * (F.col("sum") - F.col("both"))).select("a", "b"), "similar")


def _candidates(members: DataFrame, spanning: bool) -> DataFrame:
    """Pairs (a, b) of a shard's members (band, _set, _fp, _size, _sketch, root) that may be similar and are in different classes.

    With ``spanning``, at most two pairs for each member: those that join the shard's groups of likely similar members, and stars around hubs: the member that has
    the most in common with others, and those near it; the same among the members left; and so on.
    """
    over, under = AT_LEAST

    def run(batches):
        def done(key, cols):
            _, lo, hi = key
            part, names, fps, sizes, sketches, roots = cols
            n = len(names)
            maybe = MAYBE if spanning else LONG_MAYBE
            sketches = np.frombuffer(b"".join(sketches), np.uint8).reshape(n, -1)
            sizes = sizes.astype(np.int64)
            forest = simhash.Forest(n)
            found = []
            common = np.zeros(n)

            def like(i, near):
                return (sketches[near] == sketches[i]).mean(1)

            def visit(i, near):
                near = near[near > i] if not spanning else near[near != i]
                near = near[(roots[near] != roots[i]) & (under * np.minimum(sizes[near], sizes[i]) >= over * np.maximum(sizes[near], sizes[i]))]
                if lo != hi:
                    near = near[part[near] != part[i]]
                if len(near):
                    estimate = like(i, near)
                    if spanning:
                        common[i] = estimate[estimate >= maybe].sum()
                    near = near[estimate >= (LIKELY if spanning else maybe)]
                if spanning and len(near):
                    own = forest.find(near)
                    _, first = np.unique(own, return_index=True)
                    first = first[own[first] != forest.find(np.array([i]))]
                    forest.join(np.append(near, i))
                    near = near[first]
                if len(near):
                    found.append((np.full(len(near), i), near))

            simhash.BKTree(fps.view(np.uint64)).search(fps.view(np.uint64), RADIUS, visit)
            left = common > 0
            for i in np.argsort(-common, kind="stable").tolist():
                if not left[i]:
                    continue
                left[i] = False
                near = np.flatnonzero(left & (roots != roots[i]) & (under * np.minimum(sizes, sizes[i]) >= over * np.maximum(sizes, sizes[i])))
                if lo != hi:
                    near = near[part[near] != part[i]]
                near = near[like(i, near) >= maybe]
                left[near] = False
                if len(near):
                    found.append((np.full(len(near), i), near))
            if found:
                a, b = (names[np.concatenate(x)] for x in zip(*found))
                yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], names=["a", "b"])

        yield from simhash.shards(batches, 3, done)

    return simhash.dealt(members, ["band"], "_set", MOST).select("band", "lo", "hi", "part", "_set", "_fp", "_size", "_sketch", "root").mapInArrow(released(run), "a long, b long").distinct()


def small(df: DataFrame, most: int = 1 << 22) -> DataFrame:
    """``df``, marked for broadcast if it has at most ``most`` rows (of a few numbers each); it must be cheap to count."""
    return F.broadcast(df) if df.count() <= most else df


def classes(rows: DataFrame, text: str = "text") -> DataFrame:
    """(_set, root) for the sets of ``tagged`` rows that have a near copy; any other set is its own class."""
    keyed = rows.select("_set", F.explode("_bands").alias("band"))
    # Added up before anything is shuffled, so exact copies weigh nothing.
    shared = keyed.groupBy("band").agg(F.min("_set").alias("lo"), F.max("_set").alias("hi")).where("lo <> hi").select("band")
    inside = cut(keyed.join(shared, "band", "left_semi").distinct(), "bands")
    near = cut(inside.select("_set").distinct(), "near")
    one = rows.select("_set", "_row", "_fp", "_size", "_sketch").join(near, "_set", "left_semi").groupBy("_set").agg(F.min(F.struct("_row", "_fp", "_size", "_sketch")).alias("r")).select("_set", "r.*")
    one = cut(one, "one")
    members = cut(inside.join(one.drop("_row"), "_set"), "members")

    def make():
        def work(batch):
            own = [shingles(t) for t in texts(batch, text)]
            return [[x.view(np.int64) for x in own], [long_sketch(x) if len(x) else b"" for x in own]]

        return work

    # One row of each set that shares a band; texts are shuffled only if those rows are too many to broadcast.
    chosen = rows.select("_row", "_set", text).join(small(one.select("_row")), "_row", "left_semi")
    sets = cut(add_columns(chosen, make, [T.StructField("_shingles", T.ArrayType(T.LongType())), T.StructField("_long", T.BinaryType())], text).select("_set", "_shingles", "_long"), "sets")
    tried = cut(_candidates(members.withColumn("root", F.col("_set")), True), "tried")
    links = _checked(tried, sets)
    known = cut(simhash.spread_join(members.select("band", "_set", "_fp", "_size"), simhash.classes(links).withColumnRenamed("fp", "_set"), "_set", "band").withColumn("root", F.coalesce("root", "_set")), "known")
    # Bands whose members are in several classes still.
    split = known.groupBy("band").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo <> hi").select("band")
    known = known.join(split, "band", "left_semi").join(sets.select("_set", F.col("_long").alias("_sketch")), "_set")
    open_ = _candidates(known, False).join(tried, ["a", "b"], "left_anti")
    links = links.union(_checked(open_, sets))
    return simhash.classes(links).withColumnRenamed("fp", "_set")
