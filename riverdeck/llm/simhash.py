"""SimHash near-duplicates: 64-bit fingerprints, BK-trees within shards, connected classes.

Fingerprints within ``radius`` bits agree on at least one of several keys (``blocks`` parts of the 64 bits, any ``blocks - radius`` of them together);
keys are hashed to shards of about ``shard_rows``, so every link lies inside a shard.  A shard's fingerprints form a BK-tree: children are keyed by their integer Hamming distance
to the parent, and a search follows only the edges within the radius.  Trees are built and searched in the tasks that hold the shards: broadcasting them would
pass the fingerprints of all documents through the driver.  Shards hold each distinct fingerprint
once; one over ``most`` is split, and each two of its parts meet in one task, so no task holds an unbounded group.  A shard sends on
only links that join its own classes, at most one a fingerprint, and never all pairs.

Defined cases: a null or empty text has fingerprint zero and is linked like any other; repeated rows and exact copies share a
fingerprint; a null doc_id takes part but names no class (a class of nulls alone has a null component_id);
an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

from itertools import chain, combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_columns, cut, texts

SEED = 42
#: Shingles whose bits are counted at once.
CHUNK = 1 << 17


def fingerprints(docs: list[bytes], size: int = 4) -> np.ndarray:
    """The 64-bit fingerprint of each text: per bit, the majority over all its word shingles, repeats included."""
    out = np.zeros(len(docs), np.uint64)
    at, pending, counts = [], [], []

    def flush():
        n = np.array(counts)
        hashes = np.fromiter(map(xxhash.xxh64_intdigest, chain.from_iterable(pending), repeat(SEED)), np.uint64, int(n.sum()))
        ones = np.zeros((len(n), 64), np.int64)
        ends = np.cumsum(n)
        starts = ends - n
        for a in range(0, len(hashes), CHUNK):
            part = hashes[a : a + CHUNK]
            bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            lo, hi = np.searchsorted(ends, a, "right"), np.searchsorted(starts, a + len(part), "left")
            cuts = np.maximum(starts[lo:hi] - a, 0)
            ones[lo:hi] += np.add.reduceat(bits, cuts, axis=0, dtype=np.int64)
        over = (2 * ones > n[:, None]).astype(np.uint8)
        out[at] = np.packbits(over, axis=1, bitorder="little").view(np.uint64).ravel()
        at.clear(), pending.clear(), counts.clear()

    for i, text in enumerate(docs):
        w = text.lower().split()
        if not w:
            continue
        at.append(i)
        if len(w) <= size:
            pending.append([b" ".join(w)])
            counts.append(1)
        else:
            pending.append(map(b" ".join, zip(*[w[k:] for k in range(size)])))
            counts.append(len(w) - size + 1)
        if len(at) >= 512:
            flush()
    if at:
        flush()
    return out


def with_fingerprint(docs: DataFrame, column: str = "_fp", text: str = "text", size: int = 4) -> DataFrame:
    """``docs`` with the fingerprint as a signed 64-bit integer."""

    def make():
        return lambda batch: [fingerprints(texts(batch, text), size).view(np.int64)]

    return add_columns(docs, make, [T.StructField(column, T.LongType())], text)


class BKTree:
    """A BK-tree: one fingerprint a node, children keyed by their integer Hamming distance to the parent.

    A child under key k and all below it are exactly at distance k from the parent, so a search within a radius follows only the edges whose key
    differs from the distance to the parent by at most the radius.
    """

    def __init__(self, values: np.ndarray):
        self.values = values
        self.pivot: list[int] = []
        self.children: list[list[tuple[int, int]]] = []  # (distance, node)
        todo = [(np.arange(len(values)), -1, 0)] if len(values) else []
        while todo:
            members, parent, key = todo.pop()
            node = len(self.pivot)
            self.pivot.append(int(members[0]))
            self.children.append([])
            if parent >= 0:
                self.children[parent].append((key, node))
            rest = members[1:]
            if len(rest) == 1:
                todo.append((rest, node, int(np.bitwise_count(values[rest[0]] ^ values[members[0]]))))
            elif len(rest):
                d = np.bitwise_count(values[rest] ^ values[members[0]])
                order = np.argsort(d, kind="stable")
                rest, d = rest[order], d[order]
                cuts = np.flatnonzero(np.diff(d)) + 1
                for part, k in zip(np.split(rest, cuts), d[np.concatenate([[0], cuts])].tolist()):
                    todo.append((part, node, k))

    def search(self, queries: np.ndarray, radius: int, visit) -> int:
        """``visit(i, near)`` for each node reached: queries[near] are within the radius of values[i].  Returns how many distances were measured."""
        todo = [(0, np.arange(len(queries)))] if self.pivot and len(queries) else []
        measured = 0
        while todo:
            node, which = todo.pop()
            pivot = self.pivot[node]
            d = np.bitwise_count(queries[which] ^ self.values[pivot]).astype(np.int16)
            measured += len(which)
            near = which[d <= radius]
            if len(near):
                visit(pivot, near)
            for key, child in self.children[node]:
                go = which[np.abs(d - key) <= radius]
                if len(go):
                    todo.append((child, go))
        return measured


class Forest:
    """Disjoint sets of 0 to n - 1, named by their least member."""

    def __init__(self, n: int):
        self.up = np.arange(n)

    def find(self, x: np.ndarray) -> np.ndarray:
        root = self.up[x]
        while True:
            higher = self.up[root]
            if (higher == root).all():
                break
            root = higher
        self.up[x] = root
        return root

    def join(self, x: np.ndarray) -> None:
        root = self.find(x)
        self.up[root] = root.min()


def links(values: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each class of two or more: (fingerprint, the class's smallest), over one shard's ascending fingerprints."""
    forest = Forest(len(values))
    # The pivot is among the queries, so it is in ``near``.
    BKTree(values).search(values, radius, lambda _, near: forest.join(near) if len(near) > 1 else None)
    every = np.arange(len(values))
    root = forest.find(every)
    kept = root != every
    return values[kept], values[root[kept]]


def shards(batches, keys: int, done):
    """Rows of record batches sorted by their first ``keys`` columns: ``done`` gets the columns (key values, then arrays) of each group when its last row is in."""
    open_, key = [], None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(i).to_numpy(zero_copy_only=False) for i in range(batch.num_columns)]
        change = np.zeros(batch.num_rows, bool)
        for c in cols[:keys]:
            change[1:] |= c[1:] != c[:-1]
        cuts = [0, *np.flatnonzero(change).tolist(), batch.num_rows]
        for s, e in zip(cuts, cuts[1:]):
            this = tuple(c[s] for c in cols[:keys])
            if this != key and open_:
                yield from done(key, [np.concatenate(x) for x in zip(*open_)])
                open_ = []
            key = this
            open_.append([c[s:e] for c in cols[keys:]])
    if open_:
        yield from done(key, [np.concatenate(x) for x in zip(*open_)])


def dealt(keyed: DataFrame, keys: list[str], member: str, most: int) -> DataFrame:
    """Groups of ``keyed`` by ``keys``, each in one task: a group over ``most`` rows is cut into parts, and each two parts meet.

    Adds ``part`` (of the row), ``lo`` and ``hi`` (the two parts that meet); groups of one row go.
    """
    sizes = keyed.groupBy(*keys).agg(F.count("*").alias("size")).where(F.col("size") > 1)
    keyed = keyed.join(sizes, keys).withColumn("parts", F.ceil(F.col("size") / most).cast("int"))
    keyed = keyed.withColumn("part", F.pmod(F.xxhash64(member), F.col("parts")).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    keyed = keyed.withColumn("lo", F.least("part", "other")).withColumn("hi", F.greatest("part", "other")).drop("size", "parts", "other")
    names = [*keys, "lo", "hi"]
    return keyed.repartition(*names).sortWithinPartitions(*names, member).select(*names, *[c for c in keyed.columns if c not in names])


def _shard_keys(radius: int, blocks: int) -> list[int]:
    """Masks of 64 bits: one for each choice of the blocks that must agree."""
    edges = [round(64 * i / blocks) for i in range(blocks + 1)]
    parts = [((1 << b) - 1) ^ ((1 << a) - 1) for a, b in zip(edges, edges[1:])]
    masks = [sum(parts[i] for i in c) for c in combinations(range(blocks), blocks - radius)]
    return [m - (1 << 64) if m >= 1 << 63 else m for m in masks]


def sharded(nodes: DataFrame, radius: int, shard_rows: int) -> DataFrame:
    """(k, shard, fp): each fingerprint in one shard for each key; two within the radius share a shard."""
    n = nodes.count()
    blocks = radius + (1 if n < 1 << 23 else 2 if n < 1 << 31 else 3)  # more of the bits in a key as the shards would grow
    many = max(1, -(-n // shard_rows))
    value = lambda m: F.lit(m).cast("long").bitwiseAND(F.col("fp"))
    places = [F.struct(F.lit(i).alias("k"), F.pmod(F.xxhash64(F.lit(i), value(m)), F.lit(many)).alias("shard")) for i, m in enumerate(_shard_keys(radius, blocks))]
    return nodes.select("fp", F.explode(F.array(*places)).alias("s")).select("s.k", "s.shard", "fp")


def link_edges(nodes: DataFrame, radius: int = 4, shard_rows: int = 1024, most: int = 8192) -> DataFrame:
    """Links (a, b) between distinct fingerprints ``fp`` that join all classes of the radius; a tree holds about ``shard_rows``, 2 * ``most`` at most."""

    def run(batches):
        def done(_, cols):
            a, b = links(np.unique(cols[0]).view(np.uint64), radius)
            if len(a):
                yield pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], names=["a", "b"])

        yield from shards(batches, 4, done)

    return dealt(sharded(nodes, radius, shard_rows), ["k", "shard"], "fp", most).drop("part").mapInArrow(run, "a long, b long").distinct()


def spread_join(rows: DataFrame, other: DataFrame, key: str, by: str, ways: int = 64) -> DataFrame:
    """Left join by ``key``, which a large share of ``rows`` may have in common: rows are dealt to ``ways`` groups by ``by``, each of which asks once for a key."""
    salted = rows.withColumn("_salt", F.pmod(F.xxhash64(by), F.lit(ways)))
    answers = salted.select("_salt", key).distinct().join(other, key)
    return salted.join(answers, ["_salt", key], "left").drop("_salt")


def classes(edges: DataFrame, max_rounds: int = 64) -> DataFrame:
    """(fp, root): connected components by smallest neighbour and pointer jumping; each round is written to the shared folder.

    Distances to the root halve each round, so a chain of n links takes about log2(n) rounds.
    """
    edges = cut(edges.select("a", "b").union(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    state = cut(edges.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("root")).withColumnRenamed("a", "fp"), "roots")
    for _ in range(max_rounds):
        # The smallest root among the neighbours, offered to the root as well as to the node.
        near = edges.join(state.select(F.col("fp").alias("b"), F.col("root").alias("r")), "b").groupBy("a").agg(F.min("r").alias("r"))
        seen = state.join(near, state.fp == near.a).select("fp", "root", "r")
        offers = seen.select("fp", F.least("root", "r").alias("r")).union(seen.select(F.col("root").alias("fp"), F.least("root", "r").alias("r")))
        best = offers.groupBy("fp").agg(F.min("r").alias("root"))
        best = cut(best, "offers")
        jump = best.select(F.col("fp").alias("root"), F.col("root").alias("up")).where("root <> up")
        new = spread_join(best, jump, "root", "fp").select("fp", F.least("root", F.coalesce("up", "root")).alias("root"))
        new = cut(new, "roots")
        old = state.select("fp", F.col("root").alias("was"))
        if new.join(old, "fp").where("root <> was").isEmpty():
            return new
        state = new
    raise RuntimeError(f"classes not settled after {max_rounds} rounds")


def near_duplicates(docs: DataFrame, radius: int = 4, text: str = "text") -> DataFrame:
    """One row a document: doc_id, fingerprint (16 hex digits), component_id (the smallest doc_id reachable)."""
    fps = cut(with_fingerprint(docs.select("doc_id", text), "fp", text).select("doc_id", "fp"), "fingerprints")
    nodes = cut(fps.groupBy("fp").agg(F.min("doc_id").alias("first_id")), "nodes")
    roots = classes(link_edges(nodes, radius))
    named = cut(nodes.join(roots, "fp", "left").withColumn("root", F.coalesce("root", "fp")), "named")
    ids = named.groupBy("root").agg(F.min("first_id").alias("component_id"))
    of = spread_join(named.select("fp", "root"), ids, "root", "fp").select("fp", "component_id")
    return spread_join(fps, of, "fp", "doc_id").select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
