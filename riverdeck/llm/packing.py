"""Token ids packed into rows of one width: best-fit-decreasing with a segment tree over free capacities.

Each document's ids, ended by the end token, are cut into segments of at most ``width`` ids (lossless); the segments of a block of
documents are put, longest first, each into the row with the least free room that still holds it.  The row is
found in a segment tree whose leaves are free capacities.  A task packs its own documents in blocks of ``block`` ids, so
nothing is shuffled, no task holds more than a block (or one document), and the waste of a block is at most a part of its last rows.

A packed row: ``ids`` (little-endian, 16 bit if the vocabulary and the end token fit, else 32; filled up with the end token to ``width``), ``cu_seqlens`` (cumulative segment lengths, from
0), ``reset_at`` (where the position starts again from 0), ``doc_ids`` and ``chunks`` (which part of which document each segment is), ``n_tokens``, ``doc_ends`` (whether
the segment ends its document).

Defined cases: a null text is left out; an empty text is one end token; a document of any length is whole; repeated rows are each packed; a
null doc_id stays null; ids of any type are kept as they are; an empty table gives an empty result; extra columns are ignored.
"""

from __future__ import annotations

import base64

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import id_kind, slices

NAMES = ("n_tokens", "ids", "cu_seqlens", "reset_at", "doc_ids", "chunks", "doc_ends")
_KINDS = {"bigint": pa.int64(), "string": pa.string()}


class Capacities:
    """Rows by free capacity: ``take(n)`` gives a row of the least capacity that is at least n."""

    def __init__(self, width: int):
        self.size = 1
        while self.size <= width:
            self.size *= 2
        self.tree = bytearray(2 * self.size)  # 1: some row at or below this node
        self.rows: dict[int, list[int]] = {}

    def put(self, row: int, free: int) -> None:
        self.rows.setdefault(free, []).append(row)
        i = free + self.size
        while i and not self.tree[i]:
            self.tree[i] = 1
            i >>= 1

    def take(self, n: int) -> tuple[int, int] | None:
        i = n + self.size
        if not self.tree[i]:
            while True:  # up, until there is something to the right
                if i == 1:
                    return None
                if not i & 1 and self.tree[i + 1]:
                    i += 1
                    break
                i >>= 1
            while i < self.size:  # down, to the leftmost
                i = 2 * i if self.tree[2 * i] else 2 * i + 1
        free = i - self.size
        row = self.rows[free].pop()
        if not self.rows[free]:
            self.tree[i] = 0
            i >>= 1
            while i and not (self.tree[2 * i] or self.tree[2 * i + 1]):
                self.tree[i] = 0
                i >>= 1
        return row, free


def best_fit(lengths: list[int], width: int) -> list[list[int]]:
    """Rows of item numbers: best-fit-decreasing, the earlier of equal items first."""
    free, rows = Capacities(width), []
    for item in sorted(range(len(lengths)), key=lambda i: -lengths[i]):
        n = lengths[item]
        found = free.take(n)
        if found is None:
            row, room = len(rows), width
            rows.append([])
        else:
            row, room = found
        rows[row].append(item)
        if room > n:
            free.put(row, room - n)
    return rows


def _encoding(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("pieces", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def id_type(ids: int) -> str:
    """The numpy type of ids below ``ids``."""
    return "<u2" if ids <= 1 << 16 else "<u4"


def pack(docs: DataFrame, vocabulary: str, end: int | None = None, width: int = 2048, block: int = 1 << 21, text: str = "text") -> DataFrame:
    """Packed rows of all documents; ``vocabulary`` is a file of byte-pair ranks that every worker can read; ``end`` is the id after its last one unless given."""

    carried = id_kind(docs).simpleString()
    own = docs.schema["doc_id"].dataType.simpleString()

    def run(batches):
        encoding = _encoding(vocabulary)
        end_ = encoding.n_vocab if end is None else end
        kind = id_type(max(encoding.n_vocab, end_ + 1))
        held, size = [], 0  # (doc_id, ids)

        def flush():
            parts = [(doc, k, ids[a : a + width], a + width >= len(ids)) for doc, ids in held for k, a in enumerate(range(0, len(ids), width))]
            made = [[], [], [], [], [], [], []]
            for row in best_fit([len(p[2]) for p in parts], width):
                inside = [parts[i] for i in row]
                ends = np.cumsum([len(p[2]) for p in inside]).tolist()
                flat = np.full(width, end_, kind)
                flat[: ends[-1]] = np.concatenate([p[2] for p in inside])
                for column, value in zip(made, (ends[-1], flat.tobytes(), [0, *ends], [0, *ends[:-1]], [p[0] for p in inside], [p[1] for p in inside], [p[3] for p in inside])):
                    column.append(value)
            kinds = (pa.int32(), pa.binary(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(_KINDS[carried]), pa.list_(pa.int32()), pa.list_(pa.bool_()))
            return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(made, kinds)], names=NAMES)

        for whole in batches:
            for batch in slices(whole, text):
                for doc, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                    if x is None:
                        continue
                    ids = np.append(np.array(encoding.encode_ordinary(x), kind), np.array([end_], kind))
                    held.append((doc, ids))
                    size += len(ids)
                    if size >= block:
                        yield flush()
                        held, size = [], 0
        if held:
            yield flush()

    schema = f"n_tokens int, ids binary, cu_seqlens array<int>, reset_at array<int>, doc_ids array<{carried}>, chunks array<int>, doc_ends array<boolean>"
    packed = docs.select(F.col("doc_id").cast(carried).alias("doc_id"), F.col(text)).mapInArrow(run, schema)
    return packed if own == carried else packed.withColumn("doc_ids", F.col("doc_ids").cast(f"array<{own}>"))


def unpack(packed: DataFrame, width: int = 2048) -> DataFrame:
    """The segments of rows of ``width`` ids again: doc_id, chunk, doc_end and ids (array<int>); those of a document in order of chunk are its ids."""

    own = packed.schema["doc_ids"].dataType.elementType.simpleString()
    carried = id_kind(packed.select(F.explode("doc_ids").alias("doc_id"))).simpleString()

    def run(batches):
        for batch in batches:
            out = [[], [], [], []]
            for ids, cuts, docs, chunks, ends in zip(*[batch.column(i).to_pylist() for i in range(5)]):
                flat = np.frombuffer(ids, "<u2" if len(ids) == 2 * width else "<u4")
                for a, b, doc, chunk, e in zip(cuts, cuts[1:], docs, chunks, ends):
                    for column, value in zip(out, (doc, chunk, e, flat[a:b].tolist())):
                        column.append(value)
            kinds = (_KINDS[carried], pa.int32(), pa.bool_(), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds)], names=["doc_id", "chunk", "doc_end", "ids"])

    rows = packed.select("ids", "cu_seqlens", F.col("doc_ids").cast(f"array<{carried}>").alias("doc_ids"), "chunks", "doc_ends")
    return rows.mapInArrow(run, f"doc_id {carried}, chunk int, doc_end boolean, ids array<int>").withColumn("doc_id", F.col("doc_id").cast(own))
