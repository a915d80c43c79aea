"""Pieces that several operators share: table access, lineage cuts, Arrow maps, word splitting."""

from __future__ import annotations

import ctypes
import tempfile
import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

#: ASCII white space that separates words of the class ``[^\x20\x09-\x0D]+``; ``bytes.split()`` cuts at the same six bytes.
WHITESPACE = b" \t\n\r\x0b\x0c"

#: Maps a byte to itself if it belongs to a word of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after A-Z are lower-cased, else to a space.
ALNUM = bytes(
    c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256)
)

#: Text handled at once inside a task, in bytes.
SLICE_BYTES = 2 << 20


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: ``spark.checkpoint.dir``.

    Where the session names none, a temporary folder serves a local master (driver and tasks are one process there); on a cluster that is an error.
    """
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        master = spark.conf.get("spark.master", "")
        if not master.startswith("local") or master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        place = tempfile.mkdtemp(prefix="riverdeck-")
        spark.conf.set("spark.checkpoint.dir", place)
    return place


def fresh(df: DataFrame, name: str) -> str:
    """``name``, with as many underscores before it as make it differ from every column of ``df``."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name


def id_kind(df: DataFrame, column: str = "doc_id") -> T.DataType:
    """How an operator carries ids inside its tasks: whole numbers as long, ids of any other type as text; results have the column's own type again."""
    return T.LongType() if isinstance(df.schema[column].dataType, T.IntegralType) else T.StringType()


def cut(df: DataFrame, label: str) -> DataFrame:
    """Write ``df`` to the shared folder and read it back: its lineage ends there and survives lost executors."""
    path = f"{shared_dir(df.sparkSession)}/{label}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def words(text: bytes) -> list[bytes]:
    """Words of ``[^\x20\x09-\x0D]+``."""
    return text.split()


def alnum_words(text: bytes) -> list[bytes]:
    """A-Z lower-cased, words of ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+``."""
    return text.translate(ALNUM).split()


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cut a batch so that each part holds at most ``limit`` bytes of text, one row at least."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    sizes = np.asarray(pa.compute.fill_null(pa.compute.binary_length(column), 0), dtype=np.int64)
    ends = np.cumsum(sizes)
    at = 0
    while at < batch.num_rows:
        base = ends[at - 1] if at else 0
        to = max(at + 1, int(np.searchsorted(ends, base + limit, "right")))
        yield batch.slice(at, to - at)
        at = to


def texts(batch: pa.RecordBatch, text: str = "text") -> list[bytes]:
    """The texts as bytes; a null is an empty text."""
    column = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary())
    return [x or b"" for x in column.to_pylist()]


def released(run: Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]) -> Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]:
    """``run``, and at its end the memory it used goes back to the machine: Spark keeps workers for later tasks, and what the C library holds counts against the executor."""

    def to_end(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc has it
        if trim:
            trim(0)

    return to_end


def add_columns(
    df: DataFrame,
    make: Callable[[], Callable[[pa.RecordBatch], list]],
    fields: list[T.StructField],
    text: str = "text",
) -> DataFrame:
    """Append columns that a Python function computes from slices of rows; no row moves.

    ``make`` is called once in each task and returns the function; that returns one
    list or array for each of ``fields``.  A column of ``df`` whose name (in any case) is one of
    the new names is replaced.
    """
    new = {f.name.lower() for f in fields}
    df = df.select(*[F.col(f"`{c}`") for c in df.columns if c.lower() not in new])
    schema = T.StructType([*df.schema.fields, *fields])
    from pyspark.sql.pandas.types import to_arrow_type

    kinds = [to_arrow_type(f.dataType) for f in fields]
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        work = make()
        for whole in batches:
            for batch in slices(whole, text):
                made = [
                    x if isinstance(x, pa.Array) else pa.array(x, kind)
                    for x, kind in zip(work(batch), kinds, strict=True)
                ]
                yield pa.RecordBatch.from_arrays([*batch.columns, *made], names=names)

    return df.mapInArrow(released(run), schema)


def labelled_sample(spark: SparkSession, labels: DataFrame, column: str, limit: int, where=None) -> DataFrame:
    """At most ``limit`` labelled doc_ids, the first by a hash of the id: (doc_id, label), one row an id.

    The bound makes the result safe to broadcast: ``limit`` rows of 12 bytes.
    """
    rows = labels.where(F.col("doc_id").isNotNull() & F.col(column).isNotNull())
    if where is not None:
        rows = rows.where(where)
    rows = rows.groupBy("doc_id").agg(F.max(column).cast("int").alias("label"))
    # With many more labels than wanted, a share of the hash range keeps nearly as many as wanted, so that the sort below is of a bounded number of rows.
    n = rows.count()
    if n > limit:
        least, span = -(1 << 63), 1 << 64
        rows = rows.where(F.xxhash64("doc_id") <= F.lit(least + min(span - 1, int(span * 1.1 * limit / n))).cast("long"))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit)


class Numbering(dict):
    """Gives each new key the next number."""

    def __missing__(self, key):
        self[key] = n = len(self)
        return n


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers (the finaliser of splitmix64)."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x
