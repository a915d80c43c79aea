"""Labelling rows by a client that may fail: retries with growing delays, failures in a table of their own, runs that can be resumed.

A labeler is any object with ``name``, ``model`` and ``client()``, which is called once in each task and returns a function: row (dict) -> text, or a dict with
``reasoning`` and, as far as known, ``action``, ``tokens_prompt`` and ``tokens_completion``.  Services are reached through such a client; ``Template`` needs none.

A run writes chunks of rows and then commits each chunk's ids in a manifest.  Only committed rows are read: a crash between the two leaves rows that no one sees and
that the next run labels again, so a row is neither lost nor doubled.
"""

from __future__ import annotations

import json
import time
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Observation, SparkSession, functions as F, types as T

from .functions import prompts, reasoning
from .sources.shared import exists


class LabelerError(RuntimeError):
    """A row could not be labelled after all retries."""


TRACE = T.StructType(
    [
        T.StructField("reasoning", T.StringType()),
        T.StructField("action", T.StringType()),
        T.StructField("labeler", T.StringType()),
        T.StructField("labeler_model", T.StringType()),
        T.StructField("tokens_prompt", T.LongType()),
        T.StructField("tokens_completion", T.LongType()),
        T.StructField("latency_ms", T.DoubleType()),
        T.StructField("attempts", T.IntegerType()),
        T.StructField("error", T.StringType()),
    ]
)


@dataclass
class Labeler:
    """A labeler around ``make``, which builds the client in the task; it and what it returns must be picklable by Spark."""

    make: Callable[[], Callable[[dict], str | dict]]
    name: str = "client"
    model: str | None = None

    def client(self) -> Callable[[dict], str | dict]:
        return self.make()


#: What a labeler is told to do, by the style of the text.
SYSTEM = {
    "concise": "You explain decisions in no-limit hold'em. You get a situation and the action that a solver chose. In two to four sentences say why that action is right: position, hand, stack, pot odds. Do not question the action. End with a line 'Decision: ' and the action as given.",
    "structured": "You explain decisions in no-limit hold'em. You get a situation and the action that a solver chose. Answer in three sections, headed '### Strategic Analysis' (a numbered list), '### Mathematical Calculations' (a list of the numbers that matter) and '### Action' (the action as given, on one line). Write nothing outside of them.",
}


def asked(rows: DataFrame, style: str = "concise") -> DataFrame:
    """``rows`` (instruction, output) with ``system`` and ``prompt``, the two messages that a chat service is sent."""
    if style not in SYSTEM:
        raise ValueError(f"style is one of {sorted(SYSTEM)}")
    return rows.withColumns({"system": F.lit(SYSTEM[style]), "prompt": prompts.labeler_prompt(F.col("instruction"), F.col("output"))})


def labelled(rows: DataFrame, labeler: Labeler, retries: int = 3, base_delay: float = 1.0, fail_fast: bool = False, sleep: Callable[[float], None] = time.sleep) -> DataFrame:
    """``rows`` (row_id, instruction, output, ...) with the fields of TRACE; ``error`` tells why a row has no label after all retries.

    Delays between attempts are base_delay times 2**attempt.  With ``fail_fast`` the first failure raises LabelerError and ends the job.  An action that the client doesn't name
    is the row's output.
    """
    if retries < 1:
        raise ValueError("at least one attempt is needed")
    fields = {f.name: f.dataType for f in TRACE.fields}
    clash = [c for c in rows.columns if c in fields]
    if clash:
        raise ValueError(f"rows have columns that a label has: {clash}")
    schema = T.StructType([*rows.schema.fields, *TRACE.fields])
    kinds = [pa.string()] * 4 + [pa.int64()] * 2 + [pa.float64(), pa.int32(), pa.string()]

    def one(client, row: dict) -> tuple:
        error = None
        for attempt in range(retries):
            began = time.perf_counter()
            try:
                said = client(row)
                said = {"reasoning": said} if isinstance(said, str) else dict(said)
                if not (said.get("reasoning") or "").strip():
                    raise ValueError("the client returned no text")
                latency = (time.perf_counter() - began) * 1000
                action = (said.get("action") or row.get("output") or "").strip()
                return said["reasoning"], action, labeler.name, labeler.model, said.get("tokens_prompt"), said.get("tokens_completion"), latency, attempt + 1, None
            except Exception as e:  # any error of a service is tried again
                error = e
                if attempt + 1 < retries:
                    sleep(base_delay * 2**attempt)
        said = f"{labeler.name} failed after {retries} attempts: {type(error).__name__}: {error}"
        if fail_fast:
            raise LabelerError(f"{said} (row {row.get('row_id')})")
        return None, None, labeler.name, labeler.model, None, None, None, retries, said

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        client = None
        for batch in batches:
            if not batch.num_rows:
                continue
            client = client or labeler.client()
            made = [one(client, row) for row in batch.to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(c, k) for c, k in zip(zip(*made), kinds))], names=schema.names)

    return rows.mapInArrow(run, schema)


def template(rows: DataFrame, style: str = "concise") -> DataFrame:
    """Rows labelled by rules, without any client: the same columns as ``labelled``, as expressions."""
    said = {"concise": reasoning.concise, "structured": reasoning.structured}[style](F.col("instruction"), F.col("output"))
    given = {"reasoning": said, "action": F.trim("output"), "labeler": F.lit("template"), "latency_ms": F.lit(0.0), "attempts": F.lit(1)}
    return rows.select(*rows.columns, *[given.get(f.name, F.lit(None)).cast(f.dataType).alias(f.name) for f in TRACE.fields])


# Runs


@dataclass
class Result:
    """What a run did; the failed ids are a table (``failures``), here are the first of them."""

    n_input: int = 0
    n_skipped: int = 0
    n_written: int = 0
    n_failed: int = 0
    failed_row_ids: list[str] = field(default_factory=list)
    elapsed_s: float = 0.0


MANIFEST = "row_id string, chunk string"
#: Failed ids that a result names.
NAMED = 100


def committed(spark: SparkSession, out: str) -> DataFrame:
    """(row_id, chunk) of all rows that count."""
    path = f"{out}/manifest"
    return spark.read.schema(MANIFEST).parquet(path) if exists(spark, path) else spark.createDataFrame([], MANIFEST)


def read(spark: SparkSession, out: str) -> DataFrame:
    """The labelled rows of committed chunks; chunks are few."""
    chunks = committed(spark, out).select("chunk").distinct()
    return spark.read.parquet(f"{out}/rows").join(F.broadcast(chunks), "chunk", "left_semi").drop("chunk")


def failures(spark: SparkSession, out: str) -> DataFrame:
    """(row_id, error, attempts, chunk) of the rows that failed and have not been labelled since."""
    path = f"{out}/failures"
    if not exists(spark, path):
        return spark.createDataFrame([], "row_id string, error string, attempts int, chunk string")
    return spark.read.parquet(path).join(committed(spark, out).select("row_id"), "row_id", "left_anti")


def run(
    rows: DataFrame,
    label: Callable[[DataFrame], DataFrame],
    out: str,
    resume: bool = True,
    limit: int | None = None,
    order: str | Column = "row_id",
    chunk_rows: int = 100_000,
    progress: Callable[[Result], None] | None = None,
    between: Callable[[str], None] | None = None,
) -> Result:
    """Label the rows (row_id, ...) that ``out`` does not hold yet, chunk by chunk; without ``resume`` what it holds counts no more.

    ``limit``: only the first so many rows by ``order`` are looked at; those already done count among them.  A row_id that comes twice is labelled once.  ``label`` is
    ``labelled`` or ``template`` with its settings.  ``progress`` is called after each chunk, ``between`` after a chunk's rows are written and before they are committed.
    """
    spark, began, result = rows.sparkSession, time.perf_counter(), Result()
    if not resume:
        spark.createDataFrame([], MANIFEST).write.mode("overwrite").parquet(f"{out}/manifest")
    if limit is not None:
        rows = rows.orderBy(order).limit(limit)
    rows = rows.dropDuplicates(["row_id"])
    path = f"{out}/input/{uuid.uuid4().hex}"
    done = committed(spark, out).select("row_id", F.lit(True).alias("_done"))
    rows.join(done, "row_id", "left").write.parquet(path)
    both = spark.read.parquet(path)
    result.n_input, result.n_skipped = both.agg(F.count("*"), F.count("_done")).first()
    todo = both.where("_done is null").drop("_done")
    chunks = max(1, -(-(result.n_input - result.n_skipped) // chunk_rows))
    for i in range(chunks if result.n_input > result.n_skipped else 0):
        chunk = uuid.uuid4().hex
        part = todo if chunks == 1 else todo.where(F.pmod(F.xxhash64("row_id"), F.lit(chunks)) == i)
        # The client is asked once a row: what it said is written before it is split.
        seen = Observation()
        place = f"{out}/rows/chunk={chunk}"
        asked = f"{out}/asked/{chunk}"
        label(part).observe(seen, F.count_if(F.col("error").isNull()).alias("written"), F.count_if(F.col("error").isNotNull()).alias("failed")).write.parquet(asked)
        said = spark.read.parquet(asked)
        said.where("error is null").drop("error").write.parquet(place)
        if seen.get["failed"]:
            said.where("error is not null").select("row_id", "error", "attempts", F.lit(chunk).alias("chunk")).write.mode("append").parquet(f"{out}/failures")
            names = said.where("error is not null").select("row_id").limit(NAMED - len(result.failed_row_ids)) if len(result.failed_row_ids) < NAMED else None
            result.failed_row_ids += [r[0] for r in names.collect()] if names is not None else []
        if between:
            between(chunk)
        said.where("error is null").select("row_id", F.lit(chunk).alias("chunk")).write.mode("append").parquet(f"{out}/manifest")
        result.n_written += seen.get["written"]
        result.n_failed += seen.get["failed"]
        if progress:
            progress(result)
    result.elapsed_s = time.perf_counter() - began
    return result


def to_messages(rows: DataFrame, system: str, style: str = "concise") -> DataFrame:
    """Labelled rows as chat records with what is known of the label as metadata."""
    content = (prompts.enforce_structured if style == "structured" else prompts.enforce_decision)(F.col("reasoning"), F.col("action"))
    known = {"row_id": F.col("row_id"), "gold_action": F.col("action"), "labeler": F.col("labeler"), "labeler_model": F.col("labeler_model"), "tokens_prompt": F.col("tokens_prompt").cast("string"), "tokens_completion": F.col("tokens_completion").cast("string"), "style": F.lit(style)}
    meta = F.map_filter(F.create_map(*[x for k, v in known.items() for x in (F.lit(k), v)]), lambda k, v: v.isNotNull())
    return rows.select(prompts.messages(F.lit(system), F.col("instruction"), content).alias("messages"), meta.alias("metadata"))


def inspect(spark: SparkSession, folder: str, n: int = 3) -> list[str]:
    """The first records of a folder of chat records, as texts for a person."""
    rows = spark.read.schema("messages array<struct<role:string,content:string>>, metadata map<string,string>").json(folder).limit(n).collect()
    out = []
    for r in rows:
        said = "\n".join(f"--- {m['role']} ---\n{m['content']}" for m in r["messages"] or [])
        out.append(f"{json.dumps(dict(r['metadata'] or {}), sort_keys=True)}\n{said}")
    return out
