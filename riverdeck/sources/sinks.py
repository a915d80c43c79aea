"""Writers: JSON lines, CSV, Parquet, JDBC, rendered query results."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..functions import prompts
from ..operators import promptdb, rewards


def samples_jsonl(df: DataFrame, folder: str) -> None:
    """Ingested samples without their raw row."""
    df.drop("raw").write.mode("overwrite").json(folder)


def read_samples_jsonl(spark: SparkSession, folder: str, schema: T.StructType) -> DataFrame:
    return spark.read.schema(schema).json(folder)


def features_parquet(df: DataFrame, folder: str) -> None:
    """Features and their label as ``_label``."""
    df.withColumnRenamed("label", "_label").write.mode("overwrite").parquet(folder)


def sft_jsonl(pairs: DataFrame, folder: str, system: str, preflop_only: bool = True) -> None:
    rewards.scenario_records(pairs, system, preflop_only).write.mode("overwrite").json(folder)


def trajectories_jsonl(decisions: DataFrame, hands: DataFrame, folder: str, with_reward: bool = True, condition=None, summary: bool = False) -> int:
    """One line a decision, filtered by ``condition``; or one a hand, not filtered.  Returns the number of lines."""
    if summary:
        out = hands
    else:
        out = rewards.attach(decisions, hands) if with_reward else decisions
        if condition is not None:
            out = out.where(condition)
    out.write.mode("overwrite").json(folder)
    return out.sparkSession.read.json(folder).count() if out.columns else 0


def legacy_dual(df: DataFrame, folder: str) -> None:
    """CSV, with arrays, maps and structs as JSON texts, and Parquet."""
    nested = (T.ArrayType, T.MapType, T.StructType)
    flat = df.select(*[F.to_json(f.name).alias(f.name) if isinstance(f.dataType, nested) else F.col(f.name) for f in df.schema])
    flat.write.mode("overwrite").option("header", True).option("escape", '"').csv(f"{folder}/csv")
    df.write.mode("overwrite").parquet(f"{folder}/parquet")


FORMATS = ("alpaca", "chatml", "plain")


def instruction_text(df: DataFrame, style: str = "alpaca") -> DataFrame:
    """(text) of pairs (instruction, output) in one of three layouts."""
    i, o = F.trim("instruction"), F.trim("output")
    if style == "alpaca":
        text = F.concat(F.lit("### Instruction:\n"), i, F.lit("\n\n### Response:\n"), o)
    elif style == "chatml":
        text = F.concat(F.lit("<|im_start|>user\n"), i, F.lit("<|im_end|>\n<|im_start|>assistant\n"), o, F.lit("<|im_end|>"))
    elif style == "plain":
        text = F.concat(i, F.lit("\n"), o)
    else:
        raise ValueError(f"style is one of {FORMATS}")
    return df.select(text.alias("text"))


def jdbc_load(tables: dict[str, DataFrame], url: str, properties: dict[str, str]) -> None:
    """The six tables to a database, in loading order; flags as booleans."""
    for name in promptdb.LOAD_ORDER:
        df = tables[name]
        flags = [c for c in df.columns if c.startswith(("hero_is_", "is_"))]
        df.withColumns({c: F.col(c) == 1 for c in flags}).write.mode("overwrite").jdbc(url, name, properties=properties)


def export_catalog(spark: SparkSession, folder: str) -> list[str]:
    """Every table and view of the current catalog as Parquet."""
    names = sorted(t.name for t in spark.catalog.listTables())
    for name in names:
        spark.table(name).write.mode("overwrite").parquet(f"{folder}/{name}")
    return names


def render(df: DataFrame, style: str = "table", limit: int | None = 50) -> str:
    """A result as a table, CSV or JSON.  The limit goes into the plan; CSV has none."""
    if style == "csv":
        limit = None
    rows = (df if limit is None else df.limit(limit)).collect()  # shown to a person
    if not rows:
        return "(no rows)"
    if style == "json":
        return json.dumps([r.asDict(True) for r in rows], default=str)
    cells = [list(df.columns), *[["" if v is None else str(v) for v in r] for r in rows]]
    if style == "csv":
        quoted = lambda v: f'"{v.replace(chr(34), chr(34) * 2)}"' if any(c in v for c in ',"\n') else v
        return "\n".join(",".join(map(quoted, r)) for r in cells)
    widths = [max(len(r[i]) for r in cells) for i in range(len(df.columns))]
    return "\n".join("  ".join(v.ljust(w) for v, w in zip(r, widths)).rstrip() for r in cells)


def stats(tables: dict[str, DataFrame]) -> DataFrame:
    """(kind, name, n): counts of tables, splits, decision types, labels, and the 15 commonest raw labels."""
    s = tables["situations"]
    parts = [df.agg(F.count("*").alias("n")).select(F.lit("table").alias("kind"), F.lit(name).alias("name"), "n") for name, df in tables.items()]
    parts += [s.groupBy(F.col(c).alias("name")).agg(F.count("*").alias("n")).select(F.lit(c).alias("kind"), "name", "n") for c in ("split", "decision_type", "canonical_label")]
    parts.append(tables["label_taxonomy"].orderBy(F.desc("n_occurrences"), "raw_label").limit(15).select(F.lit("raw_label").alias("kind"), F.col("raw_label").alias("name"), F.col("n_occurrences").alias("n")))
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def augmented(df: DataFrame, system: str) -> DataFrame:
    """Labelled rows (row_id, instruction, reasoning, action, labeler, meta map) as chat records; keys of ``meta`` win over the record's own."""
    content = prompts.enforce_decision(F.col("reasoning"), F.col("action"))
    own = F.create_map(F.lit("row_id"), F.col("row_id"), F.lit("gold_action"), F.col("action"), F.lit("labeler"), F.col("labeler"))
    meta = F.coalesce("meta", F.create_map().cast("map<string,string>"))
    merged = F.map_concat(F.map_filter(own, lambda k, v: ~F.map_contains_key(meta, k)), meta)
    return df.select(prompts.messages(F.lit(system), F.col("instruction"), content).alias("messages"), merged.alias("metadata"))
