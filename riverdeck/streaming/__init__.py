"""Structured Streaming forms of the stateful operators."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_json(spark: SparkSession, folder: str, schema: str, files: int = 16) -> DataFrame:
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).json(folder)


def augment(stream: DataFrame, label: Callable[[DataFrame], DataFrame], out: str, checkpoint: str):
    """Label rows (row_id, ...) as they arrive and append them under ``out``, each row_id once.

    Each batch is written to a folder of its own, in which a repeated batch replaces itself; row_ids already written by earlier batches are
    left out by an anti join, so a restart neither loses nor doubles rows.  ``label`` adds its columns to a DataFrame.
    """
    spark = stream.sparkSession

    def write(batch: DataFrame, number: int) -> None:
        fresh = batch.dropDuplicates(["row_id"])
        try:
            done = spark.read.parquet(f"{out}/batch=*").where(F.col("batch") < number).select("row_id")
        except Exception as e:  # nothing is written yet
            if "PATH_NOT_FOUND" not in str(e):
                raise
            done = None
        if done is not None:
            fresh = fresh.join(done, "row_id", "left_anti")
        label(fresh).withColumn("batch", F.lit(number)).write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def population(stream: DataFrame) -> DataFrame:
    """Running counters of each position over a stream of hands (hand_id, events): only a position's first action in a hand counts.

    A hand is one row, so its first actions and the raises before them are worked out inside the row, and the state is one row a position.
    """
    e = F.col("events")
    first = F.filter(F.transform(e, lambda x, i: F.struct(x["position"].alias("position"), x["action"].alias("action"), i.alias("i"))), lambda x: F.size(F.filter(F.slice(e, 1, x["i"]), lambda y: y["position"] == x["position"])) == 0)
    one = stream.select(F.explode(F.transform(first, lambda x: F.struct(x["position"].alias("position"), x["action"].alias("action"), F.exists(F.filter(first, lambda y: y["i"] < x["i"]), lambda y: y["action"].isin("raise", "allin")).alias("facing")))).alias("x")).select("x.*")
    n = lambda c: F.sum(c.cast("int"))
    raised = F.col("action").isin("raise", "allin")
    return one.groupBy("position").agg(F.count("*").alias("hands"), n(F.col("action").isin("call", "raise", "allin")).alias("vpip_n"), n(raised).alias("pfr_n"), n(raised & F.col("facing")).alias("three_bet_n"), n(F.col("facing")).alias("facing_n"), n(F.col("facing") & (F.col("action") == "fold")).alias("fold_n"))
