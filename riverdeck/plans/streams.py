"""Streaming queries, run to the end of what is there."""

from __future__ import annotations

from pyspark.sql import functions as F

from .. import streaming
from ..functions import prompts
from ..operators import features
from ..sources import bridge
from ..sources.shared import place as _place
from ..streaming import hands
from . import duck
from .registry import query
from .scenario import _POP


@query("stm_augment_resume", "select substr(sha1(text), 1, 16) as row_id, min(concat(text, '.')) as output from documents where text is not null group by 1")
def stm_augment_resume(spark, sf):
    """Documents arrive as JSON in two goes; the second go finds the first one's rows done."""
    place = _place(spark, "augment")
    docs = spark.read.parquet(f"{sf}/documents.parquet").where("text is not null").select(prompts.row_id(F.col("text")).alias("row_id"), "text")
    label = lambda df: df.select("row_id", F.concat("text", F.lit(".")).alias("output"))
    for part in (docs.where("pmod(xxhash64(row_id), 2) = 0"), docs):
        part.write.mode("append").json(f"{place}/in")
        streaming.augment(streaming.read_json(spark, f"{place}/in", "row_id string, text string"), label, f"{place}/out", f"{place}/state").awaitTermination()
    return spark.read.parquet(f"{place}/out").select("row_id", "output")


@query("stm_population_observe", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _POP + "select position, hands, cast(round(vpip * hands) as bigint) as vpip_n, cast(round(pfr * hands) as bigint) as pfr_n from pop")
def stm_population_observe(spark, sf):
    place = _place(spark, "population")
    features.samples(bridge.scenarios(spark, sf)).select(F.col("source_index").alias("hand_id"), "events").write.json(f"{place}/in")
    stream = streaming.read_json(spark, f"{place}/in", "hand_id long, events array<struct<position:string,action:string,amount_bb:double>>")
    counts = streaming.population(stream)

    def write(batch, number):
        batch.write.mode("overwrite").parquet(f"{place}/out")

    counts.writeStream.outputMode("complete").foreachBatch(write).option("checkpointLocation", f"{place}/state").trigger(availableNow=True).start().awaitTermination()
    return spark.read.parquet(f"{place}/out").select("position", "hands", "vpip_n", "pfr_n")


@query("stm_population_events", duck.with_(duck.RAW, duck.EVENTS).rstrip() + _POP + "select position, hands, cast(round(vpip * hands) as bigint) as vpip_n, cast(round(pfr * hands) as bigint) as pfr_n from pop")
def stm_population_events(spark, sf):
    """The same counters from single actions that arrive out of order, in several batches, by state kept for each hand."""
    place = _place(spark, "actions")
    events = features.samples(bridge.scenarios(spark, sf)).select(F.col("source_index").alias("hand_id"), F.posexplode("events").alias("seq", "e")).select("hand_id", "seq", "e.position", "e.action", F.timestamp_seconds(F.col("seq") + 1_700_000_000).alias("at"))
    events.write.parquet(f"{place}/events")
    events = spark.read.parquet(f"{place}/events")
    for i in range(2):
        events.where(F.pmod(F.xxhash64("hand_id", "seq"), F.lit(2)) == i).write.mode("append").json(f"{place}/in")
    # A go's files make a batch.
    files = -(-len(spark.read.text(f"{place}/in").inputFiles()) // 2)
    stream = streaming.read_json(spark, f"{place}/in", "hand_id long, seq int, position string, action string, at timestamp", files=files)
    hands.observe(stream, f"{place}/out", f"{place}/state").awaitTermination()
    return hands.counters(spark.read.parquet(f"{place}/out")).select("position", "hands", "vpip_n", "pfr_n")
