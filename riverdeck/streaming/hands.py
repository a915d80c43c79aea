"""Statistics of positions from single actions as they arrive, in any order: keyed state by hand, hands being kept together in bundles.

The state of a hand remembers the number of the action that comes next, whether a raise was seen, who has acted, and actions that came too early.  An action is
told on as soon as all before it are in; a timer that fires when the events' time has moved on closes the hand: what is left is told in its order, without the missing ones, and the state goes.
"""

from __future__ import annotations

import json
from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StatefulProcessor, StatefulProcessorHandle

ACTED = "hand_id long, position string, action string, facing boolean"
RAISES = ("raise", "allin")
ROCKSDB = "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"


def _tell(position: str, action: str, raised: bool, acted: list, told: list) -> bool:
    if position in acted:
        return raised
    acted.append(position)
    told.append((position, action, raised))
    # A raise counts for those after it only if it was a position's first action.
    return raised or action in RAISES


class FirstActions(StatefulProcessor):
    """Rows (hand_id, seq, position, action, at) to one row for each position's first action in a hand, with whether a raise was before it."""

    def __init__(self, quiet_ms: int = 3_600_000):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        # One value a hand, so that a batch reads and writes it once: lists as texts.
        self.state = handle.getValueState("hand", "next int, raised boolean, acted string, waiting string, seen long")

    _tell = staticmethod(_tell)

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        was = self.state.get()
        seen = was[4] if was else 0
        next_, raised, acted, waiting = (was[0], was[1], json.loads(was[2]), {int(k): v for k, v in json.loads(was[3]).items()}) if was else (0, False, [], {})
        for part in rows:
            seen = max(seen, int(part["at"].max().timestamp() * 1000))
            for seq, position, action in zip(part["seq"].tolist(), part["position"].tolist(), part["action"].tolist()):
                if seq >= next_:  # one that was told comes again after a restart
                    waiting[int(seq)] = (position, action)
        told: list = []
        while next_ in waiting:
            raised = self._tell(*waiting.pop(next_), raised, acted, told)
            next_ += 1
        self.state.update((next_, raised, json.dumps(acted), json.dumps(waiting), seen))
        if not was:
            self.handle.registerTimer(seen + self.quiet_ms)
        yield self._frame(key, told)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        was = self.state.get()
        if not was:
            return
        _, raised, acted, waiting, seen = was
        if seen + self.quiet_ms > timerValues.getCurrentWatermarkInMs():  # something came since
            self.handle.registerTimer(seen + self.quiet_ms)
            return
        told: list = []
        acted = json.loads(acted)
        for _, (position, action) in sorted((int(k), v) for k, v in json.loads(waiting).items()):
            raised = self._tell(position, action, raised, acted, told)
        self.state.clear()
        yield self._frame(key, told)

    def _frame(self, key, told: list) -> pd.DataFrame:
        text = lambda i: pd.Series([t[i] for t in told], dtype=object)
        return pd.DataFrame({"hand_id": pd.Series([int(key[0])] * len(told), dtype="int64"), "position": text(0), "action": text(1), "facing": pd.Series([bool(t[2]) for t in told], dtype=bool)})

    def close(self) -> None:
        pass


class BundledFirstActions(StatefulProcessor):
    """``FirstActions`` for the hands of a bundle together: a batch reads and writes one state value a bundle, not one a hand.

    The value has for each open hand what comes next, whether a raise was seen, who has acted, what waits, and the latest time; and the earliest timer that is set.
    """

    def __init__(self, quiet_ms: int = 3_600_000):
        self.quiet_ms = quiet_ms

    def init(self, handle: StatefulProcessorHandle) -> None:
        self.handle = handle
        self.state = handle.getValueState("bundle", "hands string, timer long")

    def _load(self) -> tuple[dict, int | None]:
        was = self.state.get()
        return ({h: [n, r, a, {int(k): v for k, v in w.items()}, s] for h, n, r, a, w, s in json.loads(was[0])}, was[1]) if was else ({}, None)

    def _save(self, open_: dict, timer: int) -> None:
        self.state.update((json.dumps([(h, *x) for h, x in open_.items()]), timer))

    def handleInputRows(self, key, rows: Iterator[pd.DataFrame], timerValues) -> Iterator[pd.DataFrame]:
        open_, timer = self._load()
        touched, out = set(), []
        for part in rows:
            at = part["at"].astype("datetime64[ms]").astype("int64")
            for hand, seq, position, action, ms in zip(*(part[c].tolist() for c in ("hand_id", "seq", "position", "action")), at.tolist()):
                x = open_.setdefault(hand, [0, False, [], {}, 0])
                touched.add(hand)
                x[4] = max(x[4], ms)
                if seq >= x[0]:  # one that was told comes again after a restart
                    x[3][seq] = (position, action)
        for hand in touched:
            x, told = open_[hand], []
            while x[0] in x[3]:
                x[1] = _tell(*x[3].pop(x[0]), x[1], x[2], told)
                x[0] += 1
            out.extend((hand, *t) for t in told)
        if touched:
            due = min(open_[h][4] for h in touched) + self.quiet_ms
            if timer is None or due < timer:
                self.handle.registerTimer(due)
                timer = due
            self._save(open_, timer)
        yield self._frame(out)

    def handleExpiredTimer(self, key, timerValues, expiredTimerInfo) -> Iterator[pd.DataFrame]:
        open_, timer = self._load()
        now, out = timerValues.getCurrentWatermarkInMs(), []
        for hand in [h for h, x in open_.items() if x[4] + self.quiet_ms <= now]:
            _, raised, acted, waiting, _ = open_.pop(hand)
            told: list = []
            for _, (position, action) in sorted(waiting.items()):
                raised = _tell(position, action, raised, acted, told)
            out.extend((hand, *t) for t in told)
        if not open_:
            self.state.clear()
        else:
            due = min(x[4] for x in open_.values()) + self.quiet_ms
            if timer is None or timer <= now or due < timer:
                self.handle.registerTimer(due)
                timer = due
            self._save(open_, timer)
        yield self._frame(out)

    def _frame(self, out: list) -> pd.DataFrame:
        kinds = {"hand_id": "int64", "position": object, "action": object, "facing": bool}
        return pd.DataFrame({c: pd.Series([r[i] for r in out], dtype=kind) for i, (c, kind) in enumerate(kinds.items())})

    def close(self) -> None:
        pass


def counters(acted: DataFrame) -> DataFrame:
    """Counters of each position over first actions."""
    n = lambda c: F.sum(c.cast("int"))
    raised = F.col("action").isin(*RAISES)
    return acted.groupBy("position").agg(F.count("*").alias("hands"), n(F.col("action").isin("call", *RAISES)).alias("vpip_n"), n(raised).alias("pfr_n"), n(raised & F.col("facing")).alias("three_bet_n"), n(F.col("facing")).alias("facing_n"), n(F.col("facing") & (F.col("action") == "fold")).alias("fold_n"))


def first_actions(stream: DataFrame, quiet_ms: int = 3_600_000, late: str = "1 hour", bundles: int = 4096) -> DataFrame:
    """The stream of first actions of a stream of actions (hand_id, seq from 0, position, action, at), of which none is more than ``late`` behind others; state is kept in RocksDB.

    ``bundles``: into how many parts open hands are dealt; a part's hands are read and written together, so it should hold some ten thousand at most.
    """
    dealt = stream.withWatermark("at", late).withColumn("bundle", F.pmod(F.xxhash64("hand_id"), F.lit(bundles)))
    return dealt.groupBy("bundle").transformWithStateInPandas(statefulProcessor=BundledFirstActions(quiet_ms), outputStructType=ACTED, outputMode="Append", timeMode="EventTime")


def observe(stream: DataFrame, out: str, checkpoint: str, quiet_ms: int = 3_600_000, late: str = "1 hour"):
    """Append the first actions under ``out``, a folder a batch, in which a repeated batch replaces itself: ``counters`` of all of them are the population so far."""
    spark, name = stream.sparkSession, "spark.sql.streaming.stateStore.providerClass"
    was = spark.conf.get(name)
    spark.conf.set(name, ROCKSDB)

    def write(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{out}/batch={number}")

    try:
        return first_actions(stream, quiet_ms, late).writeStream.foreachBatch(write).outputMode("append").option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    finally:
        spark.conf.set(name, was)
