"""Labelling: retries, failures, runs that are resumed, cut short or killed between rows and manifest."""

import json

import pytest
from pyspark.sql import functions as F

from riverdeck import cli, labeling
from riverdeck.streaming import hands, read_json

ROWS = "row_id string, instruction string, output string"


def pairs(spark, n):
    return spark.createDataFrame([(f"r{i:02}", f"spot {i}", "call") for i in range(n)], ROWS)


class Failing:
    """Fails so many times for a row as its number says, and keeps what it was told to wait."""

    def __init__(self):
        self.tried = {}

    def __call__(self, row):
        n = self.tried[row["row_id"]] = self.tried.get(row["row_id"], 0) + 1
        if n <= int(row["row_id"][1:]):
            raise TimeoutError(f"attempt {n}")
        return {"reasoning": f"said of {row['instruction']}", "tokens_prompt": 7}


def no_sleep(seconds):
    pass


class Writer:
    """Appends what it is called with to a file."""

    def __init__(self, path):
        self.path = path

    def __call__(self, x):
        with open(self.path, "a") as f:
            f.write(f"{x}\n")


@pytest.mark.parametrize("retries", [1, 2, 4])
def test_rows_fail_after_all_retries(spark, tmp_path, retries):
    waits = tmp_path / "waits"
    out = labeling.labelled(pairs(spark, 6).coalesce(1), labeling.Labeler(Failing, "f", "m"), retries=retries, base_delay=0.5, sleep=Writer(waits)).orderBy("row_id").collect()
    for i, r in enumerate(out):
        assert r["attempts"] == min(i + 1, retries)
        if i < retries:
            assert (r["reasoning"], r["action"], r["error"], r["tokens_prompt"], r["labeler_model"]) == (f"said of spot {i}", "call", None, 7, "m")
        else:
            assert r["reasoning"] is None and r["error"] == f"f failed after {retries} attempts: TimeoutError: attempt {retries}"
    told = [float(x) for x in waits.read_text().split()] if waits.exists() else []
    assert told == [0.5 * 2**a for i in range(6) for a in range(min(i, retries - 1))]


def test_fail_fast_ends_the_job(spark):
    with pytest.raises(Exception, match="LabelerError.*row r01"):
        labeling.labelled(pairs(spark, 3).coalesce(1), labeling.Labeler(Failing), retries=1, fail_fast=True, sleep=no_sleep).collect()
    with pytest.raises(ValueError, match="at least one"):
        labeling.labelled(pairs(spark, 1), labeling.Labeler(Failing), retries=0)
    with pytest.raises(ValueError, match="error"):
        labeling.labelled(pairs(spark, 1).withColumn("error", F.lit(1)), labeling.Labeler(Failing))


def blank():
    return lambda row: " "


def test_an_empty_answer_is_a_failure(spark):
    assert "no text" in labeling.labelled(pairs(spark, 1), labeling.Labeler(blank), retries=1, sleep=no_sleep).first()["error"]


def flaky(df, retries=3):
    return labeling.labelled(df, labeling.Labeler(Failing), retries=retries, sleep=no_sleep)


def test_runs_are_resumed(spark, tmp_path):
    out, rows = str(tmp_path / "out"), pairs(spark, 6)
    seen = []
    first = labeling.run(rows.union(rows), flaky, out, chunk_rows=2, progress=lambda r: seen.append((r.n_written, r.n_failed)))
    assert (first.n_input, first.n_skipped, first.n_written, first.n_failed) == (6, 0, 3, 3)
    assert sorted(first.failed_row_ids) == ["r03", "r04", "r05"] and seen[-1] == (3, 3) and len(seen) == 3
    assert labeling.failures(spark, out).count() == 3
    second = labeling.run(rows, lambda df: flaky(df, 5), out)
    assert (second.n_input, second.n_skipped, second.n_written, second.n_failed) == (6, 3, 2, 1)
    assert sorted(r["row_id"] for r in labeling.read(spark, out).collect()) == [f"r0{i}" for i in range(5)]
    assert {r["row_id"] for r in labeling.failures(spark, out).collect()} == {"r05"}
    third = labeling.run(rows, labeling.template, out, resume=False, limit=2)
    assert (third.n_input, third.n_skipped, third.n_written) == (2, 0, 2)
    # Rows done before count among the limit.
    fourth = labeling.run(rows, labeling.template, out, limit=3)
    assert (fourth.n_input, fourth.n_skipped, fourth.n_written) == (3, 2, 1)
    assert sorted(r["labeler"] for r in labeling.read(spark, out).collect()) == ["template"] * 3


def test_killed_between_rows_and_manifest(spark, tmp_path):
    out, rows = str(tmp_path / "out"), pairs(spark, 5)
    done = []

    def killed(chunk):
        done.append(chunk)
        if len(done) == 2:
            raise KeyboardInterrupt

    with pytest.raises(KeyboardInterrupt):
        labeling.run(rows, labeling.template, out, chunk_rows=2, between=killed)
    before = labeling.read(spark, out).count()
    assert before < 5
    again = labeling.run(rows, labeling.template, out, chunk_rows=2)
    assert again.n_skipped == before and again.n_written == 5 - before
    assert sorted(r["row_id"] for r in labeling.read(spark, out).collect()) == [f"r0{i}" for i in range(5)]


def test_nothing_to_label(spark, tmp_path):
    result = labeling.run(pairs(spark, 0), labeling.template, str(tmp_path / "out"))
    assert (result.n_input, result.n_written) == (0, 0) and labeling.committed(spark, str(tmp_path / "out")).count() == 0


@pytest.mark.parametrize("style, tail", [("concise", "Decision: call"), ("structured", "### Action\nCALL")])
def test_records_and_commands(spark, tmp_path, monkeypatch, capsys, style, tail):
    monkeypatch.setattr(cli, "session", lambda: spark)
    (tmp_path / "rows.jsonl").write_text("".join(json.dumps({"instruction": f"position: BTN, spot {i}", "output": "call"}) + "\n" for i in range(3)))
    args = ["label", "--rows", str(tmp_path / "rows.jsonl"), "--out", str(tmp_path / "out"), "--style", style, "--records", str(tmp_path / "records")]
    cli.main(args)
    assert "3 written" in capsys.readouterr().out
    cli.main(args)
    assert "0 written, 3 done before" in capsys.readouterr().out
    cli.main(["inspect", "--records", str(tmp_path / "records"), "--limit", "2"])
    said = capsys.readouterr().out
    assert said.count("--- assistant ---") == 2 and tail in said and f'"style": "{style}"' in said and labeling.SYSTEM[style][:40] in said


def test_requests_by_style(spark):
    row = labeling.asked(pairs(spark, 1), "structured").first()
    assert "spot 0" in row["prompt"] and "call" in row["prompt"] and "### Action" in row["system"]
    with pytest.raises(ValueError, match="style"):
        labeling.asked(pairs(spark, 1), "rhymed")


class Value:
    def __init__(self):
        self.value = None

    def get(self):
        return self.value

    def update(self, value):
        self.value = value

    def clear(self):
        self.value = None


class Handle:
    def __init__(self):
        self.state, self.timers = Value(), []

    def getValueState(self, name, schema):
        return self.state

    def registerTimer(self, at):
        self.timers.append(at)


class Times:
    def __init__(self, watermark):
        self.watermark = watermark

    def getCurrentWatermarkInMs(self):
        return self.watermark


def test_a_timer_closes_a_hand_with_gaps():
    import pandas as pd

    processor, handle = hands.FirstActions(quiet_ms=1000), Handle()
    processor.init(handle)
    frame = lambda *rows: pd.DataFrame([(s, p, a, pd.Timestamp(s, unit="s")) for s, p, a in rows], columns=["seq", "position", "action", "at"])
    told = lambda parts: [tuple(r) for part in parts for r in part.itertuples(index=False)]
    assert told(processor.handleInputRows((5,), iter([frame((0, "UTG", "raise"), (3, "SB", "fold"))]), Times(0))) == [(5, "UTG", "raise", False)]
    assert handle.timers == [4000]
    assert told(processor.handleInputRows((5,), iter([frame((4, "UTG", "call"), (5, "BB", "allin"))]), Times(0))) == []
    # Something came since the timer was set: it is set again.
    assert told(processor.handleExpiredTimer((5,), Times(4500), None)) == [] and handle.timers == [4000, 6000]
    assert told(processor.handleExpiredTimer((5,), Times(6000), None)) == [(5, "SB", "fold", True), (5, "BB", "allin", True)]
    assert handle.state.value is None


def test_actions_in_any_order(spark, tmp_path):
    import random

    rng = random.Random(3)
    rows, want = [], {}
    for hand in range(8):
        raised, acted = False, set()
        for seq in range(rng.randrange(1, 9)):
            position, action = rng.choice(["UTG", "CO", "BTN"]), rng.choice(["fold", "call", "raise", "check"])
            rows.append((hand, seq, position, action, seq))
            if position not in acted:
                acted.add(position)
                c = want.setdefault(position, [0] * 6)
                for i, hit in enumerate((True, action in ("call", "raise"), action == "raise", action == "raise" and raised, raised, raised and action == "fold")):
                    c[i] += hit
                raised = raised or action == "raise"
    rng.shuffle(rows)
    for part in (rows[::2], rows[1::2]):
        spark.createDataFrame(part, "hand_id long, seq int, position string, action string, at long").withColumn("at", F.timestamp_seconds(F.col("at") + 1_700_000_000)).coalesce(1).write.mode("append").json(str(tmp_path / "in"))
    stream = read_json(spark, str(tmp_path / "in"), "hand_id long, seq int, position string, action string, at timestamp", files=1)
    hands.observe(stream, str(tmp_path / "out"), str(tmp_path / "state")).awaitTermination()
    got = {r["position"]: list(r)[1:] for r in hands.counters(spark.read.parquet(str(tmp_path / "out"))).collect()}
    assert got == want
