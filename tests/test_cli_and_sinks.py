import json

import pytest
from pyspark.sql import functions as F

from riverdeck import cli
from riverdeck.operators import promptdb
from riverdeck.sources import bridge, readers, sinks

SF = "/root/testdata/sf0.001"
HEAD = "prev_line,hero_pos,hero_holding,correct_decision,num_players,num_bets,available_moves,pot_size\n"


@pytest.fixture()
def folder(tmp_path):
    for split in ("train", "test"):
        (tmp_path / f"{split}.csv").write_text(HEAD + "UTG/2.0bb/BTN/call,BB,9s7s,fold,4,1,\"['fold', 'call']\",7.5\nHJ/2.0bb,HJ,AhKc,raise 8bb,4,3,\"['fold', 'call']\",115.5\n")
        (tmp_path / f"{split}.json").write_text(json.dumps([{"instruction": f"{split} {i}", "output": "fold"} for i in range(2)]))
    return tmp_path


def test_build_query_and_export(spark, folder, capsys, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    db = str(folder / "db")
    cli.main(["build", "--raw", str(folder), "--db", db])
    capsys.readouterr()
    cli.main(["query", "--db", db, "--sql", "select split, count(*) as n from situations group by 1 order by 1", "--format", "csv"])
    assert capsys.readouterr().out.split() == ["split,n", "test,2", "train,2"]
    cli.main(["query", "--db", db, "--sql", "select * from situations where false"])
    assert capsys.readouterr().out.strip() == "(no rows)"
    cli.main(["ddl", "--db", db])
    assert "CREATE TABLE situations" in capsys.readouterr().out
    cli.main(["stats", "--db", db, "--format", "json"])
    assert {"kind": "table", "name": "situations", "n": 4} in json.loads(capsys.readouterr().out)
    cli.main(["load", "--db", db, "--url", f"jdbc:derby:memory:{folder.name};create=true"])
    assert "situations: 4 rows" in capsys.readouterr().out
    cli.main(["ingest", "--raw", str(folder), "--out", str(folder / "samples")])
    assert spark.read.json(str(folder / "samples")).count() == 4
    cli.main(["export-parquet", "--db", db, "--out", str(folder / "out")])
    assert spark.read.parquet(str(folder / "out" / "v_situation_summary")).count() == 4


def test_featurize_and_reason(spark, folder, monkeypatch):
    monkeypatch.setattr(cli, "session", lambda: spark)
    cli.main(["featurize", "--raw", str(folder), "--out", str(folder / "features")])
    df = spark.read.parquet(str(folder / "features"))
    assert df.count() == 4 and dict(df.dtypes)["chen_strength"] == "float" and "_label" in df.columns
    (folder / "rows.jsonl").write_text('{"instruction": "a 3-bet pot", "output": "call"}\n{"instruction": "b", "output": "fold"}\n')
    cli.main(["reason", "--rows", str(folder / "rows.jsonl"), "--out", str(folder / "traces")])
    traces = spark.read.parquet(str(folder / "traces"))
    assert traces.where("reasoning like '%Decision: call'").count() == 1
    cli.main(["reason", "--rows", str(folder / "rows.jsonl"), "--out", str(folder / "more"), "--done", str(folder / "traces")])
    assert spark.read.parquet(str(folder / "more")).count() == 0


def test_splits_are_looked_for_in_several_folders(spark, folder, tmp_path):
    with pytest.raises(FileNotFoundError):
        readers.split_files(spark, str(tmp_path / "none"))
    with pytest.raises(ValueError, match="unknown split 'dev'"):
        readers.resolve(spark, "dev", (str(folder),))
    assert readers.resolve(spark, "test", (str(tmp_path / "none"), f"file://{folder}"))[0] == f"file://{folder}/test.csv"
    (folder / "test.json").rename(folder / "other.json")
    assert set(readers.split_files(spark, str(folder))) == {"train"}


@pytest.mark.parametrize("split_bytes", [64, 1000, 1 << 27])
def test_arrays_are_read_by_several_tasks(spark, tmp_path, split_bytes):
    said = ["plain", "a } brace", 'a \\" quote', "both \\\\", '} "{', "", "é\n€", "[{", '\\\\"}', "x" * 300]
    rows = [{"instruction": f"{i} {said[i % len(said)]}", "output": said[(i * 3) % len(said)], "nested": {"a": [{"b": "}"}], "c": "{"}} for i in range(120)]
    (tmp_path / "rows.json").write_text(json.dumps(rows, indent=3 if split_bytes > 100 else None, ensure_ascii=False), encoding="utf-8")
    was = spark.conf.get("spark.sql.files.maxPartitionBytes"), spark.conf.get("spark.sql.files.openCostInBytes")
    try:
        spark.conf.set("spark.sql.files.maxPartitionBytes", split_bytes)
        spark.conf.set("spark.sql.files.openCostInBytes", 0)
        got = readers.read_array(spark, str(tmp_path / "rows.json")).orderBy("source_index").collect()
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", was[0])
        spark.conf.set("spark.sql.files.openCostInBytes", was[1])
    assert [tuple(r) for r in got] == [(i, r["instruction"], r["output"]) for i, r in enumerate(rows)]


def test_only_arrays_are_taken(spark, tmp_path):
    for i, text in enumerate(['{"instruction": "a", "output": "b"}', ""]):
        (tmp_path / f"{i}.json").write_text(text)
        with pytest.raises(ValueError, match="JSON array"):
            readers.read_array(spark, str(tmp_path / f"{i}.json"))
    (tmp_path / "none.json").write_text(" [ ]\n")
    assert readers.read_array(spark, str(tmp_path / "none.json")).count() == 0


def test_limit_counts_from_the_first_row(spark, folder):
    got = readers.read_splits(spark, str(folder), limit=1)
    assert got.count() == 2 and got.select("source_index").distinct().count() == 1


@pytest.mark.parametrize("style", sinks.FORMATS)
def test_instruction_layouts(spark, style):
    df = spark.createDataFrame([(" ask ", " answer ")], "instruction string, output string")
    text = sinks.instruction_text(df, style).first()["text"]
    assert "ask" in text and text.rstrip().endswith(("answer", "<|im_end|>"))


def test_trajectory_lines(spark, tmp_path):
    d = bridge.decisions(spark, SF)
    hands = d.groupBy("hand_id").agg(F.create_map(F.lit(0), F.sum("reward_bb")).alias("net_deltas"), F.array(F.lit(0)).alias("winners"))
    n = sinks.trajectories_jsonl(d, hands, str(tmp_path / "a"), condition=F.col("winner"))
    assert n == d.where("seat_id = 0").count()
    assert sinks.trajectories_jsonl(d, hands.drop("net_deltas"), str(tmp_path / "b"), summary=True, condition=F.lit(False)) == hands.count()


def test_plans_push_filters_and_prune_columns(spark):
    plan = spark.read.parquet(f"{SF}/lineitem.parquet").where("l_quantity > 10").select("l_orderkey")._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,10.0)]" in plan and "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan
    tables = promptdb.build(bridge.scenarios(spark, SF))
    light = promptdb.matrix_view(tables["situations"], "hero_pos")._jdf.queryExecution().optimizedPlan().toString()
    assert "sha2" not in light  # template shells aren't worked out for what doesn't show them
    assert "Python" not in light
