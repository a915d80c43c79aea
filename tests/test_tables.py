import json

from pyspark.sql import functions as F

from riverdeck import ml, streaming
from riverdeck.operators import features, metrics, promptdb
from riverdeck.sources import bridge, readers

SF = "/root/testdata/sf0.001"
HEAD = "prev_line,hero_pos,hero_holding,correct_decision,num_players,num_bets,available_moves,pot_size\n"


def _write(tmp_path):
    (tmp_path / "test.csv").write_text(HEAD + "UTG/2.0bb/CO/call/BTN/call,BB,9s7s,fold,4,1,\"['fold', 'call', 'raise']\",7.5\nHJ/2.0bb/CO/6.5bb/BTN/call/BB/allin,HJ,AhKc,fold,4,3,\"['fold', 'call']\",115.5\n,UTG,9,raise,6,0,,1.5\n")
    (tmp_path / "test.json").write_text(json.dumps([{"instruction": f"prompt {i} current pot size is 9 chips", "output": "fold"} for i in range(3)]))


def test_files_to_tables(spark, tmp_path):
    _write(tmp_path)
    raw = readers.read_splits(spark, str(tmp_path))
    assert raw.count() == 3 and promptdb.rejected(promptdb.parsed(raw)).count() == 1
    tables = promptdb.build(raw)
    rows = {r["source_index"]: r for r in tables["situations"].collect()}
    assert rows[0]["hero_hand_class"] == "97s" and rows[0]["decision_type"] == "open_raise_facing" and rows[0]["pot_bb"] == 7.5
    assert rows[1]["hero_hand_class"] == "AKo" and rows[1]["decision_type"] == "allin_facing"
    first = tables["situation_actions"].where("situation_id = 1").orderBy("seq_index").collect()
    assert len(first) == 3 and tuple(first[0])[2:] == ("UTG", "raise", 2.0)
    assert {r["move"] for r in tables["situation_available_moves"].where("situation_id = 1").collect()} == {"call", "fold", "raise"}
    assert all(r["n"] == 0 for r in promptdb.violations(tables).collect())


def test_mirror_and_views(spark, tmp_path):
    tables = promptdb.build(bridge.scenarios(spark, SF).where("source_index < 50"))
    promptdb.write(tables, str(tmp_path / "db"))
    back = promptdb.load(spark, str(tmp_path / "db"))
    promptdb.register(spark, back)
    n = spark.sql("select count(*) from v_situation_summary").first()[0]
    assert n == tables["situations"].count() and spark.sql("select sum(n) from v_decision_type_mix").first()[0] <= n
    assert promptdb.ddl(back).count("CREATE TABLE") == 6


def test_index_follows_the_files(spark, tmp_path):
    spark.range(1000).repartition(7).sortWithinPartitions("id").write.parquet(str(tmp_path / "x"))
    df = readers.with_index(spark.read.parquet(str(tmp_path / "x")))
    assert [r["source_index"] for r in df.orderBy("source_index").collect()] == list(range(1000))


def test_postflop_rows(spark, tmp_path):
    (tmp_path / "p.csv").write_text("hero_pos,hero_holding,num_players,pot_size,street,board,prev_line,available_moves,correct_decision\nBTN,AhKh,3,9,turn,Ah2d3c4s,,fold,fold\nINVALID,notcards,3,9,flop,,,,fold\nBB,9s7s,3,9,unknown,,,,check\n")
    got = readers.read_postflop(spark, str(tmp_path / "p.csv")).collect()
    assert [(r["hero_pos"], r["street"]) for r in got] == [("BTN", "turn"), ("BB", "flop")]


def test_row_ids_and_meta(spark, tmp_path):
    (tmp_path / "r.jsonl").write_text('{"instruction": "a", "output": "b", "k": 1}\n\n{"instruction": "c", "output": "d", "row_id": "x"}\n{"instruction": "e"}\n')
    got = {r["instruction"]: r for r in readers.read_pairs(spark, str(tmp_path / "r.jsonl")).collect()}
    assert got["c"]["row_id"] == "x" and got["a"]["row_id"] == "86f7e437faa5a7fc" and got["a"]["meta"] == {"k": "1"} and "e" not in got


def test_resume_writes_each_row_once(spark, tmp_path):
    rows = spark.range(20).select(F.col("id").cast("string").alias("row_id"), F.lit("t").alias("text"))
    for part in (rows.where("row_id < '15'"), rows):
        part.write.mode("append").json(str(tmp_path / "in"))
        q = streaming.augment(streaming.read_json(spark, str(tmp_path / "in"), "row_id string, text string"), lambda df: df, str(tmp_path / "out"), str(tmp_path / "state"))
        q.awaitTermination()
    out = spark.read.parquet(str(tmp_path / "out"))
    assert out.count() == out.select("row_id").distinct().count() == 20


def test_split_sizes_are_exact(spark):
    df = spark.range(1000).select(F.col("id").alias("source_index"), (F.col("id") % 3).alias("y"))
    n = {r["y"]: r["n"] for r in metrics.stratified_split(df, "y", "source_index", 0.1).where("part = 'holdout'").groupBy("y").agg(F.count("*").alias("n")).collect()}
    assert n == {0: 33, 1: 33, 2: 33}


def test_empty_board_and_empty_frames(spark):
    df = spark.createDataFrame([], "s double, y int, id long")
    assert metrics.roc_auc(df, "s", "y").first()[0] is None
    assert metrics.brier(df, "s", "y").first()["n"] == 0


def test_action_head_learns(spark):
    rows = features.features(features.samples(bridge.scenarios(spark, SF))).where("label is not null").select("*").limit(400).persist()
    model = ml.train_action(rows, ml.CLASSIFIERS["logistic"])
    assert metrics.summary(ml.probabilities(model, rows)).first()["accuracy"] > 0.2
    assert ml.train_villain(rows.limit(20)) is None


def test_learning_queries(spark):
    """Heads saved and loaded predict every row of the holdout; the bundle of metrics and the calibration curves are whole."""
    from riverdeck import catalog
    from tests.oracle import SF

    held = catalog.QUERIES["ml_train_classical"](spark, SF).collect()
    assert 100 < len(held) < 200 and all(r["predicted"] in ("allin", "call", "check", "fold", "raise") and 0.2 <= r["p_max"] <= 1 for r in held)
    both = catalog.QUERIES["ml_multihead"](spark, SF).collect()
    assert {(r["split"], r["source_index"]) for r in both} == {(r["split"], r["source_index"]) for r in held}
    assert all(0 <= r["villain_fold_p"] <= 1 for r in both)
    figures = catalog.QUERIES["ml_eval"](spark, SF).first().asDict()
    assert figures["n"] == len(held) and {"accuracy", "top2_accuracy", "log_loss", "macro_f1", "villain_fold_brier", "bluff_ev_mean"} <= set(figures)
    curves = {r["method"]: r for r in catalog.QUERIES["ml_calibration"](spark, SF).collect()}
    assert set(curves) == {"none", "isotonic", "sigmoid"} and len({r["n"] for r in curves.values()}) == 1 and all(0 < r["brier"] < 0.5 for r in curves.values())
