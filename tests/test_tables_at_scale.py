"""Steps whose figures must not grow faster than their input."""

from pyspark.sql import functions as F

from riverdeck.operators import promptdb
from riverdeck.sources import bridge
from tests.oracle import SF


def _plan(df) -> str:
    return df._jdf.queryExecution().optimizedPlan().toString()


def test_numbered_once_and_counted_without_numbers(spark):
    raw = bridge.scenarios(spark, SF).where("source_index < 300")
    lazy, once = promptdb.build(raw), promptdb.build(raw, once=True)
    for name in promptdb.TABLES:
        assert sorted(map(repr, lazy[name].collect())) == sorted(map(repr, once[name].collect())), name
        assert "Window" not in _plan(once[name]) or name == "prompt_templates"
    counts = promptdb.table_counts(raw)
    assert "Window" not in _plan(counts) and _plan(counts).count("parquet") == 2  # orders and lines, once each
    assert {r["name"]: r["n"] for r in counts.collect()} == {n: t.count() for n, t in lazy.items()}


def test_prompt_is_bound_once_in_filters(spark):
    df = promptdb.build(bridge.scenarios(spark, SF))["situations"].select("situation_id", "hero_pos", "hero_hole", "pot_bb", "num_players")
    assert _plan(df).count("You are playing a ") <= 6  # over 20 before, so that the code didn't compile


def test_violations_are_found(spark):
    t = promptdb.build(bridge.scenarios(spark, SF).where("source_index < 50"))
    first = t["situation_actions"].limit(1).localCheckpoint()
    spoilt = {**t, "situation_actions": t["situation_actions"].union(first).union(first.withColumn("situation_id", F.lit(10**9).cast("long")))}
    found = {r["rule"]: r["n"] for r in promptdb.violations(spoilt).where("n > 0").collect()}
    assert found == {"situation_actions: situation_id, seq_index repeated": 1, "situation_actions: no situation": 1}


def test_rows_are_numbered_in_the_order_of_files(spark, tmp_path):
    """Larger files are read first, whatever their names are."""
    from riverdeck.sources import readers

    parts = [(0, 3), (3, 4000), (4003, 40), (4043, 900)]
    for i, (start, n) in enumerate(parts):
        rows = spark.range(start, start + n, numPartitions=1).select("id", F.concat(F.lit('{"instruction":"}'), F.repeat(F.sha2(F.col("id").cast("string"), 512), F.lit(20)), F.lit('{\\""')).alias("t"))
        rows.select("id").write.parquet(str(tmp_path / f"p{i}"))
        rows.select("id").write.csv(str(tmp_path / f"c{i}"))
        value = F.concat(F.when(F.col("id") == 0, "[").otherwise(","), "t", F.lit(', "output":"'), F.col("id").cast("string"), F.lit('"}'))
        rows.select(value).write.text(str(tmp_path / f"j{i}"))
    import shutil

    for kind, ending in (("p", "parquet"), ("c", "csv"), ("j", "txt")):
        (tmp_path / kind).mkdir()
        for i in range(len(parts)):
            (f,) = (tmp_path / f"{kind}{i}").glob(f"part-*.{ending}")
            shutil.copy(f, tmp_path / kind / f"part-{i}.{ending}")
    for df in (spark.read.parquet(str(tmp_path / "p")), spark.read.schema("id long").csv(str(tmp_path / "c"))):
        got = readers.with_index(df)
        assert got.count() == 4943 and got.where("id <> source_index").count() == 0
    spark.conf.set("spark.sql.files.maxPartitionBytes", "300000")
    try:
        got = readers.read_array(spark, str(tmp_path / "j"))
        assert got.count() == 4943 and got.where("output <> source_index or output is null").count() == 0
    finally:
        spark.conf.unset("spark.sql.files.maxPartitionBytes")


def test_side_pots_are_worked_out_within_hands(spark):
    from riverdeck import catalog

    for name in ("sim_side_pots", "sim_settle"):
        plan = _plan(catalog.QUERIES[name](spark, SF))
        assert "Join" not in plan and "Window" not in plan and plan.count("Repartition") == 1


def test_a_bundle_tells_what_its_hands_tell_alone():
    import random

    import pandas as pd

    from riverdeck.streaming import hands
    from tests.test_labeling import Handle, Times

    rng = random.Random(5)
    events = [(h, s, rng.choice(["UTG", "CO", "BTN"]), rng.choice(["fold", "call", "raise", "allin"]), pd.Timestamp(100 * h + s, unit="s")) for h in range(40) for s in range(rng.randrange(1, 9)) if rng.random() < 0.9]
    rng.shuffle(events)
    batches = [pd.DataFrame(events[i::3], columns=["hand_id", "seq", "position", "action", "at"]) for i in range(3)]
    rows = lambda parts: [tuple(r) for p in parts for r in p.itertuples(index=False)]
    bundle, handle = hands.BundledFirstActions(quiet_ms=1000), Handle()
    bundle.init(handle)
    reads = []
    get = handle.state.get
    handle.state.get = lambda: reads.append(1) or get()
    got = [sorted(rows(bundle.handleInputRows((0,), iter([b]), Times(0)))) for b in batches]
    assert len(reads) == 3  # once a batch for forty hands
    got += [sorted(rows(bundle.handleExpiredTimer((0,), Times(2_000_000), None))), sorted(rows(bundle.handleExpiredTimer((0,), Times(10_000_000), None)))]
    assert handle.state.value is None and min(handle.timers) <= 8000
    want = [[] for _ in range(5)]
    for h in range(40):
        one, own = hands.FirstActions(quiet_ms=1000), Handle()
        one.init(own)
        for i, b in enumerate(batches):
            if len(part := b[b["hand_id"] == h]):
                want[i] += rows(one.handleInputRows((h,), iter([part]), Times(0)))
        for i, now in enumerate((2_000_000, 10_000_000)):
            want[3 + i] += rows(one.handleExpiredTimer((h,), Times(now), None))
    assert got == [sorted(w) for w in want]


def test_card_features_come_from_a_dimension_or_from_the_hand(spark):
    from riverdeck.operators import features

    raw = bridge.scenarios(spark, SF).where("source_index < 200").withColumn("hero_holding", F.when(F.col("source_index") % 5 == 0, "AhX").when(F.col("source_index") % 5 == 1, "ahKD").when(F.col("source_index") % 5 == 2, F.lit(None).cast("string")).otherwise(F.col("hero_holding")))
    s = features.samples(raw)
    direct = s.select("source_index", *[F.coalesce(c, F.lit(0.0)).alias(n) for n, c in features._by_hole(F.col("hero_hole")).items()])
    made = features.features(s)
    assert sorted(map(tuple, direct.collect())) == sorted(map(tuple, made.select(*direct.columns).collect()))
    assert made._jdf.queryExecution().optimizedPlan().toString().count("52 * 52") == 0 and features.hole_dimension(spark).select("hole").distinct().count() == 2704


def test_calibrations_share_their_bases(spark):
    from pyspark.ml.classification import LogisticRegression

    from riverdeck.ml.calibration import CrossFitted

    fits = []

    class Counted(LogisticRegression):
        def _fit(self, df):
            fits.append(1)
            return super()._fit(df)

    rows = spark.range(600).selectExpr("'train' as split", "id as source_index", "cast(id % 3 = 0 as int) * 1.0 as y", "array(cast(id % 7 as double), cast(id % 3 as double) + cast(id % 11 as double)) as x")
    from pyspark.ml.functions import array_to_vector

    rows = rows.select("split", "source_index", "y", array_to_vector("x").alias("features"))
    base = Counted(labelCol="y", maxIter=5)
    both = CrossFitted(base=base, classes=2).fit_methods(rows, ["sigmoid", "isotonic"])
    assert len(fits) == 3
    for method, model in both.items():
        alone = CrossFitted(base=base, classes=2, method=method).fit(rows)
        p = lambda m: [list(r[0]) for r in m.transform(rows).orderBy("source_index").select("probability").collect()]
        assert max(abs(a - b) for x, y in zip(p(model), p(alone)) for a, b in zip(x, y)) < 1e-9


def test_situations_are_whole(spark):
    """Every column of a situation, and the number of its own template."""
    raw = bridge.scenarios(spark, SF).where("source_index < 40")
    other = F.when(F.col("source_index") == 7, F.concat(F.lit("Hello. "), "instruction")).otherwise(F.col("instruction"))
    tables = promptdb.build(raw.withColumn("instruction", other), once=True)
    rows = {r["source_index"]: r.asDict() for r in promptdb.full(tables).collect()}
    assert len(rows) == 40 and set(rows[7]) == set(promptdb.FULL) and len(promptdb.FULL) == 27
    assert {i: r["prompt_template_id"] for i, r in rows.items()} == {i: 1 + (i == 7) for i in range(40)}
    assert all(r["table_size"] == 2 + i % 5 and r["starting_stack_chips"] == 50 + i % 51 and r["pot_size_chips"] == 3.5 + i % 40 and "your holding is" in r["prompt_text"] for i, r in rows.items())
    assert _catalog("prj_situation", spark).columns == promptdb.FULL


def test_zipped_rows_are_not_broadcast(spark):
    """The files of two columns are small, their rows are as many as the orders: only the splits' offsets are broadcast."""
    df = _catalog("join_positional", spark)
    df.collect()
    plan = df._jdf.queryExecution().executedPlan().toString()
    plan = plan[plan.index("Final Plan") : plan.index("Initial Plan")]
    assert plan.count("SortMergeJoin") == 1 and plan.count("BroadcastHashJoin") == 2


def _catalog(name: str, spark):
    from riverdeck import catalog

    return catalog.QUERIES[name](spark, SF)
