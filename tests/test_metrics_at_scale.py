"""Ranked metrics against plain loops, with scores that many rows share; statistics of hands whose indexes repeat across splits."""

import random

import pytest
from pyspark.sql import functions as F

from riverdeck.operators import features, metrics


def _rows(n=900, seed=3):
    rng = random.Random(seed)
    scores = [1.0 if rng.random() < 0.4 else 0.25 if rng.random() < 0.2 else rng.random() for _ in range(n)]
    return [(i * 7 % n, s, int(rng.random() < s)) for i, s in enumerate(scores)]


def test_areas(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, s double, y int")
    pos, neg = [s for _, s, y in rows if y], [s for _, s, y in rows if not y]
    wins = sum((a > b) + (a == b) / 2 for a in pos for b in neg)
    assert metrics.roc_auc(df, "s", "y").first()[0] == pytest.approx(wins / len(pos) / len(neg))
    steps = sorted({s for _, s, _ in rows}, reverse=True)
    ap = sum(sum(1 for x in pos if x == s) * sum(1 for x in pos if x >= s) / sum(1 for _, x, _ in rows if x >= s) for s in steps) / len(pos)
    assert metrics.average_precision(df, "s", "y").first()[0] == pytest.approx(ap)
    one = df.where("y = 1")
    assert metrics.roc_auc(one, "s", "y").first()[0] is None and metrics.roc_auc(df.limit(0), "s", "y").first()[0] is None


def test_prefixes(spark):
    rows = _rows()
    df = spark.createDataFrame(rows, "id long, s double, y int")
    want, hits = [], 0
    for k, (i, s, y) in enumerate(sorted(rows, key=lambda r: (-r[1], r[0])), 1):
        hits += y
        want.append((len(rows), k, hits, s))
    ranked = metrics._prefixes(df, "s", "y", "id")
    assert sorted(map(tuple, ranked.collect()), key=lambda r: r[1]) == want


def test_no_range_holds_a_large_share(spark):
    """Two thirds of the rows have one score; they are cut by their key."""
    df = spark.range(30000).select("id", F.when(F.col("id") % 3 > 0, 1.0).otherwise(F.rand(5)).alias("s"))
    bounds = df.crossJoin(df.agg(metrics._bounds("s").alias("a"), metrics._bounds("id").alias("b")))
    b = metrics._range(F.col("s"), F.col("a"))
    ranges = bounds.select(b.alias("b"), F.when(b % 2 == 1, metrics._range(F.col("id"), F.col("b"))).otherwise(0).alias("d"))
    assert ranges.groupBy("b", "d").count().agg(F.max("count")).first()[0] < 1000


def test_percentiles(spark):
    rng = random.Random(1)
    values = [rng.choice([5.0, 5.0, rng.random() * 100]) for _ in range(501)] + [None]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    shares = [0.0, 0.1, 0.333, 0.5, 0.99, 1.0]
    want = df.agg(F.percentile("v", shares)).first()[0]
    assert metrics.percentiles(df, "v", shares).first()[0] == pytest.approx(want)
    assert metrics.percentiles(df.limit(0), "v", [0.5]).first()[0] == [None]


def test_population_tells_splits_apart(spark):
    event = lambda p, a: (p, a, None)
    hands = [("train", 0, [event("UTG", "raise"), event("BB", "fold")]), ("test", 0, [event("UTG", "call"), event("BB", "raise")]), ("test", 1, [event("UTG", "fold")])]
    df = spark.createDataFrame(hands, "split string, source_index long, events array<struct<position:string,action:string,amount_bb:double>>")
    got = {r["position"]: r for r in features.population(df).collect()}
    assert (got["UTG"]["hands"], got["UTG"]["vpip"], got["BB"]["hands"], got["BB"]["fold_to_raise_pct"]) == (3, pytest.approx(2 / 3), 2, 1.0)


def test_the_shared_folder_must_be_named_on_a_cluster(spark):
    from riverdeck.sources.shared import place

    class Conf(dict):
        set = dict.__setitem__

    class Session:
        conf = Conf({"spark.master": "spark://a:7077"})

    with pytest.raises(ValueError):
        place(Session(), "x")
    assert place(spark, "x").startswith(spark.conf.get("spark.checkpoint.dir"))
