"""Boosted trees, the two-head network, calibration, search and stacking against plain figures."""

import math
import random

import numpy as np
import pytest
from pyspark.ml import PipelineModel
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from riverdeck import catalog, ml
from riverdeck.ml import boosting, calibration, network
from riverdeck.operators import metrics
from riverdeck.operators.features import FEATURES
from tests.oracle import SF


def points(n, classes, features=4, seed=1):
    """Rows whose class depends on two features together, with some noise."""
    rng = np.random.default_rng(seed)
    x = np.round(rng.normal(size=(n, features)), 2)
    y = ((x[:, 0] > 0).astype(int) + (x[:, 1] * x[:, 0] > 0.1) + (rng.random(n) < 0.1)) % classes
    return x, y


def frame(spark, x, y, parts=3):
    rows = [(i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(x.tolist(), y.tolist()))]
    return spark.createDataFrame(rows, ["id", "features", "y"]).repartition(parts, "id")


def plain_boosting(x, y, classes, edges, rounds, depth, rate, least, l1, l2):
    """The same trees by loops over nodes, features and cuts."""
    bins = [[sum(e < v for e in edges[j]) for j, v in enumerate(row)] for row in x]
    counts = [max(sum(y == k), 1e-3) for k in range(classes)]
    scores = [[math.log(c / len(y)) for c in counts] for _ in y]
    shrink = lambda g: math.copysign(max(abs(g) - l1, 0), g)
    for _ in range(rounds):
        p = [[math.exp(s) / sum(map(math.exp, row)) for s in row] for row in scores]
        for k in range(classes):
            g = [p[i][k] - (y[i] == k) for i in range(len(y))]
            h = [p[i][k] * (1 - p[i][k]) for i in range(len(y))]
            total = lambda rows, v: sum(v[i] for i in rows)

            def worth(rows):
                return shrink(total(rows, g)) ** 2 / (total(rows, h) + l2)

            def grow(rows, level):
                best = (1e-9, None)
                if level < depth:
                    for j in range(len(edges)):
                        for cut in range(len(edges[j])):
                            left = [i for i in rows if bins[i][j] <= cut]
                            right = [i for i in rows if bins[i][j] > cut]
                            if len(left) >= least and len(right) >= least:
                                gain = worth(left) + worth(right) - worth(rows)
                                if gain > best[0] + 1e-10:
                                    best = (gain, (left, right))
                if best[1]:
                    for part in best[1]:
                        grow(part, level + 1)
                else:
                    for i in rows:
                        scores[i][k] += -rate * shrink(total(rows, g)) / (total(rows, h) + l2)

            grow(list(range(len(y))), 0)
    return np.array([[math.exp(s) / sum(map(math.exp, row)) for s in row] for row in scores])


@pytest.mark.parametrize("classes, l1", [(3, 0.0), (2, 0.5)])
def test_boosting_equals_plain_loop(spark, classes, l1):
    x, y = points(200, classes)
    df = frame(spark, x, y)
    model = boosting.Boosting(rounds=3, depth=3, rate=0.3, least=4, l1=l1, l2=1.0, subsample=1.0, columns=1.0, bins=12).fit(df)
    edges, _, rounds = model.parts()
    assert len(rounds) == 3 and len(rounds[0]) == classes
    got = {r["id"]: r["probability"].toArray() for r in model.transform(df).collect()}
    want = plain_boosting(x, y, classes, edges, 3, 3, 0.3, 4, l1, 1.0)
    assert np.allclose([got[i] for i in range(200)], want, atol=1e-9)


def test_boosting_beats_the_forest(spark, tmp_path):
    x, y = points(1500, 3)
    train, held = frame(spark, x[:1000], y[:1000]), frame(spark, x[1000:], y[1000:])
    accuracy = lambda model: model.transform(held).agg(F.avg((F.col("prediction") == F.col("y")).cast("int"))).first()[0]
    model = boosting.Boosting(rounds=12, depth=4, rate=0.3).fit(train)
    assert accuracy(model) >= accuracy(ml.forest(12, 4).fit(train)) and accuracy(model) > 0.8
    assert model.importances()[:2].sum() > 0.8
    model.write().overwrite().save(str(tmp_path / "m"))
    back = boosting.BoostedModel.load(str(tmp_path / "m"))
    rows = lambda m: sorted((r["id"], r["probability"].toArray().tolist()) for r in m.transform(held).collect())
    assert rows(back) == rows(model)
    # More rounds than are kept on the fly, and the same trees by the same seed.
    again = boosting.Boosting(rounds=12, depth=4, rate=0.3).fit(train)
    assert np.allclose([p for _, p in rows(again)], [p for _, p in rows(model)])


def test_boosting_takes_missing_values_and_constant_features(spark):
    x, y = points(120, 2)
    x[::5, 0], x[:, 3] = np.nan, 1.0
    model = boosting.Boosting(rounds=2, depth=2, rate=0.5).fit(frame(spark, x, y))
    p = np.array([r["probability"].toArray() for r in model.transform(frame(spark, x, y)).collect()])
    assert np.isfinite(p).all() and np.allclose(p.sum(1), 1)
    with pytest.raises(ValueError, match="no rows"):
        boosting.Boosting().fit(frame(spark, x[:1], y[:1]).where("false"))


# The network


def small_batch(seed=0, n=7, inputs=3):
    rng = np.random.default_rng(seed)
    return rng.normal(size=(n, inputs)), rng.integers(0, network.HANDS, n), rng.integers(0, network.POSITIONS, n), rng.integers(0, 4, n), rng.integers(-1, 2, n)


def test_gradient_equals_finite_differences():
    weights = network.initial(3, 4, hand=2, position=2, hidden=(5, 4), seed=3)
    batch = small_batch()
    masks = [np.random.default_rng(1).integers(0, 2, (7, k)) * 2.0 for k in (5, 4)]
    _, g = network.loss_and_gradient(weights, batch, masks)
    rng = np.random.default_rng(2)
    for name, w in weights.items():
        places = [np.unravel_index(i, w.shape) for i in rng.choice(w.size, min(w.size, 12), replace=False)]
        if name in ("hand", "position"):
            places = [(int(batch[1 if name == "hand" else 2][0]), j) for j in range(w.shape[1])]
        for at in places:
            was, losses = w[at], []
            for step in (1e-6, -1e-6):
                w[at] = was + step
                losses.append(network.loss_and_gradient(weights, batch, masks)[0])
            w[at] = was
            for part, i in (("action", 2), ("villain", 3)):
                assert g[part][name][at] == pytest.approx((losses[0][i] - losses[1][i]) / 2e-6, abs=1e-5)


@pytest.mark.parametrize("parts", [1, 40])
def test_sums_over_partitions(spark, parts):
    weights = network.initial(3, 4, hand=2, position=2, hidden=(5, 4), seed=3)
    batch = small_batch(5, 60)
    rows = [(x.tolist(), *map(int, r)) for x, *r in zip(*batch)]
    df = spark.createDataFrame(rows, "x array<double>, hand int, position int, y int, fold int").repartition(parts)
    sums, g = network.summed(df, weights, 3)
    want, parts_ = network.loss_and_gradient(weights, batch)
    assert np.allclose(sums, want)
    for k in weights:
        assert np.allclose(g[k], parts_["action"][k] / want[0] + network.VILLAIN * parts_["villain"][k] / want[1])
    assert network.summed(df.where("false"), weights, 3)[1] is None


def decisions(spark, n=600, seed=4):
    rng = np.random.default_rng(seed)
    rows = []
    for i in range(n):
        hand, position, x = int(rng.integers(0, 169)), int(rng.integers(0, 6)), float(rng.normal())
        y = int(hand % 2 == 0) + int(x > 0)
        rows.append(("train", i, hand, position, x, None if i % 9 == 0 else 2.0, y, int(rng.integers(-1, 2))))
    return spark.createDataFrame(rows, "split string, source_index long, hand_class_idx int, pos_idx int, a double, b double, y int, villain_fold int")


def test_network_learns_and_reruns_alike(spark):
    df = decisions(spark)
    train, held = df.where("source_index % 5 > 0"), df.where("source_index % 5 = 0")
    shape = dict(epochs=12, batches=2, rate=0.02, patience=2, hidden=(16,), hand=4, position=2)
    model, history = network.fit(train, held, ["a", "b"], 3, **shape)
    assert min(h["valid_loss"] for h in history) < history[0]["valid_loss"] and len(history) == 12
    assert all(b["rate"] <= a["rate"] for a, b in zip(history, history[1:]))
    again, history_ = network.fit(train, held, ["a", "b"], 3, **shape)
    assert history == history_ and all((model["weights"][k] == again["weights"][k]).all() for k in model["weights"])
    # The weights are those of the best epoch.
    rows = network.prepared(held, ["a", "b"], model["scale"]).select("x", "hand", "position", "y", "fold")
    assert network.loss(network.summed(rows, model["weights"], 2, gradient=False)[0]) == pytest.approx(min(h["valid_loss"] for h in history), abs=network.BETTER)
    out = network.predict(network.loads(network.dumps(model)), held)
    assert metrics.summary(out).first()["accuracy"] > 0.5
    assert out.where("villain_fold_p between 0 and 1").count() == held.count()
    assert network.predict(model, held.limit(0)).count() == 0


def test_a_step_goes_back_once_for_both_losses(spark, monkeypatch):
    """A gradient of a batch is one pass back over it, and inputs that are packed as bytes give the same figures."""
    df = decisions(spark, 300)
    rows = network.prepared(df, ["a", "b"], network.scales(df, ["a", "b"])).select("x", "hand", "position", "y", "fold").cache()
    assert network.packed(rows).schema["x"].dataType.simpleString() == "binary"
    weights = network.initial(2, 3, hand=2, position=2, hidden=(5, 4), seed=3)
    counts = (300, rows.where("fold >= 0").count())
    one, two = network.summed(rows, weights, 2, 0.2, 5), network.summed(network.packed(rows), weights, 2, 0.2, 5, counted=counts)
    assert np.allclose(one[0], two[0]) and all(np.allclose(one[1][k], two[1][k]) for k in weights)
    batch, passes, back = small_batch(), [], network._back
    monkeypatch.setattr(network, "_back", lambda *a: passes.append(1) or back(*a))
    weights = network.initial(3, 4, hand=2, position=2, hidden=(5, 4), seed=3)
    _, both = network.loss_and_gradient(weights, batch, each=(0.5, 0.25))
    assert len(passes) == 1
    _, parts = network.loss_and_gradient(weights, batch)
    assert all(np.allclose(both[k], 0.5 * parts["action"][k] + 0.25 * parts["villain"][k]) for k in weights)


@pytest.mark.parametrize("share", [0.1, 0.0, 1.0, 0.37])
def test_holdout_is_that_of_the_split_and_moves_no_rows(spark, share):
    df = decisions(spark, 900).withColumn("y", F.when(F.col("source_index") % 50 > 0, F.col("y")))
    got = metrics.holdout(df, "y", ("split", "source_index"), share)
    want = metrics.stratified_split(df, "y", ("split", "source_index"), share)
    assert {r[:] for r in got.select("source_index", "part").collect()} == {r[:] for r in want.select("source_index", "part").collect()}
    assert got.columns == [*df.columns, "part"]
    plan = got._jdf.queryExecution().executedPlan().toString().split("BroadcastExchange")[0]
    assert "Exchange hash" not in plan and "SortMergeJoin" not in plan


# Calibration, search, stacking


def scored_rows(n=900, seed=2):
    """Chances of three classes that are too sure of themselves."""
    rng = np.random.default_rng(seed)
    p = rng.dirichlet([1, 1, 1], n)
    y = np.array([rng.choice(3, p=row) for row in p])
    sharp = p**3 / (p**3).sum(1, keepdims=True)
    return sharp, y


def test_sigmoids_equal_a_plain_fit(spark):
    p, y = scored_rows(300)
    rows = [(i % 2, k, float(p[i, k]), int(y[i] == k)) for i in range(300) for k in range(3)]
    groups = [(f, k) for f in range(2) for k in range(3)]
    found = calibration.sigmoids(spark.createDataFrame(rows, "fold int, k int, s double, hit int"), groups)
    for f, k in groups:
        own = [(s, hit) for a, b, s, hit in rows if (a, b) == (f, k)]
        pos = sum(h for _, h in own)
        t = [(pos + 1) / (pos + 2) if h else 1 / (len(own) - pos + 2) for _, h in own]
        a, b = 0.0, 0.0
        for _ in range(20000):  # plain gradient descent
            q = [1 / (1 + math.exp(a * s + b)) for s, _ in own]
            a -= 0.02 * sum((ti - qi) * s for ti, qi, (s, _) in zip(t, q, own))
            b -= 0.02 * sum(ti - qi for ti, qi in zip(t, q))
        assert (found[f, k]["a"], found[f, k]["b"]) == pytest.approx((a, b), abs=1e-3)


def test_calibrated_chances():
    p = np.array([[0.2, 0.3, 0.5], [1.0, 0.0, 0.0]])
    curves = [{"x": [0.0, 1.0], "y": [0.0, 0.5]}, {"x": [0.3], "y": [0.0]}, {"x": [0.0, 0.5], "y": [0.0, 0.4]}]
    assert np.allclose(calibration.calibrated(p, curves), [[0.2, 0, 0.8], [1, 0, 0]])
    assert np.allclose(calibration.calibrated(np.zeros((1, 3)), curves), 1 / 3)
    two = calibration.calibrated(np.array([[0.4, 0.6]]), [{}, {"a": -2.0, "b": 1.0}])
    assert np.allclose(two, [[1 - 1 / (1 + math.exp(-0.2)), 1 / (1 + math.exp(-0.2))]])


class Sure:
    """A base that knows nothing and returns the row's own sharp chances."""

    def __new__(cls):
        from pyspark.ml import Transformer

        class Fixed(Transformer):
            labelCol = "y"

            def getOrDefault(self, name):
                return {"labelCol": "y"}[name]

            def fit(self, df):
                return self

            def _transform(self, df):
                return df.withColumn("probability", F.col("features"))

        return Fixed()


@pytest.mark.parametrize("method", ["sigmoid", "isotonic"])
def test_calibration_lowers_the_loss(spark, method):
    p, y = scored_rows()
    df = spark.createDataFrame([("train", i, Vectors.dense(a), float(b)) for i, (a, b) in enumerate(zip(p.tolist(), y.tolist()))], ["split", "source_index", "features", "y"])
    model = calibration.CrossFitted(base=Sure(), classes=3, method=method).fit(df.where("source_index < 600"))
    assert len(model.bases) == 3
    held = df.where("source_index >= 600")
    out = {r["source_index"]: (r["probability"].toArray(), int(r["y"])) for r in model.transform(held).collect()}
    loss = lambda rows: -np.mean([math.log(max(q[k], 1e-15)) for q, k in rows])
    assert all(abs(q.sum() - 1) < 1e-9 for q, _ in out.values())
    assert loss(out.values()) < loss([(p[i], y[i]) for i in out])
    assert calibration.CrossFitted(base=Sure(), classes=3, method=method).fit(df.limit(150)).__class__.__name__ == "Fixed"
    with pytest.raises(ValueError, match="no curve"):
        calibration.CrossFitted(base=Sure(), classes=3, method="spline")


def feature_rows(spark, n=260, seed=6):
    rng = random.Random(seed)
    rows = []
    for i in range(n):
        x = [float(rng.randrange(4)) for _ in FEATURES]
        rows.append(("train", i, ["call", "fold", "raise"][int(x[0] + rng.random() < 2) + int(x[1] > 1.5)], int(rng.random() < 0.5), *x))
    return spark.createDataFrame(rows, f"split string, source_index long, label string, villain_fold int, {', '.join(f'{f} double' for f in FEATURES)}")


def test_heads_are_calibrated_saved_and_loaded(spark, tmp_path):
    df = feature_rows(spark)
    make = lambda n: boosting.Boosting(rounds=2, depth=2, rate=0.5)
    heads = ml.train_heads(df, make)
    assert set(heads) == {"action", "villain"}
    assert all(isinstance(h.stages[-1], calibration.CalibratedModel) for h in heads.values())
    ml.save_heads(heads, str(tmp_path))
    back = ml.load_heads(["action", "villain"], str(tmp_path))
    one, two = (sorted(map(str, ml.predict(h["action"], df).select("source_index", "predicted", "p").collect())) for h in (heads, back))
    assert one == two and len(one) == df.count()
    assert isinstance(back["villain"], PipelineModel)
    top = ml.importances(heads["action"], 2)
    assert {name for name, _ in top} == set(FEATURES[:2])
    assert ml.train_action(df.limit(40), make).stages[-1].__class__.__name__ == "BoostedModel"


def test_random_search_is_reproducible(spark):
    ranges = {**ml.RANGES, "rounds": ("int", 2, 4), "depth": ("int", 1, 3)}
    assert ml.sampled(50, ranges, 3) == ml.sampled(50, ranges, 3) != ml.sampled(50, ranges, 4)
    for setting in ml.sampled(200):
        assert set(setting) == set(ml.RANGES) and all(low <= setting[k] <= high for k, (_, low, high) in ml.RANGES.items())
    found = ml.tune(feature_rows(spark, 120), trials=3, k=2, rungs=2, cut=3, ranges=ranges, seed=5)
    assert [(r["rung"], round(r["share"], 3)) for r in found] == [(1, 1.0), (0, 0.333), (0, 0.333), (0, 0.333)]
    assert found[0]["trial"] == found[1]["trial"] and found[1]["log_loss"] <= found[2]["log_loss"] <= found[3]["log_loss"]
    assert found == ml.tune(feature_rows(spark, 120), trials=3, k=2, rungs=2, cut=3, ranges=ranges, seed=5)


def test_a_failing_base_is_left_out(spark):
    def broken(n):
        raise RuntimeError("no such library")

    df = feature_rows(spark, 90)
    final, model = ml.stack(df, {"broken": broken, "logistic": ml.CLASSIFIERS["logistic"]}, k=2)
    assert list(final) == ["logistic"] and metrics.summary(ml.apply_stack(final, model, df)).first()["n"] == 90
    with pytest.raises(ValueError, match="no base"):
        ml.stack(df, {"broken": broken}, k=2)


def test_bundles_are_checked_before_scoring(spark, tmp_path):
    df = feature_rows(spark)
    heads = ml.train_heads(df, lambda n: ml.forest(3, 3), calibrate=None)
    ml.save_bundle(heads, str(tmp_path), thresholds={"trust": 0.6})
    bundle = ml.load_bundle(str(tmp_path))
    out = ml.apply_bundle(bundle, df.drop("label"))
    assert out.where("trusted <> (p_max >= 0.6) or villain_fold_p is null").isEmpty() and out.count() == df.count()
    assert set(bundle["labels"]) == {"call", "fold", "raise"}
    with pytest.raises(ValueError, match="another order"):
        ml.apply_bundle({**bundle, "features": list(reversed(FEATURES))}, df)
    with pytest.raises(ValueError, match="missing"):
        ml.apply_bundle({**bundle, "features": list(FEATURES[1:])}, df)
    with pytest.raises(ValueError, match="rows lack"):
        ml.apply_bundle(bundle, df.drop(FEATURES[3]))
    with pytest.raises(ValueError, match="no numbers"):
        ml.apply_bundle(bundle, df.withColumn(FEATURES[3], F.lit("x")))
    with pytest.raises(ValueError, match="labels"):
        ml.apply_bundle({**bundle, "labels": ["call"]}, df)


#: What each learning query must say of its rows on the smallest tables.
FIGURES = {
    "ml_action_head": lambda rows: {r["calibration"] for r in rows} == {"none", "sigmoid", "isotonic"} and all(0 < r["accuracy"] < 1 and r["log_loss"] > 0 for r in rows) and rows[1]["log_loss"] < math.log(5),
    "ml_villain_head": lambda rows: len(rows) == 1 and (rows[0]["brier"] is None or rows[0]["brier"] < 0.3),
    "ml_success": lambda rows: sorted(r["target"] for r in rows) == [0.5, 0.7, 0.9] and all(r["k"] is None or r["accuracy"] >= r["target"] for r in rows),
    "ml_multi_algo": lambda rows: {r["model"] for r in rows} == set(ml.CLASSIFIERS) and all(r["n"] == rows[0]["n"] for r in rows),
    "ml_rf_zoo": lambda rows: len(rows) == 4 and all(r["top2_accuracy"] >= r["accuracy"] for r in rows),
    "ml_torch_mlp": lambda rows: len(rows) == 1 and rows[0]["log_loss"] < math.log(5) + 0.1 and rows[0]["epoch"] >= 0,
    "ml_tune": lambda rows: len(rows) == 5 and rows[0]["rung"] == 1 and set(ml.RANGES) <= set(rows[0].asDict()),
    "ml_stack": lambda rows: rows[0]["n"] > 100 and rows[0]["accuracy"] > 0.2,
    "ml_predict": lambda rows: len(rows) > 100 and all(r["trusted"] == (r["p_max"] >= 0.4) for r in rows),
}


@pytest.mark.parametrize("name", FIGURES)
def test_learning_queries(spark, name):
    assert FIGURES[name](catalog.QUERIES[name](spark, SF).collect())


def test_forests_keep_the_nodes_of_rows(spark):
    """A forest doesn't walk rows down its trees at each level; it grows the trees of one that does."""
    rows = ml.assemble(spark.range(600).selectExpr(*[f"cast((id * {7 + i}) % {11 + i} as double) as {c}" for i, c in enumerate(FEATURES)], "cast(id * 37 % 3 as double) as y").repartition(2))
    head = ml.forest(trees=4, depth=6)
    assert head.getCacheNodeIds()
    trees = lambda m: m.toDebugString.split("\n", 1)[1]
    assert trees(head.fit(rows)) == trees(head.copy({head.cacheNodeIds: False}).fit(rows))


def test_feature_rows_parse_their_lines_once(spark, monkeypatch):
    """Features and the holdout start from written samples: neither derives the scenarios again."""
    from riverdeck.plans import learning

    seen, real = [], metrics.holdout

    def holdout(df, *a, of=None, **k):
        seen.extend([df, of])
        return real(df, *a, of=of, **k)

    monkeypatch.setattr(metrics, "holdout", holdout)
    assert learning._rows(spark, SF).count() > 1000
    plans = [d._jdf.queryExecution().optimizedPlan().toString() for d in seen]
    assert len(plans) == 2 and not any("listagg" in p or "o_orderkey" in p for p in plans)


def test_folds_grow_together_as_they_do_alone(spark):
    """Models of several parts of the rows are those of each part by itself, where bins are the same."""
    df = ml.assemble(spark.range(300).selectExpr("id", *[f"cast(pmod(hash(id, {i}), {3 + i % 5}) as double) as {c}" for i, c in enumerate(FEATURES)], "cast(pmod(hash(id, 1), 3) as double) as y").repartition(2, "id"))
    head = ml.Boosting(rounds=12, depth=3, subsample=1.0, least=2)
    fold = F.pmod(F.col("id"), F.lit(3))
    together = head.fit_parts(df, [fold != f for f in range(3)])
    for f, model in enumerate(together):
        edges, prior, rounds = model.parts()
        alone, own, trees = head.fit(df.where(fold != f)).parts()
        assert [e.tolist() for e in edges] == [e.tolist() for e in alone] and prior.tolist() == own.tolist()
        for a, b in zip((t for r in rounds for t in r), (t for r in trees for t in r)):
            assert a["feature"] == b["feature"] and a["bin"] == b["bin"] and np.allclose(a["value"], b["value"])


def test_queries_do_the_whole_search(spark, monkeypatch):
    """The tuned heads have 200 to 800 rounds and the compared ones 400 rounds, 400 trees and up to 2,000 iterations."""
    from riverdeck.plans import learning

    seen = {}
    monkeypatch.setattr(learning, "_parts", lambda spark, sf: (None, None))
    monkeypatch.setattr(ml, "tune", lambda train, ranges=ml.RANGES, **k: seen.update(ranges=ranges) or [{"a": 1}])
    monkeypatch.setattr(learning, "_compare", lambda train, held, makers, **k: seen.update({n: make(5) for n, make in makers.items()}))
    learning.ml_tune(spark, SF), learning.ml_multi_algo(spark, SF)
    assert seen["ranges"] == ml.RANGES and seen["ranges"]["rounds"] == ("int", 200, 800)
    assert seen["boosting"].getOrDefault("rounds") == 400 and seen["random_forest"].getNumTrees() == 400 and seen["logistic"].getMaxIter() == 2000


def test_folds_are_fitted_side_by_side(spark):
    """The three fits of a cross-fitted head meet at a barrier: one after the other they would wait for ever."""
    import threading

    from pyspark.ml.classification import LogisticRegression

    barrier = threading.Barrier(3)

    class Meeting(LogisticRegression):
        def _fit(self, df):
            barrier.wait(60)
            return super()._fit(df)

    rows = ml.assemble(spark.range(300).selectExpr("'train' as split", "id as source_index", *[f"cast(pmod(hash(id, {i}), 5) as double) as {c}" for i, c in enumerate(FEATURES)], "cast(id % 2 as double) as y"))
    model = calibration.CrossFitted(base=Meeting(labelCol="y", maxIter=3), classes=2).fit(rows)
    assert len(model.bases) == 3
