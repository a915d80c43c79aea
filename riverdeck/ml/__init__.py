"""Classifiers on MLlib and on boosted trees: action head, villain head, calibration, stacking, success model, search."""

from __future__ import annotations

import json
import logging

import numpy as np
from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.classification import GBTClassifier, LogisticRegression, MultilayerPerceptronClassifier, RandomForestClassifier
from pyspark.ml.feature import StringIndexer, VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import DataFrame, SparkSession, functions as F, types as T

from ..operators import metrics
from ..operators.features import FEATURES
from ..sources.shared import place, side_by_side
from .boosting import Boosting
from .calibration import CrossFitted, importances_of

#: What a hand is known by.
KEY = ("split", "source_index")
log = logging.getLogger(__name__)

#: The action classifiers by name, for a number of classes; each works on the column ``features``.
CLASSIFIERS = {
    "boosting": lambda classes: Boosting(),
    "random_forest": lambda classes: forest(),
    "logistic": lambda classes: LogisticRegression(labelCol="y", maxIter=60, standardization=True),
    "mlp": lambda classes: MultilayerPerceptronClassifier(labelCol="y", layers=[len(FEATURES), 64, 32, classes], maxIter=60, seed=7),
}


def forest(trees: int = 40, depth: int = 10, least: int = 5, **more) -> RandomForestClassifier:
    """Rows carry the nodes they are at, so that a level doesn't walk each of them down every tree again; the trees are the same."""
    return RandomForestClassifier(labelCol="y", numTrees=trees, maxDepth=depth, minInstancesPerNode=least, maxBins=64, cacheNodeIds=True, seed=7, **more)


def assemble(df: DataFrame, columns: list[str] = FEATURES, to: str = "features") -> DataFrame:
    return VectorAssembler(inputCols=list(columns), outputCol=to).transform(df)


def train_action(df: DataFrame, make=None, label: str = "label", calibrate: str | None = "sigmoid") -> PipelineModel:
    """Labels are numbered in alphabetical order; rows without label are left out.  ``make``: number of classes -> classifier.

    From 200 rows on chances are calibrated over three folds (``calibrate``: sigmoid, isotonic or None).
    """
    return train_actions(df, [calibrate], make, label)[calibrate]


def train_actions(df: DataFrame, calibrations: list[str | None], make=None, label: str = "label") -> dict[str | None, PipelineModel]:
    """``train_action`` for several calibrations; those that are calibrated share the folds' bases."""
    known = df.where(F.col(label).isNotNull())
    index = StringIndexer(inputCol=label, outputCol="y", stringOrderType="alphabetAsc").fit(known)
    assembler = VectorAssembler(inputCols=list(FEATURES), outputCol="features")
    head, rows = (make or CLASSIFIERS["random_forest"])(len(index.labels)), assembler.transform(index.transform(known))
    methods = [c for c in calibrations if c]
    found = CrossFitted(base=head, classes=len(index.labels), method=methods[0]).fit_methods(rows, methods) if methods else {}
    if len(methods) < len(calibrations):
        found[None] = head.fit(rows)
    return {c: PipelineModel([index, assembler, found[c]]) for c in calibrations}


def classes(model: PipelineModel) -> list[str]:
    return list(model.stages[0].labels)


def predict(model: PipelineModel, df: DataFrame) -> DataFrame:
    """``df`` with the predicted label, its probability and all of them; no label is read."""
    names = F.array(*[F.lit(x) for x in classes(model)])
    scored = PipelineModel(model.stages[1:]).transform(df).withColumn("p", vector_to_array("probability"))
    at = metrics.argmax(F.col("p"))
    return scored.select(*df.columns, F.get(names, at).alias("predicted"), F.array_max("p").alias("p_max"), "p")


def train_heads(df: DataFrame, make=None, calibrate: str | None = "sigmoid") -> dict[str, PipelineModel]:
    """Action and villain heads by name; the villain's is left out where it can't be learnt."""
    action, villain = side_by_side([lambda: train_action(df, make, calibrate=calibrate), lambda: train_villain(df, calibrate=calibrate)])
    return {k: m for k, m in (("action", action), ("villain", villain)) if m is not None}


def save_heads(heads: dict[str, PipelineModel], folder: str) -> None:
    for name, model in heads.items():
        model.write().overwrite().save(f"{folder}/{name}")


def load_heads(names: list[str], folder: str) -> dict[str, PipelineModel]:
    return {name: PipelineModel.load(f"{folder}/{name}") for name in names}


def save_bundle(heads: dict[str, PipelineModel], folder: str, thresholds: dict[str, float] | None = None) -> None:
    """Heads with what scoring must agree on: the features in their order, the labels, and thresholds by name."""
    save_heads(heads, f"{folder}/heads")
    about = {"version": 1, "heads": sorted(heads), "features": list(FEATURES), "labels": classes(heads["action"]), "thresholds": thresholds or {}}
    spark = SparkSession.active()
    spark.createDataFrame([(json.dumps(about),)], "value string").coalesce(1).write.mode("overwrite").text(f"{folder}/about")


def load_bundle(folder: str) -> dict:
    spark = SparkSession.active()
    about = json.loads(spark.read.text(f"{folder}/about").first()["value"])
    return {**about, "models": load_heads(about["heads"], f"{folder}/heads")}


def apply_bundle(bundle: dict, df: DataFrame) -> DataFrame:
    """``df`` with predicted, p_max, ``trusted`` (p_max is at least the threshold trust; all are where none is set) and villain_fold_p where the bundle has that head.

    A bundle whose features are others than the library's, or in another order, is refused, as are rows that lack a feature or have one that is no number.
    """
    if bundle["features"] != list(FEATURES):
        known, own = set(FEATURES), set(bundle["features"])
        raise ValueError(f"the bundle's features differ: unknown {sorted(own - known)}, missing {sorted(known - own)}" if known != own else "the bundle's features are in another order")
    kinds = {f.name: f.dataType for f in df.schema.fields}
    if lacking := [c for c in FEATURES if c not in kinds]:
        raise ValueError(f"rows lack the features {lacking}")
    if odd := [c for c in FEATURES if not isinstance(kinds[c], (T.NumericType, T.BooleanType))]:
        raise ValueError(f"features that are no numbers: {odd}")
    if bundle["labels"] != classes(bundle["models"]["action"]):
        raise ValueError("the bundle's labels are not those of its action head")
    trust = bundle["thresholds"].get("trust", 0.0)
    out = predict(bundle["models"]["action"], df).drop("p").withColumn("trusted", F.col("p_max") >= trust)
    if "villain" in bundle["models"]:
        names = out.columns
        out = bundle["models"]["villain"].transform(out).select(*names, F.get(vector_to_array("probability"), F.lit(1)).alias("villain_fold_p"))
    return out


def evaluate(heads: dict[str, PipelineModel], df: DataFrame) -> DataFrame:
    """One row: accuracy, top-2 accuracy, log loss and macro F1 of the action head, Brier score of the villain head, and bluff figures where it is known."""
    scored = metrics.scored(probabilities(heads["action"], df))
    out = metrics.summary(scored.select("p", "y")).crossJoin(metrics.averages(metrics.per_class(scored)).select("macro_f1"))
    if "villain" in heads:
        villain = heads["villain"].transform(df).withColumn("vp", F.get(vector_to_array("probability"), F.lit(1)))
        out = out.crossJoin(metrics.brier(villain, "vp", "villain_fold").select(F.col("brier").alias("villain_fold_brier"))).crossJoin(metrics.bluff_summary(villain, "vp", "pot_bb", "facing_bet_bb"))
    return out


def probabilities(model: PipelineModel, df: DataFrame, to: str = "p") -> DataFrame:
    """``df`` with the class probabilities as an array, and the label's number."""
    out = model.transform(df.where("label is not null"))
    return out.select(*df.columns, F.col("y").cast("int").alias("y"), vector_to_array("probability").alias(to))


def train_villain(df: DataFrame, label: str = "villain_fold", calibrate: str | None = "sigmoid"):
    """None with fewer than 100 known labels or only one class; calibrated like the action head."""
    known = df.where(F.col(label) >= 0)
    seen = known.groupBy(label).count().collect()  # two rows at most
    if sum(r[1] for r in seen) < 100 or len(seen) < 2:
        return None
    head = GBTClassifier(labelCol=label, maxIter=20, maxBins=64, seed=7)
    if calibrate:
        head = CrossFitted(base=head, classes=2, method=calibrate)
    return Pipeline(stages=[VectorAssembler(inputCols=list(FEATURES), outputCol="features"), head]).fit(known)


def calibrate(df: DataFrame, p: str, y: str, method: str = "isotonic"):
    """A fitted map from a score to the chance that y is 1: isotonic, or a logistic curve (Platt)."""
    if method == "isotonic":
        return IsotonicRegression(featuresCol=p, labelCol=y, predictionCol="calibrated").fit(df.withColumn(y, F.col(y).cast("double")))
    return Pipeline(stages=[VectorAssembler(inputCols=[p], outputCol="_p"), LogisticRegression(featuresCol="_p", labelCol=y)]).fit(df)


def stack(df: DataFrame, bases: dict, k: int = 5, seed: int = 7) -> tuple[dict, PipelineModel]:
    """Out-of-fold probabilities of the base models, then a logistic model on them; the bases are fitted again on all rows.

    A base that can't be fitted is left out with a warning; only if all fail is that an error.
    """
    rows = metrics.folds(df.where("label is not null"), "label", KEY, k, seed).persist()
    try:
        def whole(name):
            try:
                return train_action(rows, bases[name], calibrate=None)
            except Exception as e:  # whatever a library of models raises
                log.warning("base %s is left out: %s", name, e)

        final = {n: m for n, m in zip(bases, side_by_side([lambda n=n: whole(n) for n in bases])) if m is not None}
        if not final:
            raise ValueError("no base could be fitted")
        wanted = [(fold, name) for fold in range(k) for name in final]
        fitted = dict(zip(wanted, side_by_side([lambda f=f, n=n: train_action(rows.where(F.col("fold") != f), bases[n], calibrate=None) for f, n in wanted])))
        parts = None
        for fold in range(k):
            held = rows.where(F.col("fold") == fold)
            for name in final:
                held = probabilities(fitted[fold, name], held, f"p_{name}").drop("y")
            parts = held if parts is None else parts.unionByName(held)
        meta = _stacked(parts, list(final), max(len(classes(m)) for m in final.values()))
        path = place(df.sparkSession, "stacked")  # all bases are applied once, not in each pass of the last fit
        meta.select("label", *[c for c in meta.columns if c.startswith("z_")]).write.parquet(path)
        meta = df.sparkSession.read.parquet(path)
        stages = [StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc"), VectorAssembler(inputCols=[c for c in meta.columns if c.startswith("z_")], outputCol="z"), LogisticRegression(featuresCol="z", labelCol="y", maxIter=60)]
        return final, Pipeline(stages=stages).fit(meta)
    finally:
        rows.unpersist()


def _stacked(df: DataFrame, names: list[str], n: int) -> DataFrame:
    return df.select(*df.columns, *[F.coalesce(F.get(f"p_{name}", F.lit(i)), F.lit(0.0)).alias(f"z_{name}_{i}") for name in names for i in range(n)])


def apply_stack(final: dict, model: PipelineModel, df: DataFrame) -> DataFrame:
    for name, base in final.items():
        df = probabilities(base, df, f"p_{name}").drop("y")
    out = model.transform(_stacked(df, list(final), max(len(classes(m)) for m in final.values())))
    return out.select("source_index", F.col("y").cast("int").alias("y"), vector_to_array("probability").alias("p"))


def train_success(scored: DataFrame, trees: int = 400) -> PipelineModel:
    """The chance that a prediction is right, from features, confidence figures and the prediction rows' ``correct``."""
    columns = [*FEATURES, "p_max", "entropy", "margin"]
    return Pipeline(stages=[VectorAssembler(inputCols=columns, outputCol="meta"), RandomForestClassifier(featuresCol="meta", labelCol="correct", numTrees=trees, minInstancesPerNode=5, seed=7)]).fit(scored)


#: The ranges of a boosted head's settings: whole numbers, numbers, and numbers drawn by their logarithm.
RANGES = {
    "rounds": ("int", 200, 800),
    "rate": ("log", 0.01, 0.2),
    "depth": ("int", 4, 7),
    "least": ("int", 1, 100),
    "subsample": ("float", 0.6, 1.0),
    "columns": ("float", 0.6, 1.0),
    "l1": ("log", 1e-4, 10.0),
    "l2": ("log", 1e-4, 10.0),
}


def sampled(trials: int, ranges: dict = RANGES, seed: int = 7) -> list[dict]:
    """Settings drawn at random, the same for the same seed."""
    rng = np.random.default_rng(seed)
    out = []
    for _ in range(trials):
        setting = {}
        for name, (kind, low, high) in ranges.items():
            x = np.exp(rng.uniform(np.log(low), np.log(high))) if kind == "log" else rng.uniform(low, high + (kind == "int"))
            setting[name] = min(high, int(x)) if kind == "int" else float(x)
        out.append(setting)
    return out


def cross_loss(rows: DataFrame, make, k: int, share: float = 1.0, seed: int = 7) -> float:
    """Mean log loss over the k folds of ``rows`` (column fold), learnt from a share of the other folds' rows, by hash; boosted trees of all folds grow together."""
    part = F.pmod(F.xxhash64(F.lit(seed), *KEY), F.lit(1 << 20)) < int(share * (1 << 20))
    index = StringIndexer(inputCol="label", outputCol="y", stringOrderType="alphabetAsc").fit(rows)
    numbered, head = assemble(index.transform(rows)), make(len(index.labels))
    if isinstance(head, Boosting):
        models = head.fit_parts(numbered, [(F.col("fold") != f) & part for f in range(k)])
        scored = [model.transform(numbered.where(F.col("fold") == f)).select(F.col("y").cast("int").alias("y"), vector_to_array("probability").alias("p")) for f, model in enumerate(models)]
    else:
        scored = [probabilities(train_action(rows.where((F.col("fold") != f) & part), make, calibrate=None), rows.where(F.col("fold") == f)) for f in range(k)]
    return sum(metrics.summary(df).first()["log_loss"] for df in scored) / k


def tune(df: DataFrame, trials: int = 16, k: int = 5, rungs: int = 3, cut: int = 3, ranges: dict = RANGES, seed: int = 7, parallel: int = 4) -> list[dict]:
    """Random search with successive halving over boosted heads: rows of setting, rung, share and log_loss, the best of the last rung first.

    On each rung the best of ``cut`` settings go on, with ``cut`` times the rows and trees, all on the last; fits of a rung run side by side.
    """
    path = place(df.sparkSession, "tune")
    metrics.folds(df.where("label is not null"), "label", KEY, k, seed).write.parquet(path)
    rows = df.sparkSession.read.parquet(path)
    left, found = list(enumerate(sampled(trials, ranges, seed))), []
    for rung in range(rungs):
        share = float(cut) ** (rung - rungs + 1)

        def judged(one, share=share):
            number, setting = one
            own = {**setting, "rounds": max(1, round(setting["rounds"] * share))}
            return cross_loss(rows, lambda classes: Boosting(**own), k, share, seed), number, setting

        results = sorted(side_by_side([lambda one=one: judged(one) for one in left], parallel), key=lambda r: r[:2])
        found = [{"trial": number, "rung": rung, "share": share, "log_loss": loss, **setting} for loss, number, setting in results] + found
        left = [(number, setting) for _, number, setting in results[: max(1, len(results) // cut)]]
    return found


def importances(model: PipelineModel, most: int = 20) -> list[tuple[str, float]]:
    return sorted(zip(FEATURES, importances_of(model.stages[-1]).tolist()), key=lambda x: (-x[1], x[0]))[:most]
