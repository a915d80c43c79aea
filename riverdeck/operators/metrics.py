"""Evaluation of classifiers: each metric is one aggregate, or one window, over prediction rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

EPS = 1e-15


def argmax(p: Column) -> Column:
    """The first index of the highest probability."""
    return (F.array_position(p, F.array_max(p)) - 1).cast("int")


def entropy(p: Column) -> Column:
    return -F.aggregate(F.transform(p, lambda x: F.greatest(x, F.lit(1e-12))), F.lit(0.0), lambda a, x: a + x * F.ln(x))


def top_margin(p: Column) -> Column:
    """Highest less second highest probability; 0 with a single class."""
    s = F.sort_array(p, asc=False)
    return F.when(F.size(p) < 2, 0.0).otherwise(F.get(s, F.lit(0)) - F.get(s, F.lit(1)))


def rank_of_true(p: Column, y: Column) -> Column:
    """1 for the most probable; of equal ones the later index counts as better, so ties help no one twice."""
    mine = F.get(p, y)
    return F.size(F.filter(F.transform(p, lambda x, i: F.struct(x.alias("x"), i.alias("i"))), lambda s: (s["x"] > mine) | ((s["x"] == mine) & (s["i"] > y)))) + 1


def scored(df: DataFrame, proba: str = "p", y: str = "y") -> DataFrame:
    """Predictions, correctness and confidence figures."""
    p = F.col(proba)
    return df.withColumns({"pred": argmax(p), "p_max": F.array_max(p), "entropy": entropy(p), "margin": top_margin(p), "true_rank": rank_of_true(p, F.col(y))}).withColumn("correct", (F.col("pred") == F.col(y)).cast("int"))


def summary(df: DataFrame, proba: str = "p", y: str = "y") -> DataFrame:
    """accuracy, top2_accuracy and log_loss in one pass."""
    clipped = F.greatest(F.lit(EPS), F.least(F.lit(1 - EPS), F.get(proba, F.col(y))))
    return scored(df, proba, y).agg(F.count("*").alias("n"), F.avg("correct").alias("accuracy"), F.avg((F.col("true_rank") <= 2).cast("int")).alias("top2_accuracy"), F.avg(-F.ln(clipped)).alias("log_loss"))


def brier(df: DataFrame, p: str, y: str) -> DataFrame:
    """Over rows whose label is known (at least 0); null without any."""
    return df.where(F.col(y) >= 0).agg(F.count("*").alias("n"), F.avg(F.pow(F.col(p) - F.col(y), 2)).alias("brier"))


def bluff_ev(p: Column, pot: Column, bet: Column) -> Column:
    return p * pot - (1 - p) * bet


def imputed_bet(df: DataFrame, bet: str, default: float = 3.0) -> DataFrame:
    """A bet of 0 becomes the mean of the others, or ``default`` if all are 0."""
    mean = df.where(F.col(bet) != 0).agg(F.avg(bet).alias("_mean"))
    return df.crossJoin(F.broadcast(mean)).withColumn(bet, F.when(F.col(bet) == 0, F.coalesce("_mean", F.lit(default))).otherwise(F.col(bet))).drop("_mean")


def bluff_summary(df: DataFrame, p: str, pot: str, bet: str) -> DataFrame:
    ev = bluff_ev(F.col(p), F.col(pot), F.col(bet))
    return imputed_bet(df, bet).agg(F.avg(ev).alias("bluff_ev_mean"), F.avg((ev > 0).cast("int")).alias("bluff_positive_frac"))


def confusion(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Counts of (label, prediction), with the share in the label's row."""
    n = df.groupBy(F.col(y).alias("y"), F.col(pred).alias("pred")).agg(F.count("*").alias("n"))
    return n.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy("y")))


def per_class(df: DataFrame, y: str = "y", pred: str = "pred") -> DataFrame:
    """Precision, recall, F1 and support of each class; 0 where undefined."""
    each = F.explode(F.array_distinct(F.array(F.col(y), F.col(pred)))).alias("c")
    rows = df.select(F.col(y).alias("y"), F.col(pred).alias("pred"), each)
    n = lambda c: F.sum(c.cast("int"))
    sums = rows.groupBy("c").agg(n((F.col("y") == F.col("c")) & (F.col("pred") == F.col("c"))).alias("tp"), n(F.col("pred") == F.col("c")).alias("predicted"), n(F.col("y") == F.col("c")).alias("support"))
    safe = lambda a, b: F.coalesce(F.try_divide(a, b), F.lit(0.0))
    pr = sums.select("c", safe(F.col("tp"), F.col("predicted")).alias("precision"), safe(F.col("tp"), F.col("support")).alias("recall"), "support")
    return pr.withColumn("f1", safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def averages(classes: DataFrame) -> DataFrame:
    """Macro and weighted averages of ``per_class``."""
    macro = [F.avg(m).alias(f"macro_{m}") for m in ("precision", "recall", "f1")]
    weighted = [(F.sum(F.col(m) * F.col("support")) / F.sum("support")).alias(f"weighted_{m}") for m in ("precision", "recall", "f1")]
    return classes.agg(*macro, *weighted)


def _by_score(df: DataFrame, score: str, y: str) -> DataFrame:
    """Positives and negatives at each score: as many rows as there are different scores."""
    return df.groupBy(F.col(score).alias("s")).agg(F.sum(F.col(y)).alias("pos"), F.sum(1 - F.col(y)).alias("neg"))


#: Into how many ranges rows are cut by value before they are ranked.
RANGES = 256
BLOCKS = 16


def _bounds(value: str) -> Column:
    """Approximate quantiles of a column, in ``BLOCKS`` blocks, and the last one of each block but the last: an aggregate."""
    bounds, size = F.percentile_approx(value, [i / RANGES for i in range(1, RANGES)], 10_000), RANGES // BLOCKS
    blocks = F.array(*[F.slice(bounds, 1 + i * size, size) for i in range(BLOCKS)])
    return F.struct(blocks.alias("blocks"), F.array(*[F.get(bounds, F.lit(i * size - 1)) for i in range(1, BLOCKS)]).alias("lasts"))


def _range(value: Column, bounds: Column) -> Column:
    """The number of the range that a value lies in, ascending: even between bounds, odd for a bound itself, so that a value that many rows share is a range alone.

    The value is compared with the blocks' last bounds first, then with those of one block.
    """
    smaller = lambda of: F.size(F.filter(of, lambda e: e < value))

    one = lambda v, use: F.get(F.transform(F.array(v), use), F.lit(0))

    def place(b: Column, k: Column) -> Column:
        block = F.get(b["blocks"], k)
        at = smaller(block)
        return (k * (RANGES // BLOCKS) + at) * 2 + F.coalesce(F.get(block, at) == value, F.lit(False)).cast("int")

    return one(bounds, lambda b: one(smaller(b["lasts"]), lambda k: place(b, k)))


def _below(df: DataFrame, value: str, amounts: list[str]) -> DataFrame:
    """Rows of different values with ``below_`` (sum over all smaller values) and ``all_`` of each amount.

    Rows are added up within ranges; the ranges, some 500 at most, are added up in one task.
    """
    bounds = df.agg(_bounds(value).alias("_bounds"))
    ranged = df.crossJoin(F.broadcast(bounds)).withColumn("_b", _range(F.col(value), F.col("_bounds"))).drop("_bounds")
    sums = ranged.groupBy("_b").agg(*[F.sum(a).alias(f"_{a}") for a in amounts])
    before = Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sums.select("_b", *[F.coalesce(F.sum(f"_{a}").over(before), F.lit(0)).alias(f"_{a}") for a in amounts], *[F.sum(f"_{a}").over(Window.partitionBy()).alias(f"all_{a}") for a in amounts])
    inside = Window.partitionBy("_b").orderBy(value).rowsBetween(Window.unboundedPreceding, -1)
    running = [(F.col(f"_{a}") + F.coalesce(F.sum(a).over(inside), F.lit(0))).alias(f"below_{a}") for a in amounts]
    return ranged.join(F.broadcast(offsets), "_b").select(*df.columns, *running, *[f"all_{a}" for a in amounts])


def roc_auc(df: DataFrame, score: str, y: str) -> DataFrame:
    """Mann-Whitney with ties at one half; null with one class only.  Rows are added up by score first."""
    parts = _below(_by_score(df, score, y), "s", ["neg"]).select("pos", "neg", (F.col("pos") * (F.col("below_neg") + F.col("neg") / 2)).alias("wins"))
    return parts.agg(F.try_divide(F.sum("wins"), F.sum("pos") * F.sum("neg")).alias("roc_auc"))


def average_precision(df: DataFrame, score: str, y: str) -> DataFrame:
    """Sum over score steps of precision times the step in recall."""
    at_least = lambda a: F.col(f"all_{a}") - F.col(f"below_{a}")
    steps = _below(_by_score(df, score, y), "s", ["pos", "neg"]).select("pos", (at_least("pos") / (at_least("pos") + at_least("neg"))).alias("precision"))
    return steps.agg(F.try_divide(F.sum(F.col("precision") * F.col("pos")), F.sum("pos")).alias("average_precision"))


def percentiles(df: DataFrame, column: str, shares: list[float]) -> DataFrame:
    """One row, ``q``: the exact percentiles, between two values in proportion; nulls without any value."""
    counted = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    ranked = _below(counted, "v", ["n"])
    place = lambda q: F.lit(q) * (F.col("all_n") - 1)
    value = lambda k: F.min(F.when(F.col("below_n") + F.col("n") > k, F.col("v")))
    found = ranked.agg(F.max("all_n").alias("all_n"), *[value(f(place(q))).alias(f"{name}{i}") for i, q in enumerate(shares) for name, f in (("lo", F.floor), ("hi", F.ceil))])

    def between(i: int, q: float) -> Column:
        at, lo, hi = place(q), F.col(f"lo{i}").cast("double"), F.col(f"hi{i}").cast("double")
        return F.when(F.floor(at) == F.ceil(at), lo).otherwise((F.ceil(at) - at) * lo + (at - F.floor(at)) * hi)

    return found.select(F.array(*[between(i, q) for i, q in enumerate(shares)]).alias("q"))


def _prefixes(df: DataFrame, score: str, correct: str, key: str) -> DataFrame:
    """(n, k, hits, s): hits among the k best-scored rows, of equal scores those with the smaller key (a number) first.

    Rows are ranked within ranges of the score, a score that many rows share within ranges of the key; totals of the ranges above are added, so no task ranks all rows.
    """
    rows = df.select(F.col(score).alias("s"), F.col(correct).alias("c"), F.col(key).alias("id"))
    bounds = rows.agg(_bounds("s").alias("_s"), _bounds("id").alias("_id"))
    b = _range(F.col("s"), F.col("_s"))
    ranged = rows.crossJoin(F.broadcast(bounds)).withColumn("b", b).withColumn("d", F.when(F.col("b") % 2 == 1, _range(F.col("id"), F.col("_id"))).otherwise(0)).drop("_s", "_id")
    sums = ranged.groupBy("b", "d").agg(F.count("*").alias("_n"), F.sum("c").alias("_h"))  # a bounded number of ranges
    above = Window.orderBy(F.desc("b"), "d").rowsBetween(Window.unboundedPreceding, -1)
    zero = lambda c: F.coalesce(c, F.lit(0))
    offsets = sums.select("b", "d", zero(F.sum("_n").over(above)).alias("n0"), zero(F.sum("_h").over(above)).alias("h0"), F.sum("_n").over(Window.partitionBy()).alias("n"))
    inside = Window.partitionBy("b", "d").orderBy(F.desc("s"), "id").rowsBetween(Window.unboundedPreceding, 0)
    return ranged.join(F.broadcast(offsets), ["b", "d"]).select("n", (F.col("n0") + F.count("*").over(inside)).alias("k"), (F.col("h0") + F.sum("c").over(inside)).alias("hits"), "s")


def selective_curve(df: DataFrame, score: str, correct: str, key: str, points: int = 20) -> DataFrame:
    """Accuracy and threshold of the best-scored share of rows, for shares 1/points to 1; at least one row, halves rounded to even."""
    ranked = _prefixes(df, score, correct, key)
    grid = df.sparkSession.range(1, points + 1).select((F.col("id") / points).alias("coverage"))
    total = ranked.agg(F.max("n").alias("n"))
    wanted = grid.crossJoin(F.broadcast(total)).select("coverage", F.greatest(F.lit(1), F.bround(F.col("coverage") * F.col("n"), 0).cast("long")).alias("k"))
    return F.broadcast(wanted).join(ranked.drop("n"), "k").select("coverage", "k", (F.col("hits") / F.col("k")).alias("accuracy"), F.col("s").alias("threshold"))


def trust_policy(df: DataFrame, score: str, correct: str, key: str, targets: list[float]) -> DataFrame:
    """For each target accuracy the largest best-scored share that reaches it; nulls where none does."""
    ranked = _prefixes(df, score, correct, key)
    wanted = df.sparkSession.createDataFrame([(t,) for t in targets], "target double")
    best = [F.max(F.when(F.col("hits") >= F.lit(t) * F.col("k"), F.struct("k", "s", "hits", "n"))).alias(f"t{i}") for i, t in enumerate(targets)]
    one = ranked.agg(*best).select(F.explode(F.array(*[F.struct(F.lit(float(t)).alias("target"), F.col(f"t{i}").alias("best")) for i, t in enumerate(targets)])).alias("x")).select("x.*")
    return wanted.join(F.broadcast(one), "target", "left").select("target", F.col("best.k").alias("k"), (F.col("best.k") / F.col("best.n")).alias("coverage"), F.col("best.s").alias("threshold"), (F.col("best.hits") / F.col("best.k")).alias("accuracy"))


def nearest(curve: DataFrame, targets: DataFrame) -> DataFrame:
    """For each target coverage the curve's row that is nearest, the first of equals.  Both are a few rows."""
    gap = F.abs(F.col("coverage") - F.col("target"))
    return F.broadcast(targets).crossJoin(curve).groupBy("target").agg(F.min_by(F.struct("coverage", "accuracy", "threshold"), F.struct(gap, F.col("coverage"))).alias("r")).select("target", "r.*")


def calibration(df: DataFrame, p: str, y: str, bins: int = 10) -> DataFrame:
    """Mean probability and mean outcome in bins between exact quantiles (equal edges make one bin)."""
    edges = percentiles(df, p, [i / bins for i in range(1, bins)]).withColumnRenamed("q", "edges")
    binned = df.crossJoin(F.broadcast(edges)).select(F.col(p).alias("p"), F.col(y).alias("y"), F.size(F.filter(F.array_distinct("edges"), lambda e: F.col(p) > e)).alias("bin"))
    return binned.groupBy("bin").agg(F.count("*").alias("n"), F.avg("p").alias("mean_p"), F.avg("y").alias("mean_y"))


def describe(df: DataFrame, column: str) -> DataFrame:
    c = F.col(column)
    ps = percentiles(df, column, [0.1, 0.5, 0.9])
    figures = df.agg(F.count(c).alias("n"), F.avg(c).alias("mean"), F.stddev_samp(c).alias("std"), F.min(c).alias("min"), F.max(c).alias("max"))
    p = lambda i: F.get("q", F.lit(i))
    return figures.crossJoin(F.broadcast(ps)).select("n", "mean", "std", "min", p(0).alias("p10"), p(1).alias("p50"), p(2).alias("p90"), "max")


def clipped_histogram(df: DataFrame, column: str, bins: int = 40, quantile: float = 0.99) -> DataFrame:
    """Counts in bins of equal width from 0 to the quantile; larger values go to the last."""
    top = percentiles(df, column, [quantile]).select(F.get("q", F.lit(0)).alias("top"))
    c = F.col(column)
    at = F.least(F.lit(bins - 1), F.floor(F.least(c, F.col("top")) / (F.col("top") / bins)).cast("int"))
    return df.crossJoin(F.broadcast(top)).groupBy(at.alias("bin")).agg(F.count("*").alias("n"))


def pivot_share(df: DataFrame, row: str, column: str, values: list[str], rows: list[str] | None = None) -> DataFrame:
    """Shares of each row's counts by column value, 0 where none; ``rows``: only and all of these."""
    n = df.groupBy(row).pivot(column, values).agg(F.count(F.lit(1)))
    if rows is not None:
        n = df.sparkSession.createDataFrame([(r,) for r in rows], f"{row} string").join(n, row, "left")
    total = sum((F.coalesce(F.col(v), F.lit(0)) for v in values), F.lit(0))
    return n.select(row, *[F.coalesce(F.try_divide(F.coalesce(F.col(v), F.lit(0)), total), F.lit(0.0)).alias(f"share_{v}") for v in values])


def stratified_split(df: DataFrame, y: str, key: str | tuple[str, ...], share: float, seed: int = 7) -> DataFrame:
    """``part``: holdout for exactly that share of each class (rounded), by a hash of the key; else train.

    Rows are ranked within 256 hash ranges of each class, with the ranges before added, so that a large class is not one task.
    """
    keys = (key,) if isinstance(key, str) else key
    h = F.xxhash64(F.lit(seed), *keys)
    df = df.withColumns({"_h": h, "_b": F.pmod(F.shiftrightunsigned(h, 56), F.lit(256))})
    sizes = df.groupBy(y, "_b").agg(F.count("*").alias("_n"))
    w = Window.partitionBy(y).orderBy("_b")
    sizes = sizes.select(y, "_b", F.coalesce(F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("_before"), F.sum("_n").over(Window.partitionBy(y)).alias("_all"))
    row = F.row_number().over(Window.partitionBy(y, "_b").orderBy("_h", *keys))
    ranked = df.withColumn("_r", row).join(sizes, [y, "_b"])
    at = F.col("_before") + F.col("_r")
    return ranked.withColumn("part", F.when(at <= F.bround(F.col("_all") * share, 0), "holdout").otherwise("train")).withColumn("place", at).drop("_h", "_b", "_r", "_before", "_all")


def holdout(df: DataFrame, y: str, key: str | tuple[str, ...], share: float, seed: int = 7, of: DataFrame | None = None) -> DataFrame:
    """``df`` with the ``part`` of ``stratified_split``, for keys that differ, without moving rows: only hashes and keys are ranked, to find the last one of each class that is held out.

    ``of``: the same classes and keys where they are had for less than from ``df``.  Rows that share a key are on one side.
    """
    keys = (key,) if isinstance(key, str) else key
    h = F.xxhash64(F.lit(seed), *keys)
    b = F.pmod(F.shiftrightunsigned(h, 56), F.lit(256))
    narrow = (df if of is None else of).where(F.col(y).isNotNull()).select(F.col(y).alias("_y"), b.alias("_b"), h.alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    names = ["_h", *[f"_k{i}" for i in range(len(keys))]]
    w = Window.partitionBy("_y").orderBy("_b")
    sizes = narrow.groupBy("_y", "_b").agg(F.count("*").alias("_n"))
    sizes = sizes.select("_y", "_b", "_n", F.sum("_n").over(w).alias("_upto"), F.bround(F.sum("_n").over(Window.partitionBy("_y")) * share, 0).alias("_held"))
    range_ = sizes.where("_upto >= _held and _upto - _n < _held").select("_y", "_b", (F.col("_held") - F.col("_upto") + F.col("_n")).alias("_at"))  # one hash range a class
    ranked = narrow.join(F.broadcast(range_), ["_y", "_b"]).withColumn("_r", F.row_number().over(Window.partitionBy("_y").orderBy(*names)))
    last = ranked.where("_r = _at").select("_y", F.struct("_b", *names).alias("_last"))  # one row a class
    here = F.struct(b.alias("_b"), h.alias("_h"), *[F.col(k).alias(f"_k{i}") for i, k in enumerate(keys)])
    return df.where(F.col(y).isNotNull()).join(F.broadcast(last), F.col(y) == F.col("_y"), "left").withColumn("part", F.when(here <= F.col("_last"), "holdout").otherwise("train")).drop("_y", "_last")


def folds(df: DataFrame, y: str, key: str | tuple[str, ...], k: int = 5, seed: int = 7) -> DataFrame:
    """``fold`` 0 to k - 1: within each class the rows in hash order take turns."""
    return stratified_split(df, y, key, 0.0, seed).withColumn("fold", ((F.col("place") - 1) % k).cast("int")).drop("part", "place")


def class_cap(df: DataFrame, y: str, key: str | tuple[str, ...], total: int, seed: int = 7) -> DataFrame:
    """The same number of rows of each class, total over the classes' number, the first by a hash of the key."""
    n = df.select(y).distinct().agg(F.greatest(F.count("*"), F.lit(1)).alias("_classes"))
    return stratified_split(df, y, key, 0.0, seed).crossJoin(F.broadcast(n)).where(F.col("place") <= F.floor(F.lit(total) / F.col("_classes"))).drop("part", "place", "_classes")
