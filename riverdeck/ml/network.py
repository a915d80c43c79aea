"""A two-head network on feature rows: embeddings of the hand class and the position, a trunk, and heads for the action and the villain's fold.

The loss is cross-entropy of the action, with a weight of ``VILLAIN`` for the fold's binary cross-entropy over rows where it is known.  A step is one job: each
partition adds up the gradient of its rows of the mini-batch, and partial sums are added up in groups of about the root of their number before they reach the driver, which
holds the weights only.  The learning rate falls when the validation loss stands still, and the weights of the best epoch are kept.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, functions as F, types as T

from ..sources.shared import place

HANDS, POSITIONS = 169, 6
VILLAIN = 0.5
#: Validation loss must fall by this to count as better.
BETTER = 1e-4
#: Rows whose inputs become bytes at once, and rows that go through the network at once.
SLICE, ROWS = 1 << 13, 1 << 10


def initial(inputs: int, actions: int, hand: int = 16, position: int = 4, hidden: tuple[int, ...] = (128, 64), seed: int = 7) -> dict[str, np.ndarray]:
    """Weights by name; the trunk's layers are w0, b0, w1, b1, and so on."""
    rng = np.random.default_rng(seed)
    out = {"hand": rng.normal(size=(HANDS, hand)), "position": rng.normal(size=(POSITIONS, position))}
    width = inputs + hand + position
    for i, h in enumerate((*hidden, None)):
        bound = 1 / math.sqrt(width)
        for name, size in [(str(i), h)] if h else [("action", actions), ("villain", 1)]:
            out[f"w{name}"], out[f"b{name}"] = rng.uniform(-bound, bound, (width, size)), rng.uniform(-bound, bound, size)
        width = h
    return out


def _layers(weights: dict) -> int:
    return sum(name[0] == "w" and name[1:].isdigit() for name in weights)


def forward(weights: dict, x: np.ndarray, hand: np.ndarray, position: np.ndarray, masks: list | None = None) -> tuple[np.ndarray, np.ndarray, list]:
    """Action scores, villain score, and the inputs of all layers."""
    z = np.concatenate([x, weights["hand"][hand], weights["position"][position]], axis=1)
    kept = [z]
    for i in range(_layers(weights)):
        z = np.maximum(z @ weights[f"w{i}"] + weights[f"b{i}"], 0)
        if masks is not None:
            z = z * masks[i]
        kept.append(z)
    return z @ weights["waction"] + weights["baction"], (z @ weights["wvillain"] + weights["bvillain"])[:, 0], kept


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(1, keepdims=True))
    return e / e.sum(1, keepdims=True)


def losses(batch: tuple, action: np.ndarray, villain: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(rows, known rows, action loss, villain loss), all sums, and the chances of both heads."""
    y, fold = batch[3:]
    p, known = softmax(action), fold >= 0
    q = 1 / (1 + np.exp(-villain))
    return np.array([len(y), known.sum(), -np.log(np.maximum(p[np.arange(len(y)), y], 1e-300)).sum(), (np.logaddexp(0, villain) - np.where(known, fold, 0) * villain)[known].sum()]), p, q


def loss_and_gradient(weights: dict, batch: tuple, masks: list | None = None, each: tuple[float, float] | None = None) -> tuple[np.ndarray, dict]:
    """(rows, known rows, action loss, villain loss), all sums, and two gradients of sums: of the action's loss and the villain's, by weight.

    ``each``: what a row's loss counts in either head; then one gradient, of both losses weighed so.
    """
    x, hand, position, y, fold = batch
    action, villain, kept = forward(weights, x, hand, position, masks)
    sums, p, q = losses(batch, action, villain)
    n, known = np.arange(len(y)), fold >= 0
    errors = p
    errors[n, y] -= 1
    wrong = np.where(known, q - fold, 0.0)
    if each is not None:
        return sums, _back(weights, batch, kept, masks, errors * each[0], wrong * each[1])
    return sums, {"action": _back(weights, batch, kept, masks, errors, 0 * wrong), "villain": _back(weights, batch, kept, masks, 0 * errors, wrong)}


def _back(weights: dict, batch: tuple, kept: list, masks: list | None, action: np.ndarray, villain: np.ndarray) -> dict:
    """The gradient by weight from the errors of both heads, in one way back; of the inputs only the embeddings have one."""
    x, hand, position = batch[:3]
    villain = villain[:, None]
    out = {"waction": kept[-1].T @ action, "baction": action.sum(0), "wvillain": kept[-1].T @ villain, "bvillain": villain.sum(0)}
    last = _layers(weights)
    top = lambda name: weights[name][x.shape[1] :] if not last else weights[name]
    back = action @ top("waction").T + villain @ top("wvillain").T
    for i in reversed(range(last)):
        if masks is not None:
            back *= masks[i]
        back *= kept[i + 1] > 0
        out[f"w{i}"], out[f"b{i}"] = kept[i].T @ back, back.sum(0)
        back = back @ (weights[f"w{i}"] if i else weights["w0"][x.shape[1] :]).T
    size = weights["hand"].shape[1]
    for name, at, own in (("hand", hand, back[:, :size]), ("position", position, back[:, size:])):
        out[name] = np.stack([np.bincount(at, column, len(weights[name])) for column in own.T], axis=1)
    return out


def _flat(g: dict) -> np.ndarray:
    return np.concatenate([g[k].ravel() for k in sorted(g)])


def _unflat(flat: np.ndarray, like: dict) -> dict:
    out, at = {}, 0
    for k in sorted(like):
        out[k] = flat[at : at + like[k].size].reshape(like[k].shape)
        at += like[k].size
    return out


def _inputs(columns: list[str], scale: list[tuple[float, float]], hand: str, position: str) -> list[Column]:
    """The scaled features, a missing one being the mean, and the numbers of hand class and position."""
    x = F.array(*[F.coalesce((F.col(c) - F.lit(m)) / F.lit(s), F.lit(0.0)) for c, (m, s) in zip(columns, scale)])
    number = lambda c, top: F.least(F.greatest(F.coalesce(F.col(c).cast("int"), F.lit(0)), F.lit(0)), F.lit(top - 1))
    return [x.alias("x"), number(hand, HANDS).alias("hand"), number(position, POSITIONS).alias("position")]


def prepared(df: DataFrame, columns: list[str], scale: list[tuple[float, float]], hand: str = "hand_class_idx", position: str = "pos_idx", y: str = "y", fold: str = "villain_fold", key: tuple[str, ...] = ("split", "source_index")) -> DataFrame:
    """(x, hand, position, y, fold, slot): the inputs, both labels, and a hash of the key by which mini-batches are drawn."""
    return df.select(*_inputs(columns, scale, hand, position), F.col(y).cast("int").alias("y"), F.coalesce(F.col(fold), F.lit(-1)).cast("int").alias("fold"), F.xxhash64(*key).alias("slot"))


def scales(df: DataFrame, columns: list[str]) -> list[tuple[float, float]]:
    """Mean and deviation of each feature (1 where it is constant)."""
    row = df.agg(*[f(c).alias(f"{n}{i}") for i, c in enumerate(columns) for n, f in (("m", F.avg), ("s", F.stddev_pop))]).first()
    return [(row[f"m{i}"] or 0.0, row[f"s{i}"] or 1.0) for i in range(len(columns))]


def packed(rows: DataFrame) -> DataFrame:
    """Prepared rows with ``x`` as bytes, which files and tasks hand on as one value and not number by number."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, SLICE):
                batch = whole.slice(at, SLICE)
                x = np.ascontiguousarray(batch.column(0).flatten().to_numpy(zero_copy_only=False))
                ends = np.linspace(0, x.nbytes, batch.num_rows + 1).astype(np.int32)
                yield pa.RecordBatch.from_arrays([pa.Array.from_buffers(pa.binary(), batch.num_rows, [None, pa.py_buffer(ends), pa.py_buffer(x)]), *batch.columns[1:]], names=names)

    return rows.mapInArrow(run, T.StructType([T.StructField("x", T.BinaryType()), *rows.schema.fields[1:]]))


def _batch(batch: pa.RecordBatch, inputs: int) -> tuple:
    x = batch.column(0)
    x = np.frombuffer(b"".join(x.to_pylist())) if pa.types.is_binary(x.type) else x.flatten().to_numpy(zero_copy_only=False)
    return x.reshape(-1, inputs), *(batch.column(i).to_numpy().astype(np.int64) for i in range(1, 5))


def summed(rows: DataFrame, weights: dict, inputs: int, dropout: float = 0.0, seed: int = 0, gradient: bool = True, counted: tuple[int, int] | None = None) -> tuple[np.ndarray, dict | None]:
    """``loss_and_gradient`` added up over all rows, as one gradient of both losses' means; ``counted``: how many rows there are, and with a known fold, where that is at hand."""
    if gradient and counted is None:
        counted = tuple(rows.agg(F.count("*"), F.count_if(F.col("fold") >= 0)).first())
    each = (1 / max(counted[0], 1), VILLAIN / max(counted[1], 1)) if gradient else None

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = TaskContext.get().partitionId()
        rng = np.random.default_rng([seed, part])
        total = None
        for batch in batches:
            if batch.num_rows:
                masks = [rng.random((batch.num_rows, weights[f"w{i}"].shape[1])) >= dropout for i in range(_layers(weights))] if dropout else None
                whole = _batch(batch, inputs)
                # A few rows at a time, so that what lies between the layers stays near the processor.
                for at in range(0, batch.num_rows, ROWS):
                    here = slice(at, at + ROWS)
                    few = tuple(c[here] for c in whole)
                    if gradient:
                        sums, g = loss_and_gradient(weights, few, masks and [m[here] / (1 - dropout) for m in masks], each)
                        flat = np.concatenate([sums, _flat(g)])
                    else:
                        flat = losses(few, *forward(weights, *few[:3])[:2])[0]
                    total = flat if total is None else total + flat
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    def add(batches):
        total, first = None, None
        for batch in batches:
            for part, sums in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                sums = np.frombuffer(sums)
                total, first = (sums, part) if total is None else (total + sums, first)
        if total is not None:
            yield pa.RecordBatch.from_arrays([pa.array([first], pa.int32()), pa.array([total.tobytes()], pa.binary())], names=["part", "sums"])

    parts = rows.mapInArrow(run, "part int, sums binary")
    n = rows.rdd.getNumPartitions()
    if n > 16:
        ways = math.isqrt(n)
        parts = parts.repartition(ways, F.pmod("part", F.lit(ways))).sortWithinPartitions("part").mapInArrow(add, "part int, sums binary")
    found = [np.frombuffer(r["sums"]) for r in sorted(parts.collect(), key=lambda r: r["part"])]  # some root of the partitions' number
    if not found:
        return np.zeros(4), None
    total = np.sum(found, axis=0)
    return total[:4], _unflat(total[4:], weights) if gradient else None


def loss(sums: np.ndarray) -> float:
    """Mean action loss and VILLAIN times the mean loss of known folds."""
    return float(sums[2] / max(sums[0], 1) + VILLAIN * sums[3] / max(sums[1], 1))


def fit(train: DataFrame, valid: DataFrame, columns: list[str], actions: int, epochs: int = 20, batches: int = 3, rate: float = 1e-3, decay: float = 1e-4, dropout: float = 0.15, patience: int = 3, seed: int = 7, **shape) -> tuple[dict, list[dict]]:
    """The model of the epoch with the least validation loss, and the history (epoch, rate, train_loss, valid_loss).

    Adam with decoupled decay; the rate is halved when ``patience`` epochs bring nothing better.  Rows with a label only; a rerun on the same files gives the same weights.
    """
    spark = train.sparkSession
    scale = scales(train, columns)
    paths = place(spark, "network-train"), place(spark, "network-valid")
    for df, path in zip((train, valid), paths):
        packed(prepared(df, columns, scale)).write.parquet(path)
    rows, held = (spark.read.parquet(p) for p in paths)
    # Each epoch deals the rows to mini-batches anew; how many each gets is counted first, so that a step goes back through the network once for both losses.
    dealt = [F.pmod(F.xxhash64("slot", F.lit(seed), F.lit(epoch)), F.lit(batches)) for epoch in range(epochs)]
    counts = rows.agg(*[F.count_if(c) for deal in dealt for b in range(batches) for c in (deal == b, (deal == b) & (F.col("fold") >= 0))]).first()
    weights = initial(len(columns), actions, seed=seed, **shape)
    first, second = ({k: np.zeros_like(w) for k, w in weights.items()} for _ in range(2))
    best, best_loss, stale, step, history = weights, math.inf, 0, 0, []
    for epoch in range(epochs):
        seen = np.zeros(4)
        for b in range(batches):
            step += 1
            own = rows.where(dealt[epoch] == b).select("x", "hand", "position", "y", "fold")
            sums, g = summed(own, weights, len(columns), dropout, seed * 1_000_003 + step, counted=tuple(counts[2 * step - 2 : 2 * step]))
            seen += sums
            if g is None:
                continue
            new = {}
            for k, w in weights.items():
                first[k] = 0.9 * first[k] + 0.1 * g[k]
                second[k] = 0.999 * second[k] + 0.001 * g[k] ** 2
                new[k] = w * (1 - rate * decay) - rate * (first[k] / (1 - 0.9**step)) / (np.sqrt(second[k] / (1 - 0.999**step)) + 1e-8)
            weights = new
        now = loss(summed(held.select("x", "hand", "position", "y", "fold"), weights, len(columns), gradient=False)[0])
        history.append({"epoch": epoch, "rate": rate, "train_loss": loss(seen), "valid_loss": now})
        if now < best_loss - BETTER:
            best, best_loss, stale = weights, now, 0
        else:
            stale += 1
            if stale >= patience:
                rate, stale = rate / 2, 0
    return {"columns": list(columns), "scale": scale, "weights": best}, history


def predict(model: dict, df: DataFrame, hand: str = "hand_class_idx", position: str = "pos_idx") -> DataFrame:
    """``df`` with ``p``, the action probabilities, and ``villain_fold_p``."""
    columns, weights = model["columns"], model["weights"]
    inputs = F.struct(*_inputs(columns, model["scale"], hand, position))
    schema = df.schema

    def run(batches):
        for batch in batches:
            if not batch.num_rows:
                continue
            s = batch.column(batch.num_columns - 1)
            x, hands, positions = (s.field(i) for i in range(3))
            action, villain, _ = forward(weights, x.flatten().to_numpy(zero_copy_only=False).reshape(-1, len(columns)), hands.to_numpy(), positions.to_numpy())
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(list(softmax(action)), pa.list_(pa.float64())), pa.array(1 / (1 + np.exp(-villain)))], names=[*schema.names, "p", "villain_fold_p"])

    out = T.StructType([*schema.fields, T.StructField("p", T.ArrayType(T.DoubleType())), T.StructField("villain_fold_p", T.DoubleType())])
    return df.select(*df.columns, inputs.alias("_inputs")).mapInArrow(run, out)


def dumps(model: dict) -> str:
    return json.dumps({**model, "weights": {k: w.tolist() for k, w in model["weights"].items()}})


def loads(text: str) -> dict:
    model = json.loads(text)
    return {**model, "weights": {k: np.array(w) for k, w in model["weights"].items()}}
