"""LM scoring by a hierarchical Pitman-Yor model over words, of order two.

Each context (the word before; the end token before the first word) is a restaurant whose dishes are the words that follow it; the restaurants of all contexts
share one parent, the restaurant of single words, whose base is uniform over the training words and one unknown word.  Tables
of the context restaurants are the customers of the parent.  Seatings are sampled by blocked Gibbs sweeps over the whole hierarchy:

- A context's tables enter its dishes' conditionals only through a gamma variable x, drawn given the number of its tables; given x and
  the parent's word probabilities, the numbers of tables t of all dishes are independent, with weights S(c, t) (d x P(w))^t (generalised Stirling numbers of c customers).
- The tables of all contexts are summed up by word; the parent's tables are drawn in the same way, and its word probabilities from
  the Dirichlet distribution that its customers and tables give.

``burn_in`` sweeps are left out; the predictive probabilities of the next ``samples`` seatings are averaged.  Tables are drawn customer by customer, each opening one with the chance that
the weights of what is still to come give in closed form (``draw_tables``): one rule for all sizes, whose mean number of tables is within a tenth
of the exact one's.  Customers are seated one at a time up to 32, then in steps of a sixteenth of those seated.  Every random number
is a hash of the seed, the sweep and the words it belongs to, so scores depend neither on partitions nor on reruns.

How it is spread: documents are numbered into blocks, each with its own vocabulary, in a table in the shared folder.  A block's distinct
word pairs are counted once and dealt by context into pair buckets, which merge the counts of all blocks and are written as a table bucketed by
their number: sweeps read it in place, and only tables by word travel to the word buckets (ranges of the words' hashes) and probabilities back.  A context of
more than about ``hot`` tokens is dealt into several pair buckets by its following words; its tables are summed up with the words', so the split changes
no result.  Which contexts are hot is judged by every n-th token.  In the end counts and tables return to the blocks, which score their documents.
All counts cover all training documents.  Words are named by 48 bits of a hash in the model; the base score counts words by their text.

Defined cases: a null or empty text is one end token; texts of any length are scored whole; repeated rows are each scored and each counted; a null doc_id stays
null, and ids of any type stay as they are; an empty table gives an empty result; without any training document every word is unknown; extra columns are ignored.
"""

from __future__ import annotations

import math
import struct
import uuid
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from .common import Numbering, cut, id_kind, mix64, shared_dir, slices, texts

_BITS = 48
_GOLDEN = 0x9E3779B97F4A7C15
_MASK = (1 << 64) - 1


@dataclass(frozen=True)
class HpyParams:
    """discount and strength of the context restaurants, and of the parent; sweeps before the first sample; samples averaged.

    block, pairs, words: about how many tokens a block, tokens a pair bucket and words a word bucket have.  They follow the memory of a task (some 100 bytes for
    each); with larger ones on a larger cluster, fewer and larger pieces are exchanged: blocks times buckets at most.  hot: contexts of about more tokens are split;
    it changes no result.
    """

    discount: float = 0.8
    strength: float = 8.0
    parent_discount: float = 0.6
    parent_strength: float = 10.0
    burn_in: int = 2
    samples: int = 3
    seed: int = 7
    block: int = 1 << 21
    pairs: int = 1 << 21
    words: int = 1 << 20
    hot: int = 1 << 19


def _hash(words: list[bytes]) -> np.ndarray:
    """48 bits that name each word."""
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words)) >> np.uint64(64 - _BITS)


def _key(seed: int, tag: int, sweep: int, *names: np.ndarray) -> np.ndarray:
    """A 64-bit key of random numbers for each name or pair of names."""
    key = np.uint64(mix64(np.array([(seed << 32) + (tag << 16) + sweep + 1], np.uint64))[0])
    for n in names:
        key = mix64((key ^ n) * np.uint64(_GOLDEN))
    return key


def _uniform(key: np.ndarray, step: int) -> np.ndarray:
    return ((mix64(key + np.uint64(step * _GOLDEN & _MASK)) >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def _normal(key: np.ndarray, step: int) -> np.ndarray:
    return np.sqrt(-2 * np.log(_uniform(key, step))) * np.cos(2 * np.pi * _uniform(key, step + 1))


def _poisson(key: np.ndarray, step: int, mean: np.ndarray) -> np.ndarray:
    """Poisson numbers: by inversion, for large means by the normal quantile with the skew's correction."""
    z = _normal(key, step)
    out = np.maximum(0, np.floor(mean + np.sqrt(mean) * z + (z * z - 1) / 6 + 0.5))
    few = np.flatnonzero(mean < 12)
    u, p = _uniform(key[few], step + 2), np.exp(-mean[few])
    total, k = p.copy(), np.zeros(len(few))
    for j in range(1, 60):
        on = u > total
        if not on.any():
            break
        k[on] += 1
        p *= mean[few] / j
        total += p
    out[few] = k
    return out


def draw_gamma(key: np.ndarray, shape: np.ndarray) -> np.ndarray:
    """Gamma numbers of the given shapes (a shape of 0 gives 0), by Marsaglia and Tsang's rejection."""
    out = np.zeros(len(shape))
    on = np.flatnonzero(shape > 0)
    low = shape[on] < 1
    d = shape[on] + low - 1 / 3
    step = 0
    while len(on):
        z, u = _normal(key[on], 4 * step), _uniform(key[on], 4 * step + 2)
        v = (1 + z / np.sqrt(9 * d)) ** 3
        with np.errstate(invalid="ignore", divide="ignore"):
            good = (v > 0) & (np.log(u) < 0.5 * z * z + d - d * v + d * np.log(v))
        at = on[good]
        out[at] = d[good] * v[good]
        on, d = on[~good], d[~good]
        step += 1
    small = np.flatnonzero((shape > 0) & (shape < 1))
    out[small] *= _uniform(key[small], (1 << 20) + 1) ** (1 / shape[small])
    return out


def _power(x: np.ndarray, d: float) -> np.ndarray:
    """Gamma(x) / Gamma(x - d), by two steps up and a power."""
    return (x - d) * (x + 1 - d) / (x * (x + 1)) * (x + 2 - (1 + d) / 2) ** d


def draw_tables(key: np.ndarray, c: np.ndarray, open_: np.ndarray, d: float) -> np.ndarray:
    """Tables t of c customers with weights S(c, t) open_^t: the conditional of a dish given its restaurant's gamma variable.

    With n seated at k tables the next one opens a table with the odds open_ h(n + 1, k + 1) : (n - d k) h(n + 1, k), where h is the weight of all ways to seat
    the rest; to first order in open_, h(n, k) is Gamma(c - d k) / Gamma(n - d k) exp(open_ (1 - ((n - d k) / (c - d k))^d) / d).
    """
    t = np.minimum(c, 1)
    on = np.flatnonzero((c > 1) & (open_ > 0))
    top, w, key = c[on].astype(np.float64), open_[on], key[on]
    n, k = np.ones(len(on)), np.ones(len(on))
    step = 0
    while len(on):
        leap = np.minimum(np.maximum(1, np.floor(n / 16)), top - n)
        at = n + (leap - 1) / 2  # the middle of the step
        x, y = at + 1 - d * k, top - d * k
        rest = lambda x, y: ((np.maximum(x, 1e-9) / np.maximum(y, 1e-9)) ** d) / -d
        odds = w * _power(x, d) / _power(y, d) * np.exp(np.minimum(50, w * (rest(x - d, y - d) - rest(x, y))))
        p = odds / (odds + at - d * k)
        new = (_uniform(key, 4 * step) < p).astype(np.float64)
        many = np.flatnonzero(leap > 1)
        if len(many):
            new[many] = np.minimum(_poisson(key[many], 4 * step + 1, (p * leap)[many]), leap[many])
        k += new
        n += leap
        step += 1
        done = n >= top
        if done.any():
            t[on[done]] = k[done]
            go = ~done
            on, top, w, key, n, k = on[go], top[go], w[go], key[go], n[go], k[go]
    return t


def _pairs(seq: np.ndarray, counts: np.ndarray, words: int) -> tuple[np.ndarray, np.ndarray]:
    """The key (word before) * words + word of each token; the end token (0) stands before a document."""
    before = np.empty(len(seq), np.int64)
    before[1:] = seq[:-1]
    before[(np.cumsum(counts) - counts)] = 0
    return np.unique(before * words + seq, return_inverse=True)


class _Deal:
    """Which buckets pairs and words belong to; ``hot``: names of hot contexts, ascending, and into how many buckets each is dealt."""

    def __init__(self, pair_buckets: int, word_buckets: int, hot: np.ndarray, parts: np.ndarray):
        self.pair_buckets, self.word_buckets, self.hot, self.parts = pair_buckets, word_buckets, hot, parts

    def pairs(self, keys: np.ndarray, hashes: np.ndarray):
        """Order by bucket, context and word, for the distinct pairs of a block: (order, bucket, context, word)."""
        u, w = hashes[keys // len(hashes)], hashes[keys % len(hashes)]
        parts = np.ones(len(u), np.uint64)
        if len(self.hot):
            at = np.minimum(np.searchsorted(self.hot, u), len(self.hot) - 1)
            parts = np.where(self.hot[at] == u, self.parts[at], parts)
        bucket = (mix64(u + np.uint64(1) + mix64(w) % parts) % np.uint64(self.pair_buckets)).astype(np.int64)
        order = np.lexsort((w, u, bucket))
        return order, bucket[order], u[order], w[order]

    def cuts(self, names: np.ndarray) -> np.ndarray:
        """Where each word bucket begins in ascending names, and the end."""
        edges = [(i << _BITS) // self.word_buckets + (1 if (i << _BITS) % self.word_buckets else 0) for i in range(self.word_buckets)]
        return np.append(np.searchsorted(names, np.array(edges, np.uint64)), len(names))


def _pack(*arrays: np.ndarray) -> bytes:
    """Whole numbers of at least 0, as compressed planes of their bytes; planes of zeros at the high end are left out."""
    head, body = [struct.pack("<i", len(arrays))], []
    for x in arrays:
        flat = np.ascontiguousarray(x.ravel(), "<u8")
        width = (int(flat.max()).bit_length() + 7) // 8 if len(flat) else 0
        head.append(struct.pack("<qi", len(flat), width))
        body.append(flat.view(np.uint8).reshape(-1, 8)[:, :width].T.tobytes())
    return b"".join(head) + zstandard.compress(b"".join(body), 3)


def _unpack(x: bytes) -> list[np.ndarray]:
    (many,) = struct.unpack_from("<i", x)
    sizes = [struct.unpack_from("<qi", x, 4 + 12 * i) for i in range(many)]
    body = np.frombuffer(zstandard.decompress(x[4 + 12 * many :]), np.uint8)
    out, at = [], 0
    for n, width in sizes:
        flat = np.zeros((n, 8), np.uint8)
        flat[:, :width] = body[at : at + n * width].reshape(width, n).T
        out.append(flat.view("<i8").ravel())
        at += n * width
    return out


def _gaps(x: np.ndarray) -> np.ndarray:
    """Differences of ascending numbers, the first one from 0."""
    return np.diff(x, prepend=x.dtype.type(0))


def _names(gaps: np.ndarray) -> np.ndarray:
    return np.cumsum(gaps.astype(np.uint64), dtype=np.uint64)


def _short(x: np.ndarray) -> np.ndarray:
    """The upper 16 bits of 32-bit floats."""
    return (x.astype("<f4").view("<u4") >> np.uint32(16)).astype(np.int64)


def _long(x: np.ndarray) -> np.ndarray:
    return (x.astype("<u4") << np.uint32(16)).view("<f4").astype(np.float64)


def blocks(docs: DataFrame, block: int, text: str = "text") -> DataFrame:
    """Documents as word numbers: block, doc_ids, held_out, counts, seq, vocabulary (blank-joined; the end token is empty and first)."""

    carried = id_kind(docs).simpleString()
    ids_kind = pa.list_(pa.int64() if carried == "bigint" else pa.string())

    def run(batches):
        part = TaskContext.get().partitionId()
        number = 0

        def fresh():
            seen = Numbering()
            seen[b""]
            return [], [], [], [], seen

        ids, held, counts, seqs, seen = fresh()
        size = 0

        def row():
            seq = np.concatenate(seqs)
            names = b" ".join(seen)
            return pa.RecordBatch.from_arrays(
                [pa.array([(part << 32) + number]), pa.array([ids], ids_kind), pa.array([held], pa.list_(pa.bool_())), pa.array([counts], pa.list_(pa.int32())), pa.array([_pack(seq)], pa.binary()), pa.array([zstandard.compress(names, 3)], pa.binary()), pa.array([len(seq)]), pa.array([len(seen)])],
                names=["block", "doc_ids", "held_out", "counts", "seq", "vocabulary", "n_tokens", "n_words"],
            )

        for whole in batches:
            for batch in slices(whole, text):
                for doc, out, x in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), texts(batch, text)):
                    w = x.lower().split()
                    w.append(b"")
                    ids.append(doc), held.append(bool(out)), counts.append(len(w))
                    seqs.append(np.fromiter(map(seen.__getitem__, w), np.int32, len(w)))
                    size += len(w)
                    if size >= block:
                        yield row()
                        number += 1
                        ids, held, counts, seqs, seen = fresh()
                        size = 0
        if ids:
            yield row()

    schema = f"block long, doc_ids array<{carried}>, held_out array<boolean>, counts array<int>, seq binary, vocabulary binary, n_tokens long, n_words long"
    return docs.select(F.col("doc_id").cast(carried).alias("doc_id"), "held_out", text).mapInArrow(run, schema)


class _Block:
    """A row of ``blocks`` as arrays."""

    def __init__(self, row: dict):
        self.id = row["block"]
        self.doc_ids, self.held = list(row["doc_ids"]), np.array(row["held_out"], bool)
        self.counts = np.array(row["counts"], np.int64)
        (self.seq,) = _unpack(row["seq"])
        self.words = zstandard.decompress(row["vocabulary"]).split(b" ")
        self.hashes = _hash(self.words)
        self.train = np.repeat(~self.held, self.counts)

    def word_counts(self) -> np.ndarray:
        return np.bincount(self.seq[self.train], minlength=len(self.words))


def _over_blocks(batches):
    for batch in batches:
        for row in batch.to_pylist():
            yield _Block(row)


class _Bucket:
    """Restaurants of a pair bucket: names ascending, contexts (heads into names) with their runs of pairs, words (into names) and customers."""

    def __init__(self, x: bytes):
        names, self.heads, run, self.w, self.c = _unpack(x)
        self.names = _names(names)
        self.group = np.repeat(np.arange(len(run)), run)

    @staticmethod
    def pack(u: np.ndarray, w: np.ndarray, c: np.ndarray, names: np.ndarray) -> bytes:
        starts = np.flatnonzero(np.append(True, u[1:] != u[:-1])) if len(u) else np.zeros(0, np.int64)
        return _pack(_gaps(names), np.searchsorted(names, u[starts]), np.diff(np.append(starts, len(u))), np.searchsorted(names, w), c)

    def tables(self, t: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Tables by dish and by context, for each name."""
        return self._sum(self.w, t), self._sum(self.heads, np.bincount(self.group, t, minlength=len(self.heads)))

    def _sum(self, at, t):
        return np.bincount(at, t, minlength=len(self.names)).astype(np.int64)


_ROWS = "at long, source long, x binary"
_FRAME = ["at", "source", "x"]


def _frame(rows: list) -> pd.DataFrame:
    return pd.DataFrame(rows, columns=_FRAME)


def _bucketed(df: DataFrame, buckets: int, label: str, by: str = "at") -> DataFrame:
    """``df`` written to the shared folder as a table bucketed by a column; joins and groups by that column read it in place.

    Its name leaves the catalog at once; the files stay.
    """
    spark, name = df.sparkSession, f"riverdeck_{label}_{uuid.uuid4().hex}"
    df.write.bucketBy(min(buckets, 100_000), by).sortBy(by).option("path", f"{shared_dir(spark)}/{name}").saveAsTable(name)
    table = spark.table(name)
    spark.sql(f"DROP TABLE {name}")
    return table


def fit_and_score(docs: DataFrame, params: HpyParams = HpyParams()) -> DataFrame:
    """docs (doc_id, text, held_out) -> doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score, perplexity."""
    spark = docs.sparkSession
    p, S, carried = params, params.samples, id_kind(docs).simpleString()
    least = int(spark.conf.get("spark.sql.shuffle.partitions"))
    table = _bucketed(blocks(docs, p.block), least, "lm_blocks", "block")
    tokens, words = (x or 0 for x in table.agg(F.sum("n_tokens"), F.sum("n_words")).first())
    # By size alone; small inputs are cut finer, into up to 8 buckets.
    pair_buckets, word_buckets = (max(1, math.ceil(n / size), min(8, 16 * n // size)) for n, size in ((tokens, p.pairs), (words, p.words)))
    names, parts = _hot(table, p)
    shared = spark.sparkContext.broadcast(_Deal(pair_buckets, word_buckets, names, parts))

    def deal_pairs(batches):
        for b in _over_blocks(batches):
            keys, at = _pairs(b.seq, b.counts, len(b.words))
            n = np.bincount(at[b.train], minlength=len(keys))
            order, bucket, u, w = shared.value.pairs(keys, b.hashes)
            n = n[order]
            edges = np.concatenate([[0], np.flatnonzero(np.diff(bucket)) + 1, [len(bucket)]])
            rows = [[], [], []]
            for s, e in zip(edges[:-1], edges[1:]):
                here = np.unique(np.concatenate([u[s:e], w[s:e]]))
                for column, v in zip(rows, (int(bucket[s]), b.id, _Bucket.pack(u[s:e], w[s:e], n[s:e], here))):
                    column.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(rows, (pa.int64(), pa.int64(), pa.binary()))], names=_FRAME)

    def merge(pdf: pd.DataFrame) -> pd.DataFrame:
        """One pair bucket: the counts of all blocks; where each block's pairs are; how often each name is a dish and a context, by word bucket."""
        pdf = pdf.sort_values("source")
        us, ws, ns, sizes = [], [], [], []
        for x in pdf["x"]:
            b = _Bucket(x)
            us.append(b.names[b.heads][b.group])
            ws.append(b.names[b.w])
            ns.append(b.c)
            sizes.append(len(b.w))
        u, w, n = map(np.concatenate, (us, ws, ns))
        del us, ws, ns
        order = np.lexsort((w, u))
        new = np.ones(len(u), bool)
        new[1:] = (u[order][1:] != u[order][:-1]) | (w[order][1:] != w[order][:-1])
        slot = np.empty(len(u), np.int64)
        slot[order] = np.cumsum(new) - 1
        c = np.bincount(slot, n).astype(np.int64)
        first = order[new]
        u, w = u[first], w[first]
        here = np.unique(np.concatenate([u, w]))
        state = _Bucket.pack(u, w, c, here)
        dish, context = _Bucket(state).tables(np.minimum(c, 1))
        edges = shared.value.cuts(here)
        sent = [_pack(_gaps(here[a:b]), dish[a:b], context[a:b]) if a < b else None for a, b in zip(edges[:-1], edges[1:])]
        ends = np.cumsum(sizes)
        slots = [_pack(_gaps(slot[a:b])) for a, b in zip(ends - sizes, ends)]
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "state": [state], "blocks": [pdf["source"].tolist()], "slots": [slots], "sent": [sent]})

    merged = table.mapInArrow(deal_pairs, _ROWS).groupBy("at").applyInPandas(merge, "at long, state binary, blocks array<long>, slots array<binary>, sent array<binary>")
    merged = _bucketed(merged, pair_buckets, "lm_pairs")

    def gather(pdf: pd.DataFrame) -> pd.DataFrame:
        """One word bucket: its names, and where the names of each pair bucket are among them; the first counts."""
        pdf = pdf.sort_values("source")
        got = [_unpack(x) for x in pdf["x"]]
        own = [_names(g[0]) for g in got]
        here = np.unique(np.concatenate(own))
        places = [np.searchsorted(here, x) for x in own]
        sums = np.zeros((2, len(here)), np.int64)
        for at, g in zip(places, got):
            sums[0, at] += g[1]
            sums[1, at] += g[2]
        return pd.DataFrame({"at": [int(pdf["at"].iloc[0])], "state": [_pack(_gaps(here), *sums)], "sources": [pdf["source"].tolist()], "places": [[_pack(_gaps(x)) for x in places]]})

    first = merged.select(F.col("at").alias("source"), F.posexplode("sent").alias("pos", "x")).where("x is not null").select(F.col("pos").cast("long").alias("at"), "source", "x")
    gathered = _bucketed(first.groupBy("at").applyInPandas(gather, "at long, state binary, sources array<long>, places array<binary>"), word_buckets, "lm_words")

    def parent_sweep(sent: DataFrame | None, sweep: int, x0: float, types: int) -> DataFrame:
        """Rows for the pair buckets (source: the word bucket), and one for the word bucket itself (source -1: dish tables, parent's tables, context tables) with the totals."""

        start = sent is None

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            row = left.iloc[0]
            gaps, dish, context = _unpack(row["state"])
            here = _names(gaps)
            places = {b: np.cumsum(_unpack(x)[0]) for b, x in zip(row["sources"], row["places"])}
            if start:
                root = np.minimum(dish, 1)
            else:
                dish, context = np.zeros(len(here), np.int64), np.zeros(len(here), np.int64)
                for b, x in zip(right["source"], right["x"]):
                    t, of = _unpack(x)
                    dish[places[b]] += t
                    context[places[b]] += of
                root = draw_tables(_key(p.seed, 1, sweep, here), dish, np.full(len(here), p.parent_discount * x0 / (types + 1)), p.parent_discount)
            weight = _short(draw_gamma(_key(p.seed, 2, sweep, here), np.maximum(0, dish - p.parent_discount * root)))
            at = int(row["at"])
            out = [(b, at, _pack(weight[i], context[i]), 0, 0, 0, 0) for b, i in places.items()]
            # Weights are summed up as whole numbers, so that the order plays no part.
            out.append((at, -1, _pack(dish, root, context), int((dish > 0).sum()), int(dish.sum()), int(root.sum()), int((_long(weight) * 2**20).astype(np.int64).sum())))
            return pd.DataFrame(out, columns=[*_FRAME, "types", "customers", "tables", "weight"])

        schema = f"{_ROWS}, types long, customers long, tables long, weight long"
        other = gathered.select("at", F.lit(0).cast("long").alias("source"), F.lit(None).cast("binary").alias("x")).limit(0) if sent is None else sent
        return cut(gathered.groupBy("at").cogroup(other.groupBy("at")).applyInPandas(run, schema), "parent")

    def child_sweep(words: DataFrame, before: DataFrame | None, sweep: int, rest: float, whole: float, types: int, last: bool) -> DataFrame:
        """Rows for the word buckets (kind 0), the sum of tables so far (kind 1; source -1) and, from the last sweep, counts and tables for the blocks (kind 2)."""

        def run(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
            row = left.iloc[0]
            b = _Bucket(row["state"])
            at = int(row["at"])
            got = right[right["source"] >= 0].sort_values("source")
            weight, context = (np.concatenate(x) for x in zip(*map(_unpack, got["x"])))
            word = (_long(weight) + rest / (types + 1)) / whole
            x = draw_gamma(_key(p.seed, 3, sweep, b.names[b.heads]), p.strength / p.discount + context[b.heads])
            t = np.minimum(b.c, 1)
            many = np.flatnonzero(b.c > 1)
            i, j = b.group[many], b.w[many]
            t[many] = draw_tables(_key(p.seed, 4, sweep, b.names[b.heads][i], b.names[j]), b.c[many], p.discount * x[i] * word[j], p.discount)
            dish, context = b.tables(t)
            edges = shared.value.cuts(b.names)
            out = [(0, k, at, _pack(dish[s:e], context[s:e])) for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if s < e]
            if sweep >= p.burn_in:
                for x in right.loc[right["source"] < 0, "x"]:
                    t = t + _unpack(x)[0]
                if last:
                    for block, x in zip(row["blocks"], row["slots"]):
                        of = np.cumsum(_unpack(x)[0])
                        out.append((2, int(block), at, _pack(b.c[of], t[of])))
                else:
                    out.append((1, at, -1, _pack(t)))
            return pd.DataFrame(out, columns=["kind", *_FRAME])

        rows = words.where("source >= 0").select(*_FRAME)
        if before is not None:
            rows = rows.union(before.where("kind = 1").select(*_FRAME))
        state = merged.select("at", "state", *(["blocks", "slots"] if last else []))
        return cut(state.groupBy("at").cogroup(rows.groupBy("at")).applyInPandas(run, f"kind int, {_ROWS}"), "children")

    def totals(words: DataFrame) -> tuple[int, int, int, int]:
        row = words.where("source < 0").agg(F.sum("types"), F.sum("customers"), F.sum("tables"), F.sum("weight")).first()
        return tuple(x or 0 for x in row)

    words, children, kept, sums = parent_sweep(None, 0, 0.0, 0), None, [], []
    types, customers, tables, weight = totals(words)
    for sweep in range(p.burn_in + S):
        # What the parent leaves to its base, from the same Dirichlet distribution as the words' weights.
        draw = lambda tag, shape: float(draw_gamma(_key(p.seed, tag, sweep, np.zeros(1, np.uint64)), np.array([shape]))[0])
        rest = draw(5, p.parent_strength + p.parent_discount * tables)
        children = child_sweep(words, children, sweep, rest, weight / 2**20 + rest, types, sweep == p.burn_in + S - 1)
        words = parent_sweep(children.where("kind = 0").select(*_FRAME), sweep + 1, draw(6, p.parent_strength / p.parent_discount + tables), types)
        _, customers, tables, weight = totals(words)
        if sweep >= p.burn_in:
            kept.append(words.where("source < 0").select("at", F.lit(len(kept)).cast("long").alias("source"), "x"))
            sums.append((customers, tables))

    def deal_words(batches):
        for b in _over_blocks(batches):
            n = b.word_counts()
            order = np.argsort(b.hashes, kind="stable")
            edges = shared.value.cuts(b.hashes[order])
            rows = [(k, (1 << 62) + b.id, struct.pack("<q", len(text := zstandard.compress(b" ".join([b.words[i] for i in order[s:e]]), 3))) + text + _pack(n[order[s:e]])) for k, (s, e) in enumerate(zip(edges[:-1].tolist(), edges[1:].tolist())) if s < e]
            yield pa.RecordBatch.from_pandas(_frame(rows), preserve_index=False)

    def meet(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        """One word bucket: exact counts by text, and the tables of all samples; a row for each block, and the totals (block -1)."""
        seen = Numbering()
        ids, ns = [], []
        asked = right[right["source"] >= 1 << 62].sort_values("source")
        for x in asked["x"]:
            (size,) = struct.unpack_from("<q", x)
            ids.append(np.fromiter(map(seen.__getitem__, zstandard.decompress(x[8 : 8 + size]).split(b" ")), np.int64))
            ns.append(_unpack(x[8 + size :])[0])
        c = np.zeros(len(seen), np.int64)
        for i, n in zip(ids, ns):
            c[i] += n
        here = _names(_unpack(left["state"].iloc[0])[0])
        every = np.zeros((1 + 3 * S, len(seen)), np.int64)
        every[0] = c
        at = np.searchsorted(here, _hash(list(seen)))  # each word of a block stands in some pair
        for s, x in zip(right["source"], right["x"]):
            if s < S:
                for k, v in enumerate(_unpack(x)):
                    every[1 + k * S + s] = v[at]
        bucket = int(left["at"].iloc[0])
        out = [(int(b) - (1 << 62), bucket, _pack(*every[:, i]), 0, 0) for b, i in zip(asked["source"], ids)]
        out.append((-1, bucket, b"", int(c.sum()), int((c > 0).sum())))
        return pd.DataFrame(out, columns=[*_FRAME, "tokens", "types"])

    dealt = table.mapInArrow(deal_words, _ROWS)
    for own in kept:
        dealt = dealt.union(own)
    met = cut(gathered.select("at", "state").groupBy("at").cogroup(dealt.groupBy("at")).applyInPandas(meet, f"{_ROWS}, tokens long, types long"), "words")
    n_train, n_types = (x or 0 for x in met.where("at < 0").agg(F.sum("tokens"), F.sum("types")).first())
    customers, tables = (np.array(x, float) for x in zip(*sums))

    def score(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        outs = []
        for row in left.to_dict("records"):
            b = _Block(row)
            pairs_, words_ = (right[right["kind"] == k].sort_values("source")["x"] for k in (0, 1))
            every = np.zeros((1 + 3 * S, len(b.words)), np.int64)
            every[:, np.argsort(b.hashes, kind="stable")] = np.concatenate([np.stack(_unpack(x)) for x in words_], 1)
            c, dishes, root, contexts = every[0], every[1 : 1 + S], every[1 + S : 1 + 2 * S], every[1 + 2 * S :]
            keys, at = _pairs(b.seq, b.counts, len(b.words))
            order, *_ = shared.value.pairs(keys, b.hashes)
            n, t = np.zeros(len(keys)), np.zeros(len(keys))
            n[order], t[order] = (np.concatenate(x) for x in zip(*map(_unpack, pairs_)))
            u, w = keys // len(b.words), keys % len(b.words)
            whole = np.zeros(len(keys))
            for s in range(S):
                above = (dishes[s] - p.parent_discount * root[s] + (p.parent_strength + p.parent_discount * tables[s]) / (types + 1)) / (p.parent_strength + customers[s])
                whole += (p.strength + p.discount * contexts[s][u]) * above[w]
            prob = (n - p.discount * t / S + whole / S) / (p.strength + c[u])
            log_p = np.log10(prob)[at]
            log_base = np.log10((c + 1) / (n_train + n_types + 1))[b.seq]
            starts = np.cumsum(b.counts) - b.counts
            outs.append(pd.DataFrame({"doc_id": pd.array(b.doc_ids, "Int64" if carried == "bigint" else object), "held_out": b.held, "n_tokens": b.counts, "n_known": np.add.reduceat((c[b.seq] > 0).astype(np.int64), starts), "base_score": np.add.reduceat(log_base, starts), "score": np.add.reduceat(log_p, starts)}))
        return pd.concat(outs) if outs else pd.DataFrame([], columns=["doc_id", "held_out", "n_tokens", "n_known", "base_score", "score"])

    values = children.where("kind = 2").select(F.lit(0).alias("kind"), *_FRAME).union(met.where("at >= 0").select(F.lit(1).alias("kind"), *_FRAME))
    scored = table.groupBy("block").cogroup(values.groupBy("at")).applyInPandas(score, f"doc_id {carried}, held_out boolean, n_tokens long, n_known long, base_score double, score double")
    return scored.select(F.col("doc_id").cast(docs.schema["doc_id"].dataType).alias("doc_id"), "held_out", "n_tokens", "n_known", F.lit(n_train).cast("long").alias("train_tokens"), F.round("base_score", 6).alias("base_score"), F.round("score", 6).alias("score"), F.pow(F.lit(10.0), -F.col("score") / F.col("n_tokens")).alias("perplexity"))


def _hot(table: DataFrame, p: HpyParams) -> tuple[np.ndarray, np.ndarray]:
    """Names of the contexts that are split, and into how many parts: judged by every ``hot / 256``-th token, at most some 2 N / hot rows for N tokens."""
    every = max(1, p.hot // 256)

    def sample(batches):
        for b in _over_blocks(batches):
            at, n = np.unique(b.seq[::every], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(b.hashes[at].astype(np.int64)), pa.array(n)], names=["name", "n"])

    found = table.mapInArrow(sample, "name long, n long").groupBy("name").agg((F.sum("n") * every).alias("n")).where(F.col("n") > p.hot).sort("name").toArrow()
    parts = -(-found.column("n").to_numpy() // p.hot)
    return found.column("name").to_numpy().astype(np.uint64), parts.astype(np.uint64)
