"""Benchmark decontamination: a generalised suffix automaton of the items, fed with each document's words.

The automaton holds every run of words of the items.  A document's words are fed one after
another; the longest suffix that occurs in some item is tracked, and wherever it reaches a window (13
consecutive item words, or a whole shorter item) the words of that window are hit.  Runs of words whose
neighbouring pairs occur in no item can't reach a window and are passed over before the automaton is entered.

Items are dealt into shards of about ``shard_bytes`` of different text (long items in pieces that overlap by a window less a word), a task builds
each shard's automaton, and it is written to the shared folder as plain arrays.  A pass over the documents broadcasts as many automata as measure ``pass_bytes`` together, one at
least; each pass adds to the findings of the last.

Defined cases: a null text has no words, and no item is found in it; items that are null, empty or without id have no windows;
item ids that are whole numbers come back as long, those of any other type as text; repeated items and documents are each answered; an empty benchmark finds nothing; an empty table gives an empty result;
extra columns are carried and never read, but for those named like a result, which are replaced.
"""

from __future__ import annotations

import bisect
import hashlib
import math
import pickle
import re
from itertools import repeat

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F, types as T

from .common import add_columns, alnum_words, cut, fresh, id_kind, texts

WINDOW = 13
#: A document is contaminated if hit words are at least this share of its words: 1 in 20.
COVERAGE = 20

_WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")
_LONGS = T.ArrayType(T.LongType())
_KINDS = {"bigint": pa.int64(), "string": pa.string()}


class SuffixAutomaton:
    """All runs of words of many texts.  A state is a class of runs that end at the same places.

    The arrays, which are all that is kept and shipped: ``keys`` (state * words + word, ascending) and ``to``, ``link`` and ``length`` of each state; texts whose windows
    end in a state (``here``, ``here_at``), texts shorter than a window that end there (``whole``), ids of each text (``ids``, ``ids_at``).
    """

    def __init__(self, items: list[tuple[list[int], list[bytes]]], window: int = WINDOW):
        """items: (ids, words) of each different text."""
        vocabulary: dict[bytes, int] = {}
        nxt, link, length = [{}], [-1], [0]
        pairs = set()
        shortest = window
        texts_ = [[vocabulary.setdefault(w, len(vocabulary)) for w in words] for _, words in items]
        for words in filter(None, texts_):
            pairs.update(zip(words, words[1:]))
            last = 0
            for w in words:
                last = self._extend(nxt, link, length, last, w)
            shortest = min(shortest, len(words))
        many = max(1, len(vocabulary))
        keys = np.fromiter((s * many + w for s, t in enumerate(nxt) for w in t), np.int64)
        to = np.fromiter((x for t in nxt for x in t.values()), np.int32)
        order = np.argsort(keys)
        self._set(window, shortest, list(vocabulary), keys[order], to[order], np.array(link, np.int32), np.array(length, np.int32), np.array(sorted(pairs), np.int64).reshape(-1, 2))
        del nxt
        # With all runs in, the classes are final: mark where each text's prefixes end.
        here: dict[int, set[int]] = {}
        whole = []
        for text, words in enumerate(texts_):
            state, size = 0, 0
            for w in words:
                state, size = self.step(state, size, w)
                if size >= window:
                    here.setdefault(state, set()).add(text)
            if 0 < len(words) < window:
                whole.append((state, len(words), text))
        # A text seen in a state is seen in all its suffixes' states; down to those that still hold a window.
        for state in sorted(range(len(length)), key=length.__getitem__, reverse=True):
            up = link[state]
            if state in here and up > 0 and length[up] >= window:
                here.setdefault(up, set()).update(here[state])
        states = sorted(here)
        flat = [np.array(sorted(here[s]), np.int32) for s in states]
        self.here = (np.array(states, np.int64), np.cumsum([0, *map(len, flat)]), np.concatenate(flat) if flat else np.zeros(0, np.int32))
        self.whole = np.array(sorted(whole), np.int64).reshape(-1, 3)
        ids = [x for i, _ in items for x in i]
        self.ids = (np.cumsum([0, *(len(i) for i, _ in items)]), np.array(ids, object if any(isinstance(x, str) for x in ids) else np.int64))

    def _set(self, window, shortest, words, keys, to, link, length, pairs):
        self.window, self.shortest, self.words, self.keys, self.to, self.link, self.length, self.pair_list = window, shortest, words, keys, to, link, length, pairs
        self._ready()

    def _ready(self):
        """What is quickly worked out from the arrays and not shipped."""
        self.vocabulary = {w: i for i, w in enumerate(self.words)}
        self.many = max(1, len(self.words))
        self.view = memoryview(self.keys)
        self.pairs = np.zeros(1 << 20, bool)
        if len(self.pair_list):
            self.pairs[self.pair_slot(*self.pair_list.T)] = True

    def __getstate__(self):
        return {k: v for k, v in self.__dict__.items() if k not in ("vocabulary", "many", "view", "pairs", "words")} | {"text": b" ".join(self.words)}

    def __setstate__(self, state):
        text = state.pop("text")
        self.__dict__.update(state, words=text.split(b" ") if text else [])
        self._ready()

    def nbytes(self) -> int:
        """About what it takes in a worker."""
        arrays = (self.keys, self.to, self.link, self.length, self.pair_list, *self.here, self.whole, *self.ids, self.pairs)
        names = sum(60 + len(x) for x in self.ids[1]) if self.ids[1].dtype == object else 0
        return names + sum(x.nbytes for x in arrays) + sum(map(len, self.words)) + 150 * len(self.words)

    @staticmethod
    def _extend(nxt: list[dict], link: list[int], length: list[int], last: int, w: int) -> int:
        def clone(p, q):
            new = len(nxt)
            nxt.append(dict(nxt[q])), link.append(link[q]), length.append(length[p] + 1)
            link[q] = new
            while p >= 0 and nxt[p].get(w) == q:
                nxt[p][w] = new
                p = link[p]
            return new

        if w in nxt[last]:
            q = nxt[last][w]
            return q if length[q] == length[last] + 1 else clone(last, q)
        new = len(nxt)
        nxt.append({}), link.append(0), length.append(length[last] + 1)
        p = last
        while p >= 0 and w not in nxt[p]:
            nxt[p][w] = new
            p = link[p]
        if p >= 0:
            q = nxt[p][w]
            link[new] = q if length[q] == length[p] + 1 else clone(p, q)
        return new

    def _next(self, state: int, w: int) -> int:
        key = state * self.many + w
        at = bisect.bisect_left(self.view, key)
        return int(self.to[at]) if at < len(self.view) and self.view[at] == key else -1

    def step(self, state: int, size: int, w: int) -> tuple[int, int]:
        """The state and length of the longest suffix after one more word."""
        while (to := self._next(state, w)) < 0:
            if not state:
                return 0, 0
            state = int(self.link[state])
            size = int(self.length[state])
        return to, size + 1

    @staticmethod
    def pair_slot(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        with np.errstate(over="ignore"):
            return ((a * np.int64(0x5851F42D4C957F2D) + b * np.int64(0x14057B7EF767814F)) >> np.int64(40)) & ((1 << 20) - 1)

    def ends(self, state: int, size: int) -> list[tuple[int, np.ndarray]]:
        """(length, texts) of the windows that end where the automaton is in ``state`` with a match of ``size`` words."""
        found = []
        states, cuts, texts_ = self.here
        while state > 0:
            up = int(self.link[state])
            for _, n, text in self.whole[np.searchsorted(self.whole[:, 0], state) : np.searchsorted(self.whole[:, 0], state, "right")]:
                if n <= size:
                    found.append((int(n), np.array([text])))
            if self.length[up] < self.window <= size and self.length[state] >= self.window:
                at = np.searchsorted(states, state)
                found.append((self.window, texts_[cuts[at] : cuts[at + 1]]))
            state = up
        return found

    def owners(self, texts_) -> list:
        """The ids of texts."""
        cuts, ids = self.ids
        return [x for t in texts_ for x in ids[cuts[t] : cuts[t + 1]].tolist()]

    def scan(self, docs: list[list[bytes]]) -> tuple[list[list[tuple[int, int]]], list[set]]:
        """For each document: the spans of hit words (merged, end exclusive), and the ids of the items found."""
        counts = np.fromiter(map(len, docs), np.int64, len(docs))
        get = self.vocabulary.get
        ids = np.fromiter((i for d in docs for i in map(get, d, repeat(-1))), np.int64, int(counts.sum()))
        starts = np.cumsum(counts) - counts
        spans: list[list[tuple[int, int]]] = [[] for _ in docs]
        items: list[set[int]] = [set() for _ in docs]
        joined = np.zeros(len(ids), bool)  # to the word before, in the same run
        if len(ids) > 1:
            known = np.flatnonzero((ids[1:] >= 0) & (ids[:-1] >= 0)) + 1
            joined[known] = self.pairs[self.pair_slot(ids[known - 1], ids[known])]
        joined[starts[counts > 0]] = False
        heads = np.flatnonzero(~joined & (ids >= 0))
        breaks = np.append(np.flatnonzero(~joined), len(ids))
        tails = breaks[np.searchsorted(breaks, heads, "right")]
        long = tails - heads >= self.shortest
        for a, b in zip(heads[long].tolist(), tails[long].tolist()):
            doc = int(np.searchsorted(starts, a, "right")) - 1
            base, state, size = int(starts[doc]), 0, 0
            for at, w in enumerate(ids[a:b].tolist(), a - base + 1):
                state, size = self.step(state, size, w)
                if size >= self.shortest:
                    for n, who in self.ends(state, size):
                        items[doc].update(who.tolist())
                        if spans[doc] and spans[doc][-1][1] >= at - n:
                            spans[doc][-1] = (min(spans[doc][-1][0], at - n), at)
                        else:
                            spans[doc].append((at - n, at))
        return [_merged(s) for s in spans], [set(self.owners(t)) for t in items]


def _merged(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    out: list[tuple[int, int]] = []
    for a, b in sorted(spans):
        if out and a <= out[-1][1]:
            out[-1] = (out[-1][0], max(b, out[-1][1]))
        else:
            out.append((a, b))
    return out


def automata(benchmark: DataFrame, window: int, shard_bytes: int) -> DataFrame:
    """(shard, size, automaton): one row for each shard, built in the task that holds it and written to the shared folder."""
    kind = id_kind(benchmark, "item_id").simpleString()
    items = benchmark.where("item_id is not null and text is not null").select(F.col("item_id").cast(kind).alias("item_id"), "text")
    different = items.groupBy("text").agg(F.sort_array(F.collect_set("item_id")).alias("ids"))
    most = max(4 * window, shard_bytes // 32)  # words of a piece; a word has eight bytes or so

    def pieces(batches):
        for batch in batches:
            out = [[], []]
            for words, ids in zip(map(alnum_words, texts(batch)), batch.column(1).to_pylist()):
                for a in range(0, max(1, len(words) - window + 1), most):
                    out[0].append(ids)
                    out[1].append(b" ".join(words[a : a + most + window - 1]))
            yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.list_(_KINDS[kind])), pa.array(out[1], pa.binary())], names=["ids", "words"])

    cut_up = cut(different.select("text", "ids").mapInArrow(pieces, f"ids array<{kind}>, words binary"), "items")
    total = cut_up.agg(F.sum(F.octet_length("words"))).first()[0] or 0
    many = max(1, math.ceil(total / shard_bytes))

    def build(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("words")
        machine = SuffixAutomaton([(list(i), w.split()) for i, w in zip(pdf["ids"], pdf["words"])], window)
        return pd.DataFrame({"shard": [int(pdf["shard"].iloc[0])], "size": [machine.nbytes()], "automaton": [pickle.dumps(machine)]})

    sharded = cut_up.withColumn("shard", F.pmod(F.xxhash64("words"), F.lit(many)))
    return cut(sharded.groupBy("shard").applyInPandas(build, "shard long, size long, automaton binary"), "automata")


def _passes(built: DataFrame, pass_bytes: int) -> list[list[int]]:
    """Shards dealt to passes in order of their number."""
    passes, size = [[]], 0
    for shard, n in built.select("shard", "size").sort("shard").collect():  # one short row a shard
        if passes[-1] and size + n > pass_bytes:
            passes.append([])
            size = 0
        passes[-1].append(shard)
        size += n
    return passes


def find(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, shard_bytes: int = 1 << 20, pass_bytes: int = 64 << 20, text: str = "text") -> DataFrame:
    """``docs`` with n_words, n_hit, n_items, items, spans (start and end word, in turns) and contaminated."""
    built = automata(benchmark, window, shard_bytes)
    results = {"n_words", "n_hit", "n_items", "items", "spans", "contaminated"}
    docs = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in results])
    found = fresh(docs, "_found")
    kind = T.StructType([T.StructField("n_words", T.LongType()), T.StructField("spans", _LONGS), T.StructField("items", T.ArrayType(id_kind(benchmark, "item_id")))])
    for k, chosen in enumerate(_passes(built, pass_bytes)):
        # At most pass_bytes, or one automaton.
        machines = [pickle.loads(bytes(r[0])) for r in built.where(F.col("shard").isin(chosen)).sort("shard").select("automaton").toLocalIterator()] if chosen else []
        before = f"{found}_before"
        if k:
            docs = cut(docs.withColumnRenamed(found, before), "hits")
        shared = docs.sparkSession.sparkContext.broadcast(machines)

        def make(shared=shared, k=k, before=before):
            def work(batch):
                words = [alnum_words(x) for x in texts(batch, text)]
                spans: list[list] = [[] for _ in words]
                items: list[set] = [set() for _ in words]
                if k:
                    for i, r in enumerate(batch.column(batch.schema.get_field_index(before)).to_pylist()):
                        spans[i] = list(zip(r["spans"][::2], r["spans"][1::2]))
                        items[i] = set(r["items"])
                for machine in shared.value:
                    for i, (s, t) in enumerate(zip(*machine.scan(words))):
                        spans[i] += s
                        items[i] |= t
                return [[{"n_words": len(w), "spans": [x for y in _merged(s) for x in y], "items": sorted(t)} for w, s, t in zip(words, spans, items)]]

            return work

        docs = add_columns(docs, make, [T.StructField(found, kind)], text).drop(before)
    f = F.col(found)
    s = f["spans"]
    hit = F.when(F.size(s) == 0, F.lit(0).cast("long")).otherwise(F.aggregate(F.transform(s, lambda x, i: F.when(i % 2 == 0, -x).otherwise(x)), F.lit(0).cast("long"), lambda a, x: a + x))
    out = docs.withColumns({"n_words": f["n_words"], "n_hit": hit, "n_items": F.size(f["items"]).cast("long"), "items": f["items"], "spans": s}).drop(found)
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (COVERAGE * F.col("n_hit") >= F.col("n_words")))


def digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def strip(docs: DataFrame, text: str = "text") -> DataFrame:
    """Cut the hit spans, from the first hit word's first byte to the last one's last, out of the texts that ``find`` returned."""

    def make():
        def work(batch):
            out = []
            raw = batch.column(batch.schema.get_field_index(text)).cast(pa.large_binary()).to_pylist()
            for x, spans in zip(raw, batch.column("spans").to_pylist()):
                if x is not None and spans:
                    places = [m.span() for m in _WORD.finditer(x)]
                    kept, at = [], 0
                    for a, b in zip(spans[::2], spans[1::2]):
                        kept.append(x[at : places[a][0]])
                        at = places[b - 1][1]
                    x = b"".join([*kept, x[at:]])
                out.append(None if x is None else x.decode("utf-8", "replace"))
            return [out]

        return work

    to = fresh(docs, "_stripped")
    return add_columns(docs, make, [T.StructField(to, T.StringType())], text).withColumn(text, F.col(to)).drop(to)
