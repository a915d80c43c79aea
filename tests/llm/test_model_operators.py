import itertools
import decimal
import json
import math
import random
import struct
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riverdeck.llm import hpylm, packing, sentencepieces, toolcalls, toxicity
from riverdeck.llm.common import alnum_words
from tests.llm.helpers import LONG, awkward, empty, labels
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
vocabularies = pytest.importorskip("public_tokenizers")


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# SentencePiece


@pytest.fixture(scope="module")
def pieces():
    return sentencepieces.load(vocabularies.path("piece_bpe_32k.model"))


@pytest.fixture(scope="module")
def reference():
    return sentencepiece.SentencePieceProcessor(model_file=vocabularies.path("piece_bpe_32k.model"))


ODD = ["", " ", "  a  b ", "a\n\n b\t\x01 ▁x 日本語 😀😀", "ab" * 3000, "x" * 1000 + " " + "thequickbrown" * 60, "Hello world (this) is_a test; foo=bar+baz  \n  x", "\n", "ß" * 300, "a▁b"]


def encoded(pieces, rows):
    bounds, ids = sentencepieces.Encoder(pieces)([x.encode() for x in rows])
    return [ids[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])]


def test_encoding_equals_the_library(pieces, reference, texts):
    rows = [t for _, t in texts] + ODD
    got = encoded(pieces, rows)
    assert got == reference.encode(rows)
    assert all(sentencepieces.decode(pieces, g) == t.replace("▁", " ").encode() for g, t in zip(got, rows))


@settings(max_examples=150, deadline=None)
@given(st.lists(st.text(alphabet="aebtoh nrsT.\n▁é日", max_size=60), min_size=1, max_size=4))
def test_encoding_of_random_texts(pieces, reference, rows):
    assert encoded(pieces, rows) == reference.encode(rows)


def test_unigram_takes_the_best_path():
    names = [b"<unk>", b"a", b"b", b"ab", b"ba", b"aba", b" a", b" "]
    scores = np.array([0.0, -3.0, -3.1, -4.0, -3.7, -6.9, -4.5, -2.0])
    table = sentencepieces.Pieces(names, scores, np.arange(1, 8), np.zeros(256, np.int32), unigram=True)

    def best(text):
        options = []
        for n in range(len(text) + 1):
            for cuts in itertools.combinations(range(1, len(text)), n - 1) if n else ():
                parts = [text[i:j] for i, j in zip((0, *cuts), (*cuts, len(text)))]
                if all(p in names for p in parts):
                    options.append(sum(scores[names.index(p)] for p in parts))
        return max(options)

    for text in ("a", "ab", "abab", "ababa", "baab", "aabba"):
        got = encoded(table, [text])[0]
        assert b"".join(names[i] for i in got) == b" " + text.encode()
        assert sum(scores[i] for i in got) == pytest.approx(best(b" " + text.encode()))


def _message(*fields):
    """A protocol-buffer message of (number, whole number, float or bytes)."""

    def varint(n):
        out = b""
        while n > 127:
            out, n = out + bytes([n & 127 | 128]), n >> 7
        return out + bytes([n])

    def one(k, v):
        if isinstance(v, float):
            return varint(k << 3 | 5) + struct.pack("<f", v)
        return varint(k << 3) + varint(v) if isinstance(v, int) else varint(k << 3 | 2) + varint(len(v)) + v

    return b"".join(one(k, v) for k, v in fields)


def _model(path, names, kind, fallback, prefix=1, extra=0):
    """A model file: <unk>, the byte pieces if wanted, and the pieces with scores."""
    pieces = [("<unk>", 0.0, 2)] + [(f"<0x{i:02X}>", 0.0, 6) for i in range(256) if fallback] + [(n, s, 1) for n, s in names]
    rows = [(1, _message((1, n.encode()), (2, float(s)), (3, t))) for n, s, t in pieces]
    path.write_bytes(_message(*rows, (2, _message((3, kind), (35, int(fallback)))), (3, _message((1, b"identity"), (3, prefix), (4, extra), (5, 1)))))
    return str(path)


@pytest.mark.parametrize("kind, fallback, prefix", [(1, True, 1), (1, False, 1), (1, True, 0), (2, True, 1), (2, False, 0)])
def test_models_of_any_kind_equal_the_library(tmp_path, kind, fallback, prefix):
    rng = random.Random(kind)
    names = {"▁", *"abcdef", "▁a", "ab", "abc", "bc", "cab", "▁ab", "▁cab", "de", "fde", "é"} | {"a" * 70}
    names = [(n, -rng.uniform(1, 9) if kind == 1 else -i) for i, n in enumerate(sorted(names, key=lambda n: (-len(n), n)))]
    path = _model(tmp_path / "m.model", names, kind, fallback, prefix)
    table = sentencepieces.load(path)
    assert (table.unigram, table.prefix, table.fallback) == (kind == 1, bool(prefix), fallback)
    own = sentencepiece.SentencePieceProcessor(model_file=path)
    rows = ["".join(rng.choices("abcdef  é日\n", k=rng.randrange(1, 60))) for _ in range(60)] + ["", "b" + "a" * 70 + "é", "日本 日本x"]
    assert encoded(table, rows) == own.encode(rows)


def test_models_that_change_texts_are_refused(tmp_path):
    for kind, extra in ((1, 1), (3, 0)):
        with pytest.raises(ValueError):
            sentencepieces.load(_model(tmp_path / "m.model", [("a", -1.0)], kind, True, extra=extra))


def test_segments_kept_are_bounded_by_bytes(pieces):
    encoder = sentencepieces.Encoder(pieces, keep=20000)
    for i in range(30):
        encoder([" ".join(f"w{i}x{j}" + "y" * 300 for j in range(20)).encode()])
        assert encoder.held < 40000


def test_suffix_array_is_sorted_and_finds_all():
    text = np.frombuffer(b"banana\0bandana\0" * 3, np.uint8)
    s = sentencepieces.SuffixArray(text, 16)
    raw = bytes(text)
    assert [raw[i:][:16] for i in s.array] == sorted(raw[i:][:16] for i in range(len(raw)))
    for pattern in (b"an", b"banana", b"dana\0ban", b"zz", b"bandana\0b"):
        low = np.frombuffer(pattern.ljust(16, b"\0"), ">u8").astype(np.uint64)[None]
        high = np.frombuffer(pattern.ljust(16, b"\xff"), ">u8").astype(np.uint64)[None]
        lo, hi = s.ranges(low, high, np.array([len(pattern)]))
        assert sorted(s.array[lo[0] : hi[0]].tolist()) == [i for i in range(len(raw)) if raw.startswith(pattern, i)]


def test_encode_and_decode_columns(spark, pieces):
    docs = awkward(spark, ODD)
    out = sentencepieces.encode(docs, pieces)
    assert out.count() == docs.count() and out.where("not round_trip").count() == 0
    back = sentencepieces.decode_column(out, pieces)
    assert back.where("decoded <> replace(coalesce(text, ''), '▁', ' ')").count() == 0
    assert sentencepieces.encode(empty(spark), pieces).count() == 0


# Packing


@settings(max_examples=80, deadline=None)
@given(st.lists(st.integers(1, 50), max_size=80))
def test_best_fit_decreasing(lengths):
    rows = packing.best_fit(lengths, 50)
    assert sorted(i for r in rows for i in r) == list(range(len(lengths)))
    slow = []  # the plain method: the row with the least room that is enough
    for n in sorted(lengths, reverse=True):
        fits = [r for r in slow if r[0] >= n]
        row = min(fits, key=lambda r: r[0]) if fits else None
        if row is None:
            slow.append([50 - n])
        else:
            row[0] -= n
    assert Counter(50 - sum(lengths[i] for i in r) for r in rows) == Counter(r[0] for r in slow)


def test_packing_is_lossless(spark, texts):
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    rows = [*texts, (7000, None), (7001, ""), (7002, LONG), (None, "no id")]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    packed = packing.pack(docs, path, width=512, block=1 << 14).persist()
    for r in packed.collect():
        assert len(r["ids"]) == 1024 and r["cu_seqlens"][0] == 0 and r["cu_seqlens"][-1] == r["n_tokens"] <= 512
        assert r["reset_at"] == r["cu_seqlens"][:-1] and len(r["doc_ids"]) == len(r["chunks"]) == len(r["reset_at"])
    encoding = packing._encoding(path)
    got = {}
    for r in packing.unpack(packed, 512).orderBy("doc_id", "chunk").collect():
        got.setdefault(r["doc_id"], []).extend(r["ids"])
    assert {d: encoding.decode(x[:-1]) for d, x in got.items()} == {d: t for d, t in rows if t is not None}
    assert all(x[-1] == 50256 for x in got.values())
    assert packing.pack(empty(spark), path).count() == 0 and packing.pack(awkward(spark), path).count() > 0


def test_packing_with_a_large_vocabulary(spark, tmp_path):
    """70,000 pieces: the 256 bytes and pairs, triples of them; the end token follows the vocabulary, and ids take 32 bits."""
    import base64

    pieces = [bytes([i]) for i in range(256)] + [bytes([a, b]) for a in range(256) for b in range(256)] + [b"abc" + bytes([i]) for i in range(256)]
    path = tmp_path / "pieces"
    path.write_bytes(b"\n".join(base64.b64encode(p) + b" %d" % i for i, p in enumerate([*pieces, *[b"abcd" * 2 + b"%d" % i for i in range(5000)]])))
    docs = spark.createDataFrame([(1, "abcd words here"), (2, "")], "doc_id long, text string")
    packed = packing.pack(docs, str(path), width=64)
    got = {r["doc_id"]: r["ids"] for r in packing.unpack(packed, 64).collect()}
    n = len(pieces) + 5000
    assert n > 1 << 16 and all(x[-1] == n for x in got.values()) and got[2] == [n]
    assert packing._encoding(str(path)).decode(got[1][:-1]) == "abcd words here"
    assert all(len(r["ids"]) == 256 for r in packed.collect())


# Toxicity


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(-4, 4).filter(bool), max_size=25))
def test_maximal_segments(scores):
    """By the recursive definition: the best segment, then the same on either side of it."""

    def slow(a, b):
        best = None
        for i in range(a, b):
            for j in range(i + 1, b + 1):
                s = sum(scores[i:j])
                if s > 0 and (best is None or s > best[0] or (s == best[0] and j - i < best[2] - best[1])):
                    best = (s, i, j)
        return [] if best is None else [*slow(a, best[1]), best, *slow(best[2], b)]

    got = toxicity.segments(np.array(scores, float))
    assert sum(s for *_, s in got) == sum(s for s, *_ in slow(0, len(scores)))
    assert max((s for *_, s in got), default=0) == max((s for s, *_ in slow(0, len(scores))), default=0)
    assert all(sum(scores[a:b]) == s for a, b, s in got) and all(x[1] <= y[0] for x, y in zip(got, got[1:]))


def test_toxicity_on_held_out_rows(spark):
    sf = "/root/testdata/sf0.1"
    docs = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text")
    labelled = spark.read.parquet(f"{sf}/labels.parquet")
    left = F.crc32(F.col("doc_id").cast("string")) % 4
    model = toxicity.fit(spark, docs, labelled, left != 2)
    rows = toxicity.score(docs, model).join(labelled, "doc_id").where(left == 2).select("toxic", "score").collect()
    right = Counter((r["toxic"], r["score"] >= 0.3) for r in rows)
    assert right[1, True] >= 0.9 * (right[1, True] + right[1, False])
    assert right[0, False] >= 0.99 * (right[0, True] + right[0, False])


def test_toxic_passages_of_words_seen_before_are_segments():
    model = toxicity.ToxicityModel(toxicity.ToxicityParams(), {b"bad": 4.0, b"vile": 4.0, b"foul": 4.0})
    measure = lambda text: toxicity._measure(model, toxicity._Scores(model), text.encode())
    far = " calm" * 40 + " "
    assert measure("bad" + far + "vile" + far + "foul" + far + "bad vile foul bad")[3] == [123, 127]
    once, twice = measure("bad vile foul" + far), measure("bad vile foul" + far + "bad vile foul")
    assert once[3] == [0, 3] and twice[3] == [0, 3, 43, 46]
    assert twice[2] <= once[2]  # repeats add no evidence


def test_extreme_value_constants_are_found_again():
    rng = np.random.default_rng(4)
    n = rng.integers(50, 2000, 20000).astype(float)
    best = np.log(0.02 * n / rng.exponential(size=len(n))) / 1.7  # P(best < x) = exp(-K n exp(-lambda x))
    lam, k = toxicity.extreme_value(n, np.where(best < 2, 0, best), 2.0)
    assert lam == pytest.approx(1.7, rel=0.03) and k == pytest.approx(0.02, rel=0.1)
    assert all(np.isfinite(toxicity.extreme_value(n, np.zeros(len(n)), 2.0)))


def slow_toxicity(train, docs, p):
    """The model and the scores by the definitions, in plain loops."""
    train = list({(t or "", y) for t, y in train})
    size = [sum(y == k for _, y in train) for k in (0, 1)]
    sets = [(set(f for w in alnum_words(t.encode()) for f in toxicity.features_of(w)), y) for t, y in train]
    odds = {}
    for f in set().union(*(s for s, _ in sets)):
        y = [sum(f in s for s, k in sets if k == j) for j in (0, 1)]
        a = p.prior * sum(y) / sum(size)
        parts = [(y[j] + a) / (size[j] + p.prior - y[j] - a) if size[j] + p.prior > y[j] + a else None for j in (0, 1)]
        if None not in parts and (o := math.log(parts[1]) - math.log(parts[0])) >= p.odds_min and o / math.sqrt(1 / (y[1] + a) + 1 / (y[0] + a)) >= p.z_min:
            odds[f] = o

    def points(words):
        return [max((odds[f] for f in toxicity.features_of(w) if f in odds), default=p.background) for w in words]

    def maximal(scores, a, b):
        """The best segment, the shortest and first of equals, then the same on either side."""
        best = max(((round(sum(scores[i:j]), 9), i - j, -i, i, j) for i in range(a, b) for j in range(i + 1, b + 1)), default=(0,))
        return [] if best[0] <= 0 else [*maximal(scores, a, best[3]), (best[3], best[4], sum(scores[best[3] : best[4]])), *maximal(scores, best[4], b)]

    def found(t):
        words = alnum_words((t or "").encode())
        scores = points(words)
        return words, scores, maximal(scores, 0, len(words))

    clean = [found(t) for t, y in train if not y]
    clean = [(len(w), max((s for *_, s in x), default=0.0)) for w, _, x in clean if w]
    lam, k = toxicity.extreme_value(*map(np.array, zip(*[(float(a), b) for a, b in clean])), min(odds.values()))

    def evidence(t):
        words, scores, segments = found(t)
        base = math.log(max(k * max(1, len(words)), 1e-9))
        seen, total = set(), 0.0
        for a, b, s in segments:
            if k * len(words) * math.exp(-lam * s) <= p.e_max * (1 + 1e-12):
                for i in range(a, b):
                    if scores[i] > 0:
                        s -= scores[i] if words[i] in seen else 0
                        seen.add(words[i])
                total += max(0.0, s)
        return lam * total - base

    x, y = np.array([evidence(t) for t, _ in train]), np.array([k for _, k in train], float)
    slope, bias = toxicity._logistic(x, y)
    return [1 / (1 + math.exp(-slope * evidence(t) - bias)) for t in docs]


def test_toxicity_scores_equal_brute_force(spark):
    rng = random.Random(11)
    calm, bad = [f"calm{i}" for i in range(80)], ["vile", "foul", "rotten", "nasty"]
    rows = []
    for i in range(160):
        words = rng.choices(calm, k=rng.randrange(1, 40))
        for _ in range(rng.randrange(3, 9) if i % 4 == 0 else rng.random() < 0.04):
            words.insert(rng.randrange(len(words)) if rng.random() < 0.2 else len(words) // 2, rng.choice(bad))
        rows.append((i, " ".join(words), int(i % 4 == 0)))
    rows += [(200, rows[0][1], 1), (201, "", 0), (202, None, 0)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, y int")
    params = toxicity.ToxicityParams(prior=5.0, odds_min=1.0)
    model = toxicity.fit(spark, docs.drop("y"), docs.select("doc_id", F.col("y").alias("toxic")), params=params)
    got = {r["doc_id"]: r["score"] for r in toxicity.score(docs, model).collect()}
    want = slow_toxicity([(t, y) for _, t, y in rows], [t for _, t, _ in rows], params)
    assert max(got.values()) > 0.6 and min(got.values()) < 0.2
    assert [got[d] for d, _, _ in rows] == pytest.approx(want, abs=1e-6)


def test_toxicity_takes_anything(spark):
    model = toxicity.fit(spark, awkward(spark), labels(spark))
    out = toxicity.score(awkward(spark), model)
    assert out.count() == awkward(spark).count() and out.where("score is null or score < 0 or score > 1").count() == 0
    assert toxicity.score(empty(spark), model).count() == 0


# LM scoring


def _lm(spark, rows):
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    return {r["doc_id"]: r for r in hpylm.fit_and_score(docs).collect()}


def test_lm_base_and_sums(spark, texts):
    rows = [(d, t, d % 7 == 2) for d, t in texts] + [(9000, None, False), (9001, "", True), (9002, "zzz qqq", True)]
    got = _lm(spark, rows)
    words = lambda t: [*(t or "").encode().lower().split(), b""]
    c = Counter(w for _, t, h in rows if not h for w in words(t))
    n, v = sum(c.values()), len(c)
    for d, t, _ in rows:
        r, w = got[d], words(t)
        assert (r["n_tokens"], r["n_known"], r["train_tokens"]) == (len(w), sum(x in c for x in w), n)
        assert r["base_score"] == pytest.approx(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), abs=1e-4)
    held = [got[d] for d, _, h in rows if h]
    assert sum(r["score"] for r in held) > sum(r["base_score"] for r in held)


def test_lm_probabilities_sum_to_one(spark):
    """Texts of one and of two words, with the unknown word among them, give a linear system for the chances after the end token; these sum to one."""
    train = [(i, t, False) for i, t in enumerate(["a b a b c", "a b", "b a a", "c c b a"] * 3)]
    words = ["a", "b", "c", "zz"]
    pairs = [(200 + 10 * i + j, f"{u} {w}", True) for i, u in enumerate(words) for j, w in enumerate(words)]
    got = _lm(spark, train + [(100 + i, w, True) for i, w in enumerate(words)] + pairs + [(99, "", True)])
    p = lambda d: 10 ** got[d]["score"]
    # With s_u = P(u | end) and e_u = P(end | u): p(u) = s_u e_u and p(u v) = s_u P(v | u) e_v.  The sum of P(v | u) and e_u is 1 for each u, so
    # s_u = p(u) + sum over v of p(u v) / p(v) * s_v.
    one = np.array([p(100 + i) for i in range(4)])
    m = np.array([[p(200 + 10 * i + j) / one[j] for j in range(4)] for i in range(4)])
    start = np.linalg.solve(np.eye(4) - m, one)
    assert start.sum() + p(99) == pytest.approx(1, abs=1e-4)


def table_chances(c, open_, d):
    """The chances of 1 to c tables with weights S(c, t) open_^t, by the recursion of the generalised Stirling numbers."""
    s = np.full((c + 1, c + 1), -np.inf)
    s[0, 0] = 0
    for n in range(1, c + 1):
        for t in range(1, n + 1):
            stay = s[n - 1, t] + math.log(n - 1 - d * t) if n - 1 >= t else -np.inf
            s[n, t] = np.logaddexp(s[n - 1, t - 1], stay)
    p = s[c, 1:] + np.arange(1, c + 1) * math.log(open_)
    p = np.exp(p - p.max())
    return p / p.sum()


def test_tables_follow_their_conditional():
    # Two customers, by hand: S(2, 1) = 1 - d and S(2, 2) = 1.
    assert table_chances(2, 0.3, 0.8)[1] == pytest.approx(0.3 / (0.3 + 0.2))
    keys = hpylm._key(1, 2, 3, np.arange(20000, dtype=np.uint64))
    for d in (0.6, 0.8):
        for c in (2, 3, 7, 20, 60, 150):
            for open_ in (0.001, 0.05, 0.5, 2, 20):
                p, k = table_chances(c, open_, d), np.arange(1, c + 1)
                mean = (p * k).sum()
                t = hpylm.draw_tables(keys, np.full(20000, c), np.full(20000, float(open_)), d)
                assert (t >= 1).all() and (t <= c).all()
                assert abs(t.mean() - mean) < 0.1 * mean + 0.02
                assert abs(t.std() - math.sqrt((p * k * k).sum() - mean**2)) < 0.15 * mean
    assert (hpylm.draw_tables(keys[:2], np.array([0, 1]), np.array([1.0, 1.0]), 0.8) == [0, 1]).all()


def test_lm_and_packing_take_ids_of_any_type(spark):
    rows = [(f"d{i}", t, held) for i, t, held in _corpus(n=20)] + [(None, "w1", False)]
    docs = spark.createDataFrame(rows, "doc_id string, text string, held_out boolean")
    got = hpylm.fit_and_score(docs)
    assert got.schema["doc_id"].dataType.simpleString() == "string" and Counter(r["doc_id"] for r in got.collect()) == Counter(r[0] for r in rows)
    by_number = {r["doc_id"]: r["score"] for r in hpylm.fit_and_score(spark.createDataFrame(_corpus(n=20) + [(None, "w1", False)], "doc_id int, text string, held_out boolean")).collect()}
    assert {r["doc_id"]: r["score"] for r in got.collect()} == {None if d is None else f"d{d}": s for d, s in by_number.items()}
    path = vocabularies.path("byte_bpe_50k.tiktoken")
    for kind, value in (("string", lambda i: f"d{i}"), ("int", int), ("decimal(9,1)", lambda i: decimal.Decimal(i))):
        packed = packing.pack(spark.createDataFrame([(value(i), f"text {i}") for i in range(5)] + [(None, "x")], f"doc_id {kind}, text string"), path, width=64)
        assert packed.schema["doc_ids"].dataType.elementType.simpleString() == kind
        assert {r["doc_id"] for r in packing.unpack(packed, 64).collect()} == {None, *(value(i) for i in range(5))}


def test_keyed_random_numbers():
    keys = hpylm._key(1, 2, 3, np.arange(40000, dtype=np.uint64))
    for shape in (0.2, 0.8, 1.0, 3.5, 200.0):
        g = hpylm.draw_gamma(keys, np.full(40000, shape))
        assert g.mean() == pytest.approx(shape, rel=0.03) and g.var() == pytest.approx(shape, rel=0.06)
    for mean in (0.1, 5.0, 50.0):
        x = hpylm._poisson(keys, 0, np.full(40000, mean))
        assert x.mean() == pytest.approx(mean, rel=0.03) and x.var() == pytest.approx(mean, rel=0.06)


def test_packed_numbers():
    for arrays in ([np.array([], np.int64)], [np.array([0, 1, 255, 256, 2**47]), np.zeros(5, np.int64)], [np.arange(1000), np.arange(3)]):
        assert all((x == y).all() for x, y in zip(hpylm._unpack(hpylm._pack(*arrays)), arrays, strict=True))


def _corpus(seed=2, n=90):
    """Texts from a small chain of words, so that some contexts and words are far more frequent than others."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(25)]
    follow = {w: rng.choices(words, k=6, weights=[1 / (1 + j) for j in range(25)]) for w in words}
    rows = []
    for i in range(n):
        w = [rng.choice(words[:3])]
        for _ in range(rng.randrange(2, 15)):
            w.append(rng.choice(follow[w[-1]]) if rng.random() < 0.9 else rng.choice(words))
        rows.append((i, " ".join(w), i % 7 == 2))
    return rows


def restaurants(rows, p, burn_in, samples, seed=5):
    """log10 probabilities of the texts by a plain simulation: each customer of every restaurant gets up and is seated again, table by table."""
    rng = random.Random(seed)
    texts_ = {i: [*t.split(), ""] for i, t, _ in rows}
    train = [(u, w) for i, t, held in rows if not held for u, w in zip(["", *texts_[i]], texts_[i])]
    types = len({w for _, w in train})
    child, parent = {}, {}  # (context, word) -> sizes of its tables; word -> sizes of its tables
    customers, tables, above, above_tables = Counter(), Counter(), 0, 0

    def base(w):
        own = parent.get(w, [])
        return (sum(own) - p.parent_discount * len(own) + (p.parent_strength + p.parent_discount * above_tables) / (types + 1)) / (p.parent_strength + above)

    def seat(sizes, d, new):
        """Join a table or open one; True if opened."""
        x = rng.random() * (sum(sizes) - d * len(sizes) + new)
        for i, n in enumerate(sizes):
            x -= n - d
            if x < 0:
                sizes[i] += 1
                return False
        sizes.append(1)
        return True

    def leave(sizes):
        """A random customer gets up; True if the table goes."""
        i = rng.choices(range(len(sizes)), sizes)[0]
        sizes[i] -= 1
        if not sizes[i]:
            del sizes[i]
            return True
        return False

    def add(u, w):
        nonlocal above, above_tables
        opened = seat(child.setdefault((u, w), []), p.discount, (p.strength + p.discount * tables[u]) * base(w))
        customers[u] += 1
        if opened:
            tables[u] += 1
            above_tables += seat(parent.setdefault(w, []), p.parent_discount, (p.parent_strength + p.parent_discount * above_tables) / (types + 1))
            above += 1

    def remove(u, w):
        nonlocal above, above_tables
        customers[u] -= 1
        if leave(child[u, w]):
            tables[u] -= 1
            above -= 1
            above_tables -= leave(parent[w])

    for u, w in train:
        add(u, w)
    total = {}
    for sweep in range(burn_in + samples):
        for u, w in train:
            remove(u, w)
            add(u, w)
        if sweep >= burn_in:
            for u, w in {x for t in texts_.values() for x in zip(["", *t], t)}:
                own = child.get((u, w), [])
                chance = (sum(own) - p.discount * len(own) + (p.strength + p.discount * tables[u]) * base(w)) / (p.strength + customers[u])
                total[u, w] = total.get((u, w), 0) + chance / samples
    return {i: sum(math.log10(total[x]) for x in zip(["", *t], t)) for i, t in texts_.items()}


def test_lm_agrees_with_a_plain_simulation(spark):
    rows = _corpus()
    params = hpylm.HpyParams(burn_in=4, samples=12)
    docs = spark.createDataFrame(rows, "doc_id long, text string, held_out boolean")
    got = {r["doc_id"]: r["score"] for r in hpylm.fit_and_score(docs, params).collect()}
    want = restaurants(rows, params, 40, 200)
    assert all(abs(got[i] - want[i]) < 0.02 * abs(want[i]) for i in want)
    assert abs(sum(got.values()) - sum(want.values())) < 0.005 * abs(sum(want.values()))


def test_scores_are_the_same_however_they_are_spread(spark):
    """Other numbers of partitions, blocks and buckets, and contexts dealt into several buckets: the same scores."""
    docs = spark.createDataFrame(_corpus(), "doc_id long, text string, held_out boolean")
    default = hpylm.fit_and_score(docs.coalesce(1)).collect()
    small = hpylm.HpyParams(block=64, pairs=50, words=20, hot=16)
    before = spark.conf.get("spark.sql.shuffle.partitions")
    try:
        spark.conf.set("spark.sql.shuffle.partitions", "9")
        table = hpylm.cut(hpylm.blocks(docs, 64), "blocks")
        names, parts = hpylm._hot(table, small)
        assert len(names) >= 5 and (parts > 1).all() and hpylm._hash([b""])[0] in names
        spread = hpylm.fit_and_score(docs.repartition(5), small).collect()
    finally:
        spark.conf.set("spark.sql.shuffle.partitions", before)
    assert sorted(map(tuple, default)) == sorted(map(tuple, spread)) and len(default) == 90


def test_lm_takes_anything(spark):
    docs = awkward(spark).select("doc_id", "text", F.lit(False).alias("held_out"))
    assert hpylm.fit_and_score(docs).count() == docs.count()
    assert hpylm.fit_and_score(docs.limit(0)).count() == 0
    alone = hpylm.fit_and_score(docs.withColumn("held_out", F.lit(True))).collect()
    assert all(r["n_known"] == 0 and r["train_tokens"] == 0 for r in alone)


# Tool calls


def test_tool_calls_equal_sql(spark):
    from riverdeck.llm import queries

    assert spark_rows(queries.op10_tool_calls(spark, SF)) == duck_rows(queries.ORACLES["op10_tool_calls"])


CALL_SCHEMAS = [("add", [("a", ["BIGINT"], True), ("b", ["BIGINT", "DOUBLE", "DECIMAL(2,1)"], False)])]


def _link(spark, messages):
    df = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    calls = toolcalls.messages_to_calls(df).where("name <> 'reply'")
    return toolcalls.link(calls, toolcalls.messages_to_results(df), CALL_SCHEMAS)


def _asked(*calls):
    return json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a, "depends_on": d} for i, n, a, d in calls]})


def test_calls_are_linked_ordered_and_checked(spark):
    messages = [
        (1, 0, "assistant", _asked(("c1", "add", {"b": 2, "a": 1}, []), ("c2", "add", {"a": "x"}, ["c1"]), ("c3", "add", {}, ["c1", "c2", "gone"]), ("c4", "other", {"a": 1}, ["c5"]), ("c5", "add", {"a": 1}, ["c4"]), ("c6", "add", {"a": 2}, ["c5"]))),
        (1, 1, "tool", json.dumps({"tool_call_id": "c1", "content": "3"})),
        (1, 2, "tool", json.dumps({"tool_call_id": "c1", "content": "later"})),
        (1, 3, "tool", json.dumps({"tool_call_id": "nobody", "content": "x"})),
        (1, 4, "assistant", "{not json"),
        (None, None, None, None),
    ]
    got = {r["call_id"]: r for r in _link(spark, messages).collect()}
    assert {k: r["level"] for k, r in got.items()} == {"c1": 0, "c2": 1, "c3": 2, "c4": None, "c5": None, "c6": None}
    assert [got[c]["valid"] for c in ("c1", "c2", "c3", "c4", "c5")] == [True, False, False, False, True]
    assert got["c1"]["linked"] and got["c1"]["result_turn"] == 1 and not got["c2"]["linked"]
    assert json.loads(got["c1"]["record"]) == {"arguments": '{"a":1,"b":2}', "call_id": "c1", "name": "add", "result": "3"}


def test_a_long_chain_of_calls(spark):
    calls = spark.range(300).select(F.concat(F.lit("k"), "id").alias("call_id"), F.array(F.concat(F.lit("k"), F.col("id") - 1)).alias("depends_on"))
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(calls).collect()}
    assert got == {f"k{i}": i for i in range(300)}


def slow_levels(needs):
    """Levels by walking; None on or behind a cycle."""
    known = {}

    def level(c, path):
        if c not in known:
            if c in path:
                return None
            below = [level(n, path | {c}) for n in needs[c] if n in needs]
            if None in below:
                return None
            known[c] = 1 + max(below, default=-1)
        return known[c]

    return {c: level(c, frozenset()) for c in needs}


@pytest.mark.parametrize("seed", range(3))
def test_levels_of_random_graphs(spark, seed):
    rng = random.Random(seed)
    needs = {f"c{i}": [f"c{j}" for j in rng.sample(range(i), min(i, rng.randrange(4)))] for i in range(60)}
    for i in range(0, 60, 20) if seed == 2 else ():  # cycles
        needs[f"c{i}"].append(f"c{min(59, i + rng.randrange(1, 9))}")
    needs["c5"].append("nobody")
    calls = spark.createDataFrame([(c, n, rng.randrange(60)) for c, n in needs.items()], "call_id string, depends_on array<string>, turn int")
    assert {r["call_id"]: r["level"] for r in toolcalls.levels(calls).collect()} == slow_levels(needs)


def test_a_deep_chain_with_two_needs_each_takes_few_tables(spark, monkeypatch):
    tables = []
    monkeypatch.setattr(toolcalls, "cut", lambda df, label, cut=toolcalls.cut: tables.append(label) or cut(df, label))
    k = lambda i: F.concat(F.lit("k"), F.lpad(i.cast("string"), 4, "0"))
    calls = spark.range(1000).select(k(F.col("id")).alias("call_id"), F.array(k(F.col("id") - 1), k(F.col("id") - 2)).alias("depends_on"), F.col("id").alias("turn"))
    got = {r["call_id"]: r["level"] for r in toolcalls.levels(calls).collect()}
    assert got == {f"k{i:04d}": i for i in range(1000)}
    assert len(tables) < 25


def test_identifiers_count_within_their_conversation(spark):
    messages = []
    for conv in (1, 2):
        messages += [(conv, 0, "assistant", _asked(("call_0", "add", {"a": conv}, []), ("call_1", "add", {"a": 1}, ["call_0"] if conv == 1 else []))), (conv, 1 + conv, "tool", json.dumps({"tool_call_id": "call_0", "content": f"r{conv}"}))]
    messages.append((None, 0, "assistant", _asked(("call_0", "add", {"a": 9}, []))))
    got = {(r["conv_id"], r["call_id"]): (r["level"], r["result_turn"], json.loads(r["record"]).get("result")) for r in _link(spark, messages).collect()}
    assert got == {(1, "call_0"): (0, 2, "r1"), (1, "call_1"): (1, None, None), (2, "call_0"): (0, 3, "r2"), (2, "call_1"): (0, None, None), (None, "call_0"): (None, None, None)}


def test_declared_schemas(spark):
    tools = {"tools": [{"type": "function", "function": {"name": "find", "parameters": {"type": "object", "properties": {"q": {"type": "string"}, "n": {"type": "integer"}, "x": {"type": "number"}}, "required": ["q"]}}}]}
    asked = [("1", {"q": "a", "n": 2, "x": 1.5}), ("2", {"n": 2}), ("3", {"q": 1}), ("4", {"q": "a", "n": "b"}), ("5", {"q": "a", "other": []}), ("6", ["q"])]
    rows = [(1, 0, "system", json.dumps(tools)), (1, 1, "assistant", _asked(*[(i, "find", a, []) for i, a in asked])), (2, 0, "assistant", _asked(("7", "find", {"q": "a"}, [])))]
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    out = toolcalls.link(toolcalls.messages_to_calls(df), toolcalls.messages_to_results(df), CALL_SCHEMAS, toolcalls.messages_to_schemas(df))
    assert {r["call_id"]: r["valid"] for r in out.collect()} == {"1": True, "2": False, "3": False, "4": False, "5": True, "6": False, "7": False}


def test_tool_calls_with_columns_of_any_name(spark):
    df = spark.createDataFrame([(1, 0, "assistant", _asked(("c", "add", {"a": 1}, []))), (1, 1, "tool", json.dumps({"tool_call_id": "c", "content": "2"}))], "conv_id long, turn long, role string, text string")
    names = ["level", "r", "valid", "linked", "record", "_call", "_kinds", "_types", "_required", "types", "required", "result", "result_turn"]
    more = lambda x, own=(): x.select("*", *[F.lit("z").alias(n) for n in names if n not in own])
    parts = toolcalls.messages_to_calls(df), toolcalls.messages_to_results(df), toolcalls.messages_to_schemas(df)
    plain = toolcalls.link(parts[0], parts[1], CALL_SCHEMAS, parts[2])
    got = toolcalls.link(more(parts[0]), more(parts[1], ("result", "result_turn")), CALL_SCHEMAS, more(parts[2], ("types", "required")))
    assert got.columns == plain.columns and got.collect() == plain.collect()
    checked = toolcalls.validated(more(parts[0]), CALL_SCHEMAS, more(parts[2], ("types", "required"))).first()
    assert checked["valid"] is True and all(checked[n] == "z" for n in names if n != "valid")


def test_tool_calls_take_anything_and_stay_native(spark):
    df = spark.createDataFrame([(1, 0, "user", None), (1, 0, "user", None), (1, 1, "assistant", None), (2, None, "user", "x"), (None, 1, "user", "y"), (3, 0, None, "z")], "conv_id long, turn long, role string, text string")
    out = toolcalls.link(toolcalls.messages_to_calls(df), toolcalls.messages_to_results(df), [toolcalls.REPLY], toolcalls.messages_to_schemas(df))
    assert out.count() == 4 and out.where("linked").count() == 2
    none = df.limit(0)
    assert toolcalls.link(toolcalls.messages_to_calls(none), toolcalls.messages_to_results(none), [toolcalls.REPLY]).count() == 0
    assert "Python" not in out._jdf.queryExecution().toString()


# The pipeline


def test_pipeline_stages(spark, texts):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality", "near_dedup", "decontamination", "pii", "sentencepiece"]
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF)
        assert out.columns == docs.columns
        out.write.mode("overwrite").parquet(place := f"{spark.conf.get('spark.checkpoint.dir')}/{name}")
        docs = spark.read.parquet(place)
    assert docs.count() == docs.select("doc_id").distinct().count() > 0
    assert docs.where("n_chars <> length(text)").count() == 0
    assert corpus_pipeline.run(spark, SF).where("not round_trip").count() == 0
