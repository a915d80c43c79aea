"""Periodic runs, spelling variants and substring dedup against plain loops."""

import random
import tracemalloc
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riverdeck.llm import periodic, queries, repeats, spelling
from tests.llm.helpers import awkward, empty
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


def split(text):
    return (text or "").encode().split()


@pytest.mark.parametrize("name", ["op11_periodic_runs", "op12_spelling_variants", "op13_substring_dedup"])
def test_same_rows_as_sql(spark, name):
    assert spark_rows(queries.QUERIES[name](spark, SF)) == duck_rows(queries.ORACLES[name])


# Periodic runs


def slow_runs(words, least=12):
    found = set()
    for q in range(1, len(words) // 2 + 1):
        i = 0
        while i + q < len(words):
            if words[i] != words[i + q]:
                i += 1
                continue
            end = i
            while end + q < len(words) and words[end] == words[end + q]:
                end += 1
            start, length = i, end - i + q
            smaller = any(all(words[j] == words[j + p] for j in range(start, start + length - p)) for p in range(1, q))
            if length >= max(least, 2 * q) and not smaller:
                found.add((start, length, q))
            i = end
    return sorted(found, key=lambda r: (r[0], r[2]))


@settings(max_examples=200, deadline=None)
@given(st.lists(st.integers(0, 2), max_size=70))
def test_runs_of_few_words(ids):
    assert periodic.find(np.array(ids, np.int64)) == slow_runs(ids)


@settings(max_examples=80, deadline=None)
@given(st.lists(st.tuples(st.lists(st.integers(0, 9), min_size=1, max_size=8), st.integers(1, 9)), max_size=8), st.integers(2, 14))
def test_runs_of_repeated_pieces(pieces, least):
    ids = [x for piece, times in pieces for x in piece * times]
    assert periodic.find(np.array(ids, np.int64), least) == slow_runs(ids, least)


def test_runs_of_long_periods():
    rng = random.Random(3)
    for period in (15, 16, 17, 40, 90):
        for _ in range(4):
            piece = [rng.randrange(30) for _ in range(period)]
            ids = [rng.randrange(30) for _ in range(25)] + (piece * 4)[: rng.randrange(2 * period - 2, 4 * period)] + [rng.randrange(30) for _ in range(25)]
            assert periodic.find(np.array(ids, np.int64)) == slow_runs(ids)


@pytest.mark.parametrize("heavy", [0, 3, 10**9])
def test_lag_counts_by_either_way(heavy):
    rng = np.random.default_rng(1)
    ids = np.minimum(rng.geometric(0.2, 900), 40)
    want = [0, *(int((ids[p:] == ids[:-p]).sum()) for p in range(1, 451))]
    assert periodic.lag_counts(ids, 450, heavy).tolist() == want


def test_one_word_a_hundred_thousand_times():
    assert periodic.find(np.zeros(100_000, np.int64)) == [(0, 100_000, 1)]


def test_runs_of_anything(spark):
    texts = ["a b c " * 9 + "d " * 20 + "end", "one two", "x " * 11, "x " * 12]
    docs = awkward(spark, texts)
    out = periodic.with_runs(docs.withColumn("RUNS", F.lit("theirs")))
    assert {"KEPT", "score", "n_words"} <= set(out.columns) and "RUNS" not in out.columns
    rows = out.collect()
    assert len(rows) == docs.count()
    for r in rows:
        words = split(r["text"])
        assert r["n_words"] == len(words)
        if len(words) > 1000:  # five words, again and again
            assert (r["start"], r["length"], r["period"], r["n_runs"]) == (0, len(words), 5, 1)
            assert r["collapsed"] == "lorem ipsum dolor sit amet"
            continue
        runs = slow_runs(words)
        assert [tuple(x) for x in r["runs"]] == runs and r["n_runs"] == len(runs)
        gone = {i for s, l, q in runs for i in range(s + q, s + l)}
        assert r["collapsed"].encode() == b" ".join(w for i, w in enumerate(words) if i not in gone)
        best = min(runs, key=lambda x: (-x[1], x[0], x[2]), default=(None,) * 3)
        assert (r["start"], r["length"], r["period"]) == best
        assert r["exponent_milli"] == (1000 * best[1] // best[2] if runs else None)
    assert periodic.with_runs(empty(spark)).count() == 0


def test_planted_runs(spark):
    import zlib

    rows = [(i, " ".join(f"w{j}" for j in range(n))) for i, n in zip(range(300), [0, 1, 2, 3, 12, 50, 400] * 50)] + [(None, "kept as it is"), (7, None)]
    out = queries.planted_runs(spark.createDataFrame(rows, "doc_id long, text string"))
    changed = 0
    for (doc, text), got in zip(rows, out.collect()):
        h, w = zlib.crc32(str(doc).encode()), (text or "").split()
        if doc is None or h % 10 or not w:
            assert got["text"] == text
            continue
        g, n = h // 10, len(w)
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        assert got["text"] == " ".join(w[i] if i < a else w[a + (i - a) % p] for i in range(n))
        changed += 1
    assert changed > 10


# Spelling variants


def near(u, v):
    if len(u) == len(v):
        return sum(a != b for a, b in zip(u, v)) == 1
    if len(u) > len(v):
        u, v = v, u
    return len(v) == len(u) + 1 and any(v[:i] + v[i + 1 :] == u for i in range(len(v)))


def slow_variants(counts):
    counts = {w: n for w, n in counts.items() if n >= 5 and len(w) >= 6}
    of = {w: [v for v in counts if v != w and near(w, v)] for w in counts}
    form = {}
    for w, others in of.items():
        best = min(others, key=lambda v: (-counts[v], v), default=None)
        form[w] = best if best is not None and counts[best] >= 5 * counts[w] else None
    out = []
    for w in counts:
        root = w
        while form[root] is not None:
            root = form[root]
        out.append((w, form[w], root, counts[w], len(of[w]), counts[form[w]] if form[w] else None))
    return sorted(out, key=str)


def check_variants(spark, counts):
    df = spark.createDataFrame(list(counts.items()), "word string, n long")
    assert sorted(map(tuple, spelling.variants(df).collect()), key=str) == slow_variants(counts)


def test_variants_equal_brute_force(spark):
    rng = random.Random(11)
    counts = {}
    for _ in range(25):
        base = "".join(rng.choice("abé") for _ in range(rng.randrange(6, 9)))
        for _ in range(12):
            w = list(base)
            for _ in range(rng.randrange(3)):
                at = rng.randrange(len(w))
                w[at : at + rng.randrange(2)] = rng.choice(["a", "b", "é", "ÿ", "", "aa"])
            counts["".join(w)] = rng.choice([1, 4, 5, 5, 6, 25, 25, 30, 125, 150, 700, 4000])
    check_variants(spark, counts)


def test_chains_double_letters_and_long_words(spark):
    counts = {f"chain{'x' * i}": 5 * 5 ** (9 - i) for i in range(10)}  # each form's form is the next
    counts |= {"aabbcc": 7, "aabbc": 900, "aabbbcc": 40, "aaabbcc": 40, "abbcc": 1000, "aabbcd": 35}
    long = "".join(random.Random(2).choice("abcdéf") for _ in range(3000))
    counts |= {long: 200, long[:-1]: 10, long[:9] + "z" + long[10:]: 10, long[:9] + "y" + long[10:]: 200, "q" + long: 5, "b" * 47: 5, "b" * 48: 30, "b" * 49: 200, "b" * 50: 1000, "é" * 24: 5, "é" * 25: 50}
    check_variants(spark, counts)


def test_colliding_keys_are_told_apart(spark, monkeypatch):
    real = spelling.deletion_keys
    monkeypatch.setattr(spelling, "deletion_keys", lambda codes: tuple(x % np.uint64(5) for x in real(codes)))
    check_variants(spark, {"".join(random.Random(i).choice("ab") for _ in range(7)): 5 + i * i for i in range(40)})


def test_deletion_keys_are_those_of_the_shorter_words():
    codes = np.array([[ord(c) for c in w] for w in ("dealer", "raiser")], np.uint64)
    keys, _ = spelling.deletion_keys(codes)
    for i in range(6):
        assert (keys[:, i] == spelling.deletion_keys(np.delete(codes, i, axis=1))[1]).all()


def test_counts_of_anything(spark):
    texts = ["Straße STRAßE straße", "café-Cafétéria CAFÉTÉRIA cafétéria's ×÷×÷×÷ x1y2 abcdefg", "İstanbul ābcdefgh"]
    docs = awkward(spark, texts)
    import re

    want = Counter()
    for r in docs.collect():
        low = (r["text"] or "").encode().lower().decode()
        want.update(w for w in re.findall("[A-Za-zÀ-ÿ]+", low) if len(w) >= 6)
    got = spelling.word_counts(docs)
    assert {r["word"]: r["n"] for r in got.collect()} == want
    assert spelling.word_counts(empty(spark)).count() == 0
    assert spelling.variants(spelling.word_counts(empty(spark))).count() == 0
    assert [tuple(r) for r in spelling.variants(spark.createDataFrame([("ß" * 6, 5)], "word string, n long")).collect()] == [("ß" * 6, None, "ß" * 6, 5, 0, None)]


def test_edited_words(spark):
    docs = spark.createDataFrame([(1, "sevens eights"), (1, "sevens"), (None, "eights")], "doc_id long, text string")
    got = spelling.word_counts(docs, lambda doc, word: word[1:] if doc == "" else word + doc)
    assert {r["word"]: r["n"] for r in got.collect()} == {"sevens1": 2, "eights1": 1}


# Substring dedup


def slow_removed(rows, window=13):
    first = {}
    for doc, text in rows:
        w = split(text)
        for i in range(len(w) - window + 1):
            k = tuple(w[i : i + window])
            if doc is not None and (k not in first or doc < first[k]):
                first[k] = doc
    out = []
    for doc, text in rows:
        w = split(text)
        gone = {i + d for i in range(len(w) - window + 1) for d in range(window) if doc is not None and first[tuple(w[i : i + window])] < doc}
        out.append((doc, len(w), len(gone), b" ".join(x for i, x in enumerate(w) if i not in gone).decode()))
    return sorted(out, key=str)


def check_removed(spark, rows, kind="long", **more):
    docs = spark.createDataFrame(rows, f"doc_id {kind}, text string")
    got = repeats.remove(docs, **more)
    assert sorted(map(tuple, got.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == slow_removed(rows)


def passages(seed, n=60, vocabulary=400):
    """Texts that share passages of 9 to 40 words, some of them repeated inside a text, copies, and texts of few words."""
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(vocabulary)]
    shared = [rng.choices(words, k=k) for k in (9, 12, 13, 14, 20, 40)]
    out = []
    for _ in range(n):
        w = []
        for _ in range(rng.randrange(5)):
            w += rng.choices(words, k=rng.randrange(20)) + rng.choice(shared) * rng.choice([1, 1, 2])
        out.append(rng.choice([" ", "\n", " \t "]).join(w))
    return out + out[:10] + ["a " * 30, "a " * 50, "a b " * 20]


@pytest.mark.parametrize("most", [1 << 16, 3, 0])
def test_removed_words_equal_brute_force(spark, most):
    rows = list(enumerate(passages(1)))
    random.Random(4).shuffle(rows)
    check_removed(spark, rows, most=most)


def test_removed_words_of_few_different_words(spark):
    rng = random.Random(8)
    check_removed(spark, [(i % 17, " ".join(rng.choices("ab", k=rng.randrange(40)))) for i in range(60)])


def test_removed_words_with_text_ids(spark):
    check_removed(spark, [(f"é{i}", t) for i, t in enumerate(passages(5, 25))], "string", most=5)


def test_removed_words_of_anything(spark):
    docs = awkward(spark, passages(2, 8))
    out = repeats.remove(docs.withColumn("_cuts", F.lit(1)).withColumn("tag", F.lit(2)).withColumn("found", F.lit(3)).withColumn("_of", F.lit(4)))
    assert {"KEPT", "score", "_cuts", "tag", "found", "_of"} - set(out.columns) == {"KEPT"}
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    assert sorted(map(tuple, out.select("doc_id", "n_words", "n_removed", "kept").collect()), key=str) == slow_removed(rows)
    assert repeats.remove(empty(spark)).count() == 0


def test_ids_that_repeat_and_missing_ids(spark):
    text = " ".join(f"t{i}" for i in range(30))
    check_removed(spark, [(None, text), (None, text), (5, text), (5, text), (5, text + " more"), (6, "x " + text), (None, "y " + text), (7, None)])


def test_passages_are_those_removed(spark):
    a = " ".join(f"t{i}" for i in range(40))
    docs = spark.createDataFrame([(1, a), (2, f"one two {a} three"), (3, " ".join(a.split()[:13] + ["x"] + a.split()[20:32]))], "doc_id long, text string")
    got = {r["doc_id"]: [tuple(p) for p in r["passages"]] for r in repeats.remove(docs).collect()}
    assert got == {1: [], 2: [(2, 40)], 3: [(0, 13)]}


def test_deep_nodes():
    suffixes = np.array([[1, 2], [3, 4], [1, 2], [1, 3], [1, 2]])
    order, first = repeats.deep_nodes(np.array([7, 7, 7, 7, 8]), suffixes)
    parts = [sorted(x.tolist()) for x in np.split(order, first[1:])]
    assert sorted(parts) == [[0, 2], [1], [3], [4]]


def test_a_task_turns_few_bytes_of_text_into_numbers_at_once():
    batch = pa.RecordBatch.from_arrays([pa.array([" ".join(f"w{i % 977}" for i in range(j, j + 500)) for j in range(2500)])], names=["text"])
    tracemalloc.start()
    windows = sum(len(words.anchors(13, 6)[0]) for _, words in repeats._slices([batch], "text"))
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert windows == 2500 * 488 and peak < 64 << 20
