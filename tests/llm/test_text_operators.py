import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from hypothesis import given, settings, strategies as st
from pyspark.sql import functions as F

from riverdeck.llm import decontaminate, licenses, pii, quality, simhash
from tests.llm.helpers import LONG, awkward, empty, labels
from tests.oracle import duck_rows, spark_rows

SF = "/root/testdata/sf0.001"
SPACE = re.compile(r"[^\x20\x09-\x0D]+")
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(t):
    return (t or "").translate({c: c + 32 for c in range(65, 91)})


@pytest.fixture(scope="module")
def texts(spark):
    return [(r[0], r[1]) for r in spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()]


# Quality rules


def slow_base(t):
    t = t or ""
    w = SPACE.findall(t)
    lines = [x for x in t.split("\n") if SPACE.search(x)]
    seen, dup = set(), 0
    for x in lines:
        dup += x in seen
        seen.add(x)
    windows = [tuple(w[i : i + 3]) for i in range(len(w) - 2)]
    hit = {i + d for i, x in enumerate(windows) if windows.count(x) > 1 for d in range(3)} if len(windows) < 3000 else None
    return len(w), sum(map(len, w)), sum(c in "#*$%&|<>" for c in t), dup, None if hit is None else len(hit)


def test_quality_base_counts(spark, texts):
    model = quality.QualityModel(quality.QualityParams(), np.zeros(1 << 16, np.float32), 0.0)
    docs = spark.createDataFrame(texts, "doc_id long, text string").unionByName(awkward(spark).select("doc_id", "text"))
    for r in quality.score(docs, model).collect():
        want = slow_base(r["text"])
        assert (r["n_words"], r["word_chars"], r["n_symbols"], r["n_dup_lines"]) == want[:4]
        assert want[4] is None or r["n_repeat_words"] == want[4]
        assert r["base_failed"] == (want[0] < 50 or 100 * r["n_repeat_words"] > 50 * want[0])
        assert not (r["base_failed"] and r["kept"])


@settings(max_examples=60, deadline=None)
@given(st.lists(st.sampled_from("a b c d".split()), max_size=40))
def test_repeated_windows(words):
    seen = {w: i for i, w in enumerate("abcd")}
    ids = np.array([seen[w] for w in words], np.int64)
    got = quality._repeats(ids, np.zeros(len(ids), np.int64), 1)[0]
    assert got == slow_base(" ".join(words))[4]


def test_quality_keeps_good_and_drops_junk(spark):
    rng = random.Random(5)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(300)]
    good = [" ".join(rng.choices(vocabulary, k=120)) for _ in range(150)]
    junk = [" ".join(f"{w.upper()}!!" for w in rng.choices(vocabulary, k=120)) for _ in range(30)]
    docs = spark.createDataFrame(list(enumerate(good + junk)), "doc_id long, text string")
    labelled = labels(spark, [(i, 1, 0) for i in range(0, 150, 2)] + [(150 + i, 0, 0) for i in range(5)])
    model = quality.fit(spark, docs, labelled)
    kept = {r["doc_id"] for r in quality.score(docs, model).where("kept").collect()}
    assert len(kept & set(range(150))) >= 147 and not kept & set(range(150, 180))


def slow_quality(docs, good, half, p):
    """llr and verdict of each text in plain loops; good: doc_id -> label, half: doc_id -> 0 (target) or 1 (threshold)."""
    word = (1 << 64) - 1

    def mix(x):
        x = (x ^ x >> 30) * 0xBF58476D1CE4E5B9 & word
        x = (x ^ x >> 27) * 0x94D049BB133111EB & word
        return x ^ x >> 31

    def shape(w):
        out = []
        for c in w:
            c = "a" if chr(c).islower() and c < 128 or c >= 128 else "A" if 65 <= c <= 90 else "0" if 48 <= c <= 57 else chr(c)
            if not out or out[-1] != c:
                out.append(c)
        return "".join(out).encode()

    def grams(t):
        words = (t or "").encode().split()
        a, s = [mix(zlib.crc32(w.lower())) for w in words], [mix(zlib.crc32(shape(w)) + (1 << 40)) for w in words]
        k, mask, out = 0x9E3779B97F4A7C15, p.buckets - 1, []
        for i in range(len(words)):
            before, shape_before = (a[i - 1], s[i - 1]) if i else (1, 2)
            out += [a[i] & mask, ((before * k + a[i]) * k & word) >> 40 & mask, ((shape_before * k + s[i]) * k & word) >> 40 & mask]
        return out

    raw, target = Counter(), Counter()
    for d, t in docs:
        raw.update(grams(t))
        if good.get(d) == 1 and half[d] == 0:
            target.update(grams(t))
    all_raw, all_target = sum(raw.values()), sum(target.values())

    def weight(b):
        p_raw = (raw[b] + 1) / (all_raw + p.buckets)
        return math.log((target[b] + p.prior * p.buckets * p_raw) / (all_target + p.prior * p.buckets) / p_raw)

    llr = [sum(map(weight, g)) / max(1, len(g)) for g in (grams(t) for _, t in docs)]
    failed = [(n := slow_base(t)[0]) < p.min_words or 100 * slow_base(t)[4] > p.max_repeat_percent * n for _, t in docs]
    scores = {k: sorted(x for (d, _), x, f in zip(docs, llr, failed) if not f and half.get(d) == 1 and good.get(d) == k) for k in (0, 1)}
    low = scores[1][int(p.quantile * len(scores[1]))]
    high = scores[0][min(len(scores[0]) - 1, int(p.junk_quantile * len(scores[0])))]
    threshold = (low + high) / 2 if high < low else low
    return llr, [not f and x >= threshold for x, f in zip(llr, failed)]


def test_quality_scores_equal_brute_force(spark):
    rng = random.Random(8)
    vocabulary = ["".join(rng.choices("abcdefgh", k=5)) for _ in range(60)]
    make = lambda bad: " ".join((w.upper() + "!!9" if rng.random() < bad else w.capitalize() if rng.random() < 0.1 else w) for w in rng.choices(vocabulary, k=rng.randrange(40, 90)))
    rows = [(i, make(0.7 if i % 5 == 0 else 0.05)) for i in range(120)] + [(200, None), (201, "ß Ünï 12a b3"), (3, make(0.3))]
    good = {i: int(i % 5 > 0) for i in range(0, 120, 2)}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    params = quality.QualityParams(buckets=1 << 12, quantile=0.05)
    model = quality.fit(spark, docs, labels(spark, [(i, y, 0) for i, y in good.items()]), params)
    halves = spark.createDataFrame([(i,) for i in good], "doc_id long").select("doc_id", F.pmod(F.xxhash64(F.lit("half"), "doc_id"), F.lit(2)).alias("half"))
    llr, kept = slow_quality(rows, good, dict(map(tuple, halves.collect())), params)
    got = sorted((r["doc_id"], r["text"] or "", r["llr"], r["kept"]) for r in quality.score(docs, model).collect())
    want = sorted((d, t or "", x, k) for (d, t), x, k in zip(rows, llr, kept))
    assert [g[:2] for g in got] == [w[:2] for w in want] and [g[3] for g in got] == [w[3] for w in want]
    assert [g[2] for g in got] == pytest.approx([w[2] for w in want], abs=2e-5)
    assert 20 < sum(kept) < 120


def test_quality_takes_anything(spark):
    model = quality.fit(spark, awkward(spark), labels(spark))
    out = quality.score(awkward(spark), model)
    assert out.count() == awkward(spark).count() and out.where("KEPT is null").count() == 0
    assert quality.score(empty(spark), quality.fit(spark, empty(spark), labels(spark))).count() == 0


# SimHash


def slow_fingerprint(t):
    w = SPACE.findall(lower(t))
    if not w:
        return 0
    s = [" ".join(w[i : i + 4]) for i in range(max(1, len(w) - 3))]
    h = [xxhash.xxh64_intdigest(x.encode(), seed=42) for x in s]
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def slow_components(values, radius=4):
    """value -> smallest value reachable."""
    values = sorted(set(values))
    root = {v: v for v in values}

    def find(v):
        while root[v] != v:
            v = root[v]
        return v

    for i, a in enumerate(values):
        for b in values[:i]:
            if (a ^ b).bit_count() <= radius:
                x, y = sorted((find(a), find(b)))
                root[y] = x
    return {v: find(v) for v in values}


def test_fingerprints(texts):
    raw = [t for _, t in texts] + [None, "", "one", "one two three", "one two three four", LONG]
    got = simhash.fingerprints([(t or "").encode() for t in raw])
    assert [int(x) for x in got] == [slow_fingerprint(t) for t in raw]


def test_near_duplicates(spark, texts):
    rows = texts + [(1000, None), (1001, ""), (None, texts[0][1]), (999, texts[3][1]), (texts[5][0], texts[5][1])]
    got = simhash.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert len(got) == len(rows)
    fps = {d: slow_fingerprint(t) for d, t in rows}
    roots = slow_components([slow_fingerprint(t) for _, t in rows])
    first = {}
    for d, t in rows:
        if d is not None:
            r = roots[slow_fingerprint(t)]
            first[r] = min(d, first.get(r, d))
    for r in got:
        if r["doc_id"] is not None:
            assert r["fingerprint"] == f"{fps[r['doc_id']]:016x}"
        assert r["component_id"] == first[roots[int(r["fingerprint"], 16)]]


def clustered(seed, n=1500):
    rng = random.Random(seed)
    centers = [rng.getrandbits(64) for _ in range(40)]
    out = set()
    for _ in range(n):
        v = rng.choice(centers)
        for _ in range(rng.randrange(7)):
            v ^= 1 << rng.randrange(64)
        out.add(v)
    chain = rng.getrandbits(64)
    for i in range(64):  # a long chain: neighbours differ in four bits
        chain ^= sum(1 << b for b in rng.sample(range(64), 4))
        out.add(chain)
    return sorted(out)


def test_tree_finds_what_brute_force_finds():
    values = np.array(clustered(1), np.uint64)
    found = set()
    tree = simhash.BKTree(values)
    measured = tree.search(values, 4, lambda i, near: found.update((int(j), i) for j in near))
    near = np.bitwise_count(values[:, None] ^ values[None, :]) <= 4
    assert found == {(int(i), int(j)) for i, j in zip(*near.nonzero())}
    assert measured < len(values) ** 2 / 2
    for node, children in enumerate(tree.children):  # a child lies at the distance that its key says
        for key, child in children:
            assert (values[tree.pivot[node]] ^ values[tree.pivot[child]]).bit_count() == key


def test_shards_of_real_texts_are_searched_through_inner_nodes(spark):
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet")
    nodes = simhash.with_fingerprint(docs.select("doc_id", "text"), "fp").select("fp").distinct()
    shards = {}
    for k, shard, fp in simhash.sharded(simhash.cut(nodes, "nodes"), 4, 1024).collect():
        shards.setdefault((k, shard), []).append(fp)
    assert len(shards) >= 30 and min(map(len, shards.values())) > 400
    for fps in list(shards.values())[:5]:
        values = np.sort(np.array(fps, np.int64).view(np.uint64))
        tree, reached = simhash.BKTree(values), []
        measured = tree.search(values, 4, lambda i, near: reached.append(i))
        inner = [i for i, c in enumerate(tree.children) if c]
        assert len(tree.pivot) == len(values) and len(inner) > 100 and max(len(c) for c in tree.children) > 10
        assert sorted(reached) == list(range(len(values))) and measured < 0.6 * len(values) ** 2


def test_links_and_classes(spark):
    values = clustered(2)
    want = slow_components(values)
    signed = lambda v: v - (1 << 64) if v >> 63 else v
    nodes = spark.createDataFrame([(signed(v),) for v in values], "fp long")
    for shard_rows, most in ((1024, 8192), (100, 8192), (1024, 50)):  # one shard, many shards, large shards split
        got = {r["fp"]: r["root"] for r in simhash.classes(simhash.link_edges(nodes, 4, shard_rows, most)).collect()}
        groups = {}
        for v in values:
            groups.setdefault(want[v], set()).add(got.get(signed(v), signed(v)))
        assert all(len(g) == 1 for g in groups.values())
        assert len({next(iter(g)) for g in groups.values()}) == len(groups)


def test_long_chain_settles(spark):
    edges = spark.range(700).select(F.col("id").alias("a"), (F.col("id") + 1).alias("b"))
    got = simhash.classes(edges)
    assert got.count() == 701 and got.select("root").distinct().count() == 1


def test_simhash_takes_anything(spark):
    assert simhash.near_duplicates(awkward(spark)).count() == awkward(spark).count()
    assert simhash.near_duplicates(empty(spark)).count() == 0


# Decontamination


def slow_contamination(t, items):
    w = WORD.findall(lower(t))
    hit, found = set(), set()
    for item, x in items:
        v = WORD.findall(lower(x))
        n = min(13, len(v))
        for s in {tuple(v[i : i + n]) for i in range(len(v) - n + 1)} if n else ():
            for i in range(len(w) - n + 1):
                if tuple(w[i : i + n]) == s:
                    hit.update(range(i, i + n))
                    found.add(item)
    return len(w), len(hit), found


def contaminated_rows(seed=3):
    rng = random.Random(seed)
    vocabulary = "the of and to in a is it he was ß".split()
    item = lambda n: " ".join(rng.choices(vocabulary, k=n))
    items = [(i, item(rng.choice([1, 3, 5, 14, 20, 40]) if i else 30)) for i in range(12)] + [(20, None), (21, "..."), (None, item(20)), (3, item(15))]
    docs = []
    for i in range(60):
        parts = [item(rng.randrange(30))]
        for _ in range(rng.randrange(3)):
            w = rng.choice([x for _, x in items if x]).split()
            a = rng.randrange(len(w))
            parts += [" ".join(w[a : a + rng.randrange(1, 30)]).upper() + "!", item(rng.randrange(10))]
        docs.append((i, "\n".join(parts)))
    return docs, items


def test_decontamination_matches_brute_force(spark):
    docs, items = contaminated_rows()
    bench = spark.createDataFrame(items, "item_id long, text string")
    rows = spark.createDataFrame(docs, "doc_id long, text string")
    known = [(i, x) for i, x in items if i is not None and x is not None]
    # One automaton; several in a pass, long items in pieces; as many passes.
    for shard, together in ((1 << 20, 64 << 20), (200, 64 << 20), (200, 1)):
        built = decontaminate.automata(bench, 13, shard)
        assert (built.count() > 2) == (shard == 200) and (len(decontaminate._passes(built, together)) > 2) == (together == 1)
        for r in decontaminate.find(rows, bench, shard_bytes=shard, pass_bytes=together).collect():
            n, hit, found = slow_contamination(r["text"], known)
            assert (r["n_words"], r["n_hit"], set(r["items"]), r["n_items"]) == (n, hit, found, len(found))
            assert r["contaminated"] == (hit > 0 and 20 * hit >= n)


def test_automata_are_bounded(spark):
    """An item far over a shard is cut into pieces that overlap; automata take a small multiple of their shard."""
    rng = random.Random(1)
    words = [f"w{rng.randrange(500)}" for _ in range(20000)]
    bench = spark.createDataFrame([(1, " ".join(words)), (2, " ".join(words))], "item_id long, text string")
    built = decontaminate.automata(bench, 13, 1 << 13)
    sizes = [r["size"] for r in built.select("size").collect()]
    assert len(sizes) > 5 and max(sizes) < (2 << 20) + 60 * (1 << 13)
    docs = spark.createDataFrame([(i, " ".join(words[a : a + 13])) for i, a in enumerate(range(0, 19987, 97))], "doc_id long, text string")
    got = decontaminate.find(docs, bench, shard_bytes=1 << 13).select("n_hit", "items").collect()
    assert all(r["n_hit"] == 13 and r["items"] == [1, 2] for r in got)


def test_decontamination_equals_sql(spark):
    from riverdeck.llm import queries

    assert spark_rows(queries.op5_decontamination(spark, SF)) == duck_rows(queries.ORACLES["op5_decontamination"])


def test_strip_cuts_exactly_the_hit_words(spark):
    docs, items = contaminated_rows(8)
    bench = spark.createDataFrame(items, "item_id long, text string")
    found = decontaminate.find(spark.createDataFrame(docs, "doc_id long, text string"), bench)
    before = {r["doc_id"]: r for r in found.collect()}
    for r in decontaminate.strip(found).collect():
        b = before[r["doc_id"]]
        words = WORD.findall(lower(b["text"]))
        hit = {i for a, z in zip(b["spans"][::2], b["spans"][1::2]) for i in range(a, z)}
        # Words around a cut may touch afterwards, so their joined letters are compared.
        assert "".join(WORD.findall(lower(r["text"]))) == "".join(w for i, w in enumerate(words) if i not in hit)


def test_decontamination_takes_anything(spark):
    bench = spark.createDataFrame([(1, "lorem ipsum"), (None, None)], "item_id long, text string")
    out = decontaminate.find(awkward(spark), bench)
    assert out.count() == awkward(spark).count() and out.where("doc_id = 1").first()["n_words"] == 0
    assert decontaminate.find(empty(spark), bench).count() == 0
    assert decontaminate.find(awkward(spark), bench.limit(0)).where("n_hit > 0").count() == 0
    clash = spark.createDataFrame([("lorem ipsum", "a", "b", "c")], "text string, items string, _found string, _stripped string")
    out = decontaminate.strip(decontaminate.find(clash, bench))
    assert out.select("text", "_found", "_stripped", "items").first() == ("", "b", "c", [1])


def test_item_ids_of_any_type(spark):
    bench = spark.createDataFrame([("q-1", "lorem ipsum"), ("q-2", "lorem ipsum"), ("q-3", "nothing of it"), (None, "dolor")], "item_id string, text string")
    for pass_bytes in (1, 64 << 20):
        out = decontaminate.find(awkward(spark), bench, shard_bytes=8, pass_bytes=pass_bytes)
        assert {r["doc_id"]: r["items"] for r in out.collect() if r["n_items"]} == {5: ["q-1", "q-2"]}
    numbers = bench.withColumn("item_id", F.substring("item_id", 3, 9).cast("int"))
    assert decontaminate.find(awkward(spark), numbers).where("n_items > 0").first()["items"] == [1, 2]


# Personal data


def luhn(d):
    return sum(sum(divmod(int(c) * (2 if i % 2 else 1), 10)) for i, c in enumerate(reversed(d))) % 10 == 0


def slow_pii(t):
    t = t or ""
    kinds = [
        ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", lambda s: True),
        ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", lambda s: all(int(p) <= 255 for p in s.split("."))),
        ("card", r"[0-9]([\x20-]?[0-9])+", lambda s: 12 <= len(re.sub("[^0-9]", "", s)) <= 19 and luhn(re.sub("[^0-9]", "", s))),
        ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", lambda s: 9 <= len(re.sub("[^0-9]", "", s)) <= 15),
    ]
    found = [(m.start(), i, k, m.end()) for i, (k, p, ok) in enumerate(kinds) for m in re.finditer(p, t) if ok(m[0])]
    return ",".join(f"{k}:{a}:{b}" for a, _, k, b in sorted(found))


TRICKY = [
    "a@b.com_x@y.org", "a@b.c.d.e@f.g", "x@y", "@a.b", "a@b.com.", "1.2.3.4.5.6.7.8", "256.1.1.1 010.020.030.040 1.2.3", "00000000001.2.3.4", "4111 1111 1111 1111", "4111-1111-1111-1112",
    "4111  1111 1111 1111", "1 4111111111111111", "41111111111111111111111", "0 0 0 0 0 0 0 0 0 0 0 0", "5-500000000000004", "+1 (988) 555-2485", "+1234567", "+123456789012345678", "++1 234 567 89", "+1 ((((((", "tel +49.30.123456-7.",
    "日本 a@b.co €4111111111111111 ü+49 30 1234567", "GB82 WEST 1234 5698 7654 32", "GB82WEST12345698765433 DE89370400440532013000", "9" * 3000, "a." * 2000 + "@x.y", "1-" * 5000 + "1",
]


def test_pii_matches_plain_expressions(spark, texts):
    docs = spark.createDataFrame([*texts, *[(5000 + i, t) for i, t in enumerate(TRICKY)], (6000, None), (6001, "")], "doc_id long, text string")
    slow = {d: slow_pii(t) for d, t in [*texts, *[(5000 + i, t) for i, t in enumerate(TRICKY)], (6000, None), (6001, "")]}
    for r in pii.report(docs).collect():
        base = ",".join(x for x in r["spans"].split(",") if not x.startswith("iban"))
        assert base == slow[r["doc_id"]]
        assert r["base_sha256"] == hashlib.sha256(slow[r["doc_id"]].encode()).hexdigest()
        assert r["n_email"] == slow[r["doc_id"]].count("email:")


@settings(max_examples=25, deadline=None)
@given(st.lists(st.text(alphabet="a1 .-+@(5é", max_size=40), min_size=20, max_size=20))
def test_pii_on_random_texts(spark, rows):
    docs = spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")
    for r in pii.report(docs).collect():
        assert r["base_sha256"] == hashlib.sha256(slow_pii(rows[r["doc_id"]]).encode()).hexdigest()


def test_many_spans_in_a_long_text(spark):
    """Over several runs of spans and pieces of text, with a context word at every third span."""
    parts = [f"é{'mail ' if i % 3 == 0 else 'zzzz '}x{i}@b.co 1.2.3.{i % 300} {'y' * (60 + i % 50)}" for i in range(1500)]
    long = " ".join(parts)
    r = pii.report(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()
    assert r["spans"] == slow_pii(long) and r["n_email"] == 1500
    spans = pii.find(spark.createDataFrame([(1, long)], "doc_id long, text string")).first()["pii"]
    want = [pii.WITH_CONTEXT if re.search(rf"\b(?:{pii.CONTEXT[s['kind']]})", long[max(0, s["start"] - pii.NEAR) : s["start"]].lower() + " " + long[s["end"] : s["end"] + pii.NEAR].lower()) else pii.PLAIN for s in spans]
    assert [s["score"] for s in spans] == want and set(want) == {pii.PLAIN, pii.WITH_CONTEXT}


def test_iban_and_context(spark):
    docs = spark.createDataFrame([(1, "my bank account GB82 WEST 1234 5698 7654 32 ok"), (2, "GB82WEST12345698765433"), (3, "x 4111111111111111"), (4, "credit card 4111111111111111")], "doc_id long, text string")
    got = {r["doc_id"]: r for r in pii.report(docs).collect()}
    assert got[1]["n_iban"] == 1 and got[2]["n_iban"] == 0
    rows = ["IBAN DE89 3704 0044 0532 0130 00 BIC COBADEFF", "DE89370400440532013000 NOW", "xDE89370400440532013000", "DE893704004405320130001", "NO93 8601 1117 947, FR14 2004 1010 0505 0001 3M02 606 ZZ11"]
    spans = {r["doc_id"]: r["spans"] for r in pii.report(spark.createDataFrame(list(enumerate(rows)), "doc_id long, text string")).collect()}
    found = {d: [rows[d][int(a) : int(b)] for k, a, b in (x.split(":") for x in s.split(",") if x) if k == "iban"] for d, s in spans.items()}
    assert found == {0: ["DE89 3704 0044 0532 0130 00"], 1: ["DE89370400440532013000"], 2: [], 3: [], 4: ["NO93 8601 1117 947", "FR14 2004 1010 0505 0001 3M02 606"]}
    assert got[3]["score"] == pii.PLAIN and got[4]["score"] == got[1]["score"] == pii.WITH_CONTEXT


def test_redaction(spark):
    docs = spark.createDataFrame([(1, "write a@b.com or +1 (988) 555-2485."), (2, None), (3, "é 1.2.3.4 é"), (4, "plain")], "doc_id long, text string")
    got = {r["doc_id"]: r["text"] for r in pii.redact(docs).collect()}
    assert got == {1: "write [EMAIL] or [PHONE].", 2: None, 3: "é [IP] é", 4: "plain"}
    clash = spark.createDataFrame([("a@b.com", "p", "e", "i", "q")], "text string, pii string, _email string, _iban string, _pii string")
    assert pii.redact(clash).collect() == [("[EMAIL]", "p", "e", "i", "q")]
    assert [s["kind"] for s in pii.find(clash).first()["pii"]] == ["email"]


def test_pii_stays_native(spark):
    plan = pii.report(awkward(spark).select("doc_id", "text"))._jdf.queryExecution().toString()
    assert not re.search("Python|Pandas|Arrow", plan)
    assert pii.report(awkward(spark)).count() == awkward(spark).count() and pii.report(empty(spark)).count() == 0


# Licenses


def slow_licenses(t):
    w = WORD.findall(lower(t))
    places = [(i, label) for phrase, label in licenses.BASE.items() for p in [phrase.split()] for i in range(len(w) - len(p) + 1) if w[i : i + len(p)] == p]
    starts = [i for i, _ in places]
    return len(w), len(places), min(starts, default=None), max(starts, default=None), ",".join(sorted({x for _, x in places}))


LICENSED = ["MIT License, Apache\nLicense; cc-by cc by GNU general-public  license", "mit licenses smit license", "cc by by cc by", "gnu gnu general public license license", "xapache license", "Apache  License MIT License"]


def test_license_places(spark, texts):
    rows = [*texts, *[(5000 + i, t) for i, t in enumerate(LICENSED)], (6000, None), (6001, "")]
    for r in licenses.scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        assert (r["n_words"], r["n_base"], r["first_word"], r["last_word"], r["base_labels"]) == slow_licenses(r["text"])
        assert 0 <= r["score"] <= 1 and set(filter(None, r["base_labels"].split(","))) <= set(r["labels"].split(","))


def slow_terms(line):
    """By recursive descent over a whole well-formed expression: (level, identifiers)."""
    parts = re.findall(r"[()]|[^\s()]+", line.lower())

    def either(level=0):
        if level == 2:
            if parts[0] == "(":
                parts.pop(0)
                got = either()
                assert parts.pop(0) == ")"
                return got
            name = parts.pop(0)
            at = licenses.listed(name)
            at = 4 if at is None else at
            if parts and parts[0] == "with":
                parts.pop(0)
                with_ = parts.pop(0)
                return (max(0, at - 1) if at < 4 and with_ in licenses.EXCEPTIONS else at), {f"{name} with {with_}"}
            return at, {name}
        got = either(level + 1)
        while parts and parts[0] == ("or", "and")[level]:
            parts.pop(0)
            more = either(level + 1)
            got = (min, max)[level](got[0], more[0]), got[1] | more[1]
        return got

    got = either()
    assert not parts
    return got


_ids = st.sampled_from(["MIT", "GPL-2.0-only", "GPL-2.0-only WITH Classpath-exception-2.0", "MPL-2.0+", "Foo-1", "CC-BY-NC-4.0", "GPL-3.0 WITH Foo"])
_expressions = st.recursive(_ids, lambda x: st.tuples(x, st.sampled_from(["OR", "and"]), x).map(lambda t: f"({t[0]} {t[1]} {t[2]})") | st.tuples(x, st.sampled_from(["OR", "AND"]), x).map(" ".join), max_leaves=12)


@settings(max_examples=300, deadline=None)
@given(_expressions)
def test_expressions_equal_recursive_descent(line):
    level, names = licenses.evaluate(licenses.postfix(line))
    assert (level, set(names)) == slow_terms(line)


@pytest.mark.parametrize(
    "line, whole, start",
    [
        ("MIT", "mit", "mit"), ("MIT OR Apache-2.0 AND BSD-3-Clause", "mit apache-2.0 bsd-3-clause and or", "mit apache-2.0 bsd-3-clause and or"),
        ("MIT OR", None, "mit"), ("(MIT", None, None), ("MIT see LICENSE", None, "mit"), ("MIT, see", None, "mit"), ("MIT.", None, "mit"), ("AND", None, None), ("", None, None), ("MIT)", None, "mit"),
        ("(MIT OR ISC) WITH x", None, "mit isc or"), ("MIT */", None, "mit"), ("(MIT AND (ISC OR", None, None),
    ],
)
def test_longest_expression(line, whole, start):
    for want, got in ((whole, licenses.postfix(line)), (start, licenses.postfix(line, whole=False))):
        assert got == (want.split() if want else None)


def test_spdx_tags(spark):
    wide = " AND ".join(f"(A{i} OR MIT)" for i in range(40))  # 2 ** 40 choices
    lines = ["// SPDX-License-Identifier: MIT OR GPL-2.0-only\ncode", "SPDX-License-Identifier: MIT AND GPL-2.0-only\rx", "SPDX-License-Identifier: or", f"ü spdx-license-identifier:{wide}", "SPDX-License-Identifier: MIT, see LICENSE\n# SPDX-License-Identifier: MPL-2.0"]
    got = {r["doc_id"]: (r["labels"], r["terms"]) for r in licenses.scan(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()}
    assert got == {0: ("gpl-2.0-only,mit", "permissive"), 1: ("gpl-2.0-only,mit", "copyleft"), 2: ("unparsed", None), 3: ("mit,unlisted", "permissive"), 4: ("mit,mpl-2.0", "weak-copyleft")}


def test_licenses_take_anything(spark):
    assert licenses.scan(awkward(spark)).count() == awkward(spark).count() and licenses.scan(empty(spark)).count() == 0
