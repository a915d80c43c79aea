"""The pipeline's near_dedup stage: classes of near copies against brute force, and the row that stays of each."""

import random

import pytest

import corpus_pipeline
from riverdeck.llm import jaccard

SF = "/root/testdata/sf0.001"
pytest.importorskip("public_tokenizers")


def shingle_set(text):
    w = (text or "").lower().split()
    return {tuple(w[i : i + 5]) for i in range(max(1, len(w) - 4))} if w else set()


def brute_classes(texts):
    sets = [shingle_set(t) for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            both = len(sets[i] & sets[j])
            if sets[i] == sets[j] or 5 * both >= 4 * (len(sets[i]) + len(sets[j]) - both) > 0:
                a, b = sorted((find(i), find(j)))
                root[b] = a
    return [find(i) for i in range(len(texts))]


def near_texts():
    """Families of texts with ever more words changed, so that similarities lie on both sides of 0.8 and chains arise."""
    rng = random.Random(5)
    vocabulary = [f"w{i}" for i in range(3000)]
    out = ["", " \n", "one two", "One  two", "one two three"]
    for _ in range(40):
        base = rng.choices(vocabulary, k=rng.choice([8, 60, 200, 400]))
        for changes in (0, 0, 1, 2, 4, 7, 8, 9, 12):
            words = list(base)
            for _ in range(changes):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
            if rng.random() < 0.5:
                base = words
    return out


def test_near_copies_equal_brute_force(spark):
    texts = near_texts()
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    want = brute_classes(texts)
    assert len(set(want)) < len(texts) - 100
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert sorted(r["doc_id"] for r in kept.collect()) == sorted(set(want))


def repeated_texts(times):
    """Pairs of a text and the same with a passage of it repeated, nearly equal as sets of shingles."""
    rng = random.Random(times)
    out = []
    for i in range(40):
        words = [f"p{i}w{rng.randrange(5000)}" for _ in range(300)]
        at = rng.randrange(280)
        out += [" ".join(words), " ".join(words[:at] + words[at : at + 20] * (times + 1) + words[at + 20 :])]
    return out


@pytest.mark.parametrize("times", [1, 3, 10, 30, 100])
def test_repeated_passages_are_near_copies(spark, times):
    texts = repeated_texts(times)
    want = brute_classes(texts)
    assert len(set(want)) == 40
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect()) == sorted(set(want))


def test_short_texts_and_long_families(spark):
    rng = random.Random(9)
    texts = []
    for i in range(150):  # sets of four to twelve shingles
        words = [f"s{i}x{j}" for j in range(rng.randrange(8, 17))]
        texts += [" ".join(words), " ".join([*words, f"end{i}"]), " ".join([f"start{i}", *words])]
    for i in range(4):  # 60 copies of a text, each with a few words of its own
        base = [f"f{i}y{j}" for j in range(500)]
        for _ in range(60):
            words = list(base)
            for _ in range(rng.randrange(1, 9)):
                words[rng.randrange(500)] = f"new{rng.randrange(10**9)}"
            texts.append(" ".join(words))
    want = brute_classes(texts)
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    assert sorted(r["doc_id"] for r in corpus_pipeline.near_dedup(spark, docs, None).collect()) == sorted(set(want))


def test_near_copies_of_nothing(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    assert jaccard.classes(jaccard.tagged(docs)).count() == 0
    assert corpus_pipeline.near_dedup(spark, docs, None).count() == 0


def test_rows_stay_whatever_their_doc_id(spark):
    long = " ".join(f"a{i}" for i in range(60))
    near = long.replace("a30", "changed") + " end"  # 51 of 61 shingles and more in common
    rows = [
        (None, "no id and no copy of it anywhere"),
        (None, "a copy of seven which has an id"),
        (7, "a copy of seven which has an id"),
        (None, "twice the same text without an id"),
        (None, "twice the same text without an id"),
        (8, long),
        (9, near),
        (9, "nine also names a text of its own"),
        (9, None),
        (10, "ten repeated as a whole row here"),
        (10, "ten repeated as a whole row here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = corpus_pipeline.near_dedup(spark, docs, None)
    assert kept.columns == docs.columns
    want = [rows[0], rows[2], rows[3], rows[5], rows[7], rows[8], rows[9]]
    assert sorted(map(tuple, kept.collect()), key=str) == sorted(want, key=str)
    blank = spark.createDataFrame([(4, None), (4, ""), (None, " ")], "doc_id long, text string")
    assert [tuple(r) for r in corpus_pipeline.near_dedup(spark, blank, None).collect()] == [(4, "")]


CLASHES = "pii _email _pii items spans _found contaminated kept llr n_words _row _text _set _fp _bands _corpus_pipeline_rest root order first".split()


@pytest.mark.parametrize("name, stage", corpus_pipeline.STAGES)
def test_stages_take_anything(spark, name, stage):
    """Nulls in any column, empty and very long texts, ties, repeated rows, columns named like what operators add, an empty table: rows come out whole."""
    real = [r[0] for r in spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 400").orderBy("doc_id").select("text").limit(6).collect()]
    item = spark.read.parquet(f"{SF}/benchmark.parquet").first()["text"]
    texts = [None, "", " \n\t ", "ß € 日本 \u0001 x", "word " * 40000, "y" * 30000, real[0], *real, f"{real[1]} a@b.com {item}", f"{real[2]} write to c@d.org " * 3, item]
    rows = [(i if i % 5 else None, t, "en" if i % 2 else None, None if t is None else len(t)) for i, t in enumerate(texts)]
    rows += [rows[7], rows[8], (1, None, None, None), (1, "a text of its own under a repeated id", None, None)]
    docs = spark.createDataFrame([(*r, *(f"{c}{i}" for c in CLASHES)) for i, r in enumerate(rows)], "doc_id long, text string, lang string, n_chars long, " + ", ".join(f"{c} string" for c in CLASHES))
    out = stage(spark, docs, SF)
    got = out.collect()
    if name == "sentencepiece":
        assert len(got) == len(rows) and all(r["round_trip"] for r in got)
        return
    assert out.schema.simpleString() == docs.schema.simpleString()
    before = {r["pii"]: r for r in docs.collect()}
    for r in got:
        own = before[r["pii"]]
        assert [r[c] for c in ("doc_id", "lang", *CLASHES)] == [own[c] for c in ("doc_id", "lang", *CLASHES)]
        if name in ("quality", "near_dedup"):
            assert r == own
        assert (r["text"] is None) == (own["text"] is None) and r["n_chars"] == (None if r["text"] is None else len(r["text"])) or name in ("quality", "near_dedup")
    kept = sorted(int(r["pii"][3:]) for r in got)
    texts = [r[1] for r in rows]
    if name == "quality":
        assert 0 < len(kept) < len(rows)
    if name == "near_dedup":
        assert {(t or "").strip() for t in texts} == {(texts[i] or "").strip() for i in kept} | {t.strip() for t in texts if t and len(t.split()) > 60}
        assert len(kept) == len({(texts[i] or "").lower().strip() for i in kept})
    if name == "decontamination":
        assert texts.index(item) not in kept and set(range(6)) <= set(kept)
    if name == "pii":
        assert len(kept) == len(rows) and any("[EMAIL]" in (r["text"] or "") for r in got) and not any("a@b.com" in (r["text"] or "") for r in got)
    assert stage(spark, docs.limit(0), SF).count() == 0
