"""The quality model learns from all labels."""

import random

import numpy as np

from riverdeck.llm import quality


def test_places_are_exact(spark):
    rng = random.Random(2)
    values = [round(rng.gauss(0, 1), 4) for _ in range(3000)] + [0.5] * 500 + [1e6, -1e6]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    for rank in (0, 1, 7, 1700, 3400, len(values) - 1):
        assert quality.ranked(df, "v", rank, most=50) == sorted(values)[rank]


def test_all_labelled_documents_count(spark):
    """Every good document of the first half adds its n-grams to the target, however many there are."""
    n = 70_000  # beyond the 65,536 that were drawn once
    docs = spark.range(n).selectExpr("id as doc_id", "concat('word', id, ' ', repeat(concat('the common words of item ', id % 7, ' '), 9)) as text")
    labels = spark.range(n).selectExpr("id as doc_id", "1 as quality", "0 as toxic")
    params = quality.QualityParams(buckets=1 << 10)
    model = quality.fit(spark, docs, labels, params)
    half = docs.where("pmod(xxhash64('half', doc_id), 2) = 0")
    raw, target = quality._gram_counts(docs, 1 << 10), quality._gram_counts(half, 1 << 10)
    p_raw = (raw + 1) / (raw.sum() + 1024)
    want = np.log((target + 1024 * p_raw) / (target.sum() + 1024) / p_raw)
    assert np.allclose(model.weights, want, atol=1e-6)
    scores = sorted(r[0] for r in quality.score(docs.where("pmod(xxhash64('half', doc_id), 2) = 1"), model).where("not base_failed").select("llr").collect())
    assert model.threshold == (scores[int(0.002 * len(scores))] if scores else -np.inf)


def test_labelled_texts_stay_where_they_are(spark):
    """However many labels there are, texts meet them without an exchange, each once; a model learnt in many passes is that of one."""
    docs = spark.range(3000).selectExpr("id as doc_id", "array_join(transform(sequence(1, 60 + id % 9), i -> concat('w', (i * (1 + id % 7) + id) % 211)), ' ') as text")
    labels = spark.range(2500).selectExpr("id as doc_id", "cast(id % 3 > 0 as int) as quality", "0 as toxic")
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")  # as if the labels were many
    try:
        parts = list(quality.labelled(docs, labels.select("doc_id", "quality"), each=300))
        plans = [p._jdf.queryExecution().executedPlan().toString() for p in parts]
        assert len(parts) == 9 and all("BroadcastHashJoin" in p and "SortMergeJoin" not in p for p in plans)
        assert sorted(r["doc_id"] for p in parts for r in p.select("doc_id").collect()) == list(range(2500))
        params = quality.QualityParams(buckets=1 << 10)
        one, many = quality.fit(spark, docs, labels, params), quality.fit(spark, docs, labels, params, each=300)
        assert np.array_equal(one.weights, many.weights) and one.threshold == many.threshold > -np.inf
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_kept_words_are_bounded(spark):
    grams = quality._Grams(1 << 10)
    for i in range(0, 400_000, 20_000):
        grams([[b"w%d" % n for n in range(i, i + 20_000)]])
    assert len(grams.seen) <= quality.SEEN + 20_000
