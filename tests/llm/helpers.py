"""Inputs that every operator must take: nulls, empty and long texts, repeats, an empty table, clashing names."""

SCHEMA = "doc_id long, text string, n_words string, score string, KEPT string"
LONG = "lorem ipsum dolor sit amet " * 20000


def awkward(spark, texts=()):
    rows = [(1, None), (2, ""), (3, " \n\t "), (4, "ß € 日本 \u0001 x"), (4, "ß € 日本 \u0001 x"), (None, "no id"), (None, None), (5, LONG), *[(10 + i, t) for i, t in enumerate(texts)]]
    return spark.createDataFrame([(*r, "a", "b", "c") for r in rows], SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def labels(spark, rows=()):
    return spark.createDataFrame([(None, 1, 1), (1, None, None), *rows], "doc_id long, quality int, toxic int")
