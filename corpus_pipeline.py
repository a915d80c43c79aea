"""A corpus cleaned in five stages; each stage's result is written as Parquet and read again as the next one's documents.

quality: documents that the quality rules reject go.  near_dedup: one document of each class of near copies (five-word shingles,
Jaccard similarity of 0.8 or more, checked exactly) stays, the one with
the smallest doc_id.  decontamination: contaminated documents go, and hit passages are cut out of the others.
pii: confirmed personal data is replaced by its kind in brackets.  sentencepiece: the remaining texts are encoded.

Each stage takes the text apart from all other columns, which travel in one column of a name that no operator uses: a column of any name comes out as it went in.

near_dedup decides row by row: a row without doc_id is deduplicated by its text like any other and stays if its class has no row with one; rows
that share a doc_id but not their text are kept both.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from riverdeck.llm import decontaminate, jaccard, pii as personal, quality as rules, sentencepieces, simhash
from riverdeck.llm.common import cut, shared_dir, table

#: Learned criteria and hashes of the stages are not expressible in SQL.
ORACLE_SQL = None


#: The rest of a row, while an operator works on its text.
REST = "_corpus_pipeline_rest"


def _apart(docs: DataFrame) -> DataFrame:
    """The text, and all other columns in one."""
    rest = [F.col(f"`{c}`") for c in docs.columns if c != "text"]
    return docs.select("text", F.struct(*(rest or [F.lit(True).alias("none")])).alias(REST))


def _together(df: DataFrame, docs: DataFrame, changed: bool = False) -> DataFrame:
    """The columns of ``docs`` again; where texts were changed, n_chars follows them."""
    kinds = {f.name: f.dataType for f in docs.schema.fields}
    column = lambda c: F.length("text").cast(kinds[c]) if changed and c == "n_chars" else F.col("text") if c == "text" else F.col(REST)[c]
    return df.select(*[column(c).alias(c) for c in docs.columns])


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    model = rules.fit(spark, docs.select("doc_id", "text"), table(spark, sf_dir, "labels"))
    return _together(rules.score(_apart(docs), model).where("kept"), docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    rows = jaccard.tagged(_apart(docs))
    # Rows of a class in their order: by doc_id, a null last; a null text after any other; then by hashes, so that reruns agree.
    id_, others = F.col(REST)["doc_id"], [F.col(REST)[c] for c in docs.columns if c != "text"]
    order = F.struct(id_.isNull(), id_, F.col("text").isNull(), F.xxhash64("text"), F.xxhash64(*others), "_row").alias("order")
    rooted = cut(simhash.spread_join(rows.select("_set", "_row", order), jaccard.classes(rows), "_set", "_row").select("_row", "order", F.coalesce("root", "_set").alias("root")), "rooted")
    first = rooted.groupBy("root").agg(F.min("order").alias("first"))
    go = cut(simhash.spread_join(rooted.select("_row", "root"), first.select("root", F.col("first._row").alias("kept")), "root", "_row").where("_row <> kept").select("_row"), "go")
    return _together(rows.join(jaccard.small(go), "_row", "left_anti"), docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = decontaminate.find(_apart(docs), table(spark, sf_dir, "benchmark")).where("not contaminated")
    return _together(decontaminate.strip(found), docs, changed=True)


def pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return _together(personal.redact(_apart(docs)), docs, changed=True)


def sentencepiece(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    import public_tokenizers

    pieces = sentencepieces.load(public_tokenizers.path("piece_bpe_32k.model"))
    # Workers of the stages before still hold memory, so segments are kept in less of it than by default.
    return sentencepieces.encode(docs, pieces, keep=24 << 20).drop("text")


STAGES = [("quality", quality), ("near_dedup", near_dedup), ("decontamination", decontamination), ("pii", pii), ("sentencepiece", sentencepiece)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; results lie in the shared folder in between."""
    docs = table(spark, sf_dir, "documents")
    place = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{place}/{name}")
        docs = spark.read.parquet(f"{place}/{name}")
    return docs
