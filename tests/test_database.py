"""The six tables in the Derby database that Spark ships."""

import uuid

import pytest
from pyspark.sql import functions as F

from riverdeck.operators import promptdb
from riverdeck.sources import bridge, database

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def tables(spark, tmp_path_factory):
    place = tmp_path_factory.mktemp("db")
    small = promptdb.build(bridge.scenarios(spark, SF).where("source_index < 60"))
    for name, df in small.items():
        df.write.parquet(f"{place}/{name}")
    return {name: spark.read.parquet(f"{place}/{name}") for name in small}


def read(spark, url, name):
    return spark.read.jdbc(url, f'"{name}"')


def test_tables_are_replaced_whole_or_not_at_all(spark, tables):
    url = f"jdbc:derby:memory:{uuid.uuid4().hex};create=true"
    want = {name: df.count() for name, df in tables.items()}
    assert database.load(tables, url) == want and want["situations"] > 50
    got = read(spark, url, "situations")
    assert dict(got.dtypes)["hero_is_pair"] == "boolean"
    assert got.agg(F.sum("situation_id"), F.count_if("hero_is_pair")).first() == tables["situations"].agg(F.sum("situation_id"), F.count_if(F.col("hero_is_pair") == 1)).first()
    assert database.load(tables, url) == want  # again over itself
    # A row that refers to nothing: the load fails and what was there stays.
    orphan = tables["situation_actions"].union(tables["situation_actions"].limit(1).withColumn("situation_id", F.lit(10**9).cast(tables["situation_actions"].schema["situation_id"].dataType)))
    with pytest.raises(Exception, match="(?i)constraint|foreign|violat"):
        database.load({**tables, "situation_actions": orphan}, url)
    assert {name: read(spark, url, name).count() for name in promptdb.LOAD_ORDER} == want
    # The same for a key that comes twice, and after that a good load goes through.
    with pytest.raises(Exception, match="(?i)duplicate|constraint|unique"):
        database.load({**tables, "label_taxonomy": tables["label_taxonomy"].union(tables["label_taxonomy"].limit(1))}, url)
    assert read(spark, url, "label_taxonomy").count() == want["label_taxonomy"]
    assert database.load(tables, url) == want


def test_schema_as_text(spark, tables):
    text = database.ddl(tables)
    lines = text.split("\n")
    assert [x.split('"')[1] for x in lines if x.startswith("CREATE")] == list(promptdb.LOAD_ORDER)
    assert 'ALTER TABLE "situation_moves"' not in text and 'ADD FOREIGN KEY ("situation_id") REFERENCES "situations" ("situation_id")' in text
    assert '"hero_is_pair" BOOLEAN' in text and '"raw_label" VARCHAR(512) NOT NULL' in text
    with pytest.raises(ValueError, match="dialect"):
        database.load(tables, "jdbc:other:x")
    with pytest.raises(ValueError, match="missing"):
        database.load({}, "jdbc:derby:memory:x")
