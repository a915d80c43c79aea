import pytest

from riverdeck import catalog
from tests.oracle import SF, duck_rows, spark_rows


@pytest.mark.parametrize("name", sorted(catalog.ORACLES))
def test_same_rows_as_sql(spark, name):
    assert spark_rows(catalog.QUERIES[name](spark, SF)) == duck_rows(catalog.ORACLES[name])


@pytest.mark.parametrize("name", sorted(n for n in catalog.QUERIES if n not in catalog.ORACLES and not n.startswith("ml_")))
def test_runs_without_oracle(spark, name):
    assert catalog.QUERIES[name](spark, SF).count() > 0


def test_entry_contract(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() == 1500
