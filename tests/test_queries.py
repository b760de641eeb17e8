import pytest

from tests.compare import assert_same, oracle
from veldt.plans import catalog


@pytest.mark.parametrize("name", sorted(catalog.QUERIES))
def test_query(spark, sf, name):
    got = catalog.QUERIES[name](spark, sf).toPandas()
    if name in catalog.ORACLES:
        assert_same(got, oracle(sf, catalog.ORACLES[name]))
    else:
        assert len(got) > 0


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() == 64 * 64
    assert set(__spark_entry__.oracle_sql()) <= set(__spark_entry__.queries())
