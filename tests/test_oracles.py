"""Every registered query against its SQL, and the registry itself."""

import pytest

from strandex.plans import registry
from tests.oracle import connect, duck_rows, spark_rows

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def con():
    with connect(SF) as c:
        yield c


@pytest.mark.parametrize("name", sorted(registry.ORACLES))
def test_same_rows_as_sql(spark, con, name):
    got, want = spark_rows(registry.QUERIES[name](spark, SF)), duck_rows(con, registry.ORACLES[name])
    assert got[0] == want[0]
    assert got[1] == want[1]
    assert want[1] or name in ("scope_none_empty",)


@pytest.mark.parametrize("name", sorted(set(registry.QUERIES) - set(registry.ORACLES)))
def test_other_queries_give_rows(spark, name):
    assert registry.QUERIES[name](spark, SF).count() > 0


def test_entry_and_registration(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())
