import pytest

from framelake import catalog, catalog_records  # noqa: F401  importing adds queries
from tests.oracle import same

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", sorted(catalog.SQL))
def test_sql_gives_the_same_rows(spark, name):
    same(spark, catalog.QUERIES[name], catalog.SQL[name], SF)


@pytest.mark.parametrize("name", sorted(set(catalog.QUERIES) - set(catalog.SQL)))
def test_runs_without_sql(spark, name):
    assert catalog.QUERIES[name](spark, SF).limit(5).count() > 0


def test_entry_imports_and_runs(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() == 10
    assert set(entry.oracle_sql()) <= set(entry.queries())
