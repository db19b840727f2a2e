import pytest

from docloom.plans import catalog

from .oracle import assert_same, tables


@pytest.mark.parametrize("name", sorted(catalog.queries()))
def test_query(spark, data, name):
    df = catalog.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = catalog.oracle_sql().get(name)
    if sql is not None:
        assert_same(rows, df.columns, tables(data), sql)


def test_entry(spark, monkeypatch):
    import __spark_entry__ as entry

    assert entry.entry(spark).columns[:2] == ["query_id", "chunk_id"]
    assert set(entry.oracle_sql()) <= set(entry.queries())
