import pytest

from docloom.llm import queries as Q

from ..oracle import assert_same, tables


@pytest.mark.parametrize("name", sorted(Q.queries()))
def test_query(spark, data, name):
    df = Q.queries()[name](spark, data)
    rows = [tuple(r) for r in df.collect()]
    sql = Q.oracle_sql().get(name)
    if sql is not None:
        assert_same(rows, df.columns, tables(data), sql)
    spark.catalog.clearCache()
