from __future__ import annotations

import __spark_entry__ as entry


def test_flagship_and_registries(spark):
    df = entry.entry(spark)
    assert df.count() > 0 and df.columns[0] == "cell"
    queries, sql = entry.queries(), entry.oracle_sql()
    assert set(sql) <= set(queries) and all(map(callable, queries.values()))
    assert len(sql) > 100
