"""Every registered query equals its SQL on the small tables."""

from __future__ import annotations

import math

import duckdb
import pytest

from siltbed.plans import catalog

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    con.sql("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, float):
        return "nan" if math.isnan(v) else round(v, 5) + 0.0
    return [plain(x) for x in v] if isinstance(v, (list, tuple)) else v


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_equals_sql(spark, duck, name):
    df = catalog.queries()[name](spark, SF)
    found = duck.sql(catalog.oracle_sql()[name])
    assert sorted(df.columns) == sorted(found.columns)
    cols = sorted(df.columns)
    at = [found.columns.index(c) for c in cols]
    a = sorted(repr([plain(r[c]) for c in cols]) for r in df.collect())
    b = sorted(repr([plain(r[i]) for i in at]) for r in found.fetchall())
    assert a == b


@pytest.mark.parametrize("name", sorted(set(catalog.queries()) - set(catalog.oracle_sql()) - {"guide_em", "graph_communities"}))
def test_others_give_rows(spark, name):
    assert catalog.queries()[name](spark, SF).count() > 0
