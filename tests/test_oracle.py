"""Every registered query with an SQL twin gives the twin's rows, at the smallest scale."""

import duckdb
import pytest

from pricewell.plans import registry

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in "region nation customer supplier part orders lineitem events documents embeddings pages".split():
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def rows(names, got):
    order = sorted(range(len(names)), key=names.__getitem__)
    return sorted(repr([round(r[k], 6) if isinstance(r[k], float) else r[k] for k in order]) for r in got)


@pytest.mark.parametrize("name", sorted(registry.oracle_sql()))
def test_same_rows(spark, duck, name):
    df = registry.queries()[name](spark, SF)
    cur = duck.execute(registry.oracle_sql()[name])
    names = [d[0] for d in cur.description]
    assert sorted(df.columns) == sorted(names)
    assert rows(df.columns, df.collect()) == rows(names, cur.fetchall())
