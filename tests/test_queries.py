"""Every registered query of the library against its SQL, on the smallest tables."""

import duckdb
import pytest

from chronoloom.plans import oracle, queries

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def rows(columns, found):
    order = sorted(range(len(columns)), key=lambda k: columns[k])
    show = lambda x: repr(round(x, 9)) if isinstance(x, float) else str(x)
    return sorted(tuple(show(r[k]) for k in order) for r in found)


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{SF}/{t}.parquet')")
    return con


@pytest.mark.parametrize("name", queries.QUERIES)
def test_query(spark, duck, name):
    df = queries.QUERIES[name](spark, SF)
    found = df.collect()
    assert not any(k.startswith(("map", "struct", "array")) for _, k in df.dtypes)
    if name in oracle.ORACLE:
        got = duck.execute(oracle.ORACLE[name])
        columns = [d[0] for d in got.description]
        assert sorted(columns) == sorted(df.columns)
        assert rows(df.columns, found) == rows(columns, got.fetchall())
    else:
        assert found


def test_entry(spark):
    import __spark_entry__ as entry

    assert entry.entry(spark).count() > 0
    assert set(queries.QUERIES) <= set(entry.queries()) and set(entry.oracle_sql()) <= set(entry.queries())
