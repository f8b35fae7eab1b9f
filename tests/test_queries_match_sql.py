"""Every query with an SQL equivalent gives DuckDB's rows on the smallest tables."""

import duckdb
import pytest

import __spark_entry__ as entry

SF = "/root/testdata/sf0.001"
TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return con


def _sorted(rows, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(r[i] for i in order) for r in rows), key=lambda r: tuple((v is None, str(type(v)), v) for v in r)
    )


@pytest.mark.parametrize("name", sorted(entry.oracle_sql()))
def test_query(spark, duck, name):
    df = entry.queries()[name](spark, SF)
    result = duck.execute(entry.oracle_sql()[name])
    columns = [d[0] for d in result.description]
    expected = result.fetchall()
    assert sorted(df.columns) == sorted(columns)
    got = [tuple(r) for r in df.collect()]
    a, b = _sorted(got, df.columns), _sorted(expected, columns)
    assert len(a) == len(b)
    different = [(x, y) for x, y in zip(a, b) if x != y]
    assert not different, different[:3]


def test_entry_runs(spark):
    df = entry.entry(spark)
    assert df.columns == ["level", "bin", "n", "lo", "hi", "best_id", "lse"]
    assert df.count() == 50


def test_every_sql_has_a_query():
    assert set(entry.oracle_sql()) <= set(entry.queries())
