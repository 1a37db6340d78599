"""Every registered fleet query against its DuckDB counterpart."""

import duckdb
import pytest

from flowledger.plans import oracles, queries

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    return con


def test_every_query_has_a_counterpart():
    assert set(queries.queries()) == set(oracles.oracle_sql())


@pytest.mark.parametrize("name", sorted(queries.queries()))
def test_query_equals_sql(spark, duck, name):
    got = queries.queries()[name](spark, DATA).toArrow()
    want = duck.sql(oracles.oracle_sql()[name]).to_arrow_table()
    columns = sorted(got.column_names)
    rows = lambda t: sorted(map(repr, zip(*[t.column(c).to_pylist() for c in columns], strict=True)))
    assert columns == sorted(want.column_names)
    assert rows(got) == rows(want)


def test_entry(spark):
    import __spark_entry__

    assert __spark_entry__.entry(spark).count() > 0
