"""Every query with SQL gives what DuckDB gives on the small tables."""

import duckdb
import pytest

from siftline.plans.queries import QUERIES, SQL

SF = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def con():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"CREATE VIEW {t} AS SELECT * FROM '{SF}/{t}.parquet'")
    return c


def plain(x):
    if isinstance(x, (list, tuple)):
        return tuple(plain(v) for v in x)
    return x


@pytest.mark.parametrize("name", sorted(SQL))
def test_equals_sql(spark, con, name):
    df = QUERIES[name](spark, SF)
    got = df.collect()
    result = con.execute(SQL[name])
    columns = [c[0] for c in result.description]
    assert sorted(columns) == sorted(df.columns)
    order = sorted(columns)
    want = sorted((tuple(plain(r[columns.index(c)]) for c in order) for r in result.fetchall()), key=repr)
    assert sorted((tuple(plain(r[c]) for c in order) for r in got), key=repr) == want


@pytest.mark.parametrize("name", sorted(set(QUERIES) - set(SQL)))
def test_runs(spark, name):
    assert QUERIES[name](spark, SF).count() >= 0


def test_times_of_years_beyond_four_digits_equal_sql(spark, tmp_path):
    duckdb.sql("SELECT i AS event_id, epoch_ms(i * 86400123) AS ts FROM (SELECT unnest([0, 1, 2932896, 2932897, 6000000, 100000000]) AS i)").write_parquet(f"{tmp_path}/events.parquet")
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    for name in ("from_millis", "short_date"):
        assert sorted((r.event_id, r.shown) for r in QUERIES[name](spark, str(tmp_path)).collect()) == sorted(con.execute(SQL[name]).fetchall())
