"""Every registered query of the engine against its SQL."""

import os
from collections import Counter

import duckdb
import pytest

from verdictflow import queries

MUST_HAVE_SQL = set(queries.QUERIES)


@pytest.fixture(scope="module")
def con(sf_dir):
    c = duckdb.connect()
    for f in os.listdir(sf_dir):
        c.execute(f"create view {f.split('.')[0]} as select * from '{sf_dir}/{f}'")
    return c


@pytest.mark.parametrize("name", sorted(queries.QUERIES))
def test_query(spark, sf_dir, con, name):
    df = queries.QUERIES[name](spark, sf_dir)
    found = con.execute(queries.ORACLES[name])
    names = [x[0] for x in found.description]
    assert sorted(names) == sorted(df.columns)
    assert Counter(map(repr, map(tuple, df.select(*names).collect()))) == Counter(map(repr, found.fetchall()))


def test_verdict_report_of_many_users(spark, tmp_path, sf_dir):
    """Copies of the events with shifted keys: the deny list goes on with the users."""
    c = duckdb.connect()
    c.execute(f"create view events as select event_id + 1000000 * i as event_id, user_id + 1500 * i as user_id, * exclude (event_id, user_id) from '{sf_dir}/events.parquet', range(6) t(i)")
    c.execute(f"copy events to '{tmp_path}/events.parquet'")
    df = queries.verdict_report(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == sorted(c.execute(queries.ORACLES["verdict_report"]).fetchall())


def test_entry(spark):
    import __spark_entry__ as e

    assert e.entry(spark).columns == ["event_id", "verdict", "rules", "active"]
    assert set(e.oracle_sql()) <= set(e.queries()) and MUST_HAVE_SQL <= set(e.oracle_sql())
