"""Every query with SQL against DuckDB on the smallest shared tables."""

import os

import duckdb
import pytest

import __spark_entry__

DATA = "/root/testdata/sf0.001"
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def plain(v):
    if v is None or (isinstance(v, float) and v != v):
        return None
    if isinstance(v, bool):
        return v
    if isinstance(v, int | float) or type(v).__module__ == "decimal":
        return round(float(v), 5)
    return str(v)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(columns), sorted((tuple(plain(r[i]) for i in order) for r in rows), key=str)


@pytest.mark.skipif(not os.path.isdir(DATA), reason="no shared tables")
@pytest.mark.parametrize("name", sorted(k for k in __spark_entry__.oracle_sql() if k != "pipeline"))
def test_query_equals_its_sql(spark, name):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{DATA}/{t}.parquet'")
    cur = con.execute(__spark_entry__.oracle_sql()[name])
    want = table([d[0] for d in cur.description], cur.fetchall())
    got = __spark_entry__.queries()[name](spark, DATA)
    assert table(got.columns, [tuple(r) for r in got.collect()]) == want


def test_interval_seconds_are_rounded_as_in_sql(spark, tmp_path):
    # intervals end 86400 + event_id % 7 * 3600 seconds after their rounded start; halves go to the even second
    starts = ["2024-01-01 00:00:00.4", "2024-01-01 00:00:00.5", "2024-01-01 00:00:01.5", "2024-01-01 00:00:00.6"]
    calls = ["2024-01-02 00:00:00.4", "2024-01-02 00:00:00.5", "2024-01-02 00:00:00.6", "2024-01-02 00:00:01.5", "2024-01-02 00:00:02.5"]
    values = [f"({i * 7}, TIMESTAMP '{t}', {i}, 'click')" for i, t in enumerate(starts)]
    values += [f"({len(calls) * i + j + 100}, TIMESTAMP '{t}', {i}, 'view')" for i in range(len(starts)) for j, t in enumerate(calls)]
    con = duckdb.connect()
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts, user_id::BIGINT AS user_id, event_type FROM (VALUES {', '.join(values)}) t(event_id, ts, user_id, event_type)) TO '{tmp_path}/events.parquet' (FORMAT parquet)")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = con.execute(__spark_entry__.oracle_sql()["enclosing_interval"]).fetchall()
    got = __spark_entry__.queries()["enclosing_interval"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted(want)
    assert {f for _, f in want} == {None, 0, 7, 14, 21}


def test_entry(spark):
    assert __spark_entry__.entry(spark).count() > 0
