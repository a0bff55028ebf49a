"""Ages of timestamps with parts of a second against their SQL."""

import duckdb

import __spark_entry__ as entry

LAST = "2024-01-30 23:59:25.261702"


def test_ages_round_to_the_nearest_second(spark, tmp_path):
    # Near a minute's end, on both sides of half seconds and at them, even and odd.
    parts = ["25", "25.499999", "25.5", "25.500001", "25.913698", "24.5", "26.5", "26", "27.5"]
    rows = ["2024-01-30 23:50:" + p for p in parts] + ["2024-01-29 23:59:25.6", "2024-01-23 23:59:25.6", "2024-01-23 23:59:24.4", LAST]
    con = duckdb.connect()
    values = ", ".join(f"({k}, TIMESTAMP '{t}')" for k, t in enumerate(rows))
    con.execute(f"COPY (SELECT event_id::BIGINT AS event_id, ts FROM (VALUES {values}) v(event_id, ts)) TO '{tmp_path}/events.parquet'")
    con.execute(f"CREATE VIEW events AS SELECT * FROM '{tmp_path}/events.parquet'")
    want = sorted(con.execute(entry.oracle_sql()["x07_saved_ago"]).fetchall())
    assert dict(want)[4] == "8 min ago"
    assert sorted(map(tuple, entry.queries()["x07_saved_ago"](spark, str(tmp_path)).collect())) == want
