"""The timeline on a table with more hits than its limit, and the filters of its operator."""

import duckdb
from conftest import as_set

import __spark_entry__ as entry_point
from check_sql import rows_of
from strandline.operators import history

SF = "/root/testdata/sf0.1"


def test_timeline_over_more_hits_than_its_limit(spark):
    con = duckdb.connect()
    con.execute(f"CREATE VIEW events AS SELECT * FROM read_parquet('{SF}/events.parquet')")
    df = entry_point.queries()["timeline"](spark, SF)
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    cur = con.execute(entry_point.oracle_sql()["timeline"])
    assert len(got[1]) == 600
    assert got == rows_of([d[0] for d in cur.description], cur.fetchall())


def test_text_in_chosen_columns(rows):
    events = rows("project_id string, ts timestamp, seq int, event string, actor string, detail string",
                  ("p", None, 7, "e", "u", "none"), ("p", None, 1, "e", "u", "x7"), ("p", None, 2, "e", "v", "7"), ("p", None, 3, "f", "u", "7"))
    assert as_set(history.timeline(events, "u", "e", "7"), "seq") == {7, 1}
    assert as_set(history.timeline(events, "u", "e", "7", fields=["detail"]), "seq") == {1}
