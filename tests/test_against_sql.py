"""Queries on awkward rows against their SQL."""

from datetime import datetime, timedelta

import duckdb

import __spark_entry__


def both(spark, tmp_path, name, table, rows, ddl):
    """The rows of a query and of its SQL, over one table."""
    spark.createDataFrame(rows, ddl).write.parquet(f"{tmp_path}/{table}.parquet")
    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW {table} AS SELECT * FROM read_parquet('{tmp_path}/{table}.parquet/*.parquet')")
    got = __spark_entry__.queries()[name](spark, str(tmp_path))
    want = duck.execute(f"SELECT {', '.join(got.columns)} FROM ({__spark_entry__.oracle_sql()[name]})").fetchall()
    return sorted(map(repr, map(tuple, got.collect()))), sorted(map(repr, want))


def test_page_facts_keep_references(spark, tmp_path):
    pages = ["<title>a &amp; b &quot;c</title><h1 class='x'> d &amp</h1>", "<title>a\nb</title><h1>　 e <b>f</b>\t</h1>", "<TITLE>g</TITLE><h1>h", "", None, "<h1>&amp;amp; &#39;</h1><h1>i</h1>"]
    got, want = both(spark, tmp_path, "EX-14_page_facts", "pages", list(enumerate(pages)), "page_id bigint, html string")
    assert got == want


def test_polls_of_events_without_a_time(spark, tmp_path):
    began = datetime(2024, 5, 1)
    log = [(1, 3, None, "view"), (1, 1, 0, "view"), (1, 2, 900, "click"), (2, 4, None, "purchase"), (2, 5, 100, "purchase"), (3, None, 0, "view"), (3, 6, 0, "view"), (3, 7, 50, None), (None, 8, None, "view"), (4, 9, None, "click"), (4, 10, 10, "view")]
    rows = [(seq, None if ms is None else began + timedelta(milliseconds=ms), job, kind) for job, seq, ms, kind in log]
    got, want = both(spark, tmp_path, "SS-05_polls", "events", rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string")
    assert got == want
