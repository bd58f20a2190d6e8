"""Jobs, what runs leave behind, and admission of listing rows."""

from datetime import datetime, timedelta

from larkspur.operators import html
from larkspur.queries.pages import serp_pages
from larkspur.sources import sinks
from larkspur.streaming import jobs

BEGAN = datetime(2024, 5, 1, 12, 0, 0)
EVENTS = "job_id string, seq bigint, ts timestamp, kind string"


def events(spark, rows):
    return spark.createDataFrame([(j, s, BEGAN + timedelta(milliseconds=ms), k) for j, s, ms, k in rows], EVENTS)


def slow_polls(rows, every=800):
    """Ask again and again, as a client does."""
    seen, n = [], 0
    while True:
        ms = n * every
        past = [r for r in rows if r[2] <= ms]
        seen.append(past[-1][1])
        if past[-1][3] in jobs.ENDS or len(past) == len(rows):
            return seen
        n += 1


def test_polls_equal_a_polling_client(spark):
    a = [("a", 1, 0, "start"), ("a", 2, 100, "site_started"), ("a", 3, 801, "site_finished"), ("a", 4, 5000, "done"), ("a", 5, 9000, "site_started")]
    b = [("b", 1, 0, "start"), ("b", 2, 1600, "error")]
    c = [("c", 1, 0, "done")]
    out = jobs.polled(events(spark, a + b + c)).collect()
    for rows in (a[:4], b, c):
        runs = sorted((r.first_poll, r.n_polls, r.seq) for r in out if r.job_id == rows[0][0])
        assert [s for _, n, s in runs for _ in range(n)] == slow_polls(rows)
        assert [f for f, _, _ in runs] == [sum(n for _, n, _ in runs[:i]) for i in range(len(runs))]


def test_states_and_look_ups(spark):
    known = spark.createDataFrame([("a", "x"), ("b", "y"), ("c", "z")], "job_id string, query string")
    log = events(spark, [("a", 1, 0, "start"), ("a", 2, 1, "site_finished"), ("b", 1, 0, "start"), ("b", 2, 9, "done")]).drop("ts")
    now = jobs.states(known, log)
    assert {r.job_id: (r.query, r.status, r.percent, r.n_events) for r in now.collect()} == {"a": ("x", "running", 27, 2), "b": ("y", "done", 100, 2), "c": ("z", "running", 0, 0)}
    found = {r.job_id: r for r in jobs.looked_up(spark.createDataFrame([("b",), ("q",)], "job_id string"), now).collect()}
    assert (found["b"].http_status, found["b"].status, found["b"].detail) == (200, "done", None)
    assert (found["q"].http_status, found["q"].status, found["q"].detail) == (404, None, jobs.GONE)
    assert jobs.states(known.limit(0), log).count() == 0 and jobs.polled(events(spark, [])).count() == 0


def test_logs_and_dumps(spark, tmp_path):
    known = spark.createDataFrame([("0123456789", "Sony WH-1000XM5!"), ("idle", "x")], "job_id string, query string")
    lines = sinks.job_logs(known, events(spark, [("0123456789", 2, 1000, "done"), ("0123456789", 1, 0, "start")])).orderBy("seq").collect()
    assert [r.line for r in lines] == ["2024-05-01 12:00:00 INFO start", "2024-05-01 12:00:01 INFO done"]
    assert {r.folder for r in lines} == {"20240501-120000_01234567_sony-wh-1000xm5"}
    pages = spark.createDataFrame([("Amazon.com", "serp", "<p>1</p>"), ("Amazon.com", "product", None)], "website string, kind string, html string")
    sinks.dump_pages(pages, f"{tmp_path}/d")
    assert (tmp_path / "d/site=amazoncom/kind=serp").is_dir()
    assert sorted(map(str, (r.html for r in spark.read.parquet(f"{tmp_path}/d").collect()))) == ["<p>1</p>", "None"]


def test_admission_explains_what_pages_give(spark):
    facts = html.admission(html.serp_facts(serp_pages(spark)))
    assert {r.admitted for r in facts.collect()} == {True, False}
    given = {(r.page_id, r.url) for r in html.serp(serp_pages(spark)).collect()}
    first = facts.where("admitted AND path = 0 AND page_id < 5").collect()
    assert first and {(r.page_id, r.bare) for r in first} <= given  # repeated addresses count once
