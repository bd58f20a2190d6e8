"""The whole comparison: each way in which a row can come about."""

import os
from decimal import Decimal

import pytest

from larkspur.operators import matching
from larkspur.plans import comparison
from larkspur.queries.pages import _ld

TITLE = "Sony WH-1000XM5 Headphones"
CAPTURES = "page_id int, query_id int, website string, kind string, stage int, method string, url string, http_status int, html string"


def page(asin):
    return f"https://www.amazon.com/dp/{asin}"


def serp(*cards):
    return "<html>" + "".join(f"<div data-component-type='s-search-result' data-asin='{a}'><h2><a href='/dp/{a}'><span>{t}</span></a></h2></div>" for a, t in cards) + "</html>"


def product(title, price):
    return _ld(title, price) + f"<span id='productTitle'>{title}</span>"


SEARCH = "https://www.amazon.com/s?k=x"
A, B, C = "B0AAAAAAA1", "B0AAAAAAA2", "B0AAAAAAA3"
OTHER = "Sony WH-1000XM5 Headphones Silver"
#: By query: what was asked, captures as (kind, stage, url, status, html), and the row of Amazon.com that comes out.
CASES = {
    1: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE))), ("pdp", 1, page(A), 200, product(TITLE, "300.00"))], ("Success", 300, page(A))),
    # the first search page that has rows counts; a refined one where none of them will do
    2: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, "<html></html>"), ("serp", 2, SEARCH, 200, serp((A, "Case for Sony headphones"))), ("refined", 1, SEARCH, 200, serp((B, TITLE))), ("pdp", 1, page(B), 200, product(TITLE, "301.00"))], ("Success", 301, page(B))),
    # known pages where there is no listing at all; one without a price fails but keeps its address
    3: ("bose quietcomfort ultra", [("pdp", 1, "https://www.amazon.com/dp/B0CCZ1L489", 200, product("Bose QuietComfort Ultra Wireless Noise Cancelling Headphones", "429.00"))], ("Success", 429, "https://www.amazon.com/dp/B0CCZ1L489")),
    4: ("bose quietcomfort ultra", [], ("Failed", None, "https://www.amazon.com/dp/B0CCZ1L489")),
    # the match's page gives nothing: the next acceptable listing; a page's later stage before that
    5: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE), (B, OTHER))), ("pdp", 1, page(A), 200, "<html></html>"), ("pdp", 1, page(B), 200, product(OTHER, "305.00"))], ("Success", 305, page(B))),
    6: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE), (B, OTHER))), ("pdp", 1, page(A), 200, product(TITLE, "3.00")), ("pdp", 2, page(A), 200, product(TITLE, "306.00")), ("pdp", 1, page(B), 200, product(OTHER, "1.00"))], ("Success", 306, page(A))),
    7: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE), (B, OTHER))), ("pdp", 1, page(A), 200, product(TITLE, "3.00")), ("pdp", 1, page(B), 200, product(OTHER, "307.00"))], ("Success", 307, page(B))),
    # the match turns out to be an accessory: failed, whatever comes after it
    8: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE), (B, OTHER))), ("pdp", 1, page(A), 200, product("Case for Sony WH-1000XM5", "308.00")), ("pdp", 1, page(B), 200, product(OTHER, "308.00"))], ("Failed", None, None)),
    # the match's page is gone: a find of a web search
    9: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE))), ("pdp", 1, page(A) + "9", 404, ""), ("pdp", 1, page(C), 200, product(OTHER, "309.00"))], ("Success", 309, page(C))),
    10: ("sony wh-1000xm5 headphones", [], ("Failed", None, None)),
    # an outlier takes what the second run found; where that found nothing it failed
    11: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE))), ("pdp", 1, page(A), 200, product(TITLE, "500.00"))], ("Success", 311, page(B))),
    12: ("sony wh-1000xm5 headphones", [("serp", 1, SEARCH, 200, serp((A, TITLE))), ("pdp", 1, page(A), 200, product(TITLE, "500.00"))], ("Failed", None, None)),
}
LISTED = [(f"B0AAAAAA{k:02d}", f"{TITLE} model {k}") for k in range(9)]


def listed(pages):
    """Nine acceptable listings of one page, and their own pages as (status, html)."""
    return [("serp", 1, SEARCH, 200, serp(*LISTED))] + [("pdp", 1, page(a), *pages(k)) for k, (a, _) in enumerate(LISTED)]


def priced(k):
    return 200, product(LISTED[k][1], f"{400 + k}.00")


CASES |= {
    # unreachable listings are passed over, before a match and among the tries after it, and cost nothing
    20: ("sony wh-1000xm5 headphones", listed(lambda k: (404, "") if k == 0 else priced(k)), ("Success", 401, None)),
    21: ("sony wh-1000xm5 headphones", listed(lambda k: (200, "<html></html>") if k == 0 else (404, "") if k < 7 else priced(k)), ("Success", 407, None)),
    # five refused titles use up the checks: for a retailer whose search is taken as it is, the next listing that is not refused
    22: ("sony wh-1000xm5 headphones", listed(priced), ("Success", 406, None)),
}
REFUSED = {22: range(6)}


@pytest.fixture(scope="module")
def rows(spark):
    captures, n = [], 0
    for q, (_, pages, _) in CASES.items():
        for kind, stage, url, status, html in pages:
            n += 1
            # addresses are shared between the cases, so each has its own
            own = lambda s: s.replace("B0AAAAAA", f"B0AAA{q:02d}A") if q >= 20 else s.replace("B0AAAAAAA", f"B0AAAA{q:02d}A")  # noqa: B023, E731
            captures.append((n, q, "Amazon.com", kind, stage, "http", own(url.removesuffix("9") if status == 404 else url), status, own(html)))
    queries = spark.createDataFrame([(q, c[0]) for q, c in CASES.items()], "query_id int, user_query string")
    # a refusal holds for a question and a title, so the query that has some asks in other words
    said = [(CASES[q][0] + " black", LISTED[k][1], False, "refine_search", f"sony xm5 {k % 3}") for q, some in REFUSED.items() for k in some]
    titles = spark.createDataFrame(said, "expected string, scraped string, match boolean, action string, suggested_search string")
    refused = [("Amazon.com", TITLE, Decimal(3), False), ("Amazon.com", OTHER, Decimal(1), False)]
    prices = spark.createDataFrame(refused, "website string, title string, price decimal(38,10), plausible boolean")
    references = spark.createDataFrame([(q, "Amazon.com", Decimal(310)) for q in (11, 12)], "query_id int, website string, ref_price decimal(38,10)")
    found = spark.createDataFrame([(9, "Amazon.com", OTHER, page(C).replace("AAA3", "09A3")), (1, "Amazon.com", "Another thing", page(C))], "query_id int, website string, title string, url string")
    second = spark.createDataFrame([(11, "Amazon.com", OTHER, Decimal(311), "Success", "http", page(B))], "query_id int, website string, title string, price decimal(38,10), status string, method string, url string")
    plans = spark.createDataFrame([(q, "Amazon.com", CASES[q][0], CASES[q][0] + " black") for q in REFUSED], "query_id int, website string, search_query string, match_query string")
    out = comparison.compare(queries, plans, spark.createDataFrame(captures, CAPTURES), references, titles, prices, discovered=found, second=second)
    return {(r.query_id, r.website): r for r in out.collect()}


def test_every_query_has_every_retailer(rows):
    assert len(rows) == 4 * len(CASES)


@pytest.mark.parametrize("query_id", CASES)
def test_row(rows, query_id):
    r, (status, price, url) = rows[query_id, "Amazon.com"], CASES[query_id][2]
    assert (r.status, r.price) == (status, price)
    if url is not None and query_id != 11:
        url = url.replace("B0AAAAAAA", f"B0AAAA{query_id:02d}A")
    if (status == "Success" or query_id == 4) and query_id < 20:
        assert r.url == url
    assert r.price_outlier == (query_id in (11, 12))


def look(rows, most=5):
    """One after the other, as a person would."""
    checks, notes = 0, []
    for r in sorted(rows):
        _, gone, skip, match, suggestion, name = r
        if gone or skip:
            continue
        if checks >= most:
            break
        checks += 1
        if match:
            return name, checks, notes
        if suggestion is not None and suggestion not in notes:
            notes.append(suggestion)
    return None, checks, notes


def test_picked_equals_looking_one_after_the_other(spark):
    """Random verdicts and statuses, made from events."""
    path = "/root/testdata/sf0.001/events.parquet"
    if not os.path.exists(path):
        pytest.skip("no test tables")
    e = spark.read.parquet(path).selectExpr(
        "user_id AS k", "CAST(event_id AS INT) AS place", "event_type = 'error' AS gone", "event_id % 7 = 0 AS skip", "value > 40 AS match",
        "CASE WHEN event_type = 'click' THEN NULL ELSE concat('s', event_id % 4) END AS suggestion", "concat('e', event_id) AS name",
    )
    groups = {}
    for r in e.collect():
        groups.setdefault(r.k, []).append((r.place, r.gone, r.skip, r.match, r.suggestion, r.name))
    for most in (1, 5):
        got = {r.k: (r.taken and r.taken.name, r.checks, r.refinements) for r in matching.picked(e, ["k"], "place", ["name"], most).collect()}
        assert got == {k: look(rows, most) for k, rows in groups.items()}


def test_refinements_are_few_and_distinct(spark):
    looks = spark.createDataFrame(
        [(1, "Amazon.com", 0, 1, None, ["a b", " A B ", "c", "d"]), (2, "Amazon.com", 0, 1, "taken", ["e"]), (3, "Amazon.com", 0, 1, None, [" "])],
        "query_id int, website string, source int, stage int, taken string, refinements array<string>",
    )
    out = comparison.refinements(looks).collect()
    assert sorted((r.query_id, r["rank"], r.search) for r in out) == [(1, 1, "a b"), (1, 2, "c")]
