"""The whole comparison: queries and captured pages to one ordered row for each query and retailer."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import fixed, fuzzy, parse, urls
from ..operators import cascade, filters, html, judge, matching
from ..session import checkpointed, measured_joins
from ..sources import tables
from .hooks import Hooks, watched

GROUP = matching.GROUP
#: Where a listing comes from, in the order in which these are turned to: search pages, refined searches, known pages, a web search.
SERP, REFINED, KNOWN, DISCOVERED = range(4)
PAGE = [*GROUP, "source", "stage"]
#: What is kept of a listing that is taken.
ROW = ["place", "url", "serp_title", "score"]
AMAZON = "Amazon.com"


def offers(planned: DataFrame, served: DataFrame, about: DataFrame, discovered: DataFrame | None) -> DataFrame:
    """Listings ``query_id, website, source, stage, rank, title, url`` from everywhere; of search pages those of the first one that has any."""
    columns = [*PAGE, "rank", "title", "url"]
    source = F.when(F.col("kind") == "serp", SERP).otherwise(REFINED).alias("source")
    parsed = checkpointed(html.serp(served.where("kind IN ('serp', 'refined')"), tested=True)).drop("website")
    parsed = parsed.join(about.select("page_id", *GROUP, source, "stage"), "page_id").select(*columns)
    found = cascade.first_stage(parsed.where(F.col("source") == SERP), GROUP).unionByName(parsed.where(F.col("source") == REFINED))
    asked = planned.select(*GROUP, F.col("domain").alias("site_domain"), F.col("match_query").alias("user_query"))
    known = tables.catalogued(asked, (*GROUP, "site_domain")).where("domain = site_domain")
    found = found.unionByName(known.select(*GROUP, F.lit(KNOWN).alias("source"), F.lit(0).alias("stage"), "rank", "title", "url"))
    if discovered is not None:
        given = tables.discovered(discovered.join(planned.select(*GROUP, "domain"), GROUP))
        found = found.unionByName(given.select(*GROUP, F.lit(DISCOVERED).alias("source"), F.lit(0).alias("stage"), "rank", "title", "url"))
    return found.join(planned.select(*GROUP, F.col("match_query").alias("query")), GROUP)


def candidates(listings: DataFrame, title_verdicts: DataFrame, gone: DataFrame) -> DataFrame:
    """The listings that may be matched, each with its ``place`` on its page and score; known pages and finds score 100.

    ``gone``: its page is not there any more; ``skip``: no answer to the query, found
    without asking; ``unsafe``: not even for a retailer that takes what its search
    gives; ``match`` and ``suggestion``: what was said of its title.
    """
    formed = filters.with_forms(listings, "query", "title")
    pages = filters.drop_accessories(formed.where(F.col("source") <= REFINED), PAGE)
    ranked = matching.ranked(matching.candidates(pages, PAGE), PAGE)
    q, t = F.col("query_form"), F.col("title_form")
    fits = ~filters.model(q, t, "url") & ~filters.accessory(q, t) & (F.lower("title") != q["normalized"])
    given = formed.where((F.col("source") == KNOWN) | ((F.col("source") == DISCOVERED) & fits)).withColumn("score", F.lit(100.0)).withColumn("place", F.col("rank"))
    unsafe = filters.skip_candidate("query", q, "title", t, "url") | ((F.col("website") == AMAZON) & filters.ram_kit(urls.path("url"), "title"))
    other = filters.model(q, t, "url") | filters.accessory(q, t) | filters.earbuds_vs_headphones(q, t) | filters.known_earbuds(q, "url")
    no = F.lit(False)
    both = ranked.withColumn("unsafe", F.coalesce(unsafe, no)).withColumn("skip", F.col("unsafe") | F.coalesce(other, no))
    both = both.unionByName(given.withColumn("unsafe", no).withColumn("skip", no), allowMissingColumns=True)
    judged = judge.titles(both.withColumn("expected", F.col("query")).withColumn("scraped", F.col("title")), title_verdicts)
    if "suggestion" not in judged.columns:
        judged = judged.withColumn("suggestion", F.lit(None).cast("string"))
    flagged = judged.join(gone.select("url", F.lit(True).alias("gone")), "url", "left").withColumn("gone", F.coalesce("gone", no))
    return flagged.select(*PAGE, "place", "query", F.col("title").alias("serp_title"), "url", "score", "gone", "skip", "unsafe", "match", "suggestion")


def looked_through(listed: DataFrame) -> DataFrame:
    """One look through each search page: ``PAGE, taken, checks, refinements``."""
    return matching.picked(listed.where(F.col("source") <= REFINED), PAGE, "place", ROW)


def matched(listed: DataFrame, looks: DataFrame) -> DataFrame:
    """The match of each query and retailer, and where it comes from.

    It is what the look through the first search page that gives something has taken;
    where no page does, of Amazon's own pages the first listing that is not unsafe and
    matches, if its page is there; then the first known page or find that matches and is there.
    """
    order = F.struct("source", "stage", "place", "url")
    row = F.struct("source", "stage", *ROW)
    taken = F.struct("source", "stage", *(F.col(f"taken.{c}").alias(c) for c in ROW))
    by_look = looks.where("taken IS NOT NULL").groupBy(*GROUP).agg(F.min_by(taken, F.struct("source", "stage")).alias("by_look"))
    safe = F.min_by(F.struct(row.alias("row"), "gone"), F.when((F.col("website") == AMAZON) & (F.col("source") == SERP) & F.col("match") & ~F.col("unsafe"), order)).alias("safe")
    later = F.min_by(row, F.when((F.col("source") >= KNOWN) & F.col("match") & ~F.col("gone"), order)).alias("later")
    refined = F.col("by_look.source") == REFINED
    first = F.when(~refined, F.col("by_look"))
    own = F.when(~F.col("safe.gone"), F.col("safe.row"))
    chosen = listed.groupBy(*GROUP).agg(safe, later).join(by_look, GROUP, "left").select(*GROUP, F.coalesce(first, own, "by_look", "later").alias("m"))
    return chosen.where("m IS NOT NULL").select(*GROUP, "m.*")


def refinements(looks: DataFrame, most: int = fixed.MAX_REFINEMENTS) -> DataFrame:
    """What verdicts said to search for instead, where nothing was taken: ``GROUP, rank, search``, as many as are tried."""
    said = looks.where(F.col("taken").isNull() & (F.col("source") == SERP)).select(*GROUP, "stage", F.posexplode("refinements").alias("at", "search"))
    said = said.withColumn("key", F.lower(F.trim("search"))).where("key <> ''")
    first = said.groupBy(*GROUP, "key").agg(F.min(F.struct("stage", "at", "search")).alias("first"))
    return matching.serp_rank(first.select(*GROUP, "first.*"), GROUP, ["stage", "at"], most).select(*GROUP, "rank", "search")


def extracted(valid: DataFrame, match: DataFrame, fields: DataFrame, price_verdicts: DataFrame) -> DataFrame:
    """Fields of the match's product page, or of what is tried next: ``GROUP, stage, method, url, score`` and the fields.

    A page's first valid stage counts; where its price is refused, its later
    stages are tried, then the next acceptable listings of the same search page. A
    match whose extracted title is an accessory or another model failed.
    """
    m = match.select(*GROUP, F.col("source").alias("m_source"), F.col("stage").alias("m_stage"), F.col("place").alias("m_place"))
    # what a try does not cost is left out before tries are numbered
    good = (F.col("match") & ~F.col("gone") & ~F.col("skip")) | (F.col("place") == F.col("m_place"))
    same = valid.join(m, GROUP).where("source = m_source AND stage = m_stage AND place >= m_place").where(good)
    attempt = F.row_number().over(Window.partitionBy(*GROUP).orderBy("place", "url"))
    listed = same.withColumn("attempt", attempt).where(F.col("attempt") <= 1 + fixed.MAX_ATTEMPTS).select(*GROUP, "attempt", "query", "serp_title", "url", "score")
    tries = listed.join(fields.where(F.col("reject_reason").isNull()).select(*GROUP, "url", "stage", "method", *cascade.FIELDS), [*GROUP, "url"])
    checked = cascade.rechecked(filters.with_forms(tries, "query", "title").withColumn("status", F.lit("Success")))
    odd = cascade.unscored_sanity("query", "serp_title", "title", fuzzy.similarity("token_set", F.lower("query"), F.lower("title")))
    judged = judge.prices(checked.withColumn("odd", odd), price_verdicts)
    good = (F.col("status") == "Success") & ~F.col("odd") & F.col("plausible")
    row = F.struct("stage", "method", "url", "score", *cascade.FIELDS)
    own = F.min_by("status", F.when(F.col("attempt") == 1, F.col("stage"))).alias("own")
    found = judged.groupBy(*GROUP).agg(own, F.min_by(row, F.when(good, F.struct("attempt", "stage"))).alias("found"))
    return found.where("coalesce(own, 'Success') = 'Success' AND found IS NOT NULL").select(*GROUP, "found.*")


def compare(
    queries: DataFrame, plans: DataFrame, captures: DataFrame, references: DataFrame, title_verdicts: DataFrame, price_verdicts: DataFrame, *, discovered: DataFrame | None = None, second: DataFrame | None = None, hooks: Hooks | None = None
) -> DataFrame:
    """Queries ``(query_id, user_query)`` and captures ``(page_id, query_id, website, kind, stage, method, url, http_status, html)``.

    Search captures (kind *serp*, then *refined*) give listings, known pages and
    ``discovered`` ones ``(query_id, website, title, url)`` come after them. The best
    acceptable one that no title verdict refuses is matched; product captures
    (*pdp*) of its address give fields, with what ``extracted`` tries after them.
    Prices are judged and compared with references; outliers are replaced by the
    row of a ``second`` run ``(query_id, website, title, price, ...)`` where there was
    one. ``hooks`` take counts of the stages as they run. Every query has a row for every retailer; a failed row of a known page
    keeps its title and address.

    All joins are done when this returns; what is left is the sort.
    """
    with measured_joins(queries.sparkSession):
        rows = _compared(queries, plans, captures, references, title_verdicts, price_verdicts, discovered, second, hooks)
    return rows.orderBy("query_id", "site_order")


def _compared(queries, plans, captures, references, title_verdicts, price_verdicts, discovered, second, hooks) -> DataFrame:
    planned = checkpointed(watched(hooks, cascade.planned(tables.asked(queries), tables.retailers(queries.sparkSession), plans), "planned"))
    served = tables.usable_captures(captures)
    # what a page is about is joined from its narrow columns, so that its text is read for parsing alone
    about = captures.select("page_id", *GROUP, "kind", "stage", "method", "url", "http_status")
    gone = about.where((F.col("kind") == "pdp") & ~urls.reachable("url", F.col("http_status"))).select("url").distinct()
    valid = candidates(offers(planned, served, about, discovered), title_verdicts, gone)
    valid = checkpointed(watched(hooks, valid, "candidates", gone=F.col("gone"), skipped=F.col("skip"), refused=~F.col("match")))
    match = checkpointed(watched(hooks, matched(valid, looked_through(valid)), "matched"))
    # pages are parsed once: what they give is written before it is joined and judged
    fields = html.product_fields(served.where("kind = 'pdp'"))
    fields = checkpointed(watched(hooks, fields, "fields", rejected=F.col("reject_reason").isNotNull())).drop("website").join(about.select("page_id", *GROUP, "stage", "method", "url"), "page_id")
    found = extracted(valid, match, fields, price_verdicts).withColumn("status", cascade.status("title", "price"))
    known = match.where(F.col("source") == KNOWN).select(*GROUP, F.col("serp_title").alias("known_title"), F.col("url").alias("known_url"))
    rows = cascade.always(planned, found).join(known, GROUP, "left").withColumn("known", F.col("known_url").isNotNull() & (F.col("status") != "Success"))
    rows = rows.withColumn("title", F.when(F.col("known"), F.col("known_title")).otherwise(F.col("title"))).withColumn("url", F.when(F.col("known"), F.col("known_url")).otherwise(F.col("url")))
    rows = cascade.finalised(rows.withColumn("status", F.when(F.col("known"), "Success").otherwise(F.col("status")))).select(*GROUP, "site_order", *cascade.FIELDS, "status", "method", "url")
    expected = references.where(F.col("ref_price") > 0).select(*GROUP, "ref_price")
    far = (F.col("price") > 0) & (parse.gap("price", "ref_price") > fixed.PRICE_GAP)
    rows = rows.join(expected, GROUP, "left").withColumn("price_outlier", F.coalesce(far, F.lit(False))).drop("ref_price")
    if second is not None:
        rows = cascade.second_pass(rows, expected, second)
    # a sort reads its input twice, so the rows are written before it
    rows = checkpointed(watched(hooks, rows, "rows", succeeded=F.col("status") == "Success", outliers=F.col("price_outlier")))
    return rows.withColumn("trust_label", judge.trust("average_rating", "review_count")).select(
        "query_id", "site_order", "website", "title", "price", "average_rating", "review_count", "status", "method", "url", "price_outlier", "trust_label"
    )
