"""Queries over crawl data and view models, each with its SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.operators import crawl, crawl_order, views, visibility
from brandlens.plans.analytics import LONG, WITH, _metric_ctes, _observed, _windowed, query
from brandlens.shared_files import use_shared_checkpoints
from brandlens.sources.projection import Projection

_RANK = "CASE severity WHEN 'critical' THEN 0 WHEN 'high' THEN 1 WHEN 'medium' THEN 2 WHEN 'low' THEN 3 WHEN 'info' THEN 4 ELSE 9 END"
_ISSUES = "issues AS (SELECT user_id % 3 AS project_id, event_type AS code, CASE event_id % 4 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'low' ELSE 'info' END AS severity, 'u' || (user_id % 20) AS url FROM events)"


def _issues(p: Projection) -> DataFrame:
    kind = F.col("event_id") % 4
    return p.table("events").select((F.col("user_id") % 3).alias("project_id"), F.col("event_type").alias("code"), F.when(kind == 0, "high").when(kind == 1, "medium").when(kind == 2, "low").otherwise("info").alias("severity"), F.concat(F.lit("u"), (F.col("user_id") % 20).cast("string")).alias("url"))


@query(
    "crawl_frontier",
    """WITH RECURSIVE n AS (SELECT count(*) AS n FROM customer), l AS (SELECT 'c' || c_custkey AS source, 'c' || ((c_custkey * 2 + c_nationkey) % n) AS target FROM customer, n UNION ALL SELECT 'c' || c_custkey, 'c' || ((c_custkey * 3) % n) || CASE WHEN c_custkey % 5 = 0 THEN '.pdf' ELSE '' END FROM customer, n),
r AS (SELECT 'c1' AS url, 0 AS depth UNION SELECT target, depth + 1 FROM r JOIN l ON source = url WHERE depth < 5 AND target NOT LIKE '%.pdf')
SELECT url, min(depth) AS depth FROM r GROUP BY url""",
)
def _frontier(p: Projection) -> DataFrame:
    use_shared_checkpoints(p.spark)
    c = p.table("customer")
    n = c.count()
    name = lambda x: F.concat(F.lit("c"), x.cast("string"))
    key = F.col("c_custkey")
    one = c.select(name(key).alias("source"), name((key * 2 + F.col("c_nationkey")) % n).alias("target"))
    two = c.select(name(key).alias("source"), F.concat(name(key * 3 % n), F.when(key % 5 == 0, ".pdf").otherwise("")).alias("target"))
    return crawl.frontier(p.spark.createDataFrame([("c1",)], "url string"), one.unionByName(two), 5)


@query("page_versions", "SELECT user_id AS page_id, event_id, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts) IS DISTINCT FROM event_type AS changed FROM events")
def _versions(p: Projection) -> DataFrame:
    e = p.table("events").select(F.col("user_id").alias("page_id"), F.col("ts").alias("crawled_at"), F.col("event_type").alias("content_hash"), "event_id")
    return crawl.page_versions(e).select("page_id", "event_id", "changed")


@query("page_duplicates", "SELECT doc_id AS page_id, CASE WHEN first <> doc_id THEN first END AS duplicate_of FROM (SELECT doc_id, min(doc_id) OVER (PARTITION BY md5(lower(text))) AS first FROM documents)")
def _duplicates(p: Projection) -> DataFrame:
    d = p.table("documents").select(F.col("doc_id").alias("page_id"), F.md5(F.lower("text").cast("binary")).alias("content_hash"), F.col("doc_id").alias("first_crawled_at"))
    return crawl.duplicate_of(d).select("page_id", "duplicate_of")


@query(
    "crawl_job_status",
    """SELECT o_custkey AS job_id, CASE WHEN o_custkey % 11 = 0 THEN 'cancelled' WHEN crawled = 0 AND failed > 0 THEN 'failed' WHEN failed > 0 OR crawled < seen - skipped THEN 'partially_completed' ELSE 'completed' END AS status
FROM (SELECT o_custkey, count(*) FILTER (WHERE o_orderstatus = 'F') AS crawled, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS skipped, count(*) AS seen FROM orders GROUP BY 1)""",
)
def _jobs(p: Projection) -> DataFrame:
    o = F.col("o_orderstatus")
    g = p.table("orders").groupBy("o_custkey").agg(F.count_if(o == "F").alias("crawled"), F.count_if(o == "P").alias("failed"), F.count_if((o == "O") & (F.col("o_orderkey") % 2 == 0)).alias("skipped"), F.count("*").alias("seen"))
    return g.select(F.col("o_custkey").alias("job_id"), crawl.job_status(F.col("o_custkey") % 11 == 0, F.col("crawled"), F.col("failed"), F.col("skipped"), F.col("seen")).alias("status"))


@query(
    "crawl_url_normalize",
    f"""WITH a AS (SELECT page_id, regexp_extract(url, '^([a-z]+)://', 1) AS scheme, regexp_replace(regexp_replace(url, '^[a-z]+://', ''), '#.*$', '') AS rest FROM pages),
b AS (SELECT *, lower(regexp_extract(rest, '^([^/?]*)', 1)) AS host, regexp_replace(regexp_extract(rest, '^[^/?]*(/[^?]*)?', 1), '/+$', '') AS path, CASE WHEN contains(rest, '?') THEN substr(rest, strpos(rest, '?') + 1) ELSE '' END AS q FROM a),
c AS (SELECT *, list_sort(list_filter(string_split(q, '&'), lambda x: x <> '' AND split_part(x, '=', 1) NOT IN ({", ".join(f"'{t}'" for t in crawl.CRAWL_TRACKING)}))) AS kept FROM b)
SELECT page_id, scheme || '://' || host || CASE WHEN path = '' THEN '/' ELSE path END || CASE WHEN len(kept) > 0 THEN '?' || array_to_string(kept, '&') ELSE '' END AS url FROM c""",
)
def _crawl_urls(p: Projection) -> DataFrame:
    return p.table("pages").select("page_id", crawl.normalize_crawl_url("url").alias("url"))


@query("view_engine_rows", f"{WITH}{_windowed(LONG)}{_metric_ctes('project_id, provider')} SELECT project_id, provider, score, sample_size, CAST(row_number() OVER (PARTITION BY project_id ORDER BY coalesce(score, -1) DESC, provider) AS INTEGER) AS rank FROM metrics")
def _engines(p: Projection) -> DataFrame:
    return views.engine_rows(visibility.metric_block(_observed(p, LONG), ["project_id", "provider"])).select("project_id", "provider", "score", "sample_size", "rank")


@query("view_measured_zero", f"{WITH}{_windowed(LONG)}{_metric_ctes('project_id, prompt_id')} SELECT project_id, prompt_id, sample_size FROM metrics WHERE mention_rate = 0 AND sample_size > 0")
def _zero(p: Projection) -> DataFrame:
    rows = visibility.metric_block(_observed(p, LONG), ["project_id", "prompt_id"])
    return views.measured_zero(rows.withColumn("score", F.col("mention_rate"))).select("project_id", "prompt_id", "sample_size")


@query(
    "view_collapsed_prompts",
    f"""{WITH}{_windowed(LONG)}{_metric_ctes('project_id, prompt_id')} SELECT project_id, prompt_id % 50 AS text_id, CAST(sum(sample_size) AS BIGINT) AS sample_size, count(*) AS prompts, round_even(sum(mention_rate * sample_size) / nullif(sum(CASE WHEN mention_rate IS NOT NULL THEN sample_size END), 0), 4) AS mention_rate,
  round_even(sum(average_position * sample_size) / nullif(sum(CASE WHEN average_position IS NOT NULL THEN sample_size END), 0), 4) AS average_position FROM metrics GROUP BY 1, 2""",
)
def _collapsed(p: Projection) -> DataFrame:
    rows = visibility.metric_block(_observed(p, LONG), ["project_id", "prompt_id"]).withColumn("text_id", F.col("prompt_id") % 50)
    return views.collapse_prompts(rows, ["project_id", "text_id"], ["mention_rate", "average_position"])


@query(
    "view_priority_opportunities",
    f"WITH {_ISSUES}, g AS (SELECT project_id, code, min({_RANK}) AS severity_rank, count(*) AS reach FROM issues GROUP BY 1, 2) SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY severity_rank, reach DESC, code) AS INTEGER) AS rank FROM g) WHERE rank <= 4",
)
def _opportunities(p: Projection) -> DataFrame:
    return views.priority_opportunities(_issues(p))


@query("view_issue_list", f"WITH {_ISSUES} SELECT * FROM issues WHERE severity = 'high' AND (contains(code, 'u') OR contains(url, 'u'))")
def _issue_list(p: Projection) -> DataFrame:
    return views.issue_list(_issues(p), severity="high", text="U")


@query("view_daily_events", "SELECT date_trunc('day', ts) AS day, event_type, count(*) AS events, min(ts) AS first_at, count(*) >= 2 AS collapsed FROM events GROUP BY 1, 2")
def _daily(p: Projection) -> DataFrame:
    return views.daily_events(p.table("events"), "ts").withColumn("day", F.col("day").cast("timestamp_ntz"))


@query("view_metric_changes", "SELECT user_id AS project_id, event_id, round_even(v - last_value(v IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 1) AS change FROM (SELECT *, CASE WHEN event_id % 3 <> 0 THEN round(value) END AS v FROM events)")
def _metric_change(p: Projection) -> DataFrame:
    audits = p.table("events").select(F.col("user_id").alias("project_id"), "event_id", F.col("ts").alias("completed_at"), F.when(F.col("event_id") % 3 != 0, F.round("value")).alias("score"))
    return views.metric_changes(audits, "score").select("project_id", "event_id", "change")


@query("workflow_action_plan", "SELECT workflow_id, sequence, CAST(row_number() OVER (PARTITION BY workflow_id ORDER BY CASE risk WHEN 'low' THEN 0 WHEN 'medium' THEN 1 ELSE 2 END, sequence) AS INTEGER) AS rank FROM (SELECT l_orderkey AS workflow_id, l_linenumber AS sequence, CASE l_returnflag WHEN 'A' THEN 'low' WHEN 'N' THEN 'medium' ELSE 'high' END AS risk FROM lineitem)")
def _plan(p: Projection) -> DataFrame:
    flag = F.col("l_returnflag")
    actions = p.table("lineitem").select(F.col("l_orderkey").alias("workflow_id"), F.col("l_linenumber").alias("sequence"), F.when(flag == "A", "low").when(flag == "N", "medium").otherwise("high").alias("risk"))
    return views.action_plan(actions).select("workflow_id", "sequence", "rank")


def _site_url(key: Column) -> Column:
    return F.concat(F.lit("https://s"), (key % 5).cast("string"), F.lit(".example/c"), key.cast("string"))


@query("crawl_best_first", None)
def _best_first(p: Projection) -> DataFrame:
    """Five crawls with budgets over links between customers; the order equals a heap's, which SQL has none of: tested against one."""
    c, key = p.table("customer"), F.col("c_custkey")
    n = c.count()
    targets = F.array(
        *[F.struct(_site_url(key % 5 + 5 * i).alias("target"), F.lit(True).alias("in_navigation")) for i in range(1, 4)],
        F.struct(_site_url((key * 2 + F.col("c_nationkey")) % n).alias("target"), F.lit(False).alias("in_navigation")),
        F.struct(F.concat(_site_url(key + 5), F.when(key % 7 == 0, ".pdf").otherwise("")).alias("target"), F.lit(False).alias("in_navigation")),
    )
    links = c.select(_site_url(key).alias("source"), F.posexplode(targets).alias("position", "t")).select("source", "t.target", "position", "t.in_navigation", F.lit(False).alias("nofollow"))
    sites = p.table("region").select(F.col("r_regionkey").cast("bigint").alias("crawl_id"))
    crawls = sites.select("crawl_id", F.array(F.concat(F.lit("s"), F.col("crawl_id").cast("string"), F.lit(".example"))).alias("hosts"), (F.col("crawl_id") % 2 == 0).alias("allow_subdomains"), F.lit(6).alias("max_depth"), (F.col("crawl_id") * 40 + 60).cast("int").alias("max_pages"))
    seeds = sites.select("crawl_id", _site_url(F.col("crawl_id") + 5).alias("url"), F.lit(0).alias("position"), F.lit(True).alias("is_root"))
    return crawl_order.best_first(crawls, seeds, links)


@query(
    "crawl_sitemap_pages",
    """WITH u AS (SELECT c_custkey AS k, c_custkey % 5 AS site, (c_custkey // 5) % 25 AS f FROM customer),
o AS (SELECT site, k, row_number() OVER (PARTITION BY site ORDER BY f, k) - 1 AS n FROM u WHERE f < 19)
SELECT site AS crawl_id, n, 'https://s' || site || '.example/c' || k AS loc FROM o WHERE n < 5000""",
)
def _sitemap_pages(p: Projection) -> DataFrame:
    """Each site has an index of 25 sitemaps; a crawl reads the index and the first 19."""
    key = F.col("c_custkey")
    site, head = F.concat(F.lit("https://s"), (key % 5).cast("string"), F.lit(".example")), 'xmlns="http://www.sitemaps.org/schemas/sitemap/0.9"'
    loc = lambda x, tag: F.concat(F.lit(f"<{tag}><loc>"), x, F.lit(f"</loc></{tag}>"))
    pages = p.table("customer").select(site.alias("site"), F.floor(key / 5 % 25).alias("f"), key.alias("k"))
    listed = pages.groupBy("site", "f").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("k", "site"))), lambda x: loc(_site_url(x["k"]), "url")), "").alias("urls"))
    maps = listed.select(F.concat("site", F.lit("/m"), F.col("f").cast("string"), F.lit(".xml")).alias("sitemap_url"), F.concat(F.lit(f"<urlset {head}>"), "urls", F.lit("</urlset>")).alias("xml"))
    entries = F.array_join(F.transform(F.sequence(F.lit(0), F.lit(24)), lambda i: loc(F.concat("site", F.lit("/m"), i.cast("string"), F.lit(".xml")), "sitemap")), "")
    index = pages.select("site").distinct().select(F.concat("site", F.lit("/sitemap.xml")).alias("sitemap_url"), F.concat(F.lit(f"<sitemapindex {head}>"), entries, F.lit("</sitemapindex>")).alias("xml"))
    crawls = pages.select("site").distinct().select(F.substring("site", 10, 1).cast("bigint").alias("crawl_id"), F.col("site").alias("origin"), F.expr("cast(array() AS array<string>)").alias("candidates"))
    return crawl_order.sitemap_pages(crawls, maps.unionByName(index))
