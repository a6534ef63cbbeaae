"""What crawls fetch, in their order: best-first expansion under budgets, and sitemap indexes.

All crawls advance together, one batch of each in a round. A crawl's state is bounded by its page budget, so windows are
per crawl; links and documents are only ever joined. The results equal those of one queue for each crawl, one page at a time.
"""

from __future__ import annotations

import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.operators.crawl import MAX_SITEMAP_URLS, SKIPPED_EXTENSIONS
from brandlens.shared_files import use_shared_checkpoints

# What is fetched first, and how many sitemaps a crawl reads.
HOMEPAGE, SITEMAP, NAVIGATION, CONTENT = 0, 1, 2, 3
MAX_SITEMAPS = 20
_SITEMAPS = "{http://www.sitemaps.org/schemas/sitemap/0.9}"


def url_host(url: Column) -> Column:
    """The host of an address, lower-case, without www."""
    return F.regexp_replace(F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1)), r"^www\.", "")


def _allowed(url: Column) -> Column:
    host = url_host(url)
    apex = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    return F.exists("hosts", lambda h: (host == apex(h)) | (F.col("allow_subdomains") & host.endswith(F.concat(F.lit("."), apex(h)))))


def best_first(crawls: DataFrame, seeds: DataFrame, links: DataFrame, canonicals: DataFrame | None = None) -> DataFrame:
    """crawl_id, url, parent_url, depth, priority, arrival (from 0), status (queued or skipped), processed (order of fetching, null if skipped).

    ``crawls``: crawl_id, hosts, allow_subdomains, max_depth, max_pages; ``seeds``: crawl_id, url, position, is_root (the
    root at depth 0, others are sitemap entries at depth 1); ``links``: source, target, position, in_navigation, nofollow;
    ``canonicals``: source, target. A crawl fetches by priority, depth and arrival; an address is admitted once, by its
    first finder, while the budget lasts, on allowed hosts and to the greatest depth; files by their ending are admitted
    and skipped. A page's links are found in order, then its canonical address at the page's own depth.

    A round takes all pages of a crawl that are equal in priority and depth, as what they find comes after them. Only
    navigation found on a content page comes before other content pages: there the batch ends with the first page that
    has some not seen yet.
    """
    spark = crawls.sparkSession
    use_shared_checkpoints(spark)
    out = links.where("NOT nofollow").select("source", "target", F.lit(0).alias("kind"), "position", F.when(F.col("in_navigation"), NAVIGATION).otherwise(CONTENT).alias("child_priority"))
    if canonicals is not None:
        own = canonicals.where("source <> target")
        out = out.unionByName(own.select("source", "target", F.lit(1).alias("kind"), F.lit(0).cast("int").alias("position"), F.lit(CONTENT).alias("child_priority")))
    status = F.when(F.regexp_extract("url", r"(?i)^https?://[^/?#]*([^?#]*)", 1).rlike(SKIPPED_EXTENSIONS), "skipped").otherwise("queued").alias("status")
    columns = ["crawl_id", "url", "parent_url", "depth", "priority", "arrival", "status", "processed"]

    def numbered(found: DataFrame, order: list[str], base: Column) -> DataFrame:
        """The first finder of each address, numbered on within the budget."""
        first = found.groupBy("crawl_id", "url").agg(F.min(F.struct(*order, "parent_url", "depth", "priority")).alias("f")).select("crawl_id", "url", "f.*")
        ranked = first.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy(*order)))
        limited = ranked.join(bases, "crawl_id").withColumn("arrival", base + F.col("n") - 1).where("arrival < max_pages")
        return limited.withColumn("processed", F.lit(None).cast("bigint")).select("crawl_id", "url", "parent_url", "depth", "priority", F.col("arrival").cast("bigint").alias("arrival"), status, "processed")

    bases = crawls.select("crawl_id", "max_pages", F.lit(0).alias("base"))
    start = seeds.join(crawls, "crawl_id").where(_allowed(F.col("url")) & (F.col("is_root") | (F.col("max_depth") >= 1)))
    start = start.select("crawl_id", "url", F.lit(None).cast("string").alias("parent_url"), F.when(F.col("is_root"), 0).otherwise(1).alias("depth"), F.when(F.col("is_root"), HOMEPAGE).otherwise(SITEMAP).alias("priority"), (~F.col("is_root")).alias("later"), "position")
    state = numbered(start, ["later", "position"], F.col("base")).checkpoint()
    while True:
        waiting = state.where("processed IS NULL AND status = 'queued'")
        front = waiting.groupBy("crawl_id").agg(F.min(F.struct("priority", "depth")).alias("front"))
        batch = waiting.join(front, "crawl_id").where("priority = front.priority AND depth = front.depth").drop("front").checkpoint()
        if batch.isEmpty():
            return state.select(columns)
        # pages at the greatest depth are fetched, but nothing is followed from them
        parents = batch.select("crawl_id", F.col("url").alias("source"), F.col("depth").alias("parent_depth"), F.col("priority").alias("parent_priority"), F.col("arrival").alias("parent_arrival"))
        found = parents.join(out, "source").join(crawls, "crawl_id").where(F.col("parent_depth") < F.col("max_depth"))
        found = found.select(
            "crawl_id", F.col("target").alias("url"), F.col("source").alias("parent_url"), (F.col("parent_depth") + 1 - F.col("kind")).alias("depth"), F.col("child_priority").alias("priority"),
            "parent_arrival", "parent_priority", "kind", "position", _allowed(F.col("target")).alias("ok"),
        ).where("ok")
        fresh = found.join(state.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").checkpoint()
        ends = fresh.where((F.col("parent_priority") == CONTENT) & (F.col("priority") == NAVIGATION)).groupBy("crawl_id").agg(F.min("parent_arrival").alias("last"))
        sizes = state.groupBy("crawl_id").agg(F.count("*").alias("base"), F.count("processed").alias("done"))
        bases = crawls.select("crawl_id", "max_pages").join(sizes, "crawl_id")
        taken = fresh.join(ends, "crawl_id", "left").where("last IS NULL OR parent_arrival <= last")
        new = numbered(taken, ["parent_arrival", "kind", "position"], F.col("base"))
        order = F.row_number().over(Window.partitionBy("crawl_id").orderBy("arrival"))
        done = batch.select("crawl_id", "url", "arrival").join(ends, "crawl_id", "left").where("last IS NULL OR arrival <= last").withColumn("n", order).join(sizes.select("crawl_id", "done"), "crawl_id")
        marked = state.join(done.select("crawl_id", "url", (F.col("done") + F.col("n") - 1).alias("now")), ["crawl_id", "url"], "left").withColumn("processed", F.coalesce("processed", F.col("now").cast("bigint")))
        state = marked.select(columns).unionByName(new).checkpoint()


def sitemap_entries(documents: DataFrame) -> DataFrame:
    """sitemap_url, kind (index or page), position, loc of sitemaps (sitemap_url, xml); broken ones and those with a DOCTYPE or entities have none."""

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, xml in b[["sitemap_url", "xml"]].itertuples(index=False):
                if not xml or "<!DOCTYPE" in xml[:4096] or "<!ENTITY" in xml:
                    continue
                try:
                    root = ET.fromstring(xml)
                except (ET.ParseError, ValueError):
                    continue
                kind = {f"{_SITEMAPS}sitemapindex": "index", f"{_SITEMAPS}urlset": "page"}.get(root.tag)
                if kind:
                    said = [(e.text or "").strip() for e in root.iter(f"{_SITEMAPS}loc") if e.text]
                    rows += [(url, kind, i, x) for i, x in enumerate(said[:MAX_SITEMAP_URLS] if kind == "page" else said)]
            yield pd.DataFrame(rows, columns=["sitemap_url", "kind", "position", "loc"])

    return documents.select("sitemap_url", "xml").mapInPandas(read, "sitemap_url string, kind string, position int, loc string")


def sitemap_pages(crawls: DataFrame, documents: DataFrame, max_sitemaps: int = MAX_SITEMAPS, limit: int = MAX_SITEMAP_URLS) -> DataFrame:
    """crawl_id, n (from 0), loc: the addresses that the sitemaps of each crawl list, in order, ``limit`` at most.

    ``crawls``: crawl_id, origin, candidates (sitemaps that robots.txt names, in order); the origin's /sitemap.xml comes
    after them. Sitemaps are read first in, first out, an index adding its entries at the end; each once, on the origin's
    own host, ``max_sitemaps`` in all, whether or not there is a document (sitemap_url, xml) for it. Repeated documents
    of an address count once.
    """
    use_shared_checkpoints(crawls.sparkSession)
    origin_host = F.lower(F.regexp_extract("origin", r"(?i)^https?://([^/:?#]+)", 1))
    asked = F.concat(F.coalesce("candidates", F.expr("cast(array() AS array<string>)")), F.array(F.concat("origin", F.lit("/sitemap.xml"))))
    queue = crawls.select("crawl_id", F.posexplode(asked).alias("position", "url"), F.lit(0).cast("bigint").alias("parent"))
    hosts = crawls.select("crawl_id", origin_host.alias("host"))
    known = documents.groupBy("sitemap_url").agg(F.min("xml").alias("xml"))
    reached: DataFrame | None = None
    entries: list[DataFrame] = []
    for _ in range(max_sitemaps):
        own = queue.join(hosts, "crawl_id").where(F.lower(F.regexp_extract(F.trim("url"), r"(?i)^https?://([^/:?#]+)", 1)) == F.col("host"))
        fresh = own.groupBy("crawl_id", F.trim("url").alias("url")).agg(F.min(F.struct("parent", "position")).alias("place"))
        if reached is not None:
            fresh = fresh.join(reached.select("crawl_id", "url"), ["crawl_id", "url"], "left_anti").join(reached.groupBy("crawl_id").agg(F.count("*").alias("had")), "crawl_id", "left")
        else:
            fresh = fresh.withColumn("had", F.lit(0))
        n = F.coalesce("had", F.lit(0)) + F.row_number().over(Window.partitionBy("crawl_id").orderBy("place")) - 1
        level = fresh.withColumn("n", n.cast("bigint")).where(F.col("n") < max_sitemaps).select("crawl_id", "url", "n").checkpoint()
        if level.isEmpty():
            break
        reached = level if reached is None else reached.unionByName(level)
        read = sitemap_entries(known.join(level.select(F.col("url").alias("sitemap_url")).distinct(), "sitemap_url", "left_semi"))
        found = level.join(read, F.col("url") == F.col("sitemap_url")).select("crawl_id", F.col("n").alias("parent"), "kind", "position", "loc").checkpoint()
        entries.append(found.where("kind = 'page'"))
        queue = found.where("kind = 'index'").select("crawl_id", "position", F.col("loc").alias("url"), "parent")
    every = entries[0] if entries else queue.limit(0).select("crawl_id", "parent", F.lit("page").alias("kind"), "position", F.col("url").alias("loc"))
    for part in entries[1:]:
        every = every.unionByName(part)
    ranked = every.withColumn("n", F.row_number().over(Window.partitionBy("crawl_id").orderBy("parent", "position")) - 1)
    return ranked.where(F.col("n") < limit).select("crawl_id", F.col("n").cast("bigint").alias("n"), "loc")
