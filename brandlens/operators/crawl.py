"""Crawl data: robots rules, sitemaps, frontier, change and duplicate detection, job outcome."""

from __future__ import annotations

import ipaddress
import re
import xml.etree.ElementTree as ET
from collections.abc import Iterator
from urllib.parse import parse_qsl, quote, unquote, urlencode, urlsplit

import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, StringType

MAX_SITEMAP_URLS, MAX_URL = 5000, 2048
# Parameters that crawled URLs lose (another list than that of citations).
CRAWL_TRACKING = "utm_source utm_medium utm_campaign utm_term utm_content utm_id utm_name gclid dclid gbraid wbraid fbclid msclkid ttclid twclid mc_cid mc_eid yclid _ga _gl igshid ref_src spm".split()
CRAWL_TRACKING_PREFIXES = ("utm_", "hsa_", "pk_", "mtm_", "piwik_", "matomo_")


_URL = re.compile(r"(?s)\s*(https?)://([^/?#]*)([^?#]*)(?:\?([^#]*))?(?:#.*)?", re.I)
_KEPT_IN_PATH = "/-._~!$&'()*+,;=:@%"
_KEPT_IN_QUERY = "-._~!$'()*+,;:@/?%"


def _segments(path: str) -> str:
    """The path with ``.`` and ``..`` worked off; ``..`` never climbs above the root."""
    kept: list[str] = []
    for segment in path.split("/"):
        if segment == "..":
            kept[-1:] = []
        elif segment not in ("", "."):
            kept.append(segment)
    return "/" + "/".join(kept)


def _crawl_url(raw: str | None) -> str | None:
    found = _URL.fullmatch((raw or "").strip())
    if found is None or "@" in found[2]:
        return None
    scheme = found[1].lower()
    host, _, port = found[2].partition(":") if not found[2].startswith("[") else (found[2], "", "")
    try:
        host = host.rstrip(".").encode("idna").decode("ascii").lower()
    except UnicodeError:
        return None
    if not host or (port and not (port.isdecimal() and int(port) < 1 << 16)):
        return None
    if port and int(port) != (80 if scheme == "http" else 443):
        host += f":{int(port)}"
    query = sorted(pair for pair in parse_qsl(found[4] or "", keep_blank_values=True) if not (pair[0].lower() in CRAWL_TRACKING or pair[0].lower().startswith(CRAWL_TRACKING_PREFIXES)))
    url = f"{scheme}://{host}{quote(_segments(unquote(found[3])), safe=_KEPT_IN_PATH)}"
    if query:
        url += "?" + urlencode(query, safe=_KEPT_IN_QUERY)
    return url if len(url) <= MAX_URL else None


@F.pandas_udf(StringType())
def normalize_crawl_url(values: pd.Series) -> pd.Series:
    """The crawler's form of a URL: no credentials, dot segments resolved, one coding of characters, no tracking; else null."""
    return values.map(_crawl_url, na_action="ignore").astype(object).where(values.notna(), None)


# Networks that are never fetched, beside private, local, multicast and reserved ones.
NEVER_FETCHED = tuple(ipaddress.ip_network(n) for n in "169.254.169.254/32 100.100.100.200/32 fd00:ec2::254/128 0.0.0.0/8 100.64.0.0/10 192.0.0.0/24 198.18.0.0/15 240.0.0.0/4 ::/128 64:ff9b::/96 fec0::/10".split())


def _public(value: str) -> bool:
    try:
        ip = ipaddress.ip_address(value.strip().strip("[]"))
    except ValueError:
        return False
    ip = getattr(ip, "ipv4_mapped", None) or ip
    special = ip.is_private or ip.is_loopback or ip.is_link_local or ip.is_multicast or ip.is_reserved or ip.is_unspecified
    return not special and not any(ip in n for n in NEVER_FETCHED)


@F.pandas_udf(BooleanType())
def is_public_address(values: pd.Series) -> pd.Series:
    """Whether an address may be fetched: no private, local, reserved, translated or multicast one; anything that is no address is not."""
    return values.map(_public, na_action="ignore").astype(object).where(values.notna(), None)


def robots_rules(files: DataFrame, agent: str = "*") -> DataFrame:
    """Lines that hold for ``agent`` of robots files (robots_key, robots_body): robots_key, n, field, value.

    Agent lines that follow each other open one group together. The groups that name the agent's product count, and only
    where there are none those for ``*``. Sitemap lines belong to no group. Rules are rows: no Python.
    """
    lines = files.select("robots_key", F.posexplode(F.split(F.coalesce("robots_body", F.lit("")), r"\r?\n")).alias("n", "raw"))
    field = F.lower(F.regexp_extract("raw", r"^\s*([A-Za-z-]+)\s*:", 1))
    value = F.trim(F.regexp_replace(F.regexp_extract("raw", r"^\s*[A-Za-z-]+\s*:(.*)$", 1), r"#.*$", ""))
    known = lines.select("robots_key", "n", field.alias("field"), value.alias("value")).where(F.col("field").isin("user-agent", "allow", "disallow", "crawl-delay", "sitemap"))
    order = Window.partitionBy("robots_key").orderBy("n")
    names = F.col("field") == "user-agent"
    opens = names & F.coalesce(F.lag("field").over(order) != "user-agent", F.lit(True))
    grouped = known.where("field <> 'sitemap'").withColumn("opens", opens.cast("int")).withColumn("group", F.sum("opens").over(order.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    token = F.lit(agent.split("/")[0].lower())
    own = names & (F.col("value") != "") & (F.col("value") != "*") & F.contains(token, F.lower("value"))
    group = Window.partitionBy("robots_key", "group")
    marked = grouped.withColumn("own", F.max(own.cast("int")).over(group)).withColumn("any", F.max((names & (F.col("value") == "*")).cast("int")).over(group))
    chosen = marked.withColumn("named", F.max("own").over(Window.partitionBy("robots_key"))).where("field <> 'user-agent' AND CASE WHEN named = 1 THEN own = 1 ELSE any = 1 END")
    return chosen.select("robots_key", "n", "field", "value").unionByName(known.where("field = 'sitemap'"))


def robots_allowed(requests: DataFrame, agent: str = "*") -> DataFrame:
    """``requests`` (robots_status, robots_body, path) with allowed, crawl_delay and sitemaps: the longest fitting rule that
    holds for ``agent``, allow on ties.

    A status of 400 to 499 allows everything, 500 or more or none at all nothing; neither has a delay or sitemaps.
    """
    keyed = requests.withColumn("robots_key", F.xxhash64("robots_status", "robots_body"))
    # one row a file, however many paths are asked for
    rules = robots_rules(keyed.select("robots_key", "robots_body").groupBy("robots_key").agg(F.first("robots_body").alias("robots_body")), agent)
    quoted = F.concat(F.lit("^"), F.replace(F.regexp_replace("value", r"([.?+()\[\]{}^|\\])", r"\\$1"), F.lit("*"), F.lit(".*")))
    paths = keyed.select("robots_key", "path").distinct()
    fits = rules.where(F.col("field").isin("allow", "disallow") & (F.col("value") != "")).withColumn("pattern", quoted).join(paths, "robots_key").where("path rlike pattern")
    best = fits.groupBy("robots_key", "path").agg(F.max(F.struct(F.length("value").alias("n"), (F.col("field") == "allow").alias("allow"))).alias("best"))
    said = rules.groupBy("robots_key").agg(
        F.min(F.when(F.col("field") == "crawl-delay", F.struct("n", F.col("value").try_cast("double").alias("delay"))))["delay"].alias("crawl_delay"),
        F.transform(F.array_sort(F.collect_list(F.when(F.col("field") == "sitemap", F.struct("n", "value")))), lambda x: x["value"]).alias("sitemaps"),
    )
    status, read = F.col("robots_status"), F.col("robots_status") < 400
    allowed = F.when(status.isNull() | (status >= 500), False).when(status >= 400, True).otherwise(F.coalesce("best.allow", F.lit(True)))
    joined = keyed.join(best, ["robots_key", "path"], "left").join(said, "robots_key", "left")
    columns = [F.col(c) for c in requests.columns]
    return joined.select(*columns, allowed.alias("allowed"), F.when(read, F.col("crawl_delay")).alias("crawl_delay"), F.when(read, F.coalesce("sitemaps", F.expr("cast(array() AS array<string>)"))).otherwise(F.expr("cast(array() AS array<string>)")).alias("sitemaps"))


def sitemap_urls(sitemaps: DataFrame) -> DataFrame:
    """(sitemap_url, kind, loc) of sitemaps and sitemap indexes (sitemap_url, xml) on their own host; with a DOCTYPE none.

    At most MAX_SITEMAP_URLS addresses of a sitemap count: the protocol's own bound as the crawler sets it.
    """

    def read(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = []
            for url, xml in b[["sitemap_url", "xml"]].itertuples(index=False):
                if not xml or "<!DOCTYPE" in xml[:2000].upper() or "<!ENTITY" in xml.upper():
                    continue
                try:
                    root = ET.fromstring(xml)
                except ET.ParseError:
                    continue
                kind = "index" if root.tag.rpartition("}")[2] == "sitemapindex" else "page"
                host = urlsplit(url or "").hostname
                found = [(e.text or "").strip() for e in root.iter() if e.tag.rpartition("}")[2] == "loc"]
                rows += [(url, kind, x) for x in found[:MAX_SITEMAP_URLS] if urlsplit(x).hostname == host]
            yield pd.DataFrame(rows, columns=["sitemap_url", "kind", "loc"])

    return sitemaps.select("sitemap_url", "xml").mapInPandas(read, "sitemap_url string, kind string, loc string")


# Endings of files that are no pages.
SKIPPED = "jpg jpeg png gif webp svg ico bmp tiff avif mp4 mp3 avi mov wmv flv webm m4a wav ogg pdf zip gz tar rar 7z dmg exe msi apk bin doc docx xls xlsx ppt pptx css js json xml woff woff2 ttf eot otf".split()
SKIPPED_EXTENSIONS = rf"(?i)\.({'|'.join(SKIPPED)})$"


def frontier(seeds: DataFrame, links: DataFrame, max_depth: int, max_pages: int | None = None) -> DataFrame:
    """(url, depth) of what a crawl admits: breadth first from ``seeds`` (url) over ``links`` (source, target).

    One join a level, each level cut off by a checkpoint. ``max_pages`` is the crawl's budget: the first by depth, then url.
    """
    usable = ~F.col("url").rlike(SKIPPED_EXTENSIONS)
    level = seeds.select("url").where(usable).distinct().withColumn("depth", F.lit(0)).checkpoint()
    seen = level
    for depth in range(1, max_depth + 1):
        fresh = links.join(level.select(F.col("url").alias("source")), "source").select(F.col("target").alias("url")).where(usable).distinct()
        level = fresh.join(seen.select("url"), "url", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        if level.isEmpty():
            break
        seen = seen.unionByName(level)
    return seen if max_pages is None else seen.orderBy("depth", "url").limit(max_pages)


def page_versions(crawls: DataFrame) -> DataFrame:
    """Versions (page_id, crawled_at, content_hash) with changed: whether the content differs from the version before."""
    before = F.lag("content_hash").over(Window.partitionBy("page_id").orderBy("crawled_at"))
    return crawls.withColumn("changed", F.coalesce(before != F.col("content_hash"), before.isNull()))


def duplicate_of(pages: DataFrame) -> DataFrame:
    """Pages (page_id, content_hash, first_crawled_at) with the earliest other page of the same content, or null.

    One aggregate and a join instead of a window: a content that very many pages share is no hot group.
    """
    first = pages.where("content_hash IS NOT NULL").groupBy("content_hash").agg(F.min(F.struct("first_crawled_at", "page_id")).alias("first"))
    joined = pages.join(first, "content_hash", "left")
    return joined.withColumn("duplicate_of", F.when(F.col("first.page_id") != F.col("page_id"), F.col("first.page_id"))).drop("first")


def job_status(cancel_requested: Column, crawled: Column, failed: Column, skipped: Column, seen: Column) -> Column:
    """Outcome of a crawl: failed if no page could be fetched, partial if any failed or was left over."""
    return (
        F.when(cancel_requested, "cancelled")
        .when((crawled == 0) & (failed > 0), "failed")
        .when((failed > 0) | (crawled < seen - skipped), "partially_completed")
        .otherwise("completed")
    )


def language_of(html_lang: Column, metadata: Column, detected: Column, confidence: Column) -> Column:
    """struct<code, source, confidence>: the page's own tag, else its metadata, else what its text shows."""
    tag = lambda c: F.when(F.trim(c).rlike(r"^[A-Za-z]{2,3}([-_][A-Za-z0-9]{2,8})*$"), F.lower(F.regexp_extract(F.trim(c), "^([A-Za-z]+)", 1)))
    own, meta = tag(html_lang), tag(metadata)
    make = lambda code, source, sure: F.struct(code.alias("code"), F.lit(source).alias("source"), sure.alias("confidence"))
    return F.when(own.isNotNull(), make(own, "html_lang", F.lit(1.0))).when(meta.isNotNull(), make(meta, "metadata", F.lit(0.9))).when(detected.isNotNull(), make(detected, "detected", confidence))


_WEBSITE = re.compile(r"^(https?://)?([a-z0-9-]+\.)+[a-z]{2,}(:\d+)?(/\S*)?$", re.I)


def valid_website(url: Column) -> Column:
    """Whether a text reads as a public web address: http(s) or no scheme, a dotted host, no address literal, no credentials."""
    return F.coalesce(F.trim(url).rlike(f"(?i){_WEBSITE.pattern}") & ~F.trim(url).rlike(r"^(https?://)?\d+(\.\d+){3}") & ~url.contains("@"), F.lit(False))
