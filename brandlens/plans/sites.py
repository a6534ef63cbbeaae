"""Queries over crawled pages: facts, audit, readiness, structured data; each with its SQL where SQL can read the markup."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators import entities, entity_graph, site_audit, specificity
from brandlens.plans.analytics import query
from brandlens.sources.pages import parse_pages
from brandlens.sources.projection import Projection

_ENTITY = lambda x: f"replace(replace(replace({x}, '&quot;', '\"'), '&lt;', '<'), '&amp;', '&')"
_TITLE = f"trim(regexp_replace({_ENTITY(chr(34) + 'raw_title' + chr(34))}, '\\s+', ' ', 'g'))"
_RAW = "regexp_extract(html, '(?s)<title>(.*?)</title>', 1) AS raw_title, regexp_extract(html, '(?s)<h1>(.*?)</h1>', 1) AS raw_h1, regexp_extract(html, '<html lang=\"([^\"]*)\"', 1) AS lang"
#: References without a semicolon are read by parsers in ways that SQL can't copy: these pages are compared by other columns.
_BROKEN = "regexp_matches({c}, '&[a-zA-Z]+($|[^a-zA-Z;])')"


def _facts(p: Projection) -> DataFrame:
    return parse_pages(p.table("pages"))


@query(
    "page_facts",
    """SELECT page_id, regexp_extract(html, '<html lang="([^"]*)"', 1) AS lang, len(regexp_extract_all(html, '<h1>')) AS h1_count, len(regexp_extract_all(html, '<a href="')) AS links, len(regexp_extract_all(html, '<title>')) AS title_count,
  strlen(html) AS html_bytes, starts_with(lower(html), '<!doctype') AS has_doctype, nullif(regexp_extract(html, '<meta charset="([^"]*)"', 1), '') AS charset FROM pages""",
)
def _page_facts(p: Projection) -> DataFrame:
    return _facts(p).select("page_id", "lang", F.size(F.filter("headings", lambda h: h["level"] == 1)).alias("h1_count"), F.size("links").alias("links"), "title_count", "html_bytes", "has_doctype", "charset")


@query("page_titles", f"SELECT page_id, CASE WHEN {_BROKEN.format(c='raw_title')} THEN NULL ELSE {_TITLE} END AS title FROM (SELECT page_id, {_RAW} FROM pages)")
def _titles(p: Projection) -> DataFrame:
    raw = F.regexp_extract("html", "(?s)<title>(.*?)</title>", 1)
    pages = p.table("pages")
    broken = pages.select("page_id", raw.rlike("&[a-zA-Z]+($|[^a-zA-Z;])").alias("broken"))
    return _facts(p).join(broken, "page_id").select("page_id", F.when(~F.col("broken"), F.col("title")).alias("title"))


@query("page_titles_all", None)
def _all_titles(p: Projection) -> DataFrame:
    """The parsed title of every page, also where SQL can't decode it."""
    return _facts(p).select("page_id", "title")


@query("page_links", """SELECT page_id, u[1] AS href, CAST(n AS INTEGER) AS position FROM (SELECT page_id, unnest(list_zip(regexp_extract_all(html, '<a href="([^"]*)"', 1), range(1, 1000)[1:len(regexp_extract_all(html, '<a href="'))])) AS u, u[2] AS n FROM pages)""")
def _links(p: Projection) -> DataFrame:
    return _facts(p).select("page_id", F.explode("links").alias("l")).select("page_id", F.col("l.href").alias("href"), F.col("l.position").alias("position"))


@query("page_headings", "SELECT page_id, n AS position, 1 AS level, CAST(NULL AS INTEGER) AS parent_position FROM (SELECT page_id, unnest(range(1, 1 + len(regexp_extract_all(html, '<h1>')))) AS n FROM pages)")
def _headings(p: Projection) -> DataFrame:
    return site_audit.heading_parents(_facts(p)).drop("text")


_FOUND = f"""f AS (SELECT page_id, {_TITLE} AS t, lang, raw_title FROM (SELECT page_id, {_RAW} FROM pages)),
fd AS (SELECT page_id, 'description_missing' AS code, 'medium' AS severity, 'metadata' AS category FROM f UNION ALL SELECT page_id, 'canonical_missing', 'low', 'canonicalization' FROM f UNION ALL SELECT page_id, 'viewport_missing', 'medium', 'mobile_html' FROM f
  UNION ALL SELECT page_id, 'structured_data_missing', 'low', 'structured_data' FROM f UNION ALL SELECT page_id, 'title_missing', 'high', 'metadata' FROM f WHERE t = '' UNION ALL SELECT page_id, 'title_too_long', 'low', 'metadata' FROM f WHERE length(t) > 90
  UNION ALL SELECT page_id, 'title_long', 'info', 'metadata' FROM f WHERE length(t) > 60 AND length(t) <= 90 UNION ALL SELECT page_id, 'title_too_short', 'low', 'metadata' FROM f WHERE length(t) < 15 AND t <> '')"""


@query("seo_findings", f"WITH {_FOUND} SELECT code, severity, category, count(*) AS pages FROM fd GROUP BY 1, 2, 3")
def _findings(p: Projection) -> DataFrame:
    return site_audit.findings(site_audit.page_snapshot(_facts(p))).groupBy("code", "severity", "category").agg(F.count("*").alias("pages"))


@query("seo_duplicate_titles", None)
def _duplicates(p: Projection) -> DataFrame:
    return site_audit.duplicate_titles(site_audit.page_snapshot(_facts(p)))


@query(
    "seo_orphans",
    """WITH p AS (SELECT page_id, regexp_replace(url, '[?#].*$', '') AS norm, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, html FROM pages),
h AS (SELECT DISTINCT page_id AS source, origin || unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS norm FROM p),
g AS (SELECT p.page_id, count(DISTINCT CASE WHEN h.source <> p.page_id THEN h.source END) AS n FROM p LEFT JOIN h USING (norm) GROUP BY 1)
SELECT CASE WHEN n = 0 THEN 'orphan_pages' WHEN n < 2 THEN 'few_internal_links' ELSE 'linked' END AS code, count(*) AS pages FROM g GROUP BY 1""",
)
def _orphans(p: Projection) -> DataFrame:
    return site_audit.link_graph(_facts(p), F.regexp_replace("url", r"[?#].*$", "")).groupBy(F.coalesce("code", F.lit("linked")).alias("code")).agg(F.count("*").alias("pages"))


@query(
    "seo_health_score",
    f"""WITH {_FOUND}, n AS (SELECT count(*) AS n FROM pages), g AS (SELECT code, severity, category, count(*) AS affected FROM fd GROUP BY 1, 2, 3),
d AS (SELECT category, sum(round_even(CASE severity WHEN 'critical' THEN 25.0 WHEN 'high' THEN 12.0 WHEN 'medium' THEN 6.0 WHEN 'low' THEN 2.0 ELSE 0.0 END * greatest(0.25, least(1.0, CAST(affected AS DOUBLE) / n)), 3)) AS raw FROM g, n GROUP BY 1),
a AS (SELECT round_even(least(raw, CASE category WHEN 'canonicalization' THEN 15.0 WHEN 'metadata' THEN 15.0 WHEN 'mobile_html' THEN 10.0 WHEN 'structured_data' THEN 5.0 END), 2) AS applied FROM d)
SELECT 'site' AS site, round_even(greatest(0.0, 100.0 - sum(applied)), 1) AS score, count(*) AS categories FROM a""",
)
def _health(p: Projection) -> DataFrame:
    found = site_audit.findings(site_audit.page_snapshot(_facts(p))).groupBy("code", "severity", "category").agg(F.count("*").alias("affected")).withColumn("site", F.lit("site"))
    n = p.table("pages").agg(F.count("*").alias("n"))
    # one row: a scalar that joins every finding
    return site_audit.health_score(found.withColumn("k", F.lit(1)).join(F.broadcast(n.withColumn("k", F.lit(1))), "k"), F.col("n"))


_NORM = "regexp_replace({u}, '[?#].*$', '')"
_EDGES = f"""p AS (SELECT page_id, url, {_NORM.format(u="url")} AS norm, regexp_extract(url, '^([a-z]+://[^/?#]+)', 1) AS origin, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS site, html FROM pages),
h AS (SELECT DISTINCT page_id AS source, {_NORM.format(u="origin || href")} AS norm FROM (SELECT page_id, origin, unnest(regexp_extract_all(html, '<a href="([^"]*)"', 1)) AS href FROM p)),
edges AS (SELECT DISTINCT source, page_id AS target FROM h JOIN p USING (norm) WHERE source <> page_id),
homes AS (SELECT arg_min(page_id, (CASE WHEN regexp_extract(url, '^[a-z]+://[^/?#]*([^?#]*)', 1) IN ('', '/') THEN 0 ELSE 1 END, page_id)) AS page_id FROM p GROUP BY site)"""


def _norm():
    return F.regexp_replace("url", r"[?#].*$", "")


#: Pages get headings after their own by their number: a skipped level, a text said twice, a long one, or none.
_MORE_HEADINGS = ("<h3>Deep</h3>", "<h2>Same</h2><h3>and</h3><h2> same</h2>", f"<h2>{'long ' * 15}</h2>", "<h2>Fine</h2>")


@query(
    "seo_heading_findings",
    """SELECT page_id, CASE page_id % 4 WHEN 0 THEN 'heading_hierarchy_skipped' WHEN 1 THEN 'heading_duplicate' ELSE 'heading_too_long' END AS code, CASE page_id % 4 WHEN 0 THEN 'low' ELSE 'info' END AS severity, 'headings' AS category
FROM pages WHERE page_id % 4 < 3 AND len(regexp_extract_all(html, '<h[1-6]>')) = 1""",
)
def _heading_findings(p: Projection) -> DataFrame:
    more = F.get(F.array(*[F.lit(h) for h in _MORE_HEADINGS]), (F.col("page_id") % 4).cast("int"))
    one = F.regexp_count("html", F.lit("<h[1-6]>")) == 1
    pages = p.table("pages").where(one).withColumn("html", F.concat("html", more))
    return site_audit.heading_findings(site_audit.page_snapshot(parse_pages(pages)))


#: Pages are given a canonical by their number: their own address, the next page's, another site's, or none; answers too.
_CANON = """c AS (SELECT page_id, url, CASE page_id % 5 WHEN 0 THEN url WHEN 1 THEN 'https://www.elsewhere.example/' || page_id WHEN 2 THEN regexp_replace(url, '[?#].*$', '') || '?canonical' WHEN 3 THEN lead(url) OVER (ORDER BY page_id) END AS canonical,
  CASE WHEN page_id % 9 = 4 THEN 404 ELSE 200 END AS status FROM pages),
s AS (SELECT *, regexp_replace(regexp_extract(lower(url), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS own_host, regexp_replace(regexp_extract(lower(canonical), '^[a-z]+://([^/:?#]+)', 1), '^www\\.', '') AS dest FROM c),
t AS (SELECT url AS target, arg_min(coalesce(canonical, ''), page_id) AS next, arg_min(status, page_id) AS answer FROM c GROUP BY 1),
k AS (SELECT page_id, CASE WHEN canonical IS NULL THEN 'canonical_missing' WHEN dest <> own_host AND NOT ends_with(dest, '.' || own_host) THEN 'canonical_external' WHEN canonical = url THEN NULL WHEN next <> '' AND next <> target THEN 'canonical_chain'
  WHEN answer <> 200 THEN 'canonical_target_not_ok' ELSE 'canonical_mismatch' END AS code FROM s LEFT JOIN t ON target = canonical)"""


@query(
    "seo_canonical_findings",
    f"WITH {_CANON} SELECT page_id, code, CASE WHEN code IN ('canonical_external', 'canonical_target_not_ok') THEN 'high' WHEN code = 'canonical_chain' THEN 'medium' WHEN code = 'canonical_missing' THEN 'low' ELSE 'info' END AS severity, 'canonicalization' AS category FROM k WHERE code IS NOT NULL",
)
def _canonical_findings(p: Projection) -> DataFrame:
    pages = p.table("pages").select("page_id", "url")
    follower = pages.select((F.col("page_id") - 1).alias("page_id"), F.col("url").alias("next_url"))
    k = F.col("page_id") % 5
    canonical = F.when(k == 0, F.col("url")).when(k == 1, F.concat(F.lit("https://www.elsewhere.example/"), F.col("page_id").cast("string"))).when(k == 2, F.concat(_norm(), F.lit("?canonical"))).when(k == 3, F.col("next_url"))
    rows = pages.join(follower, "page_id", "left").select("page_id", "url", canonical.alias("canonical"), F.when(F.col("page_id") % 9 == 4, 404).otherwise(200).alias("http_status"))
    snapshot = rows.withColumn("canonical_count", F.col("canonical").isNotNull().cast("int")).withColumn("noindex", F.lit(False))
    return site_audit.canonical_findings(snapshot, "http_status")


@query(
    "seo_link_findings",
    f"""WITH RECURSIVE {_EDGES}, b AS (SELECT page_id, 0 AS depth FROM homes UNION SELECT target, depth + 1 FROM b JOIN edges ON source = page_id WHERE depth < 12), d AS (SELECT page_id, min(depth) AS depth FROM b GROUP BY 1),
n AS (SELECT p.page_id, count(source) AS n FROM p LEFT JOIN edges ON target = p.page_id WHERE p.page_id NOT IN (SELECT page_id FROM homes) GROUP BY 1)
SELECT CASE n WHEN 0 THEN 'orphan_pages' ELSE 'few_internal_links' END AS code, CASE n WHEN 0 THEN 'medium' ELSE 'low' END AS severity, 'internal_links' AS category, page_id FROM n WHERE n < 2
UNION ALL SELECT 'excessive_link_depth', 'low', 'internal_links', page_id FROM d WHERE depth > 4""",
)
def _link_findings(p: Projection) -> DataFrame:
    return site_audit.link_findings(_facts(p), _norm())


#: Customers link to two others by rules of their number; the first of a segment is where visitors start.
_CLICKS = """e AS (SELECT DISTINCT * FROM (SELECT c_custkey AS source, (c_custkey * 7) %% n + 1 AS target FROM customer, %(n)s UNION ALL SELECT c_custkey, c_custkey + 25 FROM customer) WHERE source <> target),
r AS (SELECT min(c_custkey) AS page_id FROM customer GROUP BY c_mktsegment)""" % {"n": "(SELECT count(*) AS n FROM customer)"}


@query(
    "click_depths",
    f"""WITH RECURSIVE {_CLICKS}, b AS (SELECT page_id, 0 AS depth FROM r UNION SELECT target, depth + 1 FROM b JOIN e ON source = page_id WHERE depth < 10)
SELECT page_id, CAST(min(depth) AS INTEGER) AS depth FROM b GROUP BY 1 HAVING min(depth) <= 9""",
)
def _click_depths(p: Projection) -> DataFrame:
    customers = p.table("customer")
    n = customers.agg(F.count("*").alias("n")).withColumn("k", F.lit(1))
    key = F.col("c_custkey")
    # one row: a scalar that joins every customer
    far = customers.withColumn("k", F.lit(1)).join(F.broadcast(n), "k").select(key.alias("source"), (key * 7 % F.col("n") + 1).alias("target"))
    edges = far.unionByName(customers.select(key.alias("source"), (key + 25).alias("target"))).where("source <> target").distinct()
    roots = customers.groupBy("c_mktsegment").agg(F.min("c_custkey").alias("page_id")).select("page_id")
    return site_audit.click_depths(edges, roots).where("depth <= 9")


@query("seo_audit_findings", None)
def _audit(p: Projection) -> DataFrame:
    """Findings of every kind, counted; the parts have SQL of their own."""
    return site_audit.audit_findings(_facts(p), _norm()).groupBy("code", "severity", "category").agg(F.count("*").alias("pages"))


def _site_names(p: Projection) -> DataFrame:
    """What each site's structured data calls its products and its organization."""
    placed = p.table("pages").select(site_audit.site_of(F.col("url")).alias("site"), "page_id", "url")
    found = entities.extract_entities(_blocks(p))
    return specificity.site_names(found, placed, entities.organization(found, placed))


@query("readiness_signals", None)
def _signals(p: Projection) -> DataFrame:
    return site_audit.readiness_signals(site_audit.page_snapshot(_facts(p)), _site_names(p)).withColumn("kinds", F.array_join("kinds", ","))


@query("readiness_score", None)
def _readiness(p: Projection) -> DataFrame:
    return site_audit.page_readiness(site_audit.readiness_signals(site_audit.page_snapshot(_facts(p)), _site_names(p))).select("page_id", "score")


def _blocks(p: Projection) -> DataFrame:
    """JSON-LD blocks: those of the pages, and one made of every page's address, so that the table has some."""
    own = _facts(p).select("page_id", F.posexplode("blocks").alias("block", "b")).where("b.is_valid").select("page_id", "block", "b.payload")
    host = F.regexp_extract("url", r"://([^/]+)", 1)
    made = F.to_json(F.struct(F.lit("Organization").alias("@type"), F.lit("https://schema.org").alias("@context"), host.alias("name"), F.col("url").alias("url"), (F.col("page_id") % 2).cast("string").alias("telephone"), F.array(F.concat(F.lit("https://x.com/"), host)).alias("sameAs")))
    return own.unionByName(p.table("pages").select("page_id", F.lit(-1).alias("block"), made.alias("payload")))


@query("jsonld_entities", "SELECT page_id, -1 AS block, 'Organization' AS entity_type, regexp_extract(url, '://([^/]+)', 1) AS name, url FROM pages")
def _entities(p: Projection) -> DataFrame:
    return entities.extract_entities(_blocks(p)).select("page_id", "block", "entity_type", "name", "url")


def _marked_up(p: Projection) -> DataFrame:
    """Every page with an organization in microdata and one in RDFa at its end: the given pages have none."""
    host, url = F.regexp_extract("url", r"://([^/]+)", 1), F.replace("url", F.lit("&"), F.lit("&amp;"))
    micro = F.concat(F.lit('<div itemscope itemtype="https://schema.org/Organization"><b itemprop="name">'), host, F.lit('</b><a itemprop="url" href="'), url, F.lit('">home</a></div>'))
    rdfa = F.concat(F.lit('<div vocab="https://schema.org/" typeof="Brand"><p property="name">The <i>'), host, F.lit("</i></div>"))
    return p.table("pages").withColumn("html", F.concat(F.coalesce("html", F.lit("")), micro, rdfa))


@query(
    "markup_entities",
    """SELECT page_id, 'microdata' AS format, 'Organization' AS entity_type, regexp_extract(url, '://([^/]+)', 1) AS name, url FROM pages
UNION ALL SELECT page_id, 'rdfa', 'Brand', 'The ' || regexp_extract(url, '://([^/]+)', 1), NULL FROM pages""",
)
def _markup_entities(p: Projection) -> DataFrame:
    blocks = parse_pages(_marked_up(p)).select("page_id", F.posexplode("blocks").alias("block", "b")).where("b.is_valid")
    found = entities.extract_entities(blocks.select("page_id", "block", "b.payload"))
    formats = F.when(F.col("entity_type") == "Brand", "rdfa").otherwise("microdata")
    return found.select("page_id", formats.alias("format"), "entity_type", "name", "url")


@query(
    "entity_conflicts",
    """WITH e AS (SELECT page_id, regexp_replace(regexp_extract(url, '://([^/]+)', 1), '[^a-z0-9]', ' ', 'g') AS n FROM pages)
SELECT 'Organization|' || n AS fingerprint, 'telephone' AS property, count(DISTINCT page_id % 2) AS values, count(DISTINCT page_id) AS pages FROM e GROUP BY n HAVING count(DISTINCT page_id % 2) > 1
UNION ALL SELECT 'Organization|' || n, 'url', count(DISTINCT lower(url)), count(DISTINCT page_id) FROM e JOIN pages USING (page_id) GROUP BY n HAVING count(DISTINCT lower(url)) > 1""",
)
def _conflicts(p: Projection) -> DataFrame:
    return entities.conflicts(entities.extract_entities(_blocks(p)))


@query(
    "jsonld_issues",
    """SELECT CASE page_id % 5 WHEN 0 THEN 'invalid_json' WHEN 1 THEN 'missing_context' WHEN 2 THEN 'missing_type' ELSE 'empty_block' END AS code,
  CASE page_id % 5 WHEN 0 THEN 'high' WHEN 1 THEN 'medium' WHEN 2 THEN 'medium' ELSE 'low' END AS severity, count(*) AS issues FROM pages WHERE page_id % 5 < 4 GROUP BY 1, 2""",
)
def _issues(p: Projection) -> DataFrame:
    """Issues of blocks made with a fault for every page."""
    faults = ["{bad", '{"@type":"Thing","name":"a"}', '{"@context":"https://schema.org","name":"a"}', "[]", '{"@context":"https://schema.org","@type":"Thing","name":"a"}']
    payload = F.get(F.array(*[F.lit(x) for x in faults]), (F.col("page_id") % 5).cast("int"))
    blocks = p.table("pages").select("page_id", F.lit(0).alias("block"), payload.alias("payload"))
    return entities.validate_blocks(blocks).groupBy("code", "severity").agg(F.count("*").alias("issues"))


# ---- references between entities -----------------------------------------------------------------------------------

#: Every page names its publisher by an id; the host's brand stands for its organization, which some pages define.
_LINKED_SQL = """p AS (SELECT page_id, url, regexp_extract(url, '://([^/?#]+)', 1) AS h FROM pages),
org AS (SELECT h, min(page_id) AS org_page FROM p WHERE page_id % 3 = 0 GROUP BY h), brand AS (SELECT h, min(page_id) AS brand_page FROM p GROUP BY h),
l AS (SELECT p.*, org_page, brand_page, org_page IS NOT NULL AS has_org FROM p LEFT JOIN org USING (h) LEFT JOIN brand USING (h))"""


def _linked_blocks(p: Projection) -> DataFrame:
    host = F.regexp_extract("url", r"://([^/?#]+)", 1)
    at = lambda tail: F.concat(F.lit("https://"), host, F.lit(tail))
    ref = lambda tail: F.struct(at(tail).alias("@id"))
    page = F.to_json(F.struct(F.lit("WebPage").alias("@type"), F.lit("#page").alias("@id"), F.concat(F.lit("p"), F.col("page_id").cast("string")).alias("name"), ref("/#brand").alias("publisher"), F.struct(F.lit("Person").alias("@type"), F.lit("Ann").alias("name")).alias("author")))
    brand = F.to_json(F.struct(F.lit("Brand").alias("@type"), at("/#brand").alias("@id"), ref("/#org").alias("sameAs")))
    org = F.to_json(F.struct(F.lit("Organization").alias("@type"), at("/#org").alias("@id"), host.alias("name")))
    every = F.array_join(F.array_compact(F.array(page, brand, F.when(F.col("page_id") % 3 == 0, org))), ",")
    return p.table("pages").select(host.alias("site"), "page_id", "url", F.lit(0).alias("block"), F.concat(F.lit('{"@context":"https://schema.org","@graph":['), every, F.lit("]}")).alias("payload"))


@query(
    "entity_references",
    f"""WITH {_LINKED_SQL}
SELECT page_id, 'publisher' AS property, 'https://' || h || CASE WHEN has_org THEN '/#org' ELSE '/#brand' END AS canonical_id, CASE WHEN has_org THEN org_page ELSE brand_page END AS target_page_id,
  CASE WHEN has_org THEN '@graph[2]' ELSE '@graph[1]' END AS target_path, CASE WHEN has_org THEN 'Organization' ELSE 'Brand' END AS target_type, CASE WHEN has_org THEN h END AS target_name FROM l
UNION ALL SELECT page_id, 'author', NULL, page_id, '@graph[0].author', 'Person', 'Ann' FROM l
UNION ALL SELECT page_id, 'sameAs', 'https://' || h || '/#org', org_page, '@graph[2]', 'Organization', h FROM l WHERE has_org""",
)
def _references(p: Projection) -> DataFrame:
    return entity_graph.resolve_references(entity_graph.entity_nodes(_linked_blocks(p))).select("page_id", "property", "canonical_id", "target_page_id", "target_path", "target_type", "target_name")


@query(
    "page_entities",
    f"""WITH {_LINKED_SQL} SELECT h AS site, page_id, url, CAST(CASE WHEN page_id % 3 = 0 THEN 4 ELSE 3 END AS BIGINT) AS entities, CAST(CASE WHEN has_org THEN 3 ELSE 2 END AS BIGINT) AS resolved,
  CASE WHEN has_org THEN h END AS publisher FROM l""",
)
def _page_entities(p: Projection) -> DataFrame:
    """Entities and references attached to their pages."""
    blocks = _linked_blocks(p)
    nodes = entity_graph.entity_nodes(blocks)
    rows = entity_graph.attach_to_pages(blocks, entities.extract_entities(blocks), entity_graph.resolve_references(nodes))
    refs = F.flatten(F.transform("entities", lambda e: e["refs"]))
    publisher = F.get(F.filter(refs, lambda r: r["property"] == "publisher"), F.lit(0))["target_name"]
    return rows.select("site", "page_id", "url", F.size("entities").cast("bigint").alias("entities"), F.size(refs).cast("bigint").alias("resolved"), publisher.alias("publisher"))


@query("site_readiness", None)
def _site_readiness(p: Projection) -> DataFrame:
    from brandlens.operators import readiness

    return readiness.site_readiness(readiness.page_aspects(site_audit.page_snapshot(_facts(p)), names=_site_names(p)))


@query("page_content_reviews", None)
def _reviews(p: Projection) -> DataFrame:
    from brandlens.operators import readiness

    host = F.regexp_extract("url", r"([a-z0-9-]+)\.[a-z]+(?:[/:?#]|$)", 1)
    return readiness.page_reviews(site_audit.page_snapshot(_facts(p)), host)
