"""Queries over hosts, names, topics, citations and their entities, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.functions import names as N
from brandlens.operators import citations, signals
from brandlens.plans.analytics import query
from brandlens.plans.texts import _PROMPT, _prompt_text
from brandlens.sources.projection import Projection

_HOST_SQL = "regexp_extract(url, '^[a-z]+://([^/?#]+)', 1)"
_ROOT_SQL = "regexp_extract(url, '^[a-z]+://[^/?#]*?([a-z0-9-]+\\.[a-z]+\\.[a-z]+)(?:[/?#]|$)', 1)"


def _words(values) -> str:
    return ", ".join("'" + v.replace("'", "''") + "'" for v in values)


def _host():
    return F.regexp_extract("url", r"^[a-z]+://([^/?#]+)", 1)


def _root():
    """The last three labels of a page's host, its site here."""
    return F.regexp_extract("url", r"^[a-z]+://[^/?#]*?([a-z0-9-]+\.[a-z]+\.[a-z]+)(?:[/?#]|$)", 1)


@query(
    "host_names",
    f"""SELECT page_id, regexp_replace(h, '^((www|m|en|docs|blog|news|support)\\.)+', '') AS display_name, regexp_extract(regexp_replace(h, '^www\\.', ''), '^([^.]*)', 1) AS stem,
  CASE WHEN p = '' THEN '/' ELSE p END AS path, regexp_replace(h, '^www\\.', '') = r OR ends_with(h, '.' || r) AS same_site, regexp_replace(h, '^www\\.', '') = r AS same_host
FROM (SELECT page_id, {_HOST_SQL} AS h, {_ROOT_SQL} AS r, regexp_extract(url, '^[a-z]+://[^/?#]+([^#]*)', 1) AS p FROM pages)""",
)
def _host_names(p: Projection) -> DataFrame:
    rows = p.table("pages").select("page_id", "url", _host().alias("h"), _root().alias("r"))
    return rows.select(
        "page_id", N.display_name(F.col("h")).alias("display_name"), N.host_stem(F.col("url")).alias("stem"), N.display_path(F.col("url")).alias("path"),
        N.same_site(F.col("h"), F.col("r")).alias("same_site"), N.same_site(F.col("h"), F.col("r"), False).alias("same_host"),
    )


_ENDS = ("/compare-plans", "/help", "/customers/acme", "/guide", "/pricing", "/vs-rival", "/x")
_SUFFIXED = f"url || ([{_words(_ENDS)}])[CAST(page_id % 7 AS INTEGER) + 1]"


def _case_sql(pairs, column: str) -> str:
    return "CASE " + " ".join(f"WHEN regexp_matches({column}, '{pattern}') THEN '{name}'" for name, pattern in pairs) + " END"


@query(
    "page_categories",
    f"""SELECT page_id, {_case_sql(N.ADDRESS_CATEGORIES, "low")} AS address_category, array_to_string(list_filter([{", ".join(f"CASE WHEN regexp_matches(low || ' ' || t, '{pattern}') THEN '{name}' END" for name, pattern in N.PAGE_CATEGORIES)}], lambda x: x IS NOT NULL), ',') AS categories
FROM (SELECT page_id, lower({_SUFFIXED}) AS low, 'title ' || (page_id % 3) AS t FROM pages)""",
)
def _categories(p: Projection) -> DataFrame:
    url = F.concat("url", F.get(F.array(*[F.lit(x) for x in _ENDS]), (F.col("page_id") % 7).cast("int")))
    title = F.concat(F.lit("title "), (F.col("page_id") % 3).cast("string"))
    return p.table("pages").select("page_id", N.address_category(url).alias("address_category"), F.array_join(N.page_categories(url, title), ",").alias("categories"))


@query(
    "company_keys",
    f"""SELECT p_partkey, replace(regexp_replace(trim(regexp_replace(lower(n), '[^a-z0-9]+', ' ', 'g')), '( ({'|'.join(N.COMPANY_ENDINGS)}))+$', ''), ' ', '') AS company_key
FROM (SELECT p_partkey, p_brand || ' ' || p_name || ([', Inc.', ' GmbH', ' Co. Ltd', ' LLC!', ' Works', ' Inc Labs'])[CAST(p_partkey % 6 AS INTEGER) + 1] AS n FROM part)""",
)
def _company_keys(p: Projection) -> DataFrame:
    end = F.get(F.array(*[F.lit(x) for x in (", Inc.", " GmbH", " Co. Ltd", " LLC!", " Works", " Inc Labs")]), (F.col("p_partkey") % 6).cast("int"))
    return p.table("part").select("p_partkey", N.company_key(F.concat_ws("", "p_brand", F.lit(" "), "p_name", end)).alias("company_key"))


_KEYWORDS = f"list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9''-]+'), lambda w: length(w) >= 3 AND w NOT IN ({_words([*N.TOPIC_STOP_WORDS, *N.TOPIC_GENERIC_WORDS])}))"


@query(
    "topic_words",
    f"""SELECT run_id, array_to_string(k, ' ') AS keywords, substr(CASE WHEN len(k) = 0 THEN t ELSE array_to_string(k, ' ') END, 1, 300) AS label, array_to_string(list_sort(list_distinct(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9''-]+'))), ' ') AS topic
FROM (SELECT run_id, t, {_KEYWORDS} AS k FROM (SELECT o_orderkey AS run_id, {_PROMPT} AS t FROM orders))""",
)
def _topic_words(p: Projection) -> DataFrame:
    rows = p.table("orders").select(F.col("o_orderkey").alias("run_id"), _prompt_text().alias("t"))
    return rows.select("run_id", F.array_join(N.topic_keywords(F.col("t")), " ").alias("keywords"), N.topic_label(F.col("t")).alias("label"), N.normalized_topic(F.col("t")).alias("topic"))


@query(
    "text_snippets",
    """SELECT doc_id, array_to_string(list_transform(regexp_extract_all(text, '(?s).{0,40}(?:https?://|@).{0,40}')[1:3], lambda s: trim(regexp_replace(s, '\\s+', ' ', 'g'))), '|') AS snippets FROM documents WHERE text IS NOT NULL""",
)
def _snippets(p: Projection) -> DataFrame:
    return p.table("documents").where("text IS NOT NULL").select("doc_id", F.array_join(N.snippets(F.col("text"), "https?://|@"), "|").alias("snippets"))


@query(
    "loose_dates",
    """SELECT event_id, CASE event_id % 6 WHEN 5 THEN NULL WHEN 0 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) WHEN 1 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) - 7200 WHEN 2 THEN CAST(epoch(date_trunc('second', ts)) AS BIGINT) + 19800
  ELSE CAST(epoch(date_trunc('day', ts)) AS BIGINT) END AS seconds FROM events""",
)
def _loose_dates(p: Projection) -> DataFrame:
    at = lambda f: F.date_format("ts", f)
    whole = "yyyy-MM-dd'T'HH:mm:ss"
    k = F.col("event_id") % 6
    raw = (
        F.when(k == 0, F.concat(at(whole), F.lit("Z"))).when(k == 1, F.concat(at(whole), F.lit("+02:00"))).when(k == 2, F.concat(F.lit(" "), at("yyyy-MM-dd HH:mm:ss"), F.lit("-0530")))
        .when(k == 3, at("yyyy-MM-dd")).when(k == 4, F.concat(at("yyyy-MM-dd"), F.lit(" or so"))).otherwise("soon")
    )
    return p.table("events").select("event_id", F.unix_timestamp(N.loose_date(raw)).alias("seconds"))


@query(
    "retry_and_confidence",
    """SELECT event_id, least(60.0, 1.5 * pow(2.0, user_id % 9)) AS wait_seconds, CASE WHEN least(user_id, event_id % 97) >= 50 THEN 'high' WHEN least(user_id, event_id % 97) >= 20 THEN 'medium' ELSE 'low' END AS confidence,
  CASE WHEN length(props) > 8 THEN rtrim(substr(props, 1, 7)) || '…' ELSE props END AS clip FROM events""",
)
def _retry(p: Projection) -> DataFrame:
    return p.table("events").select("event_id", N.backoff(F.col("user_id") % 9 + 1, 1.5, 60.0).alias("wait_seconds"), N.sample_confidence(F.col("user_id"), F.col("event_id") % 97).alias("confidence"), N.clipped(F.col("props"), 8).alias("clip"))


@query(
    "evidence_pages",
    f"""WITH e AS (SELECT page_id, url, CASE WHEN page_id % 2 = 0 THEN url END AS u, CASE WHEN page_id % 3 = 0 THEN [url, {_HOST_SQL}] ELSE [] END AS us, CASE WHEN page_id % 4 = 0 THEN [{_HOST_SQL}] ELSE [] END AS ch FROM pages),
x AS (SELECT *, list_filter(list_concat([u], us, ch), lambda v: v IS NOT NULL) AS l FROM e)
SELECT page_id, CAST(greatest(len(list_distinct(l)), page_id % 4) AS INTEGER) AS affected, CASE WHEN page_id % 2 = 0 THEN url || '|' || {_HOST_SQL} ELSE {_HOST_SQL} END AS cited FROM x""",
)
def _evidence_pages(p: Projection) -> DataFrame:
    when = lambda n, value: F.when(F.col("page_id") % n == 0, value)
    rows = p.table("pages").withColumn("h", _host())
    pages = N.affected_pages(when(2, F.col("url")), when(3, F.array("url", "h")), F.lit(None).cast("array<string>"), when(4, F.array("h")), (F.col("page_id") % 4).cast("int"))
    cited = N.merged_citations(when(2, F.array(F.col("url"), F.lit(""), F.col("url"))), F.array("h", "h"))
    return rows.select("page_id", pages["count"].alias("affected"), F.array_join(cited, "|").alias("cited"))


# ---- citations -------------------------------------------------------------------------------------------------------

#: Every site of the pages is the brand's, a competitor's or nobody's, by the length of its name; all five projects share them.
_ENTITY_SQL = f"""sites AS (SELECT DISTINCT {_ROOT_SQL} AS host FROM pages), named AS (SELECT host, split_part(host, '.', 1) AS entity_name, length(host) % 3 AS k FROM sites WHERE host <> ''),
entities AS (SELECT p.project_id, CASE k WHEN 0 THEN 'brand' ELSE 'competitor' END AS entity_type, entity_name, host FROM named, (SELECT unnest([0, 1, 2, 3, 4]) AS project_id) p WHERE k < 2),
cites AS (SELECT a.page_id AS citation_id, a.page_id % 5 AS project_id, CASE WHEN a.page_id % 3 = 0 THEN {_HOST_SQL.replace("url", "a.url")} END AS domain, CASE WHEN a.page_id % 7 <> 0 THEN a.url END AS url,
  'a review of ' || upper({_ROOT_SQL.replace("url", "b.url")}) AS anchor, {_HOST_SQL.replace("url", "a.url")} AS full_host FROM pages a LEFT JOIN pages b ON b.page_id = a.page_id + 1),
hosted AS (SELECT *, regexp_replace(full_host, '^www\\.', '') AS cited FROM cites WHERE citation_id % 3 = 0 OR citation_id % 7 <> 0),
own AS (SELECT citation_id, entity_type, entity_name, max(CASE WHEN cited = host THEN 0.95 ELSE 0.8 END) AS confidence FROM hosted JOIN entities USING (project_id) WHERE cited = host OR ends_with(cited, '.' || host) GROUP BY 1, 2, 3),
slugs AS (SELECT citation_id, project_id, ' ' || trim(regexp_replace(lower(coalesce(regexp_replace(regexp_replace(url, '#.*$', ''), '^[a-z]+://[^/?]*', ''), '') || ' ' || coalesce(anchor, '')), '[^a-z0-9]+', ' ', 'g')) || ' ' AS slug FROM hosted WHERE citation_id NOT IN (SELECT citation_id FROM own)),
rel AS (SELECT * FROM own UNION ALL SELECT DISTINCT citation_id, entity_type, entity_name, 0.7 FROM slugs JOIN entities USING (project_id) WHERE length(trim(regexp_replace(entity_name, '[^a-z0-9]+', ' ', 'g'))) >= 3 AND contains(slug, ' ' || trim(regexp_replace(entity_name, '[^a-z0-9]+', ' ', 'g')) || ' '))"""


def _cites(p: Projection) -> DataFrame:
    pages = p.table("pages")
    follower = pages.select((F.col("page_id") - 1).alias("page_id"), F.upper(_root()).alias("next"))
    rows = pages.join(follower, "page_id", "left")
    return rows.select(
        F.col("page_id").alias("citation_id"), (F.col("page_id") % 5).alias("project_id"), F.when(F.col("page_id") % 3 == 0, _host()).alias("domain"), F.when(F.col("page_id") % 7 != 0, F.col("url")).alias("url"), F.concat(F.lit("a review of "), "next").alias("anchor")
    )


def _site_entities(p: Projection) -> DataFrame:
    sites = p.table("pages").select(_root().alias("host")).where("host <> ''").distinct().withColumn("k", F.length("host") % 3).where("k < 2")
    project = F.explode(F.array(*[F.lit(i).cast("bigint") for i in range(5)]))
    return sites.select(project.alias("project_id"), F.when(F.col("k") == 0, "brand").otherwise("competitor").alias("entity_type"), F.split_part("host", F.lit("."), F.lit(1)).alias("entity_name"), "host")


@query("citation_relationships", f"WITH {_ENTITY_SQL} SELECT citation_id, entity_type, entity_name, CAST(confidence AS DOUBLE) AS confidence FROM rel")
def _relationships(p: Projection) -> DataFrame:
    return citations.relationships(_cites(p), _site_entities(p))


@query(
    "citations_resolved",
    f"""WITH {_ENTITY_SQL}, r AS (SELECT citation_id, bool_or(entity_type = 'brand') AS is_brand, bool_or(entity_type = 'competitor') AS is_competitor, array_to_string(list_sort(list_distinct(list(entity_name) FILTER (WHERE entity_type = 'competitor'))), ',') AS competitors FROM rel GROUP BY 1)
SELECT citation_id, project_id, cited AS host, coalesce(is_brand, false) AS is_brand, coalesce(is_competitor, false) AS is_competitor, coalesce(competitors, '') AS competitors FROM hosted LEFT JOIN r USING (citation_id)""",
)
def _resolved(p: Projection) -> DataFrame:
    return citations.resolve(_cites(p), _site_entities(p)).select("citation_id", "project_id", "host", "is_brand", "is_competitor", F.array_join("competitors", ",").alias("competitors"))


@query(
    "source_types_stored",
    """WITH s AS (SELECT s_suppkey AS k, 'h' || s_suppkey AS host, CASE s_nationkey % 3 WHEN 0 THEN 'unknown' WHEN 1 THEN 'media' ELSE 'blog' END AS t, CASE WHEN s_nationkey % 3 > 0 THEN (s_suppkey % 7) / 10.0 END AS c FROM supplier WHERE s_suppkey % 10 <> 3),
f AS (SELECT s_suppkey AS k, 'h' || s_suppkey AS host, CASE s_suppkey % 4 WHEN 0 THEN 'unknown' WHEN 1 THEN 'media' WHEN 2 THEN 'blog' ELSE 'review' END AS t, CASE WHEN s_suppkey % 4 > 0 THEN (s_nationkey % 9) / 10.0 END AS c FROM supplier WHERE s_suppkey % 10 <> 7),
j AS (SELECT coalesce(s.host, f.host) AS host, coalesce(s.t, 'unknown') AS was, coalesce(f.t, 'unknown') AS now, s.c AS sc, f.c AS fc FROM s FULL JOIN f ON s.host = f.host),
d AS (SELECT *, (now <> 'unknown' OR was = 'unknown') AND (now <> was OR coalesce(fc, 0) >= coalesce(sc, 0)) AS takes FROM j)
SELECT host, CASE WHEN takes THEN now ELSE was END AS domain_type, CAST(CASE WHEN takes THEN CASE WHEN now <> 'unknown' THEN fc END ELSE sc END AS DOUBLE) AS confidence FROM d""",
)
def _stored(p: Projection) -> DataFrame:
    s = p.table("supplier").withColumn("host", F.concat(F.lit("h"), F.col("s_suppkey").cast("string")))
    nation, key = F.col("s_nationkey"), F.col("s_suppkey")
    stored = s.where(key % 10 != 3).select("host", F.when(nation % 3 == 0, "unknown").when(nation % 3 == 1, "media").otherwise("blog").alias("domain_type"), F.when(nation % 3 > 0, (key % 7) / 10.0).alias("confidence"))
    fresh = s.where(key % 10 != 7).select("host", F.when(key % 4 == 0, "unknown").when(key % 4 == 1, "media").when(key % 4 == 2, "blog").otherwise("review").alias("domain_type"), F.when(key % 4 > 0, (nation % 9) / 10.0).alias("confidence"))
    return citations.stored_classification(stored, fresh)


# ---- content coverage ------------------------------------------------------------------------------------------------

#: Topics are the parts by name, type and brand; the site's pages tell of some of them, at some length.
_TOPIC_SQL = f"""topics AS (SELECT min(p_partkey) AS topic_id, t FROM (SELECT p_partkey, 'Which ' || p_name || ' for ' || lower(p_type) || ' ' || replace(lower(p_brand), '#', '-') || ' is best?' AS t FROM part) GROUP BY t),
site AS (SELECT page_id, url, 'On ' || p_name AS title, CASE WHEN page_id % 4 = 0 THEN replace(lower(p_brand), '#', '-') END AS meta, (page_id * 37) % 600 AS word_count FROM pages JOIN part ON p_partkey = (page_id * 13) % 97),
kw AS (SELECT topic_id, unnest(list_distinct({_KEYWORDS})) AS k, len(list_distinct({_KEYWORDS})) AS n FROM topics),
hit AS (SELECT topic_id, n, page_id, count(*) AS hits FROM kw JOIN site ON contains(lower(url || ' ' || title || ' ' || coalesce(meta, '')), k) GROUP BY 1, 2, 3),
cov AS (SELECT topic_id, count(*) AS pages, least(1.0, sum(CASE WHEN word_count >= 300 THEN 1.0 ELSE 0.4 END)) AS coverage,
  {", ".join(f"bool_or(regexp_matches(lower(url || ' ' || title), '{pattern}')) AS has_{name}" for name, pattern in N.PAGE_CATEGORIES)}
  FROM hit JOIN site USING (page_id) WHERE hits >= CASE WHEN n > 1 THEN (n + 1) // 2 ELSE 1 END GROUP BY 1)"""


def _brand_word():
    return F.replace(F.lower("p_brand"), F.lit("#"), F.lit("-"))


def prompt_texts(p: Projection) -> DataFrame:
    """prompt_id and t, its text."""
    return p.table("part").select(F.col("p_partkey").alias("prompt_id"), F.concat(F.lit("Which "), "p_name", F.lit(" for "), F.lower("p_type"), F.lit(" "), _brand_word(), F.lit(" is best?")).alias("t"))


def topic_coverage(p: Projection) -> DataFrame:
    """topic_id, t (prompt text), pages, coverage and page categories of every topic; no page is 0."""
    brand = _brand_word()
    topics = prompt_texts(p).groupBy("t").agg(F.min("prompt_id").alias("topic_id")).withColumn("keywords", N.topic_keywords(F.col("t")))
    part = p.table("part").select(F.col("p_partkey").alias("k"), F.concat(F.lit("On "), "p_name").alias("title"), brand.alias("brand"))
    site = p.table("pages").withColumn("k", F.col("page_id") * 13 % 97).join(part, "k").select("page_id", "url", "title", F.when(F.col("page_id") % 4 == 0, F.col("brand")).alias("meta"), (F.col("page_id") * 37 % 600).alias("word_count"))
    covered = signals.match_pages(topics, site)
    return topics.join(covered, "topic_id", "left").select("topic_id", "t", F.coalesce("pages", F.lit(0)).alias("pages"), F.coalesce("coverage", F.lit(0.0)).alias("coverage"), "categories")


@query("content_gap_coverage", f"WITH {_TOPIC_SQL} SELECT topic_id, t AS prompt, coalesce(pages, 0) AS pages, CAST(round_even(coalesce(coverage, 0), 3) AS DOUBLE) AS coverage FROM topics LEFT JOIN cov USING (topic_id)")
def _coverage(p: Projection) -> DataFrame:
    return topic_coverage(p).select("topic_id", F.col("t").alias("prompt"), "pages", F.bround("coverage", 3).alias("coverage"))
