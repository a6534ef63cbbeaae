"""Research findings over what the other queries return, with SQL over their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators import entities, evidence, research, signals
from brandlens.plans.analytics import ORACLE_SQL, STATED, WITH, _GAPS, _advantages, _entities, _gap_rows, _window, query, stated_claims
from brandlens.plans.rules import _discovery, _gaps_by_topic, _insights
from brandlens.plans.sites import _blocks
from brandlens.sources.projection import Gathered, Projection


def _profiles(p: Projection) -> DataFrame:
    """What the structured data of each project's pages says of its brand."""
    found = entities.extract_entities(_blocks(p))
    return signals.brand_profile(found, F.col("page_id") % 5).withColumnRenamed("site", "project_id")


@query(
    "brand_profiles",
    """WITH e AS (SELECT page_id % 5 AS project_id, trim(regexp_extract(url, '://([^/]+)', 1)) AS name FROM pages)
SELECT project_id, true AS has_organization, false AS has_description, count(DISTINCT name) AS names, count(*) AS same_as_links, CAST(0 AS BIGINT) AS products FROM e GROUP BY 1""",
)
def _brand_profiles(p: Projection) -> DataFrame:
    return _profiles(p)


def _health(p: Projection) -> DataFrame:
    events = p.table("events").groupBy((F.col("user_id") % 5).alias("project_id"))
    return events.agg((100 - F.count("*") % 80).cast("double").alias("health_score"), F.count_if((F.col("event_type") == "error") & (F.col("value") > 150)).alias("critical"))


def _rivals(p: Projection) -> DataFrame:
    digit = F.substring("entity", 5, 1)
    return p.configured.select("project_id", F.col("entity").alias("name"), F.concat(F.lit("supplier-00000000"), digit, F.lit(".example")).alias("host"))


_SQL = f"""WITH sm AS (SELECT project_id, sample_size FROM ({ORACLE_SQL["competitive_entities"]}) WHERE entity = 'brand'),
rel AS (SELECT project_id, competitor, count(*) AS related FROM ({ORACLE_SQL["insights"]}) GROUP BY 1, 2),
lead AS (SELECT a.project_id, 'competitor' AS generator, 'competitor:' || competitor AS key, competitor || ' holds a material AI-visibility lead' AS title, CASE WHEN sample_size >= 50 THEN 'high' WHEN sample_size >= 20 THEN 'medium' ELSE 'low' END AS confidence,
    CASE WHEN advantage >= 20 THEN 'high' ELSE 'medium' END AS impact, 1.0 AS b, least(1.0, advantage / 30.0) AS v, 1.0 AS c, least(1.0, 0.5 + 0.25 * coalesce(related, 0)) AS s, 1.0 AS e
  FROM ({ORACLE_SQL["competitive_advantages"]}) a LEFT JOIN rel USING (project_id, competitor) LEFT JOIN sm USING (project_id) WHERE material),
g0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, domain) AS no FROM ({ORACLE_SQL["citation_gaps"]})) WHERE no <= 10 AND score >= 60 AND confidence <> 'insufficient'),
cfg AS (SELECT DISTINCT n_regionkey AS project_id, n_nationkey % 7 AS digit FROM nation WHERE n_nationkey % 3 <> 0 AND n_regionkey <> 4),
cit AS (SELECT project_id, 'citation', 'citation:' || domain, 'Citation gap on ' || domain, confidence, CASE WHEN score >= 75 THEN 'high' ELSE 'medium' END, 0.8, least(1.0, score / 100.0),
    least(1.0, competitor_citations / CAST(greatest(1, brand_citations + competitor_citations) AS DOUBLE)), CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END / 3.0, 0.6
  FROM g0 WHERE NOT EXISTS (SELECT 1 FROM cfg WHERE cfg.project_id = g0.project_id AND (domain = 'supplier-00000000' || digit || '.example' OR list_contains(string_split(domain, '.'), 'comp' || digit)))),
t0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY score DESC, topic, gap_type) AS no FROM ({ORACLE_SQL["content_gaps_by_topic"]})) WHERE no <= 10 AND score >= 60),
con AS (SELECT project_id, 'content', 'content:' || topic || ':' || gap_type, 'Content gap: ' || topic, confidence, CASE WHEN score >= 80 THEN 'high' ELSE 'medium' END, 1.0, least(1.0, score / 100.0), 0.7,
    CASE confidence WHEN 'high' THEN 3 WHEN 'medium' THEN 2 ELSE 1 END / 3.0, CASE gap_type WHEN 'missing_comparison' THEN 0.3 WHEN 'weak_topic' THEN 1.0 ELSE 0.6 END FROM t0),
ent AS (SELECT DISTINCT page_id % 5, 'entity', 'entity:organization', 'Weak machine-readable brand identity', 'medium', 'medium', 0.7, 0.5, 0.5, 0.9, 1.0 FROM pages),
h AS (SELECT user_id % 5 AS project_id, 100 - count(*) % 80 AS score, count(*) FILTER (WHERE event_type = 'error' AND value > 150) AS critical FROM events GROUP BY 1),
seo AS (SELECT project_id, 'seo', 'seo:technical', 'Technical SEO issues on the crawled site', 'high', CASE WHEN critical > 0 THEN 'high' ELSE 'medium' END, 0.6, CASE WHEN critical > 0 THEN 0.6 ELSE 0.4 END, 0.3, 1.0, 0.6 FROM h WHERE critical > 0 OR score < 60),
d0 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY confidence DESC, name) AS no FROM ({ORACLE_SQL["discovery_scores"]})) WHERE no <= 5 AND label IN ('high', 'medium')),
eme AS (SELECT project_id, 'emerging', 'emerging:' || name, 'Emerging competitor candidate: ' || name, label, 'medium', 0.6, 0.4, 0.6, least(1.0, confidence), 1.0 FROM d0),
q0 AS ({WITH}{STATED} SELECT project_id, lower(regexp_extract(subject, 'COMP[0-9]')) AS competitor, lower(predicate) || ' ' || lower(object) AS claim, count(*) AS n FROM stated WHERE subject LIKE '%COMP%' GROUP BY 1, 2, 3 HAVING count(*) >= 3),
q1 AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY n DESC, competitor, claim) AS no FROM q0) WHERE no <= 2),
cla AS (SELECT project_id, 'claim', 'claim:' || competitor || ':' || substr(claim, 1, 60), 'AI answers repeat a claim about ' || competitor, CASE WHEN sample_size >= 20 THEN 'medium' ELSE 'low' END, 'medium', 0.7, 0.5, 0.6, least(1.0, n / 5.0), 0.6 FROM q1 LEFT JOIN sm USING (project_id)),
every AS (SELECT * FROM lead UNION ALL SELECT * FROM cit UNION ALL SELECT * FROM con UNION ALL SELECT * FROM ent UNION ALL SELECT * FROM seo UNION ALL SELECT * FROM eme UNION ALL SELECT * FROM cla),
scored AS (SELECT project_id, generator, key, title, CASE WHEN coalesce(sample_size, 0) < 10 AND confidence IN ('high', 'medium') THEN 'low' ELSE confidence END AS confidence, impact,
    round_even(25.0 * round_even(CAST(b AS DOUBLE), 6) + 25.0 * round_even(CAST(v AS DOUBLE), 6) + 20.0 * round_even(CAST(c AS DOUBLE), 6) + 20.0 * round_even(CAST(s AS DOUBLE), 6) + 10.0 * round_even(CAST(e AS DOUBLE), 6), 1) AS score FROM every LEFT JOIN sm USING (project_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, title, key) AS INTEGER) AS rank FROM scored) WHERE rank <= 7"""


@query("research_findings", _SQL)
def _findings(p: Projection) -> DataFrame:
    p = Gathered.of(p)
    samples = _entities(p).where("entity = 'brand'").select("project_id", "sample_size")
    claims = stated_claims(p).select("project_id", F.lower(F.regexp_extract("subject", "COMP[0-9]", 0)).alias("competitor"), F.concat(F.lower("predicate"), F.lit(" "), F.lower("object")).alias("claim")).where("competitor <> ''")
    candidates = [
        research.competitor_leads(_advantages(p), _insights(p).select("project_id", "competitor"), samples),
        research.citation_openings(_gap_rows(p), _rivals(p)),
        research.content_openings(_gaps_by_topic(p)),
        research.weak_identity(_profiles(p)),
        research.technical_issues(_health(p)),
        research.emerging_names(_discovery(p).withColumn("status", F.lit("new"))),
        research.repeated_claims(claims, samples),
    ]
    return research.findings(candidates, samples).select("project_id", "rank", "generator", "key", "title", "confidence", "impact", "score")


# ---- evidence documents --------------------------------------------------------------------------------------------


def _documented(p: Projection) -> DataFrame:
    """Citation gaps with the documents they are stored with: their inputs, and how often each competitor is cited."""
    rivals = _window(p).where("is_competitor").groupBy("project_id", "domain_id", "competitor").agg(F.count("*").alias("n"))
    named = rivals.groupBy("project_id", "domain_id").agg(F.to_json(F.map_from_entries(F.collect_list(F.struct("competitor", "n")))).alias("competitors"))
    inputs = F.struct("domain_type", "eligible_responses", F.col("prompts").alias("prompts_citing"), "total_prompts", "source_relevance")
    rows = _gap_rows(p).select("project_id", "domain_id", "domain", "gap_type", "score", F.to_json(F.struct(inputs.alias("inputs"), F.lit("v1").alias("version"))).alias("evidence"))
    return rows.join(named, ["project_id", "domain_id"], "left")


@query("gap_evidence", f"{WITH}{_GAPS} SELECT project_id, domain, gap_type, domain_type AS source_type, eligible_responses, prompts AS prompts_citing, total_prompts, source_relevance FROM gap")
def _gap_evidence(p: Projection) -> DataFrame:
    return evidence.gap_facts(_documented(p)).select("project_id", "domain", "gap_type", "source_type", "eligible_responses", "prompts_citing", "total_prompts", "source_relevance")


@query("gaps_naming_competitor", f"{WITH}{_GAPS}, named AS (SELECT DISTINCT project_id, domain_id FROM wc WHERE is_competitor AND competitor = 'comp2') SELECT project_id, domain, gap_type, score FROM gap JOIN named USING (project_id, domain_id)")
def _gaps_naming(p: Projection) -> DataFrame:
    return evidence.naming(_documented(p), "comp2").select("project_id", "domain", "gap_type", "score")
