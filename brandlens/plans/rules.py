"""Queries over insights, alerts, content gaps, discovery and operations, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.functions import names as N
from brandlens.operators import competitive, operations, signals, verification
from brandlens.operators.visibility import with_period
from brandlens.plans.names import _TOPIC_SQL, prompt_texts, topic_coverage
from brandlens.plans.analytics import ORACLE_SQL, _BOTH, _CITED, _COMMERCIAL, _NOW, LONG, STATED, WITH, _entity_ctes, _observed, _seen, _window, _windowed, query, stated_claims
from brandlens.sources.projection import COMPETITORS, Gathered, Projection

# ---- insights ---------------------------------------------------------------------------------------------------

_CATEGORY_SQL = "CASE page_id % 6 WHEN 0 THEN 'comparison' WHEN 1 THEN 'product' WHEN 2 THEN 'faq' WHEN 3 THEN 'use_case' WHEN 4 THEN 'educational' END"
_PAGES = " + ".join("{s}_pages_" + c for c in signals.CONTENT_CATEGORIES)
_LEADS = " + ".join(f"CAST(c_pages_{c} > b_pages_{c} AS INTEGER)" for c in signals.CONTENT_CATEGORIES)
_COUNTED = ["citing_domains", "citation_rows", "research_domains", "research_citations", "specifics", *[f"pages_{c}" for c in signals.CONTENT_CATEGORIES]]


def _sides() -> str:
    own = ["score", "mentions", "prompts_appearing", "recommendation_share", "average_position"]
    pick = lambda s: ", ".join([f"{s}.{c} AS {s}_{c}" for c in own] + [f"coalesce({s}.{c}, 0) AS {s}_{c}" for c in _COUNTED])
    return f"{pick('c')}, {pick('b')}"


def _confidence_sql(n: str, s: str) -> str:
    return f"CASE WHEN {n} >= 50 AND {s} >= 20 THEN 'high' WHEN {n} >= 20 AND {s} >= 5 THEN 'medium' ELSE 'low' END"


def _ratio_sql(a: str, b: str) -> str:
    return f"coalesce(CAST({a} AS DOUBLE) / nullif(CAST({b} AS DOUBLE), 0), CAST({a} AS DOUBLE))"


_FACTS = f"""{_windowed(LONG)}{_entity_ctes("project_id")}{_CITED},
fr AS (SELECT x.*, d.domain_type, {_CATEGORY_SQL} AS page_category FROM (SELECT *, 'brand' AS entity FROM wc WHERE is_brand UNION ALL SELECT *, competitor AS entity FROM wc WHERE is_competitor) x JOIN domains d USING (domain_id)),
fp AS (SELECT project_id, entity, count(DISTINCT domain_id) AS citing_domains, count(*) AS citation_rows, count(DISTINCT CASE WHEN domain_type = 'research' THEN domain_id END) AS research_domains,
  count(*) FILTER (WHERE domain_type = 'research') AS research_citations, count(*) FILTER (WHERE strength = 'strong') AS specifics,
  {", ".join(f"count(DISTINCT CASE WHEN page_category = '{c}' THEN page_id END) AS pages_{c}" for c in signals.CONTENT_CATEGORIES)} FROM fr GROUP BY 1, 2),
both_sides AS (SELECT em.*, {", ".join(f"fp.{c}" for c in _COUNTED)} FROM em LEFT JOIN fp USING (project_id, entity)),
pt AS (SELECT project_id, count(DISTINCT prompt_id) AS total_prompts FROM windowed GROUP BY 1),
facts AS (SELECT c.project_id, c.entity AS competitor, c.sample_size, pt.total_prompts, {_sides()} FROM both_sides c JOIN both_sides b ON b.project_id = c.project_id AND b.entity = 'brand' JOIN pt ON pt.project_id = c.project_id
  WHERE c.entity <> 'brand' AND c.sample_size >= 10)"""


def _rule_sql(name: str, where: str, supporting: str, ratio: str, strength: str) -> str:
    return f"SELECT project_id, competitor, '{name}' AS insight_type, {_confidence_sql('sample_size', supporting)} AS confidence, CASE WHEN {ratio} >= 3 THEN 'high' WHEN {ratio} >= 1.5 THEN 'medium' ELSE 'low' END AS impact, round_even(least(100.0, {strength}), 1) AS strength FROM facts WHERE {where}"


_rec, _better = "(c_recommendation_share - b_recommendation_share)", "coalesce(b_average_position - c_average_position >= 0.5, false)"
_pos = _ratio_sql("c_recommendation_share", "b_recommendation_share")
_pos = f"CASE WHEN {_better} AND {_rec} >= 15 THEN greatest({_pos}, 1.5) ELSE {_pos} END"
_dom, _cov = _ratio_sql("c_citing_domains", "b_citing_domains"), _ratio_sql("c_prompts_appearing", "b_prompts_appearing")
_con = _ratio_sql(f"({_PAGES.format(s='c')})", f"({_PAGES.format(s='b')})")
_evi = f"greatest({_ratio_sql('c_research_domains', 'b_research_domains')}, {_ratio_sql('c_specifics', 'b_specifics')})"
_RULES = " UNION ALL ".join(
    [
        _rule_sql("citation_advantage", "c_citing_domains >= 5 AND c_citing_domains >= b_citing_domains + 4 AND c_citing_domains >= 1.5 * greatest(b_citing_domains, 1)", "c_citation_rows", _dom, f"20.0 * {_dom}"),
        _rule_sql("content_advantage", f"({_PAGES.format(s='c')}) >= 3 AND ({_LEADS}) >= 2", f"({_PAGES.format(s='c')})", _con, f"20.0 * {_con}"),
        _rule_sql("coverage_advantage", "total_prompts >= 3 AND c_prompts_appearing >= b_prompts_appearing + 2 AND c_prompts_appearing >= 1.4 * greatest(b_prompts_appearing, 1)", "c_mentions", _cov, f"25.0 * {_cov}"),
        _rule_sql("positioning_advantage", f"{_rec} IS NOT NULL AND ({_rec} >= 15 OR {_better})", "c_mentions", f"({_pos})", f"{_rec} + CASE WHEN {_better} THEN 20.0 ELSE 0.0 END"),
        _rule_sql("evidence_advantage", "(c_research_domains >= 2 AND c_research_domains > b_research_domains) OR (c_specifics >= 5 AND c_specifics >= 2 * greatest(b_specifics, 1))", "(c_research_citations + c_specifics)", _evi, "10.0 * (c_research_domains + c_specifics)"),
    ]
)


def _page_category():
    return F.get(F.array(*[F.lit(c) for c in signals.CONTENT_CATEGORIES], F.lit(None)), (F.col("page_id") % 6).cast("int"))


def _facts(p: Projection) -> DataFrame:
    metrics = competitive.entity_metrics(_seen(p, LONG), ["project_id"])
    totals = p.eligible_between(p.ago(LONG), p.now()).groupBy("project_id").agg(F.countDistinct("prompt_id").alias("total_prompts"))
    return signals.competitor_facts(metrics, signals.entity_footprint(_window(p), p.domains, _page_category()), totals)


@query("insights", f"{WITH}{_FACTS} {_RULES}")
def _insights(p: Projection) -> DataFrame:
    return signals.insights(_facts(p))


@query(
    "insight_entity_advantage",
    f"""{WITH}{_FACTS}, prof AS (SELECT DISTINCT project_id, project_id % 2 = 0 AS has_organization, false AS has_description, 0 AS products, 0 AS same_as_links, 1 AS organization_names, 10 AS pages_crawled FROM prompts),
g AS (SELECT *, CAST(NOT has_organization AS INTEGER) + CAST(has_organization AND NOT has_description AS INTEGER) + CAST(products = 0 AS INTEGER) + CAST(same_as_links = 0 AS INTEGER) + CAST(organization_names > 1 AS INTEGER) AS gaps FROM facts JOIN prof USING (project_id))
SELECT project_id, competitor, 'entity_advantage' AS insight_type, CASE WHEN sample_size >= 20 THEN 'medium' ELSE 'low' END AS confidence, gaps FROM g WHERE c_score - b_score >= 10 AND pages_crawled > 0 AND gaps >= 2""",
)
def _entity_advantage(p: Projection) -> DataFrame:
    profiles = p.prompts.select("project_id").distinct().select(
        "project_id", (F.col("project_id") % 2 == 0).alias("has_organization"), F.lit(False).alias("has_description"), F.lit(0).alias("products"), F.lit(0).alias("same_as_links"), F.lit(1).alias("organization_names"), F.lit(10).alias("pages_crawled")
    )
    return signals.entity_insights(_facts(p), profiles)


# ---- alerts -----------------------------------------------------------------------------------------------------

_HALVES = f", windowed AS (SELECT *, CASE WHEN completed_at >= {_NOW} - INTERVAL 30 DAY THEN 'current' ELSE 'previous' END AS period FROM views WHERE completed_at >= {_NOW} - INTERVAL 60 DAY AND completed_at < {_NOW})"
_MEASURES = f"""{_HALVES}{_entity_ctes("project_id, period")},
ms AS (SELECT project_id, period, entity, score, sample_size, round_even(100.0 * mentions / sample_size, 2) AS share, round_even(100.0 * cited_responses / sample_size, 2) AS cited FROM em),
mw AS (SELECT project_id, entity, {", ".join(f"max(CASE WHEN period = '{p}' THEN {c} END) AS {c}_{p[0]}" for p in ("current", "previous") for c in ("score", "share", "cited", "sample_size"))} FROM ms GROUP BY 1, 2),
mm AS (SELECT * FROM mw WHERE sample_size_c >= 10 AND sample_size_p >= 10),
rv AS (SELECT r.*, b.score_c AS bsc, b.score_p AS bsp, b.cited_c AS bcc, b.cited_p AS bcp FROM mm r JOIN mm b ON b.project_id = r.project_id AND b.entity = 'brand' WHERE r.entity <> 'brand')"""


def _alert_sql(name: str, table: str, subject: str, magnitude: str, base: str, up: str, threshold: float, a: str, b: str, where: str) -> str:
    return f"SELECT project_id, '{name}' AS alert_type, {subject} AS subject, round_even({magnitude}, 2) AS magnitude, CASE WHEN {magnitude} >= {2 * threshold} THEN '{up}' ELSE '{base}' END AS severity, substr(sha256(CAST(CAST(round_even({a}, 0) AS INTEGER) AS VARCHAR) || '|' || CAST(CAST(round_even({b}, 0) AS INTEGER) AS VARCHAR)), 1, 12) AS fingerprint FROM {table} WHERE {where}"


_ALERTS = " UNION ALL ".join(
    [
        _alert_sql("visibility_drop", "mm", "'brand'", "(share_p - share_c)", "high", "critical", 10.0, "share_p", "share_c", "entity = 'brand' AND share_p - share_c >= 10"),
        _alert_sql("competitor_visibility_jump", "rv", "entity", "(share_c - share_p)", "medium", "high", 15.0, "share_p", "share_c", "share_c - share_p >= 15"),
        _alert_sql("competitor_overtakes_brand", "rv", "entity", "(score_c - bsc)", "high", "critical", 5.0, "score_c", "bsc", "score_p <= bsp AND score_c - bsc >= 5"),
        _alert_sql("citation_gap_increase", "rv", "entity", "((cited_c - bcc) - (cited_p - bcp))", "medium", "high", 15.0, "(cited_p - bcp)", "(cited_c - bcc)", "(cited_c - bcc) - (cited_p - bcp) >= 15 AND cited_c - bcc > 0"),
    ]
)


@query("alerts_period_rules", f"{WITH}{_MEASURES} {_ALERTS}")
def _period_alerts(p: Projection) -> DataFrame:
    return signals.period_alerts(signals.period_measures(with_period(p.entity_views, "completed_at", p.now(), 30)))


@query(
    "alerts_period_measures",
    f"{WITH}{_MEASURES} SELECT * FROM mw",
)
def _measures(p: Projection) -> DataFrame:
    return signals.period_measures(with_period(p.entity_views, "completed_at", p.now(), 30))


@query("alerts_new_sources", f"{WITH} SELECT project_id, page_id, min(cited_at) AS first_at, count(*) FILTER (WHERE cited_at >= {_NOW} - INTERVAL 800 DAY) AS citations FROM cited GROUP BY 1, 2 HAVING min(cited_at) >= {_NOW} - INTERVAL 800 DAY AND count(*) >= 2")
def _new_sources(p: Projection) -> DataFrame:
    return signals.new_sources(p.cited(), p.ago(800), source="page_id")


@query(
    "alerts_new_claims",
    f"""{WITH}{STATED}, t AS (SELECT project_id, lower(trim(subject)) AS subject, lower(predicate) AS predicate, lower(object) AS object, claimed_at FROM stated WHERE lower(subject) LIKE '%comp_%')
SELECT project_id, subject, predicate, object, count(*) AS occurrences FROM t n WHERE claimed_at >= {_NOW} - INTERVAL 2300 DAY
  AND NOT EXISTS (SELECT 1 FROM t o WHERE o.claimed_at < {_NOW} - INTERVAL 2300 DAY AND o.project_id = n.project_id AND o.subject = n.subject AND o.predicate = n.predicate AND o.object = n.object) GROUP BY 1, 2, 3, 4""",
)
def _new_claims(p: Projection) -> DataFrame:
    return signals.new_claims(stated_claims(p), COMPETITORS, p.ago(2300))


@query(
    "insight_claim_signals",
    f"""{WITH}{STATED}, n(entity, name) AS (VALUES ('brand', 'brand'), {", ".join(f"('{c}', '{c}')" for c in COMPETITORS)}),
t AS (SELECT project_id, entity, claimed_at, regexp_matches(object, '[0-9]') OR regexp_matches(context, '[0-9]') AS specific, substr(subject || ' ' || predicate || ' ' || object, 1, 200) AS text FROM stated JOIN n ON contains(lower(subject), name)),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, entity, specific ORDER BY claimed_at, text) AS k FROM t)
SELECT project_id, entity, count(*) AS claims, count(*) FILTER (WHERE specific) AS specific_claims, coalesce(string_agg(text, '|' ORDER BY k) FILTER (WHERE specific AND k <= 5), '') AS examples FROM r GROUP BY 1, 2""",
)
def _claim_signals(p: Projection) -> DataFrame:
    return signals.claim_signals(stated_claims(p), "brand", COMPETITORS).withColumn("examples", F.array_join("examples", "|"))


# ---- content gaps, discovery ------------------------------------------------------------------------------------

_TOPICS = f"""{_windowed(3000)}, wc AS (SELECT * FROM cited WHERE cited_at >= {_NOW} - INTERVAL 3000 DAY AND cited_at < {_NOW}),
tg AS (SELECT project_id, prompt_id, category, funnel_stage, count(DISTINCT run_id) AS responses, min(completed_at) AS first_at, count(*) FILTER (WHERE entity = 'brand' AND mentioned) AS brand_mentions,
  greatest({", ".join(f"count(*) FILTER (WHERE entity = '{c}' AND mentioned)" for c in COMPETITORS)}) AS top_competitor_mentions FROM windowed GROUP BY 1, 2, 3, 4),
tc AS (SELECT project_id, prompt_id, count(*) AS citations, count(*) FILTER (WHERE is_brand) AS brand_cited, count(*) FILTER (WHERE is_competitor AND domain_type = 'research') AS competitor_research FROM wc JOIN domains USING (domain_id) GROUP BY 1, 2),
tf AS (SELECT tg.*, coalesce(citations, 0) AS citations, coalesce(brand_cited, 0) AS brand_cited, coalesce(competitor_research, 0) AS competitor_research FROM tg LEFT JOIN tc USING (project_id, prompt_id))"""


def _topics(p: Projection) -> DataFrame:
    return signals.topic_facts(_observed(p, 3000), _window(p, 3000), p.domains, COMPETITORS)


@query("content_gap_topics", f"{WITH}{_TOPICS} SELECT * FROM tf")
def _gap_topics(p: Projection) -> DataFrame:
    return _topics(p)


_PROMPT_TEXT = "'Which ' || p_name || ' for ' || lower(p_type) || ' ' || replace(lower(p_brand), '#', '-') || ' is best?'"
_HAS_NEEDED = " ".join(f"WHEN '{gap}' THEN has_{page}" for gap, page in signals.NEEDED_PAGES.items())
_GAPS = f"""{WITH}{_TOPICS}, {_TOPIC_SQL}, pt AS (SELECT p_partkey AS prompt_id, {_PROMPT_TEXT} AS t FROM part), tl AS (SELECT t, min(prompt_id) AS topic_id FROM pt GROUP BY t),
tn AS (SELECT tf.*, 100.0 * top_competitor_mentions / responses AS cr, 100.0 * brand_mentions / responses AS br, coalesce(cov.coverage, 0.0) AS coverage, pt.t, cov.* EXCLUDE (topic_id, pages, coverage),
    CASE WHEN category IN ('comparison', 'alternative') THEN 'missing_comparison' WHEN category IN ('pricing', 'product') THEN 'missing_product_detail' WHEN category = 'industry' THEN 'missing_use_case'
      WHEN category IN ('problem_solution', 'faq') OR regexp_matches(ltrim(pt.t), '(?i)^(how|can|does|do|is|are|should|why|when)\\b') THEN 'missing_faq'
      WHEN category = 'discovery' AND regexp_matches(lower(pt.t), '\\bfor\\s+[a-z]+') THEN 'missing_use_case' END AS needed
  FROM tf LEFT JOIN pt USING (prompt_id) LEFT JOIN tl USING (t) LEFT JOIN cov USING (topic_id)),
tk AS (SELECT *, CASE WHEN coverage = 0 THEN coalesce(needed, 'missing_topic') WHEN coverage < 1 THEN 'weak_topic' WHEN needed IS NOT NULL AND NOT coalesce(CASE needed {_HAS_NEEDED} END, false) THEN needed END AS g1 FROM tn WHERE responses >= 5 AND cr >= 40 AND cr - br >= 20),
t2 AS (SELECT *, CASE WHEN competitor_research > 0 AND brand_cited = 0 AND coalesce(g1, '') <> 'missing_topic' THEN 'missing_evidence' END AS g2 FROM tk),
tt AS (SELECT *, g1 AS gap_type FROM t2 WHERE g1 IS NOT NULL UNION ALL SELECT *, g2 FROM t2 WHERE g2 IS NOT NULL),
gaps AS (SELECT project_id, prompt_id, category, responses, first_at, gap_type, CASE WHEN responses >= 20 THEN 'high' WHEN responses >= 10 THEN 'medium' ELSE 'low' END AS confidence,
  round_even(30.0 * greatest(0.0, cr - br) / 100.0 + 25.0 * least(1.0, responses / 10.0) + CASE WHEN {_COMMERCIAL} THEN 20.0 ELSE 8.0 END + 15.0 * (1.0 - coverage) + CASE WHEN citations > 0 THEN 10.0 ELSE 3.0 END, 1) AS score,
  CASE WHEN cr >= 60 THEN 'high' WHEN cr >= 30 THEN 'medium' ELSE 'low' END AS visibility_band, t FROM tt)"""


def _gaps_with_text(p: Projection) -> DataFrame:
    covered = prompt_texts(p).join(topic_coverage(p), "t").select("prompt_id", "t", "coverage", "categories")
    facts = _topics(p).join(covered, "prompt_id", "left").withColumn("coverage", F.coalesce("coverage", F.lit(0.0))).withColumn("needed", signals.needed_gap(F.col("category"), F.col("t")))
    page = F.create_map(*[F.lit(x) for pair in signals.NEEDED_PAGES.items() for x in pair])
    facts = facts.withColumn("has_needed", F.coalesce(F.array_contains("categories", F.try_element_at(page, F.col("needed"))), F.lit(False)))
    return signals.content_gaps(facts)


@query("content_gap_scores", f"{_GAPS} SELECT * EXCLUDE (t, first_at) FROM gaps")
def _gap_scores(p: Projection) -> DataFrame:
    return _gaps_with_text(p).drop("first_at")


@query(
    "content_gaps_by_topic",
    f"""{_GAPS}, words AS (SELECT *, list_filter(regexp_extract_all(lower(t), '[a-z0-9][a-z0-9''-]+'), lambda w: length(w) >= 3 AND w NOT IN ({", ".join(f"'{w}'" for w in [*N.TOPIC_STOP_WORDS, *N.TOPIC_GENERIC_WORDS])})) AS k FROM gaps),
named AS (SELECT * EXCLUDE (k), substr(array_to_string(list_sort(list_distinct(regexp_extract_all(lower(substr(CASE WHEN len(k) = 0 THEN t ELSE array_to_string(k, ' ') END, 1, 300)), '[a-z0-9][a-z0-9''-]+'))), ' '), 1, 300) AS topic FROM words)
SELECT topic, project_id, prompt_id, category, responses, gap_type, confidence, score, visibility_band
FROM (SELECT *, row_number() OVER (PARTITION BY project_id, topic, gap_type ORDER BY first_at, prompt_id) AS n FROM named) WHERE n = 1""",
)
def _gaps_by_topic(p: Projection) -> DataFrame:
    gaps = _gaps_with_text(p).join(prompt_texts(p), "prompt_id")
    found = signals.distinct_gaps(gaps, N.normalized_topic(N.topic_label(F.col("t"))), ["first_at", "prompt_id"])
    return found.drop("first_at", "t")


@query(
    "discovery_scores",
    f"""{WITH}{_CITED}, cd AS (SELECT project_id, 'part' || (page_id % 200) AS name, count(DISTINCT run_id) AS responses, count(DISTINCT CASE WHEN is_competitor THEN run_id END) AS co_occurring, count(DISTINCT CASE WHEN {_COMMERCIAL} THEN prompt_id END) AS commercial_prompts,
    count(DISTINCT prompt_id) AS prompts, bool_or(is_brand) AS has_domain, count(*) AS observations, count(*) FILTER (WHERE strength = 'strong') AS language_hits, count(DISTINCT provider) AS providers FROM wc GROUP BY 1, 2),
cs AS (SELECT *, round_even(0.30 * round_even(least(1.0, log10(responses + 1.0) / log10(11.0)), 3) + 0.20 * round_even(CAST(0.6 AS DOUBLE) * co_occurring / responses + CAST(0.4 AS DOUBLE) * commercial_prompts / greatest(prompts, 1), 3) + 0.15 * CAST(has_domain AS INTEGER)
    + 0.20 * round_even(language_hits / CAST(observations AS DOUBLE), 3) + 0.15 * round_even(CAST(providers AS DOUBLE) / 5, 3), 5) AS confidence FROM cd WHERE responses >= 2)
SELECT *, CASE WHEN confidence >= 0.7 THEN 'high' WHEN confidence >= 0.4 THEN 'medium' ELSE 'low' END AS label FROM cs""",
)
def _discovery(p: Projection) -> DataFrame:
    from brandlens.operators.gaps import is_commercial

    name = lambda page: F.concat(F.lit("part"), (page % 200).cast("string"))
    if not isinstance(p, Gathered):
        g = _window(p).withColumn("name", name(F.col("page_id"))).groupBy("project_id", "name").agg(
            F.countDistinct("run_id").alias("responses"),
            F.countDistinct(F.when(F.col("is_competitor"), F.col("run_id"))).alias("co_occurring"),
            F.countDistinct(F.when(is_commercial(), F.col("prompt_id"))).alias("commercial_prompts"),
            F.countDistinct("prompt_id").alias("prompts"),
            F.bool_or("is_brand").alias("has_domain"),
            F.count("*").alias("observations"),
            F.count_if(F.col("strength") == "strong").alias("language_hits"),
            F.countDistinct("provider").alias("providers"),
        )
        return signals.candidate_scores(g, F.lit(5.0))
    # responses are counted by their first citation of a name, prompts as groups; providers are few
    c = p.cited(p.ago(LONG), p.now(), first=lambda c: F.struct(name(c["page_id"])), beside=lambda c: F.when(c["is_competitor"], F.struct(name(c["page_id"])))).withColumn("name", name(F.col("page_id")))
    counts = {"responses": F.count_if("first"), "co_occurring": F.count_if("beside"), "observations": F.count("*"), "language_hits": F.count_if(F.col("strength") == "strong")}
    by_prompt = c.groupBy("project_id", "name", "prompt_id").agg(*[x.alias(k) for k, x in counts.items()], F.bool_or("is_brand").alias("has_domain"), F.bool_or(is_commercial()).alias("commercial"))
    g = by_prompt.groupBy("project_id", "name").agg(*[F.sum(k).alias(k) for k in counts], F.bool_or("has_domain").alias("has_domain"), F.count("*").alias("prompts"), F.count_if("commercial").alias("commercial_prompts"))
    seen = c.groupBy(F.col("project_id").alias("_project"), F.col("name").alias("_name")).agg(F.countDistinct("provider").alias("providers"))
    g = g.join(seen, F.col("project_id").eqNullSafe(F.col("_project")) & F.col("name").eqNullSafe(F.col("_name"))).drop("_project", "_name")
    return signals.candidate_scores(g, F.lit(5.0))


# ---- operations -------------------------------------------------------------------------------------------------


@query("latest_run_per_prompt", "SELECT prompt_id, run_id, completed_at, status FROM (SELECT o_custkey AS prompt_id, o_orderkey AS run_id, o_orderdate AS completed_at, CASE WHEN o_orderstatus = 'P' THEN 'failed' ELSE 'completed' END AS status, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n = 1")
def _latest_run(p: Projection) -> DataFrame:
    return operations.latest(p.runs.select("prompt_id", "run_id", "completed_at", "status"), ["prompt_id"], "completed_at", "run_id")


@query("retention_candidates", "SELECT prompt_id, run_id, completed_at FROM (SELECT o_custkey AS prompt_id, o_orderkey AS run_id, o_orderdate AS completed_at, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS n FROM orders) WHERE n > 1")
def _retention(p: Projection) -> DataFrame:
    return operations.superseded(p.runs.select("prompt_id", "run_id", "completed_at"), ["prompt_id"], "completed_at", "run_id")


@query(
    "batch_status",
    """SELECT batch_id, total, completed, failed, cancelled, CASE WHEN completed + failed + cancelled < total THEN 'running' WHEN cancelled > 0 AND completed = 0 AND failed = 0 THEN 'cancelled' WHEN completed = 0 AND failed > 0 THEN 'failed'
  WHEN completed > 0 AND failed > 0 THEN 'partial' ELSE 'completed' END AS batch_status
FROM (SELECT o_custkey AS batch_id, count(*) AS total, count(*) FILTER (WHERE o_orderstatus = 'F') AS completed, count(*) FILTER (WHERE o_orderstatus = 'P') AS failed, count(*) FILTER (WHERE o_orderstatus = 'O' AND o_orderkey % 2 = 0) AS cancelled FROM orders GROUP BY 1)""",
)
def _batch(p: Projection) -> DataFrame:
    o = F.col("o_orderstatus")
    status = F.when(o == "F", "completed").when(o == "P", "failed").when(F.col("o_orderkey") % 2 == 0, "cancelled").otherwise("queued")
    return operations.batch_status(p.table("orders").select(F.col("o_custkey").alias("batch_id"), status.alias("status")), "batch_id")


@query(
    "reaper_candidates",
    """WITH j AS (SELECT event_id, CASE event_type WHEN 'click' THEN 'crawl' WHEN 'view' THEN 'audit' WHEN 'purchase' THEN 'prompt_run' ELSE 'agent_run' END AS kind, CASE WHEN user_id % 2 = 0 THEN 'running' ELSE 'queued' END AS status, ts AS since FROM events WHERE ts >= TIMESTAMP '2024-01-30'),
a AS (SELECT *, date_diff('second', since, TIMESTAMP '2024-01-31') / 3600.0 AS age, CASE kind WHEN 'crawl' THEN CASE status WHEN 'running' THEN 7 ELSE 2 END WHEN 'prompt_run' THEN CASE status WHEN 'running' THEN 1 ELSE 12 END ELSE CASE status WHEN 'running' THEN 1 ELSE 2 END END AS most FROM j)
SELECT event_id, kind, status, round_even(age, 3) AS age_hours FROM a WHERE age > most""",
)
def _reaper(p: Projection) -> DataFrame:
    e = p.table("events").where(F.col("ts") >= F.lit("2024-01-30").cast("timestamp_ntz"))
    t = F.col("event_type")
    kind = F.when(t == "click", "crawl").when(t == "view", "audit").when(t == "purchase", "prompt_run").otherwise("agent_run")
    since = F.date_trunc("second", F.col("ts")).cast("timestamp_ntz")
    jobs = e.select("event_id", kind.alias("kind"), F.when(F.col("user_id") % 2 == 0, "running").otherwise("queued").alias("status"), since.alias("since"))
    return operations.stale_jobs(jobs, F.lit("2024-01-31").cast("timestamp_ntz")).select("event_id", "kind", "status", "age_hours")


@query(
    "schedule_next_run",
    """WITH s AS (SELECT event_id, date_trunc('second', ts) AS now, CASE WHEN event_id % 2 = 0 THEN 'daily' ELSE 'weekly' END AS cadence, CAST(user_id % 24 AS INTEGER) AS hour, CAST(event_id % 7 AS INTEGER) AS weekday FROM events),
c AS (SELECT *, date_trunc('day', now) + to_hours(hour) AS today, (weekday - (isodow(now) - 1) + 7) % 7 AS ahead FROM s)
SELECT event_id, cadence, CASE WHEN cadence = 'daily' THEN CASE WHEN today <= now THEN today + INTERVAL 1 DAY ELSE today END ELSE CASE WHEN today + to_days(CAST(ahead AS INTEGER)) <= now THEN today + to_days(CAST(ahead AS INTEGER)) + INTERVAL 7 DAY ELSE today + to_days(CAST(ahead AS INTEGER)) END END AS next_run_at FROM c""",
)
def _schedule(p: Projection) -> DataFrame:
    e = p.table("events").select("event_id", F.date_trunc("second", "ts").cast("timestamp_ntz").alias("now"), F.when(F.col("event_id") % 2 == 0, "daily").otherwise("weekly").alias("cadence"), (F.col("user_id") % 24).cast("int").alias("hour"), (F.col("event_id") % 7).cast("int").alias("weekday"))
    return e.select("event_id", "cadence", operations.next_run(F.col("cadence"), F.col("hour"), F.col("weekday"), F.col("now")).cast("timestamp_ntz").alias("next_run_at"))


@query(
    "usage_cost",
    """SELECT o_orderpriority AS provider, count(*) AS runs, CAST(sum(l_partkey) AS BIGINT) AS input_tokens, CAST(sum(l_suppkey) AS BIGINT) AS output_tokens,
  CAST(sum((l_partkey * 25 + l_suppkey * 100 + 5) // 10) AS DOUBLE) / 1000000 AS cost FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1""",
)
def _usage(p: Projection) -> DataFrame:
    rows = p.table("lineitem").join(p.runs.select(F.col("run_id").alias("l_orderkey"), "provider"), "l_orderkey")
    spent = operations.cost(F.col("l_partkey"), F.col("l_suppkey"), "2.5", "10")
    return rows.groupBy("provider").agg(F.count("*").alias("runs"), F.sum("l_partkey").alias("input_tokens"), F.sum("l_suppkey").alias("output_tokens"), F.sum(spent).cast("double").alias("cost"))


@query(
    "project_sources",
    f"""{WITH} SELECT project_id, domain_id, NULL AS page_id, count(*) AS citations, count(*) FILTER (WHERE is_brand) AS brand_citations, count(*) FILTER (WHERE is_competitor) AS competitor_citations, min(cited_at) AS first_cited_at, max(cited_at) AS last_cited_at FROM cited GROUP BY 1, 2
UNION ALL SELECT project_id, domain_id, page_id, count(*), count(*) FILTER (WHERE is_brand), count(*) FILTER (WHERE is_competitor), min(cited_at), max(cited_at) FROM cited GROUP BY 1, 2, 3""",
)
def _project_sources(p: Projection) -> DataFrame:
    return operations.project_sources(p.cited())


@query(
    "digest_summary",
    f"""{WITH}, o AS (SELECT project_id, {", ".join(f"count(DISTINCT CASE WHEN completed_at {op} {_NOW} - INTERVAL 7 DAY THEN run_id END) AS responses_{n}" for n, op in (("current", ">="), ("previous", "<")))},
    {", ".join(f"count(*) FILTER (WHERE entity = 'brand' AND mentioned AND completed_at {op} {_NOW} - INTERVAL 7 DAY) AS mentions_{n}" for n, op in (("current", ">="), ("previous", "<")))} FROM views WHERE completed_at >= {_NOW} - INTERVAL 14 DAY AND completed_at < {_NOW} GROUP BY 1),
c AS (SELECT project_id, {", ".join(f"count(*) FILTER (WHERE cited_at {op} {_NOW} - INTERVAL 7 DAY) AS citations_{n}" for n, op in (("current", ">="), ("previous", "<")))} FROM cited WHERE cited_at >= {_NOW} - INTERVAL 14 DAY AND cited_at < {_NOW} GROUP BY 1)
SELECT project_id, responses_current, responses_previous, mentions_current, mentions_previous, coalesce(citations_current, 0) AS citations_current, coalesce(citations_previous, 0) AS citations_previous, responses_current = 0 AND coalesce(citations_current, 0) = 0 AS quiet FROM o LEFT JOIN c USING (project_id)""",
)
def _digest(p: Projection) -> DataFrame:
    return operations.digest(p.observations, p.cited(), p.now())


@query(
    "audit_verification",
    """WITH i AS (SELECT DISTINCT event_type AS code, CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id END AS url, event_id % 2 AS audit FROM events),
l AS (SELECT code, url FROM i WHERE audit = 1), p AS (SELECT code, url FROM i WHERE audit = 0)
SELECT code, url, 'verified' AS state FROM p WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.code = p.code AND l.url IS NOT DISTINCT FROM p.url)
UNION ALL SELECT code, url, CASE WHEN EXISTS (SELECT 1 FROM p WHERE l.code = p.code AND l.url IS NOT DISTINCT FROM p.url) THEN 'awaiting' ELSE 'new' END FROM l""",
)
def _verification(p: Projection) -> DataFrame:
    i = p.table("events").select(F.col("event_type").alias("code"), F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("url"), (F.col("event_id") % 2).alias("audit")).distinct()
    return operations.verification(i.where("audit = 1").select("code", "url"), i.where("audit = 0").select("code", "url"))


_ISSUE_URL = "CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id || '/' || hour(ts) END"


@query(
    "audit_verification_all",
    f"""WITH i AS (SELECT DISTINCT event_type AS code, {_ISSUE_URL} AS url, day(ts) > 15 AS latest FROM events),
k AS (SELECT code, url, bool_or(latest) AS now, bool_or(NOT latest) AS before FROM i GROUP BY 1, 2)
SELECT code, url, CASE WHEN now AND before THEN 'awaiting' WHEN now THEN 'new' ELSE 'verified' END AS state FROM k""",
)
def _verification_all(p: Projection) -> DataFrame:
    """Two audits from all events: those of the first half of the month, and those after it."""
    i = p.table("events").select(F.col("event_type").alias("code"), F.expr(_ISSUE_URL).alias("url"), (F.dayofmonth("ts") > 15).alias("latest")).distinct()
    return operations.verification(i.where("latest").select("code", "url"), i.where("NOT latest").select("code", "url"))


#: An audit for each project and week; an issue is resolved by the last event on it, some time after the audit.
_AUDIT_SQL = """ev AS (SELECT user_id % 3 AS project_id, CAST((day(ts) - 1) // 7 AS INTEGER) AS week, event_type AS code, CASE WHEN user_id % 5 <> 0 THEN 'u' || user_id || '/' || hour(ts) % 4 END AS url, event_id, ts FROM events),
au AS (SELECT project_id * 10 + week AS audit_id, project_id, week, TIMESTAMP '2024-01-07 00:00:00' + to_days(CAST(week * 7 AS INTEGER)) AS completed_at, round_even(100 - count(*) % 40 / 4.0, 1) AS health_score FROM ev GROUP BY project_id, week),
ob AS (SELECT project_id * 10 + week AS audit_id, code, url, CASE WHEN max(event_id) % 3 = 0 THEN 'resolved' ELSE 'open' END AS status, max(ts) + to_days(CAST(max(event_id) % 12 AS INTEGER)) AS updated_at FROM ev GROUP BY 1, 2, 3),
sq AS (SELECT *, row_number() OVER w AS n, lead(audit_id) OVER w AS next_id, lead(completed_at) OVER w AS next_at, lead(health_score) OVER w AS next_score FROM au WINDOW w AS (PARTITION BY project_id ORDER BY completed_at, audit_id))"""


def _audits(p: Projection) -> tuple[DataFrame, DataFrame]:
    url = F.when(F.col("user_id") % 5 != 0, F.concat(F.lit("u"), F.col("user_id").cast("string"), F.lit("/"), (F.hour("ts") % 4).cast("string")))
    ev = p.table("events").select((F.col("user_id") % 3).alias("project_id"), F.floor((F.dayofmonth("ts") - 1) / 7).cast("int").alias("week"), F.col("event_type").alias("code"), url.alias("url"), "event_id", "ts")
    ev = ev.withColumn("audit_id", F.col("project_id") * 10 + F.col("week"))
    later = lambda days: F.make_dt_interval(days.cast("int"))
    audits = ev.groupBy("audit_id", "project_id", "week").agg(F.bround(100 - F.count("*") % 40 / 4.0, 1).alias("health_score"))
    audits = audits.select("project_id", "audit_id", F.lit("completed").alias("status"), (F.lit("2024-01-07 00:00:00").cast("timestamp_ntz") + later(F.col("week") * 7)).alias("completed_at"), "health_score")
    seen = ev.groupBy("audit_id", "code", "url").agg(F.when(F.max("event_id") % 3 == 0, "resolved").otherwise("open").alias("status"), (F.max("ts").cast("timestamp_ntz") + later(F.max("event_id") % 12)).alias("updated_at"))
    return audits, seen


@query(
    "verification_lifecycle",
    f"""WITH {_AUDIT_SQL}, k AS (SELECT DISTINCT audit_id, code, coalesce(url, '') AS u FROM ob)
SELECT project_id, o.audit_id, o.code, url, CASE WHEN NOT coalesce(updated_at < next_at, false) THEN 'awaiting' WHEN k.audit_id IS NOT NULL THEN 'reappeared' ELSE 'verified' END AS state,
  CASE WHEN coalesce(updated_at < next_at, false) THEN next_id END AS verified_by, round_even(next_score - health_score, 1) AS score_change
FROM ob o JOIN sq USING (audit_id) LEFT JOIN k ON k.audit_id = sq.next_id AND k.code = o.code AND k.u = coalesce(o.url, '') WHERE status = 'resolved'""",
)
def _lifecycle(p: Projection) -> DataFrame:
    return verification.verification_lifecycle(*_audits(p))


@query(
    "issue_islands",
    f"""WITH {_AUDIT_SQL}, s AS (SELECT DISTINCT project_id, code, url, o.audit_id, n, next_id FROM ob o JOIN sq USING (audit_id)),
r AS (SELECT *, n - row_number() OVER (PARTITION BY project_id, code, url ORDER BY n) AS run FROM s),
g AS (SELECT project_id, code, url, run, min(audit_id) AS first_audit, max(audit_id) AS last_audit, count(*) AS audits, bool_or(next_id IS NULL) AS is_open FROM r GROUP BY 1, 2, 3, 4)
SELECT project_id, code, url, first_audit, last_audit, audits, is_open, CAST(row_number() OVER (PARTITION BY project_id, code, url ORDER BY run) AS INTEGER) AS island FROM g""",
)
def _islands(p: Projection) -> DataFrame:
    return verification.issue_islands(*_audits(p))


@query(
    "gap_merge_idempotent",
    f"""{WITH}, f AS (SELECT DISTINCT project_id, domain_id FROM cited WHERE cited_at >= {_NOW} - INTERVAL 365 DAY), e AS (SELECT DISTINCT project_id, domain_id FROM cited WHERE cited_at < {_NOW} - INTERVAL 2300 DAY),
n AS (SELECT project_id, domain_id, count(*) AS citations FROM cited WHERE cited_at >= {_NOW} - INTERVAL 365 DAY GROUP BY 1, 2)
SELECT coalesce(n.project_id, e.project_id) AS project_id, coalesce(n.domain_id, e.domain_id) AS domain_id, coalesce(n.citations, 0) AS citations, CASE WHEN e.domain_id IS NULL OR e.domain_id % 2 = 0 THEN 'new' ELSE 'dismissed' END AS status
FROM n FULL JOIN e ON n.project_id = e.project_id AND n.domain_id = e.domain_id WHERE n.domain_id IS NOT NULL OR e.domain_id % 2 = 1""",
)
def _merge(p: Projection) -> DataFrame:
    fresh = p.cited(p.ago(365), p.now()).groupBy("project_id", "domain_id").agg(F.count("*").alias("citations"))
    old = p.cited().where(F.col("cited_at") < p.ago(2300)).select("project_id", "domain_id").distinct().select("*", F.lit(0).cast("bigint").alias("citations"), F.when(F.col("domain_id") % 2 == 0, "new").otherwise("dismissed").alias("status"))
    merge = lambda existing: operations.merge(existing, fresh, ["project_id", "domain_id"], ["status"], {"status": "new"})
    return merge(merge(old))


@query("citation_list", f"{WITH} SELECT project_id, run_id, position, domain, is_brand, is_competitor, competitor FROM cited JOIN domains USING (domain_id) WHERE domain_type IN ('review', 'media') AND is_competitor AND cited_at >= {_NOW} - INTERVAL 365 DAY AND cited_at < {_NOW}")
def _citation_list(p: Projection) -> DataFrame:
    rows = p.cited(p.ago(365), p.now()).where("is_competitor").join(p.domains.where(F.col("domain_type").isin("review", "media")), "domain_id")
    return rows.select("project_id", "run_id", "position", "domain", "is_brand", "is_competitor", "competitor")


@query(
    "source_profile",
    f"""{WITH} SELECT domain_id, count(*) AS citations, count(DISTINCT project_id) AS projects, count(DISTINCT date_trunc('week', cited_at)) AS weeks, count(DISTINCT page_id) AS pages, count(*) FILTER (WHERE project_id = 1) AS own_citations, string_agg(DISTINCT CASE WHEN is_competitor THEN competitor END, ',' ORDER BY CASE WHEN is_competitor THEN competitor END) AS competitors FROM cited GROUP BY 1""",
)
def _profile(p: Projection) -> DataFrame:
    return p.cited().groupBy("domain_id").agg(
        F.count("*").alias("citations"),
        F.countDistinct("project_id").alias("projects"),
        F.countDistinct(F.date_trunc("week", "cited_at")).alias("weeks"),
        F.countDistinct("page_id").alias("pages"),
        F.count_if(F.col("project_id") == 1).alias("own_citations"),
        F.nullif(F.array_join(F.array_sort(F.collect_set(F.when(F.col("is_competitor"), F.col("competitor")))), ","), F.lit("")).alias("competitors"),
    )


@query(
    "research_facts",
    f"""{WITH}{_CITED}, g AS (SELECT project_id, count(*) FILTER (WHERE is_competitor) AS competitor_citations, count(*) FILTER (WHERE is_brand) AS brand_citations, count(DISTINCT run_id) AS responses, count(DISTINCT prompt_id) AS prompts,
  count(DISTINCT CASE WHEN {_COMMERCIAL} THEN prompt_id END) AS commercial_prompts FROM wc JOIN domains USING (domain_id) WHERE domain_type = 'research' GROUP BY 1),
n AS (SELECT project_id, count(*) AS eligible_responses FROM eligible WHERE completed_at >= {_NOW} - INTERVAL {LONG} DAY AND completed_at < {_NOW} GROUP BY 1),
r AS (SELECT *, concat_ws(',', CASE WHEN competitor_citations < 3 THEN 'few_competitor_citations' END, CASE WHEN responses < 2 THEN 'few_responses' END, CASE WHEN brand_citations > 0 THEN 'brand_is_cited' END,
  CASE WHEN commercial_prompts / CAST(prompts AS DOUBLE) < 0.5 THEN 'not_commercial' END) AS reasons FROM g JOIN n USING (project_id))
SELECT *, reasons = '' AS warranted, CASE WHEN responses >= 20 AND eligible_responses >= 50 THEN 'high' WHEN responses >= 8 AND eligible_responses >= 20 THEN 'medium' ELSE 'low' END AS confidence FROM r""",
)
def _research(p: Projection) -> DataFrame:
    from brandlens.operators import gaps

    return gaps.research_facts(_window(p), p.eligible_between(p.ago(LONG), p.now()), p.domains)


@query("alerts_new_competitors", ORACLE_SQL["discovery_scores"].replace("SELECT *, CASE WHEN confidence >= 0.7", "SELECT project_id, 'new_competitor' AS alert_type, name AS subject, CASE WHEN confidence >= 0.7 THEN 'medium' ELSE 'low' END AS severity, substr(sha256(name), 1, 12) AS fingerprint FROM cs WHERE confidence >= 0.4 --"))
def _new_competitors(p: Projection) -> DataFrame:
    return signals.new_competitor_alerts(_discovery(p))


@query("alerts_content_gaps", f"SELECT project_id, 'new_content_gap' AS alert_type, prompt_id || ':' || gap_type AS subject, CASE WHEN score >= 80 THEN 'high' ELSE 'medium' END AS severity, score FROM ({ORACLE_SQL['content_gap_scores']}) WHERE score >= 60")
def _content_gap_alerts(p: Projection) -> DataFrame:
    return signals.content_gap_alerts(_gap_scores(p))
