"""Queries over visibility, competitors, the citation graph, gaps and recommendations, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.operators import competitive, gaps, graph, visibility
from brandlens.sources.projection import COMPETITORS, CTES, NOW, Gathered, Projection

DAYS, LONG = 90, 730
QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
WITH = f"WITH {CTES.strip()}"
_NOW = f"TIMESTAMP '{NOW}'"


def query(name: str, sql: str | None = None):
    def register(f: Callable[[Projection], DataFrame]):
        QUERIES[name] = lambda spark, sf_dir: f(Projection(spark, sf_dir))
        if sql:
            ORACLE_SQL[name] = sql
        return f

    return register


# ---- SQL pieces -------------------------------------------------------------------------------------------------


def _round_for(n: str, v: str) -> str:
    return f"CASE WHEN {n} < 5 THEN NULL WHEN {n} < 20 THEN round_even(({v}) / 5, 0) * 5 WHEN {n} < 50 THEN round_even({v}, 0) ELSE round_even({v}, 1) END"


def _mean(parts: dict[str, float]) -> str:
    top = " + ".join(f"coalesce({w} * {c}, 0)" for c, w in parts.items())
    bottom = " + ".join(f"CASE WHEN {c} IS NULL THEN 0 ELSE {w} END" for c, w in parts.items())
    return f"(({top}) / nullif(CAST({bottom} AS DOUBLE), 0))"


_SUFFICIENCY = "CASE WHEN {n} >= 50 THEN 'high' WHEN {n} >= 20 THEN 'moderate' WHEN {n} >= 5 THEN 'low' ELSE 'insufficient' END"
_POINTS = "CASE WHEN {p} IS NULL THEN NULL WHEN {p} = 1 THEN 100.0 WHEN {p} = 2 THEN 85.0 WHEN {p} = 3 THEN 70.0 WHEN {p} = 4 THEN 55.0 WHEN {p} = 5 THEN 40.0 ELSE 25.0 END"
_SENTIMENT = "CASE {s} WHEN 'positive' THEN 100.0 WHEN 'mixed' THEN 50.0 WHEN 'neutral' THEN 50.0 WHEN 'negative' THEN 0.0 END"
_VISIBILITY_WEIGHTS = {"mention_rate": 25.0, "recommendation_rate": 25.0, "position_score": 15.0, "citation_rate": 15.0, "sentiment_score": 10.0, "competitive_score": 10.0}


def _metric_ctes(keys: str, source: str = "windowed") -> str:
    """CTE ``metrics`` with the visibility metrics of each group; ``source`` is a filtered form of the view table."""
    return f""",
grouped AS (
  SELECT {keys}, count(DISTINCT run_id) AS n, count(DISTINCT prompt_id) AS prompts, min(completed_at) AS first_at, max(completed_at) AS last_at,
    count(*) FILTER (WHERE entity = 'brand' AND mentioned) AS m, count(*) FILTER (WHERE entity = 'brand' AND recommended) AS r, count(*) FILTER (WHERE entity = 'brand' AND citations > 0) AS c,
    avg(CASE WHEN entity = 'brand' THEN position END) AS raw_position, count(CASE WHEN entity = 'brand' THEN position END) AS n_positioned,
    avg(CASE WHEN entity = 'brand' THEN {_POINTS.format(p='position')} END) AS position_score,
    avg(CASE WHEN entity = 'brand' AND mentioned THEN {_SENTIMENT.format(s='sentiment')} END) AS sentiment_score,
    {", ".join(f"count(*) FILTER (WHERE entity = 'brand' AND mentioned AND sentiment = '{s}') AS n_{s}" for s in ("positive", "neutral", "negative", "mixed", "unknown"))},
    greatest({", ".join(f"count(*) FILTER (WHERE entity = 'comp{i}' AND mentioned)" for i in range(5))}) AS top_rival
  FROM {source} GROUP BY {keys}),
rated AS (
  SELECT *, 100.0 * m / n AS mention_rate, 100.0 * r / n AS recommendation_rate, 100.0 * c / n AS citation_rate,
    CASE WHEN m = 0 AND top_rival = 0 THEN NULL WHEN m >= top_rival THEN 100.0 ELSE 100.0 * m / top_rival END AS competitive_score FROM grouped),
metrics AS (
  SELECT {keys}, n AS sample_size, {_round_for("n", _mean(_VISIBILITY_WEIGHTS))} AS score,
    {", ".join(f"{_round_for('n', k)} AS {k}" for k in _VISIBILITY_WEIGHTS)},
    round_even(raw_position, 2) AS average_position, n_positioned, n_positive, n_neutral, n_negative, n_mixed, n_unknown, prompts, {_SUFFICIENCY.format(n="n")} AS sufficiency, first_at, last_at
  FROM rated)"""


def _windowed(days: int) -> str:
    return f", windowed AS (SELECT * FROM views WHERE completed_at >= {_NOW} - INTERVAL {days} DAY AND completed_at < {_NOW})"


def _observed(p: Projection, days: int) -> DataFrame:
    t = F.col("completed_at")
    return p.observations.where((t >= p.ago(days)) & (t < p.now()))


# ---- visibility -------------------------------------------------------------------------------------------------

for _name, _keys in {
    "visibility_metrics": ["project_id"],
    "visibility_by_provider": ["project_id", "provider"],
    "visibility_by_model": ["project_id", "provider", "model"],
    "visibility_by_prompt": ["project_id", "prompt_id"],
    "visibility_by_category": ["project_id", "category"],
    "visibility_by_stage": ["project_id", "funnel_stage"],
}.items():
    query(_name, f"{WITH}{_windowed(LONG)}{_metric_ctes(', '.join(_keys))} SELECT * FROM metrics")(lambda p, keys=_keys: visibility.metric_block(_observed(p, LONG), keys))

_BOTH = f", windowed AS (SELECT *, CASE WHEN completed_at >= {_NOW} - INTERVAL 90 DAY THEN 'current' ELSE 'previous' END AS period FROM views WHERE completed_at >= {_NOW} - INTERVAL 180 DAY AND completed_at < {_NOW})"
_DIRECTION = "CASE WHEN change IS NULL THEN 'unavailable' WHEN abs(change) < 2 THEN 'flat' WHEN change > 0 THEN 'up' ELSE 'down' END AS direction"


@query(
    "visibility_overview",
    f"""{WITH}{_BOTH}{_metric_ctes("project_id, period")},
pair AS (SELECT c.* EXCLUDE (period), p.score AS previous_score, p.sample_size AS previous_sample_size, round_even(c.score - p.score, 1) AS change
  FROM metrics c LEFT JOIN metrics p ON p.project_id = c.project_id AND p.period = 'previous' WHERE c.period = 'current')
SELECT *, {_DIRECTION} FROM pair""",
)
def _overview(p: Projection) -> DataFrame:
    return visibility.overview(p.observations, p.now(), DAYS)


def _trend_sql(keys: str) -> str:
    return f"""{WITH}, windowed AS (SELECT *, CAST(floor(date_diff('second', {_NOW} - INTERVAL 90 DAY, completed_at) / 604800.0) AS INTEGER) AS bucket
  FROM views WHERE completed_at >= {_NOW} - INTERVAL 90 DAY AND completed_at < {_NOW}){_metric_ctes(keys + ", bucket")},
spine AS (SELECT DISTINCT {keys}, unnest(range(0, 13)) AS bucket FROM eligible)
SELECT {keys}, CAST(bucket AS INTEGER) AS bucket, coalesce(sample_size, 0) AS sample_size, score, mention_rate, citation_rate, coalesce(sufficiency, 'insufficient') AS sufficiency FROM spine LEFT JOIN metrics USING ({keys}, bucket)"""


@query("visibility_trend_weekly", _trend_sql("project_id"))
def _trend(p: Projection) -> DataFrame:
    return visibility.weekly_trend(p.observations, p.now())


@query("visibility_trend_by_provider", _trend_sql("project_id, provider"))
def _trend_provider(p: Projection) -> DataFrame:
    return visibility.weekly_trend(p.observations, p.now(), keys=("project_id", "provider"))


@query(
    "competitor_share_of_voice",
    f"""{WITH}{_windowed(LONG)}, g AS (SELECT project_id, entity, count(DISTINCT run_id) AS n, count(*) FILTER (WHERE mentioned) AS mentions FROM windowed GROUP BY 1, 2),
t AS (SELECT *, sum(mentions) OVER (PARTITION BY project_id) AS total FROM g)
SELECT project_id, entity, mentions, {_round_for("n", "100.0 * mentions / n")} AS mention_rate, {_round_for("n", "100.0 * mentions / nullif(total, 0)")} AS share_of_voice FROM t""",
)
def _sov(p: Projection) -> DataFrame:
    return visibility.competitor_table(_observed(p, LONG))


# ---- competitive ------------------------------------------------------------------------------------------------

_ENTITY_WEIGHTS = {"mention_share": 30.0, "recommendation_share": 25.0, "position_score": 15.0, "citation_share": 15.0, "sentiment_score": 15.0}


def _entity_ctes(keys: str) -> str:
    return f""",
eg AS (
  SELECT {keys}, entity, count(*) AS sample_size, count(*) FILTER (WHERE mentioned) AS mentions, count(*) FILTER (WHERE recommended) AS recommendations, count(*) FILTER (WHERE citations > 0) AS cited_responses,
    CAST(sum(citations) AS BIGINT) AS citations, count(position) AS positioned_mentions, avg(position) AS raw_position, avg({_POINTS.format(p="position")}) AS position_score,
    avg(CASE WHEN mentioned THEN {_SENTIMENT.format(s="sentiment")} END) AS sentiment_score, count(DISTINCT CASE WHEN mentioned THEN prompt_id END) AS prompts_appearing
  FROM windowed GROUP BY {keys}, entity),
er AS (SELECT *, 100.0 * mentions / sample_size AS mention_share, 100.0 * recommendations / sample_size AS recommendation_share, 100.0 * cited_responses / sample_size AS citation_share FROM eg),
em AS (
  SELECT {keys}, entity, sample_size, mentions, recommendations, positioned_mentions, cited_responses, citations, prompts_appearing, {_round_for("sample_size", _mean(_ENTITY_WEIGHTS))} AS score,
    {", ".join(f"{_round_for('sample_size', k)} AS {k}" for k in _ENTITY_WEIGHTS)}, round_even(raw_position, 2) AS average_position, {_SUFFICIENCY.format(n="sample_size")} AS sufficiency
  FROM er)"""


def _advantage_sql(keys: str) -> str:
    using = f"USING ({keys})"
    diffs = ", ".join(f"round_even(c.{k} - b.{k}, 1) AS d{i}" for i, k in enumerate(_ENTITY_WEIGHTS))
    wins = " UNION ALL ".join(f"SELECT d{i} AS d, {i} AS i, '{k}' AS name" for i, k in enumerate(_ENTITY_WEIGHTS))
    return f""",
ad AS (SELECT c.*, b.score AS brand_score, round_even(c.score - b.score, 1) AS advantage, {diffs} FROM em c JOIN em b {using} WHERE b.entity = 'brand' AND c.entity <> 'brand'),
adv AS (SELECT {keys}, entity AS competitor, score AS competitor_score, brand_score, advantage, coalesce(sample_size >= 20 AND advantage >= 10, false) AS material,
    CASE WHEN advantage IS NULL THEN 'insufficient data' WHEN sample_size < 20 THEN 'sample too small to call the gap material' WHEN advantage < 10 THEN 'gap below the material threshold' END AS reason,
    coalesce((SELECT string_agg(name, ',' ORDER BY d DESC, i) FROM ({wins}) w WHERE d >= 5), '') AS where_they_win FROM ad)"""


def _seen(p: Projection, days: int) -> DataFrame:
    t = F.col("completed_at")
    return p.entity_views.where((t >= p.ago(days)) & (t < p.now()))


@query("competitive_entities", f"{WITH}{_windowed(LONG)}{_entity_ctes('project_id')} SELECT * FROM em")
def _entities(p: Projection) -> DataFrame:
    return competitive.entity_metrics(_seen(p, LONG), ["project_id"])


# ---- each project's own competitors --------------------------------------------------------------------------------

_OWN_VIEWS = f""", own_views AS (SELECT e.*, n.entity, s.position, s.strength_no, s.sentiment, s.run_id IS NOT NULL AS mentioned, coalesce(s.citations, 0) AS citations,
    s.run_id IS NOT NULL AND s.strength_no >= 3 AND s.sentiment <> 'negative' AS recommended
  FROM eligible e JOIN (SELECT DISTINCT project_id, 'brand' AS entity FROM prompts UNION ALL SELECT * FROM configured) n USING (project_id) LEFT JOIN said s ON s.run_id = e.run_id AND s.entity = n.entity),
windowed AS (SELECT * FROM own_views WHERE completed_at >= {_NOW} - INTERVAL {LONG} DAY AND completed_at < {_NOW})"""


def _own_metrics(keys: str) -> str:
    return _metric_ctes(keys).replace("CASE WHEN m = 0 AND top_rival = 0", "CASE WHEN project_id NOT IN (SELECT project_id FROM configured) OR (m = 0 AND top_rival = 0)")


@query("visibility_own_rivals", f"{WITH}{_OWN_VIEWS}{_own_metrics('project_id')} SELECT * FROM metrics")
def _own_rivals(p: Projection) -> DataFrame:
    return visibility.metric_block(_observed(p, LONG), ["project_id"], configured=p.configured)


@query("visibility_own_rivals_by_provider", f"{WITH}{_OWN_VIEWS}{_own_metrics('project_id, provider')} SELECT * FROM metrics")
def _own_rivals_provider(p: Projection) -> DataFrame:
    return visibility.metric_block(_observed(p, LONG), ["project_id", "provider"], configured=p.configured)


@query(
    "share_of_voice_own_rivals",
    f"""{WITH}{_OWN_VIEWS}, g AS (SELECT project_id, entity, count(DISTINCT run_id) AS n, count(*) FILTER (WHERE mentioned) AS mentions FROM windowed GROUP BY 1, 2),
t AS (SELECT *, sum(mentions) OVER (PARTITION BY project_id) AS total FROM g)
SELECT project_id, entity, mentions, {_round_for("n", "100.0 * mentions / n")} AS mention_rate, {_round_for("n", "100.0 * mentions / nullif(total, 0)")} AS share_of_voice FROM t""",
)
def _own_voice(p: Projection) -> DataFrame:
    return visibility.configured_table(_observed(p, LONG), p.configured)


def _own_entities(p: Projection, keys: list[str]) -> DataFrame:
    return competitive.configured_entity_metrics(p.eligible_between(p.ago(LONG), p.now()), p.entity_mentions, p.configured, keys)


@query("competitive_own_rivals", f"{WITH}{_OWN_VIEWS}{_entity_ctes('project_id')} SELECT * FROM em")
def _own_competitive(p: Projection) -> DataFrame:
    return _own_entities(p, ["project_id"])


@query("advantages_own_rivals", f"{WITH}{_OWN_VIEWS}{_entity_ctes('project_id, provider')}{_advantage_sql('project_id, provider')} SELECT * FROM adv")
def _own_advantages(p: Projection) -> DataFrame:
    return competitive.advantages(_own_entities(p, ["project_id", "provider"]), ["project_id", "provider"])


@query("competitive_by_provider", f"{WITH}{_windowed(LONG)}{_entity_ctes('project_id, provider')} SELECT * FROM em")
def _entities_provider(p: Projection) -> DataFrame:
    return competitive.entity_metrics(_seen(p, LONG), ["project_id", "provider"])


@query("competitive_advantages", f"{WITH}{_windowed(LONG)}{_entity_ctes('project_id')}{_advantage_sql('project_id')} SELECT * FROM adv")
def _advantages(p: Projection) -> DataFrame:
    return competitive.advantages(competitive.entity_metrics(_seen(p, LONG), ["project_id"]), ["project_id"])


@query(
    "competitive_ranking",
    f"{WITH}{_windowed(LONG)}{_entity_ctes('project_id')} SELECT project_id, entity, score, CAST(row_number() OVER (PARTITION BY project_id ORDER BY score DESC, entity) AS INTEGER) AS rank FROM em WHERE sample_size >= 20 AND score IS NOT NULL",
)
def _ranking(p: Projection) -> DataFrame:
    return competitive.ranking(competitive.entity_metrics(_seen(p, LONG), ["project_id"]), ["project_id"])


@query(
    "competitive_prompt_leaders",
    f"""{WITH}{_windowed(LONG)}, g AS (SELECT project_id, prompt_id, entity, count(*) FILTER (WHERE mentioned) AS mentions, count(*) FILTER (WHERE recommended) AS recommendations, coalesce(min(position), 99) AS best FROM windowed GROUP BY 1, 2, 3),
r AS (SELECT *, rank() OVER (PARTITION BY project_id, prompt_id ORDER BY mentions DESC, recommendations DESC, best) AS r FROM g WHERE mentions > 0)
SELECT project_id, prompt_id, min(entity) AS leader, count(*) > 1 AS tied, max(mentions) AS mentions, bool_or(entity = 'brand') AS brand_leads FROM r WHERE r = 1 GROUP BY 1, 2""",
)
def _leaders(p: Projection) -> DataFrame:
    return competitive.prompt_leaders(_seen(p, LONG))


@query(
    "competitive_engine_spread",
    f"""{WITH}{_windowed(LONG)}{_entity_ctes('project_id, provider')}{_advantage_sql('project_id, provider')}
SELECT project_id, provider, competitor, advantage, material FROM (SELECT *, row_number() OVER (PARTITION BY project_id, provider ORDER BY advantage DESC, competitor) AS r FROM adv WHERE advantage IS NOT NULL) WHERE r = 1""",
)
def _spread(p: Projection) -> DataFrame:
    return competitive.engine_spread(_seen(p, LONG))


@query(
    "competitive_changes",
    f"""{WITH}{_BOTH}{_entity_ctes('project_id, period')}, w AS (SELECT project_id, entity, max(CASE WHEN period = 'current' THEN score END) AS score, max(CASE WHEN period = 'previous' THEN score END) AS previous_score FROM em GROUP BY 1, 2),
d AS (SELECT *, round_even(score - previous_score, 1) AS change FROM w) SELECT *, {_DIRECTION} FROM d""",
)
def _changes(p: Projection) -> DataFrame:
    return competitive.changes(p.entity_views, p.now(), DAYS)


# ---- graph ------------------------------------------------------------------------------------------------------

_CITED = f", wc AS (SELECT * FROM cited WHERE cited_at >= {_NOW} - INTERVAL {LONG} DAY AND cited_at < {_NOW})"
_COUNTS = """, counts AS (SELECT project_id, domain_id, count(*) AS citations, count(DISTINCT run_id) AS responses, count(DISTINCT prompt_id) AS prompts, count(*) FILTER (WHERE is_brand) AS brand_citations,
  count(*) FILTER (WHERE is_competitor) AS competitor_citations, min(cited_at) AS first_cited_at, max(cited_at) AS last_cited_at FROM wc GROUP BY 1, 2)"""


def _window(p: Projection, days: int = LONG) -> DataFrame:
    return p.cited(p.ago(days), p.now())


def _sources_sql(where: str, order: str) -> str:
    return f"""{WITH}{_CITED}{_COUNTS}, o AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY {order}) AS INTEGER) AS rank FROM counts JOIN domains USING (domain_id) WHERE {where})
SELECT project_id, rank, domain, domain_type, citations, responses, prompts, brand_citations, competitor_citations, round_even(competitor_citations / CAST(citations AS DOUBLE), 3) AS competitor_share,
  round_even(brand_citations / CAST(nullif(competitor_citations, 0) AS DOUBLE), 3) AS brand_ratio, first_cited_at, last_cited_at FROM o WHERE rank <= 50"""


for _view, _where, _order in (
    ("top", "true", "citations DESC, responses DESC, domain"),
    ("competitor", "competitor_citations > 0", "competitor_citations DESC, citations DESC, domain"),
    ("gap", "competitor_citations >= 3 AND competitor_citations >= 3 * brand_citations", "competitor_citations - brand_citations DESC, citations DESC, domain"),
):
    query(f"graph_sources_{_view}", _sources_sql(_where, _order))(lambda p, view=_view: graph.sources(_window(p), p.domains, view))


@query(
    "graph_sources_rising",
    f"""{WITH}, g AS (SELECT project_id, domain, count(*) FILTER (WHERE cited_at >= {_NOW} - INTERVAL 90 DAY) AS citations, count(*) FILTER (WHERE cited_at < {_NOW} - INTERVAL 90 DAY) AS previous
  FROM cited JOIN domains USING (domain_id) WHERE cited_at >= {_NOW} - INTERVAL 180 DAY AND cited_at < {_NOW} GROUP BY 1, 2),
c AS (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY citations DESC, domain) AS c FROM g WHERE citations > 0),
k AS (SELECT *, round_even((citations - previous) / CAST(greatest(previous, 1) AS DOUBLE), 3) AS growth FROM c WHERE c <= 400 AND citations >= 3 AND citations > previous)
SELECT * FROM (SELECT project_id, CAST(row_number() OVER (PARTITION BY project_id ORDER BY growth DESC, citations DESC, domain) AS INTEGER) AS rank, domain, citations, previous, growth FROM k) WHERE rank <= 50""",
)
def _rising(p: Projection) -> DataFrame:
    return graph.rising(_window(p, 180), p.ago(90), p.domains)


@query(
    "graph_top_pages",
    f"""{WITH}{_CITED}, g AS (SELECT project_id, domain_id, page_id, count(*) AS citations FROM wc GROUP BY 1, 2, 3)
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, domain_id ORDER BY citations DESC, page_id) AS INTEGER) AS rank FROM g) WHERE rank <= 3""",
)
def _top_pages(p: Projection) -> DataFrame:
    return graph.top_pages(_window(p))


@query("graph_competitor_counts", f"{WITH}{_CITED} SELECT project_id, domain_id, competitor, count(*) AS citations FROM wc WHERE is_competitor GROUP BY 1, 2, 3")
def _competitor_counts(p: Projection) -> DataFrame:
    return graph.entity_map(_window(p)).select("project_id", "domain_id", F.explode("competitors").alias("competitor", "citations"))


@query(
    "graph_prompts",
    f"""{WITH}{_windowed(LONG)}{_CITED}, a AS (SELECT project_id, prompt_id, count(DISTINCT run_id) AS responses, count(*) FILTER (WHERE entity = 'brand' AND mentioned) AS brand_mentions, count(*) FILTER (WHERE entity <> 'brand' AND mentioned) AS competitor_mentions FROM windowed GROUP BY 1, 2),
b AS (SELECT project_id, prompt_id, count(*) FILTER (WHERE is_competitor) AS competitor_citations, count(*) FILTER (WHERE is_brand) AS brand_citations FROM wc GROUP BY 1, 2),
o AS (SELECT project_id, prompt_id, responses, brand_mentions, competitor_mentions, coalesce(competitor_citations, 0) AS competitor_citations, coalesce(brand_citations, 0) AS brand_citations FROM a LEFT JOIN b USING (project_id, prompt_id))
SELECT * FROM (SELECT *, CAST(row_number() OVER (PARTITION BY project_id ORDER BY competitor_citations DESC, competitor_mentions DESC, responses DESC, prompt_id) AS INTEGER) AS rank FROM o) WHERE rank <= 50""",
)
def _graph_prompts(p: Projection) -> DataFrame:
    return graph.prompts_by_competitors(_window(p), _observed(p, LONG))


#: Claims that answers make, over the projection: each citation states something of the brand, a competitor or a third one.
STATED = """, stated AS (SELECT project_id, prompt_id, run_id, CASE WHEN is_brand THEN ' Brand Suite' WHEN is_competitor THEN 'The ' || upper(competitor) || ' app' ELSE 'Wave' END AS subject, CASE page_id % 3 WHEN 0 THEN 'offers' WHEN 1 THEN 'Has' ELSE 'costs' END AS predicate,
  CASE page_id % 4 WHEN 0 THEN 'payroll add-on' WHEN 1 THEN (page_id % 90) || ' users' ELSE strength || ' support' END AS object, CAST((position % 8) AS DOUBLE) / 8 AS confidence, 'as of answer ' || CASE WHEN page_id % 5 = 0 THEN CAST(page_id AS VARCHAR) ELSE 'x' END AS context, cited_at AS claimed_at FROM cited)"""


def stated_claims(p: Projection) -> DataFrame:
    page = F.col("page_id")
    subject = F.when(F.col("is_brand"), " Brand Suite").when(F.col("is_competitor"), F.concat(F.lit("The "), F.upper("competitor"), F.lit(" app"))).otherwise("Wave")
    said = F.when(page % 4 == 0, "payroll add-on").when(page % 4 == 1, F.concat((page % 90).cast("string"), F.lit(" users"))).otherwise(F.concat("strength", F.lit(" support")))
    predicate = F.when(page % 3 == 0, "offers").when(page % 3 == 1, "Has").otherwise("costs")
    context = F.concat(F.lit("as of answer "), F.when(page % 5 == 0, page.cast("string")).otherwise("x"))
    return p.cited().select("project_id", "prompt_id", "run_id", subject.alias("subject"), predicate.alias("predicate"), said.alias("object"), ((F.col("position") % 8).cast("double") / 8).alias("confidence"), context.alias("context"), F.col("cited_at").alias("claimed_at"))


@query(
    "graph_claims",
    f"""{WITH}{STATED}, t AS (SELECT project_id, prompt_id, run_id, lower(trim(subject)) AS subject, lower(predicate) AS predicate, lower(object) AS object, confidence, context, claimed_at FROM stated WHERE claimed_at >= {_NOW} - INTERVAL {LONG} DAY AND claimed_at < {_NOW})
SELECT project_id, subject, predicate, object, count(*) AS occurrences, count(DISTINCT run_id) AS responses, count(DISTINCT prompt_id) AS prompts, round_even(avg(confidence), 3) AS confidence, min(context) AS example, max(claimed_at) AS last_at,
  CASE WHEN contains(subject, 'brand') THEN 'brand' WHEN subject LIKE '%comp_%' THEN 'competitor' ELSE 'other' END AS association FROM t GROUP BY 1, 2, 3, 4 HAVING count(*) >= 2""",
)
def _claims(p: Projection) -> DataFrame:
    stated = stated_claims(p).where((F.col("claimed_at") >= p.ago(LONG)) & (F.col("claimed_at") < p.now()))
    return graph.claims(stated, "brand", COMPETITORS)


_RIVALS = """, rv AS (SELECT a.project_id, a.entity AS competitor, count(*) AS mentions, count(*) FILTER (WHERE b.mentioned) AS with_brand, count(DISTINCT a.prompt_id) AS prompts
  FROM windowed a JOIN windowed b ON a.run_id = b.run_id AND b.entity = 'brand' WHERE a.entity <> 'brand' AND a.mentioned GROUP BY 1, 2)"""


@query("graph_competitors_comention", f"{WITH}{_windowed(LONG)}{_RIVALS} SELECT * FROM rv")
def _co(p: Projection) -> DataFrame:
    return graph.co_mentions(_observed(p, LONG))


@query("graph_statistics", f"{WITH} SELECT project_id, count(*) AS responses, count(DISTINCT prompt_id) AS prompts, count(DISTINCT provider || chr(9) || model) AS models FROM eligible WHERE completed_at >= {_NOW} - INTERVAL {LONG} DAY AND completed_at < {_NOW} GROUP BY 1")
def _statistics(p: Projection) -> DataFrame:
    return graph.statistics(p.eligible_between(p.ago(LONG), p.now()))


@query(
    "graph_edges",
    f"""{WITH}{_windowed(LONG)}{_CITED}{_RIVALS}{_COUNTS}, top AS (SELECT project_id, domain_id FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY citations DESC, domain_id) AS r FROM counts) WHERE r <= 10)
SELECT project_id, 'cites' AS kind, 'prompt:' || prompt_id AS src, 'source:' || domain_id AS dst, count(*) AS weight FROM wc JOIN top USING (project_id, domain_id) GROUP BY 1, 2, 3, 4
UNION ALL SELECT project_id, 'competes_with', 'brand', competitor, with_brand FROM rv WHERE with_brand > 0""",
)
def _edges(p: Projection) -> DataFrame:
    return graph.edges(_window(p), _observed(p, LONG))


# ---- gaps, relevance, recommendations ---------------------------------------------------------------------------

_TYPE_POINTS = "CASE domain_type " + " ".join(f"WHEN '{k}' THEN {v}" for k, v in gaps.TYPE_POINTS.items()) + " ELSE 50.0 END"
_RELEVANCE = f""",
rw AS (SELECT domain_id, count(*) AS total, count(DISTINCT project_id) AS projects, count(DISTINCT date_trunc('week', cited_at)) AS weeks, min(cited_at) AS first_seen FROM cited GROUP BY 1),
ro AS (SELECT project_id, domain_id, count(*) AS own FROM cited GROUP BY 1, 2),
rs AS (SELECT *, CAST(greatest(1, floor(date_diff('second', first_seen, {_NOW}) / 604800.0) + 1) AS DOUBLE) AS since FROM ro JOIN rw USING (domain_id) JOIN domains USING (domain_id)),
rp AS (SELECT project_id, domain_id, domain, domain_type, least(100.0, 100.0 * log10(total + 1.0) / log10(1001.0)) AS frequency, least(100.0, 100.0 * projects / 20) AS breadth, 100.0 * least(weeks, since) / since AS consistency,
  CAST(least(100.0, {_TYPE_POINTS} + CASE WHEN is_authority THEN 5.0 ELSE 0.0 END) AS DOUBLE) AS source_type, least(100.0, 100.0 * log10(own + 1.0) / log10(101.0)) AS project_frequency FROM rs),
relevance AS (SELECT project_id, domain_id, domain, domain_type, round_even((30.0 * frequency + 20.0 * breadth + 15.0 * consistency + 20.0 * source_type + 15.0 * project_frequency) / 100.0, 1) AS source_relevance,
  round_even(frequency, 1) AS frequency, round_even(breadth, 1) AS breadth, round_even(consistency, 1) AS consistency, round_even(source_type, 1) AS source_type, round_even(project_frequency, 1) AS project_frequency FROM rp)"""


@query("source_relevance", f"{WITH}{_RELEVANCE} SELECT * FROM relevance")
def _relevance(p: Projection) -> DataFrame:
    return gaps.source_relevance(p.cited(), p.domains, p.now())


_COMMERCIAL = "(category IN ('comparison', 'recommendation', 'pricing', 'alternative') OR funnel_stage IN ('consideration', 'decision', 'purchase'))"
_GAPS = f"""{_CITED}{_COUNTS}{_RELEVANCE},
halves AS (SELECT project_id, domain_id, count(*) FILTER (WHERE cited_at < {_NOW} - INTERVAL {LONG // 2} DAY) AS first_half, count(*) FILTER (WHERE cited_at >= {_NOW} - INTERVAL {LONG // 2} DAY) AS second_half,
  count(DISTINCT CASE WHEN {_COMMERCIAL} THEN prompt_id END) AS commercial_prompts FROM wc GROUP BY 1, 2),
totals AS (SELECT project_id, count(*) AS eligible_responses, count(DISTINCT prompt_id) AS total_prompts FROM eligible WHERE completed_at >= {_NOW} - INTERVAL {LONG} DAY AND completed_at < {_NOW} GROUP BY 1),
st AS (SELECT c.*, h.first_half, h.second_half, h.commercial_prompts, t.eligible_responses, t.total_prompts, r.domain, r.domain_type, r.source_relevance, brand_citations AS b, competitor_citations AS k,
    date_diff('second', last_cited_at, {_NOW}) / 86400.0 AS age
  FROM counts c JOIN halves h USING (project_id, domain_id) JOIN totals t USING (project_id) JOIN relevance r USING (project_id, domain_id)),
ty AS (SELECT *,
    CASE WHEN b = 0 AND floor(date_diff('second', first_cited_at, {_NOW}) / 86400.0) <= {LONG * 0.3} AND second_half >= greatest(3, 2 * first_half) THEN 'emerging_source'
      WHEN b = 0 AND (k >= 1 OR responses >= 3) THEN 'brand_absent' WHEN b > 0 AND k >= 3 AND k >= 2 * b THEN 'competitor_advantage' WHEN b > 0 AND k > 0 THEN 'shared_source'
      WHEN b >= 3 AND k = 0 AND b >= 0.8 * citations THEN 'source_overrepresented' ELSE 'source_underrepresented' END AS gap_type,
    CASE WHEN responses <= 1 OR eligible_responses < 5 THEN 'insufficient' WHEN responses >= 20 AND eligible_responses >= 50 THEN CASE WHEN domain_type = 'unknown' THEN 'medium' ELSE 'high' END
      WHEN responses >= 8 AND eligible_responses >= 20 THEN 'medium' WHEN responses >= 3 THEN 'low' ELSE 'insufficient' END AS confidence,
    25.0 * least(100.0, 100.0 * responses / eligible_responses / 0.3)
    + 30.0 * CASE WHEN b = 0 AND k > 0 THEN 100.0 WHEN b = 0 AND k = 0 THEN 40.0 ELSE greatest(0.0, 50.0 + 50.0 * (k - b) / (k + b)) END
    + 20.0 * source_relevance + 15.0 * least(100.0, 100.0 * prompts / total_prompts)
    + 10.0 * CASE WHEN age <= 7 THEN 100.0 WHEN age <= 30 THEN 100.0 - (age - 7) * (40.0 / 23.0) WHEN age <= 90 THEN 60.0 - (age - 30) * (40.0 / 60.0) ELSE greatest(0.0, 20.0 - (age - 90) * (20.0 / 90.0)) END AS raw
  FROM st),
sc AS (SELECT *, round_even(raw / 100.0 * CASE gap_type WHEN 'source_overrepresented' THEN 0.3 WHEN 'shared_source' THEN 0.7 ELSE 1.0 END, 1) AS score FROM ty),
gap AS (SELECT *, CASE WHEN score >= 70 THEN 'high' WHEN score >= 40 THEN 'medium' ELSE 'low' END AS priority FROM sc)"""


def _gap_rows(p: Projection) -> DataFrame:
    gathered = isinstance(p, Gathered)
    cited = p.cited(p.ago(LONG), p.now(), first=lambda c: c["domain_id"]) if gathered else _window(p)
    stats = gaps.gap_stats(cited, p.eligible_between(p.ago(LONG), p.now()), p.ago(LONG), LONG, "first" if gathered else None)
    return gaps.citation_gaps(stats, gaps.source_relevance(p.cited(), p.domains, p.now()), p.now(), LONG)


@query("citation_gaps", f"{WITH}{_GAPS} SELECT project_id, domain, gap_type, confidence, score, priority, citations, responses, prompts, brand_citations, competitor_citations, source_relevance FROM gap")
def _citation_gaps(p: Projection) -> DataFrame:
    return _gap_rows(p).select("project_id", "domain", "gap_type", "confidence", "score", "priority", "citations", "responses", "prompts", "brand_citations", "competitor_citations", "source_relevance")


@query("citation_gap_summary", f"{WITH}{_GAPS} " + " UNION ALL ".join(f"SELECT project_id, '{c}' AS dimension, {c} AS value, count(*) AS gaps FROM gap GROUP BY 1, 2, 3" for c in ("gap_type", "confidence", "priority", "domain_type")))
def _gap_summary(p: Projection) -> DataFrame:
    return gaps.gap_summary(_gap_rows(p))


@query(
    "recommendations_priority",
    f"""{WITH}{_GAPS}, f AS (SELECT *, commercial_prompts / CAST(prompts AS DOUBLE) AS business, coalesce((k - b) / CAST(nullif(k + b, 0) AS DOUBLE), 0) AS lead FROM gap
  WHERE confidence <> 'insufficient' AND gap_type IN ('brand_absent', 'competitor_advantage', 'emerging_source', 'source_underrepresented') AND NOT (domain_type = 'company' AND b = 0 AND k > 0)
    AND (gap_type <> 'source_underrepresented' OR source_relevance >= 50)),
s AS (SELECT *, round_even(score * CASE confidence WHEN 'high' THEN 1.0 WHEN 'medium' THEN 0.85 WHEN 'low' THEN 0.6 ELSE 0 END * (0.7 + 0.3 * business), 1) AS priority_score FROM f)
SELECT project_id, domain, gap_type, confidence, score, round_even(business, 3) AS business_relevance, priority_score,
  CASE WHEN priority_score >= 80 AND confidence = 'high' AND lead >= 0.6 AND responses >= 20 THEN 'critical' WHEN priority_score >= 65 THEN 'high' WHEN priority_score >= 40 THEN 'medium' ELSE 'low' END AS priority,
  'Investigate ' || domain || ' visibility opportunity' AS title FROM s""",
)
def _recommendations(p: Projection) -> DataFrame:
    return gaps.recommendations(_gap_rows(p))


@query("commercial_prompts_by_domain", f"{WITH}{_CITED} SELECT project_id, domain_id, count(DISTINCT prompt_id) AS prompts, count(DISTINCT CASE WHEN {_COMMERCIAL} THEN prompt_id END) AS commercial_prompts FROM wc GROUP BY 1, 2")
def _commercial(p: Projection) -> DataFrame:
    return gaps.commercial_prompts(_window(p))
