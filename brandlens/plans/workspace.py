"""Queries over prompts, access, quotas, queues, audits and listings, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators import accounts, citations, competitive, graph, operations, prompts
from brandlens.plans.analytics import _CITED, _NOW, LONG, WITH, _seen, _window, _windowed, query
from brandlens.plans.texts import _PROMPT, _prompt_text
from brandlens.sources.projection import COMPETITORS, Projection

# ---- graph and competitors ------------------------------------------------------------------------------------------

for _name, _key, _only in (("graph_entity_sources", "competitor", "WHERE is_competitor"), ("graph_prompt_sources", "prompt_id", "")):

    @query(
        _name,
        f"""{WITH}{_CITED}, g AS (SELECT project_id, {_key}, domain_id, count(*) AS citations FROM wc {_only} GROUP BY 1, 2, 3),
r AS (SELECT *, CAST(row_number() OVER (PARTITION BY project_id, {_key} ORDER BY citations DESC, domain_id) AS INTEGER) AS rank FROM g) SELECT * FROM r WHERE rank <= 5""",
    )
    def _top_sources(p: Projection, key: str = _key, only: str = _only) -> DataFrame:
        cited = _window(p)
        return graph.top_sources(cited.where("is_competitor") if only else cited, key)


@query(
    "graph_unmentioned_competitors",
    f"""{WITH}{_CITED}, m AS (SELECT project_id, competitor, count(*) AS mentions FROM wc WHERE is_competitor AND competitor <> 'comp' || project_id GROUP BY 1, 2),
k AS (SELECT r_regionkey AS project_id, unnest([{", ".join(f"'{c}'" for c in COMPETITORS)}, 'newcomer']) AS competitor FROM region)
SELECT k.project_id, k.competitor, coalesce(mentions, 0) AS mentions FROM k LEFT JOIN m ON m.project_id = k.project_id AND m.competitor = k.competitor""",
)
def _unmentioned(p: Projection) -> DataFrame:
    cited = _window(p).where("is_competitor").where(F.col("competitor") != F.concat(F.lit("comp"), F.col("project_id").cast("string")))
    mentioned = cited.groupBy("project_id", "competitor").agg(F.count("*").alias("mentions"))
    configured = p.table("region").select(F.col("r_regionkey").alias("project_id"), F.explode(F.array(*[F.lit(c) for c in (*COMPETITORS, "newcomer")])).alias("competitor"))
    return citations.unmentioned(mentioned, configured)


_SENT = ("positive", "neutral", "negative", "mixed", "unknown")


@query(
    "competitive_sentiment",
    f"""{WITH}{_windowed(LONG)}, s AS (SELECT project_id, entity, sentiment, count(*) AS n, min(completed_at) AS first_at FROM windowed WHERE mentioned GROUP BY 1, 2, 3),
r AS (SELECT *, row_number() OVER (PARTITION BY project_id, entity ORDER BY n DESC, sentiment = 'positive' DESC, first_at, sentiment DESC) AS k FROM s),
t AS (SELECT project_id, entity, max(strength_no) AS st, max(completed_at) AS latest_at FROM windowed WHERE mentioned GROUP BY 1, 2)
SELECT r.project_id, r.entity, {", ".join(f"coalesce(max(n) FILTER (WHERE sentiment = '{s}'), 0) AS n_{s}" for s in _SENT)}, max(sentiment) FILTER (WHERE k = 1) AS dominant,
  any_value(CASE st WHEN 0 THEN 'unknown' WHEN 1 THEN 'none' WHEN 2 THEN 'weak' WHEN 3 THEN 'moderate' ELSE 'strong' END) AS strongest, any_value(latest_at) AS latest_at
FROM r JOIN t USING (project_id, entity) GROUP BY 1, 2""",
)
def _sentiment(p: Projection) -> DataFrame:
    return competitive.sentiment_profile(_seen(p, LONG))


@query(
    "competitive_data_quality",
    f"""{WITH} SELECT project_id, count(*) AS sample_size, count(DISTINCT prompt_id) AS prompts, count(DISTINCT provider) AS provider_count, string_agg(DISTINCT provider, ',' ORDER BY provider) AS providers, string_agg(DISTINCT model, ',' ORDER BY model) AS models,
  string_agg(DISTINCT parser_version, ',' ORDER BY parser_version) AS parser_versions, min(completed_at) AS first_at, max(completed_at) AS last_at, CASE WHEN count(*) >= 50 THEN 'high' WHEN count(*) >= 20 THEN 'moderate' WHEN count(*) >= 5 THEN 'low' ELSE 'insufficient' END AS confidence,
  5 AS competitors_configured FROM eligible WHERE completed_at >= {_NOW} - INTERVAL {LONG} DAY AND completed_at < {_NOW} GROUP BY 1""",
)
def _quality(p: Projection) -> DataFrame:
    out = competitive.data_quality(p.eligible_between(p.ago(LONG), p.now()), len(COMPETITORS))
    return out.withColumns({c: F.array_join(c, ",") for c in ("providers", "models", "parser_versions")})


@query("prompt_first_run", f"""{WITH}, r AS (SELECT *, row_number() OVER (PARTITION BY prompt_id ORDER BY completed_at, run_id) AS n FROM eligible) SELECT project_id, prompt_id, run_id, category, provider, completed_at FROM r WHERE n = 1""")
def _first_run(p: Projection) -> DataFrame:
    return competitive.first_of_prompt(p.eligible)


# ---- prompts --------------------------------------------------------------------------------------------------------

_PROFILE = {"company": ("acme",), "offering": ("item 1", "tool"), "competitor": ("fix",), "descriptor": ("low", "urgent"), "geo": ("near me",)}
_RULED = "CASE o_orderkey % 4 WHEN 0 THEN 'pricing' WHEN 1 THEN 'comparison' WHEN 2 THEN 'discovery' ELSE 'local' END"


def _any_sql(*groups: str) -> str:
    return "(" + " OR ".join(f"contains(n, '{t}')" for g in groups for t in _PROFILE.get(g, ())) + ")"


_QUALITY = f"""q AS (SELECT o_orderkey AS prompt_id, o_custkey % 5 AS set_id, o_orderkey % 3 > 0 AS is_active, o_orderdate AS created_at, {_RULED} AS category, (o_custkey % 10) / 10.0 AS sim, {_PROMPT} AS t FROM orders),
w AS (SELECT *, trim(regexp_replace(regexp_replace(lower(t), '[^a-z0-9\\s]', ' ', 'g'), '\\s+', ' ', 'g')) AS n FROM q),
c AS (SELECT *, CASE WHEN {_any_sql("offering", "company", "product")} THEN 0.6 ELSE 0.0 END + least(0.4, 0.2 * (CAST({_any_sql("competitor")} AS INT) + CAST({_any_sql("descriptor")} AS INT) + CAST({_any_sql("geo")} AS INT))) AS relevance, greatest(0.0, 1.0 - sim) AS uniqueness,
  least(1.0, CASE category WHEN 'pricing' THEN 0.95 WHEN 'comparison' THEN 0.85 WHEN 'discovery' THEN 0.35 ELSE 0.80 END + CASE WHEN regexp_matches(t, '{prompts.COMMERCIAL_MARKS}') THEN 0.1 ELSE 0 END) AS commercial_intent,
  CASE WHEN {_any_sql("competitor", "company", "product")} THEN 0.4 ELSE 0.0 END + CASE WHEN {_any_sql("descriptor", "geo")} THEN 0.3 ELSE 0.0 END + CASE WHEN len(string_split(n, ' ')) BETWEEN 6 AND 18 THEN 0.3 ELSE 0.1 END AS specificity, CASE WHEN {_any_sql("geo")} THEN 1.0 ELSE 0.4 END AS geo FROM w),
s AS (SELECT *, round_even(round_even(CAST(100.0 * (0.30 * round_even(CAST(relevance AS DOUBLE), 3) + 0.20 * round_even(CAST(uniqueness AS DOUBLE), 3) + 0.25 * round_even(CAST(commercial_intent AS DOUBLE), 3) + 0.15 * round_even(CAST(specificity AS DOUBLE), 3) + 0.10 * geo) AS DOUBLE), 6), 1) AS quality_score FROM c),
pr AS (SELECT *, CASE WHEN quality_score >= 80 THEN 1 WHEN quality_score >= 65 THEN 2 WHEN quality_score >= 50 THEN 3 WHEN quality_score >= 35 THEN 4 ELSE 5 END AS priority FROM s)"""


def _scored_prompts(p: Projection) -> DataFrame:
    key = F.col("o_orderkey") % 4
    category = F.when(key == 0, "pricing").when(key == 1, "comparison").when(key == 2, "discovery").otherwise("local")
    rows = p.table("orders").select(
        F.col("o_orderkey").alias("prompt_id"), (F.col("o_custkey") % 5).alias("set_id"), (F.col("o_orderkey") % 3 > 0).alias("is_active"), F.col("o_orderdate").alias("created_at"), category.alias("category"), ((F.col("o_custkey") % 10) / 10.0).alias("max_similarity"), _prompt_text().alias("text")
    )
    return prompts.prompt_quality(rows, _PROFILE)


@query("prompt_quality", f"WITH {_QUALITY} SELECT prompt_id, CAST(relevance AS DOUBLE) AS relevance, CAST(specificity AS DOUBLE) AS specificity, quality_score, priority FROM pr")
def _prompt_quality(p: Projection) -> DataFrame:
    return _scored_prompts(p).select("prompt_id", "relevance", "specificity", "quality_score", "priority")


@query("prompt_set_counts", f"WITH {_QUALITY} SELECT set_id, count(*) AS total, count(*) FILTER (WHERE is_active) AS active FROM pr GROUP BY 1")
def _set_counts(p: Projection) -> DataFrame:
    return prompts.set_counts(_scored_prompts(p))


@query(
    "prompt_set_list",
    f"""WITH {_QUALITY}, r AS (SELECT set_id, prompt_id, priority, CASE WHEN prompt_id % 11 > 0 THEN quality_score END AS quality_score, created_at FROM pr WHERE is_active),
o AS (SELECT *, CAST(row_number() OVER (PARTITION BY set_id ORDER BY priority, quality_score DESC NULLS LAST, created_at, prompt_id) AS INTEGER) AS rank, count(*) OVER (PARTITION BY set_id) AS total FROM r) SELECT set_id, prompt_id, rank, total FROM o WHERE rank > 10 AND rank <= 60""",
)
def _set_list(p: Projection) -> DataFrame:
    rows = _scored_prompts(p).where("is_active").withColumn("quality_score", F.when(F.col("prompt_id") % 11 > 0, F.col("quality_score")))
    return graph.listed(rows, ["set_id"], prompts.prompt_order(), 50, 10).select("set_id", "prompt_id", "rank", "total")


_MENTIONS = """m AS (SELECT l_orderkey AS response_id, CASE WHEN l_suppkey % 4 = 0 THEN 'Brand' ELSE 'C' || (l_suppkey % 4) END AS name, l_linenumber AS block_no, CAST(l_partkey % 50 AS INTEGER) AS place_at, CASE WHEN l_partkey % 3 > 0 THEN l_linenumber END AS position, CAST(l_partkey % 5 AS INTEGER) AS strength_rank FROM lineitem),
n AS (SELECT response_id, name, min(position) AS position, min(block_no * 1000 + place_at) AS place, max(strength_rank) AS st, count(*) AS n FROM m GROUP BY 1, 2)"""


@query(
    "answer_summary",
    f"""WITH {_MENTIONS} SELECT response_id, string_agg(name, ',' ORDER BY position IS NULL, position, place, name) AS recommended, min(position) FILTER (WHERE name = 'Brand') AS brand_position, (list(name ORDER BY place, name))[1] AS first_mentioned, bool_or(name = 'Brand') AS brand_mentioned,
  coalesce(string_agg(name, ',' ORDER BY name) FILTER (WHERE name <> 'Brand'), '') AS competitors, max(st) FILTER (WHERE name = 'Brand') AS brand_strength_rank, CAST(sum(n) AS BIGINT) AS mentions FROM n GROUP BY 1""",
)
def _summary(p: Projection) -> DataFrame:
    supplier, part = F.col("l_suppkey"), F.col("l_partkey")
    rows = p.table("lineitem").select(
        F.col("l_orderkey").alias("response_id"), F.when(supplier % 4 == 0, "Brand").otherwise(F.concat(F.lit("C"), (supplier % 4).cast("string"))).alias("name"), F.col("l_linenumber").alias("block_no"), (part % 50).cast("int").alias("at"), F.when(part % 3 > 0, F.col("l_linenumber")).alias("position"), (part % 5).cast("int").alias("strength_rank")
    )
    return prompts.answer_summary(rows, "Brand").withColumns({c: F.array_join(c, ",") for c in ("recommended", "competitors")})


@query(
    "answers_reprocessed",
    """WITH a AS (SELECT o_orderkey AS response_id, CASE WHEN o_orderkey % 17 = 0 THEN NULL WHEN o_orderkey % 3 = 0 THEN 'v1' ELSE 'v2' END AS v FROM orders)
SELECT l_orderkey AS response_id, l_linenumber AS n, CASE WHEN v = 'v2' THEN 'old' ELSE 'new' END AS parse FROM lineitem JOIN a ON response_id = l_orderkey WHERE v = 'v2' OR l_linenumber % 2 = 0""",
)
def _reprocessed(p: Projection) -> DataFrame:
    key = F.col("o_orderkey")
    answers = p.table("orders").select(key.alias("response_id"), F.when(key % 17 == 0, None).when(key % 3 == 0, "v1").otherwise("v2").alias("parser_version"))
    rows = p.table("lineitem").select(F.col("l_orderkey").alias("response_id"), F.col("l_linenumber").alias("n"))
    return prompts.reprocessed(rows.withColumn("parse", F.lit("old")), rows.where("n % 2 = 0").withColumn("parse", F.lit("new")), answers, "v2")


# ---- access, quotas, queues -----------------------------------------------------------------------------------------


@query(
    "accessible_projects",
    """SELECT DISTINCT c_custkey AS user_id, n_nationkey AS project_id FROM customer JOIN nation ON c_custkey % 4 = n_nationkey % 4 WHERE n_nationkey % 4 <> 2""",
)
def _accessible(p: Projection) -> DataFrame:
    projects = p.table("nation").select(F.col("n_nationkey").alias("project_id"), (F.col("n_nationkey") % 4).alias("organization_id"))
    memberships = p.table("customer").select(F.col("c_custkey").alias("user_id"), (F.col("c_custkey") % 4).alias("organization_id"))
    organizations = p.spark.range(4).select(F.col("id").alias("organization_id"), F.when(F.col("id") == 2, F.current_timestamp()).alias("deleted_at"))
    return accounts.accessible(projects, memberships, organizations)


@query(
    "monthly_quota",
    """SELECT user_id, count(*) AS used, greatest(0, 60 - count(*)) AS remaining, count(*) >= 60 AS exhausted FROM events WHERE ts >= TIMESTAMP '2024-01-01' AND ts < TIMESTAMP '2024-01-20 10:00:00' GROUP BY 1""",
)
def _quota(p: Projection) -> DataFrame:
    events = p.table("events").withColumn("at", F.col("ts").cast("timestamp_ntz"))
    return accounts.month_usage(events, "user_id", "at", F.lit("2024-01-20 10:00:00").cast("timestamp_ntz"), F.lit(60))


@query(
    "daily_spend",
    """SELECT user_id, CAST(coalesce(sum(CASE WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-15 18:00:00' THEN CAST(value AS DECIMAL(12,2)) END), 0) AS DOUBLE) AS spent,
  coalesce(sum(CASE WHEN ts >= TIMESTAMP '2024-01-15' AND ts < TIMESTAMP '2024-01-15 18:00:00' THEN CAST(value AS DECIMAL(12,2)) END), 0) >= 50 AS over_budget FROM events GROUP BY 1""",
)
def _spend(p: Projection) -> DataFrame:
    usage = p.table("events").select("user_id", F.col("ts").cast("timestamp_ntz").alias("at"), F.col("value").cast("decimal(12,2)").alias("amount"))
    return accounts.day_spend(usage, "user_id", "at", "amount", F.lit("2024-01-15 18:00:00").cast("timestamp_ntz"), F.lit(50)).withColumn("spent", F.col("spent").cast("double"))


@query("active_projects", f"{WITH} SELECT DISTINCT project_id FROM runs JOIN prompts USING (prompt_id) WHERE completed_at >= {_NOW} - INTERVAL 30 DAY AND run_id IN (SELECT l_orderkey FROM lineitem)")
def _active(p: Projection) -> DataFrame:
    return accounts.active_projects(p.prompts, p.runs, p.citations.select("run_id"), p.ago(30))


@query(
    "batch_expansion",
    f"""{WITH}, r AS (SELECT project_id, prompt_id, row_number() OVER (PARTITION BY project_id ORDER BY prompt_id % 5, prompt_id) AS n FROM prompts WHERE prompt_id % 3 > 0), t AS (SELECT DISTINCT project_id, provider, model FROM eligible)
SELECT 'b1' AS batch, project_id, prompt_id, provider, model, 'queued' AS status, 0 AS attempts FROM r JOIN t USING (project_id) WHERE n <= 500""",
)
def _expansion(p: Projection) -> DataFrame:
    rows = p.prompts.withColumn("priority", F.col("prompt_id") % 5).withColumn("is_active", F.col("prompt_id") % 3 > 0)
    return accounts.expand_batch(rows, p.eligible.select("project_id", "provider", "model").distinct(), "b1", 500)


@query(
    "run_claims",
    """SELECT o_orderkey AS run_id, 'b' || (o_custkey % 50) AS batch, CASE WHEN o_orderstatus <> 'P' THEN 'completed' WHEN o_custkey % 50 = 7 THEN 'cancelled' WHEN o_orderkey % 2 = 0 THEN 'running' ELSE 'queued' END AS status,
  CAST(o_orderkey % 3 + CASE WHEN o_orderstatus = 'P' AND o_custkey % 50 <> 7 AND o_orderkey % 2 = 0 THEN 1 ELSE 0 END AS INTEGER) AS attempts, o_orderstatus = 'P' AND o_custkey % 50 <> 7 AND o_orderkey % 2 = 0 AS started FROM orders""",
)
def _claims(p: Projection) -> DataFrame:
    key = F.col("o_orderkey")
    runs = p.table("orders").select(key.alias("run_id"), F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")).alias("batch"), F.when(F.col("o_orderstatus") == "P", "queued").otherwise("completed").alias("status"), (key % 3).cast("int").alias("attempts"))
    out = accounts.claimed(runs, runs.where("run_id % 2 = 0"), p.spark.createDataFrame([("b7",)], "batch string"), p.now())
    return out.withColumn("started", F.col("started_at").isNotNull()).drop("started_at")


@query(
    "schedules_due",
    """SELECT s AS schedule_id, due_at AS next_run_at FROM (SELECT event_id AS s, date_trunc('second', ts) AS due_at FROM events WHERE user_id % 3 > 0 AND date_trunc('second', ts) <= TIMESTAMP '2024-01-25') ORDER BY due_at, s LIMIT 200""",
)
def _due(p: Projection) -> DataFrame:
    rows = p.table("events").select(F.col("event_id").alias("schedule_id"), F.date_trunc("second", F.col("ts").cast("timestamp_ntz")).cast("timestamp_ntz").alias("next_run_at"), (F.col("user_id") % 3 > 0).alias("is_active"))
    return accounts.due(rows, F.lit("2024-01-25").cast("timestamp_ntz")).select("schedule_id", "next_run_at")


# ---- audits ---------------------------------------------------------------------------------------------------------


@query(
    "audit_previous",
    """SELECT event_id AS audit_id, user_id AS project_id, lag(event_id) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS previous_id FROM events WHERE event_type <> 'error'""",
)
def _previous(p: Projection) -> DataFrame:
    rows = p.table("events").select(F.col("event_id").alias("audit_id"), F.col("user_id").alias("project_id"), F.col("ts").alias("completed_at"), F.when(F.col("event_type") == "error", "failed").otherwise("completed").alias("status"))
    return accounts.previous_audits(rows).select("audit_id", "project_id", "previous_id")


_OBSERVED = """o AS (SELECT event_id, event_type AS code, CASE WHEN user_id % 5 > 0 THEN 'u' || user_id END AS url, event_id % 7 AS severity, event_type AS category, ts < TIMESTAMP '2024-01-16' AS before FROM events),
i AS (SELECT DISTINCT code, url FROM o WHERE before AND event_id % 9 = 0), f AS (SELECT o.*, i.code IS NOT NULL AS ignored FROM o LEFT JOIN i ON i.code = o.code AND i.url IS NOT DISTINCT FROM o.url WHERE NOT before)"""


def _carried(p: Projection) -> DataFrame:
    rows = p.table("events").select(
        "event_id", F.col("event_type").alias("code"), F.when(F.col("user_id") % 5 > 0, F.concat(F.lit("u"), F.col("user_id").cast("string"))).alias("url"), (F.col("event_id") % 7).cast("string").alias("severity"), F.col("event_type").alias("category"), (F.col("ts").cast("timestamp_ntz") < F.lit("2024-01-16").cast("timestamp_ntz")).alias("before")
    )
    before = rows.where("before").withColumn("status", F.when(F.col("event_id") % 9 == 0, "ignored").otherwise("open"))
    return accounts.carry_ignored(rows.where("NOT before").drop("before"), before)


@query("audit_carry_ignored", f"WITH {_OBSERVED} SELECT event_id, code, url, CASE WHEN ignored THEN 'ignored' ELSE 'open' END AS status FROM f")
def _carry(p: Projection) -> DataFrame:
    return _carried(p).select("event_id", "code", "url", "status")


@query(
    "audit_summary",
    f"""WITH {_OBSERVED}, s AS (SELECT severity, count(*) AS n FROM f WHERE NOT ignored GROUP BY 1), c AS (SELECT category, count(*) AS n FROM f WHERE NOT ignored GROUP BY 1)
SELECT 'a' AS audit, (SELECT count(*) FROM f WHERE NOT ignored) AS open, (SELECT count(*) FROM f WHERE ignored) AS ignored, (SELECT string_agg(severity || ':' || n, ',' ORDER BY severity) FROM s) AS by_severity, (SELECT string_agg(category || ':' || n, ',' ORDER BY category) FROM c) AS by_category""",
)
def _audit_summary(p: Projection) -> DataFrame:
    out = accounts.audit_summary(_carried(p).withColumn("audit", F.lit("a")), "audit")
    shown = lambda c: F.array_join(F.transform(F.map_entries(c), lambda e: F.concat_ws(":", e["key"], e["value"].cast("string"))), ",")
    return out.withColumn("by_severity", shown("by_severity")).withColumn("by_category", shown("by_category"))


_STATUS = "CAST(CASE event_id % 11 WHEN 0 THEN 404 WHEN 1 THEN 503 WHEN 2 THEN 410 WHEN 3 THEN 204 ELSE 200 END AS INTEGER)"


@query(
    "http_findings",
    f"""WITH e AS (SELECT 's' || (user_id % 4) AS site, {_STATUS} AS http_status, CAST(floor(value) AS INTEGER) % 4 AS hops, event_id % 13 = 0 AS loops FROM events)
SELECT site, CASE WHEN http_status >= 500 THEN 'server_error' WHEN http_status >= 400 THEN 'client_error' ELSE 'non_200' END AS code, CASE WHEN http_status >= 500 THEN 'high' WHEN http_status = 404 THEN 'medium' WHEN http_status >= 400 THEN 'low' ELSE 'info' END AS severity, http_status, count(*) AS affected FROM e WHERE http_status <> 200 GROUP BY 1, 2, 3, 4
UNION ALL SELECT site, 'redirect_chain', 'medium', NULL, count(*) FROM e WHERE hops >= 2 GROUP BY 1 UNION ALL SELECT site, 'redirected_urls', 'info', NULL, count(*) FROM e WHERE hops = 1 GROUP BY 1 UNION ALL SELECT site, 'redirect_loop', 'high', NULL, count(*) FROM e WHERE loops GROUP BY 1""",
)
def _http(p: Projection) -> DataFrame:
    k = F.col("event_id") % 11
    hops = F.floor("value").cast("int") % 4
    rows = p.table("events").select(
        F.concat(F.lit("s"), (F.col("user_id") % 4).cast("string")).alias("site"),
        F.when(k == 0, 404).when(k == 1, 503).when(k == 2, 410).when(k == 3, 204).otherwise(200).alias("http_status"),
        F.when(hops > 0, F.array_repeat(F.lit("https://a.example/"), hops)).alias("redirects"),
        F.when(F.col("event_id") % 13 == 0, "too many redirects").alias("error"),
    )
    return accounts.http_findings(rows, rows)


@query(
    "page_listing",
    f"""SELECT event_id AS page_id FROM events WHERE {_STATUS} < 400 AND event_id % 17 > 0 AND {_STATUS} = 200 AND event_type IN ('click', 'view') AND (contains(lower(props), '"k": 8') OR contains(lower(event_type), '"k": 8'))""",
)
def _listing(p: Projection) -> DataFrame:
    k = F.col("event_id") % 11
    rows = p.table("events").select(
        F.col("event_id").alias("page_id"), F.when(k == 0, 404).when(k == 1, 503).when(k == 2, 410).when(k == 3, 204).otherwise(200).alias("http_status"), F.when(F.col("event_id") % 17 == 0, F.lit(1)).alias("duplicate_of"), F.when(F.col("event_type").isin("click", "view"), "en").otherwise("de").alias("language"), F.col("props").alias("url"), F.col("event_type").alias("title")
    )
    return accounts.listed_pages(accounts.usable_pages(rows), status=200, language="en", duplicates=False, q='"K": 8').select("page_id")


# ---- operators that had no query ------------------------------------------------------------------------------------


@query(
    "link_status",
    """WITH l AS (SELECT l_orderkey, l_linenumber, 'p' || (l_partkey % 3000) AS u FROM lineitem), p AS (SELECT 'p' || p_partkey AS u, p_partkey, CASE WHEN p_partkey % 9 = 0 THEN 404 ELSE 200 END AS s FROM part WHERE p_partkey % 5 > 0)
SELECT l_orderkey, l_linenumber, p_partkey AS target_page_id, CASE WHEN s IS NULL THEN 'unknown' WHEN s < 400 THEN 'ok' ELSE 'broken' END AS status FROM l LEFT JOIN p USING (u)""",
)
def _link_status(p: Projection) -> DataFrame:
    links = p.table("lineitem").select("l_orderkey", "l_linenumber", F.concat(F.lit("p"), (F.col("l_partkey") % 3000).cast("string")).alias("normalized_url"))
    pages = p.table("part").where("p_partkey % 5 > 0").select(F.concat(F.lit("p"), F.col("p_partkey").cast("string")).alias("normalized_url"), F.col("p_partkey").alias("page_id"), F.when(F.col("p_partkey") % 9 == 0, 404).otherwise(200).alias("http_status"))
    return operations.link_status(links, pages).select("l_orderkey", "l_linenumber", "target_page_id", "status")


@query(
    "first_last_seen",
    """SELECT l_suppkey AS domain_id, min(l_shipdate) AS first_seen, max(l_shipdate) AS last_seen FROM lineitem GROUP BY 1""",
)
def _first_last(p: Projection) -> DataFrame:
    rows = p.table("lineitem").select(F.col("l_suppkey").alias("domain_id"), F.col("l_shipdate").alias("first_seen"), F.col("l_shipdate").alias("last_seen"), (F.col("l_orderkey") % 2).alias("half"))
    return operations.first_last_seen(rows.where("half = 0").drop("half"), rows.where("half = 1").drop("half"), ["domain_id"])
