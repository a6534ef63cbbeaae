"""Queries over second readings, decisions on candidates, primary metrics and research runs, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators import decisions, views, visibility
from brandlens.plans.analytics import _BOTH, LONG, WITH, _metric_ctes, _seen, _windowed, query
from brandlens.sources.projection import COMPETITORS, Projection

#: A second reader judges some entities of a response by its number, in capitals, some twice, and one that nobody mentioned.
_JUDGED = """m AS (SELECT run_id, entity AS brand, sentiment, CASE strength_no WHEN 0 THEN 'unknown' WHEN 1 THEN 'none' WHEN 2 THEN 'weak' WHEN 3 THEN 'moderate' ELSE 'strong' END AS strength, position, 'rules' AS source FROM windowed WHERE mentioned),
j AS (SELECT run_id, 'BRAND' AS brand_name, CASE run_id % 3 WHEN 0 THEN 'positive' WHEN 1 THEN 'negative' ELSE 'unknown' END AS sentiment, CASE run_id % 4 WHEN 0 THEN 'unknown' ELSE 'weak' END AS strength, run_id % 7 AS position, run_id % 2 = 0 AS explicit FROM eligible
  UNION ALL SELECT run_id, 'Comp1', 'mixed', 'strong', NULL, true FROM eligible WHERE run_id % 5 = 0)"""


def _mentions(p: Projection) -> DataFrame:
    return _seen(p, LONG).where("mentioned").select("run_id", F.col("entity").alias("brand"), "sentiment", "strength", "position", F.lit("rules").alias("source"))


def _judgements(p: Projection) -> DataFrame:
    run, runs = F.col("run_id"), p.eligible
    one = lambda seq, brand, sentiment, strength, position, explicit: (F.lit(seq).alias("sequence"), F.lit(brand).alias("brand_name"), sentiment.alias("sentiment"), strength.alias("strength"), position.cast("int").alias("position"), explicit.alias("ranking_is_explicit"))
    brand = one(2, "BRAND", F.when(run % 3 == 0, "positive").when(run % 3 == 1, "negative").otherwise("unknown"), F.when(run % 4 == 0, "unknown").otherwise("weak"), run % 7, run % 2 == 0)
    earlier = one(1, "Brand", F.lit("mixed"), F.lit("strong"), F.lit(99), F.lit(True))
    rival = one(3, "Comp1", F.lit("mixed"), F.lit("strong"), F.lit(None), F.lit(True))
    return runs.select("run_id", *brand).unionByName(runs.select("run_id", *earlier)).unionByName(runs.where(run % 5 == 0).select("run_id", *rival))


@query(
    "mentions_judged",
    f"""{WITH}{_windowed(LONG)}, {_JUDGED},
t AS (SELECT m.*, j.sentiment AS js, j.strength AS jt, j.position AS jp, m.sentiment IN ('unknown', 'neutral') AND coalesce(j.sentiment, 'unknown') <> 'unknown' AS a, m.strength = 'unknown' AND coalesce(j.strength, 'unknown') <> 'unknown' AS b,
  m.position IS NULL AND coalesce(j.explicit, false) AND j.position IS NOT NULL AS c FROM m LEFT JOIN j ON j.run_id = m.run_id AND lower(j.brand_name) = m.brand)
SELECT run_id, brand, CASE WHEN a THEN js ELSE sentiment END AS sentiment, CASE WHEN b THEN jt ELSE strength END AS strength, CAST(CASE WHEN c THEN jp ELSE position END AS INTEGER) AS position, CASE WHEN a OR b OR c THEN 'llm' ELSE source END AS source FROM t""",
)
def _judged(p: Projection) -> DataFrame:
    return decisions.merge_judgements(_mentions(p), _judgements(p))


@query(
    "interpretation_needed",
    f"""{WITH}{_windowed(LONG)}, {_JUDGED} SELECT run_id, bool_or(strength = 'unknown' OR sentiment IN ('unknown', 'neutral')) OR NOT bool_or(run_id % 3 > 0) AS needed FROM m GROUP BY 1""",
)
def _needed(p: Projection) -> DataFrame:
    return decisions.needs_interpretation(_mentions(p).withColumn("answer_is_list", F.col("run_id") % 3 > 0))


@query(
    "claims_judged",
    f"""{WITH}, c AS (SELECT run_id, competitor AS subject, strength AS predicate, sentiment AS object, 0.8 AS confidence FROM cited WHERE is_competitor),
j AS (SELECT run_id, CASE WHEN run_id % 9 = 0 THEN 'Nobody' ELSE upper(competitor) END AS subject, upper(strength) AS predicate, CASE WHEN position % 2 = 0 THEN sentiment ELSE 'bold' END AS object, position / 5.0 AS confidence FROM cited WHERE is_competitor)
SELECT run_id, subject, predicate, object, CAST(confidence AS DOUBLE) AS confidence FROM c UNION ALL SELECT run_id, lower(subject), predicate, object, CAST(least(confidence, 0.9) AS DOUBLE) FROM j WHERE subject <> 'Nobody'
  AND NOT EXISTS (SELECT 1 FROM c WHERE c.run_id = j.run_id AND c.subject = lower(j.subject) AND c.predicate = lower(j.predicate) AND c.object = lower(j.object))""",
)
def _claims(p: Projection) -> DataFrame:
    cited = p.cited().where("is_competitor")
    claims = cited.select("run_id", F.col("competitor").alias("subject"), F.col("strength").alias("predicate"), F.col("sentiment").alias("object"), F.lit(0.8).alias("confidence"))
    judged = cited.select(
        "run_id", F.when(F.col("run_id") % 9 == 0, "Nobody").otherwise(F.upper("competitor")).alias("subject"), F.upper("strength").alias("predicate"), F.when(F.col("position") % 2 == 0, F.col("sentiment")).otherwise("bold").alias("object"), (F.col("position") / 5.0).alias("confidence")
    )
    brands = p.table("region").select(F.explode(F.array(*[F.lit(c) for c in COMPETITORS])).alias("brand"))
    return decisions.merge_claims(claims, judged, brands)


#: Customers are candidates of their region's project; suppliers and nations are what the project has.
_CANDIDATES = """c AS (SELECT n_regionkey AS project_id, c_custkey AS candidate_id, CASE WHEN c_custkey % 13 > 0 THEN 'n' || (c_custkey * 7) % 400 ELSE '' END AS key, CASE WHEN c_custkey % 11 > 0 THEN 'd' || (c_custkey * 3) % 500 END AS domain,
  CASE c_custkey % 5 WHEN 0 THEN 'accepted' WHEN 1 THEN 'rejected' ELSE 'new' END AS status FROM customer JOIN nation ON c_nationkey = n_nationkey),
names AS (SELECT DISTINCT s_nationkey % 5 AS project_id, 'n' || s_suppkey AS key FROM supplier), taken AS (SELECT DISTINCT s_nationkey % 5 AS project_id, 'd' || s_suppkey * 2 AS domain FROM supplier), own AS (SELECT DISTINCT n_regionkey AS project_id, 'd' || n_nationkey * 5 AS domain FROM nation),
f AS (SELECT c.*, own.domain IS NOT NULL AS is_own, taken.domain IS NOT NULL AS is_taken, names.key IS NOT NULL AS is_named FROM c LEFT JOIN own ON own.project_id = c.project_id AND own.domain = c.domain LEFT JOIN taken ON taken.project_id = c.project_id AND taken.domain = c.domain
  LEFT JOIN names ON names.project_id = c.project_id AND names.key = c.key),
g AS (SELECT *, status <> 'accepted' AND domain IS NOT NULL AND key <> '' AND NOT is_own AND NOT is_taken AND NOT is_named AS free FROM f),
w AS (SELECT *, min(CASE WHEN free THEN candidate_id END) OVER (PARTITION BY project_id, domain) AS fd, min(CASE WHEN free THEN candidate_id END) OVER (PARTITION BY project_id, key) AS fk FROM g)"""


@query(
    "candidate_decisions",
    f"""WITH {_CANDIDATES} SELECT project_id, candidate_id, CASE WHEN status = 'accepted' THEN 'already_accepted' WHEN domain IS NULL THEN 'domain_missing' WHEN key = '' THEN 'name_empty' WHEN is_own THEN 'own_domain' WHEN is_taken OR coalesce(fd < candidate_id, false) THEN 'domain_taken'
  WHEN is_named OR coalesce(fk < candidate_id, false) THEN 'name_taken' ELSE 'accepted' END AS outcome, CASE status WHEN 'accepted' THEN 'conflict' ELSE 'rejected' END AS if_rejected FROM w""",
)
def _decisions(p: Projection) -> DataFrame:
    text = lambda letter, number: F.concat(F.lit(letter), number.cast("string"))
    k, nations, suppliers = F.col("c_custkey"), p.table("nation"), p.table("supplier")
    candidates = p.table("customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select(
        F.col("n_regionkey").alias("project_id"), k.alias("candidate_id"), F.when(k % 13 > 0, text("n", k * 7 % 400)).otherwise("").alias("key"), F.when(k % 11 > 0, text("d", k * 3 % 500)).alias("domain"),
        F.when(k % 5 == 0, "accepted").when(k % 5 == 1, "rejected").otherwise("new").alias("status"),
    )
    project = (F.col("s_nationkey") % 5).alias("project_id")
    outcomes = decisions.accept_outcomes(
        candidates, suppliers.select(project, text("n", F.col("s_suppkey")).alias("key")), suppliers.select(project, text("d", F.col("s_suppkey") * 2).alias("domain")), nations.select(F.col("n_regionkey").alias("project_id"), text("d", F.col("n_nationkey") * 5).alias("domain"))
    )
    return outcomes.join(candidates.select("project_id", "candidate_id", decisions.reject_outcome(F.col("status")).alias("if_rejected")), ["project_id", "candidate_id"])


_VALUES = {m: "competitive_score" if m == "competitive_share" else m for m in views.PRIMARY_METRICS}
_SHORT = "'Not enough responses in the previous period'"


def _reason(metric: str) -> str:
    missing = {"score": "'Not enough responses in the current period'", "average_position": f"'{views.NO_POSITION}'", "competitive_share": f"'{views.NO_MENTIONS}'"}.get(metric, "'Not enough responses in this period'")
    before = _SHORT if metric == "score" else f"CASE WHEN coalesce(q.sufficiency, 'insufficient') = 'insufficient' THEN {_SHORT} ELSE 'No previous value' END"
    return f"CASE WHEN c.{_VALUES[metric]} IS NULL THEN {missing} WHEN q.{_VALUES[metric]} IS NULL THEN {before} END"


@query(
    "view_primary_metrics",
    f"{WITH}{_BOTH}{_metric_ctes('project_id, period')} "
    + " UNION ALL ".join(
        f"SELECT c.project_id, '{m}' AS metric, CAST(c.{v} AS DOUBLE) AS value, CAST(round_even(c.{v} - q.{v}, 1) AS DOUBLE) AS change, {str(m in views.LESS_IS_BETTER).lower()} AS lower_is_better, c.sample_size, c.sufficiency, {_reason(m)} AS reason FROM metrics c LEFT JOIN metrics q ON q.project_id = c.project_id AND q.period = 'previous' WHERE c.period = 'current'"
        for m, v in _VALUES.items()
    ),
)
def _primary(p: Projection) -> DataFrame:
    blocks = visibility.metric_block(visibility.with_period(p.observations, "completed_at", p.now(), 90), ["project_id", "period"])
    return views.primary_metrics(blocks, F.lit(len(COMPETITORS)))


#: Orders are runs of agents; their lines are findings, the first ones with a recommendation.
@query(
    "view_research_findings",
    """WITH r AS (SELECT o_custkey AS project_id, o_orderkey AS run_id, o_orderdate AS created_at FROM orders WHERE o_orderkey % 3 <> 0 AND o_orderstatus <> 'P' AND o_orderkey IN (SELECT l_orderkey FROM lineitem)),
l AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY project_id ORDER BY created_at DESC, run_id DESC) AS n FROM r) WHERE n = 1),
f AS (SELECT project_id, run_id, row_number() OVER (PARTITION BY run_id ORDER BY l_linenumber, l_partkey, l_quantity) - 1 AS i, l_linenumber, l_partkey, l_quantity FROM l JOIN lineitem ON l_orderkey = run_id)
SELECT project_id, run_id, CAST(i AS INTEGER) AS index, CASE WHEN l_partkey % 3 = 0 THEN run_id || ':' || i ELSE 'k' || l_partkey END AS finding_id, CASE WHEN l_partkey % 4 = 0 THEN 'Finding' ELSE 'part ' || l_partkey END AS title, l_quantity AS priority_score,
  CASE WHEN i < 2 THEN 'area ' || i END AS area, CASE WHEN l_partkey % 2 = 0 THEN 'g' || l_partkey END AS content_gap_id FROM f""",
)
def _research(p: Projection) -> DataFrame:
    text = lambda value: F.lit(value).cast("string")

    def finding(line):
        part, number = line["l_partkey"], line["l_partkey"].cast("string")
        evidence = F.when(part % 2 == 0, F.create_map(F.lit("content_gap_id"), F.concat(F.lit("g"), number))).otherwise(F.expr("cast(map() AS map<string,string>)"))
        key, title = F.when(part % 3 != 0, F.concat(F.lit("k"), number)), F.when(part % 4 != 0, F.concat(F.lit("part "), number))
        return F.struct(key.alias("key"), title.alias("title"), text("high").alias("impact"), text("low").alias("confidence"), line["l_quantity"].alias("priority_score"), evidence.alias("evidence"))

    # an order has few lines
    lines = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_quantity")))
    found = p.table("lineitem").groupBy(F.col("l_orderkey").alias("run_id")).agg(lines.alias("lines")).select("run_id", F.transform("lines", finding).alias("findings"))
    advice = F.array(*[F.struct(text("act").alias("recommended_action"), text("now").alias("why_now"), text(f"area {i}").alias("expected_area_of_impact")) for i in range(2)])
    runs = p.table("orders").select(F.col("o_custkey").alias("project_id"), F.col("o_orderkey").alias("run_id"), F.when(F.col("o_orderkey") % 3 != 0, "research").otherwise("strategy").alias("agent_name"), F.when(F.col("o_orderstatus") == "P", "failed").otherwise("completed").alias("status"), F.col("o_orderdate").alias("created_at"))
    rows = views.priority_findings(views.latest_research_run(runs.join(found, "run_id", "left").withColumn("recommendations", advice)))
    return rows.select("project_id", "run_id", "index", "finding_id", "title", "priority_score", "area", "content_gap_id")
