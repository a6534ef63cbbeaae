"""View models: what dashboards show of the analysed tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

SEVERITY_ORDER = {"critical": 0, "high": 1, "medium": 2, "low": 3, "info": 4}


def severity_rank(severity: Column) -> Column:
    out = F.lit(9)
    for name, rank in SEVERITY_ORDER.items():
        out = F.when(severity == name, rank).otherwise(out)
    return out


def engine_rows(by_provider: DataFrame) -> DataFrame:
    """Engines by score, unmeasured last."""
    order = Window.partitionBy("project_id").orderBy(F.coalesce("score", F.lit(-1.0)).desc(), "provider")
    return by_provider.withColumn("rank", F.row_number().over(order))


def collapse_prompts(rows: DataFrame, keys: list[str], values: list[str], sample: str = "sample_size") -> DataFrame:
    """Rows of one text as one: values weighted by their samples, null where no row has one."""
    n = F.col(sample)
    means = [F.bround(F.try_divide(F.sum(F.when(F.col(v).isNotNull(), F.col(v) * n)), F.nullif(F.sum(F.when(F.col(v).isNotNull(), n)), F.lit(0))), 4).alias(v) for v in values]
    return rows.groupBy(*keys).agg(F.sum(n).alias(sample), F.count("*").alias("prompts"), *means)


def overall_score(scores: list[Column]) -> Column:
    """Unweighted mean of the scores that are measured."""
    measured = F.filter(F.array(*scores), lambda s: s.isNotNull())
    return F.try_divide(F.aggregate(measured, F.lit(0.0), lambda a, s: a + s), F.nullif(F.size(measured), F.lit(0)))


def priority_opportunities(issues: DataFrame, k: int = 4) -> DataFrame:
    """Issues of one code as one, most severe first, then by reach, then by code; the first k of each project."""
    g = issues.groupBy("project_id", "code").agg(F.min(severity_rank(F.col("severity"))).alias("severity_rank"), F.count("*").alias("reach"))
    order = Window.partitionBy("project_id").orderBy("severity_rank", F.desc("reach"), "code")
    return g.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def issue_list(issues: DataFrame, severity: str | None = None, category: str | None = None, text: str | None = None) -> DataFrame:
    """Issues that pass every filter that is given, in the order of a list."""
    for column, value in (("severity", severity), ("category", category)):
        if value is not None:
            issues = issues.where(F.col(column) == value)
    if text:
        issues = issues.where(F.lower("code").contains(text.lower()) | F.lower("url").contains(text.lower()))
    return issues.orderBy(severity_rank(F.col("severity")), "code", "url")


def metric_changes(audits: DataFrame, metric: str) -> DataFrame:
    """Every audit's value with its change against the last audit before it that has one."""
    w = Window.partitionBy("project_id").orderBy("completed_at")
    before = F.last(metric, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    return audits.withColumn("change", F.bround(F.col(metric) - before, 1))


def measured_zero(by_provider: DataFrame) -> DataFrame:
    """Engines on which the brand was measured and scored 0; an unmeasured one is not among them."""
    return by_provider.where((F.col("score") == 0) & (F.col("sample_size") > 0))


def trend_series(trend: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Series of at least two measured points."""
    counted = F.count(value).over(Window.partitionBy(*keys))
    return trend.withColumn("_n", counted).where((F.col("_n") >= 2) & F.col(value).isNotNull()).drop("_n")


def daily_events(events: DataFrame, at: str) -> DataFrame:
    """Events of a day and kind as one where there are two or more."""
    g = events.groupBy(F.date_trunc("day", at).alias("day"), "event_type").agg(F.count("*").alias("events"), F.min(at).alias("first_at"))
    return g.withColumn("collapsed", F.col("events") >= 2)


# The six primary metrics, whether less is better, and the reason where no position is known.
PRIMARY_METRICS = ("score", "mention_rate", "recommendation_rate", "citation_rate", "average_position", "competitive_share")
LESS_IS_BETTER = ("average_position",)
NO_POSITION = "No positioned mentions in this period"
NO_COMPETITORS = "Add competitors to the project to measure this"
NO_MENTIONS = "Neither the brand nor a configured competitor was mentioned"


def primary_metrics(blocks: DataFrame, competitors_configured: Column) -> DataFrame:
    """Per project the six primary metrics of the current period, their change, and why a number or change is missing.

    ``blocks``: metric rows by project_id and period (current, previous). A project without a current block has none.
    """
    values = {m: F.col("competitive_score" if m == "competitive_share" else m) for m in PRIMARY_METRICS}
    block = F.struct("sample_size", "sufficiency", *[v.cast("double").alias(m) for m, v in values.items()])
    pair = blocks.groupBy("project_id").agg(*[F.any_value(F.when(F.col("period") == p, block), True).alias(p) for p in ("current", "previous")])
    pair = pair.where("current IS NOT NULL").withColumn("_configured", competitors_configured)
    previous_short = F.coalesce(F.col("previous.sufficiency"), F.lit("insufficient")) == "insufficient"

    def row(metric: str) -> Column:
        now, before = F.col(f"current.{metric}"), F.col(f"previous.{metric}")
        reason = F.when(now.isNull(), "Not enough responses in this period").when(before.isNull(), F.when(previous_short, "Not enough responses in the previous period").otherwise("No previous value"))
        if metric == "score":
            reason = F.when(now.isNull(), "Not enough responses in the current period").when(before.isNull(), "Not enough responses in the previous period")
        elif metric == "average_position":
            reason = F.when(now.isNull(), NO_POSITION).otherwise(reason)
        elif metric == "competitive_share":
            reason = F.when(now.isNull(), F.when(F.col("_configured") == 0, NO_COMPETITORS).otherwise(NO_MENTIONS)).otherwise(reason)
        return F.struct(F.lit(metric).alias("metric"), now.alias("value"), F.bround(now - before, 1).alias("change"), F.lit(metric in LESS_IS_BETTER).alias("lower_is_better"), reason.alias("reason"))

    rows = pair.select("project_id", "current.sample_size", "current.sufficiency", F.inline(F.array(*[row(m) for m in PRIMARY_METRICS])))
    return rows.select("project_id", "metric", "value", "change", "lower_is_better", "sample_size", "sufficiency", "reason")


def latest_research_run(runs: DataFrame) -> DataFrame:
    """The newest run of each project that brought findings: of the research agent, completed or awaiting approval.

    An aggregate, not a window; of runs of one moment the one of the greatest run_id.
    """
    told = runs.where((F.col("agent_name") == "research") & F.col("status").isin("completed", "awaiting_approval") & (F.size(F.coalesce("findings", F.array())) > 0))
    best = told.groupBy("project_id").agg(F.max_by(F.struct("run_id", "findings", "recommendations"), F.struct("created_at", "run_id")).alias("r"))
    return best.select("project_id", "r.*")


def priority_findings(runs: DataFrame) -> DataFrame:
    """Findings of runs in their stored order, each beside the recommendation of its index, if there is one.

    ``findings``: array of (key, title, impact, confidence, priority_score, evidence map); ``recommendations``: array of
    (recommended_action, why_now, expected_area_of_impact). A finding without a key is known by run and index.
    """
    rows = runs.select("project_id", "run_id", "recommendations", F.posexplode("findings").alias("index", "f"))
    r = F.get("recommendations", F.col("index"))
    gap = F.try_element_at("f.evidence", F.lit("content_gap_id"))
    return rows.select(
        "project_id", "run_id", "index", F.coalesce(F.nullif("f.key", F.lit("")), F.concat_ws(":", F.col("run_id").cast("string"), F.col("index").cast("string"))).alias("finding_id"), F.coalesce("f.title", F.lit("Finding")).alias("title"),
        "f.impact", "f.confidence", "f.priority_score", r["expected_area_of_impact"].alias("area"), r["recommended_action"].alias("recommended_action"), r["why_now"].alias("why_now"), gap.alias("content_gap_id"),
    )


def covered_gaps(found: DataFrame) -> DataFrame:
    """The content gaps that findings already cover."""
    return found.where("content_gap_id IS NOT NULL").select("project_id", "content_gap_id").distinct()


def action_plan(actions: DataFrame) -> DataFrame:
    """Actions by risk, then sequence."""
    risk = F.when(F.col("risk") == "low", 0).when(F.col("risk") == "medium", 1).otherwise(2)
    return actions.withColumn("rank", F.row_number().over(Window.partitionBy("workflow_id").orderBy(risk, "sequence")))


def allowed_transition(current: Column, wanted: Column, edges: dict[str, tuple[str, ...]]) -> Column:
    """Whether a status may follow another."""
    out = F.lit(False)
    for start, ends in edges.items():
        out = F.when(current == start, wanted.isin(*ends) if ends else F.lit(False)).otherwise(out)
    return out


# How people may move a recommendation on.
RECOMMENDATION_STATES = {
    "new": ("reviewing", "approved", "dismissed"),
    "reviewing": ("approved", "dismissed"),
    "approved": ("in_progress", "dismissed"),
    "in_progress": ("completed", "dismissed"),
    "dismissed": ("reviewing",),
    "completed": (),
}
