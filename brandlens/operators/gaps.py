"""Citation gaps: per source its gap type, confidence, opportunity score and priority; source relevance; recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions import ladders as L
from brandlens.operators.graph import domain_counts

# Weights, points and thresholds of the scores.
WEIGHTS = {"citation_frequency": 25.0, "competitor_gap": 30.0, "source_relevance": 20.0, "prompt_relevance": 15.0, "recency": 10.0}
FREQUENCY_SATURATION = 0.30
RELEVANCE_WEIGHTS = {"frequency": 30.0, "breadth": 20.0, "consistency": 15.0, "source_type": 20.0, "project_frequency": 15.0}
TYPE_POINTS = {
    "government": 85.0, "education": 85.0, "research": 85.0, "media": 75.0, "review": 75.0, "directory": 60.0, "company": 55.0,
    "community": 55.0, "forum": 55.0, "blog": 45.0, "social": 40.0, "other": 50.0, "unknown": 50.0,
}
CONFIDENCE_FACTOR = {"high": 1.0, "medium": 0.85, "low": 0.6}
CRITICAL_MIN_SCORE, CRITICAL_MIN_GAP, CRITICAL_MIN_RESPONSES, HIGH_MIN_SCORE, MEDIUM_MIN_SCORE = 80.0, 0.6, 20, 65.0, 40.0
UNDERREPRESENTED_MIN_RELEVANCE = 50.0
COMMERCIAL_CATEGORIES, COMMERCIAL_STAGES = ("comparison", "recommendation", "pricing", "alternative"), ("consideration", "decision", "purchase")


def is_commercial() -> Column:
    return F.col("category").isin(*COMMERCIAL_CATEGORIES) | F.col("funnel_stage").isin(*COMMERCIAL_STAGES)


def source_relevance(cited_ever: DataFrame, domains: DataFrame, now: Column) -> DataFrame:
    """Per project and domain its relevance, from all projects' counts and the project's own; one decimal.

    Global counts come from the per-project ones where they add up; weeks, which don't, are counted apart.
    """
    own = cited_ever.groupBy("project_id", "domain_id").agg(F.count("*").alias("own"), F.min("cited_at").alias("first_seen"))
    every = Window.partitionBy("domain_id")
    own = own.withColumns({"total": F.sum("own").over(every), "projects": F.count("project_id").over(every), "first_seen": F.min("first_seen").over(every)})
    # a distinct count alone, of small numbers: no row is repeated for it
    week = F.floor(F.datediff("cited_at", F.lit("1970-01-05")) / 7).cast("int")
    weeks = cited_ever.select("domain_id", week.alias("week")).groupBy("domain_id").agg(F.countDistinct("week").alias("weeks"))
    since = F.greatest(F.lit(1), F.floor(F.timestamp_diff("SECOND", F.col("first_seen"), now) / (7 * 86400)) + 1).cast("double")
    points = F.least(F.lit(100.0), L.lookup(F.col("domain_type"), TYPE_POINTS, 50.0) + F.when(F.col("is_authority"), 5.0).otherwise(0.0))
    parts = {
        "frequency": L.log_scaled(F.col("total"), 1000),
        "breadth": F.least(F.lit(100.0), 100.0 * F.col("projects") / 20),
        "consistency": 100.0 * F.least(F.col("weeks").cast("double"), since) / since,
        "source_type": points,
        "project_frequency": L.log_scaled(F.col("own"), 100),
    }
    joined = own.join(weeks, "domain_id").join(domains, "domain_id")
    score = L.available_mean({k: (v, RELEVANCE_WEIGHTS[k]) for k, v in parts.items()})
    return joined.select("project_id", "domain_id", "domain", "domain_type", L.round_even(score, 1).alias("source_relevance"), *[L.round_even(v, 1).alias(k) for k, v in parts.items()])


def gap_stats(cited: DataFrame, eligible: DataFrame, start: Column, days: int, first: str | None = None) -> DataFrame:
    """Per project and domain of one window: counts, both halves of the window, commercial prompts, and the project's totals.

    ``first`` names a column that tells a response's first citation of a domain, if ``cited`` has one: responses are then
    counted by it, and prompts as groups, so that no citation is sent more than twice.
    """
    middle = start + F.expr(f"INTERVAL '{days * 12}' HOUR")
    totals = eligible.groupBy("project_id").agg(F.count("*").alias("eligible_responses"), F.countDistinct("prompt_id").alias("total_prompts"))
    early, late = F.count_if(F.col("cited_at") < middle).alias("first_half"), F.count_if(F.col("cited_at") >= middle).alias("second_half")
    if first is None:
        halves = cited.groupBy("project_id", "domain_id").agg(early, late, F.countDistinct(F.when(is_commercial(), F.col("prompt_id"))).alias("commercial_prompts"))
        return domain_counts(cited).join(halves, ["project_id", "domain_id"]).join(totals, "project_id")
    counts = {"citations": F.count("*"), "responses": F.count_if(first), "brand_citations": F.count_if("is_brand"), "competitor_citations": F.count_if("is_competitor")}
    by_prompt = cited.groupBy("project_id", "domain_id", "prompt_id").agg(
        *[c.alias(k) for k, c in counts.items()], early, late, F.min("cited_at").alias("first_cited_at"), F.max("cited_at").alias("last_cited_at"), F.bool_or(is_commercial()).alias("commercial")
    )
    whole = by_prompt.groupBy("project_id", "domain_id").agg(
        *[F.sum(k).alias(k) for k in (*counts, "first_half", "second_half")], F.min("first_cited_at").alias("first_cited_at"), F.max("last_cited_at").alias("last_cited_at"),
        F.count("prompt_id").alias("prompts"), F.count_if(F.col("commercial") & F.col("prompt_id").isNotNull()).alias("commercial_prompts"),
    )
    return whole.join(totals, "project_id")


def gap_type(now: Column, days: int) -> Column:
    b, c, r = F.col("brand_citations"), F.col("competitor_citations"), F.col("responses")
    fresh = F.floor(F.timestamp_diff("SECOND", F.col("first_cited_at"), now) / 86400) <= days * 0.3
    grows = F.col("second_half") >= F.greatest(F.lit(3), 2 * F.col("first_half"))
    return (
        F.when((b == 0) & fresh & grows, "emerging_source")
        .when((b == 0) & ((c >= 1) | (r >= 3)), "brand_absent")
        .when((b > 0) & (c >= 3) & (c >= 2 * b), "competitor_advantage")
        .when((b > 0) & (c > 0), "shared_source")
        .when((b >= 3) & (c == 0) & (b >= 0.8 * F.col("citations")), "source_overrepresented")
        .otherwise("source_underrepresented")
    )


def gap_confidence() -> Column:
    r, n = F.col("responses"), F.col("eligible_responses")
    return (
        F.when((r <= 1) | (n < 5), "insufficient")
        .when((r >= 20) & (n >= 50), F.when(F.col("domain_type") == "unknown", "medium").otherwise("high"))
        .when((r >= 8) & (n >= 20), "medium")
        .when((r >= 3) & (n >= 5), "low")
        .otherwise("insufficient")
    )


def citation_gaps(stats: DataFrame, relevance: DataFrame, now: Column, days: int) -> DataFrame:
    """Type, confidence, opportunity score and priority of every source."""
    b, c = F.col("brand_citations"), F.col("competitor_citations")
    age = F.timestamp_diff("SECOND", F.col("last_cited_at"), now) / 86400.0
    parts = {
        "citation_frequency": F.least(F.lit(100.0), 100.0 * F.col("responses") / F.col("eligible_responses") / FREQUENCY_SATURATION),
        "competitor_gap": F.when((b == 0) & (c > 0), 100.0).when((b == 0) & (c == 0), 40.0).otherwise(F.greatest(F.lit(0.0), 50.0 + F.try_divide(50.0 * (c - b), c + b))),
        "source_relevance": F.coalesce("source_relevance", F.lit(0.0)),
        "prompt_relevance": F.least(F.lit(100.0), F.try_divide(100.0 * F.col("prompts"), F.col("total_prompts"))),
        "recency": L.recency(F.greatest(F.lit(0.0), age)),
    }
    kind = gap_type(now, days)
    raw = sum((WEIGHTS[k] * v for k, v in parts.items()), F.lit(0.0)) / sum(WEIGHTS.values())
    scale = F.when(F.col("gap_type") == "source_overrepresented", 0.3).when(F.col("gap_type") == "shared_source", 0.7).otherwise(1.0)
    joined = stats.join(relevance.select("project_id", "domain_id", "domain", "domain_type", "source_relevance"), ["project_id", "domain_id"])
    scored = joined.withColumn("gap_type", kind).withColumn("confidence", gap_confidence()).withColumn("score", L.round_even(raw * scale, 1))
    return scored.withColumn("priority", L.band(F.col("score"), 70, 40))


def gap_summary(gaps: DataFrame) -> DataFrame:
    """Per project the number of gaps by type, confidence and priority, in one pass over an unpivot."""
    values = F.explode(F.array(*[F.struct(F.lit(c).alias("dimension"), F.col(c).alias("value")) for c in ("gap_type", "confidence", "priority", "domain_type")]))
    return gaps.select("project_id", values.alias("v")).groupBy("project_id", "v.dimension", "v.value").agg(F.count("*").alias("gaps"))


def recommendations(gaps: DataFrame) -> DataFrame:
    """Gaps worth a recommendation, with score and priority."""
    b, c = F.col("brand_citations"), F.col("competitor_citations")
    fits = (
        (F.col("confidence") != "insufficient")
        & F.col("gap_type").isin("brand_absent", "competitor_advantage", "emerging_source", "source_underrepresented")
        & ~((F.col("domain_type") == "company") & (b == 0) & (c > 0))
        & ((F.col("gap_type") != "source_underrepresented") | (F.col("source_relevance") >= UNDERREPRESENTED_MIN_RELEVANCE))
    )
    business = F.coalesce(F.try_divide(F.col("commercial_prompts"), F.col("prompts")), F.lit(0.0))
    lead = F.coalesce(F.try_divide(c - b, c + b), F.lit(0.0))
    score = L.round_even(F.col("score") * L.lookup(F.col("confidence"), CONFIDENCE_FACTOR, 0.0) * (0.7 + 0.3 * business), 1)
    rows = gaps.where(fits).withColumn("priority_score", score)
    critical = (F.col("priority_score") >= CRITICAL_MIN_SCORE) & (F.col("confidence") == "high") & (lead >= CRITICAL_MIN_GAP) & (F.col("responses") >= CRITICAL_MIN_RESPONSES)
    priority = F.when(critical, "critical").when(F.col("priority_score") >= HIGH_MIN_SCORE, "high").when(F.col("priority_score") >= MEDIUM_MIN_SCORE, "medium").otherwise("low")
    title = F.concat(F.lit("Investigate "), F.col("domain"), F.lit(" visibility opportunity"))
    return rows.select("project_id", "domain", "gap_type", "confidence", "score", L.round_even(business, 3).alias("business_relevance"), "priority_score", priority.alias("priority"), title.alias("title"))


def commercial_prompts(cited: DataFrame) -> DataFrame:
    """Per project and domain, how many of the prompts that cite it are commercial."""
    return cited.groupBy("project_id", "domain_id").agg(F.countDistinct("prompt_id").alias("prompts"), F.countDistinct(F.when(is_commercial(), F.col("prompt_id"))).alias("commercial_prompts"))


# When original research is worth a recommendation.
RESEARCH_MIN_COMPETITOR_CITATIONS, RESEARCH_MIN_RESPONSES, RESEARCH_MIN_COMMERCIAL_SHARE = 3, 2, 0.5


def research_facts(cited: DataFrame, eligible: DataFrame, domains: DataFrame) -> DataFrame:
    """Per project what research sources are cited for, whether original research is warranted, why not, and how sure.

    Citations join nothing that fans them out: relationship flags are theirs already.
    """
    rows = cited.join(domains.where("domain_type = 'research'").select("domain_id"), "domain_id")
    g = rows.groupBy("project_id").agg(
        F.count_if("is_competitor").alias("competitor_citations"),
        F.count_if("is_brand").alias("brand_citations"),
        F.countDistinct("run_id").alias("responses"),
        F.countDistinct("prompt_id").alias("prompts"),
        F.countDistinct(F.when(is_commercial(), F.col("prompt_id"))).alias("commercial_prompts"),
    )
    joined = g.join(eligible.groupBy("project_id").agg(F.count("*").alias("eligible_responses")), "project_id")
    share = F.coalesce(F.try_divide(F.col("commercial_prompts"), F.col("prompts")), F.lit(0.0))
    reasons = F.array_compact(
        F.array(
            F.when(F.col("competitor_citations") < RESEARCH_MIN_COMPETITOR_CITATIONS, "few_competitor_citations"),
            F.when(F.col("responses") < RESEARCH_MIN_RESPONSES, "few_responses"),
            F.when(F.col("brand_citations") > 0, "brand_is_cited"),
            F.when(share < RESEARCH_MIN_COMMERCIAL_SHARE, "not_commercial"),
        )
    )
    r, n = F.col("responses"), F.col("eligible_responses")
    level = F.when((r >= 20) & (n >= 50), "high").when((r >= 8) & (n >= 20), "medium").otherwise("low")
    return joined.withColumn("reasons", F.array_join(reasons, ",")).withColumn("warranted", F.col("reasons") == "").withColumn("confidence", level)
