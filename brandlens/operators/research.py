"""Research findings: seven generators over the results of other operators, one score, the strongest of each project.

Every generator turns rows into candidates of one shape, so they are fused by a union; the inputs are bounded for each
project (ten gaps of a kind, five names, two claims), and ranking is one window with a limit.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions.urls import host_suffixes

# Weights in points of 100, what an effort scores, what the content gaps call for, how much is looked at and kept.
WEIGHTS = {"business_relevance": 25.0, "visibility_impact": 25.0, "competitor_advantage": 20.0, "evidence_strength": 20.0, "effort": 10.0}
EFFORT = {"low": 1.0, "medium": 0.6, "high": 0.3}
CONFIDENCE_RANK = {"high": 3, "medium": 2, "low": 1, "insufficient": 0}
GAP_EFFORT = {"missing_comparison": "high", "missing_topic": "medium", "missing_faq": "medium", "missing_use_case": "medium", "missing_product_detail": "medium", "weak_topic": "low", "missing_evidence": "medium"}
GAPS, NAMES, CLAIMS, FINDINGS = 10, 5, 2, 7
LEAST_GAP_SCORE, LEAST_HEALTH, LEAST_REPEATS, SMALL_SAMPLE = 60, 60, 3, 10


def _ranked(confidence: Column) -> Column:
    return F.coalesce(F.element_at(F.create_map(*[F.lit(x) for pair in CONFIDENCE_RANK.items() for x in pair]), confidence), F.lit(0))


def _by_sample(sample: Column) -> Column:
    return F.when(sample >= 50, "high").when(sample >= 20, "medium").otherwise("low")


def _first(rows: DataFrame, most: int, *order: Column) -> DataFrame:
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("project_id").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def _candidate(rows: DataFrame, generator: str, key: Column, title: Column, confidence: Column, impact: Column, evidence: list[str], **components: Column) -> DataFrame:
    """``components`` by name of WEIGHTS, each 0 to 1."""
    return rows.select(
        "project_id", F.lit(generator).alias("generator"), key.alias("key"), title.alias("title"), confidence.alias("confidence"), impact.alias("impact"),
        F.to_json(F.struct(*[F.col(c) for c in evidence])).alias("evidence"), *[components[k].cast("double").alias(k) for k in WEIGHTS],
    )


def competitor_leads(advantages: DataFrame, insights: DataFrame, samples: DataFrame) -> DataFrame:
    """Material leads: advantages (project_id, competitor, advantage, material), insights (project_id, competitor), samples (project_id, sample_size)."""
    related = insights.groupBy("project_id", "competitor").agg(F.count("*").alias("related"))
    rows = advantages.where("material").join(related, ["project_id", "competitor"], "left").join(samples, "project_id", "left").withColumn("related", F.coalesce("related", F.lit(0)))
    name, lead = F.col("competitor"), F.coalesce("advantage", F.lit(0.0))
    return _candidate(
        rows, "competitor", F.concat(F.lit("competitor:"), name), F.concat(name, F.lit(" holds a material AI-visibility lead")), _by_sample(F.coalesce("sample_size", F.lit(0))), F.when(lead >= 20, "high").otherwise("medium"),
        ["competitor", "advantage", "related"], business_relevance=F.lit(1.0), visibility_impact=F.least(F.lit(1.0), lead / 30.0), competitor_advantage=F.lit(1.0), evidence_strength=F.least(F.lit(1.0), 0.5 + 0.25 * F.col("related")), effort=F.lit(EFFORT["low"]),
    )


def citation_openings(gaps: DataFrame, rivals: DataFrame) -> DataFrame:
    """The best citation gaps on other sites than the rivals' own. gaps: project_id, domain, gap_type, confidence, score,
    brand_citations, competitor_citations; rivals: project_id, name (normalised), host (either may be null).

    A rival's own site is its host or a part of it, or has its name as a label.
    """
    best = _first(gaps, GAPS, F.desc("score"), F.asc("domain")).where((F.col("score") >= LEAST_GAP_SCORE) & (F.col("confidence") != "insufficient"))
    parts = best.select("project_id", "domain", F.explode(F.array_union(F.transform(host_suffixes(F.col("domain")), lambda s: F.concat(F.lit("h:"), s)), F.transform(F.split("domain", r"\."), lambda s: F.concat(F.lit("n:"), s)))).alias("part"))
    own = rivals.select("project_id", F.explode(F.array(F.concat(F.lit("h:"), F.nullif("host", F.lit(""))), F.concat(F.lit("n:"), F.nullif("name", F.lit(""))))).alias("part")).where("part IS NOT NULL")
    rows = best.join(parts.join(own, ["project_id", "part"], "left_semi").select("project_id", "domain").distinct(), ["project_id", "domain"], "left_anti")
    b, c = F.col("brand_citations"), F.col("competitor_citations")
    return _candidate(
        rows, "citation", F.concat(F.lit("citation:"), "domain"), F.concat(F.lit("Citation gap on "), "domain"), F.col("confidence"), F.when(F.col("score") >= 75, "high").otherwise("medium"),
        ["domain", "gap_type", "score", "brand_citations", "competitor_citations"], business_relevance=F.lit(0.8), visibility_impact=F.least(F.lit(1.0), F.col("score") / 100.0),
        competitor_advantage=F.least(F.lit(1.0), c / F.greatest(F.lit(1), b + c)), evidence_strength=F.least(F.lit(1.0), _ranked(F.col("confidence")) / 3.0), effort=F.lit(EFFORT["medium"]),
    )


def content_openings(gaps: DataFrame) -> DataFrame:
    """The best content gaps: project_id, topic, gap_type, confidence, score."""
    rows = _first(gaps, GAPS, F.desc("score"), F.asc("topic"), F.asc("gap_type")).where((F.col("score") >= LEAST_GAP_SCORE) & (F.col("confidence") != "insufficient"))
    effort = F.coalesce(F.element_at(F.create_map(*[x for k, e in GAP_EFFORT.items() for x in (F.lit(k), F.lit(EFFORT[e]))]), F.col("gap_type")), F.lit(EFFORT["medium"]))
    return _candidate(
        rows, "content", F.concat_ws(":", F.lit("content"), "topic", "gap_type"), F.concat(F.lit("Content gap: "), "topic"), F.col("confidence"), F.when(F.col("score") >= 80, "high").otherwise("medium"),
        ["topic", "gap_type", "score"], business_relevance=F.lit(1.0), visibility_impact=F.least(F.lit(1.0), F.col("score") / 100.0), competitor_advantage=F.lit(0.7), evidence_strength=F.least(F.lit(1.0), _ranked(F.col("confidence")) / 3.0), effort=effort,
    )


def weak_identity(profiles: DataFrame) -> DataFrame:
    """Crawled projects whose organization, its profiles or its description are not in structured data. profiles: project_id, has_organization, has_description, same_as_links."""
    issues = F.array_compact(
        F.array(
            F.when(~F.col("has_organization"), F.lit("no organization")),
            F.when(F.col("has_organization") & (F.col("same_as_links") == 0), F.lit("no sameAs profiles")),
            F.when(F.col("has_organization") & ~F.col("has_description"), F.lit("no description")),
        )
    )
    rows = profiles.withColumn("issues", issues).where(F.size("issues") > 0)
    return _candidate(
        rows, "entity", F.lit("entity:organization"), F.lit("Weak machine-readable brand identity"), F.lit("medium"), F.lit("medium"),
        ["issues"], business_relevance=F.lit(0.7), visibility_impact=F.lit(0.5), competitor_advantage=F.lit(0.5), evidence_strength=F.lit(0.9), effort=F.lit(EFFORT["low"]),
    )


def technical_issues(audits: DataFrame) -> DataFrame:
    """Projects whose latest audit has critical findings or a low or no score. audits: project_id, health_score, critical."""
    critical = F.col("critical") > 0
    rows = audits.where(critical | F.coalesce(F.col("health_score") < LEAST_HEALTH, F.lit(False)))
    return _candidate(
        rows, "seo", F.lit("seo:technical"), F.lit("Technical SEO issues on the crawled site"), F.lit("high"), F.when(critical, "high").otherwise("medium"),
        ["health_score", "critical"], business_relevance=F.lit(0.6), visibility_impact=F.when(critical, 0.6).otherwise(0.4), competitor_advantage=F.lit(0.3), evidence_strength=F.lit(1.0), effort=F.lit(EFFORT["medium"]),
    )


def emerging_names(candidates: DataFrame) -> DataFrame:
    """Discovered names of high or medium confidence, the surest first: project_id, name, confidence (0 to 1), label, status."""
    rows = _first(candidates, NAMES, F.desc("confidence"), F.asc("name")).where("status = 'new' AND label IN ('high', 'medium')").withColumnRenamed("confidence", "sure")
    return _candidate(
        rows, "emerging", F.concat(F.lit("emerging:"), "name"), F.concat(F.lit("Emerging competitor candidate: "), "name"), F.col("label"), F.lit("medium"),
        ["name", "sure"], business_relevance=F.lit(0.6), visibility_impact=F.lit(0.4), competitor_advantage=F.lit(0.6), evidence_strength=F.least(F.lit(1.0), F.col("sure")), effort=F.lit(EFFORT["low"]),
    )


def repeated_claims(claims: DataFrame, samples: DataFrame) -> DataFrame:
    """What answers say of a rival three times or more, the two most often said. claims: project_id, competitor, claim (one row each time)."""
    counted = claims.groupBy("project_id", "competitor", "claim").agg(F.count("*").alias("count")).where(F.col("count") >= LEAST_REPEATS)
    rows = _first(counted, CLAIMS, F.desc("count"), F.asc("competitor"), F.asc("claim")).join(samples, "project_id", "left")
    return _candidate(
        rows, "claim", F.concat_ws(":", F.lit("claim"), "competitor", F.substring("claim", 1, 60)), F.concat(F.lit("AI answers repeat a claim about "), "competitor"), F.when(F.coalesce("sample_size", F.lit(0)) >= 20, "medium").otherwise("low"), F.lit("medium"),
        ["competitor", "claim", "count"], business_relevance=F.lit(0.7), visibility_impact=F.lit(0.5), competitor_advantage=F.lit(0.6), evidence_strength=F.least(F.lit(1.0), F.col("count") / 5.0), effort=F.lit(EFFORT["medium"]),
    )


def findings(candidates: list[DataFrame], samples: DataFrame, most: int = FINDINGS) -> DataFrame:
    """The ``most`` candidates of each project by score, then title and key, with rank and score (one decimal).

    Below ten responses, or without any, no finding is surer than low.
    """
    every = reduce(DataFrame.unionByName, candidates).join(samples, "project_id", "left")
    small = F.coalesce("sample_size", F.lit(0)) < SMALL_SAMPLE
    confidence = F.when(small & (_ranked(F.col("confidence")) > 1), "low").otherwise(F.col("confidence"))
    # weights are whole, so points of two decimals add up without a tie that hangs on the order
    score = F.bround(sum((w * F.bround(F.col(k), 6) for k, w in WEIGHTS.items()), F.lit(0.0)), 1)
    scored = every.withColumns({"confidence": confidence, "score": score}).drop("sample_size")
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("score"), "title", "key"))
    return scored.withColumn("rank", rank).where(F.col("rank") <= most)
