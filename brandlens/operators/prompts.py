"""Prompts: quality and priority, sets and their counts, answers' order of recommendation."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.functions.text import normalize_prompt

# Weights of the quality score, commercial intent by category, marks of it, length that is right.
QUALITY_WEIGHTS = {"relevance": 0.30, "uniqueness": 0.20, "commercial_intent": 0.25, "specificity": 0.15, "geographic_relevance": 0.10}
COMMERCIAL_BASE = {"transactional": 1.0, "pricing": 0.95, "recommendation": 0.85, "comparison": 0.85, "alternative": 0.85, "local": 0.80, "product": 0.70, "problem_solution": 0.50, "discovery": 0.35, "industry": 0.30}
COMMERCIAL_MARKS = r"(?i)\b(best|top|pricing|price|cost|alternatives?|vs\.?|versus|compare|buy|demo|trial|sign up|recommend)\b"
IDEAL_WORDS = (6, 18)


def _any(normal: Column, terms: Sequence[str]) -> Column:
    return reduce(lambda a, b: a | b, [F.contains(normal, F.lit(t.lower())) for t in terms if t], F.lit(False))


def prompt_quality(prompts: DataFrame, profile: dict[str, Sequence[str]], folded: bool = False) -> DataFrame:
    """``prompts`` (text, category, max_similarity to another prompt of its set) with the quality's parts, score and priority.

    ``profile``: terms of company, product, offering, audience, competitor, descriptor and geo in normal form, a few each. A null text counts as empty. Without geo
    terms the last part doesn't apply and the others weigh more. Priority 1 is the highest.
    """
    terms = lambda *groups: [t for g in groups for t in profile.get(g, ())]
    n = F.col("_normal")
    has = lambda *groups: _any(n, terms(*groups))
    number = lambda c: c.cast("double")
    groups = sum((number(has(g)) for g in ("audience", "competitor", "descriptor", "geo")), F.lit(0.0))
    words = F.size(F.filter(F.split(n, " "), lambda w: w != ""))
    base = reduce(lambda rest, kv: F.when(F.col("category") == kv[0], kv[1]).otherwise(rest), COMMERCIAL_BASE.items(), F.lit(None).cast("double"))
    parts = {
        "relevance": F.when(has("offering", "company", "product"), 0.6).otherwise(0.0) + F.least(F.lit(0.4), 0.2 * groups),
        "uniqueness": F.greatest(F.lit(0.0), 1.0 - F.coalesce("max_similarity", F.lit(0.0))),
        "commercial_intent": F.least(F.lit(1.0), base + F.when(F.col("text").rlike(COMMERCIAL_MARKS), 0.1).otherwise(0.0)),
        "specificity": F.when(has("competitor", "company", "product"), 0.4).otherwise(0.0) + F.when(has("audience", "descriptor", "geo"), 0.3).otherwise(0.0) + F.when(words.between(*IDEAL_WORDS), 0.3).otherwise(0.1),
    }
    if profile.get("geo"):
        parts["geographic_relevance"] = F.when(has("geo"), 1.0).otherwise(0.4)
    rows = prompts.withColumn("_normal", normalize_prompt(F.col("text"), folded)).withColumns({k: F.bround(v, 3) for k, v in parts.items()})
    total = sum(QUALITY_WEIGHTS[k] for k in parts)
    # parts have three decimals and weights two: what six decimals leave out is the noise of binary sums
    score = F.bround(F.bround(100.0 * sum((QUALITY_WEIGHTS[k] * F.col(k) for k in parts), F.lit(0.0)) / total, 6), 1)
    s = F.col("quality_score")
    priority = F.when(s >= 80, 1).when(s >= 65, 2).when(s >= 50, 3).when(s >= 35, 4).otherwise(5)
    return rows.drop("_normal").withColumn("quality_score", score).withColumn("priority", priority)


def set_counts(prompts: DataFrame) -> DataFrame:
    """Prompts of every set, and the active ones."""
    return prompts.groupBy("set_id").agg(F.count("*").alias("total"), F.count_if("is_active").alias("active"))


def prompt_order() -> list[Column]:
    """The order of a set's list: priority, then the best quality with unscored ones last, then age."""
    return [F.col("priority"), F.desc_nulls_last("quality_score"), F.col("created_at"), F.col("prompt_id")]


def answer_summary(mentions: DataFrame, brand: str) -> DataFrame:
    """Per answer: names in the order it recommends them, the brand's position, the first name, who else is named, and totals.

    ``mentions``: response_id, name, block_no, at (place in the block), position (in lists, or null), sentiment, strength_rank. Names
    come by their first list position, those without one last, by place; each once.
    """
    per_name = mentions.groupBy("response_id", "name").agg(F.min("position").alias("position"), F.min(F.struct("block_no", "at")).alias("place"), F.max("strength_rank").alias("strength_rank"), F.count("*").alias("n"))
    rank = F.struct(F.col("position").isNull().alias("unlisted"), F.col("position"), F.col("place"), F.col("name"))
    own = F.col("name") == brand
    g = per_name.groupBy("response_id").agg(
        F.transform(F.array_sort(F.collect_list(rank)), lambda x: x["name"]).alias("recommended"),
        F.min(F.when(own, F.col("position"))).alias("brand_position"),
        F.min_by("name", F.struct("place", "name")).alias("first_mentioned"),
        F.bool_or(own).alias("brand_mentioned"),
        F.array_sort(F.collect_set(F.when(~own, F.col("name")))).alias("competitors"),
        F.max(F.when(own, F.col("strength_rank"))).alias("brand_strength_rank"),
        F.sum("n").alias("mentions"),
    )
    return g


def reprocessed(stored: DataFrame, parsed: DataFrame, answers: DataFrame, version: str, force: bool = False) -> DataFrame:
    """Child rows after a new parse: those of answers parsed by another version (or of all, if forced) are replaced whole.

    ``stored`` and ``parsed``: response_id and the same columns; ``answers``: response_id, parser_version.
    """
    stale = answers.where(F.lit(force) | ~F.col("parser_version").eqNullSafe(F.lit(version))).select("response_id")
    return stored.join(stale, "response_id", "left_anti").unionByName(parsed.join(stale, "response_id", "left_semi"))
