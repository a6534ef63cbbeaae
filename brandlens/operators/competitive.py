"""Competitive visibility: one score for every entity, advantages over the brand, ranking, prompt leaders."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions import ladders as L
from brandlens.functions.names import dominant_sentiment
from brandlens.operators.visibility import compare, with_period
from brandlens.sources.projection import BRAND, is_recommended

# Weights of the components, in points of 100, and thresholds.
WEIGHTS = {"mention_share": 30.0, "recommendation_share": 25.0, "position_score": 15.0, "citation_share": 15.0, "sentiment_score": 15.0}
RANKING_MIN_SAMPLE, MATERIAL, WIN_MARGIN = 20, 10.0, 5.0


def entity_metrics(views: DataFrame, keys: list[str]) -> DataFrame:
    """Metrics of every entity in each group of ``keys``; an entity never mentioned scores 0, not null."""
    return _rated(views.groupBy(*keys, "entity").agg(F.count("*").alias("sample_size"), *_counts()), keys)


def configured_entity_metrics(responses: DataFrame, mentions: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    """entity_metrics of the brand and of the competitors that each project has configured (project_id, entity).

    ``responses`` has run_id, prompt_id and ``keys`` (project_id among them), ``mentions`` run_id, entity, position,
    strength, sentiment, citations. Only mentions are joined and counted; responses are counted by group and meet the
    table of entities after, so no response is unfolded by entity.
    """
    entities = configured.select("project_id", "entity").unionByName(responses.select("project_id", F.lit(BRAND).alias("entity"))).distinct()
    said = mentions.join(responses.select("run_id", "prompt_id", *keys), "run_id").join(entities, ["project_id", "entity"], "left_semi")
    said = said.withColumns({"mentioned": F.lit(True), "recommended": is_recommended()})
    counted = said.groupBy(*keys, "entity").agg(*_counts())
    sizes = responses.groupBy(*keys).agg(F.count("*").alias("sample_size")).join(entities, "project_id")
    whole = sizes.join(counted, [*keys, "entity"], "left").na.fill(0, ["mentions", "recommendations", "cited_responses", "citations", "positioned_mentions", "prompts_appearing"])
    return _rated(whole, keys)


def _counts() -> list[Column]:
    m = F.col("mentioned")
    return [
        F.count_if(m).alias("mentions"),
        F.count_if("recommended").alias("recommendations"),
        F.count_if(F.col("citations") > 0).alias("cited_responses"),
        F.sum("citations").alias("citations"),
        F.count("position").alias("positioned_mentions"),
        F.avg("position").alias("raw_position"),
        F.avg(L.position_points(F.col("position"))).alias("raw_position_score"),
        F.avg(F.when(m, L.sentiment_points(F.col("sentiment")))).alias("raw_sentiment"),
        F.countDistinct(F.when(m, F.col("prompt_id"))).alias("prompts_appearing"),
    ]


def _rated(g: DataFrame, keys: list[str]) -> DataFrame:
    n = F.col("sample_size")
    raw = {
        "mention_share": L.share(F.col("mentions"), n),
        "recommendation_share": L.share(F.col("recommendations"), n),
        "position_score": F.col("raw_position_score"),
        "citation_share": L.share(F.col("cited_responses"), n),
        "sentiment_score": F.col("raw_sentiment"),
    }
    return g.select(
        *keys, "entity", "sample_size", "mentions", "recommendations", "positioned_mentions", "cited_responses", "citations", "prompts_appearing",
        L.round_for(n, L.available_mean({k: (v, WEIGHTS[k]) for k, v in raw.items()})).alias("score"),
        *[L.round_for(n, v).alias(k) for k, v in raw.items()],
        F.bround("raw_position", 2).alias("average_position"),
        L.sufficiency(n).alias("sufficiency"),
    )


def advantages(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """For each competitor its lead over the brand, whether that is material, and the components where it wins."""
    brand = metrics.where(F.col("entity") == BRAND).select(*keys, *[F.col(c).alias(f"brand_{c}") for c in ("score", *WEIGHTS)])
    rows = metrics.where(F.col("entity") != BRAND).join(brand, keys)
    gap = F.bround(F.col("score") - F.col("brand_score"), 1)
    diffs = F.array(*[F.struct((-F.bround(F.col(c) - F.col(f"brand_{c}"), 1)).alias("lost"), F.lit(i).alias("i"), F.lit(c).alias("name")) for i, c in enumerate(WEIGHTS)])
    wins = F.transform(F.array_sort(F.filter(diffs, lambda d: d["lost"] <= -WIN_MARGIN)), lambda d: d["name"])
    return rows.select(
        *keys, F.col("entity").alias("competitor"), F.col("score").alias("competitor_score"), "brand_score", gap.alias("advantage"),
        F.coalesce((F.col("sample_size") >= RANKING_MIN_SAMPLE) & (gap >= MATERIAL), F.lit(False)).alias("material"),
        F.when(gap.isNull(), "insufficient data").when(F.col("sample_size") < RANKING_MIN_SAMPLE, "sample too small to call the gap material").when(gap < MATERIAL, "gap below the material threshold").alias("reason"),
        F.array_join(wins, ",").alias("where_they_win"),
    )


def ranking(metrics: DataFrame, keys: list[str]) -> DataFrame:
    """Entities by score, then name; only where the sample is at least moderate."""
    scored = metrics.where((F.col("sample_size") >= RANKING_MIN_SAMPLE) & F.col("score").isNotNull())
    return scored.select(*keys, "entity", "score", F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("score"), "entity")).alias("rank"))


def prompt_leaders(views: DataFrame) -> DataFrame:
    """Per prompt the entity mentioned most often, then recommended most often, then placed best; ties are marked."""
    g = views.groupBy("project_id", "prompt_id", "entity").agg(
        F.count_if("mentioned").alias("mentions"), F.count_if("recommended").alias("recommendations"), F.min("position").alias("best_position"), F.max("completed_at").alias("last_at")
    )
    best = Window.partitionBy("project_id", "prompt_id").orderBy(F.desc("mentions"), F.desc("recommendations"), F.coalesce("best_position", F.lit(99)))
    first = g.where(F.col("mentions") > 0).withColumn("r", F.rank().over(best)).where("r = 1")
    return first.groupBy("project_id", "prompt_id").agg(F.min("entity").alias("leader"), (F.count("*") > 1).alias("tied"), F.max("mentions").alias("mentions"), F.bool_or(F.col("entity") == BRAND).alias("brand_leads"))


def engine_spread(views: DataFrame) -> DataFrame:
    """Per provider the competitor with the largest lead over the brand."""
    a = advantages(entity_metrics(views, ["project_id", "provider"]), ["project_id", "provider"]).where("advantage IS NOT NULL")
    order = Window.partitionBy("project_id", "provider").orderBy(F.desc("advantage"), "competitor")
    return a.withColumn("r", F.row_number().over(order)).where("r = 1").select("project_id", "provider", "competitor", "advantage", "material")


def changes(views: DataFrame, now: Column, days: int) -> DataFrame:
    """Per entity the score of the window, of the one before, and the change."""
    m = entity_metrics(with_period(views, "completed_at", now, days), ["project_id", "period"])
    wide = m.groupBy("project_id", "entity").agg(F.max(F.when(F.col("period") == "current", F.col("score"))).alias("score"), F.max(F.when(F.col("period") == "previous", F.col("score"))).alias("previous_score"))
    change, direction = compare(F.col("score"), F.col("previous_score"))
    return wide.withColumn("change", change).withColumn("direction", direction)


def sentiment_profile(views: DataFrame) -> DataFrame:
    """Per project and entity: mentions by sentiment, the dominant one, the strongest recommendation and the latest mention.

    Sentiments count once a response; on ties positive wins, else the one seen first.
    """
    said = views.where("mentioned")
    at = lambda s: F.when(F.col("sentiment") == s, F.unix_micros(F.col("completed_at").cast("timestamp")))
    kinds = L.SENTIMENTS
    g = said.groupBy("project_id", "entity").agg(
        *[F.count_if(F.col("sentiment") == s).alias(f"n_{s}") for s in kinds],
        *[F.min(at(s)).alias(f"first_{s}") for s in kinds],
        L.strength_of(F.max(L.strength_rank(F.col("strength")))).alias("strongest"),
        F.max("completed_at").alias("latest_at"),
    )
    dominant = dominant_sentiment({s: F.col(f"n_{s}") for s in kinds}, {s: F.coalesce(f"first_{s}", F.lit((1 << 62))) for s in kinds})
    return g.select("project_id", "entity", *[f"n_{s}" for s in kinds], dominant.alias("dominant"), "strongest", "latest_at")


def data_quality(eligible: DataFrame, configured: int) -> DataFrame:
    """Per project: how much there is to judge by, and how sure that makes."""
    g = eligible.groupBy("project_id").agg(
        F.count("*").alias("sample_size"), F.countDistinct("prompt_id").alias("prompts"), F.array_sort(F.collect_set("provider")).alias("providers"), F.array_sort(F.collect_set("model")).alias("models"), F.array_sort(F.collect_set("parser_version")).alias("parser_versions"), F.min("completed_at").alias("first_at"), F.max("completed_at").alias("last_at")
    )
    return g.withColumn("provider_count", F.size("providers")).withColumn("confidence", L.sufficiency(F.col("sample_size"))).withColumn("competitors_configured", F.lit(configured))


def first_of_prompt(eligible: DataFrame) -> DataFrame:
    """The first run of every prompt, ties to the smaller run: an aggregate, no sort."""
    return eligible.groupBy("project_id", "prompt_id").agg(F.min_by(F.struct("run_id", "category", "provider", "completed_at"), F.struct("completed_at", "run_id")).alias("r")).select("project_id", "prompt_id", "r.*")
