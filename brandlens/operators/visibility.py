"""Brand visibility: rates, position and sentiment points, the score, and its change and trend."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.functions import ladders as L
from brandlens.sources.projection import COMPETITORS

# Weights of the score's components, in points of 100.
WEIGHTS = {"mention_rate": 25.0, "recommendation_rate": 25.0, "position_score": 15.0, "citation_rate": 15.0, "sentiment_score": 10.0, "competitive_score": 10.0}
FLAT_BELOW = 2.0


def competitive_score(brand: Column, top_rival: Column) -> Column:
    """100 if no rival is mentioned more often than the brand, else the ratio; null if nobody is mentioned."""
    return F.when((brand == 0) & (F.coalesce(top_rival, F.lit(0)) == 0), F.lit(None).cast("double")).when(brand >= F.coalesce(top_rival, F.lit(0)), F.lit(100.0)).otherwise(F.lit(100.0) * brand / top_rival)


def rival_mentions(observations: DataFrame, configured: DataFrame, keys: list[str]) -> DataFrame:
    """``keys``, entity, mentions: responses that mention a competitor which their project has configured.

    ``configured`` is project_id, entity; ``keys`` has project_id. Mentions are counted by entity before they meet the table.
    """
    counts = observations.select(*keys, F.explode(F.array_distinct("competitors")).alias("entity")).groupBy(*keys, "entity").agg(F.count("*").alias("mentions"))
    return counts.join(configured, ["project_id", "entity"], "left_semi")


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """left with right's other columns, where all keys are equal; null equals null."""
    named = right.withColumnsRenamed({k: f"_{k}" for k in keys})
    on = [F.col(k).eqNullSafe(F.col(f"_{k}")) for k in keys]
    return left.join(named, on, how).drop(*[f"_{k}" for k in keys])


def metric_block(observations: DataFrame, keys: list[str], competitors: tuple[str, ...] = COMPETITORS, configured: DataFrame | None = None) -> DataFrame:
    """One row of visibility metrics for each group of ``keys``, in a single aggregation.

    Few and known ``competitors`` of all projects are conditional counts of the same pass. With ``configured``
    (project_id, entity) each project is held against its own rivals instead, and one without any has no competitive score;
    ``keys`` must then have project_id.
    """
    if configured is not None:
        competitors = ()
    mentioned = F.col("brand_mentioned")
    counts = [
        F.count("*").alias("sample_size"),
        F.count_if(mentioned).alias("n_mentioned"),
        F.count_if("recommended").alias("n_recommended"),
        F.count_if(F.col("brand_citations") > 0).alias("n_cited"),
        F.avg(F.when(mentioned, F.col("brand_position"))).alias("raw_position"),
        F.count(F.when(mentioned, F.col("brand_position"))).alias("n_positioned"),
        F.avg(F.when(mentioned, L.position_points(F.col("brand_position")))).alias("raw_position_score"),
        F.avg(F.when(mentioned, L.sentiment_points(F.col("brand_sentiment")))).alias("raw_sentiment_score"),
        F.countDistinct("prompt_id").alias("prompts"),
        F.min("completed_at").alias("first_at"),
        F.max("completed_at").alias("last_at"),
        *[F.count_if(mentioned & (F.col("brand_sentiment") == s)).alias(f"n_{s}") for s in L.SENTIMENTS],
        F.greatest(*[F.count_if(F.array_contains("competitors", c)) for c in competitors], F.lit(0), F.lit(0)).alias("top_rival"),
    ]
    g = observations.groupBy(*keys).agg(*counts)
    rivalry = competitive_score(F.col("n_mentioned"), F.col("top_rival"))
    if configured is not None:
        top = rival_mentions(observations, configured, keys).groupBy(*keys).agg(F.max("mentions").alias("top_rival"))
        g = _same(g.drop("top_rival"), top, keys).join(configured.select("project_id", F.lit(True).alias("has_rivals")).distinct(), "project_id", "left")
        rivalry = F.when(F.col("has_rivals"), rivalry)
    n = F.col("sample_size")
    raw = {
        "mention_rate": L.share(F.col("n_mentioned"), n),
        "recommendation_rate": L.share(F.col("n_recommended"), n),
        "position_score": F.col("raw_position_score"),
        "citation_rate": L.share(F.col("n_cited"), n),
        "sentiment_score": F.col("raw_sentiment_score"),
        "competitive_score": rivalry,
    }
    score = L.available_mean({k: (v, WEIGHTS[k]) for k, v in raw.items()})
    return g.select(
        *keys,
        "sample_size",
        L.round_for(n, score).alias("score"),
        *[L.round_for(n, v).alias(k) for k, v in raw.items()],
        F.bround("raw_position", 2).alias("average_position"),
        "n_positioned",
        *[f"n_{s}" for s in L.SENTIMENTS],
        "prompts",
        L.sufficiency(n).alias("sufficiency"),
        "first_at",
        "last_at",
    )


def with_period(df: DataFrame, at: str, now: Column, days: int) -> DataFrame:
    """Rows of the current and the previous window of ``days``, marked; one scan serves both."""
    start, before = now - F.expr(f"INTERVAL '{days}' DAY"), now - F.expr(f"INTERVAL '{2 * days}' DAY")
    t = F.col(at)
    return df.where((t >= before) & (t < now)).withColumn("period", F.when(t >= start, "current").otherwise("previous"))


def compare(current: Column, previous: Column) -> tuple[Column, Column]:
    """(change, direction): null if a side is; flat if smaller than two points."""
    change = F.bround(current - previous, 1)
    return change, F.when(change.isNull(), "unavailable").when(F.abs(change) < FLAT_BELOW, "flat").when(change > 0, "up").otherwise("down")


def overview(observations: DataFrame, now: Column, days: int) -> DataFrame:
    """Per project: the metrics of the window, those of the window before, and the change of the score."""
    both = metric_block(with_period(observations, "completed_at", now, days), ["project_id", "period"])
    current, previous = (both.where(F.col("period") == p) for p in ("current", "previous"))
    previous = previous.select("project_id", F.col("score").alias("previous_score"), F.col("sample_size").alias("previous_sample_size"))
    # a project that only the window before has stays, with an empty current one
    joined = current.drop("period").join(previous, "project_id", "full")
    joined = joined.withColumn("sample_size", F.coalesce("sample_size", F.lit(0))).withColumn("sufficiency", F.coalesce("sufficiency", F.lit("insufficient")))
    change, direction = compare(F.col("score"), F.col("previous_score"))
    return joined.withColumn("change", change).withColumn("direction", direction)


def weekly_trend(observations: DataFrame, now: Column, days: int = 90, keys: tuple[str, ...] = ("project_id",)) -> DataFrame:
    """Metrics of every 7-day bucket of the window, counted from its start; the last one ends with it. Empty buckets are there."""
    start = now - F.expr(f"INTERVAL '{days}' DAY")
    buckets = -(-days // 7)
    t = F.col("completed_at")
    inside = observations.where((t >= start) & (t < now))
    dated = inside.withColumn("bucket", F.floor(F.timestamp_diff("SECOND", start, t) / (7 * 86400)).cast("int"))
    found = metric_block(dated, [*keys, "bucket"])
    every = observations.select(*keys).distinct().withColumn("bucket", F.explode(F.sequence(F.lit(0), F.lit(buckets - 1))))
    out = every.join(found, [*keys, "bucket"], "left")
    return out.select(*keys, "bucket", F.coalesce("sample_size", F.lit(0)).alias("sample_size"), "score", "mention_rate", "citation_rate", F.coalesce("sufficiency", F.lit("insufficient")).alias("sufficiency"))


def competitor_table(observations: DataFrame, competitors: tuple[str, ...] = COMPETITORS) -> DataFrame:
    """Per project and entity: mentions, mention rate, and share of voice among all entities' mentions."""
    g = observations.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if("brand_mentioned").alias("brand"), *[F.count_if(F.array_contains("competitors", c)).alias(c) for c in competitors])
    total = sum((F.col(e) for e in competitors), F.col("brand"))
    rows = F.explode(F.array(*[F.struct(F.lit(e).alias("entity"), F.col(e).alias("mentions")) for e in ("brand", *competitors)]))
    return g.select("project_id", "n", total.alias("total"), rows.alias("r")).select(
        "project_id", "r.entity", "r.mentions", L.round_for(F.col("n"), L.share(F.col("r.mentions"), F.col("n"))).alias("mention_rate"), L.round_for(F.col("n"), L.share(F.col("r.mentions"), F.nullif("total", F.lit(0)))).alias("share_of_voice")
    )


def configured_table(observations: DataFrame, configured: DataFrame) -> DataFrame:
    """competitor_table with each project's own rivals: mentions, mention rate and share of voice of the brand and of them."""
    totals = observations.groupBy("project_id").agg(F.count("*").alias("n"), F.count_if("brand_mentioned").alias("brand"))
    rivals = totals.select("project_id").join(configured.distinct(), "project_id").join(rival_mentions(observations, configured, ["project_id"]), ["project_id", "entity"], "left")
    rows = rivals.select("project_id", "entity", F.coalesce("mentions", F.lit(0)).alias("mentions")).unionByName(totals.select("project_id", F.lit("brand").alias("entity"), F.col("brand").alias("mentions")))
    voices = rows.groupBy("project_id").agg(F.sum("mentions").alias("total"))
    n = F.col("n")
    return rows.join(voices, "project_id").join(totals.select("project_id", "n"), "project_id").select(
        "project_id", "entity", "mentions", L.round_for(n, L.share(F.col("mentions"), n)).alias("mention_rate"), L.round_for(n, L.share(F.col("mentions"), F.nullif("total", F.lit(0)))).alias("share_of_voice")
    )
