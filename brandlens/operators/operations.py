"""State of work, retention, schedules, cost, digests, and idempotent merging of results."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def latest(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """The newest row of each key; ties go to the larger ``tie``. An aggregate: no sort, map-side combined."""
    row = F.max_by(F.struct(*df.columns), F.struct(F.col(at), F.col(tie))).alias("r")
    return df.groupBy(*keys).agg(row).select("r.*")


def superseded(df: DataFrame, keys: list[str], at: str, tie: str) -> DataFrame:
    """All rows but the newest of each key: what retention may delete."""
    w = Window.partitionBy(*keys).orderBy(F.desc(at), F.desc(tie))
    return df.withColumn("n", F.row_number().over(w)).where("n > 1").drop("n")


def batch_status(runs: DataFrame, key: str) -> DataFrame:
    """Counters and final status of every batch of runs."""
    g = runs.groupBy(key).agg(F.count("*").alias("total"), *[F.count_if(F.col("status") == s).alias(s) for s in ("completed", "failed", "cancelled")])
    done = F.col("completed") + F.col("failed") + F.col("cancelled") >= F.col("total")
    status = (
        F.when(~done, "running")
        .when((F.col("cancelled") > 0) & (F.col("completed") == 0) & (F.col("failed") == 0), "cancelled")
        .when((F.col("completed") == 0) & (F.col("failed") > 0), "failed")
        .when((F.col("completed") > 0) & (F.col("failed") > 0), "partial")
        .otherwise("completed")
    )
    return g.withColumn("batch_status", status)


#: Hours after which a job is taken as lost: (running, queued).
MAX_AGE = {"crawl": (7, 2), "audit": (1, 2), "prompt_run": (1, 12), "agent_run": (1, 2)}


def stale_jobs(jobs: DataFrame, now: Column) -> DataFrame:
    """Jobs (kind, status, since) older than their kind allows."""
    age = F.timestamp_diff("SECOND", F.col("since"), now) / 3600.0
    limit = F.lit(None).cast("double")
    for kind, (running, queued) in MAX_AGE.items():
        limit = F.when(F.col("kind") == kind, F.when(F.col("status") == "running", float(running)).when(F.col("status") == "queued", float(queued))).otherwise(limit)
    return jobs.withColumn("age_hours", F.bround(age, 3)).where(age > limit)


def next_run(cadence: Column, hour: Column, weekday: Column, now: Column) -> Column:
    """Next daily or weekly occurrence strictly after now, in UTC; weekday 0 is Monday."""
    today = F.date_trunc("day", now) + F.make_dt_interval(F.lit(0), hour, F.lit(0), F.lit(0))
    daily = F.when(today <= now, today + F.expr("INTERVAL '1' DAY")).otherwise(today)
    ahead = F.pmod(weekday - F.weekday(now), F.lit(7))
    on_day = today + F.make_dt_interval(ahead, F.lit(0), F.lit(0), F.lit(0))
    weekly = F.when(on_day <= now, on_day + F.expr("INTERVAL '7' DAY")).otherwise(on_day)
    return F.when(cadence == "daily", daily).otherwise(weekly)


def cost(input_tokens: Column, output_tokens: Column, per_million_in: str, per_million_out: str) -> Column:
    """Cost from rates per million tokens, half up to six decimals."""
    rate = lambda r: F.lit(r).cast("decimal(12,6)")
    whole = F.coalesce(input_tokens, F.lit(0)).cast("decimal(18,0)") * rate(per_million_in) + F.coalesce(output_tokens, F.lit(0)).cast("decimal(18,0)") * rate(per_million_out)
    return F.round(whole.cast("decimal(38,12)") / F.lit(1000000).cast("decimal(7,0)"), 6).cast("decimal(18,6)")


def link_status(links: DataFrame, pages: DataFrame) -> DataFrame:
    """Internal links resolved against crawled pages: ok, broken (status 400 or more) or unknown."""
    joined = links.join(pages.select(F.col("normalized_url").alias("_url"), F.col("page_id").alias("target_page_id"), F.col("http_status").alias("target_status")), F.col("normalized_url") == F.col("_url"), "left")
    return joined.drop("_url").withColumn("status", F.when(F.col("target_status").isNull(), "unknown").when(F.col("target_status") < 400, "ok").otherwise("broken"))


def merge(existing: DataFrame, fresh: DataFrame, key: list[str], preserved: list[str], defaults: dict[str, str]) -> DataFrame:
    """Upsert: fresh analysis columns replace, ``preserved`` human columns survive, and rows whose evidence is gone go if
    they are still as the defaults made them (``status`` new). Keys compare null-safely. Running it again changes nothing."""
    analysed = [c for c in fresh.columns if c not in key and c not in preserved]
    on = None
    for k in key:
        same = F.col(f"e.{k}").eqNullSafe(F.col(f"f.{k}"))
        on = same if on is None else on & same
    e = existing.withColumn("_here", F.lit(True)).alias("e")
    f = fresh.withColumn("_new", F.lit(True)).alias("f")
    joined = e.join(f, on, "full")
    new, here = F.col("f._new").isNotNull(), F.col("e._here").isNotNull()
    columns = [F.when(new, F.col(f"f.{k}")).otherwise(F.col(f"e.{k}")).alias(k) for k in key]
    columns += [F.when(new, F.col(f"f.{c}")).otherwise(F.col(f"e.{c}")).alias(c) for c in analysed]
    columns += [F.when(here, F.col(f"e.{c}")).otherwise(F.lit(defaults.get(c))).alias(c) for c in preserved]
    keep = new | (F.col("e.status") != defaults.get("status", "new"))
    return joined.where(keep).select(*columns)


def first_last_seen(existing: DataFrame, fresh: DataFrame, key: list[str]) -> DataFrame:
    """Dimension upsert that keeps the earliest first_seen and the latest last_seen."""
    return existing.unionByName(fresh).groupBy(*key).agg(F.min("first_seen").alias("first_seen"), F.max("last_seen").alias("last_seen"))


def project_sources(cited: DataFrame) -> DataFrame:
    """Per project the counts of each domain, and of each page of it, in one grouping-sets pass; page_id null is the domain."""
    return (
        cited.groupingSets([("project_id", "domain_id"), ("project_id", "domain_id", "page_id")], "project_id", "domain_id", "page_id")
        .agg(F.count("*").alias("citations"), F.count_if("is_brand").alias("brand_citations"), F.count_if("is_competitor").alias("competitor_citations"), F.min("cited_at").alias("first_cited_at"), F.max("cited_at").alias("last_cited_at"), F.grouping("page_id").alias("whole_domain"))
        .where("whole_domain = 1 OR page_id IS NOT NULL")
        .drop("whole_domain")
    )


def digest(observations: DataFrame, cited: DataFrame, now: Column, days: int = 7) -> DataFrame:
    """Per project the week's responses, mention rate and citations, with the week before; quiet projects are marked."""
    from brandlens.operators.visibility import with_period

    o = with_period(observations, "completed_at", now, days).groupBy("project_id").agg(
        *[F.count_if(F.col("period") == p).alias(f"responses_{p}") for p in ("current", "previous")],
        *[F.count_if((F.col("period") == p) & F.col("brand_mentioned")).alias(f"mentions_{p}") for p in ("current", "previous")],
    )
    c = with_period(cited, "cited_at", now, days).groupBy("project_id").agg(*[F.count_if(F.col("period") == p).alias(f"citations_{p}") for p in ("current", "previous")])
    joined = o.join(c, "project_id", "left").na.fill(0)
    return joined.withColumn("quiet", (F.col("responses_current") == 0) & (F.col("citations_current") == 0))


def verification(latest_issues: DataFrame, previous_issues: DataFrame) -> DataFrame:
    """Issue identity is (code, url), null urls alike: still open, verified as resolved, or new in the latest audit."""
    key = F.col("a.code").eqNullSafe(F.col("b.code")) & F.col("a.url").eqNullSafe(F.col("b.url"))
    gone = previous_issues.alias("a").join(latest_issues.alias("b"), key, "left_anti").select("code", "url", F.lit("verified").alias("state"))
    open_ = latest_issues.alias("a").join(previous_issues.alias("b"), key, "left_semi").select("code", "url", F.lit("awaiting").alias("state"))
    new = latest_issues.alias("a").join(previous_issues.alias("b"), key, "left_anti").select("code", "url", F.lit("new").alias("state"))
    return gone.unionByName(open_).unionByName(new)
