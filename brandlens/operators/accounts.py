"""Access, quotas, budgets, queues and audits of a workspace: set-based forms of its bookkeeping."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def accessible(projects: DataFrame, memberships: DataFrame, organizations: DataFrame, user: Column | None = None) -> DataFrame:
    """(user_id, project_id): projects of organizations that are not deleted and that the user belongs to."""
    alive = organizations.where("deleted_at IS NULL").select("organization_id")
    own = memberships.select("user_id", "organization_id").distinct() if user is None else memberships.where(F.col("user_id") == user).select("user_id", "organization_id").distinct()
    return projects.join(alive, "organization_id", "left_semi").join(own, "organization_id").select("user_id", "project_id")


def month_usage(events: DataFrame, key: str, at: str, now: Column, quota: Column) -> DataFrame:
    """Events of every key since the start of the UTC month, and what its quota leaves, never below 0."""
    g = events.where((F.col(at) >= F.date_trunc("month", now)) & (F.col(at) < now)).groupBy(key).agg(F.count("*").alias("used"))
    return g.withColumn("remaining", F.greatest(F.lit(0).cast("bigint"), quota - F.col("used"))).withColumn("exhausted", F.col("used") >= quota)


def day_spend(usage: DataFrame, key: str, at: str, amount: str, now: Column, budget: Column) -> DataFrame:
    """Spend of every key since the start of the UTC day against its budget; a key without spend today has 0."""
    today = (F.col(at) >= F.date_trunc("day", now)) & (F.col(at) < now)
    g = usage.groupBy(key).agg(F.coalesce(F.sum(F.when(today, F.col(amount))), F.lit(0).cast("decimal(18,2)")).alias("spent"))
    return g.withColumn("over_budget", F.col("spent") >= budget)


def active_projects(prompts: DataFrame, runs: DataFrame, responses: DataFrame, since: Column) -> DataFrame:
    """project_id of projects with a response of a run since ``since``: semi-joins, nothing fans out."""
    recent = runs.where(F.col("completed_at") >= since).join(responses.select("run_id"), "run_id", "left_semi")
    return prompts.join(recent.select("prompt_id"), "prompt_id", "left_semi").select("project_id").distinct()


def expand_batch(prompts: DataFrame, targets: DataFrame, batch: str, most: int) -> DataFrame:
    """A queued run for each of the first ``most`` prompts of a project and each of its targets (project_id, provider, model).

    The operation's own limit is on prompts; targets are a project's few models, so the join is by project.
    """
    w = Window.partitionBy("project_id").orderBy("priority", "prompt_id")
    chosen = prompts.where("is_active").withColumn("n", F.row_number().over(w)).where(F.col("n") <= most).select("project_id", "prompt_id")
    return chosen.join(targets, "project_id").select(F.lit(batch).alias("batch"), "project_id", "prompt_id", "provider", "model", F.lit("queued").alias("status"), F.lit(0).alias("attempts"))


def claimed(runs: DataFrame, wanted: DataFrame, cancelled: DataFrame, now: Column) -> DataFrame:
    """Runs after a claim: wanted queued ones run once more, queued ones of cancelled batches are cancelled, all others stay."""
    w, c = wanted.select("run_id").distinct().withColumn("_w", F.lit(True)), cancelled.select("batch").distinct().withColumn("_c", F.lit(True))
    joined = runs.join(w, "run_id", "left").join(c, "batch", "left")
    queued = F.col("status") == "queued"
    status = F.when(queued & F.col("_c"), "cancelled").when(queued & F.col("_w"), "running").otherwise(F.col("status"))
    starts = queued & F.col("_w") & F.col("_c").isNull()
    return joined.select(*[F.when(starts, F.col("attempts") + 1).otherwise(F.col("attempts")).alias(n) if n == "attempts" else status.alias(n) if n == "status" else F.col(n) for n in runs.columns], F.when(starts, now).alias("started_at"))


def due(schedules: DataFrame, now: Column, most: int = 200) -> DataFrame:
    """The schedules that are due, the longest overdue first; ``most`` is the sweep's own bound."""
    return schedules.where(F.col("is_active") & (F.col("next_run_at") <= now)).orderBy("next_run_at", "schedule_id").limit(most)


def previous_audits(audits: DataFrame) -> DataFrame:
    """Completed audits with the one that a project completed before (previous_id), or null."""
    w = Window.partitionBy("project_id").orderBy("completed_at", "audit_id")
    return audits.where("status = 'completed'").withColumn("previous_id", F.lag("audit_id").over(w))


def carry_ignored(fresh: DataFrame, before: DataFrame) -> DataFrame:
    """Observations (code, url) of an audit with status ignored where the audit before ignored them; a null url fits a null url."""
    ignored = before.where("status = 'ignored'").select(F.col("code").alias("_code"), F.col("url").alias("_url"), F.lit(True).alias("_ignored")).distinct()
    joined = fresh.join(ignored, (F.col("code") == F.col("_code")) & F.col("url").eqNullSafe(F.col("_url")), "left")
    return joined.drop("_code", "_url").withColumn("status", F.when(F.col("_ignored"), "ignored").otherwise("open")).drop("_ignored")


def audit_summary(observations: DataFrame, key: str) -> DataFrame:
    """Open observations of every audit as maps by severity and by category, and how many are ignored."""
    open_ = F.col("status") != "ignored"
    by = lambda c: observations.where(open_).groupBy(key, c).agg(F.count("*").alias("n")).groupBy(key).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct(c, "n")))).alias(f"by_{c}"))
    totals = observations.groupBy(key).agg(F.count_if(open_).alias("open"), F.count_if(~open_).alias("ignored"))
    return totals.join(by("severity"), key, "left").join(by("category"), key, "left")


def http_findings(pages: DataFrame, urls: DataFrame) -> DataFrame:
    """(site, code, severity, http_status, affected) of statuses other than 200, and of how addresses redirect.

    ``pages``: site, http_status; ``urls``: site, redirects (array of hops), error. One finding for each status.
    """
    status = F.col("http_status")
    code = F.when(status >= 500, "server_error").when(status >= 400, "client_error").otherwise("non_200")
    severity = F.when(status >= 500, "high").when(status == 404, "medium").when(status >= 400, "low").otherwise("info")
    answers = pages.where(status != 200).groupBy("site", "http_status").agg(F.count("*").alias("affected")).select("site", code.alias("code"), severity.alias("severity"), "http_status", "affected")
    hops = F.size(F.coalesce("redirects", F.expr("cast(array() AS array<string>)")))
    kinds = F.array_compact(F.array(
        F.when(hops >= 2, F.struct(F.lit("redirect_chain").alias("code"), F.lit("medium").alias("severity"))),
        F.when(F.col("error") == "too many redirects", F.struct(F.lit("redirect_loop").alias("code"), F.lit("high").alias("severity"))),
        F.when(hops == 1, F.struct(F.lit("redirected_urls").alias("code"), F.lit("info").alias("severity"))),
    ))
    ways = urls.select("site", F.explode(kinds).alias("k")).groupBy("site", "k.code", "k.severity").agg(F.count("*").alias("affected"))
    return answers.unionByName(ways.withColumn("http_status", F.lit(None).cast("int")))


def usable_pages(pages: DataFrame) -> DataFrame:
    """Pages that may cover a topic: fetched (a status below 400, or none noted) and no duplicate of another."""
    return pages.where(F.coalesce(F.col("http_status") < 400, F.lit(True)) & F.col("duplicate_of").isNull())


def listed_pages(pages: DataFrame, status: int | None = None, language: str | None = None, duplicates: bool | None = None, q: str | None = None) -> DataFrame:
    """Pages by optional filters that all hold; None filters nothing. ``q`` stands in url or title, whatever its case."""
    out = pages
    if status is not None:
        out = out.where(F.col("http_status") == status)
    if language is not None:
        out = out.where(F.col("language") == language)
    if duplicates is not None:
        out = out.where(F.col("duplicate_of").isNotNull() if duplicates else F.col("duplicate_of").isNull())
    if q:
        needle = F.lit(q.lower())
        out = out.where(F.coalesce(F.contains(F.lower("url"), needle), F.lit(False)) | F.coalesce(F.contains(F.lower("title"), needle), F.lit(False)))
    return out
