"""What later audits say about resolved issues, and the timeline of each issue over all audits.

An issue is the same in two audits if code and url are; a null url equals a null url. Audits are few for each project;
observations meet the next audit's by one equi-join.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def _key() -> Column:
    # length first: no code and url can read like others
    return F.concat_ws(":", F.length("code").cast("string"), "code", F.coalesce("url", F.lit("")))


def audit_sequence(audits: DataFrame) -> DataFrame:
    """project_id, audit_id, completed_at, health_score, n (from 1), next_id, next_completed_at, next_score of completed audits."""
    w = Window.partitionBy("project_id").orderBy("completed_at", "audit_id")
    done = audits.where("status = 'completed' AND completed_at IS NOT NULL").select("project_id", "audit_id", "completed_at", "health_score")
    return done.withColumns(
        {"n": F.row_number().over(w), "next_id": F.lead("audit_id").over(w), "next_completed_at": F.lead("completed_at").over(w), "next_score": F.lead("health_score").over(w)}
    )


def verification_lifecycle(audits: DataFrame, observations: DataFrame) -> DataFrame:
    """project_id, audit_id, code, url, state, verified_by, score_change of every resolved observation of a completed audit.

    ``observations``: audit_id, code, url, status, updated_at. An issue resolved before the next audit was completed is
    verified if that audit does not find it, and has reappeared if it does, whatever its status there; one resolved later,
    or in the newest audit, awaits a measurement. score_change is the next audit's health score less the own, one decimal.
    """
    order = audit_sequence(audits)
    resolved = observations.where("status = 'resolved'").withColumn("key", _key()).join(order, "audit_id")
    found = observations.select(F.col("audit_id").alias("next_id"), _key().alias("key"), F.lit(True).alias("found")).distinct()
    joined = resolved.join(found, ["next_id", "key"], "left")
    measured = F.coalesce(F.col("updated_at") < F.col("next_completed_at"), F.lit(False))
    state = F.when(~measured, "awaiting").when(F.col("found"), "reappeared").otherwise("verified")
    return joined.select("project_id", "audit_id", "code", "url", state.alias("state"), F.when(measured, F.col("next_id")).alias("verified_by"), F.bround(F.col("next_score") - F.col("health_score"), 1).alias("score_change"))


def issue_islands(audits: DataFrame, observations: DataFrame) -> DataFrame:
    """project_id, code, url, island (from 1), first_audit, last_audit, audits, is_open: runs of audits in a row that find an issue.

    A further island is an issue that was gone and has come back. The newest audit decides what is open.
    """
    order = audit_sequence(audits)
    seen = observations.select("audit_id", "code", "url").distinct().join(order.select("audit_id", "project_id", "n", "next_id"), "audit_id")
    issue = ["project_id", "code", "url"]
    runs = seen.withColumn("run", F.col("n") - F.row_number().over(Window.partitionBy(*issue).orderBy("n")))
    islands = runs.groupBy(*issue, "run").agg(F.min_by("audit_id", "n").alias("first_audit"), F.max_by("audit_id", "n").alias("last_audit"), F.count("*").alias("audits"), F.bool_or(F.col("next_id").isNull()).alias("is_open"))
    return islands.withColumn("island", F.row_number().over(Window.partitionBy(*issue).orderBy("run"))).drop("run")
