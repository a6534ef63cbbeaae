"""Judgements of a second reader merged into what rules found, and what people decide on discovered competitors."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Confidence that a second reader's claim can have at most.
MOST_CONFIDENCE = 0.9


def needs_interpretation(mentions: DataFrame) -> DataFrame:
    """(run_id, needed) of runs with mentions (run_id, sentiment, strength, answer_is_list): a second reading is due where some
    sentiment or strength is unsettled, or the answer is prose."""
    unsettled = (F.col("strength") == "unknown") | F.col("sentiment").isin("unknown", "neutral")
    return mentions.groupBy("run_id").agg((F.bool_or(unsettled) | ~F.bool_or(F.coalesce("answer_is_list", F.lit(False)))).alias("needed"))


def merge_judgements(mentions: DataFrame, judgements: DataFrame) -> DataFrame:
    """Mentions (run_id, brand, sentiment, strength, position, source) with what a second reader adds, source ``llm``.

    ``judgements``: run_id, sequence, brand_name, sentiment, strength, position, ranking_is_explicit; of several for one brand
    the last holds. Only what is unknown is filled: an unknown or neutral sentiment, an unknown strength, a missing position
    if the answer ranks explicitly. Brands that the rules did not find are never added.
    """
    fields = F.struct("sentiment", "strength", "position", "ranking_is_explicit")
    last = judgements.groupBy("run_id", F.lower("brand_name").alias("_brand")).agg(F.max_by(fields, "sequence").alias("_j"))
    rows = mentions.withColumn("_brand", F.lower("brand")).join(last, ["run_id", "_brand"], "left")
    told = lambda field: F.coalesce(F.col(f"_j.{field}"), F.lit("unknown"))
    takes_sentiment = F.col("sentiment").isin("unknown", "neutral") & (told("sentiment") != "unknown")
    takes_strength = (F.col("strength") == "unknown") & (told("strength") != "unknown")
    takes_position = F.col("position").isNull() & F.coalesce(F.col("_j.ranking_is_explicit"), F.lit(False)) & F.col("_j.position").isNotNull()
    merged = {
        "sentiment": F.when(takes_sentiment, F.col("_j.sentiment")).otherwise(F.col("sentiment")),
        "strength": F.when(takes_strength, F.col("_j.strength")).otherwise(F.col("strength")),
        "position": F.when(takes_position, F.col("_j.position")).otherwise(F.col("position")),
        "source": F.when(takes_sentiment | takes_strength | takes_position, "llm").otherwise(F.col("source")),
    }
    return rows.withColumns(merged).drop("_brand", "_j")


def merge_claims(claims: DataFrame, judged: DataFrame, brands: DataFrame) -> DataFrame:
    """Claims (run_id, subject, predicate, object, confidence) and those of a second reader that are new.

    A new one speaks of a known brand (``brands``: brand), by its proper name, and differs from all others of the run in more
    than case. Its confidence is held to MOST_CONFIDENCE.
    """
    columns = ["run_id", "subject", "predicate", "object", "confidence"]
    said = ["_s", "_p", "_o"]
    keyed = lambda df: df.select(*columns, F.lower("subject").alias("_s"), F.lower("predicate").alias("_p"), F.lower("object").alias("_o"))
    known = brands.groupBy(F.lower("brand").alias("_s")).agg(F.min("brand").alias("_name"))
    fresh = keyed(judged).join(keyed(claims).select("run_id", *said).distinct(), ["run_id", *said], "left_anti").join(known, "_s")
    added = fresh.select("run_id", F.col("_name").alias("subject"), "predicate", "object", F.least("confidence", F.lit(MOST_CONFIDENCE)).alias("confidence"))
    return claims.select(*columns).unionByName(added)


def accept_outcomes(candidates: DataFrame, identities: DataFrame, domains: DataFrame, own_domains: DataFrame) -> DataFrame:
    """(project_id, candidate_id, outcome) of accepting candidates (project_id, candidate_id, key, domain, status).

    ``identities`` (project_id, key) are the names, aliases and products of the project's competitors, ``domains`` theirs and
    ``own_domains`` the project's own (project_id, domain). The first that holds: already_accepted, domain_missing,
    name_empty, own_domain, domain_taken, name_taken, accepted. Candidates asked for at once that share a name or domain
    count as taken but for the least candidate_id.
    """
    flag = lambda df, on, name: df.select("project_id", on).distinct().withColumn(name, F.lit(True))
    rows = (
        candidates.join(flag(own_domains, "domain", "_own"), ["project_id", "domain"], "left")
        .join(flag(domains, "domain", "_domain"), ["project_id", "domain"], "left")
        .join(flag(identities, "key", "_name"), ["project_id", "key"], "left")
    )
    told = (F.col("status") != "accepted") & (F.coalesce("domain", F.lit("")) != "") & (F.coalesce("key", F.lit("")) != "")
    free = rows.where(told & F.col("_own").isNull() & F.col("_domain").isNull() & F.col("_name").isNull())
    first = lambda on, name: free.groupBy("project_id", on).agg(F.min("candidate_id").alias(name))
    rows = rows.join(first("domain", "_first_domain"), ["project_id", "domain"], "left").join(first("key", "_first_name"), ["project_id", "key"], "left")
    outcome = (
        F.when(F.col("status") == "accepted", "already_accepted")
        .when(F.coalesce("domain", F.lit("")) == "", "domain_missing")
        .when(F.coalesce("key", F.lit("")) == "", "name_empty")
        .when(F.col("_own"), "own_domain")
        .when(F.col("_domain") | (F.col("_first_domain") < F.col("candidate_id")), "domain_taken")
        .when(F.col("_name") | (F.col("_first_name") < F.col("candidate_id")), "name_taken")
        .otherwise("accepted")
    )
    return rows.select("project_id", "candidate_id", outcome.alias("outcome"))


def reject_outcome(status: Column) -> Column:
    """What rejecting a candidate comes to: accepted ones can't be rejected."""
    return F.when(status == "accepted", "conflict").otherwise("rejected")
