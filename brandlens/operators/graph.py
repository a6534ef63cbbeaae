"""Questions over the citation graph: sources, prompts, claims, competitors, and a bounded subgraph."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

DEFAULT_LIMIT, MOST = 50, 200
#: Candidates for the rising view: the most cited domains.
RISING_CANDIDATES = 400


def domain_counts(cited: DataFrame) -> DataFrame:
    """Per project and domain: citations, responses, prompts, relationship counts, first and last time."""
    return cited.groupBy("project_id", "domain_id").agg(
        F.count("*").alias("citations"),
        F.countDistinct("run_id").alias("responses"),
        F.countDistinct("prompt_id").alias("prompts"),
        F.count_if("is_brand").alias("brand_citations"),
        F.count_if("is_competitor").alias("competitor_citations"),
        F.min("cited_at").alias("first_cited_at"),
        F.max("cited_at").alias("last_cited_at"),
    )


def limited(df: DataFrame, order: list[Column], limit: int = DEFAULT_LIMIT, offset: int = 0) -> DataFrame:
    """The first rows of each project in this order; a page of at most MOST rows."""
    limit = max(1, min(limit, MOST))
    rank = F.row_number().over(Window.partitionBy("project_id").orderBy(*order))
    return df.withColumn("rank", rank).where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def sources(cited: DataFrame, domains: DataFrame, view: str = "top", limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Most cited sources; view: top, competitor (cited for competitors) or gap (for competitors at least three times as often)."""
    c, b = F.col("competitor_citations"), F.col("brand_citations")
    counts = domain_counts(cited).join(domains, "domain_id")
    if view == "competitor":
        counts, order = counts.where(c > 0), [F.desc("competitor_citations"), F.desc("citations"), F.col("domain")]
    elif view == "gap":
        counts, order = counts.where((c >= 3) & (c >= 3 * b)), [F.desc(c - b), F.desc("citations"), F.col("domain")]
    else:
        order = [F.desc("citations"), F.desc("responses"), F.col("domain")]
    share = F.bround(F.try_divide(c, F.col("citations")), 3)
    return limited(counts, order, limit).select(
        "project_id", "rank", "domain", "domain_type", "citations", "responses", "prompts", "brand_citations", "competitor_citations", share.alias("competitor_share"), F.bround(F.try_divide(b, F.nullif(c, F.lit(0))), 3).alias("brand_ratio"), "first_cited_at", "last_cited_at"
    )


def rising(cited_both: DataFrame, start: Column, domains: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Growth of citations of this window over the one before, of domains cited at least 3 times and more than before."""
    g = cited_both.groupBy("project_id", "domain_id").agg(F.count_if(F.col("cited_at") >= start).alias("citations"), F.count_if(F.col("cited_at") < start).alias("previous"))
    g = g.where("citations > 0").join(domains, "domain_id")
    most_cited = F.row_number().over(Window.partitionBy("project_id").orderBy(F.desc("citations"), "domain"))
    candidates = g.withColumn("place", most_cited).where(F.col("place") <= RISING_CANDIDATES)
    growth = F.bround((F.col("citations") - F.col("previous")) / F.greatest(F.col("previous"), F.lit(1)), 3)
    kept = candidates.where((F.col("citations") >= 3) & (F.col("citations") > F.col("previous"))).withColumn("growth", growth)
    return limited(kept, [F.desc("growth"), F.desc("citations"), F.col("domain")], limit).select("project_id", "rank", "domain", "citations", "previous", "growth")


def top_pages(cited: DataFrame, k: int = 3) -> DataFrame:
    """The k most cited pages of every domain."""
    g = cited.groupBy("project_id", "domain_id", "page_id").agg(F.count("*").alias("citations"))
    w = Window.partitionBy("project_id", "domain_id").orderBy(F.desc("citations"), "page_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def top_sources(cited: DataFrame, key: str, k: int = 5) -> DataFrame:
    """The k domains that each value of ``key`` (a competitor, a prompt) is cited from most, ties to the smaller domain."""
    g = cited.groupBy("project_id", key, "domain_id").agg(F.count("*").alias("citations"))
    w = Window.partitionBy("project_id", key).orderBy(F.desc("citations"), "domain_id")
    return g.withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= k)


def listed(df: DataFrame, keys: list[str], order: list[Column], limit: int, offset: int = 0) -> DataFrame:
    """A page of every group's rows in order, with rank and the group's total; both are the listing's own limits."""
    w = Window.partitionBy(*keys)
    ranked = df.withColumn("rank", F.row_number().over(w.orderBy(*order))).withColumn("total", F.count("*").over(w))
    return ranked.where((F.col("rank") > offset) & (F.col("rank") <= offset + limit))


def entity_counts(cited: DataFrame) -> DataFrame:
    """Per domain, how often each competitor is cited from it."""
    return cited.where("is_competitor").groupBy("project_id", "domain_id", "competitor").agg(F.count("*").alias("citations"))


def entity_map(cited: DataFrame) -> DataFrame:
    """The same as one map per domain."""
    g = entity_counts(cited).groupBy("project_id", "domain_id")
    return g.agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("competitor", "citations")))).alias("competitors"))


def prompts_by_competitors(cited: DataFrame, observations: DataFrame, limit: int = DEFAULT_LIMIT) -> DataFrame:
    """Prompts whose answers cite and mention competitors most; each side is aggregated before the join."""
    per_prompt = observations.groupBy("project_id", "prompt_id").agg(F.count("*").alias("responses"), F.count_if("brand_mentioned").alias("brand_mentions"), F.sum(F.size("competitors")).alias("competitor_mentions"))
    cites = cited.groupBy("project_id", "prompt_id").agg(F.count_if("is_competitor").alias("competitor_citations"), F.count_if("is_brand").alias("brand_citations"))
    joined = per_prompt.join(cites, ["project_id", "prompt_id"], "left").na.fill(0, ["competitor_citations", "brand_citations"])
    order = [F.desc("competitor_citations"), F.desc("competitor_mentions"), F.desc("responses"), F.col("prompt_id")]
    return limited(joined, order, limit)


def claims(stated: DataFrame, brand: str, rivals: Sequence[str], least: int = 2) -> DataFrame:
    """Repeated triples of ``stated`` (project_id, prompt_id, run_id, subject, predicate, object, confidence, context, claimed_at)
    on their normalised form: occurrences, responses, prompts, mean confidence, an example, last time and whom they are about.

    A claim is about the brand if its subject holds the brand's name, about a competitor if it holds one of theirs, else other.
    """
    key = lambda c: F.lower(F.trim(c)).alias(c)
    triple = stated.select("project_id", "prompt_id", "run_id", key("subject"), key("predicate"), key("object"), "confidence", "context", "claimed_at")
    g = triple.groupBy("project_id", "subject", "predicate", "object").agg(
        F.count("*").alias("occurrences"), F.countDistinct("run_id").alias("responses"), F.countDistinct("prompt_id").alias("prompts"), F.bround(F.avg("confidence"), 3).alias("confidence"), F.min("context").alias("example"), F.max("claimed_at").alias("last_at")
    )
    holds = lambda names: reduce(lambda a, b: a | b, [F.col("subject").contains(n.lower()) for n in names], F.lit(False))
    return g.where(F.col("occurrences") >= least).withColumn("association", F.when(holds([brand]), "brand").when(holds(rivals), "competitor").otherwise("other"))


def co_mentions(observations: DataFrame) -> DataFrame:
    """Per competitor: responses that mention it, and those that mention the brand too."""
    rows = observations.select("project_id", "run_id", "prompt_id", "brand_mentioned", F.explode("competitors").alias("competitor"))
    return rows.groupBy("project_id", "competitor").agg(F.count("*").alias("mentions"), F.count_if("brand_mentioned").alias("with_brand"), F.countDistinct("prompt_id").alias("prompts"))


def statistics(eligible: DataFrame) -> DataFrame:
    """Per project: responses, prompts and provider/model pairs."""
    return eligible.groupBy("project_id").agg(F.count("*").alias("responses"), F.countDistinct("prompt_id").alias("prompts"), F.countDistinct("provider", "model").alias("models"))


def edges(cited: DataFrame, observations: DataFrame, k: int = 10) -> DataFrame:
    """Edges of the bounded overview: prompt-source (cites) of the k sources with most citations, and brand-competitor (competes_with)."""
    top = limited(domain_counts(cited), [F.desc("citations"), F.col("domain_id")], k).select("project_id", "domain_id")
    cites = cited.join(top, ["project_id", "domain_id"]).groupBy("project_id", "prompt_id", "domain_id").agg(F.count("*").alias("weight"))
    rivals = co_mentions(observations)
    return cites.select("project_id", F.lit("cites").alias("kind"), F.concat(F.lit("prompt:"), F.col("prompt_id").cast("string")).alias("src"), F.concat(F.lit("source:"), F.col("domain_id").cast("string")).alias("dst"), "weight").unionByName(
        rivals.where("with_brand > 0").select("project_id", F.lit("competes_with").alias("kind"), F.lit("brand").alias("src"), F.col("competitor").alias("dst"), F.col("with_brand").alias("weight"))
    )
