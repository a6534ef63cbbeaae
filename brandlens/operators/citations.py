"""Citations resolved to hosts, pages and the entities that they speak of; stored classifications."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.functions.names import slug_text
from brandlens.functions.urls import host_suffixes, normalize_host

EXACT_HOST, SUBDOMAIN, SLUG = 0.95, 0.8, 0.7


def cited_host(citations: DataFrame) -> Column:
    """The host of a citation: that of its domain, else of its address; null if neither has one."""
    return F.coalesce(normalize_host(F.col("domain")), normalize_host(F.col("url")))


def relationships(citations: DataFrame, entities: DataFrame) -> DataFrame:
    """citation_id, entity_type, entity_name, confidence: whom a citation speaks of, by clear evidence alone.

    ``citations``: citation_id, project_id, domain, url, anchor; ``entities``: project_id, entity_type (brand or competitor),
    entity_name, host. A cited host that is the entity's own counts 0.95, one under it 0.8. Only where a citation is on nobody's own
    site, names of at least three characters that stand as whole words in its path, query or anchor count 0.7. The more
    exact host wins for an entity of several. Host tests are equi-joins on the parents of the host; name tests join by the
    first word of the name.
    """
    placed = citations.select("citation_id", "project_id", cited_host(citations).alias("cited"), "url", "anchor").where("cited IS NOT NULL")
    known = entities.select("project_id", "entity_type", "entity_name", normalize_host(F.col("host")).alias("host"))
    parents = placed.select("citation_id", "project_id", "cited", F.explode(host_suffixes(F.col("cited"))).alias("host"))
    own = parents.join(known, ["project_id", "host"]).groupBy("citation_id", "entity_type", "entity_name").agg(F.max(F.when(F.col("cited") == F.col("host"), EXACT_HOST).otherwise(SUBDOMAIN)).alias("confidence"))
    names = known.select("project_id", "entity_type", "entity_name", F.trim(F.regexp_replace(F.lower("entity_name"), r"[^a-z0-9]+", " ")).alias("token")).where("length(token) >= 3").distinct().withColumn("word", F.split_part("token", F.lit(" "), F.lit(1)))
    slugs = placed.join(own.select("citation_id").distinct(), "citation_id", "left_anti").select("citation_id", "project_id", slug_text(F.col("url"), F.col("anchor")).alias("slug"))
    words = slugs.withColumn("word", F.explode(F.array_distinct(F.split(F.trim("slug"), " "))))
    said = words.join(names, ["project_id", "word"]).where(F.contains("slug", F.concat(F.lit(" "), "token", F.lit(" "))))
    return own.unionByName(said.select("citation_id", "entity_type", "entity_name", F.lit(SLUG).alias("confidence")).distinct())


def resolve(citations: DataFrame, entities: DataFrame) -> DataFrame:
    """Citations with host, is_brand, is_competitor and the competitors they speak of; those without a host are left out.

    Relationships are gathered to the citation before they join, so a citation stays one row.
    """
    found = relationships(citations, entities).groupBy("citation_id").agg(
        F.bool_or(F.col("entity_type") == "brand").alias("is_brand"),
        F.bool_or(F.col("entity_type") == "competitor").alias("is_competitor"),
        F.array_sort(F.collect_set(F.when(F.col("entity_type") == "competitor", F.col("entity_name")))).alias("competitors"),
    )
    hosted = citations.withColumn("host", cited_host(citations)).where("host IS NOT NULL").join(found, "citation_id", "left")
    no = F.lit(False)
    return hosted.withColumns({"is_brand": F.coalesce("is_brand", no), "is_competitor": F.coalesce("is_competitor", no), "competitors": F.coalesce("competitors", F.expr("cast(array() AS array<string>)"))})


def stored_classification(stored: DataFrame, fresh: DataFrame) -> DataFrame:
    """host, domain_type, confidence after a new classification: a known type never becomes unknown, another known type
    replaces it, and the same type only with at least the confidence it had. Hosts of either side are kept."""
    s, f = stored.select("host", F.col("domain_type").alias("s_type"), F.col("confidence").alias("s_sure")), fresh.select("host", F.col("domain_type").alias("f_type"), F.col("confidence").alias("f_sure"))
    was, now = F.coalesce("s_type", F.lit("unknown")), F.coalesce("f_type", F.lit("unknown"))
    takes = ((now != "unknown") | (was == "unknown")) & ((now != was) | (F.coalesce("f_sure", F.lit(0.0)) >= F.coalesce("s_sure", F.lit(0.0))))
    kind = F.when(takes, now).otherwise(was)
    sure = F.when(takes, F.when(now != "unknown", F.col("f_sure"))).otherwise(F.col("s_sure"))
    return s.join(f, "host", "full").select("host", kind.alias("domain_type"), sure.alias("confidence"))


def unmentioned(mentioned: DataFrame, configured: DataFrame) -> DataFrame:
    """Counts of mentioned competitors (project_id, competitor, mentions), and configured ones that nobody mentions with 0."""
    missing = configured.select("project_id", "competitor").distinct().join(mentioned, ["project_id", "competitor"], "left_anti")
    return mentioned.select("project_id", "competitor", "mentions").unionByName(missing.withColumn("mentions", F.lit(0).cast("bigint")))
