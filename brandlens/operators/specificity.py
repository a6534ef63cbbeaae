"""How specific texts are: the share of sentences with a number, a date or a name that the site's own entities have."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators.keywords import keyword_hits

# Where sentences end, numbers and dates in a text, words of a sentence and characters of a name at least, entity types that are products.
SENTENCE_END = r"(?<=[.!?])\s+|\n+"
NUMBER = r"(?<![\w.])\d[\d,.]*(?:%|[kKmMbB])?(?![\w.])"
DATE = r"(?i)\b(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?(?:19|20)\d{2}\b|\b(?:19|20)\d{2}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/(?:19|20)\d{2}\b"
MIN_WORDS, MIN_NAME = 4, 3
PRODUCT_TYPES = ("Product", "Service")


def site_names(entities: DataFrame, pages: DataFrame, organizations: DataFrame) -> DataFrame:
    """site, name: products and services that the site's pages declare, and the organization of the site.

    ``entities`` as of extract_entities, ``pages``: site, page_id, ``organizations``: site, name.
    """
    products = entities.where(F.col("entity_type").isin(*PRODUCT_TYPES)).join(pages.select("site", "page_id"), "page_id").select("site", "name")
    return products.unionByName(organizations.select("site", "name")).where("name IS NOT NULL").distinct()


def specific_shares(pages: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """page_id, sentences, specific, specific_share of pages (site, page_id, text); page_id is unique.

    Sentences have four words at least. A sentence without number and date is specific if it holds a name of its site
    (site, name) of three characters or more, in any case: all names of all sites are looked for in one pass, and sites
    meet by an equi-join after. A page without sentences has a share of 0.
    """
    said = F.filter(F.split(F.coalesce("text", F.lit("")), SENTENCE_END), lambda s: F.size(F.filter(F.split(s, r"\s+"), lambda w: w != "")) >= MIN_WORDS)
    if names is None:
        counted = pages.select("page_id", F.size(said).alias("sentences"), F.size(F.filter(said, lambda s: s.rlike(NUMBER) | s.rlike(DATE))).alias("specific"))
    else:
        rows = pages.select("site", "page_id", F.posexplode_outer(said).alias("n", "sentence"))
        rows = rows.withColumn("plain", F.col("sentence").isNotNull() & ~(F.col("sentence").rlike(NUMBER) | F.col("sentence").rlike(DATE)))
        wanted = names.select("site", F.lower("name").alias("keyword")).where(F.length("keyword") >= MIN_NAME).distinct()
        place = F.struct("site", "page_id", "n").alias("text_id")
        hits = keyword_hits(rows.where("plain").select(place, F.lower("sentence").alias("text")), wanted).select("text_id.*", "keyword")
        named = hits.join(wanted, ["site", "keyword"], "left_semi").select("page_id", "n").distinct().groupBy("page_id").agg(F.count("*").alias("named"))
        counts = rows.groupBy("page_id").agg(F.count("sentence").cast("int").alias("sentences"), F.count_if(F.col("sentence").isNotNull() & ~F.col("plain")).alias("other"))
        counted = counts.join(named, "page_id", "left").select("page_id", "sentences", (F.col("other") + F.coalesce("named", F.lit(0))).cast("int").alias("specific"))
    return counted.withColumn("specific_share", F.coalesce(F.try_divide(F.col("specific"), F.col("sentences")), F.lit(0.0)))
