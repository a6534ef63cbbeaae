"""Readiness of whole sites for AI answers, and reviews of single pages, from page snapshots and their entities."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from brandlens.operators.site_audit import QUESTION, SIGNALS, SPECIFICITY_TARGET, page_kinds, path_of, readiness_score, site_of
from brandlens.operators.specificity import specific_shares

# What a text says about audience, places, offers, authors and evidence.
PATTERNS = {
    "audience": r"(?i)\b(?:(?:built|designed|made|created|ideal|perfect|tailored)\s+for|for\s+(?:small|mid-?size|large|growing|modern|busy|independent)?\s*(?:businesses|companies|teams|startups|enterprises?|agencies|developers|marketers|founders|freelancers|schools|clinics|restaurants|retailers|manufacturers|nonprofits|professionals|organizations|organisations|brands|shops|stores|hotels|hospitals|dentists|lawyers|accountants|families|students|parents|homeowners|patients|engineers|designers|consultants|sales\s+teams|hr\s+teams|finance\s+teams|product\s+teams)|who\s+(?:it'?s|is\s+it)\s+for|trusted\s+by|used\s+by|customers?\s+(?:include|like)|our\s+(?:customers|clients)\s+are)\b",
    "geography": r"(?i)\b(?:(?:based|headquartered|located|founded|offices?)\s+in|serving|we\s+serve|available\s+in|ship(?:ping|s)?\s+to|operat(?:e|ing)\s+in|worldwide|globally|nationwide|international(?:ly)?|across\s+(?:the\s+)?(?:us|usa|uk|eu|europe|north\s+america|asia|australia|canada|africa|latin\s+america|\d+\s+countries)|in\s+\d+\s+countries)\b",
    "phone": r"(?<![\w/(])\(?\+?\d[\d\s().-]{6,20}\d(?![\w/])",
    "features": r"(?i)\b(features?|capabilities|what(?:'s| is) included|what you get|benefits|how it works|key\s+functions|functionality)\b",
    "use_cases": r"(?i)\b(use\s?cases?|how\s+(?:teams|companies|customers|people)\s+use|used\s+to|helps?\s+you|so\s+you\s+can|scenarios?|examples?\s+of\s+use|workflows?)\b",
    "integrations": r"(?i)\b(integrat(?:e|es|ed|ion|ions)|works\s+with|connects?\s+(?:to|with)|plugs?\s+into|\bapi\b|webhooks?|zapier|slack|salesforce|hubspot|shopify|wordpress|sync(?:s|ing)?\s+with)\b",
    "author_bio": r"(?i)\b(about\s+the\s+author|author\s+bio|written\s+by|reviewed\s+by|fact[- ]checked\s+by)\b",
    "credentials": r"(?i)\b(ph\.?d|m\.?d\.?|mba|cpa|cfa|rn|esq|professor|ceo|cto|cfo|coo|founder|co-founder|director|head\s+of|engineer|scientist|researcher|certified|licensed|years?\s+of\s+experience|specialist|expert\s+in)\b",
    "date": r"(?i)\b(?:\d{1,2}\s+)?(?:jan|feb|mar|apr|may|jun|jul|aug|sep|sept|oct|nov|dec)[a-z]*\.?\s+(?:\d{1,2},?\s+)?(?:19|20)\d{2}\b|\b(?:19|20)\d{2}-\d{2}-\d{2}\b|\b\d{1,2}/\d{1,2}/(?:19|20)\d{2}\b",
    "original_data": r"(?i)\b(our\s+(?:data|research|study|survey|analysis|benchmark|findings)|we\s+(?:analy[sz]ed|surveyed|measured|tested|studied|tracked|collected)|internal\s+data|proprietary\s+data|based\s+on\s+\d[\d,]*\s+(?:customers|users|companies|respondents|data\s+points|sites|pages))\b",
    "customer_evidence": r"(?i)\b(testimonials?|reviews?|rated\s+\d|\d(?:\.\d)?\s*/\s*5|★|stars?\b|trusted\s+by|customers?\s+(?:say|love|report)|what\s+(?:our\s+)?(?:customers|clients|users)\s+say|g2|capterra|trustpilot|clutch)\b",
    "faq": r"(?i)\b(faq|faqs|frequently\s+asked|questions?\s*(?:&|and)\s*answers?|q\s*&\s*a)\b",
}
COMPARISON = r"(?i)\bvs\.?\b|versus|\bcompar(e|ison)|alternatives?\b"
MIN_PRODUCT_WORDS, MIN_ABOUT_WORDS, THIN_WORDS = 80, 50, 150
# Words that say little, and claims that need support.
VAGUE_TERMS = "powerful best-in-class world-class cutting-edge state-of-the-art next-generation revolutionary seamless robust innovative industry-leading leading game-changing".split()
UNSUPPORTED = ("fastest", "cheapest", "#1", "number one", "most popular", "guarantee")


def page_aspects(snapshot: DataFrame, types: DataFrame | None = None, names: DataFrame | None = None) -> DataFrame:
    """Per page every boolean the site analyzers read. ``types``: page_id, schema_types (array) from structured data;
    ``names``: site, name of the sites' own entities."""
    pages = snapshot if types is None else snapshot.join(types, "page_id", "left")
    kinds_of = F.coalesce("schema_types", F.expr("cast(array() as array<string>)")) if types is not None else F.expr("cast(array() as array<string>)")
    text = F.coalesce("text", F.lit(""))
    headings = F.array_join(F.transform("headings", lambda h: h["text"]), "\n")
    says = lambda name, where=text: where.rlike(PATTERNS.get(name) or SIGNALS[name])
    questions = F.size(F.filter("headings", lambda h: h["text"].rlike(QUESTION)))
    host = site_of(F.col("url"))
    shares = specific_shares(snapshot.select(host.alias("site"), "page_id", "text"), names).select("page_id", F.col("specific_share").alias("specific_ratio"))
    pages = pages.join(shares, "page_id")
    away = lambda url: (F.lower(site_of(url)) != F.lower(host)) & ~F.lower(site_of(url)).endswith(F.concat(F.lit("."), F.lower(host)))
    columns = {
        "site": host,
        "kinds": page_kinds(F.col("url")),
        "words": F.col("words"),
        "title": F.col("title"),
        "has_schema_org": F.arrays_overlap(kinds_of, F.array(F.lit("Organization"), F.lit("Corporation"), F.lit("LocalBusiness"))),
        "has_schema_product": F.arrays_overlap(kinds_of, F.array(F.lit("Product"), F.lit("Service"))),
        "has_schema_faq": F.array_contains(kinds_of, "FAQPage"),
        "long_description": F.coalesce(F.size(F.split("description", r"\s+")) >= 8, F.lit(False)),
        "offering_heading": says("features", headings) | F.lower(headings).rlike("product|service|solution"),
        "name": F.col("h1").isNotNull() & (F.col("h1") != ""),
        "described": F.col("words") >= MIN_PRODUCT_WORDS,
        "features": says("features", headings),
        "use_cases": says("use_cases", headings) | says("use_cases"),
        **{n: says(n) for n in ("audience", "geography", "phone", "email", "pricing", "integrations", "statistic", "research", "original_data", "citation", "case_study", "customer_evidence", "byline", "author_bio")},
        "credentials": says("credentials", F.substring(text, 1, 3000)),
        "published": says("date", F.substring(text, 1, 1500)),
        "modified": F.coalesce(F.try_element_at("meta", F.lit("article:modified_time")), F.try_element_at("meta", F.lit("og:updated_time"))).isNotNull() | F.substring(text, 1, 1500).rlike(r"(?i)\b(last\s+)?(updated|modified|reviewed)\s*(on|:)?\s"),
        "faq_content": says("faq", headings) | (questions >= 3),
        "references": F.exists("links", lambda x: F.coalesce(x["target"].rlike("^https?://") & away(x["target"]), F.lit(False)) & ~x["rel"].contains("nofollow") & ~x["href"].contains("social")),
        "comparison": F.coalesce(F.concat_ws(" ", "title", "h1").rlike(COMPARISON), F.lit(False)) | path_of(F.col("url")).rlike("(?i)compare|/vs-|alternatives"),
        "specific_ratio": F.col("specific_ratio"),
        "few_headings": F.size("headings") < 2,
    }
    return pages.select("page_id", *[c.alias(n) for n, c in columns.items()])


def site_readiness(aspects: DataFrame, conflicts_per_site: DataFrame | None = None) -> DataFrame:
    """Per site the value of each category (null where it doesn't apply) and the score; one aggregation.

    Product clarity and authority are mean shares of aspects over the site's product and article pages.
    """
    is_a = lambda *kinds: F.arrays_overlap("kinds", F.array(*[F.lit(k) for k in kinds]))
    product, article = is_a("product", "service"), is_a("article")
    any_of = lambda c: F.bool_or(c)
    share = lambda flag, where: F.avg(F.when(where, flag.cast("double")))
    key_text = is_a("home", "about", "contact")
    product_aspects = ["name", "described", "features", "pricing", "use_cases", "audience", "integrations"]
    author_aspects = ["byline", "author_bio", "has_schema_org", "credentials", "published", "modified"]
    content = F.col("words") >= 50
    evidence = ["statistic", "research", "original_data", "citation", "case_study", "customer_evidence", "references"]
    entity_checks = [
        any_of(F.col("has_schema_org") | (is_a("home") & F.contains(F.lower(F.coalesce("title", F.lit(""))), F.regexp_extract("site", r"([^.]+)\.[^.]+$", 1)))),
        any_of((is_a("home") & F.col("long_description")) | (is_a("about") & (F.col("words") >= MIN_ABOUT_WORDS))),
        any_of(product | F.col("has_schema_product") | F.col("offering_heading")),
        any_of(F.col("audience") & (is_a("home") | product)),
        any_of(F.col("geography") & key_text),
        any_of(is_a("contact") | ((F.col("email") | F.col("phone")) & key_text)),
    ]
    mean = lambda columns: reduce(lambda a, b: a + b, columns) / float(len(columns))
    g = aspects.groupBy("site").agg(
        F.count("*").alias("pages"),
        mean([c.cast("double") for c in entity_checks]).alias("entity_clarity"),
        mean([share(F.col(a), product) for a in product_aspects]).alias("product_clarity"),
        mean([share(F.col(a), article) for a in author_aspects]).alias("authority"),
        F.when(F.count_if(content) > 0, mean([F.bool_or((F.col(k) & content) | (F.lit(k == "case_study") & is_a("case_study"))).cast("double") for k in evidence])).alias("evidence"),
        F.avg(F.when(content, F.col("specific_ratio"))).alias("specific"),
        F.coalesce(share(F.col("words") < THIN_WORDS, product | article), F.lit(0.0)).alias("thin"),
        F.avg(((F.col("words") >= 300) & F.col("few_headings")).cast("double")).alias("unstructured"),
        F.when(F.bool_or(F.col("faq_content") | F.col("has_schema_faq")), 0.5 * F.bool_or("faq_content").cast("double") + 0.5 * F.bool_or("has_schema_faq").cast("double")).alias("faq"),
        F.count_if("comparison").alias("comparison_pages"),
    )
    structure = 0.6 * F.least(F.lit(1.0), F.col("specific") / SPECIFICITY_TARGET) + 0.2 * (1 - F.col("thin")) + 0.2 * (1 - F.col("unstructured"))
    g = g.withColumn("content_structure", structure)
    if conflicts_per_site is not None:
        g = g.join(conflicts_per_site, "site", "left").withColumn("factual_consistency", F.when(F.col("entities") > 0, F.greatest(F.lit(0.0), 1.0 - F.col("conflicts") / F.col("entities"))))
    else:
        g = g.withColumn("factual_consistency", F.lit(None).cast("double"))
    names = ["entity_clarity", "product_clarity", "authority", "evidence", "content_structure", "faq", "factual_consistency"]
    return g.select("site", "pages", *[F.bround(c, 4).alias(c) for c in names], "comparison_pages", readiness_score({c: F.col(c) for c in names}).alias("score"))


def page_reviews(snapshot: DataFrame, brand: Column, unanswered: Column | None = None, has_organization: Column | None = None) -> DataFrame:
    """Per page the deductions of a content review and its score, never below 0.

    15 for related prompts it doesn't answer, 10 for a missing who / for whom / identity, 5 for each vague and each
    unsupported sentence up to three. Pages of fewer than 200 characters aren't reviewed.
    """
    text = F.coalesce("text", F.lit(""))
    low = F.lower(text)
    found = F.array_distinct(F.transform(F.regexp_extract_all(text, F.lit(r"([^.!?\n]{20,300}[.!?])"), F.lit(1)), lambda s: F.lower(F.trim(s))))
    any_in = lambda s, terms: reduce(lambda a, b: a | b, [s.contains(t) for t in terms])
    vague = F.size(F.filter("_said", lambda s: any_in(s, VAGUE_TERMS)))
    unsupported = F.size(F.filter("_said", lambda s: any_in(s, UNSUPPORTED) | s.rlike(r"\b\d{2,}%")))
    unclear = ~F.substring(low, 1, 1500).contains(F.lower(brand)) | ~low.rlike("for |designed for|built for|serves") | ~(has_organization if has_organization is not None else F.lit(False))
    rows = snapshot.where(F.length(text) >= 200).withColumn("_said", found)
    three = F.lit(3)
    return rows.select("page_id", (F.coalesce(unanswered, F.lit(0)) if unanswered is not None else F.lit(0)).alias("unanswered"), unclear.alias("unclear"), F.least(vague, three).alias("vague"), F.least(unsupported, three).alias("unsupported")).withColumn(
        "score", F.greatest(F.lit(0), 100 - F.when(F.col("unanswered") > 0, 15).otherwise(0) - F.when(F.col("unclear"), 10).otherwise(0) - 5 * F.col("vague") - 5 * F.col("unsupported"))
    )
