"""Rule layers over aggregated facts: why competitors win (insights), what changed (alerts), and content gaps."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions import ladders as L
from brandlens.functions.names import page_categories
from brandlens.operators.gaps import is_commercial
from brandlens.operators.keywords import keyword_hits
from brandlens.sources.projection import BRAND

MIN_RESPONSES = 10
CONTENT_CATEGORIES = ("comparison", "product", "faq", "use_case", "educational")


def confidence(sample: Column, supporting: Column) -> Column:
    return F.when((sample >= 50) & (supporting >= 20), "high").when((sample >= 20) & (supporting >= 5), "medium").otherwise("low")


def impact(ratio: Column) -> Column:
    return F.when(ratio >= 3, "high").when(ratio >= 1.5, "medium").otherwise("low")


def ratio(rival: Column, brand: Column) -> Column:
    return F.coalesce(F.try_divide(rival.cast("double"), F.nullif(brand, F.lit(0).cast("double"))), rival.cast("double"))


def entity_footprint(cited: DataFrame, domains: DataFrame, page_category: Column) -> DataFrame:
    """Per project and entity (brand and competitors): citing domains, citations, research domains, claims, pages by category."""
    entity = F.explode(F.filter(F.array(F.when(F.col("is_brand"), F.lit(BRAND)), F.when(F.col("is_competitor"), F.col("competitor"))), lambda x: x.isNotNull()))
    rows = cited.select("project_id", "domain_id", "page_id", "strength", entity.alias("entity")).join(domains.select("domain_id", "domain_type"), "domain_id").withColumn("page_category", page_category)
    research = F.col("domain_type") == "research"
    return rows.groupBy("project_id", "entity").agg(
        F.countDistinct("domain_id").alias("citing_domains"),
        F.count("*").alias("citation_rows"),
        F.countDistinct(F.when(research, F.col("domain_id"))).alias("research_domains"),
        F.count_if(research).alias("research_citations"),
        F.count_if(F.col("strength") == "strong").alias("specifics"),
        *[F.countDistinct(F.when(F.col("page_category") == c, F.col("page_id"))).alias(f"pages_{c}") for c in CONTENT_CATEGORIES],
    )


def competitor_facts(metrics: DataFrame, footprint: DataFrame, totals: DataFrame) -> DataFrame:
    """One row per project and competitor with its facts (c_*), the brand's (b_*), and the project's totals."""
    counts = [c for c in footprint.columns if c not in ("project_id", "entity")]
    facts = metrics.join(footprint, ["project_id", "entity"], "left").na.fill(0, counts)
    keep = ["score", "mentions", "prompts_appearing", "recommendation_share", "average_position", *counts]
    side = lambda df, p: df.select("project_id", *[F.col(c).alias(f"{p}_{c}") for c in keep], *(["sample_size", F.col("entity").alias("competitor")] if p == "c" else []))
    return side(facts.where(F.col("entity") != BRAND), "c").join(side(facts.where(F.col("entity") == BRAND), "b"), "project_id").join(totals, "project_id")


def insights(facts: DataFrame) -> DataFrame:
    """project_id, competitor, insight_type, confidence, impact, strength: six rules, none below the least sample."""
    facts = facts.where(F.col("sample_size") >= MIN_RESPONSES)
    c, b = (lambda n: F.col(f"c_{n}")), (lambda n: F.col(f"b_{n}"))
    n = F.col("sample_size")
    at_least_one = lambda x: F.greatest(x, F.lit(1))

    def rule(name: str, holds: Column, supporting: Column, r: Column, strength: Column) -> Column:
        found = F.struct(F.lit(name).alias("insight_type"), confidence(n, supporting).alias("confidence"), impact(r).alias("impact"), F.bround(F.least(F.lit(100.0), strength), 1).alias("strength"))
        return F.when(holds, found)

    domains = ratio(c("citing_domains"), b("citing_domains"))
    coverage = ratio(c("prompts_appearing"), b("prompts_appearing"))
    pages = lambda side: sum((side(f"pages_{k}") for k in CONTENT_CATEGORIES), F.lit(0))
    leads = sum(((c(f"pages_{k}") > b(f"pages_{k}")).cast("int") for k in CONTENT_CATEGORIES), F.lit(0))
    content = ratio(pages(c), pages(b))
    rec = c("recommendation_share") - b("recommendation_share")
    better = F.coalesce(b("average_position") - c("average_position") >= 0.5, F.lit(False))
    position = ratio(c("recommendation_share"), b("recommendation_share"))
    position = F.when(better & (rec >= 15), F.greatest(position, F.lit(1.5))).otherwise(position)
    research = (c("research_domains") >= 2) & (c("research_domains") > b("research_domains"))
    specific = (c("specifics") >= 5) & (c("specifics") >= 2 * at_least_one(b("specifics")))
    evidence = F.greatest(ratio(c("research_domains"), b("research_domains")), ratio(c("specifics"), b("specifics")))
    rules = [
        rule("citation_advantage", (c("citing_domains") >= 5) & (c("citing_domains") >= b("citing_domains") + 4) & (c("citing_domains") >= 1.5 * at_least_one(b("citing_domains"))), c("citation_rows"), domains, 20.0 * domains),
        rule("content_advantage", (pages(c) >= 3) & (leads >= 2), pages(c), content, 20.0 * content),
        rule("coverage_advantage", (F.col("total_prompts") >= 3) & (c("prompts_appearing") >= b("prompts_appearing") + 2) & (c("prompts_appearing") >= 1.4 * at_least_one(b("prompts_appearing"))), c("mentions"), coverage, 25.0 * coverage),
        rule("positioning_advantage", rec.isNotNull() & ((rec >= 15) | better), c("mentions"), position, rec + F.when(better, 20.0).otherwise(0.0)),
        rule("evidence_advantage", research | specific, c("research_citations") + c("specifics"), evidence, 10.0 * (c("research_domains") + c("specifics"))),
    ]
    # one pass: each row makes the array of what holds for it
    return facts.select("project_id", "competitor", F.explode(F.array_compact(F.array(*rules))).alias("i")).select("project_id", "competitor", "i.*")


def entity_insights(facts: DataFrame, profiles: DataFrame) -> DataFrame:
    """The sixth rule: the competitor scores 10 points more while the brand's own markup has two gaps; at most medium confidence."""
    gaps = sum(
        (
            g.cast("int")
            for g in (
                ~F.col("has_organization"),
                F.col("has_organization") & ~F.col("has_description"),
                F.col("products") == 0,
                F.col("same_as_links") == 0,
                F.col("organization_names") > 1,
            )
        ),
        F.lit(0),
    )
    rows = facts.join(profiles, "project_id").withColumn("gaps", gaps)
    holds = (F.col("sample_size") >= MIN_RESPONSES) & (F.col("c_score") - F.col("b_score") >= 10) & (F.col("pages_crawled") > 0) & (F.col("gaps") >= 2)
    level = F.when(F.col("sample_size") >= 20, "medium").otherwise("low")
    return rows.where(holds).select("project_id", "competitor", F.lit("entity_advantage").alias("insight_type"), level.alias("confidence"), "gaps")


@dataclass(frozen=True)
class AlertThresholds:
    brand_drop_points: float = 10.0
    competitor_jump_points: float = 15.0
    overtake_margin_points: float = 5.0
    citation_gap_increase_points: float = 15.0
    min_responses: int = 10
    new_source_min_citations: int = 2
    new_competitor_min_confidence: float = 0.4
    content_gap_min_score: float = 60.0


_NEXT = {"low": "medium", "medium": "high", "high": "critical", "critical": "critical"}


def escalate(base: str, magnitude: Column, threshold: float) -> Column:
    return F.when(magnitude >= 2 * threshold, F.lit(_NEXT[base])).otherwise(F.lit(base))


def fingerprint(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *[p.cast("string") for p in parts]), 256), 1, 12)


def period_measures(views: DataFrame) -> DataFrame:
    """One row per project and entity with both periods' raw shares (two decimals) and scores; ``period`` is set on the input."""
    from brandlens.operators.competitive import entity_metrics

    score = entity_metrics(views, ["project_id", "period"]).select("project_id", "period", "entity", "score", "sample_size", F.bround(L.share(F.col("mentions"), F.col("sample_size")), 2).alias("share"), F.bround(L.share(F.col("cited_responses"), F.col("sample_size")), 2).alias("cited"))
    of = lambda period, c: F.max(F.when(F.col("period") == period, F.col(c)))
    return score.groupBy("project_id", "entity").agg(*[of(p, c).alias(f"{c}_{p[0]}") for p in ("current", "previous") for c in ("score", "share", "cited", "sample_size")])


def period_alerts(measures: DataFrame, t: AlertThresholds = AlertThresholds()) -> DataFrame:
    """project_id, alert_type, subject, magnitude, severity, fingerprint of the four two-period rules."""
    enough = (F.col("sample_size_c") >= t.min_responses) & (F.col("sample_size_p") >= t.min_responses)
    m = measures.where(enough)
    brand = m.where(F.col("entity") == BRAND)
    rows = m.join(brand.select("project_id", *[F.col(f"{c}_{p}").alias(f"b_{c}_{p}") for c in ("score", "cited") for p in "cp"]), "project_id")

    def rule(holds: Column, name: str, magnitude: Column, base: str, threshold: float, a: Column, b: Column) -> Column:
        mark = fingerprint(F.rint(a).cast("int"), F.rint(b).cast("int"))
        return F.when(holds, F.struct(F.lit(name).alias("alert_type"), F.bround(magnitude, 2).alias("magnitude"), escalate(base, magnitude, threshold).alias("severity"), mark.alias("fingerprint")))

    ours, rival = F.col("entity") == BRAND, F.col("entity") != BRAND
    drop, jump = F.col("share_p") - F.col("share_c"), F.col("share_c") - F.col("share_p")
    margin = F.col("score_c") - F.col("b_score_c")
    gap_c, gap_p = F.col("cited_c") - F.col("b_cited_c"), F.col("cited_p") - F.col("b_cited_p")
    rules = [
        rule(ours & (drop >= t.brand_drop_points), "visibility_drop", drop, "high", t.brand_drop_points, F.col("share_p"), F.col("share_c")),
        rule(rival & (jump >= t.competitor_jump_points), "competitor_visibility_jump", jump, "medium", t.competitor_jump_points, F.col("share_p"), F.col("share_c")),
        rule(rival & (F.col("score_p") <= F.col("b_score_p")) & (margin >= t.overtake_margin_points), "competitor_overtakes_brand", margin, "high", t.overtake_margin_points, F.col("score_c"), F.col("b_score_c")),
        rule(rival & (gap_c - gap_p >= t.citation_gap_increase_points) & (gap_c > 0), "citation_gap_increase", gap_c - gap_p, "medium", t.citation_gap_increase_points, gap_p, gap_c),
    ]
    found = rows.select("project_id", F.col("entity").alias("subject"), F.explode(F.array_compact(F.array(*rules))).alias("a"))
    return found.select("project_id", "a.alert_type", "subject", "a.magnitude", "a.severity", "a.fingerprint")


def new_sources(cited: DataFrame, start: Column, least: int = 2, source: str = "domain_id") -> DataFrame:
    """Sources (domains or pages) cited at least ``least`` times since ``start`` and never before; one pass tells both."""
    g = cited.groupBy("project_id", source).agg(F.min("cited_at").alias("first_at"), F.count_if(F.col("cited_at") >= start).alias("citations"))
    return g.where((F.col("first_at") >= start) & (F.col("citations") >= least))


def about(subject: Column, names: Sequence[str]) -> Column:
    """Whether a claim's subject holds one of the names; a project has a few."""
    return reduce(lambda a, b: a | b, [F.lower(subject).contains(n.lower()) for n in names], F.lit(False))


def new_claims(stated: DataFrame, rivals: Sequence[str], start: Column) -> DataFrame:
    """Claims about competitors (normalised triples) since ``start`` that were not made before it; one pass tells both.

    ``stated``: project_id, subject, predicate, object, claimed_at.
    """
    key = ["project_id", "subject", "predicate", "object"]
    triples = stated.where(about(F.col("subject"), rivals)).select("project_id", *[F.lower(F.trim(c)).alias(c) for c in key[1:]], "claimed_at")
    g = triples.groupBy(*key).agg(F.count("*").alias("occurrences"), F.min("claimed_at").alias("first_at"))
    return g.where(F.col("first_at") >= start).drop("first_at")


def claim_signals(stated: DataFrame, brand: str, rivals: Sequence[str], examples: int = 5) -> DataFrame:
    """Per project and entity: claims whose subject holds its name, those with a figure in object or context, and the first
    few of these by time as examples. A claim that names two entities counts for both."""
    entities = F.explode(F.filter(F.array(*[F.when(about(F.col("subject"), [n]), F.lit(e)) for e, n in ((BRAND, brand), *((r, r) for r in rivals))]), lambda x: x.isNotNull()))
    rows = stated.select("project_id", entities.alias("entity"), "claimed_at", F.coalesce(F.col("object").rlike(r"\d") | F.col("context").rlike(r"\d"), F.lit(False)).alias("specific"), F.substring(F.concat_ws(" ", "subject", "predicate", "object"), 1, 200).alias("text"))
    counts = rows.groupBy("project_id", "entity").agg(F.count("*").alias("claims"), F.count_if("specific").alias("specific_claims"))
    first = Window.partitionBy("project_id", "entity").orderBy("claimed_at", "text")
    few = rows.where("specific").withColumn("n", F.row_number().over(first)).where(F.col("n") <= examples)
    shown = few.groupBy("project_id", "entity").agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("examples"))
    return counts.join(shown, ["project_id", "entity"], "left").withColumn("examples", F.coalesce("examples", F.expr("cast(array() AS array<string>)")))


def brand_profile(entities: DataFrame, site: Column) -> DataFrame:
    """Per site what its structured data says of the brand: organization and description there, distinct names, sameAs links,
    products. ``entities`` as of extract_entities."""
    kind = F.lower("entity_type")
    organization = kind.isin("organization", "brand", "corporation", "localbusiness")
    return entities.groupBy(site.alias("site")).agg(
        F.bool_or(organization).alias("has_organization"),
        F.coalesce(F.bool_or(F.when(organization, F.col("description").isNotNull())), F.lit(False)).alias("has_description"),
        F.countDistinct(F.when(organization, F.trim("name"))).alias("names"),
        F.coalesce(F.sum(F.when(organization, F.size("same_as"))), F.lit(0)).alias("same_as_links"),
        F.count_if(kind.isin("product", "softwareapplication", "service")).alias("products"),
    )


def topic_facts(observations: DataFrame, cited: DataFrame, domains: DataFrame, competitors: Sequence[str]) -> DataFrame:
    """Per project and prompt: responses, brand and top competitor mentions, citations, research behind competitors."""
    g = observations.groupBy("project_id", "prompt_id", "category", "funnel_stage").agg(
        F.count("*").alias("responses"), F.min("completed_at").alias("first_at"), F.count_if("brand_mentioned").alias("brand_mentions"), F.greatest(*[F.count_if(F.array_contains("competitors", c)) for c in competitors], F.lit(0)).alias("top_competitor_mentions")
    )
    c = cited.join(domains.select("domain_id", "domain_type"), "domain_id").groupBy("project_id", "prompt_id").agg(
        F.count("*").alias("citations"), F.count_if("is_brand").alias("brand_cited"), F.count_if(F.col("is_competitor") & (F.col("domain_type") == "research")).alias("competitor_research")
    )
    return g.join(c, ["project_id", "prompt_id"], "left").na.fill(0, ["citations", "brand_cited", "competitor_research"])


def content_gaps(facts: DataFrame) -> DataFrame:
    """Gap types of every topic: ``facts`` with ``coverage`` (0 to 1), ``needed`` (as of needed_gap) and ``has_needed``.

    None below five responses, a competitor rate of 40 % or a lead of 20 points.
    """
    rate = L.share(F.col("top_competitor_mentions"), F.col("responses"))
    brand = L.share(F.col("brand_mentions"), F.col("responses"))
    f = facts.withColumn("competitor_rate", rate).withColumn("brand_rate", brand)
    f = f.where((F.col("responses") >= 5) & (F.col("competitor_rate") >= 40) & (F.col("competitor_rate") - F.col("brand_rate") >= 20))
    first = F.when(F.col("coverage") == 0, F.coalesce("needed", F.lit("missing_topic"))).when(F.col("coverage") < 1, "weak_topic").when(F.col("needed").isNotNull() & ~F.col("has_needed"), F.col("needed"))
    evidence = F.when((F.col("competitor_research") > 0) & (F.col("brand_cited") == 0) & (F.coalesce(first, F.lit("")) != "missing_topic"), "missing_evidence")
    score = (
        30.0 * F.greatest(F.lit(0.0), F.col("competitor_rate") - F.col("brand_rate")) / 100.0
        + 25.0 * F.least(F.lit(1.0), F.col("responses") / 10.0)
        + F.when(is_commercial(), 20.0).otherwise(8.0)
        + 15.0 * (1.0 - F.col("coverage"))
        + F.when(F.col("citations") > 0, 10.0).otherwise(3.0)
    )
    level = F.when(F.col("responses") >= 20, "high").when(F.col("responses") >= 10, "medium").otherwise("low")
    return f.select("project_id", "prompt_id", "category", "responses", "first_at", F.explode(F.array_compact(F.array(first, evidence))).alias("gap_type"), level.alias("confidence"), F.bround(score, 1).alias("score"), L.band(F.col("competitor_rate"), 60, 30).alias("visibility_band"))


#: Content category of the page that each needed gap type calls for.
NEEDED_PAGES = {"missing_comparison": "comparison", "missing_faq": "faq", "missing_use_case": "use_case", "missing_product_detail": "product"}


def needed_gap(category: Column, prompt: Column) -> Column:
    """The gap type whose page a prompt calls for by its category or wording, or null."""
    return (
        F.when(category.isin("comparison", "alternative"), "missing_comparison")
        .when(category.isin("pricing", "product"), "missing_product_detail")
        .when(category == "industry", "missing_use_case")
        .when(category.isin("problem_solution", "faq") | F.ltrim(prompt).rlike(r"(?i)^(how|can|does|do|is|are|should|why|when)\b"), "missing_faq")
        .when((category == "discovery") & F.lower(prompt).rlike(r"\bfor\s+[a-z]+"), "missing_use_case")
    )


def match_pages(topics: DataFrame, pages: DataFrame, scope: Sequence[str] = ()) -> DataFrame:
    """Per topic: pages that hold at least half of its keywords in url, title or description, their coverage and categories.

    ``topics``: topic_id, keywords; ``pages``: page_id, url, title, meta, word_count; both with the columns of ``scope``
    (such as project_id) within which they match; page_id is unique. Keywords match as substrings: one automaton over all
    distinct keywords reads each page once, and topics then join by keyword.
    """
    scope = list(scope)
    wanted = topics.select(*scope, "topic_id", F.explode(F.array_distinct("keywords")).alias("keyword"), F.size(F.array_distinct("keywords")).alias("n"))
    categories = page_categories(F.col("url"), F.col("title"))
    facts = pages.select(*scope, "page_id", "word_count", *[F.array_contains(categories, c).alias(c) for c in NEEDED_PAGES.values()])
    hits = keyword_hits(pages.select(F.col("page_id").alias("text_id"), F.lower(F.concat_ws(" ", "url", "title", "meta")).alias("text")), wanted).withColumnRenamed("text_id", "page_id")
    if scope:
        hits = hits.join(pages.select(*scope, "page_id"), "page_id")
    needed = F.when(F.col("n") > 1, F.floor((F.col("n") + 1) / 2)).otherwise(1)
    # dealt by page, so that pairs of topics and pages are counted where they arise, if topics are sent to all tasks
    matched = wanted.join(hits.repartition("page_id"), [*scope, "keyword"]).groupBy(*scope, "topic_id", "page_id", "n").agg(F.count("*").alias("hits")).where(F.col("hits") >= needed)
    points = F.when(F.coalesce("word_count", F.lit(0)) >= 300, 1.0).otherwise(0.4)
    found = matched.join(facts, [*scope, "page_id"]).groupBy(*scope, "topic_id").agg(F.count("*").alias("pages"), F.least(F.lit(1.0), F.sum(points)).alias("coverage"), *[F.bool_or(c).alias(c) for c in NEEDED_PAGES.values()])
    has = F.array_compact(F.array(*[F.when(F.col(c), F.lit(c)) for c in NEEDED_PAGES.values()]))
    return found.select(*scope, "topic_id", "pages", "coverage", has.alias("categories"))


def distinct_gaps(gaps: DataFrame, topic: Column, order: Sequence[str]) -> DataFrame:
    """One gap for each project, topic and gap type: that of the first prompt by ``order``. An aggregate with a map-side combine.

    ``topic`` is the normalised label; gaps of prompts whose labels have the same words are one.
    """
    whole = F.struct(*[F.col(c) for c in gaps.columns])
    first = gaps.withColumn("topic", topic).groupBy("project_id", "topic", "gap_type").agg(F.min_by(whole, F.struct(*order)).alias("g"))
    return first.select("topic", "g.*")


def candidate_scores(candidates: DataFrame, providers_seen: Column) -> DataFrame:
    """Confidence of discovered competitor names: ``candidates`` has responses, co_occurring, commercial_prompts, prompts,
    has_domain, observations, language_hits, providers. One response alone is no candidate."""
    n = F.col("responses")
    parts = {
        "frequency": (F.least(F.lit(1.0), F.log10(n + 1.0) / F.log10(F.lit(11.0))), 0.30),
        "relevance": (0.6 * F.col("co_occurring") / n + 0.4 * F.col("commercial_prompts") / F.greatest(F.col("prompts"), F.lit(1)), 0.20),
        "domain_confidence": (F.col("has_domain").cast("double"), 0.15),
        "competitor_language": (F.coalesce(F.try_divide(F.col("language_hits"), F.col("observations")), F.lit(0.0)), 0.20),
        "cross_provider": (F.coalesce(F.try_divide(F.col("providers"), providers_seen), F.lit(0.0)), 0.15),
    }
    # weights of two and components of three decimals: five are exact, and no tie hangs on the order of the sums
    score = F.bround(sum((w * F.bround(v, 3) for v, w in parts.values()), F.lit(0.0)), 5)
    scored = candidates.where(n >= 2).withColumn("confidence", score)
    return scored.withColumn("label", F.when(F.col("confidence") >= 0.7, "high").when(F.col("confidence") >= 0.4, "medium").otherwise("low"))


def new_competitor_alerts(candidates: DataFrame, t: AlertThresholds = AlertThresholds()) -> DataFrame:
    """Alerts for discovered names of at least the threshold's confidence; ``candidates`` as of candidate_scores."""
    found = candidates.where(F.col("confidence") >= t.new_competitor_min_confidence)
    return found.select("project_id", F.lit("new_competitor").alias("alert_type"), F.lower("name").alias("subject"), F.when(F.col("label") == "high", "medium").otherwise("low").alias("severity"), fingerprint(F.lower("name")).alias("fingerprint"))


def content_gap_alerts(gaps: DataFrame, t: AlertThresholds = AlertThresholds()) -> DataFrame:
    """Alerts for content gaps of at least the threshold's score."""
    found = gaps.where(F.col("score") >= t.content_gap_min_score)
    return found.select("project_id", F.lit("new_content_gap").alias("alert_type"), F.concat_ws(":", F.col("prompt_id").cast("string"), "gap_type").alias("subject"), F.when(F.col("score") >= 80, "high").otherwise("medium").alias("severity"), "score")
