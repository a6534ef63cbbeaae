"""Technical audit of a site's pages, its health score, and readiness for AI answers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions.ladders import available_mean
from brandlens.functions.text import word_count
from brandlens.operators.specificity import specific_shares
from brandlens.shared_files import use_shared_checkpoints

# Points of severities, caps of categories, the least share of pages that counts, the clicks from home that are not too many.
SEVERITY_POINTS = {"critical": 25.0, "high": 12.0, "medium": 6.0, "low": 2.0, "info": 0.0}
CATEGORY_CAPS = {"indexability": 25.0, "http": 20.0, "internal_links": 15.0, "canonicalization": 15.0, "metadata": 15.0, "headings": 8.0, "mobile_html": 10.0, "structured_data": 5.0}
MIN_SPREAD = 0.25
DEEP = 4
READINESS_WEIGHTS = {"entity_clarity": 25.0, "product_clarity": 20.0, "authority": 15.0, "evidence": 15.0, "content_structure": 15.0, "faq": 5.0, "factual_consistency": 5.0}


def _meta(name: str) -> Column:
    return F.nullif(F.trim(F.try_element_at(F.col("meta"), F.lit(name))), F.lit(""))


def page_snapshot(facts: DataFrame) -> DataFrame:
    """Facts with what the checks read: trimmed title and description, first h1, robots, indexability, word count."""
    first = F.get(F.filter("headings", lambda h: h["level"] == 1), 0)
    robots = F.split(F.lower(F.coalesce(_meta("robots"), F.lit(""))), r"\s*,\s*")
    return facts.withColumns(
        {
            "title": F.nullif(F.trim("title"), F.lit("")),
            "description": _meta("description"),
            "viewport": _meta("viewport"),
            "h1": first["text"],
            "h1_count": F.size(F.filter("headings", lambda h: h["level"] == 1)),
            "noindex": F.arrays_overlap(F.transform(robots, lambda r: F.trim(r)), F.array(F.lit("noindex"), F.lit("none"))),
            "words": word_count(F.coalesce("text", F.lit(""))),
        }
    )


def heading_issues(facts: DataFrame) -> DataFrame:
    """Per page: headings that skip a level, repeat a text, or are longer than 70 characters."""
    h = facts.select("page_id", F.explode("headings").alias("h")).select("page_id", "h.*")
    w = Window.partitionBy("page_id").orderBy("position")
    rows = h.withColumn("before", F.lag("level").over(w)).withColumn("same", F.count("*").over(Window.partitionBy("page_id", F.lower("text"))))
    return rows.groupBy("page_id").agg(F.count_if(F.col("level") > F.col("before") + 1).alias("skipped"), F.count_if((F.col("same") > 1) & (F.col("text") != "")).alias("repeated"), F.count_if(F.length("text") > 70).alias("long"))


def heading_parents(facts: DataFrame) -> DataFrame:
    """Every heading with the position of the nearest earlier heading of a smaller level, its parent."""
    h = facts.select("page_id", F.explode("headings").alias("h"), "headings")
    before = lambda h: F.filter("headings", lambda x: (x["position"] < h["position"]) & (x["level"] < h["level"]))
    parent = F.array_max(F.transform(before(F.col("h")), lambda x: x["position"]))
    return h.select("page_id", "h.position", "h.level", "h.text", parent.alias("parent_position"))


def findings(snapshot: DataFrame) -> DataFrame:
    """(code, severity, category, page_id) of the page checks, one pass: each page makes the array of its findings.

    Pages that may not be indexed have milder titles and descriptions to blame.
    """
    t, d = F.col("title"), F.col("description")
    unless_hidden = lambda severity, milder: F.when(F.col("noindex"), milder).otherwise(severity)
    checks = [
        ("title_missing", unless_hidden("high", "low"), "metadata", t.isNull()),
        ("title_too_long", unless_hidden("low", "info"), "metadata", F.length(t) > 90),
        ("title_long", "info", "metadata", (F.length(t) > 60) & (F.length(t) <= 90)),
        ("title_too_short", unless_hidden("low", "info"), "metadata", F.length(t) < 15),
        ("description_missing", unless_hidden("medium", "info"), "metadata", d.isNull()),
        ("description_too_long", "low", "metadata", F.length(d) > 320),
        ("description_too_short", "info", "metadata", F.length(d) < 50),
        ("h1_missing", "medium", "headings", F.col("h1_count") == 0),
        ("h1_multiple", "low", "headings", F.col("h1_count") > 1),
        ("canonical_conflicting", "high", "canonicalization", F.col("canonical_count") > 1),
        ("canonical_missing", "low", "canonicalization", F.col("canonical_count") == 0),
        ("viewport_missing", "medium", "mobile_html", F.col("viewport").isNull()),
        ("lang_missing", "low", "mobile_html", F.col("lang").isNull()),
        ("charset_missing", "low", "mobile_html", F.col("charset").isNull()),
        ("doctype_missing", "low", "mobile_html", ~F.col("has_doctype")),
        ("title_multiple", "low", "mobile_html", F.col("title_count") > 1),
        ("noindex_pages", "info", "indexability", F.col("noindex")),
        ("structured_data_missing", "low", "structured_data", F.size("blocks") == 0),
        ("structured_data_invalid", "medium", "structured_data", F.exists("blocks", lambda b: ~b["is_valid"])),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"), F.lit(category).alias("category"))) for code, severity, category, hit in checks]))
    return snapshot.select("page_id", F.explode(found).alias("f")).select("f.*", "page_id")


def duplicate_titles(snapshot: DataFrame) -> DataFrame:
    """Titles that several pages share."""
    g = snapshot.where(F.col("title").isNotNull()).groupBy(F.lower("title").alias("title")).agg(F.count("*").alias("pages"), F.min("page_id").alias("first_page"))
    return g.where("pages > 1").withColumn("severity", F.when(F.col("pages") > 3, "medium").otherwise("low"))


def heading_findings(snapshot: DataFrame) -> DataFrame:
    """(code, severity, category, page_id) of headings: skipped levels, repeated texts, more than 70 characters.

    The headings of a page are compared within its row; nothing is shuffled.
    """
    levels = F.transform("headings", lambda h: h["level"])
    rest = F.greatest(F.size(levels) - 1, F.lit(0))
    jumps = F.zip_with(F.slice(levels, 1, rest), F.slice(levels, 2, rest), lambda above, below: below > above + 1)
    texts = F.filter(F.transform("headings", lambda h: F.lower(F.trim(h["text"]))), lambda t: t != "")
    checks = [
        ("heading_hierarchy_skipped", "low", F.exists(jumps, lambda j: j)),
        ("heading_duplicate", "info", F.size(texts) > F.size(F.array_distinct(texts))),
        ("heading_too_long", "info", F.exists("headings", lambda h: F.length(h["text"]) > 70)),
    ]
    found = F.array_compact(F.array(*[F.when(hit, F.struct(F.lit(code).alias("code"), F.lit(severity).alias("severity"), F.lit("headings").alias("category"))) for code, severity, hit in checks]))
    return snapshot.select("page_id", F.explode(found).alias("f")).select("f.*", "page_id")


def canonical_findings(snapshot: DataFrame, http_status: str | None = None) -> DataFrame:
    """(code, severity, category, page_id): the first canonical fault of a page, in order: several, none, another site's, a
    chain, a target that doesn't answer 200, another address.

    The site of a page is its host without www.; its subdomains belong to it. ``http_status`` names the column of answers,
    if there is one. Of several rows with one address the one of the least page_id is the target.
    """
    host = lambda c: F.regexp_extract(F.lower(c), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
    answer = F.col(http_status).cast("int") if http_status else F.lit(None).cast("int")
    pages = snapshot.withColumn("_answer", answer)
    told = pages.where(F.col("url").isNotNull()).groupBy(F.col("url").alias("_target")).agg(F.min_by(F.struct("canonical", "_answer"), "page_id").alias("t"))
    at, to = host(F.col("url")), host(F.col("canonical"))
    within = (to == at) | to.endswith(F.concat(F.lit("."), at))
    finding = lambda code, severity: F.struct(F.lit(code).alias("code"), (F.lit(severity) if isinstance(severity, str) else severity).alias("severity"))
    first = (
        F.when(F.col("canonical_count") > 1, finding("canonical_conflicting", "high"))
        .when(F.col("canonical").isNull(), finding("canonical_missing", F.when(F.col("noindex"), "info").otherwise("low")))
        .when(~within, finding("canonical_external", "high"))
        .when(F.col("canonical") == F.col("url"), F.lit(None))
        .when(F.col("t.canonical").isNotNull() & (F.col("t.canonical") != F.col("_target")), finding("canonical_chain", "medium"))
        .when(F.col("t._answer") != 200, finding("canonical_target_not_ok", "high"))
        .otherwise(finding("canonical_mismatch", "info"))
    )
    # pages without a canonical have no target to look for and take no part in the shuffle's hot null key
    rows = pages.join(told, F.when(F.col("canonical") != F.col("url"), F.col("canonical")) == F.col("_target"), "left")
    return rows.select("page_id", first.alias("f")).where("f IS NOT NULL").select("f.*", F.lit("canonicalization").alias("category"), "page_id")


def page_edges(facts: DataFrame, normalized: Column) -> DataFrame:
    """(source, target): which page links to which other page, each pair once, by resolved addresses."""
    pages = facts.select(F.col("page_id").alias("target"), normalized.alias("norm"))
    out = facts.select(F.col("page_id").alias("source"), F.explode("links").alias("l")).where("l.target IS NOT NULL")
    hits = out.select("source", F.regexp_replace("l.target", r"[?#].*$", "").alias("norm")).distinct()
    return hits.join(pages, "norm").where("source <> target").select("source", "target").distinct()


def click_depths(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(page_id, depth): the least number of links from a root (page_id) to every page that links lead to.

    Breadth first: a round takes the newest pages one link further and drops those already reached, until none is new. Each
    round is cut by a checkpoint in the shared folder, so that a lost executor costs one round.
    """
    use_shared_checkpoints(edges.sparkSession)
    edges = edges.checkpoint()
    newest = roots.select("page_id").distinct().withColumn("depth", F.lit(0)).checkpoint()
    reached, depth = newest, 0
    while not newest.isEmpty():
        depth += 1
        ahead = edges.join(newest.select(F.col("page_id").alias("source")), "source", "left_semi").select(F.col("target").alias("page_id")).distinct()
        newest = ahead.join(reached, "page_id", "left_anti").withColumn("depth", F.lit(depth)).checkpoint()
        reached = reached.unionByName(newest)
    return reached


def home_pages(facts: DataFrame) -> DataFrame:
    """(page_id): where each site's visitors start: the page at its root, else its first page."""
    site = F.regexp_extract(F.lower("url"), r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)
    first = F.struct((~path_of(F.col("url")).isin("", "/")).alias("inner"), "page_id")
    return facts.where(F.col("url").isNotNull()).groupBy(site.alias("site")).agg(F.min(first)["page_id"].alias("page_id")).select("page_id")


def link_findings(facts: DataFrame, normalized: Column) -> DataFrame:
    """(code, severity, category, page_id): pages that no other links to, or only one; pages more than four clicks from home.

    Home pages need no links to them.
    """
    homes = home_pages(facts)
    edges = page_edges(facts, normalized)
    sources = edges.groupBy(F.col("target").alias("page_id")).agg(F.count("*").alias("sources"))
    n = F.coalesce("sources", F.lit(0))
    linked = facts.select("page_id").join(homes, "page_id", "left_anti").join(sources, "page_id", "left")
    few = linked.where(n < 2).select(F.when(n == 0, "orphan_pages").otherwise("few_internal_links").alias("code"), F.when(n == 0, "medium").otherwise("low").alias("severity"), "page_id")
    deep = click_depths(edges, homes).where(F.col("depth") > DEEP).select(F.lit("excessive_link_depth").alias("code"), F.lit("low").alias("severity"), "page_id")
    return few.unionByName(deep).select("code", "severity", F.lit("internal_links").alias("category"), "page_id")


def broken_link_findings(links: DataFrame) -> DataFrame:
    """(code, severity, category, page_id): pages with links to addresses that answered with 400 or more (page_id, status)."""
    pages = links.where("status = 'broken'").select("page_id").distinct()
    return pages.select(F.lit("broken_internal_links").alias("code"), F.lit("high").alias("severity"), F.lit("internal_links").alias("category"), "page_id")


def audit_findings(facts: DataFrame, normalized: Column) -> DataFrame:
    """All findings that the pages alone show: of markup, headings, canonicals and links.

    Canonical faults are those of ``canonical_findings``, which looks at the targets too.
    """
    snapshot = page_snapshot(facts)
    markup = findings(snapshot).where("category <> 'canonicalization'")
    return markup.unionByName(heading_findings(snapshot)).unionByName(canonical_findings(snapshot)).unionByName(link_findings(facts, normalized))


def link_graph(facts: DataFrame, normalized: Column) -> DataFrame:
    """Per page: internal pages that link to it; none is an orphan, fewer than two few. Links count by their resolved target."""
    pages = facts.select("page_id", normalized.alias("norm"), "links")
    out = pages.select(F.col("page_id").alias("source"), F.explode("links").alias("l")).where("l.target IS NOT NULL")
    hits = out.select("source", F.regexp_replace("l.target", r"[?#].*$", "").alias("norm")).distinct()
    g = pages.select("page_id", "norm").join(hits, "norm", "left").groupBy("page_id").agg(F.countDistinct(F.when(F.col("source") != F.col("page_id"), F.col("source"))).alias("sources"))
    return g.withColumn("code", F.when(F.col("sources") == 0, "orphan_pages").when(F.col("sources") < 2, "few_internal_links"))


def health_score(found: DataFrame, pages: Column) -> DataFrame:
    """100 less the deductions of every category: points times the share of pages, at least a quarter, up to the cap.

    ``found``: site, code, severity, category, affected.
    """
    points = reduce(lambda rest, kv: F.when(F.col("severity") == kv[0], F.lit(kv[1])).otherwise(rest), SEVERITY_POINTS.items(), F.lit(0.0))
    cap = reduce(lambda rest, kv: F.when(F.col("category") == kv[0], F.lit(kv[1])).otherwise(rest), CATEGORY_CAPS.items(), F.lit(0.0))
    spread = F.greatest(F.lit(MIN_SPREAD), F.least(F.lit(1.0), F.col("affected") / pages))
    by_category = found.groupBy("site", "category").agg(F.sum(F.bround(points * spread, 3)).alias("raw"))
    return by_category.withColumn("applied", F.bround(F.least(F.col("raw"), cap), 2)).groupBy("site").agg(F.bround(F.greatest(F.lit(0.0), 100.0 - F.sum("applied")), 1).alias("score"), F.count("*").alias("categories"))


#: The share of specific sentences that counts as whole.
SPECIFICITY_TARGET = 0.30
# What a page says about itself, by path.
PAGE_KINDS = {
    "product": r"(?i)^/(products?|solutions?|features?|platform|software|apps?)(/|$)",
    "service": r"(?i)^/(services?|offerings?|what-we-do|expertise)(/|$)",
    "pricing": r"(?i)^/(pricing|plans|prices|tarifs?|preise)(/|$)",
    "article": r"(?i)^/(blog|news|articles?|insights|resources|guides?|learn|posts?)/.+",
    "about": r"(?i)^/(about|about-us|company|who-we-are|our-story|team)(/|$)",
    "contact": r"(?i)^/(contact|contact-us|impressum|imprint)(/|$)",
    "faq": r"(?i)^/(faq|faqs|help|support|questions)(/|$)",
    "case_study": r"(?i)^/(case-stud(y|ies)|customers?|success-stories|clients?)/.+",
}
# Evidence that a text holds.
SIGNALS = {
    "email": r"\b[\w.+-]+@[\w-]+(?:\.[\w-]+)+\b",
    "statistic": r"(?i)\b\d[\d,.]*\s?(?:%|percent|x\b|times\b|million|billion|k\b|hours?|days?|minutes?)",
    "research": r"(?i)\b(study|studies|research|survey(?:ed)?|report(?:ed)?\s+(?:by|that|found)|according\s+to|peer[- ]reviewed|whitepaper|white\s+paper|analysis\s+(?:of|by|shows)|benchmark(?:s|ed)?)\b",
    "citation": r"(?i)\[\d{1,3}\]|\bet\s+al\.|\b(?:source|sources|references?|citations?|bibliography):?\b",
    "case_study": r"(?i)\b(case\s+stud(?:y|ies)|success\s+stor(?:y|ies)|customer\s+stor(?:y|ies))\b",
    "pricing": r"(?i)(?:[$€£¥]\s?\d[\d,.]*|\d[\d,.]*\s?(?:usd|eur|gbp|chf|€|\$)|\bper\s+(?:month|year|user|seat)\b|/\s?(?:mo|month|yr|year|user|seat)\b|\bfree\s+(?:plan|tier|trial|forever)\b|\bpricing\b|\bprice\b|\bstarting\s+at\b|\bquote\b)",
    "postal_address": r"(?i)\b\d{1,5}\s+[A-Z][\w.'-]+(?:\s+[A-Z][\w.'-]+){0,3}\s+(?:street|st\.?|avenue|ave\.?|road|rd\.?|boulevard|blvd\.?|lane|ln\.?|drive|dr\.?|way|place|plaza|square|strasse|straße|rue)\b",
    "byline": r"(?m)(?:^|\n)\s*(?:by|written\s+by|author:?)\s+([A-Z][\w'.-]+(?:\s+[A-Z][\w'.-]+){0,3})",
}
QUESTION = r"(?i)^\s*(?:q:\s*)?(?:what|why|how|when|where|who|which|can|do|does|is|are|should|will|could)\b.*\?\s*$"


def path_of(url: Column) -> Column:
    return F.regexp_extract(url, r"^[a-z]+://[^/?#]*([^?#]*)", 1)


def page_kinds(url: Column) -> Column:
    path = path_of(url)
    return F.array_compact(F.array(F.when(path.isin("", "/"), F.lit("home")), *[F.when(path.rlike(p), F.lit(k)) for k, p in PAGE_KINDS.items()]))


def site_of(url: Column) -> Column:
    """The host of an address without www: pages of a site share it."""
    return F.regexp_extract(url, r"^[a-z]+://(?:www\.)?([^/:?#]+)", 1)


def readiness_signals(snapshot: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """Per page: which evidence its text holds, its word count, question headings, and the share of specific sentences.

    ``names`` (site, name) are what the sites' own entities are called.
    """
    text = F.coalesce("text", F.lit(""))
    shares = specific_shares(snapshot.select(site_of(F.col("url")).alias("site"), "page_id", "text"), names)
    rows = snapshot.select(
        "page_id", page_kinds(F.col("url")).alias("kinds"), "words",
        *[text.rlike(p).alias(k) for k, p in SIGNALS.items()],
        F.size(F.filter("headings", lambda h: h["text"].rlike(QUESTION))).alias("questions"),
    )
    return rows.join(shares.select("page_id", F.bround("specific_share", 4).alias("specific_share")), "page_id")


def readiness_score(values: dict[str, Column]) -> Column:
    """100 times the weighted mean of the categories that apply (not null), each held to 0..1."""
    held = {k: (F.when(v.isNotNull(), F.greatest(F.lit(0.0), F.least(F.lit(1.0), v))), READINESS_WEIGHTS[k]) for k, v in values.items()}
    return F.bround(100.0 * available_mean(held), 1)


def page_readiness(signals: DataFrame) -> DataFrame:
    """Readiness of single pages from evidence, structure and question headings; other categories don't apply to a page."""
    flags = [F.col(k).cast("int") for k in ("statistic", "research", "citation", "case_study")]
    evidence = F.when(F.col("words") >= 50, reduce(lambda a, b: a + b, flags) / float(len(flags)))
    structure = 0.6 * F.least(F.lit(1.0), F.col("specific_share") / SPECIFICITY_TARGET) + 0.2 * (F.col("words") >= 150).cast("int") + 0.2
    faq = F.when(F.col("questions") >= 3, 1.0).when(F.array_contains("kinds", "faq"), 0.5)
    return signals.withColumn("score", readiness_score({"evidence": evidence, "content_structure": structure, "faq": faq}))
