"""Answers and prompts: citations, mentions, claims, near-duplicate prompts, source classification."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from brandlens.functions.text import content_tokens, judge, normalize_prompt, sentences
from brandlens.functions.urls import host_suffixes, normalize_host
from brandlens.operators.keywords import keyword_hits
from brandlens.sources import registry as R

LINK, URL, DOMAIN = r"\[([^\]]*)\]\((https?://[^\s)]+)\)", r"(https?://[^\s)\]>\"']+)", r"\b((?:[a-zA-Z0-9-]+\.)+(?:com|org|net|io|ai|co|dev|app|gov|edu))\b"


def answer_lines(answers: DataFrame) -> DataFrame:
    """response_id, line_no, kind (heading, item, source, paragraph), item_no and text of every line that says something.

    List items count on across the whole answer; entries after a heading on sources are sources until the next heading.
    """
    lines = answers.select("response_id", F.posexplode(F.split("text", r"\n")).alias("line_no", "raw")).where(F.trim("raw") != "")
    heading = F.col("raw").rlike(r"^\s*(#{1,6}\s+\S|\*\*[^*]+\*\*:?\s*$)")
    item = F.col("raw").rlike(r"^\s*(\d{1,3}[.)]|[-*•])\s+\S")
    about_sources = F.col("raw").rlike(r"(?i)\b(sources?|references?|citations?)\b")
    w = Window.partitionBy("response_id").orderBy("line_no")
    latched = F.last(F.when(heading, about_sources), ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    rows = lines.withColumn("in_sources", F.coalesce(latched, F.lit(False))).withColumn("is_item", item & ~heading)
    kind = F.when(heading, "heading").when(F.col("is_item") & F.col("in_sources"), "source").when(F.col("is_item"), "item").otherwise("paragraph")
    counted = F.sum(F.col("is_item").cast("int")).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    text = F.trim(F.regexp_replace(F.regexp_replace(F.regexp_replace("raw", r"^\s*(#{1,6}|\d{1,3}[.)]|[-*•])\s+", ""), LINK, "$1"), r"[*_`]+", ""))
    return rows.select("response_id", "line_no", kind.alias("kind"), F.when(F.col("is_item"), counted).alias("item_no"), text.alias("text"), "raw")


def answer_citations(answers: DataFrame) -> DataFrame:
    """Cited URLs and domains of every answer: markdown links, then bare URLs, then bare domains; each once, by its first kind."""
    text = F.col("text")
    without_links = F.regexp_replace(text, LINK, " ")
    without_urls = F.regexp_replace(without_links, URL, " ")
    kinds = [
        (0, "markdown_link", F.regexp_extract_all(text, F.lit(LINK), F.lit(2))),
        (1, "explicit_url", F.regexp_extract_all(without_links, F.lit(URL), F.lit(1))),
        (2, "domain_reference", F.transform(F.regexp_extract_all(without_urls, F.lit(DOMAIN), F.lit(1)), lambda d: F.lower(d))),
    ]

    def marked(rank: int, name: str, found: Column) -> Column:
        return F.transform(found, lambda u: F.struct(F.lit(rank).alias("rank"), F.lit(name).alias("citation_type"), F.regexp_replace(u, r"[.,;:]+$", "").alias("cited")))

    every = F.flatten(F.array(*[marked(*k) for k in kinds]))
    rows = answers.select("response_id", F.explode(every).alias("c")).select("response_id", "c.*")
    best = rows.groupBy("response_id", "cited").agg(F.min_by("citation_type", "rank").alias("citation_type"), F.count("*").alias("times"))
    return best.withColumn("domain", normalize_host(F.col("cited")))


def name_mentions(answers: DataFrame, names: DataFrame) -> DataFrame:
    """response_id, name, sentence_no, sentiment, strength: sentences that hold a name as a whole word.

    ``names`` (name) is a project's few brands. Each sentence becomes its distinct lower-case words, so names of one word
    meet sentences by an equi-join; longer names join by their first word and are then checked.
    """
    said = answers.select("response_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    low = F.lower("sentence")
    words = said.withColumn("low", low).withColumn("word", F.explode(F.array_distinct(F.regexp_extract_all(low, F.lit(r"([\p{L}\p{N}]+)"), F.lit(1)))))
    wanted = names.select("name", F.lower("name").alias("low_name")).withColumn("word", F.regexp_extract("low_name", r"^[^\p{L}\p{N}]*([\p{L}\p{N}]+)", 1))
    whole = F.expr(r"regexp_like(low, concat('(^|[^\\p{L}\\p{N}])\\Q', low_name, '\\E([^\\p{L}\\p{N}]|$)'))")
    verdict = judge(F.col("sentence"))
    return words.join(wanted, "word").where(whole).select("response_id", "name", "sentence_no", *[c.alias(n) for n, c in verdict.items()])


def claims(answers: DataFrame, names: DataFrame) -> DataFrame:
    """(subject, predicate, object) of sentences that open with a name within 60 characters before a claim verb.

    Names may lie inside words, so one automaton over all of them reads each sentence once; names then join by equality.
    """
    said = answers.select("response_id", F.posexplode(sentences(F.col("text"))).alias("sentence_no", "sentence"))
    wanted = names.select("name", F.lower("name").alias("low_name"))
    whole = F.struct("response_id", "sentence_no", "sentence").alias("text_id")
    hits = keyword_hits(said.select(whole, F.lower("sentence").alias("text")), wanted.select(F.col("low_name").alias("keyword"))).select("text_id.*", F.col("keyword").alias("low_name"))
    placed = hits.join(wanted, "low_name").withColumn("at", F.expr("locate(low_name, lower(sentence))")).where(F.col("at") <= 60)
    rest = F.expr("substring(sentence, at + length(low_name))")
    predicate, obj = F.lower(F.regexp_extract(rest, R.CLAIM, 1)), F.trim(F.regexp_extract(rest, R.CLAIM, 2))
    return placed.select("response_id", "sentence_no", F.col("name").alias("subject"), predicate.alias("predicate"), obj.alias("object")).where(F.col("object") != "")


def near_duplicate_prompts(prompts: DataFrame, threshold: float = 0.8, folded: bool = False) -> DataFrame:
    """Pairs (a < b) of prompts of one set with equal normal form or token Jaccard of at least ``threshold``.

    Prefix filtering keeps it off all pairs: two sets this alike share one of their rarest tokens. Candidates come from an
    equi-join on those few tokens of each prompt and are verified on the whole sets.
    """
    norm = prompts.select("prompt_id", "set_id", normalize_prompt(F.col("text"), folded).alias("normal"))
    sets = norm.withColumn("tokens", content_tokens(F.col("normal")))
    rare = sets.select("set_id", F.explode("tokens").alias("token")).groupBy("set_id", "token").agg(F.count("*").alias("df"))
    ordered = (
        sets.select("prompt_id", "set_id", F.explode("tokens").alias("token"))
        .join(rare, ["set_id", "token"])
        .groupBy("prompt_id", "set_id")
        .agg(F.array_sort(F.collect_list(F.struct("df", "token"))).alias("t"))
    )
    keep = F.size("t") - F.ceil(F.size("t") * F.lit(threshold)) + 1
    prefix = ordered.select("prompt_id", "set_id", F.explode(F.transform(F.slice("t", F.lit(1), keep.cast("int")), lambda x: x["token"])).alias("token"))
    other = prefix.select(F.col("prompt_id").alias("b"), "set_id", "token")
    pairs = prefix.withColumnRenamed("prompt_id", "a").join(other, ["set_id", "token"]).where("a < b").select("set_id", "a", "b").distinct()
    side = lambda n: sets.select(F.col("prompt_id").alias(n), F.col("tokens").alias(f"t_{n}"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    jaccard = F.size(F.array_intersect("t_a", "t_b")) / F.size(F.array_union("t_a", "t_b"))
    alike = both.withColumn("similarity", jaccard).where(F.col("similarity") >= threshold).select("set_id", "a", "b", F.bround("similarity", 4).alias("similarity"))
    # prompts of stop words alone have no tokens: they are alike if their normal forms are equal
    bare = sets.where(F.size("tokens") == 0).select("set_id", "normal", "prompt_id")
    equal = bare.withColumnRenamed("prompt_id", "a").join(bare.withColumnRenamed("prompt_id", "b"), ["set_id", "normal"]).where("a < b").select("set_id", "a", "b", F.lit(1.0).alias("similarity"))
    return alike.unionByName(equal)


def _dimension(spark, rows: list[tuple], schema: str) -> DataFrame:
    return spark.createDataFrame(rows, schema)


def classify_sources(sources: DataFrame, companies: DataFrame | None = None, threshold: float = 0.5) -> DataFrame:
    """domain_type and confidence of every host: noisy-OR of registry, suffix, host prefix and path signals.

    ``sources``: host, path (one row per observed page). A tie between strong types, or a score below the threshold, stays
    unknown. Registry look-ups are equi-joins on the host's suffixes; its tables are a few dozen rows.
    """
    spark = sources.sparkSession
    hosts = sources.select("host").distinct()
    suffixed = hosts.withColumn("suffix", F.explode(host_suffixes(F.col("host"))))
    known = _dimension(spark, [(d, t) for t, ds in R.KNOWN_DOMAINS.items() for d in ds], "suffix string, type string")
    w = R.SIGNAL_WEIGHTS
    signals = [suffixed.join(F.broadcast(known), "suffix").select("host", "type", F.lit(w["registry"]).alias("weight"))]
    if companies is not None:
        signals.append(suffixed.join(companies.select(F.col("host").alias("suffix")), "suffix").select("host", F.lit("company").alias("type"), F.lit(w["company"]).alias("weight")).distinct())
    ends = lambda suffixes: reduce(lambda a, b: a | b, [F.col("host").endswith(s) for s in suffixes])
    tld = F.when(ends(R.GOVERNMENT_SUFFIXES), "government").when(ends(R.EDUCATION_SUFFIXES), "education")
    signals.append(hosts.select("host", tld.alias("type"), F.lit(w["tld"]).alias("weight")).where("type IS NOT NULL"))
    prefix = F.explode(F.array_compact(F.array(*[F.when(reduce(lambda a, b: a | b, [F.col("host").startswith(p) for p in ps]), F.lit(t)) for t, ps in R.HOST_PREFIXES.items()])))
    signals.append(hosts.select("host", prefix.alias("type"), F.lit(w["host"]).alias("weight")))

    def first_part(parts: list[str]) -> Column:
        out = F.lit(None).cast("string")
        for p in reversed(parts):
            out = F.when(F.lower("path").contains(p), F.lit(p)).otherwise(out)
        return out

    seen = F.explode(F.filter(F.array(*[F.struct(F.lit(t).alias("type"), first_part(ps).alias("part")) for t, ps in R.PATH_PARTS.items()]), lambda x: x["part"].isNotNull()))
    pages = sources.select("host", seen.alias("s")).groupBy("host", "s.type", "s.part").agg(F.least(F.count("*"), F.lit(R.MAX_OBSERVATIONS)).alias("n"))
    signals.append(pages.select("host", "type", (1.0 - F.pow(F.lit(1.0 - w["path"]), F.col("n"))).alias("weight")))
    scores = reduce(DataFrame.unionByName, signals).groupBy("host", "type").agg(F.round(1.0 - F.product(1.0 - F.col("weight")), 9).alias("score"))
    ranked = scores.groupBy("host").agg(F.sort_array(F.collect_list(F.struct("score", "type")), asc=False).alias("r"))
    best, second = F.get("r", F.lit(0)), F.get("r", F.lit(1))
    decided = (best["score"] >= threshold) & (F.coalesce(best["score"] - second["score"], F.lit(1.0)) >= 0.05)
    out = hosts.join(ranked, "host", "left")
    return out.select("host", F.when(decided, best["type"]).otherwise("unknown").alias("domain_type"), F.when(decided, F.bround(best["score"], 3)).otherwise(0.0).alias("confidence"))


# Language of rivalry around a name, and what stands between names of a list.
RIVALRY = r"(?i)\b(alternative|alternatives|competitor|competitors|compet(?:e|ing)s? with|similar (?:to|companies|tools|products)|instead of|rival|rivals|vs\.?|versus|compared (?:to|with)|comparison)\b"
ALTERNATIVES = r"(?i)\b(?:alternatives?|competitors?|similar (?:tools|products|companies))\s+(?:to|of|like|such as|include|including)\s+([^.\n]{2,120})"
NAME = r"[A-Z][\w&.+-]{1,40}(?: [A-Z][\w&.+-]{1,40}){0,2}"
VERSUS = rf"\b({NAME})\s+(?:vs\.?|versus)\s+({NAME})"
LABEL = r"^\s*([A-Z][\w&.+'’-]{1,40}(?:\s+[A-Z0-9][\w&.+'’-]{0,40}){0,3})(?=\s*[:—–\-(|,]|\s*$)"
BETWEEN = r"(?i),|\band\b|\bor\b|&|/|;|\binclud(?:e|es|ing)\b|\bsuch as\b|\blike\b"
NO_NAMES = """the a an and or of for with to in on by at best top free cheap affordable popular other others more overview summary pros cons pricing features conclusion note tip tips why how what when which here there
overall option options tool tools software platform platforms solution solutions service services company companies product products key main final first second third step steps example examples sources source references yes no none n/a""".split()


def discovered_names(answers: DataFrame, known: DataFrame) -> DataFrame:
    """response_id, name, position and language (rivalry) of names that answers offer: list labels, "alternatives to" and "vs".

    ``known`` (name) are the brand and configured rivals, left out by normalised name. A name has two to sixty characters,
    at most four words, and starts with a capital or digit.
    """
    lines = answer_lines(answers).where("kind <> 'source'")
    text = F.col("text")
    label = F.when(F.col("kind") == "item", F.nullif(F.regexp_extract(text, LABEL, 1), F.lit("")))
    lists = F.flatten(F.transform(F.regexp_extract_all(text, F.lit(ALTERNATIVES), F.lit(1)), lambda x: F.split(x, BETWEEN)))
    pairs = F.concat(F.regexp_extract_all(text, F.lit(VERSUS), F.lit(1)), F.regexp_extract_all(text, F.lit(VERSUS), F.lit(2)))
    entry = lambda n, language, position: F.struct(n.alias("raw"), language.alias("language"), position.alias("position"))
    found = F.concat(
        F.when(label.isNotNull(), F.array(entry(label, text.rlike(RIVALRY), F.col("item_no").cast("int")))).otherwise(F.expr("cast(array() as array<struct<raw:string,language:boolean,position:int>>)")),
        F.transform(F.concat(lists, pairs), lambda n: entry(n, F.lit(True), F.lit(None).cast("int"))),
    )
    rows = lines.select("response_id", F.explode(found).alias("f")).select("response_id", F.trim(F.regexp_replace(F.regexp_replace("f.raw", r"\s+", " "), r"^[\s*_`\"'()\[\]]+|[\s*_`\"'()\[\]]+$", "")).alias("name"), "f.language", "f.position")
    words = F.split(F.lower("name"), " ")
    proper = F.col("name").rlike(r"^[\p{Lu}0-9]") & F.col("name").rlike(r"\p{L}") & F.length("name").between(2, 60) & (F.size(words) <= 4) & ~F.forall(words, lambda w: w.isin(*NO_NAMES))
    key = F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", "")
    fresh = rows.where(proper).withColumn("key", key).where("key <> ''")
    taken = known.select(F.regexp_replace(F.lower("name"), r"[^a-z0-9]+", "").alias("known_key")).where("known_key <> ''").distinct()
    # a product of a known name ("quickbooksonline" of "quickbooks") is known too; starts of the key make it an equi-join
    starts = F.transform(F.sequence(F.lit(1), F.length("key")), lambda n: F.substring(F.col("key"), F.lit(1), n))
    keys = fresh.select("key").distinct().withColumn("start", F.explode(starts)).where("length(start) >= 4 OR start = key")
    same = keys.join(taken, F.col("start") == F.col("known_key"), "left_semi").select("key").distinct()
    rest = fresh.join(same, "key", "left_anti")
    return rest.groupBy("response_id", "key").agg(F.min("name").alias("name"), F.bool_or("language").alias("language"), F.min("position").alias("position"))
