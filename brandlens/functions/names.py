"""Hosts, names, topics and small rules as Column expressions; nothing here leaves the JVM but the folding of company names."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from brandlens.functions.text import fold_ascii

# Labels that a shown host loses, endings of company names, kinds of addresses and pages, words that name no topic.
LEADING_LABELS = ("www", "m", "en", "docs", "blog", "news", "support")
COMPANY_ENDINGS = ("inc", "llc", "ltd", "limited", "corp", "corporation", "co", "gmbh", "plc", "sa")
ADDRESS_CATEGORIES = (
    ("comparison", r"(?:^|[/-])(?:vs|versus|compare|comparison|alternatives?)(?:$|[/-])"),
    ("faq", r"faq|help|support|docs|documentation|questions"),
    ("use_case", r"use-?cases?|customers?|case-stud|success|stories"),
    ("educational", r"guide|how-to|howto|learn|tutorial|academy|blog|resources"),
    ("product", r"product|pricing|features?|plans|integrations?"),
)
PAGE_CATEGORIES = (
    ("comparison", r"\bvs\b|versus|compare|comparison|alternatives?"),
    ("faq", r"faq|frequently.asked|help|support|docs|questions?\b"),
    ("use_case", r"use.?cases?|customers?|case.stud|success|stories|industries|industry"),
    ("product", r"products?\b|pricing|features?|plans\b|integrations?"),
    ("educational", r"guide|how.to|learn|tutorial|academy|blog|resources"),
)
TOPIC_STOP_WORDS = "a an and are be best can cheap cheapest do does for from how i in is it my of on or should that the there to top what when which who why with you your".split()
TOPIC_GENERIC_WORDS = """tool tools software solution solutions platform platforms app apps service services company companies product products option options alternatives alternative vs versus
compare comparison price prices pricing cost costs review reviews""".split()
TOPIC_WORD = r"([a-z0-9][a-z0-9'-]+)"


def same_site(host: Column, root: Column, subdomains: bool = True) -> Column:
    """Whether two hosts are one site: equal but for ``www.``, or the first under the second."""
    bare = lambda h: F.regexp_replace(F.lower(h), r"^www\.", "")
    equal = bare(host) == bare(root)
    return equal | F.lower(host).endswith(F.concat(F.lit("."), bare(root))) if subdomains else equal


def display_name(host: Column) -> Column:
    """The host without its leading service labels, of which at least two labels stay."""
    leading = "|".join(LEADING_LABELS)
    return F.regexp_replace(host, rf"^(?:(?:{leading})\.)+(?=[^.]+\.[^.])", "")


def host_stem(url_or_host: Column) -> Column:
    """The first label of a host or URL without ``www.``; null without a dot."""
    rest = F.regexp_replace(F.lower(F.trim(url_or_host)), r"^[^/]*//", "")
    host = F.regexp_replace(F.regexp_replace(F.regexp_replace(rest, r"[/?#].*$", ""), r"^.*@|:\d*$", ""), r"^www\.", "")
    return F.when(host.contains("."), F.split_part(host, F.lit("."), F.lit(1)))


def _words(text: Column) -> Column:
    return F.trim(F.regexp_replace(F.lower(text), r"[^a-z0-9]+", " "))


def slug_text(url: Column, anchor: Column) -> Column:
    """Path, query and anchor as lower-case words between single spaces, padded, for whole-word look-ups."""
    tail = F.regexp_replace(F.regexp_replace(F.coalesce(url, F.lit("")), r"#.*$", ""), r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?]*", "")
    return F.concat(F.lit(" "), _words(F.concat_ws(" ", F.replace(tail, F.lit("?"), F.lit(" ")), anchor)), F.lit(" "))


def name_in(name: Column, slug: Column) -> Column:
    """Whether a name of at least three characters stands in a slug text as whole words."""
    token = _words(name)
    return (F.length(token) >= 3) & F.contains(slug, F.concat(F.lit(" "), token, F.lit(" ")))


def address_category(url: Column) -> Column:
    """The first content category that a cited address suggests, or null."""
    low = F.lower(url)
    return F.coalesce(*[F.when(low.rlike(pattern), F.lit(name)) for name, pattern in ADDRESS_CATEGORIES])


def page_categories(url: Column, title: Column) -> Column:
    """All content categories that a page's address and title suggest."""
    hay = F.lower(F.concat_ws(" ", url, title))
    return F.array_compact(F.array(*[F.when(hay.rlike(pattern), F.lit(name)) for name, pattern in PAGE_CATEGORIES]))


def display_path(url: Column) -> Column:
    """The path and query of an address, ``/`` at least; what is no address stays as it is."""
    found = F.regexp_extract(url, r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+([^#]*)", 1)
    return F.when(url.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://[^/?#]+"), F.when(found == "", "/").otherwise(found)).otherwise(url)


def company_key(name: Column, folded: bool = False) -> Column:
    """A company name as one lower-case ASCII word without its legal endings; ``folded`` says that it is ASCII already."""
    plain = _words(name if folded else fold_ascii(name))
    return F.replace(F.regexp_replace(plain, rf"(?<=[a-z0-9])(?: (?:{'|'.join(COMPANY_ENDINGS)}))+$", ""), F.lit(" "), F.lit(""))


def topic_keywords(prompt: Column) -> Column:
    """The words of a prompt that name its topic, in order and with repeats."""
    words = F.regexp_extract_all(F.lower(prompt), F.lit(TOPIC_WORD), F.lit(1))
    return F.filter(words, lambda w: (F.length(w) >= 3) & ~w.isin(*TOPIC_STOP_WORDS, *TOPIC_GENERIC_WORDS))


def topic_label(prompt: Column) -> Column:
    kept = F.array_join(topic_keywords(prompt), " ")
    return F.substring(F.when(kept == "", prompt).otherwise(kept), 1, 300)


def normalized_topic(label: Column) -> Column:
    """One form for labels of the same words: sorted, each once."""
    words = F.regexp_extract_all(F.lower(label), F.lit(TOPIC_WORD), F.lit(1))
    return F.substring(F.array_join(F.array_sort(F.array_distinct(words)), " "), 1, 300)


def snippets(text: Column, pattern: str, around: int = 40, most: int = 3) -> Column:
    """The first places where a pattern fits, with up to ``around`` characters on each side, white space as one space."""
    near = rf"(?s)(.{{0,{around}}}(?:{pattern}).{{0,{around}}})"
    found = F.slice(F.regexp_extract_all(text, F.lit(near), F.lit(1)), 1, most)
    return F.transform(found, lambda s: F.trim(F.regexp_replace(s, r"\s+", " ")))


def loose_date(value: Column) -> Column:
    """A timestamp from ISO text with a time and zone, with a time, or from the date that it begins with; else null."""
    raw = F.trim(value)
    day = F.regexp_extract(raw, r"^(\d{4}-\d{2}-\d{2})", 1)
    whole = F.when(raw.rlike(r"^\d{4}-\d{2}-\d{2}[T ]\d{2}:\d{2}(:\d{2}(\.\d+)?)?(Z|[+-]\d{2}:?\d{2})?$"), F.try_to_timestamp(F.regexp_replace(raw, r"([+-]\d{2})(\d{2})$", "$1:$2")))
    return F.coalesce(whole, F.try_to_timestamp(F.nullif(day, F.lit(""))))


def backoff(attempt: Column, base: float, cap: float) -> Column:
    """Seconds to wait before a try: doubling from ``base``, at most ``cap``."""
    return F.least(F.lit(cap), F.lit(base) * F.pow(F.lit(2.0), attempt - 1))


def sample_confidence(*samples: Column) -> Column:
    """high, medium or low by the least of the samples."""
    least = F.least(*samples) if len(samples) > 1 else samples[0]
    return F.when(least >= 50, "high").when(least >= 20, "medium").otherwise("low")


def merged_citations(own: Column, found: Column, most: int = 50) -> Column:
    """The provider's addresses before those found in the text, each once, ``most`` at most: what an answer may show."""
    none = F.expr("cast(array() AS array<string>)")
    return F.slice(F.array_distinct(F.filter(F.concat(F.coalesce(own, none), F.coalesce(found, none)), lambda u: F.coalesce(u != "", F.lit(False)))), 1, most)


def affected_pages(url: Column, urls: Column, pages: Column, chains: Column, count: Column) -> Column:
    """struct<urls, count> of the pages that an observation's evidence names in any of its forms; the larger count holds."""
    none = F.expr("cast(array() AS array<string>)")
    every = F.filter(F.array_distinct(F.concat(F.array(url), *[F.coalesce(c, none) for c in (urls, pages, chains)])), lambda u: u.isNotNull())
    return F.struct(every.alias("urls"), F.greatest(F.size(every), F.coalesce(count, F.lit(0))).alias("count"))


def clipped(text: Column, most: int) -> Column:
    """The text, or its first ``most`` - 1 characters and an ellipsis."""
    return F.when(F.length(text) > most, F.concat(F.rtrim(F.substring(text, 1, most - 1)), F.lit("…"))).otherwise(text)


def dominant_sentiment(counts: dict[str, Column], first_seen: dict[str, Column]) -> Column:
    """The most frequent sentiment; on ties positive wins, else the one seen first. Null if nothing was said."""
    entries = [F.struct(n.alias("n"), F.lit(int(s == "positive")).alias("positive"), (-first_seen[s]).alias("first"), F.lit(s).alias("s")) for s, n in counts.items()]
    best = F.array_max(F.array(*entries))
    return F.when(reduce(lambda a, b: a + b, counts.values()) > 0, best["s"])
