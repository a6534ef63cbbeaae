"""Text measures and rule-based classification as Column expressions."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Callable

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from brandlens.sources import registry as R

WORDS_PER_MINUTE = 238
MIN_WORDS, MIN_HITS, MIN_MARGIN, SAMPLE_WORDS = 40, 8, 1.6, 5000


def word_count(text: Column) -> Column:
    trimmed = F.trim(F.regexp_replace(text, r"\s+", " "))
    return F.when(trimmed == "", 0).otherwise(F.size(F.split(trimmed, " ")))


def text_metrics(text: Column) -> dict[str, Column]:
    """Words, sentences, paragraphs and reading time of a text; a null text counts as empty."""
    text = F.coalesce(text, F.lit(""))
    words = word_count(text)
    return {
        "words": words,
        "characters": F.length(text),
        "sentences": F.regexp_count(text, F.lit(r"[.!?]+(\s|$)")),
        "paragraphs": F.size(F.filter(F.split(text, r"\n+"), lambda p: F.trim(p) != "")),
        "reading_seconds": F.rint(words * 60 / F.lit(float(WORDS_PER_MINUTE))).cast("int"),
    }


def detect_language(text: Column) -> Column:
    """struct<code, confidence> by stop words among the first 5000 words; null code if there is no clear winner."""
    found = F.regexp_extract_all(F.coalesce(text, F.lit("")), F.lit(r"([a-zA-ZÀ-ÿ']+)"), F.lit(1))
    every = sorted({w for stop in R.STOP_WORDS.values() for w in stop})

    def judged(words: Column) -> Column:
        sample = F.slice(words, 1, SAMPLE_WORDS)
        stopped = F.filter(F.transform(sample, lambda w: F.lower(w)), lambda w: w.isin(*every))
        return F.struct(F.size(words).alias("n"), F.size(sample).alias("sample"), stopped.alias("stopped"))

    def hits(stopped: Column, stop: list[str]) -> Column:
        return F.size(F.filter(stopped, lambda w: w.isin(*stop)))

    def decided(c: Column) -> Column:
        # counts as (hits, order): equal counts rank in the order of the table
        counts = F.array(*[F.struct(hits(c["stopped"], stop).alias("hits"), F.lit(-i).alias("order"), F.lit(code).alias("code")) for i, (code, stop) in enumerate(R.STOP_WORDS.items())])
        return F.struct(c["n"].alias("n"), c["sample"].alias("sample"), F.sort_array(counts, asc=False).alias("ranked"))

    def result(r: Column) -> Column:
        best, second = F.get(r["ranked"], F.lit(0)), F.get(r["ranked"], F.lit(1))
        clear = (r["n"] >= MIN_WORDS) & (best["hits"] >= MIN_HITS) & (best["hits"] >= second["hits"] * MIN_MARGIN)
        return F.when(clear, F.struct(best["code"].alias("code"), F.bround(best["hits"] / F.greatest(r["sample"], F.lit(1)), 4).alias("confidence")))

    return F.get(_let(_let(_let(F.array(found), judged), decided), result), F.lit(0))


def _let(values: Column, f) -> Column:
    """f over an array of one value: what f uses several times is worked out once."""
    return F.transform(values, lambda x: f(x))


def classify_prompt(text: Column) -> dict[str, Column]:
    """category, intent and funnel stage of a prompt: the first rule that fits, then the two overrides."""
    category, intent, stage = F.lit("discovery"), F.lit("informational"), F.lit("awareness")
    for name, pattern, own_intent, own_stage in reversed(R.PROMPT_RULES):
        fits = text.rlike(pattern)
        category, intent, stage = (F.when(fits, value).otherwise(rest) for value, rest in ((name, category), (own_intent, intent), (own_stage, stage)))
    return {"category": category, "intent": F.when(text.rlike(R.NAVIGATIONAL), "navigational").otherwise(intent), "stage": F.when(text.rlike(R.RETENTION), "retention").otherwise(stage)}


def as_sql_text(text: Column) -> Column:
    r"""Text on which ``as_sql_pattern`` finds on every JVM what SQL's engine (RE2) finds in the original, whose words and spaces are ASCII.

    Before Java 19 ``\b`` takes every letter for part of a word. What is not ASCII becomes a control character, and so does the
    vertical tab, which is a space of Java's alone; the long s and the Kelvin sign get characters of their own.
    """
    return F.regexp_replace(F.translate(text, "\u017f\u212a\x02\x03\x0b", "\x02\x03\x01\x01\x01"), r"[^\x00-\x7f]", "\x01")


def as_sql_pattern(pattern: str) -> str:
    """A pattern without regard to case for ``as_sql_text``: the long s is an s and the Kelvin sign a k, and neither belongs to a word."""
    return re.sub(r"\\.|[sk]", lambda m: {"s": "[s\x02]", "k": "[k\x03]"}.get(m[0], m[0]), pattern)


def judge(sentence: Column, read: Callable[[str], str] = str) -> dict[str, Column]:
    """sentiment and recommendation strength of a sentence about a name; ``read`` gives a pattern the form that the text has."""
    has = lambda pattern: sentence.rlike(read(pattern))
    bad, good = has(R.NEGATIVE), has(R.POSITIVE)
    strength = F.when(bad & ~good, "none").when(has(R.STRONG), "strong").when(has(R.MODERATE), "moderate").when(has(R.WEAK), "weak").otherwise("unknown")
    return {"sentiment": F.when(bad & good, "mixed").when(bad, "negative").when(good, "positive").otherwise("neutral"), "strength": strength}


def _ascii(text: str) -> str:
    return unicodedata.normalize("NFKD", text).encode("ascii", "ignore").decode()


@F.pandas_udf(StringType())
def fold_ascii(values: pd.Series) -> pd.Series:
    """Compatibility-decomposed text without what ASCII lacks; Spark has no such function."""
    return values.map(_ascii, na_action="ignore").astype(object).where(values.notna(), None)


def normalize_prompt(text: Column, folded: bool = False) -> Column:
    """Lower case, punctuation to spaces, single spaces; ``folded`` says that the text is ASCII already."""
    plain = text if folded else fold_ascii(text)
    return F.trim(F.regexp_replace(F.regexp_replace(F.lower(plain), r"[^a-z0-9\s]", " "), r"\s+", " "))


def content_tokens(normalized: Column) -> Column:
    """Sorted distinct stems of a normalised prompt without stop words."""
    stem = lambda w: F.when(F.length(w) <= 3, w).when(w.endswith("ies"), F.concat(F.substring(w, 1, F.length(w) - 3), F.lit("y"))).otherwise(F.regexp_replace(w, r"(?<=[a-z])(es|s)$", ""))
    kept = F.filter(F.split(normalized, " "), lambda w: (w != "") & ~w.isin(*R.PROMPT_STOP_WORDS))
    return F.array_sort(F.array_distinct(F.transform(kept, stem)))


def sentences(text: Column) -> Column:
    return F.filter(F.split(text, r"(?<=[.!?])\s+(?=[A-Z0-9\[*\-])|\n+"), lambda s: F.trim(s) != "")
