"""Scores, bands and rounding as Column expressions.

Unavailable is null and never 0; scores of small samples are withheld or rounded more coarsely.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

# Points, weights and thresholds of the scoring method.
POSITION_POINTS = {1: 100.0, 2: 85.0, 3: 70.0, 4: 55.0, 5: 40.0}
LATER_POSITION_POINTS = 25.0
SENTIMENT_POINTS = {"positive": 100.0, "mixed": 50.0, "neutral": 50.0, "negative": 0.0}
STRENGTHS = ("unknown", "none", "weak", "moderate", "strong")
SENTIMENTS = ("positive", "neutral", "negative", "mixed", "unknown")
MIN_SAMPLE = 5


def lookup(key: Column, values: dict, default=None) -> Column:
    """``values[key]`` or the default, for a short fixed table."""
    table = F.create_map(*[F.lit(x) for pair in values.items() for x in pair])
    found = F.try_element_at(table, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def position_points(position: Column) -> Column:
    return F.when(position.isNotNull(), lookup(position.cast("int"), POSITION_POINTS, LATER_POSITION_POINTS))


def sentiment_points(sentiment: Column) -> Column:
    return lookup(sentiment, SENTIMENT_POINTS)


def strength_rank(strength: Column) -> Column:
    return lookup(strength, {s: i for i, s in enumerate(STRENGTHS)})


def strength_of(rank: Column) -> Column:
    return F.get(F.array(*[F.lit(s) for s in STRENGTHS]), rank)


def sentiment_of(has: Callable[[str], Column]) -> Column:
    """One sentiment for several mentions, of which ``has`` tells whether one has a sentiment; unknown ones don't count."""
    return (
        F.when(has("mixed") | (has("positive") & has("negative")), "mixed")
        .when(has("negative"), "negative")
        .when(has("positive"), "positive")
        .when(has("neutral"), "neutral")
        .otherwise("unknown")
    )


def folded_sentiment(sentiment: Column) -> Column:
    """Aggregate: one sentiment for several mentions; unknown ones don't count."""
    return sentiment_of(lambda s: F.coalesce(F.bool_or(sentiment == s), F.lit(False)))


def sufficiency(sample: Column) -> Column:
    return F.when(sample >= 50, "high").when(sample >= 20, "moderate").when(sample >= MIN_SAMPLE, "low").otherwise("insufficient")


def round_for(sample: Column, value: Column) -> Column:
    """Null below the least sample; else to 5s, whole numbers or one decimal, half to even."""
    return F.when(sample < MIN_SAMPLE, F.lit(None).cast("double")).when(sample < 20, F.rint(value / 5) * 5).when(sample < 50, F.rint(value)).otherwise(F.bround(value, 1))


def round_even(value: Column, digits: int) -> Column:
    """Half to even on the scaled double, bit for bit as SQL's ``round_even`` has it; ``bround`` rounds the shortest decimal form, which is another one beside a tie."""
    scale = F.lit(10.0**digits)
    return F.rint(value * scale) / scale


def share(part: Column, whole: Column) -> Column:
    """Percentage, null for an empty whole."""
    return F.try_divide(F.lit(100.0) * part, whole)


def available_mean(parts: dict[str, tuple[Column, float]]) -> Column:
    """Weighted mean over the components that are not null; null if none is."""
    total = sum((F.coalesce(value * F.lit(weight), F.lit(0.0)) for value, weight in parts.values()), F.lit(0.0))
    weights = sum((F.when(value.isNotNull(), F.lit(weight)).otherwise(F.lit(0.0)) for value, weight in parts.values()), F.lit(0.0))
    return F.try_divide(total, F.nullif(weights, F.lit(0.0)))


def log_scaled(n: Column, saturation: int) -> Column:
    return F.when(n <= 0, F.lit(0.0)).otherwise(F.least(F.lit(100.0), F.lit(100.0) * F.log10(n + 1.0) / F.log10(F.lit(saturation + 1.0))))


def recency(days: Column) -> Column:
    """100 within a week, falling in straight pieces to 60 at 30 days, 20 at 90 and 0 at 180; null days count as never."""
    return (
        F.when(days.isNull(), F.lit(0.0))
        .when(days <= 7, F.lit(100.0))
        .when(days <= 30, 100.0 - (days - 7) * F.lit(40.0 / 23.0))
        .when(days <= 90, 60.0 - (days - 30) * F.lit(40.0 / 60.0))
        .otherwise(F.greatest(F.lit(0.0), 20.0 - (days - 90) * F.lit(20.0 / 90.0)))
    )


def band(score: Column, high: float, medium: float) -> Column:
    return F.when(score >= high, "high").when(score >= medium, "medium").otherwise("low")
