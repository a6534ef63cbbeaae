"""Open evidence documents: values at nested paths and keys that exist, read from VARIANT columns without a schema."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def as_variant(document: Column) -> Column:
    """JSON text as VARIANT; text that is no JSON is null."""
    return F.try_parse_json(document)


def value_at(document: Column, path: str, kind: str, default: object = None) -> Column:
    """The value of a VARIANT at a path (``$.inputs.responses``) as ``kind``; missing, null or of another kind is ``default``."""
    found = F.try_variant_get(document, path, kind)
    return found if default is None else F.coalesce(found, F.lit(default).cast(kind))


def has_key(document: Column, key: str) -> Column:
    """Whether a VARIANT object has a key of its own, also if the value there is null; false for null and for what is no object."""
    if set(key) & set("'\"\\"):  # a path can't quote these
        return F.coalesce(F.array_contains(F.json_object_keys(F.to_json(document)), key), F.lit(False))
    return F.try_variant_get(document, f"$['{key}']", "variant").isNotNull()


def gap_facts(gaps: DataFrame) -> DataFrame:
    """``gaps`` with what recommendations read of each gap's evidence (JSON text): counts of its inputs, 0 if they are missing."""
    rows = gaps.withColumn("_evidence", as_variant(F.col("evidence")))
    found = {
        "source_type": value_at(F.col("_evidence"), "$.inputs.domain_type", "string", "unknown"),
        "eligible_responses": value_at(F.col("_evidence"), "$.inputs.eligible_responses", "bigint", 0),
        "prompts_citing": value_at(F.col("_evidence"), "$.inputs.prompts_citing", "bigint", 0),
        "total_prompts": value_at(F.col("_evidence"), "$.inputs.total_prompts", "bigint", 0),
        "source_relevance": value_at(F.col("_evidence"), "$.inputs.source_relevance", "double", 0.0),
    }
    return rows.withColumns(found).drop("_evidence")


def naming(gaps: DataFrame, competitor: str) -> DataFrame:
    """The gaps whose ``competitors`` (JSON text, name to count) have a competitor."""
    return gaps.where(has_key(as_variant(F.col("competitors")), competitor))
