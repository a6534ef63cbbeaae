"""References between structured-data entities: nested ones by path, others by @id across blocks and pages of a site.

An @id is resolved against its page's address, so a fragment means this page's entity. Ids that stand for one another
(sameAs with an @id) form chains and cycles; pointer jumping halves every chain in each round, and a cycle takes its least
id. All derived tables are rebuilt from the latest version of every page.
"""

from __future__ import annotations

import json
import math
from collections.abc import Iterator
from typing import NamedTuple
from urllib.parse import urljoin

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from brandlens.operators import entities as E
from brandlens.shared_files import use_shared_checkpoints
from brandlens.sources.attribute_items import short_name
from brandlens.sources.pages import parse_pages

NODE_SCHEMA = "site string, page_id bigint, block int, json_path string, entity_type string, name string, own_id string, refs array<struct<property:string,target_path:string,target_id:string>>"


def _absolute(base: str | None, value) -> str | None:
    found = E._strings(value)
    if not found:
        return None
    try:
        return urljoin(base or "", found[0].strip())
    except ValueError:
        return found[0].strip()


def _kinds(node) -> list[str]:
    return [short_name(t) for t in E._strings(node.get("@type"))] if isinstance(node, dict) else []


def _nodes(payload: str, base: str | None) -> Iterator[dict]:
    """Typed nodes of a block in order, each with what its properties refer to."""
    try:
        root = json.loads(payload)
    except (ValueError, RecursionError):
        return
    stack, made = [(root, "", 0)], 0
    while stack and made < E.MAX_ENTITIES:
        node, path, depth = stack.pop()
        if depth > E.MAX_DEPTH:
            continue
        if isinstance(node, list):
            stack += [(v, f"{path}[{i}]", depth) for i, v in reversed(list(enumerate(node)))]
        elif isinstance(node, dict):
            inner = [(k, v, f"{path}.{k}" if path else k) for k, v in node.items()]
            kinds = _kinds(node)
            if kinds:
                made += 1
                refs = []
                for key, value, where in inner:
                    for i, v in enumerate(value) if isinstance(value, list) else [(None, value)]:
                        at = where if i is None else f"{where}[{i}]"
                        if isinstance(v, dict) and _kinds(v):
                            refs.append({"property": key, "target_path": at, "target_id": _absolute(base, v.get("@id"))})
                        elif isinstance(v, dict) and isinstance(v.get("@id"), str) and v["@id"].strip():
                            refs.append({"property": key, "target_path": None, "target_id": _absolute(base, v["@id"])})
                        elif key == "sameAs" and isinstance(v, str) and v.strip():
                            refs.append({"property": key, "target_path": None, "target_id": _absolute(base, v)})
                name = (E._strings(node.get("name")) or E._strings(node.get("headline")) or [None])[0]
                yield {"json_path": path, "entity_type": kinds[0], "name": name, "own_id": _absolute(base, node.get("@id")), "refs": refs}
            stack += [(v, where, depth + 1) for _, v, where in reversed(inner) if isinstance(v, (dict, list))]


def entity_nodes(blocks: DataFrame) -> DataFrame:
    """site, page_id, block, json_path, entity_type, name, own_id (absolute, or null) and refs of every typed node.

    ``blocks``: site, page_id, url, block, payload. Nothing is read from a null or broken payload.
    """
    columns = [c.split()[0] for c in NODE_SCHEMA.split(", ")]

    def walk(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for b in batches:
            rows = [{"site": s, "page_id": p, "block": n, **e} for s, p, u, n, x in b[["site", "page_id", "url", "block", "payload"]].itertuples(index=False) for e in _nodes(x or "", u)]
            yield pd.DataFrame(rows, columns=columns)

    return blocks.select("site", "page_id", "url", "block", "payload").mapInPandas(walk, NODE_SCHEMA)


def canonical_ids(aliases: DataFrame) -> DataFrame:
    """site, id, canonical of every id that stands for another: the end of its chain, or the least id of the cycle it runs into.

    ``aliases``: site, id, target. Of several targets the least counts. Each round joins the pointers with themselves, so a
    chain of n needs log2(n) rounds; rounds end as soon as no pointer leads to a pointing id.
    """
    use_shared_checkpoints(aliases.sparkSession)
    points = aliases.where("id <> target").groupBy("site", "id").agg(F.min("target").alias("at")).checkpoint()
    rounds = math.ceil(math.log2(points.count() + 1))
    sources = points.select("site", F.col("id").alias("at"))

    def jumped(state: DataFrame, least: bool) -> DataFrame:
        following = state.select("site", F.col("id").alias("at"), F.col("at").alias("next"), *([F.col("least").alias("next_least")] if least else []))
        joined = state.join(following, ["site", "at"], "left")
        kept = [F.least("least", "next_least").alias("least")] if least else []
        return joined.select("site", "id", F.coalesce("next", "at").alias("at"), *kept).checkpoint()

    state = points
    for _ in range(rounds):
        if state.join(sources, ["site", "at"], "left_semi").isEmpty():
            return state.select("site", "id", F.col("at").alias("canonical"))
        state = jumped(state, False)
    # what still points on after so many rounds is in a cycle or runs into one
    members = state.join(sources, ["site", "at"], "left_semi").select("site", F.col("at").alias("id")).distinct()
    cycle = points.join(members, ["site", "id"], "left_semi").withColumn("least", F.least("id", "at")).checkpoint()
    for _ in range(rounds):
        cycle = jumped(cycle, True)
    ends = cycle.select("site", F.col("id").alias("at"), "least")
    return state.join(ends, ["site", "at"], "left").select("site", "id", F.coalesce("least", "at").alias("canonical"))


def resolve_references(nodes: DataFrame) -> DataFrame:
    """Each reference of ``nodes`` (as of entity_nodes) with what it means.

    site, page_id, block, json_path, property, target_id (as written, absolute), canonical_id, target_page_id, target_block,
    target_path, target_type, target_name, resolved. A nested entity without an id is its path. An id means the entity
    that defines it: of those with this id, or one that stands for it, the first with a name by page, block and path, else
    the first. Only ids that some node of the site has are followed; sameAs links to other addresses are left out.
    """
    use_shared_checkpoints(nodes.sparkSession)
    nodes = nodes.checkpoint()
    named = nodes.where("own_id IS NOT NULL")
    known = named.select("site", F.col("own_id").alias("target_id")).distinct()
    refs = nodes.select("site", "page_id", "block", "json_path", "own_id", F.explode("refs").alias("r")).select("site", "page_id", "block", "json_path", "own_id", "r.*")
    same = refs.where("property = 'sameAs' AND own_id IS NOT NULL AND target_id IS NOT NULL").join(known, ["site", "target_id"], "left_semi")
    canon = canonical_ids(same.select("site", F.col("own_id").alias("id"), F.col("target_id").alias("target")))
    meant = canon.select("site", F.col("id").alias("own_id"), "canonical")
    place = F.struct(F.col("name").isNull().alias("unnamed"), "page_id", "block", "json_path")
    defined = (
        named.join(meant, ["site", "own_id"], "left")
        .groupBy("site", F.coalesce("canonical", "own_id").alias("canonical_id"))
        .agg(F.min_by(F.struct("page_id", "block", "json_path", "entity_type", "name"), place).alias("d"))
    )
    by_path = nodes.select("site", "page_id", "block", F.col("json_path").alias("target_path"), F.struct("page_id", "block", "json_path", "entity_type", "name").alias("nested"))
    linked = refs.drop("own_id").join(known.withColumn("known", F.lit(True)), ["site", "target_id"], "left").where("known OR property <> 'sameAs' OR target_path IS NOT NULL")
    linked = linked.join(meant.withColumnRenamed("own_id", "target_id"), ["site", "target_id"], "left").withColumn("canonical_id", F.coalesce("canonical", "target_id"))
    found = linked.join(defined, ["site", "canonical_id"], "left").join(by_path, ["site", "page_id", "block", "target_path"], "left").withColumn("t", F.coalesce("d", "nested"))
    return found.select(
        "site", "page_id", "block", "json_path", "property", "target_id", "canonical_id",
        F.col("t.page_id").alias("target_page_id"), F.col("t.block").alias("target_block"), F.col("t.json_path").alias("target_path"), F.col("t.entity_type").alias("target_type"), F.col("t.name").alias("target_name"),
        F.col("t").isNotNull().alias("resolved"),
    )


def attach_to_pages(pages: DataFrame, entities: DataFrame, references: DataFrame) -> DataFrame:
    """site, page_id, url, entities: each page with its entities in order, their sameAs links and resolved references nested.

    Pages without entities stay, with an empty list. A page has at most 200 entities for each of its blocks.
    """
    links = references.where("resolved").groupBy("page_id", "block", "json_path").agg(F.array_sort(F.collect_list(F.struct("property", "target_type", "target_name", "target_page_id"))).alias("refs"))
    full = entities.join(links, ["page_id", "block", "json_path"], "left")
    no_refs = F.expr("cast(array() AS array<struct<property:string,target_type:string,target_name:string,target_page_id:bigint>>)")
    one = F.struct("block", "json_path", "entity_type", "name", "same_as", F.coalesce("refs", no_refs).alias("refs"))
    nested = full.groupBy("page_id").agg(F.array_sort(F.collect_list(one)).alias("entities"))
    kind = nested.schema["entities"].dataType.simpleString()
    return pages.select("site", "page_id", "url").join(nested, "page_id", "left").withColumn("entities", F.coalesce("entities", F.expr(f"cast(array() AS {kind})")))


def page_duplicates(entities: DataFrame) -> DataFrame:
    """fingerprint, page_id, occurrences: entities that a page declares more than once."""
    return entities.where("fingerprint IS NOT NULL").groupBy("fingerprint", "page_id").agg(F.count("*").alias("occurrences")).where("occurrences > 1")


class EntityTables(NamedTuple):
    """All that is derived from structured data, by table."""

    entities: DataFrame
    references: DataFrame
    issues: DataFrame
    conflicts: DataFrame
    duplicates: DataFrame
    pages: DataFrame


def rebuild(versions: DataFrame) -> EntityTables:
    """Everything anew from the latest version of each page; nothing of older versions stays.

    ``versions``: site, page_id, url, html, crawled_at; of versions of the same time the one with the greater html counts.
    """
    latest = versions.groupBy("page_id").agg(F.max_by(F.struct("site", "url", "html"), F.struct("crawled_at", F.coalesce("html", F.lit("")).alias("h"))).alias("v")).select("page_id", "v.*")
    facts = parse_pages(latest.select("page_id", "url", "html")).join(latest.select("page_id", "site"), "page_id").select("site", "page_id", "url", F.posexplode("blocks").alias("block", "b"))
    use_shared_checkpoints(versions.sparkSession)
    blocks = facts.select("site", "page_id", "url", "block", "b.payload", "b.is_valid", "b.format").checkpoint()
    valid = blocks.where("is_valid")
    found = E.extract_entities(valid)
    references = resolve_references(entity_nodes(valid))
    return EntityTables(found, references, E.validate_blocks(blocks.where("format = 'json_ld'")), E.conflicts(found), page_duplicates(found), attach_to_pages(latest, found, references))
