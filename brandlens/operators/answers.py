"""The structure of an answer, and the sources it lists, as one fold over its lines.

Every line is classified on its own; a fold over the lines of the answer then carries what earlier lines decide: whether a
list of sources has begun, how far lists have counted, and which item an indented line continues. Nothing is shuffled.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# What ends a line, and the patterns of headings, list items, source headers, source entries, links, addresses and domains.
LINE_END = r"\r\n|[\n\r\x0B\x0C\x1C-\x1E\x{85}\x{2028}\x{2029}]"
HEADING = r"^\s{0,3}#{1,6}\s+(.*)$"
ORDERED = r"^\s{0,3}(?:\*\*)?(\d{1,3})[.)]\s*(?:\*\*)?\s*(.+)$"
BULLET = r"^\s{0,3}[-*•]\s+(.+)$"
SOURCE_HEADER = r"(?i)^\s*(?:\*\*)?(sources?|references?|citations?|further reading)(?:\*\*)?\s*:?\s*$"
FOOTNOTE = r"^\s*\[?(\d{1,3})\]?[.:)]?\s+(.*)$"
LINK = r"\[([^\]]{1,300})\]\((https?://[^\s)]+)\)"
ADDRESS = r"(?i)(?<![\w(\[])(https?://[^\s<>()\]\"']+[^\s<>()\]\"'.,;:!?])"
DOMAIN = r"(?i)(?<![\w@/.])((?:[a-z0-9-]+\.)+(?:com|org|net|io|co|ai|app|dev|uk|de|fr|eu|ca|au|us|info|biz)(?:\.[a-z]{2})?)(?![\w/])"
_UNICODE = "(?U)"
_BLOCK = "struct<kind:string,text:string,raw:string,index:int,ordered:boolean>"


def _has(text: Column, pattern: str) -> Column:
    return text.rlike(_UNICODE + pattern)


def _part(text: Column, pattern: str, group: int) -> Column:
    return F.regexp_extract(text, _UNICODE + pattern, group)


def plain(text: Column) -> Column:
    """Text without link targets and marks of emphasis."""
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(text, LINK, "$1"), r"[*_`]+", ""), _UNICODE + r"^\s+|\s+$", "")


def _line(raw: Column) -> Column:
    line = F.regexp_replace(raw, _UNICODE + r"\s+$", "")
    trimmed = F.regexp_replace(line, _UNICODE + r"^\s+", "")
    heading, entry = _part(line, HEADING, 1), F.when(_has(line, FOOTNOTE), _part(line, FOOTNOTE, 2)).otherwise(trimmed)
    is_heading, is_ordered, is_bullet = _has(line, HEADING), _has(line, ORDERED), _has(line, BULLET)
    kind = F.when(_has(line, SOURCE_HEADER), "header").when(is_heading, "heading").when(is_ordered, "ordered").when(is_bullet, "bullet").otherwise("other")
    said = F.when(is_heading, heading).when(is_ordered, _part(line, ORDERED, 2)).when(is_bullet, _part(line, BULLET, 1)).otherwise(trimmed)
    return F.struct(
        kind.alias("kind"),
        plain(said).alias("text"),
        said.alias("raw"),
        F.when(_has(entry, BULLET), _part(entry, BULLET, 1)).otherwise(entry).alias("entry"),
        (is_heading & _has(heading, SOURCE_HEADER)).alias("opens"),
        _has(raw, r"^[ \t]").alias("indented"),
        trimmed.alias("trimmed"),
    )


def answer_blocks(answers: DataFrame) -> DataFrame:
    """response_id, blocks, list_items, ordered_list, has_source_list of each answer.

    A block has kind (heading, item, paragraph, source), text, raw, index (of items and sources, from 1) and ordered. List
    items count on across the answer. After a line or heading that names sources, lines are sources until the next heading.
    An indented line after an item belongs to it. A null text has no blocks.
    """
    lines = F.filter(F.split(F.coalesce("text", F.lit("")), LINE_END), lambda x: _has(x, r"\S"))
    empty = F.struct(
        F.lit(False).alias("sources"), F.lit(False).alias("listed"), F.lit(False).alias("numbered"), F.lit(0).alias("items"), F.lit(0).alias("entries"), F.expr(f"cast(array() AS array<{_BLOCK}>)").alias("blocks")
    )

    def block(kind: str | Column, text: Column, raw: Column, index: Column, ordered: Column | bool = False) -> Column:
        kind = F.lit(kind) if isinstance(kind, str) else kind
        return F.struct(kind.alias("kind"), text.alias("text"), raw.alias("raw"), index.cast("int").alias("index"), (F.lit(ordered) if isinstance(ordered, bool) else ordered).alias("ordered"))

    def step(state: Column, line: Column) -> Column:
        kind, none = line["kind"], F.lit(None)
        header, heading = kind == "header", kind == "heading"
        source = ~header & ~heading & state["sources"]
        item = ~source & kind.isin("ordered", "bullet")
        last = F.try_element_at(state["blocks"], F.lit(-1))
        goes_on = (kind == "other") & ~source & line["indented"] & F.coalesce(last["kind"] == "item", F.lit(False))
        items, entries = state["items"] + item.cast("int"), state["entries"] + source.cast("int")
        longer = block("item", F.concat_ws(" ", last["text"], line["text"]), F.concat_ws(" ", last["raw"], line["trimmed"]), last["index"], last["ordered"])
        new = (
            F.when(heading, block("heading", line["text"], line["raw"], none))
            .when(source, block("source", line["entry"], line["entry"], entries))
            .when(item, block("item", line["text"], line["raw"], items, kind == "ordered"))
            .otherwise(block("paragraph", line["text"], line["raw"], none))
        )
        blocks = F.when(header, state["blocks"]).when(goes_on, F.concat(F.slice(state["blocks"], F.lit(1), F.size(state["blocks"]) - 1), F.array(longer))).otherwise(F.concat(state["blocks"], F.array(new)))
        return F.struct(
            F.when(header, True).when(heading, line["opens"]).otherwise(state["sources"]).alias("sources"),
            (state["listed"] | header | line["opens"]).alias("listed"),
            (state["numbered"] | (item & (kind == "ordered"))).alias("numbered"),
            items.alias("items"),
            entries.alias("entries"),
            blocks.alias("blocks"),
        )

    folded = F.aggregate(F.transform(lines, _line), empty, step)
    rows = answers.select("response_id", folded.alias("s"))
    return rows.select("response_id", "s.blocks", F.col("s.items").alias("list_items"), F.col("s.numbered").alias("ordered_list"), F.col("s.listed").alias("has_source_list"))


def _host(url: Column) -> Column:
    host = F.lower(F.regexp_extract(url, r"(?i)^https?://(?:[^/?#@]*@)?([^/:?#]+)", 1))
    return F.nullif(F.regexp_replace(host, r"^www\.", ""), F.lit(""))


_CITED = "array<struct<url:string,domain:string,anchor_text:string,citation_position:int,citation_type:string>>"


def listed_citations(answers: DataFrame) -> DataFrame:
    """response_id, citation_no (from 1), url, domain, anchor_text, citation_position, citation_type: what an answer cites, each once.

    Entries of its source lists come first, with their position, then links, addresses and bare domains of the rest. A
    source without an address is cited by its text and the first domain in it. Two citations are the same if their url is,
    or without one their domain.
    """

    def cite(url: Column, domain: Column, anchor: Column, position: Column, kind: str) -> Column:
        return F.struct(url.alias("url"), domain.alias("domain"), anchor.alias("anchor_text"), position.cast("int").alias("citation_position"), F.lit(kind).alias("citation_type"))

    none, text_of = F.lit(None).cast("string"), lambda t: F.nullif(F.substring(t, 1, 500), F.lit(""))

    def entry(b: Column) -> Column:
        links, anchors = F.regexp_extract_all(b["text"], F.lit(LINK), F.lit(2)), F.regexp_extract_all(b["text"], F.lit(LINK), F.lit(1))
        urls = F.when(F.size(links) > 0, links).otherwise(F.regexp_extract_all(b["text"], F.lit(_UNICODE + ADDRESS), F.lit(1)))
        rest = text_of(plain(F.regexp_replace(b["text"], LINK, "")))
        found = F.transform(urls, lambda u, i: cite(u, _host(u), F.coalesce(F.nullif(F.get(anchors, F.array_position(links, u).cast("int") - 1), F.lit("")), rest), b["index"], "source_list"))
        bare = cite(none, F.nullif(F.lower(_part(b["text"], DOMAIN, 1)), F.lit("")), text_of(b["text"]), b["index"], "source_list")
        return F.when(F.size(urls) > 0, found).otherwise(F.array(bare))

    body = F.array_join(F.transform(F.filter("blocks", lambda b: b["kind"] != "source"), lambda b: b["raw"]), "\n")
    body = F.when(body == "", F.coalesce("text", F.lit(""))).otherwise(body)
    without_links = F.regexp_replace("body", LINK, " ")
    without_urls = F.regexp_replace(without_links, _UNICODE + ADDRESS, " ")
    anchors, links = F.regexp_extract_all("body", F.lit(LINK), F.lit(1)), F.regexp_extract_all("body", F.lit(LINK), F.lit(2))
    every = F.concat(
        F.flatten(F.transform(F.filter("blocks", lambda b: b["kind"] == "source"), entry)).cast(_CITED),
        F.transform(links, lambda u, i: cite(u, _host(u), F.regexp_replace(F.get(anchors, i), _UNICODE + r"^\s+|\s+$", ""), F.lit(None), "markdown_link")).cast(_CITED),
        F.transform(F.regexp_extract_all(without_links, F.lit(_UNICODE + ADDRESS), F.lit(1)), lambda u: cite(u, _host(u), none, F.lit(None), "explicit_url")).cast(_CITED),
        F.transform(F.regexp_extract_all(without_urls, F.lit(_UNICODE + DOMAIN), F.lit(1)), lambda d: cite(none, F.lower(d), none, F.lit(None), "domain_reference")).cast(_CITED),
    )
    blocks = answer_blocks(answers.select(F.struct("response_id", "text").alias("response_id"), "text")).select("response_id.*", "blocks")
    rows = blocks.withColumn("body", body).select("response_id", every.alias("cited"))
    # the first of each key, within the array: an answer is never shuffled
    key = lambda c: F.coalesce(F.concat(F.lit("u"), c["url"]), F.concat(F.lit("d"), c["domain"]), F.lit("none"))
    keyed = rows.withColumn("keys", F.transform("cited", key))
    first = F.filter("cited", lambda c, i: F.array_position(F.col("keys"), key(c)) == i + 1)
    return keyed.select("response_id", F.posexplode(first).alias("n", "c")).select("response_id", (F.col("n") + 1).alias("citation_no"), "c.*")
