"""Crawled HTML pages as one nested row of facts each; the checks over them are DataFrame operations.

Only the walk over the markup is Python (Arrow batches, narrow map): Spark has no HTML parser.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from html.parser import HTMLParser
from urllib.parse import urldefrag, urljoin

import pandas as pd
from pyspark.sql import DataFrame

from brandlens.sources.attribute_items import AttributeItems

# Fixed value: a block of structured data that is larger is not read.
MAX_BLOCK_BYTES = 64_000
SCHEMA = """page_id bigint, url string, title string, title_count int, lang string, charset string, has_doctype boolean,
meta map<string,string>, canonical string, canonical_count int, headings array<struct<level:int,position:int,text:string>>,
links array<struct<href:string,text:string,rel:string,in_navigation:boolean,position:int,target:string>>,
images array<struct<src:string,alt:string>>, blocks array<struct<payload:string,is_valid:boolean,error:string,format:string>>, text string, html_bytes int"""

_SKIP = frozenset("script style noscript template svg nav header footer aside form iframe".split())
_BLOCK = frozenset("p div li td th h1 h2 h3 h4 h5 h6 article section main ul ol table tr blockquote pre br title".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())


class _Walker(HTMLParser):
    def __init__(self, html: str) -> None:
        super().__init__(convert_charrefs=True)
        marks = html.lower()
        self.items = {}
        if "itemscope" in marks:
            self.items["microdata"] = AttributeItems("itemscope", "itemtype", "itemprop")
        if "typeof" in marks:
            self.items["rdfa"] = AttributeItems("typeof", "typeof", "property")
        self.title, self.titles, self.lang, self.charset, self.doctype, self.base = None, 0, None, None, False, None
        self.meta: dict[str, str] = {}
        self.canonicals: list[str] = []
        self.headings: list[dict] = []
        self.links: list[dict] = []
        self.images: list[dict] = []
        self.blocks: list[dict] = []
        self.text: list[str] = []
        self.skipped: list[str] = []
        self.held: list[tuple[str, list[str], dict]] = []

    def handle_decl(self, decl: str) -> None:
        self.doctype |= decl.lower().startswith("doctype")

    def handle_starttag(self, tag: str, attrs: list[tuple[str, str | None]]) -> None:
        a = {k: v or "" for k, v in attrs}
        for items in self.items.values():
            items.start(tag, dict(attrs), tag in _VOID)
        if tag == "html":
            self.lang = a.get("lang") or self.lang
        elif tag == "meta":
            self.charset = a.get("charset") or self.charset
            name = (a.get("name") or a.get("property") or "").lower()
            if name and "content" in a:
                self.meta.setdefault(name, a["content"])
        elif tag == "base":
            self.base = self.base or a.get("href")
        elif tag == "link" and "canonical" in a.get("rel", "").lower().split():
            self.canonicals.append(a.get("href", ""))
        elif tag == "img":
            self.images.append({"src": a.get("src") or a.get("data-src"), "alt": dict(attrs).get("alt") if "alt" in a else None})
        if tag in ("title", "a", "h1", "h2", "h3", "h4", "h5", "h6") or (tag == "script" and a.get("type", "").lower() == "application/ld+json"):
            self.titles += tag == "title"
            self.held.append((tag, [], a))
        if tag in _SKIP:
            self.skipped.append(tag)
        elif tag in _BLOCK:
            self.text.append("\n")

    def handle_endtag(self, tag: str) -> None:
        for items in self.items.values():
            items.end(tag)
        if tag in self.skipped:
            while self.skipped and self.skipped.pop() != tag:
                pass
        elif tag in _BLOCK:
            self.text.append("\n")
        for k in range(len(self.held) - 1, -1, -1):
            if self.held[k][0] == tag:
                self._said(*self.held.pop(k))
                break

    def _said(self, tag: str, parts: list[str], a: dict) -> None:
        text = " ".join("".join(parts).split())
        if tag == "title":
            self.title = self.title if self.title is not None else text
        elif tag == "a":
            if "href" in a:
                self.links.append({"href": a["href"], "text": text, "rel": a.get("rel", "").lower(), "in_navigation": any(s in ("nav", "header", "footer") for s in self.skipped), "position": len(self.links) + 1})
        elif tag == "script":
            raw = "".join(parts).strip()
            error = None
            if not raw:
                error = "empty block"
            elif len(raw.encode("utf-8", "replace")) > MAX_BLOCK_BYTES:
                error = "block too large"
            else:
                try:
                    json.loads(raw)
                except (ValueError, RecursionError) as e:
                    error = "invalid JSON: " + str(e)[:200]
            self.blocks.append({"payload": raw, "is_valid": error is None, "error": error, "format": "json_ld"})
        else:
            self.headings.append({"level": int(tag[1]), "position": len(self.headings) + 1, "text": text})

    def handle_data(self, data: str) -> None:
        for items in self.items.values():
            items.text(data)
        for _, parts, _ in self.held:
            parts.append(data)
        if not self.skipped and not (self.held and self.held[-1][0] == "title"):
            self.text.append(data)


def _resolved(base: str | None, href: str) -> str | None:
    """The absolute web address without its fragment, or null (mail, scripts, fragments of the page itself, broken addresses)."""
    href = href.strip()
    if not href or href.startswith("#"):
        return None
    try:
        target = urldefrag(urljoin(base or "", href)).url
    except ValueError:
        return None
    return target if target.lower().startswith(("http://", "https://")) else None


def _facts(page_id: int | None, url: str | None, html: str | None) -> dict:
    w = _Walker(html or "")
    w.feed(html or "")
    w.close()
    for tag, parts, a in w.held:
        if tag != "script":
            w._said(tag, parts, a)
    for form, items in w.items.items():
        found = items.finish()
        if found:
            w.blocks.append({"payload": json.dumps(found, ensure_ascii=False), "is_valid": True, "error": None, "format": form})
    lines = (" ".join(line.split()) for line in "".join(w.text).split("\n"))
    for link in w.links:
        link["target"] = _resolved(w.base or url, link["href"])
    return {
        "page_id": page_id, "url": url, "title": w.title, "title_count": w.titles, "lang": w.lang, "charset": w.charset, "has_doctype": w.doctype, "meta": w.meta,
        "canonical": w.canonicals[0] if w.canonicals else None, "canonical_count": len(w.canonicals), "headings": w.headings, "links": w.links, "images": w.images,
        "blocks": w.blocks, "text": "\n".join(x for x in lines if x), "html_bytes": len((html or "").encode("utf-8", "replace")),
    }


def parse_pages(pages: DataFrame) -> DataFrame:
    """One row of facts for each row of ``pages`` (page_id, url, html); a null html has none of them.

    Blocks of structured data come in page order, first those of JSON-LD, each valid or with its fault (empty, too large,
    no JSON); then one with the items of the page's microdata and one with those of its RDFa, in JSON-LD's shape.
    """

    def parse(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        columns = [c.split()[0] for c in "page_id url title title_count lang charset has_doctype meta canonical canonical_count headings links images blocks text html_bytes".split()]
        for b in batches:
            yield pd.DataFrame([_facts(*row) for row in b[["page_id", "url", "html"]].itertuples(index=False)], columns=columns)

    return pages.select("page_id", "url", "html").mapInPandas(parse, SCHEMA)
