"""Items written in attributes of the markup (microdata, RDFa Lite), in the shape of JSON-LD.

Fed by the one walk over a page: a stack of open elements, each with the item it opens and the properties it closes.
"""

from __future__ import annotations

import re
from collections import Counter

# How deep items nest; where a property's value stands instead of the element's text.
MAX_DEPTH = 6
_VALUE_ATTRIBUTE = {"a": "href", "link": "href", "area": "href", "img": "src", "audio": "src", "video": "src", "source": "src", "embed": "src", "iframe": "src", "track": "src", "object": "data"}
_VALUE_IF_THERE = {"time": "datetime", "data": "value", "meter": "value"}
#: Elements that end where the next of their kind starts.
_ENDS_ITSELF = frozenset("p li dt dd tr td th option".split())
#: Elements that end an open paragraph.
_ENDS_PARAGRAPH = frozenset("address article aside blockquote div dl fieldset footer form h1 h2 h3 h4 h5 h6 header hr main nav ol pre section table ul".split())


def short_name(name: str) -> str:
    """A type or property without its vocabulary's address or prefix."""
    name = name.strip()
    return re.split("[/#:]", name.rstrip("/#:"))[-1] or name


class _Item:
    """An item whose properties are known in page order; values of open elements are filled in later."""

    def __init__(self, types: list[str], identity: str | None, depth: int) -> None:
        self.types, self.identity, self.depth = types, identity, depth
        self.properties: list[tuple[str, list]] = []

    def folded(self) -> dict:
        """The item as JSON-LD has it; a property that is said again becomes a list."""
        out: dict = {"@type": self.types if len(self.types) > 1 else self.types[0]} if self.types else {}
        if self.identity:
            out["@id"] = self.identity
        said: dict[str, list] = {}
        for key, (value,) in self.properties:
            value = value.folded() if isinstance(value, _Item) else value
            if value is not None or key not in said:
                said.setdefault(key, []).append(value)
        for key, values in said.items():
            kept = [v for v in values if v is not None]
            out[key] = kept if len(kept) > 1 else (kept[0] if kept else None)
        return out


class AttributeItems:
    """Collects the top items of a page.

    An item starts at an element with ``scope``. With a property name it is the value of the item around it; without one
    inside another item, or named outside of any, it is left out with all it holds. Items deeper than MAX_DEPTH keep their
    type only.
    """

    def __init__(self, scope: str, kind: str, name: str) -> None:
        self.scope, self.kind, self.name = scope, kind, name
        self.items: list[_Item] = []
        self.open: list[tuple[str, _Item | None, list | None, int]] = []
        self.tags: Counter[str] = Counter()
        self.around: list[_Item] = []
        self.words: list[str] = []

    def start(self, tag: str, attributes: dict[str, str | None], is_void: bool) -> None:
        last = self.open[-1][0] if self.open else None
        if (tag == last and tag in _ENDS_ITSELF) or (last == "p" and tag in _ENDS_PARAGRAPH):
            self._close()
        names = (attributes.get(self.name) or "").split()
        parent = self.around[-1] if self.around else None
        item, slot = None, None
        if self.scope in attributes:
            types = [short_name(t) for t in (attributes.get(self.kind) or "").split()]
            item = _Item(types, attributes.get("itemid") or attributes.get("resource"), parent.depth + 1 if parent else 0)
            if parent is None and not names:
                self.items.append(item)
        if names and parent is not None and parent.depth < MAX_DEPTH:
            slot = [item if item is not None else self._stated(tag, attributes)]
            parent.properties += [(short_name(n), slot) for n in names]
        reads_text = slot is not None and slot[0] is _TEXT
        if is_void:
            if reads_text:
                slot[0] = ""
            return
        self.open.append((tag, item, slot if reads_text else None, len(self.words)))
        self.tags[tag] += 1
        if item is not None:
            self.around.append(item)

    def _stated(self, tag: str, attributes: dict[str, str | None]):
        if attributes.get("content") is not None:
            return attributes["content"]
        if tag in _VALUE_ATTRIBUTE:
            return attributes.get(_VALUE_ATTRIBUTE[tag])
        if tag in _VALUE_IF_THERE and attributes.get(_VALUE_IF_THERE[tag]) is not None:
            return attributes[_VALUE_IF_THERE[tag]]
        return _TEXT

    def text(self, data: str) -> None:
        if self.around and self.open[-1][0] not in ("script", "style"):
            self.words.append(data)

    def end(self, tag: str) -> None:
        if self.tags[tag]:
            while self._close() != tag:
                pass

    def _close(self) -> str:
        tag, item, slot, first = self.open.pop()
        self.tags[tag] -= 1
        if slot is not None:
            slot[0] = " ".join(" ".join(self.words[first:]).split())
        if item is not None:
            self.around.pop()
            if not self.around:
                self.words.clear()
        return tag

    def finish(self) -> list[dict]:
        """The items, after the end of the page."""
        while self.open:
            self._close()
        return [item.folded() for item in self.items]


#: Stands for a value that is the element's text.
_TEXT = object()
