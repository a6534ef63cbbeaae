"""Main text of web pages: a recurrent labeller of text blocks.

A page becomes the sequence of its leaf blocks (text between block-level tags). Each block is read as a vector of its tag
path (tags, class and id words of its ancestors, hashed), a vector of its hashed words and a few measures. A bidirectional
LSTM in numpy reads the whole sequence, so a label depends on all of the page. It is trained here, on pages that a
generator with a fixed seed lays out in many ways; no page of the corpus and no label is needed.
"""

from __future__ import annotations

import html
import random
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from brandlens.llm.spark_files import small_batches

PATH_ROWS, WORD_ROWS, PATH_DIMS, WORD_DIMS, MEASURES, HIDDEN = 4096, 32768, 24, 8, 8, 24
#: Ancestors whose tags make up a path vector, nearest first.
ANCESTORS = 32

_ATTRIBUTES = r"""(?:"[^"]*"|'[^']*'|[^'"<>])*+"""
_TAG = re.compile(
    rf"<!--.*?(?:-->|\Z)|<(script|style|title|textarea)\b{_ATTRIBUTES}>.*?(?:</\1\s*>|\Z)|<(/?)([a-zA-Z][^\s/>]*)({_ATTRIBUTES})>|<[!?/][^<>]*>|<[a-zA-Z][^<>]*>",
    re.S | re.I,
)
_NAMES = re.compile(r"""\b(?:class|id|role)\s*=\s*("[^"]*"|'[^']*'|[^\s>]+)""", re.I)
_PIECES = re.compile(r"[a-z]+|[A-Z][a-z]*")
_WORD = re.compile(r"\w+")
_INLINE = frozenset("a abbr acronym b bdi bdo big cite code data del dfn em font i ins kbd label mark nobr q rp rt ruby s samp small span strike strong sub sup time tt u var wbr object canvas audio video picture map".split())
#: Everything inside these is part of the sentence, up to their end or to a tag that ends them.
_FOREIGN = frozenset(("svg", "math"))
_ENDS_FOREIGN = frozenset("article aside blockquote body center dd div dl dt footer form h1 h2 h3 h4 h5 h6 header hr li main nav ol p pre section table td th tr ul".split())
_VOID = frozenset("area base br col embed hr img input link meta param source track wbr".split())
_HIDDEN = frozenset("button select option datalist head".split())
_CLOSED_BY_SAME = frozenset("p li td th tr dt dd option h1 h2 h3 h4 h5 h6".split())


def _hash(kind: str, name: str, rows: int) -> int:
    return zlib.crc32(f"{kind}{name}".encode("utf-8", "surrogatepass")) % rows


@dataclass
class Block:
    text: str
    path: list[int]
    linked: int
    depth: int


def blocks_of(page: str | None) -> list[Block]:
    """The leaf blocks of a page in order, character references decoded and white space made one space; empty ones dropped."""
    page = page or ""
    stack: list[tuple[str, list[int]]] = []
    found: list[Block] = []
    held: list[str] = []
    linked = links = hidden = foreign = 0

    def flush() -> None:
        nonlocal linked
        if held:
            text = " ".join("".join(held).split())
            if text:
                path = [x for _, own in stack[: -ANCESTORS - 1 : -1] for x in own]
                if stack:
                    path += [_hash("leaf ", stack[-1][0], PATH_ROWS)]
                found.append(Block(text, path or [0], linked, len(stack)))
            held.clear()
        linked = 0

    def pop_to(k: int) -> None:
        nonlocal hidden
        for name, _ in stack[k:]:
            hidden -= name in _HIDDEN
        del stack[k:]

    def say(raw: str) -> None:
        nonlocal linked
        if not hidden and raw:
            plain = html.unescape(raw) if "&" in raw else raw
            held.append(plain)
            if links:
                linked += len(plain.strip())

    at = 0
    for m in _TAG.finditer(page):
        say(page[at : m.start()])
        at = m.end()
        name = (m[3] or "").lower()
        if not name:
            continue
        if name in _FOREIGN:
            foreign = max(0, foreign + (-1 if m[2] else not m[4].rstrip().endswith("/")))
            held.append(" ")
            continue
        if foreign and name not in _ENDS_FOREIGN:
            continue
        foreign = 0
        if name in _INLINE:
            links = max(0, links + (-1 if m[2] else 1)) if name == "a" else links
            continue
        if name == "br":
            held.append(" ")
            continue
        flush()
        links = 0
        if m[2]:
            for k in range(len(stack) - 1, -1, -1):
                if stack[k][0] == name:
                    pop_to(k)
                    break
            continue
        if name in _VOID:
            continue
        while stack and ((stack[-1][0] == name and name in _CLOSED_BY_SAME) or stack[-1][0] in ("p", "head") or (stack[-1][0][0] == "h" and stack[-1][0][1:].isdigit())):
            pop_to(len(stack) - 1)
        own = [_hash("tag ", name, PATH_ROWS)]
        for value in _NAMES.findall(m[4] or ""):
            own += [_hash("name ", piece.lower(), PATH_ROWS) for piece in _PIECES.findall(value)]
        stack.append((name, own))
        hidden += name in _HIDDEN
    say(page[at:])
    flush()
    return found


def measures(found: list[Block]) -> np.ndarray:
    out = np.zeros((len(found), MEASURES), np.float32)
    for i, b in enumerate(found):
        n = len(b.text)
        out[i] = (
            np.log1p(n) / 6,
            np.log1p(b.text.count(" ")) / 4,
            min(1.0, b.linked / n),
            min(1.0, 20 * sum(map(b.text.count, ".,;:!?")) / n),
            b.text[-1] in ".!?…\"»”",
            i / len(found),
            min(b.depth, 20) / 10,
            any(c in b.text[:40] for c in "©|»•"),
        )
    return out


@dataclass
class Page:
    """The inputs of one page: path and word rows with the block of each, and measures."""

    path: np.ndarray
    path_of: np.ndarray
    word: np.ndarray
    word_of: np.ndarray
    measures: np.ndarray


def read_page(found: list[Block]) -> Page:
    words = [[zlib.crc32(w.encode("utf-8", "surrogatepass")) % WORD_ROWS for w in _WORD.findall(b.text.lower())] or [0] for b in found]
    number = np.arange(len(found))
    return Page(
        np.array([x for b in found for x in b.path], np.int64),
        np.repeat(number, [len(b.path) for b in found]),
        np.array([x for w in words for x in w], np.int64),
        np.repeat(number, [len(w) for w in words]),
        measures(found),
    )


def _sums(table: np.ndarray, rows: np.ndarray, of: np.ndarray, n: int, power: float) -> tuple[np.ndarray, np.ndarray]:
    """Per block the sum of its rows of ``table`` over count ** power, and those scales. ``of`` is sorted, no block is empty."""
    starts = np.searchsorted(of, np.arange(n))
    counts = np.diff(np.append(starts, len(of)))
    scale = (1 / counts**power).astype(np.float32)
    return np.add.reduceat(table[rows], starts, axis=0) * scale[:, None], scale


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-x))


class Labeller:
    """Embeddings of path and word rows, an LSTM in each direction and a logistic output for every block."""

    def __init__(self, seed: int = 5):
        rng = np.random.default_rng(seed)
        inputs = PATH_DIMS + WORD_DIMS + MEASURES
        draw = lambda *s, scale: rng.normal(0, scale, s).astype(np.float32)
        self.p = {"path": draw(PATH_ROWS, PATH_DIMS, scale=0.3), "word": draw(WORD_ROWS, WORD_DIMS, scale=0.01)}
        for d in "fb":
            self.p[f"x{d}"] = draw(inputs, 4 * HIDDEN, scale=inputs**-0.5)
            self.p[f"h{d}"] = draw(HIDDEN, 4 * HIDDEN, scale=HIDDEN**-0.5)
            self.p[f"c{d}"] = np.concatenate([np.zeros(HIDDEN), np.ones(HIDDEN), np.zeros(2 * HIDDEN)]).astype(np.float32)
        self.p["o"] = draw(2 * HIDDEN + inputs, scale=0.1)
        self.p["ob"] = np.zeros(1, np.float32)

    def _inputs(self, pages: list[Page]) -> tuple[np.ndarray, np.ndarray, list]:
        """x[time, page, inputs] and the mask[time, page] of blocks that are there."""
        most = max(len(p.measures) for p in pages)
        x = np.zeros((most, len(pages), PATH_DIMS + WORD_DIMS + MEASURES), np.float32)
        mask = np.zeros((most, len(pages)), np.float32)
        scales = []
        for k, p in enumerate(pages):
            n = len(p.measures)
            path, ps = _sums(self.p["path"], p.path, p.path_of, n, 0.5)
            word, ws = _sums(self.p["word"], p.word, p.word_of, n, 1.0)
            x[:n, k] = np.hstack([path, word, p.measures])
            mask[:n, k] = 1
            scales.append((ps, ws))
        return x, mask, scales

    def _run(self, x: np.ndarray, mask: np.ndarray, d: str) -> tuple[np.ndarray, list]:
        """Hidden states in page order; past a page's end the state stays 0, so the backward pass starts at its last block."""
        t_all, n = mask.shape
        z = x @ self.p[f"x{d}"] + self.p[f"c{d}"]
        h, c = np.zeros((n, HIDDEN), np.float32), np.zeros((n, HIDDEN), np.float32)
        out, saved = np.zeros((t_all, n, HIDDEN), np.float32), [None] * t_all
        for t in range(t_all) if d == "f" else range(t_all - 1, -1, -1):
            a = z[t] + h @ self.p[f"h{d}"]
            i, f, o = (_sigmoid(a[:, k * HIDDEN : (k + 1) * HIDDEN]) for k in range(3))
            g = np.tanh(a[:, 3 * HIDDEN :])
            m = mask[t][:, None]
            c_new = (f * c + i * g) * m
            tc = np.tanh(c_new)
            saved[t] = (i, f, o, g, c, tc, h, m)
            c, h = c_new, o * tc * m
            out[t] = h
        return out, saved

    def logits(self, pages: list[Page]) -> list[np.ndarray]:
        x, mask, _ = self._inputs(pages)
        both = np.concatenate([self._run(x, mask, "f")[0], self._run(x, mask, "b")[0], x], axis=2)
        z = both @ self.p["o"] + self.p["ob"]
        return [z[: len(p.measures), k] for k, p in enumerate(pages)]

    def gradients(self, pages: list[Page], labels: list[np.ndarray]) -> dict[str, np.ndarray]:
        x, mask, scales = self._inputs(pages)
        runs = {d: self._run(x, mask, d) for d in "fb"}
        both = np.concatenate([runs["f"][0], runs["b"][0], x], axis=2)
        y = np.zeros_like(mask)
        for k, own in enumerate(labels):
            y[: len(own), k] = own
        dz = ((_sigmoid(both @ self.p["o"] + self.p["ob"]) - y) * mask / mask.sum()).astype(np.float32)
        grad = {"o": np.einsum("tn,tnd->d", dz, both), "ob": dz.sum(keepdims=True).reshape(1)}
        d_both = dz[:, :, None] * self.p["o"]
        dx = d_both[:, :, 2 * HIDDEN :].copy()
        for number, d in enumerate("fb"):
            d_out = d_both[:, :, number * HIDDEN : (number + 1) * HIDDEN]
            dh, dc = np.zeros_like(d_out[0]), np.zeros_like(d_out[0])
            da_all = np.zeros((*mask.shape, 4 * HIDDEN), np.float32)
            g_h = np.zeros_like(self.p[f"h{d}"])
            steps = range(len(mask))
            for t in reversed(steps) if d == "f" else steps:
                i, f, o, g, c, tc, h, m = runs[d][1][t]
                dh = (dh + d_out[t]) * m
                dc = (dc + dh * o * (1 - tc * tc)) * m
                da = np.hstack([dc * g * i * (1 - i), dc * c * f * (1 - f), dh * tc * o * (1 - o), dc * i * (1 - g * g)])
                da_all[t] = da
                g_h += h.T @ da
                dh, dc = da @ self.p[f"h{d}"].T, dc * f
            flat = da_all.reshape(-1, 4 * HIDDEN)
            grad |= {f"h{d}": g_h, f"x{d}": x.reshape(len(flat), -1).T @ flat, f"c{d}": flat.sum(axis=0)}
            dx += (flat @ self.p[f"x{d}"].T).reshape(x.shape)
        grad["path"], grad["word"] = np.zeros_like(self.p["path"]), np.zeros_like(self.p["word"])
        for k, p in enumerate(pages):
            own = dx[: len(p.measures), k]
            np.add.at(grad["path"], p.path, (own[:, :PATH_DIMS] * scales[k][0][:, None])[p.path_of])
            np.add.at(grad["word"], p.word, (own[:, PATH_DIMS : PATH_DIMS + WORD_DIMS] * scales[k][1][:, None])[p.word_of])
        return grad


#: Names that page builders give to parts of a page, for the generator.
_MAIN = "content article post entry story main body text post-content entry-content article-body story-body page-content main-content blog-post single".split()
_PARTS = {
    "menu": "nav menu navbar navigation main-nav breadcrumb breadcrumbs tabs topnav links pagination pager toc skip".split(),
    "header": "header masthead site-header top top-bar topbar branding logo page-header hero".split(),
    "footer": "footer site-footer bottom copyright colophon foot legal credits page-footer".split(),
    "sidebar": "sidebar side aside widget rail right-column left-column related popular trending recommended more secondary archive tags tagcloud author-box".split(),
    "notice": "notice cookie cookies cookie-notice cookie-banner consent gdpr alert warning message popup modal overlay announcement disclaimer paywall banner info-bar".split(),
    "advert": "ad ads advert adverts advertisement ad-slot adsbygoogle sponsor sponsored promo promotion banner-ad ad-container commercial affiliate".split(),
    "form": "form newsletter subscribe subscription signup login search search-form contact-form register feedback poll".split(),
    "comments": "comments comment comment-list reader-comments responses replies reply discussion disqus thread comment-body user-comments".split(),
    "share": "share sharing social social-links share-buttons follow toolbar".split(),
}
_SAID = {
    "menu": "Home About Contact News Sport Shop Products Services Blog Next Previous More Start Menu Accueil Inicio Startseite".split(),
    "header": "Welcome Menu Search Log in Sign up Daily News Today Edition Your account".split(),
    "footer": "© Copyright 2024 All rights reserved Privacy policy Terms of use Imprint Contact Sitemap Powered by".split(),
    "sidebar": "Related articles Most read Popular posts Tags Categories Archives Recent Trending now You may also like".split(),
    "notice": "We use cookies to improve your experience Accept all Learn more Please enable JavaScript Notice This site".split(),
    "advert": "Advertisement Sponsored Buy now Sale Special offer Save today Click here Free shipping Promo".split(),
    "form": "Subscribe to our newsletter Email address Password Log in Search Submit Send Name Your message Sign up".split(),
    "comments": "Comments Reply Report says wrote Great post Thanks I agree ago Leave a comment replies Anonymous".split(),
    "share": "Share on Facebook Twitter Tweet Email Print Follow us Like".split(),
}
_TAGS = {"menu": "nav ul div", "header": "header div", "footer": "footer div", "sidebar": "aside div section", "notice": "div section aside p noscript", "advert": "div ins aside section p iframe template", "form": "form form div", "comments": "section div ol article", "share": "div ul p"}
#: Put before every word of the main text of a generated page, and taken out again.
_MARK = "\x01"


class _Pages:
    """Lays out pages at random; words are invented, so that no label hangs on the words of the main text."""

    def __init__(self, seed: int):
        self.r = random.Random(seed)
        r = self.r
        parts = ["".join(r.choice("bcdfghklmnprstvwzaeiouäéñ") for _ in range(r.randint(1, 3))) + r.choice("aeiouéy") for _ in range(160)]
        self.vocabulary = ["".join(r.choice(parts) for _ in range(r.randint(1, 4))) for _ in range(4000)]

    def sentence(self, least: int = 4, most: int = 22) -> str:
        r = self.r
        words = [r.choice(self.vocabulary) + ("," if r.random() < 0.08 else "") for _ in range(r.randint(least, most))]
        return " ".join(words).capitalize().rstrip(",") + r.choice("....?!")

    def main(self, text: str) -> str:
        return " ".join(_MARK + w for w in text.split())

    def prose(self, short: float = 0.15) -> str:
        r = self.r
        x = r.random()
        if x < short:
            return self.sentence(1, 8)
        if x > 0.8:
            return self.odd()
        return " ".join(self.sentence() for _ in range(r.randint(1, 7)))

    def odd(self) -> str:
        """Text that doesn't read as prose: lists, tables, shouting, code, legal lines, phrases that stand in other parts."""
        r = self.r
        words = [r.choice(self.vocabulary) for _ in range(r.randint(1, 40))]
        return r.choice(
            [
                lambda: " | ".join(words),
                lambda: " ".join(w + r.choice(["***", "###", "$$$", "%%%", "!!"]) for w in words),
                lambda: " ".join(words).upper(),
                lambda: ", ".join(words),
                lambda: " ".join(r.choice(_SAID[r.choice(list(_SAID))]) for _ in range(r.randint(1, 6))),
                lambda: r.choice(["All rights reserved.", "Copyright 2024.", "Licensed under the terms of this license.", "Subscribe now.", "Comments are closed.", "Read more"]),
                lambda: f"{words[0]}({', '.join(words[1:4])}) = {r.randint(0, 10**6)};",
                lambda: f"{words[0]}.{r.randint(1, 99)}@example.com +1 ({r.randint(100, 999)}) 555-{r.randint(1000, 9999)} {' '.join(words[:8])}",
            ]
        )()

    def name(self, names: list[str]) -> str:
        r = self.r
        if r.random() < 0.06:
            return ""
        value = r.choice(names) + r.choice(["", "", "", " clearfix", " col-md-8", " block", "-wrap", "-inner", " c1"])
        return f' {r.choice(["class", "class", "class", "id"])}="{value}"'

    def junk(self, kind: str) -> str:
        r = self.r
        tag = r.choice(_TAGS[kind].split())
        plain = tag in ("nav", "header", "footer", "aside", "form") and r.random() < 0.6
        attributes = "" if plain else self.name(_PARTS[kind])
        if not attributes and tag in ("div", "section", "p", "ul", "ol", "article", "ins"):
            attributes = f' class="{r.choice(_PARTS[kind])}"'
        said = lambda: " ".join(r.choice(_SAID[kind]) for _ in range(r.randint(1, 6))) if r.random() < 0.5 else r.choice([self.sentence(1, 4).rstrip(".?!"), self.sentence(), self.prose()])
        n = r.randint(1, 5)
        if kind in ("menu", "share") or (kind in ("sidebar", "footer") and r.random() < 0.5):
            inner = "".join(f'<li><a href="/x">{said()}</a></li>' for _ in range(n + 1))
            inner = inner if tag == "ul" else f"<ul>{inner}</ul>" if r.random() < 0.7 else "".join(f'<a href="/x">{said()}</a> ' for _ in range(n))
        elif kind == "form":
            inner = "".join(r.choice([f"<label>{said()}</label><input name=q>", f"<p>{said()}</p>", f"<button>{said()}</button>", f"<div>{said()}</div>", f"<h3>{said()}</h3>"]) for _ in range(n))
        elif kind == "comments":
            inner = r.choice(["", "<h2>Comments</h2>", f"<h3>{n} replies</h3>"]) + "".join(
                r.choice([f'<div class="comment"><p>{self.prose(0.3)}</p></div>', f"<p>{self.prose(0.3)}</p>", f"<li><b>{said()}</b> {self.prose(0.3)}</li>", f'<article class="comment"><p>{self.prose(0.3)}</p></article>'])
                for _ in range(n)
            )
        elif tag == "p" or r.random() < 0.45:
            inner = said()
        else:
            inner = "".join(r.choice([f"<p>{said()}</p>", f"<h3>{said()}</h3>", f"<div>{said()}</div>", f"<p>{self.prose()}</p>", f'<a href="/x">{said()}</a>']) for _ in range(r.randint(1, 4)))
        return f"<{tag}{attributes}>{inner}</{tag}>"

    def article(self) -> str:
        r = self.r
        main = lambda text: self.main(text)
        out = []
        if r.random() < 0.85:
            head = f"<{(h := r.choice(['h1', 'h1', 'h2']))}>{main(self.sentence(2, 12).rstrip('.'))}</{h}>"
            out.append(f"<header>{head}</header>" if r.random() < 0.1 else head)
        for _ in range(r.choice([1, 1, 2, 3, 4, 5, 6, 8, 12])):
            x = r.random()
            if x < 0.7:
                out.append(r.choice([f"<p>{main(self.prose())}</p>", f"<p>{main(self.prose())}", f"<p><b>{main(self.prose())}<br>"]))
            elif x < 0.76:
                out.append(f"<h2>{main(self.sentence(1, 7).rstrip('.'))}</h2>")
            elif x < 0.82:
                out.append("<ul>" + "".join(f"<li>{main(self.prose(0.6))}</li>" for _ in range(r.randint(2, 5))) + "</ul>")
            elif x < 0.87:
                out.append(f"<blockquote>{main(self.prose())}</blockquote>")
            elif x < 0.9:
                out.append("<table>" + "".join(f"<tr><td>{main(self.sentence(1, 3))}</td><td>{main(self.sentence(1, 3))}</td></tr>" for _ in range(2)) + "</table>")
            elif x < 0.93:
                out.append(f"<pre>{main(self.prose())}</pre>")
            elif x < 0.97:
                out.append(f"<div>{main(self.prose())}</div>")
            else:
                tag = r.choice(["math", "svg", "object", "canvas", "video", "noscript", "template", "iframe"])
                out.append(f"<p>{main(self.prose())} <{tag}>{main(self.sentence(1, 3))}</{tag}> {main(self.sentence())}</p>")
            if r.random() < 0.1:
                out.append(self.junk(r.choice(["advert", "share", "sidebar", "form", "notice"])))
        body = "".join(out)
        x = r.random()
        if x < 0.45:
            return f"<article{self.name(_MAIN) if r.random() < 0.3 else ''}>{body}</article>"
        if x < 0.6:
            return f"<main>{body}</main>"
        tag = r.choice(["div", "div", "section", "td"])
        inner = f'<{tag} class="{r.choice(_MAIN)}">{body}</{tag}>' if x < 0.92 else f"<{tag}>{body}</{tag}>"
        return inner if tag != "td" else f"<table><tr>{inner}</tr></table>"

    def page(self) -> str:
        r = self.r
        some = lambda kinds, p: "".join(self.junk(k) for k in kinds if r.random() < p)
        above = some(r.sample(["notice", "header", "menu", "advert", "form", "menu", "share"], 7), 0.4)
        below = some(r.sample(["share", "comments", "sidebar", "advert", "form", "menu", "notice"], 7), 0.35) + some(["footer"], 0.8)
        middle = self.article()
        if r.random() < 0.4:
            middle = f'<div class="{r.choice(["container", "wrapper", "row", "page", "layout", "site", "inner"])}">{some(["sidebar", "menu", "advert"], 0.25)}{middle}{some(["sidebar", "comments", "advert"], 0.25)}</div>'
        return f"<html><head><title>x</title><script>a</script></head><body>{above}{middle}{below}</body></html>"


def generated(n: int, seed: int) -> tuple[list[Page], list[np.ndarray]]:
    """n generated pages as inputs, and whether each of their blocks is main text."""
    make, pages, labels = _Pages(seed), [], []
    for _ in range(n):
        found = blocks_of(make.page())
        if found:
            labels.append(np.array([_MARK in b.text for b in found], np.float32))
            for b in found:
                b.text = b.text.replace(_MARK, "") or "-"
            pages.append(read_page(found))
    return pages, labels


@lru_cache(maxsize=2)
def train_labeller(n_pages: int = 2400, epochs: int = 6, batch: int = 32, seed: int = 5) -> Labeller:
    """Adam on cross-entropy over ``n_pages`` generated pages; the same on every call, so it is kept."""
    pages, labels = generated(n_pages, seed)
    model, rng = Labeller(seed), np.random.default_rng(seed)
    m, v, step = {k: np.zeros_like(x) for k, x in model.p.items()}, {k: np.zeros_like(x) for k, x in model.p.items()}, 0
    for epoch in range(epochs):
        order = sorted(rng.permutation(len(pages)), key=lambda k: len(pages[k].measures) // 8)
        starts = rng.permutation(np.arange(0, len(order), batch))
        for a in starts:
            own = order[a : a + batch]
            grad = model.gradients([pages[k] for k in own], [labels[k] for k in own])
            step += 1
            rate = 0.01 * (1 - epoch / epochs) + 0.0005
            for k, g in grad.items():
                m[k] = 0.9 * m[k] + 0.1 * g
                v[k] = 0.99 * v[k] + 0.01 * g * g
                model.p[k] -= (rate * (m[k] / (1 - 0.9**step)) / (np.sqrt(v[k] / (1 - 0.99**step)) + 1e-7)).astype(np.float32)
    return model


def main_blocks(pages: list[list[Block]], model: Labeller) -> list[list[bool]]:
    """Whether each block of each page is main text; pages of like length are read together."""
    out: list[list[bool]] = [[] for _ in pages]
    order = sorted((k for k in range(len(pages)) if pages[k]), key=lambda k: len(pages[k]))
    a = 0
    while a < len(order):
        b = a + 1
        while b < len(order) and b - a < 256 and len(pages[order[b]]) * (b - a) < 20_000:
            b += 1
        own = order[a:b]
        for k, z in zip(own, model.logits([read_page(pages[k]) for k in own]), strict=True):
            out[k] = (z > 0).tolist()
        a = b
    return out


def extract_text(pages: DataFrame, model: Labeller | None = None, id_col: str = "page_id") -> DataFrame:
    """page id, url, text (main blocks joined by a space, empty if none) and blocks (text, whether main) of every page.

    A null or empty html has no block and empty text; repeated rows are read each; other columns are ignored; an empty
    table gives an empty result. The whole html is read. A narrow map, no shuffle.
    """
    small_batches(pages.sparkSession)
    model = model or train_labeller()
    kind = pages.schema[id_col].dataType.simpleString()
    # a map, not a closure over numpy objects only: the labeller is some 250 KB and goes with the task
    schema = f"`{id_col}` {kind}, url string, text string, blocks array<struct<text: string, main: boolean>>"
    held = pa.list_(pa.struct([("text", pa.string()), ("main", pa.bool_())]))

    def extract(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for first in range(0, batch.num_rows, 1024):
                part = batch.slice(first, 1024)
                found = [blocks_of(x) for x in part.column(2).to_pylist()]
                marks = main_blocks(found, model)
                text = [" ".join(b.text for b, on in zip(bs, ms, strict=True) if on) for bs, ms in zip(found, marks, strict=True)]
                rows = [[{"text": b.text, "main": on} for b, on in zip(bs, ms, strict=True)] for bs, ms in zip(found, marks, strict=True)]
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), pa.array(text, pa.string()), pa.array(rows, held)], names=[id_col, "url", "text", "blocks"])

    return pages.select(id_col, "url", "html").mapInArrow(extract, schema)


def op3_html_extraction(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(spark.read.parquet(f"{sf_dir}/pages.parquet")).selectExpr("page_id", "url", "text", "CAST(length(text) AS BIGINT) AS n_chars")
