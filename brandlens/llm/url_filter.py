"""URL filter: host-and-path rules and wildcard globs run as one bit-parallel automaton.

Every rule becomes a glob over the canonical form ``host NUL path``. All globs are packed side by side into the
words of a Shift-And machine; one step on one byte moves every glob of every URL of the batch. ``*`` stays within
the host or the path, ``**`` crosses both.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

#: Rules of the registered query: (verdict, rule).
RULES = (("allow", "org/"), ("block", "example.org/es/"), ("block", "example.org/en/1"), ("allow", "com/fr/"), ("block", "com/de/"))
#: Globs that block a URL on which no rule decides.
BLOCKED = ("*cheap-pills*\0**", "*casino*\0**", "*viagra*\0**", "*porn*\0**", "**/wp-login*", "**.exe", "**.apk")
_SEP = 0


def canonical(url: str | None) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path; both empty for null or without ``://``."""
    head, mark, rest = (url or "").partition("://")
    if not mark:
        return "", ""
    for cut in "?#":
        rest = rest.partition(cut)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


_LOWER = {c: c + 32 for c in range(ord("A"), ord("Z") + 1)}


class Automaton:
    """All globs as bit masks: ``ahead[c]`` moves a state on over byte c, ``stay[c]`` lets a star keep its state."""

    def __init__(self, globs: Sequence[str]):
        self.n = len(globs)
        items: list[tuple[list[int], dict[int, bool]]] = []
        for glob in globs:
            raw, literal, stars, i = glob.encode(), [], {}, 0
            while i < len(raw):
                if raw[i] == ord("*"):
                    both = raw[i : i + 2] == b"**"
                    stars[len(literal)] = both or stars.get(len(literal), False)
                    i += 1 + both
                else:
                    literal.append(raw[i])
                    i += 1
            items.append((literal, stars))
        bits = sum(len(literal) + 1 for literal, _ in items)
        self.words = max(1, -(-bits // 64))
        self.start = np.zeros(self.words, np.uint64)
        self.ahead = np.zeros((256, self.words), np.uint64)
        self.stay = np.zeros((256, self.words), np.uint64)
        self.final: list[tuple[int, np.uint64]] = []
        at = 0
        for literal, stars in items:
            self.start[at // 64] |= np.uint64(1 << at % 64)
            for k, byte in enumerate(literal):
                self.ahead[byte, (at + k) // 64] |= np.uint64(1 << (at + k) % 64)
            for k, both in stars.items():
                where, bit = (at + k) // 64, np.uint64(1 << (at + k) % 64)
                keep = self.stay[_SEP, where]
                self.stay[:, where] |= bit
                if not both:
                    self.stay[_SEP, where] = keep
            at += len(literal) + 1
            self.final.append(((at - 1) // 64, np.uint64(1 << (at - 1) % 64)))

    def run(self, texts: Sequence[bytes]) -> np.ndarray:
        """Whether each glob fits each whole text: bool[len(texts), globs]."""
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        order = np.argsort(-lengths, kind="stable")
        flat = np.frombuffer(b"".join(texts[i] for i in order), np.uint8)
        sizes = lengths[order]
        begin = np.cumsum(sizes) - sizes
        state = np.tile(self.start, (len(texts), 1))
        for t in range(int(sizes[0]) if len(sizes) else 0):
            live = int(np.searchsorted(-sizes, -t, side="left"))  # texts longer than t come first
            byte, now = flat[begin[:live] + t], state[:live]
            moved = now & self.ahead[byte]
            step = moved << np.uint64(1)
            step[:, 1:] |= moved[:, :-1] >> np.uint64(63)
            state[:live] = step | (now & self.stay[byte])
        out = np.empty((len(texts), self.n), bool)
        for k, (word, bit) in enumerate(self.final):
            out[order, k] = (state[:, word] & bit) != 0
        return out


def rule_globs(rule: str) -> tuple[str, str]:
    """Globs of a rule: its host itself and every subdomain, with paths that begin as the rule's."""
    host, _, path = rule.partition("/")
    tail = f"{host}\0/{path}**"
    return tail, f"*.{tail}"


def judge_urls(pages: DataFrame, rules=RULES, blocked=BLOCKED, id_col: str = "page_id", url_col: str = "url") -> DataFrame:
    """Host, path, the longest fitting rule and the verdict of every URL; a narrow map, no shuffle.

    Null or a text without ``://`` has empty host and path, fits no rule and is allowed. Repeated rows are judged
    each; other columns are ignored; an empty table gives an empty result. Without a fitting rule, a URL is blocked
    if a glob of ``blocked`` fits it, else allowed. Rules of equal length: the earlier one wins.
    """
    ranked = sorted(rules, key=lambda r: -len(r[1]))
    globs = [g for _, rule in ranked for g in rule_globs(rule)] + list(blocked)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        machine = Automaton(globs)
        for batch in batches:
            parts = [canonical(u) for u in batch.column(1).to_pylist()]
            # a NUL inside a part would read as the separator: it is replaced for matching alone
            fits = machine.run([f"{h.replace(chr(0), chr(1))}\0{p.replace(chr(0), chr(1))}".encode("utf-8", "surrogatepass") for h, p in parts])
            by_rule = fits[:, : 2 * len(ranked)].reshape(len(parts), len(ranked), 2).any(axis=2)
            spam = fits[:, 2 * len(ranked) :].any(axis=1)
            first = np.where(by_rule.any(axis=1), by_rule.argmax(axis=1), -1) if ranked else np.full(len(parts), -1)
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column(0),
                    pa.array([h for h, _ in parts], pa.string()),
                    pa.array([p for _, p in parts], pa.string()),
                    pa.array([ranked[k][1] if k >= 0 else None for k in first], pa.string()),
                    pa.array([ranked[k][0] if k >= 0 else ("block" if s else "allow") for k, s in zip(first, spam, strict=True)], pa.string()),
                ],
                names=[id_col, "host", "path", "rule", "verdict"],
            )

    kind = pages.schema[id_col].dataType.simpleString()
    return pages.select(id_col, url_col).mapInArrow(judge, f"`{id_col}` {kind}, host string, path string, rule string, verdict string")


def op5_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return judge_urls(spark.read.parquet(f"{sf_dir}/pages.parquet"))


OP5_SQL = """
WITH cut AS (
  SELECT page_id, regexp_replace(substr(url, strpos(url, '://') + 3), '[?#].*$', '', 's') AS rest
  FROM pages WHERE url IS NOT NULL AND strpos(url, '://') > 0
  UNION ALL SELECT page_id, '' FROM pages WHERE url IS NULL OR strpos(url, '://') = 0
), parts AS (
  SELECT page_id,
         translate(split_part(rest, '/', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         CASE WHEN strpos(rest, '/') > 0 THEN substr(rest, strpos(rest, '/')) ELSE '' END AS path
  FROM cut
), judged AS (
  SELECT *, CASE
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/en/1') THEN 'example.org/en/1'
    WHEN (host = 'example.org' OR host LIKE '%.example.org') AND starts_with(path, '/es/') THEN 'example.org/es/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/fr/') THEN 'com/fr/'
    WHEN (host = 'com' OR host LIKE '%.com') AND starts_with(path, '/de/') THEN 'com/de/'
    WHEN (host = 'org' OR host LIKE '%.org') AND starts_with(path, '/') THEN 'org/' END AS rule
  FROM parts)
SELECT page_id, host, path, rule,
  CASE WHEN rule IN ('org/', 'com/fr/') THEN 'allow'
       WHEN rule IS NOT NULL OR host LIKE '%cheap-pills%' OR host LIKE '%casino%' OR host LIKE '%viagra%' OR host LIKE '%porn%'
            OR path LIKE '%/wp-login%' OR path LIKE '%.exe' OR path LIKE '%.apk' THEN 'block'
       ELSE 'allow' END AS verdict
FROM judged
"""
