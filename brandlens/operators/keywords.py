"""Many words against many texts in one pass: an Aho-Corasick automaton over the distinct words.

The automaton reads every character of a text once, however many words there are. As long as the words fit a stated size,
each task builds it from all of them; beyond it words are dealt over automata by hash, and each slice of texts meets each of
them in a task of its own. Nothing is paired that does not match.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Words of one automaton (some 100 bytes for each of their characters), and texts of a slice where there are several.
AUTOMATON_WORDS, SLICE_TEXTS = 200_000, 50_000


class Automaton:
    """Finds which of its words a text holds as substrings."""

    def __init__(self, words: list[str]) -> None:
        import ahocorasick

        self._machine = ahocorasick.Automaton()
        for word in words:
            if word:
                self._machine.add_word(word, word)
        self._machine.make_automaton()

    def found(self, text: str | None) -> list[str]:
        if not text or not len(self._machine):
            return []
        return sorted({word for _, word in self._machine.iter(text)})


def _hits(automaton: Automaton, ids: pa.Array, texts: pa.Array) -> list[pa.Array]:
    at: list[int] = []
    words: list[str] = []
    for i, text in enumerate(texts.to_pylist()):
        found = automaton.found(text)
        at += [i] * len(found)
        words += found
    return [ids.take(pa.array(at, pa.int64())), pa.array(words, pa.string())]


def keyword_hits(texts: DataFrame, keywords: DataFrame, automaton_words: int = AUTOMATON_WORDS, slice_texts: int = SLICE_TEXTS) -> DataFrame:
    """text_id, keyword: once for each row of ``texts`` (text_id, text) and distinct keyword that it holds as a substring.

    ``keywords`` has keyword; case counts. Null and empty texts and keywords match nothing.
    """
    words = keywords.select("keyword").where("keyword <> ''").distinct()
    texts = texts.select("text_id", "text").where("text <> ''")
    kind = texts.schema["text_id"].dataType.simpleString()
    # one row more than an automaton may have tells whether one is enough; so much is sent to the tasks at most
    few = [r["keyword"] for r in words.limit(automaton_words + 1).collect()]
    if len(few) <= automaton_words:
        sent = texts.sparkSession.sparkContext.broadcast(few)

        def match(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            automaton = Automaton(sent.value)
            for batch in batches:
                yield pa.RecordBatch.from_arrays(_hits(automaton, batch.column("text_id"), batch.column("text")), names=["text_id", "keyword"])

        return texts.mapInArrow(match, f"text_id {kind}, keyword string")

    parts, slices = -(-words.count() // automaton_words), max(1, -(-texts.count() // slice_texts))
    some = words.select(F.pmod(F.xxhash64("keyword"), F.lit(parts)).alias("part"), F.explode(F.sequence(F.lit(0), F.lit(slices - 1))).alias("slice"), "keyword")
    every = texts.select(F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(parts - 1).cast("bigint"))).alias("part"), F.pmod(F.xxhash64("text_id", "text"), F.lit(slices)).cast("int").alias("slice"), "text_id", "text")

    def matched(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found = _hits(Automaton(right.column("keyword").to_pylist()), left.column("text_id").combine_chunks(), left.column("text"))
        return pa.table({"text_id": ids, "keyword": found})

    return every.groupBy("part", "slice").cogroup(some.groupBy("part", "slice")).applyInArrow(matched, f"text_id {kind}, keyword string")
