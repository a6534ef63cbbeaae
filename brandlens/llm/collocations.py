"""Phrases whose words keep together: Apriori passes over the texts, one for each length, then scores of the best cut.

Pass k counts the k-word phrases whose two overlapping (k - 1)-word parts are frequent. The frequent parts go to all tasks
while they are below a stated size; beyond it the pass counts every k-word phrase instead, which gives the same rows, as
a phrase is never more frequent than its parts. A task counts its batches before anything is shuffled. The level tables
then hold all that the scores need: both sides of a cut of a frequent phrase are frequent themselves.
"""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.llm.spark_files import small_batches, with_checkpoint_dir

LONGEST, LEAST, SCALE, TOP = 4, 30, 2_000_000, 2000
#: Bytes of frequent phrases that may be sent to every task.
MOST_SENT = 64 << 20
#: Rankings of a language are made in so many parts first.
RANK_PARTS = 64
#: A-Z to a-z, the marks that end a piece to a full stop, tab to space. All are ASCII, so UTF-8 stays whole.
_FOLD = np.arange(256, dtype=np.uint8)
_FOLD[65:91] += 32
_FOLD[list(b".,;:!?\x0a\x0b\x0c\x0d")] = ord(".")
_FOLD[9] = 32


class _Batch:
    """Words of a batch of texts in order: ``ids`` into ``keys`` (language, tab, word), -1 where a piece or text ends."""

    def __init__(self, langs: pa.Array, texts: pa.Array) -> None:
        texts = texts.cast(pa.string()).fill_null("")
        _, offsets, data = texts.buffers()
        folded = pa.py_buffer(_FOLD[np.frombuffer(data, np.uint8)].tobytes()) if data else data
        texts = pa.Array.from_buffers(pa.string(), len(texts), [None, offsets, folded], offset=texts.offset)
        # no word holds a full stop, so it can stand for the end of a piece
        rows = pc.ascii_split_whitespace(pc.binary_join_element_wise(pc.replace_substring(texts, ".", " . "), ".", " "))
        tokens = rows.flatten().dictionary_encode()
        kinds = langs.dictionary_encode()
        of_row = kinds.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        lang = np.repeat(of_row, rows.value_lengths().to_numpy(zero_copy_only=False))
        code = tokens.indices.to_numpy(zero_copy_only=False).astype(np.int64)
        names = tokens.dictionary
        full = pc.binary_length(names).to_numpy(zero_copy_only=False)[code] > 0
        lang, code = lang[full], code[full]
        stop = pc.index(names, ".").as_py()
        word = code != stop
        distinct, inverse = np.unique(lang[word] * max(1, len(names)) + code[word], return_inverse=True)
        self.ids = np.full(len(code), -1, np.int64)
        self.ids[word] = inverse
        self.words = names.take(pa.array(distinct % max(1, len(names))))
        of = kinds.dictionary.take(pa.array(distinct // max(1, len(names))))
        self.keys = pc.binary_join_element_wise(of, self.words, "\t")
        self.counts = np.bincount(inverse, minlength=len(distinct))
        self.langs, self.totals = kinds.dictionary, np.bincount(lang[word], minlength=len(kinds.dictionary))

    def keep(self, frequent: pa.Array | None) -> None:
        if frequent is not None:
            known = pc.is_in(self.keys, value_set=frequent).to_numpy(zero_copy_only=False)
            self.ids = np.where((self.ids >= 0) & np.append(known, False)[self.ids], self.ids, -1)

    def lengthen(self) -> None:
        """Phrases one word longer, where one begins at a position and one at the next."""
        here, after = self.ids[:-1], self.ids[1:]
        at = np.flatnonzero((here >= 0) & (after >= 0))
        many = max(1, len(self.keys))
        distinct, inverse = np.unique(here[at] * many + after[at], return_inverse=True)
        self.ids = np.full(max(0, len(self.ids) - 1), -1, np.int64)
        self.ids[at] = inverse
        self.words = self.words.take(pa.array(distinct % many))
        self.keys = pc.binary_join_element_wise(self.keys.take(pa.array(distinct // many)), self.words, " ")
        self.counts = np.bincount(inverse, minlength=len(distinct))


def _packed(keys: pa.Array) -> bytes:
    sink = pa.BufferOutputStream()
    with pa.ipc.new_stream(sink, pa.schema([("key", pa.string())])) as out:
        out.write_batch(pa.RecordBatch.from_arrays([keys], names=["key"]))
    return sink.getvalue().to_pybytes()


def _unpacked(data: bytes | None) -> pa.Array | None:
    return None if data is None else pa.ipc.open_stream(data).read_all().column("key").combine_chunks()


def phrase_counts(docs: DataFrame, words: int, frequent: list[bytes | None]) -> DataFrame:
    """key (language, tab, phrase) and n of each batch, for phrases of ``words`` words whose parts are in ``frequent``.

    With ``words`` = 1 there is also a row for each language with an empty phrase: all its words.
    """
    sent = docs.sparkSession.sparkContext.broadcast(frequent)

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts = [_unpacked(x) for x in sent.value]
        for batch in batches:
            found = _Batch(batch.column("lang"), batch.column("text"))
            for level in range(words - 1):
                found.keep(parts[level])
                found.lengthen()
            keys, counts = [found.keys], [found.counts]
            if words == 1:
                keys.append(pc.binary_join_element_wise(found.langs, "", "\t"))
                counts.append(found.totals)
            yield pa.RecordBatch.from_arrays([pa.concat_arrays([k.cast(pa.string()) for k in keys]), pa.array(np.concatenate(counts), pa.int64())], names=["key", "n"])

    return docs.mapInArrow(counted, "key string, n bigint")


def phrase_levels(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, most_sent: int = MOST_SENT) -> DataFrame:
    """key, k, f: every phrase of up to ``longest`` words with f >= ``least``; k = 0: all words of a language, whatever their number."""
    spark = docs.sparkSession
    with_checkpoint_dir(spark)
    small_batches(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/phrases-{uuid.uuid4().hex}"
    docs = docs.select(F.coalesce(F.col("lang").cast("string"), F.lit("und")).alias("lang"), "text")
    frequent: list[bytes | None] = []
    for k in range(1, longest + 1):
        total = phrase_counts(docs, k, frequent).groupBy("key").agg(F.sum("n").alias("f"))
        whole = F.substring("key", -1, 1) == "\t"
        total.where((F.col("f") >= least) | whole).select("key", F.when(whole, 0).otherwise(k).alias("k"), "f").write.parquet(f"{folder}/{k}")
        level = spark.read.parquet(f"{folder}/{k}").where(F.col("k") == k)
        size = level.agg(F.count("*").alias("n"), F.sum(F.octet_length("key") + 4).alias("bytes")).first()
        if not size["n"]:
            return spark.read.parquet(*[f"{folder}/{i}" for i in range(1, k + 1)])
        if k < longest:
            # sent only below the bound
            keys = level.select("key").toArrow().column("key").combine_chunks().cast(pa.string()) if size["bytes"] <= most_sent else None
            frequent.append(None if keys is None else _packed(keys))
    return spark.read.parquet(*[f"{folder}/{i}" for i in range(1, longest + 1)])


def mine_collocations(docs: DataFrame, longest: int = LONGEST, least: int = LEAST, top: int = TOP, most_sent: int = MOST_SENT) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: of each language the ``top`` phrases by score, a, then the phrase's bytes.

    Reads lang and text; A-Z are lower-cased, a null lang is ``und``, a null text is empty, repeated rows count each. A
    phrase lies within one piece (no ``.,;:!?`` or line break inside). Its score is that of its weakest cut,
    floor(2,000,000 a / (l + r)); phrases that mostly (80 %) occur inside one longer frequent phrase are dropped. An empty
    table, or one without frequent phrases, gives no rows.
    """
    levels = phrase_levels(docs, longest, least, most_sent)
    lang = F.expr("left(key, length(key) - length(substring_index(key, '\t', -1)) - 1)")
    phrases = levels.where("k >= 1").select("key", "k", "f")
    longer = levels.where("k >= 2").select("key", "k", F.col("f").alias("a"), lang.alias("lang"), F.substring_index("key", "\t", -1).alias("phrase"))
    longer = longer.withColumn("words", F.split("phrase", " "))

    def part(start, length):
        return F.concat("lang", F.lit("\t"), F.array_join(F.slice("words", start, length), " "))

    cut = F.col("cut")
    cuts = longer.withColumn("cut", F.explode(F.sequence(F.lit(1), F.col("k") - 1)))
    cuts = cuts.select("key", "lang", "phrase", "k", "a", "cut", part(F.lit(1), cut).alias("left"), part(cut + 1, F.col("k") - cut).alias("right"))
    sides = cuts.join(phrases.select(F.col("key").alias("left"), F.col("f").alias("l")), "left").join(phrases.select(F.col("key").alias("right"), F.col("f").alias("r")), "right")
    score = F.expr(f"(CAST(a AS DECIMAL(20,0)) * {SCALE}) div (CAST(l AS DECIMAL(20,0)) + CAST(r AS DECIMAL(20,0)))")
    scored = sides.withColumn("score", score).groupBy("key", "lang", "phrase", "a").agg(F.min(F.struct("score", "cut", "l", "r")).alias("best"))

    inner = longer.where("k >= 3").withColumn("size", F.explode(F.sequence(F.lit(2), F.col("k") - 1)))
    inner = inner.withColumn("start", F.explode(F.sequence(F.lit(1), F.col("k") - F.col("size") + 1)))
    around = inner.groupBy(part(F.col("start"), F.col("size")).alias("key")).agg(F.max("a").alias("most"))
    inside = F.expr("CAST(most AS DECIMAL(20,0)) * 100 >= CAST(a AS DECIMAL(20,0)) * 80")
    kept = scored.join(around, "key", "left").where(~F.coalesce(inside, F.lit(False))).select("lang", "phrase", "a", "best.*")

    order = [F.desc("score"), F.desc("a"), F.asc("phrase")]
    # a part's first rows hold all of the language's first rows that it has, so one task ranks RANK_PARTS * top rows at most
    parted = kept.withColumn("_part", F.pmod(F.xxhash64("phrase"), F.lit(RANK_PARTS)))
    first = parted.withColumn("rank", F.row_number().over(Window.partitionBy("lang", "_part").orderBy(*order))).where(F.col("rank") <= top).drop("rank", "_part")
    ranked = first.withColumn("rank", F.row_number().over(Window.partitionBy("lang").orderBy(*order)).cast("long")).where(F.col("rank") <= top)
    words = levels.where("k = 0").select(lang.alias("lang"), F.col("f").alias("n"))
    return ranked.join(words, "lang").select("lang", "rank", "phrase", "a", "l", "r", "n", "score")


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first 2,000 phrases of each language of documents, with counts and score."""
    return mine_collocations(spark.read.parquet(f"{sf_dir}/documents.parquet"))


OP13_SQL = r"""
WITH pieces AS (
  SELECT lang, row_number() OVER () AS piece, piece_text FROM (
    SELECT coalesce(lang, 'und') AS lang,
           unnest(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece_text
    FROM documents)
), listed AS (SELECT lang, piece, regexp_extract_all(piece_text, '[^\x20\x09]+') AS w FROM pieces),
starts AS (SELECT lang, w, unnest(range(1, len(w) + 1)) AS i FROM listed),
spans AS (SELECT lang, w, i, unnest(range(1, 5)) AS k FROM starts),
counted AS (
  SELECT lang, k, array_to_string(w[i:i + k - 1], ' ') AS phrase, count(*) AS f FROM spans WHERE i + k - 1 <= len(w) GROUP BY 1, 2, 3
), totals AS (SELECT lang, sum(f) AS n FROM counted WHERE k = 1 GROUP BY lang),
cand AS (SELECT lang, k, phrase, f AS a, string_split(phrase, ' ') AS w FROM counted WHERE k >= 2 AND f >= 30),
cuts AS (SELECT *, unnest(range(1, k)) AS cut FROM cand),
sides AS (SELECT lang, k, phrase, a, cut, array_to_string(w[1:cut], ' ') AS left_part, array_to_string(w[cut + 1:k], ' ') AS right_part FROM cuts),
scored AS (
  SELECT s.lang, s.phrase, s.a, s.cut, x.f AS l, y.f AS r, CAST((CAST(2000000 AS HUGEINT) * s.a) // (CAST(x.f AS HUGEINT) + y.f) AS BIGINT) AS score
  FROM sides s JOIN counted x ON x.lang = s.lang AND x.phrase = s.left_part AND x.k = s.cut JOIN counted y ON y.lang = s.lang AND y.phrase = s.right_part AND y.k = s.k - s.cut
), best AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY lang, phrase ORDER BY score, cut) AS no FROM scored) WHERE no = 1),
parts AS (SELECT lang, w, k, a, unnest(range(2, k)) AS size FROM cand WHERE k >= 3),
placed AS (SELECT lang, w, k, a, size, unnest(range(1, k - size + 2)) AS s FROM parts),
around AS (SELECT lang, array_to_string(w[s:s + size - 1], ' ') AS phrase, max(a) AS most FROM placed GROUP BY 1, 2),
kept AS (
  SELECT b.* FROM best b LEFT JOIN around o ON o.lang = b.lang AND o.phrase = b.phrase
  WHERE o.most IS NULL OR NOT (CAST(100 AS HUGEINT) * o.most >= CAST(80 AS HUGEINT) * b.a)
), ranked AS (SELECT *, row_number() OVER (PARTITION BY lang ORDER BY score DESC, a DESC, phrase) AS rank FROM kept)
SELECT r.lang, r.rank, r.phrase, r.a, r.l, r.r, CAST(t.n AS BIGINT) AS n, r.score FROM ranked r JOIN totals t ON t.lang = r.lang WHERE r.rank <= 2000
"""
