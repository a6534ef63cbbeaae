"""Language identification with blended-spectrum string kernels.

A text is the set of its character n-grams, one hashed presence vector for each n. The kernel of two texts is the
mean over n of the cosine of their presence vectors. Nyström landmarks (labelled texts of the sample) give an explicit
feature map, and one-versus-rest kernel ridge regression on it gives a score for each language. The kernel is linear in
the presence vectors, so landmarks and ridge weights fold into one matrix and scoring is a matrix product for each n.

The scores of all languages add up to a constant, so the best one says nothing about texts in none of them. Such texts
fall short in another measure: the share of their 3-grams that are usual in a learned language.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from brandlens.llm.spark_files import small_batches
from brandlens.llm.text_arrays import class_table, slices

#: (n, hash bits) of each spectrum.
SPECTRA = ((1, 10), (2, 12), (3, 14))
_SIZES = [1 << bits for _, bits in SPECTRA]
WIDTH = sum(_SIZES)
_ROWS = 192
_MULTIPLIERS = (np.uint32(0x9E3779B1), np.uint32(0x85EBCA77), np.uint32(0xC2B2AE3D))
UND = "und"
#: A 3-gram is usual in a language if more than this share of its learning texts have it.
USUAL = 0.02
#: Least share of usual 3-grams, and the part of the share of held-out learning texts (5th percentile) that is enough.
LEAST_USUAL, PART_OF_HELD_OUT = 0.55, 0.85


def presence(texts: list[str | None]) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time: uint8[texts, WIDTH] with the n-grams present, and whether each has a letter."""
    alpha = class_table("alpha")
    for _, part in slices(texts, rows=_ROWS):
        # two NULs after every text, where no n-gram begins: none reaches into the next text
        codes = np.frombuffer(("\0\0".join(part) + "\0\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        owner = np.repeat(np.arange(len(part), dtype=np.int64) * WIDTH, [len(x) + 2 for x in part])
        letters = alpha[codes]
        lettered = np.bincount(owner[letters] // WIDTH, minlength=len(part)) > 0
        codes = np.where(letters | (codes == 0), codes, np.uint32(32))
        begins = codes != 0
        bits = np.zeros(len(part) * WIDTH, np.uint8)
        base = 0
        with np.errstate(over="ignore"):
            for (n, width), size in zip(SPECTRA, _SIZES, strict=True):
                h = codes[: len(codes) - n + 1] * _MULTIPLIERS[0]
                for k in range(1, n):
                    h = ((h << np.uint32(5)) | (h >> np.uint32(27))) ^ (codes[k : len(codes) - n + 1 + k] * _MULTIPLIERS[k])
                h = (h ^ (h >> np.uint32(15))) * np.uint32(0x2C1B3C6D)
                own = begins[: len(h)]
                bits[owner[: len(h)][own] + base + (h[own] >> np.uint32(32 - width))] = 1
                base += size
        yield bits.reshape(len(part), WIDTH), lettered


def normalised(bits: np.ndarray) -> np.ndarray:
    """Presence vectors with each spectrum scaled to length 1 / sqrt(number of spectra)."""
    out = bits.astype(np.float32)
    base = 0
    for size in _SIZES:
        part = out[:, base : base + size]
        part /= np.sqrt(np.maximum(part.sum(axis=1, keepdims=True), 1) * len(_SIZES))
        base += size
    return out


@dataclass
class LanguageModel:
    """languages, and the folded weights float32[WIDTH + 1, languages]; the last row is the bias.

    ``usual``: float32[3-grams, languages], 1 where a 3-gram is usual; ``least``: the share of usual ones a text must have.
    """

    languages: list[str]
    weights: np.ndarray
    usual: np.ndarray | None = None
    least: float = 0.0

    def scores(self, bits: np.ndarray) -> np.ndarray:
        return normalised(bits) @ self.weights[:-1] + self.weights[-1]

    def familiar(self, bits: np.ndarray) -> np.ndarray:
        """Whether the 3-grams of each text are usual in some language; one unusual 3-gram is always forgiven."""
        if self.usual is None:
            return np.ones(len(bits), bool)
        total = bits[:, -_SIZES[-1] :].sum(axis=1, dtype=np.int64)
        return usual_share(bits, self.usual) * total + 1 >= self.least * total


def usual_share(bits: np.ndarray, usual: np.ndarray) -> np.ndarray:
    """The share of the present 3-grams that are usual, for the language where it is largest."""
    present = bits[:, -_SIZES[-1] :].astype(np.float32)
    return (present @ usual).max(axis=1) / np.maximum(present.sum(axis=1), 1)


def usual_grams(packed: np.ndarray, y: np.ndarray, languages: int, folds: int = 5) -> tuple[np.ndarray, float]:
    """float32[3-grams, languages], and the least share: it is set on texts held out of the counts, fold by fold."""
    fold_no = np.zeros(len(y), np.int64)
    for c in range(languages):
        fold_no[y == c] = np.arange((y == c).sum()) % folds
    texts = np.zeros((folds, languages))
    np.add.at(texts, (fold_no, y), 1)
    have = np.zeros((folds, languages, _SIZES[-1]), np.float32)
    part = lambda rows: np.unpackbits(packed[rows], axis=1)
    for f in range(folds):
        for c in range(languages):
            rows = np.flatnonzero((fold_no == f) & (y == c))
            for a in range(0, len(rows), 128):
                have[f, c] += part(rows[a : a + 128])[:, -_SIZES[-1] :].sum(axis=0)
    usual = lambda h, n: (h > USUAL * n[:, None]).T.astype(np.float32)
    shares = []
    for f in range(folds):
        known = usual(have.sum(axis=0) - have[f], texts.sum(axis=0) - texts[f])
        rows = np.flatnonzero(fold_no == f)
        shares += [usual_share(part(rows[a : a + 128]), known) for a in range(0, len(rows), 128)]
    return usual(have.sum(axis=0), texts.sum(axis=0)), float(min(LEAST_USUAL, PART_OF_HELD_OUT * np.percentile(np.concatenate(shares), 5)))


def fit_kernel_ridge(packed: np.ndarray, labels: list[str], landmarks: int = 256, ridge: float = 1e-3) -> LanguageModel:
    """One-versus-rest kernel ridge regression on Nyström features; rows of each language weigh the same in total.

    ``packed``: presence bits of the sample, WIDTH / 8 bytes a row; only some rows at a time are unpacked.
    """
    languages = sorted(set(labels))
    y = np.array([languages.index(x) for x in labels], dtype=np.int64)
    per = max(1, landmarks // max(1, len(languages)))
    chosen = np.concatenate([np.flatnonzero(y == c)[:per] for c in range(len(languages))])
    marks = normalised(np.unpackbits(packed[chosen], axis=1))
    kernel = np.concatenate([normalised(np.unpackbits(packed[a : a + 128], axis=1)) @ marks.T for a in range(0, len(packed), 128)]).astype(np.float64)
    values, vectors = np.linalg.eigh((kernel[chosen] + kernel[chosen].T) / 2)
    root = vectors[:, values > 1e-5] / np.sqrt(values[values > 1e-5])  # K_mm ^ (-1/2)
    z = np.hstack([kernel @ root, np.ones((len(kernel), 1))])
    weight = 1 / np.bincount(y)[y] / len(languages)
    target = np.where(y[:, None] == np.arange(len(languages)), 1.0, -1.0)
    penalty = ridge * np.eye(z.shape[1])
    penalty[-1, -1] = 0
    w = np.linalg.solve(z.T @ (z * weight[:, None]) + penalty + 1e-12 * np.eye(z.shape[1]), z.T @ (target * weight[:, None]))
    return LanguageModel(languages, np.vstack([marks.T @ (root @ w[:-1]).astype(np.float32), w[-1:]]).astype(np.float32), *usual_grams(packed, y, len(languages)))


def fold(doc_id, modulus: int):
    """crc32 of the id as text, modulo ``modulus``; null for a null id."""
    return F.crc32(doc_id.cast("string").cast("binary")) % modulus


def train_language_model(docs: DataFrame, per_language: int = 300, most_texts: int = 12_000) -> LanguageModel | None:
    """Fit on a bounded sample: at most ``per_language`` texts of each language, and of every language the same part of
    ``most_texts`` if there are more than most_texts / per_language (one text of each at least). No language is left out.

    Learns from rows with text and lang whose crc32(doc_id as text) mod 3 is not 1. The sample is drawn by a hash of
    doc_id, at a rate from each language's row count; of several rows of one id and language the least text counts. One task
    fits on the sample's presence bits (WIDTH / 8 bytes a text), and only the model reaches the driver.
    None if there is nothing to learn from.
    """
    small_batches(docs.sparkSession)
    usable = docs.select("doc_id", "lang", "text").where(F.col("lang").isNotNull() & F.col("text").isNotNull() & (fold(F.col("doc_id"), 3) != 1))
    counts = usable.groupBy("lang").agg(F.count("*").alias("n"))
    languages = counts.count()
    if not languages:
        return None
    per_language = max(1, min(per_language, most_texts // languages))
    spread = 1 << 30
    key = F.pmod(F.xxhash64("doc_id"), F.lit(spread))
    rate = counts.select("lang", (F.least(F.lit(1.0), 1.2 * (per_language + 20) / F.col("n")) * spread).cast("bigint").alias("rate"))
    # one row for each language
    picked = usable.join(F.broadcast(rate), "lang").where(key < F.col("rate"))

    def bits(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            packed = [row.tobytes() for part, _ in presence(batch.column("text").to_pylist()) for row in np.packbits(part, axis=1)]
            yield pa.RecordBatch.from_arrays([batch.column("lang"), batch.column("key"), pa.array(packed, pa.binary())], names=["lang", "key", "bits"])

    single = picked.groupBy("doc_id", "lang").agg(F.min("text").alias("text"))
    drawn = single.select("lang", key.alias("key"), "text").mapInArrow(bits, "lang string, key bigint, bits binary")
    # a window over the drawn rows, some 1.2 * per_language for a language
    nth = F.row_number().over(Window.partitionBy("lang").orderBy("key", "bits"))

    def fitted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if sum(b.num_rows for b in held):
            rows = pa.Table.from_batches(held).sort_by([("key", "ascending"), ("lang", "ascending"), ("bits", "ascending")])
            packed = np.frombuffer(b"".join(rows.column("bits").to_pylist()), np.uint8).reshape(rows.num_rows, -1)
            model = fit_kernel_ridge(packed, rows.column("lang").to_pylist())
            columns = [[model.languages], [model.weights.tobytes()], [model.usual.tobytes()], [model.least]]
            yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], names=["languages", "weights", "usual", "least"])

    sample = drawn.withColumn("nth", nth).where(F.col("nth") <= per_language).select("lang", "key", "bits")
    found = sample.repartition(1).mapInArrow(fitted, "languages array<string>, weights binary, usual binary, least double").first()
    if found is None:
        return None
    weights, usual = (np.frombuffer(found[c], np.float32).reshape(-1, len(found["languages"])) for c in ("weights", "usual"))
    return LanguageModel(found["languages"], weights, usual, found["least"])


def predict_language(docs: DataFrame, model: LanguageModel | None, reject_unfamiliar: bool = False) -> DataFrame:
    """All columns of ``docs`` with lang_pred and lang_score (replacing columns of these names); a narrow map, no shuffle.

    A text with a letter gets the learned language that fits best; ``und`` with score 0 where text is null or has no
    letter, or where there is no model. With ``reject_unfamiliar`` so do texts whose 3-grams are usual in none of the
    learned languages (foreign texts, gibberish). Only text is read. The score is the winning one-versus-rest value, (value + 1) / 2 held to 0..1; ties go to the alphabetically first language.
    """
    small_batches(docs.sparkSession)
    kept = [c for c in docs.columns if c.lower() not in ("lang_pred", "lang_score")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.select("*", F.lit("").alias("lang_pred"), F.lit(0.0).alias("lang_score")).schema
    at = source.columns.index("text")

    def predict(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names: list[str] = []
            values: list[np.ndarray] = []
            for bits, lettered in presence(batch.column(at).to_pylist()):
                if model is None:
                    names += [UND] * len(bits)
                    values.append(np.zeros(len(bits)))
                    continue
                if reject_unfamiliar:
                    lettered = lettered & model.familiar(bits)
                scores = model.scores(bits)
                best = scores.argmax(axis=1)
                names += [model.languages[k] if ok else UND for k, ok in zip(best, lettered, strict=True)]
                values.append(np.where(lettered, np.clip((scores.max(axis=1).astype(np.float64) + 1) / 2, 0, 1), 0.0))
            score = np.concatenate(values) if values else np.zeros(0)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(score, pa.float64())], names=[*kept, "lang_pred", "lang_score"])

    return source.mapInArrow(predict, schema)


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, held_out, lang_pred and score of every row of documents; null texts and texts without letters are ``und``, 0."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    model = train_language_model(docs)
    return predict_language(docs.select("doc_id", "text"), model).select(
        "doc_id", F.coalesce(fold(F.col("doc_id"), 3) == 1, F.lit(False)).alias("held_out"), "lang_pred", F.col("lang_score").alias("score")
    )
