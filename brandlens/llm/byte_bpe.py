"""Byte-level BPE encoding by replaying the merges over a whole chunk of the corpus at once, and decoding.

The distinct words of a chunk lie in one array of byte tokens with links to their neighbours. An inverted index leads
from each mergeable pair (known by the rank it merges to) to its positions. Ranks are taken in order from a heap; each
merges all its positions in one array operation and updates the index of the touched neighbours alone. A chunk belongs
to a task: an index over every word of a 100 TB corpus would need all words shuffled, and merges never cross words, so
the ids are the same.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import pyarrow.compute
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from brandlens.llm.spark_files import small_batches

#: Characters of texts that are encoded together; a longer text makes a chunk of its own.
CHUNK_CHARS = 3_000_000
_NONE = np.int32(np.iinfo(np.int32).max)


class _Places(dict):
    """Numbers words in the order in which they are first asked for."""

    def __missing__(self, word: str) -> int:
        self[word] = place = len(self)
        return place


class Ranks:
    """A vocabulary of ranks: tokens, and the rank that each pair of tokens merges to."""

    def __init__(self, path: str):
        with open(path, "rb") as lines:
            self.tokens = {int(rank): base64.b64decode(token) for token, rank in (line.split() for line in lines if line.strip())}
        ids = {token: rank for rank, token in self.tokens.items()}
        self.of_byte = np.array([ids[bytes([b])] for b in range(256)], np.int32)
        pairs = [
            (ids[token[:k]] << 32 | ids[token[k:]], rank)
            for token, rank in ids.items()
            for k in range(1, len(token))
            if token[:k] in ids and token[k:] in ids
        ]
        pairs.sort()
        self.keys = np.array([k for k, _ in pairs], np.int64)
        self.merged = np.array([r for _, r in pairs], np.int32)
        size = max(self.tokens) + 1
        self.lengths = np.zeros(size, np.int64)
        for rank, token in self.tokens.items():
            self.lengths[rank] = len(token)
        self.starts = np.cumsum(self.lengths) - self.lengths
        self.flat = np.frombuffer(b"".join(self.tokens.get(i, b"") for i in range(size)), np.uint8)

    def pair_rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank that each pair merges to, or the largest int32."""
        key = left.astype(np.int64) << 32 | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], _NONE)


@lru_cache(maxsize=4)
def load_ranks(path: str) -> Ranks:
    return Ranks(path)


@lru_cache(maxsize=4)
def _pattern(pattern: str) -> regex.Pattern:
    return regex.compile(pattern)


def replay(words: list[bytes], ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
    """Tokens of all words in a row, and how many each word has. No word is empty."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    n = int(sizes.sum())
    token = ranks.of_byte[np.frombuffer(b"".join(words), np.uint8)] if n else np.empty(0, np.int32)
    ends = np.cumsum(sizes) - 1
    after = np.arange(1, n + 1, dtype=np.int32)
    after[ends] = -1
    before = np.arange(-1, n - 1, dtype=np.int32)
    before[np.append(0, ends[:-1] + 1)[: len(words)]] = -1
    alive = np.ones(n, bool)
    rank_at = np.full(n, _NONE, np.int32)
    inner = np.flatnonzero(after >= 0)
    rank_at[inner] = ranks.pair_rank(token[inner], token[inner + 1])
    index: dict[int, list[np.ndarray]] = {}

    def add(at: np.ndarray) -> list[int]:
        at = at[rank_at[at] != _NONE]
        if not len(at):
            return []
        order = np.argsort(rank_at[at], kind="stable")
        at = at[order]
        of = rank_at[at]
        cuts = np.flatnonzero(of[1:] != of[:-1]) + 1
        fresh = []
        for rank, part in zip(of[np.append(0, cuts)].tolist(), np.split(at, cuts), strict=True):
            if rank in index:
                index[rank].append(part)
            else:
                index[rank] = [part]
                fresh.append(rank)
        return fresh

    heap = add(inner.astype(np.int32))
    heapq.heapify(heap)
    while heap:
        rank = heapq.heappop(heap)
        parts = index.pop(rank)
        at = parts[0] if len(parts) == 1 else np.unique(np.concatenate(parts))
        at = at[alive[at] & (rank_at[at] == rank)]
        if not len(at):
            continue
        right = after[at]
        clash = np.isin(right, at, assume_unique=True) if len(at) > 1 and (np.diff(np.sort(at)) <= ranks.lengths[rank]).any() else None
        if clash is not None and clash.any():
            # pairs that share a token: from the left, every other one of a run merges
            taken: set[int] = set()
            keep = []
            for p, r in sorted(zip(at.tolist(), right.tolist(), strict=True)):
                if p not in taken:
                    keep.append(p)
                    taken.add(r)
            at = np.array(keep, np.int32)
            right = after[at]
        token[at] = rank
        alive[right] = False
        rank_at[right] = _NONE
        beyond = after[right]
        after[at] = beyond
        more = beyond >= 0
        before[beyond[more]] = at[more]
        rank_at[at] = _NONE
        rank_at[at[more]] = ranks.pair_rank(token[at[more]], token[beyond[more]])
        left = before[at]
        left = left[left >= 0]
        rank_at[left] = ranks.pair_rank(token[left], token[after[left]])
        for fresh in add(np.unique(np.concatenate([at, left]))):
            heapq.heappush(heap, fresh)
    counts = np.add.reduceat(alive.astype(np.int64), ends - sizes + 1) if n else np.zeros(0, np.int64)
    return token[alive], counts


def _gather(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Indexes starts[0] .. starts[0]+lengths[0]-1, starts[1] .. and so on."""
    total = int(lengths.sum())
    shift = np.cumsum(lengths) - lengths
    return np.arange(total, dtype=np.int64) + np.repeat(starts - shift, lengths)


class Chunk:
    """Texts split into numbered words, to be encoded together."""

    def __init__(self, pattern: str):
        self.find = _pattern(pattern).findall
        self.places, self.texts, self.size = _Places(), [], 0

    def add(self, text: str | None) -> None:
        pieces = self.find(text or "")
        self.texts.append(np.fromiter(map(self.places.__getitem__, pieces), np.int32, len(pieces)))
        self.size += len(text or "")

    def encode(self, ranks: Ranks) -> tuple[np.ndarray, np.ndarray]:
        """Ids of all texts in a row, and how many each text has."""
        tokens, counts = replay([w.encode("utf-8", "replace") for w in self.places], ranks)
        starts = np.cumsum(counts) - counts
        used = np.concatenate([np.empty(0, np.int32), *self.texts])
        lengths = counts[used]
        upto = np.append(0, np.cumsum(lengths))
        ends = np.cumsum([len(x) for x in self.texts], dtype=np.int64)
        ids = tokens[_gather(starts[used], lengths)]
        return ids, upto[ends] - upto[np.append(np.zeros(1, np.int64), ends)[: len(ends)]]


def encode_texts(texts: list[str | None], ranks: Ranks, pattern: str) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """For some texts at a time: ids in a row, and how many each text has."""
    chunk = Chunk(pattern)
    for text in texts:
        if chunk.texts and chunk.size + len(text or "") > CHUNK_CHARS:
            yield chunk.encode(ranks)
            chunk = Chunk(pattern)
        chunk.add(text)
    if chunk.texts:
        yield chunk.encode(ranks)


def _default_vocabulary() -> tuple[str, str]:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN


def _encoding(docs: DataFrame, ranks_path: str | None, pattern: str | None, decoded: bool = False):
    """Columns to encode, text last; the schema of the result; ranks and pattern."""
    small_batches(docs.sparkSession)
    path, own = (ranks_path, pattern) if ranks_path and pattern else _default_vocabulary()
    kept = [c for c in docs.columns if c.lower() not in ("ids", "text", "decoded" if decoded else "ids")]
    source = docs.select(*[F.col(f"`{c}`") for c in kept], "text")
    added = [F.lit(None).cast("array<int>").alias("ids")] + [F.lit(None).cast("binary").alias("decoded")] * decoded
    return source, source.select(*[F.col(f"`{c}`") for c in kept], *added).schema, path, own


def _encoder(path: str, own: str, kept: list[str]):
    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        chunk, held = Chunk(own), []

        def flush() -> pa.RecordBatch:
            ids, counts = chunk.encode(ranks)
            lists = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(counts)), pa.int32()), pa.array(ids, pa.int32()))
            rest = pa.Table.from_batches(held).combine_chunks().to_batches()[0].columns if kept else []
            return pa.RecordBatch.from_arrays([*rest, lists], names=[*kept, "ids"])

        # a chunk gathers several batches; of a text only its words' numbers are kept
        for batch in batches:
            if not batch.num_rows:
                continue
            for text in batch.column(len(kept)).to_pylist():
                chunk.add(text)
            held.append(batch.select(range(len(kept))))
            if chunk.size > CHUNK_CHARS:
                yield flush()
                chunk, held = Chunk(own), []
                pa.default_memory_pool().release_unused()
        if chunk.texts:
            yield flush()

    return encode


def encode_bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``docs`` but text, with ids array<int>: the text's ids without special tokens (replacing a column ids).

    Each match of ``pattern`` is encoded on its own. A null or empty text has no ids. ``ranks_path`` is opened on the
    executors, so it must be a path of an installed package or shared folder. A narrow map, no shuffle.
    """
    source, schema, path, own = _encoding(docs, ranks_path, pattern)
    return source.mapInArrow(_encoder(path, own, source.columns[:-1]), schema)


def _decoder(path: str, kept: list[str]):
    at = kept.index("ids")

    def decode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(path)
        for batch in batches:
            for first in range(0, batch.num_rows, 1000):
                part = batch.slice(first, 1000)
                column = part.column(at)
                flat = column.flatten()
                counts = np.array([n or 0 for n in pa.compute.list_value_length(column).to_pylist()], np.int64)
                ids = flat.fill_null(-1).to_numpy(zero_copy_only=False).astype(np.int64)
                known = (ids >= 0) & (ids < len(ranks.lengths))
                ids = np.where(known, ids, 0)
                lengths = np.where(known, ranks.lengths[ids], 0)
                raw = ranks.flat[_gather(ranks.starts[ids], lengths)]
                upto = np.append(0, np.cumsum(lengths))
                ends = np.cumsum(counts)
                offsets = np.append(0, upto[ends]).astype(np.int64)
                out = pa.LargeBinaryArray.from_buffers(pa.large_binary(), part.num_rows, [None, pa.py_buffer(offsets.tobytes()), pa.py_buffer(raw.tobytes())])
                yield pa.RecordBatch.from_arrays([*part.columns, out.cast(pa.binary())], names=[*kept, "decoded"])

    return decode


def decode_bpe(encoded: DataFrame, ranks_path: str | None = None) -> DataFrame:
    """All columns with decoded binary, the bytes of ids (replacing a column decoded). Null ids give no bytes.

    Unknown ids stand for no bytes; null ids inside an array are skipped.
    """
    path = ranks_path or _default_vocabulary()[0]
    kept = [c for c in encoded.columns if c.lower() != "decoded"]
    source = encoded.select(*[F.col(f"`{c}`") for c in kept])
    schema = source.select("*", F.lit(None).cast("binary").alias("decoded")).schema
    return source.mapInArrow(_decoder(path, kept), schema)


def round_trip_bpe(docs: DataFrame, ranks_path: str | None = None, pattern: str | None = None) -> DataFrame:
    """All columns of ``docs`` but text, with ids and decoded: decode_bpe of encode_bpe in one Python worker instead of two."""
    source, schema, path, own = _encoding(docs, ranks_path, pattern, decoded=True)
    kept = source.columns[:-1]
    encode, decode = _encoder(path, own, kept), _decoder(path, [*kept, "ids"])
    return source.mapInArrow(lambda batches: decode(encode(batches)), schema)


def digests(round_trip: DataFrame, *also: str) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of documents encoded and decoded again; then ``also``."""
    return round_trip.select(
        "doc_id",
        F.size("ids").cast("bigint").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " ").cast("binary"), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
        *also,
    )


def op6_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digests(round_trip_bpe(spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", "text")))
