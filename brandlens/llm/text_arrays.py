"""Texts as numpy arrays: code points, hashed words and hashed shingles of many texts at once.

All helpers work on whole texts. A batch is cut into slices of a bounded number of characters (one longer
text makes a slice of its own), so a task holds some 100 bytes for each character of one slice.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from functools import lru_cache

import numpy as np

#: Characters of one slice; a longer text is a slice of its own.
SLICE_CHARS = 1 << 19
_U = np.uint64


def slices(texts: list[str | None], chars: int = SLICE_CHARS, rows: int = 1 << 30) -> Iterator[tuple[int, list[str]]]:
    """(index of the first text, lower-cased texts) of at most ``rows`` texts and ``chars`` characters, or one longer text. Null is empty."""
    held: list[str] = []
    size = first = 0
    for i, text in enumerate(texts):
        low = (text or "").lower()
        if held and (size + len(low) > chars or len(held) == rows):
            yield first, held
            held, size, first = [], 0, i
        held.append(low)
        size += len(low)
    if held:
        yield first, held


def code_points(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Code points of all texts in a row, and the text number of each."""
    codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    return codes, np.repeat(np.arange(len(texts), dtype=np.int32), lengths)


@lru_cache(maxsize=4)
def class_table(kind: str) -> np.ndarray:
    """For every code point, whether str.isalnum or str.isalpha holds (``_`` counts as a word character)."""
    test = str.isalnum if kind == "word" else str.isalpha
    table = np.fromiter((test(chr(i)) for i in range(0x110000)), bool, 0x110000)
    if kind == "word":
        table[ord("_")] = True
    return table


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser (multiply and shift), element by element."""
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


@lru_cache(maxsize=1)
def _powers() -> np.ndarray:
    out = np.empty(1 << 12, np.uint64)
    out[0] = 1
    with np.errstate(over="ignore"):
        for i in range(1, len(out)):
            out[i] = out[i - 1] * _U(0x9E3779B97F4A7C15)
    return out


def _power(exponents: np.ndarray) -> np.ndarray:
    table = _powers()
    if not len(exponents) or exponents.max() < len(table):
        return table[exponents]
    high, low = np.divmod(exponents, len(table))
    step = table[-1] * table[1]
    return table[low] * np.array([pow(int(step), int(h), 1 << 64) for h in np.unique(high)], np.uint64)[np.unique(high, return_inverse=True)[1]]


def words(texts: list[str], stems: tuple[int, ...] = ()) -> tuple[np.ndarray, ...]:
    """64-bit hash of every word (a run of letters, digits or ``_``) of the texts in order, and its text's number.

    Then, for each of ``stems``, the hash of every word's first so many letters.
    """
    codes, owner = code_points(texts)
    at = np.flatnonzero(class_table("word")[codes])
    if not len(at):
        return np.empty(0, np.uint64), np.empty(0, np.int32), *[np.empty(0, np.uint64) for _ in stems]
    begins = np.empty(len(at), bool)
    begins[0] = True
    begins[1:] = (np.diff(at) > 1) | (np.diff(owner[at]) > 0)
    starts = np.flatnonzero(begins)
    place = np.arange(len(at)) - np.repeat(starts, np.diff(np.append(starts, len(at))))
    with np.errstate(over="ignore"):
        each = mix(codes[at].astype(np.uint64) + _U(0x632BE59BD9B4E019)) * _power(place)
        cut = [mix(np.add.reduceat(np.where(place < k, each, _U(0)), starts) + _U(k)) for k in stems]
        return mix(np.add.reduceat(each, starts)), owner[at[starts]], *cut


def grams(hashes: np.ndarray, owner: np.ndarray, offsets: tuple[int, ...]) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the words at ``offsets`` from every word whose whole pattern lies in one text, and the text's number."""
    span = offsets[-1]
    n = len(hashes) - span
    if n <= 0:
        return np.empty(0, np.uint64), np.empty(0, np.int32)
    with np.errstate(over="ignore"):
        out = np.full(n, 0x2545F4914F6CDD1D + len(offsets) * 131 + span, np.uint64)
        for k in offsets:
            out = (out ^ (out >> _U(29))) * _U(0x9FB21C651E98DF25) + hashes[k : k + n]
        whole = owner[:n] == owner[span:]
        return mix(out[whole]), owner[:n][whole]


def by_text(values: np.ndarray, owner: np.ndarray, n: int) -> list[np.ndarray]:
    """The values of each of ``n`` texts; ``owner`` is sorted."""
    return np.split(values, np.searchsorted(owner, np.arange(1, n)))


def shingle_sets(texts: Iterable[str | None], width: int = 5) -> Iterator[np.ndarray]:
    """Sorted distinct hashes of the ``width``-word shingles of each text.

    A text of fewer words has one shingle of all its words; one without words has none.
    """
    for _, part in slices(list(texts)):
        hashes, owner = words(part)
        shingles, of = grams(hashes, owner, tuple(range(width)))
        for found, short in zip(by_text(shingles, of, len(part)), by_text(hashes, owner, len(part)), strict=True):
            if not len(found) and len(short):
                found = grams(short, np.zeros(len(short), np.int32), tuple(range(len(short))))[0]
            yield np.unique(found)
