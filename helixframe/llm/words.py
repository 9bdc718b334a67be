"""Word and shingle hashes of whole Arrow string columns, without a Python loop over words.

Texts are read as the UTF-8 bytes of the Arrow buffer. A-Z is lowered, words are maximal runs of
bytes outside a separator set, and a word's hash comes from a difference of prefix sums of
`byte * BASE**position`, scaled back by the inverse power. Buffers are cut at separators into
pieces, so that a very long text takes no more temporary memory than many short ones.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa

PIECE = 1 << 18
BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A"):ord("Z") + 1] += 32


def separators(*ranges: tuple[int, int]) -> np.ndarray:
    """Table of the byte values inside any of the closed ranges."""
    table = np.zeros(256, dtype=bool)
    for low, high in ranges:
        table[low:high + 1] = True
    return table


#: Complement of `[^\\x20\\x09-\\x0D]` and of `[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]`.
SPACES = separators((0x20, 0x20), (0x09, 0x0D))
NON_WORD = separators((0x00, 0x2F), (0x3A, 0x60), (0x7B, 0x7F))


def mix(x: np.ndarray) -> np.ndarray:
    """Bijective scrambling of 64-bit integers (wraps silently)."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xC4CEB9FE1A85EC53)
    return x ^ (x >> np.uint64(33))


_powers: dict[str, np.ndarray] = {}


def _power_tables(n: int) -> tuple[np.ndarray, np.ndarray]:
    if not _powers or _powers["up"].size < n:
        for name, base in (("up", BASE), ("down", pow(BASE, -1, 1 << 64))):
            table = np.full(max(n, PIECE + 1), base, dtype=np.uint64)
            table[0] = 1
            _powers[name] = np.multiply.accumulate(table)
    return _powers["up"], _powers["down"]


def utf8_buffer(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Bytes of all texts and the offsets of each (nulls are empty)."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        binary = pa.types.is_binary(texts.type) or pa.types.is_large_binary(texts.type)
        texts = texts.fill_null(b"" if binary else "")
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, starts, data = texts.buffers()
    if len(texts) == 0:
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(starts, np.int64 if wide else np.int32)[texts.offset:texts.offset + len(texts) + 1].astype(np.int64)
    held = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return held[offsets[0]:offsets[-1]], offsets - offsets[0]


@dataclass
class Words:
    """hashes, byte starts and ends of all words; word `first[d]` is the first of text d."""

    hashes: np.ndarray
    starts: np.ndarray
    ends: np.ndarray
    first: np.ndarray
    data: np.ndarray
    offsets: np.ndarray

    def text(self, i: int) -> str:
        """Word i, lowered."""
        return LOWER[self.data[self.starts[i]:self.ends[i]]].tobytes().decode("utf-8", "replace")


def words_of(texts: pa.Array, separator: np.ndarray = SPACES) -> Words:
    data, offsets = utf8_buffer(texts)
    n = data.size
    edge = np.zeros(n + 1, dtype=bool)
    edge[offsets] = True
    edge[n] = True
    hashes, starts, ends = [], [], []
    at = 0
    while at < n:
        stop = min(n, at + PIECE)
        if stop < n:
            back = np.flatnonzero(separator[data[at + 1:stop + 1]] | edge[at + 1:stop + 1])
            if back.size:
                stop = at + 1 + int(back[-1])
            else:  # one word longer than a piece
                while stop < n and not (separator[data[stop]] or edge[stop]):
                    stop += 1
        low = LOWER[data[at:stop]]
        word = ~separator[low]
        before = np.empty_like(word)
        before[0] = True
        np.logical_or(~word[:-1], edge[at + 1:stop], out=before[1:])
        after = np.empty_like(word)
        after[-1] = True
        np.logical_or(~word[1:], edge[at + 1:stop], out=after[:-1])
        start = np.flatnonzero(word & before)
        end = np.flatnonzero(word & after) + 1
        up, down = _power_tables(stop - at + 1)
        total = np.zeros(stop - at + 1, dtype=np.uint64)
        np.cumsum((low.astype(np.uint64) + np.uint64(1)) * up[:stop - at], out=total[1:])
        hashes.append(mix((total[end] - total[start]) * down[start]))
        starts.append(start + at)
        ends.append(end + at)
        at = stop
    none = np.zeros(0, np.int64)
    start = np.concatenate(starts) if starts else none
    return Words(
        np.concatenate(hashes) if hashes else np.zeros(0, np.uint64), start,
        np.concatenate(ends) if ends else none, np.searchsorted(start, offsets), data, offsets,
    )


def hash_words(words: list[str]) -> np.ndarray:
    """Hashes of single words, equal to those that `words_of` gives them."""
    if not words:
        return np.zeros(0, np.uint64)
    found = words_of(pa.array(words))
    if found.hashes.size != len(words):
        raise ValueError("each entry must be one word")
    return found.hashes


def factors(k: int) -> np.ndarray:
    return mix(np.arange(1, k + 1, dtype=np.uint64) * np.uint64(0xD1342543DE82EF95)) | np.uint64(1)


def combine(hashes: np.ndarray, k: int) -> np.ndarray:
    """Hash of each run of k consecutive words."""
    n = hashes.size - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.full(n, k, dtype=np.uint64)
    for j, factor in enumerate(factors(k)):
        total += hashes[j:j + n] * factor
    return mix(total)


def shingle_sets(words: Words, k: int = 5):
    """Sorted distinct shingle hashes of each text; fewer than k words make one shingle, none none."""
    runs = combine(words.hashes, k)
    for low, high in zip(words.first[:-1].tolist(), words.first[1:].tolist()):
        count = high - low
        if count >= k:
            yield np.unique(runs[low:high - k + 1])
        elif count:
            yield combine(words.hashes[low:high], count)
        else:
            yield np.zeros(0, np.uint64)
