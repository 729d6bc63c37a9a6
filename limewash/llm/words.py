"""Words of many texts at once, as arrays: where they are and 64-bit hashes of them."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

U = np.uint64
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
AS_IS = np.arange(256, dtype=np.uint8)
#: Bytes of words ``[^\x00-\x2F\x3A-\x60\x7B-\x7F]+`` after lower-casing: digits, letters, all beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[65:91] = ALNUM[97:123] = ALNUM[128:] = True
#: Bytes of words ``[^\x20\x09-\x0D]+``.
SPACED = np.ones(256, bool)
SPACED[9:14] = SPACED[32] = False

_BASE, _STEP = U(0x9E3779B97F4A7C15 | 1), U(0xD6E8FEB86659FD93)
_powers = np.ones(1, U)
AT_ONCE = 1 << 20


def powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.multiply.accumulate(np.concatenate([np.ones(1, U), np.full(max(n, 4096) - 1, _BASE)]))
    return _powers[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads every bit over all of them."""
    h = h ^ (h >> U(32))
    h *= _STEP
    h ^= h >> U(29)
    h *= _BASE
    h ^= h >> U(32)
    return h


@dataclass
class Words:
    data: np.ndarray  # bytes of all texts, one after the other
    offsets: np.ndarray  # where text i begins; one more at the end
    starts: np.ndarray  # of each word, in data
    ends: np.ndarray
    first: np.ndarray  # the words of text i are first[i] to first[i + 1]
    hashes: np.ndarray

    def text(self, i: int, j: int) -> bytes:
        """Words i to j - 1, lower-cased, with one space between."""
        return b" ".join(LOWER[self.data[a:b]].tobytes() for a, b in zip(self.starts[i:j], self.ends[i:j]))


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and where each begins; a null is an empty text."""
    texts = texts.fill_null("") if texts.null_count else texts
    wide = pa.types.is_large_string(texts.type)
    offsets = np.frombuffer(texts.buffers()[1], np.int64 if wide else np.int32)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    body = texts.buffers()[2]
    data = np.frombuffer(body, np.uint8)[offsets[0] : offsets[-1]] if body is not None and len(body) else np.zeros(0, np.uint8)
    return data, offsets - offsets[0]


def _hashes(data: np.ndarray, inside: np.ndarray, starts: np.ndarray, ends: np.ndarray, fold: np.ndarray) -> np.ndarray:
    out = np.empty(len(starts), U)
    a = 0
    while a < len(starts):  # some words at a time, since each byte takes some 30 bytes here
        b = max(a + 1, int(np.searchsorted(ends, starts[a] + AT_ONCE)))
        lo, hi = starts[a], ends[b - 1]
        begin = starts[a:b] - lo
        off = np.arange(hi - lo) - np.repeat(begin, np.diff(np.append(begin, hi - lo)))
        value = (fold[data[lo:hi]].astype(U) + U(1)) * powers(int(off.max()) + 1)[off]
        value[~inside[lo:hi]] = 0
        out[a:b] = np.add.reduceat(value, begin)
        a = b
    return mix(out)


def words_of(texts: pa.Array, kind: np.ndarray, fold: np.ndarray = LOWER) -> Words:
    """Words of bytes of a kind; ``fold`` says which bytes count as equal."""
    data, offsets = text_bytes(texts)
    if not len(data):
        none = np.zeros(0, np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), np.int64), np.zeros(0, U))
    inside = kind[data]
    begin, end = inside.copy(), inside.copy()
    begin[1:] &= ~inside[:-1]
    end[:-1] &= ~inside[1:]
    cuts = offsets[(offsets > 0) & (offsets < len(data))]
    begin[cuts] = inside[cuts]
    end[cuts - 1] = inside[cuts - 1]
    starts, ends = np.flatnonzero(begin), np.flatnonzero(end) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets), _hashes(data, inside, starts, ends, fold))


def windows(hashes: np.ndarray, n: int) -> np.ndarray:
    """A hash of every n hashes in a row."""
    if len(hashes) < n:
        return np.zeros(0, U)
    size = len(hashes) - n + 1
    out = np.full(size, U(n))
    for k in range(n):
        out *= _STEP
        out += hashes[k : k + size]
    return mix(out)


def owners(first: np.ndarray) -> np.ndarray:
    """The text that each word belongs to."""
    return np.repeat(np.arange(len(first) - 1), np.diff(first))


def kept_words(words: Words, kept: np.ndarray) -> list[bytes]:
    """Of every text the words that are kept, with one space between."""
    at = np.flatnonzero(kept)
    size = words.ends[at] - words.starts[at] + 1
    end = np.cumsum(size)
    from_ = np.repeat(words.starts[at] - (end - size), size) + np.arange(int(size.sum()))
    from_[end - 1] = 0  # the space behind each word
    out = words.data[from_] if len(from_) else np.zeros(0, np.uint8)
    out[end - 1] = 32
    body = out.tobytes()
    bounds = np.append(0, end)[np.searchsorted(at, words.first)]
    return [body[a : max(a, b - 1)] for a, b in zip(bounds[:-1], bounds[1:])]


def small_batches(batches, column: str, size: int = 2 << 20) -> Iterator[pa.RecordBatch]:
    """The same rows in batches of about ``size`` bytes of text, one row at least."""
    for batch in batches:
        text = batch.column(batch.schema.get_field_index(column))
        _, offsets = text_bytes(text)
        a = 0
        while a < batch.num_rows:
            b = max(a + 1, int(np.searchsorted(offsets, offsets[a] + size, "right")) - 1)
            yield batch.slice(a, b - a)
            a = b
