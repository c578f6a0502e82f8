"""Word hashes and shingles in numpy."""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash

M1, M2, M3 = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xC2B2AE3D27D4EB4F), np.uint64(0x165667B19E3779F9)
SHIFT = np.uint64(29)
#: glibc's call that gives unused pages of the heap back; nothing is done where the C library has none.
TRIM = getattr(ctypes.CDLL(None), "malloc_trim", lambda pad: 0)


class Hashes(dict):
    """word (bytes) -> 64-bit hash; filled by need, emptied at `most` words."""

    def __init__(self, most: int = 400_000):
        super().__init__()
        self.most = most

    def __missing__(self, word: bytes) -> int:
        got = xxhash.xxh3_64_intdigest(word)
        if len(word) <= 40:
            if len(self) >= self.most:
                self.clear()
            self[word] = got
        return got

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> SHIFT)) * M2
    return x ^ (x >> np.uint64(32))


def rolled(h: np.ndarray, k: int, seed: int = 0) -> np.ndarray:
    """A hash of every k consecutive words; none if there are fewer."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, seed + k, np.uint64)
    for i in range(k):
        out = (out ^ h[i : i + n]) * M1
        out ^= out >> SHIFT
    return mixed(out)


def shingle_set(h: np.ndarray, k: int) -> np.ndarray:
    """Sorted distinct k-word shingles; of fewer words the whole sequence as one, of none nothing."""
    return np.unique(rolled(h, min(k, len(h)))) if len(h) else np.zeros(0, np.uint64)


# A word's hash is a polynomial in its bytes modulo 2**64, so that one running sum over a buffer of texts gives all
# words; it is the same wherever the word stands, since the sum between its ends is divided by the power at its start.
STEP = 1 << 16
ROOT = 0x9E3779B97F4A7C15
POWER = np.cumprod(np.concatenate((np.ones(1, "u8"), np.full(STEP - 1, ROOT, "u8"))))
UNDO = np.cumprod(np.concatenate((np.ones(1, "u8"), np.full(STEP - 1, pow(ROOT, -1, 1 << 64), "u8"))))
VALUE = np.random.default_rng(11).integers(1, 1 << 63, 256, dtype="u8") * np.uint64(2) + np.uint64(1)
LOWER = VALUE[np.frombuffer(bytes(range(256)).lower(), "u1")]
WORD = np.array([not bytes([i]).isspace() for i in range(256)])
LONG = 256


def slices(b: pa.RecordBatch, column: int, rows: int = 1000, size: int = 1 << 20) -> Iterator[pa.RecordBatch]:
    """b in pieces of at most `rows` rows, and of about `size` bytes of text in the column (one text at least)."""
    ends = buffers(b.column(column))[1]
    at = 0
    while at < b.num_rows:
        stop = min(at + rows, max(int(np.searchsorted(ends, ends[at] + size, "right")) - 1, at + 1), b.num_rows)
        yield b.slice(at, stop - at)
        at = stop
    # workers are kept for later tasks: pages that Arrow or the heap hold but do not use go back to the system
    pa.default_memory_pool().release_unused()
    TRIM(0)


def buffers(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The bytes of a column of texts, and where each begins; null is empty."""
    large = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    _, ends, data = texts.buffers()
    if not len(texts) or ends is None:
        return np.zeros(0, "u1"), np.zeros(len(texts) + 1, "i8")
    at = np.frombuffer(ends, "i8" if large else "i4")[texts.offset : texts.offset + len(texts) + 1].astype("i8")
    return (np.frombuffer(data, "u1") if data is not None else np.zeros(0, "u1"))[at[0] : at[-1]], at - at[0]


def word_places(data: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First and last byte of each word, and the number of words before each text; words are runs without ASCII white
    space, and no word goes over a text's end."""
    w = WORD[data]
    before, after = np.concatenate(([False], w[:-1])), np.concatenate((w[1:], [False]))
    before[at[:-1][at[:-1] < len(data)]] = False
    after[at[1:][at[1:] > 0] - 1] = False
    first = np.flatnonzero(w & ~before)
    return first, np.flatnonzero(w & ~after), np.searchsorted(first, at)


def word_hashes(texts: pa.Array, lower: bool) -> tuple[np.ndarray, np.ndarray]:
    """(64-bit hash of every word of all texts, number of words before each text); lower: A-Z as a-z."""
    data, at = buffers(texts)
    if not len(data):
        return np.zeros(0, "u8"), np.zeros(len(at), "i8")
    value, (first, last, words) = LOWER if lower else VALUE, word_places(data, at)
    out, upto = np.empty(len(first), "u8"), np.empty(len(first), "u8")
    total, scale, undo = np.uint64(0), np.uint64(1), np.uint64(1)
    a = z = 0
    with np.errstate(over="ignore"):
        for o in range(0, len(data), STEP):
            each = value[data[o : o + STEP]] * POWER[: min(STEP, len(data) - o)]
            ran = np.cumsum(each)
            b, y = np.searchsorted(first, o + STEP), np.searchsorted(last, o + STEP)
            s, e = first[a:b] - o, last[z:y] - o
            out[a:b] = UNDO[s] * undo
            upto[a:b] = total + scale * (ran[s] - each[s])
            # a word's value once its last byte is known
            out[z:y] *= (total + scale * ran[e]) - upto[z:y]
            a, z, total = b, y, total + scale * ran[-1]
            scale, undo = scale * POWER[-1] * np.uint64(ROOT), undo * UNDO[-1] * UNDO[1]
        size = (last - first + 1).astype("u8")
        out = mixed(out ^ size * M3)
    for i in np.flatnonzero(size > LONG):
        w = data[first[i] : last[i] + 1].tobytes()
        out[i] = xxhash.xxh3_64_intdigest(w.lower() if lower else w)
    return out, words


def shingle_sets(texts: pa.Array, k: int, lower: bool = True) -> list[np.ndarray]:
    """Sorted distinct k-word shingles of each text; of fewer words the whole sequence as one, of none nothing."""
    h, at = word_hashes(texts, lower)
    every, out = rolled(h, k), []
    for s, e in zip(at[:-1].tolist(), at[1:].tolist()):
        if e - s < k:
            out.append(rolled(h[s:e], e - s) if e > s else np.zeros(0, "u8"))
            continue
        x = np.sort(every[s : e - k + 1])
        new = np.empty(len(x), bool)
        new[0] = True
        np.not_equal(x[1:], x[:-1], out=new[1:])
        out.append(x[new])
    return out
