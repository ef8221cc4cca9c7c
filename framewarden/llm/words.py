"""Words of whole texts as arrays of 64-bit hashes, computed for a slice of documents at a time.

A word is a run of bytes other than ASCII white space, lower-cased. The hash of a word is a polynomial in its bytes,
taken from one running sum over the slice, so no Python object is made per word.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

BASE = np.uint64(0x9E3779B97F4A7C15)
BASE_INVERSE = np.uint64(pow(int(BASE), -1, 1 << 64))
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
#: All ASCII bytes but letters: what is apart from the letters of a word.
NOT_LETTER = np.zeros(256, bool)
NOT_LETTER[:128] = [not chr(i).isalpha() for i in range(128)]
#: Bytes of text worked on at a time; a longer document is a slice of its own.
SLICE = 1 << 20


def give_back() -> None:
    """Return freed memory to the system when a task ends: its Python worker lives on and runs other tasks."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library
    if trim:
        trim(0)


def mix(x: np.ndarray) -> np.ndarray:
    """A bijective scramble of 64-bit integers (the finaliser of the public splitmix64 generator)."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Powers:
    """Powers of the base and of its inverse, grown on demand."""

    def __init__(self) -> None:
        self.up = self.down = np.ones(1, np.uint64)

    def get(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = max(n, SLICE + 1)
            self.up, self.down = (np.cumprod(np.concatenate([np.ones(1, np.uint64), np.full(size - 1, b)])) for b in (BASE, BASE_INVERSE))
        return self.up[:n], self.down[:n]


POWERS = Powers()


def slices(sizes: np.ndarray, most: int = SLICE) -> Iterator[tuple[int, int]]:
    """Ranges of rows with at most ``most`` bytes together, one row at least."""
    start = total = 0
    for i, n in enumerate(sizes.tolist()):
        if i > start and total + n > most:
            yield start, i
            start, total = i, 0
        total += n
    if len(sizes) > start:
        yield start, len(sizes)


def text_slices(batch: pa.RecordBatch, column: str = "text", most: int = SLICE) -> Iterator[tuple[pa.RecordBatch, list[str]]]:
    """Parts of an Arrow batch, each with its texts (null: empty)."""
    texts = batch.column(column)
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False)
    for a, b in slices(sizes, most):
        part = batch.slice(a, b - a)
        yield part, [t or "" for t in part.column(column).to_pylist()]


def word_spans(texts: list[str], lower: bool = True, apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of all texts, start and end of each word in them, and for each text the number of its first word (n + 1)."""
    whole = "\n".join(texts) + "\n"
    if lower:
        data = np.frombuffer(whole.lower().encode("utf-8", "surrogatepass"), np.uint8)
        sizes = np.array([len(t.lower().encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    else:
        data = np.frombuffer(whole.encode("utf-8", "surrogatepass"), np.uint8)
        sizes = np.array([len(t.encode("utf-8", "surrogatepass")) for t in texts], np.int64)
    inside = np.concatenate([[False], ~apart[data], [False]])
    edges = np.flatnonzero(inside[1:] != inside[:-1])
    starts, ends = edges[::2], edges[1::2]
    begins = np.concatenate([[0], np.cumsum(sizes + 1)])
    return data, starts, ends, np.searchsorted(starts, begins)


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    up, down = POWERS.get(len(data) + 1)
    sums = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[:-1], out=sums[1:])
    return mix((sums[ends] - sums[starts]) * down[starts])


def word_hashes(texts: list[str], apart: np.ndarray = SPACE) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words in order, and for each text the number of its first word (one more at the end)."""
    data, starts, ends, first = word_spans(texts, apart=apart)
    return span_hashes(data, starts, ends), first


def shingles(words: np.ndarray, first: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-word shingles of each text and their offsets by text; a text of 1 to n - 1 words has one, of them all."""
    counts = np.diff(first)
    total = len(words)
    padded = np.concatenate([words, np.zeros(n, np.uint64)])
    # short texts see zeros in place of the words of the next text
    ends = np.repeat(first[1:], counts)
    position = np.arange(total)
    out = np.zeros(total, np.uint64)
    for i in range(n):
        word = np.where(position + i < ends, padded[i : total + i], np.uint64(0)) if i else padded[:total]
        out = mix(out * BASE + word + np.uint64(1))
    per_text = np.where(counts >= n, counts - n + 1, np.minimum(counts, 1))
    keep = position - np.repeat(first[:-1], counts) < np.repeat(per_text, counts)
    return out[keep], np.concatenate([[0], np.cumsum(per_text)])


def shingle_multiset(text: str, n: int) -> tuple[np.ndarray, np.ndarray]:
    words, first = word_hashes([text])
    return np.unique(shingles(words, first, n)[0], return_counts=True)
