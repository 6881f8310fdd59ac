"""Whole Arrow batches of texts as byte arrays: words, hashes and shingles without a Python object per word."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Texts are worked on in pieces of about so many bytes, which bounds the memory of a Python worker.
PIECE = 1 << 19
_BASE = np.uint64(0x9E3779B97F4A7C15 | 1)
_powers: dict[str, np.ndarray] = {}


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser: every bit of the input moves every bit of the output."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def distinct(a: np.ndarray) -> np.ndarray:
    """The different numbers of an array, in order; sorting is faster here than np.unique()."""
    a = np.sort(a)
    return a[np.concatenate([[True], a[1:] != a[:-1]])] if len(a) else a


def grouped(key: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """An order in which equal keys stand together, and where each key's begin in it."""
    order = np.argsort(key)
    key = key[order]
    return order, np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]])) if len(key) else np.zeros(0, np.int64)


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, n of each at least."""
    if len(_powers.get("up", ())) < n:
        size = max(n, PIECE + 1024)
        inverse = np.uint64(pow(int(_BASE), -1, 1 << 64))
        for name, base in (("up", _BASE), ("down", inverse)):
            a = np.full(size, base, dtype=np.uint64)
            a[0] = 1
            _powers[name] = np.cumprod(a, dtype=np.uint64)
    return _powers["up"], _powers["down"]


def flat(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts and the offset at which each begins (one more offset than texts); null counts as empty."""
    column = pc.fill_null(column, "" if pa.types.is_string(column.type) or pa.types.is_large_string(column.type) else b"")
    wide = pa.types.is_large_string(column.type) or pa.types.is_large_binary(column.type)
    _, offsets, data = column.buffers()
    if not len(column):
        return np.empty(0, np.uint8), np.zeros(1, np.int64)
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.empty(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def pieces(off: np.ndarray, size: int = PIECE) -> Iterator[tuple[int, int]]:
    """Ranges of texts of about size bytes each; a longer text is a range of its own."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + size, "right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


def prefix(data: np.ndarray) -> np.ndarray:
    """Prefix sums of the polynomial hash, one longer than data."""
    up, _ = powers(len(data) + 1)
    out = np.zeros(len(data) + 1, np.uint64)
    np.cumsum((data.astype(np.uint64) + np.uint64(1)) * up[: len(data)], out=out[1:])
    return out


def span_hash(sums: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hashes of data[start:end]; equal bytes give equal hashes wherever they stand."""
    _, down = powers(len(sums))
    return mix((sums[end] - sums[start]) * down[start] + (end - start).astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


#: ASCII letters and digits and every byte beyond ASCII belong to words.
WORD_BYTES = np.array([b >= 128 or chr(b).isalnum() for b in range(256)])


def words(data: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash and text number of every word, and the number of words of each text."""
    is_word = WORD_BYTES[data]
    before, after = np.empty_like(is_word), np.empty_like(is_word)
    if len(data):
        before[0], before[1:], after[-1], after[:-1] = False, is_word[:-1], False, is_word[1:]
        first, last = off[:-1][off[:-1] < off[1:]], off[1:][off[:-1] < off[1:]] - 1
        before[first], after[last] = False, False
    start, end = np.flatnonzero(is_word & ~before), np.flatnonzero(is_word & ~after) + 1
    counts = np.diff(np.searchsorted(start, off))
    return span_hash(prefix(data), start, end), np.repeat(np.arange(len(off) - 1), counts), counts


def shingles(hashes: np.ndarray, text: np.ndarray, counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash and text number of every run of width words; a text with fewer words has one shingle of them all."""
    n = len(hashes) - width + 1
    total = np.zeros(max(n, 0), np.uint64)
    for k in range(width if n > 0 else 0):
        total = (total + hashes[k : k + n]) * _BASE
    inside = text[: max(n, 0)] == text[width - 1 :] if n > 0 else np.zeros(0, bool)
    total, owner = total[inside], text[: max(n, 0)][inside]
    begins = np.cumsum(counts) - counts
    short = [(np.uint64(0), 0)][:0]
    for i in np.flatnonzero((counts > 0) & (counts < width)):
        h = np.uint64(counts[i])
        with np.errstate(over="ignore"):
            for x in hashes[begins[i] : begins[i] + counts[i]]:
                h = (h + x) * _BASE
        short.append((h, i))
    if short:
        total = np.concatenate([total, np.array([x for x, _ in short], np.uint64)])
        owner = np.concatenate([owner, np.array([i for _, i in short], owner.dtype)])
        order = np.argsort(owner, kind="stable")
        total, owner = total[order], owner[order]
    return mix(total), owner
