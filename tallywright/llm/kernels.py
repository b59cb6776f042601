"""Numpy kernels over Arrow string columns: words, shingles and one-permutation sketches.

Texts are handled as UTF-8 bytes. The word separators (space, tab to carriage return) and the letters
A-Z are single bytes that never occur inside a longer code point, so byte-wise work is exact.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

U = np.uint64
SPACE = np.zeros(256, bool)
SPACE[[9, 10, 11, 12, 13, 32]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: An odd multiplier and its inverse modulo 2**64, for prefix hashes.
BASE = 0x9E3779B97F4A7C15
BASE_INVERSE = pow(BASE, -1, 1 << 64)
SHINGLE = 5
#: Texts are worked on in chunks of so many bytes and rows at most.
CHUNK_BYTES = 1 << 20
CHUNK_ROWS = 4096
#: Values of the sketches of a chunk's texts: some arrays of so many 64-bit words are alive at a time.
CHUNK_CELLS = 1 << 19
#: Bits of a hash that are kept where hashes of a chunk's texts are sorted with the text's number above them.
HASH_BITS = 52


def mix(h: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit words whose every output bit depends on every input bit."""
    h = h ^ (h >> U(33))
    h = h * U(0xFF51AFD7ED558CCD)
    h = h ^ (h >> U(33))
    h = h * U(0xC4CEB9FE1A85EC53)
    return h ^ (h >> U(33))


class _Powers:
    """Powers of BASE and of its inverse, grown when a longer chunk comes."""

    up = np.ones(1, U)
    down = np.ones(1, U)

    @classmethod
    def first(cls, n: int) -> tuple[np.ndarray, np.ndarray]:
        if len(cls.up) < n:
            tables = []
            for base in (BASE, BASE_INVERSE):
                p = np.full(n, base, U)
                p[0] = 1
                tables.append(np.multiply.accumulate(p))
            if n > CHUNK_BYTES + 1:  # of use for this chunk only
                return tuple(tables)
            cls.up, cls.down = tables
        return cls.up[:n], cls.down[:n]


@dataclass
class Chunk:
    """Some consecutive texts of a column. ``bounds`` are the texts' offsets in ``data``."""

    first_row: int
    data: np.ndarray
    bounds: np.ndarray

    @property
    def n(self) -> int:
        return len(self.bounds) - 1


def chunks(column: pa.Array | pa.ChunkedArray, most: int = CHUNK_BYTES, bins: int = 1) -> Iterator[Chunk]:
    """The column's texts (null: empty) in runs of at most ``most`` bytes, or one longer text.

    A run has so few texts that sketches of ``bins`` values stay within CHUNK_CELLS.
    """
    most_rows = max(1, min(CHUNK_ROWS, CHUNK_CELLS // bins))
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    column = pc.fill_null(column, "").cast(pa.large_string())
    if not len(column):
        return
    offsets = np.frombuffer(column.buffers()[1], np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2] or b"", np.uint8)
    at = 0
    while at < len(column):
        to = min(at + most_rows, max(at + 1, int(np.searchsorted(offsets, offsets[at] + most, side="right")) - 1))
        yield Chunk(at, data[offsets[at] : offsets[to]], offsets[at : to + 1] - offsets[at])
        at = to


def word_spans(c: Chunk) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start and end byte of each word, and its text's number in the chunk."""
    n = len(c.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    solid = ~SPACE[c.data]
    edge = np.zeros(n + 1, bool)
    edge[c.bounds] = True
    before = np.empty(n, bool)
    before[0], before[1:] = True, ~solid[:-1]
    after = np.empty(n, bool)
    after[-1], after[:-1] = True, ~solid[1:]
    starts = np.flatnonzero(solid & (before | edge[:-1]))
    ends = np.flatnonzero(solid & (after | edge[1:])) + 1
    return starts, ends, np.searchsorted(c.bounds, starts, side="right") - 1


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """A 64-bit hash of each span of bytes."""
    if not len(starts):
        return np.zeros(0, U)
    up, down = _Powers.first(len(data) + 1)
    total = np.zeros(len(data) + 1, U)
    np.cumsum((data.astype(U) + U(1)) * up[:-1], out=total[1:])
    return mix((total[ends] - total[starts]) * down[starts] + (ends - starts).astype(U))


def word_hashes(c: Chunk) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each word, A-Z lower-cased, and its text's number."""
    starts, ends, doc = word_spans(c)
    return span_hashes(LOWER[c.data], starts, ends), doc


def shingle_hashes(words: np.ndarray, doc: np.ndarray, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Hash of each run of k words in a text, in order, and its text's number.

    A text with fewer words has one run, all its words; a text without words has none.
    """
    n = len(words)
    if not n:
        return words, doc
    weights = [U(pow(0xD6E8FEB86659FD93, j + 1, 1 << 64)) for j in range(k)]
    long_h = long_doc = None
    if n >= k:
        whole = np.flatnonzero(doc[: n - k + 1] == doc[k - 1 :])
        h = np.zeros(len(whole), U)
        for j in range(k):
            h += words[whole + j] * weights[j]
        long_h, long_doc = mix(h), doc[whole]
    firsts = np.flatnonzero(np.concatenate(([True], doc[1:] != doc[:-1])))
    sizes = np.diff(np.append(firsts, n))
    short = sizes < k
    if short.any():
        place = np.arange(n) - np.repeat(firsts, sizes)
        part = words * np.array(weights, U)[np.minimum(place, k - 1)]
        sums = np.add.reduceat(part, firsts)[short] + sizes[short].astype(U)
        short_h, short_doc = mix(sums), doc[firsts[short]]
        if long_h is None:
            return short_h, short_doc
        h, d = np.concatenate((long_h, short_h)), np.concatenate((long_doc, short_doc))
        order = np.argsort(d, kind="stable")
        return h[order], d[order]
    return long_h, long_doc


def keyed(h: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """One integer per hash that sorts by text, then by the hash's upper HASH_BITS bits."""
    return (doc.astype(U) << U(HASH_BITS)) | (h >> U(64 - HASH_BITS))


def distinct_sorted(h: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The distinct hashes of each text, ascending within it, cut to HASH_BITS bits; texts keep their order.

    Of a text's n shingles two are confused with probability n**2 / 2**53.
    """
    if not len(h):
        return h, doc
    key = np.sort(keyed(h, doc))
    key = key[np.concatenate(([True], key[1:] != key[:-1]))]
    return key << U(64 - HASH_BITS), (key >> U(HASH_BITS)).astype(np.int64)


def probe_table(bins: int, probes: int = 2048) -> np.ndarray:
    """probes x bins: where an empty bin looks next, by a 2-universal hash of bin and attempt."""
    prime = (1 << 31) - 1
    draw = np.random.Generator(np.random.PCG64(20170806))
    a, b = draw.integers(1, prime, probes), draw.integers(0, prime, probes)
    return ((np.arange(bins)[None, :] * a[:, None] + b[:, None]) % prime % bins).astype(np.int32)


def one_permutation(h: np.ndarray, doc: np.ndarray, n: int, bins: int, probes: np.ndarray) -> np.ndarray:
    """n x bins sketch of each text's distinct sorted hashes (0 rows for texts without any).

    Each hash falls into one bin by its high bits and the least hash of a bin is kept; an empty bin
    copies the first filled bin on its own probe sequence (optimal densification). The few bins whose
    whole sequence meets none take the text's first filled bin.
    """
    out = np.zeros((n, bins), U)
    if not len(h):
        return out
    cell = doc * bins + ((h >> U(32)) * U(bins) >> U(32)).astype(np.int64)
    first = np.concatenate(([True], cell[1:] != cell[:-1]))  # hashes ascend, so their bins do
    flat, full = out.reshape(-1), np.zeros(n * bins, bool)
    flat[cell[first]] = h[first]
    full[cell[first]] = True
    source = flat.copy()
    has = np.zeros(n, bool)
    has[doc] = True
    left = np.flatnonzero(~full & np.repeat(has, bins))
    base, place = left - left % bins, left % bins
    for t in range(len(probes)):
        if not len(left):
            return out
        look = base + probes[t][place]
        hit = full[look]
        flat[left[hit]] = source[look[hit]]
        left, base, place = left[~hit], base[~hit], place[~hit]
    if len(left):
        cells = cell[first]
        head = np.full(n, -1)
        head[(cells // bins)[::-1]] = cells[::-1]
        flat[left] = source[head[left // bins]]
    return out
