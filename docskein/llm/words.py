"""Whole texts as byte arrays: words, lines and their 64-bit hashes for a slice of documents at once.

A task walks its Arrow batches in slices of bounded size, so memory follows the largest single document and never the
partition. A word is a run of bytes other than ``\x20`` and ``\x09``–``\x0D``; UTF-8 never uses these inside a character.
Word hashes are polynomial over a random byte table, finished by a bit mixer: 64 bits, equal for equal words in any
task. At 10^10 distinct words a given word meets another one with odds of about 10^-9.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc

SLICE_BYTES = 4 << 20
BLOCK_BYTES = 1 << 14  # of text whose running sums stay in the processor's cache

SPACE = np.zeros(256, dtype=bool)
SPACE[[32, 9, 10, 11, 12, 13]] = True
LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
_LOWER = LOWER.tobytes()

_U = np.uint64
_RANDOM = np.random.Generator(np.random.PCG64(20240229)).integers(1, 2**63, 256, dtype=np.uint64) * _U(2) + _U(1)
_BASE, _INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 2**64)
_powers: dict[int, np.ndarray] = {}


def _power(base: int, n: int) -> np.ndarray:
    """base**0 … base**(n-1) modulo 2**64; kept per worker up to the usual block size."""
    have = _powers.get(base)
    if have is None or len(have) < n:
        step = np.full(n, base, dtype=np.uint64)
        step[0] = 1
        have = np.multiply.accumulate(step)
        if n <= BLOCK_BYTES:
            _powers[base] = have
    return have[:n]


def mix(h: np.ndarray) -> np.ndarray:
    """Bijective 64-bit finaliser."""
    h = h ^ (h >> _U(30))
    h = h * _U(0xBF58476D1CE4E5B9)
    h = h ^ (h >> _U(27))
    h = h * _U(0x94D049BB133111EB)
    return h ^ (h >> _U(31))


def chain(*parts: np.ndarray) -> np.ndarray:
    """Order-dependent hash of parallel hash arrays."""
    out = parts[0]
    for p in parts[1:]:
        out = mix(out * _U(0x9E3779B97F4A7C15) + p)
    return out


def span_hashes(buf: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Hash of ``buf[start[i]:end[i]]`` for ascending spans that do not overlap."""
    out = np.empty(len(start), dtype=np.uint64)
    at, n = 0, len(start)
    number, value = np.empty(BLOCK_BYTES, dtype=np.intp), np.empty(BLOCK_BYTES, dtype=np.uint64)
    while at < n:
        lo = int(start[at])
        to = int(np.searchsorted(end, lo + BLOCK_BYTES, side="right"))
        to = max(to, at + 1)
        hi = int(end[to - 1])
        size = hi - lo
        if size > len(number):  # one long word
            number, value = np.empty(size, dtype=np.intp), np.empty(size, dtype=np.uint64)
        sums = np.empty(size + 1, dtype=np.uint64)
        sums[0] = 0
        number[:size] = buf[lo:hi]
        np.take(_RANDOM, number[:size], out=value[:size], mode="clip")
        np.multiply(value[:size], _power(_BASE, size), out=value[:size])
        np.cumsum(value[:size], out=sums[1:])
        s, e = start[at:to] - lo, end[at:to] - lo
        out[at:to] = (sums[e] - sums[s]) * _power(_INVERSE, hi - lo + 1)[s] + (e - s).astype(np.uint64)
        at = to
    return mix(out)


@dataclass
class Words:
    """Words of a slice: byte spans in ``buf`` and, per document, the range ``first[i]:first[i + 1]`` of its words."""

    buf: np.ndarray
    offsets: np.ndarray
    start: np.ndarray
    end: np.ndarray
    first: np.ndarray

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        """Document position of each word."""
        return np.repeat(np.arange(len(self.first) - 1), self.counts)

    def hashes(self) -> np.ndarray:
        return span_hashes(self.buf, self.start, self.end)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a string array; null counts as empty."""
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.combine_chunks()
    if texts.null_count:
        texts = pc.fill_null(texts, "")
    kind = np.int64 if pa.types.is_large_string(texts.type) else np.int32
    _, offs, data = texts.buffers()
    n = len(texts)
    offsets = np.frombuffer(offs, dtype=kind, count=n + 1 + texts.offset)[texts.offset:].astype(np.int64)
    lo, hi = int(offsets[0]), int(offsets[-1])
    buf = np.frombuffer(data, dtype=np.uint8, count=hi)[lo:] if data is not None and hi > lo else np.empty(0, np.uint8)
    return buf, offsets - lo


def words_in(buf: np.ndarray, offsets: np.ndarray, space: np.ndarray = SPACE) -> Words:
    """Runs of bytes outside ``space``, a table of 256 flags."""
    n = len(buf)
    if n == 0:
        none = np.empty(0, dtype=np.int64)
        return Words(buf, offsets, none, none, np.zeros(len(offsets), dtype=np.int64))
    inside = np.frombuffer(buf.tobytes().translate((~space).tobytes()), dtype=bool)
    edge = offsets[(offsets > 0) & (offsets < n)]
    starts = inside.copy()
    starts[1:] &= ~inside[:-1]
    starts[edge] = inside[edge]
    ends = inside.copy()
    ends[:-1] &= ~inside[1:]
    ends[edge - 1] = inside[edge - 1]
    start = np.flatnonzero(starts)
    return Words(buf, offsets, start, np.flatnonzero(ends) + 1, np.searchsorted(start, offsets))


def words(texts: pa.Array, lower: bool = False) -> Words:
    """Words of every text; ``lower`` folds A–Z first."""
    buf, offsets = text_bytes(texts)
    return words_in(np.frombuffer(buf.tobytes().translate(_LOWER), dtype=np.uint8) if lower else buf, offsets)


def lines_in(buf: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(start, end, doc) of every \\n-separated line, empty ones included; an empty text is one empty line."""
    breaks = np.flatnonzero(buf == 10)
    owner = np.searchsorted(offsets, breaks, side="right") - 1
    start = np.concatenate([offsets[:-1], breaks + 1])
    doc = np.concatenate([np.arange(len(offsets) - 1), owner])
    order = np.lexsort((start, doc))
    start, doc = start[order], doc[order]
    end = np.empty_like(start)
    end[:-1] = start[1:] - 1
    last = np.flatnonzero(np.append(doc[1:] != doc[:-1], True))
    end[last] = offsets[doc[last] + 1]
    return start, end, doc


def slices(batches: Iterator[pa.RecordBatch], column: str = "text", limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Rows of all batches in runs of at most ``limit`` bytes of text, or of one longer text."""
    for batch in batches:
        if batch.num_rows == 0:
            continue
        _, offsets = text_bytes(batch.column(batch.schema.get_field_index(column)))
        at, n = 0, batch.num_rows
        while at < n:
            to = max(int(np.searchsorted(offsets, offsets[at] + limit, side="right")) - 1, at + 1)
            yield batch.slice(at, to - at)
            at = to


def distinct(values: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(sorted distinct values, first place of each, number of each value): ``np.unique`` by a hash table."""
    code, found = pd.factorize(values)
    order = np.argsort(found)
    rank = np.empty(len(found), dtype=np.int64)
    rank[order] = np.arange(len(found))
    first = np.empty(len(found), dtype=np.int64)
    first[code[::-1]] = np.arange(len(values))[::-1]
    return found[order], first[order], rank[code]


def per_doc(values: np.ndarray, first: np.ndarray, dtype=None) -> np.ndarray:
    """Sums of ``values`` over the ranges ``first[i]:first[i + 1]``, of which some may be empty."""
    sums = np.zeros(len(values) + 1, dtype=dtype or (np.float64 if values.dtype.kind == "f" else np.int64))
    np.cumsum(values, out=sums[1:])
    return sums[first[1:]] - sums[first[:-1]]
