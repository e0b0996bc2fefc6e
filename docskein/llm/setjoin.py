"""Line deduplication by an exact set-similarity join.

A line is the set of its words. Two lines match when the Jaccard similarity of their sets is at least ``threshold``; a
line goes when an earlier line, by (doc_id, line number), matches it. Words of a line are ordered from rare to frequent by
counts over all documents (summed in hashed counters; any fixed order keeps the join exact). Matching lines share a word
within their prefixes, so every line sends its prefix words, with its place, size, their positions, and a parity sketch
of its set. Rows of a slice travel as packed arrays per partition of the word hash, not as single records.

Within a word, candidates must pass the length filter, the prefix bound of the shorter line, the positional filter (words
that can still be shared suffice) and the sketch: the symmetric difference has at least as many words as the sketches
have differing bits. What remains is verified on the real sets. Every line keeps its ``WIDE`` earliest candidates, of which
the first ``KEPT`` are verified, and the others only where none of these is confirmed; lines that have none after that
while more were seen get all of theirs in a second pass over the texts, so nothing is capped.

Sketches hold 128, 512 or 4096 bits by the size of the longer line; a line that may meet a longer class joins that too.
Equal sets are collapsed within a slice first, so a line that fills a third of the corpus sends one row per slice, and
words too frequent for one group are dealt over pairs of parts.

Defined cases: lines without a word stay, as do texts without lines to remove (null stays null). Words are compared as
64-bit hashes. Rows without ``doc_id`` take no part. Rows that repeat an id and its text count as
one document; rows that repeat an id with another text are documents of their own, in the order of a hash of the text.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.ordinals import numbered
from docskein.llm.words import Words, lines_in, mix, per_doc, slices, text_bytes, words_in
from docskein.session import stored

THRESHOLD = 0.8
COUNTERS = 18  # log2 of the hashed counters of the word order
PARTS = 64  # least number of partitions of prefix words; more for larger inputs
BYTES_PER_PART = 24 << 20  # text whose prefix words one partition holds
KEPT = 3  # earliest candidates of a line that are verified first
WIDE = 16  # earliest candidates of a line that are known without reading the texts again
CLASSES = ((160, 2), (640, 8), (1 << 40, 64))  # largest size, 64-bit words of sketch
SLICE = 5 << 20
BLOOM = 1 << 20  # bits that stand for open lines
WORD_BLOOM = 1 << 22  # bits that stand for words
_U = np.uint64
ROW = np.dtype([("token", "<u4"), ("size", "<u4"), ("position", "<u4"), ("line", "<u4"), ("doc", "<i8"), ("digest", "<u8")])


def needed(a, b, threshold: float = THRESHOLD):
    """Shared words that sets of sizes a and b need."""
    return np.ceil(threshold / (1 + threshold) * (a + b) - 1e-9).astype(np.int64)


def needed_of(size, threshold: float = THRESHOLD):
    """Words of a set of which any match has at least so many."""
    return np.ceil(threshold * size - 1e-9).astype(np.int64)


def prefix(size, threshold: float = THRESHOLD):
    """Words of a set of which a match must share one."""
    return size - np.ceil(threshold * size - 1e-9).astype(np.int64) + 1


def short_prefix(size, threshold: float = THRESHOLD):
    """The same against sets that are no smaller."""
    return size - np.ceil(2 * threshold / (1 + threshold) * size - 1e-9).astype(np.int64) + 1


def _by_count(uniq: np.ndarray, counters: np.ndarray) -> np.ndarray:
    """Order of distinct hashes by their counter, ties by hash."""
    count = counters[(uniq >> _U(64 - COUNTERS)).astype(np.int64)]
    key = count.astype(np.uint64) << _U(32) | uniq >> _U(32)
    order = np.argsort(key)
    key = key[order]
    return np.lexsort((uniq, count)) if (key[1:] == key[:-1]).any() else order


@dataclass
class Sought:
    """What a line must have to match an open one: a word of its prefix, and enough words of any open line for the smallest."""

    rare: np.ndarray
    words: np.ndarray
    least: int

    def lines(self, hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
        """Whether a line may match; words that repeat in it count each, so no line that does is missed."""
        slot = (hashes % _U(WORD_BLOOM)).astype(np.int64)
        return (per_doc(self.rare[slot], first) > 0) & (per_doc(self.words[slot], first) >= self.least)


class LineSets:
    """Word sets of the lines of a slice, rarest word first where ``counters`` tell: ``token[first[i]:first[i + 1]]`` of line i.

    Lines that ``only`` rules out are left empty.
    """

    def __init__(self, texts: pa.Array, counters: np.ndarray | None, only: Sought | None = None):
        self.buf, self.offsets = text_bytes(texts)
        self.start, self.end, self.doc = lines_in(self.buf, self.offsets)
        heads = np.flatnonzero(np.append(True, self.doc[1:] != self.doc[:-1])) if len(self.doc) else self.doc
        self.number = np.arange(len(self.doc)) - np.repeat(heads, np.diff(np.append(heads, len(self.doc))))
        w: Words = words_in(self.buf, self.offsets)
        # words and lines both ascend, so the few lines are looked up among the words
        heads = np.searchsorted(w.start, self.start)
        counts, hashes = np.diff(np.append(heads, len(w.start))), w.hashes()
        if only is not None:
            hit = only.lines(hashes, np.append(heads, len(hashes)))
            hashes, counts = hashes[np.repeat(hit, counts)], np.where(hit, counts, 0)
        code, uniq = pd.factorize(hashes, size_hint=len(hashes) // 4)
        if counters is not None:
            order = _by_count(uniq, counters)
            rank = np.empty(len(uniq), dtype=np.int64)
            rank[order] = np.arange(len(uniq))
            code, uniq = rank[code], uniq[order]
        bits = len(uniq).bit_length()
        key = np.sort(np.repeat(np.arange(len(counts)) << bits, counts) | code)
        key = key[np.append(True, key[1:] != key[:-1])] if len(key) else key
        self.token = uniq[key & ((1 << bits) - 1)]
        self.size = np.bincount(key >> bits, minlength=len(counts))
        self.first = np.concatenate([[0], np.cumsum(self.size)])


def _count_words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("block", pa.int32()), ("counts", pa.binary())])
    total, some = np.zeros(1 << COUNTERS, dtype=np.int64), False
    for rows in slices(batches):
        w = words_in(*text_bytes(rows.column(1)))
        total += np.bincount((w.hashes() >> _U(64 - COUNTERS)).astype(np.int64), minlength=1 << COUNTERS)
        some = True
    if some:
        blocks = np.minimum(total, 2**31 - 1).astype(np.int32).reshape(16, -1)
        yield batch(schema, np.arange(16), [b.tobytes() for b in blocks])


def _add_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, block = None, None
    for rows in batches:
        block = rows.column(0).slice(0, 1)
        for blob in rows.column(1):
            own = np.frombuffer(blob.as_buffer(), dtype=np.int32).astype(np.int64)
            total = own if total is None else total + own
    yield pa.RecordBatch.from_arrays([block, pa.array([np.minimum(total, 2**31 - 1).astype(np.int32).tobytes()], pa.binary())],
                                     names=["block", "counts"])


def word_counters(texts: DataFrame) -> np.ndarray:
    """Occurrences of all words, summed in 2**COUNTERS hashed counters."""
    found = texts.mapInArrow(_count_words, "block int, counts binary").groupBy("block").applyInArrow(
        _add_blocks, "block int, counts binary").collect()  # fixed size
    out = np.zeros((16, (1 << COUNTERS) // 16), dtype=np.int32)
    for r in found:
        out[r["block"]] = np.frombuffer(r["counts"], dtype=np.int32)
    return out.ravel()


def sketches(token: np.ndarray, line: np.ndarray, n: int, width: int) -> np.ndarray:
    """Parity sketch of each set: the XOR of one bit per word, in ``width`` 64-bit words."""
    bit = mix(token) & _U(64 * width - 1)
    if width <= 2 and n:
        # words of a set stand together, and no set is empty
        head = np.flatnonzero(np.append(True, line[1:] != line[:-1]))
        one, word = _U(1) << (bit & _U(63)), bit >> _U(6)
        return np.stack([np.bitwise_xor.reduceat(np.where(word == _U(k), one, _U(0)), head) for k in range(width)], axis=1)
    flips = np.bincount(line * (64 * width) + bit.astype(np.int64), minlength=n * 64 * width) & 1
    packed = np.packbits(flips.astype(np.uint8).reshape(n, -1), axis=1, bitorder="little")
    return packed.view(np.uint64).reshape(n, width)


FOUND = "doc_id long, line int, first_doc long, first_line int, sure boolean"
FOUND_NAMES = ("doc_id", "line", "first_doc", "first_line", "sure")
_SENT = pa.schema([("part", pa.int32()), ("rows", pa.binary()), ("sketch", pa.binary()), ("doc_id", pa.int64()), ("line", pa.int32()),
                   ("first_doc", pa.int64()), ("first_line", pa.int32())])
SENT = "part int, rows binary, sketch binary, doc_id long, line int, first_doc long, first_line int"
SQUARE = 8  # pieces of a very frequent word
HEAVY = 64  # counters whose words are so treated


def _sent(n: int, **columns) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(columns[f.name], f.type) if f.name in columns else pa.nulls(n, f.type) for f in _SENT],
                                      schema=_SENT)


def _targets(token: np.ndarray, piece: np.ndarray, parts: int, heavy: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(partition, row) of every prefix row. Rows of a very frequent word are cut into pieces, and each pair of pieces is a
    partition of its own."""
    part = ((token >> _U(32)) % _U(parts)).astype(np.int64)
    bucket = (token >> _U(64 - COUNTERS)).astype(np.int64)
    at = np.minimum(np.searchsorted(heavy, bucket), max(0, len(heavy) - 1))
    often = heavy[at] == bucket if len(heavy) else np.zeros(len(token), dtype=bool)
    rest, hot = np.flatnonzero(~often), np.flatnonzero(often)
    target, source = [part[rest]], [rest]
    for other in range(SQUARE if len(hot) else 0):
        low, high = np.minimum(piece[hot], other), np.maximum(piece[hot], other)
        target.append(parts + (at[hot] * SQUARE + low) * SQUARE + high)
        source.append(hot)
    return np.concatenate(target), np.concatenate(source)


def _emit(counters_sent, parts: int, only_sent=None):
    """Packed prefix rows by partition and class; lines that repeat a line of their own slice pass as they are.

    ``only_sent`` restricts rows to prefix words of open lines, and the work to lines that may match one.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters = counters_sent.value
        heavy = np.sort(np.argsort(-counters, kind="stable")[:HEAVY])
        only = None if only_sent is None else only_sent.value
        for rows in slices(batches, limit=SLICE):
            sets = LineSets(rows.column(1), counters, only)
            ids = rows.column(0).to_numpy()
            lines = np.flatnonzero(sets.size > 0)
            if not len(lines):
                continue
            doc, number, size = ids[sets.doc[lines]], sets.number[lines], sets.size[lines]
            owner = np.repeat(np.arange(len(lines)), size)
            sums = np.zeros(len(sets.token) + 1, dtype=np.uint64)
            np.cumsum(mix(sets.token), out=sums[1:])
            digest = mix(sums[sets.first[lines + 1]] - sums[sets.first[lines]]) + size.astype(np.uint64)
            # equal sets of the slice: the earliest speaks for all
            order = np.lexsort((number, doc, digest))
            head = np.append(True, digest[order][1:] != digest[order][:-1])
            speaker = np.empty(len(lines), dtype=np.int64)
            speaker[order] = order[np.maximum.accumulate(np.where(head, np.arange(len(order)), 0))]
            again = np.flatnonzero((doc != doc[speaker]) | (number != number[speaker]))
            if len(again):
                yield _sent(len(again), part=(doc[again] % parts) * len(CLASSES), doc_id=doc[again], line=number[again],
                            first_doc=doc[speaker[again]], first_line=number[speaker[again]])
            own, most = np.flatnonzero(speaker == np.arange(len(lines))), prefix(size)
            low = 0
            for kind, (high, width) in enumerate(CLASSES):
                # the longer line of a pair decides on its class
                member = own[(size[own] <= high) & (size[own] >= THRESHOLD * low - 1e-9)]
                low = high + 1
                if not len(member):
                    continue
                place = np.full(len(lines), -1)
                place[member] = np.arange(len(member))
                mine = np.flatnonzero(place[owner] >= 0)
                sketch = sketches(sets.token[mine], place[owner[mine]], len(member), width)
                position = mine - sets.first[lines][owner[mine]]
                keep = position < most[owner[mine]]
                if only is not None:
                    keep &= only.rare[(sets.token[mine] % _U(WORD_BLOOM)).astype(np.int64)]
                if not keep.any():
                    continue
                mine, position = mine[keep], position[keep]
                line, token = owner[mine], sets.token[mine]
                packed = np.empty(len(mine), dtype=ROW)
                packed["token"] = (token & _U(0xFFFFFFFF)).astype(np.uint32)
                packed["size"], packed["position"] = size[line], position
                packed["line"], packed["doc"], packed["digest"] = number[line], doc[line], digest[line]
                target, source = _targets(token, (digest[line] % _U(SQUARE)).astype(np.int64), parts, heavy)
                by = np.argsort(target, kind="stable")
                target, source = target[by], source[by]
                cut = np.flatnonzero(np.append(True, target[1:] != target[:-1]))
                stop = np.append(cut[1:], len(target))
                data, marks = packed[source], sketch[place[line[source]]]
                yield _sent(len(cut), part=target[cut] * len(CLASSES) + kind,
                            rows=[data[x:y].tobytes() for x, y in zip(cut, stop, strict=True)],
                            sketch=[marks[x:y].tobytes() for x, y in zip(cut, stop, strict=True)])

    return run


BLOCK = 64  # earlier lines that each line is compared with in a round


def candidates_in(rows: np.ndarray, sketch: np.ndarray, kind: int, kept: int | None, wanted: np.ndarray | None = None):
    """Arrays of (later doc, line, earlier doc, line): candidate pairs of one partition that pass all filters.

    Lines of a word stand in order; each round compares the lines that are still open with the next block of earlier
    ones. A line that has found more than ``kept`` is done, so many variants of one line cost a few rounds.
    """
    by_line = np.lexsort((rows["line"], rows["doc"]))
    # lines of a word in order: the word above the place in the order of lines, which is below 2**32
    order = by_line[(np.sort(rows["token"][by_line].astype(np.uint64) << _U(32) | np.arange(len(rows), dtype=np.uint64)) & _U(0xFFFFFFFF)).astype(np.int64)]
    token, digest, doc, line = (np.ascontiguousarray(rows[c])[order] for c in ("token", "digest", "doc", "line"))
    code, uniq = pd.factorize(mix(digest + mix(token.astype(np.uint64))))
    first = np.empty(len(uniq), dtype=np.int64)
    first[code[::-1]] = np.arange(len(code))[::-1]
    first = first[code]
    alone = (token != token[first]) | (digest != digest[first])  # another set with the same mixed hash
    head = alone | (first == np.arange(len(first)))
    again = np.flatnonzero(~head & ((doc != doc[first]) | (line != line[first])))
    again = again[rows["position"][order[again]] == 0]  # equal sets meet in every word: their first one tells
    if wanted is not None:
        again = again[wanted[bloom_slot(doc[again], line[again].astype(np.int64))]]
    if len(again):  # equal sets need no search
        yield np.stack([doc[again], line[again], doc[first[again]], line[first[again]]], axis=1).astype(np.int64)
    order, token, doc, line = order[head], token[head], doc[head], line[head].astype(np.int64)
    mark = sketch[order]
    size, position = (np.ascontiguousarray(rows[c])[order].astype(np.int64) for c in ("size", "position"))
    begin = np.flatnonzero(np.append(True, token[1:] != token[:-1])) if len(token) else order
    begin = np.repeat(begin, np.diff(np.append(begin, len(token))))
    low, high = (CLASSES[kind - 1][0] if kind else 0), CLASSES[kind][0]
    inside = position < short_prefix(size)  # the shorter one must meet within its short prefix
    # sizes that a match has; the longer line of a pair decides on its class
    least = np.maximum(np.ceil(THRESHOLD * size - 1e-9).astype(np.int64), np.where(size > low, 0, low + 1)).astype(np.int32)
    most = np.where(size <= high, np.minimum(np.floor((size + 1e-9) / THRESHOLD), high), -1).astype(np.int32)
    small = size.astype(np.int32)
    left = size - position
    hits = np.zeros(len(size), dtype=np.int64)
    live = np.flatnonzero(np.arange(len(size)) > begin)
    if wanted is not None:
        live = live[wanted[bloom_slot(doc[live], line[live])]]
    turn = 0
    while len(live):
        for at in range(0, len(live), 8192):
            j = live[at:at + 8192]
            from_ = begin[j] + turn * BLOCK
            n = np.minimum(j - from_, BLOCK)
            i = np.repeat(from_ - (np.cumsum(n) - n), n) + np.arange(n.sum())
            a = small[i]
            ok = np.flatnonzero((a >= np.repeat(least[j], n)) & (a <= np.repeat(most[j], n)))
            i, j = i[ok], np.repeat(j, n)[ok]
            a, b = size[i], size[j]
            ok = (inside[i] | (a > b)) & (inside[j] | (b > a))
            i, j = i[ok], j[ok]
            need = needed(size[i], size[j])
            ok = np.minimum(left[i], left[j]) >= need
            i, j, need = i[ok], j[ok], need[ok]
            apart = np.zeros(len(i), dtype=np.int64)
            for k in range(mark.shape[1]):
                apart += np.bitwise_count(mark[i, k] ^ mark[j, k])
            ok = apart <= size[i] + size[j] - 2 * need
            i, j = i[ok], j[ok]
            ok = (doc[i] != doc[j]) | (line[i] != line[j])
            i, j = i[ok], j[ok]
            if len(i):
                hits += np.bincount(j, minlength=len(hits))
                yield np.stack([doc[j], line[j], doc[i], line[i]], axis=1)
        turn += 1
        live = live[live > begin[live] + turn * BLOCK]
        if kept is not None:
            live = live[hits[live] <= kept]


def bloom_slot(doc: np.ndarray, line: np.ndarray) -> np.ndarray:
    return (mix(doc.astype(np.uint64) * _U(0x9E3779B97F4A7C15) + line.astype(np.uint64)) % _U(BLOOM)).astype(np.int64)


def earliest(pairs: np.ndarray, kept: int) -> np.ndarray:
    """At most ``kept + 1`` earliest partners of each line; the one beyond ``kept`` tells that there are more."""
    order = np.lexsort((pairs[:, 3], pairs[:, 2], pairs[:, 1], pairs[:, 0]))
    p = pairs[order]
    p = p[np.append(True, (p[1:] != p[:-1]).any(axis=1))]
    head = np.flatnonzero(np.append(True, (p[1:, :2] != p[:-1, :2]).any(axis=1)))
    rank = np.arange(len(p)) - np.repeat(head, np.diff(np.append(head, len(p))))
    return p[rank <= kept]


def _search(kept: int | None, wanted_sent=None):
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("first_doc", pa.int64()), ("first_line", pa.int32()), ("sure", pa.bool_())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows, marks, kind = [], [], 0
        for b in batches:
            told = b.filter(b.column(3).is_valid())
            if told.num_rows and kept is not None:
                yield pa.RecordBatch.from_arrays([*(told.column(k) for k in range(3, 7)), pa.array(np.ones(told.num_rows, dtype=bool))], schema=schema)
            sent = b.filter(b.column(1).is_valid())
            if sent.num_rows:
                kind = sent.column(0)[0].as_py() % len(CLASSES)
                rows += [np.frombuffer(x.as_buffer(), dtype=ROW) for x in sent.column(1)]
                marks += [np.frombuffer(x.as_buffer(), dtype=np.uint64) for x in sent.column(2)]
        if not rows:
            return
        data, mark = np.concatenate(rows), np.concatenate(marks).reshape(-1, CLASSES[kind][1])
        wanted = None if wanted_sent is None else wanted_sent.value
        best, waiting, held = np.empty((0, 4), dtype=np.int64), [], 0
        for pairs in candidates_in(data, mark, kind, kept, wanted):
            if kept is None:
                yield batch(schema, *pairs.T, np.zeros(len(pairs), dtype=bool))
                continue
            waiting.append(pairs)
            held += len(pairs)
            if held > 1 << 20:
                best, waiting, held = earliest(np.concatenate([best, *waiting]), kept), [], 0
        if kept is not None and (len(best) or waiting):
            best = earliest(np.concatenate([best, *waiting]), kept)
            yield batch(schema, *best.T, np.zeros(len(best), dtype=bool))

    return run


PICKED = "doc_id long, line int, first_doc long, first_line int, sure boolean, rank int, n int"


def _pick(kept: int):
    """Of lines that equal an earlier one, the earliest such; of others the ``kept`` earliest candidates, with their rank from
    0 and the number of candidates seen, more than ``kept`` where there are more."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("first_doc", pa.int64()), ("first_line", pa.int32()),
                        ("sure", pa.bool_()), ("rank", pa.int32()), ("n", pa.int32())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [np.stack([b.column(c).to_numpy(zero_copy_only=False).astype(np.int64) for c in FOUND_NAMES], axis=1) for b in batches]
        p = np.concatenate(held)
        p[:, 4] = 1 - p[:, 4]  # sure ones come first
        p = p[np.lexsort((p[:, 3], p[:, 2], p[:, 4], p[:, 1], p[:, 0]))]
        p = p[np.append(True, (p[1:] != p[:-1]).any(axis=1))]
        head = np.flatnonzero(np.append(True, (p[1:, :2] != p[:-1, :2]).any(axis=1)))
        n = np.diff(np.append(head, len(p)))
        rank, sure = np.arange(len(p)) - np.repeat(head, n), np.repeat(p[head, 4] == 0, n)
        keep = rank < np.where(sure, 1, kept)
        yield batch(schema, *p[keep, :4].T, sure[keep], rank[keep], np.repeat(n, n)[keep])

    return run


def picked_of(found: DataFrame, parts: int, kept: int) -> DataFrame:
    """``PICKED`` of the lines of ``found``. Partitions each name a line's earliest partners, so the earliest of all are among them."""
    dealt = found.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "line"), F.lit(parts)).cast("int"))
    return dealt.groupBy("bucket").applyInArrow(_pick(kept), PICKED)


def _sets_of(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Word sets of the wanted lines of each document: (doc_id, line, words)."""
    schema = pa.schema([("doc_id", pa.int64()), ("line", pa.int32()), ("words", pa.list_(pa.int64()))])
    for rows in slices(batches):
        wanted = rows.column(2)
        owner = np.repeat(np.arange(len(wanted)), np.diff(wanted.offsets.to_numpy()))
        number = wanted.flatten().to_numpy().astype(np.int64)
        buf, offsets = text_bytes(rows.column(1))
        start, end, doc = lines_in(buf, offsets)
        line = np.searchsorted(doc, owner) + number
        # the wanted lines alone, each as a text of its own
        data = [buf[a:b] for a, b in zip(start[line].tolist(), end[line].tolist(), strict=True)]
        ends = np.concatenate([[0], np.cumsum(end[line] - start[line])])
        alone = pa.LargeStringArray.from_buffers(len(line), pa.py_buffer(ends.astype(np.int64)),
                                                 pa.py_buffer(np.concatenate([*data, np.empty(0, np.uint8)])))
        sets = LineSets(alone, None)
        yield pa.RecordBatch.from_arrays(
            [rows.column(0).take(pa.array(owner)), pa.array(number, pa.int32()),
             pa.ListArray.from_arrays(pa.array(sets.first, pa.int32()), pa.array(sets.token.view(np.int64)))], schema=schema)


def _prefix_words(counters_sent):
    """Bits of the prefix words of each set (``kind`` 0) and of all its words (1), and the least size of a set (2)."""
    schema = pa.schema([("kind", pa.int32()), ("slot", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counters, seen, least = counters_sent.value, np.zeros((2, WORD_BLOOM), dtype=bool), 1 << 40
        for rows in batches:
            first = rows.column(0).offsets.to_numpy()
            first = first - first[0]
            token = rows.column(0).flatten().to_numpy().view(np.uint64)
            size = np.diff(first)
            owner = np.repeat(np.arange(len(size)), size)
            order = np.lexsort((token, counters[(token >> _U(64 - COUNTERS)).astype(np.int64)], owner))
            keep = np.arange(len(token)) - first[owner] < prefix(size)[owner]
            seen[0, (token[order][keep] % _U(WORD_BLOOM)).astype(np.int64)] = True
            seen[1, (token % _U(WORD_BLOOM)).astype(np.int64)] = True
            least = min(least, int(size.astype(np.int64).min(initial=least)))
        kind, slot = np.nonzero(seen)
        yield batch(schema, np.append(kind, 2), np.append(slot, least))

    return run


def verified(pairs: DataFrame, texts: DataFrame, single: bool) -> tuple[DataFrame, DataFrame]:
    """(``pairs`` with ``similar``: whether the Jaccard similarity of the two word sets reaches the threshold, sets).

    ``single`` tells that no id repeats in ``texts``.
    """
    ends = pairs.select("doc_id", "line").unionByName(pairs.select(F.col("first_doc").alias("doc_id"), F.col("first_line").alias("line")))
    lines = ends.groupBy("doc_id").agg(F.array_sort(F.collect_set("line")).alias("lines"))  # a document's own lines
    once = texts.join(lines.withColumnRenamed("doc_id", "_id"), F.col("doc_id") == F.col("_id")).select("doc_id", "text", "lines")
    found = once.mapInArrow(_sets_of, "doc_id long, line int, words array<long>")
    sets = stored(found if single else found.dropDuplicates(["doc_id", "line"]), "sets")
    left = sets.select("doc_id", "line", F.col("words").alias("a"))
    right = sets.select(F.col("doc_id").alias("first_doc"), F.col("line").alias("first_line"), F.col("words").alias("b"))
    both = F.size(F.array_intersect("a", "b"))
    return pairs.join(left, ["doc_id", "line"]).join(right, ["first_doc", "first_line"]).withColumn(
        "similar", both >= F.ceil(F.lit(THRESHOLD / (1 + THRESHOLD)) * (F.size("a") + F.size("b")) - 1e-9)).drop("a", "b"), sets


def repeated_lines(docs: DataFrame, kept: int = KEPT, wide: int = WIDE) -> DataFrame:
    """(doc_id, line, first_doc, first_line, text_key): every line that matches an earlier one, with the earliest found.

    Ids name the texts. Where an id has several texts, each of them gets a number in the order of id and hash instead, and
    ``text_key`` tells which of them a row belongs to; it is null where the id says it.
    """
    texts = docs.select(docs["doc_id"].cast("long").alias("doc_id"), docs["text"].cast("string").alias("text")).filter(
        "doc_id IS NOT NULL AND text IS NOT NULL")
    size = texts.agg(F.sum(F.octet_length("text")).alias("volume"), F.count("*").alias("n"), F.count_distinct("doc_id").alias("ids")).first()
    no_key = F.lit(None).cast("long").alias("text_key")
    if size["n"] == size["ids"]:
        return _repeated(texts, size["volume"] or 0, kept, wide, True).select("*", no_key)
    keyed = texts.withColumn("text_key", F.xxhash64("text"))
    names = stored(keyed.select("doc_id", "text_key").distinct(), "text-keys")
    if names.groupBy("doc_id").count().filter("count > 1").isEmpty():
        return _repeated(texts, size["volume"] or 0, kept, wide, False).select("*", no_key)
    named = stored(numbered(names, [F.col("doc_id"), F.col("text_key")], "place"), "text-numbers")
    once = stored(keyed.join(named, ["doc_id", "text_key"]).select(F.col("place").alias("doc_id"), "text").dropDuplicates(["doc_id"]), "texts")
    found = _repeated(once, size["volume"] or 0, kept, wide, True)
    own = named.select(F.col("place").alias("_own"), F.col("doc_id").alias("_id"), "text_key")
    first = named.select(F.col("place").alias("_first"), F.col("doc_id").alias("_first_id"))
    return found.join(own, F.col("doc_id") == F.col("_own")).join(first, F.col("first_doc") == F.col("_first")).select(
        F.col("_id").alias("doc_id"), "line", F.col("_first_id").alias("first_doc"), "first_line", "text_key")


def _owned(doc_id: Column, text_key: Column, lines: DataFrame, names: tuple[str, str]) -> Column:
    """Whether a row of this id and hash of the text is the text that a row of ``lines`` (id, key in ``names``) speaks of."""
    key = lines[names[1]]
    return (doc_id == lines[names[0]]) & (key.isNull() | (key == text_key))


def _repeated(texts: DataFrame, volume: int, kept: int, wide: int, single: bool) -> DataFrame:
    """``repeated_lines`` of (doc_id, text) where rows of one id have one text, and one row if ``single``."""
    wide = max(wide, kept + 1)  # an open line has another candidate to go on with
    spark = texts.sparkSession
    counters = spark.sparkContext.broadcast(word_counters(texts))  # fixed size
    parts = max(PARTS, -(-volume // BYTES_PER_PART))
    sent = texts.mapInArrow(_emit(counters, parts), SENT)
    found = stored(picked_of(sent.groupBy("part").applyInArrow(_search(wide), FOUND), parts, wide), "found")
    key = ["doc_id", "line"]
    earliest_similar = F.min(F.when(F.col("similar"), F.struct("first_doc", "first_line"))).alias("m")
    near = found.filter("NOT sure").drop("sure")
    checked, _ = verified(near.filter(F.col("rank") < kept), texts, single)
    first = stored(checked.groupBy(*key, "n").agg(earliest_similar), "verified")
    result = first.filter("m IS NOT NULL").select(*key, "m.first_doc", "m.first_line").unionByName(
        found.filter("sure").select(*key, "first_doc", "first_line"))
    open_ = stored(first.filter(F.col("m").isNull() & (F.col("n") > kept)).select(*key), "open")
    if open_.isEmpty():
        return result  # a line is in one of the parts, once
    later = stored(near.filter(F.col("rank") >= kept).join(open_, key, "left_semi"), "later")
    checked, sets = verified(later, texts, single)
    second = stored(checked.groupBy(*key, "n").agg(earliest_similar), "verified")
    result = result.unionByName(second.filter("m IS NOT NULL").select(*key, "m.first_doc", "m.first_line"))
    open_ = stored(second.filter(F.col("m").isNull() & (F.col("n") > wide)).select(*key), "open")
    if not open_.isEmpty():
        # a bit per hashed line: at most BLOOM
        slot = open_.mapInArrow(_slots, "slot long").distinct().collect()
        wanted = np.zeros(BLOOM, dtype=bool)
        wanted[[r["slot"] for r in slot]] = True
        # the second pass reads all texts again, but works only on lines that may match an open one
        of_words = sets.join(open_, key, "left_semi").select("words").mapInArrow(
            _prefix_words(counters), "kind int, slot long").distinct().toArrow()  # at most two of WORD_BLOOM
        kind, slot = of_words["kind"].to_numpy(), of_words["slot"].to_numpy()
        some = np.zeros((2, WORD_BLOOM), dtype=bool)
        some[kind[kind < 2], slot[kind < 2]] = True
        least = int(needed_of(slot[kind == 2].min()))
        again = texts.mapInArrow(_emit(counters, parts, spark.sparkContext.broadcast(Sought(some[0], some[1], least))), SENT)
        rest = again.groupBy("part").applyInArrow(_search(None, spark.sparkContext.broadcast(wanted)), FOUND).select(
            *key, "first_doc", "first_line").distinct().join(open_, key, "left_semi")
        more = verified(stored(rest, "rest"), texts, single)[0].filter("similar").groupBy(*key).agg(
            F.min(F.struct("first_doc", "first_line")).alias("m"))
        result = result.unionByName(more.select(*key, "m.first_doc", "m.first_line"))
    return result


def _slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for rows in batches:
        yield pa.RecordBatch.from_arrays([pa.array(bloom_slot(rows.column(0).to_numpy(), rows.column(1).to_numpy().astype(np.int64)))], names=["slot"])


def line_report(docs: DataFrame) -> DataFrame:
    """(doc_id, n_lines, removed, first_docs) of every row: numbers of the removed lines and the documents of their first
    matches."""
    gone = repeated_lines(docs).groupBy("doc_id", "text_key").agg(F.array_sort(F.collect_list(F.struct("line", "first_doc"))).alias("g")).withColumnsRenamed(
        {"doc_id": "_id", "text_key": "_key"})
    text = docs["text"].cast("string")
    lines = F.when(text.isNotNull(), F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1).otherwise(0)
    none = F.array().cast("array<struct<line:int,first_doc:bigint>>")
    # the texts themselves need not meet their lines
    rows = docs.select(docs["doc_id"].cast("long").alias("doc_id"), lines.alias("n_lines"), F.xxhash64(text).alias("_text"))
    return rows.join(gone, _owned(rows["doc_id"], rows["_text"], gone, ("_id", "_key")), "left").withColumn("g", F.coalesce("g", none)).select(
        "doc_id", "n_lines", F.col("g.line").alias("removed"), F.array_distinct(F.col("g.first_doc")).alias("first_docs"))


def without_repeated_lines(docs: DataFrame) -> DataFrame:
    """``docs`` without the lines that match an earlier line; other columns are unchanged."""
    gone = repeated_lines(docs).groupBy("doc_id", "text_key").agg(F.collect_set("line").alias("_gone")).withColumnsRenamed(
        {"doc_id": "_id", "text_key": "_key"})
    owned = _owned(docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")), gone, ("_id", "_key"))
    joined = docs.join(gone, owned, "left").select(*[docs[c] for c in docs.columns], gone["_gone"].alias("__gone"))
    names = docs.columns
    at, last = names.index("text"), len(names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches, "text"):
            texts, lists = rows.column(at).to_pylist(), rows.column(last).to_pylist()
            for k, lines in enumerate(lists):
                if lines and texts[k] is not None:
                    out = set(lines)
                    texts[k] = "\n".join(x for i, x in enumerate(texts[k].split("\n")) if i not in out)
            columns = [rows.column(i) if i != at else pa.array(texts, rows.column(at).type) for i in range(last)]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    return joined.mapInArrow(cut, docs.schema)
