"""Language-model scores by logistic mixing of hashed-context bit predictors.

A text is scored as its lower-cased words, each closed by a space, and one end byte. The bits of a byte are predicted
from the most significant one down, in contexts of one to four bytes of the word, of the place in it, of its whole prefix,
and of an outer context: the group of the last guide word before it. Guide words are the most frequent words of the
training documents, grouped by which follow which, so a group stands for a language or a register. A context is hashed with the bits already seen into
tables of fixed size that hold counts of zeros and ones, so the tables of all training documents are sums and are
gathered by one aggregation over the training words. A word of over ``SEGMENT`` bytes is a run of segments, each of which
goes on in the last bytes of the one before it; all of it is learned and scored. A predictor gives stretch(p) and a confidence that grows with its
counts; the mixer combines them with a set of weights that a gate (how often the prefix was seen, and bit position)
selects; a second stage refines the mixed probability by an adaptive map per gate. Weights and map are learned online,
in mini-batches over the training words, in every task on its own share, and averaged by the number of bits behind them.
Learning predicts each occurrence as if it were not among the counts (counts less its own).

No other context of the letters reaches beyond a word, so a word after a group has one probability, and words are looked
up. What grows with the corpus is the table of phrases and their contexts of two words (``phrases.py``): where a text goes on
as it did before, the whole phrase is priced by its context instead of word by word. The most frequent ones, a bounded table, carry their count and score to all tasks; counts of rarer words meet their
documents in a join on the 64-bit word hash, and rarer words are scored where they stand.

``score`` is log10 P(text) of this model, for a training document with each phrase's own occurrence left out; ``base_score`` that of the add-one unigram model of the training words.

Defined cases: null and empty texts are the end byte alone. Rows without ``doc_id`` are scored as held out or not by the
CRC of an empty id. Without training documents all counts are 0: the base gives every token 1/1, and the model
predicts each bit by 1/2. Ids that repeat are scored each.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm import phrases
from docskein.llm.base import batch, tidy
from docskein.llm.words import distinct as numbered
from docskein.llm.words import mix, per_doc, slices, words
from docskein.session import stored

SLOTS = 20  # log2 of the counters of one predictor
PREDICTORS = 7
FREQUENT = 1 << 20  # words whose counts and scores travel to all tasks
SEGMENT = 256  # bytes of a word, its closing space included, that are looked at together
SLICE = 2 << 20  # bytes of text in memory at once, but for one longer text
PIECES = 1 << 15  # bytes of segments whose bits are in memory at once
ALIKE = 1 << 16  # words that are put in order, so that common beginnings are looked at once
DEPTHS = np.array([0, 1, 2, 4, 8, 32, 256, 4096])  # counts of a prefix that select the weights
GATES = 8 * len(DEPTHS)
MAP = 49  # points of the refining map
ROWS_PER_TABLE = 1_000_000
BLOCKS = 16  # parts of a table that are summed apart
GUIDES, GROUPS = 32, 6  # most frequent words whose group is the outer context, and groups of them
REMEMBERED = 300_000  # scores of rarer words that a worker keeps before it starts anew
END_WORD = b""  # the end token
_U = np.uint64
LIMIT = 12.0  # of stretch


def _squash(z):
    return 1 / (1 + np.exp(-np.clip(z, -LIMIT, LIMIT)))


class Pieces:
    """Segments of tokens: their bytes, the four bytes before each, the token, and whether it goes on a word."""

    def __init__(self, tokens: list[bytes]):
        self.data: list[bytes] = []
        self.lead: list[bytes] = []
        self.token: list[int] = []
        if max(map(len, tokens), default=0) < SEGMENT:
            self.data = [t + b" " if t else b"\x00" for t in tokens]
            self.lead, self.token = [b"    "] * len(tokens), range(len(tokens))
            return
        for i, t in enumerate(tokens):
            whole = t + b" " if t else b"\x00"  # the end token is a zero byte where a word would begin
            for at in range(0, len(whole), SEGMENT):
                self.data.append(whole[at:at + SEGMENT])
                self.lead.append(whole[at - 4:at] if at else b"    ")
                self.token.append(i)

    def runs(self, limit: int = PIECES) -> Iterator[tuple[list[bytes], list[bytes], np.ndarray]]:
        """(bytes, leads, tokens) of at most ``limit`` bytes."""
        token = np.array(self.token, dtype=np.int64)
        ends = np.cumsum(np.fromiter(map(len, self.data), dtype=np.int64, count=len(self.data)))
        at = 0
        while at < len(self.data):
            to = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + limit, side="right"))
            yield self.data[at:to], self.lead[at:to], token[at:to]
            at = to


def by_prefix(tokens: list[bytes], groups: np.ndarray) -> np.ndarray:
    """An order of tokens in which those of a group that begin alike stand together."""
    key = np.frombuffer(b"".join([t[:8].ljust(8, b"\0") for t in tokens]), dtype=">u8").astype(np.uint64)
    return np.argsort(key >> _U(8) | groups.astype(np.uint64) << _U(56), kind="stable")


class BitStream:
    """Bits and table slots of a batch of segments, laid out byte by byte.

    A byte that continues the same beginning after the same group as in the segment before has the same slots, so it is
    laid out once: ``place`` tells for every byte of the segments where.
    """

    def __init__(self, data: list[bytes], lead: list[bytes], groups: np.ndarray):
        self.size = np.fromiter(map(len, data), dtype=np.int64, count=len(data))
        buf = np.frombuffer(b"".join(data), dtype=np.uint8).astype(np.uint64)
        first = np.cumsum(self.size) - self.size
        place = np.arange(len(buf)) - np.repeat(first, self.size)
        before = np.frombuffer(b"".join(lead), dtype=np.uint8).reshape(-1, 4).astype(np.uint64)
        word = before @ np.array([1 << 24, 1 << 16, 1 << 8, 1], dtype=np.uint64) - _U(0x20202020)
        inside = word > 0  # segments that go on a word
        back = []
        for k in range(1, 5):  # k bytes back, 0x20 before the word
            b = np.full(len(buf), 32, dtype=np.uint64)
            b[k:] = buf[:-k]
            for p in range(k):
                at = np.flatnonzero(self.size > p)
                b[first[at] + p] = before[at, 4 - k + p]
            back.append(b)
        sums = np.zeros(len(buf) + 1, dtype=np.uint64)
        np.cumsum((buf + _U(1)) * _BYTE * prefix_powers(int(self.size.max(initial=1)))[place], out=sums[1:])
        prefix = sums[:-1] - np.repeat(sums[first], self.size) + np.repeat(np.where(inside, mix(word), _U(0)), self.size)
        length = np.where(np.repeat(inside, self.size), 15, np.minimum(place, 15)).astype(np.uint64)
        two = back[0] << _U(8) | back[1]
        group = np.repeat(groups.astype(np.uint64), self.size) + _U(1)
        contexts = [back[0] << _U(8) | group, two, two << _U(8) | back[2], two << _U(16) | back[2] << _U(8) | back[3],
                    two << _U(16) | length << _U(8) | group, prefix, mix(prefix + group)]
        new = self._new(buf, place, first, word, groups)
        at = np.flatnonzero(new)
        buf, contexts = buf[at], [c[at] for c in contexts]
        mixed = [mix(c * _U(0x9E3779B97F4A7C15) + _U(k + 1)) for k, c in enumerate(contexts)]
        self.slots = np.empty((8, PREDICTORS, len(buf)), dtype=np.int32)
        self.bits = np.empty((8, len(buf)), dtype=np.int32)
        seen = np.ones(len(buf), dtype=np.uint64)
        for bit in range(8):
            self.bits[bit] = (buf >> _U(7 - bit)) & _U(1)
            salt = seen * _U(0xD6E8FEB86659FD93)
            for k in range(PREDICTORS):
                h = (mixed[k] + salt) * _U(0xBF58476D1CE4E5B9)
                self.slots[bit, k] = (h ^ (h >> _U(32))) & _U((1 << SLOTS) - 1)
            seen = seen << _U(1) | self.bits[bit].astype(np.uint64)

    def _new(self, buf: np.ndarray, place: np.ndarray, first: np.ndarray, lead: np.ndarray, groups: np.ndarray) -> np.ndarray:
        """Whether a byte is the first of its slots; sets ``place``."""
        n = len(buf)
        alike = np.zeros(len(first), dtype=bool)
        alike[1:] = (lead[1:] == lead[:-1]) & (groups[1:] == groups[:-1])
        before, size = np.append(0, first[:-1]), np.append(0, self.size[:-1])
        other = np.repeat(before, self.size) + place
        equal = np.repeat(alike, self.size) & (place < np.repeat(size, self.size))
        equal &= buf[np.minimum(other, n - 1)] == buf
        # up to the first byte that differs
        until = np.minimum.reduceat(np.where(equal, n, place), first) if n else first
        new = place >= np.repeat(until, self.size)
        number = np.cumsum(new) - 1
        # a byte that is not new has the slots of the last new one at its place in a segment
        order = np.argsort(np.minimum(place, 65535).astype(np.uint16), kind="stable")
        self.place = np.empty(n, dtype=np.int64)
        self.place[order] = number[order[np.maximum.accumulate(np.where(new[order], np.arange(n), 0))]] if n else 0
        return new

    def repeat(self, values: np.ndarray) -> np.ndarray:
        """A value of each segment at each of its bytes, summed where bytes are laid out together."""
        return np.bincount(self.place, np.repeat(values, self.size), self.bits.shape[1])

    def per_segment(self, values: np.ndarray) -> np.ndarray:
        """Sums over the bytes of each segment of a value of each byte laid out."""
        return np.add.reduceat(values[self.place], np.cumsum(self.size) - self.size)


_BYTE = _U(0x9E3779B97F4A7C15)
_prefix: list[np.ndarray] = []


def prefix_powers(n: int) -> np.ndarray:
    if not _prefix or len(_prefix[0]) < n:
        step = np.full(max(n, 64), 0xD1342543DE82EF95, dtype=np.uint64)
        step[0] = 1
        _prefix[:] = [np.multiply.accumulate(step)]
    return _prefix[0]


def count_bits(tokens: list[bytes], groups: np.ndarray, times: np.ndarray, into: np.ndarray) -> None:
    """Add the bits of ``tokens``, each seen ``times``, to the table ``into[predictor, slot, bit]``.

    A word seen once teaches its letters, not itself: it does not enter the prefix tables.
    """
    flat = into.reshape(PREDICTORS, -1)
    order = by_prefix(tokens, groups)
    tokens, groups, times = [tokens[i] for i in order.tolist()], groups[order], times[order].astype(np.float64)
    for data, lead, token in Pieces(tokens).runs():
        stream = BitStream(data, lead, groups[token])
        weight, often = stream.repeat(times[token]), stream.repeat(np.where(times > 1, times, 0.0)[token])
        again = np.flatnonzero(often)
        for bit in range(8):
            for k in range(PREDICTORS):
                at = stream.slots[bit, k] * 2 + stream.bits[bit]
                if k < PREDICTORS - 2:
                    np.add.at(flat[k], at, weight)
                else:
                    np.add.at(flat[k], at[again], often[again])


def _log_odds(n0, n1):
    return np.log((n1 + np.float32(0.4)) / (n0 + np.float32(0.4)))


def _depth(count):
    return (np.searchsorted(DEPTHS, count, side="right") - 1).astype(np.uint8)


class Model:
    """Tables of log odds, gated weights and refining map."""

    def __init__(self, odds: np.ndarray | None, depth: np.ndarray | None, weights: np.ndarray | None = None,
                 refine: np.ndarray | None = None):
        self.odds, self.depth = odds, depth
        if weights is None:
            weights = np.full((GATES, PREDICTORS + 1), 0.13)
            # a well-known prefix speaks for itself
            weights[:, PREDICTORS - 1] = np.repeat(np.linspace(0.1, 0.97, len(DEPTHS)), 8)
            weights[:, :PREDICTORS - 1] *= np.repeat(np.linspace(1.6, 0.03, len(DEPTHS)), 8)[:, None]
            weights[:, PREDICTORS] = 0
        self.weights = weights.astype(np.float64)
        self.refine = np.tile(_squash(np.linspace(-LIMIT, LIMIT, MAP)), (GATES, 1)) if refine is None else refine

    @staticmethod
    def arrays(tables: np.ndarray) -> dict:
        """Log odds of every slot, and the class of the count of the deepest context, which selects the weights."""
        return {"odds": _log_odds(tables[..., 0], tables[..., 1]), "depth": _depth(tables[-1].sum(axis=-1))}

    def leave_out(self, tables: Iterable[np.ndarray]) -> Model:
        """Prepare for learning: log odds, by slot and bit, as if an occurrence that brings the bit were not among the counts."""
        without = np.empty((PREDICTORS, 2 << SLOTS), dtype=np.float32)
        for k, table in enumerate(tables):
            n0, n1 = table[:, 0], table[:, 1]
            without[k, 0::2] = _log_odds(np.maximum(n0 - 1, 0), n1)
            without[k, 1::2] = _log_odds(n0, np.maximum(n1 - 1, 0))
        # the deepest context's count selects the weights
        self.without, self.depth_without = without, _depth(np.maximum(table.sum(axis=-1) - 1, 0))
        return self

    def _predict(self, stream: BitStream, bit: int, learning: bool = False):
        slots = stream.slots[bit]
        if learning:
            x = [self.without[k].take(slots[k] * 2 + stream.bits[bit]) for k in range(PREDICTORS)]
            gate = self.depth_without.take(slots[-1]).astype(np.int64) * 8 + bit
        else:
            x = [self.odds[k].take(slots[k]) for k in range(PREDICTORS)]
            gate = self.depth.take(slots[-1]).astype(np.int64) * 8 + bit
        weights = np.ascontiguousarray(self.weights.T)
        z = weights[PREDICTORS].take(gate)
        for k in range(PREDICTORS):
            z += weights[k].take(gate) * x[k]
        return x, gate, np.clip(z, -LIMIT + 0.01, LIMIT - 0.01)

    def _refined(self, gate, z):
        at = (z + LIMIT) * ((MAP - 1) / (2 * LIMIT))
        lo = at.astype(np.int64)
        part = at - lo
        key = gate * MAP + lo
        flat = self.refine.ravel()
        q = flat.take(key) * (1 - part) + flat.take(key + 1) * part
        return np.clip(0.5 * (_squash(z) + q), 1e-6, 1 - 1e-6), key, part

    def log10(self, tokens: list[bytes], groups: np.ndarray) -> np.ndarray:
        """log10 probability of each token after a word of its group, its closing space included."""
        order = by_prefix(tokens, groups)
        tokens, groups, out = [tokens[i] for i in order.tolist()], groups[order], np.zeros(len(tokens))
        for data, lead, token in Pieces(tokens).runs():
            stream = BitStream(data, lead, groups[token])
            product = np.ones(stream.bits.shape[1])
            for bit in range(8):
                _, gate, z = self._predict(stream, bit)
                p, _, _ = self._refined(gate, z)
                product *= np.where(stream.bits[bit] == 1, p, 1 - p)
            out[order] += np.bincount(token, stream.per_segment(np.log10(product)), len(tokens))
        return out

    def learn(self, tokens: list[bytes], groups: np.ndarray, times: np.ndarray, rate: float) -> float:
        """An online step for each run of a mini-batch of words, weighted by ``times``; returns the bits behind it."""
        total, order = 0.0, by_prefix(tokens, groups)
        tokens, groups, times = [tokens[i] for i in order.tolist()], groups[order], times[order]
        for data, lead, token in Pieces(tokens).runs():
            total += self._step(BitStream(data, lead, groups[token]), times[token].astype(np.float64), rate)
        return total

    def _step(self, stream: BitStream, times: np.ndarray, rate: float) -> float:
        weight = stream.repeat(times)
        for bit in range(8):
            x, gate, z = self._predict(stream, bit, True)
            own = stream.bits[bit]
            err = (own - _squash(z)) * weight
            mass = np.bincount(gate, weight, GATES)
            live = mass > 0
            step = rate / np.maximum(mass, 1e-9)
            for k in range(PREDICTORS):
                self.weights[:, k] += step * np.bincount(gate, err * x[k], GATES)
            self.weights[:, PREDICTORS] += step * np.bincount(gate, err, GATES) * live
            _, key, part = self._refined(gate, z)
            flat = self.refine.ravel()
            near = key + (part > 0.5)
            mass = np.bincount(near, weight, len(flat))
            hit = np.bincount(near, weight * own, len(flat))
            flat += 0.1 * (hit - mass * flat) / (mass + 50)
        return float(weight.sum() * 8)


class Packed:
    """Tables of counts as compressed blocks: each executor holds a copy of a broadcast on its disk, and the driver unpacks none."""

    def __init__(self, blocks: dict[int, bytes]):
        self.blocks = blocks

    def table(self, k: int) -> np.ndarray:
        out = np.zeros((BLOCKS, (2 << SLOTS) // BLOCKS), dtype=np.float32)
        for i in range(BLOCKS):
            if k * BLOCKS + i in self.blocks:
                out[i] = np.frombuffer(pa.decompress(self.blocks[k * BLOCKS + i], out[i].nbytes, codec="zstd"), dtype=np.float32)
        return out.reshape(-1, 2)

    def model(self, learned: dict) -> Model:
        """The model that scores, one table unpacked at a time."""
        odds = np.empty((PREDICTORS, 1 << SLOTS), dtype=np.float32)
        for k in range(PREDICTORS):
            table = self.table(k)
            odds[k] = _log_odds(table[:, 0], table[:, 1])
        return Model(odds, _depth(table.sum(axis=-1)), **learned)


def in_training(ids: pa.Array, held: int = 2, parts: int = 7) -> np.ndarray:
    return np.array([zlib.crc32(b"" if i is None else str(i).encode()) % parts != held for i in ids.to_pylist()], dtype=bool)


class Guides:
    """The guide words with their groups: the last guide word before a word is its outer context."""

    def __init__(self, hashes: np.ndarray, groups: np.ndarray):
        order = np.argsort(hashes)
        self.hashes, self.groups = hashes[order], groups[order]

    def number(self, hashes: np.ndarray) -> np.ndarray:
        """Position of each word in ``hashes`` among the guides, or -1."""
        if not len(self.hashes):
            return np.full(len(hashes), -1)
        at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
        return np.where(self.hashes[at] == hashes, at, -1)

    def before(self, w, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(guide before each word, guide before each end token): -1 where the document had none so far."""
        number = self.number(hashes)
        last = np.maximum.accumulate(np.where(number >= 0, np.arange(len(number)), -1)) if len(number) else number
        prior = np.concatenate([[-1], last[:-1]]) if len(number) else last
        begin = np.repeat(w.first[:-1], w.counts)
        words_ = np.where(prior >= begin, number[prior], -1)
        ends = w.first[1:] - 1
        if not len(number):
            return words_, np.full(len(ends), -1)
        at = last[np.maximum(ends, 0)]
        return words_, np.where((w.counts > 0) & (at >= w.first[:-1]), number[at], -1)

    def of(self, number: np.ndarray) -> np.ndarray:
        """Group 1… of guide numbers, 0 for none."""
        return np.where(number >= 0, self.groups[number], 0) if len(self.groups) else np.zeros(len(number), dtype=np.int64)


@tidy
def _first_look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of the training documents of each slice: words that make up a thousandth of it, at most a thousand a slice, with no
    context, and phrases with theirs."""
    schema = pa.schema([("ctx", pa.int64()), ("h", pa.int64()), ("c", pa.int64())])
    for rows in slices(batches, limit=SLICE):
        w = words(rows.column(1), lower=True)
        hashes, train = w.hashes(), in_training(rows.column(0))
        seen, _, place = numbered(hashes[np.repeat(train, w.counts)])
        times = np.bincount(place, minlength=len(seen))
        top = times * 1000 >= max(1, times.sum())
        yield batch(schema, pa.nulls(int(top.sum()), pa.int64()), seen[top].view(np.int64), times[top])
        context, key, count = phrases.count(w, hashes, train)
        yield batch(schema, context.view(np.int64), key.view(np.int64), count)


def _successors(guides: Guides):
    schema = pa.schema([("a", pa.int32()), ("b", pa.int32()), ("c", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = len(guides.hashes)
        total = np.zeros(n * n, dtype=np.int64)
        for rows in slices(batches, limit=SLICE):
            w = words(rows.column(1), lower=True)
            hashes = w.hashes()
            number = guides.number(hashes)
            prior, _ = guides.before(w, hashes)
            ok = (number >= 0) & (prior >= 0) & np.repeat(in_training(rows.column(0)), w.counts)
            total += np.bincount(prior[ok] * n + number[ok], minlength=n * n)
        at = np.flatnonzero(total)
        yield batch(schema, at // max(n, 1), at % max(n, 1), total[at])

    return run


def group_guides(follow: np.ndarray, groups: int) -> np.ndarray:
    """Groups 1… of guide words by whom they follow and precede: the closest pair of groups joins until ``groups`` remain."""
    n = len(follow)
    vector = np.concatenate([follow, follow.T], axis=1) + 0.5
    member = [[i] for i in range(n)]
    sums = [v for v in vector]
    while len(member) > groups:
        unit_ = np.array([s / np.linalg.norm(s) for s in sums])
        near = unit_ @ unit_.T - 2 * np.eye(len(unit_))
        i, j = sorted(divmod(int(np.argmax(near)), len(unit_)))
        member[i] += member.pop(j)
        sums[i] = sums[i] + sums.pop(j)
    out = np.zeros(n, dtype=np.int64)
    for g, m in enumerate(member):
        out[m] = g + 1
    return out


def _vocabulary(guides: Guides):
    """Training words of each slice by group, with their counts; the end token rides along as the empty word."""
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("word", pa.binary()), ("c", pa.int64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows in slices(batches):
            train = in_training(rows.column(0))
            w = words(rows.column(1), lower=True)
            hashes = w.hashes()
            prior, prior_end = guides.before(w, hashes)
            used = np.repeat(train, w.counts)
            start, end, group = w.start[used], w.end[used], guides.of(prior[used])
            _, first, place = numbered(mix(hashes[used]) + group.astype(np.uint64))
            count = np.bincount(place, minlength=len(first))
            data = w.buf.tobytes()
            own = [data[a:b] for a, b in zip(start[first].tolist(), end[first].tolist(), strict=True)]
            ends, times = np.unique(guides.of(prior_end[train]), return_counts=True)
            yield batch(schema, np.concatenate([hashes[used][first], np.zeros(len(ends), np.uint64)]).view(np.int64),
                        np.concatenate([group[first], ends]), own + [END_WORD] * len(ends), np.concatenate([count, times]))

    return run


def gathered(batches: Iterator[pa.RecordBatch], limit: int = 4 << 20) -> Iterator[pa.Table]:
    """Rows of several batches at a time: ``ALIKE`` or more, or ``limit`` bytes."""
    held: list[pa.RecordBatch] = []
    for rows in batches:
        if rows.num_rows:
            held.append(rows)
        if sum(b.num_rows for b in held) >= ALIKE or sum(b.nbytes for b in held) >= limit:
            yield pa.Table.from_batches(held)
            held = []
    if held:
        yield pa.Table.from_batches(held)


@tidy
def _tables(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Counts of a task, in blocks of slots, so that blocks are summed in parallel."""
    schema = pa.schema([("block", pa.int32()), ("wide", pa.int32()), ("counts", pa.binary())])
    into = None
    for rows in gathered(batches):
        into = np.zeros((PREDICTORS, 1 << SLOTS, 2)) if into is None else into
        count_bits(rows.column(0).to_pylist(), rows.column(1).to_numpy(), rows.column(2).to_numpy(), into)
    if into is not None:
        for block, counts in enumerate(into.reshape(PREDICTORS * BLOCKS, -1)):
            if counts.any():
                exact = counts if counts.max() >= 1 << 24 else counts.astype(np.float32)
                yield batch(schema, [block], [exact.itemsize], [pa.compress(exact.tobytes(), codec="zstd", asbytes=True)])


@tidy
def _sum_blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    total, block = np.zeros((2 << SLOTS) // BLOCKS), None
    for rows in batches:
        block = rows.column(0).slice(0, 1)
        for wide, blob in zip(rows.column(1).to_pylist(), rows.column(2), strict=True):
            data = pa.decompress(blob.as_buffer(), wide * len(total), codec="zstd")
            total += np.frombuffer(data, dtype=f"f{wide}")
    packed = pa.compress(total.astype(np.float32).tobytes(), codec="zstd", asbytes=True)
    yield pa.RecordBatch.from_arrays([block, pa.array([packed], pa.binary())], names=["block", "counts"])


def _learn(shared, rate: float):
    schema = pa.schema([("at", pa.int32()), ("value", pa.float64()), ("bits", pa.float64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, total, step = None, 0.0, 0
        for rows in batches:
            for at in range(0, rows.num_rows, 1024):
                part = rows.slice(at, 1024)
                if model is None:
                    model = Model(None, None).leave_out(map(shared.value.table, range(PREDICTORS)))
                total += model.learn(part.column(0).to_pylist(), part.column(1).to_numpy(), part.column(2).to_numpy(),
                                     rate / (1 + step / 100) ** 0.5)
                step += 1
        if total:
            flat = np.concatenate([model.weights.ravel(), model.refine.ravel()])
            yield batch(schema, np.arange(len(flat)), flat * total, np.full(len(flat), total))

    return run


def _score_words(shared, learned: dict):
    schema = pa.schema([("h", pa.int64()), ("g", pa.int32()), ("lp", pa.float64())])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model = None
        for rows in batches:
            model = model or shared.value.model(learned)
            for at in range(0, rows.num_rows, ALIKE):
                part = rows.slice(at, ALIKE)
                yield batch(schema, part.column(0), part.column(1), model.log10(part.column(2).to_pylist(), part.column(1).to_numpy()))

    return run


class Fitted:
    """What scoring needs: totals, guides, arrays of the model, phrases, frequent words, and the table of all counts."""

    def __init__(self, total: int, distinct: int, guides: Guides, shared, learned: dict, spoken: phrases.Phrases, known: tuple,
                 scored: tuple, counts: DataFrame):
        self.total, self.distinct, self.guides, self.spoken = total, distinct, guides, spoken
        self.shared, self.learned = shared, learned
        self.known, self.scored, self.counts = known, scored, counts


def choose_guides(texts: DataFrame, look: DataFrame, guides: int = GUIDES, groups: int = GROUPS) -> Guides:
    """The most frequent words of the training documents, grouped by their succession."""
    heavy = look.filter("ctx IS NULL").groupBy("h").agg(F.sum("c").alias("c"))
    top = np.array([r["h"] for r in heavy.orderBy(F.desc("c"), "h").limit(guides).collect()], dtype=np.int64).view(np.uint64)
    chosen = Guides(top, np.ones(len(top), dtype=np.int64))
    follow = np.zeros((len(top), len(top)))
    found = texts.mapInArrow(_successors(chosen), "a int, b int, c long").groupBy("a", "b").agg(F.sum("c").alias("c"))
    for r in found.collect():  # guides squared
        follow[r["a"], r["b"]] = r["c"]
    chosen.groups = group_guides(follow, groups)
    return chosen


def most_frequent(counts: DataFrame, most: int) -> DataFrame:
    """The rows of ``counts(…, c)`` of highest count, at most ``most``: a bound on c from a histogram of its logarithm, so no
    task ever sorts or gathers them."""
    level = F.floor(F.log2(F.col("c").cast("double")) * 16).cast("int")
    bins = sorted(((r["level"], r["n"]) for r in counts.groupBy(level.alias("level")).agg(F.count("*").alias("n")).collect()), reverse=True)
    upto, lowest = 0, 1 << 20
    for at, n in bins:  # at most 16 a doubling
        upto += n
        if upto > most:
            break
        lowest = at
    return counts.filter(level >= lowest)


def fit(docs: DataFrame, rate: float = 0.3, frequent: int = FREQUENT) -> Fitted:
    """Learn from the training documents of ``docs(doc_id, text)``."""
    sc = docs.sparkSession.sparkContext
    texts = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"))
    look = stored(texts.mapInArrow(_first_look, "ctx long, h long, c long"), "first-look")
    guides = choose_guides(texts, look)
    seen = texts.mapInArrow(_vocabulary(guides), "h long, g int, word binary, c long")
    # the word is a key although its hash says as much: as a value it would have all rows sorted
    vocabulary = stored(seen.groupBy("h", "g", "word").agg(F.sum("c").alias("c")), "vocabulary")
    counts = stored(vocabulary.groupBy("h").agg(F.sum("c").alias("c")), "counts")
    total = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    rows = vocabulary.select("word", "g", "c")
    # a task has one set of tables: as many tasks as there are millions of rows
    tasks = max(1, -(-vocabulary.count() // ROWS_PER_TABLE))
    # the blocks stay dealt over tasks however small they are: the driver takes one task's at a time, packed
    blocks = rows.coalesce(tasks).mapInArrow(_tables, "block int, wide int, counts binary").repartition(BLOCKS, "block").groupBy(
        "block").applyInArrow(_sum_blocks, "block int, counts binary")
    learned: dict = {}
    shared = sc.broadcast(Packed({r["block"]: bytes(r["counts"]) for r in blocks.toLocalIterator()}))  # fixed size
    means = rows.mapInArrow(_learn(shared, rate), "at int, value double, bits double").groupBy("at").agg(
        (F.sum("value") / F.sum("bits")).alias("mean")).collect()  # one number a weight
    if means:
        flat = np.zeros(GATES * (PREDICTORS + 1 + MAP))
        flat[[r["at"] for r in means]] = [r["mean"] for r in means]
        learned["weights"] = flat[:GATES * (PREDICTORS + 1)].reshape(GATES, -1)
        learned["refine"] = flat[GATES * (PREDICTORS + 1):].reshape(GATES, -1)
    known = most_frequent(counts, frequent).toArrow()  # at most ``frequent`` rows of 16 bytes
    scored = most_frequent(vocabulary, frequent).select("h", "g", "word").mapInArrow(
        _score_words(shared, learned), "h long, g int, lp double").toArrow()  # at most ``frequent`` rows of 20 bytes
    h = known["h"].to_numpy().view(np.uint64)
    order = np.argsort(h)
    key = mix(scored["h"].to_numpy().view(np.uint64)) + scored["g"].to_numpy().astype(np.uint64)
    by_key = np.argsort(key)
    spoken = phrases.fit(look.filter("ctx IS NOT NULL").withColumnRenamed("h", "key"), most_frequent, frequent=min(frequent, phrases.FREQUENT))
    return Fitted(int(total[0]), int(total[1]), guides, shared, learned, spoken, (h[order], known["c"].to_numpy()[order]),
                  (key[by_key], scored["lp"].to_numpy()[by_key]), counts)


def _find(keys: np.ndarray, wanted: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, found) of each wanted key in sorted keys."""
    if not len(keys):
        return np.zeros(len(wanted), dtype=np.int64), np.zeros(len(wanted), dtype=bool)
    at = np.minimum(np.searchsorted(keys, wanted), len(keys) - 1)
    return at, keys[at] == wanted


def _read(shared, learned: dict, frequent, guides: Guides, total: int, distinct: int):
    item = pa.struct([("h", pa.int64()), ("n", pa.int64())])
    phrase = pa.struct([("ctx", pa.int64()), ("key", pa.int64()), ("words", pa.float64()), ("miss", pa.float64())])
    schema = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()),
                        ("base_score", pa.float64()), ("score", pa.float64()), ("rare", pa.list_(item)), ("open", pa.list_(phrase))])

    @tidy
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        model, remembered = shared.value.model(learned), {}
        (keys, count), (pairs, lp), (phrase_keys, phrase_lp, phrase_own, once), (contexts, miss) = frequent.value
        base = np.log10((count + 1.0) / (total + distinct + 1.0))
        end_at, has_end = _find(keys, np.zeros(1, dtype=np.uint64))
        end_base = float(base[end_at[0]]) if has_end[0] else -np.log10(total + distinct + 1.0)
        end_lp = model.log10([END_WORD] * (GROUPS + 1), np.arange(GROUPS + 1))
        for rows in slices(batches, limit=SLICE):
            w = words(rows.column(1), lower=True)
            n, train = len(w.first) - 1, in_training(rows.column(0))
            hashes = w.hashes()
            prior, prior_end = guides.before(w, hashes)
            uniq, _, where = numbered(hashes)
            at, common = _find(keys, uniq)
            own_base = np.where(common, base[at] if len(keys) else 0.0, 0.0)
            base_score = per_doc(own_base[where], w.first) + end_base
            n_known = per_doc(common[where], w.first) + int(has_end[0])
            # the model, by word and group
            group = guides.of(prior)
            both, first, place = numbered(mix(hashes) + group.astype(np.uint64))
            at, have = _find(pairs, both)
            own_lp = np.where(have, lp[at] if len(pairs) else 0.0, 0.0)
            if len(remembered) > REMEMBERED:
                remembered.clear()
            rare = np.flatnonzero(~have)
            new = [i for i, k in zip(rare.tolist(), both[rare].tolist(), strict=True) if k not in remembered]
            data = w.buf.tobytes()
            for a in range(0, len(new), ALIKE):
                part = new[a:a + ALIKE]
                got = model.log10([data[w.start[first[i]]:w.end[first[i]]] for i in part], group[first[part]])
                remembered.update(zip(both[part].tolist(), got.tolist(), strict=True))
            own_lp[rare] = [remembered[k] for k in both[rare].tolist()]
            each, closing = own_lp[place], end_lp[guides.of(prior_end)]
            score = per_doc(each, w.first) + closing
            # phrases take the place of their words' prices: frequent ones here, the others by a join
            cut = phrases.Cut(w, hashes)
            sums = np.concatenate([[0.0], np.cumsum(each)])
            spelled = sums[cut.end] - sums[cut.begin] + np.where(cut.closes, closing[cut.doc], 0.0)
            score -= np.bincount(cut.doc, spelled, n)
            at, common_phrase = _find(phrase_keys, cut.key)
            if len(phrase_keys):
                price = np.where(train[cut.doc], phrase_own[at] + np.where(once[at], spelled, 0.0), phrase_lp[at])
                score += np.bincount(cut.doc, np.where(common_phrase, price, 0.0), n)
            todo = np.flatnonzero(~common_phrase)
            at, left = _find(contexts, cut.context[todo])
            leaving = pa.array(miss[at] if len(contexts) else np.zeros(len(todo)), mask=~left)
            opened = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(cut.doc[todo], np.arange(n + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(cut.context[todo].view(np.int64)), pa.array(cut.key[todo].view(np.int64)),
                                            pa.array(spelled[todo]), leaving], fields=list(phrase)))
            # occurrences of rarer words, counted per document; their counts come by a join
            odd = ~common[where]
            key = w.doc[odd] * len(uniq) + where[odd]
            pair, times = np.unique(key, return_counts=True)
            owner = pair // max(1, len(uniq))
            lists = pa.ListArray.from_arrays(
                pa.array(np.searchsorted(owner, np.arange(n + 1)).astype(np.int32)),
                pa.StructArray.from_arrays([pa.array(uniq[pair % max(1, len(uniq))].view(np.int64)), pa.array(times.astype(np.int64))],
                                           fields=list(item)))
            yield pa.RecordBatch.from_arrays(
                [rows.column(0), pa.array(~train), pa.array(w.counts + 1), pa.array(n_known),
                 pa.array(base_score), pa.array(score), lists.cast(schema.field("rare").type), opened.cast(schema.field("open").type)], schema=schema)

    return run


def score(docs: DataFrame, model: Fitted) -> DataFrame:
    """(doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score) of every row of ``docs(doc_id, text)``."""
    frequent = docs.sparkSession.sparkContext.broadcast(
        (model.known, model.scored, model.spoken.frequent, model.spoken.leaving))  # at most FREQUENT rows each
    read = stored(docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _read(model.shared, model.learned, frequent, model.guides, model.total, model.distinct),
        "doc_id long, held_out boolean, n_tokens long, n_known long, base_score double, score double, "
        "rare array<struct<h:bigint,n:bigint>>, open array<struct<ctx:bigint,key:bigint,words:double,miss:double>>").withColumn("row", F.monotonically_increasing_id()), "scored")
    # the scores are a written table: the executors need these no longer
    frequent.unpersist()
    model.shared.unpersist()
    rare = read.select("row", F.explode("rare").alias("r")).select("row", "r.h", "r.n")
    c = F.coalesce("c", F.lit(0))
    added = rare.join(model.counts, "h", "left").groupBy("row").agg(
        F.sum(F.col("n") * (F.log10(c + 1.0) - F.log10(F.lit(model.total + model.distinct + 1.0)))).alias("more"),
        F.sum(F.when(c > 0, F.col("n")).otherwise(0)).alias("known"))
    said = phrases.settled(read.select("row", "held_out", F.explode("open").alias("o")).select("row", "held_out", "o.*"), model.spoken)
    return read.drop("rare", "open").join(added, "row", "left").join(said, "row", "left").select(
        "doc_id", "held_out", "n_tokens", (F.col("n_known") + F.coalesce("known", F.lit(0))).alias("n_known"),
        F.lit(model.total).cast("long").alias("train_tokens"),
        (F.col("base_score") + F.coalesce("more", F.lit(0.0))).alias("base_score"),
        (F.col("score") + F.coalesce("price", F.lit(0.0))).alias("score"))
