"""Token pieces packed into fixed-size sequences by swap-based local search.

``pieces`` tokenizes whole texts: a text is cut where one space stands between other characters, which is always a
border of the tokenizer's own pre-tokens, and each distinct part is encoded once per slice and remembered per worker.
The encoder reads the ranks from the tokenizer's JSON file. A document with its end id stays whole up to ``size``
tokens; a longer one becomes pieces of ``size`` tokens after a shorter first one, so that only full pieces follow.

``pack`` deals the pieces evenly to groups, by row and not by key, so repeated rows spread. In a group full pieces are
sequences of their own; the rest starts from best fit in falling order and then improves: the emptiest sequence gives
its pieces away by moves, exchanges of one for one, and exchanges of two for one or one for two, each of which makes a
fuller sequence fuller (the sum of squared fills grows), until it is empty. The search ends at the lower bound
ceil(tokens / size) or when a sweep over all underfull sequences empties none. A group loses a sequence or two against
one packing of everything, out of the thousands it holds.

Defined cases: a null text is empty and has the end id alone. Special strings inside texts are encoded as the library
does by default. Ids that are null or repeat are packed like others. An empty table gives no sequence.
"""

from __future__ import annotations

import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import tiktoken
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.bpe import byte_letters
from docskein.llm.words import slices, span_hashes, text_bytes
from docskein.session import stored

REMEMBERED = 200_000  # parts a worker keeps before it starts anew
GROUP = 32_768  # pieces packed together
PATTERN = (r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")  # fixed value of byte-level BPE


class Encoder:
    """Byte-level BPE of a tokenizer file whose ids rise with the rank of their merge."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, specials = spec["model"]["vocab"], {t["content"]: t["id"] for t in spec["added_tokens"]}
        merges = [m if isinstance(m, list) else m.split(" ", 1) for m in spec["model"]["merges"]]
        made = [vocab[a + b] for a, b in merges]
        if spec.get("normalizer") or spec["pre_tokenizer"]["type"] != "ByteLevel" or made != sorted(made):
            raise ValueError(f"{path} is not a plain byte-level BPE with ids in merge order")
        byte = {c: b for b, c in enumerate(byte_letters())}
        ranks = {bytes(byte[c] for c in token): i for token, i in vocab.items() if token not in specials}
        self.inner = tiktoken.Encoding(path, pat_str=PATTERN, mergeable_ranks=ranks, special_tokens=specials)
        self.parts: dict[int, bytes] = {}

    def ids(self, text: str) -> bytes:
        return np.array(self.inner.encode(text, allowed_special="all"), dtype="<u4").tobytes()


_encoders: dict[str, Encoder] = {}


def encoder(path: str) -> Encoder:
    if path not in _encoders:
        _encoders[path] = Encoder(path)
    return _encoders[path]


_BLANK = np.zeros(256, dtype=bool)
_BLANK[[32, 9, 10, 11, 12, 13]] = True
_WIDE_LEAD = np.zeros(256, dtype=bool)
_WIDE_LEAD[[0xC2, 0xE1, 0xE2, 0xE3]] = True  # first bytes of white space beyond ASCII
_WIDE_MID = np.zeros(256, dtype=bool)
_WIDE_MID[[0xC2, 0x80, 0x81, 0x9A]] = True  # the byte before its last one


def part_starts(buf: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Where parts begin: texts, and single spaces between characters that are surely not white space."""
    n = len(buf)
    cut = np.zeros(n, dtype=bool)
    if n > 3:
        at = np.flatnonzero(buf[2:-1] == 32) + 2
        before, two, after = buf[at - 1], buf[at - 2], buf[at + 1]
        ok = ~_BLANK[before] & ~_BLANK[after] & ~_WIDE_LEAD[after] & ~((before >= 0x80) & _WIDE_MID[two])
        at = at[ok]
        # a space next to the border of a text is no cut
        cut[at] = True
        inner = offsets[1:-1]
        for shift in (-1, 0, 1):
            near = inner + shift
            cut[near[(near >= 0) & (near < n)]] = False
    begin = offsets[:-1][np.diff(offsets) > 0]
    cut[begin] = True
    return np.flatnonzero(cut)


def _token_arrays(texts: pa.Array, enc: Encoder, end_id: int) -> tuple[np.ndarray, np.ndarray]:
    """(ids of all documents in a row, first id of each document), end ids included."""
    buf, offsets = text_bytes(texts)
    start = part_starts(buf, offsets)
    end = np.append(start[1:], len(buf))
    hashes, first, where = np.unique(span_hashes(buf, start, end), return_index=True, return_inverse=True)
    if len(enc.parts) > REMEMBERED:
        enc.parts.clear()
    keys, known, data = hashes.tolist(), enc.parts, buf.tobytes()
    for h, a, b in zip(keys, start[first].tolist(), end[first].tolist(), strict=True):
        if h not in known:
            known[h] = enc.ids(data[a:b].decode())
    blobs = [known[h] for h in keys]
    size = np.fromiter(map(len, blobs), dtype=np.int64, count=len(blobs)) // 4
    flat = np.frombuffer(b"".join(blobs), dtype="<u4")
    begin = np.cumsum(size) - size
    size_of = size[where]
    parts = np.searchsorted(start, offsets)  # parts before each text
    upto = np.concatenate([[0], np.cumsum(size_of)])
    tokens = upto[parts]
    ids = flat[np.repeat(begin[where] - upto[:-1], size_of) + np.arange(upto[-1])]
    n = len(offsets) - 1
    out = np.full(len(ids) + n, end_id, dtype="<u4")
    out[np.arange(len(ids)) + np.repeat(np.arange(n), np.diff(tokens))] = ids
    return out, tokens + np.arange(n + 1)


def _cut(path: str, size: int, end_id: int):
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()),
                        ("ids_crc32", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = encoder(path)
        for rows in slices(batches):
            ids, first = _token_arrays(rows.column(1), enc, end_id)
            total = np.diff(first)
            head = np.where(total % size > 0, total % size, np.minimum(total, size))
            count = (total - head) // size + 1
            doc = np.repeat(np.arange(len(total)), count)
            piece = np.arange(len(doc)) - np.repeat(np.cumsum(count) - count, count)
            start = np.where(piece == 0, 0, head[doc] + (piece - 1) * size)
            length = np.where(piece == 0, head[doc], size)
            view = memoryview(ids).cast("B")
            crc = np.fromiter((zlib.crc32(view[a * 4:b * 4]) for a, b in
                               zip((first[doc] + start).tolist(), (first[doc] + start + length).tolist(), strict=True)),
                              dtype=np.int64, count=len(doc))
            yield batch(schema, rows.column(0).take(pa.array(doc)), piece, start, length, crc)

    return run


def pieces(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32): the pieces of every row of ``docs(doc_id, text)``."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _cut(vocabulary, size, end_id), "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(length: np.ndarray, size: int) -> np.ndarray:
    """Bin of each item: longest first, each into the bin that it leaves fullest."""
    out = np.empty(len(length), dtype=np.int64)
    by_room: list[list[int]] = [[] for _ in range(size + 1)]
    levels = bins = 0  # levels: bit r is set when some bin has room r
    lengths = length.tolist()
    for i in np.argsort(-length, kind="stable").tolist():
        n = lengths[i]
        above = levels >> n
        if above:
            room = n + (above & -above).bit_length() - 1
            b = by_room[room].pop()
            if not by_room[room]:
                levels ^= 1 << room
        else:
            room, b, bins = size, bins, bins + 1
        out[i] = b
        if room - n:
            by_room[room - n].append(b)
            levels |= 1 << (room - n)
    return out


def improve(length: np.ndarray, bins: np.ndarray, size: int) -> np.ndarray:
    """Local search over the underfull bins; returns bins of which some may be empty."""
    bins = bins.copy()
    fill = np.bincount(bins, weights=length).astype(np.int64)
    least = -(-int(length.sum()) // size)
    freed = True
    while freed and (fill > 0).sum() > least:
        freed = False
        open_bins = np.flatnonzero((fill < size) & (fill > 0))
        items = np.flatnonzero(np.isin(bins, open_bins))
        items = items[np.lexsort((length[items], bins[items]))]
        own, size_of = bins[items].copy(), length[items]
        for source in open_bins[np.argsort(fill[open_bins], kind="stable")].tolist():
            if (fill > 0).sum() <= least:
                break
            while True:
                mine = np.flatnonzero(own == source)
                if not len(mine) or fill[source] == size:
                    break
                room = np.where(own == source, -1, size - fill[own])
                if not _step(mine, own, size_of, fill, room, source):
                    break
            freed |= bool(fill[source] == 0)
        bins[items] = own
    return bins


def _step(mine, own, size_of, fill, room, source) -> bool:
    """One move or exchange out of ``source`` into a bin at least as full; False when there is none."""

    def shift(items, target) -> None:
        for i in items:
            fill[own[i]] -= size_of[i]
            own[i] = target
            fill[target] += size_of[i]

    fuller = fill[own] >= fill[source]
    give = mine[np.argsort(-size_of[mine], kind="stable")].tolist()
    for i in give:  # move, to the tightest room
        fits = np.flatnonzero((room >= size_of[i]) & fuller)
        if len(fits):
            shift([i], own[fits[np.argmin(room[fits])]])
            return True
    best, choice = 0, None
    pair = np.flatnonzero(own[1:] == own[:-1])
    pair_size = size_of[pair] + size_of[pair + 1]
    twos = [(a, b) for k, a in enumerate(give[:6]) for b in give[k + 1:6]]
    for out in [(i,) for i in give] + twos:
        n = int(sum(size_of[i] for i in out))
        gain = n - size_of
        ok = np.flatnonzero((gain > best) & (gain <= room) & fuller)
        if len(ok):
            at = ok[np.argmax(gain[ok])]
            best, choice = int(gain[at]), (out, (int(at),))
        if len(out) == 1 and len(pair):
            gain = n - pair_size
            ok = np.flatnonzero((gain > best) & (gain <= room[pair]) & fuller[pair])
            if len(ok):
                at = ok[np.argmax(gain[ok])]
                best, choice = int(gain[at]), (out, (int(pair[at]), int(pair[at]) + 1))
    if choice is None:
        return False
    out, back = choice
    target = own[back[0]]
    shift(out, target)
    shift(back, source)
    return True


def pack_group(length: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """(bin, offset) of each piece of a group; bins are numbered from 0 without gaps."""
    bins = np.empty(len(length), dtype=np.int64)
    rest = np.flatnonzero(length < size)
    full = np.flatnonzero(length >= size)
    found = improve(length[rest], best_fit(length[rest], size), size) if len(rest) else np.empty(0, np.int64)
    bins[rest] = np.unique(found, return_inverse=True)[1]
    bins[full] = (bins[rest].max() + 1 if len(rest) else 0) + np.arange(len(full))
    order = np.argsort(bins, kind="stable")
    upto = np.cumsum(length[order])
    head = np.append(True, bins[order][1:] != bins[order][:-1])
    before = upto - length[order]
    offset = np.empty(len(length), dtype=np.int64)
    offset[order] = before - before[np.flatnonzero(head)][np.cumsum(head) - 1] if len(order) else before
    return bins, offset


def pack(cut: DataFrame, size: int = 1024, group: int = GROUP) -> DataFrame:
    """``cut`` with sequence_id and offset; every piece has at most ``size`` tokens."""
    cut = stored(cut, "pieces")
    groups = max(1, -(-cut.count() // group))
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64(F.monotonically_increasing_id()), F.lit(groups)))

    def run(table: pa.Table) -> pa.Table:
        bins, offset = pack_group(table.column("length").to_numpy().astype(np.int64), size)
        bucket = table.column("bucket").to_numpy()
        table = table.drop_columns(["bucket"])
        return table.append_column("sequence_id", pa.array((bucket << 32) + bins)).append_column("offset", pa.array(offset))

    fields = ", ".join(f"`{n}` {t}" for n, t in cut.dtypes)
    return dealt.groupBy("bucket").applyInArrow(run, f"{fields}, sequence_id long, `offset` long")


def packed_documents(docs: DataFrame, vocabulary: str, size: int = 1024, end_id: int = 2, group: int = GROUP) -> DataFrame:
    """Pieces of all documents with their places in sequences of at most ``size`` tokens."""
    return pack(pieces(docs, vocabulary, size, end_id), size, group)
