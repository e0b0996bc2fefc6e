"""Token counts by rank-synchronous array merging, and the reading of public vocabulary files.

A vocabulary of byte-pair merges is read from a tokenizer file (its path is a parameter). Texts are normalised and cut
into pre-tokens; the distinct ones of a slice become rows of ragged arrays of symbol ids. In each step every pre-token
finds its adjacent pair of lowest rank and all pre-tokens merge theirs at the same time; the ones without a known pair
leave with their number of symbols. Since a rank belongs to one pair, a step merges the occurrences of that pair
from left to right, as the library does.

White space separates pre-tokens, so each distinct white-space word is counted once per slice and remembered per worker
up to a bounded number of words. Long pre-tokens go to a heap that merges one pair at a time, in n log n.

Defined cases: null and empty texts have 0 tokens. Rows without ``doc_id`` are counted like others.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docskein.llm.base import batch
from docskein.llm.words import per_doc, slices, words

LONG = 256  # symbols; longer pre-tokens are merged by the heap
REMEMBERED = 400_000  # words a worker keeps before it starts anew


class Merges:
    """Merge table of a word-end BPE vocabulary, as arrays."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab: dict[str, int] = model["vocab"]
        end = model.get("end_of_word_suffix") or ""
        self.specials = [t["content"] for t in spec["added_tokens"]]
        parts = [s for s in spec["pre_tokenizer"]["pretokenizers"] if s["type"] == "Split"]
        self.pattern = regex.compile(parts[0]["pattern"]["Regex"])
        self.special_pattern = regex.compile("|".join(map(regex.escape, sorted(self.specials, key=len, reverse=True)))) \
            if self.specials else None
        kinds = [n["type"] for n in spec["normalizer"]["normalizers"]]
        self.lower, self.nfc = "Lowercase" in kinds, "NFC" in kinds
        letters = byte_letters()
        self.inner = np.array([vocab[letters[b]] for b in range(256)], dtype=np.int64)
        self.final = np.array([vocab[letters[b] + end] for b in range(256)], dtype=np.int64)
        merges = [tuple(m) if isinstance(m, list) else tuple(m.split(" ", 1)) for m in model["merges"]]
        left = np.array([vocab[a] for a, _ in merges], dtype=np.int64)
        right = np.array([vocab[b] for _, b in merges], dtype=np.int64)
        made = np.array([vocab[a + b] for a, b in merges], dtype=np.int64)
        key = left << 20 | right
        order = np.argsort(key, kind="stable")
        key, rank, made = key[order], order.astype(np.int64), made[order]
        last = np.append(key[1:] != key[:-1], True)  # a pair listed twice has its later rank
        self.pairs = {int(k): (int(r), int(m)) for k, r, m in zip(key[last], rank[last], made[last], strict=True)}
        self._slots(key[last], rank[last], made[last])
        self.counts: dict[int, int] = {}

    def _slots(self, key: np.ndarray, rank: np.ndarray, made: np.ndarray) -> None:
        """Open addressing: a look-up is one or a few gathers."""
        self.shift = 64 - 18
        self.key = np.full(1 << 18, -1, dtype=np.int64)
        self.rank = np.zeros(1 << 18, dtype=np.int64)
        self.made = np.zeros(1 << 18, dtype=np.int64)
        self.probes = 1
        slot = self._slot(key)
        for k, r, m, s in zip(key.tolist(), rank.tolist(), made.tolist(), slot.tolist(), strict=True):
            n = 1
            while self.key[s] >= 0:
                s, n = (s + 1) & (1 << 18) - 1, n + 1
            self.key[s], self.rank[s], self.made[s] = k, r, m
            self.probes = max(self.probes, n)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(self.shift)).astype(np.int64)

    def look_up(self, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(rank, merged symbol) of each pair; rank 2**40 where the pair never merges."""
        key = left << 20 | right
        slot = self._slot(key)
        found = self.key[slot] == key
        rank = np.where(found, self.rank[slot], 1 << 40)
        made = self.made[slot]
        open_ = np.flatnonzero(~found & (self.key[slot] >= 0))
        for _ in range(1, self.probes):
            if not len(open_):
                break
            slot[open_] = (slot[open_] + 1) & (1 << 18) - 1
            hit = self.key[slot[open_]] == key[open_]
            at = open_[hit]
            rank[at], made[at] = self.rank[slot[at]], self.made[slot[at]]
            open_ = open_[~hit & (self.key[slot[open_]] >= 0)]
        return rank, made


def byte_letters() -> list[str]:
    """The printable stand-in of each byte in byte-level vocabularies: itself where printable, else from U+0100 on."""
    printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
    rest = iter(range(256, 512))
    return [chr(b) if b in printable else chr(next(rest)) for b in range(256)]


def merge_counts(symbols: np.ndarray, sizes: np.ndarray, merges: Merges) -> np.ndarray:
    """Symbols that survive in each row of the ragged array, after all merges."""
    out = sizes.astype(np.int64).copy()
    row = np.repeat(np.arange(len(sizes)), sizes)
    while len(symbols) > 1:
        joint = row[1:] == row[:-1]
        rank = np.full(len(symbols) - 1, 1 << 40, dtype=np.int64)
        made = np.zeros(len(symbols) - 1, dtype=np.int64)
        at = np.flatnonzero(joint)
        rank[at], made[at] = merges.look_up(symbols[at], symbols[at + 1])
        # lowest rank of each row present
        head = np.flatnonzero(np.append(True, row[1:] != row[:-1]))
        low = np.minimum.reduceat(np.append(rank, 1 << 40), head)
        alive = low < 1 << 40
        if not alive.any():
            break
        each = np.repeat(np.arange(len(head)), np.diff(np.append(head, len(symbols))))
        chosen = (rank < 1 << 40) & (rank == low[each[:-1]])
        # occurrences that overlap (a a a) merge from the left, every other one
        pick = np.flatnonzero(chosen)
        run = np.append(True, pick[1:] != pick[:-1] + 1)
        begin = np.maximum.accumulate(np.where(run, np.arange(len(pick)), 0))
        pick = pick[(np.arange(len(pick)) - begin) % 2 == 0]
        symbols[pick] = made[pick]
        keep = np.ones(len(symbols), dtype=bool)
        keep[pick + 1] = False
        np.subtract.at(out, row[pick], 1)
        # rows without a pair are done
        keep &= alive[each]
        symbols, row = symbols[keep], row[keep]
    return out


def heap_count(symbols: list[int], pairs: dict[int, tuple[int, int]]) -> int:
    """The same for one long pre-token: repeatedly the leftmost pair of lowest rank."""
    n = len(symbols)
    after, before, alive = list(range(1, n + 1)), list(range(-1, n - 1)), [True] * n
    heap = []

    def offer(i: int) -> None:
        j = after[i]
        if j < n and (hit := pairs.get(symbols[i] << 20 | symbols[j])):
            heapq.heappush(heap, (hit[0], i, symbols[i], symbols[j], hit[1]))

    for i in range(n - 1):
        offer(i)
    left = n
    while heap:
        _, i, a, b, made = heapq.heappop(heap)
        if not alive[i] or symbols[i] != a or after[i] >= n or symbols[after[i]] != b:
            continue
        j = after[i]
        symbols[i], alive[j] = made, False
        after[i] = after[j]
        if after[i] < n:
            before[after[i]] = i
        left -= 1
        if before[i] >= 0:
            offer(before[i])
        offer(i)
    return left


def word_counts(texts: list[str], merges: Merges) -> np.ndarray:
    """Tokens of each text."""
    out = np.zeros(len(texts), dtype=np.int64)
    pieces: list[bytes] = []
    owner: list[int] = []
    find = merges.pattern.findall
    for k, text in enumerate(texts):
        parts = [text]
        if merges.special_pattern is not None and merges.special_pattern.search(text):
            parts = merges.special_pattern.split(text)
            out[k] += len(parts) - 1
        for part in parts:
            if merges.nfc and not part.isascii():
                part = unicodedata.normalize("NFC", part)
            if merges.lower:  # letter by letter: no final form of sigma
                part = part.replace("Σ", "σ").lower()
            for token in find(part):
                data = token.encode()
                if len(data) > LONG:
                    symbols = merges.inner[list(data)].tolist()
                    symbols[-1] = int(merges.final[data[-1]])
                    out[k] += heap_count(symbols, merges.pairs)
                else:
                    pieces.append(data)
                    owner.append(k)
    if pieces:
        sizes = np.fromiter(map(len, pieces), dtype=np.int64, count=len(pieces))
        data = np.frombuffer(b"".join(pieces), dtype=np.uint8)
        symbols = merges.inner[data]
        ends = np.cumsum(sizes) - 1
        symbols[ends] = merges.final[data[ends]]
        np.add.at(out, np.array(owner), merge_counts(symbols, sizes, merges))
    return out


_loaded: dict[str, Merges] = {}


def load_merges(path: str) -> Merges:
    if path not in _loaded:
        _loaded[path] = Merges(path)
    return _loaded[path]


def _count(path: str):
    schema = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        merges = load_merges(path)
        for rows in slices(batches):
            w = words(rows.column(1))
            hashes, first, where = np.unique(w.hashes(), return_index=True, return_inverse=True)
            if len(merges.counts) > REMEMBERED:
                merges.counts.clear()
            known = merges.counts
            keys = hashes.tolist()
            new = [i for i, h in enumerate(keys) if h not in known]
            data = w.buf.tobytes()
            at, to = w.start[first[new]].tolist(), w.end[first[new]].tolist()
            fresh = word_counts([data[a:b].decode() for a, b in zip(at, to, strict=True)], merges)
            known.update(zip([keys[i] for i in new], fresh.tolist(), strict=True))
            each = np.fromiter((known[h] for h in keys), dtype=np.int64, count=len(keys))
            yield batch(schema, rows.column(0), np.diff(w.offsets), per_doc(each[where], w.first))

    return run


def token_counts(docs: DataFrame, vocabulary: str) -> DataFrame:
    """(doc_id, n_bytes, n_tokens) of every row of ``docs(doc_id, text)``; ``vocabulary`` is a path on every worker."""
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(
        _count(vocabulary), "doc_id long, n_bytes long, n_tokens long")
