"""Best-two-fit packing of token sequences.

Documents are tokenised once, word by word with a cache, and cut into pieces. How full a bin gets depends on
lengths alone, so bins are planned on the number of pieces of each length, of which there are at most as many
as the capacity: fill greedily with the longest that fits, then replace the smallest by two unpacked pieces
that fill the widened gap better. A plan line stands for as many equal bins as the counts allow. Pieces find
their place by their rank within their length.

Defined results: null and blank texts are the end token alone; repeated rows are packed each; pieces of one
length and id are placed in any order; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator, Mapping
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .blocks import Block, blocks, span_hashes
from .common import ranked, stored
from .token_counts import tokenizer

CACHE_ROWS, ENCODE_ROWS = 1 << 20, 1 << 14
_RANKS = 1 << 48


_LETTER = np.zeros(256, dtype=bool)
_LETTER[list(range(65, 91)) + list(range(97, 123))] = True
_STOP = np.zeros(256, dtype=bool)
_STOP[list(b".,;:!?")] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32


class WordIds:
    """Token ids of texts, word by word, of a tokenizer that folds case and drops blanks.

    It never joins characters across a blank, nor a letter and a stop after it; both cut the texts, so that
    few different words are left to encode. Case is folded before the look-up, but for words that may hold a
    special token.
    """

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat, self.begins, self.sizes = np.zeros(0, np.uint32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, words: list[str]) -> None:
        for i in range(0, len(words), ENCODE_ROWS):
            part = words[i : i + ENCODE_ROWS]
            found = tokenizer(self.path).encode(part, is_pretokenized=True, add_special_tokens=False)
            sizes = np.bincount(np.array(found.word_ids, np.int64), minlength=len(part)) if len(found.ids) else np.zeros(len(part), np.int64)
            self.add(np.array(found.ids, np.uint32), sizes)

    def add(self, ids: np.ndarray, sizes: np.ndarray) -> None:
        self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
        self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, ids))

    def of(self, block: Block) -> tuple[np.ndarray, np.ndarray]:
        """All ids in order, and where each document's begin, with the end of the last."""
        data = block.data
        marked = data == ord("<")
        folded = _LOWER[data]
        if marked.any():
            for i in np.unique(np.searchsorted(block.starts, np.flatnonzero(marked), side="right") - 1).tolist():
                folded[block.starts[i] : block.ends[i]] = data[block.starts[i] : block.ends[i]]
        stops = np.flatnonzero(_LETTER[data[:-1]] & _STOP[data[1:]]) + 1
        stops = stops[~np.isin(stops, block.offsets)]  # a text's last letter and the next text's stop
        starts, ends = np.sort(np.concatenate((block.starts, stops))), np.sort(np.concatenate((block.ends, stops)))
        _, first, back = np.unique(span_hashes(folded, starts, ends), return_index=True, return_inverse=True)
        raw = folded.tobytes()
        keys = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slots = np.fromiter((self.slots.get(w, -1) for w in keys), np.int64, len(keys))
        if len(self.slots) + int((slots < 0).sum()) > CACHE_ROWS:
            self.forget()
            slots[:] = -1
        special = []
        new = np.flatnonzero(slots < 0)
        if len(new):
            texts = [keys[i].decode() for i in new.tolist()]
            special = [i for i, x in enumerate(texts) if "<" in x]
            plain = np.setdiff1d(np.arange(len(new)), special)
            slots[new[plain]] = len(self.sizes) + np.arange(len(plain))
            self.encode([texts[i] for i in plain.tolist()])
            for i in special:
                ids = tokenizer(self.path).encode(texts[i], add_special_tokens=False).ids
                slots[new[i]] = len(self.sizes)
                self.add(np.array(ids, np.uint32), np.array([len(ids)]))
            self.slots.update(zip((keys[i] for i in new.tolist()), slots[new].tolist(), strict=True))
        slot = slots[back]
        each = self.sizes[slot]
        ends_ = np.cumsum(each)
        at = np.repeat(self.begins[slot] - (ends_ - each), each) + np.arange(int(each.sum()))
        return self.flat[at], np.concatenate(([0], ends_))[np.searchsorted(starts, block.offsets)]


@lru_cache(maxsize=2)
def word_ids(path: str) -> WordIds:
    """One cache for all tasks of a worker."""
    return WordIds(path)


def pieces(docs: DataFrame, path: str, capacity: int, end_id: int) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32."""
    rows = docs.select("doc_id", "text")
    kind = dict(rows.dtypes)["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = word_ids(path)
        for batch in batches:
            for block in blocks(batch.column(1)):
                ids, sums = words.of(block)
                out: list[tuple[int, int, int, int, int]] = []
                for doc, (a, b) in enumerate(zip(sums[:-1], sums[1:], strict=True), block.row):
                    whole = np.append(ids[a:b], np.uint32(end_id)).astype("<u4")
                    for piece, start in enumerate(range(0, len(whole), capacity)):
                        part = whole[start : start + capacity]
                        out.append((doc, piece, start, len(part), zlib.crc32(part.tobytes())))
                doc, *rest = (np.array(x, np.int64) for x in zip(*out, strict=True))
                arrays = [batch.column(0).take(pa.array(doc)), pa.array(rest[0].astype(np.int32)), *(pa.array(x) for x in rest[1:])]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "piece", "start", "length", "ids_crc32"])

    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long")


def plan_bins(counts: Mapping[int, int], capacity: int) -> np.ndarray:
    """Lines (length, first rank, pieces per bin, first bin, offset) for the given number of pieces per length.

    A line places the pieces of its length from its first rank to the next line's. Each round uses up a
    length, down to fewer than a bin takes, so there are few rounds, and a bin has under sqrt(2 * capacity)
    lengths: the plan is bounded by the capacity, whatever the number of pieces.
    """
    left = np.zeros(capacity + 1, np.int64)
    for length, n in counts.items():
        left[length] = n
    rank = np.zeros(capacity + 1, np.int64)
    lines, bins = [], 0
    while left.any():
        free = left.copy()
        gap = capacity
        bin_: dict[int, int] = {}

        def take(length: int, n: int, bin_: dict[int, int] = bin_, free: np.ndarray = free) -> None:
            bin_[length] = bin_.get(length, 0) + n
            free[length] -= n

        live = np.flatnonzero(free)
        while gap and (at := int(np.searchsorted(live, gap, side="right"))):
            length = int(live[at - 1])
            n = min(gap // length, int(free[length]))
            take(length, n)
            gap -= n * length
            live = live[: at - 1]
        if gap:
            small = min(bin_)
            wide = gap + small
            live = np.flatnonzero(free[: wide + 1])
            if len(live):
                other = np.searchsorted(live, np.minimum(live, wide - live), side="right") - 1
                single = (other >= 0) & (live[other] == live) & (free[live] < 2)
                other = other - single
                sums = np.where(other >= 0, live + live[other], 0)
                best = int(np.argmax(sums))
                if sums[best] > small:
                    take(int(live[best]), 1)
                    take(int(live[other[best]]), 1)
                    bin_[small] -= 1
        items = sorted(((x, n) for x, n in bin_.items() if n), reverse=True)
        same = min(int(left[x]) // n for x, n in items)
        offset = 0
        for x, n in items:
            lines.append((x, int(rank[x]), n, bins, offset))
            rank[x] += n * same
            left[x] -= n * same
            offset += n * x
        bins += same
    return np.array(sorted(lines), np.int64).reshape(-1, 5)


def pack_documents(docs: DataFrame, path: str, capacity: int = 4096, end_id: int = 1) -> DataFrame:
    """One row per piece: doc_id, piece, start, length, ids_crc32, sequence_id, offset.

    The driver sees the number of pieces of each length, at most ``capacity`` rows.
    """
    found = stored(pieces(docs, path, capacity, end_id))
    counts = {r["length"]: r["count"] for r in found.groupBy("length").count().collect()}
    plan = docs.sparkSession.sparkContext.broadcast(plan_bins(counts, capacity))
    placed = ranked(found, ["length"], ["doc_id", "piece", "ids_crc32"])
    names = ["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths, ranks, each, bins, offsets = plan.value.T
        keys = lengths * _RANKS + ranks
        for batch in batches:
            length, rank = (batch.column(i).to_numpy() for i in (3, 5))
            line = np.searchsorted(keys, length * _RANKS + rank, side="right") - 1
            nth = rank - ranks[line]
            sequence, offset = bins[line] + nth // each[line], offsets[line] + nth % each[line] * length
            yield pa.RecordBatch.from_arrays([*batch.columns[:5], pa.array(sequence), pa.array(offset)], names)

    kind = dict(found.dtypes)["doc_id"]
    rows = placed.select(*names[:5], placed["rank"].cast("long").alias("rank"))
    return rows.mapInArrow(run, f"doc_id {kind}, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
