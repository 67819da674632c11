"""Token counts with two tiers of known pre-token lengths.

A text is cut into pre-tokens where the tokenizer surely cuts too: before a space between two visible
characters, and around a line break between two. The tokens of a text are then the sum over its pre-tokens.
Lengths come from a compact hash table of frequent pre-tokens that every task gets, then from the worker's
cache, and else from the library itself. Nothing but the documents' counts leaves a task.

The frequent pre-tokens are those of ``SAMPLE_ROWS`` documents at most; they are a cache, and any other choice
gives the same counts. The table has ``TABLE_ROWS`` entries of 24 bytes at most.

Defined results: null texts count as empty, with no bytes and no tokens; repeated rows get one row each; an
empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import cut_rows, lanes, padded, span_hashes, utf8

SAMPLE_ROWS = 2000
TABLE_ROWS = 1 << 16
CACHE_ROWS, CACHE_BYTES = 1 << 19, 256
#: ASCII characters that show, and first bytes of two-byte characters from U+00C0 on: none of them is a blank.
_SAFE = np.zeros(256, dtype=bool)
_SAFE[0x21:0x7F] = True
_SAFE[0xC3:0xE0] = True
_LEAD = np.zeros(256, dtype=bool)
_LEAD[0xC3:0xE0] = True


@lru_cache(maxsize=4)
def tokenizer(path: str):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


def pre_tokens(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens of adjacent texts; every non-empty text starts one."""
    if not len(data):
        return np.zeros(0, np.int64)
    show = _SAFE[data]  # of the character that starts at a byte
    ends = show & (data < 0x80)  # of the character that ends at a byte
    ends[1:] |= (data[1:] >= 0x80) & (data[1:] < 0xC0) & _LEAD[data[:-1]]
    gap = np.zeros(len(data), bool)
    gap[1:-1] = ends[:-2] & show[2:]
    line = gap & (data == 10)
    cut = line | (gap & (data == 32))
    cut[1:] |= line[:-1]
    starts = offsets[:-1][np.diff(offsets) > 0]
    inner = starts[starts > 0]
    for i in (inner - 1, inner):  # a text's first and last characters have no neighbour beyond it
        cut[i] = False
    cut[starts] = True
    return np.flatnonzero(cut)


def _sizes(path: str, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    raw = data.tobytes()
    texts = [raw[a:b].decode() for a, b in zip(starts.tolist(), ends.tolist(), strict=True)]
    found = tokenizer(path).encode_batch_fast(texts, add_special_tokens=False)
    return np.fromiter((len(x.ids) for x in found), np.int64, len(texts))


@lru_cache(maxsize=4)
def worker_cache(path: str) -> dict[bytes, int]:
    """Token numbers by pre-token, for all tasks of a worker."""
    return {}


class Lengths:
    """Token numbers of pre-tokens: the shared table, then this worker's cache, then the library.

    A hit in the table has the hash and the first eight bytes of the entry, one in the cache all bytes.
    """

    def __init__(self, path: str, hashes: np.ndarray, sizes: np.ndarray, heads: np.ndarray | None = None):
        self.path, self.hashes, self.sizes = path, hashes, sizes
        self.heads = np.zeros(0, np.uint64) if heads is None else heads
        self.cache = worker_cache(path)

    def of(self, data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        hashes = span_hashes(data, starts, ends)
        out = np.full(len(hashes), -1, np.int64)
        if len(self.hashes):
            at = np.minimum(np.searchsorted(self.hashes, hashes), len(self.hashes) - 1)
            hit = np.flatnonzero(self.hashes[at] == hashes)
            hit = hit[self.heads[at[hit]] == lanes(padded(data), starts[hit], ends[hit])]
            out[hit] = self.sizes[at[hit]]
        miss = np.flatnonzero(out < 0)
        if len(miss):
            _, first, back = np.unique(hashes[miss], return_index=True, return_inverse=True)
            spots, raw = miss[first], data.tobytes()
            words = [raw[a:b] for a, b in zip(starts[spots].tolist(), ends[spots].tolist(), strict=True)]
            known = np.fromiter((self.cache.get(w, -1) for w in words), np.int64, len(words))
            new = np.flatnonzero(known < 0)
            if len(new):
                known[new] = _sizes(self.path, data, starts[spots[new]], ends[spots[new]])
                if len(self.cache) + len(new) > CACHE_ROWS:
                    self.cache.clear()
                short = [(words[i], n) for i, n in zip(new.tolist()[:CACHE_ROWS], known[new].tolist(), strict=False) if len(words[i]) <= CACHE_BYTES]
                self.cache.update(short)
            out[miss] = known[back]
        return out


def frequent_lengths(docs: DataFrame, path: str, text: str = "text") -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hashes, token numbers and first bytes of the pre-tokens that a bounded sample of documents uses most."""
    fraction = min(1.0, SAMPLE_ROWS / max(1, docs.count()))
    sample = docs.select(F.col(text).alias("text")).sample(fraction, 1).limit(SAMPLE_ROWS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in cut_rows(offsets):
                part = data[offsets[i] : offsets[j]]
                starts = pre_tokens(part, offsets[i : j + 1] - offsets[i])
                ends = np.append(starts[1:], len(part))[: len(starts)]
                unique, first, counts = np.unique(span_hashes(part, starts, ends), return_index=True, return_counts=True)
                top = np.argsort(-counts, kind="stable")[:TABLE_ROWS]
                sizes = _sizes(path, part, starts[first[top]], ends[first[top]])
                heads = lanes(padded(part), starts[first[top]], ends[first[top]])
                yield pa.RecordBatch.from_arrays([pa.array(unique[top].view(np.int64)), pa.array(heads.view(np.int64)), pa.array(sizes), pa.array(counts[top])], ["h", "head", "size", "n"])

    found = sample.mapInArrow(run, "h long, head long, size long, n long").groupBy("h", "head").agg(F.max("size").alias("size"), F.sum("n").alias("n"))
    rows = found.orderBy(F.desc("n"), "h", "head").limit(TABLE_ROWS).select("h", "head", "size").toPandas()
    hashes = rows["h"].to_numpy(np.int64).view(np.uint64)
    order = np.argsort(hashes)
    return hashes[order], rows["size"].to_numpy(np.int64)[order], rows["head"].to_numpy(np.int64).view(np.uint64)[order]


def count_tokens(docs: DataFrame, path: str, limit: int) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_tokens, over_limit. Nothing is shuffled."""
    rows = docs.select("doc_id", "text")
    table = docs.sparkSession.sparkContext.broadcast(frequent_lengths(docs, path))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        lengths = Lengths(path, *table.value)
        for batch in batches:
            if not batch.num_rows:
                continue
            data, offsets = utf8(batch.column(1))
            counts = np.zeros(batch.num_rows, np.int64)
            for i, j in cut_rows(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                starts = pre_tokens(part, at)
                sums = np.concatenate(([0], np.cumsum(lengths.of(part, starts, np.append(starts[1:], len(part))[: len(starts)]))))
                counts[i:j] = np.diff(sums[np.searchsorted(starts, at)])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(np.diff(offsets)), pa.array(counts), pa.array(counts > limit)], ["doc_id", "n_bytes", "n_tokens", "over_limit"])

    return rows.mapInArrow(run, f"doc_id {dict(rows.dtypes)['doc_id']}, n_bytes long, n_tokens long, over_limit boolean")
