"""Substring dedup by fixed-block anchors.

Any ``window`` consecutive words hold a whole block of half as many at a multiple of that number, wherever the
window starts. So the blocks of every document are indexed, every rolling window of block size probes the
index, and the hits are extended: every window around a hit is hashed, and repeats in a document with a
smaller id mark its words. Consecutive marked windows are the maximal exact repeats.

Hashes travel packed, one row per block of documents and bucket of hashes, with four bytes for a probe. Index
entries of a bucket are merged to the least and greatest document of each hash, and probes stream past them, so
that a passage in many documents makes no pairs. A bucket's index must fit a task: there are
``BUCKETS_PER_PARTITION`` buckets for each shuffle partition. Probes are truncated hashes, so a false hit is
possible and only costs the look at its windows, which are compared by 96 bits.

Defined results: null and blank texts have no words; texts shorter than a window lose nothing; a document with a
null id neither loses words nor makes others lose them; of repeated rows (equal ids) neither makes the other
lose words; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .blocks import Block, blocks, inside, window_hashes, word_hashes

WINDOW = 50
BUCKETS_PER_PARTITION = 4
_PACKED = "bucket int, probe int, docs binary, counts binary, hashes binary"
_NAMES = [x.split()[0] for x in _PACKED.split(", ")]


def _pack(values: np.ndarray) -> bytes:
    """By byte planes: the equal upper bytes of neighbours then compress to nothing."""
    return np.ascontiguousarray(values.view(np.uint8).reshape(len(values), -1).T).tobytes()


def _unpack(raw: bytes, kind: type) -> np.ndarray:
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(np.dtype(kind).itemsize, -1).T).view(kind).ravel()


def _deal(hashes: np.ndarray, docs: np.ndarray, buckets: int, probe: int, extra: np.ndarray | None = None) -> Iterator[tuple]:
    """Rows of ``_PACKED``: the hashes by bucket, and in it by document. ``docs`` are sorted ids."""
    bucket = (hashes % np.uint64(buckets)).astype(np.uint16 if buckets < 1 << 16 else np.uint32)
    order = np.argsort(bucket, kind="stable")
    bounds = np.searchsorted(bucket[order], np.arange(buckets + 1))
    for b in np.flatnonzero(np.diff(bounds)):
        at = order[bounds[b] : bounds[b + 1]]
        firsts = np.flatnonzero(np.concatenate(([True], docs[at][1:] != docs[at][:-1])))
        counts = np.diff(np.append(firsts, len(at))).astype(np.uint32)
        body = (hashes[at] >> np.uint64(32)).astype(np.uint32).tobytes() if extra is None else hashes[at].tobytes() + extra[at].tobytes()
        yield int(b), probe, _pack(docs[at][firsts]), _pack(counts), body


def _batch(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.int32(), pa.binary(), pa.binary(), pa.binary()]
    return pa.RecordBatch.from_arrays([pa.array(x, k) for x, k in zip(zip(*rows, strict=True), kinds, strict=True)], _NAMES)


def _ids(column: pa.Array, block: Block) -> tuple[np.ndarray, np.ndarray]:
    """The id of every word's document, and whether there is one."""
    part = column.slice(block.row, len(block.first) - 1)
    known = np.asarray(part.is_valid())
    ids = part.fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64)
    docs = block.word_docs()
    return ids[docs], known[docs]


def _sorted_by_doc(docs: np.ndarray, *others: np.ndarray) -> tuple[np.ndarray, ...]:
    order = np.argsort(docs, kind="stable")
    return tuple(x[order] for x in (docs, *others))


def _keys(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """What a bucket and a packed hash in it tell of a hash."""
    return ((hashes % np.uint64(buckets)) << np.uint64(32)) | (hashes >> np.uint64(32))


def anchors_and_probes(docs: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed index blocks (probe 0) and rolling windows (probe 1) of the documents that have a window."""
    size = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                rolled = window_hashes(word_hashes(block), size)
                ids, known = _ids(batch.column(0), block)
                n = len(rolled)
                long = np.repeat(block.n_words >= window, block.n_words)[:n]
                place = np.arange(n) - np.repeat(block.first[:-1], block.n_words)[:n]
                use = np.flatnonzero(inside(block, size) & long & known[:n])
                if len(use):
                    docs_, hashes, place = _sorted_by_doc(ids[:n][use], rolled[use], place[use])
                    anchor = place % size == 0
                    yield _batch([*_deal(hashes[anchor], docs_[anchor], buckets, 0), *_deal(hashes, docs_, buckets, 1)])

    return docs.mapInArrow(run, _PACKED)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(batch.column(i).to_pylist() for i in range(5)), strict=True)


def anchor_hits(packed: DataFrame) -> DataFrame:
    """(doc_id, bucket, hashes): the probes of a document that meet an index block of another one."""
    met = packed.repartition("bucket").sortWithinPartitions("bucket", "probe")

    def merged(prints: list[np.ndarray], docs: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        p, d = np.concatenate(prints), np.concatenate(docs)
        order = np.argsort(p, kind="stable")
        p, d = p[order], d[order]
        starts = np.flatnonzero(np.concatenate(([True], p[1:] != p[:-1])))
        return p[starts], np.minimum.reduceat(d, starts), np.maximum.reduceat(d, starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, index = None, None
        prints: list[np.ndarray] = []
        owners: list[np.ndarray] = []
        out: list[tuple] = []
        for bucket, probe, docs, counts, hashes in _rows(batches):
            if bucket != now:
                now, index, prints, owners = bucket, None, [], []
            docs, counts, hashes = _unpack(docs, np.int64), _unpack(counts, np.uint32), np.frombuffer(hashes, np.uint32)
            each = np.repeat(docs, counts)
            if not probe:
                prints.append(hashes)
                owners.append(each)
                continue
            if index is None:
                if not prints:
                    continue
                index = merged(prints, owners)
            at = np.minimum(np.searchsorted(index[0], hashes), len(index[0]) - 1)
            hit = (index[0][at] == hashes) & ((index[1][at] != each) | (index[2][at] != each))
            if hit.any():
                each, hashes = each[hit], hashes[hit]
                ends = np.append(np.flatnonzero(each[1:] != each[:-1]) + 1, len(each))
                begin = 0
                for end in ends.tolist():
                    out.append((int(each[begin]), bucket, np.unique(hashes[begin:end]).tobytes()))
                    begin = end
            if len(out) > 10000:
                yield _hits(out)
                out = []
        if out:
            yield _hits(out)

    return met.mapInArrow(run, "doc_id long, bucket int, hashes binary")


def _hits(out: list[tuple]) -> pa.RecordBatch:
    doc, bucket, hashes = zip(*out, strict=True)
    return pa.RecordBatch.from_arrays([pa.array(doc, pa.int64()), pa.array(bucket, pa.int32()), pa.array(hashes, pa.binary())], ["doc_id", "bucket", "hashes"])


def _with_found(docs: DataFrame, found: DataFrame) -> DataFrame:
    """The documents, each with what was found for its id; both uses share the shuffle of the texts."""
    each = found.groupBy("doc_id").agg(F.collect_list(F.struct("bucket", "hashes")).alias("found")).withColumnRenamed("doc_id", "_id")
    return docs.join(each, F.col("doc_id") == F.col("_id"), "left").select("doc_id", "text", "found")


def candidate_windows(docs: DataFrame, hits: DataFrame, window: int, buckets: int) -> DataFrame:
    """Packed hashes of every window around a hit."""
    size = window // 2

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            batch = batch.filter(batch.column(2).is_valid())
            if not batch.num_rows:
                continue
            found = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                words = word_hashes(block)
                keys = _keys(window_hashes(words, size), buckets)
                hit = np.zeros(len(words) + 1, np.int64)
                for doc, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
                    last = min(int(b) - size + 1, len(keys))
                    if b - a >= window:
                        own = [(np.uint64(x["bucket"]) << np.uint64(32)) | np.frombuffer(x["hashes"], np.uint32).astype(np.uint64) for x in found[block.row + doc]]
                        hit[a + 1 : last + 1] = np.isin(keys[a:last], np.concatenate(own))
                sums = np.cumsum(hit)
                first, second = window_hashes(words, window, 1), window_hashes(words, window, 2)
                n = len(first)
                if not n:
                    continue
                near = sums[np.minimum(np.arange(n) + size + 1, len(words))] > sums[:n]
                use = np.flatnonzero(near & inside(block, window))
                if len(use):
                    ids, _ = _ids(batch.column(0), block)
                    docs_, h, more = _sorted_by_doc(ids[use], first[use], (second[use] >> np.uint64(32)).astype(np.uint32))
                    yield _batch(list(_deal(h, docs_, buckets, 1, more)))

    return _with_found(docs, hits).mapInArrow(run, _PACKED)


def later_windows(packed: DataFrame) -> DataFrame:
    """(doc_id, bucket, hashes): the windows of a document that start in one with a smaller id too."""
    met = packed.repartition("bucket").sortWithinPartitions("bucket")

    def judged(bucket: int, parts: list[tuple]) -> Iterator[tuple]:
        docs, first, second = (np.concatenate(x) for x in zip(*parts, strict=True))
        order = np.lexsort((docs, second, first))
        docs, first, second = docs[order], first[order], second[order]
        start = np.concatenate(([True], (first[1:] != first[:-1]) | (second[1:] != second[:-1])))
        least = docs[np.flatnonzero(start)][np.cumsum(start) - 1]
        docs, first = docs[docs > least], first[docs > least]
        if len(docs):
            docs, first = _sorted_by_doc(docs, first)
            ends = np.append(np.flatnonzero(docs[1:] != docs[:-1]) + 1, len(docs))
            begin = 0
            for end in ends.tolist():
                yield int(docs[begin]), bucket, np.unique(first[begin:end]).tobytes()
                begin = end

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, parts = None, []
        out: list[tuple] = []
        for bucket, _, docs, counts, body in _rows(batches):
            if bucket != now:
                if parts:
                    out.extend(judged(now, parts))
                now, parts = bucket, []
            each = np.repeat(_unpack(docs, np.int64), _unpack(counts, np.uint32))
            parts.append((each, np.frombuffer(body[: 8 * len(each)], np.uint64), np.frombuffer(body[8 * len(each) :], np.uint32)))
            if len(out) > 10000:
                yield _hits(out)
                out = []
        if parts:
            out.extend(judged(now, parts))
        if out:
            yield _hits(out)

    return met.mapInArrow(run, "doc_id long, bucket int, hashes binary")


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256, spans (first word and number of words)."""
    buckets = BUCKETS_PER_PARTITION * int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    hits = anchor_hits(anchors_and_probes(rows, window, buckets))
    later = later_windows(candidate_windows(rows, hits, window, buckets))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = batch.column(2).to_pylist()
            for block in blocks(batch.column(1)):
                rolled = window_hashes(word_hashes(block), window, 1) if any(found[block.row : block.row + len(block.n_words)]) else None
                raw = block.data.tobytes()
                removed, sums, spans = [], [], []
                for doc, (a, b) in enumerate(zip(block.first[:-1], block.first[1:], strict=True)):
                    words = raw[block.offsets[doc] : block.offsets[doc + 1]].split()  # bytes split at the six ASCII blanks
                    own, cut = found[block.row + doc], []
                    if own and b - a >= window:
                        starts = np.flatnonzero(np.isin(rolled[a : b - window + 1], np.concatenate([np.frombuffer(x["hashes"], np.uint64) for x in own])))
                        if len(starts):
                            breaks = np.flatnonzero(np.diff(starts) > window) + 1
                            cut = [(int(x[0]), int(x[-1] - x[0] + window)) for x in np.split(starts, breaks)]
                    for start, length in reversed(cut):
                        del words[start : start + length]
                    removed.append(sum(length for _, length in cut))
                    sums.append(hashlib.sha256(b" ".join(words)).hexdigest())
                    spans.append([{"start": s, "length": n} for s, n in cut])
                ids = batch.column(0).slice(block.row, len(removed))
                span = pa.list_(pa.struct([("start", pa.int32()), ("length", pa.int32())]))
                arrays = [ids, pa.array(block.n_words), pa.array(removed, pa.int64()), pa.array(sums), pa.array(spans, span)]
                yield pa.RecordBatch.from_arrays(arrays, ["doc_id", "n_words", "n_removed", "kept_sha256", "spans"])

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string, spans array<struct<start int, length int>>"
    return _with_found(rows, later).mapInArrow(run, schema)
