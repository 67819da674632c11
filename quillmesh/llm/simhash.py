"""Near-duplicates by SimHash and deletion-variant signatures.

Fingerprints that differ in at most ``bits`` bits, cut into bits // 2 + 1 segments, agree but for one bit in
one segment. Each segment is indexed once per bit, with that bit deleted; equal signatures meet, candidates
are verified on the whole fingerprint. Only distinct fingerprints are indexed, and a signature that many
share yields the edges of a spanning forest of its links, not all its pairs.

The signatures of one segment take about 2**21 values, so the verified candidates grow with the square of
the number of distinct fingerprints over that. One signature's fingerprints are one task's work: they agree
in a segment, so near copies give few distinct ones.

Defined results: null and blank texts have fingerprint zero and link like any other; repeated rows get one
row each; a null id takes part but never names a component unless all ids in it are null; an empty table
gives an empty result; other columns are ignored, or kept by ``keep_one``.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import utf8
from .common import stored
from .components import star_components

SHINGLE_WORDS, SEED, BITS = 4, 42, 4
#: Signatures up to this size compare all their pairs at once; larger ones grow trees. Results are alike.
SMALL = 16
_CHUNK = 1 << 16


def fingerprint(text: bytes, size: int = SHINGLE_WORDS) -> int:
    words = text.lower().split()  # on bytes: A-Z and the six ASCII blanks only
    if not words:
        return 0
    joined = b" ".join(words)
    lengths = np.fromiter(map(len, words), np.int64, len(words))
    ends = np.cumsum(lengths + 1) - 1
    n = max(1, len(words) - size + 1)
    from_, to = (ends - lengths)[:n].tolist(), ends[-n:].tolist()
    hash_ = xxhash.xxh64_intdigest
    counts = np.zeros(64, np.int64)
    for i in range(0, n, _CHUNK):
        h = np.array([hash_(joined[a:b], SEED) for a, b in zip(from_[i : i + _CHUNK], to[i : i + _CHUNK], strict=True)], "<u8")
        counts += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int.from_bytes(np.packbits(2 * counts > n, bitorder="little").tobytes(), "little")


def fingerprints(docs: DataFrame) -> DataFrame:
    """(doc_id, digest, print): the fingerprint as a signed long."""
    rows = docs.select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest"), "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, digest long, print long"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            found = np.array([fingerprint(data[a:b].tobytes()) for a, b in zip(offsets[:-1], offsets[1:], strict=True)], np.uint64)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found.view(np.int64))], ["doc_id", "digest", "print"])

    return rows.mapInArrow(run, schema)


def _signatures(fp: Column, bits: int) -> Column:
    """One integer per (segment, deleted bit): the variant's number and the segment without that bit."""
    segments = bits // 2 + 1
    cuts = [round(64 * i / segments) for i in range(segments + 1)]
    out = []
    for lo, hi in zip(cuts, cuts[1:], strict=False):
        part = F.shiftrightunsigned(fp, lo).bitwiseAND(F.lit((1 << (hi - lo)) - 1))
        for bit in range(hi - lo):
            out.append(part.bitwiseAND(F.lit(~(1 << bit))).bitwiseOR(F.lit((lo + bit) << 32)))
    return F.array(*out)


def _forest(prints: np.ndarray, bits: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Edges that connect what the links among ``prints`` connect."""
    left = prints
    while len(left):
        front, left = [left[0]], left[1:]
        while front and len(left):
            at = front.pop()
            near = np.bitwise_count(left ^ at) <= bits
            if near.any():
                found, left = left[near], left[~near]
                front.extend(found)
                yield np.full(len(found), at), found


def _edges(keys: np.ndarray, prints: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges within equal keys; keys are sorted."""
    starts = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    sizes = np.diff(np.append(starts, len(keys)))
    out = []
    few = np.repeat(sizes <= SMALL, sizes)
    for step in range(1, min(SMALL, int(sizes.max(initial=1)))):
        i = np.flatnonzero((keys[step:] == keys[:-step]) & few[step:])
        i = i[np.bitwise_count(prints[i] ^ prints[i + step]) <= bits]
        out.append((prints[i], prints[i + step]))
    for s, n in zip(starts[sizes > SMALL], sizes[sizes > SMALL], strict=True):
        out.extend(_forest(prints[s : s + n], bits))
    if not out:
        return np.zeros(0, np.uint64), np.zeros(0, np.uint64)
    return np.concatenate([x for x, _ in out]), np.concatenate([y for _, y in out])


def links(prints: DataFrame, bits: int = BITS) -> DataFrame:
    """Edges (a, b), a < b, whose components are those of all links among the distinct ``print``."""
    signed = prints.select("print", F.explode(_signatures(F.col("print"), bits)).alias("key"))
    met = signed.repartition("key").sortWithinPartitions("key")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []  # of the last key, which may go on

        def edges(keys: np.ndarray, fps: np.ndarray) -> pa.RecordBatch:
            a, b = (x.view(np.int64) for x in _edges(keys, fps, bits))
            pairs = np.unique(np.stack([np.minimum(a, b), np.maximum(a, b)], axis=1), axis=0)
            return pa.RecordBatch.from_arrays([pa.array(pairs[:, 0]), pa.array(pairs[:, 1])], ["a", "b"])

        for batch in batches:
            if not batch.num_rows:
                continue
            fps, keys = batch.column(0).to_numpy().view(np.uint64), batch.column(1).to_numpy()
            whole = int(np.searchsorted(keys, keys[-1]))
            if whole or (held and held[-1][0][0] != keys[-1]):
                parts = [*held, (keys[:whole], fps[:whole])]
                yield edges(np.concatenate([k for k, _ in parts]), np.concatenate([f for _, f in parts]))
                held = []
            held.append((keys[whole:], fps[whole:]))
        if held:
            yield edges(np.concatenate([k for k, _ in held]), np.concatenate([f for _, f in held]))

    return met.mapInArrow(run, "a long, b long").distinct()


def link_documents(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, digest (of the text), print, component_id."""
    rows = stored(fingerprints(docs))
    distinct = stored(rows.groupBy("print").agg(F.min("doc_id").alias("least")))
    stars = star_components(links(distinct, bits))
    rooted = distinct.join(stars, F.col("print") == F.col("node"), "left").select("print", "least", F.coalesce("root", "print").alias("root"))
    named = rooted.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(rooted.join(named, "root").select("print", "component_id"), "print")


def keep_one(docs: DataFrame, bits: int = BITS) -> DataFrame:
    """The documents with one of each component: the one with the least id (and of equal ids, least digest)."""
    return one_each(docs, link_documents(docs, bits))


def one_each(docs: DataFrame, linked: DataFrame) -> DataFrame:
    """The first document of each component of (doc_id, digest, component_id)."""
    best = linked.groupBy("component_id").agg(F.min(F.struct(F.col("doc_id").isNull(), "doc_id", "digest")).alias("best"))
    # A key without nulls: the join and the pick of one of equal rows then share its shuffle.
    key = lambda c: [F.coalesce(c, F.lit(0)).alias("_id"), F.col(c).isNull().alias("_none")]
    best = best.select(*key("best.doc_id"), F.col("best.digest").alias("_digest"))
    rows = docs.select(F.struct("*").alias("_row"), *key("doc_id"), F.xxhash64(F.coalesce("text", F.lit(""))).alias("_digest"))
    one = Window.partitionBy("_id", "_none", "_digest").orderBy(F.lit(1))
    kept = rows.join(best, ["_id", "_none", "_digest"]).withColumn("_n", F.row_number().over(one))
    return kept.where("_n = 1").select("_row.*")
