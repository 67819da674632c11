"""BPE encoding and decoding with content-defined chunks that are encoded once.

A text is cut where a rolling hash of its last bytes says so, so that equal passages give equal chunks wherever they
stand. Chunks that occur more than once are encoded once and their tokens joined to all places; the others are encoded
where they stand. A chunk's own ends mean nothing to the tokenizer, so of a chunk only the tokens between *sure
cuts* count (places where a tokenizer surely starts a new word, see ``token_counts.pre_tokens``): the core between the
second and the last but one. What lies between two cores, the join, is encoded by itself, from one sure cut before the
left core's end to one after the right core's start. The join must give the very tokens that the chunks have there;
where they do not agree, the join is taken wider, and at last the whole text. A chunk is put together from its words
between sure cuts, which a worker keeps; a join is encoded as one text, so that their agreement is a test of both.

A text whose chunks all stand alone never leaves its task. Which chunks may occur twice is told by a bit map of
``SLOTS`` bits over the hashes of those that do; a false hit only makes a chunk shared with itself.

Defined results: null counts as empty, which has no tokens; special strings inside texts are tokens, as by the library's
default; repeated rows get one row each; an empty table gives an empty result; other columns are ignored. Very
long texts are many chunks; a text without sure cuts is one join.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .blocks import cut_rows, mix, span_hashes, utf8
from .common import stored
from .token_counts import pre_tokens, tokenizer

#: A chunk ends where ``CUT_BITS`` bits of the hash of the last 32 bytes are zero, after LEAST bytes and before MOST.
CUT_BITS, LEAST, MOST = 10, 256, 1 << 14
#: Bits of the map of shared chunks (1 MB), and bytes of text encoded at a time.
SLOTS, ENCODE_BYTES = 1 << 23, 1 << 20
#: Words whose ids a worker keeps.
WORDS = 1 << 19
_GEAR = mix(np.arange(1, 257, dtype=np.uint64)).astype(np.uint32)


def rolling(data: np.ndarray) -> np.ndarray:
    """The hash of the last 32 bytes at each byte: the sum of their table values, shifted once more for each later byte."""
    h, span = _GEAR[data], 1
    while span < 32:
        h[span:] += h[:-span] << np.uint32(span)  # the right side is a copy
        span *= 2
    return h


def chunk_ends(data: np.ndarray, offsets: np.ndarray) -> list[np.ndarray]:
    """The ends of each text's chunks; chunks end between characters."""
    out = []
    at_char = np.append((data[1:] & 0xC0) != 0x80, True) if len(data) else np.zeros(0, bool)
    marks = np.flatnonzero((rolling(data) >> np.uint32(32 - CUT_BITS) == 0) & at_char) + 1 if len(data) else np.zeros(0, np.int64)
    low, high = np.searchsorted(marks, offsets[:-1], "right"), np.searchsorted(marks, offsets[1:], "left")
    for start, end, a, b in zip(offsets[:-1].tolist(), offsets[1:].tolist(), low.tolist(), high.tolist(), strict=True):
        ends, last = [], start
        for mark in [*marks[a:b].tolist(), end]:
            while mark - last > MOST:
                last += MOST
                while not at_char[last - 1]:
                    last -= 1
                ends.append(last)
            if mark - last >= LEAST or (mark == end and mark > last):
                ends.append(mark)
                last = mark
        out.append(np.array(ends, np.int64))
    return out


def chunk_name(chunk: bytes) -> bytes:
    return hashlib.blake2b(chunk, digest_size=16).digest()


@lru_cache(maxsize=4)
def token_bytes(path: str) -> tuple[np.ndarray, np.ndarray, str]:
    """The bytes of all tokens of a byte-level tokenizer in order of their ids, the numbers of bytes, and the type that holds an id."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]  # of the byte alphabet, those that stand for themselves
    alphabet = {chr(b): b for b in shown}
    alphabet.update({chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in shown)})
    names = tokenizer(path).get_vocab(with_added_tokens=True)
    table = [b""] * (max(names.values(), default=0) + 1)
    for name, i in names.items():
        table[i] = bytes(alphabet[c] for c in name) if all(c in alphabet for c in name) else name.encode()
    return np.frombuffer(b"".join(table), np.uint8), np.array([len(t) for t in table], np.int64), "<u2" if len(table) <= 1 << 16 else "<u4"


def decode(path: str, ids: np.ndarray) -> bytes:
    """The bytes that ids stand for."""
    table, sizes, _ = token_bytes(path)
    firsts, out = np.cumsum(sizes) - sizes, []
    for i in range(0, len(ids), ENCODE_BYTES):
        part = ids[i : i + ENCODE_BYTES]
        n = sizes[part]
        out.append(table[np.arange(n.sum()) + np.repeat(firsts[part] - (np.cumsum(n) - n), n)].tobytes())
    return b"".join(out)


def encode_all(path: str, texts: list[bytes]) -> list[np.ndarray]:
    """The ids of each text by itself, a bounded number of bytes at a time."""
    out: list[np.ndarray] = []
    kind, at = token_bytes(path)[2], 0
    sizes = np.cumsum([len(t) for t in texts])
    while at < len(texts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + ENCODE_BYTES)))
        found = tokenizer(path).encode_batch_fast([t.decode() for t in texts[at:to]], add_special_tokens=False)
        out.extend(np.array(x.ids, kind) for x in found)
        at = to
    return out


class Words:
    """Ids of texts from the words between their sure cuts, which a worker encodes once while they are kept."""

    def __init__(self, path: str):
        self.path = path
        self.forget()

    def forget(self) -> None:
        self.slots: dict[bytes, int] = {}
        self.flat = np.zeros(0, token_bytes(self.path)[2])
        self.begins, self.sizes = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def of(self, texts: list[bytes]) -> list[np.ndarray]:
        data = np.frombuffer(b"".join(texts), np.uint8)
        offsets = np.concatenate(([0], np.cumsum([len(t) for t in texts]))).astype(np.int64)
        starts = pre_tokens(data, offsets)
        ends = np.append(starts[1:], len(data))[: len(starts)]
        _, first, back = np.unique(span_hashes(data, starts, ends), return_index=True, return_inverse=True)
        raw = data.tobytes()
        words = [raw[a:b] for a, b in zip(starts[first].tolist(), ends[first].tolist(), strict=True)]
        slots = np.fromiter((self.slots.get(w, -1) for w in words), np.int64, len(words))
        if len(self.slots) + int((slots < 0).sum()) > WORDS or len(self.flat) > 8 * WORDS:
            self.forget()
            slots[:] = -1
        new = np.flatnonzero(slots < 0)
        if len(new):
            found = encode_all(self.path, [words[i] for i in new.tolist()])
            sizes = np.array([len(x) for x in found], np.int64)
            self.begins = np.concatenate((self.begins, len(self.flat) + np.cumsum(sizes) - sizes))
            slots[new] = len(self.sizes) + np.arange(len(new))
            self.sizes, self.flat = np.concatenate((self.sizes, sizes)), np.concatenate((self.flat, *found))
            self.slots.update(zip((words[i] for i in new.tolist()), slots[new].tolist(), strict=True))
        slot = slots[back]
        each = self.sizes[slot]
        ends_ = np.cumsum(each)
        ids = self.flat[np.repeat(self.begins[slot] - (ends_ - each), each) + np.arange(int(each.sum()))]
        cuts = np.concatenate(([0], ends_))[np.searchsorted(starts, offsets)]
        return [ids[a:b] for a, b in zip(cuts[:-1].tolist(), cuts[1:].tolist(), strict=True)]


@lru_cache(maxsize=2)
def worker_words(path: str) -> Words:
    """One cache for all tasks of a worker."""
    return Words(path)


def encode_parts(path: str, parts: list[bytes]) -> list[np.ndarray]:
    """The ids of the parts of chunks between sure cuts, a bounded number of bytes at a time."""
    out: list[np.ndarray] = []
    sizes, at = np.cumsum([len(t) for t in parts]), 0
    while at < len(parts):
        to = max(at + 1, int(np.searchsorted(sizes, sizes[at] + 4 * ENCODE_BYTES)))
        out.extend(worker_words(path).of(parts[at:to]))
        at = to
    return out


#: A chunk's part between its first and last sure cuts: its ids, and the bytes of the guards at its two sides.
Core = tuple[np.ndarray, int, int]


def split_core(path: str, core: Core) -> tuple[np.ndarray, np.ndarray, np.ndarray] | None:
    """The ids of the first guard, the core and the last guard; None where the tokens do not keep to the sure cuts."""
    ids, lead, trail = core
    ends = np.cumsum(token_bytes(path)[1][ids])
    a, b = np.searchsorted(ends, [lead, ends[-1] - trail]) + 1
    if ends[a - 1] != lead or ends[b - 1] != ends[-1] - trail:
        return None
    return ids[:a], ids[a:b], ids[b:]


def agreed(path: str, joins: list[np.ndarray], cores: list[Core]) -> list[np.ndarray] | None:
    """The ids of a text in order, if every join gives the guards of the cores beside it as these have them."""
    out, before = [], joins[0][:0]
    for join, core in zip(joins, cores, strict=False):
        parts = split_core(path, core)
        if parts is None or not np.array_equal(join[: len(before)], before) or not np.array_equal(join[len(join) - len(parts[0]) :], parts[0]):
            return None
        out += [join, parts[1]]
        before = parts[2]
    return [*out, joins[-1]] if np.array_equal(joins[-1][: len(before)], before) else None


def widened(path: str, joins: list[np.ndarray], cores: list[Core]) -> tuple[list[np.ndarray], list[Core]]:
    """The joins over every second core, encoded anew. Their texts are what their ids stand for."""
    texts, kept = [decode(path, joins[0])], []
    for n, (core, join) in enumerate(zip(cores, joins[1:], strict=True)):
        if n % 2:
            kept.append(core)
            texts.append(decode(path, join))
        else:
            ids, lead, trail = core
            part = decode(path, ids)
            texts[-1] += part[lead : len(part) - trail] + decode(path, join)
    return encode_all(path, texts), kept


def settled(path: str, joins: list[np.ndarray], cores: list[Core]) -> tuple[int, str, str]:
    """The number and digest of a text's ids and the digest of what they decode to, once joins and cores agree."""
    while (parts := agreed(path, joins, cores)) is None:
        joins, cores = widened(path, joins, cores)
    ids = np.concatenate(parts)
    decoded = decode(path, ids).decode(errors="replace")
    return len(ids), hashlib.sha256(ids.astype("<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


@dataclass
class Chunk:
    """The part of a chunk between its first and last sure cuts, and the sizes of its guards."""

    start: int
    end: int
    lead: int
    trail: int


def cored_chunks(data: np.ndarray, start: int, ends: np.ndarray, cuts: np.ndarray) -> list[tuple[int, int, Chunk]]:
    """(from, to, chunk) of the chunks of a text with at least four sure cuts inside, from its own sorted sure cuts."""
    out = []
    bounds = [start, *ends.tolist()]
    # a cut shows by up to three bytes before it and one after; all must be the chunk's own
    low, high = np.searchsorted(cuts, np.array(bounds[:-1]) + 3), np.searchsorted(cuts, np.array(bounds[1:]) - 2, "right")
    for a, b, i, j in zip(bounds, bounds[1:], low.tolist(), high.tolist(), strict=False):
        if j - i >= 4:
            out.append((a, b, Chunk(int(cuts[i]), int(cuts[j - 1]), int(cuts[i + 1] - cuts[i]), int(cuts[j - 1] - cuts[j - 2]))))
    return out


def _joins(start: int, end: int, chunks: list[Chunk]) -> list[tuple[int, int]]:
    """The spans between the cores, each with the guards at its sides."""
    lefts = [start, *(c.end - c.trail for c in chunks)]
    rights = [*(c.start + c.lead for c in chunks), end]
    return list(zip(lefts, rights, strict=True))


PIECES = "row long, doc_id {}, kind string, piece int, name binary, ids binary, lead int, trail int, n_tokens long, ids_sha256 string, decoded_sha256 string"


def chunk_names(docs: DataFrame) -> DataFrame:
    """(name): one row per chunk of all texts, equal ones of a block of texts combined to two at most."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = utf8(batch.column(0))
            for i, j in cut_rows(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                seen: dict[bytes, int] = {}
                for start, ends in zip(at[:-1].tolist(), chunk_ends(part, at), strict=True):
                    for a, b in zip([start, *ends.tolist()], ends.tolist(), strict=False):
                        name = chunk_name(part[a:b].tobytes())
                        seen[name] = seen.get(name, 0) + 1
                names = [n for n, k in seen.items() for _ in range(min(k, 2))]
                yield pa.RecordBatch.from_arrays([pa.array(names, pa.binary())], ["name"])

    return docs.select("text").mapInArrow(run, "name binary")


def _slot(name: bytes, slots: int) -> int:
    return int.from_bytes(name[:6], "big") % slots


def shared_map(names: DataFrame, slots: int = SLOTS) -> np.ndarray:
    """Bits of the slots of all names that occur twice; ``slots`` / 64 longs at most come to the driver."""
    twice = names.groupBy("name").count().where("count > 1")
    slot = F.conv(F.hex(F.substring("name", 1, 6)), 16, 10).cast("long") % slots
    marked = twice.select(slot.alias("slot")).groupBy(F.floor(F.col("slot") / 64).cast("int").alias("word"))
    found = marked.agg(F.expr("bit_or(shiftleft(1L, cast(slot % 64 as int)))").alias("bits")).toPandas()
    words = np.zeros(slots // 64, np.int64)
    words[found["word"].to_numpy(np.int64)] = found["bits"].to_numpy(np.int64)
    return words.view(np.uint64)


def _pieces(docs: DataFrame, path: str, shared: np.ndarray, slots: int) -> DataFrame:
    """Done texts, and of the others: joins and cores by name, and once per block of texts the chunk behind a name."""
    kind = dict(docs.dtypes)["doc_id"]
    rows = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    words = docs.sparkSession.sparkContext.broadcast(shared)
    empty = hashlib.sha256(b"").hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bits = words.value
        for batch in batches:
            data, offsets = utf8(batch.column(2))
            ids_, docs_ = batch.column(0).to_pylist(), batch.column(1).to_pylist()
            for i, j in cut_rows(offsets):
                part, at = data[offsets[i] : offsets[j]], offsets[i : j + 1] - offsets[i]
                cuts = pre_tokens(part, at)
                out: list[tuple] = []
                sent: set[bytes] = set()
                texts: list[bytes] = []  # the joins, which the library encodes whole
                parts: list[bytes] = []  # of the chunks that stand alone
                plans = []
                for k, (start, end, ends) in enumerate(zip(at[:-1].tolist(), at[1:].tolist(), chunk_ends(part, at), strict=True)):
                    own = cuts[np.searchsorted(cuts, start, "right") : np.searchsorted(cuts, end)]
                    cored = cored_chunks(part, start, ends, own)
                    names = [chunk_name(part[a:b].tobytes()) for a, b, _ in cored]
                    refs = [int(bits[(s := _slot(n, slots)) >> 6]) >> (s & 63) & 1 for n in names]
                    chunks = [c for _, _, c in cored]
                    spans = _joins(start, end, chunks)
                    plans.append((k, start, end, chunks, names, refs, len(texts)))
                    texts.extend(part[a:b].tobytes() for a, b in spans)
                    parts.extend(part[c.start : c.end].tobytes() for c, ref in zip(chunks, refs, strict=True) if not ref)
                found, rest = encode_all(path, texts), iter(encode_parts(path, parts))
                for k, start, end, chunks, names, refs, first in plans:
                    row, doc = ids_[i + k], docs_[i + k]
                    if start == end:
                        out.append((row, doc, "done", None, None, None, None, None, 0, empty, empty))
                        continue
                    joins = found[first : first + len(chunks) + 1]
                    if not any(refs):
                        cores = [(next(rest), c.lead, c.trail) for c in chunks]
                        out.append((row, doc, "done", None, None, None, None, None, *settled(path, joins, cores)))
                        continue
                    for n, ids in enumerate(joins):
                        out.append((row, doc, "join", 2 * n, None, ids.tobytes(), None, None, None, None, None))
                    for n, (chunk, name, ref) in enumerate(zip(chunks, names, refs, strict=True)):
                        out.append((row, doc, "core", 2 * n + 1, name if ref else None, None if ref else next(rest).tobytes(), chunk.lead, chunk.trail, None, None, None))
                        if ref and name not in sent:
                            sent.add(name)
                            out.append((None, None, "text", None, name, part[chunk.start : chunk.end].tobytes(), None, None, None, None, None))
                columns = list(zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names_)

    types = [pa.int64(), to_arrow_type(rows.schema["doc_id"].dataType), pa.string(), pa.int32(), pa.binary(), pa.binary(), pa.int32(), pa.int32(), pa.int64(), pa.string(), pa.string()]
    names_ = [c.split()[0] for c in PIECES.format(kind).split(", ")]
    return rows.mapInArrow(run, PIECES.format(kind))


def _encoded(texts: DataFrame, path: str) -> DataFrame:
    """(name, ids) of every distinct chunk, each encoded once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = [x.tobytes() for x in encode_parts(path, batch.column(1).to_pylist())]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(ids, pa.binary())], ["name", "ids"])

    return texts.groupBy("name").agg(F.max("ids").alias("ids")).mapInArrow(run, "name binary, ids binary")


def _assembled(pieces: DataFrame, path: str) -> DataFrame:
    """(row, n_tokens, ids_sha256, decoded_sha256) of the texts whose pieces (row, piece, kind, ids, lead, trail) meet; one text's
    ids are held at a time."""
    met = pieces.select("row", "piece", "kind", "ids", "lead", "trail").repartition("row").sortWithinPartitions("row", "piece")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind = token_bytes(path)[2]
        names, types = ["row", "n_tokens", "ids_sha256", "decoded_sha256"], [pa.int64(), pa.int64(), pa.string(), pa.string()]
        now, joins, cores = None, [], []

        def batch_of(rows: list[tuple]) -> pa.RecordBatch:
            columns = list(zip(*rows, strict=True)) or [[]] * 4
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

        for batch in batches:
            done = []
            for row, what, ids, lead, trail in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3, 4, 5)), strict=True):
                if row != now:
                    if joins:
                        done.append((now, *settled(path, joins, cores)))
                    now, joins, cores = row, [], []
                ids = np.frombuffer(ids, kind)
                if what == "join":
                    joins.append(ids)
                else:
                    cores.append((ids, lead, trail))
            yield batch_of(done)
        if joins:
            yield batch_of([(now, *settled(path, joins, cores))])

    return met.mapInArrow(run, "row long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode_documents(docs: DataFrame, path: str, slots: int = SLOTS) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids_sha256, decoded_sha256. ``path`` is a byte-level tokenizer."""
    pieces = stored(_pieces(docs, path, shared_map(chunk_names(docs), slots), slots))
    columns = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    chunks = stored(_encoded(pieces.where("kind = 'text'").select("name", "ids"), path))
    cores = pieces.where("kind = 'core'").select("row", "kind", "piece", "name", "ids", "lead", "trail")
    here = cores.where("name is null").drop("name")
    there = cores.where("name is not null").drop("ids").join(chunks, "name").select(*here.columns)
    joins = pieces.where("kind = 'join'")
    met = _assembled(joins.select(*here.columns).unionByName(here).unionByName(there), path)
    ids = joins.where("piece = 0").select("row", "doc_id")
    return pieces.where("kind = 'done'").select(*columns).unionByName(met.join(ids, "row").select(*columns))
