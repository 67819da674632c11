"""Quality rules by repetition coverage.

A document fails if too large a share of its word characters lies inside duplicated word n-grams of some
length, or inside lines that repeat an earlier one. Rolling hashes find the n-grams; a start whose n-gram
occurs once cannot start a longer duplicated one, so each length looks only at what the shorter one left.

Every length has a share and a limit of its own. The shortest counts n-grams found twice or more; the longer
ones, whose limits fall, count those found three times or more, so that a sentence at the head and foot of a
text is no fault, while a passage that keeps coming back is one at a smaller share.

Defined results: null and blank texts have no words and fail the word minimum; repeated rows get one row
each; an empty table gives an empty result; other columns are kept by ``keep_documents`` and ignored else.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType

from .blocks import Block, blocks, inside, mix, window_hashes, word_hashes

MIN_WORDS = 50
BASE_WINDOW, BASE_PERCENT = 3, 50
#: Per word n-gram length: how often an n-gram has to occur, and the largest share of word characters inside
#: such n-grams (all occurrences count). Then the largest share inside repeated lines.
GRAMS = {5: (2, 0.30), 6: (3, 0.28), 7: (3, 0.26), 8: (3, 0.24), 9: (3, 0.22), 10: (3, 0.20)}
LINE_SHARE = 0.20
SYMBOLS = b"#*$%&|<>"
_SYMBOL = np.zeros(256, dtype=bool)
_SYMBOL[list(SYMBOLS)] = True
_DROP = {ord(c): None for c in " \t\n\x0b\x0c\r"}
SCHEMA = (
    "n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, base_failed boolean, kept boolean, "
    "dup_line_share double, " + ", ".join(f"gram_share_{n} double" for n in GRAMS)
)


def _per_doc(values: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    sums = np.concatenate(([0], np.cumsum(values, dtype=np.int64)))
    return sums[bounds[1:]] - sums[bounds[:-1]]


def _occurrences(keys: np.ndarray) -> np.ndarray:
    """How often each key occurs. A count of low bits first sets aside what is surely single."""
    out = np.ones(len(keys), np.int64)
    if len(keys):
        slots = (keys & np.uint64((1 << max(4, (4 * len(keys)).bit_length())) - 1)).astype(np.int64)
        left = np.flatnonzero(np.bincount(slots)[slots] > 1)
        _, place, counts = np.unique(keys[left], return_inverse=True, return_counts=True)
        out[left] = counts[place]
    return out


def _covered(starts: np.ndarray, size: int, n: int) -> np.ndarray:
    edge = np.zeros(n + 1, np.int32)
    np.add.at(edge, starts, 1)
    np.add.at(edge, starts + size, -1)
    return np.cumsum(edge[:-1]) > 0


def _measure(block: Block) -> dict[str, np.ndarray]:
    n, docs = len(block.starts), block.word_docs()
    letters = np.concatenate(([0], np.cumsum((block.data & 0xC0) != 0x80)))
    chars = letters[block.ends] - letters[block.starts]
    out = {"n_words": block.n_words, "word_chars": _per_doc(chars, block.first), "n_symbols": _per_doc(_SYMBOL[block.data], block.offsets)}
    hashes = word_hashes(block)
    live = None
    for size in (BASE_WINDOW, *GRAMS):
        fits = inside(block, size)
        rolled = window_hashes(hashes, size)
        starts = np.flatnonzero(fits) if live is None else live[(live < len(fits))][fits[live[live < len(fits)]]]
        times = _occurrences(rolled[starts] ^ mix(docs[starts].astype(np.uint64) + np.uint64(1)))
        live = starts[times > 1]
        if size == BASE_WINDOW:
            out["n_repeat_words"] = _per_doc(_covered(live, size, n), block.first)
        else:
            covered = _covered(starts[times >= GRAMS[size][0]], size, n)
            out[f"gram_share_{size}"] = _per_doc(np.where(covered, chars, 0), block.first) / np.maximum(out["word_chars"], 1)
    return out


def _lines(block: Block) -> tuple[list[int], list[int]]:
    """Lines with a word that repeat an earlier line of the document: their number and word characters."""
    counts, chars = [], []
    raw = block.data.tobytes()
    for a, b in zip(block.offsets[:-1], block.offsets[1:], strict=True):
        lines = raw[a:b].decode().split("\n")
        again = []
        if len(set(lines)) < len(lines):
            seen: set[str] = set()
            for line in lines:
                if line not in seen:
                    seen.add(line)
                elif bare := line.translate(_DROP):
                    again.append(len(bare))
        counts.append(len(again))
        chars.append(sum(again))
    return counts, chars


def _judge(texts: pa.Array) -> dict[str, list]:
    out: dict[str, list] = {}
    for block in blocks(texts):
        found = _measure(block)
        n_dup, dup_chars = _lines(block)
        found["n_dup_lines"] = np.array(n_dup, np.int64)
        found["dup_line_share"] = np.array(dup_chars, np.int64) / np.maximum(found["word_chars"], 1)
        found["base_failed"] = (found["n_words"] < MIN_WORDS) | (100 * found["n_repeat_words"] > BASE_PERCENT * found["n_words"])
        rejected = found["dup_line_share"] > LINE_SHARE
        for size, (_, limit) in GRAMS.items():
            rejected |= found[f"gram_share_{size}"] > limit
        found["kept"] = ~(found["base_failed"] | rejected)
        for k, v in found.items():
            out.setdefault(k, []).extend(v.tolist())
    return out


def judge_documents(docs: DataFrame) -> DataFrame:
    """One row per document: doc_id, the counts of the base rules, the coverage shares and ``kept``."""
    rows = docs.select("doc_id", "text")
    schema = f"doc_id {dict(rows.dtypes)['doc_id']}, {SCHEMA}"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                found = _judge(batch.column(1))
                names = [x.split()[0] for x in SCHEMA.split(", ")]
                yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(found[x]) for x in names)], ["doc_id", *names])

    return rows.mapInArrow(run, schema)


@F.pandas_udf(BooleanType())
def _kept(texts):
    import pandas as pd

    return pd.Series(_judge(pa.array(texts, pa.large_string(), from_pandas=True)).get("kept", []), dtype=bool)


def keep_documents(docs: DataFrame) -> DataFrame:
    """The documents that pass, with all their columns; nothing is shuffled."""
    return docs.where(_kept(F.col("text")))
