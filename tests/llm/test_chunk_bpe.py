"""Chunked encoding against the tokenizers library."""

import hashlib
import random

import numpy as np
import pytest

from quillmesh.llm import chunk_bpe
from quillmesh.llm.queries import tokenizer_path
from quillmesh.llm.token_counts import tokenizer

PATH = tokenizer_path("byte_bpe_50k.json")
SCHEMA = "doc_id long, text string, row long, kind string, name string, ids long"


def plain(text):
    ids = tokenizer(PATH).encode(text or "", add_special_tokens=False).ids
    decoded = tokenizer(PATH).decode(ids, skip_special_tokens=False)
    return len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(decoded.encode()).hexdigest()


def documents():
    rng = random.Random(13)
    parts = ["the", "Don't", "we'll", "x1y2", "12345", "été", "über", "日本語", "привет", "😀😀", "--", "...", "<|endoftext|>", "<|endof", "\u00a0", "\u2028", "a\u0301", "\t", "\r\n", "word," * 3]
    prose = lambda n: "".join(rng.choice(parts) + rng.choice([" ", " ", " ", "  ", "\n", "", " \n "]) for _ in range(n))
    passages = [prose(rng.choice([100, 400, 900])) for _ in range(5)]
    rows = []
    for i in range(60):
        text = prose(rng.choice([0, 3, 60, 500]))
        for _ in range(rng.choice([0, 0, 1, 2])):
            text = text[: len(text) // 2] + rng.choice(passages) + text[len(text) // 2 :]
        rows.append((i, text))
    rows += [(100 + i, rows[7][1]) for i in range(5)] + [(200 + i, passages[2]) for i in range(3)]
    rows += [(300, None), (301, ""), (302, " "), (303, "x" * 50_000), (304, "日本" * 20_000), (305, "a b " * 20_000), (306, "\n" * 5000), (307, "<|endoftext|>" * 2000)]
    rows += [(308, passages[1] + passages[1] + passages[1]), (309, "ab cd\n" * 9000 + passages[0]), (None, rows[3][1]), (5, rows[9][1]), (5, rows[9][1]), (None, None)]
    return rows


@pytest.mark.parametrize("slots", [64, chunk_bpe.SLOTS])
def test_documents(spark, slots):
    rows = documents()
    got = chunk_bpe.encode_documents(spark.createDataFrame([(*r, 1, "x", "y", 2) for r in rows], SCHEMA).repartition(5), PATH, slots)
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert sorted((tuple(r) for r in got.collect()), key=repr) == sorted(((d, *plain(t)) for d, t in rows), key=repr)


def test_only_repeated_chunks_are_shared(spark):
    rows = [(i, t) for i, t in documents() if t]
    frame = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    shared = chunk_bpe.shared_map(chunk_bpe.chunk_names(frame))
    pieces = chunk_bpe._pieces(frame, PATH, shared, chunk_bpe.SLOTS).groupBy("kind").count().collect()
    counts = {r["kind"]: r["count"] for r in pieces}
    assert counts["done"] > 10 and counts["core"] > 20 and 0 < counts["text"] < counts["core"]
    alone = spark.createDataFrame([(i, f"{i} " + " ".join(f"w{i}x{j}" for j in range(400))) for i in range(20)], "doc_id long, text string")
    assert not chunk_bpe.shared_map(chunk_bpe.chunk_names(alone)).any()


def test_empty(spark):
    assert chunk_bpe.encode_documents(spark.createDataFrame([], SCHEMA), PATH).count() == 0


def test_disagreeing_joins_are_widened():
    text = " ".join(f"word{i % 7}" for i in range(900)).encode()
    data, at = np.frombuffer(text, np.uint8), np.array([0, len(text)])
    cuts = chunk_bpe.pre_tokens(data, at)[1:]
    chunks = [c for _, _, c in chunk_bpe.cored_chunks(data, 0, np.array([1000, 2000, 3000, 4000, len(text)]), cuts)]
    assert len(chunks) == 5
    joins = chunk_bpe.encode_all(PATH, [text[a:b] for a, b in chunk_bpe._joins(0, len(text), chunks)])
    cores = [(x, c.lead, c.trail) for x, c in zip(chunk_bpe.encode_all(PATH, [text[c.start : c.end] for c in chunks]), chunks, strict=True)]
    assert chunk_bpe.agreed(PATH, joins, cores) and chunk_bpe.settled(PATH, joins, cores) == plain(text.decode())
    split = lambda ids: np.concatenate([np.concatenate([chunk_bpe.encode_all(PATH, [bytes([b])])[0] for b in chunk_bpe.decode(PATH, np.array([i]))]) for i in ids.tolist()])
    for k in range(6):  # a join whose tokens are single bytes: same text, other ids
        wrong = [split(x) if i == k else x for i, x in enumerate(joins)]
        assert chunk_bpe.agreed(PATH, wrong, cores) is None and chunk_bpe.settled(PATH, wrong, cores) == plain(text.decode())
    for k in range(5):
        wrong = [(split(x), a, b) if i == k else (x, a, b) for i, (x, a, b) in enumerate(cores)]
        assert chunk_bpe.settled(PATH, joins, wrong) == plain(text.decode())


def test_chunks_follow_the_content():
    rng = random.Random(3)
    passage = "".join(rng.choice("abcdefgh é") for _ in range(20_000))
    found = []
    for head in ("", "x", "some other words before " * 50):
        raw = (head + passage).encode()
        (ends,) = chunk_bpe.chunk_ends(np.frombuffer(raw, np.uint8), np.array([0, len(raw)]))
        assert ends[-1] == len(raw) and all(raw[: e].decode() is not None for e in ends)
        found.append({raw[a:b] for a, b in zip([0, *ends[:-1]], ends, strict=True)})
    assert len(found[0] & found[1] & found[2]) > 0.7 * len(found[0])
