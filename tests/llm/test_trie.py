"""The conversation prefix trie against its plain version."""

import random

import brute
import pytest

from quillmesh.llm import prefix_trie

SCHEMA = "conv_id long, turn long, role string, text string, least long, n long, part long"
NAMES = ["conv_id", "depth", "parent_conv_id", "n_convs", "n_children", "n_leaves", "saved_tokens", "ends_sha256"]


def conversations():
    """Shared first turns, copies, turnless results, nulls, ties, repeated rows, long ones that part late."""
    rng = random.Random(11)
    talk = ["hi", "hello", "", None, "wie geht es", "fine 😀"]
    rows = []
    for c in [*range(90, 130), *range(200, 260), 305, 377, 1001, 5040, -7, -207, None]:
        for t in range(rng.randint(1, 6)):
            rows.append((c, t, rng.choice(["user", None]), rng.choice(talk)))
    for c in (400, 401, 402, 450, 451):  # one long talk, parting at turns that lie in other blocks
        part = rng.choice([3, 9, 63, 64, 65, 100, 128, 180])
        rows += [(c, t, "user", f"turn {t}" if t < part or t > part + 40 else f"own {c} {t}") for t in range(200)]
    rows += [(c, t, "user", f"turn {t}") for c in (470, 471, 472) for t in range(rng.randint(120, 140))]
    rows += [(210, None, "user", "first"), (210, None, None, None), (211, 2, "user", "tie"), (211, 2, "user", "tie"), (211, 2, "bot", "tie")]
    rows += [(c, 0, "user", "the same") for c in range(600, 690)]
    rng.shuffle(rows)
    return rows


def got_rows(spark, rows, parts=7):
    frame = spark.createDataFrame([(*r, 1, 2, 3) for r in rows], SCHEMA).repartition(parts)
    out = prefix_trie.conversation_trie(frame)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=repr)


def test_trie(spark):
    rows = conversations()
    want = sorted(brute.trie(rows), key=repr)
    assert got_rows(spark, rows) == want
    assert max(d for _, d, *_ in want) > 190 and len({r[-1] for r in want}) > 50


@pytest.mark.parametrize(("block", "stretch", "ids"), [(2, 1, 3), (4, 8, 1)])
def test_trie_in_small_blocks(spark, monkeypatch, block, stretch, ids):
    monkeypatch.setattr(prefix_trie, "BLOCK", block)
    monkeypatch.setattr(prefix_trie, "STRETCH", stretch)
    monkeypatch.setattr(prefix_trie, "ID_BLOCK", ids)
    monkeypatch.setattr(prefix_trie.prefix_names, "__defaults__", (block,))
    rows = [r for r in conversations() if r[0] in (None, 400, 402, 450, 470, 471, 210, 211, 305, 1001, -7) or 90 <= (r[0] or 0) < 130 or (r[0] or 0) >= 600]
    assert got_rows(spark, rows) == sorted(brute.trie(rows), key=repr)


def test_trie_edges(spark):
    assert got_rows(spark, []) == []
    assert got_rows(spark, [(None, 1, "user", "x")]) == []
    bare = [(c, 0, "user", "x") for c in (101, 102, 103, 104, 105, 106, 107)]  # no conversation 100 to start with
    assert got_rows(spark, bare) == sorted(brute.trie(bare), key=repr)
    one = [(100, 5, None, "x" * 100_000)]
    assert got_rows(spark, one) == sorted(brute.trie(one), key=repr)
