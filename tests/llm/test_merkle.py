"""The Merkle manifest against its plain version."""

import random

import brute
import pytest

from quillmesh.llm import merkle

SCHEMA = "doc_id long, source string, lang string, n_chars long, text string, part long, pos long, node string"
NAMES = ["doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified"]


def documents():
    rng = random.Random(12)
    rows = []
    for i in range(400):
        source = rng.choice(["hot"] * 6 + [None, "a", "B", "é", "\U0001f600", "\uffff", "", *(f"s{k}" for k in range(9))])
        text = rng.choice([None, "", "one line", f"two\nlines {i}", "ends\n", "\n"])
        rows.append((i - 5, source, rng.choice(["en", None]), rng.choice([None, i]), text))
    rows += [(None, "hot", "en", 1, "no\nid"), (None, None, None, None, None), (7, "hot", "en", 1, "x\ny"), (7, "hot", "en", 1, "x\ny")]
    rows += [(2**62 + 1, "big", "en", 1, "a\nb"), (2**62 + 3, "hot", "en", 1, "a\nb" * 50_000), (None, "big", "en", 1, "z")]
    return rows


def got_rows(spark, rows, **how):
    out = merkle.merkle_manifest(spark.createDataFrame([(*r, 1, 2, "x") for r in rows], SCHEMA).repartition(5), **how)
    assert out.columns == NAMES
    return sorted((tuple(r) for r in out.collect()), key=repr)


@pytest.mark.parametrize("height", [1, 2, 7])
def test_merkle(spark, height):
    rows = documents()
    got = got_rows(spark, rows, height=height)
    assert got == sorted(brute.merkle(rows), key=repr)
    assert 0 < sum(not r[-1] for r in got) < len(got)


def test_merkle_edges(spark):
    assert got_rows(spark, []) == []
    for rows in ([(2, None, None, None, "a\nb")], [(1, "a", "en", 3, "x"), (2, "b", "en", 3, "y")], [(i, "a", "en", 3, "x\n") for i in range(4)]):
        assert got_rows(spark, rows) == sorted(brute.merkle(rows), key=repr)
