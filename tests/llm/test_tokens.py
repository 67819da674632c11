"""Cut points and caches against the tokenizers, and hashes against sets, on odd texts; no Spark."""

import numpy as np
import pyarrow as pa
from hypothesis import given, settings
from hypothesis import strategies as st

from quillmesh.llm import blocks, packing, queries, token_counts

PIECES = st.sampled_from(list("aZ9.,'\"!?<|>\n\t \r\x0b\x1c\x85\xa0 　́ͅéßİſΣñÅ½٣日😀") + ["  ", "\n\n", "'ll", "'S", "<|endoftext|>", "<|startoftext|>", "word", "THE,", " the", "é", "ﬁ"])
TEXTS = st.lists(st.lists(PIECES, max_size=12).map("".join), min_size=1, max_size=6)


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_counts_of_cut_texts(texts):
    path = queries.tokenizer_path("byte_bpe_50k.json")
    data, offsets = blocks.utf8(pa.array(texts))
    starts = token_counts.pre_tokens(data, offsets)
    ends = np.append(starts[1:], len(data))[: len(starts)]
    lengths = token_counts.Lengths(path, np.zeros(0, np.uint64), np.zeros(0, np.int64)).of(data, starts, ends)
    sums = np.concatenate(([0], np.cumsum(lengths)))[np.searchsorted(starts, offsets)]
    tok = token_counts.tokenizer(path)
    assert np.diff(sums).tolist() == [len(tok.encode(t, add_special_tokens=False).ids) for t in texts]


@settings(max_examples=400, deadline=None)
@given(TEXTS)
def test_ids_of_words(texts):
    path = queries.tokenizer_path("word_bpe_49k.json")
    tok = token_counts.tokenizer(path)
    for block in blocks.blocks(pa.array(texts)):
        ids, at = packing.word_ids(path).of(block)
        assert [ids[a:b].tolist() for a, b in zip(at[:-1], at[1:])] == [tok.encode(t, add_special_tokens=False).ids for t in texts]


@settings(max_examples=200, deadline=None)
@given(TEXTS, st.integers(1, 9))
def test_windows_hash_like_their_words(texts, size):
    for block in blocks.blocks(pa.array(texts), limit=20):
        raw = block.data.tobytes()
        words = [raw[a:b] for a, b in zip(block.starts, block.ends)]
        docs = [texts[block.row + i].encode().split() for i in range(len(block.n_words))]
        assert words == [w for d in docs for w in d] and block.n_words.tolist() == [len(d) for d in docs]
        rolled, fits = blocks.window_hashes(blocks.word_hashes(block), size), blocks.inside(block, size)
        assert len(rolled) == len(fits) == max(0, len(words) - size + 1)
        seen = {}
        for i, h in enumerate(rolled.tolist()):
            assert seen.setdefault(h, words[i : i + size]) == words[i : i + size]
        assert len({tuple(words[i : i + size]) for i in range(len(rolled))}) == len(seen)


def thue_morse(n):
    return "".join("ab"[i.bit_count() % 2] for i in range(n)), "".join("ba"[i.bit_count() % 2] for i in range(n))


def test_words_that_collide_modulo_a_power_of_two():
    """Thue-Morse words of 1,024 letters have equal sums under every odd base; no hash of words may be such a sum."""
    pair = thue_morse(1024)
    data, offsets = blocks.utf8(pa.array(pair))
    assert len(set(blocks.span_hashes(data, offsets[:-1], offsets[1:]).tolist())) == 2
    small = [w for n in (1, 7, 8, 9, 64, 255, 256, 257) for w in thue_morse(n)]
    data, offsets = blocks.utf8(pa.array(small))
    assert len(set(blocks.span_hashes(data, offsets[:-1], offsets[1:]).tolist())) == len(small)
    path = queries.tokenizer_path("byte_bpe_50k.json")
    tok = token_counts.tokenizer(path)
    for word in pair:
        data, offsets = blocks.utf8(pa.array([word]))
        got = token_counts.Lengths(path, np.zeros(0, np.uint64), np.zeros(0, np.int64)).of(data, offsets[:-1], offsets[1:])
        assert got.tolist() == [len(tok.encode(word, add_special_tokens=False).ids)]
    path = queries.tokenizer_path("word_bpe_49k.json")
    (block,) = blocks.blocks(pa.array([" ".join(pair)]))
    assert packing.word_ids(path).of(block)[0].tolist() == token_counts.tokenizer(path).encode(" ".join(pair), add_special_tokens=False).ids


def test_hits_are_compared():
    """An entry of the shared table with the hash of another word is no hit."""
    path = queries.tokenizer_path("byte_bpe_50k.json")
    data, offsets = blocks.utf8(pa.array(["hello"]))
    wrong = token_counts.Lengths(path, blocks.span_hashes(data, offsets[:-1], offsets[1:]), np.array([99]), np.array([1], np.uint64))
    assert wrong.of(data, offsets[:-1], offsets[1:]).tolist() == [1]
