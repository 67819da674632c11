"""Registered operator queries against their SQL, and the pipeline against its plain version."""

import brute
import pytest
from oracle import compare, connect
from test_operators import ROWS, check_bins

from quillmesh.llm import packing, queries, token_counts
from quillmesh.llm.oracles import ORACLES
from quillmesh.llm.queries import QUERIES

FOLDER = "/root/testdata/sf0.001"


def test_every_operator_has_a_query():
    assert sorted(int(n.split("_")[0][2:]) for n in QUERIES) == list(range(1, 14))


@pytest.mark.parametrize("name", sorted(ORACLES))
def test_sql(spark, name):
    assert compare(spark, connect(FOLDER), name, QUERIES[name], ORACLES[name], FOLDER) is None


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rows = [r for r in ROWS if r[0] is not None and r[0] != 305]
    frame = spark.createDataFrame([(d, t, "en", s, len(t or "")) for d, t, s in rows], "doc_id long, text string, lang string, source string, n_chars long")
    frame.repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    kept = [r for r in rows if brute.quality(r[1])[-1]]
    texts = dict(brute.line_dedup([(d, t) for d, t, _ in kept]))
    kept = [(d, texts[d], s) for d, _, s in kept]
    least = set(brute.one_of_similar([(d, t) for d, t, _ in kept]))
    kept = [r for r in kept if r[0] in least]
    copies = brute.mix(kept)
    tok = token_counts.tokenizer(queries.tokenizer_path("word_bpe_49k.json"))
    want = sorted((d, len(tok.encode(t, add_special_tokens=False).ids) + 1) for (d, t, s), n in copies.items() for _ in range(n))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    check_bins(got, queries.SEQUENCE_TOKENS)
    assert sorted((r.doc_id, r.length) for r in got) == want and 20 < len(want)
    assert packing.plan_bins({}, 8).shape == (0, 5)
    docs = spark.read.parquet(f"{tmp_path}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == frame.columns, name
