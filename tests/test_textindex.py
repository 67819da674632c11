"""The stored index against scoring everything."""

import math
import random
import re

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import search, textindex

WORDS = [f"w{i}" for i in range(60)]


@pytest.fixture(scope="module")
def postings(spark):
    rng = random.Random(2)
    weights = [1 / (i + 1) for i in range(len(WORDS))]
    docs = [(i, " ".join(rng.choices(WORDS, weights, k=rng.choice([3, 10, 40, 200])))) for i in range(700)]
    docs += [(1000 + i, "w3 w59 w59") for i in range(30)] + [(2000, "only"), (2001, "Ünïque only")]
    return search.build_text_index(spark.createDataFrame(docs, "id long, text string"), "id", ["text"]).cache()


@pytest.fixture(scope="module")
def folder(postings, tmp_path_factory):
    out = str(tmp_path_factory.mktemp("index") / "ix")
    textindex.write_index(postings, out, buckets=16, size=32)
    return out


TEXTS = ["w0", "w3 w59", "w1 w2 w40 w41", "unique ONLY", "nothing here", "", " ".join(WORDS), "w59 w59 w58 nothing"]


@pytest.mark.parametrize("k", [1, 5, 40])
def test_equal_to_full_scoring(spark, postings, folder, k):
    queries = spark.createDataFrame(list(enumerate(TEXTS)), "query_id long, text string")
    got = textindex.search_index(spark, folder, queries, k, buckets=16).orderBy("query_id", "rank").collect()
    for i, text in enumerate(TEXTS):
        want = [(r.id, r.score) for r in search.search_bm25(postings, text, k).collect()]
        assert [(r.id, round(r.score, 6)) for r in got if r.query_id == i] == want, text


def test_blocks_and_buckets_are_skipped(spark, folder):
    queries = spark.createDataFrame([(0, "w40 w41"), (1, "w59 w3")], "query_id long, text string")
    heads, open_ = textindex.candidate_slices(spark, folder, queries, 3, buckets=16)
    assert 0 < open_.count() < 0.6 * heads.count()
    out = textindex.search_index(spark, folder, queries, 3, buckets=16)
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert re.search(r"blocks\], PartitionFilters: \[.*bucket#\d+", plan) or re.search(r"PartitionFilters: \[(isnotnull\(bucket#\d+\), )?bucket#\d+", plan)
    assert out.count() == 6


def test_rows_are_bounded(spark, folder):
    assert spark.read.parquet(f"{folder}/blocks").agg(F.max(F.size("postings"))).first()[0] <= 32


def test_empty_index(spark, postings, tmp_path):
    textindex.write_index(postings.limit(0), str(tmp_path / "ix"))
    queries = spark.createDataFrame([(0, "w40")], "query_id long, text string")
    assert textindex.search_index(spark, str(tmp_path / "ix"), queries, 3).count() == 0


def test_postings_of_one_id_add_up(spark, tmp_path):
    rows = [(1, "a", 1), (1, "a", 2), (1, "b", 1), (2, "a", 1), (2, "c", 7), (3, "d", 1)]
    textindex.write_index(spark.createDataFrame(rows, "id long, term string, tf long"), str(tmp_path / "ix"))
    blocks = spark.read.parquet(str(tmp_path / "ix/blocks"))
    got = {r.term: ([(p.id, p.tf, p.len) for p in r.postings], r.n) for r in blocks.collect()}
    assert got == {"a": ([(1, 3, 4), (2, 1, 8)], 2), "b": ([(1, 1, 4)], 1), "c": ([(2, 7, 8)], 1), "d": ([(3, 1, 1)], 1)}


def test_postings_are_not_shuffled_one_by_one(spark, folder):
    """A query's parts of a document's score are added in the task that cuts the rows of its slice."""
    queries = spark.createDataFrame([(0, "w40 w41"), (1, "w59 w3")], "query_id long, text string")
    plan = textindex.search_index(spark, folder, queries, 3, buckets=16)._jdf.queryExecution().executedPlan().toString()
    above = plan.split("== Initial Plan ==")[-1].partition("Generate inline(postings")[0]
    assert above.count("Exchange") == 1  # the ranks of the best


def test_terms_are_the_runs_of_letters_and_digits(spark):
    rng = random.Random(5)
    texts = [None, "", " ", "a", " a-b ", "ÀÉ 9x", "á e", "\U0001d400\U0001f600z", *("".join(rng.choices("aZ9é_ -\n\t٣中́\U0001f600", k=rng.randint(1, 15))) for _ in range(300))]
    df = spark.createDataFrame([(x,) for x in texts], "text string")
    split = F.filter(F.split(search.fold("text"), r"[^\p{L}\p{N}]+"), lambda t: t != "")
    assert all(r[0] == r[1] for r in df.select(search.terms_of("text"), split).collect())


def test_bm25_cuts_each_text_once_and_takes_odd_input(spark):
    seen = spark.sparkContext.accumulator(0)

    def read(text):
        seen.add(1)
        return text

    rows = [(i, x) for i, x in enumerate(["a b b", "b c", None, "", "b", "a a c d", "e", "e b", "f g"])]
    docs = spark.createDataFrame(rows, "id long, text string").select("id", F.udf(read, "string")("text").alias("text"))
    found = search.search_bm25(search.build_text_index(docs, "id", ["text"]), "a c B", 9).collect()
    assert seen.value == len(rows)
    words = {i: x.split() for i, x in rows if x}
    n, avg = len(words), sum(map(len, words.values())) / len(words)

    def part(term, own):
        df, tf = sum(term in w for w in words.values()), own.count(term)
        idf = math.log((n - df + 0.5) / (df + 0.5))
        return (idf if idf > 0 else search.MIN_IDF) * tf * (search.K1 + 1) / (tf + search.K1 * (1 - search.B + search.B * len(own) / avg))

    want = {i: sum(part(t, w) for t in "abc") for i, w in words.items() if set(w) & set("abc")}
    assert [r.id for r in found] == sorted(want, key=lambda i: (-round(want[i], 6), i))
    assert [r.score for r in found] == pytest.approx(sorted(want.values(), reverse=True), abs=2e-6)
    for text, df in (("zz", docs), ("", docs), ("a", docs.limit(0))):
        assert search.search_bm25(search.build_text_index(df, "id", ["text"]), text, 3).collect() == []
    twice = spark.createDataFrame([(1, "a"), (1, "a b"), (None, "a c"), (None, "c")], "id long, text string")
    assert {r.id for r in search.search_bm25(search.build_text_index(twice, "id", ["text"]), "a", 3).collect()} == {1, None}  # a row each
