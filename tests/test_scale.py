"""Hot keys, task counts and sequential rules against brute force."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import messages, ordered, vectors
from quillmesh.sources import manifest


def brute_clamp(msgs, budget):
    cost = lambda m: ((len(m[1]) + 3) // 4 if m[1] else 0) + 3
    if sum(map(cost, msgs)) <= budget:
        return [(t, x) for t, x in msgs]
    kept, used = [], 0
    for turn, text in reversed(msgs):
        if used + cost((turn, text)) <= budget:
            kept.append((turn, text))
            used += cost((turn, text))
        elif budget - used > 8:
            kept.append((turn, text[-(budget - used) * 4 :]))
            used = budget
        if used >= budget:
            break
    return kept[::-1]


def test_clamp_equals_the_fold(spark):
    rnd = random.Random(7)
    convs = {c: [(i, "x" * rnd.choice([0, 1, 4, 9, 17, 40, 200])) for i in range(rnd.randint(1, 40))] for c in range(150)}
    rows = [(c, t, "user", x) for c, ms in convs.items() for t, x in ms]
    df = spark.createDataFrame(rows, "conv_id bigint, turn bigint, role string, text string")
    for budget in (5, 12, 30, 64, 500):
        got = {}
        for r in messages.clamp_to_budget(df, budget).collect():
            got.setdefault(r["conv_id"], []).append((r["turn"], r["text"]))
        for c, ms in convs.items():
            assert sorted(got.get(c, [])) == sorted(brute_clamp(ms, budget)), (c, budget)


def test_hot_key_running_values(spark):
    rows = [("hot" if i % 3 else f"k{i}", i, i % 7 if i % 5 == 0 else None) for i in range(6000)]
    df = spark.createDataFrame(rows, "k string, i bigint, v bigint").withColumn("s", F.floor(F.col("i") / 100)).withColumn("one", F.lit(1))
    got = {r["i"]: (r["n"], r["last"]) for r in ordered.carry_last(ordered.running_sum(df, ["k"], "s", ["i"], "one", "n"), ["k"], "s", ["i"], "v", "last").collect()}
    n, last = {}, {}
    for k, i, v in rows:
        n[k] = n.get(k, 0) + 1
        last[k] = v if v is not None else last.get(k)
        assert got[i] == (n[k], last[k])


def test_rank_limit_runs_before_the_shuffle(spark):
    df = spark.range(1000).withColumn("k", F.col("id") % 2)
    plan = ordered.top_n(df, ["k"], ["id"], 3)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("WindowGroupLimit") == 2


def test_parts_do_not_depend_on_tasks(spark):
    df = spark.range(2000).select((F.col("id") / 500).cast("bigint").alias("s"), "id", F.repeat(F.lit("x"), (F.col("id") % 90).cast("int")).alias("v"))
    runs = []
    for n in ("1", "8"):
        spark.conf.set("spark.sql.shuffle.partitions", n)
        parts = manifest.assign_parts(df, "s", "id", "v", 1000)
        runs.append({r["seq"]: r["part"] for r in parts.collect()})
        index = manifest.parts_index(parts)
        assert index.where("bytes > 1000").count() == 0 and index.agg(F.sum("lines")).first()[0] == 2000
    spark.conf.set("spark.sql.shuffle.partitions", "8")
    assert runs[0] == runs[1]


def test_vector_blocks_are_exact(spark, monkeypatch):
    rnd = random.Random(1)
    vecs = [(i, [rnd.random() for _ in range(4)]) for i in range(60)]
    df = spark.createDataFrame(vecs, "vec_id bigint, embedding array<float>")
    q = df.select(F.col("vec_id").alias("query_id"), "embedding")
    whole = vectors.vector_topk(q, df, 3).collect()
    near = lambda rows: sorted((r["query_id"], r["rank"], r["vec_id"], round(r["score"], 9)) for r in rows)
    assert near(vectors.vector_topk(q, df, 3, query_blocks=4, vector_blocks=7).collect()) == near(whole)
    for metric in ("cosine", "l2"):
        monkeypatch.setattr(vectors, "CHUNK", 1024)
        one = near(vectors.vector_topk(q, df, 3, metric, vector_blocks=2).collect())
        monkeypatch.setattr(vectors, "CHUNK", 7)
        assert near(vectors.vector_topk(q, df, 3, metric, vector_blocks=2).collect()) == one
    assert all(r["query_id"] == r["vec_id"] for r in whole if r["rank"] == 1)


def test_findings_read_the_documents_once(spark):
    from quillmesh.plans import QUERIES

    plan = QUERIES["wrap_records"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") == 1
    plan = QUERIES["reduce_family"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 2


def test_searches_and_ranks_start_no_job_before_the_write(spark):
    from quillmesh.operators import search

    docs = spark.createDataFrame([(1, "a b a"), (2, "b c"), (3, None)], "id bigint, text string")
    tracker = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("plan", "plan")
    out = search.search_bm25(search.build_text_index(docs, "id", ["text"]), "A c", 2)
    assert not tracker.getJobIdsForGroup("plan")
    assert [r["id"] for r in out.collect()] == [1, 2] or {r["id"] for r in out.collect()} == {1, 2}
    spark.sparkContext.setJobGroup("", "")


def test_index_upsert_joins_aggregates(spark):
    from quillmesh.plans.store import EMPTY, updates
    from quillmesh.plans.registry import Tables
    from quillmesh.operators import store

    u = updates(Tables(spark, "/root/testdata/sf0.001"))
    plan = store.upsert_index(spark.createDataFrame([], EMPTY), u)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan parquet") <= 3
