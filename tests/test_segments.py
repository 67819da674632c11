"""The segmented index against one index of all changes."""

import random
import shutil

from pyspark.sql import functions as F

from quillmesh.operators import search
from quillmesh.operators.ordered import latest_version
from quillmesh.streaming import segments

SCHEMA = "id long, op string, seq long, text string"


def batches(n):
    rng, seq, out = random.Random(4), 0, []
    for b in range(n):
        rows = []
        for _ in range(rng.randint(1, 12)):
            seq += 1
            late = seq if rng.random() < 0.8 else rng.randint(1, seq)  # some changes arrive late
            rows.append((rng.randint(0, 15), rng.choice(["insert", "update", "delete"]), late * 1000 + seq, f"w{rng.randint(0, 5)} b{b} w1"))
        out.append(rows)
    return out


def wanted(spark, rows, base=None):
    changes = latest_version(spark.createDataFrame(rows, SCHEMA), ["id"], [F.desc("seq")])
    base = spark.createDataFrame([], "id long, col string, term string, tf long") if base is None else base
    return content(search.maintain_text_index(base, changes, ["text"]))


def content(df):
    return sorted(map(tuple, df.select("id", "col", "term", "tf").collect()))


def test_segments_equal_batch_and_stay_few(spark, tmp_path):
    folder, done, sizes = str(tmp_path / "ix"), [], []
    for n, rows in enumerate(batches(17)):
        frame = spark.createDataFrame(rows, SCHEMA)
        live = segments.add_segment(frame, ["text"], folder, n, fan=2)
        done += rows
        sizes.append(len(live))
        if n in (3, 9):  # a retried batch, its manifest lost
            shutil.rmtree(f"{folder}/manifests/batch={n}")
            assert segments.add_segment(frame, ["text"], folder, n, fan=2) == live
        if n in (0, 5, 11, 16):
            assert content(segments.read_segments(spark, folder)) == wanted(spark, done)
    assert max(sizes) <= 4 and sizes[15] == 1 and sizes[16] == 2
    before = content(segments.read_segments(spark, folder))
    assert segments.vacuum_segments(spark, folder) > 10
    assert content(segments.read_segments(spark, folder)) == before
    assert segments.live_segments(spark, folder) == [(0, 15), (16, 16)]


def test_unfinished_batches_do_not_show(spark, tmp_path):
    folder = str(tmp_path / "ix")
    first, second = batches(2)
    segments.add_segment(spark.createDataFrame(first, SCHEMA), ["text"], folder, 0)
    segments.add_segment(spark.createDataFrame(second, SCHEMA), ["text"], folder, 1)
    (tmp_path / "ix/manifests/batch=1/_SUCCESS").unlink()  # the job died while it wrote the manifest
    assert content(segments.read_segments(spark, folder)) == wanted(spark, first)


def test_stream_over_a_base(spark, tmp_path):
    for i, rows in enumerate(batches(6)):
        spark.createDataFrame(rows, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    base = search.build_text_index(spark.createDataFrame([(3, "old text"), (99, "kept text")], "id long, text string"), "id", ["text"])
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    segments.start_segments(stream, ["text"], str(tmp_path / "ix"), str(tmp_path / "ck"), fan=3).awaitTermination(120)
    got = content(segments.read_segments(spark, str(tmp_path / "ix"), base))
    assert got == wanted(spark, [r for rows in batches(6) for r in rows], base)
    assert len(segments.live_segments(spark, str(tmp_path / "ix"))) == 2


def test_postings_are_neither_hashed_nor_sorted(spark, tmp_path):
    """A batch's rows are counted in place, and changes are what is held when postings are read."""
    rows = spark.createDataFrame([(1, "b a b"), (2, ""), (None, "Élle a")], "id long, text string")
    index = search.build_text_index(rows, "id", ["text"], unique=True)
    assert sorted(map(tuple, index.select("id", "col", "term", "tf").collect()), key=repr) == [(1, "text", "a", 1), (1, "text", "b", 2), (None, "text", "a", 1), (None, "text", "elle", 1)]
    assert "Aggregate" not in index._jdf.queryExecution().executedPlan().toString()
    segments.add_segment(spark.createDataFrame(batches(1)[0], SCHEMA), ["text"], str(tmp_path / "ix"), 0)
    plan = segments.read_segments(spark, str(tmp_path / "ix"))._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin" in plan and "SortMergeJoin" not in plan
