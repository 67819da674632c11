"""The bucketed index against the index folded whole."""

import random
from pathlib import Path

from pyspark.sql import functions as F

from quillmesh.operators import store
from quillmesh.plans.store import EMPTY
from quillmesh.streaming import buckets

SCHEMA = "filepath string, symbol_type string, name string, lineno long, unique_key_hash string, description string, status string, seen_at timestamp, seq long"


def updates(spark, seed, n, keys):
    rng, rows = random.Random(seed), []
    for i in range(n):
        k = rng.randrange(keys)
        name = rng.choice([f"n{k}", f"n{k}", None])
        # a hash may come under another path: the update then finds its row by the hash
        path = f"p\\{k}" if rng.random() < 0.8 else f"moved/{k}"
        rows.append((path, "f", name, k, rng.choice([f"h{k}", f"h{k}", None]), rng.choice(["", "Bad docstring", f"text {i}" * rng.randint(1, 3)]), rng.choice(["", "todo"]), 1_700_000_000 + seed * 1000 + i, seed * 1000 + i))
    frame = spark.createDataFrame(rows, SCHEMA.replace("seen_at timestamp", "seen_at long"))
    return frame.withColumn("seen_at", F.timestamp_seconds("seen_at"))


def content(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def land(frame, folder, n):
    frame.write.parquet(f"{folder}/deltas/batch={n}")


def test_buckets_equal_the_whole_index(spark, tmp_path):
    folder = str(tmp_path / "ix")
    want = spark.createDataFrame([], EMPTY)
    buckets.create_buckets(want, folder, 8)
    assert buckets.read_buckets(spark, folder).count() == 0
    for n in range(3):
        batch = updates(spark, n, 40, 60)
        land(batch, folder, n)
        want = spark.createDataFrame(store.upsert_index(want, batch).collect(), EMPTY)
        assert content(buckets.read_buckets(spark, folder)) == content(want)  # not compacted yet
        assert buckets.compact_buckets(spark, folder) == n + 1
        assert content(buckets.read_buckets(spark, folder)) == content(want)
    assert buckets.compact_buckets(spark, folder) == 3  # nothing new landed
    assert sum(r.occurrences for r in buckets.read_buckets(spark, folder).collect()) == 120


def test_untouched_buckets_stay_and_a_dead_compaction_counts_once(spark, tmp_path):
    folder = tmp_path / "ix"
    buckets.create_buckets(spark.createDataFrame([], EMPTY), str(folder), 16)
    land(updates(spark, 1, 200, 100), str(folder), 0)
    buckets.compact_buckets(spark, str(folder))
    before = {f: f.stat().st_mtime_ns for f in Path(folder / "rows").rglob("*.parquet")}
    one = updates(spark, 2, 3, 1).withColumn("filepath", F.lit("p/0")).withColumn("name", F.lit("n0")).withColumn("unique_key_hash", F.lit("h0"))
    land(one, str(folder), 1)
    buckets.compact_buckets(spark, str(folder))
    want = content(buckets.read_buckets(spark, str(folder)))
    (folder / "manifests/version=2/_SUCCESS").unlink()  # the job died while it wrote the manifest
    assert content(buckets.read_buckets(spark, str(folder))) == want
    assert buckets.compact_buckets(spark, str(folder)) == 2
    assert content(buckets.read_buckets(spark, str(folder))) == want
    assert {f: f.stat().st_mtime_ns for f in before} == before
    assert len({f.parent for f in Path(folder / "rows/version=2").rglob("*.parquet")}) <= 3
