"""Round trips through files, and streams against their batch twins."""

from pyspark.sql import functions as F

from quillmesh.operators import search
from quillmesh.plans.registry import Tables
from quillmesh.plans.store import EMPTY, updates
from quillmesh.sources import eventlog, files, manifest
from quillmesh.streaming import flows
from quillmesh.operators import store

SF = "/root/testdata/sf0.001"


def rows(df):
    return sorted(map(repr, df.select(*sorted(df.columns)).collect()))


def test_read_files(spark, tmp_path):
    for p, b in {"a/x.py": b"1", "a/.git/y.py": b"2", "b/z.txt": b"\xff3", "Thumbs.db": b"4"}.items():
        (tmp_path / p).parent.mkdir(parents=True, exist_ok=True)
        (tmp_path / p).write_bytes(b)
    got = files.read_files(spark, str(tmp_path), include=["*.py", "*.txt"], segments=[".git"])
    assert sorted(r["path"] for r in got.collect()) == ["a/x.py", "b/z.txt"]
    assert files.with_text(got).where("path = 'b/z.txt'").first()["text"] == "�3"


def test_manifest_round_trip(spark, tmp_path):
    t = Tables(spark, SF)
    lines = t.files.select(F.lit(0).alias("s"), "doc_id", F.to_json(F.struct(F.lit("Doc-Item").alias("kind"), "path")).alias("v"))
    parts = manifest.assign_parts(lines, "s", "doc_id", "v", 2000)
    manifest.write_parts(parts, str(tmp_path / "m"))
    back = manifest.read_manifest(spark, str(tmp_path / "m"))
    assert back.count() == t.files.count() and back.select("family").distinct().collect()[0][0] == "doc_item"


def test_event_log(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"ts":"2024-01-01T00:00:00Z","run_id":"r","type":"phase","phase":"p","event":"begin"}\n{broken\n')
    log = eventlog.read_event_log(spark, str(tmp_path))
    assert log.where("run_id = 'r'").count() == 1
    assert eventlog.read_event_log(spark, str(tmp_path), streaming=True).isStreaming


def stream(spark, folder):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.repartition(3).write.mode("overwrite").parquet(str(folder))
    return e, flows.stream_events(spark, str(folder), e.schema, "10 minutes", fmt="parquet", max_files=1)


def run(df, name, mode="append"):
    q = df.writeStream.format("memory").queryName(name).outputMode(mode).trigger(availableNow=True).start()
    q.awaitTermination(120)
    return df.sparkSession.table(name)


def test_stream_counts(spark, tmp_path):
    e, s = stream(spark, tmp_path / "in")
    got = run(flows.event_counts(s, ["event_type"], "1 day"), "counts", "complete")
    assert rows(got) == rows(flows.event_counts(e, ["event_type"], "1 day"))


def test_stream_dedup(spark, tmp_path):
    e = spark.read.parquet(f"{SF}/events.parquet").withColumn("ts", F.col("ts").cast("timestamp"))
    e.union(e).coalesce(1).write.parquet(str(tmp_path / "in"))
    s = flows.stream_events(spark, str(tmp_path / "in"), e.schema, "10 minutes", fmt="parquet")
    assert run(flows.stream_dedup(s, ["event_id"]), "dedup").count() == e.count()


def test_stream_upsert_equals_batch(spark, tmp_path):
    t = Tables(spark, SF)
    u = updates(t)
    u.repartition(3).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.start_upserts(s, str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination(120)
    base = spark.createDataFrame([], EMPTY)
    got = flows.compact_index(spark, base, str(tmp_path / "ix"), 1)
    assert rows(got) == rows(store.upsert_index(base, u))
    again = flows.compact_index(spark, got, str(tmp_path / "ix"), 2, base_version=1)
    assert rows(again) == rows(got) == rows(flows.read_index(spark, got, str(tmp_path / "ix"), 1))


def test_stream_phase_pairs(spark, tmp_path):
    data = [("r", "p", "begin", None, 0), ("r", "p", "end", "ok", 5), ("r", "p", "begin", None, 100), ("r", "p", "end", "ok", 103), ("r", "q", "begin", None, 1)]
    df = spark.createDataFrame(data, "run_id string, phase string, event string, status string, s int").withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(flows.phase_pairs(s, late="1 minute"), "pairs")
    assert [(r["phase"], r["dur_ms"]) for r in got.orderBy("dur_ms").collect()] == [("p", 3000), ("p", 5000)]


def test_stream_phase_pairs_break_ties_as_batch(spark, tmp_path):
    data = [("begin", 0, 1), ("end", 5, 2), ("begin", 5, 3), ("end", 9, 4)]  # an end and the next begin at one time
    df = spark.createDataFrame([("r", "p", e, "ok", n, s) for e, n, s in data], "run_id string, phase string, event string, status string, s int, seq long")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s")
    df.write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(df.schema).parquet(str(tmp_path / "in"))
    got = run(flows.phase_pairs(s, late="1 minute"), "ties")
    assert sorted(r["dur_ms"] for r in got.collect()) == sorted(r["dur_ms"] for r in flows.phase_pairs(df).collect()) == [4000, 5000]


def test_stream_lock_expiry(spark, tmp_path):
    def land(i, data):
        df = spark.createDataFrame(data, "lock_name string, action string, holder string, s int, ttl_seconds int")
        df = df.withColumn("event_time", F.timestamp_seconds(F.col("s") + 1_700_000_000)).drop("s").coalesce(1)
        df.write.mode("append").parquet(str(tmp_path / "in"))
        return df.schema

    schema = land(0, [("a", "acquire", "h1", 0, 60), ("b", "acquire", "h2", 0, 60), ("b", "release", "h2", 30, 60)])
    s = spark.readStream.schema(schema).parquet(str(tmp_path / "in")).withWatermark("event_time", "0 seconds")
    out = flows.stream_lock_expiry(s)
    q = out.writeStream.format("memory").queryName("locks").outputMode("append").option("checkpointLocation", str(tmp_path / "ck")).start()
    q.processAllAvailable()
    land(1, [("c", "acquire", "h3", 500, 60)])
    q.processAllAvailable()
    q.stop()
    got = {(r["lock_name"], r["state"]) for r in spark.table("locks").collect()}
    assert got == {("a", "held"), ("b", "held"), ("b", "free"), ("a", "expired"), ("c", "held")}


def test_stream_text_index(spark, tmp_path):
    docs = spark.createDataFrame([(1, "old words"), (2, "keep")], "id bigint, text string")
    ch = spark.createDataFrame([(1, "update", 1, "mid"), (1, "update", 2, "new text"), (3, "insert", 3, "third"), (2, "delete", 4, "")], "id bigint, op string, seq bigint, text string")
    ch.repartition(2).write.parquet(str(tmp_path / "in"))
    s = spark.readStream.schema(ch.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    flows.start_text_index(s, ["text"], str(tmp_path / "ix"), str(tmp_path / "ck")).awaitTermination(120)
    ix = flows.read_text_index(spark, search.build_text_index(docs, "id", ["text"]), ["text"], str(tmp_path / "ix"))
    assert sorted(r["term"] for r in ix.collect()) == ["new", "text", "third"]
