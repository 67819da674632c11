"""Streams over append-only logs: counts, dedup, upserts, pairs, lock expiry, text index."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from ..functions.misc import expires_at
from ..operators import search, store
from ..operators.ordered import latest_version, phase_durations

def stream_events(spark: SparkSession, path: str, schema: StructType | str, late: str, ts: str = "ts", fmt: str = "json", max_files: int = 1000) -> DataFrame:
    """A folder of event files as a stream; rows more than ``late`` behind the newest time are dropped."""
    raw = spark.readStream.schema(schema).option("maxFilesPerTrigger", max_files).format(fmt).load(path)
    return raw.withColumn(ts, F.col(ts).cast("timestamp")).withWatermark(ts, late)


def event_counts(events: DataFrame, keys: Sequence[str], width: str, ts: str = "ts") -> DataFrame:
    """Events per tumbling window and key; the same function in batch and stream."""
    g = events.groupBy(F.window(F.col(ts).cast("timestamp"), width), *keys).agg(F.count("*").alias("n"))
    return g.select(F.col("window.start").alias("window_start"), *keys, "n")


def stream_dedup(events: DataFrame, keys: Sequence[str] = ("fp",)) -> DataFrame:
    """First record per fingerprint within the watermark."""
    return events.dropDuplicatesWithinWatermark(list(keys))


def batch_dedup(events: DataFrame, keys: Sequence[str], order: Sequence) -> DataFrame:
    from ..operators.ordered import first_seen

    return first_seen(events, list(keys), list(order))


def start_upserts(updates: DataFrame, folder: str, checkpoint: str, once: bool = True) -> StreamingQuery:
    """Each micro-batch lands in its own folder, named by batch id.

    A retried batch overwrites its folder, so a batch counts once. The index itself is
    only rewritten by ``compact_index``.
    """
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.write.mode("overwrite").parquet(f"{folder}/deltas/batch={batch_id}")

    w = updates.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint)
    return (w.trigger(availableNow=True) if once else w).start()


def _unfolded(spark: SparkSession, folder: str, version: int | None) -> DataFrame:
    """Landed batches that the given version of the base does not hold yet."""
    deltas = spark.read.parquet(f"{folder}/deltas")
    if version is None:
        return deltas
    folded = spark.read.parquet(f"{folder}/folded/version={version}").first()["batch"]
    return deltas.where(F.col("batch") > folded)


def read_index(spark: SparkSession, base: DataFrame, folder: str, version: int | None = None) -> DataFrame:
    """The base index, of the given version, with every batch folded in that landed after it."""
    return store.upsert_index(base, _unfolded(spark, folder, version).drop("batch"))


def compact_index(spark: SparkSession, base: DataFrame, folder: str, version: int, base_version: int | None = None) -> DataFrame:
    """Write the folded index as a new version and read it back.

    ``base_version`` is the version ``base`` was compacted to, None for an index without landed batches. The
    last folded batch is written beside each version, after it: a batch counts once, whatever is retried.
    """
    out = f"{folder}/base/version={version}"
    rest = _unfolded(spark, folder, base_version)
    last = rest.agg(F.max("batch")).first()[0]
    if last is None:
        last = -1 if base_version is None else spark.read.parquet(f"{folder}/folded/version={base_version}").first()["batch"]
    rest = rest.where(F.col("batch") <= last)
    store.upsert_index(base, rest.drop("batch")).write.mode("overwrite").parquet(out)
    spark.range(1).select(F.lit(last).cast("bigint").alias("batch")).write.mode("overwrite").parquet(f"{folder}/folded/version={version}")
    return spark.read.parquet(out)


PAIR_OUTPUT = "run_id string, phase string, begin_ts timestamp, end_ts timestamp, status string, dur_ms bigint"


def phase_pairs(events: DataFrame, within_s: int = 86_400, late: str | None = None, order: Sequence[str] = ("seq",)) -> DataFrame:
    """Each end of a phase with the latest begin that is open in its run, not longer than ``within_s`` ago.

    In batch these are the closed rows of ``phase_durations``. On a stream, watermarked here if ``late`` is
    given, the state of a (run, phase) is its open begins; an end pairs with one of them and no other. Events of one
    time come in the ``order`` columns' order, as in batch, or begins first if there are none.
    """
    if not events.isStreaming:
        closed = phase_durations(events, order).where(F.col("end_ts").isNotNull() & (F.col("dur_ms") <= within_s * 1000))
        return closed.select("run_id", "phase", "begin_ts", "end_ts", "status", "dur_ms")
    watched = events.withWatermark("ts", late) if late else events
    ties = [c for c in order if c in events.columns] or ["event"]

    def step(key, batches, state):
        import pandas as pd

        begins = list(state.get[0]) if state.exists else []
        rows = []
        if state.hasTimedOut:
            state.remove()
        else:
            now = pd.concat(list(batches)).sort_values(["ts", *ties], kind="stable")
            for r in now.itertuples(index=False):
                us = int(r.ts.value // 1000)
                if r.event == "begin":
                    begins.append(us)
                elif r.event == "end" and begins:
                    start = begins.pop()
                    if us - start <= within_s * 1_000_000:
                        rows.append((*key, pd.Timestamp(start, unit="us"), r.ts, "error" if r.status == "error" else "ok", (us - start) // 1000))
            if begins:
                state.update((begins,))
                state.setTimeoutTimestamp(max(begins[-1] // 1000 + within_s * 1000, state.getCurrentWatermarkMs() + 1))
            elif state.exists:
                state.remove()
        yield pd.DataFrame(rows, columns=["run_id", "phase", "begin_ts", "end_ts", "status", "dur_ms"])

    return watched.groupBy("run_id", "phase").applyInPandasWithState(step, PAIR_OUTPUT, "begins array<bigint>", "append", "EventTimeTimeout")


def lock_states(events: DataFrame, now, ttl: str = "ttl_seconds") -> DataFrame:
    """Batch form: newest event per lock and whether the lock is free, held or expired."""
    last = latest_version(events, ["lock_name"], [F.desc("event_time"), F.desc("id")])
    until = expires_at("event_time", ttl)
    state = F.when(F.col("action") != "acquire", "free").when(until <= now, "expired").otherwise("held")
    return last.select("lock_name", "holder", "action", "event_time", until.alias("expires_at"), state.alias("state"))


LOCK_OUTPUT = "lock_name string, holder string, event_time timestamp, state string"
LOCK_STATE = "holder string, since timestamp, until timestamp"


def stream_lock_expiry(events: DataFrame) -> DataFrame:
    """Held, released and expired locks as they happen, by event time.

    Input: lock_name, action, holder, event_time (watermarked), ttl_seconds. State per
    lock is one row; an event-time timeout fires when a lock outlives its ttl.
    """
    def step(key, batches, state):
        import pandas as pd

        rows = []
        held = state.get if state.exists else None
        if state.hasTimedOut:
            rows.append((key[0], held[0], held[2], "expired"))
            state.remove()
        else:
            events_now = pd.concat(list(batches)).sort_values("event_time")
            for r in events_now.itertuples(index=False):
                if held and held[2] <= r.event_time:
                    rows.append((key[0], held[0], held[2], "expired"))
                    held = None
                if r.action == "acquire":
                    held = (r.holder, r.event_time, r.event_time + pd.Timedelta(seconds=int(r.ttl_seconds)))
                    rows.append((key[0], r.holder, r.event_time, "held"))
                elif held:
                    rows.append((key[0], held[0], r.event_time, "free"))
                    held = None
            if held:
                state.update(held)
                at = max(int(pd.Timestamp(held[2]).timestamp() * 1000), state.getCurrentWatermarkMs() + 1)
                state.setTimeoutTimestamp(at)
            elif state.exists:
                state.remove()
        yield pd.DataFrame(rows, columns=["lock_name", "holder", "event_time", "state"])

    return events.groupBy("lock_name").applyInPandasWithState(step, LOCK_OUTPUT, LOCK_STATE, "append", "EventTimeTimeout")


def start_text_index(changes: DataFrame, cols: Sequence[str], folder: str, checkpoint: str) -> StreamingQuery:
    """Land text changes per micro-batch; ``read_text_index`` folds them."""
    def land(batch: DataFrame, batch_id: int) -> None:
        batch.select("id", "op", "seq", *cols).write.mode("overwrite").parquet(f"{folder}/changes/batch={batch_id}")

    return changes.writeStream.foreachBatch(land).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_text_index(spark: SparkSession, index: DataFrame, cols: Sequence[str], folder: str) -> DataFrame:
    """Postings after every landed change; the newest change per id counts."""
    changes = latest_version(spark.read.parquet(f"{folder}/changes").drop("batch"), ["id"], [F.desc("seq")])
    return search.maintain_text_index(index, changes, cols)
