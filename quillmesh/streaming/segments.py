"""A text index of immutable segments, fed by a stream of changes.

Every micro-batch becomes a segment: its postings, and the ids it changed with their sequence numbers, deletions among
them. Segments are never rewritten. The live ones are listed in a manifest, written after them, one per batch;
a batch builds on the newest finished manifest before its own, so that a retried batch repeats the same steps under the
same names. When the last ``fan`` segments cover equally many batches they are merged into one, so that n batches
leave about fan * log(n) segments to read, whatever n is.

The newest change of an id counts, by sequence number and then batch; postings of older ones are dead and go in the next
merge. Deletions stay, since an older change may still arrive late.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators.ordered import latest_version
from ..operators.search import build_text_index

FAN = 4
Segment = tuple[int, int]  # the first and last batch that it covers


def _files(spark: SparkSession, path: str):
    """The file system of a path, as every executor sees it."""
    jvm = spark._jvm
    at = jvm.org.apache.hadoop.fs.Path(path)
    return at.getFileSystem(spark._jsc.hadoopConfiguration()), jvm.org.apache.hadoop.fs.Path


def _finished(spark: SparkSession, folder: str) -> list[int]:
    """The batches with a finished manifest, in order."""
    fs, path = _files(spark, folder)
    top = path(f"{folder}/manifests")
    if not fs.exists(top):
        return []
    names = [s.getPath().getName() for s in fs.listStatus(top)]
    return sorted(int(n.split("=")[1]) for n in names if n.startswith("batch=") and fs.exists(path(f"{folder}/manifests/{n}/_SUCCESS")))


def live_segments(spark: SparkSession, folder: str, before: int | None = None) -> list[Segment]:
    """The segments of the newest finished manifest, or of the newest before a batch."""
    done = [n for n in _finished(spark, folder) if before is None or n < before]
    if not done:
        return []
    rows = spark.read.parquet(f"{folder}/manifests/batch={done[-1]}").collect()  # a row per live segment
    return sorted((r["first"], r["last"]) for r in rows)


def _at(folder: str, segment: Segment, part: str) -> str:
    return f"{folder}/segments/{segment[0]}-{segment[1]}/{part}"


def _read(spark: SparkSession, folder: str, segments: Sequence[Segment], part: str) -> DataFrame:
    return spark.read.parquet(*[_at(folder, s, part) for s in segments])


def _newest(docs: DataFrame) -> DataFrame:
    """(id, seq, batch, op): the change of each id that counts."""
    best = docs.groupBy("id").agg(F.max(F.struct("seq", "batch", "op")).alias("best"))
    return best.select("id", "best.*")


def _alive(spark: SparkSession, folder: str, segments: Sequence[Segment], newest: DataFrame) -> DataFrame:
    """Postings of the changes that count. The changes are hashed, so that postings pass by and are not sorted."""
    postings = _read(spark, folder, segments, "postings")
    return postings.join(newest.where(F.col("op") != "delete").select("id", "batch").hint("shuffle_hash"), ["id", "batch"])


def _merge(spark: SparkSession, folder: str, segments: Sequence[Segment]) -> Segment:
    merged = (segments[0][0], segments[-1][1])
    _newest(_read(spark, folder, segments, "docs")).write.mode("overwrite").parquet(_at(folder, merged, "docs"))
    alive = _alive(spark, folder, segments, spark.read.parquet(_at(folder, merged, "docs")))
    alive.write.mode("overwrite").parquet(_at(folder, merged, "postings"))
    return merged


def add_segment(changes: DataFrame, cols: Sequence[str], folder: str, batch: int, fan: int = FAN) -> list[Segment]:
    """Add the changes (id, op in insert/update/delete, seq, text columns) of a batch; returns the live segments."""
    spark = changes.sparkSession
    own, live = (batch, batch), live_segments(spark, folder, batch)
    newest = latest_version(changes, ["id"], [F.desc("seq")])
    mark = F.lit(batch).cast("long").alias("batch")
    newest.select("id", "seq", mark, "op").write.mode("overwrite").parquet(_at(folder, own, "docs"))
    postings = build_text_index(newest.where(F.col("op") != "delete"), "id", cols, unique=True)
    postings.select("id", "col", "term", "tf", mark).write.mode("overwrite").parquet(_at(folder, own, "postings"))
    live.append(own)
    while len(live) >= fan and len({last - first for first, last in live[-fan:]}) == 1:
        live[-fan:] = [_merge(spark, folder, live[-fan:])]
    rows = spark.createDataFrame(live, "first long, last long").coalesce(1)
    rows.write.mode("overwrite").parquet(f"{folder}/manifests/batch={batch}")
    return live


def start_segments(changes: DataFrame, cols: Sequence[str], folder: str, checkpoint: str, fan: int = FAN) -> StreamingQuery:
    """Index a stream of changes, a segment per micro-batch."""
    stream = changes.writeStream.foreachBatch(lambda batch, n: add_segment(batch, cols, folder, n, fan) and None)
    return stream.option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def read_segments(spark: SparkSession, folder: str, base: DataFrame | None = None) -> DataFrame:
    """(id, col, term, tf) after all finished batches, on top of a ``base`` index if there is one."""
    segments = live_segments(spark, folder)
    columns = ["id", "col", "term", "tf"]
    if not segments:
        if base is None:
            raise ValueError(f"no finished batch in {folder}")
        return base.select(*columns)
    newest = _newest(_read(spark, folder, segments, "docs"))
    out = _alive(spark, folder, segments, newest).select(*columns)
    return out if base is None else out.unionByName(base.join(newest.select("id"), "id", "left_anti").select(*columns))


def vacuum_segments(spark: SparkSession, folder: str, keep: int = 2) -> int:
    """Delete the segments that none of the last ``keep`` manifests lists, and older manifests; returns how many segments went.

    Run it between batches: a reader of an older manifest loses its segments.
    """
    done = _finished(spark, folder)
    used = {s for n in done[-keep:] for s in live_segments(spark, folder, n + 1)}
    fs, path = _files(spark, folder)
    gone = 0
    for status in fs.listStatus(path(f"{folder}/segments")) if done else ():
        first, last = map(int, status.getPath().getName().split("-"))
        if (first, last) not in used and last <= done[-1]:
            fs.delete(status.getPath(), True)
            gone += 1
    for n in done[:-keep]:
        fs.delete(path(f"{folder}/manifests/batch={n}"), True)
    return gone
