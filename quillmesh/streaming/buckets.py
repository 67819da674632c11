"""The symbol index in key buckets, of which a compaction rewrites only those that the landed updates touch.

Rows lie in buckets by their key. A second table, in buckets by hash, tells in which key bucket a row with a given
unique hash lies, since an update may find its row by either. A manifest names the version of every bucket of both
tables and the last batch that they hold; it is written last, so that a compaction that died is repeated under the same
version and a batch counts once.

Numbers of buckets and their versions go through the driver, rows do not.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import paths as P
from ..operators import store

BUCKETS = 64
ROWS, HASHES = "rows", "hashes"


def key_bucket(buckets: int) -> Column:
    """The bucket of a row or update: by the key that it is matched on, else by its path."""
    return F.pmod(F.xxhash64(F.coalesce(store._match_key(), "filepath")), F.lit(buckets)).cast("int")


def hash_bucket(buckets: int) -> Column:
    return F.pmod(F.xxhash64("unique_key_hash"), F.lit(buckets)).cast("int")


def _manifest(spark: SparkSession, folder: str) -> tuple[int, int, int, dict[str, dict[int, int]]]:
    """The newest finished version: its number, its last batch, the number of buckets, and the version of each bucket."""
    from .segments import _files

    fs, path = _files(spark, folder)
    names = [s.getPath().getName() for s in fs.listStatus(path(f"{folder}/manifests"))]
    done = [int(n.split("=")[1]) for n in names if n.startswith("version=") and fs.exists(path(f"{folder}/manifests/{n}/_SUCCESS"))]
    version = max(done)
    listed = spark.read.parquet(f"{folder}/manifests/version={version}").collect()  # a row per bucket, and one for the batch
    at: dict[str, dict[int, int]] = {ROWS: {}, HASHES: {}}
    for r in listed:
        if r["part"] in at:
            at[r["part"]][r["bucket"]] = r["version"]
    (head,) = (r for r in listed if r["part"] == "head")
    return version, head["version"], head["bucket"], at


def _commit(spark: SparkSession, folder: str, version: int, batch: int, buckets: int, at: dict[str, dict[int, int]]) -> None:
    rows = [("head", buckets, batch), *((part, b, v) for part, held in at.items() for b, v in held.items())]
    frame = spark.createDataFrame(rows, "part string, bucket int, version long").coalesce(1)
    frame.write.mode("overwrite").parquet(f"{folder}/manifests/version={version}")


def _write(rows: DataFrame, folder: str, part: str, version: int) -> dict[int, int]:
    """Write rows with a ``bucket`` column; the buckets that have any, with their version."""
    out = f"{folder}/{part}/version={version}"
    rows.repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(out)
    written = rows.sparkSession.read.schema(rows.schema).parquet(out).select("bucket").distinct().collect()
    return {r["bucket"]: version for r in written}


def _read(spark: SparkSession, folder: str, part: str, held: dict[int, int], like: DataFrame, only: Iterable[int] | None = None) -> DataFrame:
    wanted = held if only is None else [b for b in only if b in held]
    at = [f"{folder}/{part}/version={held[b]}/bucket={b}" for b in sorted(wanted)]
    return spark.read.schema(like.schema).parquet(*at) if at else spark.createDataFrame([], like.schema)


def _hash_rows(rows: DataFrame, buckets: int) -> DataFrame:
    """(unique_key_hash, home, bucket): the key bucket of each hash."""
    known = rows.where(F.col("unique_key_hash").isNotNull())
    return known.select("unique_key_hash", key_bucket(buckets).alias("home"), hash_bucket(buckets).alias("bucket")).distinct()


def create_buckets(base: DataFrame, folder: str, buckets: int = BUCKETS) -> None:
    """Store an index without landed batches as version 0."""
    at = {ROWS: _write(base.withColumn("bucket", key_bucket(buckets)), folder, ROWS, 0), HASHES: _write(_hash_rows(base, buckets), folder, HASHES, 0)}
    base.limit(0).write.mode("overwrite").parquet(f"{folder}/schema")
    _commit(base.sparkSession, folder, 0, -1, buckets, at)


def _landed(spark: SparkSession, folder: str, batch: int) -> DataFrame:
    return spark.read.parquet(f"{folder}/deltas").where(F.col("batch") > batch)


def _touched(spark: SparkSession, folder: str, updates: DataFrame, buckets: int, at: dict[str, dict[int, int]]) -> tuple[list[int], list[int], DataFrame]:
    """The key buckets and hash buckets that the updates can touch, and the rows of these hash buckets."""
    keys = updates.withColumn("filepath", P.posix_path(F.trim("filepath")))
    hashes = keys.where(F.col("unique_key_hash").isNotNull()).select("unique_key_hash", hash_bucket(buckets).alias("bucket")).distinct()
    by_hash = sorted(r["bucket"] for r in hashes.select("bucket").distinct().collect())
    like = spark.createDataFrame([], "unique_key_hash string, home int")
    known = _read(spark, folder, HASHES, at[HASHES], like, by_hash)
    homes = known.join(hashes.select("unique_key_hash"), "unique_key_hash").select(F.col("home").alias("bucket"))
    both = keys.select(key_bucket(buckets).alias("bucket")).unionByName(homes).distinct()
    return sorted(r["bucket"] for r in both.collect()), by_hash, known


def compact_buckets(spark: SparkSession, folder: str) -> int:
    """Fold the landed batches into the buckets that they touch; returns the version that holds them."""
    version, batch, buckets, at = _manifest(spark, folder)
    rest = _landed(spark, folder, batch)
    last = rest.agg(F.max("batch")).first()[0]
    if last is None:
        return version
    rest, like = rest.where(F.col("batch") <= last).drop("batch"), spark.read.parquet(f"{folder}/schema")
    touched, by_hash, known = _touched(spark, folder, rest, buckets, at)
    folded = store.upsert_index(_read(spark, folder, ROWS, at[ROWS], like, touched), rest)
    rows = _write(folded.withColumn("bucket", key_bucket(buckets)), folder, ROWS, version + 1)
    new = _read(spark, folder, ROWS, rows, like)
    fresh = _hash_rows(new, buckets).where(F.col("bucket").isin(by_hash))
    kept = known.where(~F.col("home").isin(touched)).withColumn("bucket", hash_bucket(buckets))
    hashes = _write(kept.unionByName(fresh), folder, HASHES, version + 1)
    _commit(spark, folder, version + 1, last, buckets, {ROWS: at[ROWS] | rows, HASHES: at[HASHES] | hashes})
    return version + 1


def read_buckets(spark: SparkSession, folder: str) -> DataFrame:
    """The index with every landed batch: untouched buckets as stored, touched ones with the rest folded in."""
    _, batch, buckets, at = _manifest(spark, folder)
    like = spark.read.parquet(f"{folder}/schema")
    if not _has_deltas(spark, folder):
        return _read(spark, folder, ROWS, at[ROWS], like)
    rest = _landed(spark, folder, batch).drop("batch")
    touched, _, _ = _touched(spark, folder, rest, buckets, at)
    others = [b for b in at[ROWS] if b not in set(touched)]
    folded = store.upsert_index(_read(spark, folder, ROWS, at[ROWS], like, touched), rest)
    return _read(spark, folder, ROWS, at[ROWS], like, others).unionByName(folded)


def _has_deltas(spark: SparkSession, folder: str) -> bool:
    from .segments import _files

    fs, path = _files(spark, folder)
    return fs.exists(path(f"{folder}/deltas"))
