"""The symbol index as a table: occurrence-counting upsert and filtered fetches."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions.text import normalize_status
from .joins import intersect_columns

KEY = ["filepath", "symbol_type", "name", "lineno"]
PLACEHOLDER = "Bad docstring"
ALWAYS_EXCLUDED = ["**/__pycache__/**", "output/**"]


def aggregate_updates(updates: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Updates pre-aggregated per key before anything is joined.

    Input: the key columns, unique_key_hash, description, status, seen_at, seq. The
    description rule (replace only by a longer one that is no placeholder) depends on
    the first description and the earliest of the longest ones. ``merge_updates`` adds
    such rows up.
    """
    desc = F.trim(F.coalesce("description", F.lit("")))
    real = F.when((desc != "") & (desc != PLACEHOLDER), desc)
    status = F.coalesce(F.nullif(F.trim("status"), F.lit("")), F.lit("active"))
    best = F.when(real.isNotNull(), F.struct(F.length(real).alias("length"), (-F.col("seq")).alias("at")))
    return updates.groupBy(*keys).agg(
        F.count("*").alias("n"), F.min("seen_at").alias("first_at"), F.max("seen_at").alias("last_at"),
        F.min_by(desc, "seq").alias("first_desc"), F.max_by(real, best).alias("best_desc"), F.max(best).alias("best_rank"),
        F.max_by(status, "seq").alias("last_status"), F.min_by("unique_key_hash", "seq").alias("first_hash"), F.min("seq").alias("first_seq"), F.max("seq").alias("last_seq"),
    )


def merge_updates(parts: DataFrame, keys: Sequence[str]) -> DataFrame:
    return parts.groupBy(*keys).agg(
        F.sum("n").alias("n"), F.min("first_at").alias("first_at"), F.max("last_at").alias("last_at"), F.min_by("first_desc", "first_seq").alias("first_desc"),
        F.max_by("best_desc", "best_rank").alias("best_desc"), F.max_by("last_status", "last_seq").alias("last_status"), F.min_by("first_hash", "first_seq").alias("first_hash"),
    )


def _longer(new, old):
    return F.when(F.length(new) > F.length(F.coalesce(old, F.lit(""))), new).otherwise(old)


def upsert_index(target: DataFrame, updates: DataFrame) -> DataFrame:
    """Index rows after the updates.

    Natural key first, then the hash; a null name never meets another row by key. A hot
    key is one pre-aggregated row before the full outer join. ``target`` needs the key
    columns, unique_key_hash, description, status, discovered_at, last_seen_at,
    occurrences.
    """
    u = updates.withColumn("filepath", P.posix_path(F.trim("filepath")))
    # Rows without a name conflict only by hash; without a hash each is its own row.
    own = F.when(F.col("name").isNull() & F.col("unique_key_hash").isNull(), F.col("seq"))
    parts = aggregate_updates(u.withColumn("_own", own), [*KEY, "unique_key_hash", "_own"])
    lone = F.when(F.col("name").isNull(), F.coalesce("unique_key_hash", F.concat(F.lit("#"), F.col("_own").cast("string"))))
    agg = merge_updates(_resolve_by_hash(target, parts).withColumn("_h", lone), [*KEY, "_h"])

    # Keys that cannot meet still differ, so they spread over the shuffle.
    lone_t = F.concat(F.lit("t\x1f"), F.xxhash64("filepath", "description", "last_seen_at").cast("string"))
    lone_a = F.concat(F.lit("u\x1f"), F.col("_h"))
    t = target.withColumn("_k", F.coalesce(_match_key(), lone_t))
    a = agg.withColumn("unique_key_hash", F.col("first_hash")).withColumn("_k", F.coalesce(_match_key(), lone_a))
    a = a.select("_k", *[F.col(c).alias(f"u_{c}") for c in (*KEY, "n", "first_at", "last_at", "first_desc", "best_desc", "last_status", "first_hash")])
    j = t.join(a, "_k", "full_outer")
    is_new, touched = F.col("filepath").isNull(), F.col("u_n").isNotNull()
    old_desc = F.when(is_new, F.col("u_first_desc")).otherwise(F.col("description"))
    return j.select(
        *[F.coalesce(c, f"u_{c}").alias(c) for c in KEY],
        F.coalesce("unique_key_hash", "u_first_hash").alias("unique_key_hash"),
        F.when(touched, _longer(F.col("u_best_desc"), old_desc)).otherwise(F.col("description")).alias("description"),
        F.coalesce("u_last_status", "status").alias("status"),
        F.coalesce("discovered_at", "u_first_at").alias("discovered_at"),
        F.coalesce("u_last_at", "last_seen_at").alias("last_seen_at"),
        (F.coalesce("occurrences", F.lit(0)) + F.coalesce("u_n", F.lit(0))).cast("bigint").alias("occurrences"),
    )


def _match_key():
    """Identity used by the join: the natural key, or the hash where the name is null."""
    natural = F.concat_ws("\x1f", F.lit("k"), "filepath", "symbol_type", "name", F.col("lineno").cast("string"))
    hashed = F.concat(F.lit("h\x1f"), F.col("unique_key_hash"))
    return F.when(F.col("name").isNotNull(), natural).otherwise(hashed)


def _resolve_by_hash(target: DataFrame, parts: DataFrame) -> DataFrame:
    """Aggregated updates whose key is unknown but whose hash is known take over that row's key.

    A hash is known from the target, or from the first update of the batch that has it. Only rows with a hash
    are joined, one per (key, hash); owners are one row per hash, found by a partial minimum.
    """
    hashed, cols = parts.where(F.col("unique_key_hash").isNotNull()), parts.columns
    known = target.select(*KEY).where(F.col("name").isNotNull()).distinct().withColumn("_known", F.lit(True))
    rank0 = target.where(F.col("unique_key_hash").isNotNull()).select("unique_key_hash", F.struct(*KEY).alias("_owner"), F.lit(-1).cast("bigint").alias("_at"))
    rank1 = hashed.select("unique_key_hash", F.struct(*KEY).alias("_owner"), F.col("first_seq").alias("_at"))
    owners = rank0.unionByName(rank1).groupBy("unique_key_hash").agg(F.min_by("_owner", "_at").alias("_owner"))
    j = hashed.join(known, KEY, "left").join(owners, "unique_key_hash")
    move = F.col("_known").isNull()
    moved = j.select(*[F.when(move, F.col(f"_owner.{c}")).otherwise(F.col(c)).alias(c) if c in KEY else F.col(c) for c in cols])
    return moved.unionByName(parts.where(F.col("unique_key_hash").isNull()))


def fetch_rows(
    df: DataFrame, columns: Sequence[str] = (), status: str | None = None, status_any: Sequence[str] = (), *, limit: int
) -> DataFrame:
    """Requested columns that exist, filtered by status, newest id first, limited."""
    out = df.withColumn("filepath", F.col("file")) if "filepath" not in df.columns and "file" in df.columns else df
    if status is not None and "status" in out.columns:
        out = out.where(F.col("status") == status)
    if status_any and "status" in out.columns:
        out = out.where(F.col("status").isin(*status_any))
    if "id" in out.columns:
        out = out.orderBy(F.desc("id"))
    picked = intersect_columns(columns, out.columns)
    backups = [F.col(c).cast("string") for c in ("unique_key_hash", "name", "filepath") if c in out.columns]
    out = out.limit(limit)
    if "id" in picked or "id" not in out.columns:
        own = [F.col("id").cast("string")] if "id" in out.columns else []
        out = out.withColumn("id", F.coalesce(*own, *backups)) if own or backups else out
        picked = ["id", *[c for c in picked if c != "id"]] if "id" in out.columns else picked
    return out.select(*picked)


INDEX_COLUMNS = ["id", "filepath", "symbol_type", "name", "lineno", "description", "status"]


def fetch_index(df: DataFrame, max_rows: int, status: Sequence[str] = ("todo",), exclude: Sequence[str] = ()) -> DataFrame:
    """The newest ``max_rows`` rows of a status, excluded paths left out before the limit."""
    wanted = sorted({s.replace("_", "").replace("-", "").lower() for s in status})
    rows = df.where(normalize_status("status").isin(*wanted)) if wanted else df
    keep = ~P.matches_any(P.posix_path("filepath"), [*exclude, *ALWAYS_EXCLUDED])
    return rows.where(keep).orderBy(F.desc("id")).limit(max_rows).select(*[c for c in INDEX_COLUMNS if c in df.columns])


def fetch_diagnostics(df: DataFrame, exclude: Sequence[str] = ()) -> DataFrame:
    """(status, rows, rows_after_globs) per raw status and overall (null status)."""
    keep = ~P.matches_any(P.posix_path("filepath"), [*exclude, *ALWAYS_EXCLUDED])
    return df.rollup("status").agg(F.count("*").alias("n_rows"), F.count(F.when(keep, 1)).alias("after_globs"))
