"""Joins between corpora, snapshots, mappings and metadata.

No side is broadcast by hint: Catalyst and AQE broadcast what their size estimates
allow and split skewed partitions of the rest.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P
from ..functions.misc import json_map_merge


def prune_delta(remote: DataFrame, local: DataFrame) -> DataFrame:
    """Remote paths that are not present locally."""
    return remote.join(local.select("path"), "path", "left_anti")


def merge_context(items: DataFrame, ctx: DataFrame) -> DataFrame:
    """Left join by id; keys of the context map override those of the item map."""
    c = ctx.select("id", F.col("props").alias("_ctx"))
    joined = items.join(c, "id", "left")
    merged = F.when(F.col("_ctx").isNull(), F.col("props")).otherwise(json_map_merge("props", "_ctx"))
    return joined.withColumn("props", merged).drop("_ctx")


def merge_batch_meta(results: DataFrame, batch: DataFrame) -> DataFrame:
    """Results by id with the metadata of their batch, clean paths and defaults.

    Input: results(id, docstring, relpath, target_lineno, signature), batch(id, relpath,
    filepath, target_lineno, signature, has_docstring).
    """
    meta = batch.select("id", *[F.col(c).alias(f"m_{c}") for c in ("relpath", "filepath", "target_lineno", "signature", "has_docstring")])
    own = results.where(F.trim(F.coalesce("id", F.lit(""))) != "").withColumn("id", F.trim("id"))
    j = own.join(meta, "id", "left")
    blank = lambda c: F.nullif(F.col(c), F.lit(""))
    raw = F.trim(F.coalesce(blank("m_relpath"), blank("m_filepath"), blank("relpath"), F.lit("")))
    return j.select(
        "id",
        F.coalesce("docstring", F.lit("")).alias("docstring"),
        F.regexp_replace(P.posix_path(raw), r"^(\./)*/?", "").alias("relpath"),
        F.coalesce(F.nullif("m_target_lineno", F.lit(0)), F.nullif("target_lineno", F.lit(0)), F.lit(1)).cast("bigint").alias("target_lineno"),
        F.coalesce(blank("m_signature"), blank("signature"), F.lit("module")).alias("signature"),
        F.coalesce("m_has_docstring", F.lit(False)).alias("has_docstring"),
    )


def map_qualnames(names: DataFrame, mapping: DataFrame, prefix_match: bool = True) -> DataFrame:
    """``new_name`` per dotted name: the longest mapped name or dotted prefix wins.

    Each distinct name is tried once, against its own few dotted prefixes, by an
    equi-join; the range condition ``name LIKE old.%`` never runs.
    """
    distinct = names.select("name").distinct()
    parts = F.split("name", r"\.")
    lengths = F.sequence(F.lit(1), F.size(parts)) if prefix_match else F.array(F.size(parts))
    tried = distinct.select("name", F.explode(F.transform(lengths, lambda n: F.array_join(F.slice(parts, F.lit(1), n), "."))).alias("old"))
    best = tried.join(mapping, "old").groupBy("name").agg(F.max_by(F.struct("old", "new"), F.length("old")).alias("m"))
    best = best.select("name", F.concat("m.new", F.substring("name", F.length("m.old") + 1, F.length("name"))).alias("_new"))
    return names.join(best, "name", "left").withColumn("new_name", F.coalesce("_new", "name")).drop("_new")


def fk_orphans(child: DataFrame, parent: DataFrame, child_key: str, parent_key: str) -> DataFrame:
    """Child rows whose key is set but has no parent."""
    keys = parent.select(F.col(parent_key).alias("_k"))
    return child.where(F.col(child_key).isNotNull()).join(keys, F.col(child_key) == F.col("_k"), "left_anti")


def required_rows(expected: DataFrame, table: DataFrame, key: str) -> DataFrame:
    """ok or missing per expected key; the big table is reduced to wanted keys first."""
    seen = table.join(expected.select(key).distinct(), key, "left_semi").select(key).distinct().withColumn("_s", F.lit("ok"))
    return expected.join(seen, key, "left").withColumn("status", F.coalesce("_s", F.lit("missing"))).drop("_s")


def changed_files(old: DataFrame, new: DataFrame, text: str = "text") -> DataFrame:
    """added / removed / modified paths between two snapshots, by digest.

    Texts are digested before the shuffle, which carries 32 bytes per file.
    """
    a = old.select("path", F.unhex(H.sha256_hex(text)).alias("old_hash"))
    b = new.select("path", F.unhex(H.sha256_hex(text)).alias("new_hash"))
    j = a.join(b, "path", "full_outer")
    change = (
        F.when(F.col("old_hash").isNull(), "added").when(F.col("new_hash").isNull(), "removed").when(F.col("old_hash") != F.col("new_hash"), "modified")
    )
    return j.select("path", change.alias("change")).where(F.col("change").isNotNull())


def tree_digest(files: DataFrame, text: str = "text") -> DataFrame:
    """One digest of all (path, bytes) pairs, independent of order and partitioning."""
    member = F.sha2(F.concat(F.encode("path", "UTF-8"), F.lit(bytearray(b"\x00")), F.col(text).cast("binary")), 256)
    return files.select(member.alias("_h")).agg(H.set_digest("_h").alias("digest"))


def except_paths(a: DataFrame, b: DataFrame) -> DataFrame:
    return a.select("path").distinct().join(b.select("path"), "path", "left_anti")


def intersect_columns(requested: Sequence[str], actual: Sequence[str]) -> list[str]:
    """Requested columns that exist, in request order; all when none was asked for."""
    return [c for c in requested if c in actual] or list(actual)
