"""File corpora: listing, path selection, text reads."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P

# Files that are never content.
JUNK = ["Thumbs.db", ".DS_Store"]


def path_selected(
    path, include: Sequence[str] = (), exclude: Sequence[str] = (), segments: Sequence[str] = (), case_insensitive: bool = False, junk: bool = True
) -> Column:
    """No excluded folder on the way, an include glob matches (or none is given), no exclude glob does."""
    p = P.col(path)
    ok = F.lit(True)
    if segments:
        names = [s.lower() for s in segments] if case_insensitive else list(segments)
        parts = P.dir_segments(F.lower(p) if case_insensitive else p)
        ok = ok & ~F.arrays_overlap(parts, F.array(*[F.lit(s) for s in names]))
    if include:
        ok = ok & P.matches_any(p, include, case_insensitive)
    if exclude:
        ok = ok & ~P.matches_any(p, exclude, case_insensitive)
    if junk:
        ok = ok & ~P.basename(p).isin(*JUNK)
    return ok


def select_paths(df: DataFrame, **rules) -> DataFrame:
    return df.where(path_selected("path", **rules))


def read_files(spark: SparkSession, root: str, **rules) -> DataFrame:
    """(path, content, size) of files under a root.

    The selection uses the path only, so content is read for kept files alone.
    """
    raw = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(root)
    prefix = root.rstrip("/") + "/"
    rel = F.substring_index(F.col("path"), prefix, -1)
    return select_paths(raw.select(rel.alias("path"), "content", F.col("length").alias("size")), **rules)


def utf8(raw) -> Column:
    """Bytes as text; bad bytes become the replacement character."""
    return F.make_valid_utf8(P.col(raw).cast("string"))


def with_text(files: DataFrame) -> DataFrame:
    """``text`` and ``sha256`` from ``content``; bad bytes are replaced."""
    return files.withColumn("text", utf8("content")).withColumn("sha256", F.sha2("content", 256))


def read_text_capped(df: DataFrame, max_bytes: int) -> DataFrame:
    """``head``: the first bytes of ``content`` (or of ``text``) decoded as UTF-8."""
    raw = F.col("content") if "content" in df.columns else F.encode("text", "UTF-8")
    return df.withColumn("head", utf8(F.substring(raw, 1, max_bytes)))


def document_files(documents: DataFrame) -> DataFrame:
    """Documents as files: path, text, size, lang."""
    path = F.concat("source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".txt"))
    return documents.select("doc_id", path.alias("path"), "text", F.octet_length("text").cast("bigint").alias("size"), "lang", "source")


def sums_lines(files: DataFrame) -> DataFrame:
    """(name, value): checksum lines, digest and name two blanks apart."""
    name = F.col("path")
    return files.select(name.alias("name"), F.concat(H.sha256_hex("text"), F.lit("  "), name).alias("value"))


def read_sums(lines: DataFrame) -> DataFrame:
    """(sha256, name) of well-formed checksum lines. Input: value."""
    pat = r"^([0-9a-fA-F]{64})\s+\*?(.+)$"
    rows = lines.select(F.lower(F.regexp_extract("value", pat, 1)).alias("sha256"), F.regexp_extract("value", pat, 2).alias("name"))
    return rows.where(F.col("name") != "")
