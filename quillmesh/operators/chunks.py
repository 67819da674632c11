"""Byte and character chunks, and the hash vectors of chunks."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions import hashing as H


def chunk_bytes(files: DataFrame, size: int = 2048) -> DataFrame:
    """Fixed byte slices of every text: byte and line ranges, digest of the slice.

    The slice never travels: only its digest and newline count go into the running sum
    over the chunks of one file.
    """
    data = files.select("path", F.encode("text", "UTF-8").alias("_b"))
    data = data.where(F.octet_length("_b") > 0).withColumn("base_sha", F.sha2("_b", 256))
    n = F.octet_length("_b")
    starts = F.sequence(F.lit(0), F.floor((n - 1) / size).cast("int"))
    rows = data.select("path", "base_sha", "_b", n.alias("_n"), F.explode(starts).alias("i"))
    part = F.substring("_b", F.col("i") * size + 1, F.lit(size))
    as_chars = F.decode(part, "ISO-8859-1")
    rows = rows.select(
        "path", "base_sha", "i", (F.col("i") * size).cast("bigint").alias("byte_start"),
        F.least((F.col("i") + 1) * size, F.col("_n")).cast("bigint").alias("byte_end"), F.sha2(part, 256).alias("sha256_chunk"),
        (F.length(as_chars) - F.length(F.replace(as_chars, F.lit("\n"), F.lit("")))).cast("bigint").alias("_nl"),
    )
    upto = F.sum("_nl").over(Window.partitionBy("path").orderBy("i").rowsBetween(Window.unboundedPreceding, 0))
    rows = rows.withColumn("end_line", upto + 1)
    return rows.withColumn("start_line", F.col("end_line") - F.col("_nl")).drop("_nl", "i")


def chunk_chars(df: DataFrame, key: str, text: str, size: int = 18000) -> DataFrame:
    """(key, chunk_no from 1, chunks, chunk): every text whole, at least one chunk."""
    n = F.greatest(F.ceil(F.length(text) / size), F.lit(1)).cast("int")
    rows = df.select(key, F.col(text).alias("_t"), n.alias("chunks"), F.explode(F.sequence(F.lit(1), n)).alias("chunk_no"))
    return rows.select(key, "chunk_no", "chunks", F.substring("_t", (F.col("chunk_no") - 1) * size + 1, F.lit(size)).alias("chunk"))


def hash_embeddings(chunks: DataFrame, dim: int = 64) -> DataFrame:
    """(chunk_id, model, dim, embedding) from chunk digests."""
    cid = F.concat_ws("", "path", F.lit(":"), F.col("byte_start").cast("string"), F.lit("-"), F.col("byte_end").cast("string"))
    return chunks.select(cid.alias("chunk_id"), F.lit(f"hash-{dim}").alias("model"), F.lit(dim).alias("dim"), H.hash_vector("sha256_chunk", dim).alias("embedding"))
