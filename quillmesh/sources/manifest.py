"""Manifests and bundles: parts, records, digests."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P
from ..operators.records import canonical_family

PART_SCHEMA = "shard bigint, seq bigint, part string, value string"


def assign_parts(df: DataFrame, shard: str, seq: str, value: str, split_bytes: int = 150_000, parts_per_dir: int = 10, stem: str = "manifest", ext: str = "jsonl") -> DataFrame:
    """Rows with the part file they go to: (shard, seq, part, value).

    Greedy packing in order starts a new part when the next line would pass the limit.
    Packing runs inside each shard, so the result depends on the shard column, never on
    how many tasks ran. A task streams its sorted rows and keeps one running byte count.
    """
    rows = df.select(F.col(shard).cast("bigint").alias("shard"), F.col(seq).cast("bigint").alias("seq"), F.col(value).alias("value"))

    def run(batches):
        shard_now, used, part_no = None, 0, 0
        for pdf in batches:
            names = []
            for s, v in zip(pdf["shard"], pdf["value"]):
                size = len(v.encode()) + 1
                if s != shard_now:
                    shard_now, used, part_no = s, 0, 0
                elif used and used + size > split_bytes:
                    used, part_no = 0, part_no + 1
                used += size
                names.append(f"{stem}_{s:05d}_{part_no // parts_per_dir:02d}_{part_no:04d}.{ext}")
            yield pdf.assign(part=names)[["shard", "seq", "part", "value"]]

    return rows.repartition("shard").sortWithinPartitions("shard", "seq").mapInPandas(run, PART_SCHEMA)


def parts_index(parts: DataFrame) -> DataFrame:
    """(part, bytes, lines) per part."""
    return parts.groupBy("part").agg(F.sum(F.octet_length("value") + 1).cast("bigint").alias("bytes"), F.count("*").alias("lines"))


def write_parts(parts: DataFrame, path: str) -> None:
    """One folder per part; Spark names the files."""
    parts.select("part", "value").write.mode("overwrite").partitionBy("part").text(path)


def record_lines(records: DataFrame) -> DataFrame:
    """(value): sorted-key JSON line per record."""
    return records.select(F.to_json(F.struct(*[F.col(c) for c in sorted(records.columns)])).alias("value"))


def write_records(records: DataFrame, header: dict[str, str]) -> DataFrame:
    """(seq, value): header line, record lines, trailing summary with the counts per kind."""
    spark = records.sparkSession
    head = spark.range(1).select(
        F.lit(0).alias("seq"), F.to_json(F.struct(*[F.lit(v).alias(k) for k, v in sorted({**header, "record_type": "manifest_header"}.items())])).alias("value")
    )
    counts = records.groupBy("kind").agg(F.count("*").alias("n"))
    tail = counts.agg(F.array_sort(F.collect_list(F.struct("kind", "n"))).alias("counts")).select(
        F.lit(2).alias("seq"), F.to_json(F.struct("counts", F.lit("bundle_summary").alias("record_type"))).alias("value")
    )
    return head.unionByName(record_lines(records).select(F.lit(1).alias("seq"), "value")).unionByName(tail)


def read_manifest(spark: SparkSession, path: str, parts_order: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """All records of the part files below a folder; parts are small by construction."""
    raw = spark.read.option("recursiveFileLookup", "true").text(path, wholetext=True)
    return parse_manifest(raw.select(P.basename(F.col("_metadata.file_path")).alias("part"), "value"), parts_order, aliases)


def parse_manifest(raw: DataFrame, parts_order: DataFrame | None = None, aliases: dict[str, str] | None = None) -> DataFrame:
    """(part, part_no, line_no, record, family) of part texts(part, value).

    A part is JSONL or one JSON array; lines that are no objects are skipped. Parts come
    in the order given, else by name.
    """
    is_array = F.ltrim("value").startswith("[")
    arrays = raw.where(is_array).select("part", F.posexplode(F.from_json("value", "array<string>")).alias("line_no", "record"))
    lines = raw.where(~is_array).select("part", F.posexplode(F.split("value", r"\r\n|\n|\r")).alias("line_no", "record"))
    rows = arrays.unionByName(lines).withColumn("record", F.trim("record"))
    rows = rows.where(F.col("record").startswith("{") & F.try_parse_json("record").isNotNull())
    if parts_order is None:
        rows = rows.withColumn("part_no", F.lit(None).cast("bigint"))
    else:
        rows = rows.join(parts_order.select("part", "part_no"), "part", "left")
    keys = ("family", "record_type", "kind", "type")
    fam = F.coalesce(*[F.nullif(F.get_json_object("record", f"$.{k}"), F.lit("")) for k in keys], F.lit(""))
    return rows.withColumn("family", canonical_family(fam, aliases))


def bundle_lines(files: DataFrame, mode: str = "0644") -> DataFrame:
    """(path, value): bundle record per file."""
    raw = F.encode("text", "UTF-8")
    rec = F.struct(F.translate(F.base64(raw), "\r\n", "").alias("content_b64"), F.lit(mode).alias("mode"), F.col("path"), H.sha256_hex("text").alias("sha256"))
    return files.select("path", F.to_json(rec).alias("value"))


BUNDLE_SCHEMA = "path string, sha256 string, mode string, content_b64 string"


def read_bundle(lines: DataFrame, verify: bool = True) -> DataFrame:
    """(path, mode, sha256, content, reason): ``reason`` is null for a file that can be unpacked, and ``content``
    for a record that is rejected. Each record is decoded and hashed once. Input: value."""
    rec = lines.select(F.from_json("value", BUNDLE_SCHEMA).alias("r")).select("r.*")
    rows = rec.withColumn("content", F.try_to_binary("content_b64", F.lit("base64")))
    reason = (
        F.when(F.col("path").isNull(), "no path")
        .when(~P.safe_relative("path"), "unsafe path")
        .when(F.col("content").isNull(), "bad base64")
        .when(F.lit(verify) & F.col("sha256").isNotNull() & (F.sha2("content", 256) != F.lower("sha256")), "hash mismatch")
    )
    rows = rows.withColumn("reason", reason)
    return rows.select("path", "mode", "sha256", F.when(F.col("reason").isNull(), F.col("content")).alias("content"), "reason")


def iter_json_objects(df: DataFrame) -> DataFrame:
    """(id, object_no, object): objects found in concatenated text by balanced braces."""
    def run(batches):
        import re

        import pandas as pd

        token = re.compile(r'"(?:[^"\\]|\\.)*"|[{}]', re.S)
        for pdf in batches:
            rows = []
            for i, text in zip(pdf["id"], pdf["text"]):
                depth, start, n = 0, 0, 0
                for m in token.finditer(text or ""):
                    if m.group() == "{":
                        start, depth = (m.start() if depth == 0 else start), depth + 1
                    elif m.group() == "}" and depth:
                        depth -= 1
                        if depth == 0:
                            n += 1
                            rows.append((i, n, text[start : m.end()]))
            yield pd.DataFrame(rows, columns=["id", "object_no", "object"])

    found = df.select(F.col("id").cast("string").alias("id"), "text").mapInPandas(run, "id string, object_no int, object string")
    return found.where(F.try_parse_json("object").isNotNull())


def write_rows(df: DataFrame, path: str, fmt: str) -> None:
    """csv with a header, or one JSON object per line."""
    w = df.write.mode("overwrite")
    w.option("header", "true").csv(path) if fmt == "csv" else w.json(path)


def write_summaries(summary: DataFrame, path: str) -> None:
    summary.write.mode("overwrite").partitionBy("family").json(path)
