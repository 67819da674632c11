"""Source and sink queries: parts, bundles, sums, manifests."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import search
from ..session import shared_folder
from ..sources import files as SF
from ..sources import manifest as M
from ..sources.eventlog import read_event_log
from ..streaming import flows
from .registry import FILES, ORACLES, query
from . import search as _  # noqa: F401  its checks are shared by the streams
from .store import EMPTY, updates

_PARTS = """(WITH RECURSIVE r AS (SELECT doc_id // 128 AS shard, doc_id AS seq, octet_length(encode(text)) + 1 AS size, row_number() OVER (PARTITION BY doc_id // 128 ORDER BY doc_id) AS n FROM documents),
    w AS (SELECT shard, seq, size, n, size AS used, 0 AS part_no FROM r WHERE n = 1
      UNION ALL SELECT r.shard, r.seq, r.size, r.n, CASE WHEN w.used + r.size > 20000 THEN r.size ELSE w.used + r.size END, w.part_no + CASE WHEN w.used + r.size > 20000 THEN 1 ELSE 0 END
      FROM w JOIN r ON r.shard = w.shard AND r.n = w.n + 1)
    SELECT seq, size, 'manifest_' || lpad(shard::VARCHAR, 5, '0') || '_' || lpad((part_no // 10)::VARCHAR, 2, '0') || '_' || lpad(part_no::VARCHAR, 4, '0') || '.jsonl' AS part FROM w)"""


def _parts(t):
    d = t.documents.withColumn("shard", F.floor(F.col("doc_id") / 128))
    return M.assign_parts(d, "shard", "doc_id", "text", split_bytes=20_000)


@query("assign_parts", f"SELECT seq, part FROM {_PARTS}")
def _(t):
    return _parts(t).select("seq", "part")


@query("parts_index", f"SELECT part, sum(size)::BIGINT AS bytes, count(*) AS lines FROM {_PARTS} GROUP BY part")
def _(t):
    return M.parts_index(_parts(t))


@query("write_sums", f"SELECT path AS name, sha256(text) || '  ' || path AS value FROM {FILES}")
def _(t):
    return SF.sums_lines(t.files)


@query("read_sums", f"SELECT sha256(text) AS sha256, path AS name FROM {FILES}")
def _(t):
    lines = SF.sums_lines(t.files).select("value")
    return SF.read_sums(lines.unionByName(t.files.select(F.col("lang").alias("value"))))


@query("write_bundle", f"""SELECT path, '{{"content_b64":"' || base64(encode(text)) || '","mode":"0644","path":"' || path || '","sha256":"' || sha256(text) || '"}}' AS value FROM {FILES}""")
def _(t):
    return M.bundle_lines(t.files)


@query("read_bundle", f"SELECT path, sha256(text) AS digest, NULL AS reason FROM {FILES} WHERE lang <> 'fr' AND lang <> 'de' UNION ALL SELECT '../' || path, NULL, 'unsafe path' FROM {FILES} WHERE lang = 'fr' UNION ALL SELECT path, NULL, 'hash mismatch' FROM {FILES} WHERE lang = 'de'")
def _(t):
    f = t.files.withColumn("path", F.when(F.col("lang") == "fr", F.concat(F.lit("../"), "path")).otherwise(F.col("path")))
    raw = F.encode("text", "UTF-8")
    sha = F.when(F.col("lang") == "de", F.sha2(F.lit("x"), 256)).otherwise(F.sha2(raw, 256))
    lines = f.select(F.to_json(F.struct("path", sha.alias("sha256"), F.lit("0644").alias("mode"), F.base64(raw).alias("content_b64"))).alias("value"))
    return M.read_bundle(lines).select("path", F.sha2("content", 256).alias("digest"), "reason")


@query("iter_json_objects", """SELECT conv_id || ':' || turn AS id, unnest([1, 2]) AS object_no, unnest([role, turn::VARCHAR]) AS a FROM conversations""")
def _(t):
    one = F.to_json(F.struct(F.col("role").alias("a"), F.col("text").alias("t")))
    two = F.concat(F.lit('{"a":{"x":'), F.col("turn").cast("string"), F.lit("}}"))
    src = t.conversations.select(F.concat_ws(":", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("id"), F.concat(F.lit("junk "), one, F.lit(" } , "), two).alias("text"))
    o = M.iter_json_objects(src)
    return o.select("id", "object_no", F.coalesce(F.get_json_object("object", "$.a.x"), F.get_json_object("object", "$.a")).alias("a"))


@query(
    "read_manifest",
    """SELECT 'p' || conv_id || '_' || turn AS part, conv_id AS part_no, unnest(CASE WHEN turn % 2 = 0 THEN [0, 1] ELSE [0, 2] END) AS line_no, unnest(['chat_' || role, 'done']) AS family FROM conversations""",
)
def _(t):
    one = F.to_json(F.struct(F.concat(F.lit("Chat-"), "role").alias("kind"), F.col("text").alias("t")))
    two = F.lit('{"family": "", "record_type": "end"}')
    value = F.when(F.col("turn") % 2 == 0, F.concat(F.lit("["), one, F.lit(", "), two, F.lit(", 7]"))).otherwise(F.concat(one, F.lit("\n{broken\n"), two, F.lit("\n[1]\n")))
    part = F.concat(F.lit("p"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string"))
    raw = t.conversations.select(part.alias("part"), value.alias("value"))
    order = t.conversations.select(part.alias("part"), F.col("conv_id").alias("part_no"))
    return M.parse_manifest(raw, order, {"end": "done"}).select("part", "part_no", "line_no", "family")


@query("write_records", """SELECT 1 AS seq, '{"kind":"' || lang || '","path":"' || path || '"}' AS value FROM (SELECT lang, source || '/' || doc_id || '.txt' AS path FROM documents) UNION ALL SELECT 0, '{"record_type":"manifest_header","tool":"x"}'
    UNION ALL SELECT 2, '{"counts":[' || string_agg('{"kind":"' || lang || '","n":' || n || '}', ',' ORDER BY lang) || '],"record_type":"bundle_summary"}' FROM (SELECT lang, count(*) AS n FROM documents GROUP BY lang)""")
def _(t):
    return M.write_records(t.files.select(F.col("lang").alias("kind"), "path"), {"tool": "x"})


# ---- sinks and streams, through the shared folder ------------------------------------------


def _folder(t) -> str:
    return f"{shared_folder(t.spark)}/query-{uuid.uuid4().hex}"


@query("write_rows", "SELECT doc_id, lang, source, sha256(text) AS text_sha256 FROM documents")
def _(t):
    rows, table = _folder(t), _folder(t)
    M.write_rows(t.documents.select("doc_id", "text"), rows, "json")
    M.write_rows(t.documents.select("doc_id", "lang", "source"), table, "csv")
    texts = t.spark.read.schema("doc_id bigint, text string").json(rows)
    named = t.spark.read.schema("doc_id bigint, lang string, source string").option("header", "true").csv(table)
    return named.join(texts, "doc_id").select("doc_id", "lang", "source", F.sha2("text", 256).alias("text_sha256"))


@query("read_event_log", "SELECT user_id::VARCHAR AS run_id, event_type AS type, count(*) AS n, sum(event_id)::BIGINT AS dur_ms, min(epoch_us(ts)) // 1000 AS first_ms FROM events GROUP BY ALL")
def _(t):
    at = _folder(t)
    M.write_rows(t.events.select("ts", F.col("user_id").cast("string").alias("run_id"), F.col("event_type").alias("type"), F.col("event_id").alias("dur_ms")), at, "json")
    log = read_event_log(t.spark, at)
    return log.groupBy("run_id", "type").agg(F.count("*").alias("n"), F.sum("dur_ms").alias("dur_ms"), F.min(F.unix_millis("ts")).alias("first_ms"))


@query("read_files", "SELECT sum(octet_length(encode(text)) + 1)::BIGINT AS bytes, sum(len(text) + 1)::BIGINT AS chars FROM documents")
def _(t):
    at = _folder(t)
    t.documents.select("text").write.text(at)
    found = SF.with_text(SF.read_files(t.spark, at, include=["*.txt"]))
    return found.agg(F.sum("size").alias("bytes"), F.sum(F.char_length("text")).alias("chars"))


@query("stream_upsert", ORACLES["upsert_index"])
def _(t):
    at, u = _folder(t), updates(t)
    u.repartition(3).write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(u.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    flows.start_upserts(stream, f"{at}/index", f"{at}/state").awaitTermination()
    out = flows.compact_index(t.spark, t.spark.createDataFrame([], EMPTY), f"{at}/index", 1)
    out = flows.compact_index(t.spark, out, f"{at}/index", 2, base_version=1)
    return out.select("filepath", "name", "occurrences", F.unix_micros("discovered_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "status", "description")


@query("stream_text_index", ORACLES["maintain_text_index"])
def _(t):
    at = _folder(t)
    op = F.when(F.col("quality") == 1, "update").otherwise("delete")
    changes = t.labels.select(F.col("doc_id").alias("id"), op.alias("op"), F.lit(1).cast("bigint").alias("seq"), F.lit("Updated!").alias("text"))
    changes.repartition(2).write.parquet(f"{at}/in")
    stream = t.spark.readStream.schema(changes.schema).option("maxFilesPerTrigger", 1).parquet(f"{at}/in")
    flows.start_text_index(stream, ["text"], f"{at}/index", f"{at}/state").awaitTermination()
    index = flows.read_text_index(t.spark, search.build_text_index(t.documents, "doc_id", ["text"]), ["text"], f"{at}/index")
    return index.groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))
