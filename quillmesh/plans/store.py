"""Symbol index queries: upsert and fetch."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import store as S
from ..session import shared_folder
from ..streaming import buckets
from .registry import ORACLES, query

CUT = "2024-01-15 00:00:00"


def updates(t):
    """Events as index updates: one key per (user, type)."""
    name = F.col("event_type")
    h = F.sha1(F.concat_ws("|", F.col("user_id").cast("string"), name))
    return t.events.select(
        F.concat(F.lit("u\\"), F.col("user_id").cast("string")).alias("filepath"), F.lit("event").alias("symbol_type"), name.alias("name"), F.lit(0).cast("bigint").alias("lineno"),
        h.alias("unique_key_hash"), F.when(F.col("value") < 1, "Bad docstring").otherwise(F.format_number("value", 2)).alias("description"),
        F.when(F.col("value") > 40, "todo").otherwise("").alias("status"), F.col("ts").cast("timestamp").alias("seen_at"), F.col("event_id").alias("seq"),
    )


EMPTY = "filepath string, symbol_type string, name string, lineno bigint, unique_key_hash string, description string, status string, discovered_at timestamp, last_seen_at timestamp, occurrences bigint"


@query(
    "upsert_index",
    """WITH e AS (SELECT user_id, event_type, event_id, ts, CASE WHEN value < 1 THEN 'Bad docstring' ELSE format('{:,.2f}', value) END AS d, CASE WHEN value > 40 THEN 'todo' ELSE 'active' END AS s FROM events),
    g AS (SELECT user_id, event_type, count(*) AS occurrences, epoch_us(min(ts)) AS first_us, epoch_us(max(ts)) AS last_us, arg_max(s, event_id) AS status, arg_min(d, event_id) AS fd,
      max(length(d)) FILTER (WHERE d <> 'Bad docstring') AS ml FROM e GROUP BY ALL)
    SELECT 'u/' || g.user_id AS filepath, g.event_type AS name, occurrences, first_us, last_us, status,
    CASE WHEN ml > length(fd) THEN (SELECT arg_min(d, event_id) FROM e WHERE e.user_id = g.user_id AND e.event_type = g.event_type AND length(d) = g.ml AND d <> 'Bad docstring') ELSE fd END AS description FROM g""",
)
def _(t):
    u = updates(t)
    cut = F.lit(CUT).cast("timestamp")
    base = S.upsert_index(t.spark.createDataFrame([], EMPTY), u.where(F.col("seen_at") < cut))
    out = S.upsert_index(base, u.where(F.col("seen_at") >= cut))
    return out.select("filepath", "name", "occurrences", F.unix_micros("discovered_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "status", "description")


@query("bucketed_index", ORACLES["upsert_index"])
def _(t):
    """Three landed batches over an empty index: two compacted one after the other, the last folded in on reading."""
    folder = f"{shared_folder(t.spark)}/index-{uuid.uuid4().hex}"
    buckets.create_buckets(t.spark.createDataFrame([], EMPTY), folder, 16)
    u, early, clicks = updates(t), F.col("seen_at") < F.lit(CUT).cast("timestamp"), F.col("name") == "click"
    for n, part in enumerate([u.where(early), u.where(~early & clicks), u.where(~early & ~clicks)]):
        part.write.parquet(f"{folder}/deltas/batch={n}")
        if n < 2:
            buckets.compact_buckets(t.spark, folder)
    out = buckets.read_buckets(t.spark, folder)
    return out.select("filepath", "name", "occurrences", F.unix_micros("discovered_at").alias("first_us"), F.unix_micros("last_seen_at").alias("last_us"), "status", "description")


@query("to_index_row", "SELECT 'u/' || doc_id AS filepath, CASE WHEN lang = 'en' THEN 'function' WHEN lang = 'fr' THEN 'class' ELSE 'module' END AS symbol_type, CASE WHEN lang = 'en' THEN source WHEN lang = 'fr' THEN lang ELSE doc_id::VARCHAR END AS name, CASE WHEN doc_id = 0 THEN 1 ELSE doc_id END AS lineno FROM documents")
def _(t):
    from ..operators.items import to_index_row

    e = t.documents.select(
        F.concat(F.lit("u\\"), F.col("doc_id").cast("string")).alias("path"), F.when(F.col("lang") == "fr", "fr").otherwise("-").alias("class"),
        F.when(F.col("lang") == "en", F.col("source")).otherwise("-").alias("function"), F.col("doc_id").alias("line"), F.col("text").alias("summary"),
    )
    return to_index_row(e).select("filepath", "symbol_type", "name", "lineno")


def _index(t):
    status = F.when(F.col("o_orderstatus") == "O", "TO-DO").when(F.col("o_orderstatus") == "F", "to_do").otherwise("done")
    path = F.concat(F.when(F.col("o_orderpriority").startswith("1"), "output/").otherwise("src/"), F.col("o_orderkey").cast("string"))
    return t.orders.select(F.col("o_orderkey").alias("id"), path.alias("filepath"), status.alias("status"), F.col("o_orderpriority").alias("name"), "o_totalprice")


@query("fetch_rows", "SELECT o_orderkey::VARCHAR AS id, o_totalprice FROM orders WHERE o_orderstatus IN ('O', 'F') ORDER BY o_orderkey DESC LIMIT 50")
def _(t):
    return S.fetch_rows(_index(t), ["id", "o_totalprice", "nope"], status_any=["TO-DO", "to_do"], limit=50)


@query("fetch_index", "SELECT o_orderkey AS id, 'src/' || o_orderkey AS filepath, o_orderpriority AS name FROM orders WHERE o_orderstatus IN ('O', 'F') AND o_orderpriority NOT LIKE '1%' ORDER BY o_orderkey DESC LIMIT 50")
def _(t):
    return S.fetch_index(_index(t), 50).select("id", "filepath", "name")


@query("fetch_diagnostics", "SELECT s AS status, count(*) AS n_rows, count(*) FILTER (WHERE p NOT LIKE '1%') AS after_globs FROM (SELECT CASE o_orderstatus WHEN 'O' THEN 'TO-DO' WHEN 'F' THEN 'to_do' ELSE 'done' END AS s, o_orderpriority AS p FROM orders) GROUP BY ROLLUP (s)")
def _(t):
    return S.fetch_diagnostics(_index(t))
