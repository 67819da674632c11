"""Chunk, vector and text-search queries."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from ..operators import chunks as C
from ..operators import search as S
from ..operators import textindex
from ..operators import vectors as V
from ..session import shared_folder
from ..streaming import segments
from .registry import FILES, query

_CHUNKS = f"""(SELECT path, i, base_sha, (i * 2048)::BIGINT AS byte_start, least((i + 1) * 2048, n)::BIGINT AS byte_end, b[i * 2048 + 1:least((i + 1) * 2048, n)] AS part, b
    FROM (SELECT path, encode(text) AS b, sha256(text) AS base_sha, octet_length(encode(text)) AS n, unnest(range(0, (octet_length(encode(text)) + 2047) // 2048)) AS i FROM {FILES}))"""


@query(
    "chunk_bytes",
    f"""SELECT path, base_sha, byte_start, byte_end, sha256(part) AS sha256_chunk, (1 + sum(nl) OVER w - nl)::BIGINT AS start_line, (1 + sum(nl) OVER w)::BIGINT AS end_line
    FROM (SELECT *, len(regexp_extract_all(hex(part), '(?:[0-9A-F][0-9A-F])')) AS z, len(list_filter(regexp_extract_all(hex(part), '[0-9A-F][0-9A-F]'), lambda x: x = '0A')) AS nl FROM {_CHUNKS}) WINDOW w AS (PARTITION BY path ORDER BY i)""",
)
def _(t):
    return C.chunk_bytes(t.files)


@query(
    "chunk_chars",
    "SELECT doc_id, (i + 1)::INT AS chunk_no, n::INT AS chunks, sha256(substr(text, (i * 5000 + 1)::BIGINT, 5000)) AS sha FROM (SELECT doc_id, text, greatest((length(text) + 4999) // 5000, 1) AS n, unnest(range(0, greatest((length(text) + 4999) // 5000, 1))) AS i FROM documents)",
)
def _(t):
    return C.chunk_chars(t.documents, "doc_id", "text", 5000).select("doc_id", "chunk_no", "chunks", F.sha2("chunk", 256).alias("sha"))


@query(
    "hash_embeddings",
    f"""SELECT path || ':' || byte_start || '-' || byte_end AS chunk_id, 'hash-64' AS model, 64 AS dim, (('0x' || substr(h, 1, 2))::INT - 128) / 128::DOUBLE AS first,
    (('0x' || substr(h, 63, 2))::INT - 128) / 128::DOUBLE AS last FROM (SELECT *, sha256(part) AS h FROM {_CHUNKS})""",
)
def _(t):
    e = C.hash_embeddings(C.chunk_bytes(t.files))
    return e.select("chunk_id", "model", "dim", F.get("embedding", F.lit(0)).alias("first"), F.get("embedding", F.lit(63)).alias("last"))


@query(
    "embedding_upsert",
    """SELECT item_id, 'm' AS model, dim, round(total, 3) AS total FROM (
      SELECT doc_id AS item_id, 32::BIGINT AS dim, (32 * (n_chars % 1000) + 528)::DOUBLE AS total FROM documents
      UNION ALL SELECT vec_id, len(embedding)::BIGINT, list_sum(embedding::DOUBLE[]) FROM embeddings WHERE vec_id NOT IN (SELECT doc_id FROM documents))""",
)
def _(t):
    cur = t.embeddings.select(F.col("vec_id").alias("item_id"), F.lit("m").alias("model"), "embedding")
    vec = F.transform(F.sequence(F.lit(1), F.lit(32)), lambda i: (F.col("n_chars") % 1000 + i).cast("float"))
    new = t.documents.select(F.col("doc_id").alias("item_id"), F.lit("m").alias("model"), vec.alias("embedding"), F.lit(2).alias("seq"))
    old = new.withColumn("embedding", F.reverse("embedding")).withColumn("embedding", F.slice("embedding", 1, 5)).withColumn("seq", F.lit(1))
    u = V.embedding_upsert(cur, new.unionByName(old))
    total = F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x.cast("double"))
    return u.select("item_id", "model", "dim", F.round(total, 3).alias("total"))


@query("embedding_orphans", "SELECT item_id FROM (SELECT vec_id AS item_id FROM embeddings) WHERE item_id NOT IN (SELECT doc_id FROM documents WHERE lang = 'en')")
def _(t):
    stored = t.embeddings.select(F.col("vec_id").alias("item_id"), "embedding")
    return V.embedding_orphans(stored, t.documents.where("lang = 'en'").select(F.col("doc_id").alias("item_id"))).select("item_id")


@query("pack_vectors", "SELECT vec_id, 256 AS bytes, true AS same FROM embeddings")
def _(t):
    p = t.embeddings.withColumn("b", V.pack_vector("embedding"))
    return p.select("vec_id", F.octet_length("b").alias("bytes"), (V.unpack_vector("b") == F.col("embedding")).alias("same"))


def _label_queries(t):
    return t.embeddings.groupBy("label").agg(F.min_by("embedding", "vec_id").alias("embedding")).select(F.col("label").cast("bigint").alias("query_id"), "embedding")


@query(
    "vector_topk",
    """SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT q.label::BIGINT AS query_id, e.vec_id, s AS score, row_number() OVER (PARTITION BY q.label ORDER BY s DESC, e.vec_id) AS rank
    FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) q, embeddings e, LATERAL (SELECT list_cosine_similarity(q.v::DOUBLE[], e.embedding::DOUBLE[]) AS s)) WHERE rank <= 10""",
)
def _(t):
    k = V.vector_topk(_label_queries(t), t.embeddings, 10)
    return k.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


@query(
    "vector_topk_l2",
    """SELECT query_id, vec_id, rank, round(score, 5) AS score FROM (SELECT q.label::BIGINT AS query_id, e.vec_id, s AS score, row_number() OVER (PARTITION BY q.label ORDER BY s, e.vec_id) AS rank
    FROM (SELECT label, arg_min(embedding, vec_id) AS v FROM embeddings GROUP BY label) q, embeddings e, LATERAL (SELECT list_distance(q.v::DOUBLE[], e.embedding::DOUBLE[]) AS s)) WHERE rank <= 10""",
)
def _(t):
    k = V.vector_topk(_label_queries(t), t.embeddings, 10, "l2")
    return k.select("query_id", "vec_id", "rank", F.round("score", 5).alias("score"))


_TERMS = r"(SELECT id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(txt)), '[^\p{L}\p{N}]+'), lambda x: x <> '')) AS term FROM (SELECT doc_id AS id, text AS txt FROM documents))"


@query("build_text_index", f"SELECT id, 'text' AS col, term, count(*) AS tf FROM {_TERMS} GROUP BY id, term")
def _(t):
    return S.build_text_index(t.documents, "doc_id", ["text"]).select("id", "col", "term", "tf")


QUERY_TEXT = "License the Élle token"


@query(
    "search_bm25",
    f"""WITH p AS (SELECT id, term, count(*) AS tf FROM {_TERMS} GROUP BY id, term), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY id), s AS (SELECT count(*)::DOUBLE AS n, avg(len)::DOUBLE AS avg FROM l),
    h AS (SELECT *, count(*) OVER (PARTITION BY term) AS df FROM p WHERE term IN ('license', 'the', 'elle', 'token'))
    SELECT id, round(sum(CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score
    FROM h JOIN l USING (id), s GROUP BY id ORDER BY score DESC, id LIMIT 20""",
)
def _(t):
    return S.search_bm25(S.build_text_index(t.documents, "doc_id", ["text"]), QUERY_TEXT, 20)


@query(
    "search_index",
    rf"""WITH p AS (SELECT id, term, count(*) AS tf FROM {_TERMS} GROUP BY id, term), l AS (SELECT id, sum(tf) AS len FROM p GROUP BY id), s AS (SELECT count(*)::DOUBLE AS n, avg(len)::DOUBLE AS avg FROM l),
    q AS (SELECT DISTINCT item_id, unnest(list_filter(regexp_split_to_array(strip_accents(lower(text)), '[^\p{{L}}\p{{N}}]+'), lambda x: x <> '')) AS term FROM benchmark),
    d AS (SELECT term, count(*) AS df FROM p GROUP BY term),
    h AS (SELECT item_id, id, tf, CASE WHEN ln((n - df + 0.5) / (df + 0.5)) <= 0 THEN 1e-6::DOUBLE ELSE ln((n - df + 0.5) / (df + 0.5)) END AS idf, len, avg FROM q JOIN p USING (term) JOIN d USING (term) JOIN l USING (id), s),
    r AS (SELECT item_id, id, round(sum(idf * tf * 2.2::DOUBLE / (tf + 1.2::DOUBLE * (0.25::DOUBLE + 0.75::DOUBLE * len / avg))), 6) AS score FROM h GROUP BY ALL)
    SELECT item_id AS query_id, id, score, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, id) AS rank FROM r QUALIFY rank <= 10""",
)
def _(t):
    folder = f"{shared_folder(t.spark)}/text-index-{uuid.uuid4().hex}"
    textindex.write_index(S.build_text_index(t.documents, "doc_id", ["text"]), folder)
    return textindex.search_index(t.spark, folder, t.benchmark.select(F.col("item_id").alias("query_id"), "text"), 10)


@query(
    "maintain_text_index",
    f"""SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM {_TERMS} WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
    UNION ALL SELECT doc_id, 'updated', 1 FROM labels WHERE quality = 1) GROUP BY term""",
)
def _(t):
    index = S.build_text_index(t.documents, "doc_id", ["text"])
    changes = t.labels.select(F.col("doc_id").alias("id"), F.when(F.col("quality") == 1, "update").otherwise("delete").alias("op"), F.lit("Updated!").alias("text"))
    return S.maintain_text_index(index, changes, ["text"]).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))


@query(
    "segmented_text_index",
    f"""SELECT term, count(*) AS docs, sum(tf)::BIGINT AS tf FROM (SELECT id, term, count(*) AS tf FROM {_TERMS} WHERE id NOT IN (SELECT doc_id FROM labels) GROUP BY ALL
    UNION ALL SELECT doc_id, unnest(['updated', 'twice']), 1 FROM labels WHERE quality = 1) GROUP BY term""",
)
def _(t):
    folder = f"{shared_folder(t.spark)}/segments-{uuid.uuid4().hex}"
    change = lambda df, op, seq, text: df.select(F.col("doc_id").alias("id"), op.alias("op"), F.lit(seq).cast("long").alias("seq"), text.alias("text"))
    segments.add_segment(change(t.documents, F.lit("insert"), 0, F.col("text")), ["text"], folder, 0, fan=2)
    judged = F.when(F.col("quality") == 1, "update").otherwise("delete")
    segments.add_segment(change(t.labels, judged, 2, F.lit("Updated twice")), ["text"], folder, 1, fan=2)
    segments.add_segment(change(t.labels, F.lit("update"), 1, F.lit("an older change")), ["text"], folder, 2, fan=2)
    return segments.read_segments(t.spark, folder).groupBy("term").agg(F.count("*").alias("docs"), F.sum("tf").alias("tf"))
