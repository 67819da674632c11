"""Embedding table upkeep and exact nearest neighbours."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ordered import first_seen, top_n

#: Queries and vectors that are compared at once; it bounds a score matrix.
CHUNK = 1024


def embedding_upsert(current: DataFrame, updates: DataFrame) -> DataFrame:
    """One row per (item_id, model): the newest update, else the current row.

    Input: item_id, model, embedding and, for updates, seq.
    """
    newest = first_seen(updates, ["item_id", "model"], [F.desc("seq")]).drop("seq")
    kept = current.join(newest.select("item_id", "model"), ["item_id", "model"], "left_anti")
    return kept.unionByName(newest).withColumn("dim", F.size("embedding").cast("bigint"))


def embedding_orphans(stored: DataFrame, items: DataFrame) -> DataFrame:
    """Embeddings whose item is gone."""
    return stored.join(items.select("item_id").distinct(), "item_id", "left_anti")


def pack_vector(c):
    """Embedding as little-endian float32 bytes (the stored form)."""
    @F.pandas_udf("binary")
    def pack(s):
        import numpy as np

        return s.map(lambda v: None if v is None else np.asarray(v, dtype="<f4").tobytes())

    return pack(c)


def unpack_vector(c):
    @F.pandas_udf("array<float>")
    def unpack(s):
        import numpy as np

        return s.map(lambda b: None if b is None else np.frombuffer(b, dtype="<f4"))

    return unpack(c)


def vector_topk(queries: DataFrame, vectors: DataFrame, k: int, metric: str = "cosine", query_blocks: int | None = None, vector_blocks: int | None = None) -> DataFrame:
    """(query_id, vec_id, score, rank): the k nearest vectors of every query, ties by id.

    Both sides are cut into blocks by the hash of their ids, by default so many that the pairs of blocks are
    about the shuffle partitions, and each pair is one group: the two numbers bound what a task holds. A group goes
    through its vectors in chunks and keeps k per query. Exact: nothing is dropped that could be among the best.
    """
    tasks = int(vectors.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    query_blocks = query_blocks or math.isqrt(tasks)
    n = vector_blocks or -(-tasks // query_blocks)
    blocks = lambda count: F.explode(F.sequence(F.lit(0), F.lit(count - 1)))
    block = lambda id_, count: F.pmod(F.xxhash64(id_), F.lit(count)).cast("int")
    q = queries.select("query_id", "embedding", block("query_id", query_blocks).alias("qb")).withColumn("vb", blocks(n))
    v = vectors.select("vec_id", "embedding", block("vec_id", n).alias("vb")).withColumn("qb", blocks(query_blocks))

    def best(ids, wanted, chunks):
        import numpy as np

        kept_score, kept_id = np.zeros((len(ids), 0)), np.zeros((len(ids), 0), dtype=np.int64)
        for vec_ids, matrix in chunks:
            if metric == "cosine":
                score = (wanted @ matrix.T) / np.outer(np.linalg.norm(wanted, axis=1), np.linalg.norm(matrix, axis=1))
            else:
                score = np.stack([np.linalg.norm(matrix - x, axis=1) for x in wanted])
            score = np.concatenate((kept_score, score), axis=1)
            all_ids = np.concatenate((kept_id, np.broadcast_to(vec_ids, (len(ids), len(vec_ids)))), axis=1)
            order = np.lexsort((all_ids, -score if metric == "cosine" else score), axis=1)[:, :k]
            kept_score, kept_id = np.take_along_axis(score, order, 1), np.take_along_axis(all_ids, order, 1)
        return kept_score, kept_id

    def group(left, right):
        import numpy as np
        import pandas as pd

        if left.empty or right.empty:
            return pd.DataFrame({"query_id": [], "vec_id": [], "score": []})
        out = []
        for a in range(0, len(left), CHUNK):
            part = left.iloc[a : a + CHUNK]
            wanted = np.stack(part["embedding"].to_numpy()).astype("float64")
            chunks = ((r["vec_id"].to_numpy(), np.stack(r["embedding"].to_numpy()).astype("float64")) for r in (right.iloc[b : b + CHUNK] for b in range(0, len(right), CHUNK)))
            score, ids = best(part["query_id"].to_numpy(), wanted, chunks)
            out.append(pd.DataFrame({"query_id": np.repeat(part["query_id"].to_numpy(), ids.shape[1]), "vec_id": ids.ravel(), "score": score.ravel()}))
        return pd.concat(out)

    found = q.groupBy("qb", "vb").cogroup(v.groupBy("qb", "vb")).applyInPandas(group, "query_id bigint, vec_id bigint, score double")
    order = [F.desc("score") if metric == "cosine" else F.asc("score"), "vec_id"]
    return top_n(found, ["query_id"], order, k, "rank")
