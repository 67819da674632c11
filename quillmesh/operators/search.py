"""Full-text index: postings, BM25 search and upkeep."""

from __future__ import annotations

import sys
import unicodedata
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# The usual BM25 constants and the smallest idf.
K1, B, MIN_IDF = 1.2, 0.75, 1e-6


def _fold_table() -> tuple[str, str]:
    """Letters whose canonical decomposition is one letter plus marks, and that letter."""
    pairs = []
    for cp in range(0xC0, sys.maxunicode + 1):
        d = unicodedata.normalize("NFD", chr(cp).lower())
        if len(d) > 1 and d[0].isalnum() and all(unicodedata.category(c) == "Mn" for c in d[1:]):
            pairs.append((chr(cp), d[0]))
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = _fold_table()


def fold(c) -> Column:
    """Lower case without diacritics."""
    return F.regexp_replace(F.translate(F.lower(P.col(c)), _FROM, _TO), r"\p{Mn}+", "")


def terms_of(c) -> Column:
    return F.regexp_extract_all(fold(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def row_postings(df: DataFrame, id_col: str, cols: Sequence[str]) -> DataFrame:
    """(id, col, term, tf) of each row by itself: a row's terms are sorted and counted in place, no table of counts is held."""
    cells = F.array(*[F.struct(F.lit(c).alias("col"), F.sort_array(terms_of(c)).alias("terms")) for c in cols])
    rows = df.select(F.col(id_col).alias("id"), F.inline(cells)).where(F.size("terms") > 0)
    n = F.size("terms")
    rows = rows.withColumn("ends", F.filter(F.sequence(F.lit(1), n), lambda i: (i == n) | (F.get("terms", i) != F.get("terms", i - 1))))
    count = lambda end, k: (end - F.coalesce(F.get("ends", k - 1), F.lit(0))).cast("long")
    counts = F.transform("ends", lambda end, k: F.struct(F.get("terms", end - 1).alias("term"), count(end, k).alias("tf")))
    return rows.select("id", "col", F.inline(counts))


def build_text_index(df: DataFrame, id_col: str, cols: Sequence[str], unique: bool = False) -> DataFrame:
    """(term, id, col, tf). Counting is per (id, term): no term's postings meet in a task. ``unique``: no id has two rows, so rows need not meet."""
    if unique:
        return row_postings(df, id_col, cols)
    cells = F.array(*[F.struct(F.lit(c).alias("col"), terms_of(c).alias("terms")) for c in cols])
    rows = df.select(F.col(id_col).alias("id"), F.inline(cells)).select("id", "col", F.explode("terms").alias("term"))
    return rows.groupBy("id", "col", "term").agg(F.count("*").alias("tf"))


def search_bm25(index: DataFrame, query: str, k: int) -> DataFrame:
    """(id, score): the k best documents for a query, ties by id.

    One partial aggregate per document gives its length and its postings of the query's terms, which are as
    many as the query has. Statistics and scores need the same columns of it, so that Spark runs its exchange once
    for both: the texts are cut into terms once. Nothing runs while the plan is built.
    """
    wanted = F.array_contains(F.array_distinct(terms_of(F.lit(query))), F.col("term"))
    hits = F.collect_list(F.when(wanted, F.struct("term", "tf")))
    docs = index.groupBy("id", "term").agg(F.sum("tf").alias("tf")).groupBy("id").agg(F.sum("tf").alias("len"), hits.alias("hits"))
    # A document counts under each of its hits and, for the corpus, under null.
    counted = docs.select("len", F.explode(F.concat(F.array(F.lit(None).cast("string")), F.col("hits.term"))).alias("term"))
    counted = counted.groupBy("term").agg(F.count("*").alias("df"), F.avg("len").alias("avg"))
    corpus = lambda c: F.max(F.when(F.col("term").isNull(), F.col(c)))
    dfs = F.map_from_entries(F.collect_list(F.when(F.col("term").isNotNull(), F.struct("term", "df"))))
    stats = counted.agg(corpus("df").cast("double").alias("n"), corpus("avg").alias("avg"), dfs.alias("dfs")).select(F.struct("n", "avg", "dfs")).scalar()
    scored = docs.where(F.size("hits") > 0).select("id", "len", F.inline("hits"), stats.alias("s"))
    scored = scored.withColumn("df", F.col("s.dfs")[F.col("term")])
    idf = F.log((F.col("s.n") - F.col("df") + 0.5) / (F.col("df") + 0.5))
    idf = F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf)
    part = idf * F.col("tf") * (K1 + 1) / (F.col("tf") + K1 * (1 - B + B * F.col("len") / F.coalesce(F.nullif(F.col("s.avg"), F.lit(0.0)), F.lit(1.0))))
    total = scored.groupBy("id").agg(F.round(F.sum(part), 6).alias("score"))
    return total.orderBy(F.desc("score"), "id").limit(k)


def maintain_text_index(index: DataFrame, changes: DataFrame, cols: Sequence[str]) -> DataFrame:
    """Index after changes(id, op in insert/update/delete, text columns)."""
    kept = index.join(changes.select("id").distinct(), "id", "left_anti")
    fresh = build_text_index(changes.where(F.col("op") != "delete"), "id", cols)
    return kept.unionByName(fresh)
