"""A stored inverted index: term buckets, document slices and their greatest impacts.

Documents are ranked by length and cut into slices of ``SLICE``; a row of the index holds one term's postings of
one slice, so a row is bounded whatever the term. Rows lie in folders by term bucket, sorted by term; beside them are a
dictionary of document frequencies in the same buckets and the corpus statistics. Every row carries the greatest BM25
part that any of its postings can add, before idf.

A search reads the buckets of its terms only. The impacts bound what any document of a slice can score; the best slices
are scored first, and then only those whose bound reaches the k-th best score found there. The result is that of
scoring everything. A batch of queries is one job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .ranks import ranked, stored
from .search import B, K1, MIN_IDF, terms_of

BUCKETS, SLICE = 64, 256
#: So many slices of a bucket lie in one task and file.
PART = 512
#: Scores are given to so many digits; a slice this close to the k-th score is still looked at.
DIGITS, NEAR = 6, 2e-6


def bucket_of(term: Column | str, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def impact(tf: Column, length: Column, average: Column) -> Column:
    """A posting's part of the score, but for the idf."""
    return tf * (K1 + 1) / (tf + K1 * (1 - B + B * length / average))


def _added_up(postings: str) -> Column:
    """The postings of a row with those of one id added up."""
    ids = F.transform(postings, lambda p: F.struct(p["id"].alias("id"), p["len"].alias("len")))
    tf = lambda d: F.aggregate(F.filter(postings, lambda p: p["id"] == d["id"]), F.lit(0).cast("long"), lambda n, p: n + p["tf"])
    return F.transform(F.array_distinct(ids), lambda d: F.struct(d["id"].alias("id"), tf(d).alias("tf"), d["len"].alias("len")))


def write_index(postings: DataFrame, folder: str, buckets: int = BUCKETS, size: int = SLICE) -> None:
    """Store postings (term, id, tf; several rows of a term and id add up) as an index in ``folder``."""
    spark = postings.sparkSession
    counts = stored(postings.select("id", "term", F.col("tf").cast("long").alias("tf")))
    lengths = counts.groupBy("id").agg(F.sum("tf").alias("len"))
    placed = ranked(lengths, [], ["len", "id"]).select("id", "len", F.floor(F.col("rank") / size).cast("long").alias("slice"))
    placed = stored(placed)
    stats = placed.agg(F.min("id").alias("least"), F.count("*").alias("docs"), F.coalesce(F.nullif(F.avg("len"), F.lit(0.0)), F.lit(1.0)).alias("average"))
    stats.write.parquet(f"{folder}/stats")
    average = F.lit(spark.read.parquet(f"{folder}/stats").first()["average"])
    # Postings are dealt once, by bucket and run of slices: a common term spreads over tasks, and a task writes few buckets.
    rows = counts.join(placed, "id").withColumn("bucket", bucket_of("term", buckets)).withColumn("part", F.floor(F.col("slice") / PART))
    rows = rows.withColumn("impact", impact(F.col("tf"), F.col("len"), average)).repartition("bucket", "part")
    listed = F.sort_array(F.collect_list(F.struct("id", "tf", "len"))).alias("postings")
    blocks = rows.groupBy("bucket", "part", "term", "slice").agg(F.max("impact").alias("impact"), listed)
    blocks = blocks.withColumn("again", F.size(F.array_distinct("postings.id")) < F.size("postings"))
    blocks = blocks.withColumn("postings", F.when(F.col("again"), _added_up("postings")).otherwise(F.col("postings")))
    most = F.array_max(F.transform("postings", lambda p: impact(p["tf"], p["len"], average)))
    blocks = blocks.select("term", "slice", F.when(F.col("again"), most).otherwise(F.col("impact")).alias("impact"), F.size("postings").alias("n"), "postings", "bucket")
    blocks.sortWithinPartitions("bucket", "term", "slice").write.partitionBy("bucket").parquet(f"{folder}/blocks")
    written = spark.read.schema(blocks.schema).parquet(f"{folder}/blocks")
    words = written.groupBy("bucket", "term").agg(F.sum("n").alias("df"))  # of the heads of the rows only
    words.repartition("bucket").sortWithinPartitions("bucket", "term").write.partitionBy("bucket").parquet(f"{folder}/terms")


def _wanted(spark: SparkSession, queries: DataFrame, folder: str, buckets: int) -> tuple[DataFrame, list[int]]:
    """(query_id, term, bucket, idf) of the queries' terms, and the buckets they lie in, of which there are ``buckets`` at most."""
    words = queries.select("query_id", F.explode(F.array_distinct(terms_of("text"))).alias("term"))
    words = stored(words.withColumn("bucket", bucket_of("term", buckets)))
    read = sorted(r["bucket"] for r in words.select("bucket").distinct().collect())
    docs = spark.read.parquet(f"{folder}/stats").first()["docs"]
    found = spark.read.parquet(f"{folder}/terms").where(F.col("bucket").isin(read)).select("term", "df")
    idf = F.log((F.lit(float(docs)) - F.col("df") + 0.5) / (F.col("df") + 0.5))
    return stored(words.join(found, "term").withColumn("idf", F.when(idf <= 0, F.lit(MIN_IDF)).otherwise(idf))), read


def _scored(blocks: DataFrame, words: DataFrame, slices: DataFrame, average: Column) -> DataFrame:
    """(query_id, id, score) of the documents of the given (query_id, slice), by the queries' (query_id, term, idf).

    Rows are dealt by query and slice before they are cut into postings: a document's parts are added where they are.
    """
    met = blocks.select("term", "slice", "postings").join(words.select("query_id", "term", "idf"), "term").join(slices, ["query_id", "slice"], "left_semi")
    met = met.repartition("query_id", "slice").select("query_id", "slice", "idf", F.inline("postings"))
    part = F.col("idf") * impact(F.col("tf"), F.col("len"), average)
    exact = met.groupBy("query_id", "slice", "id").agg(F.sum(part).alias("exact"))
    return exact.select("query_id", "id", "exact", F.round("exact", DIGITS).alias("score"))


def _best(scored: DataFrame, k: int) -> DataFrame:
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "id")
    return scored.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def _open_slices(spark: SparkSession, folder: str, queries: DataFrame, k: int, buckets: int) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """The queries' words, the rows of the index in their buckets, (query_id, term, slice, idf) of those that the words have, and
    the (query_id, slice) that the best k can lie in."""
    words, read = _wanted(spark, queries, folder, buckets)
    blocks = spark.read.parquet(f"{folder}/blocks").where(F.col("bucket").isin(read))
    average = F.lit(spark.read.parquet(f"{folder}/stats").first()["average"])
    heads = words.join(blocks.select("term", "slice", "impact", "n"), "term")
    bounds = stored(heads.groupBy("query_id", "slice").agg(F.sum(F.col("idf") * F.col("impact")).alias("bound"), F.max("n").alias("n")))
    # A slice has at least as many hits as its longest row: the first slices with k hits give a score to beat.
    order = Window.partitionBy("query_id").orderBy(F.desc("bound"), "slice")
    first = bounds.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    before = F.sum("n").over(order.rowsBetween(Window.unboundedPreceding, -1))
    first = first.withColumn("before", F.coalesce(before, F.lit(0))).where(F.col("before") < k).select("query_id", "slice")
    seeds = _scored(blocks, words, first, average)
    least = _best(seeds, k).groupBy("query_id").agg(F.min("score").alias("score"), F.count("*").alias("hits")).where(F.col("hits") == k)
    open_ = bounds.join(least, "query_id", "left").where(F.col("score").isNull() | (F.col("bound") >= F.col("score") - NEAR))
    return words, blocks, heads, stored(open_.select("query_id", "slice"))


def candidate_slices(spark: SparkSession, folder: str, queries: DataFrame, k: int, buckets: int = BUCKETS) -> tuple[DataFrame, DataFrame]:
    """(query_id, term, slice, idf) of all rows that the queries' terms have, and of those that the best k can lie in."""
    _, _, heads, open_ = _open_slices(spark, folder, queries, k, buckets)
    return heads, heads.join(open_, ["query_id", "slice"])


def search_index(spark: SparkSession, folder: str, queries: DataFrame, k: int, buckets: int = BUCKETS) -> DataFrame:
    """(query_id, id, score, rank): the k best documents of each query (query_id, text), ties by id."""
    stats = spark.read.parquet(f"{folder}/stats")
    if not stats.first()["docs"]:
        none = F.lit(0.0).alias("score"), F.lit(0).alias("rank")
        return queries.limit(0).select("query_id", F.lit(None).cast(stats.schema["least"].dataType).alias("id"), *none)
    words, blocks, _, open_ = _open_slices(spark, folder, queries, k, buckets)
    average = F.lit(stats.first()["average"])
    return _best(_scored(blocks, words, open_, average), k).select("query_id", "id", "score", "rank")
