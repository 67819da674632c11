"""Mixing sources to target weights by capped water-filling.

Every source gets a share of the total by weight; a source above its cap of ``epochs`` passes is clamped
there and its excess is shared again by weight, until none is above. A target becomes whole passes over
the source plus one seeded pass over part of it.

Defined results: null texts and texts of blanks have size 0 and are never taken; a null source is a source
of its own and comes last; repeated rows each count, and their order in the partial pass is arbitrary but
makes no difference to what is taken in total; an empty table gives an empty result; other columns stay.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored, words


def source_targets(sizes: DataFrame, weights: Sequence[float], epochs: float, share: float = 1.0) -> DataFrame:
    """From (source, size): source, source_size, weight, target.

    Sources by code point, null last, weigh ``weights`` in turn. Each round clamps the sources above their
    cap; the rounds exchange only sums with the driver, one row each.
    """
    totals = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    order = ranked(totals.withColumn("_last", F.col("source").isNull()), [], ["_last", "source"])
    weight = F.element_at(F.array(*(F.lit(float(w)) for w in weights)), (F.col("rank") % len(weights) + 1).cast("int"))
    sources = stored(order.select("source", "source_size", weight.alias("weight"), (F.col("source_size") * float(epochs)).alias("cap")))
    total = sources.agg(F.sum("source_size")).first()[0] or 0
    level = 0.0
    while True:  # the level only rises, and each round but the last clamps a source
        free = F.col("cap") > F.lit(level) * F.col("weight")
        clamped, weight_left = sources.agg(F.sum(F.when(~free, F.col("cap"))), F.sum(F.when(free, F.col("weight")))).first()
        if not weight_left:
            break
        raised = (total * share - (clamped or 0.0)) / weight_left
        if raised <= level:
            break
        level = raised
    target = F.least(F.col("cap"), F.lit(level) * F.col("weight"))
    return sources.select("source", "source_size", "weight", F.when(F.col("source_size") > 0, target).otherwise(F.lit(0.0)).alias("target"))


def mix_plan(docs: DataFrame, weights: Sequence[float], epochs: float, seed: str, share: float = 1.0) -> DataFrame:
    """One row per distinct (doc_id, source, text): these, ``n_rows`` and size, source_size, target, copies.

    ``copies`` is the number of times the mix takes each of the rows: the whole passes of its source, and
    one more if it lies in the source's partial pass. That pass goes through the documents by the digest of
    seed and id until it has the target's remainder; it takes the document on the edge if that comes nearer.
    """
    rows = docs.select(
        "doc_id", "source", F.size(words(F.col("text"))).cast("long").alias("size"), _digest(F.col("text")).alias("text_digest"),
        F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("null"))).cast("binary")).alias("draw"),
    )
    keys = stored(rows.groupBy(*rows.columns).agg(F.count("*").alias("n_rows")))
    mass = keys.withColumn("mass", F.col("size") * F.col("n_rows"))
    targets = source_targets(mass.select("source", F.col("mass").alias("size")), weights, epochs, share)
    placed = ranked(mass, ["source"], ["draw", "text_digest"], "mass")
    known = targets.withColumnRenamed("source", "_source")
    joined = placed.join(known, F.col("source").eqNullSafe(F.col("_source")))
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(F.lit(0.0))
    whole = F.floor(ratio + 1e-12)
    rest = F.col("target") - whole * F.col("source_size")
    drawn = F.col("before") + F.col("mass") / 2.0 <= rest
    copies = F.when(F.col("size") > 0, whole.cast("long") + F.when(drawn, 1).otherwise(0)).otherwise(0)
    return joined.select("doc_id", "source", "text_digest", "n_rows", "size", "source_size", "target", copies.cast("long").alias("copies"))


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def mix_documents(docs: DataFrame, weights: Sequence[float], epochs: float, seed: str, share: float = 1.0) -> DataFrame:
    """The mix itself: the columns of ``docs``, each document as many times as the plan takes it."""
    plan = mix_plan(docs, weights, epochs, seed, share).where("copies > 0")
    rows = docs.select(F.struct("*").alias("_row"))
    key = F.col("_row.doc_id").eqNullSafe(F.col("doc_id")) & F.col("_row.source").eqNullSafe(F.col("source"))
    key &= _digest(F.col("_row.text")) == F.col("text_digest")
    taken = rows.join(plan, key).select("_row", F.explode(F.array_repeat(F.lit(1), F.col("copies").cast("int"))).alias("_copy"))
    return taken.select("_row.*")
