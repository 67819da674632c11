"""Near copies by five-word similarity: SimHash and MinHash bands find candidates, the word sets decide.

Texts whose sets of lower-case word 5-grams have a Jaccard of at least ``LEAST`` are linked; documents of one
component are near copies. Candidates are the links of the SimHash fingerprints (see ``simhash``) and the texts
that share a band: a set's minima under 96 hashes, four to a band, meet by equality, and a pair at 0.8 misses
all 24 bands once in some 300,000 pairs. Every candidate is verified on the whole sets.

A bucket is first compared with its least text only, so that a large group costs one pair a text. What this
leaves apart is compared in full, in one of three ways:

- buckets of up to ``SMALL`` texts by pairs;
- larger ones by rare grams, those that at most ``SMALL`` of these texts have: a pair whose smaller set holds
  enough of them shares one, and one among the first of both in the order of rarity, so that only these meet;
- texts of larger buckets that are nearly all common grams (pages put together from known passages) by rounds of
  pivots, twice as many each round, against the later texts of their bucket and other components only.

Defined results are as in ``simhash``; a text under five words is one gram, and texts without words are alike.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import replace

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .blocks import Block, blocks, mix, window_hashes, word_hashes
from .common import stored
from .components import star_components
from .simhash import BITS, fingerprints, links, one_each

GRAM, LEAST = 5, 0.8
BANDS, ROWS = 24, 4
#: The largest bucket compared by pairs, and the most texts that a rare gram has. Links are alike at any value.
SMALL = 16
_SALTS, _CHUNK = 16, 1 << 12
_FACTORS = mix(np.arange(1, BANDS * ROWS + 1, dtype=np.uint64)) | np.uint64(1)
_SHIFTS = mix(np.arange(1001, BANDS * ROWS + 1001, dtype=np.uint64))


def _grams(block: Block) -> Iterator[np.ndarray]:
    """The set of gram hashes of each document."""
    data = block.data.copy()
    data[(data >= 65) & (data <= 90)] += 32
    words = word_hashes(replace(block, data=data))
    rolled = window_hashes(words, GRAM)
    for a, n in zip(block.first.tolist(), block.n_words.tolist(), strict=False):
        if n >= GRAM:
            yield np.unique(rolled[a : a + n - GRAM + 1])
        else:
            yield window_hashes(words[a : a + n], n) if n else np.zeros(1, np.uint64)


def _bands(grams: np.ndarray) -> np.ndarray:
    least = np.full(BANDS * ROWS, ~np.uint64(0))
    for i in range(0, len(grams), _CHUNK):
        least = np.minimum(least, (grams[i : i + _CHUNK] * _FACTORS[:, None] + _SHIFTS[:, None]).min(axis=1))
    keys = np.arange(1, BANDS + 1, dtype=np.uint64)
    for column in least.reshape(BANDS, ROWS).T:
        keys = mix(keys ^ column) * np.uint64(0x9E3779B97F4A7C15)
    return keys.view(np.int64)


def _digest():
    return F.xxhash64(F.coalesce("text", F.lit(""))).alias("digest")


def _arrays(rows: DataFrame, bands: bool) -> DataFrame:
    """(digest, n, keys): the size of each text's set, and its bands or the set."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for block in blocks(batch.column(1)):
                sets = list(_grams(block))
                keys = [_bands(s) if bands else s.view(np.int64) for s in sets]
                at = pa.array(np.cumsum([0, *map(len, keys)]), pa.int32())
                lists = pa.ListArray.from_arrays(at, pa.array(np.concatenate(keys)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(block.row, len(sets)), pa.array([len(s) for s in sets], pa.int64()), lists], ["digest", "n", "keys"])

    return rows.select("digest", "text").mapInArrow(run, "digest long, n long, keys array<long>")


def _sets(docs: DataFrame, wanted: DataFrame) -> DataFrame:
    """(digest, n, keys): the gram set of each text whose digest is in ``wanted``."""
    texts = docs.select(_digest(), "text").join(wanted, "digest", "left_semi").dropDuplicates(["digest"])
    return stored(_arrays(texts, bands=False))


def _verified(docs: DataFrame, pairs: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of digests whose sets are at least so much alike."""
    pairs = stored(pairs.distinct())
    sets = _sets(docs, pairs.select(F.explode(F.array("a", "b")).alias("digest")).distinct())
    side = lambda c: sets.select(F.col("digest").alias(c), F.col("keys").alias(f"{c}_set"))
    both = pairs.join(side("a"), "a").join(side("b"), "b")
    shared = F.size(F.array_intersect("a_set", "b_set"))
    return stored(both.where(shared / (F.size("a_set") + F.size("b_set") - shared) >= least).select("a", "b"))


def _close(x: Column | str, y: Column | str, least: float) -> Column:
    return F.least(x, y) >= least * F.greatest(x, y)


def _pair(x: str, y: str) -> list[Column]:
    return [F.least(x, y).alias("a"), F.greatest(x, y).alias("b")]


def _rooted(met: DataFrame, found: DataFrame) -> DataFrame:
    """(key, digest, n, root, size) of the buckets that hold several components."""
    roots = star_components(found)
    met = met.join(roots, F.col("digest") == F.col("node"), "left").select("key", "digest", "n", F.coalesce("root", "digest").alias("root"))
    several = met.groupBy("key").agg(F.min("root").alias("x"), F.max("root").alias("y"), F.count("*").alias("size")).where("x <> y")
    return stored(met.join(several.select("key", "size"), "key"))


def _by_pairs(members: DataFrame, least: float) -> DataFrame:
    """Candidates (a, b) among (key, digest, n, root); a key has at most ``SMALL`` rows."""
    texts = F.sort_array(F.collect_list(F.struct("digest", "n", "root")))
    held = members.groupBy("key").agg(texts.alias("all")).withColumn("one", F.explode("all"))
    two = held.withColumn("two", F.explode("all")).where((F.col("one.digest") < F.col("two.digest")) & (F.col("one.root") != F.col("two.root")))
    return two.where(_close("one.n", "two.n", least)).select(F.col("one.digest").alias("a"), F.col("two.digest").alias("b")).distinct()


def _by_rare_grams(docs: DataFrame, texts: DataFrame, least: float) -> tuple[DataFrame, DataFrame]:
    """Candidates (a, b) among (digest, n, root) by rare grams, and the texts (digest, dense) nearly all of common ones.

    A pair shares at least 2n * least / (1 + least) grams, n being the smaller set's size. If it has fewer common
    grams than that, the pair shares a rare one, and the rarest shared gram is among the first n - least * n + 1 of both.
    """
    sets = _sets(docs, texts.select("digest"))
    grams = sets.select("digest", F.explode("keys").alias("key"))
    counts = grams.groupBy("key").agg(F.count("*").alias("df")).where(F.col("df") <= SMALL)
    rare = stored(grams.join(counts, "key").join(texts, "digest"))
    # Sums of floats are compared with room for their last digits: a candidate too many is only verified.
    first = F.row_number().over(Window.partitionBy("digest").orderBy("df", "key")) <= F.floor(F.col("n") * (1 - least) + 1e-6) + 1
    near = _by_pairs(rare.withColumn("first", first).where("first AND df > 1"), least)
    common = sets.select("digest", "n").join(rare.groupBy("digest").agg(F.count("*").alias("rare")), "digest", "left")
    common = common.withColumn("common", F.col("n") - F.coalesce("rare", F.lit(0))).where(F.col("common") >= least * F.col("n") - 1e-6)
    return near, common.select("digest", (F.col("common") >= 2 * least / (1 + least) * F.col("n") - 1e-6).alias("dense"))


def _by_pivots(docs: DataFrame, met: DataFrame, found: DataFrame, least: float) -> DataFrame:
    """Links added to ``found`` until no two close texts of a bucket of (key, digest, n, dense) are left uncompared.

    A text's place in its bucket is drawn by hash; the texts of the next places are compared with all after them.
    """
    dense = stored(met.select("digest", "dense").distinct())
    met, done, width = stored(met.select("key", "digest", "n")), 0, SMALL
    if met.isEmpty():
        return found
    while True:
        open_ = _rooted(met, found).join(dense, "digest")
        share = F.pmod(F.xxhash64("digest", "key"), F.lit(1 << 30)) / F.lit(float(1 << 30))
        open_ = stored(open_.withColumn("place", F.floor(share * F.col("size"))))
        if (open_.agg(F.max("place")).first()[0] or 0) < done or open_.isEmpty():
            return found
        # A bucket stays whole or is left out, so that sizes and places are the same in every round.
        pivots = open_.where(F.col("place").between(done, done + width - 1)).withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(_SALTS - 1))))
        p, m = pivots.alias("p"), open_.withColumn("salt", F.pmod(F.xxhash64("digest"), F.lit(_SALTS)).cast("int")).alias("m")
        two = p.join(m, ["key", "salt"]).where(F.struct("p.place", "p.digest") < F.struct("m.place", "m.digest"))
        two = two.where((F.col("p.root") != F.col("m.root")) & _close("p.n", "m.n", least))
        two = two.where(F.when(F.col("p.n") < F.col("m.n"), F.col("p.dense")).when(F.col("p.n") > F.col("m.n"), F.col("m.dense")).otherwise(F.col("p.dense") & F.col("m.dense")))
        found = stored(found.unionByName(_verified(docs, two.select(*_pair("p.digest", "m.digest")), least)))
        done, width = done + width, 2 * width


def similar_links(docs: DataFrame, least: float = LEAST, bits: int = BITS) -> DataFrame:
    """Edges (a, b), a < b, between digests of texts; their components are those of all links."""
    marks = _arrays(docs.select(_digest(), "text"), bands=True).dropDuplicates(["digest"])
    met = stored(marks.select("digest", "n", F.explode("keys").alias("key")))
    first = met.groupBy("key").agg(F.min(F.struct("digest", "n")).alias("first"), F.count("*").alias("size")).where("size > 1")
    met = stored(met.join(first.select("key", "first"), "key"))
    stars = met.where((F.col("digest") != F.col("first.digest")) & _close("n", "first.n", least))
    stars = stars.select(F.col("first.digest").alias("a"), F.col("digest").alias("b"))
    found = _verified(docs, stars.unionByName(_print_links(docs, bits)), least)

    met = met.select("key", "digest", "n")
    left = _rooted(met, found)
    pairs = _by_pairs(left.where(F.col("size") <= SMALL), least)
    large = left.where(F.col("size") > SMALL)
    rare, common = _by_rare_grams(docs, stored(large.select("digest", "n", "root").distinct()), least)
    found = stored(found.unionByName(_verified(docs, pairs.unionByName(rare), least)))
    return _by_pivots(docs, large.select("key", "digest", "n").join(common, "digest"), found, least)


def _print_links(docs: DataFrame, bits: int) -> DataFrame:
    """Candidates (a, b) among digests: equal fingerprints, and a spanning forest of those that are near."""
    rows = stored(fingerprints(docs))
    prints = stored(rows.groupBy("print").agg(F.min("digest").alias("least")))
    same = rows.join(prints, "print").where("digest <> least").select(F.col("least").alias("a"), F.col("digest").alias("b"))
    named = lambda c: prints.select(F.col("print").alias(c), F.col("least").alias(f"{c}_least"))
    near = links(prints, bits).join(named("a"), "a").join(named("b"), "b")
    return same.unionByName(near.select(*_pair("a_least", "b_least")))


def link_similar(docs: DataFrame, bits: int = BITS, least: float = LEAST) -> DataFrame:
    """One row per document: doc_id, digest (of the text), component_id (a digest)."""
    stars = star_components(similar_links(docs, least, bits))
    linked = docs.select("doc_id", _digest()).join(stars, F.col("digest") == F.col("node"), "left")
    return linked.select("doc_id", "digest", F.coalesce("root", "digest").alias("component_id"))


def keep_one_similar(docs: DataFrame, bits: int = BITS, least: float = LEAST) -> DataFrame:
    """The documents with one of each component: the one with the least id (and of equal ids, least digest)."""
    return one_each(docs, link_similar(docs, bits, least))
