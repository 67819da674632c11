"""Document fingerprints by spot signatures.

A signature is a common word and the chain of the next content words after it, wherever it stands; the set of
a document's signatures is its fingerprint. Two sets are compared by Jaccard: sets whose length classes are
further apart than a neighbour, or whose lengths alone keep them under a floor, are not compared at all.

Everything is DataFrame functions. The chain of the i-th anchor at word p starts at content word p - i, since
every word before it is an anchor or a content word: no running count is needed.

Defined results: null texts count as empty; a text without a full chain has the digest of itself as its only
signature, so that equal texts agree and others do not; repeated rows (equal id and text) count as one
document in the order and get a row each; equal ids with different texts follow each other by digest; a null
id comes last; a single document is followed by itself; an empty table gives an empty result; other columns
are ignored.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import BLANKS, ranked, stored

CHAIN = 2
#: Common words of English, German, French and Spanish.
ANCHORS = (
    "the", "of", "and", "to", "in", "a", "is", "that", "for", "it", "was", "with", "as", "on", "be", "by", "at", "this", "are", "from", "or", "an", "not", "have",
    "der", "die", "das", "und", "zu", "den", "von", "mit", "ist", "des", "auf", "nicht", "sich", "ein", "eine", "dem", "als", "im", "auch", "es",
    "de", "la", "le", "les", "et", "un", "du", "une", "que", "est", "pour", "qui", "dans", "par", "sur", "pas", "au", "plus", "ne", "se",
    "el", "y", "los", "del", "las", "por", "con", "no", "una", "su", "para", "al", "lo", "como", "o", "pero", "sus", "le", "ya", "este",
)
_UPPER, _LOWER, _MARKS = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", ".,;:!?\"()[]"
_HALF = 1 << 31


def _number(text: Column) -> Column:
    """The first 32 bits of the MD5 of a text, as an integer in the order of its hexadecimal form."""
    return (F.conv(F.substring(F.md5(text.cast("binary")), 1, 8), 16, 10).cast("long") - _HALF).cast("int")


def add_signatures(df: DataFrame, text: str, out: str, chain: int = CHAIN) -> DataFrame:
    """Add ``out``: the sorted distinct signatures of a text column, as integers."""
    body = F.coalesce(F.col(text), F.lit(""))
    plain = F.translate(body, _UPPER + BLANKS + _MARKS, _LOWER + " " * (len(BLANKS) + len(_MARKS)))
    anchors = list(dict.fromkeys(ANCHORS))
    df = df.withColumn("_w", F.array_remove(F.split(plain, " "), ""))
    df = df.withColumn("_c", F.filter("_w", lambda w: ~w.isin(anchors)))
    places = F.filter(F.sequence(F.lit(0), F.size("_w")), lambda p: F.get("_w", p).isin(anchors))
    df = df.withColumn("_p", places)

    def signature(p: Column, i: Column) -> Column:
        return F.concat_ws(" ", F.get("_w", p), *(F.get("_c", p - i + k) for k in range(chain)))

    whole = F.filter(F.transform("_p", lambda p, i: F.when(p - i + (chain - 1) < F.size("_c"), _number(signature(p, i)))), lambda x: x.isNotNull())
    df = df.withColumn(out, F.array_sort(F.array_distinct(whole)))
    return df.withColumn(out, F.when(F.size(out) > 0, F.col(out)).otherwise(F.array(_number(body)))).drop("_w", "_c", "_p")


def fingerprint(signatures: Column) -> Column:
    """The signatures as text: eight hexadecimal digits each."""
    return F.array_join(F.transform(signatures, lambda x: F.lower(F.lpad(F.hex(x.cast("long") + _HALF), 8, "0"))), "")


def length_class(size: Column, floor: float) -> Column:
    """Sets at least ``floor`` alike are in the same class or in neighbouring ones."""
    return F.floor(F.log(size.cast("double")) / -math.log(floor))


def likeness(a: Column, b: Column, floor: float = 0.0) -> Column:
    """Jaccard of two signature sets; 0 where their lengths alone keep it under ``floor``."""
    shared = F.size(F.array_intersect(a, b)).cast("double")
    exact = shared / (F.size(a) + F.size(b) - shared)
    if floor <= 0:
        return exact
    bound = F.least(F.size(a), F.size(b)) / F.greatest(F.size(a), F.size(b))
    apart = F.abs(length_class(F.size(a), floor) - length_class(F.size(b), floor)) > 1
    return F.when(apart, 0.0).when(bound < floor, 0.0).otherwise(F.when(exact < floor, 0.0).otherwise(exact))


KEY = ["id", "no_id", "digest"]


def _followers(rows: DataFrame) -> DataFrame:
    """(KEY, to_id, to_no_id, to_digest, need): every document, the one it follows, and half that one's length."""
    keys = rows.select(*KEY, F.floor(F.char_length("text") / 2).cast("int").alias("half")).distinct()
    placed = stored(ranked(keys, [], [F.col("no_id"), F.col("id").desc(), F.col("digest")]))
    last = placed.count()
    before = placed.select(*[F.col(c).alias(f"to_{c}") for c in KEY], F.col("half").alias("need"), ((F.col("rank") + 1) % F.lit(max(1, last))).alias("rank"))
    return placed.join(before, "rank").select(*KEY, *[f"to_{c}" for c in KEY], "need")


def fingerprint_edits(docs: DataFrame, chain: int = CHAIN, floor: float = 0.0) -> DataFrame:
    """Fingerprints of every text and of its edited text, and their likeness.

    The edited text has its last half replaced by the start of the next document, by descending id. Only
    that start and the next document's signatures are sent; the texts themselves are shuffled once, by a key
    without nulls, so that the joins and the pick of one row per key agree on it.
    """
    body = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select(F.coalesce("doc_id", F.lit(0)).alias("id"), F.col("doc_id").isNull().alias("no_id"), F.xxhash64(body).alias("digest"), body.alias("text"))
    given = rows.join(_followers(rows), KEY)
    once = Window.partitionBy(*KEY).orderBy("to_id")
    given = given.withColumn("_n", F.row_number().over(once)).where("_n = 1")
    given = add_signatures(given, "text", "next_sigs", chain).select(*[F.col(f"to_{c}").alias(c) for c in KEY], F.substring("text", F.lit(1), F.col("need")).alias("start"), "next_sigs")
    both = rows.join(given, KEY)
    n = F.char_length("text")
    head = F.substring("text", F.lit(1), n - F.floor(n / 2).cast("int"))
    both = both.select(F.when(~F.col("no_id"), F.col("id")).alias("doc_id"), n.cast("long").alias("n_chars"), "text", F.concat(head, F.col("start")).alias("edited"), "next_sigs")
    both = add_signatures(both, "text", "sigs", chain)
    both = add_signatures(both, "edited", "edited_sigs", chain)
    return both.select(
        "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        fingerprint(F.col("sigs")).alias("fingerprint"), fingerprint(F.col("edited_sigs")).alias("edited_fingerprint"),
        likeness(F.col("sigs"), F.col("edited_sigs"), floor).alias("near_edited"), likeness(F.col("sigs"), F.col("next_sigs"), floor).alias("near_next"),
    )
