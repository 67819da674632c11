"""Line dedup by a log-template tree.

A line goes down a tree of fixed depth: its number of tokens, then its leading tokens, variable ones (with a
digit) as a wildcard. A leaf has any number of templates, led by lines that many documents have: a line that
agrees with a lead in enough of the constant tokens after the leading ones belongs to it, the differing fields
being variable. Every line is a template of its own as well. Lines of templates that recur in enough documents
are dropped from all documents but the first. A line with fewer than ``CONSTANTS`` constant tokens is not
masked: only its copies recur.

Everything is DataFrame functions. Lines travel as hashes; the text of a line only where its leaf recurs.

Defined results: null text stays null and empty text stays empty; lines under ``min_tokens`` tokens always
stay; a document may lose all its lines and stays with an empty text; repeated rows (equal id and text) count
as one document and lose the same lines; an empty table gives an empty result; other columns are kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import stored, words

DEPTH, SIMILARITY, MIN_DOCS, MIN_TOKENS = 3, 0.7, 3, 3
#: Constant tokens that a line must have for its other tokens to be masked.
CONSTANTS = 3
WILDCARD = "<*>"
#: Lines of one piece that meet without a second piece in common.
CROWD = 16
#: Leaves that recur are told to the second pass over the lines by so many slots at most.
SLOTS = 1 << 18
#: What a line must have for its tokens to differ from itself.
_ODD = r"[0-9\t\x0b\f\r]|^ | $|  "


def _masked(line: Column) -> Column:
    """The tokens of a line with one blank between them, variable ones masked; most lines have none."""
    return F.when(line.rlike(_ODD), _masked_tokens(line)).otherwise(line)


def _masked_tokens(line: Column) -> Column:
    tokens = words(line)
    mask = F.transform(tokens, lambda t: F.when(t.rlike("[0-9]"), F.lit(WILDCARD)).otherwise(t))
    variable = line.rlike("[0-9]") & (F.size(F.filter(mask, lambda t: t != WILDCARD)) >= CONSTANTS)
    return F.array_join(F.when(variable, mask).otherwise(tokens), " ")


def _tokens(masked: str) -> Column:
    return F.split(masked, " ")


def _digest(text: Column) -> Column:
    return F.xxhash64(F.coalesce(text, F.lit("")))


def _lines(text: Column) -> Column:
    return F.split(F.coalesce(text, F.lit("")), "\n")


UNIT = ["id", "no_id", "digest"]


def _unit(key: str, text: str) -> list[Column]:
    """What tells documents apart, without nulls."""
    return [F.coalesce(key, F.lit(0)).alias("id"), F.col(key).isNull().alias("no_id"), _digest(F.col(text)).alias("digest")]


def _agreeing(pairs: DataFrame, variants: DataFrame, tail, similarity: float) -> DataFrame:
    """Of the pairs (leaf, line, lead, n, name) those that agree in enough of the constant tokens after the leading ones."""
    pairs = pairs.join(variants.select("leaf", "line", "masked"), ["leaf", "line"])
    pairs = pairs.join(variants.select("leaf", F.col("line").alias("lead"), F.col("masked").alias("other")), ["leaf", "lead"])
    both = F.zip_with(tail("masked"), tail("other"), lambda a, b: F.when((a == WILDCARD) & (b == WILDCARD), None).otherwise((a == b) & (a != WILDCARD)))
    same, known = F.size(F.filter(both, lambda x: x)), F.size(F.filter(both, lambda x: x.isNotNull()))
    return pairs.where((same > 0) & (same >= similarity * known)).select("leaf", "line", "lead", "n", "name")


def _templates(variants: DataFrame, depth: int, similarity: float) -> DataFrame:
    """(leaf, line, template): any number of templates a leaf, agreement counted over constant tokens after the leading ones.

    The tokens after the leading ones are cut into one piece more than may differ, so that lines of one template share
    a piece. A line takes the line of most documents, more than its own, that it agrees with, and it is a template of
    its own as well. Of a piece it meets the most frequent line first; if it disagrees with that one it meets all others
    above it. Pieces of more than ``CROWD`` lines are told apart by a second piece for that, cut from the other tokens.
    """
    tail = lambda c: F.slice(_tokens(c), depth + 1, F.size(_tokens(c)))
    size = F.greatest(F.size(_tokens("masked")) - depth, F.lit(0))
    pieces = (F.floor(F.col("_size") * (1 - similarity) + 1e-9) + 1).cast("int")
    cut = lambda i, n: F.floor(i * n / F.col("_pieces")).cast("int")

    def keys(of: str, tokens: str) -> Column:
        n = F.size(tokens)
        key = lambda i: F.xxhash64(of, i, F.slice(tokens, cut(i, n) + 1, cut(i + 1, n) - cut(i, n)))
        return F.posexplode(F.transform(F.sequence(F.lit(0), F.col("_pieces") - 1), key)).alias("piece", "key")

    tails = variants.withColumn("_size", size).withColumn("_pieces", pieces).withColumn("_tail", tail("masked")).where("_size > 0")
    rank = F.struct("n", "name", "line")  # equal counts: by digest
    dealt = stored(tails.select("leaf", "line", "n", "name", keys("leaf", "_tail")))
    leads = dealt.groupBy("key").agg(F.max(rank).alias("lead"), F.count("*").alias("size")).where("size > 1")
    met = dealt.join(leads, "key").where(F.col("line") != F.col("lead.line"))
    pairs = met.select("leaf", "line", F.col("lead.line").alias("lead"), F.col("lead.n").alias("n"), F.col("lead.name").alias("name")).distinct()
    first = stored(_agreeing(pairs, variants, tail, similarity))

    # Others of a piece are below its lead: a line with a template above all of them need not look.
    best = first.groupBy("leaf", "line").agg(F.max(F.struct("n", "name", F.col("lead").alias("line"))).alias("best"))
    seekers = met.where("size > 2").join(best, ["leaf", "line"], "left").where(F.col("best").isNull() | (F.col("best") < F.col("lead")))
    seekers = stored(seekers.select("leaf", "line", "piece", "key", "size", F.coalesce(F.greatest(rank, "best"), rank).alias("over")))
    others = dealt.join(seekers.select("key", "size").distinct(), "key").select("leaf", "line", "piece", "key", "size", rank.alias("rank"))

    def told_apart(rows: DataFrame, value: str) -> DataFrame:
        few = rows.where(F.col("size") <= CROWD).select("leaf", "line", "key", value)
        many = rows.where(F.col("size") > CROWD).withColumnRenamed("key", "_key").withColumnRenamed("piece", "_piece")
        many = many.join(tails.select("leaf", "line", "_size", "_pieces", "_tail"), ["leaf", "line"])
        start, end = cut(F.col("_piece"), F.col("_size")), cut(F.col("_piece") + 1, F.col("_size"))
        rest = F.concat(F.slice("_tail", F.lit(1), start), F.slice("_tail", end + 1, F.col("_size") - end))
        many = many.withColumn("_rest", rest).select("leaf", "line", value, keys("_key", "_rest"))
        return few.unionByName(many.select("leaf", "line", "key", value))

    meet = told_apart(seekers, "over").join(told_apart(others, "rank").select("key", "rank"), "key").where(F.col("rank") > F.col("over"))
    pairs = meet.select("leaf", "line", F.col("rank.line").alias("lead"), F.col("rank.n").alias("n"), F.col("rank.name").alias("name")).distinct()
    taken = first.unionByName(_agreeing(pairs, variants, tail, similarity)).groupBy("leaf", "line").agg(F.max(F.struct("n", "name", "lead")).alias("best"))
    own = variants.select("leaf", "line", F.col("line").alias("template"))
    return own.unionByName(taken.select("leaf", "line", F.col("best.lead").alias("template")))


def recurring_lines(docs: DataFrame, depth: int = DEPTH, similarity: float = SIMILARITY, min_docs: int = MIN_DOCS, min_tokens: int = MIN_TOKENS) -> DataFrame:
    """(UNIT, drop): for each document that loses lines, the hashes of these lines' masked tokens.

    Lines are counted as hashes. The text of a line is then fetched from one document that has it, so that a
    line of many documents is no group of rows.
    """
    masked = F.array_distinct(F.transform(_lines(F.col("text")), _masked))
    long = docs.select(*_unit("doc_id", "text"), F.explode(F.filter(masked, lambda x: x != "")).alias("masked"))
    long = long.withColumn("size", F.length("masked") - F.length(F.replace("masked", F.lit(" "), F.lit(""))) + 1).where(F.col("size") >= min_tokens)
    leaf = F.xxhash64("size", F.substring_index("masked", " ", depth))
    long = long.select(*UNIT, leaf.alias("leaf"), F.xxhash64("masked").alias("line"), "masked")
    seen = stored(long.drop("masked").distinct())
    order = F.struct("no_id", "id", "digest")
    leaves = seen.select("leaf", *UNIT).distinct().groupBy("leaf").count().where(F.col("count") >= min_docs).select("leaf")
    leaves = stored(leaves)
    counted = seen.groupBy("leaf", "line").agg(F.count("*").alias("n"), F.min(order).alias("owner"))
    counted = counted.join(leaves, "leaf", "left_semi").select("leaf", "line", "n", "owner.*")

    # The text of a line comes from its owner. Few leaves recur, and only lines in their slots are shuffled.
    slot = F.pmod("leaf", F.lit(SLOTS)).cast("int").alias("slot")
    near = long.withColumn("slot", slot).join(F.broadcast(leaves.select(slot).distinct()), "slot", "left_semi").drop("leaf", "slot")
    variants = near.join(counted, [*UNIT, "line"]).select("leaf", "line", "n", "masked").dropDuplicates(["leaf", "line"])
    variants = stored(variants.withColumn("name", F.md5(F.col("masked").cast("binary"))))
    known = stored(_templates(variants, depth, similarity))

    # Documents meet lines by equality, twice; a template's documents only in partial counts and minima.
    spread = seen.join(known, ["leaf", "line"]).select("leaf", "template", *UNIT).distinct().groupBy("leaf", "template")
    recurring = spread.agg(F.count("*").alias("n"), F.min(order).alias("first")).where(F.col("n") >= min_docs)
    cut = known.join(recurring, ["leaf", "template"]).select("leaf", "line", "first")
    dropped = seen.join(cut, ["leaf", "line"]).where(order != F.col("first"))
    return dropped.groupBy(*UNIT).agg(F.collect_set("line").alias("drop"))


def _cut(docs: DataFrame, text: str, rules: dict) -> DataFrame:
    """(_row, _text, _n): each row, its text without recurring lines, and how many lines went."""
    keyed = docs.select("doc_id", F.col(text).alias("text"))
    rows = docs.select(F.struct("*").alias("_row"), *_unit("doc_id", text))
    joined = rows.join(recurring_lines(keyed, **rules), UNIT, "left")
    lines = _lines(F.col(f"_row.{text}"))
    left = F.filter(lines, lambda x: ~F.array_contains("drop", F.xxhash64(_masked(x))))
    left = joined.withColumn("_left", F.when(F.col("drop").isNotNull(), left))
    cut = F.when(F.col("_left").isNull(), F.col(f"_row.{text}")).otherwise(F.array_join("_left", "\n"))
    return left.select("_row", cut.alias("_text"), F.coalesce(F.size(lines) - F.size("_left"), F.lit(0)).cast("long").alias("_n"))


def dedup_lines(docs: DataFrame, text: str = "text", **rules) -> DataFrame:
    """The columns of ``docs`` with the recurring lines cut out of ``text``, and ``n_chars``, if there, adjusted."""
    out = []
    for name, kind in docs.dtypes:
        column = F.col("_text") if name == text else F.col(f"_row.`{name}`")
        if name == "n_chars":
            column = F.when(F.col("_n") > 0, F.char_length("_text").cast(kind)).otherwise(column)
        out.append(column.alias(name))
    return _cut(docs, text, rules).select(*out)


def line_report(docs: DataFrame, **rules) -> DataFrame:
    """One row per document: doc_id, n_lines, n_dropped, kept_sha256 of the text that stays."""
    sha = F.sha2(F.coalesce("_text", F.lit("")), 256)
    lines = F.size(_lines(F.col("_row.text"))).cast("long")
    return _cut(docs, "text", rules).select("_row.doc_id", lines.alias("n_lines"), F.col("_n").alias("n_dropped"), sha.alias("kept_sha256"))
