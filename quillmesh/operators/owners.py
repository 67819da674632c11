"""Owner rules: the last matching rule owns a path."""

from __future__ import annotations

import re
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .ranks import ranked, stored


@dataclass(frozen=True)
class OwnerRule:
    index: int
    pattern: str
    owners: tuple[str, ...]


def owner_rules(lines: DataFrame) -> DataFrame:
    """(path, line_no, pattern, owners) of an owners file given as lines.

    Comments, ``!`` rules and rules without an owner are left out.
    """
    s = F.when(X.lstrip("line").startswith("#"), "").otherwise(F.substring_index("line", "#", 1))
    parts = F.filter(F.split(X.strip(s), X.BLANK + "+"), lambda p: p != "")
    rows = lines.select("path", "line_no", parts.alias("_p"))
    rows = rows.where((F.size("_p") >= 2) & ~F.element_at("_p", 1).startswith("!"))
    return rows.select("path", "line_no", F.element_at("_p", 1).alias("pattern"), F.slice("_p", F.lit(2), F.size("_p") - 1).alias("owners"))


def collect_rules(rules: DataFrame) -> list[OwnerRule]:
    """Rules of one owners file, numbered from 1 in file order.

    An owners file is configuration written by people; it is read to the driver like
    any other setting.
    """
    rows = rules.orderBy("path", "line_no").collect()
    return [OwnerRule(i, r["pattern"], tuple(r["owners"])) for i, r in enumerate(rows, 1)]


def _regexes(pattern: str) -> tuple[str, str | None]:
    """(regex over the path, regex over the base name or None)."""
    pat = pattern.lstrip("/")
    if pat.endswith("/") or not pat:
        prefix = pat.rstrip("/")
        return (("(?s)^" + re.escape(prefix) + "/") if prefix else "(?s)^", None)
    own = P.glob_to_regex(pat)
    if "/" not in pat:
        return own, own
    if not pattern.startswith("/"):
        return own + "|" + P.glob_to_regex("**/" + pat), None
    return own, None


def rule_index(path, rules: list[OwnerRule]) -> Column:
    """Index of the last matching rule, null when none matches.

    A narrow expression, not a join: no path is ever paired with every rule row.
    """
    p = F.regexp_replace(P.col(path), r"^/+", "")
    base = P.basename(p)
    hits = []
    for r in reversed(rules):
        on_path, on_base = _regexes(r.pattern)
        hit = p.rlike(on_path)
        hits.append(F.when(hit | base.rlike(on_base) if on_base else hit, F.lit(r.index)))
    return F.coalesce(*hits) if hits else F.lit(None).cast("int")


def assign_owners(files: DataFrame, rules: list[OwnerRule]) -> DataFrame:
    """(path, rule_index, pattern, owners) of every file; nulls when unowned."""
    idx = files.select("path", rule_index("path", rules).alias("rule_index"))
    if not rules:
        return idx.select("path", "rule_index", F.lit(None).cast("string").alias("pattern"), F.lit(None).cast("array<string>").alias("owners"))
    table = F.array(*[F.struct(F.lit(r.pattern).alias("pattern"), F.array(*[F.lit(o) for o in r.owners]).alias("owners")) for r in rules])
    hit = F.when(F.col("rule_index").isNotNull(), F.get(table, F.col("rule_index") - 1))
    return idx.select("path", "rule_index", hit["pattern"].alias("pattern"), hit["owners"].alias("owners"))


def number_rules(rules: DataFrame) -> DataFrame:
    """(rule_index, pattern, owners) of ``owner_rules``, numbered from 1 in the order of (path, line_no), without a collect."""
    numbered = ranked(rules, [], ["path", "line_no"])
    return numbered.select((F.col("rank") + 1).cast("int").alias("rule_index"), "pattern", "owners")


#: Where the literal head of a rule lies in the paths that it matches: it is a folder above them, the name of one, their
#: base name, or what the path or its base name starts with.
ABOVE, UNDER, NAME, START = "above", "under", "name", "start"


def rule_key(pattern: str) -> tuple[str, str, str]:
    """(place, head, tail): every path matched by the pattern has the head at that place and ends with the tail."""
    pat = pattern.lstrip("/")
    if pat.endswith("/") or not pat:
        return (ABOVE, pat.rstrip("/"), "") if pat.rstrip("/") else (START, "", "")
    special = [i for i, c in enumerate(pat) if c in "*?["]
    if not special:
        return (START, "", pat) if "/" in pat else (NAME, pat, "")
    head, tail = pat[: special[0]], pat[special[-1] + 1 :].rpartition("]")[2]
    if "/" in head and (tail or not pattern.startswith("/")):
        folder = head.rpartition("/")[0]
        return (ABOVE, folder, tail) if pattern.startswith("/") else (UNDER, folder.rpartition("/")[2], tail)
    if "/" in pat and not pattern.startswith("/"):
        return START, "", tail
    # With a tail, a head of some power of two letters will do: there are as many shapes of keys as pairs of lengths.
    return START, head[: 1 << (len(head).bit_length() - 1)] if head and tail else head, tail


def indexed_rules(rules: DataFrame) -> DataFrame:
    """(place, head, tail, rule_index, pattern, owners, on_path, on_base): the last rule of each pattern under the key that
    it is found by. The regexes are null where the key itself decides."""

    def parts(batches):
        for frame in batches:
            keys = [rule_key(p) for p in frame["pattern"]]
            regexes = [_regexes(p) for p in frame["pattern"]]
            whole = [p.lstrip("/").endswith("/") or not p.lstrip("/") for p in frame["pattern"]]
            out = frame.assign(place=[k[0] for k in keys], head=[k[1] for k in keys], tail=[k[2] for k in keys])
            out["on_path"] = [None if w else r[0] for r, w in zip(regexes, whole, strict=True)]
            out["on_base"] = [r[1] for r in regexes]
            yield pd.DataFrame(out)

    last = rules.where(F.col("pattern").isNotNull()).groupBy("pattern").agg(F.max(F.struct("rule_index", "owners")).alias("rule"))
    schema = "rule_index int, pattern string, owners array<string>, place string, head string, tail string, on_path string, on_base string"
    return last.select("rule.rule_index", "pattern", "rule.owners").mapInPandas(parts, schema)


def key_shapes(indexed: DataFrame) -> DataFrame:
    """One row: the places of the keys with the lengths of heads that paths start with and of tails, as an array."""
    size = F.when(F.col("place") == START, F.length("head")).otherwise(0)
    return indexed.agg(F.collect_set(F.struct("place", size.alias("head"), F.length("tail").alias("tail"))).alias("shapes"))


def path_keys(p: Column, shapes: Column) -> Column:
    """(place, head, tail) keys of a path without leading slashes: in each shape, what a rule that matches it can have."""
    parts, base = F.split(p, "/"), P.basename(p)
    names = F.slice(parts, 1, F.size(parts) - 1)
    folders = F.transform(names, lambda _, i: F.array_join(F.slice(parts, F.lit(1), i + 1), "/"))

    def keys(shape):
        heads = F.when(shape["place"] == ABOVE, folders).when(shape["place"] == UNDER, names).when(shape["place"] == NAME, F.array(base))
        heads = heads.otherwise(F.array(F.substring(p, F.lit(1), shape["head"]), F.substring(base, F.lit(1), shape["head"])))
        tail = F.substring(p, F.length(p) - shape["tail"] + 1, shape["tail"])
        return F.transform(F.array_distinct(heads), lambda h: F.struct(shape["place"].alias("place"), h.alias("head"), tail.alias("tail")))

    return F.flatten(F.transform(F.filter(shapes, lambda s: s["tail"] <= F.length(p)), keys))


def assign_owners_by_table(files: DataFrame, rules: DataFrame) -> DataFrame:
    """``assign_owners`` for rules in a table (rule_index, pattern, owners), of any number.

    A path meets the rules that share one of its keys by an equality join, and only these try their regex. Of equal
    patterns the last one counts, and a path of several rows is matched once. Rules that share their head, up to a
    power of two, and tail still meet all paths that have both.
    """
    p = F.regexp_replace("path", r"^/+", "")
    indexed = stored(indexed_rules(rules))
    paths = files.select("path").distinct().withColumn("p", p)
    keyed = paths.crossJoin(key_shapes(indexed)).select("path", "p", F.inline(path_keys(F.col("p"), F.col("shapes"))))
    met = keyed.join(indexed, ["place", "head", "tail"])
    hit = F.col("on_path").isNull() | F.rlike("p", F.col("on_path")) | F.coalesce(F.rlike(P.basename("p"), F.col("on_base")), F.lit(False))
    rule = F.struct("rule_index", "pattern", "owners")
    best = met.where(hit).groupBy("path").agg(F.max_by(rule, "rule_index").alias("rule"))
    return files.select("path").join(best, "path", "left").select("path", "rule.rule_index", "rule.pattern", "rule.owners")


def owner_counts(assigned: DataFrame) -> DataFrame:
    """Files per owner by (-count, owner)."""
    rows = assigned.select(F.explode("owners").alias("owner"))
    return rows.groupBy("owner").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "owner")


def owner_summary(assigned: DataFrame) -> DataFrame:
    return assigned.agg(
        F.count("*").alias("files"),
        F.count("rule_index").alias("assigned"),
        F.count(F.when(F.col("rule_index").isNull(), 1)).alias("unassigned"),
    )


def top_unassigned_dirs(assigned: DataFrame, n: int = 10) -> DataFrame:
    """First-two-segment folders with the most unowned files; ties by first path."""
    rows = assigned.where(F.col("rule_index").isNull()).select(F.substring_index("path", "/", 2).alias("dir"), "path")
    counts = rows.groupBy("dir").agg(F.count("*").alias("files"), F.min("path").alias("_first"))
    return counts.orderBy(F.desc("files"), "_first").limit(n).drop("_first")
