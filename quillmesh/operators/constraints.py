"""Table constraints, declared as data and compiled to Spark plans.

A table's rules hold its column types, required columns, defaults, generated columns, checks, keys and references.
Checks, types and required columns of a table take one pass whatever their number; a key takes one grouping and a
reference one anti-join of grouped keys, so that a hot key is one row when it meets its parent.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .schemas import NOW, table_defaults, table_schema


@dataclass(frozen=True)
class Reference:
    """Columns that, if all are set, must occur as ``parent_columns`` of another table."""

    columns: tuple[str, ...]
    parent: str
    parent_columns: tuple[str, ...]


@dataclass(frozen=True)
class Rules:
    """Constraints of one table.

    ``types`` names the declared columns; ``generated`` and ``checks`` are SQL expressions over them, ``generated`` in
    the order they are computed. As in SQL a check fails only where it is false, not where it is null, and a key or
    reference with a null in it never fails.
    """

    types: Mapping[str, str] = field(default_factory=dict)
    required: tuple[str, ...] = ()
    defaults: Mapping[str, object] = field(default_factory=dict)
    generated: Mapping[str, str] = field(default_factory=dict)
    checks: Mapping[str, str] = field(default_factory=dict)
    keys: tuple[tuple[str, ...], ...] = ()
    references: tuple[Reference, ...] = ()


def store_rules(name: str, **more) -> Rules:
    """Rules of a table of the store: its declared types and defaults, and what the caller adds."""
    types = {f.name: f.dataType.simpleString() for f in table_schema(name).fields}
    return Rules(types=types, defaults=table_defaults(name), **more)


def _default(value: object) -> Column:
    return F.current_timestamp() if value == NOW else F.lit(value)


def _quoted(c: str) -> Column:
    return F.col(f"`{c}`")


def conform(df: DataFrame, rules: Rules) -> DataFrame:
    """The declared columns in order, cast, with defaults and generated columns; others are dropped.

    A column that is missing, or whose value is null, takes its default. A value that cannot be cast becomes null
    (``row_failures`` on the raw rows names it) and no default hides it.
    """
    def value(c: str, kind: str) -> Column:
        given = _quoted(c) if c in df.columns else F.lit(None)
        cast = given.try_cast(kind)
        if c not in rules.defaults:
            return cast
        return F.when(given.isNull(), _default(rules.defaults[c]).cast(kind)).otherwise(cast)

    plain = {c: kind for c, kind in rules.types.items() if c not in rules.generated}
    out = df.select(*[value(c, kind).alias(c) for c, kind in plain.items()])
    for c, sql in rules.generated.items():
        out = out.withColumn(c, F.expr(sql).cast(rules.types[c]) if c in rules.types else F.expr(sql))
    return out.select(*[_quoted(c) for c in (*rules.types, *(g for g in rules.generated if g not in rules.types))])


def _row_rules(df: DataFrame, rules: Rules) -> dict[str, Column]:
    """Name of every rule on single rows, and whether the row breaks it. A rule on an absent column breaks."""
    out = {}
    for c, kind in rules.types.items():
        if c in df.columns and c not in rules.generated:
            out[f"type {c}"] = _quoted(c).isNotNull() & _quoted(c).try_cast(kind).isNull()
    for c in rules.required:
        out[f"required {c}"] = _quoted(c).isNull() if c in df.columns else F.lit(c not in rules.defaults)
    for name, sql in rules.checks.items():
        out[f"check {name}"] = ~F.coalesce(F.expr(sql).cast("boolean"), F.lit(True))
    return out


def _with_generated(df: DataFrame, rules: Rules) -> DataFrame:
    return reduce(lambda d, g: d.withColumn(g[0], F.expr(g[1])), rules.generated.items(), df)


def row_failures(df: DataFrame, rules: Rules) -> DataFrame:
    """The rows with ``failed``, the names of the row rules that each breaks."""
    df = _with_generated(df, rules)
    hits = [F.when(bad, F.lit(name)) for name, bad in _row_rules(df, rules).items()]
    return df.withColumn("failed", F.array_compact(F.array(*hits)) if hits else F.array().cast("array<string>"))


def _row_report(df: DataFrame, rules: Rules) -> DataFrame | None:
    df = _with_generated(df, rules)
    bad = _row_rules(df, rules)
    if not bad:
        return None
    counts = df.agg(*[F.count_if(b).alias(f"_{i}") for i, b in enumerate(bad.values())])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(f"_{i}").alias("violations")) for i, n in enumerate(bad)])))


def _group(df: DataFrame, columns: Sequence[str]) -> DataFrame:
    """Rows per full key: partial counts come first, so that a hot key shuffles as one row a task."""
    set_ = reduce(lambda a, b: a & b, [_quoted(c).isNotNull() for c in columns])
    return df.where(set_).groupBy(*[_quoted(c).alias(f"_k{i}") for i, c in enumerate(columns)]).agg(F.count("*").alias("_n"))


def duplicate_keys(df: DataFrame, key: Sequence[str]) -> DataFrame:
    """(key columns, n): keys of more than one row."""
    groups = _group(df, key).where("_n > 1")
    return groups.select(*[F.col(f"_k{i}").alias(c) for i, c in enumerate(key)], F.col("_n").alias("n"))


def orphans(df: DataFrame, parent: DataFrame, reference: Reference) -> DataFrame:
    """(reference columns, n): keys without a parent, and the rows that have them."""
    names = [f"_k{i}" for i in range(len(reference.columns))]
    known = parent.select(*[_quoted(c).alias(k) for c, k in zip(reference.parent_columns, names)])
    lost = _group(df, reference.columns).join(known, names, "left_anti")
    return lost.select(*[F.col(k).alias(c) for c, k in zip(reference.columns, names)], F.col("_n").alias("n"))


def report(tables: Mapping[str, DataFrame], catalog: Mapping[str, Rules]) -> DataFrame:
    """(table, rule, violations) of every rule of the catalog, zeros included.

    Violations are rows: all rows of a key that occurs twice, all rows without a parent.
    """
    def named(df: DataFrame, table: str) -> DataFrame:
        return df.select(F.lit(table).alias("table"), "rule", F.col("violations").cast("bigint").alias("violations"))

    def total(groups: DataFrame, rule: str) -> DataFrame:
        return groups.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("violations")).withColumn("rule", F.lit(rule))

    parts = []
    for table, rules in catalog.items():
        df = tables[table]
        rows = _row_report(df, rules)
        if rows is not None:
            parts.append(named(rows, table))
        parts += [named(total(duplicate_keys(df, key), f"key {', '.join(key)}"), table) for key in rules.keys]
        for ref in rules.references:
            parts.append(named(total(orphans(df, tables[ref.parent], ref), f"reference {', '.join(ref.columns)} -> {ref.parent}"), table))
    return reduce(DataFrame.unionByName, parts)
