"""Data-quality operators over tables: defaults, row rules, uniqueness, gates, filters."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.misc import json_valid
from .ordered import latest_version


def apply_defaults(df: DataFrame, defaults: Mapping[str, object]) -> DataFrame:
    """Fill nulls, and missing columns, with the declared defaults."""
    out = df
    for c, v in defaults.items():
        value = F.current_timestamp() if v == "CURRENT_TIMESTAMP" else F.lit(v)
        out = out.withColumn(c, F.coalesce(F.col(c), value) if c in df.columns else value)
    return out


def in_range(c: str, lo: float, hi: float) -> Column:
    return F.col(c).isNull() | F.col(c).between(lo, hi)


def in_set(c: str, values: Sequence[str]) -> Column:
    return F.col(c).isNull() | F.col(c).isin(*values)


def positive(c: str) -> Column:
    return F.col(c).isNull() | (F.col(c) > 0)


def not_null(c: str) -> Column:
    return F.col(c).isNotNull()


def valid_json(c: str) -> Column:
    return F.col(c).isNull() | json_valid(c)


def check_rows(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """``failed``: names of the rules a row breaks."""
    hits = [F.when(~F.coalesce(ok, F.lit(False)), F.lit(name)) for name, ok in rules.items()]
    return df.withColumn("failed", F.array_compact(F.array(*hits)))


def rule_report(df: DataFrame, rules: Mapping[str, Column]) -> DataFrame:
    """(rule, violations) for every rule, zero included: one aggregate, no explode."""
    agg = df.agg(*[F.count(F.when(~F.coalesce(ok, F.lit(False)), 1)).alias(name) for name, ok in rules.items()])
    return agg.select(F.inline(F.array(*[F.struct(F.lit(n).alias("rule"), F.col(n).alias("violations")) for n in rules])))


def unique_violations(df: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Keys that occur more than once; rows with a null key never conflict."""
    full = df
    for k in keys:
        full = full.where(F.col(k).isNotNull())
    return full.groupBy(*keys).agg(F.count("*").alias("n")).where(F.col("n") > 1)


def risk_gate(patches: DataFrame, risk: DataFrame, trust: DataFrame, tests: DataFrame) -> DataFrame:
    """Patches fit for automatic application: the newest row of each table decides."""
    r = latest_version(risk, ["patch_id"], [F.desc("evaluated_at"), F.desc("id")])
    t = latest_version(trust, ["patch_id"], [F.desc("tested_at"), F.desc("id")])
    x = latest_version(tests, ["patch_id"], [F.desc("tested_at"), F.desc("id")])
    safe = r.where(F.col("is_safe_to_autoapply") & ~F.col("human_required")).select("patch_id", "risk_score")
    ok = x.where(F.col("syntax_ok") & F.col("script_tests_ok")).select("patch_id")
    return patches.join(safe, "patch_id").join(t.where("trusted").select("patch_id"), "patch_id").join(ok, "patch_id")


def unread_messages(messages: DataFrame) -> DataFrame:
    """Unread messages per receiver."""
    return messages.where(~F.col("read")).groupBy("receiver_id").agg(F.count("*").alias("unread"), F.min("created_at").alias("oldest"))


def active_rows(df: DataFrame, status: str = "active") -> DataFrame:
    return df.where(F.col("status") == status)


def due_reviews(reviews: DataFrame) -> DataFrame:
    """Pending reviews per agent and cycle."""
    return reviews.where(F.col("status") == "pending").groupBy("agent_id", "review_cycle").agg(F.count("*").alias("due"))
