"""JSON, date, map and number expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col


def json_props(c) -> Column:
    """Valid JSON as is; null, blank and broken values become ``{}``."""
    return F.when(F.try_parse_json(col(c)).isNotNull(), col(c)).otherwise(F.lit("{}"))


def json_valid(c) -> Column:
    return col(c).isNotNull() & F.try_parse_json(col(c)).isNotNull()


def json_map_merge(a, b) -> Column:
    """Right map wins on equal keys."""
    left = F.map_filter(col(a), lambda k, _: ~F.array_contains(F.map_keys(col(b)), k))
    return F.map_concat(left, col(b))


def expires_at(since, ttl_seconds) -> Column:
    return col(since) + F.make_dt_interval(F.lit(0), F.lit(0), F.lit(0), col(ttl_seconds).cast("decimal(18,6)"))


def is_expired(since, ttl_seconds, now) -> Column:
    return expires_at(since, ttl_seconds) <= col(now)


def coverage(part, total) -> Column:
    """part / total; null when there is nothing to cover."""
    return F.try_divide(col(part).cast("double"), col(total).cast("double"))


def round3(c) -> Column:
    return F.round(col(c), 3)


def megapixel_bucket(width, height) -> Column:
    mp = col(width).cast("double") * col(height).cast("double") / F.lit(1_000_000.0)
    return (
        F.when(mp < 0.3, "<0.3MP").when(mp < 1, "0.3–1MP").when(mp < 3, "1–3MP").when(mp < 8, "3–8MP").otherwise(">=8MP")
    )
