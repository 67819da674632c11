"""Digests, keys, hash vectors and set digests."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

from .paths import col


def sha256_hex(c) -> Column:
    return F.sha2(col(c).cast("binary"), 256)


def sha1_key(*parts) -> Column:
    return F.sha1(F.concat_ws("|", *[col(p).cast("string") for p in parts]))


def symbol_hash(path, kind, name, line) -> Column:
    """``hash_<name>_<first ten hex digits>`` of the natural key."""
    return F.concat(F.lit("hash_"), col(name), F.lit("_"), F.substring(sha1_key(path, kind, name, line), 1, 10))


def record_fp(kind, path, code, message, line) -> Column:
    """Stable fingerprint of a finding; nulls count as empty."""
    parts = [F.coalesce(col(c).cast("string"), F.lit("")) for c in (kind, path, code, message, line)]
    return F.concat(F.lit("sha256:"), F.sha2(F.concat_ws("|", *parts), 256))


def content_hash(cols: Sequence[str]) -> Column:
    """Digest of the named fields as JSON in name order."""
    return F.sha2(F.to_json(F.struct(*[F.col(c) for c in sorted(cols)]), {"ignoreNullFields": "false"}), 256)


def hash_vector(hex_digest, dim: int = 64) -> Column:
    """Digest bytes mapped to [-1, 1), repeated up to ``dim`` values."""
    def at(i: Column) -> Column:
        byte = F.conv(F.substring(col(hex_digest), (i % 32) * 2 + 1, F.lit(2)), 16, 10).cast("double")
        return ((byte - 128) / 128).cast("double")

    return F.transform(F.sequence(F.lit(0), F.lit(dim - 1)), at)


def digest_word(hex_digest, k: int) -> Column:
    """The k-th 48-bit word of a hex digest."""
    return F.conv(F.substring(col(hex_digest), 12 * k + 1, 12), 16, 10).cast("decimal(20,0)")


def set_digest(hex_digest) -> Column:
    """Order-free digest of a set of digests.

    Sums of 48-bit words merge map-side in constant space, so no task ever sees
    more than partial sums, however many members the set has.
    """
    sums = [F.coalesce(F.sum(digest_word(hex_digest, k)), F.lit(0)).cast("decimal(38,0)").cast("string") for k in range(4)]
    return F.sha2(F.concat_ws("|", F.count(F.lit(1)).cast("string"), *sums), 256)
