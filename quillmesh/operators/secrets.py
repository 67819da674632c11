"""Secret and personal-data findings: kinds and digests, never the matched text.

A line is searched for cheap anchors first; only the kinds whose own anchor occurs run their full pattern. Public key formats are known by their prefixes. What is left of a line is searched for long random
words: mixed case with digits, and a Shannon entropy above that of hexadecimal digests, names and paths.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import lines as L

# Our own patterns for common leaks, and published formats of access keys.
PATTERNS = {
    "token_assignment": r"""(?i)\b(?:token|secret|password|api_key)\s*=\s*["'][^"']{8,}["']""",
    "email": r"[A-Za-z0-9._%+-]+@[A-Za-z0-9.-]+\.[A-Za-z]{2,}",
    "ipv4": r"\b(?:(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\.){3}(?:25[0-5]|2[0-4][0-9]|1?[0-9]?[0-9])\b",
    "card": r"\b(?:[0-9][ -]?){12,18}[0-9]\b",
}
KEYS = {
    "aws_key": r"\b(?:AKIA|ASIA)[0-9A-Z]{16}\b",
    "github_token": r"\bgh[pousr]_[0-9A-Za-z]{36}\b",
    "slack_token": r"\bxox[abprs]-[0-9A-Za-z-]{10,}",
    "google_key": r"\bAIza[0-9A-Za-z_-]{35}",
    "stripe_key": r"\b[rs]k_live_[0-9A-Za-z]{24,}",
    "jwt": r"\beyJ[0-9A-Za-z_-]{10,}\.eyJ[0-9A-Za-z_-]{10,}\.[0-9A-Za-z_-]{10,}",
    "private_key": r"-----BEGIN (?:[A-Z]+ )*PRIVATE KEY-----",
}
_IN_WORD = "[0-9A-Za-z+/_-]"
#: What every match of a kind must contain: literals, or a pattern.
LITERALS = {
    "token_assignment": ("=",), "email": ("@",), "aws_key": ("AKIA", "ASIA"), "github_token": ("ghp_", "gho_", "ghu_", "ghs_", "ghr_"),
    "slack_token": ("xox",), "google_key": ("AIza",), "stripe_key": ("k_live_",), "jwt": ("eyJ",), "private_key": ("PRIVATE KEY",),
}
PROBES = {"ipv4": r"[0-9]\.[0-9]", "card": r"[0-9][ -]?[0-9][ -]?[0-9][ -]?[0-9]", "random_word": f"(?<!{_IN_WORD}){_IN_WORD}{{32}}"}
RANDOM_WORD = r"[0-9A-Za-z+/_-]{32,}"
#: Bits a character. Hexadecimal digests stay below 4; 32 random characters of base 64 have some 4.6.
ENTROPY = 4.3


def entropy(word: Column) -> Column:
    """Shannon entropy of the characters of a word, in bits a character."""
    n = F.char_length(word).cast("double")
    part = lambda c: (n - F.char_length(F.replace(word, c, F.lit("")))) / n
    return F.aggregate(F.array_distinct(F.split(word, "")), F.lit(0.0), lambda total, c: total - part(c) * F.log2(part(c)))


def looks_random(word: Column) -> Column:
    mixed = word.rlike("[a-z]") & word.rlike("[A-Z]") & word.rlike("[0-9]")
    return F.when(mixed, entropy(word) >= ENTROPY).otherwise(False)


def may_hold(text: Column, kind: str) -> Column:
    """Whether the anchor of a kind occurs."""
    return text.rlike(PROBES[kind]) if kind in PROBES else reduce(or_, [text.contains(x) for x in LITERALS[kind]])


def line_secrets(line: str) -> Column:
    """(kind, sha256) of the findings of a line; cards pass the Luhn check, random words the entropy bound."""
    text, none = F.col(line), F.array().cast("array<string>")

    def hits(kind: str, pattern: str) -> Column:
        found = F.when(may_hold(text, kind), F.regexp_extract_all(text, F.lit(pattern), 0)).otherwise(none)
        good = F.filter(found, lambda v: luhn_ok(F.regexp_replace(v, "[ -]", ""))) if kind == "card" else found
        return F.transform(good, lambda v: F.struct(F.lit(kind).alias("kind"), F.sha2(v, 256).alias("sha256")))

    rest = F.regexp_replace(text, "|".join(KEYS.values()), " ")
    words = F.when(may_hold(text, "random_word"), F.regexp_extract_all(rest, F.lit(RANDOM_WORD), 0)).otherwise(none)
    random = F.transform(F.filter(words, looks_random), lambda v: F.struct(F.lit("random_word").alias("kind"), F.sha2(v, 256).alias("sha256")))
    every = F.concat(*[hits(k, p) for k, p in {**PATTERNS, **KEYS}.items()], random)
    return F.when(has_anchor(text), every).otherwise(F.array().cast("array<struct<kind:string,sha256:string>>"))


def has_anchor(text: Column) -> Column:
    """Whether any kind could occur: literals first, then one alternation."""
    literals = [text.contains(x) for kind in LITERALS.values() for x in kind]
    return reduce(or_, literals) | text.rlike("|".join(PROBES.values()))


def secrets_scan(files: DataFrame) -> DataFrame:
    """(path, line_no, kind, sha256) of every finding."""
    return L.to_lines(files).where(has_anchor(F.col("line"))).select("path", "line_no", F.inline(line_secrets("line")))


def luhn_ok(digits: Column) -> Column:
    return F.call_function("luhn_check", digits)


def secrets_summary(findings: DataFrame) -> DataFrame:
    """Findings and files per kind; no items."""
    return findings.groupBy("kind").agg(F.count("*").alias("findings"), F.countDistinct("path").alias("files"))
