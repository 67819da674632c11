"""Language registry: one DataFrame function per set of extensions."""

from __future__ import annotations

from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from . import html, jsfiles, sqlfiles

Analyzer = Callable[[DataFrame], DataFrame]
_LANGUAGES: dict[str, tuple[tuple[str, ...], Analyzer]] = {}


def register_language(name: str, extensions: Iterable[str], fn: Analyzer) -> None:
    """``fn`` gets the files with these extensions and returns (path, kind, target) rows."""
    _LANGUAGES[name] = (tuple(e.lower() for e in extensions), fn)


def languages() -> list[str]:
    return sorted(_LANGUAGES)


def analyze_languages(files: DataFrame) -> DataFrame:
    """(language, path, kind, target) over every registered language."""
    out = None
    for name in languages():
        exts, fn = _LANGUAGES[name]
        rows = fn(files.where(P.ext("path").isin(*exts)))
        rows = rows.select(F.lit(name).alias("language"), "path", F.col("kind").cast("string").alias("kind"), F.col("target").cast("string").alias("target"))
        out = rows if out is None else out.unionByName(rows)
    return out


for _lang, (_exts, _) in jsfiles.EDGE_PATTERNS.items():
    register_language(_lang, _exts, lambda files, lang=_lang: jsfiles.import_edges(files, lang))
register_language("html", [".html", ".htm"], html.html_resources)
register_language("sql", [".sql"], lambda files: sqlfiles.sql_refs(files).select("path", F.lit("reference").alias("kind"), F.col("table").alias("target")))
