"""Line tables and totals over them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X


def to_lines(files: DataFrame, text: str = "text", *keep: str) -> DataFrame:
    """(path, line_no from 1, line) of every file."""
    return files.select("path", *keep, F.posexplode(X.lines_of(text)).alias("_i", "line")).select(
        "path", *keep, (F.col("_i") + 1).alias("line_no"), "line"
    )


def line_counts(files: DataFrame) -> DataFrame:
    """Per file: loc, sloc (neither blank nor a ``#`` comment) and non-blank lines.

    Counted with array functions on the row itself: no explode, no shuffle.
    """
    rows = files.select("path", X.lines_of("text").alias("_l"))
    code = "^" + X.BLANK + "*+[^#" + X.BLANK[1:]
    return rows.select(
        "path",
        F.size("_l").cast("bigint").alias("loc"),
        F.size(F.filter("_l", lambda x: x.rlike(code))).cast("bigint").alias("sloc"),
        F.size(F.filter("_l", X.has_ink)).cast("bigint").alias("non_blank"),
    )


def line_totals(files: DataFrame) -> DataFrame:
    """Lines with and without blanks per extension, and overall (null extension)."""
    ext = files.select("path", "text", P.ext("path").alias("ext"))
    return _counts_with(ext, "ext").rollup("ext").agg(F.sum("loc").alias("lines"), F.sum("non_blank").alias("non_blank"), F.count("*").alias("files"))


def _counts_with(files: DataFrame, *keep: str) -> DataFrame:
    rows = files.select(*keep, X.lines_of("text").alias("_l"))
    return rows.select(*keep, F.size("_l").cast("bigint").alias("loc"), F.size(F.filter("_l", X.has_ink)).cast("bigint").alias("non_blank"))


def dir_tree(files: DataFrame) -> DataFrame:
    """One row per file with its directory; ordering is left to the reader.

    A directory may hold a third of all files, so its names are rows, not an array.
    """
    return files.select(P.dirname("path").alias("dir"), P.basename("path").alias("name"))


def dir_counts(files: DataFrame) -> DataFrame:
    """Files per directory with the first and last name."""
    return dir_tree(files).groupBy("dir").agg(
        F.count("*").alias("files"), F.min("name").alias("first_name"), F.max("name").alias("last_name")
    )


def git_ignores(files: DataFrame) -> DataFrame:
    """Patterns of every ``.gitignore``: non-empty lines that are no comments."""
    own = files.where(P.basename("path") == ".gitignore")
    rows = to_lines(own).select("path", "line_no", X.strip("line").alias("pattern"))
    return rows.where((F.col("pattern") != "") & ~F.col("pattern").startswith("#"))


def source_window(lines: DataFrame, targets: DataFrame, before: int, after: int, bin_size: int = 64) -> DataFrame:
    """Lines within [target - before, target + after] of the same path.

    A target touches a bounded number of line bins, so this is an equi-join on
    (path, bin) instead of a range join over a whole file.
    """
    lo, hi = F.greatest(F.col("target_line") - before, F.lit(1)), F.col("target_line") + after
    bins = F.sequence(F.floor(lo / bin_size), F.floor(hi / bin_size))
    t = targets.select("path", "target_line", lo.alias("_lo"), hi.alias("_hi"), F.explode(bins).alias("_bin"))
    ln = lines.withColumn("_bin", F.floor(F.col("line_no") / bin_size))
    return ln.join(t, ["path", "_bin"]).where(F.col("line_no").between(F.col("_lo"), F.col("_hi"))).drop("_bin", "_lo", "_hi")
