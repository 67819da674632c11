"""Line edits and patches: apply, parse, dry-run, limits and scope."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P

# Line anchors.
ENCODING = r"^[ \t]*#.*coding[:=][ \t]*([-\w.]+)"
IMPORT = r"^[ \t]*(import\s+\S+|from\s+\S+\s+import\b)"
_KEEP_ENDS = r"[^\r\n]*(?:\r\n|\r|\n)|[^\r\n]+"


def keep_ends(text) -> Column:
    """Lines of a text with their line ends."""
    return F.regexp_extract_all(P.col(text), F.lit(_KEEP_ENDS), 0)


def _header_size(a: Column) -> Column:
    bang = F.coalesce(F.get(a, F.lit(0)).startswith("#!"), F.lit(False)).cast("int")
    return bang + F.coalesce(F.get(a, bang).rlike(ENCODING), F.lit(False)).cast("int")


def _import_block_end(a: Column) -> Column:
    i = _header_size(a)
    rest = F.slice(a, i + 1, F.size(a))
    quiet = lambda x: x.rlike(r"^\s*(#|$)")
    stop = F.array_position(F.transform(rest, lambda x: quiet(x) | x.rlike(IMPORT)), False)
    k = F.when(stop == 0, F.size(rest)).otherwise(stop - 1).cast("int")
    return F.when(F.exists(F.slice(rest, F.lit(1), k), lambda x: x.rlike(IMPORT)), i + k).otherwise(i)


def _splice(a: Column, cut_from: Column, cut_to: Column, block: Column) -> Column:
    """a[:cut_from] + block + a[cut_to:] with 0-based positions."""
    return F.concat(F.slice(a, F.lit(1), cut_from), block, F.slice(a, cut_to + 1, F.greatest(F.size(a) - cut_to, F.lit(0))))


def _apply(a: Column, e: Column, eol: Column) -> Column:
    text = F.regexp_replace(F.regexp_replace(F.coalesce(e["new_text"], F.lit("")), r"\r\n?", "\n"), r"\n\z", "")
    no_text = F.coalesce(e["new_text"], F.lit("")) == ""
    block = F.when(no_text, F.array().cast("array<string>")).otherwise(F.transform(F.split(text, "\n"), lambda x: F.concat(x, eol)))
    none, n = F.array().cast("array<string>"), F.size(a)
    clip = lambda c: F.least(F.greatest(c, F.lit(0)), n)
    start, end, op, anchor = clip(e["start_line"] - 1), clip(e["end_line"]), e["op"], e["anchor"]
    unfinished = (n == 0) | ~F.element_at(a, -1).rlike(r"[\r\n]\z")
    closed = F.when(unfinished, F.concat(a, F.array(F.lit("\n")))).otherwise(a)
    line = F.coalesce(e["start_line"], F.lit(0))
    at = (
        F.when(anchor == "file_start", F.lit(0))
        .when(anchor == "after_shebang_and_encoding", _header_size(a))
        .when(anchor == "after_import_block", _import_block_end(a))
        .when(anchor == "after_line", clip(line))
        .when(anchor == "before_line", clip(line - 1))
    )
    return (
        F.when(op == "replace", _splice(a, start, end, block))
        .when(op == "delete", _splice(a, start, end, none))
        .when((op == "insert") & (anchor == "file_end"), F.concat(closed, block))
        .when((op == "insert") & at.isNotNull(), _splice(a, at, at, block))
        .otherwise(a)
    )


def apply_line_edits(files: DataFrame, edits: DataFrame) -> DataFrame:
    """(path, text) after the edits, in seq order, each seeing the last one's lines.

    Edits meet their file once; the fold is a JVM array expression inside the row.
    """
    ops = edits.groupBy("path").agg(
        F.array_sort(F.collect_list(F.struct("seq", "op", "start_line", "end_line", "anchor", "new_text"))).alias("_ops")
    )
    rows = files.join(ops, "path", "left").withColumn("_a", keep_ends("text"))
    # Materialise the first line end before the fold needs it.
    eol = F.coalesce(F.nullif(F.regexp_extract(F.coalesce(F.get("_a", 0), F.lit("")), r"(\r\n|\r|\n)\z", 1), F.lit("")), F.lit("\n"))
    rows = rows.withColumn("_eol", eol)
    folded = F.aggregate(
        F.coalesce("_ops", F.array().cast(ops.schema["_ops"].dataType)), F.struct(F.col("_a").alias("a")),
        lambda acc, e: F.struct(_apply(acc["a"], e, F.col("_eol")).alias("a")), lambda acc: F.array_join(acc["a"], ""),
    )
    return rows.withColumn("text", F.when(F.col("_ops").isNull(), F.col("text")).otherwise(folded)).drop("_ops", "_a", "_eol")


HUNK_SCHEMA = (
    "patch_id string, file_no int, old_path string, new_path string, hunk_no int, old_start int, old_count int, "
    "new_start int, new_count int, pos int, tag string, content string, old_line int, new_line int, problem string"
)


def parse_hunks(patches: DataFrame) -> DataFrame:
    """Every hunk line of every unified diff, with computed old and new line numbers.

    A missing count is 0, and an untagged line, blank ones included, ends a hunk. A
    file without hunks, or a malformed patch, gives one row without a line.
    """
    def run(batches):
        import pandas as pd

        cols = [c.split()[0] for c in HUNK_SCHEMA.split(", ")]
        ints = [c.split()[0] for c in HUNK_SCHEMA.split(", ") if c.endswith(" int")]
        for pdf in batches:
            rows = [(i, *r) for i, t in zip(pdf["patch_id"], pdf["text"]) for r in _hunk_rows(t or "")]
            yield pd.DataFrame(rows, columns=cols).astype({c: "Int32" for c in ints})

    return patches.select("patch_id", "text").mapInPandas(run, HUNK_SCHEMA)


def _hunk_rows(text: str):
    import re

    header = re.compile(r"@@\s*-(\d+)(?:,(\d+))?\s+\+(\d+)(?:,(\d+))?\s*@@")

    def name(line):
        body = line[4:].split("\t", 1)[0].strip()
        return None if body == "/dev/null" else body[2:] if body[:2] in ("a/", "b/") else body

    file_no = hunk_no = pos = 0
    old = new = span = old_at = new_at = None
    state, out = "outside", []
    for line in text.splitlines(keepends=True):
        if state == "old":
            if not line.startswith("+++ "):
                break
            new, state, hunk_no = name(line), "file", 0
            out.append((file_no, old, new, *[None] * 10, None))
        elif line.startswith("--- "):
            file_no, old, state = file_no + 1, name(line), "old"
        elif line.startswith("@@") and state in ("file", "hunk"):
            m = header.match(line.strip())
            if not m:
                return [(file_no, old, new, *[None] * 10, f"Malformed hunk header: {line!r}")]
            span = tuple(int(g or 0) for g in m.groups())
            hunk_no, pos, state = hunk_no + 1, 0, "hunk"
            old_at, new_at = max(0, span[0] - 1), max(0, span[2] - 1)
        elif state == "hunk" and line[0] in " +-\\":
            tag, pos = line[0], pos + 1
            old_at, new_at = old_at + (tag in " -"), new_at + (tag in " +")
            out.append((file_no, old, new, hunk_no, *span, pos, tag, line[1:], old_at if tag in " -" else None, new_at if tag in " +" else None, None))
        else:
            state = "outside"
    if state == "old":
        return [(file_no, old, None, *[None] * 10, "Malformed diff: expected '+++' after '---'")]
    return out


def validate_hunks(hunks: DataFrame, files: DataFrame) -> DataFrame:
    """(patch_id, ok, mismatches): dry run of parsed patches against file texts.

    Context and removed lines must equal the file's line at their place, hunks must
    ascend, a deleted file must exist; one failure rejects the whole patch.
    """
    target = F.coalesce("old_path", "new_path")
    touched = hunks.where(F.col("old_line").isNotNull()).select(target.alias("path")).distinct()
    lines = files.join(touched, "path", "left_semi").select("path", F.posexplode(keep_ends("text")).alias("_i", "_line")).select(
        F.col("path").alias("_p"), (F.col("_i") + 1).alias("_n"), "_line"
    )
    must = hunks.where(F.col("old_line").isNotNull()).withColumn("_p", target)
    compared = must.join(lines, (must["_p"] == lines["_p"]) & (F.col("old_line") == F.col("_n")), "left")
    bad_lines = compared.where(~F.col("content").eqNullSafe(F.col("_line"))).groupBy("patch_id").agg(F.count("*").alias("bad"))

    ends = hunks.where(F.col("hunk_no").isNotNull()).groupBy("patch_id", "file_no", "hunk_no").agg(
        F.greatest(F.first("old_start") - 1, F.lit(0)).alias("start"), F.count("old_line").alias("used")
    )
    prev = ends.select("patch_id", "file_no", (F.col("hunk_no") + 1).alias("hunk_no"), (F.col("start") + F.col("used")).alias("_end"))
    order = ends.join(prev, ["patch_id", "file_no", "hunk_no"]).where(F.col("start") < F.col("_end"))
    order = order.groupBy("patch_id").agg(F.count("*").alias("bad"))

    gone = hunks.where(F.col("new_path").isNull() & F.col("old_path").isNotNull()).select("patch_id", F.col("old_path").alias("path")).distinct()
    gone = gone.join(files.select("path"), "path", "left_anti").groupBy("patch_id").agg(F.count("*").alias("bad"))
    broken = hunks.where(F.col("problem").isNotNull()).groupBy("patch_id").agg(F.count("*").alias("bad"))

    bad = bad_lines.unionByName(order).unionByName(gone).unionByName(broken).groupBy("patch_id").agg(F.sum("bad").alias("mismatches"))
    out = hunks.select("patch_id").distinct().join(bad, "patch_id", "left")
    return out.select("patch_id", F.col("mismatches").isNull().alias("ok"), F.coalesce("mismatches", F.lit(0)).alias("mismatches"))


def patch_paths(patches: DataFrame) -> DataFrame:
    """(patch_id, path): distinct file paths of diff headers."""
    heads = F.regexp_extract_all("text", F.lit(r"(?m)^(?:\+\+\+|---) ([^\t\r\n]*)"), 1)
    clean = F.transform(heads, lambda p: F.regexp_replace(F.trim(p), r"^[ab]/", ""))
    return patches.select("patch_id", F.explode(F.array_distinct(F.filter(clean, lambda p: p != "/dev/null"))).alias("path"))


def patch_scope(paths: DataFrame, excludes: Sequence[str]) -> DataFrame:
    """``reason`` per touched path: traversal, out of scope, or null when fine."""
    p = P.posix_path("path")
    outside = p.rlike(r"^/|^[A-Za-z]:") | P.matches_any(p, excludes)
    reason = F.when(p.rlike(r"(^|/)\.\.(/|$)"), "Illegal path traversal").when(outside, "Out-of-scope path")
    return paths.withColumn("reason", reason)


def patch_limits(
    sizes: DataFrame, max_file_bytes: int = 2_000_000, max_total_bytes: int = 10_000_000, max_hunks: int = 200,
    max_path: int = 240, deny: Sequence[str] = (), max_files: int = 0,
) -> DataFrame:
    """(patch_id, path, problems). Input: patch_id, path, bytes, hunks.

    Patch totals are a partial aggregate joined back, not a window over a patch.
    """
    total = sizes.groupBy("patch_id").agg(F.sum("bytes").alias("_total"), F.countDistinct("path").alias("_files"))
    j = sizes.join(total, "patch_id")
    probs = [
        F.when(F.col("bytes") > max_file_bytes, "file_bytes"), F.when(F.col("_total") > max_total_bytes, "total_bytes"),
        F.when(F.col("hunks") > max_hunks, "hunks"), F.when(F.length("path") > max_path, "path_length"),
        F.when(P.matches_any("path", deny), "denied"), F.when(F.lit(max_files > 0) & (F.col("_files") > max_files), "files"),
    ]
    return j.select("patch_id", "path", F.array_compact(F.array(*probs)).alias("problems"))
