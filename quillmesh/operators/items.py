"""Items of the documentation loop: shape, prompts, responses, edits, verification."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P
from ..functions import text as X
from .records import lift_first

# Languages by extension.
LANGS = {".py": "python", ".js": "javascript", ".ts": "typescript", ".sql": "sql", ".sh": "shell", ".md": "markdown", ".txt": "text"}
EDITS_TYPE = "array<struct<type:string,lineno:int,start_line:int,end_line:int,text:string>>"


def normalize_item_keys(df: DataFrame) -> DataFrame:
    """path|file to filepath, line to lineno, filetype to symbol_type."""
    out = df.withColumn("filepath", lift_first(df, ["filepath", "path", "file"], True))
    out = out.withColumn("lineno", lift_first(df, ["lineno", "line"]).cast("bigint"))
    return out.withColumn("symbol_type", lift_first(df, ["symbol_type", "filetype"], True))


def enrich_items(df: DataFrame, root: str, exclude: Sequence[str]) -> DataFrame:
    """id, POSIX path, path relative to the root and language; excluded paths drop out."""
    p = P.posix_path(F.col("filepath"))
    prefix = root.rstrip("/") + "/"
    rel = F.when(p.startswith(prefix), F.substring(p, F.lit(len(prefix) + 1), F.length(p))).otherwise(P.strip_root(p))
    langs = F.create_map(*[F.lit(v) for kv in LANGS.items() for v in kv])
    rows = df.withColumn("relpath", rel).where(~P.matches_any("relpath", exclude))
    ident = F.coalesce(*[F.col(c).cast("string") for c in ("id", "unique_key_hash", "name") if c in df.columns], F.col("relpath"))
    return rows.withColumn("id", ident).withColumn("path", F.concat(F.lit(prefix), F.col("relpath"))).withColumn(
        "lang", F.coalesce(F.try_element_at(langs, P.ext("relpath")), F.lit("text"))
    )


def to_index_row(entries: DataFrame, status: str = "active") -> DataFrame:
    """Index rows: function before class before module; hash of the natural key.

    Input: path, class, function, line, summary.
    """
    p = P.posix_path(F.trim("path"))
    fn, cls = F.nullif(F.col("function"), F.lit("-")), F.nullif(F.col("class"), F.lit("-"))
    line = F.coalesce(F.nullif(F.col("line"), F.lit(0)), F.lit(1)).cast("bigint")
    name = F.coalesce(fn, cls, F.nullif(P.stem(p), F.lit("")), F.lit("unknown"))
    kind = F.when(fn.isNotNull(), "function").when(cls.isNotNull(), "class").otherwise("module")
    rows = entries.select(
        p.alias("filepath"), kind.alias("symbol_type"), name.alias("name"), line.alias("lineno"), F.trim("summary").alias("description"),
        F.lit(status).alias("status"),
    )
    return rows.withColumn("unique_key_hash", H.symbol_hash("filepath", "symbol_type", "name", "lineno"))


def scan_outcomes(flagged: DataFrame) -> DataFrame:
    """One row: entries written, duplicates, bad ones and good ones. Input: verdict."""
    count = lambda c: F.count(F.when(c, 1))
    v = F.col("verdict")
    return flagged.agg(
        F.count("*").alias("entries"), count(~v.startswith("Duplicate")).alias("written"), count(v.startswith("Duplicate")).alias("duplicates"),
        count(v == "Bad docstring").alias("bad"), count(v == "keep").alias("ok"),
    )


def verify_items(items: DataFrame, policy: str = "lenient", width: int = 72) -> tuple[DataFrame, DataFrame]:
    """(reports with errors and warnings per item, rows that pass).

    Input: id, relpath, docstring. Everything is one narrow projection.
    """
    strict = policy == "strict"
    ds = F.coalesce("docstring", F.lit(""))
    rel, ident = F.coalesce("relpath", F.lit("")), F.coalesce(F.col("id").cast("string"), F.lit(""))
    base = items.withColumn("_l", F.when(ds == "", F.array().cast("array<string>")).otherwise(X.lines_of(ds)))
    lines = F.col("_l")
    over = F.size(F.filter(lines, lambda x: F.length(x) > width))
    first = F.get(F.filter(F.transform(lines, lambda x: X.strip(x)), lambda x: x != ""), 0)
    framed = ds.startswith("\n") & ds.endswith("\n")
    blanks = F.exists(lines, lambda x: x.rlike(r"[ \t]\z"))
    critical = [
        F.when(ident == "", "missing id"),
        F.when(rel == "", "missing relpath/filepath"),
        F.when(X.strip(ds) == "", "empty docstring"),
        F.when(F.contains(ds, F.lit('"""')) | F.contains(ds, F.lit("'''")), "docstring contains triple quotes"),
    ]
    soft = [
        F.when(~framed, f"docstring {'must' if strict else 'should'} start and end with a newline"),
        F.when(blanks, "trailing whitespace detected"),
        F.when(over > 0, F.lit(f"lines exceed width {width}") if strict else F.concat(over.cast("string"), F.lit(f" line(s) exceed width {width}"))),
    ]
    no_summary = F.when(first.isNull(), "missing summary line")
    hints = [
        F.when(F.size(F.split(first, X.BLANK + "+")) < 3, "summary line is very short"),
        F.when(~F.substring(first, -1, 1).isin(".", "!", "?"), "summary should end with punctuation"),
    ]
    errors = F.array_compact(F.array(*critical, *(soft if strict else []), no_summary))
    warnings = F.array_compact(F.array(*([] if strict else soft), *hints))
    fatal = F.size(F.array_compact(F.array(*critical))) > 0
    allow = (F.size("errors") == 0) if strict else ~F.col("_fatal")
    checked = base.withColumn("errors", errors).withColumn("warnings", warnings).withColumn("_fatal", fatal).withColumn("allowed", allow)
    checked = checked.drop("_l", "_fatal")
    return checked.select("id", "errors", "warnings", "allowed"), checked.where("allowed").drop("errors", "warnings", "allowed")


def require_edits(items: DataFrame) -> DataFrame:
    """Structural check: a path inside the root and edits or a patch."""
    has = F.col("edits").isNotNull() | (F.coalesce(lift_first(items, ["patch", "diff"], True), F.lit("")) != "")
    return items.where((F.coalesce("filepath", F.lit("")) != "") & P.safe_relative("filepath") & has)


def coerce_edits(items: DataFrame) -> DataFrame:
    """Canonical ``edits`` of JSON items, and ``ok``: has edits, a patch or a diff.

    Input: id, item (JSON object text). Accepts a list, one object, a docstring object
    or a plain text, in that order.
    """
    g = lambda path: F.get_json_object("item", path)
    line0 = F.coalesce(g("$.lineno").cast("int"), F.lit(1))
    raw = F.from_json(g("$.edits"), "array<string>")
    listed = F.when(g("$.edits").startswith("["), raw).when(g("$.edits").startswith("{"), F.array(g("$.edits")))
    edits = F.filter(F.transform(F.coalesce(listed, F.array()), lambda e: _coerce_edit(e, line0)), lambda e: e.isNotNull())
    doc = F.when(g("$.docstring.text").isNotNull(), F.array(_insert(F.coalesce(g("$.docstring.lineno").cast("int"), line0), g("$.docstring.text"))))
    text = F.when(g("$.text").isNotNull(), F.array(_insert(line0, g("$.text"))))
    none = F.array().cast(EDITS_TYPE)
    best = F.when(F.size(edits) > 0, edits).otherwise(F.coalesce(doc, text, none))
    rows = items.withColumn("edits", best.cast(EDITS_TYPE))
    return rows.withColumn("ok", (F.size("edits") > 0) | F.coalesce(g("$.patch"), g("$.diff")).isNotNull())


def _edit(kind: Column, lineno: Column, start: Column, end: Column, text: Column) -> Column:
    return F.struct(kind.alias("type"), lineno.alias("lineno"), start.alias("start_line"), end.alias("end_line"), text.alias("text"))


def _insert(lineno: Column, text: Column) -> Column:
    null = F.lit(None).cast("int")
    return _edit(F.lit("insert"), lineno, null, null, text)


def _coerce_edit(e: Column, fallback: Column) -> Column:
    g = lambda path: F.get_json_object(e, path)
    num = lambda k: g(f"$.{k}").cast("int")
    text, kind = g("$.text"), g("$.type")
    standard = kind.isin("insert", "replace") & text.isNotNull()
    placed = F.coalesce(num("lineno"), num("line"))
    return (
        F.when(standard, _edit(kind, num("lineno"), num("start_line"), num("end_line"), text))
        .when(g("$.docstring.text").isNotNull(), _insert(F.coalesce(num("docstring.lineno"), fallback), g("$.docstring.text")))
        .when(text.isNotNull() & placed.isNotNull(), _insert(F.coalesce(F.nullif(placed, F.lit(0)), fallback), text))
        .when(text.isNotNull() & num("start_line").isNotNull() & num("end_line").isNotNull(),
              _edit(F.lit("replace"), F.lit(None).cast("int"), num("start_line"), num("end_line"), text))
    )


def parse_responses(df: DataFrame) -> DataFrame:
    """(id, item_no, item) from raw model answers: object items only.

    Whole-text JSON is read in the JVM. Only answers that are not JSON as they stand go
    to a Python helper that reads the first JSON value in the prose.
    """
    t = X.strip_fences(F.coalesce("raw", F.lit("")))
    rows = df.select("id", t.alias("t")).where(F.col("t") != "")
    valid = F.try_parse_json("t").isNotNull()
    direct = rows.where(valid)
    prose = rows.where(~valid & F.col("t").rlike(r"[{\[]")).withColumn("t", _first_json("t")).where(F.col("t").isNotNull())
    both = direct.unionByName(prose)
    inner = F.get_json_object("t", "$.choices[0].message.content")
    direct_list = _item_list("t")
    unwrapped = X.strip_fences(inner)
    items = F.coalesce(direct_list, F.when(F.try_parse_json(unwrapped).isNotNull(), _item_list(unwrapped)))
    objects = F.filter(items, lambda x: x.startswith("{"))
    return both.select("id", F.posexplode(objects).alias("_i", "item")).select("id", (F.col("_i") + 1).alias("item_no"), "item")


def _item_list(t) -> Column:
    """The list of an answer: itself, ``items`` or ``results``; null if none."""
    c = F.trim(P.col(t))
    pick = lambda k: F.when(F.get_json_object(c, f"$.{k}").startswith("["), F.get_json_object(c, f"$.{k}"))
    raw = F.when(c.startswith("["), c).otherwise(F.coalesce(pick("items"), pick("results")))
    return F.transform(F.from_json(raw, "array<string>"), lambda x: F.ltrim(x))


def _first_json(c):
    @F.pandas_udf("string")
    def run(s):
        import json
        import re

        read = json.JSONDecoder().raw_decode

        def first(t):
            m = re.search(r"[{\[]", t or "")
            try:
                return json.dumps(read(t, m.start())[0], ensure_ascii=False) if m else None
            except ValueError:
                return None

        return s.map(first)

    return run(c)


# Wording of the prompt.
INSTRUCTIONS = (
    "Add or fix the Python docstring for the referenced symbol. "
    "Keep it accurate, PEP 257 compliant, and do not change code behavior."
)
CLOSING = "Return EXACTLY one JSON object with an `items` array. No markdown."


def build_prompts(items: DataFrame, max_source: int | None = None) -> DataFrame:
    """(id, prompt): filled fields only; the source is whole unless ``max_source`` cuts it."""
    line = lambda label, c: F.when(F.coalesce(F.col(c), F.lit("")) != "", F.concat(F.lit(label), F.col(c)))
    snippet = F.col("source") if max_source is None else X.truncate("source", max_source)
    name = F.coalesce(F.nullif("name", F.lit("")), F.col("id").cast("string"), F.lit("<unknown symbol>"))
    parts = [
        F.concat(F.lit("Target file: "), F.coalesce(F.nullif("filepath", F.lit("")), F.lit("UNKNOWN_FILE"))),
        F.concat(F.lit("Symbol: "), name, F.lit(" (line "), F.coalesce("lineno", F.lit(0)).cast("string"), F.lit(")")),
        line("Current description: ", "description"),
        line("Signature: ", "signature"),
        F.when(F.coalesce("source", F.lit("")) != "", F.concat(F.lit("Source snippet:\n"), snippet)),
        F.lit("\nInstructions:\n" + INSTRUCTIONS),
        F.lit("\n" + CLOSING),
    ]
    return items.select("id", F.concat_ws("\n", *parts).alias("prompt"))


def prompt_rows(prompts: DataFrame) -> DataFrame:
    """(id, value): one JSONL line per item with its message list."""
    msg = F.array(F.struct(F.lit("user").alias("role"), F.col("prompt").alias("content")))
    return prompts.select("id", F.to_json(F.struct(F.col("id"), msg.alias("messages"))).alias("value"))
