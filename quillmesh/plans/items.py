"""Item, response, edit and patch queries."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..operators import edits as E
from ..operators import items as I
from .registry import FILES, query

# ---- items -----------------------------------------------------------------------------


@query("normalize_item_keys", "SELECT doc_id::VARCHAR AS id, source || '/' || doc_id AS filepath, doc_id AS lineno, lang AS symbol_type FROM documents")
def _(t):
    d = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/"), F.col("doc_id").cast("string")).alias("file"), F.col("doc_id").alias("line"), F.col("lang").alias("filetype"))
    return I.normalize_item_keys(d).select("id", "filepath", "lineno", "symbol_type")


@query("enrich_items", f"SELECT doc_id::VARCHAR AS id, path AS relpath, '/root/w/' || path AS path, 'text' AS lang FROM {FILES} WHERE path NOT LIKE 'src1/%'")
def _(t):
    f = t.files.select(F.col("doc_id").alias("id"), F.concat(F.lit("\\root\\w\\"), F.translate("path", "/", "\\")).alias("filepath"))
    return I.enrich_items(f, "/root/w", ["src1/*"]).select("id", "relpath", "path", "lang")


def _docs(t):
    return t.documents.select(F.col("doc_id").cast("string").alias("id"), F.concat("source", F.lit("/x")).alias("relpath"), F.col("text").alias("docstring"))


_CHECKS = r"""(SELECT doc_id::VARCHAR AS id, regexp_replace(text, '^\s+|\s+$', '', 'g') = '' AS empty, contains(text, repeat(chr(34), 3)) OR contains(text, repeat(chr(39), 3)) AS quotes,
    starts_with(text, chr(10)) AND ends_with(text, chr(10)) AS framed, len(list_filter(l, lambda x: regexp_matches(x, '[ \t]$'))) > 0 AS blanks, len(list_filter(l, lambda x: length(x) > 72)) AS over,
    list_filter(list_transform(l, lambda x: regexp_replace(x, '^\s+|\s+$', '', 'g')), lambda x: x <> '')[1] AS s FROM (SELECT *, string_split(text, chr(10)) AS l FROM documents))"""
_TAIL = "CASE WHEN len(regexp_split_to_array(s, '\\s+')) < 3 THEN 'summary line is very short' END, CASE WHEN right(s, 1) NOT IN ('.', '!', '?') THEN 'summary should end with punctuation' END"


@query(
    "verify_items",
    f"""SELECT id, concat_ws(';', CASE WHEN empty THEN 'empty docstring' END, CASE WHEN quotes THEN 'docstring contains triple quotes' END, CASE WHEN s IS NULL THEN 'missing summary line' END) AS errors,
    concat_ws(';', CASE WHEN NOT framed THEN 'docstring should start and end with a newline' END, CASE WHEN blanks THEN 'trailing whitespace detected' END, CASE WHEN over > 0 THEN over || ' line(s) exceed width 72' END, {_TAIL}) AS warnings,
    NOT (empty OR quotes) AS allowed FROM {_CHECKS}""",
)
def _(t):
    r, _ = I.verify_items(_docs(t))
    return r.select("id", F.array_join("errors", ";").alias("errors"), F.array_join("warnings", ";").alias("warnings"), "allowed")


@query(
    "verify_items_strict",
    f"""SELECT id, concat_ws(';', CASE WHEN empty THEN 'empty docstring' END, CASE WHEN quotes THEN 'docstring contains triple quotes' END, CASE WHEN NOT framed THEN 'docstring must start and end with a newline' END,
    CASE WHEN blanks THEN 'trailing whitespace detected' END, CASE WHEN over > 0 THEN 'lines exceed width 72' END, CASE WHEN s IS NULL THEN 'missing summary line' END) AS errors FROM {_CHECKS}""",
)
def _(t):
    r, _ = I.verify_items(_docs(t), "strict")
    return r.select("id", F.array_join("errors", ";").alias("errors"))


@query("require_edits", f"SELECT path FROM {FILES} WHERE lang <> 'fr' AND lang <> 'de'")
def _(t):
    path = F.when(F.col("lang") == "fr", F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    f = t.files.select(path.alias("filepath"), F.when(F.col("lang") == "es", F.lit("e")).alias("edits"), F.when(F.col("lang") == "en", F.lit("diff")).alias("patch"))
    return I.require_edits(f).select(F.col("filepath").alias("path"))


@query(
    "coerce_edits",
    """SELECT doc_id, CASE lang WHEN 'en' THEN 'insert:5:' || source || ',replace:2-3:x' WHEN 'fr' THEN 'insert:7:d' WHEN 'de' THEN 'insert:' || doc_id || ':plain' ELSE '' END AS edits, true AS ok FROM documents""",
)
def _(t):
    item = (
        F.when(F.col("lang") == "en", F.concat(F.lit('{"lineno":5,"edits":[{"docstring":{"text":"'), "source", F.lit('"}},{"start_line":2,"end_line":3,"text":"x"},{"bad":1}]}')))
        .when(F.col("lang") == "fr", '{"edits":[],"docstring":{"text":"d","lineno":7}}')
        .when(F.col("lang") == "de", F.concat(F.lit('{"text":"plain","lineno":'), F.col("doc_id").cast("string"), F.lit("}")))
        .otherwise('{"patch":"--- a"}')
    )
    c = I.coerce_edits(t.documents.select("doc_id", item.alias("item")))
    span = lambda e: F.coalesce(e["lineno"].cast("string"), F.concat_ws("-", e["start_line"].cast("string"), e["end_line"].cast("string")))
    return c.select("doc_id", F.array_join(F.transform("edits", lambda e: F.concat_ws(":", e["type"], span(e), e["text"])), ",").alias("edits"), "ok")


@query(
    "parse_responses",
    """SELECT conv_id || ':' || turn AS id, 1 AS item_no, conv_id || ':' || turn AS item_id, role FROM conversations WHERE (conv_id + turn) % 5 < 4""",
)
def _(t):
    r = I.parse_responses(t.derived("responses"))
    return r.select("id", "item_no", F.get_json_object("item", "$.id").alias("item_id"), F.get_json_object("item", "$.role").alias("role"))


@query(
    "build_prompts",
    """SELECT doc_id AS id, sha256('Target file: f' || doc_id || chr(10) || 'Symbol: ' || lang || ' (line 0)' || chr(10) || 'Signature: ' || source || chr(10) || 'Source snippet:' || chr(10) ||
    text || chr(10) || chr(10) || 'Instructions:' || chr(10) ||
    'Add or fix the Python docstring for the referenced symbol. Keep it accurate, PEP 257 compliant, and do not change code behavior.' || chr(10) || chr(10) ||
    'Return EXACTLY one JSON object with an `items` array. No markdown.') AS h FROM documents""",
)
def _(t):
    null = F.lit(None).cast("string")
    items = t.documents.select(F.col("doc_id").alias("id"), F.concat(F.lit("f"), F.col("doc_id").cast("string")).alias("filepath"), F.col("lang").alias("name"), F.lit(None).cast("int").alias("lineno"), null.alias("description"), F.col("source").alias("signature"), F.col("text").alias("source"))
    return I.build_prompts(items).select("id", F.sha2("prompt", 256).alias("h"))


# ---- edits and patches -------------------------------------------------------------------


@query(
    "apply_line_edits",
    f"""SELECT path, sha256('top' || chr(10) || CASE WHEN n > 1 THEN array_to_string(l[2:], chr(10)) ELSE '' END || CASE WHEN n > 1 AND NOT ends_with(text, chr(10)) THEN chr(10) ELSE '' END || 'end' || chr(10)) AS h
    FROM (SELECT path, text, string_split(text, chr(10)) AS l, len(string_split(text, chr(10))) AS n FROM {FILES})""",
)
def _(t):
    ops = [(1, "insert", None, None, "file_start", "top"), (2, "delete", 2, 2, None, None), (3, "insert", None, None, "file_end", "end\n")]
    cols = F.array(*[F.struct(F.lit(s).alias("seq"), F.lit(o).alias("op"), F.lit(a).cast("int").alias("start_line"), F.lit(b).cast("int").alias("end_line"), F.lit(an).cast("string").alias("anchor"), F.lit(tx).cast("string").alias("new_text")) for s, o, a, b, an, tx in ops])
    edits = t.files.select("path", F.inline(cols))
    return E.apply_line_edits(t.files.select("path", "text"), edits).select("path", F.sha2("text", 256).alias("h"))


@query("parse_hunks", "SELECT doc_id::VARCHAR AS patch_id, source || '/' || doc_id || '.txt' AS new_path, unnest(['-', '+']) AS tag, unnest([1, NULL]) AS old_line, unnest([NULL, 1]) AS new_line FROM documents")
def _(t):
    h = E.parse_hunks(t.derived("patches"))
    return h.where(F.col("tag").isNotNull()).select("patch_id", "new_path", "tag", "old_line", "new_line")


@query("validate_hunks", "SELECT doc_id::VARCHAR AS patch_id, doc_id % 2 = 0 AND contains(text, chr(10)) AS ok FROM documents")
def _(t):
    return E.validate_hunks(E.parse_hunks(t.derived("patches")), t.files).select("patch_id", "ok")


@query("patch_paths", "SELECT doc_id::VARCHAR AS patch_id, source || '/' || doc_id || '.txt' AS path FROM documents")
def _(t):
    return E.patch_paths(t.derived("patches"))


@query("patch_scope", f"SELECT path, CASE WHEN lang = 'fr' THEN 'Illegal path traversal' WHEN path LIKE 'src1/%' THEN 'Out-of-scope path' END AS reason FROM (SELECT lang, CASE WHEN lang = 'fr' THEN '../' || path ELSE path END AS path FROM {FILES})")
def _(t):
    path = F.when(F.col("lang") == "fr", F.concat(F.lit("../"), "path")).otherwise(F.col("path"))
    return E.patch_scope(t.files.select(path.alias("path")), ["src1/*"])


@query(
    "patch_limits",
    f"""SELECT path, concat_ws(',', CASE WHEN size > 5000 THEN 'file_bytes' END, CASE WHEN total > 100000 THEN 'total_bytes' END, CASE WHEN doc_id % 300 > 200 THEN 'hunks' END, CASE WHEN path LIKE '%7.txt' THEN 'denied' END) AS problems
    FROM (SELECT *, sum(size) OVER (PARTITION BY source) AS total FROM {FILES})""",
)
def _(t):
    sizes = t.files.select(F.col("source").alias("patch_id"), "path", F.col("size").alias("bytes"), (F.col("doc_id") % 300).alias("hunks"))
    r = E.patch_limits(sizes, 5000, 100_000, 200, deny=["*7.txt"])
    return r.select("path", F.array_join("problems", ",").alias("problems"))


@query(
    "prompt_rows",
    """SELECT doc_id AS id, '{"id":' || doc_id || ',"messages":[{"role":"user","content":"' || lang || ' ' || source || '"}]}' AS value FROM documents""",
)
def _(t):
    return I.prompt_rows(t.documents.select(F.col("doc_id").alias("id"), F.concat_ws(" ", "lang", "source").alias("prompt")))
