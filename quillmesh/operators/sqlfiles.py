"""SQL sources: statements, facts per file, table references, objects per line."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import sqltext as S
from ..functions import text as X
from .lines import to_lines

# Quoted pieces run to their closing quote or to the end of the text.
_SQ = r"'(?:[^'\\]++|\\'|''|\\)*+(?:'|\z)"
_DQ = r'"(?:[^"\\]++|\\"|\\)*+(?:"|\z)'
_BQ = r"`[^`]*+(?:`|\z)"
_TOKENS = rf"(?s)({_SQ}|{_DQ}|{_BQ}|--[^\n\r]*+[\n\r]?|#[^\n\r]*+[\n\r]?|/\*.*?(?:\*/|\z)|[^'\"`#/-]++|.)"
_SPLIT = r"(?s)('(?:[^']++|'')*+(?:'|\z)|\"[^\"]*+(?:\"|\z)|`[^`]*+(?:`|\z)|;|[^'\"`;]++)"


def without_comments(text) -> Column:
    """Comments out, string literals and quoted names untouched."""
    toks = F.regexp_extract_all(P.col(text), F.lit(_TOKENS), 1)
    clean = F.transform(
        toks, lambda t: F.when(t.startswith("--") | t.startswith("#"), "\n").when(t.startswith("/*"), " ").otherwise(t)
    )
    return F.array_join(clean, "")


def statement_array(text) -> Column:
    """Trimmed statements: cut at semicolons outside quotes."""
    toks = F.regexp_extract_all(without_comments(text), F.lit(_SPLIT), 1)
    return _between_semicolons(toks)


# A mark that no text can hold once its own first character is escaped.
_ESCAPED, _MARK = "\x01\x02", "\x01\x03"


def _between_semicolons(toks: Column) -> Column:
    """The trimmed, non-empty texts between the semicolon tokens."""
    marked = F.transform(toks, lambda t: F.when(t == ";", _MARK).otherwise(F.replace(t, F.lit("\x01"), F.lit(_ESCAPED))))
    parts = F.split(F.array_join(marked, ""), _MARK)
    return F.filter(F.transform(parts, lambda s: X.strip(F.replace(s, F.lit(_ESCAPED), F.lit("\x01")))), lambda s: s != "")


def sql_statements(files: DataFrame) -> DataFrame:
    """(path, i from 1, stmt) of every .sql file."""
    own = files.where(F.lower("path").endswith(".sql"))
    return own.select("path", F.posexplode(statement_array("text")).alias("_i", "stmt")).select("path", (F.col("_i") + 1).alias("i"), "stmt")


def sql_statement_facts(statements: DataFrame, fixed: bool = False) -> DataFrame:
    """Kind, tables, constraints, parameters, dangers and hints of each statement."""
    named, positional, qmark = S.sql_params("stmt")
    return statements.select(
        "path",
        "i",
        S.classify_stmt("stmt").alias("kind"),
        *[S.tables_in("stmt", r, fixed).alias(r) for r in S.TABLE_PATTERNS],
        *[c.alias(n) for n, c in S.sql_constraints("stmt").items()],
        *[c.alias(n) for n, c in S.danger_flags("stmt").items()],
        *[S.created_name("stmt", w).alias(w) for w in S.CREATORS],
        named.alias("named"),
        positional.alias("positional"),
        qmark.alias("qmark"),
        S.dialect_hints("stmt").alias("hints"),
    )


def sql_facts(statement_facts: DataFrame) -> DataFrame:
    """One row per file. Arrays hold a single file's distinct values only."""
    as_set = lambda c: F.array_sort(F.array_distinct(F.flatten(F.collect_list(c)))).alias(c)
    sums = [*S.CONSTRAINTS, *S.DANGERS, "qmark"]
    return statement_facts.groupBy("path").agg(
        F.count("*").alias("statements"),
        *[as_set(c) for c in (*S.TABLE_PATTERNS, "named", "positional", "hints")],
        *[F.sum(c).alias(c) for c in sums],
        *[F.array_sort(F.collect_list(c)).alias(c) for c in S.CREATORS],
    )


def sql_kinds(statement_facts: DataFrame) -> DataFrame:
    return statement_facts.groupBy("kind").agg(F.count("*").alias("statements"))


def sql_top_tables(statement_facts: DataFrame, n: int = 20) -> DataFrame:
    """Tables by the number of files that reference them."""
    pairs = statement_facts.select("path", F.explode("referenced").alias("table")).distinct()
    return pairs.groupBy("table").agg(F.count("*").alias("files")).orderBy(F.desc("files"), "table").limit(n)


def sql_summary(statement_facts: DataFrame) -> DataFrame:
    """One row: statements, distinct tables per role, dangers."""
    dangers = sum((F.col(d) for d in S.DANGERS), F.lit(0))
    base = statement_facts.agg(F.countDistinct("path").alias("files"), F.count("*").alias("statements"), F.sum(dangers).alias("danger_total"))
    roles = ["referenced", "created", "dropped"]

    def used(role: str) -> Column:
        return F.transform(role, lambda t: F.struct(F.lit(role).alias("role"), t.alias("table")))

    uses = statement_facts.select(F.inline(F.concat(*[used(r) for r in roles])))
    counts = uses.distinct().groupBy("role").agg(F.count("*").alias("n"))
    one = counts.agg(*[F.coalesce(F.max(F.when(F.col("role") == r, F.col("n"))), F.lit(0)).alias(f"{r}_tables") for r in roles])
    return base.withColumn("_k", F.lit(1)).join(one.withColumn("_k", F.lit(1)), "_k").drop("_k")


# Reference patterns of the per-file graph and of the line index.
REF_PATTERNS = [
    r'(?i)\bfrom\s+([A-Za-z0-9_."`\[\]]+)',
    r'(?i)\bjoin\s+([A-Za-z0-9_."`\[\]]+)',
    r'(?i)\binsert\s+into\s+([A-Za-z0-9_."`\[\]]+)',
    r'(?i)\bupdate\s+([A-Za-z0-9_."`\[\]]+)',
    r'(?i)\bdelete\s+from\s+([A-Za-z0-9_."`\[\]]+)',
]
DEF = r"(?i)^\s*CREATE\s+(?:OR\s+REPLACE\s+)?(TABLE|VIEW|FUNCTION|PROCEDURE|TRIGGER|INDEX)\s+([^\s(]+)"
EXEC = r"(?i)\b(?:EXEC|EXECUTE|CALL)\s+([^\s(;,]+)"
USES = r"(?i)\b(?:FROM|JOIN|UPDATE|INTO|DELETE\s+FROM|MERGE\s+INTO)\s+([^\s,;()]+)"


def sql_refs(files: DataFrame) -> DataFrame:
    """(path, stmt_no from 1, dialect, table) references; comments are not stripped here."""
    own = files.where(F.lower("path").endswith(".sql"))
    toks = F.regexp_extract_all("text", F.lit(r"(?s)('[^']*+'|\"[^\"]*+\"|;|[^'\";]++|['\"])"), 1)
    rows = own.select("path", F.posexplode(_between_semicolons(toks)).alias("_i", "_s"))
    found = F.concat(*[F.regexp_extract_all("_s", F.lit(p), 1) for p in REF_PATTERNS])
    return rows.select("path", (F.col("_i") + 1).alias("stmt_no"), S.plugin_dialect("_s").alias("dialect"), F.explode(found).alias("table"))


def sql_objects(files: DataFrame) -> DataFrame:
    """(path, line_no, role, kind, name): definitions, calls and table uses per line."""
    own = files.where(F.lower("path").endswith(".sql")).select("path", S.strip_sql_comments("text").alias("text"))
    ln = to_lines(own)
    entry = lambda role, kind, name: F.struct(F.lit(role).alias("role"), kind.alias("kind"), name.alias("name"))
    made = F.when(
        F.col("line").rlike(DEF),
        F.array(entry("def", F.upper(F.regexp_extract("line", DEF, 1)), S.canon_sql_name(F.regexp_extract("line", DEF, 2)))),
    ).otherwise(F.array())
    calls = F.transform(F.regexp_extract_all("line", F.lit(EXEC), 1), lambda n: entry("ref", F.lit("proc"), S.canon_sql_name(n)))
    uses = F.transform(F.regexp_extract_all("line", F.lit(USES), 1), lambda n: entry("ref", F.lit("table_or_view"), S.canon_sql_name(F.rtrim(n))))
    kept = F.filter(uses, lambda e: ~F.contains(e["name"], F.lit("(")) & ~F.upper(e["name"]).startswith("SELECT"))
    return ln.select("path", "line_no", F.inline(F.concat(made, calls, kept)))
