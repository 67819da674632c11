"""Environment variables: declared, required and used."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X

# Key, placeholder and usage patterns.
KEY = r"^\s*(?:export\s+)?([A-Za-z_][A-Za-z0-9_]*)\s*="
BRACED = r"\$\{([A-Z][A-Z0-9_]*)(?::-[^}]*)?\}"
BARE = r"(?<![\w$])\$([A-Z][A-Z0-9_]*)\b"
CONFIG_EXTS = [".yml", ".yaml", ".json", ".toml", ".ini", ".cfg", ".conf"]
JS_EXTS = [".js", ".jsx", ".ts", ".tsx", ".mjs", ".cjs"]
JS_USES = [
    r"process\.env\.([A-Za-z_][A-Za-z0-9_]*)",
    r"process\.env\[\s*['\"]([A-Za-z_][A-Za-z0-9_]*)['\"]\s*\]",
    r"import\.meta\.env\.([A-Za-z_][A-Za-z0-9_]*)",
]


def env_file_vars(files: DataFrame) -> DataFrame:
    """Sorted distinct keys of every env file, their count, and the template flag."""
    own = files.where(X.is_env_name(P.basename("path")))
    keys = F.transform(X.lines_of("text"), lambda x: F.regexp_extract(X.strip_inline_comment(x), KEY, 1))
    return own.select(
        "path",
        F.array_sort(F.array_distinct(F.filter(keys, lambda k: k != ""))).alias("vars"),
        X.is_template_env(P.basename("path")).alias("is_template"),
    ).withColumn("count", F.size("vars").cast("bigint"))


def placeholders(text) -> Column:
    """Distinct ``${VAR}``, ``${VAR:-default}`` and ``$VAR`` names."""
    return F.array_union(F.regexp_extract_all(P.col(text), F.lit(BRACED), 1), F.regexp_extract_all(P.col(text), F.lit(BARE), 1))


def json_strings(text) -> Column:
    """String values of a JSON text, keys left out; null when it does not parse.

    A string literal followed by a colon is a key, every other literal is a value.
    """
    valid = F.try_parse_json(P.col(text)).isNotNull()
    literals = F.regexp_extract_all(P.col(text), F.lit(r'"(?:[^"\\]++|\\.)*+"(?:\s*:)?'), 0)
    return F.when(valid, F.filter(literals, lambda x: ~x.endswith(":")))


def env_required(files: DataFrame) -> DataFrame:
    """Variables config files ask for. JSON looks at string values only.

    TOML too: its strings need a parser, which sees the TOML files alone.
    """
    e = P.ext("path")
    own = files.where(e.isin(*CONFIG_EXTS) & ~X.is_env_name(P.basename("path"))).select("path", "text")
    own = own.where(e != ".toml").unionByName(toml_string_values(own.where(e == ".toml")))
    src = F.when(e == ".json", F.coalesce(F.array_join(json_strings("text"), "\n"), F.col("text"))).otherwise(F.col("text"))
    rows = own.select("path", F.array_sort(placeholders(src)).alias("vars"))
    return rows.where(F.size("vars") > 0).withColumn("count", F.size("vars").cast("bigint"))


def toml_string_values(files: DataFrame) -> DataFrame:
    """(path, text) with the text of a TOML file cut down to its string values."""
    def run(batches):
        import tomllib

        def strings(x):
            if isinstance(x, str):
                yield x
            elif isinstance(x, (dict, list)):
                for v in x.values() if isinstance(x, dict) else x:
                    yield from strings(v)

        def reduce(t):
            try:
                return "\n".join(strings(tomllib.loads(t)))
            except Exception:
                return t

        for pdf in batches:
            yield pdf.assign(text=pdf["text"].map(reduce))

    return files.select("path", "text").mapInPandas(run, "path string, text string")


def env_usage_js(files: DataFrame) -> DataFrame:
    """Variables and call count per JS/TS file."""
    found = F.concat(*[F.regexp_extract_all("text", F.lit(p), 1) for p in JS_USES])
    rows = files.where(P.ext("path").isin(*JS_EXTS)).select("path", found.alias("_f"))
    return rows.where(F.size("_f") > 0).select(
        "path", F.array_sort(F.array_distinct("_f")).alias("vars"), F.size("_f").cast("bigint").alias("calls")
    )


def env_usage_py(facts: DataFrame) -> DataFrame:
    """Variables and per-form call counts from the ``env`` facts of Python files."""
    env = facts.where(F.col("fact") == "env")
    form = lambda f: F.count(F.when(F.col("kind") == f, 1)).alias(f)
    return env.groupBy("path").agg(
        F.array_sort(F.collect_set("name")).alias("vars"), form("getenv"), form("environ_index"), form("environ_get")
    )


def env_summary(uses: DataFrame) -> DataFrame:
    """Files and distinct variables per source and overall (null source).

    Input: source, path, var. Rollup expands each pair once; nothing is collected.
    """
    return uses.rollup("source").agg(F.countDistinct("path").alias("files"), F.countDistinct("var").alias("vars"))


def union_vars(*sources: DataFrame) -> DataFrame:
    """Distinct variables over all sources."""
    out = sources[0].select("var")
    for s in sources[1:]:
        out = out.union(s.select("var"))
    return out.distinct()
