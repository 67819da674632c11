"""Entry points: main guards, scripts and configured commands."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .ordered import top_n

# Guard, shebang and extension sets.
GUARD = r"""(?m)^\s*if\s+__name__\s*==\s*['"]__main__['"]\s*:"""
DEF_MAIN = r"(?m)^\s*def\s+main\s*\("
SHEBANG = r"^#!\s*(\S+)"
SHELL_EXTS = [".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd"]
TEXT_EXTS = [
    ".py", ".pyi", ".pyw", ".sh", ".bash", ".zsh", ".ps1", ".bat", ".cmd", ".toml", ".cfg", ".ini", ".json", ".jsonc", ".md", ".txt",
]

CONFIG_SCHEMA = "path string, source string, name string, target string"


def file_entrypoints(files: DataFrame) -> DataFrame:
    """(path, kind, module, has_main_fn, interpreter) found in file texts."""
    e = P.ext("path")
    own = files.where(e.isin(*TEXT_EXTS, ""))
    first = F.regexp_extract("text", r"^[^\n\r]*", 0)
    dotted = F.when(e == ".py", F.translate(F.regexp_replace("path", r"(?i)\.py$", ""), "/", "."))
    null, no = F.lit(None).cast("string"), F.lit(None).cast("boolean")

    def entry(kind: str, module, has_main, interpreter):
        return F.struct(F.lit(kind).alias("kind"), module.alias("module"), has_main.alias("has_main_fn"), interpreter.alias("interpreter"))

    # The literal probe is part of the rule and spares most texts the pattern.
    guard = F.contains("text", F.lit("__main__")) & F.col("text").rlike(GUARD)
    py = F.when(guard, entry("entrypoint.python", dotted, F.col("text").rlike(DEF_MAIN), null))
    interp = F.nullif(F.regexp_extract(first, SHEBANG, 1), F.lit(""))
    sh = F.when(e.isin(*SHELL_EXTS) | first.rlike(SHEBANG), entry("entrypoint.shell", null, no, interp))
    return own.select("path", F.inline(F.array_compact(F.array(py, sh))))


def config_entrypoints(files: DataFrame) -> DataFrame:
    """(path, source, name, target) from pyproject, setup.cfg and package.json."""
    base = F.lower(P.basename("path"))
    pkg = files.where(base == "package.json")
    bin_field = F.get_json_object("text", "$.bin")
    name = F.coalesce(F.get_json_object("text", "$.name"), F.lit("<bin>"))
    as_map = F.from_json(bin_field, "map<string,string>")
    pairs = F.when(bin_field.startswith("{"), F.map_entries(as_map)).when(
        bin_field.isNotNull(), F.array(F.struct(name.alias("key"), bin_field.alias("value")))
    )
    js = pkg.select("path", F.inline(pairs).alias("name", "target")).select("path", F.lit("package.json.bin").alias("source"), "name", "target")
    ini = files.where(base.isin("pyproject.toml", "setup.cfg")).select("path", "text").mapInPandas(_config_rows, CONFIG_SCHEMA)
    return js.unionByName(ini)


def _config_rows(batches):
    import configparser
    import tomllib

    import pandas as pd

    def from_toml(text):
        data = tomllib.loads(text)
        proj, poetry = data.get("project") or {}, (data.get("tool") or {}).get("poetry") or {}
        tables = {
            "pyproject.project.scripts": proj.get("scripts"),
            "pyproject.project.gui-scripts": proj.get("gui-scripts"),
            "pyproject.tool.poetry.scripts": poetry.get("scripts"),
        }
        return [(src, str(n), str(t)) for src, table in tables.items() for n, t in (table or {}).items()]

    def from_ini(text):
        cp = configparser.ConfigParser()
        cp.read_string(text)
        section = "options.entry_points"
        for group, raw in cp.items(section) if cp.has_section(section) else ():
            for line in map(str.strip, (raw or "").splitlines()):
                if line and line[0] not in "#;":
                    name, eq, target = line.partition("=")
                    yield (f"setup.cfg[{group}]", name.strip(), target.strip()) if eq else (f"setup.cfg[{group}]", line, line)

    for pdf in batches:
        rows = []
        for path, text in zip(pdf["path"], pdf["text"]):
            try:
                found = list((from_toml if path.lower().endswith(".toml") else from_ini)(text or ""))
            except Exception:
                found = []
            rows += [(path, *f) for f in found]
        yield pd.DataFrame(rows, columns=["path", "source", "name", "target"])


def entrypoint_summary(found: DataFrame) -> DataFrame:
    return found.groupBy("kind").agg(F.count("*").alias("entries"))


def entrypoint_examples(found: DataFrame, n: int = 10) -> DataFrame:
    return top_n(found, ["kind"], ["path"], n, "n").select("kind", "n", "path")
