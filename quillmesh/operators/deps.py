"""Declared dependencies and the one version that counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from ..functions import text as X
from .lines import to_lines
from .ordered import first_seen

# Source ranks, requirement pattern and option prefixes.
SOURCES = ["poetry_lock", "requirements", "pyproject", "setup_cfg"]
REQUIREMENT = r"^\s*([A-Za-z0-9_.-]+)(?:\[[^\]]*\])?\s*(?:(===|==|~=|>=|<=|!=|>|<)\s*([A-Za-z0-9*_.+-]+))?"
OPTIONS = [
    "-r", "--requirement", "-c", "--constraint", "-f", "--find-links", "--extra-index-url", "--index-url",
]


def is_requirements(path):
    return F.lower(P.basename(path)).rlike(r"^requirements(\..*)?\.txt$")


def deps_requirements(files: DataFrame) -> DataFrame:
    """(path, line_no, package, version) of requirement lines."""
    ln = to_lines(files.where(is_requirements("path")))
    skip = F.col("line").rlike(r"^\s*(#|" + "|".join(OPTIONS) + ")")
    editable = F.col("line").rlike(r"^\s*(-e|--editable)")
    rows = ln.where(X.has_ink("line") & ~skip).select(
        "path",
        "line_no",
        F.when(editable, F.regexp_extract("line", r"#egg=([A-Za-z0-9_.-]+)", 1)).otherwise(F.regexp_extract("line", REQUIREMENT, 1)).alias("package"),
        F.when(~editable, F.nullif(F.regexp_extract("line", REQUIREMENT, 3), F.lit(""))).alias("version"),
    )
    return rows.where(F.col("package") != "")


LEAVES = "path string, leaves array<struct<at: array<string>, value: string>>"


def config_leaves(files: DataFrame) -> DataFrame:
    """(path, leaves): every value of a TOML or INI file under the keys and list positions that lead to it, in
    file order. Values that are no strings, and empty tables, are null; a file that does not parse has none."""
    def run(batches):
        import configparser
        import tomllib

        import pandas as pd

        def parse(path, text):
            if not path.lower().endswith(".cfg"):
                return tomllib.loads(text)
            ini = configparser.ConfigParser()
            ini.read_string(text)
            return {name: dict(ini.items(name, raw=True)) for name in ini.sections()}

        def leaves(path, text):
            try:
                todo = [([], parse(path, text or ""))]
            except (ValueError, RecursionError, configparser.Error):
                return []
            out = []
            while todo:
                at, node = todo.pop()
                below = list(node.items() if isinstance(node, dict) else enumerate(node)) if isinstance(node, (dict, list)) else []
                if not below:
                    out.append({"at": at, "value": node if isinstance(node, str) else None})
                todo += [([*at, str(k)], v) for k, v in reversed(below)]
            return out

        for pdf in batches:
            yield pd.DataFrame({"path": pdf["path"], "leaves": [leaves(p, t) for p, t in zip(pdf["path"], pdf["text"])]})

    return files.select("path", "text").mapInPandas(run, LEAVES)


def _specs(texts: Column) -> Column:
    """Requirement strings as (package, version)."""
    trimmed = F.transform(texts, lambda s: F.trim(s))
    pairs = F.transform(trimmed, lambda s: F.struct(F.regexp_extract(s, REQUIREMENT, 1).alias("package"), F.nullif(F.regexp_extract(s, REQUIREMENT, 3), F.lit("")).alias("version")))
    return F.filter(pairs, lambda p: p["package"] != "")


def _strings(leaves: Column) -> Column:
    return F.filter(F.transform(leaves, lambda x: x["value"]), lambda v: v.isNotNull())


def _named(leaves: Column, depth: int) -> Column:
    """Entries whose name is the key at ``depth``, with their own text or that of a ``version`` key below."""
    names = F.array_distinct(F.transform(leaves, lambda x: F.slice(x["at"], 1, depth + 1)))

    def entry(at: Column) -> Column:
        own = F.filter(leaves, lambda y: (y["at"] == at) | (y["at"] == F.array_append(at, F.lit("version"))))
        return F.struct(F.get(at, depth).alias("package"), F.nullif(F.trim(F.get(own, 0)["value"]), F.lit("")).alias("version"))

    return F.transform(names, entry)


def _under(*keys: str | None) -> Column:
    """Leaves below the keys; None stands for any."""
    def below(x: Column) -> Column:
        hit = F.size(x["at"]) > len(keys)
        for n, k in enumerate(keys):
            hit &= (F.get(x["at"], n) == k) if k is not None else F.lit(True)
        return hit

    return F.filter("leaves", below)


def deps_toml(files: DataFrame) -> DataFrame:
    """(path, source, seq, package, version) of poetry.lock, pyproject and setup.cfg."""
    base = F.lower(P.basename("path"))
    parsed = config_leaves(files.where(base.isin("poetry.lock", "pyproject.toml", "setup.cfg")))
    locked = F.filter(_named(_under("package", None), 1), lambda p: p["package"].isNotNull())

    def of_lock(p: Column) -> Column:
        name = F.get(F.filter("leaves", lambda y: y["at"] == F.array(F.lit("package"), p["package"], F.lit("name"))), 0)["value"]
        return F.struct(F.trim(name).alias("package"), p["version"].alias("version"))

    lock = F.filter(F.transform(locked, of_lock), lambda p: F.coalesce(p["package"], F.lit("")) != "")
    poetry = F.filter(_named(_under("tool", "poetry", "dependencies"), 3), lambda p: F.lower(p["package"]) != "python")
    groups = _named(F.filter(_under("tool", "poetry", "group", None), lambda x: (F.get(x["at"], 4) == "dependencies") & (F.size(x["at"]) > 5)), 5)
    project = F.concat(_specs(_strings(_under("project", "dependencies"))), _specs(_strings(_under("project", "optional-dependencies"))), poetry, groups)
    raw = F.concat(F.filter(_under("options"), lambda x: F.get(x["at"], 1) == "install_requires"), _under("options.extras_require"))
    setup = _specs(F.flatten(F.transform(_strings(raw), lambda v: F.split(v, r"[\n,]"))))
    kind = F.when(base == "poetry.lock", "poetry_lock").when(base == "pyproject.toml", "pyproject").otherwise("setup_cfg")
    found = F.when(kind == "poetry_lock", lock).when(kind == "pyproject", project).otherwise(setup)
    return parsed.select("path", kind.alias("source"), F.posexplode(found).alias("seq", "_d")).select("path", "source", "seq", "_d.package", "_d.version")


def deps_merge(candidates: DataFrame, order: list[str]) -> DataFrame:
    """One row per package: best source, then one with a version, then a lockfile, then first seen.

    Input: package, version, source, lockfile and the order columns.
    """
    rank = F.coalesce(F.array_position(F.array(*[F.lit(s) for s in SOURCES]), F.col("source")).cast("int"), F.lit(0))
    rank = F.when(rank == 0, 9999).otherwise(rank)
    named = candidates.withColumn("package", F.trim("package")).where(F.col("package") != "")
    ready = named.withColumn("version", F.nullif(F.trim("version"), F.lit(""))).withColumn("_rank", rank)
    ready = ready.withColumn("_nov", F.col("version").isNull()).withColumn("_nol", F.col("lockfile").isNull())
    return first_seen(ready, ["package"], ["_rank", "_nov", "_nol", *order]).drop("_rank", "_nov", "_nol")


def stable_order(df: DataFrame, name: str, *ties: str) -> DataFrame:
    """Case-insensitive by name, then by name, then by the ties."""
    return df.orderBy(F.lower(name), name, *ties)
