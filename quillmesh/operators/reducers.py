"""One summary per record family: every reducer is a grouped aggregate.

Summaries are long tables (family, metric, name, value), so any number of families
reduces in one job and top lists are rank-limited before they shuffle.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import paths as P
from .ordered import top_n
from .records import canonical_family, lift_first, literal_map

Reducer = Callable[..., DataFrame]
#: Default lengths of the top lists; every reducer takes its own ``n``.
TOP, TOP_STATIC, TOP_BUNDLES = 50, 15, 5
_REDUCERS: dict[str, Reducer] = {}


def register_reducer(token: str, fn: Reducer | None = None):
    """Bind a reducer to a family name (dashes and dots count as underscores)."""
    key = token.strip().lower().replace("-", "_").replace(".", "_")

    def bind(f: Reducer) -> Reducer:
        _REDUCERS[key] = f
        return f

    return bind(fn) if fn else bind


def reducer_for(family: str) -> Reducer:
    key = family.strip().lower().replace("-", "_").replace(".", "_")
    for name in (key, key + "s", key[:-1] if key.endswith("s") else key):
        if name in _REDUCERS and (name == key or key.startswith("ast_")):
            return _REDUCERS[name]
    return reduce_generic


def _long(df: DataFrame, metric: str, name, value) -> DataFrame:
    return df.select(F.lit(metric).alias("metric"), P.col(name).cast("string").alias("name"), P.col(value).cast("double").alias("value"))


def _totals(agg: DataFrame, metric: str = "totals") -> DataFrame:
    """Columns of a one-row aggregate as long rows; empty input gives none."""
    cells = F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).cast("double").alias("value")) for c in agg.columns])
    return agg.select(F.lit(metric).alias("metric"), F.inline(cells)).where(F.col("value").isNotNull())


def top_counts(items: DataFrame, name, metric: str, n: int) -> DataFrame:
    """The n most frequent names by (-count, name)."""
    counts = items.select(P.col(name).alias("name")).where(F.col("name").isNotNull()).groupBy("name").agg(F.count("*").alias("c"))
    return _long(counts.orderBy(F.desc("c"), "name").limit(n), metric, "name", "c")


def reduce_generic(items: DataFrame, n: int | None = None) -> DataFrame:
    """Sum of every integer column."""
    ints = [f.name for f in items.schema.fields if f.dataType.typeName() in ("integer", "long", "short", "byte")]
    return _totals(items.agg(*[F.sum(c).alias(c) for c in ints])) if ints else _totals(items.agg(F.count("*").alias("count")))


@register_reducer("quality")
def reduce_quality(items: DataFrame, n: int | None = None) -> DataFrame:
    loc = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("loc", "sloc") if c in items.columns], F.lit(0))
    cyc = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("cyclomatic", "complexity") if c in items.columns], F.lit(0))
    rows = items.select(loc.alias("loc"), cyc.alias("cyclomatic"), lift_first(items, ["name", "file", "path"], True).alias("file"))
    worst = rows.where(F.col("file").isNotNull()).groupBy("file").agg(F.max("cyclomatic").alias("score"))
    return _totals(rows.agg(F.sum("loc").alias("loc"), F.sum("cyclomatic").alias("cyclomatic"))).unionByName(
        _long(worst.orderBy(F.desc("score"), "file").limit(n or TOP), "top", "file", "score")
    )


@register_reducer("quality_metric")
def reduce_quality_metric(items: DataFrame, n: int | None = None) -> DataFrame:
    keys = [k for k in ("loc", "sloc", "n_functions", "n_classes", "cyclomatic") if k in items.columns]
    return _totals(items.agg(*[F.sum(k).alias(k) for k in keys]))


@register_reducer("env")
def reduce_env(items: DataFrame, n: int | None = None) -> DataFrame:
    key = lift_first(items, ["key", "name"], True)
    f = lift_first(items, ["file", "path"])
    return _totals(items.agg(F.count(key).alias("keys"), F.countDistinct(f).alias("files"))).unionByName(top_counts(items, key, "top", n or TOP))


@register_reducer("deps")
def reduce_deps(items: DataFrame, n: int | None = None) -> DataFrame:
    name = lift_first(items, ["name", "package", "id"], True)
    return _totals(items.agg(F.countDistinct(name).alias("packages"))).unionByName(top_counts(items, name, "top", n or TOP))


@register_reducer("ast_imports")
def reduce_ast_imports(items: DataFrame, n: int | None = None) -> DataFrame:
    name = lift_first(items, ["module", "name", "target"], True)
    return _totals(items.agg(F.count(name).alias("imports"), F.countDistinct(name).alias("unique"))).unionByName(top_counts(items, name, "top", n or TOP))


@register_reducer("ast_calls")
def reduce_ast_calls(items: DataFrame, n: int | None = None) -> DataFrame:
    name = lift_first(items, ["name", "call", "func", "callee"], True)
    return _totals(items.agg(F.count(name).alias("calls_total"))).unionByName(top_counts(items, name, "calls_top", n or TOP))


@register_reducer("docs")
def reduce_docs(items: DataFrame, n: int | None = None) -> DataFrame:
    cov = F.coalesce(*[F.nullif(F.col(c), F.lit(0)) for c in ("coverage", "doc_coverage") if c in items.columns])
    whole = F.when(cov == F.floor(cov), cov)
    return _totals(items.agg(F.sum(whole).alias("coverage")), "metrics_sum")


@register_reducer("ast_docstring")
def reduce_ast_docstring(items: DataFrame, n: int | None = None) -> DataFrame:
    kind = F.nullif(F.translate(F.lower(F.trim(lift_first(items, ["owner_kind", "kind"], True))), "-", "_"), F.lit(""))
    owner = lift_first(items, ["owner", "symbol", "name"], True)
    out = _totals(items.agg(F.count("*").alias("docstrings")))
    out = out.unionByName(top_counts(items, kind, "by_owner_kind", n or TOP)).unionByName(top_counts(items, owner, "top_owners", n or TOP))
    return out.unionByName(top_counts(items, lift_first(items, ["file", "path"]), "files_top", n or TOP))


@register_reducer("static")
def reduce_static(items: DataFrame, n: int | None = None) -> DataFrame:
    out = _totals(items.agg(F.count("*").alias("count")))
    for c, metric, few in (("severity", "by_severity", TOP), ("check", "top_checks", TOP_STATIC), ("code", "top_codes", TOP_STATIC)):
        if c in items.columns:
            out = out.unionByName(top_counts(items, F.coalesce(F.col(c), F.lit("unknown")), metric, n or few))
    return out


@register_reducer("entrypoints")
def reduce_entrypoints(items: DataFrame, n: int | None = None) -> DataFrame:
    kind = F.translate(F.lower(F.trim(lift_first(items, ["kind", "type"], True))), "-", "_")
    interp = F.col("interpreter") if "interpreter" in items.columns else F.lit(None)
    k = F.coalesce(kind, F.when(interp.isNotNull(), "shell"))
    lang = F.when(k.isin("python", "py"), "python").when(k.isin("shell", "sh", "bash"), "shell")
    f = lift_first(items, ["file", "path"])
    name = F.coalesce(lift_first(items, ["name"], True), P.basename(f))
    rows = items.select(lang.alias("metric"), name.alias("name")).where(F.col("metric").isNotNull())
    listed = rows.select("metric", "name", F.lit(1.0).alias("value"))
    return listed.unionByName(_totals(rows.agg(F.count("*").alias("total"))))


@register_reducer("license")
def reduce_license(items: DataFrame, n: int | None = None) -> DataFrame:
    sid = lift_first(items, ["spdx_id", "spdx", "id"], True)
    has = F.col("has_header") if "has_header" in items.columns else F.lit(None).cast("boolean")
    agg = items.agg(
        F.count("*").alias("files"),
        F.count(F.when(has, 1)).alias("with_header"),
        F.count(F.when(~has, 1)).alias("without_header"),
    )
    return _totals(agg).unionByName(top_counts(items, sid, "spdx_top", n or TOP))


register_reducer("license_header", reduce_license)


@register_reducer("git")
def reduce_git(items: DataFrame, n: int | None = None) -> DataFrame:
    """Later records overwrite keys of earlier ones: (name = key, text value).

    Input: seq, props map. One partial max_by per key.
    """
    cells = items.select("seq", F.explode("props").alias("name", "text"))
    return cells.groupBy("name").agg(F.max_by("text", "seq").alias("text")).select(F.lit("info").alias("metric"), "name", "text")


@register_reducer("io_core")
def reduce_io_core(items: DataFrame, n: int | None = None) -> DataFrame:
    """First header and first ``n`` bundle summaries by seq. Input: seq, record_type, payload."""
    wanted = items.where(F.col("record_type").isin("manifest_header", "bundle_summary"))
    ranked = top_n(wanted, ["record_type"], ["seq"], n or TOP_BUNDLES, "n")
    keep = (F.col("record_type") == "bundle_summary") | (F.col("n") == 1)
    return ranked.where(keep).select(F.col("record_type").alias("metric"), F.col("n").cast("string").alias("name"), F.col("payload").alias("text"))


def reduce_families(items: DataFrame, families: Iterable[str], n: int | None = None) -> DataFrame:
    """Every listed family through its reducer, as one long table; ``n`` sets the length of all top lists."""
    out = None
    for fam in sorted(families):
        part = reducer_for(fam)(items.where(F.col("family") == fam), n).select(F.lit(fam).alias("family"), "metric", "name", "value")
        out = part if out is None else out.unionByName(part)
    return out


def family_counts(records: DataFrame, aliases: dict[str, str] | None = None) -> DataFrame:
    """Records, distinct paths and fingerprints per canonical family."""
    fam = canonical_family(F.substring_index("kind", ".", 1), aliases)
    return records.groupBy(fam.alias("family")).agg(
        F.count("*").alias("records"), F.countDistinct("path").alias("paths"), F.countDistinct("fp").alias("fingerprints")
    )


def zero_fill(summary: DataFrame, gate: Iterable[str]) -> DataFrame:
    """Every gated family once; absent ones with count 0 and ``no_data``."""
    spark = summary.sparkSession
    gates = spark.createDataFrame([(g,) for g in sorted(set(gate))], "family string")
    return gates.join(summary, "family", "left").select(
        "family", F.coalesce("records", F.lit(0)).alias("records"), F.col("records").isNull().alias("no_data")
    )


def summary_index(counts: DataFrame, modes: dict[str, str], default: str = "both") -> DataFrame:
    """(family, records, mode, path): manifest-only families write no file."""
    mode = F.coalesce(F.try_element_at(literal_map(modes), F.col("family")), F.lit(default)) if modes else F.lit(default)
    out = counts.select("family", "records", mode.alias("mode"))
    return out.withColumn("path", F.when(F.col("mode") != "manifest", F.concat("family", F.lit(".summary.json"))))


def bundle_summary(records: DataFrame) -> DataFrame:
    """Record counts per producer."""
    return records.groupBy(F.col("scanner.name").alias("producer")).agg(F.count("*").alias("records"))


def top_records(records: DataFrame, n: int = 200) -> DataFrame:
    """The first n rows by name, id or path."""
    keys = [F.col(c).cast("string") for c in ("name", "id", "path") if c in records.columns]
    return records.orderBy(F.coalesce(*keys), *[k for k in keys[1:]]).limit(n)


# Section, name, and the family, metric and key of the summary it shows.
HIGHLIGHTS = [
    ("stats", "files_total_python", "quality_metric", "totals", "files"),
    ("stats", "python_functions", "quality_metric", "totals", "n_functions"),
    ("stats", "python_classes", "quality_metric", "totals", "n_classes"),
    ("stats", "python_loc", "quality_metric", "totals", "loc"),
    ("stats", "python_symbols", "ast_symbols", "totals", "count"),
    ("stats", "imports_statements", "ast_imports", "totals", "imports"),
    ("stats", "sql_graph_edges", "sql_refs", "totals", "count"),
    ("risks", "secrets_findings", "secrets", "totals", "count"),
    ("risks", "license_flags", "license", "totals", "files"),
]


def highlights(summary: DataFrame, tops: Mapping[str, DataFrame] | None = None, n: int = 5) -> DataFrame:
    """(section, name, rank, label, value): figures of a long summary table, absent risks counting 0, and the
    first ``n`` rows of each top list, given as (label, value), by (-value, label)."""
    def pick(fam: str, metric: str, name: str):
        return F.max(F.when((F.col("family") == fam) & (F.col("metric") == metric) & (F.col("name") == name), F.col("value")))

    none = F.lit(None)
    figures = summary.agg(*[pick(*at).alias(f"{section}_{name}") for section, name, *at in HIGHLIGHTS])
    cells = [
        F.struct(F.lit(section).alias("section"), F.lit(name).alias("name"), none.cast("int").alias("rank"), none.cast("string").alias("label"),
                 (F.coalesce(f"{section}_{name}", F.lit(0.0)) if section == "risks" else F.col(f"{section}_{name}")).alias("value"))
        for section, name, *_ in HIGHLIGHTS
    ]
    out = figures.select(F.inline(F.array(*cells)))
    for name, rows in (tops or {}).items():
        best = top_n(rows.select(F.lit(name).alias("name"), F.col("label").cast("string").alias("label"), F.col("value").cast("double").alias("value")), ["name"], [F.desc("value"), "label"], n, "rank")
        out = out.unionByName(best.select(F.lit("top").alias("section"), "name", "rank", "label", "value"))
    return out

