"""From wrapped records to family summaries in one pass.

A record's payload becomes a map of VARIANT values, shaped for its family: envelope fields fill keys that the
payload leaves open. Every family's reducer is then a list of cells (metric, rule, name, value) of one record,
so that any number of families is one scan, one grouped aggregate and one rank filter. A cell's rule says how
equal cells meet:

``sum``     values of a name are added
``max``     the greatest value of a name
``count``   like ``sum``, of ones
``distinct`` names are counted once; the metric's row is named by the cell's label
``list``    every cell is a row
``latest``  the text of the latest record per name
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import paths as P
from .records import canonical_family, lookup
from .reducers import TOP, TOP_STATIC

# Families of kinds that are not their first part.
KIND_FAMILIES = {
    "ast_call": "ast_calls",
    "ast_docstring": "ast_docstring",
    "ast_import": "ast_imports",
    "ast_symbol": "ast_symbols",
    "ast_symbol_metrics": "quality_metric",
    "edge_import": "ast_imports",
    "quality_metric": "quality_metric",
}
ITEM = "map<string,variant>"


def _at(item: Column, key: str) -> Column:
    """The value of a key; JSON nulls count as absent."""
    value = F.try_element_at(item, F.lit(key))
    return F.when(~F.is_variant_null(value), value)


def _string(value: Column) -> Column:
    """The value if it is a string and not empty."""
    return F.when(F.schema_of_variant(value) == "STRING", F.nullif(F.try_variant_get(value, "$", "string"), F.lit("")))


def shape_family_items(records: DataFrame, aliases: Mapping[str, str] = KIND_FAMILIES) -> DataFrame:
    """(family, seq, item): each record's payload as the reducers of its family expect it.

    What the payload has wins over what the envelope has; ``seq`` is the time of detection in microseconds.
    """
    kind = canonical_family("kind")
    family = F.coalesce(lookup(kind, aliases), F.substring_index(kind, "_", 1))
    raw = F.coalesce(F.from_json("data", ITEM), F.map_from_arrays(F.array().cast("array<string>"), F.array().cast("array<variant>")))
    seq = F.unix_micros(F.to_timestamp("detected_at"))
    rows = records.select(family.alias("family"), seq.alias("seq"), raw.alias("raw"), "kind", "path", "severity", "code", "symbol", "edge")
    text = lambda name: F.col(name).cast("variant")
    own = lambda key: _at(F.col("raw"), key)
    target = F.coalesce(_string(F.try_variant_get(own("edge"), "$.to.name", "variant")), F.col("edge.to_name"))
    of = lambda name, value: F.when(F.col("family") == name, value)
    # The keys that each family's reducer reads, and what fills them.
    fill = {
        "file": text("path"),
        "severity": text("severity"),
        "code": text("code"),
        "kind": F.coalesce(of("ast_symbols", F.coalesce(_string(F.try_variant_get(own("symbol"), "$.kind", "variant")), F.col("symbol.kind")).cast("variant")), text("kind")),
        "name": F.coalesce(
            of("ast_calls", _string(own("callee")).cast("variant")),
            of("ast_symbols", _string(F.try_variant_get(own("symbol"), "$.name", "variant")).cast("variant")),
            text("symbol.name"),
        ),
        "module": of("ast_imports", target.cast("variant")),
        "edges": of("ast_imports", F.when(_string(own("to")).isNotNull(), F.parse_json(F.to_json(F.array(F.struct(_string(own("to")).alias("to"))))))),
        "coverage": of("docs", own("doc_coverage")),
        "statements": of("sql", F.when(F.schema_of_variant(own("statement")).startswith("OBJECT"), F.parse_json(F.concat(F.lit("["), F.to_json(own("statement")), F.lit("]"))))),
    }
    given = F.filter(F.array(*[F.struct(F.lit(k).alias("key"), v.alias("value")) for k, v in fill.items()]), lambda x: x["value"].isNotNull() & own_missing(x["key"]))
    return rows.select("family", "seq", F.map_concat("raw", F.map_from_entries(given)).alias("item"))


def own_missing(key: Column) -> Column:
    return ~F.map_contains_key("raw", key)


@dataclass
class Cell:
    metric: str
    rule: str
    name: Column
    value: Column | None = None
    label: str | None = None
    #: How many rows a ranked metric keeps; None keeps all.
    top: int | None = None
    text: Column | None = None


Reader = Callable[[str], Column]


def _first(item: Column, *keys: str) -> Column:
    """The first value that is there and not an empty text, as text."""
    return F.coalesce(*[F.nullif(F.try_variant_get(_at(item, k), "$", "string"), F.lit("")) for k in keys])


def _whole(item: Column, *keys: str) -> Column:
    """The first whole number that is there and not 0."""
    return F.coalesce(*[F.nullif(F.when(F.schema_of_variant(_at(item, k)) == "BIGINT", F.try_variant_get(_at(item, k), "$", "bigint")), F.lit(0)) for k in keys])


def _ints(item: Column, keys: Iterable[str]) -> list[Cell]:
    return [Cell("totals", "sum", F.when(_whole(item, k).isNotNull() | F.map_contains_key(item, k), F.lit(k)), F.coalesce(_whole(item, k), F.lit(0))) for k in keys]


def _one(name: str) -> Column:
    return F.lit(name)


def family_cells(family: str, item: Column, n: int | None = None) -> list[Cell]:
    """The cells of one record of a family; ``n`` sets the length of all top lists."""
    top, first = n or TOP, lambda *keys: _first(item, *keys)
    count = lambda label, when=None: Cell("totals", "count", _one(label) if when is None else F.when(when, label))
    unique = lambda label, name: Cell("totals", "distinct", name, label=label)
    ranked = lambda metric, name, few=None: Cell(metric, "count", name, top=n or few or TOP)
    if family == "quality":
        score = F.coalesce(_whole(item, "cyclomatic", "complexity"), F.lit(0))
        sums = [Cell("totals", "sum", _one("loc"), F.coalesce(_whole(item, "loc", "sloc"), F.lit(0))), Cell("totals", "sum", _one("cyclomatic"), score)]
        return [*sums, Cell("top", "max", first("name", "file", "path"), score, top=top)]
    if family == "quality_metric":
        return _ints(item, ("loc", "sloc", "n_functions", "n_classes", "cyclomatic"))
    if family == "env":
        key = first("key", "name")
        return [count("keys", key.isNotNull()), unique("files", first("file", "path")), ranked("top", key)]
    if family == "deps":
        name = first("name", "package", "id")
        return [unique("packages", name), ranked("top", name)]
    if family == "ast_imports":
        name = first("module", "name", "target")
        return [count("imports", name.isNotNull()), unique("unique", name), ranked("top", name)]
    if family == "ast_calls":
        name = first("name", "call", "func", "callee")
        return [count("calls_total", name.isNotNull()), ranked("calls_top", name)]
    if family == "docs":
        return [Cell("metrics_sum", "sum", F.when(_whole(item, "coverage", "doc_coverage").isNotNull(), "coverage"), _whole(item, "coverage", "doc_coverage"))]
    if family == "ast_docstring":
        kind = F.translate(F.lower(F.trim(first("owner_kind", "kind"))), "-", "_")
        return [count("docstrings"), ranked("by_owner_kind", kind), ranked("top_owners", first("owner", "symbol", "name")), ranked("files_top", first("file", "path"))]
    if family == "static":
        known = lambda key: F.coalesce(first(key), F.lit("unknown"))
        return [count("count"), ranked("by_severity", known("severity")), ranked("top_checks", known("check"), TOP_STATIC), ranked("top_codes", known("code"), TOP_STATIC)]
    if family == "entrypoints":
        kind = F.coalesce(F.translate(F.lower(F.trim(first("type"))), "-", "_"), F.when(first("interpreter").isNotNull(), "shell"))
        lang = F.when(kind.isin("python", "py"), "python").when(kind.isin("shell", "sh", "bash"), "shell")
        name = F.coalesce(first("name"), P.basename(first("file", "path")))
        return [count("total", lang.isNotNull()), *[Cell(x, "list", F.when(lang == x, name)) for x in ("python", "shell")]]
    if family == "license":
        has = F.try_variant_get(_at(item, "has_header"), "$", "boolean")
        return [count("files"), count("with_header", has), count("without_header", ~has), ranked("spdx_top", first("spdx_id", "spdx", "code", "id"))]
    return []


#: Families with rules of their own; the others sum their whole numbers, and ``git`` keeps the latest value of each key.
FAMILIES = ("quality", "quality_metric", "env", "deps", "ast_imports", "ast_calls", "docs", "ast_docstring", "static", "entrypoints", "license")
_CELL = "struct<metric:string,rule:string,label:string,name:string,value:double,top:int,text:string>"


def _struct(cell: Cell) -> Column:
    value = F.lit(1.0) if cell.value is None else cell.value.cast("double")
    cells = {"metric": F.lit(cell.metric), "rule": F.lit(cell.rule), "label": F.lit(cell.label), "name": cell.name, "value": value, "top": F.lit(cell.top), "text": cell.text if cell.text is not None else F.lit(None)}
    return F.struct(*[v.alias(k) for k, v in cells.items()]).cast(_CELL)


def _entries(item: Column, rule: str) -> Column:
    """One cell per key: whole numbers to add, or any value to keep as text."""
    whole = F.filter(F.map_entries(item), lambda e: F.schema_of_variant(e["value"]) == "BIGINT")
    if rule == "sum":
        return F.transform(whole, lambda e: _struct(Cell("totals", "sum", e["key"], F.try_variant_get(e["value"], "$", "double"))))
    kept = F.filter(F.map_entries(item), lambda e: ~e["key"].isin("kind", "file"))
    return F.transform(kept, lambda e: _struct(Cell("info", "latest", e["key"], F.col("seq"), text=F.try_variant_get(e["value"], "$", "string"))))


def reduce_items(items: DataFrame, n: int | None = None) -> DataFrame:
    """(family, metric, name, value, text) of shaped items, all families at once.

    The cells of equal names meet in one partial aggregate; a distinct count is the number of groups that come
    out of it, and top lists are cut by rank before they shuffle.
    """
    item = F.col("item")
    cells = F.when(F.col("family") == "git", _entries(item, "latest"))
    for family in FAMILIES:
        cells = cells.when(F.col("family") == family, F.array(*[_struct(c) for c in family_cells(family, item, n)]))
    cells = cells.otherwise(F.concat(_entries(item, "sum"), F.array(_struct(Cell("totals", "count", _one("records"))))))
    rows = items.select("family", F.inline(F.filter(cells, lambda c: c["name"].isNotNull())))
    met = rows.groupBy("family", "metric", "rule", "label", "top", "name", "text").agg(F.sum("value").alias("total"), F.max("value").alias("most"))
    rule = F.col("rule")
    value = F.when(rule == "distinct", 1.0).when(rule.isin("max", "latest"), F.col("most")).otherwise(F.col("total"))
    name = F.when(rule == "distinct", F.col("label")).otherwise(F.col("name"))
    met = met.select("family", "metric", "rule", "top", "text", name.alias("name"), value.alias("value"))
    met = met.groupBy("family", "metric", "rule", "top", "name", "text").agg(F.sum("value").alias("value"))
    # Ranked metrics are one group; any other name is a group of its own, so that one rank filter serves both.
    slot = F.when(F.col("top").isNull(), F.col("name"))
    most = n or TOP
    order = Window.partitionBy("family", "metric", "slot").orderBy(F.desc("value"), "name", "text")
    best = met.withColumn("slot", slot).withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= most)
    best = best.where(F.col("top").isNull() & ((rule != "latest") | (F.col("rank") == 1)) | (F.col("rank") <= F.col("top")))
    value = F.when(rule == "list", 1.0).when(rule != "latest", F.col("value"))
    times = F.when(rule == "list", F.col("value").cast("int")).otherwise(1)
    out = best.withColumn("_each", F.explode(F.array_repeat(F.lit(0), times)))
    return out.select("family", "metric", "name", value.alias("value"), "text")


def reduce_records(records: DataFrame, aliases: Mapping[str, str] = KIND_FAMILIES, n: int | None = None) -> DataFrame:
    """The summaries of all families of wrapped records, in one scan of them."""
    return reduce_items(shape_family_items(records, aliases), n)
