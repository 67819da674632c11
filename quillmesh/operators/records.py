"""The record envelope: lifting raw findings, fingerprints, validation, families."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import paths as P

# The wrapper policy.
SCHEMA = "scanner.record.v1"
RECORD_TYPE_KINDS = {
    "module_index": "python.module.index",
    "edge.import": "edge.import",
    "ast.symbol": "ast.symbol",
    "ast.xref": "edge.import",
    "ast.call": "ast.call",
    "ast.docstring": "ast.docstring",
    "ast.symbol_metrics": "ast.symbol.metrics",
}
SCOPE_OVERRIDES = {
    "git.repo": "repo",
    "edge.import": "edge",
    "ast.call": "edge",
    "ast.symbol": "symbol",
    "ast.docstring": "symbol",
    "ast.symbol.metrics": "symbol",
}
EXCLUDED_TYPES = ["manifest_header", "bundle_summary", "parts_index", "superbundle.run", "assistant_handoff.v1"]
KIND_ALIASES = {"entrypoints": "entrypoint", "git.info": "git"}
PATH_KEYS = ["path", "src_path", "file", "file_path", "module_path"]
LOC_KEYS = {
    "line": ["line", "lineno"],
    "col": ["col", "col_offset", "column"],
    "end_line": ["end_line", "end_lineno"],
    "end_col": ["end_col", "end_col_offset"],
}
CODE_KEYS = ["code", "rule", "check", "id"]
MESSAGE_KEYS = ["message", "note", "reason", "desc", "description"]
EDGE_TARGET_KEYS = ["module", "to", "dst_module"]
SYMBOL_KEYS = ["name", "symbol", "qualname", "sym_kind", "symbol_kind"]


def literal_map(m: Mapping[str, str]) -> Column:
    return F.create_map(*[F.lit(x) for kv in m.items() for x in kv])


def lookup(key, m: Mapping[str, str]) -> Column:
    """Mapped value or null; works for an empty mapping too."""
    return F.try_element_at(literal_map(m), P.col(key)) if m else F.lit(None).cast("string")


def canonical_kind(kind, aliases: Mapping[str, str] = KIND_ALIASES) -> Column:
    """The part before the first dot through the aliases."""
    k = F.coalesce(F.nullif(P.col(kind), F.lit("")), F.lit("unknown.item"))
    fam = F.substring_index(k, ".", 1)
    return F.concat(F.coalesce(lookup(fam, aliases), fam), F.substring(k, F.length(fam) + 1, F.length(k)))


def canonical_family(name, aliases: Mapping[str, str] | None = None, dots: bool = True) -> Column:
    """Trim, lower case, ``-`` to ``_``, ``.`` to ``_`` unless told not to, alias."""
    n = F.translate(F.lower(F.trim(F.coalesce(P.col(name), F.lit("")))), "-." if dots else "-", "__" if dots else "_")
    return F.coalesce(lookup(n, aliases or {}), n)


def infer_scope(kind, overrides: Mapping[str, str] = SCOPE_OVERRIDES) -> Column:
    k = P.col(kind)
    fam = F.substring_index(k, ".", 1)
    sub = F.regexp_extract(k, r"^[^.]*\.(.*)$", 1)
    inferred = (
        F.when(k.endswith(".summary") | (k == "git.repo"), "repo")
        .when((fam == "edge") | sub.isin("xref", "edge"), "edge")
        .when((fam == "ast") & (sub.startswith("symbol") | (sub == "docstring")), "symbol")
        .otherwise("file")
    )
    return F.coalesce(lookup(k, overrides), inferred)


def _present(df: DataFrame, keys: Sequence[str]) -> list[str]:
    return [k for k in keys if k in df.columns]


def lift_first(df: DataFrame, keys: Sequence[str], non_empty: bool = False) -> Column:
    """First present value of the keys, as a string."""
    cols = [F.col(k).cast("string") for k in _present(df, keys)]
    if non_empty:
        cols = [F.nullif(c, F.lit("")) for c in cols]
    return F.coalesce(*cols) if cols else F.lit(None).cast("string")


def lift_path(df: DataFrame) -> Column:
    return P.posix_path(lift_first(df, PATH_KEYS, non_empty=True))


def lift_int(df: DataFrame, keys: Sequence[str]) -> Column:
    """First value that is a number or a string of digits."""
    cols = [F.when(F.col(k).cast("string").rlike(r"^-?\d+$"), F.expr(f"try_cast(`{k}` as int)")) for k in _present(df, keys)]
    return F.coalesce(*cols) if cols else F.lit(None).cast("int")


def wrap_records(df: DataFrame, producer: str, detected_at: Column, version: str = "1") -> DataFrame:
    """Raw findings to envelopes. Columns the envelope does not lift land in ``data``.

    Rows that already carry the envelope schema keep their kind and fingerprint.
    """
    null = F.lit(None).cast("string")
    rt = F.col("record_type") if "record_type" in df.columns else null
    raw_kind = F.nullif(F.col("kind"), F.lit("")) if "kind" in df.columns else null
    is_v1 = (F.col("schema") == SCHEMA) if "schema" in df.columns else F.lit(False)
    is_v1 = F.coalesce(is_v1, F.lit(False))

    mapped = F.coalesce(lookup(rt, RECORD_TYPE_KINDS), raw_kind)
    bad = mapped.isNull() & ~is_v1
    resolved = F.coalesce(mapped, F.concat(F.lit("unknown."), F.coalesce(rt, F.lit("item"))))
    reason = F.when(bad, F.when(rt.isNotNull(), "record_type_unmapped").otherwise("no_kind_or_record_type"))

    lifted = {"schema", "kind", "record_type", "severity", "external", "fp", "detected_at", *PATH_KEYS, *CODE_KEYS,
              *MESSAGE_KEYS, *EDGE_TARGET_KEYS, *SYMBOL_KEYS, *[k for ks in LOC_KEYS.values() for k in ks if k != "column"]}
    rest = [c for c in df.columns if c not in lifted]
    data = F.to_json(F.struct(*[F.col(c) for c in sorted(rest)])) if rest else F.lit("{}")

    wrapped = df.where(rt.isNull() | ~rt.isin(*EXCLUDED_TYPES)).select(
        F.when(is_v1, raw_kind).otherwise(canonical_kind(resolved)).alias("kind"),
        rt.alias("_rt"),
        raw_kind.alias("_raw_kind"),
        lift_path(df).alias("path"),
        *[lift_int(df, ks).alias(name) for name, ks in LOC_KEYS.items()],
        (F.nullif(F.col("severity"), F.lit("")) if "severity" in df.columns else null).alias("severity"),
        lift_first(df, CODE_KEYS).alias("code"),
        lift_first(df, MESSAGE_KEYS).alias("message"),
        lift_first(df, ["name", "symbol"], True).alias("_name"),
        lift_first(df, ["qualname"], True).alias("_qual"),
        lift_first(df, ["sym_kind", "symbol_kind"]).alias("_sub"),
        lift_first(df, EDGE_TARGET_KEYS, True).alias("_to"),
        (F.coalesce(F.col("external").cast("boolean"), F.lit(False)) if "external" in df.columns else F.lit(False)).alias("_ext"),
        data.alias("data"),
        (F.col("detected_at") if "detected_at" in df.columns else null).alias("_seen"),
        (F.col("fp") if "fp" in df.columns else null).alias("_fp"),
        bad.alias("_bad"),
        reason.alias("_reason"),
    )
    symbolic = F.coalesce(F.col("_rt") == "ast.symbol", F.lit(False)) | F.col("kind").startswith("ast.symbol")
    has_name = F.col("_name").isNotNull() | F.col("_qual").isNotNull()
    xref = F.coalesce(F.col("_rt") == "ast.xref", F.lit(False))
    edge_type = F.when(xref, F.when(F.col("_raw_kind").isin("import", "import_from"), F.col("_raw_kind")).otherwise("import"))
    subtype = F.coalesce("_sub", F.when(F.col("_raw_kind") != F.col("kind"), F.col("_raw_kind")))
    return wrapped.select(
        F.lit(SCHEMA).alias("schema"),
        "kind",
        infer_scope("kind").alias("scope"),
        "path",
        F.struct("line", "col", "end_line", "end_col").alias("loc"),
        "severity",
        "code",
        "message",
        F.when(symbolic & has_name, F.struct(F.col("_name").alias("name"), F.col("_qual").alias("qualname"), subtype.alias("kind"))).alias("symbol"),
        F.when(
            xref | F.col("kind").startswith("edge."),
            F.struct(edge_type.alias("type"), F.col("path").alias("from_path"), F.col("_to").alias("to_name"), F.col("_ext").alias("external")),
        ).alias("edge"),
        "data",
        F.struct(F.lit(producer).alias("name"), F.lit(version).alias("version")).alias("scanner"),
        F.coalesce(F.col("_seen"), detected_at).alias("detected_at"),
        F.struct((~F.col("_bad")).alias("ok"), F.col("_bad").alias("parse_error"), F.lit(False).alias("suppressed"), F.col("_reason").alias("reason")).alias("status"),
        F.coalesce(F.col("_fp"), H.record_fp("kind", "path", "code", "message", "line")).alias("fp"),
    )


def fingerprint(df: DataFrame, kind: str, path: str, code: str, message: str, line: str) -> DataFrame:
    return df.withColumn("fp", H.record_fp(kind, path, code, message, line))


def record_problem(df: DataFrame) -> Column:
    """First thing wrong with an envelope row, null when it is fine."""
    checks: list[Column] = []
    for c in ("schema", "kind", "scope", "data", "detected_at", "fp"):
        missing = F.col(c).isNull() if c in df.columns else F.lit(True)
        checks.append(F.when(missing, F.lit(f"missing required key: {c}")))
    if "schema" in df.columns:
        checks.append(F.when(F.col("schema") != SCHEMA, F.lit(f"schema must be '{SCHEMA}'")))
    if "data" in df.columns:
        checks.append(F.when(F.coalesce(F.schema_of_variant(F.try_parse_json("data")), F.lit("")).startswith("OBJECT") == F.lit(False), F.lit("data must be an object")))
    if "scanner" in df.columns:
        checks.append(F.when(F.col("scanner.name").isNull() | F.col("scanner.version").isNull(), F.lit("scanner must be an object with name and version")))
    if "status" in df.columns:
        checks.append(F.when(F.col("status.ok").isNull(), F.lit("status must contain ok, parse_error, suppressed, reason")))
    return F.coalesce(*checks)


def validate_records(df: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(valid rows, rejected rows with their problem)."""
    checked = df.withColumn("problem", record_problem(df))
    return checked.where(F.col("problem").isNull()).drop("problem"), checked.where(F.col("problem").isNotNull())


def map_paths(df: DataFrame, prefix: str, mode: str) -> DataFrame:
    """Prefix or un-anchor every path column; arrays named ``examples_*`` too."""
    out = df
    for c in df.columns:
        if c in ("path", "src_path", "dst_path", "caller_path", "callee_path"):
            out = out.withColumn(c, P.map_path(c, prefix, mode))
        elif c.startswith("examples_"):
            out = out.withColumn(c, F.transform(c, lambda x: P.map_path(x, prefix, mode)))
    return out


def union_records(*dfs: DataFrame) -> DataFrame:
    out = dfs[0]
    for d in dfs[1:]:
        out = out.unionByName(d, allowMissingColumns=True)
    return out


def coalesce_edges(edges: DataFrame, position: Sequence[str]) -> DataFrame:
    """First edge per (kind, src, dst), in position order."""
    from .ordered import first_seen

    keyed = edges.select(
        "*",
        F.coalesce(lift_first(edges, ["kind", "record_type"]), F.lit("")).alias("_k"),
        F.coalesce(lift_first(edges, ["src_path", "src"]), F.lit("")).alias("_s"),
        F.coalesce(lift_first(edges, ["dst_path", "dst", "dst_module"]), F.lit("")).alias("_d"),
    )
    return first_seen(keyed, ["_k", "_s", "_d"], position).drop("_k", "_s", "_d")


def sanitize_items(df: DataFrame, json_col: str, forbid_secrets: bool = True, max_keys: int | None = None, max_items: int | None = None) -> DataFrame:
    """A JSON object column without payload, raw and (if asked) secret-looking keys.

    Scalars stay; objects and arrays with a scalar stay, reduced to their scalars, but
    for those over ``max_keys`` or ``max_items``, if given.
    """
    banned = r"(?i)^(payload|raw)$" + (r"|secret|token|password|key" if forbid_secrets else "")
    top = F.try_parse_json(json_col).cast("map<string,variant>")
    small = F.map_filter(top, lambda k, v: ~k.rlike(banned) & _keep_value(v, max_keys, max_items))
    return df.withColumn(json_col, F.to_json(F.transform_values(small, lambda _, v: _reduce_value(v)), {"ignoreNullFields": "false"}))


def _nested(v: Column, kind: str) -> Column:
    return F.schema_of_variant(v).startswith(kind)


def _scalar(v: Column) -> Column:
    return ~_nested(v, "OBJECT") & ~_nested(v, "ARRAY")


def _keep_value(v: Column, max_keys: int | None, max_items: int | None) -> Column:
    n_keys = F.size(F.map_keys(v.try_cast("map<string,variant>")))
    n_items = F.size(F.filter(v.try_cast("array<variant>"), _scalar))
    few_keys = F.lit(True) if max_keys is None else n_keys <= max_keys
    few_items = n_items >= 1 if max_items is None else n_items.between(1, max_items)
    return F.when(_nested(v, "OBJECT"), few_keys).when(_nested(v, "ARRAY"), few_items).otherwise(F.lit(True))


def _reduce_value(v: Column) -> Column:
    fields = F.map_filter(v.try_cast("map<string,variant>"), lambda _, x: _scalar(x))
    items = F.filter(v.try_cast("array<variant>"), _scalar)
    return F.when(_nested(v, "OBJECT"), F.to_variant_object(fields)).when(_nested(v, "ARRAY"), F.to_variant_object(items)).otherwise(v)


def apply_emission_mode(families: DataFrame, default: str, modes: Mapping[str, str], override: Mapping[str, str]) -> DataFrame:
    """``mode`` per family: the override map wins over the mode map, then the default."""
    return families.withColumn("mode", F.coalesce(lookup("family", override), lookup("family", modes), F.lit(default)))


def require_fields(df: DataFrame, required: Mapping[str, str], allow_extra: bool = True) -> DataFrame:
    """``problems`` per row: missing fields, values that do not cast, extra columns."""
    probs: list[Column] = []
    for name, typ in required.items():
        if name not in df.columns:
            probs.append(F.lit(f"missing:{name}"))
            continue
        bad = F.expr(f"try_cast(`{name}` as {typ})").isNull()
        probs.append(F.when(F.col(name).isNull(), F.lit(f"missing:{name}")).when(bad, F.lit(f"type:{name}")))
    if not allow_extra:
        probs += [F.lit(f"extra:{c}") for c in df.columns if c not in required]
    return df.withColumn("problems", F.array_compact(F.array(*probs)))
