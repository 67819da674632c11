"""Record queries: envelopes, fingerprints, families, reducers."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import hashing as H
from ..functions import text as X
from ..operators import families, licenses, pysource, records as R, reducers, secrets
from .registry import FILES, LINES, ORACLES, query

# ---- raw findings of three scanners -----------------------------------------------------


def seen_at():
    return F.lit("2024-01-01T00:00:00.000000Z")


def raw_findings(t):
    """Unwrapped rows of the license, static and secret scanners, from one pass over the lines."""
    # The hint is found before the lines are cut: in the select that cuts them, Spark would look for it once per line.
    hinted = t.files.select("path", licenses.license_hint("text").alias("hint"), X.lines_of("text").alias("_lines"))
    rows = hinted.select("path", "hint", F.posexplode_outer("_lines").alias("_i", "line"))

    def finding(kind, line, code, message=None, severity=None, check=None, sha256=None):
        text = {"code": code, "message": message, "severity": severity, "check": check, "sha256": sha256}
        cells = [(F.lit(None) if c is None else c).cast("string").alias(k) for k, c in text.items()]
        return F.struct(F.lit(kind).alias("kind"), line.cast("int").alias("line"), *cells)

    n = F.col("_i") + 1
    hint = F.when((F.coalesce("_i", F.lit(0)) == 0) & F.col("hint").isNotNull(), finding("license.hint", F.lit(None), F.col("hint")))
    static = F.transform(pysource.line_issues("line"), lambda x: finding("static.issue", n, x["code"], x["message"], F.lit("info"), x["check"]))
    found = F.transform(secrets.line_secrets("line"), lambda x: finding("secrets.finding", n, x["kind"], sha256=x["sha256"]))
    of_line = F.when(F.col("line").isNotNull(), F.concat(static, found))
    return rows.select("path", F.inline(F.concat(F.array_compact(F.array(hint)), F.coalesce(of_line, F.array().cast(FINDINGS)))))


FINDINGS = "array<struct<kind:string,line:int,code:string,message:string,severity:string,check:string,sha256:string>>"


_SECRETS = ORACLES["secrets_scan"]
_RAW = f"""(SELECT 'license.hint' AS kind, path, NULL::INT AS line, spdx_id AS code, NULL AS message, NULL AS severity FROM ({ORACLES['license_hints']})
    UNION ALL SELECT 'static.issue', path, line_no::INT, code, message, 'info' FROM ({ORACLES['line_checks']})
    UNION ALL SELECT 'secrets.finding', path, line_no::INT, kind, NULL, NULL FROM ({_SECRETS}))"""
_FP = "'sha256:' || sha256(concat_ws('|', kind, coalesce(path, ''), coalesce(code, ''), coalesce(message, ''), coalesce(line::VARCHAR, '')))"


@query("wrap_records", f"SELECT kind, 'file' AS scope, path, line, code, message, severity, {_FP} AS fp FROM {_RAW}")
def _(t):
    w = R.wrap_records(raw_findings(t), "scan", seen_at())
    return w.select("kind", "scope", "path", F.col("loc.line").alias("line"), "code", "message", "severity", "fp")


@query(
    "reduce_family",
    f"""SELECT split_part(kind, '.', 1) AS family, count(*) AS records, count(DISTINCT path) AS paths, count(DISTINCT fp) AS fingerprints, any_value(top) AS top_code
    FROM (SELECT *, {_FP} AS fp FROM {_RAW}) r JOIN (SELECT kind AS k, code AS top FROM (SELECT kind, code, row_number() OVER (PARTITION BY kind ORDER BY count(*) DESC, code) AS rn FROM {_RAW} GROUP BY kind, code) WHERE rn = 1) x ON r.kind = x.k
    GROUP BY split_part(kind, '.', 1)""",
)
def _(t):
    w = R.wrap_records(raw_findings(t), "scan", seen_at())
    groups = w.groupBy(F.substring_index("kind", ".", 1).alias("family"), "code", "path", "fp").agg(F.count("*").alias("n"))
    codes = groups.groupBy("family", "code").agg(F.sum("n").alias("c"))
    top = codes.groupBy("family").agg(F.min(F.struct((-F.col("c")).alias("c"), "code"))["code"].alias("top_code"))
    counts = groups.groupBy("family").agg(F.sum("n").alias("records"), F.countDistinct("path").alias("paths"), F.countDistinct("fp").alias("fingerprints"))
    return counts.join(top, "family")


_EVENT_FP = "'sha256:' || sha256(concat_ws('|', event_type, '', event_id::VARCHAR, '', user_id::VARCHAR))"


@query("fingerprint", f"SELECT event_id, {_EVENT_FP} AS fp FROM events")
def _(t):
    e = t.events.withColumn("path", F.lit(None).cast("string"))
    return R.fingerprint(e, "event_type", "path", "event_id", "path", "user_id").select("event_id", "fp")


@query(
    "wrap_events",
    """SELECT CASE event_type WHEN 'view' THEN 'edge.import' WHEN 'click' THEN 'ast.call' ELSE 'unknown.' || event_type END AS kind,
    CASE WHEN event_type IN ('view', 'click') THEN 'edge' ELSE 'file' END AS scope, event_type NOT IN ('view', 'click') AS bad,
    CASE WHEN event_type NOT IN ('view', 'click') THEN 'record_type_unmapped' END AS reason, count(*) AS n FROM events WHERE event_type <> 'error' GROUP BY ALL""",
)
def _(t):
    rt = F.when(F.col("event_type") == "view", "ast.xref").when(F.col("event_type") == "click", "ast.call").when(F.col("event_type") == "error", "manifest_header")
    raw = t.events.select(F.coalesce(rt, "event_type").alias("record_type"), F.col("event_id").cast("string").alias("id"), "value", F.col("user_id").alias("line"))
    w = R.wrap_records(raw, "log", seen_at())
    return w.groupBy("kind", "scope", F.col("status.parse_error").alias("bad"), F.col("status.reason").alias("reason")).agg(F.count("*").alias("n"))


@query("validate_records", f"SELECT count(*) FILTER (code <> 'ST100') AS ok, count(*) FILTER (code = 'ST100') AS bad FROM {_RAW}")
def _(t):
    w = R.wrap_records(raw_findings(t), "scan", seen_at())
    w = w.withColumn("schema", F.when(F.col("code") == "ST100", "other").otherwise(F.col("schema")))
    return w.agg(F.count(F.when(R.record_problem(w).isNull(), 1)).alias("ok"), F.count(F.when(R.record_problem(w).isNotNull(), 1)).alias("bad"))


@query("canonical_kind", "SELECT event_id, CASE event_type WHEN 'view' THEN 'seen' ELSE event_type END || '.' || user_id AS kind FROM events")
def _(t):
    return t.events.select("event_id", R.canonical_kind(F.concat_ws(".", "event_type", F.col("user_id").cast("string")), {"view": "seen"}).alias("kind"))


@query("canonical_family", "SELECT event_type AS raw, CASE event_type WHEN 'view' THEN 'seen' ELSE event_type || '_x_y' END AS family, count(*) AS n FROM events GROUP BY event_type")
def _(t):
    fam = R.canonical_family(F.concat(F.lit(" "), F.upper("event_type"), F.lit("-X.y ")), {"view_x_y": "seen"})
    return t.events.groupBy(F.col("event_type").alias("raw"), fam.alias("family")).agg(F.count("*").alias("n"))


@query("infer_scope", "SELECT event_type, CASE event_type WHEN 'view' THEN 'repo' WHEN 'click' THEN 'edge' WHEN 'signup' THEN 'symbol' ELSE 'file' END AS scope FROM (SELECT DISTINCT event_type FROM events)")
def _(t):
    kind = F.when(F.col("event_type") == "view", "html.summary").when(F.col("event_type") == "click", "edge.x").when(F.col("event_type") == "signup", "ast.symbol.class").otherwise("license.file")
    return t.events.select("event_type", R.infer_scope(kind).alias("scope")).distinct()


@query("lift_fields", """SELECT o_orderkey, replace(nullif(o_orderpriority, ''), '\\', '/') AS path, o_custkey::INT AS line, o_orderstatus AS code FROM orders""")
def _(t):
    o = t.orders.select("o_orderkey", F.lit("").alias("path"), F.col("o_orderpriority").alias("src_path"), F.col("o_custkey").cast("string").alias("lineno"), F.col("o_orderstatus").alias("rule"))
    return o.select("o_orderkey", R.lift_path(o).alias("path"), R.lift_int(o, ["line", "lineno"]).alias("line"), R.lift_first(o, R.CODE_KEYS).alias("code"))


@query("map_paths", "SELECT doc_id, 'root/' || source || '/' || doc_id || '.txt' AS path, 'root/x/' || lang || ',root/y' AS examples_paths FROM documents")
def _(t):
    f = t.files.select("doc_id", "path", F.array(F.concat(F.lit("/x/"), "lang"), F.lit("y")).alias("examples_paths"))
    return R.map_paths(f, "root", "local").withColumn("examples_paths", F.array_join("examples_paths", ","))


@query("union_records", "SELECT 'd' || doc_id AS id, lang, NULL::INT AS label FROM documents UNION ALL SELECT 'v' || vec_id, NULL, label FROM embeddings")
def _(t):
    return R.union_records(
        t.documents.select(F.concat(F.lit("d"), F.col("doc_id").cast("string")).alias("id"), "lang"),
        t.embeddings.select(F.concat(F.lit("v"), F.col("vec_id").cast("string")).alias("id"), "label"),
    )


@query(
    "coalesce_edges",
    """SELECT kind, src, dst, l_orderkey, l_linenumber FROM (SELECT l_returnflag AS kind, l_suppkey::VARCHAR AS src, l_partkey::VARCHAR AS dst, l_orderkey, l_linenumber,
    row_number() OVER (PARTITION BY l_returnflag, l_suppkey, l_partkey ORDER BY l_orderkey, l_linenumber) AS rn FROM lineitem) WHERE rn = 1""",
)
def _(t):
    e = t.lineitem.select(F.col("l_returnflag").alias("kind"), F.col("l_suppkey").cast("string").alias("src"), F.col("l_partkey").cast("string").alias("dst"), "l_orderkey", "l_linenumber")
    return R.coalesce_edges(e, ["l_orderkey", "l_linenumber"])


@query("sanitize_items", "SELECT event_id, props FROM (SELECT event_id, json_object('k', json_extract(props, '$.k'), 'n', user_id, 'o', json('{\"a\":1}')) AS props FROM events)")
def _(t):
    raw = F.concat(F.lit('{"k":'), F.get_json_object("props", "$.k"), F.lit(',"api_key":"x","payload":{"z":1},"n":'), F.col("user_id").cast("string"), F.lit(',"o":{"a":1,"b":{"c":2}}}'))
    s = R.sanitize_items(t.events.select("event_id", raw.alias("props")), "props")
    g = lambda k: F.get_json_object("props", f"$.{k}")
    keys = F.array_join(F.array_sort(F.json_object_keys("props")), ",")
    return s.select("event_id", F.when(keys == "k,n,o", F.concat(F.lit('{"k":'), g("k"), F.lit(',"n":'), g("n"), F.lit(',"o":'), g("o"), F.lit("}"))).otherwise(keys).alias("props"))


@query("apply_emission_mode", "SELECT event_type AS family, CASE event_type WHEN 'view' THEN 'manifest' WHEN 'click' THEN 'summary' ELSE 'both' END AS mode FROM (SELECT DISTINCT event_type FROM events)")
def _(t):
    fam = t.events.select(F.col("event_type").alias("family")).distinct()
    return R.apply_emission_mode(fam, "both", {"view": "both", "click": "summary"}, {"view": "manifest"})


@query("require_fields", "SELECT problem, count(*) AS n FROM (SELECT CASE WHEN quality IS NULL THEN 'missing:quality' END AS problem FROM documents LEFT JOIN labels USING (doc_id) UNION ALL SELECT 'type:lang' FROM documents) WHERE problem IS NOT NULL GROUP BY problem")
def _(t):
    rows = t.documents.join(t.labels, "doc_id", "left")
    r = R.require_fields(rows, {"doc_id": "bigint", "lang": "int", "quality": "int"})
    return r.select(F.explode("problems").alias("problem")).groupBy("problem").agg(F.count("*").alias("n"))


# ---- reducers ---------------------------------------------------------------------------


@query("zero_fill", "SELECT g AS family, coalesce(n, 0) AS records, n IS NULL AS no_data FROM (SELECT unnest(['view', 'click', 'git', 'sql']) AS g) LEFT JOIN (SELECT event_type, count(*) AS n FROM events GROUP BY 1) ON g = event_type")
def _(t):
    counts = t.events.groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("records"))
    return reducers.zero_fill(counts, ["view", "click", "git", "sql"])


@query("summary_index", "SELECT event_type AS family, count(*) AS records, CASE event_type WHEN 'view' THEN 'manifest' ELSE 'both' END AS mode, CASE WHEN event_type <> 'view' THEN event_type || '.summary.json' END AS path FROM events GROUP BY event_type")
def _(t):
    counts = t.events.groupBy(F.col("event_type").alias("family")).agg(F.count("*").alias("records"))
    return reducers.summary_index(counts, {"view": "manifest"})


@query("bundle_summary", f"SELECT 'scan' AS producer, count(*) AS records FROM {_RAW}")
def _(t):
    return reducers.bundle_summary(R.wrap_records(raw_findings(t), "scan", seen_at()))


@query("reduce_generic", "SELECT 'totals' AS metric, unnest(['l_linenumber', 'l_orderkey', 'l_partkey', 'l_suppkey']) AS name, unnest([sum(l_linenumber)::DOUBLE, sum(l_orderkey)::DOUBLE, sum(l_partkey)::DOUBLE, sum(l_suppkey)::DOUBLE]) AS value FROM lineitem")
def _(t):
    return reducers.reduce_generic(t.lineitem)


@query(
    "reduce_quality",
    """SELECT 'totals' AS metric, unnest(['loc', 'cyclomatic']) AS name, unnest([sum(l_quantity)::DOUBLE, sum(l_linenumber)::DOUBLE]) AS value FROM lineitem
    UNION ALL SELECT * FROM (SELECT 'top', l_suppkey::VARCHAR, max(l_linenumber)::DOUBLE AS s FROM lineitem GROUP BY l_suppkey ORDER BY s DESC, l_suppkey::VARCHAR LIMIT 50)""",
)
def _(t):
    return reducers.reduce_quality(t.lineitem.select(F.col("l_quantity").cast("bigint").alias("loc"), F.col("l_linenumber").alias("cyclomatic"), F.col("l_suppkey").cast("string").alias("file")))


def _top_sql(col, metric, n=50, src="events"):
    return f"SELECT * FROM (SELECT '{metric}' AS metric, {col} AS name, count(*)::DOUBLE AS value FROM {src} GROUP BY 2 ORDER BY 3 DESC, 2 LIMIT {n})"


@query("reduce_env", f"SELECT 'totals' AS metric, unnest(['keys', 'files']) AS name, unnest([count(*)::DOUBLE, count(DISTINCT user_id)::DOUBLE]) AS value FROM events UNION ALL {_top_sql('event_type', 'top')}")
def _(t):
    return reducers.reduce_env(t.events.select(F.col("event_type").alias("key"), F.col("user_id").cast("string").alias("file")))


@query("reduce_deps", f"SELECT 'totals' AS metric, 'packages' AS name, count(DISTINCT user_id)::DOUBLE AS value FROM events UNION ALL {_top_sql('user_id::VARCHAR', 'top')}")
def _(t):
    return reducers.reduce_deps(t.events.select(F.col("user_id").cast("string").alias("package")))


@query("reduce_ast_imports", f"SELECT 'totals' AS metric, unnest(['imports', 'unique']) AS name, unnest([count(*)::DOUBLE, count(DISTINCT p_brand)::DOUBLE]) AS value FROM part UNION ALL {_top_sql('p_brand', 'top', src='part')}")
def _(t):
    return reducers.reduce_ast_imports(t.part.select(F.col("p_brand").alias("module")))


@query("reduce_ast_calls", f"SELECT 'totals' AS metric, 'calls_total' AS name, count(*)::DOUBLE AS value FROM part UNION ALL {_top_sql('p_type', 'calls_top', src='part')}")
def _(t):
    return reducers.reduce_ast_calls(t.part.select(F.col("p_type").alias("callee")))


@query("reduce_docs", "SELECT 'metrics_sum' AS metric, 'coverage' AS name, sum(quality)::DOUBLE AS value FROM labels")
def _(t):
    return reducers.reduce_docs(t.labels.select(F.col("quality").alias("coverage")))


@query("reduce_ast_docstring", f"SELECT 'totals' AS metric, 'docstrings' AS name, count(*)::DOUBLE AS value FROM events UNION ALL {_top_sql('event_type', 'by_owner_kind')} UNION ALL {_top_sql('user_id::VARCHAR', 'top_owners')} UNION ALL {_top_sql('user_id::VARCHAR', 'files_top')}")
def _(t):
    u = F.col("user_id").cast("string")
    return reducers.reduce_ast_docstring(t.events.select(F.col("event_type").alias("owner_kind"), u.alias("owner"), u.alias("file")))


@query("reduce_static", f"SELECT 'totals' AS metric, 'count' AS name, count(*)::DOUBLE AS value FROM orders UNION ALL {_top_sql('o_orderstatus', 'by_severity', src='orders')} UNION ALL {_top_sql('o_orderpriority', 'top_checks', 15, 'orders')}")
def _(t):
    return reducers.reduce_static(t.orders.select(F.col("o_orderstatus").alias("severity"), F.col("o_orderpriority").alias("check")))


@query("reduce_entrypoints", "SELECT CASE event_type WHEN 'view' THEN 'python' ELSE 'shell' END AS metric, event_id::VARCHAR AS name, 1.0::DOUBLE AS value FROM events WHERE event_type IN ('view', 'click') UNION ALL SELECT 'totals', 'total', count(*)::DOUBLE FROM events WHERE event_type IN ('view', 'click')")
def _(t):
    kind = F.when(F.col("event_type") == "view", "Py").when(F.col("event_type") == "click", "BASH").otherwise("other")
    return reducers.reduce_entrypoints(t.events.select(kind.alias("kind"), F.concat(F.lit("bin/"), F.col("event_id").cast("string")).alias("file")))


@query("reduce_license", f"SELECT 'totals' AS metric, unnest(['files', 'with_header', 'without_header']) AS name, unnest([count(*), count(*) FILTER (WHERE quality = 1), count(*) FILTER (WHERE quality = 0)])::DOUBLE AS value FROM documents LEFT JOIN labels USING (doc_id) UNION ALL {_top_sql('lang', 'spdx_top', src='documents')}")
def _(t):
    d = t.documents.join(t.labels, "doc_id", "left")
    return reducers.reduce_license(d.select(F.col("lang").alias("spdx_id"), (F.col("quality") == 1).alias("has_header")))


@query("reduce_git", "SELECT 'info' AS metric, k AS name, arg_max(v, event_id) AS text FROM (SELECT event_id, unnest([event_type, 'last']) AS k, unnest([user_id::VARCHAR, event_type]) AS v FROM events) GROUP BY k")
def _(t):
    props = F.create_map(F.col("event_type"), F.col("user_id").cast("string"), F.lit("last"), F.col("event_type"))
    return reducers.reduce_git(t.events.select(F.col("event_id").alias("seq"), props.alias("props")))


@query(
    "reduce_io_core",
    """SELECT metric, rn::VARCHAR AS name, props AS text FROM (SELECT CASE event_type WHEN 'view' THEN 'manifest_header' ELSE 'bundle_summary' END AS metric, props,
    row_number() OVER (PARTITION BY event_type ORDER BY event_id) AS rn FROM events WHERE event_type IN ('view', 'click')) WHERE (metric = 'bundle_summary' AND rn <= 5) OR rn = 1""",
)
def _(t):
    rt = F.when(F.col("event_type") == "view", "manifest_header").when(F.col("event_type") == "click", "bundle_summary")
    return reducers.reduce_io_core(t.events.select(F.col("event_id").alias("seq"), rt.alias("record_type"), F.col("props").alias("payload")))


@query(
    "reduce_families",
    f"""SELECT 'deps' AS family, 'totals' AS metric, 'packages' AS name, count(DISTINCT name)::DOUBLE AS value FROM (SELECT lang AS name FROM documents)
    UNION ALL SELECT 'deps', * FROM ({_top_sql('lang', 'top', src='documents')}) UNION ALL SELECT 'static', 'totals', 'count', count(*)::DOUBLE FROM labels""",
)
def _(t):
    items = t.documents.select(F.lit("deps").alias("family"), F.col("lang").alias("name")).unionByName(t.labels.select(F.lit("static").alias("family"), F.col("doc_id").cast("string").alias("name")))
    return reducers.reduce_families(items, ["static", "deps"])


def _ranked_sql(family: str, metric: str, name: str, source: str, n: int) -> str:
    return f"""SELECT '{family}' AS family, '{metric}' AS metric, name, c::DOUBLE AS value FROM (SELECT {name} AS name, count(*) AS c FROM {source} GROUP BY 1) WHERE name IS NOT NULL
    QUALIFY row_number() OVER (ORDER BY c DESC, name) <= {n}"""


@query(
    "reduce_records",
    f"""WITH r AS (SELECT * FROM {_RAW}), l AS (SELECT * FROM r WHERE kind = 'license.hint'), st AS (SELECT code FROM r WHERE kind = 'static.issue')
    SELECT 'license' AS family, 'totals' AS metric, 'files' AS name, count(*)::DOUBLE AS value FROM l HAVING count(*) > 0
    UNION ALL {_ranked_sql("license", "spdx_top", "code", "l", 50)}
    UNION ALL SELECT 'static', 'totals', 'count', count(*)::DOUBLE FROM st HAVING count(*) > 0
    UNION ALL SELECT 'static', 'by_severity', 'info', count(*)::DOUBLE FROM st HAVING count(*) > 0
    UNION ALL {_ranked_sql("static", "top_checks", "'unknown'", "st", 15)}
    UNION ALL {_ranked_sql("static", "top_codes", "code", "st", 15)}
    UNION ALL SELECT 'secrets', 'totals', 'records', count(*)::DOUBLE FROM r WHERE kind = 'secrets.finding' HAVING count(*) > 0""",
)
def _(t):
    wrapped = R.wrap_records(raw_findings(t), "scan", seen_at())
    return families.reduce_records(wrapped).select("family", "metric", "name", "value")


@query(
    "reduce_event_records",
    f"""WITH e AS (SELECT *, CASE WHEN event_type = 'view' THEN 'm' || user_id % 70 END AS module, CASE WHEN event_type = 'purchase' THEN 'f' || user_id % 90 END AS file FROM events),
    imports AS (SELECT * FROM e WHERE event_type = 'view'), calls AS (SELECT * FROM e WHERE event_type = 'click'), quality AS (SELECT * FROM e WHERE event_type = 'purchase'), deps AS (SELECT * FROM e WHERE event_type = 'signup')
    SELECT 'ast_imports' AS family, 'totals' AS metric, 'imports' AS name, count(*)::DOUBLE AS value FROM imports HAVING count(*) > 0
    UNION ALL SELECT 'ast_imports', 'totals', 'unique', count(DISTINCT module)::DOUBLE FROM imports HAVING count(*) > 0
    UNION ALL {_ranked_sql("ast_imports", "top", "module", "imports", 50)}
    UNION ALL SELECT 'ast_calls', 'totals', 'calls_total', count(*)::DOUBLE FROM calls HAVING count(*) > 0
    UNION ALL {_ranked_sql("ast_calls", "calls_top", "'u' || user_id", "calls", 50)}
    UNION ALL SELECT 'quality', 'totals', unnest(['loc', 'cyclomatic']), unnest([sum(user_id % 100), sum(event_id % 10)])::DOUBLE FROM quality HAVING count(*) > 0
    UNION ALL SELECT 'quality', 'top', file, max(event_id % 10)::DOUBLE AS score FROM quality GROUP BY file QUALIFY row_number() OVER (ORDER BY score DESC, file) <= 50
    UNION ALL SELECT 'deps', 'totals', 'packages', count(DISTINCT user_id)::DOUBLE FROM deps HAVING count(*) > 0
    UNION ALL {_ranked_sql("deps", "top", "'p' || user_id", "deps", 50)}
    UNION ALL SELECT 'other', 'totals', unnest(['user', 'records']), unnest([sum(user_id), count(*)])::DOUBLE FROM e WHERE event_type NOT IN ('view', 'click', 'purchase', 'signup') HAVING count(*) > 0""",
)
def _(t):
    kinds = {"view": "edge.import", "click": "ast.call", "purchase": "quality.file", "signup": "deps.entry"}
    user, of = F.col("user_id"), lambda name, value: F.when(F.col("event_type") == name, value)
    named = lambda letter, value: F.concat(F.lit(letter), value.cast("string"))
    raw = t.events.select(
        F.coalesce(R.lookup("event_type", kinds), F.lit("other.event")).alias("kind"),
        of("view", named("m", user % 70)).alias("module"),
        of("click", named("u", user)).alias("callee"),
        of("purchase", named("f", user % 90)).alias("file"),
        of("purchase", user % 100).alias("loc"),
        of("purchase", F.col("event_id") % 10).alias("complexity"),
        of("signup", named("p", user)).alias("package"),
        F.when(~F.col("event_type").isin(*kinds), user).alias("user"),
    )
    return families.reduce_records(R.wrap_records(raw, "log", seen_at())).select("family", "metric", "name", "value")


@query(
    "highlights",
    """SELECT 'stats' AS section, unnest(['files_total_python', 'python_functions', 'python_classes', 'python_loc', 'python_symbols', 'imports_statements', 'sql_graph_edges']) AS name, NULL::INT AS rank, NULL AS label,
    unnest([NULL, (SELECT sum(l_linenumber) FROM lineitem), (SELECT count(*) FILTER (l_returnflag = 'A') FROM lineitem), (SELECT sum(l_quantity::BIGINT) FROM lineitem), (SELECT count(*) FROM customer), (SELECT count(*) FROM part), (SELECT count(*) FROM orders)])::DOUBLE AS value
    UNION ALL SELECT 'risks', unnest(['secrets_findings', 'license_flags']), NULL, NULL, unnest([0, (SELECT count(*) FROM documents)])::DOUBLE
    UNION ALL SELECT 'top', 'complexity_modules', row_number() OVER (ORDER BY n_chars DESC, doc_id::VARCHAR), doc_id::VARCHAR, n_chars FROM documents QUALIFY row_number() OVER (ORDER BY n_chars DESC, doc_id::VARCHAR) <= 5
    UNION ALL SELECT 'top', 'import_modules', row_number() OVER (ORDER BY c DESC, p_brand), p_brand, c FROM (SELECT p_brand, count(*) AS c FROM part GROUP BY p_brand) QUALIFY row_number() OVER (ORDER BY c DESC, p_brand) <= 5
    UNION ALL SELECT 'top', 'entrypoints', row_number() OVER (ORDER BY s_name), s_name, NULL FROM supplier QUALIFY row_number() OVER (ORDER BY s_name) <= 5""",
)
def _(t):
    quality = t.lineitem.select(F.col("l_quantity").cast("bigint").alias("loc"), F.col("l_linenumber").alias("n_functions"), F.when(F.col("l_returnflag") == "A", 1).otherwise(0).alias("n_classes"))
    parts = {
        "quality_metric": reducers.reduce_quality_metric(quality), "ast_imports": reducers.reduce_ast_imports(t.part.select(F.col("p_brand").alias("module"))),
        "license": reducers.reduce_license(t.documents.select(F.col("lang").alias("spdx_id"))),
        "ast_symbols": reducers.reduce_generic(t.customer.select("c_name")), "sql_refs": reducers.reduce_generic(t.orders.select("o_orderpriority")),
    }
    summary = R.union_records(*(df.withColumn("family", F.lit(name)) for name, df in parts.items()))
    tops = {
        "complexity_modules": t.documents.select(F.col("doc_id").alias("label"), F.col("n_chars").alias("value")),
        "import_modules": t.part.groupBy(F.col("p_brand").alias("label")).agg(F.count("*").alias("value")),
        "entrypoints": t.supplier.select(F.col("s_name").alias("label"), F.lit(None).alias("value")),
    }
    return reducers.highlights(summary, tops)


@query("sample_items", "SELECT c_name AS name, c_custkey FROM customer ORDER BY c_name LIMIT 200")
def _(t):
    return reducers.top_records(t.customer.select(F.col("c_name").alias("name"), "c_custkey"), 200)


@query("content_hash", """SELECT event_id, sha256('{"event_type":"' || event_type || '","user_id":' || user_id || '}') AS h FROM events""")
def _(t):
    return t.events.select("event_id", H.content_hash(["user_id", "event_type"]).alias("h"))
