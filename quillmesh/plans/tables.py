"""Window, join, ordering and data-quality queries over the relational tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from ..functions import misc as M
from ..functions import paths as P
from ..operators import constraints as K
from ..operators import items as I
from ..operators import joins as J
from ..operators import messages as MS
from ..operators import ordered as O
from ..operators import quality as Q
from ..operators.deps import stable_order
from ..operators.ranks import ranked
from ..streaming import flows
from .registry import FILES, query

# ---- windows ---------------------------------------------------------------------------


@query("first_seen", "SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS rn FROM events) WHERE rn = 1")
def _(t):
    return O.first_seen(t.events, ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("latest_version", "SELECT o_custkey, o_orderkey, o_totalprice FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1")
def _(t):
    return O.latest_version(t.orders, ["o_custkey"], [F.desc("o_orderdate"), F.desc("o_orderkey")]).select("o_custkey", "o_orderkey", "o_totalprice")


@query("retain_last", "SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) <= 3 AS retained FROM events")
def _(t):
    return O.retain_last(t.events, ["user_id"], [F.desc("ts"), F.desc("event_id")], 3, "event_id").select("event_id", "retained")


@query("top_n_per_group", "SELECT event_type, user_id, n, rank FROM (SELECT event_type, user_id, n, row_number() OVER (PARTITION BY event_type ORDER BY n DESC, user_id) AS rank FROM (SELECT event_type, user_id, count(*) AS n FROM events GROUP BY ALL)) WHERE rank <= 10")
def _(t):
    counts = t.events.groupBy("event_type", "user_id").agg(F.count("*").alias("n"))
    return O.top_n(counts, ["event_type"], [F.desc("n"), "user_id"], 10, "rank")


@query("running_bytes", f"SELECT path, sum(size) OVER (PARTITION BY source ORDER BY doc_id)::BIGINT AS upto FROM {FILES}")
def _(t):
    f = t.files.withColumn("_s", F.floor(F.col("doc_id") / 512))
    return O.running_sum(f.drop("text"), ["source"], "_s", ["doc_id"], "size", "upto").select("path", "upto")


@query("batch_items", "SELECT event_id, ((row_number() OVER (ORDER BY event_id) - 1) // 50 + 1) AS batch_no FROM events")
def _(t):
    return O.batch_items(t.events.select("event_id"), ["event_id"], 50).select("event_id", "batch_no")


@query("limit_totals", f"SELECT path FROM (SELECT path, sum(size) OVER (ORDER BY doc_id) AS upto, sum(size) OVER () AS total FROM {FILES}) WHERE upto <= total // 3")
def _(t):
    f = t.files.select("path", "doc_id", "size")
    third = f.agg(F.floor(F.sum("size") / 3)).scalar()
    return O.limit_totals(f, ["doc_id"], "size", max_bytes=third).select("path")


@query(
    "dup_flag",
    r"""SELECT doc_id, CASE WHEN length(s) <= 50 THEN 'Bad docstring' WHEN row_number() OVER (PARTITION BY s ORDER BY lang, doc_id) = 1 THEN 'keep' ELSE 'Duplicate docstring — skipped' END AS verdict
    FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents)""",
)
def _(t):
    return O.dup_flag(t.documents, "text", "lang", "doc_id").select("doc_id", "verdict")


@query(
    "scan_outcomes",
    r"""SELECT count(*) AS entries, count(*) FILTER (WHERE v <> 'd') AS written, count(*) FILTER (WHERE v = 'd') AS duplicates, count(*) FILTER (WHERE v = 'b') AS bad, count(*) FILTER (WHERE v = 'k') AS ok
    FROM (SELECT CASE WHEN length(s) <= 50 THEN 'b' WHEN row_number() OVER (PARTITION BY s ORDER BY doc_id) = 1 THEN 'k' ELSE 'd' END AS v FROM (SELECT doc_id, lang, regexp_replace(text, '^\s+|\s+$', '', 'g') AS s FROM documents))""",
)
def _(t):
    return I.scan_outcomes(O.dup_flag(t.documents, "text", "lang", "doc_id"))


_FLOW = """(SELECT user_id::VARCHAR AS run_id, json_extract_string(props, '$.k') AS phase, CASE WHEN event_type = 'view' THEN 'begin' WHEN event_type IN ('purchase', 'error') THEN 'end' END AS event, CASE event_type WHEN 'error' THEN 'error' ELSE 'ok' END AS status, ts, event_id AS seq FROM events)"""


def _flow(t):
    event = F.when(F.col("event_type") == "view", "begin").when(F.col("event_type").isin("purchase", "error"), "end")
    status = F.when(F.col("event_type") == "error", "error").otherwise("ok")
    return t.events.select(F.col("user_id").cast("string").alias("run_id"), F.get_json_object("props", "$.k").alias("phase"), event.alias("event"), status.alias("status"), F.col("ts").cast("timestamp").alias("ts"), F.col("event_id").alias("seq"))


_PHASES = f"""(SELECT run_id, phase, ts AS b, CASE WHEN next = 'end' THEN next_ts END AS e, CASE WHEN next = 'end' THEN next_status END AS status FROM (
    SELECT *, lead(event) OVER w AS next, lead(ts) OVER w AS next_ts, lead(status) OVER w AS next_status FROM (
      SELECT *, sum(CASE event WHEN 'begin' THEN 1 ELSE -1 END) OVER (PARTITION BY run_id, phase ORDER BY ts, seq) - CASE event WHEN 'begin' THEN 1 ELSE 0 END AS level FROM {_FLOW} WHERE event IS NOT NULL)
    WINDOW w AS (PARTITION BY run_id, phase, level ORDER BY ts, seq)) WHERE event = 'begin')"""


@query("phase_durations", f"SELECT run_id, phase, epoch_us(b) AS begin_us, (epoch_us(e) - epoch_us(b)) // 1000 AS dur_ms, coalesce(status, 'open') AS status FROM {_PHASES}")
def _(t):
    return O.phase_durations(_flow(t)).select("run_id", "phase", F.unix_micros("begin_ts").alias("begin_us"), "dur_ms", "status")


@query("phase_pairs", f"SELECT run_id, phase, (epoch_us(e) - epoch_us(b)) // 1000 AS dur_ms, status FROM {_PHASES} WHERE e <= b + INTERVAL 1 DAY")
def _(t):
    return flows.phase_pairs(_flow(t)).select("run_id", "phase", "dur_ms", "status")


@query("enclosing_function", "SELECT event_id, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS signup_id FROM events")
def _(t):
    e = t.events.withColumn("_v", F.when(F.col("event_type") == "signup", F.col("event_id"))).withColumn("_s", F.date_trunc("day", "ts"))
    return O.carry_last(e, ["user_id"], "_s", ["ts", "event_id"], "_v", "signup_id").select("event_id", "signup_id")


# ---- messages --------------------------------------------------------------------------


@query("token_totals", "SELECT conv_id, sum((length(text) + 3) // 4 + 3)::BIGINT AS tokens, count(*) AS messages FROM conversations GROUP BY conv_id")
def _(t):
    return MS.token_totals(t.conversations)


@query(
    "clamp_to_budget",
    """WITH RECURSIVE m AS (SELECT conv_id, turn, text, (length(text) + 3) // 4 + 3 AS c, row_number() OVER (PARTITION BY conv_id ORDER BY turn DESC) AS n FROM conversations),
    w AS (SELECT conv_id, 0::BIGINT AS n, 0::BIGINT AS used, false AS stop, NULL::BIGINT AS turn, -1::BIGINT AS tail, false AS keep FROM (SELECT DISTINCT conv_id FROM m)
      UNION ALL SELECT m.conv_id, m.n, CASE WHEN w.used + m.c <= 400 THEN w.used + m.c WHEN 400 - w.used > 8 THEN 400 ELSE w.used END,
        CASE WHEN w.used + m.c <= 400 THEN w.used + m.c >= 400 ELSE 400 - w.used > 8 OR w.used >= 400 END, m.turn,
        CASE WHEN w.used + m.c <= 400 THEN -1 ELSE (400 - w.used) * 4 END, w.used + m.c <= 400 OR 400 - w.used > 8
      FROM w JOIN m ON m.conv_id = w.conv_id AND m.n = w.n + 1 WHERE NOT w.stop)
    SELECT w.conv_id, w.turn, CASE WHEN tail < 0 THEN text ELSE right(text, tail) END AS text, tail >= 0 AS truncated FROM w JOIN conversations c ON c.conv_id = w.conv_id AND c.turn = w.turn WHERE keep""",
)
def _(t):
    return MS.clamp_to_budget(t.conversations, 400).select("conv_id", "turn", "text", "truncated")


# ---- joins -----------------------------------------------------------------------------


@query("prune_delta", f"SELECT path FROM {FILES} WHERE doc_id NOT IN (SELECT doc_id FROM labels)")
def _(t):
    local = t.files.join(t.labels.select("doc_id"), "doc_id", "left_semi")
    return J.prune_delta(t.files.select("path"), local)


@query("except_paths", f"SELECT path FROM {FILES} EXCEPT SELECT path FROM {FILES} WHERE lang = 'en'")
def _(t):
    return J.except_paths(t.files, t.files.where(F.col("lang") == "en"))


@query(
    "merge_context",
    """SELECT doc_id, CASE WHEN quality IS NULL THEN lang ELSE 'q' || quality END AS a, source AS b, CASE WHEN quality IS NULL THEN NULL ELSE toxic::VARCHAR END AS c FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    items = t.documents.select(F.col("doc_id").alias("id"), F.create_map(F.lit("a"), F.col("lang"), F.lit("b"), F.col("source")).alias("props"))
    q = F.concat(F.lit("q"), F.col("quality").cast("string"))
    ctx = t.labels.select(F.col("doc_id").alias("id"), F.create_map(F.lit("a"), q, F.lit("c"), F.col("toxic").cast("string")).alias("props"))
    m = J.merge_context(items, ctx)
    return m.select(F.col("id").alias("doc_id"), *[F.try_element_at("props", F.lit(k)).alias(k) for k in "abc"])


@query(
    "merge_batch_meta",
    """SELECT doc_id::VARCHAR AS id, source || '/' || doc_id || '.py' AS relpath, CASE WHEN quality = 1 THEN 9 ELSE 1 END::BIGINT AS target_lineno, CASE WHEN quality IS NULL THEN 'module' ELSE 'def f' || quality END AS signature,
    coalesce(toxic = 1, false) AS has_docstring FROM documents LEFT JOIN labels USING (doc_id)""",
)
def _(t):
    rel = F.concat(F.lit(".\\.\\"), "source", F.lit("/"), F.col("doc_id").cast("string"), F.lit(".py"))
    null = F.lit(None).cast("string")
    results = t.documents.select(F.col("doc_id").cast("string").alias("id"), F.col("text").alias("docstring"), rel.alias("relpath"), F.lit(None).cast("int").alias("target_lineno"), null.alias("signature"))
    batch = t.labels.select(
        F.col("doc_id").cast("string").alias("id"), null.alias("relpath"), F.lit("").alias("filepath"), (F.col("quality") * 9).alias("target_lineno"),
        F.concat(F.lit("def f"), F.col("quality").cast("string")).alias("signature"), (F.col("toxic") == 1).alias("has_docstring"),
    )
    return J.merge_batch_meta(results, batch).drop("docstring")


@query(
    "map_qualnames",
    """WITH n AS (SELECT p_partkey, p_type || '.' || p_brand || '.' || p_size AS d, p_type AS a, p_type || '.' || p_brand AS b, lower(p_type) AS low FROM part),
    w AS (SELECT DISTINCT p_type || '.' || p_brand AS old FROM part WHERE p_size = 1)
    SELECT p_partkey, CASE WHEN b IN (SELECT old FROM w) THEN 'whole' || substr(d, length(b) + 1) ELSE 'x.' || low || substr(d, length(a) + 1) END AS new_name FROM n""",
)
def _(t):
    name = F.concat_ws(".", "p_type", "p_brand", F.col("p_size").cast("string"))
    short = t.part.select(F.col("p_type").alias("old"), F.concat(F.lit("x."), F.lower("p_type")).alias("new"))
    whole = t.part.where(F.col("p_size") == 1).select(F.concat_ws(".", "p_type", "p_brand").alias("old"), F.lit("whole").alias("new"))
    return J.map_qualnames(t.part.select("p_partkey", name.alias("name")), short.union(whole).distinct()).select("p_partkey", "new_name")


@query("fk_orphans", "SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')")
def _(t):
    return J.fk_orphans(t.lineitem, t.orders.where("o_orderstatus <> 'F'"), "l_orderkey", "o_orderkey").select("l_orderkey", "l_linenumber")


@query("required_rows", "SELECT n_nationkey AS k, CASE WHEN n_nationkey IN (SELECT c_nationkey FROM customer WHERE c_acctbal > 9000) THEN 'ok' ELSE 'missing' END AS status FROM nation")
def _(t):
    rich = t.customer.where(F.col("c_acctbal") > 9000).select(F.col("c_nationkey").alias("k"))
    return J.required_rows(t.nation.select(F.col("n_nationkey").alias("k")), rich, "k")


@query(
    "changed_files",
    f"""SELECT path, change FROM (SELECT source || '/' || doc_id || '.txt' AS path, CASE WHEN quality IS NULL THEN 'added' WHEN lang = 'fr' THEN 'removed' WHEN toxic = 1 THEN 'modified' END AS change
    FROM documents LEFT JOIN labels USING (doc_id)) WHERE change IS NOT NULL""",
)
def _(t):
    d = t.files.join(t.labels, "doc_id", "left")
    old = d.where(F.col("quality").isNotNull())
    text = F.when(F.col("toxic") == 1, F.concat("text", F.lit("!"))).otherwise(F.col("text"))
    new = d.where(F.col("quality").isNull() | (F.col("lang") != "fr")).withColumn("text", text)
    return J.changed_files(old, new)


@query(
    "tree_digest",
    f"""SELECT sha256(concat_ws('|', count(*)::VARCHAR, sum(w1)::VARCHAR, sum(w2)::VARCHAR, sum(w3)::VARCHAR, sum(w4)::VARCHAR)) AS digest FROM (SELECT ('0x' || substr(h, 1, 12))::HUGEINT AS w1, ('0x' || substr(h, 13, 12))::HUGEINT AS w2,
    ('0x' || substr(h, 25, 12))::HUGEINT AS w3, ('0x' || substr(h, 37, 12))::HUGEINT AS w4 FROM (SELECT sha256(encode(path) || '\\x00'::BLOB || encode(text)) AS h FROM {FILES}))""",
)
def _(t):
    return J.tree_digest(t.files)


# ---- order, sets, quality ----------------------------------------------------------------


@query("stable_order", "SELECT n_name, row_number() OVER (ORDER BY lower(n_name), n_name) AS pos FROM nation")
def _(t):
    ordered = stable_order(t.nation.select("n_name"), "n_name")
    return ranked(ordered, [], [F.lower("n_name"), F.col("n_name")]).select("n_name", (F.col("rank") + 1).alias("pos"))


@query(
    "check_rows",
    """SELECT l_orderkey, l_linenumber, concat_ws(',', CASE WHEN NOT l_discount BETWEEN 0 AND 0.05 THEN 'discount' END, CASE WHEN l_linestatus NOT IN ('O') THEN 'status' END, CASE WHEN NOT l_quantity > 10 THEN 'qty' END) AS failed FROM lineitem""",
)
def _(t):
    rules = {"discount": Q.in_range("l_discount", 0, 0.05), "status": Q.in_set("l_linestatus", ["O"]), "qty": F.col("l_quantity") > 10}
    return Q.check_rows(t.lineitem, rules).select("l_orderkey", "l_linenumber", F.array_join("failed", ",").alias("failed"))


@query(
    "rule_report",
    "SELECT unnest(['json', 'label', 'positive', 'known']) AS rule, unnest([0, (SELECT count(*) FROM documents WHERE doc_id NOT IN (SELECT doc_id FROM labels)), (SELECT count(*) FROM events WHERE value <= 0), (SELECT count(*) FROM events WHERE event_type NOT IN ('view', 'click'))])::BIGINT AS violations",
)
def _(t):
    d = Q.rule_report(t.documents.join(t.labels, "doc_id", "left"), {"label": Q.not_null("quality")})
    e = Q.rule_report(t.events, {"json": Q.valid_json("props"), "positive": Q.positive("value"), "known": Q.in_set("event_type", ["view", "click"])})
    return d.unionByName(e)


@query("unique_violations", "SELECT l_orderkey, l_partkey, count(*) AS n FROM lineitem GROUP BY ALL HAVING count(*) > 1")
def _(t):
    return Q.unique_violations(t.lineitem, ["l_orderkey", "l_partkey"])


@query("apply_defaults", "SELECT doc_id, coalesce(quality, -1) AS quality, 'active' AS status FROM documents LEFT JOIN labels USING (doc_id)")
def _(t):
    return Q.apply_defaults(t.documents.join(t.labels, "doc_id", "left"), {"quality": -1, "status": "active"}).select("doc_id", "quality", "status")


# ---- constraint catalog ---------------------------------------------------------------

CATALOG = {
    "nation": K.Rules(
        types={"n_nationkey": "int", "n_name": "string", "n_regionkey": "int"}, required=("n_nationkey", "n_name"), checks={"name": "n_name = upper(n_name)"},
        keys=(("n_nationkey",), ("n_regionkey",)), references=(K.Reference(("n_regionkey",), "region", ("r_regionkey",)),),
    ),
    "customer": K.Rules(
        types={"c_custkey": "bigint", "c_name": "string", "c_mktsegment": "string"}, required=("c_custkey", "c_name"),
        checks={"balance": "c_acctbal >= 0", "segment": "c_mktsegment IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')"},
        keys=(("c_custkey",),), references=(K.Reference(("c_nationkey",), "nation", ("n_nationkey",)),),
    ),
    "orders": K.Rules(
        types={"o_orderkey": "bigint", "o_totalprice": "tinyint"}, required=("o_orderkey", "o_custkey", "o_orderdate"),
        checks={"status": "o_orderstatus IN ('O', 'F')", "price": "o_totalprice > 1500"},
        keys=(("o_orderkey",), ("o_custkey", "o_orderdate")), references=(K.Reference(("o_custkey",), "rich_customer", ("c_custkey",)),),
    ),
    "lineitem": K.Rules(
        types={"l_orderkey": "bigint", "l_quantity": "double", "l_net": "double"}, required=("l_orderkey", "l_linenumber"),
        generated={"l_net": "l_extendedprice * (1 - l_discount)"}, checks={"discount": "l_discount BETWEEN 0 AND 0.05", "net": "l_net >= 1000", "flag": "l_returnflag <> 'R' OR l_linestatus = 'F'"},
        keys=(("l_orderkey", "l_linenumber"),), references=(K.Reference(("l_orderkey",), "open_orders", ("o_orderkey",)), K.Reference(("l_partkey",), "part", ("p_partkey",))),
    ),
}


def _dup_sql(table: str, cols: str) -> str:
    return f"(SELECT coalesce(sum(n), 0) FROM (SELECT count(*) AS n FROM {table} GROUP BY {cols} HAVING count(*) > 1))"


@query(
    "constraint_report",
    f"""SELECT 'nation' AS "table", unnest(['type n_nationkey', 'type n_name', 'type n_regionkey', 'required n_nationkey', 'required n_name', 'check name', 'key n_nationkey', 'key n_regionkey', 'reference n_regionkey -> region']) AS rule,
      unnest([0, 0, 0, 0, 0, (SELECT count(*) FROM nation WHERE n_name <> upper(n_name)), {_dup_sql("nation", "n_nationkey")}, {_dup_sql("nation", "n_regionkey")}, (SELECT count(*) FROM nation WHERE n_regionkey NOT IN (SELECT r_regionkey FROM region))])::BIGINT AS violations
    UNION ALL SELECT 'customer', unnest(['type c_custkey', 'type c_name', 'type c_mktsegment', 'required c_custkey', 'required c_name', 'check balance', 'check segment', 'key c_custkey', 'reference c_nationkey -> nation']),
      unnest([0, 0, 0, 0, 0, (SELECT count(*) FROM customer WHERE c_acctbal < 0), (SELECT count(*) FROM customer WHERE c_mktsegment NOT IN ('BUILDING', 'MACHINERY', 'HOUSEHOLD')), {_dup_sql("customer", "c_custkey")}, (SELECT count(*) FROM customer WHERE c_nationkey NOT IN (SELECT n_nationkey FROM nation))])
    UNION ALL SELECT 'orders', unnest(['type o_orderkey', 'type o_totalprice', 'required o_orderkey', 'required o_custkey', 'required o_orderdate', 'check status', 'check price', 'key o_orderkey', 'key o_custkey, o_orderdate', 'reference o_custkey -> rich_customer']),
      unnest([0, (SELECT count(*) FROM orders WHERE trunc(o_totalprice) NOT BETWEEN -128 AND 127), 0, 0, 0, (SELECT count(*) FROM orders WHERE o_orderstatus NOT IN ('O', 'F')), (SELECT count(*) FROM orders WHERE o_totalprice <= 1500), {_dup_sql("orders", "o_orderkey")}, {_dup_sql("orders", "o_custkey, o_orderdate")},
        (SELECT count(*) FROM orders WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))])
    UNION ALL SELECT 'lineitem', unnest(['type l_orderkey', 'type l_quantity', 'required l_orderkey', 'required l_linenumber', 'check discount', 'check net', 'check flag', 'key l_orderkey, l_linenumber', 'reference l_orderkey -> open_orders', 'reference l_partkey -> part']),
      unnest([0, 0, 0, 0, (SELECT count(*) FROM lineitem WHERE NOT l_discount BETWEEN 0 AND 0.05), (SELECT count(*) FROM lineitem WHERE l_extendedprice * (1 - l_discount) < 1000), (SELECT count(*) FROM lineitem WHERE l_returnflag = 'R' AND l_linestatus <> 'F'), {_dup_sql("lineitem", "l_orderkey, l_linenumber")},
        (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders WHERE o_orderstatus <> 'F')), (SELECT count(*) FROM lineitem WHERE l_partkey NOT IN (SELECT p_partkey FROM part))])""",
)
def _(t):
    names = ("region", "nation", "customer", "orders", "lineitem", "part")
    views = {"rich_customer": t.customer.where("c_acctbal > 0"), "open_orders": t.orders.where("o_orderstatus <> 'F'")}
    return K.report({**{n: getattr(t, n) for n in names}, **views}, CATALOG)


@query(
    "conform_messages",
    """SELECT conv_id AS sender_id, turn::BIGINT AS receiver_id, CASE WHEN role = 'user' THEN text END AS content,
    CASE WHEN role = 'user' THEN 'info' ELSE role END AS msg_type, '{}' AS metadata, false AS read FROM conversations""",
)
def _(t):
    user = F.col("role") == "user"
    raw = t.conversations.select(
        F.col("conv_id").cast("string").alias("sender_id"), F.col("turn").alias("receiver_id"), F.when(user, F.col("text")).alias("content"), F.when(~user, F.col("role")).alias("msg_type"), F.lit("dropped").alias("extra"),
    )
    return K.conform(raw, K.store_rules("agent_messages")).drop("id", "created_at", "updated_at")


@query(
    "risk_gate",
    """SELECT c_custkey::VARCHAR AS patch_id, o_totalprice AS risk_score FROM customer JOIN (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate DESC, o_orderkey DESC) AS rn FROM orders) WHERE rn = 1) ON o_custkey = c_custkey
    WHERE o_orderstatus <> 'P' AND o_orderpriority NOT LIKE '1%' AND o_totalprice > 1000 AND o_orderkey % 2 = 0""",
)
def _(t):
    ev = t.orders.select(
        F.col("o_custkey").cast("string").alias("patch_id"), F.col("o_orderkey").alias("id"), F.col("o_orderdate").alias("evaluated_at"), F.col("o_orderdate").alias("tested_at"),
        F.col("o_totalprice").alias("risk_score"), (F.col("o_orderstatus") != "P").alias("is_safe_to_autoapply"), F.col("o_orderpriority").startswith("1").alias("human_required"),
        (F.col("o_totalprice") > 1000).alias("trusted"), (F.col("o_orderkey") % 2 == 0).alias("syntax_ok"), F.lit(True).alias("script_tests_ok"),
    )
    return Q.risk_gate(t.customer.select(F.col("c_custkey").cast("string").alias("patch_id")), ev, ev, ev)


@query("unread_messages", "SELECT user_id AS receiver_id, count(*) AS unread, min(event_id) AS oldest FROM events WHERE event_type <> 'view' GROUP BY user_id")
def _(t):
    return Q.unread_messages(t.events.select(F.col("user_id").alias("receiver_id"), (F.col("event_type") == "view").alias("read"), F.col("event_id").alias("created_at")))


@query("due_reviews", "SELECT o_custkey AS agent_id, year(o_orderdate)::INT AS review_cycle, count(*) AS due FROM orders WHERE o_orderstatus = 'O' GROUP BY ALL")
def _(t):
    r = t.orders.select(F.col("o_custkey").alias("agent_id"), F.year("o_orderdate").alias("review_cycle"), F.when(F.col("o_orderstatus") == "O", "pending").otherwise("done").alias("status"))
    return Q.due_reviews(r)


@query("active_rows", "SELECT o_orderkey FROM orders WHERE o_orderstatus = 'F'")
def _(t):
    return Q.active_rows(t.orders.withColumn("status", F.col("o_orderstatus")), "F").select("o_orderkey")


@query("json_props", "SELECT event_id, json_extract_string(props, '$.k')::BIGINT AS k, '{}' AS broken FROM events")
def _(t):
    return t.events.select("event_id", F.get_json_object(M.json_props("props"), "$.k").cast("bigint").alias("k"), M.json_props(F.concat(F.lit("{"), "props")).alias("broken"))


@query("csv_tags", "SELECT p_partkey, 'a,' || p_brand AS tags, 2::BIGINT AS n FROM part")
def _(t):
    from ..functions.text import csv_tags

    tags = csv_tags(F.concat(F.lit(" a ,, "), "p_brand", F.lit(" ,")))
    return t.part.select("p_partkey", F.array_join(tags, ",").alias("tags"), F.size(tags).cast("bigint").alias("n"))


@query("expires_at", "SELECT event_id, epoch_us(ts + INTERVAL 900 SECOND) AS until_us, ts + INTERVAL 900 SECOND <= TIMESTAMP '2024-01-15 00:00:00' AS expired FROM events")
def _(t):
    e = t.events.select("event_id", F.col("ts").cast("timestamp").alias("ts"), F.lit(900).alias("ttl"))
    now = F.lit("2024-01-15 00:00:00").cast("timestamp")
    return e.select("event_id", F.unix_micros(M.expires_at("ts", "ttl")).alias("until_us"), M.is_expired("ts", "ttl", now).alias("expired"))


@query("symbol_keys", "SELECT doc_id, 'hash_' || lang || '_' || substr(sha1(source || '|doc|' || lang || '|' || doc_id), 1, 10) AS h FROM documents")
def _(t):
    from ..functions.hashing import symbol_hash

    return t.documents.select("doc_id", symbol_hash("source", F.lit("doc"), "lang", "doc_id").alias("h"))


@query("categorize", "SELECT doc_id, ['document', 'code', 'archive', 'image', 'other'][doc_id % 5 + 1] AS category, 'm' || doc_id AS module FROM documents")
def _(t):
    exts = F.array(*[F.lit(e) for e in (".YML", ".py", ".tar.gz", ".heic", ".zzz")])
    name = F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.get(exts, (F.col("doc_id") % 5).cast("int")))
    return t.documents.select("doc_id", P.categorize(name).alias("category"), P.module_name(F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".py"))).alias("module"))


# ---- batch twins of the streams ------------------------------------------------------------


@query("stream_counts", "SELECT epoch_us(time_bucket(INTERVAL 1 HOUR, ts)) AS start_us, event_type, count(*) AS n FROM events GROUP BY ALL")
def _(t):
    c = flows.event_counts(t.events, ["event_type"], "1 hour")
    return c.select(F.unix_micros("window_start").alias("start_us"), "event_type", "n")


@query("stream_dedup", "SELECT user_id, event_type, min(event_id) AS event_id FROM events GROUP BY ALL")
def _(t):
    return flows.batch_dedup(t.events, ["user_id", "event_type"], ["event_id"]).select("user_id", "event_type", "event_id")


@query(
    "lock_states",
    """SELECT user_id::VARCHAR AS lock_name, CASE WHEN event_type NOT IN ('view', 'click') THEN 'free' WHEN ts + INTERVAL 6 HOUR <= TIMESTAMP '2024-01-29 12:00:00' THEN 'expired' ELSE 'held' END AS state
    FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts DESC, event_id DESC) AS rn FROM events) WHERE rn = 1""",
)
def _(t):
    action = F.when(F.col("event_type").isin("view", "click"), "acquire").otherwise("release")
    e = t.events.select(F.col("user_id").cast("string").alias("lock_name"), action.alias("action"), F.lit("h").alias("holder"), F.col("ts").cast("timestamp").alias("event_time"), F.col("event_id").alias("id"), F.lit(21600).alias("ttl_seconds"))
    return flows.lock_states(e, F.lit("2024-01-29 12:00:00").cast("timestamp")).select("lock_name", "state")
