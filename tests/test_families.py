"""One-pass family reduction against the reducers of one family each."""

import json
import random

import pytest
from pyspark.sql import functions as F

from quillmesh.operators import families, records, reducers

#: Fields of a raw finding by family, as the scanners give them.
FIELDS = {
    "quality": ("quality.file", lambda r: {"loc": r.randint(0, 90), "complexity": r.randint(0, 9), "file": f"f{r.randint(0, 9)}"}),
    "quality_metric": ("quality.metric", lambda r: {"loc": r.randint(0, 50), "n_functions": r.randint(0, 3), "cyclomatic": r.randint(0, 5)}),
    "env": ("env.usage", lambda r: {"key": r.choice(["A", "B", "C", ""]), "file": f"f{r.randint(0, 5)}"}),
    "deps": ("deps.entry", lambda r: {"package": f"p{r.randint(0, 70)}"}),
    "ast_imports": ("ast.import", lambda r: {"module": r.choice(["os", "sys", "re", None])}),
    "ast_calls": ("ast.call", lambda r: {"callee": r.choice(["f", "g", "h"])}),
    "docs": ("docs.file", lambda r: {"doc_coverage": r.choice([0, 50, 100])}),
    "ast_docstring": ("ast.docstring", lambda r: {"owner_kind": r.choice(["Class", "async-def"]), "owner": f"o{r.randint(0, 9)}", "file": f"f{r.randint(0, 4)}"}),
    "static": ("static.issue", lambda r: {"severity": r.choice(["low", "high", None]), "check": f"c{r.randint(0, 30)}", "code": f"S{r.randint(0, 30)}"}),
    "entrypoints": ("entrypoints.main", lambda r: {"type": r.choice(["Python", "sh", "other"]), "name": f"e{r.randint(0, 9)}"}),
    "license": ("license.file", lambda r: {"spdx_id": r.choice(["MIT", "ISC", None]), "has_header": r.choice([True, False])}),
    "html": ("html.page", lambda r: {"links": r.randint(0, 9), "words": r.randint(0, 9), "title": "x"}),
}


def rows():
    rng = random.Random(5)
    return [(family, kind, make(rng)) for family, (kind, make) in FIELDS.items() for _ in range(200)]


def envelopes(spark, found):
    data = [(kind, item.get("file"), json.dumps({k: v for k, v in item.items() if k != "file"}), item.get("severity"), item.get("code")) for _, kind, item in found]
    raw = spark.createDataFrame(data, "kind string, path string, data string, severity string, code string")
    null = lambda t: F.lit(None).cast(t)
    return raw.select("kind", "path", "data", "severity", "code", null("string").alias("message"), null("struct<line:int,col:int,end_line:int,end_col:int>").alias("loc"),
                      null("struct<name:string,qualname:string,kind:string>").alias("symbol"), null("struct<type:string,from_path:string,to_name:string,external:boolean>").alias("edge"),
                      F.lit("2024-01-01T00:00:00Z").alias("detected_at"))


@pytest.mark.parametrize("n", [None, 3])
def test_equal_to_the_single_reducers(spark, n):
    found = rows()
    got = families.reduce_records(envelopes(spark, found), n=n).select("family", "metric", "name", "value").collect()
    for family in FIELDS:
        items = [i for f, _, i in found if f == family]
        if family in ("html", "docs"):
            continue
        keys = sorted({k for i in items for k in i})
        kind = {k: type(next(i[k] for i in items if i[k] is not None)) for k in keys}
        schema = ", ".join(f"{k} {({int: 'long', str: 'string', bool: 'boolean'})[kind[k]]}" for k in keys)
        frame = spark.createDataFrame([tuple(i[k] for k in keys) for i in items], schema)
        want = reducers.reducer_for(family)(frame, n).select("metric", "name", "value").collect()
        assert sorted(map(tuple, want)) == sorted((r.metric, r.name, r.value) for r in got if r.family == family), family
    html = [i for f, _, i in found if f == "html"]
    assert {(r.name, r.value) for r in got if r.family == "html"} == {("links", sum(i["links"] for i in html)), ("words", sum(i["words"] for i in html)), ("records", 200)}
    assert [(r.metric, r.name, r.value) for r in got if r.family == "docs"] == [("metrics_sum", "coverage", sum(i["doc_coverage"] for f, _, i in found if f == "docs"))]


def test_shapes(spark):
    raw = spark.createDataFrame(
        [
            ("ast.symbol", "a.py", '{"symbol": {"kind": "class", "name": "C"}, "line": 3}'),
            ("edge.import", "a.py", '{"edge": {"to": {"name": "os.path"}}, "to": "os", "module": 5}'),
            ("ast.call", "a.py", '{"callee": "run", "name": "kept"}'),
            ("sql.file", "q.sql", '{"statement": {"kind": "SELECT"}}'),
            ("git.info", None, '{"branch": "main", "ahead": 2}'),
            ("x.y", None, "no json"),
        ],
        "record_type string, file string, data string",
    )
    wrapped = envelopes(spark, [("", k, {}) for k in ()]).unionByName(
        envelopes(spark, [("", r.record_type, {"file": r.file}) for r in raw.collect()]).drop("data").join(raw.select(F.col("record_type").alias("kind"), "data"), "kind")
    )
    shaped = families.shape_family_items(wrapped)
    got = {r.family: json.loads(r.item) for r in shaped.select("family", F.to_json("item").alias("item")).collect()}
    assert got["ast_symbols"] == {"symbol": {"kind": "class", "name": "C"}, "line": 3, "file": "a.py", "kind": "class", "name": "C"}
    assert got["ast_imports"] == {"edge": {"to": {"name": "os.path"}}, "to": "os", "module": 5, "edges": [{"to": "os"}], "file": "a.py", "kind": "edge.import"}
    assert got["ast_calls"]["name"] == "kept" and got["sql"]["statements"] == [{"kind": "SELECT"}] and got["x"] == {"kind": "x.y"}
    late = wrapped.where("kind = 'git.info'").withColumn("data", F.lit('{"branch": "next"}')).withColumn("detected_at", F.lit("2024-02-01T00:00:00Z"))
    out = families.reduce_records(wrapped.unionByName(late)).where("family = 'git'").collect()
    assert {(r.metric, r.name, r.text) for r in out} == {("info", "branch", "next"), ("info", "ahead", "2")}
    assert families.reduce_records(wrapped.limit(0)).count() == 0


def test_one_scan(spark, tmp_path):
    envelopes(spark, rows()).write.parquet(str(tmp_path / "records"))
    out = families.reduce_records(spark.read.parquet(str(tmp_path / "records")))
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert plan.count("FileScan") == 1 and plan.count("Inline") <= 2 and "WindowGroupLimit" in plan and "Union" not in plan
    assert records.SCHEMA
