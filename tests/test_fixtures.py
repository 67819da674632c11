"""Hand-computed answers on small source files."""

import struct

from pyspark.sql import functions as F

from quillmesh.functions import paths as P
from quillmesh.functions import text as X
from quillmesh.operators import assets, deps, edits, entrypoints, env, html, items, jsfiles, lines, ordered, owners, pysource, records, shellfiles, sqlfiles
from quillmesh.operators import store


def files(spark, **by_path):
    rows = [(p.replace("__", "/").replace("_DOT_", "."), t) for p, t in by_path.items()]
    return spark.createDataFrame(rows, "path string, text string")


def one(spark, path, text):
    return spark.createDataFrame([(path, text)], "path string, text string")


def test_lines_follow_python(spark):
    text = "a\r\nb\rc\x0bd\x1ce\x85f g\n"
    got = [r["line"] for r in lines.to_lines(one(spark, "x", text)).orderBy("line_no").collect()]
    assert got == text.splitlines()
    assert lines.to_lines(one(spark, "x", "")).count() == 0


def test_globs_follow_fnmatch(spark):
    import fnmatch

    paths = ["a/b.txt", "b.txt", "src/x/__pycache__/m.pyc", "[x]", "a.b+c", "é.md"]
    globs = ["*.txt", "**/*.txt", "a/?.txt", "[ab].txt", "[!a].txt", "**/__pycache__/**", "a.b+c", "?.md"]
    df = spark.createDataFrame([(p,) for p in paths], "p string")
    for g in globs:
        got = [r[0] for r in df.where(P.matches_any("p", [g])).collect()]
        assert sorted(got) == sorted(p for p in paths if fnmatch.fnmatchcase(p, g)), g


def test_sql_statements_and_facts(spark):
    text = (
        "-- c ; x\nSELECT 'a;b', 'it''s', \"q;\" FROM `t;1` # tail ; \n; /* ; */ DELETE FROM x;\n"
        "CREATE TEMP TABLE s.t2 (id INT, FOREIGN KEY (id) REFERENCES x(id));\nUPDATE y SET a = :p, b = @q, c = $1, d = ? , e = z::int WHERE 1=1; DROP TABLE IF EXISTS [old]"
    )
    st = sqlfiles.sql_statements(one(spark, "a.sql", text))
    rows = [r["stmt"] for r in st.orderBy("i").collect()]
    assert len(rows) == 5 and rows[0].startswith("SELECT 'a;b', 'it''s'") and rows[1] == "DELETE FROM x"
    f = sqlfiles.sql_facts(sqlfiles.sql_statement_facts(st)).first()
    assert f["referenced"] == ["t;1", "x", "y"]
    assert f["created"] == [] and f["dropped"] == ["old"]
    assert f["named"] == [":p", "@q"] and f["positional"] == ["$1"] and f["qmark"] == 1
    assert f["delete_no_where"] == 1 and f["drop_table"] == 1 and f["foreign_keys"] == 1
    fixed = sqlfiles.sql_facts(sqlfiles.sql_statement_facts(st, fixed=True)).first()
    assert fixed["created"] == ["s.t2"]


def test_js_facts(spark):
    text = "import a from 'pkg';\nconst s = 'http://x'; // c\n/* b\n\nb */ const t = `//${1}`;\nexport { A as B, C };\nconst m = await import('./dyn');\nexport default class K {\n}\n"
    f = jsfiles.js_facts(one(spark, "a.jsx", text)).first()
    assert (f["lines_total"], f["lines_code"], f["lines_blank"]) == (9, 7, 1)
    assert f["imports_static"] == ["pkg"] and f["imports_dynamic"] == ["./dyn"] and f["packages"] == ["pkg"]
    assert f["export_named"] == ["B", "C"] and f["export_default"] and f["hints"] == ["jsx"]


def test_shell_enclosing(spark):
    text = "#!/bin/sh\nrun a\nf() {\n  grep x | sort\n}\nfunction g {\n  f\n}\n"
    sf = one(spark, "a.sh", text)
    edges = {(r["line_no"], r["src"], r["dst"], r["kind"]) for r in shellfiles.shell_edges(shellfiles.shell_lines(sf)).collect()}
    assert (2, "a.sh", "run", "calls-external") in edges and (4, "f", "sort", "calls-external") in edges and (7, "g", "f", "calls-function") in edges


PY = '''"""Mod."""
import os as o
from os import environ as env, getenv
import a.b
class C:
    """Doc."""
    def m(self, x=[], *, y={}):
        """D."""
        def inner():
            if x: pass
        return self.n(x) if x and y and self else eval("1")
    async def n(self):
        with open("f") as f:
            for i in f:
                assert i
        o.getenv("A"); env["B"]; env.get("C"); getenv("D"); o.environ.get("E")
try:
    print(C())
except ValueError:
    pass
except:
    global z
'''


def test_python_facts(spark):
    fs = spark.createDataFrame([("pkg/__init__.py", PY), ("bad.py", "def ("), ("empty.py", "")], "path string, text string")
    facts = pysource.py_facts(fs).cache()
    fn = {r["qualname"]: r["complexity"] for r in pysource.functions_of(facts).collect()}
    assert fn == {"C.m": 4, "C.m.inner": 2, "C.n": 3}
    checks = sorted(r["code"] for r in pysource.ast_checks(facts).collect())
    assert checks == ["ST001", "ST003", "ST004", "ST005", "ST006"]
    e = env.env_usage_py(facts).first()
    assert e["vars"] == ["A", "B", "C", "D", "E"] and (e["getenv"], e["environ_index"], e["environ_get"]) == (2, 1, 2)
    cov = pysource.doc_coverage(facts).where("path like 'pkg%'").first()
    assert (cov["classes_doc"], cov["methods_total"], cov["methods_doc"], cov["module_doc"], cov["documentables"]) == (1, 2, 1, True, 4)
    calls = {(r["target"], r["confidence"]) for r in pysource.resolve_calls(facts).collect()}
    assert ("pkg:C.n", "high") in calls and ("os.getenv", "medium") in calls and ("pkg:C", "medium") in calls and ("open", "low") in calls
    assert facts.where("fact = 'error'").select("path").first()[0] == "bad.py"
    near = pysource.nearest_symbol(spark.createDataFrame([("pkg/__init__.py", 6, None), ("pkg/__init__.py", 6, "inner")], "path string, target_line int, symbol_name string"), facts)
    got = {(r["symbol_name"], r["name"]) for r in near.collect()}
    assert got == {(None, "m"), ("inner", "inner")}
    facts.unpersist()


def test_line_checks(spark):
    text = "x" * 121 + "\n\ty \nok # todo: z\n"
    got = {(r["line_no"], r["code"], r["col"]) for r in pysource.line_checks(one(spark, "a.py", text)).collect()}
    assert got == {(1, "ST100", 121), (2, "ST101", 3), (2, "ST102", 1), (3, "ST200", 6)}


def test_env_files_and_placeholders(spark):
    df = spark.createDataFrame(
        [("x/.env.example", "export A=1 # c\n#B=2\nC='#'\n D = 3\n"), ("c.json", '{"${KEY}": "v ${V1:-x} $V2", "n": [1, "$V3"]}'), ("bad.json", "{$RAW"), ("c.toml", 'a = "${T1}"\n# $NOT\n')],
        "path string, text string",
    )
    v = env.env_file_vars(df).first()
    assert v["vars"] == ["A", "C", "D"] and v["is_template"]
    req = {r["path"]: r["vars"] for r in env.env_required(df.where("path like '%.json'")).collect()}
    assert req == {"c.json": ["V1", "V2", "V3"], "bad.json": ["RAW"]}
    assert env.env_required(df.where("path like '%.toml'")).first()["vars"] == ["T1"]


def test_owners(spark):
    text = "# c\n*.py @a @b # x\ndocs/ @d\n!no @x\nalone\n/src/*.py @e\n"
    rules = owners.collect_rules(owners.owner_rules(lines.to_lines(one(spark, "OWNERS", text))))
    assert [(r.pattern, r.owners) for r in rules] == [("*.py", ("@a", "@b")), ("docs/", ("@d",)), ("/src/*.py", ("@e",))]
    df = spark.createDataFrame([(p,) for p in ("x/a.py", "docs/b.py", "src/c.py", "x/docs/d.md")], "path string")
    want = {"x/a.py": 1, "docs/b.py": 2, "src/c.py": 3, "x/docs/d.md": None}
    assert {r["path"]: r["rule_index"] for r in owners.assign_owners(df, rules).collect()} == want
    many = rules + [owners.OwnerRule(i, f"none{i}/", ("@n",)) for i in range(4, 300)]
    assert {r["path"]: r["i"] for r in df.select("path", owners.rule_index("path", many).alias("i")).collect()} == want


def test_html_counts_equal_parser(spark):
    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet").select(F.col("url").alias("path"), F.col("html").alias("text"))
    odd = spark.createDataFrame([("o", "<!-- <h1> --><A HREF=//x>1</A><script src='react.js'></script><img/><link rel=stylesheet href=a><style>h1 <h1></style><a>n</a>")], "path string, text string")
    both = pages.union(odd)
    facts = html.html_facts(both).select("path", *[F.col("counts")[c].alias(c) for c in html.COUNTERS])
    counts = html.html_counts(both).select("path", *html.COUNTERS)
    assert facts.exceptAll(counts).count() == 0 and counts.exceptAll(facts).count() == 0


def test_assets(spark):
    png = b"\x89PNG\r\n\x1a\n\x00\x00\x00\rIHDR" + struct.pack(">II", 640, 480)
    gif = b"GIF89a" + struct.pack("<HH", 3, 4) + b"\x00"
    bmp = b"BM" + b"\x00" * 16 + struct.pack("<ii", 5, -6)
    jpg = b"\xff\xd8\xff\xe0\x00\x04ab\xff\xc0\x00\x11\x08" + struct.pack(">HH", 20, 10) + b"\x00" * 8
    df = spark.createDataFrame([("a.png", bytearray(png)), ("b.gif", bytearray(gif)), ("c.bmp", bytearray(bmp)), ("d.jpg", bytearray(jpg)), ("e.svg", bytearray(b'<svg width="7" height="8">')), ("g.svg", bytearray(b'<svg viewBox="0 0 30 40">')), ("h.webp", bytearray(b"RIFF0000WEBPVP8X")), ("i.webp", None), ("f.py", bytearray(b"x"))], "path string, content binary")
    got = {r["path"]: r["image"] for r in assets.asset_facts(df).collect()}
    assert "f.py" not in got and tuple(got["a.png"]) == (640, 480, "png") and tuple(got["b.gif"]) == (3, 4, "gif") and tuple(got["c.bmp"]) == (5, 6, "bmp")
    other = {k: (v["width"], v["height"]) for k, v in got.items() if v and v["format"] in ("jpeg", "svg", "webp")}
    assert other == {"d.jpg": (10, 20), "e.svg": (7, 8), "g.svg": (30, 40), "h.webp": (None, None)} and got["i.webp"] is None
    assert assets.jpeg_sides(b"\xff\xd8\xff\xff\xff\xd9\xff\xe0\x00\x00") == assets.jpeg_sides(b"\xff\xd8") == (None, None)


def test_deps(spark):
    df = spark.createDataFrame(
        [("p/poetry.lock", '[[package]]\nname = "A"\nversion = "1"\n'), ("s/setup.cfg", "[options]\ninstall_requires =\n  a>=2\n  b[x]==3\n"), ("requirements.txt", "a==9\n-e git+x#egg=e\n--index-url z\n"), ("requirements-dev.txt", "no==1")],
        "path string, text string",
    )
    r = {(x["package"], x["version"]) for x in deps.deps_requirements(df).collect()}
    assert r == {("a", "9"), ("e", None)}
    t = {(x["source"], x["package"], x["version"]) for x in deps.deps_toml(df).collect()}
    assert t == {("poetry_lock", "A", "1"), ("setup_cfg", "a", "2"), ("setup_cfg", "b", "3")}


def test_config_entrypoints(spark):
    df = spark.createDataFrame([("setup.cfg", "[options.entry_points]\nconsole_scripts =\n  x = m:f\n"), ("package.json", '{"name": "n", "bin": "./b.js"}')], "path string, text string")
    got = {(r["source"], r["name"], r["target"]) for r in entrypoints.config_entrypoints(df).collect()}
    assert got == {("setup.cfg[console_scripts]", "x", "m:f"), ("package.json.bin", "n", "./b.js")}


def apply(spark, text, *ops):
    e = spark.createDataFrame([("f", i, *o) for i, o in enumerate(ops)], "path string, seq int, op string, start_line int, end_line int, anchor string, new_text string")
    return edits.apply_line_edits(one(spark, "f", text), e).first()["text"]


def test_line_edits(spark):
    base = "#!/bin/sh\n# coding: utf-8\nimport a\n\nfrom b import c\nx = 1\n"
    assert apply(spark, base, ("insert", None, None, "after_import_block", "y")) == base.replace("x = 1", "y\nx = 1")
    assert apply(spark, base, ("insert", None, None, "after_shebang_and_encoding", "y\n")) == base.replace("import a", "y\nimport a")
    assert apply(spark, "a\r\nb\r\n", ("replace", 2, 2, None, "c\nd")) == "a\r\nc\r\nd\r\n"
    assert apply(spark, "1\n2\n3\n", ("delete", 1, 1, None, None), ("replace", 1, 1, None, "two")) == "two\n3\n"
    assert apply(spark, "1\n2", ("insert", None, None, "file_end", "3")) == "1\n2\n3\n"
    assert apply(spark, "1\n2\n", ("insert", 1, None, "after_line", "a"), ("insert", 1, None, "before_line", "b")) == "b\n1\na\n2\n"


def test_patches(spark):
    ok = "--- a/f\n+++ b/f\n@@ -1,2 +1,2 @@\n one\n-two\n+zwei\n@@ -4,1 +4,2 @@\n four\n+five\n"
    bad = ok.replace("-two", "-tow")
    gone = "--- a/missing\n+++ /dev/null\n@@ -1 +0,0 @@\n-x\n"
    new = "--- /dev/null\n+++ b/g\n@@ -0,0 +1,1 @@\n+hi\n"
    back = "--- a/f\n+++ b/f\n@@ -3,1 +3,1 @@\n three\n@@ -1,1 +1,1 @@\n one\n"
    df = spark.createDataFrame([("ok", ok), ("bad", bad), ("gone", gone), ("new", new), ("back", back), ("broken", "--- a/f\nnope\n")], "patch_id string, text string")
    tree = one(spark, "f", "one\ntwo\nthree\nfour\n")
    h = edits.parse_hunks(df)
    got = {r["patch_id"]: r["ok"] for r in edits.validate_hunks(h, tree).collect()}
    assert got == {"ok": True, "bad": False, "gone": False, "new": True, "back": False, "broken": False}
    assert h.where("patch_id = 'gone' and pos = 1").select("old_count").first()[0] == 0
    assert {(r["patch_id"], r["path"]) for r in edits.patch_paths(df.where("patch_id = 'gone'")).collect()} == {("gone", "missing")}


def test_wrap_records(spark):
    raw = spark.createDataFrame(
        [("ast.xref", "import_from", "a\\b.py", "7", None, "os", None, 1), (None, "entrypoints.python", None, "x", "n", None, None, 2), ("manifest_header", None, None, None, None, None, None, 3), ("zzz", None, "p", None, None, None, None, 4)],
        "record_type string, kind string, file string, lineno string, note string, module string, severity string, extra int",
    )
    rows = {r["kind"]: r for r in records.wrap_records(raw, "t", F.lit("now")).collect()}
    assert set(rows) == {"edge.import", "entrypoint.python", "unknown.zzz"}
    e = rows["edge.import"]
    assert e["path"] == "a/b.py" and e["loc"]["line"] == 7 and e["edge"]["type"] == "import_from" and e["edge"]["to_name"] == "os" and e["data"] == '{"extra":1}'
    assert rows["entrypoint.python"]["message"] == "n" and rows["unknown.zzz"]["status"]["reason"] == "record_type_unmapped"
    good, bad = records.validate_records(records.wrap_records(raw, "t", F.lit("now")))
    assert good.count() == 3 and bad.count() == 0


def test_responses_odd_shapes(spark):
    df = spark.createDataFrame([("1", 'text [{"a": 1}, 2] more'), ("2", "{broken"), ("3", "5"), ("4", '{"x": 1}'), ("5", "")], "id string, raw string")
    got = [(r["id"], r["item"]) for r in items.parse_responses(df).collect()]
    assert len(got) == 1 and got[0][0] == "1"


def test_upsert_by_hash_and_null_names(spark):
    from quillmesh.plans.store import EMPTY

    schema = "filepath string, symbol_type string, name string, lineno bigint, unique_key_hash string, description string, status string, seen_at timestamp, seq bigint"
    import datetime as d

    t = d.datetime(2024, 1, 1)
    up = spark.createDataFrame(
        [("a", "f", "n", 1, "h1", "short", "", t, 1), ("a", "f", "n", 1, "h1", "Bad docstring", "todo", t, 2), ("a", "f", "n", 2, "h1", "longer text", None, t, 3),
         ("m", "module", None, 1, None, "x", "", t, 4), ("m", "module", None, 1, None, "x", "", t, 5)], schema)
    out = store.upsert_index(spark.createDataFrame([], EMPTY), up).orderBy("filepath").collect()
    assert [(r["filepath"], r["occurrences"]) for r in out] == [("a", 3), ("m", 1), ("m", 1)]
    assert out[0]["description"] == "longer text" and out[0]["status"] == "active"
    again = store.upsert_index(store.upsert_index(spark.createDataFrame([], EMPTY), up), up.where("seq = 1"))
    assert again.where("name = 'n'").first()["occurrences"] == 4


def test_text_helpers(spark):
    df = spark.createDataFrame([('"""a\nb"""', "```json\n{}\n```", "a\n\n\n\n\nb  \n", "One two. Three")], "q string, f string, b string, s string")
    s, b = X.split_summary_body("s")
    r = df.select(X.strip_triple_quotes("q"), X.strip_fences("f"), X.collapse_blank_lines("b"), s, b).first()
    assert tuple(r) == ("a\nb", "{}", "a\n\n\nb", "One two.", "Three")


def test_dup_flag_ties(spark):
    text = "the same words again and again, more than fifty characters of them"
    df = spark.createDataFrame([(1, 5, text), (2, 5, f" {text}\n"), (3, 4, "short"), (4, 9, text + "!")], "id long, o int, text string")
    got = {r["id"]: r["verdict"][:4] for r in ordered.dup_flag(df, "text", "o", "id").collect()}
    assert got == {1: "keep", 2: "Dupl", 3: "Bad ", 4: "keep"}


def test_phases_repeat_and_nest(spark):
    rows = [("r", "p", "begin", 0), ("r", "p", "end", 5), ("r", "p", "begin", 100), ("r", "p", "end", 103), ("r", "q", "end", 1), ("r", "q", "begin", 2), ("r", "q", "begin", 4000), ("r", "q", "end", 4001), ("r", "q", "end", 9000), ("r", "o", "begin", 3)]
    df = spark.createDataFrame([(*x, i, "error" if i == 8 else "ok") for i, x in enumerate(rows)], "run_id string, phase string, event string, s int, seq int, status string")
    df = df.withColumn("ts", F.timestamp_seconds(F.col("s") + 1_700_000_000))
    got = sorted((r["phase"], r["dur_ms"], r["status"]) for r in ordered.phase_durations(df).collect() if r["dur_ms"])
    assert got == [("p", 3000, "ok"), ("p", 5000, "ok"), ("q", 1000, "ok"), ("q", 8998000, "error")]
    assert [r["phase"] for r in ordered.phase_durations(df).where("status = 'open'").collect()] == ["o"]


def test_deep_sources(spark):
    df = files(spark, sum_DOT_py="x = " + " + ".join(["a"] * 1500), chain_DOT_py="y = b" + ".f()" * 600, ok_DOT_py="print(1)")
    got = {r["path"]: r["n"] for r in pysource.py_facts(df).where("fact IN ('call', 'error')").groupBy("path").agg(F.count("*").alias("n")).collect()}
    assert got["ok.py"] == 1 and got.get("chain.py", 0) >= 1
    assert {r["path"] for r in pysource.py_facts(df).where("fact IN ('module', 'error')").collect()} == {"sum.py", "chain.py", "ok.py"}


def test_html_facts_of_one_page(spark):
    page = (
        "<!DOCTYPE html><html lang=' de '><head><title>\n A &amp; B </title><meta name=Description content='d1'><meta name=description content=d2>"
        "<meta property='keywords' content='k'><meta name=generator content='Next.js 1'><link rel='canonical' href='/c'></head><body><div class='my-App'></div><script src=vue.js></script></body>"
    )
    r = html.html_facts(spark.createDataFrame([("a", page), ("b", None), ("c", "<html><META CHARSET=x>")], "path string, text string")).collect()
    a, b, c = sorted(r, key=lambda x: x["path"])
    assert (a["title"], a["lang"], a["doctype_html5"], a["description"], a["keywords"], a["viewport"], a["robots"], a["canonical"]) == ("A & B", "de", True, "d1", "k", None, None, "/c")
    assert a["hints"] == ["vue", "nextjs", "spa_mount"] and a["counts"]["scripts_external"] == 1
    assert (b["title"], b["doctype_html5"], b["hints"]) == (None, False, []) and c["doctype_html5"]


def test_pyproject_entries(spark):
    toml = (
        '[project]\ndependencies = ["a>=1", " b[x] == 2 "]\n[project.optional-dependencies]\nt = ["c"]\n[tool.poetry.dependencies]\npython = "^3"\nd = "^4"\ne = {version = "5", extras = ["z"]}\n'
        'f = {git = "u"}\n[tool.poetry.group.dev.dependencies]\ng = "*"\n[tool.poetry.group.doc.dependencies]\nh = {version = "8"}\n'
    )
    got = [(r["package"], r["version"]) for r in deps.deps_toml(one(spark, "x/pyproject.toml", toml)).orderBy("seq").collect()]
    assert got == [("a", "1"), ("b", "2"), ("c", None), ("d", "^4"), ("e", "5"), ("f", None), ("g", "*"), ("h", "8")]
    assert deps.deps_toml(one(spark, "setup.cfg", "[options")).count() == 0


def test_statements_with_control_characters(spark):
    df = files(spark, a_DOT_sql="SELECT '\x01;\x03' ; SELECT \x01\x02\x03 ;; \x01")
    got = [r["stmt"] for r in sqlfiles.sql_statements(df).orderBy("i").collect()]
    assert got == ["SELECT '\x01;\x03'", "SELECT \x01\x02\x03", "\x01"]
