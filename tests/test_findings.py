"""Findings of the line scanners: one search for hints per text, one split per text, and whole lines."""

import random
import re
from types import SimpleNamespace

from pyspark.sql import functions as F

from quillmesh.functions import text as X
from quillmesh.plans import records


def test_hints_are_sought_once_per_text(spark):
    files = spark.createDataFrame([("a", "MIT License\nx \n\ty"), ("b", None), ("c", ""), ("d", "\n"), (None, "TODO"), ("a", "MIT License\nx \n\ty")], "path string, text string")
    found = records.raw_findings(SimpleNamespace(files=files))
    rows = sorted((r["path"] or "", r["kind"], r["line"] or 0, r["code"]) for r in found.collect())
    assert rows == [("", "static.issue", 1, "ST200")] + [("a", "license.hint", 0, "MIT")] * 2 + [("a", "static.issue", 2, "ST101")] * 2 + [("a", "static.issue", 3, "ST102")] * 2
    plan = found._jdf.queryExecution().optimizedPlan().toString()
    assert plan.index("posexplode(") < plan.index("Apache")  # the search stands below the cutting of lines


def test_lines_of_splits_once(spark):
    rng = random.Random(3)
    texts = [None, "", "\n", "\r", "\r\n", "\n\n", "a", "a\n", "a\n\nb\n\n", "a\r", "a\x85", "a b", *("".join(rng.choices("ab \n\r\x0b\x1c\x85 é", k=rng.randint(1, 12))) for _ in range(200))]
    df = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, text string")
    for row in df.select("text", X.lines_of("text").alias("lines")).collect():
        parts = re.split("\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85  ]", row["text"]) if row["text"] is not None else None
        assert row["lines"] == (parts[:-1] if parts and parts[-1] == "" else parts)
    plan = df.select(F.posexplode_outer(X.lines_of("text")))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("split(text") == 2  # one for each of the two ways
