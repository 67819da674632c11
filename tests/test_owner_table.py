"""Rules met through their keys against every rule tried on every path."""

import random

from pyspark.sql import functions as F

from quillmesh.operators import lines, owners


def test_equal_to_trying_all_rules(spark):
    rng = random.Random(6)
    names = ["a", "b", "src", "docs", "x.py", "y.md", "z", "no.ext.txt", "[k]"]
    globs = [*names, "*", "*.py", "?.md", "[ab]", "[!a]*", "*x*", "s*c", "*.t?t", "**", "a*", "*]", "[", "*.e[x"]
    path = lambda parts: "/".join(rng.choice(parts) for _ in range(rng.randint(1, 4)))
    patterns = [rng.choice(["", "/", "//"]) + path(globs) + rng.choice(["", "", "/", "//"]) for _ in range(600)] + ["/", "*", ""]
    rules = [owners.OwnerRule(i, p, (f"@{i}",)) for i, p in enumerate(patterns, 1)]
    files = sorted({rng.choice(["", "", "/"]) + path(names) for _ in range(300)} | {"a//b", "weird//", ""})
    for few in (rules, rules[:40], rules[40:45], []):
        table = spark.createDataFrame([(r.index, r.pattern, list(r.owners)) for r in few], "rule_index int, pattern string, owners array<string>")
        frame = spark.createDataFrame([(f,) for f in [*files, files[0]]], "path string")
        got = owners.assign_owners_by_table(frame, table)
        want = {}
        for start in range(0, len(few), 50):  # a few rules at a time keep the plain plan small
            part = few[start : start + 50]
            found = frame.distinct().select("path", owners.rule_index("path", part).alias("i")).where("i is not null").collect()
            want.update({r.path: r.i for r in found})
        assert sorted((r.path, r.rule_index) for r in got.select("path", F.coalesce("rule_index", F.lit(0)).alias("rule_index")).collect()) == sorted((f, want.get(f, 0)) for f in [*files, files[0]])


def test_rules_of_a_file_are_numbered_without_a_collect(spark):
    text = "*.py @a @b\n# none\ndocs/ @d\n!x @no\n/src/*.py @e\n"
    rules = owners.number_rules(owners.owner_rules(lines.to_lines(spark.createDataFrame([("OWNERS", text)], "path string, text string"))))
    assert [(r.rule_index, r.pattern, r.owners) for r in rules.orderBy("rule_index").collect()] == [(1, "*.py", ["@a", "@b"]), (2, "docs/", ["@d"]), (3, "/src/*.py", ["@e"])]


def test_a_path_meets_few_of_many_rules(spark):
    """Rules that share folders, endings or patterns by the thousand: the pairs met grow with the paths."""
    n = 3000
    forms = ["/src/", "*{}.txt", "/src/{}.txt", "{}.txt", "src/*{}.txt", "{}*.txt", "/src/{}*"]
    table = spark.createDataFrame([(i, forms[i % len(forms)].format(i), ["@a"]) for i in range(1, n + 1)], "rule_index int, pattern string, owners array<string>")
    paths = spark.range(1, n + 1).select(F.format_string("src/%d.txt", "id").alias("p"))
    indexed = owners.indexed_rules(table)
    keyed = paths.crossJoin(owners.key_shapes(indexed)).select("p", F.inline(owners.path_keys(F.col("p"), F.col("shapes"))))
    assert keyed.join(indexed, ["place", "head", "tail"]).count() < 40 * n
