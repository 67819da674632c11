"""The constraint catalog on hand-made rows, nulls and hot keys."""

import pytest

from quillmesh.operators import constraints as K
from quillmesh.operators import schemas

RULES = K.Rules(
    types={"a": "int", "b": "string", "c": "double", "d": "bigint"}, required=("a", "z"), defaults={"b": "x", "c": 1.5}, generated={"d": "a * 2", "e": "d + 1"},
    checks={"positive": "a > 0", "even": "e % 4 = 1"}, keys=(("a", "b"),), references=(K.Reference(("a", "b"), "parent", ("p", "q")),),
)
ROWS = [("1", "u", "2.5"), ("1", "u", "no"), ("x", "u", None), (None, None, None), ("-2", None, "1"), ("-2", None, "1")]


@pytest.fixture
def rows(spark):
    return spark.createDataFrame(ROWS, "a string, b string, c string").repartition(3)


def test_conform(rows):
    got = K.conform(rows, RULES)
    assert got.dtypes == [("a", "int"), ("b", "string"), ("c", "double"), ("d", "bigint"), ("e", "bigint")]
    want = [(1, "u", 2.5, 2, 3), (1, "u", None, 2, 3), (None, "u", 1.5, None, None), (None, "x", 1.5, None, None), (-2, "x", 1.0, -4, -3), (-2, "x", 1.0, -4, -3)]
    assert sorted(map(tuple, got.collect()), key=repr) == sorted(want, key=repr)
    assert K.conform(rows.select("b"), RULES).where("a IS NULL AND c = 1.5").count() == len(ROWS)


def test_row_failures(spark):
    df = spark.createDataFrame([(1, "s", 9), (-1, "t", None), (None, "u", 2)], "a int, b string, z int")
    got = {r.b: r.failed for r in K.row_failures(df, RULES).collect()}
    assert got == {"s": ["check even"], "t": ["required z", "check positive", "check even"], "u": ["required a"]}
    assert [r.failed for r in K.row_failures(df, K.Rules()).collect()] == [[]] * 3


def test_report(spark):
    df = spark.createDataFrame([(1, "u", 1)] * 1000 + [(1, "v", 1), (2, None, 1), (2, None, 1), (None, "w", 1)], "a int, b string, z int").repartition(4)
    parent = spark.createDataFrame([(1, "v"), (None, "w"), (2, None)], "p int, q string")
    got = {r.rule: r.violations for r in K.report({"t": df, "parent": parent}, {"t": RULES}).collect()}
    assert got == {"type a": 0, "type b": 0, "required a": 1, "required z": 0, "check positive": 0, "check even": 1001, "key a, b": 1000, "reference a, b -> parent": 1000}
    empty = {r.rule: r.violations for r in K.report({"t": df.limit(0), "parent": parent}, {"t": RULES}).collect()}
    assert set(empty) == set(got) and not any(empty.values())


def test_report_plan(spark, rows):
    """One scan for all row rules, one exchange of groups for a key."""
    df = rows.selectExpr("try_cast(a AS int) AS a", "b", "1 AS z")
    plan = K.duplicate_keys(df, ("a", "b"))._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1 and "partial_count" in plan


def test_store_tables(spark):
    for name in schemas.TABLES:
        rules = K.store_rules(name)
        assert K.conform(spark.range(2).selectExpr("CAST(NULL AS string) AS id"), rules).dtypes == list(rules.types.items())
