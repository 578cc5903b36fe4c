"""The WHERE language against a plain evaluator, its errors, and what reaches the scan."""

from __future__ import annotations

import datetime as dt
import itertools

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import types as T

from cairnfield.errors import EngineError, WhereError
from cairnfield.plans.query import Query, build, checked
from cairnfield.plans.where import BoundWhere, evaluate, fields_of, parse

SCHEMA = T.StructType(
    [
        T.StructField("i", T.IntegerType()),
        T.StructField("big", T.LongType()),
        T.StructField("d", T.DoubleType()),
        T.StructField("f", T.FloatType()),
        T.StructField("s", T.StringType()),
        T.StructField("raw", T.BinaryType()),
    ]
)
KINDS = {"i": "numeric", "big": "numeric", "d": "numeric", "f": "numeric", "s": "string", "raw": "other"}
VALUES = {
    "i": [None, -3, 0, 5, 2**31 - 1],
    "big": [None, 2**53, 2**53 + 1, -(2**62), 5],
    "d": [None, float("nan"), float("inf"), -0.0, 5.0, 5.5],
    "f": [None, float("nan"), 0.5, 5.0],
    "s": [None, "", "it's", "Z", "a", "5", "成都", "\U0001f600"],
    "raw": [None, b"", b"5"],
}
LITERALS = ["5", "0", "-3", "5.5", "-0.5", "9007199254740992", "1e300", "4000000000", "'a'", "'5'", "''", "'it''s'"]


@pytest.fixture(scope="module")
def rows(spark):
    longest = max(map(len, VALUES.values()))
    data = [tuple(VALUES[c][k % len(VALUES[c])] for c in SCHEMA.names) for k in range(longest)]
    return data, spark.createDataFrame([(n, *r) for n, r in enumerate(data)], T.StructType([T.StructField("n", T.IntegerType()), *SCHEMA.fields])).cache()


def expected(data, text):
    node = parse(text)
    return [n for n, r in enumerate(data) if evaluate(node, dict(zip(SCHEMA.names, r, strict=True)), KINDS)]


def test_every_leaf(rows):
    data, df = rows
    clauses = [f"{c} {op} {lit}" for c, op, lit in itertools.product(SCHEMA.names, ("=", "!=", "<", "<=", ">", ">="), LITERALS)]
    clauses += [f"{c} IN ({a}, {b})" for c in SCHEMA.names for a, b in (("5", "'5'"), ("-3", "'a'"))]
    columns = [BoundWhere(c, SCHEMA).column().alias(f"c{k}") for k, c in enumerate(clauses)]
    found = {c: [] for c in clauses}
    for at in range(0, len(columns), 60):
        for r in df.select("n", *columns[at : at + 60]).collect():
            for k, c in enumerate(clauses[at : at + 60], at):
                if r[f"c{k}"]:
                    found[c].append(r["n"])
    for c in clauses:
        assert sorted(found[c]) == expected(data, c), c


leaf = st.builds(lambda c, op, v: f"{c} {op} {v}", st.sampled_from(SCHEMA.names), st.sampled_from(["=", "!=", "<", ">="]), st.sampled_from(LITERALS))
clause = st.recursive(leaf, lambda inner: st.builds(lambda a, op, b, p: f"({a} {op} {b})" if p else f"{a} {op} {b}", inner, st.sampled_from(["AND", "or"]), inner, st.booleans()), max_leaves=6)


@given(clause)
@settings(max_examples=25, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
def test_nesting(rows, text):
    data, df = rows
    assert sorted(r["n"] for r in df.where(BoundWhere(text, SCHEMA).column()).select("n").collect()) == expected(data, text)


def test_null_and_like(rows):
    _, df = rows
    assert df.where(BoundWhere("s IS NULL", SCHEMA).column()).count() == 1
    assert df.where(BoundWhere("s IS NOT NULL AND s LIKE '%t_s'", SCHEMA).column()).count() == 1


def test_precedence():
    node = parse("a = 1 OR b = 2 AND c = 3")
    assert not node.every and node.parts[1].every


@pytest.mark.parametrize("text", ["", "   ", "i = ", "i == 5", "i <> 5", "NOT i = 5", "i BETWEEN 1 AND 2", "5 = i", "i = .5", "i = 1e9999", "(i = 5", "i = 5)", "i = 'a", "i IN ()", "é = 5", "i = 5 AND", "i = j", "i = 5x", 'i = "a"', "i = 1.5.2"])
def test_refused(text):
    with pytest.raises(WhereError):
        BoundWhere(text, SCHEMA)


def test_unknown_field_and_length():
    with pytest.raises(WhereError, match="unknown field"):
        BoundWhere("nothing = 1", SCHEMA)
    with pytest.raises(EngineError):
        parse("i = 1 OR " * 10_000 + "i = 1")


def test_names_and_references():
    bound = BoundWhere("I = 5 AND S = 'a' OR i = 6", SCHEMA)
    assert bound.references == ["i", "s"] and not bound.single_comparison
    assert fields_of(parse("(a = 1)")) == {"a"}


def test_dates(spark):
    day = dt.date(2000, 1, 1)
    df = spark.createDataFrame([(day, dt.datetime(2000, 1, 1, 12))], "d date, t timestamp")
    ole = 36526
    for text, hit in ((f"d = {ole}", True), (f"d > {ole}", False), (f"t = {ole}.5", True), (f"t > {ole}", True), (f"t < {ole}.25", False), (f"d != {ole}.5", True)):
        assert (df.where(BoundWhere(text, df.schema).column()).count() == 1) is hit, text


def test_comparisons_reach_the_scan(spark, tmp_path):
    path = str(tmp_path / "t")
    spark.range(100).selectExpr("cast(id as int) i", "id big", "cast(id as double) d", "cast(id as string) s").write.parquet(path)
    df = spark.read.parquet(path)
    for text, pushed in (("i >= 4.5", "GreaterThanOrEqual(i,5)"), ("big != 7", "Or(IsNull(big),Not(EqualTo(big,7)))"), ("d > 3", "GreaterThan(d,3.0)"), ("s IN ('a','b')", "s")):
        plan = df.where(BoundWhere(text, df.schema).column())._jdf.queryExecution().toString()
        assert pushed in plan[plan.index("PushedFilters") :].split("]")[0] + "]" + plan[plan.index("PushedFilters") :].split("\n")[0], text


def test_paging_and_budget(spark):
    df = spark.range(20).withColumnRenamed("id", "fid").selectExpr("fid", "fid * 2 as v")
    assert [r.fid for r in build(df, Query(where="v >= 10", by_fid=True, offset=2, limit=3)).collect()] == [7, 8, 9]
    assert build(df, Query(by_fid=True, offset=50)).count() == 0
    assert build(df, Query(limit=0)).count() == 20
    assert checked(df, 20).count() == 20
    with pytest.raises(EngineError, match="limit"):
        checked(df, 19)
    for bad in (Query(fields=("nothing",)), Query(offset=-1), Query(box=(0, 0, 1, 1)), Query(fid=-1)):
        with pytest.raises(EngineError):
            build(df, bad)
