import pytest
from hypothesis import given
from hypothesis import strategies as st
from pyspark.sql import functions as F

from docframe import Sort
from docframe.functions.conditions import parse_condition
from docframe.functions.values import coerced, key_of, value_of

#: (condition, value, result)
TRUTH = [
    (Sort.eq("alice"), "alice", True), (Sort.eq("alice"), "bob", False), (Sort.eq("42"), "42", True), (Sort.eq("42"), "43", False), (Sort.eq(42), "42", True), (Sort.eq("1.0"), "1", True),
    (Sort.ne("alice"), "alice", False), (Sort.ne("alice"), "bob", True), (Sort.lt("10"), "5", True), (Sort.lt("10"), "10", False), (Sort.lt("10"), "15", False),
    (Sort.lt("banana"), "apple", True), (Sort.lt("banana"), "banana", False), (Sort.lt("banana"), "cherry", False), (Sort.lte("10"), "5", True), (Sort.lte("10"), "10", True), (Sort.lte("10"), "15", False),
    (Sort.gt("10"), "15", True), (Sort.gt("10"), "10", False), (Sort.gt("10"), "5", False), (Sort.gte("10"), "15", True), (Sort.gte("10"), "10", True), (Sort.gte("10"), "5", False),
    (Sort.between("5", "15"), "10", True), (Sort.between("5", "15"), "5", True), (Sort.between("5", "15"), "15", True), (Sort.between("5", "15"), "3", False), (Sort.between("5", "15"), "20", False),
    (Sort.between("a", "m"), "dog", True), (Sort.between("a", "m"), "zebra", False), (Sort.begins_with("user-"), "user-abc", True), (Sort.begins_with("user-"), "admin-abc", False),
    (Sort.begins_with("user-"), "user-", True), (Sort.begins_with(""), "anything", True), (Sort.contains("error"), "server error", True), (Sort.contains("error"), "all good", False),
    (Sort.contains(""), "anything", True), (Sort.eq(""), "", True), (Sort.gt("abc"), "9", False), (Sort.lt("abc"), "9", True), (Sort.gt("2024-01-01"), "2024-06-01", True), (Sort.ne("abc"), "7", True),
]
NULLS = [Sort.eq("a"), Sort.ne("a"), Sort.lt("a"), Sort.lte("a"), Sort.gt("a"), Sort.gte("a"), Sort.begins_with("a"), Sort.contains("a"), Sort.between("a", "z")]


def test_truth_table_on_values():
    assert all(c(v) is r for c, v, r in TRUTH)
    assert not any(c(None) for c in NULLS)


@pytest.mark.parametrize("kind", ["string", "variant"])
def test_truth_table_on_columns(spark, kind):
    import json

    rows = [(i, v if kind == "string" else json.dumps(v)) for i, (_, v, _) in enumerate(TRUTH)] + [(-1, None), (-2, None if kind == "string" else "null")]
    df = spark.createDataFrame(rows, "i int, v string")
    df = df if kind == "string" else df.withColumn("v", F.parse_json("v"))
    v = value_of(df, "v")
    found = df.where("i >= 0").select("i", *[c.column(v).alias(f"c{k}") for k, (c, _, _) in enumerate(TRUTH)]).collect()
    for r in found:
        assert r[f"c{r['i']}"] is TRUTH[r["i"]][2], TRUTH[r["i"]]
    for r in df.where("i < 0").select(*[F.coalesce(c.column(v), F.lit(False)).alias(f"n{k}") for k, c in enumerate(NULLS)]).collect():
        assert not any(r)


def test_mixed_types_have_one_order(spark):
    values = [None, False, True, -3, 2.5, 10, "", "10", "9", "abc", [1], {"a": 1}]
    import json

    df = spark.createDataFrame([(i, json.dumps(v)) for i, v in enumerate(values)], "i int, t string").select("i", F.parse_json("t").alias("v"))
    assert [r["i"] for r in df.orderBy(value_of(df, "v").order).collect()] == list(range(len(values)))
    assert sorted(values, key=key_of) == values


@given(st.one_of(st.none(), st.booleans(), st.integers(-1000, 1000), st.floats(-1e3, 1e3), st.text(max_size=4)), st.one_of(st.integers(-1000, 1000), st.text(max_size=4)))
def test_exactly_one_of_lt_eq_gt(value, other):
    held = [c(value) for c in (Sort.lt(other), Sort.eq(other), Sort.gt(other))]
    assert sum(held) == (0 if value is None else 1)


@pytest.mark.parametrize(("text", "value"), [("42", 42), ("-1.5", -1.5), ("1e3", 1000.0), (" 42", " 42"), ("1_000", "1_000"), ("nan", "nan"), ("1.5d", "1.5d"), ("", ""), (".5", 0.5), ("٣", "٣")])
def test_coercion_grammar(text, value):
    assert coerced(text) == value and type(coerced(text)) is type(value)


def test_directives():
    assert parse_condition({"gte": 3, "lt": 9}) == Sort.gte(3)
    assert parse_condition({"like": 3}) is None and parse_condition({}) is None and parse_condition(None) is None
    for bad in ([1], 5, [1, 2, 3]):
        with pytest.raises(ValueError):
            parse_condition({"between": bad})
