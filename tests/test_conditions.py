"""Two-valued logic, kinds, evaluation policy, strings, times."""

import datetime as dt

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from ruleweave.functions import scalars as S
from ruleweave.functions.conditions import TODAY, Condition, attr, context, full_text, present
from ruleweave.sources.entities import EntityView, from_facts, to_facts

ROWS = [
    (1, 10.0, 5.0, "oil filter", True, ["src/a.py", "docs/b.md"], dt.date(1998, 1, 5)),
    (2, None, 5.0, "Brake pad", None, [], dt.date(1996, 1, 5)),
    (3, 3.0, 0.0, None, False, None, None),
    (4, -0.0, None, "", True, ["x"], dt.date(1998, 1, 1)),
]


@pytest.fixture(scope="module")
def view(spark):
    df = spark.createDataFrame(ROWS, "id long, km double, last double, name string, active boolean, files array<string>, due date")
    return EntityView(df, "id", context={"today": "1998-01-01", "limit": 4})


def ids(view, condition):
    return sorted(r.id for r in view.df.where(condition.on(view)).collect())


def test_missing_is_false_and_its_negation_true(view):
    assert ids(view, attr("km") > 2) == [1, 3]
    assert ids(view, ~(attr("km") > 2)) == [2, 4]
    assert ids(view, attr("nothing") == 1) == []
    assert ids(view, ~(attr("nothing") == 1)) == [1, 2, 3, 4]
    assert ids(view, present("files")) == [1, 2, 4]


def test_unequal_and_not_in_need_presence(view):
    assert ids(view, attr("km") != 3) == [1, 4]
    assert ids(view, attr("name").notin("oil filter")) == [2, 4]
    assert ids(view, attr("km").isin(3, 10)) == [1, 3]


def test_kinds_never_mix(view):
    assert ids(view, attr("active") == 1) == []
    assert ids(view, attr("name") == 3) == []
    assert ids(view, attr("active") != 1) == [1, 3, 4]
    assert ids(view, attr("name") > "a") == []  # only numbers are ordered
    assert ids(view, attr("km") == 3) == [3]


def test_computed_conditions_follow_the_policy(view):
    late = attr("km") - attr("last") > 4
    assert ids(view, late) == [1, 2, 4]
    strict = EntityView(view.df, "id", on_error="drop")
    assert ids(strict, late) == [1]
    assert ids(strict, attr("km") / attr("last") > 1) == [1]
    with pytest.raises(Exception, match="evaluated"):
        ids(EntityView(view.df, "id", on_error="fail"), late)


def test_strings_and_lists(view):
    assert ids(view, attr("name").contains("filter")) == [1]
    assert ids(view, attr("name").starts_with("brake")) == []
    assert ids(view, attr("name").matches("BRAKE")) == [2]
    assert ids(view, attr("name").matches("")) == []
    assert ids(view, attr("files").ends_with(".md")) == [1]
    assert ids(view, ~attr("files").starts_with("src")) == [2, 3, 4]
    assert ids(view, full_text("PAD")) == [2]


def test_times_and_context(view):
    assert ids(view, attr("due").older_than(1, "year")) == [2]
    assert ids(view, attr("due").approaching_within(1, "week")) == [1, 4]
    assert ids(view, attr("due") >= TODAY) == [1, 4]
    assert ids(view, attr("km") > context("limit")) == [1]


def test_remainder_has_the_sign_of_the_dividend(spark):
    view = EntityView(spark.createDataFrame([(1, -7.9, 3.0), (2, 7.0, 0.0)], "id long, a double, b double"), "id")
    got = {r.id: r.x for r in view.df.select("id", (attr("a") % attr("b")).build(view).alias("x")).collect()}
    assert got == {1: -1.0, 2: None}


@settings(max_examples=6, deadline=None, suppress_health_check=[HealthCheck.function_scoped_fixture])
@given(st.floats(-5, 15), st.sampled_from(["km", "last", "nothing"]))
def test_a_condition_and_its_negation_part_the_rows(view, x, name):
    for c in (attr(name) > x, (attr(name) == x) | (attr("km") < x), attr(name) + 1 > x):
        assert sorted(ids(view, c) + ids(view, ~c)) == [1, 2, 3, 4]


def test_scalars(spark):
    row = spark.createDataFrame([("  a.b ", "ab", 3.0, 2.5)], "s string, t string, whole double, part double").select(
        S.trim(F.col("s")).alias("trim"), S.substring(F.col("t"), -3, 1).alias("sub"), S.replace(F.col("t"), "", "-").alias("rep"), S.split(F.col("s"), ".").alias("split"),
        S.stringify(F.col("whole")).alias("w"), S.stringify(F.col("part")).alias("p"), S.template("{t} and {u}", {"t": F.col("t")}).alias("tpl"),
        S.path(F.lit('{"a": {"b": [1, {"c": "x"}]}}'), "a.b.1.c").alias("path"), S.path(F.lit('{"a": 1}'), "a.b.7").alias("none"),
    ).first()
    assert (row.trim, row.sub, row.rep, row.w, row.p, row.tpl, row.path, row.none) == ("a.b", "a", "-a-b-", "3", "2.5", "ab and {u}", "x", None)
    assert row.split == ["  a", "b "]


def test_facts_and_rows_are_the_same(view):
    back = from_facts(to_facts(view.with_df(view.df.select("id", "km", "name"))), {"km": "double", "name": "string"})
    assert {r.id: (r.km, r.name) for r in back.collect()} == {r[0]: (r[1], r[3]) for r in ROWS}


def test_more_rows_and_columns_change_nothing(view):
    c = (attr("km") > 2) & ~attr("name").contains("x")
    wider = view.with_df(view.df.withColumn("other", F.lit("z")).repartition(3))
    assert ids(view, c) == ids(wider, c)
    assert ids(view, Condition(lambda v: F.lit(None).cast("boolean"))) == []
