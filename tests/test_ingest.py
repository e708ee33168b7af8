"""Tool answers as facts, refreshed cells, nested documents, judgements."""

import datetime as dt
import json

from pyspark.sql import functions as F

from ruleweave.functions.conditions import attr
from ruleweave.operators import policy
from ruleweave.sources import factlog, ingest
from ruleweave.sources.entities import EntityView


def test_collect(spark):
    bodies = ['[{"id": 7, "a": 1, "b": {"c": 2}}, {"a": "x"}]', '{"results": [{"id": "9", "a": null, "z": true}]}', '{"id": 3, "a": 2.5}', "no json", None, "[]", '{"items": []}']
    got = ingest.collect(spark.createDataFrame([(b,) for b in bodies], "body string"), "body", "thing", "t1")
    cells = {(r.entity, r.attribute, r.value) for r in got.collect()}
    want = {(7, "a", "1"), (2, "a", "x"), (9, "z", "true"), (3, "a", "2.5")}
    assert {c for c in cells if c[1] not in ("type", "tag")} == want
    assert {(i, "type", "thing") for i in (7, 2, 9, 3)} <= cells


def test_refresh_touches_only_old_cells(spark):
    at = lambda h: dt.datetime(2024, 1, 1, h)
    facts = spark.createDataFrame([(1, "s", "old", at(1), 1, False), (2, "s", "new", at(9), 2, False)], "entity long, attribute string, value string, at timestamp, seq long, deleted boolean")
    answers = spark.createDataFrame([(1, "x"), (2, "y"), (3, "z"), (4, None)], "entity long, value string")
    out = factlog.as_of(ingest.refresh(facts, answers, F.lit(at(10)), F.expr("interval 2 hours"), "s"))
    assert {r.entity: r.value for r in out.collect()} == {1: "x", 2: "new", 3: "z"}


def test_pull(spark):
    view = EntityView(spark.createDataFrame([(1, "a", None), (2, None, 3.0)], "id long, name string, x double"), "id")
    kids = spark.createDataFrame([(1, 5), (1, 4), (9, 1)], "parent long, k long")
    docs = {r.id: json.loads(r.document) for r in ingest.pull(view, ["name", "x"], {"kids": (kids, "parent", ["k"], ["k"])}).collect()}
    assert docs == {1: {"id": 1, "name": "a", "kids": [{"k": 4}, {"k": 5}]}, 2: {"id": 2, "x": 3.0}}


def test_judgements(spark):
    view = EntityView(spark.createDataFrame([(1, 5.0), (2, 50.0), (3, None)], "id long, x double"), "id")
    rules = [policy.Judgement("a", attr("x") > 1, "requires", "x is {x}"), policy.Judgement("b", attr("x") > 10, "block", "too much"), policy.Judgement("c", attr("x") > 20, "block", "far too much")]
    got = {r.entity: (r.decision, r.reasons) for r in policy.judge(view, rules).collect()}
    assert got == {1: ("requires", ["x is 5"]), 2: ("block", ["too much", "far too much"]), 3: ("allow", [])}
