"""Whole detections on small worlds: fleets, stocks, claims, incidents, patients, pull requests."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from ruleweave.functions.conditions import attr, derived, present
from ruleweave.operators import aggregates, graph, models, optimize, policy, recursion, sequences, stats
from ruleweave.plans.detect import Detect
from ruleweave.sources.entities import EntityView, from_facts, records


def found(df, id_col="id"):
    return sorted(r[id_col] for r in df.collect())


@pytest.fixture(scope="module")
def fleet(spark):
    rows = [
        {"id": 1, "type": "vehicle", "status": "active", "category": "trucks", "name": "Red", "km": 52000.0, "last_service_km": 40000.0, "model": "T1"},
        {"id": 2, "type": "vehicle", "status": "active", "category": "vans", "name": "Blue", "km": 41000.0, "last_service_km": 40000.0, "model": "V9"},
        {"id": 3, "type": "vehicle", "status": "retired", "category": "trucks", "name": "Old", "km": 300000.0, "last_service_km": 1000.0, "model": "T1"},
        {"id": 4, "type": "depot", "status": "active", "category": "sites", "name": "North"},
        {"id": 5, "type": "vehicle", "status": "active", "category": "trucks", "name": "Green", "km": 90000.0, "model": "T7"},
    ]
    return EntityView(records(spark, rows, "id long, type string, status string, category string, name string, km double, last_service_km double, model string"), "id")


VEHICLE = attr("type") == "vehicle"
OVERDUE = derived(lambda: attr("km") - attr("last_service_km") > 10000)


def test_service_overdue(fleet):
    strict = EntityView(fleet.df, "id", on_error="drop")
    assert found(Detect("overdue", VEHICLE & (attr("status") == "active") & OVERDUE).run(strict)) == [1]
    assert found(Detect("overdue", VEHICLE & (attr("status") == "active") & OVERDUE).run(fleet)) == [1, 5]  # unknown service stays
    assert found(Detect("fine", VEHICLE & ~OVERDUE).run(strict)) == [2, 5]


def test_recall_by_model_and_membership(fleet):
    recalled = derived(lambda: attr("model").isin("T1", "T7"))
    assert found(Detect("recall", recalled & (attr("status") != "retired")).run(fleet)) == [1, 5]
    assert found(Detect("other", VEHICLE & attr("model").notin("T1", "T7")).run(fleet)) == [2]


def test_category_tree_of_vehicles(spark, fleet):
    tree = spark.createDataFrame([("fleet", None), ("road", "fleet"), ("trucks", "road"), ("vans", "road"), ("sites", None)], "name string, parent string")
    assert found(recursion.in_category(fleet.df, "category", tree, "fleet")) == [1, 2, 3, 5]
    assert found(recursion.in_category(fleet.df, "category", tree, "fleet", negate=True)) == [4]


def test_low_stock_feeds_a_recommendation(spark):
    stock = EntityView(spark.createDataFrame([(1, "oil", 2.0, 10.0), (2, "tyre", 40.0, 10.0), (3, "belt", None, 5.0)], "id long, name string, stock double, least double"), "id", on_error="drop")
    low = Detect("low", attr("stock") - attr("least") < 0, label="{name}: {stock} of {least}").run(stock)
    assert [r.label for r in low.collect()] == ["oil: 2 of 10"]
    order = Detect("reorder", present("name"), matching=[low]).run(stock)
    assert found(order) == [1]


def test_outlier_among_the_selected_only(spark):
    rows = [(i, "stock", 100.0 + i) for i in range(8)] + [(8, "stock", 400.0), (9, "item", 9999.0)]
    view = EntityView(spark.createDataFrame(rows, "id long, type string, use double"), "id")
    for test in (lambda df: stats.zscore(df, "use"), lambda df: stats.grubbs(df, "use")):
        assert found(Detect("outlier", attr("type") == "stock", statistics=[test]).run(view)) == [8]


def test_statistics_narrow_one_after_the_other(spark):
    view = EntityView(spark.createDataFrame([(i, float(i)) for i in range(1, 101)], "id long, x double"), "id")
    twice = Detect("top", present("x"), statistics=[lambda df: stats.learned_threshold(df, "x", 90).drop("threshold"), lambda df: stats.learned_threshold(df, "x", 50)]).run(view)
    assert found(twice) == [96, 97, 98, 99, 100]  # the median of the ten rows that are left


def test_stock_out_forecast(spark):
    days = [(1, d, 50.0 - 5 * d) for d in range(6)] + [(2, d, 10.0 + d) for d in range(6)]
    out = stats.forecast(spark.createDataFrame(days, "id long, d int, stock double"), ["id"], ["d"], "stock")
    assert {r.id: (r.steps, r.confidence) for r in out.collect()} == {1: (5, 1.0), 2: (365, 0.0)}


def test_risk_by_neighbours_and_by_tree(spark):
    history = spark.createDataFrame([(i, 1000.0 * i, "failed" if i > 5 else "fine") for i in range(1, 11)], "id long, hours double, outcome string")
    now = spark.createDataFrame([(100, 9800.0), (101, 900.0), (102, 5500.0)], "id long, hours double")
    sure = models.knn_classify(now, history, "id", "outcome", ["hours"], 5, 0.9)
    assert {r.id: r.label for r in sure.collect()} == {100: "failed", 101: "fine"}  # a split vote is dropped
    tree = models.fit_tree(history, "id", "outcome", ["hours"])
    assert tree.threshold == 5500.0
    assert {r.id: r.label for r in models.predict(now, tree, 0.9).collect()} == {100: "failed", 101: "fine", 102: "fine"}


def test_claims_above_the_cap(spark):
    view = EntityView(spark.createDataFrame([(1, "p1", "suspended", 90.0, 100.0), (2, "p2", "active", 150.0, 100.0), (3, "p3", "active", None, 100.0)], "id long, provider string, standing string, amount double, cap double"), "id")
    rules = [policy.Rule("capped", attr("amount") > attr("cap"), "reduce", {"to": "{cap}"}, "HIGH"), policy.Rule("banned", attr("standing") == "suspended", "reject", {}, strict=True)]
    assert {(r.entity, r.verb) for r in policy.matched(view, rules).collect()} == {(1, "reject"), (2, "reduce")}


def test_conflicting_reads(spark):
    view = EntityView(spark.createDataFrame([(1, "benign", "malignant"), (2, "benign", "benign"), (3, "benign", None)], "id long, first string, second string"), "id")
    assert found(Detect("conflict", attr("first") != attr("second")).run(view)) == [1]


def test_fault_chain(spark):
    t0 = dt.datetime(2024, 1, 1)
    rows = [(1, 0, "electrical"), (1, 20, "engine"), (2, 0, "engine"), (2, 5, "electrical"), (3, 0, "electrical"), (3, 31, "engine"), (4, 0, "electrical")]
    faults = spark.createDataFrame([(i, v, t0 + dt.timedelta(days=d), k) for i, (v, d, k) in enumerate(rows)], "seq long, item long, at timestamp, type string")
    assert found(sequences.event_sequence(faults, "item", "at", "seq", "type", ["electrical", "engine"], 1, "month"), "item") == [1]


def test_consumption_gate(spark):
    depots = spark.createDataFrame([(1, "a"), (2, "b")], "id long, name string")
    use = spark.createDataFrame([(10, 5.0), (11, 7.0), (12, 12.0)], "id long, amount double")
    mean = aggregates.calculate(use, "rate", "average", "amount")
    assert found(aggregates.having(depots, mean, F.col("rate") > 7)) == [1, 2]
    assert found(aggregates.having(depots, mean, F.col("rate") > 9)) == []
    wma = aggregates.weighted_moving_average(use.withColumn("g", F.lit(1)), "amount", ["id"], ["g"]).first().wma
    assert wma == pytest.approx((5 + 14 + 36) / 6)


def test_pull_request_review(spark):
    rows = [
        {"id": 1, "draft": False, "described": True, "lines": 40.0, "files": ["src/a.py", "tests/t.py"], "author": "ann"},
        {"id": 2, "draft": False, "described": False, "lines": 900.0, "files": ["src/a.py"], "author": "bob"},
        {"id": 3, "draft": True, "files": [], "author": "ann"},
        {"id": 4, "draft": False, "described": True, "lines": 10.0, "author": "cyd"},
    ]
    view = EntityView(records(spark, rows, "id long, draft boolean, described boolean, lines double, files array<string>, author string"), "id")
    ready = ~(attr("draft") == True)  # noqa: E712
    rules = [
        policy.Rule("approve", ready & (attr("lines") < 100), "approve"),
        policy.Rule("tests", ready & ~attr("files").starts_with("tests/"), "ask", {"for": "tests of {author}"}, "HIGH", ("approve",)),
        policy.Rule("describe", ready & ~(attr("described") == True), "comment"),  # noqa: E712
        policy.Rule("large", attr("lines") > 500, "split", {}, "HIGH"),
    ]
    left = policy.resolve(policy.matched(view, rules), rules)
    assert {(r.entity, r.verb) for r in left.collect()} == {(1, "approve"), (2, "ask"), (2, "comment"), (2, "split"), (4, "ask")}


def test_dispatch_front(spark):
    rows = [(1, 5.0, 9.0), (2, 3.0, 7.0), (3, 6.0, 8.0), (4, 2.0, 1.0), (5, 2.0, 1.0), (6, None, 5.0)]
    assert found(optimize.pareto_front(spark.createDataFrame(rows, "id long, cost double, urgency double"), "id", {"cost": "min", "urgency": "max"})) == [1, 2, 4, 5]


def test_related_parts_stay_in_their_clique(spark):
    facts = spark.createDataFrame([(i, "group", "a") for i in range(1, 5)] + [(i, "group", "b") for i in range(5, 8)], "entity long, attribute string, value string")
    near = graph.related(graph.shared_value_edges(facts), spark.createDataFrame([(1,)], "node long"))
    assert found(near, "node") == [2, 3, 4]
    assert graph.shared_value_edges(facts, most=3).where("src < 5").count() == 0  # a value that too many share links none


def test_cells_of_mixed_kinds(spark):
    facts = spark.createDataFrame([(1, "km", "12.5"), (1, "name", "x"), (2, "km", "unknown"), (3, "other", "1")], "entity long, attribute string, value string")
    wide = from_facts(facts, {"km": "double", "name": "string"})
    assert {r.id: (r.km, r.name) for r in wide.collect()} == {1: (12.5, "x"), 2: (None, None)}
