"""Operators on small tables, against values worked out by hand or by plain Python."""

import datetime as dt
import itertools
import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from ruleweave.functions.conditions import attr
from ruleweave.operators import aggregates, graph, models, optimize, policy, recursion, sequences, stats
from ruleweave.plans import catalogue
from ruleweave.plans.detect import Detect
from ruleweave.sources import factlog
from ruleweave.sources.entities import EntityView

T0 = dt.datetime(2024, 1, 1)


def at(hours):
    return T0 + dt.timedelta(hours=hours)


def numbers(spark, values):
    return spark.createDataFrame([(i, v) for i, v in enumerate(values)], "id long, x double")


def flagged(df):
    return sorted(r.id for r in df.where("flagged").collect())


def test_zscore(spark):
    assert flagged(stats.zscore(numbers(spark, [10.0] * 8 + [11.0, 100.0, None]), "x")) == [9]
    assert flagged(stats.zscore(numbers(spark, [5.0] * 5), "x")) == []  # no spread
    assert flagged(stats.zscore(numbers(spark, [1.0, 100.0]), "x", threshold=0.1)) == []  # below the minimal sample


def test_grubbs(spark):
    assert flagged(stats.grubbs(numbers(spark, [10.0, 11.0, 10.5, 10.2, 9.9, 10.1, 10.4, 30.0]), "x")) == [7]
    assert stats.grubbs_critical(8) == 2.126
    assert stats.grubbs_critical(22) == pytest.approx(2.709 + 2 / 5 * (2.822 - 2.709))
    assert stats.grubbs_critical(5000) > 3.957
    assert stats.grubbs_critical(10, 0.1) == pytest.approx(2.176, abs=0.01)
    assert stats.grubbs_critical(2) == math.inf
    for alpha in (0.05, 0.01, 0.1):
        sizes = spark.createDataFrame([(n,) for n in (3, 4, 7, 22, 100, 101, 600, 1000, 1001, 50_000)], "n long")
        for r in stats._with_critical(sizes.withColumn("sample", F.col("n")), alpha).withColumnRenamed("g_crit", "g").collect():
            assert r.g == pytest.approx(stats.grubbs_critical(r.n, alpha), rel=1e-6)


def test_learned_threshold(spark):
    out = stats.learned_threshold(numbers(spark, [1.0, 2.0, 10.0]), "x", 90).collect()
    assert [(r.id, round(r.threshold, 6)) for r in out] == [(2, 8.4)]
    assert stats.learned_threshold(numbers(spark, [1.0, 2.0]), "x", 90).count() == 2  # too small a sample passes


def test_correlation(spark):
    df = spark.createDataFrame([(1, 1.0, 2.0), (2, 2.0, 4.1), (3, 3.0, 6.0), (4, None, 1.0)], "id long, a double, b double")
    assert stats.correlation(df, "a", "b").first().r == pytest.approx(np.corrcoef([1, 2, 3], [2, 4.1, 6])[0, 1])
    assert stats.correlation(df.withColumn("b", F.lit(1.0)), "a", "b").first().r == 0
    assert stats.correlates_with(df, "a", "b", 0.9).count() == 4
    assert stats.correlates_with(df, "a", "b", -0.9).count() == 0


def test_forecast(spark):
    df = spark.createDataFrame([("a", i, 100.0 - 10 * i) for i in range(5)] + [("b", 0, 3.0)] + [("c", i, 5.0 + i) for i in range(3)], "k string, i int, x double")
    out = {r.k: r for r in stats.forecast(df, ["k"], ["i"], "x").collect()}
    assert (out["a"].steps, round(out["a"].level, 6), round(out["a"].trend, 6), out["a"].confidence) == (6, 60.0, -10.0, 1.0)
    assert (out["b"].steps, out["b"].confidence) == (365, 0.0)
    assert (out["c"].steps, out["c"].confidence) == (365, 0.0)


def test_markov_and_hidden_markov(spark):
    df = spark.createDataFrame([(1, i, s) for i, s in enumerate("aabab")], "k long, i int, s string")
    t = stats.markov_transitions(df, ["k"], ["i"], "s")
    assert {(r.from_state, r.to_state): r.p for r in t.collect()} == {("a", "a"): pytest.approx(1 / 3), ("a", "b"): pytest.approx(2 / 3), ("b", "a"): 1.0}
    assert {r.state: r.p for r in stats.markov_after(t, "b", 2).collect()} == {"a": pytest.approx(1 / 3), "b": pytest.approx(2 / 3)}
    start, move, emit = [0.6, 0.4], [[0.7, 0.3], [0.4, 0.6]], [{"a": 0.5, "b": 0.5}, {"a": 0.1, "b": 0.9}]
    got = stats.hmm_score(df, ["k"], ["i"], "s", start, move, emit, 0.0).first()
    p = 0.0
    for path in itertools.product(range(2), repeat=5):
        q = start[path[0]] * emit[path[0]]["a"]
        for i in range(1, 5):
            q *= move[path[i - 1]][path[i]] * emit[path[i]]["aabab"[i]]
        p += q
    assert got.log_likelihood == pytest.approx(math.log(p))
    assert stats.hmm_score(df.withColumn("s", F.lit("z")), ["k"], ["i"], "s", start, move, emit, 0.0).first().anomaly == 1.0


def test_tuning_and_quality(spark):
    df = spark.createDataFrame([(0.7, False), (1.2, False), (2.6, True), (3.1, True), (None, False)], "s double, e boolean")
    best = stats.tune_threshold(df, "s", "e").first()
    assert (best.threshold, best.f1) == (1.2, 1.0)
    q = stats.quality_of(df.withColumn("f", F.col("s") > 1), "f", "e").first()
    assert (q.precision, q.recall, round(q.f1, 6)) == (pytest.approx(2 / 3), 1.0, 0.8)


def test_aggregates(spark):
    df = spark.createDataFrame([(1, "a", 1.0), (2, "a", None), (3, "b", 4.0)], "id long, k string, x double")
    assert {r.k: (r.n, r.t) for r in aggregates.group(df, ["k"], n=("count", None), t=("sum", "x")).collect()} == {"a": (2.0, 1.0), "b": (1.0, 4.0)}
    assert aggregates.calculate(df.where("x > 9"), "m", "average", "x").first().m == 0.0
    assert aggregates.weighted_moving_average(df.withColumn("g", F.lit(1)), "x", ["id"], ["g"]).first().wma == pytest.approx((1 + 8) / 3)
    assert aggregates.having(df, aggregates.calculate(df, "m", "max", "x"), F.col("m") > 5).count() == 0
    assert [r.k for r in aggregates.quantified(df, "k", F.col("x") > 3, "none").collect()] == ["a"]


def test_sequences(spark):
    rows = [(1, 0, "a"), (1, 1, "b"), (1, 30, "c"), (2, 0, "b"), (2, 1, "a"), (3, 0, "a"), (3, 40, "b"), (4, 0, "a"), (4, 20, "a"), (4, 30, "b"), (4, 31, "c")]
    df = spark.createDataFrame([(k, i, at(h), n) for i, (k, h, n) in enumerate(rows)], "k long, seq long, ts timestamp, n string")
    seq = lambda chain, days: sorted(r.k for r in sequences.event_sequence(df, "k", "ts", "seq", "n", chain, days).collect())
    assert seq(["a", "b"], 1) == [1, 4]
    assert seq(["a", "b"], 0) == [1, 3, 4]
    assert seq(["a", "b", "c"], 1) == [4]  # only the later start is near enough
    assert seq(["a", "b", "c"], 2) == [1, 4]
    assert [(r.k, r.most) for r in sequences.burst(df, ["k"], "ts", 3, 12, "hours").collect()] == [(4, 3)]
    assert sorted(r.k for r in sequences.burst(df, ["k"], "ts", 2, 1 / 24).collect()) == [1, 2, 4]


@pytest.mark.parametrize("seed", range(3))
def test_sequences_against_all_chains(spark, seed):
    rng = np.random.default_rng(seed)
    rows = [(int(rng.integers(12)), i, at(int(rng.integers(60))), "abc"[rng.integers(3)]) for i in range(90)]
    df = spark.createDataFrame(rows, "k long, seq long, ts timestamp, n string")
    for chain in (["a", "b", "c"], ["a", "a"], ["b", "a", "b"]):
        want = set()
        for k in range(12):
            own = sorted((r[2], r[1], r[3]) for r in rows if r[0] == k)
            for c in itertools.combinations(own, len(chain)):
                if [x[2] for x in c] == chain and c[-1][0] - c[0][0] <= dt.timedelta(days=1):
                    want.add(k)
        assert {r.k for r in sequences.event_sequence(df, "k", "ts", "seq", "n", chain, 1).collect()} == want


def test_fact_log(spark):
    rows = [(1, "s", "a", 0, 1, False), (1, "s", "a", 1, 2, False), (1, "s", "b", 2, 3, False), (1, "s", None, 3, 4, True), (2, "s", "x", 0, 5, False), (2, "t", "y", 0, 6, False), (2, None, None, 5, 7, True), (3, "s", "p", 0, 8, False), (3, "s", "q", 0, 9, False)]
    facts = factlog.expand_retractions(spark.createDataFrame([(e, a, v, at(h), s, d) for e, a, v, h, s, d in rows], "entity long, attribute string, value string, at timestamp, seq long, deleted boolean"))
    snap = lambda h: {(r.entity, r.attribute): r.value for r in factlog.as_of(facts, F.lit(at(h))).collect()}
    assert snap(1) == {(1, "s"): "a", (2, "s"): "x", (2, "t"): "y", (3, "s"): "q"}
    assert snap(3) == {(2, "s"): "x", (2, "t"): "y", (3, "s"): "q"}
    assert snap(9) == {(3, "s"): "q"}
    assert [r.kind for r in factlog.changes(facts).where("entity = 1").orderBy("seq").collect()] == ["assert", "change", "retract"]
    assert sorted((r.attribute, r.kind) for r in factlog.changes(facts).where("entity = 2").collect()) == [("s", "assert"), ("s", "retract"), ("t", "assert"), ("t", "retract")]
    assert factlog.last_written(facts.where("seq < 3")).first().last_written == at(1)  # an equal value counts as written
    assert [(r.value, r.valid_to) for r in factlog.versions(facts).where("entity = 1").orderBy("valid_from").collect()] == [("a", at(2)), ("b", at(3))]


def test_reachability(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 5), (5, None)], "src long, dst long")
    got = recursion.reachable(edges, spark.createDataFrame([(1,), (4,), (9,)], "seed long"))
    assert {(r.seed, r.node) for r in got.collect()} == {(1, 2), (1, 3), (1, 1), (4, 5)}
    assert got.count() == 4
    assert {(r.seed, r.node) for r in recursion.reachable(edges, spark.createDataFrame([(1,)], "seed long"), guard=F.col("dst") < 3).collect()} == {(1, 2)}


def test_categories(spark):
    tree = spark.createDataFrame([("root", None), ("a", "root"), ("b", "a"), ("c", "other")], "name string, parent string")
    rows = spark.createDataFrame([(1, "b"), (2, "c"), (3, None), (4, "root")], "id long, cat string")
    assert sorted(r.id for r in recursion.in_category(rows, "cat", tree, "root").collect()) == [1, 4]
    assert sorted(r.id for r in recursion.in_category(rows, "cat", tree, "root", negate=True).collect()) == [2]


def test_well_founded_games(spark):
    """win(x) if move(x, y) and not win(y): a path alternates, a cycle alone is a draw, a cycle with a way out isn't."""
    moves = [("a", "b"), ("b", "c"), ("x", "y"), ("y", "x"), ("p", "q"), ("q", "p"), ("q", "r")]
    rules = spark.createDataFrame([(x, [], [y]) for x, y in moves], "head string, pos array<string>, neg array<string>")
    got = {r.atom: r.truth for r in recursion.well_founded(rules).collect()}
    assert got == {"a": "false", "b": "true", "c": "false", "x": "undefined", "y": "undefined", "p": "false", "q": "true", "r": "false"}
    positive = spark.createDataFrame([("a", [], []), ("b", ["a"], []), ("c", ["b", "a"], []), ("d", ["e"], []), ("e", ["d"], [])], "head string, pos array<string>, neg array<string>")
    assert {r.atom: r.truth for r in recursion.well_founded(positive).collect()} == {"a": "true", "b": "true", "c": "true", "d": "false", "e": "false"}


def test_well_founded_rounds_broadcast_nothing(spark, monkeypatch):
    plans, cut = [], recursion.cut
    monkeypatch.setattr(recursion, "cut", lambda df: plans.append(df._jdf.queryExecution().executedPlan().toString()) or cut(df))
    rules = spark.createDataFrame([(x, [], [y]) for x, y in ("ab", "bc")], "head string, pos array<string>, neg array<string>")
    found = recursion.well_founded(rules)
    plans.append(found._jdf.queryExecution().executedPlan().toString())
    assert len(plans) > 5 and not any("Broadcast" in p for p in plans)
    assert {r.atom: r.truth for r in found.collect()} == {"a": "false", "b": "true", "c": "false"}


def test_nearest_neighbours(spark):
    training = spark.createDataFrame([(i, "hot" if i < 5 else "cold", float(i < 5) * 10 + i / 10) for i in range(10)], "id long, label string, x double")
    got = models.knn_classify(spark.createDataFrame([(100, 9.8), (101, 0.4), (102, None)], "id long, x double"), training, "id", "label", ["x"], 5, 0.8)
    assert {r.id: (r.label, r.confidence) for r in got.collect()} == {100: ("hot", 1.0), 101: ("cold", 1.0), 102: ("cold", 1.0)}
    with pytest.raises(ValueError, match="more than"):
        models.bounded(training, "the training set", 3)


def test_tree(spark):
    rng = np.random.default_rng(1)
    rows = [(i, float(rng.integers(100)), float(rng.integers(100))) for i in range(80)]
    df = spark.createDataFrame([(i, x, y, "in" if x <= 40 and y <= 60 else "out") for i, x, y in rows], "id long, x double, y double, label string")
    tree = models.fit_tree(df, "id", "label", ["x", "y"], leaf=1)
    assert models.predict(df.withColumnRenamed("label", "truth"), tree).where("label <> truth").count() == 0
    assert models.fit_tree(df.limit(0), "id", "label", ["x"]).label is None
    assert models.fit_tree(df.where("label = 'in'"), "id", "label", ["x"]).confidence == 1.0


def test_tree_of_more_rows_than_one_place_takes(spark, monkeypatch):
    """The same tree as in one place, with equal values, features without a split and values over several batches."""
    rng = np.random.default_rng(4)
    x = np.column_stack([rng.integers(0, 30, 400), rng.normal(size=400).round(2), np.ones(400), rng.integers(0, 3, 400)]).astype(float)
    label = [None if i % 50 == 9 else "xyz"[int(a > 12) + int(a > 12 and b > 0.3)] if rng.random() < 0.9 else "xyz"[i % 3] for i, (a, b) in enumerate(x[:, :2])]
    names = ["a", "b", "c", "d"]
    df = spark.createDataFrame([(i, *v, c) for i, (v, c) in enumerate(zip(x.tolist(), label, strict=True))], "id long, a double, b double, c double, d double, label string")
    whole = models.fit_tree(df, "id", "label", names)
    assert whole.feature == "a"
    monkeypatch.setattr(models, "BOUND", 100)
    monkeypatch.setattr(models, "TOGETHER", 3, raising=False)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert models.fit_tree(df, "id", "label", names) == whole
        assert models.fit_tree(df.where("label = 'x'"), "id", "label", names) == models.Split(label="x", confidence=1.0)
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


def test_all_labelled_embeddings_fit_the_tree(spark, tmp_path):
    """1,500 rows whose labels 0 and 1 are parted by the first number: with all rows trained, half way between the nearest two."""
    values = [i / 1500 for i in range(1500)]
    spark.createDataFrame([(i, [v, *[0.0] * 63], int(i > 777)) for i, v in enumerate(values)], "vec_id long, embedding array<double>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    v = catalogue.vectors(spark, str(tmp_path))
    assert models.fit_tree(catalogue.training(v), "vec_id", "label", ["f0", "f1"]).threshold == pytest.approx((values[777] + values[778]) / 2, abs=1e-12)
    assert catalogue.training(v).count() == 1500


def test_vectors(spark):
    df = spark.createDataFrame([(1, [1.0, 0.0]), (2, [0.9, 0.1]), (3, [0.0, 1.0]), (4, [0.0, 0.0])], "id long, v array<float>")
    assert [r.id for r in models.vector_topk(df, df.where("id = 1"), "id", "v", 2).orderBy("distance").collect()] == [2, 3]
    assert {r.id for r in models.similar_to_centroid(df, "id", "v", 0.8).collect()} == {1, 2}
    assert models.vector_topk(df, df.where("id = 4"), "id", "v", 1).first().distance == 1.0


def test_neighbours_in_small_blocks(spark, monkeypatch):
    """Blocks of few numbers give the same neighbours, with ties at the last place and rows in several batches."""
    rng = np.random.default_rng(6)
    x = rng.integers(-1, 2, (60, 3)).astype(float)
    df = spark.createDataFrame([(i, v.tolist(), *v.tolist(), "ab"[i % 2]) for i, v in enumerate(x)], "id long, v array<double>, x double, y double, z double, label string")
    seeds = df.where("id % 5 = 0")
    find = lambda: (sorted(models.vector_topk(df, seeds, "id", "v", 4).collect()), sorted(models.knn_classify(df, seeds, "id", "label", ["x", "y", "z"], 3).collect()))
    whole = find()
    unit = np.divide(x, s := np.sqrt((x * x).sum(axis=1, keepdims=True)), out=np.zeros_like(x), where=s > 0)
    want = [(i, j) for i in range(0, 60, 5) for j in sorted((j for j in range(60) if j != i), key=lambda j: (round(1 - float(unit[i] @ unit[j]), 9), j))[:4]]
    assert sorted(want) == sorted((r.seed, r.id) for r in whole[0])
    monkeypatch.setattr(models, "CELLS", 5)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        assert find() == whole
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")


@pytest.mark.parametrize("numbers", [4_000_000, 64 * 90])
def test_all_labelled_embeddings_are_training_rows(spark, monkeypatch, tmp_path, numbers):
    """Against brute force over all of 1,200 rows: some without label, many equal ones, one far away; in one share and in several."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(1200, 64)).astype(np.float32)
    x[300:330], x[330:420], x[7] = x[0], x[1:4].repeat(30, axis=0), 500
    x[600:] = x[rng.integers(0, 300, 600)] + 0.6 * x[600:]
    label = [None if i % 7 == 3 else int(rng.integers(3)) for i in range(1200)]
    spark.createDataFrame([(i * 3, v.tolist(), c) for i, (v, c) in enumerate(zip(x, label, strict=True))], "vec_id long, embedding array<float>, label int").write.parquet(f"{tmp_path}/embeddings.parquet")
    some = np.array([i for i in range(1200) if label[i] is not None])
    both = np.concatenate([x, x[some]]).astype(float)
    z = (x - both.mean(axis=0)) / both.std(axis=0)
    want = {}
    for i in range(1200):
        near = some[np.argsort(np.round(np.sqrt(((z[i] - z[some]) ** 2).sum(axis=1)), 9), kind="stable")[:5]]
        n, best = min((-sum(label[j] == c for j in near), str(c)) for c in range(3))
        if n <= -3:
            want[i * 3] = (best, round(-n / 5, 6))
    monkeypatch.setattr(models, "NUMBERS", numbers, raising=False)
    got = catalogue.knn_classify(spark, str(tmp_path))
    assert {r.vec_id: (r.label, r.confidence) for r in got.collect()} == want
    assert len(want) > 600


def test_copies_and_rows_without_numbers(spark):
    """Of equal training rows the smallest ids count; with a value that isn't a number no distance is one, and ids decide."""
    training = spark.createDataFrame([(i, "ab"[i % 4 == 0], 1.0) for i in range(50)], "id long, label string, x double")
    row = spark.createDataFrame([(100, 1.0)], "id long, x double")
    assert models.knn_classify(row, training, "id", "label", ["x"], 5).first()[1:] == ("a", 0.6)
    assert models.knn_classify(row, training.where("id < 3"), "id", "label", ["x"], 5).first().confidence == pytest.approx(2 / 3)
    odd = training.withColumn("x", F.when(F.col("id") == 40, float("nan")).otherwise(F.col("id").cast("double")))
    assert models.knn_classify(row, odd, "id", "label", ["x"], 5).first()[1:] == ("a", 0.6)
    assert models.knn_classify(row, training.where("id < 0"), "id", "label", ["x"], 5).count() == 0


@pytest.mark.parametrize("min_pts", [2, 4])
def test_clusters_of_numbers(spark, monkeypatch, min_pts):
    """One feature, with copies, gaps of just eps, sparse and dense cells, and points that aren't numbers; pairs stay few."""
    rng = np.random.default_rng(min_pts)
    v = [*np.repeat(rng.integers(0, 40, 12), 3).tolist(), *rng.integers(0, 400, 40).tolist(), *range(200, 206), 1000, math.nan, math.inf, math.inf] + [700] * 500
    rows = [(i, float(a)) for i, a in enumerate(v)]
    near = [[j for j, b in rows if abs(a - b) <= 3] for _, a in rows]
    core = [i for i in range(len(v)) if len(near[i]) >= min_pts]
    label, k, inside = {}, 0, set(core)
    for i in core:
        todo, fresh = [i], i not in label
        while todo:
            p = todo.pop()
            if p not in label:
                label[p] = k
                todo += [q for q in near[p] if q in inside]
        k += fresh
    want = {i: label.get(i, min((label[j] for j in near[i] if j in label), default=-1)) for i in range(len(v))}
    sizes, cut = [], models.cut
    monkeypatch.setattr(models, "cut", lambda df: sizes.append((out := cut(df)).count()) or out)
    assert {r.id: r.cluster for r in models.dbscan(spark.createDataFrame(rows, "id long, x double"), "id", ["x"], 3.0, min_pts).collect()} == want
    assert max(sizes) <= len(v)


@pytest.mark.parametrize("seed", range(3))
def test_clusters(spark, seed):
    rng = np.random.default_rng(seed)
    x = np.concatenate([rng.normal(c, 0.4, (12, 2)) for c in (0, 3, 9)] + [rng.uniform(-20, 20, (6, 2))])
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)], "id long, a double, b double")
    near = [[j for j in range(len(x)) if math.dist(x[i], x[j]) <= 0.7] for i in range(len(x))]
    core = [i for i in range(len(x)) if len(near[i]) >= 3]
    label, k = {}, 0
    for i in core:
        if i not in label:
            todo = [i]
            while todo:
                p = todo.pop()
                if p not in label:
                    label[p] = k
                    todo += [q for q in near[p] if q in core]
            k += 1
    want = {i: label.get(i, min((label[j] for j in near[i] if j in label), default=-1)) for i in range(len(x))}
    assert {r.id: r.cluster for r in models.dbscan(df, "id", ["a", "b"], 0.7).collect()} == want
    d = [abs(a - b) for a, b in itertools.combinations(x[:, 0], 2)]
    assert models.mean_distance_eps(df, ["a"]) == pytest.approx(0.5 * sum(d) / len(d))


def test_page_rank(spark):
    cells = [(1, "v"), (2, "v"), (3, "v"), (3, "w"), (4, "w"), (7, "z"), (8, "z")]
    facts = spark.createDataFrame([(e, "a", v) for e, v in cells], "entity long, attribute string, value string")
    edges = graph.shared_value_edges(facts)
    got = graph.related(edges, spark.createDataFrame([(1,)], "node long")).collect()
    assert [r.node for r in got][:2] == [3, 2] and {r.node for r in got} == {2, 3, 4}
    n = [1, 2, 3, 4]
    m = np.zeros((4, 4))
    for r in edges.where("src < 7").collect():
        m[n.index(r.dst), n.index(r.src)] = r.w
    m /= m.sum(axis=0)
    p = np.array([1.0, 0, 0, 0])
    for _ in range(200):
        p = 0.85 * m @ p + 0.15 * np.array([1.0, 0, 0, 0])
    assert {r.node: r.score for r in got} == pytest.approx({2: p[1], 3: p[2], 4: p[3]}, abs=1e-5)
    assert graph.related(edges, spark.createDataFrame([(99,)], "node long")).count() == 0


@pytest.mark.parametrize("kinds", [{"a": "min", "b": "max"}, {"a": "min", "b": "min", "c": "max"}])
def test_pareto(spark, kinds):
    rng = np.random.default_rng(5)
    rows = [(i, *map(float, rng.integers(0, 9, 3))) for i in range(60)] + [(99, None, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "id long, a double, b double, c double")
    left = {r[0]: tuple((1 if h == "min" else -1) * r[1 + "abc".index(k)] for k, h in kinds.items()) for r in rows[:-1]}
    want, rank = {}, 0
    while left:
        front = [i for i, x in left.items() if not any(y != x and all(p <= q for p, q in zip(y, x, strict=True)) for y in left.values())]
        for i in front:
            want[i] = rank
            del left[i]
        rank += 1
    assert {r.id for r in optimize.pareto_front(df, "id", kinds).collect()} == {i for i, k in want.items() if k == 0}
    ranked = optimize.pareto_rank(df, "id", kinds, ranks=3)
    assert {r.id: r.rank for r in ranked.collect()} == {i: k for i, k in want.items() if k < 3}
    assert optimize.crowding(ranked, df, list(kinds)).where("crowding = double('inf')").count() >= 2


def test_pareto_with_empty_tasks(spark):
    df = spark.createDataFrame([(i, float(i), float(-i), 1.0) for i in range(5)] + [(9, 9.0, 9.0, 9.0)], "id long, a double, b double, c double")
    spread = df.repartition(4).where("a < 9 or c > 5").union(df.where("id < 0"))
    assert {r.id for r in optimize.pareto_front(spread, "id", {"a": "min", "b": "min", "c": "min"}).collect()} == set(range(5))


def test_related_ties_after_rounding(spark):
    edges = [(1, 9, 1.0), (9, 1, 1.0), (1, 8, 1.0 - 1e-13), (8, 1, 1.0), (1, 7, 1.0 - 2e-13), (7, 1, 1.0)]
    got = graph.related(spark.createDataFrame(edges, "src long, dst long, w double"), spark.createDataFrame([(1,)], "node long"), rounds=3, top=2, digits=9).collect()
    assert [r.node for r in got] == [7, 8]


def test_subsets(spark):
    rng = np.random.default_rng(2)
    rows = [(g, i, float(rng.integers(1, 50)), float(rng.integers(1, 50))) for g in range(3) for i in range(9)] + [(7, 1, 1.0, 1.0)]
    df = spark.createDataFrame(rows, "g long, id long, gain double, cost double")
    got = {r.group: r.total for r in optimize.subsets(df, "g", "id", 3, ("max", "gain"), [("cost", "<=", 60.0)]).collect()}
    want = {g: max(sum(r[2] for r in c) for c in itertools.combinations([r for r in rows if r[0] == g], 3) if sum(r[3] for r in c) <= 60) for g in range(3)}
    assert got == want
    near = optimize.subsets(df, "g", "id", 3, ("max", "gain"), [("cost", "<=", 60.0)], exact=False).collect()
    costs = {(r[0], r[1]): r[3] for r in rows}
    assert all(sum(costs[r.group, i] for i in r.ids) <= 60 and len(r.ids) == 3 and r.total <= want[r.group] for r in near)
    assert optimize.subsets(df, "g", "id", 3, ("max", "gain"), [("cost", "<=", 1.0)]).count() == 0


def test_subsets_of_many_groups(spark):
    """Groups that batches part, groups of one size together, above the number of subsets that are all tried, without a subset."""
    rng = np.random.default_rng(3)
    frames = [pd.DataFrame({"g": g, "id": range(n), "gain": rng.integers(1, 99, n) / 4}) for g, n in enumerate([*rng.integers(1, 12, 300), 90])]
    rows = pd.concat(frames)
    df = spark.createDataFrame(rows)
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {exact: optimize.subsets(df, "g", "id", 3, ("max", "gain"), [("gain", "<=", 30.0)], exact=exact).collect() for exact in (True, False)}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    want = {}
    for g, part in rows.groupby("g"):
        own = part["gain"].tolist()
        want[g] = max((t for c in itertools.combinations(own, 3) if (t := sum(c)) <= 30), default=None)
    assert {r.group: r.total for r in got[True]} == {g: t for g, t in want.items() if t is not None}
    assert all(r.total <= want[r.group] and len(set(r.ids)) == 3 for r in got[False]) and len(got[False]) > 100


def test_tours_of_many_points():
    """A tour of some thousand points takes seconds, and no reversal of a part shortens it further."""
    rng = np.random.default_rng(4)
    p = np.stack([rng.random(2000) * 11000, np.arange(2000) * 40.0], 1)
    t = optimize._reversals(p, optimize._nearest(p))
    assert sorted(t) == list(range(2000))
    q = p[np.append(t, t[0])]
    step = np.hypot(*(q[1:] - q[:-1]).T)
    for i in range(1, 1999):
        new = np.hypot(*(q[i + 1 : 2000] - q[i - 1]).T) + np.hypot(*(q[i + 2 :] - q[i]).T)
        assert (new >= step[i - 1] + step[i + 1 :] - 1e-8).all()


def test_tours(spark):
    square = [(1, i, x, y) for i, (x, y) in enumerate([(0.0, 0.0), (10.0, 10.0), (0.0, 10.0), (10.0, 0.0)])]
    circle = [(2, i, math.cos(i * 2.4) * 10, math.sin(i * 2.4) * 10) for i in range(13)]
    got = {r.group: r for r in optimize.tours(spark.createDataFrame(square + circle, "g long, id long, x double, y double"), "g", "id", "x", "y").collect()}
    assert got[1].length == pytest.approx(40)
    angles = sorted(i * 2.4 % (2 * math.pi) for i in range(13))
    assert got[2].length == pytest.approx(sum(20 * math.sin(((b - a) % (2 * math.pi)) / 2) for a, b in zip(angles, angles[1:] + angles[:1], strict=True)))


def test_policy(spark):
    df = spark.createDataFrame([(1, 5.0, "O"), (2, 50.0, "O"), (3, 500.0, None)], "id long, x double, s string")
    view = EntityView(df, "id")
    rules = [policy.Rule("base", attr("x") > 0, "allow", {"text": "{x} of {id}"}), policy.Rule("big", attr("x") > 10, "stop", priority="HIGH", overrides=("base",)), policy.Rule("huge", attr("x") > 100, "note", strict=True), policy.Rule("free", attr("s") == "O", "tag")]
    hits = policy.matched(view, rules)
    assert hits.count() == 8
    assert hits.where("entity = 1 and rule = 'base'").first().arguments == {"text": "5 of 1"}
    left = {(r.entity, r.rule) for r in policy.resolve(hits, rules).collect()}
    assert left == {(1, "base"), (1, "free"), (2, "big"), (2, "free"), (3, "big"), (3, "huge")}
    with pytest.raises(ValueError, match="strict"):
        policy.matched(view, [rules[2], policy.Rule("z", attr("x") > 0, overrides=("huge",))])
    verdict = policy.verdicts(view, [("present", attr("s") == "O", "warn"), ("small", attr("x") < 100, "reject")])
    assert {r.entity: (r.verdict, r.violated) for r in verdict.collect()} == {1: ("accept", []), 2: ("accept", []), 3: ("reject", ["present", "small"])}
    steps = policy.state_step(view.with_df(df.withColumn("s", F.coalesce("s", F.lit("P/x")))), "s", [("O", "Q", attr("x") > 10), ("P", "R", attr("x") > 10)], {"small": attr("x") < 100})
    assert {r.entity: (r.after, r.violations) for r in steps.collect()} == {1: ("O", []), 2: ("Q", []), 3: ("R", ["small"])}
    feedback = spark.createDataFrame([("b", "yes"), ("b", "yes"), ("b", "no"), ("c", "no")], "k string, v string")
    assert {r.k: round(r.probability, 6) for r in policy.posterior(feedback, "k", F.col("v") == "yes", F.col("v") == "no", 0.0).collect()} == {"b": 0.5, "c": 0.01}
    many = spark.range(2000)
    passed = policy.gate(many, "id", "b", F.lit(0.3))
    assert 500 < passed.count() < 700 and {r.id for r in passed.collect()} == {r.id for r in policy.gate(many.repartition(7), "id", "b", F.lit(0.3)).collect()}


def test_detect_order(spark):
    df = spark.createDataFrame([(i, "a" if i < 20 else "b", float(i % 20) if i != 7 else 500.0) for i in range(40)], "id long, k string, x double")
    view = EntityView(df, "id")
    out = Detect("d", attr("k") == "a", matching=[spark.range(30).toDF("id")], statistics=[lambda d: stats.zscore(d, "x")], scalars=[aggregates.calculate(df, "m", "avg", "x")], having=F.col("m") > 0, label="row {id}").run(view)
    assert [(r.id, r.label) for r in out.collect()] == [(7, "row 7")]


def test_empty_tables(spark):
    none = numbers(spark, [1.0]).limit(0)
    assert stats.zscore(none, "x").count() == stats.grubbs(none, "x").count() == stats.learned_threshold(none, "x", 50).count() == 0
    assert models.dbscan(none, "id", ["x"], 1.0).count() == optimize.pareto_front(none.withColumn("y", F.lit(1.0)), "id", {"x": "min", "y": "max"}).count() == 0
    assert isinstance(stats.correlation(none.withColumn("y", F.lit(1.0)), "x", "y").toPandas(), pd.DataFrame)


def test_exact_percentile_in_a_bracket(spark, monkeypatch):
    monkeypatch.setattr(stats, "FEW", 0)
    rows = spark.range(200_000).select((F.pmod(F.xxhash64("id"), F.lit(5000)) / 7).alias("x"))
    for share in (0.0, 0.3, 0.95, 1.0):
        want = rows.select(F.percentile("x", share)).first()[0]
        assert stats.exact_percentile(rows, F.col("x"), share).first() == (want, 200_000)
    assert stats.exact_percentile(rows.limit(0), F.col("x"), 0.5).first() == (None, 0)


def test_retractions_of_entities_and_values(spark):
    rows = [(1, "a", "x", 1, False), (1, "b", "y", 2, False), (1, None, None, 3, True), (1, "b", "z", 4, False), (2, "a", "x", 1, False), (2, "a", "no", 2, True), (3, "a", "x", 1, False), (3, "a", "x", 2, True)]
    facts = spark.createDataFrame([(e, a, v, dt.datetime(2024, 1, i), i, d) for e, a, v, i, d in rows], "entity long, attribute string, value string, at timestamp, seq long, deleted boolean")
    assert sorted((r.entity, r.attribute, r.value) for r in factlog.as_of(facts).collect()) == [(1, "b", "z"), (2, "a", "x")]
    got = sorted((r.entity, r.attribute, r.seq, r.kind) for r in factlog.changes(facts).collect())
    assert got == [(1, "a", 1, "assert"), (1, "a", 3, "retract"), (1, "b", 2, "assert"), (1, "b", 3, "retract"), (1, "b", 4, "assert"), (2, "a", 1, "assert"), (3, "a", 1, "assert"), (3, "a", 2, "retract")]


def test_trees_of_many_levels_and_cycles(spark):
    chain = spark.range(1, 3001).select(F.col("id").alias("name"), (F.col("id") - 1).alias("parent"))
    assert recursion.descendants(chain, "0").count() == 3001 and recursion.descendants(chain, "2990").count() == 11
    loop = spark.createDataFrame([("a", "b"), ("b", "a"), ("c", "a"), ("d", "e"), ("e", "d"), ("f", None)], "name string, parent string")
    assert sorted(r.name for r in recursion.descendants(loop, "a").collect()) == ["a", "b", "c"]
    assert sorted(r.name for r in recursion.descendants(loop, "f").collect()) == ["f"]
    both = spark.createDataFrame([("x", "p"), ("x", "q"), ("p", "r"), ("q", "s")], "name string, parent string")
    assert sorted(r.name for r in recursion.descendants(both, "s").collect()) == ["q", "s", "x"]


def test_rules_with_constants_and_repeated_variables(spark):
    edge = spark.createDataFrame([(1, 2), (2, 3), (3, 1), (4, 4), (None, 5)], "a long, b long")
    atom = lambda relation, *terms: recursion.Atom(relation, terms)
    rules = [
        recursion.Rule(atom("path", "x", "y"), (atom("edge", "x", "y"),)),
        recursion.Rule(atom("path", "x", "z"), (atom("path", "x", "y"), atom("path", "y", "z"))),
        recursion.Rule(atom("loop", "x"), (atom("path", "x", "x"),)),
        recursion.Rule(atom("from_two", "y"), (atom("path", F.lit(2), "y"),), F.col("y") > 1),
    ]
    found = recursion.solve(rules, {"edge": edge})
    assert found["path"].where("_0 is not null").count() == 10
    assert sorted(r[0] for r in found["loop"].collect()) == [1, 2, 3, 4] and sorted(r[0] for r in found["from_two"].collect()) == [2, 3]
