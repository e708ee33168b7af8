"""Streams give what the same rows give in a batch."""

import datetime as dt

from pyspark.sql import functions as F

from ruleweave.sources import factlog
from ruleweave.streaming import feed

SCHEMA = "entity long, attribute string, value string, at timestamp, seq long, deleted boolean"


def rows():
    t0 = dt.datetime(2024, 1, 1)
    values = ["a", "a", "b", None, "b", "c"]
    return [(k, "s", v, t0 + dt.timedelta(hours=i), i * 10 + k, v is None) for k in range(4) for i, v in enumerate(values)]


def source(spark, tmp_path, data, parts=3):
    """A stream of files, one micro-batch each, in the order of the log."""
    for i in range(parts):
        part = [r for r in data if r[4] // 10 % 6 * parts // 6 == i]
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    return spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def test_change_feed_equals_the_batch(spark, tmp_path):
    stream = feed.change_feed(source(spark, tmp_path, rows()))
    query = stream.writeStream.format("memory").queryName("changes").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.entity, r.kind, r.value, r.prev, r.seq)
    got = sorted(map(key, spark.table("changes").collect()), key=str)
    want = sorted(map(key, factlog.changes(spark.createDataFrame(rows(), SCHEMA)).collect()), key=str)
    assert got == want and len(got) == 20


def test_reactive_rules_fire_in_batches(spark, tmp_path):
    stream = feed.change_feed(source(spark, tmp_path, rows()))
    fired = []
    rules = [feed.On("to c", "change", "s", to="c"), feed.On("gone", "retract"), feed.On("never", "change", "other")]
    act = lambda df, n: fired.extend((r.entity, r.rule) for r in df.collect())
    query = feed.dispatch(stream, rules).writeStream.foreachBatch(act).option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted(fired) == sorted([(k, rule) for k in range(4) for rule in ("to c", "gone")])


def test_windows_with_a_watermark(spark, tmp_path):
    out = feed.windowed(source(spark, tmp_path, rows()), "at", "2 hours", ["attribute"], late="1 hour")
    query = out.writeStream.format("memory").queryName("windows").outputMode("complete").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    assert sorted((r.start.hour, r.n) for r in spark.table("windows").collect()) == [(0, 8), (2, 8), (4, 8)]
    batch = spark.createDataFrame(rows(), SCHEMA)
    assert feed.sessions(batch, "at", "90 minutes", ["entity"]).agg(F.max("n")).first()[0] == 6
    assert feed.windowed(batch, "at", "4 hours", ["entity"], slide="2 hours").where("n >= 4").count() == 8


def test_entity_retractions_on_a_stream(spark, tmp_path):
    t0 = dt.datetime(2024, 1, 1)
    data = [(1, "a", "x", t0, 0, False), (1, "b", "y", t0, 10, False), (1, None, None, t0, 20, True), (1, "a", "x", t0, 30, False), (2, "a", "x", t0, 40, False), (2, "a", "no", t0, 50, True)]
    stream = feed.change_feed(source(spark, tmp_path, data))
    query = stream.writeStream.format("memory").queryName("gone").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    query.awaitTermination(120)
    key = lambda r: (r.entity, r.attribute, r.kind, r.value, r.prev, r.seq)
    got = sorted(map(key, spark.table("gone").collect()), key=str)
    assert got == sorted(map(key, factlog.changes(spark.createDataFrame(data, SCHEMA)).collect()), key=str) and len(got) == 6
