"""Ordered events of an entity: chains within a window, bursts, state changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.conditions import DAYS


def seconds(c: Column) -> Column:
    return c.cast("timestamp").cast("double")


def event_sequence(events: DataFrame, entity: str, at: str, seq: str, name: str, chain: list[str], within: float = 0, unit: str = "days") -> DataFrame:
    """(entity, started, ended): entities with the chain of names in order, first to last within the window (0: any time).

    started and ended belong to the chain that ends first. One fold over the entity's events that are part of the chain,
    in the order (at, seq): for every step it keeps the latest start of a chain that has come that far, which is
    all that a later step needs. The events of one entity are gathered, those of no interest before that left out.
    """
    limit = within * DAYS.get(unit, 1) * 86400
    k = len(chain)
    state = f"struct<{','.join(f's{i}:double' for i in range(k))},a:double,b:double>"
    rows = events.where(F.col(name).isin(*chain)).groupBy(entity).agg(F.array_sort(F.collect_list(F.struct(seconds(F.col(at)).alias("at"), F.col(seq).alias("seq"), F.col(name).alias("name")))).alias("e"))
    empty = F.struct(*[F.lit(None).cast("double").alias(f"s{i}") for i in range(k)], F.lit(None).cast("double").alias("a"), F.lit(None).cast("double").alias("b")).cast(state)

    def step(s: Column, e: Column) -> Column:
        new = []
        for i in range(k):
            reached = e["at"] if i == 0 else s[f"s{i - 1}"]
            live = F.lit(True) if not limit or i == 0 else e["at"] - reached <= limit
            # A later start is always at least as good: what fits an earlier one fits it too.
            new.append(F.when((e["name"] == chain[i]) & reached.isNotNull() & live, F.greatest(reached, s[f"s{i}"]) if i else reached).otherwise(s[f"s{i}"]))
        done = s["a"].isNull() & new[-1].isNotNull()
        return F.struct(*[c.alias(f"s{i}") for i, c in enumerate(new)], F.when(done, new[-1]).otherwise(s["a"]).alias("a"), F.when(done, e["at"]).otherwise(s["b"]).alias("b")).cast(state)

    folded = rows.select(entity, F.aggregate("e", empty, step).alias("f"))
    return folded.where("f.a is not null").select(entity, F.timestamp_seconds("f.a").alias("started"), F.timestamp_seconds("f.b").alias("ended"))


def burst(events: DataFrame, by: list[str], at: str, n: int, within: float, unit: str = "days") -> DataFrame:
    """(by, most): groups with n or more records within some window of the length given, and the most in one."""
    limit = within * DAYS.get(unit, 1) * 86400
    frame = W.partitionBy(*by).orderBy("t").rangeBetween(-int(limit), 0)
    rows = events.select(*by, seconds(F.col(at)).cast("bigint").alias("t")).withColumn("n", F.count(F.lit(1)).over(frame))
    return rows.groupBy(*by).agg(F.max("n").alias("most")).where(F.col("most") >= n)


def changed_to(rows: DataFrame, by: list[str], order: list[str], state: str, value: str) -> DataFrame:
    """Rows at which a group's state becomes the value, having been another."""
    before = F.lag(state).over(W.partitionBy(*by).orderBy(*order))
    return rows.withColumn("was", before).where((F.col(state) == value) & (F.col("was") != value))


def has_record(parents: DataFrame, records: DataFrame, on: str, condition: Column | None = None, negate: bool = False) -> DataFrame:
    """Parents with a record (that meets a condition), or without any."""
    found = records if condition is None else records.where(condition)
    return parents.join(found.select(on).distinct(), on, "left_anti" if negate else "left_semi")
