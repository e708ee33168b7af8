"""Streams of facts: change feeds with state, reactive rules, windows with watermarks."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

CHANGE = "entity {id}, attribute string, kind string, value string, prev string, at timestamp, seq long"


@dataclass(frozen=True)
class On:
    """A reactive rule: a kind of event on an attribute (None: any), the value it goes to, and a further test of the event."""

    name: str
    kind: str
    attribute: str | None = None
    to: str | None = None
    when: Column | None = None


def change_feed(facts: DataFrame, ttl: str | None = None) -> DataFrame:
    """Assert, change and retract events of a stream of facts (entity, attribute, value, at, seq, deleted).

    The state of an entity is the last value of each of its cells; within a micro-batch its facts are taken in the order (at, seq).
    A fact that repeats the value gives no event, the retraction of the entity one for each cell, that of a cell with a
    value one where the cell has just that value. With a ttl, entities that get no fact for so long are forgotten.
    """
    kind = facts.schema["entity"].dataType.simpleString()
    columns = ["entity", "attribute", "kind", "value", "prev", "at", "seq"]

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        if state.hasTimedOut:
            state.remove()
            return
        held = dict(zip(*state.get, strict=True)) if state.exists else {}
        out = []
        for row in pd.concat(list(frames)).sort_values(["at", "seq"], kind="stable").itertuples(index=False):
            name, there = row.attribute, row.attribute in held
            if row.deleted:
                gone = sorted(held) if name is None else [name] if there and row.value in (None, held[name]) else []
                out += [(*key, cell, "retract", None, held.pop(cell), row.at, row.seq) for cell in gone]
            elif not there or row.value != held[name]:
                out.append((*key, name, "change" if there else "assert", row.value, held.get(name), row.at, row.seq))
                held[name] = row.value
        if held:
            state.update((list(held), list(held.values())))
            if ttl:
                state.setTimeoutDuration(ttl)
        elif state.exists:
            state.remove()
        if out:
            yield pd.DataFrame(out, columns=columns)

    timeout = GroupStateTimeout.ProcessingTimeTimeout if ttl else GroupStateTimeout.NoTimeout
    rows = facts.select("entity", "attribute", "value", "at", "seq", "deleted")
    return rows.groupBy("entity").applyInPandasWithState(step, CHANGE.format(id=kind), "names array<string>, held array<string>", "append", timeout)


def dispatch(changes: DataFrame, rules: list[On]) -> DataFrame:
    """Every event with the name of each rule it fires: one pass with an array of the rules that hold, batch or stream."""

    def holds(rule: On) -> Column:
        test = F.col("kind") == rule.kind
        test = test if rule.attribute is None else test & (F.col("attribute") == rule.attribute)
        test = test if rule.to is None else test & (F.col("value") == rule.to)
        return F.coalesce(test if rule.when is None else test & rule.when, F.lit(False))

    return changes.withColumn("rule", F.explode(F.array_compact(F.array(*[F.when(holds(x), F.lit(x.name)) for x in rules]))))


def fire(changes: DataFrame, rules: list[On], act: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """Starts a stream that hands each micro-batch's firings to `act`, with the batch's number for idempotent writes."""
    return dispatch(changes, rules).writeStream.foreachBatch(act).option("checkpointLocation", checkpoint).start()


def windowed(events: DataFrame, at: str, length: str, by: list[str], slide: str | None = None, value: str | None = None, late: str | None = None) -> DataFrame:
    """Counts (and sums of a value) by tumbling or sliding windows; `late` sets the watermark of a stream."""
    rows = events.withWatermark(at, late) if late else events
    sums = [F.sum(value).alias("total")] if value else []
    out = rows.groupBy(*by, F.window(at, length, slide or length)).agg(F.count(F.lit(1)).alias("n"), *sums)
    return out.select(*by, F.col("window.start").alias("start"), F.col("window.end").alias("end"), *[c for c in out.columns if c in ("n", "total")])


def sessions(events: DataFrame, at: str, gap: str, by: list[str], late: str | None = None) -> DataFrame:
    """Runs of events with less than the gap between neighbours."""
    rows = events.withWatermark(at, late) if late else events
    out = rows.groupBy(*by, F.session_window(at, gap)).agg(F.count(F.lit(1)).alias("n"))
    return out.select(*by, F.col("session_window.start").alias("start"), F.col("session_window.end").alias("end"), "n")


def bursts(events: DataFrame, at: str, n: int, within: str, slide: str, by: list[str], late: str) -> DataFrame:
    """Groups with n or more events in a sliding window, on a stream."""
    return windowed(events, at, within, by, slide, late=late).where(F.col("n") >= n)
