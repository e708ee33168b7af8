"""An append-only log of facts: history, snapshots, freshness and changes."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

#: (entity, attribute, value, at, seq, deleted). seq orders rows of one instant; a deleted row without attribute retracts the entity.
COLUMNS = ["entity", "attribute", "value", "at", "seq", "deleted"]


def log(rows: DataFrame, entity: str, attribute: str | Column, value: str, at: str, seq: str) -> DataFrame:
    """Asserted facts from the rows of a table."""
    name = F.lit(attribute) if isinstance(attribute, str) else attribute
    return rows.select(F.col(entity).alias("entity"), name.alias("attribute"), F.col(value).cast("string").alias("value"), F.col(at).alias("at"), F.col(seq).alias("seq"), F.lit(False).alias("deleted"))


def retract(rows: DataFrame, entity: str, at: str, seq: str, attribute: str | None = None, value: str | None = None) -> DataFrame:
    """Tombstones for an attribute, or without one for all attributes of the entities; with a column `value` only where the cell has just
    this value."""
    text = F.lit(None) if value is None else F.col(value)
    return rows.select(F.col(entity).alias("entity"), F.lit(attribute).cast("string").alias("attribute"), text.cast("string").alias("value"), F.col(at).alias("at"), F.col(seq).alias("seq"), F.lit(True).alias("deleted"))


def expand_retractions(facts: DataFrame) -> DataFrame:
    """Tombstones of whole entities become one for each attribute the entity ever had."""
    whole = facts.where("deleted and attribute is null").drop("attribute")
    cells = facts.where("attribute is not null").select("entity", "attribute").distinct()
    return facts.where("attribute is not null").unionByName(whole.join(cells, "entity").select(COLUMNS))


def as_of(facts: DataFrame, moment: Column | None = None) -> DataFrame:
    """(entity, attribute, value, at): the last value of each cell up to a moment; retracted cells are absent.

    Of rows with one instant the last appended counts. Retractions are of an entity, of a cell, or of a cell with a value; each
    kind is an aggregate of its own that meets the cells.
    """
    known = facts if moment is None else facts.where(F.col("at") <= moment)
    order = F.struct("at", "seq")
    last = known.where("not deleted").groupBy("entity", "attribute").agg(F.max_by("value", order).alias("value"), F.max(order).alias("o"))
    cells = known.where("deleted and attribute is not null and value is null").groupBy("entity", "attribute").agg(F.max(order).alias("cell"))
    exact = known.where("deleted and attribute is not null and value is not null").groupBy("entity", "attribute", "value").agg(F.max(order).alias("exact"))
    whole = known.where("deleted and attribute is null").groupBy("entity").agg(F.max(order).alias("whole"))
    met = last.join(cells, ["entity", "attribute"], "left").join(exact, ["entity", "attribute", "value"], "left").join(whole, "entity", "left")
    gone = F.greatest("cell", "exact", "whole")
    return met.where(gone.isNull() | (F.col("o") > gone)).select("entity", "attribute", "value", F.col("o.at").alias("at"))


def last_written(facts: DataFrame) -> DataFrame:
    """(entity, attribute, last_written): the last assertion of each cell that isn't retracted, also of an equal value."""
    return as_of(facts).select("entity", "attribute", F.col("at").alias("last_written"))


def changes(facts: DataFrame) -> DataFrame:
    """(entity, attribute, kind, value, prev, at, seq): assert, change and retract events; an unchanged value is no event.

    An entity's retraction is an event of each of its cells; one of a cell with a value counts only where the cell has that value.
    """
    order = W.partitionBy("entity", "attribute").orderBy("at", "seq")
    facts = expand_retractions(facts)
    asserted = F.last(F.when(~F.col("deleted"), F.struct("value")), ignorenulls=True).over(order.rowsBetween(W.unboundedPreceding, -1))
    facts = facts.withColumn("asserted", asserted).where(~F.col("deleted") | F.col("value").isNull() | F.col("value").eqNullSafe(F.col("asserted.value"))).drop("asserted")
    facts = facts.withColumn("value", F.when(~F.col("deleted"), F.col("value")))
    before = F.lag(F.struct("value", "deleted")).over(order)
    rows = facts.withColumn("b", before).withColumn("prev", F.when(F.col("b").isNotNull() & ~F.col("b.deleted"), F.col("b.value")))
    fresh = F.col("b").isNull() | F.col("b.deleted")
    kind = F.when(F.col("deleted") & ~fresh, "retract").when(~F.col("deleted") & fresh, "assert").when(~F.col("deleted") & ~F.col("value").eqNullSafe(F.col("prev")), "change")
    return rows.withColumn("kind", kind).where("kind is not null").select("entity", "attribute", "kind", "value", "prev", "at", "seq")


def versions(facts: DataFrame) -> DataFrame:
    """(entity, attribute, value, valid_from, valid_to): the history of every cell as periods."""
    order = W.partitionBy("entity", "attribute").orderBy("at", "seq")
    return changes(facts).withColumn("valid_to", F.lead("at").over(order)).where("kind <> 'retract'").select("entity", "attribute", "value", F.col("at").alias("valid_from"), "valid_to")


def was(view_ids: DataFrame, facts: DataFrame, moment: Column, condition: Column) -> DataFrame:
    """Rows of view_ids (column id) whose facts met a condition on attribute and value at a past moment."""
    return view_ids.join(as_of(facts, moment).where(condition).select(F.col("entity").alias("id")).distinct(), "id", "left_semi")


def stale(facts: DataFrame, now: Column, limit: Column) -> DataFrame:
    """Cells that were last written longer than `limit` before `now`."""
    return last_written(facts).where(F.col("last_written") < now - limit)
