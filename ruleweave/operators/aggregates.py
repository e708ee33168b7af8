"""Aggregates over selected entities: scalars for later conditions, groups and weighted averages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.functions.conditions import Condition
from ruleweave.sources.entities import EntityView


def select(view: EntityView, condition: Condition, *columns: str) -> DataFrame:
    """Rows that meet a condition: the id and the columns named."""
    return condition.rows(view).select(view.id, *columns)


def number(name: str) -> Column:
    return F.col(name).try_cast("double")


def aggregate(kind: str, name: str | None = None) -> Column:
    """count counts rows; sum and avg of nothing are 0; min and max of nothing are null; only numbers take part."""
    if kind == "count":
        return F.count(F.lit(1)).cast("double")
    x = number(name)
    return {
        "sum": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "total": lambda: F.coalesce(F.sum(x), F.lit(0.0)),
        "avg": lambda: F.coalesce(F.avg(x), F.lit(0.0)),
        "average": lambda: F.coalesce(F.avg(x), F.lit(0.0)),
        "min": lambda: F.min(x),
        "max": lambda: F.max(x),
    }[kind]()


def calculate(df: DataFrame, out: str, kind: str, name: str | None = None) -> DataFrame:
    """One row with one scalar."""
    return df.agg(aggregate(kind, name).alias(out))


def with_scalars(df: DataFrame, *scalars: DataFrame) -> DataFrame:
    """df with one-row tables beside every row; one row is all that is broadcast."""
    for s in scalars:
        df = df.crossJoin(F.broadcast(s))
    return df


def having(df: DataFrame, scalar: DataFrame, condition: Column) -> DataFrame:
    """All rows if the scalar meets the condition, else none."""
    return with_scalars(df, scalar).where(F.coalesce(condition, F.lit(False))).select(df.columns)


def group(df: DataFrame, keys: list[str], **aggregates: tuple[str, str | None]) -> DataFrame:
    return df.groupBy(*keys).agg(*[aggregate(kind, name).alias(out) for out, (kind, name) in aggregates.items()])


def weighted_moving_average(df: DataFrame, value: str, order: list[str], by: list[str], out: str = "wma") -> DataFrame:
    """Sum of i * x over sum of i, with i the row's place (from 1) in its group's order."""
    i = F.row_number().over(W.partitionBy(*by).orderBy(*order))
    rows = df.where(number(value).isNotNull()).withColumn("i", i)
    return rows.groupBy(*by).agg((F.sum(F.col("i") * number(value)) / F.sum("i")).alias(out))


def quantified(children: DataFrame, key: str, condition: Column, how: str) -> DataFrame:
    """(key) of the parents of whose children some, all or none meet a condition; childless parents aren't listed."""
    met = F.coalesce(condition, F.lit(False))
    test = {"some": F.bool_or(met), "all": F.bool_and(met), "none": ~F.bool_or(met)}[how]
    return children.groupBy(key).agg(test.alias("ok")).where("ok").select(key)
