"""Detections: the order in which selection, history, statistics, scalars and labels narrow a population."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame

from ruleweave.functions.conditions import Condition
from ruleweave.functions.scalars import template
from ruleweave.operators.aggregates import with_scalars
from ruleweave.sources.entities import EntityView


@dataclass
class Detect:
    """A named detection. Steps run in the order: selector, sequences and past states (semi-joins on the id), statistics on what
    is left, scalars with their gate, label. Each is a lazy DataFrame step; nothing is collected."""

    name: str
    when: Condition
    matching: list[DataFrame] = field(default_factory=list)  # tables of ids
    statistics: list[Callable[[DataFrame], DataFrame]] = field(default_factory=list)
    scalars: list[DataFrame] = field(default_factory=list)
    having: Column | None = None
    label: str | None = None

    def run(self, view: EntityView) -> DataFrame:
        out = self.when.rows(view)
        for ids in self.matching:
            out = out.join(ids.select(ids.columns[0]).withColumnRenamed(ids.columns[0], view.id).distinct(), view.id, "left_semi")
        for narrow in self.statistics:
            out = narrow(out)
            out = out.where("flagged").drop("flagged") if "flagged" in out.columns else out
        out = with_scalars(out, *self.scalars)
        if self.having is not None:
            out = out.where(self.having)
        if self.label is not None:
            out = out.withColumn("label", template(self.label, {c: out[c] for c in out.columns}))
        return out
