"""Answers of tools as facts, refreshed cells, and entities as nested documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.sources import factlog
from ruleweave.sources.entities import EntityView

LISTS = ("items", "results", "data")


def collect(answers: DataFrame, body: str, record_type: str, tag: str | None = None) -> DataFrame:
    """(entity, attribute, value) from JSON answers: a list of items, or one under `items`, `results` or `data`, or one object.

    An item's id is its `id`, else its place from 1. Only scalars become facts; every item gets a `type`, and a `tag` if
    one is given. An answer that isn't JSON has no items. Parsing and exploding are Spark's own functions.
    """
    text = F.ltrim(F.col(body))
    held = [F.get_json_object(text, f"$.{name}") for name in LISTS]
    listed = F.coalesce(*[F.when(h.startswith("["), h) for h in held], F.concat(F.lit("["), text, F.lit("]")))
    items = F.from_json(F.when(text.startswith("["), text).otherwise(listed), "array<map<string,string>>")
    rows = answers.select(F.posexplode(items).alias("place", "item")).where("item is not null")
    entity = F.coalesce(F.try_element_at("item", F.lit("id")).try_cast("bigint"), F.col("place") + 1).alias("entity")
    more = {"type": record_type} | ({"tag": tag} if tag else {})
    own = F.map_filter("item", lambda k, v: (k != "id") & v.isNotNull() & ~v.startswith("{") & ~v.startswith("["))
    cells = F.map_concat(own, F.create_map(*[F.lit(x) for kv in more.items() for x in kv]))
    return rows.select(entity, F.explode(cells).alias("attribute", "value"))


def refresh(facts: DataFrame, answers: DataFrame, now: Column, limit: Column, attribute: str) -> DataFrame:
    """facts with the answers (entity, value) appended for entities whose attribute is missing or older than the limit."""
    fresh = factlog.last_written(facts).where((F.col("attribute") == attribute) & (F.col("last_written") >= now - limit)).select("entity")
    seq = F.lit((1 << 62)).cast("bigint")
    new = answers.join(fresh, "entity", "left_anti").where("value is not null")
    return facts.unionByName(new.select("entity", F.lit(attribute).alias("attribute"), F.col("value").cast("string"), now.alias("at"), seq.alias("seq"), F.lit(False).alias("deleted")))


def pull(view: EntityView, attributes: list[str], nested: dict[str, tuple[DataFrame, str, list[str], list[str]]] | None = None) -> DataFrame:
    """(id, document): an entity as JSON, with lists of its children (table, key, attributes, order) under their names.

    Missing attributes are left out of the document; a child table is grouped by its key before it meets the entities.
    """
    out, parts = view.df, [view.column(a).alias(a) for a in [view.id, *attributes]]
    for name, (children, key, columns, order) in (nested or {}).items():
        child = F.transform(F.array_sort(F.collect_list(F.struct(F.struct(*order).alias("o"), F.struct(*columns).alias("c")))), lambda x: x["c"])
        own = children.groupBy(F.col(key).alias("child_key")).agg(child.alias(name))
        out = out.join(own, view.column(view.id) == F.col("child_key"), "left").drop("child_key")
        parts.append(F.col(name))
    return out.select(view.id, F.to_json(F.struct(*parts)).alias("document"))
