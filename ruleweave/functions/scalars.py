"""Scalar functions of rules over Columns or names, with their edge cases."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Unicode white space.
SPACE = "\t\n\x0b\x0c\r \x85\xa0                　"


def stringify(c: Column) -> Column:
    """A value as text: null is empty, a whole number has no fraction, whatever the column's type."""
    text = c.cast("string")
    number = text.try_cast("double")
    whole = F.typeof(c).rlike("^(double|float|decimal)") & (number == F.floor(number)) & (F.abs(number) < F.lit(1e15))
    return F.coalesce(F.when(whole, number.cast("decimal(20,0)").cast("string")).otherwise(text), F.lit(""))


def trim(c: Column) -> Column:
    return F.btrim(c, F.lit(SPACE))


def substring(c: Column, start: int, length: int | None = None) -> Column:
    """From a 0-based start, in code points; what lies outside is cut off."""
    start = max(start, 0)
    return F.substring(c, start + 1, 2147483647 if length is None else max(length, 0))


def replace(c: Column, search: str, by: str) -> Column:
    """All occurrences; an empty search stands between all characters and at both ends."""
    if search == "":
        return F.concat(F.lit(by), F.array_join(F.transform(F.split(c, ""), lambda x: F.concat(x, F.lit(by))), ""))
    return F.replace(c, F.lit(search), F.lit(by))


def concat(*parts: Column) -> Column:
    return F.concat(*[stringify(p) for p in parts])


def split(c: Column, separator: str) -> Column:
    return F.split(c, "\\Q" + separator + "\\E") if separator else F.split(c, "")


def length(c: Column, is_list: bool = False) -> Column:
    return (F.size(c) if is_list else F.char_length(c)).cast("double")


def days_until(c: Column, today: Column) -> Column:
    """Calendar days from today, at least 0."""
    return F.greatest(F.datediff(F.to_date(c), today), F.lit(0))


def days_since(c: Column, today: Column) -> Column:
    return F.greatest(F.datediff(today, F.to_date(c)), F.lit(0))


def path(c: Column, where: str, kind: str = "string") -> Column:
    """A value inside a JSON text by a dotted path with list positions (`a.b.0.c`); null beyond the end."""
    steps = "".join(f"[{s}]" if s.isdigit() else f".{s}" for s in where.split("."))
    return F.try_variant_get(F.try_parse_json(c), f"${steps}", kind)


def template(text: str, values: dict[str, Column]) -> Column:
    """`{name}` in the text replaced by values; unknown names stay as they are."""
    out: list[Column] = []
    rest = text
    while "{" in rest and "}" in rest.split("{", 1)[1]:
        before, rest = rest.split("{", 1)
        name, rest = rest.split("}", 1)
        out += [F.lit(before), stringify(values[name]) if name in values else F.lit("{" + name + "}")]
    return F.concat(*out, F.lit(rest))
