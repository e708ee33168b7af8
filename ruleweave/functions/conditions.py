"""Conditions on entities with two-valued logic: what is missing is false, and its negation true."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.sources.entities import EntityView

#: Days of the units of durations; a month counts as 30 and a year as 365 days, an unknown unit as days.
DAYS = {"second": 1 / 86400, "seconds": 1 / 86400, "minute": 1 / 1440, "minutes": 1 / 1440, "hour": 1 / 24, "hours": 1 / 24, "day": 1, "days": 1, "week": 7, "weeks": 7, "month": 30, "months": 30, "year": 365, "years": 365}


@dataclass(frozen=True)
class Condition:
    """A yes-or-no test of a row. build gives a Column that is true where the test holds, and false or null elsewhere.

    That is all a filter needs, and it keeps comparisons bare, so that they reach the scan. on() makes null false, which
    negations and columns need.
    """

    build: Callable[[EntityView], Column]

    def on(self, view: EntityView) -> Column:
        return F.coalesce(self.build(view), F.lit(False))

    def rows(self, view: EntityView) -> DataFrame:
        """The view's rows that meet the test."""
        return view.df.where(self.build(view))

    def __and__(self, other: Condition) -> Condition:
        return Condition(lambda v: self.build(v) & other.build(v))

    def __or__(self, other: Condition) -> Condition:
        return Condition(lambda v: self.build(v) | other.build(v))

    def __invert__(self) -> Condition:
        return Condition(lambda v: ~self.on(v))


@dataclass(frozen=True)
class Expr:
    """A value of a row. plain says that it is an attribute or a literal, for which a missing value fails a comparison;
    in a computed value it is an evaluation error, which the view's policy decides."""

    build: Callable[[EntityView], Column]
    kind: Callable[[EntityView], str]
    plain: bool = False

    def _compare(self, other: object, op: Callable[[Column, Column], Column], ordered: bool) -> Condition:
        right = lift(other)

        def build(view: EntityView) -> Column:
            a, b = self.kind(view), right.kind(view)
            times = "time" in (a, b)
            if times:
                return op(F.to_date(self.build(view)), F.to_date(right.build(view)))
            if ordered and (a != "number" or b != "number"):
                return F.lit(False)
            if a != b:  # values of two kinds are never equal; unequal needs both
                here = self.build(view).isNotNull() & right.build(view).isNotNull()
                return here & F.lit(not op is _eq)
            x, y = self.build(view), right.build(view)
            if a == "number" and not (self.plain and right.plain):
                x, y = x.cast("double"), y.cast("double")
            result = op(x, y)
            if self.plain and right.plain:
                return result
            if view.on_error == "fail":
                return F.when(x.isNull() | y.isNull(), F.raise_error(F.lit("a condition can't be evaluated"))).otherwise(result)
            return F.coalesce(result, F.lit(view.on_error == "keep"))

        return Condition(build)

    def __eq__(self, other: object) -> Condition:  # type: ignore[override]
        return self._compare(other, _eq, False)

    def __ne__(self, other: object) -> Condition:  # type: ignore[override]
        return self._compare(other, lambda a, b: a != b, False)

    __hash__ = None  # type: ignore[assignment]

    def __lt__(self, other: object) -> Condition:
        return self._compare(other, lambda a, b: a < b, True)

    def __le__(self, other: object) -> Condition:
        return self._compare(other, lambda a, b: a <= b, True)

    def __gt__(self, other: object) -> Condition:
        return self._compare(other, lambda a, b: a > b, True)

    def __ge__(self, other: object) -> Condition:
        return self._compare(other, lambda a, b: a >= b, True)

    def _calculate(self, other: object, op: Callable[[Column, Column], Column]) -> Expr:
        right = lift(other)
        return Expr(lambda v: op(self.build(v).try_cast("double"), right.build(v).try_cast("double")), lambda v: "number")

    def __add__(self, other: object) -> Expr:
        return self._calculate(other, lambda a, b: a + b)

    def __sub__(self, other: object) -> Expr:
        return self._calculate(other, lambda a, b: a - b)

    def __mul__(self, other: object) -> Expr:
        return self._calculate(other, lambda a, b: a * b)

    def __truediv__(self, other: object) -> Expr:
        return self._calculate(other, F.try_divide)

    def __mod__(self, other: object) -> Expr:
        """Remainder of the operands without their fractions; it has the sign of the dividend."""
        return self._calculate(other, lambda a, b: F.try_mod(a.cast("bigint"), b.cast("bigint")).cast("double"))

    def __neg__(self) -> Expr:
        return Expr(lambda v: -self.build(v).try_cast("double"), lambda v: "number")

    def isin(self, *values: object) -> Condition:
        def build(view: EntityView) -> Column:
            kind = self.kind(view)
            own = [x for x in values if lift(x).kind(view) == kind]
            if self.plain and own and kind in ("string", "number"):
                return self.build(view).isin(*own)  # one comparison, which the scan can use
            return reduce(lambda a, b: a | b, [(self == x).build(view) for x in values], F.lit(False))

        return Condition(build)

    def notin(self, *values: object) -> Condition:
        return present(self) & ~self.isin(*values)

    def _text(self, test: Callable[[Column], Column]) -> Condition:
        """A test of a string, or of any element of a list of strings."""

        def build(view: EntityView) -> Column:
            kind = self.kind(view)
            if kind == "list":
                return F.exists(F.transform(self.build(view), lambda x: x.cast("string")), test)
            return test(self.build(view)) if kind == "string" else F.lit(False)

        return Condition(build)

    def contains(self, part: str) -> Condition:
        return self._text(lambda c: c.contains(part))

    def starts_with(self, part: str) -> Condition:
        return self._text(lambda c: c.startswith(part))

    def ends_with(self, part: str) -> Condition:
        return self._text(lambda c: c.endswith(part))

    def matches(self, query: str) -> Condition:
        """The query anywhere in the text, whatever the case; an empty query matches nothing."""
        return self._text(lambda c: F.contains(F.lower(c), F.lit(query.lower())) & F.lit(query != ""))

    def older_than(self, n: float, unit: str = "days") -> Condition:
        return Condition(lambda v: F.to_date(self.build(v)) < F.date_sub(today(v), _days(n, unit)))

    def newer_than(self, n: float, unit: str = "days") -> Condition:
        return Condition(lambda v: F.to_date(self.build(v)) > F.date_sub(today(v), _days(n, unit)))

    def approaching_within(self, n: float, unit: str = "days") -> Condition:
        return Condition(lambda v: F.to_date(self.build(v)).between(today(v), F.date_add(today(v), _days(n, unit))))


def _eq(a: Column, b: Column) -> Column:
    return a == b


def _days(n: float, unit: str) -> int:
    return int(n * DAYS.get(unit, 1))


def today(view: EntityView) -> Column:
    return F.to_date(F.lit(view.context["today"]))


def attr(name: str) -> Expr:
    """An attribute; one that the view doesn't have is missing on every row."""
    return Expr(lambda v: v.column(name) if v.has(name) else F.lit(None), lambda v: v.kind(name) if v.has(name) else "missing", True)


def context(name: str) -> Expr:
    """A value of the run."""
    return Expr(lambda v: F.lit(v.context.get(name)), lambda v: lift(v.context.get(name)).kind(v), True)


TODAY = Expr(today, lambda v: "time", True)


def lift(x: object) -> Expr:
    if isinstance(x, Expr):
        return x
    kind = "bool" if isinstance(x, bool) else "number" if isinstance(x, int | float) else "string" if isinstance(x, str) else "missing"
    return Expr(lambda v: F.lit(x), lambda v: kind, True)


def present(e: Expr | str) -> Condition:
    e = attr(e) if isinstance(e, str) else e
    return Condition(lambda v: e.build(v).isNotNull())


def full_text(query: str) -> Condition:
    """The query in any string attribute of the entity."""
    return Condition(lambda v: reduce(lambda a, b: a | b, [attr(c).matches(query).build(v) for c in v.strings()], F.lit(False)))


def derived(build: Callable[[], Condition]) -> Condition:
    """A named condition that others use: its body is built where it is used."""
    return Condition(lambda v: build().build(v))
