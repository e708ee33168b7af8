"""What follows from matched rules: actions, overrides, constraints, state steps, recommendations, decisions."""

from __future__ import annotations

from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.functions.conditions import Condition
from ruleweave.functions.scalars import template
from ruleweave.sources.entities import EntityView

PRIORITY = {"LOW": 1, "MEDIUM": 2, "HIGH": 3, "CRITICAL": 4}
SEVERITY = {"warn": 1, "quarantine": 2, "reject": 3}


@dataclass(frozen=True)
class Rule:
    """A named condition with an action; strict rules can't be overridden."""

    name: str
    when: Condition
    verb: str = "flag"
    arguments: dict[str, str] = field(default_factory=dict)
    priority: str = "MEDIUM"
    overrides: tuple[str, ...] = ()
    strict: bool = False


def matched(view: EntityView, rules: list[Rule]) -> DataFrame:
    """(entity, rule, verb, arguments, priority, overrides, strict) for every rule that an entity meets: one pass over the rows."""
    by_name = {r.name: r for r in rules}
    for r in rules:
        for target in r.overrides:
            if target not in by_name:
                raise ValueError(f"{r.name} overrides {target}, which doesn't exist")
            if by_name[target].strict:
                raise ValueError(f"{r.name} overrides {target}, which is strict")
    columns = {c: view.column(c) for c in view.df.columns}
    arguments = lambda r: F.map_from_arrays(F.array(*[F.lit(k) for k in r.arguments]).cast("array<string>"), F.array(*[template(v, columns) for v in r.arguments.values()]).cast("array<string>"))
    entry = lambda r: F.struct(F.lit(r.name).alias("rule"), F.lit(r.verb).alias("verb"), arguments(r).alias("arguments"), F.lit(PRIORITY[r.priority]).alias("priority"), F.array(*[F.lit(t) for t in r.overrides]).cast("array<string>").alias("overrides"), F.lit(r.strict).alias("strict"))
    hits = F.array_compact(F.array(*[F.when(r.when.on(view), entry(r)) for r in rules]))
    return view.df.select(F.col(view.id).alias("entity"), F.explode(hits).alias("m")).select("entity", "m.*")


def resolve(hits: DataFrame, rules: list[Rule]) -> DataFrame:
    """hits without the defeated ones.

    Rules linked by an override compete, for each entity, with the others of their group that it meets: strict ones
    stay, overridden ones go, and of the rest those of the highest priority stay, ties together. Rules without links
    stay. All an entity's matched rules lie in one row's arrays, so this is one aggregate on the entity.
    """
    group = {r.name: r.name for r in rules}
    for _ in rules:
        for r in rules:
            for t in r.overrides:
                low = min(group[r.name], group[t])
                group[r.name] = group[t] = low
    linked = {r.name for r in rules if r.overrides} | {t for r in rules for t in r.overrides}
    of = F.create_map(*[F.lit(x) for name, g in group.items() for x in (name, g if name in linked else f"={name}")])
    per = hits.withColumn("group", F.element_at(of, F.col("rule"))).groupBy("entity", "group").agg(F.collect_list(F.struct(*hits.columns[1:])).alias("all"))
    beaten = F.flatten(F.transform("all", lambda m: m["overrides"]))
    left = F.filter("all", lambda m: ~F.array_contains(beaten, m["rule"]) | m["strict"])
    best = F.array_max(F.transform(F.filter(left, lambda m: ~m["strict"]), lambda m: m["priority"]))
    stay = F.filter(left, lambda m: m["strict"] | (m["priority"] == best))
    return per.select("entity", F.explode(stay).alias("m")).select("entity", "m.*")


@dataclass(frozen=True)
class Judgement:
    """What a rule says of an event such as `before deploy`: it blocks, allows, or requires something, with a reason."""

    name: str
    when: Condition
    decision: str  # block, requires or allow
    reason: str = ""
    event: str = ""


def judge(view: EntityView, rules: list[Judgement], default: str = "allow") -> DataFrame:
    """(entity, decision, reasons): block before requires before allow, with the reasons of the rules of that decision."""
    columns = {c: view.column(c) for c in view.df.columns}
    held = F.array_compact(F.array(*[F.when(r.when.on(view), F.struct(F.lit(r.decision).alias("d"), template(r.reason, columns).alias("r"))) for r in rules]))
    chosen = F.coalesce(*[F.when(F.array_contains("held.d", d), F.lit(d)) for d in ("block", "requires", "allow")], F.lit(default))
    rows = view.df.select(F.col(view.id).alias("entity"), held.alias("held")).withColumn("decision", chosen)
    return rows.select("entity", "decision", F.transform(F.filter("held", lambda x: x["d"] == F.col("decision")), lambda x: x["r"]).alias("reasons"))


def verdicts(view: EntityView, constraints: list[tuple[str, Condition, str]]) -> DataFrame:
    """(entity, verdict, violated): the most severe of the violated constraints' severities, or accept."""
    failed = [(name, F.when(~must.on(view), F.lit(name)), severity) for name, must, severity in constraints]
    level = F.greatest(*[F.when(f.isNotNull(), F.lit(SEVERITY[s])).otherwise(F.lit(0)) for _, f, s in failed], F.lit(0))
    verdict = reduce(lambda out, kv: out.when(level == kv[1], F.lit(kv[0])), SEVERITY.items(), F.when(level == 0, F.lit("accept")))
    return view.df.select(F.col(view.id).alias("entity"), verdict.alias("verdict"), F.array_compact(F.array(*[f for _, f, _ in failed])).alias("violated"))


def state_step(view: EntityView, state: str, transitions: list[tuple[str, str, Condition]], invariants: dict[str, Condition] | None = None) -> DataFrame:
    """(entity, before, after, violations): one step of a state machine.

    The first transition, in order, whose source is the state or a parent of it (`a` of `a/b`) and whose guard holds is
    taken. Invariants are checked on the row as it was.
    """
    now = view.column(state)
    after = F.coalesce(*[F.when(F.coalesce((now == src) | now.startswith(src + "/"), F.lit(False)) & guard.on(view), F.lit(dst)) for src, dst, guard in transitions], now)
    broken = F.array_compact(F.array(*[F.when(~c.on(view), F.lit(name)) for name, c in (invariants or {}).items()]).cast("array<string>"))
    return view.df.select(F.col(view.id).alias("entity"), now.alias("before"), after.alias("after"), broken.alias("violations"))


def posterior(feedback: DataFrame, key: str, accepted: Column, rejected: Column, prior: float) -> DataFrame:
    """(key, accepts, rejects, probability): (prior + accepts) / (1 + accepts + rejects), held between 0.01 and 0.99."""
    one = lambda c: F.sum(F.when(F.coalesce(c, F.lit(False)), 1).otherwise(0))
    n = feedback.groupBy(key).agg(one(accepted).alias("accepts"), one(rejected).alias("rejects"))
    p = (F.lit(prior) + F.col("accepts")) / (1 + F.col("accepts") + F.col("rejects"))
    return n.withColumn("probability", F.greatest(F.lit(0.01), F.least(F.lit(0.99), p)))


def gate(df: DataFrame, id_col: str, block: str, probability: Column, seed: int = 42) -> DataFrame:
    """Rows that a seeded draw lets through: the same rows on every run and however the rows are dealt."""
    draw = F.pmod(F.xxhash64(F.lit(block), F.lit(seed), F.col(id_col)), F.lit(1 << 30)) / float(1 << 30)
    return df.where(draw < probability)


def decisions(hits: DataFrame, text: str, source: str = "rules") -> DataFrame:
    """(block, entity, action, why, priority, source): flat rows for an audit file."""
    named = {"entity": F.col("entity"), "rule": F.col("rule"), "verb": F.col("verb")}
    names = F.create_map(*[F.lit(x) for k, v in PRIORITY.items() for x in (v, k)])
    return hits.select(F.col("rule").alias("block"), "entity", template(text, named).alias("action"), F.concat(F.lit("rule "), F.col("rule"), F.lit(" holds")).alias("why"), F.element_at(names, F.col("priority")).alias("priority"), F.lit(source).alias("source"))
