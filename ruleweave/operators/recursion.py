"""Recursive rules: closures over edges, and negation under the well-founded semantics."""

from __future__ import annotations

import uuid
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ruleweave.session import shared_dir


def cut(df: DataFrame, lean: bool = False) -> DataFrame:
    """df as a table in the folder that all executors share, read again: its lineage ends there. A lean one is packed more
    closely, and the shuffle files of its making are removed at once."""
    spark, key = df.sparkSession, "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    path, before = f"{shared_dir(spark)}/ruleweave/round-{uuid.uuid4().hex}", spark.conf.get(key, None)
    if lean:
        spark.conf.set(key, "true")
    try:
        df.write.parquet(path, compression="zstd" if lean else None)
    finally:
        if lean:
            spark.conf.unset(key) if before is None else spark.conf.set(key, before)
    return spark.read.schema(df.schema).parquet(path)


def drop(table: DataFrame) -> None:
    """Deletes a table made by cut() that nothing reads any more."""
    spark = table.sparkSession
    for name in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
        path = spark._jvm.org.apache.hadoop.fs.Path(name)
        if "/ruleweave/round-" in name:
            path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt over all shuffle partitions: for small rows that cost much work each, which would else share few tasks."""
    spark = df.sparkSession
    return df.repartition(max(int(spark.conf.get("spark.sql.shuffle.partitions")), spark.sparkContext.defaultParallelism), *keys)


def reachable(edges: DataFrame, seeds: DataFrame, src: str = "src", dst: str = "dst", guard: Column | None = None) -> DataFrame:
    """(seed, node): every node that a seed reaches over edges that meet the guard; the seed itself only over a cycle.

    Semi-naive: each round joins only the pairs that the last one found, and the rounds end when one finds none.
    """
    steps = (edges if guard is None else edges.where(guard)).select(F.col(src).alias("s"), F.col(dst).alias("t")).where("s is not null and t is not null").distinct()
    fresh = cut(seeds.select(F.col(seeds.columns[0]).alias("seed")).distinct().join(steps, F.col("seed") == F.col("s")).select("seed", F.col("t").alias("node")).distinct())
    parts = [fresh]
    while not fresh.isEmpty():
        found = fresh.join(steps, F.col("node") == F.col("s")).select("seed", F.col("t").alias("node")).distinct()
        for old in parts:
            found = found.join(old, ["seed", "node"], "left_anti")
        fresh = cut(found)
        parts.append(fresh)
        if len(parts) > 8:
            parts = [cut(_union(parts[:-1])), fresh]
    return _union(parts)


def _union(parts: list[DataFrame]) -> DataFrame:
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def descendants(tree: DataFrame, root: str, name: str = "name", parent: str = "parent") -> DataFrame:
    """(name) of a root and all that lies below it in a table of parents; cycles do no harm.

    Pointers to parents are doubled each round, so a chain of n levels takes about log2(n) rounds.
    """
    pointers = tree.select(F.col(name).cast("string").alias("name"), F.col(parent).cast("string").alias("up")).where("name is not null and up is not null").distinct()
    below = cut(tree.sparkSession.createDataFrame([(root,)], "name string"))
    pointers = cut(pointers.where(F.col("name") != root))
    nodes, reach = pointers.select("name").distinct().count(), 1
    while not pointers.isEmpty():
        hit = cut(pointers.join(below.withColumnRenamed("name", "up"), "up", "left_semi").select("name").distinct())
        if reach > nodes and hit.isEmpty():  # every way without a cycle has been looked at
            break
        below = cut(below.unionByName(hit).distinct())
        # What is known to lie below needs no pointers; those that lead there stay for the next round.
        open_ones = pointers.join(hit, "name", "left_anti")
        over = open_ones.select(F.col("name").alias("up"), F.col("up").alias("top"))
        further = open_ones.join(over, "up").select("name", F.col("top").alias("up"))
        arrived = open_ones.join(hit.withColumnRenamed("name", "up"), "up", "left_semi").select("name", "up")
        pointers = cut(further.unionByName(arrived).distinct())
        reach *= 2
    return below


def in_category(entities: DataFrame, category: str, tree: DataFrame, root: str, negate: bool = False) -> DataFrame:
    """Entities whose category lies (or doesn't lie) in a subtree; one without a category is in neither."""
    below = descendants(tree, root).withColumnRenamed("name", category)
    return entities.where(F.col(category).isNotNull()).join(below, category, "left_anti" if negate else "left_semi")


@dataclass(frozen=True)
class Atom:
    """A relation and its terms: names of variables, or Columns for constants."""

    relation: str
    terms: tuple[str | Column, ...]


@dataclass(frozen=True)
class Rule:
    """head follows where all atoms of the body hold and the guard, a Column over variables, is true."""

    head: Atom
    body: tuple[Atom, ...]
    guard: Column | None = None


def solve(rules: list[Rule], facts: dict[str, DataFrame]) -> dict[str, DataFrame]:
    """All relations that follow from tables of facts (terms by position) and positive rules, which may be mutually recursive.

    A body is a join over its shared variables. Semi-naive: in each round, one atom of a body takes only what the last round
    found; the rounds end when nothing is new. A null joins nothing.
    """

    def rows(atom: Atom, df: DataFrame) -> DataFrame:
        df = df.toDF(*[f"_{i}" for i in range(len(df.columns))])
        first: dict[str, int] = {}
        for i, term in enumerate(atom.terms):
            if isinstance(term, str) and term not in first:
                first[term] = i
            else:
                df = df.where(F.col(f"_{i}") == (F.col(f"_{first[term]}") if isinstance(term, str) else term))
        return df.select(*[F.col(f"_{i}").alias(v) for v, i in first.items()])

    def derive(rule: Rule, tables: list[DataFrame]) -> DataFrame:
        out = rows(rule.body[0], tables[0])
        for atom, table in zip(rule.body[1:], tables[1:], strict=True):
            right = rows(atom, table)
            shared = [c for c in right.columns if c in out.columns]
            out = out.join(right, shared) if shared else out.crossJoin(right)
        out = out if rule.guard is None else out.where(rule.guard)
        return out.select(*[(F.col(t) if isinstance(t, str) else t).alias(f"_{i}") for i, t in enumerate(rule.head.terms)])

    heads = {r.head.relation for r in rules}
    known: dict[str, DataFrame] = {}
    fresh: dict[str, DataFrame] = {}
    for name in heads:
        parts = [facts[name].toDF(*[f"_{i}" for i in range(len(facts[name].columns))])] if name in facts else []
        parts += [derive(r, [facts[a.relation] for a in r.body]) for r in rules if r.head.relation == name and not heads.intersection(a.relation for a in r.body)]
        if parts:
            known[name] = fresh[name] = cut(_union(parts).distinct())
    while fresh:
        found: dict[str, list[DataFrame]] = {}
        for rule in rules:
            if any(a.relation not in known and a.relation in heads for a in rule.body):
                continue  # nothing of one atom is known yet
            for i, atom in enumerate(rule.body):
                if atom.relation in fresh:
                    tables = [fresh[a.relation] if i == j else known.get(a.relation, facts.get(a.relation)) for j, a in enumerate(rule.body)]
                    found.setdefault(rule.head.relation, []).append(derive(rule, tables))
        fresh = {}
        for name, parts in found.items():
            new = _union(parts).distinct()
            new = cut(new.join(known[name], new.columns, "left_anti") if name in known else new)
            if not new.isEmpty():
                fresh[name] = new
        for name, new in fresh.items():
            known[name] = cut(known[name].unionByName(new)) if name in known else new
    return known


def well_founded(rules: DataFrame, atoms: DataFrame | None = None) -> DataFrame:
    """(atom, truth) of ground rules (head, pos array, neg array): true, undefined or false.

    The alternating fixpoint: what follows if no negated atom is false yet, then what can still follow if only what is
    surely true blocks, and so on until both sides stay. The least model within a round is semi-naive over body atoms.
    Joins are merges: broadcasts of a table in each of many rounds would pass through the driver.
    """
    body = rules.select(F.monotonically_increasing_id().alias("rule"), "head", F.array_distinct("pos").alias("pos"), F.array_distinct("neg").alias("neg"))
    body = cut(body)
    every = cut(body.select(F.explode(F.concat(F.array("head"), "pos", "neg")).alias("atom")).unionByName(atoms.select("atom") if atoms is not None else body.select(F.col("head").alias("atom")).limit(0)).distinct())
    pos, neg = body.select("rule", F.explode("pos").alias("atom")), body.select("rule", F.explode("neg").alias("atom"))

    def least(blocking: DataFrame) -> DataFrame:
        """Atoms that follow when a rule with a negated atom in `blocking` is left out."""
        live = cut(body.join(neg.join(blocking.hint("merge"), "atom", "left_semi").select("rule").distinct().hint("merge"), "rule", "left_anti").select("rule", "head", F.size("pos").alias("need")))
        derived = cut(live.where("need = 0").select(F.col("head").alias("atom")).distinct())
        while True:
            got = pos.join(derived.hint("merge"), "atom", "left_semi").groupBy("rule").agg(F.count(F.lit(1)).alias("got"))
            more = cut(live.join(got.hint("merge"), "rule").where("got = need").select(F.col("head").alias("atom")).distinct().join(derived.hint("merge"), "atom", "left_anti"))
            if more.isEmpty():
                return derived
            derived = cut(derived.unionByName(more))

    possible = least(every.limit(0))  # nothing blocks: all that may be true
    sure = least(possible)
    while True:
        possible = least(sure)
        more = least(possible)
        if more.count() == sure.count():
            break
        sure = more
    truth = F.when(F.col("t"), "true").when(F.col("p"), "undefined").otherwise("false")
    marked = every.join(sure.withColumn("t", F.lit(True)).hint("merge"), "atom", "left").join(possible.withColumn("p", F.lit(True)).hint("merge"), "atom", "left")
    return marked.select("atom", truth.alias("truth"))
