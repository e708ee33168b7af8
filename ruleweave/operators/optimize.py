"""Choosing among candidates: Pareto fronts, subsets and tours."""

from __future__ import annotations

import itertools
import math
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.operators.aggregates import number
from ruleweave.operators.recursion import cut

#: Subsets of a group up to which all are tried in whole arrays; above it they are branched over.
MANY = 50_000
#: Cells of an array in which groups of one size are solved together.
CELLS = 2_000_000


def _numeric(df: DataFrame, id_col: str, objectives: dict[str, str]) -> DataFrame:
    """(id, x array): the objectives as numbers to make small; rows with a missing one are left out."""
    x = [number(a) if how == "min" else -number(a) for a, how in objectives.items()]
    rows = df.select(F.col(id_col).alias("id"), F.array(*x).alias("x"))
    return rows.where(~F.exists("x", lambda v: v.isNull()))


def pareto_front(df: DataFrame, id_col: str, objectives: dict[str, str], values: DataFrame | None = None) -> DataFrame:
    """(id) of the rows that no other dominates; objectives are min or max. Equal rows don't dominate each other.

    Every task first finds the front of its own rows; only those meet, again in a few tasks, until one front is left.
    With two objectives the front comes from a sort and a running minimum instead, which needs no pairs at all.
    """
    rows = values if values is not None else _numeric(df, id_col, objectives)
    if len(objectives) == 2:
        return _front_of_two(rows).select("id")

    m = len(objectives)

    def own(batches):
        best, x = None, np.zeros((0, m))
        for batch in batches:
            y = batch.column(1).flatten().to_numpy(zero_copy_only=False).reshape(-1, m)
            at = _undominated(y, x)
            at = at[_first_front(y[at])]
            old = _undominated(x, y[at])
            new = pa.Table.from_batches([batch.take(pa.array(at))])
            best = new if best is None else pa.concat_tables([best.take(pa.array(old)), new])
            x = np.concatenate([x[old], y[at]])
        if best is not None:
            yield from best.to_batches()

    local = cut(rows.mapInArrow(own, rows.schema))
    a, b = local, local.select(F.col("id").alias("j"), F.col("x").alias("y"))
    worse = [F.col("y")[i] <= F.col("x")[i] for i in range(m)]
    better = [F.col("y")[i] < F.col("x")[i] for i in range(m)]
    rule = worse[0]
    some = better[0]
    for w, s in zip(worse[1:], better[1:], strict=True):
        rule, some = rule & w, some | s
    return a.join(b, rule & some, "left_anti").select("id")


def _undominated(x: np.ndarray, by: np.ndarray) -> np.ndarray:
    """The places of the points x that none of the points `by` dominates."""
    at = np.arange(len(x))
    for b in by:
        y = x[at]
        at = at[~((b <= y).all(axis=1) & (b < y).any(axis=1))]
    return at


def _first_front(x: np.ndarray) -> np.ndarray:
    """The places of the points that no other of x dominates; in their order a point stands behind all that dominate it."""
    at, out = np.lexsort(x.T[::-1]), []
    while len(at):
        out.append(at[0])
        at = at[1:][_undominated(x[at[1:]], x[at[:1]])]
    return np.array(out, np.int64)


def _front_of_two(rows: DataFrame) -> DataFrame:
    """A point is on the front if it has the least second value of its first value, and less than all smaller first values have.

    The first values are dealt by ranges: running minima within each range, and one minimum for each range before it.
    """
    least = rows.groupBy(F.col("x")[0].alias("a")).agg(F.min(F.col("x")[1]).alias("b"))
    dealt = cut(least.repartitionByRange("a").withColumn("part", F.spark_partition_id()))
    parts = dealt.groupBy("part").agg(F.min("b").alias("m"))
    before = parts.select("part", F.min("m").over(W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)).alias("earlier"))  # a row a partition
    inside = F.min("b").over(W.partitionBy("part").orderBy("a").rowsBetween(W.unboundedPreceding, -1))
    front = dealt.withColumn("inside", inside).join(F.broadcast(before), "part").where("b < least(coalesce(inside, double('inf')), coalesce(earlier, double('inf')))")
    return rows.join(front.select("a", "b"), (F.col("x")[0] == F.col("a")) & (F.col("x")[1] == F.col("b")), "left_semi")


def pareto_rank(df: DataFrame, id_col: str, objectives: dict[str, str], ranks: int | None = None) -> DataFrame:
    """(id, rank): 0 for the front, 1 for the front of the rest, and so on (up to `ranks` fronts if given)."""
    rest = cut(_numeric(df, id_col, objectives))
    out, rank = None, 0
    while not rest.isEmpty() and (ranks is None or rank < ranks):
        front = cut(pareto_front(df, id_col, objectives, rest))
        part = front.withColumn("rank", F.lit(rank))
        out = part if out is None else out.unionByName(part)
        rest = cut(rest.join(front, "id", "left_anti"))
        rank += 1
    return out if out is not None else df.select(F.col(id_col).alias("id"), F.lit(0).alias("rank")).limit(0)


def crowding(ranked: DataFrame, values: DataFrame, objectives: list[str]) -> DataFrame:
    """(id, rank, crowding): for each row the gaps between its neighbours within its front, scaled and summed; ends are infinite."""
    rows = ranked.join(values, "id")
    total = F.lit(0.0)
    for a in objectives:
        order = W.partitionBy("rank").orderBy(number(a), "id")
        low, high = F.lag(number(a)).over(order), F.lead(number(a)).over(order)
        span = F.max(number(a)).over(W.partitionBy("rank")) - F.min(number(a)).over(W.partitionBy("rank"))
        total = total + F.when(low.isNull() | high.isNull(), F.lit(math.inf)).otherwise(F.coalesce(F.try_divide(high - low, span), F.lit(0.0)))
    return rows.select("id", "rank", total.alias("crowding"))


def subsets(df: DataFrame, group: str, id_col: str, k: int, objective: tuple[str, str], limits: list[tuple[str, str, float]], exact: bool = True, seed: int = 42) -> DataFrame:
    """(group, ids, total): for each group the k rows with the best total of the objective (min or max, name) whose totals keep
    the limits (name, <= or >=, value); groups without such a subset, or with fewer rows, are left out.

    Exactly, by all subsets or branch and bound (of equal subsets the first by objective and id), or by seeded exchange. Groups
    are dealt over the cluster; one group's candidates are one problem and meet in one task, in batches of many groups.
    """
    how, name = objective
    sign = 1 if how == "max" else -1
    kind = df.schema
    schema = f"group {kind[group].dataType.simpleString()}, ids array<{kind[id_col].dataType.simpleString()}>, total double"

    def solve(frame: pd.DataFrame) -> list[pd.DataFrame]:
        """The subsets of whole groups whose rows follow one another; groups of one size are solved together."""
        g, ids, gain = frame["g"].to_numpy(), frame["id"].to_numpy(), frame["s"].to_numpy(float)
        cost = [frame[f"c{i}"].to_numpy(float) for i in range(len(limits))]
        starts = np.flatnonzero(np.concatenate([[True], g[1:] != g[:-1]]))
        sizes = np.diff(np.append(starts, len(g)))
        parts: list[pd.DataFrame] = []
        for n in np.unique(sizes[sizes >= k]).tolist():
            whole = exact and math.comb(n, k) > MANY
            room = 1 if whole else max(1, CELLS // (math.comb(n, k) if exact else k * k * max(1, n - k)))
            for at in np.array_split(own := starts[sizes == n], -(-len(own) // room)):
                rows = at[:, None] + np.arange(n)
                costs = [(c[rows], op, limit) for c, (_, op, limit) in zip(cost, limits, strict=True)]
                if whole:
                    best = _branch(gain[rows[0]], [(c[0], op, limit) for c, op, limit in costs], k)
                    found, ok = np.array([best or range(k)]), np.array([best is not None])
                else:
                    found, ok = _every(gain[rows], costs, k) if exact else _exchange(gain[rows], costs, k, seed)
                chosen = np.take_along_axis(rows, found, axis=1)[ok]
                if ok.any():  # a frame without rows has no kind of list
                    parts.append(pd.DataFrame({"group": g[at[ok]], "ids": [sorted(x) for x in ids[chosen].tolist()], "total": sign * gain[chosen].sum(axis=1)}))
        return parts

    def run(frames):
        held: list[pd.DataFrame] = []  # rows of the last group so far
        for frame in frames:
            if not len(frame):
                continue
            g = frame["g"].to_numpy()
            if held and held[-1]["g"].iloc[-1] != g[0]:
                yield from solve(pd.concat(held))
                held = []
            last = int((g != g[-1]).sum())
            if last:
                yield from solve(pd.concat([*held, frame.iloc[:last]]))
                held = []
            held.append(frame.iloc[last:])
        if held:
            yield from solve(pd.concat(held))

    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), (sign * number(name)).alias("s"), *[number(c).alias(f"c{i}") for i, (c, _, _) in enumerate(limits)]).na.drop()
    return rows.repartition("g").sortWithinPartitions("g", F.desc("s"), "id").mapInPandas(run, schema)


def _every(gain: np.ndarray, costs: list, k: int) -> tuple[np.ndarray, np.ndarray]:
    """For each group (a row of gain and of every cost) the best of all its subsets, and whether it keeps the limits."""
    sets = _combinations(gain.shape[1], k)
    totals, broken = _sums(gain, sets), np.zeros((len(gain), len(sets)))
    for c, op, limit in costs:
        s = _sums(c, sets)
        broken += np.maximum(0.0, s - limit if op == "<=" else limit - s)
    totals[broken > 1e-9] = -math.inf
    most = totals.max(axis=1)
    return sets[(totals >= most[:, None] - 1e-9).argmax(axis=1)], most > -math.inf


@lru_cache(maxsize=64)
def _combinations(n: int, k: int) -> np.ndarray:
    return np.array(list(itertools.combinations(range(n), k)), np.int64).reshape(-1, k)


def _sums(x: np.ndarray, sets: np.ndarray) -> np.ndarray:
    out = np.zeros((len(x), len(sets)))
    for i in range(sets.shape[1]):
        out += x[:, sets[:, i]]
    return out


def _broken(costs: list, chosen: list[int]) -> float:
    """By how much a subset breaks the limits."""
    return sum(max(0.0, c[chosen].sum() - limit if op == "<=" else limit - c[chosen].sum()) for c, op, limit in costs)


def _branch(gain: np.ndarray, costs: list, k: int) -> list[int] | None:
    """Depth first over rows in the order of their gain; a branch ends where neither gain nor limits can be reached any more."""
    upto = np.concatenate([[0], np.cumsum(gain)])
    reach = []  # for each limit and row: the least and the most that 0 to k further rows add
    for c, _, _ in costs:
        rest = [np.sort(c[i:]) for i in range(len(c) + 1)]
        reach.append([(np.concatenate([[0], np.cumsum(x[:k])]), np.concatenate([[0], np.cumsum(x[::-1][:k])])) for x in rest])
    best: list = [-math.inf, None]
    stack = [(0, [], 0.0)]
    while stack:
        i, chosen, total = stack.pop()
        need = k - len(chosen)
        if not need:
            if total > best[0] + 1e-9 and _broken(costs, chosen) <= 1e-9:
                best = [total, chosen]
            continue
        if need == 1:  # the rows stand in the order of their gain: the first that keeps the limits is the best
            over = np.zeros(len(gain) - i)
            for c, op, limit in costs:
                t = (c[chosen].sum() if chosen else 0.0) + c[i:]
                over += np.maximum(0.0, t - limit if op == "<=" else limit - t)
            fit = np.flatnonzero(over <= 1e-9)
            if len(fit) and total + gain[i + fit[0]] > best[0] + 1e-9:
                best = [total + gain[i + fit[0]], [*chosen, i + int(fit[0])]]
            continue
        if len(gain) - i < need or total + upto[i + need] - upto[i] <= best[0] + 1e-9:
            continue
        sums = [c[chosen].sum() if chosen else 0.0 for c, _, _ in costs]
        if any(s + t[i][0][need] > limit + 1e-9 if op == "<=" else s + t[i][1][need] < limit - 1e-9 for s, (_, op, limit), t in zip(sums, costs, reach, strict=True)):
            continue
        stack.append((i + 1, chosen, total))
        stack.append((i + 1, [*chosen, i], total + gain[i]))
    return best[1]


def _exchange(gain: np.ndarray, costs: list, k: int, seed: int, starts: int = 8) -> tuple[np.ndarray, np.ndarray]:
    """For each group (a row of gain and of every cost): from several random subsets, the best exchange of one row again and
    again until none helps; and whether the best found keeps the limits. Groups of one size have the same starts."""
    many, n = gain.shape
    rng = np.random.default_rng(seed)

    def judge(at: np.ndarray, sets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """By how much the sets keep the limits (0 at most), and what they gain; the sets of a row are those of group at."""
        where = at.reshape(-1, *[1] * (sets.ndim - 1))
        broken = np.zeros(sets.shape[:-1])
        for c, op, limit in costs:
            s = c[where, sets].sum(axis=-1)
            broken += np.maximum(0.0, s - limit if op == "<=" else limit - s)
        return -broken, gain[where, sets].sum(axis=-1)

    best, kept, most = np.zeros((many, k), np.int64), np.full(many, -math.inf), np.full(many, -math.inf)
    for _ in range(starts):
        chosen = np.tile(rng.permutation(n)[:k], (many, 1))
        fit, total = judge(np.arange(many), chosen)
        at = np.arange(many if n > k else 0)
        while len(at):
            free = np.ones((len(at), n), bool)
            np.put_along_axis(free, chosen[at], False, axis=1)
            rest = np.nonzero(free)[1].reshape(len(at), n - k)
            others = np.repeat(chosen[at][:, None, :], k * (n - k), axis=1)
            for i in range(k):
                others[:, i * (n - k) : (i + 1) * (n - k), i] = rest
            f, t = judge(at, others)
            t = np.where(f == f.max(axis=1, keepdims=True), t, -math.inf)
            pick = t.argmax(axis=1)
            line = np.arange(len(at))
            f, t = f[line, pick], t[line, pick]
            better = (f > fit[at]) | ((f == fit[at]) & (t > total[at]))
            at, f, t, others = at[better], f[better], t[better], others[line, pick][better]
            chosen[at], fit[at], total[at] = others, f, t
        new = (fit > kept) | ((fit == kept) & (total > most))
        best[new], kept[new], most[new] = chosen[new], fit[new], total[new]
    return best, kept >= -1e-9


def _nearest(p: np.ndarray) -> np.ndarray:
    """The tour that goes on to the nearest point left, of equally near ones to the first."""
    left, tour = np.arange(1, len(p)), [0]
    x, y = p[1:, 0].copy(), p[1:, 1].copy()
    while len(left):
        i = int(np.hypot(x - p[tour[-1], 0], y - p[tour[-1], 1]).argmin())
        tour.append(int(left[i]))
        left, x, y = np.delete(left, i), np.delete(x, i), np.delete(y, i)
    return np.array(tour)


def _reversals(p: np.ndarray, tour: np.ndarray) -> np.ndarray:
    """A tour after reversing the first part that shortens it, again and again until none does.

    All ends of a part are judged at once. Most are discarded by one coordinate, which bounds distances from below, so
    memory grows with the points; the time of a round still grows with their square, by a few nanoseconds a pair.
    """
    n, far = len(tour), int(np.ptp(p, axis=0).argmax())
    tour = np.append(tour, tour[0])
    q = p[tour]
    x, y, z = q[:, 0].copy(), q[:, 1].copy(), q[:, far].copy()
    step = np.hypot(x[1:] - x[:-1], y[1:] - y[:-1])  # from each stop to the next
    better = True
    while better:
        better = False
        for i in range(1, n - 1):
            j = i + 1
            while j < n:
                old = step[i - 1] + step[j:]
                near = np.flatnonzero(np.abs(z[j:n] - z[i - 1]) + np.abs(z[j + 1 :] - z[i]) < old * (1 + 1e-9)) + j
                new = np.hypot(x[near] - x[i - 1], y[near] - y[i - 1]) + np.hypot(x[near + 1] - x[i], y[near + 1] - y[i])
                hit = near[new < old[near - j] - 1e-9]
                if not len(hit):
                    break
                j = int(hit[0])
                for a in (tour, x, y, z):
                    a[i : j + 1] = a[i : j + 1][::-1].copy()
                step[i - 1 : j + 1] = np.hypot(x[i : j + 2] - x[i - 1 : j + 1], y[i : j + 2] - y[i - 1 : j + 1])
                better, j = True, j + 1
    return tour[:n]


def tours(df: DataFrame, group: str, id_col: str, x: str, y: str, exact: int = 8) -> DataFrame:
    """(group, stops array, length): for each group a short closed tour over its points, from the smallest id.

    Up to `exact` points all orders are tried, above that the nearest neighbour's tour is improved by reversing parts
    until none helps. Groups are dealt over the cluster; one group is one tour's points.
    """

    def one(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values("id")
        ids, p = frame["id"].tolist(), frame[["px", "py"]].to_numpy(float)
        n = len(ids)
        length = lambda t: float(sum(np.hypot(*(p[list(t)] - p[[*t[1:], t[0]]]).T).tolist()))
        if n <= exact:
            best = min(((0, *rest) for rest in itertools.permutations(range(1, n))), key=lambda t: (round(length(t), 9), t))
        else:
            best = tuple(_reversals(p, _nearest(p)).tolist())
        return pd.DataFrame({"group": [frame["g"].iloc[0]], "stops": [[ids[i] for i in best]], "length": [length(best)]})

    kinds = df.schema
    rows = df.select(F.col(group).alias("g"), F.col(id_col).alias("id"), number(x).alias("px"), number(y).alias("py")).na.drop()
    return rows.groupBy("g").applyInPandas(one, f"group {kinds[group].dataType.simpleString()}, stops array<{kinds[id_col].dataType.simpleString()}>, length double")
