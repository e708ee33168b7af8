"""Statistical tests and forecasts over entities; every one is an aggregate, then a join of its few rows."""

from __future__ import annotations

import math
from functools import reduce
from statistics import NormalDist

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.operators.aggregates import number

# Two-sided critical values of Grubbs' test from the NIST/SEMATECH handbook, by sample size.
GRUBBS = {
    0.05: {3: 1.155, 4: 1.481, 5: 1.715, 6: 1.887, 7: 2.020, 8: 2.126, 9: 2.215, 10: 2.290, 11: 2.355, 12: 2.412, 13: 2.462, 14: 2.507, 15: 2.549, 16: 2.585, 17: 2.620, 18: 2.651, 19: 2.681, 20: 2.709, 25: 2.822, 30: 2.908, 40: 3.036, 50: 3.128, 60: 3.199, 70: 3.257, 80: 3.305, 90: 3.347, 100: 3.383, 150: 3.498, 200: 3.610, 500: 3.836, 1000: 3.957},
    0.01: {3: 1.155, 4: 1.496, 5: 1.764, 6: 1.973, 7: 2.139, 8: 2.274, 9: 2.387, 10: 2.482, 11: 2.564, 12: 2.636, 13: 2.699, 14: 2.755, 15: 2.806, 16: 2.852, 17: 2.894, 18: 2.932, 19: 2.968, 20: 3.001, 25: 3.135, 30: 3.236, 40: 3.381, 50: 3.483, 60: 3.560, 70: 3.622, 80: 3.673, 90: 3.716, 100: 3.754},
}


def _beside(df: DataFrame, summary: DataFrame, by: list[str]) -> DataFrame:
    """df with its group's summary, or with the one row of a summary without groups."""
    return df.join(summary, by) if by else df.crossJoin(F.broadcast(summary))


def zscore(df: DataFrame, value: str, by: list[str] | None = None, threshold: float = 2.5, min_sample: int = 3) -> DataFrame:
    """df with mean, sd (of the population), z and flagged (|z| > threshold); non-numbers, groups without spread and groups
    below the minimal sample are never flagged."""
    by = by or []
    x = number(value)
    summary = df.where(x.isNotNull()).groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_pop(x).alias("sd"), F.count(F.lit(1)).alias("sample"))
    z = F.try_divide(x - F.col("mean"), F.col("sd"))
    flagged = F.coalesce((F.col("sample") >= min_sample) & (F.abs(z) > threshold), F.lit(False))
    return _beside(df, summary, by).withColumn("z", z).withColumn("flagged", flagged)


def grubbs_critical(n: int, alpha: float = 0.05) -> float:
    """The critical value for one sample size: tabulated with straight lines between the entries, else from Student's t."""
    table = GRUBBS.get(alpha, {})
    if n in table:
        return table[n]
    below, above = [k for k in table if k < n], [k for k in table if k > n]
    if below and above:
        a, b = max(below), min(above)
        return table[a] + (n - a) / (b - a) * (table[b] - table[a])
    if n < 3:
        return math.inf
    t = student_t(alpha / (2 * n), n - 2)
    return (n - 1) / math.sqrt(n) * math.sqrt(t * t / (n - 2 + t * t))


def student_t(p: float, df: int) -> float:
    """Upper critical value of Student's t by the expansion around the normal quantile; exact for one degree of freedom."""
    if df == 1:
        return math.tan(math.pi * (0.5 - p))
    z = NormalDist().inv_cdf(1 - p)
    terms = [(z**3 + z) / 4, (5 * z**5 + 16 * z**3 + 3 * z) / 96, (3 * z**7 + 19 * z**5 + 17 * z**3 - 15 * z) / 384]
    return z + sum(c / df ** (k + 1) for k, c in enumerate(terms))


# Acklam's rational approximation of the lower tail of the normal quantile, for probabilities below 0.02425.
TAIL_ABOVE = (-7.784894002430293e-03, -3.223964580411365e-01, -2.400758277161838, -2.549732539343734, 4.374664141464968, 2.938163982698783)
TAIL_BELOW = (7.784695709041462e-03, 3.224671290700398e-01, 2.445134137142996, 3.754408661907416, 1.0)


def _with_critical(summary: DataFrame, alpha: float) -> DataFrame:
    """summary (with sample) and g_crit, as grubbs_critical(): the table with straight lines, beyond it the formula step by step."""
    if alpha / 6 >= 0.02425:
        raise ValueError("alpha is too large for grouped tests")
    n = F.col("_n")
    poly = lambda cs: reduce(lambda out, c: out * F.col("_q") + F.lit(c), cs[1:], F.lit(cs[0]))
    df, z = n - 2, F.col("_z")
    power = lambda k: F.pow(z, F.lit(float(k)))
    t = z + (power(3) + z) / (4 * df) + (5 * power(5) + 16 * power(3) + 3 * z) / (96 * df * df) + (3 * power(7) + 19 * power(5) + 17 * power(3) - 15 * z) / (384 * df * df * df)
    t = F.when(df == 1, F.tan(F.lit(math.pi) * (0.5 - F.lit(alpha) / (2 * n)))).otherwise(t)
    formula = F.when(n >= 3, (n - 1) / F.sqrt(n) * F.sqrt(F.col("_t") * F.col("_t") / (n - 2 + F.col("_t") * F.col("_t"))))
    points = sorted(GRUBBS.get(alpha, {}).items())
    out = F.when(n == points[0][0], F.lit(points[0][1])) if points else None
    for (a, x), (b, y) in zip(points, points[1:], strict=False):
        out = out.when((n > a) & (n <= b), F.lit(x) + (n - a) / F.lit(float(b - a)) * F.lit(y - x))
    steps = summary.withColumn("_n", F.col("sample").cast("double")).withColumn("_q", F.sqrt(-2 * F.ln(F.lit(alpha) / (2 * n))))
    steps = steps.withColumn("_z", -poly(TAIL_ABOVE) / poly(TAIL_BELOW)).withColumn("_t", t)
    return steps.withColumn("g_crit", F.when(n >= 3, formula if out is None else out.otherwise(formula))).drop("_n", "_q", "_z", "_t")


def grubbs(df: DataFrame, value: str, by: list[str] | None = None, alpha: float = 0.05) -> DataFrame:
    """df with g (distance from the mean in sample deviations), g_crit and flagged (g > g_crit)."""
    by = by or []
    x = number(value)
    summary = df.where(x.isNotNull()).groupBy(*by).agg(F.avg(x).alias("mean"), F.stddev_samp(x).alias("sd"), F.count(F.lit(1)).alias("sample"))
    if by:
        summary = _with_critical(summary, alpha)
    else:
        n = df.where(x.isNotNull()).count()
        summary = summary.withColumn("g_crit", F.lit(grubbs_critical(n, alpha)))
    g = F.coalesce(F.try_divide(F.abs(x - F.col("mean")), F.col("sd")), F.lit(0.0))
    return _beside(df, summary, by).withColumn("g", g).withColumn("flagged", F.coalesce(F.col("g") > F.col("g_crit"), F.lit(False)))


#: Values that are put in order as they are; of more, the approximate bracket is many ranks wider than its error.
FEW = 100_000


def exact_percentile(df: DataFrame, x: Column, share: float) -> DataFrame:
    """One row (threshold, sample): the percentile of a whole table with straight lines between ranks.

    An approximate percentile brackets the rank; values below the bracket are counted, and only the values inside, about one
    in a thousand, are put in order.
    """
    rows = df.select(x.alias("x")).where("x is not null")
    ends = [max(0.0, share - 5e-4), min(1.0, share + 5e-4)]
    bracket = rows.agg(F.percentile_approx("x", F.array(*[F.lit(e) for e in ends]), 10_000).alias("b"), F.min("x").alias("low"), F.max("x").alias("high"), F.count("x").alias("sample"))
    few = F.col("sample") < FEW
    low = F.when(few | F.lit(ends[0] == 0), F.col("low")).otherwise(F.col("b")[0])
    high = F.when(few | F.lit(ends[1] == 1), F.col("high")).otherwise(F.col("b")[1])
    bracket = bracket.select(low.alias("low"), high.alias("high"), "sample", (F.lit(share) * (F.col("sample") - 1)).alias("rank"))
    met = rows.crossJoin(F.broadcast(bracket))  # one row
    below = met.agg(F.coalesce(F.sum((F.col("x") < F.col("low")).cast("long")), F.lit(0)).alias("below"))
    band = met.where((F.col("x") >= F.col("low")) & (F.col("x") <= F.col("high"))).groupBy("x").agg(F.count("*").alias("n"), F.first("rank").alias("rank"))
    upto = F.sum("n").over(W.orderBy("x").rowsBetween(W.unboundedPreceding, W.currentRow))  # values of the bracket only
    band = band.crossJoin(F.broadcast(below)).withColumn("last", F.col("below") + upto - 1).withColumn("first", F.col("last") - F.col("n") + 1)
    at = lambda place: F.max(F.when((F.col("first") <= place) & (place <= F.col("last")), F.col("x")))
    ends = band.agg(at(F.floor("rank")).alias("lower"), at(F.ceil("rank")).alias("upper"))
    whole, rank = F.floor("rank"), F.col("rank")
    straight = F.when((whole == rank) | (F.col("lower") == F.col("upper")), F.col("lower")).otherwise((whole + 1 - rank) * F.col("lower") + (rank - whole) * F.col("upper"))
    return bracket.crossJoin(F.broadcast(ends)).select(straight.alias("threshold"), "sample")


def learned_threshold(df: DataFrame, value: str, percentile: float, above: bool = True, min_sample: int = 3, by: list[str] | None = None) -> DataFrame:
    """Rows beyond the percentile (0 to 100, straight lines between ranks) of their group, with the threshold.

    A group below the minimal sample passes as a whole, as its threshold can't be learned.
    """
    by = by or []
    x = number(value)
    if by:
        summary = df.groupBy(*by).agg(F.percentile(x, percentile / 100).alias("threshold"), F.count(x).alias("sample"))
    else:
        summary = exact_percentile(df, x, percentile / 100)
    beyond = x > F.col("threshold") if above else x < F.col("threshold")
    return _beside(df, summary, by).where((F.col("sample") < min_sample) | beyond).drop("sample")


def correlation(df: DataFrame, a: str, b: str) -> DataFrame:
    """One row (r, sample): Pearson's coefficient over complete pairs, 0 without spread."""
    x, y = number(a), number(b)
    pairs = df.where(x.isNotNull() & y.isNotNull()).select(x.alias("x"), y.alias("y"))
    sums = pairs.agg(F.count(F.lit(1)).alias("sample"), F.avg("x").alias("mx"), F.avg("y").alias("my"), F.covar_pop("x", "y").alias("cov"), F.var_pop("x").alias("vx"), F.var_pop("y").alias("vy"))
    return sums.select(F.coalesce(F.try_divide(F.col("cov"), F.sqrt(F.col("vx") * F.col("vy"))), F.lit(0.0)).alias("r"), "sample")


def correlates_with(df: DataFrame, a: str, b: str, threshold: float, min_sample: int = 3) -> DataFrame:
    """All rows if the coefficient is above a threshold (below, for a negative one), else none; too small a sample passes."""
    gate = F.col("r") >= threshold if threshold >= 0 else F.col("r") <= threshold
    r = correlation(df, a, b)
    return df.crossJoin(F.broadcast(r)).where((F.col("sample") < min_sample) | gate).select(*df.columns, "r")


def forecast(df: DataFrame, by: list[str], order: list[str], value: str, op: str = "<=", threshold: float = 0.0, alpha: float = 0.3, beta: float = 0.1, horizon: int = 365) -> DataFrame:
    """For each series its smoothed level and trend (Holt) and the first step, from 0 to horizon, that meets the predicate.

    A series of fewer than two points, and one that never meets it, has the horizon and a confidence of 0. A series is
    gathered as an array of its group, so it is as long as one entity's history.
    """
    x = number(value)
    state = "struct<level:double,trend:double,last:double>"
    series = df.where(x.isNotNull()).groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, x.alias("x")))).alias("s")).withColumn("x", F.col("s.x"))
    first = F.struct(F.col("x")[0].alias("level"), F.coalesce(F.try_element_at("x", F.lit(2)) - F.col("x")[0], F.lit(0.0)).alias("trend"), F.lit(0.0).alias("last")).cast(state)

    def step(s: Column, v: Column) -> Column:
        level = alpha * v + (1 - alpha) * (s["level"] + s["trend"])
        return F.struct(level.alias("level"), (beta * (level - s["level"]) + (1 - beta) * s["trend"]).alias("trend"), v.alias("last")).cast(state)

    fitted = series.withColumn("f", F.aggregate(F.slice("x", 2, F.greatest(F.size("x") - 1, F.lit(0))), first, step))
    tests = {"<=": lambda p: p <= threshold, "<": lambda p: p < threshold, ">=": lambda p: p >= threshold, ">": lambda p: p > threshold, "==": lambda p: p == threshold}
    hits = F.filter(F.sequence(F.lit(0), F.lit(horizon)), lambda k: tests[op](F.col("f.level") + k * F.col("f.trend")))
    found = F.when(F.size("x") >= 2, F.try_element_at(hits, F.lit(1)))
    return fitted.select(*by, F.size("x").alias("points"), F.col("f.level").alias("level"), F.col("f.trend").alias("trend"), F.coalesce(found, F.lit(horizon)).alias("steps"), F.when(found.isNotNull(), 1.0).otherwise(0.0).alias("confidence"))


def markov_transitions(df: DataFrame, by: list[str], order: list[str], state: str) -> DataFrame:
    """(from_state, to_state, n, p): how often a state follows another, and its share of what follows."""
    moves = df.select(F.lag(state).over(W.partitionBy(*by).orderBy(*order)).alias("from_state"), F.col(state).alias("to_state")).where("from_state is not null and to_state is not null")
    counts = moves.groupBy("from_state", "to_state").agg(F.count(F.lit(1)).alias("n"))
    totals = counts.groupBy("from_state").agg(F.sum("n").alias("all"))
    return counts.join(totals, "from_state").select("from_state", "to_state", "n", (F.col("n") / F.col("all")).alias("p"))


def markov_after(transitions: DataFrame, start: str, steps: int) -> DataFrame:
    """(state, p): the distribution some steps after a state; one small join a step."""
    spark = transitions.sparkSession
    now = spark.createDataFrame([(start, 1.0)], "state string, p double")
    for _ in range(steps):
        moved = now.withColumnRenamed("p", "q").join(transitions, F.col("state") == F.col("from_state"))
        now = moved.groupBy(F.col("to_state").alias("state")).agg(F.sum(F.col("q") * F.col("p")).alias("p"))
    return now


def hmm_score(df: DataFrame, by: list[str], order: list[str], observation: str, initial: list[float], move: list[list[float]], emit: list[dict[str, float]], cutoff: float) -> DataFrame:
    """For each sequence its log likelihood under a hidden Markov model (forward algorithm, scaled) and how far, from 0 to 1
    over ten nats, it lies below the cutoff. An unknown symbol or an empty sequence is impossible: -inf, and 1."""
    n = len(initial)
    state = f"struct<{','.join(f'a{i}:double' for i in range(n))},ll:double>"
    likely = lambda o, i: F.coalesce(F.element_at(F.create_map(*[F.lit(x) for kv in emit[i].items() for x in kv]), o), F.lit(0.0))

    def scaled(raw: list[Column], ll: Column) -> Column:
        total = sum(raw[1:], raw[0])
        return F.struct(*[F.coalesce(F.try_divide(r, total), F.lit(0.0)).alias(f"a{i}") for i, r in enumerate(raw)], (ll + F.when(total > 0, F.ln(total)).otherwise(F.lit(float("-inf")))).alias("ll")).cast(state)

    def step(s: Column, o: Column) -> Column:
        reach = [sum((s[f"a{i}"] * move[i][j] for i in range(1, n)), s["a0"] * move[0][j]) for j in range(n)]
        first = s["ll"].isNull()
        raw = [F.when(first, F.lit(initial[j])).otherwise(reach[j]) * likely(o, j) for j in range(n)]
        return scaled(raw, F.coalesce(s["ll"], F.lit(0.0)))

    start = F.struct(*[F.lit(0.0).alias(f"a{i}") for i in range(n)], F.lit(None).cast("double").alias("ll")).cast(state)
    rows = df.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct(*order, F.col(observation).alias("o")))).alias("s"))
    ll = F.coalesce(F.aggregate(F.col("s.o"), start, step)["ll"], F.lit(float("-inf")))
    return rows.select(*by, ll.alias("log_likelihood"), F.greatest(F.lit(0.0), F.least(F.lit(1.0), (F.lit(cutoff) - ll) / 10)).alias("anomaly"))


def quality_of(flags: DataFrame, flagged: str, expected: str) -> DataFrame:
    """One row of precision, recall and f1 of flags; without a true positive all are 0."""
    one = lambda c: F.sum(F.when(c, 1.0).otherwise(0.0))
    f, e = F.coalesce(F.col(flagged), F.lit(False)), F.coalesce(F.col(expected), F.lit(False))
    sums = flags.agg(one(f & e).alias("tp"), one(f & ~e).alias("fp"), one(~f & e).alias("fn"))
    p, r = F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fp")), F.lit(0.0)), F.coalesce(F.try_divide("tp", F.col("tp") + F.col("fn")), F.lit(0.0))
    return sums.select(p.alias("precision"), r.alias("recall"), F.coalesce(F.try_divide(2 * p * r, p + r), F.lit(0.0)).alias("f1"))


def tune_threshold(scored: DataFrame, score: str, expected: str, low: float = 0.5, high: float = 4.0, step: float = 0.01) -> DataFrame:
    """(threshold, f1) with the best F1 of `score > threshold`, the smallest of equal ones: a sweep over all thresholds.

    Scores are first counted by the step they fall in, so the sweep's table is as long as the sweep.
    """
    n = round((high - low) / step)
    e = F.coalesce(F.col(expected), F.lit(False))
    # A row counts for all thresholds below its score: bucket k holds the scores above k thresholds of the sweep.
    bucket = F.least(F.greatest(F.ceil(F.round((F.col(score) - low) / step, 9)), F.lit(0)), F.lit(n + 1)).cast("int")
    counts = scored.groupBy(F.coalesce(bucket, F.lit(0)).alias("b")).agg(F.sum(e.cast("double")).alias("pos"), F.count(F.lit(1)).cast("double").alias("all"))
    grid = scored.sparkSession.range(n + 1).select(F.col("id").alias("k"))
    swept = grid.join(F.broadcast(counts), F.col("b") > F.col("k"), "left").groupBy("k").agg(F.coalesce(F.sum("pos"), F.lit(0.0)).alias("tp"), F.coalesce(F.sum("all"), F.lit(0.0)).alias("flagged"))
    total = counts.agg(F.sum("pos").alias("pos"))
    f1 = F.coalesce(F.try_divide(2 * F.col("tp"), F.col("flagged") + F.col("pos")), F.lit(0.0))
    best = swept.crossJoin(F.broadcast(total)).select(F.round(F.lit(low) + F.col("k") * step, 9).alias("threshold"), f1.alias("f1"))
    return best.orderBy(F.desc("f1"), "threshold").limit(1)
