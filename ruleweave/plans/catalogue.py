"""The registered queries of the rule engine and the SQL that gives the same rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.functions import scalars as S
from ruleweave.functions.conditions import Condition, attr, derived, full_text, present
from ruleweave.operators import aggregates as A
from ruleweave.operators import graph, models, optimize, policy, recursion, sequences, stats
from ruleweave.plans.detect import Detect
from ruleweave.sources import factlog, ingest
from ruleweave.sources.entities import EntityView, from_facts, read_table, to_facts
from ruleweave.streaming import feed

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}
NOW = "1998-01-01"


def query(sql: str | None = None) -> Callable:
    """Registers a function under its name, with its SQL."""

    def add(fn: Callable[[SparkSession, str], DataFrame]) -> Callable:
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


def customers(spark: SparkSession, d: str) -> EntityView:
    return EntityView(read_table(spark, d, "customer"), "c_custkey", "customer")


def orders(spark: SparkSession, d: str) -> EntityView:
    return EntityView(read_table(spark, d, "orders"), "o_orderkey", "order", context={"today": NOW})


def parts(spark: SparkSession, d: str) -> EntityView:
    return EntityView(read_table(spark, d, "part"), "p_partkey", "part")


def events(spark: SparkSession, d: str) -> DataFrame:
    return read_table(spark, d, "events")


def r(c, digits: int = 4):
    """Rounded, without a negative zero: sums differ in their last digits with the order of the rows."""
    return F.round(c, digits) + F.lit(0.0)


# Selection


@query("select c_custkey, c_name, c_acctbal from customer where c_mktsegment = 'BUILDING' and c_acctbal < 0")
def detect_compare(spark, d):
    return A.select(customers(spark, d), (attr("c_mktsegment") == "BUILDING") & (attr("c_acctbal") < 0), "c_name", "c_acctbal")


@query("select l_orderkey, count(*)::bigint as n_lines from lineitem where l_extendedprice > l_quantity * 1500 group by l_orderkey")
def detect_attr_attr(spark, d):
    view = EntityView(read_table(spark, d, "lineitem"), "l_orderkey")
    return (attr("l_extendedprice") > attr("l_quantity") * 1500).rows(view).groupBy("l_orderkey").agg(F.count("*").alias("n_lines"))


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority in ('1-URGENT', '2-HIGH')")
def detect_membership(spark, d):
    return A.select(orders(spark, d), attr("o_orderpriority").isin("1-URGENT", "2-HIGH"), "o_orderpriority")


@query("select o_orderkey, o_orderpriority from orders where o_orderpriority is not null and o_orderpriority not in ('1-URGENT', '2-HIGH', '3-MEDIUM')")
def detect_not_in(spark, d):
    return A.select(orders(spark, d), attr("o_orderpriority").notin("1-URGENT", "2-HIGH", "3-MEDIUM"), "o_orderpriority")


@query("select p_partkey from part where (coalesce(p_size < 5, false) or not coalesce(p_retailprice > 1200, false)) and not coalesce(p_brand = 'Brand#11', false)")
def detect_or_not(spark, d):
    return A.select(parts(spark, d), ((attr("p_size") < 5) | ~(attr("p_retailprice") > 1200)) & ~(attr("p_brand") == "Brand#11"))


@query("select o_orderkey, o_totalprice from orders where not coalesce(o_totalprice > 150000, false) and o_orderstatus = 'O'")
def derive_negation(spark, d):
    large = derived(lambda: attr("o_totalprice") > 150000)
    return A.select(orders(spark, d), ~large & (attr("o_orderstatus") == "O"), "o_totalprice")


@query("select c_custkey from customer")
def missing_attribute(spark, d):
    """An attribute that no row has: a test of it is false everywhere, its negation true."""
    return A.select(customers(spark, d), ~(attr("discount_code") == "X") & ~present("discount_code"))


@query("""select p_partkey, p_name from part where contains(p_name, 'e') and (starts_with(p_name, 'b') or ends_with(p_name, 'n') or p_type like '%A%')""")
def string_predicates(spark, d):
    return A.select(parts(spark, d), attr("p_name").contains("e") & (attr("p_name").starts_with("b") | attr("p_name").ends_with("n") | attr("p_type").contains("A")), "p_name")


@query("select doc_id from documents where contains(lower(text), 'thing') or contains(lower(lang), 'thing') or contains(lower(source), 'thing')")
def full_text_search(spark, d):
    return A.select(EntityView(read_table(spark, d, "documents"), "doc_id"), full_text("THING"))


@query("select p_partkey from part where len(list_filter(string_split(p_name, ' '), lambda x: starts_with(x, 'a') or starts_with(x, 's'))) > 0")
def list_quantifier(spark, d):
    view = parts(spark, d)
    view = view.with_df(view.df.withColumn("words", S.split(F.col("p_name"), " ")))
    return A.select(view, attr("words").starts_with("a") | attr("words").starts_with("s"))


@query("""select p_partkey, upper(substr(p_name, 3, 5)) as cut, length(p_name)::double as len, replace(p_name, 'a', '*') as starred, p_brand || '/' || p_size::varchar as joined,
  string_split(p_name, ' ')[1] as first_word, trim(lower(p_type)) as kind from part""")
def string_functions(spark, d):
    c = F.col
    return parts(spark, d).df.select(
        "p_partkey", F.upper(S.substring(c("p_name"), 2, 5)).alias("cut"), S.length(c("p_name")).alias("len"), S.replace(c("p_name"), "a", "*").alias("starred"),
        S.concat(c("p_brand"), F.lit("/"), c("p_size")).alias("joined"), S.split(c("p_name"), " ")[0].alias("first_word"), S.trim(F.lower(c("p_type"))).alias("kind"),
    )


@query("""select o_orderkey, round(o_totalprice / 7, 4) as ratio, (o_custkey % 7)::double as rest from orders where (o_totalprice - 1000) * 2 > o_custkey * 100 + 5 and o_custkey % 7 = 3""")
def arithmetic(spark, d):
    view = orders(spark, d)
    kept = (((attr("o_totalprice") - 1000) * 2 > attr("o_custkey") * 100 + 5) & (attr("o_custkey") % 7 == 3)).rows(view)
    return kept.select("o_orderkey", r((attr("o_totalprice") / 7).build(view)).alias("ratio"), (attr("o_custkey") % 7).build(view).alias("rest"))


@query("select event_id, json_extract_string(props, '$.k')::double as k from events where json_extract_string(props, '$.k')::double >= 50")
def json_path(spark, d):
    rows = events(spark, d).withColumn("k", S.path(F.col("props"), "k", "double"))
    return rows.where("k >= 50").select("event_id", "k")


@query("select o_orderkey from orders where o_orderdate::date < date '1998-01-01' - 365 and o_orderstatus = 'P'")
def temporal_older(spark, d):
    return A.select(orders(spark, d), attr("o_orderdate").older_than(1, "year") & (attr("o_orderstatus") == "P"))


@query("select o_orderkey from orders where o_orderdate::date between date '1998-01-01' and date '1998-01-01' + 21")
def temporal_approaching(spark, d):
    return A.select(orders(spark, d), attr("o_orderdate").approaching_within(3, "weeks"))


@query("""select c_custkey, 'Customer ' || c_name || ' of ' || c_mktsegment || ' {unknown}' as label from customer where c_acctbal < -900""")
def label_template(spark, d):
    out = Detect("low balance", attr("c_acctbal") < -900, label="Customer {c_name} of {c_mktsegment} {unknown}").run(customers(spark, d))
    return out.select("c_custkey", "label")


@query("""with f as (select c_custkey, c_acctbal from customer where c_acctbal < -900), a as (select count(*) as n, round(avg(c_acctbal), 2) as m from f) select c_custkey, n::varchar || ' customers below, ' || m::varchar || ' on average' as label from f, a""")
def label_aggregates(spark, d):
    """A label with aggregates over the flagged rows."""
    rows = (attr("c_acctbal") < -900).rows(customers(spark, d))
    summary = rows.agg(F.count("*").alias("n"), r(F.avg("c_acctbal"), 2).alias("m"))
    out = A.with_scalars(rows, summary)
    return out.select("c_custkey", S.template("{n} customers below, {m} on average", {"n": F.col("n"), "m": F.col("m")}).alias("label"))


# Aggregates


@query("select o_orderkey, round(p, 4) as average_price from orders, (select avg(o_totalprice) as p from orders where o_orderstatus = 'F') where p > 1000 and o_orderstatus = 'O' and o_totalprice > 1.5 * p")
def calculate_having(spark, d):
    view = orders(spark, d)
    mean = A.calculate(view.df.where("o_orderstatus = 'F'"), "p", "average", "o_totalprice")
    out = Detect("dear", attr("o_orderstatus") == "O", scalars=[mean], having=(F.col("p") > 1000) & (F.col("o_totalprice") > 1.5 * F.col("p"))).run(view)
    return out.select("o_orderkey", r("p").alias("average_price"))


@query("""select c_nationkey, count(*)::double as n, round(sum(c_acctbal), 2) as total, round(avg(c_acctbal), 4) as mean, min(c_acctbal) as low, max(c_acctbal) as high from customer group by c_nationkey""")
def group_aggregate(spark, d):
    b = ("sum", "c_acctbal"), ("avg", "c_acctbal"), ("min", "c_acctbal"), ("max", "c_acctbal")
    out = A.group(customers(spark, d).df, ["c_nationkey"], n=("count", None), total=b[0], mean=b[1], low=b[2], high=b[3])
    return out.withColumn("total", r("total", 2)).withColumn("mean", r("mean"))


@query("""select user_id, round(sum(i * value) / sum(i), 4) as wma from (select user_id, value, row_number() over (partition by user_id order by ts, event_id) as i from events where value is not null) group by user_id""")
def wma_rate(spark, d):
    return A.weighted_moving_average(events(spark, d), "value", ["ts", "event_id"], ["user_id"]).withColumn("wma", r("wma"))


@query("select o_custkey from orders group by o_custkey having bool_and(coalesce(o_totalprice > 20000, false))")
def for_all_orders(spark, d):
    return A.quantified(orders(spark, d).df, "o_custkey", F.col("o_totalprice") > 20000, "all")


# Statistics


@query("select event_id, round((value - m) / s, 4) as z from events, (select avg(value) as m, stddev_pop(value) as s from events) where abs(value - m) / s > 2.5")
def anomaly_zscore(spark, d):
    return stats.zscore(events(spark, d), "value").where("flagged").select("event_id", r("z").alias("z"))


@query("""select event_id, user_id, round((value - m) / s, 4) as z from events join (select user_id, avg(value) as m, stddev_pop(value) as s, count(value) as n from events group by user_id) using (user_id) where n >= 3 and s > 0 and abs(value - m) / s > 2.5""")
def anomaly_zscore_grouped(spark, d):
    return stats.zscore(events(spark, d), "value", ["user_id"]).where("flagged").select("event_id", "user_id", r("z").alias("z"))


_GRUBBS = ", ".join(f"({n}, {g}::double)" for n, g in stats.GRUBBS[0.05].items())


@query(f"""with t(n, g) as (values {_GRUBBS}), s as (select user_id, avg(value) as m, stddev_samp(value) as sd, count(value) as n from events group by user_id),
c as (select s.*, coalesce((select g from t where t.n = s.n), lo.g + (s.n - lo.n) * (hi.g - lo.g) / (hi.n - lo.n)) as crit from s
  asof left join t lo on s.n >= lo.n left join lateral (select n, g from t where t.n > s.n order by n limit 1) hi on true)
select event_id, user_id, round(abs(value - m) / sd, 4) as g, round(crit, 4) as g_crit from events join c using (user_id) where sd > 0 and abs(value - m) / sd > crit""")
def anomaly_grubbs(spark, d):
    out = stats.grubbs(events(spark, d), "value", ["user_id"]).where("flagged")
    return out.select("event_id", "user_id", r("g").alias("g"), r("g_crit").alias("g_crit"))


@query("""with t as (select quantile_cont(o_totalprice, 0.95) as threshold from orders where o_orderstatus = 'O') select o_orderkey, o_totalprice, round(threshold, 4) as threshold from orders, t where o_orderstatus = 'O' and o_totalprice > threshold""")
def learned_threshold(spark, d):
    out = Detect("dear open orders", attr("o_orderstatus") == "O", statistics=[lambda df: stats.learned_threshold(df, "o_totalprice", 95)]).run(orders(spark, d))
    return out.select("o_orderkey", "o_totalprice", r("threshold").alias("threshold"))


@query("""with c as (select covar_pop(p_partkey, p_retailprice) / sqrt(var_pop(p_partkey) * var_pop(p_retailprice)) as r from part) select p_partkey, round(r, 4) as r from part, c where r >= 0.1""")
def correlation_gate(spark, d):
    return stats.correlates_with(parts(spark, d).df, "p_partkey", "p_retailprice", 0.1).select("p_partkey", r("r").alias("r"))


@query("""with recursive day as (select c_nationkey as series, date_trunc('month', o_orderdate)::date as m, sum(o_totalprice) as x from orders join customer on o_custkey = c_custkey group by 1, 2),
n as (select series, x, row_number() over (partition by series order by m) as i from day),
h(series, i, level, trend) as (
  select a.series, 1::bigint, a.x, b.x - a.x from n a join n b on a.series = b.series and a.i = 1 and b.i = 2
  union all
  select h.series, h.i + 1, 0.3 * n.x + 0.7 * (h.level + h.trend), 0.1 * (0.3 * n.x + 0.7 * (h.level + h.trend) - h.level) + 0.9 * h.trend from h join n on n.series = h.series and n.i = h.i + 1),
f as (select *, row_number() over (partition by series order by i desc) as k from h)
select series, i::int as points, round(level, 2) as level, round(trend, 2) as trend, coalesce((select min(k) from range(0, 366) t(k) where level + k * trend <= 100000), 365)::int as steps,
  case when (select min(k) from range(0, 366) t(k) where level + k * trend <= 100000) is null then 0.0 else 1.0 end::double as confidence from f where k = 1""")
def forecast_holt(spark, d):
    monthly = orders(spark, d).df.join(customers(spark, d).df, F.col("o_custkey") == F.col("c_custkey"))
    monthly = monthly.groupBy(F.col("c_nationkey").alias("series"), F.trunc("o_orderdate", "month").alias("m")).agg(F.sum("o_totalprice").alias("x"))
    out = stats.forecast(monthly, ["series"], ["m"], "x", "<=", 100000.0)
    return out.withColumn("level", r("level", 2)).withColumn("trend", r("trend", 2))


@query("""with m as (select lag(event_type) over (partition by user_id order by ts, event_id) as a, event_type as b from events), c as (select a as from_state, b as to_state, count(*) as n from m where a is not null group by 1, 2)
select from_state, to_state, n::bigint as n, round(n / sum(n) over (partition by from_state), 6) as p from c""")
def markov_transition(spark, d):
    out = stats.markov_transitions(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")
    return out.withColumn("p", r("p", 6))


@query("""with recursive m as (select lag(event_type) over (partition by user_id order by ts, event_id) as a, event_type as b from events), c as (select a, b, count(*) as n from m where a is not null group by 1, 2),
t as (select a, b, n / sum(n) over (partition by a) as p from c),
s1 as (select b as s, p from t where a = 'view'), s2 as (select t.b as s, sum(s1.p * t.p) as p from s1 join t on t.a = s1.s group by t.b), s3 as (select t.b as s, sum(s2.p * t.p) as p from s2 join t on t.a = s2.s group by t.b)
select s as state, round(p, 6) as p from s3""")
def markov_forecast(spark, d):
    t = stats.markov_transitions(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type")
    return stats.markov_after(recursion.cut(t), "view", 3).withColumn("p", r("p", 6))


@query()
def hmm_score(spark, d):
    emit = [{"view": 0.6, "click": 0.3, "purchase": 0.05, "signup": 0.04, "error": 0.01}, {"view": 0.2, "click": 0.1, "purchase": 0.1, "signup": 0.1, "error": 0.5}]
    out = stats.hmm_score(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", [0.9, 0.1], [[0.8, 0.2], [0.3, 0.7]], emit, -100.0)
    return out.select("user_id", r("log_likelihood").alias("log_likelihood"), r("anomaly").alias("anomaly"))


@query("""with s as (select abs(value - m) / sd as z, event_type = 'purchase' as e from events, (select avg(value) as m, stddev_pop(value) as sd from events)), g as (select round(0.5 + k * 0.01, 9) as t from range(0, 351) x(k)),
f as (select t, coalesce(sum(case when z > t and e then 1.0 else 0 end), 0) as tp, sum(case when z > t then 1.0 else 0 end) as fl, sum(case when e then 1.0 else 0 end) as pos from g, s group by t),
q as (select t, case when fl + pos = 0 then 0.0 else 2 * tp / (fl + pos) end as f1 from f)
select t::double as threshold, round(f1::double, 6) as f1 from q order by round(f1::double, 9) desc, t limit 1""")
def tune_threshold(spark, d):
    scored = stats.zscore(events(spark, d), "value").select(F.abs("z").alias("score"), (F.col("event_type") == "purchase").alias("expected"))
    return stats.tune_threshold(scored, "score", "expected").withColumn("f1", r("f1", 6))


@query("""with f as (select coalesce(abs(value - m) / sd > 1.5, false) as f, event_type = 'purchase' as e from events, (select avg(value) as m, stddev_pop(value) as sd from events)), s as (select sum((f and e)::int)::double as tp, sum((f and not e)::int)::double as fp, sum((not f and e)::int)::double as fn from f)
select round(coalesce(tp / nullif(tp + fp, 0), 0), 6) as precision, round(coalesce(tp / nullif(tp + fn, 0), 0), 6) as recall, round(coalesce(2 * tp / nullif(2 * tp + fp + fn, 0), 0), 6) as f1 from s""")
def detection_quality(spark, d):
    scored = stats.zscore(events(spark, d), "value", threshold=1.5).withColumn("expected", F.col("event_type") == "purchase")
    out = stats.quality_of(scored, "flagged", "expected")
    return out.select(*[r(c, 6).alias(c) for c in out.columns])


# Sequences and history


@query("""select distinct v.user_id from events v join events c on c.user_id = v.user_id and c.event_type = 'click' and (c.ts, c.event_id) > (v.ts, v.event_id) join events p on p.user_id = c.user_id and p.event_type = 'purchase' and (p.ts, p.event_id) > (c.ts, c.event_id)
where v.event_type = 'view' and p.ts - v.ts <= interval 1 day""")
def event_sequence(spark, d):
    return sequences.event_sequence(events(spark, d), "user_id", "ts", "event_id", "event_type", ["view", "click", "purchase"], 1).select("user_id")


@query("""select distinct f.o_custkey from orders f join orders o on f.o_custkey = o.o_custkey and f.o_orderstatus = 'F' and o.o_orderstatus = 'O' and (o.o_orderdate, o.o_orderkey) > (f.o_orderdate, f.o_orderkey) where o.o_orderdate - f.o_orderdate <= interval 30 day""")
def record_sequence(spark, d):
    return sequences.event_sequence(orders(spark, d).df, "o_custkey", "o_orderdate", "o_orderkey", "o_orderstatus", ["F", "O"], 30).select("o_custkey")


@query("""with w as (select user_id, count(*) over (partition by user_id order by epoch_us(ts) // 1000000 range between 259200 preceding and current row) as n from events where event_type = 'error') select user_id, max(n)::bigint as most from w group by user_id having max(n) >= 4""")
def burst_pattern(spark, d):
    return sequences.burst(events(spark, d).where("event_type = 'error'"), ["user_id"], "ts", 4, 3)


@query("""with w as (select event_id, user_id, event_type, lag(event_type) over (partition by user_id order by ts, event_id) as was from events) select event_id, user_id, was from w where event_type = 'error' and was <> 'error'""")
def status_changed(spark, d):
    return sequences.changed_to(events(spark, d), ["user_id"], ["ts", "event_id"], "event_type", "error").select("event_id", "user_id", "was")


@query("select c_custkey from customer where exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def has_open_record(spark, d):
    records = orders(spark, d).df.withColumnRenamed("o_custkey", "c_custkey")
    return sequences.has_record(customers(spark, d).df.select("c_custkey"), records, "c_custkey", F.col("o_orderstatus") == "P")


@query("select c_custkey from customer where not exists (select 1 from orders where o_custkey = c_custkey and o_orderstatus = 'P')")
def has_no_record(spark, d):
    records = orders(spark, d).df.withColumnRenamed("o_custkey", "c_custkey")
    return sequences.has_record(customers(spark, d).df.select("c_custkey"), records, "c_custkey", F.col("o_orderstatus") == "P", negate=True)


def order_log(spark: SparkSession, d: str) -> DataFrame:
    """The status of each customer's latest order as facts."""
    return factlog.log(orders(spark, d).df, "o_custkey", "status", "o_orderstatus", "o_orderdate", "o_orderkey")


@query("""select o_custkey as entity, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as status from orders where o_orderdate <= timestamp '1998-01-01' group by o_custkey""")
def fact_history(spark, d):
    return factlog.as_of(order_log(spark, d), F.lit(NOW).cast("timestamp")).select("entity", F.col("value").alias("status"))


@query("""with n as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders group by o_custkey), p as (select o_custkey, arg_max(o_orderstatus, (o_orderdate, o_orderkey)) as s from orders where o_orderdate <= timestamp '1998-01-01' group by o_custkey)
select n.o_custkey as id from n join p using (o_custkey) where n.s = 'F' and p.s = 'O'""")
def asof_intersect(spark, d):
    facts = order_log(spark, d)
    now = factlog.as_of(facts).where("value = 'F'").select(F.col("entity").alias("id"))
    return factlog.was(now, facts, F.lit(NOW).cast("timestamp"), F.col("value") == "O")


@query("""with e as (select user_id, event_type = 'error' as gone, ts, event_id, event_type from events), l as (select user_id, arg_max(event_type, (ts, event_id)) as t, arg_max(gone, (ts, event_id)) as gone from e group by user_id) select user_id as entity, t as value from l where not gone""")
def fact_retraction(spark, d):
    rows = events(spark, d)
    asserted = factlog.log(rows.where("event_type <> 'error'"), "user_id", "last", "event_type", "ts", "event_id")
    gone = factlog.retract(rows.where("event_type = 'error'"), "user_id", "ts", "event_id", "last")
    return factlog.as_of(asserted.unionByName(gone)).select("entity", "value")


_GONE = "with e as (select user_id, event_type, value, ts, event_id, event_type = 'error' as gone from events), g as (select user_id, max((ts, event_id)) as o from e where gone group by user_id)"


@query(_GONE + """, l as (select e.user_id, event_type, arg_max(round(value, 2), (ts, event_id)) as v, max((ts, event_id)) as o from e where not gone group by all)
select l.user_id as entity, event_type as attribute, v::double as value from l left join g using (user_id) where g.o is null or l.o > g.o""")
def entity_retraction(spark, d):
    """The last value of each kind of event of a user; an error takes back all that is known of the user."""
    rows = events(spark, d)
    asserted = factlog.log(rows.where("event_type <> 'error'").withColumn("v", F.round("value", 2)), "user_id", F.col("event_type"), "v", "ts", "event_id")
    gone = factlog.retract(rows.where("event_type = 'error'"), "user_id", "ts", "event_id")
    return factlog.as_of(asserted.unionByName(gone)).select("entity", "attribute", F.col("value").cast("double").alias("value"))


@query("select user_id as entity, max(ts) as last_written from events group by user_id having max(ts) < timestamp '2024-01-30' - interval 12 hour")
def freshness_stale(spark, d):
    facts = factlog.log(events(spark, d), "user_id", "seen", "event_type", "ts", "event_id")
    out = factlog.stale(facts, F.lit("2024-01-30").cast("timestamp"), F.expr("interval 12 hours"))
    return out.select("entity", F.col("last_written").cast("timestamp_ntz").alias("last_written"))


@query("""with c as (select user_id, event_type, event_id, ts, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events) select event_id, user_id as entity, case when prev is null then 'assert' else 'change' end as kind, event_type as value, prev from c where prev is null or prev <> event_type""")
def stream_change_feed(spark, d):
    facts = factlog.log(events(spark, d), "user_id", "status", "event_type", "ts", "event_id")
    return factlog.changes(facts).select(F.col("seq").alias("event_id"), "entity", "kind", "value", "prev")


@query("""with c as (select user_id, event_type, event_id, ts, lag(event_type) over (partition by user_id order by ts, event_id) as prev from events), f as (select * from c where prev is null or prev <> event_type)
select event_id, user_id as entity, 'after purchase' as rule from f where prev = 'purchase' and event_type = 'error' union all select event_id, user_id, 'signed up' from f where event_type = 'signup' and prev is not null""")
def reactive_rules(spark, d):
    facts = factlog.log(events(spark, d), "user_id", "status", "event_type", "ts", "event_id")
    rules = [feed.On("after purchase", "change", "status", to="error", when=F.col("prev") == "purchase"), feed.On("signed up", "change", "status", to="signup")]
    return feed.dispatch(factlog.changes(facts), rules).select(F.col("seq").alias("event_id"), "entity", "rule")


@query("""select c_custkey as id, 'balance ' || case when c_acctbal = floor(c_acctbal) then floor(c_acctbal)::bigint::varchar else c_acctbal::varchar end || ' of ' || (c_custkey * 2)::varchar as label from customer""")
def label_numbers(spark, d):
    """Numbers in labels: whole ones have no fraction."""
    rows = customers(spark, d).df
    label = S.template("balance {money} of {twice}", {"money": F.col("c_acctbal"), "twice": F.col("c_custkey").cast("double") * 2})
    return rows.select(F.col("c_custkey").alias("id"), label.alias("label"))


@query("""select c_custkey as id, c_mktsegment, c_acctbal from customer""")
def fact_roundtrip(spark, d):
    view = customers(spark, d)
    return from_facts(to_facts(view), {"c_mktsegment": "string", "c_acctbal": "double"})


@query("""select event_id as entity, 'event_type' as attribute, event_type as value from events where event_type is not null union all select event_id, 'user_id', user_id::varchar from events union all select event_id, 'type', 'event' from events union all select event_id, 'tag', 'import' from events""")
def collect_ingest(spark, d):
    """Answers with lists of items, one for each user, become facts."""
    item = F.struct(F.col("event_id").alias("id"), "event_type", "user_id", F.array(F.lit(1)).alias("nested"))
    answers = events(spark, d).groupBy("user_id").agg(F.to_json(F.struct(F.collect_list(item).alias("items"))).alias("body"))
    return ingest.collect(answers, "body", "event", "import")


@query("""with l as (select user_id, max(ts) as t, arg_max(event_type, (ts, event_id)) as v from events group by user_id) select user_id as entity, case when t < timestamp '2024-01-30' - interval 12 hour then 'checked' else v end as value from l""")
def enrich_stale(spark, d):
    """Users not seen for half a day get a fresh answer, the others keep what they have."""
    facts = factlog.log(events(spark, d), "user_id", "seen", "event_type", "ts", "event_id")
    answers = facts.select("entity").distinct().withColumn("value", F.lit("checked"))
    return factlog.as_of(ingest.refresh(facts, answers, F.lit("2024-01-30").cast("timestamp"), F.expr("interval 12 hours"), "seen")).select("entity", "value")


@query("""select c_custkey, '{"c_custkey":' || c_custkey || ',"c_mktsegment":"' || c_mktsegment || '"' || coalesce(',"orders":[' || string_agg('{"o_orderkey":' || o_orderkey || ',"o_orderstatus":"' || o_orderstatus || '"}', ',' order by o_orderkey) || ']', '') || '}' as document
from customer left join orders on o_custkey = c_custkey group by c_custkey, c_mktsegment""")
def pull_documents(spark, d):
    children = {"orders": (orders(spark, d).df, "o_custkey", ["o_orderkey", "o_orderstatus"], ["o_orderkey"])}
    return ingest.pull(customers(spark, d), ["c_mktsegment"], children)


# Recursion


def places(spark: SparkSession, d: str) -> DataFrame:
    regions = read_table(spark, d, "region").select(F.col("r_name").alias("name"), F.lit(None).cast("string").alias("parent"))
    nations = read_table(spark, d, "nation").join(read_table(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_name").alias("name"), F.col("r_name").alias("parent"))
    return regions.unionByName(nations)


def placed(spark: SparkSession, d: str) -> DataFrame:
    return customers(spark, d).df.join(read_table(spark, d, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")


_BELOW = "with recursive t(name, parent) as (select r_name, null::varchar from region union all select n_name, r_name from nation join region on n_regionkey = r_regionkey), b(name) as (select (select min(r_name) from region) union select t.name from t join b on t.parent = b.name)"


@query(_BELOW + " select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where n_name in (select name from b)")
def category_tree(spark, d):
    root = read_table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return recursion.in_category(placed(spark, d), "n_name", places(spark, d), root).select("c_custkey", "n_name")


@query(_BELOW + " select c_custkey, n_name from customer join nation on c_nationkey = n_nationkey where n_name not in (select name from b)")
def category_tree_not(spark, d):
    root = read_table(spark, d, "region").agg(F.min("r_name")).first()[0]
    return recursion.in_category(placed(spark, d), "n_name", places(spark, d), root, negate=True).select("c_custkey", "n_name")


@query("""with recursive n as (select count(*) as n from part), e as (select p_partkey as s, (p_partkey * 7 + 3) % n as t from part, n where p_size > 10), r(seed, node) as (
  select s, t from e where s in (select p_partkey from part where p_size = 50) union select r.seed, e.t from r join e on e.s = r.node) select seed, node from r""")
def recursion_reach(spark, d):
    part = parts(spark, d).df
    edges = part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).where("p_size > 10").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst"))
    return recursion.reachable(edges, part.where("p_size = 50").select(F.col("p_partkey").alias("seed")))


_CHAIN = "with recursive n as (select min(p_partkey) as lo, max(p_partkey) as hi from part), t as (select p_partkey as c, case when p_partkey > lo then p_partkey - 1 else hi end as p from part, n)"


@query(_CHAIN + ", b(c) as (select lo from n union select t.c from t join b on t.p = b.c) select c::varchar as name from b")
def category_cycle(spark, d):
    """All below a root in a tree of parents that is one long ring: many levels, and a cycle."""
    part = parts(spark, d).df
    ends = part.agg(F.min("p_partkey").alias("lo"), F.max("p_partkey").alias("hi"))
    ring = part.crossJoin(F.broadcast(ends)).select(F.col("p_partkey").alias("name"), F.when(F.col("p_partkey") > F.col("lo"), F.col("p_partkey") - 1).otherwise(F.col("hi")).alias("parent"))
    return recursion.descendants(ring, str(ends.first()["lo"]))


@query("""select distinct o_orderkey as id, r_name as region from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey join region on n_regionkey = r_regionkey
union select s_suppkey, r_name from supplier join nation on s_nationkey = n_nationkey join region on n_regionkey = r_regionkey where s_acctbal > 0""")
def rule_join(spark, d):
    """Where an order or a solvent supplier belongs: two rules of one name, joins over shared variables, a guard."""
    facts = {
        "orders": orders(spark, d).df.select("o_orderkey", "o_custkey"),
        "customer": customers(spark, d).df.select("c_custkey", "c_nationkey"),
        "supplier": read_table(spark, d, "supplier").select("s_suppkey", "s_nationkey", "s_acctbal"),
        "nation": read_table(spark, d, "nation").select("n_nationkey", "n_regionkey"),
        "region": read_table(spark, d, "region").select("r_regionkey", "r_name"),
    }
    atom = lambda relation, *terms: recursion.Atom(relation, terms)
    place = (atom("nation", "n", "r"), atom("region", "r", "name"))
    rules = [
        recursion.Rule(atom("belongs", "o", "name"), (atom("orders", "o", "c"), atom("customer", "c", "n"), *place)),
        recursion.Rule(atom("belongs", "s", "name"), (atom("supplier", "s", "n", "money"), *place), F.col("money") > 0),
    ]
    return recursion.solve(rules, facts)["belongs"].toDF("id", "region")


@query("""with recursive n as (select count(*) as n from part), e as (select p_partkey as s, (p_partkey * 7 + 3) % n as t from part, n where p_size > 10),
  r(node, k) as (select p_partkey, 0 from part where p_size = 50 union select e.t, 1 - r.k from r join e on e.s = r.node) select node, case when k = 0 then 'even' else 'odd' end as steps from r""")
def mutual_recursion(spark, d):
    """Parts that lie an even or an odd number of steps from a start: two relations that define each other."""
    part = parts(spark, d).df
    edges = part.crossJoin(F.broadcast(part.agg(F.count("*").alias("n")))).where("p_size > 10").select(F.col("p_partkey").alias("src"), ((F.col("p_partkey") * 7 + 3) % F.col("n")).alias("dst"))
    facts = {"edge": edges, "start": part.where("p_size = 50").select("p_partkey")}
    atom = lambda relation, *terms: recursion.Atom(relation, terms)
    step = atom("edge", "x", "y")
    rules = [recursion.Rule(atom("even", "x"), (atom("start", "x"),)), recursion.Rule(atom("odd", "y"), (atom("even", "x"), step)), recursion.Rule(atom("even", "y"), (atom("odd", "x"), step))]
    found = recursion.solve(rules, facts)
    return found["even"].toDF("node").withColumn("steps", F.lit("even")).unionByName(found["odd"].toDF("node").withColumn("steps", F.lit("odd")))


@query()
def wellfounded_win(spark, d):
    """Who wins a game of moves between customers: one wins who can move to one that doesn't."""
    rows = customers(spark, d).df
    n = rows.agg(F.count("*").alias("n"))
    rows = rows.crossJoin(F.broadcast(n)).select("c_custkey", ((F.col("c_custkey") * 5 + 2) % F.col("n")).alias("a"), ((F.col("c_custkey") * 3 + 7) % F.col("n")).alias("b"), "c_acctbal")
    moves = rows.where("c_acctbal > 3000").select(F.col("c_custkey").alias("x"), F.explode(F.array("a", "b")).alias("y"))
    rules = moves.select(F.col("x").alias("head"), F.array().cast("array<bigint>").alias("pos"), F.array("y").alias("neg"))
    return recursion.well_founded(rules)


# Models


def vectors(spark: SparkSession, d: str) -> DataFrame:
    wide = read_table(spark, d, "embeddings")
    return wide.select("vec_id", F.col("label").cast("string").alias("label"), *[F.col("embedding")[i].cast("double").alias(f"f{i}") for i in range(64)], "embedding")


def training(v: DataFrame) -> DataFrame:
    """All rows with a label."""
    return v.where("label is not null")


_KNN = ["avg(f{0}) m{0}", "stddev_pop(f{0}) s{0}", "(f{0} - m{0}) / s{0} as z{0}", "(x.z{0} - t.z{0}) * (x.z{0} - t.z{0})", "embedding[{1}]::double as f{0}"]
_KNN = {k: t.join(p.format(i, i + 1) for i in range(64)) for k, p, t in zip(("m", "s", "z", "d", "f"), _KNN, (", ", ", ", ", ", " + ", ", "), strict=True)}


@query(f"""with e as (select vec_id, label::varchar as label, {_KNN["f"]} from embeddings),
c as (select vec_id from e where label is not null),
v as (select * from e union all select * from e where vec_id in (from c)), s as (select {_KNN["m"]}, {_KNN["s"]} from v),
z as (select vec_id, label, {_KNN["z"]} from e, s), t as (select * from z where vec_id in (from c)),
p as (select x.vec_id, t.label, row_number() over (partition by x.vec_id order by round(sqrt({_KNN["d"]}), 9), t.vec_id) as k from z x, t),
n as (select vec_id, label, count(*) as n from p where k <= 5 group by 1, 2), q as (select *, row_number() over (partition by vec_id order by n desc, label) as k from n)
select vec_id, label, round(n / 5.0, 6)::double as confidence from q where k = 1 and n >= 3""")
def knn_classify(spark, d):
    v = vectors(spark, d)
    out = models.knn_classify(v, training(v), "vec_id", "label", [f"f{i}" for i in range(64)], 5, 0.6)
    return out.withColumn("confidence", r("confidence", 6))


@query("""select p_partkey, case when p_size <= 20 then case when p_retailprice <= 1100 then 'low' else 'mid' end else 'high' end as label, case when p_size <= 20 then case when p_retailprice <= 1100 then 0.9 else 0.7 end else 0.8 end::double as confidence from part where not (p_size <= 20 and p_retailprice > 1100)""")
def tree_fitted(spark, d):
    leaf = lambda label, c: models.Split(label=label, confidence=c)
    tree = models.Split("p_size", 20.0, models.Split("p_retailprice", 1100.0, leaf("low", 0.9), leaf("mid", 0.7)), leaf("high", 0.8))
    return models.predict(parts(spark, d).df, tree, 0.8).select("p_partkey", "label", "confidence")


@query()
def tree_predict(spark, d):
    v = vectors(spark, d)
    tree = models.fit_tree(training(v), "vec_id", "label", [f"f{i}" for i in range(64)])
    return models.predict(v, tree, 0.4).select("vec_id", "label", "confidence")


@query("""with c as (select i, avg(embedding[i]::double) as x from embeddings, range(1, 65) t(i) group by i), l as (select list(x order by i) as c from c),
s as (select vec_id, list_sum(list_transform(list_zip(embedding, c), lambda p: p[1]::double * p[2])) / sqrt(list_sum(list_transform(embedding, lambda p: p::double * p::double)) * list_sum(list_transform(c, lambda p: p * p))) as s from embeddings, l)
select vec_id, round(s, 6) as similarity from s where s >= 0.2""")
def similar_cosine(spark, d):
    out = models.similar_to_centroid(vectors(spark, d), "vec_id", "embedding", 0.2)
    return out.withColumn("similarity", r("similarity", 6))


@query("""with s as (select vec_id as seed, embedding as v from embeddings where vec_id % 100 = 0), p as (select seed, vec_id, round(1 - list_sum(list_transform(list_zip(embedding, v), lambda p: p[1]::double * p[2]::double)) / sqrt(list_sum(list_transform(embedding, lambda p: p::double * p::double)) * list_sum(list_transform(v, lambda p: p::double * p::double))), 9) as distance from embeddings, s where vec_id <> seed),
q as (select *, row_number() over (partition by seed order by distance, vec_id) as k from p) select seed, vec_id, round(distance, 6) as distance from q where k <= 10""")
def vector_topk(spark, d):
    v = vectors(spark, d)
    return models.vector_topk(v, v.where("vec_id % 100 = 0"), "vec_id", "embedding", 10).withColumn("distance", r("distance", 6))


@query("""with recursive p as (select s_suppkey as id, s_acctbal as x from supplier), n as (select a.id as a, b.id as b from p a join p b on abs(a.x - b.x) <= 100), core as (select a as id from n group by a having count(*) >= 3),
l as (select a, b from n where a in (from core) and b in (from core)), r(id, c) as (select id, id from core union select l.a, r.c from l join r on l.b = r.id), m as (select id, min(c) as c from r group by id),
o as (select c, dense_rank() over (order by c) - 1 as k from (select distinct c from m)), x as (select n.a as id, min(m.c) as c from n join m on n.b = m.id group by n.a)
select p.id, coalesce(o.k, -1)::int as cluster from p left join x on p.id = x.id left join o on o.c = x.c""")
def cluster_dbscan(spark, d):
    return models.dbscan(read_table(spark, d, "supplier"), "s_suppkey", ["s_acctbal"], 100.0, 3)


_PPR = """with recursive c as (select s_suppkey as e, 'n' as a, s_nationkey::varchar as v from supplier union all select s_suppkey, 'b', floor(s_acctbal / 500)::varchar from supplier),
k as (select a, v from c group by a, v having count(*) between 2 and 500), g as (select x.e as src, y.e as dst, count(*)::double as w from c x join k using (a, v) join c y on x.a = y.a and x.v = y.v and x.e <> y.e group by 1, 2),
f as (select src, dst, w / sum(w) over (partition by src) as share from g), nodes as (select distinct src as node from g), home as (select node, 1.0::double / count(*) over () as r from nodes where node < 5),
s(k, node, score) as (select 0, node, r from home union all
  select k, node, sum(x) from (
    select k, node, x from (select k + 1 as k, dst as node, 0.85 * sum(score * share) as x from s join f on src = node group by all)
    union all select n.k, home.node, r * (1 - n.moved) from home, (select k + 1 as k, 0.85 * sum(score * share) as moved from s join f on src = node group by all) n) where k <= 100 group by all),
d as (select coalesce(a.k, b.k + 1) as k, sum(abs(coalesce(a.score, 0) - coalesce(b.score, 0))) as gap from (from s where k > 0) a full join s b on a.k = b.k + 1 and a.node = b.node group by 1),
z as (select coalesce(min(k), 100) as k from d where gap < 1e-6 and k <= 100)
select node, round(score, 9) as score from s where k = (select k from z) and node not in (select node from home) order by score desc, node limit 10"""


@query(_PPR)
def related_ppr(spark, d):
    suppliers = read_table(spark, d, "supplier")
    nation = suppliers.select(F.col("s_suppkey").alias("entity"), F.lit("n").alias("attribute"), F.col("s_nationkey").cast("string").alias("value"))
    band = suppliers.select(F.col("s_suppkey").alias("entity"), F.lit("b").alias("attribute"), F.floor(F.col("s_acctbal") / 500).cast("string").alias("value"))
    edges = graph.shared_value_edges(nation.unionByName(band))
    seeds = suppliers.where("s_suppkey < 5").select(F.col("s_suppkey").alias("node"))
    return graph.related(edges, seeds, digits=9)


# Optimisation


@query("select p_partkey as id from part a where not exists (select 1 from part b where b.p_retailprice <= a.p_retailprice and b.p_size >= a.p_size and (b.p_retailprice < a.p_retailprice or b.p_size > a.p_size))")
def pareto_front(spark, d):
    return optimize.pareto_front(parts(spark, d).df, "p_partkey", {"p_retailprice": "min", "p_size": "max"})


@query("""select o_orderkey as id from orders a where not exists (select 1 from orders b where b.o_totalprice >= a.o_totalprice and b.o_orderdate <= a.o_orderdate and b.o_custkey <= a.o_custkey and (b.o_totalprice > a.o_totalprice or b.o_orderdate < a.o_orderdate or b.o_custkey < a.o_custkey))""")
def pareto_front_three(spark, d):
    df = orders(spark, d).df.withColumn("day", sequences.seconds(F.col("o_orderdate")))
    return optimize.pareto_front(df, "o_orderkey", {"o_totalprice": "max", "day": "min", "o_custkey": "min"})


@query("""with p as (select p_partkey as id, p_retailprice as x, -p_size as y from part),
f0 as (select id from p a where not exists (select 1 from p b where b.x <= a.x and b.y <= a.y and (b.x < a.x or b.y < a.y))), p1 as (select * from p where id not in (from f0)),
f1 as (select id from p1 a where not exists (select 1 from p1 b where b.x <= a.x and b.y <= a.y and (b.x < a.x or b.y < a.y))), p2 as (select * from p1 where id not in (from f1)),
f2 as (select id from p2 a where not exists (select 1 from p2 b where b.x <= a.x and b.y <= a.y and (b.x < a.x or b.y < a.y)))
select id, 0::int as rank from f0 union all select id, 1 from f1 union all select id, 2 from f2""")
def pareto_rank(spark, d):
    return optimize.pareto_rank(parts(spark, d).df, "p_partkey", {"p_retailprice": "min", "p_size": "max"}, ranks=3)


@query("""with t as (select a.o_custkey, a.o_totalprice + b.o_totalprice + c.o_totalprice as total from orders a join orders b on a.o_custkey = b.o_custkey and a.o_orderkey < b.o_orderkey join orders c on b.o_custkey = c.o_custkey and b.o_orderkey < c.o_orderkey)
select o_custkey as group, round(max(total), 2) as total from t where total <= 300000 group by o_custkey""")
def subset_exact(spark, d):
    """For each customer the three orders with the largest total within a budget."""
    return optimize.subsets(orders(spark, d).df, "o_custkey", "o_orderkey", 3, ("max", "o_totalprice"), [("o_totalprice", "<=", 300000.0)]).select("group", r("total", 2).alias("total"))


@query()
def subset_search(spark, d):
    """For each customer three orders with a large total within a budget, by seeded exchange."""
    out = optimize.subsets(orders(spark, d).df, "o_custkey", "o_orderkey", 3, ("max", "o_totalprice"), [("o_totalprice", "<=", 300000.0)], exact=False)
    return out.select("group", "ids", r("total", 2).alias("total"))


@query()
def route_tours(spark, d):
    """For each nation a short tour over its suppliers, placed by their balance and key."""
    rows = read_table(spark, d, "supplier").withColumn("y", F.col("s_suppkey") * 10.0)
    return optimize.tours(rows, "s_nationkey", "s_suppkey", "s_acctbal", "y").select("group", "stops", r("length").alias("length"))


# Policy


def order_rules() -> list[policy.Rule]:
    return [
        policy.Rule("auto", attr("o_orderstatus") == "O", "approve", {"order": "{o_orderkey}"}),
        policy.Rule("large", attr("o_totalprice") > 150000, "review", {"why": "total {o_totalprice}"}, "HIGH", ("auto",)),
        policy.Rule("urgent", attr("o_orderpriority") == "1-URGENT", "expedite", {}, "HIGH", ("auto",)),
        policy.Rule("audit", attr("o_totalprice") > 180000, "record", {}, strict=True),
    ]


_MATCHED = """m as (select o_orderkey as entity, 'auto' as rule, 'approve' as verb, 2 as priority from orders where o_orderstatus = 'O' union all select o_orderkey, 'large', 'review', 3 from orders where o_totalprice > 150000
  union all select o_orderkey, 'urgent', 'expedite', 3 from orders where o_orderpriority = '1-URGENT' union all select o_orderkey, 'audit', 'record', 2 from orders where o_totalprice > 180000)"""


@query(f"with {_MATCHED} select entity, rule, verb, priority from m")
def policy_actions(spark, d):
    return policy.matched(orders(spark, d), order_rules()).select("entity", "rule", "verb", "priority")


@query(f"with {_MATCHED} select entity, rule, verb from m where rule <> 'auto' or not exists (select 1 from m o where o.entity = m.entity and o.rule in ('large', 'urgent'))")
def defeasible(spark, d):
    rules = order_rules()
    return policy.resolve(policy.matched(orders(spark, d), rules), rules).select("entity", "rule", "verb")


@query(f"""with {_MATCHED} select rule as block, entity, verb || ' order ' || entity::varchar as action, 'rule ' || rule || ' holds' as why, case priority when 2 then 'MEDIUM' else 'HIGH' end as priority, 'rules' as source from m where rule in ('urgent', 'audit')""")
def decisions_export(spark, d):
    hits = policy.matched(orders(spark, d), order_rules()).where("rule in ('urgent', 'audit')")
    return policy.decisions(hits, "{verb} order {entity}")


@query("""select o_orderkey as entity, case when not coalesce(o_totalprice > 0, false) then 'reject' when not coalesce(o_orderstatus in ('O', 'F'), false) then 'quarantine' when not coalesce(o_totalprice < 150000, false) then 'warn' else 'accept' end as verdict from orders""")
def constraint_verdict(spark, d):
    rules = [("positive", attr("o_totalprice") > 0, "reject"), ("status", attr("o_orderstatus").isin("O", "F"), "quarantine"), ("size", attr("o_totalprice") < 150000, "warn")]
    return policy.verdicts(orders(spark, d), rules).select("entity", "verdict")


@query("""select o_orderkey as entity, case when o_totalprice > 180000 then 'block' when o_orderpriority = '1-URGENT' then 'requires' else 'allow' end as decision,
  case when o_totalprice > 180000 then 'total is ' || case when o_totalprice = floor(o_totalprice) then o_totalprice::bigint::varchar else o_totalprice::varchar end when o_orderpriority = '1-URGENT' then 'needs a second look' else '' end as reasons from orders""")
def judgements(spark, d):
    rules = [policy.Judgement("dear", attr("o_totalprice") > 180000, "block", "total is {o_totalprice}", "before ship"), policy.Judgement("urgent", attr("o_orderpriority") == "1-URGENT", "requires", "needs a second look")]
    return policy.judge(orders(spark, d), rules).withColumn("reasons", F.array_join("reasons", "; "))


@query("""select o_orderkey as entity, o_orderstatus as before, case when o_orderstatus = 'O' and o_totalprice < 50000 then 'P' when o_orderstatus = 'P' and o_orderdate < timestamp '1998-01-01' then 'F' else o_orderstatus end as after, case when coalesce(o_totalprice > 1000, false) then 0 else 1 end::int as violations from orders""")
def state_step(spark, d):
    moves = [("O", "P", attr("o_totalprice") < 50000), ("P", "F", Condition(lambda v: F.col("o_orderdate") < F.lit(NOW).cast("timestamp")))]
    out = policy.state_step(orders(spark, d), "o_orderstatus", moves, {"total": attr("o_totalprice") > 1000})
    return out.withColumn("violations", F.size("violations"))


@query("""select user_id, sum((event_type = 'purchase')::int)::bigint as accepts, sum((event_type = 'error')::int)::bigint as rejects, round(greatest(0.01, least(0.99, (0.3 + sum((event_type = 'purchase')::int)) / (1 + sum((event_type = 'purchase')::int) + sum((event_type = 'error')::int)))), 6)::double as probability
from events where ts >= timestamp '2024-01-10' group by user_id""")
def recommend_posterior(spark, d):
    rows = events(spark, d).where(F.col("ts") >= F.lit("2024-01-10").cast("timestamp"))
    return policy.posterior(rows, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", 0.3).withColumn("probability", r("probability", 6))


@query()
def recommend_gate(spark, d):
    rows = events(spark, d)
    scored = policy.posterior(rows, "user_id", F.col("event_type") == "purchase", F.col("event_type") == "error", 0.3)
    return policy.gate(scored, "user_id", "suggest", F.col("probability")).select("user_id", r("probability", 6).alias("probability"))


# Windows over event time, as the streaming operators compute them


@query("""select event_type, time_bucket(interval 1 hour, ts) as start, count(*)::bigint as n, round(sum(value), 2) as total from events group by 1, 2""")
def tumbling_counts(spark, d):
    out = feed.windowed(events(spark, d), "ts", "1 hour", ["event_type"], value="value")
    return out.select("event_type", F.col("start").cast("timestamp_ntz").alias("start"), "n", r("total", 2).alias("total"))


@query("""with g as (select user_id, ts, case when ts - lag(ts) over (partition by user_id order by ts) < interval 6 hour then 0 else 1 end as new from events), s as (select user_id, ts, sum(new) over (partition by user_id order by ts rows unbounded preceding) as k from g)
select user_id, min(ts) as start, count(*)::bigint as n from s group by user_id, k""")
def session_windows(spark, d):
    out = feed.sessions(events(spark, d), "ts", "6 hours", ["user_id"])
    return out.select("user_id", F.col("start").cast("timestamp_ntz").alias("start"), "n")
