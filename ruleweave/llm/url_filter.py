"""URL block and allow lists by host-suffix and path-prefix expressions, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import read

UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
#: Bytes of a digest that the equality join uses; the whole digest is compared afterwards.
PREFIX_HEX = 8
RULES = [("com", "/en/", "block"), ("example.com", "/en/7", "allow"), ("net", "/de/", "allow"), ("example.net", "/de/8", "block"), ("org", "/es/", "block")]


def url_host(url: Column) -> Column:
    """What follows the first `://` up to `/`, `?`, `#` or the end, with A-Z lower-cased; empty without `://` or url."""
    return F.coalesce(F.translate(F.regexp_extract(url, r"(?s)^.*?://([^/?#]*)", 1), UPPER, LOWER), F.lit(""))


def url_path(url: Column) -> Column:
    """What follows the host up to `?`, `#` or the end."""
    return F.coalesce(F.regexp_extract(url, r"(?s)^.*?://[^/?#]*([^?#]*)", 1), F.lit(""))


def _digest(host: Column, path: Column) -> Column:
    # No host holds a slash, so one slash parts both without doubt.
    return F.sha2(F.concat(host, F.lit("/"), path), 256)


def rule_table(spark: SparkSession, rules: list[tuple[str, str, str]] | None = None) -> DataFrame:
    return spark.createDataFrame(RULES if rules is None else rules, "host string, path string, action string")


def match_rules(urls: DataFrame, rules: DataFrame, url_col: str = "url", default: str = "allow") -> DataFrame:
    """urls with the columns host, path, rule and verdict added (an own column of such a name is replaced).

    A rule (host, path, action) fits its host and all subdomains, where the url's path starts with the rule's. The
    longest rule wins (host and path together), then the longer host, then block before allow. Without a fitting rule,
    `rule` is null and the verdict is `default`. A null or malformed url has an empty host and path and meets no rule.
    Rules without a host or action are void; repeated rules count once; an empty rule table leaves the default.

    Each distinct (host, path) is expanded into its host suffixes times the path prefixes of those lengths that rules
    have (few: no rule is longer than a url). The expansions meet the rules in an equality join on a short hash prefix,
    so no rule list, however long, has to be broadcast; Spark does that by itself for a list it knows to be small.
    """
    spec = rules.select(F.translate(F.col("host"), UPPER, LOWER).alias("r_host"), F.coalesce("path", F.lit("")).alias("r_path"), F.lower("action").alias("r_action")).where("r_host <> '' and r_action is not null")
    spec = spec.groupBy("r_host", "r_path").agg(F.max("r_action").alias("r_action"))
    spec = spec.withColumn("r_digest", _digest(F.col("r_host"), F.col("r_path"))).withColumn("prefix", F.substring("r_digest", 1, PREFIX_HEX))
    lengths = sorted(row["l"] for row in spec.select(F.char_length("r_path").alias("l")).distinct().collect())  # as many as path lengths

    own = [c for c in urls.columns if c not in ("host", "path", "rule", "verdict")]
    split = urls.select(*[F.col(f"`{c}`") for c in own], url_host(F.col(url_col)).alias("host"), url_path(F.col(url_col)).alias("path"))
    distinct = split.select("host", "path").where("host <> ''").distinct()
    labels = F.split("host", r"\.")
    hosts = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    known = F.array(*[F.lit(n) for n in lengths]).cast("array<int>")
    paths = F.transform(F.filter(known, lambda n: n <= F.char_length("path")), lambda n: F.substring(F.col("path"), F.lit(1), n))
    expanded = distinct.select("host", "path", F.explode(hosts).alias("e_host"), paths.alias("paths")).select("host", "path", "e_host", F.explode("paths").alias("e_path"))
    expanded = expanded.withColumn("digest", _digest(F.col("e_host"), F.col("e_path"))).withColumn("prefix", F.substring("digest", 1, PREFIX_HEX))
    fitting = expanded.join(spec, "prefix").where("digest = r_digest and e_host = r_host and e_path = r_path")
    rank = F.struct((F.char_length("r_host") + F.char_length("r_path")).alias("all"), F.char_length("r_host").alias("h"), "r_action", "r_host", "r_path")
    best = fitting.groupBy("host", "path").agg(F.max(rank).alias("best"))
    best = best.select("host", "path", F.concat("best.r_host", "best.r_path").alias("rule"), F.col("best.r_action").alias("r_verdict"))
    return split.join(best, ["host", "path"], "left").select(*[F.col(f"`{c}`") for c in own], "host", "path", "rule", F.coalesce("r_verdict", F.lit(default)).alias("verdict"))


def op2_url_filters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return match_rules(read(spark, sf_dir, "pages").select("page_id", "url"), rule_table(spark)).select("page_id", "host", "path", "rule", "verdict")


ORACLE = """
with p as (
  select page_id,
    translate(coalesce(regexp_extract(url, '^.*?://([^/?#]*)', 1, 's'), ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    coalesce(regexp_extract(url, '^.*?://[^/?#]*([^?#]*)', 1, 's'), '') as path
  from pages),
r(r_host, r_path, action) as (values ('com', '/en/', 'block'), ('example.com', '/en/7', 'allow'), ('net', '/de/', 'block'), ('example.net', '/de/8', 'block'), ('org', '/es/', 'block')),
m as (
  select host, path, arg_max(r_host || r_path, length(r_host || r_path)) as rule, arg_max(action, length(r_host || r_path)) as verdict
  from (select distinct host, path from p) join r on (host = r_host or ends_with(host, '.' || r_host)) and starts_with(path, r_path)
  group by host, path)
select page_id, p.host, p.path, m.rule as rule, coalesce(m.verdict, 'allow') as verdict
from p left join m on p.host = m.host and p.path = m.path
"""
