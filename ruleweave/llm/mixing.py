"""Mixing sources to target weights by Pareto order sampling, with DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import materialize, n_words, read

#: Weights of the sources in code point order (null last), repeating; the share of all sizes; the most copies of a source.
WEIGHTS, SHARE, MOST = (5.0, 2.0, 1.0), 1.5, 2.0
#: Steps into which the ranks between 0 and 1 are cut, twice, before single documents are ordered.
STEPS = 4096
#: Sources up to which tables of sources are broadcast (some 100 bytes each).
SOURCES = 50_000


def source_targets(sizes: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST) -> DataFrame:
    """(source, source_size, target) from (source, size): the water level at which no target exceeds `most` sizes.

    Targets are weight times one level, held at the source's limit; sorted by limit per weight, the first sources reach
    their limit. The table has a row for each source, so it is small beside the documents.
    """
    per = sizes.groupBy("source").agg(F.sum("size").alias("source_size"))
    rank = F.row_number().over(W.orderBy(F.col("source").asc_nulls_last())) - 1
    per = per.withColumn("rank", rank)
    per = per.withColumn("weight", F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("rank") % len(weights) + 1).cast("int")))
    per = per.withColumn("limit", F.col("source_size") * F.lit(float(most))).withColumn("per", F.col("limit") / F.col("weight"))
    order = W.orderBy("per", "rank")
    everything = W.partitionBy()
    per = per.withColumn("total", F.sum("source_size").over(everything) * F.lit(float(share)))
    per = per.withColumn("before", F.coalesce(F.sum("limit").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0)))
    per = per.withColumn("rest", F.sum("weight").over(order.rowsBetween(W.currentRow, W.unboundedFollowing)))
    # The first source, in this order, whose share of what is left fits under its limit ends the capping.
    per = per.withColumn("level", F.greatest(F.lit(0.0), F.col("total") - F.col("before")) / F.col("rest"))
    per = per.withColumn("fits", F.col("weight") * F.col("level") <= F.col("limit"))
    per = per.withColumn("open", F.max("fits").over(order.rowsBetween(W.unboundedPreceding, W.currentRow)))
    per = per.withColumn("final", F.min(F.when(F.col("fits"), F.struct("per", "rank", "level"))).over(everything)["level"])
    return per.select("source", "source_size", F.when(F.col("open"), F.col("weight") * F.col("final")).otherwise(F.col("limit")).alias("target"))


def uniform(key: Column, seed: str) -> Column:
    """A number strictly between 0 and 1 that depends on the key and the seed only; 52 bits of an MD5."""
    bits = F.conv(F.substring(F.md5(F.concat(F.lit(seed), key)), 1, 13), 16, 10).cast("double")
    return (bits + 0.5) / F.lit(float(1 << 52))


def mix(docs: DataFrame, weights: tuple[float, ...] = WEIGHTS, share: float = SHARE, most: float = MOST, seed: str = "mix-", id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, source, tie, size, source_size, target, copies, taken): how often the mix takes each document.

    Every document of a source is expected target / source_size times. The whole part are certain copies. For the rest,
    documents are ranked by Pareto order sampling: random odds u / (1 - u) divided by inclusion odds p / (1 - p), and
    the source's first documents are taken until their words come nearest to what is left of the target, so a source
    misses its target by at most half a document. taken is copies times size, at most `most` times the size.

    The order of a source is never sorted as a whole: ranks are cut into steps, of which only sums are kept, then the
    step that holds the end is cut once more, and only documents of the last step are ordered. A source with a third
    of all rows costs no more in one task than any other.

    Null texts and blank texts have the size 0 and are never taken (copies 0). A null source is a source of its own,
    last in order. Rows with a null id draw their random number by a hash of their text; repeated rows each count
    with their size. An empty table gives an empty result. Columns other than the three named are ignored.
    """
    base = docs.select(F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), n_words(F.col(text_col)).alias("size"), F.xxhash64(F.col(text_col)).alias("tie"))
    base = materialize(base, "mix-sizes")
    targets = materialize(source_targets(base, weights, share, most), "mix-targets")
    chance = targets.withColumn("copies", F.coalesce(F.floor(F.try_divide("target", F.col("source_size"))), F.lit(0)).cast("long"))
    chance = chance.withColumn("left", F.col("target") - F.col("copies") * F.col("source_size")).withColumn("p", F.try_divide(F.col("left"), F.col("source_size")))
    # Tables with a row for each source are broadcast if they are counted to be few, so that no task gets a whole source;
    # more sources meet their rows in joins by source, of which Spark splits the large ones.
    small = F.broadcast if targets.count() <= SOURCES else (lambda df: df)
    # Sources that are null meet by the null-safe comparison.
    chance = small(chance.withColumnRenamed("source", "s"))
    u = uniform(F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("text "), F.col("tie").cast("string"))), seed)
    ranked = base.join(chance, F.col("source").eqNullSafe(F.col("s"))).drop("s")
    ranked = ranked.withColumn("u", u).withColumn("q", F.try_divide(F.try_divide(F.col("u"), 1 - F.col("u")), F.try_divide(F.col("p"), 1 - F.col("p"))))
    # q runs from 0 to infinity; q / (q + c), with c the ratio at u = 1/2, has the same order and spreads evenly from 0 to 1.
    even = F.try_divide(F.col("q"), F.col("q") + F.try_divide(1 - F.col("p"), F.col("p")))
    ranked = ranked.withColumn("step", F.floor(even * STEPS).cast("int")).withColumn("fine", F.floor((even * STEPS - F.floor(even * STEPS)) * STEPS).cast("int"))

    def end(rows: DataFrame, cut: str, keys: list[str], offset: Column) -> DataFrame:
        """For each source the first cut whose words reach what is left, and the words before it."""
        sums = rows.groupBy("source", *keys, cut).agg(F.sum("size").alias("words"), F.first("left").alias("left"), F.first(offset).alias("offset"))
        upto = F.sum("words").over(W.partitionBy("source").orderBy(cut)) + F.col("offset")
        sums = sums.withColumn("upto", upto).where("upto >= left")
        first = sums.groupBy("source").agg(F.min(F.struct(cut, (F.col("upto") - F.col("words")).alias("before"))).alias("e"))
        return first.select(F.col("source").alias("s"), F.col(f"e.{cut}").alias(f"end_{cut}"), F.col("e.before").alias(f"before_{cut}"))

    some = ranked.where("left > 0 and size > 0")
    coarse = small(materialize(end(some, "step", [], F.lit(0)), "mix-steps"))
    inside = some.join(coarse, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("step = end_step")
    finer = small(materialize(end(inside, "fine", ["step"], F.col("before_step")), "mix-fine-steps"))
    last = inside.join(finer, F.col("source").eqNullSafe(F.col("s"))).drop("s").where("fine = end_fine")
    order = W.partitionBy("source").orderBy("q", F.col("doc_id").asc_nulls_last(), "tie").rowsBetween(W.unboundedPreceding, W.currentRow)
    last = last.withColumn("middle", F.col("before_fine") + F.sum("size").over(order) - F.col("size") / 2).where("middle <= left")
    # Rows that are equal in all columns share a rank key: how many of them are taken is all that matters.
    marks = last.groupBy("source").agg(F.max(F.struct("q", F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")).alias("upto"))
    ends = coarse.join(finer.withColumnRenamed("s", "t"), F.col("s").eqNullSafe(F.col("t"))).drop("t").join(marks, F.col("s").eqNullSafe(F.col("source")), "left").drop("source")
    key = F.struct("q", F.col("doc_id").isNull().alias("no_id"), "doc_id", "tie")
    inside_end = (F.col("step") == F.col("end_step")) & ((F.col("fine") < F.col("end_fine")) | ((F.col("fine") == F.col("end_fine")) & F.coalesce(key <= F.col("upto"), F.lit(False))))
    more = F.coalesce((F.col("left") > 0) & (F.col("size") > 0) & ((F.col("step") < F.col("end_step")) | inside_end), F.lit(False))
    out = ranked.join(small(ends), F.col("source").eqNullSafe(F.col("s")), "left").withColumn("copies", F.when(F.col("size") > 0, F.col("copies") + more.cast("long")).otherwise(F.lit(0)))
    return out.select("doc_id", "source", "tie", "size", "source_size", "target", "copies", (F.col("copies") * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs with each row as often as mix() takes it; rows without words are never taken.

    The copies are found per id, source and text, so equal rows share their copies evenly, the first ones one more.
    Texts never go through a shuffle by source: the small table of copies meets the rows by id.
    """
    counts = materialize(mix(docs, id_col=id_col, text_col=text_col, source_col=source_col).where("copies > 0"), "mix-copies")
    times = counts.groupBy("doc_id", "source", "tie").agg(F.sum("copies").alias("sum"))
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).alias("doc_id"), F.col(source_col).alias("source"), F.xxhash64(F.col(text_col)).alias("tie"))
    right = times.select(F.coalesce("doc_id", F.lit(-1)).alias("k"), F.col("doc_id").alias("d"), F.col("source").alias("s"), F.col("tie").alias("t"), "sum")
    # k stands for the id in the equality that deals the rows; the other columns are compared null-safely.
    same = (F.coalesce(F.col("doc_id"), F.lit(-1)) == F.col("k")) & F.col("doc_id").eqNullSafe(F.col("d")) & F.col("source").eqNullSafe(F.col("s")) & (F.col("tie") == F.col("t"))
    taken = row.join(right, same)
    equal = W.partitionBy("k", "doc_id", "source", "tie")
    n, i = F.count("*").over(equal), F.row_number().over(equal.orderBy("tie")) - 1
    taken = taken.withColumn("n", n).withColumn("i", i)
    times = (F.floor(F.col("sum") / F.col("n")) + F.when(F.col("i") < F.col("sum") % F.col("n"), 1).otherwise(0)).cast("int")
    return taken.select("row", F.explode(F.array_repeat(F.lit(0), times)).alias("copy")).select("row.*")


def op10_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mix(read(spark, sf_dir, "documents")).select("doc_id", "size", "source_size", "target", "taken")


ORACLE = r"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::bigint as size from documents),
s as (select source, sum(size)::bigint as source_size, (array[5.0::double, 2.0::double, 1.0::double])[1 + ((row_number() over (order by source nulls last) - 1) % 3)::int] as weight from d group by source),
a as (select *, 2.0::double * source_size as lim, (2.0::double * source_size) / weight as per, (sum(source_size) over ())::double * 1.5::double as total from s),
b as (select *, greatest(0.0::double, total - coalesce(sum(lim) over (order by per, source nulls last rows between unbounded preceding and 1 preceding), 0.0::double))
    / sum(weight) over (order by per, source nulls last rows between current row and unbounded following) as level from a),
c as (select *, weight * level <= lim as fits from b),
f as (select *, max(fits::int) over (order by per, source nulls last rows between unbounded preceding and current row) as open, first_value(level) over (order by (not fits)::int, per, source nulls last) as final from c),
t as (select source, source_size, case when open = 1 then weight * final else lim end as target from f),
e as (select *, floor(target / nullif(source_size, 0))::bigint as copies from t),
g as (select *, target - copies * source_size as rest, (target - copies * source_size) / source_size as p from e),
h as (select d.*, source_size, target, copies, rest, p, ((('0x' || substr(md5('mix-' || doc_id), 1, 13))::ubigint)::double + 0.5::double) / 4503599627370496.0::double as u
    from d join g on d.source is not distinct from g.source),
q as (select *, (u / (1 - u)) / (p / (1 - p)) as q from h),
m as (select *, sum(case when rest > 0 then size else 0 end) over (partition by source order by q, doc_id rows between unbounded preceding and current row) - size / 2.0::double as middle from q)
select doc_id, size, source_size, target, (size * (copies + case when rest > 0 and middle <= rest then 1 else 0 end))::bigint as taken from m
"""
