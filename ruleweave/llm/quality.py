"""Quality by the perplexity of an interpolated modified Kneser-Ney model of characters, trained on trusted text."""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, field
from operator import eq

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ruleweave.llm.common import drop_tables, materialize, mix64, read

ORDER = 5
#: Every tenth trusted document is kept out of the counts and sets the thresholds instead.
HELD_OUT = 10
#: Documents above this quantile of the held-out trusted documents of their language and length, and SLACK times the
#: quantile's distance from the median, are rejected. Bands of length with fewer documents than LEAST use all lengths.
QUANTILE, SLACK, LEAST = 0.99, 0.5, 50
#: Entries of the model that are broadcast at once; a larger model is scored in several shards, one after the other.
SHARD_ENTRIES = 4_000_000
START = "\x02" * (ORDER - 1)
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
PIECE = 1 << 14
ONE = np.uint64(1)
PIECE_ROWS = 512
#: A word that its follower repeats, which becomes one mark. A mark is scored by the lowest order alone, where it is rare:
#: a history would let a long run of repetitions predict itself.
REPEATED, MARK = re.compile(r"(?<!\S)(\S+)(?=\s+\1(?!\S))"), "\x04"


def marked(text: str) -> str:
    words = text.split()
    return REPEATED.sub(MARK, text) if any(map(eq, words, words[1:])) else text


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), dtype=np.uint32)


def salt(lang: str | None, n: int) -> np.uint64:
    return mix64(np.array([hash_lang(lang) + 31 * n + 7], dtype=np.uint64))[0]


def hash_lang(lang: str | None) -> int:
    total = 1
    for b in (lang or "").encode():
        total = (total * 257 + b) % (1 << 40)
    return total


def gram_keys(c: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit number for each run of n codes, at the index of its first code."""
    h = np.zeros(len(c) - n + 1, dtype=np.uint64)
    for j in range(n):
        h = h * MULTIPLIER + (c[j : len(c) - n + 1 + j].astype(np.uint64) + np.uint64(1))
    return h


def trusted_documents(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(id, lang, text, held_out) of the documents that are labelled good and not toxic; a null language is ''."""
    spark = docs.sparkSession
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0").select(F.col("doc_id").cast("long").alias("id"))
    picked = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"), F.col(text_col).cast("string").alias("text")).where("text is not null and text <> ''")
    held_out = F.pmod(F.xxhash64("id"), F.lit(HELD_OUT)) == 0
    # Spark's own bloom filter keeps the texts of most other documents out of the shuffle of this semi-join.
    key = "spark.sql.optimizer.runtime.bloomFilter.applicationSideScanSizeThreshold"
    before = spark.conf.get(key)
    spark.conf.set(key, "0")
    try:
        return materialize(picked.join(good, "id", "left_semi").withColumn("held_out", held_out), "trusted")
    finally:
        spark.conf.set(key, before)


def gram_counts(texts: DataFrame) -> DataFrame:
    """(lang, gram, c): counts of all grams of ORDER characters; texts begin with start marks. Summed within each task first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: dict[str, dict[str, int]] = {}

        def flush() -> Iterator[pa.RecordBatch]:
            for lang, table in held.items():
                yield pa.RecordBatch.from_arrays([pa.array([lang] * len(table), pa.string()), pa.array(table.keys(), pa.string()), pa.array(table.values(), pa.int64())], ["lang", "gram", "c"])
            held.clear()

        for batch in batches:
            by_lang: dict[str, list[str]] = {}
            for lang, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                by_lang.setdefault(lang, []).append(START + marked(text))
            for lang, texts in by_lang.items():
                table = held.setdefault(lang, {})
                while texts:
                    part, size = [], 0
                    while texts and size < 1 << 21:
                        part.append(texts.pop())
                        size += len(part[-1])
                    joined = "".join(part)
                    # Runs across two texts don't count: each text has len - ORDER + 1 of its own.
                    starts = np.concatenate([[0], np.cumsum([len(p) for p in part])])
                    own = np.ones(len(joined), dtype=bool)
                    for end in starts[1:]:
                        own[end - ORDER + 1 : end] = False
                    where = np.nonzero(own)[0]
                    keys, first, counts = np.unique(gram_keys(codes(joined), ORDER)[where[where <= len(joined) - ORDER]], return_index=True, return_counts=True)
                    for i, c in zip(where[first].tolist(), counts.tolist(), strict=True):
                        gram = joined[i : i + ORDER]
                        table[gram] = table.get(gram, 0) + c
            if sum(map(len, held.values())) > 1_000_000:
                yield from flush()
        yield from flush()

    return texts.select("lang", "text").mapInArrow(run, "lang string, gram string, c long").groupBy("lang", "gram").agg(F.sum("c").alias("c"))


def _discounts(level: DataFrame) -> DataFrame:
    """(lang, d1, d2, d3) of modified Kneser-Ney from the counts of counts; 0.5, 1 and 1.5 where those are degenerate."""
    n = [F.sum(F.when(F.col("c") == i, 1).otherwise(0)).cast("double").alias(f"n{i}") for i in (1, 2, 3, 4)]
    y = F.try_divide(F.col("n1"), F.col("n1") + 2 * F.col("n2"))
    d = [F.lit(float(i)) - (i + 1) * y * F.try_divide(F.col(f"n{i + 1}"), F.col(f"n{i}")) for i in (1, 2, 3)]
    safe = [F.when((x > 0) & (x < i), x).otherwise(F.lit(i / 2)).alias(f"d{i}") for i, x in zip((1, 2, 3), d, strict=True)]
    return level.groupBy("lang").agg(*n).select("lang", *safe)


def model_table(counts: DataFrame) -> DataFrame:
    """(lang, kind, n, gram, value): log probabilities ('p') of all seen grams of 1 to ORDER characters, log back-off weights
    ('b') of all seen histories, and the log probability of an unseen character (kind 'u').

    p(w|h) = (c(hw) - d) / c(h) + b(h) p(w|h'), down to an even share of the language's characters and one unseen one. The
    highest order has counts, lower orders the number of different characters before a gram. Every order is a count
    table dealt by language and gram; histories and lower orders meet it in joins on those keys.
    """
    levels = {ORDER: materialize(counts, "grams")}
    for n in range(ORDER - 1, 0, -1):
        levels[n] = materialize(levels[n + 1].groupBy("lang", F.substring("gram", 2, n).alias("gram")).agg(F.count("*").alias("c")), "grams")
    base = levels[1].groupBy("lang").agg((1 / (F.count("*") + 1)).alias("low"))
    out, lower = [base.select("lang", F.lit("u").alias("kind"), F.lit(0).alias("n"), F.lit("").alias("gram"), F.log("low").alias("value"))], None
    orders: list[DataFrame] = []
    for n in range(1, ORDER + 1):
        d = F.when(F.col("c") == 1, F.col("d1")).when(F.col("c") == 2, F.col("d2")).otherwise(F.col("d3"))
        level = levels[n].join(F.broadcast(_discounts(levels[n])), "lang")  # a row for each language
        level = level.select("lang", "gram", F.substring("gram", 1, n - 1).alias("h"), F.substring("gram", 2, n - 1).alias("short"), "c", d.alias("d"))
        level = materialize(level, "cut-grams")  # short plans: the driver's memory goes with their size
        history = level.groupBy("lang", "h").agg(F.sum("c").alias("all"), F.sum("d").alias("kept")).select("lang", "h", "all", (F.col("kept") / F.col("all")).alias("b"))
        history = materialize(history, "histories")
        orders += [level, history]
        level = level.join(history, ["lang", "h"])
        level = level.join(F.broadcast(base), "lang") if n == 1 else level.join(lower.select("lang", F.col("gram").alias("short"), F.col("p").alias("low")), ["lang", "short"])
        lower = materialize(level.select("lang", "gram", ((F.col("c") - F.col("d")) / F.col("all") + F.col("b") * F.col("low")).alias("p")), "probabilities")
        orders.append(lower)
        out.append(lower.select("lang", F.lit("p").alias("kind"), F.lit(n).alias("n"), "gram", F.log("p").alias("value")))
        out.append(history.select("lang", F.lit("b").alias("kind"), F.lit(n - 1).alias("n"), F.col("h").alias("gram"), F.log("b").alias("value")))
    table = out[0]
    for part in out[1:]:
        table = table.unionByName(part)
    table = materialize(table, "language-model")
    drop_tables(*levels.values(), *orders)
    return table


class Table:
    """64-bit keys to 32-bit values in open addressing, built and searched in whole arrays."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.bits = max(4, int(np.ceil(np.log2(max(1, len(keys)) * 1.5))))
        self.keys = np.zeros(1 << self.bits, dtype=np.uint64)
        self.values = np.zeros(1 << self.bits, dtype=np.float32)
        self.rounds, used, left = 0, np.zeros(1 << self.bits, dtype=bool), np.arange(len(keys))
        while len(left):
            at = self._at(keys[left], self.rounds)
            free, first = np.unique(at, return_index=True)
            first = first[~used[free]]
            self.keys[at[first]], self.values[at[first]] = keys[left[first]], values[left[first]]
            used[at[first]] = True
            left = np.delete(left, first)
            self.rounds += 1

    def _at(self, keys: np.ndarray, step: int) -> np.ndarray:
        return ((keys >> np.uint64(64 - self.bits)) + np.uint64(step)) & np.uint64((1 << self.bits) - 1)

    def get(self, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(found, value) of each key."""
        at = self._at(keys, 0)
        there, value = self.keys[at], self.values[at]
        found = there == keys
        left = np.nonzero(~found & (there != 0))[0]
        for step in range(1, self.rounds):
            if not len(left):
                break
            at = self._at(keys[left], step)
            hit = self.keys[at] == keys[left]
            found[left[hit]], value[left[hit]] = True, self.values[at[hit]]
            left = left[~hit & (self.keys[at] != 0)]
        return found, value


def shard_of(before: np.ndarray, last: np.ndarray, shards: int) -> np.ndarray:
    """The shard of a history by its last two codes: all that a character's probability needs of longer grams lies in one shard."""
    return (mix64(before.astype(np.uint64) << np.uint64(32) | last.astype(np.uint64)) >> np.uint64(8)) % np.uint64(shards)


def keyed(table: DataFrame, shards: int) -> DataFrame:
    """(shard, key, value): the model with a 64-bit number for each entry; shard -1 belongs to all shards.

    That is where entries with a history of fewer than two characters are, which are no more than pairs of characters.
    """
    offset = {"p": 0, "b": 100, "u": 200}

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            frame = batch.to_pandas()
            for (lang, kind, n), rows in frame.groupby(["lang", "kind", "n"], sort=False):
                c = codes("".join(rows["gram"])).reshape(len(rows), n)
                h = np.zeros(len(rows), dtype=np.uint64)
                for j in range(n):
                    h = h * MULTIPLIER + (c[:, j].astype(np.uint64) + np.uint64(1))
                keys = mix64(h ^ salt(lang, n + offset[kind])) | ONE
                # A character's shard is that of the two codes before it: the last of a history, or of a gram without its end.
                last = n - 2 if kind == "p" else n - 1
                shard = shard_of(c[:, last - 1], c[:, last], shards).astype(np.int32) if last >= 1 and kind != "u" else np.full(len(rows), -1, np.int32)
                yield pa.RecordBatch.from_arrays([pa.array(shard), pa.array(keys.view(np.int64)), pa.array(rows["value"].to_numpy(np.float32))], ["shard", "key", "value"])

    return table.select("lang", "kind", "n", "gram", "value").mapInArrow(run, "shard int, key long, value float")


class Entries:
    """A shard's keys and values as they are broadcast; the table over them is built once in each worker process."""

    def __init__(self, keys: np.ndarray, values: np.ndarray):
        self.keys, self.values, self.built = keys, values, None

    def table(self) -> Table:
        if self.built is None:
            self.built, self.keys, self.values = Table(self.keys, self.values), None, None
        return self.built


@dataclass(frozen=True)
class Model:
    """A model's languages, its entries as a table, and the shards into which they are dealt."""

    langs: frozenset[str]
    entries: DataFrame
    shards: range
    kept: list[Broadcast] = field(default_factory=list)

    def share(self, shard: int) -> Broadcast:
        """A shard's entries, about SHARD_ENTRIES, as a broadcast; the only one of a model is made once."""
        if self.kept:
            return self.kept[0]
        own = self.entries.where(F.col("shard").isin(-1, shard)).select("key", "value").toArrow()
        shared = self.entries.sparkSession.sparkContext.broadcast(Entries(own["key"].to_numpy().view(np.uint64), own["value"].to_numpy()))
        del own
        pa.default_memory_pool().release_unused()
        if len(self.shards) == 1:
            self.kept.append(shared)
        return shared


def train(texts: DataFrame) -> Model:
    """The model of (lang, text) rows."""
    table = model_table(gram_counts(texts))
    langs = frozenset(r["lang"] for r in table.where("kind = 'u'").select("lang").collect())
    shards = max(1, -(-table.count() // SHARD_ENTRIES))
    entries = materialize(keyed(table, shards), "keyed-model")
    drop_tables(table)
    return Model(langs, entries, range(shards))


def log_likelihoods(table: Table, texts: list[str], lang: str, shard: int = 0, shards: int = 1) -> np.ndarray:
    """For each text the sum of the log probabilities of its characters (those that belong to the shard).

    Texts are scored together in pieces that stay in the processor's cache; a long text has several.
    """
    out, parts, owners, size = np.zeros(len(texts)), [], [], 0
    salts = {n: (salt(lang, n), salt(lang, n + 99)) for n in range(1, ORDER + 1)}
    unseen = float(table.get(np.array([mix64(np.array([salt(lang, 200)], np.uint64))[0] | ONE]))[1][0])

    def score_parts() -> None:
        c = codes("".join(parts)).astype(np.uint64) + ONE
        lengths = np.array([len(p) for p in parts])
        starts = np.cumsum(lengths) - lengths
        own = np.ones(len(c), dtype=bool)
        own[(starts[:, None] + np.arange(ORDER - 1)[None, :]).ravel()] = False  # what only is history
        left, values = np.flatnonzero(own), np.zeros(len(c))
        if shards > 1:
            left = left[shard_of(c[left - 2] - ONE, c[left - 1] - ONE, shards) == shard]
        mark = c[left] == ord(MARK) + 1
        runs, left = left[mark], left[~mark]

        def keys(last: np.ndarray, n: int, s: np.uint64) -> np.ndarray:
            h = np.zeros(len(last), dtype=np.uint64)
            for j in range(n - 1, -1, -1):
                h = h * MULTIPLIER + c[last - j]
            return mix64(h ^ s) | ONE

        for n in range(ORDER, 0, -1):
            left = np.concatenate([left, runs]) if n == 1 else left
            found, value = table.get(keys(left, n, salts[n][0]))
            values[left[found]] += value[found]
            left = left[~found]
            if not len(left) and not len(runs):
                break
            found, value = table.get(keys(left - 1, n - 1, salts[n][1]))
            values[left[found]] += value[found]
        else:
            values[left] += unseen
        np.add.at(out, owners, np.add.reduceat(values, starts))

    for i, text in enumerate(texts):
        padded = START + text
        for at in range(0, len(text), PIECE):
            parts.append(padded[at : at + PIECE + ORDER - 1])
            owners.append(i)
            size += len(parts[-1])
            if size >= PIECE:
                score_parts()
                parts, owners, size = [], [], 0
    if parts:
        score_parts()
    return out


def _sums(rows: DataFrame, model: Model, shard: int, shared: Broadcast) -> DataFrame:
    """rows (with text and lang) with chars and total added: the sum of the log probabilities of a shard's characters."""
    langs, shards = model.langs, len(model.shards)
    schema = T.StructType([*rows.schema.fields, T.StructField("chars", T.IntegerType()), T.StructField("total", T.DoubleType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # Small pieces: only some hundred texts are Python objects at a time.
        for batch in (b.slice(at, PIECE_ROWS) for b in batches for at in range(0, b.num_rows, PIECE_ROWS)):
            texts, tongues = (batch.column(batch.schema.get_field_index(n)) for n in ("text", "lang"))
            by_lang: dict[str, list[int]] = {}
            for i, (text, lang) in enumerate(zip(texts, tongues.to_pylist(), strict=True)):
                if lang in langs and text.as_py():
                    by_lang.setdefault(lang, []).append(i)
            new, chars = [None] * batch.num_rows, [0] * batch.num_rows
            for lang, own in by_lang.items():
                seen = [marked(texts[i].as_py()) for i in own]
                for i, text, sum_of in zip(own, seen, log_likelihoods(shared.value.table(), seen, lang, shard, shards).tolist(), strict=True):
                    new[i], chars[i] = sum_of, len(text)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(chars, pa.int32()), pa.array(new, pa.float64())], names=[*batch.schema.names, "chars", "total"])

    return rows.mapInArrow(run, schema)


def score(rows: DataFrame, model: Model) -> DataFrame:
    """rows (with text and lang) with nll added: the mean negative log probability of a character, null for empty texts and for
    languages without trusted text.

    A model of one shard is broadcast, and rows are scored as they pass. A larger one is scored one shard after the other: rows
    are written once with a number, each shard's sums are a table by that number, and its broadcast goes before the next
    one comes, so neither the driver nor a task ever holds more than one shard.
    """
    if len(model.shards) == 1:
        scored = _sums(rows, model, 0, model.share(0))
    else:
        numbered = materialize(rows.withColumn("row_number", F.monotonically_increasing_id()), "numbered-rows")
        parts = []
        for shard in model.shards:
            shared = model.share(shard)
            parts.append(materialize(_sums(numbered.select("row_number", "text", "lang"), model, shard, shared).select("row_number", "chars", "total"), "shard-sums"))
            shared.destroy()
        sums = parts[0]
        for part in parts[1:]:
            sums = sums.unionByName(part)
        scored = numbered.join(sums.groupBy("row_number").agg(F.max("chars").alias("chars"), F.sum("total").alias("total")), "row_number")
    return scored.select(*rows.columns, F.try_divide(-F.col("total"), F.col("chars")).alias("nll"))


def band(text: Column) -> Column:
    """Length band: powers of two of the number of characters, from 16 to 4096."""
    return F.floor(F.log2(F.least(F.greatest(F.char_length(text), F.lit(16)), F.lit(4096)))).cast("int")


def thresholds(scored: DataFrame) -> DataFrame:
    """(lang, band, threshold) by quantiles of nll; band -1 stands for all lengths."""
    q = F.percentile_approx("nll", F.array(F.lit(0.5), F.lit(QUANTILE)), 10000)
    limit = F.col("q")[1] + F.lit(SLACK) * (F.col("q")[1] - F.col("q")[0])
    both = scored.where("nll is not null").select("lang", F.explode(F.array(band(F.col("text")), F.lit(-1))).alias("band"), "nll")
    return both.groupBy("lang", "band").agg(q.alias("q"), F.count("*").alias("n")).where((F.col("n") >= LEAST) | (F.col("band") == -1)).select("lang", "band", limit.alias("threshold"))


def classify(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """(row, lang, nll, threshold, keep) for every document; row is the whole row of docs.

    keep is false where the mean negative log probability of a character under the model of the row's language lies above
    the threshold of its language and length. Rows with a null or empty text and rows of a language without trusted
    text have no score and are kept. A null language is a language of its own. Null ids and repeated rows are scored each;
    without any trusted document everything is kept; an empty table gives an empty result.
    """
    trusted = trusted_documents(docs, labels, id_col, text_col, lang_col)
    model = train(trusted.where("not held_out"))
    limits = materialize(thresholds(score(trusted.where("held_out").select("lang", "text"), model)), "quality-thresholds")
    drop_tables(trusted)
    rows = docs.select(F.struct("*").alias("row"), F.col(text_col).cast("string").alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit("")).alias("lang"))
    scored = score(rows, model)
    drop_tables(model.entries)
    scored = scored.withColumn("band", band(F.col("text"))).drop("text")
    own = limits.where("band >= 0").withColumnRenamed("threshold", "own")
    every = limits.where("band = -1").select("lang", F.col("threshold").alias("every"))
    scored = scored.join(every, "lang", "left").join(own, ["lang", "band"], "left").withColumn("threshold", F.coalesce("own", "every"))
    return scored.select("row", "lang", "nll", "threshold", F.coalesce(F.col("nll") <= F.col("threshold"), F.lit(True)).alias("keep"))


def op9_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = classify(docs, read(spark, sf_dir, "labels"))
    return found.select(F.col("row.doc_id").alias("doc_id"), "lang", F.exp("nll").alias("perplexity"), F.exp("threshold").alias("threshold"), "keep")
