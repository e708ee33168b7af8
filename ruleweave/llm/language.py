"""Language identification: known words first, then ever shorter character n-grams."""

from __future__ import annotations

import re
from collections import Counter
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import drop_tables, flat_map, materialize, read

#: Documents that the model learns from: about so many of each language, and fewer of each where all languages together had more
#: than SAMPLE. They are picked by a hash of their id. All words and n-grams of these documents are kept; the bound on the
#: sample is what bounds the model that is broadcast.
TRAIN_DOCS, SAMPLE = 2000, 40_000
#: Entries of a text that are summed at once.
AT_ONCE = 1 << 18
ORDERS = (5, 4, 3, 2, 1)
EMPTY = pa.table({"lang": pa.array([], pa.string()), "n": pa.array([], pa.int32()), "gram": pa.array([], pa.string()), "c": pa.array([], pa.int64())})
LETTERS = re.compile(r"[^\W\d_]+")
MEMO = 200_000


def letters(text: str | None) -> list[str]:
    """Lower-case runs of letters."""
    return [w for w in LETTERS.findall(text.lower()) if w.isalpha() or any(map(str.isalpha, w))] if text else []


def grams(word: str, n: int) -> list[str]:
    """The word's n-grams, with its edges marked; single characters have no marks."""
    marked = f"<{word}>" if n > 1 else word
    return [marked[i : i + n] for i in range(len(marked) - n + 1)]


class Model:
    """Log frequencies by language of words and of character n-grams, sparse: an entry lists the languages that know it."""

    def __init__(self, langs: list[str], rows: pa.Table, totals: dict[tuple[str, int], int]):
        """rows: (lang, n, gram, c), order n = 0 for words; totals: counts of all grams of a language and order."""
        self.langs = langs
        table = rows.sort_by([("n", "ascending"), ("gram", "ascending"), ("lang", "ascending")])
        orders, names, counts = table["n"].to_numpy(), table["gram"].to_pylist(), table["c"].to_numpy()
        self.columns = np.searchsorted(np.array(langs, dtype=object), np.array(table["lang"].to_pylist(), dtype=object)).astype(np.int32) if langs else np.zeros(0, np.int32)
        # Every count is half a time more than seen; a language that doesn't know an entry has just that half.
        self.gains = (np.log(counts + 0.5) - np.log(0.5)).astype(np.float32)
        size = np.array([[totals.get((lang, n), 0) for lang in langs] for n in range(max(ORDERS) + 1)], dtype=float).reshape(max(ORDERS) + 1, len(langs))
        self.base = np.log(0.5) - np.log(size + 1)
        first = [i for i in range(len(names)) if not i or names[i] != names[i - 1] or orders[i] != orders[i - 1]]
        self.starts, self.orders = np.array([*first, len(names)], dtype=np.int64), orders[first].astype(np.int8)
        self.words = {names[i]: k for k, i in enumerate(first) if orders[i] == 0}
        self.grams = {names[i]: k for k, i in enumerate(first) if orders[i] > 0}
        self.memo: dict[str, list[int]] = {}

    def backoff(self, word: str) -> list[int]:
        """Rows of the longest n-grams of an unseen word of which any is known."""
        found = self.memo.get(word)
        if found is None:
            found = []
            for n in ORDERS:
                if found := [r for g in grams(word, n) if (r := self.grams.get(g)) is not None]:
                    break
            if len(self.memo) < MEMO:
                self.memo[word] = found
        return found

    def total(self, rows: np.ndarray) -> np.ndarray:
        """Sums of the log frequencies of entries, by language."""
        total = np.bincount(self.orders[rows], minlength=len(self.base)).astype(np.float64) @ self.base
        for part in np.array_split(rows, -(-len(rows) // AT_ONCE)) if len(rows) else []:
            size = self.starts[part + 1] - self.starts[part]
            at = np.repeat(self.starts[part] - np.cumsum(size) + size, size) + np.arange(size.sum())
            total += np.bincount(self.columns[at], weights=self.gains[at], minlength=len(self.langs))
        return total

    def predict(self, text: str | None) -> tuple[str, float]:
        """The likeliest language (the first of equal ones) and its share of the likelihood of all languages."""
        words = letters(text)
        if not words or not self.langs:
            return "und", 0.0
        rows = np.fromiter(map(self.words.get, words, repeat(-1)), np.int64, len(words))
        unseen = [r for i in np.nonzero(rows < 0)[0].tolist() for r in self.backoff(words[i])]
        total = self.total(np.concatenate([rows[rows >= 0], np.array(unseen, dtype=np.int64)]))
        best = int(total.argmax())
        return self.langs[best], float(1 / np.exp(np.minimum(total - total[best], 0)).sum())


def train(labelled: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", train_docs: int = TRAIN_DOCS, sample: int = SAMPLE) -> Model:
    """Learns from about train_docs documents of each language, and sample in all, picked by a hash of their id.

    Rows without text or language are not used. Words and n-grams are counted by Spark; the counts of the bounded sample come
    to the driver.
    """
    base = labelled.select(F.col(id_col).cast("string").alias("id"), F.col(text_col).alias("text"), F.col(lang_col).cast("string").alias("lang")).where("text is not null and lang is not null")
    known = {r["lang"]: r["n"] for r in base.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # a row for each language
    if not known:
        return Model([], EMPTY, {})
    each = min(train_docs, -(-sample // len(known)))
    shares = base.sparkSession.createDataFrame([(lang, min(1.0, each / n)) for lang, n in known.items()], "lang string, share double")
    picked = base.join(F.broadcast(shares), "lang").where(F.pmod(F.xxhash64("id"), F.lit(1 << 20)) < F.col("share") * (1 << 20)).select("lang", "text")

    def count(batch: pa.RecordBatch) -> pa.RecordBatch:
        found: dict[str, Counter] = {}
        for lang, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            found.setdefault(lang, Counter()).update(letters(text.as_py()))
        out: Counter = Counter()
        for lang, words in found.items():
            for w, c in words.items():
                out[lang, 0, w] += c
                for n in ORDERS:
                    for g in grams(w, n):
                        out[lang, n, g] += c
        cols = list(zip(*out, strict=True)) if out else [(), (), ()]
        return pa.RecordBatch.from_arrays([pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(out.values(), pa.int64())], ["lang", "n", "gram", "c"])

    counts = materialize(flat_map(picked, count, "lang string, n int, gram string, c long").groupBy("lang", "n", "gram").agg(F.sum("c").alias("c")), "language-counts")
    totals = {(r["lang"], r["n"]): r["t"] for r in counts.groupBy("lang", "n").agg(F.sum("c").alias("t")).collect()}
    rows = counts.select("lang", "n", "gram", "c").toArrow()
    drop_tables(counts)
    return Model(sorted(known), rows, totals)


def identify(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, lang_pred, score) for every whole text.

    Texts that are null or have no letter are `und` with a score of 0, and so is everything if nothing was learned.
    Null ids and repeated rows pass through; an empty table gives an empty result; other columns are ignored.
    """
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        found = [shared.value.predict(t.as_py()) for t in batch.column(1)]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())], ["doc_id", "lang_pred", "score"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return flat_map(picked, run, "doc_id long, lang_pred string, score double")


def op1_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    held_out = F.coalesce(F.crc32(F.col("doc_id").cast("string")) % 4 == 2, F.lit(False))
    model = train(docs.where(~held_out).select("doc_id", "text", "lang"))
    return identify(docs, model).select("doc_id", held_out.alias("held_out"), "lang_pred", "score")
