"""The corpus pipeline: five stages over `documents`, each written as a table and read again by the next.

Every stage takes the columns of `documents` (doc_id, text, lang, source, n_chars) and returns them; the last returns what
the token files hold of each row. Null values, empty texts, repeated rows and empty tables are handled as the
operators say: rows that a filter can't judge (no text, a language without trusted text) are kept.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from ruleweave.llm.common import materialize, read
from ruleweave.llm.decontaminate import clean
from ruleweave.llm.mixing import mixed_documents
from ruleweave.llm.near_copies import keep_first
from ruleweave.llm.quality import classify
from ruleweave.llm.wavelet import token_documents
from ruleweave.session import ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose perplexity lies above the threshold of their language and length go."""
    return classify(docs, read(ship(spark), sf_dir, "labels")).where("keep").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class stays, the one with the smallest id: linked by SimHash fingerprints or near copies (five-word shingles, similarity 0.8 or more)."""
    ship(spark)
    return keep_first(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a benchmark item go."""
    return clean(docs, read(ship(spark), sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document as often as the mix takes it: not at all, once or twice."""
    ship(spark)
    return mixed_documents(docs)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Wavelet-matrix shards of the mix, and what they hold of each document: doc_id, start, n_tokens, ids_crc32."""
    ship(spark)
    return token_documents(docs)


STAGES = [
    ("quality classifier", quality),
    ("SimHash near-dedup", near_dedup),
    ("benchmark decontamination", decontamination),
    ("mixing to target weights", mixing),
    ("token output", tokens),
]

#: SQL can express neither the language model nor the tokenizer; tests/llm holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage; every stage before it is written as Parquet into the shared folder and read again."""
    docs = read(ship(spark), sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)
