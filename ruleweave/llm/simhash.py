"""SimHash near-duplicates with pivot distance tables."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import flat_map, materialize, mix64, raw_words, read, spread
from ruleweave.llm.components import connected_components

SHINGLE = 3
SEED = 42
RADIUS = 2
#: Block pivots: reference fingerprints with two neighbouring bits set; with the zero fingerprint they give every
#: block's part of a distance. Further references are pseudo-random.
BLOCK_PIVOTS = [3 << 2 * i for i in range(32)]
EXTRA_PIVOTS = [int(x) for x in mix64(np.arange(1, 9, dtype=np.uint64))]
#: Two fingerprints within RADIUS differ in at most two blocks, so in at most two of five groups of blocks.
GROUPS = 5
#: Keys with at most this many fingerprints are compared pair by pair, the others by radius-one hubs.
SMALL = 32
CHUNK = 1 << 15


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """Majority bits of the XXH64 values of a text's word shingles; 0 for a text without words."""
    words = raw_words(text)
    if not words:
        return 0
    words = [w.lower() for w in words]
    n = max(1, len(words) - shingle + 1)
    total = np.zeros(64, dtype=np.int64)
    for at in range(0, n, CHUNK):
        part = words[at : at + CHUNK + shingle - 1] if n > CHUNK else words
        rows = zip(*(part[i:] for i in range(shingle)), strict=False) if len(part) >= shingle else [part]
        h = np.array([xxhash.xxh64_intdigest(b" ".join(r), SEED) for r in rows], dtype=np.uint64)
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    bits = (2 * total > n).astype(np.uint8)
    return int(np.packbits(bits, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", shingle: int = SHINGLE) -> DataFrame:
    """(doc_id, fp): the fingerprint of every whole text as a signed 64-bit number; null and blank texts have 0."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        fps = np.fromiter((fingerprint(t.as_py(), shingle) for t in batch.column(1)), np.uint64, batch.num_rows)
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    return flat_map(picked, run, "doc_id long, fp long")


def _long(x: int) -> Column:
    return F.lit(x - (1 << 64) if x >= 1 << 63 else x).cast("long")


def pivot_table(nodes: DataFrame) -> DataFrame:
    """Adds the distances of fp: `blocks` to the zero and the block pivots, `far` to the pseudo-random references."""
    dist = lambda p: F.bit_count(F.col("fp").bitwiseXOR(_long(p)))
    return nodes.withColumn("far", F.array(*[dist(p) for p in EXTRA_PIVOTS])).withColumn("blocks", F.array(*[dist(p) for p in [0, *BLOCK_PIVOTS]]))


def _keys() -> Column:
    """Join keys: for every three of the five groups, the distances to all pivots of these groups, less the one to zero."""
    signs = []
    for g in range(GROUPS):
        own = list(range(len(BLOCK_PIVOTS)))[g::GROUPS]
        differences = F.array(*[F.col("blocks")[i + 1] - F.col("blocks")[0] for i in own])
        signs.append(F.xxhash64(differences))
    return F.array(*[F.xxhash64(F.lit(k), *[signs[g] for g in c]) for k, c in enumerate(combinations(range(GROUPS), GROUPS - RADIUS))])


def close_pairs(nodes: DataFrame) -> DataFrame:
    """Links (a, b) between the distinct fingerprints `fp` of nodes that differ in one or two bits.

    The pivot distance tables give both the candidates and the filter. Distances to the block pivots say how many bits
    each block has set; by the triangle inequality two fingerprints within the radius agree on all pivots of at least
    three of five groups, so an equality join on those distances misses none. Pairs of a key are discarded where any
    coordinate of the tables differs by more than the radius, and survivors are verified on the fingerprints.
    A key that many fingerprints share (a large group of near copies) isn't paired: each of its fingerprints is linked
    to the 65 points within one bit of it, and two fingerprints are within two bits exactly if they share such a point.
    There the links go to the smallest fingerprint of a point, which keeps the components and the row count linear.
    """
    keyed = pivot_table(spread(nodes.select("fp"), "fp")).select("fp", "far", "blocks", F.explode(_keys()).alias("key")).select("fp", "far", "key")
    keyed = materialize(keyed, "pivot-keys")
    sizes = keyed.groupBy("key").agg(F.count("*").alias("n")).where("n > 1")
    shared = materialize(keyed.join(sizes, "key"), "pivot-shared")
    small = shared.where(F.col("n") <= SMALL)
    left = small.select("key", F.col("fp").alias("a"), F.col("far").alias("fa"))
    right = small.select("key", F.col("fp").alias("b"), F.col("far").alias("fb"))
    gap = F.array_max(F.transform(F.arrays_zip("fa", "fb"), lambda x: F.abs(x["fa"] - x["fb"])))
    pairs = left.join(right, "key").where("a < b").where(gap <= RADIUS).where(F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= RADIUS).select("a", "b")
    large = shared.where(F.col("n") > SMALL).select("fp").distinct()
    points = large.select("fp", F.explode(F.array(_long(0), *[_long(1 << i) for i in range(64)])).alias("flip")).select("fp", F.col("fp").bitwiseXOR(F.col("flip")).alias("point"))
    hubs = points.groupBy("point").agg(F.min("fp").alias("hub"), F.count("*").alias("n")).where("n > 1").select("point", "hub")
    stars = points.join(hubs, "point").where("fp <> hub").select(F.col("hub").alias("a"), F.col("fp").alias("b"))
    return pairs.union(stars).distinct()


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, fp, component_id): SimHash classes of documents; component_id is the smallest doc_id reachable.

    Null and blank texts have the fingerprint zero and are linked like any other. Rows with a null id take part, but
    never name a component unless it has no other id (then component_id is null). Repeated rows stay repeated; an empty
    table gives an empty result; columns other than the two named are ignored.
    """
    fps = materialize(fingerprints(docs, id_col, text_col), "fingerprints")
    nodes = materialize(fps.groupBy("fp").agg(F.min("doc_id").alias("rep")), "fp-nodes")
    links = close_pairs(nodes)
    # Components run on fingerprints; a component's name is the smallest of its documents.
    roots = materialize(connected_components(links, "a", "b"), "fp-components")
    named = nodes.join(roots.withColumnRenamed("node", "fp"), "fp", "left").withColumn("component", F.coalesce("component", "fp"))
    least = named.groupBy("component").agg(F.min("rep").alias("component_id"))
    labels = named.join(least, "component").select("fp", "component_id")
    return fps.join(labels, "fp").select("doc_id", "fp", "component_id")


def keep_one(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """docs without the near copies: the row with the smallest id of each class stays, with all its columns.

    Of repeated rows with one id, one stays. Rows with a null id can't be told apart and all stay.
    """
    row = docs.select(F.struct("*").alias("row"), F.col(id_col).cast("long").alias("id"))
    keep = near_duplicates(docs, id_col, text_col).where("doc_id = component_id").select(F.col("doc_id").alias("id")).distinct()
    kept = row.join(keep, "id", "left_semi")
    kept = kept.groupBy("id").agg(F.min_by("row", F.xxhash64("row")).alias("row")) if _repeats(docs, id_col) else kept
    return kept.select("row.*").union(row.where("id is null").select("row.*"))


def _repeats(docs: DataFrame, id_col: str) -> bool:
    n = docs.where(F.col(id_col).isNotNull()).groupBy(id_col).agg(F.count("*").alias("n"))
    return not n.where("n > 1").isEmpty()


def op8_simhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = near_duplicates(read(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")
