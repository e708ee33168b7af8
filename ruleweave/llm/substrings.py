"""Removal of repeated passages by relative Lempel-Ziv parsing: documents are factored against blocks of all earlier documents."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import drop_tables, flat_map, materialize, mix64, raw_words, read

WINDOW = 13
#: Words of an anchor. The anchor of a window is its run of three words that begins with the longest word (of equal ones,
#: the one with the smallest hash), so equal windows have equal anchors, and neighbouring windows mostly share one.
ANCHOR = 3
#: A reference block begins at every STEP-th word of a document and has WINDOW - 1 words more, so each window lies in one block.
STEP = 64
#: Bits of a word's place in its document; above them stand TIE bits of a hash of the text, which part rows of one id.
PLACE, TIE = 32, 24
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)


def _runs(h: np.ndarray, n: int) -> np.ndarray:
    """A 64-bit hash of each run of n words."""
    out = h[: len(h) - n + 1].copy()
    for j in range(1, n):
        out = out * MULTIPLIER + h[j : len(h) - n + 1 + j]
    return mix64(out)


def _least(x: np.ndarray, n: int) -> np.ndarray:
    """The smallest of each n neighbours."""
    size = 1
    while 2 * size <= n:
        x = np.minimum(x[:-size], x[size:])
        size *= 2
    return np.minimum(x[: len(x) - (n - size)], x[n - size :]) if n > size else x


def windows(words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, hash) of every window of a document, as signed numbers."""
    if len(words) < WINDOW:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    h = np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))
    size = np.fromiter(map(len, words), np.uint64, len(words))
    runs = _runs(h, ANCHOR)
    order = (np.uint64(255) - np.minimum(size, np.uint64(255)))[: len(runs)] << np.uint64(56) | runs >> np.uint64(8)
    return _least(order, WINDOW - ANCHOR + 1).view(np.int64), _runs(h, WINDOW).view(np.int64)


def _emit(df: DataFrame, values: Callable[[list], tuple[np.ndarray, np.ndarray]], names: list[str]) -> DataFrame:
    """(name, doc_id, place): values of every row of df, whose first columns are doc_id and tie, and where they stand first."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        found, places = [], []
        for tie, *row in zip(batch.column(1).to_pylist(), *batch.columns[2:], strict=True):
            all_of, at = values(row)
            value, first = np.unique(all_of, return_index=True)
            found.append(value)
            places.append(at[first] + (tie << PLACE))
        ids = np.repeat(batch.column(0).to_numpy(), [len(f) for f in found])
        columns = [pa.array(c) for c in (np.concatenate(found), ids, np.concatenate(places))]
        return pa.RecordBatch.from_arrays(columns[: len(names)], names) if len(ids) else None

    return flat_map(df, run, ", ".join(f"{n} long" for n in names))


def _anchors(row: list) -> tuple[np.ndarray, np.ndarray]:
    anchor, _ = windows(raw_words(row[0].as_py()))
    return anchor, np.arange(len(anchor))


def _over_shared(row: list) -> tuple[np.ndarray, np.ndarray]:
    anchor, h = windows(raw_words(row[0].as_py()))
    at = np.flatnonzero(np.isin(anchor, row[1].values.to_numpy()))
    return h[at], at


def seeds(docs: DataFrame) -> DataFrame:
    """(doc_id, tie, starts, lengths, refs, places) from (doc_id, tie, text): runs of windows that a smaller doc_id has too.

    A run is `lengths` windows from a word on; the smallest document that has them is refs, where the first one stands at the
    place. First the anchors, about one for every four words, of all documents are counted; most stand in one document only.
    Only windows over an anchor that others share are hashed and compared. Both steps find the smallest document of a
    value by a partial aggregate and carry it back by a join on the value, so a passage that a third of all documents
    share is neither gathered nor paired. Windows are equal here if their 64-bit hashes are; parse() compares words.
    """
    anchors = materialize(_emit(docs, _anchors, ["anchor", "doc_id"]), "anchors")
    several = anchors.groupBy("anchor").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last")).where("first < last").select("anchor")
    shared = materialize(anchors.join(several, "anchor").groupBy("doc_id").agg(F.collect_list("anchor").alias("anchors")), "shared-anchors")
    drop_tables(anchors)
    found = materialize(_emit(docs.join(shared, "doc_id").select("doc_id", "tie", "text", "anchors"), _over_shared, ["window", "doc_id", "place"]), "windows")
    drop_tables(shared)
    least = found.groupBy("window").agg(F.min("doc_id").alias("first"), F.max("doc_id").alias("last"), F.min_by("place", "doc_id").alias("first_place"))
    least = materialize(least.where("first < last").select("window", "first", "first_place"), "first-windows")
    known = found.join(least, "window").where("first < doc_id")
    lists = [F.collect_list(c).alias(c) for c in ("place", "first", "first_place")]
    grouped = known.groupBy("doc_id", F.shiftright("place", PLACE).alias("tie")).agg(*lists)
    kinds = [pa.list_(pa.int64())] * 4

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        out: list[list[list[int]]] = [[], [], [], []]
        for row in zip(*batch.columns[2:], strict=True):
            place, ref, at = (c.values.to_numpy() for c in row)
            order = np.argsort(place)
            place, ref, at = place[order], ref[order], at[order]
            goes_on = (np.diff(place) == 1) & (np.diff(at) == 1) & (ref[1:] == ref[:-1])
            first = np.flatnonzero(np.concatenate([[True], ~goes_on]))
            length = np.diff(np.append(first, len(place)))
            for column, values in zip(out, (place[first] & ((1 << PLACE) - 1), length, ref[first], at[first]), strict=True):
                column.append(values)
        columns = [*batch.columns[:2], *(pa.array(c, k) for c, k in zip(out, kinds, strict=True))]
        return pa.RecordBatch.from_arrays(columns, ["doc_id", "tie", "starts", "lengths", "refs", "places"])

    runs = materialize(flat_map(grouped, run, "doc_id long, tie long, starts array<long>, lengths array<long>, refs array<long>, places array<long>"), "window-runs")
    drop_tables(found, least)
    return runs


def reference_blocks(docs: DataFrame, runs: DataFrame) -> DataFrame:
    """(doc_id, tie, blocks): for each document the blocks (ref, ref_tie, block, words) of earlier documents that its runs name.

    A block that many documents need is cut out of its document once and meets them in a join on the block.
    """
    run = F.posexplode(F.arrays_zip("lengths", "refs", "places"))
    named = runs.select("doc_id", "tie", run.alias("i", "r")).select("doc_id", "tie", F.col("r.refs").alias("ref"), F.shiftright("r.places", PLACE).alias("ref_tie"), F.expr(f"r.places & {(1 << PLACE) - 1}").alias("at"), F.col("r.lengths").alias("n"))
    block = F.explode(F.sequence(F.floor(F.col("at") / STEP), F.floor((F.col("at") + F.col("n") - 1) / STEP)))
    named = materialize(named.select("doc_id", "tie", "ref", "ref_tie", block.alias("block")).distinct(), "named-blocks")
    wanted = named.select("ref", "ref_tie", "block").distinct().groupBy("ref", "ref_tie").agg(F.collect_list("block").alias("wanted"))

    def cut(batch: pa.RecordBatch) -> pa.RecordBatch | None:
        out = []
        for ref, tie, text, blocks in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), batch.column(2), batch.column(3).to_pylist(), strict=True):
            words = raw_words(text.as_py())
            out += [(ref, tie, b, b" ".join(words[b * STEP : b * STEP + STEP + WINDOW - 1]).decode("utf-8", "surrogatepass")) for b in blocks]
        columns = zip(zip(*out, strict=True), (pa.int64(), pa.int64(), pa.int64(), pa.string()), strict=True)
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in columns], ["ref", "ref_tie", "block", "words"]) if out else None

    sources = docs.select(F.col("doc_id").alias("ref"), F.col("tie").alias("ref_tie"), "text").join(wanted, ["ref", "ref_tie"])
    # Rows that are equal in id and text give equal blocks.
    blocks = materialize(flat_map(sources, cut, "ref long, ref_tie long, block long, words string").dropDuplicates(["ref", "ref_tie", "block"]), "reference-blocks")
    given = named.join(blocks, ["ref", "ref_tie", "block"]).groupBy("doc_id", "tie").agg(F.collect_list(F.struct("ref", "ref_tie", "block", "words")).alias("blocks"))
    given = materialize(given, "given-blocks")
    drop_tables(named, blocks)
    return given


def parse(words: list[bytes], runs: tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray], blocks: dict[tuple[int, int, int], list[bytes]]) -> list[tuple[int, int, int]]:
    """(first word, words, reference document) of the factors of WINDOW words or more, in order.

    Greedy: a factor begins at the first window that the index knows, at its place in the reference block, and goes on as long as
    the words are the same; over the block's end into the next one, if the index leads there. The parse goes on with the
    first window that the factor doesn't cover whole, not with the word after it, so windows across a factor's border
    are looked up as well. A window whose words differ from those at its place, as only its hash is the same, begins nothing.
    """
    _, h = windows(words)
    starts, lengths, refs, places = runs
    at = np.repeat(starts - np.cumsum(lengths) + lengths, lengths) + np.arange(lengths.sum())
    ref, place = np.repeat(refs, lengths), np.repeat(places - starts, lengths) + at
    inside = at < len(h)
    at, ref, place = at[inside], ref[inside], place[inside]
    if not len(at):
        return []
    # The index holds the first place of each window in this document; the same window further on is known as well.
    order = np.argsort(h[at], kind="stable")
    near = np.minimum(np.searchsorted(h[at][order], h), len(at) - 1)
    known = np.flatnonzero(h[at][order][near] == h)
    ref, place = ref[order][near], place[order][near]
    out: list[tuple[int, int, int]] = []
    i, end_at = 0, (-1, -1, -1)
    while i < len(known):
        p = int(known[i])
        r, q = int(ref[p]), int(place[p])
        tie, q = q >> PLACE, q & ((1 << PLACE) - 1)
        block = blocks.get((r, tie, q // STEP), [])
        offset = q % STEP
        n = max(0, min(len(block) - offset, len(words) - p))
        if words[p : p + n] != block[offset : offset + n]:
            n = next(k for k in range(n) if words[p + k] != block[offset + k])
        if n < WINDOW:
            i += 1
            continue
        if out and out[-1][2] == r and end_at == (p, tie, q):  # the same passage goes on in the next block
            out[-1] = (out[-1][0], p + n - out[-1][0], r)
        else:
            out.append((p, n, r))
        end_at = (p + n - WINDOW + 1, tie, q + n - WINDOW + 1)
        i = int(np.searchsorted(known, p + n - WINDOW + 1))
    return out


def deduplicate(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, factors, kept) for every document: its factors (start, length, ref) and the words outside them.

    A factor is a passage of 13 words or more that its reference, a document with a smaller id, has word for word. Every window of
    13 words that also starts in a document with a smaller id lies in a factor. Words are runs of anything but ASCII blanks,
    compared as bytes; null and blank texts have none. Rows with a null id have no smaller id, remove nothing and serve as
    no reference; rows of one id never remove each other's words. An empty table gives an empty result; other columns
    are ignored.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.pmod(F.xxhash64(F.col(text_col)), F.lit(1 << TIE)).alias("tie"), F.col(text_col).cast("string").alias("text"))
    own = picked.where("doc_id is not null")
    runs = seeds(own)
    given = reference_blocks(own, runs)
    joined = picked.join(runs, ["doc_id", "tie"], "left").join(given, ["doc_id", "tie"], "left").select("doc_id", "text", "starts", "lengths", "refs", "places", "blocks")
    factor = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("ref", pa.int64())])
    kinds = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("factors", pa.list_(factor)), ("kept", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for doc_id, text, *known, given in zip(batch.column(0).to_pylist(), *batch.columns[1:], strict=True):
                words, factors = raw_words(text.as_py()), []
                if given.is_valid:
                    blocks = {(b["ref"], b["ref_tie"], b["block"]): raw_words(b["words"]) for b in given.as_py()}
                    factors = parse(words, tuple(c.values.to_numpy() for c in known), blocks)
                kept, end = [], 0
                for start, length, _ in factors:
                    kept += words[end:start] if start > end else []
                    end = max(end, start + length)
                kept += words[end:]
                out.append((doc_id, len(words), len(words) - len(kept), factors, b" ".join(kept).decode("utf-8", "surrogatepass")))
            ids, n, removed, parsed, texts = zip(*out, strict=True)
            factors = pa.array([[{"start": s, "length": size, "ref": r} for s, size, r in f] for f in parsed], kinds.field("factors").type)
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(n, pa.int64()), pa.array(removed, pa.int64()), factors, pa.array(texts, pa.string())], schema=kinds)

    return joined.mapInArrow(run, "doc_id long, n_words long, n_removed long, factors array<struct<start:long,length:long,ref:long>>, kept string")


def digest(found: DataFrame) -> DataFrame:
    """The columns of the registered query, from deduplicate()."""
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.encode("kept", "UTF-8"), 256).alias("kept_sha256"))


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return digest(deduplicate(read(spark, sf_dir, "documents")))
