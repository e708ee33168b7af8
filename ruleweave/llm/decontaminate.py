"""Benchmark decontamination: SimHash of item-sized windows, multi-index Hamming blocks, exact shingle similarity."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import flat_map, mix64, read

SHINGLE, SIMILARITY = 5, 0.8
#: 8 blocks of 8 bits, each searched within 2 bits: fingerprints within 8 * 3 - 1 bits agree that far in at least one block.
BLOCKS, BLOCK_RADIUS = 8, 2
RADIUS = BLOCKS * (BLOCK_RADIUS + 1) - 1
#: Items are searched in blocks of at most this many bytes of text; every block passes over all documents.
BLOCK_BYTES = 8_000_000
#: ASCII letters and digits and all other characters beyond ASCII stay, the rest parts words.
KEEP = bytes(b if b >= 128 or chr(b).isalnum() else 32 for b in range(256))
MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
NEAR = np.bitwise_count(np.arange(256, dtype=np.uint8)[:, None] ^ np.arange(256, dtype=np.uint8)[None, :]) <= BLOCK_RADIUS


def normal_words(text: str | None) -> list[bytes]:
    """Lower-case words without punctuation."""
    return text.lower().encode("utf-8", "surrogatepass").translate(KEEP).split() if text else []


def shingles(word_hashes: np.ndarray) -> np.ndarray:
    h = word_hashes[: max(0, len(word_hashes) - SHINGLE + 1)].copy()
    for j in range(1, SHINGLE):
        h = h * MULTIPLIER + word_hashes[j : len(word_hashes) - SHINGLE + 1 + j]
    return mix64(h)


def hashes(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh64_intdigest, words), np.uint64, len(words))


def votes(h: np.ndarray) -> np.ndarray:
    """For each shingle +1 or -1 for each of 64 bits."""
    return np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").astype(np.int32) * 2 - 1


def pack(total: np.ndarray) -> np.ndarray:
    """Fingerprints as rows of 8 bytes from sums of votes."""
    return np.packbits(total > 0, axis=1, bitorder="little")


class Items:
    """An index of benchmark items: their shingles, and for each size the fingerprints in multi-index blocks.

    An item with fewer words than a shingle has its whole sequence as its only one, so it is found where just these words stand;
    items without a word match nothing; repeated items are found each.
    """

    def __init__(self, items: list[tuple[int, str | None]]):
        self.ids, self.sizes, self.shingles, self.place, self.by_size = [], [], [], [], defaultdict(list)
        self.vocabulary: dict[bytes, int] = {}
        self.short: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        owners = defaultdict(set)
        for item_id, text in items:
            words = normal_words(text)
            if not words:
                continue
            k, n = len(self.ids), len(words)
            self.ids.append(item_id)
            self.sizes.append(n)
            self.place.append(len(self.by_size[n]))
            self.shingles.append(shingles(hashes(words)))
            codes = np.array([self.vocabulary.setdefault(w, len(self.vocabulary) + 1) for w in words], dtype=np.uint64)
            if n < SHINGLE:
                self.short[tuple(words)].append(k)
                continue
            self.by_size[n].append(k)
            for key in shingles(codes).tolist():
                owners[key].add(k)
        self.short_sizes = sorted({len(words) for words in self.short})
        self.keys = np.array(sorted(owners), dtype=np.uint64)
        self.owners = [sorted(owners[k]) for k in self.keys.tolist()]
        self.counts = [Counter(s.tolist()) for s in self.shingles]
        self.prints = {n: np.concatenate([pack(votes(self.shingles[k]).sum(axis=0)[None]) for k in own]) for n, own in self.by_size.items() if own}
        # near[block, value, item]: whether the item's block is within the block radius of the value
        self.near = {n: np.stack([NEAR[:, p[:, b]] for b in range(BLOCKS)]) for n, p in self.prints.items()}

    def search(self, text: str | None) -> list[tuple[int, int, int, float, int]]:
        """(item, first word, words, similarity, differing bits) of each item's best window, the first of equal ones."""
        words = normal_words(text)
        if not words or not self.ids:
            return []
        codes = np.fromiter(map(self.vocabulary.get, words, repeat(0)), np.uint64, len(words))
        known = np.concatenate([[0], np.cumsum(codes > 0)])
        best: dict[int, tuple] = {}
        for n in self.short_sizes:
            for p in np.nonzero(known[n:] - known[:-n] == n)[0].tolist():
                for k in self.short.get(tuple(words[p : p + n]), ()):
                    best.setdefault(k, (1.0, p, 0))
        self._long(words, codes, np.nonzero(known[SHINGLE:] - known[:-SHINGLE] == SHINGLE)[0], best)
        return [(self.ids[k], start, min(self.sizes[k], len(words)), sim, bits) for k, (sim, start, bits) in sorted(best.items())]

    def _long(self, words: list[bytes], codes: np.ndarray, at: np.ndarray, best: dict) -> None:
        """Items of a shingle and more, from the places where five words of the vocabulary stand."""
        if not len(at) or not len(self.keys):
            return
        # A window as similar as asked shares a shingle with the item, so only windows over such a shingle matter.
        keys = mix64(sum((codes[at + j] * MULTIPLIER ** np.uint64(SHINGLE - 1 - j) for j in range(SHINGLE)), np.zeros(len(at), np.uint64)))
        place = np.minimum(np.searchsorted(self.keys, keys), len(self.keys) - 1)
        hit = self.keys[place] == keys
        spans: dict[int, list[tuple[int, int, list[int]]]] = defaultdict(list)
        for p, key in zip(at[hit].tolist(), place[hit].tolist(), strict=True):
            owners: dict[int, list[int]] = defaultdict(list)
            for k in self.owners[key]:
                owners[self.sizes[k]].append(k)
            for n, own in owners.items():
                size = min(n, len(words))
                spans[n].append((max(0, p - size + SHINGLE), min(p, len(words) - size), own))
        for n, found in spans.items():
            merged: list[tuple[int, int, set[int]]] = []
            for a, b, own in sorted(found):
                if merged and a <= merged[-1][1] + 1:
                    merged[-1] = (merged[-1][0], max(b, merged[-1][1]), merged[-1][2].union(own))
                else:
                    merged.append((a, b, set(own)))
            for a, b, own in merged:
                self._windows(words, n, a, b, sorted(own), best)

    def _windows(self, words: list[bytes], n: int, a: int, b: int, own: list[int], best: dict) -> None:
        """Compares the windows that begin at a to b with the items (all of n words) that share a shingle with one of them."""
        m = min(n, len(words)) - SHINGLE + 1  # shingles of a window
        h = shingles(hashes(words[a : b + m + SHINGLE - 1]))
        v = np.zeros((len(h) + 1, 64), dtype=np.int32)
        np.cumsum(votes(h), axis=0, out=v[1:])
        prints = pack(v[m:] - v[:-m])
        places = np.array([self.place[k] for k in own])
        found = np.zeros((len(prints), len(own)), dtype=bool)
        for block in range(BLOCKS):
            found |= self.near[n][block][np.ix_(prints[:, block], places)]
        for i, j in zip(*np.nonzero(found), strict=True):
            k = own[j]
            bits = int(np.bitwise_count(prints[i] ^ self.prints[n][places[j]]).sum())
            if bits > RADIUS:
                continue
            ours, theirs = Counter(h[i : i + m].tolist()), self.counts[k]
            shared = sum((ours & theirs).values())
            sim = shared / (m + len(self.shingles[k]) - shared)
            if sim >= SIMILARITY and (k not in best or (-sim, a + i) < (-best[k][0], best[k][1])):
                best[k] = (sim, a + int(i), bits)


def item_blocks(benchmark: DataFrame, id_col: str = "item_id", text_col: str = "text") -> Iterator[Items]:
    """The stated query set, in indexes of a bounded size."""
    block, size = [], 0
    for item_id, text in benchmark.select(id_col, text_col).toLocalIterator():
        if block and size + len(text or "") > BLOCK_BYTES:
            yield Items(block)
            block, size = [], 0
        block.append((item_id, text))
        size += len(text or "")
    yield Items(block)


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, item_id, start_word, n_words, similarity, bits): each document's best window for each item it holds.

    Similarity is the weighted Jaccard similarity of 5-word shingles (weights are counts), 0.8 or more; an item of fewer words is
    found where all its words stand in a row. Null and empty
    texts and items hold nothing; null ids are kept as null; repeated rows are found each; empty tables give an empty
    result; other columns are ignored. Every task searches whole texts on its own, without a shuffle.
    """
    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    kinds = pa.schema([("doc_id", pa.int64()), ("item_id", pa.int64()), ("start_word", pa.int64()), ("n_words", pa.int64()), ("similarity", pa.float64()), ("bits", pa.int32())])
    out = None
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            found = [(d, *r) for d, t in zip(batch.column(0).to_pylist(), batch.column(1), strict=True) for r in shared.value.search(t.as_py())]
            return pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*found, strict=True), kinds, strict=True)], schema=kinds) if found else None

        part = flat_map(picked, run, "doc_id long, item_id long, start_word long, n_words long, similarity double, bits int")
        out = part if out is None else out.union(part)
    return out


def clean(docs: DataFrame, benchmark: DataFrame, text_col: str = "text") -> DataFrame:
    """docs without those that hold a benchmark item; all their columns and rows are otherwise unchanged."""
    for items in item_blocks(benchmark):
        shared = docs.sparkSession.sparkContext.broadcast(items)

        def run(batch: pa.RecordBatch, shared=shared) -> pa.RecordBatch:
            texts = batch.column(batch.schema.get_field_index(text_col))
            return batch.filter(pa.array([not shared.value.search(t.as_py()) for t in texts], pa.bool_()))

        docs = flat_map(docs, run, docs.schema)
    return docs


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return leaks(read(spark, sf_dir, "documents"), read(spark, sf_dir, "benchmark"))
