"""Token ids in wavelet matrices: one succinct, compressed row for each shard of a corpus."""

from __future__ import annotations

import json
import re
import zlib
from collections.abc import Iterator
from dataclasses import dataclass
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ruleweave.llm.common import materialize, read

#: A shard ends with the first document that brings it to this many ids, or with its partition.
SHARD_TOKENS = 1 << 20
#: Bits of a plane for each entry of the rank directory.
BLOCK = 512
END_ID = 1
#: Encoded words that a task keeps at most.
MEMO = 500_000
SEPARATOR = "<|startoftext|>"
#: Letters (in UTF-8) of which neither normal forms nor lower-casing make anything but one letter: A-Z, a-z, À-Ö, Ø-ö, ø-ÿ.
LEAD = re.compile(rb"(?:[A-Za-z]|\xc3[\x80-\x96\x98-\xb6\xb8-\xbf])*")
#: Bytes of text that are split and gathered at once.
PIECE = 1 << 22
#: ASCII letters, and second bytes of the plain letters after 0xC3.
LETTER = np.isin(np.arange(256), np.frombuffer(b"ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz", np.uint8))
SECOND = (np.arange(256) >= 0x80) & (np.arange(256) <= 0xBF) & ~np.isin(np.arange(256), [0x97, 0xB7])
BLANKS = bytes.maketrans(b"\n", b" ")
LOWER = bytes.maketrans(b"\nABCDEFGHIJKLMNOPQRSTUVWXYZ", b" abcdefghijklmnopqrstuvwxyz")
#: Normalizer and pre-tokenizer that leave runs of lower-case plain letters as they are but for the bytes' names.
LETTER_STEPS = (
    {"type": "Sequence", "normalizers": [{"type": "NFC"}, {"type": "Replace", "pattern": {"Regex": r"\s+"}, "content": " "}, {"type": "Lowercase"}]},
    {
        "type": "Sequence",
        "pretokenizers": [
            {"type": "Split", "pattern": {"Regex": r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"}, "behavior": "Removed", "invert": True},
            {"type": "ByteLevel", "add_prefix_space": False, "trim_offsets": True, "use_regex": False},
        ],
    },
)

SHARD = "shard_part int, shard_seq int, n_tokens long, width int, zeros array<int>, planes binary, ranks binary, doc_ids array<long>, ends array<long>"


@dataclass
class WaveletMatrix:
    """Ids as bit planes, most significant first; each plane lists the ids with a zero in the plane before it first."""

    n: int
    zeros: np.ndarray  # zeros in each plane
    planes: np.ndarray  # (width, bytes of a plane), bits packed little-endian, padded to whole blocks
    ranks: np.ndarray  # (width, blocks + 1): ones before each block

    @classmethod
    def build(cls, ids: np.ndarray, width: int) -> WaveletMatrix:
        size = -(-max(len(ids), 1) // BLOCK) * (BLOCK // 8)
        planes, zeros = np.zeros((width, size), dtype=np.uint8), np.zeros(width, dtype=np.int32)
        n, spare = len(ids), np.empty_like(ids)
        for level in range(width):
            ones = (ids & ids.dtype.type(1 << (width - 1 - level))).astype(bool)
            packed = np.packbits(ones, bitorder="little")
            planes[level, : len(packed)] = packed
            z = zeros[level] = n - np.count_nonzero(ones)
            np.compress(~ones, ids, out=spare[:z])
            np.compress(ones, ids, out=spare[z:])
            ids, spare = spare, ids if level else np.empty_like(ids)  # the caller's array stays
        return cls(n, zeros, planes, cls.directory(planes))

    @staticmethod
    def directory(planes: np.ndarray) -> np.ndarray:
        ones = np.bitwise_count(planes.view(np.uint64)).reshape(len(planes), -1, BLOCK // 64).sum(axis=2, dtype=np.uint32)
        return np.concatenate([np.zeros((len(planes), 1), np.uint32), np.cumsum(ones, axis=1, dtype=np.uint32)], axis=1)

    @classmethod
    def from_row(cls, n: int, width: int, zeros: list[int], planes: bytes, ranks: bytes) -> WaveletMatrix:
        return cls(n, np.array(zeros, dtype=np.int32), np.frombuffer(planes, np.uint8).reshape(width, -1), np.frombuffer(ranks, np.uint32).reshape(width, -1))

    def rank1(self, level: int, i: int) -> int:
        """Ones among the first i bits of a plane."""
        block = i // BLOCK
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : -(-i // 8)], bitorder="little")
        return int(self.ranks[level, block]) + int(bits[: i - block * BLOCK].sum())

    def select(self, level: int, bit: int, k: int) -> int:
        """Position of the k-th (from 0) one or zero of a plane."""
        ones = self.ranks[level].astype(np.int64)
        counts = ones if bit else np.arange(len(ones)) * BLOCK - ones
        block = int(np.searchsorted(counts, k, side="right")) - 1
        bits = np.unpackbits(self.planes[level, block * BLOCK // 8 : (block + 1) * BLOCK // 8], bitorder="little")
        return block * BLOCK + int(np.nonzero(bits == bit)[0][k - int(counts[block])])

    def access(self, i: int) -> int:
        """The id at position i."""
        value = 0
        for level in range(len(self.planes)):
            bit = int(self.planes[level, i // 8]) >> (i % 8) & 1
            value = value << 1 | bit
            ones = self.rank1(level, i)
            i = int(self.zeros[level]) + ones if bit else i - ones
        return value

    def _range(self, token: int, end: int) -> tuple[int, int]:
        start = 0
        for level in range(len(self.planes)):
            a, b = self.rank1(level, start), self.rank1(level, end)
            z = int(self.zeros[level])
            start, end = (z + a, z + b) if token >> (len(self.planes) - 1 - level) & 1 else (start - a, end - b)
        return start, end

    def count(self, token: int, end: int | None = None) -> int:
        """Occurrences of an id among the first `end` positions, in one step for each plane."""
        if token < 0 or token >> len(self.planes):
            return 0
        start, stop = self._range(token, self.n if end is None else end)
        return stop - start

    def occurrence(self, token: int, k: int) -> int:
        """Position of the k-th (from 0) occurrence of an id."""
        i = self._range(token, self.n)[0] + k
        for level in reversed(range(len(self.planes))):
            bit = token >> (len(self.planes) - 1 - level) & 1
            i = self.select(level, bit, i - int(self.zeros[level]) if bit else i)
        return i

    def ids(self) -> np.ndarray:
        """All ids in order, from the last plane to the first."""
        width = len(self.planes)
        kind = np.uint16 if width <= 16 else np.uint32
        out = np.zeros(self.n, dtype=kind)
        for level in reversed(range(width)):
            ones = np.unpackbits(self.planes[level], count=self.n, bitorder="little").view(bool)
            z, at = int(self.zeros[level]), np.empty(self.n, dtype=kind)
            out[z:] |= kind(1 << (width - 1 - level))
            at[np.flatnonzero(~ones)] = out[:z]
            at[np.flatnonzero(ones)] = out[z:]
            out = at
        return out


class WordEncoder:
    """Encodes whole texts with a tokenizer that never joins characters across a blank or a line feed.

    Texts are split at blanks and behind a word's leading plain letters, and the different words found, in whole arrays. Each
    different word is encoded once and kept (in two generations of at most MEMO words); the ids of the texts are gathered
    from those of their words. Tests hold the result against encoding texts as a whole. New words go to the tokenizer
    together: plain letters parted by blanks, where the vocabulary marks word ends, anything else parted by a special token.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.width = max(1, (self.tokenizer.get_vocab_size() - 1).bit_length())
        self.kind = np.uint16 if self.width <= 16 else np.uint32
        self.separator = self.tokenizer.token_to_id(SEPARATOR)
        vocabulary = self.tokenizer.get_vocab()
        self.ends = np.zeros(max(vocabulary.values()) + 1, dtype=bool)
        self.ends[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
        self.lowers = self._encode("A").tolist() == self._encode("a").tolist()
        self.marks_ends = bool(self.ends.any())
        self.letters = self._letters_only()
        self.memo: dict[bytes, bytes] = {}
        self.older: dict[bytes, bytes] = {}

    def _letters_only(self):
        """A tokenizer for lower-case plain letters between blanks: the same model without the steps that leave such text alone.

        Where the file has other steps than those of LETTER_STEPS this is the tokenizer itself.
        """
        from tokenizers import Tokenizer
        from tokenizers.pre_tokenizers import ByteLevel, Sequence, WhitespaceSplit

        steps = json.loads(self.tokenizer.to_str())
        if (steps["normalizer"], steps["pre_tokenizer"]) != LETTER_STEPS:
            return self.tokenizer
        letters = Tokenizer(self.tokenizer.model)
        letters.pre_tokenizer = Sequence([WhitespaceSplit(), ByteLevel(add_prefix_space=False, use_regex=False)])
        return letters

    def _encode(self, text: str, tokenizer=None) -> np.ndarray:
        return np.array((tokenizer or self.tokenizer).encode_batch_fast([text], add_special_tokens=False)[0].ids, dtype=self.kind)

    def _keep(self, words: list[bytes], ids: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> None:
        size, raw = ids.itemsize, ids.tobytes()
        self.memo.update((w, raw[a:b]) for w, a, b in zip(words, (starts * size).tolist(), (ends * size).tolist(), strict=True))

    def _known(self, word: bytes) -> bool:
        if word in self.memo:
            return True
        found = self.older.get(word)
        if found is not None:
            self.memo[word] = found
        return found is not None

    def learn(self, words: list[bytes]) -> None:
        """Adds different words to the memo."""
        new = [w for w in words if not self._known(w)]
        leads = [w for w in new if LEAD.fullmatch(w)] if self.marks_ends else []
        upper = {w: w.decode().lower().encode() for w in leads if b"\xc3" in w or not w.islower()}
        lower = set(leads).difference(upper).union(w for w in upper.values() if not self._known(w))
        self._learn_leads(list(lower))
        self._learn_apart(list(set(new).difference(leads)))
        self.memo.update((w, self.memo[low]) for w, low in upper.items())

    def _learn_leads(self, words: list[bytes]) -> None:
        """Words of plain letters, each of which ends with the only word end of its ids."""
        for at in range(0, len(words), 5000):
            part = words[at : at + 5000]
            ids = self._encode(b" ".join(part).decode(), self.letters)
            ends = np.nonzero(self.ends[ids])[0] + 1
            if len(ends) == len(part):
                self._keep(part, ids, np.concatenate([[0], ends[:-1]]), ends)
            else:
                self._learn_apart(part)

    def _learn_apart(self, words: list[bytes]) -> None:
        first = SEPARATOR[:1].encode()
        alone = [w for w in words if self.separator is None or first in w]
        self.memo.update((w, self._encode(w.decode("utf-8", "replace")).tobytes()) for w in alone)
        rest = list(set(words).difference(alone))
        for at in range(0, len(rest), 5000):
            part = rest[at : at + 5000]
            ids = self._encode(SEPARATOR.join(w.decode("utf-8", "replace") for w in part))
            cuts = np.nonzero(ids == self.separator)[0]
            self._keep(part, ids, np.concatenate([[0], cuts + 1]), np.concatenate([cuts, [len(ids)]]))

    def _split(self, x: np.ndarray, bounds: np.ndarray) -> np.ndarray:
        """Where words begin in UTF-8 text, and where their leading plain letters end if an ASCII character follows."""
        blank = x == 0x20
        letter = LETTER[x]
        pairs = np.flatnonzero((x[:-1] == 0xC3) & SECOND[x[1:]])
        letter[pairs] = letter[pairs + 1] = True
        first = np.ones(len(x), dtype=bool)
        first[1:] = blank[:-1]
        first[bounds[:-1][bounds[:-1] < len(x)]] = True
        starts = np.flatnonzero(first & ~blank)
        if not self.marks_ends:
            return starts
        ends = np.flatnonzero(letter[:-1] & ~letter[1:] & ~blank[1:] & ~first[1:]) + 1
        word = np.searchsorted(starts, ends, side="right") - 1
        ends = ends[(np.diff(word, prepend=-1) > 0) & letter[starts[word]] & (x[ends] < 0x80)]
        return np.sort(np.concatenate([starts, ends]))

    def _piece(self, raw: bytes, bounds: np.ndarray, closes: np.ndarray, end: bytes) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the texts raw[bounds[i] : bounds[i + 1]] one after the other, with `end` after those that close a document, and
        how many each has."""
        # Special tokens are told apart by case; else A-Z become a-z, so that fewer words are different.
        raw = raw.translate(LOWER if self.lowers and b"<|" not in raw else BLANKS)
        x = np.frombuffer(raw, np.uint8)
        starts = self._split(x, bounds)
        after = np.searchsorted(starts, bounds[1:])  # words up to the end of each text
        dense = raw.translate(None, b" ")
        at = np.append(starts - np.cumsum(x == 0x20, dtype=np.int32)[starts], len(dense)).astype(np.int64)
        coded = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(dense)]).dictionary_encode()
        _, at, letters = coded.dictionary.buffers()
        at = np.frombuffer(at, np.int64)[: len(coded.dictionary) + 1].tolist() if at else [0]
        letters = letters.to_pybytes() if letters else b""
        words = [letters[a:b] for a, b in zip(at, at[1:], strict=False)]
        if len(self.memo) > MEMO:
            self.memo, self.older = {}, self.memo
        found = list(map(self.memo.get, words))
        holes = [i for i, ids in enumerate(found) if ids is None]
        self.learn([words[i] for i in holes])
        for i in holes:
            found[i] = self.memo[words[i]]
        found.append(end)
        flat = np.frombuffer(b"".join(found), self.kind)
        size = np.fromiter(map(len, found), np.int64, len(found)) // flat.itemsize
        order = np.insert(coded.indices.to_numpy(), after[closes], len(words))
        own = size[order]
        total = np.concatenate([[0], np.cumsum(own)])
        ids = flat[np.repeat((np.cumsum(size) - size)[order] - total[:-1], own) + np.arange(total[-1])]
        return ids, np.diff(total[after + np.cumsum(closes)], prepend=0)

    def pieces(self, texts: pa.Array, end: bytes) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, how many each text has, whether it closes a document) of about PIECE bytes of texts at a time.

        A longer text is cut at blanks into several, of which the last one closes the document. Null texts are empty.
        """
        texts = texts.cast(pa.large_string()).fill_null("")
        _, at, raw = texts.buffers()
        at = np.frombuffer(at, np.int64)[texts.offset :][: len(texts) + 1] if len(texts) else np.zeros(1, np.int64)
        i = 0
        while i < len(texts):
            stop = max(i + 1, int(np.searchsorted(at, at[i] + PIECE, side="right")) - 1)
            part = raw.slice(int(at[i]), int(at[stop] - at[i])).to_pybytes() if raw else b""
            bounds = at[i : stop + 1] - at[i]
            cut = 0
            while len(bounds) == 2 and len(part) - cut > PIECE and (blank := part.find(b" ", cut + PIECE)) >= 0:
                # The blank itself is nothing; words on both sides stay whole.
                yield *self._piece(part[cut:blank], np.array([0, blank - cut]), np.zeros(1, bool), end), np.zeros(1, bool)
                cut = blank + 1
            bounds = np.maximum(bounds - cut, 0)
            closes = np.ones(len(bounds) - 1, dtype=bool)
            yield *self._piece(part[cut:], bounds, closes, end), closes
            i = stop

    def encode(self, texts: list[str | None]) -> list[bytes]:
        """The ids of each text as bytes."""
        out, own = [], []
        for ids, sizes, closes in self.pieces(pa.array(texts, pa.string()), b""):
            for part, close in zip(np.split(ids, np.cumsum(sizes)[:-1]), closes.tolist(), strict=True):
                own.append(part.tobytes())
                if close:
                    out.append(b"".join(own))
                    own = []
        return out


class SharedEncoder:
    """What is broadcast of an encoder: its file. Each worker process opens it once, keeps it for all tasks of the job, and
    lets it go with the broadcast, so that other jobs don't find the memory taken."""

    def __init__(self, path: str):
        self.path, self.encoder = path, None

    def get(self) -> WordEncoder:
        if self.encoder is None:
            self.encoder = WordEncoder(self.path)
        return self.encoder


def encode_shards(docs: DataFrame, tokenizer: str, end_id: int = END_ID, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """A row with a wavelet matrix for each shard; shards ordered by (shard_part, shard_seq) hold ascending ids of documents.

    Every document is its ids and end_id. Null texts and texts without a token are end_id alone; null ids come last;
    rows of one id are ordered by a hash of their text and all stay; an empty table has no shard. The documents are dealt
    by ranges of their ids, so each task reads a bounded, sorted part and writes shards of about SHARD_TOKENS ids;
    a longer document has a longer shard.
    """
    shared = docs.sparkSession.sparkContext.broadcast(SharedEncoder(tokenizer))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        encoder = shared.value.get()
        end = np.array([end_id], dtype=encoder.kind).tobytes()
        part, seq, ids, doc_ids, ends, size = TaskContext.get().partitionId(), 0, [], [], [], 0

        def shard() -> pa.RecordBatch:
            m = WaveletMatrix.build(np.concatenate(ids), encoder.width)
            rows = {
                "shard_part": part,
                "shard_seq": seq,
                "n_tokens": m.n,
                "width": encoder.width,
                "zeros": m.zeros.tolist(),
                "planes": m.planes.tobytes(),
                "ranks": m.ranks.tobytes(),
                "doc_ids": doc_ids,
                "ends": ends,
            }
            longs = pa.list_(pa.int64())
            kinds = [pa.int32(), pa.int32(), pa.int64(), pa.int32(), pa.list_(pa.int32()), pa.binary(), pa.binary(), longs, longs]
            return pa.RecordBatch.from_arrays([pa.array([v], k) for v, k in zip(rows.values(), kinds, strict=True)], list(rows))

        for batch in batches:
            names = iter(batch.column(0).to_pylist())
            for found, sizes, closes in encoder.pieces(batch.column(1), end):
                used = at = 0
                for n, close in zip(sizes.tolist(), closes.tolist(), strict=True):
                    at += n
                    size += n
                    if not close:
                        continue
                    doc_ids.append(next(names))
                    ends.append(size)
                    if size >= SHARD_TOKENS:
                        ids.append(found[used:at])
                        yield shard()
                        used, seq, ids, doc_ids, ends, size = at, seq + 1, [], [], [], 0
                ids.append(found[used:])
        if doc_ids:
            yield shard()

    picked = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")).withColumn("tie", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_last(), F.col("tie")]
    return picked.repartitionByRange(*order).sortWithinPartitions(*order).select("doc_id", "text").mapInArrow(run, SHARD)


def _matrices(batch: pa.RecordBatch) -> Iterator[tuple[dict, WaveletMatrix]]:
    for row in batch.to_pylist():
        yield row, WaveletMatrix.from_row(row["n_tokens"], row["width"], row["zeros"], row["planes"], row["ranks"])


def shard_starts(shards: DataFrame) -> DataFrame:
    """(shard_part, shard_seq, shard_start): ids before each shard. Sums per part first, then within the part."""
    heads = shards.select("shard_part", "shard_seq", "n_tokens")
    parts = heads.groupBy("shard_part").agg(F.sum("n_tokens").alias("all"))  # a row for each partition of the write
    before = F.sum("all").over(W.orderBy("shard_part").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("all")
    own = F.sum("n_tokens").over(W.partitionBy("shard_part").orderBy("shard_seq").rowsBetween(W.unboundedPreceding, W.currentRow)) - F.col("n_tokens")
    return heads.join(parts.select("shard_part", before.alias("before")), "shard_part").select("shard_part", "shard_seq", (F.col("before") + own).alias("shard_start"))


def read_documents(shards: DataFrame) -> DataFrame:
    """(doc_id, start, n_tokens, ids_crc32) of every document, from its ids as they come out of the shards' planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, m in _matrices(batch):
                ids, start, out = m.ids().astype("<u4"), 0, []
                for end in row["ends"]:
                    out.append((start, end - start, zlib.crc32(ids[start:end].tobytes())))
                    start = end
                a, n, c = (np.array(x, dtype=np.int64) for x in zip(*out, strict=True))
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(a), row["shard_part"], np.int32)), pa.array(np.full(len(a), row["shard_seq"], np.int32)), pa.array(row["doc_ids"], pa.int64()), pa.array(a), pa.array(n), pa.array(c)], ["shard_part", "shard_seq", "doc_id", "own", "n_tokens", "ids_crc32"])

    rows = shards.mapInArrow(run, "shard_part int, shard_seq int, doc_id long, own long, n_tokens long, ids_crc32 long")
    starts = shard_starts(shards)
    return rows.join(starts, ["shard_part", "shard_seq"]).select("doc_id", (F.col("shard_start") + F.col("own")).alias("start"), "n_tokens", "ids_crc32")


def count_tokens(shards: DataFrame, tokens: list[int]) -> DataFrame:
    """(token, n): occurrences in all shards, by rank on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, m in _matrices(batch):
                yield pa.RecordBatch.from_arrays([pa.array(tokens, pa.int32()), pa.array([m.count(t) for t in tokens], pa.int64())], ["token", "n"])

    return shards.mapInArrow(run, "token int, n long").groupBy("token").agg(F.sum("n").alias("n"))


def occurrences(shards: DataFrame, token: int) -> DataFrame:
    """(doc_id, position): every place of an id, counted from the corpus' first id, by select on the planes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row, m in _matrices(batch):
                found = np.array([m.occurrence(token, k) for k in range(m.count(token))], dtype=np.int64)
                docs = [row["doc_ids"][i] for i in np.searchsorted(row["ends"], found, side="right")]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(found), row["shard_part"], np.int32)), pa.array(np.full(len(found), row["shard_seq"], np.int32)), pa.array(docs, pa.int64()), pa.array(found)], ["shard_part", "shard_seq", "doc_id", "own"])

    rows = shards.mapInArrow(run, "shard_part int, shard_seq int, doc_id long, own long")
    return rows.join(shard_starts(shards), ["shard_part", "shard_seq"]).select("doc_id", (F.col("shard_start") + F.col("own")).alias("position"))


def token_documents(docs: DataFrame, tokenizer: str | None = None) -> DataFrame:
    """Writes docs as shards into the shared folder and gives back what the shards hold of each document."""
    if tokenizer is None:
        import public_tokenizers

        tokenizer = str(Path(public_tokenizers.path("word_bpe_49k.json")))
    return read_documents(materialize(encode_shards(docs, tokenizer), "token-shards"))


def op3_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_documents(read(spark, sf_dir, "documents"))
