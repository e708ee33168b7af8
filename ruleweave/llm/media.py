"""Documents as ISO base media files, and the walk that reads such files' tables."""

from __future__ import annotations

import hashlib
import struct
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ruleweave.llm.common import flat_map, materialize, read

#: A media sample has 64 bytes (64 PCM values of 8 bits), a chunk up to 64 samples, of which the first is a sync sample.
SAMPLE, PER_CHUNK, RATE = 64, 64, 8000
CONTAINERS = {b"moov", b"trak", b"mdia", b"minf", b"stbl", b"edts", b"dinf"}
#: Boxes that decode() reads, and the depth to which boxes are opened (sample tables lie at a depth of five).
TABLES = {b"stsd", b"stts", b"stsc", b"stsz", b"stco", b"co64", b"stss", b"mdhd"}
DEEPEST = 16
MATRIX = struct.pack(">9I", 0x10000, 0, 0, 0, 0x10000, 0, 0, 0, 0x40000000)


def box(kind: bytes, *parts: bytes) -> bytes:
    body = b"".join(parts)
    if len(body) + 8 < 1 << 32:
        return struct.pack(">I4s", len(body) + 8, kind) + body
    return struct.pack(">I4sQ", 1, kind, len(body) + 16) + body


def full(kind: bytes, *parts: bytes, version: int = 0, flags: int = 0) -> bytes:
    return box(kind, struct.pack(">I", version << 24 | flags), *parts)


def pad(data: bytes) -> bytes:
    """data and zero bytes up to the next positive multiple of 64."""
    return data + bytes(-len(data) % SAMPLE or (0 if data else SAMPLE))


def store(payload: bytes) -> bytes:
    """A media file with one track of uncompressed 8-bit audio (`ipcm`) that holds the payload as samples of 64 bytes."""
    n = len(payload) // SAMPLE
    chunks = -(-n // PER_CHUNK)
    ftyp = box(b"ftyp", b"isom", struct.pack(">I", 512), b"isom", b"iso6")
    data_box = box(b"mdat", payload)
    head = len(data_box) - len(payload)
    entry = box(b"ipcm", bytes(6), struct.pack(">H", 1), bytes(8), struct.pack(">HHHHI", 1, 8, 0, 0, RATE << 16), full(b"pcmC", bytes([1, 8])))
    runs = [(1, PER_CHUNK)] * (n >= PER_CHUNK) + [(chunks, n % PER_CHUNK)] * (n % PER_CHUNK > 0)

    def moov(base: int) -> bytes:
        offsets = [base + k * PER_CHUNK * SAMPLE for k in range(chunks)]
        wide = base + len(payload) >= 1 << 32
        table = box(
            b"stbl",
            full(b"stsd", struct.pack(">I", 1), entry),
            full(b"stts", struct.pack(">III", 1, n, SAMPLE)),
            full(b"stsc", struct.pack(">I", len(runs)), *(struct.pack(">III", a, b, 1) for a, b in runs)),
            full(b"stsz", struct.pack(">II", SAMPLE, n)),
            full(b"stss", struct.pack(f">I{chunks}I", chunks, *range(1, n + 1, PER_CHUNK))),
            full(b"co64" if wide else b"stco", struct.pack(f">I{chunks}{'Q' if wide else 'I'}", chunks, *offsets)),
        )
        span = n * SAMPLE
        mdhd = full(b"mdhd", struct.pack(">QQIQHH", 0, 0, RATE, span, 0x55C4, 0), version=1)
        hdlr = full(b"hdlr", struct.pack(">I4s", 0, b"soun"), bytes(12), b"text\0")
        minf = box(b"minf", full(b"smhd", bytes(4)), box(b"dinf", full(b"dref", struct.pack(">I", 1), full(b"url ", flags=1))), table)
        tkhd = full(b"tkhd", struct.pack(">QQIIQ", 0, 0, 1, 0, span), bytes(8), struct.pack(">HHHH", 0, 0, 0x100, 0), MATRIX, bytes(8), version=1, flags=3)
        mvhd = full(b"mvhd", struct.pack(">QQIQIH", 0, 0, RATE, span, 0x10000, 0x100), bytes(10), MATRIX, bytes(24), struct.pack(">I", 2), version=1)
        return box(b"moov", mvhd, box(b"trak", tkhd, box(b"mdia", mdhd, hdlr, minf)))

    front = len(ftyp) + len(moov(1 << 32 if len(payload) >= 1 << 31 else 0)) + head
    return ftyp + moov(front) + data_box


def walk(data: bytes) -> Iterator[tuple[tuple[bytes, ...], int, int]]:
    """(path of kinds, first byte of the body, end) of every box, parents first.

    A box that overruns its parent ends the parent's walk; boxes deeper than DEEPEST aren't opened.
    """
    open_boxes: list[tuple[int, int, tuple[bytes, ...]]] = [(0, len(data), ())]
    while open_boxes:
        start, end, path = open_boxes.pop()
        if start + 8 > end:
            continue
        size, kind = struct.unpack_from(">I4s", data, start)
        body = start + 8
        if size == 1 and start + 16 <= end:
            size, body = struct.unpack_from(">Q", data, start + 8)[0], start + 16
        elif size == 0:
            size = end - start
        if size < body - start or start + size > end:
            continue
        yield (*path, kind), body, start + size
        open_boxes.append((start + size, end, path))
        if kind in CONTAINERS and len(path) < DEEPEST:
            open_boxes.append((body, start + size, (*path, kind)))


def tables(data: bytes) -> dict:
    """Codec, time scale, duration, channels, bits and the byte ranges of all chunks and sync samples of the first track.

    Only the boxes of the sample tables are decoded; the payload stays untouched. Bytes that are no media file, and files whose
    tables contradict each other, their boxes or the file's size, give a codec of None and empty ranges.
    """
    try:
        found = decode(data)
    except (struct.error, IndexError):  # a table ends before what it announces
        found = None
    return found or {"codec": None, "timescale": 0, "duration": 0, "channels": 0, "bits": 0, "samples": 0, "chunks": [], "keyframes": []}


def decode(data: bytes) -> dict | None:
    """tables() of a sound file; None or an error for others. Nothing larger than the file is believed."""
    boxes: dict[bytes, bytes] = {}
    for path, a, b in walk(data):
        if path[-1] in TABLES:
            boxes.setdefault(path[-1], data[a:b])
    if not {b"stsd", b"stsz", b"stsc", b"mdhd", b"stts"} <= boxes.keys() or not boxes.keys() & {b"stco", b"co64"}:
        return None

    def read_at(kind: bytes, form: str, at: int) -> tuple:
        return struct.unpack_from(">" + form, boxes[kind], at)

    def rows(kind: bytes, form: str, count: int, at: int = 8) -> list[tuple]:
        size = struct.calcsize(">" + form)
        if count * size > len(boxes[kind]) - at:
            raise struct.error(f"{kind!r} holds fewer rows than it announces")
        return list(struct.iter_unpack(">" + form, boxes[kind][at : at + count * size]))

    codec = read_at(b"stsd", "4s", 12)[0].decode("latin-1")
    channels, bits = read_at(b"stsd", "HH", 32)
    wide = boxes[b"mdhd"][0] == 1
    timescale, _ = read_at(b"mdhd", "IQ" if wide else "II", 20 if wide else 12)
    duration = sum(x * y for x, y in rows(b"stts", "II", *read_at(b"stts", "I", 4)))
    fixed, n = read_at(b"stsz", "II", 4)
    if fixed * n > len(data) or n > len(data):
        return None
    sizes = [] if fixed else [x for (x,) in rows(b"stsz", "I", n, 12)]
    kind = b"stco" if b"stco" in boxes else b"co64"
    offsets = [x for (x,) in rows(kind, "I" if kind == b"stco" else "Q", *read_at(kind, "I", 4))]
    runs = rows(b"stsc", "III", *read_at(b"stsc", "I", 4))
    sync = {x for (x,) in rows(b"stss", "I", *read_at(b"stss", "I", 4))} if b"stss" in boxes else None
    chunks, keyframes, sample, run = [], [], 0, 0
    for chunk, offset in enumerate(offsets, 1):
        while run + 1 < len(runs) and runs[run + 1][0] <= chunk:
            run += 1
        first, count = offset, runs[run][1]
        if sample + count > n:
            return None
        for i in range(sample, sample + count):
            size = fixed or sizes[i]
            if sync is None or i + 1 in sync:
                keyframes.append((offset, size))
            offset += size
        sample += count
        chunks.append((first, offset - first))
    return {"codec": codec, "timescale": timescale, "duration": duration, "channels": channels, "bits": bits, "samples": sample, "chunks": chunks, "keyframes": keyframes}


def payload(data: bytes, found: dict | None = None) -> bytes:
    """The bytes of all chunks in order."""
    return b"".join(data[a : a + n] for a, n in (found or tables(data))["chunks"])


def media_files(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_bytes, media): each whole text as a media file; a null text is empty and holds 64 zero bytes."""

    def run(batch: pa.RecordBatch) -> pa.RecordBatch:
        raw = [(t or "").encode("utf-8", "surrogatepass") for t in batch.column(1).to_pylist()]
        return pa.RecordBatch.from_arrays([batch.column(0), pa.array([len(r) for r in raw], pa.int64()), pa.array([store(pad(r)) for r in raw], pa.binary())], ["doc_id", "n_bytes", "media"])

    return flat_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), run, "doc_id long, n_bytes long, media binary")


FEATURES = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, codec string, duration double, keyframes array<struct<at:long,size:long>>, feature string"


def media_features(files: DataFrame) -> DataFrame:
    """What the sample tables of stored media say: codec, duration in seconds, byte ranges of the keyframes, checksums.

    Rows are independent; null ids and repeated rows pass through, an empty table gives an empty result.
    """

    def one(doc_id: int | None, n: int, data: bytes) -> dict:
        t = tables(data)
        p = payload(data, t)
        seconds = t["duration"] / t["timescale"] if t["timescale"] else 0.0
        feature = f"codec={t['codec']};rate={t['timescale']};channels={t['channels']};bits={t['bits']};duration={t['duration']};samples={t['samples']};chunks={len(t['chunks'])};keyframes={len(t['keyframes'])}"
        return {
            "doc_id": doc_id, "n_bytes": n, "payload_bytes": len(p), "payload_sha256": hashlib.sha256(p).hexdigest(), "tail_crc32": zlib.crc32(p[-64:]), "media_bytes": len(data), "media_sha256": hashlib.sha256(data).hexdigest(),
            "codec": t["codec"], "duration": seconds, "keyframes": [{"at": a, "size": b} for a, b in t["keyframes"]], "feature": feature,
        }

    kinds = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("codec", pa.string()), ("duration", pa.float64()), ("keyframes", pa.list_(pa.struct([("at", pa.int64()), ("size", pa.int64())]))), ("feature", pa.string())])
    return flat_map(files, lambda b: pa.RecordBatch.from_pylist([one(*r) for r in zip(*(c.to_pylist() for c in b.columns), strict=True)], schema=kinds), FEATURES)


def op7_media_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    files = materialize(media_files(read(spark, sf_dir, "documents")), "media")
    return media_features(files).select("doc_id", "n_bytes", "payload_bytes", "payload_sha256", "tail_crc32", "media_bytes", "media_sha256", "feature")
