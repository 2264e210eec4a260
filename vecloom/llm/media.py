"""Operator 3, media columns: content-addressed payloads in tar shards.

A text's UTF-8 bytes, padded with zeros to a positive multiple of 64, are stored losslessly as an
8-bit grey PNG 64 samples wide. Each task appends the PNGs of its rows to its own tar shards, once
for each digest in a shard, so a hot group of copies costs one payload a shard and no row is ever
shuffled. Rows carry digest, shard, offset and length. Shard names hold the task attempt, and a shard
gets its name only when it is whole, so a lost or repeated attempt leaves rows of other attempts
intact. header_columns reads 33 bytes a payload; media_features reads the stored bytes back.

Defined cases: null or empty text is 64 zero bytes; equal texts have equal values; a null doc_id
stays; repeated rows repeat; other columns are ignored; an empty table writes no shard.
"""

from __future__ import annotations

import hashlib

import struct
import tarfile
import zlib

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import batch_of, scratch, text_batches, text_bytes

WIDTH = 64
PNG_HEAD = 33  # signature, then the IHDR chunk
STORED = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("digest", pa.string()), ("shard", pa.string()), ("offset", pa.int64()), ("length", pa.int64())])
STORED_DDL = "doc_id long, n_bytes long, digest string, shard string, offset long, length long"
FEATURES = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("payload_bytes", pa.int64()), ("payload_sha256", pa.string()), ("tail_crc32", pa.int64()), ("media_bytes", pa.int64()), ("media_sha256", pa.string()), ("feature", pa.string()), ("width", pa.int64()), ("height", pa.int64())])
FEATURES_DDL = "doc_id long, n_bytes long, payload_bytes long, payload_sha256 string, tail_crc32 long, media_bytes long, media_sha256 string, feature string, width long, height long"
HEADERS = pa.schema([*STORED, ("width", pa.int64()), ("height", pa.int64()), ("bit_depth", pa.int64()), ("colour_type", pa.int64())])
HEADERS_DDL = STORED_DDL + ", width long, height long, bit_depth long, colour_type long"

def padded(text: bytes) -> bytes:
    return text + bytes(-len(text) % WIDTH if text else WIDTH)

def _chunk(kind: bytes, data: bytes) -> bytes:
    return struct.pack(">I", len(data)) + kind + data + struct.pack(">I", zlib.crc32(kind + data))

def to_png(payload: bytes) -> bytes:
    """8-bit grey, WIDTH samples a row, every row unfiltered."""
    rows = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    raw = np.zeros((len(rows), WIDTH + 1), np.uint8)
    raw[:, 1:] = rows
    return b"\x89PNG\r\n\x1a\n" + _chunk(b"IHDR", struct.pack(">IIBBBBB", WIDTH, len(rows), 8, 0, 0, 0, 0)) + _chunk(b"IDAT", zlib.compress(raw.tobytes(), 6)) + _chunk(b"IEND", b"")

def png_header(head: bytes) -> tuple[int, int, int, int]:
    """Width, height, bit depth and colour type from the first PNG_HEAD bytes."""
    return struct.unpack(">IIBB", head[16:26])

def from_png(png: bytes) -> bytes:
    """The samples of what to_png wrote; rows with another filter are refused."""
    at, data = 8, b""
    while at < len(png):
        n, kind = struct.unpack(">I4s", png[at:at + 8])
        if kind == b"IDAT":
            data += png[at + 8:at + 8 + n]
        at += 12 + n
    rows = np.frombuffer(zlib.decompress(data), np.uint8).reshape(-1, png_header(png)[0] + 1)
    if rows[:, 0].any():
        raise ValueError("unexpected PNG row filter")
    return rows[:, 1:].tobytes()

def feature_of(payload: bytes) -> str:
    """64 bits, one for each sample column: its mean is above the image's; then mean and deviation."""
    image = np.frombuffer(payload, np.uint8).reshape(-1, WIDTH)
    total = image.sum(axis=0, dtype=np.int64)
    bits = np.packbits(total * WIDTH > total.sum()).tobytes().hex()
    return f"{bits}:{image.mean():.4f}:{image.std():.4f}"

class ShardWriter:
    """Tar shards of up to `most` bytes under folder; add() gives a payload's place."""

    def __init__(self, folder: str, name: str, most: int):
        self.fs, self.base = fs.FileSystem.from_uri(folder)
        self.name, self.most, self.count, self.out = name, most, 0, None

    def add(self, digest: str, png: bytes) -> tuple[str, int, int]:
        if self.out is None or self.out.tell() >= self.most:
            self.close()
            self.shard, self.places = f"{self.name}-{self.count:05d}.tar", {}
            self.count += 1
            self.fs.create_dir(self.base, recursive=True)
            self.out = self.fs.open_output_stream(f"{self.base}/.{self.shard}")
        info = tarfile.TarInfo(f"{digest}.png")
        info.size = len(png)
        self.out.write(info.tobuf(tarfile.USTAR_FORMAT))
        self.places[digest] = place = (self.shard, self.out.tell(), len(png))
        self.out.write(png + bytes(-len(png) % tarfile.BLOCKSIZE))
        return place

    def find(self, digest: str) -> tuple[str, int, int] | None:
        return self.places.get(digest) if self.out is not None else None

    def close(self) -> None:
        if self.out is not None:
            self.out.write(bytes(2 * tarfile.BLOCKSIZE))
            self.out.close()
            self.fs.move(f"{self.base}/.{self.shard}", f"{self.base}/{self.shard}")
            self.out = None

def store_media(docs: DataFrame, folder: str, shard_bytes: int = 256 << 20) -> DataFrame:
    """Write every row's payload under folder; the catalogue is kept there too, as Parquet, and returned."""

    def run(batches):
        task = TaskContext.get()
        w = ShardWriter(f"{folder}/shards", f"shard-{task.partitionId():06d}-{task.taskAttemptId()}", shard_bytes)
        for b in batches:
            rows = []
            for i, text in enumerate(b.column(1)):
                text = text.as_py()
                payload = padded(text)
                digest = hashlib.sha256(payload).hexdigest()
                rows.append((len(text), digest, *(w.find(digest) or w.add(digest, to_png(payload)))))
            n, *rest = map(list, zip(*rows)) if rows else [[]] * 5
            yield batch_of(STORED, b.column(0), n, *rest)
        w.close()

    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text")).mapInArrow(run, STORED_DDL)
    text_batches(docs.sparkSession)
    # a shard is named before the task's last row is out, so rows and shards are kept or lost together
    rows.write.parquet(f"{folder}/catalogue")
    return docs.sparkSession.read.schema(STORED_DDL).parquet(f"{folder}/catalogue")

class RangeReader:
    """Range reads from shards; the shard read last stays open."""

    def __init__(self, folder: str):
        self.fs, self.base = fs.FileSystem.from_uri(f"{folder}/shards")
        self.shard = self.file = None

    def read(self, shard: str, offset: int, length: int) -> bytes:
        if shard != self.shard:
            self.shard, self.file = shard, self.fs.open_input_file(f"{self.base}/{shard}")
        return self.file.read_at(length, offset)

def header_columns(stored: DataFrame, folder: str) -> DataFrame:
    """The catalogue's columns and the metadata columns, which header-only range reads fill."""

    def run(batches):
        reader = RangeReader(folder)
        for b in batches:
            rows = b.select(["shard", "offset"]).to_pylist()
            heads = [png_header(reader.read(r["shard"], r["offset"], PNG_HEAD)) for r in rows]
            yield batch_of(HEADERS, *b.columns, *(map(list, zip(*heads)) if heads else [[]] * 4))

    return stored.mapInArrow(run, HEADERS_DDL)

def media_features(stored: DataFrame, folder: str) -> DataFrame:
    """The stored payloads, read back: sizes, digests and features; width and height come from header_columns."""
    if "width" not in stored.columns:
        stored = header_columns(stored, folder)

    def run(batches):
        reader, last, known = RangeReader(folder), None, {}
        for b in batches:
            rows = []
            for r in b.to_pylist():
                if r["shard"] != last:
                    last, known = r["shard"], {}
                if (value := known.get(r["offset"])) is None:
                    png = reader.read(r["shard"], r["offset"], r["length"])
                    payload = from_png(png)
                    value = known[r["offset"]] = (len(payload), hashlib.sha256(payload).hexdigest(), zlib.crc32(payload[-WIDTH:]), len(png), hashlib.sha256(png).hexdigest(), feature_of(payload))
                rows.append(value)
            yield batch_of(FEATURES, b.column("doc_id"), b.column("n_bytes"), *(map(list, zip(*rows)) if rows else [[]] * 6), b.column("width"), b.column("height"))

    return stored.mapInArrow(run, FEATURES_DDL)

def op3_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = scratch(spark, "media")
    stored = store_media(spark.read.parquet(f"{sf_dir}/documents.parquet"), folder)
    return media_features(header_columns(stored, folder), folder)
