"""Operator 1, token-ID output: ORC token shards in document order.

Documents are range-partitioned by id and sorted, each partition is encoded in order and written
as one ORC file: integer run-length encoded ids, a row index every `row_index_stride` rows and a
Bloom filter on the document id. Stripes are read in parallel, and a filter on doc_id skips files
and stripes by footer statistics and Bloom filters.

Columns of the shard: doc_id, part (range partition), local_start (ids before the document within
its part), n_tokens, ids. A document's global start is its part's base plus local_start; bases are
one row per part.

Defined cases: null or empty text gives the end id alone; a null doc_id sorts first; rows with the
same doc_id all stay, ordered by their text; other columns are ignored; an empty table gives no rows.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from vecloom.llm.common import scratch, text_batches, tokenizer_path
from vecloom.llm.pieces import PieceCache, byte_symbols, pieces_of

END_ID = 0
SHARD = pa.schema([("doc_id", pa.int64()), ("part", pa.int32()), ("local_start", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32()))])
SHARD_DDL = "doc_id long, part int, local_start long, n_tokens long, ids array<int>"


class LibraryEncoder:
    """Whole-text encoding by the tokenizers library, one call of its merge model for each piece not yet cached.

    Byte-level BPE never merges across the pieces of its split pattern, so a text's ids are its
    pieces' ids in a row. Texts that hold an added token or a character of a rare block (ODD) are
    given to the library whole.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.lib = Tokenizer.from_file(path)
        self.added = [t.content for t in self.lib.get_added_tokens_decoder().values()]
        self.shown = str.maketrans({chr(b): c for c, b in byte_symbols().items()})
        self.cache = PieceCache(self.encode_piece, 1_000_000)

    def encode_piece(self, piece: str) -> bytes:
        """The library's merges of one piece, written in the vocabulary's printable bytes."""
        if piece.isascii() and piece.isprintable():
            shown = piece.replace(" ", "Ġ")
        else:
            shown = piece.encode().decode("latin1").translate(self.shown)
        return array("I", [t.id for t in self.lib.model.tokenize(shown)]).tobytes()

    def encode_whole(self, text: str) -> bytes:
        return np.array(self.lib.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """The ids as little-endian unsigned 32-bit integers."""
        pieces = None if any(a in text for a in self.added) else pieces_of(text)
        return self.encode_whole(text) if pieces is None else b"".join(map(self.cache.__getitem__, pieces))


@cache
def encoder(path: str) -> LibraryEncoder:
    return LibraryEncoder(path)


def _encode_part(path: str):
    end = END_ID.to_bytes(4, "little")

    def run(batches):
        enc, part, at = encoder(path), TaskContext.get().partitionId(), 0
        for b in batches:
            ids, texts = b.column(0), b.column(1)
            for lo in range(0, b.num_rows, 512):
                blobs = [enc.encode(t or "") + end for t in texts.slice(lo, 512).to_pylist()]
                n = np.fromiter((len(x) // 4 for x in blobs), "i8", len(blobs))
                stop = np.cumsum(n)
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], stop]), pa.int32()), pa.array(np.frombuffer(b"".join(blobs), "<i4")))
                yield pa.RecordBatch.from_arrays([ids.slice(lo, 512), pa.array(np.full(len(n), part, "i4")), pa.array(at + stop - n), pa.array(n), lists], schema=SHARD)
                at += int(stop[-1])

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str | None = None, parts: int | None = None, row_index_stride: int = 1000, stripe_bytes: int = 32 << 20) -> None:
    """Encode documents (doc_id, text) in ascending doc_id order into ORC files under path."""
    text_batches(docs.sparkSession)
    tokenizer = tokenizer or tokenizer_path("byte_bpe_50k.json")
    d = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    # the partition count follows the input: with no count, Spark uses the session's and AQE may merge small ones
    # rows of one doc_id, null included, are dealt by the beginnings of their texts
    place = [F.col("doc_id"), F.substring("text", 1, 64)]
    d = d.repartitionByRange(parts, *place) if parts else d.repartitionByRange(*place)
    d = d.sortWithinPartitions("doc_id", "text").mapInArrow(_encode_part(tokenizer), SHARD_DDL)
    (d.write.option("compression", "zstd").option("orc.bloom.filter.columns", "doc_id").option("orc.row.index.stride", row_index_stride)
     .option("orc.stripe.size", stripe_bytes).option("orc.create.index", "true").orc(path))


def read_tokens(spark: SparkSession, path: str, doc_ids: list[int] | None = None) -> DataFrame:
    """doc_id, start, n_tokens, ids; with doc_ids, only those, by footer, row index and Bloom filter."""
    shard = spark.read.schema(SHARD_DDL).orc(path)
    sizes = shard.groupBy("part").agg(F.max(F.col("local_start") + F.col("n_tokens")).alias("n"))
    # one row per part: a total order over them is a small sort
    base = sizes.select("part", (F.sum("n").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, 0)) - F.col("n")).alias("base"))
    rows = shard if doc_ids is None else shard.where(F.col("doc_id").isin(doc_ids))
    return rows.join(F.broadcast(base), "part").select("doc_id", (F.col("base") + F.col("local_start")).alias("start"), "n_tokens", "ids")


CRC = pa.schema([("doc_id", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())])


def _crc(batches):
    for b in batches:
        lists = b.column(3)
        if not b.num_rows:
            continue
        flat, off = np.ascontiguousarray(lists.flatten().to_numpy(zero_copy_only=False).astype("<i4", copy=False)), lists.offsets.to_numpy()
        raw, off = memoryview(flat).cast("B"), (off - off[0]) * 4
        crc = [zlib.crc32(raw[off[i]:off[i + 1]]) for i in range(b.num_rows)]
        yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), pa.array(crc, pa.int64())], schema=CRC)


def token_digests(tokens: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of what read_tokens returns."""
    return tokens.mapInArrow(_crc, "doc_id long, start long, n_tokens long, ids_crc32 long")


def op1_token_output(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = scratch(spark, "tokens")
    write_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"), path)
    return token_digests(read_tokens(spark, path))
