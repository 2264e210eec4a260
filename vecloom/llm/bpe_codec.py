"""Operator 10, byte-level BPE encoding and decoding by a monoid tree reduction.

A piece of text is encoded by halves: each half recursively, then the two token lists are joined.
The join re-encodes a window of i tokens left and j tokens right of the boundary and grows it until
the tokens outside provably stay: a token list is the encoding of its bytes exactly if every two
neighbours, encoded together, give the same two tokens again. Inside each half that holds already,
so the join is done when it holds at both edges of the window. Joining is associative, and so is
decoding: bytes concatenate up the same tree.

Defined cases: null or empty text has no tokens, its ids and decoded bytes are empty; repeated rows
repeat; other columns are ignored; special-token strings are ordinary text.
"""

from __future__ import annotations

import base64
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import KEPT, text_batches, tokenizer_path
from vecloom.llm.pieces import ODD, PieceCache, any_split, pieces_of

CODED_DDL = "doc_id long, ids array<int>, decoded binary"
LEAF_BYTES = 16
#: Rows of a batch that goes back to Spark.
OUT_ROWS = 250
NONE = 1 << 60


class TreeCodec:
    def __init__(self, path: str):
        with open(path, "rb") as f:
            self.rank = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
        self.bytes_of = {r: t for t, r in self.rank.items()}
        self.stable: dict[tuple[int, int], bool] = {}
        self.cache = PieceCache(self._cached, 250_000)

    def merge(self, piece: bytes) -> list[int]:
        """Encode a short piece: merge the lowest-ranked neighbours until none can be merged."""
        rank = self.rank.get
        parts = [piece[i:i + 1] for i in range(len(piece))]
        pair = [rank(piece[i:i + 2], NONE) for i in range(len(piece) - 1)]
        while pair and (best := min(pair)) != NONE:
            i = pair.index(best)
            parts[i] = new = parts[i] + parts.pop(i + 1)
            del pair[i]
            if i:
                pair[i - 1] = rank(parts[i - 1] + new, NONE)
            if i < len(pair):
                pair[i] = rank(new + parts[i + 1], NONE)
        return list(map(self.rank.__getitem__, parts))

    def stays(self, a: int, b: int) -> bool:
        """Whether tokens a and b next to each other encode as themselves."""
        key = (a, b)
        if (known := self.stable.get(key)) is None:
            if len(self.stable) >= 1_000_000:
                self.stable.clear()
            known = self.stable[key] = self.merge(self.bytes_of[a] + self.bytes_of[b]) == [a, b]
        return known

    def join(self, left: list[int], right: list[int]) -> list[int]:
        if not left or not right or self.stays(left[-1], right[0]):
            return left + right
        i = j = 1
        while True:
            i, j = min(i, len(left)), min(j, len(right))
            window = self.merge(b"".join(self.bytes_of[t] for t in left[len(left) - i:] + right[:j]))
            ok_left = i == len(left) or self.stays(left[-i - 1], window[0])
            ok_right = j == len(right) or self.stays(window[-1], right[j])
            if ok_left and ok_right:
                return left[:len(left) - i] + window + right[j:]
            i, j = i if ok_left else 2 * i, j if ok_right else 2 * j

    def encode_bytes(self, piece: bytes) -> list[int]:
        """Tree reduction over halves; the leaves have at most LEAF_BYTES bytes."""
        if len(piece) <= LEAF_BYTES:
            return self.merge(piece)
        half = len(piece) // 2
        return self.join(self.encode_bytes(piece[:half]), self.encode_bytes(piece[half:]))

    def decode(self, ids: list[int]) -> bytes:
        """Concatenation up the tree, the inverse of encode_bytes."""
        if len(ids) <= 64:
            return b"".join(map(self.bytes_of.__getitem__, ids))
        half = len(ids) // 2
        return self.decode(ids[:half]) + self.decode(ids[half:])

    def encode(self, text: str) -> list[int]:
        return [t for p in pieces(text) for t in self.encode_piece(p)]

    def encode_piece(self, piece: str) -> list[int]:
        raw = piece.encode()
        # as the library: a piece that is itself in the vocabulary is that one token
        return [self.rank[raw]] if raw in self.rank else self.encode_bytes(raw)

    def _cached(self, piece: str) -> bytes:
        return np.array(self.encode_piece(piece), np.int32).tobytes()

    def coded(self, text: str) -> tuple[np.ndarray, bytes]:
        """The ids of a text, and the bytes that they decode to."""
        ids = np.frombuffer(b"".join(map(self.cache.__getitem__, pieces(text))), np.int32)
        return ids, self.decode(ids.tolist())


@cache
def stand_in(c: str) -> str:
    """A common character of the class that tiktoken's split pattern sees in c.

    The library is asked: a letter, digit or sign and c are one piece only if both are of one class.
    """
    import public_tokenizers
    import tiktoken

    raw, ranks = c.encode(), {bytes([b]): b for b in range(256)}
    for first in b"a1!":
        for n in range(1, len(raw) + 1):
            ranks[bytes([first]) + raw[:n]] = len(ranks)
    lib = tiktoken.Encoding("classes", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})
    return next((first for first in "a1!" if len(lib.encode_ordinary(first + c)) == 1), c)


def pieces(text: str) -> list[str]:
    """The library's split: where the text has characters of rare blocks, through their stand-ins."""
    if (found := pieces_of(text)) is not None:
        return found
    out, at = [], 0
    for p in any_split()(ODD.sub(lambda m: stand_in(m[0]), text)):
        out.append(text[at:at + len(p)])
        at += len(p)
    return out


@cache
def codec(path: str) -> TreeCodec:
    return TreeCodec(path)


KEPT.append(codec.cache_clear)


def encode_documents(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, ids, decoded (the bytes of the ids) for every row of docs."""
    path = ranks or tokenizer_path("byte_bpe_multi_50k.tiktoken")
    text_batches(docs.sparkSession)

    def run(batches):
        c = codec(path)
        for b in batches:
            for at in range(0, b.num_rows, OUT_ROWS):
                part = b.slice(at, OUT_ROWS)
                ids, decoded = zip(*[c.coded(t or "") for t in part.column(1).to_pylist()])
                off = np.cumsum([0, *map(len, ids)])
                lists = pa.ListArray.from_arrays(pa.array(off, pa.int32()), pa.array(np.concatenate(ids)))
                yield pa.RecordBatch.from_arrays([part.column(0), lists, pa.array(decoded, pa.binary())], names=["doc_id", "ids", "decoded"])

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(run, CODED_DDL)


def encode_decode(docs: DataFrame, ranks: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids, decoded, and the digests ids_sha256 and decoded_sha256 of them, for every row of docs."""
    ids = F.sha2(F.array_join(F.col("ids").cast("array<string>"), ","), 256)
    return encode_documents(docs, ranks).select("doc_id", F.size("ids").cast("long").alias("n_tokens"), "ids", "decoded", ids.alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


def op10_bpe_codec(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_decode(spark.read.parquet(f"{sf_dir}/documents.parquet")).drop("ids", "decoded")
