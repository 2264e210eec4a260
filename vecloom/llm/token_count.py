"""Operator 5, token counts: heap-and-linked-list byte-pair merging without emitting identifiers.

A piece starts as its bytes' symbols in a doubly linked list. A heap holds the rank and position of
every mergeable adjacent pair; the lowest rank (leftmost on ties) is popped, merged in place and its
two new neighbours pushed. The count is the initial symbols minus the merges done. Equal pieces of a
text share one count through a bounded cache.

Defined cases: null or empty text has 0 bytes and 0 tokens; repeated rows repeat; other columns are
ignored; an added token's string inside a text counts as one token, as the library's default has it.
"""

from __future__ import annotations

import json
from functools import cache
from heapq import heapify, heappop, heappush

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import batch_of, text_batches, tokenizer_path
from vecloom.llm.pieces import PieceCache, byte_symbols, pieces_of

COUNTS = pa.schema([("doc_id", pa.int64()), ("n_bytes", pa.int64()), ("n_tokens", pa.int64()), ("over_limit", pa.bool_())])
COUNTS_DDL = "doc_id long, n_bytes long, n_tokens long, over_limit boolean"


class PairMerger:
    """Counts tokens from the merge list of a byte-level BPE tokenizer file."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        vocab, byte_of = spec["model"]["vocab"], byte_symbols()
        self.first = [0] * 256
        for c, b in byte_of.items():
            self.first[b] = vocab[c]
        self.merges: dict[tuple[int, int], tuple[int, int]] = {}
        for rank, m in enumerate(spec["model"]["merges"]):
            a, b = m.split(" ") if isinstance(m, str) else m
            self.merges.setdefault((vocab[a], vocab[b]), (rank, vocab[a + b]))
        added = sorted((t["content"] for t in spec["added_tokens"]), key=len, reverse=True)
        self.added = regex.compile("|".join(map(regex.escape, added))) if added else None
        self.cache = PieceCache(self.count_piece)
        self.path = path

    def count_piece(self, piece: str) -> int:
        sym = [self.first[b] for b in piece.encode()]
        n = len(sym)
        if n < 2:
            return n
        merges = self.merges
        heap = [(m[0], i, m[1], sym[i], sym[i + 1]) for i in range(n - 1) if (m := merges.get((sym[i], sym[i + 1])))]
        heapify(heap)
        left, right, end, count = list(range(-1, n - 1)), list(range(1, n + 1)), n, n
        while heap:
            _, i, new, a, b = heappop(heap)
            j = right[i]
            if sym[i] != a or j >= end or sym[j] != b:
                continue  # one side has merged since
            sym[i], sym[j] = new, -1
            k = right[i] = right[j]
            if k < end:
                left[k] = i
            count -= 1
            if (h := left[i]) >= 0 and (m := merges.get((sym[h], new))):
                heappush(heap, (m[0], h, m[1], sym[h], new))
            if k < end and (m := merges.get((new, sym[k]))):
                heappush(heap, (m[0], i, m[1], new, sym[k]))
        return count

    def _count_plain(self, text: str) -> int:
        pieces = pieces_of(text)
        return sum(map(self.cache.__getitem__, self.odd_pieces(text) if pieces is None else pieces))

    def odd_pieces(self, text: str) -> list[str]:
        """The library's own split, for texts with characters of rare blocks."""
        byte_of = byte_symbols()
        return [bytes(byte_of[c] for c in p).decode("utf-8", "surrogateescape") for p, _ in library(self.path).pre_tokenizer.pre_tokenize_str(text)]

    def count(self, text: str) -> int:
        if self.added is None or not self.added.search(text):
            return self._count_plain(text)
        parts = self.added.split(text)
        return len(parts) - 1 + sum(map(self._count_plain, parts))


@cache
def library(path: str):
    from tokenizers import Tokenizer

    return Tokenizer.from_file(path)


@cache
def merger(path: str) -> PairMerger:
    return PairMerger(path)


def count_tokens(docs: DataFrame, tokenizer: str | None = None, limit: int = 512) -> DataFrame:
    """doc_id, n_bytes, n_tokens, over_limit (n_tokens > limit) for every row of docs."""
    path = tokenizer or tokenizer_path("byte_bpe_50k.json")
    text_batches(docs.sparkSession)

    def run(batches):
        m = merger(path)
        for b in batches:
            n = [m.count(t or "") for t in b.column(1).to_pylist()]
            yield batch_of(COUNTS, b.column(0), b.column(2), n, [x > limit for x in n])

    rows = docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string"), F.coalesce(F.octet_length("text"), F.lit(0)).cast("long").alias("n_bytes"))
    return rows.mapInArrow(run, COUNTS_DDL)


def op5_token_count(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark.read.parquet(f"{sf_dir}/documents.parquet"))
