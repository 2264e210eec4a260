"""Operator 6, benchmark decontamination by winnowing.

A text's fingerprints are the minimum k-gram hash of every run of `window - k + 1` successive
k-grams (the rightmost on ties), so two texts that share a span of `window` words share the
fingerprint of that span. Fingerprints of documents are joined with those of the benchmark, and each
hit is extended: the words around it are compared with every item that has the fingerprint, and the
item windows that occur whole mark their words. Items shorter than a window are one window of their
own length; for them k and the run shrink with the length, and the same guarantee holds.

The benchmark's fingerprints are broadcast if they fit a checked bound; otherwise documents'
fingerprints are shuffled to join them and only documents with a hit are read again. Both ways end
in the same extension.

Defined cases: null or empty text has no words and is clean; an item without words has no window;
items with the same item_id count once; a null item_id counts as one item named by the empty string;
repeated documents repeat; other columns pass through the filter; empty tables are fine.
"""

from __future__ import annotations

import hashlib
import uuid
from collections import defaultdict

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import BROADCAST_BYTES, KEPT, batch_of, text_batches, text_bytes
from vecloom.llm.hashing import gram_hashes, word_hashes

WINDOW, K = 13, 5
#: Hits of one fingerprint, in a text and an item, up to which each is extended along its own diagonal.
DIAGONALS = 64
#: Fixed by the contract: words are runs of digits, lower-case ASCII letters and bytes from 0x80 on.
WORD_TABLE = bytes(b if 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A or b >= 0x80 else 0x20 for b in range(256))
HITS = pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_())])
HITS_DDL = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def words_of(text: bytes) -> list[bytes]:
    return text.lower().translate(WORD_TABLE).split()


def winnow(grams: np.ndarray, run: int) -> np.ndarray:
    """Positions of the fingerprints: of each `run` successive grams the rightmost minimum."""
    if len(grams) < run:
        return np.empty(0, np.int64)
    views = np.lib.stride_tricks.sliding_window_view(grams, run)
    pick = run - 1 - views[:, ::-1].argmin(axis=1) + np.arange(len(views))
    return np.unique(pick)


def shape(length: int) -> tuple[int, int]:
    """k and run for windows of so many words."""
    k = min(K, length)
    return k, length - k + 1


class Fingerprints:
    """The benchmark: for each window length its fingerprints, with (item, position) of each."""

    def __init__(self, items: list[tuple[str, bytes]]):
        self.items = [(name, w) for name, text in items if (w := words_of(text))]
        self.by_length: dict[int, dict[int, dict[int, list[int]]]] = defaultdict(lambda: defaultdict(lambda: defaultdict(list)))
        for i, (_, words) in enumerate(self.items):
            n = min(len(words), WINDOW)
            k, run = shape(n)
            grams = gram_hashes(word_hashes(words), k)
            for p in winnow(grams, run).tolist():
                self.by_length[n][int(grams[p])][i].append(p)
        self.arrays = {n: np.sort(np.fromiter(f, np.uint64, len(f))) for n, f in self.by_length.items()}

    def hits(self, words: list[bytes]) -> tuple[np.ndarray, set[str]]:
        """Which words are inside an occurrence of a window, and the items of those windows."""
        covered, found = np.zeros(len(words), bool), set()
        hashes = word_hashes(words)
        for n, known in self.arrays.items():
            k, run = shape(n)
            grams = gram_hashes(hashes, k)
            picked = winnow(grams, run)
            if not len(picked):
                continue
            at = np.searchsorted(known, grams[picked])
            at[at == len(known)] = 0
            met = picked[known[at] == grams[picked]]
            if not len(met):
                continue
            prints, counts = np.unique(grams[met], return_counts=True)
            often = {i for h, c in zip(prints.tolist(), counts.tolist()) for i, own in self.by_length[n][h].items() if c * len(own) > DIAGONALS}
            done: set[tuple[int, int]] = set()
            for p in met.tolist():
                for i, own in self.by_length[n][int(grams[p])].items():
                    for q in own if i not in often else ():
                        if (i, p - q) not in done:
                            done.add((i, p - q))
                            self._extend(words, i, p, q, k, n, covered, found)
            if often:
                self._sweep(words, often, n, covered, found)
        return covered, found

    def _sweep(self, words, often, n, covered, found) -> None:
        """Items that repeat a fingerprint, as does the document: all windows of both, in linear time."""
        inside: dict[tuple[bytes, ...], list[int]] = defaultdict(list)
        for i in often:
            item = self.items[i][1]
            for w in {tuple(item[q:q + n]) for q in range(len(item) - n + 1)}:
                inside[w].append(i)
        met: set[int] = set()
        for p in range(len(words) - n + 1):
            if own := inside.get(tuple(words[p:p + n])):
                covered[p:p + n] = True
                met.update(own)
        found.update(self.items[i][0] for i in met)

    def _extend(self, words, i, p, q, k, n, covered, found) -> None:
        """Every shared span of item i and the document along the diagonal of one hit."""
        name, item = self.items[i]
        shift = p - q  # document position of the item's first word
        lo, hi = max(0, -shift), min(len(item), len(words) - shift)
        start = None
        for j in range(lo, hi + 1):
            if j < hi and item[j] == words[j + shift]:
                start = j if start is None else start
            elif start is not None:
                if j - start >= n:
                    covered[start + shift:j + shift] = True
                    found.add(name)
                start = None


def judge(text: bytes, prints: Fingerprints) -> tuple[int, int, int, str, bool]:
    words = words_of(text)
    covered, found = prints.hits(words)
    n_hit = int(covered.sum())
    return len(words), n_hit, len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(n_hit > 0 and 20 * n_hit >= len(words))


def _item_rows(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), text_bytes().alias("text")).where(F.length("text") > 0)


def _small(benchmark: DataFrame, limit: int) -> bool:
    text_batches(benchmark.sparkSession)
    size = _item_rows(benchmark).agg(F.sum(F.length("text") + 64).alias("n")).first()["n"]
    return (size or 0) <= limit


def _broadcast_items(benchmark: DataFrame):
    """The items, in a broadcast variable; its size is checked before (_small)."""
    rows = sorted((r["item"], bytes(r["text"])) for r in _item_rows(benchmark).collect())
    return benchmark.sparkSession.sparkContext.broadcast(rows)


_PRINTS: dict[str, Fingerprints] = {}
KEPT.append(_PRINTS.clear)


def _prints(shared, name: str) -> Fingerprints:
    """One index a worker and broadcast."""
    if name not in _PRINTS:
        _PRINTS.clear()
        _PRINTS[name] = Fingerprints(shared.value)
    return _PRINTS[name]


def contamination(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES // 4) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs."""
    rows = docs.select(F.col("doc_id").cast("long"), text_bytes().alias("text"))
    if _small(benchmark, broadcast_bytes):
        shared, name = _broadcast_items(benchmark), uuid.uuid4().hex

        def run(batches):
            prints = _prints(shared, name)
            for b in batches:
                out = [judge(t.as_py(), prints) for t in b.column(1)]
                yield batch_of(HITS, b.column(0), *(map(list, zip(*out)) if out else [[]] * 5))

        return rows.mapInArrow(run, HITS_DDL)
    return _joined(rows, benchmark)


def _judged(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """key (sha256 of a text), n_words, n_hit, n_items, items_sha256, contaminated of the texts that share a fingerprint with an item.

    The way for a benchmark of any size: fingerprints meet in a shuffle join. A document with its
    items is one group: it is as large as the text and the items that share a fingerprint with it.
    Rows are numbered by content, as doc_id may repeat.
    """
    key = F.sha2("text", 256)
    docs = rows.select("text").withColumn("key", key).distinct()
    items = _item_rows(benchmark)
    prints = "fingerprint long, width int"
    lengths = [r["n"] for r in items.mapInArrow(_lengths, "n int").distinct().collect()]  # at most WINDOW of them

    def fingerprint(of, name, own):
        def run(batches):
            for b in batches:
                out: tuple[list, list, list] = [], [], []
                for ident, text in zip(b.column(0).to_pylist(), b.column(1)):
                    words = words_of(text.as_py())
                    hashes = word_hashes(words)
                    for n in ([min(len(words), WINDOW)] if own else lengths) if words else []:
                        k, run_ = shape(n)
                        grams = gram_hashes(hashes, k)
                        for h in np.unique(grams[winnow(grams, run_)]).view(np.int64).tolist():
                            for column, v in zip(out, (ident, h, n)):
                                column.append(v)
                yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.int64()), pa.array(out[2], pa.int32())], names=[name, "fingerprint", "width"])

        return of.mapInArrow(run, f"{name} string, {prints}")

    items = items.withColumn("ikey", F.sha2(F.concat_ws("\x00", "item", F.hex("text")), 256)).dropDuplicates(["ikey"])
    pairs = fingerprint(docs.select("key", "text"), "key", False).join(fingerprint(items.select("ikey", "text"), "ikey", True), ["fingerprint", "width"]).select("key", "ikey").distinct()
    wanted = pairs.join(items.withColumnRenamed("text", "item_text"), "ikey").select("key", "item", "item_text")

    def decide(key_, docs_, items_):
        for t in docs_.column("text").to_pylist()[:1]:
            prints_ = Fingerprints(list(zip(items_.column("item").to_pylist(), items_.column("item_text").to_pylist())))
            n, hit, found, digest, bad = judge(t, prints_)
            return pa.table({"key": [key_[0].as_py()], "n_words": [n], "n_hit": [hit], "n_items": [found], "items_sha256": [digest], "contaminated": [bad]})
        return pa.table({n: pa.array([], t) for n, t in (("key", pa.string()), ("n_words", pa.int64()), ("n_hit", pa.int64()), ("n_items", pa.int64()), ("items_sha256", pa.string()), ("contaminated", pa.bool_()))})

    ddl = "key string, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"
    hit = docs.join(wanted.select("key").distinct(), "key", "left_semi")
    return hit.groupBy("key").cogroup(wanted.groupBy("key")).applyInArrow(decide, ddl)


def _joined(rows: DataFrame, benchmark: DataFrame) -> DataFrame:
    """Every row of (doc_id, text), with what _judged says of its text."""
    judged = _judged(rows, benchmark)

    def count(batches):
        for b in batches:
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array([len(words_of(t.as_py())) for t in b.column(1)], pa.int64()), b.column(2)], names=["doc_id", "own_words", "key"])

    counted = rows.select("doc_id", "text", F.sha2("text", 256).alias("key")).mapInArrow(count, "doc_id long, own_words long, key string")
    return counted.join(judged, "key", "left").select(
        "doc_id", F.col("own_words").alias("n_words"), F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.coalesce("n_items", F.lit(0)).cast("long").alias("n_items"),
        F.coalesce("items_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("items_sha256"), F.coalesce("contaminated", F.lit(False)).alias("contaminated"))


def _lengths(batches):
    for b in batches:
        found = sorted({min(len(w), WINDOW) for t in b.column(1) if (w := words_of(t.as_py()))})
        yield pa.RecordBatch.from_arrays([pa.array(found, pa.int32())], names=["n"])


def drop_contaminated(docs: DataFrame, benchmark: DataFrame, broadcast_bytes: int = BROADCAST_BYTES // 4) -> DataFrame:
    """The rows of docs that are not contaminated, all columns as they are."""
    if not _small(benchmark, broadcast_bytes):
        key = f"key_{uuid.uuid4().hex}"  # a name that no column of docs has
        bad = _judged(docs.select(text_bytes().alias("text")), benchmark).where("contaminated").select(F.col("key").alias(key))
        return docs.withColumn(key, F.sha2(text_bytes(), 256)).join(bad, key, "left_anti").select(*docs.columns)
    shared, name, at = _broadcast_items(benchmark), uuid.uuid4().hex, docs.columns.index("text")

    def run(batches):
        prints = _prints(shared, name)
        for b in batches:
            keep = [not judge((t.as_py() or "").encode(), prints)[4] for t in b.column(at)]
            yield b.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(run, docs.schema)


def op6_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


ORACLE = r"""
with d as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
b as (select coalesce(cast(item_id as varchar), '') as item, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
bn as (select item, w, least(13, len(w)) as n from b where len(w) > 0),
bw as (select distinct item, n, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as win from bn),
dn as (select doc_id, w, n from d, (select distinct n from bn) where len(w) >= n),
dw as (select doc_id, n, unnest(range(1, len(w) - n + 2)) as i, unnest(list_transform(range(1, len(w) - n + 2), lambda i: array_to_string(w[i:i + n - 1], ' '))) as win from dn),
hits as (select doc_id, item, n, i from dw join bw using (n, win)),
words as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from hits) group by 1),
items as (select doc_id, count(*) as n_items, sha256(string_agg(item, ',' order by item)) as items_sha256 from (select distinct doc_id, item from hits) group by 1)
select d.doc_id, cast(len(d.w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit, cast(coalesce(n_items, 0) as bigint) as n_items, coalesce(items_sha256, sha256('')) as items_sha256,
  coalesce(n_hit > 0 and 20 * n_hit >= len(d.w), false) as contaminated
from d left join words on words.doc_id = d.doc_id left join items on items.doc_id = d.doc_id
"""
