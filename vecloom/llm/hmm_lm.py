"""Operator 9, LM scoring with a hidden Markov model over words and word classes.

A text is its words and one end token. A frequent word, one with 4 * sqrt(N) or more of the N training
tokens, is a class of its own, so that latent states emit it directly; their number grows with the
corpus, to sqrt(N) / 4 at most. Other words back off to classes by their last letters, and such a
class emits its words by add-one counts over all training tokens, with one share for the unseen. So
P(text) is the sum over state paths of the product of transition, class and word probabilities, and
the scaled forward recursion gives it exactly.

States are trained by Baum-Welch over whole texts: each pass runs over all training tokens, a task
returns expected counts that are summed by Spark, and the model goes back by broadcast. Long texts are
worked on in segments side by side, joined exactly by transfer matrices (Model.expected). Word counts
grow with the corpus and are never gathered: a chunk of documents has a dictionary of local token
numbers, the dictionaries join the counts by a hash of the word, and each chunk meets the counts of
its own dictionary again.

Defined cases: null, empty or blank text is the end token alone; a null doc_id is scored and is
learned from; repeated rows repeat; other columns are ignored; without training tokens every count
is 0.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from vecloom.llm.common import drop_stored, stored, text_batches, text_bytes

STATES, CLASSES, PASSES = 8, 1024, 4
#: A chunk ends with the batch that has so many tokens or bytes.
CHUNK_TOKENS, CHUNK_BYTES = 4_000_000, 1 << 27
#: Tokens of a segment, of a block whose forward vectors are held at once, and of texts gathered for a pass or for scores.
SEGMENT, BLOCK_TOKENS, POOL_TOKENS = 1024, 1 << 17, 1 << 21
#: Steps after which forward and backward vectors are scaled again; the product of so many smoothed probabilities stays far above 1e-308.
RESCALE = 8
END_HASH = int(np.uint64(xxhash.xxh3_64_intdigest(b"end", 1)).view(np.int64))


def class_of(word: bytes) -> int:
    """Class 0 is the end token's; words that have no class of their own have 1 to CLASSES - 1."""
    return 1 + zlib.crc32(word[-3:]) % (CLASSES - 1)


def hashes_of(words: list[bytes]) -> np.ndarray:
    return np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)).view(np.int64)


#: The crc32 register after one byte, by the byte that goes in.
CRC_TABLE = np.array([zlib.crc32(bytes([b]), 0xFFFFFFFF) ^ 0xFFFFFFFF for b in range(256)], np.uint32)


def classes_of(data: np.ndarray, ends: np.ndarray, n: np.ndarray) -> np.ndarray:
    """class_of for words of n bytes, at least one, that end at ends."""
    crc = np.full(len(n), 0xFFFFFFFF, np.uint32)
    for back in (3, 2, 1):
        step = CRC_TABLE[(crc ^ data[np.maximum(ends - back, 0)]) & 0xFF] ^ (crc >> 8)
        crc = np.where(n >= back, step, crc)
    return 1 + (crc ^ np.uint32(0xFFFFFFFF)) % np.uint32(CLASSES - 1)


class _Words:
    """Words of gathered texts: numbers in order of first occurrence, hashes and classes of the distinct ones."""

    def __init__(self):
        self.values, self.lengths, self.total, self.size = [], [], 0, 0

    def add(self, texts: pa.Array) -> None:
        """Texts are split at bytes 0x20 and 0x09 to 0x0D, as bytes.split does, whatever their other bytes are."""
        lists = pc.ascii_split_whitespace(pc.ascii_lower(texts.cast(pa.binary()).view(pa.string())))
        words, at = lists.values, lists.offsets.to_numpy()
        some = pc.binary_length(words).to_numpy() > 0
        if not some.all():  # a text that is empty, or begins or ends in space
            words, at = words.filter(pa.array(some)), np.concatenate([[0], np.cumsum(some)])[at]
        self.values.append(words)
        self.lengths.append(np.diff(at).astype(np.int64))
        self.total += len(words) + len(texts)
        self.size += texts.nbytes

    def numbered(self) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Words of each text, the number of each word, and by number hashes and classes."""
        chunks = pa.chunked_array(self.values, pa.string()).dictionary_encode().chunks or [pa.array([], pa.string()).dictionary_encode()]
        words = chunks[-1].dictionary
        _, at, data = words.buffers()
        at = np.frombuffer(at, np.int32)[words.offset:words.offset + len(words) + 1] if len(words) else np.zeros(1, np.int32)
        raw = data.to_pybytes() if data else b""
        hashes = hashes_of([raw[lo:hi] for lo, hi in zip(at[:-1].tolist(), at[1:].tolist())])
        classes = classes_of(np.frombuffer(raw, np.uint8), at[1:], np.diff(at))
        return np.concatenate(self.lengths), np.concatenate([c.indices.to_numpy() for c in chunks]), hashes, classes


def _count(batches):
    """Words of training texts with their counts; a task sends a word once, or once a chunk."""

    def send():
        lengths, numbers, hashes, classes = words.numbered()
        yield pa.RecordBatch.from_arrays([pa.array(np.append(hashes, END_HASH)), pa.array(np.append(classes, 0).astype(np.int32)), pa.array(np.append(np.bincount(numbers, minlength=len(hashes)), len(lengths)))], names=["h", "cls", "c"])

    words = _Words()
    for b in batches:
        words.add(b.column(0))
        if words.total >= CHUNK_TOKENS or words.size >= CHUNK_BYTES:
            yield from send()
            words = _Words()
    if words.total:
        yield from send()


CODEC = pa.Codec("zstd", compression_level=1)


def pack(numbers: np.ndarray) -> bytes:
    """Width, count and the compressed low bytes of all numbers, then their next bytes and so on."""
    width = numbers.itemsize
    planes = np.ascontiguousarray(numbers.view(np.uint8).reshape(-1, width).T)
    return bytes([width]) + len(numbers).to_bytes(8, "little") + CODEC.compress(planes, asbytes=True)


def unpack(packed: bytes) -> np.ndarray:
    width, n = packed[0], int.from_bytes(packed[1:9], "little")
    planes = np.frombuffer(CODEC.decompress(packed[9:], n * width), np.uint8).reshape(width, n)
    return np.ascontiguousarray(planes.T).view(f"u{width}").ravel()


# rows of documents have doc_id .. classes; rows of a chunk's dictionary have slot and h
CHUNKS = pa.schema([("chunk", pa.int64()), ("doc_id", pa.int64()), ("held_out", pa.bool_()), ("tokens", pa.binary()), ("classes", pa.binary()), ("slot", pa.int32()), ("h", pa.int64())])
CHUNKS_DDL = "chunk long, doc_id long, held_out boolean, tokens binary, classes binary, slot int, h long"


def _chunk(number: int, words: _Words, ids: list, held: list, own: np.ndarray):
    """Rows of a chunk's documents, then of its dictionary; slot 0 is the end token's."""
    lengths, numbers, hashes, classes = words.numbered()
    hashes, classes = np.append(END_HASH, hashes), np.append(0, classes)
    if len(own):
        at = np.searchsorted(own, hashes)
        at[at == len(own)] = 0
        classes = np.where(own[at] == hashes, CLASSES + at, classes)
    classes = classes.astype(np.uint16 if CLASSES + len(own) <= 1 << 16 else np.uint32)
    ends = np.cumsum(lengths + 1)
    tokens, word = np.zeros(ends[-1], np.uint32), np.ones(ends[-1], bool)
    word[ends - 1] = False
    tokens[word] = numbers + 1
    runs = list(zip((ends - lengths - 1).tolist(), ends.tolist()))
    of_class = classes[tokens]
    none = pa.nulls
    for lo in range(0, len(runs), 256):
        part = runs[lo:lo + 256]
        k = len(part)
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), pa.array(ids[lo:lo + k], pa.int64()), pa.array(held[lo:lo + k], pa.bool_()), pa.array([pack(tokens[i:j]) for i, j in part], pa.binary()), pa.array([pack(of_class[i:j]) for i, j in part], pa.binary()), none(k, pa.int32()), none(k, pa.int64())], schema=CHUNKS)
    for lo in range(0, len(hashes), 50_000):
        k = len(hashes[lo:lo + 50_000])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(k, number)), none(k, pa.int64()), none(k, pa.bool_()), none(k, pa.binary()), none(k, pa.binary()), pa.array(np.arange(lo, lo + k, dtype=np.int32)), pa.array(hashes[lo:lo + k])], schema=CHUNKS)


def _chunked(shared):
    def run(batches):
        own = shared.value
        number = TaskContext.get().partitionId() << 32
        words, ids, held = _Words(), [], []
        for b in batches:
            words.add(b.column(2))
            ids += b.column(0).to_pylist()
            held += b.column(1).to_pylist()
            if words.total >= CHUNK_TOKENS or words.size >= CHUNK_BYTES:
                yield from _chunk(number, words, ids, held, own)
                number += 1
                words, ids, held = _Words(), [], []
        if ids:
            yield from _chunk(number, words, ids, held, own)

    return run


class Model:
    """Start, transition and class-emission probabilities."""

    def __init__(self, start: np.ndarray, move: np.ndarray, emit: np.ndarray):
        self.start, self.move, self.emit = start, move, emit

    @classmethod
    def initial(cls, states: int, shares: np.ndarray, seed: int = 11) -> Model:
        """Near the class shares, each state with its own seeded disturbance; states tend to stay."""
        r = np.random.default_rng(seed)
        emit = (shares + 1e-6) * r.uniform(0.5, 1.5, (states, len(shares)))
        move = np.full((states, states), 0.5 / max(1, states - 1)) + np.eye(states) * (0.5 - 0.5 / max(1, states - 1))
        return cls(np.full(states, 1 / states), move / move.sum(1, keepdims=True), emit / emit.sum(1, keepdims=True))

    def log10(self, classes: np.ndarray, lengths: np.ndarray) -> np.ndarray:
        """Exact log10 likelihood of each sequence of a flat array, by the scaled forward recursion."""
        order = np.argsort(-lengths, kind="stable")
        out = np.empty(len(lengths))
        out[order] = self._forward(classes, (np.cumsum(lengths) - lengths)[order], lengths[order], np.repeat(self.start[None], len(lengths), 0))[1]
        return out

    def _forward(self, classes: np.ndarray, first: np.ndarray, n: np.ndarray, a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For runs in order of falling length and the states of their first tokens: the states at their ends, up to a factor, and log10 likelihoods."""
        alive, by_class = _alive(n), np.ascontiguousarray(self.emit.T)
        total, ends = np.zeros(len(n)), np.empty((len(n), len(self.start)))
        for t, (k, on) in enumerate(zip(alive, [*alive[1:], 0])):
            a = np.dot(a[:k], self.move) if t else a
            a *= by_class.take(classes[first[:k] + t], axis=0)
            if t % RESCALE == RESCALE - 1 or on < k:
                c = a.sum(1)
                total[:k] += np.log10(c)
                a /= c[:, None]
                ends[on:k] = a[on:]
        return ends, total

    def _backward(self, classes: np.ndarray, first: np.ndarray, n: np.ndarray) -> np.ndarray:
        """For runs in order of falling length, with nothing behind them: the backward vectors before them, up to a factor."""
        alive, by_class, back = _alive(n), np.ascontiguousarray(self.emit.T), np.ascontiguousarray(self.move.T)
        b = np.ones((0, len(self.start)))
        for t in range(len(alive) - 1, -1, -1):
            k = alive[t]
            if len(b) < k:  # runs that end here
                b = np.concatenate([b, np.ones((k - len(b), len(self.start)))])
            b = np.dot(b * by_class.take(classes[first[:k] + t], axis=0), back)
            if t % RESCALE == 0:
                b /= b.sum(1)[:, None]
        return b

    def transfer(self, classes: np.ndarray, first: np.ndarray, length: int) -> np.ndarray:
        """For runs classes[first:first + length]: the matrix that takes the state before a run to the state after it, up to a factor."""
        move = np.ascontiguousarray(self.move.T)
        m = np.repeat(np.eye(len(move))[:, :, None], len(first), 2)
        for t in range(length):
            m = move @ m
            m *= self.emit.take(classes[first + t], axis=1)
            if t % RESCALE == RESCALE - 1 or t == length - 1:
                m /= m.sum((0, 1))
        return m.transpose(2, 0, 1)

    def expected(self, classes: np.ndarray, lengths: np.ndarray, segment: int = SEGMENT) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Expected starts, moves and emissions of whole sequences (forward and backward).

        A long sequence is worked on in segments side by side. The state before each segment and the
        backward vector behind it come from the first segment's forward vector, the last one's backward
        vector and the transfer matrices of those between, so the counts are those of the uncut sequence.
        """
        states = len(self.start)
        begin = np.cumsum(lengths) - lengths
        pieces = -(-lengths // segment)
        seq = np.repeat(np.arange(len(lengths)), pieces)
        nth = np.arange(len(seq)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first = begin[seq] + nth * segment
        n = np.minimum(segment, lengths[seq] - nth * segment)
        head, tail = nth == 0, nth == pieces[seq] - 1
        enter, leave = np.zeros((len(seq), states)), np.ones((len(seq), states))
        if not (head & tail).all():
            m = np.empty((len(seq), states, states))
            mid = np.nonzero(~head & ~tail)[0]
            m[mid] = self.transfer(classes, first[mid], segment)
            at = np.nonzero(head & ~tail)[0]
            after = self._forward(classes, first[at], n[at], np.repeat(self.start[None], len(at), 0))[0]
            while len(at):
                at = at + 1
                enter[at] = after
                more = ~tail[at]
                at = at[more]
                after = np.einsum("ni,nij->nj", after[more], m[at])
                after = after / after.sum(1, keepdims=True)
            at = np.nonzero(tail & ~head)[0]
            at = at[np.argsort(-n[at], kind="stable")]
            behind = self._backward(classes, first[at], n[at])
            while len(at):
                at = at - 1
                leave[at] = behind
                more = ~head[at]
                at = at[more]
                behind = np.einsum("nij,nj->ni", m[at], behind[more])
                behind = behind / behind.sum(1, keepdims=True)
        sums = np.zeros(states), np.zeros((states, states)), np.zeros_like(self.emit)
        order = np.argsort(-n, kind="stable")
        bounds = np.searchsorted(np.cumsum(n[order]), np.arange(0, n.sum() + 1, BLOCK_TOKENS)[1:])
        for part in np.split(order, np.unique(bounds)):
            if len(part):
                for total, x in zip(sums, self._block(classes, first[part], n[part], head[part], enter[part], leave[part])):
                    total += x
        return sums[0], sums[1] * self.move, sums[2]

    def _block(self, classes, first, n, head, enter, leave) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Forward and backward over runs in order of falling length; moves without their probabilities.

        Rows are the runs' first tokens, then their second ones and so on. A class's factor cancels in
        expected counts, so emissions are shares of their class among the states.
        """
        alive, states, back = _alive(n), len(self.start), np.ascontiguousarray(self.move.T)
        at = np.cumsum(alive) - alive
        step = np.repeat(np.arange(len(alive)), alive)
        obs = classes[first[np.arange(len(step)) - at[step]] + step].astype(np.int64)
        among = self.emit.sum(0)
        e = np.ascontiguousarray((self.emit / np.where(among > 0, among, 1)).T).take(obs, axis=0)
        a, b, scales, ones = np.empty_like(e), np.empty_like(e), {}, np.ones((states, states))
        bounds = list(zip(at.tolist(), (at + alive).tolist()))
        np.multiply(np.where(head[:, None], self.start, enter @ self.move), e[:len(n)], out=a[:len(n)])
        before = a[:len(n)]
        for t, (lo, hi) in enumerate(bounds):
            now = a[lo:hi]
            if t:
                np.dot(before[:hi - lo], self.move, out=now)
                now *= e[lo:hi]
            if t % RESCALE == 0:
                scales[t] = np.dot(now, ones)
                now /= scales[t]
            before = now
        last = at[n - 1] + np.arange(len(n))
        b[last] = leave / (a[last] * leave).sum(1, keepdims=True)
        for t in range(len(bounds) - 1, -1, -1):
            lo, hi = bounds[t]
            eb = np.multiply(e[lo:hi], b[lo:hi], out=e[lo:hi])
            if t in scales:
                eb /= scales[t]
            if t:
                lo, hi = bounds[t - 1][0], bounds[t - 1][0] + hi - lo
                np.dot(eb, back, out=b[lo:hi])
        moves = enter[~head].T @ e[:len(n)][~head]
        # steps of as many runs as the step before lie as far behind it, so they go at once
        turn = np.nonzero(np.diff(alive, prepend=alive[0]))[0].tolist()
        for t, u in zip([0, *turn], [*turn, len(alive)]):
            k = alive[t]
            if t:
                moves += a[at[t - 1]:at[t - 1] + k].T @ e[at[t]:at[t] + k]
            moves += a[at[t]:at[u - 1]].T @ e[at[t] + k:at[u - 1] + k]
        a *= b
        return a[:len(n)][head].sum(0), moves, np.stack([np.bincount(obs, g, self.emit.shape[1]) for g in np.ascontiguousarray(a.T)])

    def next(self, starts: np.ndarray, moves: np.ndarray, emits: np.ndarray, smooth: float = 0.1) -> Model:
        def norm(x):
            x = x + smooth
            return x / x.sum(-1, keepdims=True)

        return Model(norm(starts), norm(moves), norm(emits))


def _alive(lengths: np.ndarray) -> np.ndarray:
    """How many of the lengths, which fall, exceed 0, 1, 2, ..."""
    return np.searchsorted(-lengths, -np.arange(1, lengths.max(initial=0) + 1), side="right")


def _expect(shared):
    """One row for each parameter and task; whole texts, some POOL_TOKENS of them at a time."""

    def run(batches):
        m: Model = shared.value
        sums = [np.zeros_like(m.start), np.zeros_like(m.move), np.zeros_like(m.emit)]
        held, n = [], 0

        def work():
            for total, x in zip(sums, m.expected(np.concatenate(held), np.array([len(s) for s in held]))):
                total += x

        for b in batches:
            for packed in b.column(0).to_pylist():
                s = unpack(packed)
                held.append(s)
                n += len(s)
                if n >= POOL_TOKENS:
                    work()
                    held, n = [], 0
        if held:
            work()
        flat = np.concatenate([x.ravel() for x in sums])
        at = np.nonzero(flat)[0]
        yield pa.RecordBatch.from_arrays([pa.array(at.astype(np.int32)), pa.array(flat[at])], names=["at", "x"])

    return run


def train(spark: SparkSession, docs: DataFrame, shares: np.ndarray, states: int = STATES, passes: int = PASSES) -> Model:
    """Baum-Welch over all training rows (classes); the sums that come back have the model's size."""
    m = Model.initial(states, shares)
    for _ in range(passes):
        shared = spark.sparkContext.broadcast(m)
        got = docs.select("classes").mapInArrow(_expect(shared), "at int, x double").groupBy("at").agg(F.sum("x").alias("x")).toArrow()
        flat = np.zeros(m.start.size + m.move.size + m.emit.size)
        flat[got.column("at").to_numpy()] = got.column("x").to_numpy()
        a, b = m.start.size, m.start.size + m.move.size
        m = m.next(flat[:a], flat[a:b].reshape(m.move.shape), flat[b:].reshape(m.emit.shape))
        shared.unpersist()
    return m


SCORED = pa.schema([("doc_id", pa.int64()), ("held_out", pa.bool_()), ("n_tokens", pa.int64()), ("n_known", pa.int64()), ("train_tokens", pa.int64()), ("base_score", pa.float64()), ("score", pa.float64())])
SCORED_DDL = "doc_id long, held_out boolean, n_tokens long, n_known long, train_tokens long, base_score double, score double"


def _score(shared, n_all: int, v_all: int):
    """Rows in order of chunk, a chunk's word counts before its texts -> scored texts."""

    def run(batches):
        m, share = shared.value
        now, count, logs = None, None, None
        pool, pooled = [], 0

        def known(b) -> None:
            nonlocal count, logs
            slots, c = b.column(1).to_numpy(), b.column(2).to_numpy()
            if len(slots):
                if len(count) <= slots.max():
                    count = np.concatenate([count, np.zeros(max(int(slots.max()) + 1 - len(count), len(count)), np.int64)])
                count[slots] = c
                logs = None

        def gather(b) -> None:
            """All but the model's part of the texts' scores, which goes over many texts at once."""
            nonlocal logs, pooled
            if logs is None:
                logs = np.log10(count + 1.0)
            tokens = [unpack(x) for x in b.column(5).to_pylist()]
            flat, n = np.concatenate(tokens), np.array([len(t) for t in tokens])
            classes = np.concatenate([unpack(x) for x in b.column(6).to_pylist()])
            seen, slot = flat < len(count), np.minimum(flat, len(count) - 1)
            at = np.cumsum(n) - n
            each = logs[slot] * seen
            base = np.add.reduceat(each - np.log10(n_all + v_all + 1.0), at)
            hits = np.add.reduceat(((count[slot] > 0) & seen).astype(np.int64), at)
            pool.append((b.column(3), b.column(4), n, hits, base, np.add.reduceat(each - share[classes], at), classes))
            pooled += len(flat)

        def score():
            nonlocal pooled
            ids, held, *numbers, classes = zip(*pool)
            n, hits, base, words = map(np.concatenate, numbers)
            total = m.log10(np.concatenate(classes), n) + words
            pool.clear()
            pooled = 0
            yield from pa.Table.from_arrays([pa.chunked_array(ids), pa.chunked_array(held), pa.array(n, pa.int64()), pa.array(hits), pa.array(np.full(len(n), n_all)), pa.array(base), pa.array(total)], schema=SCORED).combine_chunks().to_batches()

        for b in batches:
            chunks = b.column(0).to_numpy()
            for lo, hi in zip(*(lambda e: (e[:-1], e[1:]))(np.concatenate([[0], np.nonzero(np.diff(chunks))[0] + 1, [len(chunks)]]) if len(chunks) else np.zeros(1, int))):
                if chunks[lo] != now:
                    now, count, logs = chunks[lo], np.zeros(1, np.int64), None
                part = b.slice(lo, hi - lo)
                texts = part.column(1).is_null().to_numpy(zero_copy_only=False)
                if not texts.all():
                    known(part.filter(pa.array(~texts)))
                if texts.any():
                    gather(part.filter(pa.array(texts)))
                if pooled >= POOL_TOKENS:
                    yield from score()
        if pool:
            yield from score()

    return run


def score_documents(docs: DataFrame, states: int = STATES, passes: int = PASSES) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row of docs."""
    spark = docs.sparkSession
    text_batches(spark)
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 2, F.lit(False))
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), held.alias("held_out"), text_bytes().alias("text"))
    counts = stored(rows.where("not held_out").select("text").mapInArrow(_count, "h long, cls int, c long").groupBy("h").agg(F.min("cls").alias("cls"), F.sum("c").alias("c")), "counts")
    whole = counts.agg(F.coalesce(F.sum("c"), F.lit(0)).alias("n"), F.count("*").alias("v")).first()
    n_all, v_all = whole["n"], whole["v"]

    # frequent words are classes of their own: sqrt(n) / 4 of them at most
    often = F.col("c") >= 4 * n_all**0.5
    frequent = sorted((r["h"], r["c"]) for r in counts.where(often & (F.col("cls") > 0)).select("h", "c").collect())
    own = np.array([h for h, _ in frequent], np.int64)
    size = CLASSES + len(own)
    n_of, share = np.zeros(size, np.int64), np.zeros(size)
    for r in counts.where(~often | (F.col("cls") == 0)).groupBy("cls").agg(F.sum("c").alias("n"), F.count("*").alias("v")).collect():  # at most CLASSES rows
        n_of[r["cls"]], share[r["cls"]] = r["n"], r["n"] + r["v"]
    n_of[CLASSES:] = [c for _, c in frequent]
    # a class of one word emits it for certain, the others keep one share for what is unseen
    share = np.log10(np.where((np.arange(size) >= CLASSES) | (np.arange(size) == 0), n_of, share) + 1.0)

    shared_own = spark.sparkContext.broadcast(own)
    chunks = stored(rows.mapInArrow(_chunked(shared_own), CHUNKS_DDL), "chunks")
    texts, words = chunks.where("slot is null"), chunks.where("slot is not null")
    model = train(spark, texts.where("not held_out"), n_of / max(1, n_all), states, passes if n_all else 0)
    shared = spark.sparkContext.broadcast((model, share))

    # each chunk meets the counts of its own words again; chunks are dealt in turn, not by a hash
    own_counts = words.select("h", "chunk", "slot").join(counts.select("h", "c"), "h").select("chunk", "slot", "c", *[F.lit(None).cast(t).alias(n) for n, t in (("doc_id", "long"), ("held_out", "boolean"), ("tokens", "binary"), ("classes", "binary"))])
    met = own_counts.unionByName(texts.select("chunk", "slot", F.lit(None).cast("long").alias("c"), "doc_id", "held_out", "tokens", "classes"))
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    deal = F.pmod(F.shiftright("chunk", 32) + F.col("chunk").bitwiseAND(0xFFFFFFFF), F.lit(parts)).cast("int")
    dealt = met.repartitionById(parts, deal).sortWithinPartitions("chunk", F.col("slot").asc_nulls_last())
    out = stored(dealt.mapInArrow(_score(shared, n_all, v_all), SCORED_DDL), "scored")
    drop_stored(chunks, counts)
    return out


def op9_hmm_lm(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score_documents(spark.read.parquet(f"{sf_dir}/documents.parquet"))
