"""IVF index with sign codes and 8-bit residuals: training, encoding and search.

Vectors live in DataFrames. What is broadcast has a fixed size: rotation, centroids, ranges, and the
queries of one block of at most QUERY_BYTES. Encoding and scoring run in Arrow batches with numpy; a
search scans only the partition folders it probes and each task returns its own best rows, so the one
shuffle carries queries * k rows a task. Training takes a bounded sample (`sample`, and at most
POINTS_EACH vectors a partition); every vector is then assigned and encoded.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from vecloom.operators.config import EmptyIndex, IndexConfig, InvalidDimension, InvalidVectorIndex, check_dim
from vecloom.sources.scratch import scratch_folder
from vecloom.sources.vector_files import with_ids

#: Bytes of queries that one scan takes; more are searched in blocks, a scan each.
QUERY_BYTES = 64 << 20
#: Queries that one kernel call scores against a batch of rows.
QUERY_ROWS = 256
#: Training vectors taken for each partition.
POINTS_EACH = 256
CODES_DDL = "vec_id long, code array<long>, residual_norm double, dot_o_bar_o double, residual array<double>, partition_id int"
STORED = ("vec_id", "code", "residual_norm", "dot_o_bar_o", "sq8", "partition_id")
STORED_DDL = "vec_id long, code array<long>, residual_norm double, dot_o_bar_o double, sq8 binary, partition_id int"


def rotation_matrix(dim: int, seed: int = 42) -> np.ndarray:
    """A seeded random orthogonal matrix."""
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def matrix(column) -> np.ndarray:
    """Arrow lists of one length as a 2-d array of doubles."""
    if len(column) == 0:
        return np.empty((0, 0))
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def pack(rotated: np.ndarray) -> np.ndarray:
    bits = np.packbits(rotated >= 0, axis=1, bitorder="little")
    return bits.view("<i8")


def unpack(codes: np.ndarray) -> np.ndarray:
    """Code words -> signs, +1 or -1."""
    return np.unpackbits(np.ascontiguousarray(codes).view(np.uint8), axis=1, bitorder="little").astype(np.float64) * 2 - 1


def squared(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Squared distances of all rows of x from all rows of y."""
    return (x**2).sum(1)[:, None] - 2 * x @ y.T + (y**2).sum(1)


def apart(x: np.ndarray, centroids: np.ndarray, decimals: int = 9) -> np.ndarray:
    """Squared distances, rounded half up, as SQL does."""
    return np.floor(squared(x, centroids) * 10.0**decimals + 0.5) / 10.0**decimals


def nearest(x: np.ndarray, centroids: np.ndarray, decimals: int = 9) -> np.ndarray:
    """Least distance; the lowest id on ties."""
    return apart(x, centroids, decimals).argmin(1)


def lists_of(m: np.ndarray, kind: pa.DataType) -> pa.ListArray:
    """A 2-d array as Arrow lists of one length."""
    return pa.ListArray.from_arrays(pa.array(np.arange(0, m.size + 1, max(1, m.shape[1])), pa.int32()), pa.array(np.ascontiguousarray(m).ravel(), kind))


@dataclass
class Index:
    dim: int
    config: IndexConfig
    rotation: np.ndarray
    centroids: np.ndarray
    supers: np.ndarray  # super-partition of each partition
    super_centroids: np.ndarray
    low: np.ndarray | None = None  # SQ8 ranges by partition and dimension
    scale: np.ndarray | None = None
    codes: DataFrame | None = None
    next_id: int = 0


def validate(vectors: DataFrame, dim: int) -> int:
    """All vectors are checked before any is written; their number."""
    bad = F.col("embedding").isNull() | (F.size("embedding") != dim)
    row = vectors.agg(F.count("*").alias("n"), F.count_if(bad).alias("bad")).first()
    if row["bad"]:
        raise InvalidDimension(f"not every vector has dimension {dim}")
    return row["n"]


def lloyd(x: np.ndarray, means: np.ndarray, rounds: int = 10) -> np.ndarray:
    """Rounds of nearest centroid and mean; an empty cluster keeps its centroid."""
    own = None
    for _ in range(rounds):
        new = nearest(x, means)
        if own is not None and np.array_equal(new, own):
            break
        own = new
        n = np.bincount(own, minlength=len(means))
        sums = np.stack([np.bincount(own, column, len(means)) for column in x.T], axis=1)
        means = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], means)
    return means


def spread_seeds(x: np.ndarray, k: int, r: np.random.Generator) -> np.ndarray:
    """k-means++ seeds: each next one is drawn by its squared distance from the seeds before."""
    at = [int(r.integers(len(x)))]
    d = ((x - x[at[0]]) ** 2).sum(1)
    while len(at) < k:
        total = d.sum()
        at.append(int(r.choice(len(x), p=d / total)) if total > 0 else int(r.integers(len(x))))
        d = np.minimum(d, ((x - x[at[-1]]) ** 2).sum(1))
    return x[at]


def super_partitions(centroids: np.ndarray, seed: int = 42) -> tuple[np.ndarray, np.ndarray]:
    """About the square root of as many groups of partitions, by Lloyd rounds over centroids."""
    n = len(centroids)
    s = int(np.sqrt(n))
    if s <= 1 or s >= n:
        return np.zeros(n, int), centroids.mean(0, keepdims=True)
    means = lloyd(centroids, centroids[np.random.default_rng(seed).choice(n, s, replace=False)])
    return nearest(centroids, means), means


def train(vectors: DataFrame, dim: int, config: IndexConfig, sample: int = 100_000, seed: int = 42) -> Index:
    """K-means over at most `sample` vectors (and POINTS_EACH a partition), picked by a hash of their id.

    The bound is the number of rows that the driver holds; each of them is dim doubles.
    """
    check_dim(dim)
    n = validate(vectors, dim)
    if not n:
        raise EmptyIndex("no vectors to train on")
    wanted = min(n, sample or n, max(1000, POINTS_EACH * config.num_partitions))
    kept = F.lit(True) if wanted >= n else F.pmod(F.xxhash64("vec_id"), F.lit(1 << 40)) < int((wanted * 1.02 + 50) / n * (1 << 40))
    got = vectors.where(kept).select(F.col("vec_id").cast("long"), "embedding").toArrow().combine_chunks()
    ids, x = got.column(0).to_numpy(), matrix(got.column(1).combine_chunks())
    x = x[np.argsort(ids, kind="stable")][:wanted]  # not in the order of tasks
    centroids = x.mean(0, keepdims=True) if config.num_partitions == 1 else lloyd(x, spread_seeds(x, config.num_partitions, np.random.default_rng(seed)))
    own, means = super_partitions(centroids)
    return Index(dim, config, rotation_matrix(dim, config.rotation_seed), centroids, own, means)


def assign(vectors: DataFrame, index: Index, hierarchical: bool = False) -> DataFrame:
    """vec_id, embedding, partition_id; hierarchical looks at the partitions of the nearest groups only."""
    shared = vectors.sparkSession.sparkContext.broadcast((index.centroids, index.supers, index.super_centroids))
    s, decimals = len(index.super_centroids), index.config.decimals
    look = max(2, min(s, 2 * int(np.sqrt(s))))

    def run(batches):
        centroids, own, means = shared.value
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                part = np.empty(0, np.int32)
            elif hierarchical and s > 1:
                near = np.argsort(apart(x, means, decimals), axis=1, kind="stable")[:, :look]
                allowed = (own[None, None, :] == near[:, :, None]).any(1)
                part = np.where(allowed, apart(x, centroids, decimals), np.inf).argmin(1)
            else:
                part = nearest(x, centroids, decimals)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(part.astype(np.int32))], names=["vec_id", "embedding", "partition_id"])

    return vectors.select(F.col("vec_id").cast("long"), F.col("embedding").cast("array<float>")).mapInArrow(run, "vec_id long, embedding array<float>, partition_id int")


def partition_means(assigned: DataFrame) -> DataFrame:
    """(partition_id, centroid) of assigned vectors: one Lloyd step. Sums leave a task once a partition."""

    def run(batches):
        sums: dict[int, np.ndarray] = {}
        for b in batches:
            part, x = b.column(0).to_numpy(), matrix(b.column(1))
            for p in np.unique(part).tolist():
                own = x[part == p]
                sums[p] = sums.get(p, 0) + np.append(own.sum(0), len(own))
        if sums:
            m = np.stack(list(sums.values()))
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), lists_of(m, pa.float64())], names=["partition_id", "sums"])

    cells = assigned.select(F.col("partition_id").cast("int"), "embedding").mapInArrow(run, "partition_id int, sums array<double>").select("partition_id", F.posexplode("sums").alias("d", "s"))
    whole = cells.groupBy("partition_id", "d").agg(F.sum("s").alias("s")).groupBy("partition_id").agg(F.array_sort(F.collect_list(F.struct("d", "s"))).alias("c"))
    return whole.select("partition_id", F.transform(F.slice("c", 1, F.size("c") - 1), lambda v: v["s"] / F.element_at("c", -1)["s"]).alias("centroid"))


def encode(vectors: DataFrame, index: Index) -> DataFrame:
    """Sign codes, residual norms and residuals of assigned vectors (vec_id, embedding, partition_id)."""
    shared = vectors.sparkSession.sparkContext.broadcast((index.centroids, index.rotation))

    def run(batches):
        centroids, rotation = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(2).to_numpy()
            r = matrix(b.column(1)) - centroids[part]
            norm = np.sqrt((r**2).sum(1))
            o = np.where(norm[:, None] > 1e-8, (r @ rotation.T) / np.maximum(norm, 1e-8)[:, None], 0.0)
            yield pa.RecordBatch.from_arrays([b.column(0), lists_of(pack(o), pa.int64()), pa.array(norm), pa.array(np.abs(o).sum(1)), lists_of(r, pa.float64()), b.column(2)], names=["vec_id", "code", "residual_norm", "dot_o_bar_o", "residual", "partition_id"])

    return vectors.select(F.col("vec_id").cast("long"), "embedding", F.col("partition_id").cast("int")).mapInArrow(run, CODES_DDL)


def sq8_ranges(codes: DataFrame) -> DataFrame:
    """(partition_id, d, lo, hi) of residuals: each task sends one row a partition, then partitions * dim rows remain."""

    def run(batches):
        low: dict[int, np.ndarray] = {}
        high: dict[int, np.ndarray] = {}
        for b in batches:
            part, r = b.column(0).to_numpy(), matrix(b.column(1))
            for p in np.unique(part).tolist():
                own = r[part == p]
                low[p] = np.minimum(low[p], own.min(0)) if p in low else own.min(0)
                high[p] = np.maximum(high[p], own.max(0)) if p in high else own.max(0)
        if low:
            yield pa.RecordBatch.from_arrays([pa.array(list(low), pa.int32()), lists_of(np.stack(list(low.values())), pa.float64()), lists_of(np.stack([high[p] for p in low]), pa.float64())], names=["partition_id", "low", "high"])

    found = codes.select("partition_id", "residual").mapInArrow(run, "partition_id int, low array<double>, high array<double>")
    return found.select("partition_id", F.posexplode(F.arrays_zip("low", "high")).alias("d", "z")).groupBy("partition_id", "d").agg(F.min("z.low").alias("lo"), F.max("z.high").alias("hi"))


def fit_sq8(codes: DataFrame, index: Index) -> None:
    """Ranges of residuals by partition and dimension, on the driver: partitions * dim rows."""
    got = sq8_ranges(codes).toArrow()
    index.low, index.scale = np.zeros((len(index.centroids), index.dim)), np.ones((len(index.centroids), index.dim))
    at, lo = (got.column("partition_id").to_numpy(), got.column("d").to_numpy()), got.column("lo").to_numpy()
    span = got.column("hi").to_numpy() - lo
    index.low[at] = lo
    index.scale[at] = np.where(span > 1e-8, 255 / np.maximum(span, 1e-300), 1.0)


def encode_sq8(codes: DataFrame, index: Index) -> DataFrame:
    """Replace residuals by 8-bit codes; values outside the fitted ranges are clamped."""
    shared = codes.sparkSession.sparkContext.broadcast((index.low, index.scale))

    def run(batches):
        low, scale = shared.value
        for b in batches:
            if not b.num_rows:
                continue
            part = b.column(5).to_numpy()
            # rounding first, so that a value that is whole but for the last bits isn't cut to the one below
            c = np.floor(np.round(np.clip((matrix(b.column(4)) - low[part]) * scale[part], 0, 255), 6)).astype(np.uint8)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), b.column(2), b.column(3), pa.array([x.tobytes() for x in c], pa.binary()), b.column(5)], names=[*STORED])

    return codes.mapInArrow(run, STORED_DDL)


def sq8_values(codes: DataFrame) -> DataFrame:
    """(vec_id, partition_id, codes): the stored 8-bit codes as numbers."""

    def run(batches):
        for b in batches:
            if b.num_rows:
                c = np.frombuffer(b"".join(b.column(2).to_pylist()), np.uint8).reshape(b.num_rows, -1)
                yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), lists_of(c.astype(np.int32), pa.int32())], names=["vec_id", "partition_id", "codes"])

    return codes.select("vec_id", "partition_id", "sq8").mapInArrow(run, "vec_id long, partition_id int, codes array<int>")


def after_ids(vectors: DataFrame) -> int:
    """The id after the greatest one."""
    most = vectors.agg(F.max("vec_id").alias("m")).first()["m"]
    return 0 if most is None else most + 1


def encoded(assigned: DataFrame, index: Index) -> Index:
    """Fit the ranges over all assigned vectors and encode them."""
    codes = encode(assigned, index)
    fit_sq8(codes, index)
    index.codes = encode_sq8(codes, index)
    return index


def build(vectors: DataFrame, dim: int, config: IndexConfig, sample: int = 100_000, hierarchical: bool = False) -> Index:
    """Train, assign, encode; index.codes is the encoded table."""
    index = train(vectors, dim, config, sample)
    index.next_id = after_ids(vectors)
    return encoded(assign(vectors, index, hierarchical), index)


def insert(index: Index, vectors: DataFrame, order: str = "embedding") -> Index:
    """Encode more vectors with the trained model and append them; nothing is retrained silently.

    Vectors without a vec_id get dense ids from index.next_id, in the order of a column.
    """
    validate(vectors, index.dim)
    if "vec_id" not in vectors.columns:
        vectors = with_ids(vectors, order, index.next_id)
    index.next_id = max(index.next_id, after_ids(vectors))
    index.codes = index.codes.select(*STORED).unionByName(encode_sq8(encode(assign(vectors, index), index), index))
    return index


def probed(index: Index, queries: np.ndarray, nprobe: int, hierarchical: bool = False) -> np.ndarray:
    """The nprobe nearest partitions of each query, nearest first; at most all.

    Hierarchical: only the partitions of the nearest groups are compared, of as many groups as hold
    nprobe partitions on average and one more. Where they hold fewer, the row ends in -1.
    """
    p, s = len(index.centroids), len(index.super_centroids)
    n = min(nprobe, p)
    d = apart(queries, index.centroids, index.config.decimals)
    if not hierarchical or s <= 1:
        return np.argsort(d, axis=1, kind="stable")[:, :n]
    each = max(1, p // s)
    groups = np.argsort(apart(queries, index.super_centroids, index.config.decimals), axis=1, kind="stable")[:, :max(1, min(s, -(-n // each) + 1))]
    d = np.where((index.supers[None, None, :] == groups[:, :, None]).any(1), d, np.inf)
    order = np.argsort(d, axis=1, kind="stable")[:, :n]
    return np.where(np.isfinite(np.take_along_axis(d, order, 1)), order, -1)


def probe(index: Index, queries: DataFrame, nprobe: int, hierarchical: bool = False) -> DataFrame:
    """(qid, rank, partition_id, dist): the partitions that a search of these queries reads."""
    shared = queries.sparkSession.sparkContext.broadcast(index.centroids)
    light = Index(index.dim, index.config, index.rotation, index.centroids, index.supers, index.super_centroids)

    def run(batches):
        for b in batches:
            if not b.num_rows:
                continue
            q = matrix(b.column(1))
            parts = probed(light, q, nprobe, hierarchical)
            d = np.take_along_axis(squared(q, shared.value), np.maximum(parts, 0), 1)
            there = (parts >= 0).ravel()
            rank = np.tile(np.arange(1, parts.shape[1] + 1, dtype=np.int32), len(q))
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(b.column(0).to_numpy(), parts.shape[1])[there]), pa.array(rank[there]), pa.array(parts.ravel()[there].astype(np.int32)), pa.array(d.ravel()[there])], names=["qid", "rank", "partition_id", "dist"])

    return queries.select(F.col("qid").cast("long"), "embedding").mapInArrow(run, "qid long, rank int, partition_id int, dist double")


def coarse(signs: np.ndarray, q: np.ndarray, config: IndexConfig) -> np.ndarray:
    """Inner products (query, row) of sign codes with rotated residual queries, by the configured estimator."""
    dim = q.shape[1]
    if config.fastscan:
        same = np.where(q >= 0, 1.0, -1.0) @ signs.T  # dim - 2 * Hamming distance
        return same * ((np.sqrt((q**2).sum(1)) if config.compat else np.abs(q).sum(1)) / dim)[:, None]
    if 1 <= config.query_bits <= 8:
        levels = 2**config.query_bits
        low = q.min(1, keepdims=True)
        step = np.maximum((q.max(1, keepdims=True) - low) / (levels - 1), 1e-300)
        level = np.floor(np.round((q - low) / step, 6))
        return ((level - levels // 2) * step if config.compat else low + level * step) @ signs.T
    return q @ signs.T


def describe(index: Index) -> DataFrame:
    """One row: dimension, partitions, vectors, the least and the most vectors of a partition, and the least of those that hold any."""
    sizes = index.codes.groupBy("partition_id").count()
    p = len(index.centroids)
    least = F.when(F.count("*") < p, F.lit(0)).otherwise(F.min("count")).cast("long")
    return sizes.agg(F.lit(index.dim).alias("dimension"), F.lit(p).alias("partitions"), F.coalesce(F.sum("count"), F.lit(0)).cast("long").alias("vectors"), least.alias("least"), F.coalesce(F.max("count"), F.lit(0)).cast("long").alias("most"), F.min("count").alias("least_held"))


def sq8_distance(index: Index, query: list[float], vec_id: int) -> float:
    """Squared L2 distance of one stored vector from a query, by its 8-bit residual."""
    row = index.codes.where(F.col("vec_id") == vec_id).select("partition_id", "sq8").first()
    if row is None:
        raise InvalidVectorIndex(f"no vector {vec_id}")
    p = row["partition_id"]
    found = index.centroids[p] + np.frombuffer(bytes(row["sq8"]), np.uint8) / index.scale[p] + index.low[p]
    return float(((np.asarray(query, float) - found) ** 2).sum())


# best rows of many queries


def lowest(score: np.ndarray, ids: np.ndarray, keep: int) -> np.ndarray:
    """Columns of the `keep` least scores of each row, in any order; ties at the cut go to the lower id."""
    if score.shape[1] <= keep:
        return np.broadcast_to(np.arange(score.shape[1]), score.shape)
    at = np.argpartition(score, keep - 1, axis=1)[:, :keep]
    cut = np.take_along_axis(score, at, 1).max(1)
    for i in np.nonzero(np.isfinite(cut) & ((score <= cut[:, None]).sum(1) > keep))[0]:
        at[i] = np.lexsort((ids[i], score[i]))[:keep]
    return at


class Best:
    """The best rows of a task for each query: arrays of queries * keep, by score."""

    def __init__(self, queries: int, keep: int):
        self.keep, self.blocks = keep, {lo: None for lo in range(0, queries, QUERY_ROWS)}

    def add(self, lo: int, score: np.ndarray, *columns: np.ndarray) -> None:
        """Scores (query, row) of a block of queries; infinite where a row doesn't count. The first column has the ids."""
        columns = tuple(np.broadcast_to(c, score.shape) for c in columns)
        at = lowest(score, columns[0], self.keep)
        new = [np.take_along_axis(c, at, 1) for c in (score, *columns)]
        if (old := self.blocks[lo]) is not None:
            new = [np.concatenate(c, axis=1) for c in zip(old, new)]
            at = lowest(new[0], new[1], self.keep)
            new = [np.take_along_axis(c, at, 1) for c in new]
        self.blocks[lo] = new

    def lists(self) -> tuple[np.ndarray, np.ndarray, list[np.ndarray]]:
        """Query numbers, list bounds and flat columns."""
        who, flat = [], []
        for lo, held in self.blocks.items():
            if held is None:
                continue
            there = np.isfinite(held[0])
            who.append(np.repeat(np.arange(lo, lo + len(there)), there.sum(1)))
            flat.append([c[there] for c in held])
        if not who:
            return np.empty(0, int), np.zeros(1, np.int32), []
        who = np.concatenate(who)
        queries, n = np.unique(who, return_counts=True)
        return queries, np.concatenate([[0], np.cumsum(n)]).astype(np.int32), [np.concatenate(c) for c in zip(*flat)]


LISTS_DDL = "qid long, coarse array<double>, vec_id array<long>, partition_id array<int>, score array<double>"
FOUND_DDL = "qid long, rank int, vec_id long, partition_id int, score double"


def send(best: Best, ids: np.ndarray):
    """One row a query: its best rows of this task, as lists."""
    who, bounds, flat = best.lists()
    if len(who):
        yield pa.RecordBatch.from_arrays([pa.array(ids[who], pa.int64()), *(pa.ListArray.from_arrays(pa.array(bounds), pa.array(c, t)) for c, t in zip(flat, (pa.float64(), pa.int64(), pa.int32(), pa.float64())))], names=["qid", "coarse", "vec_id", "partition_id", "score"])


def merge_lists(found: DataFrame, keep: dict[int, int], asked_k: dict[int, int]) -> DataFrame:
    """Lists of all tasks -> each query's best k by score among its best `keep` by the coarse one."""

    def final(batches):
        now, held = None, []

        def close():
            s, vec, part, exact = best_of(keep[now], *map(np.concatenate, zip(*held)))
            order = np.lexsort((vec, exact))[:asked_k[now]]
            n = len(order)
            return pa.RecordBatch.from_arrays([pa.array(np.full(n, now)), pa.array(np.arange(1, n + 1, dtype=np.int32)), pa.array(vec[order]), pa.array(part[order]), pa.array(exact[order])], names=["qid", "rank", "vec_id", "partition_id", "score"])

        done = []
        for b in batches:
            lists = [(c.offsets.to_numpy(), c.values.to_numpy()) for c in (b.column(i) for i in range(1, 5))]
            for i, qid in enumerate(b.column(0).to_pylist()):
                if qid != now and held:
                    done.append(close())
                    held = []
                now = qid
                held.append([v[o[i]:o[i + 1]] for o, v in lists])
        if held:
            done.append(close())
        if done:
            yield from pa.Table.from_batches(done).combine_chunks().to_batches()

    return found.repartition("qid").sortWithinPartitions("qid").mapInArrow(final, FOUND_DDL)


def best_of(keep: int, score: np.ndarray, vec: np.ndarray, *rest: np.ndarray) -> tuple[np.ndarray, ...]:
    """The `keep` least scores with their columns; ties at the cut go to the lower vec_id."""
    if len(score) > keep:
        at = np.lexsort((vec, score))[:keep]
        return score[at], vec[at], *(x[at] for x in rest)
    return score, vec, *rest


def in_blocks(queries: DataFrame, dim: int, k: int, run) -> DataFrame:
    """run(ids, vectors, k of each id) for blocks of queries of at most QUERY_BYTES.

    Queries that fit one block are one lazy scan. More are dealt by a hash of qid, each block's
    result is written to the shared folder, and the driver holds one block at a time.
    """
    own = F.coalesce(F.col("k").cast("int"), F.lit(k)) if "k" in queries.columns else F.lit(k)
    rows = queries.select(F.col("qid").cast("long").alias("qid"), "embedding", own.alias("k"))
    blocks = max(1, -(-validate(rows, dim) * dim * 8 // QUERY_BYTES))

    def block(i: int) -> DataFrame:
        part = rows if blocks == 1 else rows.where(F.pmod(F.xxhash64("qid"), F.lit(blocks)) == i)
        got = part.toArrow().combine_chunks()
        x = matrix(got.column(1).combine_chunks()) if got.num_rows else np.empty((0, dim))
        ids = got.column(0).to_numpy()
        return run(ids, x, dict(zip(ids.tolist(), np.maximum(got.column(2).to_numpy(), 0).tolist())))

    if blocks == 1:
        return block(0)
    spark, folder = queries.sparkSession, scratch_folder(queries.sparkSession, "blocks")
    for i in range(blocks):
        block(i).write.parquet(f"{folder}/block={i}")
    return spark.read.parquet(folder).drop("block")


def search(index: Index, queries: DataFrame, k: int, nprobe: int, allowed: DataFrame | None = None, hierarchical: bool = False) -> DataFrame:
    """(qid, rank, vec_id, partition_id, score) of each query (qid, embedding); one scan for a block of them.

    A column k of queries, where it is not null, takes the place of k. Only vectors whose vec_id is in
    `allowed` are scored, if that is given: filters come before the search.
    """
    if nprobe < 1:
        raise ValueError("nprobe must be positive")
    spark, config = queries.sparkSession, index.config

    def run(ids, q, asked_k):
        parts = probed(index, q, nprobe, hierarchical)
        wanted = np.zeros((len(q), len(index.centroids) + 1), bool)
        np.put_along_axis(wanted, parts, True, axis=1)  # -1 is the last column
        keep = {qid: n * config.refine_k if config.refine_sq8 else n for qid, n in asked_k.items()}
        most = max(keep.values(), default=0)
        shared = spark.sparkContext.broadcast((ids, q, wanted, index.centroids, index.rotation, index.low, index.scale))

        def local(batches):
            """Each query's best rows of one task, by the coarse score, as one list."""
            ids, q, wanted, centroids, rotation, low, scale = shared.value
            best = Best(len(q), most)
            for b in batches if most else ():
                if not b.num_rows:
                    continue
                part = b.column(5).to_numpy()
                order = np.argsort(part, kind="stable")
                b, part = b.take(pa.array(order)), part[order]
                vec, norm, doo = (b.column(i).to_numpy() for i in (0, 2, 3))
                signs = unpack(b.column(1).flatten().to_numpy().reshape(len(vec), -1))
                if config.refine_sq8:
                    near = centroids[part] + low[part] + np.frombuffer(b"".join(b.column(4).to_pylist()), np.uint8).reshape(len(vec), -1) / scale[part]
                    near_sq = (near**2).sum(1)
                bounds = np.concatenate([[0], np.nonzero(np.diff(part))[0] + 1, [len(part)]])
                for lo in best.blocks:
                    own = q[lo:lo + QUERY_ROWS]
                    score = np.full((len(own), len(vec)), np.inf)
                    for start, stop in zip(bounds, bounds[1:]):
                        asked = np.nonzero(wanted[lo:lo + QUERY_ROWS, part[start]])[0]
                        if len(asked):
                            r = own[asked] - centroids[part[start]]
                            n = norm[start:stop]
                            score[asked, start:stop] = n**2 + (r**2).sum(1)[:, None] - 2 * n * coarse(signs[start:stop], r @ rotation.T, config) / np.maximum(doo[start:stop], 1e-8)
                    fine = (own**2).sum(1)[:, None] - 2 * own @ near.T + near_sq if config.refine_sq8 else score
                    best.add(lo, score, vec, part, fine)
            yield from send(best, ids)

        codes = index.codes.select(*STORED).where(F.col("partition_id").isin(np.unique(parts[parts >= 0]).tolist()))
        if allowed is not None:
            codes = codes.join(allowed.select("vec_id"), "vec_id", "left_semi").select(*STORED)
        return merge_lists(codes.mapInArrow(local, LISTS_DDL), keep, asked_k)

    return in_blocks(queries, index.dim, k, run)


def flat_search(index: Index, assigned: DataFrame, queries: DataFrame, k: int, nprobe: int, hierarchical: bool = False) -> DataFrame:
    """As search, but scored exactly: over assigned vectors (vec_id, embedding, partition_id), no codes."""
    spark = queries.sparkSession

    def run(ids, q, asked_k):
        parts = probed(index, q, nprobe, hierarchical)
        wanted = np.zeros((len(q), len(index.centroids) + 1), bool)
        np.put_along_axis(wanted, parts, True, axis=1)
        rows = assigned.where(F.col("partition_id").isin(np.unique(parts[parts >= 0]).tolist()))
        return exact_lists(spark, rows, ids, q, asked_k, wanted)

    return in_blocks(queries, index.dim, k, run)


def exact_lists(spark, rows: DataFrame, ids: np.ndarray, q: np.ndarray, asked_k: dict[int, int], wanted: np.ndarray | None) -> DataFrame:
    most = max(asked_k.values(), default=0)
    shared = spark.sparkContext.broadcast((ids, q, wanted))

    def local(batches):
        ids, q, wanted = shared.value
        best = Best(len(q), most)
        for b in batches if most else ():
            if not b.num_rows:
                continue
            vec, x, part = b.column(0).to_numpy(), matrix(b.column(1)), b.column(2).to_numpy()
            x_sq = (x**2).sum(1)
            for lo in best.blocks:
                own = q[lo:lo + QUERY_ROWS]
                d = (own**2).sum(1)[:, None] - 2 * own @ x.T + x_sq
                best.add(lo, d if wanted is None else np.where(wanted[lo:lo + QUERY_ROWS][:, part], d, np.inf), vec, part, d)
        yield from send(best, ids)

    part = F.col("partition_id").cast("int") if wanted is not None else F.lit(0)
    found = rows.select(F.col("vec_id").cast("long"), "embedding", part.alias("partition_id")).mapInArrow(local, LISTS_DDL)
    return merge_lists(found, asked_k, asked_k)


def exact_batch(base: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """(qid, rank, vec_id, dist): exact nearest neighbours by blocked matrix products; ties go to the lower vec_id.

    Queries are (qid, embedding) and may have a column k. Each task sends k rows a query.
    """
    first = queries.select(F.size("embedding").alias("n")).first()
    dim = first["n"] if first and first["n"] is not None else 0
    found = in_blocks(queries, dim, k, lambda ids, q, own: exact_lists(base.sparkSession, base, ids, q, own, None))
    return found.select("qid", "rank", "vec_id", F.col("score").alias("dist"))


def dot_products(base: DataFrame, queries: DataFrame) -> DataFrame:
    """(vec_id, qid, dot) of every row of base with every query, in blocks of queries."""
    first = queries.select(F.size("embedding").alias("n")).first()

    def run(ids, q, _):
        shared = base.sparkSession.sparkContext.broadcast((ids, q))

        def local(batches):
            ids, q = shared.value
            for b in batches:
                for lo in range(0, b.num_rows, 1024):
                    part = b.slice(lo, 1024)
                    vec, dots = part.column(0).to_numpy(), matrix(part.column(1)) @ q.T
                    yield pa.RecordBatch.from_arrays([pa.array(np.repeat(vec, len(ids))), pa.array(np.tile(ids, len(vec))), pa.array(dots.ravel())], names=["vec_id", "qid", "dot"])

        return base.select(F.col("vec_id").cast("long"), "embedding").mapInArrow(local, "vec_id long, qid long, dot double")

    return in_blocks(queries, first["n"] if first else 0, 1, run)
