import numpy as np
import pytest
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import index as ann
from vecloom.operators import metrics
from vecloom.operators.config import CorruptIndex, EmptyIndex, IndexConfig, InvalidDimension, VersionConflict, VersionNotFound, check_dim
from vecloom.operators.retrieval import Predicate, QueryPlan, exact_knn
from vecloom.sources.index_store import Dataset, load_index, save_index
from vecloom.sources.vector_files import read_fvecs, read_ivecs, read_json_vectors, with_ids

DDL = "vec_id long, embedding array<float>"


@pytest.fixture(scope="module")
def base(spark):
    r = np.random.default_rng(5)
    return spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(r.random((600, 64)))], DDL).cache()


@pytest.fixture(scope="module")
def index(base):
    i = ann.build(base, 64, IndexConfig(num_partitions=8, fastscan=False))
    i.codes = i.codes.cache()
    return i


def asked(base, n=30):
    return base.where(F.col("vec_id") < n).select(F.col("vec_id").alias("qid"), "embedding")


@pytest.mark.parametrize("dim", [0, 7, 8, 15, 16, 32, 63, 65])
def test_bad_dimensions(dim):
    with pytest.raises(InvalidDimension):
        check_dim(dim)


@pytest.mark.parametrize("dim", [64, 128, 768, 1536])
def test_good_dimensions(dim):
    assert check_dim(dim) == dim


def test_no_partitions():
    with pytest.raises(InvalidDimension):
        IndexConfig(num_partitions=0)


def test_kernels(spark):
    row = spark.createDataFrame([([1.0, 2.0, 3.0], [4.0, 5.0, 6.0])], "a array<double>, b array<double>").select(V.dot(F.col("a"), F.col("b")), V.l2sq(F.col("a"), F.col("b")), V.l2sq(F.col("a"), F.col("a"))).first()
    assert tuple(row) == (32.0, 27.0, 0.0)
    codes = spark.createDataFrame([([0], [-1]), ([255], [255]), ([0], [0])], "a array<long>, b array<long>").select(V.popcount(F.col("a")), V.popcount(F.col("b")), V.hamming(F.col("a"), F.col("b"))).collect()
    assert [tuple(r) for r in codes] == [(0, 64, 64), (8, 8, 0), (0, 0, 0)]


def test_packed_signs_agree(spark, base):
    want = {r["vec_id"]: ann.pack(np.array([r["embedding"]]) - 0.5)[0].tolist() for r in base.collect()}
    got = base.select("vec_id", V.pack_signs(F.transform("embedding", lambda x: x - F.lit(0.5)), 64).alias("code"))
    assert all(want[r["vec_id"]] == r["code"] for r in got.collect())


def test_rotation_is_orthogonal():
    r = ann.rotation_matrix(64)
    assert np.allclose(r @ r.T, np.eye(64)) and np.array_equal(r, ann.rotation_matrix(64))


@pytest.mark.parametrize("n,groups", [(1, 1), (4, 2), (16, 4), (64, 8)])
def test_super_partitions_cover_once(n, groups):
    own, means = ann.super_partitions(np.random.default_rng(1).random((n, 64)))
    assert len(own) == n and len(means) == groups and own.max() < groups


def test_two_clusters(spark):
    rows = [(i, [0.1 + 0.8 * (i >= 100)] * 64) for i in range(200)]
    i = ann.train(spark.createDataFrame(rows, DDL), 64, IndexConfig(num_partitions=2))
    assert np.allclose(sorted(i.centroids[:, 0]), [0.1, 0.9], atol=1e-4)


def test_search_orders_and_recall(base, index):
    got = ann.search(index, asked(base), 10, 8)
    exact = ann.exact_batch(base, asked(base), 10)
    assert metrics.recall(got, exact, 10).agg(F.avg("recall")).first()[0] >= 0.85
    rows = got.orderBy("qid", "rank").collect()
    assert len(rows) == 300
    for q in range(30):
        own = [r for r in rows if r["qid"] == q]
        assert [r["score"] for r in own] == sorted(r["score"] for r in own)
        assert own[0]["vec_id"] == q  # an exact match is first


def test_batch_equals_single(base, index):
    both = {(r["qid"], r["rank"]): r["vec_id"] for r in ann.search(index, asked(base, 4), 5, 3).collect()}
    for q in range(4):
        one = ann.search(index, asked(base, 4).where(F.col("qid") == q), 5, 3).collect()
        assert all(both[q, r["rank"]] == r["vec_id"] for r in one)


def test_refinement_helps(base, index):
    exact = ann.exact_batch(base, asked(base), 10)
    mean = lambda f: metrics.recall(f, exact, 10).agg(F.avg("recall")).first()[0]
    plain = ann.Index(**{**vars(index), "config": IndexConfig(num_partitions=8, fastscan=False, refine_sq8=False)})
    assert mean(ann.search(index, asked(base), 10, 8)) > mean(ann.search(plain, asked(base), 10, 8))


def test_limits(base, index):
    assert ann.search(index, asked(base, 1), 1, 999).count() == 1
    assert ann.search(index, asked(base, 1), 0, 2).count() == 0
    with pytest.raises(ValueError):
        ann.search(index, asked(base, 1), 1, 0)
    with pytest.raises(InvalidDimension):
        ann.search(index, base.limit(1).select(F.lit(1).alias("qid"), F.slice("embedding", 1, 32).alias("embedding")), 1, 1)


def test_validation_before_writing(spark, base, index):
    with pytest.raises(InvalidDimension):
        ann.insert(index, spark.createDataFrame([(900, [0.0] * 64), (901, [0.0] * 32)], DDL))
    with pytest.raises(EmptyIndex):
        ann.train(spark.createDataFrame([], DDL), 64, IndexConfig(num_partitions=4))


def test_save_and_load(spark, base, index, tmp_path):
    save_index(index, str(tmp_path / "i"), spark)
    again = load_index(spark, str(tmp_path / "i"))
    assert again.config == index.config
    want, got = (sorted(map(tuple, ann.search(i, asked(base, 5), 5, 4).select("qid", "rank", "vec_id").collect())) for i in (index, again))
    assert want == got
    with pytest.raises(CorruptIndex):
        load_index(spark, str(tmp_path / "none"))


def test_snapshots(spark, tmp_path):
    d = Dataset(spark, str(tmp_path / "d"))
    assert [d.append(spark.range(3)), d.append(spark.range(3, 5))] == [1, 2]
    assert (d.read().count(), d.read(1).count()) == (5, 3)
    with pytest.raises(VersionNotFound):
        d.read(9)


def test_vector_files(spark, tmp_path):
    rows = np.arange(128, dtype="<f4").reshape(2, 64)
    (tmp_path / "a.fvecs").write_bytes(b"".join(np.int32(64).tobytes() + r.tobytes() for r in rows))
    (tmp_path / "a.ivecs").write_bytes(b"".join(np.int32(3).tobytes() + np.array([i, 2, 3], "<i4").tobytes() for i in range(4)))
    assert [r["embedding"] for r in read_fvecs(spark, str(tmp_path / "a.fvecs")).orderBy("row").collect()] == rows.tolist()
    assert read_ivecs(spark, str(tmp_path / "a.ivecs")).count() == 4
    (tmp_path / "v.json").write_text('{"vectors": [[1, 2], [3, 4]]}')
    assert read_json_vectors(spark, str(tmp_path / "v.json"), 2).count() == 2
    with pytest.raises(InvalidDimension):
        read_json_vectors(spark, str(tmp_path / "v.json"), 3)


def test_dense_ids(spark):
    got = sorted((r["id"], r["vec_id"]) for r in with_ids(spark.range(100).repartition(7), "id", 5).collect())
    assert got == [(i, i + 5) for i in range(100)]


def test_predicates(spark):
    df = spark.createDataFrame([(25, 90), (None, 10)], "age int, score int")
    count = lambda p: df.where(p.to_column(df.columns)).count()
    assert count(Predicate("eq", "age", 25)) == 1
    assert count(Predicate("eq", "age", 0)) == 1  # null is 0
    assert count(Predicate("eq", "absent", 0)) == 2
    assert count(Predicate("and", left=Predicate("gt", "score", 50), right=Predicate("lt", "age", 30))) == 1
    assert count(Predicate("or", left=Predicate("gt", "score", 50), right=Predicate("true"))) == 2


def test_hybrid_dispatch(spark, base):
    docs = spark.createDataFrame([(i, f"word{i} common") for i in range(20)], "doc_id long, text string")
    q = base.where("vec_id = 7").select(F.col("embedding").alias("q"))
    assert QueryPlan().execute(base, docs) is None
    assert QueryPlan(vector=q, k=3).execute(base, docs).first()["id"] == 7
    assert QueryPlan(text="word5", k=3).execute(base, docs).collect()[0]["source"] == "fulltext"
    both = QueryPlan(vector=q, text="word7", k=3).execute(base, docs).collect()
    assert both[0]["id"] == 7 and both[0]["source"] == "hybrid"
    assert QueryPlan(vector=q, text="word7", k=3, mode="weighted").execute(base, docs).first()["id"] == 7
    near = QueryPlan(vector=q, k=2, where=Predicate("gt", "vec_id", 100)).execute(base, docs)
    assert all(r["id"] > 100 for r in near.collect())


def test_sql_and_arrow_agree(base):
    q = base.where("vec_id = 9")
    a = [r["vec_id"] for r in exact_knn(base, q.select(F.col("embedding").alias("q")), 10).collect()]
    b = [r["vec_id"] for r in ann.exact_batch(base, q.select(F.col("vec_id").alias("qid"), "embedding"), 10).orderBy("rank").collect()]
    assert a == b


def test_dense_ids_at_size(spark):
    """Rows whose range partitioning is sampled anew in each run."""
    got = with_ids(spark.range(400_000).select(F.xxhash64("id").alias("x")), "x", 0).agg(F.count_distinct("vec_id").alias("n"), F.max("vec_id").alias("most")).first()
    assert (got["n"], got["most"]) == (400_000, 399_999)


def test_ties_go_to_lower_ids(spark):
    rows = [(i, [float(i < 50)] * 64) for i in range(100)]
    df = spark.createDataFrame([(i, [0.0] * 64 if 50 <= i else [1.0] * 64) for i, _ in rows], DDL).repartition(3, F.col("vec_id") % 7)
    asked_ = spark.createDataFrame([(0, [0.0] * 64)], "qid long, embedding array<float>")
    assert [r["vec_id"] for r in ann.exact_batch(df, asked_, 3).orderBy("rank").collect()] == [50, 51, 52]


def test_blocks_of_queries(base, index, monkeypatch):
    want = sorted(map(tuple, ann.search(index, asked(base, 12), 5, 4).collect()))
    exact = sorted(map(tuple, ann.exact_batch(base, asked(base, 12), 5).collect()))
    monkeypatch.setattr(ann, "QUERY_BYTES", 4 * 64 * 8)
    # the last bits of a score depend on how many queries a matrix product has
    assert [r[:4] for r in sorted(map(tuple, ann.search(index, asked(base, 12), 5, 4).collect()))] == [r[:4] for r in want]
    assert [r[:3] for r in sorted(map(tuple, ann.exact_batch(base, asked(base, 12), 5).collect()))] == [r[:3] for r in exact]


def test_hierarchical_probing_keeps_recall(base):
    i = ann.build(base, 64, IndexConfig(num_partitions=16, refine_k=60), hierarchical=True)
    i.codes = i.codes.cache()
    exact = ann.exact_batch(base, asked(base), 10)
    mean = lambda f: metrics.recall(f, exact, 10).agg(F.avg("recall")).first()[0]
    linear, two_level = (mean(ann.search(i, asked(base), 10, 12, hierarchical=h)) for h in (False, True))
    assert two_level >= linear - 0.05
    assert mean(ann.search(i, asked(base), 10, 16)) >= 0.9


def test_second_writer_is_refused(spark, tmp_path, monkeypatch):
    a, b = (Dataset(spark, str(tmp_path / "d")) for _ in range(2))
    assert a.append(spark.range(2)) == 1
    monkeypatch.setattr(b, "versions", lambda: [])
    with pytest.raises(VersionConflict):
        b.append(spark.range(3))
    assert a.read().count() == 2


@pytest.fixture(scope="module")
def close(spark):
    """Vectors that are by 8e-8 nearer to the later of the first two centroids; an index that tells them apart by so many decimals."""
    one, x = np.eye(64), np.zeros(64)
    x[1] = 4e-8
    vectors = spark.createDataFrame([(i, x.tolist()) for i in range(3)], DDL)
    return vectors, lambda decimals: ann.Index(64, IndexConfig(3, decimals=decimals), one, one[:3], np.arange(3), one[:3])


@pytest.mark.parametrize("decimals, part", [(6, 0), (9, 1)])
def test_close_distances_tie_at_the_given_decimals(close, decimals, part):
    vectors, index = close
    assert {r["partition_id"] for r in ann.assign(vectors, index(decimals)).collect()} == {part}
    assert {r["partition_id"] for r in ann.probe(index(decimals), vectors.withColumnRenamed("vec_id", "qid"), 1).collect()} == {part}


@pytest.mark.parametrize("decimals, part", [(6, 0), (9, 1)])
def test_close_groups_tie_at_the_given_decimals(close, decimals, part):
    vectors, index = close
    assert {r["partition_id"] for r in ann.assign(vectors, index(decimals), hierarchical=True).collect()} == {part}


def test_balance_counts_ties_at_the_given_decimals(close):
    vectors, index = close
    row = ann.describe(ann.encoded(ann.assign(vectors, index(6)), index(6))).first()
    assert (row["least"], row["most"], row["vectors"]) == (0, 3, 3)
    sizes = ann.assign(vectors, index(6)).groupBy("partition_id").count().collect()
    assert [(r["partition_id"], r["count"]) for r in sizes] == [(0, 3)]
