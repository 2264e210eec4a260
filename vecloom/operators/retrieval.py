"""Exact search, predicates, BM25 and fused retrieval as DataFrame plans."""

from __future__ import annotations

import re
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from vecloom.functions import vectors as V
from vecloom.operators import index as ann

#: Rows beyond k that a ranking by rounded distances looks at.
ROUNDING_ROWS = 16


def exact_knn(base: DataFrame, query: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """The k nearest rows of base to the one row of query (q); ties go to the lower vec_id."""
    measure = {"l2": V.l2sq, "ip": lambda a, b: -V.dot(a, b), "cosine": V.cosine_distance}[metric]
    near = F.round(measure(F.col("embedding"), F.col("q")), 4)
    # a vector's distance from itself may round to minus zero
    scored = base.crossJoin(F.broadcast(query.limit(1))).select("vec_id", F.when(near == 0, F.lit(0.0)).otherwise(near).alias("dist"))
    return scored.orderBy("dist", "vec_id").limit(k)


def batch_knn(base: DataFrame, queries: DataFrame, k: int | Column, digits: int = 4) -> DataFrame:
    """queries (qid, q, ...) against all rows of base, in blocks of bounded size; k may be a column of queries.

    Distances are rounded, and equal ones go to the lower vec_id; as the engine ranks unrounded
    distances, it is asked for some more rows than k, all of which it would have to tie.
    """
    own = k if isinstance(k, Column) else F.lit(k)
    asked = queries.select("qid", F.col("q").alias("embedding"), (own + ROUNDING_ROWS).cast("int").alias("k"))
    found = ann.exact_batch(base, asked, 0).withColumn("dist", F.round("dist", digits))
    w = Window.partitionBy("qid").orderBy("dist", "vec_id")
    kept = queries.select("qid", own.cast("int").alias("k"))
    return found.withColumn("rank", F.row_number().over(w)).join(kept, "qid").where(F.col("rank") <= F.col("k")).select("qid", F.col("rank").cast("long").alias("rank"), "vec_id", F.when(F.col("dist") == 0, F.lit(0.0)).otherwise(F.col("dist")).alias("dist"))


@dataclass(frozen=True)
class Predicate:
    """eq, gt and lt compare an integer column (missing or null is 0); and_, or_ join; true passes all."""

    kind: str
    column: str = ""
    value: int = 0
    left: Predicate | None = None
    right: Predicate | None = None

    def to_column(self, columns: list[str]) -> Column:
        if self.kind == "true":
            return F.lit(True)
        if self.kind in ("and", "or"):
            a, b = self.left.to_column(columns), self.right.to_column(columns)
            return a & b if self.kind == "and" else a | b
        c = F.coalesce(F.col(self.column).cast("long"), F.lit(0)) if self.column in columns else F.lit(0)
        return {"eq": c == self.value, "gt": c > self.value, "lt": c < self.value}[self.kind]


def condition(where: Predicate | Column | str | None, columns: list[str]) -> Column:
    """A predicate, a Column or SQL text (NOT, IN, LIKE and whatever Spark has) as a Column; nothing passes all."""
    if where is None:
        return F.lit(True)
    if isinstance(where, Predicate):
        return where.to_column(columns)
    return F.expr(where) if isinstance(where, str) else where


def bm25(docs: DataFrame, query: str, k: int, k1: float = 1.2, b: float = 0.75) -> DataFrame:
    """doc_id, score of the k best documents; only the query's terms are exploded and shuffled."""
    terms = sorted(set(re.findall("[a-z0-9]+", query.lower())))
    # one pass over the texts: a row a document keeps its length and its counts of the query's terms
    toks = docs.select("doc_id", F.expr("regexp_extract_all(lower(text), '[a-z0-9]+', 0)").alias("toks"))
    of = lambda word: F.size(F.filter("toks", lambda t: t == word))
    tf = toks.select("doc_id", F.size("toks").alias("dl"), *[of(w).alias(f"t{i}") for i, w in enumerate(terms)])
    stats = tf.agg(F.count("*").alias("n"), F.avg("dl").alias("avgdl"), *[F.count_if(F.col(f"t{i}") > 0).alias(f"d{i}") for i in range(len(terms))])
    found = tf.where(" or ".join([f"t{i} > 0" for i in range(len(terms))]) or "false")

    def part(i: int) -> Column:
        idf = F.log(1 + (F.col("n") - F.col(f"d{i}") + 0.5) / (F.col(f"d{i}") + 0.5))
        t = F.col(f"t{i}")
        return F.when(t > 0, idf * t * (k1 + 1) / (t + k1 * (1 - b + b * F.col("dl") / F.col("avgdl")))).otherwise(F.lit(0.0))

    # stats is one row
    score = sum([part(i) for i in range(len(terms))], F.lit(0.0))
    return found.crossJoin(F.broadcast(stats)).select("doc_id", F.round(score, 4).alias("score")).orderBy(F.desc("score"), "doc_id").limit(k)


def ranked(df: DataFrame, key: str, *order) -> DataFrame:
    """Number the rows of a short, limited list."""
    return df.select(F.col(key).alias("id"), "*").withColumn("rank", F.row_number().over(Window.orderBy(*order)))


def reciprocal_rank_fusion(lists: list[DataFrame], k: int, c: int = 60) -> DataFrame:
    """Sum of 1 / (c + rank) over lists (id, rank); sorted before it is cut."""
    every = lists[0].select("id", "rank")
    for other in lists[1:]:
        every = every.unionByName(other.select("id", "rank"))
    return every.groupBy("id").agg(F.round(F.sum(1.0 / (c + F.col("rank"))), 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


def weighted_fusion(vector: DataFrame, text: DataFrame, alpha: float, k: int) -> DataFrame:
    """alpha * scaled nearness + (1 - alpha) * scaled text score over lists (id, dist) and (id, score)."""
    scaled = lambda df, c: df.crossJoin(F.broadcast(df.agg(F.min(c).alias("lo"), F.max(c).alias("hi")))).select("id", F.when(F.col("hi") > F.col("lo"), (F.col(c) - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0).alias("s"))
    a = scaled(vector, "dist").select("id", (1 - F.col("s")).alias("a"))
    b = scaled(text, "score").select("id", F.col("s").alias("b"))
    total = alpha * F.coalesce("a", F.lit(0.0)) + (1 - alpha) * F.coalesce("b", F.lit(0.0))
    return a.join(b, "id", "full").select("id", F.round(total, 6).alias("score")).orderBy(F.desc("score"), "id").limit(k)


@dataclass(frozen=True)
class QueryPlan:
    """A hybrid query; where filters before scoring. Both sides fetch fetch(k) rows before fusion."""

    vector: DataFrame | None = None
    k: int = 10
    where: Predicate | Column | str | None = None
    text: str | None = None
    mode: str = "rrf"
    alpha: float = 0.5

    def fetch(self) -> int:
        return 4 * self.k if self.k <= 64 else 256

    def execute(self, base: DataFrame, docs: DataFrame, index: ann.Index | None = None, nprobe: int = 8) -> DataFrame | None:
        """(id, score, source): distances for vectors alone, greater is better for text and hybrid.

        With an index the vector side is searched in it, among the rows that pass; else all are scored.
        """
        allowed = None
        if self.where is not None:
            base = allowed = base.where(condition(self.where, base.columns))
            docs = docs.join(base.select(F.col("vec_id").alias("doc_id")), "doc_id", "left_semi") if self.vector is not None else docs.where(condition(self.where, docs.columns))
        near = None
        if self.vector is not None and index is not None:
            asked = self.vector.limit(1).select(F.lit(0).cast("long").alias("qid"), F.col("q").alias("embedding"))
            near = ann.search(index, asked, self.fetch(), nprobe, allowed).select("vec_id", F.round("score", 4).alias("dist"))
        elif self.vector is not None:
            near = exact_knn(base, self.vector, self.fetch())
        found = bm25(docs, self.text, self.fetch()) if self.text is not None else None
        if near is None and found is None:
            return None
        if found is None:
            return near.orderBy("dist", "vec_id").limit(self.k).select(F.col("vec_id").alias("id"), F.col("dist").alias("score"), F.lit("vector").alias("source"))
        if near is None:
            return found.orderBy(F.desc("score"), "doc_id").limit(self.k).select(F.col("doc_id").alias("id"), "score", F.lit("fulltext").alias("source"))
        if self.mode == "weighted":
            fused = weighted_fusion(near.withColumnRenamed("vec_id", "id"), found.withColumnRenamed("doc_id", "id"), self.alpha, self.k)
        else:
            fused = reciprocal_rank_fusion([ranked(near, "vec_id", "dist", "vec_id"), ranked(found, "doc_id", F.desc("score"), "doc_id")], self.k)
        return fused.withColumn("source", F.lit("hybrid"))
