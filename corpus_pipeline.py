"""A training corpus from `documents`: five stages, each written as Parquet and read as the next one's docs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from vecloom.llm.bpe_codec import encode_decode
from vecloom.llm.common import scratch, text_batches
from vecloom.llm.decontaminate import drop_contaminated
from vecloom.llm.line_dedup import dedup_lines
from vecloom.llm.ngram_join import keep_one
from vecloom.llm.toxicity import drop_toxic

#: Rows of an Arrow batch. All stages run in the same executors, whose heaps grow from stage to stage and leave less
#: for batches outside the heap than one operator alone has.
BATCH = 250


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rejects documents that score 0.7 or more."""
    text_batches(spark, BATCH)
    return drop_toxic(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes lines that occur earlier: long ones within three edits, shorter ones of three words as they are."""
    return dedup_lines(docs)


def ngram_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the least document of each group of near copies."""
    text_batches(spark, BATCH)
    return keep_one(docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Removes documents contaminated by benchmark items."""
    return drop_contaminated(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def bpe_codec(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Encodes and decodes what is left."""
    return encode_decode(docs).drop("decoded")


STAGES = [("toxicity", toxicity), ("line dedup", line_dedup), ("n-gram Jaccard join", ngram_join), ("benchmark decontamination", decontamination), ("byte-level BPE", bpe_codec)]

#: The first stage is a trained model, so SQL can't express the rows. Tests hold the stages' operators to brute force,
#: and the pipeline to what each stage promises of its own output.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        path = scratch(spark, name.replace(" ", "-"))
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    path = scratch(spark, "corpus")
    STAGES[-1][1](spark, docs, sf_dir).write.parquet(path)
    return spark.read.parquet(path)
