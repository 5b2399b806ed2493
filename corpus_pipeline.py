"""The corpus pipeline: five of the training-data operators, each over all that the one before kept.

``STAGES`` lists (name, function); a function takes (spark, docs, sf_dir) and returns a DataFrame.
:func:`run` writes each stage's result as Parquet in the shared checkpoint folder and reads it again, so
that a later stage never recomputes an earlier one and lost executors lose nothing.

Defined results: null and empty texts are scored, kept or rejected as the toxicity model does with texts without hits, are near
duplicates of nothing and hold no benchmark window; the mixture takes them only with whole epochs. Rows that repeat a doc_id and
a text stay or go together in all stages, and no stage but the mixture multiplies them. An empty table gives no rows at
the end. Further columns, whatever their names are, come through all stages; the last leaves out text, shard, tier and version of
the documents themselves.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from locusloom.llm import decontam, mixing, neardup, sharding, toxicity
from locusloom.llm.common import shared_dir, table
from locusloom.llm.queries import MIX_WEIGHTS, SHARD_BYTES

#: Scores are learned, so SQL can't express the first stage; tests hold the stages against brute force.
ORACLE_SQL = None


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity score rejects go."""
    return toxicity.reject_toxic(docs, table(spark, sf_dir, "labels"), threshold=0.7)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates stays (five words, similarity 0.8)."""
    return neardup.deduplicate(docs, width=5, percent=80)


def benchmark(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold a window of a benchmark item go."""
    return decontam.decontaminate(docs, table(spark, sf_dir, "benchmark"), window=10, mode="document")


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows are taken, some repeatedly, as the target weights ask."""
    return mixing.mixed(docs, MIX_WEIGHTS, fraction=1.0, max_epochs=3.0, seed=7)


def shards(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The rows are stored as compacted shards; returned are doc_id and where each row is."""
    return sharding.sharded(docs, target=SHARD_BYTES)


STAGES = [
    ("toxicity", toxic),
    ("minhash near-dedup", near_duplicates),
    ("benchmark decontamination", benchmark),
    ("mixing", mixture),
    ("sharding", shards),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Apply the stages to ``documents`` and return the last one's rows."""
    root = f"{shared_dir(spark)}/pipeline-{uuid.uuid4().hex}"
    docs = table(spark, sf_dir, "documents")
    for k, (_, stage) in enumerate(STAGES):
        stage(spark, docs, sf_dir).write.parquet(f"{root}/{k}")
        docs = spark.read.parquet(f"{root}/{k}")
    return docs
