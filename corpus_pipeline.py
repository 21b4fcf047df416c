"""The corpus pipeline: five operators one after the other over the documents of a scale-factor folder.

Each stage takes what its predecessor kept. The first three filter, the fourth repeats or leaves out documents so that
sources come near their targets, and the last gives every remaining document its shard.

All stages take nulls in any column, empty and very long texts, repeated rows, an empty table and extra columns of any
name; each stage's docstring says what becomes of them. All but the last return the columns they were given.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from tessera.llm import decontaminate, mixture, shard, simhash, similar, toxicity
from tessera.plans.lineage import cut


def toxic_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that score under the threshold; one at the threshold goes.

    Null and empty texts score the model's leak and stay while that is under the threshold. Whole texts are scored, of any
    length. Rows that repeat are scored alike and all stay or all go. A null id teaches nothing and is scored like any
    other. Without labels nothing can be learned and nothing goes.
    """
    return toxicity.clean(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))


def near_duplicates_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near duplicates: by fingerprints, then by five-word shingles that agree in 80 %.

    The row of the smallest id stays (null ids last), of several with it that of the smallest hash of the text, of several
    of that the one with the smallest hash of all columns, and of rows that repeat all columns one. Texts without words, null ones too, are duplicates of each other. Rows that share an
    id but not their texts are told apart.
    """
    return similar.dedup(simhash.dedup(docs))


def benchmark_out(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a passage of a benchmark item.

    Null and empty texts stay, as does everything if the benchmark is empty. Long texts are searched whole. Rows that
    repeat all stay or all go. Items without an id or text, or of fewer than five tokens, match nothing.
    """
    return decontaminate.clean(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix of sources takes them.

    Null sources are one source, the last. Null and empty texts have no words and stay once. Rows that repeat id, text and
    source are taken alike, in the same number each. A document that is taken for less than half of it goes.
    """
    return mixture.mix(docs)


def sharded(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The shard of every row that is left.

    Null and empty texts have no bytes and a shard like others; a text over the limit has a shard of its own. Rows that
    repeat id and text fill overflow pages. Null ids are hashed as one value.
    """
    return shard.assign(docs)


STAGES = [
    ("toxicity", toxic_out),
    ("near_duplicates", near_duplicates_out),
    ("decontamination", benchmark_out),
    ("mixing", mixed),
    ("sharding", sharded),
]

#: SQL can't express the learned, hashed and linked stages; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``, each read back from the checkpoint folder as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for _, stage in STAGES[:-1]:
        docs = cut(stage(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
