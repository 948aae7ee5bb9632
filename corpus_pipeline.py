"""From raw documents to training shards: five stages, each one corpus operator over all that the one before kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sentrel.llm.common import Scratch, own_columns, table
from sentrel.llm.decontaminate import without_benchmark
from sentrel.llm.mixing import mixed
from sentrel.llm.ngram_join import first_of_each_group
from sentrel.llm.quality import good_documents
from sentrel.llm.sharding import assign_shards
from sentrel.scratch import scratch_made


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents that the quality classifier rejects."""
    return good_documents(spark, docs, table(spark, sf_dir, "labels"))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document of smallest doc_id."""
    return first_of_each_group(spark, docs)


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Without the documents in which a benchmark window occurs."""
    return without_benchmark(spark, docs, table(spark, sf_dir, "benchmark"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of sources takes it."""
    return mixed(spark, docs)


def sharding(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents with their shard and slot; columns of those names are replaced."""
    rows = docs.select("doc_id", "text", F.struct(*own_columns(docs)).alias("row"))
    placed = assign_shards(spark, rows, keep=("row",))
    return placed.select(*[F.col("row")[c].alias(c) for c in docs.columns if c not in ("shard", "slot")], "shard", "slot")


STAGES = [("quality", quality), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("mixing", mixing), ("sharding", sharding)]

#: The classifier is fitted by iterations that SQL can't express; tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages over documents; what each returns is written to the shared folder and read again by the next.

    Once a stage's result is written, the one before it and all that the stage wrote for itself go, so that only the last result stays.
    """
    scratch, docs, last = Scratch(spark), table(spark, sf_dir, "documents"), []
    for name, stage in STAGES:
        with scratch_made() as made:
            docs = scratch.write(stage(spark, docs, sf_dir), name)
        for own in made:
            own.keep()
        scratch.drop(*last)
        last = [docs]
    return docs
