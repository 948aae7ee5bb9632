"""Contiguous balanced shards by global prefix sums of byte sizes.

Rows are put in one global order (hash of the text, then id), sorted by range into partitions, in which sizes
are summed row by row; the totals of the partitions before are a partition's offset. A row's shard is
where the middle of its bytes falls among equal targets.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from .common import Scratch, small_batches, table, with_fields

SHARDS, OVERHEAD = 40, 16


def with_prefix_sums(scratch: Scratch, rows: DataFrame, order: list[str], size: str) -> tuple[DataFrame, int]:
    """rows with `before` (sum of `size` over all rows before it in the order), and the total. rows should be narrow.

    The range partitions are written with their number, so that a rerun can't place rows otherwise. Only one
    total per partition passes through the driver.
    """
    spark = scratch.spark
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, *order).withColumn("part", F.spark_partition_id())
    ranged = scratch.write(ranged, "ranged")
    totals = {r["part"]: r["t"] for r in ranged.groupBy("part").agg(F.sum(size).alias("t")).collect()}
    offsets, total = [], 0
    for part in sorted(totals):
        offsets.append((part, total))
        total += totals[part]
    starts = spark.createDataFrame(offsets, "part int, start long")
    w = W.partitionBy("part").orderBy(*order).rowsBetween(W.unboundedPreceding, -1)
    out = ranged.withColumn("before", F.coalesce(F.sum(size).over(w), F.lit(0))).join(F.broadcast(starts), "part")
    return out.withColumn("before", F.col("before") + F.col("start")).drop("start"), total


def _running(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Adds the sum of sizes and the number of rows before each row of the partition."""
    total = rows = 0
    for batch in batches:
        size = batch.column("size").to_numpy()
        upto = total + np.cumsum(size)
        at = rows + np.arange(len(size))
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(upto - size, pa.int64()), pa.array(at, pa.int64())], [*batch.schema.names, "before", "place"])
        total, rows = int(upto[-1]) if len(size) else total, rows + len(size)


def assign_shards(spark: SparkSession, docs: DataFrame, shards: int = SHARDS, id_col: str = "doc_id", text_col: str = "text", size: Column | None = None, keep: tuple[str, ...] = ()) -> DataFrame:
    """One row per row of docs: doc_id, size, text_crc32, shard (0 to shards - 1), slot (gapless from 0 in each shard)
    and the columns named in `keep` (of docs; their names must differ from those).

    Rows of equal texts follow one another in the global order, so a group of copies is together unless a cut
    falls into it; a group larger than a shard's target is spread over several. Sizes are the text's UTF-8 bytes
    plus 16, and shards differ from the target by less than one row's size at either end. Null texts count as
    none (CRC 0, of the empty text) and null ids come first among equal texts; repeated rows take one slot each.
    A text larger than a target may leave other shards empty. An empty table gives no rows.

    Rows move once, into sorted range partitions, which are written with their number so that a rerun can't place rows otherwise. Only
    one total per partition and one count per shard pass through the driver.
    """
    small_batches(spark)
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    size = F.octet_length(text).cast("long") + OVERHEAD if size is None else size
    rows = docs.select(F.col(id_col).alias("doc_id"), size.alias("size"), F.crc32(F.encode(text, "UTF-8")).alias("text_crc32"), F.xxhash64(text).alias("at"), *[F.col(c).alias(f"keep_{c}") for c in keep])
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, "at", "doc_id").withColumn("part", F.spark_partition_id()).sortWithinPartitions("at", "doc_id")
    ranged = Scratch(spark).write(ranged.mapInArrow(_running, with_fields(ranged, before=T.LongType(), place=T.LongType())), "ranged")

    offsets, total, n = [], 0, 0
    for r in sorted(ranged.groupBy("part").agg(F.sum("size").alias("size"), F.count("*").alias("n")).collect(), key=lambda r: r["part"]):
        offsets.append((r["part"], total, n))
        total, n = total + r["size"], n + r["n"]
    starts = spark.createDataFrame(offsets, "part int, bytes0 long, rows0 long")
    middle = (F.col("before") + F.col("bytes0")).cast("decimal(38,0)") * 2 + F.col("size")
    shard = F.least(F.floor(middle * F.lit(shards) / F.lit(max(1, 2 * total)).cast("decimal(38,0)")), F.lit(shards - 1)).cast("int")
    placed = ranged.join(F.broadcast(starts), "part").withColumn("shard", shard)  # one row per partition
    firsts = placed.groupBy("shard").agg(F.min(F.col("place") + F.col("rows0")).alias("first"))  # shards are contiguous
    out = placed.join(F.broadcast(firsts), "shard")  # one row per shard
    return out.select("doc_id", "size", "text_crc32", "shard", (F.col("place") + F.col("rows0") - F.col("first")).alias("slot"), *[F.col(f"keep_{c}").alias(c) for c in keep])


def op5_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shards_by_bytes(spark, table(spark, sf_dir, "documents"))


def shards_by_bytes(spark: SparkSession, docs: DataFrame) -> DataFrame:
    return assign_shards(spark, docs).select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))
