"""Mixing sources to target weights by hash-threshold histograms.

Every row has a fixed 60-bit hash. Words are summed by source and leading hash digits; the digit range in
which a source's sum passes its target is refined by the next digits, until it is a single hash. Rows below
the threshold are taken: a filter, no sort.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import Scratch, checked_broadcast, own_columns, table

WEIGHTS, SHARE, REPEATS = (5, 2, 1), 1.5, 2
DIGITS, STEP = 15, 3  # hex digits of the hash, and those that one histogram resolves


def n_words(text: Column) -> Column:
    """Number of runs of anything but ASCII white space."""
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit("[^\\x20\\x09-\\x0D]+")).cast("long")


def targets(sizes: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS) -> DataFrame:
    """(source, source_size) -> with target: `share` of all sizes by weight, never over `repeats` times the source.

    Where a source reaches its cap, the excess goes to the others by weight. In order of cap per weight, the
    level with the first j sources capped is (budget - their caps) / (weights of the rest); the first j whose
    level leaves the next source under its cap is right. One row per source, so the global windows are narrow.
    """
    by_name = W.orderBy(F.col("source").asc_nulls_last())
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.pmod(F.row_number().over(by_name) - 1, F.lit(len(weights))) + 1).cast("int"))
    s = sizes.withColumn("weight", w).withColumn("cap", F.col("source_size") * F.lit(float(repeats)))
    order = W.orderBy(F.col("cap") / F.col("weight"), F.col("source").asc_nulls_last())
    every = W.partitionBy().rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    budget = F.sum("source_size").over(every) * F.lit(float(share))
    s = s.withColumn("level", (budget - F.coalesce(F.sum("cap").over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0.0))) / F.sum("weight").over(order.rowsBetween(0, W.unboundedFollowing)))
    fits = F.min(F.when(F.col("level") * F.col("weight") <= F.col("cap"), F.col("k"))).over(every)
    s = s.withColumn("k", F.row_number().over(order)).withColumn("free_from", fits)
    level = F.max(F.when(F.col("k") == F.col("free_from"), F.col("level"))).over(every)
    s = s.withColumn("final", level)
    return s.select("source", "source_size", F.when(F.col("free_from").isNull() | (F.col("k") < F.col("free_from")), F.col("cap")).otherwise(F.col("final") * F.col("weight")).alias("target"))


def row_hash(doc: Column, text: Column) -> Column:
    """Leading hex digits of a hash of id and text."""
    return F.substring(F.md5(F.concat_ws("|", F.coalesce(doc.cast("string"), F.lit("-")), F.md5(F.coalesce(text, F.lit(""))))), 1, DIGITS)


def source_key(source: Column) -> Column:
    """Null has a key of its own."""
    return F.coalesce(F.concat(F.lit("="), source), F.lit("-"))


def cuts(scratch: Scratch, sized: DataFrame, weights: tuple, share: float, repeats: int) -> DataFrame:
    """sized (a table: key, source, h, size) -> one row per source: key, source_size, target, whole (times that all rows are taken), cut, take_cut.

    Once more are taken the rows whose hash lies below `cut` (all, where it is null and something is left; at it, with take_cut).
    """
    sizes = sized.groupBy("key", "source").agg(F.sum("size").alias("source_size"))
    plan = targets(sizes, weights, share, repeats).withColumn("key", source_key(F.col("source")))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0).cast("long")
    plan = plan.withColumn("whole", whole).withColumn("left", F.col("target") - F.col("whole") * F.col("source_size"))
    plan = scratch.write(plan.select("key", "source_size", "target", "whole", "left"), "targets")

    # state: per source the prefix of the boundary range and the words below it
    state = plan.select("key", F.lit("").alias("at"), F.lit(0).cast("long").alias("below"), "left")
    for end in range(STEP, DIGITS + 1, STEP):
        inside = sized.join(checked_broadcast(state), "key").where(F.col("h").startswith(F.col("at")))
        sums = inside.groupBy("key", F.substring("h", 1, end).alias("to")).agg(F.sum("size").alias("w"), F.first("below").alias("below"), F.first("left").alias("left"))
        run = sums.withColumn("upto", F.col("below") + F.sum("w").over(W.partitionBy("key").orderBy("to")))
        over = run.where("upto > left").groupBy("key").agg(F.min(F.struct("to", (F.col("upto") - F.col("w")).alias("below"), "left", "upto")).alias("x"))
        last = scratch.write(over.select("key", F.col("x.to").alias("at"), F.col("x.below").alias("below"), F.col("x.left").alias("left"), F.col("x.upto").alias("upto")), "state")
        state = last.select("key", "at", "below", "left")
    nearer = (F.col("upto") - F.col("left")) < (F.col("left") - F.col("below"))
    found = plan.join(last.select("key", F.col("at").alias("cut"), nearer.alias("take_cut")), "key", "left")
    return scratch.write(found.select("key", "source_size", "target", "whole", "cut", "take_cut"), "cuts")


def taken(h: Column, repeats: int) -> Column:
    """How often a row with this hash is taken; the columns of `cuts` stand beside it."""
    rest = (F.col("target") > F.col("whole") * F.col("source_size")).cast("long")
    below = ((h < F.col("cut")) | ((h == F.col("cut")) & F.col("take_cut"))).cast("long")
    return F.least(F.col("whole") + F.when(F.col("cut").isNull(), rest).otherwise(below), F.lit(repeats)).cast("int")


_RESULTS = ("__size", "__source_size", "__target", "__copies")


def mix_plan(spark: SparkSession, docs: DataFrame, weights: tuple = WEIGHTS, share: float = SHARE, repeats: int = REPEATS, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """docs' columns with __size, __source_size, __target and __copies (how often the mix takes the row, 0 to `repeats`).

    A source takes its rows floor(target / size) times, and once more those whose hash lies below its threshold:
    the largest threshold at which the words taken stay within the target, or the next one if that is nearer.
    Rows with the same id, source and text have one hash and are taken alike. Null texts have size 0; the null
    source is a source of its own, the last. Columns of docs named like the four are replaced, any other names may be
    there. An empty table gives no rows.
    """
    scratch, docs = Scratch(spark), docs.drop(*_RESULTS)
    row, text = F.struct(*own_columns(docs)), F.col(f"`{text_col}`")
    each = docs.select(row.alias("row"), source_key(F.col(f"`{source_col}`")).alias("key"), F.col(f"`{source_col}`").alias("source"), row_hash(F.col(f"`{id_col}`"), text).alias("h"), n_words(text).alias("size"))
    sized = scratch.write(each.drop("row"), "sized")
    found = cuts(scratch, sized, weights, share, repeats)
    scratch.keep(found)
    out = each.join(checked_broadcast(found), "key")
    return out.select(*[F.col("row")[c].alias(c) for c in docs.columns], F.col("size").alias("__size"), F.col("source_size").alias("__source_size"), F.col("target").alias("__target"), taken(F.col("h"), repeats).alias("__copies"))


def op9_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Ids, sizes and hashes are written once; texts are read once."""
    scratch, docs = Scratch(spark), table(spark, sf_dir, "documents")
    sized = scratch.write(docs.select("doc_id", source_key(F.col("source")).alias("key"), "source", row_hash(F.col("doc_id"), F.col("text")).alias("h"), n_words(F.col("text")).alias("size")), "sized")
    found = cuts(scratch, sized, WEIGHTS, SHARE, REPEATS)
    scratch.keep(sized, found)
    return sized.join(checked_broadcast(found), "key").select("doc_id", "size", "source_size", "target", (F.col("size") * taken(F.col("h"), REPEATS)).alias("taken"))


def mixed(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs with each row as often as the mix takes it."""
    rows = docs.select(F.struct(*own_columns(docs, "text")).alias("row"), *[F.col(c) for c in ("doc_id", "text", "source")])
    plan = mix_plan(spark, rows).where("__copies > 0").select("*", F.explode(F.sequence(F.lit(1), F.col("__copies"))).alias("__copy"))
    return plan.select(*[F.col("text") if c == "text" else F.col("row")[c].alias(c) for c in docs.columns])


ORACLE = """
WITH d AS (
  SELECT doc_id, source, CAST(len(regexp_extract_all(coalesce(text, ''), '[^\\x20\\x09-\\x0D]+')) AS BIGINT) AS size,
         left(md5(coalesce(CAST(doc_id AS VARCHAR), '-') || '|' || md5(coalesce(text, ''))), 15) AS h
  FROM documents),
s AS (SELECT source, CAST(sum(size) AS BIGINT) AS source_size FROM d GROUP BY source),
w AS (SELECT *, CAST([5.0, 2.0, 1.0][CAST((row_number() OVER (ORDER BY source ASC NULLS LAST) - 1) % 3 + 1 AS INT)] AS DOUBLE) AS weight,
             CAST(source_size * 2 AS DOUBLE) AS cap FROM s),
l AS (SELECT *, row_number() OVER o AS k,
             (CAST(sum(source_size) OVER () AS DOUBLE) * CAST(1.5 AS DOUBLE) - coalesce(sum(cap) OVER (o ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0))
             / sum(weight) OVER (o ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING) AS level
      FROM w WINDOW o AS (ORDER BY cap / weight, source ASC NULLS LAST)),
f AS (SELECT *, min(CASE WHEN level * weight <= cap THEN k END) OVER () AS free_from FROM l),
g AS (SELECT *, max(CASE WHEN k = free_from THEN level END) OVER () AS final FROM f),
t AS (SELECT source, source_size, CASE WHEN free_from IS NULL OR k < free_from THEN cap ELSE final * weight END AS target FROM g),
p AS (SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM p),
c AS (SELECT d.*, r.source_size, r.target, r.whole, r.rest,
             sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE UNBOUNDED PRECEDING) AS upto,
             coalesce(sum(size) OVER (PARTITION BY d.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW EXCLUDE GROUP), 0) AS below
      FROM d JOIN r ON d.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       CAST(size * least(2, whole + CASE WHEN upto <= rest THEN 1 WHEN below <= rest AND upto - rest < rest - below THEN 1 ELSE 0 END) AS BIGINT) AS taken
FROM c
"""
