"""Shared helpers of the corpus operators: scratch tables, checked broadcasts, components."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sentrel.scratch import Scratch

#: Rows of (id) or (key, value) pairs up to which a join side is broadcast; beyond it the join shuffles.
BROADCAST_ROWS = 200_000
#: A key that holds more than this part of all rows is hot. There are fewer hot keys than that, whatever the data.
HOT_PART = 50_000

ARROW_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def small_batches(spark: SparkSession) -> None:
    """At most 1000 rows in an Arrow batch that goes to Python, so that a worker holds few texts at a time; a caller's own setting stays."""
    if spark.conf.get(ARROW_ROWS) == "10000":  # Spark's default
        spark.conf.set(ARROW_ROWS, "1000")


def own_columns(df: DataFrame, *but: str) -> list[Column]:
    """df's columns by name, whatever characters the names have, without those in `but`."""
    return [F.col(f"`{c.replace('`', '``')}`") for c in df.columns if c not in but]


def with_fields(df: DataFrame, **more: T.DataType) -> T.StructType:
    """df's schema and further columns, whatever characters the names of columns and nested fields have."""
    return T.StructType([*df.schema.fields, *[T.StructField(n, t) for n, t in more.items()]])


def map_texts(docs: DataFrame, text_col: str, *runs, **more: T.DataType) -> DataFrame:
    """docs' columns and those in `more`, which replace columns of their names; all columns may have any names.

    The first of runs gets Arrow batches of `row` and `text` (the text column as strings) and returns batches of `row`, `text` and the new columns,
    which any further ones get and return.
    """
    docs = docs.drop(*more)
    kept = text_col if dict(docs.dtypes).get(text_col) == "string" else None  # goes along once, not twice
    own = own_columns(docs, *([kept] if kept else []))
    text = F.col(f"`{text_col.replace('`', '``')}`").cast("string").alias("text")
    packed = docs.select((F.struct(*own) if own else F.lit(0)).alias("row"), text)
    out, schema = packed, with_fields(packed, **more)
    for run in runs:
        out = out.mapInArrow(run, schema)
    return out.select(*[F.col("text").alias(c) if c == kept else F.col("row")[c].alias(c) for c in docs.columns], *more)


def checked_broadcast(df: DataFrame, rows: int | None = None) -> DataFrame:
    """df marked for broadcast if it has at most so many rows, else as it is (the join then shuffles).

    df must be cheap to count: a written table or an aggregate of one.
    """
    rows = BROADCAST_ROWS if rows is None else rows
    return F.broadcast(df) if df.limit(rows + 1).count() <= rows else df


def join_by_key(rows: DataFrame, per_key: DataFrame, key: str | list[str], count: str) -> DataFrame:
    """rows joined with per_key, which has one row per key and in `count` how many of `rows` it holds. No task gets a hot key whole.

    A per_key of few rows is broadcast. Of a larger one the hot keys are, whose number HOT_PART bounds; the others shuffle. per_key must be
    a written table.
    """
    small = checked_broadcast(per_key)
    if small is not per_key:
        return rows.join(small, key)
    total = per_key.agg(F.sum(count)).first()[0]
    is_hot = F.col(count) * HOT_PART > F.lit(total)
    hot = per_key.where(is_hot)
    rest = rows.join(F.broadcast(hot.select(*([key] if isinstance(key, str) else key))), key, "left_anti").join(per_key.where(~is_hot), key)
    return rows.join(F.broadcast(hot), key).unionByName(rest)


def hash_sample(df: DataFrame, n: int, *key: str) -> DataFrame:
    """The n rows whose hash of `key` is smallest; all, if there are no more. Rows of one key are taken together, so there may be a few less.

    A threshold on the hash, set from the number of rows, leaves little more than n to put in order; only hashes are, rows stay where they are.
    """
    total, h = df.count(), F.xxhash64(*key)
    if total <= n:
        return df
    near = df.where(h <= int(-(2**63) + 2**64 * min(1.0, 1.05 * n / total + 50 / total)) - 1)
    last = near.select(h.alias("h")).orderBy("h").limit(n + 1).groupBy().agg(F.min("h").alias("low"), F.max("h").alias("top"), F.count("*").alias("k")).first()
    if last["k"] <= n:
        return near
    return near.where(h < F.lit(last["top"])) if last["low"] < last["top"] else near.limit(n)


def components(scratch: Scratch, links: DataFrame) -> DataFrame:
    """links (a long, b long) -> (id, component): the smallest id reachable, for every id that has a link.

    Alternating large-star and small-star steps over tables in the shared folder. A node's smallest
    neighbour is found by a partial aggregate and joined back by `join_by_key`, so a hub's links are never gathered.
    Edges that are few enough for a broadcast are worked on in one task, where nothing needs to move.
    """
    edges = scratch.write(links.where("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct(), "edges")

    def state(e: DataFrame):
        return tuple(e.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first())

    def lowered(e: DataFrame, few: bool) -> DataFrame:
        """e with `m`, the smallest of u and its neighbours."""
        low = e.groupBy("u").agg(F.least("u", F.min("v")).alias("m"), F.count("*").alias("c"))
        return e.join(low, "u") if few else join_by_key(e, scratch.write(low, "low"), "u", "c")

    before = state(edges)
    while before[0]:
        few = before[0] <= BROADCAST_ROWS
        together = (lambda e: e.coalesce(1)) if few else (lambda e: e)
        both = together(together(edges).unionByName(together(edges).select(F.col("v").alias("u"), F.col("u").alias("v"))))
        large = lowered(both, few).where("v > u").select(F.col("v").alias("u"), F.col("m").alias("v")).where("u <> v").distinct()
        large = large if few else scratch.write(large, "large")
        small = lowered(large, few).select(F.explode(F.array(F.struct("u", F.col("m").alias("v")), F.struct(F.col("v").alias("u"), F.col("m").alias("v")))).alias("e")).select("e.*").where("u <> v").distinct()
        new = scratch.write(small, "edges")
        scratch.drop(edges)
        edges, after = new, state(new)
        if after == before:
            break
        before = after
    stars = edges.groupBy("u").agg(F.min("v").alias("component")).select(F.col("u").alias("id"), "component")
    all_ = stars.unionByName(edges.select(F.col("v").alias("id"), F.col("v").alias("component")))
    return scratch.write(all_.groupBy("id").agg(F.min("component").alias("component")), "components")
