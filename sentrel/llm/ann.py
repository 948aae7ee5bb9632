"""Approximate nearest neighbours: a hierarchical navigable small-world graph per shard, shard results merged.

Equal vectors become one point with its smallest ids, so that a very common vector can't fill neighbour lists.
Points are dealt to shards by hash, as many to one as SHARD_BYTES of vectors hold: a search in a graph costs the
logarithm of its size, so the fewer shards the better. A shard's graph is built layer by layer, in batches that
double, and kept as flat neighbour arrays. A shard goes to a task once, and blocks of queries stream over it: a beam search over
all queries of a block at once; the whole beam is scored by exact cosine, and the nearest of each shard are merged.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from sentrel.scratch import settings

from .common import ARROW_ROWS, Scratch, checked_broadcast, table

NEAREST, QUERY_STEP = 5, 50
SHARD_BYTES, BLOCK_ROWS = 32 << 20, 2048  # of a shard's vectors in double precision; a task holds about four times as much
LINKS, BEAM, SEARCH_BEAM = 16, 64, 96
AT_ONCE = 512  # points inserted or queries searched together, at most
LANES = 0  # tasks that share a shard's queries; 0: as many as keep all cores busy
SEED = 11


def unit(x: np.ndarray) -> np.ndarray:
    """Rows scaled to length 1, in double precision and safe from overflow."""
    x = x / np.abs(x).max(1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


def diverse(near: np.ndarray, dist: np.ndarray, x: np.ndarray, most: int) -> np.ndarray:
    """Of each row's candidates (by distance, -1 pads) those nearer to the row's point than to any taken one, then the nearest others."""
    rows, width = near.shape
    d = 1 - np.matmul(x[near], x[near].transpose(0, 2, 1))
    to_taken, taken, count = np.full(near.shape, np.inf, np.float32), np.zeros(near.shape, bool), np.zeros(rows, np.int64)
    for j in range(width):
        ok = (near[:, j] >= 0) & (dist[:, j] < to_taken[:, j]) & (count < most)
        taken[:, j], count = ok, count + ok
        to_taken = np.where(ok[:, None], np.minimum(to_taken, d[:, j]), to_taken)
    order = np.argsort(np.where(near < 0, 2, np.where(taken, 0, 1)), axis=1, kind="stable")[:, :most]
    out = np.full((rows, most), -1, np.int32)
    out[:, : order.shape[1]] = np.take_along_axis(near, order, 1)
    return out


def beam_search(links: np.ndarray, x: np.ndarray, q: np.ndarray, entries: np.ndarray, beam: int, at_once: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """The beam nearest points found for each query, by distance (-1 and inf pad)."""
    n, rows = len(q), np.arange(len(q))[:, None]
    seen = np.zeros((n, len(x) + 1), bool)
    seen[:, -1] = True  # where -1 points

    def fresh(ids: np.ndarray, who: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        ids = np.sort(ids, axis=1)
        ids[:, 1:][ids[:, 1:] == ids[:, :-1]] = -1
        ids[seen[who[:, None], ids]] = -1
        seen[who[:, None], ids] = True
        return ids, np.where(ids < 0, np.inf, 1 - np.matmul(x[ids], q[who][:, :, None])[:, :, 0]).astype(np.float32)

    ids, dist = fresh(entries.astype(np.int32), np.arange(n))
    pad = max(0, beam - ids.shape[1])
    ids, dist = np.pad(ids, ((0, 0), (0, pad)), constant_values=-1), np.pad(dist, ((0, 0), (0, pad)), constant_values=np.inf)
    done = ids < 0
    live = np.arange(n)
    while len(live):
        open_ = np.where(done[live], np.inf, dist[live])
        pick = np.argpartition(open_, min(at_once, open_.shape[1]) - 1, axis=1)[:, :at_once]
        good = np.isfinite(np.take_along_axis(open_, pick, 1))
        some = good.any(1)
        live, pick, good = live[some], pick[some], good[some]
        if not len(live):
            break
        done[live[:, None], pick] = True
        nxt = np.where(good[:, :, None], links[ids[live[:, None], pick]], -1).reshape(len(live), -1)
        new, new_dist = fresh(nxt, live)
        all_ids, all_dist = np.concatenate([ids[live], new], 1), np.concatenate([dist[live], new_dist], 1)
        all_done = np.concatenate([done[live], new < 0], 1)
        best = np.argpartition(all_dist, beam - 1, axis=1)[:, :beam]
        ids[live], dist[live], done[live] = (np.take_along_axis(a, best, 1) for a in (all_ids, all_dist, all_done))
    order = np.argsort(dist, axis=1, kind="stable")
    return ids[rows, order], dist[rows, order]


class Layer:
    """Neighbour lists of some points; ids are places in `points`."""

    def __init__(self, points: np.ndarray, links: np.ndarray):
        self.points, self.links = points, links


class SmallWorld:
    """layers[0] holds all points; each further one a random part of the one before."""

    def __init__(self, x: np.ndarray, layers: list[Layer]):
        self.x, self.layers = np.ascontiguousarray(x, np.float32), layers

    @classmethod
    def build(cls, x: np.ndarray, links: int = LINKS, beam: int = BEAM, seed: int = SEED) -> SmallWorld:
        n = len(x)
        level = np.floor(-np.log(1 - np.random.default_rng(seed).random(n)) / np.log(links)).astype(int)
        level[:1] = max(1, level.max(initial=0))
        own = cls(x, [])
        for k in range(int(level.max(initial=0)), -1, -1):
            points = np.flatnonzero(level >= k)
            own.layers.insert(0, Layer(points, np.full((len(points), 2 * links if k == 0 else links), -1, np.int32)))
            own.fill(own.layers[0], links, beam)
        return own

    def fill(self, layer: Layer, most: int, beam: int) -> None:
        # points of the layers above come first, so that searches have somewhere to start from
        above = np.isin(layer.points, self.layers[1].points) if len(self.layers) > 1 else np.zeros(len(layer.points), bool)
        order = np.concatenate([np.flatnonzero(above), np.flatnonzero(~above)])
        x, done = self.x[layer.points], 0
        while done < len(order):
            batch = order[done : done + max(32, min(AT_ONCE, done))]
            near = np.full((len(batch), 0), -1, np.int32)
            if done:
                near, _ = beam_search(layer.links, x, x[batch], self.enter(x[batch], layer, order[:done]), beam)
            near = np.concatenate([near, np.broadcast_to(batch.astype(np.int32), (len(batch), len(batch)))], 1)
            dist = np.where((near < 0) | (near == batch[:, None]), np.inf, 1 - np.matmul(x[near], x[batch][:, :, None])[:, :, 0]).astype(np.float32)
            by = np.argsort(dist, axis=1, kind="stable")[:, :beam]
            near, dist = np.take_along_axis(near, by, 1), np.take_along_axis(dist, by, 1)
            near[np.isinf(dist)] = -1
            chosen = diverse(near, dist, x, most)
            layer.links[batch, : chosen.shape[1]] = chosen
            self.link_back(layer, x, batch, chosen)
            done += len(batch)

    def link_back(self, layer: Layer, x: np.ndarray, batch: np.ndarray, chosen: np.ndarray) -> None:
        to, source = chosen.ravel(), np.repeat(batch, chosen.shape[1])
        to, source = to[to >= 0], source[to >= 0]
        if not len(to):
            return
        by = np.lexsort(((1 - (x[to] * x[source]).sum(1)), to))
        to, source = to[by], source[by]
        first = np.flatnonzero(np.diff(to, prepend=-1))
        place = np.arange(len(to)) - np.repeat(first, np.diff(np.append(first, len(to))))
        width = layer.links.shape[1]
        keep = place < width  # the nearest of those that came at once
        nodes = to[first]
        near = np.concatenate([layer.links[nodes], np.full((len(nodes), width), -1, np.int32)], 1)
        near[np.searchsorted(nodes, to[keep]), width + place[keep]] = source[keep]
        near = np.sort(near, axis=1)
        near[:, 1:][near[:, 1:] == near[:, :-1]] = -1
        dist = np.where(near < 0, np.inf, 1 - np.matmul(x[near], x[nodes][:, :, None])[:, :, 0]).astype(np.float32)
        order = np.argsort(dist, axis=1, kind="stable")
        layer.links[nodes] = diverse(np.take_along_axis(near, order, 1), np.take_along_axis(dist, order, 1), x, width)

    def enter(self, q: np.ndarray, layer: Layer, ready: np.ndarray | None = None) -> np.ndarray:
        """Places in `layer` to start from: what a search down the layers above it finds."""
        above = self.layers[self.layers.index(layer) + 1 :]
        if not above:
            start = 0 if ready is None else ready[0]
            return np.full((len(q), 1), start, np.int32)
        entries = self.enter(q, above[0])
        found, _ = beam_search(above[0].links, self.x[above[0].points], q, entries, 8)
        places = np.searchsorted(layer.points, above[0].points).astype(np.int32)
        found = np.where(found < 0, -1, places[found])
        return found if ready is None else np.where(np.isin(found, ready), found, ready[0]).astype(np.int32)

    def search(self, q: np.ndarray, k: int, beam: int = SEARCH_BEAM) -> np.ndarray:
        """Places of the k nearest points found for each query, by single precision (-1 pads)."""
        out = []
        for at in range(0, len(q), AT_ONCE):
            part = np.ascontiguousarray(q[at : at + AT_ONCE], np.float32)
            out.append(beam_search(self.layers[0].links, self.x, part, self.enter(part, self.layers[0]), max(beam, k))[0][:, :k])
        return np.concatenate(out) if out else np.empty((0, k), np.int32)


_INDEX = "dim int, shard int, vectors binary, ids binary, ends binary, sizes array<int>, points binary, links binary"


def _index(group: pd.DataFrame) -> pd.DataFrame:
    """One row of flat arrays per shard; sizes: points and links per point of each layer."""
    group = group.sort_values("rep")
    x = np.array(group["x"].tolist(), np.float64)
    graph = SmallWorld.build(unit(x).astype(np.float32))
    ids = np.concatenate([np.asarray(v, np.int64) for v in group["ids"]])
    ends = np.cumsum([len(v) for v in group["ids"]])
    flat = lambda a, t: np.ascontiguousarray(a, t).tobytes()
    return pd.DataFrame([{
        "dim": group["dim"].iloc[0], "shard": group["shard"].iloc[0], "vectors": flat(x, np.float64), "ids": flat(ids, np.int64), "ends": flat(ends, np.int64),
        "sizes": [v for layer in graph.layers for v in layer.links.shape],
        "points": b"".join(flat(layer.points, np.int32) for layer in graph.layers), "links": b"".join(flat(layer.links, np.int32) for layer in graph.layers),
    }])


def _packed(group: pd.DataFrame) -> pd.DataFrame:
    group = group.sort_values("vec_id")
    return pd.DataFrame([{"dim": group["dim"].iloc[0], "block": group["block"].iloc[0], "q_ids": group["vec_id"].to_numpy(np.int64).tobytes(), "q_vectors": np.array(group["x"].tolist(), np.float64).tobytes()}])


def _opened(row: dict) -> tuple[SmallWorld, np.ndarray, np.ndarray, np.ndarray]:
    """A shard's graph, vectors of length 1, ids and where each point's ids end."""
    x = unit(np.frombuffer(row["vectors"], np.float64).reshape(-1, row["dim"]))
    points, links, layers, p, k = np.frombuffer(row["points"], np.int32), np.frombuffer(row["links"], np.int32), [], 0, 0
    for n, w in zip(row["sizes"][::2], row["sizes"][1::2], strict=True):
        layers.append(Layer(points[p : p + n], links[k : k + n * w].reshape(n, w)))
        p, k = p + n, k + n * w
    return SmallWorld(x, layers), x, np.frombuffer(row["ids"], np.int64), np.frombuffer(row["ends"], np.int64)


def _searcher(nearest: int, beam: int):
    """Rows in order of shard: its index, then the blocks of queries that it meets."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, shard = None, None
        for batch in batches:
            for row in batch.to_pylist():
                if row["q_ids"] is None:
                    now, shard = (row["dim"], row["shard"]), _opened(row)
                    continue
                if now != (row["dim"], row["shard"]):
                    raise ValueError(f"queries came before shard {row['shard']}")
                graph, unit_x, ids, ends = shard
                q_ids, q = np.frombuffer(row["q_ids"], np.int64), unit(np.frombuffer(row["q_vectors"], np.float64).reshape(-1, row["dim"]))
                found = graph.search(q, max(beam, nearest + 1), beam)
                query, place = np.nonzero(found >= 0)
                place = found[query, place]
                score = (unit_x[place] * q[query]).sum(1)
                sizes = np.diff(ends, prepend=0)[place]
                starts = ends[place] - sizes
                each = np.repeat(np.arange(len(place)), sizes)
                member = ids[starts[each] + np.arange(len(each)) - np.repeat(np.cumsum(sizes) - sizes, sizes)]
                query, score = query[each], score[each]
                other = member != q_ids[query]
                query, member, score = query[other], member[other], score[other]
                order = np.lexsort((member, -score, query))
                query, member, score = query[order], member[order], score[order]
                first = np.searchsorted(query, query, side="left")
                top = np.arange(len(query)) - first < nearest
                yield pa.RecordBatch.from_arrays([pa.array(q_ids[query[top]]), pa.array(member[top]), pa.array(score[top])], ["query_id", "vec_id", "score"])

    return run


def nearest_neighbours(spark: SparkSession, vectors: DataFrame, nearest: int = NEAREST, query_step: int = QUERY_STEP, id_col: str = "vec_id", vector_col: str = "embedding", shard_bytes: int = SHARD_BYTES, beam: int = SEARCH_BEAM) -> DataFrame:
    """query_id, rank (from 1), vec_id, score: the nearest rows by cosine for each row whose id is divisible by query_step.

    Every row is indexed and every query meets every shard; what a shard's search returns is approximate, the score is
    exact (double precision, original vectors), ties go to the smaller id. Null ids, and vectors that are null, empty,
    zero or hold null or non-finite components take no part. Rows with the query's own id aren't its candidates. Vectors
    of another length are not compared. An empty table gives no rows; fewer candidates than `nearest` give fewer rows.
    """
    scratch = Scratch(spark)
    own = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("x"))
    finite = lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) != float("inf"))
    own = own.where(F.col("vec_id").isNotNull() & F.col("x").isNotNull() & F.forall("x", finite) & F.exists("x", lambda v: v != 0))
    rows = scratch.write(own.select("vec_id", "x", F.size("x").alias("dim")), "rows")
    # a query needs `nearest` ids besides its own, and no more of any vector
    least = rows.select("vec_id", "x", "dim").distinct().withColumn("r", F.row_number().over(W.partitionBy("x").orderBy("vec_id"))).where(F.col("r") <= nearest + 1)
    points = scratch.write(least.groupBy("x", "dim").agg(F.array_sort(F.collect_list("vec_id")).alias("ids")).withColumn("rep", F.element_at("ids", 1)), "points")
    shards = points.groupBy("dim").agg(F.ceil(F.count("*") * F.col("dim") * 8 / shard_bytes).cast("int").alias("shards"))
    shards = scratch.write(shards, "shards")
    dealt = points.join(checked_broadcast(shards), "dim").select("dim", F.pmod(F.xxhash64("rep"), F.col("shards")).cast("int").alias("shard"), "rep", "x", "ids")
    index = scratch.write(dealt.groupBy("dim", "shard").applyInPandas(_index, _INDEX), "index")

    asked = rows.where(F.col("vec_id") % query_step == 0).distinct()
    blocks = scratch.write(asked.groupBy("dim").agg(F.ceil(F.count("*") / BLOCK_ROWS).cast("int").alias("blocks")), "blocks")
    asked = asked.join(checked_broadcast(blocks), "dim").withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    packed = scratch.write(asked.select("dim", "block", "vec_id", "x").groupBy("dim", "block").applyInPandas(_packed, "dim int, block int, q_ids binary, q_vectors binary"), "packed")
    # where there are fewer shards than tasks, each goes to several, which share its queries
    total = shards.agg(F.sum("shards")).first()[0] or 1
    lanes = max(1, min(blocks.agg(F.sum("blocks")).first()[0] or 1, LANES or spark.sparkContext.defaultParallelism // total))
    lane = F.pmod(F.col("block"), F.lit(lanes)).cast("int").alias("lane")
    sent = packed.join(checked_broadcast(shards), "dim").select("dim", F.explode(F.sequence(F.lit(0), F.col("shards") - 1)).alias("shard"), lane, "q_ids", "q_vectors")
    held = index.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    key = ["dim", "shard", "lane"]
    met = held.unionByName(sent, allowMissingColumns=True).repartition(max(total * lanes, 1), *key).sortWithinPartitions(*key, F.col("q_ids").isNotNull())
    with settings(spark, {ARROW_ROWS: "4"}):  # a row holds a whole shard
        found = scratch.write(met.mapInArrow(_searcher(nearest, beam), "query_id long, vec_id long, score double"), "found")
    scratch.keep(found)
    best = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    rank = F.row_number().over(W.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return best.withColumn("rank", rank).where(F.col("rank") <= nearest).select("query_id", "rank", "vec_id", "score")


def op4_nearest_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest_neighbours(spark, table(spark, sf_dir, "embeddings"))
