"""N-gram Jaccard self-join by parity sketches.

A document's set of word shingles is hashed to 64 bits and cut, by hash range, into k blocks. The
XOR of a block's hashes is a sparse parity sketch: two sets that differ in d shingles differ in at
most d blocks, so with more than d blocks some block agrees (pigeonhole). k depends on the size
band, and bands overlap by the largest size ratio that the similarity allows. Blocks have one global
order, fullest first, and a set only ships the first d + 1 of them: two sets that agree in a block agree in
one that both ship. Pairs that share a block are pruned by the Hamming distance of dense 1024-bit parity
sketches, a lower bound of the symmetric difference, and the rest is verified on the whole sets.

Frequent blocks (common passages, large groups of copies) never emit all pairs. They meet in rounds: in each
frequent block a central document is held against the rest until a block's documents are in one
component; what is left is joined across components, where blocks are large on the rarest shingles of each set.
Blocks that a sixteenth of the documents shows to be frequent don't go through the sort that finds the rare
ones, so no task gets a hot block whole; which blocks these are changes the plan, not the result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from .common import HOT_PART, Scratch, checked_broadcast, components, join_by_key, own_columns, small_batches, table

WORDS, PERCENT = 5, 80
RARE = 3  # documents that share a block, up to which all their pairs are emitted
SKETCH_BITS = 1024
LOOKED_AT, HOT_FROM = 16, 16  # one in so many documents shows which blocks are hot: those that so many of them share
ROUNDS = 12
WORTH = 20  # pairs tried per link found, from which rounds end
FEW_PAIRS = 100_000  # pairs across components in frequent blocks, up to which they are joined at once
MANY_PAIRS = 8  # pairs per row of frequent blocks, from which what is left is joined on rare shingles instead
CELL_ROWS = 2_000  # rows of one key that a cell of the last join holds, at either side
_ODD = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD)]


def _mix(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * _ODD[3]
    h = (h ^ (h >> np.uint64(29))) * _ODD[4]
    return h ^ (h >> np.uint64(32))


def shingle_hashes(text: str | None, n: int = WORDS) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the text's n-word shingles; its whole sequence if it is shorter."""
    words = text.encode("utf-8", "surrogatepass").lower().split() if text else []
    if not words:
        return np.empty(0, np.uint64)
    h = _mix(np.fromiter(map(xxhash.xxh3_64_intdigest, words), np.uint64, len(words)))
    n_here = min(n, len(words))
    out = np.full(len(words) - n_here + 1, n_here, np.uint64)
    for i in range(n_here):
        out = (out * _ODD[0] + h[i : len(h) - n_here + 1 + i]) ^ (out >> np.uint64(31))
    return np.unique(_mix(out))


def most_apart(size: int, percent: int = PERCENT, largest: int | None = None) -> int:
    """Largest symmetric difference that a set of this size has with any linked one (of at most `largest` shingles)."""
    other = size * 100 // percent
    other = other if largest is None else min(other, largest)
    return (size + other) * (100 - percent) // (100 + percent)


def bands(size: int, percent: int = PERCENT) -> list[int]:
    """The band of a size (band 0: under 8, then doubling) and the next one if partners may be there."""
    own = max(0, size.bit_length() - 3)
    return [own] + [own + 1] * (max(0, (size * 100 // percent).bit_length() - 3) > own)


def band_blocks(band: int, percent: int = PERCENT) -> int:
    top = 8 << band
    return 2 * (top - 1) * (100 - percent) // (100 + percent) + 4 + int((top / 2) ** 0.5)


def block_signatures(hashes: np.ndarray, percent: int = PERCENT) -> list[tuple[int, np.ndarray]]:
    """For each band: (band, signatures of the first blocks). Linked sets have one of them in common in every band that they share.

    Blocks that hold something are ordered by their number of hashes, then by signature, and as many are taken as
    the largest symmetric difference with a partner of the band, and one more. Partners above the band meet in the next.
    """
    out = []
    for band in bands(len(hashes), percent):
        k = band_blocks(band, percent)
        block = ((hashes >> np.uint64(32)) * np.uint64(k)) >> np.uint64(32)
        starts = np.flatnonzero(np.diff(block, prepend=np.uint64(k)))
        held, size = np.bitwise_xor.reduceat(hashes, starts), np.diff(np.append(starts, len(hashes))).astype(np.uint64)
        salt = block[starts] * _ODD[0] + size * _ODD[4] + np.array([band + 1], np.uint64) * _ODD[1]
        sig = _mix(held ^ _mix(salt))[held != 0]
        first = most_apart(len(hashes), percent, (8 << band) - 1) + 1
        if len(sig) < first:  # what agrees may be empty blocks only: such documents of a band meet here
            sig = np.append(sig, _mix(np.array([band + 1], np.uint64) * _ODD[2]))
        else:
            sig = sig[np.lexsort((sig, -size[held != 0].astype(np.int64)))[:first]]
        out.append((band, sig))
    return out


def parity_sketch(hashes: np.ndarray, bits: int = SKETCH_BITS) -> np.ndarray:
    """The XOR of the halves of a sketch is the sketch of half the bits."""
    odd = np.bincount((hashes & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64)


def fine_bits(n: int) -> int:
    """Eight bits or more per shingle: so long a sketch tells nearly all pairs apart that are no links, at an eighth of the set's size."""
    return max(SKETCH_BITS, 8 << max(0, n - 1).bit_length())


_LONGS = pa.list_(pa.int64())


def _sketches(n: int, percent: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x, n) for x in batch.column("text").to_pylist()]
            sigs = [np.concatenate([x for _, x in block_signatures(s, percent)]).view(np.int64) if len(s) else np.empty(0, np.int64) for s in sets]
            yield pa.RecordBatch.from_arrays(
                [batch.column("h"), batch.column("id"), pa.array([len(x) for x in sets], pa.int64()), pa.array(sigs, _LONGS), pa.array([parity_sketch(x) for x in sets], _LONGS)], ["h", "id", "n", "sigs", "sketch"]
            )

    return run


def _sets(n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            sets = [shingle_hashes(x, n) for x in batch.column("text").to_pylist()]
            fine = [parity_sketch(x, fine_bits(len(x))) for x in sets]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array([x.view(np.int64) for x in sets], _LONGS), pa.array(fine, _LONGS)], ["id", "shingles", "fine"])

    return run


class _Join:
    def __init__(self, spark: SparkSession, docs: DataFrame, id_col: str, text_col: str, n: int, percent: int):
        small_batches(spark)
        self.spark, self.scratch, self.n, self.percent = spark, Scratch(spark), n, percent
        self.docs = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text")).withColumn("h", F.md5(F.coalesce("text", F.lit(""))))

    def near(self, na: str, nb: str, both: str):
        return F.expr(f"100 * {both} >= {self.percent} * ({na} + {nb} - {both})")

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(per row: id, h, n, component), (links between different texts: a, b)."""
        s = self.scratch
        rows = s.write(self.docs.select("id", "h"), "rows")
        reps = s.write(rows.groupBy("h").agg(F.min("id").alias("rep"), F.count("*").alias("rows")), "reps")
        # an id may stand for one text and be a copy of another: only its copies go
        copies = join_by_key(rows, reps, "h", "rows").where("id <> rep").select("h", "id").distinct()
        copies = s.write(copies, "copies")
        firsts = self.docs.join(checked_broadcast(copies), ["h", "id"], "left_anti")
        sketches = s.write(firsts.mapInArrow(_sketches(self.n, self.percent), "h string, id long, n long, sigs array<long>, sketch array<long>"), "sketches")
        counts = s.write(sketches.select("h", "id", "n", "sketch"), "counts")
        links = self.links(sketches, counts)
        comp = components(s, links)
        counts = counts.groupBy("h").agg(F.max("n").alias("n"))
        named = reps.join(comp, F.col("rep") == F.col("id"), "left").select("h", "rep", "rows", F.coalesce("component", "rep").alias("component"))
        by_text = s.write(named.join(counts, "h", "left"), "by_text")
        # a text's rows with an id are one group; an id with several texts joins their groups
        many = join_by_key(rows.where("id is not null"), by_text, "h", "rows").groupBy("id").agg(F.min("component").alias("lo"), F.max("component").alias("hi")).where("lo <> hi")
        many = s.write(many, "many")
        if many.take(1):
            more = many.select(F.col("lo").alias("a"), F.col("hi").alias("b"))
            spread = join_by_key(rows.join(many.select("id"), "id"), by_text, "h", "rows").select(F.col("id").alias("a"), F.col("component").alias("b"))
            comp = components(s, links.unionByName(more).unionByName(spread))
            named = by_text.drop("component").join(comp, F.col("rep") == F.col("id"), "left").select("h", "rows", "n", F.coalesce("component", "rep").alias("component"))
            by_text = s.write(named, "by_text")
        out = join_by_key(rows, by_text.select("h", "rows", "n", "component"), "h", "rows").select("id", "h", F.coalesce("n", F.lit(0)).alias("n"), F.when((F.col("n") > 0) & F.col("id").isNotNull(), F.col("component")).otherwise(F.col("id")).alias("component"))
        out = s.write(out, "groups")
        s.keep(out, links)
        return out, links

    def blocks(self, sketches: DataFrame) -> tuple[DataFrame, DataFrame]:
        """(a, b of documents that share a rare block; sig, id, m of the blocks that more than RARE documents share)."""
        s = self.scratch
        sketches = sketches.where("id is not null")
        sigs = sketches.select("id", F.explode("sigs").alias("sig"))
        seen = sketches.where(F.pmod(F.xxhash64("h"), F.lit(LOOKED_AT)) == 0).select(F.explode("sigs").alias("sig"))
        some = s.write(seen.groupBy("sig").agg(F.count("*").alias("c")).where(F.col("c") >= HOT_FROM), "some")
        least = max(HOT_FROM, (some.agg(F.sum("c")).first()[0] or 0) // HOT_PART + 1)
        hot = s.write(some.where(F.col("c") >= least).select("sig"), "hot")  # fewer than HOT_PART rows
        w = W.partitionBy("sig").orderBy("id")
        whole = w.rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
        others = sigs.join(F.broadcast(hot), "sig", "left_anti")
        shared = others.select("sig", "id", F.count("*").over(whole).alias("m"), F.lead("id", 1).over(w).alias("next1"), F.lead("id", 2).over(w).alias("next2")).where("m > 1")
        shared = s.write(shared, "shared")
        pairs = shared.where(F.col("m") <= RARE).select(F.col("id").alias("a"), F.explode(F.array("next1", "next2")).alias("b")).where("a < b").distinct()
        pairs = s.write(pairs, "pairs")
        frequent = shared.where(F.col("m") > RARE).select("sig", "id", "m")
        if hot.take(1):
            at_hot = s.write(sigs.join(F.broadcast(hot), "sig", "left_semi"), "at_hot")
            sizes = s.write(at_hot.groupBy("sig").agg(F.count("*").alias("m")), "sizes")
            frequent = frequent.unionByName(at_hot.join(F.broadcast(sizes), "sig").select("sig", "id", "m"))
        frequent = s.write(frequent, "frequent")
        s.drop(shared)
        return pairs, frequent

    def links(self, sketches: DataFrame, counts: DataFrame) -> DataFrame:
        s = self.scratch
        pairs, frequent = self.blocks(sketches)
        s.drop(sketches)
        one = counts.where("id is not null").select("id", "n", "sketch")
        rare = s.write(self.close(pairs, one), "rare")
        s.drop(pairs)
        central = s.write(frequent.groupBy("id").agg(F.avg("m").alias("central")), "central")
        need = s.write(rare.select(F.explode(F.array("a", "b")).alias("id")).unionByName(central.select("id")).distinct(), "need")
        texts = self.docs.select("id", "text").join(checked_broadcast(need), "id", "left_semi")
        sets = s.write(texts.mapInArrow(_sets(self.n), "id long, shingles array<long>, fine array<long>"), "sets")
        links = s.write(self.verified(rare, sets), "links")
        one = s.write(one.join(checked_broadcast(need), "id", "left_semi"), "one")
        start = components(s, links)
        first = s.write(central.join(start, "id", "left").select("id", "central", F.coalesce("component", "id").alias("comp")), "first")
        named = s.write(frequent.join(checked_broadcast(first), "id").select("sig", "id", "comp", "central"), "named")
        open_ = self.unfinished(named, F.col("central"))
        s.drop(frequent, rare, need, central, start, first, named)
        tried, found_in = None, [links]
        for k in range(1, ROUNDS + 2):
            sizes = self.sizes(open_)
            if not sizes["rows"]:
                return s.write(reduce(DataFrame.unionByName, found_in), "links")
            if k > ROUNDS or sizes["pairs"] <= max(FEW_PAIRS, 2 * sizes["rows"]):
                break
            pick = open_.where("comp <> lead_comp").select(F.least("id", "lead").alias("a"), F.greatest("id", "lead").alias("b")).distinct()
            if tried is not None:
                pick = pick.join(tried, ["a", "b"], "left_anti")
            pick = s.write(pick, "pick")
            tried = pick if tried is None else tried.unionByName(pick)
            close = s.write(self.close(pick, one), "close")
            found = s.write(self.verified(close, sets), "found")
            s.drop(close)
            linked, worth = found.count(), pick.count() / WORTH
            if linked:
                found_in.append(found)
                named = s.write(open_.select("id", "comp").distinct(), "named")
                joined = found.join(named.select(F.col("id").alias("a"), F.col("comp").alias("ca")), "a").join(named.select(F.col("id").alias("b"), F.col("comp").alias("cb")), "b").select(F.col("ca").alias("a"), F.col("cb").alias("b")).distinct()
                moved = components(s, joined)
                renamed = s.write(open_.join(checked_broadcast(moved.select(F.col("id").alias("comp"), "component")), "comp", "left").select("sig", "id", F.coalesce("component", "comp").alias("comp")), "renamed")
                before, open_ = open_, self.unfinished(renamed, F.xxhash64("id", F.lit(k)))
                s.drop(before, named, moved, renamed)
            if linked < worth or not linked:
                sizes = self.sizes(open_)
                if not sizes["rows"]:
                    return s.write(reduce(DataFrame.unionByName, found_in), "links")
                break
        direct = sizes["pairs"] <= MANY_PAIRS * sizes["rows"]
        keys = s.write(open_.select("id", "comp", F.col("sig").alias("key")) if direct else self.rarest_shingles(open_.select("id", "comp").distinct(), sets), "keys")
        rest = s.write(self.across(keys, one), "rest")
        found_in.append(self.verified(rest, sets))
        return s.write(reduce(DataFrame.unionByName, found_in).distinct(), "links")

    def sizes(self, open_: DataFrame):
        """Rows of unfinished blocks, and pairs in them."""
        return open_.agg(F.count("*").alias("rows"), F.coalesce(F.sum((F.col("m") - 1) / 2), F.lit(0.0)).alias("pairs")).first()

    def close(self, pairs: DataFrame, one: DataFrame) -> DataFrame:
        """Pairs that sizes and the dense sketches don't rule out."""
        of = lambda x: one.select(F.col("id").alias(x), F.col("n").alias(f"n{x}"), F.col("sketch").alias(f"s{x}"))
        apart = F.aggregate(F.zip_with("sa", "sb", lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda t, x: t + x)
        near = self.near("na", "nb", "least(na, nb)") & (apart * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent))
        return pairs.join(of("a"), "a").join(of("b"), "b").where(near).select("a", "b")

    def across(self, keys: DataFrame, one: DataFrame) -> DataFrame:
        """Pairs of different components that share a key and that sizes and sketches don't rule out; no others leave the join.

        A key's rows are dealt to parts of about CELL_ROWS, and two parts meet in a cell of their own, so that no task gets a hot key whole.
        """
        s = self.scratch
        sizes = s.write(keys.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "sizes")
        full = s.write(join_by_key(keys, sizes, "key", "m").join(one, "id"), "full")
        parts = F.ceil(F.col("m") / CELL_ROWS).cast("int")
        dealt = full.withColumns({"parts": parts, "part": F.pmod(F.xxhash64("id"), parts).cast("int")})
        x = dealt.withColumn("other", F.explode(F.sequence(F.col("part"), F.col("parts") - 1))).withColumnRenamed("part", "own").alias("x")
        y = dealt.withColumn("own", F.explode(F.sequence(F.lit(0), F.col("part")))).withColumnRenamed("part", "other").alias("y")
        apart = " + ".join(f"bit_count(x.sketch[{i}] ^ y.sketch[{i}])" for i in range(SKETCH_BITS // 64))
        near = F.expr(f"100 * least(x.n, y.n) >= {self.percent} * greatest(x.n, y.n) AND ({apart}) * {100 + self.percent} <= (x.n + y.n) * {100 - self.percent}")
        same = [F.col(f"x.{c}") == F.col(f"y.{c}") for c in ("key", "own", "other")]
        once = (F.col("x.own") < F.col("x.other")) | (F.col("x.id") < F.col("y.id"))
        met = x.join(y, reduce(Column.__and__, same) & once & (F.col("x.comp") != F.col("y.comp")) & near)
        return met.select(F.least("x.id", "y.id").alias("a"), F.greatest("x.id", "y.id").alias("b")).distinct()

    def rarest_shingles(self, ids: DataFrame, sets: DataFrame) -> DataFrame:
        """id, comp, key: so many of each set's rarest shingles that linked sets share one (the prefix filter).

        Documents that share most of a long passage, but too little to link, agree in many blocks; what is rarest in them is their own.
        """
        ids = self.scratch.write(ids, "ids")
        own = sets.join(checked_broadcast(ids), "id").select("id", "comp", F.xxhash64("shingles").alias("set"), F.size("shingles").alias("n"), "shingles")
        each = own.select("id", "comp", "set", "n", F.explode("shingles").alias("key"))  # not in one step: what stands beside explode is made for every row
        each = self.scratch.write(each, "shingles")
        often = self.scratch.write(each.groupBy("key").agg(F.count("*").alias("m")).where("m > 1"), "often")
        rank = F.row_number().over(W.partitionBy("id", "set").orderBy("m", "key"))
        # shingles of one document come first and have no partner
        shared = join_by_key(each, often, "key", "m").withColumn("r", rank).withColumn("own", F.col("n") - F.count("*").over(W.partitionBy("id", "set")))
        return shared.where(F.expr(f"r + own <= n - ({self.percent} * n + 99) div 100 + 1")).select("id", "comp", "key")

    def unfinished(self, named: DataFrame, order: Column) -> DataFrame:
        """Rows of frequent blocks whose documents are not yet in one component, with the block's size and the document of highest order."""
        lead = F.max(F.struct(order.alias("o"), (-F.col("id")).alias("neg"), F.col("comp").alias("c"))).alias("p")
        split = named.groupBy("sig").agg(F.count("*").alias("m"), F.min("comp").alias("lo"), F.max("comp").alias("hi"), lead).where("lo <> hi")
        split = self.scratch.write(split.select("sig", "m", (-F.col("p.neg")).alias("lead"), F.col("p.c").alias("lead_comp")), "split")
        out = self.scratch.write(join_by_key(named.select("sig", "id", "comp"), split, "sig", "m"), "open")
        self.scratch.drop(split)
        return out

    def verified(self, pairs: DataFrame, sets: DataFrame) -> DataFrame:
        """Pairs (a written table) whose whole sets are near enough. Only sets of documents in a pair are moved."""
        half = lambda x, m: F.when(F.size(x) > m, F.zip_with(F.slice(x, 1, m), F.slice(x, m + 1, m), lambda u, v: u.bitwiseXOR(v))).otherwise(F.col(x))
        least = F.least(F.size("fa"), F.size("fb"))
        apart = F.aggregate(F.zip_with(half("fa", least), half("fb", least), lambda u, v: F.bit_count(u.bitwiseXOR(v))), F.lit(0), lambda t, u: t + u)
        fine = lambda x: held.select(F.col("id").alias(x), F.size("shingles").alias(f"n{x}"), F.col("fine").alias(f"f{x}"))
        held = self.asked(sets, pairs)
        maybe = pairs.join(fine("b"), "b").join(fine("a"), "a").where((F.size("fa") > 2 * F.size("fb")) | (F.size("fb") > 2 * F.size("fa")) | (apart * (100 + self.percent) <= (F.col("na") + F.col("nb")) * (100 - self.percent)))
        pairs = self.scratch.write(maybe.select("a", "b").distinct(), "maybe")
        held = self.asked(sets, pairs)
        whole = lambda x: held.select(F.col("id").alias(x), F.col("shingles").alias(f"s{x}"))
        both = pairs.join(whole("b"), "b").join(whole("a"), "a").select("a", "b", F.size("sa").alias("na"), F.size("sb").alias("nb"), F.size(F.array_intersect("sa", "sb")).alias("both"))
        return both.where(self.near("na", "nb", "both")).select("a", "b").distinct()

    def asked(self, sets: DataFrame, pairs: DataFrame) -> DataFrame:
        """Sets of documents in a pair: no others are moved."""
        ids = self.scratch.write(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "asked")
        return sets.join(checked_broadcast(ids), "id", "left_semi")


def ngram_jaccard_join(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", words: int = WORDS, percent: int = PERCENT) -> tuple[DataFrame, DataFrame]:
    """Near-duplicate groups over whole texts, exact at `percent` Jaccard of `words`-word shingles.

    Returns (groups, links). groups has one row per input row: id, h (MD5 of the text), n (distinct
    shingles), component (smallest id reachable by links). links has pairs (a, b) of ids of different
    texts, a < b: enough verified links to connect each group.

    Null or blank texts have no shingles and link with nothing. Rows without an id link with nothing
    (component null). Rows that repeat an id are one document: their texts' groups are one. An empty
    table gives empty tables. Other columns of docs are not read.
    """
    return _Join(spark, docs, id_col, text_col, words, percent).run()


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    groups, _ = ngram_jaccard_join(spark, table(spark, sf_dir, "documents"))
    return groups.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.col("component").alias("component_id"))


def first_of_each_group(spark: SparkSession, docs: DataFrame) -> DataFrame:
    """docs without the near copies: of each group the row of the smallest doc_id stays, once."""
    join = _Join(spark, docs, "doc_id", "text", WORDS, PERCENT)
    (groups, _), scratch = join.run(), join.scratch
    gone = scratch.write(groups.where("n > 0 and id <> component").select(F.col("id").alias("doc_id")).distinct(), "gone")
    kept = docs.join(checked_broadcast(gone), "doc_id", "left_anti").select(*own_columns(docs))
    repeated = scratch.write(groups.where("id is not null and n > 0").groupBy("id").agg(F.count("*").alias("k")).where("k > 1").select(F.col("id").alias("doc_id")), "repeated")
    scratch.keep(gone, repeated)
    if not repeated.take(1):
        return kept
    repeated = checked_broadcast(repeated)
    return kept.join(repeated, "doc_id", "left_anti").select(*own_columns(docs)).union(kept.join(repeated, "doc_id", "left_semi").select(*own_columns(docs)).dropDuplicates(["doc_id"]))


ORACLE = """
WITH RECURSIVE d AS (SELECT doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x20\\x09-\\x0D]+') AS w FROM documents),
s AS (SELECT DISTINCT doc_id, hash(array_to_string(w[i:i + 4], ' ')) AS g FROM (SELECT doc_id, w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS i FROM d WHERE len(w) > 0)),
n AS (SELECT doc_id, count(*) AS n FROM s GROUP BY doc_id),
p AS (SELECT x.doc_id AS a, y.doc_id AS b, count(*) AS c FROM s x JOIN s y ON x.g = y.g AND x.doc_id < y.doc_id GROUP BY ALL),
l AS (SELECT a, b FROM p JOIN n na ON na.doc_id = a JOIN n nb ON nb.doc_id = b WHERE 100 * c >= 80 * (na.n + nb.n - c)),
e AS (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r(id, m) AS (SELECT DISTINCT a, a FROM e UNION SELECT e.b, r.m FROM r JOIN e ON e.a = r.id AND r.m < e.b)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_shingles, least(doc_id, coalesce(m, doc_id)) AS component_id
FROM d LEFT JOIN n USING (doc_id) LEFT JOIN (SELECT id, min(m) AS m FROM r GROUP BY id) c ON c.id = doc_id
"""
