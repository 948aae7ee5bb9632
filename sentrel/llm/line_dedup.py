"""Line dedup by a suffix array over line-id sequences, built by distributed prefix doubling.

Each distinct text is a sequence of line ids; a global prefix sum places the sequences one behind another,
with a gap between. Round k ranks the suffixes by their first 2^k lines, as pairs of ranks of the round
before; prefixes that occur once can't be repeated further on and leave. Two ranks that overlap name a prefix
of any length m, so all suffixes with equal names are the interval of the suffix array whose longest common
prefix is m or more; all members that begin behind the end of its first are later copies.

A maximal repeated run is the union of its shortest parts that are long enough to count: for each line the
shortest such part that starts there and the shortest that ends there. So only one length per line and side
is looked up, and rounds end at the longest of those, whatever the length of the runs.

Two more criteria need no suffixes: whole copies are found by the text's hash, whatever their length, and a
line that stands in many distinct texts counts by itself, however short it is.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import HOT_PART, Scratch, join_by_key, own_columns, small_batches, table
from .sharding import with_prefix_sums

MIN_WORDS = 50
#: Distinct texts from which a line counts by itself.
MIN_TEXTS = 6


def lines_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").split(b"\n")


def shortest_parts(words: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray]:
    """For each line: lines of the shortest part with so many words that starts there, and that ends there; 0: none."""
    n, sums = len(words), np.concatenate([[0], np.cumsum(words)])
    at = np.arange(n)
    end = np.searchsorted(sums, sums[:-1] + least, side="left")
    start = np.searchsorted(sums, sums[1:] - least, side="right") - 1
    return np.where(end <= n, end - at, 0), np.where(start >= 0, at + 1 - start, 0)


def _parsed(least: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out: dict[str, list] = {c: [] for c in ("words", "lo", "hi", "fwd", "back")}
            for text in batch.column("text").to_pylist():
                lines = [x for x in (line.strip() for line in lines_of(text)) if x]
                words = np.fromiter((len(x.split()) for x in lines), np.int64, len(lines))
                fwd, back = shortest_parts(words, least)
                ids = [xxhash.xxh3_128_intdigest(x) for x in lines]
                for c, v in zip(out, (int(words.sum()), [(i & (1 << 64) - 1) - (1 << 63) for i in ids], [(i >> 64) - (1 << 63) for i in ids], fwd, back), strict=True):
                    out[c].append(v)
            types = (pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([batch.column("h"), batch.column("id"), *(pa.array(v, t) for v, t in zip(out.values(), types, strict=True))], ["h", "id", *out])

    return run


def _without(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        texts, lines_n, gone_n = [], [], []
        for text, spans in zip(batch.column("text").to_pylist(), batch.column("spans").to_pylist(), strict=True):
            if text is None:
                texts.append(None), lines_n.append(0), gone_n.append(0)
                continue
            lines = lines_of(text)
            full = [i for i, x in enumerate(lines) if x.strip()]
            mark = np.zeros(len(full) + 1, np.int64)
            for s in spans or ():
                mark[s["at"]] += 1
                mark[min(s["at"] + s["m"], len(full))] -= 1
            gone = {full[i] for i in np.flatnonzero(np.cumsum(mark[:-1]) > 0)}
            texts.append(b"\n".join(x for i, x in enumerate(lines) if i not in gone).decode("utf-8", "surrogatepass") if gone else text)
            lines_n.append(len(full)), gone_n.append(len(gone))
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(lines_n, pa.int64()), pa.array(gone_n, pa.int64())], ["row", "text", "n_lines", "n_removed"])


class _Suffixes:
    """Ranks of suffixes by their first 2^k lines: levels[k] has (gpos, r), for prefixes that occur more than once."""

    def __init__(self, scratch: Scratch, lines: DataFrame):
        """lines: gpos, lo, hi (the line's id)."""
        self.scratch = scratch
        self.levels = [self.ranked(lines, ["lo", "hi"])]

    def ranked(self, rows: DataFrame, key: list[str]) -> DataFrame:
        again = self.scratch.write(rows.groupBy(*key).agg(F.count("*").alias("c")).where("c > 1"), "again")
        ranks, _ = with_prefix_sums(self.scratch, again.withColumn("one", F.lit(1).cast("long")), key, "one")
        ranks = self.scratch.write(ranks.select(*key, "c", (F.col("before") + 1).alias("r")), "ranks")
        level = self.scratch.write(join_by_key(rows, ranks, key, "c").select("gpos", "r"), "level")
        self.scratch.drop(again, ranks)
        return level

    def double(self) -> None:
        last, step = self.levels[-1], 1 << (len(self.levels) - 1)
        right = last.select((F.col("gpos") - step).alias("gpos"), F.col("r").alias("r2"))
        pairs = self.scratch.write(last.join(right, "gpos").select("gpos", F.col("r").alias("r1"), "r2"), "pairs")
        self.levels.append(self.ranked(pairs, ["r1", "r2"]))
        self.scratch.drop(pairs)


def remove_repeated_lines(spark: SparkSession, docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", min_words: int = MIN_WORDS, min_texts: int | None = None, short_copies: bool = False) -> DataFrame:
    """docs and all their columns, with repeated runs of lines deleted from the text, and n_lines, n_removed.

    A line goes if it is in a run of consecutive lines of at least `min_words` words that occurs before: in a
    document of smaller id, or further up without overlapping the run. With `min_texts`, a line that stands in at least so many
    distinct texts goes too wherever it occurs before, whatever its length and neighbours. Lines are compared without white space
    around them; blank lines take no part and stay. A later whole copy of a text of at least `min_words` words loses all its lines,
    with `short_copies` one of any text. Rows of one id and text are one document; texts of one id are
    ordered by MD5. Null texts stay null with 0 lines, null ids come first, columns of docs named n_lines or
    n_removed are replaced, any other names may be there, and an empty table gives no rows.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    own = docs.drop("n_lines", "n_removed")
    text = F.col(text_col).cast("string")
    rest = own_columns(own, text_col)
    keyed = own.select((F.struct(*rest) if rest else F.lit(0)).alias("row"), text.alias("text"), F.md5(text).alias("h"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    texts = keyed.where("text is not null").select("h", "id", "text")
    schema = "h string, id long, words long, lo array<long>, hi array<long>, fwd array<int>, back array<int>"
    parsed = texts.mapInArrow(_parsed(min_words), schema)
    if min_texts is None and not short_copies:
        parsed = parsed.where("words >= %d" % min_words)
    parsed = scratch.write(parsed, "parsed")
    heads = parsed.groupBy("h").agg(F.min("id").alias("id"), F.count("*").alias("rows"), F.min(F.size("lo")).alias("n"), F.min("words").alias("words"))
    placed, _ = with_prefix_sums(scratch, heads.select("id", "h", "rows", "words", (F.col("n") + 1).cast("long").alias("n")), ["id", "h"], "n")
    placed = scratch.write(placed.select("h", F.col("id").alias("first"), "rows", "words", F.col("before").alias("start")), "placed")
    each = parsed.dropDuplicates(["h"]).join(placed.select("h", "start"), "h").select("h", "start", F.posexplode(F.arrays_zip("lo", "hi", "fwd", "back")).alias("i", "x"))
    lines = scratch.write(each.select("h", "i", (F.col("start") + F.col("i")).alias("gpos"), "x.lo", "x.hi", "x.fwd", "x.back"), "lines")
    scratch.drop(parsed)

    suffixes = _Suffixes(scratch, lines.select("gpos", "lo", "hi"))
    repeated = scratch.write(lines.join(suffixes.levels[0], "gpos").select("h", "i", "gpos", "r", "fwd", "back"), "repeated")
    scratch.drop(lines)
    found = []
    if min_texts is not None:
        common = repeated.groupBy("r").agg(F.count_distinct("h").alias("texts"), F.min("gpos").alias("start"), F.count("*").alias("c"))
        common = scratch.write(common.where(F.col("texts") >= min_texts).select("r", "start", "c"), "common")
        found.append(scratch.write(join_by_key(repeated, common, "r", "c").where("gpos > start").select("h", "i", F.lit(1).alias("m")), "later"))
    parts = repeated.select("h", F.explode(F.array(F.struct("i", "gpos", F.col("fwd").alias("m")), F.struct((F.col("i") - F.col("back") + 1).alias("i"), (F.col("gpos") - F.col("back") + 1).alias("gpos"), F.col("back").alias("m")))).alias("p")).select("h", "p.*").where("m > 0").distinct()
    parts = scratch.write(parts, "parts")
    scratch.drop(repeated)
    longest = parts.agg(F.max("m")).first()[0] or 0
    while 2 << (len(suffixes.levels) - 1) <= longest:
        suffixes.double()
    for k, level in enumerate(suffixes.levels):
        here = parts.where(F.col("m").between(1 << k, (2 << k) - 1)).withColumn("gpos2", F.col("gpos") + F.col("m") - (1 << k))
        named = here.join(level.withColumnRenamed("r", "r1"), "gpos").join(level.select(F.col("gpos").alias("gpos2"), F.col("r").alias("r2")), "gpos2")
        named = scratch.write(named.select("h", "i", "gpos", "m", "r1", "r2"), "named")
        interval = scratch.write(named.groupBy("m", "r1", "r2").agg(F.min("gpos").alias("start"), F.count("*").alias("c")).where("c > 1"), "intervals")
        later = join_by_key(named, interval, ["m", "r1", "r2"], "c").where("gpos >= start + m").select("h", "i", "m")
        found.append(scratch.write(later, "later"))
        scratch.drop(named, interval)
    spans = reduce(DataFrame.unionByName, found).groupBy("h").agg(F.collect_list(F.struct(F.col("i").alias("at"), "m")).alias("spans"))
    copied = F.col("rows") if short_copies else F.when(F.col("words") >= min_words, F.col("rows")).otherwise(0)
    changed = scratch.write(placed.select("h", "first", copied.alias("rows")).join(spans, "h", "left").where("rows > 1 or spans is not null"), "changed")
    total = placed.agg(F.sum("rows")).first()[0] or 0
    many = scratch.write(changed.where((F.col("rows") > 1) & (F.col("rows") * HOT_PART > total)).select("h", F.col("first").alias("kept")), "many")
    scratch.keep(changed, many)
    # copies of texts with so many that they could fill a task are marked where they are, the rest, and of those texts the first, by a join
    # that moves texts once, whatever the size: what is changed grows with them
    whole = F.array(F.struct(F.lit(0).alias("at"), F.lit(2**31 - 1).cast("int").alias("m")))
    seen = keyed.join(F.broadcast(many), "h", "left")
    copy = F.col("h").isNotNull() & F.col("kept").isNotNull() & (F.col("id") != F.col("kept"))
    still = seen.where(F.col("h").isNull() | copy).select("row", "text", F.when(copy, whole).alias("spans"))
    moved = seen.where(F.col("h").isNotNull() & ~copy).join(changed.hint("merge"), "h", "left")
    moved = moved.select("row", "text", F.when((F.col("id") != F.col("first")) & (F.col("rows") > 1), whole).otherwise(F.col("spans")).alias("spans"))
    marked = still.unionByName(moved)
    out = marked.mapInArrow(_without, T.StructType([marked.schema["row"], T.StructField("text", T.StringType()), T.StructField("n_lines", T.LongType()), T.StructField("n_removed", T.LongType())]))
    return out.select(*[F.col("text").alias(c) if c == text_col else F.col("row")[c].alias(c) for c in own.columns], "n_lines", "n_removed")


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return remove_repeated_lines(spark, docs, min_texts=MIN_TEXTS, short_copies=True).select("doc_id", "n_lines", "n_removed", "text")
