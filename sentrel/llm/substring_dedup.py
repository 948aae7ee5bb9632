"""Substring dedup by Rabin-Karp hashes of every window of 20 words, counted in Spark.

Documents are sorted by id into ranges and written in chunks of a few MB, so that an earlier chunk holds earlier
documents only. A chunk's windows are hashed together (prefix sums of a polynomial, so a window costs a subtraction
and a product whatever its length) and leave it as distinct narrow rows (hash, chunk). For each hash Spark finds the first
chunk; every other chunk that holds it is told so. What repeats inside a chunk, the chunk sees by itself. Windows that
start earlier somewhere mark their words, and overlapping ones merge into maximal removal intervals.

A frequent window leaves each chunk once, however many of its documents hold it, and only texts of one chunk
are together in a task.
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
from pyspark.sql import Window as W

from sentrel.scratch import settings

from .common import Scratch, own_columns, small_batches, table

WORDS = 20
CHUNK_BYTES = 4 << 20  # of UTF-8 text; a longer text is a chunk of its own
BASES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)  # odd, so that powers have inverses modulo 2^64
SLICES = 2  # of the hash space, counted one after another: texts are hashed for each, but only one slice's rows are on disk
CHECK = 24  # bits of the second hash, beside the chunk in one long: 20 for the partition, 20 for the chunk in it
SPAN = T.StructType([T.StructField("start", T.IntegerType()), T.StructField("end", T.IntegerType())])


def _powers(base: int, n: int) -> np.ndarray:
    out = np.full(n, base & (2**64 - 1), np.uint64)
    out[:1] = 1
    return np.multiply.accumulate(out)


def rolling(words: np.ndarray, k: int, base: int) -> np.ndarray:
    """Of each k consecutive hashes (unsigned 64 bits) the polynomial in base modulo 2^64."""
    n = len(words)
    sums = np.concatenate([np.zeros(1, np.uint64), np.cumsum(words * _powers(base, n), dtype=np.uint64)])
    return (sums[k:] - sums[:-k]) * _powers(pow(base, -1, 2**64), n - k + 1)


def in_order(h: np.ndarray, check: np.ndarray) -> np.ndarray:
    """Places by hash; equal pairs are neighbours and keep their order."""
    order = np.argsort(h, kind="stable")
    a, b = h[order], check[order]
    return np.lexsort((check, h)) if ((a[1:] == a[:-1]) & (b[1:] != b[:-1])).any() else order


class Chunk:
    """Words and windows of some texts, one behind another. h, check: a window's hash of 64 bits and another of CHECK bits; at: its first word."""

    def __init__(self, texts: list[bytes | None], k: int):
        self.words, self.k = [(t or b"").split() for t in texts], k
        self.sizes = np.array([len(w) for w in self.words], np.int64)
        self.starts = np.concatenate([[0], np.cumsum(self.sizes)])
        n = int(self.starts[-1])
        w = np.fromiter((xxhash.xxh64_intdigest(x) for ws in self.words for x in ws), np.uint64, n)
        if n < k:
            self.at, self.h, self.check = np.zeros(0, np.int64), np.zeros(0, np.uint64), np.zeros(0, np.uint64)
            return
        own = np.repeat(np.arange(len(texts)), self.sizes)
        at = np.arange(n - k + 1)
        self.at = at[own[: n - k + 1] == own[k - 1 :]]  # not over the end of a text
        self.h = rolling(w, k, BASES[0])[self.at]
        other = w ^ (w >> np.uint64(29))
        self.check = rolling(other * other, k, BASES[1])[self.at] >> np.uint64(64 - CHECK)

    def distinct(self, piece: int, pieces: int) -> tuple[np.ndarray, np.ndarray]:
        """The windows of one slice of the hash space, each once."""
        mine = (self.h >> np.uint64(48)) % np.uint64(pieces) == piece
        h, c = self.h[mine], self.check[mine]
        order = in_order(h, c)
        h, c = h[order], c[order]
        new = np.ones(len(h), bool)
        new[1:] = (h[1:] != h[:-1]) | (c[1:] != c[:-1])
        return h[new], c[new]

    def removed(self, h: np.ndarray, check: np.ndarray) -> np.ndarray:
        """For each word whether it goes: h, check are the windows that stand in an earlier chunk."""
        at = np.concatenate([np.full(len(h), -1), self.at])  # what is earlier comes first
        h, c = np.concatenate([h, self.h]), np.concatenate([check, self.check])
        order = in_order(h, c)
        h, c, at = h[order], c[order], at[order]
        again = np.zeros(len(h), bool)
        again[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        gone = at[again & (at >= 0)]
        mark = np.zeros(int(self.starts[-1]) + 1, np.int64)
        np.add.at(mark, gone, 1)
        np.add.at(mark, gone + self.k, -1)
        return np.cumsum(mark[:-1]) > 0


def _numbered(chunk_bytes: int):
    """Rows of a sorted partition with the chunk that they are in: the partition's number, then that of the chunk."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        size, chunk = 0, 0
        for batch in batches:
            out = []
            for part, n in zip(batch.column("part").to_pylist(), batch.column("n").to_pylist(), strict=True):
                if size and size + n > chunk_bytes:
                    size, chunk = 0, chunk + 1
                size += n
                out.append((part << 20) + chunk)
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.int64()), batch.column("row"), batch.column("text")], ["chunk", "row", "text"])

    return run


def _windows(k: int, piece: int):
    """Distinct windows of each chunk whose hash is in a slice: h, and in `at` the chunk before the check."""

    def rows(chunk: int, texts: list[bytes | None]) -> Iterator[pa.RecordBatch]:
        h, check = Chunk(texts, k).distinct(piece, SLICES)
        at = (np.int64(chunk) << np.int64(CHECK)) | check.astype(np.int64)
        for i in range(0, len(h), 1 << 16):
            yield pa.RecordBatch.from_arrays([pa.array(h[i : i + (1 << 16)].view(np.int64)), pa.array(at[i : i + (1 << 16)])], ["h", "at"])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        now, texts = None, []
        for batch in batches:
            for chunk, text in zip(batch.column("chunk").to_pylist(), batch.column("text").to_pylist(), strict=True):
                if chunk != now and texts:
                    yield from rows(now, texts)
                    texts = []
                now = chunk
                texts.append(text)
        if texts:
            yield from rows(now, texts)

    return run


def _kept(k: int):
    spans_type = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32())]))

    def run(docs: pa.Table, told: pa.Table) -> pa.Table:
        texts = docs.column("text").to_pylist()
        chunk = Chunk(texts, k)
        at = told.column("at").to_numpy()
        gone = chunk.removed(told.column("h").to_numpy().view(np.uint64), (at & np.int64((1 << CHECK) - 1)).astype(np.uint64))
        out, spans, n_gone = [], [], []
        for text, words, start in zip(texts, chunk.words, chunk.starts, strict=False):
            g = gone[start : start + len(words)]
            edges = np.flatnonzero(np.diff(np.concatenate([[0], g, [0]]))).reshape(-1, 2).tolist()
            spans.append([{"start": a, "end": b} for a, b in edges])
            n_gone.append(int(g.sum()))
            out.append(None if text is None else b" ".join(w for w, x in zip(words, g.tolist(), strict=True) if not x) if edges else b" ".join(words))
        columns = [docs.column("row"), pa.array(out, pa.binary()), pa.array(chunk.sizes), pa.array(n_gone, pa.int64()), pa.array(spans, spans_type)]
        return pa.table(columns, ["row", "text", "n_words", "n_removed", "spans"])

    return run


def remove_repeated_windows(spark: SparkSession, docs: DataFrame, words: int = WORDS, id_col: str = "doc_id", text_col: str = "text", chunk_bytes: int = CHUNK_BYTES) -> DataFrame:
    """docs and all their columns, with the text's words (joined by one space) that no earlier text has in a window, and n_words,
    n_removed (long) and spans (the removed words as maximal intervals, counted from 0, end exclusive).

    Words are runs of anything but ASCII white space, compared byte by byte. A word goes if a window of `words` words that covers it
    also starts earlier: in a document of smaller id, or further up in its own, overlapping or not. Windows are judged on the input, so a
    removal never hides another. Texts of fewer words have no window and stay whole, but for white space. Documents of one id are ordered by
    a hash of the text, repeated rows as they come, so one of them stays; null ids come first. A null text stays null with no words, an
    empty one empty; columns of docs named n_words, n_removed or spans are replaced, any other names may be there, and an empty table
    gives no rows. Hashes have 88 bits in all.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    own = docs.drop("n_words", "n_removed", "spans")
    text, rest = F.col(text_col).cast("string"), own_columns(own, text_col)
    row = (F.struct(*rest) if rest else F.lit(0)).alias("row")
    rows = own.select(row, text.cast("binary").alias("text"), F.col(id_col).alias("id"), F.xxhash64(text).alias("order"), F.coalesce(F.octet_length(text), F.lit(0)).alias("n"))
    parts = max(1, int(spark.conf.get("spark.sql.shuffle.partitions")))
    ranged = rows.repartitionByRange(parts, F.asc_nulls_first("id"), "order").withColumn("part", F.spark_partition_id()).sortWithinPartitions(F.asc_nulls_first("id"), "order")
    row_field = ranged.select("row").schema.fields[0]
    schema = T.StructType([T.StructField("chunk", T.LongType()), row_field, T.StructField("text", T.BinaryType())])
    with settings(spark, {"spark.sql.parquet.compression.codec": "zstd"}):
        chunks = scratch.write(ranged.select("part", "n", "row", "text").mapInArrow(_numbered(chunk_bytes), schema), "chunks")

    first = F.min("chunk").over(W.partitionBy("h", "check"))
    told = []
    for piece in range(SLICES):
        found = chunks.select("text", "chunk").mapInArrow(_windows(words, piece), "h long, at long").repartition("h")
        found = found.withColumn("check", F.col("at").bitwiseAND(F.lit((1 << CHECK) - 1))).withColumn("chunk", F.shiftright("at", CHECK))
        told.append(scratch.write(found.withColumn("first", first).where("chunk > first").select("h", "at", "chunk"), "told"))
    told = reduce(DataFrame.unionByName, told)

    out = T.StructType([row_field, *[T.StructField(n, t) for n, t in (("text", T.BinaryType()), ("n_words", T.LongType()), ("n_removed", T.LongType()), ("spans", T.ArrayType(SPAN)))]])
    kept = chunks.groupBy("chunk").cogroup(told.groupBy("chunk")).applyInArrow(_kept(words), out)
    field = lambda c: F.col("row").getField(c).alias(c)
    back = [F.col("text").cast("string").alias(c) if c == text_col else field(c) for c in own.columns]
    return kept.select(*back, "n_words", "n_removed", "spans")


def op11_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    kept = F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256")
    return remove_repeated_windows(spark, docs).select("doc_id", "n_words", "n_removed", kept)


ORACLE = r"""
WITH w AS (SELECT doc_id, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words FROM documents),
word AS (SELECT doc_id, generate_subscripts(words, 1) AS pos, unnest(words) AS word FROM w),
win AS (SELECT w.doc_id, i AS pos, md5(array_to_string(w.words[i:i + 19], ' ')) AS k FROM w, range(1, len(words) - 18) r(i)),
again AS (SELECT doc_id, pos, row_number() OVER (PARTITION BY k ORDER BY doc_id, pos) > 1 AS later FROM win),
marked AS (SELECT doc_id, pos, word, coalesce(max(later::int) OVER (PARTITION BY doc_id ORDER BY pos ROWS BETWEEN 19 PRECEDING AND CURRENT ROW), 0) > 0 AS gone
    FROM word LEFT JOIN again USING (doc_id, pos)),
kept AS (SELECT doc_id, count(*) AS n_words, count(*) FILTER (gone) AS n_removed, string_agg(word, ' ' ORDER BY pos) FILTER (NOT gone) AS text FROM marked GROUP BY doc_id)
SELECT d.doc_id, coalesce(n_words, 0)::bigint AS n_words, coalesce(n_removed, 0)::bigint AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM documents d LEFT JOIN kept USING (doc_id)
"""
