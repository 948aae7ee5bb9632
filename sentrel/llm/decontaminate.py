"""Benchmark decontamination by an FM-index per training shard.

A shard is one batch of documents inside a task. Its words are mapped to the benchmark's vocabulary;
stretches of known words too short for any window can hold no occurrence and are left out, the others
are joined with separators that sort apart. The shard's suffix array (prefix doubling) gives its
Burrows-Wheeler transform, held in a wavelet matrix. All windows are searched backward at once by
wavelet ranks, occurrences are located by sampled suffix positions, and their spans are merged.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator
from itertools import repeat

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import map_texts, own_columns, small_batches, table

WINDOW = 10
#: Benchmark words held in a task at once; a larger benchmark is searched in several passes over the documents' batches.
PASS_WORDS = 1_000_000
SAMPLE = 8
_ALNUM = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or 48 <= c <= 57 or 97 <= c <= 122 else 32 for c in range(256))


#: The same words where they stand, in UTF-8.
WORD = re.compile(rb"[0-9A-Za-z\x80-\xff]+")


def words_of(text: str | None) -> list[bytes]:
    """Runs of 0-9, a-z and everything beyond ASCII, with A-Z lower-cased."""
    return text.encode("utf-8", "surrogatepass").translate(_ALNUM).split() if text else []


def suffix_array(seq: np.ndarray) -> np.ndarray:
    """Of symbols >= 1 with separators 0, where every separator counts as a symbol of its own."""
    n, cuts = len(seq), np.flatnonzero(seq == 0)
    rank = seq.astype(np.int64) + len(cuts)
    rank[cuts] = np.arange(1, len(cuts) + 1)
    k = 1
    while True:
        nxt = np.zeros(n, np.int64)
        if k < n:
            nxt[:-k] = rank[k:]
        key = rank * (n + int(rank.max()) + 2) + nxt
        order = np.argsort(key, kind="stable")
        ordered = key[order]
        new = np.empty(n, np.int64)
        new[order] = np.cumsum(np.append(True, ordered[1:] != ordered[:-1]))
        rank, k = new, 2 * k
        if rank[order[-1]] == n or k > n:
            return order


class FMIndex:
    """Backward search and location over one sequence; symbols in [0, sigma), 0 separates."""

    def __init__(self, seq: np.ndarray, sigma: int):
        seq = np.append(seq, 0).astype(np.int64)
        sa = suffix_array(seq)
        self.n, bwt = len(seq), seq[sa - 1]
        self.starts = np.concatenate([[0], np.cumsum(np.bincount(seq, minlength=sigma))])
        self.levels: list[tuple[np.ndarray, int]] = []  # most significant bit first: zeros before i, zeros in all
        for bit in range(max(1, int(sigma - 1).bit_length()) - 1, -1, -1):
            zero = (bwt >> bit) & 1 == 0
            self.levels.append((np.concatenate([[0], np.cumsum(zero)]), int(zero.sum())))
            bwt = np.concatenate([bwt[zero], bwt[~zero]])
        self.sampled = sa % SAMPLE == 0
        self.sample_rank = np.cumsum(self.sampled) - 1
        self.sample_at = sa[self.sampled]
        # separators are told apart by place, not by symbol: a step over one isn't a rank, so those rows keep their place
        sep = seq[sa - 1] == 0
        self.sampled |= sep
        self.sample_rank, self.sample_at = np.cumsum(self.sampled) - 1, sa[self.sampled]

    def rank(self, symbol: np.ndarray, i: np.ndarray) -> np.ndarray:
        """Occurrences of the symbol before row i, less the symbol's start in the last level."""
        for k, (zeros, z) in enumerate(self.levels):
            before = zeros[i]
            i = np.where((symbol >> (len(self.levels) - 1 - k)) & 1 == 0, before, z + i - before)
        return i

    def search(self, patterns: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """patterns: right-aligned rows. Returns the suffix interval [lo, hi) of each."""
        lo, hi = np.zeros(len(patterns), np.int64), np.full(len(patterns), self.n, np.int64)
        live = np.arange(len(patterns))
        width = patterns.shape[1]
        for step in range(width):
            live = live[(lengths[live] > step) & (lo[live] < hi[live])]
            if not len(live):
                break
            c = patterns[live, width - 1 - step]
            base = self.rank(c, np.zeros(len(c), np.int64))
            lo[live], hi[live] = self.starts[c] + self.rank(c, lo[live]) - base, self.starts[c] + self.rank(c, hi[live]) - base
        return lo, hi

    def access(self, i: np.ndarray) -> np.ndarray:
        out = np.zeros(len(i), np.int64)
        for zeros, z in self.levels:
            one = zeros[i + 1] == zeros[i]
            out = out * 2 + one
            i = np.where(one, z + i - zeros[i], zeros[i])
        return out

    def locate(self, rows: np.ndarray) -> np.ndarray:
        at, add = rows.copy(), np.zeros(len(rows), np.int64)
        todo = np.flatnonzero(~self.sampled[at])
        while len(todo):
            c = self.access(at[todo])
            at[todo] = self.starts[c] + self.rank(c, at[todo]) - self.rank(c, np.zeros(len(c), np.int64))
            add[todo] += 1
            todo = todo[~self.sampled[at[todo]]]
        return self.sample_at[self.sample_rank[at]] + add


class Windows:
    """The windows of some benchmark items, as right-aligned rows of word numbers (from 1)."""

    def __init__(self, items: list[tuple], window: int):
        self.vocab: dict[bytes, int] = {}
        of: dict[tuple, set] = {}
        for item, text in items:
            words = [self.vocab.setdefault(w, len(self.vocab) + 1) for w in words_of(text)]
            k = min(window, len(words))
            for i in range(len(words) - k + 1 if words else 0):
                of.setdefault(tuple(words[i : i + k]), set()).add(item)
        self.lengths = np.array([len(x) for x in of], np.int64)
        self.rows = np.zeros((len(of), window), np.int64)
        for row, x in zip(self.rows, of, strict=True):
            row[window - len(x) :] = x
        self.items = [sorted(x) for x in of.values()]
        self.shortest = int(self.lengths.min()) if len(of) else 0

    def find(self, docs: list[list[bytes]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(document, first word, window) of every occurrence in a shard."""
        none = np.empty(0, np.int64)
        sizes = np.array([len(d) for d in docs], np.int64)
        if not len(self.lengths) or not sizes.sum():
            return none, none, none
        ends = np.cumsum(sizes + 1)
        seq = np.zeros(int(ends[-1]), np.int64)
        for d, end in zip(docs, ends, strict=True):
            seq[end - 1 - len(d) : end - 1] = np.fromiter(map(self.vocab.get, d, repeat(0)), np.int64, len(d))
        known = np.concatenate([[0], (seq > 0).astype(np.int8), [0]])
        first, last = np.flatnonzero(np.diff(known) == 1), np.flatnonzero(np.diff(known) == -1)
        long = last - first >= self.shortest
        first, last = first[long], last[long]
        if not len(first):
            return none, none, none
        sizes = last - first + 1
        place = np.repeat(first - np.concatenate([[0], np.cumsum(sizes)[:-1]]), sizes) + np.arange(sizes.sum())
        run = np.append(seq, 0)[place]
        run[np.cumsum(sizes) - 1] = 0
        index = FMIndex(run, len(self.vocab) + 1)
        lo, hi = index.search(self.rows, self.lengths)
        counts = np.maximum(hi - lo, 0)
        which = np.repeat(np.arange(len(counts)), counts)
        rows = np.repeat(lo - np.concatenate([[0], np.cumsum(counts)[:-1]]), counts) + np.arange(counts.sum())
        at = place[index.locate(rows)]
        doc = np.searchsorted(ends, at, side="right")
        return doc, at - np.concatenate([[0], ends[:-1]])[doc], which


def merged(starts: np.ndarray, ends: np.ndarray) -> list[tuple[int, int]]:
    """Union of half-open spans, as disjoint sorted spans that do not touch."""
    out: list[list[int]] = []
    for a, b in sorted(zip(starts.tolist(), ends.tolist(), strict=True)):
        if out and a <= out[-1][1]:
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [tuple(x) for x in out]


_SPANS = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))
_OUT = T.ArrayType(T.StructType([T.StructField("start", T.LongType()), T.StructField("end", T.LongType())]))


def _shards(windows, names: tuple[str, str, str], first: bool):
    words_col, spans_col, items_col = names

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w = windows.value
        for batch in batches:
            docs = [words_of(x) for x in batch.column("text").to_pylist()]
            doc, start, which = w.find(docs)
            spans: list[list] = [[] for _ in docs] if first else [[(s["start"], s["end"]) for s in x] for x in batch.column(spans_col).to_pylist()]
            items: list[list] = [[] for _ in docs] if first else batch.column(items_col).to_pylist()
            order = np.argsort(doc, kind="stable")
            cuts = np.append(np.flatnonzero(np.diff(doc[order], prepend=-1)), len(order))
            for a, b in zip(cuts[:-1], cuts[1:], strict=True):
                rows = order[a:b]
                d = int(doc[rows[0]])
                old = np.array(spans[d], np.int64).reshape(-1, 2)
                spans[d] = merged(np.append(old[:, 0], start[rows]), np.append(old[:, 1], start[rows] + w.lengths[which[rows]]))
                items[d] = sorted({*items[d], *(i for x in np.unique(which[rows]) for i in w.items[x])})
            keep = [c for c in batch.schema.names if c not in names]
            arrays = [batch.column(c) for c in keep] + [pa.array([len(d) for d in docs], pa.int64()), pa.array([[{"start": a, "end": b} for a, b in x] for x in spans], _SPANS), pa.array(items, pa.list_(pa.string()))]
            yield pa.RecordBatch.from_arrays(arrays, [*keep, *names])

    return run


def benchmark_passes(spark: SparkSession, benchmark: DataFrame, item_col: str, text_col: str, window: int, pass_words: int) -> list:
    """Broadcasts of the benchmark's windows, each of about pass_words words: one, unless the benchmark is larger.

    The driver makes one after another and holds the windows of one at a time; a broadcast is a file for it then.
    """
    b = benchmark.where(F.col(item_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(item_col).cast("string").alias("item"), F.col(text_col).cast("string").alias("text"))
    size = b.agg(F.sum(F.octet_length("text")).alias("n")).first()["n"] or 0
    passes = 1 + size // (6 * pass_words)
    return [spark.sparkContext.broadcast(Windows([tuple(r) for r in b.where(F.pmod(F.xxhash64("item"), F.lit(passes)) == k).orderBy("item", "text").toLocalIterator()], window)) for k in range(passes)]


def find_contamination(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", benchmark_text_col: str = "text", window: int = WINDOW, names: tuple[str, str, str] = ("words", "spans", "items"), pass_words: int = PASS_WORDS) -> DataFrame:
    """docs and all their columns, with three more (`names`): number of words, merged spans of words inside any
    occurrence of a benchmark window (start, end exclusive), and the sorted item ids (strings) that occur.

    Null or empty texts have no words and no spans. Benchmark rows with a null id or text, or without words,
    have no windows; a repeated id is one item with the windows of all its texts. An item of fewer than
    `window` words is one window. Empty tables give empty spans or no rows. Columns of docs named like
    `names` are replaced.
    """
    small_batches(spark)
    passes = [_shards(windows, names, k == 0) for k, windows in enumerate(benchmark_passes(spark, benchmark, item_col, benchmark_text_col, window, pass_words))]
    return map_texts(docs, text_col, *passes, **dict(zip(names, (T.LongType(), _OUT, T.ArrayType(T.StringType())), strict=True)))


def cut_words(text: str, spans: list[tuple[int, int]]) -> str:
    """text without the words of these spans (disjoint and in order) and what stands between them; what is around them stays as it is."""
    raw = text.encode("utf-8", "surrogatepass")
    at = [m.span() for m in WORD.finditer(raw)]
    kept, last = [], 0
    for a, b in spans:
        kept.append(raw[last : at[a][0]])
        last = at[b - 1][1]
    return b"".join([*kept, raw[last:]]).decode("utf-8", "surrogatepass")


def _cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        spans = batch.column("row").field("spans").to_pylist()
        texts = [t if not x else cut_words(t, [(s["start"], s["end"]) for s in x]) for t, x in zip(batch.column("text").to_pylist(), spans, strict=True)]
        n = [sum(s["end"] - s["start"] for s in x) for x in spans]
        yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array(texts, pa.string()), pa.array(n, pa.int64())], ["row", "text", "n_cut"])


def cut_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame, text_col: str = "text", **how) -> DataFrame:
    """docs and all their columns, with the words that a benchmark window covers cut out of the text, and n_cut, their number.

    Takes the options of `find_contamination`, and treats nulls, odd texts and empty tables as that does; a column of docs named n_cut is replaced.
    """
    docs = docs.drop("n_cut")
    rows = docs.select(F.struct(*own_columns(docs, text_col)).alias("own") if len(docs.columns) > 1 else F.lit(0).alias("own"), F.col(f"`{text_col.replace('`', '``')}`").cast("string").alias("text"))
    found = find_contamination(spark, rows, benchmark, "text", **how).select("own", "spans", "text")
    cut = map_texts(found, "text", _cut, n_cut=T.LongType())
    return cut.select(*[F.col("text").alias(c) if c == text_col else F.col("own")[c].alias(c) for c in docs.columns], "n_cut")


def items_digest(items: list) -> str:
    return hashlib.sha256(",".join(sorted(map(str, items))).encode()).hexdigest()


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    found = find_contamination(spark, docs, table(spark, sf_dir, "benchmark"))
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda t, s: t + s["end"] - s["start"])
    return found.select("doc_id", F.col("words").alias("n_words"), hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), (F.size("spans") > 0).alias("contaminated"))


def without_benchmark(spark: SparkSession, docs: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of docs in which no benchmark window occurs."""
    rows = docs.select(F.struct(*own_columns(docs)).alias("row"), F.col("text").cast("string").alias("text"))
    return find_contamination(spark, rows, benchmark).where(F.size("spans") == 0).select("row.*")


_WORDS = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
ORACLE = f"""
WITH b AS (SELECT CAST(item_id AS VARCHAR) AS item, {_WORDS} AS w FROM benchmark),
bw AS (SELECT DISTINCT item, least(10, len(w)) AS k, array_to_string(w[i:i + least(10, len(w)) - 1], ' ') AS g
       FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 9) + 1)) AS i FROM b WHERE len(w) > 0)),
d AS (SELECT doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT doc_id, k, i, array_to_string(w[i:i + k - 1], ' ') AS g
       FROM (SELECT doc_id, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM d, (SELECT DISTINCT k FROM bw) WHERE len(w) >= k)),
o AS (SELECT doc_id, item, k, i FROM dw JOIN bw USING (k, g)),
h AS (SELECT doc_id, count(DISTINCT p) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + k)) AS p FROM (SELECT DISTINCT doc_id, i, k FROM o)) GROUP BY doc_id),
t AS (SELECT doc_id, count(*) AS n_items, sha256(string_agg(item, ',' ORDER BY item)) AS s FROM (SELECT DISTINCT doc_id, item FROM o) GROUP BY doc_id)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       coalesce(s, sha256('')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM d LEFT JOIN h USING (doc_id) LEFT JOIN t USING (doc_id)
"""
