"""Language identification by segmentation-marginalised unigrams.

Each language has a probability for every piece of a fixed public vocabulary. A word's probability is the sum
over all its segmentations into pieces, by the forward algorithm; a text's is the product over its words. The
piece probabilities are fitted by expectation maximisation, whose expected counts come from forward and backward
sums over the words of the training sample. Words whose sums could underflow are summed in logarithms, in training as in
scoring, so a word of any length is one word: in a script without spaces that is a sentence or a whole text.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, checked_broadcast, map_texts, small_batches, table
from .token_counts import START, VOCABULARY, load_pieces

TRAIN_DOCS = 20_000  # training documents, about: those of smallest hash of each language, which share the number alike
ITERATIONS = 3
SMOOTHING = 0.1
REMEMBERED = 200_000  # words whose probabilities a task keeps
PLACES_AT_ONCE = 1 << 18  # places in words of like length whose sums are made together; a longer word is worked on in parts
SUMS_AT_ONCE = 1 << 20  # places times languages, likewise
PART = 4096  # places of a very long word whose pieces are held at a time
SMALLEST = 290  # decimal digits that a sum may lie below 1
UNKNOWN = "und"
_LETTERS = re.compile(r"[^\W\d_]+")


def letter_words(text: str | None) -> Counter[str]:
    """Runs of letters in lower case, with their numbers."""
    counts = Counter(_LETTERS.findall(text.lower())) if text else Counter()
    for w in [w for w in counts if not w.isalpha()]:
        n = counts.pop(w)
        if any(map(str.isalpha, w)):
            counts[w] += n
    return counts


class PieceTrie:
    """The vocabulary as a trie whose transitions are in an open hash table, so that many words walk it at once."""

    def __init__(self, pieces: dict[str, int]):
        chars = {c: i + 1 for i, c in enumerate(sorted({c for p in pieces for c in p}))}
        step: dict[tuple[int, int], int] = {}
        own = [0]
        for p, number in pieces.items():
            u = 0
            for c in p:
                v = step.get((u, chars[c]))
                if v is None:
                    v = step[u, chars[c]] = len(own)
                    own.append(0)
                u = v
            own[u] = number
        self.own, self.width = np.array(own), len(chars) + 1
        self.code = np.zeros(max(map(ord, chars), default=0) + 2, np.int64)
        for c, i in chars.items():
            self.code[ord(c)] = i
        self.bits = max(4, (4 * len(step)).bit_length())
        self.keys, self.to = np.full(1 << self.bits, -1, np.int64), np.zeros(1 << self.bits, np.int64)
        todo = np.array([u * self.width + c for u, c in step], np.int64)
        values, at = np.array(list(step.values()), np.int64), self._slot(todo)
        while len(todo):  # of those that want a free slot the first gets it, the others go on
            first = np.zeros(len(todo), bool)
            first[np.unique(at, return_index=True)[1]] = True
            first &= self.keys[at] < 0
            self.keys[at[first]], self.to[at[first]] = todo[first], values[first]
            todo, values, at = todo[~first], values[~first], (at[~first] + 1) & ((1 << self.bits) - 1)

    def _slot(self, key: np.ndarray) -> np.ndarray:
        return ((key.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) >> np.uint64(64 - self.bits)).astype(np.int64)

    def codes(self, words: list[str], length: np.ndarray) -> np.ndarray:
        """One row per word, with the start mark and zeros behind."""
        flat = np.frombuffer("".join(START + w for w in words).encode("utf-32-le", "surrogatepass"), np.uint32)
        out = np.zeros((len(words), int(length.max(initial=0)) + 1), np.int64)
        row = np.repeat(np.arange(len(words)), length)
        out[row, np.arange(len(flat)) - np.repeat(np.cumsum(length) - length, length)] = self.code[np.minimum(flat, len(self.code) - 1)]
        return out

    def follow(self, node: np.ndarray, code: np.ndarray) -> np.ndarray:
        """The next nodes; -1: none."""
        key = node * self.width + code
        at, out, todo = self._slot(key), np.full(len(key), -1, np.int64), np.arange(len(key))
        while len(todo):
            found = self.keys[at[todo]]
            hit = found == key[todo]
            out[todo[hit]] = self.to[at[todo[hit]]]
            todo = todo[~hit & (found >= 0)]
            at[todo] = (at[todo] + 1) & ((1 << self.bits) - 1)
        return out


class Lattice:
    """All pieces inside some words, as flat arrays of edges; piece 0 is any single character that no piece is."""

    def __init__(self, words: list[str], trie: PieceTrie):
        self.length = np.array([len(w) + 1 for w in words], np.int64)
        codes, edges = trie.codes(words, self.length), []
        for a in range(int(self.length.max(initial=0))):
            word = np.flatnonzero(self.length > a)
            node, b = np.zeros(len(word), np.int64), a
            while len(word):
                b += 1
                node = trie.follow(node, codes[word, b - 1])
                piece = np.where(node >= 0, trie.own[node], 0)
                some = (piece > 0) | (b == a + 1)
                edges.append(np.stack([word[some], np.full(some.sum(), a), np.full(some.sum(), b), piece[some]]))
                on = (node >= 0) & (self.length[word] > b)
                word, node = word[on], node[on]
        self.word, self.start, self.end, self.piece = np.concatenate(edges, 1) if edges else np.zeros((4, 0), np.int64)

    def _sums(self, p: np.ndarray, into: np.ndarray, outof: np.ndarray, first: np.ndarray, steps: range, logs: bool) -> np.ndarray:
        """Sums over paths to each place, for rows of p (edges x languages): [word, place, language]. logs: p and sums are logarithms."""
        out = np.full((len(self.length), int(self.length.max(initial=0)) + 1, p.shape[1]), -np.inf if logs else 0.0)
        out[np.arange(len(first)), first] = 0 if logs else 1
        order = np.argsort(into, kind="stable")
        cuts = np.searchsorted(into[order], np.arange(out.shape[1] + 1))
        for j in steps:
            e = order[cuts[j] : cuts[j + 1]]
            if logs:
                np.logaddexp.at(out, (self.word[e], j), out[self.word[e], outof[e]] + p[e])
            else:
                np.add.at(out, (self.word[e], j), out[self.word[e], outof[e]] * p[e])
        return out

    def forward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sums(p, self.end, self.start, np.zeros(len(self.length), np.int64), range(1, int(self.length.max(initial=0)) + 1), logs)

    def backward(self, p: np.ndarray, logs: bool = False) -> np.ndarray:
        return self._sums(p, self.start, self.end, self.length, range(int(self.length.max(initial=0)) - 1, -1, -1), logs)

    def log_probability(self, probs: np.ndarray, logs: bool = False) -> np.ndarray:
        """words x languages. probs: pieces x languages. logs: for words that could underflow (see PieceModel.safe)."""
        last = self.forward(np.log(probs)[self.piece] if logs else probs[self.piece], logs)[np.arange(len(self.length)), self.length]
        return last if logs else np.log(last)

    def shares(self, probs: np.ndarray, lang: np.ndarray, logs: bool = False) -> np.ndarray:
        """For each edge how often its piece is expected in its word. lang: of each word, a column of probs."""
        p = probs[self.piece, lang[self.word]][:, None]
        p = np.log(p) if logs else p
        ahead, behind = self.forward(p, logs)[..., 0], self.backward(p, logs)[..., 0]
        total = ahead[np.arange(len(self.length)), self.length][self.word]
        a, b = ahead[self.word, self.start], behind[self.word, self.end]
        return np.exp(a + p[:, 0] + b - total) if logs else a * p[:, 0] * b / total


class PieceModel:
    def __init__(self, langs: list[str], pieces: dict[str, int] | PieceTrie, probs: np.ndarray, prior: np.ndarray):
        self.langs, self.trie, self.probs, self.prior = langs, pieces if isinstance(pieces, PieceTrie) else PieceTrie(pieces), probs, prior
        #: Letters up to which no word's sum is too small for a double.
        self.safe = int(SMALLEST / max(1e-9, -np.log10(probs.min(initial=1.0)))) - 1

    def lattice(self, words: list[str]) -> Lattice:
        return Lattice(words, self.trie)

    def groups(self, words: list[str], width: int) -> Iterator[tuple[int, int, bool]]:
        """Words in order of length as (first, end, whether sums need logarithms), of bounded size together. width: languages of a sum."""
        most, at = min(PLACES_AT_ONCE, SUMS_AT_ONCE // max(1, width)), 0
        while at < len(words):
            long, end = len(words[at]) > self.safe, at + 1
            while end < len(words) and (len(words[end]) > self.safe) == long and (end + 1 - at) * (len(words[end]) + 2) <= most:
                end += 1
            yield at, end, long
            at = end

    def log_probability(self, words: list[str]) -> np.ndarray:
        """words x languages; words must come in order of length."""
        out = np.empty((len(words), len(self.langs)))
        for at, end, long in self.groups(words, len(self.langs)):
            if len(words[at]) > PLACES_AT_ONCE:
                out[at] = self.very_long(words[at])
            else:
                out[at:end] = self.lattice(words[at:end]).log_probability(self.probs, long)
        return out

    def expected(self, words: list[str], lang: np.ndarray, n: np.ndarray, sums: np.ndarray) -> None:
        """Adds to sums (pieces x languages) the expected numbers of the pieces in words, each n times and of the language in column lang."""
        order = sorted(range(len(words)), key=lambda i: len(words[i]))
        ranked = [words[i] for i in order]
        for at, end, long in self.groups(ranked, 1):
            mine = np.array(order[at:end])
            if len(ranked[at]) > PLACES_AT_ONCE:
                self.very_long(ranked[at], int(lang[mine[0]]), float(n[mine[0]]), sums)
                continue
            grid = self.lattice(ranked[at:end])
            np.add.at(sums, (grid.piece, lang[mine][grid.word]), grid.shares(self.probs, lang[mine], long) * n[mine][grid.word])

    def _edges(self, codes: np.ndarray, first: int, last: int, n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Start, end and piece of the edges that start in [first, last) of a word of n places, by start; where each start's edges begin."""
        start = np.arange(first, last)
        edges, node, b = [], np.zeros(len(start), np.int64), start.copy()
        while len(start):
            b = b + 1
            node = self.trie.follow(node, codes[b - 1])
            piece = np.where(node >= 0, self.trie.own[node], 0)
            some = (piece > 0) | (b == start + 1)
            edges.append(np.stack([start[some], b[some], piece[some]]))
            on = (node >= 0) & (b < n)
            start, node, b = start[on], node[on], b[on]
        start, end, piece = np.concatenate(edges, 1)
        order = np.argsort(start, kind="stable")
        return start[order], end[order], piece[order], np.searchsorted(start[order], np.arange(first, last + 1))

    def very_long(self, word: str, lang: int | None = None, n: float = 0, sums: np.ndarray | None = None) -> np.ndarray:
        """Log probability of one word in every language, or in `lang`; the pieces of PART places are held at a time. sums: see `expected`."""
        places = len(word) + 1
        codes = self.trie.codes([word], np.array([places]))[0]
        logs = np.log(self.probs if lang is None else self.probs[:, [lang]])
        ahead = np.full((places + 1, logs.shape[1]), -np.inf)
        ahead[0] = 0
        firsts = range(0, places, PART)
        for first in firsts:
            last = min(places, first + PART)
            _, end, piece, cuts = self._edges(codes, first, last, places)
            p = logs[piece]
            for k, a in enumerate(range(first, last)):  # the ends of one start differ
                e = slice(cuts[k], cuts[k + 1])
                ahead[end[e]] = np.logaddexp(ahead[end[e]], ahead[a] + p[e])
        if sums is not None:
            behind = np.full(places + 1, -np.inf)
            behind[places] = 0
            for first in reversed(firsts):
                last = min(places, first + PART)
                start, end, piece, cuts = self._edges(codes, first, last, places)
                p = logs[piece, 0]
                for k in range(last - first - 1, -1, -1):
                    e = slice(cuts[k], cuts[k + 1])
                    behind[first + k] = np.logaddexp.reduce(p[e] + behind[end[e]])
                np.add.at(sums, (piece, lang), n * np.exp(ahead[start, 0] + p + behind[end] - ahead[places, 0]))
        return ahead[places]


def quotas(sizes: dict[str, int], total: int) -> dict[str, float]:
    """Shares of `total`: alike, but none above its size, what a small one leaves going to the others."""
    out, left = {}, float(total)
    for k, x in enumerate(sorted(sizes, key=sizes.get)):
        out[x] = min(float(sizes[x]), left / (len(sizes) - k))
        left -= out[x]
    return out


def _words(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        counts: Counter[tuple[str, str]] = Counter()
        for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist(), strict=True):
            for w, n in letter_words(text).items():
                counts[lang, w] += n
        yield pa.RecordBatch.from_arrays([pa.array([k[0] for k in counts], pa.string()), pa.array([k[1] for k in counts], pa.string()), pa.array(list(counts.values()), pa.int64())], ["lang", "word", "n"])


def _expected(model):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        column = {x: i for i, x in enumerate(m.langs)}
        sums = np.zeros(m.probs.shape)
        for batch in batches:
            lang = np.array([column[x] for x in batch.column("lang").to_pylist()], np.int64)
            m.expected(batch.column("word").to_pylist(), lang, np.array(batch.column("n"), float), sums)
        piece, lang = np.nonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(piece.astype(np.int32)), pa.array(lang.astype(np.int32)), pa.array(sums[piece, lang])], ["piece", "lang", "n"])

    return run


def fit_languages(spark: SparkSession, docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id", train_docs: int = TRAIN_DOCS, vocabulary: str = VOCABULARY, iterations: int = ITERATIONS) -> PieceModel:
    """Learns from rows with a non-null lang and words, about train_docs of them: of each language the rows of smallest hash, all of a
    small one, and all their words of any length.

    Languages are taken to be few: the model has a column of the vocabulary's size for each. What the driver gets is one sum per piece and language. No such row gives a model without languages.
    """
    small_batches(spark)
    scratch = Scratch(spark)
    named = lambda c: F.col(f"`{c.replace('`', '``')}`")
    own = docs.select(*[named(c).alias(a) for c, a in ((id_col, "id"), (lang_col, "lang")) if c in docs.columns], named(text_col).cast("string").alias("text"))
    known = own.where("lang is not null and text is not null").withColumn("lang", F.col("lang").cast("string"))
    sizes = {r["lang"]: r["n"] for r in known.groupBy("lang").agg(F.count("*").alias("n")).collect()}  # as many as the model has languages
    share = quotas(sizes, train_docs)
    h = F.xxhash64(*[c for c in ("id", "text") if c in known.columns])
    below = spark.createDataFrame([(x, min(2**63 - 1, -(2**63) + int(2**64 * share[x] / sizes[x]))) for x in sizes], "lang string, below long")
    sample = scratch.write(known.join(checked_broadcast(below), "lang").where(h <= F.col("below")).select("lang", "text"), "sample")
    parts = max(1, spark.sparkContext.defaultParallelism)
    counted = scratch.write(sample.repartition(parts).mapInArrow(_words, "lang string, word string, n long").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    langs = [r["lang"] for r in counted.select("lang").distinct().orderBy("lang").collect()]
    pieces = {p: i + 1 for i, p in enumerate(load_pieces(vocabulary))}
    size = len(pieces) + 1
    seen = {r["lang"]: r["n"] for r in counted.groupBy("lang").agg(F.sum("n").alias("n")).collect()}
    prior = np.array([seen[x] for x in langs], float)
    model = PieceModel(langs, pieces, np.full((size, len(langs)), 1 / size), prior / max(1.0, prior.sum()))
    for _ in range(iterations if langs else 0):
        sums = counted.mapInArrow(_expected(spark.sparkContext.broadcast(model)), "piece int, lang int, n double").groupBy("piece", "lang").agg(F.sum("n").alias("n")).toPandas()
        counts = np.full(model.probs.shape, SMOOTHING)
        counts[sums["piece"], sums["lang"]] += sums["n"]
        model = PieceModel(langs, model.trie, counts / counts.sum(0), model.prior)
    scratch.drop(sample, counted)
    return model


def _predicted(model, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m = model.value
        known: dict[str, int] = {}
        table_ = np.empty((1024, len(m.langs)))
        for batch in batches:
            docs = [letter_words(t) for t in batch.column("text").to_pylist()]
            if len(known) > REMEMBERED:
                known = {}
            new = sorted({w for d in docs for w in d if w not in known}, key=len) if m.langs else []
            while len(table_) < len(known) + len(new):
                table_ = np.concatenate([table_, np.empty_like(table_)])
            if new:
                table_[len(known) : len(known) + len(new)] = m.log_probability(new)
                known.update({w: len(known) + i for i, w in enumerate(new)})
            langs, scores = [], []
            for d in docs:
                if not d or not m.langs:
                    langs.append(UNKNOWN), scores.append(0.0)
                    continue
                z = np.log(m.prior) + np.fromiter(d.values(), float, len(d)) @ table_[np.fromiter(map(known.__getitem__, d), np.int64, len(d))]
                best = int(z.argmax())
                langs.append(m.langs[best]), scores.append(float(1 / np.exp(z - z[best]).sum()))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(langs, pa.string()), pa.array(scores, pa.float64())], [*batch.schema.names, *names])

    return run


def identify_languages(spark: SparkSession, docs: DataFrame, model: PieceModel, text_col: str = "text", names: tuple[str, str] = ("lang_pred", "score")) -> DataFrame:
    """docs and all their columns, with the most probable language and its posterior probability.

    `und` with score 0 where the text is null or has no letter, or nothing was learned; ties go to the first language
    by code point. Whole texts are scored, in lower case, a run of letters of any length as one word. Columns of docs named
    like `names` are replaced; an empty table gives no rows. The broadcast model has the size of vocabulary times languages.
    """
    small_batches(spark)
    return map_texts(docs, text_col, _predicted(spark.sparkContext.broadcast(model), names), **{names[0]: T.StringType(), names[1]: T.DoubleType()})


def op10_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text", "lang").withColumn("held_out", F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % 5 == 0)
    model = fit_languages(spark, docs.where(~F.col("held_out")))
    return identify_languages(spark, docs.drop("lang"), model).select("doc_id", "held_out", "lang_pred", "score")
