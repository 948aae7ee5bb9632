"""Greedy word-piece counts by a linear longest-match automaton.

The vocabulary is a trie whose nodes have failure links. A link says where matching goes on once the
pieces that are sure by then are popped; only the number of popped pieces is kept, computed in advance.
A word of n characters costs at most 2n steps and no piece is ever built.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

from .common import map_texts, small_batches, table

VOCABULARY = "/opt/tokenizers/piece_bpe_32k.model"
START = "▁"  # stands before a word
REMEMBERED = 200_000  # words whose counts a task keeps


def load_pieces(path: str = VOCABULARY) -> list[str]:
    """Ordinary pieces of a sentencepiece model."""
    import sentencepiece

    model = sentencepiece.SentencePieceProcessor(model_file=path)
    return [model.id_to_piece(i) for i in range(model.get_piece_size()) if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))]


class LongestMatch:
    """Counts pieces of a greedy longest-match segmentation; a character that no piece starts with counts as its UTF-8 bytes."""

    def __init__(self, pieces: list[str]):
        self.next: list[dict[str, int]] = [{}]
        own = [0]  # pieces popped by the node's own string, 0: it is no piece
        for piece in sorted(set(pieces) | {c for p in pieces for c in p}, key=lambda p: (len(p), p)):
            u = 0
            for c in piece:
                if (v := self.next[u].get(c)) is None:
                    v = self.next[u][c] = len(self.next)
                    self.next.append({})
                    own.append(0)
                u = v
            if u:
                own[u] = 1
        for c in set(self.next[0]) - set(pieces):
            own[self.next[0][c]] = len(c.encode("utf-8", "surrogatepass"))
        self.fail, self.popped = [0] * len(self.next), [0] * len(self.next)
        level = [(0, c, v) for c, v in self.next[0].items()]
        while level:
            for u, c, v in level:
                if own[v]:
                    self.popped[v] = own[v]  # and matching starts anew at the root
                    continue
                z, n = self.fail[u], self.popped[u]
                while c not in self.next[z]:
                    z, n = self.fail[z], n + self.popped[z]
                self.fail[v], self.popped[v] = self.next[z][c], n
            level = [(v, c, w) for _, _, v in level for c, w in self.next[v].items()]

    def count(self, word: str) -> int:
        nxt, fail, popped = self.next, self.fail, self.popped
        u = n = 0
        for c in word:
            while (v := nxt[u].get(c)) is None:
                if not u:
                    n += len(c.encode("utf-8", "surrogatepass"))
                    v = 0
                    break
                n += popped[u]
                u = fail[u]
            u = v
        while u:
            n += popped[u]
            u = fail[u]
        return n


def _counts(automaton, names: tuple[str, str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count, known = automaton.value.count, {}
        for batch in batches:
            words, tokens = [], []
            for text in batch.column("text").to_pylist():
                n = t = 0
                for word, k in Counter(text.encode("utf-8", "surrogatepass").split() if text else ()).items():
                    if (c := known.get(word)) is None:
                        c = count(START + word.decode("utf-8", "surrogatepass"))
                        if len(known) < REMEMBERED and len(word) < 64:
                            known[word] = c
                    n, t = n + k, t + k * c
                words.append(n)
                tokens.append(t)
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(words, pa.int64()), pa.array(tokens, pa.int64())], [*batch.schema.names, *names])

    return run


def count_tokens(spark: SparkSession, docs: DataFrame, text_col: str = "text", vocabulary: str = VOCABULARY, names: tuple[str, str] = ("n_words", "n_tokens")) -> DataFrame:
    """docs and all their columns, with the number of words (runs of anything but ASCII white space) and of word pieces.

    Each word, with the start mark before it, is cut greedily into longest pieces of the vocabulary; a character
    that no piece starts with takes one token per UTF-8 byte. Null and blank texts have 0 of both; words have no
    length limit; columns of docs named like `names` are replaced; an empty table gives no rows. The automaton is
    broadcast: its size is the vocabulary's and doesn't grow with the data.
    """
    small_batches(spark)
    automaton = spark.sparkContext.broadcast(LongestMatch(load_pieces(vocabulary)))
    return map_texts(docs, text_col, _counts(automaton, names), **{n: T.LongType() for n in names})


def op7_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return count_tokens(spark, table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "n_words", "n_tokens")
