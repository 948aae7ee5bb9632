"""Secret scan: fixed patterns, and a character convolutional network over every candidate and its context.

Candidates are all runs of token characters that are no plain words or numbers: 8 characters or more with a digit
beside a letter or sign, 12 or more whose case changes inside, and 6 or more behind `:` or `=`. Findings of the fixed
patterns label them for training. These labels are weak, as the patterns know a few forms only, so each finding is also shown as what it stands
for: its value spelled anew in other alphabets and lengths, in the contexts of tokens that are no findings, behind words that no pattern knows or
behind nothing. Against it stand the corpus's own words, joined as names, paths and versions join them, in the same
contexts: what is left to tell them apart is the form of the value. The network is a convolution over characters with max
pooling, written in numpy. Every labelled candidate of the corpus takes part: chunks of them are fitted side by side, an epoch from the same weights each,
and the weights averaged after each epoch. Its scores are calibrated on a held-out part of both kinds, whole as well, and the threshold is at even odds, or
as far below as the recall asked for needs there.
"""

from __future__ import annotations

import math
import pickle
import re
import string
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import Scratch, map_texts, small_batches, table

KINDS = ("assign", "access", "hex")
ASSIGN = re.compile(r"(?ai)(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)")
KEYS = ("password", "passwd", "secret", "token", "apikey", "api_key")
ACCESS = re.compile(r"AKIA[A-Z0-9]{16,}")  # runs are maximal, so the shorter ones are those that fail
HEX = re.compile(r"[0-9a-f]{24,}")
TOKEN = re.compile(r"(?<![A-Za-z0-9+/_=.-])[A-Za-z0-9+/_=.-]{6,}")
_DIGIT, _OTHER, _TURN, _VALUE = re.compile("[0-9]"), re.compile("[A-Za-z+/_=-]"), re.compile("[a-z][A-Z]"), re.compile(r"[:=][\"']?\x20{0,2}[\"']?$")
MODEL = "model"

CHUNK_ROWS = 20_000  # labelled candidates that a task fits at a time, about; all take part
EPOCHS = 12
VARIANTS = 4_000  # of each kind, made of a chunk
BINS = 4_096  # scores before calibration are counted in steps of one part in so many
ALPHABETS = tuple(string.ascii_letters + string.digits + x for x in ("", "", "_-", "+/")) + ("0123456789abcdef", "0123456789ABCDEF", string.ascii_lowercase + string.digits, string.ascii_uppercase + string.digits)
RECALL = 0.98
BEFORE, INSIDE, AFTER = 24, 40, 8
LENGTH = BEFORE + INSIDE + AFTER
FILTERS, WIDTH, EMBED = 24, 5, 8
LEFT_OUT = 64  # candidates scored at a time
SEED = 7


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start, then kind as listed."""
    out = []
    low = text.lower()
    if any(k in low for k in KEYS):
        out += [("assign", m.start(), m.end()) for m in ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", m.start(), m.end()) for m in ACCESS.finditer(text)]
    out += [("hex", m.start(), m.end()) for m in HEX.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0])))


def candidates(text: str) -> list[tuple[int, int]]:
    """(start, end) of the tokens that the network is to see."""
    out = []
    for m in TOKEN.finditer(text):
        a, b = m.span()
        t = m[0]
        if (b - a >= 8 and _DIGIT.search(t) and _OTHER.search(t)) or (b - a >= 12 and _TURN.search(t)) or (a and _VALUE.search(text[max(0, a - 5) : a])):
            out.append((a, b))
    return out


def windows(start: int, end: int) -> list[tuple[int, int]]:
    """Overlapping parts of a candidate that together show all of it; itself, if it is short enough for one."""
    if end - start <= INSIDE:
        return [(start, end)]
    return [(min(a, end - INSIDE), min(a, end - INSIDE) + INSIDE) for a in range(start, end - INSIDE // 2, INSIDE // 2)]


def encode(text: str, start: int, end: int) -> np.ndarray:
    """Codes of the characters before (right-aligned), inside (at most INSIDE of them) and after; 0 pads."""
    a, b, c = text[max(0, start - BEFORE) : start], text[start:end], text[end : end + AFTER]
    s = a.rjust(BEFORE, "\0") + b.ljust(INSIDE, "\0") + c.ljust(AFTER, "\0")
    codes = np.frombuffer(s.encode("utf-32-le", "surrogatepass"), np.uint32)
    return np.where(codes < 127, codes, 127).astype(np.int64)


class CharNetwork:
    """Embedding, one convolution (with the part of the input that a place is in), max over each part, logistic output."""

    PARTS = np.repeat([0, 1, 2], [BEFORE, INSIDE, AFTER])

    def __init__(self, seed: int = SEED):
        r = np.random.default_rng(seed)
        self.p = {
            "e": r.normal(0, 0.3, (128, EMBED)), "w": r.normal(0, 0.25, (WIDTH * EMBED, FILTERS)), "b": np.zeros(FILTERS),
            "o": r.normal(0, 0.2, 3 * FILTERS), "c": np.zeros(1),
        }
        self.scale, self.shift, self.threshold = 1.0, 0.0, 2.0

    def forward(self, x: np.ndarray) -> tuple:
        e = np.pad(self.p["e"][x], ((0, 0), (WIDTH // 2, WIDTH // 2), (0, 0)))
        cols = np.concatenate([e[:, i : i + LENGTH] for i in range(WIDTH)], axis=2)
        a = cols @ self.p["w"] + self.p["b"]
        tops = [a[:, self.PARTS == k].argmax(1) + np.flatnonzero(self.PARTS == k)[0] for k in range(3)]
        top = np.stack(tops, 1)
        h = np.maximum(np.take_along_axis(a, top, 1), 0)
        return cols, top, h, h.reshape(len(x), -1) @ self.p["o"] + self.p["c"][0]

    def fit(self, x: np.ndarray, y: np.ndarray, epochs: int = EPOCHS, rate: float = 0.01, seed: int = SEED) -> None:
        r, m, v, t = np.random.default_rng(seed), {k: 0.0 for k in self.p}, {k: 0.0 for k in self.p}, 0
        weight = np.where(y > 0, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum())) * len(y)
        for _ in range(epochs):
            order = r.permutation(len(x))
            for at in range(0, len(x), 64):
                i = order[at : at + 64]
                cols, top, h, z = self.forward(x[i])
                d = (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y[i]) * weight[i] / len(i)
                dh = (d[:, None] * self.p["o"]).reshape(h.shape) * (h > 0)
                picked = np.take_along_axis(cols, top[:, :, :, None].reshape(len(i), -1, 1), 1).reshape(*h.shape, -1)
                g = {"o": h.reshape(len(i), -1).T @ d, "c": np.array([d.sum()]), "b": dh.sum((0, 1)), "w": np.einsum("nkfc,nkf->cf", picked, dh), "e": np.zeros_like(self.p["e"])}
                back = np.einsum("nkf,cf->nkfc", dh, self.p["w"]).reshape(*h.shape, WIDTH, EMBED)
                padded = np.pad(x[i], ((0, 0), (WIDTH // 2, WIDTH // 2)), constant_values=-1)
                for j in range(WIDTH):
                    at_char = np.take_along_axis(padded, (top + j).reshape(len(i), -1), 1).reshape(h.shape)
                    real = at_char >= 0
                    np.add.at(g["e"], at_char[real], back[..., j, :][real])
                t += 1
                for k, q in self.p.items():
                    m[k] = 0.9 * m[k] + 0.1 * g[k]
                    v[k] = 0.999 * v[k] + 0.001 * g[k] ** 2
                    q -= rate * (m[k] / (1 - 0.9**t)) / (np.sqrt(v[k] / (1 - 0.999**t)) + 1e-8)

    def calibrate(self, x: np.ndarray, y: np.ndarray, recall: float) -> None:
        """Platt scaling on held-out rows, then the threshold: even odds, or less if the recall asked for needs it."""
        self.settle(self.forward(x)[3], y, np.ones(len(y)), recall)

    def settle(self, z: np.ndarray, y: np.ndarray, n: np.ndarray, recall: float) -> None:
        """`calibrate` from outputs z, labels y and how often each of the pairs is there."""
        good, bad = float(n[y > 0].sum()), float(n[y == 0].sum())
        target = np.where(y > 0, (good + 1) / (good + 2), 1 / (bad + 2))
        mean = lambda v: float((v * n).sum() / n.sum())
        square = mean(z * z)
        for _ in range(200):
            d = 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30))) - target
            self.scale -= 0.1 * mean(d * z) / (1 + square)
            self.shift -= 0.5 * mean(d)
        score = 1 / (1 + np.exp(-np.clip(self.scale * z[y > 0] + self.shift, -30, 30)))
        order = np.argsort(score, kind="stable")
        below = np.cumsum(n[y > 0][order])
        self.threshold = min(0.5, float(score[order][np.searchsorted(below, int((1 - recall) * good), "right")])) if good else 2.0

    def score(self, x: np.ndarray) -> np.ndarray:
        parts = [self.forward(x[i : i + LEFT_OUT])[3] for i in range(0, len(x), LEFT_OUT)]
        z = np.concatenate(parts) if parts else np.empty(0)
        return 1 / (1 + np.exp(-np.clip(self.scale * z + self.shift, -30, 30)))


def _labelled(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """One row per part of a candidate: its codes as bytes and whether a fixed pattern's span meets it."""
    for batch in batches:
        codes, found = [], []
        for text in batch.column("text").to_pylist():
            if text:
                spans = base_spans(text)
                for a, b in (w for c in candidates(text) for w in windows(*c)):
                    codes.append(encode(text, a, b).astype(np.uint8).tobytes())
                    found.append(any(s < b and a < e for _, s, e in spans))
        yield pa.RecordBatch.from_arrays([pa.array(codes, pa.binary()), pa.array(found, pa.bool_())], ["codes", "found"])


def with_variants(x: np.ndarray, y: np.ndarray, seed: int = SEED, variants: int = VARIANTS) -> tuple[np.ndarray, np.ndarray]:
    """The examples, each once more without what stands before it, and `variants` of either label whose values are made anew."""
    r = np.random.default_rng(seed)
    inside = BEFORE + INSIDE
    text = lambda codes: "".join(map(chr, codes[codes > 0]))
    clean = x[y == 0] if (y == 0).any() else x
    words = sorted({w.lower() for row in clean for w in re.findall("[A-Za-z]{2,9}", text(row[:BEFORE]))}) or ["word"]
    word = lambda: words[r.integers(len(words))]

    def value(secret: bool) -> str:
        if secret:
            head = f"{word()[:4]}_" if r.random() < 0.15 else ""
            return head + "".join(r.choice(list(ALPHABETS[r.integers(len(ALPHABETS))]), int(r.integers(16, INSIDE + 1 - len(head)))))
        parts = [word() for _ in range(r.integers(1, 5))]
        if r.random() < 0.6:
            parts[int(r.integers(len(parts)))] += str(r.integers(10 ** int(r.integers(1, 5))))
        if r.random() < 0.3:
            parts = [w.capitalize() for w in parts]
        kind = r.random()
        if kind < 0.15:
            return "-".join(str(r.integers(10 ** int(r.integers(1, 5)))) for _ in range(r.integers(2, 5)))
        return str(r.choice(["", "-", "_", ".", "/"])).join(parts) if kind < 0.8 else parts[0] + "".join(w.capitalize() for w in parts[1:])

    made, labels = [], []
    for i in range(2 * variants):
        context = clean[r.integers(len(clean))].copy()
        before, kind = text(context[:BEFORE]), r.random()
        before = "" if kind < 0.25 else f"{before}{word()}{r.choice([': ', '=', ' = ', ': \"'])}" if kind < 0.5 else before
        v = value(i % 2 == 0)
        made.append(encode(before + v + text(context[inside:]), len(before), len(before) + min(INSIDE, len(v))))
        labels.append(float(i % 2 == 0))
    bare = x.copy()
    bare[:, :BEFORE] = 0
    return np.concatenate([x, bare, made]), np.concatenate([y, y, labels])


def _examples(rows: pa.Table) -> tuple[np.ndarray, np.ndarray]:
    """Codes and labels of a chunk, in an order of their own so that reruns agree."""
    both = sorted(zip(rows.column("codes").to_pylist(), rows.column("found").to_pylist(), strict=True))
    return np.array([np.frombuffer(c, np.uint8) for c, _ in both], np.int64).reshape(-1, LENGTH), np.array([f for _, f in both], float)


def _fit_chunk(weights, epochs: int, turn: int, variants: int):
    def run(rows: pa.Table) -> pa.Table:
        net, chunk = CharNetwork(), rows.column("chunk")[0].as_py()
        net.p = {k: v.copy() for k, v in weights.value.items()}
        net.fit(*with_variants(*_examples(rows), SEED + 2 * chunk, variants), epochs=epochs, seed=SEED + turn)
        return pa.table({"chunk": pa.array([chunk], pa.int64()), "n": pa.array([rows.num_rows], pa.int64()), "weights": pa.array([pickle.dumps(net.p)], pa.binary())})

    return run


def _count_outputs(network, variants: int):
    def run(rows: pa.Table) -> pa.Table:
        x, y = with_variants(*_examples(rows), SEED + 2 * rows.column("chunk")[0].as_py() + 1, variants)
        outputs = np.concatenate([network.value.forward(x[i : i + LEFT_OUT])[3] for i in range(0, len(x), LEFT_OUT)])
        bins, n = np.unique(np.stack([np.rint(np.clip(outputs, -40, 40) * BINS), y]), axis=1, return_counts=True)
        return pa.table({"bin": pa.array(bins[0].astype(np.int64)), "found": pa.array(bins[1] > 0), "n": pa.array(n.astype(np.int64))})

    return run


def train_network(spark: SparkSession, docs: DataFrame, text_col: str = "text", chunk_rows: int = CHUNK_ROWS, recall: float = RECALL) -> CharNetwork:
    """Fitted on all distinct labelled candidates and on variants of them; a fifth is held out, with variants of its own, for calibration.

    Candidates are dealt by hash to chunks of about chunk_rows. Of more than one chunk, each is fitted for an epoch from common weights, which are
    averaged by rows after it. The driver holds one set of weights (17 KB) for each chunk, and counts of the held-out rows' outputs by bin and label.
    """
    small_batches(spark)
    rows = docs.select(F.col(f"`{text_col.replace('`', '``')}`").cast("string").alias("text")).mapInArrow(_labelled, "codes binary, found boolean")
    scratch, net = Scratch(spark), CharNetwork()
    held = F.conv(F.substring(F.md5("codes"), 1, 2), 16, 10).cast("int") % 5 == 0
    seen = scratch.write(rows.groupBy("codes").agg(F.max("found").alias("found")).withColumn("held", held), "candidates")
    size = {(r["held"], r["found"]): r["count"] for r in seen.groupBy("held", "found").count().collect()}
    variants = min(VARIANTS, max(500, chunk_rows))
    sent = lambda value: spark.sparkContext.broadcast(value)

    def chunks(part: bool):
        n = max(1, math.ceil((size.get((part, True), 0) + size.get((part, False), 0)) / chunk_rows))
        return n, seen.where(F.col("held") == part).select("codes", "found", F.pmod(F.xxhash64("codes"), F.lit(n)).cast("long").alias("chunk")).repartition(n, "chunk").groupBy("chunk")

    if all((False, label) in size for label in (True, False)):
        n, dealt = chunks(False)
        for turn in range(1 if n == 1 else EPOCHS):
            fitted = dealt.applyInArrow(_fit_chunk(sent(net.p), EPOCHS if n == 1 else 1, turn, variants), "chunk long, n long, weights binary").collect()
            fitted = [(r["n"], pickle.loads(r["weights"])) for r in sorted(fitted, key=lambda r: r["chunk"])]
            net.rows = sum(k for k, _ in fitted)
            net.p = {name: sum(k * p[name] for k, p in fitted) / net.rows for name in net.p}
        if all((True, label) in size for label in (True, False)):
            counted = chunks(True)[1].applyInArrow(_count_outputs(sent(net), variants), "bin long, found boolean, n long").groupBy("bin", "found").agg(F.sum("n").alias("n")).orderBy("bin", "found").collect()
            net.settle(*[np.array([f(r) for r in counted], float) for f in (lambda r: r["bin"] / BINS, lambda r: r["found"], lambda r: r["n"])], recall)
    scratch.drop(seen)
    return net


def _scan(network, name: str):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        net = network.value
        for batch in batches:
            base, loose, codes = [], [], []
            for d, text in enumerate(batch.column("text").to_pylist()):
                base.append(base_spans(text or ""))
                for c in candidates(text or ""):
                    if not any(s < c[1] and c[0] < e for _, s, e in base[d]):
                        for a, b in windows(*c):
                            loose.append((d, *c))
                            codes.append(encode(text, a, b).astype(np.uint8))
            added: list[set] = [set() for _ in base]
            for (d, a, b), p in zip(loose, net.score(np.array(codes, np.uint8).reshape(-1, LENGTH)), strict=True):
                if p >= net.threshold:
                    added[d].add((MODEL, a, b))
            order = (*KINDS, MODEL)
            spans = [[{"kind": k, "start": s, "end": e} for k, s, e in sorted([*x, *y], key=lambda z: (z[1], order.index(z[0])))] for x, y in zip(base, added, strict=True)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))], [*batch.schema.names, name])

    return run


def find_secrets(spark: SparkSession, docs: DataFrame, network: CharNetwork, text_col: str = "text", name: str = "spans") -> DataFrame:
    """docs and all their columns, with an array of spans (kind, start, end in code points) by start, then kind.

    Kinds are those of the fixed patterns and `model` for a candidate that the network adds, by the highest score of its parts; one
    that meets a span of a fixed pattern adds none. Null and empty texts have no spans. A column of docs named like `name` is replaced.
    A network without training data adds nothing. Every candidate of the whole text is scored.
    """
    small_batches(spark)
    span = T.StructType([T.StructField("kind", T.StringType()), T.StructField("start", T.LongType()), T.StructField("end", T.LongType())])
    return map_texts(docs, text_col, _scan(spark.sparkContext.broadcast(network), name), **{name: T.ArrayType(span)})


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", F.col("text").cast("string").alias("text"))
    found = find_secrets(spark, docs, train_network(spark, docs))
    said = lambda only: F.array_join(F.transform(F.filter("spans", only), lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return found.select("doc_id", *map(of, KINDS), F.sha2(said(lambda s: s["kind"] != MODEL), 256).alias("base_sha256"), said(lambda s: F.lit(True)).alias("spans"))
