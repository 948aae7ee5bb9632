import hashlib
import random

import numpy as np
from pyspark.sql import functions as F

from sentrel.llm.substring_dedup import BASES, Chunk, op11_substring_dedup, remove_repeated_windows, rolling


def by_hand(docs, k):
    """docs: (id, text bytes) in order. For each the flags of its words, by a set of all windows so far."""
    seen, out = set(), []
    for _, text in docs:
        words = (text or b"").split()
        gone = [False] * len(words)
        for i in range(len(words) - k + 1):
            w = tuple(words[i : i + k])
            if w in seen:
                gone[i : i + k] = [True] * k
            seen.add(w)
        out.append((words, gone))
    return out


def check(spark, rows, k, **how):
    df = spark.createDataFrame(rows, "doc_id long, text string, n_words string, `a.b` int, chunk int").repartition(5)
    got = remove_repeated_windows(spark, df, k, **how)
    assert got.columns == ["doc_id", "text", "a.b", "chunk", "n_words", "n_removed", "spans"]
    order = {r["text"]: r["k"] for r in df.select("text", F.xxhash64("text").alias("k")).distinct().collect()}
    docs = sorted(((r[0], r[1]) for r in rows), key=lambda r: (r[0] is not None, r[0] or 0, order[r[1]]))
    want = []
    for (i, text), (words, gone) in zip(docs, by_hand([(i, t if t is None else t.encode()) for i, t in docs], k), strict=True):
        kept = None if text is None else b" ".join(w for w, g in zip(words, gone, strict=True) if not g).decode()
        want.append((i, kept, len(words), sum(gone)))
    rows = got.collect()
    assert sorted(((r["doc_id"], r["text"], r["n_words"], r["n_removed"]) for r in rows), key=repr) == sorted(want, key=repr)
    for r in rows:
        assert r["n_removed"] == sum(s["end"] - s["start"] for s in r["spans"])
        assert all(a["end"] < b["start"] for a, b in zip(r["spans"], r["spans"][1:], strict=False))
    return rows


def corpus(seed):
    rnd = random.Random(seed)
    words = ["x%d" % i for i in range(40)] + ["é", "—", "A", "a", " nbsp"]
    passage = [rnd.choice(words) for _ in range(30)]
    docs = [None, "", " \t\n\x0b\x0c\r ", "one", " ".join(["again"] * 90), " ".join(passage[:7])]
    for _ in range(60):
        body = [rnd.choice(words) for _ in range(rnd.randint(0, 120))]
        if rnd.random() < 0.7:
            at, a = rnd.randint(0, len(body)), rnd.randint(0, 10)
            body[at:at] = passage[a : a + rnd.randint(4, 20)]
        docs.append(rnd.choice((" ", "\n", "  ")).join(body))
    return docs + docs[10:30] + [docs[12]] * 40 + [" ".join(rnd.choice(words) for _ in range(20_000))]


def test_against_a_set_of_windows(spark):
    docs = corpus(3)
    rows = [(i if i % 11 else None, t, "n", i, 1) for i, t in enumerate(docs)] + [(5, "same id " * 9, None, None, 2), (5, "same id " * 8, None, None, 3)] * 2
    for k, size in ((5, 1 << 20), (8, 700), (1, 2_000)):
        check(spark, rows, k, chunk_bytes=size)


def test_partitions_and_chunks_do_not_matter(spark):
    docs = corpus(5)
    df = spark.createDataFrame([(i, t) for i, t in enumerate(docs)], "doc_id long, text string")
    rows = [sorted(remove_repeated_windows(spark, df.repartition(n), 6, chunk_bytes=size).collect()) for n, size in ((1, 1), (9, 5_000), (3, 1 << 22))]
    assert rows[0] == rows[1] == rows[2]


def test_nothing(spark):
    df = spark.createDataFrame([], "doc_id long, text string")
    assert remove_repeated_windows(spark, df).count() == 0
    assert [tuple(r) for r in remove_repeated_windows(spark, spark.createDataFrame([(None, None)], "doc_id long, text string")).collect()] == [(None, None, 0, 0, [])]


def test_rolling_hash_is_the_polynomial():
    w = np.random.default_rng(0).integers(0, 2**63, 50).astype(np.uint64)
    want = [sum(int(x) * BASES[0] ** j for j, x in enumerate(w[i : i + 7])) % 2**64 for i in range(44)]
    assert rolling(w, 7, BASES[0]).tolist() == want
    chunk = Chunk([b"a b c", None, b"b c d a b c"], 3)
    assert chunk.at.tolist() == [0, 3, 4, 5, 6] and len(set(chunk.h.tolist())) == 4 and chunk.h[0] == chunk.h[-1]


def test_query(spark):
    sf = "/root/testdata/sf0.001"
    docs = sorted((r["doc_id"], (r["text"] or "").encode()) for r in spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect())
    want = {i: (len(w), sum(g), hashlib.sha256(b" ".join(x for x, y in zip(w, g, strict=True) if not y)).hexdigest()) for (i, _), (w, g) in zip(docs, by_hand(docs, 20), strict=True)}
    got = {r["doc_id"]: (r["n_words"], r["n_removed"], r["kept_sha256"]) for r in op11_substring_dedup(spark, sf).collect()}
    assert got == want and sum(v[1] for v in got.values()) > 0
