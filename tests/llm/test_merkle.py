import random
import zlib
from hashlib import sha256

import pytest
from pyspark.sql import functions as F

from sentrel.llm import merkle
from sentrel.llm.merkle import fold, merkle_manifest


def h(*parts):
    return sha256("".join(parts).encode()).hexdigest()


def leaf(*values):
    return h(*("-" if v is None else f"{len(str(v).encode())}:{v}" for v in values))


def levels(nodes):
    out = [nodes]
    while len(out[-1]) > 1:
        out.append([h(*out[-1][i : i + 16]) for i in range(0, len(out[-1]), 16)])
    return out


def siblings(tree, i):
    out = []
    for nodes in tree[:-1]:
        first = i // 16 * 16
        out.append((i % 16, nodes[first:i] + nodes[i + 1 : first + 16]))
        i //= 16
    return out


def by_hand(rows):
    """rows: (doc_id, source, lang, n_chars, text) -> sorted (doc_id, leaf, subroot, root, proof hash, proof)."""
    groups = {}
    for r in rows:
        groups.setdefault(r[1], []).append((r[0] is not None, r[0] or 0, leaf(*r), r[0]))
    names = sorted(groups, key=lambda s: (s is not None, (s or "").encode()))
    trees = {s: levels([x[2] for x in sorted(groups[s], key=lambda x: x[:3])]) for s in names}
    top = levels([trees[s][-1][0] for s in names])
    out = []
    for k, s in enumerate(names):
        for i, x in enumerate(sorted(groups[s], key=lambda x: x[:3])):
            proof = siblings(trees[s], i) + siblings(top, k)
            out.append((x[3], x[2], trees[s][-1][0], top[-1][0], h(*[d for _, ds in proof for d in ds]), proof))
    return out


def rows_of(sizes, seed=1):
    rnd, out, i = random.Random(seed), [], 0
    for source, n in sizes:
        for _ in range(n):
            i += rnd.randint(1, 3)
            out.append((None if i % 97 == 0 else i, source, rnd.choice(("en", None, "é")), rnd.choice((None, 5)), rnd.choice((None, "", "Text É %d" % i, "x" * 3000))))
    rnd.shuffle(out)
    return out


SCHEMA = "doc_id long, source string, lang string, n_chars long, text string"


@pytest.mark.parametrize("block", [3, 1])
def test_against_trees_by_hand(spark, monkeypatch, block):
    monkeypatch.setattr(merkle, "BLOCK_LEVELS", block)
    rows = rows_of([(None, 17), ("", 1), ("a", 300), ("Z", 16), ("é", 2), ("b", 700), ("one", 1)] + [("s%03d" % i, 1 + i % 3) for i in range(40)])
    rows += [rows[0]] * 20 + [(rows[1][0], *rows[1][1:4], "other")]
    got = merkle_manifest(spark, spark.createDataFrame(rows, SCHEMA).repartition(6), proofs=True).collect()
    found = [(r["row"]["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"], [(p["at"], p["siblings"]) for p in r["proof"]]) for r in got]
    assert sorted(found, key=repr) == sorted(by_hand(rows), key=repr)
    assert all(r["folded_root"] == r["root"] == fold(r["leaf"], [(p["at"], p["siblings"]) for p in r["proof"]]) for r in got)


@pytest.mark.parametrize("sizes", [[("only", 1)], [("only", 16)], [("only", 17)], [(None, 1), ("x", 257)]])
def test_small_shapes(spark, sizes):
    rows = rows_of(sizes, 3)
    got = merkle_manifest(spark, spark.createDataFrame(rows, SCHEMA)).collect()
    assert sorted(((r["row"]["doc_id"], r["leaf"], r["subroot"], r["root"], r["proof_sha256"]) for r in got), key=repr) == sorted((x[:5] for x in by_hand(rows)), key=repr)


def test_a_changed_value_shows(spark):
    rows = rows_of([("a", 40), ("b", 5)])
    df = spark.createDataFrame(rows, SCHEMA).withColumn("a.b`c", F.lit(1)).withColumn("g", F.lit(2)).withColumn("idx", F.lit(3))
    got = merkle_manifest(spark, df, claimed={"text": F.when(F.col("doc_id") % 2 == 0, F.upper("text")).otherwise(F.col("text"))}, keep=tuple(df.columns)).collect()
    assert len(got) == 45
    for r in got:
        text, i = r["row"]["text"], r["row"]["doc_id"]
        assert (r["folded_root"] == r["root"]) == (i is None or i % 2 == 1 or text is None or text.upper() == text) and r["row"]["a.b`c"] == 1


def test_nothing(spark):
    assert merkle_manifest(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_query_finds_what_was_tampered_with(spark):
    sf = "/root/testdata/sf0.001"
    docs = {r["doc_id"]: r for r in spark.read.parquet(f"{sf}/documents.parquet").collect()}
    got = merkle.op12_merkle_manifest(spark, sf).collect()
    assert sorted(r["doc_id"] for r in got) == sorted(docs)
    for r in got:
        text = docs[r["doc_id"]]["text"]
        touched = zlib.crc32(str(r["doc_id"]).encode()) % 5 == 0 and any("A" <= c <= "Z" for c in text or "")
        assert r["verified"] is (not touched)
