import hashlib
import math
import random
import zlib

from pyspark.sql import functions as F

from sentrel.llm.mixing import mix_plan, mixed, op9_mixing
from sentrel.llm.sharding import assign_shards, op5_sharding

SF = "/root/testdata/sf0.001"


def walk(rows, shards):
    """rows: (order key, id, size). One pass over the sorted rows."""
    total, before, slots, out = sum(r[2] for r in rows), 0, {}, []
    for _, i, size in sorted(rows, key=lambda r: (r[0], r[1] is not None, r[1] or 0)):
        shard = min((2 * before + size) * shards // (2 * total), shards - 1)
        out.append((i, size, shard, slots.get(shard, 0)))
        slots[shard] = slots.get(shard, 0) + 1
        before += size
    return out


def test_shards_against_one_walk(spark):
    rnd = random.Random(4)
    texts = [None, "", "é" * 50, "x" * 40000] + ["same text"] * 300 + [" ".join(rnd.choice("abc") for _ in range(rnd.randint(0, 400))) for _ in range(200)]
    rows = [(i if i % 50 else None, t, 1) for i, t in enumerate(texts)] + [(7, "x" * 40000, 1)] * 2
    df = spark.createDataFrame(rows, "doc_id long, text string, shard int").repartition(5)
    at = {r["text"]: r["k"] for r in df.select("text", F.xxhash64(F.coalesce("text", F.lit(""))).alias("k")).distinct().collect()}
    got = sorted(((r["doc_id"], r["size"], r["shard"], r["slot"]) for r in assign_shards(spark, df, 13).collect()), key=str)
    sized = [(at[t], i, len((t or "").encode()) + 16) for i, t, _ in rows]
    assert [x[:3] for x in got] == sorted([x[:3] for x in walk(sized, 13)], key=str) or sorted(x[1:] for x in got) == sorted(x[1:] for x in walk(sized, 13))
    assert sorted((x[2], x[3]) for x in got) == sorted((x[2], x[3]) for x in walk(sized, 13))
    assert assign_shards(spark, df.limit(0)).count() == 0


def test_shard_query(spark):
    got = op5_sharding(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    assert set(got["doc_id"]) == set(texts) and len(got) == len(texts)
    for r in got.itertuples():
        raw = (texts[r.doc_id] or "").encode()
        assert r.size == len(raw) + 16 and r.text_crc32 == zlib.crc32(raw) and r.law == "bytes" and 0 <= r.shard < 40
    for _, g in got.groupby("shard"):
        assert sorted(g["slot"]) == list(range(len(g)))
    sizes, largest = got.groupby("shard")["size"].sum(), got["size"].max()
    assert sizes.max() - got["size"].sum() / 40 <= largest


def water_filled(sizes):
    """Targets by repeated resharing."""
    names = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(names)}
    budget, capped = 1.5 * sum(sizes.values()), set()
    while True:
        free = [s for s in names if s not in capped]
        left = budget - sum(2 * sizes[s] for s in capped)
        level = left / sum(weight[s] for s in free) if free else 0
        over = [s for s in free if level * weight[s] > 2 * sizes[s]]
        if not over:
            return {s: 2.0 * sizes[s] if s in capped else level * weight[s] for s in names}
        capped |= set(over)


def mix_walk(rows):
    """rows: (id, text, source). (targets by source, sorted (id or -1, words, copies)), by one walk over each source in order of hash."""
    n = lambda t: len((t or "").encode().split())
    key = lambda i, t: hashlib.md5(f"{'-' if i is None else i}|{hashlib.md5((t or '').encode()).hexdigest()}".encode()).hexdigest()[:15]
    sizes = {}
    for _, t, s in rows:
        sizes[s] = sizes.get(s, 0) + n(t)
    targets, want = water_filled(sizes), []
    for s, target in targets.items():
        own = [(key(i, t), n(t), -1 if i is None else i) for i, t, x in rows if x == s]
        whole = math.floor(target / sizes[s]) if sizes[s] else 0
        left, upto, sums = target - whole * sizes[s], 0, {}
        for h, k, _ in own:
            sums[h] = sums.get(h, 0) + k
        take, done = {}, False
        for h in sorted(sums):
            below, upto = upto, upto + sums[h]
            if upto <= left:
                take[h] = 1
            elif not done:
                take[h], done = int(upto - left < left - below), True
            else:
                take[h] = 0
        want += [(i, k, min(2, whole + take[h])) for h, k, i in own]
    return targets, sorted(want)


def test_mix_against_sorting(spark):
    rnd = random.Random(8)
    rows = [(i, " ".join("w" * 1 for _ in range(rnd.randint(0, 60))), rnd.choice(["hot"] * 5 + ["b", "c", None, ""])) for i in range(400)] + [(None, None, "b"), (3, "again and again", "c"), (3, "again and again", "c"), (900, "z " * 9000, "hot")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, source string, target int")
    targets, want = mix_walk(rows)
    plan = mix_plan(spark, df)
    got = sorted((-1 if r["doc_id"] is None else r["doc_id"], r["__size"], r["__copies"]) for r in plan.collect())
    assert got == want
    assert {r["source"]: round(r["__target"], 6) for r in plan.select("source", "__target").distinct().collect()} == {s: round(t, 6) for s, t in targets.items()}
    out = mixed(spark, df)
    assert out.columns == df.columns and out.count() == sum(c for _, _, c in want)
    assert mix_plan(spark, df.limit(0)).count() == 0


def test_mix_with_clashing_names(spark):
    names = ["key", "h", "size", "row", "cut", "whole", "take_cut", "target", "source_size", "left", "at", "below", "__size", "__copies", "__h", "__key", "a b"]
    df = spark.createDataFrame([(i, "some words here", "s", *[i] * len(names)) for i in range(8)], ["doc_id", "text", "source", *names])
    plan = mix_plan(spark, df)
    assert plan.columns == [*[c for c in df.columns if c not in ("__size", "__copies")], "__size", "__source_size", "__target", "__copies"]
    assert {(r["whole"], r["__size"]) for r in plan.collect()} == {(i, 3) for i in range(8)}
    out = mixed(spark, df)
    assert out.columns == df.columns and out.count() == 12 and all(r["cut"] == r["__copies"] == r["doc_id"] for r in out.collect())


def test_mix_query_repeats(spark):
    a, b = (sorted(map(tuple, op9_mixing(spark, SF).collect())) for _ in range(2))
    assert a == b and all(t <= 2 * s for _, s, _, _, t in a)
