from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline as cp
from sentrel.llm import language_id, secrets, token_counts
from sentrel.llm.decontaminate import find_contamination
from sentrel.llm.line_dedup import remove_repeated_lines
from sentrel.llm.ngram_join import first_of_each_group
from sentrel.llm.quality import KEEP_FROM

from sentrel.scratch import shared_dir

from .test_decontaminate import brute as contaminated
from .test_models import quality_by_hand
from .test_ngram_join import brute as groups
from .test_sharding_mixing import mix_walk, walk

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def steps(spark, tmp_path_factory):
    """Each stage's result, written and read again."""
    docs, out = spark.read.parquet(f"{SF}/documents.parquet"), {}
    out["start"] = docs
    for name, f in cp.STAGES:
        path = str(tmp_path_factory.mktemp("stage") / name)
        f(spark, docs, SF).write.parquet(path)
        out[name] = docs = spark.read.parquet(path)
    return out


def test_columns_and_names(steps):
    own = steps["start"].columns
    assert [n for n, _ in cp.STAGES] == ["quality", "near_duplicates", "decontamination", "mixing", "sharding"]
    assert all(steps[n].columns == own for n, _ in cp.STAGES[:-1]) and steps["sharding"].columns == [*own, "shard", "slot"]


def test_only_the_result_stays(spark, steps):
    """Of all that a run writes to the shared folder, the last table."""
    files = lambda: {str(p): p.stat().st_size for p in Path(shared_dir(spark).removeprefix("file://")).rglob("*.parquet")}
    before = files()
    out = cp.run(spark, SF)
    left = {p: n for p, n in files().items() if p not in before}
    assert left and all("/sharding-" in p for p in left)
    assert sum(left.values()) < 1.5 * sum(p.stat().st_size for p in Path(f"{SF}/documents.parquet").parent.glob("documents.parquet")) + 50_000
    assert out.count() == steps["sharding"].count()


def ids(df):
    return sorted(r["doc_id"] for r in df.select("doc_id").collect())


def test_each_stage_on_its_own_input(spark, steps):
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    rows = [(r["doc_id"], r["text"], r["source"], r["lang"]) for r in steps["start"].collect()]
    judged = quality_by_hand(rows, [(r["doc_id"], r["quality"]) for r in labels.collect()])
    assert ids(steps["quality"]) == sorted(i for i, *_, p in judged if p >= KEEP_FROM)
    known = {r["doc_id"] for r in labels.where("quality = 1").collect()} & set(ids(steps["start"]))
    assert len(known & set(ids(steps["quality"]))) >= 0.98 * len(known)

    rows = [(r["doc_id"], r["text"]) for r in steps["quality"].collect()]
    assert ids(steps["near_duplicates"]) == [i for i, _, c in sorted(groups(rows)) if i == c]

    items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{SF}/benchmark.parquet").collect()]
    rows = [(r["doc_id"], r["text"]) for r in steps["near_duplicates"].collect()]
    hit = contaminated([t for _, t in rows], items)
    assert ids(steps["decontamination"]) == sorted(i for i, t in rows if not hit[t][1]) and any(h[1] for h in hit.values())

    rows = [(r["doc_id"], r["text"], r["source"]) for r in steps["decontamination"].collect()]
    assert ids(steps["mixing"]) == sorted(i for i, _, c in mix_walk(rows)[1] for _ in range(c))

    rows = steps["mixing"].select("doc_id", F.xxhash64(F.coalesce("text", F.lit(""))).alias("at"), F.octet_length(F.coalesce("text", F.lit(""))).alias("n")).collect()
    placed = sorted((r["doc_id"], r["shard"], r["slot"]) for r in steps["sharding"].collect())
    assert placed == sorted((i, shard, slot) for i, _, shard, slot in walk([(r["at"], r["doc_id"], r["n"] + 16) for r in rows], 40))


def test_run_is_the_stages(spark, steps):
    key = lambda df: sorted(map(str, df.select("doc_id", "shard", "slot").collect()))
    assert key(cp.run(spark, SF)) == key(steps["sharding"])


ODD = ("shard", "p_doc", "x", "row", "id", "size", "at", "part", "key", "__spans", "__copies", "__size", "cut", "first", "a b", "a.b", "c`d")


def test_odd_rows_and_clashing_columns(spark, tmp_path):
    rows = [(None, None, None, None, 0), (1, "", "en", "s", 0), (1, "words to keep here", "en", "s", 1), (2, "words to keep here", None, None, 1)]
    docs = spark.createDataFrame([(*r, *[f"own {c}" for c in ODD]) for r in rows], ["doc_id", "text", "lang", "source", "n_chars", *ODD])
    docs = docs.withColumn("doc_id", F.col("doc_id").cast("long"))
    for k, (_, f) in enumerate(cp.STAGES):
        f(spark, docs, SF).write.parquet(str(tmp_path / str(k)))
        docs = spark.read.parquet(str(tmp_path / str(k)))
    assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars", *ODD[1:], "shard", "slot"]
    got = docs.collect()
    assert {r["text"] for r in got} == {"words to keep here"} and all(r[c] == f"own {c}" for r in got for c in ODD[1:])


def test_operators_keep_any_columns(spark):
    names = [c for c in ODD if not set(c) & set("`.")]  # which mapInArrow doesn't take
    docs = spark.createDataFrame([(1, "token = abcdef12 and more", *names), (2, None, *names)], ["doc_id", "text", *names])
    bench = spark.createDataFrame([(1, "token abcdef12 and")], "item_id long, text string")
    model = language_id.PieceModel(["en"], {"a": 1}, np.full((2, 1), 0.5), np.array([1.0]))
    for out, more in (
        (token_counts.count_tokens(spark, docs), ["n_words", "n_tokens"]), (find_contamination(spark, docs, bench), ["words", "spans", "items"]),
        (secrets.find_secrets(spark, docs, secrets.CharNetwork()), ["spans"]), (language_id.identify_languages(spark, docs, model), ["lang_pred", "score"]),
        (remove_repeated_lines(spark, docs), ["n_lines", "n_removed"]), (first_of_each_group(spark, docs), []),
    ):
        assert out.columns == ["doc_id", "text", *names, *more]
        assert sorted((r["doc_id"], *[r[c] for c in names]) for r in out.collect()) == [(1, *names), (2, *names)]
