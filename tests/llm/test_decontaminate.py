import random

from hypothesis import given, settings
from hypothesis import strategies as st

from sentrel.llm.decontaminate import Windows, cut_benchmark, find_contamination, items_digest, without_benchmark, words_of


def brute(docs, items, k=10):
    """text -> (hit words, items), window by window."""
    windows = {}
    for item, t in items:
        w = words_of(t)
        m = min(k, len(w))
        for i in range(len(w) - m + 1 if w else 0):
            windows.setdefault(tuple(w[i : i + m]), set()).add(str(item))
    out = {}
    for t in docs:
        w, hit, found = words_of(t), set(), set()
        for g, own in windows.items():
            for i in range(len(w) - len(g) + 1):
                if tuple(w[i : i + len(g)]) == g:
                    hit |= set(range(i, i + len(g)))
                    found |= own
        out[t] = (len(w), len(hit), sorted(found))
    return out


@settings(max_examples=60, deadline=None)
@given(st.lists(st.text("ab ", max_size=25), max_size=5), st.lists(st.text("ab ", max_size=12), max_size=4), st.integers(1, 4))
def test_shard_search(docs, items, k):
    w = Windows(list(enumerate(items)), k)
    doc, start, which = w.find([words_of(d) for d in docs])
    got = {}
    for d, s, x in zip(doc.tolist(), start.tolist(), which.tolist(), strict=True):
        got.setdefault(docs[d], set()).update(range(s, s + int(w.lengths[x])))
    want = brute(docs, list(enumerate(items)), k)
    assert {d: len(got.get(d, ())) for d in docs} == {d: want[d][1] for d in docs}


def test_frame_and_passes(spark):
    rnd = random.Random(6)
    word = lambda: rnd.choice(["alpha", "beta", "Gamma", "delta9", "élan", "x", "y", "z"])
    items = [(i, " ".join(word() for _ in range(rnd.choice([0, 3, 10, 14])))) for i in range(12)] + [(99, None), (3, "another text of three"), (None, "x y z")]
    docs = [" ".join(word() for _ in range(rnd.randint(0, 60))) for _ in range(60)]
    docs += [f"{word()} {items[k][1].upper()}! {word()}" for k in range(12)] + [None, "", "-- !!", "x " * 20000 + items[2][1]]
    df = spark.createDataFrame([(i, t, "c") for i, t in enumerate(docs)], "doc_id long, text string, spans string").repartition(3)
    bench = spark.createDataFrame(items, "item_id long, text string")
    want = brute(docs, [x for x in items if x[0] is not None and x[1] is not None])
    for pass_words in (10**6, 10):
        out = find_contamination(spark, df, bench, pass_words=pass_words)
        assert out.columns == ["doc_id", "text", "words", "spans", "items"]
        for r in out.collect():
            assert (r["words"], sum(s["end"] - s["start"] for s in r["spans"]), r["items"]) == want[r["text"]]
    clean = without_benchmark(spark, df, bench)
    assert clean.columns == df.columns and sorted(r["doc_id"] for r in clean.collect()) == [i for i, t in enumerate(docs) if not want[t][1]]
    assert without_benchmark(spark, df, bench.limit(0)).count() == len(docs) and find_contamination(spark, df.limit(0), bench).count() == 0
    assert items_digest([]) == "e3b0c44298fc1c149afbf4c8996fb92427ae41e4649b934ca495991b7852b855"


def test_spans_are_cut_out(spark):
    bench = spark.createDataFrame([(1, "one two three"), (2, "três quatro")], "item_id long, text string")
    texts = {"A, One-TWO  three! b": ("A, ! b", 3), "one two": ("one two", 0), "one two three": ("", 3), "x one two three três Quatro. (y)": ("x . (y)", 5), None: (None, 0), "": ("", 0), "a três quatro, b one two three": ("a , b ", 5)}
    df = spark.createDataFrame([(t, 1, "n") for t in texts], "`te.xt` string, spans int, n_cut string")
    got = cut_benchmark(spark, df, bench, "te.xt")
    assert got.columns == ["te.xt", "spans", "n_cut"] and sorted(((r["te.xt"], r["n_cut"], r["spans"]) for r in got.collect()), key=str) == sorted(((*v, 1) for v in texts.values()), key=str)
    again = find_contamination(spark, got, bench, "te.xt", names=("words", "found", "items"))
    assert again.where("size(found) > 0").count() == 0 and cut_benchmark(spark, df.limit(0), bench, "te.xt").count() == 0
    assert cut_benchmark(spark, df.select("`te.xt`"), bench, "te.xt").columns == ["te.xt", "n_cut"]
