import random

from sentrel.llm.token_counts import START, LongestMatch, count_tokens, load_pieces


def brute(word, pieces):
    """Longest piece first, by slicing."""
    n = 0
    while word:
        k = next((k for k in range(len(word), 0, -1) if word[:k] in pieces), 0)
        n += 1 if k else len(word[0].encode())
        word = word[k or 1:]
    return n


def test_automaton_against_slicing():
    rnd = random.Random(3)
    for _ in range(200):
        pieces = {"".join(rnd.choice("abc") for _ in range(rnd.randint(1, 6))) for _ in range(rnd.randint(1, 12))}
        auto = LongestMatch(list(pieces))
        for _ in range(20):
            word = "".join(rnd.choice("abcd€") for _ in range(rnd.randint(0, 20)))
            assert auto.count(word) == brute(word, pieces), (word, pieces)


def test_query_against_slicing(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet("/root/testdata/sf0.001/documents.parquet").select("doc_id", "text").limit(40).collect()]
    rows += [(-1, None), (-2, ""), (-3, "  \t\n"), (-4, "x" * 30000 + " €uro 漢字   end"), (-4, "x" * 30000), (None, "one")]
    docs = spark.createDataFrame([(i, t, "clash") for i, t in rows], "doc_id long, text string, n_tokens string")
    pieces = set(load_pieces())
    words = lambda t: [w.decode() for w in (t or "").encode().split()]
    out = count_tokens(spark, docs)
    assert out.columns == ["doc_id", "text", "n_words", "n_tokens"]
    got = sorted(((r["doc_id"], r["n_words"], r["n_tokens"]) for r in out.collect()), key=str)
    cut = {w: brute(START + w, pieces) for _, t in rows for w in words(t) if len(w) < 100}
    want = [(i, len(words(t)), sum(cut[w] if w in cut else LongestMatch(list(pieces)).count(START + w) for w in words(t))) for i, t in rows]
    assert got == sorted(want, key=str)
    assert count_tokens(spark, docs.limit(0)).count() == 0
