import random

from sentrel.llm.line_dedup import MIN_TEXTS, op2_line_dedup, remove_repeated_lines

SCHEMA = "doc_id long, text string, n_removed string"


def brute(rows, least):
    """Every pair of places is compared line by line; a run that overlaps the one further up counts to where it begins."""
    seqs = [(i, [x.strip() for x in t.split("\n") if x.strip()]) for i, t in sorted({(i, t) for i, t, _ in rows if t is not None}, key=lambda r: r[0])]
    places = [(d, k) for d, (_, s) in enumerate(seqs) for k in range(len(s))]
    gone = {i: set() for i, _ in seqs}
    for q, (d, k) in enumerate(places):
        for e, j in places[:q]:
            a, b, n = seqs[d][1][k:], seqs[e][1][j:], 0
            while n < min(len(a), len(b), k - j if d == e else len(a)) and a[n] == b[n]:
                n += 1
            if sum(len(x.split()) for x in a[:n]) >= least:
                gone[seqs[d][0]] |= set(range(k, k + n))
    return {i: [x for n, x in enumerate(s) if n not in gone[i]] for i, s in seqs}


def kept(df):
    return {r["doc_id"]: [x.strip() for x in r["text"].split("\n") if x.strip()] for r in df.collect() if r["text"] is not None}


def test_against_brute_force(spark):
    rnd = random.Random(5)
    for trial in range(3):
        pool = [" ".join(rnd.choice("abcdefg") for _ in range(rnd.randint(1, 5))) for _ in range(6)]
        rows = [(i, "\n".join(rnd.choice(pool + [f"u{i} {k}", ""]) for k in range(rnd.randint(0, 14))), "x") for i in range(12)]
        rows += [(i + 12, rows[i][1], "x") for i in range(3)]
        got = kept(remove_repeated_lines(spark, spark.createDataFrame(rows, SCHEMA), min_words=6 + trial))
        assert got == brute(rows, 6 + trial)


def test_common_lines_and_short_copies(spark, tmp_path):
    """Short lines that stand in many distinct texts and copies of short texts go, held against a walk over all lines."""
    rnd = random.Random(8)
    pool = ["all rights reserved", "x", "y z", "rare"] + [f"p{k}" for k in range(8)]
    rows = [(i, "\n".join([rnd.choice(pool) for _ in range(rnd.randint(0, 3))] + [f" own {i} ", ""])) for i in range(40)]
    rows += [(i + 40, rows[i][1]) for i in range(10)] + [(60 + k, "only this") for k in range(MIN_TEXTS + 3)] + [(80, None), (81, ""), (82, "")]
    spark.createDataFrame(rows, "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    strip = lambda t: [x.strip() for x in t.split("\n") if x.strip()]
    texts = {t for _, t in rows if t is not None}
    many = {x for x in pool if sum(x in strip(t) for t in texts) >= MIN_TEXTS}
    assert many and many != set(pool)
    want, seen, lines = {}, set(), set()
    for i, t in rows:
        if t is not None:
            want[i] = []
            for x in strip(t) if t not in seen else ():
                if x not in many or x not in lines:
                    want[i].append(x)
                lines.add(x)
            seen.add(t)
    out = op2_line_dedup(spark, str(tmp_path))
    assert kept(out) == want
    assert {r["doc_id"]: r["n_removed"] for r in out.collect()} == {i: len(strip(t or "")) - len(want.get(i, ())) for i, t in rows}


def test_passage_and_copies(spark):
    passage = " ".join(f"w{k}" for k in range(51))
    rows = [(3, f"third\n{passage}\nend", "x"), (1, f"first\n{passage}", "x"), (2, "clean text\nof its own", "x"), (5, f"first\n{passage}", "x"), (4, f"again {passage[3:]}", "x")]
    out = {r["doc_id"]: (r["text"], r["n_lines"], r["n_removed"]) for r in remove_repeated_lines(spark, spark.createDataFrame(rows, SCHEMA)).collect()}
    assert out == {1: (f"first\n{passage}", 2, 0), 2: ("clean text\nof its own", 2, 0), 3: ("third\nend", 3, 1), 4: (rows[4][1], 1, 0), 5: ("", 2, 2)}


def test_edge_cases(spark):
    long = "\n".join(f"line {k} of a long text" for k in range(3000))
    rows = [(1, None, "x"), (2, "", "x"), (None, long, "x"), (7, long, "x"), (7, long, "x"), (8, "a\n\n \nb", "x")]
    out = remove_repeated_lines(spark, spark.createDataFrame(rows, SCHEMA))
    assert out.columns == ["doc_id", "text", "n_lines", "n_removed"]
    got = sorted(((r["doc_id"], r["text"], r["n_lines"], r["n_removed"]) for r in out.collect()), key=str)
    gone = "\n" * 0
    assert got == sorted([(1, None, 0, 0), (2, "", 0, 0), (None, long, 3000, 0), (7, gone, 3000, 3000), (7, gone, 3000, 3000), (8, "a\n\n \nb", 2, 0)], key=str)
    assert remove_repeated_lines(spark, spark.createDataFrame([], SCHEMA)).count() == 0


def test_a_line_repeated_in_one_text(spark):
    """A copy that overlaps the first run isn't one: five lines of ten words are the first run of fifty."""
    line = "ten words are in this line as you can count"
    for n, left in ((9, 9), (10, 5), (12, 5), (23, 5)):
        out = remove_repeated_lines(spark, spark.createDataFrame([(1, "\n".join([line] * n), "x")], SCHEMA)).collect()
        assert [(r["n_lines"], r["n_lines"] - r["n_removed"]) for r in out] == [(n, left)] and kept(remove_repeated_lines(spark, spark.createDataFrame([(1, "\n".join([line] * n), "x")], SCHEMA))) == brute([(1, "\n".join([line] * n), "x")], 50)


def test_clashing_names(spark):
    """Columns with the names of the operator's own."""
    names = ["first", "spans", "rows", "h", "id", "row", "kept", "m", "i", "gpos", "r", "words", "start", "part", "before", "__text", "a b", "n_lines"]
    passage = " ".join(f"w{k}" for k in range(51))
    df = spark.createDataFrame([(1, passage, *range(len(names))), (2, f"x\n{passage}", *range(len(names))), (3, passage, *range(len(names)))], ["doc_id", "text", *names])
    out = remove_repeated_lines(spark, df)
    assert out.columns == ["doc_id", "text", *names[:-1], "n_lines", "n_removed"]
    assert sorted((r["doc_id"], r["text"], r["first"], r["a b"]) for r in out.collect()) == [(1, passage, 0, 16), (2, "x", 0, 16), (3, "", 0, 16)]
