import math
import random
import string
import re
from collections import Counter
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from sentrel.llm import ann, language_id, quality, secrets
from sentrel.llm.token_counts import START

SF = "/root/testdata/sf0.01"


@pytest.fixture(scope="module")
def docs(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


# ---- quality


def test_quality_on_labels(spark):
    out = quality.op3_quality(spark, SF).toPandas().merge(spark.read.parquet(f"{SF}/labels.parquet").toPandas(), on="doc_id")
    good, bad = out[out.quality == 1], out[out.quality == 0]
    assert good.keep.mean() > 0.99 and (~bad.keep).mean() > 0.9


def test_quality_of_unseen_documents(spark, docs):
    """Fitted on one half of the labels, measured on the other."""
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    half = F.crc32(F.col("doc_id").cast("string")) % 2 == 0
    model = quality.fit_quality(spark, docs, labels.where(half))
    scored = model.score(model.rows, "x").select(F.col("id").alias("doc_id"), "p_quality").join(labels.where(~half), "doc_id").toPandas()
    keep = scored.p_quality >= quality.KEEP_FROM
    assert keep[scored.quality == 1].mean() > 0.98 and (~keep[scored.quality == 0]).mean() > 0.85


def test_sites_shrink(spark):
    """Site rates without the document itself, by hand."""
    rows = [(i, "some words here to read", f"h{i % 3}", "p" if i % 2 else None, "x") for i in range(30)] + [(99, "other words", "rare", "p", "x"), (None, None, None, "p", "x"), (99, "other words", "rare", "p", "x")]
    df = spark.createDataFrame(rows, "doc_id long, text string, source string, lang string, p_doc string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(10)] + [(1, 0, 0), (None, 1, 0), (5, None, 0), (6, 7, 0)], "doc_id long, quality int, toxic int")
    model = quality.fit_quality(spark, df, labels)
    out = model.score(model.rows, "x").toPandas()
    assert len(out) == len(rows)
    k, m, mu = model.host_strength, model.path_strength, model.rate
    assert abs(out.p_doc.mean() - mu) < 1e-9
    for r in out[out.id == 4].itertuples():
        own = [i for i in range(30) if i % 3 == 1]
        p = {x.id: x.p_doc for x in out.itertuples() if x.id == x.id}
        host = (sum(p[i] for i in own if i != 4) + k * mu) / (len(own) - 1 + k)
        path = (sum(p[i] for i in own if i % 2 == 0 and i != 4) + m * host) / (len([i for i in own if i % 2 == 0]) - 1 + m)
        e = math.log(p[4] / (1 - p[4])) + math.log(path / (1 - path)) - math.log(mu / (1 - mu))
        assert (r.host_rate, r.path_rate, r.p_quality) == pytest.approx((host, path, 1 / (1 + math.exp(-e))))
    assert out[out.id.isna()].p_quality.tolist() == [0.0]
    kept = quality.good_documents(spark, df, labels)
    assert kept.columns == df.columns
    none = quality.good_documents(spark, df, labels.limit(0))
    assert none.count() == len(rows) - 1  # no labels: all with words stay
    assert quality.good_documents(spark, df.limit(0), labels).count() == 0


def quality_by_hand(rows, labels):
    """rows: (id, text, host, path). (id, p_doc, host_rate, path_rate, p_quality) of each, by loops over all rows."""
    said = {}
    for i, q in labels:
        if i is not None and q in (0, 1):
            said.setdefault(i, set()).add(q)
    x = {t: quality.text_features(t) for _, t, *_ in rows}
    known = sorted((i, tuple(x[t]), min(said[i])) for i, t, *_ in rows if len(said.get(i, ())) == 1)
    w, b = quality.fit_logistic(np.array([k[1] for k in known]).reshape(-1, len(quality.FEATURES)), np.array([k[2] for k in known], float))
    e = [float(np.clip(x[t] @ w + b, -quality.CLIP, quality.CLIP)) for _, t, *_ in rows]
    p = [1 / (1 + math.exp(-v)) for v in e]
    mu = sum(p) / len(p)

    def pulled(groups, rate_of):
        """How many documents the parent counts for, by the spread of the groups' rates beyond chance."""
        n = sum(len(g) for g in groups.values())
        between = sum(len(g) * (sum(g) / len(g) - rate_of(k)) ** 2 for k, g in groups.items())
        chance = sum(rate_of(k) * (1 - rate_of(k)) for k in groups)
        excess = (between - chance) / n
        top = sum(len(g) * rate_of(k) * (1 - rate_of(k)) for k, g in groups.items()) / n
        return min(max(top / excess - 1, 1.0), 1e6) if excess > 0 else 1e6

    hosts, paths = {}, {}
    for (_, _, h, q), v in zip(rows, p, strict=True):
        hosts.setdefault(h, []).append(v)
        paths.setdefault((h, q), []).append(v)
    k = pulled(hosts, lambda h: mu)
    host = {h: (sum(g) + k * mu) / (len(g) + k) for h, g in hosts.items()}
    m = pulled(paths, lambda hq: host[hq[0]])
    logit = lambda v: math.log(v / (1 - v))
    out = []
    for (i, t, h, q), ev, v in zip(rows, e, p, strict=True):
        host_rate = (sum(hosts[h]) - v + k * mu) / (len(hosts[h]) - 1 + k)
        path_rate = (sum(paths[h, q]) - v + m * host_rate) / (len(paths[h, q]) - 1 + m)
        out.append((i, v, host_rate, path_rate, 1 / (1 + math.exp(-(ev + logit(path_rate) - logit(mu)))) if x[t][0] > 0 else 0.0))
    return out


def test_quality_query_by_hand(spark, tmp_path):
    r = np.random.default_rng(4)
    text = lambda good: " ".join(str(r.choice(["the", "river", "house", "went", "small", "over"] if good else ["zz", "QQ9", "$$", "1234", "zz"])) for _ in range(int(r.integers(5, 60))))
    rows = []
    for i in range(150):
        host = [None, "a", "b", "c"][int(r.integers(0, 4))]
        rows.append((i if i % 40 else None, text(r.random() < {"a": 0.95, "b": 0.2}.get(host, 0.6)), host, [None, "en", "de"][int(r.integers(0, 3))]))
    rows += [(200, None, "a", "en"), (201, "", "b", None), (5, "again the river", "a", "en"), (5, "again the river", "a", "en")]
    labels = [(i, int("zz" not in (t or "zz"))) for i, t, *_ in rows[:80]] + [(7, 0), (7, 1), (9, None), (11, 5), (None, 1)]
    spark.createDataFrame(rows, "doc_id long, text string, source string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([(*v, 0) for v in labels], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    got = sorted(([-1 if v["doc_id"] is None else v["doc_id"], v["p_doc"], v["host_rate"], v["path_rate"], v["p_quality"], v["keep"]] for v in quality.op3_quality(spark, str(tmp_path)).collect()), key=lambda v: [round(z, 7) for z in v])
    want = sorted(([-1 if i is None else i, *v, v[-1] >= quality.KEEP_FROM] for i, *v in quality_by_hand(rows, labels)), key=lambda v: [round(z, 7) for z in v])
    assert np.array(got, float) == pytest.approx(np.array(want, float), abs=1e-9) and len({v[-1] for v in got}) == 2


def test_logistic_regression_is_at_its_optimum():
    r = np.random.default_rng(1)
    x = r.normal(size=(200, 5)) * [1, 10, 0.1, 3, 1] + 2
    side = x @ [1, 0.1, -4, 0.3, 0] + r.normal(size=200)
    y = (side > np.median(side)).astype(float)
    w, b = quality.fit_logistic(x, y)
    z, v = (x - x.mean(0)) / x.std(0), w * x.std(0)
    left = y - 1 / (1 + np.exp(-(x @ w + b)))
    assert np.abs(z.T @ left - v).max() < 1e-5 and abs(left.sum()) < 1e-4


def test_features_of_odd_texts():
    for t in (None, "", " \n", "x", "\ud800 lone", "word " * 100000):
        f = quality.text_features(t)
        assert f.shape == (len(quality.FEATURES),) and np.isfinite(f).all()


# ---- language identification


def segmentations(word, pieces, longest, probs):
    if not word:
        return 1.0
    total = 0.0
    for k in range(1, min(len(word), longest) + 1):
        p = pieces.get(word[:k], 0 if k == 1 else None)
        if p is not None:
            total += probs[p] * segmentations(word[k:], pieces, longest, probs)
    return total


def test_forward_sums_all_segmentations():
    pieces = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5, "ba": 6, "▁ab": 7}
    r = np.random.default_rng(1)
    probs = r.random((8, 2))
    model = language_id.PieceModel(["x", "y"], pieces, probs, np.array([0.5, 0.5]))
    words = ["a", "ab", "abba", "babz", "zz", "aaaaabbb"]
    got = model.lattice(words).log_probability(probs)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(math.log(segmentations(START + w, pieces, 3, probs[:, k])))
    grid = model.lattice(words)
    p = probs[grid.piece]
    assert grid.forward(p)[np.arange(len(words)), grid.length] == pytest.approx(grid.backward(p)[:, 0])


def exact_log(word, pieces, longest, probs):
    """The same sum over prefixes, in fractions."""
    sums = [Fraction(1)]
    for j in range(1, len(word) + 1):
        total = Fraction(0)
        for i in range(max(0, j - longest), j):
            p = pieces.get(word[i:j], 0 if j - i == 1 else None)
            if p is not None:
                total += sums[i] * Fraction(float(probs[p]))
        sums.append(total)
    return math.log(sums[-1].numerator) - math.log(sums[-1].denominator)


def test_long_words_are_whole(monkeypatch):
    """Words beyond what a double holds, over several parts, against exact fractions; languages may differ by any factor."""
    monkeypatch.setattr(language_id, "PART", 50)
    pieces = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5, "ba": 6, "▁ab": 7}
    probs = np.random.default_rng(2).random((8, 2)) * np.array([1e-2, 1e-9])
    model = language_id.PieceModel(["x", "y"], pieces, probs, np.array([0.5, 0.5]))
    r = np.random.default_rng(3)
    words = sorted(["ab", "b", *("".join(r.choice(list("abz"), n)) for n in (model.safe, model.safe + 1, 49, 50, 51, 150, 333))], key=len)
    got = model.log_probability(words)
    for i, w in enumerate(words):
        for k in range(2):
            assert got[i, k] == pytest.approx(exact_log(START + w, pieces, 3, probs[:, k]), rel=1e-12)
    assert sum(len(w) > model.safe for w in words) >= 4 and np.isfinite(model.log_probability(["z" * 20000])).all()


def test_expected_pieces_of_long_words(monkeypatch):
    """Sums in logarithms and in parts give what plain sums do; every letter of a word of any length is in one expected piece."""
    pieces = {"▁": 1, "▁a": 2, "a": 3, "ab": 4, "b": 5, "ba": 6, "▁ab": 7}
    long_pieces = np.array([1, 1, 2, 1, 2, 1, 2, 3])
    probs = np.random.default_rng(2).random((8, 2)) * np.array([1e-2, 1e-9])
    model = language_id.PieceModel(["x", "y"], pieces, probs, np.array([0.5, 0.5]))
    r = np.random.default_rng(3)
    words = ["".join(r.choice(list("abz"), int(n))) for n in r.integers(1, model.safe, 40)] + ["a", "zz"]
    lang, n = r.integers(0, 2, len(words)), r.integers(1, 5, len(words)).astype(float)
    grid = model.lattice(words)
    assert grid.shares(probs, lang) == pytest.approx(grid.shares(probs, lang, logs=True), rel=1e-9)
    plain = np.zeros((8, 2))
    model.expected(words, lang, n, plain)
    longer = [*words, "ab" * 200, "z" * 333, "ba" * 30]
    lang, n = np.append(lang, [0, 1, 1]), np.append(n, [2.0, 1.0, 3.0])
    whole, parts = np.zeros((8, 2)), np.zeros((8, 2))
    model.expected(longer, lang, n, whole)
    monkeypatch.setattr(language_id, "PART", 7)
    monkeypatch.setattr(language_id, "PLACES_AT_ONCE", 12)
    model.expected(longer, lang, n, parts)
    assert parts == pytest.approx(whole, rel=1e-9) and np.isfinite(whole).all()
    for k in range(2):
        assert long_pieces @ whole[:, k] == pytest.approx(sum((len(w) + 1) * m for w, x, m in zip(longer, lang, n, strict=True) if x == k))
    assert (whole >= plain - 1e-9).all()


def test_scripts_without_spaces_are_learned(spark):
    r = np.random.default_rng(5)
    text = lambda letters, n: "".join(r.choice(list(letters), n))
    zh, ja = "的一是不了人我在有他这中大来上个国", "のにはをたがでてとしれさあいるもか"
    rows = [(i, text(zh, 60), "zh") for i in range(20)] + [(20 + i, text(ja, 4000 if i == 0 else 200), "ja") for i in range(20)] + [(40 + i, "the river and the house of the town", "en") for i in range(20)]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit_languages(spark, df)
    assert model.langs == ["en", "ja", "zh"]
    held = spark.createDataFrame([(text(zh, 45), "zh"), (text(ja, 90), "ja"), ("a house and a town", "en"), (text(zh, 3000), "zh")], "text string, `a.b` string")
    assert [r["lang_pred"] for r in language_id.identify_languages(spark, held.coalesce(1), model).collect()] == ["zh", "ja", "en", "zh"]


def test_expectation_maximisation(spark):
    """Whole fits, and predictions by them, against sums over all segmentations of every word; rare languages are in the sample."""
    rows = [(i, t, x) for i, (t, x) in enumerate([("Ab ba, ab", "x"), ("abba zz", "x"), ("b b a1a", "y"), ("baba bab", "y"), (None, "x"), ("ab", None), ("...", "y"), ("a" * 9, "x"), ("ba z", "w")])]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    pieces = language_id.load_pieces(language_id.VOCABULARY)
    number = {p: i + 1 for i, p in enumerate(pieces)}
    longest = max(map(len, pieces))
    model = language_id.fit_languages(spark, df, iterations=2)
    assert model.langs == ["w", "x", "y"]

    def ways(word):
        """All segmentations, as lists of piece numbers."""
        if not word:
            return [[]]
        out = []
        for k in range(1, min(len(word), longest) + 1):
            p = number.get(word[:k], 0 if k == 1 else None)
            if p is not None:
                out += [[p, *rest] for rest in ways(word[k:])]
        return out

    words = {"w": Counter({"ba": 1, "z": 1}), "x": Counter({"ab": 2, "ba": 1, "abba": 1, "zz": 1, "a" * 9: 1}), "y": Counter({"b": 2, "a": 2, "baba": 1, "bab": 1})}
    size = len(pieces) + 1
    for k, x in enumerate(model.langs):
        p = np.full(size, 1 / size)
        for _ in range(2):
            counts = np.full(size, language_id.SMOOTHING)
            for w, n in words[x].items():
                each = [(np.prod(p[g]), g) for g in map(np.array, ways(START + w))]
                for v, g in each:
                    np.add.at(counts, g, n * v / sum(u for u, _ in each))
            p = counts / counts.sum()
        assert model.probs[:, k] == pytest.approx(p, rel=1e-9)
    assert model.prior == pytest.approx(np.array([2, 6, 6]) / 14)
    got = language_id.identify_languages(spark, df, model).orderBy("doc_id").collect()
    for r in got:
        w = language_id.letter_words(r["text"])
        if not w:
            assert (r["lang_pred"], r["score"]) == ("und", 0.0)
        elif len(r["text"]) < 20:
            z = np.log(model.prior) + sum(n * np.log([sum(np.prod(model.probs[g, k]) for g in map(np.array, ways(START + v))) for k in range(3)]) for v, n in w.items())
            assert r["lang_pred"] == model.langs[int(z.argmax())] and r["score"] == pytest.approx(1 / np.exp(z - z.max()).sum())


def test_quotas():
    assert language_id.quotas({"a": 5, "b": 100, "c": 60}, 65) == {"a": 5, "c": 30, "b": 30} and language_id.quotas({"a": 5}, 65) == {"a": 5}


def test_language_accuracy(spark, docs):
    out = language_id.op10_language_id(spark, SF).toPandas()
    both = docs.select("doc_id", "lang", "text").toPandas().merge(out, on="doc_id")
    import zlib

    assert (both.held_out == both.doc_id.map(lambda i: zlib.crc32(str(i).encode()) % 5 == 0)).all()
    held = both[both.held_out & both.lang.notna() & (both.lang_pred != "und")]
    assert (held.lang == held.lang_pred).mean() > 0.98 and both.score.between(0, 1).all()


def test_language_edge_cases(spark, docs):
    model = language_id.fit_languages(spark, docs.limit(300))
    rows = [(1, None), (2, ""), (3, "123 !!"), (4, "the and of"), (5, "x" * 30000), (5, "漢字"), (None, "the the")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, score string")
    out = language_id.identify_languages(spark, df, model)
    assert out.columns == ["doc_id", "text", "lang_pred", "score"]
    got = out.collect()
    assert [r["lang_pred"] for r in got[:4]] == ["und", "und", "und", "en"] and all(r["lang_pred"] in model.langs for r in got[3:])
    empty = language_id.fit_languages(spark, docs.limit(0))
    assert {(r["lang_pred"], r["score"]) for r in language_id.identify_languages(spark, df, empty).collect()} == {("und", 0.0)}
    assert language_id.identify_languages(spark, df.limit(0), model).count() == 0


# ---- secrets


def brute_spans(text):
    """The patterns as the contract writes them."""
    out = []
    for kind, pattern in (("assign", r"((?a:(?i:password|passwd|secret|token|api_?key)))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)"), ("access", "AKIA[A-Z0-9]+"), ("hex", "[0-9a-f]+")):
        for m in re.finditer(pattern, text):
            if {"assign": lambda m: len(m[2]) >= 6, "access": lambda m: len(m[0]) >= 20, "hex": lambda m: len(m[0]) >= 24}[kind](m):
                out.append((kind, m.start(), m.end()))
    return sorted(out, key=lambda x: (x[1], ("assign", "access", "hex").index(x[0])))


def test_base_spans():
    hexa = "0123456789abcdef" * 2
    texts = ["", "token: token: abcdef", f'é PassWord" = "{hexa}"', "api_key=aaaaa, APIKEY='bbbbbbb'", "AKIA" + "A" * 15, "AKIA" + "B" * 16 + "c", "xAKIAAKIA" + "C" * 30, hexa + "g" + hexa, "ſecret=abcdefgh", "toKen=abcdefgh", "secret=token=abcdefg password==xyzxyz", "passwd : " + "z" * 30000]
    for t in texts:
        assert secrets.base_spans(t) == brute_spans(t), t


def test_scan_and_network(spark, docs):
    net = secrets.train_network(spark, docs)
    rows = [(1, None), (2, ""), (3, f"é token = \"{'ab12' * 10}\" and 4111111111111111"), (4, "word " * 30000), (4, "10.20.30.40 a.b@mail1.example.com +1 (614) 555-8001")]
    df = spark.createDataFrame([(*r, "c") for r in rows], "doc_id long, text string, spans string")
    out = secrets.find_secrets(spark, df, net)
    assert out.columns == ["doc_id", "text", "spans"]
    got = [[(s["kind"], s["start"], s["end"]) for s in r["spans"]] for r in out.collect()]
    assert got == [[], [], [("assign", 2, 51), ("hex", 11, 51)], [], []]
    found = secrets.op6_secret_scan(spark, SF).toPandas()
    texts = {r["doc_id"]: r["text"] for r in docs.collect()}
    import hashlib

    for r in found.itertuples():
        base = brute_spans(texts[r.doc_id] or "")
        said = [":".join(map(str, s)) for s in base]
        assert r.base_sha256 == hashlib.sha256(",".join(said).encode()).hexdigest() and set(said) <= set(r.spans.split(",")) | {""}
        assert (r.n_assign, r.n_access, r.n_hex) == tuple(sum(k == x for k, _, _ in base) for x in ("assign", "access", "hex"))
    assert secrets.find_secrets(spark, df.limit(0), net).count() == 0
    assert secrets.train_network(spark, df.limit(0)).threshold > 1  # adds nothing


def test_every_candidate_trains_the_network(spark):
    """All labelled candidates but the held-out fifth are fitted, in one chunk or in several, and both find keys that no pattern knows."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("text").where("text rlike '[0-9a-f]{24}|[0-9]-[0-9]|=|:'").limit(6000)
    at = {secrets.encode(t, *w).astype(np.uint8).tobytes() for (t,) in docs.collect() for c in secrets.candidates(t or "") for w in secrets.windows(*c)}
    import hashlib

    want = sum(hashlib.md5(c).digest()[0] % 5 != 0 for c in at)
    keys = [f"and then we read {'q7RtX2mZ9bLk4VwN8sJd' * 2}"[:44], "f3" * 16]
    for chunk_rows in (secrets.CHUNK_ROWS, math.ceil(want / 3)):
        net = secrets.train_network(spark, docs, chunk_rows=chunk_rows)
        assert net.rows == want and net.threshold <= 0.5
        assert all(net.score(np.array([secrets.encode(t, *w) for c in secrets.candidates(t) for w in secrets.windows(*c)])).max() >= net.threshold for t in keys)


def test_network_learns_and_meets_the_recall():
    """Secrets without a key word beside them are found, numbers of other kinds are not."""
    r = np.random.default_rng(2)
    pick = lambda chars, n: "".join(r.choice(list(chars), n))
    rows = []
    for i in range(600):
        bad = i % 2 == 0
        body = pick("0123456789abcdef", 40) if bad else pick("0123456789", 16)
        text = f"some text {'token = ' if bad and i % 4 == 0 else 'and '}{body} more"
        a = text.index(body)
        rows.append((secrets.encode(text, a, a + len(body)), bad))
    x, y = np.array([a for a, _ in rows]), np.array([b for _, b in rows], float)
    net = secrets.CharNetwork()
    net.fit(x[:400], y[:400], epochs=6)
    net.calibrate(x[400:], y[400:], 0.95)
    p = net.score(x[400:])
    assert (p[y[400:] > 0] >= net.threshold).mean() >= 0.95 and (p[y[400:] == 0] >= net.threshold).mean() < 0.05


def test_forward_pass_by_loops():
    net = secrets.CharNetwork(3)
    x = np.array([secrets.encode(t, 4, len(t)) for t in ("key=abcDEF123", "and some-thing.else", "    " + "z" * 40)])
    z = net.forward(x)[3]
    side = secrets.WIDTH // 2
    for row, got in zip(x, z, strict=True):
        out = net.p["c"][0]
        for part in range(3):
            for f in range(secrets.FILTERS):
                best = -np.inf
                for at in np.flatnonzero(net.PARTS == part):
                    seen = [net.p["e"][row[at + j - side]] if 0 <= at + j - side < len(row) else np.zeros(secrets.EMBED) for j in range(secrets.WIDTH)]
                    best = max(best, float(np.concatenate(seen) @ net.p["w"][:, f]) + net.p["b"][f])
                out += max(best, 0) * net.p["o"][part * secrets.FILTERS + f]
        assert got == pytest.approx(out)


def test_recall_of_keys_that_no_pattern_knows(spark):
    """Random keys in sentences, behind unknown key words and at a text's start; the corpus itself has no false find."""
    docs = spark.read.parquet("/root/testdata/sf0.1/documents.parquet").select("doc_id", "text")
    net = secrets.train_network(spark, docs)
    rnd = random.Random(8)
    key = lambda n: "".join(rnd.choice(string.ascii_letters + string.digits) for _ in range(n))
    contexts = ["and then we read {} in the house", "credential: {}", "pwd = {}", "{} and the rest"]
    rows = [(c * 2 + k, contexts[c].format(key(n))) for c in range(4) for k, n in enumerate((20, 32)) for _ in range(100)]
    got = secrets.find_secrets(spark, spark.createDataFrame(rows, "kind int, text string"), net).groupBy("kind").agg(F.avg((F.size("spans") > 0).cast("double")).alias("r")).collect()
    assert len(got) == 8 and min(r["r"] for r in got) >= 0.9
    false = secrets.find_secrets(spark, docs, net).select(F.explode("spans").alias("s")).where("s.kind = 'model'").count()
    assert false <= 1


def test_any_column_names(spark):
    df = spark.createDataFrame([(1, "password = hunter22", 2, 3), (None, None, 2, 3)], "`doc.id` long, `te`xt.x` string, row int, text int".replace("te`xt.x", "te``xt.x"))
    out = secrets.find_secrets(spark, df, secrets.CharNetwork(), text_col="te`xt.x")
    assert out.columns == ["doc.id", "te`xt.x", "row", "text", "spans"]
    assert sorted((r["doc.id"] or 0, r["te`xt.x"], r["text"], len(r["spans"])) for r in out.collect()) == [(0, None, 3, 0), (1, "password = hunter22", 3, 1)]


def test_what_the_network_is_shown():
    long = "k" * 30 + "9" + "x" * 200
    for text, want in [("pin 1234567, 2024-01-05 and abcdefgh", ["2024-01-05"]), ("aB" * 6 + " camelCase", ["aB" * 6]), ("key: hunter", ["hunter"]), ("key='hunter'", ["hunter"]), ("x " + long, [long]), ("", [])]:
        assert [text[a:b] for a, b in secrets.candidates(text)] == want
    parts = secrets.windows(2, 2 + len(long))
    assert all(b - a == secrets.INSIDE for a, b in parts) and {i for a, b in parts for i in range(a, b)} == set(range(2, 2 + len(long)))
    assert secrets.windows(3, 3 + secrets.INSIDE) == [(3, 3 + secrets.INSIDE)]


def test_no_context_is_no_sign(spark):
    """Dates, versions and names are left alone wherever they stand, at a text's start too; keys are found without a key word."""
    net = secrets.train_network(spark, spark.read.parquet("/root/testdata/sf0.1/documents.parquet"))  # sf0.01 has 12 findings only
    plain = ["2024-11-05T12", "version-1.2.3-release", "chapter10-section4", "2024-11-05", "section-12.4", "word2vec-model", "release-2024.1", "http2-server", "room-101-north"]
    texts = [f"{p} {t}" if p else t for p in ("", "and then we read") for t in plain]
    keys = ["f3" * 16, "0123456789abcdef" * 2, "9c1185a5c5e9fc54612808977ee8f548b2258d31"]
    at = lambda t: [secrets.encode(t, *w) for c in secrets.candidates(t) for w in secrets.windows(*c)]
    shown = [np.array(at(t)) for t in texts]
    assert all(len(x) for x in shown) and sum(net.score(x).max() >= net.threshold for x in shown) <= 1
    found = [net.score(np.array(at(f"{p}{k} end"))).max() >= net.threshold for p in ("", "and then ") for k in keys]
    assert net.threshold > 0.3 and np.mean(found) >= 0.8


def test_network_gradient():
    r = np.random.default_rng(3)
    x, y = r.integers(0, 128, (8, secrets.LENGTH)), np.array([0, 1] * 4, float)
    net = secrets.CharNetwork()
    loss = lambda: float(np.mean(np.log1p(np.exp(-np.where(y > 0, 1, -1) * net.forward(x)[3]))))
    before = loss()
    net.fit(x, y, epochs=40, rate=0.02)
    assert loss() < before / 4


# ---- nearest neighbours


def exact(rows, k=5, step=50):
    good = [(i, np.array(v, float)) for i, v in rows if i is not None and v and all(c is not None and math.isfinite(c) for c in v) and any(v)]
    out = {}
    for i, a in good:
        if i % step == 0:
            best = {}
            for j, b in good:
                if j != i and len(a) == len(b):
                    s = float(a @ b / np.sqrt(a @ a) / np.sqrt(b @ b))
                    best[j] = max(s, best.get(j, -9))
            out[i] = sorted(best.items(), key=lambda x: (-round(x[1], 12), x[0]))[:k]
    return out


def test_neighbours_and_edge_cases(spark):
    r = np.random.default_rng(5)
    rows = [(i, r.normal(size=8).tolist()) for i in range(300)]
    rows += [(1000 + i, [1.0] * 8) for i in range(60)] + [(2000, [2.0] * 8), (2050, None), (2100, []), (2150, [0.0] * 8), (2200, [None] + [1.0] * 7), (2250, [float("nan")] * 8), (2300, [float("inf")] + [1.0] * 7), (None, [1.0] * 8), (2350, [1.0, 2.0]), (2400, [2.0, 1.0]), (150, rows[150][1])]
    df = spark.createDataFrame([(*x, 3) for x in rows], "vec_id long, embedding array<double>, rank int")
    out = ann.nearest_neighbours(spark, df, shard_bytes=6400).collect()
    got = {}
    for x in sorted(out, key=lambda x: (x["query_id"], x["rank"])):
        got.setdefault(x["query_id"], []).append((x["vec_id"], x["score"]))
    want = exact(rows)
    assert set(got) == set(want) - {i for i, v in want.items() if not v}
    for i, v in got.items():
        assert [a for a, _ in v] == [a for a, _ in want[i]] and [s for _, s in v] == pytest.approx([s for _, s in want[i]], abs=1e-12)
    assert ann.nearest_neighbours(spark, df.limit(0)).count() == 0


def test_recall_of_a_graph():
    r = np.random.default_rng(6)
    centres = r.normal(size=(30, 32))
    x = ann.unit(centres[r.integers(0, 30, 6000)] + 0.6 * r.normal(size=(6000, 32))).astype(np.float32)
    graph = ann.SmallWorld.build(x)
    q = x[::60]
    found = graph.search(q, 6)
    want = np.argsort(-(q @ x.T), axis=1)[:, :6]
    assert np.mean([len(set(a) & set(b)) / 6 for a, b in zip(found, want, strict=True)]) > 0.95
    assert all(layer.links.max() < len(layer.points) for layer in graph.layers) and len(graph.layers) >= 3


@pytest.mark.parametrize("shard_bytes", [ann.SHARD_BYTES, 200_000])
def test_recall_on_embeddings(spark, shard_bytes):
    """Every row of the table is a candidate; one shard and several."""
    e = spark.read.parquet("/root/testdata/sf0.1/embeddings.parquet")
    got = ann.nearest_neighbours(spark, e, query_step=20, shard_bytes=shard_bytes).toPandas()
    want = exact([(r["vec_id"], r["embedding"]) for r in e.collect()], step=20)
    assert (e.count() * 64 * 8 > 4 * shard_bytes) == (shard_bytes == 200_000)
    found = {q: set(g.vec_id) for q, g in got.groupby("query_id")}
    assert np.mean([len(found[q] & {j for j, _ in v}) / len(v) for q, v in want.items()]) >= 0.95
    assert spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch") in ("1000", "10000")


@pytest.mark.parametrize("lanes", [1, 3])
def test_several_shards_and_blocks_of_queries(spark, monkeypatch, lanes):
    monkeypatch.setattr(ann, "BLOCK_ROWS", 7)
    monkeypatch.setattr(ann, "LANES", lanes)
    r = np.random.default_rng(9)
    x = r.normal(size=(900, 16)).astype(np.float32)
    df = spark.createDataFrame([(i, v.tolist()) for i, v in enumerate(x)] + [(2000 + i, r.normal(size=8).tolist()) for i in range(60)], "vec_id long, embedding array<float>")
    got = ann.nearest_neighbours(spark, df, query_step=10, shard_bytes=200 * 16 * 8).collect()
    u = ann.unit(x.astype(np.float64))
    best = {q: set(np.argsort(-np.where(np.arange(900) == q, -9, u @ u[q]), kind="stable")[:5].tolist()) for q in range(0, 900, 10)}
    mine = {}
    for row in got:
        mine.setdefault(row["query_id"], set()).add(row["vec_id"])
    assert set(mine) == set(best) | set(range(2000, 2060, 10)) and all(len(v) == 5 for v in mine.values())
    assert np.mean([len(mine[q] & best[q]) / 5 for q in best]) >= 0.9
    assert all(row["score"] == pytest.approx(float(u[row["vec_id"]] @ u[row["query_id"]]), abs=1e-12) for row in got if row["query_id"] < 900)
