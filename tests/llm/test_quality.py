import re
from collections import Counter

import numpy as np

from veilsift.llm import quality as Q

WORD = re.compile(r"[^\x20\x09-\x0D]+")
SCHEMA = "doc_id long, text string, lang string, source string, n_words string"


def base(text):
    text = text or ""
    words = WORD.findall(text)
    grams = Counter(zip(words, words[1:], words[2:]))
    inside = set()
    for i in range(len(words) - 2):
        if grams[tuple(words[i : i + 3])] > 1:
            inside |= {i, i + 1, i + 2}
    lines = [x for x in text.split("\n") if WORD.search(x)]
    return len(words), sum(map(len, words)), sum(c in "#*$%&|<>" for c in text), len(lines) - len(set(lines)), len(inside)


def sample():
    rng = np.random.default_rng(2)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(2, 9))) for _ in range(400)]
    rows = []
    for i in range(300):
        words = rng.choice(vocabulary, rng.integers(40, 200))
        text = "\n".join(" ".join(words[k : k + 12]) for k in range(0, len(words), 12))
        if i % 20 == 7:
            text = " ".join(w + "$$%&" for w in words)
        if i % 20 == 13:
            text = (text + "\n") * 4
        rows.append((i, text, ["en", "de", None][i % 3], f"s{i % 2}", "x"))
    rows += [(900, None, "en", "s0", ""), (901, "", None, None, None), (902, "é ü #|", "en", "s9", ""), (903, "x" * 200_000, "en", "s0", ""), (904, "a b " * 30_000, "en", "s0", ""), (None, rows[1][1], "en", "s0", ""), (1, rows[1][1], "de", "s1", "")]
    return rows


def test_base_counts_and_verdicts(spark):
    rows = sample()
    out = Q.rules(spark.createDataFrame(rows, SCHEMA).repartition(5)).collect()
    assert len(out) == len(rows)
    got = {r.doc_id: r for r in out}
    for doc_id, text, *_ in rows:
        r, b = got[doc_id], base(text)
        assert tuple(r[1:6]) == b
        assert r.base_failed == (b[0] < 50 or 100 * b[4] > 50 * b[0])
        assert not (r.base_failed and r.kept)
    passed = [r for r in out if not r.base_failed and r.doc_id is not None and r.doc_id < 300]
    assert all(not r.kept for r in passed if r.doc_id % 20 == 7)
    assert all(r.kept for r in passed if r.doc_id % 20 not in (7, 13))


def test_estimate_matches_numpy(spark, monkeypatch):
    rows = [(i, t, "en", "s", "x") for i, t, *_ in sample()[:300]]
    df = spark.createDataFrame(rows, SCHEMA)
    measured = Q.measure(df, {"q_lang": df["lang"], "q_source": df["source"], "doc_id": df["doc_id"]})
    got = {r.doc_id: r.distance2 for r in Q.judge(measured, Q.fit(measured)).collect() if not r.base_failed}
    x = np.array([[r[f"x{i}"] for i in range(6)] for r in measured.collect() if not r.base_failed])
    ids = [r.doc_id for r in measured.collect() if not r.base_failed]
    floor = np.square(Q.FLOOR)
    scale = Q.SUBSET / Q.chi2_cdf(Q.chi2_quantile(Q.SUBSET, 6), 8)
    best = None
    cut = np.floor(x * 1000)
    quartile = lambda p: (np.sort(cut, 0)[max(0, int(np.ceil(len(x) * p)) - 1)] + 0.5) / 1000
    for start in (np.square((quartile(0.75) - quartile(0.25)) / 1.349) + floor, floor):
        m, c = quartile(0.5), np.diag(start)
        for _ in range(Q.STEPS):
            d = np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
            bins = np.floor(np.log(d + 1e-12) * 1000)
            keep = bins <= np.sort(bins)[max(0, int(np.ceil(len(x) * Q.SUBSET)) - 1)]
            m, c = x[keep].mean(0), np.cov(x[keep].T, bias=True) * scale + np.diag(floor)
        det = np.linalg.slogdet(c)[1]
        if best is None or det < best[0]:
            best = det, np.einsum("ij,jk,ik->i", x - m, np.linalg.inv(c), x - m)
    assert np.allclose([got[i] for i in ids], best[1], rtol=1e-6, atol=1e-9)


def test_repetition_alone_rejects_in_a_clean_group(spark):
    rng = np.random.default_rng(7)
    vocabulary = ["".join(rng.choice(list("abcdefghij"), rng.integers(3, 9))) for _ in range(3000)]
    lines = lambda n: [" ".join(rng.choice(vocabulary, 10)) for _ in range(n)]
    rows = [(i, "\n".join(lines(20)), "en", "s", "") for i in range(200)]
    twice = lines(6)
    rows += [(900, "\n".join([*lines(13), *twice[:3], *twice[:3]]), "en", "s", ""), (901, "\n".join([*lines(20), "same", *["same"] * 19]), "en", "s", ""), (902, "\n".join([*lines(18), twice[0], twice[0]]), "en", "s", "")]
    rows += [(1000 + i, "\n".join(lines(20)), "en", f"small{i}", "") for i in range(20)]  # groups of one row lean on the language
    got = {r.doc_id: r for r in Q.rules(spark.createDataFrame(rows, SCHEMA)).collect()}
    assert not any(r.base_failed for r in got.values())
    assert not got[900].kept and not got[901].kept and got[902].kept
    assert all(r.kept for d, r in got.items() if d not in (900, 901))


def test_kept_documents_and_empty(spark):
    df = spark.createDataFrame(sample(), SCHEMA)
    kept = Q.kept_documents(df)
    assert kept.columns == df.columns
    want = sorted(r.doc_id for r in Q.rules(df).collect() if r.kept and r.doc_id is not None)
    assert sorted(r.doc_id for r in kept.collect() if r.doc_id is not None) == want
    assert Q.rules(df.where("false")).count() == 0
    assert [r.kept for r in Q.rules(df.where("doc_id = 901")).collect()] == [False]


def test_quantile():
    assert abs(Q.chi2_cdf(Q.chi2_quantile(0.9999, 6), 6) - 0.9999) < 1e-9
