import sys
import tracemalloc
import zlib

import numpy as np

from veilsift.llm import toxicity as T

WORDS = ["river", "stone", "garden", "window", "letter", "morning", "silver", "paper", "ocean", "forest", "little", "number", "market", "summer", "bridge", "yellow", "doctor", "motion", "idea", "theatre"]
BAD = ["idiot", "moron", "clown", "scum", "worthless"]


def sample(n=900):
    rng = np.random.default_rng(4)
    docs, labels = [], []
    for i in range(n):
        words = list(rng.choice(WORDS, rng.integers(5, 60)))
        toxic = i % 4 == 0
        for _ in range(3 if toxic else 0):
            words.insert(rng.integers(len(words)), str(rng.choice(BAD)))
        docs.append((i, " ".join(words) + ".", "en", 1.0))
        labels.append((i, int(toxic)))
    return docs, labels


DOCS, LABELS = "doc_id long, text string, lang string, score double", "doc_id long, toxic int"


def test_held_out_accuracy_and_gaps(spark):
    docs, labels = sample()
    odd = ["you IDIOT.", "what an i d i o t you are", "i-d-i-o-t", "idiiot here", "a m.o.r.o.n there", "cl_own", "river stone garden", "the motion of an idea", "", None, "x" * 100_000, "paper " * 50_000, "paper " * 20_000 + "worthless"]
    rows = docs + [(10_000 + i, t, None, None) for i, t in enumerate(odd)] + [(None, "idiot idiot idiot", "en", 0.0), (5, docs[5][1], "en", 0.0)]
    more = labels + [(99_999, 1), (None, 1), (3, None)]
    out = T.scored(spark.createDataFrame(rows, DOCS).repartition(4), spark.createDataFrame(more, LABELS)).collect()
    assert len(out) == len(rows)
    truth = dict(labels)
    for r in out:
        assert 0 <= r.score <= 1 and r.predicted == int(r.score >= 0.7)
        assert r.held_out == (r.doc_id is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 1)
    held = [r for r in out if r.held_out and r.doc_id in truth]
    assert np.mean([r.predicted == truth[r.doc_id] for r in held]) > 0.98
    by = {r.doc_id: r.predicted for r in out}
    assert [by[10_000 + i] for i in range(len(odd))] == [1, 1, 1, 1, 1, 1, 0, 0, 0, 0, 0, 0, 1]


def test_kernel_is_the_subsequence_kernel():
    def plain(a, b):
        def grams(w):
            s, out = "\x00" + w, {}
            for i in range(len(s)):
                for j in range(i + 1, len(s)):
                    for k in range(j + 1, min(len(s), i + T.SPAN)):
                        out[s[i], s[j], s[k]] = out.get((s[i], s[j], s[k]), 0) + T.DECAY ** (k - i + 1)
            return out

        x, y = grams(a), grams(b)
        dot = lambda p, q: sum(v * q.get(g, 0) for g, v in p.items())
        return dot(x, y) / (dot(x, x) * dot(y, y)) ** 0.5

    words = ["idiot", "idiiot", "patriot", "moron", "tionthtion", "motion"]
    marks = [b"idiot", b"moron"]
    got = T.Kernel(marks)([w.encode() for w in words])
    want = np.array([[plain(w, m.decode()) for m in marks] for w in words])
    close = want >= T.NEAR
    assert np.allclose(got[close], want[close], atol=1e-5) and (np.abs(got - want)[~close] < 0.15).all()


def test_long_landmarks_of_any_script():
    marks = ["中" * 20, "é" * 40, "очень" * 12, "x" * 200]
    kernel = T.Kernel([m.encode() for m in marks])
    own = kernel([m.encode() for m in marks])
    assert (np.diag(own) > 0.5).all() and own[0, 3] < 0.3
    assert T.strings("ÉCLAIR Мир".encode()) == ["éclair".encode(), "мир".encode()]


def test_toxic_words_of_other_scripts_are_learned(spark):
    docs, labels = sample(300)
    bad = "негодяйпрохвостмерзавецнегодяйпрохвост"
    docs = [(d, t.replace("idiot", bad).replace("moron", bad), lang, s) for d, t, lang, s in docs]
    docs += docs[:50]  # repeated ids
    out = T.scored(spark.createDataFrame(docs, DOCS), spark.createDataFrame(labels, LABELS)).collect()
    truth = dict(labels)
    assert np.mean([r.predicted == truth[r.doc_id] for r in out if r.held_out]) > 0.9


def test_without_labels_and_empty(spark):
    docs, labels = sample(30)
    df, none = spark.createDataFrame(docs, DOCS), spark.createDataFrame([], LABELS)
    assert {(r.score, r.predicted) for r in T.scored(df, none).collect()} == {(0.0, 0)}
    assert T.scored(df.where("false"), spark.createDataFrame(labels, LABELS)).count() == 0
    kept = T.clean_documents(df, none)
    assert kept.columns == df.columns and kept.count() == df.count()


def test_memory_of_kernel_values_does_not_grow_with_the_words():
    """Beyond the values themselves; all words are near to a landmark, so that their subsequences are listed."""
    rng = np.random.default_rng(2)
    mark = "worthlessscoundrelsandidiots"
    words = [f"{mark[:at]}{c}{mark[at:]}{i}".encode() for i, (at, c) in enumerate(zip(rng.integers(1, 28, 6000).tolist(), rng.choice(list("abcdefgh"), 6000)))]
    kernel = T.Kernel([mark.encode(), b"moron"])

    def peak(some):
        tracemalloc.start()
        try:
            values = kernel(some)
            return tracemalloc.get_traced_memory()[1] - values.nbytes
        finally:
            tracemalloc.stop()

    assert (kernel(words[:50])[:, 0] >= T.NEAR).all()
    assert peak(words) < 1.5 * peak(words[:1000])


def test_learning_keeps_a_documents_strings_in_little_memory():
    texts = [" ".join(f"word{(i * 37 + k) % 5000}" for k in range(400)).encode() + (b" idiot" if i % 2 else b"") for i in range(400)]
    held = []

    def chosen(toxic, clean, n):
        held.append(sum(sys.getsizeof(x) for x in toxic) / sum(len(x) for x in toxic))
        return choose(toxic, clean, n)

    choose, T._choose = T._choose, chosen
    try:
        assert T.train(texts, [i % 2 == 1 for i in range(400)])
    finally:
        T._choose = choose
    assert held[0] < 20  # bytes a string
