from itertools import combinations

import numpy as np
import pytest

from veilsift.llm import dedup, setjoin
from veilsift.llm.common import durable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string"


def test_near_copies_with_other_frequent_words_go(spark):
    """Five-word shingles alike, but the words that weigh most, those repeated, differ: no fingerprint brings them together."""
    rows = []
    for g in range(20):
        shared = " ".join(f"w{g}x{i}" for i in range(120))
        for k in range(2):
            cycle = " ".join(f"repeated{g}y{k}z{i}" for i in range(3))
            rows.append((2 * g + k, f"{shared} {' '.join([cycle] * 400)}", "en", "s", 1, "r"))
    sets = [dedup.shingle_hashes(r[1].encode()) for r in rows]
    assert all(dedup.near(sets[2 * g], sets[2 * g + 1]) for g in range(20))
    kept = dedup.one_of_each(durable(spark.createDataFrame(rows, SCHEMA).repartition(4))).select("doc_id").collect()
    assert sorted(r.doc_id for r in kept) == list(range(0, 40, 2))


def table_rows():
    rng = np.random.default_rng(12)
    rows, passage = [], [f"common{i}" for i in range(30)]
    for g in range(40):
        base = [f"w{x}" for x in rng.integers(0, 400, rng.integers(1, 60))] + (passage if g % 2 else [])
        for _ in range(4):
            copy = list(base)
            for at in rng.integers(0, len(copy), rng.integers(0, 3)):
                copy[at] = f"new{rng.integers(9)}"
            rows.append((len(rows), " ".join(copy)))
    return [*rows, (900, None), (901, ""), (902, "a a a a a"), (903, "a a a a a a"), (904, "one two"), (905, "ONE two")]


@pytest.mark.parametrize("hot", [20_000, 4])
@pytest.mark.parametrize("repeated", [3, 10_000])
@pytest.mark.parametrize("labels", [1, 30])
def test_every_pair_apart_is_found(spark, monkeypatch, hot, repeated, labels):
    monkeypatch.setattr(setjoin, "HOT", hot)
    monkeypatch.setattr(setjoin, "REPEATED", repeated)
    rows = table_rows()
    label = {r[0]: r[0] // labels for r in rows if r[0] != 3}
    sets = {r[0]: dedup.shingle_hashes((r[1] or "").encode()) for r in rows}
    want = {(a, b) for a, b in combinations(sorted(label), 2) if label[a] != label[b] and len(sets[a]) and len(sets[b]) and dedup.near(sets[a], sets[b])}
    texts = durable(spark.createDataFrame(rows, "rid long, text string").repartition(4))
    named = durable(spark.createDataFrame(list(label.items()), "rid long, label long"))
    found = setjoin.near_links(texts, named, dedup.shingle_hashes, dedup.near, 0.8).collect()
    assert len(found) == len(want) and {(r.a, r.b) for r in found} == want
    assert labels > 1 or len(want) > 50
    assert setjoin.near_links(texts.where("false"), named, dedup.shingle_hashes, dedup.near, 0.8).count() == 0


def test_unrelated_long_sets_are_ruled_out_before_the_whole_sets_travel(spark):
    """Maps of 1,024 bits tell nothing of 5,000 elements; texts that share some of what they must show were all compared in full."""
    shared = " ".join(f"passage{i}" for i in range(300))
    rows = [(g, " ".join(f"w{g}x{i}" for i in range(4700)) + " " + shared) for g in range(6)]
    rows.append((6, rows[0][1].replace("w0x9 ", "other ")))

    def strict(a, b):
        both = len(np.intersect1d(a, b))
        assert both > 0.5 * (len(a) + len(b) - both)
        return dedup.near(a, b)

    def hashed(text):
        """Sets in which the shared elements come first."""
        first = set(dedup.shingle_hashes(shared.encode()).tolist())
        return np.sort(np.array([x >> 32 if x in first else x | 1 << 63 for x in dedup.shingle_hashes(text).tolist()], np.uint64))

    texts = durable(spark.createDataFrame(rows, "rid long, text string").repartition(2))
    labels = durable(texts.selectExpr("rid", "rid AS label"))
    assert [(r.a, r.b) for r in setjoin.near_links(texts, labels, hashed, strict, 0.8).collect()] == [(0, 6)]


def test_maps_of_any_sizes_lose_no_pair():
    rng = np.random.default_rng(5)
    for n in (1, 5, 1000, 1024, 1030, 2050, 5000, 9000):
        a = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        for drop, add in ((0.0, 0.0), (0.1, 0.1), (0.19, 0.0), (0.0, 0.24)):
            b = np.unique(np.concatenate([a[int(drop * n) :], rng.integers(0, 1 << 63, int(add * n), np.uint64)]))
            x, y = (len(s).to_bytes(8, "big") + setjoin.parity(s) for s in (a, b))
            assert dedup.near(a, b) <= setjoin.possible(x, y, 0.8)
        other = np.unique(rng.integers(0, 1 << 63, n, np.uint64))
        assert not setjoin.possible(x, len(other).to_bytes(8, "big") + setjoin.parity(other), 0.8)


def test_counts_of_frequent_elements_are_bounded():
    rng = np.random.default_rng(6)
    keys = np.minimum(rng.zipf(1.5, 30_000), 5_000)
    key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for some in np.array_split(keys, 7):
        key, count = setjoin.frequent(np.concatenate([key, some]), np.concatenate([count, np.ones(len(some), np.int64)]), 50)
        assert len(key) <= 50
    got, true = dict(zip(key.tolist(), count.tolist())), np.bincount(keys)
    assert all(true[k] - len(keys) / 51 <= got.get(k, 0) <= true[k] for k in range(1, 5_001))


def formed(spark, rows):
    """Candidates of texts that are all labelled apart."""
    texts = durable(spark.createDataFrame(rows, "rid long, text string").repartition(4))
    common, counts = setjoin._common(texts, dedup.shingle_hashes)
    shown = setjoin._prefixes(texts, dedup.shingle_hashes, common, counts, 0.8).join(texts.selectExpr("rid", "rid AS label"), "rid")
    return setjoin.candidates(durable(shown), 0.8).count()


def test_edited_copies_that_stay_apart_form_few_candidates(spark):
    """All pairs share most of their elements; a candidate a pair were 3,160."""
    rng = np.random.default_rng(3)
    rows = []
    for k in range(80):
        words = [f"word{i}" for i in range(150)]
        for at in rng.choice(np.arange(3, 147, 6), 4, replace=False):
            words[at] = f"new{k}x{at}"
        rows.append((k, " ".join(words)))
    sets = [dedup.shingle_hashes(t.encode()) for _, t in rows]
    assert not any(dedup.near(a, b) for a, b in combinations(sets, 2))
    assert formed(spark, rows) < 400


def test_passages_that_a_sample_misses_form_few_candidates(spark, monkeypatch):
    """Each of 30 passages lies in 8 texts, of which a sample of 12 texts holds hardly any; a candidate a pair were 840."""
    monkeypatch.setattr(setjoin, "SAMPLE", 12)
    rows = []
    for k in range(240):
        passage = [f"p{k // 8}x{i}" for i in range(20)]
        rows.append((k, " ".join([f"w{k}x{i}" for i in range(90)] + passage)))
    assert formed(spark, rows) < 100
