import math
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
import xxhash

from veilsift.llm import pitmanyor as M


def sample():
    rng = np.random.default_rng(5)
    a, b = [f"a{i}" for i in range(60)], [f"b{i}" for i in range(60)]
    rows = []
    for i in range(240):
        words = rng.choice(a if i % 2 else b, rng.integers(1, 80), p=np.arange(60, 0, -1) / 1830)
        rows.append((i, " ".join(w.upper() if rng.random() < 0.1 else w for w in words), "x"))
    rows += [(500, None, ""), (501, "", ""), (502, "never seen É words\n\there", ""), (503, "a1 " * 40_000, ""), (None, "a1 b1", ""), (7, rows[7][1], "")]
    return rows


SCHEMA = "doc_id long, text string, n_tokens string"


def words_of(text):
    return (text or "").encode().lower().split() + [None]


def held(doc_id):
    return doc_id is not None and zlib.crc32(str(doc_id).encode()) % 7 == 2


def counted(rows):
    c = Counter()
    for d, t, _ in rows:
        if not held(d):
            c.update(words_of(t))
    return c


@pytest.mark.parametrize("entries", [1_500_000, 40, 0])
def test_base_and_counts(spark, monkeypatch, entries):
    monkeypatch.setattr(M, "HEAD_ENTRIES", entries)
    rows = sample()
    out = M.scored(spark.createDataFrame(rows, SCHEMA).repartition(6)).collect()
    c = counted(rows)
    n, v = sum(c.values()), len(c)
    assert len(out) == len(rows)
    want = defaultdict(list)
    for d, t, _ in rows:
        w = words_of(t)
        want[d].append((held(d), len(w), sum(c[x] > 0 for x in w), n, round(sum(math.log10((c[x] + 1) / (n + v + 1)) for x in w), 4)))
    got = defaultdict(list)
    for r in out:
        got[r.doc_id].append((r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 4)))
    assert {k: sorted(x) for k, x in got.items()} == {k: sorted(x) for k, x in want.items()}
    tokens = sum(r.n_tokens for r in out if r.held_out)
    ppl = [10 ** (-sum(getattr(r, k) for r in out if r.held_out) / tokens) for k in ("base_score", "score")]
    assert ppl[1] < ppl[0]


def test_probabilities_of_a_context_add_up_to_one(spark):
    rows = sample()
    docs = spark.createDataFrame(rows, SCHEMA).select("doc_id", "text").where("doc_id is not null")
    train = [r for r in rows if r[0] is not None]
    shards = M.build(M.counts(docs, 3), 3)
    shards.persist()
    totals = M._sum_rows(shards)
    hyper = M.draws(totals)
    model = M.sample(shards, totals, hyper)
    model.persist()
    p, head = M.Predictive.of(M._sample_sums(model), hyper), M._head(model)
    seen = {w for _, t, _ in train for w in words_of(t)}
    hashes = np.array([xxhash.xxh64_intdigest(M.END if w is None else w) for w in seen], np.uint64).view(np.int64)
    at, there = head.find(hashes)
    assert there.all() and p.words == len(seen)
    for context in (0, M.context_of(b"a1"), M.context_of(b"zzz")):
        where = np.full(len(at), context)
        known = 10 ** head.score(at, there, where, p)[0]
        unknown = 10 ** head.score(at[:1], np.array([False]), where[:1], p)[0]
        assert known.sum() + unknown.sum() == pytest.approx(1.0, abs=1e-4)


def test_seating_is_exact():
    """Tables of one dish against the enumeration of its conditional."""
    discount, strength, base, others, c = 0.5, 2.0, 0.3, 4, 6
    table = M.stirling(M.EXACT, discount)
    rng = np.random.default_rng(0)
    n = 200_000
    drawn = M.seat(np.full(n, c), np.full(n, others), np.full(n, base), discount, strength, table, rng)
    weight = [np.exp(table[c, t]) * np.prod([(strength + discount * (others + k)) * base for k in range(t)]) for t in range(1, c + 1)]
    assert np.allclose(np.bincount(drawn, minlength=c + 1)[1:] / n, np.array(weight) / sum(weight), atol=5e-3)
    many = M.seat(np.full(5000, 2000), np.full(5000, others), np.full(5000, base), discount, strength, table, rng)
    assert many.min() >= 1 and many.max() <= 2000


def test_no_training_text_and_empty(spark):
    df = spark.createDataFrame([(i, "a b", "") for i in range(30) if held(i)], SCHEMA)
    out = M.scored(df).collect()
    assert len(out) == df.count() and all((r.n_known, r.train_tokens, r.base_score) == (0, 0, 0.0) and r.score == 0 for r in out)
    assert M.scored(df.where("false")).count() == 0


def test_draw_finds_the_discount_of_a_seating():
    """Restaurants seated customer by customer with known parameters."""
    rng = np.random.default_rng(3)
    discount, strength, base = 0.5, 2.0, 1 / 50
    customers, tables, n, t = [], [], [], []
    for _ in range(150):
        dishes: dict[int, list[int]] = defaultdict(list)
        opened = 0
        for i in range(60):
            if rng.random() < (strength + discount * opened) / (strength + i):
                dishes[int(rng.integers(0, 50))].append(1)
                opened += 1
            else:
                every = [(d, k) for d, sizes in dishes.items() for k in range(len(sizes))]
                weight = np.array([dishes[d][k] - discount for d, k in every])
                d, k = every[rng.choice(len(every), p=weight / weight.sum())]
                dishes[d][k] += 1
        customers.append(60.0)
        tables.append(float(opened))
        n += [sum(s) for s in dishes.values()]
        t += [len(s) for s in dishes.values()]
    evidence = M._evidence(np.array(n), np.array(t))
    d, s = M.draw(evidence, np.array(customers), np.array(tables), rng)
    assert abs(d - discount) <= 0.1 and 0.5 <= s <= 8


def test_head_holds_the_most_frequent_words(spark, monkeypatch):
    """By counts over all texts, whatever the parts."""
    docs = spark.createDataFrame([(i, "often " * 50 + f"rare{i} seldom{i % 3}", "") for i in range(40)], SCHEMA)
    shards = M.build(M.counts(docs.select("text"), 5), 5).persist()
    totals = M._sum_rows(shards)
    model = M.sample(shards, totals, M.draws(totals)).persist()
    assert len(M._head(model).hash) == 45
    monkeypatch.setattr(M, "HEAD_ENTRIES", 60)
    head = M._head(model)
    often = np.array([xxhash.xxh64_intdigest(b"often")], np.uint64).view(np.int64)
    assert head.find(often)[1].all() and head.count.min() >= 13 and len(head.hash) < 45


def test_rounds_begin_with_a_collection_on_executors(spark, monkeypatch):
    """Before the counts, the second round and the scoring."""
    made = []
    for name in ("settle", "build", "sample"):
        monkeypatch.setattr(M, name, lambda *a, f=getattr(M, name), name=name: made.append(name) or f(*a))
    assert M.scored(spark.createDataFrame(sample()[:40], SCHEMA)).count() == 40
    assert made == ["settle", "build", "settle", "sample", "settle"]
