import numpy as np
import pytest
import xxhash

from veilsift.llm import simhash as S


def plain(text, words=3):
    found = (text or "").encode().lower().split()
    grams = [b" ".join(found[i : i + words]) for i in range(max(1, len(found) - words + 1))] if found else []
    hashes = [xxhash.xxh64_intdigest(g, 42) for g in grams]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes))


def brute(rows, k=2, words=3):
    fps = [plain(t, words) for _, t in rows]
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i in range(len(rows)):
        for j in range(i):
            if bin(fps[i] ^ fps[j]).count("1") <= k:
                parent[root(i)] = root(j)
    low = {}
    for i, (d, _) in enumerate(rows):
        low[root(i)] = min(d, low.get(root(i), d))
    return sorted((d, f"{fps[i]:016x}", low[root(i)]) for i, (d, _) in enumerate(rows))


def result(df):
    return sorted(map(tuple, df.select("doc_id", "fingerprint", "component_id").collect()))


def test_groups_match_brute_force(spark):
    rng = np.random.default_rng(1)
    words = [f"w{i}" for i in range(300)]
    rows = [(i, " ".join(rng.choice(words, rng.integers(1, 60)))) for i in range(150)]
    for i in range(150, 220):  # a few words changed in long texts, and copies
        base = " ".join(rng.choice(words, 400)) if i % 7 == 3 else rows[i - 1][1]
        parts = base.split()
        parts[rng.integers(len(parts))] = "changed"
        rows.append((i, " ".join(parts) if i % 3 else base))
    rows += [(900, None), (901, ""), (902, " \n\t"), (903, "One"), (904, "one"), (905, rows[0][1]), (905, rows[0][1])]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumnRenamed("text", "text")
    assert result(S.linked(df.repartition(5))) == brute(rows)


@pytest.mark.parametrize("k", [1, 2, 3, 5, 7])
def test_every_link_is_found_at_any_threshold(spark, k):
    rng = np.random.default_rng(k)
    base = rng.integers(0, 2**63, 40, dtype=np.uint64)
    fps = list(base)
    for b in base:
        for _ in range(6):
            fps.append(b ^ np.uint64(sum(1 << int(x) for x in rng.choice(64, rng.integers(1, 9), replace=False))))
    fps = np.unique(np.array(fps, np.uint64))
    rows = [(int(x),) for x in fps.view(np.int64)]
    got = S.components(S.links(spark.createDataFrame(rows, "fp long"), k)).collect()
    parent = {int(x): int(x) for x in fps.view(np.int64)}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    for i, x in enumerate(fps):
        for y in fps[:i]:
            if bin(int(x ^ y)).count("1") <= k:
                a, b = root(int(x.view(np.int64))), root(int(y.view(np.int64)))
                parent[max(a, b)] = min(a, b)
    want = {x: root(x) for x in parent}
    sizes = {r: sum(v == r for v in want.values()) for r in set(want.values())}
    assert sorted((r.node, r.root) for r in got) == sorted((x, r) for x, r in want.items() if sizes[r] > 1)


def test_hot_buckets_are_salted_without_loss(spark, monkeypatch):
    monkeypatch.setattr(S, "HOT", 5)
    rng = np.random.default_rng(3)
    fps = {int(rng.integers(0, 2**40)) for _ in range(80)}  # the upper bits agree
    fps |= {f ^ (1 << int(rng.integers(40))) for f in fps}
    got = S.components(S.links(spark.createDataFrame([(f,) for f in fps], "fp long"), 2)).collect()
    nodes = {r.node for r in got}
    want = {f for f in fps if any(0 < bin(f ^ g).count("1") <= 2 for g in fps)}
    assert nodes == want


def test_thresholds_satisfy_the_pigeonhole():
    rng = np.random.default_rng(0)
    sample = rng.integers(0, 2**63, 500, dtype=np.uint64)
    for k in range(1, 9):
        groups, thresholds = S.allocate(sample, 10**6, k)
        assert sorted(b for g in groups for b in g) == list(range(64))
        assert sum(t + 1 for t in thresholds) == k + 1


def test_empty_and_extra_columns(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert S.linked(empty).collect() == []
    df = spark.createDataFrame([(1, "a b c", "x", 9), (None, "a b c", "y", 8)], "doc_id long, text string, fp string, component_id int")
    assert {(r.doc_id, r.component_id) for r in S.linked(df).collect()} == {(1, 1), (None, 1)}


def test_wide_search_meets_every_pair_within_its_radius(spark):
    rng = np.random.default_rng(4)
    bits, lanes = 24 * 12, 5
    one = rng.integers(0, 2, (150, bits), np.uint8)
    rows = list(one)
    for r in one:
        for _ in range(3):
            near = r.copy()
            near[rng.choice(bits, rng.integers(1, 40), replace=False)] ^= 1
            rows.append(near)
    rows += [one[0]] * 70  # a bucket that is compared row by row
    raw = [np.packbits(np.concatenate([r, np.zeros(64 * lanes - bits, np.uint8)]), bitorder="little").tobytes() for r in rows]
    df = spark.createDataFrame([(i, bytearray(x)) for i, x in enumerate(raw)], "rid long, fp binary")
    root = {r.node: r.root for r in S.components(S.wide_links(df, 24, 12, 19, 40)).collect()}
    for i in range(len(rows)):
        for j in range(i):
            d = int((rows[i] != rows[j]).sum())
            if d <= 19:
                assert root[i] == root[j]
            elif d > 100:
                assert root.get(i, -1) != root.get(j, -2)
    assert S.components(S.wide_links(df.where("false"), 24, 12, 19, 20)).count() == 0
