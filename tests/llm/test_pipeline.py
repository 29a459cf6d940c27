import re
from collections import Counter, defaultdict
from itertools import combinations

import numpy as np
import pytest
from pyspark.sql import functions as F

import corpus_pipeline
from veilsift.llm import dedup, simhash
from veilsift.llm.common import durable

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long, rid string"


def grams(text):
    w = (text or "").encode().lower().split()
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} or {tuple(w)}


def groups(rows, least=0.8):
    parent = list(range(len(rows)))

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets = [grams(r[1]) for r in rows]
    for i, j in combinations(range(len(rows)), 2):
        if len(sets[i] & sets[j]) >= least * len(sets[i] | sets[j]):
            parent[max(root(i), root(j))] = min(root(i), root(j))
    out = defaultdict(list)
    for i in range(len(rows)):
        out[root(i)].append(rows[i][0])
    return list(out.values())


def near_rows():
    rng = np.random.default_rng(6)
    words = [f"word{i}" for i in range(500)]
    rows = []
    for g in range(25):
        base = list(rng.choice(words, rng.integers(60, 300)))
        for k in range(int(rng.integers(1, 5))):
            copy = list(base)
            if k:
                copy[int(rng.integers(len(copy)))] = f"new{k}"
            rows.append((len(rows), " ".join(copy), "en", "s", 1, "r"))
    rows += [(900, "", "en", "s", 0, ""), (901, None, None, None, None, None), (902, "Short one", "en", "s", 1, ""), (903, "short ONE", "en", "s", 1, ""), (0, rows[0][1], "en", "s", 1, "r"), (904, "long " * 30_000, "en", "s", 1, "")]
    return rows


@pytest.mark.parametrize("hot", [20_000, 2])
def test_one_of_each_group_stays(spark, monkeypatch, hot):
    monkeypatch.setattr(simhash, "HOT_BUCKET", hot)
    rows = near_rows()
    df = durable(spark.createDataFrame(rows, SCHEMA).repartition(4))
    kept = dedup.one_of_each(df)
    assert kept.columns == df.columns
    ids = Counter(r.doc_id for r in kept.collect())
    for g in groups(rows):
        inside = sum(ids[d] for d in set(g))
        assert inside == 1 and ids[min(g)] == 1, g
    assert dedup.one_of_each(durable(df.where("false"))).count() == 0


def star(n):
    """A text, and copies near to it but not to each other."""
    rng = np.random.default_rng(8)
    base = [f"word{i}" for i in range(200)]
    out = [base]
    for k in range(n):
        copy = list(base)
        for at in rng.choice(np.arange(5, 195, 6), 4, replace=False):
            copy[at] = f"new{k}"
        out.append(copy)
    return [out[k] for k in np.random.default_rng(1).permutation(len(out))]


def chain(n):
    """Texts near only to the ones before and after."""
    words = [f"word{i}" for i in range(200 + 20 * n)]
    return [words[20 * k : 20 * k + 200] for k in np.random.default_rng(9).permutation(n)]


@pytest.mark.parametrize("block", [1024, 50])
@pytest.mark.parametrize("shape", [star, chain])
def test_large_groups_are_settled_in_full(spark, monkeypatch, shape, block):
    monkeypatch.setattr(dedup, "BLOCK", block)
    rows = [(k, " ".join(words), "en", "s", 1, "r") for k, words in enumerate(shape(200))] + [(900, "alone " + " ".join(f"other{i}" for i in range(200)), "en", "s", 1, "r")]
    want = groups(rows)
    assert len(want) == 2
    df = durable(spark.createDataFrame(rows, SCHEMA).repartition(4))
    # one candidate group of all texts
    texts = durable(df.select(F.monotonically_increasing_id().alias("rid"), "doc_id", F.lit(1).cast("long").alias("group"), "text"))
    inside = dedup.components(dedup.verified(texts)).join(texts, F.col("node") == F.col("rid")).select("doc_id", "root").collect()
    assert len({r.root for r in inside}) == 1
    assert sorted(r.doc_id for r in inside) == sorted(max(want, key=len))


def test_row_numbers_hold_however_files_are_read(spark):
    rows = near_rows()
    df = durable(spark.createDataFrame(rows, SCHEMA).repartition(9))
    want = sorted(map(repr, dedup.one_of_each(df).collect()))
    kept = dedup.one_of_each(df)
    mixed = spark.createDataFrame([(r[0], r[1], r[2], f"s{r[0] % 4 if r[0] is not None else 0}", 1, "r") for r in rows], SCHEMA)
    from veilsift.llm.mixing import mixed_documents

    taken = mixed_documents(durable(mixed.repartition(9)))
    plain = sorted(map(repr, taken.collect()))
    before = spark.conf.get("spark.sql.files.minPartitionNum", None)
    spark.conf.set("spark.sql.files.minPartitionNum", "37")  # as executors come or go between the jobs
    try:
        assert sorted(map(repr, kept.collect())) == want
        assert sorted(map(repr, taken.collect())) == plain
    finally:
        spark.conf.unset("spark.sql.files.minPartitionNum") if before is None else spark.conf.set("spark.sql.files.minPartitionNum", before)


def test_recall_of_candidates_on_a_table(spark):
    """Of all pairs of sf0.01 that brute force finds near, those apart after the stage."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    kept = Counter(r.doc_id for r in dedup.one_of_each(docs).select("doc_id").collect())
    holders = defaultdict(list)
    sets = [grams(t) for _, t in rows]
    for i, s in enumerate(sets):
        for g in s:
            holders[g].append(i)
    together = {pair for own in holders.values() for pair in combinations(own, 2)}
    near = [(i, j) for i, j in together if len(sets[i] & sets[j]) >= 0.8 * len(sets[i] | sets[j])]
    both = [(i, j) for i, j in near if kept[rows[i][0]] and kept[rows[j][0]]]
    assert len(near) > 50 and len(both) <= 0.02 * len(near)


def test_null_ids(spark):
    df = durable(spark.createDataFrame([(None, "a b c d e f", "en", "s", 1, ""), (4, "A b c d e f", "en", "s", 1, ""), (None, "", "en", "s", 1, "")], SCHEMA))
    assert sorted(str(r.doc_id) for r in dedup.one_of_each(df).collect()) == ["4", "None"]


def test_stages(spark, tmp_path):
    pipeline = pytest.importorskip("corpus_pipeline")
    data = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{data}/documents.parquet")
    columns, seen = docs.columns, {}
    for name, stage in pipeline.STAGES:
        before = docs
        docs = durable(stage(spark, before, data))
        seen[name] = (before, docs)
        if name != pipeline.STAGES[-1][0]:
            assert docs.columns == columns
    before, after = seen["mixing sources"]
    from veilsift.llm.mixing import mix

    want = {r.doc_id: r.copies for r in mix(before).collect() if r.copies}
    assert {r.doc_id: r["count"] for r in after.groupBy("doc_id").count().collect()} == want
    before, after = seen["packing"]
    texts = before.select("doc_id", F.length("text").alias("n")).collect()
    starts = after.where("start = 0").groupBy("doc_id").count().collect()
    assert Counter(r.doc_id for r in texts) == Counter({r.doc_id: r["count"] for r in starts})
    before, after = seen["quality rules"]
    assert all(len(re.findall(r"\S+", r.text)) >= 50 for r in after.collect())
    assert sorted(r.doc_id for r in pipeline.run(spark, data).select("doc_id").collect()) == sorted(r.doc_id for r in seen["packing"][1].select("doc_id").collect())


def garbage(spark):
    """A weak reference to a Java string that nothing else holds: a full collection clears it."""
    return spark.sparkContext._jvm.java.lang.ref.WeakReference("garbage")


def test_stages_begin_with_a_collection_on_executors(spark, tmp_path, monkeypatch):
    """In local mode the executor's JVM is the driver's."""
    for name in ("clean_documents", "kept_documents", "one_of_each", "mixed_documents", "packed"):
        monkeypatch.setattr(corpus_pipeline, name, lambda docs, *a, **k: docs)
    spark.createDataFrame([], "doc_id long, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    docs = spark.createDataFrame([(1, "a")], "doc_id long, text string")
    for name, stage in corpus_pipeline.STAGES:
        young = garbage(spark)
        stage(spark, docs, str(tmp_path))
        assert young.get() is None, name
