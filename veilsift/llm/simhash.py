"""SimHash near duplicates by a generalised pigeonhole search (Charikar 2002; Qin et al. 2018).

The 64 bits are grouped into partitions, correlated bits together, and each partition i gets a threshold t_i >= -1 with
sum(t_i + 1) = k + 1: two fingerprints at k or fewer differing bits then differ in at most t_i bits of some partition i.
Number of partitions and thresholds are chosen by dynamic programming on estimated costs (rows probed plus candidate
pairs), from a sample of SAMPLE distinct fingerprints; the sample steers cost only, any choice finds every link.
All distinct fingerprints are then indexed and probed, and every candidate is verified on all 64 bits.

Equal fingerprints are merged first, so groups of copies of any size cost one row. A task compares its probes with its
index rows in chunks of CHUNK pairs and keeps a spanning forest of the links found, so a bucket of g fingerprints
emits fewer than g links a task. `wide_links` is the same search for fingerprints of hundreds of bits, whose partitions
grow with the logarithm of the table and are probed at threshold 0 or not at all. Buckets above HOT fingerprints are salted: their index rows are repeated for each
salt and their probes spread over the salts.

Nulls: a null text has no words; fingerprint zero. Null ids take part, but do not become a component's id unless all
are null. Repeated rows and equal texts link. An empty table gives an empty result. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from itertools import combinations, repeat

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_ROWS, durable, lookup, ship
from .components import components

SAMPLE = 20_000
CHUNK = 2_000_000
HOT = 50_000
ROWS_A_TASK = 500_000
#: Hashes whose bits are counted at once.
HASHES = 1 << 16
#: Of wide fingerprints: words counted at once, fingerprints that choose the partitions, rows of a bucket whose pairs are
#: compared at once, and rows of one that is linked unseen.
WORD_BLOCK, WIDE_SAMPLE, SMALL, HOT_BUCKET = 1 << 14, 5_000, 64, 20_000


def shingles(text: bytes, words: int) -> list[bytes]:
    """Space-joined runs of so many lower-case (A-Z) words; all words if there are fewer; nothing without a word."""
    found = text.lower().split()
    if not found:
        return []
    return [b" ".join(x) for x in zip(*(found[i:] for i in range(words)))] or [b" ".join(found)]


def simhash(grams: list[bytes], weights: np.ndarray | None = None) -> int:
    """The unsigned fingerprint: a bit is 1 if set in over half the grams' XXH64 (seed 42), by weight if given."""
    count, total = np.zeros(64), 0.0
    hashes = np.fromiter(map(xxhash.xxh64_intdigest, grams, repeat(42)), np.uint64, len(grams))
    for at in range(0, len(hashes), HASHES):
        part = hashes[at : at + HASHES]
        bits = np.unpackbits(part.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
        if weights is None:
            count += bits.sum(0, dtype=np.int64)
            total += len(part)
        else:
            count += weights[at : at + HASHES] @ bits
            total += weights[at : at + HASHES].sum()
    return int(np.packbits(2 * count > total, bitorder="little").view(np.uint64)[0])


def fingerprints(docs: DataFrame, words: int) -> DataFrame:
    """docs (doc_id, text) to (doc_id, fp), fp the fingerprint's bits as a long."""
    ship(docs.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(1).cast(pa.binary()).to_pylist()
            fps = np.fromiter((simhash(shingles(t or b"", words)) for t in texts), np.uint64, len(texts))
            yield pa.record_batch([b.column(0), pa.array(fps.view(np.int64))], ["doc_id", "fp"])

    kind = docs.schema["doc_id"].dataType
    return docs.select("doc_id", F.col("text").cast("string").alias("text")).mapInArrow(run, f"doc_id {kind.simpleString()}, fp long")


def bits_of(fps: np.ndarray) -> np.ndarray:
    return np.unpackbits(fps.astype("<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")


def group_bits(sample: np.ndarray, parts: int) -> list[list[int]]:
    """Bits in `parts` partitions of nearly equal size: each starts with the freest bit and takes its most correlated."""
    if len(sample) > 1:
        x = bits_of(sample).astype(float)
        x -= x.mean(0)
        sd = np.sqrt((x * x).sum(0))
        corr = np.abs(x.T @ x) / np.maximum(np.outer(sd, sd), 1e-9)
    else:
        corr = np.zeros((64, 64))
    free, out = list(range(64)), []
    for p in range(parts):
        size = len(free) // (parts - p)
        group = [max(free, key=lambda b: (corr[b, free].sum(), -b))]
        free.remove(group[0])
        while len(group) < size:
            best = max(free, key=lambda b: (corr[b, group].sum(), -b))
            group.append(best)
            free.remove(best)
        out.append(sorted(group))
    return out


def part_values(fps: np.ndarray, bits: list[int]) -> np.ndarray:
    """The given bits of each fingerprint, packed."""
    out = np.zeros(len(fps), np.uint64)
    for to, bit in enumerate(bits):
        out |= ((fps >> np.uint64(bit)) & np.uint64(1)) << np.uint64(to)
    return out


def flips(width: int, most: int) -> np.ndarray:
    """Masks of up to `most` of `width` bits."""
    return np.array([sum(1 << b for b in c) for n in range(most + 1) for c in combinations(range(width), n)], np.uint64)


def _pair_share(values: np.ndarray, width: int, most: int) -> float:
    """Estimated share of pairs within `most` bits in a partition: counted in the sample, at least as by chance."""
    chance = sum(float(np.prod([(width - i) / (i + 1) for i in range(n)])) for n in range(most + 1)) / 2.0**width
    n = len(values)
    if n < 2:
        return chance
    seen, counts = np.unique(values, return_counts=True)
    near = -float(n)
    for mask in flips(width, min(most, 1)):  # beyond one bit, grown as by chance
        at = np.minimum(np.searchsorted(seen, seen ^ mask), len(seen) - 1)
        near += float((counts * counts[at] * (seen[at] == seen ^ mask)).sum())
    share = near / (n * (n - 1.0))
    if most > 1:
        share *= chance / (sum([1, width]) / 2.0**width)
    return min(1.0, max(share, chance))


def allocate(sample: np.ndarray, total: int, k: int) -> tuple[list[list[int]], list[int]]:
    """Partitions and thresholds of least estimated cost."""
    best: tuple[float, list[list[int]], list[int]] | None = None
    for parts in range(1, k + 2):
        groups = group_bits(sample, parts)
        cost = []
        for bits in groups:
            values, row = part_values(sample, bits), [0.0]
            for t in range(min(k, 4) + 1):
                probes = float(len(list(combinations(range(len(bits)), t)))) if t < 2 else float(np.prod([(len(bits) - i) / (i + 1) for i in range(t)]))
                before = row[-1] if t else 0.0
                row.append(0.05 * total * total * _pair_share(values, len(bits), t) / 2 + total * (1.0 if t == 0 else probes) + (before if t > 1 else 0.0))
            cost.append(row)
        # table[u]: least cost with sum(t + 1) = u
        table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
        for row in cost:
            nxt: dict[int, tuple[float, list[int]]] = {}
            for used, (c, ts) in table.items():
                for step, extra in enumerate(row):
                    u = used + step
                    if u <= k + 1 and (u not in nxt or c + extra < nxt[u][0]):
                        nxt[u] = (c + extra, [*ts, step - 1])
            table = nxt
        if k + 1 in table and (best is None or table[k + 1][0] < best[0]):
            best = (table[k + 1][0], groups, table[k + 1][1])
    assert best is not None
    return best[1], best[2]


def forest(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A spanning forest of the links."""
    nodes, flat = np.unique(np.concatenate([a, b]), return_inverse=True)
    parent = list(range(len(nodes)))

    def root(x: int) -> int:
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    keep = []
    for i, (x, y) in enumerate(zip(flat[: len(a)].tolist(), flat[len(a) :].tolist())):
        x, y = root(x), root(y)
        if x != y:
            parent[max(x, y)] = min(x, y)
            keep.append(i)
    return a[keep], b[keep]


def _matches(index_keys: np.ndarray, index_fps: np.ndarray, keys: np.ndarray, fps: np.ndarray, own: bool, k: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Verified links of the probes with the index rows of their key. own: the probes are the index rows."""
    order = np.argsort(index_keys, kind="stable")
    index_keys, index_fps = index_keys[order], index_fps[order]
    if own:
        keys, fps = index_keys, index_fps
        low = np.arange(1, len(keys) + 1)
    else:
        low = np.searchsorted(index_keys, keys, "left")
    count = np.searchsorted(index_keys, keys, "right") - low
    has = count > 0
    fps, low, count = fps[has], low[has], count[has]
    ends = np.cumsum(count)
    at = 0
    while at < len(fps):
        done = int(ends[at - 1]) if at else 0
        to = max(at + 1, int(np.searchsorted(ends, done + CHUNK, "right")))
        n = count[at:to]
        if to == at + 1 and n[0] > CHUNK:  # one probe, a long run of index rows
            spans = [(s, min(s + CHUNK, int(n[0]))) for s in range(0, int(n[0]), CHUNK)]
        else:
            spans = [(0, -1)]
        for s, e in spans:
            if e < 0:
                first = np.repeat(fps[at:to], n)
                where = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
            else:
                first, where = np.repeat(fps[at:to], e - s), np.arange(low[at] + s, low[at] + e)
            second = index_fps[where]
            good = (np.bitwise_count(first ^ second) <= k) & (first != second)
            if good.any():
                yield first[good], second[good]
        at = to


def links(distinct: DataFrame, k: int) -> DataFrame:
    """Links (a, b) between distinct fingerprints (fp) at k or fewer differing bits: all that their components need."""
    spark = distinct.sparkSession
    ship(spark)
    total = distinct.count()
    rows = distinct.orderBy(F.xxhash64("fp", F.lit("sample"))).limit(SAMPLE).toPandas()["fp"].to_numpy(np.int64)
    groups, thresholds = allocate(rows.view(np.uint64), total, k)
    plan = [(p, bits, t, flips(len(bits), t)) for p, (bits, t) in enumerate(zip(groups, thresholds)) if t >= 0]

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                fps = np.asarray(whole.column(0).slice(at, 2000)).view(np.uint64)
                for p, bits, t, masks in plan:
                    value = part_values(fps, bits)
                    yield _rows(p, value, fps, 0)
                    for some in np.array_split(masks, max(1, len(masks) // 64)) if t else ():
                        yield _rows(p, (value[:, None] ^ some[None, :]).ravel(), np.repeat(fps, len(some)), 1)

    def _rows(p: int, value: np.ndarray, fps: np.ndarray, kind: int) -> pa.RecordBatch:
        n = len(value)
        return pa.record_batch([pa.array(np.full(n, p, np.int32)), pa.array(value.view(np.int64)), pa.array(fps.view(np.int64)), pa.array(np.full(n, kind, np.int32))], ["part", "value", "fp", "kind"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        part, value, fp, kind = (np.concatenate([np.asarray(b.column(i)) for b in got]) for i in range(4))
        value, fp = value.view(np.uint64), fp.view(np.uint64)
        a, b = np.zeros(0, np.uint64), np.zeros(0, np.uint64)
        for p, _, t, _ in plan:
            here = part == p
            index, probe, cold = here & (kind != 1), here & (kind == 1), here & (kind == 0)
            sides = [(index, value[probe], fp[probe], False)]
            if t == 0:  # index rows probe for themselves, but for salted ones (kind 2)
                sides.append((cold, value[cold], fp[cold], True))
            for side, keys, fps, same in sides:
                for x, y in _matches(value[side], fp[side], keys, fps, same, k):
                    a, b = np.concatenate([a, x]), np.concatenate([b, y])
                    if len(a) > CHUNK:
                        a, b = forest(a, b)
        if len(a):
            a, b = forest(a, b)
            yield pa.record_batch([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["a", "b"])

    keyed = distinct.select("fp").mapInArrow(spread, "part int, value long, fp long, kind int")
    made = total * sum(1 + (len(m) if t else 0) for _, _, t, m in plan)
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made // ROWS_A_TASK))
    hot = durable(keyed.where("kind = 0").groupBy("part", "value").count().where(F.col("count") > HOT).select("part", "value", F.ceil(F.col("count") / HOT).cast("int").alias("salts")))
    if hot.isEmpty():
        dealt = keyed.repartition(tasks, "part", "value")
    else:
        # a hot index row goes to every salt as kind 2, and to one as a probe
        every = F.transform(F.sequence(F.lit(0), F.col("salts") - 1), lambda i: F.struct(i.alias("salt"), F.lit(2).alias("as")))
        one = F.array(F.struct(F.pmod(F.xxhash64("fp"), F.col("salts")).cast("int").alias("salt"), F.lit(1).alias("as")))
        cold = F.array(F.struct(F.lit(0).alias("salt"), F.col("kind").alias("as")))
        to = F.when(F.col("salts").isNull(), cold).when(F.col("kind") == 0, F.concat(every, one)).otherwise(one)
        salted = keyed.join(F.broadcast(hot) if hot.count() <= BROADCAST_ROWS else hot, ["part", "value"], "left")
        dealt = salted.select("part", "value", "fp", F.explode(to).alias("to")).repartition(tasks, "part", "value", "to.salt").select("part", "value", "fp", F.col("to.as").alias("kind"))
    return dealt.mapInArrow(compare, "a long, b long")


class _Places(dict):
    """Words to places in the order they come."""

    def __missing__(self, word: bytes) -> int:
        place = self[word] = len(self)
        return place


def word_fingerprints(texts: list[list[bytes]], bits: int, longest: int) -> list[bytes]:
    """Fingerprints of that many bits of texts' words; a word weighs the root of its count times its length up to `longest`."""
    lanes = -(-bits // 64)
    places = _Places()
    flat = np.fromiter(map(places.__getitem__, (w for words in texts for w in words)), np.int64)
    owner = np.repeat(np.arange(len(texts)), np.fromiter(map(len, texts), np.int64, len(texts)))
    words = list(places)
    key, count = np.unique(owner * max(1, len(words)) + flat, return_counts=True)
    place = key % max(1, len(words))
    weight = (np.sqrt(count) * np.minimum(np.fromiter(map(len, words), np.int64, len(words)), longest)[place]).astype(np.float32)
    # lane k of a word's bits is its hash after k steps of a 64-bit mixer
    x = np.fromiter(map(xxhash.xxh64_intdigest, words, repeat(42)), np.uint64, len(words))[:, None] + np.arange(lanes, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    table = (x ^ (x >> np.uint64(31))).view(np.uint8).reshape(len(words), 8 * lanes)
    cuts = np.searchsorted(key, np.arange(len(texts) + 1) * max(1, len(words)))
    out = []
    for start, end in zip(cuts[:-1].tolist(), cuts[1:].tolist()):
        sums = np.zeros(64 * lanes, np.float32)
        for at in range(start, end, WORD_BLOCK):
            to = min(end, at + WORD_BLOCK)
            sums += weight[at:to] @ np.unpackbits(table[place[at:to]], axis=1, bitorder="little").astype(np.float32)
        out.append(np.packbits(2 * sums > weight[start:end].sum(), bitorder="little").tobytes())
    return out


def allocate_wide(sample: np.ndarray, parts: int, bits: int, k: int) -> list[np.ndarray]:
    """The bits of the partitions to probe, each at threshold 0: dynamic programming picks thresholds of 0 or -1 that add
    up, each plus 1, to k + 1 at the least number of expected candidates. sample: rows of 0 and 1."""
    n = len(sample)
    x = sample.astype(np.float32)
    x -= x.mean(0) if n else 0
    sd = np.sqrt((x * x).sum(0))
    corr = np.abs(x.T @ x) / np.maximum(np.outer(sd, sd), 1e-6)
    free, groups = np.ones(parts * bits, bool), []
    for _ in range(parts):  # each starts with the freest bit and takes its most correlated
        tie = corr[:, free].sum(1)
        group: list[int] = []
        for _ in range(bits):
            best = int(np.where(free, tie, -1.0).argmax())
            tie = corr[:, best].copy() if not group else tie + corr[:, best]
            group.append(best)
            free[best] = False
        groups.append(np.array(sorted(group)))
    shares = []
    for g in groups:
        _, count = np.unique(np.packbits(sample[:, g], axis=1), axis=0, return_counts=True) if n else (None, np.zeros(0))
        shares.append(max(2.0**-bits, float((count * (count - 1.0)).sum()) / max(1.0, n * (n - 1.0))))
    # table[u]: least expected candidates of u probed partitions
    table: dict[int, tuple[float, list[int]]] = {0: (0.0, [])}
    for p, share in enumerate(shares):
        for used in sorted(table, reverse=True):
            cost, chosen = table[used]
            if used <= k and (used + 1 not in table or cost + share < table[used + 1][0]):
                table[used + 1] = (cost + share, [*chosen, p])
    return [groups[p] for p in table[k + 1][1]]


def _bucket_links(fps: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of a spanning forest of the rows (of 64-bit words) that differ in at most `most` bits."""
    label = np.arange(len(fps))
    a: list[np.ndarray] = []
    b: list[np.ndarray] = []

    def reach(i: int) -> None:
        """Join all components that have a row near row i."""
        others = np.flatnonzero(label != label[i])
        near = others[np.bitwise_count(fps[others] ^ fps[i]).sum(1) <= most]
        parts, first = np.unique(label[near], return_index=True)
        a.append(np.full(len(first), i))
        b.append(near[first])
        label[np.isin(label, parts)] = label[i]

    reach(0)
    values, count = np.unique(label, return_counts=True)
    for i in np.flatnonzero(label != values[count.argmax()]):  # of two rows apart, one is outside the largest component
        reach(int(i))
    return np.concatenate(a), np.concatenate(b)


def _wide_pairs(key: np.ndarray, fps: np.ndarray, most: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of near rows of equal keys; a forest of them in buckets above SMALL rows. Rows are in order of key."""
    start = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.append(start, len(key)))
    for s, n in zip(start[size > SMALL], size[size > SMALL]):
        a, b = _bucket_links(fps[s : s + n], most)
        yield s + a, s + b
    # pairs of small buckets: every row with the later ones of its bucket
    later = np.repeat(np.where(size > SMALL, 0, start + size), size) - np.arange(len(key)) - 1
    rows = np.flatnonzero(later > 0)
    later = later[rows]
    ends = np.cumsum(later)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = later[at:to]
        a = np.repeat(rows[at:to], n)
        b = a + 1 + np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
        good = np.bitwise_count(fps[a] ^ fps[b]).sum(1) <= most
        yield a[good], b[good]
        at = to


def wide_links(rows: DataFrame, parts: int, bits: int, k: int, most: int) -> DataFrame:
    """Links (a, b) between the ids of rows (rid, fp), fp of parts * bits bits, that their candidate groups need.

    k + 1 partitions are probed at threshold 0, so rows that differ in at most k bits meet for certain, and others as
    likely as one partition agrees; rows that meet are linked if at most `most` of their first 128 bits differ. A row
    makes k + 1 rows at any table size. Buckets above HOT_BUCKET rows are linked unseen, each row to the least: callers
    verify. rid is not null.
    """
    spark = rows.sparkSession
    ship(spark)
    total = rows.count()
    lanes = -(-parts * bits // 64)

    def unpacked(column: pa.Array | list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        raw = np.frombuffer(b"".join(column), np.uint8).reshape(-1, 8 * lanes)
        return raw, np.unpackbits(raw, axis=1, bitorder="little")[:, : parts * bits]

    some = [bytes(r.fp) for r in rows.orderBy(F.xxhash64("rid", F.lit("sample"))).limit(WIDE_SAMPLE).select("fp").collect()]
    groups = allocate_wide(unpacked(some)[1], parts, bits, k)

    def spread(batches: Iterator[pa.RecordBatch], whole: bool) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 4000):
                b = batch.slice(at, 4000)
                raw, one = unpacked(b.column(1).to_pylist())
                words = raw[:, :16].copy().view(np.uint64).view(np.int64)
                for p, g in enumerate(groups):
                    value = np.zeros((len(raw), 8), np.uint8)
                    packed = np.packbits(one[:, g], axis=1, bitorder="little")
                    value[:, : packed.shape[1]] = packed
                    key = pa.array(value.view(np.int64).ravel() | (p << 48))
                    yield pa.record_batch([key, b.column(0), pa.array(words[:, 0]), pa.array(words[:, 1])], ["key", "rid", "v0", "v1"]) if whole else pa.record_batch([key], ["key"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, rid, v0, v1 = (np.concatenate([np.asarray(b.column(i)) for b in got]) for i in range(4))
        order = np.argsort(key, kind="stable")
        key, rid, fps = key[order], rid[order], np.stack([v0, v1], 1)[order].view(np.uint64)
        a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
        for x, y in _wide_pairs(key, fps, most):
            a, b = np.concatenate([a, rid[x]]), np.concatenate([b, rid[y]])
            if len(a) > CHUNK:
                a, b = forest(a, b)
        if len(a):
            a, b = forest(a, b)
            yield pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    keyed = rows.select("rid", "fp").mapInArrow(lambda x: spread(x, True), "key long, rid long, v0 long, v1 long")
    keys = rows.select("rid", "fp").mapInArrow(lambda x: spread(x, False), "key long")
    hot = durable(keys.groupBy("key").count().where(F.col("count") > HOT_BUCKET).select(F.col("key").alias("hot")))
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-total * (k + 1) // ROWS_A_TASK))
    cold, stars = keyed, None
    if not hot.isEmpty():
        few = lookup(hot)
        cold = keyed.join(few, F.col("key") == F.col("hot"), "left_anti")
        mine = keyed.join(few, F.col("key") == F.col("hot")).select("key", "rid")
        least = lookup(durable(mine.groupBy("key").agg(F.min("rid").alias("low")).withColumnRenamed("key", "of")))
        stars = mine.join(least, F.col("key") == F.col("of")).where(F.col("rid") != F.col("low")).select(F.col("rid").alias("a"), F.col("low").alias("b"))
    found = cold.repartition(tasks, "key").mapInArrow(compare, "a long, b long")
    return found if stars is None else found.unionByName(stars)


def linked(docs: DataFrame, *, words: int = 3, k: int = 2) -> DataFrame:
    """docs (doc_id, text) to doc_id, fingerprint (16 hex digits), component_id (least doc_id reachable)."""
    fps = durable(fingerprints(docs, words))
    distinct = durable(fps.groupBy("fp").agg(F.min("doc_id").alias("first")))
    roots = components(links(distinct.select("fp"), k))
    least = roots.join(distinct, F.col("node") == F.col("fp")).select("node", "root", "first")
    lowest = least.groupBy("root").agg(F.min("first").alias("component"))
    of_root = durable(least.join(lowest, "root").select(F.col("node").alias("fp"), "component"))
    alone = distinct.join(of_root, "fp", "left").select("fp", F.coalesce("component", "first").alias("component_id"))
    out = fps.join(alone, "fp")
    return out.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
