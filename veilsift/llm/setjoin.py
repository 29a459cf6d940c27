"""All pairs of sets at a Jaccard similarity or above, by prefixes (Chaudhuri et al. 2006; Xiao et al. 2008).

Of two sets of n and m elements in one common order that reach a similarity t, the first n - ceil(t n) + 1 elements of one
and the first m - ceil(t m) + 1 of the other share an element. So texts that share no such element need no comparison, and
the rest are candidates unless their sizes, the places of the first element they share, or their parity maps (a bit for an odd number
of elements in a bin; elements in one set only flip at most one bit each) rule the similarity out. A map has a bit an element
or more, else it would tell nothing of a large set; of two maps the longer is folded. No filter loses a pair. Candidates are
verified on the whole sets.

The order puts elements held repeatedly last, by count: those of hashes below LOW are counted in all texts, others in a
sample of SAMPLE texts. Elements held once come first by hash, so most of what a text shows has been counted in full. It
steers cost only. A pair passes at the first element it shares, with nothing shared before it, so copies of a text that
differ in rare elements and stay apart form few candidates, though they share most elements. Texts carry a label, and pairs of one label are linked already: they are not formed. An element shared by more than HOT texts is dealt
to tasks in pairs of blocks; such elements are found by counts within tasks (Misra and Gries 1982), which shuffle few of
them. What a step wrote or shuffled is deleted once nothing reads it. A text makes about (1 - t) n rows at any table size; texts that share their
first elements and stay apart cost a candidate a pair.

Empty sets have no element and no pair. An empty table gives no links. rid and label are not null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from math import ceil

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, durable, give_back, lookup, remove_scratch, ship

#: Texts whose elements are all counted for the order, elements kept of it, and the count from which an element is kept.
SAMPLE, COMMON, REPEATED = 20_000, 200_000, 3
#: Elements below it are counted in all texts, and of equal count come first; texts of a task that counts them.
LOW, TEXTS_A_TASK = np.uint64(3 << 61), 10_000
#: Rows of an element above which it is dealt in blocks, rows of a task, and pairs formed at once.
HOT, ROWS_A_TASK, CHUNK = 20_000, 500_000, 1_000_000
#: Least bits of a parity map, a power of two.
MAP = 1024
#: Elements that a task counts at least.
COUNTED = 4096


def prefix(elements: np.ndarray, common: np.ndarray, counts: np.ndarray, least: float) -> np.ndarray:
    """The elements that a set must show, in the common order. elements and common ascend."""
    n = len(elements)
    if not n:
        return elements
    rank = np.zeros(n, np.int64)
    if len(common):
        at = np.minimum(np.searchsorted(common, elements), len(common) - 1)
        rank = np.where(common[at] == elements, counts[at], 0)
    return elements[np.lexsort((elements, rank))[: n - ceil(least * n - 1e-9) + 1]]


def parity(elements: np.ndarray) -> bytes:
    bits = max(MAP, 1 << max(0, len(elements) - 1).bit_length())
    odd = np.bincount((elements % np.uint64(bits)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def possible(x: bytes, y: bytes, least: float) -> bool:
    """Whether sizes (8 bytes) and parity maps leave the similarity possible."""
    n, m = int.from_bytes(x[:8], "big"), int.from_bytes(y[:8], "big")
    if min(n, m) < least * max(n, m) - 1e-6:
        return False
    maps = [np.frombuffer(f, np.uint8, offset=8) for f in (x, y)]
    width = min(map(len, maps))
    a, b = (np.bitwise_xor.reduce(p.reshape(-1, width)) for p in maps)
    return int(np.bitwise_count(a ^ b).sum()) <= (1 - least) / (1 + least) * (n + m) + 1e-6


def frequent(key: np.ndarray, count: np.ndarray, most: int) -> tuple[np.ndarray, np.ndarray]:
    """At most `most` of the keys, and counts of them: none is too high, or too low by more than all counts / (most + 1)."""
    key, at = np.unique(key, return_inverse=True)
    count = np.bincount(at, count, len(key)).astype(np.int64)
    if len(key) > most:
        count -= np.partition(count, len(key) - most - 1)[len(key) - most - 1]
    return key[count > 0], count[count > 0]


def bucket_pairs(key: np.ndarray, label: np.ndarray, size: np.ndarray, place: np.ndarray, least: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places of rows of one key and two labels that may reach the similarity. Rows are in order of key, label."""
    if not len(key):
        return
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    run = np.flatnonzero(np.concatenate([[True], (key[1:] != key[:-1]) | (label[1:] != label[:-1])]))
    end = np.repeat(np.append(first[1:], len(key)), np.diff(np.append(first, len(key))))
    low = np.repeat(np.append(run[1:], len(key)), np.diff(np.append(run, len(key))))
    rows = np.flatnonzero(end > low)
    low, count = low[rows], (end - low)[rows]
    ends = np.cumsum(count)
    at = 0
    while at < len(rows):
        to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + CHUNK, "right")))
        n = count[at:to]
        a = np.repeat(rows[at:to], n)
        b = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(low[at:to], n)
        # a pair need only pass at the first element it shares: none before, at most the rest from it on
        most = np.minimum(size[a] - place[a], size[b] - place[b])
        good = most >= least / (1 + least) * (size[a] + size[b]) - 1e-6
        yield a[good], b[good]
        at = to


def _prefixes(sets: DataFrame, hashed: Callable[[bytes], np.ndarray], common: np.ndarray, counts: np.ndarray, least: float) -> DataFrame:
    """(rid, text) to (rid, size, shown, map)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            size, shown, maps = [], [], []
            for text in b.column(1).cast(pa.binary()).to_pylist():
                elements = hashed(text or b"")
                size.append(len(elements))
                shown.append(prefix(elements, common, counts, least).tobytes())
                maps.append(parity(elements))
            yield pa.record_batch([b.column(0), pa.array(size, pa.int32()), pa.array(shown, pa.binary()), pa.array(maps, pa.binary())], ["rid", "size", "shown", "map"])
        give_back()

    return sets.select("rid", "text").mapInArrow(run, "rid long, size int, shown binary, map binary")


def _common(texts: DataFrame, hashed: Callable[[bytes], np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Elements held repeatedly, ascending, and their counts: of elements below LOW in all texts, of others in a sample."""
    share = max(1, -(-texts.count() // SAMPLE))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 500):
                b = whole.slice(at, 500)
                some = [(hashed(text or b""), drawn) for text, drawn in zip(b.column(0).cast(pa.binary()).to_pylist(), b.column(1).to_pylist())]
                counted = np.concatenate([x if drawn else x[x < LOW] for x, drawn in some])
                yield pa.record_batch([pa.array(counted.view(np.int64))], ["element"])
        give_back()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [np.asarray(b.column(0)) for b in batches if b.num_rows]
        if got:
            element, n = np.unique(np.concatenate(got).view(np.uint64), return_counts=True)
            element, n = element[n >= REPEATED], n[n >= REPEATED]
            yield pa.record_batch([pa.array(element.view(np.int64)), pa.array(np.where(element < LOW, n, n * share))], ["element", "count"])
        give_back()

    drawn = F.pmod(F.xxhash64("rid", F.lit("common")), F.lit(share)) == 0
    held = texts.select("text", drawn.alias("drawn")).mapInArrow(run, "element long")
    tasks = max(int(texts.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-texts.count() // TEXTS_A_TASK))
    counted = held.repartition(tasks, "element").mapInArrow(count, "element long, count long")
    found = counted.orderBy(F.col("count").desc(), "element").limit(COMMON).toPandas()
    element, counts = found["element"].to_numpy(np.int64).view(np.uint64), found["count"].to_numpy(np.int64)
    order = np.argsort(element)
    return element[order], counts[order]


def _spread(shown: DataFrame) -> DataFrame:
    """(rid, label, size, shown) to a row (key, rid, label, size, place) an element shown."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                b = whole.slice(at, 2000)
                raw = [np.frombuffer(x, np.int64) for x in b.column(3).to_pylist()]
                n = np.fromiter(map(len, raw), np.int64, len(raw))
                if not n.sum():
                    continue
                place = np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n)
                own = [pa.array(np.repeat(np.asarray(b.column(i)), n)) for i in range(3)]
                yield pa.record_batch([pa.array(np.concatenate(raw)), *own, pa.array(place.astype(np.int32))], ["key", "rid", "label", "size", "place"])

    return shown.select("rid", "label", "size", "shown").mapInArrow(run, "key long, rid long, label long, size int, place int")


def _hot(shown: DataFrame, made: int) -> DataFrame:
    """(hot, count): all elements shown more than HOT times, and none shown HOT / 2 times or fewer; made: elements shown.
    A count is at least the true one and at most HOT / 2 above it."""
    most = max(COUNTED, 2 * made // HOT)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, count = np.zeros(0, np.int64), np.zeros(0, np.int64)
        waiting: list[np.ndarray] = []
        for whole in batches:
            for at in range(0, whole.num_rows, 2000):
                waiting += [np.frombuffer(x, np.int64) for x in whole.column(0).slice(at, 2000).to_pylist()]
                if sum(map(len, waiting)) >= CHUNK:
                    new = np.concatenate(waiting)
                    key, count = frequent(np.concatenate([key, new]), np.concatenate([count, np.ones(len(new), np.int64)]), most)
                    waiting = []
        new = np.concatenate([key, *waiting])
        key, count = frequent(new, np.concatenate([count, np.ones(len(new) - len(count), np.int64)]), most)
        yield pa.record_batch([pa.array(key), pa.array(count)], ["hot", "count"])
        give_back()

    counted = shown.select("shown").mapInArrow(run, "hot long, count long").groupBy("hot").agg(F.sum("count").alias("count"))
    return counted.where(F.col("count") > HOT / 2).withColumn("count", F.col("count") + HOT // 2)


def candidates(shown: DataFrame, least: float) -> DataFrame:
    """Pairs (a, b), a < b, of texts (rid, label, size, shown) of two labels that share an element shown and whose sizes and
    the element's places leave the similarity possible."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [b for b in batches if b.num_rows]
        if not got:
            return
        key, rid, label, size, place, side = (np.concatenate([np.asarray(b.column(i)) for b in got]) for i in range(6))
        order = np.lexsort((label, key))
        key, rid, label, size, place, side = (x[order] for x in (key, rid, label, size, place, side))
        for x, y in bucket_pairs(key, label, size, place, least):
            good = (side[x] == 0) | (side[x] != side[y])
            x, y = rid[x[good]], rid[y[good]]
            if len(x):
                a, b = np.unique(np.stack([np.minimum(x, y), np.maximum(x, y)], 1), axis=0).T
                yield pa.record_batch([pa.array(np.ascontiguousarray(a)), pa.array(np.ascontiguousarray(b))], ["a", "b"])
        give_back()

    spark = shown.sparkSession
    keyed = _spread(shown)
    made = (shown.agg(F.sum(F.octet_length("shown").cast("long"))).first()[0] or 0) // 8
    hot = durable(_hot(shown, made).withColumn("blocks", F.ceil(F.col("count") / HOT).cast("int")).where("blocks > 1"))
    made += hot.agg(F.sum(F.col("count") * (F.col("blocks") - 1))).first()[0] or 0
    tasks = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-made // ROWS_A_TASK))
    if hot.isEmpty():
        dealt = keyed.withColumn("side", F.lit(0))
    else:
        # a row of a hot key meets its own block and every other, in a bucket for each pair of blocks; side 0 meets all
        joined = keyed.join(lookup(hot.drop("count")), F.col("key") == F.col("hot"), "left")
        own = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("blocks")).cast("int")
        every = F.when(F.col("blocks").isNull(), F.array(F.lit(0))).otherwise(F.sequence(F.lit(0), F.col("blocks") - 1))
        placed = joined.withColumn("own", own).withColumn("other", F.explode(every))
        bucket = F.when(F.col("blocks").isNull(), F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
        side = F.when(F.col("blocks").isNull() | (F.col("own") == F.col("other")), 0).when(F.col("own") < F.col("other"), 1).otherwise(2)
        dealt = placed.select(bucket.alias("key"), "rid", "label", "size", "place", side.cast("int").alias("side"))
    return dealt.repartition(tasks, "key").mapInArrow(compare, "a long, b long").distinct()


def _kept(pairs: DataFrame, facts: DataFrame, test: Callable[[bytes, bytes], bool]) -> DataFrame:
    """The pairs (a, b) whose facts (rid, fact) pass the test."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            good = [test(x, y) for x, y in zip(b.column(2).to_pylist(), b.column(3).to_pylist())]
            yield b.select([0, 1]).filter(pa.array(good, pa.bool_()))
        give_back()

    left, right = facts.select(F.col("rid").alias("a"), F.col("fact").alias("x")), facts.select(F.col("rid").alias("b"), F.col("fact").alias("y"))
    return pairs.join(left, "a").join(right, "b").select("a", "b", "x", "y").mapInArrow(run, "a long, b long")


def near_links(texts: DataFrame, labels: DataFrame, hashed: Callable[[bytes], np.ndarray], near: Callable[[np.ndarray, np.ndarray], bool], least: float) -> DataFrame:
    """Links (a, b) between all texts (rid, text) of two labels (rid, label) that are near: whose sets are at `least` or more.

    hashed gives a text's set, ascending; near decides on two sets. Texts without a label take no part.
    """
    spark = texts.sparkSession
    ship(spark)
    common, counts = _common(texts, hashed)
    drop_shuffles(spark)
    shown = durable(_prefixes(texts, hashed, common, counts, least).join(labels, "rid"))
    drop_shuffles(spark)
    formed = durable(candidates(shown, least))
    drop_shuffles(spark)

    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            sets = [hashed(t or b"").tobytes() for t in b.column(1).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([b.column(0), pa.array(sets, pa.binary())], ["rid", "fact"])
        give_back()

    sketches = shown.select("rid", F.concat(F.unhex(F.lpad(F.hex(F.col("size").cast("long")), 16, "0")), "map").alias("fact"))
    pairs = durable(_kept(formed, sketches, lambda x, y: possible(x, y, least)))
    remove_scratch(shown)
    remove_scratch(formed)
    asked = durable(pairs.select(F.col("a").alias("asked")).unionByName(pairs.select(F.col("b").alias("asked"))).distinct())
    drop_shuffles(spark)
    sets = durable(texts.join(lookup(asked), F.col("rid") == F.col("asked")).select("rid", "text").mapInArrow(whole, "rid long, fact binary"))
    found = durable(_kept(pairs, sets, lambda x, y: near(np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64))))
    remove_scratch(sets)
    drop_shuffles(spark)
    return found
