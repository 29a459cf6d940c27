"""One document of each group of near copies stays: SimHash candidates, verified on five-word shingles, then all other pairs.

Texts with the same words are merged first. Of the rest, wide fingerprints of words are compared (each word weighted by
the root of its count times its length up to 8, so that frequent short words don't dominate): five-word shingles would
be too far apart, texts at Jaccard 0.8 differ in a sixth of such bits there, but in about a fourteenth by words. The
search is the generalised pigeonhole of `simhash.wide_links`: PARTS partitions of log2(texts) + SPARE bits, correlated bits
together, of which dynamic programming probes the RADIUS + 1 of fewest expected candidates. So a text makes RADIUS + 1
rows and about constantly many chance candidates whatever the table's size; candidates with at most DISTANT of 128 bits
apart make a candidate group. Every group is then verified: two texts are near copies if the Jaccard similarity of their
sets of five-word shingles is at least SIMILARITY.

Fingerprints miss some near copies: those of long partitions, and texts whose repeated words outweigh what they share. So
`setjoin.near_links` then finds, exactly, every near pair of texts that the links so far leave apart.

Candidate groups are settled exactly. A group of one block (BLOCK texts, BLOCK_BYTES of shingles) is compared in full in
one task. In a larger one about LEADERS texts drawn by hash go to all of its blocks, which links most of a dense group;
then every pair that these links leave apart is compared: a task holds two blocks, and pairs inside the group's largest
linked part are not dealt out. So a group of near copies costs about its size, and one whose texts stay apart the
square of its size, in tasks of bounded size. Pairs are first held against a bound of what they share, counted in BINS.
Linked texts are one group; the document with the least doc_id stays.

Rows are numbered once, in the job that writes them with their marks; all later steps read those numbers.

Nulls: null texts are empty texts, and copies of each other; null ids come last. Repeated rows are copies: one stays. An
empty table gives an empty result. doc_id is of an integer type. All columns of docs are kept.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import drop_shuffles, durable, give_back, integer_ids, lookup, remove_scratch, ship
from .components import components
from .setjoin import near_links
from .simhash import shingles, wide_links, word_fingerprints

WORDS, SIMILARITY, LEADERS = 5, 0.8, 64
#: Partitions of a fingerprint, the differing bits within which every pair is a candidate, bits of a partition beyond
#: log2 of the number of texts, and differing bits of 128 up to which candidates are kept.
PARTS, RADIUS, SPARE, DISTANT = 24, 19, 3, 20
#: Texts, and bytes of shingles, of a block of a large candidate group.
BLOCK, BLOCK_BYTES = 1024, 32_000_000
#: Bytes of text whose fingerprints are taken at once.
BLOCK_TEXT = 1_000_000
#: Bins of hashed shingles: what two texts share in them is never less than what they share.
BINS, ROWS = 4096, 256


def part_bits(texts: int) -> int:
    """Bits of a partition: chance candidates of a text stay about as many whatever the table's size."""
    return min(40, max(12, max(1, texts - 1).bit_length() + SPARE))


def shingle_hashes(text: bytes) -> np.ndarray:
    grams = shingles(text, WORDS)
    return np.unique(np.fromiter(map(xxhash.xxh64_intdigest, grams), np.uint64, len(grams)))


def near(a: np.ndarray, b: np.ndarray) -> bool:
    if not len(a) or not len(b):
        return len(a) == len(b)
    if min(len(a), len(b)) < SIMILARITY * max(len(a), len(b)):
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def _binned(sets: list[np.ndarray]) -> np.ndarray:
    out = np.zeros((len(sets), BINS), np.float32)
    for row, s in zip(out, sets):
        row += np.bincount((s % np.uint64(BINS)).astype(np.int64), minlength=BINS)
    return out


def near_pairs(a: list[np.ndarray], b: list[np.ndarray], binned: np.ndarray | None = None) -> Iterator[tuple[int, int]]:
    """Places (i, j) of near sets of a and b; binned: b's, if at hand."""
    other = _binned(b) if binned is None else binned
    size = np.array([len(x) for x in b], np.float32)
    for at in range(0, len(a), ROWS):
        some = a[at : at + ROWS]
        most = _binned(some) @ other.T
        own = np.array([len(x) for x in some], np.float32)[:, None]
        least = SIMILARITY / (1 + SIMILARITY) * (own + size)
        for i, j in zip(*np.nonzero(most >= least - 1e-3)):
            if near(some[i], b[j]):
                yield at + int(i), int(j)


def near_forest(a: list[np.ndarray], b: list[np.ndarray], a_labels: np.ndarray, b_labels: np.ndarray) -> Iterator[tuple[int, int]]:
    """Places (i, j) of near sets of a and b that link all labels that near pairs link; equal labels are linked already."""
    parts, flat = np.unique(np.concatenate([a_labels, b_labels]), return_inverse=True)
    root = list(range(len(parts)))

    def find(x: int) -> int:
        while root[x] != x:
            root[x] = root[root[x]]
            x = root[x]
        return x

    other = _binned(b)
    size = np.array([len(x) for x in b], np.float32)
    for at in range(0, len(a), ROWS):
        now = np.array([find(x) for x in range(len(root))], np.int64)
        mine, theirs = now[flat[at : min(len(a), at + ROWS)]], now[flat[len(a) :]]
        columns = np.nonzero(theirs != mine[0])[0] if (mine == mine[0]).all() else np.arange(len(b))
        if not len(columns):
            continue
        some = a[at : at + ROWS]
        most = _binned(some) @ other[columns].T
        own = np.array([len(x) for x in some], np.float32)[:, None]
        least = SIMILARITY / (1 + SIMILARITY) * (own + size[columns])
        for i, k in zip(*np.nonzero((most >= least - 1e-3) & (mine[:, None] != theirs[columns]))):
            j = int(columns[k])
            x, y = find(int(flat[at + i])), find(int(flat[len(a) + j]))
            if x != y and near(some[i], b[j]):
                root[max(x, y)] = min(x, y)
                yield at + int(i), j


def _marked(docs: DataFrame, bits: int) -> DataFrame:
    """(row, rid, doc_id, same, fp): all of docs' columns, the row's number, a hash of its words in order, and the
    fingerprint of its words, of so many bits."""
    ship(docs.sparkSession)
    source = docs.select(
        docs["text"].cast("string").alias("text"), F.struct(*[docs[c] for c in docs.columns]).alias("row"), F.monotonically_increasing_id().alias("rid"), docs["doc_id"].cast("long").alias("doc_id")
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            same: list[str] = []
            fp: list[bytes] = []
            while len(same) < len(texts):
                block: list[list[bytes]] = []
                size = 0
                while len(same) < len(texts) and size < BLOCK_TEXT:
                    text = texts[len(same)] or b""
                    block.append(text.lower().split())
                    same.append(xxhash.xxh128_hexdigest(b" ".join(block[-1])))
                    size += len(text)
                fp += word_fingerprints(block, bits, 8)
            yield pa.record_batch([*b.columns[1:], pa.array(same), pa.array(fp, pa.binary())], ["row", "rid", "doc_id", "same", "fp"])
        give_back()

    return source.mapInArrow(run, source.drop("text").schema.add("same", "string").add("fp", "binary"))


def _settle(unit: pa.Table) -> pa.Table:
    """Links (a, b) of one block of a candidate group: between all its texts if the group has no other block, else of all
    with the group's leaders."""
    unit = unit.sort_by("rid")
    rid, leads = unit["rid"].to_pylist(), np.array(unit["leads"].to_pylist(), bool)
    sets = [np.frombuffer(g, np.uint64) for g in unit["grams"].to_pylist()]
    own = np.arange(len(sets))
    to = own[leads] if unit["blocks"][0].as_py() > 1 else own
    found = list(near_forest(sets, [sets[k] for k in to], own, own[to]))
    return pa.table({"a": pa.array([rid[i] for i, _ in found], pa.int64()), "b": pa.array([rid[to[j]] for _, j in found], pa.int64())})


def _compare(unit: pa.Table) -> pa.Table:
    """Links (a, b) between two blocks of a candidate group, or within one."""
    order = np.argsort(unit["label"].to_numpy(), kind="stable")
    rid, label, block = (unit[c].to_numpy()[order] for c in ("rid", "label", "block"))
    grams = unit["grams"].to_pylist()
    sets = [np.frombuffer(grams[k], np.uint64) for k in order]
    low, high = unit["low"][0].as_py(), unit["high"][0].as_py()
    a, b = np.nonzero(block == low)[0], np.nonzero(block == high)[0]
    found = list(near_forest([sets[k] for k in a], [sets[k] for k in b], label[a], label[b])) if len(a) and len(b) else []
    return pa.table({"a": pa.array([int(rid[a[i]]) for i, _ in found], pa.int64()), "b": pa.array([int(rid[b[j]]) for _, j in found], pa.int64())})


def _blocks(n: Column, size: Column) -> Column:
    return F.greatest(F.lit(1), F.ceil(n / BLOCK), F.ceil(size / BLOCK_BYTES)).cast("int")


def _remaining(texts: DataFrame, known: DataFrame) -> DataFrame:
    """Links (a, b) of candidate groups (rid, group, grams) that join what the known links (a, b) leave apart."""
    roots = durable(components(known))
    labelled = durable(texts.join(lookup(roots), F.col("rid") == F.col("node"), "left").select("rid", "group", F.coalesce("root", "rid").alias("label"), "grams"))
    parts = labelled.groupBy("group", "label").agg(F.count(F.lit(1)).alias("n"), F.sum(F.octet_length("grams").cast("long")).alias("bytes"))
    groups = parts.groupBy("group").agg(F.count(F.lit(1)).alias("parts"), F.max(F.struct("n", "label", "bytes")).alias("main"), F.sum("n").alias("n"), F.sum("bytes").alias("bytes"))
    apart = durable(
        groups.where("parts > 1").select(
            F.col("group").alias("of"), F.col("main.label").alias("main"), _blocks(F.col("main.n"), F.col("main.bytes")).alias("mains"), _blocks(F.col("n") - F.col("main.n"), F.col("bytes") - F.col("main.bytes")).alias("rests")
        )
    )
    # blocks of the rest come first; a block of the largest part meets only those
    joined = labelled.join(lookup(apart), F.col("group") == F.col("of"))
    hashed = F.xxhash64("rid", F.lit("block"))
    placed = joined.withColumn("block", F.when(F.col("label") == F.col("main"), F.col("rests") + F.pmod(hashed, F.col("mains"))).otherwise(F.pmod(hashed, F.col("rests"))).cast("int"))
    meets = F.sequence(F.lit(0), F.when(F.col("label") == F.col("main"), F.col("rests")).otherwise(F.col("rests") + F.col("mains")) - 1)
    dealt = placed.select("group", "rid", "label", "block", "grams", F.explode(meets).alias("other")).withColumns({"low": F.least("block", "other"), "high": F.greatest("block", "other")})
    return dealt.drop("other").groupBy("group", "low", "high").applyInArrow(_compare, "a long, b long")


def _grams(texts: DataFrame) -> DataFrame:
    """(rid, group, text) with the text's hashed shingles in its place."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            found = [shingle_hashes(t or b"").tobytes() for t in b.column(2).cast(pa.binary()).to_pylist()]
            yield pa.record_batch([*b.columns[:2], pa.array(found, pa.binary())], ["rid", "group", "grams"])
        give_back()

    return texts.select("rid", "group", "text").mapInArrow(run, "rid long, group long, grams binary")


def verified(texts: DataFrame) -> DataFrame:
    """Links (a, b) of near texts within candidate groups of texts (rid, group, text): all that their components need."""
    whole = durable(_grams(texts))
    size = F.sum(F.octet_length("grams").cast("long"))
    facts = durable(whole.groupBy("group").agg(F.count(F.lit(1)).alias("n"), size.alias("bytes")).select(F.col("group").alias("of"), "n", _blocks(F.col("n"), F.col("bytes")).alias("blocks")).where("n > 1"))
    joined = whole.join(lookup(facts), F.col("group") == F.col("of"))
    drawn = F.pmod(F.xxhash64("rid", F.lit(0)), F.ceil(F.col("n") / LEADERS).cast("long")) == 0
    own = F.pmod(F.xxhash64("rid", F.lit("block")), F.col("blocks")).cast("int")
    # leaders go to every block
    home = F.when(F.col("leads") & (F.col("blocks") > 1), F.sequence(F.lit(0), F.col("blocks") - 1)).otherwise(F.array(own))
    dealt = joined.withColumn("leads", drawn).select("group", "rid", "grams", "leads", "blocks", F.explode(home).alias("block"))
    found = durable(dealt.groupBy("group", "block").applyInArrow(_settle, "a long, b long"))
    large = facts.where("blocks > 1").select("of")
    if not large.isEmpty():
        found = found.unionByName(durable(_remaining(whole.join(lookup(large), F.col("group") == F.col("of")).drop("of"), found)))
    remove_scratch(whole)
    return found


def removed(marked: DataFrame, bits: int) -> DataFrame:
    """(gone): the numbers of rows, marked with fingerprints of partitions of so many bits, that are copies of one that stays."""
    order = F.struct(F.col("doc_id").isNull(), F.col("doc_id"), F.col("rid"))
    firsts = durable(marked.groupBy("same").agg(F.min_by(F.struct("rid", "doc_id", "fp"), order).alias("first")).select("same", "first.*"))
    roots = durable(components(wide_links(firsts.select("rid", "fp"), PARTS, bits, RADIUS, DISTANT)))
    texts = marked.select("rid", F.col("row.text").cast("string").alias("text")).join(lookup(roots), F.col("rid") == F.col("node"))
    met = durable(components(verified(texts.select("rid", F.col("root").alias("group"), "text"))))
    drop_shuffles(marked.sparkSession)
    labels = durable(firsts.select("rid").join(lookup(met), F.col("rid") == F.col("node"), "left").select("rid", F.coalesce("root", "rid").alias("label")))
    rest = near_links(marked.select("rid", F.col("row.text").cast("string").alias("text")), labels, shingle_hashes, near, SIMILARITY)
    linked = durable(components(met.select(F.col("node").alias("a"), F.col("root").alias("b")).unionByName(rest)))
    grouped = firsts.select("rid", "doc_id").join(lookup(linked), F.col("rid") == F.col("node"))
    stays = durable(grouped.groupBy("root").agg(F.min_by("rid", order).alias("stay")))
    near_copies = grouped.join(lookup(stays), "root").where(F.col("rid") != F.col("stay")).select(F.col("rid").alias("gone"))
    copies = marked.select("same", "rid").join(firsts.select(F.col("same").alias("known"), F.col("rid").alias("first_rid")), F.col("same") == F.col("known")).where(F.col("rid") != F.col("first_rid"))
    return durable(copies.select(F.col("rid").alias("gone")).unionByName(near_copies))


def one_of_each(docs: DataFrame) -> DataFrame:
    """The rows of docs that stay, with all their columns."""
    integer_ids(docs)
    bits = part_bits(docs.count())
    marked = durable(_marked(docs, PARTS * bits))
    return marked.join(lookup(removed(marked, bits)), F.col("rid") == F.col("gone"), "left_anti").select("row.*")
