"""Mixing sources to target weights by Pareto order sampling (Rosén 1997), in DataFrame functions only.

A source's share of the words is a water-filling over its weight and a cap of `cap` times its size. Within a source a
document is expected lambda = min(cap, c * floor(sqrt(size))) times, c such that the expected words are the target: longer
documents are likelier, in proportion to the root of their size, and none comes more than `cap` times. The whole part
of lambda is certain copies, the fraction p is the inclusion probability of one more copy. Documents are ranked by
Q = (u / (1 - u)) / (p / (1 - p)) and taken in that order as long as the words left to take allow; the last place goes to
the document whose size fits the remainder best. So the sample has a fixed size in words, up to that last fit.

No group is gathered: c comes from sums per distinct root (a row a root and source); the cut in the Q order is found on a
histogram of Q (about BUCKET_DOCS documents a bucket); of the bucket that holds the cut, documents of equal rank, id and
size are one row; and if the cut falls among equal ones, they are numbered within slices of their hash.

Nulls: a null text has size 0, a null source is a source of its own that comes last, a null id is hashed as ''. Repeated
rows are documents of their own. An empty table gives an empty result; if no document has a word, all targets are 0.
Columns besides the three named are ignored, or kept by `mixed_documents`.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, lookup, word_count

#: Documents that share a bucket of the Q histogram, on average, and equal ones a slice.
BUCKET_DOCS = 2000
#: What is too little to be a probability.
LEAST = 1e-12


def uniform(key: Column, seed: str) -> Column:
    """A number in (0, 1) from the first 52 bits of an MD5."""
    text = F.concat(F.lit(seed), F.coalesce(key.cast("string"), F.lit("")))
    return (F.conv(F.substring(F.md5(text), 1, 13), 16, 10).cast("double") + 0.5) / F.lit(float(2**52))


def source_targets(sizes: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """(source, source_size) to (source, source_size, target).

    One row a source: the windows below run over the sources, never over documents.
    """
    order = W.orderBy(F.col("source").asc_nulls_last())
    cyc = F.array(*[F.lit(int(w)) for w in weights])
    s = sizes.withColumn("w", F.element_at(cyc, ((F.row_number().over(order) - 1) % len(weights) + 1).cast("int")).cast("long"))
    s = s.withColumn("ratio", F.col("source_size") * cap / F.col("w"))
    by = W.orderBy("ratio", F.col("source").asc_nulls_last())
    before = by.rowsBetween(W.unboundedPreceding, -1)
    after = by.rowsBetween(0, W.unboundedFollowing)
    everything = W.orderBy(F.lit(1)).rowsBetween(W.unboundedPreceding, W.unboundedFollowing)
    s = s.withColumn("level", (F.sum("source_size").over(everything) - cap * F.coalesce(F.sum("source_size").over(before), F.lit(0))) / F.sum("w").over(after))
    s = s.withColumn("water", -F.min(F.when(F.col("level") <= F.col("ratio"), F.struct("ratio", (-F.col("level")).alias("level")))).over(everything)["level"])
    target = F.when(F.col("ratio") < F.coalesce("water", F.lit(0.0)), (F.col("source_size") * cap).cast("double")).otherwise(F.coalesce("water", F.lit(0.0)) * F.col("w"))
    return s.select("source", "source_size", target.alias("target"))


def expected(cap: int) -> Column:
    """How often a document of a source's `root` is expected, by the source's c (null: cap times)."""
    return F.when(F.col("root") == 0, F.lit(0.0)).otherwise(F.least(F.lit(float(cap)), F.coalesce(F.col("c") * F.col("root"), F.lit(float(cap)))))


def _whole() -> Column:
    return F.floor(F.col("times") + LEAST).cast("long")


def source_rates(roots: DataFrame, targets: DataFrame, cap: int) -> DataFrame:
    """roots (source, root, words), targets to (source, source_size, target, c, rest): rest is left after certain copies."""
    t = lookup(targets).select(F.col("source").alias("of"), "source_size", "target")
    of_source = roots.join(t, F.col("source").eqNullSafe(F.col("of")))
    down = W.partitionBy("source").orderBy(F.col("root").desc())
    up = W.partitionBy("source").orderBy("root")
    capped = F.coalesce(F.sum("words").over(down.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    level = (F.col("target") - cap * capped) / F.sum(F.col("root") * F.col("words")).over(up)
    found = of_source.withColumn("level", F.when(F.col("root") > 0, level))
    c = F.max_by("level", F.when(F.col("level") * F.col("root") <= cap + 1e-9, F.col("root"))).over(W.partitionBy("source"))
    found = found.withColumn("c", c).withColumn("times", expected(cap))
    return found.groupBy("source").agg(F.first("source_size").alias("source_size"), F.first("target").alias("target"), F.first("c").alias("c"), F.greatest(F.lit(0.0), F.first("target") - F.sum(_whole() * F.col("words"))).alias("rest"))


def numbered(docs: DataFrame, seed: str, keep: dict[str, Column]) -> DataFrame:
    """Rows of docs by number, with what the mix reads of them; written once, as numbers must not change between jobs."""
    size = word_count(F.col("text"))
    return durable(
        docs.select(
            F.monotonically_increasing_id().alias("rid"), F.col("doc_id"), F.col("source").cast("string").alias("source"), size.alias("size"), F.floor(F.sqrt(size)).alias("root"), uniform(F.col("doc_id"), seed).alias("u"), *[c.alias(k) for k, c in keep.items()]
        )
    )


def copies(rows: DataFrame, weights: Sequence[int], cap: int) -> DataFrame:
    """numbered() rows with all their columns, source_size, target and copies."""
    own = [c for c in rows.columns]
    narrow = rows.select("rid", "doc_id", "source", "size", "root", "u")
    roots = durable(narrow.groupBy("source", "root").agg(F.sum("size").alias("words"), F.count(F.lit(1)).alias("docs")))
    sizes = durable(roots.groupBy("source").agg(F.sum("words").alias("source_size"), F.sum("docs").alias("docs")))
    facts = sizes.agg(F.count(F.lit(1)), F.coalesce(F.sum("docs"), F.lit(0))).first()
    buckets = max(256, -(-facts[1] // BUCKET_DOCS))
    rates = durable(source_rates(roots.drop("docs"), durable(source_targets(sizes.drop("docs"), weights, cap)), cap))

    def ranked(of: DataFrame) -> DataFrame:
        joined = of.join(lookup(rates, facts[0]).withColumnRenamed("source", "of"), F.col("source").eqNullSafe(F.col("of"))).drop("of").withColumn("times", expected(cap)).withColumn("whole", _whole())
        p = F.col("times") - F.col("whole")
        q = F.when((p > LEAST) & (F.col("rest") > 0), (F.col("u") / (1 - F.col("u"))) / (p / (1 - p)))
        return joined.withColumn("q", q).withColumn("bucket", F.floor(F.col("q") / (1 + F.col("q")) * F.lit(float(buckets))))

    # The bucket in which a source's running words first pass what is left to take.
    histogram = ranked(narrow).where(F.col("q").isNotNull()).groupBy("source", "rest", "bucket").agg(F.sum("size").alias("words"))
    running = F.sum("words").over(W.partitionBy("source").orderBy("bucket"))
    cut = histogram.withColumn("upto", running).groupBy("source").agg(
        F.coalesce(F.min(F.when(F.col("upto") > F.col("rest"), F.col("bucket"))), F.lit(2**62)).alias("cut"),
        F.coalesce(F.max(F.when(F.col("upto") <= F.col("rest"), F.col("upto"))), F.lit(0)).alias("below"),
    )
    cut = lookup(durable(cut), facts[0]).withColumnRenamed("source", "of_cut")

    def placed(of: DataFrame) -> DataFrame:
        return ranked(of).join(cut, F.col("source").eqNullSafe(F.col("of_cut")), "left").drop("of_cut")

    edge = durable(placed(narrow).where(F.col("bucket") == F.col("cut")).select("rid", "source", "rest", "below", "q", "doc_id", "size"))
    equal = edge.groupBy("source", "q", "doc_id", "size").agg(F.count(F.lit(1)).alias("n"), F.first("rest").alias("rest"), F.first("below").alias("below"))
    upto = F.col("below") + F.sum(F.col("n") * F.col("size")).over(W.partitionBy("source").orderBy("q", "doc_id", "size"))
    equal = equal.withColumn("upto", upto)
    # Of the first equal documents that pass what is left, as many as fit; none of those after them.
    first = F.min(F.when(F.col("upto") > F.col("rest"), F.col("upto"))).over(W.partitionBy("source"))
    fit = F.when(F.col("upto") <= F.col("rest"), F.col("n")).when(F.col("upto") == first, F.floor((F.col("rest") - F.col("upto") + F.col("n") * F.col("size")) / F.col("size"))).otherwise(0)
    equal = durable(equal.withColumn("fit", fit.cast("long")).withColumn("slices", F.ceil(F.col("n") / BUCKET_DOCS)))
    some = lookup(durable(equal.where("fit > 0").select(F.col("source").alias("s"), F.col("q").alias("q0"), F.col("doc_id").alias("d"), F.col("size").alias("z"), "n", "fit", "slices")))
    same = F.col("source").eqNullSafe(F.col("s")) & (F.col("q") == F.col("q0")) & F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("size") == F.col("z"))
    among = edge.join(some, same).select("rid", "s", "q0", "d", "z", "n", "fit", F.pmod(F.xxhash64("rid"), F.col("slices")).alias("slice"))
    parts = among.where("fit < n").groupBy("s", "q0", "d", "z", "slice").agg(F.count(F.lit(1)).alias("here"))
    parts = parts.withColumn("ahead", F.sum("here").over(W.partitionBy("s", "q0", "d", "z").orderBy("slice")) - F.col("here")).select(*[F.col(x).alias(f"{x}_") for x in ("s", "q0", "d", "z", "slice")], "ahead")
    rank = F.row_number().over(W.partitionBy("s", "q0", "d", "z", "slice").orderBy(F.xxhash64("rid"), "rid"))
    cutting = among.where("fit < n").withColumn("rank", rank)
    at = [F.col(x).eqNullSafe(F.col(f"{x}_")) for x in ("s", "q0", "d", "z", "slice")]
    cutting = cutting.join(lookup(durable(parts)), at).where(F.col("ahead") + F.col("rank") <= F.col("fit")).select("rid")
    fits = durable(among.where("fit = n").select("rid").unionByName(cutting).select(F.col("rid").alias("fits")))
    # What the order leaves untaken, and the document that fits it best.
    gap = durable(equal.groupBy("source").agg((F.first("rest") - F.first("below") - F.sum(F.col("fit") * F.col("size"))).alias("gap")))
    gap = lookup(gap, facts[0]).withColumnRenamed("source", "of_gap")
    fitting = lookup(fits)

    def taken(of: DataFrame) -> DataFrame:
        return placed(of).join(fitting, F.col("rid") == F.col("fits"), "left").withColumn("taken_once", F.coalesce(F.col("bucket") < F.col("cut"), F.lit(False)) | F.col("fits").isNotNull()).drop("fits")

    left = taken(narrow).where(~F.col("taken_once") & F.col("q").isNotNull()).join(gap, F.col("source").eqNullSafe(F.col("of_gap")))
    off = F.abs(F.col("size") - F.col("gap"))
    last = left.where(off < F.col("gap")).groupBy("source").agg(F.min(F.struct(off.alias("off"), "q", "doc_id", "size", "rid"))["rid"].alias("last")).select("last")
    last = lookup(durable(last), facts[0])
    out = taken(rows).join(last, F.col("rid") == F.col("last"), "left")
    return out.select(*own, "source_size", "target", (F.col("whole") + F.when(F.col("taken_once") | F.col("last").isNotNull(), 1).otherwise(0)).cast("long").alias("copies"))


def mix(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix:") -> DataFrame:
    """docs (doc_id, text, source) to one row a document: doc_id, source, size, source_size, target, copies, taken."""
    out = copies(numbered(docs, seed, {}), weights, cap)
    return out.select("doc_id", "source", "size", "source_size", "target", "copies", (F.col("size") * F.col("copies")).alias("taken"))


def mixed_documents(docs: DataFrame, *, weights: Sequence[int] = (5, 2, 1), cap: int = 3, seed: str = "mix:") -> DataFrame:
    """The rows of docs, with all their columns, each as often as the mix takes it. Texts are written once, not shuffled."""
    rows = numbered(docs, seed, {"row": F.struct(*[docs[c] for c in docs.columns])})
    out = copies(rows, weights, cap).where("copies > 0")
    return out.select("row", F.explode(F.sequence(F.lit(1), F.col("copies").cast("int"))).alias("copy")).select("row.*")
