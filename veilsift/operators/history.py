"""Version history: each distinct blob is scanned once, its findings go to every path that held it."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed as X


def blob_paths(refs: DataFrame) -> DataFrame:
    """refs (walk_seq, commit, commit_time, path, object_name) to each blob's paths with their newest commit.

    Newest is first in the walk, whatever the times say.
    """
    newest = F.min_by(F.struct("commit", "commit_time"), "walk_seq")
    return refs.groupBy("object_name", "path").agg(newest.alias("n"), F.min("walk_seq").alias("walk_seq"), F.count(F.lit(1)).alias("occurrences")).select("object_name", "path", "n.commit", "n.commit_time", "walk_seq", "occurrences")


def occurrences(refs: DataFrame) -> DataFrame:
    return refs.groupBy("object_name").agg(F.count(F.lit(1)).alias("occurrences"))


def first_commits(refs: DataFrame, most: int) -> tuple[DataFrame, DataFrame]:
    """The refs of the first commits of the walk, and one row: truncated."""
    order = refs.groupBy("commit").agg(F.min("walk_seq").alias("first"))
    kept = order.orderBy("first").limit(most + 1)  # one more tells whether there are more
    last = kept.agg(F.count(F.lit(1)).alias("seen"), F.max("first").alias("edge"))
    cut = F.broadcast(last.select((F.col("seen") > most).alias("truncated"), F.when(F.col("seen") > most, F.col("edge")).alias("edge")))
    inside = refs.join(order.join(cut, F.col("edge").isNull() | (F.col("first") < F.col("edge"))).select("commit"), "commit", "left_semi")
    return inside, cut.select("truncated")


def first_blobs(refs: DataFrame, most: int = X.MAX_BLOBS) -> DataFrame:
    """Refs to the first `most` distinct blobs of the walk."""
    first = refs.groupBy("object_name").agg(F.min("walk_seq").alias("first")).orderBy("first", "object_name").limit(most)
    return refs.join(first, "object_name", "left_semi")


def blob_status(refs: DataFrame, objects: DataFrame, max_bytes: int = X.MAX_FILE_BYTES, carry: tuple[str, ...] = ()) -> DataFrame:
    """objects (object_name, kind, size, and carried columns) joined to the distinct blobs of refs: missing, not-a-blob,
    too-large or readable."""
    names = refs.select("object_name").distinct()
    status = F.when(F.col("kind").isNull(), "missing").when(F.col("kind") != "blob", "not-a-blob").when(F.col("size") > max_bytes, "too-large").otherwise("readable")
    return names.join(objects, "object_name", "left").select("object_name", "kind", "size", status.alias("status"), *carry)


def counters(status: DataFrame, refs: DataFrame, filtered: DataFrame) -> DataFrame:
    """One row of what a history scan saw: status (status), refs walked (commit), refs that path filters left out (path)."""
    one = lambda *values: F.count_if(F.col("status").isin(*values))
    blobs = status.agg(
        F.count(F.lit(1)).alias("blobs_seen"), one("scanned").alias("blobs_scanned"), one("binary", "invalid-encoding").alias("blobs_binary"),
        one("too-large").alias("blobs_too_large"), one("missing").alias("blobs_unreadable"),
    )
    return blobs.join(refs.agg(F.count_distinct("commit").alias("commits"))).join(filtered.agg(F.count_distinct("path").alias("paths_filtered")))  # one row each


def fan_out(findings: DataFrame, paths: DataFrame) -> DataFrame:
    """Findings of blobs (object_name) at every path of the blob, with its newest commit."""
    return findings.drop("path", "commit", "commit_time").join(paths.select("object_name", "path", "commit", "commit_time"), "object_name")


def merge_spans(spans: DataFrame, *keys: str) -> DataFrame:
    """(keys, start, end) to disjoint spans; touching ones are one."""
    by = W.partitionBy(*keys).orderBy("start", "end")
    before = F.max("end").over(by.rowsBetween(W.unboundedPreceding, -1))
    distinct = spans.where(F.col("end") > F.col("start")).select(*keys, "start", "end").distinct()  # no ties in the windows
    marked = distinct.withColumn("island", F.when(before.isNull() | (F.col("start") > before), 1).otherwise(0))
    numbered = marked.withColumn("island", F.sum("island").over(by.rowsBetween(W.unboundedPreceding, 0)))
    return numbered.groupBy(*keys, "island").agg(F.min("start").alias("start"), F.max("end").alias("end")).drop("island")
