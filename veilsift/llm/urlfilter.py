"""URL rules behind a blocked Bloom filter, in DataFrame functions only.

A rule is a canonical URL prefix: a host (lower case A-Z) that stands for itself and its subdomains, and a path prefix.
A URL's possible rules are its host's suffixes times its path's prefixes. Those keys first probe a split-block Bloom
filter of the listed keys (eight 64-bit words a block, one bit in each); what passes goes to an exact hash join with the
rules, which removes false positives. Of the rules that fit, the longest key wins (then the longer host).

The path prefixes tried are of the lengths that rule paths have, so the keys a URL makes are bounded by its host's
labels times the distinct rule path lengths. Filter and rules are broadcast if counted small; else both are shuffled.

Null URLs and those without '://' have an empty host and path; a URL that no rule fits gets `default`. Repeated rows
stay. Empty tables give an empty result. Without rules all is `default`. Rules that state a key twice: block wins.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import durable, lookup

#: Keys a filter block holds on average: 512 bits / 24 keys is about 21 bits a key.
KEYS_PER_BLOCK = 24
WORDS = 8


def _after_scheme(url: Column) -> Column:
    at = F.instr(url, "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise(F.lit(""))


def host_of(url: Column) -> Column:
    """From the first '://' to '/', '?', '#' or the end, A-Z lower-cased; '' if there is none."""
    host = F.regexp_extract(_after_scheme(url), r"^[^/?#]*", 0)
    return F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def path_of(url: Column) -> Column:
    """What follows the host up to '?', '#' or the end; '' if there is no '://'."""
    return F.regexp_extract(_after_scheme(url), r"^[^/?#]*([^?#]*)", 1)


def _block(key: Column, blocks: int) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(blocks)).cast("int")


def _bits(key: Column) -> list[Column]:
    second = F.xxhash64(key, F.lit("veilsift"))
    return [F.shiftright(second, 6 * i).bitwiseAND(F.lit(63)).cast("int") for i in range(WORDS)]


def bloom(keys: DataFrame, blocks: int) -> DataFrame:
    """keys (key) to the filter: block, w0..w7."""
    one = F.lit(1).cast("long")
    bits = [F.call_function("shiftleft", one, b) for b in _bits(F.col("key"))]
    rows = keys.select(_block(F.col("key"), blocks).alias("block"), *[b.alias(f"b{i}") for i, b in enumerate(bits)])
    return rows.groupBy("block").agg(*[F.bit_or(f"b{i}").alias(f"w{i}") for i in range(WORDS)])


def maybe_listed(frame: DataFrame, filter_rows: DataFrame, blocks: int, rows: int) -> DataFrame:
    """The rows of frame (with a column key) that the filter can't exclude."""
    probe = frame.withColumn("block", _block(F.col("key"), blocks))
    hit = F.lit(True)
    for i, b in enumerate(_bits(F.col("key"))):
        hit = hit & (F.call_function("shiftright", F.col(f"w{i}"), b).bitwiseAND(F.lit(1)) == 1)
    return probe.join(lookup(filter_rows, rows), "block").where(hit).drop("block", *[f"w{i}" for i in range(WORDS)])


def judge(pages: DataFrame, rules: DataFrame, *, default: str = "allow") -> DataFrame:
    """pages (page_id, url), rules (host, path, verdict) to page_id, url, host, path, rule, verdict."""
    urls = durable(pages.select(F.monotonically_increasing_id().alias("rid"), "page_id", "url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path")))
    listed = durable(
        rules.where(F.col("host").isNotNull() & F.col("verdict").isNotNull())
        .select(F.col("host"), F.coalesce("path", F.lit("")).alias("rule_path"), "verdict")
        .groupBy(F.concat("host", "rule_path").alias("key"), "host", "rule_path")
        .agg(F.max(F.when(F.col("verdict") == "block", F.lit("block")).otherwise(F.col("verdict"))).alias("any"), F.max((F.col("verdict") == "block").cast("int")).alias("blocked"))
        .select("key", F.length("host").alias("host_chars"), F.length("rule_path").alias("path_chars"), F.when(F.col("blocked") == 1, F.lit("block")).otherwise(F.col("any")).alias("verdict"))
    )
    n = listed.count()
    blocks = max(1, -(-n // KEYS_PER_BLOCK))
    lengths = sorted(r[0] for r in listed.select("path_chars").distinct().collect())  # one number for each length of path
    labels = F.split("host", r"\.")
    suffixes = F.transform(F.sequence(F.lit(1), F.size(labels)), lambda i: F.array_join(F.slice(labels, i, F.size(labels)), "."))
    fitting = F.filter(F.array(*[F.lit(x) for x in lengths]).cast("array<int>"), lambda k: k <= F.length("path"))
    prefixes = F.transform(fitting, lambda k: F.substr(F.col("path"), F.lit(1), k))
    keys = F.flatten(F.transform(suffixes, lambda h: F.transform(prefixes, lambda p: F.concat(h, p))))
    candidates = urls.where(F.col("host") != "").select("rid", F.explode(F.array_distinct(keys)).alias("key"))
    filter_rows = durable(bloom(listed, blocks))
    hits = maybe_listed(candidates, filter_rows, blocks, blocks)
    exact = hits.join(lookup(listed, n), "key")
    best = exact.groupBy("rid").agg(F.max(F.struct(F.length("key").alias("chars"), "host_chars", "key", "verdict")).alias("best"))
    out = urls.join(best, "rid", "left")
    return out.select("page_id", "url", "host", "path", F.col("best.key").alias("rule"), F.coalesce("best.verdict", F.lit(default)).alias("verdict"))
