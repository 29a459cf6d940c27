"""Windowed counts of events and findings of arriving texts, in batch or on streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import info
from ..functions import text as T
from ..operators import lexer, patterns


def tumbling(events: DataFrame, width: str = "1 hour", late: str | None = None) -> DataFrame:
    """events (ts, event_type) to window_start, event_type, events; late: the watermark of a stream."""
    if late:
        events = events.withWatermark("ts", late)
    counts = events.groupBy(F.window("ts", width).alias("w"), "event_type").agg(F.count(F.lit(1)).alias("events"))
    return counts.select(F.col("w.start").alias("window_start"), "event_type", "events")


def stream_matches(units: DataFrame) -> DataFrame:
    """Redacted pattern matches and entropy candidates, row by row: no state, so it runs on any stream."""
    text = units.select("unit_id", T.normalize_newlines(F.coalesce("text", F.lit(""))).alias("text"))
    out = [F.col("unit_id"), F.col("line"), F.col("column"), F.length("value").alias("value_length"), info.mask(F.col("value")).alias("masked_value"), info.fingerprint(F.col("value")).alias("value_fingerprint")]
    found = patterns.matches(text).select("rule_id", "confidence", "severity", *out)
    screen = lexer.entropy_candidates(text).select(F.lit(X.ENTROPY_RULE).alias("rule_id"), F.lit(2).alias("confidence"), F.lit(2).alias("severity"), *out)
    return found.unionByName(screen)


def once_within(matches: DataFrame, at: str, late: str) -> DataFrame:
    """Each (rule, fingerprint) once within the watermark."""
    return matches.withWatermark(at, late).dropDuplicatesWithinWatermark(["rule_id", "value_fingerprint"])
