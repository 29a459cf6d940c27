"""Redacted findings, their order, and what is counted of them."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import info
from ..functions import text as T
from ..rules import RULES, Rule

KEY = ["rule_id", "path", "line", "column", "commit", "value_fingerprint"]


def label(value: Column, labels: dict[str, int]) -> Column:
    out = None
    for name, rank in labels.items():
        out = F.when(value == rank, name) if out is None else out.when(value == rank, name)
    return out


def from_label(text: Column, labels: dict[str, int]) -> Column:
    """A label's rank; case and '-' for '_' don't matter."""
    low = F.translate(F.lower(F.trim(text)), "-", "_")
    out = None
    for name, rank in labels.items():
        out = F.when(low == name, rank) if out is None else out.when(low == name, rank)
    return out


def redact(merged: DataFrame, rules: Iterable[Rule] = RULES, *, key: bytes | None = None) -> DataFrame:
    """Merged rows with path, commit and commit_time to findings; the value goes in this projection."""
    category, advice = F.lit("unknown"), F.lit("Find out what the value opens, and rotate it.")
    masked = info.mask(F.col("value"))
    for r in rules:
        if r.keep_prefix or r.keep_suffix:
            masked = F.when(F.col("rule_id") == r.rule_id, info.mask(F.col("value"), r.keep_prefix, r.keep_suffix)).otherwise(masked)
        category = F.when(F.col("rule_id") == r.rule_id, r.category).otherwise(category)
        advice = F.when(F.col("rule_id") == r.rule_id, r.advice).otherwise(advice)
    return merged.select(
        "rule_id", category.alias("category"), "severity", "confidence", "detector", T.strip_controls(F.col("path")).alias("path"), "line", "column", "commit", "commit_time", masked.alias("masked_value"), F.length("value").alias("value_length"),
        info.fingerprint(F.col("value"), key).alias("value_fingerprint"), "entropy", F.array_sort("keywords").alias("matched_keywords"), advice.alias("remediation"), "start", "end",
    )


def dedupe(findings: DataFrame) -> DataFrame:
    """The first finding of each key, by span, rule and every field that could differ; spans are dropped."""
    w = W.partitionBy(*KEY).orderBy("start", "end", "rule_id", "detector", "confidence", "severity", "value_length")
    # as row_number() = 1, for which Spark would sort all rows once more before the shuffle; hardly any go there
    return findings.withColumn("_before", F.lag(F.lit(1)).over(w)).where("_before IS NULL").drop("_before", "start", "end")


def order_columns() -> list[Column]:
    """The canonical order of findings."""
    return [F.col("path"), F.coalesce("line", F.lit(0)), F.coalesce("column", F.lit(0)), F.col("rule_id"), F.col("value_fingerprint")]


def count_by(findings: DataFrame, column: str, labels: dict[str, int]) -> DataFrame:
    """(label, rank, findings) for every label, the greatest first; absent ones count 0."""
    spark = findings.sparkSession
    dim = spark.createDataFrame([(k, v) for k, v in labels.items()], f"{column}_label string, {column} int")
    counts = findings.groupBy(column).agg(F.count(F.lit(1)).alias("findings"))
    return F.broadcast(dim).join(counts, column, "left").select(f"{column}_label", column, F.coalesce("findings", F.lit(0)).cast("long").alias("findings")).orderBy(F.desc(column))


def count_by_category(findings: DataFrame) -> DataFrame:
    return findings.groupBy("category").agg(F.count(F.lit(1)).alias("findings")).orderBy("category")


def summary(findings: DataFrame) -> DataFrame:
    """One row: findings, distinct secrets, greatest severity, counts by severity and confidence."""
    counts = [F.count_if(F.col("severity") == rank).alias(f"severity_{name}") for name, rank in X.SEVERITIES.items()]
    counts += [F.count_if(F.col("confidence") == rank).alias(f"confidence_{name}") for name, rank in X.CONFIDENCES.items()]
    secrets = F.count_distinct("rule_id", "value_fingerprint").alias("distinct_secrets")
    return findings.agg(F.count(F.lit(1)).alias("findings"), secrets, F.max("severity").alias("highest_severity"), *counts)


def summary_block(findings: DataFrame, errors: DataFrame, totals: DataFrame) -> DataFrame:
    """One row, what a report sums up: total_findings, distinct_secrets, by_severity, by_confidence, by_category (maps of label
    to count), highest_severity, files_scanned, bytes_scanned, error_count. totals: one row (files_scanned, bytes_scanned)."""
    by = lambda column, labels: F.map_from_arrays(F.array(*map(F.lit, labels)), F.array(*(F.count_if(F.col(column) == rank) for rank in labels.values())))
    first = findings.agg(
        F.count(F.lit(1)).alias("total_findings"), F.count_distinct("rule_id", "value_fingerprint").alias("distinct_secrets"), by("severity", X.SEVERITIES).alias("by_severity"),
        by("confidence", X.CONFIDENCES).alias("by_confidence"), label(F.max("severity"), X.SEVERITIES).alias("highest_severity"),
    )
    categories = count_by_category(findings).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("category", "findings")))).alias("by_category"))
    bad = errors.agg(F.count(F.lit(1)).alias("error_count"))
    return first.join(categories).join(totals).join(bad)  # one row each


def error_codes(errors: DataFrame) -> DataFrame:
    """One row: the distinct codes of errors in order, 'unknown' for none given."""
    return errors.agg(F.array_sort(F.collect_set(F.coalesce("code", F.lit("unknown")))).alias("codes"))


def exit_code(findings: DataFrame, errors: DataFrame, fail_on: int | None) -> DataFrame:
    """One row: 3 if there are errors, else 1 if a finding reaches fail_on, else 0."""
    worst = findings.agg(F.max("severity").alias("worst"))
    any_error = errors.agg(F.count(F.lit(1)).alias("errors"))
    threshold = F.lit(fail_on).cast("int")
    code = F.when(F.col("errors") > 0, 3).when(F.col("worst") >= threshold, 1).otherwise(0)
    return worst.join(any_error).select(code.alias("exit_code"))
