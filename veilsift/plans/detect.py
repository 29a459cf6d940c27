"""Texts to findings, DataFrame to DataFrame."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import text as T
from ..operators import findings as O
from ..operators import fusion, lexer, patterns
from ..rules import RULES, Rule


@dataclass(frozen=True)
class Options:
    """How to scan; the entropy gates, the ceiling of entropy findings, the line cap, the detectors, a digest key."""

    min_length: int = X.MIN_LENGTH
    max_prose_words: int = X.MAX_PROSE_WORDS
    min_entropy: float = X.MIN_ENTROPY
    max_entropy: float = X.MAX_ENTROPY
    min_normalized: float = X.MIN_NORMALIZED
    severity_ceiling: int = 2
    line_cap: int | None = X.LINE_CAP
    detectors: tuple[str, ...] = ("pattern", "entropy")
    key: bytes | None = None


def prepare(units: DataFrame) -> DataFrame:
    """Units with all columns, line ends made \\n, null texts empty, a byte order mark dropped."""
    have = set(units.columns)
    kinds = {"path": "string", "source_kind": "string", "commit": "string", "commit_time": "long"}
    for name, kind in kinds.items():
        if name not in have:
            units = units.withColumn(name, F.lit("file" if name == "source_kind" else None).cast(kind))
    text = F.coalesce(F.col("text"), F.lit(""))
    bare = F.when(F.startswith(text, F.lit("\ufeff")), F.regexp_replace(text, "^\ufeff", "")).otherwise(text)
    lines = F.when(F.contains(text, F.lit("\r")), T.normalize_newlines(bare)).otherwise(bare)
    return units.select("unit_id", F.coalesce("path", F.col("unit_id").cast("string")).alias("path"), lines.alias("text"), "source_kind", "commit", "commit_time")


def over_cap(units: DataFrame, cap: int) -> DataFrame:
    """Units with a line longer than cap: unit_id, path, long_lines."""
    count = F.size(F.filter(F.split("text", "\n"), lambda line: F.length(line) > cap))
    return units.where(F.length("text") > cap).select("unit_id", "path", count.alias("long_lines")).where("long_lines > 0")


def line_errors(units: DataFrame, cap: int = X.LINE_CAP) -> DataFrame:
    return over_cap(units, cap).select("path", F.lit("line-too-long").alias("code"), F.concat(F.col("long_lines").cast("string"), F.lit(" lines are longer than the entropy screen reads")).alias("reason"))


def detect(units: DataFrame, rules: Iterable[Rule] = RULES, options: Options = Options()) -> DataFrame:
    """units (unit_id, text, and path, source_kind, commit, commit_time if there) to findings, unordered."""
    rules = tuple(rules)
    ready = prepare(units)
    cap = options.line_cap
    is_long = F.lit(False) if cap is None else (F.octet_length("text") > cap) & (F.length("text") > cap) & F.exists(F.split("text", "\n"), lambda line: F.length(line) > cap)
    capped = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.substr(line, F.lit(1), F.lit(cap or 1))), "\n")
    # what a finding says of its unit travels with its id, so that no join with the units is due
    unit = F.struct("unit_id", "path", "commit", "commit_time", is_long.alias("is_long")).alias("unit_id")
    marked = ready.select(unit, "text")
    gates = {k: getattr(options, k) for k in ("min_length", "max_prose_words", "min_entropy", "max_entropy", "min_normalized")}
    screen = marked.withColumn("text", F.when(F.col("unit_id.is_long"), capped).otherwise(F.col("text")))
    candidates = lexer.entropy_candidates(screen, **gates) if "entropy" in options.detectors else None
    if not rules or "pattern" not in options.detectors:
        merged = fusion.as_findings(candidates if candidates is not None else lexer.entropy_candidates(screen.where("false")), options.severity_ceiling)
    else:
        if candidates is None:
            candidates = lexer.entropy_candidates(screen.where("false"))
        merged = fusion.fuse(patterns.matches(marked, rules), candidates, severity_ceiling=options.severity_ceiling, is_long=F.col("unit_id.is_long"))
    placed = merged.select("unit_id.path", "unit_id.commit", "unit_id.commit_time", *[c for c in merged.columns if c != "unit_id"])
    return O.dedupe(O.redact(placed, rules, key=options.key))
