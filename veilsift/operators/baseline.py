"""Known findings: which are new, which known, which gone."""

from __future__ import annotations

import json
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

IDENTITY = ["rule_id", "path", "line", "column", "value_fingerprint", "commit"]
VERSION, MOST_BYTES = 1, 256_000_000
SCHEMA = "rule_id string, path string, line int, column int, value_fingerprint string, commit string, category string, severity int, confidence int"


def _same(a: DataFrame, b: DataFrame) -> Column:
    on = F.lit(True)
    for c in IDENTITY:
        on = on & a[c].eqNullSafe(b[c])
    return on


def classify(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Identity and classification: new, baselined, stale; each identity once."""
    sides = findings.select(*IDENTITY, F.lit(True).alias("now")).unionByName(baseline.select(*IDENTITY, F.lit(False).alias("now")))
    seen = sides.groupBy(*IDENTITY).agg(F.bool_or("now").alias("now"), F.bool_and("now").alias("only"))
    return seen.select(*IDENTITY, F.when(F.col("only"), "new").when(F.col("now"), "baselined").otherwise("stale").alias("classification"))


def only_new(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    known = baseline.select(*IDENTITY)
    return findings.join(known, _same(findings, known), "left_anti")


def updated(findings: DataFrame, baseline: DataFrame) -> DataFrame:
    """Baseline entries after an update: the old ones and the current ones."""
    own = findings.select(*IDENTITY, "category", "severity", "confidence")
    old = baseline.select(*own.columns)
    gone = only_new(old, own)
    return own.dropDuplicates(IDENTITY).unionByName(gone.dropDuplicates(IDENTITY))


def read(spark: SparkSession, path: str) -> DataFrame:
    """Entries of a baseline file: {"schema_version": VERSION, "entries": [...]} in any order; a broken file, another version or an
    identity given twice is an error with a plain message."""
    with open(path, encoding="utf-8") as f:  # one small file of the driver's, its name taken literally
        raw = f.read(MOST_BYTES + 1)
    if len(raw) > MOST_BYTES:
        raise ValueError(f"a baseline of over {MOST_BYTES} characters: {path}")
    try:
        whole = json.loads(raw)
        version, entries = whole["schema_version"], whole["entries"]
        names = [c.split()[0] for c in SCHEMA.split(", ")]
        rows = [tuple(e[n] if n in ("rule_id", "path", "value_fingerprint") else e.get(n) for n in names) for e in entries]
    except (ValueError, KeyError, TypeError, AttributeError) as e:
        raise ValueError(f"not a baseline: {path}") from e
    if version != VERSION or isinstance(version, bool):
        raise ValueError(f"a baseline of another version: {path}")
    if any(not isinstance(r[names.index(n)], str) or not r[names.index(n)] for r in rows for n in ("rule_id", "path", "value_fingerprint")):
        raise ValueError(f"not a baseline: {path}")
    places = [names.index(n) for n in IDENTITY]
    twice = [i for i, n in Counter(tuple(r[p] for p in places) for r in rows).items() if n > 1]
    if twice:
        raise ValueError(f"{len(twice)} identities are given twice in the baseline: {path}")
    return spark.createDataFrame(rows, SCHEMA)


def as_json(baseline: DataFrame) -> str:
    """The baseline file's text, entries in order of identity."""
    rows = [r.asDict() for r in baseline.orderBy(*IDENTITY).collect()]
    return json.dumps({"schema_version": 1, "entries": rows}, sort_keys=True, indent=1)
