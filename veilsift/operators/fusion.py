"""Pattern matches and entropy candidates of the same value become one finding.

Both sides are the few rows that survive the gates. `fuse` gathers a unit's into arrays, which reads each side once;
`fuse_by_join` gives the same rows by an equi-join on the unit with the spans as its residual condition.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import text as T


def best_patterns(matches: DataFrame) -> DataFrame:
    """One rule for each span and value: the most specific, then by priority, id."""
    w = W.partitionBy("unit_id", "start", "end", "value").orderBy("specificity", "priority", "rule_id")
    return matches.withColumn("_rank", F.row_number().over(w)).where("_rank = 1").drop("_rank")


def overlaps(patterns: DataFrame, candidates: DataFrame) -> DataFrame:
    """(unit_id, p_rule, p_start, p_end, p_value, c_start, c_end): pairs that describe the same value."""
    p = patterns.select("unit_id", F.col("rule_id").alias("p_rule"), F.col("start").alias("p_start"), F.col("end").alias("p_end"), F.col("value").alias("p_value"))
    c = candidates.select(F.col("unit_id").alias("c_unit"), F.col("start").alias("c_start"), F.col("end").alias("c_end"), F.col("value").alias("c_value"))
    meet = (F.col("unit_id") == F.col("c_unit")) & (F.col("p_start") < F.col("c_end")) & (F.col("c_start") < F.col("p_end"))
    inside = ((F.col("p_start") <= F.col("c_start")) & (F.col("c_end") <= F.col("p_end"))) | ((F.col("c_start") <= F.col("p_start")) & (F.col("p_end") <= F.col("c_end")))
    same = inside | F.contains(F.col("p_value"), F.col("c_value")) | F.contains(F.col("c_value"), F.col("p_value"))
    return p.join(c, meet & same).select("unit_id", "p_rule", "p_start", "p_end", "p_value", "c_start", "c_end")


def fuse_by_join(matches: DataFrame, candidates: DataFrame, *, severity_ceiling: int = 2) -> DataFrame:
    """Matches and candidates to merged rows with detector and confidence.

    A candidate of one pattern supports it, one of several is used up, one of none is a finding of its own.
    """
    patterns = best_patterns(matches)
    pairs = overlaps(patterns, candidates)
    of_candidate = pairs.groupBy("unit_id", "c_start", "c_end").agg(F.count(F.lit(1)).alias("n"), F.min(F.struct("p_rule", "p_start", "p_end", "p_value")).alias("p"))
    support = of_candidate.where("n = 1").select("unit_id", F.col("p.p_rule").alias("rule_id"), F.col("p.p_start").alias("start"), F.col("p.p_end").alias("end"), F.col("p.p_value").alias("value")).distinct().withColumn("supported", F.lit(True))
    joined = patterns.join(support, ["unit_id", "rule_id", "start", "end", "value"], "left")
    supported = F.coalesce("supported", F.lit(False))
    from_patterns = joined.select("unit_id", "rule_id", "value", "start", "end", "line", "column", "entropy", "keywords", F.when(supported, 3).otherwise(F.col("confidence")).alias("confidence"), "severity", F.when(supported, "composite").otherwise("pattern").alias("detector"))
    used = of_candidate.select("unit_id", F.col("c_start").alias("start"), F.col("c_end").alias("end"))
    alone = candidates.join(used, ["unit_id", "start", "end"], "left_anti")
    return from_patterns.unionByName(as_findings(alone, severity_ceiling))


PATTERN = ["rule_id", "value", "start", "end", "line", "column", "entropy", "keywords", "confidence", "severity", "specificity", "priority"]
OUT = ["rule_id", "value", "start", "end", "line", "column", "entropy", "keywords", "confidence", "severity", "detector"]


def fuse(matches: DataFrame, candidates: DataFrame, *, severity_ceiling: int = 2, is_long: Column | None = None) -> DataFrame:
    """Matches and candidates to merged rows with detector and confidence.

    A candidate of one pattern supports it, one of several is used up, one of none is a finding of its own. Of units
    for which is_long (of unit_id) holds, both sides are kept as they are; a value may come twice.
    """
    p = matches.select("unit_id", *PATTERN, F.lit(True).alias("by_rule"))
    c = as_findings(candidates, severity_ceiling).select("unit_id", *PATTERN[:10], F.lit(0).alias("specificity"), F.lit(0).alias("priority"), F.lit(False).alias("by_rule"))
    rows = p.unionByName(c).groupBy("unit_id").agg(F.collect_list(F.struct(*PATTERN, "by_rule")).alias("all"))

    def as_out(x: Column, confidence: Column, detector: Column) -> Column:
        return F.struct(*[confidence.alias(k) if k == "confidence" else detector.alias(k) if k == "detector" else x[k].alias(k) for k in OUT])

    def meets(a: Column, b: Column) -> Column:
        cross = (a["start"] < b["end"]) & (b["start"] < a["end"])
        inside = ((a["start"] <= b["start"]) & (b["end"] <= a["end"])) | ((b["start"] <= a["start"]) & (a["end"] <= b["end"]))
        return cross & (inside | F.contains(a["value"], b["value"]) | F.contains(b["value"], a["value"]))

    def same(a: Column, b: Column) -> Column:
        return (a["start"] == b["start"]) & (a["end"] == b["end"]) & (a["value"] == b["value"])

    rank = lambda x: F.struct(x["specificity"], x["priority"], x["rule_id"])

    def merged(both: Column) -> Column:
        best = F.filter(both["p"], lambda x: ~F.exists(both["p"], lambda y: same(x, y) & (rank(y) < rank(x))))

        def with_best(b: Column) -> Column:
            near = F.transform(both["c"], lambda c: F.struct(c.alias("c"), F.filter(b, lambda x: meets(x, c)).alias("ps")))

            def with_near(n: Column) -> Column:
                support = F.transform(F.filter(n, lambda s: F.size(s["ps"]) == 1), lambda s: s["ps"][0])
                from_rules = T.let(support, lambda s: F.transform(b, lambda x: T.let(F.exists(s, lambda y: same(x, y) & (x["rule_id"] == y["rule_id"])), lambda yes: as_out(x, F.when(yes, 3).otherwise(x["confidence"]), F.when(yes, "composite").otherwise("pattern")))))
                alone = F.transform(F.filter(n, lambda s: F.size(s["ps"]) == 0), lambda s: as_out(s["c"], s["c"]["confidence"], F.lit("entropy")))
                return F.concat(from_rules, alone)

            return T.let(near, with_near)

        return T.let(best, with_best)

    sides = F.struct(F.array_distinct(F.filter("all", lambda x: x["by_rule"])).alias("p"), F.filter("all", lambda x: ~x["by_rule"]).alias("c"))
    apart = F.transform("all", lambda x: as_out(x, x["confidence"], F.when(x["by_rule"], "pattern").otherwise("entropy")))
    out = T.let(sides, merged)
    if is_long is not None:
        out = F.when(is_long, F.array_distinct(apart)).otherwise(out)
    return rows.select("unit_id", F.explode(out).alias("m")).select("unit_id", "m.*")


def as_findings(candidates: DataFrame, severity_ceiling: int = 2) -> DataFrame:
    """Entropy candidates as merged rows."""
    return candidates.select(
        "unit_id", F.lit(X.ENTROPY_RULE).alias("rule_id"), "value", "start", "end", "line", "column", "entropy", F.array().cast("array<string>").alias("keywords"), F.lit(2).alias("confidence"), F.lit(min(severity_ceiling, 2)).alias("severity"), F.lit("entropy").alias("detector"),
    )


def unfused(matches: DataFrame, candidates: DataFrame) -> DataFrame:
    """Both sides as they are, for units with over-long lines; a value may come twice."""
    once = matches.dropDuplicates(["unit_id", "rule_id", "start", "end"])
    own = once.select("unit_id", "rule_id", "value", "start", "end", "line", "column", "entropy", "keywords", "confidence", "severity", F.lit("pattern").alias("detector"))
    return own.unionByName(as_findings(candidates))
