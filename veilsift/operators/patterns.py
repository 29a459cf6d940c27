"""Matches of the rule table. Patterns are literals, so that each is compiled once a task; matches are rows only."""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import info
from ..functions import text as T
from ..rules import HELD, RULES, RUN, Rule

MATCH = "struct<value:string,start:int,end:int>"


def holds(text: Column, held: tuple[str, ...] | str) -> Column:
    """Whether a text may match a pattern by what each match holds (rules.HELD): a search for a literal costs far less."""
    if isinstance(held, str):
        return F.rlike(text, F.lit(held))
    return T.contains_any(text, held) if held else F.lit(True)


def spans(text: Column, pattern: str, group: int = 0) -> Column:
    """Every match: value (of the group), and start and end of the whole match."""
    held = HELD.get(pattern, ())
    pattern = "(?m)" + RUN.get(pattern, pattern)
    may = holds(text, held)
    if not held or isinstance(held, str):
        may = may & F.rlike(text, F.lit(pattern))

    def of(gaps: Column) -> Column:
        whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

        def build(m: Column) -> Column:
            start = lambda i: F.length(F.array_join(F.slice(gaps, 1, i + 1), "")) + F.length(F.array_join(F.slice(m, 1, i), ""))
            values = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else m
            return F.transform(F.zip_with(m, values, lambda a, b: F.struct(a.alias("m"), b.alias("v"))), lambda s, i: F.struct(s["v"].alias("value"), start(i).alias("start"), (start(i) + F.length(s["m"])).alias("end")))

        return T.let(whole, build)

    return F.when(may, T.let(F.split(text, pattern, -1), of)).otherwise(F.array().cast(f"array<{MATCH}>"))


def raw_matches(units: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """units (unit_id, text) to (unit_id, text, rule_id, value, start, end): every match, before the gates."""

    def of(r: Rule) -> Column:
        named = lambda s: F.struct(F.lit(r.rule_id).alias("rule_id"), s["value"].alias("value"), s["start"].alias("start"), s["end"].alias("end"))
        return F.transform(spans(F.col("text"), r.pattern, r.value_group), named)

    found = F.flatten(F.array(*map(of, rules)))
    return units.select("unit_id", "text", F.explode(found).alias("m")).select("unit_id", "text", "m.*")


def _by_rule(rules: Iterable[Rule], what, kind: str) -> Column:
    """A rule's field as a literal chosen by rule_id."""
    out = None
    for r in rules:
        v = what(r)
        c = v if isinstance(v, Column) else F.lit(v)
        out = F.when(F.col("rule_id") == r.rule_id, c.cast(kind)) if out is None else out.when(F.col("rule_id") == r.rule_id, c.cast(kind))
    return out if out is not None else F.lit(None).cast(kind)


def matches(units: DataFrame, rules: Iterable[Rule] = RULES) -> DataFrame:
    """Matches that pass the gates: rule_id, value, start, end, line, column, entropy, keywords, assignment_name,
    confidence, severity, specificity, priority."""
    rules = tuple(rules)
    v = F.col("value")
    lenient = [r.rule_id for r in rules if not r.suppress_placeholders]
    placeholder = T.match_placeholder(v)
    for r in rules:
        if r.placeholders:
            placeholder = placeholder | ((F.col("rule_id") == r.rule_id) & F.rlike(F.lower(v), F.lit(T.any_of(p.lower() for p in r.placeholders))))
    if lenient:
        placeholder = placeholder & ~F.col("rule_id").isin(*lenient)
    hashes = [r.rule_id for r in rules if r.reject_hashes]
    n = F.length(v)
    kept = raw_matches(units, rules).where(v.isNotNull() & (v != "") & (n <= F.least(F.lit(X.MAX_MATCH), F.coalesce(_by_rule(rules, lambda r: r.max_length, "int"), F.lit(X.MAX_MATCH)))))
    kept = kept.where(~placeholder).where(~T.match_template(v)).where(~T.repetitive(v))
    if hashes:
        kept = kept.where(~(F.col("rule_id").isin(*hashes) & T.looks_like_hash(v)))
    kept = T.once(kept, entropy=info.shannon_entropy(v)).where(F.col("entropy") >= F.coalesce(_by_rule(rules, lambda r: r.min_entropy, "double"), F.lit(0.0)))
    kept = T.once(kept, line_text=T.line_text(F.col("text"), F.col("start")), line=T.line_of(F.col("text"), F.col("start")), column=T.column_of(F.col("text"), F.col("start"))).drop("text")
    keywords = T.present_keywords(F.col("line_text"), _by_rule(rules, lambda r: T.keyword_pairs(r.keywords), "array<struct<keyword:string,normalised:string>>"))
    kept = T.once(kept, keywords=keywords, assignment_name=T.assignment_name(F.col("line_text"), F.col("column")))
    need = [r.rule_id for r in rules if r.requires_context]
    if need:
        kept = kept.where(~F.col("rule_id").isin(*need) | (F.size("keywords") > 0))
    floor = _by_rule(rules, lambda r: r.floor, "int")
    confidence = F.when((floor < 3) & ((F.size("keywords") > 0) | F.col("assignment_name").isNotNull()), F.least(floor + 1, F.lit(3))).otherwise(floor)
    return kept.select(
        "unit_id", "rule_id", "value", "start", "end", "line", "column", "entropy", "keywords", "assignment_name", confidence.alias("confidence"),
        _by_rule(rules, lambda r: r.severity, "int").alias("severity"), _by_rule(rules, lambda r: 0 if r.exact else 1, "int").alias("specificity"), _by_rule(rules, lambda r: r.priority, "int").alias("priority"),
    )
