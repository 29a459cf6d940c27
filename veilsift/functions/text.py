"""Text predicates and transformations of columns. Null in, null out unless said otherwise."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body(value), value evaluated once even where body uses it in lambdas."""
    return F.transform(F.array(value), body)[0]


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, each evaluated once a row: Spark copies a column of `withColumn` into every filter on it and again
    into the projection, but nothing through a generator."""
    made = F.struct(*(c.alias(name) for name, c in columns.items()))
    return df.select("*", F.explode_outer(F.array(made)).alias("_once")).select("*", "_once.*").drop("_once")


def contains_any(text: Column, parts: Iterable[str]) -> Column:
    hit = F.lit(False)
    for p in parts:
        hit = hit | F.contains(text, F.lit(p))
    return hit


def any_of(parts: Iterable[str]) -> str:
    """A pattern of literal alternatives."""
    return "|".join(re.sub(r"([^A-Za-z0-9_ ])", r"\\\1", p) for p in parts)


def normalize_newlines(text: Column) -> Column:
    return F.regexp_replace(text, r"\r\n?", "\n")


def normalize_keyword(text: Column) -> Column:
    """Lower case, letters and digits only."""
    return F.regexp_replace(F.lower(text), r"[^a-z0-9]+", "")


def assignment_name(line: Column, column: Column) -> Column:
    """The name that a value at a 1-based column is assigned to; null without one."""
    return F.nullif(F.regexp_extract(F.substr(line, F.lit(1), column - 1), X.ASSIGNED_NAME, 1), F.lit(""))


def present_keywords(line: Column, keywords: Column) -> Column:
    """The keywords (array of keyword, normalised) that a line holds, the line normalised too."""
    return let(normalize_keyword(line), lambda n: F.transform(F.filter(keywords, lambda k: F.contains(n, k["normalised"])), lambda k: k["keyword"]))


def keyword_pairs(keywords: Iterable[str]) -> Column:
    """Array of keyword, normalised; what is plain is normalised here, not at every row."""
    own = lambda k: F.lit(re.sub("[^a-z0-9]+", "", k.lower())) if k.isascii() else normalize_keyword(F.lit(k))
    return F.array(*(F.struct(F.lit(k).alias("keyword"), own(k).alias("normalised")) for k in keywords)).cast("array<struct<keyword:string,normalised:string>>")


def term_pattern(term: str) -> str:
    return rf"(?i)(?<![A-Za-z0-9]){'[-_]?'.join(term.replace('-', ''))}(?![A-Za-z0-9])"


def keyword_score(line: Column) -> Column:
    """Distinct credential terms of a line, terms inside wider ones not counted.

    A term's span is that of its first match; spans are swept by start, the widest first.
    """

    def span(term: str) -> Column:
        p = F.lit(term_pattern(term))
        start = F.length(F.element_at(F.split(line, term_pattern(term), 2), 1))
        return F.when(F.regexp_like(line, p), F.struct(start.alias("s"), (-(start + F.length(F.regexp_substr(line, p)))).alias("e")))

    spans = F.array_sort(F.array_compact(F.array(*[span(t) for t in X.CREDENTIAL_TERMS])))
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("covered"))
    step = lambda a, s: F.when(-s["e"] > a["covered"], F.struct((a["n"] + 1).alias("n"), (-s["e"]).alias("covered"))).otherwise(a)
    return F.aggregate(spans, zero, step, lambda a: a["n"])


def _wrapped(value: Column, pairs: Iterable[tuple[str, str]], inner: int) -> Column:
    hit = F.lit(False)
    for a, z in pairs:
        hit = hit | (F.startswith(value, F.lit(a)) & F.endswith(value, F.lit(z)) & (F.length(value) >= len(a) + len(z) + inner))
    return hit


def _opens(value: Column, openings: Iterable[str]) -> Column:
    """Whether a value begins, white space aside, as one of some openings does: asked before dearer questions."""
    return F.rlike(value, F.lit(rf"^\s*(?:{any_of(sorted({o[0] for o in openings}))})"))


def token_template(value: Column) -> Column:
    """Of the lexer: wholly a template expression."""
    v = F.regexp_replace(value, r"^\s+|\s+$", "")
    hit = v.isin(*X.TOKEN_TEMPLATE_VALUES)
    for a, z in X.TOKEN_TEMPLATE_PAIRS:
        hit = hit | (F.startswith(v, F.lit(a)) & F.endswith(v, F.lit(z)))
    return _opens(value, (*X.TOKEN_TEMPLATE_VALUES, *(a for a, _ in X.TOKEN_TEMPLATE_PAIRS))) & hit


def match_template(value: Column) -> Column:
    """Of a rule's match: wholly a template expression with something inside."""
    return _opens(value, (a for a, _ in X.MATCH_TEMPLATE_PAIRS)) & _wrapped(F.regexp_replace(value, r"^\s+|\s+$", ""), X.MATCH_TEMPLATE_PAIRS, 1)


def _has_word(lower: Column, words: Iterable[str]) -> Column:
    words = tuple(words)
    return contains_any(lower, words) & F.rlike(lower, F.lit(rf"(?:^|[^a-z0-9])(?:{any_of(words)})(?:[^a-z0-9]|$)"))


def token_placeholder(value: Column) -> Column:
    return let(F.lower(value), lambda low: contains_any(low, X.TOKEN_PLACEHOLDER_PARTS) | _has_word(low, X.TOKEN_PLACEHOLDER_WORDS))


def match_placeholder(value: Column, extra: Iterable[str] = ()) -> Column:
    parts = (*X.MATCH_PLACEHOLDER_PARTS, *(e.lower() for e in extra))
    openings = sorted({p.partition(" ")[0] for p in X.MATCH_PLACEHOLDER_PHRASES})

    def of(low: Column) -> Column:
        phrase = contains_any(low, openings) & F.rlike(F.regexp_replace(low, r"[-_]+", " "), F.lit(any_of(X.MATCH_PLACEHOLDER_PHRASES)))
        return contains_any(low, parts) | _has_word(low, X.MATCH_PLACEHOLDER_WORDS) | phrase

    return let(F.lower(value), of)


def repetitive(value: Column) -> Column:
    """One distinct character, two equal halves, or a run up or down; at least four characters."""

    def of(v: Column) -> Column:
        n = F.length(v)
        steps = F.sequence(F.lit(1), n - 1)
        code = lambda i: F.ascii(F.substr(v, i, F.lit(1)))
        first = code(F.lit(2)) - code(F.lit(1))
        run = lambda by: (first == by) & F.forall(steps, lambda i: code(i + 1) - code(i) == by)
        half = (n / 2).cast("int")
        return (n >= 4) & ((F.length(F.replace(v, F.substr(v, F.lit(1), F.lit(1)), F.lit(""))) == 0) | ((n % 2 == 0) & (F.substr(v, F.lit(1), half) == F.substr(v, half + 1, half))) | run(1) | run(-1))

    return F.when(F.length(value) < 4, F.lit(False)).otherwise(let(value, of))


def looks_like_hash(value: Column) -> Column:
    return F.rlike(value, F.lit(r"^[0-9a-fA-F]+\z")) & F.length(value).isin(*X.HASH_LENGTHS)


def non_secret_structure(value: Column) -> Column:
    """Code, names, markup or addresses rather than a credential."""
    return (
        contains_any(value, "\n\r{}")
        | (F.contains(value, F.lit(".")) & F.rlike(value, F.lit(rf"^{X.IDENTIFIER}(?:\.{X.IDENTIFIER})+\z")))
        | (F.contains(value, F.lit("_")) & F.rlike(value, F.lit(rf"^{X.IDENTIFIER}\z")))
        | (F.contains(value, F.lit("-")) & F.rlike(value, F.lit(rf"^{X.KEBAB}\z")))
        | F.startswith(value, F.lit("~"))
        | (F.startswith(value, F.lit(":")) & F.rlike(value, F.lit(X.ROLE)))
        | F.contains(value, F.lit("(?:"))
        | F.contains(value, F.lit("\\"))
        | (F.startswith(value, F.lit("^")) & F.endswith(value, F.lit("$")) & (F.length(value) > 1))
        | (F.contains(value, F.lit("(")) & F.rlike(value, F.lit(X.CALL_SHAPE)))
        | (F.contains(value, F.lit("://")) & ~F.rlike(value, F.lit("[@?]")))
    )


def plausible_token(value: Column) -> Column:
    """Cheap tests first; the order is kept within a filter."""
    n = F.length(value)
    return (n > 0) & (n <= X.MAX_TOKEN) & ~token_template(value) & ~token_placeholder(value) & ~repetitive(value) & ~non_secret_structure(value)


def prose_words(value: Column) -> Column:
    """Words of two or more characters."""
    words = F.size(F.filter(F.split(F.regexp_replace(value, r"^\s+|\s+$", ""), r"\s+"), lambda w: F.length(w) >= 2))
    return F.when(~F.rlike(value, F.lit(r"\s")), F.when(F.length(value) >= 2, 1).otherwise(0)).otherwise(words)


CONTROLS = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"


#: Lengths that one block of `running` sums.
BLOCK = 256


def running(lengths: Column, use: Callable[[Callable[[Column], Column]], Column]) -> Column:
    """use(before), where before(i) is the sum of the first i lengths: a block's start is looked up, and fewer than BLOCK
    lengths are added to it, so that many of them cost no more than a few."""
    total = lambda a: F.aggregate(a, F.lit(0), lambda s, x: s + x)
    blocks = lambda ls: F.sequence(F.lit(0), (F.size(ls) / BLOCK).cast("int"))

    def of(ls: Column) -> Column:
        sums = F.transform(blocks(ls), lambda b: total(F.slice(ls, b * BLOCK + 1, BLOCK)))
        starts = let(sums, lambda s: F.transform(blocks(ls), lambda b: total(F.slice(s, 1, b))))

        def looked_up(begin: Column) -> Column:
            return use(lambda i: F.get(begin, (i / BLOCK).cast("int")) + total(F.slice(ls, (i / BLOCK).cast("int") * BLOCK + 1, i % BLOCK)))

        return let(starts, looked_up)

    return let(lengths, of)


def strip_controls(text: Column) -> Column:
    return F.regexp_replace(text, CONTROLS, "")


def has_controls(text: Column) -> Column:
    return F.rlike(text, F.lit(CONTROLS))


def sanitize_text(text: Column) -> Column:
    """Controls become spaces, runs of white space one space, ends trimmed."""
    return F.trim(F.regexp_replace(F.regexp_replace(text, r"[\x00-\x1f\x7f-\x{9f}]", " "), r"\s+", " "))


def sanitize_excerpt(line: Column, spans: Column, marker: str = X.REDACTION) -> Column:
    """The line with every span (array of start, end) replaced by the marker, then without controls. Spans come in any order;
    they are cut at the line's ends, and those that overlap or touch get one marker."""
    if not marker:
        raise ValueError("a marker is not empty")
    n = F.length(line)
    inside = F.transform(spans, lambda s: F.struct(F.greatest(s["start"].cast("int"), F.lit(0)).alias("start"), F.least(s["end"].cast("int"), n).alias("end")))
    ordered = F.array_sort(F.filter(inside, lambda s: s["end"] > s["start"]))
    zero = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"), F.lit(False).alias("any"))

    def step(a: Column, s: Column) -> Column:
        joined = F.struct(a["out"].alias("out"), F.greatest(a["at"], s["end"]).alias("at"), F.lit(True).alias("any"))
        apart = F.struct(F.concat(a["out"], F.substr(line, a["at"] + 1, s["start"] - a["at"]), F.lit(marker)).alias("out"), s["end"].alias("at"), F.lit(True).alias("any"))
        return F.when(a["any"] & (s["start"] <= a["at"]), joined).otherwise(apart)

    return strip_controls(F.aggregate(ordered, zero, step, lambda a: F.concat(a["out"], F.substr(line, a["at"] + 1))))


def markdown_escape(text: Column) -> Column:
    return sanitize_text(F.regexp_replace(text, r"([|`\[\]*_#<>])", r"\\$1"))


def line_of(text: Column, offset: Column) -> Column:
    """1-based line of a 0-based offset."""
    before = F.substr(text, F.lit(1), offset)
    return (F.length(before) - F.length(F.replace(before, F.lit("\n"), F.lit(""))) + 1).cast("int")


def column_of(text: Column, offset: Column) -> Column:
    """1-based column of a 0-based offset."""
    return (F.length(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1)) + 1).cast("int")


def line_text(text: Column, offset: Column) -> Column:
    """The line that holds an offset."""
    return F.concat(F.substring_index(F.substr(text, F.lit(1), offset), "\n", -1), F.substring_index(F.substr(text, offset + 1), "\n", 1))


def location(path: Column, line: Column, column: Column, commit: Column) -> Column:
    """path:line:column@commit, what is null left out."""
    at = F.when(line.isNotNull(), F.concat(F.lit(":"), line, F.when(column.isNotNull(), F.concat(F.lit(":"), column)).otherwise(F.lit(""))))
    return F.concat(path, F.coalesce(at, F.lit("")), F.coalesce(F.concat(F.lit("@"), F.substr(commit, F.lit(1), F.lit(12))), F.lit("")))
