"""Tokens of a text: quoted literals and assigned values, found by one tiling pattern.

The pattern's matches put together are the text, so a lexeme's offset is the length of what precedes it. Lexemes are
filtered inside their array; only survivors become rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .. import fixed as X
from ..functions import info
from ..functions import text as T


def lexemes(text: Column) -> Column:
    """All lexemes in order; joined they give the text."""
    return F.regexp_extract_all(text, F.lit(X.TILE), F.lit(0))


def coarse_lexemes(text: Column) -> Column:
    """As `lexemes`, with neighbours that can't be tokens put together: fewer strings, the same tokens at the same offsets."""
    return F.regexp_extract_all(text, F.lit(X.COARSE_TILE), F.lit(0))


def _value(lexeme: Column) -> Column:
    """A token's value: what the quotes hold, escapes collapsed, or what follows '='."""
    inner = F.substr(lexeme, F.lit(2), F.length(lexeme) - 2)
    quoted = F.regexp_replace(inner, r"\\(?:\n|([\s\S]))", "$1")
    return F.when(F.rlike(lexeme, F.lit(r"^[\"'`]")), quoted).otherwise(F.regexp_replace(lexeme, X.NAME_BEFORE_VALUE, ""))


def raw_tokens(units: DataFrame, min_length: int = 1) -> DataFrame:
    """units (unit_id, text with \\n line ends) to (unit_id, value, start, end, line, column, origin), before any filter."""
    first = lambda x: F.substr(x, F.lit(1), F.lit(1))
    is_quoted = lambda x: first(x).isin('"', "'", "`")
    is_token = lambda x: (F.length(x) >= min_length + 2) & (is_quoted(x) | F.rlike(x, F.lit(X.ASSIGNMENT)))

    def token(lexeme: Column, offset: Column) -> Column:
        end = offset + F.length(lexeme)

        def of(v: Column) -> Column:
            # an assigned value ends its lexeme as it stands; a quoted one lies between the quotes
            return F.struct(
                v.alias("value"), F.when(is_quoted(lexeme), offset + 1).otherwise(end - F.length(v)).cast("int").alias("start"), F.when(is_quoted(lexeme), end - 1).otherwise(end).cast("int").alias("end"),
                F.when(is_quoted(lexeme), "quoted").otherwise("unquoted-assignment").alias("origin"),
            )

        return T.let(_value(lexeme), of)

    found = T.let(
        coarse_lexemes(F.col("text")),
        lambda all_: T.let(
            F.filter(F.transform(all_, lambda x, i: F.struct(x.alias("lexeme"), i.alias("at"))), lambda s: is_token(s["lexeme"])),
            lambda kept: F.when(
                F.size(kept) > 0,
                T.running(F.transform(all_, lambda x: F.length(x)), lambda before: F.transform(kept, lambda s: token(s["lexeme"], before(s["at"])))),
            ),
        ),
    )
    can_hold = T.contains_any(F.col("text"), "=\"'`")  # most prose needs no lexer
    rows = units.select("*", F.explode(F.when(can_hold, found)).alias("t")).select("*", "t.*").where(F.length("value") >= min_length)
    return rows.select("unit_id", "value", "start", "end", T.line_of(F.col("text"), F.col("start")).alias("line"), T.column_of(F.col("text"), F.col("start")).alias("column"), "origin")


def tokens(units: DataFrame, min_length: int = 1) -> DataFrame:
    """Tokens that may be credentials by their shape."""
    return raw_tokens(units, min_length).where(T.plausible_token(F.col("value")))


def entropy_candidates(units: DataFrame, *, min_length: int = X.MIN_LENGTH, max_prose_words: int = X.MAX_PROSE_WORDS, min_entropy: float = X.MIN_ENTROPY, max_entropy: float = X.MAX_ENTROPY, min_normalized: float = X.MIN_NORMALIZED) -> DataFrame:
    """Tokens that pass the entropy gates, with their entropy."""
    v = F.col("value")
    short = tokens(units, min_length).where((F.length(v) >= min_length) & (T.prose_words(v) <= max_prose_words))
    rated = T.once(short, entropy=info.shannon_entropy(v), distinct=info.distinct_count(v))
    return rated.where((F.col("entropy") >= min_entropy) & (F.col("entropy") <= max_entropy) & (info.normalized(F.col("entropy"), F.col("distinct")) >= min_normalized)).drop("distinct")
