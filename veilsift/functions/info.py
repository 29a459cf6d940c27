"""Information measures, digests and masks of columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import fixed as X
from .text import has_controls, let

#: What counts as white space at a value's ends.
WHITE = r"[\s\x1c-\x1f\x{85}\p{Z}]"


def shannon_entropy(value: Column) -> Column:
    """Bits a character; 0 for the empty string. Terms are added in order of first appearance."""

    def of(v: Column) -> Column:
        # bytes gone over a character's bytes are its occurrences: counting characters anew costs more
        share = lambda c, n: (F.octet_length(v) - F.octet_length(F.replace(v, c, F.lit("")))) / F.octet_length(c) / n
        shares = let(F.length(v), lambda n: F.transform(F.array_distinct(F.split(v, "")), lambda c: share(c, n)))
        return F.aggregate(shares, F.lit(0.0), lambda a, share: a - share * F.log2(share))

    return F.when(value == "", F.lit(0.0)).otherwise(let(value, of))


def normalized_entropy(value: Column) -> Column:
    """Entropy over its most for as many distinct characters; 0 below two."""
    return F.when(value == "", F.lit(0.0)).otherwise(normalized(shannon_entropy(value), distinct_count(value)))


def distinct_count(value: Column) -> Column:
    return F.size(F.array_distinct(F.split(value, "")))


def normalized(entropy: Column, distinct: Column) -> Column:
    """As normalized_entropy, of an entropy and a count that are there."""
    return F.when(distinct < 2, F.lit(0.0)).otherwise(F.least(F.lit(1.0), entropy / F.log2(distinct)))


def distinct_characters(value: Column) -> Column:
    return F.when(value == "", F.array().cast("array<string>")).otherwise(F.array_sort(F.array_distinct(F.split(value, ""))))


def charset_family(value: Column) -> Column:
    """The narrowest alphabet that holds the value."""
    return (
        F.when(value == "", "empty").when(F.rlike(value, F.lit(r"^[0-9a-fA-F]*\z")), "hex").when(F.rlike(value, F.lit(r"^[A-Z2-7]*\z")), "base32").when(F.rlike(value, F.lit(r"^[A-Za-z0-9\-_=]*\z")), "base64").otherwise("mixed")
    )


def fingerprint(value: Column, key: bytes | None = None) -> Column:
    """The first 12 hex digits of SHA-256, or of HMAC-SHA-256 under a key."""
    if key is None:
        return F.substring(F.sha2(value.cast("binary"), 256), 1, X.FINGERPRINT_HEX)
    if len(key) > 64:
        import hashlib

        key = hashlib.sha256(key).digest()
    inner, outer = (bytes(b ^ pad for b in key.ljust(64, b"\0")) for pad in (0x36, 0x5C))
    inside = F.unhex(F.sha2(F.concat(F.lit(inner), value.cast("binary")), 256))
    return F.substring(F.sha2(F.concat(F.lit(outer), inside), 256), 1, X.FINGERPRINT_HEX)


def is_fingerprint(value: Column) -> Column:
    return F.coalesce(F.rlike(value, F.lit(r"^[0-9a-f]{12}\z")), F.lit(False))


def mask(value: Column, prefix: int = 0, suffix: int = 0) -> Column:
    """The mark, with a few characters before and after only if enough stay hidden; never the value itself."""
    if prefix < 0 or suffix < 0:
        raise ValueError("a mask can't reveal fewer than no characters")
    prefix = min(prefix, X.MAX_REVEALED)
    suffix = min(suffix, X.MAX_REVEALED - prefix)
    if not prefix and not suffix:  # only a value that is the mark itself, white space aside, needs a look
        v = F.regexp_replace(value, rf"^{WHITE}+|{WHITE}+\z", "")
        return F.when(F.contains(value, F.lit(X.REDACTION)) & (v == X.REDACTION), F.lit(X.REDACTION_FALLBACK)).otherwise(F.lit(X.REDACTION))
    v = F.regexp_replace(value, rf"^{WHITE}+|{WHITE}+\z", "")
    n = F.length(v)
    shown = F.concat(F.substr(v, F.lit(1), F.lit(prefix)), F.lit(X.REDACTION), F.substr(v, n - suffix + 1, F.lit(suffix)))
    out = F.when((n - prefix - suffix >= X.MIN_HIDDEN) & ~has_controls(v), shown).otherwise(F.lit(X.REDACTION))
    return F.when(out == v, F.lit(X.REDACTION_FALLBACK)).otherwise(out)
