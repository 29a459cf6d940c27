"""Order MinHash document fingerprints (Marçais et al. 2019), in DataFrame functions only.

A text's tokens are its words, cut into pieces of at most PIECE characters; its k-mers are runs of K tokens, each
numbered by its occurrence in the text and hashed. Each of SKETCHES orders ranks all numbered k-mers of the text by
their hash with the order's number exclusive-ored into its first bits: every order of hashes is a random permutation. The
L least of an order are put back into text order and hashed as a tuple. Equal order of rare k-mers, not only equal sets,
makes signatures agree, which tracks edit distance. Likeness of two fingerprints is the share of equal signature places.
Tokens are words, not characters, so that the cost goes by the word and an edit by the words that it touches.

A k-mer is one long: 36 bits of its hash and PLACES bits of its place, so one sort gives occurrence numbers and another the
orders: k-mers of equal first bits keep their sorted order in every order, so the L least of an order are among the L
least of each value of the first bits, at most L * SKETCHES k-mers found in one pass over the whole text. Nothing is
exploded. Places fit texts of up to 2^28 tokens; beyond, equal places are put in order of hash.

Nulls: a null text is empty. Texts without tokens share the all-zero fingerprint; a text of fewer than K tokens has one
k-mer, all its tokens. Equal texts have equal fingerprints. Extra columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import integer_ids, let

PIECE, K, SKETCHES, L = 16, 2, 32, 2
#: Bits of a k-mer's long that hold its place, and the mask of them.
PLACES = 28
PLACE = (1 << PLACES) - 1
#: First bits of a hash, as many as number the orders.
FIRST = (SKETCHES - 1).bit_length()
#: Documents a range of ids, and the most ranges.
RANGE_DOCS, RANGES = 2000, 4096


def _kmers(text: Column) -> Column:
    """K-mers as longs, sorted: hash in the upper bits, place in the lower PLACES."""

    def run(tokens: Column) -> Column:
        n = F.size(tokens)
        grams = F.transform(F.sequence(F.lit(0), F.greatest(n - K, F.lit(0))), lambda i: F.xxhash64(*[F.get(tokens, i + j) for j in range(K)]).bitwiseAND(F.lit(~PLACE)).bitwiseOR(i.cast("long").bitwiseAND(F.lit(PLACE))))
        return F.when(n == 0, F.array().cast("array<bigint>")).otherwise(F.sort_array(grams))

    return let(F.regexp_extract_all(text, F.lit(rf"[^ \t-\r]{{1,{PIECE}}}"), F.lit(0)), run)


def _numbered(kmers: Column) -> Column:
    """Sorted k-mers with the second and later occurrences hashed anew by their number, sorted again."""

    def run(a: Column) -> Column:
        n = F.size(a)
        gram = lambda x: F.shiftright(x, PLACES)
        starts = F.filter(F.sequence(F.lit(0), n - 1), lambda i: (i == 0) | (gram(F.get(a, i)) != gram(F.get(a, i - 1))))

        def renumber(s: Column) -> Column:
            ends = F.concat(F.slice(s, 2, F.greatest(F.size(s), F.lit(1))), F.array(n))
            nth = F.flatten(F.zip_with(s, ends, lambda x, y: F.sequence(F.lit(0), y - x - 1)))
            new = F.zip_with(a, nth, lambda x, k: F.when(k == 0, x).otherwise(F.xxhash64(gram(x), k).bitwiseAND(F.lit(~PLACE)).bitwiseOR(x.bitwiseAND(F.lit(PLACE)))))
            return F.when(F.size(s) == n, a).otherwise(F.sort_array(new))

        return F.when(n == 0, a).otherwise(let(starts, renumber))

    return let(kmers, run)


def _leading(kmers: Column) -> Column:
    """Of sorted k-mers, the L least of each value of the first bits."""
    first = lambda x: F.shiftright(x, 64 - FIRST)
    return let(kmers, lambda a: F.filter(a, lambda x, i: (i < L) | (first(x) != first(F.get(a, i - L)))))


def signature(text: Column) -> Column:
    """SKETCHES ints; all zero for a text without tokens."""

    def run(leading: Column) -> Column:
        def sketch(j: int) -> Column:
            order = j << 64 - FIRST
            flip = F.lit(order - (1 << 64) if order >> 63 else order)
            least = F.slice(F.sort_array(F.transform(leading, lambda x: x.bitwiseXOR(flip))), 1, L)
            in_order = F.sort_array(F.transform(least, lambda x: F.struct(x.bitwiseAND(F.lit(PLACE)).alias("p"), F.shiftright(x, PLACES).alias("h"))))
            return F.hash(F.transform(in_order, lambda x: x["h"]))

        return F.when(F.size(leading) == 0, F.array_repeat(F.lit(0), SKETCHES)).otherwise(F.array(*[sketch(j) for j in range(SKETCHES)]))

    return let(_leading(_numbered(_kmers(F.coalesce(text, F.lit(""))))), run)


def as_string(sketches: Column) -> Column:
    """Four hex digits a signature place."""
    return F.array_join(F.transform(sketches, lambda s: F.substring(F.lower(F.lpad(F.hex(s), 16, "0")), 13, 4)), "")


def likeness(a: Column, b: Column) -> Column:
    """Share of equal places of two fingerprint strings."""
    same = F.filter(F.sequence(F.lit(0), F.lit(SKETCHES - 1)), lambda i: F.substr(a, i * 4 + 1, F.lit(4)) == F.substr(b, i * 4 + 1, F.lit(4)))
    return F.size(same) / F.lit(float(SKETCHES))


def with_next(docs: DataFrame, carried: list[str]) -> DataFrame:
    """docs with `next_<column>` of the next document in descending doc_id order (after the last: the first).

    Ids are dealt to ranges of about RANGE_DOCS documents, whose bounds are quantiles; each range also gets the first
    documents of the range below, so the text is shuffled once and no task sees more than a range. Null ids come last;
    documents of equal ids are ordered by their carried columns.
    """
    facts = docs.agg(F.count(F.lit(1)), F.min("doc_id"), F.max("doc_id")).first()
    ranges = min(RANGES, max(1, -(-facts[0] // RANGE_DOCS)))
    bounds = []
    if ranges > 1 and facts[1] is not None:
        bounds = sorted(set(docs.agg(F.percentile_approx("doc_id", [i / ranges for i in range(1, ranges)], 100_000)).first()[0]))
    step = max(1, int(len(bounds) ** 0.5))
    coarse = F.array(*[F.lit(b) for b in bounds[::step]]).cast("array<bigint>")
    fine = F.array(*[F.array(*[F.lit(b) for b in bounds[i + 1 : i + step]]).cast("array<bigint>") for i in range(0, len(bounds), step)]).cast("array<array<bigint>>")
    among = lambda array: F.size(F.filter(array, lambda b: b <= F.col("doc_id")))
    # range 0 holds null ids and those below the first bound
    place = let(among(coarse), lambda c: F.when(c == 0, 0).otherwise((c - 1) * step + 1 + among(F.coalesce(F.get(fine, c - 1), F.array().cast("array<bigint>")))))
    place = F.when(F.col("doc_id").isNull(), 0).otherwise(place).cast("int")
    tops = {r["range"]: (r["top"], r["any"]) for r in docs.select("doc_id", place.alias("range")).groupBy("range").agg(F.max("doc_id").alias("top"), F.count(F.lit(1)).alias("any")).collect()}  # a row a range
    filled = sorted(tops)
    # the first documents of a range also follow the last of the next range above; the highest follow the lowest range
    above = {r: filled[(i + 1) % len(filled)] for i, r in enumerate(filled)}
    top_of = F.array(*[F.lit(tops[r][0] if r in tops else None).cast("bigint") for r in range(max(filled, default=0) + 1)])
    guest = F.array(*[F.lit(above.get(r, -1)) for r in range(max(filled, default=0) + 1)])
    homes = F.when(F.col("doc_id").eqNullSafe(F.get(top_of, F.col("range"))), F.array(F.struct(F.col("range").alias("home"), F.lit(0).alias("guest")), F.struct(F.get(guest, F.col("range")).alias("home"), F.lit(1).alias("guest")))).otherwise(F.array(F.struct(F.col("range").alias("home"), F.lit(0).alias("guest"))))
    placed = docs.withColumn("range", place).withColumn("at", F.explode(homes))
    order = W.partitionBy("at.home").orderBy("at.guest", F.col("doc_id").desc_nulls_last(), *carried)
    out = placed.select("*", *[F.lead(c).over(order).alias(f"next_{c}") for c in carried])
    return out.where(F.col("at.guest") == 0).drop("range", "at")


def edited(text: Column, following: Column) -> Column:
    """text with its last third of code points replaced by as many of the following text's first (or all)."""
    third = F.floor(F.char_length(text) / 3).cast("int")
    return F.concat(F.substr(text, F.lit(1), F.char_length(text) - third), F.substr(following, F.lit(1), third))


def fingerprinted(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text) to doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next."""
    integer_ids(docs)
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    base = docs.select("doc_id", text.alias("text")).withColumn("fingerprint", as_string(signature(F.col("text"))))
    pairs = with_next(base, ["text", "fingerprint"])
    pairs = pairs.withColumn("edited", edited(F.col("text"), F.col("next_text")))
    out = pairs.select("doc_id", F.char_length("text").cast("long").alias("n_chars"), F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"), "fingerprint", as_string(signature(F.col("edited"))).alias("edited_fingerprint"), "next_fingerprint")
    return out.select("doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"), likeness(F.col("fingerprint"), F.col("next_fingerprint")).alias("near_next"))
