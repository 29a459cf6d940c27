"""Quality rules: base rules, then robust outliers by minimum covariance determinant (Rousseeuw and Van Driessen 1999).

Every text gives a vector of FEATURES transformed statistics. Over the texts that pass the base rules, each language
and source gets a centre and scatter: concentration steps keep the share SUBSET of its rows with the least Mahalanobis
distances and estimate anew from them. Two deterministic starts (medians with quartile scales; medians with FLOOR as
scales) are improved STEPS times and the one of lesser determinant stays. The scatter is scaled to be consistent for
normal data, and FLOOR squared is added to its diagonal: a statistic that hardly varies in a group (no symbols at all)
must not make a tiny deviation infinite. Where texts hardly repeat, a repeated share of about 0.28 alone is far enough to
go. A document goes if its squared distance exceeds the chi-squared quantile at
CONFIDENCE.

Statistics, quantiles and moments cover all rows and are sums that Spark combines before it shuffles; a group's rows
are never gathered. A group's centre and scatter are averaged, by their rows, with PRIOR_ROWS rows' worth of its language's,
and those with PRIOR_ROWS rows' worth of the estimate of all rows: small groups lean on their language without a switch.

Nulls: a null text has no word and fails the base rules; a null language or source is a value of its own. Without any
row that passes the base rules there is no estimate and nothing more is rejected. Repeated rows count each. An empty
table gives an empty result. Other columns are ignored, or kept by `kept_documents`.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import durable, give_back, lookup, remove_scratch, ship

FEATURES = 6
#: Least deviations that count: log word length, roots of the shares of symbols, non-letters, capitals, words in
#: repeated windows, and repeated lines.
FLOOR = (0.08, 0.05, 0.08, 0.06, 0.1, 0.1)
SUBSET, STEPS, PRIOR_ROWS, CONFIDENCE = 0.75, 6, 60, 0.9999
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50

SPACE = b" \t\n\x0b\x0c\r"
SYMBOLS = b"#*$%&|<>"
CAPITALS = bytes(range(65, 91))
NOT_LETTERS = bytes(c for c in range(128) if not chr(c).isalpha())

PAIRS = [(i, j) for i in range(FEATURES) for j in range(i, FEATURES)]
X = [f"x{i}" for i in range(FEATURES)]
BASE = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]


def chi2_cdf(x: float, dof: int) -> float:
    """For even degrees of freedom."""
    return 1 - math.exp(-x / 2) * sum((x / 2) ** k / math.factorial(k) for k in range(dof // 2))


def chi2_quantile(p: float, dof: int) -> float:
    low, high = 0.0, 1000.0
    for _ in range(200):
        mid = (low + high) / 2
        low, high = (mid, high) if chi2_cdf(mid, dof) < p else (low, mid)
    return low


def statistics(text: bytes) -> tuple[int, ...]:
    """Words, their code points, symbols, repeated lines, words in repeated 3-word windows, lines, letters, capitals.

    Code points beyond ASCII count as letters; capitals are A-Z.
    """
    words = text.split()
    n = len(words)
    dense = text.translate(None, SPACE)
    chars = len(dense.decode())
    symbols = len(text) - len(text.translate(None, SYMBOLS))
    lines = [x for x in text.split(b"\n") if x.strip()]
    repeated = 0
    if n > 3:
        ids: dict[bytes, int] = {}
        code = np.fromiter((ids.setdefault(w, len(ids)) for w in words), np.int64, n)
        pairs = np.unique(code[:-1] * len(ids) + code[1:], return_inverse=True)[1]
        _, back, count = np.unique(pairs[:-1] * len(ids) + code[2:], return_inverse=True, return_counts=True)
        twice = count[back] > 1
        inside = np.zeros(n, bool)
        for k in range(3):
            inside[k : n - 2 + k] |= twice
        repeated = int(inside.sum())
    letters = chars - (len(dense) - len(dense.translate(None, NOT_LETTERS)))
    capitals = len(dense) - len(dense.translate(None, CAPITALS))
    return n, chars, symbols, len(lines) - len(set(lines)), repeated, len(lines), letters, capitals


def measure(docs: DataFrame, keep: dict[str, Column]) -> DataFrame:
    """The kept columns (under names of the caller's), the base statistics, base_failed, and x0..x5 (null without words)."""
    ship(docs.sparkSession)
    source = docs.select(F.col("text").cast("string").alias("text"), *[c.alias(k) for k, c in keep.items()])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            texts = b.column(0).cast(pa.binary()).to_pylist()
            found = np.array([statistics(t or b"") for t in texts], np.int64).reshape(-1, 8)
            n, chars, symbols, dup, rep, lines, letters, capitals = found.T
            with np.errstate(divide="ignore", invalid="ignore"):
                x = [np.log(chars / n), np.sqrt(symbols / chars), np.sqrt(1 - letters / chars), np.sqrt(np.minimum(1, capitals / np.maximum(letters, 1))), np.sqrt(rep / n), np.sqrt(dup / np.maximum(lines, 1))]
            failed = (n < MIN_WORDS) | (100 * rep > MAX_REPEAT_PERCENT * n)
            columns = [pa.array(c) for c in (n, chars, symbols, dup, rep)] + [pa.array(failed)] + [pa.array(c, mask=n == 0) for c in x]
            yield pa.record_batch([*b.columns[1:], *columns], [*b.schema.names[1:], *BASE, "base_failed", *X])
        give_back()

    schema = source.drop("text").schema
    for name in BASE:
        schema = schema.add(name, "long")
    schema = schema.add("base_failed", "boolean")
    for name in X:
        schema = schema.add(name, "double")
    return source.mapInArrow(run, schema)


def _part(c: str) -> Column:
    return F.coalesce(F.concat(F.length(c).cast("string"), F.lit(":"), F.col(c)), F.lit("-"))


def _levels() -> Column:
    """Keys of a row's language and source, of its language, and of all."""
    return F.array(F.concat(F.lit("0"), _part("q_lang"), _part("q_source")), F.concat(F.lit("1"), _part("q_lang")), F.lit("2"))


def distance(prefix: str = "") -> Column:
    """Squared Mahalanobis distance of x0.. from m0.. by the packed inverse p0..."""
    d = [F.col(f"x{i}") - F.col(f"{prefix}m{i}") for i in range(FEATURES)]
    total: Column | None = None
    for at, (i, j) in enumerate(PAIRS):
        term = d[i] * d[j] * F.col(f"{prefix}p{at}") * F.lit(1.0 if i == j else 2.0)
        total = term if total is None else total + term
    assert total is not None
    return total


PARAMETERS = "key string, start int, n long, logdet double, " + ", ".join([*(f"m{i} double" for i in range(FEATURES)), *(f"p{i} double" for i in range(len(PAIRS)))])


def _parameters(key: str, start: int, n: int, centre: np.ndarray, scatter: np.ndarray) -> list:
    inverse = np.linalg.inv(scatter)
    return [key, start, n, float(np.linalg.slogdet(scatter)[1]), *centre, *(inverse[i, j] for i, j in PAIRS)]


def _columns() -> list[str]:
    return [c.split()[0] for c in PARAMETERS.split(", ")]


def _starts(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, n, quantiles: a list of quartiles of each feature) to the two starts."""
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            q = np.array(r.quantiles.tolist(), float).reshape(FEATURES, 3)
            scale = ((q[:, 2] - q[:, 0]) / 1.349) ** 2
            rows.append(_parameters(r.key, 0, r.n, q[:, 1], np.diag(scale + np.square(FLOOR))))
            rows.append(_parameters(r.key, 1, r.n, q[:, 1], np.diag(np.square(FLOOR))))
        yield pd.DataFrame(rows, columns=_columns())


def _estimates(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (key, start, n, h, s0.., c0..) of sums over the kept rows to parameters."""
    consistent = SUBSET / chi2_cdf(chi2_quantile(SUBSET, FEATURES), FEATURES + 2)
    for f in frames:
        rows = []
        for r in f.itertuples(index=False):
            s = np.array([getattr(r, f"s{i}") for i in range(FEATURES)]) / r.h
            c = np.zeros((FEATURES, FEATURES))
            for at, (i, j) in enumerate(PAIRS):
                c[i, j] = c[j, i] = getattr(r, f"c{at}") / r.h - s[i] * s[j]
            c[np.diag_indices(FEATURES)] = np.maximum(c.diagonal(), 0)
            rows.append(_parameters(r.key, r.start, r.n, s, c * consistent + np.diag(np.square(FLOOR))))
        yield pd.DataFrame(rows, columns=_columns())


def fit(measured: DataFrame) -> DataFrame:
    """A row a language and source of measured (q_lang, q_source, base_failed, x0..): its key and parameters."""
    rows = durable(measured.where(~F.col("base_failed")).select(F.explode(_levels()).alias("key"), *X))
    # Quartiles from counts of values cut to thousandths.
    cell = F.posexplode(F.array(*[F.floor(F.col(x) * 1000).cast("long") for x in X])).alias("feature", "bin")
    cells = rows.select("key", cell).groupBy("key", "feature", "bin").count()
    run = W.partitionBy("key", "feature").orderBy("bin")
    whole = W.partitionBy("key", "feature")
    cells = cells.select("key", "feature", "bin", F.sum("count").over(run).alias("upto"), F.sum("count").over(whole).alias("n"))
    quartile = lambda p: (F.min(F.when(F.col("upto") >= F.col("n") * p, F.col("bin"))) + 0.5) / 1000.0
    quartiles = cells.groupBy("key", "feature").agg(F.first("n").alias("n"), F.array(quartile(0.25), quartile(0.5), quartile(0.75)).alias("q"))
    quartiles = quartiles.groupBy("key").agg(F.first("n").alias("n"), F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("feature", "q"))), lambda s: s["q"])).alias("quantiles"))
    now = durable(quartiles.mapInPandas(_starts, PARAMETERS))
    groups = now.count()
    for _ in range(STEPS):
        placed = rows.join(lookup(now, groups), "key").withColumn("bin", F.floor(F.log(distance() + 1e-12) * 1000))
        counts = placed.groupBy("key", "start", "bin").count()
        run = W.partitionBy("key", "start").orderBy("bin")
        upto = counts.select("key", "start", "bin", F.sum("count").over(run).alias("upto"), F.sum("count").over(W.partitionBy("key", "start")).alias("n"))
        cut = durable(upto.where(F.col("upto") >= F.col("n") * SUBSET).groupBy("key", "start").agg(F.min("bin").alias("cut")))
        kept = placed.join(lookup(cut, groups), ["key", "start"]).where(F.col("bin") <= F.col("cut"))
        sums = kept.groupBy("key", "start", "n").agg(
            F.count(F.lit(1)).alias("h"), *[F.sum(x).alias(f"s{i}") for i, x in enumerate(X)], *[F.sum(F.col(X[i]) * F.col(X[j])).alias(f"c{at}") for at, (i, j) in enumerate(PAIRS)]
        )
        following = durable(sums.mapInPandas(_estimates, PARAMETERS))
        remove_scratch(now)
        now = following
    best = now.groupBy("key").agg(F.min_by(F.struct(*now.columns), F.struct("logdet", "start")).alias("e")).select("e.*").drop("start", "logdet")
    best = durable(best)
    found = measured.select(F.concat(F.lit("0"), _part("q_lang"), _part("q_source")).alias("group"), F.explode(_levels()).alias("key")).distinct()
    levels = F.struct(F.col("key"), F.col("n"), F.array(*[f"m{i}" for i in range(FEATURES)]).alias("m"), F.array(*[f"p{i}" for i in range(len(PAIRS))]).alias("p"))
    nested = found.join(lookup(best, groups), "key").groupBy("group").agg(F.sort_array(F.collect_list(levels), asc=False).alias("levels"))
    return durable(nested.mapInPandas(_blended, BLENDED))


BLENDED = "group string, n long, " + ", ".join([*(f"m{i} double" for i in range(FEATURES)), *(f"p{i} double" for i in range(len(PAIRS)))])


def _blended(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """Rows (group, levels: estimates of all rows, of the language, of the group, as far as there are any) to parameters."""
    for f in frames:
        rows = []
        for group, levels in zip(f["group"], f["levels"]):
            centre = scatter = None
            for level in levels:
                n, m, inverse = level["n"], np.array(level["m"], float), np.zeros((FEATURES, FEATURES))
                for at, (i, j) in enumerate(PAIRS):
                    inverse[i, j] = inverse[j, i] = level["p"][at]
                own = np.linalg.inv(inverse)
                share = 1.0 if centre is None else n / (n + PRIOR_ROWS)
                centre = m if centre is None else share * m + (1 - share) * centre
                scatter = own if scatter is None else share * own + (1 - share) * scatter
            rows.append([group, *_parameters("", 0, int(n), centre, scatter)[2:3], *_parameters("", 0, 0, centre, scatter)[4:]])
        yield pd.DataFrame(rows, columns=[c.split()[0] for c in BLENDED.split(", ")])


def judge(measured: DataFrame, parameters: DataFrame) -> DataFrame:
    """measured with distance2 (null without an estimate) and kept."""
    near = lookup(parameters.drop("n").withColumnRenamed("group", "p_group"))
    joined = measured.withColumn("group", F.concat(F.lit("0"), _part("q_lang"), _part("q_source"))).join(near, F.col("group") == F.col("p_group"), "left")
    d2 = distance()
    judged = joined.withColumn("distance2", d2).withColumn("kept", ~F.col("base_failed") & F.coalesce(F.col("distance2") <= chi2_quantile(CONFIDENCE, FEATURES), F.lit(True)))
    return judged.drop("group", "p_group", *parameters.drop("group", "n").columns)



def _keyed(docs: DataFrame, extra: dict[str, Column]) -> dict[str, Column]:
    return {"q_lang": docs["lang"].cast("string"), "q_source": docs["source"].cast("string"), **extra}


def rules(docs: DataFrame) -> DataFrame:
    """docs (doc_id, text, lang, source) to doc_id, the base statistics, base_failed, kept, distance2."""
    measured = durable(measure(docs, _keyed(docs, {"doc_id": docs["doc_id"]})))
    return judge(measured, fit(measured)).select("doc_id", *BASE, "base_failed", "kept", "distance2")


def kept_documents(docs: DataFrame) -> DataFrame:
    """The rows of docs that the rules keep, with all their columns; texts are measured twice and never shuffled."""
    narrow = durable(measure(docs, _keyed(docs, {})))
    parameters = fit(narrow)
    whole = measure(docs, _keyed(docs, {"q_doc": F.struct(*docs.columns)}))
    return judge(whole, parameters).where("kept").select("q_doc.*")
