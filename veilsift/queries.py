"""The core queries over the driver's tables, each with DuckDB SQL where SQL can say the same."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from . import fixed as X
from . import oracle as S
from .corpus import corpus, corpus_sql
from .functions import info
from .functions import text as T
from .operators import baseline as B
from .operators import findings as O
from .operators import fusion, history, lexer, paths, patterns
from .operators.order import positions
from .plans.detect import Options, detect, prepare
from .rules import RULES, registry, rule_table

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE_SQL: dict[str, str] = {}
KEY = b"a key for tests only"


def query(sql: str | None = None, name: str | None = None) -> Callable[[Query], Query]:
    def add(f: Query) -> Query:
        own = name or f.__name__
        QUERIES[own] = f
        if sql:
            ORACLE_SQL[own] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def values(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(id, v): values of many shapes."""
    return spark.sql(S.values_sql(False), customer=table(spark, sf_dir, "customer"))


def units(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The derived corpus and documents as content units."""
    docs = table(spark, sf_dir, "documents").select((F.col("doc_id") + 1_000_000_000).alias("unit_id"), F.concat(F.lit("documents/"), F.col("doc_id").cast("string")).alias("path"), F.coalesce("text", F.lit("")).alias("text"))
    return corpus(spark, sf_dir).unionByName(docs)


# -- scalar functions over values


def _of_value(name: str, column: Callable[[Column], Column], sql: str) -> None:
    def run(spark: SparkSession, sf_dir: str) -> DataFrame:
        return values(spark, sf_dir).select("id", column(F.col("v")).alias("result"))

    query(f"SELECT id, {sql} AS result FROM ({S.values_sql(True)})", name)(run)


_of_value("value_entropy", lambda v: F.round(info.shannon_entropy(v), 6), f"round({S.entropy('v')}, 6)")
_of_value("value_normalized_entropy", lambda v: F.round(info.normalized_entropy(v), 6), f"round({S.normalized('v')}, 6)")
_of_value("charset_family", info.charset_family, S.charset("v"))
_of_value("charset_characters", lambda v: F.array_join(info.distinct_characters(v), ""), "CASE WHEN v = '' THEN '' ELSE array_to_string(list_sort(list_distinct(string_split(v, ''))), '') END")
_of_value("fingerprint_sha256", info.fingerprint, S.fingerprint("v"))
_of_value("fingerprint_hmac", lambda v: info.fingerprint(v, KEY), S.hmac("v", KEY))
_of_value("is_fingerprint", lambda v: info.is_fingerprint(F.substring(F.sha2(v, 256), 1, F.length(v) % 14)), "regexp_matches(substr(sha256(v), 1, (length(v) % 14)::INT), '^[0-9a-f]{12}$')")
_of_value("mask_policy", lambda v: info.mask(v, 4, 2), "CASE WHEN length(trim(v)) - 6 >= 12 AND NOT regexp_matches(trim(v), '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]') THEN left(trim(v), 4) || '************' || right(trim(v), 2) ELSE '************' END")
_of_value("normalize_keyword", T.normalize_keyword, S.keyword("v"))
_of_value("placeholder_of_token", T.token_placeholder, S.token_placeholder("v"))
_of_value("placeholder_of_match", T.match_placeholder, S.match_placeholder("v"))
_of_value("template_of_token", T.token_template, S.token_template("v"))
_of_value("template_of_match", T.match_template, S.match_template("v"))
_of_value("repetitive_structure", T.repetitive, S.repetitive("v"))
_of_value("non_secret_structure", T.non_secret_structure, S.non_secret("v"))
_of_value("looks_like_hash", T.looks_like_hash, "regexp_matches(v, '^[0-9a-fA-F]+$') AND length(v) IN (32, 40, 64)")
_of_value("prose_gate", lambda v: T.prose_words(v) <= X.MAX_PROSE_WORDS, f"{S.prose_words('v')} <= {X.MAX_PROSE_WORDS}")
_of_value("entropy_gates", lambda v: (F.length(v) >= X.MIN_LENGTH) & (info.shannon_entropy(v) >= X.MIN_ENTROPY) & (info.shannon_entropy(v) <= X.MAX_ENTROPY) & (info.normalized_entropy(v) >= X.MIN_NORMALIZED), f"length(v) >= {X.MIN_LENGTH} AND {S.entropy('v')} >= {X.MIN_ENTROPY} AND {S.entropy('v')} <= {X.MAX_ENTROPY} AND {S.normalized('v')} >= {X.MIN_NORMALIZED}")
_of_value("strip_controls", T.strip_controls, "regexp_replace(v, '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]', '', 'g')")
_of_value("has_controls", T.has_controls, "regexp_matches(v, '[\\p{Cc}\\p{Cf}\\p{Zl}\\p{Zp}]')")
_of_value("sanitize_text", T.sanitize_text, S.sanitize("v"))
_of_value("markdown_escape", T.markdown_escape, S.sanitize("regexp_replace(v, '([|`\\[\\]*_#<>])', '\\\\\\1', 'g')"))


_STRIPPED = r"[\p{Cc}\p{Cf}\p{Zl}\p{Zp}]"
_COVERED = "(({i} >= id % 7 AND {i} < id % 7 + 3) OR ({i} >= id % 5 + 4 AND {i} < id % 5 + 6))"


@query(
    f"SELECT id, regexp_replace(array_to_string(list_transform(range(length(v)), lambda i: CASE WHEN NOT {_COVERED.format(i='i')} THEN substr(v, (i + 1)::INT, 1)"
    f" WHEN i > 0 AND {_COVERED.format(i='(i - 1)')} THEN '' ELSE '{X.REDACTION}' END), ''), '{_STRIPPED}', '', 'g') AS excerpt FROM ({S.values_sql(True)})"
)
def excerpts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Two spans of every value replaced; they may overlap, touch or end beyond the value."""
    span = lambda start, n: F.struct(start.cast("int").alias("start"), (start + n).cast("int").alias("end"))
    spans = F.array(span(F.col("id") % 5 + 4, 2), span(F.col("id") % 7, 3))
    return values(spark, sf_dir).select("id", T.sanitize_excerpt(F.col("v"), spans).alias("excerpt"))


@query(
    "WITH raw AS (SELECT id, regexp_replace('../a' || chr(27) || '\\./' || v || CASE WHEN id % 50 = 0 THEN repeat('/p', 2048) ELSE '' END, '" + _STRIPPED + "', '', 'g') AS p FROM (" + S.values_sql(True) + ")),"
    + " clean AS (SELECT id, p, array_to_string(list_filter(string_split(replace(p, '\\', '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/') AS c FROM raw)"
    + f" SELECT id, CASE WHEN length(p) <= {X.MAX_PATH} AND c <> '' THEN c END AS path FROM clean"
)
def report_paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Paths with an escape, '..', a backslash, and some too long to report."""
    raw = F.concat(F.lit("../a\x1b\\./"), F.col("v"), F.when(F.col("id") % 50 == 0, F.repeat(F.lit("/p"), 2048)).otherwise(F.lit("")))
    return values(spark, sf_dir).select("id", paths.report_path(raw).alias("path"))


@query("SELECT array_to_string(list_sort(list(DISTINCT CASE o_orderkey % 4 WHEN 0 THEN 'binary' WHEN 1 THEN 'vanished' WHEN 2 THEN 'too-large' ELSE 'unknown' END)), ',') AS codes FROM orders")
def error_codes(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("o_orderkey") % 4
    errors = table(spark, sf_dir, "orders").select(F.when(k == 0, "binary").when(k == 1, "vanished").when(k == 2, "too-large").alias("code"))
    return O.error_codes(errors).select(F.array_join("codes", ",").alias("codes"))

_of_value("credential_terms", lambda v: T.keyword_score(F.concat(F.lit("api_key access-token token "), v)), "2")
_of_value("label_rank", lambda v: O.from_label(F.element_at(F.array(F.lit("LOW"), F.lit("High-Confidence"), F.lit("critical"), F.lit("?")), (F.length(v) % 4 + 1).cast("int")), X.SEVERITIES | X.CONFIDENCES), "CASE length(v) % 4 WHEN 0 THEN 1 WHEN 1 THEN 3 WHEN 2 THEN 4 END::INT")


@query(f"SELECT doc_id, round({S.entropy('text')}, 6) AS entropy, round({S.normalized('text')}, 6) AS normalized FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def entropy_by_document(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = F.coalesce("text", F.lit(""))
    return table(spark, sf_dir, "documents").select("doc_id", F.round(info.shannon_entropy(v), 6).alias("entropy"), F.round(info.normalized_entropy(v), 6).alias("normalized"))


# -- lexer


@query(f"SELECT doc_id, len(ls) AS lexemes, coalesce(length(array_to_string(ls, '')), 0) AS characters FROM (SELECT doc_id, regexp_extract_all(coalesce(text, ''), {S.q(S.re2(X.TILE))}) AS ls FROM documents)")
def lexeme_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = T.let(lexer.lexemes(F.coalesce("text", F.lit(""))), lambda a: F.struct(F.size(a).cast("long").alias("lexemes"), F.aggregate(a, F.lit(0).cast("long"), lambda n, x: n + F.length(x)).alias("characters")))
    return table(spark, sf_dir, "documents").select("doc_id", found.alias("f")).select("doc_id", "f.*")


TOKEN_OUT = ["unit_id", "start", "end", "line", "column", "origin"]
_TOKEN_SQL = 'unit_id, "start", "end", line, "column", origin, length(value) AS value_length, substr(sha256(value), 1, 12) AS value_fingerprint'


def _redacted_tokens(df: DataFrame) -> DataFrame:
    return df.select(*TOKEN_OUT, F.length("value").alias("value_length"), info.fingerprint(F.col("value")).alias("value_fingerprint"))


@query(f"WITH u AS ({corpus_sql(True)}), {S.tokens_cte('u')} SELECT {_TOKEN_SQL} FROM tk")
def raw_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted_tokens(lexer.raw_tokens(corpus(spark, sf_dir)))


@query(
    f"WITH u AS ({corpus_sql(True)}), {S.tokens_cte('u')} SELECT {_TOKEN_SQL} FROM tk WHERE length(value) <= {X.MAX_TOKEN} AND NOT {S.token_template('value')} AND NOT {S.token_placeholder('value')} AND NOT {S.repetitive('value')} AND NOT {S.non_secret('value')}"
)
def tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted_tokens(lexer.tokens(corpus(spark, sf_dir)))


@query(f"WITH u AS (SELECT page_id AS unit_id, html AS text FROM pages), {S.tokens_cte('u')} SELECT unit_id, count(*) AS tokens, sum(length(value)) AS characters FROM tk GROUP BY unit_id")
def page_tokens(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = lexer.raw_tokens(table(spark, sf_dir, "pages").select(F.col("page_id").alias("unit_id"), F.col("html").alias("text")))
    return raw.groupBy("unit_id").agg(F.count(F.lit(1)).alias("tokens"), F.sum(F.length("value")).alias("characters"))


@query(f"WITH u AS ({corpus_sql(True)} UNION ALL SELECT doc_id + 1000000000, '', text FROM documents), {S.candidates_cte('u')} SELECT {_TOKEN_SQL}, round(entropy, 6) AS entropy FROM ca")
def entropy_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = lexer.entropy_candidates(units(spark, sf_dir).select("unit_id", "text"))
    return found.select(*TOKEN_OUT, F.length("value").alias("value_length"), info.fingerprint(F.col("value")).alias("value_fingerprint"), F.round("entropy", 6).alias("entropy"))


FINDING_OUT = ["rule_id", "category", "severity", "confidence", "detector", "path", "line", "column", "masked_value", "value_length", "value_fingerprint", "entropy", "matched_keywords", "remediation"]


def _rounded(df: DataFrame) -> DataFrame:
    return df.withColumn("entropy", F.round("entropy", 6)).withColumn("matched_keywords", F.array_join("matched_keywords", ",")).select(*FINDING_OUT)


_FI_OUT = "rule_id, category, severity, confidence, detector, path, line, \"column\", masked_value, value_length, value_fingerprint, entropy, coalesce(array_to_string(matched_keywords, ','), '') AS matched_keywords, remediation"


@query(f"WITH u AS (SELECT doc_id AS unit_id, coalesce(text, '') AS text FROM documents), {S.candidates_cte('u')} SELECT 'documents/' || unit_id AS path, line, \"column\", length(value) AS value_length, substr(sha256(value), 1, 12) AS value_fingerprint FROM ca QUALIFY row_number() OVER (PARTITION BY unit_id, line, \"column\", value ORDER BY \"start\") = 1")
def entropy_findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = units(spark, sf_dir).where(F.col("path").startswith("documents/"))
    return detect(docs, RULES, Options(detectors=("entropy",))).select("path", "line", "column", "value_length", "value_fingerprint")


# -- patterns


@query(f"WITH u AS ({corpus_sql(True)}), {S.spans_cte('u')} SELECT unit_id, rule_id, \"start\", \"end\", {S.LINE} AS line, {S.COLUMN} AS \"column\", length(value) AS value_length FROM sp")
def pattern_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    raw = patterns.raw_matches(corpus(spark, sf_dir))
    return raw.select("unit_id", "rule_id", "start", "end", T.line_of(F.col("text"), F.col("start")).alias("line"), T.column_of(F.col("text"), F.col("start")).alias("column"), F.length("value").alias("value_length"))


_MATCH_SQL = "unit_id, rule_id, \"start\", \"end\", line, \"column\", round(entropy, 6) AS entropy, coalesce(array_to_string(keywords, ','), '') AS keywords, assignment_name, confidence"


def _redacted_matches(df: DataFrame) -> DataFrame:
    return df.select("unit_id", "rule_id", "start", "end", "line", "column", F.round("entropy", 6).alias("entropy"), F.array_join("keywords", ",").alias("keywords"), "assignment_name", "confidence")


@query(f"WITH u AS ({corpus_sql(True)}), {S.matches_cte('u')} SELECT {_MATCH_SQL} FROM ma")
def pattern_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _redacted_matches(patterns.matches(corpus(spark, sf_dir)))


for _rule in RULES:

    def _one_rule(spark: SparkSession, sf_dir: str, rule=_rule) -> DataFrame:
        return _redacted_matches(patterns.matches(corpus(spark, sf_dir), (rule,)))

    query(f"WITH u AS ({corpus_sql(True)}), {S.matches_cte('u', (_rule,))} SELECT {_MATCH_SQL} FROM ma", f"pattern_{_rule.rule_id.replace('-', '_')}")(_one_rule)


# -- fusion and findings


def _sides(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    text = corpus(spark, sf_dir).select("unit_id", "text")
    return patterns.matches(text), lexer.entropy_candidates(text)


_PAIRS = f"WITH u AS ({corpus_sql(True)}), {S.fused_cte('u')}"


@query(f"{_PAIRS} SELECT unit_id, rule_id AS p_rule, ps AS p_start, pe AS p_end, cs AS c_start, ce AS c_end FROM pr")
def fusion_overlap(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, candidates = _sides(spark, sf_dir)
    return fusion.overlaps(fusion.best_patterns(found), candidates).drop("p_value")


@query(f"{_PAIRS} SELECT unit_id, cs AS c_start, ce AS c_end, count(*) AS patterns FROM pr GROUP BY ALL HAVING count(*) >= 2")
def multi_secret_literal(spark: SparkSession, sf_dir: str) -> DataFrame:
    found, candidates = _sides(spark, sf_dir)
    return fusion.overlaps(fusion.best_patterns(found), candidates).groupBy("unit_id", "c_start", "c_end").agg(F.count(F.lit(1)).alias("patterns")).where("patterns >= 2")


_MERGED = ["unit_id", "rule_id", "start", "end", "line", "column", "confidence", "severity", "detector"]
_MERGED_SQL = 'unit_id, rule_id, "start", "end", line, "column", confidence, severity, detector'


@query(f"{_PAIRS} SELECT {_MERGED_SQL} FROM mg")
def fusion_merged(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(*_sides(spark, sf_dir)).select(*_MERGED)


@query(f"{_PAIRS} SELECT {_MERGED_SQL} FROM mg")
def fusion_merged_by_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse_by_join(*_sides(spark, sf_dir)).select(*_MERGED)


@query(f"{_PAIRS} SELECT unit_id, rule_id, \"start\", \"end\", 'pattern' AS detector FROM ma UNION ALL SELECT unit_id, 'high-entropy-string', \"start\", \"end\", 'entropy' FROM ca")
def unfused_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.unfused(*_sides(spark, sf_dir)).select("unit_id", "rule_id", "start", "end", "detector")


@query(f"{_PAIRS} SELECT unit_id, rule_id, \"start\", \"end\", confidence FROM pa")
def drop_duplicate_patterns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.best_patterns(_sides(spark, sf_dir)[0]).select("unit_id", "rule_id", "start", "end", "confidence")


def found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings of the derived corpus and of documents."""
    return detect(units(spark, sf_dir))


@query(f"{S.findings_cte()} SELECT {_FI_OUT} FROM fi")
def findings(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(found(spark, sf_dir))


def _dim(labels: dict[str, int], name: str) -> str:
    return f"(VALUES {', '.join(f'({S.q(k)}, {v}::INT)' for k, v in labels.items())}) AS dim({name}_label, {name})"


for _name, _labels in (("severity", X.SEVERITIES), ("confidence", X.CONFIDENCES)):

    def _counted(spark: SparkSession, sf_dir: str, name=_name, labels=_labels) -> DataFrame:
        return O.count_by(found(spark, sf_dir), name, labels)

    query(f"{S.findings_cte()} SELECT {_name}_label, {_name}, count(fi.rule_id) AS findings FROM {_dim(_labels, _name)} LEFT JOIN fi USING ({_name}) GROUP BY ALL", f"count_by_{_name}")(_counted)


@query(f"{S.findings_cte()} SELECT category, count(*) AS findings FROM fi GROUP BY category")
def count_by_category(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.count_by_category(found(spark, sf_dir))


_DETECTORS = ("pattern", "entropy", "composite")


@query(f"{S.findings_cte()} SELECT severity_label, severity, d.detector, count(fi.rule_id) AS findings FROM {_dim(X.SEVERITIES, 'severity')} CROSS JOIN (VALUES ('pattern'), ('entropy'), ('composite')) AS d(detector) LEFT JOIN fi USING (severity, detector) GROUP BY ALL")
def severity_by_detector(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Findings by severity and detector, every pair present."""
    dim = spark.createDataFrame([(k, v, d) for k, v in X.SEVERITIES.items() for d in _DETECTORS], "severity_label string, severity int, detector string")
    counts = found(spark, sf_dir).groupBy("severity", "detector").agg(F.count(F.lit(1)).alias("findings"))
    return F.broadcast(dim).join(counts, ["severity", "detector"], "left").select("severity_label", "severity", "detector", F.coalesce("findings", F.lit(0)).alias("findings"))


_COUNTS = ", ".join([f"count(*) FILTER (WHERE severity = {v}) AS severity_{k}" for k, v in X.SEVERITIES.items()] + [f"count(*) FILTER (WHERE confidence = {v}) AS confidence_{k}" for k, v in X.CONFIDENCES.items()])


@query(f"{S.findings_cte()} SELECT count(*) AS findings, count(DISTINCT rule_id || ' ' || value_fingerprint) AS distinct_secrets, max(severity) AS highest_severity, {_COUNTS} FROM fi")
def summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return O.summary(found(spark, sf_dir))


_LABEL = " ".join(f"WHEN {v} THEN '{k}'" for k, v in X.SEVERITIES.items())


@query(
    f"{S.findings_cte()}, er AS (SELECT count(*) FILTER (WHERE o_orderkey % 3 = 0) AS error_count, count(*) AS files_scanned, sum(o_orderkey)::BIGINT AS bytes_scanned FROM orders)"
    " SELECT (SELECT count(*) FROM fi) AS total_findings, (SELECT count(DISTINCT rule_id || ' ' || value_fingerprint) FROM fi) AS distinct_secrets,"
    f" (SELECT CASE max(severity) {_LABEL} END FROM fi) AS highest_severity, coalesce((SELECT string_agg(category || '=' || n, ',' ORDER BY category) FROM (SELECT category, count(*) AS n FROM fi GROUP BY 1)), '') AS by_category,"
    f" (SELECT concat_ws(',', {', '.join(f'count(*) FILTER (WHERE severity = {v})' for v in X.SEVERITIES.values())}) FROM fi) AS by_severity,"
    f" (SELECT concat_ws(',', {', '.join(f'count(*) FILTER (WHERE confidence = {v})' for v in X.CONFIDENCES.values())}) FROM fi) AS by_confidence, er.* FROM er"
)
def summary_block(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What a report sums up, its maps as text."""
    orders = table(spark, sf_dir, "orders")
    errors = orders.where(F.col("o_orderkey") % 3 == 0).select(F.lit("p").alias("path"), F.lit("binary").alias("code"), F.lit("r").alias("reason"))
    totals = orders.agg(F.count(F.lit(1)).alias("files_scanned"), F.sum("o_orderkey").cast("long").alias("bytes_scanned"))
    block = O.summary_block(found(spark, sf_dir), errors, totals)
    shown = lambda name, keys: F.concat_ws(",", *(F.col(name)[k].cast("string") for k in keys)).alias(name)
    pairs = F.array_join(F.transform(F.map_entries("by_category"), lambda e: F.concat(e["key"], F.lit("="), e["value"].cast("string"))), ",")
    return block.select("total_findings", "distinct_secrets", "highest_severity", pairs.alias("by_category"), shown("by_severity", X.SEVERITIES), shown("by_confidence", X.CONFIDENCES), "files_scanned", "bytes_scanned", "error_count")


@query(f"{S.findings_cte()} SELECT {_FI_OUT} FROM fi WHERE confidence >= 3")
def min_confidence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _rounded(found(spark, sf_dir).where("confidence >= 3"))


@query(f"{S.findings_cte()} SELECT fail_on, CASE WHEN (SELECT max(severity) FROM fi) >= fail_on THEN 1 ELSE 0 END AS exit_code FROM (VALUES (1), (4)) AS t(fail_on)")
def exit_code(spark: SparkSession, sf_dir: str) -> DataFrame:
    none = spark.createDataFrame([], "path string, code string, reason string")
    rows = found(spark, sf_dir)
    return O.exit_code(rows, none, 1).select(F.lit(1).alias("fail_on"), "exit_code").unionByName(O.exit_code(rows, none, 4).select(F.lit(4).alias("fail_on"), "exit_code"))


@query(f"{S.findings_cte()} SELECT path, line, \"column\", rule_id, row_number() OVER (ORDER BY path, coalesce(line, 0), coalesce(\"column\", 0), rule_id, value_fingerprint) AS position FROM fi")
def canonical_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Positions in the report's order, numbered range by range."""
    rows = found(spark, sf_dir).select("path", "line", "column", "rule_id", "value_fingerprint")
    return positions(rows, O.order_columns()).drop("value_fingerprint")


@query(f"{S.findings_cte()} SELECT path || ':' || line || ':' || \"column\" AS location, rule_id FROM fi")
def location_display(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select(T.location(F.col("path"), F.col("line"), F.col("column"), F.col("commit")).alias("location"), "rule_id")


@query(f"{S.findings_cte()} SELECT rule_id, dense_rank() OVER (ORDER BY rule_id) - 1 AS rule_index FROM (SELECT DISTINCT rule_id FROM fi)")
def sarif_rule_index(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).select("rule_id").distinct().select("rule_id", (F.dense_rank().over(W.orderBy("rule_id")) - 1).cast("long").alias("rule_index"))


@query(
    f"{S.findings_cte()} SELECT rule_id, CASE WHEN severity >= 3 THEN 'error' WHEN severity = 2 THEN 'warning' ELSE 'note' END AS level, CASE confidence WHEN 4 THEN 100.0 WHEN 3 THEN 90.0 WHEN 2 THEN 60.0 ELSE 30.0 END::DOUBLE AS rank, count(*) AS findings FROM fi GROUP BY ALL"
)
def sarif_level_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    level, rank = F.lit(None).cast("string"), F.lit(None).cast("double")
    for k, v in X.SEVERITIES.items():
        level = F.when(F.col("severity") == v, X.SARIF_LEVEL[k]).otherwise(level)
    for k, v in X.CONFIDENCES.items():
        rank = F.when(F.col("confidence") == v, X.SARIF_RANK[k]).otherwise(rank)
    return found(spark, sf_dir).groupBy("rule_id", level.alias("level"), rank.alias("rank")).agg(F.count(F.lit(1)).alias("findings"))


@query(f"{S.findings_cte()} SELECT rule_id, remediation, count(*) AS findings, min(path) AS first_path FROM fi GROUP BY ALL")
def remediation_once(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).groupBy("rule_id", "remediation").agg(F.count(F.lit(1)).alias("findings"), F.min("path").alias("first_path"))


# -- baseline: every third unit's findings are known, and one that is gone for each severity


def _baseline(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    now = found(spark, sf_dir).select(*B.IDENTITY, "category", "severity", "confidence")
    number = F.regexp_extract("path", r"(\d+)$", 1).cast("long")
    place = F.when(number % 3 == 0, F.col("path")).when(number % 3 == 1, F.concat(F.lit("gone/"), "path"))
    # no filter goes below `once`, so both sides ask for the same findings, and Spark looks for them once
    known = T.once(now, place=place).where("place IS NOT NULL").withColumn("path", F.col("place")).select(now.columns)
    return now, known


_BASELINE = (
    f"{S.findings_cte()}, kn AS (SELECT rule_id, path, line, \"column\", value_fingerprint FROM fi WHERE regexp_extract(path, '(\\d+)$', 1)::BIGINT % 3 = 0 UNION ALL SELECT rule_id, 'gone/' || path, line, \"column\", value_fingerprint FROM fi WHERE regexp_extract(path, '(\\d+)$', 1)::BIGINT % 3 = 1),"
    ' cl AS (SELECT DISTINCT rule_id, path, line, "column", value_fingerprint, CASE WHEN k IS NULL THEN \'new\' WHEN f IS NULL THEN \'stale\' ELSE \'baselined\' END AS classification FROM (SELECT *, 1 AS f FROM (SELECT rule_id, path, line, "column", value_fingerprint FROM fi)) FULL JOIN (SELECT *, 1 AS k FROM kn) USING (rule_id, path, line, "column", value_fingerprint))'
)


@query(f"{_BASELINE} SELECT * FROM cl")
def baseline_classes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify(*_baseline(spark, sf_dir)).drop("commit")


@query(f"{_BASELINE} SELECT classification, count(*) AS findings FROM cl GROUP BY ALL")
def baseline_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.classify(*_baseline(spark, sf_dir)).groupBy("classification").agg(F.count(F.lit(1)).alias("findings"))


@query(f"{_BASELINE} SELECT rule_id, path, line, \"column\", value_fingerprint FROM cl WHERE classification = 'new'")
def baseline_new(spark: SparkSession, sf_dir: str) -> DataFrame:
    now, known = _baseline(spark, sf_dir)
    return B.only_new(now, known).select("rule_id", "path", "line", "column", "value_fingerprint")


@query(f"{_BASELINE} SELECT rule_id, path, line, \"column\", value_fingerprint FROM cl")
def baseline_updated(spark: SparkSession, sf_dir: str) -> DataFrame:
    return B.updated(*_baseline(spark, sf_dir)).select("rule_id", "path", "line", "column", "value_fingerprint")


_DISABLED = ("stripe-test-key", "aws-access-key-id")


@query(f"WITH {S.rule_values()} SELECT rule_id, priority, row_number() OVER (ORDER BY priority, rule_id) AS position FROM ru WHERE rule_id NOT IN {_DISABLED}")
def rules_disabled(spark: SparkSession, sf_dir: str) -> DataFrame:
    off = spark.createDataFrame([(d,) for d in _DISABLED], "rule_id string")
    return rule_table(spark, registry()).join(F.broadcast(off), "rule_id", "left_anti").select("rule_id", "priority", F.row_number().over(W.orderBy("priority", "rule_id")).cast("long").alias("position"))


@query(f"WITH {S.rule_values()} SELECT rule_id, category, severity, len(keys) AS keywords FROM ru UNION ALL SELECT 'high-entropy-string', 'unknown', 2, 0")
def rule_catalog(spark: SparkSession, sf_dir: str) -> DataFrame:
    own = spark.createDataFrame([(X.ENTROPY_RULE, "unknown", 2, 0)], "rule_id string, category string, severity int, keywords int")
    return rule_table(spark).select("rule_id", "category", "severity", F.size("keywords").alias("keywords")).unionByName(own).withColumn("keywords", F.col("keywords").cast("long"))


# -- history, shaped from lineitem: an order is a commit, a part a blob, a supplier a path


def _refs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "lineitem").select(
        (F.lit(10**12) - F.col("l_orderkey") * 10 + F.col("l_linenumber")).alias("walk_seq"), F.sha1(F.col("l_orderkey").cast("string")).alias("commit"), F.col("l_orderkey").alias("commit_time"), F.concat(F.lit("src/s"), (F.col("l_suppkey") % 7).cast("string"), F.lit(".txt")).alias("path"), F.concat(F.lit("o"), F.col("l_partkey").cast("string")).alias("object_name"),
    )


_REFS = "WITH re AS (SELECT 1000000000000 - l_orderkey * 10 + l_linenumber AS walk_seq, l_orderkey AS ck, l_orderkey AS commit_time, 'src/s' || (l_suppkey % 7) || '.txt' AS path, 'o' || l_partkey AS object_name FROM lineitem)"


@query(f"{_REFS} SELECT object_name, count(*) AS occurrences FROM re GROUP BY ALL")
def blob_occurrences(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.occurrences(_refs(spark, sf_dir))


@query(f"{_REFS} SELECT object_name, path, arg_min(commit_time, walk_seq) AS commit_time, min(walk_seq) AS walk_seq, count(*) AS occurrences FROM re GROUP BY object_name, path")
def blob_newest_ref(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.blob_paths(_refs(spark, sf_dir)).drop("commit")


_OBJECTS = "SELECT 'o' || p_partkey AS object_name, CASE WHEN p_size % 10 = 0 THEN 'tree' ELSE 'blob' END AS kind, p_size * 1000 AS size FROM part WHERE p_partkey % 11 <> 0"


def _objects(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "part").where("p_partkey % 11 <> 0").select(F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("object_name"), F.when(F.col("p_size") % 10 == 0, "tree").otherwise("blob").alias("kind"), (F.col("p_size") * 1000).alias("size"))


@query(f"{_REFS}, ob AS ({_OBJECTS}) SELECT CASE WHEN kind IS NULL THEN 'missing' WHEN kind <> 'blob' THEN 'not-a-blob' WHEN size > 40000 THEN 'too-large' ELSE 'readable' END AS status, count(*) AS blobs FROM (SELECT DISTINCT object_name FROM re) LEFT JOIN ob USING (object_name) GROUP BY ALL")
def blob_status_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.blob_status(_refs(spark, sf_dir), _objects(spark, sf_dir), 40_000).groupBy("status").agg(F.count(F.lit(1)).alias("blobs"))


@query(f"{_REFS}, pt AS (SELECT object_name, path, arg_min(commit_time, walk_seq) AS commit_time FROM re GROUP BY ALL) SELECT object_name, 'r' AS rule_id, path, commit_time FROM (SELECT 'o' || p_partkey AS object_name FROM part WHERE p_size > 45) JOIN pt USING (object_name)")
def blob_fanout(spark: SparkSession, sf_dir: str) -> DataFrame:
    hits = table(spark, sf_dir, "part").where("p_size > 45").select(F.concat(F.lit("o"), F.col("p_partkey").cast("string")).alias("object_name"), F.lit("r").alias("rule_id"), F.lit("").alias("path"))
    return history.fan_out(hits, history.blob_paths(_refs(spark, sf_dir))).drop("commit")


_CUT = ", co AS (SELECT ck, row_number() OVER (ORDER BY min(walk_seq)) AS k FROM re GROUP BY ck)"


@query(f"{_REFS}{_CUT} SELECT count(*) AS refs, count(DISTINCT ck) AS commits, (SELECT max(k) FROM co) > 100 AS truncated FROM re JOIN co USING (ck) WHERE k <= 100")
def max_commits(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept, cut = history.first_commits(_refs(spark, sf_dir), 100)
    return kept.agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("commit").alias("commits")).join(cut)


@query(f"{_REFS}, bo AS (SELECT object_name, row_number() OVER (ORDER BY min(walk_seq), object_name) AS k FROM re GROUP BY object_name) SELECT object_name, count(*) AS refs FROM re JOIN bo USING (object_name) WHERE k <= 50 GROUP BY ALL")
def max_blobs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return history.first_blobs(_refs(spark, sf_dir), 50).groupBy("object_name").agg(F.count(F.lit(1)).alias("refs"))


@query(f"{_REFS} SELECT count(*) AS refs, count(DISTINCT ck) AS commits, count(DISTINCT path) AS paths, count(DISTINCT object_name) AS blobs FROM re WHERE commit_time BETWEEN 100 AND 900")
def commit_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _refs(spark, sf_dir).where(F.col("commit_time").between(100, 900)).agg(F.count(F.lit(1)).alias("refs"), F.count_distinct("commit").alias("commits"), F.count_distinct("path").alias("paths"), F.count_distinct("object_name").alias("blobs"))


# -- paths, shaped from part

_PATH_TEMPLATES = ("'src/m' || k || '.py'", "'.git/objects/' || k", "'a/node_modules/b/' || k || '.js'", "'img/' || k || '.PNG'", "'./a/../b//c' || k || '.txt'", "'docs/.DS_Store'", "'vendor/x/' || k || '.go'", "'pkg.egg-info/' || k", "'.env'", "'d1/d2/d3/d4/d5/' || k || '.cfg'", "'build' || chr(92) || 'w' || k || '.ini'", "'..'")


def _paths_sql(duckdb: bool) -> str:
    kind = "VARCHAR" if duckdb else "STRING"
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_PATH_TEMPLATES))
    return f"SELECT id, size, CASE id % {len(_PATH_TEMPLATES)} {cases} END AS path FROM (SELECT p_partkey AS id, p_size AS size, CAST(p_partkey AS {kind}) AS k FROM {'part' if duckdb else '{part}'})"


def _paths(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_paths_sql(False), part=table(spark, sf_dir, "part"))


_NORM = "array_to_string(list_filter(string_split(replace(path, chr(92), '/'), '/'), lambda s: s NOT IN ('', '.', '..')), '/')"
_EXT = "lower(regexp_extract(name, '^.+([.][^./]+)$', 1))"
_in = lambda xs: "(" + ", ".join(map(S.q, xs)) + ")"
_DIR = f"len(list_filter(string_split(p, '/')[1:-2], lambda d: d IN {_in(X.IGNORED_DIRECTORIES)} OR ends_with(d, '.egg-info') OR ends_with(d, '.dist-info'))) > 0"
_DECISION = f"CASE WHEN p = 'vendor' OR starts_with(p, 'vendor/') THEN 'ignored-path' WHEN {_DIR} THEN 'ignored-directory' WHEN name IN {_in(X.IGNORED_FILENAMES)} THEN 'ignored-filename' WHEN {_EXT} IN {_in(X.IGNORED_EXTENSIONS)} THEN 'ignored-extension' END"
_PATHS = f"WITH pa AS (SELECT *, coalesce({_NORM}, '') AS p, coalesce(string_split({_NORM}, '/')[-1], '') AS name FROM ({_paths_sql(True)}))"


@query(f"{_PATHS} SELECT id, p AS normalized, {_EXT} AS extension, length(p) - length(replace(p, '/', '')) AS depth FROM pa")
def path_normalize(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.normalize(F.col("path"))
    return _paths(spark, sf_dir).select("id", p.alias("normalized"), paths.extension(F.element_at(F.split(p, "/"), -1)).alias("extension"), (F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit("")))).cast("long").alias("depth"))


@query(f"{_PATHS} SELECT id, {_DECISION} AS skip_reason FROM pa")
def path_decision(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _paths(spark, sf_dir).select("id", paths.skip_reason_with_parents(F.col("path"), ignored_paths=("vendor",)).alias("skip_reason"))


@query(f"{_PATHS} SELECT {_DECISION} AS skip_reason, count(*) AS files, sum(size) AS bytes FROM pa GROUP BY ALL")
def skip_reason_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    reason = paths.skip_reason_with_parents(F.col("path"), ignored_paths=("vendor",))
    return _paths(spark, sf_dir).groupBy(reason.alias("skip_reason")).agg(F.count(F.lit(1)).alias("files"), F.sum("size").alias("bytes"))


@query(f"{_PATHS} SELECT id FROM pa WHERE length(p) - length(replace(p, '/', '')) <= 2 AND size <= 30")
def depth_and_size_limit(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = paths.normalize(F.col("path"))
    return _paths(spark, sf_dir).where((F.length(p) - F.length(F.replace(p, F.lit("/"), F.lit(""))) <= 2) & (F.col("size") <= 30)).select("id")


@query(f"SELECT id FROM ({_paths_sql(True)}) ORDER BY id LIMIT 100")
def max_files(spark: SparkSession, sf_dir: str) -> DataFrame:
    return paths.first_files(_paths(spark, sf_dir).withColumn("traversal", F.col("id")), 100).select("id")


@query(
    "SELECT doc_id, verdict, CASE WHEN verdict IN ('nul-byte', 'control-heavy') THEN 'binary' WHEN verdict = 'undecodable' THEN 'invalid-encoding' END AS code FROM (SELECT doc_id, "
    f"CASE WHEN doc_id % 5 = 0 AND strlen(coalesce(text, '')) < {X.SNIFF_BYTES} THEN 'nul-byte' WHEN doc_id % 5 = 1 THEN 'undecodable' WHEN doc_id % 5 = 2 THEN 'control-heavy' ELSE 'text' END AS verdict FROM documents)"
)
def binary_verdict(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Verdicts on texts and on spoiled ones. SQL has no UTF-8 check, but knows how each text was spoiled."""
    docs = table(spark, sf_dir, "documents")
    raw = F.encode(F.coalesce("text", F.lit("")), "UTF-8")
    spoiled = F.when(F.col("doc_id") % 5 == 0, F.concat(raw, F.lit(b"\x00"))).when(F.col("doc_id") % 5 == 1, F.concat(F.lit(b"\xff\xfe"), raw)).when(F.col("doc_id") % 5 == 2, F.concat(F.repeat(F.lit("\x01"), 9000).cast("binary"), raw)).otherwise(raw)
    return docs.select("doc_id", paths.verdict(spoiled).alias("verdict")).withColumn("code", paths.error_code(F.col("verdict")))


# -- lines and spans


@query("SELECT doc_id, len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 500)) AS long_lines, length(array_to_string(list_transform(string_split(text, chr(10)), lambda l: left(l, 500)), chr(10))) AS kept FROM (SELECT doc_id, coalesce(text, '') AS text FROM documents)")
def line_cap(spark: SparkSession, sf_dir: str) -> DataFrame:
    lines = F.split(F.coalesce("text", F.lit("")), "\n")
    return table(spark, sf_dir, "documents").select("doc_id", F.size(F.filter(lines, lambda x: F.length(x) > 500)).cast("long").alias("long_lines"), F.length(F.array_join(F.transform(lines, lambda x: F.substr(x, F.lit(1), F.lit(500))), "\n")).cast("long").alias("kept"))


_SPANS = "SELECT DISTINCT l_orderkey AS id, l_linenumber * 7 % 40 AS \"start\", l_linenumber * 7 % 40 + l_quantity::INT % 9 AS \"end\" FROM lineitem"


@query(
    f"""WITH s AS ({_SPANS}), k AS (SELECT *, max("end") OVER (PARTITION BY id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS b FROM s WHERE "end" > "start"),
    i AS (SELECT *, sum(CASE WHEN b IS NULL OR "start" > b THEN 1 ELSE 0 END) OVER (PARTITION BY id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS g FROM k) SELECT id, min("start") AS "start", max("end") AS "end" FROM i GROUP BY id, g"""
)
def merge_spans(spark: SparkSession, sf_dir: str) -> DataFrame:
    start = F.col("l_linenumber") * 7 % 40
    spans = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("id"), start.alias("start"), (start + F.col("l_quantity").cast("int") % 9).alias("end"))
    return history.merge_spans(spans, "id")


@query(f"WITH u AS ({corpus_sql(True)}), {S.fused_cte('u')}, ln AS (SELECT unit_id, line, count(*) AS hits FROM mg GROUP BY ALL) SELECT unit_id, line, hits FROM ln")
def findings_by_line(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(*_sides(spark, sf_dir)).groupBy("unit_id", "line").agg(F.count(F.lit(1)).alias("hits"))


@query("SELECT unit_id, regexp_extract(lt, '[^=:]*') AS head FROM (SELECT o_orderkey AS unit_id, 'name' || (o_orderkey % 9) || ' = value' AS lt FROM orders)")
def line_heads(spark: SparkSession, sf_dir: str) -> DataFrame:
    line = F.concat(F.lit("name"), (F.col("o_orderkey") % 9).cast("string"), F.lit(" = value"))
    return table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("unit_id"), F.regexp_extract(line, "[^=:]*", 0).alias("head"))


_NAME_LINES = ("'password = ' || q", "'  \"api_key\": ' || q", "'os.environ[' || q || 'TOKEN' || q || '] = ' || q", "'this.password := '", "'a => b => '", "'nothing here'", "'x == '")


def _name_sql(duckdb: bool) -> str:
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(_NAME_LINES))
    return f"SELECT id, CASE id % {len(_NAME_LINES)} {cases} END AS line FROM (SELECT o_orderkey AS id, chr(34) AS q FROM {'orders' if duckdb else '{orders}'})"


@query(f"SELECT id, nullif(regexp_extract(line, {S.q(X.ASSIGNED_NAME)}, 1), '') AS name FROM ({_name_sql(True)})")
def assignment_name(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.sql(_name_sql(False), orders=table(spark, sf_dir, "orders")).select("id", T.assignment_name(F.col("line"), F.length("line") + 1).alias("name"))


@query("SELECT time_bucket(INTERVAL 1 HOUR, ts) AS window_start, event_type, count(*) AS events FROM events GROUP BY ALL")
def tumbling_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The batch form of the streaming count."""
    from .streaming.counts import tumbling

    return tumbling(table(spark, sf_dir, "events"))


@query(f"{S.findings_cte()} SELECT category, severity, count(*) AS findings FROM fi GROUP BY ROLLUP (category, severity)")
def findings_rollup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return found(spark, sf_dir).rollup("category", "severity").agg(F.count(F.lit(1)).alias("findings"))


@query("SELECT path, code, reason FROM (SELECT 'documents/' || doc_id AS path, 'line-too-long' AS code, len(list_filter(string_split(text, chr(10)), lambda l: length(l) > 3000)) || ' lines are longer than the entropy screen reads' AS reason, text FROM documents) WHERE NOT starts_with(reason, '0 ')")
def line_errors(spark: SparkSession, sf_dir: str) -> DataFrame:
    from .plans.detect import line_errors as errors

    return errors(prepare(units(spark, sf_dir).where(F.col("path").startswith("documents/"))), 3000)
