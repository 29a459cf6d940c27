"""SQL that DuckDB runs to check the queries: the same semantics, said again in another engine's words."""

from __future__ import annotations

from . import fixed as X
from .corpus import corpus_sql
from .functions.text import any_of
from .rules import RULES, Rule

#: Shapes of values, from hex digests of customer keys; h and g digests, n a line feed, k the key.
VALUE_TEMPLATES = (
    "h",
    "upper(substr(h, 1, 32))",
    "chr(36) || chr(123) || substr(h, 1, 10) || chr(125)",
    "'changeme-' || substr(h, 1, 20)",
    "substr(h, 1, 8) || substr(h, 1, 8)",
    "'aaaaaaaaaaaa'",
    "'module.sub_' || substr(g, 1, 4) || '.Name'",
    "'DEFAULT_' || upper(substr(h, 1, 9))",
    "'github-pat-fine'",
    "'~' || substr(h, 1, 18)",
    "':class:' || substr(h, 1, 18)",
    "'render(x' || substr(h, 1, 12) || ')'",
    "'https://host/' || substr(h, 1, 16)",
    "'https://u:p@host/' || substr(h, 1, 16)",
    "'^' || substr(h, 1, 20) || chr(36)",
    "substr(h, 1, 12) || n || substr(g, 1, 12)",
    "'your key here ' || k",
    "'a test ' || substr(g, 1, 10) || ' of it'",
    "substr(h, 1, 8) || '-' || substr(h, 9, 4) || '-' || substr(h, 13, 12)",
    "'  padded words are prose  '",
    "translate(upper(substr(h, 1, 24)), '0189', 'QRST')",
    "'abcdefghij'",
    "''",
    "'a|b`c[d]*_#<e> ' || chr(7) || ' x' || chr(9) || 'y'",
)


def values_sql(duckdb: bool) -> str:
    """SELECT id, v."""
    kind = "VARCHAR" if duckdb else "STRING"
    sha = (lambda x: f"sha256({x})") if duckdb else (lambda x: f"sha2({x}, 256)")
    cases = " ".join(f"WHEN {i} THEN {t}" for i, t in enumerate(VALUE_TEMPLATES))
    table = "customer" if duckdb else "{customer}"
    return (
        f"SELECT id, CASE id % {len(VALUE_TEMPLATES)} {cases} END AS v FROM (SELECT c_custkey AS id, CAST(c_custkey AS {kind}) AS k, {sha(f'CAST(c_custkey AS {kind})')} AS h, "
        f"{sha(f'CAST(c_custkey AS {kind}) || chr(46)')} AS g, chr(10) AS n FROM {table})"
    )


def q(text: str) -> str:
    return "'" + text.replace("'", "''") + "'"


def re2(pattern: str) -> str:
    """A Java pattern without possessive quantifiers, end marks and large repeat counts."""
    return pattern.replace("++", "+").replace("*+", "*").replace("?+", "?").replace(r"\z", "$").replace("{0,40000}?", "*?")


def matches(value: str, pattern: str) -> str:
    return f"regexp_matches({value}, {q(re2(pattern))})"


# -- value predicates


def trimmed(v: str) -> str:
    return f"regexp_replace({v}, '^\\s+|\\s+$', '', 'g')"


def has_word(low: str, words: tuple[str, ...]) -> str:
    return matches(low, rf"(?:^|[^a-z0-9])(?:{any_of(words)})(?:[^a-z0-9]|$)")


def token_placeholder(v: str) -> str:
    return f"({matches(f'lower({v})', any_of(X.TOKEN_PLACEHOLDER_PARTS))} OR {has_word(f'lower({v})', X.TOKEN_PLACEHOLDER_WORDS)})"


def match_placeholder(v: str) -> str:
    low = f"lower({v})"
    return f"({matches(low, any_of(X.MATCH_PLACEHOLDER_PARTS))} OR {has_word(low, X.MATCH_PLACEHOLDER_WORDS)} OR " + matches(f"regexp_replace({low}, '[-_]+', ' ', 'g')", any_of(X.MATCH_PLACEHOLDER_PHRASES)) + ")"


def token_template(v: str) -> str:
    t = trimmed(v)
    values = ", ".join(map(q, X.TOKEN_TEMPLATE_VALUES))
    return f"({t} IN ({values}) OR " + " OR ".join(f"(starts_with({t}, {q(a)}) AND ends_with({t}, {q(z)}))" for a, z in X.TOKEN_TEMPLATE_PAIRS) + ")"


def match_template(v: str) -> str:
    t = trimmed(v)
    return "(" + " OR ".join(f"(starts_with({t}, {q(a)}) AND ends_with({t}, {q(z)}) AND length({t}) > {len(a) + len(z)})" for a, z in X.MATCH_TEMPLATE_PAIRS) + ")"


def repetitive(v: str) -> str:
    run = lambda by: f"len(list_filter(range(1, length({v})), lambda i: unicode(substr({v}, i + 1, 1)) - unicode(substr({v}, i, 1)) <> {by})) = 0"
    return (
        f"(length({v}) >= 4 AND (len(list_distinct(string_split({v}, ''))) = 1 OR (length({v}) % 2 = 0 AND left({v}, length({v}) // 2) = right({v}, length({v}) // 2)) OR {run(1)} OR {run(-1)}))"
    )


def non_secret(v: str) -> str:
    return (
        f"({matches(v, chr(91) + chr(92) + 'n' + chr(92) + 'r{}]')} OR {matches(v, '^' + X.IDENTIFIER + '(?:[.]' + X.IDENTIFIER + ')+$')} OR ({matches(v, '^' + X.IDENTIFIER + '$')} AND contains({v}, '_')) OR {matches(v, '^' + X.KEBAB + '$')}"
        f" OR starts_with({v}, '~') OR {matches(v, X.ROLE)} OR contains({v}, '(?:') OR contains({v}, '\\') OR (starts_with({v}, '^') AND ends_with({v}, '$') AND length({v}) > 1) OR {matches(v, X.CALL_SHAPE)}"
        f" OR (contains({v}, '://') AND NOT {matches(v, '[@?]')}))"
    )


def prose_words(v: str) -> str:
    return f"len(list_filter(string_split_regex({trimmed(v)}, '\\s+'), lambda w: length(w) >= 2))"


def entropy(v: str) -> str:
    return f"(CASE WHEN {v} = '' THEN 0.0 ELSE list_entropy(string_split({v}, '')) END)"


def normalized(v: str) -> str:
    return f"(CASE WHEN len(list_distinct(string_split({v}, ''))) < 2 OR {v} = '' THEN 0.0 ELSE least(1.0, list_entropy(string_split({v}, '')) / log2(len(list_distinct(string_split({v}, ''))))) END)"


def charset(v: str) -> str:
    return f"CASE WHEN {v} = '' THEN 'empty' WHEN {matches(v, '^[0-9a-fA-F]*$')} THEN 'hex' WHEN {matches(v, '^[A-Z2-7]*$')} THEN 'base32' WHEN {matches(v, '^[A-Za-z0-9_=-]*$')} THEN 'base64' ELSE 'mixed' END"


def fingerprint(v: str) -> str:
    return f"substr(sha256({v}), 1, 12)"


def hmac(v: str, key: bytes) -> str:
    inner, outer = (bytes(b ^ p for b in key.ljust(64, b"\0")).hex() for p in (0x36, 0x5C))
    return f"substr(sha256(from_hex('{outer}') || from_hex(sha256(from_hex('{inner}') || encode({v})))), 1, 12)"


def keyword(v: str) -> str:
    return f"regexp_replace(lower({v}), '[^a-z0-9]+', '', 'g')"


def sanitize(v: str) -> str:
    return f"trim(regexp_replace(regexp_replace({v}, '[\\x00-\\x1f\\x7f-\\x{{9f}}]', ' ', 'g'), '\\s+', ' ', 'g'))"


# -- tokens and candidates

LINE = "1 + length(left(text, \"start\")) - length(replace(left(text, \"start\"), chr(10), ''))"
COLUMN = "length(left(text, \"start\")) - CASE WHEN contains(left(text, \"start\"), chr(10)) THEN length(left(text, \"start\")) - strpos(reverse(left(text, \"start\")), chr(10)) + 1 ELSE 0 END + 1"
LINE_TEXT = "regexp_extract(left(text, \"start\"), '[^\\n]*$') || regexp_extract(substr(text, \"start\" + 1), '^[^\\n]*')"


def tokens_cte(units: str) -> str:
    """lx, tk: raw tokens (unit_id, text, value, start, end, line, column, origin)."""
    return f"""
lx AS (SELECT unit_id, text, l, (sum(length(l)) OVER (PARTITION BY unit_id ORDER BY i))::BIGINT - length(l) AS o FROM (
  SELECT unit_id, text, unnest(ls) AS l, unnest(range(len(ls))) AS i FROM (SELECT unit_id, text, regexp_extract_all(text, {q(re2(X.TILE))}) AS ls FROM {units}))),
t0 AS (SELECT unit_id, text, CASE WHEN left(l, 1) IN ('"', '''', '`') THEN regexp_replace(substr(l, 2, length(l) - 2), '\\\\(?:\\n|([\\s\\S]))', '\\1', 'g') ELSE regexp_replace(l, {q(X.NAME_BEFORE_VALUE)}, '') END AS value,
  CASE WHEN left(l, 1) IN ('"', '''', '`') THEN o + 1 ELSE o + length(l) - length(regexp_replace(l, {q(X.NAME_BEFORE_VALUE)}, '')) END AS "start",
  CASE WHEN left(l, 1) IN ('"', '''', '`') THEN o + length(l) - 1 ELSE o + length(l) END AS "end",
  CASE WHEN left(l, 1) IN ('"', '''', '`') THEN 'quoted' ELSE 'unquoted-assignment' END AS origin
  FROM lx WHERE (left(l, 1) IN ('"', '''', '`') AND length(l) >= 3) OR (left(l, 1) NOT IN ('"', '''', '`', '#') AND {matches('l', X.NAME_BEFORE_VALUE)})),
tk AS (SELECT *, {LINE} AS line, {COLUMN} AS "column" FROM t0 WHERE length(value) >= 1)"""


def candidates_cte(units: str) -> str:
    v = "value"
    return (
        tokens_cte(units)
        + f""",
ca AS MATERIALIZED (SELECT * FROM (SELECT *, {entropy(v)} AS entropy FROM tk WHERE length(value) BETWEEN {X.MIN_LENGTH} AND {X.MAX_TOKEN} AND NOT {token_template(v)} AND NOT {token_placeholder(v)}
  AND NOT {repetitive(v)} AND NOT {non_secret(v)} AND {prose_words(v)} <= {X.MAX_PROSE_WORDS}) WHERE entropy >= {X.MIN_ENTROPY} AND entropy <= {X.MAX_ENTROPY} AND {normalized(v)} >= {X.MIN_NORMALIZED})"""
    )


# -- matches


def spans_cte(units: str, rules: tuple[Rule, ...] = RULES) -> str:
    """sp: every match (unit_id, text, rule_id, value, start, end), before the gates."""
    parts = []
    for r in rules:
        p = q(re2(r.pattern))
        parts.append(f"SELECT unit_id, text, '{r.rule_id}' AS rule_id, regexp_extract_all(text, {p}) AS ms, regexp_extract_all(text, {p}, {r.value_group}) AS vs, string_split_regex(text, {p}) AS gs FROM {units} WHERE regexp_matches(text, {p})")
    return f"""
rx AS ({" UNION ALL ".join(parts)}),
ix AS (SELECT *, unnest(range(1, len(ms) + 1)) AS i FROM rx),
sp AS (SELECT unit_id, text, rule_id, vs[i] AS value, s AS "start", s + length(ms[i]) AS "end" FROM (
  SELECT *, coalesce(length(array_to_string(gs[1:i], '')), 0) + coalesce(length(array_to_string(ms[1:i - 1], '')), 0) AS s FROM ix))"""


def rule_values(rules: tuple[Rule, ...] = RULES) -> str:
    rows = []
    for r in rules:
        keys = "[" + ", ".join(map(q, r.keywords)) + "]::VARCHAR[]"
        rows.append(f"('{r.rule_id}', '{r.category}', {r.severity}, {r.priority}, {keys}, {0.0 if r.min_entropy is None else r.min_entropy}::DOUBLE, {0 if r.exact else 1}, {r.floor}, {str(r.requires_context).lower()}, {str(r.suppress_placeholders).lower()}, {q(r.advice)})")
    return f"ru(rule_id, category, severity, priority, keys, min_entropy, specificity, floor, context, ph, advice) AS (VALUES {', '.join(rows)})"


def matches_cte(units: str, rules: tuple[Rule, ...] = RULES) -> str:
    v = "value"
    return (
        spans_cte(units, rules)
        + f""",
{rule_values(rules)},
g1 AS (SELECT *, {LINE} AS line, {COLUMN} AS "column", {LINE_TEXT} AS lt FROM (SELECT sp.*, ru.* EXCLUDE (rule_id), {entropy("value")} AS entropy FROM sp JOIN ru USING (rule_id)
  WHERE value <> '' AND length(value) <= {X.MAX_MATCH} AND NOT (ph AND {match_placeholder(v)}) AND NOT {match_template(v)} AND NOT {repetitive(v)}) WHERE entropy >= min_entropy),
g2 AS (SELECT *, list_filter(keys, lambda k: contains({keyword("lt")}, {keyword("k")})) AS keywords, nullif(regexp_extract(left(lt, "column" - 1), {q(X.ASSIGNED_NAME)}, 1), '') AS assignment_name FROM g1),
ma AS MATERIALIZED (SELECT *, CASE WHEN floor < 3 AND (len(keywords) > 0 OR assignment_name IS NOT NULL) THEN least(floor + 1, 3) ELSE floor END AS confidence FROM g2 WHERE NOT context OR len(keywords) > 0)"""
    )


def fused_cte(units: str) -> str:
    """mg: merged rows (unit_id, rule_id, value, start, end, line, column, entropy, keywords, confidence, severity, detector)."""
    return (
        matches_cte(units)
        + ","
        + candidates_cte(units)
        + """,
pa AS MATERIALIZED (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY unit_id, "start", "end", value ORDER BY specificity, priority, rule_id) AS rk FROM ma) WHERE rk = 1),
pr AS (SELECT p.unit_id, p.rule_id, p."start" AS ps, p."end" AS pe, p.value AS pv, c."start" AS cs, c."end" AS ce FROM pa p JOIN ca c ON p.unit_id = c.unit_id AND p."start" < c."end" AND c."start" < p."end"
  AND ((p."start" <= c."start" AND c."end" <= p."end") OR (c."start" <= p."start" AND p."end" <= c."end") OR contains(p.value, c.value) OR contains(c.value, p.value))),
nc AS MATERIALIZED (SELECT unit_id, cs, ce, count(*) AS n, min(rule_id) AS rule_id, min(ps) AS ps, min(pe) AS pe, min(pv) AS pv FROM pr GROUP BY ALL),
su AS (SELECT DISTINCT unit_id, rule_id, ps, pe, pv FROM nc WHERE n = 1),
mg AS (SELECT pa.unit_id, pa.rule_id, value, "start", "end", line, "column", entropy, keywords, CASE WHEN su.unit_id IS NOT NULL THEN 3 ELSE confidence END AS confidence, severity, CASE WHEN su.unit_id IS NOT NULL THEN 'composite' ELSE 'pattern' END AS detector
  FROM pa LEFT JOIN su ON pa.unit_id = su.unit_id AND pa.rule_id = su.rule_id AND "start" = ps AND "end" = pe AND value = pv
  UNION ALL SELECT ca.unit_id, 'high-entropy-string', value, "start", "end", line, "column", entropy, []::VARCHAR[], 2, 2, 'entropy' FROM ca WHERE NOT EXISTS (SELECT 1 FROM nc WHERE nc.unit_id = ca.unit_id AND cs = ca."start" AND ce = ca."end"))"""
    )


def findings_cte() -> str:
    """fi: findings of the derived corpus and of documents."""
    return f"""WITH u AS ({corpus_sql(True)} UNION ALL SELECT doc_id + 1000000000, 'documents/' || doc_id, coalesce(text, '') FROM documents),
{fused_cte("u")},
fi AS (SELECT mg.rule_id, coalesce(ru.category, 'unknown') AS category, mg.severity, mg.confidence, detector, path, line, "column", '************' AS masked_value, length(value) AS value_length, {fingerprint("value")} AS value_fingerprint,
  round(entropy, 6) AS entropy, list_sort(keywords) AS matched_keywords, coalesce(ru.advice, 'Find out what the value opens, and rotate it.') AS remediation
  FROM mg JOIN u USING (unit_id) LEFT JOIN ru ON mg.rule_id = ru.rule_id
  QUALIFY row_number() OVER (PARTITION BY mg.rule_id, path, line, "column", value_fingerprint ORDER BY "start", "end", mg.rule_id, detector, mg.confidence, mg.severity, value_length) = 1)
"""
