"""Work that must not be done twice, or by one task, with results that stay the same."""

import random
import re

import duckdb
import pytest
from pyspark.sql import functions as F

from veilsift import fixed as X
from veilsift import queries, rules
from veilsift.functions import info
from veilsift.operators import lexer, patterns
from veilsift.operators.order import positions
from veilsift.plans.detect import detect

DATA = "/root/testdata/sf0.001"
BODY = "0f3a9c7be1d24568af09b3c7d1e5f2a4b6c8d0e1f2a7c3b9"


def units(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "unit_id int, text string")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString().split("== Initial Plan ==")[0]


def tokens_by_tile(text):
    """(start, end) of tokens by the fine tile."""
    at, out = 0, []
    for x in re.findall(X.TILE, text):
        if x[0] in "\"'`" and len(x) >= 3:
            out.append((at + 1, at + len(x) - 1))
        elif x[0] not in "\"'`#" and (m := re.match(X.NAME_BEFORE_VALUE, x, re.ASCII)):
            out.append((at + m.end(), at + len(x)))
        at += len(x)
    assert at == len(text)
    return out


def test_coarse_lexemes_give_the_same_tokens(spark):
    draw = random.Random(5)
    parts = ["a", "bc_1", " ", "\t", "=", "==", "\n", '"', "'", "`", "#", "\\", "/", "é", "😀", "x=y", "k = v-w ", '"q r"', "# c\n"]
    texts = ["".join(draw.choices(parts, k=draw.randrange(30))) for _ in range(400)] + ["x == y", "a=b=c", "p = \n q", "=a", "word " * 20000, 'v="' + "w " * 20000 + '"', "# only\nz=1"]
    got = lexer.raw_tokens(units(spark, *texts)).select("unit_id", "start", "end").collect()
    assert sorted(map(tuple, got)) == sorted((i, *t) for i, text in enumerate(texts) for t in tokens_by_tile(text) if t[1] > t[0])
    prose = units(spark, "word and, " * 50).select(F.size(lexer.coarse_lexemes(F.col("text"))))
    assert prose.first()[0] == 1


def test_what_a_rule_asks_for_first_loses_no_match(spark, monkeypatch):
    heads = ["AK" + "IA", "AS" + "IA", "s" + "k-", "s" + "k-proj-", "gh" + "p_", "gh" + "s_", "github" + "_pat_", "s" + "k_live_", "r" + "k_live_", "r" + "k_test_", "p" + "k_test_", "https://hooks" + ".slack.com/services/TAAAAAAAAA/BAAAAAAAAA/", "postgres" + "://u:", "-----BEGIN " + "PRIVATE KEY-----", " ", "x", "=", "/"]
    bodies = [BODY[:16].upper(), BODY[:20], BODY[:36], BODY[:39], BODY[:40], BODY[:41], BODY, "pass@h", "é" + BODY[:40], BODY[:40] + "+", "/" * 40, "-" + BODY[:40] + "-"]
    texts = [before + head + body + after for before in ("", "a ", "\n", "_", "é") for head in heads for body in bodies for after in ("", " z", "_", "\n", "+", "é")]
    columns = ["unit_id", "rule_id", "value", "start", "end"]
    got = patterns.raw_matches(units(spark, *texts)).select(columns).collect()
    monkeypatch.setattr(patterns, "HELD", {})
    monkeypatch.setattr(patterns, "RUN", {})
    want = patterns.raw_matches(units(spark, *texts)).select(columns).collect()
    assert sorted(map(tuple, got)) == sorted(map(tuple, want)) and {r.rule_id for r in got} == {r.rule_id for r in rules.RULES}
    assert set(rules.HELD) == {r.pattern for r in rules.RULES}


def test_entropy_is_worked_out_once(spark):
    text = units(spark, f'k = "{BODY}" aws_secret = "{BODY[:40]}"')
    assert plan(lexer.entropy_candidates(text)).count("LOG2(lambda") == 1
    assert plan(patterns.matches(text)).count("LOG2(lambda") == 1
    odd = ["", "a", "ab", "éé😀é", BODY, "\n\n ", "aAbB" * 9]
    rated = spark.createDataFrame([(v,) for v in odd], "v string").select(info.shannon_entropy(F.col("v")), info.normalized_entropy(F.col("v"))).collect()
    for v, (entropy, share) in zip(odd, rated):
        n = duckdb.execute("SELECT CASE WHEN ? = '' THEN 0.0 ELSE list_entropy(string_split(?, '')) END", [v, v]).fetchone()[0]
        assert entropy == pytest.approx(n, abs=1e-12) and 0 <= share <= 1


@pytest.mark.parametrize("name", ["baseline_new", "baseline_classes", "baseline_updated", "baseline_summary"])
def test_a_baseline_looks_for_findings_once(spark, name):
    df = queries.QUERIES[name](spark, DATA)
    assert df.collect()
    assert plan(df).count("Generate explode(flatten") == 1  # of the rules' matches, below an exchange that is reused


def test_findings_are_not_sorted_before_they_are_dealt(spark):
    df = detect(units(spark, f'"{BODY[:40]}"'))
    assert df.count() == 1 and "WindowGroupLimit" not in plan(df)


def test_positions_by_many_tasks(spark):
    draw = random.Random(3)
    rows = [(f"p{draw.randrange(50)}", draw.choice([None, 1, 2]), i) for i in range(3000)]
    df = spark.createDataFrame(rows, "path string, line int, i int").repartition(7)
    got = positions(df, [F.col("path"), F.coalesce("line", F.lit(0)), F.col("i")])
    for _ in range(2):
        assert [r.i for r in got.orderBy("position").collect()] == [r[2] for r in sorted(rows, key=lambda r: (r[0], r[1] or 0, r[2]))]
    assert sorted(r.position for r in got.collect()) == list(range(1, 3001)) and got.columns == ["path", "line", "i", "position"]
    assert positions(df.where("false"), [F.col("i")]).count() == 0
    ordered = queries.QUERIES["canonical_order"](spark, DATA)
    assert "row_number" not in plan(ordered) and ordered.count() == queries.found(spark, DATA).count()
