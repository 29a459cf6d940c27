import re
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from veilsift import fixed as X
from veilsift.operators import baseline as B
from veilsift.operators import findings as O
from veilsift.operators import fusion, history, lexer, patterns
from veilsift.plans import report
from veilsift.plans.detect import Options, detect, line_errors, prepare
from veilsift.rules import RULES, Rule, registry

BODY = "0f3a9c7be1d24568af09b3c7d1e5f2a4b6c8d0e1f2a7c3b9"
GH = "gh" + "p_" + BODY[:36]
GHS = "gh" + "s_" + BODY[4:40]
DB = "postgres" + "://user:s3cr3tpw9@db.host/app"


def units(spark, *texts):
    return spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "unit_id int, text string")


def rows(df, *columns):
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_lexemes_tile_the_text(spark):
    odd = ['a = "x\\"y" # c "no"\n\'q\' `m\nn` "open\nk=v==w', "", "'\n\"", "é = 'ü😀'", "\\" * 50, "`" + "x" * 50000 + "`", '"' + "\\\\" * 20000 + '"']
    got = units(spark, *odd).select("unit_id", F.array_join(lexer.lexemes(F.col("text")), "").alias("t")).orderBy("unit_id").collect()
    assert [r.t for r in got] == odd


def test_tokens(spark):
    text = 'name = value9 # "hidden"\nx = "a\\"b\\n" \'q\' `m\nn` z == y "open'
    got = rows(lexer.raw_tokens(units(spark, text)), "start", "value", "line", "column", "origin")
    assert [(g[1], g[4]) for g in got] == [("value9", "unquoted-assignment"), ('a"bn', "quoted"), ("q", "quoted"), ("m\nn", "quoted")]
    for start, value, line, column, _ in got:
        before = text[:start]
        assert (line, column) == (before.count("\n") + 1, len(before) - before.rfind("\n"))


@pytest.mark.parametrize(
    "text, want",
    [
        (f'github_token = "{GH}"', [("github-pat-classic", "pattern", 3, 40)]),
        (f'pad = "  {GH}  "', [("github-pat-classic", "composite", 3, 40)]),
        (f'two = "{GH} {GHS}"', [("github-app-token", "pattern", 3, 40), ("github-pat-classic", "pattern", 3, 40)]),
        (f'DATABASE_URL = "{DB}"', [("database-uri-with-password", "composite", 3, 9)]),
        (f'MAC = "{BODY[:41]}-x9"', [("high-entropy-string", "entropy", 2, 44)]),
        (f'aws_secret_access_key = "{BODY[:40]}"', [("aws-secret-access-key", "composite", 3, 40)]),
        (f'other = "{BODY[:40]}"', [("high-entropy-string", "entropy", 2, 40)]),
        (f'# token = "{BODY[:40]}"', []),
        ('k = "changeme-' + BODY[:30] + '"', []),
        ("", []),
        (None, []),
    ],
)
def test_findings_of_whole_texts(spark, text, want):
    assert rows(detect(units(spark, text)), "rule_id", "detector", "confidence", "value_length") == sorted(want)


def test_line_ends_lines_and_copies(spark):
    found = detect(units(spark, f"a\r\nb = 1\r{GH}\n{GH} {GH}"))
    assert rows(found, "line", "column") == [(3, 1), (4, 1), (4, 42)]


def test_order_and_partitions_do_not_matter(spark):
    text = [f'k{i} = "{GH} {GHS}"\n{DB}\nv = "{BODY[i:i + 30]}"' for i in range(12)]
    a, b = units(spark, *text).repartition(1), units(spark, *text).repartition(16)
    columns = ["rule_id", "path", "line", "column", "detector", "value_fingerprint"]
    assert rows(detect(a), *columns) == rows(detect(b), *columns) == rows(detect(a, tuple(reversed(RULES))), *columns)


def test_both_fusions_agree(spark):
    text = units(spark, f'p = "{GH} {GHS}"', f'"  {GH} "', f'"{BODY}"', DB, f'"{DB}" "{GH}"')
    found, candidates = patterns.matches(text), lexer.entropy_candidates(text)
    assert rows(fusion.fuse(found, candidates), "unit_id", "rule_id", "start", "detector", "confidence") == rows(fusion.fuse_by_join(found, candidates), "unit_id", "rule_id", "start", "detector", "confidence")


def test_nothing_shows_a_value(spark):
    found = detect(units(spark, f'x = "{GH}"\n{DB}\n"{BODY[:40]}"'))
    for r in found.collect():
        shown = " ".join(map(str, r))
        assert GH not in shown and "s3cr3tpw9" not in shown and BODY[:40] not in shown
    for render in report.RENDERERS.values():
        assert GH[4:] not in render(found) and "s3cr3tpw9" not in render(found)


def test_rule_options(spark):
    mine = Rule("own-rule", "generic_token", 3, 5, r"\bOWN-[0-9a-f]+", ("credential",), min_entropy=1.0, exact=False, reject_hashes=False, placeholders=("dead",), max_length=20)
    text = units(spark, "credential OWN-12ab34cd", "OWN-12ab34cd", "OWN-dead12ab34", "OWN-" + "1a" * 30)
    got = rows(patterns.matches(text, registry(extra=(mine,))), "unit_id", "rule_id", "confidence")
    assert got == [(0, "own-rule", 2), (1, "own-rule", 1)]
    hashes = Rule("hex-rule", "generic_token", 3, 5, r"\b[0-9a-f]{40}\b", reject_hashes=True)
    assert patterns.matches(units(spark, BODY[:40]), (hashes,)).count() == 0
    with pytest.raises(ValueError):
        registry(extra=(RULES[0],))
    with pytest.raises(ValueError):
        registry(disabled=("no-such",))
    with pytest.raises(ValueError):
        Rule("Bad Id", "x", 1, 1, "x")


def test_over_long_lines(spark):
    text = f'{"x" * 100}\nk = "  {GH}  "'
    options = Options(line_cap=90)
    found = detect(units(spark, text), RULES, options)
    assert rows(found, "rule_id", "detector") == [("github-pat-classic", "pattern"), ("high-entropy-string", "entropy")]
    assert rows(line_errors(prepare(units(spark, text, "short")), 90), "code") == [("line-too-long",)]


def test_detectors_and_keys(spark):
    text = units(spark, f'k = "  {GH}  "')
    assert rows(detect(text, RULES, Options(detectors=("pattern",))), "detector") == [("pattern",)]
    assert rows(detect(text, RULES, Options(detectors=("entropy",))), "detector") == [("entropy",)]
    plain, keyed = (detect(text, RULES, Options(key=k)).first().value_fingerprint for k in (None, b"k"))
    assert plain != keyed and re.fullmatch("[0-9a-f]{12}", keyed)


def test_counts_and_exit_codes(spark):
    found = detect(units(spark, f'"{GH}" {DB} "{BODY[:40]}"'))
    assert [tuple(r) for r in O.count_by(found, "severity", X.SEVERITIES).collect()] == [("critical", 4, 1), ("high", 3, 1), ("medium", 2, 1), ("low", 1, 0)]
    none = spark.createDataFrame([], "path string, code string, reason string")
    one = spark.createDataFrame([("p", "binary", "r")], none.schema)
    assert O.exit_code(found, none, 4).first().exit_code == 1
    assert O.exit_code(found, none, None).first().exit_code == 0
    assert O.exit_code(found.where("false"), none, 1).first().exit_code == 0
    assert O.exit_code(found, one, 1).first().exit_code == 3
    assert O.summary(found.where("false")).first().highest_severity is None
    totals = spark.createDataFrame([(2, 30)], "files_scanned long, bytes_scanned long")
    block = O.summary_block(found, one.union(one), totals).first()
    assert (block.total_findings, block.distinct_secrets, block.highest_severity, block.files_scanned, block.bytes_scanned, block.error_count) == (3, 3, "critical", 2, 30, 2)
    assert block.by_severity == {"low": 0, "medium": 1, "high": 1, "critical": 1} and block.by_category == {"database": 1, "github": 1, "unknown": 1} and sum(block.by_confidence.values()) == 3
    nothing = O.summary_block(found.where("false"), none, totals).first()
    assert (nothing.total_findings, nothing.highest_severity, nothing.by_category) == (0, None, {})
    assert O.error_codes(one.union(one).union(spark.createDataFrame([("p", None, "r"), ("p", "vanished", "r")], none.schema))).first().codes == ["binary", "unknown", "vanished"]
    assert O.error_codes(none).first().codes == []


def test_masks_of_rules(spark):
    shown = tuple(replace(r, keep_prefix=4, keep_suffix=2) if r.rule_id == "github-pat-classic" else r for r in RULES)
    found = detect(units(spark, f'"{GH}" {DB}'), shown)
    assert rows(found, "rule_id", "masked_value") == [("database-uri-with-password", "*" * 12), ("github-pat-classic", GH[:4] + "*" * 12 + GH[-2:])]
    with pytest.raises(ValueError):
        replace(RULES[0], keep_prefix=-1)


def test_baseline(spark, tmp_path):
    now = detect(units(spark, GH, DB))
    known = detect(units(spark, GH, f"\n{DB}"))
    assert sorted(r.classification for r in B.classify(now, known).collect()) == ["baselined", "new", "stale"]
    assert B.updated(now, known).count() == 3
    path = tmp_path / "b.json"
    path.write_text(B.as_json(known.select(*B.IDENTITY, "category", "severity", "confidence")))
    assert rows(B.only_new(now, B.read(spark, str(path))), "rule_id") == [("database-uri-with-password",)]
    path.write_text('{"schema_version": 1, "entries": [{}]}')
    with pytest.raises(ValueError):
        B.read(spark, str(path))


def test_history_keeps_walk_order(spark):
    refs = spark.createDataFrame([(0, "c3", 5, "a", "o1"), (1, "c2", 9, "a", "o1"), (2, "c2", 9, "b", "o2"), (3, "c1", 7, "b", "o1")], "walk_seq long, commit string, commit_time long, path string, object_name string")
    assert rows(history.blob_paths(refs), "object_name", "path", "commit", "occurrences") == [("o1", "a", "c3", 2), ("o1", "b", "c1", 1), ("o2", "b", "c2", 1)]
    kept, cut = history.first_commits(refs, 2)
    assert kept.count() == 3 and cut.first().truncated
    kept, cut = history.first_commits(refs, 3)
    assert kept.count() == 4 and not cut.first().truncated
    assert rows(history.first_blobs(refs, 1), "walk_seq") == [(0,), (1,), (3,)]
    spans = spark.createDataFrame([(1, 0, 3), (1, 3, 5), (1, 7, 9), (1, 8, 8), (2, 1, 2)], "id int, start int, end int")
    assert rows(history.merge_spans(spans, "id"), "id", "start", "end") == [(1, 0, 5), (1, 7, 9), (2, 1, 2)]
