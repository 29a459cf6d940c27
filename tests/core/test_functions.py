import hashlib
import hmac
import math
from collections import Counter

import pytest
from pyspark.sql import functions as F

from veilsift import fixed as X
from veilsift.functions import info
from veilsift.functions import text as T
from veilsift.operators import findings as O
from veilsift.operators import paths


def values(spark, rows, column):
    df = spark.createDataFrame([(i, v) for i, v in enumerate(rows)], "i int, v string")
    return [r.x for r in df.select("i", column(F.col("v")).alias("x")).orderBy("i").collect()]


def test_entropy_is_that_of_counts(spark):
    rows = ["", "a", "aa", "ab", "hello world", "é😀é", "0123456789abcdef" * 3]

    def plain(v):
        return -sum(n / len(v) * math.log2(n / len(v)) for n in Counter(v).values()) if v else 0.0

    assert values(spark, rows, info.shannon_entropy) == pytest.approx([plain(v) for v in rows])
    assert values(spark, rows, info.normalized_entropy) == pytest.approx([min(1.0, plain(v) / math.log2(len(set(v)))) if len(set(v)) > 1 else 0.0 for v in rows])
    assert values(spark, ["", "0aF", "AB27", "a-_=Z", "a b"], info.charset_family) == ["empty", "hex", "hex", "base64", "mixed"]


@pytest.mark.parametrize("key", [b"k", b"x" * 200])
def test_fingerprints(spark, key):
    rows = ["", "secret", "é😀"]
    assert values(spark, rows, info.fingerprint) == [hashlib.sha256(v.encode()).hexdigest()[:12] for v in rows]
    assert values(spark, rows, lambda v: info.fingerprint(v, key)) == [hmac.new(key, v.encode(), "sha256").hexdigest()[:12] for v in rows]


def test_masks_hide(spark):
    rows = ["", "short", "a" * 30, "*" * 12, "x" * 11 + "\x00" + "y" * 20]
    assert values(spark, rows, info.mask) == [X.REDACTION, X.REDACTION, X.REDACTION, X.REDACTION_FALLBACK, X.REDACTION]
    assert values(spark, ["abcdefghijklmnopqrst", "abcdefghijklm"], lambda v: info.mask(v, 4, 2)) == ["abcd" + X.REDACTION + "st", X.REDACTION]
    assert values(spark, ["abcdefghijklmnopqrstuvwxyz"], lambda v: info.mask(v, 7, 7)) == ["abcdefg" + X.REDACTION + "z"]


def test_repetition_and_structure(spark):
    rows = ["aaa", "aaaa", "abcabc", "abcd", "dcba", "abce", "aab"]
    assert values(spark, rows, T.repetitive) == [False, True, True, True, True, False, False]
    code = ["a\nb", "x{y}", "mod.Name", "A_B", "git-hub", "550e8400-e29b", "~x", ":role:x", "(?:x", "a\\b", "^x$", "f(x)", "http://h/x", "http://u@h/x", "plain"]
    assert values(spark, code, T.non_secret_structure) == [True, True, True, True, True, False, True, True, True, True, True, True, True, False, False]


def test_placeholders_and_templates(spark):
    rows = ["my-example-key", "your key", "yourself", "changeme", "realvalue9"]
    assert values(spark, rows, T.token_placeholder) == [True, True, False, True, False]
    assert values(spark, ["a test b", "latest", "your_api_key_here", "zz"], T.match_placeholder) == [True, False, True, False]
    assert values(spark, ["${}", " ${X} ", "{{x}}", "%X%", "a${X}"], T.token_template) == [True, True, True, False, False]
    assert values(spark, ["${}", "${X}", "%X%", "%%", "{%x%}"], T.match_template) == [False, True, True, False, True]


def test_names_terms_and_lines(spark):
    rows = ["password = ", "this.password := ", '"api_key": "', "nothing", "a b", "TOKEN]= "]
    assert values(spark, rows, lambda v: T.assignment_name(v, F.length(v) + 1)) == ["password", "this.password", "api_key", None, None, "TOKEN"]
    assert values(spark, ["access_token", "api-key and password", "tokenizer", "", "secretsecret"], T.keyword_score) == [1, 2, 0, 0, 0]
    text = "ab\ncd\n\nef"
    df = spark.createDataFrame([(text, o) for o in range(len(text))], "t string, o int")
    got = df.select("o", T.line_of(F.col("t"), F.col("o")).alias("l"), T.column_of(F.col("t"), F.col("o")).alias("c"), T.line_text(F.col("t"), F.col("o")).alias("x")).collect()
    for r in got:
        before = text[: r.o]
        assert (r.l, r.c) == (before.count("\n") + 1, len(before) - before.rfind("\n")) and r.x == text.split("\n")[before.count("\n")]


def test_controls_and_markdown(spark):
    assert values(spark, ["a​b c\x07", "é x"], T.strip_controls) == ["abc", "é x"]
    assert values(spark, ["a\x00b\n c ", "\x9fx"], T.sanitize_text) == ["a b c", "x"]
    assert values(spark, ["a|b*c_"], T.markdown_escape) == ["a\\|b\\*c\\_"]


def test_labels(spark):
    assert values(spark, ["HIGH", "critical ", "none"], lambda v: O.from_label(v, X.SEVERITIES)) == [3, 4, None]
    assert values(spark, ["High-Confidence"], lambda v: O.from_label(v, X.CONFIDENCES)) == [3]


def test_paths(spark):
    rows = ["a\\b/./c/../d", "..", "/x//y/", ""]
    assert values(spark, rows, paths.normalize) == ["a/b/c/d", "", "x/y", ""]
    names = ["a.PNG", ".env", "a.tar.gz", "x.", "noext"]
    assert values(spark, names, paths.extension) == [".png", "", ".gz", "", ""]
    files = ["src/a.py", ".git/x", "a/venv/b.txt", "envs/a.py", "img/x.Png", "d/.DS_Store", "vendor/a.go", "vendors/a.go", "p.egg-info/x"]
    assert values(spark, files, lambda p: paths.skip_reason_with_parents(p, ignored_paths=("vendor",))) == [None, "ignored-directory", "ignored-directory", None, "ignored-extension", "ignored-filename", "ignored-path", None, "ignored-directory"]


def test_binary_verdicts(spark):
    split = "é".encode() * 5000  # the window of 8191 cuts a character
    rows = [b"", b"plain\ttext\n", b"a\x00b", b"\xff\xfe", split, b"\x01" * 31 + b"a" * 69, b"\x01" * 30 + b"a" * 70, "日本語".encode(), "日".encode()[:2], b"a" * 9000 + b"\x00", ("x" + "日" * 4000).encode(), ("xx" + "\U0001f600" * 3000).encode()]
    want = ["text", "text", "nul-byte", "undecodable", "text", "control-heavy", "text", "text", "undecodable", "text", "text", "text"]
    df = spark.createDataFrame([(i, bytearray(b)) for i, b in enumerate(rows)], "i int, b binary")
    assert [r.x for r in df.select("i", paths.verdict(F.col("b")).alias("x")).orderBy("i").collect()] == want
    odd = spark.createDataFrame([(bytearray(split),)], "b binary").select(paths.verdict(F.col("b"), window=8191).alias("x")).first().x
    assert odd == "text"


def test_excerpts(spark):
    cases = [
        ("key = abc;", [(6, 9)], "key = ************;"),
        ("abcdef", [(3, 5), (0, 2), (2, 3)], "************f"),
        ("abcdef", [(4, 4), (9, 12), (-3, 1), (5, 99)], "************bcde************"),
        ("abcdef", [(0, 6), (2, 3)], "************"),
        ("a\x1b[31mb\u202ec", [(1, 2)], "a************[31mbc"),
        ("plain", [], "plain"),
        ("", [(0, 3)], ""),
        ("😀é😀", [(1, 2)], "😀************😀"),
    ]
    df = spark.createDataFrame([(i, line, spans) for i, (line, spans, _) in enumerate(cases)], "i int, line string, spans array<struct<start:int,end:int>>")
    got = df.select("i", T.sanitize_excerpt(F.col("line"), F.col("spans")).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == [want for _, _, want in cases]


def test_paths_of_reports_and_masks_of_padded_values(spark):
    rows = ["a/b.txt", "/../a/./b\x1b\n.txt", "..\\x", "../..", "\u202e", "p" * 4096, "p" * 4097, "x/" * 3000 + "y"]
    assert values(spark, rows, paths.report_path) == ["a/b.txt", "a/b.txt", "x", None, None, "p" * 4096, None, None]
    padded = ["\t0123456789abcdefghij\u00a0", " 0123456789abcdefghij\n", "0123456789\tabcdefghijklm"]
    assert values(spark, padded, lambda v: info.mask(v, 4, 2)) == ["0123************ij"] * 2 + ["*" * 12]


def test_running_sums_over_blocks(spark):
    lengths = [(i * 7) % 11 for i in range(2 * T.BLOCK + 3)]
    at = [0, 1, T.BLOCK - 1, T.BLOCK, T.BLOCK + 1, 2 * T.BLOCK, 2 * T.BLOCK + 3]
    df = spark.createDataFrame([(lengths, at), ([5], [0, 1]), ([], [0])], "lengths array<int>, at array<int>")
    got = df.select("lengths", "at", T.running(F.col("lengths"), lambda before: F.transform(F.col("at"), before)).alias("sums")).collect()
    assert all(r.sums == [sum(r.lengths[:i]) for i in r["at"]] for r in got) and len(got) == 3
