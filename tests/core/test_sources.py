import json
import os
import shutil
import subprocess

import pytest
from pyspark.sql import functions as F

from veilsift.plans import report, scan
from veilsift.sources import config, files
from veilsift.streaming import counts

BODY = "0f3a9c7be1d24568af09b3c7d1e5f2a4b6c8d0e1f2a7c3b9"
GH = "gh" + "p_" + BODY[:36]


def tree(root):
    (root / "src").mkdir()
    (root / "node_modules/x").mkdir(parents=True)
    (root / "deep/a/b").mkdir(parents=True)
    (root / "src/a.py").write_text(f'k = "{GH}"\n')
    (root / "src/é.txt").write_bytes("﻿nothing here\r\n".encode())
    (root / "src/bin.txt").write_bytes(b"a\0b")
    (root / "src/bad.txt").write_bytes(b"ok\xff")
    (root / "src/late.txt").write_bytes(b"x" * 9000 + b"\xff")
    (root / "x.png").write_text(GH)
    (root / "node_modules/x/y.js").write_text(GH)
    (root / "deep/a/b/c.txt").write_text("c")
    os.symlink(root / "src/a.py", root / "link.py")
    os.symlink("/etc", root / "out")
    os.symlink(root, root / "src/up")


def test_walk(tmp_path):
    tree(tmp_path)
    w = files.walk(str(tmp_path))
    assert [f[0] for f in w.files] == ["deep/a/b/c.txt", "src/a.py", "src/bad.txt", "src/bin.txt", "src/late.txt", "src/é.txt"]
    assert dict(w.skipped) == {"link.py": "symlink", "node_modules": "ignored-directory", "out": "symlink", "src/up": "symlink", "x.png": "ignored-extension"}
    w = files.walk(str(tmp_path), files.WalkOptions(follow_symlinks=True, max_depth=1))
    assert dict(w.skipped)["out"] == "symlink-outside-root" and dict(w.skipped)["src/up"] in ("circular-symlink", "ignored-depth") and dict(w.skipped)["deep/a"] == "ignored-depth"
    w = files.walk(str(tmp_path), files.WalkOptions(max_files=2))
    assert len(w.files) == 2 and w.truncated and w.errors[0][1] == "too-many-files"
    assert files.walk(str(tmp_path / "none")).errors[0][1] == "root-not-a-directory"


def test_scan_of_a_folder(spark, tmp_path):
    tree(tmp_path)
    s = scan.scan_path(spark, str(tmp_path))
    assert [(r.path, r.rule_id) for r in s.findings.collect()] == [("src/a.py", "github-pat-classic")]
    assert sorted((r.path, r.code) for r in s.errors.collect()) == [("src/bad.txt", "invalid-encoding"), ("src/bin.txt", "binary"), ("src/late.txt", "invalid-encoding")]
    assert s.totals().first().files_scanned == 3
    one = scan.scan_path(spark, str(tmp_path / "x.png"))
    assert one.findings.count() == 1
    assert scan.scan_file(spark, str(tmp_path / "src/a.py")).findings.count() == 0


def test_reports(spark, tmp_path):
    tree(tmp_path)
    s = scan.scan_path(spark, str(tmp_path))
    text, data = report.render_text(s.findings, s.errors), json.loads(report.render_json(s.findings, s.errors))
    assert "src/a.py:1:6" in text and data["summary"]["total_findings"] == 1 and data["summary"]["by_category"] == {"github": 1} and data["summary"]["error_count"] == 3 and data["findings"][0]["confidence"] == 3
    sarif = json.loads(report.render_sarif(s.findings, s.errors))["runs"][0]
    assert [r["id"] for r in sarif["tool"]["driver"]["rules"]] == ["github-pat-classic", "scan-error"] and sarif["results"][0]["level"] == "error"
    assert "github-pat-classic" in report.render_markdown(s.findings, s.errors)
    report.write_report(str(tmp_path / "r"), text)
    assert (tmp_path / "r").read_text() == text and (tmp_path / "r").stat().st_mode & 0o777 == 0o600


@pytest.mark.skipif(not shutil.which("git"), reason="no git program")
def test_history(spark, tmp_path):
    from veilsift.sources import git

    def run(*a):
        subprocess.run(["git", "-c", "user.name=t", "-c", "user.email=t@t", "-C", tmp_path, *a], check=True, capture_output=True)

    assert git.head_state(str(tmp_path)) == "invalid"
    run("init", "-q")
    assert git.head_state(str(tmp_path)) == "unborn"
    (tmp_path / "a.txt").write_text(f"k {GH}\n")
    run("add", "."), run("commit", "-qm", "one")
    (tmp_path / "b.txt").write_text(f"k {GH}\n")
    (tmp_path / "a.txt").write_text("gone\n")
    (tmp_path / "c.bin").write_bytes(b"\0\1")
    run("add", "."), run("commit", "-qm", "two")
    h = git.scan_history(spark, str(tmp_path))
    assert sorted((r.path, r.line) for r in h.findings.collect()) == [("a.txt", 1), ("b.txt", 1)]
    assert sorted(r.status for r in h.status.collect()) == ["binary", "scanned", "scanned"] and h.errors.count() == 0
    assert h.counters.first().asDict() == {"blobs_seen": 3, "blobs_scanned": 2, "blobs_binary": 1, "blobs_too_large": 0, "blobs_unreadable": 0, "commits": 2, "paths_filtered": 0}
    cut = git.scan_history(spark, str(tmp_path), max_commits=1)
    assert cut.findings.count() == 1 and [(r.path, r.code) for r in cut.errors.collect()] == [(None, "history-truncated")]
    cut = git.scan_history(spark, str(tmp_path), max_refs=2, max_blobs=1)
    assert sorted(r.reason[:20] for r in cut.errors.collect()) == ["only the newest 1 ob", "only the newest 2 re"] and cut.counters.first().blobs_seen == 1
    assert len(list(git.inventory(str(tmp_path)))) == 2 + 2 + 4 - 1  # commits, trees, distinct contents
    for bad in ({"timeout": 0}, {"since": "--output=x"}, {"until": "9" * 200}):
        with pytest.raises(ValueError):
            git.scan_history(spark, str(tmp_path), **bad)
    (tmp_path / "node_modules").mkdir()
    (tmp_path / "node_modules/k.js").write_text(f"x = '{GH}'\n")
    (tmp_path / "large.txt").write_bytes(b"x" * 700_000)
    run("add", "-f", ".")
    assert [f[0] for f in git.staged(str(tmp_path)).files] == ["large.txt", "node_modules/k.js"]
    run("commit", "-qm", "three")
    filtered = git.scan_history(spark, str(tmp_path), path_filters=True)
    assert filtered.counters.first().paths_filtered == 2 and "node_modules/k.js" not in {r.path for r in filtered.findings.collect()}
    names = [n for n, _ in git.inventory(str(tmp_path))] + ["0" * 40]
    plain = {n: git.git(str(tmp_path), "cat-file", "blob", n) for n, k, _ in git.headers(str(tmp_path), names) if k == "blob"}
    assert {n: c for n, k, _, c in git.objects(str(tmp_path), names) if k == "blob"} == plain
    small = {n: (k, c) for n, k, _, c in git.objects(str(tmp_path), names, 1000)}
    assert small["0" * 40] == (None, None) and sum(k == "blob" and c is None for k, c in small.values()) == 1
    with pytest.raises(git.GitError):
        list(git.inventory(str(tmp_path), timeout=0.0001))


def test_command_line(spark, tmp_path, capsys, monkeypatch):
    tree(tmp_path)
    known, folder = str(tmp_path / "known"), str(tmp_path / "src")
    assert scan.main(["scan", folder, "--baseline-output", known, "--format", "json", "--output", str(tmp_path / "r.json")]) == 3
    assert "binary, invalid-encoding" in capsys.readouterr().err
    summary = json.loads((tmp_path / "r.json").read_text())["summary"]
    assert summary["files_scanned"] == 2 and summary["highest_severity"] == "high"
    for name in ("bin.txt", "bad.txt", "late.txt"):
        (tmp_path / "src" / name).unlink()
    assert scan.main(["scan", folder]) == 1 and "2 texts of" in capsys.readouterr().out
    assert scan.main(["scan", folder, "--baseline", known, "--fail-on-new"]) == 0
    assert scan.main(["scan", folder, "--fail-on", "critical"]) == 0
    data = json.loads((tmp_path / "known").read_text())
    for broken in (data | {"schema_version": 2}, data | {"entries": data["entries"] * 2}, {"entries": []}):
        (tmp_path / "broken").write_text(json.dumps(broken))
        assert scan.main(["scan", folder, "--baseline", str(tmp_path / "broken")]) == 2
    assert scan.main(["scan", folder, "--fail-on-new"]) == 2 and scan.main(["scan"]) == 2 and scan.main(["--version"]) == 0
    capsys.readouterr()
    assert scan.main(["rules", "list", "--format", "json"]) == 0 and len(json.loads(capsys.readouterr().out)["rules"]) == 15

    def fail(error):
        def run(*_, **__):
            raise error

        monkeypatch.setattr(scan, "scan_path", run)
        return scan.main(["scan", folder])

    assert fail(KeyboardInterrupt()) == 130 and fail(RuntimeError(GH)) == 4
    assert GH not in capsys.readouterr().err


def test_names_are_literal_and_vanished_files_are_errors(spark, tmp_path):
    for name in ("[id].tsx", "a{b,c}.py", "star*.txt", "what?.txt", "per%20cent.txt"):
        (tmp_path / name).write_text(f"k = '{GH}'\n")
    s = scan.scan_path(spark, str(tmp_path))
    assert sorted(r.path for r in s.findings.collect()) == ["[id].tsx", "a{b,c}.py", "per%20cent.txt", "star*.txt", "what?.txt"]
    w = files.walk(str(tmp_path))
    (tmp_path / "[id].tsx").unlink()
    s = scan.scan_walk(spark, w)
    assert [(r.path, r.code) for r in s.errors.collect()] == [("[id].tsx", "vanished")] and s.findings.count() == 4
    (tmp_path / "large").write_bytes(b"x" * 50)
    assert [(r.code, r.size, r.text) for r in files.read_files(spark, [("large", str(tmp_path / "large"), 50)], 20).collect()] == [("too-large", 50, None)]


def test_config(tmp_path):
    (tmp_path / "pyproject.toml").write_text("[tool.veilsift.entropy]\nmin_length = 10\nmin_entropy = 3.0\n")
    (tmp_path / "veilsift.json").write_text('{"entropy.min_length": 30}')
    c = config.load(tmp_path, {"scan.jobs": 2}, {"VEILSIFT_ENTROPY_MIN_ENTROPY": "4.5", "VEILSIFT_SCAN_MAX_DEPTH": "none"})
    assert (c["entropy.min_length"], c["entropy.min_entropy"], c["scan.jobs"], c["scan.max_depth"]) == (30, 4.5, 2, None)
    assert (c.source_of("entropy.min_length"), c.source_of("entropy.min_entropy"), c.source_of("scan.line_cap")) == ("json", "environment", "default")
    for bad in ({"entropy.min_lenght": 3}, {"entropy.min_length": "x"}, {"entropy.min_length": True}, {"scan.jobs": 65}, {"entropy.severity": "dire"}):
        with pytest.raises(config.ConfigError):
            config.load(tmp_path, bad, {})
    (tmp_path / "veilsift.json").write_text('{"scan.jobs": 1, "scan.jobs": 2}')
    with pytest.raises(config.ConfigError):
        config.load(tmp_path, None, {})


def test_streams(spark, tmp_path):
    spark.createDataFrame([(1, f"k {GH}"), (2, "none"), (3, f"k {GH}")], "unit_id long, text string").write.json(str(tmp_path / "in"))
    stream = spark.readStream.schema("unit_id long, text string").json(str(tmp_path / "in"))
    run = counts.stream_matches(stream).writeStream.format("memory").queryName("found").trigger(availableNow=True).start()
    run.awaitTermination(120)
    assert sorted((r.unit_id, r.rule_id) for r in spark.table("found").collect()) == [(1, "github-pat-classic"), (3, "github-pat-classic")]
    rate = spark.createDataFrame([("2024-01-01 00:10:00", "a"), ("2024-01-01 00:50:00", "a"), ("2024-01-01 01:00:00", "b")], "t string, event_type string").select(F.to_timestamp("t").alias("ts"), "event_type")
    assert sorted((str(r.window_start), r.event_type, r.events) for r in counts.tumbling(rate).collect()) == [("2024-01-01 00:00:00", "a", 2), ("2024-01-01 01:00:00", "b", 1)]
