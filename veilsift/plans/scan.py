"""Whole scans of a folder, a file or a repository, and the command line."""

from __future__ import annotations

import argparse
import json
import os
import sys
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import fixed as X
from ..operators import baseline as B
from ..operators import findings as O
from ..rules import RULES, registry
from ..sources import config, files
from .detect import Options, detect, line_errors
from .report import RENDERERS, VERSION, clean, write_report

ERRORS = "path string, code string, reason string"


@dataclass
class Scan:
    """Findings, errors (path, code, reason) and files (path, size, code)."""

    findings: DataFrame
    errors: DataFrame
    files: DataFrame
    walk: files.Walk | None = None

    def totals(self) -> DataFrame:
        """One row: files_scanned, bytes_scanned."""
        return self.files.agg(F.count_if(F.col("code").isNull()).alias("files_scanned"), F.coalesce(F.sum(F.when(F.col("code").isNull(), F.col("size"))), F.lit(0)).alias("bytes_scanned"))


def options_of(c: config.Config, key: bytes | None = None) -> Options:
    detectors = tuple(n for n, on in (("pattern", c["patterns.enabled"]), ("entropy", c["entropy.enabled"])) if on)
    return Options(c["entropy.min_length"], c["entropy.max_prose_words"], c["entropy.min_entropy"], c["entropy.max_entropy"], c["entropy.min_normalized"], X.SEVERITIES[c["entropy.severity"]], c["scan.line_cap"], detectors, key)


def scan_path(spark: SparkSession, target: str, c: config.Config | None = None, *, key: bytes | None = None, options: Options | None = None) -> Scan:
    """A folder by its walk, or one file whatever its name."""
    c = c or config.Config({n: s.default for n, s in config.SETTINGS.items()})
    if os.path.isfile(target):
        found = files.Walk(os.path.dirname(os.path.abspath(target)), [(os.path.basename(target), os.path.abspath(target), os.path.getsize(target))])
    else:
        found = files.walk(target, files.WalkOptions(c["scan.ignored_paths"], c["scan.ignored_directories"], c["scan.ignored_filenames"], c["scan.ignored_extensions"], c["scan.follow_symlinks"], c["scan.max_depth"], c["scan.max_bytes"], c["scan.max_files"]))
    return scan_walk(spark, found, c, key=key, options=options)


def scan_walk(spark: SparkSession, found: files.Walk, c: config.Config | None = None, *, key: bytes | None = None, options: Options | None = None) -> Scan:
    """What a walk found."""
    c = c or config.Config({n: s.default for n, s in config.SETTINGS.items()})
    read = files.read_files(spark, found.files, c["scan.max_bytes"])
    units = files.as_units(read)
    opts = options or options_of(c, key)
    rules = registry(RULES, disabled=c["patterns.disabled"])
    reason = F.when(F.col("code").isin("vanished", "read-failed", "is-directory"), "the file could not be opened").when(F.col("code") == "too-large", "larger than the limit").otherwise("not read as text")
    errors = spark.createDataFrame(found.errors, ERRORS).unionByName(read.where("code is not null").select("path", "code", reason.alias("reason")))
    if opts.line_cap is not None:
        errors = errors.unionByName(line_errors(units, opts.line_cap))
    return Scan(detect(units, rules, opts), errors, read.select("path", "size", "code"), found)


def scan_file(spark: SparkSession, path: str, key: bytes | None = None) -> Scan:
    """One file by the entropy screen alone."""
    return scan_path(spark, path, options=Options(detectors=("entropy",), key=key))


def say(line: str) -> None:
    """One line for the person at the terminal, apart from the report."""
    print(f"veilsift: {clean(line)}", file=sys.stderr)


def coverage(counters: dict[str, int], reasons: Sequence[str]) -> str | None:
    """What of a history was not searched; None if all was."""
    notes = ["cut: " + "; ".join(reasons)] if reasons else []
    notes += [f"{counters[k]} {what}" for k, what in (("paths_filtered", "paths left out by name"), ("blobs_binary", "binary objects"), ("blobs_too_large", "objects too large")) if counters[k]]
    if not notes:
        return None
    return f"{counters['commits']} commits walked, {counters['blobs_scanned']} of {counters['blobs_seen']} objects searched; " + "; ".join(notes)


def _positive(text: str) -> int:
    if not text.isdecimal() or int(text) < 1:
        raise argparse.ArgumentTypeError("a whole number of 1 or more is due")
    return int(text)


def _parser() -> argparse.ArgumentParser:
    p = argparse.ArgumentParser(prog="veilsift", description="Find credentials in folders, files and histories.")
    p.add_argument("--version", action="version", version=f"veilsift {VERSION}")
    sub = p.add_subparsers(dest="command", required=True)
    for name in ("scan", "git"):
        s = sub.add_parser(name)
        s.add_argument("target")
        s.add_argument("--format", choices=sorted(RENDERERS), default="text")
        s.add_argument("--output")
        s.add_argument("--baseline", help="known findings; they are left out of the report")
        s.add_argument("--baseline-output", "--write-baseline", dest="baseline_output", help="write the known findings, those of --baseline and the current ones")
        s.add_argument("--fail-on", choices=[*X.SEVERITIES, "none"], default="low")
        s.add_argument("--fail-on-new", action="store_true", help="only findings that --baseline does not know count")
        s.add_argument("--min-confidence", choices=list(X.CONFIDENCES), default="candidate")
        s.add_argument("--fingerprint", choices=["sha256", "hmac", "none"], default="sha256")
        s.add_argument("--max-line-length", type=_positive)
        s.add_argument("--project-root", help="the folder whose settings hold")
        if name == "scan":
            for option in ("--max-file-size", "--max-files", "--max-depth"):
                s.add_argument(option, type=_positive)
            s.add_argument("--follow-symlinks", action="store_true")
        else:
            for option in ("--max-commits", "--max-blobs", "--max-refs", "--timeout"):
                s.add_argument(option, type=_positive)
            s.add_argument("--since")
            s.add_argument("--until")
            s.add_argument("--respect-path-filters", action="store_true")
    rules = sub.add_parser("rules")
    rules.add_argument("action", nargs="?", choices=["list"], default="list")
    rules.add_argument("--format", choices=["text", "json"], default="text")
    gate = sub.add_parser("gate", help="fail on sure findings outside tests/, in a repository's files or in what is staged")
    gate.add_argument("target", nargs="?", default=".")
    gate.add_argument("--staged", action="store_true")
    return p


def _rules_text(kind: str) -> str:
    rules = registry()
    if kind == "text":
        return "".join(f"{r.priority:3} {r.rule_id} {r.category}\n" for r in rules) + f"  - {X.ENTROPY_RULE} unknown\n"
    names = {v: k for k, v in X.SEVERITIES.items()}
    entries = [{"rule_id": r.rule_id, "category": r.category, "severity": names[r.severity], "priority": r.priority, "keywords": list(r.keywords)} for r in rules]
    return json.dumps({"rules": [*entries, {"rule_id": X.ENTROPY_RULE, "category": "unknown", "severity": "medium", "priority": None, "keywords": []}]}, sort_keys=True) + "\n"


def gate_findings(scan: Scan, level: str = "high_confidence") -> DataFrame:
    """Findings that a gate stops at: sure ones outside tests/."""
    return scan.findings.where((F.col("confidence") >= X.CONFIDENCES[level]) & ~F.startswith(F.col("path"), F.lit("tests/")))


def _history(spark: SparkSession, a: argparse.Namespace, c: config.Config, options: Options) -> Scan:
    from ..sources.git import TIMEOUT, scan_history

    h = scan_history(
        spark, a.target, registry(RULES, disabled=c["patterns.disabled"]), options, max_commits=a.max_commits, max_blobs=a.max_blobs or X.MAX_BLOBS, max_refs=a.max_refs or X.MAX_REFS, since=a.since, until=a.until,
        path_filters=a.respect_path_filters, ignored_paths=c["scan.ignored_paths"], timeout=a.timeout or TIMEOUT,
    )
    note = coverage(h.counters.first().asDict(), [r.reason for r in h.errors.where("code = 'history-truncated'").select("reason").collect()])
    if note:
        say(note)
    return Scan(h.findings, h.errors, h.status.select(F.col("object_name").alias("path"), "size", F.when(F.col("status") != "scanned", F.col("status")).alias("code")))


def _run(a: argparse.Namespace) -> int:
    if a.command == "rules":
        sys.stdout.write(_rules_text(a.format))
        return 0
    spark = SparkSession.builder.appName("veilsift").getOrCreate()
    if a.command == "gate":
        from ..sources.git import staged

        scan = scan_path(spark, a.target) if not a.staged else scan_walk(spark, staged(a.target))
        stopped = gate_findings(scan).persist()
        sys.stdout.write(RENDERERS["text"](stopped, scan.errors))
        return O.exit_code(stopped, scan.errors, 1).first().exit_code
    key = os.environ.get("VEILSIFT_KEY", "").encode() or None
    if a.fingerprint == "hmac" and not key:
        raise ValueError("a keyed fingerprint needs VEILSIFT_KEY")
    if a.fail_on_new and not a.baseline:
        raise ValueError("--fail-on-new needs --baseline")
    key = key if a.fingerprint == "hmac" else None
    own = {"scan.line_cap": a.max_line_length}
    if a.command == "scan":
        own |= {"scan.max_bytes": a.max_file_size, "scan.max_files": a.max_files, "scan.max_depth": a.max_depth, "scan.follow_symlinks": a.follow_symlinks or None}
    root = a.project_root or (a.target if os.path.isdir(a.target) else ".")
    c = config.load(root, {k: v for k, v in own.items() if v is not None})
    known = B.read(spark, a.baseline) if a.baseline else None
    scan = _history(spark, a, c, options_of(c, key)) if a.command == "git" else scan_path(spark, a.target, c, key=key)
    # the report, the baseline and the exit code read one detection
    found, errors = scan.findings.persist(), scan.errors.persist()
    shown = found.where(F.col("confidence") >= X.CONFIDENCES[a.min_confidence])
    if known is not None:
        shown = B.only_new(shown, known)
    if a.baseline_output:
        write_report(a.baseline_output, B.as_json(B.updated(found, known if known is not None else found.where("false"))))
    report = RENDERERS[a.format](shown, errors, fingerprints=a.fingerprint != "none", totals=scan.totals().first().asDict())
    if a.output:
        write_report(a.output, report)
    else:
        sys.stdout.write(report)
        sys.stdout.flush()
    n = errors.count()
    if n:
        say(f"{n} inputs could not be read whole ({', '.join(O.error_codes(errors).first().codes)}); the result is partial")
    return O.exit_code(shown, errors, None if a.fail_on == "none" else X.SEVERITIES[a.fail_on]).first().exit_code


def main(arguments: Sequence[str] | None = None) -> int:
    """0: nothing; 1: findings at or above --fail-on; 2: usage; 3: errors; 4: a failure inside; 130: interrupted.

    No message holds a scanned value: of a failure inside only its kind is told.
    """
    from ..sources.git import GitError

    try:
        return _run(_parser().parse_args(arguments))
    except SystemExit as e:
        return e.code if isinstance(e.code, int) else 0 if e.code is None else 2
    except KeyboardInterrupt:
        say("interrupted; there is no report")
        return 130
    except GitError as e:
        say(str(e))
        return 3
    except BrokenPipeError:
        return 3
    except (config.ConfigError, ValueError) as e:
        say(str(e))
        return 2
    except Exception as e:  # noqa: BLE001 - the end of the process: a trace could hold scanned text
        say(f"a failure inside: {type(e).__name__}")
        return 4


if __name__ == "__main__":
    sys.exit(main())
