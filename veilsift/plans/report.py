"""Reports of findings: text, JSON, Markdown, SARIF. A report is one file; its findings come in canonical order."""

from __future__ import annotations

import json
import os
import re
import tempfile
import textwrap
from collections import Counter
from collections.abc import Mapping

from pyspark.sql import DataFrame

from .. import fixed as X
from ..operators.findings import order_columns
from ..rules import RULES, Rule

WIDTH, VERSION = 78, "1"
_SEVERITY, _CONFIDENCE = ({v: k for k, v in d.items()} for d in (X.SEVERITIES, X.CONFIDENCES))


def clean(text: str) -> str:
    return re.sub(r"\s+", " ", re.sub(r"[\x00-\x1f\x7f-\x9f]", " ", text)).strip()


def _rows(findings: DataFrame) -> list[dict]:
    return [r.asDict() for r in findings.orderBy(*order_columns()).collect()]


def _errors(errors: DataFrame | None) -> list[dict]:
    return [] if errors is None else sorted((r.asDict() for r in errors.select("path", "code", "reason").collect()), key=lambda e: (e["path"] or "", e["code"] or "", e["reason"]))


def _where(f: dict) -> str:
    at = "".join(f":{f[k]}" for k in ("line", "column") if f[k] is not None)
    return clean(f"{f['path']}{at}" + (f"@{f['commit'][:12]}" if f["commit"] else ""))


def render_text(findings: DataFrame, errors: DataFrame | None = None, *, fingerprints: bool = True, totals: Mapping[str, int] | None = None) -> str:
    rows, bad = _rows(findings), _errors(errors)
    out = []
    for i, f in enumerate(rows, 1):
        out.append(f"{i}. {f['rule_id']} at {_where(f)}")
        out.append(f"   {_SEVERITY[f['severity']]}, {_CONFIDENCE[f['confidence']]}, by {f['detector']}; {f['value_length']} characters" + (f", {f['value_fingerprint']}" if fingerprints else ""))
    for rule, n in Counter(f["rule_id"] for f in rows).items():
        advice = next(f["remediation"] for f in rows if f["rule_id"] == rule)
        out += ["", *textwrap.wrap(f"{rule} ({n}): {clean(advice)}", WIDTH)]
    out += ["", *(f"error {e['code']}: {clean((e['path'] or '') + ' ' + e['reason'])}" for e in bad)] if bad else []
    read = [f"{totals['files_scanned']} texts of {totals['bytes_scanned']} bytes read"] if totals else []
    return "\n".join([*out, "", *read, f"{len(rows)} findings, {len({(f['rule_id'], f['value_fingerprint']) for f in rows})} distinct secrets, {len(bad)} errors"]) + "\n"


def render_json(findings: DataFrame, errors: DataFrame | None = None, *, fingerprints: bool = True, totals: Mapping[str, int] | None = None) -> str:
    """totals: files_scanned and bytes_scanned, where a scan knows them."""
    rows, out = _rows(findings), []
    for f in rows:
        one = {k: f[k] for k in ("rule_id", "category", "confidence", "detector", "masked_value", "value_length", "entropy")}
        one |= {"severity": _SEVERITY[f["severity"]], "location": {k: f[k] for k in ("path", "line", "column", "commit", "commit_time")}, "remediation": clean(f["remediation"])}
        if fingerprints:
            one["fingerprint"] = f["value_fingerprint"]
        if f["matched_keywords"]:
            one["matched_keywords"] = sorted(f["matched_keywords"])
        out.append(one)
    severities, confidences = (Counter(names[f[k]] for f in rows) for k, names in (("severity", _SEVERITY), ("confidence", _CONFIDENCE)))
    bad = _errors(errors)
    summary = {
        "total_findings": len(rows),
        "distinct_secrets": len({(f["rule_id"], f["value_fingerprint"]) for f in rows}),
        "by_severity": {k: severities[k] for k in X.SEVERITIES},
        "by_confidence": {k: confidences[k] for k in X.CONFIDENCES},
        "by_category": dict(sorted(Counter(f["category"] for f in rows).items())),
        "highest_severity": _SEVERITY[max(f["severity"] for f in rows)] if rows else None,
        "files_scanned": (totals or {}).get("files_scanned", 0),
        "bytes_scanned": (totals or {}).get("bytes_scanned", 0),
        "error_count": len(bad),
    }
    return json.dumps({"schema_version": VERSION, "findings": out, "errors": bad, "summary": summary}, sort_keys=True, separators=(",", ":"))


def _cell(text: str) -> str:
    return clean(re.sub(r"([|`\[\]*_#<>])", r"\\\1", text))


def render_markdown(findings: DataFrame, errors: DataFrame | None = None, *, fingerprints: bool = True, totals: Mapping[str, int] | None = None) -> str:
    rows = _rows(findings)
    counts = Counter(_SEVERITY[f["severity"]] for f in rows)
    out = ["# Findings", "", *(f"- {k}: {counts[k]}" for k in sorted(counts)), "", "| Severity | Rule | Location | Confidence | Fingerprint |", "| --- | --- | --- | --- | --- |"]
    out += [f"| {_SEVERITY[f['severity']]} | {_cell(f['rule_id'])} | {_cell(_where(f))} | {f['confidence']} | {f['value_fingerprint'] if fingerprints else ''} |" for f in rows]
    advice = dict.fromkeys(clean(f["remediation"]) for f in rows)
    out += ["", *(f"- {_cell(a)}" for a in advice)]
    out += ["", *(f"- {_cell(e['code'] or '')}: {_cell(e['reason'])}" for e in _errors(errors))]
    return "\n".join(out).rstrip() + "\n"


def render_sarif(findings: DataFrame, errors: DataFrame | None = None, rules: tuple[Rule, ...] = RULES, *, fingerprints: bool = True, totals: Mapping[str, int] | None = None) -> str:
    rows, bad = _rows(findings), _errors(errors)
    severity = {f["rule_id"]: f["severity"] for f in rows}
    names = {r.rule_id: r.name for r in rules}
    ids = sorted(severity) + (["scan-error"] if bad else [])
    index = {r: i for i, r in enumerate(ids)}
    results = []
    for f in rows:
        region = {k: v for k, v in (("startLine", f["line"]), ("startColumn", f["column"])) if v is not None}
        place = {"artifactLocation": {"uri": f["path"]}} | ({"region": region} if region else {})
        one = {"ruleId": f["rule_id"], "ruleIndex": index[f["rule_id"]], "level": X.SARIF_LEVEL[_SEVERITY[f["severity"]]], "rank": X.SARIF_RANK[_CONFIDENCE[f["confidence"]]], "message": {"text": names.get(f["rule_id"], f["rule_id"])}, "locations": [{"physicalLocation": place}]}
        one["properties"] = {"category": f["category"], "confidence": _CONFIDENCE[f["confidence"]], "detector": f["detector"], "maskedValue": f["masked_value"], "valueLength": f["value_length"]}
        if fingerprints:
            one["partialFingerprints"] = {"valueFingerprint": f["value_fingerprint"]}
        results.append(one)
    results += [{"ruleId": "scan-error", "ruleIndex": index["scan-error"], "level": "error", "message": {"text": clean(f"{e['code']}: {e['reason']}")}} for e in bad]
    described = [{"id": r, "name": names.get(r, r), "defaultConfiguration": {"level": X.SARIF_LEVEL[_SEVERITY[severity[r]]] if r in severity else "error"}} for r in ids]
    run = {"tool": {"driver": {"name": "veilsift", "rules": described}}, "invocations": [{"executionSuccessful": not bad}], "results": results}
    return json.dumps({"$schema": "https://json.schemastore.org/sarif-2.1.0.json", "version": "2.1.0", "runs": [run]}, sort_keys=True)


def write_report(path: str, text: str) -> None:
    """Write a file whole or not at all, readable by its owner only."""
    folder = os.path.dirname(os.path.abspath(path))
    handle, temporary = tempfile.mkstemp(dir=folder)
    try:
        with os.fdopen(handle, "w", encoding="utf-8") as f:
            f.write(text)
            f.flush()
            os.fsync(f.fileno())
        os.chmod(temporary, 0o600)
        os.replace(temporary, path)
    except BaseException:
        os.unlink(temporary)
        raise


RENDERERS = {"text": render_text, "json": render_json, "markdown": render_markdown, "sarif": render_sarif}
