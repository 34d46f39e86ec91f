"""Reports as text, for findings of a bounded scan: these collect. Large results are written with write_findings."""

from __future__ import annotations

import json
from collections.abc import Sequence

from pyspark.sql import DataFrame, Row
from pyspark.sql import functions as F

from gleanguard.operators import report
from gleanguard.operators.schema import ORDER
from gleanguard.plans.levels import SEVERITIES
from gleanguard.sinks import rows

TOOL = "gleanguard"
#: Fixed value: the schema that the static-analysis format names.
SARIF_SCHEMA = "https://raw.githubusercontent.com/oasis-tcs/sarif-spec/master/Schemata/sarif-schema-2.1.0.json"


def write_findings(findings: DataFrame, path: str) -> None:
    """JSON lines, one file for each task."""
    rows.json_findings(findings).write.mode("overwrite").option("ignoreNullFields", True).json(path)


def write_annotations(findings: DataFrame, path: str, least: str = "info") -> None:
    rows.annotation_lines(rows.annotations(findings, least)).write.mode("overwrite").text(path)


def _cut(text: str, n: int) -> str:
    raw = text.encode()
    return text if len(raw) <= n else raw[:n].decode("utf-8", "ignore") + "..."


def _ordered(findings: DataFrame) -> list[Row]:
    return findings.orderBy(*ORDER).collect()


def _named(severity: int) -> str:
    return SEVERITIES[severity - 1] if 1 <= severity <= len(SEVERITIES) else "unknown"


def text(findings: DataFrame, verbose: bool = False) -> str:
    total = report.risk(findings).first()
    out = [total["summary"], ""]
    found = _ordered(findings)
    if not found:
        return "\n".join(out) + "\n"
    out += ["Findings:", ""]
    for f in found:
        out += [f"  [{f['action'] or ''}] {f['type']}", f"        File: {f['file']}:{f['line']}"]
        if f["source_line"]:
            out.append(f"        Line: {_cut(f['source_line'], 80)}")
        if verbose:
            out.append(f"        Value: {_cut(f['value'] or '', 60)}")
            if f["context"]:
                out += ["        Context:", *(f"          {x}" for x in f["context"].rstrip("\n").split("\n"))]
        out += [f"        Severity: {_named(f['severity'])} | Confidence: {f['confidence'] * 100:.0f}%", ""]
    if total["reasons"]:
        out += ["Risk factors:", *(f"  \u2022 {r}" for r in total["reasons"]), ""]
    out.append("Boundary checks:")
    out += [f"  {name + ':':<20} {'\u2713 Safe' if total['safe_to_share'][name] else '\u26a0 Unsafe'}" for name, _ in report.BOUNDARIES]
    return "\n".join(out) + "\n"


def _escaped(value) -> str:
    return json.dumps(value, indent=2, ensure_ascii=False).replace("<", "\\u003c").replace(">", "\\u003e").replace("&", "\\u0026").replace("\u2028", "\\u2028").replace("\u2029", "\\u2029")


def as_json(findings: DataFrame, boundaries: Sequence[str] = ()) -> str:
    total = report.risk(findings).first()
    found = [{k: v for k, v in r.asDict().items() if v is not None or k not in ("value", "context", "source_line")} for r in rows.json_findings(findings.orderBy(*ORDER)).collect()]
    for f in found:
        f["action"] = f["action"] or ""
    return _escaped({
        "risk_score": total["risk_score"], "summary": total["summary"], "findings": found or None, "reasons": total["reasons"] or None,
        "safe_to_share": total["safe_to_share"], "boundaries": list(boundaries) or None,
    }) + "\n"


def sarif(findings: DataFrame, version: str = "0.1.0", uri: str = "") -> str:
    rules = [
        {"id": r["rule_id"], "name": r["name"], "description": {"text": r["description"]}, "defaultConfiguration": {"level": r["level"]}}
        for r in rows.sarif_rules(findings).orderBy("rule_index").collect()
    ]
    results = [
        {
            "ruleId": r["rule_id"], "level": r["level"], "message": {"text": r["message"]},
            "locations": [{"physicalLocation": {"artifactLocation": {"uri": r["uri"]}, "region": {"startLine": r["start_line"], "startColumn": r["start_column"]}}}],
            "ruleIndex": r["rule_index"],
        }
        for r in rows.sarif_results(findings).orderBy("uri", "detector_ord", "rule_ord", "pattern_ord", "match_ord").collect()
    ]
    driver = {"name": TOOL, "version": version} | ({"rules": rules} if rules else {}) | {"informationUri": uri}
    return _escaped({"$schema": SARIF_SCHEMA, "version": "2.1.0", "runs": [{"tool": {"driver": driver}, "results": results or None}]}) + "\n"


#: The dashboard's title and how wide it is, files named for a rule.
_TITLE, _WIDE, _NAMED = "Rule Health Dashboard", 60, 5


def dashboard(findings: DataFrame, shown: int = 20, verbose: bool = False) -> str:
    stats = report.top_rules(findings, shown).collect()
    total = findings.agg(F.count("*").alias("n"), F.count_distinct("file").alias("files"), F.count_distinct("rule_id").alias("rules")).first()
    by = {r["severity"]: r["findings"] for r in report.severity_histogram(findings).collect()}
    out = ["╔" + "═" * _WIDE + "╗", "║" + (" " * 18 + _TITLE).ljust(_WIDE) + "║", "╚" + "═" * _WIDE + "╝", ""]
    out += [f"  Total Findings: {total['n']}", f"  Files Affected: {total['files']}", "", "  Severity Distribution:"]
    out += [f"    {SEVERITIES[s - 1]:<10} {by[s]:3d} {'█' * min(by[s], 30)}" for s in range(5, 0, -1) if by.get(s)]
    out += ["", "  Top Rules:", f"  {'RULE':<20} {'HITS':<8} {'CONF':<6} {'FILES':<10}", "  " + "-" * 50]
    out += [f"  {_short(r['rule_id']):<20} {r['hits']:<8d} {r['avg_confidence']:<6.2f} {r['files']:<10d}" for r in stats]
    if total["rules"] > shown:
        out.append(f"  ... and {total['rules'] - shown} more rules")
    if verbose:
        out += ["", "  Detailed Rule Stats:"]
        for r in report.rule_files(findings, _NAMED).collect():
            names = list(r["some_files"]) + ([f"... and {r['files'] - _NAMED} more"] if r["files"] > _NAMED else [])
            out += [f"    {r['rule_name']} ({r['rule_id']})", f"      Hits: {r['hits']}, Avg Confidence: {r['avg_confidence']:.2f}", f"      Files: {r['files']}", f"      {', '.join(names)}"]
    return "\n".join(out) + "\n"


def _short(rule: str) -> str:
    return rule[:15] + "..." if len(rule) > 18 else rule


def workflow_summary(findings: DataFrame, least: str = "info") -> str:
    found = rows.annotations(findings, least).orderBy("path", "detector_ord", "rule_ord", "pattern_ord", "match_ord").collect()
    if not found:
        return "No secrets detected!\n"
    errors = sum(a["level"] == "error" for a in found)
    out = ["## Scan Results", "", f"Found **{len(found)}** potential secrets:", ""]
    out += [f"- \U0001f534 **{errors}** high severity"] if errors else []
    out += [f"- \U0001f7e1 **{len(found) - errors}** medium/low severity"] if errors < len(found) else []
    out += ["", "| Severity | File | Line | Rule | Message |", "|----------|------|------|------|---------|"]
    for a in found:
        rule = a["message"][1 : a["message"].index("]")]
        message = a["message"] if len(a["message"].encode()) <= 60 else a["message"].encode()[:57].decode("utf-8", "ignore") + "..."
        out.append(f"| {'\U0001f534' if a['level'] == 'error' else '\U0001f7e1'} | `{a['path']}` | {a['line']} | {rule} | {message} |")
    return "\n".join(out) + "\n"
