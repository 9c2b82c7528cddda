"""The report envelope: one versioned JSON document for every command."""

from __future__ import annotations

import json
import os
import time
from datetime import UTC, datetime
from typing import Any

VERSION, SCHEMA_VERSION, TOOL = "0.1.0", "1.0", "lodestone"
SECTIONS = ("dataset", "profile", "pii", "quality", "schema", "lineage", "policy", "evidence")


def uuid7() -> str:
    """A time-ordered identifier: 48 bits of milliseconds, version 7, random rest."""
    ms = int(time.time() * 1000)
    n = (ms << 80) | int.from_bytes(os.urandom(10), "big")
    n = n & ~(0xF << 76) | (7 << 76)
    n = n & ~(0x3 << 62) | (2 << 62)
    h = f"{n:032x}"
    return f"{h[:8]}-{h[8:12]}-{h[12:16]}-{h[16:20]}-{h[20:]}"


class ReportBuilder:
    """Times a run from its construction on; absent parts leave no key."""

    def __init__(self) -> None:
        self.began, self.clock = datetime.now(UTC), time.perf_counter()
        self.input: dict | None = None
        self.summary = {"status": "success", "errors": 0, "warnings": 0, "info": 0}
        self.sections: dict[str, Any] = {}
        self.extensions: dict[str, Any] = {}

    def on(self, uri: str, fmt: str, content_hash: str | None = None) -> ReportBuilder:
        self.input = {"uri": uri, "format": fmt} | ({"content_hash": content_hash} if content_hash else {})
        return self

    def section(self, name: str, body: Any) -> ReportBuilder:
        assert name in SECTIONS
        self.sections[name] = body
        return self

    def extension(self, name: str, body: Any) -> ReportBuilder:
        self.extensions[name] = body
        return self

    def status(self, status: str, errors: int = 0, warnings: int = 0, info: int = 0) -> ReportBuilder:
        self.summary = {"status": status, "errors": errors, "warnings": warnings, "info": info}
        return self

    def build(self) -> dict:
        stamp = lambda d: d.isoformat().replace("+00:00", "Z")
        run = {"id": uuid7(), "started_at": stamp(self.began), "completed_at": stamp(datetime.now(UTC)), "duration_ms": round((time.perf_counter() - self.clock) * 1000)}
        out: dict[str, Any] = {"schema_version": SCHEMA_VERSION, "tool": {"name": TOOL, "version": VERSION}, "run": run}
        if self.input:
            out["input"] = self.input
        out["summary"] = self.summary
        out |= {s: self.sections[s] for s in SECTIONS if s in self.sections}
        if self.extensions:
            out["extensions"] = dict(sorted(self.extensions.items()))
        return out


def consolidated(profile: dict | None, pii: dict | None, policies: list[dict] | None = None) -> ReportBuilder:
    """Profile and personal-data findings in one report; the status is the worst of its parts."""
    from lodestone.operators.policy import evaluate_policies

    b = ReportBuilder()
    for name, part in (("profile", profile), ("pii", pii)):
        if part is not None:
            b.section(name, part)
    warnings = len((pii or {}).get("findings", []))
    errors = 0
    if policies:
        results = evaluate_policies(b.sections, policies)
        b.section("policy", {"results": results})
        errors = sum(r["severity"] == "error" for r in results)
        warnings += sum(r["severity"] == "warning" for r in results)
    return b.status("failed" if errors else "warning" if warnings else "success", errors, warnings)


def to_yaml(report: dict) -> str:
    import yaml

    return yaml.safe_dump(json.loads(json.dumps(report, default=str)), sort_keys=False, allow_unicode=True)


def to_markdown(report: dict) -> str:
    """The profile and the findings as tables."""
    out = [f"# Report {report['run']['id']}", "", f"Status: {report['summary']['status']}"]
    if report.get("profile"):
        out += ["", "## Profile", "", "| column | type | nulls | distinct | semantic type |", "|---|---|---|---|---|"]
        out += [f"| {c['name']} | {c['data_type']} | {c['null_percentage']:.1f}% | {c['distinct_count']} | {c.get('semantic_type', '')} |" for c in report["profile"]["columns"]]
    if report.get("pii"):
        out += ["", "## Personal data", "", "| column | entity | confidence | matches |", "|---|---|---|---|"]
        out += [f"| {f['column']} | {f['entity']} | {f['confidence']:.2f} | {f['match_count']} |" for f in report["pii"]["findings"]]
    return "\n".join(out) + "\n"


def _object(required: dict[str, dict], optional: dict[str, dict] | None = None) -> dict:
    return {"type": "object", "properties": required | (optional or {}), "required": list(required)}


def json_schema() -> dict:
    """The JSON Schema of the envelope."""
    text, whole, number, flag = {"type": "string"}, {"type": "integer", "minimum": 0}, {"type": "number"}, {"type": "boolean"}
    many = lambda x: {"type": "array", "items": x}
    column = _object({"name": text, "data_type": text, "row_count": whole, "null_count": whole, "null_percentage": number, "distinct_count": whole, "uniqueness_percentage": number, "top_values": many(_object({"value": {}, "count": whole, "percentage": number})), "possible_identifier": flag}, {"min": {}, "max": {}, "mean": number, "median": number, "stddev": number, "quantiles": {"type": "object"}, "string_lengths": _object({"min": whole, "max": whole, "mean": number}), "semantic_type": text})
    finding = _object({"column": text, "entity": text, "recognizer": text, "confidence": number, "match_count": whole, "match_percentage": number, "sample_evidence": many(text), "reason": text})
    dataset = _object({"format": text, "file_size_bytes": whole, "row_count": whole, "column_count": whole, "schema": many(_object({"name": text, "data_type": text, "nullable": flag})), "approx_memory_bytes": whole, "sample_rows": many({"type": "object"})}, {"parquet": {"type": "object"}})
    body = _object(
        {"schema_version": {"const": SCHEMA_VERSION}, "tool": _object({"name": text, "version": text}), "run": _object({"id": text, "started_at": text, "completed_at": text, "duration_ms": whole}), "summary": _object({"status": {"enum": ["success", "warning", "failed"]}, "errors": whole, "warnings": whole, "info": whole})},
        {"input": _object({"uri": text, "format": text}, {"content_hash": text}), "dataset": dataset, "profile": _object({"sample_size": {"type": ["integer", "null"]}, "columns": many(column)}), "pii": _object({"scanned_rows": whole, "findings": many(finding)}, {"sample_size": whole}), "extensions": {"type": "object"}} | {s: {"type": "object"} for s in ("quality", "schema", "lineage", "policy", "evidence")},
    )
    return {"$schema": "https://json-schema.org/draft/2020-12/schema", "title": "Report", **body}
