"""Policies over a report: when a condition holds of a section's entries, requirements must hold too."""

from __future__ import annotations

from typing import Any

from lodestone.errors import InvalidArgs

OPS = {"eq": lambda a, b: a == b, "ne": lambda a, b: a != b, "gt": lambda a, b: a is not None and a > b, "gte": lambda a, b: a is not None and a >= b, "lt": lambda a, b: a is not None and a < b, "lte": lambda a, b: a is not None and a <= b, "in": lambda a, b: a in b, "exists": lambda a, b: (a is not None) == b, "contains": lambda a, b: a is not None and b in a}
SEVERITIES = ("info", "warning", "error")


def _holds(entry: dict, condition: dict[str, Any], who: str) -> bool:
    """All of {"field": value} or {"field": {"op": value}}; a dotted field looks inside."""
    for field, want in condition.items():
        value: Any = entry
        for part in field.split("."):
            value = value.get(part) if isinstance(value, dict) else None
        for op, operand in want.items() if isinstance(want, dict) else [("eq", want)]:
            if op not in OPS:
                raise InvalidArgs(f"policy '{who}': unknown operator '{op}'", f"use one of: {', '.join(OPS)}")
            if not OPS[op](value, operand):
                return False
    return True


def entries(report: dict, section: str) -> list[dict]:
    part = report.get(section) or {}
    return part.get("columns") or part.get("findings") or part.get("results") or part.get("schema") or ([part] if part else [])


def evaluate_policies(report: dict, policies: list[dict]) -> list[dict]:
    """Violations of policies {"id", "section", "when", "require", "severity"} over a report, in order."""
    out = []
    for p in policies:
        who = p.get("id", "?")
        if p.get("severity", "error") not in SEVERITIES:
            raise InvalidArgs(f"policy '{who}': unknown severity", f"use one of: {', '.join(SEVERITIES)}")
        for e in entries(report, p.get("section", "profile")):
            if _holds(e, p.get("when", {}), who) and not _holds(e, p.get("require", {}), who):
                out.append({"policy": who, "severity": p.get("severity", "error"), "subject": e.get("name") or e.get("column") or p.get("section", "profile"), "message": p.get("message", f"does not meet {p.get('require', {})}")})
    return out
