"""Data-quality rules. Row rules of a table are counted together in one aggregation; set rules each add a job."""

from __future__ import annotations

from dataclasses import dataclass, field
from typing import Any

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgs
from lodestone.sources.formats import quoted


@dataclass(frozen=True)
class Rule:
    """kind: not_null, accepted_values, regex, type, range, date_range, expression (counted by row), unique, row_count, distinct_count,
    reference (a set of columns must exist in another table) or sql (no rows may come back)."""

    name: str
    kind: str
    column: str | None = None
    args: dict[str, Any] = field(default_factory=dict)
    severity: str = "error"


ROW_KINDS = ("not_null", "accepted_values", "regex", "type", "range", "date_range", "expression")


def violation(rule: Rule) -> Column:
    """Whether a row breaks a row rule. Nulls break only not_null, type and the like pass them."""
    col = F.col(quoted(rule.column)) if rule.column else F.lit(None)
    a = rule.args
    if rule.kind == "not_null":
        return col.isNull()
    if rule.kind == "accepted_values":
        return F.coalesce(~col.isin(a["values"]), F.lit(False))
    if rule.kind == "regex":
        return F.coalesce(~col.cast("string").rlike(a["pattern"]), F.lit(False))
    if rule.kind == "type":
        return col.isNotNull() & col.try_cast(a["type"]).isNull()
    if rule.kind in ("range", "date_range"):
        kind = "date" if rule.kind == "date_range" else "double"
        bound = lambda x: F.lit(x).cast(kind)
        low = (col.cast(kind) < bound(a["min"])) if a.get("min") is not None else F.lit(False)
        high = (col.cast(kind) > bound(a["max"])) if a.get("max") is not None else F.lit(False)
        return F.coalesce(low | high, F.lit(False))
    if rule.kind == "expression":
        return F.coalesce(~F.expr(a["expression"]), F.lit(False))
    raise InvalidArgs(f"rule '{rule.name}': unknown kind '{rule.kind}'", f"use one of: {', '.join(ROW_KINDS)}, unique, row_count, distinct_count, reference, sql")


def _set_rule(df: DataFrame, rule: Rule, tables: dict[str, DataFrame]) -> DataFrame:
    """(violations) of a rule that looks at more than one row."""
    a = rule.args
    columns = a.get("columns") or ([rule.column] if rule.column else [])
    cols = [F.col(quoted(c)) for c in columns]
    if rule.kind == "unique":
        groups = df.dropna(subset=columns).groupBy(*cols).agg(F.count("*").alias("n")).where("n > 1")
        return groups.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).alias("violations"))
    if rule.kind in ("row_count", "distinct_count"):
        counted = df.agg(F.count("*").alias("n")) if rule.kind == "row_count" else df.dropna(subset=columns).groupBy(*cols).count().agg(F.count("*").alias("n"))
        broken = (F.col("n") < a.get("min", 0)) | (F.col("n") > a.get("max", 2**62))
        return counted.select(broken.cast("long").alias("violations"))
    if rule.kind == "reference":
        other = tables[a["table"]].select(*(F.col(quoted(c)).alias(f"__r{i}") for i, c in enumerate(a.get("keys") or columns))).distinct()
        missing = df.dropna(subset=columns).join(other, [c == F.col(f"__r{i}") for i, c in enumerate(cols)], "left_anti")
        return missing.agg(F.count("*").alias("violations"))
    if rule.kind == "sql":
        for name, table in ({"dataset": df} | tables).items():
            table.createOrReplaceTempView(name)
        return df.sparkSession.sql(a["query"]).agg(F.count("*").alias("violations"))
    violation(rule)
    raise AssertionError


def check_rules(df: DataFrame, rules: list[Rule], tables: dict[str, DataFrame] | None = None) -> DataFrame:
    """(rule, kind, column_name, severity, rows, violations, passed) for each rule. A row rule may allow a share of violations: args max_share."""
    row_rules = [r for r in rules if r.kind in ROW_KINDS]
    flat = df.agg(F.count("*").alias("rows"), *(F.count_if(violation(r)).alias(f"v{i}") for i, r in enumerate(row_rules)))

    def line(r: Rule, rows: Column, n: Column) -> list[Column]:
        allowed = F.greatest(rows, F.lit(1)) * float(r.args.get("max_share", 0.0))
        return [F.lit(r.name).alias("rule"), F.lit(r.kind).alias("kind"), F.lit(r.column).cast("string").alias("column_name"), F.lit(r.severity).alias("severity"), rows.alias("rows"), n.cast("long").alias("violations"), (n <= allowed).alias("passed")]

    out = flat.select(F.explode(F.array(*(F.struct(*line(r, F.col("rows"), F.col(f"v{i}"))) for i, r in enumerate(row_rules)))).alias("x")).select("x.*") if row_rules else None
    for r in rules:
        if r.kind not in ROW_KINDS:
            one = _set_rule(df, r, tables or {}).select(*line(r, F.lit(None).cast("long"), F.col("violations")))
            out = one if out is None else out.union(one)
    if out is None:
        raise InvalidArgs("no rules", "give at least one rule")
    return out
