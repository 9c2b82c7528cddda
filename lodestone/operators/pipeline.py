"""Declarative pipelines: named steps over tables, planned as one graph and run only where they are needed."""

from __future__ import annotations

import time
from typing import Any

from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import InvalidArgs
from lodestone.operators.anonymise import anonymise
from lodestone.operators.quality import Rule, check_rules
from lodestone.sources.formats import detect, read_typed

OPS = ("read", "sql", "filter", "select", "anonymise", "quality", "write")


def load_steps(path: str) -> list[dict]:
    import yaml

    with open(path, encoding="utf-8") as f:
        data = yaml.safe_load(f)
    return data["steps"] if isinstance(data, dict) else data


def order_steps(steps: list[dict]) -> list[dict]:
    """The steps with each after its inputs; unknown inputs, repeated names and circles are errors."""
    by_name = {}
    for s in steps:
        if s.get("op") not in OPS or not s.get("name"):
            raise InvalidArgs(f"step {s.get('name', '?')}: unknown op '{s.get('op')}'", f"use one of: {', '.join(OPS)}")
        if s["name"] in by_name:
            raise InvalidArgs(f"step '{s['name']}' is there twice", "rename one")
        by_name[s["name"]] = s
    done: dict[str, dict] = {}
    open_: set[str] = set()

    def visit(name: str) -> None:
        if name in done:
            return
        if name not in by_name:
            raise InvalidArgs(f"unknown step '{name}'", "check the inputs")
        if name in open_:
            raise InvalidArgs(f"step '{name}' depends on itself", "break the circle")
        open_.add(name)
        for i in inputs_of(by_name[name]):
            visit(i)
        done[name] = by_name[name]

    for s in steps:
        visit(s["name"])
    return list(done.values())


def inputs_of(step: dict[str, Any]) -> list[str]:
    given = step.get("inputs", step.get("input", []))
    return [given] if isinstance(given, str) else list(given)


def run_pipeline(spark: SparkSession, steps: list[dict]) -> tuple[dict[str, DataFrame], list[dict]]:
    """(tables, manifest). Tables are lazy; steps that several others read are cached. Only write and quality run jobs.

    The manifest has an entry for each step: name, op, inputs, columns, seconds, and for quality the rules that failed.
    """
    plan = order_steps(steps)
    readers: dict[str, int] = {}
    for s in plan:
        for i in inputs_of(s):
            readers[i] = readers.get(i, 0) + 1
    tables: dict[str, DataFrame] = {}
    manifest = []
    for s in plan:
        began, extra = time.perf_counter(), {}
        ins = {i: tables[i] for i in inputs_of(s)}
        first = next(iter(ins.values()), None)
        op = s["op"]
        if op == "read":
            out = read_typed(spark, s["path"], detect(s["path"], s.get("type"), spark))
        elif op == "sql":
            for name, df in ins.items():
                df.createOrReplaceTempView(name)
            out = spark.sql(s["query"])
        elif op == "filter":
            out = first.where(s["where"])
        elif op == "select":
            out = first.selectExpr(*s["columns"])
        elif op == "anonymise":
            out = anonymise(first, s["columns"])
        elif op == "quality":
            out = first
            failed = [r.rule for r in check_rules(first, [Rule(**r) for r in s["rules"]], ins).where("not passed").collect()]
            extra = {"failed": failed}
        else:
            out = first
            first.write.mode(s.get("mode", "errorifexists")).format(s.get("format", "parquet")).save(s["path"])
        if readers.get(s["name"], 0) > 1:
            out = out.cache()
        tables[s["name"]] = out
        manifest.append({"name": s["name"], "op": op, "inputs": inputs_of(s), "columns": out.columns, "seconds": round(time.perf_counter() - began, 3)} | extra)
    return tables, manifest
