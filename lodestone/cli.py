"""The command line: one command, one report, one exit code."""

from __future__ import annotations

import argparse
import csv
import json
import logging
import os
import sys
import tempfile
from typing import Any

from lodestone import config
from lodestone.errors import ExitCode, InputNotFound, InvalidArgs, LodestoneError
from lodestone.report import VERSION, ReportBuilder, consolidated, to_markdown, to_yaml

COMMANDS = ["version", "capabilities", "inspect", "profile", "query", "sql parse", "sql format", "sql transpile", "sql lint", "sql lineage", "pii scan", "pii recognizers list", "pii recognizers validate", "report", "doctor"]
LOG = logging.getLogger("lodestone")


def build_parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="lodestone", description="Inspect, profile, query and scan data files.")
    top.add_argument("--output", choices=config.OUTPUTS)
    loud = top.add_mutually_exclusive_group()
    loud.add_argument("--quiet", action="store_true")
    loud.add_argument("--verbose", action="store_true")
    sub = top.add_subparsers(dest="command", required=True)
    listed = lambda s: [x for x in s.split(",") if x]
    for name in ("version", "capabilities", "doctor"):
        sub.add_parser(name)
    for name in ("inspect", "profile", "report"):
        p = sub.add_parser(name)
        p.add_argument("path")
        p.add_argument("--type")
        if name != "inspect":
            p.add_argument("--columns", type=listed)
            p.add_argument("--sample", type=int)
        if name == "report":
            p.add_argument("--as", dest="style", choices=("json", "yaml", "markdown"), default="json")
    p = sub.add_parser("query")
    p.add_argument("sql")
    p.add_argument("--limit", type=int, default=1000)
    sql = sub.add_parser("sql").add_subparsers(dest="action", required=True)
    for name in ("parse", "format", "transpile", "lint", "lineage"):
        p = sql.add_parser(name)
        p.add_argument("path")
        if name == "transpile":
            p.add_argument("--from", dest="source", required=True)
            p.add_argument("--to", required=True)
        else:
            p.add_argument("--dialect")
        if name == "format":
            p.add_argument("--write", action="store_true")
    pii = sub.add_parser("pii").add_subparsers(dest="action", required=True)
    p = pii.add_parser("scan")
    p.add_argument("path")
    p.add_argument("--type")
    p.add_argument("--sample", type=int)
    p.add_argument("--field", type=listed)
    p.add_argument("--recognizers")
    p.add_argument("--fail-on", type=float)
    own = pii.add_parser("recognizers").add_subparsers(dest="what", required=True)
    own.add_parser("list")
    own.add_parser("validate").add_argument("path")
    return top


def session():
    from pyspark.sql import SparkSession

    spark = SparkSession.builder.appName("lodestone").config("spark.ui.enabled", "false").config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    spark.sparkContext.setLogLevel("ERROR")
    return spark


def _text(path: str) -> str:
    if path == "-":
        return sys.stdin.read()
    try:
        with open(path, encoding="utf-8") as f:
            return f.read()
    except OSError as e:
        raise InputNotFound(f"{path} cannot be read", "check the path") from e


def _table(rows: list[list[Any]], head: list[str]) -> str:
    cells = [head, *([("null" if c is None else str(c)) for c in r] for r in rows)]
    width = [max(len(r[i]) for r in cells) for i in range(len(head))]
    line = lambda r: "| " + " | ".join(c.ljust(w) for c, w in zip(r, width, strict=True)) + " |"
    return "\n".join([line(cells[0]), "|" + "|".join("-" * (w + 2) for w in width) + "|", *map(line, cells[1:])])


class App:
    def __init__(self, args: argparse.Namespace, output: str, out=None):
        self.args, self.output, self.out, self.builder = args, output, out or sys.stdout, ReportBuilder()

    def say(self, text: str) -> None:
        print(text, file=self.out)

    def emit(self, text: str) -> None:
        """The report as JSON, or the text for people. CSV is for query rows alone."""
        if self.output == "csv":
            raise InvalidArgs("CSV output is for query only", "use --output json or table")
        self.say(json.dumps(self.builder.build(), ensure_ascii=False, indent=2, default=str) if self.output == "json" else text)

    def _open(self) -> tuple[Any, str]:
        from lodestone.sources.formats import content_hash, detect, is_remote, require

        a = self.args
        if a.path == "-" and a.command != "inspect":
            raise InvalidArgs(f"{a.command} does not read standard input", "give a path")
        fmt = detect(a.path, a.type, session() if is_remote(a.path) and not a.type else None)
        path = a.path
        if path == "-":
            with tempfile.NamedTemporaryFile("wb", suffix=f".{fmt}", delete=False) as f:
                f.write(sys.stdin.buffer.read())
            path = f.name
            if fmt == "parquet":
                raise InvalidArgs("Parquet cannot be read from standard input", "give a path")
        else:
            require(session() if is_remote(path) else None, path)
        self.builder.on(a.path, fmt, content_hash(path) if a.path != "-" and os.path.isfile(path) else None)
        return path, fmt

    def version(self) -> ExitCode:
        self.builder.extension("version", {"version": VERSION})
        self.emit(f"lodestone {VERSION}")
        return ExitCode.SUCCESS

    def capabilities(self) -> ExitCode:
        from lodestone.operators.pii import BUILTINS
        from lodestone.plans.sqltext.dialects import DIALECTS
        from lodestone.sources.formats import FORMATS

        body = {"commands": COMMANDS, "formats": FORMATS, "dialects": list(DIALECTS), "recognizers": [r.id for r in BUILTINS]}
        self.builder.extension("capabilities", body)
        self.emit("\n".join(f"{k}: {', '.join(v)}" for k, v in body.items()))
        return ExitCode.SUCCESS

    def doctor(self) -> ExitCode:
        spark = session()
        body = {"python": sys.version.split()[0], "spark": spark.version, "java": spark._jvm.System.getProperty("java.version"), "master": spark.sparkContext.master, "adaptive": spark.conf.get("spark.sql.adaptive.enabled"), "shuffle_partitions": spark.conf.get("spark.sql.shuffle.partitions")}
        self.builder.extension("doctor", body)
        self.emit("\n".join(f"{k}: {v}" for k, v in body.items()))
        return ExitCode.SUCCESS

    def inspect(self) -> ExitCode:
        from lodestone.operators.inspect import humanize_bytes, inspect

        path, fmt = self._open()
        d = inspect(session(), path, fmt)
        if path != self.args.path:
            d["file_size_bytes"] = 0
            os.unlink(path)
        self.builder.section("dataset", d)
        names = [c["name"] for c in d["schema"]]
        parts = [f"format:       {d['format']}", f"file size:    {humanize_bytes(d['file_size_bytes'])}", f"row count:    {d['row_count']}", f"column count: {d['column_count']}", _table([[c["name"], c["data_type"], str(c["nullable"]).lower()] for c in d["schema"]], ["name", "type", "nullable"])]
        if d.get("parquet"):
            parts.append(f"row groups: {len(d['parquet']['row_groups'])}, compression: {', '.join(d['parquet']['compression_codecs'])}")
        if d["sample_rows"]:
            parts.append(_table([[r.get(n) for n in names] for r in d["sample_rows"]], names))
        self.emit("\n".join(parts))
        return ExitCode.SUCCESS

    def profile(self) -> ExitCode:
        from lodestone.operators.profile import profile_file

        path, fmt = self._open()
        body = profile_file(session(), path, fmt, self.args.columns, self.args.sample)
        self.builder.section("profile", body)
        head = ["name", "data_type", "null_percentage", "distinct_count", "min", "max", "mean", "semantic_type"]
        self.emit(_table([[c.get(h) for h in head] for c in body["columns"]], head))
        return ExitCode.SUCCESS

    def query(self) -> ExitCode:
        from lodestone.operators.query import run_query

        if self.args.limit < 0:
            raise InvalidArgs("--limit is negative", "give a number of rows")
        r = run_query(session(), self.args.sql, self.args.limit)
        if self.output == "csv":
            w = csv.writer(self.out, lineterminator="\n")
            w.writerow(r.columns)
            w.writerows([["" if v is None else v for v in row] for row in r.rows])
            return ExitCode.SUCCESS
        self.builder.extension("query", r.to_dict())
        self.emit(_table([list(x) for x in r.rows], r.columns) + (f"\n{r.row_count_returned} of {r.total_row_count} rows" if r.truncated else ""))
        return ExitCode.SUCCESS

    def sql(self) -> ExitCode:
        from lodestone.plans.sqltext import api

        a = self.args
        text = _text(a.path)
        if a.action == "transpile":
            body = api.transpile(text, a.source, a.to)
            self.builder.extension("sql_transpile", body).status("warning" if body["warnings"] else "success", warnings=len(body["warnings"]))
            for w in body["warnings"] if self.output != "json" else []:
                print(f"warning: {w['message']}", file=sys.stderr)
            self.emit(body["sql"])
        elif a.action == "format":
            formatted = api.format_sql(text, a.dialect)
            if a.write:
                if a.path == "-":
                    raise InvalidArgs("--write needs a file", "give a path")
                with open(a.path, "w", encoding="utf-8") as f:
                    f.write(formatted + "\n")
            self.builder.extension("sql_format", {"sql": formatted, "written": a.write})
            self.emit(formatted)
        elif a.action == "parse":
            body = api.parse(text, a.dialect)
            self.builder.extension("sql_parse", body)
            self.emit("\n".join(f"{k}: {json.dumps(v, ensure_ascii=False)}" for k, v in body.items() if k != "ast"))
        else:
            body = getattr(api, a.action)(text, a.dialect)
            self.builder.extension(f"sql_{a.action}", body)
            self.emit(json.dumps(body, ensure_ascii=False, indent=2))
        return ExitCode.SUCCESS

    def pii(self) -> ExitCode:
        from lodestone.operators import pii

        a = self.args
        if a.action == "recognizers":
            if a.what == "list":
                rows = [r.summary() for r in pii.BUILTINS]
                self.builder.extension("pii_recognizers", rows)
                self.emit(_table([list(r.values()) for r in rows], list(rows[0])))
            else:
                n = len(pii.load_recognizers(a.path))
                self.builder.extension("recognizers_validate", {"path": a.path, "valid": True, "count": n})
                self.emit(f"{n} valid recognizers in {a.path}")
            return ExitCode.SUCCESS
        pii.gate([], a.fail_on)
        path, fmt = self._open()
        known = pii.merge(pii.BUILTINS, pii.load_recognizers(a.recognizers)) if a.recognizers else pii.BUILTINS
        body = pii.scan_file(session(), path, fmt, a.field, a.sample, known)
        self.builder.section("pii", body).status("warning" if body["findings"] else "success", warnings=len(body["findings"]))
        head = ["column", "entity", "confidence", "match_count", "reason"]
        self.emit(_table([[f[h] for h in head] for f in body["findings"]], head))
        return pii.gate(body["findings"], a.fail_on)

    def report(self) -> ExitCode:
        from lodestone.operators.pii import scan_file
        from lodestone.operators.profile import profile_file

        path, fmt = self._open()
        spark = session()
        held = self.builder.input
        self.builder = consolidated(profile_file(spark, path, fmt, self.args.columns, self.args.sample), scan_file(spark, path, fmt, self.args.columns, self.args.sample))
        self.builder.input = held
        done = self.builder.build()
        self.say({"yaml": to_yaml, "markdown": to_markdown, "json": lambda d: json.dumps(d, ensure_ascii=False, indent=2, default=str)}[self.args.style](done))
        return ExitCode.SUCCESS


def main(argv: list[str] | None = None, out=None) -> int:
    try:
        args = build_parser().parse_args(argv)
    except SystemExit as e:
        return int(ExitCode.SUCCESS if not e.code else ExitCode.INVALID_ARGS)
    logging.basicConfig(stream=sys.stderr, level=logging.ERROR if args.quiet else logging.DEBUG if args.verbose else logging.WARNING)
    output = args.output
    try:
        output = args.output or config.load().output or "table"
        return int(getattr(App(args, output, out), args.command)())
    except LodestoneError as e:
        print(json.dumps(e.to_dict()) if output == "json" else f"error: {e}\n{e.remediation}", file=sys.stderr)
        return int(e.exit_code)


if __name__ == "__main__":
    sys.exit(main())
