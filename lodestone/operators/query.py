"""SQL directly over files: quoted paths in place of tables, and a bounded result."""

from __future__ import annotations

import time
from collections.abc import Iterator
from dataclasses import dataclass, field

from pyspark.errors import AnalysisException, ParseException, PySparkException
from pyspark.sql import DataFrame, SparkSession

from lodestone.errors import InvalidArgs, LodestoneError, UnsupportedInput
from lodestone.plans.sqltext.dialects import DIALECTS
from lodestone.plans.sqltext.lexer import tokenize
from lodestone.sources.formats import from_extension, register, require

DEFAULT_LIMIT = 1000
#: Double quotes name things, as in the dialect that users of file queries write, and reserved words stay reserved.
SETTINGS = {"spark.sql.ansi.enabled": "true", "spark.sql.ansi.doubleQuotedIdentifiers": "true", "spark.sql.ansi.enforceReservedKeywords": "true"}


@dataclass
class QueryResult:
    columns: list[str]
    rows: list[tuple]
    row_count_returned: int
    total_row_count: int
    truncated: bool
    duration_ms: int
    sources: list[dict] = field(default_factory=list)

    def to_dict(self) -> dict:
        rows = [{c: v for c, v in zip(self.columns, r, strict=True) if v is not None} for r in self.rows]
        return {"columns": self.columns, "rows": rows, "row_count_returned": self.row_count_returned, "total_row_count": self.total_row_count, "truncated": self.truncated, "sources": self.sources, "duration_ms": self.duration_ms}


def resolve_files(spark: SparkSession, sql: str) -> tuple[str, list[dict]]:
    """The SQL with each quoted path in the place of a table replaced by a view of that file.

    Only CSV and Parquet serve as tables. A path used twice is registered once. A literal elsewhere, as in a
    comparison, stays a literal even if it looks like a path.
    """
    tokens = tokenize(sql, DIALECTS["ansi"])
    names: dict[str, str] = {}
    sources, out, last, taken = [], [], 0, set()
    depth_from: list[bool] = [False]
    for before, t in zip([None, *tokens], tokens, strict=False):
        word = t.upper
        if word == "(":
            depth_from.append(depth_from[-1] and before is not None and before.upper in ("FROM", "JOIN", ",", "("))
        elif word == ")" and len(depth_from) > 1:
            depth_from.pop()
        elif word in ("FROM", "JOIN"):
            depth_from[-1] = True
        elif word in ("WHERE", "GROUP", "HAVING", "ORDER", "LIMIT", "SELECT", "ON", "UNION", "EXCEPT", "INTERSECT", "WINDOW", "USING"):
            depth_from[-1] = False
        place = t.kind == "string" and before is not None and (before.upper in ("FROM", "JOIN") or (before.upper in (",", "(") and depth_from[-1]))
        if not place or (fmt := from_extension(t.text)) is None:
            continue
        if fmt not in ("csv", "parquet"):
            require(spark, t.text)
            raise UnsupportedInput(f"querying {fmt} files is not supported: {t.text}", "convert the file to CSV or Parquet")
        if t.text not in names:
            require(spark, t.text)
            names[t.text] = register(spark, t.text, fmt, taken)
            sources.append({"path": t.text, "table": names[t.text], "format": fmt})
        out.append(sql[last : t.start] + "`" + names[t.text] + "`")
        last = t.end
    return "".join(out) + sql[last:], sources


#: What ends the condition of QUALIFY, and the part of a SELECT that it belongs to.
AFTER_QUALIFY = ("WINDOW", "ORDER", "LIMIT", "OFFSET", "FETCH", "UNION", "EXCEPT", "INTERSECT", "CLUSTER", "DISTRIBUTE", "SORT")


def _level(tokens: list, at: int, step: int) -> Iterator[int]:
    """Places of the tokens before or after `at` in the same brackets."""
    depth, i = 0, at + step
    while 0 <= i < len(tokens) and depth >= 0:
        word = tokens[i].upper
        if word in "()" and word:
            depth += 1 if (word == "(") == (step > 0) else -1
        elif depth == 0:
            yield i
        i += step


def expand_qualify(sql: str) -> str:
    """QUALIFY as a filter over a subquery that computes its condition, which Spark's SQL lacks: innermost SELECTs first."""
    while True:
        tokens = tokenize(sql, DIALECTS["ansi"])
        at = next((i for i in range(len(tokens) - 1, -1, -1) if tokens[i].upper == "QUALIFY"), None)
        if at is None:
            return sql
        before = list(_level(tokens, at, -1))
        begin = next((i for i in before if tokens[i].upper == "SELECT"), None)
        source = next((i for i in reversed(before) if begin is not None and i > begin and tokens[i].upper == "FROM"), None)
        if begin is None or source is None:
            raise InvalidArgs("QUALIFY without a SELECT and FROM before it", "check the query")
        after = list(_level(tokens, at, 1))
        stop = next((i for i in after if tokens[i].upper in AFTER_QUALIFY or tokens[i].kind == "end"), None)
        stop = stop if stop is not None else next(i for i in range(after[-1] if after else at, len(tokens)) if tokens[i].upper == ")" or tokens[i].kind == "end")
        end = next((i for i in after if i > stop and (tokens[i].upper in AFTER_QUALIFY or tokens[i].kind == "end")), None) if tokens[stop].upper == "WINDOW" else stop
        if end is None:
            end = next(i for i in range(after[-1] + 1, len(tokens)) if tokens[i].upper == ")")
        place = lambda i: tokens[i].start
        items, rest, condition, window = sql[place(begin) : place(source)], sql[place(source) : place(at)], sql[tokens[at].end : place(stop)], sql[place(stop) : place(end)]
        inner = f"{items.rstrip()}, ({condition.strip()}) AS __qualified {rest.rstrip()} {window.strip()}"
        sql = f"{sql[: place(begin)]}SELECT * EXCEPT (__qualified) FROM ({inner.rstrip()}) WHERE __qualified {sql[place(end) :]}"


def expand_fetch(sql: str) -> str:
    """FETCH FIRST n ROWS ONLY, and OFFSET n ROWS, as LIMIT and OFFSET."""
    tokens = tokenize(sql, DIALECTS["ansi"])
    out, last, i = [], 0, 0
    rows = ("ROW", "ROWS")
    offset: tuple[int, str] | None = None
    while i < len(tokens):
        t = tokens[i]
        if t.upper == "OFFSET" and tokens[i + 1].kind == "number" and i + 2 < len(tokens) and tokens[i + 2].upper in rows:
            out.append(sql[last : t.start])
            offset, last, i = (i, tokens[i + 1].text), tokens[i + 2].end, i + 3
            if tokens[i].upper != "FETCH":
                out.append(f"OFFSET {offset[1]}")
            continue
        if t.upper == "FETCH" and tokens[i + 1].upper in ("FIRST", "NEXT"):
            k = i + 2
            n = tokens[k].text if tokens[k].kind == "number" else "1"
            k += tokens[k].kind == "number"
            if tokens[k].upper not in rows or tokens[k + 1].upper != "ONLY":
                raise InvalidArgs("FETCH takes FIRST n ROWS ONLY", "use LIMIT")
            out.append(sql[last : t.start] + f"LIMIT {n}" + (f" OFFSET {offset[1]}" if offset and offset[0] + 3 == i else ""))
            last, i = tokens[k + 1].end, k + 2
            continue
        i += 1
    return "".join(out) + sql[last:]


def prepare(spark: SparkSession, sql: str) -> tuple[DataFrame, list[dict]]:
    """The DataFrame that the SQL describes, not yet run. Only queries are taken: text that changes data is refused."""
    first = next((t.upper for t in tokenize(sql, DIALECTS["ansi"]) if t.upper != "("), "")
    if first not in ("SELECT", "WITH", "VALUES", "FROM"):
        raise InvalidArgs("only queries can be run", "start with SELECT or WITH")
    text, sources = resolve_files(spark, expand_fetch(expand_qualify(sql.strip().rstrip(";"))))
    held = {k: spark.conf.get(k, None) for k in SETTINGS}
    try:
        for k, v in SETTINGS.items():
            spark.conf.set(k, v)
        return spark.sql(text), sources
    except (ParseException, AnalysisException) as e:
        raise InvalidArgs(f"the query cannot be planned ({e.getCondition() or 'syntax error'})", "check table paths, column names and syntax") from e
    finally:
        for k, v in held.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def run_query(spark: SparkSession, sql: str, limit: int = DEFAULT_LIMIT, count_all: bool = True) -> QueryResult:
    """At most limit rows, in the query's order. Without count_all, the query stops as soon as limit + 1 rows are known."""
    began = time.perf_counter()
    df, sources = prepare(spark, sql)
    try:
        rows = [tuple(r) for r in df.limit(limit + 1).collect()]
        more = len(rows) > limit
        total = df.count() if more and count_all else len(rows)
    except PySparkException as e:
        raise LodestoneError(f"the query failed ({e.getCondition() or type(e).__name__})", "check the data that it reads") from e
    return QueryResult(df.columns, rows[:limit], min(len(rows), limit), total, more, round((time.perf_counter() - began) * 1000), sources)
