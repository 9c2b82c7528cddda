"""Column profiles.

Everything but distinct values comes from aggregations over a few columns each, which run side by side. Distinct
counts and the most frequent values share one frequency table for each column, a job each: a partial count below
the shuffle, so what moves is at most the distinct values of each task. Quantiles are exact: approximate ones bracket
them, and a second scan counts what lies below the brackets and ranks the values in them. Nothing is expanded, and the
driver only sees one row for each column, ten values and five quantiles.
"""

from __future__ import annotations

import math
import re
from concurrent.futures import ThreadPoolExecutor
from fractions import Fraction

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgs, LodestoneError, UnsupportedInput
from lodestone.functions.masking import mask, mask_column, sensitive_fragment
from lodestone.functions.types import ARRAY, BOOLEAN, FLOAT, INTEGER, NUMERIC, OBJECT, STRING, profile_type
from lodestone.sources.formats import ordered, quoted, read_typed

TOP, DECIMALS = 10, 9
#: Columns for each aggregation: few enough that its generated code is compiled. A columnar file is still read once in all.
WIDTH = 4
#: Fixed values.
QUANTILES = [("p25", 0.25), ("p50", 0.5), ("p75", 0.75), ("p90", 0.9), ("p99", 0.99)]
#: Approximate quantiles are off by a rank of rows / ACCURACY at most; exact ones are looked for MARGIN of the rows to both sides.
ACCURACY = 10_000
MARGIN = 2 / ACCURACY
ID_NAME = re.compile(r"(?i)^(id|.*_id|.*id)$")


def choose_columns(df: DataFrame, wanted: list[str] | None, what: str = "column") -> DataFrame:
    """The wanted columns in the order asked for, names compared exactly."""
    if not wanted:
        return df
    for name in wanted:
        if name not in df.columns:
            raise InvalidArgs(f"unknown {what} '{name}'", f"available: {', '.join(df.columns)}")
    return df.select(*(F.col(quoted(c)) for c in wanted))


def first_rows(df: DataFrame, path: str, fmt: str, n: int) -> DataFrame:
    """The first n rows in source order, held for all statistics that follow."""
    return ordered(df, path, fmt).orderBy("__row").limit(n).drop("__row").cache()


def types_of(df: DataFrame) -> dict[str, str]:
    return {f.name: profile_type(f.dataType) for f in df.schema.fields}


def as_text(df: DataFrame, name: str) -> Column:
    kind = types_of(df)[name]
    col = F.col(quoted(name))
    return F.to_json(col) if kind in (OBJECT, ARRAY) else col.cast("string")


def brackets(col: Column, margin: float) -> Column:
    """Approximate quantiles `margin` below and above each of QUANTILES."""
    return F.percentile_approx(col, [min(max(p + side, 0.0), 1.0) for _, p in QUANTILES for side in (-margin, margin)], ACCURACY)


def ranked(df: DataFrame, name: str, ranks: list[int], around: list[float]) -> dict[int, float]:
    """The values of a column at those of the ranks (from 1, nulls left out) that lie in the brackets `around`.

    Values in a bracket count one by one, those between two brackets together, so one task sorts 3 of 1,000 rows at most.
    """
    ends: list[list[float]] = []
    size = lambda v: (math.isnan(v), v)  # noqa: E731  # no number is the largest value
    for lo, hi in zip(around[::2], around[1::2], strict=True):
        if ends and size(lo) <= size(ends[-1][1]):
            ends[-1][1] = max(ends[-1][1], hi, key=size)
        else:
            ends.append([lo, hi])
    x = F.col("x")
    part = sum(((x >= lo).cast("int") + (x > hi).cast("int") for lo, hi in ends), F.lit(0))  # odd within a bracket
    cells = df.select(F.col(quoted(name)).cast("double").alias("x")).where("x is not null").select(part.alias("part"), "x")
    cells = cells.groupBy("part", F.when(F.col("part") % 2 == 1, x).alias("x")).agg(F.count("*").alias("n"))
    upto = cells.withColumn("upto", F.sum("n").over(Window.orderBy("part", "x")))
    holds = lambda r: (F.col("upto") >= r) & (F.col("upto") - F.col("n") < r)
    found = upto.select("x", *(holds(r).alias(str(r)) for r in sorted(set(ranks)))).where("x is not null and (" + " or ".join(f"`{r}`" for r in sorted(set(ranks))) + ")")
    return {r: row.x for row in found.collect() for r in ranks if row[str(r)]}


def exact_quantiles(df: DataFrame, name: str, rows: int, around: list[float]) -> list[float]:
    """Of `rows` values that are not null, the least that the share of each quantile does not exceed."""
    ranks = [max(1, math.ceil(Fraction(str(p)) * rows)) for _, p in QUANTILES]
    margin = MARGIN
    while margin < 8:  # from 1 on, the brackets hold all values
        found = ranked(df, name, ranks, around)
        if len(found) == len(set(ranks)):
            return [found[r] for r in ranks]
        margin = margin * 8 + 1 / ACCURACY
        around = df.agg(brackets(F.col(quoted(name)).cast("double"), margin)).first()[0]
    raise LodestoneError(f"column '{name}' changed while it was read")


def _metrics(df: DataFrame, exact: bool) -> dict[str, dict[str, Column]]:
    out: dict[str, dict[str, Column]] = {}
    for name, kind in types_of(df).items():
        col, text = F.col(quoted(name)), as_text(df, name)
        own = {"non_null": F.count(col)}
        if kind not in (OBJECT, ARRAY):
            own |= {"min": F.min(col), "max": F.max(col)}
        if kind in NUMERIC:
            own |= {"mean": F.round(F.avg(col.cast("double")), DECIMALS), "stddev": F.round(F.stddev_samp(col.cast("double")), DECIMALS)}
            own |= {"quantiles": F.percentile(col.cast("double"), [p for _, p in QUANTILES])} if exact else {"around": brackets(col.cast("double"), MARGIN)}
        elif kind == STRING:
            own |= {"length_min": F.coalesce(F.min(F.length(text)), F.lit(0)), "length_max": F.coalesce(F.max(F.length(text)), F.lit(0)), "length_mean": F.round(F.coalesce(F.avg(F.length(text)), F.lit(0.0)), DECIMALS)}
        out[name] = own
    return out


def frequencies(df: DataFrame, name: str) -> DataFrame:
    """(value, n) of every non-null value of a column: the full frequency distribution."""
    col = F.col(quoted(name))
    value = F.to_json(col) if types_of(df)[name] in (OBJECT, ARRAY) else col
    return df.select(value.alias("value")).where("value is not null").groupBy("value").agg(F.count("*").alias("n"))


def top_values(df: DataFrame, name: str, k: int = TOP) -> DataFrame:
    """The k most frequent values, equal counts by value: a bounded heap in each task, then one merge."""
    return frequencies(df, name).orderBy(F.desc("n"), F.asc("value")).limit(k)


def counts_frame(df: DataFrame) -> DataFrame:
    """One row for each column: row_count, null_count, null_percentage, distinct_count, uniqueness_percentage."""
    names = df.columns
    flat = df.agg(F.count("*").alias("__rows"), *(F.count(F.col(quoted(c))).alias(f"c{i}") for i, c in enumerate(names)))
    rows = flat.select("__rows", F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), F.col(f"c{i}").alias("n")) for i, c in enumerate(names)))).alias("x")).select("__rows", "x.*")
    distinct = None
    for c in names:
        one = frequencies(df, c).agg(F.count("*").alias("distinct_count")).select(F.lit(c).alias("column_name"), "distinct_count")
        distinct = one if distinct is None else distinct.union(one)
    share = lambda part: F.when(F.col("__rows") == 0, 0.0).otherwise(part / F.col("__rows") * 100.0)
    return rows.join(F.broadcast(distinct), "column_name").select(  # one row for each column of the table
        "column_name", F.col("__rows").alias("row_count"), (F.col("__rows") - F.col("n")).alias("null_count"), share(F.col("__rows") - F.col("n")).alias("null_percentage"),
        "distinct_count", share(F.col("distinct_count")).alias("uniqueness_percentage"),
    )


def metric_frame(df: DataFrame, wanted: list[str]) -> DataFrame:
    """One row for each column that has all wanted metrics, values as they are where all columns agree, else as text."""
    metrics = {c: {m: x for m, x in own.items() if m in wanted} for c, own in _metrics(df, True).items()}
    metrics = {c: own for c, own in metrics.items() if set(wanted) <= set(own)}
    flat = df.agg(*(x.alias(f"{i}_{m}") for i, own in enumerate(metrics.values()) for m, x in own.items()))
    kinds = {m: {flat.schema[f"{i}_{m}"].dataType.simpleString() for i in range(len(metrics))} for m in wanted}
    cell = lambda i, m: (F.col(f"{i}_{m}") if len(kinds[m]) == 1 else F.col(f"{i}_{m}").cast("string")).alias(m)
    return flat.select(F.explode(F.array(*(F.struct(F.lit(c).alias("column_name"), *(cell(i, m) for m in wanted)) for i, c in enumerate(metrics)))).alias("x")).select("x.*")


def possible_identifier(name: str, distinct: int, rows: int) -> bool:
    return (distinct == rows and rows > 0) or ID_NAME.match(name) is not None


def semantic_type(name: str, kind: str, identifier: bool) -> str | None:
    if fragment := sensitive_fragment(name):
        return fragment
    if identifier:
        return "identifier"
    return "numeric" if kind in NUMERIC else "boolean" if kind == BOOLEAN else "text" if kind == STRING else None


def _plain(value, kind: str):
    if value is None or isinstance(value, (bool, int, float, str)):
        return value
    return float(value) if kind in NUMERIC else str(value)


def frequent_frame(df: DataFrame, name: str, k: int = TOP) -> DataFrame:
    """(column_name, value, n): a column's k most frequent values, and a row with a null value and the distinct count.

    Both parts read one frequency table, whose exchange Spark runs once.
    """
    table = frequencies(df, name)
    top = table.orderBy(F.desc("n"), F.asc("value")).limit(k).select(F.lit(name).alias("column_name"), F.col("value").cast("string").alias("value"), "n")
    return top.union(table.agg(F.count("*").alias("n")).select(F.lit(name), F.lit(None).cast("string"), "n"))


def _from_text(text: str, kind: str):
    return int(text) if kind == INTEGER else float(text) if kind == FLOAT else text == "true" if kind == BOOLEAN else text


def profile(df: DataFrame, columns: list[str] | None = None, exact: bool = False, mask_identifiers: bool = False) -> list[dict]:
    """A profile of each column. Strings of sensitive columns, and of identifiers if asked for, come out masked only.

    Quantiles are values of the column: the least that a share of its values does not exceed, at the exact rank, by a state that
    has a bound. exact interpolates between neighbours instead, by a state that grows with the distinct values of a column.
    """
    df = choose_columns(df, columns)
    kinds, metrics = types_of(df), _metrics(df, exact)
    numbered = list(enumerate(metrics.values()))

    def part(lo: int) -> dict:
        aggregates = [x.alias(f"{i}_{m}") for i, own in numbered[lo : lo + WIDTH] for m, x in own.items()]
        return df.agg(F.count("*").alias("rows"), *aggregates).first().asDict()

    with ThreadPoolExecutor(8) as pool:  # jobs of a few tasks each share the cluster
        wanted = [pool.submit(lambda c=c: frequent_frame(df, c).collect()) for c in kinds]
        row = {k: v for p in pool.map(part, range(0, len(numbered), WIDTH)) for k, v in p.items()}
        if not exact:
            of = {f"{i}_quantiles": pool.submit(exact_quantiles, df, c, row[f"{i}_non_null"], row[f"{i}_around"]) for i, c in enumerate(kinds) if row.get(f"{i}_around")}
            row |= {k: q.result() for k, q in of.items()}
        frequent = [r for w in wanted for r in w.result()]
    rows = row["rows"]
    tops: dict[str, tuple[int, list]] = {c: (0, []) for c in kinds}
    for r in frequent:
        distinct, top = tops[r.column_name]
        if r.value is None:
            tops[r.column_name] = (r.n, top)
        else:
            top.append((_from_text(r.value, kinds[r.column_name]), r.n))
    tops = {c: (n, sorted(top, key=lambda t: (-t[1], t[0]))) for c, (n, top) in tops.items()}
    out = []
    for i, (name, kind) in enumerate(kinds.items()):
        got = {m: row[f"{i}_{m}"] for m in metrics[name]}
        distinct, top = tops[name]
        identifier = possible_identifier(name, distinct, rows)
        hide = sensitive_fragment(name) is not None or (mask_identifiers and identifier)
        show = lambda v, kind=kind, hide=hide: None if v is None else mask(str(_plain(v, kind))) if hide else _plain(v, kind)
        share = lambda n: n / rows * 100 if rows else 0.0
        nulls = rows - got["non_null"]
        one = {"name": name, "data_type": kind, "row_count": rows, "null_count": nulls, "null_percentage": share(nulls), "distinct_count": distinct, "uniqueness_percentage": share(distinct), "min": show(got.get("min")), "max": show(got.get("max"))}
        if kind in NUMERIC:
            q = row.get(f"{i}_quantiles")
            q = q and {k: round(v, DECIMALS) for (k, _), v in zip(QUANTILES, q, strict=True)}
            one |= {"mean": got["mean"], "median": q and q["p50"], "stddev": got["stddev"], "quantiles": q}
        if kind == STRING:
            one["string_lengths"] = {"min": got["length_min"], "max": got["length_max"], "mean": got["length_mean"]}
        one["top_values"] = [{"value": show(v), "count": n, "percentage": share(n)} for v, n in top]
        one |= {"possible_identifier": identifier, "semantic_type": semantic_type(name, kind, identifier)}
        out.append({k: v for k, v in one.items() if v is not None})
    return out


def profile_frame(df: DataFrame, columns: list[str] | None = None) -> DataFrame:
    """The profile as one row for each column; nested parts as JSON."""
    import json

    fields = ["name", "data_type", "row_count", "null_count", "null_percentage", "distinct_count", "uniqueness_percentage", "min", "max", "mean", "median", "stddev", "quantiles", "string_lengths", "top_values", "possible_identifier", "semantic_type"]
    kinds = {"row_count": "long", "null_count": "long", "null_percentage": "double", "distinct_count": "long", "uniqueness_percentage": "double", "mean": "double", "median": "double", "stddev": "double", "possible_identifier": "boolean"}
    text = lambda v: v if v is None or isinstance(v, str) else json.dumps(v, ensure_ascii=False, default=str)
    rows = [tuple(c.get(f) if f in kinds else text(c.get(f)) for f in fields) for c in profile(df, columns)]
    return df.sparkSession.createDataFrame(rows, ", ".join(f"{f} {kinds.get(f, 'string')}" for f in fields))


def masked_top_values(df: DataFrame, name: str) -> DataFrame:
    return top_values(df, name).select(mask_column(F.col("value").cast("string")).alias("value"), "n")


def profile_file(spark, path: str, fmt: str, columns: list[str] | None = None, sample: int | None = None, exact: bool = False) -> dict:
    """The profile section of a report on a CSV or Parquet file."""
    if fmt not in ("csv", "parquet"):
        raise UnsupportedInput(f"profiling {fmt} is not supported", "convert the file to CSV or Parquet")
    df = read_typed(spark, path, fmt)
    choose_columns(df, columns)
    if sample is not None:
        df = first_rows(df, path, fmt, sample)
    return {"sample_size": sample, "columns": profile(df, columns, exact)}

