"""Schema inference, validation and comparison."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import types as T

#: Changes of type that every old value survives.
WIDENS = {("tinyint", "smallint"), ("tinyint", "int"), ("tinyint", "bigint"), ("smallint", "int"), ("smallint", "bigint"), ("int", "bigint"), ("float", "double"), ("int", "double"), ("date", "timestamp"), ("smallint", "double"), ("tinyint", "double")}
FIELDS = "column_name string, change string, before string, after string, compatible boolean"


def diff(before: T.StructType, after: T.StructType) -> list[tuple]:
    """(column, change, before, after, compatible): added, removed, type, nullability and order. Compatible: readers of the old schema still work."""
    a, b = {f.name: f for f in before.fields}, {f.name: f for f in after.fields}
    out: list[tuple] = []
    for name, f in a.items():
        if name not in b:
            out.append((name, "removed", f.dataType.simpleString(), None, False))
            continue
        g = b[name]
        x, y = f.dataType.simpleString(), g.dataType.simpleString()
        if x != y:
            out.append((name, "type", x, y, (x, y) in WIDENS))
        if f.nullable != g.nullable:
            out.append((name, "nullability", str(f.nullable).lower(), str(g.nullable).lower(), not g.nullable))
    out += [(name, "added", None, g.dataType.simpleString(), g.nullable) for name, g in b.items() if name not in a]
    shared_a, shared_b = [n for n in a if n in b], [n for n in b if n in a]
    out += [(n, "order", str(i), str(shared_b.index(n)), True) for i, n in enumerate(shared_a) if shared_b.index(n) != i]
    return out


def diff_frame(spark: SparkSession, before: T.StructType, after: T.StructType) -> DataFrame:
    return spark.createDataFrame(diff(before, after), FIELDS)


def infer(df: DataFrame) -> dict:
    return df.schema.jsonValue()


def validate(df: DataFrame, expected: T.StructType | dict) -> list[tuple]:
    """Changes from the expected schema that break it."""
    want = T.StructType.fromJson(expected) if isinstance(expected, dict) else expected
    return [d for d in diff(want, df.schema) if not d[4]]
