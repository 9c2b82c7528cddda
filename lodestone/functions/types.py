"""The eight coarse logical types, and what maps to them."""

from __future__ import annotations

from pyspark.sql import types as T

BOOLEAN, INTEGER, FLOAT, STRING, OBJECT, ARRAY, NULL, MIXED = "boolean", "integer", "float", "string", "object", "array", "null", "mixed"
NUMERIC = (INTEGER, FLOAT)


def profile_type(t: T.DataType) -> str:
    """The type that a profile reports: decimals are floats; dates, times, binary and the like are strings."""
    if isinstance(t, T.BooleanType):
        return BOOLEAN
    if isinstance(t, (T.ByteType, T.ShortType, T.IntegerType, T.LongType)):
        return INTEGER
    if isinstance(t, (T.FloatType, T.DoubleType, T.DecimalType)):
        return FLOAT
    if isinstance(t, (T.StructType, T.MapType)):
        return OBJECT
    if isinstance(t, T.ArrayType):
        return ARRAY
    if isinstance(t, T.NullType):
        return NULL
    return STRING


#: Parquet inspection goes by physical type, so a timestamp stored as INT64 is an integer there.
PHYSICAL = {"BOOLEAN": BOOLEAN, "INT32": INTEGER, "INT64": INTEGER, "INT96": INTEGER, "FLOAT": FLOAT, "DOUBLE": FLOAT, "BYTE_ARRAY": STRING, "BINARY": STRING, "FIXED_LEN_BYTE_ARRAY": STRING}
