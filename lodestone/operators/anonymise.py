"""Anonymisation of columns, and of personal data within free text, as column expressions."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgs
from lodestone.functions.masking import mask_column
from lodestone.functions.validators import keep_valid
from lodestone.operators.pii import spans
from lodestone.sources.formats import quoted

METHODS = ("redact", "mask", "hash", "tokenise", "replace", "format_preserving", "pseudonym", "null")


def keyed_digest(col: Column, key: str, bits: int = 256) -> Column:
    """HMAC-SHA-256 from its definition, so that a pseudonym cannot be recomputed without the key."""
    raw = key.encode()
    if len(raw) > 64:
        import hashlib

        raw = hashlib.sha256(raw).digest()
    raw = raw.ljust(64, b"\0")
    inner, outer = (F.lit(bytes(b ^ x for b in raw)) for x in (0x36, 0x5C))
    return F.substring(F.sha2(F.concat(outer, F.unhex(F.sha2(F.concat(inner, F.encode(col, "UTF-8")), 256))), 256), 1, bits // 4)


def format_preserving(col: Column, key: str) -> Column:
    """Letters and digits give way to others of their kind, chosen by the key, the value and the place; the rest stays. Not reversible."""
    digest = keyed_digest(col, key)
    at = lambda i: F.conv(F.substring(digest, (i % 32) * 2 + 1, 2), 16, 10).cast("int")
    pick = lambda alphabet, i: F.substring(F.lit(alphabet), (at(i) % len(alphabet)) + 1, F.lit(1))
    low = "abcdefghijklmnopqrstuvwxyz"
    chars = F.filter(F.split(col, ""), lambda c: c != "")
    new = F.transform(chars, lambda c, i: F.when(c.rlike("^[0-9]$"), pick("0123456789", i)).when(c.rlike("^[a-z]$"), pick(low, i)).when(c.rlike("^[A-Z]$"), pick(low.upper(), i)).otherwise(c))
    return F.when(col.isNotNull(), F.array_join(new, ""))


def anonymise(df: DataFrame, plan: dict[str, dict]) -> DataFrame:
    """df with each column of plan treated: {"method": one of METHODS, "key": ..., "value": ..., "prefix": ...}. Nulls stay null."""
    out = {}
    for name, how in plan.items():
        if name not in df.columns:
            raise InvalidArgs(f"unknown column '{name}'", f"available: {', '.join(df.columns)}")
        col, method = F.col(quoted(name)).cast("string"), how.get("method")
        if method not in METHODS:
            raise InvalidArgs(f"unknown method '{method}' for column '{name}'", f"use one of: {', '.join(METHODS)}")
        if method in ("tokenise", "pseudonym", "format_preserving") and not how.get("key"):
            raise InvalidArgs(f"method '{method}' for column '{name}' needs a key", "give a secret key")
        present = lambda x, col=col: F.when(col.isNotNull(), x)
        out[name] = {
            "redact": lambda: present(F.lit("[REDACTED]")), "mask": lambda col=col: mask_column(col), "hash": lambda col=col: F.sha2(col, 256), "null": lambda: F.lit(None).cast("string"),
            "replace": lambda how=how: present(F.lit(how.get("value", ""))), "tokenise": lambda col=col, how=how: present(F.concat(F.lit(how.get("prefix", "tok_")), keyed_digest(col, how["key"], 128))),
            "pseudonym": lambda col=col, how=how: present(F.concat(F.lit(how.get("prefix", "person_")), keyed_digest(col, how["key"], 48))), "format_preserving": lambda col=col, how=how: format_preserving(col, how["key"]),
        }[method]()
    return df.withColumns(out)


def redact_text(col: Column, recognizers: list) -> Column:
    """Free text with every valid match of the recognisers replaced by the entity's name in brackets.

    All are found in the text as it was. Where matches overlap, they go together, under the entity whose match starts first
    (of those, the longest). Null stays null.
    """

    def named(entity: str) -> Callable[[Column], Column]:
        return lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("end"), F.lit(entity).alias("entity"))

    found = [F.transform(_valid_spans(col, r), named(r.entity)) for r in recognizers]
    ordered_spans = F.array_sort(F.concat(*found)) if found else F.array().cast("array<struct<start:int,end:int,entity:string>>")
    zero = F.struct(F.lit(0).alias("at"), F.lit("").alias("out"))

    def step(acc: Column, s: Column) -> Column:
        end = -s["end"]
        cut = F.concat(acc["out"], F.substring(col, acc["at"] + 1, s["start"] - acc["at"]), F.lit("["), s["entity"], F.lit("]"))
        return F.struct(F.greatest(acc["at"], end).alias("at"), F.when(s["start"] >= acc["at"], cut).otherwise(acc["out"]).alias("out"))

    return F.when(col.isNotNull(), F.aggregate(ordered_spans, zero, step, lambda acc: F.concat(acc["out"], F.substring(col, acc["at"] + 1, F.length(col))))).alias("redacted")


def _valid_spans(col: Column, r) -> Column:
    """The spans of a recogniser's matches that pass its validators."""
    found = spans(col, r)
    if not r.validators:
        return found
    valid = keep_valid(F.transform(found, lambda s: s["match"]), list(r.validators))
    flagged = F.transform(F.arrays_zip(found.alias("span"), F.array_repeat(valid, F.size(found)).alias("valid")), lambda x: F.struct(x["span"].alias("span"), F.array_contains(x["valid"], x["span"]["match"]).alias("ok")))
    return F.transform(F.filter(flagged, lambda x: x["ok"]), lambda x: x["span"])
