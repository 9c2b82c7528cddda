"""Validators of candidate matches, as column expressions where SQL can say it and on Arrow batches where not.

IPv6 literals and URLs need a parser. They first pass a cheap expression that no valid value fails, so that the
Arrow step sees few values.
"""

from __future__ import annotations

import ipaddress
from collections.abc import Callable
from urllib.parse import urlsplit

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

#: Fixed values.
BAD_SSN_AREAS, BAD_ZIPS = ["000", "666"], ["00000", "99999"]
NAMES = ["luhn", "ipv4", "ipv6", "url", "us_ssn", "uuid", "us_zip", "aba", "iban", "birth_date"]


def _digits(x: Column) -> Column:
    return F.regexp_replace(x, "[^0-9]", "")


def luhn(x: Column) -> Column:
    digits = _digits(x)
    return ~x.rlike("[^0-9 -]") & F.length(digits).between(13, 19) & F.call_function("luhn_check", digits)


def ipv4(x: Column) -> Column:
    octet = "(25[0-5]|2[0-4][0-9]|1[0-9]{2}|[1-9]?[0-9])"
    return x.rlike(rf"^{octet}(\.{octet}){{3}}$")


def is_ipv6(x: str) -> bool:
    try:
        ipaddress.IPv6Address(x)
    except ValueError:
        return False
    return "%" not in x


def is_url(x: str) -> bool:
    try:
        parts = urlsplit(x)
        host = parts.hostname
        _ = parts.port  # raises if it is not a port
    except ValueError:
        return False
    return bool(parts.scheme and host) and not any(c in host for c in " #%<>[]^|\\\"`{}" if not host.startswith("[")) and (":" not in host or is_ipv6(host))


def us_ssn(x: Column) -> Column:
    d = _digits(x)
    return (F.length(d) == 9) & ~F.substring(d, 1, 3).isin(BAD_SSN_AREAS) & (F.substring(d, 1, 3) < "900")


def uuid(x: Column) -> Column:
    return F.regexp_replace(x, "-", "").rlike("(?i)^[0-9a-f]{12}[1-5][0-9a-f]{3}[89ab][0-9a-f]{15}$")


def us_zip(x: Column) -> Column:
    return ~F.substring(x, 1, 5).isin(BAD_ZIPS)


def aba(x: Column) -> Column:
    d = _digits(x)
    n = lambda i: F.substring(d, i, 1).cast("int")
    total = 3 * (n(1) + n(4) + n(7)) + 7 * (n(2) + n(5) + n(8)) + n(3) + n(6) + n(9)
    return F.when(F.length(d) == 9, (total % 10 == 0) & (d != "000000000")).otherwise(False)


def iban(x: Column) -> Column:
    """ISO 13616: with the first four characters at the end and letters as numbers, the remainder by 97 is 1."""
    bare = F.upper(F.regexp_replace(x, " ", ""))
    moved = F.concat(F.substring(bare, 5, 64), F.substring(bare, 1, 4))
    value = lambda c: F.when(c.rlike("^[0-9]$"), c.cast("int")).otherwise(F.ascii(c) - 55)
    step = lambda acc, c: (acc * F.when(value(c) > 9, 100).otherwise(10) + value(c)) % 97
    return F.when(bare.rlike("^[A-Z]{2}[0-9]{2}[A-Z0-9]{11,30}$"), F.aggregate(F.split(moved, ""), F.lit(0), lambda a, c: F.when(c == "", a).otherwise(step(a, c))) == 1).otherwise(False)


def birth_date(x: Column) -> Column:
    d = F.coalesce(F.try_to_date(x, "yyyy-MM-dd"), F.try_to_date(x, "MM/dd/yyyy"))
    return F.coalesce((d >= F.lit("1900-01-01").cast("date")) & (d <= F.current_date()), F.lit(False))


EXPRESSIONS = {"luhn": luhn, "ipv4": ipv4, "us_ssn": us_ssn, "uuid": uuid, "us_zip": us_zip, "aba": aba, "iban": iban, "birth_date": birth_date}
#: For the parsed ones: a condition that every valid value meets, and the test of a single value.
PARSED = {"ipv6": (lambda x: x.contains("::") | (F.length(x) - F.length(F.replace(x, F.lit(":"))) >= 6), is_ipv6), "url": (lambda x: x.contains(":"), is_url)}


def _tested(test: Callable[[str], bool]) -> Callable[[Column], Column]:
    @F.pandas_udf("array<string>")
    def parsed(values: pd.Series) -> pd.Series:
        return values.map(lambda v: None if v is None else [x for x in v if test(x)])

    return parsed


def _holding(expression: Callable[[Column], Column]) -> Callable[[Column], Column]:
    return lambda x: F.coalesce(expression(x), F.lit(False))


def keep_valid(candidates: Column, validators: list[str]) -> Column:
    """The elements of an array of strings that pass all validators."""
    out = candidates
    for name in validators:
        if name in EXPRESSIONS:
            out = F.filter(out, _holding(EXPRESSIONS[name]))
    for name in validators:
        if name in PARSED:
            quick, test = PARSED[name]
            out = F.filter(out, quick)
            some = F.size(out) > 0
            out = F.when(some, _tested(test)(F.when(some, out))).otherwise(out)
    return out
