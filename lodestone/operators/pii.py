"""Personal-data scans: recognisers of patterns, validators and context, with a confidence that follows from them.

A scan is one projection, which finds and validates candidates of every column and recogniser. Its hits are held, since
one aggregation counts them and a ranking that is cut before its shuffle takes the first rows of each as
evidence. What static types rule out is not searched for.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterable
from dataclasses import dataclass

from pyspark import SparkContext
from pyspark.errors import IllegalArgumentException
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from lodestone.errors import ExitCode, InputNotFound, InvalidArgs, UnsupportedInput
from lodestone.functions.masking import mask
from lodestone.functions.validators import NAMES, keep_valid
from lodestone.operators.profile import choose_columns
from lodestone.sources.formats import ordered, quoted, read_typed, spread

VALIDATOR_BONUS, CONTEXT_BONUS, EVIDENCE = 0.10, 0.05, 3


@dataclass(frozen=True)
class Recognizer:
    id: str
    entity: str
    base: float
    patterns: tuple[str, ...]
    context: tuple[str, ...] = ()
    validators: tuple[str, ...] = ()
    builtin: bool = False

    def context_term(self, column: str) -> str | None:
        """The first term, as listed, that the column's name contains in any case."""
        low = column.lower()
        return next((t for t in self.context if t.lower() in low), None)

    def summary(self) -> dict:
        return {"id": self.id, "entity": self.entity, "base_confidence": self.base, "pattern_count": len(self.patterns)}


def _built(id_: str, entity: str, base: float, pattern: str, context: tuple[str, ...] = (), validator: str = "") -> Recognizer:
    return Recognizer(id_, entity, base, (pattern,), context, (validator,) if validator else (), True)


#: The built-in recognisers in their stable order.
BUILTINS = [
    _built("email_address", "EMAIL_ADDRESS", 0.75, r"(?i)\b[a-z0-9._%+-]+@[a-z0-9.-]+\.[a-z]{2,}\b", ("email", "e-mail")),
    _built("phone_number", "PHONE_NUMBER", 0.60, r"\(\d{3}\)\s?\d{3}-\d{4}|\b\d{3}-\d{3}-\d{4}\b|\b\d{3}\.\d{3}\.\d{4}\b", ("phone", "phone_number", "mobile", "cell", "telephone")),
    _built("ip_address_v4", "IP_ADDRESS_V4", 0.55, r"\b(?:\d{1,3}\.){3}\d{1,3}\b", ("ipv4", "ip_address", "ip address", "ipaddr"), "ipv4"),
    _built("ip_address_v6", "IP_ADDRESS_V6", 0.55, r"[0-9A-Fa-f:]{2,45}", ("ipv6", "ip_address", "ip address", "ipaddr"), "ipv6"),
    _built("url", "URL", 0.65, r"""(?i)\bhttps?://[^\s"'<>]+""", ("url", "website", "link", "uri"), "url"),
    _built("us_ssn", "US_SSN", 0.75, r"\b\d{3}-\d{2}-\d{4}\b", ("ssn", "social_security", "taxpayer_id"), "us_ssn"),
    _built("credit_card", "CREDIT_CARD", 0.70, r"\b\d[\d -]{11,21}\d\b", ("credit_card", "card_number", "creditcard", "cc_number"), "luhn"),
    _built("uuid", "UUID", 0.55, r"(?i)\b[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12}\b", ("uuid", "guid"), "uuid"),
    _built("mac_address", "MAC_ADDRESS", 0.80, r"(?i)\b(?:[0-9a-f]{2}[:-]){5}[0-9a-f]{2}\b", ("mac_address", "macaddr", "hwaddr")),
    _built("us_zip_code", "US_ZIP_CODE", 0.50, r"\b\d{5}(?:-\d{4})?\b", ("zip", "zip_code", "zipcode", "postal_code", "postal"), "us_zip"),
]
#: Further entities, on request.
EXTRA = [
    _built("aba_routing", "ABA_ROUTING_NUMBER", 0.40, r"\b\d{9}\b", ("aba", "routing"), "aba"),
    _built("iban", "IBAN", 0.65, r"\b[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,4})?\b", ("iban", "account"), "iban"),
    _built("date_of_birth", "DATE_OF_BIRTH", 0.30, r"\b\d{4}-\d{2}-\d{2}\b|\b\d{2}/\d{2}/\d{4}\b", ("birth", "dob"), "birth_date"),
]


# --- recognisers from YAML


def java_pattern(pattern: str) -> str:
    """A pattern as Spark runs it: classes such as \\d and \\b know all of Unicode, and groups lose names that Java would refuse."""
    return "(?U)" + re.sub(r"(?<!\\)((?:\\\\)*)\(\?P?<[A-Za-z_][A-Za-z0-9_]*>", r"\1(?:", pattern)


def _compiles(pattern: str) -> str | None:
    """Why a pattern is refused: it must be a regular expression of Java's, without look-around, back-references, atomic groups
    or possessive repeats. Without a running JVM, Python's compiler stands in for Java's."""
    if re.search(r"\(\?(?:[=!>]|<[=!])", pattern):
        return "look-around and atomic groups are not supported"
    if re.search(r"(?<!\\)(?:\\\\)*\\[1-9k]", pattern):
        return "back-references are not supported"
    if re.search(r"(?<!\\)(?:\\\\)*[*+?}]\+", re.sub(r"\[(?:\\.|[^\]])*\]", "", pattern)):
        return "possessive repeats are not supported"
    context = SparkContext._active_spark_context
    try:
        if context is None:
            re.compile(pattern)
        else:
            context._jvm.java.util.regex.Pattern.compile(java_pattern(pattern))
    except re.error as e:
        return str(e)
    except IllegalArgumentException as e:
        return str(e).splitlines()[0]
    return None


def load_recognizers(path: str) -> list[Recognizer]:
    """Recognisers of a YAML file: a list, or a mapping with the key recognizers. Errors name the entry and the field."""
    import yaml

    if not os.path.exists(path):
        raise InputNotFound(f"{path} does not exist", "check the path")
    with open(path, encoding="utf-8") as f:
        try:
            data = yaml.safe_load(f)
        except yaml.YAMLError as e:
            raise InvalidArgs(f"malformed YAML in {path}", "fix the syntax") from e
    entries = data.get("recognizers") if isinstance(data, dict) else data
    if not isinstance(entries, list):
        raise InvalidArgs(f"{path} lists no recognizers", "give a list under 'recognizers'")
    return [_entry(e, k) for k, e in enumerate(entries)]


def _entry(e: object, k: int) -> Recognizer:
    who = e.get("id") if isinstance(e, dict) and e.get("id") else f"entry {k + 1}"

    def bad(field: str, why: str) -> InvalidArgs:
        return InvalidArgs(f"recognizer '{who}', field '{field}': {why}", "fix the entry")

    if not isinstance(e, dict):
        raise bad("id", "not a mapping")
    for field in ("id", "entity"):
        if not isinstance(e.get(field), str) or not e[field]:
            raise bad(field, "missing")
    base = next((e[f] for f in ("confidence", "base_confidence") if f in e), None)
    if isinstance(base, bool) or not isinstance(base, (int, float)) or not 0 <= base <= 1:
        raise bad("confidence", "not a number from 0 to 1")
    lists = {f: e.get(f) or [] for f in ("patterns", "context", "validators")}
    for f, v in lists.items():
        if not isinstance(v, list) or not all(isinstance(x, (str, dict)) for x in v):
            raise bad(f, "not a list")
    patterns = [x.get("regex", "") if isinstance(x, dict) else x for x in lists["patterns"]]
    if not patterns:
        raise bad("patterns", "at least one is needed")
    for p in patterns:
        if why := _compiles(p):
            raise bad("patterns", why)
    for v in lists["validators"]:
        if v not in NAMES:
            raise bad("validators", f"unknown validator '{v}'")
    return Recognizer(e["id"], e["entity"], float(base), tuple(patterns), tuple(lists["context"]), tuple(lists["validators"]))


def merge(base: list[Recognizer], custom: list[Recognizer]) -> list[Recognizer]:
    """An id that is known is replaced in its place; a new one goes to the end."""
    out = {r.id: r for r in base}
    out.update({r.id: r for r in custom})
    return list(out.values())


def recognizers_frame(spark: SparkSession, recognizers: Iterable[Recognizer] = BUILTINS) -> DataFrame:
    return spark.createDataFrame([tuple(r.summary().values()) for r in recognizers], "id string, entity string, base_confidence double, pattern_count int")


# --- scanning


def _all(text: Column, pattern: str) -> Column:
    return F.regexp_extract_all(text, F.lit(pattern), F.lit(0))


def spans(text: Column, r: Recognizer) -> Column:
    """Array of structs (start, end, match) of all matches, distinct, in order; code points, end exclusive.

    The text between matches and the matches alternate, so running sums of their lengths are the places."""
    whole = "array<struct<start:int,end:int,match:string>>"

    def of(pattern: str) -> Column:
        zipped = F.arrays_zip(F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"), _all(text, pattern).alias("match"))
        start = lambda acc, x: acc["at"] + x["gap"]
        end = lambda acc, x: start(acc, x) + F.length(x["match"])
        step = lambda acc, x: F.struct(end(acc, x).alias("at"), F.concat(acc["out"], F.array(F.struct(start(acc, x).alias("start"), end(acc, x).alias("end"), x["match"].alias("match")))).alias("out"))
        zero = F.struct(F.lit(0).alias("at"), F.array().cast(whole).alias("out"))
        return F.aggregate(F.filter(zipped, lambda x: F.length(x["match"]) > 0), zero, step, lambda acc: acc["out"])

    return F.array_sort(F.array_distinct(F.concat(*(of(java_pattern(p)) for p in r.patterns))))


def candidates(text: Column, r: Recognizer) -> Column:
    """All matches in a value, in order of their starts; spans that several patterns find count once."""
    if len(r.patterns) == 1:
        return _all(text, java_pattern(r.patterns[0]))
    return F.transform(spans(text, r), lambda s: s["match"])


def _to_test(text: Column, r: Recognizer) -> tuple[Column, Column]:
    """(candidates worth testing, whether there are others): of IPv6's hex runs, only those with a colon can be valid."""
    if r.builtin and r.id == "ip_address_v6":
        runs = _all(text, "(?<![0-9A-Fa-f:])[0-9A-Fa-f]*+:[0-9A-Fa-f:]*+")
        return F.flatten(F.transform(runs, lambda x: _all(x, r.patterns[0]))), text.rlike("(?<![0-9A-Fa-f:])[0-9A-Fa-f]{2,}+(?!:)")
    return candidates(text, r), F.lit(False)


def possible(r: Recognizer, kind: T.DataType) -> bool:
    """Whether values of a type can match a built-in recogniser at all. Custom ones are always searched for."""
    if not r.builtin:
        return True
    if isinstance(kind, T.BooleanType):
        return False
    if isinstance(kind, (T.ByteType, T.ShortType, T.IntegerType, T.LongType, T.FloatType, T.DoubleType, T.DecimalType)):
        return r.id in ("credit_card", "us_zip_code")
    return True


def confidence(base: float, all_valid: bool, in_context: bool) -> float:
    return min(1.0, max(0.0, round(base + VALIDATOR_BONUS * all_valid + CONTEXT_BONUS * in_context, 6)))


def matches_frame(df: DataFrame, column: str, r: Recognizer, keep: list[str] | None = None) -> DataFrame:
    """keep columns, and for each non-null value its candidates and the valid ones among them."""
    text = F.col(quoted(column)).cast("string")
    found = df.select(*(keep or []), text.alias("__value")).where("__value is not null").withColumn("candidates", candidates(F.col("__value"), r))
    return found.withColumn("valid", keep_valid(F.col("candidates"), list(r.validators))).drop("__value")


def finding_frame(df: DataFrame, column: str, r: Recognizer) -> DataFrame:
    """One row: column, entity, non_null, rows_with_candidates, candidates, valid, rows_with_valid, confidence."""
    m = matches_frame(df, column, r)
    out = m.agg(
        F.count("*").alias("non_null"), F.count_if(F.size("candidates") > 0).alias("rows_with_candidates"), F.coalesce(F.sum(F.size("candidates")), F.lit(0)).cast("long").alias("candidates"),
        F.coalesce(F.sum(F.size("valid")), F.lit(0)).cast("long").alias("valid"), F.count_if(F.size("valid") > 0).alias("rows_with_valid"),
    )
    bonus = F.when((F.col("candidates") == F.col("valid")) & F.lit(bool(r.validators)), VALIDATOR_BONUS).otherwise(0.0)
    score = F.least(F.lit(1.0), F.greatest(F.lit(0.0), F.round(F.lit(r.base) + bonus + (CONTEXT_BONUS if r.context_term(column) else 0.0), 6)))
    return out.select(F.lit(column).alias("column_name"), F.lit(r.entity).alias("entity"), "*", score.alias("confidence"))


def evidence_frame(df: DataFrame, column: str, r: Recognizer, order: list[str], k: int = EVIDENCE) -> DataFrame:
    """(place, match): the first k valid matches by the order of their rows and then within them, masked."""
    from lodestone.functions.masking import mask_column

    hits = matches_frame(df, column, r, order).where("size(valid) > 0").orderBy(*order).limit(k)  # k rows hold the first k matches
    flat = hits.select(*order, F.posexplode("valid").alias("at", "match")).orderBy(*order, "at").limit(k)
    return flat.select(*order, "at", mask_column(F.col("match")).alias("match"))


def scan(df: DataFrame, recognizers: list[Recognizer] = BUILTINS, fields: list[str] | None = None) -> tuple[int, list[dict]]:
    """(rows, findings): a finding for each column and recogniser with at least one valid match, in the order of both.

    df may have a column __row that orders its rows; else they count in reading order. Findings hold masked evidence only.
    """
    names = [c for c in df.columns if c != "__row"]
    choose_columns(df.select(*(F.col(quoted(c)) for c in names)), fields, "field")
    if "__row" not in df.columns:
        df = ordered(df, "", "text")
    df = spread(df)
    kinds = {f.name: f.dataType for f in df.schema.fields}
    scanned = fields or names
    pairs = [(c, r) for c in scanned for r in recognizers if possible(r, kinds[c])]
    tested = [_to_test(F.col(quoted(c)).cast("string"), r) for c, r in pairs]
    base = df.select("__row", *(x.alias(f"{m}{i}") for i, two in enumerate(tested) for m, x in zip("fo", two, strict=True)))
    base = base.select("*", *(keep_valid(F.col(f"f{i}"), list(r.validators)).alias(f"v{i}") for i, (_, r) in enumerate(pairs)))
    found = [
        F.struct(F.lit(i).alias("pair"), F.size(f"v{i}").alias("valid"), (F.col(f"o{i}") | (F.size(f"f{i}") > F.size(f"v{i}"))).alias("invalid"), F.slice(f"v{i}", 1, EVIDENCE).alias("shown"))
        for i in range(len(pairs))
    ]
    hits = base.select("__row", F.explode(F.filter(F.array(*found), lambda x: (x["valid"] > 0) | x["invalid"])).alias("x")).select("__row", "x.*").persist() if pairs else None
    try:
        row = df.agg(F.count("*").alias("rows"), *(F.count(F.col(quoted(c))).alias(f"k{j}") for j, c in enumerate(scanned))).first()
        sums, shown = {}, {}
        if hits is not None:
            sums = {x.pair: x for x in hits.groupBy("pair").agg(F.count_if(F.col("valid") > 0).alias("hits"), F.max("invalid").alias("invalid")).collect()}
            first = Window.partitionBy("pair").orderBy("__row")
            for x in hits.where("valid > 0").withColumn("at", F.row_number().over(first)).where(F.col("at") <= EVIDENCE).orderBy("pair", "at").select("pair", "shown").collect():  # three rows of each pair
                shown.setdefault(x.pair, []).extend(x.shown)
    finally:
        if hits is not None:
            hits.unpersist()
    column_at = {c: j for j, c in enumerate(scanned)}
    findings = []
    for i, (c, r) in enumerate(pairs):
        n, non_null = sums[i].hits if i in sums else 0, row[f"k{column_at[c]}"]
        if not n:
            continue
        term = r.context_term(c)
        share = n / non_null * 100 if non_null else 0.0
        reason = (f"column name matches context term '{term}'; " if term else "") + f"{n}/{non_null} values ({share:.1f}%) matched {r.entity}" + (" and passed validation" if r.validators else "")
        score = confidence(r.base, bool(r.validators) and not sums[i].invalid, term is not None)
        findings.append({"column": c, "entity": r.entity, "recognizer": r.id, "confidence": score, "match_count": n, "match_percentage": share, "sample_evidence": [mask(m) for m in shown[i][:EVIDENCE]], "reason": reason})
    return row["rows"], findings


def scan_file(spark: SparkSession, path: str, fmt: str, fields: list[str] | None = None, sample: int | None = None, recognizers: list[Recognizer] = BUILTINS) -> dict:
    """The pii section of a report."""
    if fmt == "json":
        raise UnsupportedInput("scanning JSON arrays is not supported", "convert the file to JSON lines")
    df = ordered(read_typed(spark, path, fmt), path, fmt)
    if sample is not None:
        df = df.orderBy("__row").limit(sample).cache()
    rows, findings = scan(df, recognizers, fields)
    return {"scanned_rows": rows, "findings": findings} | ({} if sample is None else {"sample_size": sample})


def gate(findings: list[dict], threshold: float | None) -> ExitCode:
    """The exit code of --fail-on: any finding with at least that confidence fails."""
    if threshold is not None and not 0 <= threshold <= 1:
        raise InvalidArgs(f"--fail-on {threshold} is not from 0 to 1", "give a confidence")
    hit = threshold is not None and any(f["confidence"] >= threshold for f in findings)
    return ExitCode.PII_FAILED if hit else ExitCode.SUCCESS


def findings_frame(spark: SparkSession, findings: list[dict]) -> DataFrame:
    kinds = "column string, entity string, recognizer string, confidence double, match_count long, match_percentage double, sample_evidence array<string>, reason string"
    return spark.createDataFrame([tuple(f.values()) for f in findings], kinds)
