"""Secret scans with multipart credential linking, in DataFrame and SQL functions only.

Base kinds are strong enough alone: assignments to secret-like names, access-key identifiers and long hex
runs. Weak candidates say little alone: a user name (`user`), a mixed-case random-looking run (`key`) and a URL
or host (`endpoint`). An interval join links parts of one document whose starts lie within `scope` code points
of each other, and a weak candidate is reported only when its complement co-occurs: a key with an access or
user part; a user with an assignment or key; an endpoint with both sides.

Positions come from splitting: the text between matches and the matches alternate, so running sums of their
lengths in code points are starts and ends. Only documents with a match leave the scan; equal rows are worked
on once. The join meets parts in buckets as wide as the scope, so a document of any length costs in proportion
to its parts.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stash, text_or_empty

#: Name, pattern, group whose length counts, least length. The first three are the base kinds. A run of the
#: access or hex kind is matched whole or not at all, so its least length may stand in the pattern; an assignment that is
#: too short still takes its place from what overlaps it.
KINDS = [
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
    ("user", r"""(?i:\b(user|username|user_?id|login|client_?id|account_?id))["']?\x20*[:=]\x20*["']?([A-Za-z0-9_.@-]+)""", 2, 3),
    ("key", r"(?<![A-Za-z0-9+/_=-])(?=[A-Za-z0-9+/_-]*[a-z])(?=[A-Za-z0-9+/_-]*[A-Z])(?=[A-Za-z0-9+/_-]*[0-9])[A-Za-z0-9+/_-]+={0,2}", 0, 32),
    ("endpoint", r"""\b[A-Za-z][A-Za-z0-9+.-]*://[^\s"'<>]+|(?i:\b(endpoint|host|server))["']?\x20*[:=]\x20*["']?[A-Za-z0-9.-]+(:[0-9]+)?""", 0, 6),
]
#: Cheaper patterns that find a long enough match of a kind wherever there is one.
QUICK = {"assign": KINDS[0][1].replace("]+)", "]{6})"), "access": r"AKIA[A-Z0-9]{16}", "hex": r"[0-9a-f]{24}", "user": KINDS[3][1].replace("]+)", "]{3})")}
BASE = [k[0] for k in KINDS[:3]]
KEY = ["doc_id", "text_hash"]


def _matches(text: Column, pattern: str, group: int) -> Column:
    return F.arrays_zip(
        F.transform(F.split(text, pattern, -1), lambda x: F.length(x)).alias("gap"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(0)), lambda x: F.length(x)).alias("len"),
        F.transform(F.regexp_extract_all(text, F.lit(pattern), F.lit(group)), lambda x: F.length(x)).alias("val"),
    )


def _keyed(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", text_or_empty().alias("text")).withColumn("text_hash", F.xxhash64("text"))


def _parts(keyed: DataFrame) -> DataFrame:
    """All base and candidate spans: (doc_id, text_hash, rank, kind, start, end); hits that are too short are dropped."""
    hit = {k: F.col("text").rlike(QUICK[k]) for k in ("assign", "hex", "user")}
    hit["access"] = F.contains("text", F.lit("AKIA")) & F.col("text").rlike(QUICK["access"])
    found = keyed.select(*KEY, "text", *(hit[k].alias(f"has_{k}") for k in hit))
    found = found.where(" or ".join(f"has_{k}" for k in hit))
    linkable = F.col("has_access") | F.col("has_user")  # without these, no weak candidate has its complement
    wanted = [F.col(f"has_{name}") if name in hit else linkable for name, *_ in KINDS]
    kinds = [
        F.when(want, F.struct(F.lit(rank).alias("rank"), _matches(F.col("text"), pattern, group).alias("m")))
        for rank, ((_, pattern, group, _), want) in enumerate(zip(KINDS, wanted, strict=True))
    ]
    rows = found.select(*KEY, F.explode(F.array(*kinds)).alias("k")).where("k is not null").select(*KEY, "k.rank", F.posexplode("k.m").alias("i", "m"))
    rows = rows.select(*KEY, "rank", "i", "m.gap", "m.len", "m.val").where("len is not null").distinct()
    upto = Window.partitionBy(*KEY, "rank").orderBy("i").rowsBetween(Window.unboundedPreceding, 0)
    rows = rows.withColumn("end", F.sum(F.col("gap") + F.col("len")).over(upto))
    least = F.element_at(F.array(*(F.lit(k[3]) for k in KINDS)), F.col("rank") + 1)
    name = F.element_at(F.array(*(F.lit(k[0]) for k in KINDS)), F.col("rank") + 1)
    return rows.where(F.col("val") >= least).select(*KEY, "rank", name.alias("kind"), (F.col("end") - F.col("len")).alias("start"), "end")


def _linked(parts: DataFrame, scope: int) -> DataFrame:
    """The weak candidates whose complements lie within scope; a candidate inside a base span adds nothing."""
    side = F.when(F.col("kind").isin("access", "user"), "id").when(F.col("kind").isin("assign", "key"), "secret")
    at = (F.col("start") / scope).cast("long")
    other = parts.withColumn("side", side).where("side is not null").select(*(F.col(k).alias(f"o_{k}") for k in KEY), at.alias("o_bucket"), "side", F.col("start").alias("o_start"))
    reach = F.explode(F.sequence(at, ((F.col("end") - 1) / scope).cast("long")))  # spans that overlap share a bucket
    cover = parts.where(F.col("kind").isin(BASE)).select(*(F.col(k).alias(f"c_{k}") for k in KEY), reach.alias("c_bucket"), F.col("start").alias("c_start"), F.col("end").alias("c_end"))
    weak = parts.where(~F.col("kind").isin(BASE))
    same = lambda p: (F.col("text_hash") == F.col(f"{p}_text_hash")) & F.col("doc_id").eqNullSafe(F.col(f"{p}_doc_id"))
    inside = same("c") & (F.col("bucket") == F.col("c_bucket")) & (F.col("start") < F.col("c_end")) & (F.col("end") > F.col("c_start"))
    covered = weak.withColumn("bucket", reach).join(cover, inside, "left_semi").select(*(F.col(k).alias(f"v_{k}") for k in KEY), F.col("rank").alias("v_rank"), F.col("start").alias("v_start"))
    weak = weak.join(covered, same("v") & (F.col("rank") == F.col("v_rank")) & (F.col("start") == F.col("v_start")), "left_anti")
    near = weak.withColumn("bucket", F.explode(F.array(at - 1, at, at + 1))).join(other, same("o") & (F.col("bucket") == F.col("o_bucket")) & (F.abs(F.col("start") - F.col("o_start")) <= scope))
    near = near.groupBy(*KEY, "rank", "kind", "start", "end").agg(F.max((F.col("side") == "id").cast("int")).alias("with_id"), F.max((F.col("side") == "secret").cast("int")).alias("with_secret"))
    ok = F.when(F.col("kind") == "key", F.col("with_id") == 1).when(F.col("kind") == "user", F.col("with_secret") == 1).otherwise((F.col("with_id") == 1) & (F.col("with_secret") == 1))
    return near.where(ok).select(*KEY, "rank", "kind", "start", "end")


def find_spans(docs: DataFrame, scope: int = 200) -> DataFrame:
    """(doc_id, text_hash, rank, kind, start, end): every base span and every linked weak one of each distinct row."""
    parts = stash(_parts(_keyed(docs)))  # few rows, read in four places; the texts are searched once
    return parts.where(F.col("kind").isin(BASE)).union(_linked(parts, scope))


def _with(keyed: DataFrame, found: DataFrame) -> DataFrame:
    """Left join by the key, a null doc_id matching a null one."""
    found = found.select(*(F.col(c).alias(f"f_{c}") if c in KEY else F.col(c) for c in found.columns))
    return keyed.join(found, (F.col("text_hash") == F.col("f_text_hash")) & F.col("doc_id").eqNullSafe(F.col("f_doc_id")), "left").drop("f_doc_id", "f_text_hash")


def scan(docs: DataFrame, scope: int = 200) -> DataFrame:
    """Per row of docs(doc_id, text, ...): doc_id, counts of base spans, base_sha256, spans, n_linked.

    spans lists kind:start:end by start, then kind as listed in KINDS, in code points with end exclusive; base_sha256
    is the digest of the base part of that list. A null text counts as empty and has no spans; a null doc_id stays
    null; repeated rows each get their row; extra columns are ignored; no rows give no rows.
    """
    keyed = _keyed(docs)
    spans = find_spans(docs, scope).withColumn("said", F.concat_ws(":", "kind", "start", "end"))
    row = F.struct("start", "rank", "said")
    said = lambda c: F.array_join(F.transform(F.array_sort(c), lambda x: x["said"]), ",")
    base = F.col("rank") < len(BASE)
    found = spans.groupBy(*KEY).agg(
        *(F.count_if(F.col("kind") == k).alias(f"n_{k}") for k in BASE), F.count_if(~base).alias("n_linked"),
        said(F.collect_list(F.when(base, row))).alias("base"), said(F.collect_list(row)).alias("spans"),
    )
    out = _with(keyed.select(*KEY), found)
    count = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return out.select("doc_id", *(count(f"n_{k}") for k in BASE), F.sha2(F.coalesce("base", F.lit("")), 256).alias("base_sha256"), F.coalesce("spans", F.lit("")).alias("spans"), count("n_linked"))


def redact(docs: DataFrame, scope: int = 200, mark: str = "[REDACTED]") -> DataFrame:
    """docs with each found span of text replaced by mark; overlapping spans become one mark. Other columns stay as they are.

    Rows without a span, null texts included, come back unchanged; n_chars, if there, is that of the new text.
    """
    names = docs.columns
    spans = find_spans(docs, scope)
    before = Window.partitionBy(*KEY).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    reach = spans.withColumn("reach", F.coalesce(F.max("end").over(before), F.lit(0)))
    ends = reach.groupBy(*KEY).agg(F.max("end").alias("last"), F.array_sort(F.collect_list(F.when(F.col("start") >= F.col("reach"), F.struct("reach", "start")))).alias("gaps"))
    held = docs.withColumns({"__text": text_or_empty(), "__hash": F.xxhash64(text_or_empty())})
    ends = ends.select(F.col("doc_id").alias("__doc"), F.col("text_hash").alias("__h"), "last", "gaps").withColumnsRenamed({"last": "__last", "gaps": "__gaps"})
    out = held.join(ends, (F.col("__hash") == F.col("__h")) & F.col("doc_id").eqNullSafe(F.col("__doc")), "left")
    kept = F.transform("__gaps", lambda g: F.substring(F.col("__text"), g["reach"].cast("int") + 1, (g["start"] - g["reach"]).cast("int")))
    tail = F.substring(F.col("__text"), F.col("__last").cast("int") + 1, F.length("__text"))
    text = F.when(F.col("__gaps").isNull(), F.col("text")).otherwise(F.concat(F.array_join(kept, mark), F.lit(mark), tail))
    out = out.withColumn("text", text)
    if "n_chars" in names:
        out = out.withColumn("n_chars", F.when(F.col("__gaps").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))
    return out.select(*names)
