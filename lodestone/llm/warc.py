"""Resolution of WARC not-modified revisits against earlier full responses.

An as-of join by canonical URL gives each revisit the latest full response before it; its validators are
checked against that response, and the header fields that a 304 may update are merged into the stored ones.

Captures are range-partitioned by (canonical URL, time), so a URL that holds a third of all captures spans
many blocks. Within a block a window carries the last response; from block to block only one row for each URL
and block is carried. No task gathers all captures of one URL.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lodestone.llm._common import stash

#: Fields that describe the stored body and that a 304 must not replace (RFC 9110, RFC 9111).
KEPT_FIELDS = ["connection", "content-encoding", "content-length", "content-range", "content-type", "keep-alive", "proxy-authenticate", "te", "trailer", "transfer-encoding", "upgrade"]

RECORD = "record_id long, ts long, url string, kind string, status int, etag string, last_modified string, digest string, headers map<string,string>"


def canonical_url(url: Column) -> Column:
    """Host in lower case without www. and default ports, path without a last slash, parameters sorted and without utm_*; no scheme or fragment."""
    bare = F.regexp_replace(F.trim(url), r"(?s)#.*$", "")
    rest = F.regexp_replace(bare, r"^[A-Za-z][A-Za-z0-9+.-]*://", "")
    host = F.regexp_replace(F.regexp_replace(F.lower(F.regexp_extract(rest, r"^[^/?]*", 0)), r"^www\.", ""), r":(80|443)$", "")
    path = F.regexp_replace(F.regexp_extract(rest, r"^[^/?]*([^?]*)", 1), r"/+$", "")
    query = F.array_join(F.array_sort(F.filter(F.split(F.regexp_extract(rest, r"\?(.*)$", 1), "&"), lambda p: (p != "") & ~p.startswith("utm_"))), "&")
    return F.concat(host, path, F.when(query != "", F.concat(F.lit("?"), query)).otherwise(""))


def merge_headers(stored: Column, update: Column) -> Column:
    """stored with the permitted fields of update; names compare and come out in lower case, sorted; of names that differ
    in case alone the last entry counts."""

    def low(m: Column) -> Column:
        entries = F.reverse(F.transform(F.map_entries(F.coalesce(m, F.create_map().cast("map<string,string>"))), lambda e: F.struct(F.lower(e["key"]).alias("key"), e["value"].alias("value"))))
        names = F.transform(entries, lambda e: e["key"])
        return F.filter(entries, lambda e, i: F.array_position(names, e["key"]) == i + 1)

    allowed = F.filter(low(update), lambda e: ~e["key"].isin(KEPT_FIELDS))
    kept = F.filter(low(stored), lambda e: ~F.exists(allowed, lambda u: u["key"] == e["key"]))
    return F.map_from_entries(F.array_sort(F.array_distinct(F.concat(kept, allowed))))


def _last_response(records: DataFrame) -> DataFrame:
    """Each record with last: the latest response of its URL at an earlier ts (the greater record_id between equals), else null."""
    cols = F.struct("record_id", "ts", "status", "etag", "last_modified", "digest", "headers")
    # A revisit sorts before responses of its own time, so what precedes it is earlier.
    ranked = records.withColumn("late", (F.col("kind") == "response").cast("int")).withColumn("resp", F.when(F.col("kind") == "response", cols))
    order = ["ts", "late", "record_id"]
    ranged = stash(ranked.repartitionByRange(F.col("canonical_url"), *order).withColumn("block", F.spark_partition_id()))
    inside = Window.partitionBy("block", "canonical_url").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    here = ranged.withColumn("in_block", F.last("resp", ignorenulls=True).over(inside))
    ends = ranged.where("resp is not null").groupBy("block", "canonical_url").agg(F.max_by("resp", F.struct(*order)).alias("end"))
    blocks = ranged.select("block", "canonical_url").distinct().join(ends, ["block", "canonical_url"], "left")
    across = Window.partitionBy("canonical_url").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    carried = blocks.select("block", "canonical_url", F.last("end", ignorenulls=True).over(across).alias("carried")).where("carried is not null")
    out = here.where("kind = 'revisit'").join(carried, ["block", "canonical_url"], "left")
    return out.withColumn("last", F.coalesce("in_block", "carried"))


def resolve_revisits(records: DataFrame) -> DataFrame:
    """Per revisit of records (see RECORD): what it stands for.

    record_id, ts, url, canonical_url, response_id, outcome, status, digest, headers. outcome: resolved; no_response, if no
    full response of the URL is earlier; mismatch, if an etag or, where either side lacks one, a last_modified or else a
    digest that both have differs (weak etags compare without W/); unchecked, if the two have no validator in common.
    Status, digest and headers are given if resolved or unchecked: the response's, headers merged.

    Records without a ts or a canonical url (null, or nothing but a scheme or fragment), or of another kind, have no place in a sequence: a revisit among them comes out
    as no_response, a response among them serves none. Repeated revisits each get their row; null headers count as
    empty; extra columns are ignored; no rows give no rows.
    """
    names = [c.split()[0] for c in RECORD.split(", ")]
    records = records.select(*names).withColumn("canonical_url", canonical_url(F.col("url"))).where(F.col("kind").isin("response", "revisit"))
    placed = "coalesce(canonical_url, '') <> '' and ts is not null"
    lost = records.where(f"not ({placed}) and kind = 'revisit'").withColumn("last", F.lit(None).cast("struct<record_id:long,ts:long,status:int,etag:string,last_modified:string,digest:string,headers:map<string,string>>"))
    joined = _last_response(records.where(placed)).select(*names, "canonical_url", "last").unionByName(lost)
    strong = lambda c: F.regexp_replace(c, r"^W/", "")
    same_etag, same_time, same_digest = strong(F.col("etag")) == strong(F.col("last.etag")), F.col("last_modified") == F.col("last.last_modified"), F.col("digest") == F.col("last.digest")
    agrees = F.coalesce(same_etag, same_time, same_digest)
    outcome = F.when(F.col("last").isNull(), "no_response").when(agrees.isNull(), "unchecked").when(agrees, "resolved").otherwise("mismatch")
    joined = joined.withColumn("outcome", outcome)
    usable = F.col("outcome").isin("resolved", "unchecked")
    return joined.select(
        "record_id", "ts", "url", "canonical_url", F.col("last.record_id").alias("response_id"), "outcome", F.when(usable, F.col("last.status")).alias("status"),
        F.when(usable, F.col("last.digest")).alias("digest"), F.when(usable, merge_headers(F.col("last.headers"), F.col("headers"))).alias("headers"),
    )


def page_records(pages: DataFrame, lag: int = 500) -> DataFrame:
    """Capture records of pages(page_id, url, html): a full response at time page_id, and a revisit `lag` later that
    found the page's own body unchanged. Pages share canonical URLs, so a revisit may meet another page's response."""
    body = F.md5(F.coalesce(F.col("html"), F.lit("")))
    base = pages.select("page_id", "url", body.alias("etag"), F.length(F.coalesce("html", F.lit(""))).cast("string").alias("size"))
    kinds = F.explode(F.array(F.lit("response"), F.lit("revisit"))).alias("kind")
    base = base.select("*", kinds).withColumn("again", (F.col("kind") == "revisit").cast("long"))
    first = F.create_map(F.lit("Content-Type"), F.lit("text/html"), F.lit("Content-Length"), F.col("size"), F.lit("ETag"), F.col("etag"), F.lit("Age"), F.lit("0"))
    update = F.create_map(F.lit("Content-Length"), F.lit("0"), F.lit("ETag"), F.col("etag"), F.lit("Age"), F.lit(str(lag)), F.lit("Date"), F.col("page_id").cast("string"))
    return base.select(
        (F.col("page_id") * 2 + F.col("again")).alias("record_id"), (F.col("page_id") + F.col("again") * lag).alias("ts"), "url", "kind", F.when(F.col("again") == 1, 304).otherwise(200).alias("status"),
        "etag", F.lit(None).cast("string").alias("last_modified"), F.when(F.col("again") == 0, F.concat(F.lit("md5:"), "etag")).alias("digest"), F.when(F.col("again") == 1, update).otherwise(first).alias("headers"),
    )


def revisit_report(pages: DataFrame) -> DataFrame:
    """resolve_revisits over page_records, with the headers as one string of name=value joined by ;."""
    out = resolve_revisits(page_records(pages))
    flat = F.array_join(F.transform(F.array_sort(F.map_entries("headers")), lambda e: F.concat(e["key"], F.lit("="), e["value"])), ";")
    return out.withColumn("headers", flat)


ORACLE_SQL = r"""
WITH base AS (
  SELECT page_id, url, md5(coalesce(html, '')) AS etag, CAST(length(coalesce(html, '')) AS VARCHAR) AS size,
         regexp_replace(regexp_replace(trim(url), '(?s)#.*$', ''), '^[A-Za-z][A-Za-z0-9+.-]*://', '') AS rest
  FROM pages
), canon AS (
  SELECT *, regexp_replace(regexp_replace(lower(regexp_extract(rest, '^[^/?]*', 0)), '^www\.', ''), ':(80|443)$', '') AS host,
         regexp_replace(regexp_extract(rest, '^[^/?]*([^?]*)', 1), '/+$', '') AS path,
         array_to_string(list_sort([p FOR p IN string_split(regexp_extract(rest, '\?(.*)$', 1), '&') IF p <> '' AND NOT starts_with(p, 'utm_')]), '&') AS query
  FROM base
), rec AS (
  SELECT page_id, url, etag, size, host || path || CASE WHEN query <> '' THEN '?' || query ELSE '' END AS canonical_url FROM canon
), events AS (
  SELECT 2 * page_id AS record_id, page_id AS ts, 1 AS late, page_id, url, canonical_url, etag, size FROM rec
  UNION ALL
  SELECT 2 * page_id + 1, page_id + 500, 0, page_id, url, canonical_url, etag, size FROM rec
), seen AS (
  SELECT *, last_value(CASE WHEN late = 1 THEN {'record_id': record_id, 'etag': etag, 'size': size} END IGNORE NULLS)
              OVER (PARTITION BY canonical_url ORDER BY ts, late, record_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS last
  FROM events
)
SELECT record_id, ts, url, canonical_url, last.record_id AS response_id,
       CASE WHEN last IS NULL THEN 'no_response' WHEN last.etag = etag THEN 'resolved' ELSE 'mismatch' END AS outcome,
       CAST(CASE WHEN last.etag = etag THEN 200 END AS INTEGER) AS status,
       CASE WHEN last.etag = etag THEN 'md5:' || last.etag END AS digest,
       CASE WHEN last.etag = etag THEN 'age=500;content-length=' || last.size || ';content-type=text/html;date=' || page_id || ';etag=' || etag END AS headers
FROM seen WHERE late = 0
"""
