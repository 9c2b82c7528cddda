"""Registered queries of the governance operators and the relational surface, each with SQL that must give the same rows.

Counts are bigint and ratios double on both sides; floats are rounded where engines may differ in the last digit.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.functions.masking import mask_column
from lodestone.operators import anonymise, drift, evaluate, inspect, pii, profile, quality, query, schema
from lodestone.operators.quality import Rule
from lodestone.plans.sqltext import api as sqltext

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE_SQL: dict[str, str] = {}


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def register(name: str, fn: Callable[[SparkSession, str], DataFrame], oracle: str | None = None) -> None:
    QUERIES[name] = fn
    if oracle:
        ORACLE_SQL[name] = oracle


def registered(oracle: str | None = None):
    def wrap(fn):
        register(fn.__name__, fn, oracle)
        return fn

    return wrap


# --- profiles

COLUMNS = {
    "orders": ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice", "o_orderdate", "o_orderpriority"],
    "lineitem": ["l_orderkey", "l_partkey", "l_suppkey", "l_linenumber", "l_quantity", "l_extendedprice", "l_discount", "l_tax", "l_returnflag", "l_linestatus", "l_shipdate"],
    "documents": ["doc_id", "text", "lang", "source", "n_chars"],
    "customer": ["c_custkey", "c_name", "c_nationkey", "c_acctbal", "c_mktsegment"],
}


def _union(parts: list[str]) -> str:
    return "\nUNION ALL\n".join(parts)


for _t, _cols in COLUMNS.items():
    register(
        f"profile_counts_{_t}", lambda s, d, t=_t: profile.counts_frame(table(s, d, t)),
        _union([f"SELECT '{c}' AS column_name, count(*) AS row_count, count(*) - count({c}) AS null_count, (count(*) - count({c})) / count(*)::DOUBLE * 100.0 AS null_percentage, count(DISTINCT {c}) AS distinct_count, count(DISTINCT {c}) / count(*)::DOUBLE * 100.0 AS uniqueness_percentage FROM {_t}" for c in _cols]),
    )
register(
    "profile_nulls", lambda s, d: profile.counts_frame(table(s, d, "orders").select(F.nullif("o_orderstatus", F.lit("F")).alias("status"), F.nullif("o_totalprice", F.col("o_totalprice")).alias("nothing"))),
    _union([f"SELECT '{n}' AS column_name, count(*) AS row_count, count(*) - count(v) AS null_count, (count(*) - count(v)) / count(*)::DOUBLE * 100.0 AS null_percentage, count(DISTINCT v) AS distinct_count, count(DISTINCT v) / count(*)::DOUBLE * 100.0 AS uniqueness_percentage FROM (SELECT {e} AS v FROM orders)" for n, e in (("status", "nullif(o_orderstatus, 'F')"), ("nothing", "nullif(o_totalprice, o_totalprice)"))]),
)
NUMERIC = {"orders": ["o_orderkey", "o_custkey", "o_totalprice"], "lineitem": ["l_orderkey", "l_quantity", "l_extendedprice", "l_discount", "l_tax"]}
for _t, _cols in NUMERIC.items():
    register(
        f"profile_minmax_numeric_{_t}", lambda s, d, t=_t, c=tuple(_cols): profile.metric_frame(table(s, d, t).select(*((F.col(x).cast("double") + 0.0).alias(x) for x in c)), ["min", "max"]),
        _union([f"SELECT '{c}' AS column_name, min({c}::DOUBLE) + 0.0::DOUBLE AS min, max({c}::DOUBLE) + 0.0::DOUBLE AS max FROM {_t}" for c in _cols]),
    )
# Means of rates have few digits and may fall between two roundings at 6 places; prices have noise beyond 6.
for _n, _t, _cols, _places in (("orders", "orders", NUMERIC["orders"], 6), ("lineitem", "lineitem", ["l_orderkey", "l_quantity", "l_extendedprice"], 6), ("rates", "lineitem", ["l_discount", "l_tax"], 9)):
    register(
        f"profile_moments_{_n}", lambda s, d, t=_t, c=tuple(_cols), k=_places: profile.metric_frame(table(s, d, t).select(*c), ["mean", "stddev"]).select("column_name", F.round("mean", k).alias("mean"), F.round("stddev", k).alias("stddev")),
        _union([f"SELECT '{c}' AS column_name, round(avg({c}::DOUBLE), {_places}) AS mean, round(stddev_samp({c}::DOUBLE), {_places}) AS stddev FROM {_t}" for c in _cols]),
    )
register(
    "profile_minmax_string", lambda s, d: profile.metric_frame(table(s, d, "customer").select("c_name", "c_mktsegment"), ["min", "max"]),
    _union([f"SELECT '{c}' AS column_name, min({c}) AS min, max({c}) AS max FROM customer" for c in ("c_name", "c_mktsegment")]),
)
_Q = [0.25, 0.5, 0.75, 0.9, 0.99]


@registered(_union([f"SELECT '{c}' AS column_name, " + ", ".join(f"round(quantile_cont({c}::DOUBLE, {q}), 4) AS p{int(q * 100)}" for q in _Q) + " FROM orders" for c in ("o_custkey", "o_totalprice")]))
def profile_quantiles(spark, sf_dir):
    m = profile.metric_frame(table(spark, sf_dir, "orders").select("o_custkey", "o_totalprice"), ["quantiles"])
    return m.select("column_name", *(F.round(F.element_at("quantiles", i + 1), 4).alias(f"p{int(q * 100)}") for i, q in enumerate(_Q)))


@registered(_union([f"SELECT '{c}' AS column_name, CAST(coalesce(min(length({c})), 0) AS INTEGER) AS length_min, CAST(coalesce(max(length({c})), 0) AS INTEGER) AS length_max, round(avg(length({c})), 6) AS length_mean FROM {t}" for t, c in (("documents", "text"), ("documents", "lang"), ("customer", "c_name"))]))
def profile_string_length(spark, sf_dir):
    out = [profile.metric_frame(table(spark, sf_dir, t).select(*cols), ["length_min", "length_max", "length_mean"]) for t, cols in (("documents", ["text", "lang"]), ("customer", ["c_name"]))]
    return out[0].union(out[1]).withColumn("length_mean", F.round("length_mean", 6))


for _t, _c in (("customer", "c_mktsegment"), ("orders", "o_orderpriority"), ("lineitem", "l_partkey"), ("documents", "source")):
    register(f"profile_top_values_{_t}", lambda s, d, t=_t, c=_c: profile.top_values(table(s, d, t), c), f"SELECT {_c} AS value, count(*) AS n FROM {_t} WHERE {_c} IS NOT NULL GROUP BY 1 ORDER BY n DESC, value LIMIT 10")
register("profile_frequencies", lambda s, d: profile.frequencies(table(s, d, "events"), "user_id"), "SELECT user_id AS value, count(*) AS n FROM events GROUP BY 1")
_MASK = "CASE WHEN length({0}) < 8 THEN '●●●' ELSE substr({0}, 1, 2) || '…' || right({0}, 2) END"
register("profile_masked_top_values", lambda s, d: profile.masked_top_values(table(s, d, "customer").select(F.col("c_name").alias("customer_email")), "customer_email"), f"SELECT {_MASK.format('value')} AS value, n FROM (SELECT c_name AS value, count(*) AS n FROM customer GROUP BY 1 ORDER BY n DESC, value LIMIT 10)")
_IDS = {"documents": ["doc_id", "text", "lang", "source", "n_chars"], "events": ["event_id", "ts", "user_id", "event_type", "value", "props"]}


@registered(_union([f"SELECT '{t}' AS table_name, '{c}' AS column_name, (count(DISTINCT {c}) = count(*) AND count(*) > 0) OR {str(profile.ID_NAME.match(c) is not None).lower()} AS possible_identifier FROM {t}" for t, cs in _IDS.items() for c in cs]))
def profile_identifier(spark, sf_dir):
    out = None
    for t in _IDS:
        one = profile.counts_frame(table(spark, sf_dir, t)).select(F.lit(t).alias("table_name"), "column_name", ((F.col("distinct_count") == F.col("row_count")) & (F.col("row_count") > 0) | F.col("column_name").rlike(profile.ID_NAME.pattern)).alias("possible_identifier"))
        out = one if out is None else out.union(one)
    return out


@registered("SELECT o_orderkey, o_custkey FROM orders ORDER BY o_orderkey LIMIT 100")
def profile_sample_first_n(spark, sf_dir):
    return profile.first_rows(table(spark, sf_dir, "orders"), f"{sf_dir}/orders.parquet", "parquet", 100).select("o_orderkey", "o_custkey")


for _t in ("customer", "lineitem", "documents"):
    register(f"profile_{_t}", lambda s, d, t=_t: profile.profile_frame(table(s, d, t)))

# --- inspection


def _as_text(df: DataFrame) -> DataFrame:
    return df.select(*(F.col(c).cast("string").alias(c) for c in df.columns))


_NARROW = "CASE WHEN count(v) = 0 THEN 'null' WHEN bool_and(v IN ('true', 'false')) THEN 'boolean' WHEN bool_and(regexp_matches(v, '^[+-]?[0-9]+$') AND TRY_CAST(v AS BIGINT) IS NOT NULL) THEN 'integer' WHEN bool_and(regexp_matches(v, '^[+-]?([0-9]+\\.?[0-9]*|\\.[0-9]+)([eE][+-]?[0-9]+)?$')) THEN 'float' ELSE 'string' END"
register(
    "inspect_narrow_types", lambda s, d: inspect.narrow_frame(_as_text(table(s, d, "customer")).withColumn("flag", (F.col("c_nationkey").cast("int") > 9).cast("string")).withColumn("blank", F.nullif("c_name", F.col("c_name")))),
    _union([f"SELECT '{c}' AS name, {_NARROW} AS data_type, count(*) > count(v) AS nullable FROM (SELECT {e} AS v FROM customer)" for c, e in [*((c, f"CAST({c} AS VARCHAR)") for c in COLUMNS["customer"]), ("flag", "CAST(c_nationkey > 9 AS VARCHAR)"), ("blank", "nullif(c_name, c_name)")]]),
)
register(
    "inspect_memory_bytes", lambda s, d: inspect.memory_bytes(table(s, d, "documents"), {"doc_id": "integer", "text": "string", "lang": "string", "source": "string", "n_chars": "integer"}),
    "SELECT CAST(sum(16 + strlen(text) + 24 + strlen(lang) + 24 + strlen(source) + 24) AS BIGINT) AS approx_memory_bytes FROM documents",
)
register("inspect_row_groups", lambda s, d: inspect.parquet_footers(s, f"{d}/orders.parquet").agg(F.sum("row_count").alias("row_count")), "SELECT count(*) AS row_count FROM orders")
register("inspect_parquet_schema", lambda s, d: s.createDataFrame([(x["name"], x["data_type"], x["nullable"]) for x in inspect.parquet_leaves(s, f"{d}/embeddings.parquet")], "name string, data_type string, nullable boolean"))

# --- SQL over files

_FILE_SQL = {
    "query_group_count": ("SELECT c_mktsegment, COUNT(*) AS n FROM '{d}/customer.parquet' GROUP BY c_mktsegment", "SELECT c_mktsegment, count(*) AS n FROM customer GROUP BY 1"),
    "query_two_files": ("SELECT c.c_mktsegment AS segment, COUNT(*) AS n, ROUND(SUM(o.o_totalprice), 2) AS total FROM '{d}/orders.parquet' o JOIN '{d}/customer.parquet' AS c ON o.o_custkey = c.c_custkey WHERE o.o_orderpriority <> 'x.csv' GROUP BY c.c_mktsegment", "SELECT c_mktsegment AS segment, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1"),
    "query_bounded": ("SELECT o_orderkey, o_totalprice AS \"price\" FROM '{d}/orders.parquet' ORDER BY o_totalprice DESC, o_orderkey LIMIT 25", "SELECT o_orderkey, o_totalprice AS price FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 25"),
}
for _n, (_s, _o) in _FILE_SQL.items():
    register(_n, lambda s, d, q=_s: query.prepare(s, q.replace("{d}", d))[0], _o)

# --- personal data

_REC = {r.id: r for r in [*pii.BUILTINS, *pii.EXTRA]}


def _finding(name: str, view: str, expr: str, rec: str, valid: str, spark_df: Callable[[SparkSession, str], DataFrame], pattern: str | None = None) -> None:
    """Register a finding over one column. valid: DuckDB SQL of x, one candidate, that its validators stand for."""
    r = _REC[rec]
    p = (pattern or r.patterns[0]).replace("'", "''")
    base = f"SELECT regexp_extract_all(v, '{p}') AS c FROM (SELECT {expr} AS v FROM {view}) WHERE v IS NOT NULL"
    both = f"SELECT c, [x FOR x IN c IF {valid}] AS k FROM ({base})"
    bonus = f"CASE WHEN coalesce(sum(len(c)), 0) = coalesce(sum(len(k)), 0) AND {str(bool(r.validators)).lower()} THEN 0.1 ELSE 0.0 END"
    context = 0.05 if r.context_term(name.split(":")[1]) else 0.0
    register(
        name.split(":")[0], lambda s, d: pii.finding_frame(spark_df(s, d), name.split(":")[1], r),
        f"SELECT '{name.split(':')[1]}' AS column_name, '{r.entity}' AS entity, count(*) AS non_null, count(*) FILTER (WHERE len(c) > 0) AS rows_with_candidates, CAST(coalesce(sum(len(c)), 0) AS BIGINT) AS candidates, CAST(coalesce(sum(len(k)), 0) AS BIGINT) AS valid, count(*) FILTER (WHERE len(k) > 0) AS rows_with_valid, CAST(round(least(1.0, {r.base}::DOUBLE + ({bonus})::DOUBLE + {context}::DOUBLE), 6) AS DOUBLE) AS confidence FROM ({both})",
    )


_OCTET = "(25[0-5]|2[0-4][0-9]|1[0-9][0-9]|[1-9]?[0-9])"
_LUHN = "(length(regexp_replace(x, '[ -]', '', 'g')) BETWEEN 13 AND 19 AND list_sum([CASE WHEN i % 2 = 1 THEN CAST(substr(reverse(regexp_replace(x, '[ -]', '', 'g')), CAST(i AS INTEGER), 1) AS INTEGER) ELSE [0, 2, 4, 6, 8, 1, 3, 5, 7, 9][CAST(substr(reverse(regexp_replace(x, '[ -]', '', 'g')), CAST(i AS INTEGER), 1) AS INTEGER) + 1] END FOR i IN range(1, length(regexp_replace(x, '[ -]', '', 'g')) + 1)]) % 10 = 0)"
_documents = lambda s, d: table(s, d, "documents")
_finding("pii_email_documents:text", "documents", "text", "email_address", "true", _documents)
_finding("pii_phone_documents:text", "documents", "text", "phone_number", "true", _documents)
_finding("pii_ipv4_documents:text", "documents", "text", "ip_address_v4", f"regexp_full_match(x, '{_OCTET}(\\.{_OCTET}){{3}}')", _documents)
_finding("pii_cards_documents:text", "documents", "text", "credit_card", _LUHN, _documents)
_finding("pii_url_pages:url", "pages", "url", "url", "contains(x, ':')", lambda s, d: table(s, d, "pages"))
_finding("pii_mac_documents:text", "documents", "text", "mac_address", "true", _documents)


def _derived(name: str, column: str, rec: str, spark_expr: str, duck_expr: str, valid: str) -> None:
    _finding(f"{name}:{column}", "orders", duck_expr, rec, valid, lambda s, d: table(s, d, "orders").select(F.expr(spark_expr).alias(column)))


_key = "lpad(cast(o_orderkey * 7919 % 1000000000 as string), 9, '0')"
_kd = "lpad(CAST(o_orderkey * 7919 % 1000000000 AS VARCHAR), 9, '0')"
_ssn = "concat(substr({0}, 1, 3), '-', substr({0}, 4, 2), '-', substr({0}, 6, 4))"
_derived("pii_ssn_synthetic", "holder_ssn", "us_ssn", _ssn.format(_key), _ssn.format(_kd), "substr(x, 1, 3) NOT IN ('000', '666') AND substr(x, 1, 3) < '900'")
_uuid = "concat(substr({0}, 1, 8), '-', substr({0}, 9, 4), '-', substr({0}, 13, 4), '-', substr({0}, 17, 4), '-', substr({0}, 21, 12))"
_derived("pii_uuid_synthetic", "row_uuid", "uuid", _uuid.format("md5(cast(o_orderkey as string))"), _uuid.format("md5(CAST(o_orderkey AS VARCHAR))"), "substr(x, 15, 1) IN ('1', '2', '3', '4', '5') AND substr(x, 20, 1) IN ('8', '9', 'a', 'b')")
_mac = "concat(substr({0}, 1, 2), ':', substr({0}, 3, 2), ':', substr({0}, 5, 2), ':', substr({0}, 7, 2), ':', substr({0}, 9, 2), ':', substr({0}, 11, 2))"
_derived("pii_mac_synthetic", "macaddr", "mac_address", _mac.format("md5(cast(o_orderkey as string))"), _mac.format("md5(CAST(o_orderkey AS VARCHAR))"), "true")
_derived("pii_zip_synthetic", "zip_code", "us_zip_code", "lpad(cast(o_custkey * 37 % 100000 as string), 5, '0')", "lpad(CAST(o_custkey * 37 % 100000 AS VARCHAR), 5, '0')", "x NOT IN ('00000', '99999')")


@registered("SELECT count(*) AS rows, CAST(sum(len(regexp_extract_all(text, '[0-9A-Fa-f:]{2,45}'))) AS BIGINT) AS candidates FROM documents")
def pii_ipv6_prefilter(spark, sf_dir):
    m = pii.matches_frame(table(spark, sf_dir, "documents"), "text", _REC["ip_address_v6"])
    return m.agg(F.count("*").alias("rows"), F.sum(F.size("candidates")).alias("candidates"))


@registered(f"SELECT doc_id, CAST(i AS INTEGER) - 1 AS at, {_MASK.format('m')} AS match FROM (SELECT doc_id, unnest(c) AS m, generate_subscripts(c, 1) AS i FROM (SELECT doc_id, regexp_extract_all(text, '{_REC['email_address'].patterns[0]}') AS c FROM documents)) ORDER BY doc_id, i LIMIT 3")
def pii_evidence_masked(spark, sf_dir):
    return pii.evidence_frame(table(spark, sf_dir, "documents"), "text", _REC["email_address"], ["doc_id"])


@registered("SELECT 'text' AS column_name, 'LICENSE_LINE' AS entity, count(*) AS non_null, count(*) FILTER (WHERE n > 0) AS rows_with_candidates, CAST(sum(n) AS BIGINT) AS candidates, CAST(sum(n) AS BIGINT) AS valid, count(*) FILTER (WHERE n > 0) AS rows_with_valid, 0.8::DOUBLE AS confidence FROM (SELECT len(regexp_extract_all(text, 'All rights reserved')) AS n FROM documents)")
def pii_custom_recognizer(spark, sf_dir):
    own = pii.Recognizer("license_line", "LICENSE_LINE", 0.8, ("All rights reserved",))
    return pii.finding_frame(table(spark, sf_dir, "documents"), "text", own)


@registered("SELECT count(*) > 0 AS failed FROM documents WHERE regexp_matches(text, '" + _REC["email_address"].patterns[0] + "')")
def pii_fail_on(spark, sf_dir):
    f = pii.finding_frame(table(spark, sf_dir, "documents"), "text", _REC["email_address"])
    return f.select(((F.col("rows_with_valid") > 0) & (F.col("confidence") >= 0.75)).alias("failed"))


@registered("SELECT * FROM (VALUES " + ", ".join(f"('{r.id}', '{r.entity}', {r.base}::DOUBLE, {len(r.patterns)}::INTEGER)" for r in pii.BUILTINS) + ") t(id, entity, base_confidence, pattern_count)")
def pii_recognizers_list(spark, sf_dir):
    return pii.recognizers_frame(spark)


def pii_scan_documents(spark, sf_dir):
    return pii.findings_frame(spark, pii.scan(table(spark, sf_dir, "documents"))[1])


register("pii_scan_documents", pii_scan_documents)

# --- relational surface: (SQL for both engines) or (Spark, DuckDB)

RELATIONAL: dict[str, str | tuple[str, str]] = {
    "rel_project_filter": "SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN 'big' WHEN l_quantity BETWEEN 10 AND 25 THEN 'mid' ELSE 'small' END AS size, l_extendedprice * (1 - l_discount) AS net FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_shipdate < TIMESTAMP '1995-06-01' AND l_linestatus LIKE 'F%'",
    "rel_join_inner": "SELECT o.o_orderkey, c.c_name FROM orders o JOIN customer c ON o.o_custkey = c.c_custkey WHERE c.c_acctbal > 0",
    "rel_join_left": "SELECT c.c_custkey, count(o.o_orderkey) AS n FROM customer c LEFT JOIN orders o ON o.o_custkey = c.c_custkey AND o.o_totalprice > 100000 GROUP BY c.c_custkey",
    "rel_join_right": "SELECT n.n_name, count(s.s_suppkey) AS n FROM supplier s RIGHT JOIN nation n ON s.s_nationkey = n.n_nationkey AND s.s_acctbal > 5000 GROUP BY n.n_name",
    "rel_join_full": "SELECT coalesce(a.k, b.k) AS k, a.n AS orders_n, b.n AS events_n FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a FULL JOIN (SELECT user_id AS k, count(*) AS n FROM events GROUP BY 1) b ON a.k = b.k",
    "rel_join_cross": "SELECT r.r_name, n.n_name FROM region r CROSS JOIN nation n WHERE r.r_regionkey <> n.n_regionkey",
    "rel_join_using_natural": "SELECT k, a.n + b.n AS total FROM (SELECT o_custkey AS k, count(*) AS n FROM orders GROUP BY 1) a JOIN (SELECT c_custkey AS k, 1 AS n FROM customer) b USING (k)",
    "rel_join_semi": "SELECT c_custkey FROM customer c WHERE EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey AND o.o_orderstatus = 'F')",
    "rel_join_anti": "SELECT c_custkey FROM customer c WHERE NOT EXISTS (SELECT 1 FROM orders o WHERE o.o_custkey = c.c_custkey)",
    "rel_in_subquery": "SELECT p_partkey FROM part WHERE p_partkey IN (SELECT l_partkey FROM lineitem WHERE l_quantity > 49)",
    "rel_join_range": "SELECT r.lo, count(*) AS n FROM part p JOIN (SELECT * FROM (VALUES (0, 10), (10, 25), (25, 100)) t(lo, hi)) r ON p.p_size >= r.lo AND p.p_size < r.hi GROUP BY r.lo",
    "rel_groupby": "SELECT l_returnflag, l_linestatus, count(*) AS n, round(sum(l_quantity), 2) AS sum_qty, round(avg(l_discount), 6) AS avg_disc, min(l_shipdate) AS first_ship, max(l_extendedprice) AS max_price, round(var_samp(l_tax), 9) AS var_tax FROM lineitem GROUP BY l_returnflag, l_linestatus",
    "rel_distinct_agg": "SELECT o_orderpriority, count(DISTINCT o_custkey) AS customers, count(*) AS n FROM orders GROUP BY o_orderpriority",
    "rel_cube": "SELECT l_returnflag, l_linestatus, CAST(grouping(l_returnflag) + 2 * grouping(l_linestatus) AS INTEGER) AS g, count(*) AS n FROM lineitem GROUP BY CUBE (l_returnflag, l_linestatus)",
    "rel_rollup": "SELECT n_regionkey, n_name, count(*) AS n FROM nation JOIN customer ON c_nationkey = n_nationkey GROUP BY ROLLUP (n_regionkey, n_name)",
    "rel_grouping_sets": "SELECT c_mktsegment, c_nationkey, count(*) AS n FROM customer GROUP BY GROUPING SETS ((c_mktsegment), (c_nationkey), ())",
    "rel_filter_agg": "SELECT o_orderstatus, count(*) FILTER (WHERE o_totalprice > 200000) AS dear, round(sum(o_totalprice) FILTER (WHERE o_orderpriority = '1-URGENT'), 2) AS urgent FROM orders GROUP BY o_orderstatus",
    "rel_having": "SELECT user_id, count(*) AS n FROM events GROUP BY user_id HAVING count(*) > 8",
    "rel_window_rank": "SELECT o_orderkey, row_number() OVER w AS rn, rank() OVER w AS rk, dense_rank() OVER w AS dr FROM (SELECT o_orderkey, o_custkey, CAST(o_totalprice / 10000 AS INTEGER) AS band FROM (SELECT o_orderkey, o_custkey, floor(o_totalprice / 10000) * 10000 AS o_totalprice FROM orders)) WINDOW w AS (PARTITION BY o_custkey ORDER BY band, o_orderkey)",
    "rel_window_lag": "SELECT event_id, lag(value) OVER w AS prev, lead(event_type, 2) OVER w AS later, first_value(value) OVER w AS first FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)",
    "rel_window_frame": "SELECT o_orderkey, round(sum(o_totalprice) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN 2 PRECEDING AND CURRENT ROW), 2) AS moving FROM orders",
    "rel_window_ntile": "SELECT c_custkey, ntile(4) OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey) AS quartile, round(percent_rank() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS pr, round(cume_dist() OVER (PARTITION BY c_mktsegment ORDER BY c_acctbal, c_custkey), 9) AS cd FROM customer",
    "rel_qualify": ("SELECT o_custkey, o_orderkey FROM (SELECT o_custkey, o_orderkey, row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) AS rn FROM orders) WHERE rn = 1", "SELECT o_custkey, o_orderkey FROM orders QUALIFY row_number() OVER (PARTITION BY o_custkey ORDER BY o_totalprice DESC, o_orderkey) = 1"),
    "rel_topk": "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20",
    "rel_offset": "SELECT c_custkey FROM customer ORDER BY c_acctbal, c_custkey LIMIT 10 OFFSET 15",
    "rel_union": "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier",
    "rel_union_all": "SELECT 'c' AS who, c_nationkey AS k FROM customer UNION ALL SELECT 's', s_nationkey FROM supplier",
    "rel_intersect": "SELECT o_custkey AS k FROM orders WHERE o_orderstatus = 'F' INTERSECT SELECT user_id FROM events",
    "rel_except": "SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders",
    "rel_except_all": "SELECT o_orderstatus AS k FROM orders EXCEPT ALL SELECT o_orderstatus FROM orders WHERE o_totalprice > 100000",
    "rel_cte": "WITH big AS (SELECT o_custkey, sum(o_totalprice) AS total FROM orders GROUP BY o_custkey), top AS (SELECT * FROM big WHERE total > (SELECT avg(total) FROM big)) SELECT c_mktsegment, count(*) AS n FROM top JOIN customer ON o_custkey = c_custkey GROUP BY c_mktsegment",
    "rel_recursive": "WITH RECURSIVE t(n, f) AS (SELECT 1, 1 UNION ALL SELECT n + 1, f * (n + 1) FROM t WHERE n < 10) SELECT n, f FROM t",
    "rel_scalar_subquery": "SELECT p_partkey, p_retailprice - (SELECT avg(l_extendedprice) FROM lineitem WHERE l_partkey = p_partkey) IS NOT NULL AS sold FROM part",
    "rel_pivot": ("SELECT * FROM (SELECT o_orderstatus, o_orderpriority, o_orderkey FROM orders) PIVOT (count(o_orderkey) FOR o_orderstatus IN ('F' AS f, 'O' AS o, 'P' AS p))", "SELECT o_orderpriority, nullif(count(*) FILTER (WHERE o_orderstatus = 'F'), 0) AS f, nullif(count(*) FILTER (WHERE o_orderstatus = 'O'), 0) AS o, nullif(count(*) FILTER (WHERE o_orderstatus = 'P'), 0) AS p FROM orders GROUP BY 1"),
    "rel_unpivot": ("SELECT l_orderkey, l_linenumber, kind, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR kind IN (l_discount, l_tax))", "SELECT l_orderkey, l_linenumber, kind, amount FROM (SELECT l_orderkey, l_linenumber, l_discount, l_tax FROM lineitem) UNPIVOT (amount FOR kind IN (l_discount, l_tax))"),
    "rel_explode": ("SELECT vec_id, CAST(x AS FLOAT) AS x FROM embeddings LATERAL VIEW explode(embedding) t AS x", "SELECT vec_id, unnest(embedding) AS x FROM embeddings"),
    "rel_lateral": ("SELECT c.c_custkey, o.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 250000) o", "SELECT c.c_custkey, o.o_orderkey FROM customer c, LATERAL (SELECT o_orderkey FROM orders WHERE o_custkey = c.c_custkey AND o_totalprice > 250000) o"),
    "rel_approx": ("SELECT count(*) AS n, abs(approx_count_distinct(o_custkey, 0.01) - count(DISTINCT o_custkey)) <= 0.05 * count(DISTINCT o_custkey) AS near FROM orders", "SELECT count(*) AS n, true AS near FROM orders"),
    "fn_string": ("SELECT doc_id, upper(lang) AS u, length(text) AS n, trim(concat('  ', lang, ' ')) AS t, substr(text, 3, 5) AS s, replace(source, 'src', 's-') AS r, lpad(lang, 5, '*') AS lp, rpad(lang, 5, '*') AS rp, reverse(source) AS rev, repeat(lang, 2) AS rep, translate(source, 'src', 'SRC') AS tr, instr(source, 'c') AS i, split_part(source, 'c', 2) AS sp, md5(text) AS m, sha2(text, 256) AS h FROM documents", "SELECT doc_id, upper(lang) AS u, CAST(length(text) AS INTEGER) AS n, trim('  ' || lang || ' ') AS t, substr(text, 3, 5) AS s, replace(source, 'src', 's-') AS r, lpad(lang, 5, '*') AS lp, rpad(lang, 5, '*') AS rp, reverse(source) AS rev, repeat(lang, 2) AS rep, translate(source, 'src', 'SRC') AS tr, CAST(instr(source, 'c') AS INTEGER) AS i, split_part(source, 'c', 2) AS sp, md5(text) AS m, sha256(text) AS h FROM documents"),
    "fn_date": ("SELECT o_orderkey, date_trunc('month', o_orderdate) AS m, year(o_orderdate) AS y, month(o_orderdate) AS mo, day(o_orderdate) AS d, hour(o_orderdate) AS h, last_day(o_orderdate) AS l, datediff(TIMESTAMP_NTZ '1999-01-01', o_orderdate) AS days, date_format(o_orderdate, 'yyyy-MM-dd') AS f FROM orders", "SELECT o_orderkey, CAST(date_trunc('month', o_orderdate) AS TIMESTAMP) AS m, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(month(o_orderdate) AS INTEGER) AS mo, CAST(day(o_orderdate) AS INTEGER) AS d, CAST(hour(o_orderdate) AS INTEGER) AS h, last_day(o_orderdate) AS l, CAST(date_diff('day', CAST(o_orderdate AS DATE), DATE '1999-01-01') AS INTEGER) AS days, strftime(o_orderdate, '%Y-%m-%d') AS f FROM orders"),
    "fn_math": ("SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, CAST(ceil(l_extendedprice) AS DOUBLE) AS c, CAST(floor(l_extendedprice) AS DOUBLE) AS f, round(sqrt(l_quantity), 9) AS s, round(ln(l_extendedprice), 9) AS l, round(power(l_quantity, 2), 6) AS p, sign(l_discount) AS sg, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, l_orderkey % 7 AS m, l_orderkey div 7 AS d FROM lineitem", "SELECT l_orderkey, l_linenumber, abs(-l_quantity) AS a, ceil(l_extendedprice) AS c, floor(l_extendedprice) AS f, round(sqrt(l_quantity), 9) AS s, round(ln(l_extendedprice), 9) AS l, round(power(l_quantity, 2), 6) AS p, CAST(sign(l_discount) AS DOUBLE) AS sg, greatest(l_tax, l_discount) AS g, least(l_tax, l_discount) AS le, l_orderkey % 7 AS m, l_orderkey // 7 AS d FROM lineitem"),
    "fn_array": ("SELECT vec_id, size(embedding) AS n, element_at(embedding, 2) AS e, round(aggregate(embedding, CAST(0 AS DOUBLE), (a, x) -> a + CAST(x AS DOUBLE)), 5) AS s, size(filter(embedding, x -> x > 0)) AS pos, array_contains(array(1, 2, label), 7) AS has FROM embeddings", "SELECT vec_id, CAST(len(embedding) AS INTEGER) AS n, embedding[2] AS e, round(list_sum([CAST(x AS DOUBLE) FOR x IN embedding]), 5) AS s, CAST(len([x FOR x IN embedding IF x > 0]) AS INTEGER) AS pos, list_contains([1, 2, label], 7) AS has FROM embeddings"),
    "fn_map": ("SELECT r_regionkey, element_at(map_from_arrays(array('a', 'b'), array(r_name, upper(r_name))), 'b') AS v, size(map_keys(map('k', r_name))) AS n, named_struct('x', r_regionkey, 'y', r_name).y AS y FROM region", "SELECT r_regionkey, upper(r_name) AS v, CAST(1 AS INTEGER) AS n, {'x': r_regionkey, 'y': r_name}.y AS y FROM region"),
    "fn_json": ("SELECT event_id, get_json_object(props, '$.k') AS k, from_json(props, 'k int').k AS i, try_variant_get(parse_json(props), '$.k', 'int') + 1 AS v FROM events", "SELECT event_id, json_extract_string(props, '$.k') AS k, CAST(json_extract_string(props, '$.k') AS INTEGER) AS i, CAST(json_extract_string(props, '$.k') AS INTEGER) + 1 AS v FROM events"),
    "fn_aggregate": ("SELECT o_orderstatus, count_if(o_totalprice > 100000) AS c, bool_and(o_totalprice > 0) AS ba, bool_or(o_totalprice > 400000) AS bo, max_by(o_orderkey, struct(o_totalprice, o_orderkey)) AS mb, round(corr(o_totalprice, o_custkey), 6) AS co, round(covar_samp(o_totalprice, o_custkey), 2) AS cv, round(median(o_totalprice), 4) AS md, array_join(array_sort(collect_set(o_orderpriority)), ',') AS ps FROM orders GROUP BY o_orderstatus", "SELECT o_orderstatus, count_if(o_totalprice > 100000)::BIGINT AS c, bool_and(o_totalprice > 0) AS ba, bool_or(o_totalprice > 400000) AS bo, arg_max(o_orderkey, {'a': o_totalprice, 'b': o_orderkey}) AS mb, round(corr(o_totalprice, o_custkey), 6) AS co, round(covar_samp(o_totalprice, o_custkey), 2) AS cv, round(median(o_totalprice), 4) AS md, string_agg(DISTINCT o_orderpriority, ',' ORDER BY o_orderpriority) AS ps FROM orders GROUP BY o_orderstatus"),
}
TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents", "embeddings"]


def run_sql(spark: SparkSession, sf_dir: str, sql: str) -> DataFrame:
    """A query over the tables by their names; views exist only for the ones that it names."""
    for t in TABLES:
        if t in sql:
            table(spark, sf_dir, t).createOrReplaceTempView(t)
    return spark.sql(sql)


for _n, _s in RELATIONAL.items():
    _spark, _duck = (_s, _s) if isinstance(_s, str) else _s
    register(_n, lambda s, d, q=_spark: run_sql(s, d, q), _duck)

# --- quality, schema, drift, evaluation, anonymisation

RULES = [
    Rule("status_known", "accepted_values", "o_orderstatus", {"values": ["F", "O"]}), Rule("price_range", "range", "o_totalprice", {"min": 1000, "max": 400000}), Rule("priority_shape", "regex", "o_orderpriority", {"pattern": "^[1-3]-"}),
    Rule("key_present", "not_null", "o_orderkey"), Rule("key_unique", "unique", "o_custkey"), Rule("customer_known", "reference", "o_custkey", {"table": "few", "keys": ["c_custkey"]}), Rule("enough", "row_count", None, {"min": 10}),
]
_RULE_SQL = [
    ("status_known", "count(*) FILTER (WHERE o_orderstatus NOT IN ('F', 'O'))"), ("price_range", "count(*) FILTER (WHERE o_totalprice < 1000 OR o_totalprice > 400000)"), ("priority_shape", "count(*) FILTER (WHERE NOT regexp_matches(o_orderpriority, '^[1-3]-'))"),
    ("key_present", "count(*) FILTER (WHERE o_orderkey IS NULL)"), ("key_unique", "count(*) - count(DISTINCT o_custkey)"), ("customer_known", "count(*) FILTER (WHERE o_custkey NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal > 0))"), ("enough", "CASE WHEN count(*) < 10 THEN 1 ELSE 0 END"),
]


@registered(_union([f"SELECT '{n}' AS rule, CAST({e} AS BIGINT) AS violations, CAST({e} AS BIGINT) = 0 AS passed FROM orders" for n, e in _RULE_SQL]))
def quality_rules(spark, sf_dir):
    few = table(spark, sf_dir, "customer").where("c_acctbal > 0")
    return quality.check_rules(table(spark, sf_dir, "orders"), RULES, {"few": few}).select("rule", "violations", "passed")


@registered("SELECT * FROM (VALUES ('c_acctbal', 'type', 'double', 'string', false), ('c_mktsegment', 'removed', 'string', NULL, false), ('extra', 'added', NULL, 'int', false)) t(column_name, change, before, after, compatible)")
def schema_diff(spark, sf_dir):
    before = table(spark, sf_dir, "customer")
    after = before.withColumn("c_acctbal", F.col("c_acctbal").cast("string")).drop("c_mktsegment").withColumn("extra", F.lit(1))
    return schema.diff_frame(spark, before.schema, after.schema)


@registered("WITH a AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus = 'F' GROUP BY 1), b AS (SELECT o_orderpriority AS v, count(*) AS n FROM orders WHERE o_orderstatus <> 'F' GROUP BY 1) SELECT 'o_orderpriority' AS column_name, round(sum(abs(coalesce(a.n, 0) / (SELECT sum(n) FROM a) - coalesce(b.n, 0) / (SELECT sum(n) FROM b))) / 2, 6) AS total_variation FROM a FULL JOIN b ON a.v = b.v")
def profile_distribution_shift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    return drift.distribution_shift(o.where("o_orderstatus = 'F'"), o.where("o_orderstatus <> 'F'"), "o_orderpriority").select("column_name", F.round("total_variation", 6).alias("total_variation"))


@registered(_union([f"SELECT '{c}' AS column_name, (SELECT count(*) FROM orders WHERE o_orderstatus = 'F') AS row_count_before, (SELECT count(*) FROM orders) AS row_count_after, (SELECT count(DISTINCT {c}) FROM orders WHERE o_orderstatus = 'F') AS distinct_count_before, (SELECT count(DISTINCT {c}) FROM orders) AS distinct_count_after" for c in ("o_custkey", "o_orderpriority")]))
def profile_drift(spark, sf_dir):
    o = table(spark, sf_dir, "orders")
    cols = ["o_custkey", "o_orderpriority"]
    return drift.profile_drift(o.where("o_orderstatus = 'F'").select(*cols), o.select(*cols)).select("column_name", "row_count_before", "row_count_after", "distinct_count_before", "distinct_count_after")


@registered("SELECT o_orderpriority AS entity, count(*) FILTER (WHERE o_totalprice > 150000 AND o_custkey % 2 = 0) AS tp, count(*) FILTER (WHERE o_totalprice <= 150000 AND o_custkey % 2 = 0) AS fp, count(*) FILTER (WHERE o_totalprice > 150000 AND o_custkey % 2 <> 0) AS fn FROM orders WHERE o_totalprice > 150000 OR o_custkey % 2 = 0 GROUP BY 1")
def pii_evaluate(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", F.col("o_orderpriority").alias("entity"), "o_totalprice", "o_custkey")
    return evaluate.evaluate(o.where("o_totalprice > 150000"), o.where("o_custkey % 2 = 0"), ["o_orderkey"]).select("entity", "tp", "fp", "fn")


@registered(f"SELECT c_custkey, {_MASK.format('c_name')} AS c_name, sha256(c_mktsegment) AS c_mktsegment, '[REDACTED]' AS c_acctbal FROM customer")
def anonymise_customer(spark, sf_dir):
    df = table(spark, sf_dir, "customer").select("c_custkey", "c_name", "c_mktsegment", "c_acctbal")
    return anonymise.anonymise(df, {"c_name": {"method": "mask"}, "c_mktsegment": {"method": "hash"}, "c_acctbal": {"method": "redact"}})


register("mask_names", lambda s, d: table(s, d, "customer").select("c_custkey", mask_column(F.col("c_name")).alias("masked"), mask_column(F.col("c_mktsegment")).alias("segment")), f"SELECT c_custkey, {_MASK.format('c_name')} AS masked, {_MASK.format('c_mktsegment')} AS segment FROM customer")

# --- SQL text

CORPUS = {
    "ansi": "SELECT id, name FROM people ORDER BY id FETCH FIRST 5 ROWS ONLY", "postgres": "SELECT id FROM people WHERE name ILIKE '%li%'", "duckdb": "SELECT * FROM sales PIVOT (SUM(amount) FOR quarter IN ('Q1', 'Q2')) AS p",
    "spark": "SELECT id, tag FROM people LATERAL VIEW EXPLODE(tags) x AS tag", "databricks": "SELECT id, ROW_NUMBER() OVER (PARTITION BY region ORDER BY id) AS rn FROM people QUALIFY rn = 1", "snowflake": "SELECT id, ROW_NUMBER() OVER (PARTITION BY region ORDER BY id) AS rn FROM people QUALIFY rn = 1",
    "bigquery": "SELECT id FROM `a`.`b`.`people` WHERE id > 1", "trino": "SELECT APPROX_DISTINCT(id) FROM people", "mysql": "SELECT `id` FROM `people` WHERE `id` > 1", "sqlite": "INSERT INTO people (id, region) VALUES (1, 'NW') ON CONFLICT (id) DO NOTHING", "tsql": "SELECT TOP 10 id FROM people",
}


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: "NULL" if v is None else str(v) if isinstance(v, (int, float)) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join(f"({', '.join(cell(v) for v in r)})" for r in rows) + f") t({names})"


@registered(_values([(d, "insert" if d == "sqlite" else "select", "sales" if d == "duckdb" else "a.b.people" if d == "bigquery" else "people") for d in CORPUS], "dialect, statement_type, tables"))
def sql_parse_corpus(spark, sf_dir):
    rows = [(d, p["statement_type"], ",".join(t["name"] for t in p["tables"])) for d, p in ((d, sqltext.parse(s, d)) for d, s in CORPUS.items())]
    return spark.createDataFrame(rows, "dialect string, statement_type string, tables string")


@registered(_values([("tsql", "postgres", "SELECT id FROM people LIMIT 10", None), ("snowflake", "ansi", CORPUS["snowflake"], "QUALIFY"), ("duckdb", "mysql", "SELECT * FROM sales PIVOT(SUM(amount) FOR quarter IN ('Q1', 'Q2')) AS p", "PIVOT/UNPIVOT"), ("mysql", "ansi", 'SELECT "id" FROM "people" WHERE "id" > 1', None), ("trino", "spark", "SELECT APPROX_COUNT_DISTINCT(id) FROM people", None)], "source, target, sql, warnings"))
def sql_transpile_corpus(spark, sf_dir):
    rows = []
    for a, b in (("tsql", "postgres"), ("snowflake", "ansi"), ("duckdb", "mysql"), ("mysql", "ansi"), ("trino", "spark")):
        t = sqltext.transpile(CORPUS[a], a, b)
        rows.append((a, b, t["sql"], ",".join(w["construct"] for w in t["warnings"]) or None))
    return spark.createDataFrame(rows, "source string, target string, sql string, warnings string")
