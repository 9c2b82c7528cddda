"""Formats, inspection, profiles, file queries, scans and their command line on small files."""

import io
import json
import math

import pytest
from pyspark.sql import functions as F

from lodestone import cli, config, report
from lodestone.errors import InputNotFound, InvalidArgs, LodestoneError, UnsupportedInput
from lodestone.functions import validators
from lodestone.functions.masking import mask, mask_column, sensitive_fragment
from lodestone.operators import anonymise, drift, evaluate, lineage, pii, policy, quality, schema
from lodestone.operators import profile as profiles
from lodestone.operators.inspect import humanize_bytes, inspect
from lodestone.operators.profile import profile, profile_file
from lodestone.operators.quality import Rule
from lodestone.operators.query import prepare, run_query
from lodestone.sources import formats

SECRET = "alice@example.com"


@pytest.fixture
def write(tmp_path):
    def put(name, text):
        p = tmp_path / name
        p.write_bytes(text if isinstance(text, bytes) else text.encode())
        return str(p)

    return put


@pytest.fixture
def people(write):
    return write("people.csv", "id,email,flag,score,code\n1,alice@example.com,true,1.5,007\n2,bob@example.org,false,,x\n3,,true,2.5,12\n")


# --- formats


@pytest.mark.parametrize(("head", "want"), [(b"PAR1xx", "parquet"), (b"a,b\n1,2", "csv"), (b"a\tb\n", "tsv"), (b' [{"a":1}]', "json"), (b'{"a":1}', "json"), (b'{"a":1}\n{"a":2}\n', "jsonl"), (b"plain words", None), (b"", None)])
def test_sniffing(head, want):
    assert formats.from_bytes(head) == want


def test_detection(write, spark, tmp_path):
    assert formats.detect("x.NDJSON") == "jsonl" and formats.detect("x.csv", "TSV") == "tsv"
    with pytest.raises(InvalidArgs):
        formats.detect("-")
    with pytest.raises(InvalidArgs):
        formats.detect("x", "xml")
    with pytest.raises(InputNotFound):
        formats.detect(str(tmp_path / "none.dat"))
    with pytest.raises(UnsupportedInput):
        formats.detect(write("p.dat", "plain words"))
    assert [formats.table_name(p) for p in ("a/b-c.csv", "1x.csv", "é.csv")] == ["b_c", "t_1x", "_"]
    write("c.dat", "a,b\n1,2")
    rows = {r.path.rsplit("/", 1)[1]: r for r in formats.content_hashes(spark, str(tmp_path)).collect()}
    assert rows["c.dat"].format == "csv" and rows["c.dat"].content_hash == formats.content_hash(str(tmp_path / "c.dat"))


def test_arrow(spark, tmp_path):
    import pyarrow as pa

    t = pa.table({"a": [1, 2]})
    with pa.OSFile(str(tmp_path / "x.arrow"), "wb") as f, pa.ipc.new_file(f, t.schema) as w:
        w.write_table(t)
    assert formats.read_arrow(spark, str(tmp_path / "x.arrow")).count() == 2


# --- masks


def test_masks(spark):
    assert (mask("1234567"), mask("12345678"), mask("éa345678ü")) == ("●●●", "12…78", "éa…8ü")
    rows = spark.createDataFrame([("1234567",), ("éa345678ü",), (None,)], "v string").select(mask_column(F.col("v"))).collect()
    assert [r[0] for r in rows] == ["●●●", "éa…8ü", None]
    assert sensitive_fragment("Home_EMAIL") == "email" and sensitive_fragment("user") is None


# --- inspection


def test_inspect_csv(spark, people):
    d = inspect(spark, people, "csv")
    assert [(c["name"], c["data_type"], c["nullable"]) for c in d["schema"]] == [("id", "integer", False), ("email", "string", True), ("flag", "boolean", False), ("score", "float", True), ("code", "string", False)]
    assert d["row_count"] == 3 and d["sample_rows"][0] == {"id": 1, "email": "al…om", "flag": True, "score": 1.5, "code": "007"} and d["sample_rows"][1]["score"] is None
    assert d["approx_memory_bytes"] == 3 * 8 + (17 + 24 + 15 + 24 + 1) + 3 + (8 + 1 + 8) + (3 + 24 + 1 + 24 + 2 + 24)


def test_inspect_odd_delimited(spark, write):
    d = inspect(spark, write("q.tsv", 'a\tb\n"x\ty"\t1e5\n\n7\n'), "tsv")
    assert [(c["name"], c["data_type"], c["nullable"]) for c in d["schema"]] == [("a", "string", False), ("b", "float", True)] and d["row_count"] == 2
    d = inspect(spark, write("h.csv", "a,b\n"), "csv")
    assert d["row_count"] == 0 and [c["data_type"] for c in d["schema"]] == ["null", "null"]


def test_inspect_json(spark, write):
    d = inspect(spark, write("a.json", '[{"b": 1, "a": "x"}, {"a": 2, "c": null, "d": 1.5}, {"a": "y", "d": 2, "e": [1], "f": {"z": 1}, "g": true}]'), "json")
    assert [(c["name"], c["data_type"], c["nullable"]) for c in d["schema"]] == [("a", "mixed", False), ("b", "integer", True), ("c", "null", True), ("d", "float", True), ("e", "array", True), ("f", "object", True), ("g", "boolean", True)]
    assert d["row_count"] == 3 and d["sample_rows"][1] == {"a": 2, "b": None, "c": None, "d": 1.5, "e": None, "f": None, "g": None}
    assert inspect(spark, write("o.json", '{"a": 1}'), "json")["row_count"] == 1
    assert inspect(spark, write("l.jsonl", '{"a": 18446744073709551615}\n\n{"a": 1, "phone": "555-123-4567"}\n'), "jsonl")["schema"][0] == {"name": "a", "data_type": "integer", "nullable": False}
    with pytest.raises(UnsupportedInput):
        inspect(spark, write("s.json", "[1, 2]"), "json")
    with pytest.raises(LodestoneError):
        inspect(spark, write("s.jsonl", '{"a": 1}\nnot json\n'), "jsonl")


def test_inspect_parquet(spark, sf):
    d = inspect(spark, f"{sf}/embeddings.parquet", "parquet")
    assert [c["name"] for c in d["schema"]] == ["vec_id", "element", "label"] and d["column_count"] == 3
    assert d["row_count"] == sum(g["row_count"] for g in d["parquet"]["row_groups"]) and d["parquet"]["compression_codecs"] == ["SNAPPY"]
    assert (humanize_bytes(12), humanize_bytes(494_490)) == ("12 B", "482.9 KiB")


# --- profile


def test_profile(spark, people):
    got = {c["name"]: c for c in profile_file(spark, people, "csv")["columns"]}
    assert got["id"] | {"top_values": 0} == got["id"] | {"top_values": 0, "mean": 2.0, "median": 2.0, "stddev": 1.0, "min": 1, "max": 3, "distinct_count": 3, "possible_identifier": True, "semantic_type": "identifier"}
    e = got["email"]
    assert e["null_count"] == 1 and math.isclose(e["null_percentage"], 100 / 3) and e["semantic_type"] == "email" and e["min"] == "al…om" and SECRET not in json.dumps(got)
    assert got["flag"]["top_values"] == [{"value": True, "count": 2, "percentage": 2 / 3 * 100}, {"value": False, "count": 1, "percentage": 1 / 3 * 100}] and got["flag"]["semantic_type"] == "boolean"
    assert got["email"]["string_lengths"]["max"] == 17
    assert [c["name"] for c in profile_file(spark, people, "csv", ["score", "id"])["columns"]] == ["score", "id"]
    assert profile_file(spark, people, "csv", sample=1)["columns"][0]["row_count"] == 1
    with pytest.raises(InvalidArgs):
        profile_file(spark, people, "csv", ["ID"])
    with pytest.raises(UnsupportedInput):
        profile_file(spark, people, "tsv")


def test_profile_of_odd_types(spark):
    df = spark.sql("SELECT * FROM VALUES (array(1), map('a', 1), DATE '2020-01-02', CAST(1.25 AS DECIMAL(9,2)), X'00'), (null, null, null, null, null) t(a, m, d, x, b)")
    got = {c["name"]: c for c in profile(df)}
    assert [got[c]["data_type"] for c in "amdxb"] == ["array", "object", "string", "float", "string"] and got["d"]["string_lengths"]["max"] == 10 and got["x"]["mean"] == 1.25
    assert profile(df.limit(0))[0]["null_percentage"] == 0.0
    assert profile(spark.createDataFrame([("x" * 9,)], "username string"), mask_identifiers=True)[0]["top_values"][0]["value"] == "xx…xx"


def test_profile_quantiles_are_exact(spark, monkeypatch):
    n = 60_001
    values = [(i * 7919) % n for i in range(n)]  # each of 0..60000 once
    df = spark.createDataFrame([(v, v % 997, None if v % 3 else v / 8) for v in values], "a long, b int, c double").repartition(5)
    plain = {"a": sorted(values), "b": sorted(v % 997 for v in values), "c": sorted(v / 8 for v in values if v % 3 == 0)}
    want = {c: {k: float(x[-(-q * len(x) // 100) - 1]) for k, q in (("p25", 25), ("p50", 50), ("p75", 75), ("p90", 90), ("p99", 99))} for c, x in plain.items()}
    assert {c["name"]: c["quantiles"] for c in profile(df)} == want
    monkeypatch.setattr(profiles, "MARGIN", 0.0)  # brackets that miss are widened
    assert {c["name"]: c["quantiles"] for c in profile(df)} == want


def test_profile_quantiles_of_no_numbers(spark):
    odd = [math.nan] * 4_000 + [math.inf, -math.inf, -0.0, 0.0] + [i / 4 for i in range(8_000)]
    for values, want in ((odd, [749.25, 1499.5, math.nan, math.nan, math.nan]), ([math.nan] * 3, [math.nan] * 5), ([None, 7.0], [7.0] * 5)):
        got = profile(spark.createDataFrame([(v,) for v in values], "x double"))[0]["quantiles"].values()
        assert [str(v) for v in got] == [str(v) for v in want], values[0]
    assert "quantiles" not in profile(spark.createDataFrame([(None,)], "x double"))[0]


def test_flat_profile_rounds_as_sql(spark):
    from lodestone.product_queries import _flat_profile

    df = spark.createDataFrame([(1 if i == 0 else 0, "x" if i < 31 else None) for i in range(32)], "n int, s string")
    got = {r.name: r for r in _flat_profile(spark, profile(df), True).collect()}
    assert got["n"]["mean"] == 0.0313  # 1 / 32
    three = spark.createDataFrame([(None,), (1,), (2,)], "n int")
    assert _flat_profile(spark, profile(three), True).first().null_percentage == 1 * 100.0 / 3


# --- queries over files


def test_query(spark, people, write, sf):
    r = run_query(spark, f"SELECT email, COUNT(*) AS n FROM '{people}' GROUP BY email ORDER BY email NULLS LAST LIMIT 2;")
    assert r.rows == [("alice@example.com", 1), ("bob@example.org", 1)] and not r.truncated and r.sources[0]["table"] == "people"
    r = run_query(spark, f"SELECT a.id, b.id FROM '{people}' a JOIN '{people}' b ON a.id < b.id WHERE a.code <> 'x.csv'", limit=1)
    assert r.columns == ["id", "id"] and (r.row_count_returned, r.total_row_count, r.truncated) == (1, 3, True) and len(r.sources) == 1
    assert run_query(spark, f"WITH x AS (SELECT * FROM '{sf}/region.parquet') SELECT (SELECT COUNT(*) FROM x) AS \"n\"").to_dict()["rows"] == [{"n": 5}]
    for bad, error in (("SELECT FROM WHERE", InvalidArgs), ("SELECT x FROM '/none/a.csv'", InputNotFound), (f"SELECT * FROM '{write('a.json', '{}')}'", UnsupportedInput), ("DROP TABLE x", InvalidArgs), (f"SELECT nope FROM '{people}'", InvalidArgs)):
        with pytest.raises(error):
            run_query(spark, bad)
    plan = prepare(spark, f"SELECT o_orderkey FROM '{sf}/orders.parquet' WHERE o_totalprice > 100000")[0]._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThan(o_totalprice" in plan and "o_orderpriority" not in plan.split("ReadSchema")[1]


# --- personal data


def test_scan(spark, write):
    text = "user_ssn,note,ipv6_address,card_number,site\n123-45-6789,see https://a.example/x,2001:db8::1,4111 1111 1111 1111,http://x.example\n666-45-6789,10.0.0.256 or 10.0.0.1,nothing,4111 1111 1111 1112,ftp\n"
    body = pii.scan_file(spark, write("p.csv", text), "csv")
    got = {(f["column"], f["entity"]): f for f in body["findings"]}
    assert body["scanned_rows"] == 2
    ssn = got["user_ssn", "US_SSN"]
    assert ssn["confidence"] == 0.8 and ssn["match_count"] == 1 and ssn["sample_evidence"] == ["12…89"] and ssn["reason"] == "column name matches context term 'ssn'; 1/2 values (50.0%) matched US_SSN and passed validation"
    assert got["ipv6_address", "IP_ADDRESS_V6"]["confidence"] == 0.7 and got["note", "URL"]["confidence"] == 0.75 and got["note", "IP_ADDRESS_V4"]["match_count"] == 1
    assert got["card_number", "CREDIT_CARD"]["confidence"] == 0.75 and "4111" not in json.dumps(body)
    assert pii.gate(body["findings"], 0.8) == 12 and pii.gate(body["findings"], 0.99) == 0


def test_scan_order_and_multiple_patterns(spark):
    r = pii.Recognizer("t", "TICKET", 0.6, (r"\bT-\d+\b", r"\b[TU]-\d{4,}\b"), ("ref",))
    df = spark.createDataFrame([(i, f"T-{i:08d} U-{i:08d} T-{i:08d}") for i in range(20)], "n int, text string")
    rows, found = pii.scan(df, [r], ["text"])
    assert rows == 20 and found[0]["match_count"] == 20 and found[0]["sample_evidence"] == ["T-…00", "U-…00", "T-…00"] and found[0]["confidence"] == 0.6
    with pytest.raises(InvalidArgs):
        pii.scan(df, [r], ["nope"])


def test_validators(spark):
    good = {"luhn": ["4111111111111111", "5555-5555-5555-4444"], "ipv4": ["1.2.3.4"], "ipv6": ["::1", "2001:db8::1", "1:2:3:4:5:6:7:8"], "url": ["https://a.example/x?y", "http://[::1]:80/"], "us_ssn": ["123-45-6789"], "uuid": ["123e4567-e89b-12d3-a456-426614174000"], "us_zip": ["12345-6789"], "aba": ["021000021"], "iban": ["DE89 3704 0044 0532 0130 00"], "birth_date": ["1980-02-29", "12/31/1999"]}
    bad = {"luhn": ["4111111111111112", "411111", "4111a11111111111"], "ipv4": ["1.2.3.256", "01.2.3.4"], "ipv6": ["abcd", "1::2::3", "dead"], "url": ["https://", "http://a b"], "us_ssn": ["666-45-6789", "900-45-6789", "000-11-1111"], "uuid": ["123e4567-e89b-62d3-a456-426614174000", "123e4567-e89b-12d3-c456-426614174000"], "us_zip": ["00000", "99999-1234"], "aba": ["021000022"], "iban": ["DE89 3704 0044 0532 0130 01"], "birth_date": ["1980-02-30", "1799-01-01"]}
    for name in validators.NAMES:
        both = good[name] + bad[name]
        kept = spark.createDataFrame([(both,)], "v array<string>").select(validators.keep_valid(F.col("v"), [name])).first()[0]
        assert kept == good[name], name


def test_recognizer_files(write):
    own = pii.load_recognizers(write("r.yaml", "recognizers:\n  - id: us_ssn\n    entity: US_SSN\n    confidence: 0.85\n    patterns: ['\\d{9}']\n  - id: new\n    entity: NEW\n    confidence: 0.6\n    patterns: [{regex: 'x+'}]\n    validators: [luhn]\n"))
    merged = pii.merge(pii.BUILTINS, own)
    assert len(merged) == 11 and merged[5].base == 0.85 and merged[-1].id == "new"
    for text, field in (("- {id: a, entity: A, confidence: 0.5, patterns: ['(']}", "patterns"), ("- {id: a, entity: A, confidence: 2, patterns: [x]}", "confidence"), ("- {id: a, entity: A, confidence: 0.5, patterns: [x], validators: [no]}", "validators"), ("- {id: a, entity: A, confidence: 0.5, patterns: ['(?=x)']}", "patterns"), ("- {id: a, entity: A, confidence: 0.5}", "patterns")):
        with pytest.raises(InvalidArgs, match=f"'a', field '{field}'"):
            pii.load_recognizers(write("b.yaml", text))
    with pytest.raises(InputNotFound):
        pii.load_recognizers("/none.yaml")
    with pytest.raises(InvalidArgs):
        pii.load_recognizers(write("c.yaml", "a: [b"))


# --- rules, schemas, policies, drift


def test_rules(spark):
    df = spark.createDataFrame([(1, "a", "5"), (1, None, "x"), (None, "z", "2020-01-01")], "k int, s string, t string")
    other = spark.createDataFrame([(2,)], "k int")
    rules = [Rule("n", "not_null", "k"), Rule("v", "accepted_values", "s", {"values": ["a"]}), Rule("t", "type", "t", {"type": "int"}), Rule("e", "expression", None, {"expression": "k < 2"}), Rule("d", "date_range", "t", {"min": "2021-01-01"}), Rule("u", "unique", "k"), Rule("c", "distinct_count", "s", {"min": 3}), Rule("r", "reference", "k", {"table": "o"}), Rule("q", "sql", None, {"query": "SELECT 1 FROM dataset WHERE s = 'z'"}), Rule("m", "not_null", "k", {"max_share": 0.5})]
    rules[4] = Rule("d", "date_range", "s2", {"min": "2021-01-01"})
    df = df.withColumn("s2", F.lit("2020-05-05"))
    got = {r.rule: (r.violations, r.passed) for r in quality.check_rules(df, rules, {"o": other}).collect()}
    assert got == {"n": (1, False), "v": (1, False), "t": (2, False), "e": (0, True), "d": (3, False), "u": (1, False), "c": (1, False), "r": (2, False), "q": (1, False), "m": (1, True)}
    with pytest.raises(InvalidArgs):
        quality.check_rules(df, [Rule("x", "nope")])


def test_schema_and_policy(spark):
    a, b = spark.sql("SELECT 1 AS x, 'a' AS y, 2 AS z").schema, spark.sql("SELECT 'a' AS y, CAST(1 AS BIGINT) AS x, CAST(null AS STRING) AS w").schema
    changes = {(d[0], d[1]): d[4] for d in schema.diff(a, b)}
    assert changes == {("x", "type"): True, ("z", "removed"): False, ("w", "added"): True, ("x", "order"): True, ("y", "order"): True}
    assert schema.validate(spark.sql("SELECT 1 AS x"), a.jsonValue())[0][:2] == ("y", "removed")
    rep = {"pii": {"findings": [{"column": "a", "entity": "US_SSN", "confidence": 0.9}, {"column": "b", "entity": "URL", "confidence": 0.9}]}}
    got = policy.evaluate_policies(rep, [{"id": "p", "section": "pii", "when": {"entity": "US_SSN"}, "require": {"confidence": {"lt": 0.5}}, "severity": "error"}])
    assert [(v["policy"], v["subject"]) for v in got] == [("p", "a")]
    with pytest.raises(InvalidArgs):
        policy.evaluate_policies(rep, [{"id": "p", "section": "pii", "when": {"entity": {"like": 1}}}])


def test_anonymise(spark):
    df = spark.createDataFrame([("Ab-12", "x", "k"), (None, "x", None)], "a string, b string, c string")
    r = anonymise.anonymise(df, {"a": {"method": "format_preserving", "key": "k"}, "b": {"method": "pseudonym", "key": "k"}, "c": {"method": "tokenise", "key": "k" * 80}}).collect()
    assert __import__("re").match(r"^[A-Z][a-z]-\d\d$", r[0].a) and r[1].a is None and r[0].b == r[1].b and r[1].c is None
    import hashlib
    import hmac

    assert r[0].b == "person_" + hmac.new(b"k", b"x", hashlib.sha256).hexdigest()[:12] and r[0].c == "tok_" + hmac.new(b"k" * 80, b"k", hashlib.sha256).hexdigest()[:32]
    assert spark.createDataFrame([("mail a@b.com now",)], "t string").select(anonymise.redact_text(F.col("t"), pii.BUILTINS[:1])).first()[0] == "mail [EMAIL_ADDRESS] now"
    with pytest.raises(InvalidArgs):
        anonymise.anonymise(df, {"a": {"method": "pseudonym"}})


def test_drift_and_evaluation(spark):
    a, b = spark.createDataFrame([("x",)] * 3 + [("y",)], "v string"), spark.createDataFrame([("x",), ("z",)], "v string")
    r = drift.distribution_shift(a, b, "v").first()
    assert (r.total_variation, r.new_values, r.lost_values) == (0.5, 1, 1) and r.psi > 0
    assert {x.column_name: x.status for x in drift.profile_drift(a, b.withColumn("w", F.lit(1))).collect()} == {"v": "kept", "w": "added"}
    t, f = spark.createDataFrame([(1, "E"), (2, "E")], "k int, entity string"), spark.createDataFrame([(2, "E"), (3, "E"), (3, "E")], "k int, entity string")
    e = evaluate.evaluate(t, f, ["k"]).first()
    assert (e.tp, e.fp, e.fn, e.precision, e.recall, e.f1) == (1, 1, 1, 0.5, 0.5, 0.5)
    x = spark.createDataFrame([("p", "c", "E", 0.5), ("q", "c", "E", 0.7)], "engine string, column string, entity string, confidence double")
    assert evaluate.compare_detectors(x).first().asDict() == {"column": "c", "entity": "E", "p": 0.5, "q": 0.7}


def test_lineage(spark, sf):
    df = spark.read.parquet(f"{sf}/region.parquet")
    assert lineage.plan_inputs(df)[0].endswith("region.parquet") and lineage.open_lineage_event("j", ["a"], ["b"])["outputs"][0]["name"] == "b"
    edges = lineage.dbt_edges(spark, {"parent_map": {"b": ['a "q"']}})
    assert lineage.export_edges(edges, "cypher").first()[0].startswith('MERGE (a:Dataset {name: "a \\"q\\""})')
    assert "<urn:dataset:b>" in lineage.export_edges(edges, "rdf").first()[0] and "<edge " in lineage.graphml_document(edges)


# --- envelope, configuration, command line


def run(*argv):
    out = io.StringIO()
    code = cli.main(list(argv), out)
    return code, out.getvalue()


def test_cli(spark, people, write, sf, capsys):
    code, text = run("--output", "json", "inspect", people)
    doc = json.loads(text)
    assert code == 0 and doc["schema_version"] == "1.0" and doc["input"]["content_hash"].startswith("sha256:") and doc["dataset"]["row_count"] == 3 and doc["run"]["id"][14] == "7"
    assert run("inspect", people)[1].startswith("format:       csv\n")
    assert run("--output", "csv", "query", f"SELECT id, score FROM '{people}' ORDER BY id")[1] == "id,score\n1,1.5\n2,\n3,2.5\n"
    doc = json.loads(run("--output", "json", "profile", people, "--columns", "id,score", "--sample", "2")[1])
    assert doc["profile"]["sample_size"] == 2 and [c["name"] for c in doc["profile"]["columns"]] == ["id", "score"]
    code, text = run("--output", "json", "pii", "scan", people, "--fail-on", "0.7")
    assert code == 12 and SECRET not in text and json.loads(text)["pii"]["findings"][0]["entity"] == "EMAIL_ADDRESS"
    q = write("q.sql", "select top 3 a from t")
    assert run("sql", "transpile", q, "--from", "tsql", "--to", "duckdb") == (0, "SELECT a FROM t LIMIT 3\n")
    assert run("sql", "format", q, "--dialect", "tsql", "--write")[0] == 0 and open(q).read() == "SELECT TOP 3\n  a\nFROM\n  t\n"
    assert json.loads(run("--output", "json", "sql", "parse", q, "--dialect", "tsql")[1])["extensions"]["sql_parse"]["columns"] == ["a"]
    assert run("capabilities")[0] == 0 and run("version")[1] == f"lodestone {report.VERSION}\n" and run("pii", "recognizers", "list")[0] == 0 and run("doctor")[0] == 0
    assert run("report", people, "--as", "markdown")[1].startswith("# Report") and "summary:" in run("report", people, "--as", "yaml")[1]
    for argv, want in ((("inspect", "/none.csv"), 3), (("profile", "-"), 2), (("sql", "parse", q, "--dialect", "no"), 4), (("--output", "csv", "version"), 2), (("nope",), 2), (("query", "SELECT FROM WHERE"), 2), (("pii", "scan", people, "--fail-on", "3"), 2)):
        assert run(*argv)[0] == want, argv
    capsys.readouterr()
    assert run("--output", "json", "inspect", "/none.csv")[0] == 3 and json.loads(capsys.readouterr().err)["code"] == "input_not_found"


def test_config(tmp_path):
    (tmp_path / "lodestone.yaml").write_text("output: json\nthreads: 2\n")
    assert config.load(tmp_path, {}) == config.Config("json", 2)
    assert config.load(tmp_path, {"LODESTONE_OUTPUT": "table", "LODESTONE_THREADS": "4"}) == config.Config("table", 4)
    (tmp_path / "lodestone.yaml").write_text("output: [")
    with pytest.raises(InvalidArgs):
        config.load(tmp_path, {})


def test_report_status():
    b = report.consolidated({"sample_size": None, "columns": []}, {"scanned_rows": 1, "findings": [{"column": "a", "entity": "E", "confidence": 0.5}]})
    assert b.build()["summary"] == {"status": "warning", "errors": 0, "warnings": 1, "info": 0} and report.json_schema()["required"][0] == "schema_version"


# --- streams


def test_stream(spark, tmp_path):
    from lodestone.streaming.scans import profile_batches, windowed_findings

    spark.sql("SELECT TIMESTAMP '2024-01-01 00:00:10' AS at, 'a@b.com' AS t UNION ALL SELECT TIMESTAMP '2024-01-01 00:01:10', 'none' UNION ALL SELECT TIMESTAMP '2024-01-01 00:07:00', 'c@d.org'").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("at timestamp, t string").parquet(str(tmp_path / "in"))
    q = windowed_findings(stream, "t", "at", pii.BUILTINS[:1]).writeStream.outputMode("complete").format("memory").queryName("hits").start()
    q.processAllAvailable()
    q.stop()
    assert sorted((r.rows, r.rows_with_valid) for r in spark.table("hits").collect()) == [(1, 1), (2, 1)]
    seen = []
    q = profile_batches(stream, lambda k, p: seen.append((k, p[0]["row_count"])), ["t"], str(tmp_path / "ck"))
    q.processAllAvailable()
    q.stop()
    assert seen == [(0, 3)]


def test_declared_pipeline(spark, people, tmp_path):
    from lodestone.operators.pipeline import run_pipeline

    steps = [
        {"name": "out", "op": "write", "input": "masked", "path": str(tmp_path / "out")}, {"name": "raw", "op": "read", "path": people}, {"name": "checked", "op": "quality", "input": "raw", "rules": [{"name": "mail", "kind": "not_null", "column": "email"}]},
        {"name": "some", "op": "filter", "input": "checked", "where": "email is not null"}, {"name": "masked", "op": "anonymise", "input": "some", "columns": {"email": {"method": "mask"}}}, {"name": "n", "op": "sql", "inputs": ["raw"], "query": "SELECT count(*) AS n FROM raw"},
    ]
    tables, manifest = run_pipeline(spark, steps)
    assert tables["n"].first().n == 3 and {r.email for r in spark.read.parquet(str(tmp_path / "out")).collect()} == {"al…om", "bo…rg"}
    assert next(m for m in manifest if m["name"] == "checked")["failed"] == ["mail"]
    for bad in ([{"name": "a", "op": "nope"}], [{"name": "a", "op": "filter", "input": "b"}], [{"name": "a", "op": "filter", "input": "a"}]):
        with pytest.raises(InvalidArgs):
            run_pipeline(spark, bad)
