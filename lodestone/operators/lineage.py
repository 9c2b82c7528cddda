"""Lineage of DataFrames from their analysed plans, lineage events, and graph exports."""

from __future__ import annotations

import re
import uuid
from datetime import UTC, datetime
from xml.sax.saxutils import escape

from pyspark.sql import DataFrame, SparkSession


def plan_inputs(df: DataFrame) -> list[str]:
    """Tables and files that a DataFrame reads."""
    files = sorted({re.sub(r"/[^/]*$", "", f) if f.endswith("part") else f for f in df.inputFiles()})
    names = set(re.findall(r"SubqueryAlias spark_catalog\.(\S+)", df._jdf.queryExecution().analyzed().toString()))
    return sorted(names) + files


def open_lineage_event(job: str, inputs: list[str], outputs: list[str], state: str = "COMPLETE", namespace: str = "lodestone") -> dict:
    """A run event in the OpenLineage format."""
    data = lambda names: [{"namespace": namespace, "name": n} for n in names]
    return {
        "eventType": state, "eventTime": datetime.now(UTC).isoformat(), "run": {"runId": str(uuid.uuid4())}, "job": {"namespace": namespace, "name": job}, "inputs": data(inputs), "outputs": data(outputs),
        "producer": "lodestone", "schemaURL": "https://openlineage.io/spec/2-0-2/OpenLineage.json#/$defs/RunEvent",
    }


def dbt_edges(spark: SparkSession, manifest: dict) -> DataFrame:
    """(source, target) of a dbt manifest's parent map."""
    rows = [(p, child) for child, parents in (manifest.get("parent_map") or {}).items() for p in parents]
    return spark.createDataFrame(rows, "source string, target string")


def export_edges(edges: DataFrame, fmt: str) -> DataFrame:
    """(line) of an edges table (source, target) as cypher, rdf (N-Triples) or graphml; written by tasks, not gathered."""
    from pyspark.sql import functions as F

    quote = lambda c: F.concat(F.lit('"'), F.regexp_replace(F.col(c), r'(["\\])', r"\\$1"), F.lit('"'))
    if fmt == "cypher":
        line = F.concat(F.lit("MERGE (a:Dataset {name: "), quote("source"), F.lit("}) MERGE (b:Dataset {name: "), quote("target"), F.lit("}) MERGE (a)-[:FEEDS]->(b);"))
    elif fmt == "rdf":
        iri = lambda c: F.concat(F.lit("<urn:dataset:"), F.url_encode(F.col(c)), F.lit(">"))
        line = F.concat(iri("source"), F.lit(" <urn:lodestone:feeds> "), iri("target"), F.lit(" ."))
    elif fmt == "graphml":
        safe = lambda c: F.regexp_replace(F.regexp_replace(F.regexp_replace(F.col(c), "&", "&amp;"), "<", "&lt;"), '"', "&quot;")
        line = F.concat(F.lit('<edge source="'), safe("source"), F.lit('" target="'), safe("target"), F.lit('"/>'))
    else:
        from lodestone.errors import InvalidArgs

        raise InvalidArgs(f"unknown graph format '{fmt}'", "use cypher, rdf or graphml")
    return edges.select(line.alias("line"))


def graphml_document(edges: DataFrame) -> str:
    """A small lineage graph as one document."""
    rows = edges.collect()
    nodes = "".join(f'<node id="{escape(n, {chr(34): "&quot;"})}"/>' for n in sorted({x for r in rows for x in (r.source, r.target)}))
    lines = "".join(r.line for r in export_edges(edges, "graphml").collect())
    return f'<?xml version="1.0" encoding="UTF-8"?><graphml xmlns="http://graphml.graphdrawing.org/xmlns"><graph edgedefault="directed">{nodes}{lines}</graph></graphml>'
