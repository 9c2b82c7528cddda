"""The eleven dialects: names, quoting, and which constructs each of them has."""

from __future__ import annotations

from dataclasses import dataclass, field

from lodestone.errors import UnsupportedInput

DEFAULT = "ansi"


@dataclass(frozen=True)
class Dialect:
    name: str
    #: What the dialect is called in messages.
    title: str
    #: Opening and closing quote of identifiers when it writes them.
    quote: tuple[str, str] = ('"', '"')
    #: Opening quotes that it reads as identifiers.
    reads: str = '"`['
    double_is_string: bool = False
    qualify: bool = False
    pivot: bool = False
    limit: str = "LIMIT"
    ilike: bool = False
    functions: dict[str, str] = field(default_factory=dict)
    types: dict[str, str] = field(default_factory=dict)


_TICK = ("`", "`")
#: What the dialects' public manuals say of them.
DIALECTS = {
    d.name: d
    for d in (
        Dialect("ansi", "ANSI SQL"),
        Dialect("postgres", "PostgreSQL", ilike=True, functions={"IFNULL": "COALESCE", "NVL": "COALESCE"}, types={"STRING": "TEXT", "DOUBLE": "DOUBLE PRECISION", "DATETIME": "TIMESTAMP", "TINYINT": "SMALLINT"}),
        Dialect("duckdb", "DuckDB", qualify=True, pivot=True, ilike=True, functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT", "NVL": "COALESCE"}, types={"STRING": "TEXT", "DATETIME": "TIMESTAMP"}),
        Dialect("spark", "Spark SQL", quote=_TICK, reads="`", double_is_string=True, pivot=True, ilike=True, functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT", "ISNULL": "COALESCE"}, types={"TEXT": "STRING", "VARCHAR": "STRING", "DATETIME": "TIMESTAMP"}),
        Dialect("databricks", "Databricks", quote=_TICK, reads="`", double_is_string=True, qualify=True, pivot=True, ilike=True, functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT", "ISNULL": "COALESCE"}, types={"TEXT": "STRING", "VARCHAR": "STRING", "DATETIME": "TIMESTAMP"}),
        Dialect("snowflake", "Snowflake", qualify=True, pivot=True, ilike=True, functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT"}, types={"STRING": "VARCHAR"}),
        Dialect("bigquery", "BigQuery", quote=_TICK, reads="`", double_is_string=True, qualify=True, pivot=True, functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT", "NVL": "IFNULL"}, types={"TEXT": "STRING", "VARCHAR": "STRING", "INT": "INT64", "INTEGER": "INT64", "BIGINT": "INT64", "DOUBLE": "FLOAT64", "BOOLEAN": "BOOL"}),
        Dialect("trino", "Trino", functions={"APPROX_COUNT_DISTINCT": "APPROX_DISTINCT", "NVL": "COALESCE", "IFNULL": "COALESCE"}, types={"STRING": "VARCHAR", "TEXT": "VARCHAR", "DATETIME": "TIMESTAMP"}),
        Dialect("mysql", "MySQL", quote=_TICK, reads="`", double_is_string=True, functions={"NVL": "IFNULL"}, types={"STRING": "TEXT"}),
        Dialect("sqlite", "SQLite", functions={"NVL": "IFNULL"}, types={"STRING": "TEXT"}),
        Dialect("tsql", "T-SQL", quote=("[", "]"), reads='"[', pivot=True, limit="TOP", functions={"APPROX_DISTINCT": "APPROX_COUNT_DISTINCT", "IFNULL": "ISNULL", "NVL": "ISNULL", "LENGTH": "LEN"}, types={"STRING": "VARCHAR", "BOOLEAN": "BIT", "TEXT": "VARCHAR", "DOUBLE": "FLOAT"}),
    )
}
ALIASES = {"postgresql": "postgres", "mssql": "tsql", "sqlserver": "tsql"}


def resolve(name: str | None) -> Dialect:
    low = (name or DEFAULT).strip().lower()
    low = ALIASES.get(low, low)
    if low not in DIALECTS:
        raise UnsupportedInput(f"unsupported SQL dialect: '{name}'", f"use one of: {', '.join(DIALECTS)}")
    return DIALECTS[low]
