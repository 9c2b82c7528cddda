"""Dataset inspection: schema with narrowed types, counts, sizes and masked sample rows."""

from __future__ import annotations

import json
import os

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InvalidArgs, LodestoneError, UnsupportedInput
from lodestone.functions.masking import mask, sensitive_fragment
from lodestone.functions.types import ARRAY, BOOLEAN, FLOAT, INTEGER, MIXED, NULL, OBJECT, PHYSICAL, STRING
from lodestone.sources.formats import is_remote, quoted, read_strings, require

SAMPLE_ROWS, STRING_COST = 5, 24
BOOL_RE = "^(true|false)$"
INT_RE = "^[+-]?[0-9]+$"
FLOAT_RE = r"^[+-]?(([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?|(?i:inf|infinity|nan))$"


def narrowed(col: Column) -> Column:
    """The narrowest type that all non-null values of a text column fit, as an aggregate."""
    fits = lambda test: F.coalesce(F.bool_and(test), F.lit(True))
    integer = col.rlike(INT_RE) & col.try_cast("long").isNotNull()
    return (
        F.when(F.count(col) == 0, NULL).when(fits(col.rlike(BOOL_RE)), BOOLEAN).when(fits(integer), INTEGER).when(fits(col.rlike(FLOAT_RE)), FLOAT).otherwise(STRING)
    )


def narrow_frame(df: DataFrame) -> DataFrame:
    """(name, data_type, nullable) of a table of text columns, from one aggregation."""
    flat = df.agg(F.count("*").alias("__rows"), *(x for i, c in enumerate(df.columns) for x in (narrowed(F.col(quoted(c))).alias(f"t{i}"), F.count(F.col(quoted(c))).alias(f"n{i}"))))
    rows = F.explode(F.array(*(F.struct(F.lit(c).alias("name"), F.col(f"t{i}").alias("data_type"), (F.col(f"n{i}") < F.col("__rows")).alias("nullable")) for i, c in enumerate(df.columns)))).alias("x")
    return flat.select(rows).select("x.*")


def value_cost(col: Column, kind: str) -> Column:
    """Bytes that a value counts for in the estimate of memory."""
    if kind == STRING:
        return F.coalesce(F.octet_length(col) + STRING_COST, F.lit(1))
    return F.when(col.isNull(), 1).otherwise({INTEGER: 8, FLOAT: 8, BOOLEAN: 1, NULL: 1}.get(kind, STRING_COST))


def memory_bytes(df: DataFrame, kinds: dict[str, str]) -> DataFrame:
    total = sum((F.coalesce(F.sum(value_cost(F.col(quoted(c)), k)), F.lit(0)) for c, k in kinds.items()), F.lit(0))
    return df.agg(total.cast("long").alias("approx_memory_bytes"))


def _typed(value: str | None, kind: str):
    if value is None:
        return None
    if kind == BOOLEAN:
        return value == "true"
    if kind == INTEGER:
        return int(value)
    if kind == FLOAT:
        x = float(value)
        return x if x == x and abs(x) != float("inf") else None
    return value


def mask_rows(rows: list[dict]) -> list[dict]:
    """Values of columns with sensitive names as their masks; null stays null."""
    hide = lambda c, v: v if v is None or sensitive_fragment(c) is None else mask(v if isinstance(v, str) else json.dumps(v))
    return [{c: hide(c, v) for c, v in r.items()} for r in rows]


def _dataset(fmt: str, size: int, rows: int, schema: list[dict], memory: int, sample: list[dict], **more) -> dict:
    return {"format": fmt, "file_size_bytes": size, "row_count": rows, "column_count": len(schema), "schema": schema, "approx_memory_bytes": memory, "sample_rows": mask_rows(sample)} | more


def inspect_delimited(spark: SparkSession, path: str, fmt: str, size: int) -> dict:
    df = read_strings(spark, path, fmt)
    schema = [r.asDict() for r in narrow_frame(df).collect()]
    kinds = {c["name"]: c["data_type"] for c in schema}
    memory = memory_bytes(df, kinds).first()[0]
    sample = [{c: _typed(r[c], kinds[c]) for c in df.columns} for r in df.limit(SAMPLE_ROWS).collect()]
    return _dataset(fmt, size, df.count(), schema, memory, sample)


# --- JSON: kinds come from the raw tokens, because schema inference would turn mixed values into strings


def json_records(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """(at, record): each record as a variant. Lines are split among tasks; an array is one document by its nature."""
    if fmt == "jsonl":
        lines = spark.read.text(path).where(F.trim("value") != "").select(F.monotonically_increasing_id().alias("at"), F.try_parse_json("value").alias("record"))
        return lines
    whole = spark.read.text(path, wholetext=True).select(F.try_parse_json("value").alias("doc"))
    kind = F.schema_of_variant("doc")
    rows = F.when(kind.startswith("ARRAY"), F.col("doc").try_cast("array<variant>")).otherwise(F.array("doc"))
    return whole.select(F.posexplode_outer(rows).alias("at", "record")).where("at is not null")


def family(value: Column) -> Column:
    """The family of a variant's token: null, boolean, integer, float, string, array or object."""
    kind = F.schema_of_variant(value)
    return (
        F.when(value.isNull() | F.is_variant_null(value) | (kind == "VOID"), NULL).when(kind == "BOOLEAN", BOOLEAN).when(kind == "BIGINT", INTEGER)
        .when(kind.rlike(r"^DECIMAL\(\d+,0\)$"), INTEGER).when(kind.rlike("^(DECIMAL|DOUBLE|FLOAT)"), FLOAT).when(kind.startswith("ARRAY"), ARRAY).when(kind.startswith("OBJECT"), OBJECT).otherwise(STRING)
    )


def json_fields(records: DataFrame) -> DataFrame:
    """(at, key, family, cost) of every field of every record."""
    fields = records.select("at", F.explode(F.map_entries(F.col("record").cast("map<string,variant>"))).alias("e"))
    kind, text = family(F.col("e.value")), F.col("e.value").try_cast("string")
    cost = F.when(kind == STRING, F.octet_length(text) + STRING_COST).when(kind.isin(INTEGER, FLOAT), 8).when(kind.isin(BOOLEAN, NULL), 1).otherwise(STRING_COST)
    return fields.select("at", F.col("e.key").alias("key"), kind.alias("family"), cost.alias("cost"))


def json_schema_frame(records: DataFrame) -> DataFrame:
    """(name, data_type, nullable, bytes, first_at): the kind of each key over all records, in order of first sight, keys of one record by name."""
    total = records.agg(F.count("*").alias("n"))
    kinds = F.array_remove(F.collect_set("family"), NULL)
    by_key = json_fields(records).groupBy("key").agg(kinds.alias("kinds"), F.count_if(F.col("family") != NULL).alias("present"), F.sum("cost").alias("bytes"), F.min("at").alias("first_at"))
    numbers = F.size(F.array_except("kinds", F.array(F.lit(INTEGER), F.lit(FLOAT)))) == 0
    kind = F.when(F.size("kinds") == 0, NULL).when(F.size("kinds") == 1, F.element_at("kinds", 1)).when(numbers, FLOAT).otherwise(MIXED)
    return by_key.crossJoin(F.broadcast(total)).select(F.col("key").alias("name"), kind.alias("data_type"), (F.col("present") < F.col("n")).alias("nullable"), "bytes", "first_at")  # total is one row


def inspect_json(spark: SparkSession, path: str, fmt: str, size: int) -> dict:
    records = json_records(spark, path, fmt).cache()
    try:
        wrong = records.where(F.col("record").isNull() | ~F.schema_of_variant("record").startswith("OBJECT")).isEmpty()
        if not wrong:
            if fmt == "jsonl":
                raise LodestoneError(f"{path} holds a line that is not a JSON object")
            raise UnsupportedInput(f"{path} is not a JSON object or an array of objects", "give an array of objects")
        found = json_schema_frame(records).orderBy("first_at", "name").collect()
        sample = [json.loads(r.j) for r in records.orderBy("at").limit(SAMPLE_ROWS).select(F.to_json("record").alias("j")).collect()]
        names = [r.name for r in found]
        schema = [{"name": r.name, "data_type": r.data_type, "nullable": r.nullable} for r in found]
        return _dataset(fmt, size, records.count(), schema, sum(r.bytes for r in found), [{n: s.get(n) for n in names} for s in sample])
    finally:
        records.unpersist()


# --- Parquet: from footers alone


def parquet_footers(spark: SparkSession, path: str) -> DataFrame:
    """One row for each row group of each file under path, read from footers; no data page is touched."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    fs = root.getFileSystem(conf)
    files = [s.getPath() for s in fs.listStatus(root) if s.isFile() and not s.getPath().getName().startswith(("_", "."))]
    rows = []
    for file in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
        try:
            for k, block in enumerate(reader.getFooter().getBlocks()):
                codecs = sorted({str(c.getCodec()) for c in block.getColumns()})
                rows.append((file.toString(), k, block.getRowCount(), block.getCompressedSize(), block.getTotalByteSize(), codecs))
        finally:
            reader.close()
    return spark.createDataFrame(rows, "file string, row_group int, row_count long, compressed_bytes long, uncompressed_bytes long, codecs array<string>")


def parquet_leaves(spark: SparkSession, path: str) -> list[dict]:
    """Leaf columns with their types by physical storage, from the first footer."""
    jvm, conf = spark._jvm, spark._jsc.hadoopConfiguration()
    root = jvm.org.apache.hadoop.fs.Path(path)
    file = next(s.getPath() for s in root.getFileSystem(conf).listStatus(root) if s.isFile() and not s.getPath().getName().startswith(("_", ".")))
    reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(file, conf))
    try:
        return [{"name": list(d.getPath())[-1], "data_type": PHYSICAL.get(str(d.getPrimitiveType().getPrimitiveTypeName()), STRING), "nullable": str(d.getPrimitiveType().getRepetition()) != "REQUIRED"} for d in reader.getFooter().getFileMetaData().getSchema().getColumns()]
    finally:
        reader.close()


def inspect_parquet(spark: SparkSession, path: str, size: int) -> dict:
    groups = parquet_footers(spark, path).orderBy("file", "row_group").collect()
    sample = [r.asDict(recursive=True) for r in spark.read.parquet(path).limit(SAMPLE_ROWS).collect()]
    plain = json.loads(json.dumps(sample, default=str))
    listed = [{"index": k, "row_count": g.row_count, "compressed_bytes": g.compressed_bytes, "uncompressed_bytes": g.uncompressed_bytes} for k, g in enumerate(groups)]
    info = {"row_groups": listed, "compression_codecs": sorted({c for g in groups for c in g.codecs})}
    return _dataset("parquet", size, sum(g.row_count for g in groups), parquet_leaves(spark, path), sum(g.uncompressed_bytes for g in groups), plain, parquet=info)


def inspect(spark: SparkSession, path: str, fmt: str) -> dict:
    """The dataset section of a report. Standard input must have been spooled to a file."""
    if path == "-":
        raise InvalidArgs("standard input must be spooled first", "pass a path")
    require(spark, path)
    if is_remote(path):
        root = spark._jvm.org.apache.hadoop.fs.Path(path)
        size = root.getFileSystem(spark._jsc.hadoopConfiguration()).getContentSummary(root).getLength()
    else:
        size = os.path.getsize(path) if os.path.isfile(path) else sum(e.stat().st_size for e in os.scandir(path) if e.is_file())
    if fmt == "parquet":
        return inspect_parquet(spark, path, size)
    return inspect_json(spark, path, fmt, size) if fmt in ("json", "jsonl") else inspect_delimited(spark, path, fmt, size)


def humanize_bytes(n: int) -> str:
    if n < 1024:
        return f"{n} B"
    x = float(n)
    for unit in ("KiB", "MiB", "GiB", "TiB", "PiB"):
        x /= 1024
        if x < 1024:
            break
    return f"{x:.1f} {unit}"

