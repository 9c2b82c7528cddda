"""Format detection and the engine's view of files: which format, which table name, which readers."""

from __future__ import annotations

import hashlib
import os
import re

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.errors import InputNotFound, InvalidArgs, LodestoneError, UnsupportedInput

FORMATS = ["csv", "tsv", "json", "jsonl", "parquet"]
ALIASES = {"ndjson": "jsonl"}
PREFIX = 64 * 1024


def from_flag(name: str) -> str:
    low = name.strip().lower()
    low = ALIASES.get(low, low)
    if low not in FORMATS:
        raise InvalidArgs(f"unknown format '{name}'", f"use one of: {', '.join(FORMATS)}")
    return low


def from_extension(path: str) -> str | None:
    ext = os.path.splitext(path)[1].lstrip(".").lower()
    ext = ALIASES.get(ext, ext)
    return ext if ext in FORMATS else None


def from_bytes(head: bytes) -> str | None:
    """What the first bytes of a file look like; None if they do not tell."""
    if head.startswith(b"PAR1"):
        return "parquet"
    text = head.decode("utf-8", "ignore").lstrip("﻿").lstrip()
    if text.startswith("["):
        return "json"
    if text.startswith("{"):
        return "jsonl" if sum(bool(x.strip()) for x in text.splitlines()) > 1 else "json"
    line = text.splitlines()[0] if text else ""
    commas, tabs = line.count(","), line.count("\t")
    return None if commas == tabs else "csv" if commas > tabs else "tsv"


def is_remote(path: str) -> bool:
    return re.match(r"^[A-Za-z][A-Za-z0-9+.-]*://", path) is not None


def require(spark: SparkSession | None, path: str) -> None:
    found = os.path.exists(path)
    if is_remote(path) and spark is not None:
        p = spark._jvm.org.apache.hadoop.fs.Path(path)
        found = p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)
    if not found:
        raise InputNotFound(f"{path} does not exist", "check the path")


def head_of(path: str, spark: SparkSession | None = None) -> bytes:
    if is_remote(path) and spark is not None:
        rows = spark.read.format("binaryFile").load(path).select(F.substring(F.col("content"), 1, PREFIX).alias("h")).take(1)
        return bytes(rows[0].h) if rows else b""
    try:
        with open(path, "rb") as f:
            return f.read(PREFIX)
    except OSError as e:
        raise InputNotFound(f"{path} cannot be read", "check the path and its permissions") from e


def detect(target: str, type_flag: str | None = None, spark: SparkSession | None = None) -> str:
    """The flag, else the extension, else the content. Standard input (-) needs the flag."""
    if type_flag:
        return from_flag(type_flag)
    if target == "-":
        raise InvalidArgs("standard input needs an explicit format", "pass --type")
    found = from_extension(target) or (None if os.path.isdir(target) else from_bytes(head_of(target, spark)))
    if found is None:
        raise UnsupportedInput(f"cannot tell the format of {target}", f"pass --type with one of: {', '.join(FORMATS)}")
    return found


def content_format(content):
    """from_bytes as an expression over a column of file contents, for many files at once."""
    head = F.decode(F.substring(content, 1, PREFIX), "UTF-8")
    text = F.regexp_replace(head, "^[\\s﻿]+", "")
    line = F.regexp_extract(text, r"^[^\r\n]*", 0)
    count = lambda c: F.length(line) - F.length(F.replace(line, F.lit(c)))
    lines = F.size(F.filter(F.split(text, r"\r?\n"), lambda x: F.trim(x) != ""))
    return (
        F.when(F.substring(content, 1, 4) == F.lit(b"PAR1"), "parquet").when(text.startswith("["), "json").when(text.startswith("{"), F.when(lines > 1, "jsonl").otherwise("json"))
        .when(count(",") > count("\t"), "csv").when(count(",") < count("\t"), "tsv")
    )


def content_hash(path: str) -> str:
    digest = hashlib.sha256()
    with open(path, "rb") as f:
        while part := f.read(PREFIX):
            digest.update(part)
    return f"sha256:{digest.hexdigest()}"


def content_hashes(spark: SparkSession, paths: str) -> DataFrame:
    """(path, content_hash, format) of every file under paths, computed where the files lie."""
    files = spark.read.format("binaryFile").load(paths)
    return files.select("path", F.concat(F.lit("sha256:"), F.sha2("content", 256)).alias("content_hash"), content_format(F.col("content")).alias("format"))


def table_name(path: str) -> str:
    """The file's stem with all but ASCII letters and digits as underscores; t_ before a digit; t if nothing is left."""
    stem = os.path.splitext(os.path.basename(path.rstrip("/")))[0]
    name = re.sub(r"[^A-Za-z0-9]", "_", stem)
    return "t" if not name else f"t_{name}" if name[0].isdigit() else name


CSV_OPTIONS = {"header": True, "quote": '"', "escape": '"', "mode": "PERMISSIVE", "encoding": "UTF-8"}


def _delimited(spark: SparkSession, path: str, fmt: str) -> dict:
    """Options of a delimited file. Files are split by lines among tasks, unless a quoted field spans lines: then one has an odd number of quotes."""
    quotes = F.length("value") - F.length(F.replace("value", F.lit('"')))
    spans_lines = not spark.read.text(path).where(quotes % 2 == 1).isEmpty()
    return CSV_OPTIONS | {"multiLine": spans_lines, "sep": "\t" if fmt == "tsv" else ","}


def read_strings(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A delimited file with every value as text and empty fields as null."""
    df = spark.read.options(**_delimited(spark, path, fmt), inferSchema=False, nullValue="", emptyValue="").csv(path)
    return df.select(*(F.nullif(F.col(quoted(c)), F.lit("")).alias(c) for c in df.columns))


def read_typed(spark: SparkSession, path: str, fmt: str) -> DataFrame:
    """A file as the engine sees it, with inferred types. JSON arrays are for inspection only."""
    require(spark, path)
    if fmt == "parquet":
        return spark.read.parquet(path)
    if fmt in ("csv", "tsv"):
        return spark.read.options(**_delimited(spark, path, fmt), inferSchema=True).csv(path)
    if fmt == "jsonl":
        try:
            return spark.read.option("mode", "FAILFAST").json(path)
        except Exception as e:
            raise LodestoneError(f"{path} holds a line that is not JSON") from e
    raise UnsupportedInput("JSON arrays cannot be registered as tables", "convert the file to JSON lines")


def register(spark: SparkSession, path: str, fmt: str, taken: set[str]) -> str:
    """Register a file as a temporary view whose name is not yet taken; _2, _3 and so on set equal stems apart."""
    base = table_name(path)
    name, k = base, 2
    while name.lower() in taken:
        name, k = f"{base}_{k}", k + 1
    read_typed(spark, path, fmt).createOrReplaceTempView(name)
    taken.add(name.lower())
    return name


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def ordered(df: DataFrame, path: str, fmt: str) -> DataFrame:
    """df with __row, its rows' places in the source. Parquet files know theirs; text is numbered in reading order."""
    if fmt == "parquet":
        return df.select("*", F.struct(F.col("_metadata.file_path"), F.col("_metadata.row_index")).alias("__row"))
    return df.select("*", F.struct(F.lit("").alias("file_path"), F.monotonically_increasing_id().alias("row_index")).alias("__row"))


def row_groups(spark: SparkSession, files: list[str], enough: int) -> int:
    """How many row groups Parquet files have by their footers, counted up to `enough`."""
    jvm, conf, n = spark._jvm, spark._jsc.hadoopConfiguration(), 0
    for file in files:
        reader = jvm.org.apache.parquet.hadoop.ParquetFileReader.open(jvm.org.apache.parquet.hadoop.util.HadoopInputFile.fromPath(jvm.org.apache.hadoop.fs.Path(file), conf))
        try:
            n += len(reader.getFooter().getBlocks())
        finally:
            reader.close()
        if n >= enough:
            break
    return n


def spread(df: DataFrame, most_files: int = 64) -> DataFrame:
    """df read from Parquet, dealt out anew if it has fewer row groups than the cluster has cores, since a task reads a whole one.

    Only tables of a few files can be that small, so larger ones are never looked at nor moved."""
    cores, files = df.sparkSession.sparkContext.defaultParallelism, df.inputFiles()
    few = 0 < len(files) < min(cores, most_files) and all(f.endswith(".parquet") for f in files) and row_groups(df.sparkSession, files, cores) < cores
    return df.repartition(cores) if few else df


def read_arrow(spark: SparkSession, path: str) -> DataFrame:
    """An Arrow IPC file or stream as a DataFrame: the driver reads the schema and the number of batches, tasks read the batches.

    A stream has no index, so its batches are read in one task, one at a time. The path must be one that executors can open."""
    import pyarrow as pa
    from pyspark.sql.pandas.types import from_arrow_schema

    with open(path, "rb") as f:
        magic = f.read(6) == b"ARROW1"
    with pa.memory_map(path) as source:
        reader = pa.ipc.open_file(source) if magic else pa.ipc.open_stream(source)
        schema, batches = from_arrow_schema(reader.schema), reader.num_record_batches if magic else 1

    def read(numbers):
        with pa.memory_map(path) as held:
            if not magic:
                for _ in numbers:
                    yield from pa.ipc.open_stream(held)
                return
            opened = pa.ipc.open_file(held)
            for rows in numbers:
                yield from (opened.get_batch(k) for k in rows.column(0).to_pylist())

    return spark.range(0, batches, 1, max(1, min(batches, spark.sparkContext.defaultParallelism))).mapInArrow(read, schema)


def read_jdbc(spark: SparkSession, url: str, table: str, **options: str) -> DataFrame:
    """A database table; give partitionColumn, lowerBound, upperBound and numPartitions to read it in parallel."""
    return spark.read.format("jdbc").options(url=url, dbtable=table, **options).load()
