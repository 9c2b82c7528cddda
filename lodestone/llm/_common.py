"""Shared helpers of the training-data operators: durable intermediate results and Arrow batching."""

from __future__ import annotations

import atexit
import tempfile
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lodestone.sources.formats import spread


def checkpoint_dir(spark: SparkSession) -> str:
    """The shared folder that the cluster names in spark.checkpoint.dir; where none is named, one of its own on local masters only."""
    sc = spark.sparkContext
    named = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if not named:
        current = sc._jsc.sc().getCheckpointDir()
        if current.isDefined():
            named = current.get()
        elif sc.master == "local" or sc.master.startswith("local["):
            named = tempfile.mkdtemp(prefix="lodestone-ckpt-")
        else:
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        sc.setCheckpointDir(named)
    return named


def _remove(spark: SparkSession, path: str) -> None:
    try:
        hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
        hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).delete(hadoop, True)
    except Exception:  # the session is gone; nothing is left to clean with
        pass


def stash(df: DataFrame) -> DataFrame:
    """Write df once as Parquet in the shared checkpoint folder and read it back.

    This cuts lineage and survives the loss of any executor. The files go with `release` or when the driver ends.
    """
    spark = df.sparkSession
    path = f"{checkpoint_dir(spark)}/stash-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.schema(df.schema).parquet(path)
    out.stashed_at = path
    return out


def release(df: DataFrame) -> None:
    """Delete the files of a stash that nothing reads any more."""
    _remove(df.sparkSession, df.stashed_at)


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spread(spark.read.parquet(f"{sf_dir}/{name}.parquet"))


def text_or_empty(col: str = "text"):
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def string_slices(batch_column, max_bytes: int = 1 << 21) -> Iterator[tuple[int, int]]:
    """Row ranges of a string column that hold about max_bytes each; a longer text is a range of its own."""
    import numpy as np

    offsets = utf8_parts(batch_column)[1]
    n, i = len(offsets) - 1, 0
    while i < n:
        j = int(np.searchsorted(offsets, offsets[i] + max_bytes, side="right")) - 1
        j = min(n, max(j, i + 1))
        yield i, j
        i = j


def utf8_parts(column):
    """(bytes, offsets) of an Arrow string column without nulls; offsets start at 0."""
    import numpy as np

    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
        if isinstance(column, pa.ChunkedArray):
            column = pa.concat_arrays(column.chunks) if column.num_chunks else pa.array([], pa.large_string())
    column = column.cast(pa.large_string())
    if column.null_count:
        column = column.fill_null("")
    _, off, data = column.buffers()
    if off is None or len(column) == 0:
        return np.zeros(0, np.uint8), np.zeros(len(column) + 1, np.int64)
    offsets = np.frombuffer(off, np.int64)[column.offset : column.offset + len(column) + 1]
    base, end = int(offsets[0]), int(offsets[-1])
    raw = np.frombuffer(data, np.uint8)[base:end] if data is not None and end > base else np.zeros(0, np.uint8)
    return raw, offsets - base
