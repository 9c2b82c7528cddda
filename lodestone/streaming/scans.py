"""Scans of streams: findings per window of event time, with bounded state, and profiles of micro-batches."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from lodestone.functions.validators import keep_valid
from lodestone.operators.pii import Recognizer, candidates
from lodestone.operators.profile import profile
from lodestone.sources.formats import quoted


def windowed_findings(stream: DataFrame, column: str, time: str, recognizers: list[Recognizer], window: str = "5 minutes", late: str = "10 minutes") -> DataFrame:
    """(window, entity, rows, rows_with_valid) of a stream; state is one row for each open window and recogniser."""
    text = F.col(quoted(column)).cast("string")
    hits = F.array(*(F.struct(F.lit(r.entity).alias("entity"), (F.size(keep_valid(candidates(text, r), list(r.validators))) > 0).alias("hit")) for r in recognizers))
    flat = stream.withWatermark(time, late).where(text.isNotNull()).select(F.col(time), F.explode(hits).alias("x"))
    return flat.groupBy(F.window(time, window), F.col("x.entity")).agg(F.count("*").alias("rows"), F.count_if("x.hit").alias("rows_with_valid"))


def profile_batches(stream: DataFrame, sink: Callable[[int, list[dict]], None], columns: list[str] | None = None, checkpoint: str | None = None) -> StreamingQuery:
    """Start a query that profiles each micro-batch and hands the profile to sink; a batch that is replayed has the same number."""
    writer = stream.writeStream.foreachBatch(lambda df, k: sink(k, profile(df, columns)))
    return (writer.option("checkpointLocation", checkpoint) if checkpoint else writer).start()
