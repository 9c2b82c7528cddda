"""Baselines and drift: how a table's profile, values and findings differ from those of an earlier one."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from lodestone.operators.profile import counts_frame, frequencies


def profile_drift(before: DataFrame, after: DataFrame) -> DataFrame:
    """One row for each column of either table: counts then and now, and the change of its null and distinct shares."""
    names = ["row_count", "null_percentage", "distinct_count", "uniqueness_percentage"]
    side = lambda df, s: counts_frame(df).select("column_name", *(F.col(n).alias(f"{n}_{s}") for n in names))
    both = side(before, "before").join(side(after, "after"), "column_name", "full_outer")
    status = F.when(F.col("row_count_before").isNull(), "added").when(F.col("row_count_after").isNull(), "removed").otherwise("kept")
    return both.withColumns({"status": status, "null_change": F.col("null_percentage_after") - F.col("null_percentage_before"), "row_ratio": F.when(F.col("row_count_before") > 0, F.col("row_count_after") / F.col("row_count_before"))})


def distribution_shift(before: DataFrame, after: DataFrame, column: str) -> DataFrame:
    """(column_name, total_variation, psi, new_values, lost_values) of a column's value shares; the PSI smooths empty cells by half a count."""
    a, b = (frequencies(df, column).withColumnRenamed("n", n) for df, n in ((before, "na"), (after, "nb")))
    both = a.join(b, "value", "full_outer").select(F.coalesce("na", F.lit(0)).alias("na"), F.coalesce("nb", F.lit(0)).alias("nb"))
    sums = both.agg(F.sum("na").alias("ta"), F.sum("nb").alias("tb"), F.count("*").alias("k"))
    x = both.crossJoin(F.broadcast(sums))  # sums is one row
    p, q = (F.col("na") + 0.5) / (F.col("ta") + 0.5 * F.col("k")), (F.col("nb") + 0.5) / (F.col("tb") + 0.5 * F.col("k"))
    return x.agg(
        F.lit(column).alias("column_name"), F.round(F.sum(F.abs(F.col("na") / F.greatest("ta", F.lit(1)) - F.col("nb") / F.greatest("tb", F.lit(1)))) / 2, 9).alias("total_variation"),
        F.round(F.sum((q - p) * F.log(q / p)), 9).alias("psi"), F.count_if(F.col("na") == 0).alias("new_values"), F.count_if(F.col("nb") == 0).alias("lost_values"),
    )


def finding_changes(before: DataFrame, after: DataFrame) -> DataFrame:
    """(column, entity, change) of findings_frame tables: new personal data, and what is gone."""
    a, b = (df.select("column", "entity", F.lit(True).alias(n)) for df, n in ((before, "a"), (after, "b")))
    both = a.join(b, ["column", "entity"], "full_outer")
    return both.select("column", "entity", F.when(F.col("a").isNull(), "new").when(F.col("b").isNull(), "gone").otherwise("kept").alias("change"))
