"""Ordered operators over keys: islands, transitions and first occurrences."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def islands(rows: DataFrame, key: str, order: str, gap: Column) -> DataFrame:
    """rows with island: a new one begins where gap(previous) holds; ``gap`` is over columns ``order`` and ``prev``."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("prev", F.lag(order).over(w))
    return rows.withColumn("island", F.sum(F.coalesce(gap.cast("int"), F.lit(0))).over(w.rowsBetween(Window.unboundedPreceding, 0)))


def transitions(rows: DataFrame, key: str, order: str, state: Column) -> DataFrame:
    """Rows at which the state begins to hold; unknown before the first row."""
    w = Window.partitionBy(key).orderBy(order)
    rows = rows.withColumn("_now", state).withColumn("_was", F.lag("_now").over(w))
    return rows.where(F.col("_now") & ~F.coalesce("_was", F.lit(False))).drop("_now", "_was")


def first_of(rows: DataFrame, keys: list[str], order: str, *kept: str) -> DataFrame:
    """The first row of each key by an aggregate that combines before shuffling, not by a window."""
    return rows.groupBy(*keys).agg(F.min_by(F.struct(*kept), order).alias("_x")).select(*keys, "_x.*")


def numbered_names(rows: DataFrame, name: str, *order: Column) -> DataFrame:
    """Names that repeat get #2, #3 and so on."""
    n = F.row_number().over(Window.partitionBy(name).orderBy(*order))
    return rows.withColumn("_n", n).withColumn(name, F.when(F.col("_n") > 1, F.concat(name, F.lit("#"), F.col("_n").cast("string"))).otherwise(F.col(name))).drop("_n")
