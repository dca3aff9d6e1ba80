"""Positions in a total order, without sorting everything in one task."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from ..shared import stored


def ranked(df: DataFrame, keys: list[str], rank: str = "rank") -> DataFrame:
    """``df`` with the position of each row (from 1) in the order of ``keys``; rows of equal keys follow each other in any order.

    Rows are dealt to partitions by ranges of keys, sorted there and stored; a row's position is that
    in its partition, after the sizes of those before (a number for each partition, which is broadcast).
    """
    rows = stored(df.repartitionByRange(*keys).sortWithinPartitions(*keys).withColumn("__at", F.monotonically_increasing_id()), "ranked")
    rows = rows.withColumn("__part", F.shiftright("__at", 33))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = rows.groupBy("__part").agg(F.count("*").alias("__n")).select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    place = F.col("__start") + F.col("__at").bitwiseAND((1 << 33) - 1) + 1
    return rows.join(F.broadcast(starts), "__part").withColumn(rank, place).select(*df.columns, rank)


def numbered_pages(df: DataFrame, keys: list[str], limit: int) -> DataFrame:
    """``df`` with ``page`` (from 0): ``limit`` rows each in the order of ``keys``, all pages at once."""
    return ranked(df, keys, "__rank").withColumn("page", F.floor((F.col("__rank") - 1) / limit)).drop("__rank")
