"""Places over a whole table without a window over the whole table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources.shared import written


def with_place(df: DataFrame, order: list[Column], name: str = "place") -> DataFrame:
    """``df`` with each row's place, from 1, by ``order`` over all rows.

    The rows are dealt out by ranges of the order and written; a row's place is its place in its range after the rows of all
    ranges before. Only the sizes of the ranges, a row each, meet in one task. Equal values are dealt apart by what follows in
    the order, so it should end in a unique column.
    """
    ranges = written(df.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()), "ranges")
    inside = ranges.withColumn("_n", F.row_number().over(Window.partitionBy("_range").orderBy(*order)))
    before = Window.orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sizes = ranges.groupBy("_range").agg(F.count("*").alias("_size")).select("_range", F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"))
    return inside.join(sizes.hint("merge"), "_range").withColumn(name, (F.col("_before") + F.col("_n")).cast("int")).drop("_range", "_n", "_before")
