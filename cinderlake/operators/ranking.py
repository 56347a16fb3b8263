"""Place numbers over a whole table without a window that takes it into one task."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cinderlake.storage import Stored


def numbered(df: DataFrame, order: list[Column], place: str = "place") -> DataFrame:
    """``df`` with its place from 1 on in ``order``, which must leave no ties.

    Rows are dealt out by ranges of the order and stored with their range, so that each range is numbered by itself and
    starts behind the rows of those before; the offsets are one row for each range.
    """
    ranges = Stored(df.repartitionByRange(*order).withColumn("range_no", F.spark_partition_id()), "ranges").df
    before = Window.partitionBy(F.lit(0)).orderBy("range_no").rowsBetween(Window.unboundedPreceding, -1)
    offsets = ranges.groupBy("range_no").agg(F.count("*").alias("n")).select("range_no", F.coalesce(F.sum("n").over(before), F.lit(0)).alias("skipped"))
    inside = F.row_number().over(Window.partitionBy("range_no").orderBy(*order))
    out = ranges.join(F.broadcast(offsets), "range_no").withColumn(place, (F.col("skipped") + inside).cast("long"))
    return out.drop("range_no", "skipped")
