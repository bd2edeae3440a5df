"""Places of all rows in one order, without a task that holds them all."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from ..sources.shared import shared_folder


def placed(rows: DataFrame, *order: Column, ties: bool = False) -> DataFrame:
    """``rows`` and ``place`` (from 1); with ``ties``, rows that the order does not tell apart share the first one's.

    Rows are dealt by ranges of the order, so that equal ones are together; a row's
    place is that within its range after the counts of the ranges before, of
    which there are as many as partitions. The ranges are written, as they are drawn anew by each run.
    """
    shared_folder(rows.sparkSession)
    dealt = rows.repartitionByRange(*order).withColumn("_range", F.spark_partition_id()).checkpoint()
    counts = dealt.groupBy("_range").agg(F.count("*").alias("_n"))
    before = counts.select("_range", (F.sum("_n").over(W.orderBy("_range")) - F.col("_n")).alias("_before"))
    within = (F.rank() if ties else F.row_number()).over(W.partitionBy("_range").orderBy(*order))
    return dealt.withColumn("_at", within).join(F.broadcast(before), "_range").withColumn("place", F.col("_before") + F.col("_at")).drop("_range", "_at", "_before")
