"""Positions in a global order without bringing all rows into one task."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.session import bounded, written

#: Rows that a bucket of the order is meant to have.
BUCKET_ROWS = 200_000


def positions(df: DataFrame, first: str, *ties: str, name: str = "at") -> DataFrame:
    """df with each row's place, from 0, by the column `first` (nulls before all) and then `ties`.

    Rows are dealt to ranges of (first, ties), so a frequent value is in many ranges if the ties tell its rows apart; a place is
    the count of earlier ranges plus the place within the own one. The ranges are written, as they come from a sample.
    """
    buckets = max(1, -(-df.count() // BUCKET_ROWS))
    held = written(df.repartitionByRange(buckets, first, *ties).withColumn("sv_bucket", F.spark_partition_id()))
    counts = held.groupBy("sv_bucket").agg(F.count("*").alias("sv_n"))
    ahead = W.orderBy("sv_bucket").rowsBetween(W.unboundedPreceding, -1)  # one row per bucket
    starts = counts.select("sv_bucket", F.coalesce(F.sum("sv_n").over(ahead), F.lit(0)).alias("sv_start"))
    place = F.row_number().over(W.partitionBy("sv_bucket").orderBy(first, *ties))
    out = held.withColumn("sv_place", place).join(bounded(starts, 32), "sv_bucket")
    return out.withColumn(name, (F.col("sv_start") + F.col("sv_place") - 1).cast("long")).drop("sv_bucket", "sv_place", "sv_start")
