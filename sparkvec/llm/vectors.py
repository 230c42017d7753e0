"""Shared by the two vector searches: which vectors take part, and their exchange with numpy."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def usable(df: DataFrame, key: str, vector: str, zero: bool) -> DataFrame:
    """key, vector (array<double>) and dim of rows with an id and a vector of finite components; `zero` keeps zero vectors."""
    v = F.col(vector).cast("array<double>")
    src = df.select(F.col(key).cast("long").alias("key"), v.alias("v")).where(F.col("key").isNotNull() & F.col("v").isNotNull() & (F.size("v") > 0))
    fine = F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    src = src.where(F.coalesce(fine, F.lit(False)))
    if not zero:
        src = src.where(F.exists("v", lambda x: x != 0))
    return src.withColumn("dim", F.size("v"))


def matrix(column: pa.ChunkedArray | pa.Array, dim: int) -> np.ndarray:
    """A list column of equal lengths as rows of doubles."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    return np.asarray(column.flatten(), np.float64).reshape(-1, dim)


def merged(found: DataFrame, k: int) -> DataFrame:
    """The k best of every query's partial results, ties to the smaller id."""
    order = W.partitionBy("query_id").orderBy(F.col("score").desc(), "vec_id")
    out = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return out.select("query_id", "rank", "vec_id", "score")
