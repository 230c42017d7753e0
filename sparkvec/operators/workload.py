"""Labels and truth tables for search workloads. All are functions of ids, values and seeds, so they can be made again."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.operators.ordering import positions
from sparkvec.operators.quantization import closest_centers
from sparkvec.session import bounded

#: Multiplier of the integer hash that labels are drawn by.
STEP = 2654435761


def draw(id: Column, salt: int = 0, of: int = 1000) -> Column:
    """A whole number below `of` for an id."""
    return F.pmod((F.pmod(id, F.lit(1 << 20)) + salt) * F.lit(STEP), F.lit(of))


def uniform_labels(df: DataFrame, classes: int = 10) -> DataFrame:
    return df.select("id", F.pmod(draw(F.col("id"), 7), F.lit(classes)).alias("label"))


def correlated_labels(df: DataFrame, centers: DataFrame, alpha: float, classes: int = 10) -> DataFrame:
    """id and label: the nearest centre's number with probability alpha, else a uniform class."""
    near = closest_centers(df, centers, 1).select("id", "center")
    own = draw(F.col("id")) < int(alpha * 1000)
    return near.select("id", F.when(own, F.col("center")).otherwise(F.pmod(draw(F.col("id"), 7), F.lit(classes))).cast("long").alias("label"))


def zipf_labels(df: DataFrame, classes: int = 10, s: float = 1.0) -> DataFrame:
    """id and label, class c with weight 1 / (c + 1)^s."""
    weights = [1 / (c + 1) ** s for c in range(classes)]
    steps = [int(1000 * sum(weights[: c + 1]) / sum(weights)) for c in range(classes - 1)]
    label = sum(((draw(F.col("id"), 3) >= F.lit(t)).cast("long") for t in steps), F.lit(0).cast("long"))
    return df.select("id", label.alias("label"))


def equal_bins(df: DataFrame, value: str, bins: int) -> DataFrame:
    """id and bin (from 0): as many rows in each bin as can be, by value and then id."""
    n = df.count()
    return positions(df.select("id", value), value, "id").select("id", F.floor(F.col("at") * bins / F.lit(max(n, 1))).alias("bin"))


def bin_statistics(df: DataFrame, value: str, bins: int) -> DataFrame:
    """bin, n, least and most: how many rows each bin has and between which values."""
    b = equal_bins(df, value, bins).join(df.select("id", value), "id")
    return b.groupBy("bin").agg(F.count("*").alias("n"), F.min(value).alias("least"), F.max(value).alias("most"))


def truth_from_unfiltered(truth: DataFrame, labels: DataFrame, query_labels: DataFrame, k: int) -> DataFrame:
    """qid, id, rk: of an unfiltered truth the first k with the query's label; fewer where the truth is too short."""
    same = truth.join(labels.select("id", "label"), "id").join(query_labels.select("qid", "qlabel"), "qid").where("label = qlabel")
    rk = F.row_number().over(W.partitionBy("qid").orderBy("dist", "id")).cast("long")
    return same.withColumn("rk", rk).where(F.col("rk") <= k).select("qid", "id", "rk")


def truth_in_window(truth: DataFrame, windows: DataFrame, k: int) -> DataFrame:
    """step, qid, id, rk: per window(step, first, last) of ids the first k of each query; a step with a short query is left out."""
    inside = truth.join(bounded(windows, 64), (F.col("id") >= F.col("first")) & (F.col("id") < F.col("last")))
    rk = F.row_number().over(W.partitionBy("step", "qid").orderBy("dist", "id")).cast("long")
    kept = inside.withColumn("rk", rk).where(F.col("rk") <= k).select("step", "qid", "id", "rk")
    n = truth.select("qid").distinct().count()
    full = kept.where(F.col("rk") == k).groupBy("step").agg(F.count("*").alias("n")).where(F.col("n") == n).select("step")
    return kept.join(full, "step")
