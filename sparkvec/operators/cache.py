"""Which nodes to keep close by: access frequencies, hit rates, and the smallest cache for a target."""

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def frequencies(log: DataFrame, node: str = "id") -> DataFrame:
    """id and freq of an access log."""
    return log.where(F.col(node).isNotNull()).groupBy(F.col(node).alias("id")).agg(F.count("*").alias("freq"))


def hot_nodes(freq: DataFrame, k: int) -> DataFrame:
    """id, freq and rk of the k most used nodes, ties by id."""
    top = freq.orderBy(F.desc("freq"), "id").limit(k)
    return top.select("id", "freq", F.row_number().over(W.orderBy(F.desc("freq"), "id")).cast("long").alias("rk"))


def levels(freq: DataFrame) -> DataFrame:
    """Per frequency: how many nodes have it, and how many nodes and accesses come before, from the most used."""
    steps = freq.groupBy("freq").agg(F.count("*").alias("n"))
    before = W.orderBy(F.desc("freq")).rowsBetween(W.unboundedPreceding, -1)  # one row per frequency that occurs
    zero = F.lit(0).cast("long")
    return steps.select("freq", "n", F.coalesce(F.sum("n").over(before), zero).alias("nodes"), F.coalesce(F.sum(F.col("n") * F.col("freq")).over(before), zero).alias("accesses"))


def hit_rate(freq: DataFrame, sizes: list[int]) -> DataFrame:
    """k and the share of accesses that the k most used nodes serve."""
    total = freq.agg(F.sum("freq")).first()[0] or 0
    ask = freq.sparkSession.createDataFrame([(k,) for k in sizes], "k long")
    took = F.greatest(F.lit(0), F.least(F.col("k") - F.col("nodes"), F.col("n"))) * F.col("freq")
    got = levels(freq).join(F.broadcast(ask), F.col("nodes") < F.col("k")).groupBy("k").agg(F.sum(took).alias("hits"))
    return got.select("k", (F.col("hits").cast("double") / float(max(total, 1))).alias("rate"))


def size_for(freq: DataFrame, targets: list[float]) -> DataFrame:
    """target and k: the fewest of the most used nodes that serve that share of accesses; all if it can't be reached."""
    total, nodes = freq.agg(F.sum("freq"), F.count("*")).first()
    ask = freq.sparkSession.createDataFrame([(t, t * float(total or 0)) for t in targets], "target double, need double")
    steps = levels(freq).join(F.broadcast(ask), (F.col("accesses") < F.col("need")) & (F.col("accesses") + F.col("n") * F.col("freq") >= F.col("need")))
    found = steps.select("target", (F.col("nodes") + F.ceil((F.col("need") - F.col("accesses")) / F.col("freq"))).alias("k"))
    return ask.join(found, "target", "left").select("target", F.when(F.col("need") <= 0, F.least(F.lit(1), F.lit(nodes))).otherwise(F.coalesce("k", F.lit(nodes))).cast("long").alias("k"))
