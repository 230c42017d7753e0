"""Recall against a truth table, latency percentiles, throughput."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.operators.ordering import positions

#: Strategies or settings that one report compares.
MOST_NAMES = 1000


def _hits(results: DataFrame, truth: DataFrame, by: list[str]) -> DataFrame:
    pairs = results.select(*by, "qid", "id").distinct().join(truth.select("qid", "id").distinct(), ["qid", "id"])
    return pairs.groupBy(*by).agg(F.count("*").alias("hits"))


def recall(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean over all queries of the share of the k true neighbours that were found; missing results count against it."""
    by = list(by)
    n = queries.select("qid").distinct().count()
    found = _hits(results.where(F.col("rk") <= k), truth.where(F.col("rk") <= k), by)
    base = results.select(*by).distinct() if by else None
    found = base.join(found, by, "left") if by else found
    return found.select(*by, (F.coalesce("hits", F.lit(0)).cast("double") / float(max(n * k, 1))).alias("recall"))


def recall_valid(results: DataFrame, truth: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Each query with any truth is weighed by the size of its true set; queries without truth don't count."""
    by = list(by)
    valid = truth.where(F.col("rk") <= k).select("qid", "id").distinct()
    sizes = valid.groupBy("qid").agg(F.count("*").alias("size"))
    hits = results.where(F.col("rk") <= k).select(*by, "qid", "id").distinct().join(valid, ["qid", "id"]).groupBy(*by, "qid").agg(F.count("*").alias("hits"))
    names = [r.asDict() for r in results.select(*by).distinct().limit(MOST_NAMES + 1).collect()] if by else []
    if len(names) > MOST_NAMES:
        raise ValueError(f"more than {MOST_NAMES} combinations of {by}")
    grid = sizes.withColumn("name", F.explode(F.array(*(F.struct(*(F.lit(n[c]).alias(c) for c in by)) for n in names)))).select("qid", "size", "name.*") if names else sizes
    each = grid.join(hits, [*by, "qid"], "left").withColumn("share", F.coalesce("hits", F.lit(0)).cast("double") / F.col("size"))
    return each.groupBy(*by).agg(F.round(F.avg("share"), 12).alias("recall"))


def recall_tie_aware(results: DataFrame, truth: DataFrame, queries: DataFrame, k: int, by: tuple[str, ...] = ()) -> DataFrame:
    """In per cent, with every true row as near as the k-th counted as right."""
    last = truth.where(F.col("rk") == k).select("qid", F.col("dist").alias("far"))
    wide = truth.join(last, "qid", "left").where(F.col("far").isNull() | (F.col("dist") <= F.col("far")))
    by = list(by)
    n = queries.select("qid").distinct().count()
    found = _hits(results.where(F.col("rk") <= k), wide, by)
    base = results.select(*by).distinct() if by else None
    found = base.join(found, by, "left") if by else found
    return found.select(*by, (F.coalesce("hits", F.lit(0)).cast("double") / float(max(n, 1)) * (100.0 / k)).alias("recall"))


def percentiles(df: DataFrame, value: str, at: list[float]) -> DataFrame:
    """p and value: the element at index floor(p n) of the sorted values (the last one for p = 1), without interpolation."""
    some = df.where(F.col(value).isNotNull()).select(value, F.rand(7).alias("tie"))  # equal values may stand in any order
    n = some.count()
    wanted = [(p, min(int(p * n), n - 1)) for p in at] if n else []
    ask = df.sparkSession.createDataFrame(wanted, "p double, at long")
    return positions(some, value, "tie").join(F.broadcast(ask), "at").select("p", F.col(value).alias("value"))


def throughput(n_queries: int, seconds: float) -> float:
    return n_queries / seconds if seconds > 0 else float("inf")
