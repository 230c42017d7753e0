"""Search strategies over a pool: the L nearest of all rows first, then the predicate.

`post` takes the pool by exact distance and filters it, so it returns fewer than k rows where fewer pool members match. `gated` takes
the pool from the codes of the rows that satisfy the predicate, and only then fetches their wide vectors for exact distances:
the explicit join on id is what keeps wide columns out of the pool's scan. It returns k rows if k match, whatever the selectivity.
"""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Predicate
from sparkvec.functions.vector import distance
from sparkvec.operators.knn import knn, ranked
from sparkvec.operators.quantization import Coder, adc
from sparkvec.session import bounded


def filtered_pool(pool: DataFrame, base: DataFrame, queries: DataFrame, where: Predicate) -> DataFrame:
    """The pool's pairs that satisfy the predicate; base gives narrow columns only."""
    rows = pool.select("qid", "id", "dist").join(base.select("id", *where.base_columns), "id")
    return rows.join(bounded(queries.select("qid", *where.query_columns), 1024), "qid").where(where.column()).select("qid", "id", "dist")


def post_filter_knn(base: DataFrame, queries: DataFrame, k: int, pool: int, where: Predicate, metric: str = "l2") -> DataFrame:
    """qid, id, dist, rk of the first k matches in the exact pool."""
    return ranked(filtered_pool(knn(base, queries, pool, metric), base, queries, where), k)


def rerank(pairs: DataFrame, base: DataFrame, queries: DataFrame, k: int, metric: str = "l2") -> DataFrame:
    """Exact distances for (qid, id) pairs, and the k nearest."""
    wide = pairs.select("qid", "id").join(base.select("id", "vec"), "id").join(bounded(queries.select("qid", "qvec"), 8192), "qid")
    return ranked(wide.select("qid", "id", distance(metric, F.col("qvec"), F.col("vec")).alias("dist")), k)


def gated_knn(base: DataFrame, codes: DataFrame, queries: DataFrame, book: Coder, k: int, pool: int, where: Predicate, metric: str = "l2") -> DataFrame:
    """qid, id, dist, rk: codes are (id, codes) with the predicate's columns; base is read for survivors only."""
    return rerank(adc(codes, queries, book, max(pool, k), metric, where), base, queries, k, metric)


def io_counts(pool: DataFrame, base: DataFrame, queries: DataFrame, where: Predicate) -> DataFrame:
    """Per query the wide rows that a post-filter fetches and those that the gate lets through."""
    hits = filtered_pool(pool, base, queries, where).groupBy("qid").agg(F.count("*").alias("n_fetch_gated"))
    every = pool.groupBy("qid").agg(F.count("*").alias("n_fetch_post")).join(hits, "qid", "left")
    return every.select("qid", "n_fetch_post", F.coalesce("n_fetch_gated", F.lit(0)).alias("n_fetch_gated"))
