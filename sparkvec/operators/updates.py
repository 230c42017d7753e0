"""Changes to an index: upserts, lazy deletes, repair of a graph after deletes, renumbering, and versions.

Files are immutable: a change makes a new version, and readers keep to the version that they opened.
"""

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators.graph import placed, robust_prune
from sparkvec.operators.knn import knn
from sparkvec.operators.ordering import positions


def change_order(changes: DataFrame) -> F.Column:
    """What decides between changes of one tag, the same in any order of rows."""
    return F.struct("seq", F.coalesce(F.col("op") == "delete", F.lit(False)), F.xxhash64(*changes.columns))


def latest(changes: DataFrame) -> DataFrame:
    """Of changes(tag, seq, op, ...) each tag's one with the largest seq; among equals a delete, then the one with the greatest hash."""
    rest = [c for c in changes.columns if c != "tag"]
    last = changes.where("tag is not null").groupBy("tag").agg(F.max_by(F.struct(*rest), change_order(changes)).alias("last"))
    return last.select("tag", *(F.col(f"last.{c}").alias(c) for c in rest))


def upserted(changes: DataFrame) -> DataFrame:
    """The tags that are there after all changes: the latest is not a delete. A tag deleted and inserted again is there."""
    return latest(changes).where("op <> 'delete'")


def applied(base: DataFrame, changes: DataFrame) -> DataFrame:
    """base(tag, seq, ...) with changes(tag, seq, op, ...) applied; older changes than the base's row have no effect."""
    rest = [c for c in base.columns]
    both = base.withColumn("op", F.lit("insert")).unionByName(changes.select(*rest, "op"))
    return upserted(both).select(*rest)


def live(nodes: DataFrame, tombstones: DataFrame, key: str = "id") -> DataFrame:
    return nodes.join(tombstones.select(key), key, "left_anti")


def knn_with_deletes(base: DataFrame, queries: DataFrame, k: int, tombstones: DataFrame, metric: str = "l2") -> DataFrame:
    """Deleted rows go before ranking, so k live ones are found without over-fetching."""
    return knn(live(base, tombstones), queries, k, metric)


def delete_repair(edges: DataFrame, deleted: DataFrame) -> DataFrame:
    """(src, dst) of live nodes after deletes: a deleted neighbour is replaced by its own live neighbours."""
    gone = deleted.select(F.col("id").alias("gone"))
    from_live = edges.select("src", "dst").join(gone, F.col("src") == F.col("gone"), "left_anti")
    direct = from_live.join(gone, F.col("dst") == F.col("gone"), "left_anti")
    via = from_live.join(gone, F.col("dst") == F.col("gone")).select(F.col("src").alias("a"), F.col("gone").alias("via"))
    ahead = via.join(edges.select("src", "dst"), F.col("via") == F.col("src")).select(F.col("a").alias("src"), "dst")
    ahead = ahead.join(gone, F.col("dst") == F.col("gone"), "left_anti").where("src <> dst")
    return direct.unionByName(ahead).distinct()


def consolidated(edges: DataFrame, base: DataFrame, deleted: DataFrame, degree: int, metric: str = "l2", alpha: float = 1.2) -> DataFrame:
    """Repaired edges with distances; nodes above the degree are pruned."""
    from sparkvec.functions.vector import distance

    a, b = base.select(F.col("id").alias("src"), F.col("vec").alias("va")), base.select(F.col("id").alias("dst"), F.col("vec").alias("vb"))
    rows = delete_repair(edges, deleted).join(a, "src").join(b, "dst").select("src", "dst", distance(metric, F.col("va"), F.col("vb")).alias("dist"))
    over = rows.groupBy("src").agg(F.count("*").alias("n")).where(F.col("n") > degree).select("src")
    return placed(rows.join(over, "src", "left_anti")).unionByName(robust_prune(rows.join(over, "src", "left_semi"), base, degree, alpha, metric))


def compaction(ids: DataFrame) -> DataFrame:
    """old_id and new_id: the survivors numbered from 0 in order."""
    return positions(ids.select(F.col("id").alias("old_id")), "old_id", name="new_id").select("old_id", "new_id")


def renamed(edges: DataFrame, names: DataFrame) -> DataFrame:
    a, b = (names.select(F.col("old_id").alias(c), F.col("new_id").alias(f"new_{c}")) for c in ("src", "dst"))
    out = edges.join(a, "src").join(b, "dst")
    rest = [c for c in edges.columns if c not in ("src", "dst")]
    return out.select(F.col("new_src").alias("src"), F.col("new_dst").alias("dst"), *rest)


def tag_lookup(ids: DataFrame, tags: DataFrame) -> DataFrame:
    """id and tag; the id itself where there is no tag."""
    return ids.select("id").join(tags, "id", "left").select("id", F.coalesce("tag", "id").alias("tag"))


def version(spark: SparkSession, root: str) -> int:
    """The latest committed version, 0 if there is none."""
    try:
        return spark.read.schema("version long").parquet(f"{root}/commits").agg(F.max("version")).first()[0] or 0
    except AnalysisException:
        return 0


def read_version(spark: SparkSession, root: str, at: int | None = None) -> DataFrame:
    return spark.read.parquet(f"{root}/data-{at or version(spark, root)}")


def commit(df: DataFrame, root: str) -> int:
    """Write df as the next version; it counts only once its commit row is there."""
    spark = df.sparkSession
    at = version(spark, root) + 1
    df.write.mode("overwrite").parquet(f"{root}/data-{at}")
    spark.createDataFrame([(at,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/commits")
    return at
