"""A mutable table fed by a stream of changes: each micro-batch makes a new version of the buckets of tags that it touches.

A version is a list of buckets and the folders that hold them. It counts once its commit row is there; what a failed batch has
written is not listed or is listed again with the same content.
"""

from collections.abc import Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery

from sparkvec.operators.updates import change_order, latest, version
from sparkvec.session import written


def once(changes: DataFrame, delay: str = "10 minutes") -> DataFrame:
    """Changes without those that arrive again within the delay of their event time ts."""
    return changes.withWatermark("ts", delay).dropDuplicatesWithinWatermark(["tag", "seq"])


def latest_per_tag(changes: DataFrame) -> DataFrame:
    """A running table of each tag's latest change: state is one row per tag."""
    rest = [c for c in changes.columns if c != "tag"]
    last = changes.groupBy("tag").agg(F.max_by(F.struct(*rest), change_order(changes)).alias("last"))
    return last.select("tag", *(F.col(f"last.{c}").alias(c) for c in rest))


#: Buckets of tags: a batch rewrites those that it touches.
BUCKETS = 64


def manifest(spark: SparkSession, root: str) -> dict[int, int]:
    """Bucket -> the version that wrote it last, as of the latest version."""
    at = version(spark, root)
    if not at:
        return {}
    rows = spark.read.schema("version long, bucket int, written long").parquet(f"{root}/manifests").where(F.col("version") == at)
    return {r.bucket: r.written for r in rows.collect()}  # one row per bucket


def records(spark: SparkSession, root: str, schema: T.StructType, buckets: Iterable[int] | None = None) -> DataFrame:
    """The latest change of each tag, deletes too, from all or the named buckets."""
    known = manifest(spark, root)
    paths = [f"{root}/data-{v}/bucket={b}" for b, v in known.items() if buckets is None or b in buckets]
    return spark.read.schema(schema).parquet(*paths) if paths else spark.createDataFrame([], schema)


def current(spark: SparkSession, root: str, columns: DataFrame | T.StructType) -> DataFrame:
    """The rows that are there now. columns: the schema that the table was fed with."""
    schema = columns if isinstance(columns, T.StructType) else columns.schema
    names = [f.name for f in schema if f.name != "op"]
    op = [] if "op" in schema.names else [T.StructField("op", T.StringType())]
    return records(spark, root, T.StructType([*schema.fields, *op])).where("op <> 'delete'").select(*names)


def apply_to(root: str, columns: list[str], settled: int | None = None):
    """A foreachBatch function that merges a batch of changes(tag, seq, op, ...) into the latest version.

    A deleted tag leaves its delete in the table, so an older insert that comes later has no effect. Deletes with a seq below
    `settled` go when their bucket is written again: set it where no older change can come any more. A batch that runs again
    after a failure gives the same table, as seq decides.
    """

    def merge(batch: DataFrame, _: int) -> None:
        spark: SparkSession = batch.sparkSession
        new = latest(batch).select(*columns, "op").withColumn("bucket", F.pmod(F.xxhash64("tag"), F.lit(BUCKETS)).cast("int"))
        new = written(new)
        touched = {r[0] for r in new.select("bucket").distinct().collect()}
        old = records(spark, root, new.drop("bucket").schema, touched)
        both = latest(new.drop("bucket").unionByName(old)).select(*columns, "op")
        if settled is not None:
            both = both.where((F.col("op") != "delete") | (F.col("seq") >= settled))
        before, at = manifest(spark, root), version(spark, root) + 1
        both.withColumn("bucket", F.pmod(F.xxhash64("tag"), F.lit(BUCKETS)).cast("int")).repartition("bucket").write.mode("overwrite").partitionBy("bucket").parquet(f"{root}/data-{at}")
        full = {r[0] for r in spark.read.parquet(f"{root}/data-{at}").select("bucket").distinct().collect()} if not both.isEmpty() else set()
        rows = [(at, b, v) for b, v in before.items() if b not in touched] + [(at, b, at) for b in full]
        spark.createDataFrame(rows, "version long, bucket int, written long").coalesce(1).write.mode("append").parquet(f"{root}/manifests")
        spark.createDataFrame([(at,)], "version long").coalesce(1).write.mode("append").parquet(f"{root}/commits")

    return merge


def start(changes: DataFrame, root: str, checkpoint: str, columns: list[str], settled: int | None = None) -> StreamingQuery:
    """Merge all that is there now, batch by batch, and stop."""
    w = changes.writeStream.foreachBatch(apply_to(root, columns, settled)).option("checkpointLocation", checkpoint)
    return w.trigger(availableNow=True).start()
