"""An index that changes while it is searched: a base, layers of changes on top of it, and merges that make a new base.

A folder holds bases, layers and a manifest. A change writes one layer (rows that are there from now on, tags that are gone) and a new
version of the manifest; a merge writes a new base and a version that names it without the layers it took in. A version counts once its commit row is there,
so readers keep to what they opened, and a change or merge that fails leaves the last version as it was.

Users name rows by tags. A base numbers its rows 0, 1, ... in order of tags; a merge numbers the survivors anew, and codes, attributes and
neighbour lists follow. Searches take queries and give results by tag.
"""

from dataclasses import dataclass, replace

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Predicate, predicate
from sparkvec.operators import knn, updates
from sparkvec.plans.index import VectorIndex, one_each
from sparkvec.session import bounded, written

MANIFEST = "version long, base long, layers array<long>"


def by_tag(index: VectorIndex, order: DataFrame) -> VectorIndex:
    """The index with the ids that order(id, new) gives."""
    nodes = index.nodes.join(order, "id").select(F.col("new").alias("id"), *(c for c in index.nodes.columns if c != "id"))
    edges = index.graph.select("shard", "part", "id", "entry", F.posexplode_outer("nbrs").alias("pos", "dst"))
    edges = edges.join(order, "id").join(order.select(F.col("id").alias("dst"), F.col("new").alias("to")), "dst", "left")
    pair = F.when(F.col("to").isNotNull(), F.struct("pos", "to"))
    lists = edges.groupBy("shard", "part", F.col("new").alias("id"), "entry").agg(F.array_sort(F.collect_list(pair)).alias("r"))
    return replace(index, nodes=written(nodes), graph=written(lists.select("shard", "part", "id", "entry", F.col("r.to").alias("nbrs"))), pages_at=None)


@dataclass(frozen=True)
class LayeredIndex:
    """One version. tags(id, tag) names the base's rows; added has tag and the base's columns but codes; gone has tags."""

    spark: SparkSession
    root: str
    version: int
    number: int
    layers: tuple[int, ...]

    @staticmethod
    def create(index: VectorIndex, root: str) -> "LayeredIndex":
        """Write an index as the first base; its ids become tags."""
        spark = index.nodes.sparkSession
        one = LayeredIndex(spark, root, 0, 0, ())
        return one._commit(one._base(index, index.nodes.select("id", F.col("id").alias("tag")), 1), ())

    @staticmethod
    def open(spark: SparkSession, root: str, at: int | None = None) -> "LayeredIndex":
        """The latest version, or an earlier one."""
        at = at or updates.version(spark, root)
        row = spark.read.schema(MANIFEST).parquet(f"{root}/manifests").where(F.col("version") == at).first()
        return LayeredIndex(spark, root, at, row.base, tuple(row.layers))

    def _base(self, index: VectorIndex, tags: DataFrame, number: int) -> int:
        """Write the index with its rows numbered in order of their tags(id, tag)."""
        order = written(updates.positions(tags, "tag", name="new"))
        by_tag(index, order.select("id", "new")).save(f"{self.root}/base-{number}")
        order.select(F.col("new").alias("id"), "tag").write.parquet(f"{self.root}/base-{number}/tags")
        return number

    def _commit(self, base: int, layers: tuple[int, ...]) -> "LayeredIndex":
        at = updates.version(self.spark, self.root) + 1
        if at != self.version + 1:
            raise ValueError(f"version {at - 1} has come after {self.version}: open it and change that")
        self.spark.createDataFrame([(at, base, list(layers))], MANIFEST).coalesce(1).write.mode("append").parquet(f"{self.root}/manifests")
        self.spark.createDataFrame([(at,)], "version long").coalesce(1).write.mode("append").parquet(f"{self.root}/commits")
        return LayeredIndex(self.spark, self.root, at, base, layers)

    @property
    def base(self) -> VectorIndex:
        return VectorIndex.open(self.spark, f"{self.root}/base-{self.number}")

    @property
    def tags(self) -> DataFrame:
        return self.spark.read.parquet(f"{self.root}/base-{self.number}/tags")

    def changes(self) -> tuple[DataFrame, DataFrame]:
        """(rows that the layers add, tags that they touch): of each tag its last layer counts."""
        kept = [c for c in self.base.nodes.columns if c not in ("id", "codes")]
        rows = self.base.nodes.select(F.col("id").alias("tag"), *kept).limit(0).withColumn("seq", F.lit(0)).withColumn("op", F.lit(""))
        for n in self.layers:
            rows = rows.unionByName(self.spark.read.parquet(f"{self.root}/layer-{n}").select("tag", *kept, F.lit(n).alias("seq"), "op"))
        last = updates.latest(rows)
        return last.where("op = 'insert'").select("tag", *kept), last.select("tag")

    def _layer(self, rows: DataFrame) -> "LayeredIndex":
        number = self.version + 1
        rows.write.mode("overwrite").parquet(f"{self.root}/layer-{number}")
        return self._commit(self.number, (*self.layers, number))

    def insert(self, df: DataFrame) -> "LayeredIndex":
        """A version with df's rows (tag, vec, attributes); rows of the same tag are replaced."""
        kept = [c for c in self.base.nodes.columns if c not in ("id", "codes")]
        rows = one_each(df.select(F.col("tag").alias("id"), *kept)).withColumnRenamed("id", "tag")
        return self._layer(rows.withColumn("op", F.lit("insert")))

    def delete(self, tags: DataFrame) -> "LayeredIndex":
        """A version without these tags."""
        fields = [f for f in self.base.nodes.schema.fields if f.name not in ("id", "codes")]
        none = [F.lit(None).cast(f.dataType).alias(f.name) for f in fields]
        return self._layer(tags.select("tag").distinct().select("tag", *none, F.lit("delete").alias("op")))

    def search(self, queries: DataFrame, k: int = 10, pool: int = 100, where: Predicate | str = "none", strategy: str = "exact", with_self: bool = False) -> DataFrame:
        """qid, tag, dist, rk: the base without what layers touch, by strategy, and the layers' rows exactly. qid is a tag for with_self."""
        where = predicate(where) if isinstance(where, str) else where
        base = self.base
        added, touched = self.changes()
        hidden = self.tags.join(touched, "tag", "left_semi").select("id")
        if strategy in ("exact", "gated", "post"):  # these scan nodes, so hidden ones can go first
            found = replace(base, nodes=updates.live(base.nodes, hidden)).search(queries, k + 1, pool, where, strategy, with_self=True)
        else:
            found = updates.live(base.search(queries, pool, pool, where, strategy, with_self=True), hidden)
        found = found.join(self.tags, "id").select("qid", F.col("tag").alias("id"), "dist")
        fresh = knn.knn(added.withColumnRenamed("tag", "id"), queries, k + 1, base.metric, where, True).select("qid", "id", "dist")
        both = found.unionByName(fresh)
        return knn.ranked(both if with_self else both.where("qid <> id"), k).withColumnRenamed("id", "tag")

    def merge(self) -> "LayeredIndex":
        """A version whose base has taken the layers in. Searches on this version go on meanwhile."""
        added, touched = self.changes()
        tags = self.tags
        hidden = written(tags.join(touched, "tag", "left_semi").select("id"))
        first = (tags.agg(F.max("id")).first()[0] or 0) + 1
        new = updates.positions(added.select("tag"), "tag", name="at").select("tag", (F.col("at") + first).alias("id"))
        new = written(new)
        rows = added.join(bounded(new, 32), "tag").drop("tag")
        merged = self.base.delete(hidden).insert(rows)
        every = updates.live(tags, hidden).select("id", "tag").unionByName(new.select("id", "tag"))
        number = self._base(merged, every, self.version + 1)
        return self._commit(number, ())
