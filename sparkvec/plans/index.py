"""VectorIndex: a table of vectors with attributes, its codes, codebook and sharded graph, searched by strategy."""

import math
from dataclasses import dataclass, replace
from functools import cached_property

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Predicate, predicate
from sparkvec.operators import codes, frontier, graph_index, knn, partition, pools, quantization, updates
from sparkvec.operators.quantization import Codebook, Coder
from sparkvec.session import bounded, shared_dir, written

ATTRIBUTES = ("label", "labels", "attr")
SETTINGS = "metric string, degree int, pool int, alpha double, copies int, candidates int, shard_rows int, chunks int, n_centers int, kind string, seed int"


def one_each(df: DataFrame) -> DataFrame:
    """One row for each id: of rows that share one, that with the greatest vector and attributes."""
    rest = [c for c in df.columns if c != "id"]
    best = df.where("id is not null and vec is not null").groupBy("id").agg(F.max(F.struct("vec", *(c for c in rest if c != "vec"))).alias("best"))
    return best.select("id", *(F.col(f"best.{c}").alias(c) for c in rest))


@dataclass(frozen=True)
class VectorIndex:
    """All parts are written tables. nodes: id, vec, attributes, codes; graph: shard, part, id, entry, nbrs; tree: the cells that are the
    shards, none with more than shard_rows rows; centers: their means."""

    nodes: DataFrame
    book: Coder
    centers: DataFrame
    graph: DataFrame
    metric: str
    degree: int
    pool: int
    alpha: float
    copies: int = 2
    candidates: int = graph_index.CANDIDATES
    tree: DataFrame | None = None
    shard_rows: int = 20_000
    chunks: int = 16
    n_centers: int = 256
    kind: str = "pq"
    seed: int = 42
    pages_at: str | None = None

    @staticmethod
    def build(df: DataFrame, id: str = "id", vec: str = "vec", label: str | None = None, labels: str | None = None, attr: str | None = None, metric: str = "l2", degree: int = 32, pool: int = 64, alpha: float = 1.2, chunks: int = 16, centers: int = 256, shard_rows: int = 20_000, copies: int = 2, seed: int = 42, candidates: int = graph_index.CANDIDATES, kind: str = "pq") -> "VectorIndex":
        """kind: of the codes, by their name in `codes`. candidates: how many of a node's candidates pruning looks at, nearest first. shard_rows: rows of a shard at most, here and after
        any insert. Of rows that share an id one is taken; rows without id or vector are left out. An empty table gives an index that finds nothing."""
        names = {id: "id", vec: "vec"} | {c: n for c, n in ((label, "label"), (labels, "labels"), (attr, "attr")) if c}
        rows = written(one_each(df.select(*(df[c].alias(n) for c, n in names.items()))))
        n, dim = rows.agg(F.count("*"), F.coalesce(F.max(F.size("vec")), F.lit(0))).first()
        book = codes.trained(kind, rows, dim, chunks, min(centers, max(1, n // 16)), seed) if n else Codebook([], [], np.zeros(0))
        rows = written(rows.where(F.size("vec") == dim))
        kept = [n for n in names.values() if n not in ("id", "vec")]
        coded = quantization.encode(rows, book, *kept, keep_vec=True) if n else rows.withColumn("codes", F.array().cast("array<int>"))
        nodes = written(coded.select("id", "vec", *kept, "codes"))
        cells, tree = partition.cells(rows, shard_rows, seed)
        cells = written(cells)
        shard_centers = written(partition.centroids(cells))
        assigned = written(graph_index.members(cells, shard_centers, copies, shard_rows))
        graph = written(graph_index.build_graph(rows, assigned, metric, degree, pool, alpha, candidates))
        return VectorIndex(nodes, book, shard_centers, graph, metric, degree, pool, alpha, copies, candidates, tree, shard_rows, chunks, centers, kind, seed)

    @cached_property
    def paged(self) -> frontier.Paged:
        """The tables that strategy `visit` reads; those of a saved index were written with it."""
        spark = self.nodes.sparkSession
        if self.pages_at:
            return frontier.opened(spark, self.pages_at)
        return self._pages(shared_dir(spark))

    def _pages(self, to: str) -> frontier.Paged:
        placed = partition.located(self.nodes.select("id", "vec"), self.tree)
        return frontier.pages(self.nodes, self.graph, written(placed.select("id", "cell")), to)

    def strategy(self, where: Predicate, pool: int) -> str:
        """exact, whatever the size: the others return fewer matches and are for callers who name them."""
        return "exact"

    def search(self, queries: DataFrame, k: int = 10, pool: int = 100, where: Predicate | str = "none", strategy: str | None = None, store: int = 32, probes: int | None = None, with_self: bool = False) -> DataFrame:
        """qid, id, dist, rk for queries(qid, qvec, and what the predicate reads). probes: the shards that `graph` visits for a query, twice
        the root of their number if not given, so that splitting a shard does not lose what was found in it."""
        where = predicate(where) if isinstance(where, str) else where
        strategy = strategy or self.strategy(where, pool)
        narrow = self.nodes.select("id", "codes", *where.base_columns)
        if strategy == "exact":
            return knn.knn(self.nodes, queries, k, self.metric, where, with_self)
        if strategy == "post":
            return pools.post_filter_knn(self.nodes, queries, k, pool, where, self.metric)
        if strategy == "gated":
            return pools.gated_knn(self.nodes, narrow, queries, self.book, k, pool, where, self.metric)
        if strategy == "graph":
            rows = self.graph.join(self.nodes, "id")
            probes = probes or 2 * math.ceil(math.sqrt(self.centers.count()))
            return graph_index.search(rows, queries, self.centers, k, pool, where, self.book, True, store, probes, self.metric, with_self)[0]
        if strategy == "visit":
            return frontier.search(self.paged, queries, self.book, k, pool, where, self.metric, store, with_self=with_self)[0]
        raise ValueError(f"unknown strategy {strategy!r}; known: exact, post, gated, graph, visit")

    def insert(self, df: DataFrame) -> "VectorIndex":
        """A new index whose rows of the same id are replaced. Codes use the codebook at hand; of the graph only the shards that
        hold replaced rows or get new ones are changed. Shards that would overflow are split, and their graphs built anew."""
        kept = [c for c in self.nodes.columns if c not in ("id", "vec", "codes")]
        if not self.book.dim:
            names = {c: c for c in kept}
            return VectorIndex.build(df, metric=self.metric, degree=self.degree, pool=self.pool, alpha=self.alpha, chunks=self.chunks, centers=self.n_centers, kind=self.kind, shard_rows=self.shard_rows, copies=self.copies, seed=self.seed, candidates=self.candidates, **names)
        new = written(quantization.encode(one_each(df.select("id", "vec", *kept)), self.book, *kept, keep_vec=True).select(*self.nodes.columns))
        gone = new.select("id")
        nodes = written(updates.live(self.nodes, gone).unionByName(new))
        own = partition.located(new.select("id", "vec"), self.tree).select("id", F.col("cell").alias("shard"))
        near = quantization.closest_centers(new, self.centers, self.copies).select("id", F.col("center").alias("shard"))
        of = written(own.unionByName(near).distinct().withColumn("part", F.lit(0)))
        left = updates.live(self.graph.select("id", "shard", "part"), gone).unionByName(of)
        over = written(left.groupBy("shard").agg(F.count("*").alias("n")).where(F.col("n") > self.shard_rows).select("shard"))
        if over.isEmpty():
            return self._changed(nodes, gone, of, new)
        full = bounded(over, 32)
        rows = left.join(full, "shard", "left_semi").join(nodes.select("id", "vec"), "id").select("id", "vec", F.col("shard").alias("cell"))
        cells, tree = partition.grown(written(rows), self.tree, self.shard_rows, self.seed)
        cells = written(cells)
        assigned = cells.select("id", F.col("cell").alias("shard"), F.lit(0).alias("part"))
        built = graph_index.build_graph(nodes, assigned, self.metric, self.degree, self.pool, self.alpha, self.candidates)
        rest = replace(self, graph=self.graph.join(full, "shard", "left_anti"))
        changed = rest._changed(nodes, gone, of.join(full, "shard", "left_anti"), new)
        centers = self.centers.join(over.withColumnRenamed("shard", "center"), "center", "left_anti").select("center", "cvec")
        centers = written(centers.unionByName(partition.centroids(cells)))
        return replace(changed, graph=written(changed.graph.unionByName(built)), centers=centers, tree=tree)

    def delete(self, ids: DataFrame) -> "VectorIndex":
        """A new index without these ids; their neighbours are linked to what they led to."""
        none = self.graph.select("id", "shard", "part").limit(0)
        return self._changed(written(updates.live(self.nodes, ids)), ids, none, None)

    def _changed(self, nodes: DataFrame, gone: DataFrame, new: DataFrame, fresh: DataFrame | None) -> "VectorIndex":
        # old nodes keep their old vectors until their neighbours are relinked
        rows = self.nodes.select("id", "vec", F.lit(False).alias("fresh"))
        rows = rows if fresh is None else rows.unionByName(fresh.select("id", "vec", F.lit(True).alias("fresh")))
        graph = written(graph_index.changed(self.graph, rows, gone, new, self.metric, self.degree, self.pool, self.alpha, self.candidates))
        return replace(self, nodes=nodes, graph=graph, pages_at=None)

    def save(self, to: str) -> None:
        """Write all parts to a new folder."""
        spark = self.nodes.sparkSession
        self.nodes.write.parquet(f"{to}/nodes")
        self.graph.write.parquet(f"{to}/graph")
        self.centers.coalesce(1).write.parquet(f"{to}/centers")
        self.tree.write.parquet(f"{to}/tree")
        self._pages(f"{to}/pages")
        codes.save(spark, self.book, f"{to}/codebook")
        row = tuple(getattr(self, n) for n in SETTINGS.replace(",", "").split()[::2])
        spark.createDataFrame([row], SETTINGS).coalesce(1).write.parquet(f"{to}/settings")

    @staticmethod
    def open(spark: SparkSession, at: str) -> "VectorIndex":
        read = spark.read.parquet
        parts = (read(f"{at}/nodes"), codes.opened(spark, f"{at}/codebook"), read(f"{at}/centers"), read(f"{at}/graph"))
        return VectorIndex(*parts, tree=read(f"{at}/tree"), pages_at=f"{at}/pages", **read(f"{at}/settings").first().asDict())
