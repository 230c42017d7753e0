"""Proximity graphs as tables: edges(src, pos, dst, dist), neighbours in order of distance, and what is done with them."""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.operators.knn import BLOCKS, knn, matrix
from sparkvec.session import bounded, written


def knn_graph(base: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """Each row's exact nearest others."""
    found = knn(base, base.select(F.col("id").alias("qid"), F.col("vec").alias("qvec")), degree, metric)
    return found.select(F.col("qid").alias("src"), (F.col("rk") - 1).alias("pos"), F.col("id").alias("dst"), "dist")


def neighbors_of(ids: DataFrame, base: DataFrame, degree: int, metric: str = "l2") -> DataFrame:
    """src, pos, dst, dist: the exact nearest others among all rows of base(id, vec), for the rows whose ids(id) are asked for."""
    asked = base.join(bounded(ids.select("id").distinct(), 16), "id", "left_semi")
    found = knn(base, written(asked.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))), degree, metric)
    return found.select(F.col("qid").alias("src"), (F.col("rk") - 1).alias("pos"), F.col("id").alias("dst"), "dist")


def adjacency(edges: DataFrame) -> DataFrame:
    """id and nbrs (array in order of pos)."""
    rows = F.array_sort(F.collect_list(F.struct("pos", "dst")))
    return edges.groupBy(F.col("src").alias("id")).agg(rows.alias("r")).select("id", F.col("r.dst").alias("nbrs"))


def placed(edges: DataFrame, degree: int | None = None) -> DataFrame:
    """Distinct edges with places by distance and id, cut at a degree."""
    one = edges.groupBy("src", "dst").agg(F.min("dist").alias("dist"))
    pos = F.row_number().over(W.partitionBy("src").orderBy("dist", "dst")).cast("long") - 1
    out = one.withColumn("pos", pos).select("src", "pos", "dst", "dist")
    return out if degree is None else out.where(F.col("pos") < degree)


def neighbor_store(edges: DataFrame, most: int) -> DataFrame:
    """The first neighbours of every node: the narrow tier that tunnelling reads."""
    return edges.where(F.col("pos") < most).select("src", "pos", "dst")


def reverse_edges(edges: DataFrame) -> DataFrame:
    """Distinct (src, dst) of all edges and their reverses."""
    both = edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst")))
    return both.distinct()


def degree_stats(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """max_degree, min_degree, avg_degree and n_low (nodes with under 2) in one row."""
    n = nodes.select(F.col("id").alias("src")).join(edges.groupBy("src").agg(F.count("*").alias("n")), "src", "left")
    n = n.select(F.coalesce("n", F.lit(0)).alias("n"))
    return n.agg(F.max("n").alias("max_degree"), F.min("n").alias("min_degree"), (F.sum("n").cast("double") / F.count("*")).alias("avg_degree"), F.count_if(F.col("n") < 2).alias("n_low"))


def bfs(edges: DataFrame, start: DataFrame, hops: int) -> DataFrame:
    """id and hop of all nodes within that many hops of start(id): one join a hop, from the last frontier only."""
    edges = edges.select("src", "dst").distinct()
    seen = frontier = written(start.select("id", F.lit(0).cast("long").alias("hop")).distinct())
    for hop in range(1, hops + 1):
        ahead = frontier.join(edges, F.col("id") == F.col("src")).select(F.col("dst").alias("id")).distinct()
        frontier = written(ahead.join(seen, "id", "left_anti").withColumn("hop", F.lit(hop).cast("long")))
        if frontier.isEmpty():
            break
        seen = seen.unionByName(frontier)
    return seen


#: Rows of a shard's part.
PART_ROWS = 2000


def shard_graphs(base: DataFrame, assigned: DataFrame, degree: int, part_rows: int = PART_ROWS) -> DataFrame:
    """Exact neighbours within each shard of assigned(id, shard); shards of more than part_rows are cut into parts by id."""

    def solve(t: pa.Table) -> pa.Table:
        ids, x = t["id"].to_numpy(), matrix(t["vec"])
        order = np.argsort(ids, kind="stable")
        ids, x = ids[order], x[order]
        src, pos, dst, dist = [], [], [], []
        for at in range(0, len(ids), 256):
            d = BLOCKS["l2"](x[at : at + 256], x)
            for r, line in enumerate(d):
                line[at + r] = np.inf
                best = np.argsort(line, kind="stable")[: min(degree, len(ids) - 1)]
                src += [ids[at + r]] * len(best)
                pos += range(len(best))
                dst += ids[best].tolist()
                dist += line[best].tolist()
        return pa.table([pa.array(src, pa.int64()), pa.array(pos, pa.int64()), pa.array(dst, pa.int64()), pa.array(dist, pa.float64())], ["src", "pos", "dst", "dist"])

    parts = assigned.groupBy("shard").agg(F.ceil(F.count("*") / part_rows).alias("parts"))
    rows = assigned.join(bounded(parts, 32), "shard").withColumn("part", F.pmod("id", "parts")).drop("parts")
    rows = rows.join(base.select("id", "vec"), "id")
    return rows.groupBy("shard", "part").applyInArrow(solve, "src long, pos long, dst long, dist double")


def merge_shards(edges: DataFrame, degree: int) -> DataFrame:
    """The union of the shards' neighbour lists, nearest first, cut at a degree: deterministic, unlike a shuffle."""
    return placed(edges, degree)


def tunnel(failed: DataFrame, store: DataFrame, pool: DataFrame) -> DataFrame:
    """(qid, id): what the resident neighbours of failed(qid, id) add to the pool(qid, id), without reading any node."""
    ahead = failed.join(store, F.col("id") == F.col("src")).select("qid", F.col("dst").alias("id")).distinct()
    return ahead.join(pool.select("qid", "id"), ["qid", "id"], "left_anti").where("qid <> id")


def occlusion(metric: str, to_other: np.ndarray, between: np.ndarray) -> np.ndarray:
    """As functions.vector.occlude_factor, on arrays."""
    to_other, between = np.broadcast_arrays(np.asarray(to_other, float), np.asarray(between, float))
    most = float(np.finfo(np.float32).max)
    if metric in ("l2", "cosine"):
        return np.divide(to_other, between, out=np.full(between.shape, most), where=between != 0)
    # inner products: distances may be negative, and only a pair nearer to each other than the node is to the other one counts
    out = np.full(between.shape, most)
    np.divide(between, to_other, out=out, where=(between <= 0) & (to_other < 0))
    np.divide(to_other, between, out=out, where=between > 0)
    return out * (to_other > between)


def pruned(dist: np.ndarray, mutual: np.ndarray, degree: int, alpha: float = 1.2, metric: str = "l2", fill: bool = False) -> list[int]:
    """Numbers of the neighbours that stay, nearest first. dist is ascending; mutual[i, j] is the distance of two candidates.

    A candidate's shade is the largest factor by which one that stays and is nearer hides it. With a slack of 1, then of 1.2 and so on
    up to alpha, the nearest candidate in less shade than the slack stays and shades those behind it, and so on down the list. With
    fill, the nearest others make up the degree.
    """
    n = len(dist)
    shade, behind = np.zeros(n), np.arange(n)
    stays = np.zeros(n, bool)
    for slack in (1.2**k for k in range(1 + int(np.log(alpha + 1e-6) / np.log(1.2)) if alpha + 1e-6 >= 1 else 0)):
        lit = np.flatnonzero((shade <= slack) & ~stays)
        while len(lit) and stays.sum() < degree:
            i = lit[0]
            stays[i] = True
            shade = np.where(behind > i, np.maximum(shade, occlusion(metric, dist, mutual[i])), shade)
            lit = lit[1:][shade[lit[1:]] <= slack]
    if fill and alpha > 1:
        stays[np.flatnonzero(~stays)[: max(0, degree - int(stays.sum()))]] = True
    return np.flatnonzero(stays).tolist()


def pruned_lists(dist: np.ndarray, mutual: np.ndarray, degree: int, alpha: float = 1.2, metric: str = "l2", fill: bool = False) -> np.ndarray:
    """A mask of what `pruned` lets stay, for many lists at once: dist (lists, candidates) is infinite where there is no candidate."""
    lists, n = dist.shape
    real = np.isfinite(dist)
    behind = np.arange(n) > np.arange(n)[:, None]
    hides = np.where(behind, occlusion(metric, np.where(real, dist, 0.0)[:, None], mutual), 0.0)
    shade, stays, count = np.zeros((lists, n)), np.zeros((lists, n), bool), np.zeros(lists, np.int64)
    for slack in (1.2**k for k in range(1 + int(np.log(alpha + 1e-6) / np.log(1.2)) if alpha + 1e-6 >= 1 else 0)):
        for i in range(n):
            lit = real[:, i] & ~stays[:, i] & (shade[:, i] <= slack) & (count < degree)
            if lit.any():
                stays[:, i] |= lit
                count += lit
                np.maximum(shade, hides[:, i], out=shade, where=lit[:, None])
    if fill and alpha > 1:
        free = real & ~stays
        stays |= free & (free.cumsum(1) <= (degree - count)[:, None])
    return stays


def robust_prune(candidates: DataFrame, base: DataFrame, degree: int, alpha: float = 1.2, metric: str = "l2", most: int = 750, fill: bool = False) -> DataFrame:
    """src, pos, dst, dist of what stays of edges(src, dst, dist); of each node's candidates the `most` nearest are looked at."""

    def solve(t: pa.Table) -> pa.Table:
        dist, dst = t["dist"].to_numpy(), t["dst"].to_numpy()
        order = np.lexsort((dst, dist))[:most]
        x = matrix(t["vec"])[order]
        stay = pruned(dist[order], BLOCKS[metric](x, x), degree, alpha, metric, fill)
        src = t["src"].to_numpy()[order][stay]
        return pa.table([pa.array(src), pa.array(np.arange(len(stay))), pa.array(dst[order][stay]), pa.array(dist[order][stay])], ["src", "pos", "dst", "dist"])

    rows = candidates.select("src", "dst", "dist").join(base.select(F.col("id").alias("dst"), "vec"), "dst")
    return rows.groupBy("src").applyInArrow(solve, "src long, pos long, dst long, dist double")
