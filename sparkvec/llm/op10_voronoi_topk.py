"""Exact top-k by integer inner product as a Voronoi kNN join.

Components become floor(1024 x). With Phi the largest norm of the data, a further component sqrt(Phi^2 - |s|^2) for data and
0 for queries turns the largest inner product into the smallest Euclidean distance: |q - s|^2 = |q|^2 + Phi^2 - 2 q.s. Data
and queries are then assigned to the nearest of about sqrt(n) pivots. From summaries per cell alone (largest query distance, the
k + r smallest data distances, with r the most rows that any query's id has) follows for each query cell a bound theta that the k-th
distance of none of its queries exceeds. Query cells are gathered into groups, and a data row of cell j at distance d from its pivot is sent to a group only if
d >= |p_i p_j| - U_i - theta_i for one of the group's cells i: by the triangle inequality all others are too far. Every group is
solved locally, in parts of bounded size (as many as the rows that it was sent need), and the parts' results are merged. Inner products are sums of integers far
below 2^53 and so exact in double precision.

Pivots are a bounded sample (rows of smallest hash); they affect cost only. Vectors that are null, empty or hold null or
non-finite components, and rows without id take no part; zero vectors do. Vectors only meet others of the same length. A
query's own id is no candidate; rows that repeat an id are candidates of their own, and a repeated query id is searched once,
with its smallest vector. An empty table gives an empty result.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm.common import written
from sparkvec.llm.vectors import matrix, merged, usable
from sparkvec.session import table

#: Pivots at least and at most (the driver holds their mutual distances), rows of a part, queries of a group, scale of components.
PIVOTS, MOST_PIVOTS, PART_ROWS, GROUP_QUERIES, SCALE = 48, 2048, 2048, 512, 1024
#: Rows of a cell, besides k, whose distances the driver gets. With more rows of one id the bound only loosens.
OWN = 1000
FOUND = "query_id long, vec_id long, score long"


def integers(df: DataFrame) -> DataFrame:
    """v as floor(1024 x) in doubles, with its squared norm."""
    out = df.withColumn("v", F.transform("v", lambda x: F.floor(x * SCALE).cast("double")))
    return out.withColumn("sq", F.aggregate("v", F.lit(0.0), lambda a, x: a + x * x))


def extended(x: np.ndarray, phi2: float) -> np.ndarray:
    return np.column_stack([x, np.sqrt(np.maximum(phi2 - (x * x).sum(1), 0))])


def assigned(rows: DataFrame, pivots: np.ndarray, phi2: float, data: bool) -> DataFrame:
    """Adds the nearest pivot's number and the distance to it, in the extended space."""
    dim = pivots.shape[1] - 1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = matrix(b.column(1), dim)
            y = extended(x, phi2) if data else np.column_stack([x, np.zeros(len(x))])
            far = (y * y).sum(1)[:, None] + (pivots * pivots).sum(1) - 2 * y @ pivots.T
            cell = far.argmin(1) if len(x) else np.zeros(0, int)
            dist = np.sqrt(((y - pivots[cell]) ** 2).sum(1))
            yield pa.record_batch([b.column(0), b.column(1), pa.array(cell, pa.int32()), pa.array(dist, pa.float64())], ["key", "v", "cell", "dist"])

    return rows.select("key", "v").mapInArrow(run, "key long, v array<double>, cell int, dist double")


def bounds(pivots: np.ndarray, reach: dict[int, float], nearest: list[tuple[int, float]], k: int, own: int) -> dict[int, np.ndarray]:
    """For every query cell i the least distance from its pivot that a row of each data cell needs to be among the k nearest.

    Up to `own` rows may have a query's id, so the k-th of the others is among the first k + own.
    """
    between = np.sqrt(((pivots[:, None] - pivots[None]) ** 2).sum(-1))
    cells, dist = np.array([c for c, _ in nearest], int), np.array([d for _, d in nearest])
    out = {}
    for i, u in reach.items():
        upper = np.sort(u + between[i, cells] + dist)
        theta = upper[k + own - 1] if len(upper) >= k + own else np.inf
        out[i] = (between[i] - u - theta) * (1 - 1e-9) - 1e-6
    return out


def grouped(counts: dict[int, int], pivots: np.ndarray, most: int) -> list[list[int]]:
    """Neighbouring query cells gathered until a group has `most` queries."""
    left, out = set(counts), []
    while left:
        at = min(left)
        near = sorted(left, key=lambda c: (float(((pivots[c] - pivots[at]) ** 2).sum()), c))
        group, n = [], 0
        for c in near:
            if group and n + counts[c] > most:
                break
            group.append(c)
            n += counts[c]
        out.append(group)
        left -= set(group)
    return out


def solve_groups(data: DataFrame, queries: DataFrame, groups: list[list[int]], needs: dict[int, np.ndarray], blocks: int, part_rows: int, dim: int, k: int) -> DataFrame:
    """Send each row where it may matter, and find every group part's best."""
    floor = np.array([np.min([needs[c] for c in g], axis=0) for g in groups])
    group_of = {c: g for g, cells in enumerate(groups) for c in cells}

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cell, dist = b.column(2).to_numpy(), b.column(3).to_numpy()
            row, group = np.nonzero(dist[:, None] >= floor[:, cell].T)
            take = pa.array(row, pa.int64())
            yield pa.record_batch([pa.array(group, pa.int32()), b.column(0).take(take), b.column(1).take(take)], ["grp", "key", "v"])

    def part(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(name)), F.lit(n)).cast("int")

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def counted(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        n = np.zeros(len(floor), np.int64)
        for b in batches:
            cell, dist = b.column(0).to_numpy(), b.column(1).to_numpy()
            n += (dist[:, None] >= floor[:, cell].T).sum(0)
        yield pa.record_batch([pa.array(np.arange(len(n)), pa.int32()), pa.array(n)], ["grp", "n"])

    spark = data.sparkSession
    got = data.select("cell", "dist").mapInArrow(counted, "grp int, n long").groupBy("grp").agg(F.sum("n").alias("n"))
    salts = got.select("grp", F.greatest(F.lit(1), F.ceil(F.col("n") / part_rows)).cast("int").alias("salts"))
    salts = F.broadcast(written(salts))  # one row per group
    sent = data.mapInArrow(send, "grp int, key long, v array<double>").join(salts, "grp")
    sent = sent.select("grp", each(blocks).alias("block"), F.pmod(F.xxhash64("key", F.lit("salt")), F.col("salts")).cast("int").alias("salt"), "key", "v")
    groups_of = F.broadcast(spark.createDataFrame(list(group_of.items()), "cell int, grp int"))  # one row per query cell
    asked = queries.join(groups_of, "cell").join(salts, "grp")
    asked = asked.select("grp", part("block", blocks).alias("block"), F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"), "key", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        ids, found, score = [], [], []
        if left.num_rows and right.num_rows:
            keys = left["key"].to_numpy()
            order = np.argsort(keys, kind="stable")
            keys, x = keys[order], matrix(left["v"], dim)[order]
            for query, row in zip(right["key"].to_numpy(), matrix(right["v"], dim) @ x.T, strict=True):
                row[keys == query] = -np.inf
                first = np.argsort(-row, kind="stable")[:k]
                first = first[row[first] > -np.inf]
                ids.extend([query] * len(first))
                found.extend(keys[first])
                score.extend(row[first].astype(np.int64))
        return pa.table([pa.array(c, pa.int64()) for c in (ids, found, score)], ["query_id", "vec_id", "score"])

    by = ["grp", "block", "salt"]
    return sent.groupBy(*by).cogroup(asked.groupBy(*by)).applyInArrow(solve, FOUND)


def search(rows: DataFrame, is_query: Column, k: int, n_pivots: int | None = None, part_rows: int = PART_ROWS, group_queries: int = GROUP_QUERIES) -> DataFrame:
    """query_id, rank, vec_id and score of the k highest inner products; rows come from `usable`."""
    spark, rows = rows.sparkSession, written(integers(rows))
    out = None
    for dim, phi2, n in sorted(rows.groupBy("dim").agg(F.max("sq"), F.count("*")).collect()):  # one row per vector length
        data = rows.where(F.col("dim") == dim)
        wanted = n_pivots or min(max(PIVOTS, int(n**0.5)), MOST_PIVOTS)
        sample = data.orderBy(F.xxhash64("key"), "key").limit(wanted).select("v").collect()
        pivots = extended(np.unique(np.array([r[0] for r in sample]), axis=0), phi2)
        queries = data.where(is_query).groupBy("key").agg(F.min("v").alias("v"))
        data, queries = written(assigned(data, pivots, phi2, True)), written(assigned(queries, pivots, phi2, False))
        own = data.join(queries.select("key"), "key", "left_semi").groupBy("key").count().agg(F.max("count")).first()[0] or 0
        in_cell = W.partitionBy("cell").orderBy("dist")
        nearest = data.select("cell", "dist", F.row_number().over(in_cell).alias("rn")).where(F.col("rn") <= k + min(own, OWN))
        nearest = [(r[0], r[1]) for r in nearest.collect()]  # k + OWN per pivot at most
        asked = queries.groupBy("cell").agg(F.max("dist"), F.count("*")).collect()
        if not asked:
            continue
        needs = bounds(pivots, {r[0]: r[1] for r in asked}, nearest, k, own)
        counts = {r[0]: r[2] for r in asked}
        blocks = max(1, -(-max(counts.values()) // (4 * group_queries)))
        found = solve_groups(data, queries, grouped(counts, pivots, group_queries), needs, blocks, part_rows, dim, k)
        out = found if out is None else out.unionByName(found)
    return merged(spark.createDataFrame([], FOUND) if out is None else out, k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 10 highest integer inner products of every row of embeddings whose vec_id is divisible by 100."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=True)
    return search(rows, F.col("key") % 100 == 0, 10)

