"""Exact nearest neighbours under a predicate: every query against every row, in blocks.

Queries whose counted size is small go to all tasks; more of them are cut into blocks that meet salted parts of the base, so
neither side is ever whole in one task. Either way a kernel takes one block of queries at a time, computes a block of distances and
hands on each query's k best matching rows, and a window merges them. Distances add up element by element in double precision, as `functions.vector` does;
of many rows, a matrix product with a bound on its rounding rules out those that are not among the k best, and only the others' are added up so.
Rows with a null id, a null vector or another length than the queries' take no part.
"""

import uuid
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Always, Predicate

#: Bytes of queries that are broadcast, queries that a kernel takes at once, rows of a base part beyond that, elements of a distance block.
BROADCAST, QUERY_BLOCK, PART_ROWS, BLOCK = 64 << 20, 1024, 1 << 16, 1 << 20
#: Blocks of queries that meet a part together, so that parts are not sent once for each; rows from which on products rule out; pairs that are settled at once.
BLOCKS_TOGETHER, PRODUCT_ROWS, SETTLED = 16, 1024, 1 << 14
FOUND = "qid long, id long, dist double"


def matrix(col: pa.Array | pa.ChunkedArray) -> np.ndarray:
    """A list column without nulls, of equal lengths, as rows of doubles."""
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    flat = np.asarray(col.flatten(), np.float64)
    return flat.reshape(len(col), -1) if len(col) else flat.reshape(0, 0)


def l2_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        step = q[:, d, None] - x[None, :, d]
        step *= step
        out += step
    return out


def ip_block(q: np.ndarray, x: np.ndarray) -> np.ndarray:
    out = np.zeros((len(q), len(x)))
    for d in range(q.shape[1]):
        out += q[:, d, None] * x[None, :, d]
    return 1.0 - out


BLOCKS: dict[str, Callable[[np.ndarray, np.ndarray], np.ndarray]] = {"l2": l2_block, "cosine": ip_block, "ip": ip_block, "mips": ip_block}


def pair_distances(metric: str, q: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Of each q to the x of the same row, added up in the order of BLOCKS."""
    out = np.zeros(len(q))
    for d in range(q.shape[1]):
        step = q[:, d] - x[:, d] if metric == "l2" else x[:, d]
        out += step * (step if metric == "l2" else q[:, d])
    return out if metric == "l2" else 1.0 - out


def nearest(dist: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Row and column numbers of each row's k least entries, ties by id."""
    if allowed is not None:
        dist = np.where(allowed, dist, np.inf)
    rows, cols = [], []
    for r, line in enumerate(dist):
        if len(line) > k:
            at = np.flatnonzero(line <= np.partition(line, k - 1)[k - 1])
        else:
            at = np.arange(len(line))
        at = at[np.isfinite(line[at])]
        at = at[np.lexsort((ids[at], line[at]))][:k]
        rows.append(np.full(len(at), r))
        cols.append(at)
    return np.concatenate(rows) if rows else np.zeros(0, int), np.concatenate(cols) if cols else np.zeros(0, int)


def alike(allowed: np.ndarray | None, queries: int, rows: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Numbers of the queries that may have the same rows, with these rows: distances are computed within such groups only."""
    if allowed is None:
        yield np.arange(queries), np.arange(rows)
        return
    _, of = np.unique(np.packbits(allowed, axis=1), axis=0, return_inverse=True)
    for group in np.split(np.argsort(of, kind="stable"), np.cumsum(np.bincount(of))[:-1]):
        if len(group) and len(at := np.flatnonzero(allowed[group[0]])):
            yield group, at


class Products:
    """Distances by one matrix product, with a bound on how far they are from those that are added up in order."""

    def __init__(self, q: np.ndarray, x: np.ndarray, metric: str):
        self.q, self.x, self.metric = q, x, metric
        with np.errstate(over="ignore", invalid="ignore"):
            self.q_sq, self.x_sq = (q * q).sum(1), (x * x).sum(1)

    def bound(self, some: np.ndarray, rows: np.ndarray) -> np.ndarray | None:
        """For each query; none where products may not be finite."""
        # a sum of n products is off by n roundings of its absolute terms at most, in any order; this is four times what all sums here need
        with np.errstate(over="ignore", invalid="ignore"):
            size = self.q_sq[some] + self.x_sq[rows].max(initial=0) + (self.metric != "l2")
            ok = np.isfinite(4 * size).all() and np.isfinite(self.x_sq[rows]).all()
        return 8 * (self.q.shape[1] + 2) * np.finfo(float).eps * size + 1e-300 if ok else None

    def distances(self, some: np.ndarray, rows: np.ndarray) -> np.ndarray:
        products = self.q[some] @ self.x[rows].T
        if self.metric != "l2":
            return np.subtract(1.0, products, out=products)
        products *= -2
        products += self.q_sq[some, None]
        products += self.x_sq[rows]
        return products

    def nearest(self, some: np.ndarray, rows: np.ndarray, ids: np.ndarray, allowed: np.ndarray | None, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """As `nearest` by the distances of BLOCKS, and these: they are computed where the bound leaves a row among the k nearest."""
        rough = self.distances(some, rows)
        if allowed is not None:
            np.copyto(rough, np.inf, where=~allowed)
        most = np.partition(rough, k - 1, 1)[:, k - 1] + 2 * bound if rough.shape[1] > k else np.full(len(rough), np.inf)
        at, col = np.nonzero(rough <= np.minimum(most, np.finfo(float).max)[:, None])
        dist = np.concatenate([np.zeros(0), *(pair_distances(self.metric, self.q[some[at[n : n + SETTLED]]], self.x[rows[col[n : n + SETTLED]]]) for n in range(0, len(at), SETTLED))])
        order = np.lexsort((ids[col], dist, at))
        at, col, dist = at[order], col[order], dist[order]
        best = np.arange(len(at)) - np.searchsorted(at, at) < k
        return at[best], col[best], dist[best]


def found_in(base: pa.RecordBatch, queries: pa.Table, k: int, where: Predicate, with_self: bool, distances: Callable[[np.ndarray, np.ndarray], np.ndarray], products: Products | None = None) -> pa.RecordBatch:
    """Each query's k nearest rows that satisfy the predicate; distances(query numbers, row numbers) is asked for these rows only,
    and for few of them where products can be asked before."""
    ids, qids = base.column(base.schema.get_field_index("id")).to_numpy(), queries["qid"].to_numpy()
    out = []
    step = max(1, BLOCK // max(1, len(ids)))
    for at in range(0, len(qids), step):
        allowed = where.mask(base, queries.slice(at, step))
        for group, rows in alike(allowed, min(step, len(qids) - at), len(ids)):
            other = None if with_self else qids[group + at, None] != ids[rows][None]
            bound = products.bound(group + at, rows) if products is not None and len(rows) >= PRODUCT_ROWS else None
            if bound is None:
                dist = distances(group + at, rows)
                r, c = nearest(dist, ids[rows], other, k)
                d = dist[r, c]
            else:
                r, c, d = products.nearest(group + at, rows, ids[rows], other, k, bound)
            out.append((qids[group + at][r], ids[rows][c], d))
    cols = [np.concatenate(c) for c in zip(*out, strict=True)] if out else [np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)]
    return pa.record_batch([pa.array(cols[0], pa.int64()), pa.array(cols[1], pa.int64()), pa.array(cols[2], pa.float64())], ["qid", "id", "dist"])


def block_knn(base: pa.RecordBatch, queries: pa.Table, k: int, metric: str, where: Predicate, with_self: bool) -> pa.RecordBatch:
    """The kernel: base has id and vec, queries have qid and qvec, both with the predicate's columns."""
    q, x = matrix(queries["qvec"]), matrix(base.column(base.schema.get_field_index("vec")))
    return found_in(base, queries, k, where, with_self, lambda some, rows: BLOCKS[metric](q[some], x[rows]), Products(q, x, metric))


def ranked(found: DataFrame, k: int) -> DataFrame:
    """qid, id, dist and rk (from 1) of each query's k nearest, ties by id."""
    rk = F.row_number().over(W.partitionBy("qid").orderBy("dist", "id"))
    return found.withColumn("rk", rk.cast("long")).where(F.col("rk") <= k).select("qid", "id", "dist", "rk")


Kernel = Callable[[pa.RecordBatch, pa.Table], pa.RecordBatch]


def met(base: DataFrame, queries: DataFrame, row_bytes: int, kernel: Kernel) -> DataFrame:
    """What the kernel finds (qid, id, dist) for every batch of base(id, ...) and every query(qid, ...).

    Queries of a counted size below BROADCAST go to all tasks; more are cut into some blocks at a time that meet salted parts of the base. What
    a worker computes at once is of one block of queries, however many there are.
    """
    n = queries.count()
    if n * row_bytes <= BROADCAST:
        held = base.sparkSession.sparkContext.broadcast(queries.toArrow())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                for at in range(0, held.value.num_rows, QUERY_BLOCK):
                    yield kernel(b, held.value.slice(at, QUERY_BLOCK))

        return base.mapInArrow(run, FOUND)
    blocks, parts = -(-n // (BLOCKS_TOGETHER * QUERY_BLOCK)), max(1, -(-base.count() // PART_ROWS))
    name = uuid.uuid4().hex

    def dealt(key: str, count: int) -> F.Column:
        return F.pmod(F.xxhash64(key, F.lit(name)), F.lit(count)).cast("int")

    left = base.withColumn("part", dealt("id", parts)).withColumn("block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))))
    right = queries.withColumn("block", dealt("qid", blocks)).withColumn("part", F.explode(F.sequence(F.lit(0), F.lit(parts - 1))))

    def solve(b: pa.Table, q: pa.Table) -> pa.Table:
        rows = b.combine_chunks().to_batches()
        return pa.Table.from_batches([kernel(x, q.slice(at, QUERY_BLOCK)) for x in rows for at in range(0, q.num_rows, QUERY_BLOCK)], pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64())]))

    return left.groupBy("part", "block").cogroup(right.groupBy("part", "block")).applyInArrow(solve, FOUND)


def knn(base: DataFrame, queries: DataFrame, k: int, metric: str = "l2", where: Predicate | None = None, with_self: bool = False) -> DataFrame:
    """qid, id, dist, rk: for each query the k nearest rows that satisfy the predicate; fewer if fewer match."""
    if metric not in BLOCKS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(BLOCKS)}")
    where = where or Always()
    base = base.where("id is not null and vec is not null").select("id", "vec", *where.base_columns)
    queries = queries.where("qid is not null and qvec is not null").select("qid", "qvec", *where.query_columns)
    dim = queries.agg(F.max(F.size("qvec"))).first()[0] or 0
    base, queries = base.where(F.size("vec") == dim), queries.where(F.size("qvec") == dim)
    return ranked(met(base, queries, dim * 8 + 64, lambda b, q: block_knn(b, q, k, metric, where, with_self)), k)


def matching_points(base: DataFrame, queries: DataFrame, where: Predicate) -> DataFrame:
    """qid, id of all rows that satisfy each query's predicate; an equality predicate is an equi-join."""
    pairs = base.select("id", *where.base_columns).join(queries.select("qid", *where.query_columns), where.column())
    return pairs.select("qid", "id")


def selectivity(base: DataFrame, queries: DataFrame, where: Predicate) -> DataFrame:
    """qid and the share of base rows that match, over counted groups of equal attributes."""
    groups = base.groupBy(*where.base_columns).agg(F.count("*").alias("n"))
    hits = queries.select("qid", *where.query_columns).join(groups, where.column(), "left")
    n = base.count()
    return hits.groupBy("qid").agg((F.coalesce(F.sum("n"), F.lit(0)).cast("double") / F.lit(float(max(n, 1)))).alias("sel"))


def partitioned_knn(base: DataFrame, queries: DataFrame, k: int, parts: int, metric: str = "l2") -> DataFrame:
    """The k nearest of each part of the base, united and ranked again: one pass, as the kernel takes the parts one by one."""
    if metric not in BLOCKS:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(BLOCKS)}")
    dim = queries.agg(F.max(F.size("qvec"))).first()[0] or 0
    base = base.where("id is not null and vec is not null").where(F.size("vec") == dim).select("id", "vec", F.pmod("id", F.lit(parts)).alias("part"))
    queries = queries.where("qid is not null and qvec is not null").where(F.size("qvec") == dim).select("qid", "qvec")

    def kernel(b: pa.RecordBatch, q: pa.Table) -> pa.RecordBatch:
        part = b.column(2).to_numpy()
        each = [block_knn(b.take(pa.array(np.flatnonzero(part == p))), q, k, metric, Always(), False) for p in np.unique(part)]
        return pa.concat_batches(each) if each else block_knn(b, q, k, metric, Always(), False)

    return ranked(met(base, queries, dim * 8 + 64, kernel), k)
