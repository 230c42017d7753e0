"""Product quantisation and k-means as joins, folds and kernels.

A codebook is (chunk, center, vec): per chunk of dimensions the centres' coordinates. Codes are the nearest centre per chunk,
the lowest number among equals. A query table holds, per chunk and centre, the part of the distance that the chunk adds;
summing its entries in order of chunk gives the approximate distance.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple, Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Always, Predicate
from sparkvec.functions.vector import chunk_bounds, chunked, l2_sq, sample_rate
from sparkvec.operators.knn import found_in, matrix, met, nearest, ranked
from sparkvec.session import bounded


#: Rows that a codebook's sample has at least, if there are as many.
LEAST_SAMPLE = 10_000


class Coder(Protocol):
    """What searches need of a way to code vectors: arrays of ints that give approximate distances. `codes.CODERS` has the kinds by name."""

    @property
    def dim(self) -> int: ...

    def codes(self, x: np.ndarray) -> np.ndarray:
        """(rows, ints a row) of vectors."""

    def scorer(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of query numbers and codes that gives (queries, rows) of approximate distances."""

    def paired(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        """A function of query numbers and codes, one for each, that gives the distances of these pairs."""

    def rowwise(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        """The approximate distance of each query to the code of the same row."""

    def rows(self) -> list[tuple]:
        """As rows of `codes.SAVED`."""


class Codebook(NamedTuple):
    """centers[chunk]: (centres, width) in doubles, relative to `mean`."""

    bounds: list[tuple[int, int]]
    centers: list[np.ndarray]
    mean: np.ndarray

    @property
    def dim(self) -> int:
        return sum(n for _, n in self.bounds)

    def codes(self, x: np.ndarray) -> np.ndarray:
        x = x - self.mean if x.size else np.zeros((0, self.dim))
        return np.stack([nearest_center(x[:, at : at + n], c) for (at, n), c in zip(self.bounds, self.centers, strict=True)], 1)

    def scorer(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        tables = [np.ascontiguousarray(t.T) for t in query_tables(q, self, metric)]

        def distances(some: np.ndarray, codes: np.ndarray) -> np.ndarray:
            dist = np.zeros((len(codes), len(some)))
            for c, t in enumerate(tables):
                dist += t[:, some][codes[:, c]]  # whole rows are taken
            return np.ascontiguousarray(dist.T)

        return distances

    def paired(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        tables = query_tables(q, self, metric)

        def distances(some: np.ndarray, codes: np.ndarray) -> np.ndarray:
            dist = np.zeros(len(some))
            for c, t in enumerate(tables):
                dist += t[some, codes[:, c]]
            return dist

        return distances

    def rowwise(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        dist = np.zeros(len(codes))
        for c, ((at, n), centers) in enumerate(zip(self.bounds, self.centers, strict=True)):
            if len(codes):
                x, mine = centers[codes[:, c]], q[:, at : at + n]
                dist += ((mine - self.mean[at : at + n] - x) ** 2).sum(1) if metric == "l2" else -(mine * x).sum(1)
        return dist

    def rows(self) -> list[tuple]:
        return [("pq", c, at, n, i, v.tolist(), self.mean[at : at + n].tolist()) for c, ((at, n), x) in enumerate(zip(self.bounds, self.centers, strict=True)) for i, v in enumerate(x)]


def chunks(df: DataFrame, dim: int, m: int, vec: str = "vec") -> DataFrame:
    """id, chunk and vec (the chunk's coordinates)."""
    return df.select("id", F.posexplode(chunked(F.col(vec), dim, m)).alias("chunk", "vec"))


def codebook_of(centers: DataFrame, dim: int, m: int, mean: np.ndarray | None = None) -> Codebook:
    """From (chunk, center, vec) rows, which the number of chunks and centres bounds."""
    rows = sorted(centers.select("chunk", "center", "vec").collect())
    per = [np.array([r[2] for r in rows if r[0] == c], float) for c in range(m)]
    return Codebook(chunk_bounds(dim, m), per, np.zeros(dim) if mean is None else mean)


class Bounds:
    """Nearest centres of rows with a bound above on the distance to the own centre and one below on that to any other.

    After centres have moved, the bounds move with them; where the first is still below the second (or below half the way from the
    own centre to its nearest neighbour), the row keeps its centre and no distance is computed. `computed` counts the others.
    """

    def __init__(self, x: np.ndarray, c: np.ndarray):
        self.x, self.c, self.computed = x, c, 0
        self.of = np.zeros(len(x), np.int64)
        self.above, self.below = np.full(len(x), np.inf), np.zeros(len(x))
        self.assign()

    def assign(self) -> None:
        gap = ((self.c[:, None] - self.c[None]) ** 2).sum(-1) if len(self.c) > 1 else np.full((1, 1), np.inf)
        np.fill_diagonal(gap, np.inf)
        half = np.sqrt(gap.min(1)) / 2
        safe = np.maximum(self.below, half[self.of]) * (1 - 1e-9)  # rounding never saves a row that a tie would move
        open_ = np.flatnonzero(self.above >= safe)
        self.above[open_] = np.sqrt(((self.x[open_] - self.c[self.of[open_]]) ** 2).sum(1))
        self.computed += len(open_)
        open_ = open_[self.above[open_] >= safe[open_]]
        d = np.sqrt(np.maximum((self.x[open_] ** 2).sum(1)[:, None] + (self.c * self.c).sum(1) - 2 * self.x[open_] @ self.c.T, 0))
        self.computed += d.size
        self.of[open_] = d.argmin(1)
        two = np.partition(d, 1, 1)[:, :2] if len(self.c) > 1 else np.column_stack([d, np.full(len(d), np.inf)])
        self.above[open_], self.below[open_] = two[:, 0], two[:, 1]

    def move(self, c: np.ndarray) -> None:
        went = np.sqrt(((c - self.c) ** 2).sum(1))
        self.above += went[self.of]
        self.below -= went.max(initial=0)
        self.c = c
        self.assign()


def lloyd(x: np.ndarray, k: int, rounds: int, seed: int) -> np.ndarray:
    """k-means++ seeding and Lloyd steps, with distances computed only where bounds leave a choice; an empty cluster keeps its centre; at
    most as many centres as rows."""
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    centers = [x[rng.integers(len(x))]]
    gap = ((x - centers[0]) ** 2).sum(1)
    while len(centers) < k:
        pick = rng.choice(len(x), p=gap / gap.sum()) if gap.sum() > 0 else rng.integers(len(x))
        centers.append(x[pick])
        gap = np.minimum(gap, ((x - x[pick]) ** 2).sum(1))
    c = np.array(centers)
    before, near = np.inf, Bounds(x, c)
    for _ in range(rounds):
        n = np.bincount(near.of, minlength=len(c))
        sums = np.stack([np.bincount(near.of, weights=x[:, j], minlength=len(c)) for j in range(x.shape[1])], 1)
        residual = max(((x - c[near.of]) ** 2).sum(), 0)
        c = np.where(n[:, None] > 0, sums / np.maximum(n, 1)[:, None], c)
        if before - residual <= 1e-5 * max(residual, 1e-300):
            break
        before = residual
        near.move(c)
    return c


def opened_codebook(rows: list) -> Codebook:
    """From what `rows` gave; chunks x centres of them."""
    rows = sorted(rows, key=lambda r: (r.chunk, r.center))
    first = [r for r in rows if r.center == 0]
    per = [np.array([r.vec for r in rows if r.chunk == f.chunk], float) for f in first]
    return Codebook([(f.start, f.width) for f in first], per, np.concatenate([np.zeros(0), *(np.array(f.mean, float) for f in first)]))


def train(df: DataFrame, dim: int, m: int, k: int = 256, rounds: int = 15, seed: int = 42, share: float = 0.1, most: int = 256_000) -> Codebook:
    """A codebook from a bounded sample: a share of the rows, `most` at most and LEAST_SAMPLE at least; chunks in parallel."""
    n = df.count()
    rate = min(1.0, max(sample_rate(n, share, most), LEAST_SAMPLE / max(n, 1)))
    sample = df.where("vec is not null").where(F.size("vec") == dim)
    if rate < 1:
        sample = sample.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < int(rate * (1 << 20)))
    mean = F.array(*(F.avg(F.element_at("vec", i + 1)) for i in range(dim)))
    mean = np.array(sample.agg(mean).first()[0], float)

    def fit(key: tuple, t: pa.Table) -> pa.Table:
        c = key[0].as_py()
        at, width = bounds[c]
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        centers = lloyd(matrix(t["vec"])[order] - mean[at : at + width], k, rounds, seed + c)
        return pa.table([pa.array([c] * len(centers), pa.int32()), pa.array(range(len(centers)), pa.int32()), pa.array(centers.tolist(), pa.list_(pa.float64()))], ["chunk", "center", "vec"])

    bounds = chunk_bounds(dim, m)
    fitted = chunks(sample, dim, m).groupBy("chunk").applyInArrow(fit, "chunk int, center int, vec array<double>")
    return codebook_of(fitted, dim, m, mean)


def encode(df: DataFrame, book: Coder, *keep: str, keep_vec: bool = False) -> DataFrame:
    """id, the columns to keep (and vec), and codes (array<int>). The codebook is small by construction and goes to all tasks."""
    held = df.sparkSession.sparkContext.broadcast(book)
    src = df.where("id is not null and vec is not null").where(F.size("vec") == book.dim).select("id", *keep, "vec")
    fields = ", ".join(f"`{n}` {t}" for n, t in (src if keep_vec else src.drop("vec")).dtypes)
    last = None if keep_vec else -1

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        book = held.value
        for b in batches:
            x = matrix(b.column(b.schema.get_field_index("vec"))) if b.num_rows else np.zeros((0, book.dim))
            codes = book.codes(x)
            lists = pa.ListArray.from_arrays(pa.array(np.arange(len(codes) + 1) * codes.shape[1], pa.int32()), pa.array(codes.ravel(), pa.int32()))
            yield pa.record_batch([*b.columns[:last], lists], [*b.schema.names[:last], "codes"])

    return src.mapInArrow(run, f"{fields}, codes array<int>")


def nearest_center(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    d = np.zeros((len(x), len(c)))
    for j in range(c.shape[1]):
        step = x[:, j, None] - c[None, :, j]
        d += step * step
    return d.argmin(1).astype(np.int32)


def query_tables(q: np.ndarray, book: Codebook, metric: str = "l2") -> list[np.ndarray]:
    """Per chunk (queries, centres): squared distances of the centred query, or negative inner products of the raw one."""
    out = []
    for (at, n), c in zip(book.bounds, book.centers, strict=True):
        d = np.zeros((len(q), len(c)))
        for j in range(n):
            x = q[:, at + j, None]
            d += (x - book.mean[at + j] - c[None, :, j]) ** 2 if metric == "l2" else -(x * c[None, :, j])
        out.append(d)
    return out


def query_table(queries: DataFrame, centers: DataFrame, dim: int, m: int, metric: str = "l2") -> DataFrame:
    """qid, chunk, center, value by a join of the queries' chunks with the codebook's rows of that chunk."""
    parts = queries.select("qid", F.posexplode(chunked(F.col("qvec"), dim, m)).alias("chunk", "part"))
    joined = parts.join(bounded(centers.withColumnRenamed("vec", "center_vec"), 8 * dim + 32), "chunk")
    ip = F.aggregate(F.zip_with("part", "center_vec", lambda x, y: -(x * y)), F.lit(0.0), lambda s, x: s + x)
    return joined.select("qid", "chunk", "center", (l2_sq(F.col("part"), F.col("center_vec")) if metric == "l2" else ip).alias("value"))


def adc(codes: DataFrame, queries: DataFrame, book: Coder, k: int, metric: str = "l2", where: Predicate | None = None, with_self: bool = False) -> DataFrame:
    """qid, id, dist, rk: of the rows that satisfy the predicate each query's k with the least approximate distance, from codes alone.

    The gate is inside the kernel, so rows that fail it take no place in the pool.
    """
    where = where or Always()
    held = codes.sparkSession.sparkContext.broadcast(book)

    def kernel(b: pa.RecordBatch, q: pa.Table) -> pa.RecordBatch:
        score = held.value.scorer(matrix(q["qvec"]), metric)
        code = np.asarray(b.column(1).flatten()).reshape(b.num_rows, -1)
        return found_in(b, q, k, where, with_self, lambda some, rows: score(some, code[rows]))

    ask = queries.where("qid is not null and qvec is not null").where(F.size("qvec") == book.dim).select("qid", "qvec", *where.query_columns)
    return ranked(met(codes.select("id", "codes", *where.base_columns), ask, book.dim * 8 + 64, kernel), k)


def code_values(pairs: DataFrame, queries: DataFrame, codes: DataFrame, centers: DataFrame, dim: int, m: int, metric: str = "l2") -> DataFrame:
    """qid, id, value: approximate distances of pairs(qid, id), from joins of the queries' tables and the rows' codes."""
    tables = query_table(queries, centers, dim, m, metric)
    per = tables.groupBy("qid", "chunk").agg(F.array_sort(F.collect_list(F.struct("center", "value"))).alias("t"))  # as many as centres
    per = per.groupBy("qid").agg(F.array_sort(F.collect_list(F.struct("chunk", F.col("t.value").alias("t")))).alias("t")).select("qid", F.col("t.t").alias("tables"))
    rows = pairs.join(codes.select("id", "codes"), "id").join(per, "qid")
    each = F.zip_with("tables", "codes", lambda t, c: F.get(t, c))
    return rows.select("qid", "id", F.aggregate(each, F.lit(0.0), lambda s, x: s + x).alias("value"))


def symmetric(pairs: DataFrame, codes: DataFrame, book: Codebook) -> DataFrame:
    """qid, id, value of pairs(qid, id): distances between the two rows' codes, from the centres' mutual distances."""
    mutual = []
    for c in book.centers:
        d = np.zeros((len(c), len(c)))
        for j in range(c.shape[1]):
            step = c[:, j, None] - c[None, :, j]
            d += step * step
        mutual.append(d)
    held = codes.sparkSession.sparkContext.broadcast(mutual)  # as large as the codebook allows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for x in batches:
            a, b = (np.asarray(x.column(i).flatten()).reshape(x.num_rows, -1) for i in (2, 3))
            value = np.zeros(x.num_rows)
            for c, d in enumerate(held.value):
                value += d[a[:, c], b[:, c]]
            yield pa.record_batch([x.column(0), x.column(1), pa.array(value)], ["qid", "id", "value"])

    one = codes.select("id", "codes")
    rows = pairs.join(one, "id").join(one.select(F.col("id").alias("qid"), F.col("codes").alias("qcodes")), "qid")
    return rows.select("qid", "id", "qcodes", "codes").mapInArrow(run, "qid long, id long, value double")


def closest_centers(df: DataFrame, centers: DataFrame, k: int) -> DataFrame:
    """id, center, dist and rk of the k centres nearest to each row; centers(center, cvec) is small and broadcast."""
    held = df.sparkSession.sparkContext.broadcast(centers.orderBy("center").toArrow())

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = matrix(held.value["cvec"]), held.value["center"].to_numpy()
        for b in batches:
            x, ids = matrix(b.column(1)), b.column(0).to_numpy()
            d = np.zeros((len(ids), len(c)))
            for j in range(c.shape[1]):
                step = x[:, j, None] - c[None, :, j]
                d += step * step
            r, at = nearest(d, names, None, k)
            rk = np.arange(len(r)) - np.searchsorted(r, r) + 1
            yield pa.record_batch([pa.array(ids[r]), pa.array(names[at]), pa.array(d[r, at]), pa.array(rk)], ["id", "center", "dist", "rk"])

    src = df.where("id is not null and vec is not null").select("id", "vec")
    return src.mapInArrow(run, "id long, center long, dist double, rk long")


def kmeans_step(df: DataFrame, centers: DataFrame, dim: int) -> DataFrame:
    """center, n, sse and cvec after one Lloyd step; centres that no row is nearest to keep their place.

    Each batch gives counts and coordinate sums per centre, so no vector is shuffled.
    """
    held = df.sparkSession.sparkContext.broadcast(centers.orderBy("center").toArrow())  # k rows

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, names = matrix(held.value["cvec"]), held.value["center"].to_numpy()
        n, sse, sums = np.zeros(len(c), np.int64), np.zeros(len(c)), np.zeros((len(c), dim))
        for b in batches:
            x = matrix(b.column(1))
            if not len(x):
                continue
            d = np.zeros((len(x), len(c)))
            for j in range(dim):
                step = x[:, j, None] - c[None, :, j]
                d += step * step
            of = d.argmin(1)
            n += np.bincount(of, minlength=len(c))
            sse += np.bincount(of, weights=d.min(1), minlength=len(c))
            np.add.at(sums, of, x)
        yield pa.record_batch([pa.array(names), pa.array(n), pa.array(sse), pa.array(sums.tolist(), pa.list_(pa.float64()))], ["center", "n", "sse", "sums"])

    src = df.where("id is not null and vec is not null").where(F.size("vec") == dim).select("id", "vec")
    parts = src.mapInArrow(run, "center long, n long, sse double, sums array<double>").where("n > 0")
    total = F.array(*(F.sum(F.element_at("sums", i + 1)) for i in range(dim)))
    moved = parts.groupBy("center").agg(F.sum("n").alias("n"), F.sum("sse").alias("sse"), total.alias("sums"))
    out = centers.join(moved, "center", "left")
    mean = F.transform("sums", lambda x: x / F.col("n"))
    return out.select("center", F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("sse", F.lit(0.0)).alias("sse"), F.coalesce(mean, F.col("cvec").cast("array<double>")).alias("cvec"))


def kmeans(df: DataFrame, dim: int, k: int, rounds: int = 20, seed: int = 42) -> DataFrame:
    """center and cvec: seeded on the rows of least hash (a bounded sample), then `rounds` distributed Lloyd steps."""
    spark = df.sparkSession
    seeds = df.where("vec is not null").orderBy(F.xxhash64("id", F.lit(seed)), "id").limit(min(64 * k, 20_000)).select("vec").toArrow()
    rows = [(i, c.tolist()) for i, c in enumerate(lloyd(matrix(seeds["vec"]), k, 3, seed))]
    for _ in range(rounds):
        centers = spark.createDataFrame(rows, "center long, cvec array<double>")
        new = sorted((r[0], list(r[1])) for r in kmeans_step(df, centers, dim).select("center", "cvec").collect())  # k rows
        if new == rows:
            break
        rows = new
    return spark.createDataFrame(rows, "center long, cvec array<double>")


def shard_assign(df: DataFrame, centers: DataFrame, copies: int = 2) -> DataFrame:
    """id and shard: each row in the shards of its nearest centres."""
    return closest_centers(df, centers, copies).select("id", F.col("center").alias("shard"))


def shard_sizes(assigned: DataFrame) -> DataFrame:
    return assigned.groupBy("shard").agg(F.count("*").alias("n"))


def centroid(df: DataFrame, dim: int) -> DataFrame:
    """pos and value of the mean vector."""
    mean = F.array(*(F.avg(F.element_at("vec", i + 1).cast("double")) for i in range(dim)))
    return df.agg(mean.alias("m")).select(F.posexplode("m").alias("pos", "value"))


def medoid(df: DataFrame, dim: int) -> DataFrame:
    """id and dist of the row nearest to the mean, the smallest id among equals."""
    mean = [float(r[1]) for r in sorted(centroid(df, dim).collect())]  # dim numbers
    dist = l2_sq(F.col("vec"), F.array(*(F.lit(x) for x in mean)))
    return df.select("id", dist.alias("dist")).agg(F.min(F.struct("dist", "id")).alias("x")).select("x.id", "x.dist")
