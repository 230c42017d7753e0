"""A tree of cells with a row budget: near rows share a cell, and no cell holds more rows than its budget.

Cells above the budget are split all at once, one level a round: each is cut by k-means over a bounded sample of its own rows into as many
children as its size asks for, and its rows go to the nearest child. Rows that k-means cannot part (equal vectors) are dealt by a
hash of the id. The same descent places new rows and queries, so a table that grows splits only the cells that overflow.

tree: cell, parent, hashed, cvec (null for hashed children). A cell's number is its parent's times FAN plus its place, the root is 1.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators.knn import matrix
from sparkvec.operators.quantization import lloyd
from sparkvec.session import BROADCAST_BYTES, bounded, written

ROOT, FAN = 1, 256
#: Sampled rows for each child that a split makes; how much of a cell may be in one child before it is dealt by hash.
SAMPLED, LOPSIDED = 64, 0.9
TREE = "cell long, parent long, hashed boolean, cvec array<double>"
#: Per parent: whether rows are dealt by hash, the children, their centres.
Level = dict[int, tuple[bool, np.ndarray, np.ndarray | None]]


def level_of(tree: pa.Table) -> Level:
    out: Level = {}
    parent = tree["parent"].to_numpy()
    for p in np.unique(parent):
        mine = tree.filter(pa.array(parent == p)).sort_by("cell")
        hashed = mine["hashed"][0].as_py()
        out[int(p)] = (hashed, mine["cell"].to_numpy(), None if hashed else matrix(mine["cvec"]))
    return out


def moved(cell: np.ndarray, x: np.ndarray, draw: np.ndarray, level: Level) -> np.ndarray:
    """The children that rows go to; rows of cells without children stay."""
    out = cell.copy()
    for p in np.unique(cell):
        if int(p) in level:
            hashed, ids, centers = level[int(p)]
            mine = np.flatnonzero(cell == p)
            if hashed:
                out[mine] = ids[draw[mine] % len(ids)]
            else:
                v = x[mine]
                d = (v * v).sum(1)[:, None] + (centers * centers).sum(1) - 2 * v @ centers.T
                out[mine] = ids[d.argmin(1)]
    return out


def step(rows: DataFrame, tree: DataFrame) -> DataFrame:
    """rows(id, vec, cell) one level further down. Centres go to all tasks if they are few, else cells meet them."""
    kind = dict(rows.dtypes)["vec"]
    schema = f"id long, vec {kind}, cell long"
    src = rows.select("id", "vec", "cell", F.pmod(F.xxhash64("id", "cell"), F.lit(1 << 30)).alias("draw"))

    def solve(b: pa.RecordBatch | pa.Table, level: Level) -> list:
        cell = b.column(2).to_numpy()
        return [b.column(0), b.column(1), pa.array(moved(cell, matrix(b.column(1)), b.column(3).to_numpy(), level) if len(cell) else cell, pa.int64())]

    dim = tree.select(F.max(F.size("cvec"))).first()[0] or 1
    if tree.count() * (8 * dim + 64) <= BROADCAST_BYTES:
        held = rows.sparkSession.sparkContext.broadcast(level_of(tree.toArrow()))

        def run(batches):
            for b in batches:
                yield pa.record_batch(solve(b, held.value), ["id", "vec", "cell"])

        return src.mapInArrow(run, schema)

    def meet(b: pa.Table, t: pa.Table) -> pa.Table:
        return pa.table(solve(b, level_of(t)), ["id", "vec", "cell"])

    return src.groupBy("cell").cogroup(tree.groupBy("parent")).applyInArrow(meet, schema)


def cut(rows: DataFrame, over: DataFrame, budget: int, seed: int) -> DataFrame:
    """The children (as tree rows) of the cells over(cell, n), from samples of their rows."""

    def fit(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        x, cell, n = matrix(t["vec"])[order], t["cell"][0].as_py(), t["n"][0].as_py()
        k = max(2, min(FAN - 1, -(-3 * n // (2 * budget))))
        centers = np.unique(lloyd(x, k, 8, seed), axis=0)
        d = (x * x).sum(1)[:, None] + (centers * centers).sum(1) - 2 * x @ centers.T
        hashed = len(centers) < 2 or np.bincount(d.argmin(1)).max() > LOPSIDED * len(x)
        n_children = k if hashed else len(centers)
        cells = [cell * FAN + j for j in range(n_children)]
        vecs = [None] * n_children if hashed else centers.tolist()
        return pa.table([pa.array(cells, pa.int64()), pa.array([cell] * n_children, pa.int64()), pa.array([hashed] * n_children), pa.array(vecs, pa.list_(pa.float64()))], ["cell", "parent", "hashed", "cvec"])

    wanted = F.lit(SAMPLED) * F.least(F.lit(FAN - 1), F.ceil(1.5 * F.col("n") / budget) + 1)
    sample = rows.join(bounded(over, 32), "cell").where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 20)) < wanted / F.col("n") * (1 << 20))
    fitted = written(sample.select("id", "vec", "cell", "n").groupBy("cell").applyInArrow(fit, TREE))
    # a small sample may have missed a cell altogether
    missed = over.join(fitted.select(F.col("parent").alias("cell")).distinct(), "cell", "left_anti")
    dealt = missed.select(F.explode(F.sequence(F.lit(0), F.least(F.lit(FAN - 1), F.ceil(1.5 * F.col("n") / budget)).cast("int"))).alias("j"), "cell")
    return fitted.unionByName(dealt.select((F.col("cell") * FAN + F.col("j")).alias("cell"), F.col("cell").alias("parent"), F.lit(True).alias("hashed"), F.lit(None).cast("array<double>").alias("cvec")))


def empty_tree(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([], TREE)


def grown(rows: DataFrame, tree: DataFrame, budget: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows(id, vec, cell) and the tree once no cell has more rows than the budget)."""
    while True:
        over = written(rows.groupBy("cell").agg(F.count("*").alias("n")).where(F.col("n") > budget))
        if over.isEmpty():
            return rows, tree
        new = written(cut(rows, over, budget, seed))
        rows = written(step(rows, new))
        tree = written(tree.unionByName(new))


def located(df: DataFrame, tree: DataFrame) -> DataFrame:
    """id, vec, cell: the leaf that each row of df(id, vec) descends to."""
    rows = df.where("id is not null and vec is not null").select("id", "vec", F.lit(ROOT).cast("long").alias("cell"))
    at, depth = tree.where(F.col("parent") == ROOT), 0
    while not at.isEmpty():
        rows = step(rows, at)
        depth += 1
        at = tree.where((F.col("parent") >= FAN**depth) & (F.col("parent") < 2 * FAN**depth))
    return rows


def cells(df: DataFrame, budget: int, seed: int = 42) -> tuple[DataFrame, DataFrame]:
    """(rows(id, vec, cell), tree) for df(id, vec)."""
    rows = df.where("id is not null and vec is not null").select("id", "vec", F.lit(ROOT).cast("long").alias("cell"))
    return grown(rows, empty_tree(df.sparkSession), budget, seed)


def centroids(rows: DataFrame) -> DataFrame:
    """center (the cell) and cvec, the mean of each cell's rows."""

    def mean(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        return pa.table([pa.array([t["cell"][0].as_py()], pa.int64()), pa.array([matrix(t["vec"])[order].mean(0).tolist()], pa.list_(pa.float64()))], ["center", "cvec"])

    return rows.groupBy("cell").applyInArrow(mean, "center long, cvec array<double>")
