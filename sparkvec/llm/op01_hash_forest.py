"""Approximate nearest neighbours by a forest of hash prefixes.

Rows are dealt at random to shards. In each shard, every tree has its own sequence of random hyperplanes, whose sides make a
64-bit hash string per vector; the tree is the sorted array of those strings. A query descends in each tree, by binary search,
to its longest common prefix, of whatever length the data there gives. From the longest match of all trees the search then
ascends in all trees together, one bit at a time: each step widens the ranges that share the prefix, and scores the rows that
are new by their cosine on the original vectors.

The ascent of a query ends at prefix length x when a row at least as near as its current k-th would have shared x bits in one
of the trees with probability 1 - `miss`, so easy data end deep in the trees and hard data go on, to the root if need be:
there is no cap on candidates. Every row is indexed, nothing is fitted. Shards' results are merged exactly.

Vectors that are null, empty, zero, or hold null or non-finite components, and rows without id take no part. Vectors only
meet others of the same length. A query's own id is no candidate; rows that repeat an id are candidates of their own, and a
repeated query id is searched once, with its smallest vector. An empty table gives an empty result.
"""

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import written
from sparkvec.llm.vectors import matrix, merged, usable
from sparkvec.session import table

TREES, BITS, SHARD_ROWS, QUERY_BLOCK, MISS = 32, 64, 2048, 2048, 0.04
FOUND = "query_id long, vec_id long, score double"


def hash_strings(x: np.ndarray, trees: int, seed: int) -> np.ndarray:
    """(trees, rows) of 64-bit strings, the first plane in the highest bit."""
    planes = np.random.default_rng([seed, x.shape[1]]).standard_normal((x.shape[1], trees * BITS))
    sides = (x @ planes > 0).reshape(len(x), trees, BITS // 8, 8)
    return np.packbits(sides, axis=-1)[..., 0].copy().view(">u8")[..., 0].astype(np.uint64).T


class Forest:
    """The trees of one shard."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, trees: int, seed: int):
        order = np.argsort(ids, kind="stable")
        self.ids, self.x, self.seed = ids[order], x[order], seed
        self.norms = np.sqrt((self.x * self.x).sum(1))
        keys = hash_strings(self.x, trees, seed)
        self.order = np.argsort(keys, axis=1, kind="stable")
        self.keys = np.take_along_axis(keys, self.order, 1)

    def ranges(self, keys: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For every prefix length the ranges (trees, queries) that share it, until none is shared."""
        lows, highs = [], []
        for x in range(BITS + 1):
            rest = np.uint64((1 << (BITS - x)) - 1)
            low = np.stack([np.searchsorted(s, k & ~rest, "left") for s, k in zip(self.keys, keys, strict=True)])
            high = np.stack([np.searchsorted(s, k | rest, "right") for s, k in zip(self.keys, keys, strict=True)])
            lows.append(low)
            highs.append(high)
            if not (high > low).any():
                break
        return lows, highs

    def search(self, query_ids: np.ndarray, q: np.ndarray, k: int, miss: float) -> tuple[list, list, list, int]:
        trees = len(self.keys)
        lows, highs = self.ranges(hash_strings(q, trees, self.seed))
        shared = np.stack([(h > lo).any(0) for lo, h in zip(lows, highs, strict=True)])
        deepest = len(lows) - 1 - np.argmax(shared[::-1], axis=0)
        norms = np.sqrt((q * q).sum(1))
        scored, out = 0, ([], [], [])
        for i, query in enumerate(query_ids):
            seen = self.ids == query
            at, best = np.zeros(0, np.int64), np.zeros(0)
            for x in range(int(deepest[i]), -1, -1):
                near = np.zeros(len(seen), bool)
                if x == 0:
                    near[:] = True
                else:
                    low, high = lows[x][:, i], highs[x][:, i]
                    for t in np.flatnonzero(high > low):
                        near[self.order[t, low[t] : high[t]]] = True
                new = np.flatnonzero(near & ~seen)
                if len(new):
                    seen[new] = True
                    scored += len(new)
                    at, best = np.concatenate([at, new]), np.concatenate([best, (self.x[new] @ q[i]) / (self.norms[new] * norms[i])])
                    first = np.lexsort((at, -best))[:k]
                    at, best = at[first], best[first]
                if len(at) == k:
                    same = 1 - np.arccos(np.clip(best[-1], -1, 1)) / np.pi
                    if (1 - same**x) ** trees <= miss:
                        break
            out[0].extend([query] * len(at))
            out[1].extend(self.ids[at])
            out[2].extend(best)
        return *out, scored


def search(rows: DataFrame, is_query: Column, k: int, trees: int = TREES, miss: float = MISS, shard_rows: int = SHARD_ROWS, query_block: int = QUERY_BLOCK, seed: int = 11) -> DataFrame:
    """query_id, rank, vec_id and score of the k nearest found; rows come from `usable`, is_query picks queries by `key`."""
    rows = written(rows)
    queries = rows.where(is_query).groupBy("key", "dim").agg(F.min("v").alias("v"))
    n_shards = max(1, -(-rows.count() // shard_rows))
    n_blocks = max(1, -(-queries.count() // query_block))

    def each(n: int) -> Column:
        return F.explode(F.sequence(F.lit(0), F.lit(n - 1)))

    def part(name: str, n: int) -> Column:
        return F.pmod(F.xxhash64("key", F.lit(name)), F.lit(n)).cast("int")

    data = rows.select("dim", part("shard", n_shards).alias("shard"), each(n_blocks).alias("block"), "key", "v")
    queries = queries.select("dim", each(n_shards).alias("shard"), part("block", n_blocks).alias("block"), "key", "v")

    def solve(left: pa.Table, right: pa.Table) -> pa.Table:
        if left.num_rows == 0 or right.num_rows == 0:
            return pa.table([pa.array([], t) for t in (pa.int64(), pa.int64(), pa.float64())], ["query_id", "vec_id", "score"])
        dim = left["dim"][0].as_py()
        forest = Forest(left["key"].to_numpy(), matrix(left["v"], dim), trees, seed)
        ids, found, score, _ = forest.search(right["key"].to_numpy(), matrix(right["v"], dim), k, miss)
        return pa.table([pa.array(ids, pa.int64()), pa.array(found, pa.int64()), pa.array(score, pa.float64())], ["query_id", "vec_id", "score"])

    by = ["dim", "shard", "block"]
    return merged(data.groupBy(*by).cogroup(queries.groupBy(*by)).applyInArrow(solve, FOUND), k)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The 5 nearest by cosine of every row of embeddings whose vec_id is divisible by 50."""
    rows = usable(table(spark, sf_dir, "embeddings"), "vec_id", "embedding", zero=False)
    return search(rows, F.col("key") % 50 == 0, 5)
