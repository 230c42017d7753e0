"""Graph index in shards: build and traverse a proximity graph in each shard, queries meet the shards they probe.

A shard has a bounded number of rows (it is a cell of `partition`, or a k-means centre's rows, split by hash where there are too many), so
one task builds it by sequential insertion and later searches it. A query visits the shards of its nearest centres, and the
shards' results are merged. `frontier` searches all shards as one graph.
"""

from collections.abc import Callable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Predicate
from sparkvec.operators.graph import occlusion, pruned, pruned_lists
from sparkvec.operators.knn import BROADCAST, Products, matrix, pair_distances, ranked
from sparkvec.operators.quantization import Coder, closest_centers
from sparkvec.session import bounded, written

#: How far a neighbour list may grow before it is pruned, and the nearest candidates that pruning looks at.
SLACK, CANDIDATES = 1.3, 750
#: Queries times nodes of a shard part whose walks go together; the distance of what has none.
TOGETHER, FARTHEST = 1 << 18, np.finfo(float).max
#: Rows that are inserted together at most; lists times pairs of candidates that are pruned together.
BATCH, PAIRS = 256, 1 << 20
#: Tasks that search all shard parts, at most: each hands on k rows a query.
TASKS = 128
GRAPH = "shard long, part int, id long, entry boolean, nbrs array<long>"
STATS = "qid long, id long, dist double, n_fetch long, n_skip long, n_cmp long"


class Walk(NamedTuple):
    fetched: list[int]
    skipped: int
    compared: int


def walk(start: list[int], near: Callable[[list[int]], np.ndarray], nbrs: list[np.ndarray], pool: int, passes: np.ndarray | None = None, most: int | None = None, k: int | None = None, relaxed: int | None = None) -> Walk:
    """Greedy traversal to a fixed point. near gives the approximate distances of nodes, and is asked once for each that is met.

    With `relaxed`, it ends that many fetches after the k nearest of the pool have all been looked at.

    With `passes`, a node that fails is not fetched, but its first `most` neighbours still enter the pool (tunnelling); most = 0
    leaves it at a dead end.
    """
    first = sorted(set(start))
    seen = set(first)
    held = sorted(zip(near(first).tolist(), first, strict=True))[:pool]
    done: set[int] = set()
    fetched, skipped, compared, settled = [], 0, len(seen), None
    while True:
        at = next((i for _, i in held if i not in done), None)
        if relaxed is not None and settled is None and k is not None and all(i in done for _, i in held[:k]):
            settled = len(fetched)
        if at is None or (settled is not None and len(fetched) >= settled + relaxed):
            return Walk(fetched, skipped, compared)
        done.add(at)
        if passes is not None and not passes[at]:
            skipped += 1
            ahead = nbrs[at][:most]
        else:
            fetched.append(at)
            ahead = nbrs[at]
        new = [int(i) for i in ahead if i not in seen]
        seen.update(new)
        compared += len(new)
        if new:
            held = sorted([*held, *zip(near(new).tolist(), new, strict=True)])[:pool]


def walks(start: list[int], near: Callable[[np.ndarray, np.ndarray], np.ndarray], nbrs: list[np.ndarray], pool: int, queries: int, passes: np.ndarray | None = None, most: int | None = None, k: int | None = None, relaxed: int | None = None) -> list[Walk]:
    """What `walk` gives for each of so many queries, which go one step at a time together: near(query numbers, nodes) gives distances of
    pairs, and is asked once a step for all. passes: (queries, nodes).

    The nearest open node leads unless `pool` nodes before it have been looked at: all that are nearer have been.
    """
    n, width = len(nbrs), max(map(len, nbrs), default=0)
    lists, length = np.zeros((n, width), np.int64), np.array([len(x) for x in nbrs], np.int64)
    for i, x in enumerate(nbrs):
        lists[i, : len(x)] = x
    ahead = np.arange(width)
    first = np.unique(np.array(start, np.int64))
    seen = np.zeros((queries, n + 1), bool)  # the last column takes what is no neighbour
    open_ = np.full((queries, n), np.inf)
    q, at = np.repeat(np.arange(queries), len(first)), np.tile(first, queries)
    seen[q, at] = True
    open_[q, at] = np.fmin(near(q, at), FARTHEST)
    fetched: list[list[int]] = [[] for _ in range(queries)]
    skipped, compared = np.zeros(queries, np.int64), np.full(queries, len(first), np.int64)
    settled = np.full(queries, -1)
    done_dist, done_node, steps = np.full((queries, pool), np.inf), np.zeros((queries, pool), np.int64), 0
    live = np.arange(queries)
    while len(live) and n:
        every = len(live) == queries
        lead = (open_ if every else open_[live]).argmin(1)  # the least number among equals
        dist = open_[live, lead]
        before = np.zeros(len(live), np.int64)
        if steps >= min(pool, k or pool):  # fewer steps than that end no walk
            d, at = (done_dist[:, :steps], done_node[:, :steps]) if every else (done_dist[live, :steps], done_node[live, :steps])
            before = ((d < dist[:, None]) | ((d == dist[:, None]) & (at < lead[:, None]))).sum(1)
        going = np.isfinite(dist) & (before < pool)
        if relaxed is not None and k is not None:
            held = np.minimum(np.minimum(compared[live], pool), k)
            now = (settled[live] < 0) & ((before >= held) | ~going)
            n_fetched = np.array([len(fetched[i]) for i in live])
            settled[live[now]] = n_fetched[now]
            going &= ~((settled[live] >= 0) & (n_fetched >= settled[live] + relaxed))
        live, lead, dist = live[going], lead[going], dist[going]
        if not len(live):
            break
        if steps == done_dist.shape[1]:
            done_dist = np.concatenate([done_dist, np.full((queries, pool), np.inf)], 1)
            done_node = np.concatenate([done_node, np.zeros((queries, pool), np.int64)], 1)
        done_dist[live, steps], done_node[live, steps] = dist, lead
        steps += 1
        open_[live, lead] = np.inf
        passing = np.ones(len(live), bool) if passes is None else passes[live, lead]
        for i, at_ in zip(live[passing].tolist(), lead[passing].tolist(), strict=True):
            fetched[i].append(at_)
        skipped[live[~passing]] += 1
        upto = length[lead] if most is None else np.where(passing, length[lead], np.minimum(length[lead], most))
        new = np.where(ahead < upto[:, None], lists[lead], n)
        row, col = np.nonzero(~seen[live[:, None], new] & (new < n))
        q, at = live[row], new[row, col]
        if len(q):
            seen[q, at] = True
            compared += np.bincount(q, minlength=queries)
            open_[q, at] = np.fmin(near(q, at), FARTHEST)
    return [Walk(fetched[i], int(skipped[i]), int(compared[i])) for i in range(queries)]


def rounds(near: np.ndarray, start: list[int], lists: np.ndarray, pool: int, beam: int, passes: np.ndarray | None = None, most: int | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(followed, met), masks of (queries, nodes): walks like those of `walk` that follow the `beam` nearest open members of their pool a
    round, so that a block of queries ends within few rounds; a walk ends when its whole pool has been followed.

    near: (queries, nodes). lists: (nodes, neighbours), filled up with the number of nodes. passes: (queries, nodes); a node that fails
    is followed by its first `most` neighbours only. Of equal distances at an end all count.
    """
    queries, n = near.shape
    near, far = np.minimum(near, np.finfo(np.float32).max).astype(np.float32), np.float32(np.inf)
    held = np.full((queries, n + 1), far)  # of what was met; the last column takes what is no neighbour
    first = np.unique(np.array(start, np.int64))
    held[:, first] = near[:, first]
    open_ = held[:, :n].copy()  # of what was met and not followed
    short = lists if most is None else np.where(np.arange(lists.shape[1]) < most, lists, n)
    live = np.arange(queries if n else 0)
    while len(live):
        every = len(live) == queries
        mine = open_ if every else open_[live]
        upto = np.partition(mine, beam - 1, 1)[:, beam - 1] if n > beam else np.full(len(live), far)
        if n > pool:
            upto = np.minimum(upto, np.partition(held if every else held[live], pool - 1, 1)[:, pool - 1])
        at = np.flatnonzero(mine <= np.minimum(upto, np.finfo(np.float32).max)[:, None])
        q, at = at // n, at % n
        going = np.bincount(q, minlength=len(live)) > 0
        q, live = live[q], live[going]
        open_.ravel()[q * n + at] = far
        ahead = lists[at] if passes is None or most is None else np.where(passes[q, at][:, None], lists[at], short[at])
        at = (q * (n + 1))[:, None] + ahead
        new = np.flatnonzero((held.ravel()[at] == far) & (ahead < n))
        at, ahead, q = at.ravel()[new], ahead.ravel()[new], np.repeat(q, lists.shape[1])[new] if len(new) else q[:0]
        held.ravel()[at] = open_.ravel()[q * n + ahead] = near.ravel()[q * n + ahead]
    met = held[:, :n] < far
    return met & (open_ == far), met


def padded(nbrs: list[np.ndarray]) -> np.ndarray:
    """Lists as rows of equal length, filled up with their number."""
    length = np.array([len(x) for x in nbrs], np.int64)
    out = np.full((len(nbrs), length.max(initial=0)), len(nbrs))
    out[np.arange(out.shape[1]) < length[:, None]] = np.concatenate([np.zeros(0, np.int64), *nbrs])
    return out


class Shard:
    """Vectors of one shard part and their neighbours, changed in place. Nodes are numbers of rows."""

    def __init__(self, x: np.ndarray, nbrs: list[np.ndarray], metric: str, degree: int, pool: int, alpha: float, candidates: int):
        self.x, self.nbrs, self.metric, self.degree, self.pool, self.alpha, self.candidates = x, nbrs, metric, degree, pool, alpha, candidates
        self.sq = (x * x).sum(1)
        self.computed = 0  # distances of pruning

    def dist(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Between rows by number; as one matrix product, since building needs no bit-equal sums."""
        products = self.x[a] @ self.x[b].T
        return np.maximum(self.sq[a][:, None] + self.sq[b] - 2 * products, 0) if self.metric == "l2" else 1 - products

    def cut(self, i: int, others: np.ndarray) -> np.ndarray:
        """What pruning leaves of the candidates."""
        others = np.unique(others[others != i])
        d = self.dist(np.array([i]), others)[0]
        order = np.lexsort((others, d))[: self.candidates]
        others, d = others[order], d[order]
        self.computed += len(others) ** 2
        return others[pruned(d, self.dist(others, others), self.degree, self.alpha, self.metric, fill=True)]

    def insert(self, i: int, entry: int) -> None:
        """Search for the row from the entry, prune what was looked at, and link back."""
        at = np.array([i])
        found = walk([entry], lambda some: self.dist(at, np.array(some, int))[0], self.nbrs, self.pool).fetched if i != entry else []
        self.nbrs[i] = self.cut(i, np.array(found, int))
        for j in self.nbrs[i]:
            back = np.append(self.nbrs[j], i)
            self.nbrs[j] = self.evicted(int(j), i) if len(back) > SLACK * self.degree else back

    def evicted(self, j: int, i: int) -> np.ndarray:
        """A full list of j with i in one place of it, from distances of the list to j and to i alone.

        If a nearer member hides i by the slack, the list stays. Otherwise the member that i hides most makes room, or the
        farthest of all, i among them, where i hides none.
        """
        mine = self.nbrs[j]
        to_j, to_i = self.dist(np.array([j, i]), np.append(mine, i))
        self.computed += 2 * len(mine) + 1
        new, to_j, to_i = to_j[-1], to_j[:-1], to_i[:-1]
        if (occlusion(self.metric, np.full(len(mine), new), to_i)[to_j < new] > self.alpha).any():
            return mine
        hides = np.where(to_j > new, occlusion(self.metric, to_j, to_i), 0.0)
        out = int(hides.argmax()) if hides.max(initial=0) > self.alpha else int(to_j.argmax()) if to_j.max() > new else -1
        if out < 0:
            return mine
        mine = mine.copy()
        mine[out] = i
        return mine

    def delete(self, gone: np.ndarray) -> None:
        """Neighbours that go (a mask) are replaced by their own that stay; what is too long is pruned."""
        for i in np.flatnonzero(~gone):
            mine = self.nbrs[i]
            lost = mine[gone[mine]]
            if len(lost):
                ahead = np.concatenate([mine, *(self.nbrs[j] for j in lost)])
                ahead = np.unique(ahead[~gone[ahead]])
                ahead = ahead[ahead != i]
                self.nbrs[i] = self.cut(int(i), ahead) if len(ahead) > self.degree else ahead

    def trimmed(self) -> list[np.ndarray]:
        return [n if len(n) <= self.degree else self.cut(i, n) for i, n in enumerate(self.nbrs)]


def medoid_of(x: np.ndarray) -> int:
    return int(((x - x.mean(0)) ** 2).sum(1).argmin()) if len(x) else 0


class Growing:
    """Rows that get their neighbours batch by batch, in the order in which they come. Lists are filled up with the number of rows."""

    def __init__(self, x: np.ndarray, metric: str, degree: int, alpha: float, candidates: int):
        self.x, self.metric, self.degree, self.alpha, self.candidates = x, metric, degree, alpha, candidates
        self.sq = (x * x).sum(1)
        self.lists = np.full((len(x), max(degree, int(SLACK * degree))), len(x))

    def dist(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Of rows a to rows b, or of each list of a to the same list of b where these are lists of rows."""
        products = self.x[a] @ np.swapaxes(self.x[b], -1, -2)
        return np.maximum(self.sq[a][..., None] + self.sq[b][..., None, :] - 2 * products, 0) if self.metric == "l2" else 1 - products

    def cut(self, rows: np.ndarray, some: np.ndarray) -> np.ndarray:
        """What pruning leaves of each row's candidates, nearest first; both are filled up with the number of rows."""
        n = len(self.x)
        out = np.full((len(rows), self.degree), n)
        width = (some < n).sum(1)
        order = np.argsort(width, kind="stable")
        at = 0
        while at < len(rows):
            wide = max(1, int(width[order[min(len(rows), at + max(1, PAIRS // max(1, int(width[order[at]])) ** 2)) - 1]]))
            mine = order[at : at + max(1, PAIRS // wide**2)]
            at += len(mine)
            cand = np.sort(some[mine], 1)[:, : max(1, int(width[mine].max()))]
            known = np.minimum(cand, n - 1)
            d = np.where(cand < n, self.dist(rows[mine, None], known)[:, 0], np.inf)
            near = np.argsort(d, 1, kind="stable")[:, : self.candidates]
            d, cand, known = (np.take_along_axis(v, near, 1) for v in (d, cand, known))
            stay = pruned_lists(d, self.dist(known, known), self.degree, self.alpha, self.metric, fill=True)
            r, c = np.nonzero(stay)
            out[mine[r], np.arange(len(r)) - np.searchsorted(r, r)] = cand[r, c]
        return out

    def insert(self, at: int, to: int, pool: int) -> None:
        """The rows from `at` to `to`, by one search of all from row 0; rows of the batch that a pool would have held are candidates, too."""
        new = np.arange(at, to)
        near = self.dist(new, np.arange(to))
        followed, _ = rounds(near[:, :at], [0], np.minimum(self.lists[:at], at), pool, max(1, pool // 4))
        found = np.where(followed, near[:, :at], np.inf)
        last = np.partition(found, pool - 1, 1)[:, pool - 1] if at > pool else np.full(len(new), np.inf)
        mates = near[:, at:] <= last[:, None]
        np.fill_diagonal(mates, False)
        self.lists[new, : self.degree] = self.cut(new, self.filled(np.concatenate([followed, mates], 1)))
        self.link(new)

    def filled(self, mask: np.ndarray) -> np.ndarray:
        """The numbers of what is set in each row."""
        r, c = np.nonzero(mask)
        place = np.arange(len(r)) - np.searchsorted(r, r)
        out = np.full((len(mask), 1 + place.max(initial=0)), len(self.x))
        out[r, place] = c
        return out

    def link(self, new: np.ndarray) -> None:
        """Enter the new rows in their neighbours' lists, and prune what is too long then."""
        n, width = self.lists.shape  # n fills up
        i, col = np.nonzero(self.lists[new] < n)
        src, dst = new[i], self.lists[new[i], col]
        fresh = ~(self.lists[dst] == src[:, None]).any(1)
        order = np.lexsort((src[fresh], dst[fresh]))
        src, dst = src[fresh][order], dst[fresh][order]
        of, count = np.unique(dst, return_counts=True)
        place = np.arange(len(dst)) - np.searchsorted(dst, dst)
        length = (self.lists[of] < n).sum(1)
        row = np.searchsorted(of, dst)
        fits = length + count <= width
        ok = fits[row]
        self.lists[dst[ok], (length[row] + place)[ok]] = src[ok]
        full = np.flatnonzero(~fits)
        if len(full):
            some = np.full((len(of), width + count[full].max()), n)
            some[:, :width] = self.lists[of]
            some[row[~ok], width + place[~ok]] = src[~ok]
            self.lists[of[full]] = n
            self.lists[of[full], : self.degree] = self.cut(of[full], some[full])

    def trimmed(self) -> np.ndarray:
        """All lists, nearest first, and none longer than the degree."""
        n = len(self.x)
        return np.concatenate([np.full((0, self.degree), n), *(self.cut(rows, self.lists[rows]) for rows in np.array_split(np.arange(n), -(-n // 1024)))]) if n else self.lists


def build(x: np.ndarray, metric: str, degree: int, pool: int, alpha: float, candidates: int = CANDIDATES) -> tuple[int, list[np.ndarray]]:
    """Entry point (the medoid) and neighbours, nearest first, by inserting rows in batches that double in size: search, prune, link back."""
    n, entry = len(x), medoid_of(x)
    order = np.concatenate([np.arange(n) == entry, np.arange(n) != entry]).nonzero()[0] % max(1, n)
    g, at = Growing(x[order], metric, degree, alpha, candidates), 1
    while at < n:
        to = min(n, at + min(at, BATCH))
        g.insert(at, to, pool)
        at = to
    nbrs = {int(order[i]): order[mine[mine < n]] for i, mine in enumerate(g.trimmed())}
    return entry, [nbrs[i] for i in range(n)]


def shards(df: DataFrame, centers: DataFrame, copies: int, most_rows: int) -> DataFrame:
    """id, shard and part: each row in its nearest centres' shards, large shards in parts by hash."""
    of = closest_centers(df, centers, copies).select("id", F.col("center").alias("shard"))
    return parted(of, of.groupBy("shard").agg(F.ceil(F.count("*") / F.lit(most_rows)).cast("int").alias("parts")))


def members(rows: DataFrame, centers: DataFrame, copies: int, most_rows: int) -> DataFrame:
    """id, shard and part 0 of rows(id, vec, cell): each row is in its cell, and in its nearest other cells as far as these have room."""
    own = rows.select("id", F.col("cell").alias("shard"), F.lit(0).alias("rk"))
    near = closest_centers(rows, centers, copies).select("id", F.col("center").alias("shard"), "rk")
    near = near.join(own.select("id", "shard"), ["id", "shard"], "left_anti")
    place = F.row_number().over(W.partitionBy("shard").orderBy("rk", "id"))
    every = own.unionByName(near).withColumn("place", place)
    return every.where(F.col("place") <= most_rows).select("id", "shard", F.lit(0).alias("part"))


def parted(of: DataFrame, parts: DataFrame) -> DataFrame:
    """id, shard, part of rows of(id, shard) in shards with that many parts; a shard that had no rows has one."""
    out = of.join(bounded(parts, 32), "shard", "left")
    return out.select("id", "shard", F.pmod(F.xxhash64("id"), F.coalesce("parts", F.lit(1))).cast("int").alias("part"))


def build_graph(df: DataFrame, assigned: DataFrame, metric: str = "l2", degree: int = 32, pool: int = 64, alpha: float = 1.2, candidates: int = CANDIDATES) -> DataFrame:
    """shard, part, id, entry (whether a walk starts here) and nbrs, all within one shard part."""

    def solve(t: pa.Table) -> pa.Table:
        order = np.argsort(t["id"].to_numpy(), kind="stable")
        t = t.take(pa.array(order))
        ids = t["id"].to_numpy()
        entry, nbrs = build(matrix(t["vec"]), metric, degree, pool, alpha, candidates)
        return pa.table([t["shard"], t["part"], t["id"], pa.array(np.arange(len(ids)) == entry), pa.array([ids[n].tolist() for n in nbrs], pa.list_(pa.int64()))], ["shard", "part", "id", "entry", "nbrs"])

    rows = assigned.join(df.select("id", "vec"), "id").select("shard", "part", "id", "vec")
    return rows.groupBy("shard", "part").applyInArrow(solve, GRAPH)


def changed(graph: DataFrame, rows: DataFrame, gone: DataFrame, new: DataFrame, metric: str, degree: int, pool: int, alpha: float, candidates: int = CANDIDATES) -> DataFrame:
    """The graph without the nodes gone(id) and with new(id, shard, part); rows(id, fresh, vec) has the vectors of old and new ones.

    Only the shard parts that hold one of these are read and written anew: deleted neighbours are replaced by their own, then the
    new rows are inserted one after another. All other parts stay as they are.
    """
    lost = graph.join(gone.select("id").distinct(), "id", "left_semi").select("shard", "part")
    touched = written(lost.unionByName(new.select("shard", "part")).distinct())
    still = graph.join(bounded(touched, 32), ["shard", "part"], "left_anti")
    old = graph.join(bounded(touched, 32), ["shard", "part"], "left_semi")
    old = old.join(gone.select("id", F.lit(True).alias("gone")).distinct(), "id", "left").select("shard", "part", "id", "entry", "nbrs", F.coalesce("gone", F.lit(False)).alias("gone"), F.lit(False).alias("fresh"))
    fresh = new.select("shard", "part", "id", F.lit(False).alias("entry"), F.array().cast("array<long>").alias("nbrs"), F.lit(False).alias("gone"), F.lit(True).alias("fresh"))
    every = old.unionByName(fresh).join(rows.select("id", "fresh", "vec"), ["id", "fresh"], "left")

    def solve(t: pa.Table) -> pa.Table:
        # an id that is replaced is there twice: the old node goes, the new one stays
        t = t.filter(pc.is_valid(t["vec"]))
        fresh = t["fresh"].to_numpy()
        order = np.lexsort((fresh, t["id"].to_numpy()))
        t, fresh = t.take(pa.array(order)), fresh[order]
        ids, gone = t["id"].to_numpy(), t["gone"].to_numpy()
        x = matrix(t["vec"])
        at = {int(v): i for i, v in enumerate(ids) if not fresh[i]}
        nbrs = [np.array([at[v] for v in n if v in at], int) for n in t["nbrs"].to_pylist()]
        g = Shard(x, nbrs, metric, degree, pool, alpha, candidates)
        g.delete(gone)
        live = np.flatnonzero(~gone)
        if not len(live):
            return pa.table([pa.array([], f.type) for f in schema], schema=schema)
        was = np.flatnonzero(t["entry"].to_numpy() & ~gone)
        old = live[~fresh[live]]
        entry = int(was[0]) if len(was) else int(old[medoid_of(x[old])]) if len(old) else int(live[medoid_of(x[live])])
        for i in live[fresh[live]]:
            g.insert(int(i), entry)
        nbrs = g.trimmed()
        cols = [t["shard"].take(pa.array(live)), t["part"].take(pa.array(live)), pa.array(ids[live]), pa.array(live == entry), pa.array([ids[nbrs[i]].tolist() for i in live], pa.list_(pa.int64()))]
        return pa.table(cols, schema=schema)

    schema = pa.schema([("shard", pa.int64()), ("part", pa.int32()), ("id", pa.int64()), ("entry", pa.bool_()), ("nbrs", pa.list_(pa.int64()))])
    return still.select("shard", "part", "id", "entry", "nbrs").unionByName(every.groupBy("shard", "part").applyInArrow(solve, GRAPH))


class Best:
    """Each query's k nearest of what is added, ties by id; an id counts once."""

    def __init__(self, queries: int, k: int):
        self.k, self.dist, self.ids = k, np.full((queries, k), np.inf), np.zeros((queries, k), np.int64)

    def add(self, of: np.ndarray, ids: np.ndarray, dist: np.ndarray) -> None:
        near = dist <= self.dist[of, -1]
        touched = np.unique(of[near])
        of = np.concatenate([np.repeat(touched, self.k), of[near]])
        ids = np.concatenate([self.ids[touched].ravel(), ids[near]])
        dist = np.concatenate([self.dist[touched].ravel(), dist[near]])
        order = np.lexsort((ids, dist, of))
        order = order[np.isfinite(dist[order])]
        of, ids, dist = of[order], ids[order], dist[order]
        new = np.ones(len(of), bool)
        new[1:] = (of[1:] != of[:-1]) | (ids[1:] != ids[:-1])
        of, ids, dist = of[new], ids[new], dist[new]
        place = np.arange(len(of)) - np.searchsorted(of, of)
        of, ids, dist, place = (v[place < self.k] for v in (of, ids, dist, place))
        self.dist[touched] = np.inf
        self.ids[of, place], self.dist[of, place] = ids, dist

    def rows(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Query numbers, ids and distances."""
        of, place = np.nonzero(np.isfinite(self.dist))
        return of, self.ids[of, place], self.dist[of, place]


def whole_parts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.Table]:
    """One table for each shard part, of batches in order of shard and part."""
    held: list[pa.RecordBatch] = []
    for b in batches:
        shard, part = b.column("shard").to_numpy(), b.column("part").to_numpy()
        ends = [*(np.flatnonzero((shard[1:] != shard[:-1]) | (part[1:] != part[:-1])) + 1).tolist(), b.num_rows] if b.num_rows else []
        at = 0
        for end in ends:
            piece = b.slice(at, end - at)
            if held and (held[0].column("shard")[0], held[0].column("part")[0]) != (piece.column("shard")[0], piece.column("part")[0]):
                yield pa.Table.from_batches(held).combine_chunks()
                held = []
            held.append(piece)
            at = end
    if held:
        yield pa.Table.from_batches(held).combine_chunks()


def search(nodes: DataFrame, queries: DataFrame, centers: DataFrame, k: int, pool: int, where: Predicate, book: Coder | None = None, gate: bool = True, store: int = 32, probes: int = 2, metric: str = "l2", with_self: bool = False, relaxed: int | None = None, beam: int | None = None) -> tuple[DataFrame, DataFrame]:
    """(qid, id, dist, rk; per query n_fetch, n_skip, n_cmp).

    nodes: shard, part, id, vec, entry, nbrs, the predicate's columns, and codes if there is a codebook. gate: failing nodes are not
    fetched, only tunnelled through by their first `store` neighbours; otherwise results are filtered at the end. A walk follows the `beam`
    nearest open members of its pool a round (a quarter of the pool if not given), or one at a time with `relaxed`.

    Queries of a counted size below BROADCAST go to all tasks, which hand on each query's k best of all their parts; more of them meet
    the parts that they probe in a cogroup.
    """
    beam = beam or max(8, pool // 4)
    queries = queries.where("qid is not null and qvec is not null")
    asked = closest_centers(queries.select(F.col("qid").alias("id"), F.col("qvec").alias("vec")), centers, probes).select(F.col("id").alias("qid"), F.col("center").alias("shard"))
    asked = written(asked)
    columns = ["qid", "qvec", *where.query_columns]
    held = nodes.sparkSession.sparkContext.broadcast(book)
    stats_schema = pa.schema([("qid", pa.int64()), ("id", pa.int64()), ("dist", pa.float64()), ("n_fetch", pa.int64()), ("n_skip", pa.int64()), ("n_cmp", pa.int64())])

    def walked(t: pa.Table, q: pa.Table) -> Iterator[tuple]:
        """For blocks of queries over one shard part: where the block starts, query numbers, ids and distances of what was found, and counts a query."""
        base = t.combine_chunks().to_batches()[0]
        ids, x = t["id"].to_numpy(), matrix(t["vec"])
        order = np.argsort(ids)
        known = ids[order]
        nbrs = t["nbrs"].combine_chunks()
        to = np.asarray(nbrs.flatten())
        node = np.searchsorted(known, to)
        there = (node < len(ids)) & (known[np.minimum(node, len(ids) - 1)] == to)
        of = np.repeat(np.arange(len(ids)), np.asarray(pc.list_value_length(nbrs)))[there]
        nbrs = np.split(order[node[there]], np.cumsum(np.bincount(of, minlength=len(ids)))[:-1])
        lists = padded(nbrs)
        start = np.flatnonzero(t["entry"].to_numpy(zero_copy_only=False)).tolist()
        codes = matrix(t["codes"]).astype(int) if held.value is not None else None
        step = max(1, TOGETHER // len(ids))
        for n in range(0, q.num_rows, step):
            yield n, *block(q.slice(n, step), base, ids, x, nbrs, lists, start, codes)

    def block(q: pa.Table, base: pa.RecordBatch, ids: np.ndarray, x: np.ndarray, nbrs: list[np.ndarray], lists: np.ndarray, start: list[int], codes: np.ndarray | None) -> tuple:
        qids, qx, mask = q["qid"].to_numpy(), matrix(q["qvec"]), where.mask(base, q)
        passes = mask if gate else None
        if relaxed is not None:
            score = held.value.paired(qx, "l2" if metric == "l2" else "ip") if codes is not None else None
            found = walks(start, lambda some, at: pair_distances(metric, qx[some], x[at]) if score is None else score(some, codes[at]), nbrs, pool, len(qids), passes, store, k, relaxed)
            of, got = np.repeat(np.arange(len(qids)), [len(w.fetched) for w in found]), np.array([i for w in found for i in w.fetched], np.int64)
            counts = np.array([(len(w.fetched), w.skipped, w.compared) for w in found], np.int64)
        else:
            every = np.arange(len(qids))
            near = Products(qx, x, metric).distances(every, np.arange(len(ids))) if codes is None else held.value.scorer(qx, "l2" if metric == "l2" else "ip")(every, codes)
            followed, met = rounds(near, start, lists, pool, beam, passes, store)
            fetched = followed if passes is None else followed & passes
            of, got = np.nonzero(fetched)
            n_fetch = fetched.sum(1)
            counts = np.stack([n_fetch, followed.sum(1) - n_fetch, met.sum(1)], 1)
        right = np.ones(len(of), bool) if mask is None else mask[of, got]
        right &= with_self | (ids[got] != qids[of])
        of, got = of[right], got[right]
        return of, ids[got], pair_distances(metric, qx[of], x[got]), counts

    def handed(q: np.ndarray, best: Best, counts: np.ndarray) -> pa.RecordBatch:
        """A row of each query's counts, then what was found."""
        of, ids, dist = best.rows()
        empty = np.concatenate([np.ones(len(q), bool), np.zeros(len(of), bool)])
        cols = [np.concatenate([q, q[of]]), np.concatenate([np.zeros(len(q), np.int64), ids]), np.concatenate([np.zeros(len(q)), dist]), *np.concatenate([counts, np.zeros((len(of), 3), np.int64)]).T]
        return pa.record_batch([pa.array(np.ascontiguousarray(c), f.type, mask=empty if f.name in ("id", "dist") else None) for c, f in zip(cols, stats_schema, strict=True)], schema=stats_schema)

    def solve(t: pa.Table, q: pa.Table) -> pa.Table:
        best, counts = Best(q.num_rows, k), np.zeros((q.num_rows, 3), np.int64)
        if t.num_rows and q.num_rows:
            for at, of, ids, dist, more in walked(t, q):
                best.add(at + of, ids, dist)
                counts[at : at + len(more)] += more
        return pa.Table.from_batches([handed(q["qid"].to_numpy() if t.num_rows else np.zeros(0, np.int64), best, counts if t.num_rows else counts[:0])])

    parts = written(nodes.select("shard", "part").distinct())
    nodes = nodes.join(bounded(asked.select("shard").distinct(), 16), "shard", "left_semi")  # before any vector is shuffled
    n, dim = queries.agg(F.count("*"), F.coalesce(F.max(F.size("qvec")), F.lit(0))).first()
    if n * (8 * dim + 16 * probes + 64) <= BROADCAST:
        to = asked.groupBy("qid").agg(F.collect_set("shard").alias("shards"))
        asking = nodes.sparkSession.sparkContext.broadcast(queries.select(*columns).join(to, "qid").toArrow().combine_chunks())

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            q = asking.value.drop_columns("shards")
            lists = asking.value["shards"].combine_chunks()
            shard, row = np.asarray(lists.flatten()), np.repeat(np.arange(len(lists)), np.asarray(pc.list_value_length(lists)))
            best, counts, asked_here = Best(q.num_rows, k), np.zeros((q.num_rows, 3), np.int64), np.zeros(q.num_rows, bool)
            for t in whole_parts(batches):
                mine = row[shard == t["shard"][0].as_py()]
                asked_here[mine] = True
                for at, of, ids, dist, more in walked(t, q.take(pa.array(mine))):
                    best.add(mine[at + of], ids, dist)
                    counts[mine[at : at + len(more)]] += more
            some = np.flatnonzero(asked_here)
            best.dist, best.ids = best.dist[some], best.ids[some]
            yield handed(q["qid"].to_numpy()[some], best, counts[some])

        found = nodes.repartition(max(1, min(TASKS, parts.count())), "shard", "part").sortWithinPartitions("shard", "part", "id").mapInArrow(run, STATS)
    else:
        meeting = asked.join(bounded(parts, 32), "shard").join(queries, "qid").select(*columns, F.col("shard").alias("to_shard"), F.col("part").alias("to_part"))
        found = nodes.groupBy("shard", "part").cogroup(meeting.groupBy("to_shard", "to_part")).applyInArrow(solve, STATS)
    found = written(found)
    results = found.where("id is not null").groupBy("qid", "id").agg(F.min("dist").alias("dist"))
    stats = found.where("id is null").groupBy("qid").agg(*(F.sum(c).alias(c) for c in ("n_fetch", "n_skip", "n_cmp")))
    return ranked(results, k), stats
