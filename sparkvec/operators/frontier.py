"""Graph search that reads what it visits: all queries go one step at a time through a table of nodes that is laid out by cell.

The shards' graphs are merged into one, and nodes are written in two tiers, one folder for each cell of `partition`: narrow rows (neighbours with
their cells, codes and attributes) and wide rows (vectors). A round takes each query's next few pool members and reads their narrow rows,
which say all that is needed of their neighbours: those that the query has met before are left out, the others get a distance and compete
for its pool. A query is one row, which keeps ids and distances, and meets what a round has read for it in one cogroup. The wide rows of the
nearest met nodes that satisfy the predicate are read last. Neither tier is listed or scanned as a whole.

A search starts from the rows of a bounded sample that are nearest to the query, both of all and of those that satisfy its predicate.
"""

from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.functions.predicates import Predicate
from sparkvec.functions.vector import distance
from sparkvec.operators.knn import knn, matrix, ranked
from sparkvec.operators.quantization import Coder
from sparkvec.session import BROADCAST_BYTES, bounded, written

#: Rows of the sample that searches start from, at most.
SAMPLE = 20_000
#: Queries that one task takes a round further, and groups of queries at least.
TOGETHER, GROUPS = 256, 16
#: What a query keeps: the ids it has met, in order, and by distance its pool and the nearest nodes that pass. Members of a turn are followed
#: in the next round, those that are near are read at the end.
STATE = "met array<long>, ids array<long>, cells array<long>, dist array<double>, passes array<boolean>, done array<boolean>, turn array<boolean>, near array<boolean>"


class Paged(NamedTuple):
    """Folders `narrow` (id, codes, attributes, nbrs with all of that of neighbours) and `wide` (id, vec) with one folder a cell, and the sampled rows."""

    at: str
    narrow_schema: str
    wide_schema: str
    sample: DataFrame

    def read(self, spark: SparkSession, tier: str, keys: DataFrame) -> DataFrame:
        """The tier's rows in the cells of keys(cell): only their folders are opened. The list of cells is no longer than there are cells."""
        return self.cells(spark, tier, sorted(r.cell for r in keys.select("cell").distinct().collect()))

    def cells(self, spark: SparkSession, tier: str, found: list[int]) -> DataFrame:
        schema = self.narrow_schema if tier == "narrow" else self.wide_schema
        if not found:
            return spark.createDataFrame([], f"{schema}, cell long")
        folder = f"{self.at}/{tier}"
        return spark.read.option("basePath", folder).schema(f"{schema}, cell long").parquet(*(f"{folder}/cell={c}" for c in found))


def opened(spark: SparkSession, at: str) -> Paged:
    """What `pages` has written."""
    row = spark.read.parquet(f"{at}/schemas").first()
    return Paged(at, row.narrow, row.wide, spark.read.parquet(f"{at}/sample"))


def merged_graph(graph: DataFrame) -> DataFrame:
    """id and nbrs: the union of each node's lists in all shards, in order of their places there."""
    each = graph.select("id", F.posexplode("nbrs").alias("pos", "dst"))
    one = each.groupBy("id", "dst").agg(F.min("pos").alias("pos"))
    return one.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst"))).alias("r")).select("id", F.col("r.dst").alias("nbrs"))


def pages(nodes: DataFrame, graph: DataFrame, placed: DataFrame, to: str, sample: int = SAMPLE, seed: int = 42) -> Paged:
    """Write the tiers of nodes(id, vec, codes, attributes) with graph(id, nbrs of all shards), in the cells of placed(id, cell)."""
    where = placed.select("id", "cell")
    edges = merged_graph(graph).select("id", F.posexplode("nbrs").alias("pos", "dst"))
    told = nodes.drop("vec").join(where, "id")
    rest = [c for c in told.columns if c not in ("id", "cell")]
    edges = edges.join(told.select(F.col("id").alias("dst"), "cell", *(F.col(c).alias(f"of_{c}") for c in rest)), "dst")
    lists = edges.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("pos", "dst", "cell", *(f"of_{c}" for c in rest)))).alias("r"))
    member = lambda x: F.struct(x["cell"].alias("cell"), x["dst"].alias("id"), *(x[f"of_{c}"].alias(c) for c in rest))
    lists = lists.select("id", F.transform("r", member).alias("nbrs"))
    rows = nodes.join(where, "id").join(lists, "id", "left")
    narrow = rows.drop("vec").withColumn("nbrs", F.coalesce("nbrs", F.array().cast(lists.schema["nbrs"].dataType)))
    narrow.repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{to}/narrow")
    wide = nodes.select("id", "vec").join(where, "id")
    wide.repartition("cell").sortWithinPartitions("cell", "id").write.partitionBy("cell").parquet(f"{to}/wide")
    rate = sample / max(1, nodes.count())
    some = nodes.join(where, "id")
    if rate < 1:
        some = some.where(F.pmod(F.xxhash64("id", F.lit(seed)), F.lit(1 << 30)) < int(rate * (1 << 30)))
    some.write.parquet(f"{to}/sample")
    fields = [", ".join(f"`{n}` {t}" for n, t in df.dtypes if n != "cell") for df in (narrow, wide)]
    spark = nodes.sparkSession
    spark.createDataFrame([tuple(fields)], "narrow string, wide string").coalesce(1).write.parquet(f"{to}/schemas")
    return opened(spark, to)


def lists_of(values: list[np.ndarray], kind: pa.DataType) -> pa.ListArray:
    ends = np.concatenate([[0], np.cumsum([len(v) for v in values], dtype=np.int64)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate([*values, np.zeros(0, kind.to_pandas_dtype())]), kind))


def search(paged: Paged, queries: DataFrame, book: Coder, k: int, pool: int, where: Predicate, metric: str = "l2", store: int = 32, beam: int | None = None, seeds: int = 8, fetch: int | None = None, with_self: bool = False) -> tuple[DataFrame, DataFrame]:
    """(qid, id, dist, rk; per query n_fetch (wide rows read), n_met (nodes met) and n_rounds).

    A pool member that fails the predicate is not fetched, but its first `store` neighbours are still followed. A round follows the `beam`
    nearest members that were not followed before (an eighth of the pool if not given): more save rounds and meet a few more nodes. Besides
    the pool, which leads the way, each query keeps the `fetch` nearest nodes that it met and that pass (half the pool if not given).
    """
    beam, fetch = beam or max(8, pool // 8), fetch or max(4 * k, pool // 2)
    spark = queries.sparkSession
    columns = ["qid", "qvec", *where.query_columns]
    queries = written(queries.where("qid is not null and qvec is not null").select(*columns))
    told = ["cell", "id", "codes", *where.base_columns]
    held = spark.sparkContext.broadcast(book)
    groups = max(GROUPS, -(-queries.count() // TOGETHER))
    group = F.pmod(F.xxhash64("qid"), F.lit(groups)).cast("int").alias("group")
    fields = [f.split()[0] for f in STATE.split(", ")]
    kinds = dict(zip(fields, [pa.int64(), pa.int64(), pa.int64(), pa.float64(), pa.bool_(), pa.bool_(), pa.bool_(), pa.bool_()], strict=True))

    def advance(state: pa.Table, read: pa.Table) -> pa.Table:
        """The queries one round further: what was read for them is scored and competes with what they hold."""
        state = state.combine_chunks()
        qids, qx = state["qid"].to_numpy(), matrix(state["qvec"])
        q = state.select(columns)
        had = {f: (np.asarray(state[f].combine_chunks().flatten().cast(pa.int8()) if kinds[f] == pa.bool_() else state[f].combine_chunks().flatten()), np.concatenate([[0], np.cumsum(pc.list_value_length(state[f]).to_numpy())])) for f in fields if len(qids)}
        lists = read["nbrs"].combine_chunks()
        rows, of = lists.flatten(), np.repeat(read["to"].to_numpy(), pc.list_value_length(lists).to_numpy())
        ids = rows.field("id").to_numpy()
        order = np.lexsort((ids, of))
        first = np.ones(len(order), bool)
        first[1:] = (of[order][1:] != of[order][:-1]) | (ids[order][1:] != ids[order][:-1])
        order = order[first]
        of, ids = of[order], ids[order]
        start, end = np.searchsorted(of, qids), np.searchsorted(of, qids, "right")
        score = held.value.paired(qx, "l2" if metric == "l2" else "ip") if len(order) else None
        out: dict[str, list[np.ndarray]] = {f: [] for f in fields}
        for i in range(len(qids)):
            mine = {f: v[at[i] : at[i + 1]] for f, (v, at) in had.items()}
            met, new, some = mine["met"], ids[start[i] : end[i]], order[start[i] : end[i]]
            if len(new) and len(met):
                fresh = met[np.minimum(np.searchsorted(met, new), len(met) - 1)] != new
                new, some = new[fresh], some[fresh]
            parts = {"ids": mine["ids"], "cells": mine["cells"], "dist": mine["dist"], "passes": mine["passes"].astype(bool), "done": (mine["done"] | mine["turn"]).astype(bool)}
            if len(new):
                rows_of = rows.take(pa.array(some))
                codes = matrix(rows_of.field("codes")).astype(np.int64)
                base = pa.record_batch([rows_of.field(c) for c in ("id", *where.base_columns)], ["id", *where.base_columns])
                mask = where.mask(base, q.slice(i, 1))
                added = {"ids": new, "cells": rows_of.field("cell").to_numpy(), "dist": score(np.full(len(new), i), codes), "passes": np.ones(len(new), bool) if mask is None else mask[0], "done": np.zeros(len(new), bool)}
                parts = {f: np.concatenate([parts[f], added[f]]) for f in parts}
                met = np.sort(np.concatenate([met, new]))
            by = np.lexsort((parts["ids"], parts["dist"]))
            parts = {f: v[by] for f, v in parts.items()}
            leads, pass_place = np.arange(len(by)) < pool, np.cumsum(parts["passes"])
            kept = leads | (parts["passes"] & (pass_place <= fetch + 1))  # one for the query itself
            turn = leads & ~parts["done"]
            turn &= np.cumsum(turn) <= beam
            parts |= {"turn": turn, "near": parts["passes"] & (pass_place <= fetch + (not with_self))}
            out["met"].append(met)
            for f, v in parts.items():
                out[f].append(v[kept])
        return pa.table([*(state[c] for c in ("group", *columns)), *(lists_of(out[f], kinds[f]) for f in fields)], ["group", *columns, *fields])

    def round_of(state: DataFrame, read: DataFrame) -> DataFrame:
        """read: (qid, nbrs)."""
        schema = ", ".join(f"`{n}` {t}" for n, t in state.select("group", *columns).dtypes)
        to = read.select(group.alias("to_group"), F.col("qid").alias("to"), "nbrs")
        return written(state.groupBy("group").cogroup(to.groupBy("to_group")).applyInArrow(advance, f"{schema}, {STATE}"))

    def members(state: DataFrame, which: str) -> DataFrame:
        each = F.explode(F.filter(F.arrays_zip("cells", "ids", "passes", which), lambda m: m[which])).alias("m")
        return state.select("qid", each).select("qid", F.col("m.cells").alias("cell"), F.col("m.ids").alias("id"), F.col("m.passes").alias("passes"))

    start = knn(paged.sample, queries, seeds, metric, with_self=True).select("qid", "id")
    start = start.unionByName(knn(paged.sample, queries, seeds, metric, where, True).select("qid", "id")).distinct()
    start = start.join(paged.sample.select(*told), "id").select("qid", F.array(F.struct(*told)).alias("nbrs"))
    empty = [F.array().cast(f.split(" ", 1)[1]).alias(f.split()[0]) for f in STATE.split(", ")]
    state = round_of(queries.select(group, *columns, *empty), start)
    going = F.exists("turn", lambda t: t)
    ended, rounds = state.where(~going), 0
    while at := {r.cell: r["count"] for r in members(state, "turn").groupBy("cell").count().collect()}:  # no more than there are cells
        rounds += 1
        turns = members(state, "turn")
        turns = F.broadcast(turns) if sum(at.values()) * 48 <= BROADCAST_BYTES else turns
        rows = paged.cells(spark, "narrow", sorted(at)).select("id", F.transform("nbrs", lambda x: F.struct(*(x[c].alias(c) for c in told))).alias("nbrs"))
        ahead = F.when(F.col("passes"), F.col("nbrs")).otherwise(F.slice("nbrs", 1, store))
        state = round_of(state.where(going), rows.join(turns, "id").select("qid", ahead.alias("nbrs")))
        ended = ended.unionByName(state.where(~going))  # goes no further and is not written again
    fetched = members(ended, "near")
    fetched = fetched if with_self else fetched.where("qid <> id")
    asked = bounded(queries.select("qid", "qvec"), 16 * book.dim + 256)
    wide = fetched.select("qid", "cell", "id").join(paged.read(spark, "wide", fetched).select("id", "vec"), "id").join(asked, "qid")
    result = ranked(wide.select("qid", "id", distance(metric, F.col("qvec"), F.col("vec")).alias("dist")), k)
    n_fetch = fetched.groupBy("qid").agg(F.count("*").alias("n_fetch"))
    stats = ended.where("size(met) > 0").select("qid", F.size("met").cast("long").alias("n_met")).join(n_fetch, "qid", "left")
    return result, stats.select("qid", F.coalesce("n_fetch", F.lit(0)).alias("n_fetch"), "n_met", F.lit(rounds).alias("n_rounds"))
