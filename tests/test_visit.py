"""The tree of cells with a row budget, and graph search that reads what it visits."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions.predicates import predicate
from sparkvec.operators import codes, frontier, knn, partition
from sparkvec.plans.index import VectorIndex
from sparkvec.session import written

SF = "/root/testdata/sf0.001"


def clustered(spark, n, groups, seed=1):
    rng = np.random.default_rng(seed)
    middle = rng.normal(size=(groups, 8)) * 10
    x = middle[np.arange(n) % groups] + rng.normal(size=(n, 8))
    return spark.createDataFrame([(i, v.tolist(), i % 7) for i, v in enumerate(x)], "id long, vec array<float>, label long")


def sizes(df, by="cell"):
    return {r[by]: r["count"] for r in df.groupBy(by).count().collect()}


def test_cells_keep_the_budget_and_neighbours_together(spark):
    rows = clustered(spark, 1200, 12)
    got, tree = partition.cells(rows, 150)
    assert sum(sizes(got).values()) == 1200 and max(sizes(got).values()) <= 150
    assert partition.located(rows, tree).exceptAll(got).isEmpty()
    group = got.withColumn("g", F.col("id") % 12).groupBy("cell").agg(F.countDistinct("g").alias("n"))
    assert group.where("n > 3").isEmpty()


def test_equal_vectors_are_dealt_by_hash(spark):
    rows = spark.range(500).select("id", F.array(F.lit(1.0), F.lit(2.0)).alias("vec"))
    got, tree = partition.cells(rows, 40)
    assert max(sizes(got).values()) <= 40 and not tree.where("hashed").isEmpty()
    assert partition.located(rows, tree).exceptAll(got).isEmpty()


def test_centres_that_are_not_broadcast(spark, monkeypatch):
    rows = clustered(spark, 400, 6)
    want = {(r.id, r.cell) for r in partition.cells(rows, 60)[0].collect()}
    monkeypatch.setattr(partition, "BROADCAST_BYTES", 0)
    assert {(r.id, r.cell) for r in partition.cells(rows, 60)[0].collect()} == want


def test_no_shard_overflows_after_inserts(spark):
    rows = clustered(spark, 600, 6)
    index = VectorIndex.build(rows.where("id < 200"), label="label", degree=8, pool=16, centers=16, shard_rows=150)
    for at in (200, 400):
        more = rows.where(F.col("id").between(at, at + 199))
        index = index.insert(more.unionByName(more.where(F.col("id") < at + 5)))  # some come twice
        assert max(sizes(index.graph, "shard").values()) <= 150
    assert index.nodes.count() == index.nodes.select("id").distinct().count() == 600
    assert index.graph.select("id").distinct().count() == 600
    assert {r.center for r in index.centers.collect()} == set(sizes(index.graph, "shard"))
    q = rows.where("id % 20 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    exact = {(r.qid, r.id) for r in index.search(q, 5).collect()}
    for strategy in ("graph", "visit"):
        found = {(r.qid, r.id) for r in index.search(q, 5, 100, strategy=strategy).collect()}
        assert len(found & exact) / len(exact) >= 0.9


def test_an_empty_index(spark):
    rows = clustered(spark, 40, 2)
    index = VectorIndex.build(rows.limit(0), label="label", degree=4, pool=8, shard_rows=20)
    q = rows.where("id < 3").selectExpr("id qid", "vec qvec", "label qlabel")
    for strategy in ("exact", "gated", "graph", "visit"):
        assert index.search(q, 3, strategy=strategy).isEmpty()
    full = index.insert(rows)
    assert full.nodes.count() == 40 and full.search(q, 3, 40, strategy="visit").count() == 9


@pytest.fixture(scope="module")
def index(spark):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    return VectorIndex.build(e, vec="embedding", label="label", degree=16, pool=32, centers=16, shard_rows=200)


def test_recall_of_visits(spark, index, tmp_path):
    q = index.nodes.where("id % 25 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    exact = {(r.qid, r.id): r.dist for r in index.search(q, 10, where="eq").collect()}
    found, stats = frontier.search(index.paged, q, index.book, 10, 200, predicate("eq"))
    got = {(r.qid, r.id): r.dist for r in found.collect()}
    assert len(got.keys() & exact.keys()) / len(exact) >= 0.9
    assert all(abs(got[x] - exact[x]) < 1e-9 for x in got.keys() & exact.keys())
    assert stats.where("n_fetch > 100").isEmpty()
    index.save(str(tmp_path / "i"))
    again = VectorIndex.open(spark, str(tmp_path / "i"))
    assert {(r.qid, r.id): r.dist for r in again.search(q, 10, 200, "eq", "visit").collect()} == got


def test_what_queries_keep_has_no_neighbour_lists(spark, index, monkeypatch):
    seen = []
    monkeypatch.setattr(frontier, "written", lambda df: seen.append(df.columns) or written(df))
    q = index.nodes.where("id % 100 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    found, stats = frontier.search(index.paged, q, index.book, 10, 40, predicate("eq"))
    assert found.count() == 50 and stats.where("n_rounds = 0 or n_met < 40").isEmpty()
    assert len(seen) > 4 and not any("nbrs" in c for c in seen)


def test_a_round_writes_one_row_a_query(spark, index, monkeypatch):
    made = []
    monkeypatch.setattr(frontier, "written", lambda df: made.append(written(df)) or made[-1])
    monkeypatch.setattr(frontier, "TOGETHER", 2)
    q = index.nodes.where("id % 25 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    found, stats = frontier.search(index.paged, q, index.book, 10, 40, predicate("eq"))
    rounds = stats.first().n_rounds
    assert len(made) == rounds + 2  # the queries, the seeds' round and the others
    sizes = [df.count() for df in made[1:]]
    assert sizes[0] == 20 and sizes == sorted(sizes, reverse=True) and sizes[-1] < 20  # what has ended is not written again
    last = {r.qid: r for df in made[1:] for r in df.collect()}
    assert len(last) == 20
    assert {(r.qid, r.n_met) for r in stats.collect()} == {(i, len(set(r.met))) for i, r in last.items()}
    assert all(r.met == sorted(r.met) and r.dist == sorted(r.dist) and not any(r.turn) and all(r.done[:40]) for r in last.values())
    codes = {r.id: r for r in index.nodes.collect()}
    r = last[25]
    want = [index.book.rowwise(np.array([codes[25].vec], float), np.array([codes[i].codes]), "l2")[0] for i in r.ids]
    assert np.allclose(want, r.dist) and r.passes == [codes[i].label == codes[25].label for i in r.ids]


def test_visits_open_few_cells(spark):
    rows = clustered(spark, 1500, 30)
    index = VectorIndex.build(rows, label="label", degree=8, pool=16, centers=16, shard_rows=80, copies=2)
    paged = index.paged
    q = rows.where("id in (0, 30)").selectExpr("id qid", "vec qvec", "label qlabel")  # of one group
    found, stats = frontier.search(paged, q, index.book, 5, 24, predicate("none"), seeds=2)
    assert {(r.qid, r.id) for r in found.collect()} == {(r.qid, r.id) for r in knn.knn(rows, q, 5).collect()}
    assert stats.agg(F.max("n_met")).first()[0] < 300
    cells = index.centers.count()
    read = paged.read(spark, "wide", partition.located(rows.where("id % 30 = 0"), index.tree).select("cell"))
    assert len({f.split("/")[-2] for f in read.inputFiles()}) < cells / 4
    assert paged.read(spark, "wide", q.selectExpr("1L cell").limit(0)).isEmpty()


def test_bits_estimate_distances_within_their_bound():
    rng = np.random.default_rng(2)
    x, q = rng.normal(size=(2000, 64)), rng.normal(size=(2000, 64))
    r, _ = np.linalg.qr(rng.normal(size=(64, 64)))
    bits = codes.RotatedBits(r, x.mean(0))
    coded = bits.codes(x)
    assert coded.shape == (2000, 4)  # 64 bits and two numbers
    true, guess = ((x - q) ** 2).sum(1), bits.rowwise(q, coded, "l2")
    assert (np.abs(true - guess) <= bits.error(q, coded)).mean() > 0.97
    assert abs((guess - true).mean()) < 0.02 * true.mean()
    assert np.allclose(bits.scorer(q[:5], "l2")(np.arange(5), coded[:5]).diagonal(), guess[:5])
    assert np.corrcoef(bits.rowwise(q, coded, "ip"), -((x - x.mean(0)) * q).sum(1))[0, 1] > 0.75


def test_every_search_takes_either_kind_of_codes(spark, tmp_path):
    """Recall grows with the size of the codes: 16 bits (4 chunks of 16 centres), 64 bits and two numbers, 64 bits of 16 chunks."""
    e = spark.read.parquet(f"{SF}/embeddings.parquet").withColumnRenamed("vec_id", "id")
    q = e.where("id % 25 = 0").selectExpr("id qid", "embedding qvec", "label qlabel")
    shares = {}
    for name, kind, chunks in (("pq4", "pq", 4), ("bits", "bits", 0), ("pq16", "pq", 16)):
        index = VectorIndex.build(e, vec="embedding", label="label", degree=12, pool=24, centers=16, chunks=chunks, shard_rows=500, kind=kind)
        exact = {(r.qid, r.id) for r in index.search(q, 10, where="eq").collect()}
        for strategy in ("gated", "graph", "visit") if kind == "bits" else ("gated",):
            got = {(r.qid, r.id) for r in index.search(q, 10, 20, "eq", strategy).collect()}
            shares[name, strategy] = len(got & exact) / len(exact)
        if kind == "bits":
            index.save(str(tmp_path / "i"))
            again = VectorIndex.open(spark, str(tmp_path / "i"))
            assert {(r.qid, r.id) for r in again.search(q, 10, 20, "eq", "gated").collect()} == {(r.qid, r.id) for r in index.search(q, 10, 20, "eq", "gated").collect()}
    assert shares["pq4", "gated"] < shares["bits", "gated"] and shares["bits", "gated"] > 0.85 and shares["bits", "visit"] > 0.7, shares
    with pytest.raises(ValueError, match="unknown codes"):
        VectorIndex.build(e, vec="embedding", kind="none")
