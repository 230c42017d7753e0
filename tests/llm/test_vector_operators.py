"""Vector searches against brute force, with vectors and ids that take no part, copies, and small tables."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.llm import op01_hash_forest, op10_voronoi_topk
from sparkvec.llm.vectors import usable

SCHEMA = "vec_id long, embedding array<float>, key string, v int"


@pytest.fixture(scope="module")
def table():
    rng = np.random.default_rng(7)
    x = rng.standard_normal((400, 16)).astype(np.float32)
    x[100:180] = x[100]  # copies
    x[180:230] = x[3] + rng.standard_normal((50, 16)).astype(np.float32) * 0.05
    rows = [(i, r.tolist(), "k", 1) for i, r in enumerate(x)]
    return [*rows, (1000, None, "k", 1), (1020, [0.0] * 16, "k", 1), (1040, [None] + [1.0] * 15, "k", 1), (1060, [float("nan")] * 16, "k", 1), (1080, [float("inf")] * 16, "k", 1), (None, [1.0] * 16, "k", 1), (1100, [], "k", 1), (1120, [1.0, 2.0], "k", 1)]


def brute(rows, measure, every, k):
    rows = [(i, np.array(v, np.float64)) for i, v, *_ in rows if i is not None and v and all(x is not None and np.isfinite(x) for x in v)]
    out = {}
    for q, v in rows:
        if q % every == 0:
            scored = sorted((-measure(v, w), i) for i, w in rows if i != q and len(w) == len(v))
            out[q] = [(i, -s) for s, i in scored[:k]]
    return out


def results(df):
    out = {}
    for r in df.orderBy("query_id", "rank").collect():
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def cosine(a, b):
    return float(a @ b) / float(np.sqrt((a * a).sum()) * np.sqrt((b * b).sum()))


def test_forest(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    rows = usable(df, "vec_id", "embedding", zero=False)
    got = results(op01_hash_forest.search(rows, F.col("key") % 5 == 0, 5, shard_rows=90, query_block=30))
    want = brute([r for r in table if r[0] != 1020], cosine, 5, 5)
    want.pop(1120)  # nothing of its length
    assert set(got) == set(want)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * sum(map(len, want.values()))
    vectors = {i: np.array(v, float) for i, v, *_ in table if v}
    assert all(abs(s - cosine(vectors[q], vectors[i])) < 1e-12 for q, found in got.items() for i, s in found)
    assert [i for i, _ in got[100]] == [101, 102, 103, 104, 105]
    assert op01_hash_forest.search(usable(df.limit(0), "vec_id", "embedding", False), F.lit(True), 5).count() == 0


def test_forest_ends_early_on_easy_data():
    rng = np.random.default_rng(1)
    centers = rng.standard_normal((200, 32))
    x = np.repeat(centers, 10, 0) + rng.standard_normal((2000, 32)) * 0.02
    f = op01_hash_forest.Forest(np.arange(2000), x, 32, 1)
    ids, found, _, scored = f.search(np.arange(0, 2000, 20), x[::20], 5, 0.04)
    assert np.mean(np.array(found) // 10 == np.array(ids) // 10) > 0.95
    assert scored < 0.3 * 100 * 2000


def test_forest_of_the_test_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    got = results(op01_hash_forest.query(spark, "/root/testdata/sf0.001"))
    want = brute([tuple(r) for r in e.select("vec_id", "embedding").collect()], cosine, 50, 5)
    hits = sum(len({i for i, _ in got[q]} & {i for i, _ in want[q]}) for q in want)
    assert hits >= 0.9 * 5 * len(want)


def whole(a, b):
    return int(np.floor(1024 * a) @ np.floor(1024 * b))


def test_voronoi(spark, table):
    df = spark.createDataFrame(table, SCHEMA)
    rows = usable(df, "vec_id", "embedding", zero=True)
    got = results(op10_voronoi_topk.search(rows, F.col("key") % 5 == 0, 10, n_pivots=12, part_rows=90, group_queries=10))
    want = brute(table, whole, 5, 10)
    want.pop(1120)
    assert got == want
    assert op10_voronoi_topk.search(usable(df.limit(0), "vec_id", "embedding", True), F.lit(True), 5).count() == 0


def test_voronoi_sends_less_where_it_can():
    rng = np.random.default_rng(1)
    pivots = op10_voronoi_topk.extended(rng.standard_normal((6, 8)) * 1000, 1e8)
    needs = op10_voronoi_topk.bounds(pivots, {0: 10.0}, [(0, float(d)) for d in range(12)], 10, 1)
    assert needs[0][0] < 0 and (needs[0][1:] > 0).all()


def test_voronoi_with_repeated_query_ids(spark):
    rng = np.random.default_rng(3)
    centers = rng.standard_normal((12, 8)) * 4
    rows = [(i, (centers[i % 12] + rng.standard_normal(8) * 0.05).tolist()) for i in range(1, 240)]
    rows += [(0, (centers[0] + rng.standard_normal(8) * 0.001).tolist()) for _ in range(15)]  # fill the nearest places
    df = spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    got = results(op10_voronoi_topk.search(usable(df, "vec_id", "embedding", zero=True), F.col("key") == 0, 10, n_pivots=12, part_rows=20))
    asked = min((np.floor(1024 * np.array(v)).tolist(), v) for i, v in rows if i == 0)[1]
    want = sorted((-whole(np.array(asked), np.array(v)), i) for i, v in rows if i != 0)[:10]
    assert [(i, s) for i, s in got[0]] == [(i, -s) for s, i in want]


def test_voronoi_of_the_test_table(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet")
    want = brute([tuple(r) for r in e.select("vec_id", "embedding").collect()], whole, 100, 10)
    assert results(op10_voronoi_topk.query(spark, "/root/testdata/sf0.001")) == want
