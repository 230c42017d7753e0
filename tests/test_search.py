"""Small cases worked out by hand, and properties that tie the strategies together."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.functions import sql
from sparkvec.functions import vector as V
from sparkvec.functions.predicates import predicate
from sparkvec.operators import cache, codes, graph, graph_index, knn, pools, quality, quantization, updates
from sparkvec.plans.index import VectorIndex

BASE = "id long, vec array<float>, label int, labels array<int>, attr int"
ASK = "qid long, qvec array<float>, qlabel int, qlabels array<int>, lo int, hi int"


def square(spark):
    rows = [(0, [0.0, 0.0], 0, [], 5), (1, [1.0, 0.0], 1, [1], 10), (2, [0.0, 1.0], 0, [1, 2], None), (3, [1.0, 1.0], 1, None, 7)]
    return spark.createDataFrame(rows, BASE)


def ask(spark, qlabels=(1,), **more):
    row = {"qid": 9, "qvec": [0.0, 0.0], "qlabel": 1, "qlabels": list(qlabels), "lo": 5, "hi": 10} | more
    return spark.createDataFrame([tuple(row[c] for c in ("qid", "qvec", "qlabel", "qlabels", "lo", "hi"))], ASK)


def ids(df):
    return [r["id"] for r in df.orderBy("qid", "rk").collect()]


def test_ties_go_to_the_smaller_id(spark):
    got = knn.knn(square(spark), ask(spark), 10).orderBy("rk").collect()
    assert [(r.id, r.dist) for r in got] == [(0, 0.0), (1, 1.0), (2, 1.0), (3, 2.0)]


@pytest.mark.parametrize(
    ("name", "wanted", "expected"),
    [("eq", (1,), [1, 3]), ("subset", (1,), [1, 2]), ("subset", (), [0, 1, 2]), ("subset", (1, 1), [1, 2]), ("subset", (1, 3), []), ("intersect", (1, 3), [1, 2]), ("intersect", (), []), ("range", (1,), [0, 1, 3]), ("none", (1,), [0, 1, 2, 3])],
)
def test_predicates_as_mask_and_as_column(spark, name, wanted, expected):
    b, q = square(spark), ask(spark, wanted)
    assert ids(knn.knn(b, q, 10, "l2", predicate(name))) == expected
    assert sorted(r.id for r in knn.matching_points(b, q, predicate(name)).collect()) == expected


def test_unknown_label_passes_only_if_asked(spark):
    b = square(spark).withColumn("label", F.when(F.col("id") == 2, None).otherwise(F.col("label")))
    assert ids(knn.knn(b, ask(spark), 10, "l2", predicate("eq"))) == [1, 3]
    assert ids(knn.knn(b, ask(spark), 10, "l2", predicate("eq", unknown_passes=True))) == [1, 2, 3]


def test_unknown_names_are_errors(spark):
    with pytest.raises(ValueError, match="unknown metric"):
        knn.knn(square(spark), ask(spark), 1, "hamming")
    with pytest.raises(ValueError, match="unknown predicate"):
        predicate("like")


def test_null_vectors_and_empty_tables(spark):
    b = square(spark).unionByName(spark.createDataFrame([(7, None, 1, [1], 5), (8, [1.0], 1, [1], 5)], BASE))
    assert ids(knn.knn(b, ask(spark), 10)) == [0, 1, 2, 3]
    assert ids(knn.knn(b.limit(0), ask(spark), 10)) == []
    assert ids(knn.knn(b, ask(spark).limit(0), 10)) == []


def test_byte_distances_and_zero_vector(spark):
    df = spark.createDataFrame([([255, 0], [0, 255], [127, 0], [0, 127], [0.0, 0.0])], "a array<smallint>, b array<smallint>, c array<smallint>, d array<smallint>, z array<double>")
    a = F.col
    got = df.select(V.cosine(a("a"), a("a"), "uint8"), V.cosine(a("a"), a("b"), "uint8"), V.cosine(a("c"), a("c"), "int8"), V.cosine(a("c"), a("d"), "int8"), V.normalize(a("z"))).first()
    assert tuple(got) == (0.0, 65025.0, 0.0, 16129.0, [0.0, 0.0])


def test_blocks_of_queries_give_the_same(spark, monkeypatch):
    b = spark.range(300).select("id", F.array(*(F.rand(i).cast("float") for i in range(4))).alias("vec"))
    b = spark.createDataFrame(b.toPandas(), "id long, vec array<float>")
    q = b.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"))
    whole = knn.knn(b, q, 5).orderBy("qid", "rk").collect()
    monkeypatch.setattr(knn, "BROADCAST", 0)
    monkeypatch.setattr(knn, "QUERY_BLOCK", 100)
    monkeypatch.setattr(knn, "PART_ROWS", 100)
    assert knn.knn(b, q, 5).orderBy("qid", "rk").collect() == whole


@pytest.mark.parametrize("metric", ["l2", "ip"])
@pytest.mark.parametrize("scale, far", [(1.0, 0.0), (1e-6, 1e3), (1e-170, 0.0), (1e160, 0.0)])
def test_products_rule_out_and_change_no_bit(monkeypatch, metric, scale, far):
    """With many equal vectors and near ties, with components that are tiny against their sum, whose squares vanish or overflow."""
    import pyarrow as pa

    x = np.random.default_rng(1).integers(-2, 3, (1500, 6)) * scale + far
    x[:400], x[401, 0] = x[400], np.nan
    vec = pa.array(x.tolist(), pa.list_(pa.float64()))
    base = pa.record_batch([pa.array(range(1500)), vec], ["id", "vec"])
    ask = pa.table([pa.array(range(350, 450)), vec.slice(350, 100)], ["qid", "qvec"])
    for rows in (base, base.filter(pa.array(~np.isnan(x[:, 0])))):
        with np.errstate(all="ignore"):
            got = knn.block_knn(rows, ask, 7, metric, predicate("none"), False)
            monkeypatch.setattr(knn, "PRODUCT_ROWS", 1 << 40)
            assert got.equals(knn.block_knn(rows, ask, 7, metric, predicate("none"), False))
            monkeypatch.undo()


def test_kernels_take_one_block_of_broadcast_queries(spark, monkeypatch):
    import pyarrow as pa

    def size(b, q):
        n = q.num_rows
        return pa.record_batch([q["qid"].combine_chunks(), pa.array([0] * n, pa.int64()), pa.array([float(n)] * n)], ["qid", "id", "dist"])

    monkeypatch.setattr(knn, "QUERY_BLOCK", 16)
    b, q = spark.range(50), spark.range(100).withColumnRenamed("id", "qid")
    found = knn.met(b.coalesce(1), q, 8, size).collect()
    assert sorted(r.qid for r in found) == list(range(100)) and max(r.dist for r in found) == 16


def test_recall_with_ties(spark):
    truth = spark.createDataFrame([(0, 1, 1.0, 1), (0, 2, 2.0, 2), (0, 3, 2.0, 3)], "qid long, id long, dist double, rk long")
    found = spark.createDataFrame([(0, 1, 1.0, 1), (0, 3, 2.0, 2)], "qid long, id long, dist double, rk long")
    q = spark.createDataFrame([(0,)], "qid long")
    assert quality.recall_tie_aware(found, truth, q, 2).first()[0] == 100.0
    assert quality.recall(found, truth, q, 2).first()[0] == 0.5


def test_percentile_is_an_element(spark):
    df = spark.createDataFrame([(float(i),) for i in range(1, 11)], "value double")
    assert [tuple(r) for r in quality.percentiles(df, "value", [0.5, 1.0]).orderBy("p").collect()] == [(0.5, 6.0), (1.0, 10.0)]


def test_prune_on_a_line():
    x = np.array([[1.0], [2.0], [3.0]])
    assert graph.pruned((x[:, 0] ** 2), (x - x.T) ** 2, 1) == [0]


def test_bfs_and_delete_repair(spark):
    g = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (1, 0, 3), (2, 0, 3), (3, 0, 0)], "src long, pos long, dst long")
    hops = graph.bfs(g, spark.createDataFrame([(0,)], "id long"), 5)
    assert sorted(map(tuple, hops.collect())) == [(0, 0), (1, 1), (2, 1), (3, 2)]
    g = spark.createDataFrame([(0, 0, 1), (1, 0, 2), (1, 1, 3)], "src long, pos long, dst long")
    gone = spark.createDataFrame([(1,)], "id long")
    fixed = updates.delete_repair(g, gone)
    assert sorted(map(tuple, fixed.collect())) == [(0, 2), (0, 3)]
    names = updates.compaction(spark.createDataFrame([(0,), (2,), (3,)], "id long"))
    assert sorted(map(tuple, updates.renamed(fixed, names).collect())) == [(0, 1), (0, 2)]


def test_cache_sizes(spark):
    f = spark.createDataFrame([(1, 5), (2, 3), (3, 2)], "id long, freq long")
    assert [tuple(r) for r in cache.size_for(f, [0.8, 1.0]).orderBy("target").collect()] == [(0.8, 2), (1.0, 3)]
    assert cache.hit_rate(f, [1]).first()["rate"] == 0.5


def test_reinserted_tag_is_there(spark):
    c = spark.createDataFrame([(7, 1, "insert", 1.0), (7, 2, "delete", None), (7, 3, "insert", 3.0), (8, 1, "insert", 1.0), (8, 2, "delete", None)], "tag long, seq long, op string, v double")
    assert [(r.tag, r.v) for r in updates.upserted(c).collect()] == [(7, 3.0)]


@pytest.fixture(scope="module")
def index(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").withColumnRenamed("vec_id", "id")
    return VectorIndex.build(e, vec="embedding", label="label", degree=16, pool=32, centers=16, shard_rows=400)


def test_strategies(index):
    rows = index.nodes
    q = rows.where("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))
    n = rows.count()
    exact = index.search(q, 10, where="eq", strategy="exact").orderBy("qid", "rk").collect()
    for strategy in ("post", "gated"):
        assert index.search(q, 10, n, "eq", strategy).orderBy("qid", "rk").collect() == exact
    few = index.search(q, 10, 12, "eq", "gated").groupBy("qid").count().collect()  # ten match, so ten come, at any pool
    assert len(few) == q.count() and all(r["count"] == 10 for r in few)
    want = {(r.qid, r.id) for r in exact}
    label = {r.id: r.label for r in rows.select("id", "label").collect()}

    def share(**options):
        got = index.search(q, 10, where="eq", strategy="graph", probes=2, **options).collect()
        assert all(label[r.id] == label[r.qid] for r in got)
        return len({(r.qid, r.id) for r in got} & want) / len(want)

    wide = share(pool=200, store=32)
    assert wide >= 0.85
    assert share(pool=200, store=0) < wide
    shares = [len({(r.qid, r.id) for r in index.search(q, 10, p, "eq", "gated").collect()} & want) for p in (20, 100, n)]
    assert shares == sorted(shares)


def test_large_tables_stay_exact():
    class Many:
        def count(self):
            return 10**9

    index = VectorIndex(Many(), None, None, None, "l2", 16, 32, 1.2)
    assert index.strategy(predicate("eq"), 100) == "exact"


def test_gate_reads_narrow_columns_only(index):
    q = index.nodes.where("id < 5").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))
    pool = quantization.adc(index.nodes.select("id", "codes", "label"), q, index.book, 50)
    plan = pool._jdf.queryExecution().toString()
    scans = [line for line in plan.split("\n") if "ReadSchema" in line]
    assert scans
    assert all("vec:" not in line.split("ReadSchema")[1] for line in scans)


def found_share(index, q, **options):
    exact = {(r.qid, r.id) for r in index.search(q, 10, where="eq").collect()}
    got = {(r.qid, r.id) for r in index.search(q, 10, 200, "eq", "graph", **options).collect()}
    return len(exact & got) / len(exact)


def test_index_updates(index, spark, tmp_path):
    q = index.nodes.where("id % 25 = 0").select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"))
    gone = index.nodes.where("id % 10 = 3").select("id")
    less = index.delete(gone)
    assert less.nodes.where("id % 10 = 3").count() == 0
    assert less.graph.where("id % 10 = 3").isEmpty() and less.graph.where(F.exists("nbrs", lambda n: n % 10 == 3)).isEmpty()
    assert less.graph.where("size(nbrs) > 16").isEmpty()
    back = less.insert(index.nodes.where("id % 10 = 3").select("id", "vec", "label"))
    assert back.nodes.count() == index.nodes.count() and back.graph.select("id").distinct().count() == index.nodes.count()
    assert back.graph.where("size(nbrs) = 0").isEmpty() and back.graph.groupBy("shard", "part").agg(F.count_if("entry").alias("n")).where("n <> 1").isEmpty()
    assert found_share(less, q) >= 0.85 and found_share(back, q) >= 0.85
    moved = index.nodes.where("id = 5").select("id", F.transform("vec", lambda x: -x).alias("vec"), "label")
    new = index.insert(moved)
    assert new.nodes.where("id = 5").first().vec == moved.first().vec and new.nodes.count() == index.nodes.count()
    same = index.graph.join(new.graph, ["shard", "part", "id", "entry", "nbrs"], "left_semi").count()
    assert 0 < same < index.graph.count()
    new.save(str(tmp_path / "i"))
    opened = VectorIndex.open(spark, str(tmp_path / "i"))
    for strategy in ("exact", "gated", "graph"):
        assert opened.search(q, 5, where="eq", strategy=strategy).orderBy("qid", "rk").collect() == new.search(q, 5, where="eq", strategy=strategy).orderBy("qid", "rk").collect()


def test_pruning_by_its_definition(spark):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec")).where("id < 60")
    edges = graph.knn_graph(e, 12)
    x = {r.id: np.array(r.vec, float) for r in e.collect()}
    near = {}
    for r in edges.orderBy("src", "dist", "dst").collect():
        near.setdefault(r.src, []).append((r.dist, r.dst))
    want = set()
    for src, rows in near.items():
        stays, slack = [], 1.0
        while slack <= 1.2 + 1e-6 and len(stays) < 4:
            for d, i in rows:
                if len(stays) < 4 and i not in stays:
                    hidden = max((d / ((x[i] - x[j]) ** 2).sum() for dj, j in rows if j in stays and (dj, j) < (d, i)), default=0.0)
                    if hidden <= slack:
                        stays.append(i)
            slack *= 1.2
        want |= {(src, i) for i in stays}
    assert {(r.src, r.dst) for r in graph.robust_prune(edges, e, 4).collect()} == want


def test_trained_codes_are_the_nearest_of_a_good_codebook(spark, tmp_path):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").select(F.col("vec_id").alias("id"), F.col("embedding").alias("vec"))
    book = quantization.train(e, 64, 16, 16)
    x = np.array([r.vec for r in e.orderBy("id").collect()], float)
    coded = np.array([r.codes for r in quantization.encode(e, book).orderBy("id").collect()])
    error, chance = 0.0, 0.0
    for c, ((at, n), centers) in enumerate(zip(book.bounds, book.centers, strict=True)):
        d = (((x[:, at : at + n] - book.mean[at : at + n])[:, None] - centers[None]) ** 2).sum(-1)
        assert (coded[:, c] == d.argmin(1)).all()
        assert np.allclose(centers, [x[coded[:, c] == i, at : at + n].mean(0) - book.mean[at : at + n] for i in range(16)], atol=0.05)
        error += d.min(1).sum()
        chance += (((x[:, at : at + n])[:, None] - x[None, :16, at : at + n]) ** 2).sum(-1).min(1).sum()
    assert error < 0.8 * chance
    codes.save(spark, book, str(tmp_path / "b"))
    again = codes.opened(spark, str(tmp_path / "b"))
    assert again.bounds == book.bounds and all((a == b).all() for a, b in zip(again.centers, book.centers, strict=True)) and (again.mean == book.mean).all()


def test_positions_of_ties_and_bins(spark, monkeypatch):
    from sparkvec.operators import ordering, workload

    monkeypatch.setattr(ordering, "BUCKET_ROWS", 50)
    df = spark.range(1000).select("id", F.when(F.col("id") % 7 == 0, None).otherwise((F.col("id") % 3).cast("double")).alias("x"))
    order = sorted(df.collect(), key=lambda r: (r.x is not None, r.x or 0, r.id))
    assert {r.id: r["at"] for r in ordering.positions(df, "x", "id").collect()} == {r.id: i for i, r in enumerate(order)}
    some = spark.range(10).select("id", F.col("id").cast("double").alias("x"))
    assert [tuple(r) for r in workload.bin_statistics(some, "x", 2).orderBy("bin").collect()] == [(0, 5, 0.0, 4.0), (1, 5, 5.0, 9.0)]


def test_tunnels_lead_to_the_nearest_of_all_rows(spark, tmp_path):
    """More rows than a shard part has; a pool member's neighbours are the nearest wherever they are."""
    from sparkvec.plans import registry

    rng = np.random.default_rng(3)
    x = rng.normal(size=(4500, 64)).astype(np.float32)
    spark.createDataFrame([(i, v.tolist(), i % 10) for i, v in enumerate(x)], "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {(r.qid, r.id) for r in registry.queries()["tunnel_expand"](spark, str(tmp_path)).collect()}
    x = x.astype(float)
    near = np.concatenate([np.argpartition(np.where(np.arange(4500) == np.arange(a, a + 500)[:, None], np.inf, knn.ip_block(x[a : a + 500], x) * 2 + (x * x).sum(1)), 20, 1)[:, :21] for a in range(0, 4500, 500)])
    order = [[int(i) for i in sorted(n, key=lambda j, s=s: ((x[s] - x[j]) ** 2).sum()) if i != s] for s, n in enumerate(near)]
    pool = {q: order[q][:20] for q in range(0, 4500, 20)}
    want = {(q, i) for q, p in pool.items() for j in p if j % 10 != q % 10 for i in order[j][:4] if i != q and i not in p}
    assert got == want


def test_walk_needs_tunnels():
    near, nbrs = np.array([3.0, 2.0, 1.0]).__getitem__, [np.array([1]), np.array([2]), np.array([1])]
    passes = np.array([True, False, True])
    assert graph_index.walk([0], near, nbrs, 10, passes, 4).fetched == [0, 2]
    assert graph_index.walk([0], near, nbrs, 10, passes, 0).fetched == [0]


@pytest.mark.parametrize("most, k, relaxed", [(None, None, None), (2, None, None), (0, 3, 0), (4, 5, 6)])
def test_walks_of_a_block_go_together(most, k, relaxed):
    """Each query's walk is what it is alone, with ties, and all ask for distances once a step."""
    rng = np.random.default_rng(3)
    x, q = rng.integers(0, 4, (120, 3)).astype(float), rng.integers(0, 4, (30, 3)).astype(float)
    nbrs = [np.unique(rng.integers(0, 120, rng.integers(0, 7))) for _ in x]
    passes = None if most is None else rng.random((30, 120)) < 0.4
    asked = []

    def near(some, at):
        asked.append(len(some))
        return knn.pair_distances("l2", q[some], x[at])

    got = graph_index.walks([5, 60], near, nbrs, 15, 30, passes, most, k, relaxed)
    for i, w in enumerate(got):
        alone = graph_index.walk([5, 60], lambda at, i=i: knn.l2_block(q[i : i + 1], x[at])[0], nbrs, 15, None if passes is None else passes[i], most, k, relaxed)
        assert w == alone
    assert len(asked) <= 1 + max(len(w.fetched) + w.skipped for w in got)


@pytest.mark.parametrize("passing", [False, True])
def test_rounds_of_one_member_are_walks(passing):
    rng = np.random.default_rng(11)
    x, q = rng.integers(-2, 3, (300, 6)).astype(float), rng.normal(size=(30, 6))
    nbrs = [rng.choice(300, rng.integers(0, 9), replace=False) for _ in x]
    near = knn.l2_block(q, x).astype(np.float32).astype(float)
    passes = rng.random((30, 300)) < 0.3 if passing else None
    want = [graph_index.walk([5, 60], lambda at, i=i: near[i, at], nbrs, 15, None if passes is None else passes[i], 3) for i in range(30)]
    followed, met = graph_index.rounds(near, [5, 60], graph_index.padded(nbrs), 15, 1, passes, 3)
    assert met.sum(1).tolist() == [w.compared for w in want] and followed.sum(1).tolist() == [len(w.fetched) + w.skipped for w in want]
    fetched = followed if passes is None else followed & passes
    assert [np.flatnonzero(f).tolist() for f in fetched] == [sorted(w.fetched) for w in want]
    wide, _ = graph_index.rounds(near, [5, 60], graph_index.padded(nbrs), 15, 4, passes, 3)
    assert wide.sum() < 1.3 * followed.sum()


@pytest.mark.parametrize("metric", ["l2", "ip"])
def test_lists_that_are_pruned_together(metric):
    rng = np.random.default_rng(12)
    x = rng.normal(size=(40, 3))
    x[5:9] = x[4]
    lists = [rng.choice(40, rng.integers(1, 20), replace=False) for _ in range(25)]
    for fill in (False, True):
        dist, mutual = np.full((25, 20), np.inf), np.zeros((25, 20, 20))
        want = []
        for i, some in enumerate(lists):
            d, m = knn.BLOCKS[metric](x[i : i + 1], x[some])[0], knn.BLOCKS[metric](x[some], x[some])
            order = np.argsort(d, kind="stable")
            dist[i, : len(some)], mutual[i, : len(some), : len(some)] = d[order], m[order][:, order]
            want.append(graph.pruned(d[order], m[order][:, order], 6, 1.2, metric, fill))
        got = graph.pruned_lists(dist, mutual, 6, 1.2, metric, fill)
        assert [np.flatnonzero(g).tolist() for g in got] == want


@pytest.mark.parametrize("metric", ["l2", "cosine"])
def test_building_in_batches(monkeypatch, metric):
    rng = np.random.default_rng(13)
    x = rng.normal(size=(20, 8))[np.arange(900) % 20] * 6 + rng.normal(size=(900, 8))
    x = x / np.linalg.norm(x, axis=1)[:, None] if metric == "cosine" else x
    calls = []
    cut = graph_index.Growing.cut
    monkeypatch.setattr(graph_index.Growing, "cut", lambda self, rows, some: calls.append(len(rows)) or cut(self, rows, some))
    entry, nbrs = graph_index.build(x, metric, 12, 24, 1.2)
    assert len(calls) < 60  # not one for each row
    assert max(map(len, nbrs)) <= 12 and all(i not in n for i, n in enumerate(nbrs))
    for i, n in enumerate(nbrs):
        d = knn.pair_distances(metric, np.repeat(x[i : i + 1], len(n), 0), x[n])
        assert (np.diff(d) > -1e-9).all()
    q = x[::9] + rng.normal(size=(100, 8)) * 0.1
    true = knn.BLOCKS[metric](q, x).argsort(1)[:, :5]
    followed, _ = graph_index.rounds(knn.BLOCKS[metric](q, x), [entry], graph_index.padded(nbrs), 40, 1)
    assert np.take_along_axis(followed, true, 1).mean() > 0.95
    for n in (0, 1, 2, 3):
        e, few = graph_index.build(x[:n], metric, 12, 24, 1.2)
        assert [sorted(v.tolist()) for v in few] == [[j for j in range(n) if j != i] for i in range(n)]


def test_queries_that_meet_parts_find_what_broadcast_ones_find(index, monkeypatch):
    rows = index.graph.join(index.nodes, "id")
    q = index.nodes.where("id % 20 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    search = lambda: [sorted(map(tuple, df.collect())) for df in graph_index.search(rows, q, index.centers, 10, 60, predicate("eq"), index.book, probes=2)]
    whole = search()
    assert whole[0] and len(whole[1]) == q.count()
    monkeypatch.setattr(graph_index, "BROADCAST", 0)
    assert search() == whole


def test_pool_counts(spark):
    b, q = square(spark), ask(spark)
    got = pools.io_counts(knn.knn(b, q, 3), b, q, predicate("eq")).first()
    assert tuple(got) == (9, 3, 1)


def test_relaxed_end():
    near, nbrs = np.array([3.0, 1.0, 2.0, 4.0]).__getitem__, [np.array([1]), np.array([2]), np.array([3]), np.array([0])]
    assert graph_index.walk([0], near, nbrs, 10).fetched == [0, 1, 2, 3]
    assert graph_index.walk([0], near, nbrs, 10, k=1, relaxed=0).fetched == [0, 1]


def test_sql_functions(spark):
    assert "l2_sq" in sql.register(spark)
    row = spark.sql("SELECT l2_sq(array(0D, 1D), array(2D, 1D)) a, inner_product(array(1D, 2D), array(3D, 4D)) b, labels_contain(array(1L, 2L), array(2L)) c, norm_sq(array(3D, 4D)) d").first()
    assert tuple(row) == (4.0, 11.0, True, 25.0)


@pytest.mark.parametrize("name", ["eq", "range", "subset", "intersect", "none"])
def test_distances_are_of_matching_rows_only(spark, monkeypatch, name):
    """As many as there are matches, whatever the selectivity; exact and by codes."""
    import pyarrow as pa

    rows = spark.range(200).select("id", F.array(*(F.rand(i).cast("float") for i in range(4))).alias("vec"), (F.col("id") % 10).cast("int").alias("label"), F.array((F.col("id") % 3).cast("int"), (F.col("id") % 5 + 10).cast("int")).alias("labels"), (F.col("id") % 50).cast("int").alias("attr"))
    rows = spark.createDataFrame(rows.toPandas(), BASE)
    q = rows.where("id % 20 = 0").selectExpr("id + 1000 qid", "vec qvec", "label qlabel", "slice(labels, 1, 1) qlabels", "attr lo", "attr + 4 hi")
    base, ask = rows.toArrow().combine_chunks().to_batches()[0], q.toArrow()
    where, seen = predicate(name), []
    block = knn.l2_block

    def counted(a, b):
        seen.append(len(a) * len(b))
        return block(a, b)

    monkeypatch.setitem(knn.BLOCKS, "l2", counted)
    got = knn.block_knn(base, ask, 5, "l2", where, False)
    matches = knn.matching_points(rows, q, where).count()
    assert sum(seen) == matches
    want = knn.knn(rows, q, 5, "l2", where).select("qid", "id", "dist").toArrow()
    assert sorted(pa.Table.from_batches([got]).to_pylist(), key=str) == sorted(want.to_pylist(), key=str)


def test_ties_of_seq_are_settled_the_same_way(spark):
    rows = [(1, 5, "insert", 1.0), (1, 5, "delete", None), (2, 5, "insert", 1.0), (2, 5, "insert", 2.0)]
    got = {tuple(map(tuple, updates.upserted(spark.createDataFrame(r, "tag long, seq long, op string, v double")).collect())) for r in (rows, rows[::-1])}
    assert len(got) == 1
    assert [r[0] for r in got.pop()] == [2]


def test_scratch_deletes_after_a_failure(spark):
    import os

    from sparkvec import session

    made = []
    with pytest.raises(ZeroDivisionError):
        with session.scratch(spark):
            session.final(spark.range(3).toDF("id"))
            made.append(session.GIVEN[spark.sparkContext.applicationId][-1])
            raise ZeroDivisionError
    assert made and not os.path.exists(made[0])


def test_bounds_save_distances_and_change_nothing():
    rng = np.random.default_rng(3)
    x = rng.normal(size=(3000, 8)) + 6 * rng.normal(size=(20, 8))[rng.integers(0, 20, 3000)]
    c, full = x[:20].copy(), 0
    near = quantization.Bounds(x, c)
    for _ in range(12):
        d = ((x[:, None] - near.c[None]) ** 2).sum(-1)
        full += d.size
        assert (near.of == d.argmin(1)).all()
        near.move(np.array([x[near.of == i].mean(0) if (near.of == i).any() else near.c[i] for i in range(20)]))
    assert near.computed < full / 2


def test_one_eviction_costs_less_and_finds_as_much(spark, monkeypatch):
    e = spark.read.parquet("/root/testdata/sf0.001/embeddings.parquet").orderBy("vec_id").collect()
    x = np.array([r.embedding for r in e], float)
    true = np.argsort(((x[:, None] - x[None]) ** 2).sum(-1), axis=1)[:, 1:11]

    def built(evict):
        g = graph_index.Shard(x, [np.zeros(0, int) for _ in x], "l2", 12, 32, 1.2, 750)
        if not evict:
            monkeypatch.setattr(graph_index.Shard, "evicted", lambda self, j, i: self.cut(j, np.append(self.nbrs[j], i)))
        entry = graph_index.medoid_of(x)
        for i in [entry, *(j for j in range(len(x)) if j != entry)]:
            g.insert(i, entry)
        nbrs = g.trimmed()
        assert max(map(len, nbrs)) <= 12
        hits = 0
        for q in range(0, len(x), 10):
            near = lambda some, q=q: g.dist(np.array([q]), np.array(some, int))[0]
            got = graph_index.walk([entry], near, nbrs, 40).fetched
            d = near(got)
            best = [got[i] for i in np.argsort(d) if got[i] != q][:10]
            hits += len(set(best) & set(true[q].tolist()))
        return g.computed, hits

    cost, hits = built(True)
    full_cost, full_hits = built(False)
    assert cost < full_cost and hits >= full_hits - 5, (cost, full_cost, hits, full_hits)


@pytest.mark.parametrize("metric", ["l2", "ip", "cosine"])
def test_pruning_of_any_metric_by_its_definition(metric):
    """Against a loop over sets: with a slack of 1, 1.2, ... the nearest that none hides by more than the slack stay."""
    rng = np.random.default_rng(4)
    hides = lambda to, apart: float(graph.occlusion(metric, to, apart))
    for degree in (1, 2, 3, 5, 8, 12):
        for alpha in (1.0, 1.2, 1.5):
            x, q = rng.normal(size=(20, 3)), rng.normal(size=3)
            d = ((x - q) ** 2).sum(1) if metric == "l2" else 1 - x @ q
            x, d = x[np.argsort(d)], np.sort(d)
            m = ((x[:, None] - x[None]) ** 2).sum(-1) if metric == "l2" else 1 - x @ x.T
            stay, slack = set(), 1.0
            while slack <= alpha + 1e-6:
                for i in range(20):
                    if len(stay) < degree and max((hides(d[i], m[j, i]) for j in stay if j < i), default=0) <= slack:
                        stay.add(i)
                slack *= 1.2
            assert graph.pruned(d, m, degree, alpha, metric) == sorted(stay)
            full = graph.pruned(d, m, degree, alpha, metric, fill=True)
            rest = [i for i in range(20) if i not in stay][: degree - len(stay)] if alpha > 1 else []
            assert full == sorted([*stay, *rest])
