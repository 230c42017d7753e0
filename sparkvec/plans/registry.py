"""The named queries over the test tables. The same queries as SQL are in `oracle`.

Test set-up: `embeddings` is the base, with derived label sets and a numeric attribute; queries are its rows whose id is divisible
by 20, each without itself; deletes are ids that end in 3; the codebook's centres are the first 16 rows, cut into 16 chunks.
"""

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.functions import vector as V
from sparkvec.functions.predicates import predicate
from sparkvec.operators import cache, codes, graph, graph_index, knn, partition, pools, quality, quantization, updates, workload
from sparkvec.operators.quantization import Codebook
from sparkvec.plans import oracle
from sparkvec.plans.index import VectorIndex
from sparkvec.session import table, written

DIM, CHUNKS, CENTERS, K, DEGREE = 64, 16, 16, 10, 8
POOLS = (10, 50, 100, 200)
Query = Callable[[SparkSession, str], DataFrame]
FOUND: dict[str, Query] = {}


def query(f: Query) -> Query:
    FOUND[f.__name__] = f
    return f


def base_of(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "embeddings")
    id = F.col("vec_id")
    labels = F.array(F.col("label").cast("long"), 10 + id % 3, 20 + id % 5)
    return e.select(id.alias("id"), F.col("embedding").alias("vec"), F.col("label").cast("long").alias("label"), labels.alias("labels"), (id % 100).alias("attr"))


def queries_of(base: DataFrame) -> DataFrame:
    q = base.where("id % 20 = 0")
    return q.select(F.col("id").alias("qid"), F.col("vec").alias("qvec"), F.col("label").alias("qlabel"), F.slice("labels", 1, 2).alias("qlabels"), (F.col("id") % 90).alias("lo"), (F.col("id") % 90 + 9).alias("hi"))


def both(spark: SparkSession, sf: str) -> tuple[DataFrame, DataFrame]:
    b = base_of(spark, sf)
    return b, queries_of(b)


def centers_of(base: DataFrame) -> DataFrame:
    """chunk, center, vec of the codebook."""
    first = base.where(F.col("id") < CENTERS)
    return quantization.chunks(first, DIM, CHUNKS).select("chunk", F.col("id").cast("int").alias("center"), "vec")


def book_of(base: DataFrame) -> Codebook:
    return quantization.codebook_of(centers_of(base), DIM, CHUNKS)


def three(base: DataFrame) -> DataFrame:
    return base.where("id IN (0, 1, 2)").select(F.col("id").alias("center"), F.col("vec").alias("cvec"))


def graph_of(base: DataFrame) -> DataFrame:
    """Exact neighbours within shards of bounded size: the work grows with the rows."""
    return graph.shard_graphs(base, quantization.shard_assign(base, three(base), 1), DEGREE)


def coordinates(df: DataFrame, vec: str = "vec") -> DataFrame:
    return df.select("id", F.posexplode(V.doubles(vec)).alias("pos", "value")).withColumn("pos", F.col("pos").cast("long"))


def paired(spark: SparkSession, sf: str, value: Callable[[F.Column, F.Column], F.Column]) -> DataFrame:
    """qid, id and a value of every row with the query of its block of ids."""
    b, q = both(spark, sf)
    return pairs_of(b).join(b.select("id", "vec"), "id").join(q.select("qid", "qvec"), "qid").select("qid", "id", value(F.col("qvec"), F.col("vec")).alias("value"))


def pairs_of(base: DataFrame) -> DataFrame:
    """Each id with the query before it: a list of pairs that grows with the rows."""
    return base.select((F.col("id") - F.col("id") % 20).alias("qid"), "id")


def knn_by(name: str) -> Query:
    return lambda spark, sf: knn.knn(*both(spark, sf), K, "l2", predicate(name))


for _key, _name in (("filter_eq_knn", "eq"), ("filter_subset_knn", "subset"), ("filter_intersect_knn", "intersect"), ("filter_range_knn", "range"), ("knn_unfiltered", "none")):
    FOUND[_key] = knn_by(_name)
for _key, _name in (("postfilter_eq_knn", "eq"), ("postfilter_subset_knn", "subset")):
    FOUND[_key] = lambda spark, sf, name=_name: pools.post_filter_knn(*both(spark, sf), K, 100, predicate(name))


@query
def knn_partitioned_merge(spark: SparkSession, sf: str) -> DataFrame:
    return knn.partitioned_knn(*both(spark, sf), K, 4)


@query
def knn_with_deletes(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    return updates.knn_with_deletes(b, q, K, b.where("id % 10 = 3"))


@query
def top_l_pool(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    book = book_of(b)
    return quantization.adc(quantization.encode(b, book), q, book, 20)


@query
def rerank_exact(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    book = book_of(b)
    return pools.rerank(quantization.adc(quantization.encode(b, book), q, book, 50), b, q, K)


@query
def gated_pool_knn(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    book = book_of(b)
    return pools.gated_knn(b, quantization.encode(b, book, "label"), q, book, K, 100, predicate("eq"))


@query
def matching_points(spark: SparkSession, sf: str) -> DataFrame:
    return knn.matching_points(*both(spark, sf), predicate("eq"))


@query
def selectivity(spark: SparkSession, sf: str) -> DataFrame:
    return knn.selectivity(*both(spark, sf), predicate("eq"))


@query
def label_histogram(spark: SparkSession, sf: str) -> DataFrame:
    return base_of(spark, sf).groupBy("label").agg(F.count("*").alias("n"))


@query
def multilabel_sets(spark: SparkSession, sf: str) -> DataFrame:
    total = F.aggregate("labels", F.lit(0).cast("long"), lambda s, x: s + x)
    return base_of(spark, sf).select("id", F.size("labels").cast("long").alias("n_labels"), total.alias("label_sum"))


@query
def dist_l2(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf, V.l2_sq)


@query
def dist_ip(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf, lambda a, b: -V.inner(a, b))


@query
def dist_cosine(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf, V.cosine)


@query
def dist_matrix(spark: SparkSession, sf: str) -> DataFrame:
    return paired(spark, sf, lambda a, b: V.norm_sq(a) + V.norm_sq(b) - F.lit(2.0) * V.inner(a, b))


@query
def normalize(spark: SparkSession, sf: str) -> DataFrame:
    return coordinates(base_of(spark, sf).select("id", V.normalize(F.col("vec")).alias("vec")))


@query
def row_norms(spark: SparkSession, sf: str) -> DataFrame:
    return base_of(spark, sf).select("id", V.norm_sq(F.col("vec")).alias("value"))


@query
def occlude_factor(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    g = written(graph_of(b))
    x, y = g.select("src", F.col("pos").alias("p"), F.col("dst").alias("near")), g.select("src", F.col("pos").alias("r"), F.col("dst").alias("far"), "dist")
    two = x.join(y, "src").where("p < r")
    two = two.join(b.select(F.col("id").alias("near"), F.col("vec").alias("a")), "near").join(b.select(F.col("id").alias("far"), F.col("vec").alias("c")), "far")
    return two.select("src", "near", "far", V.occlude_factor("l2", F.col("dist"), V.l2_sq(F.col("a"), F.col("c"))).alias("factor"))


@query
def ram_estimate(spark: SparkSession, sf: str) -> DataFrame:
    n = base_of(spark, sf).groupBy("label").agg(F.count("*").alias("n"))
    return n.select("label", V.ram_estimate(F.col("n"), F.lit(DIM), 4, 32).alias("bytes"))


@query
def scan_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return coordinates(base_of(spark, sf))


@query
def vector_metadata(spark: SparkSession, sf: str) -> DataFrame:
    return base_of(spark, sf).agg(F.count("*").alias("n_rows"), F.max(F.size("vec")).cast("long").alias("dim"))


@query
def vector_by_id(spark: SparkSession, sf: str) -> DataFrame:
    """The point lookup."""
    return coordinates(base_of(spark, sf).where("id = 7"))


@query
def head_n(spark: SparkSession, sf: str) -> DataFrame:
    """The head-of-n copy, by id rather than by limit, so that it is the same each time."""
    return base_of(spark, sf).where("id < 100").select("id", "label")


@query
def modulo_sample(spark: SparkSession, sf: str) -> DataFrame:
    """The sampling operator: rows whose draw is below the rate."""
    return base_of(spark, sf).where(workload.draw(F.col("id")) < 100).select("id", "label")


@query
def node_table(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    g = graph_of(b).groupBy(F.col("src").alias("id")).agg(F.count("*").alias("degree"), F.min_by("dst", "pos").alias("nearest"))
    return b.join(g, "id").select("id", "label", "degree", "nearest", V.norm_sq(F.col("vec")).alias("norm_sq"))


@query
def index_meta(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    n = V.node_length(DIM, DEGREE)
    one = quantization.medoid(b, DIM).select(F.col("id").alias("entry")).join(b.agg(F.count("*").alias("n_points")), F.lit(True))  # two rows
    return one.select("n_points", F.lit(DIM).cast("long").alias("dim"), "entry", F.lit(n).cast("long").alias("node_length"), F.lit(V.SECTOR // n).cast("long").alias("nodes_per_sector"))


@query
def page_layout(spark: SparkSession, sf: str) -> DataFrame:
    sector, place = V.sector_of(F.col("id"), V.node_length(DIM, DEGREE))
    return base_of(spark, sf).select("id", sector.alias("sector"), place.alias("place"))


@query
def tag_lookup(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return updates.tag_lookup(b, b.where("id % 2 = 0").select("id", (F.col("id") + 1_000_000).alias("tag")))


def pooled_results(b: DataFrame, q: DataFrame) -> DataFrame:
    """l, qid, id, dist, rk of the post-filter at several pool sizes, from the largest pool."""
    pool = written(knn.knn(b, q, max(POOLS)))
    passed = pools.filtered_pool(pool, b, q, predicate("eq")).join(pool.select("qid", "id", F.col("rk").alias("place")), ["qid", "id"])
    sizes = F.filter(F.array(*map(F.lit, POOLS)), lambda n: n >= F.col("place"))
    each = passed.withColumn("l", F.explode(sizes))
    rk = F.row_number().over(W.partitionBy("l", "qid").orderBy("dist", "id")).cast("long")
    return written(each.select("l", "qid", "id", "dist", rk.alias("rk")))


def recalled(measure: Callable) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b, q = both(spark, sf)
        return measure(pooled_results(b, q), written(knn.knn(b, q, 2 * K, "l2", predicate("eq"))), q)

    return run


FOUND["recall_at_k"] = recalled(lambda res, truth, q: quality.recall(res, truth, q, K, ("l",)))
FOUND["recall_valid_only"] = recalled(lambda res, truth, q: quality.recall_valid(res, truth, K, ("l",)))
FOUND["recall_tie_aware"] = recalled(lambda res, truth, q: quality.recall_tie_aware(res, truth, q, K, ("l",)))


@query
def latency_stats(spark: SparkSession, sf: str) -> DataFrame:
    return quality.percentiles(table(spark, sf, "events"), "value", [0.5, 0.9, 0.99])


@query
def io_reduction(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    return pools.io_counts(written(knn.knn(b, q, 100)), b, q, predicate("eq"))


@query
def centroid(spark: SparkSession, sf: str) -> DataFrame:
    return quantization.centroid(base_of(spark, sf), DIM).select(F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


@query
def medoid(spark: SparkSession, sf: str) -> DataFrame:
    return quantization.medoid(base_of(spark, sf), DIM).select("id", F.round("dist", 9).alias("dist"))


@query
def graph_degree_stats(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return graph.degree_stats(graph.reverse_edges(graph_of(b)), b)


@query
def cluster_sse(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return quantization.kmeans_step(b, three(b), DIM).select("center", "n", F.round("sse", 6).alias("sse"))


@query
def kmeans_step(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    new = quantization.kmeans_step(b, three(b), DIM).select("center", F.posexplode("cvec").alias("pos", "value"))
    return new.select("center", F.col("pos").cast("long").alias("pos"), F.round("value", 9).alias("value"))


@query
def closest_centers(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return quantization.closest_centers(b, three(b), 2)


@query
def shard_assign(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return quantization.shard_assign(b, three(b))


@query
def shard_sizes(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return quantization.shard_sizes(quantization.shard_assign(b, three(b)))


@query
def pq_chunks(spark: SparkSession, sf: str) -> DataFrame:
    c = quantization.chunks(base_of(spark, sf), DIM, CHUNKS)
    return c.select("id", F.col("chunk").cast("long").alias("chunk"), F.element_at("vec", 1).alias("first"), F.element_at("vec", -1).alias("last"))


@query
def pq_encode(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    codes = quantization.encode(b, book_of(b)).select("id", F.posexplode("codes").alias("chunk", "code"))
    return codes.select("id", F.col("chunk").cast("long").alias("chunk"), F.col("code").cast("long").alias("code"))


def tables_by(metric: str) -> Query:
    def run(spark: SparkSession, sf: str) -> DataFrame:
        b, q = both(spark, sf)
        t = quantization.query_table(q, centers_of(b), DIM, CHUNKS, metric)
        return t.select("qid", F.col("chunk").cast("long").alias("chunk"), F.col("center").cast("long").alias("center"), "value")

    return run


FOUND["pq_query_table"], FOUND["pq_query_table_ip"] = tables_by("l2"), tables_by("ip")


@query
def pq_adc(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    return quantization.code_values(pairs_of(b), q, quantization.encode(b, book_of(b)), centers_of(b), DIM, CHUNKS)


@query
def pq_sdc(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    book = book_of(b)
    return quantization.symmetric(pairs_of(b), written(quantization.encode(b, book)), book)


@query
def neighbor_store(spark: SparkSession, sf: str) -> DataFrame:
    return graph.neighbor_store(graph_of(base_of(spark, sf)), 4)


@query
def reverse_edges(spark: SparkSession, sf: str) -> DataFrame:
    return graph.reverse_edges(graph_of(base_of(spark, sf)))


@query
def bfs_hops(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return graph.bfs(written(graph_of(b)), quantization.medoid(b, DIM), 3)


@query
def merge_shards(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    parts = graph.shard_graphs(b, quantization.shard_assign(b, three(b)), DEGREE)
    return graph.merge_shards(parts, DEGREE).select("src", "pos", "dst")


@query
def tunnel_expand(spark: SparkSession, sf: str) -> DataFrame:
    """Neighbours are the nearest among all rows; only those that tunnels go through are sought."""
    b, q = both(spark, sf)
    pool = written(knn.knn(b, q, 20))
    passed = pools.filtered_pool(pool, b, q, predicate("eq"))
    failed = written(pool.select("qid", "id").join(passed, ["qid", "id"], "left_anti"))
    return graph.tunnel(failed, graph.neighbors_of(failed, b, 4), pool)


@query
def robust_prune(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: the passes depend on what stays."""
    b = base_of(spark, sf)
    return graph.robust_prune(graph_of(b), b, 4)


@query
def graph_search(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: traversal of a sharded graph with a gate and tunnelling, over trained codes."""
    b, q = both(spark, sf)
    centers = written(quantization.kmeans(b, DIM, 4, 5))
    assigned = written(graph_index.shards(b, centers, 2, 2000))
    book = quantization.train(b, DIM, CHUNKS, CENTERS)
    nodes = graph_index.build_graph(b, assigned, "l2", 16, 32).join(quantization.encode(b, book, "label", keep_vec=True), "id")
    return graph_index.search(written(nodes), q, centers, K, 200, predicate("eq"), book, probes=4)[0]


@query
def visit_search(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: traversal of the merged graph that reads the cells it visits, from seeds near the query."""
    b, q = both(spark, sf)
    index = VectorIndex.build(b, label="label", degree=16, pool=32, chunks=CHUNKS, centers=CENTERS, shard_rows=2000)
    return index.search(q, K, 200, predicate("eq"), "visit")


@query
def cell_assignment(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: recursive k-means until no cell has more than 100 rows; each row with the size of its cell."""
    rows, _ = partition.cells(base_of(spark, sf), 100)
    rows = written(rows.select("id", "cell"))
    return rows.join(rows.groupBy("cell").agg(F.count("*").alias("n_rows")), "cell")


@query
def one_bit_adc(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: pools by rotated one-bit codes."""
    b, q = both(spark, sf)
    coder = codes.trained("bits", b, DIM, 0, 0, 42)
    return quantization.adc(quantization.encode(b, coder, "label"), q, coder, 20, where=predicate("eq"))


@query
def pq_train(spark: SparkSession, sf: str) -> DataFrame:
    """No SQL: seeded k-means per chunk; the result is each row's codes."""
    b = base_of(spark, sf)
    codes = quantization.encode(b, quantization.train(b, DIM, CHUNKS, CENTERS)).select("id", F.posexplode("codes").alias("chunk", "code"))
    return codes


@query
def live_nodes(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return updates.live(b, b.where("id % 10 = 3")).select("id")


@query
def delete_repair(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return updates.delete_repair(written(graph_of(b)), b.where("id % 10 = 3"))


@query
def id_compaction(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return updates.compaction(updates.live(b, b.where("id % 10 = 3")))


@query
def insert_upsert(spark: SparkSession, sf: str) -> DataFrame:
    e = table(spark, sf, "events")
    op = F.when(F.col("event_id") % 10 == 3, "delete").otherwise("insert")
    return updates.upserted(e.select(F.col("user_id").alias("tag"), F.col("event_id").alias("seq"), op.alias("op"))).select("tag", "seq")


def accesses(spark: SparkSession, sf: str) -> DataFrame:
    return cache.frequencies(table(spark, sf, "events"), "user_id")


@query
def hot_nodes(spark: SparkSession, sf: str) -> DataFrame:
    return cache.hot_nodes(accesses(spark, sf), 50)


@query
def cache_hit_rate(spark: SparkSession, sf: str) -> DataFrame:
    return cache.hit_rate(accesses(spark, sf), [10, 50, 100])


@query
def optimal_cache_size(spark: SparkSession, sf: str) -> DataFrame:
    return cache.size_for(accesses(spark, sf), [0.5, 0.8, 0.9])


@query
def norm_bins(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf).select("id", V.l1_norm(F.col("vec")).alias("norm"))
    return workload.equal_bins(b, "norm", 10)


@query
def correlated_labels(spark: SparkSession, sf: str) -> DataFrame:
    b = base_of(spark, sf)
    return workload.correlated_labels(b, three(b), 0.5)


@query
def zipf_labels(spark: SparkSession, sf: str) -> DataFrame:
    return workload.zipf_labels(base_of(spark, sf))


@query
def truth_from_unfiltered(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    return workload.truth_from_unfiltered(knn.knn(b, q, 50), b, q, K)


@query
def gt_window(spark: SparkSession, sf: str) -> DataFrame:
    b, q = both(spark, sf)
    windows = spark.createDataFrame([(0, 0, 300), (1, 100, 400), (2, 200, 203)], "step long, first long, last long")
    return workload.truth_in_window(written(knn.knn(b, q, 100)), windows, 5)


def queries() -> dict[str, Query]:
    return dict(FOUND)


def oracle_sql() -> dict[str, str]:
    return oracle.oracle_sql()
