"""Round trips of the binary files, and a stream of changes against its replay as a batch."""

import struct

import numpy as np
import pytest

from sparkvec.operators.updates import upserted, version
from sparkvec.sources import binary
from sparkvec.streaming import changes


@pytest.mark.parametrize("kind", ["float", "uint8", "int8"])
def test_matrix_round_trip(spark, tmp_path, kind):
    x = np.random.default_rng(1).integers(0, 100, (50, 6)).tolist()
    df = spark.createDataFrame([(i, [float(a) for a in r]) for i, r in enumerate(x)], "id long, vec array<float>")
    for write, read, name in ((binary.write_bin, binary.read_bin, "bin"), (binary.write_vecs, binary.read_vecs, "vecs")):
        assert write(df.repartition(3), str(tmp_path / name), kind) == 50
        got = read(spark, str(tmp_path / name), kind).orderBy("id").collect()
        assert [list(map(float, r.vec)) for r in got] == x
    assert binary.metadata(str(tmp_path / "bin")) == (50, 6)


def test_small_files(spark, tmp_path):
    p = tmp_path / "labels"
    p.write_bytes(struct.pack("<I", 3) + bytes([1, 200, 3]))
    assert [tuple(r) for r in binary.read_labels(spark, str(p)).orderBy("id").collect()] == [(0, 1), (1, 200), (2, 3)]
    p = tmp_path / "csr"
    p.write_bytes(struct.pack("<qqq", 3, 5, 4) + np.array([0, 2, 2, 4], "<i8").tobytes() + np.array([4, 1, 2, 3], "<i4").tobytes() + np.array([1, 1, 0, 1], "<f4").tobytes())
    assert [tuple(r) for r in binary.read_csr(spark, str(p)).orderBy("id").collect()] == [(0, [1, 4]), (1, []), (2, [3])]
    p = tmp_path / "truth"
    p.write_bytes(struct.pack("<ii", 2, 2) + np.array([5, 6, 7, -1], "<i4").tobytes() + np.array([0.5, 1, 2, 9], "<f4").tobytes())
    assert [tuple(r) for r in binary.read_truth(spark, str(p)).orderBy("qid", "rk").collect()] == [(0, 1, 5, 0.5, 5), (0, 2, 6, 1.0, 6), (1, 1, 7, 2.0, 7)]
    p = tmp_path / "graph"
    p.write_bytes(struct.pack("<QIIQ", 24 + 12 + 4, 2, 1, 0) + struct.pack("<III", 2, 1, 5) + struct.pack("<I", 0))
    table, head = binary.read_graph(spark, str(p))
    assert [tuple(r) for r in table.orderBy("id").collect()] == [(0, [1, 5]), (1, [])]
    assert head["entry"] == 1


def test_written_tables_come_back(spark, tmp_path):
    at = lambda name: str(tmp_path / name)
    df = spark.createDataFrame([(i, i * 7 % 256, [i % 3, 9] if i % 4 else None) for i in range(40)], "id long, label int, labels array<int>").repartition(3)
    assert binary.write_labels(df, at("l")) == 40
    assert [tuple(r) for r in binary.read_labels(spark, at("l")).orderBy("id").collect()] == [(i, i * 7 % 256) for i in range(40)]
    binary.write_csr(df, at("c"), 10)
    assert [r.labels for r in binary.read_csr(spark, at("c")).orderBy("id").collect()] == [sorted({i % 3, 9}) if i % 4 else [] for i in range(40)]
    truth = spark.createDataFrame([(0, 1, 5, 0.5), (0, 2, 6, 1.0), (1, 1, 7, 2.0)], "qid long, rk long, id long, dist double")
    binary.write_truth(truth, at("t"), 2)
    assert [tuple(r)[:4] for r in binary.read_truth(spark, at("t")).orderBy("qid", "rk").collect()] == [tuple(r) for r in truth.orderBy("qid", "rk").collect()]
    binary.write_graph(spark.createDataFrame([(0, [1, 2]), (1, []), (2, [0])], "id long, nbrs array<long>").coalesce(1), at("g"), 2, 0)
    part = next(p for p in binary.files(at("g")))
    assert binary.read_graph(spark, part)[0].count() >= 1
    binary.write_text_labels(df, at("x"))
    assert spark.read.text(at("x")).count() == 40


def test_stream_equals_batch(spark, tmp_path):
    schema = "tag long, seq long, op string, value double"
    rows = [(i % 5, i, "delete" if i % 7 == 3 else "insert", float(i)) for i in range(40)]
    for at in range(0, 40, 10):
        spark.createDataFrame(rows[at : at + 10], schema).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    root = str(tmp_path / "table")
    changes.start(stream, root, str(tmp_path / "checkpoint"), ["tag", "seq", "value"]).awaitTermination()
    want = upserted(spark.createDataFrame(rows, schema)).select("tag", "seq", "value")
    assert version(spark, root) == 4
    got = changes.current(spark, root, want)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, want.collect()))


def test_older_inserts_stay_deleted(spark, tmp_path):
    schema, root = "tag long, seq long, op string, value double", str(tmp_path / "t")
    for rows in ([(5, 1, "insert", 1.0), (6, 1, "insert", 1.0)], [(5, 10, "delete", None)], [(5, 7, "insert", 7.0), (7, 3, "insert", 3.0)], [(5, 7, "insert", 7.0)], []):
        changes.apply_to(root, ["tag", "seq", "value"])(spark.createDataFrame(rows, schema), 0)
    kind = spark.createDataFrame([], "tag long, seq long, value double")
    assert sorted(map(tuple, changes.current(spark, root, kind).collect())) == [(6, 1, 1.0), (7, 3, 3.0)]
    before = changes.manifest(spark, root)
    changes.apply_to(root, ["tag", "seq", "value"], settled=100)(spark.createDataFrame([(5, 11, "delete", None)], schema), 0)
    after = changes.manifest(spark, root)
    assert len(after) == len(before) - 1 and all(before[b] == v for b, v in after.items())  # other buckets stay where they are


@pytest.mark.parametrize(("element", "layout"), [("float", "bin"), ("uint8", "bin"), ("float", "vecs")])
def test_data_source(spark, tmp_path, element, layout):
    from pyspark.sql import functions as F

    from sparkvec.sources import datasource

    datasource.register(spark)
    df = spark.range(100).select("id", F.transform(F.sequence(F.lit(1), F.lit(5)), lambda i: ((F.col("id") * i) % 200).cast("float")).alias("vec"))
    to = str(tmp_path / "v")
    w = df.repartitionByRange(3, "id").sortWithinPartitions("id").write.format("vecfile").option("element", element).option("layout", layout)
    w.mode("append").save(to)
    back = spark.read.format("vecfile").option("element", element).option("layout", layout).option("rangeBytes", 100).load(to)
    want = {(r.id, tuple(map(float, r.vec))) for r in df.collect()}
    assert {(r.id, tuple(map(float, r.vec))) for r in back.collect()} == want
    assert sorted(r.id for r in back.where("id between 7 and 9").collect()) == [7, 8, 9]
    assert back.count() == 100
    some = spark.read.format("vecfile").option("element", element).option("layout", layout).option("first", 40).option("last", 77).option("rangeBytes", 100).load(to)
    assert {(r.id, tuple(map(float, r.vec))) for r in some.collect()} == {w for w in want if 40 <= w[0] <= 77}
    ranges = datasource.VectorReader({"path": to, "element": element, "layout": layout, "first": "40", "last": "77", "rangeBytes": "100"}).partitions()
    assert sum(p.n for p in ranges) == 38 and sum(p.n for p in datasource.VectorReader({"path": to, "element": element, "layout": layout}).partitions()) == 100
    with pytest.raises(Exception, match="not in order"):
        df.orderBy(F.desc("id")).coalesce(1).write.format("vecfile").option("element", element).mode("append").save(str(tmp_path / "w"))
    w.mode("overwrite").save(to)
    assert back.count() == 100
