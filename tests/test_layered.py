"""Changes in layers, searches during a merge, versions."""

import pytest
from pyspark.sql import functions as F

from sparkvec.plans.index import VectorIndex
from sparkvec.plans.layered import LayeredIndex

SF = "/root/testdata/sf0.001"


def found(index, q, strategy="exact"):
    return [(r.qid, r.tag, round(r.dist, 9), r.rk) for r in index.search(q, 5, 60, "eq", strategy).orderBy("qid", "rk").collect()]


def test_layers_and_merges(spark, tmp_path, monkeypatch):
    e = spark.read.parquet(f"{SF}/embeddings.parquet").where("vec_id < 160").selectExpr("vec_id * 10 id", "embedding vec", "cast(label as long) label").cache()
    q = e.where("id % 200 = 0").selectExpr("id qid", "vec qvec", "label qlabel")
    first = LayeredIndex.create(VectorIndex.build(e.where("id < 1200"), label="label", degree=10, pool=20, centers=16, shard_rows=100), str(tmp_path / "i"))
    assert {r.tag for r in first.tags.collect()} == set(range(0, 1200, 10))
    assert sorted(r.id for r in first.tags.collect()) == list(range(120))
    more = e.where("id >= 1200").withColumnRenamed("id", "tag")
    moved = e.where("id = 30").select(F.col("id").alias("tag"), F.transform("vec", lambda x: -x).alias("vec"), "label")
    layered = first.insert(more).delete(e.where("id % 100 = 50").select(F.col("id").alias("tag"))).insert(moved)
    layered = layered.insert(e.where("id = 150").withColumnRenamed("id", "tag"))  # deleted before
    there = e.where("(id % 100 <> 50 or id = 150) and id <> 30").unionByName(moved.withColumnRenamed("tag", "id"))
    want = [(r.qid, r.id, round(r.dist, 9), r.rk) for r in VectorIndex.build(there, label="label", degree=4, pool=8, centers=4, shard_rows=200).search(q, 5, where="eq").orderBy("qid", "rk").collect()]
    assert found(layered, q) == want
    near = set(found(layered, q, "gated"))
    assert len(near & set(want)) / len(want) > 0.9
    assert found(LayeredIndex.open(spark, first.root, first.version), q) == found(first, q) != want

    # a merge that fails leaves the version readable
    monkeypatch.setattr(VectorIndex, "save", lambda self, to: 1 / 0)
    with pytest.raises(ZeroDivisionError):
        layered.merge()
    monkeypatch.undo()
    again = LayeredIndex.open(spark, first.root)
    assert again.version == layered.version and found(again, q) == want

    merged = again.merge()
    assert merged.layers == () and merged.version == again.version + 1
    assert found(merged, q) == want == found(again, q)  # readers of the old version go on
    n = merged.base.nodes.count()
    assert n == there.count() and sorted(r.id for r in merged.base.nodes.select("id").collect()) == list(range(n))
    assert {r.id for r in merged.base.graph.select("id").distinct().collect()} == set(range(n))
    assert merged.base.graph.where(F.exists("nbrs", lambda x: (x < 0) | (x >= n))).isEmpty()
    codes = merged.tags.join(merged.base.nodes, "id").where("tag = 30").select("vec").first()[0]
    assert list(codes) == list(moved.first().vec)
    assert len(set(found(merged, q, "visit")) & set(want)) / len(want) > 0.8
    with pytest.raises(ValueError, match="has come after"):
        again.delete(e.limit(1).select(F.col("id").alias("tag")))
