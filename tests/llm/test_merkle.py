"""The Merkle manifest against a tree built by hand, and on odd rows."""

import hashlib
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from sparkvec.llm import op13_merkle as merkle
from sparkvec.llm import oracle

SF = "/root/testdata/sf0.001"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
DOCS = "doc_id long, source string, lang string, n_chars long, text string"


def sha(s):
    return hashlib.sha256(s.encode()).hexdigest()


def leaf(r, text):
    return sha("".join("-" if v is None else f"{len(str(v).encode())}:{v}" for v in (r.doc_id, r.source, r.lang, r.n_chars, text)))


def tree(nodes, arity):
    """The top, and for each leaf its siblings left and right, from the bottom up."""
    paths, under = [[] for _ in nodes], [[i] for i in range(len(nodes))]
    while len(nodes) > 1:
        up, held = [], []
        for a in range(0, len(nodes), arity):
            run = nodes[a : a + arity]
            for k in range(len(run)):
                for i in under[a + k]:
                    paths[i].append(("".join(run[:k]), "".join(run[k + 1 :])))
            up.append(sha("".join(run)))
            held.append([i for o in under[a : a + arity] for i in o])
        nodes, under = up, held
    return nodes[0], paths


def expected(rows, arity=8):
    rows = sorted(rows, key=lambda r: (r.doc_id is not None, r.doc_id or 0, leaf(r, r.text)))
    parts = []
    for g in sorted({r.lang for r in rows}, key=lambda g: (g is not None, (g or "").encode())):
        mine = [r for r in rows if r.lang == g]
        parts.append((mine, *tree([leaf(r, r.text) for r in mine], arity)))
    root, above = tree([p[1] for p in parts], arity)
    out = []
    for (mine, sub, paths), up in zip(parts, above, strict=True):
        for r, p in zip(mine, paths, strict=True):
            hit = r.doc_id is not None and r.text is not None and zlib.crc32(str(r.doc_id).encode()) % 3 == 0
            h = leaf(r, r.text.translate(LOWER) if hit else r.text)
            for a, z in p + up:
                h = sha(a + h + z)
            out.append((r.doc_id, leaf(r, r.text), sub, root, sha("".join(a + z for a, z in p + up)), h, h == root))
    return sorted(out, key=str)


def rows_of(df):
    return sorted((tuple(r) for r in df.select("doc_id", "leaf", "subroot", "root", "proof_sha256", "folded_root", "verified").collect()), key=str)


def test_query_equals_hand_built_tree_and_sql(spark):
    got = rows_of(merkle.query(spark, SF))
    assert got == expected(spark.read.parquet(f"{SF}/documents.parquet").collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW documents AS SELECT * FROM '{SF}/documents.parquet'")
    assert sorted(db.execute(oracle.MERKLE).fetchall(), key=str) == got


def odd(spark, n):
    some = [None, "", "A b", "É\x00x\n", "Z" * 300_000, "Straße ΑΒΓ"]
    rows = [(None if i % 17 == 16 else i % 23, None if i % 5 == 4 else "s:1", [None, "", "en", "en", "Ä", "zz"][i * i % 6], None if i % 7 == 6 else i % 3, some[i % 6]) for i in range(n)]
    return spark.createDataFrame([*rows, *rows[:3]], DOCS)


@pytest.mark.parametrize(("n", "arity"), [(1, 8), (2, 8), (90, 8), (30, 3)])
def test_odd_rows(spark, n, arity):
    docs = odd(spark, n)
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(hit, F.translate("text", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")).otherwise(F.col("text"))
    wide = docs.withColumn("grp", F.lit(1)).withColumn("lo", F.lit("x")).withColumn("digest", F.lit(2.5))
    m = merkle.manifest(wide, "doc_id", "lang", merkle.COLUMNS, {"text": text}, arity)
    assert rows_of(merkle.verified(m).withColumnRenamed("key", "doc_id")) == expected(docs.collect(), arity)


def test_empty_table(spark):
    m = merkle.manifest(odd(spark, 3).limit(0), "doc_id", "lang", merkle.COLUMNS)
    assert m.root() is None
    assert merkle.verified(m).count() == 0


def test_only_changed_leaves_differ(spark):
    docs = spark.range(300).select(F.col("id").alias("doc_id"), F.lit("s").alias("source"), F.when(F.col("id") % 3 == 0, "en").otherwise("de").alias("lang"), F.lit(1).cast("long").alias("n_chars"), F.col("id").cast("string").alias("text"))
    a = merkle.manifest(docs, "doc_id", "lang", merkle.COLUMNS)
    b = merkle.manifest(docs.withColumn("text", F.when(F.col("doc_id").isin(30, 31), "new").otherwise(F.col("text"))), "doc_id", "lang", merkle.COLUMNS)
    got = {(r.grp, r.lo) for r in merkle.differing(a, b).collect()}
    assert got == {("=en", 10), ("=de", 20)}
    assert a.root() != b.root()
    assert merkle.differing(a, a).count() == 0
    more = merkle.manifest(docs.unionByName(docs.limit(1).withColumn("doc_id", F.lit(900).cast("long")).withColumn("lang", F.lit("xx"))), "doc_id", "lang", merkle.COLUMNS)
    got = merkle.differing(a, more).collect()
    assert [(r.grp, r.lo, r.a_digest) for r in got] == [("=xx", 0, None)]
