"""Periodic runs against brute force, suffix trees against sorted suffixes, and odd rows."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sparkvec.llm import op11_runs as runs
from sparkvec.llm.suffix_tree import SuffixTree

SF = "/root/testdata/sf0.001"
WORD = re.compile("[^\x20\x09-\x0d]+")


def brute(words):
    """All runs, by comparing every word with the one a period further."""
    n, found = len(words), []
    for q in range(1, n // 3 + 1):
        i = 0
        while i + q < n:
            j = i
            while j + q < n and words[j] == words[j + q]:
                j += 1
            if j > i and j + q - i >= max(24, 3 * q):
                found.append((i, j + q - i, q))
            i = j + 1
    smaller = lambda s, n, q: any(all(words[x] == words[x + r] for x in range(s, s + n - r)) for r in range(1, q))
    return sorted((r for r in found if not smaller(*r)), key=lambda r: (r[0], r[2]))


def rewritten(doc_id, words):
    n = len(words)
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g = h // 10
    if h % 10 or not n:
        return words
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    return [words[a + (i - a) % p] if i >= a else words[i] for i in range(n)]


def expected(doc_id, text):
    words = rewritten(doc_id, WORD.findall(text or ""))
    found = brute(words)
    gone = {i for s, n, q in found for i in range(s + q, s + n)}
    best = None
    for r in found:
        if best is None or r[1] * best[2] > best[1] * r[2]:
            best = r
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    lines = "".join(f"{s},{n},{q}\n" for s, n, q in found)
    top = (*best, 1000 * best[1] // best[2]) if best else (None,) * 4
    return (doc_id, len(found), *top, sha(lines), sha(" ".join(w for i, w in enumerate(words) if i not in gone)))


def sequence(rng, most):
    k, out, n = rng.choice([1, 2, 3, 5, 50]), [], rng.randrange(most)
    while len(out) < n:
        if out and rng.random() < 0.5:
            p = rng.randrange(1, min(len(out), 30) + 1)
            out += (out[-p:] * 9)[: rng.randrange(1, 90)]
        else:
            out += [str(rng.randrange(k)) for _ in range(rng.randrange(1, 20))]
    return out


@pytest.mark.parametrize("seed", range(4))
def test_suffix_tree(seed):
    rng = random.Random(seed)
    for _ in range(60):
        n, k = rng.randrange(40), rng.choice([1, 2, 3])
        t = [rng.randrange(k) for _ in range(n)]
        tree = SuffixTree(t)
        assert np.argsort(tree.rank).tolist() == sorted(range(n + 1), key=lambda i: t[i:])
        i, j = (x.ravel() for x in np.meshgrid(np.arange(n + 1), np.arange(n + 1)))
        for a, b, e in zip(i, j, tree.extension(i, j), strict=True):
            m = 0
            while a != b and max(a, b) + m < n and t[a + m] == t[b + m]:
                m += 1
            assert a == b or m == e


@pytest.mark.parametrize("seed", range(4))
def test_runs_equal_brute_force(seed):
    rng = random.Random(seed)
    rows = [sequence(rng, 130) for _ in range(300)]
    got = runs.all_runs(rows)
    assert [list(map(tuple, g.tolist())) for g in got] == [brute(r) for r in rows]
    assert sum(map(len, got)) > 100


def test_stretches_lose_no_run():
    """Trees of whole texts give the same runs as those of stretches."""
    rng = random.Random(9)
    for _ in range(100):
        row = sequence(rng, 200)
        ids = {w: i for i, w in enumerate(sorted(set(row)))}
        whole = runs.runs_of([ids[w] for w in row]) if row else []
        assert np.array_equal(np.array(whole).reshape(-1, 3), runs.all_runs([row])[0])


def test_query(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").collect()
    got = sorted(tuple(r) for r in runs.query(spark, SF).collect())
    assert got == sorted(expected(r.doc_id, r.text) for r in docs)
    assert any(r[1] for r in got)


def test_a_long_text():
    rng = random.Random(2)
    phrase = [str(rng.randrange(10**6)) for _ in range(7000)]
    row = ["a", *phrase * 20, *(["x", "y"] * 30_000), "b"]
    assert runs.all_runs([row])[0].tolist() == [[1, 140_000, 7000], [140_001, 60_000, 2]]


def test_odd_rows(spark, tmp_path):
    ten = [d for d in range(200) if zlib.crc32(str(d).encode()) % 10 == 0][:4]
    some = [None, "", " \t", "a " * 30, "a\x0bb\x0cc\r\n" * 9, "é\x1cx " * 24, "one two three", "x y " * 11 + "x x y " * 8]
    rows = [(d, t) for d in [*range(8), *ten] for t in some] + [(None, "a " * 30), (None, None), (3, "a " * 30)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").withColumn("key", F.lit("k")).withColumn("runs", F.lit(1))
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    got = sorted((tuple(r) for r in runs.query(spark, str(tmp_path)).collect()), key=str)
    assert got == sorted((expected(*r) for r in rows), key=str)
    docs.limit(0).write.parquet(str(tmp_path / "none" / "documents.parquet"))
    assert runs.query(spark, str(tmp_path / "none")).count() == 0
