"""Periodic runs of words, found with suffix trees, and texts with their repetitions collapsed.

A run is a stretch of words with smallest period q and a length of at least max(24, 3 q) that cannot be extended to either side. Every run
holds a Lyndon root, a stretch of q words that is smaller than all its rotations, in the order of words or in the reverse one;
and the longest Lyndon word at a place ends where the next smaller suffix begins. So each place gives two candidates, the
distances to the next smaller and to the next greater suffix; the longest common extensions forward (from the suffix tree of
the text) and backward (from the tree of its reversal) of their two ends give the maximal stretch of that period.

Trees are built of the stretches that can hold a run. In a run every eight words come again within the run, so stretches
are cut wherever eight words do not come again inside their stretch, until no cut is left; equal words give equal hashes, so no run is lost.

A null text has no words, no runs and an empty collapsed text; so has an empty one. Texts of any length are taken whole; a tree takes about 450 bytes
for each word of its stretch. Rows that repeat give repeated rows, and an empty table an empty one. Only key and text are read.
"""

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import by_bytes, settled, texts
from sparkvec.llm.suffix_tree import SuffixTree
from sparkvec.session import table

WORD = re.compile("[^\x20\x09-\x0d]+")
#: The shortest run in words and in periods, and the words that come again inside any such run.
SHORTEST, PERIODS, GRAM = 24, 3, 8
RUNS = "array<struct<start:long,length:long,period:long>>"


def next_smaller(rank: list[int]) -> np.ndarray:
    """For each place the next one with a smaller value, or the number of places."""
    out, open_ = [len(rank)] * len(rank), []
    for i, r in enumerate(rank):
        while open_ and rank[open_[-1]] > r:
            out[open_.pop()] = i
        open_.append(i)
    return np.array(out, np.int64)


def runs_of(text: list[int]) -> np.ndarray:
    """start, length and period of all runs of a list of small ints, in order of start and period."""
    n = len(text)
    tree = SuffixTree(text)
    rank = tree.rank[:n]
    at, ends = np.arange(n), [next_smaller(rank.tolist()), next_smaller((-rank).tolist())]
    i, j = np.concatenate([at, at]), np.concatenate(ends)
    period = j - i
    fits = (j < n) & (np.maximum(SHORTEST, PERIODS * period) <= n)
    i, j, period = i[fits], j[fits], period[fits]
    end = j + tree.extension(i, j)
    del tree
    start = i - SuffixTree(text[::-1]).extension(n - i, n - j)
    long = end - start >= np.maximum(SHORTEST, PERIODS * period)
    found = np.stack([start, end - start, period], 1)[long]
    found = np.unique(found, axis=0)  # a run comes up at every one of its roots
    return found[np.lexsort((found[:, 2], found[:, 0]))]


def repeating(words: np.ndarray, part: np.ndarray) -> np.ndarray:
    """Which words stand in a stretch of GRAM words that comes again in the same part. Parts are runs of equal numbers."""
    n = len(words)
    out = np.zeros(n, bool)
    if n < GRAM:
        return out
    h = (words.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    h ^= h >> np.uint64(29)
    width = 1
    while width < GRAM:
        factor = np.uint64(pow(0xBF58476D1CE4E5B9, width, 1 << 64))
        h = h[: len(h) - width] * factor + h[width:]
        h ^= h >> np.uint64(31)
        width *= 2
    whole = np.flatnonzero(part[: len(h)] == part[GRAM - 1 :])
    h = h[whole] ^ (part[whole].astype(np.uint64) * np.uint64(0x94D049BB133111EB))
    order = np.argsort(h)
    same = h[order][1:] == h[order][:-1]
    again = np.zeros(len(h), bool)
    again[order[1:][same]] = again[order[:-1][same]] = True
    reach = np.zeros(n + 1, np.int64)
    np.add.at(reach, whole[again], 1)
    np.add.at(reach, whole[again] + GRAM, -1)
    return np.cumsum(reach)[:-1] > 0


def stretches(words: np.ndarray, document: np.ndarray) -> list[tuple[int, int]]:
    """The stretches of words that can hold runs, each within one document."""
    at, part = np.arange(len(words)), document
    while True:
        inside = repeating(words[at], part)
        kept, was = at[inside], part[inside]
        if not len(kept):
            return []
        new = np.append(True, (np.diff(kept) != 1) | (np.diff(was) != 0))
        number = np.cumsum(new) - 1
        size = np.bincount(number)
        enough = size[number] >= SHORTEST
        if enough.all() and len(kept) == len(at):
            first = np.flatnonzero(new)
            return [(int(kept[f]), int(kept[f]) + int(s)) for f, s in zip(first, size, strict=True)]
        at, part = kept[enough], number[enough]
        if not len(at):
            return []


def all_runs(rows: list[list[str]]) -> list[np.ndarray]:
    """The runs of every list of words."""
    known: dict[str, int] = {}
    words = np.fromiter((known.setdefault(w, len(known)) for r in rows for w in r), np.int64)
    n = np.fromiter(map(len, rows), np.int64, len(rows))
    first = np.cumsum(n) - n
    out: list[list[np.ndarray]] = [[] for _ in rows]
    for a, z in stretches(words, np.repeat(np.arange(len(rows)), n)):
        d = int(np.searchsorted(first, a, side="right")) - 1
        found = runs_of(np.unique(words[a:z], return_inverse=True)[1].tolist())
        found[:, 0] += a - first[d]
        out[d].append(found)
    return [np.concatenate(o) if o else np.zeros((0, 3), np.int64) for o in out]


def collapsed(words: list[str], runs: np.ndarray) -> str:
    """The words that no run holds behind its first period, joined by spaces."""
    if not len(runs):
        return " ".join(words)
    reach = np.zeros(len(words) + 1, np.int64)
    np.add.at(reach, runs[:, 0] + runs[:, 2], 1)
    np.add.at(reach, runs[:, 0] + runs[:, 1], -1)
    return " ".join(words[i] for i in np.flatnonzero(np.cumsum(reach)[:-1] == 0).tolist())


def periodic(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, n_words, runs (in order of start and period; starts are word numbers from 0) and the collapsed text of every whole text."""
    schema = f"key long, n_words long, runs {RUNS}, collapsed string"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 2 << 20):
            rows = [WORD.findall(t) for t in texts(b)]
            runs = all_runs(rows)
            flat = np.concatenate(runs) if runs else np.zeros((0, 3), np.int64)
            offsets = np.cumsum([0, *map(len, runs)])
            items = pa.StructArray.from_arrays([pa.array(flat[:, k]) for k in range(3)], ["start", "length", "period"])
            lists = pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), items)
            short = [collapsed(w, r) for w, r in zip(rows, runs, strict=True)]
            yield pa.record_batch([b.column(0), pa.array([len(r) for r in rows], pa.int64()), lists, pa.array(short, pa.string())], ["key", "n_words", "runs", "collapsed"])
        settled()

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, schema).withColumnRenamed("key", key)


def greatest(runs: Column) -> Column:
    """The run with the greatest length / period, the first of equals; null if there is none."""
    none = F.lit(None).cast("struct<start:long,length:long,period:long>")
    better = lambda a, r: a.isNull() | (r["length"] * a["period"] > a["length"] * r["period"])
    return F.aggregate(runs, none, lambda a, r: F.when(better(a, r), r).otherwise(a))


def planted(key: Column, text: Column) -> Column:
    """The text of every tenth key (by its CRC-32) with all words from some place on made periodic; other texts stay."""
    h = F.crc32(key.cast("string"))
    g = F.floor(h / 10)
    words = F.filter(F.split(text, "[ \\t-\\r]+"), lambda w: w != "")
    n = F.size(words)
    a = (g % n).cast("int")
    p = (1 + F.floor((n - a) / (3 + g % 8))).cast("int")
    # p is more than a (3 + g % 8)th of the words from a on, so so many periods reach to the end
    periods = F.flatten(F.array_repeat(F.slice(words, a + 1, p), (3 + g % 8).cast("int")))
    made = F.array_join(F.concat(F.slice(words, F.lit(1), a), F.slice(periods, F.lit(1), n - a)), " ")
    return F.when((h % 10 == 0) & (n > 0), made).otherwise(text)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_runs, the run of the greatest exponent (start, length, period, exponent_milli) and digests of the runs and of the collapsed text."""
    docs = table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic(docs).withColumn("best", greatest(F.col("runs")))
    lines = F.array_join(F.transform("runs", lambda r: F.concat(F.concat_ws(",", r["start"].cast("string"), r["length"].cast("string"), r["period"].cast("string")), F.lit("\n"))), "")
    return found.select(
        "doc_id",
        F.size("runs").cast("long").alias("n_runs"),
        "best.start",
        "best.length",
        "best.period",
        F.expr("1000 * best.length div best.period").alias("exponent_milli"),
        F.sha2(lines.cast("binary"), 256).alias("runs_sha256"),
        F.sha2(F.col("collapsed").cast("binary"), 256).alias("collapsed_sha256"),
    )
