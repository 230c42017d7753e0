"""Mixing sources to target weights by a low-discrepancy schedule of equal-word blocks.

Each source's documents, shuffled by a hash of their id, form one stream of words, read again from its start when it ends. The
stream is cut into blocks of equal words. Slot i of the mix has the golden-ratio point frac(i / phi), mapped through the
cumulative target weights to a source; the r-th slot of a source takes its r-th block, so the sources stay interleaved in
proportion at every prefix of the mix. The schedule alone decides what is taken. As the number of slots is a Fibonacci number, its
points lie almost evenly, and every source gets its target to within two blocks; there are SLOTS slots at least, of
BLOCK words at most. A stream ends after `cap` rounds, whatever slots are left.

Positions in a stream and ranks of slots are prefix sums in three levels (within hash buckets, over buckets of a range, over ranges),
so a source with a third of all rows isn't one task. Only one row per source reaches the driver.

Null texts have size 0 and are never taken; a null source is a source of its own, last in order; null ids are hashed as
such. Repeated rows each count, and each get a row. An empty table gives an empty result. Other columns are not read by
`taken`; `mixed_documents` keeps them, whatever their names.
"""

from collections.abc import Iterator
from math import isqrt

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm.common import small_enough, written
from sparkvec.session import table

#: Words of a block at most and slots at least, documents of a hash bucket, slots of a rank chunk, buckets of a range.
BLOCK, SLOTS, BUCKET_DOCS, CHUNK_SLOTS, RANGE = 1024, 28_657, 512, 4096, 4096
#: The golden ratio's inverse as a share of 2^64.
GOLDEN = (isqrt(5 << 128) - (1 << 64)) // 2
WORD = r"[^\x20\x09-\x0D]+"


def n_words(text: Column) -> Column:
    return F.regexp_count(F.coalesce(text, F.lit("")), F.lit(WORD)).cast("long")


def targets(sizes: list[int], weights: list[float], total: float, cap: float) -> list[float]:
    """Shares of the total by weight, none above cap times its size; what is cut off goes to the others by weight."""
    out, free = [0.0] * len(sizes), set(range(len(sizes)))
    left = total
    while free:
        unit = left / sum(weights[i] for i in free)
        over = {i for i in free if unit * weights[i] > cap * sizes[i]}
        if not over:
            for i in free:
                out[i] = unit * weights[i]
            break
        for i in over:
            out[i] = float(cap * sizes[i])
            left -= out[i]
        free -= over
    return out


def running(df: DataFrame, value: str, group: list[str], bucket: str, order: list[str]) -> DataFrame:
    """Adds `before`: the sum of `value` over the group's earlier rows, by bucket and then order; and `rn` in the bucket."""

    def ahead(by: list[str], of: str, name: str) -> Column:
        w = W.partitionBy(*by).orderBy(of).rowsBetween(W.unboundedPreceding, -1)
        return F.coalesce(F.sum(name).over(w), F.lit(0))

    totals = df.groupBy(*group, bucket).agg(F.sum(value).alias("sum1")).withColumn("range", F.floor(F.col(bucket) / RANGE))
    ranges = totals.groupBy(*group, "range").agg(F.sum("sum1").alias("sum2"))
    ranges = ranges.select(*group, "range", ahead(group, "range", "sum2").alias("start2"))
    totals = totals.withColumn("start1", ahead([*group, "range"], bucket, "sum1")).join(ranges, [*group, "range"])
    totals = totals.select(*group, bucket, (F.col("start1") + F.col("start2")).alias("start"))
    inside = W.partitionBy(*group, bucket).orderBy(*order)
    rows = df.withColumn("rn", F.row_number().over(inside))
    rows = rows.withColumn("upto", F.sum(value).over(inside.rowsBetween(W.unboundedPreceding, 0)))
    return rows.join(totals, [*group, bucket]).withColumn("before", F.col("start") + F.col("upto") - F.col(value)).drop("upto", "start")


def placed(df: DataFrame, weights: tuple[float, ...], share: float, cap: float, seed: int, key: str, source: str, text: str) -> tuple[DataFrame, list[float]]:
    """Every document with its source's number, size and target and its place in the stream; and the sources' targets."""
    spark = df.sparkSession
    rows = written(df.select(F.col(key).alias("key"), F.col(source).cast("string").alias("source"), n_words(F.col(text)).alias("size"), F.xxhash64(text).alias("own")))
    found = sorted(rows.groupBy("source").agg(F.sum("size"), F.count("*")).collect(), key=lambda r: (r[0] is None, r[0] or ""))
    sizes, n_rows = [r[1] for r in found], sum(r[2] for r in found)
    aims = targets(sizes, [weights[i % len(weights)] for i in range(len(sizes))], share * sum(sizes), cap)
    plan = [(r[0], i, s, t) for i, (r, s, t) in enumerate(zip(found, sizes, aims, strict=True))]
    plan = spark.createDataFrame(plan, "of string, src int, source_size long, target double")  # one row per source
    rows = rows.join(F.broadcast(plan), F.col("source").eqNullSafe(F.col("of"))).drop("of")
    point = F.shiftrightunsigned(F.xxhash64("key", F.lit(seed)), 11)
    buckets = max(1, -(-n_rows // BUCKET_DOCS))
    rows = rows.withColumn("point", point).withColumn("bucket", F.floor(point / F.lit(float(1 << 53)) * buckets))
    return running(rows, "size", ["src"], "bucket", ["point", "key", "size", "own"]), aims


def n_slots(total: float, block: int, least: int) -> int:
    """The first Fibonacci number that leaves blocks of at most that many words."""
    a, b = 1, 1
    while b < max(total / block, least):
        a, b = b, a + b
    return b


def drawn(slot: np.ndarray, aims: list[float], step: int) -> np.ndarray:
    """The sources of slots by their points, multiples of step / 2^64 without whole parts."""
    point = (slot.astype(np.uint64) * np.uint64(step)).astype(np.float64) / 2.0**64
    ends = np.cumsum(aims) / sum(aims)
    return np.searchsorted(ends, point, side="right").clip(0, len(aims) - 1)


def slots(spark: SparkSession, aims: list[float], n: int) -> DataFrame:
    """slot, src and block (the slot's rank in its source) of the schedule."""
    step = GOLDEN

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            yield pa.record_batch([b.column(0), pa.array(drawn(b.column(0).to_numpy(), aims, step), pa.int32())], ["slot", "src"])

    made = spark.range(n if sum(aims) else 0).mapInArrow(run, "slot long, src int")
    made = made.withColumns({"chunk": F.floor(F.col("slot") / CHUNK_SLOTS), "one": F.lit(1)})
    return running(made, "one", ["src"], "chunk", ["slot"]).select("slot", "src", F.col("before").cast("long").alias("block"))


ROW = ["src", "bucket", "rn"]


def mixture(df: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2, block: int = BLOCK, least: int = SLOTS, seed: int = 17, key: str = "doc_id", source: str = "source", text: str = "text") -> tuple[DataFrame, DataFrame]:
    """(documents with their place, the mix: slot and the words [first, last) of a document's epoch that it takes)."""
    rows, aims = placed(df, weights, share, cap, seed, key, source, text)
    rows = written(rows)
    n = n_slots(sum(aims), block, least)
    wide = max(sum(aims), 1.0) / n  # words of a block; block b ends before word floor((b + 1) * wide)
    schedule = written(slots(df.sparkSession, aims, n))
    asked = schedule.groupBy("src").agg(F.max("block").alias("last_block"))  # one row per source
    epochs = F.explode(F.sequence(F.lit(0), F.lit(int(np.ceil(cap)) - 1))).alias("epoch")
    parts = rows.where("size > 0").join(F.broadcast(asked), "src").select("*", epochs).withColumn("at", F.col("before") + F.col("epoch") * F.col("source_size"))
    parts = parts.withColumn("until", F.least(F.col("at") + F.col("size"), F.floor(cap * F.col("source_size")))).where("until > at")
    parts = parts.where(F.floor(F.col("at") / wide) <= F.col("last_block") + 1)
    span = F.explode(F.sequence(F.greatest(F.floor(F.col("at") / wide) - 1, F.lit(0)), F.least(F.floor(F.col("until") / wide) + 1, F.col("last_block") + 1)))
    parts = parts.select(*ROW, "key", "own", "epoch", "at", "until", span.alias("block"))
    first, last = F.greatest("at", F.floor(F.col("block") * wide)), F.least("until", F.floor((F.col("block") + 1) * wide))
    parts = parts.withColumns({"first": first - F.col("at"), "last": last - F.col("at")}).where("last > first")
    mix = parts.join(schedule, ["src", "block"])
    return rows, mix.select("slot", *ROW, "key", "own", "epoch", "first", "last")


def taken(rows: DataFrame, mix: DataFrame, key: str = "doc_id") -> DataFrame:
    """Per document what the mix takes of it, and the first slot that does."""
    kinds = dict(rows.dtypes)
    none = rows.select(*ROW, "key", "size", "source_size", "target", F.lit(0).cast("long").alias("n"), F.lit(None).cast("long").alias("slot"))
    empty = (F.lit(None).cast(kinds[c]).alias(c) for c in ("key", "size", "source_size", "target"))
    some = mix.select(*ROW, *empty, (F.col("last") - F.col("first")).alias("n"), "slot")
    out = none.unionByName(some).groupBy(*ROW).agg(*(F.max(c).alias(c) for c in ("key", "size", "source_size", "target")), F.sum("n").alias("taken"), F.min("slot").alias("first_slot"))
    return out.select(F.col("key").alias(key), "size", "source_size", "target", "taken", "first_slot")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, size, source_size, target, taken and first_slot of all documents."""
    return taken(*mixture(table(spark, sf_dir, "documents")))


def mixed_documents(df: DataFrame, key: str = "doc_id", source: str = "source", text: str = "text", **options) -> DataFrame:
    """The rows of df in the order of the mix: once per epoch that takes any of it, at the place of the first slot that does.

    Where a source's last slot ends inside a document, its text is cut there.
    """
    rows, mix = mixture(df, key=key, source=source, text=text, **options)
    same = ["src", "key", "own"]
    repeated = not rows.groupBy(*same).count().where("count > 1").isEmpty()
    copy = F.row_number().over(W.partitionBy(*same).orderBy("bucket", "rn")) if repeated else F.lit(1)
    names = rows.select(*ROW, "source", "size", copy.alias("copy"))
    runs = mix.groupBy(*ROW, "key", "own", "epoch").agg(F.max("last").alias("upto"), F.min("slot").alias("slot"))
    runs = runs.join(names, ROW).groupBy("key", "source", "own", "copy", "size").agg(F.collect_list(F.struct("upto", "slot")).alias("runs"))  # one entry per epoch
    runs = small_enough(written(runs), 128).alias("r")

    docs = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), F.col(key).alias("key"), F.col(source).cast("string").alias("source"), F.xxhash64(text).alias("own"))
    copy = F.row_number().over(W.partitionBy("key", "source", "own").orderBy("row")) if repeated else F.lit(1)
    docs = docs.withColumn("copy", copy).alias("d")
    met = F.col("d.key").eqNullSafe(F.col("r.key")) & F.col("d.source").eqNullSafe(F.col("r.source")) & (F.col("d.own") == F.col("r.own")) & (F.col("d.copy") == F.col("r.copy"))
    out = docs.join(runs, met).select("row", "size", F.explode("runs").alias("run"))
    whole = F.col("row").getField(text)
    words = F.regexp_extract_all(whole, F.lit(WORD + r"[\x20\x09-\x0D]*"), F.lit(0))
    cut = F.array_join(F.slice(words, F.lit(1), F.col("run.upto").cast("int")), "")
    new = F.when(F.col("run.upto") < F.col("size"), cut).otherwise(whole)
    out = out.repartitionByRange("run.slot").sortWithinPartitions("run.slot")
    return out.select(*(new.alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))
