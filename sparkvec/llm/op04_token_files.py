"""Token ids as Parquet list columns: one range-sorted pass that encodes, writes and can be read selectively.

File format: a folder of Parquet files in ascending key order with the columns key, part, local_start, n_tokens and ids
(array<int>). Files use format version 2: ids are delta encoded in bit-packed blocks unless the dictionary stays small,
row groups and pages have set sizes, and the column and page indexes that the writer adds let a reader skip row groups and
pages by key and read metadata columns without touching ids. `local_start` counts the ids before a row within its part, so
the global start of a row is its part's start plus that: only one total per part meets elsewhere.

Nulls and empty texts are encoded as the end id alone. Rows with a null key sort first. Ties and repeated rows are all
written, in any order among themselves. An empty table gives empty files and an empty result. Other columns are not read.
"""

import zlib
from collections.abc import Iterator
from functools import reduce
from operator import or_

import numpy as np
import public_tokenizers
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from sparkvec.llm.common import by_bytes, shared_dir, texts
from sparkvec.llm.words import segments_of, summed
from sparkvec.session import table

FILE_SCHEMA = "key long, part int, local_start long, n_tokens long, ids array<int>"


def encoded(df: DataFrame, path: str, end_id: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of the file format, range-partitioned and sorted by key."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, done = segments_of(path), 0
        for b in by_bytes(batches, "text", 2 << 20):
            numbers, per_text = known.of_texts(texts(b))
            ids, per_segment = known.ids(numbers)
            n = summed(per_segment, per_text)
            ids = np.insert(ids.astype(np.int32), np.cumsum(n), end_id)
            n = n + 1
            offsets = np.concatenate([[0], np.cumsum(n)])
            cols = [
                b.column(0),
                b.column(1),
                pa.array(done + offsets[:-1], pa.int64()),
                pa.array(n, pa.int64()),
                pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(ids, pa.int32())),
            ]
            done += int(offsets[-1])
            yield pa.record_batch(cols, ["key", "part", "local_start", "n_tokens", "ids"])

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    src = src.repartitionByRange("key").sortWithinPartitions("key")
    return src.select("key", F.spark_partition_id().alias("part"), "text").mapInArrow(run, FILE_SCHEMA)


def write_tokens(df: DataFrame, to: str, path: str, end_id: int = 1, key: str = "doc_id", text: str = "text", row_group: int = 16 << 20, page: int = 256 << 10) -> None:
    """Encode every whole text and write the files; row_group and page are bytes."""
    w = encoded(df, path, end_id, key, text).write.option("parquet.writer.version", "v2")
    w = w.option("parquet.enable.dictionary", "true").option("parquet.dictionary.page.size", str(page))
    w = w.option("parquet.block.size", str(row_group)).option("parquet.page.size", str(page))
    w.option("compression", "zstd").parquet(to)


def read_tokens(spark: SparkSession, at: str) -> DataFrame:
    """The written rows with `start`, the ids of all rows before it. Select fewer columns and only those are read."""
    rows = spark.read.schema(FILE_SCHEMA).parquet(at)
    # one row per part: as many as the write had partitions
    totals = rows.groupBy("part").agg(F.sum("n_tokens").alias("ids_in_part"))
    before = W.orderBy("part").rowsBetween(W.unboundedPreceding, -1)
    starts = totals.select("part", F.coalesce(F.sum("ids_in_part").over(before), F.lit(0)).alias("part_start"))
    return rows.join(F.broadcast(starts), "part").withColumn("start", F.col("part_start") + F.col("local_start"))


def read_keys(spark: SparkSession, at: str, first: int, last: int) -> DataFrame:
    """The rows with keys from first to last: row groups and pages of other keys are skipped by their statistics."""
    return read_tokens(spark, at).where(F.col("key").between(first, last))


def read_token_range(spark: SparkSession, at: str, first: int, last: int) -> DataFrame:
    """key, start and ids of the tokens [first, last) of the whole corpus; ids are read of the parts and rows that hold any.

    The places are found in the narrow columns, so ids outside are not decoded.
    """
    places = read_tokens(spark, at).select("part", "local_start", "start", "n_tokens")
    inside = places.where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    spans = inside.groupBy("part").agg(F.min("local_start").alias("a"), F.max("local_start").alias("z"), F.min(F.col("start") - F.col("local_start")).alias("part_start")).collect()  # one row per part inside
    if not spans:
        return read_tokens(spark, at).select("key", "start", "ids").limit(0)
    some = reduce(or_, (F.col("part").eqNullSafe(r.part) & F.col("local_start").between(r.a, r.z) for r in spans))
    rows = spark.read.schema(FILE_SCHEMA).parquet(at).where(some)
    start = F.element_at(F.create_map(*(F.lit(x) for r in spans for x in (r.part, r.part_start))), F.col("part")) + F.col("local_start")
    skip = F.greatest(first - start, F.lit(0)).cast("int")
    return rows.select("key", (start + skip).alias("start"), F.slice("ids", skip + 1, F.least("n_tokens", last - start).cast("int") - skip).alias("ids"))


def digest(rows: DataFrame, key: str = "doc_id") -> DataFrame:
    """key, start, n_tokens and the CRC-32 of the ids as little-endian unsigned 32-bit integers."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            ids = b.column(2)
            flat, off = ids.flatten().to_numpy().astype("<u4"), ids.offsets.to_numpy()
            off = off - off[0]
            crc = [zlib.crc32(flat[a:z].tobytes()) for a, z in zip(off[:-1], off[1:], strict=True)]
            n = np.diff(off)
            yield pa.record_batch([b.column(0), b.column(1), pa.array(n, pa.int64()), pa.array(crc, pa.int64())], ["key", "start", "n_tokens", "ids_crc32"])

    out = rows.select("key", "start", "ids").mapInArrow(run, "key long, start long, n_tokens long, ids_crc32 long")
    return out.withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of all documents, from the files that were written."""
    to = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), to, public_tokenizers.path("word_bpe_49k.json"))
    return digest(read_tokens(spark, to))
