"""Vector files as a Spark data source: `spark.read.format("vecfile")` and `df.write.format("vecfile")`, after `register(spark)`.

Options: path; element (float, uint8, int8, ...); layout (bin: one header a file; vecs: each record begins with its dimension). A partition is a
range of bytes of one file. With the options first and last only the records of these
ids are read. (Filters are not pushed down: Spark 4.1 keeps a Python reader with the filters of an earlier query on the same DataFrame.) A write puts each task's rows into a file of its own, which gets its name, in
order of the first ids, when all tasks have succeeded; a failed write leaves nothing. Rows are numbered as they lie, so a table is
to be sorted by id (`repartitionByRange("id").sortWithinPartitions("id")`) before it is written.
"""

import posixpath
import struct
import uuid
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import SparkSession
from pyspark.sql.datasource import DataSource, DataSourceArrowWriter, DataSourceReader, InputPartition, WriterCommitMessage

from sparkvec.sources import binary

ARROW = {"smallint": pa.int16(), "tinyint": pa.int8(), "bigint": pa.int64(), "int": pa.int32(), "float": pa.float32()}


@dataclass
class Range(InputPartition):
    """Records of one file: n of them from the byte `start`, numbered from `first`."""

    path: str
    start: int
    record: int
    first: int
    n: int
    dim: int


class VectorReader(DataSourceReader):
    def __init__(self, options: dict[str, str]):
        self.path, self.element, self.layout = options["path"], options.get("element", "float"), options.get("layout", "bin")
        self.step = int(options.get("rangeBytes", binary.RANGE_BYTES))
        self.low, self.high = int(options.get("first", 0)), int(options.get("last", 1 << 62))

    def partitions(self) -> list[InputPartition]:
        size, out, before = np.dtype(binary.ELEMENTS[self.element][0]).itemsize, [], 0
        for path in binary.files(self.path):
            if self.layout == "bin":
                rows, dim = struct.unpack("<ii", binary.read_bytes(path, 0, 8))
                start, record = 8, size * dim
            else:
                (dim,) = struct.unpack("<i", binary.read_bytes(path, 0, 4))
                start, record = 0, 4 + size * dim
                rows = binary.size_of(path) // record
            step = max(1, self.step // max(1, record))
            # only the records of asked ids are cut into ranges
            for at in range(max(0, self.low - before), min(rows, self.high + 1 - before), step):
                n = min(step, rows - at, self.high + 1 - before - at)
                out.append(Range(path, start + at * record, record, before + at, n, dim))
            before += rows
        return out

    def read(self, partition: Range) -> Iterator[pa.RecordBatch]:
        kind, name = binary.ELEMENTS[self.element]
        raw = np.frombuffer(binary.read_bytes(partition.path, partition.start, partition.record * partition.n), np.uint8)
        raw = raw.reshape(partition.n, partition.record)[:, 0 if self.layout == "bin" else 4 :]
        x = pa.array(np.ascontiguousarray(raw).view(kind).ravel()).cast(ARROW[name])
        lists = pa.ListArray.from_arrays(pa.array(np.arange(partition.n + 1) * partition.dim, pa.int32()), x)
        yield pa.record_batch([pa.array(partition.first + np.arange(partition.n), pa.int64()), lists], ["id", "vec"])


@dataclass
class Written(WriterCommitMessage):
    path: str | None
    first: int


class VectorWriter(DataSourceArrowWriter):
    def __init__(self, options: dict[str, str], overwrite: bool):
        self.path, self.element, self.layout, self.overwrite = options["path"], options.get("element", "float"), options.get("layout", "bin"), overwrite
        self.job = uuid.uuid4().hex

    def write(self, iterator: Iterator[pa.RecordBatch]) -> Written:
        held = [b for b in iterator if b.num_rows]
        if not held:
            return Written(None, 0)
        t = pa.Table.from_batches(held)
        ids, x = t["id"].to_numpy(), binary.rectangle(t, "vec", binary.ELEMENTS[self.element][0])
        if (np.diff(ids) <= 0).any():
            raise ValueError("rows are not in order of id")
        if self.layout == "bin":
            body = struct.pack("<ii", *x.shape) + x.tobytes()
        else:
            body = np.hstack([np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8), x.view(np.uint8).reshape(len(x), -1)]).tobytes()
        system, at = binary.located(self.path)
        system.create_dir(at, recursive=True)
        name = posixpath.join(at, f"_{self.job}-{uuid.uuid4().hex}")
        with system.open_output_stream(name) as f:
            f.write(body)
        return Written(name, int(ids[0]))

    def commit(self, messages: list[Written | None]) -> None:
        system, at = binary.located(self.path)
        system.create_dir(at, recursive=True)
        before = binary.files(self.path)
        if self.overwrite:
            for p in before:
                system.delete_file(binary.located(p)[1])
        done = sorted((m for m in messages if m and m.path), key=lambda m: m.first)
        for i, m in enumerate(done, 0 if self.overwrite else len(before)):
            system.move(m.path, posixpath.join(at, f"part-{i:05d}"))

    def abort(self, messages: list[Written | None]) -> None:
        system, _ = binary.located(self.path)
        for m in messages:
            if m and m.path:
                system.delete_file(m.path)


class VectorFile(DataSource):
    @classmethod
    def name(cls) -> str:
        return "vecfile"

    def schema(self) -> str:
        return f"id long, vec array<{binary.ELEMENTS[self.options.get('element', 'float')][1]}>"

    def reader(self, schema) -> VectorReader:
        return VectorReader(dict(self.options))

    def writer(self, schema, overwrite: bool) -> VectorWriter:
        return VectorWriter(dict(self.options), overwrite)


def register(spark: SparkSession) -> None:
    """Make the format known to a session."""
    spark.dataSource.register(VectorFile)
