"""Readers and writers of the usual binary vector files, little-endian.

`bin`: int32 rows, int32 columns, then the matrix; row number = id. `vecs`: each record is its dimension and its elements.
`labels`: uint32 count, then a byte each. `csr`: int64 rows, columns, entries; int64 row pointers; int32 columns; float32 values,
a label is present if its value is not 0. `truth`: int32 queries, int32 K, ids, optionally float32 distances, optionally tags.
`graph`: uint64 size, uint32 width, uint32 entry, uint64 frozen, then per node its degree and neighbours.

Fixed-length files are read in row ranges, one range per partition, through pyarrow's file systems; a folder of files is read
in order of name with ids running on. Writers make a folder with a file per partition.
"""

import posixpath
import struct
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

ELEMENTS = {"float": ("<f4", "float"), "uint8": ("<u1", "smallint"), "int8": ("<i1", "tinyint"), "uint32": ("<u4", "bigint"), "int32": ("<i4", "int")}
RANGE_BYTES = 64 << 20


def located(path: str) -> tuple[fs.FileSystem, str]:
    return fs.FileSystem.from_uri(path) if "://" in path else (fs.LocalFileSystem(), path)


def files(path: str) -> list[str]:
    """The path itself, or a folder's data files in order."""
    system, at = located(path)
    if system.get_file_info(at).type != fs.FileType.Directory:
        return [path]
    names = sorted(i.base_name for i in system.get_file_info(fs.FileSelector(at)) if i.is_file and i.base_name[0] not in "._")
    return [posixpath.join(path, n) for n in names]


def read_bytes(path: str, at: int, n: int) -> bytes:
    system, name = located(path)
    with system.open_input_file(name) as f:
        return f.read_at(n, at)


def size_of(path: str) -> int:
    system, name = located(path)
    return system.get_file_info(name).size


def metadata(path: str) -> tuple[int, int]:
    """Rows and columns of a `bin` file or folder."""
    heads = [struct.unpack("<ii", read_bytes(p, 0, 8)) for p in files(path)]
    return sum(n for n, _ in heads), max((d for _, d in heads), default=0)


def _ranges(spark: SparkSession, spans: list[tuple[str, int, int, int, int, int]], element: str, lead: int) -> DataFrame:
    """spans: (file, first byte, bytes of a record, first id, rows, columns); lead: bytes of a record before its elements."""
    kind, name = ELEMENTS[element]
    plan = []
    for path, start, record, first, rows, dim in spans:
        step = max(1, RANGE_BYTES // record)
        plan += [(path, start + at * record, record, first + at, min(step, rows - at), dim) for at in range(0, rows, step)]
    ask = spark.createDataFrame(plan, "path string, start long, record long, first long, n long, dim long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, start, record, first, n, dim in zip(*(c.to_pylist() for c in b.columns), strict=True):
                raw = np.frombuffer(read_bytes(path, start, record * n), np.uint8).reshape(n, record)[:, lead:]
                x = np.ascontiguousarray(raw).view(kind).astype({"smallint": "i2", "tinyint": "i1", "bigint": "i8", "int": "i4", "float": "f4"}[name])
                lists = pa.ListArray.from_arrays(pa.array(np.arange(n + 1) * dim, pa.int32()), pa.array(x.ravel()))
                yield pa.record_batch([pa.array(first + np.arange(n)), lists], ["id", "vec"])

    return ask.repartition(max(1, len(plan))).mapInArrow(run, f"id long, vec array<{name}>")


def read_bin(spark: SparkSession, path: str, element: str = "float", offset: int = 0) -> DataFrame:
    """id and vec of a matrix file; offset: bytes before its header."""
    size, spans, first = np.dtype(ELEMENTS[element][0]).itemsize, [], 0
    for p in files(path):
        n, dim = struct.unpack("<ii", read_bytes(p, offset, 8))
        spans.append((p, offset + 8, size * dim, first, n, dim))
        first += n
    return _ranges(spark, spans, element, 0)


def read_vecs(spark: SparkSession, path: str, element: str = "float") -> DataFrame:
    """id and vec of an fvecs, bvecs or ivecs file."""
    size, spans, first = np.dtype(ELEMENTS[element][0]).itemsize, [], 0
    for p in files(path):
        total = size_of(p)
        if total:
            (dim,) = struct.unpack("<i", read_bytes(p, 0, 4))
            record = 4 + dim * size
            spans.append((p, 0, record, first, total // record, dim))
            first += total // record
    return _ranges(spark, spans, element, 4)


def write_parts(df: DataFrame, path: str, order: str, columns: list[str], encode: Callable[[pa.Table], bytes]) -> int:
    """Rows in order of a column, one file per range partition, each with its own header; the number of rows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = [b for b in batches if b.num_rows]
        if held:
            t = pa.Table.from_batches(held)
            system, at = located(path)
            system.create_dir(at, recursive=True)
            with system.open_output_stream(posixpath.join(at, f"part-{t['part'][0].as_py():05d}")) as f:
                f.write(encode(t))
        yield pa.record_batch([pa.array([sum(b.num_rows for b in held)], pa.int64())], ["n"])

    ranged = df.repartitionByRange(order).sortWithinPartitions(order).select(*columns, F.spark_partition_id().alias("part"))
    return ranged.mapInArrow(run, "n long").agg(F.sum("n")).first()[0] or 0


def rectangle(t: pa.Table, name: str, kind: str) -> np.ndarray:
    """A list column of equal lengths as a matrix."""
    col = t[name].combine_chunks()
    return np.asarray(col.flatten()).reshape(len(col), -1).astype(kind)


def write_files(df: DataFrame, path: str, element: str, order: str, header: bool) -> int:
    def encode(t: pa.Table) -> bytes:
        x = rectangle(t, "vec", ELEMENTS[element][0])
        if header:
            return struct.pack("<ii", *x.shape) + x.tobytes()
        dims = np.full((len(x), 1), x.shape[1], "<i4").view(np.uint8)
        return np.hstack([dims, x.view(np.uint8).reshape(len(x), -1)]).tobytes()

    return write_parts(df, path, order, ["vec"], encode)


def write_labels(df: DataFrame, path: str, order: str = "id") -> int:
    """label (0 to 255) in order of id."""
    return write_parts(df, path, order, ["label"], lambda t: struct.pack("<I", t.num_rows) + t["label"].to_numpy().astype("<u1").tobytes())


def write_csr(df: DataFrame, path: str, columns: int, order: str = "id") -> int:
    """labels (arrays; null as empty) in order of id."""

    def encode(t: pa.Table) -> bytes:
        sets = [sorted(set(x or [])) for x in t["labels"].to_pylist()]
        flat = np.array([x for r in sets for x in r], "<i4")
        at = np.cumsum([0, *map(len, sets)]).astype("<i8")
        return struct.pack("<qqq", len(sets), columns, len(flat)) + at.tobytes() + flat.tobytes() + np.ones(len(flat), "<f4").tobytes()

    return write_parts(df, path, order, ["labels"], encode)


def write_truth(df: DataFrame, path: str, k: int) -> int:
    """qid, rk, id, dist as ids, distances and tags (the ids); missing ranks are -1 with the largest distance."""
    rows = F.map_from_entries(F.collect_list(F.struct("rk", F.struct("id", "dist"))))
    wide = df.where(F.col("rk") <= k).groupBy("qid").agg(rows.alias("m"))
    ranks = F.array(*(F.lit(i).cast("long") for i in range(1, k + 1)))
    ids = F.transform(ranks, lambda r: F.coalesce(F.try_element_at("m", r)["id"], F.lit(-1).cast("long")))
    dists = F.transform(ranks, lambda r: F.coalesce(F.try_element_at("m", r)["dist"], F.lit(3.4028234663852886e38)))

    def encode(t: pa.Table) -> bytes:
        x = rectangle(t, "ids", "<i4")
        return struct.pack("<ii", *x.shape) + x.tobytes() + rectangle(t, "dists", "<f4").tobytes() + x.astype("<u4").tobytes()

    return write_parts(wide.select("qid", ids.alias("ids"), dists.alias("dists")), path, "qid", ["ids", "dists"], encode)


def write_graph(df: DataFrame, path: str, width: int, entry: int) -> int:
    """id and nbrs in order of id; a node's number is its place in the order."""

    def encode(t: pa.Table) -> bytes:
        body = b"".join(struct.pack("<I", len(n)) + np.array(n, "<u4").tobytes() for n in t["nbrs"].to_pylist())
        return struct.pack("<QIIQ", 24 + len(body), width, entry, 0) + body

    return write_parts(df, path, "id", ["nbrs"], encode)


def write_text_labels(df: DataFrame, path: str, order: str = "id") -> None:
    """One label per line, in order of id."""
    df.repartitionByRange(order).sortWithinPartitions(order).select(F.col("label").cast("string")).write.text(path)


def write_bin(df: DataFrame, path: str, element: str = "float", order: str = "id") -> int:
    return write_files(df, path, element, order, header=True)


def write_vecs(df: DataFrame, path: str, element: str = "float", order: str = "id") -> int:
    return write_files(df, path, element, order, header=False)


def read_labels(spark: SparkSession, path: str) -> DataFrame:
    """id and label of a label file or folder."""
    spans, first = [], 0
    for p in files(path):
        (n,) = struct.unpack("<I", read_bytes(p, 0, 4))
        spans.append((p, 4, 1, first, n, 1))
        first += n
    return _ranges(spark, spans, "uint8", 0).select("id", F.element_at("vec", 1).cast("int").alias("label"))


def read_csr(spark: SparkSession, path: str) -> DataFrame:
    """id and labels (sorted) of a label matrix file or folder; rows without any have an empty array."""
    step, plan, before = 1 << 20, [], 0
    for p in files(path):
        rows, _, entries = struct.unpack("<qqq", read_bytes(p, 0, 24))
        plan += [(p, rows, entries, before, a, min(step, rows - a)) for a in range(0, rows, step)]
        before += rows
    ask = spark.createDataFrame(plan, "path string, rows long, entries long, before long, first long, n long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, rows, entries, before, first, n in zip(*(c.to_pylist() for c in b.columns), strict=True):
                columns_at = 24 + 8 * (rows + 1)
                at = np.frombuffer(read_bytes(path, 24 + 8 * first, 8 * (n + 1)), "<i8")
                some = int(at[-1] - at[0])
                cols = np.frombuffer(read_bytes(path, columns_at + 4 * int(at[0]), 4 * some), "<i4")
                vals = np.frombuffer(read_bytes(path, columns_at + 4 * entries + 4 * int(at[0]), 4 * some), "<f4")
                sets = [np.sort(cols[a:z][vals[a:z] != 0]).tolist() for a, z in zip(at[:-1] - at[0], at[1:] - at[0], strict=True)]
                yield pa.record_batch([pa.array(before + first + np.arange(n)), pa.array(sets, pa.list_(pa.int32()))], ["id", "labels"])

    return ask.repartition(max(1, len(plan))).mapInArrow(run, "id long, labels array<int>")


def read_truth(spark: SparkSession, path: str) -> DataFrame:
    """qid, rk, id, dist, tag of a truth file or folder; the layout follows from the size, and ids of -1 are padding."""
    heads, first = [], 0
    for p in files(path):
        n, k = struct.unpack("<ii", read_bytes(p, 0, 8))
        heads.append((p, n, k, first))
        first += n
    fields = min((size_of(p) - 8) // max(1, 4 * n * k) for p, n, k, _ in heads)

    def column(i: int, element: str) -> DataFrame:
        spans = [(p, 8 + 4 * n * k * i, 4 * k, at, n, k) for p, n, k, at in heads]
        return _ranges(spark, spans, element, 0).select(F.col("id").alias("qid"), F.posexplode("vec").alias("at", f"c{i}"))

    out = column(0, "int32")
    for i, element in ((1, "float"), (2, "uint32")):
        if fields > i:
            out = out.join(column(i, element), ["qid", "at"])
    dist = F.col("c1").cast("double") if fields > 1 else F.lit(None).cast("double")
    tag = F.col("c2") if fields > 2 else F.col("c0").cast("long")
    return out.where("c0 <> -1").select("qid", (F.col("at") + 1).cast("long").alias("rk"), F.col("c0").cast("long").alias("id"), dist.alias("dist"), tag.alias("tag"))


def read_graph(spark: SparkSession, path: str) -> tuple[DataFrame, dict[str, int]]:
    """(id and nbrs; width, entry and frozen). Records vary in length, so one task walks a file."""
    size, width, entry, frozen = struct.unpack("<QIIQ", read_bytes(path, 0, 24))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, total in zip(*(c.to_pylist() for c in b.columns), strict=True):
                system, at = located(name)
                with system.open_input_stream(at) as f:
                    f.read(24)
                    done, node, ids, nbrs = 24, 0, [], []
                    while done < total:
                        (degree,) = struct.unpack("<I", f.read(4))
                        ids.append(node)
                        nbrs.append(np.frombuffer(f.read(4 * degree), "<u4").astype("i8").tolist())
                        done, node = done + 4 + 4 * degree, node + 1
                        if len(ids) == 10_000:
                            yield pa.record_batch([pa.array(ids), pa.array(nbrs, pa.list_(pa.int64()))], ["id", "nbrs"])
                            ids, nbrs = [], []
                    yield pa.record_batch([pa.array(ids, pa.int64()), pa.array(nbrs, pa.list_(pa.int64()))], ["id", "nbrs"])

    table = spark.createDataFrame([(path, size)], "path string, size long").mapInArrow(run, "id long, nbrs array<long>")
    return table, {"width": width, "entry": entry, "frozen": frozen}
