"""What several of these operators need: the shared folder, size-checked broadcasts and text batches."""

__all__ = ["BROADCAST_BYTES", "by_bytes", "settled", "shared_dir", "small_enough", "texts", "written"]

import ctypes
import gc
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sparkvec.session import shared_dir, written

#: A side is broadcast up to this many bytes, counted first; beyond it the join shuffles.
BROADCAST_BYTES = 64 << 20


def small_enough(df: DataFrame, row_bytes: int, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its counted rows stay below the limit."""
    return F.broadcast(df) if df.count() * row_bytes <= limit else df


def settled() -> None:
    """Give free memory back to the system: workers are reused, and what one stage has freed should not count in the next."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU library
    if trim is not None:
        trim(0)


def texts(batch: pa.RecordBatch, name: str = "text") -> list[str]:
    """The strings of a column; a null is the empty text."""
    return [t or "" for t in batch.column(batch.schema.get_field_index(name)).to_pylist()]


def by_bytes(rows: Iterator[pa.RecordBatch], name: str = "text", most: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Cut batches so that none holds much more than `most` bytes of text (one row at least)."""
    for b in rows:
        col = b.column(b.schema.get_field_index(name))
        size = pc.fill_null(pc.binary_length(col), 0).to_numpy(zero_copy_only=False)
        ends, at = np.cumsum(size), 0
        while at < len(size):
            stop = int(np.searchsorted(ends, (ends[at - 1] if at else 0) + most, side="right"))
            stop = max(stop, at + 1)
            yield b.slice(at, stop - at)
            at = stop
