"""Predicates on the attributes of a row and a query: as Column expressions for joins, and as masks for the kernels.

Base rows have label, labels (array) and attr; queries have qlabel, qlabels (array), lo and hi. A missing value on either side
does not match, except that an empty set of wanted labels is part of every set. Repeated labels count once.
"""

from abc import ABC, abstractmethod

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column
from pyspark.sql import functions as F


class Predicate(ABC):
    base_columns: tuple[str, ...] = ()
    query_columns: tuple[str, ...] = ()

    @abstractmethod
    def column(self) -> Column:
        """Over the columns of a joined row."""

    @abstractmethod
    def mask(self, base: pa.RecordBatch, queries: pa.Table) -> np.ndarray | None:
        """(queries, rows) of matches; None for all."""


def _column(rows: pa.RecordBatch | pa.Table, name: str) -> np.ndarray:
    """Numbers as doubles, nulls as NaN, which matches nothing."""
    col = rows.column(rows.schema.get_field_index(name))
    col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
    return col.cast(pa.float64()).to_numpy(zero_copy_only=False)


class Always(Predicate):
    def column(self) -> Column:
        return F.lit(True)

    def mask(self, base, queries):
        return None


class LabelEquals(Predicate):
    """label = qlabel; with unknown_passes also rows without a label."""

    base_columns, query_columns = ("label",), ("qlabel",)

    def __init__(self, unknown_passes: bool = False):
        self.unknown_passes = unknown_passes

    def column(self) -> Column:
        same = F.coalesce(F.col("label") == F.col("qlabel"), F.lit(False))
        return same | F.col("label").isNull() if self.unknown_passes else same

    def mask(self, base, queries):
        label = _column(base, "label")
        same = label[None] == _column(queries, "qlabel")[:, None]
        return same | np.isnan(label)[None] if self.unknown_passes else same


class AttributeBetween(Predicate):
    """lo <= attr <= hi."""

    base_columns, query_columns = ("attr",), ("lo", "hi")

    def column(self) -> Column:
        return F.coalesce(F.col("attr").between(F.col("lo"), F.col("hi")), F.lit(False))

    def mask(self, base, queries):
        attr = _column(base, "attr")[None]
        return (attr >= _column(queries, "lo")[:, None]) & (attr <= _column(queries, "hi")[:, None])


class _Sets(Predicate):
    base_columns, query_columns = ("labels",), ("qlabels",)

    @staticmethod
    def shared(base: pa.RecordBatch, queries: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(queries, rows) of how many labels they share, the wanted sets' sizes, and which base sets are null."""

        def flat(rows, name):
            col = rows.column(rows.schema.get_field_index(name))
            col = col.combine_chunks() if isinstance(col, pa.ChunkedArray) else col
            n = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()], np.int64)
            return np.asarray(col.flatten()), np.repeat(np.arange(len(n)), n), np.asarray(col.is_null())

        wanted, of_query, no_query = flat(queries, "qlabels")
        have, of_row, no_row = flat(base, "labels")
        names = np.unique(wanted)
        q = np.zeros((queries.num_rows, len(names)), np.float32)
        q[of_query, np.searchsorted(names, wanted)] = 1
        known = np.isin(have, names)
        b = np.zeros((base.num_rows, len(names)), np.float32)
        b[of_row[known], np.searchsorted(names, have[known])] = 1
        sizes = q.sum(1)
        sizes[no_query] = np.inf
        return q @ b.T, sizes, no_row


class LabelsContain(_Sets):
    """All wanted labels are among the row's."""

    def column(self) -> Column:
        return F.coalesce(F.size(F.array_except("qlabels", "labels")) == 0, F.lit(False))

    def mask(self, base, queries):
        n, sizes, missing = self.shared(base, queries)
        return (n == sizes[:, None]) & ~missing[None]


class LabelsOverlap(_Sets):
    """Any wanted label is among the row's; not for an empty side."""

    def column(self) -> Column:
        return F.coalesce(F.arrays_overlap("qlabels", "labels"), F.lit(False))

    def mask(self, base, queries):
        n, sizes, _ = self.shared(base, queries)
        return (n > 0) & np.isfinite(sizes)[:, None]


REGISTRY = {"none": Always, "eq": LabelEquals, "range": AttributeBetween, "subset": LabelsContain, "intersect": LabelsOverlap}


def predicate(name: str, **options) -> Predicate:
    """A predicate by name. Unknown names are errors."""
    if name not in REGISTRY:
        raise ValueError(f"unknown predicate {name!r}; known: {', '.join(REGISTRY)}")
    return REGISTRY[name](**options)
