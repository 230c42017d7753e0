"""Column builders over array columns: distances, norms, normalisation, chunks, and index arithmetic.

All sums run over the elements in order and in double precision, so results do not depend on partitioning. A null operand
gives null; arrays of different lengths give null, as a missing element does.
"""

import sys

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Largest inner product of normalised vectors by element type: fixed values of the data formats.
FULL = {"float": 1.0, "uint8": 65025.0, "int8": 16129.0}
SCALE = {"float": 1.0, "uint8": 255.0, "int8": 127.0}
#: Squared norms below this count as zero.
TINY = 1.1920928955078125e-07
SECTOR = 4096
GREATEST_FLOAT = 3.4028234663852886e38


def doubles(v: Column | str) -> Column:
    return (F.col(v) if isinstance(v, str) else v).cast("array<double>")


def total(a: Column) -> Column:
    return F.aggregate(a, F.lit(0.0), lambda s, x: s + x)


def l2_sq(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: (x - y) * (x - y)))


def inner(a: Column, b: Column) -> Column:
    return total(F.zip_with(doubles(a), doubles(b), lambda x, y: x * y))


def cosine(a: Column, b: Column, element: str = "float") -> Column:
    """1 - <a, b> for normalised floats, and the like for bytes; the same order as `ip`."""
    return F.lit(FULL[element]) - inner(a, b)


def norm_sq(v: Column) -> Column:
    return total(F.transform(doubles(v), lambda x: x * x))


def l1_norm(v: Column) -> Column:
    return total(F.transform(doubles(v), F.abs))


def distance(metric: str, a: Column, b: Column, element: str = "float") -> Column:
    """An order-preserving distance by metric name: l2, cosine, ip (mips is another name). Unknown names are errors."""
    kinds = {"l2": lambda: l2_sq(a, b), "cosine": lambda: cosine(a, b, element), "ip": lambda: cosine(a, b, element), "mips": lambda: cosine(a, b, element)}
    if metric not in kinds:
        raise ValueError(f"unknown metric {metric!r}; known: {', '.join(kinds)}")
    return kinds[metric]()


def normalize(v: Column, element: str = "float") -> Column:
    """To length 1 (or 255, 127 with rounding for bytes); all zeros for a vector that is next to zero."""
    n = norm_sq(v)
    scaled = F.transform(doubles(v), lambda x: x / F.sqrt(n) * F.lit(SCALE[element]))
    if element != "float":
        scaled = F.transform(scaled, lambda x: F.round(x))
    return F.when(n < TINY, F.transform(doubles(v), lambda x: F.lit(0.0))).otherwise(scaled)


def chunk_bounds(dim: int, chunks: int) -> list[tuple[int, int]]:
    """(offset, length) of each chunk in natural order; the first dim mod chunks get one more."""
    out, at = [], 0
    for c in range(chunks):
        n = dim // chunks + (c < dim % chunks)
        out.append((at, n))
        at += n
    return out


def chunked(v: Column, dim: int, chunks: int) -> Column:
    """Array of the chunks' arrays."""
    return F.array(*(F.slice(doubles(v), at + 1, n) for at, n in chunk_bounds(dim, chunks)))


def occlude_factor(metric: str, to_other: Column, between: Column) -> Column:
    """How far a neighbour at `between` from another, which is `to_other` from the node, hides that other one."""
    if metric in ("l2", "cosine"):
        return F.when(between == 0, F.lit(GREATEST_FLOAT)).otherwise(to_other / between)
    both_ways = F.when(between > 0, to_other / between).when(to_other < 0, between / to_other).otherwise(F.lit(GREATEST_FLOAT))
    return F.when(to_other > between, both_ways).otherwise(F.lit(0.0))


def ram_estimate(n: Column, dim: Column, size: int, degree: int) -> Column:
    """Bytes that building a graph over n vectors takes, with slack for neighbours and overhead."""
    return F.lit(1.1) * (n.cast("double") * float(degree) * 4.0 * 1.3 + (n * dim * size).cast("double"))


def node_length(dim: int, degree: int, size: int = 4, label_size: int = 0) -> int:
    return (degree + 1) * 4 + dim * size + label_size


def sector_of(at: Column, length: int) -> tuple[Column, Column]:
    """Sector (from 1) and place in it of the node at a position."""
    per = SECTOR // length
    if per:
        return F.floor(at / per) + 1, at % per
    return at * -(-length // SECTOR) + 1, F.lit(0).cast("long")


def sample_rate(n: int, share: float = 0.1, most: int = 256_000) -> float:
    """The training sample's rate: min(share of n, most) rows, one at least."""
    return max(1.0, min(share * n, most)) / max(n, 1) if n else sys.float_info.min
