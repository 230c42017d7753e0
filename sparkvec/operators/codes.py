"""Kinds of codes by name: trained, saved and opened alike, so that every search takes any of them."""

from collections.abc import Callable
from typing import NamedTuple

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.operators.quantization import Codebook, Coder, opened_codebook, train

SAVED = "kind string, chunk int, start int, width int, center int, vec array<double>, mean array<double>"


class RotatedBits(NamedTuple):
    """One bit a dimension: the signs of the centred, randomly rotated vector, with its length and how much of it the signs keep.

    A unit vector o and its signs s (scaled to length 1) give the estimate <s, q> / <s, o> of <o, q>; over random rotations it is right
    on average, and off by more than `error` only rarely. A row is its bits in ints of 32, then the two numbers as bits of floats.
    """

    rotation: np.ndarray
    mean: np.ndarray

    @property
    def dim(self) -> int:
        return len(self.mean)

    def codes(self, x: np.ndarray) -> np.ndarray:
        words = -(-self.dim // 32)
        if not x.size:
            return np.zeros((0, words + 2), np.int32)
        y = (x - self.mean) @ self.rotation.T
        size = np.sqrt((y * y).sum(1))
        kept = np.abs(y).sum(1) / np.sqrt(self.dim) / np.where(size > 0, size, 1)
        bits = np.zeros((len(y), words * 32), np.uint8)
        bits[:, : self.dim] = y > 0
        packed = np.packbits(bits, axis=1, bitorder="little").view("<i4")
        return np.concatenate([packed, size.astype("<f4").view("<i4")[:, None], kept.astype("<f4").view("<i4")[:, None]], 1)

    def parts(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Signs (scaled to length 1), lengths and shares kept."""
        raw = np.ascontiguousarray(codes.astype("<i4"))
        bits = np.unpackbits(np.ascontiguousarray(raw[:, :-2]).view(np.uint8), axis=1, bitorder="little")[:, : self.dim]
        size, kept = (np.ascontiguousarray(raw[:, i]).view("<f4").astype(float) for i in (-2, -1))
        return (2.0 * bits - 1) / np.sqrt(self.dim), size, np.where(kept > 0, kept, 1)

    def scorer(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        y = ((q - self.mean) if metric == "l2" else q) @ self.rotation.T

        def distances(some: np.ndarray, codes: np.ndarray) -> np.ndarray:
            signs, size, kept = self.parts(codes)
            products = y[some] @ signs.T / kept * size
            return (y[some] ** 2).sum(1)[:, None] + size**2 - 2 * products if metric == "l2" else -products

        return distances

    def paired(self, q: np.ndarray, metric: str) -> Callable[[np.ndarray, np.ndarray], np.ndarray]:
        y = ((q - self.mean) if metric == "l2" else q) @ self.rotation.T

        def distances(some: np.ndarray, codes: np.ndarray) -> np.ndarray:
            signs, size, kept = self.parts(codes)
            products = (y[some] * signs).sum(1) / kept * size
            return (y[some] ** 2).sum(1) + size**2 - 2 * products if metric == "l2" else -products

        return distances

    def rowwise(self, q: np.ndarray, codes: np.ndarray, metric: str) -> np.ndarray:
        if not len(codes):
            return np.zeros(0)
        y = ((q - self.mean) if metric == "l2" else q) @ self.rotation.T
        signs, size, kept = self.parts(codes)
        products = (y * signs).sum(1) / kept * size
        return (y * y).sum(1) + size**2 - 2 * products if metric == "l2" else -products

    def error(self, q: np.ndarray, codes: np.ndarray, deviations: float = 3.0) -> np.ndarray:
        """How far `rowwise` l2 distances may be off, at so many standard deviations of the rotation."""
        _, size, kept = self.parts(codes)
        length = np.sqrt(((q - self.mean) ** 2).sum(1))
        return 2 * size * length * np.sqrt(np.maximum(1 - kept**2, 0)) / kept * deviations / np.sqrt(max(1, self.dim - 1))

    def rows(self) -> list[tuple]:
        return [("bits", 0, 0, self.dim, i, r.tolist(), self.mean.tolist()) for i, r in enumerate(self.rotation)]


def rotated(df: DataFrame, dim: int, seed: int) -> RotatedBits:
    """A random rotation around the mean of all rows: nothing else is trained."""
    mean = F.array(*(F.avg(F.element_at("vec", i + 1)) for i in range(dim)))
    mean = df.where("vec is not null").where(F.size("vec") == dim).agg(mean).first()[0]
    q, r = np.linalg.qr(np.random.default_rng(seed).normal(size=(dim, dim)))
    return RotatedBits(q * np.sign(np.diag(r)), np.array(mean, float))


#: Kind -> training from (rows, dim, chunks, centres, seed).
CODERS: dict[str, Callable[[DataFrame, int, int, int, int], Coder]] = {
    "pq": lambda df, dim, chunks, centers, seed: train(df, dim, min(chunks, dim), centers, seed=seed),
    "bits": lambda df, dim, chunks, centers, seed: rotated(df, dim, seed),
}


def trained(kind: str, df: DataFrame, dim: int, chunks: int, centers: int, seed: int) -> Coder:
    if kind not in CODERS:
        raise ValueError(f"unknown codes {kind!r}; known: {', '.join(CODERS)}")
    return CODERS[kind](df, dim, chunks, centers, seed)


def save(spark: SparkSession, coder: Coder, to: str) -> None:
    spark.createDataFrame(coder.rows(), SAVED).coalesce(1).write.parquet(to)


def opened(spark: SparkSession, at: str) -> Coder:
    rows = spark.read.parquet(at).collect()  # as many as centres, or dimensions
    if rows and rows[0].kind == "bits":
        rows = sorted(rows, key=lambda r: r.center)
        return RotatedBits(np.array([r.vec for r in rows], float), np.array(rows[0].mean, float))
    return opened_codebook(rows) if rows else Codebook([], [], np.zeros(0))
