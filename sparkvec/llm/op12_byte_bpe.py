"""Byte-level BPE: encoding in length-bucketed padded matrices, and decoding.

A text is split by the pattern of the rank files; a match of the pattern is a piece, and pieces never merge across. The
distinct new pieces of a batch are laid out as rows of byte ids in matrices of one width each (the powers of two), padded
at the end. A row's pair of neighbours with the lowest rank, the leftmost among equals, is merged in each round; all rows of a matrix
take their merge at once. Ranks of pairs are looked up in an open-addressing hash table of all splits of every token, only for the two pairs that
a merge makes new. Each round takes one column out of every row, so matrices shrink, and rows that have no pair left
leave. A piece that is itself a token is that token. Pieces longer than LONG bytes are cut into short rows where that is proven
not to matter (`cuts`). A worker keeps the ids of pieces that it has met, up to KEPT bytes.

Letters, numbers and white space are what the library takes them for; another regular-expression module may know a newer Unicode, so texts
that hold characters of which the two differ are split by classes that list the library's own.

A null text is encoded as the empty one: no ids, and it decodes to no bytes. Null ids decode to null. Repeated rows each give a row; an
empty table gives an empty one. Texts of any length are encoded whole. `encode` and `decode` carry other columns along, but for
one of the name that they add, which is replaced.
"""

import base64
import hashlib
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm.common import by_bytes, settled, texts
from sparkvec.llm.cuts import in_cuts
from sparkvec.llm.words import summed
from sparkvec.session import table

#: Bytes of pieces kept at most (estimated, with ENTRY for each), ids of a matrix at most, bytes of a piece that is merged in one row.
KEPT, ENTRY, CELLS, LONG = 48 << 20, 180, 1 << 18, 256
NONE = np.iinfo(np.int32).max
PAD = -1


def ranges(points: np.ndarray) -> str:
    """Code points as the inside of a character class."""
    runs = np.split(points, np.flatnonzero(np.diff(points) != 1) + 1) if len(points) else []
    return "".join(f"\\U{r[0]:08x}-\\U{r[-1]:08x}" for r in runs)


def splitters(pattern: str) -> tuple[regex.Pattern, regex.Pattern, re.Pattern | None]:
    """The pattern for usual texts, the one with the library's letters and numbers spelled out, and what finds texts that need it."""
    import tiktoken

    every = "".join(chr(c) for c in range(0x110000) if not 0xD800 <= c < 0xE000)
    single = {bytes([b]): b for b in range(256)}
    exact, unlike = pattern, []
    for name in (r"\p{L}", r"\p{N}"):
        seen = tiktoken.Encoding("class", pat_str=name, mergeable_ranks=single, special_tokens={})
        theirs = np.array([ord(c) for c in seen.decode(seen.encode_ordinary(every))])
        ours = np.array([ord(c) for c in regex.findall(name, every)])
        unlike.append(np.setxor1d(theirs, ours))
        inside = ranges(theirs)
        exact = re.sub(r"\[\^([^\]]*)" + re.escape(name), lambda m, s=inside: f"[^{m[1]}{s}", exact)  # within a class
        exact = exact.replace(name, f"[{inside}]")
    odd = ranges(np.unique(np.concatenate(unlike)))
    return regex.compile(pattern), regex.compile(exact), re.compile(f"[{odd}]") if odd else None


class PairTable:
    """Hashed lookup of the rank of two neighbouring ids."""

    def __init__(self, keys: np.ndarray, ranks: np.ndarray):
        self.shift = np.uint64(64 - max(4, int(len(keys) * 3).bit_length()))
        self.keys = np.full(1 << int(64 - self.shift), np.uint64(0xFFFFFFFFFFFFFFFF))
        self.ranks = np.full(len(self.keys), NONE, np.int32)
        at, left = self.slot(keys), np.arange(len(keys))
        while len(left):  # one key of those that want a free slot takes it, the others go on to the next one
            free = self.keys[at] == self.keys.dtype.type(0xFFFFFFFFFFFFFFFF)
            self.keys[at[free]] = keys[left[free]]
            won = self.keys[at] == keys[left]
            self.ranks[at[won]] = ranks[left[won]]
            left, at = left[~won], (at[~won] + 1) % len(self.keys)

    def slot(self, keys: np.ndarray) -> np.ndarray:
        return ((keys * np.uint64(0x9E3779B97F4A7C15)) >> self.shift).astype(np.int64)

    def __call__(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """The ranks of pairs, NONE for those that don't merge and where either is PAD."""
        out = np.full(a.shape, NONE, np.int32).ravel()
        todo = np.flatnonzero((a.ravel() != PAD) & (b.ravel() != PAD))
        keys = (a.ravel()[todo].astype(np.uint64) << np.uint64(32)) | b.ravel()[todo].astype(np.uint64)
        at = self.slot(keys)
        while len(todo):
            held = self.keys[at]
            found = held == keys
            out[todo[found]] = self.ranks[at[found]]
            on = ~found & (held != held.dtype.type(0xFFFFFFFFFFFFFFFF))
            todo, keys, at = todo[on], keys[on], (at[on] + 1) % len(self.keys)
        return out.reshape(a.shape)


def ranks_in(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(t): int(r) for t, r in (line.split() for line in f if line.strip())}


class Tokens:
    """The bytes of every token end to end."""

    def __init__(self, ranks: dict[bytes, int]):
        raw = [b""] * (max(ranks.values()) + 1)
        for t, r in ranks.items():
            raw[r] = t
        self.raw, self.raw_n = np.frombuffer(b"".join(raw), np.uint8), np.array([len(t) for t in raw])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        n = self.raw_n[ids]
        step = np.repeat(self.raw_at[ids] - (np.cumsum(n) - n), n)
        raw = self.raw[step + np.arange(len(step))].tobytes()
        sizes = summed(n, per_text)
        ends = np.cumsum(sizes)
        return [raw[z - s : z] for s, z in zip(sizes, ends, strict=True)]


class ByteBpe(dict):
    """Piece -> number, with the ids of numbered pieces in flat arrays."""

    def __init__(self, path: str, pattern: str):
        super().__init__()
        self.rank_of = ranks_in(path)
        self.raw_n = Tokens(self.rank_of).raw_n
        self.byte = np.array([self.rank_of[bytes([b])] for b in range(256)], np.int32)
        self.pair = PairTable(*self.splits())
        self.usual, self.exact, self.odd = splitters(pattern)
        self.restart()
        settled()

    def splits(self) -> tuple[np.ndarray, np.ndarray]:
        """All pairs of tokens that make a token, packed, and its rank."""
        keys, ranks = array("Q"), array("i")
        for t, r in self.rank_of.items():
            for i in range(1, len(t)):
                a, b = self.rank_of.get(t[:i]), self.rank_of.get(t[i:])
                if a is not None and b is not None:
                    keys.append(a << 32 | b)
                    ranks.append(r)
        return np.frombuffer(keys, np.uint64), np.frombuffer(ranks, np.int32)

    def restart(self) -> None:
        self.clear()
        self.held, self.pending = 0, []
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, piece: str) -> int:
        self[piece] = n = len(self)
        self.pending.append(piece)
        self.held += len(piece) * 2 + ENTRY
        return n

    def split(self, text: str) -> list[str]:
        odd = self.odd is not None and not text.isascii() and self.odd.search(text)
        return (self.exact if odd else self.usual).findall(text)

    def merged(self, m: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The final ids of all rows end to end, and how many each has."""
        ranks, left = self.pair(m[:, :-1], m[:, 1:]), np.arange(len(m))
        out, per = [], np.zeros(len(m), np.int64)
        while len(left):
            width = m.shape[1]
            at = ranks.argmin(1) if width > 1 else np.zeros(len(left), np.int64)
            row = np.arange(len(left))
            best = ranks[row, at] if width > 1 else np.full(len(left), NONE, np.int32)
            ended = best == NONE
            if ended.any():
                inside = m[ended] != PAD
                per[left[ended]] = inside.sum(1)
                out.append((np.repeat(left[ended], inside.sum(1)), m[ended][inside]))
                m, ranks, left, at, best = m[~ended], ranks[~ended], left[~ended], at[~ended], best[~ended]
                if not len(left):
                    break
                row = np.arange(len(left))
            m[row, at] = best  # a pair's rank is the id of what it becomes
            stays = np.ones(m.shape, bool)
            stays[row, at + 1] = False
            m = m[stays].reshape(len(row), width - 1)
            stays = stays[:, 1:]  # the pair at `at` gives way to the one behind it, made new below
            ranks = ranks[stays].reshape(len(row), width - 2)
            for shift in (-1, 0):
                i = at + shift
                new = np.flatnonzero((i >= 0) & (i < width - 2))
                ranks[new, i[new]] = self.pair(m[new, i[new]], m[new, i[new] + 1])
        if not out:
            return np.zeros(0, np.int32), per
        rows, ids = (np.concatenate(x) for x in zip(*out, strict=True))
        return ids[np.argsort(rows, kind="stable")], per

    def of_spans(self, raw: np.ndarray, spans: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of spans of bytes end to end, and how many each has."""
        n = spans[:, 1] - spans[:, 0]
        per, found = np.zeros(len(n), np.int64), []
        widths = 1 << np.maximum(1, np.ceil(np.log2(np.maximum(n, 1))).astype(np.int64))
        for width in np.unique(widths):
            mine = np.flatnonzero(widths == width)
            step = max(1, CELLS // int(width))
            for a in range(0, len(mine), step):
                some = mine[a : a + step]
                at = spans[some, :1] + np.arange(width)
                inside = np.arange(width) < n[some, None]
                m = np.where(inside, self.byte[raw[np.minimum(at, len(raw) - 1)]], PAD).astype(np.int32)
                ids, per[some] = self.merged(m)
                found.append((np.repeat(some, per[some]), ids))
        if not found:
            return np.zeros(0, np.int32), per
        rows, ids = (np.concatenate(x) for x in zip(*found, strict=True))
        return ids[np.argsort(rows, kind="stable")], per

    def of_long(self, piece: bytes) -> np.ndarray:
        raw = np.frombuffer(piece, np.uint8)

        def encode(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            ids, per = self.of_spans(raw, spans)
            return ids, self.raw_n[ids], per

        return in_cuts(len(raw), encode)[0]

    def learn(self) -> None:
        new, self.pending = [p.encode() for p in self.pending], []
        ids: list[np.ndarray | None] = [None] * len(new)
        short = []
        for i, p in enumerate(new):
            if (r := self.rank_of.get(p)) is not None:
                ids[i] = np.array([r], np.int32)
            elif len(p) > LONG:
                ids[i] = self.of_long(p)
            else:
                short.append(i)
        if short:
            ends = np.cumsum([len(new[i]) for i in short])
            starts = np.append(0, ends[:-1])
            flat, per = self.of_spans(np.frombuffer(b"".join(new[i] for i in short), np.uint8), np.stack([starts, ends], 1))
            for i, x in zip(short, np.split(flat, np.cumsum(per)[:-1]), strict=True):
                ids[i] = x
        counts = np.fromiter(map(len, ids), np.int64, len(ids))
        self.starts = np.concatenate([self.starts, len(self.flat) + np.cumsum(counts) - counts])
        self.counts = np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, *ids])
        self.held += int(counts.sum()) * 4

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and how many each has."""
        if self.held > KEPT:
            self.restart()
        rows = [self.split(t) for t in texts]
        numbers = np.fromiter(map(self.__getitem__, chain.from_iterable(rows)), np.int64, sum(map(len, rows)))
        if self.pending:
            self.learn()
        n = self.counts[numbers]
        step = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n)
        return self.flat[step + np.arange(len(step))], summed(n, np.fromiter(map(len, rows), np.int64, len(rows)))


@lru_cache(maxsize=1)
def coder_of(path: str, pattern: str) -> ByteBpe:
    """One per worker process."""
    return ByteBpe(path, pattern)


@lru_cache(maxsize=1)
def tokens_of(path: str) -> Tokens:
    return Tokens(ranks_in(path))


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids", pattern: str = public_tokenizers.PATTERN, keep: list[str] | None = None) -> DataFrame:
    """df (or its columns `keep`) with the column `ids` (array<int>): the tokens of every whole text."""
    kept = [c for c in (df.columns if keep is None else keep) if c != ids]
    out = T.StructType([*df.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])
    read = kept if text in kept else [*kept, text]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path, pattern)
        for b in by_bytes(batches, text, 2 << 20):
            flat, n = coder.encode(texts(b, text))
            col = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([*b.columns[: len(kept)], col], [*kept, ids])
        coder.restart()  # the worker may be used for other things next
        settled()

    return df.select(*read).mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids: str = "ids", decoded: str = "decoded") -> DataFrame:
    """df with the column `decoded` (binary): the bytes that the ids stand for."""
    kept = [c for c in df.columns if c != decoded]
    out = T.StructType([*df.select(*kept).schema.fields, T.StructField(decoded, T.BinaryType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = tokens_of(path)
        for b in batches:
            col = b.column(kept.index(ids))
            n = np.diff(col.offsets.to_numpy())
            n[~np.asarray(col.is_valid())] = 0
            got = tokens.decode(col.flatten().to_numpy(), n)
            got = [g if ok else None for g, ok in zip(got, col.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(got, pa.binary())], [*kept, decoded])

    return df.select(*kept).mapInArrow(run, out)


def digests(df: DataFrame, path: str, key: str = "doc_id", text: str = "text", pattern: str = public_tokenizers.PATTERN) -> DataFrame:
    """key, n_tokens, and the SHA-256 of every whole text's ids and of what they decode to, without the ids leaving the worker."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, tokens = coder_of(path, pattern), tokens_of(path)
        for b in by_bytes(batches, "text", 1 << 20):
            ids, n = coder.encode(texts(b))
            ends = np.cumsum(n)
            listed = [",".join(map(str, ids[z - k : z].tolist())) for k, z in zip(n, ends, strict=True)]
            cols = [[hashlib.sha256(x).hexdigest() for x in some] for some in (map(str.encode, listed), tokens.decode(ids, n))]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), *map(pa.array, cols)], ["key", "n_tokens", "ids_sha256", "decoded_sha256"])
        coder.restart()
        settled()

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, "key long, n_tokens long, ids_sha256 string, decoded_sha256 string").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, and digests of the ids and of the decoded bytes of all documents."""
    return digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_multi_50k.tiktoken"))
