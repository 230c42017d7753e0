"""SentencePiece encoding and decoding by suffix-array matching.

The distinct new segments of a batch (a run of spaces with the characters up to the next one, which no piece crosses) are
laid end to end. A suffix array of that text, sorted by as many characters as the longest piece has, is searched by bisection
for every piece of the vocabulary: each has one range of suffixes that begin with it. All ranges together are the edges
(start, piece), put in order of position. Relaxation then follows the model's kind: for a BPE model, the best-scored edge
that joins two neighbouring symbols of a segment replaces them, leftmost first among equals, until no edge joins any;
characters without a piece become their bytes. That gives the library's own ids. Segments longer than IN_STEP are cut into short ones
where that is proven not to matter (`cuts`). Segments' ids are kept, so a segment is matched once per worker.

Decoding joins the pieces' bytes and drops the space that encoding puts in front.

A null text is encoded as the empty one: no ids. A space character U+2581 in a text counts as a space, as in the library, so
such texts don't come back the same. Repeated rows each give a row; an empty table gives an empty one. Other columns are not
read by the query; `encode` carries them along.
"""

import re
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm.common import by_bytes, settled, texts
from sparkvec.llm.cuts import in_cuts
from sparkvec.llm.words import summed
from sparkvec.session import table

SPACE = "▁"
SEGMENT = re.compile(f"{SPACE}+[^{SPACE}]*")
#: Bytes of segments kept at most (estimated), characters indexed at once, longest segment that is relaxed in step with others.
KEPT, INDEXED, IN_STEP = 64 << 20, 200_000, 192
#: What a kept segment takes besides its characters and ids.
ENTRY = 180
NONE = -1


class Pieces:
    """A model's pieces: the normal ones as packed keys for the search, all of them as bytes for decoding."""

    def __init__(self, path: str):
        import sentencepiece

        m = sentencepiece.SentencePieceProcessor(model_file=path)
        n = m.vocab_size()
        text = [m.id_to_piece(i) for i in range(n)]
        special = [m.is_control(i) or m.is_unknown(i) or m.is_byte(i) or m.is_unused(i) for i in range(n)]
        self.ids = np.array([i for i in range(n) if not special[i]], np.int32)
        self.score = np.array([m.get_score(i) for i in range(n)])
        self.byte = np.full(256, m.unk_id(), np.int32)
        for i in range(n):
            if m.is_byte(i):
                self.byte[int(text[i][1:-1], 16)] = i
        self.by_text = {text[i]: int(i) for i in self.ids}
        self.length = np.array([len(text[i]) for i in self.ids])
        self.longest = int(self.length.max())
        self.newlines = any("\n" in text[i] for i in self.ids)
        alphabet = sorted({c for i in self.ids for c in text[i]})
        self.code = np.ones(0x110000, np.uint16)  # 0 ends a segment, 1 is in no piece
        self.code[[ord(c) for c in alphabet]] = np.arange(2, len(alphabet) + 2)
        low = np.zeros((len(self.ids), self.longest), ">u2")
        high = np.full((len(self.ids), self.longest), 0xFFFF, ">u2")
        for r, i in enumerate(self.ids):
            low[r, : len(text[i])] = high[r, : len(text[i])] = self.code[[ord(c) for c in text[i]]]
        self.low, self.high = packed(low), packed(high)
        raw = [b"" if m.is_control(i) else bytes([int(text[i][1:-1], 16)]) if m.is_byte(i) else text[i].replace(SPACE, " ").encode() for i in range(n)]
        self.raw, self.raw_n = np.frombuffer(b"".join(raw), np.uint8), np.array([len(x) for x in raw])
        self.raw_at = np.cumsum(self.raw_n) - self.raw_n


def packed(codes: np.ndarray) -> np.ndarray:
    """Rows of codes as byte strings that sort as the rows do."""
    return np.ascontiguousarray(codes).view(f"S{codes.shape[1] * 2}")[:, 0]


def edges(p: Pieces, text: np.ndarray) -> np.ndarray:
    """table[position, length - 1]: the id of the piece that begins there with that length, or NONE. text: codes, 0 after each segment."""
    wide = np.concatenate([text, np.zeros(p.longest, np.uint16)]).astype(">u2")
    windows = np.lib.stride_tricks.sliding_window_view(wide, p.longest)[: len(text)]
    suffixes = packed(windows)
    order = np.argsort(suffixes, kind="stable")
    suffixes = suffixes[order]
    first, last = np.searchsorted(suffixes, p.low, "left"), np.searchsorted(suffixes, p.high, "right")
    n = last - first
    piece = np.repeat(np.arange(len(n)), n)
    at = order[np.arange(n.sum()) - np.repeat(np.cumsum(n) - n, n) + np.repeat(first, n)]
    by_position = np.argsort(at * (p.longest + 1) + p.length[piece], kind="stable")
    at, piece = at[by_position], piece[by_position]
    table = np.full((len(text), p.longest), NONE, np.int32)
    table[at, p.length[piece] - 1] = p.ids[piece]
    return table


def relaxed(p: Pieces, table: np.ndarray, starts: np.ndarray, lengths: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, length and segment of the final symbols, in order."""
    seg = np.repeat(np.arange(len(starts)), lengths)
    start = np.arange(len(seg)) - np.repeat(np.cumsum(lengths) - lengths, lengths) + starts[seg]
    length = np.ones(len(seg), np.int64)
    done = [(start[:0], length[:0], seg[:0])]
    score = np.append(p.score, -np.inf)  # of NONE
    while len(seg):
        both = length + np.append(length[1:], 0)
        joins = np.append(seg[1:] == seg[:-1], False) & (both <= p.longest)
        gain = np.where(joins, score[table[start, np.minimum(both, p.longest) - 1]], -np.inf)
        firsts = np.flatnonzero(np.append(True, seg[1:] != seg[:-1]))
        best = np.maximum.reduceat(gain, firsts)
        per = np.diff(np.append(firsts, len(seg)))
        ended = np.repeat(best == -np.inf, per)
        done.append((start[ended], length[ended], seg[ended]))
        hit = np.flatnonzero((gain == np.repeat(best, per)) & ~ended)
        hit = hit[np.append(True, seg[hit][1:] != seg[hit][:-1])] if len(hit) else hit
        length[hit] = both[hit]
        stays = ~ended
        stays[hit + 1] = False
        start, length, seg = start[stays], length[stays], seg[stays]
    start, length, seg = (np.concatenate(x) for x in zip(*done, strict=True))
    order = np.argsort(start, kind="stable")
    return start[order], length[order], seg[order]


class Segments(dict):
    """Segment -> number, with the ids of numbered segments in flat arrays."""

    def __init__(self, path: str):
        super().__init__()
        self.pieces = Pieces(path)
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.pending: list[str] = []
        self.held = 0
        self.flat, self.counts, self.starts = np.zeros(0, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.pending.append(segment)
        return n

    def cut(self, text: str) -> list[str]:
        """Segments; one without leading space or newline stands for itself with a space before it."""
        if not text:
            return []
        if SPACE in text or "  " in text or " \n" in text or text[0] == " " or text[-1] == " " or (self.pieces.newlines and "\n" in text):
            return SEGMENT.findall(SPACE + text.replace(" ", SPACE))
        if text[0] == "\n":
            return [SPACE, *text.replace("\n", " \n").split(" ")[1:]]
        return text.replace("\n", " \n").split(" ")

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        if self.held > KEPT:
            self.restart()
        rows = [self.cut(t) for t in texts]
        flat = [s for r in rows for s in r]
        numbers = np.fromiter(map(self.__getitem__, flat), np.int64, len(flat))
        new, self.pending = self.pending, []
        size = 0
        at = 0
        for i, s in enumerate(new):
            size += len(s) + 2
            if size >= INDEXED:
                self.learn(new[at : i + 1])
                at, size = i + 1, 0
        if at < len(new):
            self.learn(new[at:])
        return numbers, np.fromiter(map(len, rows), np.int64, len(rows))

    def pieces_of(self, whole: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids (NONE for a character without a piece) and lengths of the pieces of short segments end to end, and how many each has."""
        p = self.pieces
        lengths = np.fromiter(map(len, whole), np.int64, len(whole))
        points = np.frombuffer(("\0".join(whole) + "\0").encode("utf-32-le", "surrogatepass"), np.uint32)
        starts = np.cumsum(lengths + 1) - lengths - 1
        codes = p.code[points]
        codes[starts + lengths] = 0
        table = edges(p, codes)
        start, length, seg = relaxed(p, table, starts, lengths)
        return table[start, length - 1], length, np.bincount(seg, minlength=len(whole))

    def of_long(self, segment: str) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """The same for one segment of any length."""

        def encode(spans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            each, at = [], 0
            size = np.cumsum(spans[:, 1] - spans[:, 0])
            while at < len(spans):  # as much at once as is indexed
                stop = max(at + 1, int(np.searchsorted(size, (size[at - 1] if at else 0) + INDEXED)))
                each.append(self.pieces_of([segment[a:z] for a, z in spans[at:stop].tolist()]))
                at = stop
            return tuple(np.concatenate(x) for x in zip(*each, strict=True))

        ids, lengths = in_cuts(len(segment), encode, IN_STEP // 2)
        return ids, lengths, np.array([len(ids)])

    def learn(self, new: list[str]) -> None:
        p = self.pieces
        whole = [s if s[0] in (SPACE, "\n") else SPACE + s for s in new]
        long = [i for i, s in enumerate(whole) if len(s) > IN_STEP]
        short = [i for i, s in enumerate(whole) if len(s) <= IN_STEP]
        found = [self.of_long(whole[i]) for i in long] + ([self.pieces_of([whole[i] for i in short])] if short else [])
        ids, lengths, n_pieces = (np.concatenate(x) for x in zip(*found, strict=True))
        text = "".join(whole[i] for i in [*long, *short])
        begins = np.cumsum(lengths) - lengths
        per = np.ones(len(ids), np.int64)
        unknown = np.flatnonzero(ids == NONE)
        for i in unknown:  # a character without a piece: its bytes
            per[i] = len(text[begins[i]].encode("utf-8", "surrogatepass"))
        out = np.repeat(ids, per)
        at = np.cumsum(per) - per
        for i in unknown:
            out[at[i] : at[i] + per[i]] = p.byte[list(text[begins[i]].encode("utf-8", "surrogatepass"))]
        counts, starts = np.zeros(len(new), np.int64), np.zeros(len(new), np.int64)
        order = np.array([*long, *short])
        counts[order] = summed(per, n_pieces)
        starts[order] = len(self.flat) + np.cumsum(counts[order]) - counts[order]
        self.starts, self.counts = np.concatenate([self.starts, starts]), np.concatenate([self.counts, counts])
        self.flat = np.concatenate([self.flat, out.astype(np.int32)])
        self.held += len(text) * 2 + len(out) * 4 + len(new) * ENTRY

    def encode(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All texts' ids end to end, and how many each has."""
        numbers, per_text = self.of_texts(texts)
        n = self.counts[numbers]
        step = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n)
        return self.flat[step + np.arange(len(step))], summed(n, per_text)

    def decode(self, ids: np.ndarray, per_text: np.ndarray) -> list[bytes]:
        """The texts' UTF-8 bytes."""
        p = self.pieces
        n = p.raw_n[ids]
        step = np.repeat(p.raw_at[ids] - (np.cumsum(n) - n), n)
        raw = p.raw[step + np.arange(len(step))].tobytes()
        sizes = summed(n, per_text)
        ends = np.cumsum(sizes)
        return [raw[z - s + (raw[z - s : z - s + 1] == b" ") : z] for s, z in zip(sizes, ends, strict=True)]


@lru_cache(maxsize=1)
def segments_of(path: str) -> Segments:
    return Segments(path)


def encode(df: DataFrame, path: str, text: str = "text", ids: str = "ids") -> DataFrame:
    """df with the column `ids` (array<int>): the pieces of every whole text. A column of that name is replaced."""
    kept = [c for c in df.columns if c != ids]
    out = T.StructType([*df.select(*kept).schema.fields, T.StructField(ids, T.ArrayType(T.IntegerType()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segments_of(path)
        for b in by_bytes(batches, text, 2 << 20):
            flat, n = known.encode(texts(b, text))
            col = pa.ListArray.from_arrays(pa.array(np.append(0, np.cumsum(n)), pa.int32()), pa.array(flat, pa.int32()))
            yield pa.record_batch([*b.columns, col], [*kept, ids])
        known.restart()  # the worker may be used for other things next
        settled()

    return df.select(*kept).mapInArrow(run, out)


def decode(df: DataFrame, path: str, ids: str = "ids", text: str = "decoded") -> DataFrame:
    """df with the text that the ids stand for; null ids give null. A column of that name is replaced."""
    kept = [c for c in df.columns if c != text]
    out = T.StructType([*df.select(*kept).schema.fields, T.StructField(text, T.StringType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segments_of(path)
        for b in batches:
            col = b.column(kept.index(ids))
            n = np.array([0 if x is None else x for x in pc.list_value_length(col).to_pylist()], np.int64)
            got = known.decode(col.flatten().to_numpy(), n)
            got = [g.decode("utf-8", "replace") if ok else None for g, ok in zip(got, col.is_valid().to_pylist(), strict=True)]
            yield pa.record_batch([*b.columns, pa.array(got, pa.string())], [*kept, text])

    return df.select(*kept).mapInArrow(run, out)


def round_trip(df: DataFrame, path: str, text: str = "text", key: str = "doc_id") -> DataFrame:
    """key, n_tokens, the CRC-32 of the ids as little-endian unsigned 32-bit integers, and whether decoding gives the text back."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = segments_of(path)
        for b in by_bytes(batches, "text", 2 << 20):
            whole = texts(b)
            flat, n = known.encode(whole)
            same = [g == t.encode() for g, t in zip(known.decode(flat, n), whole, strict=True)]
            raw, ends = flat.astype("<u4").tobytes(), np.cumsum(n) * 4
            crc = [zlib.crc32(raw[z - 4 * k : z]) for k, z in zip(n, ends, strict=True)]
            yield pa.record_batch([b.column(0), pa.array(n, pa.int64()), pa.array(crc, pa.int64()), pa.array(same)], ["key", "n_tokens", "ids_crc32", "decoded_same"])
        known.restart()
        settled()

    src = df.select(F.col(key).cast("long").alias("key"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    return src.mapInArrow(run, "key long, n_tokens long, ids_crc32 long, decoded_same boolean").withColumnRenamed("key", key)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, n_tokens, ids_crc32 and decoded_same of all documents."""
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path("piece_bpe_32k.model"))
