"""Words of a `tokenizers` file whose tokens never span white space, each encoded by the library once and kept.

For such a file the ids of a text are those of its white-space separated segments, one after another: the pre-tokenizer
drops white space, and normalization does not reach across it. Special strings hold no white space, so the library also
meets them whole inside a segment. A word of plain letters is one pre-token, and a comma or full stop after it another.
"""

import os
import re
from functools import lru_cache

import numpy as np

#: Cuts here are white space to every part of the tokenizer; rarer white space stays inside a segment.
CUTS = re.compile("[ \t\n\r]+")
#: Without these, Python's lower() and split() do what the tokenizer's normalizer does.
ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
PLAIN = re.compile("[a-zß-öø-ÿ]+")
END_OF_WORD = "</w>"
#: Bytes of segments kept at most (estimated, with ENTRY for each); beyond it the table starts anew. A bound on memory, not on what is counted.
KEPT, ENTRY = 256 << 20, 180
#: Plain words that are encoded in one call.
JOINED = 1000


def segments(text: str) -> list[str]:
    return CUTS.split(text) if "<|" in text or ODD.search(text) else text.lower().split()  # special strings are met in their own case only


class Segments(dict):
    """Segment -> number, with the ids of numbered segments in flat arrays."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), bool)
        self.ends[[i for s, i in self.tokenizer.get_vocab().items() if s.endswith(END_OF_WORD)]] = True
        self.restart()

    def restart(self) -> None:
        self.clear()
        self.held = 0
        self.pending: list[str] = []
        self.flat = np.zeros(0, np.uint32)
        self.counts = np.zeros(0, np.int64)
        self.starts = np.zeros(0, np.int64)

    def __missing__(self, segment: str) -> int:
        self[segment] = n = len(self)
        self.pending.append(segment)
        self.held += len(segment) + ENTRY
        return n

    def numbers(self, parts: list[str]) -> np.ndarray:
        """The segments' numbers, good until the next call."""
        if self.held > KEPT:
            self.restart()
        out = np.fromiter(map(self.__getitem__, parts), np.int64, len(parts))
        if self.pending:
            self.resolve()
        return out

    def resolve(self) -> None:
        """Have the library encode the segments that came up since."""
        base, plain, other, pairs = len(self.counts), [], [], []
        for s in self.pending:  # grows meanwhile, as a word comes up that has only been seen with a mark
            n = self.get(s)
            if PLAIN.fullmatch(s):
                plain.append(n)
            elif s[-1:] in (",", ".") and PLAIN.fullmatch(s, 0, len(s) - 1):
                pairs.append((n, self[s[:-1]], self[s[-1]]))
            else:
                other.append(n)
        words, self.pending = self.pending, []
        new = [words[n - base] for n in plain]
        ids = [np.array(e.ids, np.uint32) for e in self.tokenizer.encode_batch_fast([" ".join(new[i : i + JOINED]) for i in range(0, len(new), JOINED)], add_special_tokens=False)]
        ids = np.concatenate(ids) if ids else np.zeros(0, np.uint32)
        self.add(np.array(plain, np.int64), ids, np.diff(np.flatnonzero(self.ends[ids]), prepend=-1), len(words))
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([words[n - base] for n in other], add_special_tokens=False)]
        self.add(np.array(other, np.int64), np.array([i for x in rest for i in x], np.uint32), np.fromiter(map(len, rest), np.int64, len(rest)))
        if pairs:
            p = np.array(pairs, np.int64)
            ids, n = self.ids(p[:, 1:].ravel())
            self.add(p[:, 0], ids, n.reshape(-1, 2).sum(1))

    def add(self, numbers: np.ndarray, ids: np.ndarray, counts: np.ndarray, more: int = 0) -> None:
        self.counts, self.starts = (np.concatenate([a, np.zeros(more, np.int64)]) for a in (self.counts, self.starts))
        self.counts[numbers], self.starts[numbers] = counts, len(self.flat) + np.cumsum(counts) - counts
        self.flat = np.concatenate([self.flat, ids])

    def ids(self, numbers: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the numbered segments end to end, and how many each has."""
        n = self.counts[numbers]
        step = np.repeat(self.starts[numbers] - (np.cumsum(n) - n), n)
        return self.flat[step + np.arange(len(step))], n

    def of_texts(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """The numbers of all texts' segments end to end, and the segments of each text."""
        rows = [segments(t) for t in texts]
        return self.numbers([s for r in rows for s in r]), np.fromiter(map(len, rows), np.int64, len(rows))


def summed(values: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Sums of consecutive runs of these lengths, 0 for empty ones."""
    upto = np.concatenate([[0], np.cumsum(values)])
    ends = np.cumsum(lengths)
    return upto[ends] - upto[ends - lengths]


@lru_cache(maxsize=1)
def segments_of(path: str) -> Segments:
    """One table per worker process and file."""
    return Segments(path)
