"""A tokenizer of the word-BPE kind as a deterministic finite-state transducer over characters, with token counts on transitions.

The sum of what the transitions emit is at every place the number of tokens of the text read so far, so a transition emits the
difference that its character makes, which may be negative (a join) or zero.

States know where they are in the pre-tokenizer's pattern (between pre-tokens, in letters, in marks, behind an apostrophe that may
become a contraction) and, inside a pre-token, how byte-pair merges stand: for every place where a token that is not finished
may have begun, the text since then, the token that ends there, and the count up to there, less the count so far. A token that ends
at the new character follows from these alone: of the candidates only one fits the token before it. Such places reach back no
further than the longest token, and counts are relative, so the states are finite. They are made when first entered; up to
MOST_STATES are kept with their transitions, rarer ones are made again.
"""

import json
import os
import re
from functools import lru_cache

END = "</w>"
#: Without these, Python's lower() does what the tokenizer's normalizer does.
ODD = re.compile("[\x1c-\x1fİɐ-\U0010ffff]")
SPACE, LETTER, DIGIT, MARK = range(4)
#: Modes: between pre-tokens, in letters, in marks, behind a first apostrophe, behind that and one letter.
BETWEEN, LETTERS, MARKS, QUOTE, HALF = range(5)
#: The pre-tokenizer's contractions.
CONTRACTIONS = ("'s", "'t", "'re", "'ve", "'m", "'ll", "'d")
#: States kept at most: a bound on memory, not on what is counted.
MOST_STATES = 150_000

Word = tuple[tuple[str, int, int], ...]
#: Before a pre-token: nothing open, no token, count 0.
FRESH: Word = (("", -1, 0),)


Key = tuple[int, Word, str]


class State(dict):
    """Character -> (next state, emitted)."""

    __slots__ = ("key", "machine")

    def __init__(self, machine: "Machine", key: Key):
        super().__init__()
        self.machine, self.key = machine, key

    def __missing__(self, c: str) -> "tuple[State, int]":
        step = self.machine.step(self.key, c)
        if step[0].key in self.machine.states:
            self[c] = step
        return step


class Merges:
    """The vocabulary with its merges undone: every token is of two, or a byte."""

    def __init__(self, model: dict):
        self.vocab: dict[str, int] = model["vocab"]
        self.parts = {}
        self.joined = {}
        for m in model["merges"]:
            a, b = m if isinstance(m, list) else m.split(" ")
            i = self.vocab[a + b]
            self.parts[i] = x, y = self.vocab[a], self.vocab[b]
            self.joined[x, y] = i
        plain = {t.removesuffix(END) for t in self.vocab}
        self.prefixes = {t[:n]: t[:n] for t in plain for n in range(1, len(t))}
        self.sound: dict[int, bool] = {}
        self.known: dict[tuple[int, int], bool] = {}

    def apart(self, a: int, b: int, before: float) -> bool:
        """Whether neighbours a and b never merge across their border, by merges that come before the given one.

        Goes back in time: of the two tokens at the border the one that was merged last is taken apart.
        """
        while True:
            if self.joined.get((a, b), before) < before:
                return False
            x, y = self.parts.get(a), self.parts.get(b)
            if x is None and y is None:
                return True
            if y is None or (x is not None and a > b):
                before, a = a, x[1]  # equal merges are made from the left, so b's may not be before a's
            else:
                before, b = b + 1, y[0]

    def whole(self, i: int) -> bool:
        """Whether the merges of a token's bytes give the token."""
        if i not in self.sound:
            p = self.parts.get(i)
            self.sound[i] = p is None or (self.whole(p[0]) and self.whole(p[1]) and self.apart(*p, i))
        return self.sound[i]

    def fits(self, a: int, b: int) -> bool:
        """Whether token b may follow token a (-1: a pre-token's start)."""
        if a < 0:
            return self.whole(b)
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 4 * MOST_STATES:
                self.known.clear()
            got = self.known[a, b] = self.whole(b) and self.apart(a, b, float("inf"))
        return got


class Machine:
    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.library = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            read = json.load(f)
        self.merges = Merges(read["model"])
        special = [re.escape(t["content"]) for t in read["added_tokens"]]
        self.special = re.compile("|".join(special)) if special else None
        # a byte's character in the vocabulary: printable ones stand for themselves, the others follow from U+0100 on
        shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
        hidden = [b for b in range(256) if b not in shown]
        self.symbol = {b: chr(b) for b in shown} | {b: chr(0x100 + i) for i, b in enumerate(hidden)}
        self.classes: dict[str, int] = {}
        self.states: dict[Key, State] = {}
        self.start = self.state(BETWEEN, FRESH)

    def state(self, mode: int, word: Word, half: str = "") -> State:
        key = (mode, word, half)
        got = self.states.get(key)
        if got is None:
            got = State(self, key)
            if len(self.states) < MOST_STATES:
                self.states[key] = got
        return got

    def class_of(self, c: str) -> int:
        """What the pre-tokenizer takes a character for, by trial."""
        got = self.classes.get(c)
        if got is None:
            n = self.library.normalizer.normalize_str(c)
            tried = self.library.pre_tokenizer.pre_tokenize_str
            got = SPACE if not tried(n) else LETTER if len(tried(f"a{n}a")) == 1 else DIGIT if len(tried(n + n)) == 2 * len(n) else MARK
            self.classes[c] = got
        return got

    def read(self, word: Word, c: str) -> tuple[Word, int]:
        """The merges behind one more character, and how many tokens that adds if the pre-token ends here."""
        symbols = [self.symbol[b] for b in c.encode()]
        m = self.merges
        for k, s in enumerate(symbols):
            if k == len(symbols) - 1:
                added = next(n + 1 for pre, t, n in word if (i := m.vocab.get(pre + s + END)) is not None and m.fits(t, i))
            ahead = [(p, t, n) for pre, t, n in word if (p := m.prefixes.get(pre + s)) is not None]
            token, n = next((i, n + 1) for pre, t, n in word if (i := m.vocab.get(pre + s)) is not None and m.fits(t, i))
            word = (*ahead, ("", token, n))
        return tuple((pre, t, n - added) for pre, t, n in word), added

    def step(self, key: Key, c: str) -> tuple[State, int]:
        mode, word, half = key
        kind = self.class_of(c)
        if mode == LETTERS and kind == LETTER or mode in (MARKS, QUOTE) and kind == MARK:
            word, added = self.read(word, c)
            return self.state(MARKS if kind == MARK else LETTERS, word), added
        if mode == QUOTE and "'" + c in CONTRACTIONS:
            return self.start, self.count("'" + c) - self.count("'")
        if mode == QUOTE and any(x.startswith("'" + c) for x in CONTRACTIONS):
            word, added = self.read(FRESH, c)
            return self.state(HALF, word, c), added
        if mode == HALF:
            if "'" + half + c in CONTRACTIONS:
                return self.start, self.count("'" + half + c) - self.count("'") - self.count(half)
            return self.step((LETTERS, word, ""), c)
        if kind == SPACE:
            return self.start, 0
        word, added = self.read(FRESH, c)
        if kind == DIGIT:
            return self.start, added
        return self.state(LETTERS if kind == LETTER else QUOTE if c == "'" else MARKS, word), added

    def count(self, pre_token: str) -> int:
        word, n = FRESH, 0
        for c in pre_token:
            word, added = self.read(word, c)
            n += added
        return n

    def pieces(self, text: str) -> tuple[list[str], int]:
        """The normalized texts between special strings, and how many of these there are."""
        parts = self.special.split(text) if self.special and "<|" in text else [text]
        return [self.library.normalizer.normalize_str(p) if ODD.search(p) else p.lower() for p in parts if p], len(parts) - 1


def run(s: State, text: str) -> tuple[State, int]:
    """The state behind a text, and what is emitted."""
    n = 0
    for c in text:
        s, k = s[c]
        n += k
    return s, n


class ChunkMap:
    """A chunk of text as a map from the state before it to the state behind it and what is emitted.

    It is found from the start state, with marks on the way. From another state it is found until the two ways meet.
    """

    MARK_EVERY = 256

    def __init__(self, start: State, text: str):
        self.text, self.marks = text, [(start, 0)]
        self.known: dict[Key, tuple[State, int]] = {}
        s, n = start, 0
        for at in range(0, len(text), self.MARK_EVERY):
            s, k = run(s, text[at : at + self.MARK_EVERY])
            n += k
            self.marks.append((s, n))
        self.known[start.key] = s, n

    def __call__(self, s: State) -> tuple[State, int]:
        got = self.known.get(s.key)
        if got is None:
            before, n = s.key, 0
            for i, at in enumerate(range(0, len(self.text), self.MARK_EVERY), 1):
                s, k = run(s, self.text[at : at + self.MARK_EVERY])
                n += k
                met, m = self.marks[i]
                if met is s or met.key == s.key:
                    end, total = self.marks[-1]
                    s, n = end, n + total - m
                    break
            got = self.known[before] = s, n
        return got


class Composed:
    """First a, then b."""

    def __init__(self, a, b):
        self.a, self.b = a, b

    def __call__(self, s: State) -> tuple[State, int]:
        s, n = self.a(s)
        s, k = self.b(s)
        return s, n + k


def scanned(maps: list) -> list:
    """All prefixes' maps: pairs are composed, the pairs' prefixes found in the same way, then the ones between."""
    if len(maps) < 2:
        return maps
    wide = scanned([Composed(a, b) for a, b in zip(maps[::2], maps[1::2], strict=False)])
    return [maps[0], *(wide[i // 2] if i % 2 else Composed(wide[i // 2 - 1], maps[i]) for i in range(1, len(maps)))]


def count_text(machine: Machine, text: str, chunk: int) -> int:
    """The number of tokens of a text, cut into chunks."""
    parts, total = machine.pieces(text)
    for p in parts:
        maps = [ChunkMap(machine.start, p[i : i + chunk]) for i in range(0, len(p), chunk)]
        total += scanned(maps)[-1](machine.start)[1]
    return total


@lru_cache(maxsize=1)
def machine_of(path: str) -> Machine:
    """One per worker process."""
    return Machine(path)
