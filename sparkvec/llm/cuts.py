"""Exact merging of long runs in short pieces that are encoded side by side.

Merges take the best pair of neighbours, the leftmost among equals, whatever stands further away. So the encoding of a text is that of
its two parts end to end if the last token of the first and the first token of the second stay as they are when encoded
alone together: the first merge across the cut would also come up between just these two. Cuts are proposed where a block's
encoding has a boundary near its middle, and those that fail this test are dropped until none fails.
"""

from collections.abc import Callable

import numpy as np

#: Encodes the spans [from, to) of a text: ids and lengths of all tokens end to end, and the number of tokens of each span.
Encode = Callable[[np.ndarray], tuple[np.ndarray, np.ndarray, np.ndarray]]
BLOCK = 128


def in_cuts(n: int, encode: Encode, block: int = BLOCK) -> tuple[np.ndarray, np.ndarray]:
    """Ids and lengths of the tokens of a run of length n."""
    first = np.arange(0, n, block)
    _, lengths, _ = encode(np.stack([first, np.minimum(first + block, n)], 1))
    ends = np.cumsum(lengths)
    middle = np.minimum(first + block // 2, n - 1)
    cuts = np.unique(ends[np.searchsorted(ends, middle)])
    cuts = cuts[cuts < n]
    while True:
        at = np.concatenate([[0], cuts, [n]])
        ids, lengths, per = encode(np.stack([at[:-1], at[1:]], 1))
        if not len(cuts):
            return ids, lengths
        behind = np.cumsum(per)[:-1]  # the first token after each cut
        left, right = lengths[behind - 1], lengths[behind]
        _, pair_lengths, pair_n = encode(np.stack([cuts - left, cuts + right], 1))
        holds = (pair_n == 2) & (pair_lengths[np.cumsum(pair_n) - pair_n] == left)
        if holds.all():
            return ids, lengths
        cuts = cuts[holds]
