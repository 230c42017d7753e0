"""Suffix trees by Ukkonen's construction, and the longest common extensions that they give.

The text is a list of small non-negative ints. Longest common extensions are lowest common ancestors of leaves, found in the
Euler tour of the tree as the shallowest node between two visits: a constant number of lookups in a table of range minima.
Questions are put in bulk, so the rows of that table (one for each power of two) are made one after another and only one is held.
"""

from array import array

import numpy as np

END = 0


class SuffixTree:
    """The tree of text with an end symbol that sorts before all others.

    depth and leaf_at (the node of the suffix that begins there, by position) are arrays over nodes, rank orders the suffixes.
    """

    def __init__(self, text: list[int]):
        self.n = len(text) + 1
        self._build([c + 1 for c in text] + [END])
        self._tour()

    def _build(self, text: list[int]) -> None:
        n = self.n
        start, end, link = array("i", [-1]), array("i", [-1]), array("i", [0])  # edge labels [start, end); an open end is n
        step: dict[int, int] = {}  # node and first symbol, packed -> child
        node, edge, length, left = 0, 0, 0, 0  # the active point and the suffixes still to be put in
        for i in range(n):
            c, left, last = text[i], left + 1, 0
            while left:
                if length == 0:
                    edge = i
                key = node << 32 | text[edge]
                child = step.get(key)
                if child is None:
                    step[key] = len(start)
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    if last:
                        link[last], last = node, 0
                else:
                    size = (end[child] if end[child] < i + 1 else i + 1) - start[child]
                    if length >= size:
                        node, edge, length = child, edge + size, length - size
                        continue
                    if text[start[child] + length] == c:
                        length += 1
                        if last:
                            link[last] = node
                        break
                    mid = len(start)
                    start.append(start[child])
                    end.append(start[child] + length)
                    link.append(0)
                    step[key] = mid
                    start.append(i)
                    end.append(n)
                    link.append(0)
                    step[mid << 32 | c] = mid + 1
                    start[child] += length
                    step[mid << 32 | text[start[child]]] = child
                    if last:
                        link[last] = mid
                    last = mid
                left -= 1
                if node == 0 and length:
                    length -= 1
                    edge = i - left + 1
                elif node:
                    node = link[node]
        self.start, self.end, self.step = start, end, step

    def _tour(self) -> None:
        """Visits of the nodes in depth-first order, children in order of their first symbol."""
        size = len(self.start)
        key = np.fromiter(self.step, np.int64, size - 1)
        child = np.fromiter(self.step.values(), np.int64, size - 1)
        self.step = None
        order = np.argsort(key)
        kids = array("i", child[order].astype(np.int32).tobytes())
        first = array("i", np.searchsorted(key[order] >> 32, np.arange(size + 1)).astype(np.int32).tobytes())
        length = array("i", (np.array(self.end) - np.array(self.start)).astype(np.int32).tobytes())
        depth, seen, tour, leaves = array("i", bytes(4 * size)), array("i", bytes(4 * size)), array("i"), array("i")
        stack, upto = [0], array("i", first[:-1])
        while stack:
            v = stack[-1]
            k = upto[v]
            tour.append(v)
            if k == first[v]:
                seen[v] = len(tour) - 1
                if k == first[v + 1]:
                    leaves.append(v)
            if k < first[v + 1]:
                upto[v] = k + 1
                c = kids[k]
                depth[c] = depth[v] + length[c]
                stack.append(c)
            else:
                stack.pop()
        self.depth = np.array(depth)
        self.tour_depth = self.depth[tour]
        place = self.n - self.depth[leaves]  # of each leaf's suffix, in order of the suffixes
        self.rank = np.empty(self.n, np.int64)
        self.rank[place] = np.arange(self.n)
        self.seen = np.empty(self.n, np.int64)
        self.seen[place] = np.array(seen)[leaves]
        self.start = self.end = None

    def extension(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """The lengths of the longest common prefixes of the suffixes at i and j (from 0 to n, the empty suffix)."""
        a, z = np.minimum(self.seen[i], self.seen[j]), np.maximum(self.seen[i], self.seen[j])
        level = np.frexp((z - a + 1).astype(np.float64))[1] - 1  # the largest power of two inside
        out = np.zeros(len(a), np.int64)
        least, width = self.tour_depth, 1
        for k in range(int(level.max(initial=-1)) + 1):
            mine = level == k
            out[mine] = np.minimum(least[a[mine]], least[z[mine] + 1 - width])
            least = np.minimum(least[:-width], least[width:])
            width *= 2
        return out
