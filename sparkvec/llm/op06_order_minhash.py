"""Near-duplicate documents by Order MinHash, verified by banded alignment.

A document is its sequence of words. Every k-mer of two words is labelled with how often it occurred before in the document.
Each of the sketches takes the `picked` labelled k-mers that are least under its own hash and keeps them in text order; equal
sketches make candidates, more often the smaller the edit distance, as moved text changes the order. Exact copies are one
representative. A pair is near if the word edit distance, found in a band around the diagonal, leaves a similarity of 0.8. In
every bucket of equal sketches the members are first aligned with one head, and those outside its class with further heads; then
every pair of the bucket that is still in different classes, unless lengths or parities of words rule it out for certain.
Classes are the components of near pairs, named by their smallest document id.

The k-mers follow from the threshold: where one word in five is replaced, at even spacing, no five-word k-mer is left, but three
of five pairs of words are. With 32 sketches of 2 picked pairs such a pair is missed with a probability of 0.0015, and one
with a word in ten replaced below 1e-6; documents of up to 40 words have sketches of single words.

Null and empty texts are the document without words: all these are copies of each other. Repeated rows each get a row; rows
with a null id get a null class. An empty table gives an empty one. Other columns are not read by `classes`; `deduplicated`
keeps them.
"""

from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from sparkvec.llm.common import by_bytes, settled, small_enough, texts, written
from sparkvec.llm.components import components
from sparkvec.session import final, scratch, table

K, SKETCHES, PICKED, NEAR = 2, 32, 2, 0.8
#: Documents of up to SHORT words have sketches of single words, those from LONG words on of K words; near ones share a kind.
SHORT, LONG = 40, 32
#: 64-bit words of parities of any document, rounds of heads, members of a bucket that one task pairs with the others.
MARKS, STARS, PART = 8, 2, 1024
#: Bits of a document's own parities: at least so many a word, but no more than that in all.
OWN_BITS, MOST_BITS = 4, 1 << 20
#: Pairs of one text that meet it in one task.
SIDE_PAIRS = 256
MOST = np.uint64(0xFFFFFFFFFFFFFFFF)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that scatters them."""
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return x ^ (x >> np.uint64(32))


def word_hashes(text: str) -> np.ndarray:
    words = text.split()
    return np.fromiter(map(xxh64_intdigest, words), np.uint64, len(words))


def kmers(docs: list[np.ndarray], k: int) -> tuple[np.ndarray, np.ndarray]:
    """Labelled k-mers of all documents end to end, and how many each has."""
    n = np.array([len(d) for d in docs], np.int64)
    short = np.flatnonzero(n < k)
    docs = list(docs)
    for i in short:  # padded to one k-mer
        docs[i] = np.concatenate([docs[i], np.ones(k - len(docs[i]), np.uint64)])
    n = np.maximum(n, k)
    flat = np.concatenate(docs) if docs else np.zeros(0, np.uint64)
    per = n - k + 1
    ends = np.cumsum(n)
    at = np.arange(per.sum()) - np.repeat(np.cumsum(per) - per, per) + np.repeat(ends - n, per)
    h = np.zeros(len(at), np.uint64)
    for j in range(k):
        h = mixed(h + flat[at + j])
    doc = np.repeat(np.arange(len(n)), per).astype(np.uint64)
    own = mixed(h + mixed(doc + np.uint64(1)))
    order = np.argsort(own, kind="stable")
    same = np.append(False, own[order][1:] == own[order][:-1])
    if same.any():
        place = np.arange(len(same))
        run = place - np.maximum.accumulate(np.where(same, 0, place))
        seen = np.zeros(len(h), np.uint64)
        seen[order] = run
        h = np.where(seen > 0, mixed(h + seen), h)
    return h, per


def sketches(docs: list[np.ndarray], k: int = K, m: int = SKETCHES, picked: int = PICKED) -> np.ndarray:
    """(documents, m) keys."""
    h, per = kmers(docs, k)
    if not len(per):
        return np.zeros((0, m), np.uint64)
    starts = np.cumsum(per) - per
    out = np.zeros((len(per), m), np.uint64)
    for i in range(m):
        v = mixed(h ^ mixed(np.uint64([i + 1])))
        at = np.full((picked, len(per)), np.iinfo(np.int64).max)
        for r in range(min(picked, int(per.max()))):
            least = np.minimum.reduceat(v, starts)
            hit = np.flatnonzero((v == np.repeat(least, per)) & (v < MOST))
            of = np.searchsorted(starts, hit, "right") - 1
            at[r, of[::-1]] = hit[::-1]
            v[hit] = MOST
        key = np.full(len(per), i + 1, np.uint64)
        for row in np.sort(at, axis=0):
            there = row < len(h)
            key = np.where(there, mixed(key * np.uint64(31) + h[np.minimum(row, len(h) - 1)]), key)
        out[:, i] = key
    return out


def sketch_lists(docs: list[np.ndarray]) -> pa.ListArray:
    """Each document's keys: of single words if it is short, of K-mers if it is long, both in between."""
    n = np.array([len(d) for d in docs], np.int64)
    short, long = np.flatnonzero(n <= SHORT), np.flatnonzero(n >= LONG)
    of = np.concatenate([np.repeat(short, SKETCHES), np.repeat(long, SKETCHES)])
    single = mixed(sketches([docs[i] for i in short], 1) + np.uint64(1))  # apart from the keys of K-mers
    keys = np.concatenate([single.ravel(), sketches([docs[i] for i in long]).ravel()])
    ends = np.concatenate([[0], np.cumsum(SKETCHES * ((n <= SHORT).astype(np.int64) + (n >= LONG)))])
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(keys[np.argsort(of, kind="stable")].view(np.int64), pa.int64()))


def anchored(x: np.ndarray, y: np.ndarray, k: int = 3) -> int:
    """The cost of the alignment that follows k-mers which both have once, in an order that both share: never below the edit distance."""

    def once(a: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        h = a[: len(a) - k + 1].copy()
        for j in range(1, k):
            h = mixed(h + a[j : len(a) - k + 1 + j])
        u, at, n = np.unique(h, return_index=True, return_counts=True)
        return u[n == 1], at[n == 1]

    if min(len(x), len(y)) < k:
        return max(len(x), len(y))
    (ux, ax), (uy, ay) = once(x), once(y)
    _, i, j = np.intersect1d(ux, uy, assume_unique=True, return_indices=True)
    order = np.argsort(ax[i])
    px, py = ax[i][order], ay[j][order]
    if len(py) > 1 and (np.diff(py) <= 0).any():  # longest increasing subsequence
        tails: list[int] = []
        at: list[int] = []
        back = [-1] * len(py)
        for n, v in enumerate(py.tolist()):
            p = bisect_left(tails, v)
            back[n] = at[p - 1] if p else -1
            tails[p : p + 1], at[p : p + 1] = [v], [n]
        keep, n = [], at[-1]
        while n >= 0:
            keep.append(n)
            n = back[n]
        px, py = px[keep[::-1]], py[keep[::-1]]
    # words of anchors, each matched once; anchors overlap only along one diagonal
    fresh = np.append(True, (np.diff(px) != np.diff(py))) if len(px) else np.zeros(0, bool)
    cost, ex, ey = 0, 0, 0
    for a, b, new in zip(px.tolist(), py.tolist(), fresh.tolist(), strict=True):
        if a >= ex and b >= ey:
            cost += max(a - ex, b - ey)
            ex, ey = a + k, b + k
        elif not new or a - ex == b - ey:
            ex, ey = a + k, b + k
    return cost + max(len(x) - ex, len(y) - ey)


def banded(x: np.ndarray, y: np.ndarray, band: int) -> int:
    """The edit distance if it is at most `band`, else something above. A column of differences is two numbers of len(x) bits."""
    n, m = len(x), len(y)
    if abs(n - m) > band:
        return band + 1
    if not n:
        return m
    at: dict[int, int] = {}
    for i, w in enumerate(x.tolist()):
        at[w] = at.get(w, 0) | (1 << i)
    full, last, cost = (1 << n) - 1, 1 << (n - 1), n
    more, less = full, 0  # where a cell is one above, or one below, the cell before it in its column
    for left, w in enumerate(y.tolist(), 1 - m):
        same = at.get(w, 0)
        down = same | less
        along = (((same & more) + more) ^ more) | same
        up, low = less | (full & ~(along | more)), more & along
        cost += 1 if up & last else -1 if low & last else 0
        if cost + left > band:  # what is left lowers it by one a word at most
            return band + 1
        up, low = (up << 1) | 1, low << 1
        more, less = full & (low | ~(down | up)), full & up & down
    return cost


def near(x: np.ndarray, y: np.ndarray, least: float = NEAR) -> bool:
    """1 - edit distance / longer length >= least, in words."""
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    if abs(len(x) - len(y)) > most:
        return False
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[:short] != y[:short])
    head = int(differ[0]) if len(differ) else short
    x, y = x[head:], y[head:]
    short = min(len(x), len(y))
    differ = np.flatnonzero(x[::-1][:short] != y[::-1][:short])
    tail = int(differ[0]) if len(differ) else short
    x, y = x[: len(x) - tail], y[: len(y) - tail]
    if min(len(x), len(y)) == 0:
        return True
    _, codes = np.unique(np.concatenate([x, y]), return_inverse=True)
    a, b = np.bincount(codes[: len(x)], minlength=codes.max() + 1), np.bincount(codes[len(x) :], minlength=codes.max() + 1)
    if max(np.maximum(a - b, 0).sum(), np.maximum(b - a, 0).sum()) > most:
        return False
    if anchored(x, y) <= most:
        return True
    return banded(x, y, most) <= most


def marks(docs: list[np.ndarray]) -> tuple[pa.ListArray, pa.ListArray]:
    """Parities of each document's words: MARKS words of bits, and a larger power of two of them, by its length.

    A word, labelled with how often it occurred before, flips the bit that its hash names. Low bits name it, so bits fold by halves.
    """
    h, per = kmers(docs, 1)
    bits = np.full(len(per), 64 * MARKS)
    while (small := (bits < OWN_BITS * per) & (bits < MOST_BITS)).any():
        bits[small] *= 2
    ends = np.cumsum(bits)
    cell = np.repeat(ends - bits, per) + (h & np.repeat(bits - 1, per).astype(np.uint64)).astype(np.int64)
    own = np.packbits((np.bincount(cell, minlength=bits.sum()) & 1).astype(np.uint8)).view(np.int64)
    folded = np.bitwise_xor.reduceat(own.reshape(-1, MARKS), (ends - bits) // (64 * MARKS)) if len(per) else own
    first = np.append(0, ends // 64)
    return (
        pa.ListArray.from_arrays(pa.array(np.arange(len(per) + 1) * MARKS, pa.int32()), pa.array(folded.ravel(), pa.int64())),
        pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(own, pa.int64())),
    )


def edits(least: float) -> Column:
    """The largest edit distance of near documents a and b."""
    return F.floor((1 - least) * F.greatest(F.col("a.n"), F.col("b.n")) + 1e-9)


def flips(least: float) -> Column:
    """The most bits that these edits flip: two each, but one where the length changes."""
    return 2 * edits(least) - F.abs(F.col("a.n") - F.col("b.n"))


def may(least: float) -> Column:
    """Whether documents a and b can be near by lengths and marks. Loses none."""
    apart = sum((F.bit_count(F.get("a.marks", F.lit(i)).bitwiseXOR(F.get("b.marks", F.lit(i)))) for i in range(MARKS)), F.lit(0))
    return (F.abs(F.col("a.n") - F.col("b.n")) <= edits(least)) & (apart <= flips(least))


def may_still(least: float) -> Column:
    """As may, by the documents' own bits. Lengths that differ by less than half give as many bits, or twice as many, which fold."""

    def fitted(x: Column, other: Column) -> Column:
        half = (F.size(x) / 2).cast("int")
        folded = F.zip_with(F.slice(x, 1, half), F.slice(x, half + 1, half), lambda u, v: u.bitwiseXOR(v))
        return F.when(F.size(x) > F.size(other), folded).otherwise(x)

    a, b = F.col("a.bits"), F.col("b.bits")
    apart = F.zip_with(fitted(a, b), fitted(b, a), lambda u, v: F.bit_count(u.bitwiseXOR(v)))
    fits = F.aggregate(apart, F.lit(0), lambda n, x: n + x) <= flips(least)
    return F.coalesce(fits, F.lit(True))  # null: more than twice as many, at a lower threshold


def sketched(df: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """key, a 128-bit digest of the text, the number of words, their marks and bits, and the sketches' keys."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in by_bytes(batches, "text", 2 << 20):
            whole = texts(b)
            docs = [word_hashes(t) for t in whole]
            n = pa.array([len(d) for d in docs], pa.int64())
            yield pa.record_batch([b.column(0), b.column(1), n, *marks(docs), sketch_lists(docs)], ["key", "digest", "n", "marks", "bits", "sketches"])
        settled()

    src = df.select(F.col(key).cast("long").alias("key"), digest(text).alias("digest"), F.col(text).alias("text"))
    return src.mapInArrow(run, "key long, digest binary, n long, marks array<long>, bits array<long>, sketches array<long>")


def digest(text: str) -> Column:
    """128 bits that name a text; null is the empty one."""
    return F.substring(F.unhex(F.sha2(F.coalesce(F.col(text), F.lit("")), 256)), 1, 16)


def with_text(pairs: DataFrame, held: DataFrame, side: str) -> DataFrame:
    """pairs with the text of one side; a digest of many pairs is dealt to several tasks, each with its text."""
    many = pairs.groupBy(side).agg(F.ceil(F.count("*") / SIDE_PAIRS).cast("int").alias("salts")).where("salts > 1")
    many = small_enough(written(many), 40)
    salted = pairs.join(many, side, "left").withColumn("salt", F.pmod(F.xxhash64("a", "b"), F.coalesce("salts", F.lit(1))).cast("int")).drop("salts")
    texts = held.select(F.col("digest").alias(side), F.col("text").alias(f"text_{side}")).join(many, side, "left")
    texts = texts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.coalesce("salts", F.lit(1)) - 1))).drop("salts")
    return salted.join(texts, [side, "salt"]).drop("salt")


def verified(pairs: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """The pairs (a, b) of digests whose texts, in held(digest, text), are near."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            known: dict[bytes, np.ndarray] = {}  # a batch often holds one text many times
            keep = []
            for a, c, x, y in zip(*(b.column(i).to_pylist() for i in range(4)), strict=True):
                for i, t in ((a, x), (c, y)):
                    if i not in known:
                        known[i] = word_hashes(t or "")
                keep.append(near(known[a], known[c], least))
            yield b.select(["a", "b"]).filter(pa.array(keep, pa.bool_()))
            known.clear()
        settled()

    ids = pairs.select(F.col("a").alias("digest")).unionByName(pairs.select(F.col("b").alias("digest"))).distinct()
    held = held.join(small_enough(ids, 40), "digest", "left_semi").dropDuplicates(["digest"])
    two = with_text(with_text(pairs, held, "a"), held, "b")
    return two.select("a", "b", "text_a", "text_b").mapInArrow(run, "a binary, b binary")


def linked(firsts: DataFrame, held: DataFrame, least: float) -> DataFrame:
    """node, label: the components of all near pairs among candidates; firsts(digest, n, marks, bits, sketches) has every text once.

    Stars first: in each bucket the members are aligned with one of them, its head; then those that aren't in the head's class
    get a head of their own. That links large families with few pairs. After some rounds every pair of a bucket whose sides are
    still in different classes, and which lengths, marks and bits allow, is aligned, so no candidate pair is left out. Of the buckets
    that a pair shares, the one of the least key gives it.
    """
    keys = written(firsts.select(F.col("digest").alias("node"), F.explode("sketches").alias("sketch")))
    many = keys.groupBy("sketch").agg(F.count("*").alias("size")).where("size > 1").select("sketch")
    facts = firsts.select(F.col("digest").alias("node"), "n", "marks")
    members = written(keys.join(many, "sketch").join(facts, "node"))
    edges = tried = labels = None

    def classed(df: DataFrame) -> DataFrame:
        if labels is None:
            return df.withColumn("class", F.col("node"))
        return df.join(labels, "node", "left").withColumn("class", F.coalesce("label", "node")).drop("label")

    def align(pairs: DataFrame) -> None:
        nonlocal edges, tried, labels
        found = written(verified(pairs, held, least))
        edges = found if edges is None else edges.unionByName(found)
        tried = pairs if tried is None else tried.unionByName(pairs)
        if labels is None or not found.isEmpty():
            labels = components(edges)

    def fresh(pairs: DataFrame) -> DataFrame:
        pairs = pairs.select(F.least("a.node", "b.node").alias("a"), F.greatest("a.node", "b.node").alias("b")).distinct()
        return written(pairs if tried is None else pairs.join(tried, ["a", "b"], "left_anti"))

    active = members.select("sketch", "node", "n", "marks")
    for turn in range(STARS):
        order = F.col("node") if turn == 0 else F.xxhash64("node", "sketch", F.lit(turn))  # at first the same head in all buckets
        now = written(classed(active))
        heads = written(now.groupBy("sketch").agg(F.min(F.struct(order.alias("o"), "node", "n", "marks", "class")).alias("h"), F.count("*").alias("size")).where("size > 1").select("sketch", "h.*"))
        stars = now.alias("a").join(heads.alias("b"), (F.col("a.sketch") == F.col("b.sketch")) & (F.col("a.class") != F.col("b.class")) & may(least))
        pairs = fresh(stars)
        if turn == 0:  # most are linked by one partner each
            pairs = written(pairs.groupBy("b").agg(F.min("a").alias("a")).select("a", "b"))
        if not pairs.isEmpty():
            align(pairs)
        head_class = classed(heads.select("sketch", "node")).select("sketch", F.col("class").alias("head_class"))
        active = classed(now.drop("class")).join(head_class, "sketch").where("class <> head_class").select("sketch", "node", "n", "marks")
        active = written(active)
        if active.isEmpty():
            break

    every = written(classed(members.select("sketch", "node")))
    largest = every.groupBy("sketch", "class").agg(F.count("*").alias("size"))
    largest = largest.groupBy("sketch").agg(F.max(F.struct("size", "class")).alias("x"), F.sum("size").alias("all"))
    split = largest.where("x.size < all").select("sketch", F.col("x.class").alias("top"), F.ceil((F.col("all") - F.col("x.size")) / PART).cast("int").alias("salts"))
    # members outside the bucket's largest class against all of other classes
    every = every.join(written(split), "sketch").join(firsts.select(F.col("digest").alias("node"), "n", "marks", "bits", "sketches"), "node")
    left = every.where("class <> top").withColumn("salt", F.pmod(F.xxhash64("node"), F.col("salts").cast("long")).cast("int")).alias("a")
    right = every.withColumn("salt", F.explode(F.sequence(F.lit(0), F.col("salts") - 1))).alias("b")
    once = (F.col("b.class") == F.col("b.top")) | (F.col("a.node") < F.col("b.node"))
    met = (F.col("a.sketch") == F.col("b.sketch")) & (F.col("a.salt") == F.col("b.salt")) & (F.col("a.class") != F.col("b.class"))
    own = F.col("a.sketch") == F.array_min(F.array_intersect("a.sketches", "b.sketches"))
    pairs = fresh(left.join(right, met & once & may(least) & own & may_still(least)))
    if labels is None or not pairs.isEmpty():
        align(pairs)
    return labels


def labelled(df: DataFrame, key: str, text: str, least: float) -> tuple[DataFrame, DataFrame]:
    """key and digest of all rows; and digest, rep (the smallest id with that text) and label of every different text."""
    with scratch(df.sparkSession):
        every = final(sketched(df, key, text))
        firsts = written(every.groupBy("digest").agg(F.min("key").alias("rep"), *(F.any_value(c).alias(c) for c in ("n", "marks", "bits", "sketches"))))
        held = df.select(digest(text).alias("digest"), F.col(text).alias("text"))
        labels = linked(firsts, held, least)
        reps = firsts.select("digest", "rep").join(labels, F.col("digest") == F.col("node"), "left")
        reps = final(reps.select("digest", "rep", F.coalesce("label", "digest").alias("label")))
    return every.select("key", "digest"), reps


def classes(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = NEAR) -> DataFrame:
    """key, copy_of (the smallest id with the same text) and class_id of every document."""
    every, reps = labelled(df, key, text, least)
    names = reps.groupBy("label").agg(F.min("rep").alias("class_id"))
    out = every.join(reps.join(names, "label"), "digest", "left")
    own = F.col("key").isNotNull()
    return out.select(F.col("key").alias(key), F.when(own, F.col("rep")).alias("copy_of"), F.when(own, F.col("class_id")).alias("class_id"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", least: float = NEAR) -> DataFrame:
    """One row of df for each class: of its texts the one with the smallest id, where null is the last; of equal ids any one text."""
    _, reps = labelled(df, key, text, least)
    first = F.min(F.struct(F.col("rep").isNull().alias("none"), "rep", "digest")).alias("x")
    found = written(reps.groupBy("label").agg(first).select("x.rep", "x.digest"))
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), digest(text).alias("own"), F.col(key).cast("long").alias("id"))
    kept = rows.join(small_enough(found, 40), (F.col("own") == F.col("digest")) & F.col("id").eqNullSafe(F.col("rep")), "left_semi")
    repeated = not df.groupBy(key).count().where("count > 1").isEmpty()
    return (kept.dropDuplicates(["own"]) if repeated else kept).select(*(F.col("row").getField(c).alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, copy_of and class_id of all documents."""
    return classes(table(spark, sf_dir, "documents"))
