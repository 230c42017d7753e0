"""Line dedup: an exact set-similarity join of lines, with DataFrame functions only.

A line is the set of its lower-cased, white-space separated tokens. A line goes if a line before it, in order of document id
and position, has the same set or a Jaccard similarity of at least `near`. The order is that of all lines, kept or not.

1. The lines are tokenised once, into a written table of one row per line with a number, its place and its tokens' 31-bit hashes.
2. Equal lines are one: all but the first go.
3. Token counts over all lines that are left, in a table of fixed size (tokens share cells, which only affects cost), rank the
   tokens by rarity. A token's key has its cell's rank in front, so sorted keys are in order of rarity.
4. Each remaining line gives the rows of its prefix, its n - ceil(near * n) + 1 rarest tokens: similar lines share one of them.
   A semi-join on the token keeps the rows that have any partner within the length filter, the positional filter (what can
   still be shared from here on) and a filter on parity bitmaps (their Hamming distance never exceeds the symmetric
   difference). It gives no more rows than it reads, however large a group of similar lines is.
5. Of those, each is paired with the first line of its token; the true Jaccard of the pairs' words decides. Only lines that are
   still there after that meet all earlier partners of their tokens.

Words that share a hash only add candidates: each counts for itself in a line's size and prefix, and the words themselves decide.

Null texts stay null and have no lines; blank lines have no tokens and stay. Rows that repeat an id and text count as one document,
rows of one id with other texts as documents of their own; null ids come first. An empty table gives an empty one. Other
columns stay as they are, whatever their names.
"""

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import BROADCAST_BYTES, small_enough, written
from sparkvec.session import final, scratch, table

NEAR = 0.8
#: Cells of the count table, as a power of two, and bits of a token's hash; together they make up a token's key.
CELL_BITS, HASH_BITS = 18, 31
CELLS = 1 << CELL_BITS
#: Sets from this size on have a bitmap of twice the bits.
LONG = 64
FIRST_ID = -(1 << 63)
#: What names a line.
PLACE = ["doc", "own", "at"]


def words(text: Column) -> Column:
    """Lower-cased tokens between white space."""
    rare = F.contains(text, F.lit("\t")) | F.contains(text, F.lit("\r")) | F.contains(text, F.lit("\v")) | F.contains(text, F.lit("\f"))
    spaced = F.when(rare, F.translate(text, "\t\r\v\f", "    ")).otherwise(text)  # looking is cheaper than translating
    return F.array_remove(F.split(F.lower(spaced), " "), "")


def ranked_cells(tokens: DataFrame) -> DataFrame:
    """One row with an array of all cells' ranks by count in tokens(t), shifted to the front of a key."""
    counts = tokens.select(F.explode("t").alias("h")).select(F.col("h").bitwiseAND(CELLS - 1).alias("cell")).groupBy("cell").count()
    every = tokens.sparkSession.range(CELLS).select(F.col("id").cast("int").alias("cell")).join(counts, "cell", "left")
    in_order = every.agg(F.sort_array(F.collect_list(F.struct(F.coalesce("count", F.lit(0)).alias("n"), "cell"))).alias("x"))
    ranks = in_order.select(F.posexplode("x.cell").alias("rank", "cell"))
    front = F.shiftleft(F.col("rank").cast("long"), HASH_BITS).alias("front")
    return ranks.agg(F.sort_array(F.collect_list(F.struct("cell", front))).alias("x")).select(F.col("x.front").alias("ranks"))


def keys(t: Column, ranks: Column) -> Column:
    """The tokens' keys, rarest first."""
    return F.sort_array(F.transform(t, lambda h: F.get(ranks, h.bitwiseAND(CELLS - 1)).bitwiseOR(h.cast("long"))))


def identity(key: str, text: str) -> list[Column]:
    """What names a document: its id, where null is the first, and a hash of its text, as ids may repeat."""
    return [F.coalesce(F.col(key).cast("long"), F.lit(FIRST_ID)).alias("doc"), F.xxhash64(text).alias("own")]


def line_table(df: DataFrame, key: str, text: str) -> DataFrame:
    """ref, doc, own, at, a 128-bit digest (h, g) and the tokens' hashes t of all lines that have tokens; written."""
    # a text is hashed once, before it is cut
    parts = df.select(*identity(key, text), F.split(text, "\n").alias("parts"))
    lines = parts.select("doc", "own", F.posexplode("parts").alias("at", "line")).where(filled(F.col("line")))
    t = F.transform(F.array_distinct(words(F.col("line"))), lambda w: F.hash(w).bitwiseAND((1 << HASH_BITS) - 1))
    # the numbers are those of the written rows, so they stay as they are
    return written(lines.select(F.monotonically_increasing_id().alias("ref"), *PLACE, F.xxhash64("line").alias("h"), F.xxhash64("line", F.lit(1)).alias("g"), t.alias("t")))


def filled(line: Column) -> Column:
    """Whether a line has tokens."""
    return F.trim(line, F.lit(" \t\r\v\f")) != ""


def bitmap(k: Column) -> Column:
    """64 parities: each key flips the bit that its last six bits name."""
    one = F.lit(1).cast("long")
    return F.aggregate(k, F.lit(0).cast("long"), lambda a, x: a.bitwiseXOR(F.call_function("shiftleft", one, x.bitwiseAND(63).cast("int"))))


def close(n: Column, i: Column, b: Column, c: Column, m: Column, j: Column, d: Column, e: Column, near: float) -> Column:
    """Whether sets of n and m tokens that share the token at places i and j can be similar.

    b and d are the bitmaps of all keys, c and e those of every second key, known if both sets are long: then the two halves
    are compared apart. No more bits differ than tokens do.
    """
    shared = near / (1 + near) * (n + m)  # the least overlap of similar sets
    length = (n >= near * m - 1e-6) & (m >= near * n - 1e-6)
    position = F.least(n - i, m - j) >= shared - 1e-6
    whole, half = b.bitwiseXOR(d), c.bitwiseXOR(e)
    apart = F.when((n >= LONG) & (m >= LONG), F.bit_count(whole.bitwiseXOR(half)) + F.bit_count(half)).otherwise(F.bit_count(whole))
    return length & position & (apart <= n + m - 2 * shared + 1e-6)


def prefixes(df: DataFrame, ranks: Column, near: float) -> DataFrame:
    """token, ref, n, i and bitmaps of the prefix rows of lines(ref, t)."""
    # the optimizer puts the ranks, used once, into the next expression, so no row holds them
    src = df.select("ref", "t", ranks.alias("ranks")).select("ref", keys(F.col("t"), F.col("ranks")).alias("k"))
    # and exploding an array of one keeps it from computing keys and bitmaps again for each row of the prefix
    n = F.size("k")
    second = F.filter("k", lambda x: x.bitwiseAND(64) != 0)
    prefix = F.slice("k", 1, (n - F.ceil(near * n - 1e-6) + 1).cast("int"))
    half = F.when(n >= LONG, bitmap(second)).otherwise(F.lit(0).cast("long"))
    facts = F.struct(n.alias("n"), bitmap(F.col("k")).alias("b"), half.alias("c"), prefix.alias("p"))
    src = src.select("ref", F.explode(F.array(facts)).alias("x"))
    return src.select("ref", "x.n", "x.b", "x.c", F.posexplode("x.p").alias("i", "token"))


def with_lists(df: DataFrame, lists: str) -> DataFrame:
    """df(doc, own, lists), marked for broadcast if its rows and what the lists hold stay below the limit."""
    n, held = df.agg(F.count("*"), F.coalesce(F.sum(F.size(lists)), F.lit(0))).first()
    return F.broadcast(df) if 64 * n + 8 * held <= BROADCAST_BYTES else df


def later_matches(df: DataFrame, key: str = "doc_id", text: str = "text", near: float = NEAR) -> DataFrame:
    """doc, own and gone (the positions of the lines that go) of the documents that lose any."""
    src = df.select(key, text)
    every = line_table(src, key, text)
    place = F.struct(*PLACE)
    repeated = every.groupBy("h", "g").agg(F.min(F.struct(*PLACE, "ref")).alias("first"), F.count("*").alias("copies")).where("copies > 1").select("h", "g", "first.ref", F.struct(*(f"first.{c}" for c in PLACE)).alias("first"))
    copies = every.select("h", "g", F.col("ref").alias("copy"), *PLACE).join(small_enough(written(repeated), 80), ["h", "g"]).where(F.col("copy") != F.col("ref"))
    copies = written(copies.select("copy", *PLACE, (place == F.col("first")).alias("same")))  # the same place: a repeated row
    left = every.select("ref", "t").join(small_enough(copies.select(F.col("copy").alias("ref")), 16), "ref", "left_anti")
    copies = copies.where("not same").select(*PLACE).distinct()

    rows = prefixes(left, written(ranked_cells(left.select("t"))).scalar(), near)
    a, b = rows.alias("a"), rows.alias("b")
    col = F.col
    may = close(col("a.n"), col("a.i"), col("a.b"), col("a.c"), col("b.n"), col("b.i"), col("b.b"), col("b.c"), near)
    met = written(a.join(b, (col("a.token") == col("b.token")) & (col("a.ref") != col("b.ref")) & may, "left_semi"))

    # what follows is about lines that have a partner
    lines = every.select("ref", *PLACE).join(small_enough(met.select("ref").distinct(), 16), "ref", "left_semi")
    lines = written(lines.select("ref", place.alias("place")))
    met = written(met.join(small_enough(lines, 48), "ref"))
    ats = lines.groupBy("place.doc", "place.own").agg(F.collect_set("place.at").alias("ats"))
    texts = src.select(*identity(key, text), F.col(text).alias("text"))
    texts = texts.join(with_lists(written(ats), "ats"), ["doc", "own"]).select("doc", "own", "ats", F.posexplode(F.split("text", "\n")).alias("at", "line"))
    texts = texts.where(F.array_contains("ats", F.col("at")))
    sets = written(texts.select(F.struct(*PLACE).alias("place"), F.array_distinct(words(F.col("line"))).alias("t")).join(small_enough(lines, 48), "place").select("ref", "t").dropDuplicates(["ref"]))  # rows may repeat

    def similar(pairs: DataFrame) -> DataFrame:
        """ref of the first sides of truly similar pairs(ref, ref2)."""
        one = pairs.join(sets.select("ref", col("t").alias("t1")), "ref")
        two = one.join(sets.select(col("ref").alias("ref2"), col("t").alias("t2")), "ref2")
        both = F.size(F.array_intersect("t1", "t2"))
        return two.where(both >= near * (F.size("t1") + F.size("t2") - both) - 1e-9).select("ref").distinct()

    firsts = met.groupBy("token").agg(F.min(F.struct("place", "ref", "n", "i", "b", "c")).alias("f"))
    fits = close(col("n"), col("i"), col("b"), col("c"), col("f.n"), col("f.i"), col("f.b"), col("f.c"), near)
    with_first = met.join(firsts, "token").where(fits & (col("place") > col("f.place")))
    with_first = written(with_first.select("ref", col("f.ref").alias("ref2")).distinct())
    gone = written(similar(with_first))
    still = met.join(small_enough(gone, 16), "ref", "left_anti").alias("a")
    fits = close(col("a.n"), col("a.i"), col("a.b"), col("a.c"), col("b.n"), col("b.i"), col("b.b"), col("b.c"), near)
    pairs = still.join(met.alias("b"), (col("a.token") == col("b.token")) & (col("b.place") < col("a.place")) & fits)
    pairs = pairs.select("a.ref", col("b.ref").alias("ref2")).distinct()
    pairs = written(pairs.join(with_first, ["ref", "ref2"], "left_anti"))
    both = gone.unionByName(similar(pairs)).join(lines, "ref").select("place.*")
    return copies.unionByName(both).groupBy("doc", "own").agg(F.collect_set("at").alias("gone"))


def deduplicated(df: DataFrame, key: str = "doc_id", text: str = "text", near: float = NEAR, lines_as: str | None = None, gone_as: str | None = None) -> DataFrame:
    """df with the text of the lines that stay; and, if named, the number of lines and of those that went."""
    with scratch(df.sparkSession):
        gone = final(later_matches(df, key, text, near))
    gone = with_lists(gone, "gone")
    rows = df.select(F.struct(*(F.col(f"`{c}`") for c in df.columns)).alias("row"), *identity(key, text)).join(gone, ["doc", "own"], "left")
    whole = F.col("row").getField(text)
    parts = F.split(whole, "\n")
    stay = F.array_join(F.filter(parts, lambda x, i: ~F.array_contains("gone", i)), "\n")
    new = F.when(F.col("gone").isNull(), whole).otherwise(stay)
    more = {n: c for n, c in ((lines_as, F.coalesce(F.size(parts), F.lit(0)).cast("long")), (gone_as, F.coalesce(F.size("gone"), F.lit(0)).cast("long"))) if n}
    kept = [(new if c == text else F.col("row").getField(c)).alias(c) for c in df.columns if c not in more]
    return rows.select(*kept, *(c.alias(n) for n, c in more.items()))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, text, n_lines and n_removed of all documents."""
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs, lines_as="n_lines", gone_as="n_removed").select("doc_id", "text", "n_lines", "n_removed")
