"""Merkle manifest of a dataset: nodes are intervals of leaf ranks, and containment of intervals is ancestry.

A leaf is the digest of a row's columns. Rows of a group are ranked by key without one task seeing them all
(`ordering.positions`); the node of level k that a leaf belongs to covers the ranks [j w, (j + 1) w) with w = arity ^ k, cut
at the group's end. A level is built from the one below by its bucket (rank div w), so every grouping has at most `arity`
rows however large a group is. The groups' top nodes are in turn the leaves of one more tree, whose top is the root.

Going down again, each node meets the node of the next level that contains its interval (again by bucket), takes over that
node's path and puts its own siblings in front: those of the parent's intervals that lie before and behind its own.

Null values are hashed as `-`; a null group is a group of its own before all others, a null key sorts first. Rows of equal
group and key are ranked by their digest, so their order among themselves does not matter; repeated rows are leaves of their own. Empty and long
texts are no special case (a row is hashed in one piece). An empty table has no leaves, no nodes and no root. Only the named columns are read, other
columns, whatever their names, are not.
"""

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkvec.llm.common import small_enough, written
from sparkvec.operators.ordering import positions
from sparkvec.session import final, scratch, table

ARITY = 8
COLUMNS = ("doc_id", "source", "lang", "n_chars", "text")
PATH = "array<struct<left:string,right:string>>"
#: Bytes that one group's row takes at most where groups are broadcast (digests and a path of 20 levels).
GROUP_BYTES = 12_000


def digest(parts: Column) -> Column:
    """Lower-case hex SHA-256 of concatenated strings."""
    return F.sha2(parts.cast("binary"), 256)


def encoded(value: Column) -> Column:
    """`-` for null, else the number of UTF-8 bytes, a colon and the value; numbers are decimal."""
    text = value.cast("string")
    return F.when(text.isNull(), F.lit("-")).otherwise(F.concat(F.octet_length(text).cast("string"), F.lit(":"), text))


def leaf_digest(values: list[Column]) -> Column:
    return digest(F.concat(*(encoded(v) for v in values)))


@dataclass
class Manifest:
    """leaves: grp, key, n, lo, hi, digest, other; levels and upper: grp, n, lo, hi, digest, children, from level 1 up; groups: the
    leaves of the upper tree. `n` is the number of leaves of the tree. All are written tables."""

    leaves: DataFrame
    levels: list[DataFrame]
    groups: DataFrame
    upper: list[DataFrame]
    arity: int

    def root(self) -> str | None:
        """The digest of everything; None for an empty table."""
        top = self.upper[-1] if self.upper else self.groups
        row = top.select("digest").first()
        return row.digest if row else None


def bucket(width: int) -> Column:
    """Where the interval of this width begins that holds `lo`."""
    return F.col("lo") - F.col("lo") % width


def climb(nodes: DataFrame, arity: int) -> list[DataFrame]:
    """The levels above nodes (grp, n, lo, hi, digest), until each tree has one node."""
    most, width, levels = nodes.agg(F.max("n")).first()[0] or 0, 1, []
    while width < most:
        child = F.struct("lo", "hi", "digest")
        below = nodes.where(F.col("n") > width)  # smaller trees have ended
        width *= arity
        above = below.groupBy("grp", "n", bucket(width).alias("bucket")).agg(F.sort_array(F.collect_list(child)).alias("children"))
        first, last = F.element_at("children", 1), F.element_at("children", -1)
        joined = F.array_join(F.transform("children", lambda c: c["digest"]), "")
        nodes = written(above.select("grp", "n", first["lo"].alias("lo"), last["hi"].alias("hi"), digest(joined).alias("digest"), "children"))
        levels.append(nodes)
    return levels


def tops(nodes: DataFrame, levels: list[DataFrame]) -> DataFrame:
    """grp and digest of the node that covers its whole tree."""
    out = None
    for level in [nodes, *levels]:
        top = level.where((F.col("lo") == 0) & (F.col("hi") == F.col("n"))).select("grp", "digest")
        out = top if out is None else out.unionByName(top)
    return out


def descend(nodes: DataFrame, levels: list[DataFrame], above: DataFrame, arity: int) -> DataFrame:
    """nodes with `path` and what else above (grp, path, ...) has: the siblings at every step up to the root, nearest first.

    A node's parent is the one of the next level whose interval contains its own.
    """
    carried = [c for c in above.columns if c != "grp"]
    above, parents = small_enough(above, GROUP_BYTES), None
    for k, level in reversed(list(enumerate([nodes, *levels]))):
        whole = (F.col("lo") == 0) & (F.col("hi") == F.col("n"))
        out = level.where(whole).join(above, "grp")
        if parents is not None:
            width = arity ** (k + 1)  # of the parents
            p = parents.select(F.col("grp").alias("p_grp"), F.col("lo").alias("p_lo"), F.col("hi").alias("p_hi"), "p_children", *(F.col(c).alias(f"p_{c}") for c in carried))
            inside = (F.col("grp") == F.col("p_grp")) & (bucket(width) == F.col("p_lo"))
            inside &= (F.col("p_lo") <= F.col("lo")) & (F.col("hi") <= F.col("p_hi"))
            met = level.where(~whole).join(p, inside)
            before = F.array_join(F.transform(F.filter("p_children", lambda c: c["hi"] <= F.col("lo")), lambda c: c["digest"]), "")
            behind = F.array_join(F.transform(F.filter("p_children", lambda c: c["lo"] >= F.col("hi")), lambda c: c["digest"]), "")
            step = F.array(F.struct(before.alias("left"), behind.alias("right")))
            values = [(F.concat(step, F.col("p_path")) if c == "path" else F.col(f"p_{c}")).alias(c) for c in carried]
            out = out.select(*level.columns, *carried).unionByName(met.select(*level.columns, *values))
        parents = out.withColumnRenamed("children", "p_children")
    return out


def manifest(df: DataFrame, key: str, group: str, columns: tuple[str, ...], other: dict[str, Column] | None = None, arity: int = ARITY) -> Manifest:
    """The tree over df's rows. `other` replaces columns in a second digest of each row, kept beside the first (as what is met at a later check)."""
    other = other or {}
    # null before every value, and no value is null
    code = F.coalesce(F.concat(F.lit("="), F.col(group).cast("string")), F.lit("-"))
    rows = df.select(
        code.alias("grp"),
        F.col(key).alias("key"),
        leaf_digest([F.col(c) for c in columns]).alias("digest"),
        leaf_digest([other.get(c, F.col(c)) for c in columns]).alias("other"),
    )
    held = written(rows.withColumn("row", F.monotonically_increasing_id()))
    placed = written(positions(held, "grp", "key", "digest", "row").drop("row"))
    ranges = written(placed.groupBy("grp").agg(F.min("at").alias("first"), F.count("*").alias("n")))
    leaves = placed.join(small_enough(ranges, 200), "grp").withColumn("lo", F.col("at") - F.col("first"))
    leaves = written(leaves.select("grp", "key", "n", "lo", (F.col("lo") + 1).alias("hi"), "digest", "other"))
    levels = climb(leaves, arity)
    count = ranges.count()
    groups = positions(tops(leaves, levels).withColumnRenamed("grp", "name"), "name")
    lo = F.col("at")
    groups = written(groups.select(F.lit("").alias("grp"), "name", F.lit(count).cast("long").alias("n"), lo.alias("lo"), (lo + 1).alias("hi"), "digest"))
    return Manifest(leaves, levels, groups, climb(groups, arity), arity)


def paths(m: Manifest) -> DataFrame:
    """The leaves with subroot, root and path (siblings left and right at every step from the leaf to the root)."""
    spark = m.leaves.sparkSession
    start = spark.createDataFrame([("", m.root())], "grp string, root string").withColumn("path", F.array().cast(PATH))
    upper = descend(m.groups, m.upper, start, m.arity)
    upper = written(upper.select(F.col("name").alias("grp"), F.col("digest").alias("subroot"), "root", "path"))
    return descend(m.leaves, m.levels, upper, m.arity)


def proof_digest(path: Column) -> Column:
    return digest(F.array_join(F.transform(path, lambda s: F.concat(s["left"], s["right"])), ""))


def folded(leaf: Column, path: Column) -> Column:
    """The root that a leaf and the siblings on its way give."""
    return F.aggregate(path, leaf, lambda h, s: digest(F.concat(s["left"], h, s["right"])))


def verified(m: Manifest) -> DataFrame:
    """key, leaf, subroot, root, proof_sha256, folded_root (from the second digest) and whether that is the root."""
    out = paths(m).select(
        "key",
        F.col("digest").alias("leaf"),
        "subroot",
        "root",
        proof_digest(F.col("path")).alias("proof_sha256"),
        folded(F.col("other"), F.col("path")).alias("folded_root"),
    )
    return out.withColumn("verified", F.col("folded_root") == F.col("root"))


def differing(a: Manifest, b: Manifest) -> DataFrame:
    """grp, lo and both digests of the leaves that differ between two manifests of one arity: only subtrees whose digests differ are entered.

    A leaf that one side lacks has a null digest there. A group whose number of leaves changed is compared rank by rank.
    """
    unlike = None
    for k in range(max(len(a.levels), len(b.levels)), -1, -1):
        sides = []
        for m, name in ((a, "a_digest"), (b, "b_digest")):
            nodes = [m.leaves, *m.levels][k] if k <= len(m.levels) else m.leaves.limit(0)
            top = (F.col("lo") == 0) & (F.col("hi") == F.col("n"))
            asked = nodes.where(top)
            if unlike is not None:
                inside = nodes.where(~top).withColumn("up", bucket(a.arity ** (k + 1)))
                asked = asked.unionByName(inside.join(unlike, ["grp", "up"], "left_semi").drop("up"))
            sides.append(asked.select("grp", "lo", F.col("digest").alias(name)))
        both = sides[0].join(sides[1], ["grp", "lo"], "full")
        found = written(both.where(~F.col("a_digest").eqNullSafe(F.col("b_digest"))))
        unlike = found.select("grp", F.col("lo").alias("up"))
    return found


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, leaf, subroot, root, proof_sha256, folded_root and verified of all documents; every third has its text lower-cased before the check."""
    upper = "ABCDEFGHIJKLMNOPQRSTUVWXYZ"
    hit = F.crc32(F.col("doc_id").cast("string")) % 3 == 0
    text = F.when(hit, F.translate("text", upper, upper.lower())).otherwise(F.col("text"))
    with scratch(spark):
        m = manifest(table(spark, sf_dir, "documents"), "doc_id", "lang", COLUMNS, {"text": text})
        return final(verified(m).withColumnRenamed("key", "doc_id"))
