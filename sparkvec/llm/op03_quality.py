"""Quality classifier: interpolated modified Kneser-Ney models of character n-grams, trained on trusted text.

Characters are taken as they are: the alphabet is open, so the tables grow with the corpus. (Those beyond U+FFFF share 6,400
stand-ins, which lets four characters fit one 64-bit code.) Every trusted text is counted, none is sampled. Each language has
models of its own, and all trusted texts together have shared ones: of all documents, and of each half of them. A trusted
document is scored by the half that it isn't in, any other by the first, so no document is scored by a model that has seen it. A character's
probability is a mixture of its language's and of the shared model's; with n trusted characters behind it the language's own has the
weight n / (n + TRUST), so a language with few of them leans on the shared model and one with none has that alone.

1. Counts of 4-grams are summed from partial counts; continuation counts of the lower orders, context totals and discounts follow
   by grouping. Each order's n-grams are joined with their contexts and with the next lower order on sharded keys, which gives every
   seen n-gram its probability and every context its back-off weight.
2. Documents are dealt to blocks of one model and bounded text. The different 4-grams of a block are pre-aggregated there. The
   different ones of all blocks are joined, order by order, with the probabilities and weights, and each block gets back the
   log-probabilities of its own n-grams. No task holds a whole model, and no table goes to the driver.
3. A document's perplexity is over all its characters. A language's limit is a quantile of its trusted documents' perplexities, from a
   histogram with steps of 1/1000 standard deviation. Few documents tell little of their spread: the language's variance, and the number
   of standard deviations from its mean to its quantile, are averaged with those of all languages, which count as much as STEADY documents.

Trusted are documents whose labels say quality 1 and not toxic. A null text is the empty one; it has no perplexity and is not
kept. A null lang is the empty one; null ids are scored, but never trusted. Repeated rows are each scored; an id that is labelled
twice is trusted if one row says so. Where one half of the trusted documents is empty, all are scored by the model of all; without any
trusted text, every text with characters is kept. An empty table gives an empty one. `kept` carries all columns of its input
through, whatever their names, and texts of any length are read in pieces.
"""

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import zstandard
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sparkvec.llm.common import by_bytes, settled, small_enough, texts, written
from sparkvec.session import final, scratch, table

ORDER, BITS, QUANTILE = 4, 16, 0.98
#: Characters at which a language's own model counts as much as the shared one; documents that the shared spread of perplexities counts for.
TRUST, STEADY = 1 << 18, 50
#: Texts that the compression's dictionary is made of.
SAMPLES = 1000
#: Stands before a text.
START = "\x02" * (ORDER - 1)
#: Characters of a block, characters that are coded at once.
BLOCK, PIECE = 8 << 20, 1 << 20
#: Stand-ins of characters beyond U+FFFF: the private-use area.
BEYOND, BEYOND_SIZE = 0xE000, 6400


def codes_of(text: str) -> np.ndarray:
    """The codes of the n-grams that end at each of the characters after the first ORDER - 1, 16 bits a character."""
    p = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    p = np.where(p > 0xFFFF, BEYOND + p % BEYOND_SIZE, p)
    n = max(0, len(p) - ORDER + 1)
    code = np.zeros(n, np.uint64)
    for i in range(ORDER):
        code = code << np.uint64(BITS) | p[i : i + n]
    return code.view(np.int64)


def pieces(whole: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Codes end to end, and the numbers and lengths of the texts (or parts of one) that they are of, in bounded portions."""
    some: list[str] = []
    of: list[int] = []
    size = 0

    def portion() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        n = np.array([len(t) - ORDER + 1 for t in some], np.int64)
        codes = codes_of("".join(some))
        starts = np.cumsum(n + ORDER - 1) - (n + ORDER - 1)
        at = np.repeat(starts - (np.cumsum(n) - n), n) + np.arange(n.sum())
        return codes[at], np.array(of, np.int64), n

    for i, t in enumerate(whole):
        for at in range(0, len(t), PIECE):
            some.append((START if at == 0 else t[at - ORDER + 1 : at]) + t[at : at + PIECE])
            of.append(i)
            size += len(some[-1])
            if size >= PIECE:
                yield portion()
                some, of, size = [], [], 0
    if some:
        yield portion()


def encoded(codes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The different codes, and the number of its code at each place."""
    d = pc.dictionary_encode(pa.array(codes))
    return d.dictionary.to_numpy(), d.indices.to_numpy()


def counted(trusted: DataFrame) -> DataFrame:
    """model, code and n of trusted(model, text): each task sums its own counts before they are shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for b in by_bytes(batches, "text", 4 << 20):
            models, whole = b.column(0).to_numpy(), texts(b)
            for m in np.unique(models).tolist():
                for codes, _, _ in pieces([whole[i] for i in np.flatnonzero(models == m)]):
                    new, at = encoded(codes)
                    n = np.bincount(at, minlength=len(new))
                    if m in known:
                        new, at = encoded(np.concatenate([known[m][0], new]))
                        n = np.bincount(at, weights=np.concatenate([known[m][1], n]), minlength=len(new)).astype(np.int64)
                    known[m] = new, n
        for m, (code, n) in known.items():
            yield pa.record_batch([pa.array(np.full(len(code), m)), pa.array(code), pa.array(n)], ["model", "code", "n"])
        known.clear()
        settled()

    return trusted.select("model", "text").mapInArrow(run, "model long, code long, n long").groupBy("model", "code").agg(F.sum("n").alias("n"))


def last(code: Column, k: int) -> Column:
    """The n-gram's last k characters."""
    return code.bitwiseAND(F.lit((1 << BITS * k) - 1)) if k < ORDER else code


def discount(i: int) -> Column:
    """What a count of i (3: or more) is lowered by, from the counts of counts n1 to n4, within what they allow."""
    a, b = F.col(f"n{i}").cast("double"), F.col(f"n{i + 1}").cast("double")
    y = F.when(F.col("n1") > 0, F.col("n1") / (F.col("n1") + 2 * F.col("n2"))).otherwise(F.lit(0.5))
    free = F.when(a > 0, i - (i + 1) * y * b / F.when(a > 0, a)).otherwise(F.lit(i * 0.5))
    return F.least(F.greatest(free, F.lit(0.1)), F.lit(i - 0.05))


def estimated(top: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(k, model, code, p of all seen n-grams; k, model, context, weight of all seen contexts) of counted 4-grams."""
    orders = {ORDER: top}
    for k in range(ORDER - 1, 0, -1):  # how many different characters come before
        orders[k] = orders[k + 1].select("model", last(F.col("code"), k).alias("code")).groupBy("model", "code").agg(F.count("*").alias("n"))
    grams = None
    for k, df in orders.items():
        one = df.select(F.lit(k).alias("k"), "model", "code", F.shiftrightunsigned("code", BITS).alias("context"), "n")
        grams = one if grams is None else grams.unionByName(one)
    grams = written(grams)
    rates = grams.groupBy("k", "model").agg(*(F.count_if(F.col("n") == i).alias(f"n{i}") for i in (1, 2, 3, 4)))
    rates = written(rates.select("k", "model", *(discount(i).alias(f"d{i}") for i in (1, 2, 3))))  # four rows a model
    grams = grams.join(small_enough(rates, 64), ["k", "model"])
    cut = F.when(F.col("n") == 1, F.col("d1")).when(F.col("n") == 2, F.col("d2")).otherwise(F.col("d3"))
    grams = grams.withColumn("cut", cut)
    contexts = grams.groupBy("k", "model", "context").agg(F.sum("n").alias("total"), (F.sum("cut") / F.sum("n")).alias("weight"), F.count("*").alias("kinds"))
    contexts = written(contexts)
    shares = grams.join(contexts, ["k", "model", "context"]).select("k", "model", "code", ((F.col("n") - F.col("cut")) / F.col("total")).alias("share"), "weight", "kinds")
    shares, seen, lower = written(shares), None, None
    for k in range(1, ORDER + 1):
        one = shares.where(F.col("k") == k)
        if k == 1:  # under all seen characters lies the uniform share of these and an unknown one
            p = one.select("k", "model", "code", (F.col("share") + F.col("weight") / (F.col("kinds") + 1)).alias("p"))
        else:
            below = lower.select("model", F.col("code").alias("suffix"), F.col("p").alias("q"))
            p = one.withColumn("suffix", last(F.col("code"), k - 1)).join(below, ["model", "suffix"])
            p = p.select("k", "model", "code", (F.col("share") + F.col("weight") * F.col("q")).alias("p"))
        lower = written(p)
        seen = lower if seen is None else seen.unionByName(lower)
    unknown = contexts.where("k = 1").select(F.lit(0).alias("k"), "model", F.lit(0).cast("long").alias("code"), (1 / (F.col("kinds") + 1)).alias("p"))
    return seen.unionByName(unknown), contexts.select("k", "model", "context", "weight")


def probabilities(wanted: DataFrame, seen: DataFrame, weights: DataFrame) -> DataFrame:
    """wanted(model, code) with the probability p of the last character: from the longest seen ending up. The tables of the lowest orders,
    in which many n-grams share an ending, are small; they are broadcast below a counted size."""
    own = ["model", "code"]
    out = wanted.select(*own, F.lit(None).cast("double").alias("p"), F.lit(1.0).alias("w"))
    for k in range(ORDER, -1, -1):
        one = seen.where(F.col("k") == k).select("model", F.col("code").alias("end"), F.col("p").alias("found"))
        one = small_enough(one, 32) if k <= 1 else one
        out = out.withColumn("end", last(F.col("code"), k)).join(one, ["model", "end"], "left")
        out = out.select(*own, F.coalesce("p", F.col("w") * F.col("found")).alias("p"), "w")
        if k > 0:
            back = weights.where(F.col("k") == k).select("model", "context", "weight")
            back = small_enough(back, 32) if k <= 2 else back
            out = out.withColumn("context", F.shiftrightunsigned(last(F.col("code"), k), BITS)).join(back, ["model", "context"], "left")
            out = out.select(*own, "p", F.when(F.col("p").isNull(), F.col("w") * F.coalesce("weight", F.lit(1.0))).otherwise(F.col("w")).alias("w"))
    return out.select(*own, "p")


def log_probabilities(pairs: DataFrame, seen: DataFrame, weights: DataFrame, models: DataFrame | None) -> DataFrame:
    """pairs(model, block, code) with the log-probability logp under the model, mixed as models(model, base, own) says."""
    asked = pairs.select("model", "code").distinct()
    if models is None:
        mixed = probabilities(asked, seen, weights)
    else:
        asked = written(asked.join(small_enough(models, 32), "model", "left"))
        shared = asked.where("base is not null").select(F.col("base").alias("model"), "code")
        p = written(probabilities(asked.select("model", "code").unionByName(shared).distinct(), seen, weights))
        low = p.select(F.col("model").alias("base"), "code", F.col("p").alias("q"))
        own = F.when(F.col("base").isNull(), F.lit(1.0)).otherwise(F.col("own"))
        mixed = asked.join(p, ["model", "code"]).join(low, ["base", "code"], "left")
        mixed = mixed.select("model", "code", (own * F.coalesce("p", F.lit(0.0)) + (1 - own) * F.coalesce("q", F.lit(0.0))).alias("p"))
    return pairs.join(mixed, ["model", "code"]).select("model", "block", "code", F.log("p").alias("logp"))


def common_parts(rows: DataFrame) -> bytes:
    """A dictionary for compressing texts, from the beginnings of some: it saves shuffled bytes and changes no result. Empty if there are too few."""
    some = [r.text.encode("utf-8", "surrogatepass") for r in rows.where("length(text) > 0").select(F.substring("text", 1, 8000).alias("text")).limit(SAMPLES).collect()]
    try:
        return zstandard.train_dictionary(64 << 10, some).as_bytes()
    except (zstandard.ZstdError, ValueError):
        return b""


def packed(rows: DataFrame, parts: bytes) -> DataFrame:
    """rows with compressed texts, since these are shuffled."""
    names = rows.columns
    at = names.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        z = zstandard.ZstdCompressor(level=6, dict_data=zstandard.ZstdCompressionDict(parts) if parts else None)
        for b in by_bytes(batches, "text"):
            raw = pa.array([None if t is None else z.compress(t.encode("utf-8", "surrogatepass")) for t in b.column(at).to_pylist()], pa.binary())
            yield pa.record_batch([raw if i == at else c for i, c in enumerate(b.columns)], names)
        settled()

    return rows.mapInArrow(run, T.StructType([T.StructField("text", T.BinaryType()) if f.name == "text" else f for f in rows.schema.fields]))


def unpacked(t: pa.Table, parts: bytes) -> list[str]:
    """The texts of a table; null is the empty one."""
    z = zstandard.ZstdDecompressor(dict_data=zstandard.ZstdCompressionDict(parts) if parts else None)
    return ["" if x is None else z.decompress(x).decode("utf-8", "surrogatepass") for x in t["text"].to_pylist()]


def scored(rows: DataFrame, seen: DataFrame, weights: DataFrame, models: DataFrame | None = None, with_text: bool = False) -> DataFrame:
    """rows(model, id, text, ...) with the mean negative log-probability nll of a text's characters; null for a text without any.

    The texts are left out of the result if it is without them.
    """
    sizes = rows.groupBy("model").agg(F.greatest(F.lit(1), F.ceil(F.sum(F.length("text")) / BLOCK)).cast("long").alias("blocks"))
    rows = rows.join(small_enough(written(sizes), 32), "model")
    parts = common_parts(rows)
    rows = packed(rows.withColumn("block", F.pmod(F.xxhash64("id", "text"), F.coalesce("blocks", F.lit(1)))).drop("blocks"), parts)
    by = ["model", "block"]

    def different(t: pa.Table) -> pa.Table:
        known = np.zeros(0, np.int64)
        for codes, _, _ in pieces(unpacked(t, parts)):
            known = encoded(np.concatenate([known, encoded(codes)[0]]))[0]
        settled()
        model, block = (pa.array(np.full(len(known), t[c][0].as_py()), pa.int64()) for c in by)
        return pa.table([model, block, pa.array(known)], [*by, "code"])

    pairs = written(rows.groupBy(*by).applyInArrow(different, "model long, block long, code long"))
    back = log_probabilities(pairs, seen, weights, models)
    rest = [c for c in rows.columns if c not in by and (with_text or c != "text")]

    def score(t: pa.Table, known: pa.Table) -> pa.Table:
        code, logp = known["code"].to_numpy(), known["logp"].to_numpy()
        order = np.argsort(code)
        code, logp = code[order], logp[order]
        total, n = np.zeros(t.num_rows), np.zeros(t.num_rows, np.int64)
        for codes, of, size in pieces(unpacked(t, parts)):
            new, at = encoded(codes)
            each = logp[np.searchsorted(code, new)][at]
            np.add.at(total, of, np.add.reduceat(each, np.cumsum(size) - size))
            np.add.at(n, of, size)
        settled()
        nll = pa.array(-total / np.maximum(n, 1), pa.float64(), mask=n == 0)
        whole = {"text": pa.array(unpacked(t, parts), pa.string(), mask=t["text"].is_null().to_numpy())} if with_text else {}
        return pa.table([*(whole[c] if c in whole else t[c] for c in rest), nll], [*rest, "nll"])

    kinds = [T.StructField("text", T.StringType()) if f.name == "text" else f for f in rows.select(*rest).schema.fields]
    out = T.StructType([*kinds, T.StructField("nll", T.DoubleType())])
    return rows.groupBy(*by).cogroup(back.groupBy(*by)).applyInArrow(score, out)


def trusted_ids(labels: DataFrame, key: str = "doc_id") -> DataFrame:
    good = labels.where("quality = 1 and coalesce(toxic, 0) = 0")
    return written(good.select(F.col(key).alias("trusted_id")).where("trusted_id is not null").distinct())


def model_of(group: Column, part: Column) -> Column:
    """A number that names the model of a group's half (0, 1) or whole (2); the group of all is null."""
    return F.xxhash64(group, part)


def judged(df: DataFrame, labels: DataFrame, key: str, text: str, lang: str, quantile: float, with_text: bool) -> DataFrame:
    """row (a struct of df's other columns), text if asked for, nll, limit and keep of every row."""
    rest = [F.col(f"`{c}`") for c in df.columns if c != text]
    rows = df.select(F.struct(*rest).alias("row"), F.col(text).alias("text"), F.col(key).alias("id"), F.coalesce(F.col(lang).cast("string"), F.lit("")).alias("lang"))
    ids = trusted_ids(labels, key)
    rows = rows.join(small_enough(ids, 24), F.col("id") == F.col("trusted_id"), "left").withColumn("trusted", F.col("trusted_id").isNotNull() & (F.coalesce(F.length("text"), F.lit(0)) > 0)).drop("trusted_id")
    rows = rows.withColumn("half", F.pmod(F.xxhash64("id"), F.lit(2)).cast("int"))
    per = written(rows.where("trusted").groupBy("lang", "half").agg(F.sum(F.length("text")).alias("chars")))
    halves = {r[0] for r in per.select("half").distinct().collect()}  # two rows
    shown = ["row", "text"] if with_text else ["row"]
    if not halves:
        none = F.lit(None).cast("double")
        return rows.select(*shown, none.alias("nll"), none.alias("limit"), F.coalesce(F.length("text") > 0, F.lit(False)).alias("keep"))
    own = written(per.groupBy(F.col("lang").alias("grp")).agg(*(F.sum(F.when(F.col("half") == h, F.col("chars")).otherwise(0)).alias(f"c{h}") for h in (0, 1))))
    rows = rows.join(small_enough(own.select(F.col("grp").alias("lang"), "grp"), 64), "lang", "left")
    behind = F.explode(F.array(*(F.struct(F.lit(p).alias("part"), c.alias("chars")) for p, c in ((0, F.col("c1")), (1, F.col("c0")), (2, F.col("c0") + F.col("c1"))))))
    models = own.select("grp", behind.alias("x")).select(model_of(F.col("grp"), F.col("x.part")).alias("model"), model_of(F.lit(None).cast("string"), F.col("x.part")).alias("base"), (F.col("x.chars") / (F.col("x.chars") + TRUST)).alias("own"))
    models = written(models)
    part = F.when(F.col("trusted") & F.lit(len(halves) == 2), F.col("half")).otherwise(F.lit(2))
    trusted = rows.where("trusted").select("grp", "half", "text")
    both = F.explode(F.array(F.lit(2), 1 - F.col("half"))).alias("part")
    of_all = F.lit(None).cast("string")
    some = trusted.select("grp", both, "text").unionByName(trusted.select(of_all.alias("grp"), both, "text"))
    with scratch(df.sparkSession):
        seen, weights = (final(t) for t in estimated(written(counted(some.select(model_of(F.col("grp"), F.col("part")).alias("model"), "text")))))

    # limits first; where there are languages without trusted documents, all trusted ones also set the limit of these
    ask = rows.where("trusted").select("id", "text", "grp", model_of(F.col("grp"), part).alias("model"))
    if not rows.where("grp is null and length(text) > 0").isEmpty():
        ask = ask.unionByName(rows.where("trusted").select("id", "text", of_all.alias("grp"), model_of(of_all, part).alias("model")))
    with scratch(df.sparkSession):
        limits = final(limit_of(written(scored(ask, seen, weights, models)), quantile))
    limits = small_enough(limits, 64)
    done = scored(rows.select("row", "id", "text", "grp", model_of(F.col("grp"), part).alias("model")), seen, weights, models, with_text)
    done = done.join(limits, F.col("grp").eqNullSafe(F.col("of")), "left")
    return done.select(*shown, "nll", "limit", F.coalesce(F.col("nll") <= F.col("limit"), F.lit(False)).alias("keep"))


def limit_of(scores: DataFrame, quantile: float) -> DataFrame:
    """of (a group) and limit of scores(grp, nll): as many standard deviations above its mean as the quantile lies, averaged with all groups'."""
    means = scores.where("nll is not null").groupBy(F.col("grp").alias("of")).agg(F.avg("nll").alias("mean"), F.var_pop("nll").alias("var"), F.count("*").alias("docs"))
    means = written(means)  # a row a group
    var = means.agg(F.sum(F.col("docs") * F.col("var")) / F.sum("docs")).first()[0] or 0.0
    spread = F.sqrt((F.col("docs") * F.col("var") + STEADY * var) / (F.col("docs") + STEADY))
    means = written(means.withColumn("spread", F.when(spread > 0, spread).otherwise(1.0)))
    above = scores.join(small_enough(means, 64), F.col("grp").eqNullSafe(F.col("of")))
    steps = written(above.groupBy("of", F.ceil((F.col("nll") - F.col("mean")) / F.col("spread") * 1000).alias("step")).agg(F.count("*").alias("n")))

    def reached(steps: DataFrame, by: list[str], name: str) -> DataFrame:
        up, every = W.partitionBy(*by).orderBy("step"), W.partitionBy(*by)
        held = steps.withColumn("upto", F.sum("n").over(up)).withColumn("all", F.sum("n").over(every))
        return held.where(F.col("upto") >= quantile * F.col("all")).groupBy(*by).agg((F.min("step") / 1000).alias(name))

    own = reached(steps, ["of"], "at").withColumnRenamed("of", "same")
    common = reached(steps.groupBy("step").agg(F.sum("n").alias("n")), [], "common").first()[0] or 0.0  # over steps, not rows
    out = means.join(own, F.col("of").eqNullSafe(F.col("same")))
    return out.select("of", (F.col("mean") + F.col("spread") * (F.col("docs") * F.col("at") + STEADY * common) / (F.col("docs") + STEADY)).alias("limit"))


def classified(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """key, lang, perplexity, max_perplexity (the language's) and keep."""
    out = judged(df.select(key, lang, text), labels, key, text, lang, quantile, False)
    return out.select(*(F.col("row").getField(c).alias(c) for c in (key, lang)), F.exp("nll").alias("perplexity"), F.exp("limit").alias("max_perplexity"), "keep")


def kept(df: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", lang: str = "lang", quantile: float = QUANTILE) -> DataFrame:
    """The rows of df that the classifier keeps."""
    out = judged(df, labels, key, text, lang, quantile, True).where("keep")
    return out.select(*(F.col("text").alias(c) if c == text else F.col("row").getField(c).alias(c) for c in df.columns))


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, lang, perplexity, max_perplexity and keep of all documents."""
    return classified(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
