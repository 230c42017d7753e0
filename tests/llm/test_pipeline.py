"""The pipeline's stages: each on what the one before kept, against brute force, and on odd rows."""

from collections import Counter, defaultdict

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F

import corpus_pipeline
from sparkvec.llm import op03_quality, op05_sentencepiece, op07_mixing
from tests.llm.test_text_operators import PIECES, KneserNey, brute_schedule, distance, odd, without_later_lines

SF = "/root/testdata/sf0.001"


def test_stages(spark):
    docs = first = spark.read.parquet(f"{SF}/documents.parquet")
    kept = []
    for name, stage in corpus_pipeline.STAGES[:-1]:
        docs = spark.createDataFrame(stage(spark, docs, SF).toPandas(), first.schema)
        kept.append((name, docs.count(), docs.select("doc_id").distinct().count()))
        assert docs.columns == first.columns
        assert docs.where("n_chars <> length(text)").count() == 0
    quality, lines, near, mixed = (n for _, n, _ in kept)
    assert first.count() > quality == lines > near
    assert mixed >= kept[-1][2]
    labels = spark.read.parquet(f"{SF}/labels.parquet")
    clean = labels.where("quality = 1 and toxic = 0").select("doc_id")
    left = corpus_pipeline.STAGES[0][1](spark, first, SF)
    assert clean.join(left, "doc_id", "left_semi").count() >= 0.95 * clean.count()
    out = corpus_pipeline.STAGES[-1][1](spark, docs, SF)
    assert out.count() == docs.count()
    back = op05_sentencepiece.decode(out, PIECES)
    assert sorted(r.decoded for r in back.collect()) == sorted(r.text for r in docs.collect())


@pytest.fixture(scope="module")
def small(spark, tmp_path_factory):
    """A folder with 60 short documents, copies of every kind among them, and their labels."""
    to = str(tmp_path_factory.mktemp("small"))
    some = spark.read.parquet(f"{SF}/documents.parquet").where("length(text) > 500").orderBy("doc_id").limit(40).collect()
    rows = [(r.doc_id, "\n".join(" ".join(r.text.split()[i : i + 20]) for i in (0, 20, 40)), r.lang, r.source, 0) for r in some]
    rows += [(1000 + d, f"{t} more", lang, source, 0) for d, t, lang, source, _ in rows[:8]]
    rows += [(2000 + d, t.split("\n")[1] + f"\nown words of {d} here", lang, source, 0) for d, t, lang, source, _ in rows[8:14]]
    rows += [(3000 + d, t.upper() + "!!", lang, source, 0) for d, t, lang, source, _ in rows[14:18]]
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").withColumn("n_chars", F.length("text").cast("long"))
    df.write.parquet(f"{to}/documents.parquet")
    df.where("doc_id < 3000").select("doc_id", F.lit(1).alias("quality"), F.lit(0).alias("toxic")).write.parquet(f"{to}/labels.parquet")
    return to


def test_pipeline_by_brute_force(spark, small):
    stages = dict(corpus_pipeline.STAGES)
    docs = spark.read.parquet(f"{small}/documents.parquet")
    rows = docs.collect()

    # quality: models of each language and of all, of all trusted documents and of each half
    half = {r[0]: r[1] for r in docs.select("doc_id", F.pmod(F.xxhash64("doc_id"), F.lit(2))).collect()}
    trusted = {r.doc_id: r.text for r in rows if r.doc_id < 3000}
    lang = {r.doc_id: r.lang for r in rows}
    models = {}
    for g in [None, *set(lang.values())]:
        for part in (0, 1, 2):
            some = [t for d, t in trusted.items() if half[d] != part and g in (None, lang[d])]
            models[g, part] = KneserNey(some) if some else None, sum(map(len, some))

    def nll(r):
        part = half[r.doc_id] if r.doc_id in trusted else 2
        (own, n), (base, _) = models[r.lang, part], models[None, part]
        w, t = n / (n + op03_quality.TRUST), op03_quality.START + r.text
        p = [(w * own.p(t[i - 3 : i], t[i]) if own else 0) + (1 - w) * base.p(t[i - 3 : i], t[i]) for i in range(3, len(t))]
        return -np.mean(np.log(p))

    score = {r.doc_id: nll(r) for r in rows}
    groups = {g: [score[d] for d in trusted if lang[d] == g] for g in {lang[d] for d in trusted}}
    var = sum(len(x) * np.var(x) for x in groups.values()) / len(trusted)
    steady = op03_quality.STEADY
    spread = {g: np.sqrt((len(x) * np.var(x) + steady * var) / (len(x) + steady)) for g, x in groups.items()}
    steps = {g: sorted(np.ceil((np.array(x) - np.mean(x)) / spread[g] * 1000).tolist()) for g, x in groups.items()}
    place = lambda x: next(s for s in x if sum(y <= s for y in x) >= op03_quality.QUANTILE * len(x)) / 1000
    common = place(sorted(s for x in steps.values() for s in x))
    limit = {g: np.mean(x) + spread[g] * (len(x) * place(steps[g]) + steady * common) / (len(x) + steady) for g, x in groups.items()}
    good = [r for r in rows if score[r.doc_id] <= limit[r.lang]]
    assert len(good) < len(rows) and len(set(limit.values())) == len(groups) > 1
    got = stages["quality"](spark, docs, small)
    assert sorted(map(tuple, got.collect())) == sorted(map(tuple, good))

    lines = without_later_lines([(r.doc_id, r.text) for r in good])
    texts = {d: t for d, (t, _, _) in lines.items()}
    got = stages["line_dedup"](spark, got, small)
    assert {r.doc_id: r.text for r in got.collect()} == texts and len(texts) < len(rows)

    root = {d: d for d in texts}
    find = lambda d: d if root[d] == d else find(root[d])
    for a in texts:
        for b in texts:
            x, y = texts[a].split(), texts[b].split()
            if a < b and abs(len(x) - len(y)) <= 0.2 * max(len(x), len(y)) and distance(x, y) <= 0.2 * max(len(x), len(y)) + 1e-9:
                root[max(find(a), find(b))] = min(find(a), find(b))
    firsts = {d: texts[d] for d in texts if find(d) == d}
    got = stages["near_dedup"](spark, got, small)
    assert {r.doc_id: r.text for r in got.collect()} == firsts and len(firsts) < len(texts)

    placed = op07_mixing.mixture(got)[0].collect()
    aims = [t for _, t in sorted({(r.src, r.target) for r in placed})]
    n = op07_mixing.n_slots(sum(aims), op07_mixing.BLOCK, op07_mixing.SLOTS)
    key = {(r.src, r.bucket, r.rn): r.key for r in placed}
    order = sorted((r.src, r.bucket, r.rn, r["size"]) for r in placed)
    taken = Counter(key[src, *at] for src, words in brute_schedule(order, aims, n, sum(aims) / n) for at in words)
    want = []
    for d, words in taken.items():
        size = len(firsts[d].split())
        want += [" ".join(firsts[d].split()[: min(size, words - done)]) for done in range(0, words, size)]
    got = stages["mixing"](spark, got, small)
    assert sorted(" ".join(r.text.split()) for r in got.collect()) == sorted(want)

    library = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    out = stages["encoding"](spark, got, small).collect()
    assert sorted(tuple(r.ids) for r in out) == sorted(tuple(library.encode(r.text)) for r in got.collect())
    assert all(r.n_tokens == len(r.ids) for r in out)
    whole = corpus_pipeline.run(spark, small)
    assert sorted((r.doc_id, tuple(r.ids)) for r in whole.collect()) == sorted((r.doc_id, tuple(r.ids)) for r in out)


def test_stages_keep_odd_rows(spark, small):
    """Null ids and repeated ids with other texts are documents of their own; other columns come along."""
    mine = [(None, "null one, with enough of words", "en", "s", 1), (None, "another null, of other words again", None, None, 1), (7, "first text of seven is this", "en", "s", 1), (7, "second text of the same id", "en", "t", 1), (8, "x y " * 40_000, "en", "s", 1), (9, "", "en", "s", 0), (10, None, "en", "s", None)]
    df = odd(spark).unionByName(spark.createDataFrame(mine, "doc_id long, text string, lang string, source string, n_chars long").withColumns({"key": F.lit(2), "ids": F.lit("y")}))
    df = df.withColumns({c: F.lit(5) for c in ("row", "block", "model", "nll", "gone", "doc", "ref", "slot", "run", "sv_own", "sv_nll", "sv_gone")})
    names = Counter((r.doc_id, r.text) for r in df.collect())
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, df, small)
        assert out.columns == df.columns, name
        found = out.collect()
        assert all(r.ids in ("x", "y") and r.sv_own == 5 and r.slot == 5 for r in found)
        if name == "quality":
            assert not Counter((r.doc_id, r.text) for r in found) - names
        if name == "line_dedup":
            assert len(found) == sum(names.values())
            assert {t for _, t, *_ in mine[:4]} <= {r.text for r in found}
        if name == "near_dedup":
            assert {t for _, t, *_ in mine[:5]} <= {r.text for r in found}
        if name == "mixing":
            sizes = defaultdict(int)
            for r in found:
                sizes[r.doc_id, r.source] += len((r.text or "").split())
            assert {(None, "s"), (None, None), (7, "s"), (7, "t")} <= {k for k, n in sizes.items() if n}
        empty = stage(spark, df.limit(0), small)
        assert empty.count() == 0 and empty.columns == df.columns
    assert corpus_pipeline.STAGES[-1][1](spark, df, small).count() == sum(names.values())
