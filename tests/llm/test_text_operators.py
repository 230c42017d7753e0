"""Text operators against the libraries and brute force, and on nulls, empty and long texts, repeated rows and odd columns."""

import os
import random
import re
import zlib
from collections import defaultdict

import numpy as np
import public_tokenizers
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from sparkvec.llm import op02_line_dedup, op03_quality, op04_token_files, op05_sentencepiece, op06_order_minhash, op07_mixing, op08_token_counts, op09_html, transducer
from sparkvec.llm.words import segments_of

SF = "/root/testdata/sf0.001"
BPE, PIECES = public_tokenizers.path("word_bpe_49k.json"), public_tokenizers.path("piece_bpe_32k.model")
ODD = [None, "", " ", "a", "It's 12.5 <|endoftext|>x, Ω.ΣΑΣ é. İ \x1d ...", "x" * 300, "the cat " * 9000, "a\n\nb\t c ", "日本 😀, ok.", "a"]
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def odd(spark):
    rows = [(i * 3, t, None if i == 1 else "en", None if i == 2 else "s", 0) for i, t in enumerate(ODD)]
    return spark.createDataFrame([*rows, rows[-1], (None, "null id", "en", "s", 1)], DOCS).withColumn("key", F.lit(1)).withColumn("ids", F.lit("x"))


@pytest.fixture(scope="module")
def documents(spark):
    return spark.read.parquet(f"{SF}/documents.parquet")


@pytest.fixture(scope="module")
def texts(documents):
    return {r.doc_id: r.text for r in documents.collect()}


def library(texts):
    t = Tokenizer.from_file(BPE)
    return [e.ids for e in t.encode_batch_fast([x or "" for x in texts], add_special_tokens=False)]


def test_token_counts(spark, documents, texts):
    got = {r.doc_id: r for r in op08_token_counts.query(spark, SF).collect()}
    for (d, t), ids in zip(texts.items(), library(texts.values()), strict=True):
        assert (got[d].n_bytes, got[d].n_tokens, got[d].over_limit) == (len((t or "").encode()), len(ids), len(ids) > 2048)
    rows = odd(spark)
    got = op08_token_counts.count_tokens(rows, BPE, chunk=1000).collect()
    want = [(r.doc_id, len(ids)) for r, ids in zip(rows.collect(), library(r.text for r in rows.collect()), strict=True)]
    assert sorted(((r.doc_id, r.n_tokens) for r in got), key=str) == sorted(want, key=str)
    assert op08_token_counts.count_tokens(rows.limit(0), BPE).count() == 0


def test_special_strings_keep_their_case():
    known = segments_of(BPE)
    some = ["A <|ENDOFTEXT|> b", "<|EndOfText|>", "x<|endoftext|>Y"]
    ids, _ = known.ids(known.of_texts(some)[0])
    assert ids.tolist() == [i for x in library(some) for i in x]


def fuzzed(n, seed):
    rng = random.Random(seed)
    some = ["a", "b", "th", "e", "'", "'s", "'re", "'l", "'ll", "'v", "r", "1", "2٣", "é", "e\u0301", "İ", "ς", "Σ", "日本", "😀", "!", "?!", " ", "\n", "<|endoftext|>", "<|END", "|>", "\x1d", "\u3000", "ing", "tion", "S", "ß", "ﬁ", "²", "_"]
    return ["".join(rng.choice(some) for _ in range(rng.randrange(1, 25))) for _ in range(n)]


@pytest.mark.parametrize(("chunk", "states"), [(1, 150_000), (2, 40), (7, 150_000), (1000, 40)])
def test_chunk_maps_compose(monkeypatch, chunk, states):
    monkeypatch.setattr(transducer, "MOST_STATES", states)
    monkeypatch.setattr(transducer.ChunkMap, "MARK_EVERY", 3)
    machine = transducer.Machine(BPE)
    some = [*ODD[1:6], *ODD[7:], *fuzzed(2000, chunk)]
    assert [transducer.count_text(machine, t, chunk) for t in some] == [len(ids) for ids in library(some)]
    assert len(machine.states) <= states


def test_emitted_tokens_are_those_of_every_prefix():
    machine = transducer.machine_of(BPE)
    text = "it's they'll don't're hello, (world)!! 2024 straße unbelievably antidisestablishmentarianism'll"
    state, n = machine.start, 0
    for i, c in enumerate(text):
        state, k = state[c]
        n += k
        assert n == len(library([text[: i + 1]])[0]), text[: i + 1]


def test_a_long_text_without_white_space():
    rng = random.Random(4)
    machine = transducer.machine_of(BPE)
    text = "".join(rng.choice(["the", "ing", "ation", "er", "st", "q", "1"]) for _ in range(1_500_000))
    cut = text[:150_000]
    assert transducer.count_text(machine, cut, 1000) == len(library([cut])[0])
    assert transducer.count_text(machine, text, 1 << 16) == transducer.count_text(machine, text, len(text))


def test_token_files(spark, texts):
    got = {r.doc_id: r for r in op04_token_files.query(spark, SF).collect()}
    start = 0
    for d, ids in zip(sorted(texts), library(texts[d] for d in sorted(texts)), strict=True):
        ids = [*ids, 1]
        assert (got[d].start, got[d].n_tokens, got[d].ids_crc32) == (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)


def test_token_files_of_odd_rows(spark, tmp_path):
    op04_token_files.write_tokens(odd(spark), str(tmp_path / "t"), BPE)
    rows = op04_token_files.read_tokens(spark, str(tmp_path / "t")).orderBy("start").collect()
    assert [r.key for r in rows] == [None, *(3 * i for i in range(10)), 27]
    assert [r.start for r in rows] == np.cumsum([0] + [r.n_tokens for r in rows])[:-1].tolist()
    assert all(r.ids[-1] == 1 for r in rows)
    narrow = op04_token_files.read_tokens(spark, str(tmp_path / "t")).select("key", "n_tokens")
    assert "ids" not in narrow._jdf.queryExecution().executedPlan().toString().split("ReadSchema")[-1]
    op04_token_files.write_tokens(odd(spark).limit(0), str(tmp_path / "e"), BPE)
    assert op04_token_files.digest(op04_token_files.read_tokens(spark, str(tmp_path / "e"))).count() == 0


def test_token_files_are_read_in_parts(spark, tmp_path):
    import pyarrow.parquet as pq

    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    texts = {r.doc_id: r.text for r in documents.collect()}
    to = str(tmp_path / "t")
    op04_token_files.write_tokens(documents, to, BPE, row_group=64 << 10, page=4 << 10)
    flat, keys = [], sorted(texts)
    for ids in library(texts[d] for d in keys):
        flat += [*ids, 1]
    for first, last in ((0, 10), (1234, 5678), (len(flat) - 5, len(flat)), (len(flat), len(flat) + 9), (0, len(flat))):
        got = op04_token_files.read_token_range(spark, to, first, last).orderBy("start").collect()
        assert [i for r in got for i in r.ids] == flat[first:last]
        at = first
        for r in got:
            assert r.start == at
            at += len(r.ids)
    assert [r.key for r in op04_token_files.read_keys(spark, to, keys[20], keys[25]).orderBy("key").collect()] == keys[20:26]
    groups, outside = 0, 0
    for f in (tmp_path / "t").glob("*.parquet"):
        m = pq.ParquetFile(f).metadata
        for g in range(m.num_row_groups):
            cols = {m.row_group(g).column(c).path_in_schema: m.row_group(g).column(c) for c in range(m.row_group(g).num_columns)}
            ids = next(c for n, c in cols.items() if n.startswith("ids."))
            assert {"DELTA_BINARY_PACKED", "RLE_DICTIONARY"} & set(ids.encodings) and all(c.has_offset_index and c.has_column_index for c in cols.values())
            s = cols["key"].statistics
            groups, outside = groups + 1, outside + (s.max < keys[20] or s.min > keys[25])
    assert groups >= 6 and outside >= groups - 2
    plan = op04_token_files.read_keys(spark, to, keys[20], keys[25])._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(key" in plan
    long = spark.createDataFrame([(1, "a" * 3_000_000), (2, "b c " * 500_000)], "doc_id long, text string")
    op04_token_files.write_tokens(long, str(tmp_path / "l"), BPE)
    assert [r.n_tokens for r in op04_token_files.read_tokens(spark, str(tmp_path / "l")).orderBy("key").collect()][1] == 1_000_001


def test_sentencepiece_is_the_librarys(spark, texts):
    m = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    known = op05_sentencepiece.segments_of(PIECES)
    some = [t or "" for t in [*ODD, *texts.values(), "  a  b ", "\nx", "▁▁y", "q" * 90 + " zz"]]
    ids, n = known.encode(some)
    ends = np.cumsum(n)
    assert [ids[z - k : z].tolist() for k, z in zip(n, ends, strict=True)] == m.encode(some, num_threads=1)
    assert [b.decode() for b in known.decode(ids, n)] == [t.replace("▁", " ") for t in some]


def test_sentencepiece_of_odd_rows(spark):
    out = op05_sentencepiece.decode(op05_sentencepiece.encode(odd(spark), PIECES), PIECES)
    assert all(r.decoded == (r.text or "") for r in out.collect())
    assert op05_sentencepiece.encode(odd(spark).limit(0), PIECES).count() == 0
    assert op05_sentencepiece.round_trip(odd(spark), PIECES).where("decoded_same").count() == 12


def without_later_lines(rows, near=0.8):
    """Brute force: every line against all earlier ones."""
    seen, out = [], {}
    for d, t in sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0)):
        if t is None:
            out[d] = (None, 0, 0)
            continue
        kept = []
        for line in t.split("\n"):
            s = frozenset(line.lower().split())
            if not s or not any(len(s & o) >= near * len(s | o) - 1e-9 for o in seen):
                kept.append(line)
            seen += [s] if s else []
        out[d] = ("\n".join(kept), t.count("\n") + 1, t.count("\n") + 1 - len(kept))
    return out


def test_line_dedup(spark):
    rng = random.Random(5)
    words = ["the", "of", "a", *(f"w{i}" for i in range(60))]
    lines = [" ".join(rng.choice(words) for _ in range(rng.choice([1, 2, 4, 9, 20, 55]))) for _ in range(60)]
    lines += [" ".join(w if rng.random() > 0.06 else "new" for w in x.split()) for x in rng.choices(lines, k=60)] + ["", "  "]
    rows = [(i, "\n".join(rng.choices(lines, k=5))) for i in range(60)] + [(None, lines[0]), (70, None), (71, ""), (72, "x " * 3000 + "\nx")]
    df = spark.createDataFrame(rows, "doc_id long, text string").withColumn("line", F.lit("clash")).withColumn("gone", F.lit(1))
    got = op02_line_dedup.deduplicated(df, lines_as="n", gone_as="m").collect()
    assert {r.doc_id: (r.text, r.n, r.m) for r in got} == without_later_lines(rows)
    assert op02_line_dedup.deduplicated(df.limit(0)).count() == 0


def test_near_copies(spark, documents, texts):
    rng = random.Random(3)
    base = [t for t in texts.values() if 150 < len(t.split()) < 600][:20]
    rows = [(i, t) for i, t in enumerate(base)]
    for i, t in enumerate(base):
        for n in range(3):
            w = t.split(" ")
            for _ in range(len(w) // 60):
                w[rng.randrange(len(w))] = f"new{rng.random()}"
            rows.append((100 + 3 * i + n, " ".join(w)))
    rows += [(500 + i, t) for i, t in enumerate(base)]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    found = {r.doc_id: r.class_id for r in op06_order_minhash.classes(df).collect()}
    apart = {r.doc_id: r.class_id for r in op06_order_minhash.classes(df.where("doc_id < 100")).collect()}
    for i in range(len(base)):
        assert found[500 + i] == found[i] == found[100 + 3 * i] == found[101 + 3 * i] == found[102 + 3 * i] == apart[i]


def distance(x, y):
    row = list(range(len(y) + 1))
    for i, a in enumerate(x, 1):
        last, row[0] = row[0], i
        for j, b in enumerate(y, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (a != b))
    return row[-1]


def test_alignment_is_the_edit_distance():
    rng = np.random.default_rng(2)
    for _ in range(150):
        x = rng.integers(0, 6, rng.integers(1, 30)).astype(np.uint64)
        y = x.copy()
        for _ in range(rng.integers(0, 9)):
            at = rng.integers(0, len(y) + 1)
            y = np.insert(y, at, 9) if rng.random() < 0.5 else np.delete(y, min(at, len(y) - 1)) if len(y) > 1 else y
        d = distance(x.tolist(), y.tolist())
        for band in (0, 2, 5, 40):
            assert min(op06_order_minhash.banded(x, y, band), band + 1) == min(d, band + 1)
        assert op06_order_minhash.anchored(x, y) >= d
        assert op06_order_minhash.near(x, y) == (1 - d / max(len(x), len(y)) >= 0.8 - 1e-9)


def test_near_copies_of_odd_rows(spark):
    got = op06_order_minhash.classes(odd(spark)).collect()
    by = defaultdict(set)
    for r in got:
        by[r.class_id].add(r.doc_id)
    assert {0, 3, 6} in by.values() and {9, 27} in by.values() and {None} in by.values()
    assert len(got) == 12
    kept = [r.doc_id for r in op06_order_minhash.deduplicated(odd(spark)).collect()]
    assert len(kept) == len(set(kept)) and 9 in kept and 27 not in kept
    assert op06_order_minhash.classes(odd(spark).limit(0)).count() == 0


def test_sketches_meet_down_to_the_threshold():
    rng = random.Random(6)
    for n, gap, least in ((200, 5, 0.97), (200, 8, 0.99), (200, 10, 0.99), (35, 5, 0.99), (5, 5, 0.99), (9, 9, 0.99), (41, 5, 0.93)):
        met = 0
        for _ in range(300):
            x = [rng.getrandbits(64) for _ in range(n)]
            y = [rng.getrandbits(64) if i % gap == gap // 2 else w for i, w in enumerate(x)]
            docs = [np.array(d, np.uint64) for d in (x, y)]
            assert op06_order_minhash.near(*docs)
            a, b = op06_order_minhash.sketch_lists(docs).to_pylist()
            met += bool(set(a) & set(b))
        assert met >= least * 300, (n, gap, met)


def test_rows_of_one_id_are_documents_of_their_own(spark):
    rows = [(None, "one two\nred sky"), (None, "three four\none two"), (None, "five six\nblue sea"), (7, "seven eight\ngreen hill"), (7, "nine ten\nseven eight"), (7, "nine ten\nseven eight")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    out = [r.text for r in op02_line_dedup.deduplicated(df).collect()]
    left = [x for t in out for x in t.split("\n")]
    assert len(out) == 6 and {x for _, t in rows for x in t.split("\n")} == set(left)
    assert left.count("one two") == 1
    kept = op06_order_minhash.deduplicated(df).collect()
    assert sorted(r.text for r in kept) == sorted({t for _, t in rows})


def test_near_copies_behind_other_heads(spark):
    rng = random.Random(8)
    word = lambda: f"w{rng.random()}"
    rows = []
    for f in range(40):  # one head that shares three quarters with a family, whose members are near each other only
        shared, own = [word() for _ in range(150)], [word() for _ in range(50)]
        rows.append((f, " ".join(shared + [word() for _ in range(50)])))
        for n in range(3):
            w = own + shared if f % 2 else shared + own
            for _ in range(8):
                w[rng.randrange(len(w))] = word()
            rows.append((1000 + 10 * f + n, " ".join(w)))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    sk = op06_order_minhash.sketches([op06_order_minhash.word_hashes(t) for _, t in rows])
    of, words = defaultdict(list), [op06_order_minhash.word_hashes(t) for _, t in rows]
    for i, line in enumerate(sk.tolist()):
        for x in line:
            of[x].append(i)
    root = list(range(len(rows)))
    find = lambda i: i if root[i] == i else find(root[i])
    for i, j in {(i, j) for b in of.values() for i in b for j in b if i < j}:  # all pairs of all buckets
        if op06_order_minhash.near(words[i], words[j]):
            root[max(find(i), find(j))] = min(find(i), find(j))
    want = {d: rows[find(i)][0] for i, (d, _) in enumerate(rows)}
    assert {r.doc_id: r.class_id for r in op06_order_minhash.classes(df).collect()} == want


def test_unlike_texts_of_a_bucket_are_not_aligned(spark, monkeypatch):
    rng = random.Random(9)
    word = lambda: f"w{rng.randrange(2000)}"
    shared = [word() for _ in range(500)]  # a passage, so that they share sketches
    rows = [(i, " ".join(shared + [word() for _ in range(400 + i)])) for i in range(30)]
    w = shared + [word() for _ in range(400)]
    rows += [(100 + i, " ".join(w[: 900 - 60 * i])) for i in range(4)]  # and a family whose lengths differ
    met, verified = [], op06_order_minhash.verified
    monkeypatch.setattr(op06_order_minhash, "verified", lambda pairs, held, least: met.append(pairs.count()) or verified(pairs, held, least))
    found = {r.doc_id: r.class_id for r in op06_order_minhash.classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert found == {i: min(i, 100) for i, _ in rows}
    assert sum(met[op06_order_minhash.STARS :]) < 100, met  # of 435 pairs


def test_marks_and_bits_bound_the_edits(spark):
    rng = np.random.default_rng(4)
    docs, words = [], rng.integers(0, 1 << 63, 501).astype(np.uint64)
    for _ in range(60):
        x = words[rng.integers(0, 400, rng.integers(1, 1500))]
        y = x.copy()
        for _ in range(int(rng.integers(0, 1 + len(x) // 5))):  # up to the threshold
            at, kind = rng.integers(0, len(y) + 1), rng.random()
            y = np.insert(y, at, words[500]) if kind < 0.3 else np.delete(y, min(at, len(y) - 1)) if kind < 0.6 and len(y) > 1 else y
            y[min(at, len(y) - 1)] = words[rng.integers(0, 500)]
        docs += [x, y]
    m, b = op06_order_minhash.marks(docs)
    rows = [(i // 2, len(d), x, y) for i, (d, x, y) in enumerate(zip(docs, m.to_pylist(), b.to_pylist(), strict=True))]
    sides = [spark.createDataFrame(rows[i::2], "i long, n long, marks array<long>, bits array<long>").alias(s) for i, s in ((0, "a"), (1, "b"))]
    pairs = sides[0].join(sides[1], "i").select("i", op06_order_minhash.may(0.8).alias("may"), op06_order_minhash.may_still(0.8).alias("still")).collect()
    like = {i for i in range(60) if op06_order_minhash.near(docs[2 * i], docs[2 * i + 1])}
    assert len(like) > 20 and like <= {r.i for r in pairs if r.may and r.still}


def targets(sizes, share=1.5, cap=2):
    """By bisection, unlike the operator."""
    w = [(3, 1, 2)[i % 3] for i in range(len(sizes))]
    low, high = 0.0, 1e12
    for _ in range(300):
        mid = (low + high) / 2
        low, high = (mid, high) if sum(min(mid * a, cap * s) for a, s in zip(w, sizes, strict=True)) < share * sum(sizes) else (low, mid)
    return [min(low * a, cap * s) for a, s in zip(w, sizes, strict=True)]


def brute_schedule(rows, aims, n, wide, cap=2):
    """Slot by slot: the next block of the source that the point falls to; rows are (src, bucket, rn, size) in stream order."""
    words = defaultdict(list)
    for src, bucket, rn, size in rows:
        words[src] += [(bucket, rn)] * size
    done, mix = defaultdict(int), []
    for i in range(n):
        point, total, src = (i * op07_mixing.GOLDEN % 2**64) / 2**64, sum(aims), 0
        while src < len(aims) - 1 and sum(aims[: src + 1]) / total <= point:
            src += 1
        r = done[src]
        done[src] += 1
        stream = words[src] * cap
        mix.append((src, stream[int(r * wide) : int((r + 1) * wide)]))
    return mix


@pytest.mark.parametrize("golden", [op07_mixing.GOLDEN, int(0.123 * 2**64)])
def test_mixing_is_the_schedules(spark, documents, monkeypatch, golden):
    monkeypatch.setattr(op07_mixing, "GOLDEN", golden)
    rows, mix = op07_mixing.mixture(documents, block=97, least=1)
    held = rows.orderBy("src", "bucket", "rn").collect()
    aims = [t for _, t in sorted({(r.src, r.target) for r in held})]
    n = op07_mixing.n_slots(sum(aims), 97, 1)
    want = brute_schedule([(r.src, r.bucket, r.rn, r["size"]) for r in held], aims, n, sum(aims) / n)
    got = defaultdict(lambda: defaultdict(int))
    for r in mix.collect():
        got[r.slot][r.src, r.bucket, r.rn] += r.last - r.first
    for i, (src, words) in enumerate(want):
        counts = defaultdict(int)
        for bucket, rn in words:
            counts[src, bucket, rn] += 1
        assert got[i] == counts, i
    if golden != int(0.123 * 2**64):  # every prefix is near the weights
        seen = [0] * len(aims)
        for i, (src, _) in enumerate(want, 1):
            seen[src] += 1
            assert all(abs(c - i * a / sum(aims)) < 4 for c, a in zip(seen, aims, strict=True))


def test_mixing(spark):
    documents = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = op07_mixing.query(spark, "/root/testdata/sf0.01").join(documents, "doc_id").collect()
    size = {r.doc_id: len(re.findall(r"[^\x20\x09-\x0D]+", r.text or "")) for r in got}
    assert all(r["size"] == size[r.doc_id] and 0 <= r.taken <= 2 * r["size"] and (r.taken > 0) == (r.first_slot is not None) for r in got)
    names = sorted({r.source for r in got})
    sizes = [sum(size[r.doc_id] for r in got if r.source == s) for s in names]
    for s, aim in zip(names, targets(sizes), strict=True):
        own = [r for r in got if r.source == s]
        assert abs(own[0].target - aim) < 1e-6 * aim + 1e-6 and abs(sum(r.taken for r in own) - aim) <= 0.005 * aim + 50
    again = op07_mixing.query(spark, "/root/testdata/sf0.01")
    assert sorted(map(tuple, again.collect())) == sorted((r.doc_id, r["size"], r.source_size, r.target, r.taken, r.first_slot) for r in got)


def test_mixed_documents_follow_the_slots(spark, documents):
    df = documents.withColumn("slot", F.lit("clash")).withColumn("sv_words", F.lit(1))
    df = df.unionByName(df.limit(3)).unionByName(df.limit(2).withColumn("text", F.lit("other words")))
    rows, mix = op07_mixing.mixture(df, block=97)
    out = op07_mixing.mixed_documents(df, block=97)
    assert out.columns == df.columns
    found = out.collect()
    words = lambda t: re.findall(r"[^\x20\x09-\x0D]+", t)
    assert sum(len(words(r.text)) for r in found) == mix.agg(F.sum(F.col("last") - F.col("first"))).first()[0]
    want = mix.groupBy(*op07_mixing.ROW, "key", "epoch").agg(F.min("slot").alias("slot")).orderBy("slot").collect()
    first = {r.slot: set() for r in want}
    for r in want:
        first[r.slot].add(r.key)
    at = 0
    for s in sorted(first):  # documents of one slot in any order
        n = sum(1 for r in want if r.slot == s)
        assert {r.doc_id for r in found[at : at + n]} == first[s]
        at += n
    assert at == len(found)


def test_mixed_documents_of_odd_rows(spark):
    out = op07_mixing.mixed_documents(odd(spark), block=5)
    words = out.select(F.sum(op07_mixing.n_words(F.col("text")))).first()[0]
    want = op07_mixing.taken(*op07_mixing.mixture(odd(spark), block=5)).agg(F.sum("taken")).first()[0]
    assert words == want
    assert out.columns == odd(spark).columns
    assert op07_mixing.taken(*op07_mixing.mixture(odd(spark).limit(0))).count() == 0
    assert op07_mixing.mixed_documents(odd(spark).limit(0)).count() == 0


def test_quality(spark):
    d, labels = spark.read.parquet("/root/testdata/sf0.01/documents.parquet"), spark.read.parquet("/root/testdata/sf0.01/labels.parquet")
    train = labels.where("doc_id % 2 = 0")
    got = op03_quality.classified(d, train).join(labels.where("doc_id % 2 = 1"), "doc_id")
    assert got.select("lang", "max_perplexity").distinct().count() == got.select("lang").distinct().count() > 3  # limits of their own
    share = {r.quality: r.s for r in got.groupBy("quality").agg(F.avg(F.col("keep").cast("double")).alias("s")).collect()}
    assert share[1] > 0.93 and share[0] < 0.15


class KneserNey:
    """Interpolated modified Kneser-Ney by its definition, on strings."""

    def __init__(self, corpus, order=4):
        self.order, self.counts = order, {order: defaultdict(int)}
        for t in corpus:
            t = op03_quality.START + t
            for i in range(len(t) - order + 1):
                self.counts[order][t[i : i + order]] += 1
        for k in range(order - 1, 0, -1):
            self.counts[k] = defaultdict(int)
            for g in self.counts[k + 1]:
                self.counts[k][g[1:]] += 1
        self.cuts, self.after = {}, defaultdict(lambda: defaultdict(int))
        for k, grams in self.counts.items():
            n = [sum(1 for c in grams.values() if c == i) for i in range(5)]
            y = n[1] / (n[1] + 2 * n[2]) if n[1] else 0.5
            free = [i - (i + 1) * y * n[i + 1] / n[i] if n[i] else i / 2 for i in (1, 2, 3)]
            self.cuts[k] = [min(max(f, 0.1), i - 0.05) for i, f in zip((1, 2, 3), free, strict=True)]
            for g, c in grams.items():
                self.after[k, g[:-1]][g[-1]] = c

    def p(self, context, c):
        k = len(context) + 1
        below = 1 / (len(self.counts[1]) + 1) if k == 1 else self.p(context[1:], c)
        seen = self.after.get((k, context))
        if not seen:
            return below
        cut = lambda n: self.cuts[k][min(n, 3) - 1] if n else 0
        total = sum(seen.values())
        n = seen.get(c, 0)
        return (n - cut(n)) / total + sum(map(cut, seen.values())) / total * below

    def nll(self, t):
        t = op03_quality.START + t
        return -np.mean([np.log(self.p(t[i - self.order + 1 : i], t[i])) for i in range(self.order - 1, len(t))])


def test_scores_are_kneser_neys(spark, texts, monkeypatch):
    corpora = {1: [t[:900] for t in list(texts.values())[:12] if t], 2: ["日本語の文章です。", "中文句子,没有空格。", "aaaa aaab", ""]}
    asked = ["The and of", "中文", "日本語 the", "q", "", None, "aaaa" * 40, "x\x02y \ud83d\ude00".encode("utf-16", "surrogatepass").decode("utf-16"), next(iter(texts.values()))[:2500]]
    train = spark.createDataFrame([(m, t) for m, c in corpora.items() for t in c], "model long, text string")
    seen, weights = op03_quality.estimated(op03_quality.counted(train))
    rows = spark.createDataFrame([(m, i, t) for m in corpora for i, t in enumerate(asked)], "model long, id int, text string")
    monkeypatch.setattr(op03_quality, "BLOCK", 300)
    got = {(r.of, r.id): r.nll for r in op03_quality.scored(rows.withColumn("of", F.col("model")), seen, weights).collect()}
    models = {m: KneserNey(c) for m, c in corpora.items()}
    assert len(got) == len(corpora) * len(asked)
    for (m, i), nll in got.items():
        assert (nll is None) if not asked[i] else abs(nll - models[m].nll(asked[i])) < 1e-9, (m, asked[i])
    for m in models.values():  # over all characters and an unknown one
        assert abs(sum(m.p("the", c) for c in [*m.counts[1], "\u0fff"]) - 1) < 1e-9


def test_long_texts_are_read_in_pieces(monkeypatch):
    whole = ["abcdefgh" * 50, "", "xy", "é" * 33]
    want = {i: op03_quality.codes_of(op03_quality.START + t).tolist() for i, t in enumerate(whole) if t}
    monkeypatch.setattr(op03_quality, "PIECE", 7)
    got = defaultdict(list)
    for codes, of, n in op03_quality.pieces(whole):
        for i, part in zip(of, np.split(codes, np.cumsum(n)[:-1]), strict=True):
            got[i] += part.tolist()
    assert got == want


def test_quality_of_odd_rows(spark):
    labels = spark.createDataFrame([(9, 1, 0), (18, 1, None), (27, 1, 1), (None, 1, 0)], "doc_id long, quality int, toxic int")
    got = op03_quality.classified(odd(spark), labels).collect()
    assert len(got) == 12 and all(r.keep is not None for r in got)
    assert not any(r.keep for r in got if r.doc_id in (0, 3))
    assert op03_quality.kept(odd(spark), labels).columns == odd(spark).columns
    assert op03_quality.classified(odd(spark), labels.limit(0)).where("keep").count() == 10
    assert op03_quality.classified(odd(spark).limit(0), labels).count() == 0


PAGE = """<!DOCTYPE html><html><head><title>T</title><style>p{}</style><script>var a="</p><p>no";</script></head><body>
<header class="site-header"><a href=/>Home</a></header><nav><ul><li><a href="/x">Menu one</a></li></ul></nav>
<div class="cookie-notice">We use cookies to make this site work for you and for all of our partners, please accept them now.</div>
<article><header><h1>A &amp; B</h1></header><p>First&nbsp;paragraph   of the
story &#233; with <a href="y">a link</a> in it.</p><div class="ad">Buy now</div><p>Short.<p>Last one<br>ends here.
<div class="comments"><p>I liked this story a lot, thank you for writing it down for all of us to read.</p></div></article>
<aside class="sidebar">Other things to read on this site</aside><form><input name=q> Search</form><footer>&copy; us</footer></body></html>"""


def test_html(spark):
    rows = [(1, "u", PAGE), (2, None, None), (3, "u", ""), (4, "u", "<article><p>Cut off &am"), (4, "u", "<article><p>x <b"), (None, "u", "<p>")]
    df = spark.createDataFrame(rows, "page_id long, url string, html string").withColumn("text", F.lit("clash"))
    got = [(r.page_id, r.text, r.n_chars) for r in op09_html.extract(df).collect()]
    want = "A & B\nFirst paragraph of the story é with a link in it.\nShort.\nLast one ends here."
    assert got == [(1, want, len(want)), (2, "", 0), (3, "", 0), (4, "Cut off &am", 11), (4, "x", 1), (None, "", 0)]
    assert op09_html.extract(df.limit(0)).count() == 0


LONG = "This paragraph has more than a score of words, so it is taken for running text of the story and not for one of the labels around it."


def extracted(page, tree=op09_html.trained()):
    return op09_html.main_text(page, tree)


def test_the_tree_on_layouts_it_has_not_seen():
    tree, held_out = op09_html.trained(), op09_html.examples(99, 150)
    right = [op09_html.judge(tree, r[:-1]) == r[-1] for r in held_out]
    assert len(right) > 2000 and sum(right) / len(right) > 0.98
    label = [r[-1] for r in held_out]
    assert max(sum(label), len(label) - sum(label)) / len(label) < 0.8
    # neither place nor names alone do as well: the tree weighs words and links
    gates = [int(r[6] > 0 and r[7] == 0) == r[-1] for r in held_out]
    assert sum(gates) < sum(right) - 0.02 * len(right)


def test_pages_need_the_tree(spark):
    """Without words and links (a tree of places, names and kinds alone) other texts come out."""
    blind = op09_html.train([(*(0,) * 6, *r[6:9], 0, r[-1]) for r in op09_html.examples(1, 400)])
    pages = list(op09_html.layouts(5, 60))
    assert sum(extracted(p) != extracted(p, blind) for p in pages) > 10


@pytest.mark.parametrize(
    ("page", "want"),
    [
        ('<body><form id="aspnetForm"><div><h1>Head</h1><p>{0}</p><p>{0}</p></div></form></body>', "Head\n{0}\n{0}"),
        ('<article><h1>T</h1><div class="related"><p>{0}</p></div><p class="menu">{0}</p><p>{0}</p></article>', "T\n{0}\n{0}\n{0}"),
        ('<div class="page"><header><h1>Title</h1><p>The standfirst of the story.</p></header><p>{0}</p></div>', "Title\nThe standfirst of the story.\n{0}"),
        ("<h1>T</h1><p>Short one.</p>", "T\nShort one."),
        ("<p>Hi.</p>", "Hi."),
        ("<p>foo<!-- c -->bar</p>", "foobar"),
        ('<article><p>{0}</p></article><section class="discussion"><article><p>{0}</p></article></section>', "{0}"),
        ('<article><p>{0}</p></article><div class="user-reviews"><article><p>{0}</p></article></div>', "{0}"),
        ('<article><h1>A</h1><p>{0}</p><div class="q3">Share on X</div><p>{0}</p></article>', "A\n{0}\n{0}"),
        ('<article><p>{0}</p></article><div class="zz">We use cookies to improve. Accept our cookie policy</div>', "{0}"),
        ('<article><p>{0}</p><div class="most-read"><ul><li><a href=x>One story</a></li></ul></div></article>', "{0}"),
    ],
)
def test_layouts_in_doubt(page, want):
    assert extracted(page.format(LONG)) == want.format(LONG)


@pytest.mark.parametrize("piece", ["<svg>", "<div><i>", "<li><div>", "<form>", "<div class=ad>", "<td>", "<a href=x><p>", "<title", "<svg></svg", "<!--", "<p a=", '<p a="', "<dl><dd>"])
def test_time_grows_with_the_page(piece):
    import time

    def seconds(n):
        began = time.process_time()
        op09_html.blocks(piece * n)
        return time.process_time() - began

    seconds(100)
    assert seconds(16_000) < 0.1 + 16 * max(seconds(2_000), 0.02)


@pytest.mark.parametrize("name", ["entry-header", "post-header", "content has-sidebar", "story related-topic", "main-content", "ad-hoc-notes", "page"])
def test_names_that_are_not_furniture(name):
    page = f'<body><div class="{name}"><h1>Head</h1><p>{LONG}</p><p>Short.</p><p>{LONG}</p></div></body>'
    assert extracted(page) == f"Head\n{LONG}\nShort.\n{LONG}"


@pytest.mark.parametrize("apart", ['<div class="ad">', '<div id="comments">', '<ol class="comment-list">', '<div class="cookie-notice">', '<ul class="nav menu">', '<div role="navigation">', "<aside>", "<form action=x>", "<footer>", '<section class="reader-comments">', '<div class="newsletter-signup box">', '<div class="site-banner">', "<nav>"])
@pytest.mark.parametrize("inside", [True, False])
def test_furniture(apart, inside):
    tag = apart[1:].split()[0].strip(">")
    box = f"{apart}<h2>Not this</h2><article><p>{LONG} Nor this.</p></article></{tag}>" if "comment" in apart or tag == "aside" else f"{apart}<h2>Not this</h2><p>{LONG} Nor this.</p></{tag}>"
    page = f"<body><article><h1>Head</h1><p>One.</p>{box if inside else ''}<p>Two.</p></article>{'' if inside else box}</body>"
    assert extracted(page) == "Head\nOne.\nTwo."


def test_html_syntax():
    art = "<article>{}</article>".format
    assert extracted(art("<p>" + "\u0130" * 40 + "<SCRIPT>no</sCript ><p>yes")) == "\u0130" * 40 + "\nyes"
    assert extracted(art("<p title=it's>a<p data-x='>'>b<p x=\"1\"y='2'>c<p =d>e</p>")) == "a\nb\nc\ne"
    assert extracted(art("<p>a < b &lt; c &amp;amp; &#8364;&eacute &notit; x<!-- <p>no --><!-->d<!doctype x><?php no ?></3 no>e</p>")) == "a < b < c &amp; €é ¬it; xde"
    assert extracted(art("<p>a<br>b\n\t c&nbsp;d<textarea><p>no</textarea><select><option>no<option>no</select><svg><title>no</title><svg></svg></svg>e</p>")) == "a b c d e"
    assert extracted("<head><title>no</title><p>yes") == "yes" and extracted(f"<head><title>no</title><p>{LONG}") == LONG
    assert extracted(art("<p>a</p><p class='x")) == "a"
    assert extracted(f'<div><a href="/x"><h2>Menu one</h2><h2>Menu two</h2></a></div><p>{LONG}</p>') == LONG  # a link around blocks
    assert extracted(f'<div><a name="x">Heading</a></div><p>{LONG}</p>') == f"Heading\n{LONG}"
    assert extracted(art(f'<p>Under twenty-eight words.</p><p><a href="a">all link</a></p><p>{LONG}</p>')) == f"Under twenty-eight words.\nall link\n{LONG}"
    assert extracted(art("<p>x</p>" * 30_000 + "<b>" * 30_000)).count("x") == 30_000


def test_pages_against_another_parser(spark):
    from html.parser import HTMLParser

    class Articles(HTMLParser):
        def __init__(self):
            super().__init__(convert_charrefs=True)
            self.deep, self.out = 0, [""]

        def handle_starttag(self, tag, attrs):
            self.deep += tag == "article"
            self.out[-1] += " " if tag == "br" else ""
            if tag in ("p", "h1", "article"):
                self.out.append("")

        def handle_endtag(self, tag):
            self.deep -= tag == "article"
            if tag in ("p", "h1", "article"):
                self.out.append("")

        def handle_data(self, data):
            if self.deep:
                self.out[-1] += data

    pages = spark.read.parquet("/root/testdata/sf0.01/pages.parquet")
    got = {r.page_id: r.text for r in op09_html.extract(pages).collect()}
    for r in pages.collect():
        a = Articles()
        a.feed(r.html or "")
        a.close()
        assert got[r.page_id] == "\n".join(" ".join(x.split()) for x in a.out if x.split())


@pytest.mark.parametrize("alphabet", [["the", "ing", "ation", "er", "q"], ["a"], ["ab", "a"], list("abcdefghij"), ["日", "本", "é"], ["!", "="]])
def test_sentencepiece_runs_without_spaces(alphabet):
    rng = random.Random(5)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    model = sentencepiece.SentencePieceProcessor(model_file=PIECES)
    assert op05_sentencepiece.Segments(PIECES).encode([text])[0].tolist() == model.encode(text)


def test_sentencepiece_memory_of_a_long_run():
    """A worker's memory grows by less than 150 bytes for each character of a segment."""
    import subprocess
    import sys

    code = """
import random, resource, sys
from sparkvec.llm import op05_sentencepiece as m
known = m.Segments(sys.argv[1])
size = lambda: resource.getrusage(resource.RUSAGE_SELF).ru_maxrss * 1024
make = lambda k: "".join(random.Random(6).choices(["the", "ing", "ation", "er", "q"], k=k))
known.encode([make(100_000)])
before, text = size(), make(400_000)
ids, n = known.encode([text])
assert known.decode(ids, n)[0].decode() == text
print((size() - before) / len(text))
"""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    out = subprocess.run([sys.executable, "-c", code, PIECES], capture_output=True, text=True, cwd=root, env={**os.environ, "PYTHONPATH": os.pathsep.join([root, os.environ.get("PYTHONPATH", "")])}, check=True)
    assert float(out.stdout) < 150
