"""Byte-level BPE against the library, on random odd strings, long runs and odd rows."""

import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken
from pyspark.sql import functions as F

from sparkvec.llm import op12_byte_bpe as bpe
from sparkvec.llm.cuts import in_cuts

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
SOME = ["a", "b", "th", "e", "'", "'s", "'re", "'ll", "1", "2٣", "é", "é", "İ", "日本", "😀", "!", "?!", " ", "\n", "  ", "\x1d", "　", "\x85", "ing", "՘", "\U0001e5f0", "࢏", "²", "_", "\U00016ff4", "﻿", "\0"]


@pytest.fixture(scope="module")
def coder():
    return bpe.coder_of(PATH, public_tokenizers.PATTERN)


@pytest.fixture(scope="module")
def library(coder):
    e = tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=coder.rank_of, special_tokens={})
    return e.encode_ordinary


def flat(rows):
    return [i for r in rows for i in r]


def test_query(spark, library):
    texts = {r.doc_id: r.text or "" for r in spark.read.parquet(f"{SF}/documents.parquet").collect()}
    got = {r.doc_id: r for r in bpe.query(spark, SF).collect()}
    assert got.keys() == texts.keys()
    for d, t in texts.items():
        ids = library(t)
        assert (got[d].n_tokens, got[d].ids_sha256) == (len(ids), hashlib.sha256(",".join(map(str, ids)).encode()).hexdigest())
        assert got[d].decoded_sha256 == hashlib.sha256(t.encode()).hexdigest()


@pytest.mark.parametrize("seed", range(3))
def test_random_strings(coder, library, seed):
    rng = random.Random(seed)
    texts = ["".join(rng.choice(SOME) for _ in range(rng.randrange(60))) for _ in range(2000)]
    texts += ["".join(chr(rng.choice([rng.randrange(0xD800), rng.randrange(0xE000, 0x110000)])) for _ in range(40)) for _ in range(500)]
    ids, n = coder.encode(texts)
    assert ids.tolist() == flat(map(library, texts))
    assert [x.decode() for x in bpe.tokens_of(PATH).decode(ids, n)] == texts


@pytest.mark.parametrize("alphabet", [["the", "ing", "ation", "er", "q"], ["a"], ["ab", "a"], list("abcdefghijklmnopqrstuvwxyz"), ["é", "日", "本"], [" "], ["!", "="]])
def test_runs_that_are_one_piece(coder, library, alphabet):
    rng = random.Random(7)
    text = "".join(rng.choice(alphabet) for _ in range(20_000))
    assert coder.encode([text])[0].tolist() == library(text)


def test_merges_are_those_of_the_definition(coder):
    """The lowest rank first, the leftmost among equals, one at a time."""
    rng = random.Random(3)
    for _ in range(200):
        ids = [coder.rank_of[bytes([b])] for b in "".join(rng.choice("etaonisr h") for _ in range(rng.randrange(2, 40))).encode()]
        row = np.array([ids], np.int32)
        raw = bpe.tokens_of(PATH).decode(np.array(ids), np.ones(len(ids), int))
        while True:
            found = [(coder.rank_of[a + b], i) for i, (a, b) in enumerate(zip(raw, raw[1:], strict=False)) if a + b in coder.rank_of]
            if not found:
                break
            _, i = min(found)
            raw[i : i + 2] = [raw[i] + raw[i + 1]]
        assert coder.merged(row)[0].tolist() == [coder.rank_of[t] for t in raw]


def test_cuts_that_matter_are_dropped():
    """Pairs of two join from the left, so a cut at an odd place is wrong; blocks of odd length propose such cuts."""

    def encode(spans):
        lengths, per = [], []
        for a, z in spans.tolist():
            own = [2] * ((z - a) // 2) + [1] * ((z - a) % 2)
            lengths += own
            per.append(len(own))
        return np.array(lengths), np.array(lengths), np.array(per)

    for n in (1, 2, 6, 7, 8, 20, 21, 100):
        assert in_cuts(n, encode, 7)[1].tolist() == [2] * (n // 2) + [1] * (n % 2)


def test_a_worker_forgets(coder, library, monkeypatch):
    monkeypatch.setattr(bpe, "KEPT", 1000)
    for text in ("some words here", "and some others " * 20, "some words here"):
        assert coder.encode([text])[0].tolist() == library(text)


def test_odd_rows(spark, library):
    texts = [None, "", " ", "a", "x" * 3000, "the cat " * 9000, "a\n\nb\t c ", "日本 😀, ok.", "a"]
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(texts)] + [(None, "a"), (3, "a")], "doc_id long, text string").withColumn("ids", F.lit("x")).withColumn("decoded", F.lit(1)).withColumn("key", F.lit(2))
    got = bpe.decode(bpe.encode(docs, PATH), PATH).collect()
    assert len(got) == 11
    for r in got:
        assert r.ids == library(r.text or "")
        assert bytes(r.decoded) == (r.text or "").encode()
        assert r.key == 2
    assert bpe.decode(bpe.encode(docs.limit(0), PATH), PATH).count() == 0
    nulls = docs.select("doc_id", F.lit(None).cast("array<int>").alias("ids"))
    assert all(r.decoded is None for r in bpe.decode(nulls, PATH).collect())
