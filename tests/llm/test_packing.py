"""Packing against the tokenizer itself and a check of every placement rule."""

import random
import zlib

import numpy as np
import public_tokenizers
import pytest
from tokenizers import Tokenizer

from msgwarden.llm.catalog import bpe_encoder, op9_packing
from msgwarden.llm.packing import TIERS, pack

SF_DIR = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def plain():
    found = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    return lambda text: found.encode(text or "", add_special_tokens=False).ids + [1]


def check(rows, docs, plain):
    """`docs`: (id, text) with unique ids."""
    ids = {i: plain(t) for i, t in docs}
    pieces, sequences = {}, {}
    for r in rows:
        own = ids[r.doc_id]
        assert r.doc_tokens == len(own) and r.length > 0
        part = np.array(own[r.start : r.start + r.length], "<u4")
        assert len(part) == r.length and zlib.crc32(part.tobytes()) == r.ids_crc32
        pieces.setdefault(r.doc_id, []).append((r.start, r.length))
        sequences.setdefault(r.sequence_id, []).append((r.offset, r.length))
    assert pieces.keys() == ids.keys()
    for i, found in pieces.items():
        at = 0
        for start, length in sorted(found):
            assert start == at
            at += length
        assert at == len(ids[i])
    padding = 0
    for found in sequences.values():
        at = 0
        for offset, length in sorted(found):
            assert offset == at
            at += length
        assert at <= TIERS[-1]
        padding += 0 if at & (at - 1) == 0 else TIERS[-1] - at
    return padding


def test_query(spark, plain):
    docs = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SF_DIR}/documents.parquet").collect()]
    assert check(op9_packing(spark, SF_DIR).collect(), docs, plain) <= 2048


def test_encoder_equals_the_tokenizer(plain):
    encode = bpe_encoder()
    random.seed(5)
    letters = ["a", "B", "é", "中", "7", " ", "  ", "\n", "\t", "'s", "'", ",", "!!", " ", " ", "\x85", "😀", "the ", "\r\n"]
    for _ in range(3000):
        text = "".join(random.choice(letters) for _ in range(random.randrange(30)))
        assert np.frombuffer(encode(text), "<u4").tolist() == plain(text)[:-1], repr(text)


def test_edges(spark, plain):
    docs = [(1, None), (2, ""), (3, "word " * 40_000), (4, "x"), (None, "no id"), (6, "a b c " * 300), (7, "é" * 3000)]
    df = spark.createDataFrame([(i, t, 5) for i, t in docs], "doc_id long, text string, start int").coalesce(1)
    assert check(pack(df, bpe_encoder).collect(), docs, plain) <= 2048
    assert pack(df.limit(0), bpe_encoder).collect() == []
    twice = pack(df.union(df).coalesce(1), bpe_encoder)
    assert twice.groupBy().sum("length").first()[0] == 2 * sum(len(plain(t)) for _, t in docs)


def test_tiers_and_steps(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', int(20 + pmod(id * 37, 900))) text").coalesce(1)
    rows = pack(docs, bpe_encoder, step_tokens=4096).collect()
    assert {r.tier for r in rows} == set(TIERS)
    steps = {}
    for r in rows:
        steps[r.step_group] = steps.get(r.step_group, 0) + r.length
    assert max(steps.values()) == 4096 and sum(v != 4096 for v in steps.values()) <= len(TIERS)


def test_steps_over_many_partitions(spark):
    docs = spark.range(3000).selectExpr("id doc_id", "repeat('w ', int(20 + pmod(id * 37, 900))) text").repartition(9)
    rows = pack(docs, bpe_encoder, step_tokens=4096).collect()
    steps = {}
    for r in rows:
        steps.setdefault((r.tier, r.step_group), set()).add(r.sequence_id)
    assert len({g for _, g in steps}) == len(steps)  # a step holds one tier
    short = [(t, g) for (t, g), found in steps.items() if len(found) * t != 4096]
    assert len({t for t, _ in short}) == len(short)  # one step of a tier at most
