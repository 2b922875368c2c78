"""Sampled segmentations: exact round trips, reproducible draws, and frequencies against all segmentations."""

import math
import random
from collections import Counter

import public_tokenizers
import pytest

from msgwarden.llm import pieces as p
from msgwarden.llm.catalog import op6_sentencepiece_sampling


@pytest.fixture(scope="module")
def sampler():
    return p.PieceSampler(public_tokenizers.path("piece_bpe_32k.model"))


def test_query(spark, sf_dir):
    docs = {r.doc_id: r.text for r in spark.read.parquet(f"{sf_dir}/documents.parquet").collect()}
    rows = op6_sentencepiece_sampling(spark, sf_dir).collect()
    assert {r.doc_id for r in rows} == docs.keys() and all(r.lossless and r.n_pieces == len(r.ids) for r in rows)
    again = op6_sentencepiece_sampling(spark, sf_dir).repartition(5).collect()
    assert {r.doc_id: r.ids_crc32 for r in rows} == {r.doc_id: r.ids_crc32 for r in again}


def test_round_trips(sampler, monkeypatch):
    random.seed(9)
    letters = ["a", "the", " ", "  ", "\n", "\t", "▁", "é", "中", "😀", "\0", "<0x41>", "<s>", "</s>", " ", ".", "ing", "\r", "é"]
    batch = ["".join(random.choices(letters, k=random.randrange(25))) for _ in range(400)] + ["", " ", "   ", "▁", "x" * 9000, " " * 9000, "long " * 5000]
    seeds = [p.row_seed(i, 1) for i in range(len(batch))]
    found = sampler.sample(batch, seeds)
    assert [sampler.decode(f.tolist()) for f in found] == batch
    alone = [sampler.sample([t], [s])[0].tolist() for t, s in zip(batch[::7], seeds[::7])]
    assert alone == [f.tolist() for f in found[::7]]
    monkeypatch.setattr(p, "BLOCK", 50)
    assert [f.tolist() for f in sampler.sample(batch, seeds)] == [f.tolist() for f in found]


def test_frequencies(sampler):
    def all_paths(text):
        if not text:
            return [((), 0.0)]
        found = []
        for n in range(1, len(text) + 1):
            if text[:n] in sampler.pieces:
                i, w = sampler.pieces[text[:n]]
                found += [((i, *rest), w + v) for rest, v in all_paths(text[n:])]
        return found

    paths = {ids: math.exp(w) for ids, w in all_paths(" there")}
    total, n = sum(paths.values()), 20_000
    seen = Counter(tuple(f.tolist()) for f in sampler.sample(["there"] * n, [p.row_seed(i, 3) for i in range(n)]))
    assert seen.keys() <= paths.keys() and len(seen) > 5
    for ids, w in paths.items():
        share = w / total
        assert abs(seen[ids] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4


def test_edges(spark):
    df = spark.createDataFrame([(1, None, 0), (2, "", 0), (None, "no id", 0), (4, "same", 0), (4, "same", 0)], "doc_id long, text string, ids int")
    rows = p.sample_pieces(df, public_tokenizers.path("piece_bpe_32k.model")).collect()
    assert len(rows) == 5 and all(r.lossless for r in rows)
    assert len({tuple(r.ids) for r in rows if r.doc_id == 4}) == 1 and sum(r.n_pieces == 0 for r in rows) == 2
    assert p.sample_pieces(df.limit(0), public_tokenizers.path("piece_bpe_32k.model")).collect() == []


def test_a_run_of_any_length_is_one_lattice(sampler, monkeypatch):
    random.seed(2)
    batch = ["".join(random.choices(["ther", "ing", "a", "é", "中", "\n", "▁", "  ", " "], k=random.randrange(30))) for _ in range(150)] + ["there " * 40, ""]
    seeds = [p.row_seed(i, 4) for i in range(len(batch))]
    found = [f.tolist() for f in sampler.sample(batch, seeds)]
    long_ = "".join(random.choices(["there", "ation", "x", "é"], k=8000))
    monkeypatch.setattr(p, "RUN", 1)  # every chunk goes the way of very long ones, and draws the same
    alone = p.PieceSampler(public_tokenizers.path("piece_bpe_32k.model"))
    assert [f.tolist() for f in alone.sample(batch, seeds)] == found
    monkeypatch.setattr(p, "RUN", 4096)
    assert len(long_) > 20_000
    (one,) = sampler.sample([long_], [7])
    assert sampler.decode(one.tolist()) == long_
    monkeypatch.setattr(p, "RUN", 1 << 20)
    whole = p.PieceSampler(public_tokenizers.path("piece_bpe_32k.model"))
    assert whole.sample([long_], [7])[0].tolist() == one.tolist()


def test_remembered_lattices_change_nothing(sampler, monkeypatch):
    monkeypatch.setattr(p, "REMEMBERED", 500)
    other = p.PieceSampler(public_tokenizers.path("piece_bpe_32k.model"))
    for k in range(30):
        batch, seeds = [f"there is number {k} of them {'x' * k}"] * 3, [p.row_seed(i, k) for i in range(3)]
        assert [f.tolist() for f in other.sample(batch, seeds)] == [f.tolist() for f in sampler.sample(batch, seeds)]


def test_rows_follow_the_distribution_of_whole_texts(spark):
    """The operator's rows of one short text of several chunks, against all its segmentations."""
    model = public_tokenizers.path("piece_bpe_32k.model")
    sampler = p.PieceSampler(model, 0.1)

    def all_paths(text):
        if not text:
            return [((), 0.0)]
        found = []
        for n in range(1, len(text) + 1):
            if text[:n] in sampler.pieces:
                i, w = sampler.pieces[text[:n]]
                found += [((i, *rest), w + v) for rest, v in all_paths(text[n:])]
        return found

    paths = {ids: math.exp(w) for ids, w in all_paths(" it is")}
    total, n = sum(paths.values()), 20_000
    rows = p.sample_pieces(spark.range(n).selectExpr("id AS doc_id", "'it is' AS text"), model, seed=5, sharpness=0.1)
    seen = Counter(tuple(r.ids) for r in rows.collect())
    assert sum(seen.values()) == n and seen.keys() <= paths.keys() and len(seen) > 5
    for ids, w in paths.items():
        share = w / total
        assert abs(seen[ids] / n - share) < 5 * math.sqrt(share * (1 - share) / n) + 1e-4
