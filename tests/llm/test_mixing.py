"""Mixing: targets by plain resharing, the mix against a plain queue, budget, caps, repeated runs and edges."""

import hashlib
import math
import re
from collections import defaultdict

import pytest

from msgwarden.llm.catalog import op13_source_mixing
from msgwarden.llm.mixing import Mix, running


def plain_targets(sizes, weights=(5, 2, 1), epochs=3):
    """`sizes`: source to words."""
    names = sorted((s for s in sizes if s is not None)) + [None] * (None in sizes)
    weight = {s: weights[i % len(weights)] for i, s in enumerate(names)}
    budget, full = sum(sizes.values()), set()
    while True:
        rest = budget - sum(epochs * sizes[s] for s in full)
        open_ = sum(weight[s] for s in names if s not in full)
        target = {s: float(epochs * sizes[s]) if s in full else weight[s] * rest / open_ for s in names}
        above = {s for s in names if target[s] > epochs * sizes[s]}
        if not above:
            return target
        full |= above


def plain_mix(docs, epochs=3):
    """(doc_id, size, source_size, target, taken) of (doc_id, source, text), by one list of all turns."""
    sized = [(d, s, len(re.findall(r"[^\x20\x09-\x0D]+", t or ""))) for d, s, t in docs]
    total = defaultdict(int)
    for _, s, n in sized:
        total[s] += n
    target = plain_targets(total, epochs=epochs)
    key = lambda x: (hashlib.md5(f"0:{'' if x[0] is None else x[0]}".encode()).hexdigest(), x[0] or 0, x[2])
    turns, at = [], defaultdict(int)
    for row in sorted(range(len(sized)), key=lambda i: key(sized[i])):
        d, s, n = sized[row]
        for e in range(epochs):
            began = e * total[s] + at[s]
            piece = min(n, math.ceil(target[s]) - began)
            if piece > 0:
                turns.append(((began + piece) / target[s], s is None, s or "", began, row, piece))
        at[s] += n
    left, taken = sum(total.values()), defaultdict(int)
    for *_, row, piece in sorted(turns):
        taken[row] += min(piece, left)
        left -= min(piece, left)
    assert left == 0 or not turns
    return sorted(((d, n, total[s], target[s], taken[i]) for i, (d, s, n) in enumerate(sized)), key=repr)


def rows_of(df):
    return sorted(((r.doc_id, r["size"], r.source_size, r.target, r.taken) for r in df.collect()), key=repr)


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    rows = rows_of(op13_source_mixing(spark, sf_dir))
    assert rows == plain_mix([(r.doc_id, r.source, r.text) for r in docs.collect()])
    assert rows == rows_of(Mix(docs.repartition(11)).report())
    given = defaultdict(int)
    source = {r.doc_id: r.source for r in docs.select("doc_id", "source").collect()}
    for doc_id, size, _, target, taken in rows:
        given[source[doc_id], target] += taken
        assert taken <= 3 * size
    assert all(abs(n - target) < len(given) for (_, target), n in given.items())
    assert sum(r[4] for r in rows) == sum(r[1] for r in rows)


def text(n):
    return " ".join(["w"] * n)


def test_hot_source_repeated_rows_and_capped_sources(spark):
    docs = [(i, "a", text(i % 7)) for i in range(60)] + [(1, "b", text(50))] * 40 + [(i, None, text(3)) for i in range(100, 130)]
    docs += [(None, "c", text(9)), (None, "c", text(9)), (5, "dé", None), (6, "z", ""), (7, "\U0001f600", text(4)), (8, "￮", text(1000))]
    df = spark.createDataFrame([(*d, 1, "x") for d in docs], "doc_id long, source string, text string, row int, target string")
    expected = plain_mix(docs)
    assert any(r[3] == 3 * r[2] for r in expected) and any(0 < r[3] < r[2] for r in expected)
    assert rows_of(Mix(df).report()) == expected == rows_of(Mix(df.repartition(5)).report())


def test_the_mix_keeps_the_weights_at_any_point(spark):
    docs = [(i, "abc"[i % 3], text(5 + i % 11)) for i in range(900)]
    mix = Mix(spark.createDataFrame(docs, "doc_id long, source string, text string"))
    order = mix.sequence.orderBy("finish", "source", "before").collect()
    target = {r.source: r.target for r in mix.documents.select("source", "target").distinct().collect()}
    given, before = defaultdict(int), 0
    for r in order:
        assert r.before == before
        before += r.taken
        given[r.source] += r.taken
        for s in target:
            assert abs(given[s] - before * target[s] / mix.budget) <= 45
    assert before == mix.budget


def test_edges(spark):
    shape = "doc_id long, source string, text string"
    assert Mix(spark.createDataFrame([], shape)).report().collect() == []
    only = Mix(spark.createDataFrame([(1, None, None), (2, "a", " \n")], shape)).report().collect()
    assert sorted(tuple(r) for r in only) == [(1, 0, 0, 0.0, 0), (2, 0, 0, 0.0, 0)]
    long_ = [(1, "a", text(200_000)), (2, "b", text(10))]
    assert rows_of(Mix(spark.createDataFrame(long_, shape)).report()) == plain_mix(long_)


@pytest.mark.parametrize("n", [0, 1, 1000])
def test_running_sums(spark, n):
    df = spark.range(n).selectExpr("id % 10 AS k", "id % 7 AS v")
    rows = sorted(((r.k, r.before, r.v) for r in running(df, [df.k], "v").collect()), key=lambda r: r[:2])
    total = 0
    for _, before, v in rows:
        assert before == total
        total += v
    assert len(rows) == n
