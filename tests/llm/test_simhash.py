"""SimHash groups against all pairs, and buckets that must be split."""

import random
import re

import numpy as np
import xxhash
from pyspark.sql import functions as F

from msgwarden.llm import simhash as s
from msgwarden.llm.catalog import op5_simhash
from msgwarden.llm.components import components


def plain_fingerprint(text):
    text = re.sub("[A-Z]", lambda m: m[0].lower(), text or "")
    words = re.findall(r"[^\x20\x09-\x0D]+", text)
    shingles = [" ".join(words[i : i + 3]) for i in range(len(words) - 2)] or ([" ".join(words)] if words else [])
    hashes = [xxhash.xxh64_intdigest(x.encode(), 42) for x in shingles]
    return sum(1 << b for b in range(64) if 2 * sum(h >> b & 1 for h in hashes) > len(hashes)) if hashes else 0


def plain_groups(ids, fps, radius=2):
    """Smallest id per row by closing over all pairs."""
    parent = list(range(len(ids)))

    def root(x):
        while parent[x] != x:
            parent[x] = parent[parent[x]]
            x = parent[x]
        return x

    for i in range(len(ids)):
        for j in range(i):
            if (fps[i] ^ fps[j]).bit_count() <= radius:
                parent[root(i)] = root(j)
    least = {}
    for i, own in enumerate(ids):
        if own is not None:
            least[root(i)] = min(least.get(root(i), own), own)
    return [least.get(root(i)) for i in range(len(ids))]


def test_query(spark, sf_dir):
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").collect()
    fps = [plain_fingerprint(r.text) for r in docs]
    groups = plain_groups([r.doc_id for r in docs], fps)
    rows = {r.doc_id: (r.fingerprint, r.component_id) for r in op5_simhash(spark, sf_dir).collect()}
    assert rows == {r.doc_id: (f"{f:016x}", g) for r, f, g in zip(docs, fps, groups)}
    assert len({g for g in groups}) < len(docs)


def test_edges(spark):
    docs = [(3, None), (5, ""), (4, " \n"), (8, "One"), (7, "one"), (9, "one two"), (None, "one"), (None, "alone here"), (9, "one two")]
    df = spark.createDataFrame([(i, t, 0) for i, t in docs], "doc_id long, text string, fp int")
    fps = [plain_fingerprint(t) for _, t in docs]
    groups = plain_groups([i for i, _ in docs], fps)
    got = s.simhash_groups(df).collect()
    key = lambda x: tuple((v is None, v) for v in x)
    assert sorted(((r.doc_id, r.fingerprint, r.component_id) for r in got), key=key) == sorted(((i, f"{f:016x}", g) for (i, _), f, g in zip(docs, fps, groups)), key=key)
    assert s.simhash_groups(df.limit(0)).collect() == []
    kept = s.keep_first(df)
    assert kept.columns == df.columns
    assert sorted(((r.doc_id, r.text) for r in kept.collect()), key=key) == sorted([(3, None), (7, "one"), (9, "one two"), (None, "alone here")], key=key)


def test_long_text_is_cut_without_loss(monkeypatch):
    text = " ".join(f"w{i % 701}" for i in range(5000)) + " " + "x" * 3000 + "\n\nend  now"
    whole = s.fingerprint(text, 3)
    monkeypatch.setattr(s, "_PIECE", 500)
    assert whole == s.fingerprint(text, 3)
    assert whole & (1 << 64) - 1 == plain_fingerprint(text)


def test_crowded_buckets_are_split(spark):
    random.seed(6)
    center = random.getrandbits(64)
    fps = {center}
    while len(fps) < 700:
        near = random.choice(list(fps)) if random.random() < 0.7 else center
        for _ in range(random.randrange(1, 6)):
            near ^= 1 << random.randrange(64)
        fps.add(near)
    fps = sorted(fps)
    df = spark.createDataFrame([(i, s._signed(f)) for i, f in enumerate(fps)], "id long, fp long")
    got = {r.id: r.first_id for r in s.grouped(df, 2, bucket=16).collect()}
    assert got == dict(enumerate(plain_groups(range(len(fps)), fps)))
    i, j = s.near_pairs(np.array(fps, np.uint64), np.array([[(f ^ (p & (1 << 64) - 1)).bit_count() for p in s.PIVOT_VALUES] for f in fps], np.uint8), 2)
    pairs = {(min(a, b), max(a, b)) for a, b in zip(i.tolist(), j.tolist())}
    assert pairs == {(a, b) for b in range(len(fps)) for a in range(b) if (fps[a] ^ fps[b]).bit_count() <= 2}


def test_components(spark):
    random.seed(7)
    chain = [(i, i + 1) for i in range(1000, 1300)]
    star = [(5, i) for i in range(2000, 2500)]
    loose = [(random.randrange(3000, 3400), random.randrange(3000, 3400)) for _ in range(150)]
    edges = chain + star + loose + [(7, 7), (1, 2), (2, 1)]
    random.shuffle(edges)
    nodes = sorted({x for e in edges if e[0] != e[1] for x in e})
    at = {x: i for i, x in enumerate(nodes)}
    pairs = np.array([(at[a], at[b]) for a, b in edges if a != b])
    least = s.spanning(len(nodes), pairs[:, 0], pairs[:, 1])
    got = {r.node: r.component for r in components(spark.createDataFrame(edges, "a long, b long")).distinct().collect()}
    assert got == {x: nodes[least[at[x]]] for x in nodes}
    assert components(spark.createDataFrame([], "a long, b long")).select(F.count("*")).first()[0] == 0
