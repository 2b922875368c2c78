"""Embedding links against all pairs, and the estimates against their bounds."""

import numpy as np

from msgwarden.llm import vectors as v
from msgwarden.llm.catalog import op8_embedding_near_dedup


def plain(rows, threshold=0.98):
    """vec_id to (n_links, component_id) over all pairs; ids unique."""
    found = {}
    by_label = {}
    for i, vector, label in rows:
        x = np.array(vector or [0.0], float) if vector is None or None not in vector else np.zeros(1)
        if label is None or not np.isfinite(x).all() or not x.any():
            found[i] = (0, i)
        else:
            by_label.setdefault((label, len(x)), []).append((i, x))
    for members in by_label.values():
        ids, m = [i for i, _ in members], np.array([x for _, x in members])
        m = m / np.linalg.norm(m, axis=1, keepdims=True)
        near = m @ m.T >= threshold
        np.fill_diagonal(near, False)
        least = np.array(ids)
        while True:
            new = np.array([min(least[k], least[near[k]].min(initial=least[k])) for k in range(len(ids))])
            if (new == least).all():
                break
            least = new
        for k, i in enumerate(ids):
            found[i] = (int(near[k].sum()), int(least[k]))
    return found


def test_query(spark, sf_dir):
    rows = [tuple(r) for r in spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding", "label").collect()]
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_embedding_near_dedup(spark, sf_dir).collect()}
    assert got == plain(rows)


def test_edges_and_blocks(spark):
    rng = np.random.default_rng(3)
    center = rng.standard_normal(32)
    rows = [(i, (center + rng.standard_normal(32) * 0.13).tolist(), 1) for i in range(400)]
    rows += [(1000 + i, rng.standard_normal(32).tolist(), 2) for i in range(200)] + [(2000 + i, center.tolist(), i % 3) for i in range(60)]
    rows += [(3000, None, 1), (3001, [], 1), (3002, [0.0] * 32, 1), (3003, [1.0, None], 1), (3004, [float("nan")] * 32, 1), (3005, [float("inf")] + [1.0] * 31, 1), (3006, center.tolist(), None), (3007, [1.0, 2.0], 1), (3008, [2.0, 4.0], 1), (3009, [5.0], 7)]
    rows = [(i, None if x is None else [None if y is None else float(np.float32(y)) for y in x], label) for i, x, label in rows]
    df = spark.createDataFrame([(*r, 0) for r in rows], "vec_id long, embedding array<float>, label int, copies int")
    expected = plain(rows)
    for block in (2048, 50):
        got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(df, block=block).collect()}
        assert got == expected
    extra = v.near_vectors(df.where("vec_id = 2000").selectExpr("cast(null as long) vec_id", "embedding", "label").union(df.where("vec_id in (2000, 2003)").select("vec_id", "embedding", "label")))
    assert sorted((r.vec_id or 0, r.n_links, r.component_id, r.kept) for r in extra.collect()) == [(0, 2, 2000, False), (2000, 2, 2000, True), (2003, 2, 2000, False)]
    assert v.near_vectors(df.limit(0)).collect() == []


def test_estimates(spark):
    rng = np.random.default_rng(1)
    x = rng.standard_normal((300, 64))
    x[150:] = x[:150] + 0.2 * rng.standard_normal((150, 64))
    signs, factors = v.codes(x, 0)
    unit = x / np.linalg.norm(x, axis=1, keepdims=True)
    upper = v.upper_bounds(signs, factors, unit @ v.rotation(64, 0))
    spread = v.WIDTH * np.sqrt((1 - factors**2) / factors**2 / 63)[:, None]
    error = upper - spread - unit @ unit.T
    off = ~np.eye(300, dtype=bool)
    assert abs(error[off].mean()) < 0.005 and (np.abs(error) <= spread)[off].mean() > 0.9999
    bits, tables = v.table_sizes(10**9, 0.98)
    assert bits == 24 and tables < 60


def test_doubles_and_labels_keep_their_type(spark):
    rng = np.random.default_rng(5)
    center = rng.standard_normal(32)
    center /= np.linalg.norm(center)
    rows = [(0, center, "a")]
    for i in range(1, 41):  # cosines closer to the threshold than floats can tell
        off = rng.standard_normal(32)
        off -= (off @ center) * center
        cosine = 0.98 + (1e-9 if i % 2 else -1e-9)
        rows.append((i, cosine * center + np.sqrt(1 - cosine**2) * off / np.linalg.norm(off), "a"))
    for k, scale in enumerate((1e300, 1e-200, 5e-324)):  # outside the range of floats, and of their squares that of doubles
        rows += [(100 + 2 * k, np.array([scale, scale]), str(k)), (101 + 2 * k, 2 * np.array([scale, scale]), str(k))]
    rows.append((200, np.array([1.0, 1.0]), "no number"))
    data = [(i, [float(y) for y in x], label) for i, x, label in rows]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>, label string")
    got = {r.vec_id: (r.n_links, r.component_id) for r in v.near_vectors(df).collect()}
    assert got == plain(data[:41]) | {100 + i: (1, 100 + i // 2 * 2) for i in range(6)} | {200: (0, 200)}
    wide = spark.createDataFrame([(1, [1.0, 0.0], 2**40), (2, [1.0, 0.0], 2**40), (3, [1.0, 0.0], 2**40 + 2**32)], "vec_id long, embedding array<float>, label long")
    assert sorted((r.vec_id, r.n_links) for r in v.near_vectors(wide).collect()) == [(1, 1), (2, 1), (3, 0)]


def test_query_finds_planted_links(spark, tmp_path):
    """The query over a table of the given shape with near vectors planted in it, in chains, groups and alone."""
    rng = np.random.default_rng(5)
    base = rng.standard_normal((3000, 64))
    rows = [(i, x, i % 7) for i, x in enumerate(base)]
    for k in range(2500):
        of = rng.integers(0, 300) if k % 2 else len(rows) - 1
        i, x, label = rows[of]
        rows.append((len(rows), x + rng.standard_normal(64) * np.linalg.norm(x) / 8 * rng.choice([0.0, 0.1, 0.19, 0.21, 0.3]), label))
    data = [(int(i), [float(np.float32(y)) for y in x], int(label)) for i, x, label in rows]
    spark.createDataFrame(data, "vec_id long, embedding array<float>, label int").write.parquet(str(tmp_path / "embeddings.parquet"))
    got = {r.vec_id: (r.n_links, r.component_id) for r in op8_embedding_near_dedup(spark, str(tmp_path)).collect()}
    wanted = plain(data)
    assert sum(n for n, _ in wanted.values()) > 3000 and got == wanted
