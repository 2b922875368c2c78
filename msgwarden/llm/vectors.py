"""Near-duplicate embeddings by randomly rotated binary codes with correction factors."""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import col, kept
from .components import components

#: Share of links at the threshold itself that the tables may miss; closer vectors are missed far less.
MISSED = 1e-4
#: Members of a bucket aimed at, and of a block; fuller buckets are compared block by block.
BUCKET, BLOCK = 64, 2048
#: Width of the confidence bounds in standard deviations of the estimate.
WIDTH = 5.0
#: Vectors whose largest component lies outside are divided by it, since their squares could leave the range of doubles.
RANGE = 1e-100, 1e100


@cache
def rotation(dim: int, number: int) -> np.ndarray:
    """A random orthogonal matrix, the same in every task."""
    q, r = np.linalg.qr(np.random.default_rng([dim, number]).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def table_sizes(vectors: int, threshold: float) -> tuple[int, int]:
    """Bits per table key for buckets of about `BUCKET`, and as many tables as find all but `MISSED` of the links.

    Two vectors at an angle agree in one code bit with probability 1 - angle / pi.
    """
    bits = max(4, min(30, round(math.log2(max(1, vectors) / BUCKET))))
    alike = (1 - math.acos(threshold) / math.pi) ** bits
    return bits, math.ceil(math.log(MISSED) / math.log1p(-alike))


def codes(vectors: np.ndarray, number: int) -> tuple[np.ndarray, np.ndarray]:
    """Signs of the rotated unit vectors, and their inner products with what they code (the correction factors)."""
    unit = vectors / np.linalg.norm(vectors, axis=1, keepdims=True)
    turned = unit @ rotation(vectors.shape[1], number)
    return np.where(turned >= 0, 1, -1).astype(np.int8), np.abs(turned).sum(axis=1) / math.sqrt(vectors.shape[1])


def upper_bounds(signs: np.ndarray, factors: np.ndarray, others: np.ndarray) -> np.ndarray:
    """Upper confidence bounds of the cosines of coded vectors (rows) with rotated unit vectors `others` (columns).

    code · other / factor is an unbiased estimate, off by about sqrt((1 - factor^2) / factor^2 / (dim - 1)).
    """
    dim = signs.shape[1]
    estimate = signs.astype(np.float32) @ others.T.astype(np.float32)
    estimate /= (math.sqrt(dim) * factors)[:, None].astype(np.float32)
    spread = WIDTH * np.sqrt(np.maximum(0, 1 - factors**2) / factors**2 / max(1, dim - 1))
    return estimate + spread[:, None].astype(np.float32)


def linked(vectors: np.ndarray, signs: np.ndarray, factors: np.ndarray, threshold: float, left: np.ndarray, right: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs (one of `left`, one of `right`, each pair once) with a cosine of `threshold` or more.

    Estimates decide which pairs are computed again in double precision: those whose bounds reach the threshold.
    """
    norms = np.linalg.norm(vectors, axis=1)
    turned = (vectors / norms[:, None]) @ rotation(vectors.shape[1], 0)
    i, j = np.nonzero(upper_bounds(signs[left], factors[left], turned[right]) >= threshold)
    i, j = left[i], right[j]
    if left is right:
        i, j = i[i < j], j[i < j]
    sure = []
    for at in range(0, len(i), 1 << 16):
        a, b = i[at : at + (1 << 16)], j[at : at + (1 << 16)]
        sure.append((vectors[a] * vectors[b]).sum(axis=1) / (norms[a] * norms[b]) >= threshold)
    sure = np.concatenate(sure) if sure else np.zeros(0, bool)
    return i[sure], j[sure]


def _coded(classes: DataFrame, bits: int, tables: int) -> DataFrame:
    """`classes` with the code, its factor and the keys of all tables. Table keys take their bits from the codes."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n = batch.num_rows
            lengths = np.diff(batch.column(3).offsets.to_numpy())
            flat = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.float64)
            starts = np.cumsum(lengths) - lengths
            signs, factors, keys = [None] * n, np.zeros(n), np.zeros((n, tables), np.int32)
            for dim in np.unique(lengths):
                rows = np.flatnonzero(lengths == dim)
                own = flat[starts[rows][:, None] + np.arange(dim)]
                rounds = [codes(own, k) for k in range(-(-bits * tables // int(dim)))]
                factors[rows] = rounds[0][1]
                every = np.concatenate([s for s, _ in rounds], axis=1)[:, : bits * tables] > 0
                keys[rows] = every.reshape(len(rows), tables, bits) @ (1 << np.arange(bits))
                for r, code in zip(rows, rounds[0][0]):
                    signs[r] = code.tobytes()
            extra = [pa.array(signs, pa.binary()), pa.array(factors), pa.ListArray.from_arrays(np.arange(n + 1, dtype=np.int32) * tables, pa.array(keys.ravel()))]
            yield pa.RecordBatch.from_arrays([*batch.columns, *extra], ["cid", "label", "copies", "vector", "signs", "factor", "keys"])

    given = classes.select("cid", "label", "copies", "vector")
    added = (("signs", T.BinaryType()), ("factor", T.DoubleType()), ("keys", T.ArrayType(T.IntegerType())))
    return given.mapInArrow(run, T.StructType([*given.schema.fields, *(T.StructField(*x) for x in added)]))


def _bucket_links(classes: DataFrame, threshold: float, block: int) -> DataFrame:
    """(cid, links, least) per class and bucket: rows linked there and nowhere in an earlier table, and a class they lead to.

    A bucket over `block` is dealt into blocks by a hash, and every pair of blocks is a group of its own.
    """
    most = classes.groupBy("label").agg(F.count(F.lit(1)).alias("n")).agg(F.max("n")).first()[0] or 0
    bits, tables = table_sizes(most, threshold)
    coded = kept(_coded(classes, bits, tables))
    rows = coded.select("*", F.size("vector").alias("dim"), F.posexplode("keys").alias("table", "key"))
    place = ["label", "dim", "table", "key"]
    sizes = rows.groupBy(*place).agg(F.count(F.lit(1)).alias("size")).where("size > 1")
    sizes = sizes.withColumn("blocks", F.ceil(F.col("size") / block).cast("int"))
    own = F.pmod(F.xxhash64("cid"), F.col("blocks")).cast("int")
    dealt = rows.join(sizes, place).withColumn("own", own).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    member = F.struct("cid", "copies", "vector", "signs", "factor", "keys", "own")
    groups = dealt.groupBy(*place, F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high")).agg(F.collect_list(member).alias("members"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = ([], [], [])
            for row in range(batch.num_rows):
                table, low, high = (batch.column(c)[row].as_py() for c in range(3))
                m = batch.column(3)[row].values
                n = len(m)
                ids, copies, factors, own = (m.field(c).to_numpy(zero_copy_only=False) for c in ("cid", "copies", "factor", "own"))
                vectors = m.field("vector").flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(n, -1)
                signs = np.frombuffer(b"".join(m.field("signs").to_pylist()), np.int8).reshape(n, -1)
                keys = m.field("keys").flatten().to_numpy(zero_copy_only=False).reshape(n, -1)
                left = np.flatnonzero(own == low)
                i, j = linked(vectors, signs, factors, threshold, left, left if low == high else np.flatnonzero(own == high))
                new = ~(keys[i, :table] == keys[j, :table]).any(axis=1)
                i, j = i[new], j[new]
                links, least, part = np.zeros(n, np.int64), ids.copy(), np.arange(n)
                for a, b in ((i, j), (j, i)):
                    np.add.at(links, a, copies[b])
                before = None
                while not np.array_equal(part, before):  # what is linked here, by however many links, leads to one class
                    before = part.copy()
                    for a, b in ((i, j), (j, i)):
                        np.minimum.at(part, a, part[b])
                    part = part[part]
                np.minimum.at(least, part, ids)
                least = least[part]
                met = np.flatnonzero(links)
                for column, values in zip(out, (ids, links, least)):
                    column.append(values[met])
            arrays = [pa.array(np.concatenate(c) if c else np.zeros(0, np.int64), pa.int64()) for c in out]
            yield pa.RecordBatch.from_arrays(arrays, ["cid", "links", "least"])

    return groups.select("table", "low", "high", "members").mapInArrow(run, "cid long, links long, least long")


def near_vectors(
    vectors: DataFrame, threshold: float = 0.98, id_col: str = "vec_id", vector_col: str = "embedding",
    label_col: str = "label", block: int = BLOCK,
) -> DataFrame:
    """One row per vector: the other vectors of its label at a cosine of `threshold` or more, the smallest id reachable
    by such links, and whether that is its own.

    A vector that is null, zero, or holds null or non-finite components, or whose label is null, links with nothing, nor
    do vectors of different lengths. Equal vectors of a label are one class that counts its copies. A null id takes part;
    it is a component's id only when all are null. Components other than floats are taken as doubles, labels of any type
    that can be grouped as they are. Other columns are ignored; an empty table gives no rows.

    Links are found by tables keyed with code bits; each is counted in the first table that holds both vectors. The
    tables' width follows the number of vectors, so buckets stay small; a bucket that is nevertheless large, because its
    vectors are alike, is compared in blocks, all of it. No pairs are written, only counts and links that connect.
    """
    vector = col(vector_col)
    floats = vectors.select(vector).dtypes[0][1] == "array<float>"
    if not floats:
        vector = vector.cast("array<double>")
    sound = F.coalesce(
        col(label_col).isNotNull() & (F.size(vector) > 0)
        & F.forall(vector, lambda x: F.coalesce(F.abs(x) < float("inf"), F.lit(False)))
        & F.exists(vector, lambda x: x != 0),
        F.lit(False),
    )
    rows = vectors.select(col(id_col).cast("long").alias("vec_id"), F.when(sound, vector).alias("vector"), col(label_col).alias("label"))
    key = ["label", F.xxhash64("vector").alias("k1"), F.xxhash64(F.lit(1), "vector").alias("k2")]
    valid = rows.where("vector is not null")
    classes = kept(
        valid.groupBy(*key)
        .agg(F.min("vec_id").alias("least_id"), F.count(F.lit(1)).alias("copies"), F.first("vector").alias("vector"))
        .withColumn("cid", F.monotonically_increasing_id())
    )
    scaled = classes
    if not floats:
        most = F.array_max(F.transform("vector", F.abs))
        unit = F.transform("vector", lambda x: x / most)
        scaled = classes.withColumn("vector", F.when(most.between(*RANGE), F.col("vector")).otherwise(unit))
    found = kept(_bucket_links(scaled, threshold, block))
    groups = components(found.select(F.col("cid").alias("a"), F.col("least").alias("b")))
    counts = found.groupBy("cid").agg(F.sum("links").alias("links"))
    rooted = (
        classes.select("label", "k1", "k2", "cid", "least_id", "copies")
        .join(counts, "cid", "left")
        .join(groups.select(F.col("node").alias("cid"), "component"), "cid", "left")
        .withColumn("root", F.coalesce("component", "cid"))
    )
    first = rooted.groupBy("root").agg(F.min("least_id").alias("first_id"))
    by_class = rooted.join(first, "root").select("label", "k1", "k2", (F.coalesce("links", F.lit(0)) + F.col("copies") - 1).alias("links"), "first_id")
    linked_rows = valid.select("vec_id", *key).join(by_class, ["label", "k1", "k2"]).select("vec_id", "links", "first_id")
    lone = rows.where("vector is null").select("vec_id", F.lit(0).cast("long"), "vec_id")
    return linked_rows.union(lone).select(
        "vec_id", F.col("links").alias("n_links"), F.col("first_id").alias("component_id"),
        F.coalesce(F.col("vec_id") == F.col("first_id"), F.lit(False)).alias("kept"),
    )
