"""SimHash near-duplicates over pivot distance tables."""

from __future__ import annotations

import re
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_and_text, kept, texts, unused, written
from .components import components

BITS = 64
SEED = 42
#: Reference fingerprints per table; each costs a byte per fingerprint and rejects about two thirds of what is left.
PIVOTS = 24
#: Fingerprints compared in one bucket; fuller buckets are split by further bits first.
BUCKET = 4096
_PIECE = 1 << 20


def _signed(value: int) -> int:
    return value - (1 << 64) if value >> 63 else value


PIVOT_VALUES = [_signed(xxhash.xxh64_intdigest(b"pivot %d" % i, SEED)) for i in range(PIVOTS)]


def _pieces(raw: bytes) -> Iterator[bytes]:
    """`raw` in parts of about a megabyte, cut at white space."""
    space, at = re.compile(rb"[ \t-\r]"), 0
    while at < len(raw):
        cut = space.search(raw, at + _PIECE) if len(raw) - at > _PIECE else None
        end = cut.start() if cut else len(raw)
        yield raw[at:end]
        at = end


def fingerprint(text: str, words: int) -> int:
    """Signed 64-bit SimHash: a bit is set where over half the shingles' hashes have it; 0 without a word."""
    ones, total, carried = np.zeros(BITS, np.int64), 0, []
    for piece in _pieces(text.encode().lower()):
        own = carried + piece.split()
        hashes = [xxhash.xxh64_intdigest(s, SEED) for s in map(b" ".join, zip(*(own[i:] for i in range(words))))]
        carried = own[max(0, len(own) - words + 1) :]
        if hashes:
            total += len(hashes)
            bits = np.unpackbits(np.array(hashes, "<u8").view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            ones += bits.sum(axis=0, dtype=np.int64)
    if not total:
        return _signed(xxhash.xxh64_intdigest(b" ".join(carried), SEED)) if carried else 0
    return int(np.packbits(2 * ones > total, bitorder="little").view("<i8")[0])


def fingerprints(docs: DataFrame, words: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(id, fp) of every row; a null text has no word."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, batch in texts(batches):
            found = [fingerprint(text, words) for text in batch]
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(found, pa.int64())], ["id", "fp"])

    return id_and_text(docs, id_col, text_col).mapInArrow(run, "id long, fp long")


def _levels(radius: int, bucket: int) -> list[list[tuple[int, list[int]]]]:
    """Per level, the bit masks of its paths, each with its place in the former level.

    A mask's other bits are split into `radius` + 1 parts: two fingerprints that agree under a mask and differ in
    `radius` bits at most agree under one of the masks that add a part. The last level leaves so few bits that a bucket
    of distinct fingerprints cannot exceed `bucket`.
    """
    levels, masks = [], [0]
    while any(2 ** (BITS - m.bit_count()) > bucket for m in masks):
        level = []
        for m in masks:
            free = [b for b in range(BITS) if not m >> b & 1]
            level.append([m | sum(1 << b for b in free[i :: radius + 1]) for i in range(min(radius + 1, len(free)))])
        levels.append(level)
        masks = [m for part in level for m in part]
    return levels


def near_pairs(fps: np.ndarray, tables: np.ndarray, radius: int) -> tuple[np.ndarray, np.ndarray]:
    """Positions of all pairs within `radius` bits.

    Distances to a pivot differ by no more than the fingerprints do. Sorted by the first pivot's table, only pairs
    within `radius` there are formed; those with a greater difference in any other table are discarded; the rest is
    verified bit by bit.
    """
    order = np.argsort(tables[:, 0], kind="stable")
    fps, tables = fps[order], tables[order].astype(np.int16)
    reach = np.searchsorted(tables[:, 0], tables[:, 0] + radius, side="right")
    found = []
    for start in range(0, len(fps), 256):
        rows = np.arange(start, min(start + 256, len(fps)))
        counts = reach[rows] - rows - 1
        i = np.repeat(rows, counts)
        j = np.arange(len(i)) - np.repeat(np.cumsum(counts) - counts, counts) + i + 1
        for k in range(1, tables.shape[1]):
            if not len(i):
                break
            near = np.abs(tables[i, k] - tables[j, k]) <= radius
            i, j = i[near], j[near]
        same = np.bitwise_count(fps[i] ^ fps[j]) <= radius
        found.append((order[i[same]], order[j[same]]))
    return np.concatenate([x for x, _ in found]), np.concatenate([y for _, y in found])


def spanning(n: int, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """For each of `n` positions the least one connected to it by the pairs."""
    least = np.arange(n)
    while len(i):
        before = least.copy()
        np.minimum.at(least, i, least[j])
        np.minimum.at(least, j, least[i])
        least = least[least]
        if (least == before).all():
            break
    return least


def links(classes: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """(a, b): links that connect exactly the fingerprints of `classes` (fp, distances) within `radius` bits.

    Candidates share a bucket, that is the bits under one of `radius` + 1 masks. Sizes of buckets are counted first;
    those over `bucket` are dealt to narrower masks, level by level, so none is gathered before it is small enough.
    Every bucket gives a spanning forest, not its pairs.
    """
    levels, parts = _levels(radius, bucket), []
    rows = classes.select("fp", "distances", F.lit(0).alias("path"))
    for level, masks in enumerate(levels):
        choice = F.array(*(F.array(*(F.lit(_signed(m)) for m in own)) for own in masks))
        split = rows.select("fp", "distances", "path", F.posexplode(F.element_at(choice, F.col("path") + 1)).alias("child", "mask"))
        keyed = split.select("fp", "distances", (F.col("path") * (radius + 1) + F.col("child")).alias("path"), F.col("fp").bitwiseAND(F.col("mask")).alias("key"))
        sizes = keyed.groupBy("path", "key").agg(F.count(F.lit(1)).alias("size")).where("size > 1")
        sized = keyed.join(sizes, ["path", "key"])
        if level == len(levels) - 1:
            parts.append(sized)
            break
        sized = kept(sized)
        parts.append(sized.where(F.col("size") <= bucket))
        rows = sized.where(F.col("size") > bucket).select("fp", "distances", "path")
        if rows.isEmpty():
            break

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            a, b = [], []
            for start in range(0, batch.num_rows, 64):
                for members in batch.slice(start, 64).column(0):
                    values = members.values
                    fps = values.field("fp").to_numpy(zero_copy_only=False).view(np.uint64)
                    tables = np.frombuffer(b"".join(values.field("distances").to_pylist()), np.uint8).reshape(len(fps), -1)
                    least = spanning(len(fps), *near_pairs(fps, tables, radius))
                    moved = least != np.arange(len(fps))
                    a += fps[moved].view(np.int64).tolist()
                    b += fps[least[moved]].view(np.int64).tolist()
            yield pa.RecordBatch.from_arrays([pa.array(a, pa.int64()), pa.array(b, pa.int64())], ["a", "b"])

    found = None
    for level, part in enumerate(parts):
        members = part.groupBy("path", "key").agg(F.collect_list(F.struct("fp", "distances")).alias("members"))
        edges = members.select("members").mapInArrow(run, "a long, b long")
        found = edges if found is None else found.union(edges)
    return found


def grouped(fps: DataFrame, radius: int, bucket: int = BUCKET) -> DataFrame:
    """`fps` (id, fp, …) with `first_id`: the smallest id whose fingerprint is reachable by links."""
    distance = [F.bit_count(F.col("fp").bitwiseXOR(F.lit(p))) for p in PIVOT_VALUES]
    table = F.unhex(F.concat(*(F.lpad(F.hex(d.cast("long")), 2, "0") for d in distance)))
    classes = kept(fps.groupBy("fp").agg(F.min("id").alias("least_id")).withColumn("distances", table))
    groups = components(links(classes, radius, bucket)).select(F.col("node").alias("fp"), "component")
    rooted = classes.join(groups, "fp", "left").select("fp", "least_id", F.coalesce("component", "fp").alias("root"))
    first = rooted.groupBy("root").agg(F.min("least_id").alias("first_id"))
    return fps.join(rooted.join(first, "root").select("fp", "first_id"), "fp")


def simhash_groups(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """Every row's `fingerprint` (16 hexadecimal digits) and `component_id`, the smallest id of its group.

    Groups are the components of fingerprints at `radius` or fewer differing bits; shingles are `words` words of the
    whole text with A-Z lower-cased. Texts without a word, null ones included, share fingerprint zero. A null id is
    grouped like any other and is only a group's id when all its ids are null. Repeated rows stay; other columns are
    ignored; an empty table gives no rows.

    Equal fingerprints are one class, however many rows have them. Pivot tables are computed once per class.
    """
    fps = kept(fingerprints(docs, words, id_col, text_col))
    return grouped(fps, radius, bucket).select(
        F.col("id").alias("doc_id"), F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), F.col("first_id").alias("component_id")
    )


def keep_first(
    docs: DataFrame, words: int = 3, radius: int = 2, id_col: str = "doc_id", text_col: str = "text", bucket: int = BUCKET
) -> DataFrame:
    """The rows of `docs`, all columns as they are, without all but one of each group: the smallest id (nulls last),
    among equal ids the first row of the table as it is read."""
    place = unused(docs, "place")
    placed = written(docs.withColumn(place, F.monotonically_increasing_id()))
    fps = kept(fingerprints(placed, words, place, text_col))
    ids = placed.select(col(place).alias("id"), col(id_col).cast("long").alias("own"))
    order = F.struct(F.col("own").isNull().alias("none"), F.col("own"), F.col("id").alias("row"))
    roots = grouped(fps, radius, bucket)
    first = roots.join(ids, "id").groupBy("first_id").agg(F.min(order)["row"].alias("id"))
    dropped = roots.join(first.select("id"), "id", "left_anti").select(F.col("id").alias(place))
    return placed.join(dropped, place, "left_anti").select(*map(col, docs.columns))
