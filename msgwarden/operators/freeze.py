"""Fingerprints, manifests and inventories of frozen datasets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pandas as pd
import pyarrow.fs
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: The file source holds a file's bytes in one value; larger files are read in parts.
ONE_VALUE, PART = 2_147_483_647, 1 << 23


def _exists(spark: SparkSession, path: str) -> bool:
    jvm = spark._jvm
    hpath = jvm.org.apache.hadoop.fs.Path(path)
    found = hpath.getFileSystem(spark._jsc.hadoopConfiguration()).globStatus(hpath)
    return found is not None and len(found) > 0


def _hash_in_parts(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
    """SHA-256 of each listed file, read through its file system a part at a time."""
    for batch in batches:
        digests = []
        for path in batch["path"]:
            system, place = pyarrow.fs.FileSystem.from_uri(path)
            digest = hashlib.sha256()
            with system.open_input_stream(place) as stream:
                while part := stream.read(PART):
                    digest.update(part)
            digests.append(digest.hexdigest())
        yield batch.assign(sha256=digests)


def file_hashes(spark: SparkSession, path: str, one_value: int = ONE_VALUE) -> DataFrame:
    """path, length and SHA-256 of every file under a path; NULL where a file is missing.

    Files are spread over tasks and each is hashed where it is read. A file of more than ``one_value`` bytes is read in
    parts of 8 MB, whatever its size; that needs a file system which Arrow can open. For a table of many files
    :func:`row_fingerprint` costs one pass and does not depend on how the rows are stored.
    """
    if not _exists(spark, path):
        return spark.createDataFrame([(path,)], "path string").select(
            "path", F.lit(None).cast("bigint").alias("length"), F.lit(None).cast("string").alias("sha256")
        )
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    hashed = files.where(F.col("length") <= one_value).select("path", "length", F.sha2("content", 256).alias("sha256"))
    large = files.where(F.col("length") > one_value).select("path", "length").repartition("path")
    return hashed.unionByName(large.mapInPandas(_hash_in_parts, "path string, length bigint, sha256 string"))


def inventory(spark: SparkSession, path: str) -> DataFrame:
    """path and size of every file under a path; contents are not read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path)
    return files.select("path", F.col("length").alias("bytes"))


def row_hash(columns: list[str]) -> Column:
    """SHA-256 over a row's columns; NULLs, empty texts and separators are kept apart."""
    texts = [F.col(c).cast("string") for c in columns]
    parts = [
        F.coalesce(F.concat(F.length(t).cast("string"), F.lit(":"), t), F.lit("-")) for t in texts
    ]
    return F.sha2(F.concat_ws("|", *parts), 256)


def _digest_sums(df: DataFrame, digest: str, keys: list[str], *more: Column) -> DataFrame:
    """Rows and the sums of the eight numbers of a hexadecimal digest, per group; they may be added up further."""
    parts = [F.conv(F.substring(digest, 1 + 8 * i, 8), 16, 10).cast("decimal(38,0)") for i in range(8)]
    zero = F.lit(0).cast("decimal(38,0)")
    return df.groupBy(*keys).agg(
        F.count(F.lit(1)).alias("n_rows"), *[F.coalesce(F.sum(p), zero).alias(f"__s{i}") for i, p in enumerate(parts)], *more
    )


def _digest_of_sums() -> Column:
    return F.sha2(F.concat_ws("|", F.col("n_rows").cast("string"), *[F.col(f"__s{i}").cast("string") for i in range(8)]), 256)


def row_fingerprint(df: DataFrame, columns: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """Fingerprint of a table that depends neither on row order nor on its files.

    Every row's digest is split into eight numbers, which are summed; the sums and the row
    count make up the fingerprint. Sums are partial before the shuffle, so any size works.
    """
    keys = by or []
    hashed = df.select(*keys, row_hash(columns or df.columns).alias("__hash"))
    return _digest_sums(hashed, "__hash", keys).select(*keys, "n_rows", _digest_of_sums().alias("fingerprint"))


def manifest_rows(
    spark: SparkSession, datasets: dict[str, tuple[str | None, DataFrame]], by: str = "phase", columns: list[str] | None = None
) -> DataFrame:
    """What is frozen of each dataset, one row per thing: name, part, key, n, digest.

    Parts are ``file`` (key: path below the dataset's, n: bytes, digest: SHA-256), ``group`` (key: value of ``by``, n: rows,
    digest: fingerprint of its rows over ``columns``) and ``all`` (the same of the whole table). ``datasets`` maps a name to
    its path, None for a table without files, and its table, which is read once. Digests are sums, partial before the
    shuffle, and those of the whole are the sums of the groups'; nothing is gathered, however many files and groups there are.
    """
    out = None
    for name, (path, df) in datasets.items():
        hashed = df.select(F.col(by).cast("string").alias("key"), row_hash(columns or df.columns).alias("__hash"))
        groups = _digest_sums(hashed, "__hash", ["key"])
        sums = [F.coalesce(F.sum(f"__s{i}"), F.lit(0)).cast("decimal(38,0)").alias(f"__s{i}") for i in range(8)]
        whole = groups.agg(F.coalesce(F.sum("n_rows"), F.lit(0)).alias("n_rows"), *sums).withColumn("key", F.lit(None).cast("string"))
        made = [
            d.select(F.lit(name).alias("name"), F.lit(part).alias("part"), "key", F.col("n_rows").alias("n"), _digest_of_sums().alias("digest"))
            for d, part in ((groups, "group"), (whole, "all"))
        ]
        if path is not None:
            below = F.element_at(F.split(F.col("path"), F.lit(path.rstrip("/")), 2), -1)
            files = file_hashes(spark, path)
            made.append(files.select(F.lit(name).alias("name"), F.lit("file").alias("part"), below.alias("key"), F.col("length").alias("n"), F.col("sha256").alias("digest")))
        for d in made:
            out = d if out is None else out.unionByName(d)
    return out


def manifest_changes(old: DataFrame, new: DataFrame) -> DataFrame:
    """What differs between two manifests (:func:`manifest_rows`, stored or made now): name, part, key, change, n_old, n_new.

    ``change`` is added, removed or changed; things that are alike are left out. Things meet by name, part and key, one row each.
    """
    same = F.col("o.name").eqNullSafe(F.col("n.name")) & F.col("o.part").eqNullSafe(F.col("n.part")) & F.col("o.key").eqNullSafe(F.col("n.key"))
    both = old.alias("o").join(new.alias("n"), same, "full")
    change = (
        F.when(F.col("o.name").isNull(), "added").when(F.col("n.name").isNull(), "removed")
        .when(~(F.col("o.n").eqNullSafe(F.col("n.n")) & F.col("o.digest").eqNullSafe(F.col("n.digest"))), "changed")
    )
    first = lambda c: F.coalesce(F.col(f"o.{c}"), F.col(f"n.{c}")).alias(c)
    rows = both.select(first("name"), first("part"), first("key"), change.alias("change"), F.col("o.n").alias("n_old"), F.col("n.n").alias("n_new"))
    return rows.where("change IS NOT NULL")


def manifest(
    spark: SparkSession, datasets: dict[str, tuple[str, DataFrame]], frozen_at: str, by: str = "phase"
) -> DataFrame:
    """One row per dataset: name, path, sha256, frozen_at, n_rows and rows per group.

    ``datasets`` maps a name to its file path and its table. A path of several files has a digest made from sums of its
    files' digests, whatever their order. The record holds all groups, so it is for tables of few; :func:`manifest_rows` is
    for any.
    """
    rows = []
    for name, (path, df) in datasets.items():
        one, missing = F.max("sha256").alias("__one"), F.count_if(F.col("sha256").isNull()).alias("__open")
        files = _digest_sums(file_hashes(spark, path), "sha256", [], one, missing)
        whole = F.when(F.col("__open") == 0, F.when(F.col("n_rows") == 1, F.col("__one")).otherwise(_digest_of_sums()))
        split = (
            df.groupBy(F.col(by).cast("string").alias("g")).agg(F.count(F.lit(1)).alias("n"))
            .agg(
                F.coalesce(F.sum("n"), F.lit(0)).alias("n_rows"),
                F.map_from_entries(F.sort_array(F.collect_list(F.struct(F.coalesce("g", F.lit("")).alias("key"), F.col("n").alias("value"))))).alias("split"),
            )
        )
        key = F.lit(name).alias("name")
        rows.append(
            split.select(key, "n_rows", "split")
            .join(files.select(key, whole.alias("sha256")), "name")
            .select("name", F.lit(path).alias("path"), "sha256", F.lit(frozen_at).alias("frozen_at"), "n_rows", "split")
        )
    out = rows[0]
    for r in rows[1:]:
        out = out.unionByName(r)
    return out
