"""Sharding over fixed virtual slots, with a versioned map from slots to shards."""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, kept, shared_folder

SLOTS = 8192
#: A slot with over this part of a shard's bytes or rows (it holds a hot key) is split by the rows' places.
SPLIT = 64


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS) -> DataFrame:
    """Per row: id, UTF-8 bytes plus one, CRC-32, virtual slot of the id, and the row's place in the table.

    Kept in the shared folder, since the place is what tells repeated rows apart from here on.
    """
    text = F.coalesce(col(text_col).cast("string"), F.lit(""))
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text.cast("binary")).alias("text_crc32"),
        F.monotonically_increasing_id().alias("place"),
    )
    return kept(rows.withColumn("vslot", F.pmod(F.xxhash64("doc_id"), F.lit(slots)).cast("int")))


def in_units(rows: DataFrame, shards: int, known: DataFrame | None = None) -> DataFrame:
    """`rows` with `part`: 0, but for slots too heavy to balance, whose rows are dealt by place.

    Slots of the map `known` keep the number of parts they have there. The table of slots has a fixed number of rows,
    whatever the input.
    """
    per_slot = rows.groupBy("vslot").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))
    whole = W.partitionBy()
    parts = F.ceil(
        F.greatest(
            F.col("bytes") * (shards * SPLIT) / F.sum("bytes").over(whole),
            F.col("rows") * (shards * SPLIT) / F.sum("rows").over(whole),
        )
    )
    heavy = per_slot.select("vslot", parts.alias("parts"))
    if known is not None:
        had = known.groupBy("vslot").agg((F.max("part") + 1).alias("had"))
        heavy = heavy.join(had, "vslot", "left").select("vslot", F.coalesce("had", "parts").alias("parts"))
    return rows.join(F.broadcast(heavy), "vslot").select(
        *rows.columns, F.pmod(F.xxhash64("place"), "parts").cast("int").alias("part")
    )


def unit_table(units: DataFrame) -> DataFrame:
    """Bytes and rows per slot part: at most `SLOTS` + shards * `SPLIT` * 2 rows."""
    return units.groupBy("vslot", "part").agg(F.sum("size").alias("bytes"), F.count(F.lit(1)).alias("rows"))


def _dealt(table: DataFrame, loads: DataFrame) -> DataFrame:
    """The units of `table` with `shard`: heaviest first, each to the shard with the fewest bytes so far (the lowest of
    equals). `loads`: one row with the bytes every shard has, in the order of shards."""
    units = F.sort_array(F.collect_list(F.struct((-F.col("bytes")).alias("b"), "vslot", "part", "rows")))

    def deal(state, unit):
        k = F.array_position(state["loads"], F.array_min(state["loads"])) - 1
        return F.struct(
            F.transform(state["loads"], lambda x, i: F.when(i == k, x - unit["b"]).otherwise(x)).alias("loads"),
            F.concat(state["dealt"], F.array(k.cast("int"))).alias("dealt"),
        )

    start = F.struct("loads", F.array().cast("array<int>").alias("dealt"))
    both = table.agg(units.alias("units")).withColumn("one", F.lit(1)).join(loads.withColumn("one", F.lit(1)), "one")
    dealt = both.select(F.explode(F.arrays_zip("units", F.aggregate("units", start, deal)["dealt"].alias("shard"))).alias("u"))
    return dealt.select("u.units.vslot", "u.units.part", (-F.col("u.units.b")).alias("bytes"), "u.units.rows", "u.shard")


MAP = "version int, shards int, vslot int, part int, bytes long, rows long, shard int"
_MAP = [field.split()[0] for field in MAP.split(", ")]


def first_map(table: DataFrame, shards: int) -> DataFrame:
    """Version 1: all units dealt to empty shards."""
    empty = table.agg(F.array_repeat(F.lit(0).cast("long"), shards).alias("loads"))
    return _dealt(table, empty).select(F.lit(1).alias("version"), F.lit(shards).alias("shards"), *_MAP[2:])


def edited_map(old: DataFrame, table: DataFrame, shards: int, version: int, rebalance: bool = False) -> DataFrame:
    """Map `old` edited for the units there are now: new ones are dealt to the shards with the fewest bytes.

    With `rebalance`, shards above their share first release what exceeds it, unit by unit; those are dealt as well. No
    other unit moves. Units that have no rows any more keep their shard.
    """
    now = old.select("vslot", "part", "shard").join(table, ["vslot", "part"], "full").fillna(0, ["bytes", "rows"])
    own = W.partitionBy("shard").orderBy(F.xxhash64("vslot", "part"), "vslot", "part")
    share = F.sum("bytes").over(W.partitionBy()) / shards
    stays = F.col("shard").isNotNull() & ((F.sum("bytes").over(own) <= share) if rebalance else F.lit(True))
    marked = now.withColumn("stays", stays)
    rest = marked.where("stays").select("vslot", "part", "bytes", "rows", "shard")
    held = rest.groupBy("shard").agg(F.sum("bytes").alias("held")).agg(F.map_from_entries(F.collect_list(F.struct("shard", "held"))).alias("held"))
    each = F.sequence(F.lit(0), F.lit(shards - 1))
    loads = held.select(F.transform(each, lambda s: F.coalesce(F.try_element_at("held", s), F.lit(0).cast("long"))).alias("loads"))
    loose = _dealt(marked.where("NOT stays").select("vslot", "part", "bytes", "rows"), loads)
    return rest.unionByName(loose).select(F.lit(version).alias("version"), F.lit(shards).alias("shards"), *_MAP[2:])


def grown_map(old: DataFrame, shards: int, version: int | None = None) -> DataFrame:
    """The next version with shard number `shards` added: each shard hands over what exceeds its new share.

    Units only move into the new shard; all others keep theirs.
    """
    own, whole = W.partitionBy("shard"), W.partitionBy()
    taken = F.sum("bytes").over(own.orderBy(F.xxhash64("vslot", "part"), "vslot", "part"))
    spare = F.sum("bytes").over(own) - F.sum("bytes").over(whole) / (shards + 1)
    number = F.col("version") + 1 if version is None else F.lit(version)
    return old.select(
        number.alias("version"), F.lit(shards + 1).alias("shards"), "vslot", "part", "bytes", "rows",
        F.when(taken <= spare, F.lit(shards)).otherwise(F.col("shard")).cast("int").alias("shard"),
    )


def store_map(version: DataFrame, path: str) -> None:
    """Adds a version to the stored map; one that is there is replaced, the others stay."""
    version.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("version").parquet(path)


def stored_map(spark: SparkSession, path: str, version: int) -> DataFrame:
    return spark.read.schema(MAP).parquet(path).where(F.col("version") == version).select(*_MAP)


def versions(spark: SparkSession, path: str) -> dict[int, int]:
    """The versions of a stored map and their numbers of shards; none where nothing is stored."""
    try:
        rows = spark.read.schema(MAP).parquet(path).groupBy("version").agg(F.max("shards").alias("shards")).collect()
    except AnalysisException:
        return {}
    return {r.version: r.shards for r in rows}


def _latest(known: dict[int, int], shards: int) -> int | None:
    return max((v for v, n in known.items() if n == shards), default=None)


def current_map(spark: SparkSession, path: str, table: DataFrame, shards: int, rebalance: bool = False) -> DataFrame:
    """The latest stored version for so many shards, read from `path`, after it was made or edited if it has to be.

    Version 1 is made where there is none, by growing where there is one for one shard less. A later version is
    written for units that the latest does not have, or to `rebalance`.
    """
    known = versions(spark, path)
    last, new = _latest(known, shards), max(known, default=0) + 1
    if last is None:
        fewer = _latest(known, shards - 1)
        if fewer is None:
            store_map(first_map(table, shards).withColumn("version", F.lit(new)), path)
            return stored_map(spark, path, new)
        store_map(grown_map(kept(stored_map(spark, path, fewer)), shards - 1, new), path)
        return current_map(spark, path, table, shards, rebalance)
    latest = stored_map(spark, path, last)
    if rebalance or not table.join(latest, ["vslot", "part"], "left_anti").isEmpty():
        store_map(edited_map(kept(latest), table, shards, new, rebalance), path)
        last = new
    return stored_map(spark, path, last)


def shard_documents(
    docs: DataFrame, shards: int = 8, id_col: str = "doc_id", text_col: str = "text", slots: int = SLOTS,
    map_path: str | None = None, rebalance: bool = False,
) -> DataFrame:
    """Every row's shard, and its place there (`slot`, gapless from 0), such that the shards' bytes are near equal.

    Ids are hashed into `slots` virtual slots; bytes are summed per slot; a stored map of versions says which slot is in
    which shard. At `map_path` the latest version for so many shards is read and followed; where there is none, one is
    made, stored and read. A version is only ever followed by another one: for slots it does not have, or with `rebalance`,
    which moves what shards hold too much. So rows added later move no others. Without `map_path` the map is stored in the
    shared folder, for this result alone. `next_shard` follows the next version, with one more shard.

    A slot that holds a hot key (a repeated or null id) is split by the rows' places, so repeated rows balance as well; of
    such a slot equal ids may change their parts when rows are added. Equal texts of different ids may lie in several
    shards. A null text has no bytes and counts one; an empty table gives no rows; other columns are ignored. Ties are
    broken by id, checksum and place.

    What is shuffled are digests of about 40 bytes a row, dealt by slot; texts stay where they are. Maps and slot tables
    have a fixed size, so they may be broadcast.
    """
    spark = docs.sparkSession
    path = map_path or f"{shared_folder(spark)}/llm-slots-{uuid.uuid4().hex}"
    rows, known = digests(docs, id_col, text_col, slots), versions(spark, path)
    last = _latest(known, shards) or _latest(known, shards - 1)  # the one followed, or grown
    units = in_units(rows, shards, None if last is None else kept(stored_map(spark, path, last)))
    table = kept(unit_table(units))
    now = current_map(spark, path, table, shards, rebalance)
    grown = grown_map(now, shards).select("vslot", "part", F.col("shard").alias("next_shard"))
    before = W.partitionBy("shard").orderBy("vslot", "part").rowsBetween(W.unboundedPreceding, -1)
    held = now.drop("rows").join(table.select("vslot", "part", "rows"), ["vslot", "part"])
    places = held.withColumn("before", F.coalesce(F.sum("rows").over(before), F.lit(0))).join(grown, ["vslot", "part"])
    places = places.select("vslot", "part", "shard", "next_shard", "before", "version")
    within = F.row_number().over(W.partitionBy("vslot", "part").orderBy("doc_id", "text_crc32", "size", "place"))
    return (
        units.withColumn("within", within - 1)
        .join(F.broadcast(places), ["vslot", "part"])
        .select(
            "doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard",
            (F.col("before") + F.col("within")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"),
            "vslot", "part", F.col("version").alias("map_version"), "next_shard",
        )
    )
