"""Mixing sources to target weights by weighted fair queueing."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, written

#: Weights of the sources in the order of their names, repeating; times a source may be taken at most.
WEIGHTS, EPOCHS = (5, 2, 1), 3
WORD = r"[^\x20\x09-\x0D]+"


def running(df: DataFrame, order: list[Column], value: str) -> DataFrame:
    """`df` in a global order, with `before`: the sum of `value` (long) over all rows that come earlier.

    Rows are dealt by ranges of `order` and sorted there; each task adds up its own rows as they pass, and what the ranges
    before it hold, one number for each, is added afterwards. No task sees more than its range. The result is stored, so
    the order it was made in is the one that stays, also for rows that `order` cannot tell apart.
    """
    place = [F.monotonically_increasing_id()]  # splits what is alike: equal rows may take each other's place
    keyed = df.select("*", *[o.alias(f"__o{i}") for i, o in enumerate([*order, *place])])
    keys = [F.col(f"__o{i}").asc_nulls_last() for i in range(len(order) + 1)]
    ranges = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed.repartitionByRange(ranges, *keys).sortWithinPartitions(*keys)
    dealt = dealt.select(*df.columns, F.spark_partition_id().alias("__range"))

    def add(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = 0
        for batch in batches:
            sums = np.cumsum(np.concatenate([[total], batch.column(batch.schema.get_field_index(value)).to_numpy()]).astype(np.int64))
            total = int(sums[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(sums[:-1])], [*batch.schema.names, "__before"])

    fields = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in dealt.schema)
    summed = written(dealt.mapInArrow(add, f"{fields}, __before bigint"))
    totals = summed.groupBy("__range").agg(F.sum(value).alias("own"))  # one row for each range
    earlier = totals.select("__range", (F.sum("own").over(W.orderBy("__range")) - F.col("own")).alias("earlier"))
    both = summed.join(F.broadcast(earlier), "__range")
    return both.select(*df.columns, (F.col("__before") + F.col("earlier")).alias("before"))


def source_targets(sized: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS) -> DataFrame:
    """(source, source_size, target) from (source, size): what each source shall give of as many words as there are.

    Sources stand in the order of their names by code point, null last, and weigh `weights`, repeating. No target exceeds
    `epochs` times its source; the excess goes to the others by weight, round by round, until none is above. A round reads
    three sums of the table of sources, nothing else comes to the driver.
    """
    totals = sized.groupBy("source").agg(F.sum("size").alias("source_size")).withColumn("one", F.lit(1).cast("long"))
    numbered = running(totals, [F.col("source").isNull(), F.col("source")], "one")
    nth = F.array(*[F.lit(w) for w in weights])[(F.col("before") % len(weights)).cast("int")]
    rows = written(numbered.select("source", "source_size", nth.cast("long").alias("weight"), (F.col("source_size") * epochs).alias("most")))
    every = rows.agg(F.sum("source_size"), F.sum("weight")).first()
    budget, whole = (every[0] or 0, every[1] or 1)
    rest, weight, full = budget, whole, 0
    while True:
        share = F.col("weight") * F.lit(float(rest)) / F.lit(float(weight))
        above = rows.where(share > F.col("most")).agg(F.count(F.lit(1)), F.sum("most"), F.sum("weight")).first()
        if above[0] == full or above[2] == whole:  # all at once only where nothing is there to share
            break
        full, rest, weight = above[0], budget - above[1], whole - above[2]
    return rows.select("source", "source_size", F.least(share, F.col("most").cast("double")).alias("target"))


def sizes(docs: DataFrame, id_col: str, text_col: str, source_col: str, seed: int) -> DataFrame:
    """doc_id, source, words of the text, and the digest that shuffles: all that is moved of a document."""
    words = F.coalesce(F.regexp_count(col(text_col).cast("string"), F.lit(WORD)), F.lit(0)).cast("long")
    key = F.coalesce(col(id_col).cast("string"), F.lit(""))
    return docs.select(
        col(id_col).cast("long").alias("doc_id"), col(source_col).cast("string").alias("source"), words.alias("size"),
        F.md5(F.concat(F.lit(f"{seed}:"), key).cast("binary")).alias("shuffle"),
    )


class Mix:
    """Documents taken in a common order such that every source keeps to its weight at any point of it.

    Each source's documents are shuffled by a digest of seed and id and queue up, epoch after epoch. A document's virtual
    finish time is the number of its source's words up to its end, over the source's target; sources whose document is in
    service at time 1, when all targets are met, give only the words up to there. A global range sort by finish time is
    the order of the mix, which is cut at the budget, the number of all words.

    `documents`: one row per document, with `row` to tell repeated rows apart. `sequence`: the mix, one row for each time a
    document is taken: (row, doc_id, source, epoch, finish, before, taken), where `taken` counts its words from the first
    and `before` those of the mix before it.

    A null text or one without words is taken never; a null source is one; a null id is an id like others; repeated rows
    each count; an empty table has an empty mix; other columns are ignored. The same documents and seed give the same
    mix, however they are stored. A source with most of the rows is spread over ranges like all others.
    """

    def __init__(self, docs: DataFrame, weights: tuple[int, ...] = WEIGHTS, epochs: int = EPOCHS, seed: int = 0,
                 id_col: str = "doc_id", text_col: str = "text", source_col: str = "source"):
        sized = written(sizes(docs, id_col, text_col, source_col, seed))
        targets = written(source_targets(sized, weights, epochs))
        self.budget = sized.agg(F.coalesce(F.sum("size"), F.lit(0))).first()[0]
        order = [F.col("source").isNull(), F.col("source"), F.col("shuffle"), F.col("doc_id"), F.col("size")]
        queued = written(running(sized, order, "size").withColumn("row", F.monotonically_increasing_id()))
        first = queued.groupBy("source").agg(F.min("before").alias("first"))
        known = targets.join(first.withColumnRenamed("source", "s"), F.col("source").eqNullSafe(F.col("s"))).drop("s")
        same = F.col("source").eqNullSafe(F.col("known"))
        self.documents = queued.join(known.withColumnRenamed("source", "known"), same).select(
            "row", "doc_id", "source", "size", "source_size", "target", (F.col("before") - F.col("first")).alias("start")
        )
        turns = self.documents.where("size > 0").withColumn("end", F.ceil("target")).select(
            "*", F.explode(F.sequence(F.lit(0), F.lit(epochs - 1))).alias("epoch")
        )
        began = F.col("epoch") * F.col("source_size") + F.col("start")
        cut = turns.withColumn("began", began).where("began < end").withColumn("piece", F.least("size", F.col("end") - F.col("began")))
        stamped = cut.withColumn("finish", (F.col("began") + F.col("piece")) / F.col("target"))
        mixed = running(stamped, [F.col("finish"), F.col("source").isNull(), F.col("source"), F.col("began")], "piece")
        taken = F.greatest(F.lit(0), F.least(F.col("piece"), F.lit(self.budget) - F.col("before")))
        self.sequence = mixed.select("row", "doc_id", "source", "epoch", "finish", "before", taken.alias("taken")).where("taken > 0")

    def report(self) -> DataFrame:
        """Per document: its words, those of its source, the source's target, and the words taken in all its turns."""
        never = self.documents.select("row", "doc_id", "size", "source_size", "target", F.lit(0).cast("long").alias("taken"))
        turns = self.sequence.select("row", "doc_id", *[F.lit(None).cast(t).alias(c) for c, t in (("size", "long"), ("source_size", "long"), ("target", "double"))], "taken")
        both = never.unionByName(turns).groupBy("row", "doc_id")
        return both.agg(*[F.max(c).alias(c) for c in ("size", "source_size", "target")], F.sum("taken").alias("taken")).drop("row")
