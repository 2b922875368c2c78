"""Records of CSV files and items of JSON documents that many tasks read at once.

A file is read in the splits Spark makes of it, as lines with a place: file, start of the split, place in the split. What
a line belongs to depends on all before it, through two numbers only: whether it stands in quotes, and how deep in
brackets. Both are prefix sums. Each split adds up its own lines, for either state it may begin in; the few rows that
makes, one a split, are added up per file; and the state at the start of each split then settles its lines. A window sees
one split, or one row per split of a file; no row or task ever holds a file.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_SPLIT = ("file", "block")
_BEFORE = (Window.unboundedPreceding, -1)
_UPTO = (Window.unboundedPreceding, Window.currentRow)


def placed_lines(spark: SparkSession, path: str, end: str = "\n") -> DataFrame:
    """file, block, place, value: what stands between two `end`s, in the splits of the files."""
    lines = spark.read.option("lineSep", end).text(path)
    return lines.select(
        F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"),
        F.monotonically_increasing_id().alias("place"), "value",
    )


def splits_of(spark: SparkSession, path: str) -> tuple[int, int]:
    """Tasks that reading the files takes, and their number; nothing is read."""
    lines = spark.read.text(path)
    return lines.rdd.getNumPartitions(), len(lines.inputFiles())


def _in_split(df: DataFrame, rows: tuple = _BEFORE) -> Window:
    return Window.partitionBy(*_SPLIT).orderBy("place").rowsBetween(*rows)


def _of_file(rows: tuple = _BEFORE) -> Window:
    """Over one row per split."""
    return Window.partitionBy("file").orderBy("block").rowsBetween(*rows)


def _sum(column: Column | str, over: Window) -> Column:
    return F.coalesce(F.sum(column).over(over), F.lit(0))


def _count(text: Column | str, mark: str) -> Column:
    return F.length(text) - F.length(F.replace(text, F.lit(mark), F.lit("")))


def _joined(parts: str, between: str) -> Column:
    return F.array_join(F.transform(F.array_sort(parts), lambda p: p["value"]), between)


def csv_records(lines: DataFrame) -> DataFrame:
    """file, record, first: the records of CSV files given as `placed_lines`; a line that ends in quotes goes on.

    A line ends in quotes if the quotes up to it are odd in number. Doubled quotes inside a field count two and change
    nothing; a single one in a field without quotes, which CSV does not allow, would. `first` marks the first record
    of a file. Empty records are left out. A carriage return before the line break belongs to that, in records that end so. Lines that are records move once, with their split; only records of several
    lines are put together in a further exchange, each by itself.
    """
    odd = _count("value", '"') % 2
    counted = lines.withColumn("odd", odd).withColumn("before", _sum("odd", _in_split(lines)) % 2)
    sums = counted.groupBy(*_SPLIT).agg(
        (F.sum("odd") % 2).alias("odd"), F.min("place").alias("least"),
        F.max(F.when(F.col("before") == 0, F.col("place"))).alias("even"), F.max(F.when(F.col("before") == 1, F.col("place"))).alias("uneven"),
    )
    states = sums.withColumn("inside", _sum("odd", _of_file()) % 2)
    begun = F.when(F.col("inside") == 0, F.col("even")).otherwise(F.col("uneven"))  # where the split's last record begins
    known = states.withColumn("begun", F.when(begun.isNotNull(), F.struct("block", begun.alias("place"))))
    carried = known.select(
        *_SPLIT, "inside", F.last("begun", ignorenulls=True).over(_of_file()).alias("open"),
        F.first(F.struct("block", F.col("least").alias("place"))).over(_of_file(_UPTO)).alias("top"),
    )
    begins = F.col("before") == F.col("inside")
    here = F.struct("block", "place")
    settled = counted.join(carried, list(_SPLIT)).withColumn("starts", F.when(begins, here))
    settled = settled.withColumn("key", F.coalesce(F.last("starts", ignorenulls=True).over(_in_split(lines, _UPTO)), "open"))
    alone = begins & (F.col("odd") == 0)
    single = settled.where(alone).select("file", F.col("value").alias("record"), (F.col("key") == F.col("top")).alias("first"))
    parts = settled.where(~alone).groupBy("file", "key").agg(
        F.collect_list(F.struct("block", "place", "value")).alias("parts"), F.max(F.col("key") == F.col("top")).alias("first")
    )
    several = parts.select("file", _joined("parts", "\n").alias("record"), "first")
    windows = F.replace(F.expr("substring(record, 1, length(record) - 1)"), F.lit("\r\n"), F.lit("\n"))
    whole = F.when(F.col("record").endswith("\r"), windows).otherwise(F.col("record"))
    return single.union(several).select("file", whole.alias("record"), "first").where("record <> ''")


# Text outside of quotes that goes on or ends, and up to the first open brace; possessive, so of any length.
_STRINGS = r'"[^"]*+("|$)'
_HEAD = r'^(?:[^"{]++|"(?:[^"\\]++|\\.)*+")*+'
_KEY = r'(?s)"((?:[^"\\]++|\\.)*+)"\s*+:\s*+\[\s*+$'


def json_items(pieces: DataFrame, key: str | None = "items") -> DataFrame:
    """file, item: the objects in the top-level list `key` of JSON documents given as `placed_lines` that end in `}`.

    Documents are cut at every closing brace, whatever it means; quotes and braces outside of quotes are counted for both
    states a piece may begin in. An item ends with a brace that leads back to the depth of the list, and takes all pieces
    since the one before it. `key` None: the document itself is the list. One item is put together in one task; the
    document is not.
    """
    base = 0 if key is None else 1
    plain = F.regexp_replace("value", r"(?s)\\.", "")
    pieces = pieces.withColumn("plain", plain).withColumn("odd", _count("plain", '"') % 2)
    outside = F.regexp_replace("plain", _STRINGS, "")
    begun_inside = F.regexp_replace(F.regexp_replace("plain", r'^[^"]*+("|$)', ""), _STRINGS, "")
    opens = pieces.withColumns({"o0": _count(outside, "{"), "o1": _count(begun_inside, "{")})
    # change of depth with the piece and the brace after it, if that is outside of quotes
    steps = opens.select(
        *_SPLIT, "place", "value", "odd", (F.col("o0") - F.when(F.col("odd") == 0, 1).otherwise(0)).alias("d0"),
        (F.col("o1") - F.when(F.col("odd") == 1, 1).otherwise(0)).alias("d1"),
    ).withColumn("before", _sum("odd", _in_split(pieces)) % 2)
    for s in (0, 1):  # the same, by the state the split begins in
        steps = steps.withColumn(f"s{s}", F.when(F.col("before") == s, F.col("d0")).otherwise(F.col("d1")))
    sums = steps.groupBy(*_SPLIT).agg((F.sum("odd") % 2).alias("odd"), F.sum("s0").alias("s0"), F.sum("s1").alias("s1"))
    states = sums.withColumn("inside", _sum("odd", _of_file()) % 2)
    states = states.withColumn("deep", _sum(F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1")), _of_file()))
    both = steps.join(states.select(*_SPLIT, "inside", "deep"), list(_SPLIT))
    both = both.withColumn("step", F.when(F.col("inside") == 0, F.col("s0")).otherwise(F.col("s1")))
    both = both.withColumn("depth", F.col("deep") + _sum("step", _in_split(pieces))).withColumn("quoted", (F.col("before") + F.col("inside")) % 2)
    ends = ((F.col("quoted") + F.col("odd")) % 2 == 0) & (F.col("depth") + F.col("step") == base)
    head = F.when((F.col("quoted") == 0) & (F.col("depth") <= base), _head(base))
    marked = both.select(
        *_SPLIT, "place", "value", F.when(ends, F.struct("block", "place")).alias("end"),
        F.when(head.isNotNull(), F.nullif(F.regexp_extract(head, _KEY, 1), F.lit(""))).alias("list"),
        F.regexp_like(head, F.lit(r"[\]:]")).alias("other"),
    )
    # which list a piece is in: the last one named before it, until anything else follows at the depth of the lists
    listed = F.when(F.col("list").isNotNull() | F.col("other"), F.struct(F.coalesce("list", F.lit("")).alias("name")))
    marked = marked.withColumn("listed", listed)
    last = marked.groupBy(*_SPLIT).agg(F.max("end").alias("end"), F.max_by("listed", F.when(F.col("listed").isNotNull(), F.col("place"))).alias("listed"))
    carried = last.select(
        *_SPLIT, F.last("end", ignorenulls=True).over(_of_file()).alias("end_before"),
        F.last("listed", ignorenulls=True).over(_of_file()).alias("listed_before"),
    )
    keyed = marked.join(carried, list(_SPLIT)).select(
        "file", "block", "place", "value", "end",
        F.coalesce(F.last("end", ignorenulls=True).over(_in_split(pieces)), "end_before").alias("after"),
        F.coalesce(F.last("listed", ignorenulls=True).over(_in_split(pieces, _UPTO)), "listed_before").alias("listed"),
    )
    if key is not None:
        keyed = keyed.where(F.col("listed.name") == key)
    parts = keyed.groupBy("file", "after").agg(F.collect_list(F.struct("block", "place", "value")).alias("parts"), F.max("end").alias("end"))
    text = F.concat(_joined("parts", "}"), F.lit("}"))
    start = F.regexp_replace(text, r"^\s*+\{", "") if base else text
    opening = F.when(F.col("after").isNull(), start).otherwise(text)
    return parts.where("end IS NOT NULL").select("file", F.regexp_replace(opening, "(?s)" + _HEAD, "").alias("item"))


def _head(base: int) -> Column:
    """What stands in a piece before its first open brace outside of quotes, that of the document itself left out."""
    text = F.when((F.col("depth") == 0) & F.lit(base == 1), F.regexp_replace("value", r"^\s*+\{", "")).otherwise(F.col("value"))
    return F.regexp_extract(text, "(?s)" + _HEAD, 0)
