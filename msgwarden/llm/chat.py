"""Chat formatting: reply trees to conversations, and conversations back to turns."""

from __future__ import annotations

import hashlib
import math
import re
from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import col, kept, written

#: The template: a head that names the role, the text, an end.
HEAD_START, HEAD_END, TURN_END = "<|", "|>\n", "</s>\n"
#: First characters of control strings, each where the rest follows, and the escape character itself.
CONTROL = r"\\|<(?=\||/?s>|/?SYS>>|</?SYS>>)|\|(?=>)|\[(?=/?INST\])"
TRAINED_ROLE = "assistant"


def escaped(text):
    r"""`text` with a backslash after every backslash and after the first character of every control string."""
    return F.regexp_replace(F.coalesce(text, F.lit("")), CONTROL, r"$0\\")


def unescaped(text: str) -> str:
    return re.sub(r"\\(\\?)", r"\1", text)


def reply_chain(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """A table of turns as a forest: in every conversation each row answers the one before it.

    Order within a conversation: turn (nulls first), role, text. A null conversation id is a conversation too. Rows are
    numbered by a range sort, so a conversation with a third of all rows is spread over tasks like any other rows.
    """
    order = ["tree", "turn", "role", "text"]
    picked = rows.select(
        col(conv_col).cast("long").alias("tree"), col(turn_col).alias("turn"), col(role_col).cast("string").alias("role"),
        col(text_col).cast("string").alias("text"),
    )
    dealt = picked.repartitionByRange(*order).sortWithinPartitions(*order).select("tree", "role", "text")
    shape = "tree long, role string, text string, goes_on boolean"
    placed = written(dealt.mapInArrow(_goes_on, shape).withColumn("at", F.monotonically_increasing_id())).withColumn("part", F.shiftright("at", 33))
    # one row for each range: how many rows come before it, and the tree of the last of them
    sizes = placed.groupBy("part").agg(F.count(F.lit(1)).alias("rows"), F.max(F.struct("at", "tree")).alias("last"))
    along = W.orderBy("part")
    starts = sizes.select("part", (F.sum("rows").over(along) - F.col("rows")).alias("before"), F.lag("last").over(along).alias("former"))
    nodes = placed.join(F.broadcast(starts), "part").withColumn("node", F.col("before") + F.col("at").bitwiseAND((1 << 33) - 1))
    crossing = F.col("former").isNotNull() & F.col("tree").eqNullSafe(F.col("former.tree"))
    return nodes.select("tree", "node", F.when(F.coalesce("goes_on", crossing), F.col("node") - 1).alias("parent"), "role", "text")


def _goes_on(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sorted rows with whether they are of the tree of the row before; null for the first, which has none here."""
    last = None
    for batch in batches:
        if not batch.num_rows:
            continue
        trees = batch.column(0)
        before = pa.concat_arrays([trees[:1] if last is None else last, trees[:-1]])
        alike = pc.or_(pc.fill_null(pc.equal(trees, before), False), pc.and_(pc.is_null(trees), pc.is_null(before)))
        if last is None:
            alike = pa.concat_arrays([pa.nulls(1, pa.bool_()), alike[1:]])
        last = trees[-1:]
        yield pa.RecordBatch.from_arrays([*batch.columns, alike], ["tree", "role", "text", "goes_on"])


def climbs(nodes: DataFrame) -> tuple[list[DataFrame], DataFrame]:
    """Tables of ever longer climbs, and the (node, score, turns) of whole climbs to a root.

    In table k, `up` is the 2^k-th ancestor of `node`; nodes without one are not in it. `score` and `turns` add up over
    the nodes climbed, `node` included and `up` not. Each table is made by joining the open climbs with the climbs of
    where they ended, so a path of n turns takes log2(n) joins, and a climb that is done is joined no more. Nodes that
    lead into a circle never reach a root.
    """
    columns = ["node", "up", F.col("score").cast("double").alias("score"), F.lit(1).cast("long").alias("turns")]
    ids = nodes.select(F.col("node").alias("known"))
    answers = nodes.where("parent is not null")
    first = answers.join(ids, answers["parent"] == ids["known"], "left").withColumn("up", F.col("known"))
    roots = nodes.where("parent is null").withColumn("up", F.lit(None).cast("long"))
    state = kept(first.select(*columns).union(roots.select(*columns)))
    total, open_rows = state.agg(F.count(F.lit(1)), F.count("up")).first()
    tables = []
    while open_rows and len(tables) <= math.log2(total) + 1:
        climbing = state.where("up is not null")
        tables.append(climbing)
        ends = state.select(F.col("node").alias("mid"), F.col("up").alias("top"), F.col("score").alias("more"), F.col("turns").alias("longer"))
        longer = climbing.join(ends, F.col("up") == F.col("mid")).select(
            "node", F.col("top").alias("up"), (F.col("score") + F.col("more")).alias("score"), (F.col("turns") + F.col("longer")).alias("turns")
        )
        state = kept(longer.union(state.where("up is null")))
        open_rows = state.agg(F.count("up")).first()[0]
    return tables, state.where("up is null").select("node", "score", "turns")


def best_paths(nodes: DataFrame, paths: int | None = 1) -> DataFrame:
    """Root-to-leaf paths of every tree, ranked by mean score: (tree, leaf, path_rank, path_score, node, above).

    One row per node of each of the `paths` best (None: all); `above` counts the steps from the leaf up to the node.
    Ties: the longer path, then the smaller leaf.
    """
    tables, whole = climbs(nodes)
    answered = nodes.select(F.col("parent").alias("node")).where("node is not null").distinct()
    leaves = nodes.select("tree", "node").join(answered, "node", "left_anti").join(whole, "node")
    leaves = leaves.select("tree", F.col("node").alias("leaf"), (F.col("score") / F.col("turns")).alias("path_score"), "turns")
    rank = F.row_number().over(W.partitionBy("tree").orderBy(F.desc("path_score"), F.desc("turns"), "leaf"))
    ranked = leaves.withColumn("path_rank", rank)
    chosen = ranked if paths is None else ranked.where(F.col("path_rank") <= paths)
    found = kept(chosen.select("tree", "leaf", "path_rank", "path_score", F.col("leaf").alias("node"), F.lit(0).cast("long").alias("above")))
    for k in reversed(range(len(tables))):  # every distance is one sum of powers of two, so no node comes twice
        up = tables[k].select("node", "up")
        step = found.join(up, "node").select("tree", "leaf", "path_rank", "path_score", F.col("up").alias("node"), F.col("above") + (1 << k))
        found = kept(found.union(step))
    return found


def format_paths(nodes: DataFrame, paths: int | None = 1) -> DataFrame:
    """One conversation per chosen path of a forest `nodes` (tree, node, parent, role, text, score).

    Returns tree, path_rank, path_score, the formatted `text` and `loss`: the places (start, length, in code points) of
    the assistants' texts in it. `node` is unique; a parent that is null or absent makes a root; nodes on a circle have
    no root and belong to no path; a null score counts 0, a null text or role is empty; an empty table gives no rows; other
    columns are ignored.

    Turns are formatted one by one before they meet; what meets in one task is one conversation, which is one row.
    """
    nodes = nodes.select("tree", "node", "parent", "role", "text", F.coalesce(F.col("score").cast("double"), F.lit(0.0)).alias("score"))
    head = F.concat(F.lit(HEAD_START), escaped(F.col("role")), F.lit(HEAD_END))
    turns = nodes.select("node", head.alias("head"), escaped(F.col("text")).alias("body"), F.coalesce(F.col("role") == TRAINED_ROLE, F.lit(False)).alias("trained"))
    pieces = best_paths(nodes, paths).join(turns, "node")
    piece = F.struct((-F.col("above")).alias("at"), "head", "body", "trained")
    rows = pieces.groupBy("tree", "leaf", "path_rank", "path_score").agg(F.sort_array(F.collect_list(piece)).alias("pieces"))

    def join_pieces(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                row = batch.slice(i, 1).to_pylist()[0]
                text, loss, at = [], [], 0
                for p in row["pieces"]:
                    text += [p["head"], p["body"], TURN_END]
                    if p["trained"]:
                        loss.append({"start": at + len(p["head"]), "length": len(p["body"])})
                    at += sum(map(len, text[-3:]))
                yield pa.RecordBatch.from_pylist(
                    [{"tree": row["tree"], "path_rank": row["path_rank"], "path_score": row["path_score"], "text": "".join(text), "loss": loss}],
                    schema=_FORMATTED,
                )

    return rows.select("tree", "path_rank", "path_score", "pieces").mapInArrow(
        join_pieces, "tree long, path_rank int, path_score double, text string, loss array<struct<start long, length long>>"
    )


_FORMATTED = pa.schema([
    ("tree", pa.int64()), ("path_rank", pa.int32()), ("path_score", pa.float64()), ("text", pa.string()),
    ("loss", pa.list_(pa.struct([("start", pa.int64()), ("length", pa.int64())]))),
])


def turns_of(formatted: str) -> list[tuple[str, str]]:
    """(role, text) of every turn of a formatted conversation."""
    turns = []
    for turn in formatted.split(TURN_END)[:-1]:
        role, body = turn[len(HEAD_START) :].split(HEAD_END, 1)
        turns.append((unescaped(role), unescaped(body)))
    return turns


_READ = pa.schema([
    ("conv_id", pa.int64()), ("n_turns", pa.int64()), ("turns_sha256", pa.string()), ("loss_chars", pa.int64()),
    ("loss_sha256", pa.string()), ("formatted_chars", pa.int64()), ("path_score", pa.float64()),
])


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns and trained text of formatted conversations, as counts and digests; `conv_id` is the tree."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = []
            for i in range(batch.num_rows):
                tree, score, text, loss = (c[0].as_py() for c in batch.slice(i, 1).columns)
                turns, digest, trained, chars = turns_of(text), hashlib.sha256(), hashlib.sha256(), 0
                for role, body in turns:
                    digest.update(f"{role}\n{body}\n".encode())
                for place in loss:
                    body = unescaped(text[place["start"] : place["start"] + place["length"]])
                    trained.update(body.encode())
                    chars += len(body)
                rows.append((tree, len(turns), digest.hexdigest(), chars, trained.hexdigest(), len(text), score))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*rows), _READ)], schema=_READ)

    return formatted.select("tree", "path_score", "text", "loss").mapInArrow(
        run,
        "conv_id long, n_turns long, turns_sha256 string, loss_chars long, loss_sha256 string, formatted_chars long,"
        " path_score double",
    )


def format_conversations(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """`format_paths` over a table of turns; a branch scores the trained characters per turn.

    Repeated rows stay, each as a turn of its own; other columns are ignored.
    """
    nodes = reply_chain(rows, conv_col, turn_col, role_col, text_col)
    score = F.when(F.col("role") == TRAINED_ROLE, F.length("text")).otherwise(0)
    return format_paths(nodes.withColumn("score", score))
