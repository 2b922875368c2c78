"""Conversation structure repair: the cheapest edits to a well-formed alternation, by a Viterbi search that forgets."""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col

KEEP, REROLE, DELETE, INSERT = "K", "R", "D", "I"
#: What an edit costs; a truncated row that is not deleted costs `TRUNCATED` more.
REROLE_COST, DELETE_COST, INSERT_COST, TRUNCATED = 3, 4, 3, 3
START, SYSTEM, USER, ASSISTANT = range(4)
#: From each state: the state of the next user or assistant turn, and what may be kept there.
NEXT = (USER, USER, ASSISTANT, USER)
KEPT = ({"s": SYSTEM, "u": USER}, {"u": USER}, {"a": ASSISTANT}, {"u": USER})
ROLE = {USER: "user", ASSISTANT: "assistant"}
LEGAL = {"su", "ua", "au"}
BLANKS = " \t\n\x0b\x0c\r"


class Node:
    """An edit in the tree of those that may still be chosen; `held` counts the children and the survivor that need it."""

    __slots__ = ("parent", "edit", "state", "row", "held", "children")

    def __init__(self, parent, edit, state, row):
        self.parent, self.edit, self.state, self.row = parent, edit, state, row
        self.held, self.children = 0, []
        if parent is not None:
            parent.children.append(self)
            parent.held += 1


class Search:
    """The cheapest edits of a stream of rows, handed to `emit(edit, state, row)` as soon as they are certain.

    A survivor is the best way to a state: its cost, its node, and its place among the survivors' whole edit strings.
    Ways that cost the same are compared by those strings. Two ways that take the same rows and cost the same never have
    strings of which one begins the other, since only inserted turns could follow, which cost. Hence the order of the
    strings that end with the last row decides, then what was inserted since; and that order is known from one row to the
    next, so complete unresolved strings are compared without being walked or kept twice.

    Edits form a tree of back pointers. A node that no survivor needs is dropped, and with it the ways to it; once the
    oldest node has one child left, that edit belongs to every survivor and is emitted. Memory holds the unresolved edits
    and their rows only.
    """

    def __init__(self, emit):
        self.emit = emit
        self.root = Node(None, None, START, None)
        self.root.held = 1
        self.ways = {START: (0, 0, "", self.root)}  # cost, order of the string at the last row, what was inserted since, node
        self._insert()

    def row(self, row, initial: str, must_go: bool, truncated: bool) -> None:
        extra = TRUNCATED if truncated else 0
        best: dict[int, tuple] = {}

        def offer(state, cost, order, tail, node, edit):
            known = best.get(state)
            if known is None or (cost, order, tail) < known[:3]:
                best[state] = (cost, order, tail, node, edit)

        for state, (cost, order, tail, node) in self.ways.items():
            offer(state, cost + DELETE_COST, order, tail + DELETE, node, DELETE)
            if must_go:
                continue
            kept = KEPT[state].get(initial)
            if kept is not None:
                offer(kept, cost + extra, order, tail + KEEP, node, KEEP)
            offer(NEXT[state], cost + REROLE_COST + extra, order, tail + REROLE, node, REROLE)
        before = self.ways
        ranks = {state: i for i, state in enumerate(sorted(best, key=lambda s: best[s][1:3]))}
        self.ways = {s: (cost, ranks[s], "", Node(node, edit, s, row)) for s, (cost, _, _, node, edit) in best.items()}
        for _, _, _, node in self.ways.values():
            node.held += 1
        for _, _, _, node in before.values():
            self._drop(node)
        self._insert()
        self._prune()
        self._forget()

    def _prune(self) -> None:
        """Drops survivors that cannot win any more, which would keep the oldest edits open for ever.

        What follows a system turn may as well follow an answer, so that way must be the better one; and so may what follows
        nothing, but for a system turn, which would have to be deleted instead.
        """
        answer = self.ways[ASSISTANT]
        if START in self.ways and self.ways[START][0] > answer[0] + DELETE_COST:
            self._drop(self.ways.pop(START)[3])
        if SYSTEM in self.ways and self.ways[SYSTEM][:3] > answer[:3]:
            self._drop(self.ways.pop(SYSTEM)[3])

    def _insert(self) -> None:
        """Ways that go on by turns without text, until none is better than what is known."""
        changed = True
        while changed:
            changed = False
            for state in list(self.ways):
                cost, order, tail, node = self.ways[state]
                way = (cost + INSERT_COST, order, tail + INSERT)
                known = self.ways.get(NEXT[state])
                if known is None or way < known[:3]:
                    new = Node(node, INSERT, NEXT[state], None)
                    new.held += 1
                    self.ways[NEXT[state]] = (*way, new)
                    if known is not None:
                        self._drop(known[3])
                    changed = True

    def _drop(self, node: Node) -> None:
        node.held -= 1
        while node.held == 0 and node.parent is not None:
            parent = node.parent
            parent.children.remove(node)
            node.parent = None
            parent.held -= 1
            node = parent

    def _forget(self) -> None:
        while self.root.held == 1 and self.root.children:
            child = self.root.children[0]
            self.emit(child.edit, child.state, child.row)
            child.parent, self.root = None, child

    def finish(self) -> int:
        """Emits the rest of the cheapest way that ends after an answer, or has no turn at all; returns its cost."""
        ends = [self.ways[s] for s in (START, ASSISTANT) if s in self.ways]
        cost, _, _, node = min(ends, key=lambda w: w[:3])
        rest = []
        while node is not self.root:
            rest.append(node)
            node = node.parent
        for node in reversed(rest):
            self.emit(node.edit, node.state, node.row)
        return cost


def fault(text: str, seen: bool) -> str | None:
    """The first fault of a row: blank, duplicate (`seen` before) or truncated."""
    shown = text.rstrip(BLANKS)
    if not shown:
        return "blank"
    if seen:
        return "duplicate"
    return None if shown[-1] in ".!?" else "truncated"


class Conversation:
    """One conversation under repair, fed row by row in order; what is certain goes to `out`, as a row of `EDITS`."""

    def __init__(self, conv_id: int | None, out):
        self.conv_id, self.out = conv_id, out
        self.counts = dict.fromkeys(("blank", "duplicate", "truncated"), 0)
        self.illegal = self.turns = 0
        self.least = self.most = self.last_turn = self.last = None
        self.audit, self.digest, self.begun = [], hashlib.sha256(), False
        self.search = Search(self._emit)

    def _emit(self, edit: str, state: int, row: tuple | None) -> None:
        role, text = row or ("", "")
        if edit in (REROLE, INSERT):
            role = ROLE[state]
        if self.out is not None:
            self.out((self.conv_id, len(self.audit), edit, role, text))
        self.audit.append(edit)
        if edit != DELETE:
            self.digest.update((("\n" if self.begun else "") + role + ":" + text).encode())
            self.begun = True

    def add(self, turn: int | None, role: str, text: str, seen: bool) -> None:
        if turn is not None and turn != self.last_turn:
            self.turns += 1
            self.least, self.most, self.last_turn = turn if self.least is None else self.least, turn, turn
        initial = role[:1]
        if self.last is not None and self.last + initial not in LEGAL:
            self.illegal += 1
        self.last = initial
        found = fault(text, seen)
        if found:
            self.counts[found] += 1
        self.search.row((role, text), initial, found in ("blank", "duplicate"), found == "truncated")

    def finish(self) -> tuple:
        cost = self.search.finish()
        gaps = self.most - self.least + 1 - self.turns if self.turns else 0
        return (self.conv_id, gaps, *self.counts.values(), self.illegal, cost, "".join(self.audit), self.digest.hexdigest())


REPORT = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string, repaired_sha256 string"
EDITS = "conv_id long, step long, edit string, role string, text string"


def _in_order(rows: DataFrame, conv_col: str, turn_col: str, role_col: str, text_col: str) -> DataFrame:
    """conv_id, turn, role, text, seen, copies: the distinct rows of every conversation in order, each in one stream.

    `seen`: role and text stand in an earlier turn. That is known from an aggregate over digests, of which only those met
    more than once are joined back, so no task keeps what it has seen.
    """
    blank = F.lit(" ")
    read = rows.select(
        col(conv_col).cast("long").alias("conv_id"), col(turn_col).cast("long").alias("turn"),
        F.coalesce(col(role_col).cast("string"), blank).alias("role"), F.coalesce(col(text_col).cast("string"), blank).alias("text"),
    )
    read = read.select("*", F.xxhash64("text").alias("t1"), F.xxhash64(F.lit(1), "text").alias("t2"))
    key = ["conv_id", "role", "t1", "t2"]
    at = F.struct(F.col("turn").isNotNull().alias("known"), "turn")
    again = read.groupBy(*key).agg(F.min(at).alias("first"), F.max(at).alias("last")).where("first < last")
    again = again.select(*[F.col(k).alias(f"k_{k}") for k in key], "first")
    same = [F.col(k).eqNullSafe(F.col(f"k_{k}")) for k in key]
    marked = read.join(again, same, "left").withColumn("seen", F.coalesce(F.col("first") < at, F.lit(False)))
    order = ["conv_id", F.col("turn").asc_nulls_first(), "role", "text"]
    return marked.select("conv_id", "turn", "role", "text", "seen").repartition("conv_id").sortWithinPartitions(*order)


def _finished(batches: Iterable[pa.RecordBatch], out=None) -> Iterator[list[tuple]]:
    """Reports of the conversations that end in each slice of the sorted rows; equal rows of a turn are seen after the first."""
    now = last = None
    for batch in batches:
        for start in range(0, batch.num_rows, 1024):
            done = []
            for conv_id, *row, seen in zip(*(c.to_pylist() for c in batch.slice(start, 1024).columns)):
                if now is None or now.conv_id != conv_id:
                    if now is not None:
                        done.append(now.finish())
                    now, last = Conversation(conv_id, out), None
                now.add(*row, seen or row == last)
                last = row
            yield done
    yield [now.finish()] if now is not None else []


def _batch(rows: list[tuple], schema: str) -> pa.RecordBatch:
    names, types = zip(*(f.split() for f in schema.split(", ")))
    columns = list(zip(*rows)) or [()] * len(names)
    kinds = [pa.int64() if t == "long" else pa.string() for t in types]
    return pa.RecordBatch.from_arrays([pa.array(list(c), k) for c, k in zip(columns, kinds)], list(names))


def repair_report(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """One row per conversation: its faults, the cheapest edits to role initials `(s?(ua)+)?`, and a digest of the result.

    Rows are taken by turn, null first, those of one turn by role and text. `gaps` counts turns missing between the first
    and the last; `blank`, `duplicate` and `truncated` the rows with that as their first fault; `illegal` neighbours whose
    initials cannot follow each other; `audit` has an initial per edit, the least of equally cheap ones.
    `repaired_sha256` digests the repaired `role:text` lines.

    A null role or text is one space; a null turn is no turn, a null id an id like others; a role that begins with none of
    `sua` cannot be kept. Repeated rows are duplicates. An empty table gives no rows; other columns are ignored. A conversation
    is one stream of sorted rows through one task, which holds its unresolved edits only, however many rows it has.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for done in _finished(batches):
            yield _batch(done, REPORT)

    return _in_order(rows, conv_col, turn_col, role_col, text_col).mapInArrow(run, REPORT)


def repaired_turns(
    rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn", role_col: str = "role", text_col: str = "text"
) -> DataFrame:
    """The edits of every conversation, `step` counting from 0: what was done, and the role and text that result.

    A row with edit `D` shows what was deleted; all others, in the order of `step`, are the repaired conversation. Rows are
    handed on as soon as they are certain. Order, nulls and ties are as in `repair_report`.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple] = []
        for _ in _finished(batches, held.append):
            yield _batch(held, EDITS)
            held.clear()

    return _in_order(rows, conv_col, turn_col, role_col, text_col).mapInArrow(run, EDITS)


def damaged(rows: DataFrame) -> DataFrame:
    """conv_id, turn, role, text with faults by the CRC-32 of `conv_id:turn`, of 20 rows one each: 0 drops the row, 1 empties
    its text, 2 takes out its `.!?`, 3 repeats it, 4 gives it to the user. Nulls read as one space."""
    blank = F.lit(" ")
    h = F.crc32(F.concat(F.coalesce(F.col("conv_id").cast("string"), blank), F.lit(":"), F.coalesce(F.col("turn").cast("string"), blank)).cast("binary"))
    kind = rows.select("conv_id", "turn", F.coalesce("role", blank).alias("role"), F.coalesce("text", blank).alias("text"), (h % 20).alias("kind"))
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    copies = F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))
    return kind.where("kind <> 0").select(
        "conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), F.explode(copies).alias("copy")
    ).drop("copy")


def damage_report(rows: DataFrame) -> DataFrame:
    """`repair_report` of every conversation in `rows` after `damaged`; one of which no row is left has no faults and no edits."""
    ids = rows.select(F.col("conv_id").cast("long").alias("conv_id")).distinct()
    report = repair_report(damaged(rows)).withColumnRenamed("conv_id", "id")
    found = ids.join(report, F.col("conv_id").eqNullSafe(F.col("id")), "left")
    zero, empty = F.lit(0).cast("long"), F.lit(hashlib.sha256().hexdigest())
    counts = ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")
    return found.select(
        "conv_id", *[F.coalesce(c, zero).alias(c) for c in counts],
        F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", empty).alias("repaired_sha256"),
    )
