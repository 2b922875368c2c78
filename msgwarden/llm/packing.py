"""Hierarchical multi-length packing of documents into token sequences."""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterable, Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import id_and_text, texts, written

TIERS = (256, 512, 1024, 2048)
#: Tokens of one training step; sequences of one tier are dealt to steps of this many.
STEP_TOKENS = 1 << 17
SCHEMA = (
    "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long,"
    " tier int, part int, nth long"
)
_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
_TYPES = [{"long": pa.int64(), "int": pa.int32()}[field.split()[1]] for field in SCHEMA.split(", ")]


class TierPacker:
    """Packs a stream of documents; holds at most one open window per tier.

    A document goes to the smallest tier that holds it, longer ones to the longest tier. Windows of a tier are filled in
    order and cut at the tier's size. What a long document leaves over opens a long window, whose gap is filled by the
    following shorter documents before their own tiers get any.
    """

    def __init__(self, tiers: tuple[int, ...], part: int):
        self.tiers, self.part, self.next_id = tuple(sorted(tiers)), part, part << 32
        self.longest = self.tiers[-1]
        self.open = {t: [] for t in self.tiers}
        self.filled = dict.fromkeys(self.tiers, 0)
        self.closed = dict.fromkeys(self.tiers, 0)
        self.rows: list[tuple] = []

    def add(self, doc: tuple, total: int) -> None:
        tier = next((t for t in self.tiers if total <= t), self.longest)
        start = 0
        if tier != self.longest and self.filled[self.longest]:
            start = min(total, self.longest - self.filled[self.longest])
            self._put(self.longest, doc, 0, start)
        if start < total:
            self._put(tier, doc, start, total)

    def _put(self, tier: int, doc: tuple, start: int, end: int) -> None:
        while start < end:
            length = min(end - start, tier - self.filled[tier])
            self.open[tier].append((doc, start, length))
            self.filled[tier] += length
            start += length
            if self.filled[tier] == tier:
                self._close(tier)

    def _close(self, tier: int) -> None:
        offset = 0
        for (doc_id, ids, total), start, length in self.open[tier]:
            crc = zlib.crc32(ids[4 * start : 4 * (start + length)])
            self.rows.append((doc_id, start, length, crc, total, self.next_id, offset, tier, self.part, self.closed[tier]))
            offset += length
        self.next_id += 1
        self.closed[tier] += 1
        self.open[tier], self.filled[tier] = [], 0

    def finish(self) -> None:
        """Joins the open windows and cuts them by tier, longest first; less than the smallest tier is padded."""
        rest = [piece for t in reversed(self.tiers) for piece in self.open[t]]
        left = sum(length for _, _, length in rest)
        self.open, self.filled = {t: [] for t in self.tiers}, dict.fromkeys(self.tiers, 0)
        sizes = []
        for t in reversed(self.tiers):
            sizes += [t] * (left // t)
            left %= t
        for size in sizes + [left] * bool(left):
            need = size
            tier = size if size in self.tiers else self.longest
            while need:
                doc, start, length = rest.pop(0)
                taken = min(need, length)
                self.open[tier].append((doc, start, taken))
                if taken < length:
                    rest.insert(0, (doc, start + taken, length - taken))
                need -= taken
            self._close(tier)

    def taken(self) -> pa.RecordBatch:
        columns = zip(*self.rows) if self.rows else [[] for _ in _NAMES]
        batch = pa.RecordBatch.from_arrays([pa.array(list(c), t) for c, t in zip(columns, _TYPES)], _NAMES)
        self.rows = []
        return batch


def pack(
    docs: DataFrame,
    encoder: Callable[[], Callable[[str], bytes]],
    id_col: str = "doc_id",
    text_col: str = "text",
    tiers: tuple[int, ...] = TIERS,
    end_id: int = 1,
    step_tokens: int = STEP_TOKENS,
) -> DataFrame:
    """One row per piece of a document: where it starts there, its length and checksum, its sequence and place there.

    `encoder()` is called once per task and returns a function from a text to the little-endian 32-bit token ids; every
    document ends with `end_id`. A null or empty text is that one token. Repeated rows are packed each for itself; a null
    id stays null; other columns are ignored; an empty table gives no rows.

    One narrow pass: each partition packs its own rows, holding one open window per tier, and numbers its sequences from
    partition number * 2^32. Every sequence is full but one per partition at most (under the smallest tier, to be padded
    to the longest). The pieces, a few numbers each, are stored; then `step_group` deals the sequences of each tier, in the
    order of partitions, to steps of `step_tokens`. How many sequences a partition has of a tier is one row of a small
    table, whose running sums say where its sequences stand among all; so all steps cost the same, but for the last of
    each tier.
    """
    end = end_id.to_bytes(4, "little")
    tiers = tuple(sorted(tiers))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = encoder()
        packer = TierPacker(tiers, TaskContext.get().partitionId())
        for ids, batch in texts(batches):
            for doc_id, text in zip(ids, batch):
                tokens = encode(text) + end
                packer.add((doc_id, tokens, len(tokens) // 4), len(tokens) // 4)
            yield packer.taken()
        packer.finish()
        yield packer.taken()

    pieces = written(id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA))
    held = pieces.where("offset = 0").groupBy("tier", "part").agg(F.count(F.lit(1)).alias("own"))
    before = held.select("tier", "part", (F.sum("own").over(W.partitionBy("tier").orderBy("part")) - F.col("own")).alias("before"))
    index = F.array_position(F.array(*[F.lit(t) for t in tiers]), F.col("tier")) - 1
    step = F.expr(f"(before + nth) div greatest(1, {step_tokens} div tier)") * len(tiers) + index
    return pieces.join(before, ["tier", "part"]).select(*_NAMES[:8], step.alias("step_group"))
