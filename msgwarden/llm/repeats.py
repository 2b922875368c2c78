"""Suffix-order deduplication: bytes that lie in a long string which occurs elsewhere in the corpus.

Equal strings of `LENGTH` bytes have the same smallest hash among their grams of `GRAM` bytes, so windows are brought
together by that hash: consecutive windows with the same one make a segment, and only segments whose hash occurs twice
are moved. Within a task, distinct segments are indexed by their suffix order: a run-length compressed
Burrows-Wheeler transform with the text places at run ends. Matching statistics are computed at those places only and
streamed along the text in between, where each step loses one byte.
"""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import col, shared_folder, written

LENGTH, GRAM = 200, 64
#: Bytes hashed at a time, windows of a segment at most, bytes indexed at a time, bytes of one hash that are not divided.
BLOCK, LONGEST, INDEXED, CROWDED = 1 << 21, 4096, 1 << 20, 900_000
_TOP = np.uint64(0xFFFFFFFFFFFFFFFF)


def _slide(values: np.ndarray, width: int, best: np.ufunc, idle) -> np.ndarray:
    """`best` (minimum or maximum) of every `width` consecutive values; two running passes over blocks of that width."""
    count = len(values) - width + 1
    rows = np.full(-(-len(values) // width) * width, idle, values.dtype)
    rows[: len(values)] = values
    rows = rows.reshape(-1, width)
    ahead = best.accumulate(rows, axis=1).ravel()
    back = best.accumulate(rows[:, ::-1], axis=1)[:, ::-1].ravel()
    return best(back[:count], ahead[width - 1 : width - 1 + count])


def _hashes(data: np.ndarray, length: int, base: int = 0x100000001B3) -> np.ndarray:
    """64-bit hash of the `length` bytes at every place: a polynomial put together from powers of two, then mixed."""
    with np.errstate(over="ignore"):
        power, ready, done, total = np.uint64(base), (data.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15), 1, None
        rest = length
        while True:
            if rest & done:
                if total is None:
                    total, size = ready.copy(), done
                else:  # the part so far follows `done` bytes
                    count = len(data) - size - done + 1
                    shift = np.uint64(pow(base, size, 1 << 64))
                    total, size = ready[:count] * shift + total[done : done + count], size + done
                rest ^= done
            if not rest:
                break
            ready = ready[:-done] * power + ready[done:]
            power, done = power * power, done * 2
        total ^= total >> np.uint64(29)
        total *= np.uint64(0xBF58476D1CE4E5B9)
        total ^= total >> np.uint64(32)
    return total


def _blocks(rows: Iterable[tuple], length: int, size: int) -> Iterator[list[tuple]]:
    """(row, place in its text, bytes) lists of about `size` bytes; longer texts in parts that share `length` - 1 bytes."""
    held, total = [], 0
    for row, raw in rows:
        for at in range(0, max(1, len(raw) - length + 1), size):
            held.append((row, at, raw[at : at + size + length - 1]))
            total += len(held[-1][2])
            if total >= size:
                yield held
                held, total = [], 0
    if held:
        yield held


def segments_of(block: list[tuple], length: int, gram: int, longest: int) -> dict[str, np.ndarray]:
    """Segments of a block: their hash, the part of the block, the first window and how many there are.

    `many`: the gram with that hash is met twice or more in the segment, so it may hold equal windows by itself.
    """
    data = np.frombuffer(b"".join(raw for _, _, raw in block), np.uint8)
    sizes = np.array([len(raw) for _, _, raw in block])
    starts = np.cumsum(sizes) - sizes
    windows = len(data) - length + 1
    if windows < 1:
        return {k: np.zeros(0, np.int64) for k in ("h", "part", "start", "windows", "many")}
    width = length - gram + 1
    grams = _hashes(data, gram)
    least = _slide(grams, width, np.minimum, _TOP)
    edge = np.zeros(len(data) + 1, np.int32)
    own = np.maximum(0, sizes - length + 1)
    np.add.at(edge, starts, (own > 0).astype(np.int32))
    np.add.at(edge, starts + own, -(own > 0).astype(np.int32))
    valid = np.cumsum(edge[:windows]) > 0
    change = np.flatnonzero((least[1:] != least[:-1]) | (valid[1:] != valid[:-1])) + 1
    first = np.concatenate([[0], change])
    count = np.diff(np.concatenate([first, [windows]]))
    first, count = first[valid[first]], count[valid[first]]
    pieces = -(-count // longest)
    if (pieces > 1).any():
        nth = np.arange(pieces.sum()) - np.repeat(np.cumsum(pieces) - pieces, pieces)
        first, total = np.repeat(first, pieces) + nth * longest, np.repeat(count, pieces)
        count = np.minimum(longest, total - nth * longest)
    h = least[first]
    # places of grams that are the least of some window
    around = np.zeros(len(grams) + width - 1, np.uint64)
    around[width - 1 : width - 1 + windows] = np.where(valid, least, 0)
    chosen = np.flatnonzero(_slide(around, width, np.maximum, np.uint64(0)) == grams)
    low = np.searchsorted(chosen, first)
    high = np.searchsorted(chosen, first + count + width - 1)
    met = np.zeros(len(first), np.int64)
    todo, step = np.arange(len(first)), 0
    while len(todo):
        todo = todo[(low[todo] + step < high[todo]) & (met[todo] < 2)]
        met[todo] += grams[chosen[low[todo] + step]] == h[todo]
        step += 1
    part = np.searchsorted(starts, first, side="right") - 1
    return {"h": h.view(np.int64), "part": part, "start": first - starts[part], "windows": count, "many": met > 1}


def _sorted(first: np.ndarray, second: np.ndarray, places: np.ndarray, n: int) -> np.ndarray:
    """`places` by `first` there (if any), `second` there, and place; packed into one number where they fit."""
    bits = n.bit_length()
    if (2 + bool(len(first))) * bits <= 63 and (len(first) or bits <= 27):
        keys = second[places] << bits | places
        if len(first):
            keys |= first[places] << 2 * bits
        keys.sort()
        return keys & (1 << bits) - 1
    return places[np.lexsort((places, second[places], *([first[places]] if len(first) else [])))]


class RunIndex:
    """Suffix order of distinct segments, with the text places at the ends of the runs of its transform."""

    def __init__(self, segments: list[bytes]):
        step = 4  # symbols of nine bits in a first key
        sizes = np.array([len(s) for s in segments])
        self.starts = np.cumsum(sizes + step) - sizes - step
        n = int(sizes.sum()) + step * len(segments)
        symbols = np.zeros(n + step, np.int64)
        self.end = np.repeat(self.starts + sizes, sizes + step)
        inside = np.arange(n) < self.end
        symbols[:n][inside] = np.frombuffer(b"".join(segments), np.uint8).astype(np.int64) + 1
        self.symbols = symbols
        key = np.zeros(n, np.int64)
        for i in range(step):
            key = (key << 9) | symbols[i : i + n]
        # a name is one more than the number of suffixes before its group; 0 stands at or after a segment's end
        places, name = _sorted(np.zeros(0, np.int64), key, np.flatnonzero(inside), n), np.zeros(n, np.int64)
        name[places] = 1
        sorted_key, span, longest = key[places], step, int(sizes.max())
        self.names, self.spans = [], []
        while True:
            fresh = np.flatnonzero(np.concatenate([[True], sorted_key[1:] != sorted_key[:-1]]))
            count = np.diff(np.append(fresh, len(places)))
            group = name[places[fresh]]  # all groups that were one so far have the same name
            first = np.flatnonzero(np.concatenate([[True], group[1:] != group[:-1]]))
            begin = np.repeat(fresh[first], np.diff(np.append(first, len(fresh))))
            name = name.copy()
            name[places] = np.repeat(group + fresh - begin, count)
            self.names.append(name.astype(np.int32))
            self.spans.append(span)
            places = places[np.repeat(count > 1, count)]  # only suffixes that share a name are sorted on
            if not len(places) or span >= longest:
                break
            after = places + span
            follow = np.zeros(n, np.int64)
            follow[places] = np.where(after < self.end[places], name[np.minimum(after, n - 1)], 0)
            places = _sorted(name, follow, places, n)
            sorted_key = name[places] * (n + 1) + follow[places]
            span *= 2
        # equal suffixes end with their segments and stand in the segments' order
        self.order = _sorted(np.zeros(0, np.int64), name, np.flatnonzero(inside), n)
        before = np.where(np.isin(self.order, self.starts), 0, symbols[self.order - 1])
        same = (before[1:] == before[:-1]) & (before[1:] > 0)
        self.heads, self.tails = np.flatnonzero(~same) + 1, np.flatnonzero(~same)

    def common(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Length of the longest common prefix of the suffixes at `a` and `b`."""
        most = np.minimum(self.end[a] - a, self.end[b] - b)
        got = np.zeros(len(a), np.int64)
        for name, span in zip(reversed(self.names), reversed(self.spans)):
            while True:
                open_ = np.flatnonzero(got + span <= most)
                alike = name[a[open_] + got[open_]] == name[b[open_] + got[open_]]
                got[open_[alike]] += span
                if not alike.any() or span < self.spans[-1]:
                    break
        for _ in range(self.spans[0]):
            open_ = np.flatnonzero(got < most)
            alike = self.symbols[a[open_] + got[open_]] == self.symbols[b[open_] + got[open_]]
            if not alike.any():
                break
            got[open_[alike]] += 1
        return got

    def matching(self) -> np.ndarray:
        """For every place, the longest string from there that also starts elsewhere.

        Neighbours in suffix order share most. Where a run of the transform begins or ends that length is compared;
        within a run it is what it was one place earlier in the text, less one.
        """
        n, longest = len(self.end), None
        for sampled, step in ((self.heads, -1), (self.tails, 1)):
            at, other = self.order[sampled], self.order[sampled + step]
            reach = np.zeros(n, np.int64)
            reach[self.starts] = self.starts
            reach[at] = at + self.common(at, other)
            reach = np.maximum.accumulate(reach) - np.arange(n)
            longest = reach if longest is None else np.maximum(longest, reach)
        return np.minimum(np.maximum(longest, 0), np.maximum(self.end - np.arange(n), 0))


def _intervals(flags: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Begins and ends of the runs of true values."""
    edge = np.diff(np.concatenate([[False], flags, [False]]).astype(np.int8))
    return np.flatnonzero(edge == 1), np.flatnonzero(edge == -1)


def _segment_key(h: int, segment: bytes) -> tuple[int, int]:
    value = xxhash.xxh3_128_intdigest(segment, h & 0xFFFFFFFF)
    low, high = value & (1 << 64) - 1, value >> 64
    return low - (low >> 63 << 64), high - (high >> 63 << 64)


_LONG = pa.int64()
_SPANS = "s1 long, s2 long, spans array<struct<start long, end long>>"
_SPANS_ARROW = pa.schema([("s1", _LONG), ("s2", _LONG), ("spans", pa.list_(pa.struct([("start", _LONG), ("end", _LONG)])))])


def _text_keys(text: Column) -> list[Column]:
    return [F.xxhash64(text).alias("t1"), F.xxhash64(F.lit(1), text).alias("t2")]


class Repeats:
    """Where the texts of `docs` repeat each other; see `repeats`."""

    def __init__(self, docs: DataFrame, text_col: str, length: int, gram: int, longest: int, crowded: int):
        self.length, self.gram, self.longest, self.crowded = length, gram, longest, crowded
        self.spark = docs.sparkSession
        raw = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
        texts = docs.select(raw.alias("raw")).where(F.octet_length("raw") >= length).select(*_text_keys(F.col("raw")), "raw")
        self.texts = self._by_text(texts.groupBy("t1", "t2").agg(F.first("raw").alias("raw"), F.count(F.lit(1)).alias("copies")))
        self.found = written(self._repeated_hashes())

    def _by_text(self, texts: DataFrame) -> DataFrame:
        """Distinct texts, stored in buckets of their key, so that no later join moves them."""
        buckets = int(self.spark.conf.get("spark.sql.shuffle.partitions"))
        name = f"llm_{uuid.uuid4().hex}"
        rows = texts.repartition(buckets, "t1", "t2").write.bucketBy(buckets, "t1", "t2").sortBy("t1", "t2")
        rows.option("path", f"{shared_folder(self.spark)}/{name}").option("compression", "zstd").saveAsTable(name)
        stored = self.spark.table(name)
        self.spark.sql(f"DROP TABLE {name}")  # the name only; the files are in a folder of their own
        return stored

    def _repeated_hashes(self) -> DataFrame:
        """Per text, its segments whose hash is met twice or more in the corpus."""
        length, gram, longest = self.length, self.gram, self.longest

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            def rows():
                for batch in batches:
                    for i in range(batch.num_rows):
                        yield (batch.column(0)[i].as_py(), batch.column(1)[i].as_py()), batch.column(2)[i].as_py()

            for block in _blocks(rows(), length, BLOCK):
                s = segments_of(block, length, gram, longest)
                keys = np.array([row for row, _, _ in block], np.int64).reshape(-1, 2)[s["part"]]
                at = np.array([at for _, at, _ in block], np.int64)[s["part"]]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(x) for x in (s["h"], keys[:, 0].copy(), keys[:, 1].copy(), s["start"] + at, s["windows"].astype(np.int64))] + [pa.array(s["many"].astype(bool))],
                    ["h", "t1", "t2", "start", "windows", "many"],
                )

        all_segments = written(self.texts.select("t1", "t2", "raw").mapInArrow(run, "h long, t1 long, t2 long, start long, windows long, many boolean"))
        met = all_segments.groupBy("h").agg(F.count(F.lit(1)).alias("n"), F.max("many").alias("many")).where("n > 1 or many").select("h")
        again = all_segments.join(met, "h").groupBy("t1", "t2").agg(F.collect_list(F.struct("h", "start", "windows")).alias("segments"))
        return again

    def _cut(self, columns: str, row) -> DataFrame:
        """`row(h, segment, copies, t1, t2, start)` for every segment found; the texts stay where they are."""
        length = self.length
        kinds = {"long": _LONG, "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], kinds[c.split()[1]]) for c in columns.split(", ")])

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    out = []
                    for r in batch.slice(start, 64).to_pylist():
                        for s in r["segments"]:
                            segment = r["raw"][s["start"] : s["start"] + s["windows"] + length - 1]
                            out.append(row(s["h"], segment, r["copies"], r["t1"], r["t2"], s["start"]))
                    columns_ = list(zip(*out)) or [[] for _ in schema]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns_, schema)], schema=schema)

        return self.texts.join(self.found, ["t1", "t2"]).select("t1", "t2", "raw", "copies", "segments").mapInArrow(run, columns)

    def window_spans(self) -> DataFrame:
        """Per text, the ranges of window starts whose window occurs elsewhere: (t1, t2, spans)."""
        cut = self._cut("h long, segment binary, n long", lambda h, segment, copies, *_: (h, segment, copies))
        distinct = written(cut.groupBy("h", "segment").agg(F.sum("n").alias("n")))
        marked = self._marked(distinct)
        places = self._cut(
            "s1 long, s2 long, t1 long, t2 long, start long", lambda h, segment, _, t1, t2, start: (*_segment_key(h, segment), t1, t2, start)
        )
        moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("start")).alias("start"), (s["end"] + F.col("start")).alias("end")))
        hits = places.join(marked, ["s1", "s2"]).select("t1", "t2", moved.alias("spans"))
        return hits.groupBy("t1", "t2").agg(F.flatten(F.collect_list("spans")).alias("spans"))

    def _indexed(self, quiet: DataFrame) -> DataFrame:
        """Spans of segments by the run index, all segments of a hash together."""
        length = self.length

        def spans(held: list[tuple]) -> pa.RecordBatch:
            """`held`: lists of (h, segment, n), one for each hash."""
            rows = []

            def add(h, segment, begins, ends):
                s1, s2 = _segment_key(h, segment)
                rows.append({"s1": s1, "s2": s2, "spans": [{"start": a, "end": b} for a, b in zip(begins, ends)]})

            known = [m for members in held for m in members if m[2] > 1]
            for h, segment, _ in known:  # met twice as a whole
                add(h, segment, [0], [len(segment) - length + 1])
            open_ = [m for members in held if any(n == 1 for _, _, n in members) for m in members]
            if open_:
                index = RunIndex([segment for _, segment, _ in open_])
                hit = index.matching() >= length
                for (h, segment, n), start in zip(open_, index.starts):
                    if n == 1:
                        begins, ends = _intervals(hit[start : start + len(segment) - length + 1])
                        if len(begins):
                            add(h, segment, begins.tolist(), ends.tolist())
            return pa.RecordBatch.from_pylist(rows, schema=_SPANS_ARROW)

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            held, total, last = [], 0, None
            for batch in batches:
                for h, segment, n in zip(*(c.to_pylist() for c in batch.columns)):
                    if h != last:
                        if total >= INDEXED:
                            yield spans(held)
                            held, total = [], 0
                        held.append([])
                    held[-1].append((h, segment, n))
                    total, last = total + len(segment), h
            if held:
                yield spans(held)

        return quiet.select("h", "segment", "n").repartition("h").sortWithinPartitions("h").mapInArrow(run, _SPANS)

    def _crowded(self, distinct: DataFrame) -> DataFrame | None:
        """The hashes of `distinct` whose segments are too many bytes for one index, if there are any."""
        sizes = distinct.groupBy("h").agg(F.sum(F.length("segment")).alias("bytes"), F.count(F.lit(1)).alias("members"))
        found = written(sizes.where((F.col("bytes") > self.crowded) & (F.col("members") > 1)).select("h"))
        return None if found.isEmpty() else found

    def _marked(self, distinct: DataFrame) -> DataFrame:
        """(s1, s2, spans): windows of the segments `distinct` (h, segment, n) that occur elsewhere, by the run index.

        Segments of a crowded hash are divided by where their windows hold its gram: windows of one half of the places all
        have the same bytes around it, so by the hash of those they part into groups, whose segments are shorter and often
        the same. What is still crowded is divided again; after at most eight rounds, a group holds one window. What is
        found in the parts goes back to the segments they were cut from.
        """
        crowded = self._crowded(distinct)
        if crowded is None:
            return self._indexed(distinct)
        found, rounds, whole = [self._indexed(distinct.join(crowded, "h", "left_anti"))], [], True
        while crowded is not None:
            parts = written(self._divided(distinct.join(crowded, "h", "left_semi"), whole))
            rounds.append(parts.select("c1", "c2", "p1", "p2", "shift"))
            distinct, whole = written(parts.groupBy("h", "segment", "at", "low", "high").agg(F.sum("n").alias("n"))), False
            crowded = self._crowded(distinct)
            found.append(self._indexed(distinct if crowded is None else distinct.join(crowded, "h", "left_anti")))
        marked = found.pop()
        moved = F.transform("spans", lambda s: F.struct((s["start"] + F.col("shift")).alias("start"), (s["end"] + F.col("shift")).alias("end")))
        while rounds:
            back = marked.join(rounds.pop(), (F.col("s1") == F.col("c1")) & (F.col("s2") == F.col("c2")))
            marked = found.pop().union(back.select(F.col("p1").alias("s1"), F.col("p2").alias("s2"), moved.alias("spans")))
        return marked

    def _divided(self, crowded: DataFrame, whole: bool) -> DataFrame:
        """Segments cut in two: windows that hold the gram of their hash at one of the places `low` to `high`, for either half.

        `at` is where the gram stands in the part. A window's gram is the first one with the hash, so equal windows hold it
        at the same place. `h`: the hash of the bytes that all windows with these places hold around the gram. `p1`, `p2` and
        `c1`, `c2` are the keys of the segment and the part, which begins `shift` bytes into it.
        """
        length, gram = self.length, self.gram
        kinds = "h long, segment binary, at int, low int, high int, n long, c1 long, c2 long, p1 long, p2 long, shift long"
        types = {"long": _LONG, "int": pa.int32(), "binary": pa.binary()}
        schema = pa.schema([(c.split()[0], types[c.split()[1]]) for c in kinds.split(", ")])

        def runs(h: int, segment: bytes) -> Iterator[tuple[int, int, int]]:
            """First and last window, and place of the gram they hold first."""
            hashes, windows, before = _hashes(np.frombuffer(segment, np.uint8), gram).view(np.int64), len(segment) - length + 1, -1
            for at in np.flatnonzero(hashes == h).tolist():
                first, last = max(before + 1, at - length + gram), min(at, windows - 1)
                if first <= last:
                    yield first, last, at
                before = at

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for begin in range(0, batch.num_rows, 512):
                    out = []
                    for r in batch.slice(begin, 512).to_pylist():
                        segment, parent = r["segment"], _segment_key(r["h"], r["segment"])
                        low, high = (0, length - gram) if whole else (r["low"], r["high"])
                        middle = (low + high) // 2
                        for first, last, at in runs(r["h"], segment) if whole else [(0, len(segment) - length, r["at"])]:
                            for a, b in ((low, middle), (middle + 1, high)):
                                x, y = max(a, at - last), min(b, at - first)
                                if x <= y:
                                    part = segment[at - y : at - x + length]
                                    around = segment[at - a : at + length - b]
                                    h = xxhash.xxh64_intdigest(around, a << 32 | b)
                                    h -= h >> 63 << 64
                                    out.append((h, part, y, a, b, r["n"], *_segment_key(h, part), *parent, at - y))
                    columns = list(zip(*out)) or [()] * len(schema)
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns, schema)], schema=schema)

        return crowded.mapInArrow(run, kinds)

    def finished(self, columns: str, schema: pa.Schema, row) -> DataFrame:
        """t1, t2 and `row(bytes, begins, ends)` of every text of `length` bytes or more; begins and ends of removed runs."""
        length = self.length

        def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for start in range(0, batch.num_rows, 64):
                    out = []
                    for r in batch.slice(start, 64).to_pylist():
                        raw = r["raw"]
                        if r["copies"] > 1:
                            begins, ends = [0], [len(raw)]
                        else:
                            edge = np.zeros(len(raw) + 1, np.int32)
                            for s in r["spans"] or ():
                                edge[s["start"]] += 1
                                edge[s["end"] + length - 1] -= 1
                            begins, ends = (x.tolist() for x in _intervals(np.cumsum(edge[:-1]) > 0))
                        out.append((r["t1"], r["t2"], *row(raw, begins, ends)))
                    columns_ = list(zip(*out)) or [[] for _ in schema]
                    yield pa.RecordBatch.from_arrays([pa.array(list(c), f.type) for c, f in zip(columns_, schema)], schema=schema)

        joined = self.texts.join(self.window_spans(), ["t1", "t2"], "left")
        return joined.select("t1", "t2", "raw", "copies", "spans").mapInArrow(run, columns)


def _kept_bytes(raw: bytes, begins: list[int], ends: list[int]) -> bytes:
    return b"".join(raw[a:b] for a, b in zip([0, *ends], [*begins, len(raw)]))


def _kept_text(raw: bytes, begins: list[int], ends: list[int]) -> str:
    """What is left in whole characters: one that loses a byte is lost."""
    kept, at = [], 0
    for a, b in zip(begins, ends):
        while a > at and raw[a] & 0xC0 == 0x80:
            a -= 1
        kept.append(raw[at:a])
        while b < len(raw) and raw[b] & 0xC0 == 0x80:
            b += 1
        at = b
    return b"".join([*kept, raw[at:]]).decode()


def repeats(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", length: int = LENGTH, gram: int = GRAM,
    longest: int = LONGEST, crowded: int = CROWDED,
) -> DataFrame:
    """One row per document: its bytes, those covered by a string of `length` bytes that also starts elsewhere in the
    corpus, the runs these make, and the SHA-256 of the rest.

    A null text is empty; texts shorter than `length` lose nothing; equal texts (repeated rows among them) lose all.
    A null id stays null, other columns are ignored, an empty table gives no rows. Only distinct texts are moved and
    searched, whatever number of copies they have.
    """
    found = Repeats(docs, text_col, length, gram, longest, crowded)
    schema = pa.schema([("t1", _LONG), ("t2", _LONG), ("removed", _LONG), ("runs", _LONG), ("digest", pa.string())])

    def row(raw, begins, ends):
        return sum(ends) - sum(begins), len(begins), hashlib.sha256(_kept_bytes(raw, begins, ends)).hexdigest()

    by_text = found.finished("t1 long, t2 long, removed long, runs long, digest string", schema, row)
    raw = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    rows = docs.select(
        col(id_col).cast("long").alias("doc_id"), *_text_keys(raw), F.octet_length(raw).cast("long").alias("n_bytes"),
        F.when(F.octet_length(raw) < length, F.sha2(raw, 256)).alias("short"),
    )
    return rows.join(by_text, ["t1", "t2"], "left").select(
        "doc_id", "n_bytes", F.coalesce("removed", F.lit(0)).alias("n_removed"), F.coalesce("runs", F.lit(0)).alias("n_spans"),
        F.coalesce("digest", "short").alias("kept_sha256"),
    )


def without_repeats(
    docs: DataFrame, text_col: str = "text", chars_col: str | None = None, length: int = LENGTH, gram: int = GRAM,
    longest: int = LONGEST, crowded: int = CROWDED,
) -> DataFrame:
    """All rows of `docs` with the same columns, their texts without repeated strings, cut at whole characters.

    A null text stays null. `chars_col`, where given, is set to the new number of characters.
    """
    found = Repeats(docs, text_col, length, gram, longest, crowded)
    schema = pa.schema([("t1", _LONG), ("t2", _LONG), ("left", pa.string())])
    by_text = found.finished("t1 long, t2 long, left string", schema, lambda raw, a, b: (_kept_text(raw, a, b),))
    raw = F.coalesce(col(text_col).cast("string"), F.lit("")).cast("binary")
    names = [f"c{i}" for i in range(len(docs.columns))]
    spot = docs.columns.index(text_col)
    short = F.when(F.octet_length(raw) < length, col(text_col).cast("string"))
    rows = docs.select(*_text_keys(raw), *((short if i == spot else col(c)).alias(n) for i, (c, n) in enumerate(zip(docs.columns, names))))
    joined = rows.join(by_text, ["t1", "t2"], "left").withColumn(names[spot], F.coalesce("left", names[spot]))
    if chars_col is not None:
        kind = docs.schema[chars_col].dataType
        joined = joined.withColumn(names[docs.columns.index(chars_col)], F.coalesce(F.length(names[spot]), F.lit(0)).cast(kind))
    return joined.select(*(F.col(n).alias(c) for n, c in zip(names, docs.columns)))
