"""SentencePiece segmentations sampled from the piece lattice, and lossless decoding."""

from __future__ import annotations

import math
import re
import zlib
from array import array
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import sentencepiece
import xxhash
from pyspark.sql import DataFrame

from .common import id_and_text, texts

#: Sharpness of the distribution: pieces weigh 1 / rank to this power.
SHARPNESS = 1.0
#: Chunks of more characters are worked on alone, a character at a time.
RUN = 4096
#: Characters whose lattices are built at once, and chunks drawn at once.
BLOCK = 400_000
#: Edges of lattices remembered from one block of texts to the next.
REMEMBERED = 3_000_000
_MIX = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def _uniform(seeds: np.ndarray, chunks: np.ndarray, step: int) -> np.ndarray:
    """Numbers in [0, 1) that depend on the row's seed, the chunk's place in its text, and the step alone."""
    with np.errstate(over="ignore"):
        x = seeds + chunks * _MIX[0] + np.uint64(step) * _MIX[3]
        x = (x ^ (x >> np.uint64(30))) * _MIX[1]
        x = (x ^ (x >> np.uint64(27))) * _MIX[2]
        return ((x ^ (x >> np.uint64(31))) >> np.uint64(11)).astype(np.float64) * 2.0**-53


class Lattices(dict):
    """Numbers of the chunks whose lattices are known, by the chunk without its first space; new ones queue in `fresh`.

    A lattice is its nodes, each the first of the edges that end there; an edge holds its piece (-1 less the code point of
    a spelled character), the node it comes from (-1: the chunk's start), and the share of the node's sum up to it.
    """

    def __init__(self):
        super().__init__()
        self.fresh: list[str] = []
        self.edges, self.nodes = 0, 0
        self.share, self.piece, self.origin = np.zeros(1 << 16), np.zeros(1 << 16, np.int32), np.zeros(1 << 16, np.int32)
        self.first, self.end = np.zeros(1 << 16, np.int32), np.zeros(1 << 12, np.int32)

    def __missing__(self, word: str) -> int:
        if len(word) >= RUN:
            return -1
        self[word] = number = len(self)
        self.fresh.append(word)
        return number

    def add(self, share: np.ndarray, piece: np.ndarray, origin: np.ndarray, first: np.ndarray, end: np.ndarray, number: int) -> None:
        """The lattices of the chunks from `number` on: edges, nodes, and the last node of each chunk."""
        self.share, self.piece = _put(self.share, self.edges, share), _put(self.piece, self.edges, piece)
        self.origin = _put(self.origin, self.edges, np.where(origin < 0, -1, origin + self.nodes))
        self.first, self.end = _put(self.first, self.nodes, first + self.edges), _put(self.end, number, end + self.nodes)
        self.edges, self.nodes = self.edges + len(share), self.nodes + len(first)


def _put(room: np.ndarray, at: int, values: np.ndarray) -> np.ndarray:
    """`room` with `values` at `at`, in a larger array if they do not fit."""
    if at + len(values) > len(room):
        room = np.concatenate([room[:at], np.zeros(max(len(values), at), room.dtype)])
    room[at : at + len(values)] = values
    return room


def chunk_keys(text: str) -> list[str]:
    """The chunks of a text with a space before it, each without its first space: runs of spaces with the word after them."""
    if not text:
        return []
    if "  " in text or text[0] == " ":
        return [chunk[1:] for chunk in re.findall(" +[^ ]*", " " + text)]
    return text.split(" ")


class PieceSampler:
    """Samples segmentations of texts by forward filtering and backward sampling.

    A text is read with a space before it. Pieces hold spaces at their start only, so its lattice falls apart into chunks,
    a run of spaces with the word after it. Forward sums depend on the chunk alone, so the lattice of a chunk is built once
    and remembered, up to a bound: pieces of all new chunks are found by walking their trie from every character at once,
    and sums go from character to character. Backward steps are drawn for all chunks of a block of texts that are not yet
    done. A very long chunk keeps the sums of its characters only, and finds the pieces once more on the way back.
    Characters that are no piece are spelled in byte pieces; that includes the model's own mark for a space, so decoding
    gives back every text as it was.
    """

    def __init__(self, model_path: str, sharpness: float = SHARPNESS):
        self.lattices = Lattices()
        model = sentencepiece.SentencePieceProcessor(model_file=model_path)
        self.bytes_of: list[bytes] = []
        ids: dict[str, int] = {}
        self.byte_ids = [0] * 256
        for i in range(model.get_piece_size()):
            piece = model.id_to_piece(i)
            if model.is_byte(i):
                self.bytes_of.append(bytes([int(piece[3:5], 16)]))
                self.byte_ids[int(piece[3:5], 16)] = i
            elif model.is_control(i) or model.is_unknown(i):
                self.bytes_of.append(b"")
            else:
                text = piece.replace("▁", " ")
                self.bytes_of.append(text.encode())
                if not re.search("[^ ] ", text):
                    ids[text] = i
        ranks = sorted(ids, key=lambda p: (-model.get_score(ids[p]), ids[p]))
        weight = lambda rank: -sharpness * math.log(rank + 2)
        self.pieces = {p: (ids[p], weight(r)) for r, p in enumerate(ranks)}
        self.longest = max(map(len, self.pieces), default=1)
        self.byte_weight = weight(len(ranks))
        self.weights = np.zeros(len(self.bytes_of))
        for i, w in self.pieces.values():
            self.weights[i] = w
        self._trie()

    def _trie(self) -> None:
        """Tables by code point for the first character, and from node and character class to node for the others."""
        top = 0x110000
        self.single, self.first = np.full(top, -1, np.int32), np.zeros(top, np.int32)
        self.classes = np.zeros(top, np.int32)
        nodes: dict[str, int] = {}
        longer = [p for p in self.pieces if len(p) > 1]
        for number, c in enumerate(sorted({c for p in longer for c in p[1:]}), 1):
            self.classes[ord(c)] = number
        for p in longer:
            for n in range(1, len(p) + 1):
                nodes.setdefault(p[:n], len(nodes) + 1)
        self.next = np.zeros((len(nodes) + 1, int(self.classes.max()) + 1), np.int32)
        self.ends = np.full(len(nodes) + 1, -1, np.int32)
        for prefix, node in nodes.items():
            if len(prefix) == 1:
                self.first[ord(prefix)] = node
            else:
                self.next[nodes[prefix[:-1]], self.classes[ord(prefix[-1])]] = node
            if prefix in self.pieces:
                self.ends[node] = self.pieces[prefix][0]
        for p, (i, _) in self.pieces.items():
            if len(p) == 1:
                self.single[ord(p)] = i

    def _edges(self, chars: np.ndarray, stop: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Start, length and piece of every piece in the chunks; -1 less the code point for a spelled character.
        `stop`: for every character the end of its chunk."""
        at = np.arange(len(chars))
        one = self.single[chars].astype(np.int64)
        found = [(at, np.ones(len(at), np.int64), np.where(one < 0, -1 - chars.astype(np.int64), one))]
        node, length = self.first[chars], 1
        while True:
            going = (node > 0) & (at + length < stop[at])
            at, node = at[going], node[going]
            if not len(at):
                break
            node = self.next[node, self.classes[chars[at + length]]]
            length += 1
            hit = np.flatnonzero(self.ends[node] >= 0)
            found.append((at[hit], np.full(len(hit), length), self.ends[node[hit]].astype(np.int64)))
        return tuple(np.concatenate(x) for x in zip(*reversed(found)))  # a stable sort by end keeps long pieces first

    def _learn(self) -> None:
        """Builds the lattices of the chunks that are new, in blocks."""
        words, known = self.lattices.fresh, self.lattices
        number, low = len(known) - len(words), 0
        while low < len(words):
            high, held = low, 0
            while high < len(words) and (high == low or held + len(words[high]) < BLOCK):
                held += len(words[high]) + 1
                high += 1
            known.add(*self._lattices(words[low:high]), number + low)
            low = high
        words.clear()

    def _lattices(self, words: list[str]) -> tuple[np.ndarray, ...]:
        """Shares, pieces and origins of edges, first edges of nodes, and last nodes, for all chunks of `words`."""
        chars = np.frombuffer("".join(" " + w for w in words).encode("utf-32-le"), np.uint32)
        n = len(chars)
        size = np.array([len(w) + 1 for w in words])
        begin = np.cumsum(size) - size
        origin, stop = np.repeat(begin, size), np.repeat(begin + size, size)
        start, length, piece = self._edges(chars, stop)
        depth = start - origin[start] + length
        order = np.argsort(depth * (n + 1) + start + length, kind="stable")
        start, end, piece, depth = start[order], (start + length)[order], piece[order], depth[order]
        weight = np.where(piece >= 0, self.weights[np.maximum(piece, 0)], 0.0)
        spelled = np.flatnonzero(piece < 0)
        code = -1 - piece[spelled]
        weight[spelled] = self.byte_weight * (1 + (code > 0x7F) + (code > 0x7FF) + (code > 0xFFFF))
        opening = start == origin[start]
        # nodes are places between characters, in the order in which their sums can be taken
        node_first = np.flatnonzero(np.concatenate([[True], end[1:] != end[:-1]]))
        node_of = np.zeros(n + 1, np.int64)
        node_of[end[node_first]] = np.arange(len(node_first))
        total = np.zeros(len(node_first))
        value = np.where(opening, weight, 0.0)
        cut = np.searchsorted(depth, np.arange(1, int(depth[-1]) + 2))
        node_cut = np.searchsorted(node_first, cut)
        inner = ~opening
        for low, high, a, b in zip(cut[:-1], cut[1:], node_cut[:-1], node_cut[1:]):
            own = np.flatnonzero(inner[low:high]) + low
            value[own] = weight[own] + total[node_of[start[own]]]
            total[a:b] = np.logaddexp.reduceat(value[low:high], node_first[a:b] - low)
        share = np.exp(value - np.repeat(total, np.diff(np.append(node_first, len(end)))))
        rank = np.arange(len(end)) - np.repeat(node_first, np.diff(np.append(node_first, len(end))))
        for k in range(1, int(rank.max()) + 1):
            later = np.flatnonzero(rank == k)
            share[later] += share[later - 1]
        share[np.append(node_first[1:], len(end)) - 1] = 1.0
        return share, piece, np.where(opening, -1, node_of[start]), node_first, node_of[begin + size]

    def _draw(self, chunks: np.ndarray, seeds: np.ndarray, places: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pieces per chunk, and all pieces in reading order, for chunks by number."""
        known = self.lattices
        node, open_, step, drawn = known.end[chunks], np.arange(len(chunks)), 0, []
        counts = np.zeros(len(chunks), np.int64)
        while len(open_):
            u = _uniform(seeds[open_], places[open_], step)
            edge = known.first[node]
            short = np.flatnonzero(known.share[edge] <= u)
            while len(short):
                edge[short] += 1
                short = short[known.share[edge[short]] <= u[short]]
            drawn.append((open_, known.piece[edge]))
            node, step = known.origin[edge], step + 1
            done = node < 0
            counts[open_[done]] = step
            open_, node = open_[~done], node[~done]
        ids, last = np.zeros(int(counts.sum()), np.int32), np.cumsum(counts) - 1
        for step, (owner, pieces) in enumerate(drawn):
            ids[last[owner] - step] = pieces
        return counts, ids

    def _draw_long(self, word: str, seed: np.uint64, place: int) -> np.ndarray:
        """The same for one very long chunk: sums of its characters are kept, pieces are looked up both ways."""
        text, pieces, spelt = " " + word, self.pieces, self.byte_weight

        def ending(end: int) -> list[tuple]:
            """(piece, weight, start) of the pieces that end there, the longest first."""
            found = []
            for start in range(max(0, end - self.longest), end):
                piece = pieces.get(text[start:end])
                if piece is not None:
                    found.append((*piece, start))
                elif start == end - 1:
                    found.append((-1 - ord(text[start]), spelt * len(text[start].encode()), start))
            return found

        sums = array("d", [0.0])
        for end in range(1, len(text) + 1):
            values = [weight + sums[start] for _, weight, start in ending(end)]
            top = max(values)
            sums.append(top + math.log(math.fsum(math.exp(v - top) for v in values)))
        at, step, drawn = len(text), 0, []
        while at:
            (u,) = _uniform(np.array([seed]), np.array([place], np.uint64), step)
            for piece, weight, start in ending(at):
                u -= math.exp(weight + sums[start] - sums[at])
                if u < 0:
                    break
            drawn.append(piece)
            at, step = start, step + 1
        return np.array(drawn[::-1], np.int32)

    def _spelled(self, owner: np.ndarray, ids: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same with byte pieces in place of spelled characters."""
        at = np.flatnonzero(ids < 0)
        if not len(at):
            return owner, ids
        raw = [chr(-1 - c).encode() for c in ids[at].tolist()]
        counts = np.ones(len(ids), np.int64)
        counts[at] = [len(b) for b in raw]
        out = np.repeat(ids, counts)
        for s, b in zip((np.cumsum(counts) - counts)[at].tolist(), raw):
            out[s : s + len(b)] = [self.byte_ids[x] for x in b]
        return np.repeat(owner, counts), out

    def sample(self, batch: list[str], seeds: list[int]) -> list[np.ndarray]:
        """Piece ids of every text; a text's depend on it and its seed only."""
        if self.lattices.edges > REMEMBERED:
            self.lattices = Lattices()
        owners, found = [np.zeros(0, np.int64)], [np.zeros(0, np.int32)]
        for first, words, owner, place in self._chunks(batch):
            chunks = np.fromiter(map(self.lattices.__getitem__, words), np.int64, len(words))
            self._learn()
            seed, place = np.array(seeds[first:], np.uint64)[owner - first], place.astype(np.uint64)
            short = np.flatnonzero(chunks >= 0)
            counts, ids = np.zeros(len(words), np.int64), None
            counts[short], ids = self._draw(chunks[short], seed[short], place[short])
            long_ = {i: self._draw_long(words[i], seed[i], place[i]) for i in np.flatnonzero(chunks < 0).tolist()}
            for i, own in long_.items():
                at = int(counts[:i].sum())
                counts[i], ids = len(own), np.concatenate([ids[:at], own, ids[at:]])
            own, ids = self._spelled(np.repeat(owner, counts), ids)
            owners.append(own)
            found.append(ids)
        cuts = np.searchsorted(np.concatenate(owners), np.arange(1, len(batch)))
        return np.split(np.concatenate(found), cuts)

    def _chunks(self, batch: list[str]) -> Iterator[tuple[int, list[str], np.ndarray, np.ndarray]]:
        """The chunks of the texts, about `BLOCK` at a time: the first text, chunks, their texts, their places in those."""
        words, owner, place, first = [], [], [], 0
        for i, text in enumerate(batch):
            keys = chunk_keys(text)
            for low in range(0, len(keys), BLOCK):
                part = keys[low : low + BLOCK]
                words += part
                owner.append(np.full(len(part), i))
                place.append(np.arange(low, low + len(part)))
                if len(words) >= BLOCK:
                    yield first, words, np.concatenate(owner), np.concatenate(place)
                    words, owner, place, first = [], [], [], i
        if words:
            yield first, words, np.concatenate(owner), np.concatenate(place)

    def decode(self, ids: Iterable[int]) -> str:
        return b"".join(map(self.bytes_of.__getitem__, ids)).decode()[1:]


def row_seed(row_id: int | None, seed: int) -> int:
    return xxhash.xxh64_intdigest(b"" if row_id is None else row_id.to_bytes(8, "little", signed=True), seed)


def sample_pieces(
    docs: DataFrame, model_path: str, seed: int = 0, sharpness: float = SHARPNESS, id_col: str = "doc_id", text_col: str = "text"
) -> DataFrame:
    """Every row's id and a sampled segmentation: `ids`, their number, CRC-32 (little-endian, 32 bits each), and whether
    decoding them gave back the text.

    The draw depends on the row's id, its text and `seed`, not on partitions or other rows; equal rows get equal pieces.
    A null or empty text has none; a null id is an id like others; other columns are ignored; an empty table gives no
    rows. A run without a space, however long, is one lattice. One narrow pass over few texts at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sampler = PieceSampler(model_path, sharpness)
        for ids, batch in texts(batches, 128):
            found = sampler.sample(batch, [row_seed(i, seed) for i in ids])
            sizes = np.array([len(f) for f in found])
            offsets = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int32)
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(f.astype("<u4").tobytes()) for f in found], pa.int64()),
                    pa.array([sampler.decode(f.tolist()) == t for f, t in zip(found, batch)]),
                    pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.concatenate(found) if found else np.zeros(0, np.int32))),
                ],
                ["doc_id", "n_pieces", "ids_crc32", "lossless", "ids"],
            )

    return id_and_text(docs, id_col, text_col).mapInArrow(
        run, "doc_id long, n_pieces long, ids_crc32 long, lossless boolean, ids array<int>"
    )
