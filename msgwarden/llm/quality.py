"""Quality rules: repeated words and compression bands."""

from __future__ import annotations

from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator
from itertools import count

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import col, id_and_text, texts

LEVEL = 3
CHUNK_BYTES = 4096
#: From so many bytes on: least and greatest ratio of the text's size to its compressed size. Short texts compress
#: badly whatever they say; long ones hold more to refer back to.
WHOLE_BANDS = ((0, 0.0, 4.0), (256, 1.15, 4.0), (512, 1.25, 4.0), (2048, 1.4, 4.5), (16_384, 1.4, 6.0), (131_072, 1.4, 8.0))
#: The same for one chunk. A text fails when chunks outside make up over this share of the chunked bytes.
CHUNK_BANDS = ((0, 0.0, 4.0), (1024, 1.3, 4.5), (4096, 1.4, 4.5))
#: A last chunk under this joins no count, unless it is the only one.
CHUNK_LEAST = 1024
CHUNK_SHARE = 0.25
WINDOW = 5
_SPACES, _SYMBOLS = b" \t\n\v\f\r", b"#*$%&|<>"
#: Up to so many words, windows are compared as tuples, beyond as sorted number arrays.
_TUPLES_UPTO = 20_000
SCHEMA = (
    "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long,"
    " base_failed boolean, kept boolean, whole_ratio double, bad_chunk_share double"
)
_NAMES = [field.split()[0] for field in SCHEMA.split(", ")]
_KINDS = {"long": pa.int64(), "boolean": pa.bool_(), "double": pa.float64()}
_ARROW = pa.schema([(field.split()[0], _KINDS[field.split()[1]]) for field in SCHEMA.split(", ")])


def repeated_words(words: list[bytes], window: int = WINDOW) -> int:
    """Words that lie in a run of `window` words which occurs twice or more."""
    n = len(words) - window + 1
    if n < 2:
        return 0
    if n <= _TUPLES_UPTO:
        runs = list(zip(*(words[i:] for i in range(window))))
        seen = Counter(runs)
        if len(seen) == n:
            return 0
        again = np.fromiter((seen[r] > 1 for r in runs), bool, n)
    else:
        numbers: dict[bytes, int] = defaultdict(count().__next__)
        ids = np.fromiter(map(numbers.__getitem__, words), np.int64, len(words))
        name = ids
        for step in range(1, window):  # names of ever longer runs: equal names, equal runs
            pairs = name[:-1] * (int(ids.max()) + 1) + ids[step:]
            name = np.unique(pairs, return_inverse=True)[1].astype(np.int64)
        again = np.bincount(name)[name] > 1
    edges = np.zeros(len(words) + 1, np.int64)
    edges[:n] += again
    edges[window : window + n] -= again
    return int((np.cumsum(edges[:-1]) > 0).sum())


def outside(size: int, packed: int, bands: tuple) -> bool:
    low, high = next((lo, hi) for least, lo, hi in reversed(bands) if size >= least)
    return not low <= size / packed <= high


def measure(text: str, pack: zstandard.ZstdCompressor) -> tuple:
    """What the rules look at, after the id: from n_words to bad_chunk_share."""
    raw = text.encode()
    words = raw.split()
    lines = [line for line in raw.split(b"\n") if line.translate(None, _SPACES)]
    again = repeated_words(words)
    failed = len(words) < 10 or 100 * again > 20 * len(words)
    whole = len(pack.compress(raw))
    chunked = bad = 0
    view = memoryview(raw)
    for at in range(0, len(raw), CHUNK_BYTES):
        part = view[at : at + CHUNK_BYTES]
        if len(part) >= CHUNK_LEAST or not at:
            chunked += len(part)
            bad += len(part) * outside(len(part), len(pack.compress(part)), CHUNK_BANDS) if len(part) else 0
    share = bad / chunked if chunked else 0.0
    kept = not failed and not outside(len(raw), whole, WHOLE_BANDS) and share <= CHUNK_SHARE
    return (
        len(words), len(text) - (len(raw) - len(raw.translate(None, _SPACES))), len(raw) - len(raw.translate(None, _SYMBOLS)),
        len(lines) - len(set(lines)), again, failed, kept, len(raw) / whole, share,
    )


def quality(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document with its counts, its compression ratios and the verdict `kept`.

    Words are what stands between ASCII white space. A text fails the base rules with under ten words or with over 20 %
    of its words in repeated five-word runs. It fails the compression bands when its zstandard ratio as a whole leaves
    the band of its length, or when over a quarter of its bytes lie in fixed chunks that leave theirs.

    A null or empty text has no words and fails. Repeated rows are judged each for itself, a null id stays null, other
    columns are ignored, an empty table gives no rows. One narrow pass, a text at a time.
    """

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pack = zstandard.ZstdCompressor(level=LEVEL)
        for ids, batch in texts(batches):
            rows = [measure(text, pack) for text in batch]
            arrays = [pa.array(ids, pa.int64()), *(pa.array(c, f.type) for c, f in zip(zip(*rows), list(_ARROW)[1:]))]
            yield pa.RecordBatch.from_arrays(arrays, schema=_ARROW)

    return id_and_text(docs, id_col, text_col).mapInArrow(run, SCHEMA)


def keep_good(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """The rows of `docs`, all columns as they are, whose text passes; a null text does not."""

    @F.arrow_udf("boolean")
    def passes(column: pa.Array) -> pa.Array:
        pack, found = zstandard.ZstdCompressor(level=LEVEL), []
        for start in range(0, len(column), 256):  # only so many texts exist as Python strings
            found += [text is not None and bool(measure(text, pack)[6]) for text in column.slice(start, 256).to_pylist()]
        return pa.array(found, pa.bool_())

    return docs.where(passes(col(text_col).cast("string")))
