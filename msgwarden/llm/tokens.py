"""Token ids of the public byte-level BPE vocabularies, with a bounded memory of words."""

from __future__ import annotations

import base64
from array import array

import tiktoken

#: Words remembered per Python worker, and the longest of them in characters.
CACHED_WORDS, CACHED_CHARS = 300_000, 48


class WordTokens(dict):
    """Token ids, as little-endian 32-bit bytes, of a word together with the space before it.

    A space that follows and precedes other characters always begins a new pre-token, and byte-level BPE never joins
    across pre-tokens; a text is therefore the concatenation of its words' tokens. Runs of spaces are not split.
    """

    def __init__(self, ranks_path: str, pattern: str):
        super().__init__()
        with open(ranks_path, "rb") as lines:
            ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}
        self.encode = tiktoken.Encoding("ranks", pat_str=pattern, mergeable_ranks=ranks, special_tokens={}).encode_ordinary

    def __missing__(self, word: str) -> bytes:
        found = array("I", self.encode(" " + word)).tobytes()
        if len(word) <= CACHED_CHARS:
            if len(self) >= CACHED_WORDS:
                self.clear()
            self[word] = found
        return found

    def ids(self, text: str) -> bytes:
        """Ids of the whole text."""
        if "  " in text:
            return array("I", self.encode(text)).tobytes()
        first, *rest = text.split(" ")
        if rest and not rest[-1]:  # a trailing space is a word of its own
            return array("I", self.encode(text)).tobytes()
        return array("I", self.encode(first)).tobytes() + b"".join(map(self.__getitem__, rest))
