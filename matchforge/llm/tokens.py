"""Fast token ids of whole texts by a word-level BPE vocabulary file.

The vocabulary drops white space and never joins characters across it, so the ids of a text are the ids of its
white-space-free chunks, one after the other (the tests compare whole texts). A worker tokenises a chunk
when it meets it and then looks it up. Tables hold two generations of a bounded number of chunks: the older is dropped when
the younger is full, and what is still in use moves over, so memory is bounded for any input.
"""

from __future__ import annotations

import re
import struct

CACHE_CHUNKS, CACHE_WORDS = 400_000, 100_000
#: Ends every document.
END_ID = 2


def default_tokenizer() -> str:
    """Path of the vocabulary on this machine."""
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


class ChunkEncoder(dict):
    """bytes of a chunk -> its ids as little-endian 16-bit numbers."""

    #: Letters, then marks that are neither letters, digits, spaces nor apostrophes. The first group also takes
    #: superscripts and fractions, which are numbers to the vocabulary; isalpha() tells them apart.
    plain = re.compile(r"([^\W\d_]+)([!-&(-/:-@\[-`{-~]*)")

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__()
        self.tokenizer = Tokenizer.from_file(path)
        self.model = self.tokenizer.model
        self.older: dict[bytes, bytes] = {}
        self.words: dict[str, bytes] = {}
        self.older_words: dict[str, bytes] = {}
        # The byte-level alphabet: printable Latin-1 bytes stand for themselves, the others for letters from U+0100 on.
        printable = [*range(33, 127), *range(161, 173), *range(174, 256)]
        others = [b for b in range(256) if b not in printable]
        self.alphabet = {b: chr(256 + i) for i, b in enumerate(others)}

    def _ids(self, text: str) -> bytes:
        ids = self.tokenizer.encode(text, add_special_tokens=False).ids
        return struct.pack(f"<{len(ids)}H", *ids)

    def _word(self, word: str) -> bytes:
        """Ids of small Latin letters only: one piece for the model, written in its byte alphabet."""
        ids = self.words.get(word)
        if ids is None:
            ids = self.older_words.get(word)
            if len(self.words) > CACHE_WORDS:
                self.words, self.older_words = {}, self.words
            if ids is not None:
                self.words[word] = ids
        if ids is None:
            piece = word if word.isascii() else word.encode().decode("latin-1").translate(self.alphabet)
            found = [t.id for t in self.model.tokenize(piece)]
            ids = self.words[word] = struct.pack(f"<{len(found)}H", *found)
        return ids

    def _mark(self, mark: str) -> bytes:
        ids = self.words.get(mark)
        if ids is None:
            ids = self.words[mark] = self._ids(mark)
        return ids

    def __missing__(self, chunk: bytes) -> bytes:
        ids = self.older.get(chunk)
        if ids is None:
            ids = self._tokenise(chunk)
        if len(self) > CACHE_CHUNKS:
            self.older = dict(self)
            self.clear()
        self[chunk] = ids
        return ids

    def _tokenise(self, chunk: bytes) -> bytes:
        text = chunk.decode("utf-8", "replace")
        # Latin letters up to U+024F but for U+0130 keep their number when normalised and lower-cased.
        m = self.plain.fullmatch(text.lower()) if "<|" not in text and (text.isascii() or (max(text) < "\u0250" and "\u0130" not in text)) else None
        if m and m[1].isalpha():
            ids = self._word(m[1]) + (self._mark(m[2]) if m[2] else b"")
        else:
            ids = self._ids(text)
        return ids

    def encode(self, text: bytes) -> bytes:
        """Ids of a whole text in UTF-8."""
        return b"".join(map(self.__getitem__, text.split()))


_ENCODERS: dict[str, ChunkEncoder] = {}


def encoder(path: str) -> ChunkEncoder:
    """The encoder of this worker process; it serves all tasks that run here."""
    import os

    os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
    if path not in _ENCODERS:
        _ENCODERS[path] = ChunkEncoder(path)
    return _ENCODERS[path]
