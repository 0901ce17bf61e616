"""Token ids of a public byte-level word BPE, with every distinct word encoded once per worker."""

from __future__ import annotations

import re
import unicodedata
from itertools import chain

#: Texts with other characters than these go to the tokenizer whole: its idea of letters, numbers and blanks then counts.
UNUSUAL = re.compile(r"[^\t\n\x0b\x0c\r\x20-\x7e\xa1-\xb1\xb4-\xb8\xba\xbb\xbf-ɏ‐-‧€]|<\|")
#: The vocabulary's pieces, for texts without unusual characters; matches never span a blank.
PIECES = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[^\W\d_]+|\d|(?:[^\s\w]|_)+")
MAX_CACHED = 1_000_000

_loaded: dict[str, WordTokenizer] = {}


class WordTokenizer:
    """encode(text) gives the ids of tokenizers' encode(text, add_special_tokens=False)."""

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        self.whole = Tokenizer.from_file(path)
        self.model, self.known = self.whole.model, {}
        printable = {b: chr(b) for b in (*range(33, 127), *range(161, 173), *range(174, 256))}
        rest = iter(range(256, 512))
        self.byte_chars = {b: printable.get(b) or chr(next(rest)) for b in range(256)}

    @classmethod
    def load(cls, path: str) -> WordTokenizer:
        """One tokenizer per worker process; it outlives the task."""
        if path not in _loaded:
            _loaded[path] = cls(path)
        return _loaded[path]

    def _piece(self, word: str) -> list[int]:
        if len(self.known) >= MAX_CACHED:
            self.known.clear()
        mapped = word if word.isascii() else word.encode().decode("latin-1").translate(self.byte_chars)
        ids = self.known[word] = [t.id for t in self.model.tokenize(mapped)]
        return ids

    def encode(self, text: str) -> list[int]:
        if UNUSUAL.search(text):
            return self.whole.encode(text, add_special_tokens=False).ids
        known, words = self.known, PIECES.findall(unicodedata.normalize("NFC", text).lower())
        for w in set(words).difference(known):
            self._piece(w)
        try:
            return list(chain.from_iterable(map(known.__getitem__, words)))
        except KeyError:  # the cache was emptied meanwhile
            return list(chain.from_iterable(known[w] if w in known else self._piece(w) for w in words))
