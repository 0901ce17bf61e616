"""Word pieces of one text; the operator around them is answers.word_pieces()."""

from __future__ import annotations

import re
import unicodedata

_PIECES = re.compile(r"[^\W_]+|[^\w\s]|_")


def split_words(text: str) -> list[str]:
    """Lower-case words without accents, and punctuation marks one by one."""
    bare = "".join(c for c in unicodedata.normalize("NFD", text.lower()) if unicodedata.category(c) != "Mn")
    return _PIECES.findall(bare)


def cut_word(word: str, vocabulary: dict[str, int], unknown: str, longest: int) -> list[int]:
    """The ids of the longest pieces from left to right, or of `unknown` where some part has none."""
    ids, at = [], 0
    while at < len(word) <= longest:
        end = next((e for e in range(len(word), at, -1) if ("##" if at else "") + word[at:e] in vocabulary), None)
        if end is None:
            break
        ids.append(vocabulary[("##" if at else "") + word[at:end]])
        at = end
    return ids if at == len(word) else [vocabulary[unknown]]
