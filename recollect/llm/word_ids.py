"""Token ids of whole texts by the tokenizers library, with each distinct word encoded once a worker.

A byte-level BPE with the usual pattern always ends a token before a single space, and before and after a
single line break, that stands between two characters which are not white space. Texts are cut there, and
only words that a worker hasn't met go to the library. What a text's words give, joined, is what the
library gives for the whole text.
"""

from __future__ import annotations

import os
import re
from array import array

import numpy as np

from recollect.llm.word_cache import WordCache

SPACE = "Ġ"  # the space, as the vocabulary writes it
JOINED = 500
KEPT_WORDS = 300_000

_TOUCHING = re.compile(r"\s\s")
_LINES = re.compile(r"(?<!\s)\n(?!\s)")
_CUT = re.compile(r"(?<!\s) (?!\s)")


def lines_of(text: str) -> list[list[str]]:
    """A text's words by line, cut only where that changes no token."""
    if _TOUCHING.search(text):
        return [_CUT.split(line) for line in _LINES.split(text)]
    return [line.split(" ") for line in text.split("\n")]


class WordIds:
    """Encodes texts to bytes of little-endian ids, 2 bytes each if the vocabulary allows it, else 4."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.kind = "H" if self.tokenizer.get_vocab_size(with_added_tokens=True) <= 1 << 16 else "I"
        self.dtype = {"H": "<u2", "I": "<u4"}[self.kind]
        self.line_break = self._ids(["\n"])[0]
        self.heads = WordCache(self._ids)
        self.words = WordCache(self._spaced, KEPT_WORDS)
        vocabulary = self.tokenizer.get_vocab(with_added_tokens=True)
        self.opens = np.zeros(max(vocabulary.values()) + 1, bool)
        self.opens[[i for token, i in vocabulary.items() if token.startswith(SPACE)]] = True

    def _ids(self, texts: list[str]) -> list[bytes]:
        found = self.tokenizer.encode_batch(texts, add_special_tokens=False)
        return [array(self.kind, x.ids).tobytes() for x in found]

    def _spaced(self, words: list[str]) -> list[bytes]:
        """Ids of words that a space stands before. Many make one text; where a word starts, a token with a space does."""
        whole = [word for word in words if word.split() == [word]]
        out = {}
        for low in range(0, len(whole), JOINED):
            some = whole[low : low + JOINED]
            found = self.tokenizer.encode_batch_fast([" " + " ".join(some)], add_special_tokens=False)[0]
            ids = np.array(found.ids, self.dtype)
            at = np.append(np.flatnonzero(self.opens[ids]), len(ids)) * ids.itemsize
            data = ids.tobytes()
            out.update(zip(some, [data[a:b] for a, b in zip(at.tolist(), at[1:].tolist())], strict=True))
        rest = [word for word in words if word not in out]
        out.update(zip(rest, self._ids([" " + word for word in rest])))
        return [out[word] for word in words]

    def encode(self, texts: list[str]) -> list[bytes]:
        parts = [lines_of(text) for text in texts]
        firsts = [[words.pop(0) for words in lines] for lines in parts]
        heads = self.heads.of(firsts)
        known = self.words.of([words for lines in parts for words in lines])
        join, get = b"".join, known.__getitem__
        return [
            self.line_break.join([heads[first] + join(map(get, words)) for first, words in zip(first_words, lines)])
            for first_words, lines in zip(firsts, parts)
        ]


_open: dict[str, WordIds] = {}


def word_ids(path: str) -> WordIds:
    """The worker's encoder for this tokenizer file."""
    if path not in _open:
        _open[path] = WordIds(path)
    return _open[path]
