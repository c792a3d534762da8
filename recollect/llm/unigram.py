"""Counts of unigram-model tokens by a count-only Viterbi pass.

The model is a list of pieces with scores. A text's spaces become ``▁``, one stands before the text if it
doesn't start with one, and each ``▁`` starts a word; no piece is matched over the start of a word. Within
a word an Aho-Corasick automaton enumerates every piece that ends at each character, and a dynamic
programme carries the best score and that path's number of pieces, never the path.

Tie rules, as those of the public tokenizers library: of equal scores at an end, the piece that starts
first stands; a character that no piece of its own matches may count as unknown with the least score less
10, which loses ties; an unknown character falls back to as many pieces as it has UTF-8 bytes.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import sliced, text_or_empty
from recollect.llm.word_cache import WordCache

SPACE = "▁"
UNKNOWN_PENALTY = 10.0


@cache
def read_pieces(path: str) -> tuple[tuple[str, float], ...]:
    """The pieces of a sentencepiece model file and their scores, in order of their ids."""
    from sentencepiece import SentencePieceProcessor

    model = SentencePieceProcessor(model_file=path)
    return tuple((model.id_to_piece(i), model.get_score(i)) for i in range(model.get_piece_size()))


class UnigramCounter:
    """Best score and piece count of words; words met are remembered."""

    def __init__(self, pieces: tuple[tuple[str, float], ...]):
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        for piece, score in pieces:
            self.automaton.add_word(piece, (len(piece), score))
        self.automaton.make_automaton()
        self.unknown = min(score for _, score in pieces) - UNKNOWN_PENALTY
        self.known = WordCache(self._words)

    def word(self, text: str) -> tuple[int, float]:
        """Pieces and score of one word, which starts with the space mark."""
        n = len(text)
        best, count, alone = [None] * (n + 1), [0] * (n + 1), [False] * n
        best[0] = 0.0
        done = 0  # ends up to here are settled

        def settle(upto: int) -> None:
            nonlocal done
            while done < upto:
                if not alone[done]:
                    score = best[done] + self.unknown
                    if best[done + 1] is None or score > best[done + 1]:
                        best[done + 1], count[done + 1] = score, count[done] + len(text[done].encode())
                done += 1

        for end, (length, score) in self.automaton.iter(text):
            settle(end)
            start = end + 1 - length
            if length == 1:
                alone[end] = True
            score += best[start]
            if best[end + 1] is None or score > best[end + 1]:
                best[end + 1], count[end + 1] = score, count[start] + 1
        settle(n)
        return count[n], best[n]

    def texts(self, texts: list[str]) -> list[tuple[int, float]]:
        """Pieces and score of each text; none and 0 where it is empty."""
        parts = [self.split(text) for text in texts]
        known = self.known.of(parts)
        found = [[known[word] for word in words] for words in parts]
        return [(sum([n for n, _ in x]), math.fsum([score for _, score in x])) for x in found]

    @staticmethod
    def split(text: str) -> list[str]:
        """A text's words, without their marks."""
        if not text:
            return []
        return (text[1:] if text[0] in (" ", SPACE) else text).split(" ")

    def _words(self, words: list[str]) -> list[tuple[int, float]]:
        return [self.word(SPACE + word) if SPACE not in word else self.marked(word) for word in words]

    def marked(self, word: str) -> tuple[int, float]:
        """A word that holds the space mark itself: each mark starts a word."""
        found = [self.word(SPACE + part) for part in word.split(SPACE)]
        return sum(n for n, _ in found), sum(score for _, score in found)


_open: dict[int, UnigramCounter] = {}


def unigram_counter(path: str) -> UnigramCounter:
    if path not in _open:
        _open[path] = UnigramCounter(read_pieces(path))
    return _open[path]


def _counter(path: str) -> Callable:
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counter = unigram_counter(path)
        for batch in batches:
            found = counter.texts(batch.column("text").to_pylist())
            yield pa.RecordBatch.from_pydict(
                {
                    "doc_id": batch.column("doc_id"),
                    "n_tokens": pa.array([n for n, _ in found], pa.int64()),
                    "score": pa.array([score for _, score in found], pa.float64()),
                }
            )

    return count


def count_tokens(docs: DataFrame, model: str) -> DataFrame:
    """doc_id, n_tokens and score (that of the best segmentation) for each row of ``docs`` (doc_id, text).

    A null or empty text has 0 tokens and score 0. Each row has its own result, also where a doc_id is
    null or repeated; an empty table gives no rows; other columns are left alone. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    return texts.mapInArrow(sliced(_counter(model)), "doc_id long, n_tokens long, score double")
