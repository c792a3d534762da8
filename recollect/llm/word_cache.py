"""A bounded memory of what a worker has computed for words."""

from __future__ import annotations

from collections.abc import Callable, Iterable

KEPT_WORDS = 200_000
KEPT_LENGTH = 64


class WordCache:
    """Values of words by ``compute`` (a list of words to a list of values), in two generations.

    A generation ends once it holds ``kept`` words of up to ``KEPT_LENGTH`` characters; words met again go
    from the last one to the present one, so frequent words stay. What one call needs is held besides.
    """

    def __init__(self, compute: Callable[[list[str]], list], kept: int = KEPT_WORDS):
        self.compute, self.kept = compute, kept
        self.present: dict = {}
        self.last: dict = {}

    def of(self, words: Iterable[list[str]]) -> dict:
        """A mapping that has every word of these lists."""
        if len(self.present) >= self.kept:
            self.last, self.present = self.present, {}
        known = self.present
        new = set().union(*words).difference(known)
        again = new & self.last.keys()
        known.update(zip(again, map(self.last.__getitem__, again)))
        new = list(new - again)
        known.update(zip(new, self.compute(new)))
        if any(map(KEPT_LENGTH.__lt__, map(len, new))):
            self.present = {word: value for word, value in known.items() if len(word) <= KEPT_LENGTH}
        return known
