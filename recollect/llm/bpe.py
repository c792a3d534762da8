"""Encoding and decoding by byte-pair merges of a public word-level vocabulary.

A word's merges work on a contiguous array: the boundaries of its parts, and beside each part the rank of
the merge with the next one. The least rank is found by a scan, the boundary between those two parts goes,
and the ranks on both sides are looked up anew. Words over ``LONG`` characters take a heap of the same
ranks, as repeated scans would cost the square of their length.
"""

from __future__ import annotations

import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.llm.common import sliced, text_or_empty
from recollect.llm.word_cache import KEPT_LENGTH, KEPT_WORDS, WordCache

NONE = 1 << 30
LONG = 200
#: White space as the vocabulary's patterns mean it.
WHITE = "\t-\r \x85\xa0  -     　"


def byte_letters() -> list[str]:
    """The letter that stands for each byte: itself if it prints, else the next free one from U+0100."""
    prints = {*range(33, 127), *range(161, 173), *range(174, 256)}
    free = iter(range(256, 512))
    return [chr(b if b in prints else next(free)) for b in range(256)]


class WordBpe:
    """The tokenizer of a vocabulary file whose words end in a suffix."""

    def __init__(self, path: str):
        import regex

        with open(path, encoding="utf-8") as file:
            spec = json.load(file)
        model = spec["model"]
        self.ids: dict[str, int] = model["vocab"]
        self.ranks = {tuple(pair): rank for rank, pair in enumerate(model["merges"])}
        self.suffix: str = model["end_of_word_suffix"]
        self.special = {x["content"]: x["id"] for x in spec["added_tokens"]}
        self.tokens = {i: token for token, i in [*self.ids.items(), *self.special.items()]}
        self.specials = regex.compile("(" + "|".join(map(regex.escape, sorted(self.special, key=len, reverse=True))) + ")")
        pattern = spec["pre_tokenizer"]["pretokenizers"][0]["pattern"]["Regex"].replace(r"[^\s", f"[^{WHITE}")
        self.pattern = regex.compile(pattern)
        self.letters = byte_letters()
        self.words: dict[str, tuple[int, ...]] = {}
        self.known = WordCache(self._chunks)

    def merged(self, word: str) -> tuple[int, ...]:
        """Ids of one word, given as the letters of its bytes."""
        text = word + self.suffix
        bounds = [*range(len(word)), len(text)]
        if len(word) > LONG:
            bounds = self._by_heap(text, bounds)
        else:
            get, last = self.ranks.get, len(text)
            ranks = [get(pair, NONE) for pair in zip(word[:-2], word[1:-1])]
            if len(word) > 1:
                ranks.append(get((word[-2], word[-1] + self.suffix), NONE))
            ranks.append(NONE)  # the last part has no next one
            while (least := min(ranks)) != NONE:
                i = ranks.index(least)
                del bounds[i + 1], ranks[i + 1]
                a, b = bounds[i], bounds[i + 1]
                part = text[a:b]
                ranks[i] = get((part, text[b : bounds[i + 2]]), NONE) if b != last else NONE
                if i:
                    ranks[i - 1] = get((text[bounds[i - 1] : a], part), NONE)
        ids = self.ids
        return tuple([ids[text[a:b]] for a, b in zip(bounds, bounds[1:])])

    def _by_heap(self, text: str, bounds: list[int]) -> list[int]:
        after = dict(zip(bounds, bounds[1:]))
        before = dict(zip(bounds[1:], bounds))
        end = bounds[-1]
        heap: list[tuple[int, int, int, int]] = []

        def push(a: int) -> None:
            b = after.get(a, end)
            if b != end and (found := self.ranks.get((text[a:b], text[b : after[b]]))) is not None:
                heapq.heappush(heap, (found, a, b, after[b]))

        for a in bounds[:-2]:
            push(a)
        while heap:
            _, a, b, c = heapq.heappop(heap)
            if after.get(a) != b or after.get(b) != c:
                continue
            after[a], before[c] = c, a
            del after[b], before[b]
            push(a)
            if a in before:
                push(before[a])
        out = [0]
        while out[-1] != end:
            out.append(after[out[-1]])
        return out

    def chunk(self, text: str) -> list[int]:
        """Ids of a text between spaces."""
        ids: list[int] = []
        for part in self.specials.split(text) if "<|" in text else (text,):
            if part in self.special:
                ids.append(self.special[part])
                continue
            if not part.isascii():
                part = unicodedata.normalize("NFC", part)
            part = part.lower() if "Σ" not in part else "".join(c.lower() for c in part)
            for word in (part,) if part.isalpha() else self.pattern.findall(part):
                found = self.words.get(word)
                if found is None:
                    found = self.merged(word if word.isascii() and word.isprintable() else "".join([self.letters[b] for b in word.encode()]))
                    if len(word) <= KEPT_LENGTH:
                        if len(self.words) >= KEPT_WORDS:
                            self.words.clear()
                        self.words[word] = found
                ids += found
        return ids

    def encode(self, text: str) -> list[int]:
        """Ids of a whole text. No part of the vocabulary's patterns spans a space."""
        return [i for part in text.split(" ") for i in self.chunk(part)]

    def decode(self, ids: list[int]) -> str:
        """The tokens of the ids, special ones too, joined by spaces: the file names no other decoder."""
        return " ".join(self.tokens[i] for i in ids)

    def _chunks(self, parts: list[str]) -> list[tuple[str, str]]:
        return [("".join([f" {i}" for i in ids]), "".join([" " + self.tokens[i] for i in ids])) for ids in map(self.chunk, parts)]

    def both(self, texts: list[str]) -> list[tuple[int, str, str]]:
        """For each text its number of ids, the ids in decimal joined by spaces, and what they decode to."""
        parts = [text.replace("\n", " ").split(" ") for text in texts]
        known = self.known.of(parts)
        out = []
        for words in parts:
            found = [known[word] for word in words]
            ids = "".join([x for x, _ in found])
            out.append((ids.count(" "), ids[1:], "".join([x for _, x in found])[1:]))
        return out


_open: dict[str, WordBpe] = {}


def word_bpe(path: str) -> WordBpe:
    """The worker's tokenizer for this file."""
    if path not in _open:
        _open[path] = WordBpe(path)
    return _open[path]


def _coder(path: str, digests: bool) -> Callable:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from hashlib import sha256

        bpe = word_bpe(path)
        for batch in batches:
            found = bpe.both(batch.column("text").to_pylist())
            columns = {"doc_id": batch.column("doc_id"), "n_tokens": pa.array([n for n, _, _ in found], pa.int64())}
            if digests:
                columns["ids_sha256"] = pa.array([sha256(ids.encode()).hexdigest() for _, ids, _ in found], pa.string())
                columns["decoded_sha256"] = pa.array([sha256(d.encode()).hexdigest() for _, _, d in found], pa.string())
            else:
                columns["ids"] = pa.array([[int(i) for i in ids.split()] for _, ids, _ in found], pa.list_(pa.int32()))
                columns["decoded"] = pa.array([d for _, _, d in found], pa.string())
            yield pa.RecordBatch.from_pydict(columns)

    return code


def encode_decode(docs: DataFrame, path: str, digests: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids and the decoded text for each row of ``docs`` (doc_id, text).

    With ``digests``, ids_sha256 and decoded_sha256 stand for ids and text, computed beside them. A null or
    empty text has no ids and decodes to an empty text. Each row has its own result, also where a doc_id is
    null or repeated; an empty table gives no rows; other columns are left alone. No shuffle.
    """
    texts = docs.select(F.col("doc_id").cast("long"), text_or_empty().alias("text"))
    schema = "ids_sha256 string, decoded_sha256 string" if digests else "ids array<int>, decoded string"
    return texts.mapInArrow(sliced(_coder(path, digests)), f"doc_id long, n_tokens long, {schema}")
