"""Batches of texts scanned as arrays of bytes and code points: which hold given pieces, and how often given terms."""

from __future__ import annotations

import functools
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

from recollect.functions.text import folds

#: Bytes of texts that are scanned at once.
CHUNK = 1 << 18
#: Places of a needle among which its anchor is chosen, and pairs of places and needles that are tested at once.
PLACES, PAIRS = 8, 100_000
_ODD = np.uint64(0x9E3779B97F4A7C15)
_BASE = 0xD1342543DE82EF95
SIGMA = 0x3A3
WHITE = (b" ", b"\n")


def _bytes_of(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(offsets, data) of a column of texts; text ``i`` is ``data[offsets[i]:offsets[i + 1]]``."""
    texts = texts.cast(pa.large_binary())
    _, offsets, data = texts.buffers()
    if not len(texts) or data is None:
        return np.zeros(len(texts) + 1, "i8"), np.zeros(0, "u1")
    return np.frombuffer(offsets, "i8")[texts.offset : texts.offset + len(texts) + 1], np.frombuffer(data, "u1")


class _Sieve:
    """Sorted 64-bit codes behind a table that most other codes don't pass."""

    def __init__(self, codes: np.ndarray):
        self.order = np.argsort(codes, kind="stable")
        self.codes = codes[self.order]
        bits = min(24, max(16, len(codes).bit_length() + 5))
        self.shift = np.uint64(64 - bits)
        self.table = np.zeros(1 << bits, bool)
        self.table[(codes * _ODD) >> self.shift] = True

    def met(self, codes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(places, first, last): which of ``codes`` are here, and as which range of ``order``."""
        at = np.flatnonzero(self.table[(codes * _ODD) >> self.shift])
        first, last = np.searchsorted(self.codes, codes[at]), np.searchsorted(self.codes, codes[at], "right")
        some = last > first
        return at[some], first[some], last[some]


def _windows(data: np.ndarray, low: int, high: int) -> np.ndarray:
    """The eight bytes from each of the places ``low`` to ``high + 8`` as a number; zeros follow the data."""
    part = np.zeros((high - low + 31) // 8 * 8, "u1")
    got = data[low : high + 16]
    part[: len(got)] = got
    out = np.empty(len(part) - 8, "u8")
    for shift in range(8):
        out[shift::8] = np.frombuffer(part, "<u8", (len(part) - 8) // 8, shift)
    return out[: high - low + 8]


def _codes(windows: np.ndarray, width: int) -> np.ndarray:
    """Of each place its first ``width`` bytes, at 16 mixed into 64 bits."""
    if width == 16:
        return windows[:-8] * np.uint64(_BASE) + windows[8:]
    return windows[:-8] & np.uint64((1 << 8 * width) - 1)


class Needles:
    """Different pieces of text, told by an anchor each: 16 bytes, or the greatest power of two that they have.

    Of a few places in a needle its anchor is the one that the fewest needles share, then one of many different bytes.
    """

    def __init__(self, ids: pa.Array, texts: list[bytes]):
        self.ids, self.texts = ids, texts
        self.length = np.array([len(t) for t in texts], "i8")
        self.head = np.array([int.from_bytes(t[:8], "little") for t in texts], "u8")
        self.tail = np.array([int.from_bytes(t[-8:], "little") for t in texts], "u8")
        self.offset = np.zeros(len(texts), "i8")
        self.classes: list[tuple[int, np.ndarray, _Sieve]] = []
        width = np.minimum(16, 1 << (np.frexp(self.length)[1] - 1))
        for w in np.unique(width).tolist():
            of = np.flatnonzero(width == w)
            places = [sorted({(len(texts[j]) - w) * i // (PLACES - 1) for i in range(PLACES)}) for j in of.tolist()]
            parts = [[texts[j][p : p + w] for p in own] for j, own in zip(of.tolist(), places)]
            shared: dict[bytes, int] = {}
            for own in parts:
                for part in set(own):
                    shared[part] = shared.get(part, 0) + 1
            best = [min(range(len(own)), key=lambda i: (shared[own[i]], -len(set(own[i])))) for own in parts]
            self.offset[of] = [own[i] for own, i in zip(places, best)]
            anchors = np.frombuffer(b"".join(own[i].ljust(16, b"\0") for own, i in zip(parts, best)), "<u8").reshape(-1, 2)
            codes = anchors[:, 0] * np.uint64(_BASE) + anchors[:, 1] if w == 16 else anchors[:, 0].copy()
            self.classes.append((w, of, _Sieve(codes)))

    def _eight(self, data: np.ndarray, at: np.ndarray) -> np.ndarray:
        return data[np.clip(at[:, None] + np.arange(8), 0, len(data) - 1)].view("<u8")[:, 0]

    def within(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """(rows, needles) of the texts that hold a needle, once each."""
        offsets, data = _bytes_of(texts)
        view, n, found = memoryview(data), len(self.texts), set()
        for low in range(int(offsets[0]), int(offsets[-1]), CHUNK):
            windows = _windows(data, low, min(low + CHUNK, int(offsets[-1])))
            for width, of, sieve in self.classes:
                at, first, last = sieve.met(_codes(windows, width))
                upto = np.cumsum(last - first)
                for begin in range(0, int(upto[-1]) if len(upto) else 0, PAIRS):
                    pair = np.arange(begin, min(begin + PAIRS, int(upto[-1])))
                    hit = np.searchsorted(upto, pair, "right")
                    j = of[sieve.order[last[hit] - (upto[hit] - pair)]]
                    place = at[hit] + low
                    row = np.searchsorted(offsets, place, "right") - 1
                    start, length = place - self.offset[j], self.length[j]
                    inside = (start >= offsets[row]) & (start + length <= offsets[row + 1])
                    row, j, start, length = row[inside], j[inside], start[inside], length[inside]
                    mask = np.uint64(0xFFFFFFFFFFFFFFFF) >> (8 * (8 - np.minimum(length, 8))).astype("u8")
                    same = ((self._eight(data, start) & mask) == self.head[j]) & ((length < 8) | (self._eight(data, start + length - 8) == self.tail[j]))
                    whole = same & (length <= 16)  # head and tail are all of it
                    found.update(np.unique(row[whole] * n + j[whole]).tolist())
                    for key, r, i, s in zip(*(x[same & ~whole].tolist() for x in (row * n + j, row, j, start))):
                        if key not in found and view[s : s + len(self.texts[i])] == self.texts[i]:
                            found.add(key)
        keys = np.array(sorted(found), "i8")
        return keys // n, keys % n


@functools.cache
def _tables() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of each code point: 1 for letters, 2 for digits, else 0; what it folds to; a random number of what it folds to."""
    kind, to = np.zeros(0x110000, "u1"), np.arange(0x110000, dtype="u4")
    fold = str.maketrans(*folds())
    for c in range(0x40000):  # no letters are beyond
        char = chr(c)
        kind[c] = {"L": 1, "N": 2}.get(unicodedata.category(char)[0], 0)
        lower = char.translate(fold).lower()
        to[c] = ord(lower) if len(lower) == 1 else c
    return kind, to, np.random.default_rng(1).integers(0, 1 << 64, 0x110000, "u8")[to]


@functools.lru_cache(3)
def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    up, down = np.full(n, _BASE, "u8"), np.full(n, pow(_BASE, -1, 1 << 64), "u8")
    up[0] = down[0] = 1
    return np.multiply.accumulate(up), np.multiply.accumulate(down)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), "<u4")


class Terms:
    """Different index tokens (see ``functions.text.analyze``) that are counted in texts."""

    def __init__(self, names: pa.Array):
        self.names = names
        to_code = _tables()[2]
        points = [_points(t) for t in names.to_pylist()]
        self.length = np.array([len(p) for p in points], "i8")
        up = _powers(1 << int(self.length.max(initial=1)).bit_length())[0]
        self.sieve = _Sieve(np.array([int((to_code[p] * up[: len(p)]).sum(dtype="u8")) for p in points], "u8"))
        self.of_length = {n: np.stack([points[i] for i in np.flatnonzero(self.length == n)]) for n in np.unique(self.length).tolist()}
        self.row = np.zeros(len(points), "i8")
        for n in self.of_length:
            of = np.flatnonzero(self.length == n)
            self.row[of] = np.arange(len(of))

    def _met(self, points: np.ndarray, starts: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(tokens, places, terms): where every token of texts that start at ``starts`` does, and the places and terms of those that are terms."""
        kind, to, to_code = _tables()
        n, kinds = len(points), kind[points]
        edge = np.ones(n + 1, bool)
        np.not_equal(kinds[1:], kinds[:-1], out=edge[1:-1])
        edge[starts] = True
        at = np.flatnonzero(edge)
        real = kinds[at[:-1]] > 0
        begin, end = at[:-1][real], at[1:][real]
        up, down = _powers(CHUNK if n <= CHUNK else 1 << n.bit_length())
        sums = np.zeros(n + 1, "u8")
        np.cumsum(to_code[points] * up[:n], out=sums[1:])
        hit, first, _ = self.sieve.met((sums[end] - sums[begin]) * down[begin])
        term, place, size = self.sieve.order[first], begin[hit], (end - begin)[hit]
        same = size == self.length[term]
        for length, rows in self.of_length.items():
            own = np.flatnonzero(same & (size == length))
            if len(own):
                same[own] = (to[points[place[own, None] + np.arange(length)]] == rows[self.row[term[own]]]).all(1)
        return begin, place[same], term[same]

    def _of_texts(self, data: bytes, lengths: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(rows of tokens, rows and terms of those that are terms) of texts that lie one after the other in ``data``."""
        try:
            points = _points(data.decode())
        except UnicodeDecodeError:
            points = None
        cuts = np.concatenate([[0], np.cumsum(lengths)])
        if points is None or (len(points) < len(data) and (points == SIGMA).any()):  # how a sigma folds depends on its place
            fold = str.maketrans(*folds())
            texts = [data[a:b].decode("utf-8", "replace") for a, b in zip(cuts.tolist(), cuts[1:].tolist())]
            texts = [t.translate(fold).lower() if chr(SIGMA) in t else t for t in texts]
            points, starts = _points("".join(texts)), np.cumsum([0, *map(len, texts)])[:-1]
        elif len(points) < len(data):
            first = (np.frombuffer(data, "u1") & 0xC0) != 0x80  # of a code point's bytes
            starts = np.concatenate([[0], np.cumsum(first)])[cuts[:-1]]
        else:
            starts = cuts[:-1]
        begin, place, term = self._met(points, starts)
        of = lambda at: rows[np.searchsorted(starts, at, "right") - 1]
        return of(begin), of(place), term

    def counted(self, texts: pa.Array) -> Iterator[tuple[int, int, np.ndarray, pa.Array]]:
        """(first row, row after the last, numbers of tokens, lists of (term, tf)) of runs of texts, at most ``CHUNK`` bytes of them at once."""
        offsets, data = _bytes_of(texts)
        low, n = 0, len(self.names)
        while low < len(texts):
            high = max(low + 1, int(np.searchsorted(offsets, offsets[low] + CHUNK, "right")) - 1)
            rows = np.arange(high - low)
            part = data[offsets[low] : offsets[high]].tobytes()
            pieces = [part] if len(part) <= CHUNK else _pieces(part)
            tokens, keys = np.zeros(high - low, "i8"), []
            for piece in pieces:
                if piece:
                    own, row, term = self._of_texts(piece, np.diff(offsets[low : high + 1]) if piece is part else np.array([len(piece)]), rows)
                    tokens += np.bincount(own, minlength=high - low)
                    keys.append(row * n + term)
            met, tf = np.unique(np.concatenate(keys), return_counts=True) if keys else (np.zeros(0, "i8"), np.zeros(0, "i8"))
            bounds = pa.array(np.searchsorted(met, np.arange(high - low + 1) * n), pa.int32())
            held = pa.StructArray.from_arrays([self.names.take(pa.array(met % max(n, 1))), pa.array(tf, pa.int32())], ["term", "tf"])
            yield low, high, tokens, pa.ListArray.from_arrays(bounds, held)
            low = high


def _pieces(text: bytes) -> Iterator[bytes]:
    """A long text in pieces of at most ``CHUNK`` bytes, or up to the next white space, cut there."""
    low = 0
    while len(text) - low > CHUNK:
        cut = max(text.rfind(c, low + 1, low + CHUNK) for c in WHITE)
        if cut < 0:
            cut = min((at for c in WHITE if (at := text.find(c, low + CHUNK)) > 0), default=len(text))
        yield text[low:cut]
        low = cut
    yield text[low:]


def finder(needles) -> Callable:
    """Of batches (hay, text) those of (needle, hay) where the text holds the needle; ``needles`` is a broadcast of ``Needles``."""

    def find(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows, of = needles.value.within(batch.column("text"))
            yield pa.RecordBatch.from_arrays([needles.value.ids.take(pa.array(of)), batch.column("hay").take(pa.array(rows))], ["needle", "hay"])

    return find


def counter(names) -> Callable:
    """Of batches (text and others) the others, with length (null where the text is) and held, a list of (term, tf); ``names`` is a broadcast array of terms."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        terms = Terms(names.value)
        for batch in batches:
            text, others = batch.column("text"), [c for c in batch.schema.names if c != "text"]
            for low, high, tokens, held in terms.counted(text):
                length = pc.if_else(text.slice(low, high - low).is_valid(), pa.array(tokens, pa.int32()), pa.scalar(None, pa.int32()))
                yield pa.RecordBatch.from_arrays([*(batch.column(c).slice(low, high - low) for c in others), length, held], [*others, "length", "held"])

    return count
