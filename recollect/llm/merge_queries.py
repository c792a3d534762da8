"""Byte-level BPE by recursive queries of an in-memory DuckDB, one in each Python worker.

A word's bytes are rows of (word, position, token). A recursive query joins neighbours with the merge table and
contracts each word's leftmost pair of least rank, for all words at once, until no pair is left; ordered
aggregation gives the ids and the bytes that they stand for.

A long word takes a query that contracts a pair wherever no pair of lower rank stands within reach, in rounds of few
steps, so that a word of n bytes takes far fewer than n steps and little memory. That gives the same tokens if
each token of the vocabulary is what its own bytes encode to: then a merge only makes pairs of higher rank,
and a pair is disturbed only through pairs of lower rank that stand no farther off than the longest token is
long. This is tested the first time that a long word comes; a vocabulary that fails takes one pair at a time.
"""

from __future__ import annotations

import base64
import duckdb
import numpy as np
import pyarrow as pa

from recollect.llm.word_cache import WordCache
from recollect.llm.word_ids import lines_of

LONG = 256
CALL_WORDS = 16_384
KEPT_WORDS = 300_000
STEPS = 16
ROUND_ROWS = 2_000_000
MEMORY = "600MB"
#: Fixed value: white space as the pattern means it, where Python's own differs.
WHITE = r"\t-\r \x85\xa0  -     　"

EACH_WORD = """
    WITH RECURSIVE pairs(step, word, pos, lower, upper, merged) AS (
        SELECT 0, word, pos, lower, upper, merged FROM start LEFT JOIN merges USING (lower, upper)
        UNION ALL (
            WITH least AS (
                SELECT word, min((merged::BIGINT << 32) | pos) AS found FROM pairs WHERE merged IS NOT NULL AND step < $steps GROUP BY word
            ), cut AS (
                SELECT word, (found & 4294967295)::INTEGER AS place, (found >> 32)::INTEGER AS made FROM least
            ), moved AS (
                SELECT step + 1 AS step, p.word, CASE WHEN pos > place THEN pos - 1 ELSE pos END AS pos,
                    CASE WHEN pos = place + 1 THEN made ELSE lower END AS lower, CASE WHEN pos = place - 1 THEN made ELSE upper END AS upper
                FROM pairs p JOIN cut ON cut.word = p.word WHERE pos <> place
            )
            SELECT step, word, pos, moved.lower, moved.upper, merged FROM moved LEFT JOIN merges m ON m.lower = moved.lower AND m.upper = moved.upper
        )
    ), kept AS (
        SELECT word, pos, lower, upper FROM pairs JOIN (SELECT word, max(step) AS step FROM pairs GROUP BY word) USING (word, step)
    ), parts AS (
        SELECT word, pos + 1 AS pos, upper AS token FROM kept UNION ALL SELECT word, 0, lower FROM kept WHERE pos = 0
    )
"""
EACH_REACH = """
    WITH RECURSIVE parts(step, word, pos, token) AS (
        SELECT 0, word, pos, token FROM start
        UNION ALL (
            WITH pairs AS (
                SELECT *, lead(token) OVER (PARTITION BY word ORDER BY pos) AS following FROM parts WHERE step < $steps
            ), ranked AS (
                SELECT pairs.*, merged FROM pairs LEFT JOIN merges ON lower = token AND upper = following
            ), near AS (
                SELECT *, merged = min(merged) OVER (PARTITION BY word ORDER BY pos ROWS BETWEEN $reach PRECEDING AND $reach FOLLOWING) AS due,
                    merged IS DISTINCT FROM lag(merged) OVER (PARTITION BY word ORDER BY pos) AS opens
                FROM ranked
            ), runs AS (
                SELECT *, sum(opens::INTEGER) OVER (PARTITION BY word ORDER BY pos ROWS UNBOUNDED PRECEDING) AS run FROM near
            ), chosen AS (
                SELECT *, coalesce(due AND first_value(due) OVER same AND row_number() OVER same % 2 = 1, false) AS joins
                FROM runs WINDOW same AS (PARTITION BY word, run ORDER BY pos)
            ), told AS (
                SELECT *, coalesce(lag(joins) OVER (PARTITION BY word ORDER BY pos), false) AS gone, bool_or(joins) OVER (PARTITION BY word) AS goes_on FROM chosen
            )
            SELECT step + 1, word, pos, CASE WHEN joins THEN merged ELSE token END FROM told WHERE goes_on AND NOT gone
        )
    )
"""
LAST = "SELECT word, pos, token, step FROM parts JOIN (SELECT word, max(step) AS step FROM parts GROUP BY word) USING (word, step)"
IDS = "SELECT word, token FROM merged ORDER BY word, pos"
DECODED = "SELECT string_agg(spelt, '' ORDER BY word, pos) FROM merged JOIN tokens USING (token)"

Coded = tuple[bytes, bytes]  # ids, 4 bytes each, little-endian; the bytes that they decode to


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as file:
        return {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, filter(bytes.strip, file))}


class MergeQueries:
    """The coder of a rank file and a pattern; ``both`` gives ids and decoded bytes of texts."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.ranks = ranks = read_ranks(path)
        self.split = regex.compile(pattern.replace(r"[^\s", f"[^{WHITE}").replace(r"\s", f"[{WHITE}]").replace(r"\S", f"[^{WHITE}]")).findall
        self.single = np.array([ranks[bytes([b])] for b in range(256)], "i4")
        self.base = duckdb.connect(":memory:", config={"threads": 1, "memory_limit": MEMORY, "temp_directory": ""})
        merges = [(ranks[t[:i]], ranks[t[i:]], rank) for t, rank in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks]
        lower, upper, merged = np.array(merges, "i4").reshape(-1, 3).T
        self._table("merges", lower=lower, upper=upper, merged=merged)
        self._table("tokens", token=np.array(list(ranks.values()), "i4"), spelt=[token.hex() for token in ranks])
        self.spelt_length = np.zeros(max(ranks.values()) + 1, "i8")
        self.spelt_length[list(ranks.values())] = list(map(len, ranks))
        self.sound: bool | None = None
        self.words = WordCache(self._encode_words)
        self.heads = WordCache(self._pieces)
        self.spaced = WordCache(lambda words: self._pieces([" " + word for word in words]), KEPT_WORDS)
        self.line_break = self._pieces(["\n"])[0]

    def _table(self, name: str, **columns) -> None:
        self.base.register("given", pa.table({k: pa.array(v) for k, v in columns.items()}))
        self.base.execute(f"CREATE OR REPLACE TEMP TABLE {name} AS SELECT * FROM given")
        self.base.unregister("given")

    def _start(self, words: list[bytes], pairs: bool) -> None:
        """The words' bytes as rows, or their pairs of neighbours."""
        lengths = np.array(list(map(len, words)))
        word = np.repeat(np.arange(len(words), dtype="i4"), lengths)
        pos = (np.arange(len(word)) - np.repeat(np.cumsum(lengths) - lengths, lengths)).astype("i4")
        token = self.single[np.frombuffer(b"".join(words), "u1")]
        if pairs:
            inside = np.flatnonzero(word[1:] == word[:-1])
            self._table("start", word=word[inside], pos=pos[inside], lower=token[inside], upper=token[inside + 1])
        else:
            self._table("start", word=word, pos=pos, token=token)

    def _merged(self, query: str) -> list[Coded]:
        """What the table ``merged`` (word, pos, token) that ``query`` makes says of each word, in order."""
        self.base.execute("CREATE OR REPLACE TEMP TABLE merged AS " + query)
        ids = self.base.execute(IDS).fetchnumpy()
        word, token = ids["word"], ids["token"].astype("<u4")
        ends = np.append(np.flatnonzero(np.diff(word)) + 1, len(word))
        data, decoded = token.tobytes(), bytes.fromhex(self.base.execute(DECODED).fetchall()[0][0])  # all words in one
        spelt = np.append(0, np.cumsum(self.spelt_length[token]))[ends].tolist()
        ends = (ends * 4).tolist()
        return [(data[a:b], decoded[c:d]) for a, b, c, d in zip([0, *ends], ends, [0, *spelt], spelt)]

    def _short(self, words: list[bytes]) -> list[Coded]:
        """Words of more than a byte."""
        out: list[Coded] = []
        for low in range(0, len(words), CALL_WORDS):
            self._start(words[low : low + CALL_WORDS], pairs=True)
            out += self._merged(EACH_WORD.replace("$steps", str(LONG)) + "SELECT * FROM parts")
        return out

    def is_sound(self) -> bool:
        """Whether each token is what its own bytes encode to."""
        if self.sound is None:
            tokens = [token for token in self.ranks if len(token) > 1]
            self.sound = all(len(ids) == 8 for ids, _ in self._short(tokens))  # the pair before the last merge
        return self.sound

    def _one_long(self, word: bytes) -> Coded:
        letters = set(word)
        reach = max(len(token) for token in self.ranks if letters.issuperset(token)) if self.is_sound() else len(word)
        query = EACH_REACH.replace("$reach", str(reach))
        self._start([word], pairs=False)
        steps = left = max(1, min(STEPS, ROUND_ROWS // len(word)))
        while left == steps:
            self.base.execute("CREATE OR REPLACE TEMP TABLE after AS " + query.replace("$steps", str(steps)) + LAST)
            left = self.base.execute("SELECT max(step) FROM after").fetchall()[0][0]
            self.base.execute("CREATE OR REPLACE TEMP TABLE start AS SELECT word, pos, token FROM after")
        return self._merged("SELECT * FROM start")[0]

    def _encode_words(self, words: list[bytes]) -> list[Coded]:
        """A word that is a token is never merged."""
        out, left = {}, []
        for word in words:
            rank = self.ranks.get(word)
            if rank is not None:
                out[word] = (rank.to_bytes(4, "little"), word)
            elif len(word) > LONG:
                out[word] = self._one_long(word)
            else:
                left.append(word)
        out.update(zip(left, self._short(left), strict=True))
        return [out[word] for word in words]

    def _pieces(self, pieces: list[str]) -> list[Coded]:
        split = self.split
        words = [[x.encode()] if x.isascii() and x.removeprefix(" ").isalpha() else [w.encode() for w in split(x)] for x in pieces]
        known = self.words.of(words)
        found = [[known[word] for word in some] for some in words]
        return [some[0] if len(some) == 1 else (b"".join([x for x, _ in some]), b"".join([x for _, x in some])) for some in found]

    def both(self, texts: list[str]) -> list[Coded]:
        """Ids and decoded bytes of each text: those of its pieces, in order."""
        parts = [lines_of(text) for text in texts]
        firsts = [[words.pop(0) for words in lines] for lines in parts]
        heads = self.heads.of(firsts)
        known = self.spaced.of([words for lines in parts for words in lines])
        out = []
        for first_words, lines in zip(firsts, parts):
            found = []
            for first, words in zip(first_words, lines):
                found += (self.line_break, heads[first], *map(known.__getitem__, words))
            del found[0]  # before the first line
            out.append((b"".join([x for x, _ in found]), b"".join([x for _, x in found])))
        return out


_open: dict[tuple[str, str], MergeQueries] = {}


def merge_queries(path: str, pattern: str) -> MergeQueries:
    """The worker's coder for this rank file and pattern."""
    if (path, pattern) not in _open:
        _open[path, pattern] = MergeQueries(path, pattern)
    return _open[path, pattern]
