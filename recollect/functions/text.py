"""Text rules as column expressions."""

from __future__ import annotations

import unicodedata

from pyspark.sql import Column
from pyspark.sql import functions as F


def folds() -> tuple[str, str]:
    """Accented Latin letters and the letters that they decompose to."""
    pairs = [(chr(c), unicodedata.normalize("NFD", chr(c))[0]) for c in range(0xC0, 0x180)]
    pairs = [(a, b) for a, b in pairs if a != b and b.isascii()]
    return "".join(a for a, _ in pairs), "".join(b for _, b in pairs)


_FROM, _TO = folds()

#: Words that near-duplicate detection leaves out.
STOP_WORDS = (
    "the and for that with this from have was are but not you all can her his she they them were been has had its it's "
    "into than then also just only over such when what which who will would could should about there their your more some very"
).split()
#: Words that query rewriting leaves out.
QUERY_STOP_WORDS = "the and for with from that this what when where which have has was were are about into your our".split()
#: Cues of negation, looked for in the text between two spaces.
NEGATIONS = (
    " not ", "n't", " never ", " no longer ", " cannot ", " can't ", " won't ", " isn't ", " aren't ", " don't ", " doesn't ", " didn't ",
)
#: Cues of lasting facts, for callers and for the rule writer.
FACT_CUES = (
    "prefer", "prefers", "should ", "must ", "always ", "never ", "decision", "decided", "requirement", "constraint", "we use ",
    "use typescript", "use rust",
)
WRITER_CUES = ("prefer", "prefers", "must ", "should ", "decided", "always ", "never ")
#: Summaries that are no more than chatter.
CHATTER = ("ok", "okay", "thanks", "thank you", "lol", "lgtm", "wip", "testing", "hello", "hi ")


def fold(text: Column) -> Column:
    """Lower case without accents. ASCII texts have none: translating costs more than all else."""
    return F.lower(F.when(F.length(text) == F.octet_length(text), text).otherwise(F.translate(text, _FROM, _TO)))


def analyze(text: Column) -> Column:
    """Index tokens: runs of letters and runs of digits, in lower case without accents."""
    return F.regexp_extract_all(fold(text), F.lit(r"[\p{L}]+|[\p{N}]+"), F.lit(0))


def ascii_tokens(text: Column) -> Column:
    """Runs of ASCII letters and digits, in lower case."""
    return F.regexp_extract_all(F.lower(text), F.lit("[a-z0-9]+"), F.lit(0))


def compared(tokens: Column) -> Column:
    """Those that near-duplicate detection compares."""
    return F.filter(tokens, lambda t: (F.length(t) > 2) & ~t.isin(*STOP_WORDS))


def values(tokens: Column) -> Column:
    """Those that hold a digit."""
    return F.filter(tokens, lambda t: t.rlike("[0-9]"))


def similarity_tokens(text: Column) -> Column:
    """The distinct tokens that near-duplicate detection compares."""
    return F.array_distinct(compared(ascii_tokens(text)))


def value_tokens(text: Column) -> Column:
    """The distinct tokens that hold a digit, in order."""
    return F.array_sort(F.array_distinct(values(ascii_tokens(text))))


def contains_any(text: Column, cues) -> Column:
    """Whether a lower-case text holds one of the cues."""
    out = F.lit(False)
    for cue in cues:
        out = out | F.contains(text, F.lit(cue))
    return out


def negates(text: Column) -> Column:
    return contains_any(F.concat(F.lit(" "), F.lower(text), F.lit(" ")), NEGATIONS)


def contradicts(a: Column, b: Column) -> Column:
    """Exactly one side negates, or both hold values and these differ."""
    va, vb = value_tokens(a), value_tokens(b)
    return (negates(a) != negates(b)) | ((F.size(va) > 0) & (F.size(vb) > 0) & (va != vb))


def collapsed(text: Column) -> Column:
    """Lower case with runs of white space as one space: an exact-duplicate identity."""
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def normalised(text: Column) -> Column:
    """Lower-case words between single spaces; everything but letters, digits and white space separates."""
    return F.trim(F.regexp_replace(F.lower(F.regexp_replace(text, r"[^\p{L}\p{N}\s]", " ")), r"\s+", " "))


def text_match(a: Column, b: Column) -> Column:
    """Normalised containment either way, or half of the smaller set of words of over three bytes."""
    x, y = normalised(a), normalised(b)
    words = lambda t: F.array_distinct(F.filter(F.split(t, " "), lambda w: F.octet_length(w) > 3))
    wx, wy = words(x), words(y)
    overlap = 2 * F.size(F.array_intersect(wx, wy)) >= F.least(F.size(wx), F.size(wy))
    some = (F.length(a) > 0) & (F.length(b) > 0)
    return F.coalesce(some & (F.contains(x, y) | F.contains(y, x) | ((F.size(wx) > 0) & (F.size(wy) > 0) & overlap)), F.lit(False))


def preview(text: Column, chars: int, ellipsis: str = "…") -> Column:
    """The text, or its first characters and an ellipsis."""
    return F.when(F.length(text) > chars, F.concat(F.substring(text, 1, chars), F.lit(ellipsis))).otherwise(text)


def fact_like(text: Column, cues=FACT_CUES) -> Column:
    return contains_any(F.lower(text), cues)
