"""Arrays and texts of any length as expressions: running values, and pieces of a text, in about linear time.

An array that grows by an element in each step of an aggregation is copied each time, and a substring is
found by walking from the text's start. Here arrays grow inside runs of ``1 << RUN_BITS`` elements, of runs of these, and so on, and a piece is
cut out of the chunks of ``1 << CHUNK_BITS`` characters that it touches.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

RUN_BITS = 5
CHUNK_BITS = 12


def bound(value: Column, use: Callable[[Column], Column]) -> Column:
    """``use(value)``, where ``value`` is worked out once, however often and in whatever lambda it is used."""
    return F.get(F.transform(F.array(value), use), F.lit(0))


def running(numbers: Column, join: Callable[[Column, Column], Column] = lambda a, b: a + b) -> Column:
    """For each of an array of ints, ``join`` (a sum, or another associative one) of it and all before it."""
    last = lambda a: F.get(a, F.size(a) - 1)

    def grown(a: Column) -> Column:
        step = lambda out, x: F.concat(out, F.array(F.when(F.size(out) > 0, join(last(out), x)).otherwise(x)))
        return F.aggregate(a, F.array().cast("array<int>"), step)

    def of(a: Column, levels: int) -> Column:
        if not levels:
            return grown(a)
        runs = F.sequence(F.lit(0), F.greatest(F.shiftright(F.size(a) - 1, RUN_BITS), F.lit(0)))
        return bound(F.transform(runs, lambda r: grown(F.slice(a, F.shiftleft(r, RUN_BITS) + 1, 1 << RUN_BITS))), lambda parts: based(parts, levels))

    def based(parts: Column, levels: int) -> Column:
        moved = lambda before: F.transform(parts, lambda p, r: F.transform(p, lambda x: F.when(r > 0, join(F.get(before, r - 1), x)).otherwise(x)))
        return F.flatten(bound(bound(F.transform(parts, last), lambda lasts: of(lasts, levels - 1)), moved))

    return bound(numbers, lambda a: of(a, 2))


def replaced(text: Column, spans: Column, put: str) -> Column:
    """``text`` with ``put`` for each of ``spans`` (longs: start << 32 | end, in order); overlapping ones are one."""
    start = lambda s: F.shiftright(s, 32).cast("int")
    end = lambda s: s.bitwiseAND(F.lit(0xFFFFFFFF)).cast("int")

    def piece(chunks: Column, a: Column, b: Column) -> Column:
        first = F.shiftright(a, CHUNK_BITS)
        near = F.array_join(F.slice(chunks, first + 1, F.shiftright(b - 1, CHUNK_BITS) - first + 1), "")
        return F.when(b > a, F.substr(near, a - F.shiftleft(first, CHUNK_BITS) + 1, b - a)).otherwise("")

    def cut(spans: Column, ends: Column) -> Column:
        before = lambda i: F.when(i > 0, F.get(ends, i - 1)).otherwise(0)
        gaps = F.transform(spans, lambda s, i: F.struct(before(i).alias("a"), start(s).alias("b"), (i == 0).alias("first")))
        gaps = F.filter(gaps, lambda g: g["first"] | (g["b"] >= g["a"]))
        rest = F.struct(before(F.size(ends)).alias("a"), F.length(text).alias("b"))
        whole = F.concat(F.transform(gaps, lambda g: F.struct(g["a"], g["b"])), F.array(rest))
        chunks = F.regexp_extract_all(text, F.lit(f"(?s).{{1,{1 << CHUNK_BITS}}}"), F.lit(0))
        return bound(chunks, lambda c: F.array_join(F.transform(whole, lambda g: piece(c, g["a"], g["b"])), put))

    return bound(spans, lambda s: bound(running(F.transform(s, end), F.greatest), lambda ends: cut(s, ends)))
