"""Pairs of similar token sets: parity bitmaps tell which may be similar, and only these are compared. No row is made for two sets that only share tokens.

A set's bitmap flips one bit for each token. Two bitmaps differ in no more places than their sets do, and a Jaccard similarity of at
least ``t`` bounds that by the sizes; what is dropped can't be similar. Bitmaps have about two bits for each token. Sets
of one key and size class are dealt into blocks of at most 4 MB, and blocks of the same and of
neighbouring classes meet in cells, at most ``WAVE`` of them at a time, so that what is shuffled at once is bounded. Within a cell sets are in order
of their sizes, and only those of fitting sizes are compared, a tile at a time. The work is quadratic, some nanoseconds for a pair of sets.

What may be similar leaves a cell in chunks: lists of pairs among a bounded number of sets. Tokens go to a chunk once for each of its
sets, not for each pair, so that a crowd of near copies moves as many rows as it has sets and chunks.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from recollect.sources.shared import saved, short

BLOCK_WORDS = 524_288  # of 64 bits: 4 MB
WAVE = 256  # cells, of two blocks each: 2 GB
LEAST_WORDS, MOST_WORDS = 2, 1024
TOKENS_A_WORD = 42
TILE_ROWS, TILE_COLUMNS = 16, 4096
OPEN_PAIRS = 1 << 20
CHUNK_TOKENS = 1 << 18
OUT_PAIRS = 1 << 15


def _words(kind: np.ndarray, threshold: float) -> np.ndarray:
    """How many words bitmaps of a size class have where they are compared: for the class's largest sets, ``TOKENS_A_WORD`` tokens a word at most."""
    return np.clip(2 ** np.ceil(np.log2((1 / threshold) ** (kind + 1) / TOKENS_A_WORD)), LEAST_WORDS, MOST_WORDS).astype("i8")


def _signer(threshold: float) -> Callable:
    """Bitmaps as the next class needs them; within their own class they are folded."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            hashes = batch.column("hashes")
            n = hashes.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
            h = hashes.flatten().to_numpy(zero_copy_only=False).view("u8")
            kind = np.floor(np.log(n) / (math.log(1 / threshold) * (1 + 1e-9))).astype("i4")
            words = _words(kind + 1, threshold)
            starts = np.concatenate([[0], np.cumsum(words)])
            at = np.repeat(starts[:-1], n) + ((h >> np.uint64(6)) & np.repeat(words - 1, n).astype("u8")).astype("i8")
            bits = np.zeros(starts[-1], "u8")
            np.bitwise_xor.at(bits, at, np.uint64(1) << (h & np.uint64(63)))
            signs = pa.array([bits[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())
            kept = [batch.column(c) for c in ("no", "scope", "category")]
            yield pa.RecordBatch.from_arrays([*kept, pa.array(n.astype("i4")), pa.array(kind), pa.array(words.astype("i4")), signs], ["no", "scope", "category", "n", "kind", "words", "bits"])

    return sign


def _block(rows: pa.StructArray, words: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(numbers, sizes, bitmaps by word) of a block in order of size. Bitmaps with more words are folded: each word is then the parity of those that it stands for."""
    n = rows.field("n").to_numpy(zero_copy_only=False).astype("i8")
    order = np.argsort(n, kind="stable")
    bits = rows.field("bits")
    bits = np.frombuffer(b"".join(bits.to_pylist()), "u8").reshape(len(bits), -1)[order]
    return rows.field("no").to_numpy(zero_copy_only=False)[order], n[order], np.ascontiguousarray(np.bitwise_xor.reduce(bits.reshape(len(bits), -1, words), 1).T)


def _met(a: tuple, b: tuple | None, threshold: float) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Places in ``a`` and ``b`` of sets that may be similar; within ``a``, each pair once, without ``b``."""
    (_, a_n, a_bits), (_, b_n, b_bits) = a, b or a
    rate = (1 - threshold) / (1 + threshold)  # of both sizes: so many tokens may differ
    kind = "i2" if len(a_bits) <= MOST_WORDS // 4 else "i4"
    a_most, b_most = (np.ceil(rate * n).astype(kind) for n in (a_n, b_n))
    flips, counts, over = (np.empty((TILE_ROWS, TILE_COLUMNS), t) for t in ("u8", "u1", kind))
    for low in range(0, len(a_n), TILE_ROWS):
        x, part = a_n[low : low + TILE_ROWS], a_bits[:, low : low + TILE_ROWS]
        first = np.searchsorted(b_n, math.floor(threshold * x[0] - 1e-9)) if b else low
        last = np.searchsorted(b_n, math.ceil(x[-1] / threshold + 1e-9), "right")
        for left in range(first, last, TILE_COLUMNS):
            y = b_n[left : min(left + TILE_COLUMNS, last)]
            f, c, o = (t[: len(x), : len(y)] for t in (flips, counts, over))
            np.negative(np.add(a_most[low : low + TILE_ROWS, None], b_most[left : left + len(y)], out=o), out=o)
            for mine, yours in zip(part, b_bits[:, left : left + len(y)]):
                np.bitwise_count(np.bitwise_xor(mine[:, None], yours, out=f), out=c)
                np.add(o, c, out=o)
            rows, columns = np.nonzero(o <= 0)
            if len(rows):
                small, large = np.minimum(x[rows], y[columns]), np.maximum(x[rows], y[columns])
                both = small + large
                differ = o[rows, columns].astype("i8") + a_most[low + rows] + b_most[left + columns]
                good = (differ <= both - 2 * np.ceil(threshold / (1 + threshold) * both - 1e-9)) & (small >= threshold * large - 1e-9)
                if not b:
                    good &= low + rows < left + columns
                if good.any():
                    yield low + rows[good], left + columns[good]


def _groups(places: np.ndarray, n: np.ndarray) -> np.ndarray:
    """For each place, the number of its group: runs of the different places with about ``CHUNK_TOKENS`` tokens."""
    own, at = np.unique(places, return_inverse=True)
    return (np.cumsum(n[own]) // CHUNK_TOKENS)[at]


def _chunks(a: tuple, b: tuple, one: np.ndarray, two: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(numbers of sets, two places among these of each pair, the lesser first), with a bounded number of tokens each."""
    rows, columns = _groups(one, a[1]), _groups(two, b[1])
    key = rows * (columns.max() + 1) + columns
    order = np.argsort(key, kind="stable")
    for some in np.split(order, np.flatnonzero(np.diff(key[order])) + 1):
        members, at = np.unique(np.concatenate([a[0][one[some]], b[0][two[some]]]), return_inverse=True)
        x, y = at[: len(some)], at[len(some) :]
        yield members, np.minimum(x, y), np.maximum(x, y)


def _close(threshold: float) -> Callable:
    def close(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i, (cell, of, same) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("cell", "of", "same")))):
                words = int(_words(np.array(of), threshold))
                a = _block(batch.column("a")[i].values, words)
                b = None if same else _block(batch.column("b")[i].values, words)
                made, held, n = 0, [], 0
                for pairs in _met(a, b, threshold):
                    held.append(pairs)
                    n += len(pairs[0])
                    if n >= OPEN_PAIRS:
                        made += (yield from _listed(cell, made, a, b or a, held))
                        held, n = [], 0
                if n:
                    yield from _listed(cell, made, a, b or a, held)

    return close


def _listed(cell: int, made: int, a: tuple, b: tuple, held: list) -> Iterator[pa.RecordBatch]:
    before = made
    for members, x, y in _chunks(a, b, *(np.concatenate(side) for side in zip(*held))):
        lists = [pa.array([v.astype(t)]) for v, t in ((members, "i8"), (x, "i4"), (y, "i4"))]
        yield pa.RecordBatch.from_arrays([pa.array([cell << 24 | made], pa.int64()), *lists], ["chunk", "members", "x", "y"])
        made += 1
    return made - before


def chunks(sets: DataFrame, threshold: float) -> DataFrame:
    """(chunk, members, x, y): lists of pairs of ``sets`` (no, scope, category, tokens), as places among their chunk's members, the lesser number first."""
    hashed = sets.where("scope IS NOT NULL AND category IS NOT NULL").select("no", "scope", "category", F.transform("tokens", lambda t: F.xxhash64(t)).alias("hashes"))
    kinds = ", ".join(f"{c} {sets.schema[c].dataType.simpleString()}" for c in ("no", "scope", "category"))
    signed = saved(hashed.mapInArrow(_signer(threshold), f"{kinds}, n int, kind int, words int, bits binary"), "signed")
    key = ["scope", "category", "kind"]
    dealt = signed.groupBy(*key).agg(F.ceil(F.count("*") * F.first("words") / BLOCK_WORDS).alias("parts"))
    part = F.pmod(F.xxhash64("no"), F.col("parts")).alias("part")
    blocks = signed.join(dealt, key).groupBy(*key, part).agg(F.collect_list(F.struct("no", "n", "bits")).alias("rows"))
    blocks = saved(blocks.withColumn("block", F.monotonically_increasing_id()), "set-blocks")  # fixed where it is written
    one = blocks.select("scope", "category", F.col("kind").alias("of"), F.col("part").alias("part_a"), F.col("block").alias("block_a"), F.explode(F.array(F.col("kind"), F.col("kind") - 1)).alias("kind"))
    two = blocks.select(*key, F.col("part").alias("part_b"), F.col("block").alias("block_b"))
    cells = one.join(two, key).where((F.col("kind") < F.col("of")) | (F.col("part_b") <= F.col("part_a"))).select("of", "block_a", "block_b")
    cells = saved(cells.repartition(1).withColumn("cell", F.monotonically_increasing_id()), "cells")  # a few numbers a cell
    n = cells.count()
    out = []
    for low in range(0, max(n, 1), WAVE):
        wave = cells.where((F.col("cell") >= low) & (F.col("cell") < low + WAVE))
        side = lambda x: short(wave.select("cell", "of", F.col(f"block_{x}").alias("block"), (F.col("block_a") == F.col("block_b")).alias("same"))).join(blocks.select("block", F.col("rows").alias(x)), "block").repartition(max(1, min(WAVE, n - low)), "cell")  # noqa: E731, B023
        both = side("a").hint("merge").join(side("b").where("NOT same").select("cell", "b"), "cell", "left")
        out.append(saved(both.select("cell", "of", "same", "a", "b").mapInArrow(_close(threshold), "chunk long, members array<long>, x array<int>, y array<int>"), "met"))
    return reduce(DataFrame.unionByName, out)


def candidates(sets: DataFrame, threshold: float) -> DataFrame:
    """(no_a, no_b), each pair once, of ``sets`` (no, scope, category, tokens): every pair of one scope and category that is at least that similar, and few others."""
    pairs = chunks(sets, threshold).select("members", F.explode(F.arrays_zip("x", "y")).alias("p"))
    return pairs.select(F.get("members", F.col("p.x")).alias("no_a"), F.get("members", F.col("p.y")).alias("no_b"))


def _common(lists: pa.ListArray, x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """How many tokens the sets at ``x`` and ``y`` share, for pairs in order of ``x``."""
    codes = lists.flatten().dictionary_encode()
    place = codes.indices.to_numpy(zero_copy_only=False)
    n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
    starts = np.cumsum(n) - n
    held = np.zeros(len(codes.dictionary), "i4")
    out = np.zeros(len(x), "i8")
    bounds = [0, *(np.flatnonzero(np.diff(x)) + 1), len(x)]
    for low, high in zip(bounds[:-1], bounds[1:]):
        own, others = x[low], y[low:high]
        mine = place[starts[own] : starts[own] + n[own]]
        ends = np.cumsum(n[others])
        at = np.arange(ends[-1]) + np.repeat(starts[others] - ends + n[others], n[others])
        held[mine] = 1
        out[low:high] = np.add.reduceat(held[place[at]], ends - n[others])
        held[mine] = 0
    return out


def _compare(threshold: float) -> Callable:
    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(batch.num_rows):
                sets = batch.column("sets")[i].values
                members = batch.column("members")[i].values.to_numpy(zero_copy_only=False)
                place = np.empty(len(members), "i8")
                place[np.searchsorted(members, sets.field("no").to_numpy(zero_copy_only=False))] = np.arange(len(sets))
                x, y = (batch.column(c)[i].values.to_numpy(zero_copy_only=False) for c in ("x", "y"))
                order = np.argsort(x, kind="stable")
                x, y = place[x[order]], place[y[order]]
                lists = pc.split_pattern(sets.field("words"), " ")
                n = lists.value_lengths().to_numpy(zero_copy_only=False).astype("i8")
                common = _common(lists, x, y)
                jaccard = common / (n[x] + n[y] - common)
                good = np.flatnonzero(jaccard >= threshold)
                row = sets.field("row")
                for low in range(0, len(good), OUT_PAIRS):
                    some = good[low : low + OUT_PAIRS]
                    yield pa.RecordBatch.from_arrays([row.take(pa.array(x[some])), row.take(pa.array(y[some])), pa.array(jaccard[some])], ["a", "b", "jaccard"])

    return compare


def similar(sets: DataFrame, threshold: float) -> DataFrame:
    """(a, b, jaccard), each pair once, of ``sets`` (no, scope, category, words, row) whose words (a space between each two) are at least that similar; a and b are their rows."""
    met = chunks(sets.withColumn("tokens", F.split("words", " ")), threshold)
    asked = short(met.select("chunk", F.explode("members").alias("no")))
    held = sets.select("no", "words", "row").hint("merge").join(asked, "no")
    held = held.groupBy("chunk").agg(F.collect_list(F.struct("no", "words", "row")).alias("sets"))
    kind = sets.schema["row"].dataType.simpleString()
    return held.hint("merge").join(met, "chunk").select("members", "x", "y", "sets").mapInArrow(_compare(threshold), f"a {kind}, b {kind}, jaccard double")
