"""SimHash fingerprints and the search for all fingerprints within a Hamming radius, in DataFrame operations only.

A text's terms are its shingles of five words. A term's hash votes on each of 64 bits, for the bit where it
is set and against it elsewhere, with the term's count as its weight; the sign of the sum is the bit. Votes
are summed in 32 longs that hold two bits' counts each, so that a text is one row after the map-side
aggregation. For the radius search, fingerprints are cut into blocks; a table for each choice of blocks is
keyed by their bits, and two fingerprints within the radius agree in one of the tables at least.
"""

from __future__ import annotations

import math
from collections import Counter
from itertools import combinations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import checked, text_or_empty, written

WORDS = 5
BITS = 64
RADIUS = 3
LANES = 0x0000000100000001
NO_ID = -(1 << 63)
BUCKET_ROWS = 4096
RANGES = 512


def terms(text: Column) -> Column:
    """Hashes of the text's shingles; of the whole sequence if it has fewer words; none if it has none."""
    words = F.filter(F.split(F.lower(text), r"[^\p{L}\p{N}]+", -1), lambda w: w != "")
    return F.transform(words, lambda w: F.xxhash64(w))


def shingles(hashes: Column) -> Column:
    many = F.transform(
        F.slice(hashes, 1, F.greatest(F.size(hashes) - (WORDS - 1), F.lit(0))),
        lambda h, i: F.xxhash64(h, *[F.get(hashes, i + k) for k in range(1, WORDS)]),
    )
    few = F.when(F.size(hashes) > 0, F.array(F.xxhash64(hashes))).otherwise(F.array().cast("array<bigint>"))
    return F.when(F.size(hashes) >= WORDS, many).otherwise(few)


def _votes(term: str) -> list[Column]:
    """Counts of set bits k and k + 32, in the low and the high half of one sum."""
    return [F.sum(F.shiftrightunsigned(term, k).bitwiseAND(F.lit(LANES))).alias(f"v{k}") for k in range(32)]


def _sign(n: str) -> Column:
    """The fingerprint: a bit is set where more than half of the ``n`` votes are for it."""
    out = F.lit(0).cast("long")
    for k in range(32):
        low = F.col(f"v{k}").bitwiseAND(F.lit(0xFFFFFFFF))
        high = F.shiftrightunsigned(F.col(f"v{k}"), 32)
        for at, votes in ((k, low), (k + 32, high)):
            bit = (1 << at) - (1 << 64 if at == 63 else 0)
            out = out.bitwiseOR(F.when(2 * votes > F.col(n), F.lit(bit)).otherwise(F.lit(0)))
    return out


def fingerprints(rows: DataFrame, keys: list[str], text: str) -> DataFrame:
    """``keys`` and ``fingerprint`` (0 without words); rows of equal keys count as one text.

    Up to 2^32 - 1 shingles a text are counted exactly.
    """
    hashed = rows.select(*keys, terms(F.col(text)).alias("_hashes"))
    exploded = hashed.select(*keys, F.explode_outer(shingles(F.col("_hashes"))).alias("_term"))
    counted = exploded.groupBy(*keys).agg(F.count("_term").alias("_n"), *_votes("_term"))
    return counted.select(*keys, _sign("_n").alias("fingerprint"))


def likeness(a: Column, b: Column) -> Column:
    """1 less the share of bits that differ."""
    return 1 - F.bit_count(a.bitwiseXOR(b)) / float(BITS)


def _signed(mask: int) -> int:
    return mask - (1 << 64 if mask >> 63 else 0)


def _blocks(blocks: int) -> list[int]:
    """Masks of that many runs of bits."""
    edges = [round(BITS * i / blocks) for i in range(blocks + 1)]
    return [sum(1 << at for at in range(a, b)) for a, b in zip(edges, edges[1:])]


def block_count(n: int, radius: int) -> int:
    """How many blocks for ``n`` fingerprints: ``radius`` of them may differ, the others make a key of at least log2(n) - 4 bits.

    So a key of a table holds about 16 unrelated fingerprints at most, however many there are. More blocks
    make longer keys and more tables.
    """
    blocks = radius + 2
    while BITS * (blocks - radius) / blocks < math.log2(max(n, 2)) - 4 and blocks < 12:
        blocks += 1
    return blocks


def within_radius(queries: DataFrame, index: DataFrame, radius: int = RADIUS, blocks: int | None = None) -> DataFrame:
    """All pairs (query, fingerprint, distance) of distinct fingerprints at most ``radius`` bits apart.

    Both frames have a column ``fingerprint`` (nulls take no part; equal ones count once). Of ``blocks`` blocks
    (see ``block_count``) each choice of all but ``radius`` makes a table, keyed by its blocks' bits. The tables are
    joined on their keys, and a pair is reported in the first table in which it meets, so that no pair
    needs to be made distinct. Equal fingerprints are pairs at distance 0.
    """
    one = lambda df: df.where("fingerprint IS NOT NULL").select("fingerprint").distinct()
    blocks = blocks or block_count(one(index).count(), radius)
    masks = _blocks(blocks)
    tables = list(combinations(range(blocks), blocks - radius))

    def tabled(df: DataFrame, name: str) -> DataFrame:
        keys = [F.struct(F.lit(n).alias("table"), F.col("fingerprint").bitwiseAND(F.lit(_signed(sum(masks[b] for b in chosen)))).alias("bits")) for n, chosen in enumerate(tables)]
        return one(df).select(F.col("fingerprint").alias(name), F.explode(F.array(*keys)).alias("key")).select(name, "key.*")

    met = tabled(queries, "query").join(tabled(index, "fingerprint"), ["table", "bits"])
    differs = F.col("query").bitwiseXOR(F.col("fingerprint"))
    first = F.coalesce(*[F.when(differs.bitwiseAND(F.lit(_signed(sum(masks[b] for b in chosen)))) == 0, F.lit(n)) for n, chosen in enumerate(tables)])
    return met.where((F.bit_count(differs) <= radius) & (first == F.col("table"))).select(
        "query", "fingerprint", F.bit_count(differs).cast("int").alias("distance")
    )


def _ranges(rows: DataFrame) -> list[tuple[int, int, int]]:
    """(lowest id, highest id, slices) of ranges of ids in ascending order, from quantiles over all rows.

    Rows without an id are the first range. An id that takes up a whole range is one of its own. A range is
    cut into as many slices as it has rows by ``BUCKET_ROWS``.
    """
    real = F.when(F.col("id") != NO_ID, F.col("id"))
    n, known = rows.agg(F.count("*"), F.count(real)).first()
    parts = max(1, min(known // BUCKET_ROWS, RANGES))
    shares = [i / parts for i in range(1, parts)] or [0.5]
    low, high, edges = rows.agg(F.min(real), F.max(real), F.percentile_approx(real, shares, 10_000)).first()
    slices = lambda count: max(1, -(-count // BUCKET_ROWS))
    out = [(NO_ID, NO_ID, slices(n - known))]
    if not known:
        return out
    times = Counter(edges if parts > 1 else [])
    uppers = sorted({*times, *(e - 1 for e, k in times.items() if k > 1), high})
    for upper in uppers:
        if upper >= low:
            out.append((low, upper, slices(known * times.get(upper, 1) // parts) if low == upper else slices(known // parts)))
            low = upper + 1
    return out


def _ordered(docs: DataFrame) -> DataFrame:
    """Texts with ``id`` (null: lowest), ``h`` (the text's hash) and ``bucket``: slices of ranges of ids, in ascending order of (id, h).

    A range of several ids is sliced by id, evenly between its ends, and a range of one id by hash, so that a
    hot id is split as well. Only rows equal in id and text stay together.
    """
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"), F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("id")).withColumn("h", F.xxhash64("text"))
    ranges = _ranges(rows)

    def place(low: int, high: int) -> Column:
        if low == high:
            return F.lit(low)
        mid = (low + high) // 2
        return F.when(F.col("id") > F.lit(ranges[mid][1]), place(mid + 1, high)).otherwise(place(low, mid))

    of = lambda k: F.get(F.lit([float(x[k]) for x in ranges]), F.col("range"))
    by_id = (F.col("id").cast("double") - of(0)) / (of(1) - of(0) + 1)
    by_hash = F.col("h").cast("double") / float(1 << 64) + 0.5
    share = F.when(of(0) == of(1), by_hash).otherwise(by_id)
    part = F.greatest(F.least(F.floor(share * of(2)), of(2).cast("long") - 1), F.lit(0))
    return rows.withColumn("range", place(0, len(ranges) - 1)).withColumn("bucket", F.shiftleft(F.col("range").cast("long"), 32) + part).drop("range")


def _heads(firsts: DataFrame) -> DataFrame:
    """``firsts`` (a row a bucket) for the buckets whose last row they follow: the next higher bucket, after the lowest the highest.

    Buckets are put in order inside their ranges; in one place only the ranges are, of which there are at most
    about 2 x ``RANGES``.
    """
    firsts = firsts.withColumn("range", F.shiftright("bucket", 32))
    ranges = firsts.groupBy("range").agg(F.min("bucket").alias("least"))
    order = Window.orderBy(F.desc("range"))
    whole = order.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranges = ranges.select("range", F.coalesce(F.lag("least").over(order), F.min("least").over(whole)).alias("beyond"))
    above = F.lag("bucket").over(Window.partitionBy("range").orderBy(F.desc("bucket")))
    linked = firsts.withColumn("above", above).join(F.broadcast(ranges), "range")
    return linked.withColumn("of", F.coalesce("above", "beyond")).drop("range", "above", "beyond")


def edited(docs: DataFrame) -> DataFrame:
    """Each row's text and its edited text, with bucket and id: its last half gives way to the next row's start.

    The next row is the next one in descending doc_id (rows of one doc_id in descending order of their text's
    hash; null doc_ids last), and the first row's after the last. Texts are shuffled once, by ranges of ids; the
    first text of each bucket goes along to the bucket before it, as its last row.
    """
    rows = _ordered(docs)
    firsts = rows.groupBy("bucket").agg(F.max(F.struct("id", "h")).alias("top")).select("bucket", "top.*")
    firsts = written(_heads(firsts), "bucket-firsts")
    heads = rows.select("bucket", "id", "h", "text").join(checked(firsts), ["bucket", "id", "h"])  # a row a bucket, but for repeated rows
    heads = heads.groupBy("of").agg(F.max("text").alias("text"))
    heads = heads.select(F.col("of").alias("bucket"), F.lit(None).cast("long").alias("doc_id"), "text", F.lit(NO_ID).alias("id"), F.lit(0).cast("long").alias("h"), F.lit(1).alias("head"))
    every = rows.withColumn("head", F.lit(0)).unionByName(heads)
    down = Window.partitionBy("bucket").orderBy("head", F.desc("id"), F.desc("h"))
    ranked = every.withColumn("following", F.lead("text").over(down)).withColumn("row", F.row_number().over(down)).where("head = 0")
    half = F.floor(F.col("n_chars") / 2).cast("int")
    return ranked.withColumn("n_chars", F.length("text").cast("long")).select(
        "bucket", "row", "doc_id", "n_chars", "text",
        F.concat(F.substr("text", F.lit(1), (F.col("n_chars") - half).cast("int")), F.substr("following", F.lit(1), half)).alias("edited"),
    )


def fingerprint_report(docs: DataFrame, every: int = 100, radius: int = RADIUS) -> DataFrame:
    """Fingerprints of all rows of ``docs`` (doc_id, text) and of their edited texts.

    Returns doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint (16 hexadecimal digits; those of
    a text without words are 0), near_edited, near_next, and n_within and within: for rows whose doc_id is
    divisible by ``every``, how many rows (itself among them) have fingerprints within ``radius`` bits, and
    these fingerprints in order, else null. The partners are the rows of the result with such a fingerprint;
    listed so, a group of copies is one entry. A null text is empty. Rows stand alone, also where a doc_id is null or repeated; an empty table gives no rows;
    other columns are left alone.
    """
    halves = edited(docs)
    both = halves.select(
        "bucket", "row", "doc_id", "n_chars", F.sha2("edited", 256).alias("edited_sha256"),
        F.explode(F.array(F.struct(F.lit(0).alias("which"), F.col("text").alias("t")), F.struct(F.lit(1).alias("which"), F.col("edited").alias("t")))).alias("x"),
    ).select("bucket", "row", "doc_id", "n_chars", "edited_sha256", "x.which", "x.t")
    keys = ["bucket", "row", "doc_id", "n_chars", "edited_sha256"]
    signed = fingerprints(both, [*keys, "which"], "t")
    rows = written(
        signed.groupBy(*keys).agg(
            F.max(F.when(F.col("which") == 0, F.col("fingerprint"))).alias("fingerprint"),
            F.max(F.when(F.col("which") == 1, F.col("fingerprint"))).alias("edited_fingerprint"),
        ),
        "fingerprints",
    )
    down = Window.partitionBy("bucket").orderBy("row")
    heads = _heads(rows.where("row = 1").select("bucket", "fingerprint")).select(F.col("of").alias("bucket"), F.col("fingerprint").alias("head"))
    linked = rows.withColumn("following", F.lead("fingerprint").over(down)).join(checked(heads), "bucket")
    counts = rows.groupBy("fingerprint").agg(F.count("*").alias("n"))
    asked = rows.where(F.col("doc_id") % every == 0)
    near = within_radius(asked, counts, radius).join(counts, "fingerprint").withColumnRenamed("fingerprint", "fingerprint_b").groupBy(F.col("query").alias("fingerprint")).agg(F.sum("n").alias("n"), F.collect_list("fingerprint_b").alias("near"))
    out = linked.join(near, "fingerprint", "left")
    hexa = lambda c: F.lower(F.lpad(F.hex(c), 16, "0"))
    return out.select(
        "doc_id", "n_chars", "edited_sha256", hexa("fingerprint").alias("fingerprint"), hexa("edited_fingerprint").alias("edited_fingerprint"),
        likeness(F.col("fingerprint"), F.col("edited_fingerprint")).alias("near_edited"),
        likeness(F.col("fingerprint"), F.coalesce("following", "head")).alias("near_next"),
        F.when(F.col("doc_id") % every == 0, F.col("n")).alias("n_within"),
        F.when(F.col("doc_id") % every == 0, F.array_sort(F.transform("near", hexa))).alias("within"),
    )
