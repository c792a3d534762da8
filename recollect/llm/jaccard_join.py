"""Exact n-gram Jaccard join of documents: each row's number of links, and connected components.

1. Each text becomes a set of shingle hashes; equal sets are one set from then on.
2. Highly similar sets form groups. A set's least hash in each of 8 slices of the hash space is a key; of the
   sets of a key, the one whose keys the most sets share leads. A set joins the leader of most of its keys
   if their similarity is at least ``LOOSE`` percent, and is from then on the leader plus a delta.
3. Index lists by shingle find which groups may be linked. A set's prefix in one order of all shingles
   (frequent ones last, the most frequent at the very end) must meet the prefix of any set it links with.
   Lists hold blocks by group, size and position in the prefix; blocks of one group, and blocks whose sizes
   and positions bound the intersection too low, are skipped as wholes. So are pairs of groups that share
   too few shingles of their prefixes for what lies beyond them to make up.
4. Links inside a group, and between two groups, follow from one intersection of the two leaders: the
   members' intersections differ from it by what their deltas add and take away, for 256 by 256 members at once.
   Inside a group, members whose deltas are together small enough are linked without a comparison; their
   number is a sum over the counts of members by delta size.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.llm.common import checked, outside, scratch, sliced, text_or_empty, written
from recollect.llm.components import components
from recollect.llm.shingles import shingle_sets

SLICES = 8
LOOSE = 50  # percent
STORED = 1.25  # prefixes are stored this many times as long, for frequent shingles that move to the end
FREQUENT = 40  # shingles in more groups than this go last in the order ...
MOST_FREQUENT = 200_000  # ... or in more than a multiple of it, so that these are at most so many (3 MB)
BLOOM_BITS = 26  # a fixed 8 MB
MEMBERS = 256  # in a chunk of a group ...
CHUNK_BYTES = 1_000_000  # ... and bytes of their deltas, but for a chunk of one
COLUMNS = 4096


def prefix_length(n, percent: int):
    """How many shingles of a set of ``n`` any linked set must share one of, in a common order."""
    return n - -(-n * percent // 100) + 1


def _beyond(n: Column, percent: int) -> Column:
    """How many shingles of a set of ``n`` are not in its prefix."""
    return F.floor((n * percent + 99) / 100) - 1


# 1. Sets

PROFILE = "doc_id long, mark binary, sid long, n int, digest binary, mins array<long>, low binary"


def _profiler(words: int, percent: int) -> Callable:
    def profile(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        import xxhash

        bounds = np.arange(SLICES, dtype="u8") * np.uint64((1 << 64) // SLICES)
        for batch in batches:
            digests, sizes, mins, lows = [], [], [], []
            for found in shingle_sets(batch.column("text").to_pylist(), words):
                n = len(found)
                at = np.searchsorted(found, bounds)
                at = at[(at < n) & (np.append(at[1:], n) > at)]
                digests.append(xxhash.xxh3_128_digest(found.tobytes()))
                sizes.append(n)
                mins.append(found[at].view("i8"))
                lows.append(found[: min(n, math.ceil(STORED * prefix_length(n, percent)))].tobytes() if n else b"")
            yield pa.RecordBatch.from_arrays(
                [
                    batch.column("doc_id"), batch.column("mark"), batch.column("sid"), pa.array(sizes, pa.int32()),
                    pa.array(digests, pa.binary()), pa.array(mins, pa.list_(pa.int64())), pa.array(lows, pa.binary()),
                ],
                ["doc_id", "mark", "sid", "n", "digest", "mins", "low"],
            )

    return profile


def _keyed_texts(docs: DataFrame) -> DataFrame:
    text = text_or_empty()
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.unhex(F.md5(text)).alias("mark"), text.alias("text"))


def _tokens_of(words: int, kept: list[str]) -> Callable:
    def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = [x.tobytes() for x in shingle_sets(batch.column("text").to_pylist(), words)]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in kept), pa.array(data, pa.binary())], [*kept, "tokens"])

    return whole


def whole_sets(docs: DataFrame, wanted: DataFrame, words: int) -> DataFrame:
    """Written ``wanted`` columns (sid among them) and tokens: the sets, computed anew from their texts, once each.

    ``wanted`` tells the text by doc_id and mark; where rows repeat with their doc_ids, one of them stands.
    """
    kept = [c for c in wanted.columns if c not in ("doc_id", "mark")]
    small = checked(wanted.withColumnsRenamed({"doc_id": "_id", "mark": "_mark"}))
    texts = _keyed_texts(docs)
    met = texts.join(small, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("mark") == F.col("_mark")))
    types = {f.name: f.dataType.simpleString() for f in wanted.schema}
    schema = ", ".join(f"{c} {types[c]}" for c in kept) + ", tokens binary"
    found = written(met.select(*kept, "text").mapInArrow(sliced(_tokens_of(words, kept)), schema), "sets")
    rows, sets = found.agg(F.count("*"), F.count_distinct(*kept)).first()
    return found if rows == sets else written(found.dropDuplicates(kept), "sets")


# 2. Groups

DELTAS = "sid long, leader long, n int, leader_n int, plus int, delta binary"


def _tokens(cell) -> np.ndarray:
    return np.frombuffer(cell.as_buffer(), "u8")


def _deltas(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Verifies pairs of a set and its possible leader; what the similar ones add (first) and leave out."""
    for batch in batches:
        rows = []
        for i in range(batch.num_rows):
            x, y = _tokens(batch.column("tokens")[i]), _tokens(batch.column("leader_tokens")[i])
            both = np.intersect1d(x, y, assume_unique=True)
            if 100 * len(both) >= LOOSE * (len(x) + len(y) - len(both)):
                added, removed = np.setdiff1d(x, both, assume_unique=True), np.setdiff1d(y, both, assume_unique=True)
                rows.append((batch.column("sid")[i].as_py(), batch.column("leader")[i].as_py(), len(x), len(y), len(added), np.concatenate([added, removed]).tobytes()))
        columns = zip(*rows) if rows else [[]] * 6
        types = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int32(), pa.binary())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], ["sid", "leader", "n", "leader_n", "plus", "delta"])


def _groups(docs: DataFrame, heads: DataFrame, words: int) -> DataFrame:
    """Written (sid, leader, n, leader_n, plus, delta) of each set that is in the group of another; no leader is."""
    each = heads.select("sid", "n", F.size("mins").alias("keys"), F.explode("mins").alias("value"))
    # Sums of hot keys are written before they are joined, so that Spark can split a hot key's rows in the join.
    popular = written(each.groupBy("value").agg(F.count("*").alias("times")).where("times > 1"), "popular")
    keyed = written(each.join(popular, "value"), "keys")
    score = keyed.groupBy("sid").agg(F.sum("times").alias("score"))
    scored = written(keyed.select("sid", "n", "keys", "value").join(score, "sid"), "scores")
    no = -F.col("sid")
    first = scored.groupBy("value").agg(F.max(F.struct("score", no.alias("no"), "n")).alias("f")).select("value", "f.*")
    first = written(first.select("value", (-F.col("no")).alias("leader"), F.col("score").alias("leader_score"), F.col("n").alias("leader_n")), "first")
    votes = scored.join(first, "value").groupBy("sid", "leader").agg(F.count("*").alias("votes"), *(F.first(c).alias(c) for c in ("n", "keys", "leader_score", "leader_n")))
    best = votes.groupBy("sid").agg(F.max(F.struct("votes", "leader_score", (-F.col("leader")).alias("no"), "n", "keys", "leader_n")).alias("m"))
    near = (F.col("sid") != F.col("leader")) & (200 * F.col("votes") >= LOOSE * F.col("keys"))
    near = near & (100 * F.least("n", "leader_n") >= LOOSE * F.greatest("n", "leader_n"))
    pairs = best.select("sid", "m.*").withColumn("leader", -F.col("no")).where(near).select("sid", "leader")
    pairs = written(pairs, "leaders")
    leaders = pairs.select("leader").distinct()
    needed = pairs.unionByName(leaders.select(F.col("leader").alias("sid"), "leader"))
    tokens = whole_sets(docs, needed.join(heads.select("sid", "doc_id", "mark"), "sid"), words)
    of_leader = tokens.where("sid = leader").select("leader", F.col("tokens").alias("leader_tokens"))
    rows = tokens.where("sid <> leader").join(of_leader, "leader").select("sid", "leader", "tokens", "leader_tokens")
    found = written(rows.mapInArrow(sliced(_deltas, 64), DELTAS), "deltas")
    # Groups don't nest: who leads others is in no other group.
    return written(found.join(found.select(F.col("leader").alias("sid")).distinct(), "sid", "left_anti"), "groups")


# 3. Which groups may be linked

POSTINGS = "token long, sid long, comp long, n int, place int"


def _exploder(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """(token, comp) of stored shingles; comp is doubled, and odd for the group's leader."""
    for batch in batches:
        data = batch.column("low").to_pylist()
        comp = batch.column("comp").to_numpy()
        comp = 2 * comp + (comp == batch.column("sid").to_numpy())
        found = np.frombuffer(b"".join(data), "i8")
        yield pa.RecordBatch.from_arrays([pa.array(found), pa.array(np.repeat(comp, [len(x) // 8 for x in data]))], ["token", "comp"])


def _frequent(counts: DataFrame) -> np.ndarray:
    """The most frequent shingles (sorted by hash, with how often) in a fixed room."""
    doublings = F.floor(F.log2(F.col("n") / FREQUENT))
    sizes = {r.d: r.c for r in counts.where(F.col("n") > FREQUENT).groupBy(doublings.alias("d")).agg(F.count("*").alias("c")).collect()}  # 64 rows at most
    least = 0
    while sum(c for d, c in sizes.items() if d >= least) > MOST_FREQUENT:
        least += 1
    found = counts.where((F.col("n") > FREQUENT) & (F.col("n") >= FREQUENT * 2**least)).select("token", "n").toArrow()
    out = np.zeros(found.num_rows, [("token", "u8"), ("n", "i8")])
    out["token"], out["n"] = found.column("token").to_numpy().view("u8"), found.column("n").to_numpy()
    return np.sort(out, order="token")


def _bloom(tokens: DataFrame) -> np.ndarray:
    """A filter of fixed size: words of 64 bits by the hash's first bits."""
    bit = F.shiftrightunsigned("token", 64 - BLOOM_BITS)
    words = tokens.select(F.shiftright(bit, 6).alias("word"), bit.bitwiseAND(F.lit(63)).cast("int").alias("bit"))
    found = words.groupBy("word").agg(F.expr("bit_or(shiftleft(1L, bit))").alias("bits")).toArrow()  # 2^20 rows at most
    out = np.zeros(1 << (BLOOM_BITS - 6), "i8")
    out[found.column("word").to_numpy()] = found.column("bits").to_numpy()
    return out.view("u8")


def _in_bloom(bloom: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    bit = tokens >> np.uint64(64 - BLOOM_BITS)
    return (bloom[(bit >> np.uint64(6)).astype("i8")] >> (bit & np.uint64(63))) & np.uint64(1) == 1


def _how_frequent(frequent: np.ndarray, tokens: np.ndarray) -> np.ndarray:
    if not len(frequent):
        return np.zeros(len(tokens), "i8")
    at = np.minimum(np.searchsorted(frequent["token"], tokens), len(frequent) - 1)
    return np.where(frequent["token"][at] == tokens, frequent["n"][at], 0)


def _short(frequent, percent: int) -> Callable:
    """The sets whose stored shingles don't reach for a prefix without frequent ones."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data = batch.column("low").to_pylist()
            n, stored = batch.column("n").to_numpy(), np.array([len(x) // 8 for x in data], "i8")
            often = np.concatenate([[0], np.cumsum(_how_frequent(frequent.value, np.frombuffer(b"".join(data), "u8")) > 0)])
            ends = np.cumsum(stored)
            rare = stored - (often[ends] - often[ends - stored])
            yield pa.RecordBatch.from_arrays([batch.column("sid").filter(pa.array((rare < prefix_length(n, percent)) & (stored < n)))], ["sid"])

    return run


def _poster(frequent, bloom, percent: int, whole: bool) -> Callable:
    """(token, sid, comp, n, place) of prefixes; those of stored shingles only where the filter has them."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            parts = []
            sid, comp, size = (batch.column(c).to_pylist() for c in ("sid", "comp", "n"))
            for s, c, n, data in zip(sid, comp, size, batch.column("low").to_pylist()):
                found = np.frombuffer(data, "u8")
                often = _how_frequent(frequent.value, found)
                p = prefix_length(n, percent)
                if not whole and len(found) < n and (often == 0).sum() < p:
                    continue  # it is among the short ones
                ordered = found[np.argsort(often, kind="stable")][:p] if often.any() else found[:p]
                place = np.arange(p)
                if not whole:
                    use = _in_bloom(bloom.value, ordered)
                    ordered, place = ordered[use], place[use]
                if len(ordered):
                    parts.append((ordered, s, c, n, place))
            if parts:
                lengths = [len(x[0]) for x in parts]
                columns = [np.repeat(np.array([x[k] for x in parts], "i8"), lengths) for k in (1, 2, 3)]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(np.concatenate([x[0] for x in parts]).view("i8")), pa.array(columns[0]), pa.array(columns[1]),
                     pa.array(columns[2].astype("i4")), pa.array(np.concatenate([x[4] for x in parts]).astype("i4"))],
                    ["token", "sid", "comp", "n", "place"],
                )

    return run


def _lists(docs: DataFrame, grouped: DataFrame, heads: DataFrame, words: int, percent: int) -> DataFrame:
    """Written index lists (token, sid, comp, n, place, met) of the shingles in prefixes of different groups; met counts the set's such shingles before."""
    context = docs.sparkSession.sparkContext
    each = grouped.select("sid", "comp", "low").mapInArrow(sliced(_exploder), "token long, comp long")
    counts = each.groupBy("token").agg(F.sum(F.col("comp").bitwiseAND(F.lit(1))).alias("n"), F.min("comp").alias("least"), F.max("comp").alias("most"))
    counts = written(counts.where(F.shiftright("least", 1) != F.shiftright("most", 1)).select("token", "n"), "shared")
    frequent = context.broadcast(_frequent(counts))
    rows = grouped.select("sid", "comp", "n", "low")
    short = written(rows.mapInArrow(sliced(_short(frequent, percent)), "sid long"), "short")
    wanted = short.join(heads.select("sid", "doc_id", "mark", "n"), "sid").join(grouped.select("sid", "comp"), "sid")
    full = whole_sets(docs, wanted, words).withColumnRenamed("tokens", "low")
    more = written(full.select("sid", "comp", "n", "low").mapInArrow(sliced(_poster(frequent, None, percent, True)), POSTINGS), "short-postings")
    bloom = context.broadcast(_bloom(counts.select("token").unionByName(more.select("token"))))
    posted = written(rows.mapInArrow(sliced(_poster(frequent, bloom, percent, False)), POSTINGS).unionByName(more), "postings")
    apart = posted.groupBy("token").agg(F.min("comp").alias("least"), F.max("comp").alias("most")).where("least <> most").select("token")
    before = Window.partitionBy("sid").orderBy("place").rowsBetween(Window.unboundedPreceding, -1)
    lists = posted.join(apart, "token", "left_semi").withColumn("met", F.count("*").over(before).cast("int"))
    return written(lists, "lists")


def _candidates(lists: DataFrame, percent: int) -> DataFrame:
    """Written pairs (comp_a, comp_b) of groups of which some sets may be linked."""
    # Sets that can be linked are in the same size class or in neighbouring ones.
    step = math.log(100 / percent) * (1 + 1e-9)
    size, at = F.floor(F.log(F.col("n").cast("double")) / step), F.floor(F.log2(F.col("place") + 1.0))
    lists = lists.withColumns({"size": size.cast("int"), "at": at.cast("int")})
    blocks = lists.groupBy("token", "comp", "size", "at").agg(
        F.min("n").alias("least"), F.max("n").alias("most"), F.min("place").alias("from"), F.max("place").alias("to"), F.max("met").alias("met")
    )
    blocks = written(blocks, "blocks")
    a, b = (blocks.select("token", *[F.col(c).alias(f"{c}_{x}") for c in blocks.columns[1:]]) for x in "ab")
    # A shingle at places i and j bounds the intersection: no more than the shared ones before either, and than what follows either.
    able = F.least(
        F.least("met_a", "met_b") + F.least(F.col("most_a") - F.col("from_a"), F.col("most_b") - F.col("from_b")),
        F.greatest("most_a", "most_b") - F.greatest(F.lit(0), F.col("from_a") - F.col("to_b"), F.col("from_b") - F.col("to_a")),
    )
    sizes = F.col("least_a") + F.col("least_b")
    fit = (F.col("comp_a") < F.col("comp_b")) & (F.abs(F.col("size_a") - F.col("size_b")) <= 1) & ((100 + percent) * able >= percent * sizes)
    met = a.join(b, "token").where(fit)
    pairs = met.groupBy("comp_a", "comp_b", "size_a", "size_b").agg(
        F.count_distinct("token").alias("shared"), *(F.min(f"{c}_{x}").alias(f"{c}_{x}") for c in ("least", "from") for x in "ab"), *(F.max(f"most_{x}").alias(f"most_{x}") for x in "ab")
    )
    # Of common shingles, those up to the end of the shorter reaching prefix are in both; the others are beyond it in that set.
    most = F.least(
        F.col("shared") + F.greatest(_beyond(F.col("most_a"), percent), _beyond(F.col("most_b"), percent)),
        F.col("most_a") - F.col("from_a"), F.col("most_b") - F.col("from_b"),
    )
    return written(pairs.where((100 + percent) * most >= percent * sizes).select("comp_a", "comp_b").distinct(), "candidates")


# 4. Links

LINKS = "a long, b long, links long"


class _Side:
    """The members of a chunk, and their deltas as one run of signed tokens."""

    def __init__(self, members: pa.Array):
        n_of = lambda name: members.field(name).to_numpy(zero_copy_only=False)
        self.sid, self.n, self.copies, self.weight = n_of("sid"), n_of("n").astype("i8"), n_of("copies"), n_of("weight")
        data = members.field("delta").to_pylist()
        lengths, plus = np.array([len(x) // 8 for x in data], "i8"), n_of("plus").astype("i8")
        self.tokens = np.frombuffer(b"".join(data), "u8")
        self.owner = np.repeat(np.arange(len(data)), lengths)
        place = np.arange(len(self.tokens)) - np.repeat(np.cumsum(lengths) - lengths, lengths)
        self.sign = np.where(place < np.repeat(plus, lengths), 1, -1)

    def met(self, base: np.ndarray) -> np.ndarray:
        """Each member's signed number of delta tokens in the sorted ``base``."""
        if not len(base) or not len(self.tokens):
            return np.zeros(len(self.sid), "i8")
        there = base[np.minimum(np.searchsorted(base, self.tokens), len(base) - 1)] == self.tokens
        return np.bincount(self.owner[there], self.sign[there], len(self.sid)).astype("i8")

    def dense(self, columns: np.ndarray) -> np.ndarray:
        at = np.minimum(np.searchsorted(columns, self.tokens), len(columns) - 1)
        use = columns[at] == self.tokens
        out = np.zeros((len(self.sid), len(columns)), "f4")
        out[self.owner[use], at[use]] = self.sign[use]
        return out


def _products(a: _Side, b: _Side) -> np.ndarray:
    """Products of the signed deltas of each member of ``a`` and each of ``b``."""
    both = np.intersect1d(a.tokens, b.tokens)
    out = np.zeros((len(a.sid), len(b.sid)), "i8")
    for low in range(0, len(both), COLUMNS):
        some = both[low : low + COLUMNS]
        out += (a.dense(some) @ b.dense(some).T).astype("i8")
    return out


def _spanning(linked: np.ndarray) -> list[tuple[int, int]]:
    """Few of the pairs (row, column) of ``linked`` that connect the same rows and columns as all do."""
    out: list[tuple[int, int]] = []
    rows, columns = linked.any(1), np.ones(linked.shape[1], bool)
    while rows.any():
        start = int(rows.argmax())
        rows[start] = False
        ahead = [start]
        while ahead:
            new_columns: list[int] = []
            for r in ahead:
                for c in np.flatnonzero(linked[r] & columns).tolist():
                    columns[c] = False
                    new_columns.append(c)
                    out.append((r, c))
            ahead = []
            for c in new_columns:
                for r in np.flatnonzero(linked[:, c] & rows).tolist():
                    rows[r] = False
                    ahead.append(r)
                    out.append((r, c))
    return out


def _linker(percent: int, inside: bool) -> Callable:
    """Links between two chunks of members, of one group or of two.

    Gives pairs (a, b) that connect what links connect, and rows (a, null, links) of how many rows each set
    links with here. Inside a group, links that the deltas' sizes already tell are left out.
    """

    def found(batch: pa.RecordBatch, i: int) -> tuple[list, list, list]:
        a, b = _Side(batch.column("members_a")[i].values), _Side(batch.column("members_b")[i].values)
        if inside:
            n = batch.column("base_n")[i].as_py()
            removed = lambda side: np.bincount(side.owner[side.sign < 0], minlength=len(side.sid))
            common = n - removed(a)[:, None] - removed(b)[None, :]
        else:
            p, q = _tokens(batch.column("base_a")[i]), _tokens(batch.column("base_b")[i])
            common = len(np.intersect1d(p, q, assume_unique=True)) + a.met(q)[:, None] + b.met(p)[None, :]
            most = common + np.minimum(np.bincount(a.owner, minlength=len(a.sid))[:, None], np.bincount(b.owner, minlength=len(b.sid))[None, :])
            if not ((100 + percent) * most >= percent * (a.n[:, None] + b.n[None, :])).any():
                return [], [], []
        linked = (100 + percent) * (common + _products(a, b)) >= percent * (a.n[:, None] + b.n[None, :])
        same = inside and batch.column("same")[i].as_py()
        edges = linked
        if inside:
            room = (100 - percent) * n
            linked &= a.weight[:, None] + b.weight[None, :] > room
            if same:
                np.fill_diagonal(linked, False)
            edges = linked & ~((a.weight <= room)[:, None] & (b.weight <= room)[None, :])
        if not linked.any():
            return [], [], []
        pairs = _spanning(edges)
        out = [(a.sid[r], b.sid[c], None) for r, c in pairs]
        for side, other, table in ((a, b, linked), (b, a, linked.T))[: 1 if same else 2]:
            number = table @ other.copies
            out += [(side.sid[k], None, number[k]) for k in np.flatnonzero(number)]
        return tuple(list(x) for x in zip(*out))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            columns: tuple[list, list, list] = ([], [], [])
            for i in range(batch.num_rows):
                for column, more in zip(columns, found(batch, i)):
                    column += more
            yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in columns], ["a", "b", "links"])

    return run


def _weight(percent: int) -> Column:
    """What a member's delta costs: two members of weights that add up to (100 - percent) times the leader's size are linked."""
    return 100 * (F.length("delta") / 8 - F.col("plus")).cast("long") + percent * F.col("plus").cast("long")


def _chunks(members: DataFrame) -> DataFrame:
    """Written (comp, chunk, light, heavy, members): the groups' members, by weight and dealt by hash into bounded chunks."""
    kind = F.least(F.floor(8 * F.col("weight") / F.greatest(F.col("room"), F.lit(1))), F.lit(32)).cast("int")
    rows = members.withColumn("kind", kind)
    sizes = rows.groupBy("comp", "kind").agg(F.greatest(F.ceil(F.count("*") / MEMBERS), F.ceil(F.sum(F.length("delta")) / CHUNK_BYTES)).alias("parts"))
    dealt = rows.join(sizes, ["comp", "kind"]).withColumn("chunk", 1_000_000_000 * F.col("kind").cast("long") + F.pmod(F.xxhash64("sid", F.lit(5)), F.col("parts")))
    cell = F.struct("sid", "n", "copies", "weight", "plus", "delta")
    return written(dealt.groupBy("comp", "chunk").agg(F.min("weight").alias("light"), F.max("weight").alias("heavy"), F.collect_list(cell).alias("members")), "chunks")


def _inner_links(members: DataFrame) -> DataFrame:
    """(sid, links): how many rows of its group a set links with by the sizes of the two deltas alone."""
    able = members.where("weight <= room").select("comp", "sid", "weight", "room", "copies")
    by_weight = able.groupBy("comp", "weight", "room").agg(F.sum("copies").alias("copies"))
    asked = by_weight.select("comp", (F.col("room") - F.col("weight")).alias("weight"), F.col("weight").alias("of"), F.lit(0).cast("long").alias("copies"))
    points = by_weight.select("comp", "weight", F.lit(None).cast("long").alias("of"), "copies").unionByName(asked)
    upto = Window.partitionBy("comp").orderBy("weight", F.col("of").isNotNull()).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    sums = points.withColumn("links", F.sum("copies").over(upto)).where("of IS NOT NULL").select("comp", F.col("of").alias("weight"), "links")
    itself = F.when(2 * F.col("weight") <= F.col("room"), F.col("copies")).otherwise(0)
    return able.join(sums, ["comp", "weight"]).select("sid", (F.col("links") - itself).alias("links"))


def _links(docs: DataFrame, heads: DataFrame, deltas: DataFrame, candidates: DataFrame, words: int, percent: int, counted: bool) -> tuple[DataFrame, DataFrame]:
    """Written edges (a, b) that connect the components, and counts (sid, links) of the linked rows of other sets."""
    room = (F.lit(100 - percent) * F.col("leader_n")).cast("long").alias("room")
    follow = deltas.select(F.col("leader").alias("comp"), "sid", "n", "plus", "delta", _weight(percent).alias("weight"), room)
    of_groups = deltas.select(F.col("leader").alias("sid"), "leader_n").distinct()
    alone = candidates.select(F.col("comp_a").alias("sid")).unionByName(candidates.select(F.col("comp_b").alias("sid"))).distinct()
    leaders = of_groups.select("sid").unionByName(alone).distinct().join(heads.select("sid", "n"), "sid").select(
        F.col("sid").alias("comp"), "sid", "n", F.lit(0).alias("plus"), F.lit(b"").alias("delta"), F.lit(0).cast("long").alias("weight"),
        (F.lit(100 - percent) * F.col("n")).cast("long").alias("room"),
    )
    members = written(follow.unionByName(leaders).join(heads.select("sid", "copies"), "sid"), "members")
    chunks = _chunks(members)
    a, b = (chunks.select("comp", *[F.col(c).alias(f"{c}_{x}") for c in ("chunk", "light", "heavy", "members")]) for x in "ab")
    base = of_groups.select(F.col("sid").alias("comp"), F.col("leader_n").alias("base_n"))
    room = F.col("base_n") * (100 - percent)
    open_ = F.col("heavy_a") + F.col("heavy_b") > room
    if not counted:  # what is linked with the leader is connected
        open_ = open_ & (F.greatest("heavy_a", "heavy_b") > room)
    inside = a.join(base, "comp").join(b, "comp").where((F.col("chunk_a") <= F.col("chunk_b")) & open_)
    inside = inside.select("members_a", "members_b", "base_n", (F.col("chunk_a") == F.col("chunk_b")).alias("same")).mapInArrow(sliced(_linker(percent, True), 64), LINKS)
    bases = whole_sets(docs, alone.join(heads.select("sid", "doc_id", "mark"), "sid"), words)
    side = lambda x: chunks.select(F.col("comp").alias(f"comp_{x}"), F.col("members").alias(f"members_{x}"))
    base_of = lambda x: bases.select(F.col("sid").alias(f"comp_{x}"), F.col("tokens").alias(f"base_{x}"))
    across = candidates.join(base_of("a"), "comp_a").join(side("a"), "comp_a").join(base_of("b"), "comp_b").join(side("b"), "comp_b")
    across = across.select("members_a", "members_b", "base_a", "base_b").mapInArrow(sliced(_linker(percent, False), 64), LINKS)
    found = written(inside.unionByName(across), "links")
    edges = found.where("b IS NOT NULL").select("a", "b").unionByName(follow.where("weight <= room").select(F.col("sid").alias("a"), F.col("comp").alias("b")))
    counts = found.where("b IS NULL").select(F.col("a").alias("sid"), "links").unionByName(_inner_links(members))
    return edges, counts.groupBy("sid").agg(F.sum("links").alias("links"))


def jaccard_components(docs: DataFrame, words: int = 4, percent: int = 85, counted: bool = True) -> DataFrame:
    """doc_id, n_shingles, component_id, n_links, component and mark of every row of ``docs`` (doc_id, text).

    Two rows link when 100 * intersection >= percent * union of their sets of ``words``-word shingles;
    component_id is the least doc_id reachable by links, itself included; n_links is how many other rows a
    row links with (null unless ``counted``, which compares all members of a group that the sizes of their
    deltas leave open, not only those that may connect components); component numbers the components
    themselves (null for rows without words), and mark is the md5 of the text. A null text is empty; rows
    without words have no shingles, link with nothing and are their own components. Repeated rows link;
    a null doc_id links like any, and its component_id is null only if no member has an id. An empty table
    gives no rows; other columns are left alone.
    """
    spark = docs.sparkSession
    with scratch(spark, "jaccard"):
        texts = _keyed_texts(docs).withColumn("sid", F.monotonically_increasing_id())
        profiles = written(texts.mapInArrow(sliced(_profiler(words, percent)), PROFILE), "profiles")
        firsts = profiles.where("n > 0").groupBy("digest").agg(F.min("sid").alias("sid"), F.count("*").alias("copies"), F.min("doc_id").alias("least"))
        firsts = written(firsts, "firsts")
        heads = written(profiles.select("sid", "doc_id", "mark", "n", "mins").join(firsts.select("sid", "copies"), "sid"), "heads")
        deltas = _groups(docs, heads, words)
        of = heads.select("sid").join(deltas.select("sid", "leader"), "sid", "left").select("sid", F.coalesce("leader", "sid").alias("comp"))
        grouped = written(profiles.select("sid", "n", "low").join(of, "sid"), "grouped")
        candidates = _candidates(_lists(docs, grouped, heads, words, percent), percent)
        edges, counts = _links(docs, heads, deltas, candidates, words, percent, counted)
        ids = firsts.join(components(edges).withColumnRenamed("node", "sid"), "sid", "left").withColumn("component", F.coalesce("root", "sid"))
        ids = ids.join(counts, "sid", "left").withColumn("n_links", F.coalesce("links", F.lit(0)) + F.col("copies") - 1)
        ids = written(ids.select("digest", "least", "component", "n_links"), "ids")
        least = ids.groupBy("component").agg(F.min("least").alias("component_id"))
        of_set = ids.join(least, "component").select("digest", "component_id", "n_links", "component")
        slim = profiles.select("doc_id", F.col("n").cast("long").alias("n_shingles"), "digest", "mark")
        with_words = slim.where("n_shingles > 0").join(of_set, "digest")
        none = slim.where("n_shingles = 0").withColumns({"component_id": F.col("doc_id"), "n_links": F.lit(0).cast("long"), "component": F.lit(None).cast("long")})
        columns = ["doc_id", "n_shingles", "component_id", "n_links", "component", "mark"]
        out = with_words.select(columns).unionByName(none.select(columns))
        if not counted:
            out = out.withColumn("n_links", F.lit(None).cast("long"))
        return written(out, "components", outside(spark, "components"))


def one_of_each(docs: DataFrame, words: int = 5, percent: int = 80) -> DataFrame:
    """``docs`` less all but one row of each component: the one of the least (doc_id, mark) stays.

    A null doc_id comes before any other. Rows without words stay. Of rows of one doc_id and one text, one
    stays, whether they have words or not. Rows that stay keep all their columns, whatever these are called.
    """
    spark = docs.sparkSession
    found = jaccard_components(docs, words, percent, counted=False)
    kept = found.where("component IS NOT NULL").groupBy("component").agg(F.min(F.struct("doc_id", "mark")).alias("k")).select("k.*")
    kept = kept.unionByName(found.where("component IS NULL").select("doc_id", "mark")).distinct().withColumn("stays", F.lit(True))
    rows = found.groupBy("doc_id", "mark").agg(F.count("*").alias("rows"))
    same = rows["doc_id"].eqNullSafe(kept["doc_id"]) & (rows["mark"] == kept["mark"])
    judged = rows.join(kept, same, "left").select(rows["doc_id"].alias("id"), rows["mark"].alias("m"), "rows", "stays")
    # All but the rows that go, or that stand for several, pass by unmoved.
    judged = written(judged.where("stays IS NULL OR rows > 1"), "judged", outside(spark, "judged"))
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever they are called, no name clashes
    rows = docs.toDF(*names)
    doc_id, text = (F.col(names[docs.columns.index(c)]) for c in ("doc_id", "text"))
    key = doc_id.cast("long").eqNullSafe(F.col("id")) & (F.unhex(F.md5(F.coalesce(text, F.lit("")))) == F.col("m"))
    out = rows.join(checked(judged), key, "left_anti")
    repeated = judged.where("stays")
    if repeated.limit(1).count():
        again = rows.join(checked(repeated), key)
        out = out.unionByName(again.dropDuplicates(["id", "m"]).select(names))
    return out.toDF(*docs.columns)
