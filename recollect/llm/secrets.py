"""Secrets in texts and who owns them, in DataFrame operations only.

Base patterns give spans of assignments, access keys and hexadecimal keys. The method adds to them: the
value of each span, and each long opaque word that mixes letters and digits, as a whole and cut at /, is hashed
(= and . end a word, but for = as padding); over the whole corpus the hashes' distinct repositories and owners are counted, wherever a
value stands between other characters than letters, digits, +, _ and -. A value that one or two owners hold
and that looks live is owner-specific, whether a base pattern meets it or not: its occurrences anywhere are
``live`` spans. A value that many owners hold is a copied example.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from recollect.llm.arrays import bound, replaced, running
from recollect.llm.common import checked, outside, text_or_empty, written

#: Kind, pattern, group of the value, least characters of the value, in order of the kinds. A run of
#: characters that is too short has no long enough match inside, so patterns of runs ask for the length at once.
KINDS = (
    ("assign", r"""(?i:(password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 6),
    ("access", r"AKIA[A-Z0-9]{16,}", 0, 20),
    ("hex", r"[0-9a-f]{24,}", 0, 24),
)
#: Cheap patterns that hold wherever a kind has a match that is long enough.
HINTS = {
    "assign": r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]""",
    "access": r"AKIA[A-Z0-9]{16}",
    "hex": r"[0-9a-f]{24}",
    "opaque": r"[A-Za-z0-9+/_=-]{16}",
    "run": r"[A-Za-z0-9+/_.=-]{6}",
}
OPAQUE = r"[A-Za-z0-9+/_-]+=*"  # NAME=VALUE is two words
PIECE = r"[A-Za-z0-9+_-]+"  # what =, / and . leave of a word
EDGE = PIECE.removesuffix("+")
RUN = r"[A-Za-z0-9+/_.=-]{6,}"  # the characters of all values: a value's places lie inside runs
OPAQUE_LENGTH = 16
LEAST = min(least for *_, least in KINDS)
OWNERS = 2
DISTINCT_CHARACTERS = 8
BROADCAST_ROWS = 500_000  # values as three numbers and two marks: at most about 40 MB
SPAN_ROWS = 1_000_000  # spans of 8 bytes, and 8 for each text: at most about 20 MB
SPAN = "struct<kind:string,ord:int,start:int,`end`:int,vstart:int,vend:int,value:string>"


def _found(text: Column, kind: str, order: int, pattern: str, group: int, least: int) -> Column:
    """Spans of a pattern's leftmost matches: running sums of the lengths of matches and of what is between them."""
    between = F.transform(F.split(text, pattern, -1), F.length)
    whole = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))

    def spans(whole: Column) -> Column:
        ends = running(F.zip_with(between, whole, lambda gap, w: gap + F.length(w)))
        value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole
        parts = F.filter(F.arrays_zip(ends.alias("end"), whole.alias("whole"), value.alias("value")), lambda p: F.length(p["value"]) >= least)
        return F.transform(parts, lambda p: F.struct(
            F.lit(kind).alias("kind"), F.lit(order).alias("ord"), (p["end"] - F.length(p["whole"])).alias("start"), p["end"].alias("end"),
            (p["end"] - F.length(p["value"])).alias("vstart"), p["end"].alias("vend"), p["value"].alias("value"),
        ))

    found = bound(whole, spans)
    return F.when(text.rlike(HINTS[kind]), found).otherwise(F.array().cast(f"array<{SPAN}>"))


def scan(docs: DataFrame) -> DataFrame:
    """``docs`` with ``base`` (spans of the base kinds) and ``opaque`` (spans of words and their pieces)."""
    text = F.col("text")
    found = [_found(text, kind, i, pattern, group, least) for i, (kind, pattern, group, least) in enumerate(KINDS)]
    words, pieces = (_found(text, "opaque", len(KINDS), pattern, 0, OPAQUE_LENGTH) for pattern in (OPAQUE, f"{EDGE}{{{OPAQUE_LENGTH},}}"))
    words = F.filter(words, lambda s: s["value"].rlike("[=/]"))  # others are pieces
    opaque = F.filter(F.concat(words, pieces), lambda s: s["value"].rlike("[0-9]") & s["value"].rlike("[A-Za-z]"))
    base = F.array_sort(F.concat(*found), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["ord"] - b["ord"]))
    return docs.withColumns({"base": base, "opaque": opaque})


def _lively(value: Column) -> Column:
    """Letters and digits, and enough different characters. Whether it is an example is for its owners to tell."""
    return value.rlike("[0-9]") & value.rlike("[A-Za-z]") & (F.size(F.array_distinct(F.split(value, ""))) >= DISTINCT_CHARACTERS)


def ownership(candidates: DataFrame) -> DataFrame:
    """value_hash, known, repositories, owners and live for candidates (value_hash, known, lively, repository, owner).

    Counts of distinct repositories and owners are over the whole table, first by (value, repository,
    owner), so that a value copied everywhere is reduced before its rows meet.
    """
    each = candidates.groupBy("value_hash", "repository", "owner").agg(F.max("known").alias("known"), F.max("lively").alias("lively"))
    counted = each.groupBy("value_hash").agg(
        F.max("known").alias("known"), F.max("lively").alias("lively"),
        F.count_distinct("repository").alias("repositories"), F.count_distinct("owner").alias("owners"),
    )
    return counted.select("value_hash", "known", "repositories", "owners", (F.col("lively") & (F.col("owners") <= OWNERS)).alias("live"))


def _places(text: Column, value: Column) -> Column:
    """Where ``value`` stands in ``text`` and no piece goes on at its ends: an array of starts, overlapping ones too."""
    ahead = F.concat(F.lit(rf"(?<!{EDGE})(?=\Q"), value, F.lit(rf"\E(?!{EDGE}))"))
    lengths = F.transform(F.split(text, ahead, -1), F.length)
    later = bound(lengths, lambda n: running(F.slice(n, 1, F.size(n) - 1)))
    # An empty match at the very start doesn't split.
    return F.when(F.regexp_like(text, F.concat(F.lit("^"), ahead)), F.concat(F.array(F.lit(0)), later)).otherwise(later)


def _pieces(text: str, least: int) -> Column:
    """Distinct pieces of ``least`` characters or more."""
    return F.explode(F.array_distinct(F.regexp_extract_all(text, F.lit(f"{EDGE}{{{least},}}"), F.lit(0))))


def _hashed(df: DataFrame) -> DataFrame:
    """``df`` with two hashes of 64 bits in the place of ``piece``."""
    return df.withColumns({"h1": F.xxhash64("piece"), "h2": F.xxhash64(F.lit(1), "piece")}).drop("piece")


def elsewhere(texts: DataFrame, candidates: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Every place of the candidates' values in ``texts``: written holders and places.

    Holders (value_hash, known, lively, repository, owner) are of all values, places (mark, value_hash, start,
    length) of those that look live. The distinct pieces of each text, as hashes, are met with each value's longest
    piece. Texts with a value to look for, because it looks live or has more than one piece, are cut into runs
    of the characters that values have, and each value is looked for in the runs that have its longest piece. So
    neither a text nor a value is beside a piece in any row. Opaque words without =, / and . are whole
    pieces, which the scan has met everywhere.
    """
    values = candidates.where(F.col("known") | F.col("value").rlike("[=/.]")).groupBy("value").agg(F.max("known").alias("known"))
    pieces = F.array_sort(F.split("value", "[=/.]+"), lambda a, b: F.length(b) - F.length(a))
    values = values.select("value", "known", _lively(F.col("value")).alias("lively"), F.get(pieces, 0).alias("piece")).where("piece <> ''")
    values = written(values.withColumn("number", F.monotonically_increasing_id()), "secret-values")
    n, least = values.agg(F.count("*"), F.coalesce(F.min(F.length("piece")), F.lit(1))).first()
    keys = _hashed(values.select("number", "piece", (F.col("lively") | (F.col("value") != F.col("piece"))).alias("look")))
    words = texts.select("mark", "repository", "owner", _pieces("text", least).alias("piece"))
    met = _hashed(words).join(F.broadcast(keys) if n <= BROADCAST_ROWS else keys, ["h1", "h2"])
    met = written(met.distinct(), "secret-met")
    asked = met.where("look").select("mark", "h1", "h2", "number").distinct()
    sought = texts.join(checked(asked.select("mark").distinct()), "mark", "left_semi")
    run = F.explode(_found(F.col("text"), "run", 0, RUN, 0, LEAST)).alias("run")
    runs = written(sought.select("mark", run).select("mark", F.col("run.start").alias("at"), F.col("run.value").alias("run")).distinct(), "secret-runs")
    pairs = _hashed(runs.select("mark", "at", _pieces("run", least).alias("piece"))).join(asked, ["mark", "h1", "h2"]).select("mark", "at", "number")
    value = values.select("number", "value", "lively", F.sha2("value", 256).alias("value_hash"))
    places = pairs.join(runs, ["mark", "at"]).join(value, "number")
    places = places.select("mark", "number", "value_hash", "lively", F.length("value").alias("length"), "at", F.explode(_places(F.col("run"), F.col("value"))).alias("start"))
    places = places.withColumn("start", F.col("at") + F.col("start")).drop("at")
    places = written(places, "secret-places")
    there = met.where("look").join(places.select("mark", "number").distinct(), ["mark", "number"], "left_semi")
    holders = met.where("NOT look").unionByName(there).select("number", "repository", "owner").distinct()
    holders = holders.join(values.select("number", "known", "lively", F.sha2("value", 256).alias("value_hash")), "number").drop("number")
    return written(holders, "secret-holders"), places.where("lively").select("mark", "value_hash", "start", "length")


def find_secrets(docs: DataFrame, repository: Column, owner: Column) -> tuple[DataFrame, DataFrame]:
    """Spans of all secrets of ``docs`` (doc_id, text): a row for each document, and the ownership table.

    The first frame has doc_id, mark (md5 of the text), base and live (arrays of spans, start and end in code
    points), and example, where its base spans stand whose value many owners hold. Dots at a value's end are
    no part of it. A null or empty text has no spans. Rows stand alone, also where a doc_id is null or
    repeated; a null repository or owner counts as none. An empty table gives no rows; other columns are left
    alone. The scan is written to the shared folder without the texts; what is joined and shuffled after that
    is candidates, hashes of pieces, and runs of the texts that may have a value to look for. Equal texts are judged once.
    """
    text = text_or_empty()
    texts = docs.select(F.col("doc_id"), text.alias("text"), F.md5(text).alias("mark"), repository.alias("repository"), owner.alias("owner"))
    scanned = written(scan(texts).drop("text"), "secret-scan")
    each = scanned.where((F.size("base") > 0) | (F.size("opaque") > 0)).select(
        "mark", "repository", "owner", F.explode(F.concat("base", "opaque")).alias("span")
    )
    value = F.col("span.value")
    bare = F.regexp_replace(value, r"\.+$", "")
    value = F.when(F.length(bare) >= LEAST, bare).otherwise(value)
    candidates = each.select("mark", "repository", "owner", "span", value.alias("value"), (F.col("span.kind") != "opaque").alias("known"))
    candidates = candidates.withColumns({"value_hash": F.sha2("value", 256), "lively": _lively(F.col("value"))})
    holders, places = elsewhere(texts, candidates)
    counted = ["value_hash", "known", "lively", "repository", "owner"]
    owned = written(ownership(candidates.select(*counted).unionByName(holders.select(*counted))), "secret-owners")
    # A longer word around a copied example, such as a path to it, isn't live for the example's sake.
    inner = candidates.where(~F.col("known") & F.col("lively") & F.col("value").contains("/")).select(F.col("value_hash").alias("outer"), F.explode(F.split("value", "[=/]+")).alias("piece"))
    inner = inner.distinct().withColumn("value_hash", F.sha2("piece", 256)).join(owned.where(F.col("known") & (F.col("owners") > OWNERS)), "value_hash", "left_semi")
    around = inner.select(F.col("outer").alias("value_hash"), F.lit(True).alias("around")).distinct()
    owned = owned.join(around, "value_hash", "left").withColumn("live", F.col("live") & (F.col("known") | F.col("around").isNull())).drop("around")
    owned = written(owned, "secret-judged")
    copied = F.col("known") & (F.col("owners") > OWNERS)
    start = F.col("span.vstart")
    spans = candidates.select("mark", "value_hash", "known", start.alias("start"), (start + F.length("value")).alias("end"), F.struct("span.start", "span.end").alias("whole"))
    met = places.select("mark", "value_hash", F.lit(False).alias("known"), "start", (F.col("start") + F.col("length")).alias("end"))
    spans = spans.unionByName(met, allowMissingColumns=True).distinct()
    told = owned.where(F.col("live") | copied).select("value_hash", "owners", "live")
    live = F.struct(F.lit("live").alias("kind"), F.lit(len(KINDS)).alias("ord"), "start", "end")
    by_mark = spans.join(told, "value_hash").groupBy("mark").agg(
        F.array_sort(F.collect_set(F.when(F.col("live"), live))).alias("live"), F.array_sort(F.collect_set(F.when(copied, F.col("whole")))).alias("example"),
    )
    no_spans = F.array().cast("array<struct<kind:string,ord:int,start:int,`end`:int>>")
    none = F.array().cast("array<struct<start:int,`end`:int>>")
    out = scanned.select("doc_id", "mark", "base").join(by_mark, "mark", "left")
    return out.select("doc_id", "mark", "base", F.coalesce("live", no_spans).alias("live"), F.coalesce("example", none).alias("example")), owned


def spans_text(spans: Column) -> Column:
    """Spans as kind:start:end, joined by commas."""
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")


def _of_kind(spans: str, kind: str) -> Column:
    return F.size(F.filter(spans, lambda s: s["kind"] == kind))


def secret_report(docs: DataFrame, repository: Column, owner: Column) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans, n_live and n_example of every row of ``docs``."""
    found, _ = find_secrets(docs, repository, owner)
    counts = [_of_kind("base", kind).cast("long").alias(f"n_{kind}") for kind, *_ in KINDS]
    slim = F.transform("base", lambda s: F.struct(s["kind"].alias("kind"), s["ord"].alias("ord"), s["start"].alias("start"), s["end"].alias("end")))
    every = F.array_sort(
        F.concat(slim, "live"), lambda a, b: F.when(a["start"] != b["start"], a["start"] - b["start"]).otherwise(a["ord"] - b["ord"])
    )
    return found.select(
        F.col("doc_id").cast("long").alias("doc_id"), *counts, F.sha2(spans_text(F.col("base")), 256).alias("base_sha256"),
        spans_text(every).alias("spans"), F.size("live").cast("long").alias("n_live"), F.size("example").cast("long").alias("n_example"),
    )


def redact(docs: DataFrame, repository: Column, owner: Column, put: str = "[SECRET]") -> DataFrame:
    """``docs`` with ``put`` in the place of every secret, and n_chars to match; copied examples stay.

    All rows and columns stay, whatever these are called; texts without secrets, null ones among them, stay
    as they are. An empty table gives no rows. Texts aren't shuffled while the texts with secrets are few
    enough to be told to all tasks (``SPAN_ROWS`` of their spans); beyond that they are joined by digest.
    """
    found, _ = find_secrets(docs, repository, owner)
    place = lambda s: F.shiftleft(s["start"].cast("long"), 32).bitwiseOR(s["end"].cast("long"))
    base, example, live = (F.transform(spans, place) for spans in ("base", "example", "live"))
    secret = F.concat(F.array_except(base, example), live)
    spans = found.select("mark", F.array_sort(secret).alias("spans")).where(F.size("spans") > 0)
    spans = written(spans.groupBy("mark").agg(F.first("spans").alias("spans")), "secret-spans", outside(docs.sparkSession, "secret-spans"))  # one text, one list
    few = (spans.agg(F.sum(F.size("spans") + 8)).first()[0] or 0) <= SPAN_ROWS
    names = [f"c{i}" for i in range(len(docs.columns))]  # whatever they are called, no name clashes
    at = {name: f"c{i}" for i, name in enumerate(docs.columns)}
    text = at["text"]
    hit = F.col("spans").isNotNull()
    rows = docs.toDF(*names).withColumn("mark", F.md5(text_or_empty(text)))
    joined = rows.join(F.broadcast(spans) if few else spans, "mark", "left").withColumn(text, F.when(hit, replaced(F.col(text), F.col("spans"), put)).otherwise(F.col(text)))
    if "n_chars" in at:
        n_chars = at["n_chars"]
        joined = joined.withColumn(n_chars, F.when(hit, F.length(text).cast(docs.schema["n_chars"].dataType)).otherwise(F.col(n_chars)))
    return joined.select(names).toDF(*docs.columns)
