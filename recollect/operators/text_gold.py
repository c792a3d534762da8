"""Hits without a key told by their texts: containment of normalised texts, either way, without comparing all pairs.

Needles go to the texts as a broadcast, and a text's bytes are looked up among their anchors (see ``text_scan``). Of more needles than
that, those of three words and more hold one of their inner words as a whole word wherever they are contained; shorter ones
hold one of their runs of up to three characters. Of these a needle's rarest is its anchor, texts are met by anchors, and
what meets is tested. Equal texts are one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructField, StructType

from recollect.operators import text_scan
from recollect.operators.evaluate import score_probes
from recollect.sources.shared import SHORT_ROWS, saved, short

GRAM = 3
#: Texts of needles that may be broadcast.
MOST_BYTES = 20_000_000


def normalised_text(text: Column) -> Column:
    """Letters and digits in lower case, words apart by one space; null is empty."""
    kept = F.lower(F.regexp_replace(F.coalesce(text, F.lit("")), r"[^\p{L}\p{N}\s]", ""))
    return F.trim(F.regexp_replace(kept, r"\s+", " "))


def _grams(text: Column, n: int) -> Column:
    last = F.length(text) - n + 1
    return F.when(last > 0, F.transform(F.sequence(F.lit(1), F.greatest(last, F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))).otherwise(F.array().cast("array<string>"))


def contained(needles: DataFrame, hays: DataFrame) -> DataFrame:
    """(needle, hay) of ``needles`` (needle, text) and ``hays`` (hay, text) whose text has the needle's somewhere; blank needles are left out.

    One pass over the hays, where they lie. Only if the needles are over ``MOST_BYTES`` or there are very many, marks are counted,
    pairs of ids are shuffled and texts joined to them.
    """
    words, text = F.split("text", " "), F.col("text")
    needles = saved(needles.where("text <> ''"), "needles")
    size = needles.agg(F.count("*").alias("n"), F.sum(F.octet_length(text)).alias("bytes")).first()
    if size.n <= SHORT_ROWS and (size.bytes or 0) <= MOST_BYTES:
        part = needles.select("needle", "text").toArrow()
        block = text_scan.Needles(part.column("needle").combine_chunks(), [t.encode() for t in part.column("text").to_pylist()])
        kind = StructType([needles.schema["needle"], StructField("hay", hays.schema["hay"].dataType)])
        return hays.where("text IS NOT NULL").select("hay", "text").mapInArrow(text_scan.finder(needles.sparkSession.sparkContext.broadcast(block)), kind)
    many = F.size(words) > 2
    short_marks = F.when(F.length(text) < GRAM, F.array(text)).otherwise(_grams(text, GRAM))
    marks = F.when(many, F.slice(words, F.lit(2), F.greatest(F.size(words) - 2, F.lit(0)))).otherwise(short_marks)
    marked = saved(needles.select("needle", F.explode(F.array_distinct(marks)).alias("mark")), "needle-marks")
    grams = [r.n for r in needles.where(~many).select(F.least(F.length(text), F.lit(GRAM)).alias("n")).distinct().collect()]  # at most three
    held = F.array_distinct(F.concat(words, *[_grams(text, n) for n in sorted(grams)]))
    in_hays = hays.select("hay", F.explode(held).alias("mark"))
    met = in_hays.select("mark").join(short(saved(marked.select("mark").distinct(), "marks")), "mark")
    counted = saved(met.groupBy("mark").agg(F.count("*").alias("df")), "mark-counts")
    anchor = marked.join(counted, "mark").groupBy("needle").agg(F.min(F.struct("df", "mark")).alias("m")).select("needle", F.col("m.mark").alias("mark"))
    both = in_hays.join(anchor, "mark").select("needle", "hay").join(needles.withColumnRenamed("text", "n_text"), "needle").join(hays, "hay")
    return both.where(F.contains("text", F.col("n_text"))).select("needle", "hay")


def text_gold(hits: DataFrame, gold: DataFrame) -> DataFrame:
    """(hit, key) of ``hits`` (hit, text) that contain the text of ``gold`` (ord, key, text) or are contained in it, normalised; the first by (ord, key) counts.

    A hit whose text is blank has no key; gold whose text is blank is contained in every other hit. Hits over the length of
    the longest gold aren't looked for in any.
    """
    digest = F.sha2("text", 256)
    hits = hits.select("hit", normalised_text(F.col("text")).alias("text")).where("text <> ''")
    hits = saved(hits.withColumn("row", F.monotonically_increasing_id()), "hit-texts")  # fixed where it is written
    gold = gold.select(F.struct("ord", "key").alias("first"), normalised_text(F.col("text")).alias("text"))
    blank = gold.where("text = ''").agg(F.min("first").alias("blank"))  # one row
    firsts = saved(gold.where("text <> ''").groupBy("text").agg(F.min("first").alias("first")).withColumn("digest", digest), "gold-texts")
    longest = firsts.select(F.max(F.length("text"))).first()[0] or 0
    small = saved(hits.where(F.length("text") <= longest).withColumn("digest", digest), "small-hits")
    inside = contained(firsts.select(F.col("digest").alias("needle"), "text"), hits.select(F.col("row").alias("hay"), "text"))
    inside = inside.select(F.col("hay").alias("row"), F.col("needle").alias("digest")).join(firsts.select("digest", "first"), "digest").select("row", "first")
    around = contained(small.select(F.col("digest").alias("needle"), "text").distinct(), firsts.select(F.col("first").alias("hay"), "text"))
    around = around.groupBy(F.col("needle").alias("digest")).agg(F.min("hay").alias("first")).join(small.select("row", "digest"), "digest").select("row", "first")
    told = inside.unionByName(around).groupBy("row").agg(F.min("first").alias("first"))
    rows = hits.select("row", "hit").join(told, "row", "left").join(F.broadcast(blank), F.lit(True), "left")
    return rows.withColumn("first", F.array_min(F.array_compact(F.array("first", "blank")))).where("first IS NOT NULL").select("hit", F.col("first.key").alias("key"))


def score_by_text(hits: DataFrame, probes: DataFrame, gold: DataFrame, k: int) -> DataFrame:
    """``score_probes`` with skipped, of hits (probe, rank1, key, text) of which those without a key get it by their text.

    Probes of tag multi_hop, or with skip_if_no_graph, are skipped: they hit nothing and recall 0.
    """
    rows = hits.withColumn("hit", F.struct("probe", "rank1"))
    by_text = text_gold(rows.where("key IS NULL").select("hit", "text"), gold).withColumnRenamed("key", "_key")
    keyed = rows.join(by_text, "hit", "left").select("probe", "rank1", F.coalesce("key", "_key").alias("key"))
    skipped = F.coalesce(F.col("tag") == "multi_hop", F.lit(False)) if "tag" in probes.columns else F.lit(False)
    if "skip_if_no_graph" in probes.columns:
        skipped = skipped | F.coalesce("skip_if_no_graph", F.lit(False))
    scored = score_probes(keyed, probes, k).withColumn("skipped", skipped)
    return scored.withColumns({"hit": F.col("hit") & ~F.col("skipped"), "recall": F.when(F.col("skipped"), 0.0).otherwise(F.col("recall"))})
