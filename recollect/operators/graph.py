"""Typed relationship edges: checks, updates, traversal, expansion of hits, and edges mined from pages."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.operators.lenses import lens_of, seen, valid_at
from recollect.sources.shared import saved

#: Predicate, kinds of its subject, kinds of its object, symmetric, reserved.
PREDICATES = (
    ("supports", ("span", "memory"), ("memory",), False, False),
    ("derived_from", ("memory",), ("span", "artifact", "memory"), False, False),
    ("contradicts", ("memory",), ("memory",), True, False),
    ("supersedes", ("memory",), ("memory",), False, True),
    ("mentions", ("memory",), ("entity",), False, False),
    ("depends_on", ("entity", "memory"), ("entity", "artifact", "memory"), False, False),
    ("applies_to", ("memory",), ("entity", "artifact"), False, False),
    ("observed_in", ("memory",), ("span",), False, False),
    ("attempted", ("memory",), ("memory",), False, False),
    ("resolved_by", ("memory",), ("memory",), False, False),
)
RESERVED = tuple(p for p, _, _, _, reserved in PREDICATES if reserved)
SYMMETRIC = tuple(p for p, _, _, symmetric, _ in PREDICATES if symmetric)


def registry(spark) -> DataFrame:
    return spark.createDataFrame(
        [(p, list(s), list(o), sym, r) for p, s, o, sym, r in PREDICATES],
        "predicate string, subject_kinds array<string>, object_kinds array<string>, symmetric boolean, reserved boolean",
    )


def dangling_endpoints(edges: DataFrame, endpoints: DataFrame) -> DataFrame:
    """``edges`` (subject_kind, subject, object_kind, object, scope) with reason: an end that is missing or in another scope.

    If ``edges`` has subject_rev and object_rev and ``endpoints`` a version, a pinned revision must be one of
    1 to that version, and only memories and entities may be pinned.
    """
    pinned = "version" in endpoints.columns
    ends = endpoints.select("kind", "id", "scope", *["version"] * pinned)
    out = edges
    for side in ("subject", "object"):
        own = [F.col("kind").alias(f"{side}_kind"), F.col("id").alias(side), F.col("scope").alias(f"_{side}_scope"), *[F.col("version").alias(f"_{side}_version")] * pinned]
        out = out.join(ends.select(*own), [f"{side}_kind", side], "left")

    def bad(side: str) -> Column:
        reason = F.when(F.col(f"_{side}_scope").isNull(), f"{side}_not_found").when(F.col(f"_{side}_scope") != F.col("scope"), f"{side}_scope_denied")
        if pinned and f"{side}_rev" in edges.columns:
            rev = F.col(f"{side}_rev")
            reason = reason.when(rev.isNotNull() & ~F.col(f"{side}_kind").isin("memory", "entity"), f"{side}_not_pinnable")
            reason = reason.when((rev < 1) | (rev > F.col(f"_{side}_version")), f"{side}_bad_revision")
        return reason

    return out.withColumn("reason", F.coalesce(bad("subject"), bad("object"))).drop(*[c for c in out.columns if c.startswith("_subject_") or c.startswith("_object_")])


def validate_edges(edges: DataFrame) -> DataFrame:
    """``edges`` (predicate, subject_kind, object_kind, valid_from?, valid_until?) with reason, by the registry alone."""
    known = F.broadcast(registry(edges.sparkSession))  # ten rows
    rows = edges.join(known, "predicate", "left")
    reason = (
        F.when(F.col("reserved").isNull(), "unknown_predicate").when(F.col("reserved"), "reserved_predicate")
        .when(~F.array_contains("subject_kinds", F.col("subject_kind")), "subject_kind").when(~F.array_contains("object_kinds", F.col("object_kind")), "object_kind")
    )
    if {"valid_from", "valid_until"} <= set(edges.columns):
        reason = reason.when(F.col("valid_until") <= F.col("valid_from"), "invalid_interval")
    return rows.withColumn("reason", reason).select(*edges.columns, "reason")


def dedupe_edges(new: DataFrame, existing: DataFrame) -> DataFrame:
    """``new`` (seq, scope, predicate, subject, object, payload) with status: created, replayed or conflict with the live one."""
    key = ["scope", "predicate", "subject", "object"]
    first = new.groupBy(*key).agg(F.min("seq").alias("_first"), F.min_by("payload", "seq").alias("_payload"))
    held = existing.where("state = 'active'").groupBy(*key).agg(F.min("payload").alias("_held"), F.lit(True).alias("_live"))
    rows = new.join(first, key).join(held, key, "left")
    live = F.coalesce("_live", F.lit(False))
    holder = F.when(live, F.col("_held")).otherwise(F.col("_payload"))
    status = F.when(~F.col("payload").eqNullSafe(holder), "conflict").when(~live & (F.col("seq") == F.col("_first")), "created").otherwise("replayed")
    return rows.withColumn("status", status).select(*new.columns, "status")


#: What a change may set besides the state, and what an event keeps of the edge before it.
CHANGEABLE = ("epistemic", "evidence", "valid_until")
SNAPSHOT = ("version", "state", "state_reason", *CHANGEABLE)


def update_edges(edges: DataFrame, requests: DataFrame, now: Column | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(edges, outcomes, events): compare-and-set changes (seq, id, expected_version, state?, reason?, epistemic?, evidence?, valid_until?) of edges (id, state, version).

    What a request leaves null stays. Closed and stale need a reason; nothing reopens; purged can't be asked
    for, and a purged edge doesn't change. Of several good requests for an edge the lowest seq wins, the rest
    conflict. A state that changes sets state_reason, else it stays. Columns that ``edges`` lacks aren't added, but for state_reason. An event (id, version, prior, at_sys)
    has the version that the change made and the edge before it as a struct; see ``edges_at_version``.
    """
    if "state_reason" not in edges.columns:
        edges = edges.withColumn("state_reason", F.lit(None).cast("string"))
    rows = requests.join(edges.select("id", F.col("state").alias("_state"), F.col("version").alias("_version")), "id", "left")
    why = (
        F.when(F.col("_version").isNull(), "not_found").when(F.col("expected_version") != F.col("_version"), "version_conflict")
        .when((F.col("state") == "purged") | (F.col("_state") == "purged"), "not_allowed").when((F.col("_state") != "active") & (F.col("state") == "active"), "cannot_reopen")
        .when(F.col("state").isin("closed", "stale") & (F.trim(F.coalesce("reason", F.lit(""))) == ""), "reason_required")
    )
    order = Window.partitionBy("id").orderBy(F.col("why").isNotNull(), "seq")
    outcomes = rows.withColumn("why", why).withColumn("status", F.when(F.col("why").isNotNull(), F.col("why")).when(F.row_number().over(order) == 1, "ok").otherwise("conflict"))
    given = [c for c in CHANGEABLE if c in requests.columns and c in edges.columns]
    won = outcomes.where("status = 'ok'").select("id", F.lit(True).alias("_hit"), F.col("state").alias("_new"), F.col("reason").alias("_reason"), *[F.col(c).alias(f"_to_{c}") for c in given])
    joined = edges.join(won, "id", "left")
    hit, set_state = F.coalesce("_hit", F.lit(False)), F.col("_new").isNotNull()
    new = {
        "state": F.coalesce("_new", "state"), "version": F.col("version") + F.when(hit, 1).otherwise(0),
        "state_reason": F.when(set_state, F.col("_reason")).otherwise(F.col("state_reason")), **{c: F.coalesce(f"_to_{c}", c) for c in given},
    }
    changed = joined.select(*[new[c].alias(c) if c in new else F.col(c) for c in edges.columns])
    prior = F.struct(*[c for c in SNAPSHOT if c in edges.columns])
    at = F.lit(None).cast("timestamp_ntz") if now is None else now
    events = joined.where(hit).select("id", (F.col("version") + 1).alias("version"), prior.alias("prior"), at.alias("at_sys"))
    return changed, outcomes.select("seq", "id", "status"), events


def edges_at_version(edges: DataFrame, events: DataFrame, asked: DataFrame) -> DataFrame:
    """Asked edges (id, version) as they were at that version: ``edges`` with what the journal kept of them.

    The journal (id, version, prior) has one event for each change, in any order, from any number of calls
    of ``update_edges``. An edge's present version gives the edge itself; another one is the snapshot that the change away from it
    kept, found by (id, version) alone, so that a long journal needs no fold. Versions that never were, or that the journal has lost, give no row.
    """
    own = asked.select("id", F.col("version").alias("_asked")).distinct()
    rows = edges.join(own, "id")
    present = rows.where(F.col("_asked") == F.col("version"))
    kept = events.select("id", F.col("prior.version").alias("_asked"), F.col("prior").alias("_prior"))
    before = rows.where(F.col("_asked") < F.col("version")).join(kept, ["id", "_asked"])
    fields = set(events.schema["prior"].dataType.fieldNames())
    before = before.select(*[F.col(f"_prior.{c}").alias(c) if c in fields else F.col(c) for c in edges.columns])
    return present.select(edges.columns).unionByName(before)


def list_edges(edges: DataFrame, endpoint: Column | None = None, predicate: str | None = None, state: str = "active", limit: int = 128) -> DataFrame:
    """Edges of an endpoint on either side, newest first."""
    rows = edges.where(F.col("state") == state)
    if endpoint is not None:
        rows = rows.where((F.col("subject") == endpoint) | (F.col("object") == endpoint))
    if predicate:
        rows = rows.where(F.col("predicate") == predicate)
    return rows.orderBy(F.desc("valid_from"), "subject", "object").limit(limit)


def _steps(edges: DataFrame, direction: str, most: int | None = None) -> DataFrame:
    """(a, b, predicate, id) moves along edges; symmetric predicates go both ways. ``most`` keeps a node's first ones by id."""
    own = edges if "id" in edges.columns else edges.withColumn("id", F.concat_ws("|", "subject", "predicate", "object"))
    out = own.select(F.col("subject").alias("a"), F.col("object").alias("b"), "predicate", "id")
    back = own.select(F.col("object").alias("a"), F.col("subject").alias("b"), "predicate", "id")
    if direction == "in":
        out, back = back, out
    if direction != "both":
        back = back.where(F.col("predicate").isin(*SYMMETRIC))
    moves = out.unionByName(back).where("a <> b").distinct()
    if most:
        moves = moves.withColumn("_n", F.row_number().over(Window.partitionBy("a").orderBy("id", "b"))).where(F.col("_n") <= most).drop("_n")
    return moves


def traverse(
    edges: DataFrame, seeds: DataFrame, depth: int = 2, direction: str = "out", visited: int = 128, most_edges: int = 256,
    predicates: tuple[str, ...] | None = None, states: tuple[str, ...] = ("active",),
) -> tuple[DataFrame, DataFrame]:
    """(nodes, stats) of a breadth-first walk from each seed (id) on its own.

    nodes has seed, node, depth and path: the ids of the edges that led there first. A level's edges are
    taken in order of where they start (the order in which these nodes were found), then of their ids. Budgets
    hold for a seed: ``depth`` (8 at most), ``visited`` nodes with the seed itself (4096 at most) and
    ``most_edges`` scanned (8192 at most), those to nodes seen before included. stats has seed, visited,
    edges_scanned, depth_reached and truncated: in order, ``depth`` if the last level's nodes have edges that
    weren't taken, ``edges`` if that many were scanned, ``visited`` if edges were left when that many nodes
    were seen. A seed that meets one of the last two goes no deeper. ``edges`` has subject, predicate, object
    and, if there, id and state; edges from a node to itself don't count. Since budgets bound what a seed
    can meet, no more of a hub's edges than the budget are joined, and sums of degrees tell which of a level's
    edges a seed's budget reaches before any edge is joined. Each level is two joins and an anti join, and is written. Predicates that the store alone keeps (``RESERVED``) aren't walked, and asking for one is an error.
    """
    if set(predicates or ()) & set(RESERVED):
        raise ValueError("foundation-maintained predicates are not traversable")
    depth, visited, most_edges = min(depth, 8), max(1, min(visited, 4096)), max(1, min(most_edges, 8192))
    if "state" in edges.columns:
        edges = edges.where(F.col("state").isin(*states))
    allowed = F.col("predicate").isin(*predicates) if predicates else ~F.col("predicate").isin(*RESERVED)
    moves = _steps(edges.where(allowed), direction).withColumn("nth", F.row_number().over(Window.partitionBy("a").orderBy("id", "b")))
    steps = saved(moves.where(F.col("nth") <= most_edges + 1).withColumnRenamed("a", "node"), "steps")
    degrees = saved(steps.groupBy("node").agg(F.max("nth").alias("degree")), "degrees")
    first = seeds.select(F.col("id").alias("seed")).distinct()
    none = F.array().cast("array<string>")
    frontier = first.select("seed", F.col("seed").alias("node"), F.lit(0).alias("depth"), none.alias("path"), F.lit(1).alias("rank"), F.lit(0).cast("long").alias("scanned"), F.lit(1).cast("long").alias("seen"))
    frontier = nodes = saved(frontier, "level")
    told = first.select("seed", F.lit(1).cast("long").alias("seen"), F.lit(0).cast("long").alias("scanned"), F.lit(None).cast("string").alias("mark"))
    for level in range(1, depth + 1):
        upto = F.sum("degree").over(Window.partitionBy("seed").orderBy("rank").rowsBetween(Window.unboundedPreceding, Window.currentRow))
        heads = frontier.select("seed", "node", "path", "rank", "scanned", "seen").join(degrees, "node").withColumn("upto", F.col("scanned") + upto)
        heads = saved(heads.withColumn("base", F.col("upto") - F.col("degree")), "heads")
        within = heads.where(F.col("base") < most_edges).join(steps, "node").withColumn("pos", F.col("base") + F.col("nth")).where(F.col("pos") <= most_edges)
        within = within.select("seed", "b", "pos", "seen", F.concat("path", F.array("id")).alias("path"))
        fresh = within.groupBy("seed", F.col("b").alias("node")).agg(F.min(F.struct("pos", "path", "seen")).alias("f"))
        fresh = fresh.join(nodes.select("seed", "node"), ["seed", "node"], "left_anti").select("seed", "node", "f.*")
        fresh = fresh.withColumn("rank", F.row_number().over(Window.partitionBy("seed").orderBy("pos"))).where(F.col("rank") <= visited - F.col("seen"))
        fresh = saved(fresh, "fresh")
        found = fresh.groupBy("seed").agg(F.count("*").alias("found"), F.max("pos").alias("last"))
        per = heads.groupBy("seed").agg(F.max("upto").alias("pos"), F.max("scanned").alias("before"), F.max("seen").alias("seen")).join(found, "seed", "left")
        total = F.col("seen") + F.coalesce("found", F.lit(0))
        upto = F.least("pos", F.lit(most_edges))
        full = (total >= visited) & (upto > F.coalesce("last", "before"))
        marks = F.array_compact(F.array(F.when(F.col("pos") >= most_edges, "edges"), F.when(full, "visited")))
        per = saved(per.select("seed", total.alias("seen"), upto.cast("long").alias("scanned"), marks.alias("marks")), "per-seed")
        told = told.unionByName(per.select("seed", "seen", "scanned", F.explode_outer("marks").alias("mark")))
        reached = fresh.select("seed", "node", F.lit(level).alias("depth"), "path", "rank").join(per, "seed")
        reached = saved(reached, "level")
        nodes = nodes.unionByName(reached.drop("marks"))
        frontier = reached.where(F.size("marks") == 0).drop("marks")
    cut = frontier.join(steps.select("node").distinct(), "node", "left_semi").select("seed").distinct().withColumns({"seen": F.lit(0).cast("long"), "scanned": F.lit(0).cast("long"), "mark": F.lit("depth")})
    stats = told.unionByName(cut).groupBy("seed").agg(F.max("seen").alias("visited"), F.max("scanned").alias("edges_scanned"), F.array_sort(F.collect_set("mark")).alias("truncated"))
    deepest = nodes.groupBy("seed").agg(F.max("depth").alias("depth_reached"))
    return nodes.select("seed", "node", "depth", "path"), stats.join(deepest, "seed").select("seed", "visited", "edges_scanned", "depth_reached", "truncated")


def graph_expand(
    hits: DataFrame, edges: DataFrame, queries: DataFrame, memories: DataFrame, depth: int = 1, seeds: int = 8, most: int = 32, most_edges: int = 256
) -> tuple[DataFrame, DataFrame]:
    """(hits, stats): ``hits`` (query_id, id, rank1, score) with what a walk along active memory edges adds.

    The first ``seeds`` hits of a query (16 at most) are expanded both ways, ``depth`` steps (2 at most), along
    edges that are valid at the query's as_of, if the edges have times. Edges are scanned in the order of
    ``traverse``. Direct hits keep place and score and only gain from (the seeds that lead there), via
    (predicates; three of each, in order of discovery) and the least depth. Others are candidates, ``most`` (64
    at most) a query; those that the query's scope and lenses allow follow the direct hits by depth, then
    discovery, with a rank's score. stats has query_id, seeds, edges_scanned, candidates_found,
    candidates_added and truncated: ``candidates``, ``depth`` (the last level has edges that weren't taken)
    and ``edges`` (``most_edges`` were scanned). A query that meets another limit than the depth goes no deeper.
    """
    depth, seeds, most = min(depth, 2), min(seeds, 16), min(most, 64)
    if "state" in edges.columns:
        edges = edges.where("state = 'active'")
    timed = "valid_from" in edges.columns and "as_of" in queries.columns
    steps = _steps(edges, "both", None if timed else most_edges + 1).withColumnRenamed("a", "node")
    if timed:
        own = edges if "id" in edges.columns else edges.withColumn("id", F.concat_ws("|", "subject", "predicate", "object"))
        steps = steps.join(own.select("id", "valid_from", "valid_until"), "id")
    steps = saved(steps, "steps")
    hits = saved(hits.select("query_id", "id", "rank1", "score"), "hits")
    frontier = saved(
        hits.where(F.col("rank1") <= seeds).select("query_id", F.col("id").alias("node"), F.col("id").alias("origin"), F.col("rank1").cast("long").alias("rank"), F.lit(0).cast("long").alias("scanned"), F.lit(0).cast("long").alias("found")),
        "level",
    )
    start = frontier.groupBy("query_id").agg(F.count("*").alias("seeds"))
    told = start.select("query_id", F.lit(0).cast("long").alias("scanned"), F.lit(None).cast("string").alias("mark"))
    met = candidates = None
    for level in range(1, depth + 1):
        ahead = frontier.join(steps, "node")
        if timed:
            ahead = ahead.join(queries.select("query_id", "as_of"), "query_id").where(valid_at(F.col("as_of")))
        order = Window.partitionBy("query_id").orderBy("rank", "id", "b")
        ahead = ahead.withColumn("pos", F.col("scanned") + F.row_number().over(order))
        ahead = saved(ahead.select("query_id", "node", "origin", F.col("b").alias("id"), "predicate", "pos", "scanned", "found", F.lit(level).alias("depth")), "ahead")
        within = ahead.where(F.col("pos") <= most_edges)
        met = within.select("query_id", "id", "origin", "predicate", "pos", "depth") if met is None else met.unionByName(within.select("query_id", "id", "origin", "predicate", "pos", "depth"))
        fresh = within.groupBy("query_id", "id").agg(F.min(F.struct("pos", "origin", "found")).alias("f")).select("query_id", "id", "f.*").join(hits.select("query_id", "id"), ["query_id", "id"], "left_anti")
        if candidates is not None:
            fresh = fresh.join(candidates.select("query_id", "id"), ["query_id", "id"], "left_anti")
        fresh = saved(fresh.withColumn("rank", F.row_number().over(Window.partitionBy("query_id").orderBy("pos")).cast("long")), "fresh")
        over = fresh.groupBy("query_id").agg(F.max(F.col("rank") + F.col("found")).alias("all"))
        per = ahead.groupBy("query_id").agg(F.max("pos").alias("pos"), F.max("found").alias("before")).join(over, "query_id", "left")
        marks = F.array_compact(F.array(F.when(F.col("all") > most, "candidates"), F.when(F.col("pos") >= most_edges, "edges")))
        per = saved(per.select("query_id", F.least("pos", F.lit(most_edges)).cast("long").alias("scanned"), F.least(F.coalesce("all", "before"), F.lit(most)).alias("found"), marks.alias("marks")), "per-query")
        told = told.unionByName(per.select("query_id", "scanned", F.explode_outer("marks").alias("mark")))
        kept = fresh.where(F.col("rank") + F.col("found") <= most)
        taken = kept.select("query_id", "id", F.lit(level).alias("depth"), "pos")
        candidates = taken if candidates is None else candidates.unionByName(taken)
        frontier = saved(kept.select("query_id", F.col("id").alias("node"), "origin", "rank").join(per, "query_id").where(F.size("marks") == 0).drop("marks"), "level")
    firsts = lambda c: met.groupBy("query_id", "id", c).agg(F.min("pos").alias("p")).groupBy("query_id", "id").agg(F.slice(F.array_sort(F.collect_list(F.struct("p", c))), 1, 3).alias("l"))
    of = lambda c, name: firsts(c).select("query_id", "id", F.transform("l", lambda x: x[c]).alias(name))
    led = met.groupBy("query_id", "id").agg(F.min("depth").alias("depth")).join(of("origin", "from"), ["query_id", "id"]).join(of("predicate", "via"), ["query_id", "id"])
    direct = hits.join(led, ["query_id", "id"], "left").select("query_id", "id", "rank1", "score", F.lit(False).alias("expanded"), "from", "via", "depth")
    allowed = seen(candidates, queries, memories)
    if not lens_of(queries):
        allowed = allowed.join(memories.select("id"), "id", "left_semi")
    placed = allowed.withColumn("n", F.row_number().over(Window.partitionBy("query_id").orderBy("depth", "pos"))).join(hits.groupBy("query_id").agg(F.max("rank1").alias("direct")), "query_id")
    rank = F.col("direct") + F.col("n")
    added = placed.drop("depth").join(led, ["query_id", "id"]).select("query_id", "id", rank.alias("rank1"), (1 / (60.0 + rank)).alias("score"), F.lit(True).alias("expanded"), "from", "via", "depth")
    cut = frontier.join(steps.select("node").distinct(), "node", "left_semi").select("query_id").distinct().select("query_id", F.lit(0).cast("long").alias("scanned"), F.lit("depth").alias("mark"))
    stats = told.unionByName(cut).groupBy("query_id").agg(F.max("scanned").alias("edges_scanned"), F.array_sort(F.collect_set("mark")).alias("truncated"))
    for rows, name in ((candidates, "candidates_found"), (added, "candidates_added")):
        stats = stats.join(rows.groupBy("query_id").agg(F.count("*").alias(name)), "query_id", "left").withColumn(name, F.coalesce(name, F.lit(0)))
    return direct.unionByName(added), stats.join(start, "query_id").select("query_id", "seeds", "edges_scanned", "candidates_found", "candidates_added", "truncated")


def upsert_entities(entities: DataFrame, requests: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(entities, outcomes): inserts and compare-and-set updates (seq, id, kind?, name?, expected_version?); null keeps what is there."""
    rows = requests.join(entities.select("id", F.col("version").alias("_version")), "id", "left")
    why = F.when(F.col("_version").isNotNull() & F.col("expected_version").isNotNull() & (F.col("expected_version") != F.col("_version")), "version_conflict").when(
        F.col("_version").isNull() & (F.coalesce("name", F.lit("")) == ""), "name_required"
    )
    order = Window.partitionBy("id").orderBy(F.col("why").isNotNull(), "seq")
    outcomes = rows.withColumn("why", why).withColumn("status", F.when(F.col("why").isNotNull(), F.col("why")).when(F.row_number().over(order) == 1, "ok").otherwise("conflict"))
    won = outcomes.where("status = 'ok'").select("id", F.col("kind").alias("_kind"), F.col("name").alias("_name"), F.lit(True).alias("_hit"))
    merged = entities.join(won, "id", "full").select(
        "id", F.coalesce("_kind", "kind").alias("kind"), F.coalesce("_name", "name").alias("name"),
        (F.coalesce("version", F.lit(0)) + F.when(F.col("_hit"), 1).otherwise(0)).cast("long").alias("version"),
    )
    return merged, outcomes.select("seq", "id", "status")


def link_derived_from(links: DataFrame, memories: DataFrame, sources: DataFrame) -> DataFrame:
    """``links`` (id, source_kind, source) with reason: the memory or its source is missing, or in another scope."""
    own = memories.select("id", F.col("scope").alias("_scope"))
    of = sources.select(F.col("kind").alias("source_kind"), F.col("id").alias("source"), F.col("scope").alias("_source_scope"))
    rows = links.join(own, "id", "left").join(of, ["source_kind", "source"], "left")
    reason = (
        F.when(F.col("_scope").isNull(), "memory_not_found").when(F.col("_source_scope").isNull(), "source_not_found")
        .when(F.col("_scope") != F.col("_source_scope"), "scope_denied")
    )
    return rows.withColumn("reason", reason).select(*links.columns, "reason")


#: Words that tell nothing in a heading.
HEADING_STOP_WORDS = (
    "the", "and", "for", "with", "that", "this", "must", "shall", "from", "into", "when", "where",
    "are", "is", "a", "an", "of", "to", "in", "on", "or", "not", "be", "by", "at", "as", "it",
)
PREAMBLE = "00-preamble"
REQUIREMENT = r"[A-Z]{2,5}-[0-9]{3}(?![A-Za-z0-9-])"
_stripped = lambda c: F.regexp_replace(c, r"^\s+|\s+$", "")


def slug(heading: Column) -> Column:
    """A heading's letters and digits in lower case, joined by single hyphens, 40 characters at most."""
    joined = F.regexp_replace(F.lower(F.regexp_replace(heading, "[^A-Za-z0-9]+", "-")), "^-|-$", "")
    return F.substring(joined, 1, 40)


def split_sections(documents: DataFrame, most_chars: int = 1200) -> DataFrame:
    """(doc, section, label, heading, text) of Markdown documents (doc, text), cut at headings of the second and third level.

    What stands before the first of them is section 0, the preamble. A label is the document, two colons and the heading's
    slug; a slug's second section in a document gets -2, and so on. The heading is the text's first line without its marks. Texts
    are stripped, then cut to ``most_chars``; blank sections are left out.
    """
    lines = documents.select("doc", F.posexplode(F.split("text", "\n", -1)).alias("no", "line"))
    opens = F.startswith("line", F.lit("## ")) | F.startswith("line", F.lit("### "))
    number = F.sum(F.when(opens, 1).otherwise(0)).over(Window.partitionBy("doc").orderBy("no"))
    rows = lines.withColumn("section", number).groupBy("doc", "section").agg(F.array_sort(F.collect_list(F.struct("no", "line"))).alias("l"))
    text = F.substring(_stripped(F.array_join(F.transform("l", lambda x: x["line"]), "\n")), 1, most_chars)
    rows = rows.select("doc", F.col("section").cast("long").alias("section"), text.alias("text")).where("text <> ''")
    heading = _stripped(F.regexp_replace(F.substring_index("text", "\n", 1), "^#+", ""))
    rows = rows.withColumn("heading", heading).withColumn("slug", F.when(F.col("section") == 0, PREAMBLE).otherwise(slug(F.col("heading"))))
    nth = F.row_number().over(Window.partitionBy("doc", "slug").orderBy("section"))
    label = F.concat("doc", F.lit("::"), "slug", F.when(nth > 1, F.concat(F.lit("-"), nth)).otherwise(""))
    return rows.withColumn("label", label).select("doc", "section", "label", "heading", "text")


def mine_edges(sections: DataFrame) -> DataFrame:
    """Edges of sections (doc, section, label, text): ``derived_from`` the section that defines a requirement that a text names, ``depends_on`` the preamble of a linked document.

    A definition is a requirement id right after two asterisks; of several the first in order of (doc,
    section) stands. A link's target counts up to its #, by the file's name without folders and .md. No self edges; each once.
    Sections are made once: what their texts name is written, without the texts.
    """
    found = lambda pattern, group: F.array_distinct(F.regexp_extract_all("text", F.lit(pattern), F.lit(group)))
    named = sections.select(
        "doc", "section", "label", found(rf"(?<=\*\*)({REQUIREMENT})", 1).alias("defines"), found(rf"(?<![A-Za-z0-9-])({REQUIREMENT})", 1).alias("uses"), found(r"\]\(([^)]*)", 1).alias("links")
    )
    named = saved(named, "named")
    defines = named.select("doc", "section", "label", F.explode("defines").alias("req"))
    first = defines.groupBy("req").agg(F.min_by("label", F.struct("doc", "section")).alias("object"))
    uses = named.select(F.col("label").alias("subject"), F.explode("uses").alias("req"))
    derived = uses.join(first, "req").select("subject", F.lit("derived_from").alias("predicate"), "object")
    links = named.select(F.col("label").alias("subject"), F.explode("links").alias("target"))
    links = links.select("subject", F.regexp_extract(F.substring_index("target", "#", 1), r"([^/]+)\.md$", 1).alias("doc")).where("doc <> ''")
    preambles = named.where("section = 0").select("doc", F.col("label").alias("object"))
    linked = links.join(preambles, "doc").select("subject", F.lit("depends_on").alias("predicate"), "object")
    return derived.unionByName(linked).where("subject <> object").distinct()


def telling_words(text: Column) -> Column:
    """A text's distinct words of four letters or digits and more that aren't stop words."""
    words = F.split(F.translate(text, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), "[^a-z0-9]+", -1)
    return F.array_distinct(F.filter(words, lambda w: (F.length(w) >= 4) & ~w.isin(*HEADING_STOP_WORDS)))


def mine_probes(sections: DataFrame, edges: DataFrame) -> DataFrame:
    """(name, label, query, gold, seeds, min_depth) of sections (label, heading, text) with edges whose headings have two telling words or more.

    Gold are the linked sections that share no telling word with the heading (kind d1, depth 1). Without any, these are the
    sections one step farther, neither the section itself nor linked, that share none (d2, depth 2); without those all
    linked ones (lex, depth 0), a baseline. Seeds are the section, and for d2 its targets too. The second
    step is walked only from sections that need it, and words are looked up, of sections that some edge leads to, instead of texts carried along.
    """
    pairs = saved(edges.select(F.col("subject").alias("label"), "object").distinct(), "pairs")
    asked = sections.select("label", F.col("heading").alias("query"), telling_words(F.col("heading")).alias("q")).where(F.size("q") >= 2)
    asked = saved(asked.join(pairs.select("label").distinct(), "label", "left_semi"), "asked")
    of_query = asked.select("label", F.explode("q").alias("word"))
    linked = sections.join(pairs.select(F.col("object").alias("label")).distinct(), "label", "left_semi")
    held = linked.select(F.col("label").alias("object"), F.explode(telling_words(F.col("text"))).alias("word"))
    held = saved(held.join(of_query.select("word").distinct(), "word", "left_semi"), "held")

    def apart(links: DataFrame, name: str) -> DataFrame:
        """Links to sections without a word of the query, by label."""
        shared = links.join(of_query, "label").join(held, ["object", "word"]).select("label", "object").distinct()
        return links.join(shared, ["label", "object"], "left_anti").groupBy("label").agg(F.array_sort(F.collect_set("object")).alias(name))

    direct = pairs.join(asked.select("label"), "label", "left_semi")
    first = saved(apart(direct, "g1"), "first")
    rest = direct.join(first.select("label"), "label", "left_anti")
    beyond = rest.join(pairs.select(F.col("label").alias("object"), F.col("object").alias("next")), "object")
    beyond = beyond.select("label", F.col("next").alias("object")).where("label <> object").distinct().join(pairs, ["label", "object"], "left_anti")
    targets = direct.groupBy("label").agg(F.array_sort(F.collect_set("object")).alias("targets"))
    out = asked.join(targets, "label").join(first, "label", "left").join(apart(beyond, "g2"), "label", "left")
    one, two = F.col("g1").isNotNull(), F.col("g2").isNotNull()
    kind = F.when(one, "d1").when(two, "d2").otherwise("lex")
    own = F.array("label")
    return out.select(
        F.concat("label", F.lit("::"), kind).alias("name"), "label", "query", F.coalesce("g1", "g2", "targets").alias("gold"),
        F.when(~one & two, F.concat(own, "targets")).otherwise(own).alias("seeds"), F.when(one, 1).when(two, 2).otherwise(0).alias("min_depth"),
    )
