"""Belief revision as sets of requests: new table versions, outcomes and journal events.

Where several requests name one row, the one of the lowest seq wins and the rest conflict. Nothing reads a
clock: every function takes ``now``.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from recollect.sources.shared import saved


def apply_puts(memories: DataFrame, puts: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memories, events): each put (seq, scope, category, text, valid_from?, known_at?) as a first version, with an assert event."""
    made = puts.select(
        F.concat(F.lit("p"), F.sha2(F.concat_ws("\u0000", "scope", "category", "text", F.col("seq").cast("string")), 256)).alias("id"),
        "scope", "category", "text", F.coalesce("valid_from", now).alias("valid_from"), F.coalesce("known_at", now).alias("known_at"),
        now.alias("sys_created"), F.lit(1).cast("long").alias("version"),
    )
    events = made.select("scope", F.col("id").alias("memory_id"), F.lit("assert").alias("kind"), now.alias("at_sys"), "version")
    return memories.unionByName(made, allowMissingColumns=True), events


def keyed_put_outcomes(puts: DataFrame, slots: DataFrame | None = None) -> DataFrame:
    """(seq, scope, key, status, first_seq) of keyed puts (seq, scope, key, identity).

    The first request of a key creates; the same identity replays it; another one conflicts. ``slots``
    (scope, key, identity, erased) are keys taken before: an erased target is unavailable.
    """
    first = puts.groupBy("scope", "key").agg(F.min_by("identity", "seq").alias("first_identity"), F.min("seq").alias("first_seq"))
    rows = puts.join(first, ["scope", "key"])
    if slots is None:
        rows = rows.withColumns({"slot_identity": F.lit(None).cast("string"), "erased": F.lit(None).cast("boolean")})
    else:
        rows = rows.join(slots.select("scope", "key", F.col("identity").alias("slot_identity"), "erased"), ["scope", "key"], "left")
    holder = F.coalesce("slot_identity", "first_identity")
    status = (
        F.when(F.col("identity") != holder, "idempotency_conflict").when(F.coalesce("erased", F.lit(False)), "unavailable")
        .when(F.col("slot_identity").isNull() & (F.col("seq") == F.col("first_seq")), "created").otherwise("replayed")
    )
    return rows.select("seq", "scope", "key", status.alias("status"), F.when(F.col("slot_identity").isNull(), F.col("first_seq")).alias("first_seq"))


def apply_keyed_puts(memories: DataFrame, puts: DataFrame, slots: DataFrame, now: Column) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, slots, outcomes) of keyed puts (seq, scope, key, identity, category, text): what is created gives a row and takes its key's slot."""
    outcomes = keyed_put_outcomes(puts, slots)
    made = puts.join(outcomes.where("status = 'created'").select("seq", "scope", "key"), ["seq", "scope", "key"], "left_semi")
    first_version = [now.alias("valid_from"), now.alias("known_at"), now.alias("sys_created"), F.lit(1).cast("long").alias("version")]
    rows = made.select(F.concat(F.lit("k"), F.sha2(F.concat_ws("\u0000", "scope", "key"), 256)).alias("id"), "scope", "category", "text", *first_version)
    taken = made.select("scope", "key", "identity", F.lit(False).alias("erased"))
    return memories.unionByName(rows, allowMissingColumns=True), slots.select("scope", "key", "identity", "erased").unionByName(taken), outcomes


def revision_events(outcomes: DataFrame, kind: str, now: Column, key: str = "id") -> DataFrame:
    """Journal rows (scope, memory_id, kind, at_sys, version) of the requests with status ok: supersede, forget; version is the one that the change made."""
    won = outcomes.where("status = 'ok'")
    return won.select("scope", F.col(key).alias("memory_id"), F.lit(kind).alias("kind"), now.alias("at_sys"), (F.col("expected_version") + 1).alias("version"))


def erase_vectors(staged: DataFrame, ids: DataFrame) -> DataFrame:
    """``staged`` vectors (id, generation, embedding, ...) less those of erased rows, of whatever generation."""
    return staged.join(ids.select("id").distinct(), "id", "left_anti")


def request_identity(*columns: str) -> Column:
    """A digest of a whole request before defaults; nulls differ from empty texts."""
    return F.sha2(F.to_json(F.struct(*sorted(columns)), {"ignoreNullFields": "false"}), 256)


def _single_winner(checked: DataFrame, key: str = "id") -> DataFrame:
    """``checked`` with status: its reason, or ok for the lowest seq of a row, or conflict."""
    order = Window.partitionBy(key).orderBy(F.col("reason").isNotNull(), "seq")
    first = F.row_number().over(order) == 1
    return checked.withColumn("status", F.when(F.col("reason").isNotNull(), F.col("reason")).when(first, "ok").otherwise("conflict"))


def _of_row(memories: DataFrame, column: str) -> Column:
    """A column of ``memories``, or null where it has none."""
    return F.col(column) if column in memories.columns else F.lit(None).cast("string")


def _first_versions(made: DataFrame, memories: DataFrame) -> DataFrame:
    """``memories`` and the rows ``made``, which have category, known_at and sys_created only where ``memories`` has them."""
    optional = [c for c in ("category", "known_at", "sys_created") if c not in memories.columns]
    return memories.unionByName(made.drop(*optional), allowMissingColumns=True)


def supersede_outcomes(requests: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    """``requests`` (seq, prior_id, scope, expected_version, close_at?, new_valid_from?) with status and close_time."""
    return _judged(requests, memories, now).drop("_category")


def _judged(requests: DataFrame, memories: DataFrame, now: Column) -> DataFrame:
    prior = memories.select(
        _of_row(memories, "category").alias("_category"), F.col("id").alias("prior_id"), F.col("scope").alias("_scope"), F.col("version").alias("_version"), F.col("valid_from").alias("_from"),
        (F.col("valid_until").isNotNull() | F.col("sys_closed").isNotNull() | F.col("superseded_by").isNotNull()).alias("_closed"),
    )
    rows = requests.join(prior, "prior_id", "left").withColumn("close_time", F.coalesce("close_at", "new_valid_from", now))
    reason = (
        F.when(F.col("_version").isNull(), "not_found").when(F.col("scope") != F.col("_scope"), "scope_denied")
        .when(F.col("expected_version") != F.col("_version"), "version_conflict").when(F.col("_closed"), "already_closed")
        .when(F.col("close_time") < F.col("_from"), "invalid_interval")
    )
    return _single_winner(rows.withColumn("reason", reason), "prior_id").drop("_scope", "_version", "_from", "_closed", "reason")


def apply_supersedes(requests: DataFrame, memories: DataFrame, now: Column) -> tuple[DataFrame, DataFrame]:
    """(memories, outcomes): closed priors with their next version, and first versions of what supersedes them.

    A first version has the request's category and new_known_at, if it has them, else the prior's category and
    ``now``; it is in the system from ``now`` on, so that known-time and system-time lenses see it.
    """
    outcomes = _judged(requests, memories, now)
    won = outcomes.where("status = 'ok'")
    new_id = F.concat("prior_id", F.lit("+"), F.col("seq"))
    closing = won.select(F.col("prior_id").alias("id"), F.col("close_time").alias("_close"), new_id.alias("_by"))
    hit = F.col("_close").isNotNull()
    joined = memories.join(closing, "id", "left")
    priors = joined.select(
        *[
            F.when(hit, value).otherwise(F.col(c)).alias(c)
            if (value := {"valid_until": F.col("_close"), "sys_closed": now, "version": F.col("version") + 1, "superseded_by": F.col("_by")}.get(c)) is not None
            else F.col(c)
            for c in memories.columns
        ]
    )
    given = lambda c, default: F.coalesce(c, default) if c in requests.columns else default
    made = won.select(
        new_id.alias("id"), "scope", "text", F.coalesce("new_valid_from", "close_time").alias("valid_from"), F.col("prior_id").alias("supersedes"),
        F.lit(1).cast("long").alias("version"), given("category", F.col("_category")).alias("category"), given("new_known_at", now).alias("known_at"), now.alias("sys_created"),
    )
    return _first_versions(made, priors), outcomes.drop("_category")


def soft_forget_outcomes(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """``requests`` (seq, id, scope, expected_version?, at) with status; a row closes once."""
    own = memories.select("id", F.col("scope").alias("_scope"), F.col("version").alias("_version"), F.col("valid_from").alias("_from"), (F.col("valid_until").isNotNull() | F.col("sys_closed").isNotNull()).alias("_closed"))
    rows = requests.join(own, "id", "left")
    reason = (
        F.when(F.col("_version").isNull(), "not_found").when(F.col("scope") != F.col("_scope"), "scope_denied")
        .when(F.col("expected_version") != F.col("_version"), "version_conflict").when(F.col("_closed"), "already_closed")
        .when(F.col("at") < F.col("_from"), "invalid_interval")
    )
    return _single_winner(rows.withColumn("reason", reason)).drop("_scope", "_version", "_from", "_closed", "reason")


def apply_soft_forgets(requests: DataFrame, memories: DataFrame) -> tuple[DataFrame, DataFrame]:
    outcomes = soft_forget_outcomes(requests, memories)
    closing = outcomes.where("status = 'ok'").select("id", F.col("at").alias("_at"))
    hit = F.col("_at").isNotNull()
    joined = memories.join(closing, "id", "left")
    changed = joined.withColumns(
        {"valid_until": F.when(hit, F.col("_at")).otherwise(F.col("valid_until")), "sys_closed": F.when(hit, F.col("_at")).otherwise(F.col("sys_closed")),
         "version": F.when(hit, F.col("version") + 1).otherwise(F.col("version"))}
    )
    return changed.select(memories.columns), outcomes


def apply_hard_erases(memories: DataFrame, edges: DataFrame, ids: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, edges, events): rows go, edges that touch them are purged, events keep id and version."""
    gone = ids.select("id").distinct()
    events = memories.join(gone, "id", "left_semi").select(F.col("id").alias("memory_id"), F.lit("erase").alias("kind"), "version")
    ends = edges.join(gone.select(F.col("id").alias("subject"), F.lit(True).alias("_s")), "subject", "left").join(
        gone.select(F.col("id").alias("object"), F.lit(True).alias("_o")), "object", "left"
    )
    touched = F.col("_s").isNotNull() | F.col("_o").isNotNull()
    purged = ends.withColumn("state", F.when(touched, "purged").otherwise(F.col("state"))).withColumn("state_reason", F.when(touched, "endpoint_erased").otherwise(_of_row(edges, "state_reason")))
    return memories.join(gone, "id", "left_anti"), purged.drop("_s", "_o"), events


def _merged(old: Column, new: Column) -> Column:
    """A JSON object with the keys of both, those of ``new`` first; ``new`` itself where one of them is no object."""
    a, b = (F.from_json(c, "map<string,variant>") for c in (old, new))  # variants keep numbers, objects and nulls as they are
    both = F.map_concat(F.map_filter(a, lambda k, _: ~F.map_contains_key(b, k)), b)
    by_key = lambda x, y: F.when(x["key"] < y["key"], -1).when(x["key"] > y["key"], 1).otherwise(0)
    text = F.to_json(F.map_from_entries(F.array_sort(F.map_entries(both), by_key)))
    return F.when(new.isNull(), old).when(a.isNull() | b.isNull(), new).otherwise(text)


def apply_annotations(requests: DataFrame, memories: DataFrame, now: Column, attrs_bytes: int = 4096) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, outcomes, events) of annotations (seq, id, scope, expected_version?, attrs?, confidence?, provenance_source?, provenance_kind?, bump_version?).

    attrs are merged key by key, at the top only, and come out with sorted keys; request keys win, whatever
    their values (null stays null). What a request leaves null stays as it is. The row must exist in the
    request's scope and have the expected version, and merged attrs must fit; of several good requests for a
    row the lowest seq wins, the rest conflict. bump_version (by default true) advances the version. Columns
    that ``memories`` lacks aren't added, others are kept. An event tells each change.
    """
    own = memories.select("id", F.col("scope").alias("_scope"), F.col("version").alias("_version"), F.col("attrs").alias("_attrs"))
    rows = requests.join(own, "id", "left").withColumn("_merged", _merged(F.col("_attrs"), F.col("attrs")))
    reason = (
        F.when(F.col("_version").isNull(), "not_found").when(F.col("scope") != F.col("_scope"), "scope_denied")
        .when(F.col("expected_version") != F.col("_version"), "version_conflict").when(F.octet_length("_merged") > attrs_bytes, "attrs_too_large")
    )
    outcomes = _single_winner(rows.withColumn("reason", reason))
    bump = F.coalesce("bump_version", F.lit(True))
    won = outcomes.where("status = 'ok'").withColumn("_new_version", F.col("_version") + F.when(bump, 1).otherwise(0))
    given = {"attrs": "_merged", "version": "_new_version", **{c: c for c in ("confidence", "provenance_source", "provenance_kind")}}
    given = {c: source for c, source in given.items() if c in memories.columns}
    changes = won.select("id", *[F.col(source).alias(f"_to_{c}") for c, source in given.items()])
    changed = memories.join(changes, "id", "left").select(*[F.coalesce(f"_to_{c}", c).alias(c) if c in given else c for c in memories.columns])
    events = won.select("scope", F.col("id").alias("memory_id"), F.lit("annotate").alias("kind"), now.alias("at_sys"), F.col("_new_version").alias("version"), bump.alias("bump"))
    return changed, outcomes.select("seq", "id", "status"), events


def version_conflicts(requests: DataFrame, memories: DataFrame) -> DataFrame:
    """(seq, id, expected, found) where an expected version isn't the found one."""
    met = requests.join(memories.select("id", F.col("version").alias("found")), "id")
    return met.where(F.col("expected_version") != F.col("found")).select("seq", "id", F.col("expected_version").alias("expected"), "found")


def history(memories: DataFrame, ids: DataFrame, steps: int = 64) -> DataFrame:
    """(asked, id, pos) of each asked id's chain within ``steps`` each way: predecessors below 0, itself 0, successors above.

    Pointers double: after r rounds a row knows the rows up to 2^r away, so 64 steps take 6 joins, which both
    directions share. A round's pointers are written only while an asked row's chain goes on.
    """
    links = F.explode(F.array(F.struct(F.lit(-1).alias("sign"), F.col("supersedes").alias("b")), F.struct(F.lit(1).alias("sign"), F.col("superseded_by").alias("b"))))
    hop = memories.select(F.col("id").alias("a"), links.alias("l")).select("a", "l.sign", "l.b").where("b IS NOT NULL")
    signs = F.explode(F.array(F.lit(-1), F.lit(1))).alias("sign")
    found = ids.select(F.col("id").alias("asked"), "id", F.lit(0).alias("pos"), signs)
    hop, width = saved(hop, "hops"), 1
    while width <= steps:
        ahead = found.join(hop.withColumnRenamed("a", "id"), ["id", "sign"]).select("asked", F.col("b").alias("id"), (F.col("pos") + width).alias("pos"), "sign")
        ahead = saved(ahead, "chain")
        if ahead.isEmpty():
            break  # no asked row's chain is that long
        found = found.unionByName(ahead)
        width *= 2
        if width <= steps:
            hop = saved(hop.join(hop.select(F.col("a").alias("b"), F.col("b").alias("c"), "sign"), ["b", "sign"]).select("a", "sign", F.col("c").alias("b")), "hops")
    own = memories.join(ids.select("id").distinct(), "id", "left_semi").select(F.col("id").alias("asked"), "id", F.lit(0).alias("pos"))
    met = found.where((F.col("pos") > 0) & (F.col("pos") <= steps))
    return own.unionByName(met.select("asked", "id", (F.col("pos") * F.col("sign")).alias("pos")))


def belief_events(events: DataFrame, ids: DataFrame, kinds: tuple[str, ...]) -> DataFrame:
    """Journal rows of the asked ids, bare or prefixed, of known kinds, numbered by at_sys."""
    bare = lambda c: F.regexp_replace(c, "^memory:", "")
    asked = ids.select(bare("id").alias("memory_id")).distinct()
    rows = events.where(F.col("kind").isin(*kinds)).withColumn("memory_id", bare("memory_id")).join(asked, "memory_id")
    return rows.withColumn("pos", F.row_number().over(Window.partitionBy("memory_id").orderBy("at_sys", "event_id")))


def stale_dependents(memories: DataFrame, derived: DataFrame, closed: DataFrame) -> DataFrame:
    """Ids derived (derived: id, source) from a closed row (closed: id, scope) of their own scope."""
    of = derived.join(closed.select(F.col("id").alias("source"), F.col("scope").alias("_scope")), "source")
    return of.join(memories.select("id", "scope"), "id").where(F.col("scope") == F.col("_scope")).select("id").distinct()


def stale_edges(edges: DataFrame, closed: DataFrame) -> DataFrame:
    """``edges`` with active derived_from ones that touch a closed row marked stale."""
    ids = closed.select("id").distinct()
    rows = edges.join(ids.select(F.col("id").alias("subject"), F.lit(True).alias("_s")), "subject", "left").join(
        ids.select(F.col("id").alias("object"), F.lit(True).alias("_o")), "object", "left"
    )
    hit = (F.col("state") == "active") & (F.col("predicate") == "derived_from") & (F.col("_s").isNotNull() | F.col("_o").isNotNull())
    return rows.withColumn("state_reason", F.when(hit, "endpoint_superseded").otherwise(_of_row(edges, "state_reason"))).withColumn("state", F.when(hit, "stale").otherwise(F.col("state"))).drop("_s", "_o")


def op_outcomes(ops: DataFrame, hard_allowed: bool = False) -> DataFrame:
    """``ops`` (batch_id, idx, op, hard, failed) with status and applied: what follows a batch's first failure isn't attempted.

    Hard forgets become soft ones unless the policy allows them.
    """
    first = F.min(F.when(F.col("failed"), F.col("idx"))).over(Window.partitionBy("batch_id"))
    status = F.when(first.isNull() | (F.col("idx") < first), "ok").when(F.col("idx") == first, "failed").otherwise("not_attempted")
    kind = F.when((F.col("op") == "forget") & F.col("hard"), "hard_forget" if hard_allowed else "soft_forget").when(F.col("op") == "forget", "soft_forget").otherwise(F.col("op"))
    return ops.withColumn("status", status).withColumn("applied", F.when(status == "ok", kind))


def apply_ops(memories: DataFrame, ops: DataFrame, now: Column, hard_allowed: bool = False) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(memories, outcomes, events) of ordered batches of ops (batch_id, idx, op, id?, scope, text?, expected_version?, hard?).

    An op fails with a reason: unknown_op; empty_text of a put or supersede; of a supersede or forget, not_found,
    scope_denied, version_conflict or already_closed, by the table as it is before all batches. Of the good
    ones for a row, the one of the least (batch_id, idx) holds it and the rest fail as conflict, whether or
    not that one is attempted. What follows a batch's first failure isn't attempted; see ``op_outcomes``.
    The rest is applied as a set: puts and supersedes make first versions (ids b<batch>-<idx>), supersedes and
    soft forgets close a row with its next version, hard forgets take it away. Each change has an event, a
    supersede one for either row. Other columns of ``memories`` (id, scope, text, valid_from, valid_until,
    sys_closed, superseded_by, supersedes, version) stay; new rows have the op's category, by default that of
    the superseded row, and are known and in the system from ``now`` on; what else they lack is null.
    """
    own = memories.select(
        F.col("id"), F.col("scope").alias("_scope"), F.col("version").alias("_version"), _of_row(memories, "category").alias("_category"),
        (F.col("valid_until").isNotNull() | F.col("sys_closed").isNotNull() | F.col("superseded_by").isNotNull()).alias("_closed"),
    )
    rows = ops.join(own, "id", "left")
    writes, targets = F.col("op").isin("put", "supersede"), F.col("op").isin("supersede", "forget")
    reason = (
        F.when(~F.col("op").isin("put", "supersede", "forget", "noop") | F.col("op").isNull(), "unknown_op").when(writes & (F.trim(F.coalesce("text", F.lit(""))) == ""), "empty_text")
        .when(targets & F.col("_version").isNull(), "not_found").when(targets & (F.col("scope") != F.col("_scope")), "scope_denied")
        .when(targets & (F.col("expected_version") != F.col("_version")), "version_conflict").when(targets & F.col("_closed"), "already_closed")
    )
    rows = rows.withColumn("reason", reason)
    holder = F.row_number().over(Window.partitionBy("id", targets, F.col("reason").isNull()).orderBy("batch_id", "idx")) == 1
    rows = rows.withColumn("reason", F.when(targets & F.col("reason").isNull() & ~holder, "conflict").otherwise(F.col("reason")))
    rows = op_outcomes(rows.withColumn("failed", F.col("reason").isNotNull()).withColumn("hard", F.coalesce("hard", F.lit(False))), hard_allowed)
    rows = saved(rows.withColumn("new_id", F.when(writes, F.concat(F.lit("b"), "batch_id", F.lit("-"), "idx"))), "applied")
    done = rows.where("status = 'ok' AND applied <> 'noop'")
    changes = done.where(targets).select("id", F.col("applied").alias("_applied"), F.col("new_id").alias("_by"))
    closes = F.col("_applied").isin("supersede", "soft_forget")
    new = {"valid_until": now, "sys_closed": now, "version": F.col("version") + 1, "superseded_by": F.col("_by")}
    left = memories.join(changes, "id", "left").where(F.col("_applied").isNull() | closes)
    left = left.select(*[F.when(closes, new[c]).otherwise(F.col(c)).alias(c) if c in new else c for c in memories.columns])
    category = F.when(F.col("op") == "supersede", F.col("_category"))
    category = F.coalesce("category", category) if "category" in ops.columns else category
    made = done.where(writes).select(
        F.col("new_id").alias("id"), "scope", "text", now.alias("valid_from"), F.when(F.col("op") == "supersede", F.col("id")).alias("supersedes"), F.lit(1).cast("long").alias("version"),
        category.alias("category"), now.alias("known_at"), now.alias("sys_created"),
    )
    kinds = F.array_compact(F.array(F.when(writes, F.struct(F.col("new_id").alias("memory_id"), F.lit("assert").alias("kind"), F.lit(1).cast("long").alias("version"))), F.when(
        targets, F.struct(F.col("id").alias("memory_id"), F.when(F.col("applied") == "supersede", "supersede").when(F.col("applied") == "soft_forget", "forget").otherwise("erase").alias("kind"), (F.col("_version") + F.when(F.col("applied") == "hard_forget", 0).otherwise(1)).alias("version")))))
    events = done.select("scope", F.explode(kinds).alias("e")).select("scope", "e.*", now.alias("at_sys"))
    return _first_versions(made, left), rows.select("batch_id", "idx", "status", "reason", "applied"), events


def fold_task_state(ops: DataFrame) -> DataFrame:
    """(scope, slot, seq, status, version) of compare-and-set writes (scope, slot, seq, body, expected_version?, create_only?) in seq order.

    A slot's writes are one ordered fold: create_only succeeds on a fresh slot alone, an expected version
    must be the current one, others always advance it; bodies must be JSON objects of at most 8192 bytes.
    Slots are dealt out and sorted by Spark and pass by one write at a time: a task holds one slot's version,
    however long its log. An order is one task's work, so a hot slot is one task.
    """
    good = F.coalesce(F.trim("body").startswith("{") & (F.octet_length("body") <= 8192), F.lit(False))
    rows = ops.select("scope", "slot", "seq", good.alias("good"), "expected_version", F.coalesce("create_only", F.lit(False)).alias("create_only"))
    dealt = rows.repartition("scope", "slot").sortWithinPartitions("scope", "slot", "seq")

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        slot, version = None, 0
        for batch in batches:
            statuses, versions = [], []
            for *key, good, expected, fresh in zip(*(batch.column(c).to_pylist() for c in ("scope", "slot", "good", "expected_version", "create_only"))):
                if key != slot:
                    slot, version = key, 0
                if not good:
                    status = "invalid_body"
                elif fresh and version > 0:
                    status = "exists"
                elif expected is not None and expected != version:
                    status = "version_conflict"
                else:
                    status, version = "ok", version + 1
                statuses.append(status)
                versions.append(version)
            columns = [*(batch.column(c) for c in ("scope", "slot", "seq")), pa.array(statuses, pa.string()), pa.array(versions, pa.int64())]
            yield pa.RecordBatch.from_arrays(columns, ["scope", "slot", "seq", "status", "version"])

    return dealt.mapInArrow(fold, "scope string, slot string, seq long, status string, version long")
