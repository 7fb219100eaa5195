"""A cycle of continuous perception: what each frame says about every entity known so far, and what a policy's conditions point at.

A frame's coverage entries are the areas that were analysed, its work ROIs those that are being analysed. Only within the former a
region counts as seen or as missing; within the latter that waits until the work is accepted; elsewhere nothing is known.
"""

from __future__ import annotations

import struct

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.functions.image import fnv1a, signed
from ocellus.operators.continuous import checked_policy

FRAME = ["source_id", "seq"]
_RECT = ("x", "y", "w", "h")
#: Bytes that an event, an entity and a token count, besides their texts, and those of a policy's texts at most.
EVENT_BYTES, ENTITY_BYTES, TOKEN_BYTES, POLICY_BYTES = 96, 256, 80, 16 << 20


def _first_holding(rows: DataFrame, areas: DataFrame, key: str, name: str) -> DataFrame:
    """``rows`` (source_id, seq, stable_id, x, y, w, h, ...) with ``name``: the smallest ``key`` of the frame's ``areas`` that hold each, or null."""
    a = areas.select(*FRAME, F.struct(F.col(key).alias("key"), *_RECT).alias("a"))
    held = rows.select(*FRAME, "stable_id", *_RECT).join(a, FRAME).where(G.contains(G.Rect.of("a."), G.Rect.of()))
    first = held.groupBy(*FRAME, "stable_id").agg(F.min("a.key").alias(name))
    return rows.join(first, [*FRAME, "stable_id"], "left")


def observations(frames: DataFrame, regions: DataFrame, entries: DataFrame, work: DataFrame, tracks: DataFrame | None = None) -> DataFrame:
    """What each of ``frames`` (source_id, seq) says about every entity that its source has shown until then: source_id, seq, stable_id,
    observed, occluder, lost, entry, work, the region's text and label, and bounds: where it is, or was last seen within coverage.

    observed is present, absent or uncovered; presentPending or absentPending where only a work ROI (idx) holds the bounds. An absent
    entity whose last place another region overlaps, or whose track (source_id, seq, track_id, state) is alive, is occluded; one
    whose track is lost is lost. Regions without a stable id (0) only occlude."""
    seen = regions.where(F.col("stable_id") != 0)
    born = seen.groupBy("source_id", "stable_id").agg(F.min("seq").alias("born"))
    asked = frames.select(*FRAME).distinct().join(born, "source_id").where(F.col("seq") >= F.col("born")).select(*FRAME, "stable_id")
    shown = _first_holding(seen.select(*FRAME, "stable_id", *(F.col(c).cast("double").alias(c) for c in _RECT), "text", "label"), entries, "entry_id", "here")
    told = asked.join(shown.withColumn("shown", F.lit(True)), [*FRAME, "stable_id"], "left")
    own = Window.partitionBy("source_id", "stable_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)
    known = F.last(F.when(F.col("shown") & F.col("here").isNotNull(), F.struct(*_RECT)), ignorenulls=True).over(own)
    told = told.withColumn("known", known)
    place = [F.when(F.col("shown"), F.col(c)).otherwise(F.coalesce(F.col(f"known.{c}"), F.lit(0.0))).alias(c) for c in _RECT]
    told = told.select(*FRAME, "stable_id", F.coalesce("shown", F.lit(False)).alias("shown"), "text", "label", *place)
    told = _first_holding(_first_holding(told, entries, "entry_id", "entry"), work, "idx", "work")
    missing = told.where(~F.col("shown"))
    r = regions.select(*FRAME, F.struct(*(F.col(c).cast("double").alias(c) for c in _RECT)).alias("r"))
    hidden = missing.select(*FRAME, "stable_id", *_RECT).join(r, FRAME).where(G.overlaps(G.Rect.of("r."), G.Rect.of())).select(*FRAME, "stable_id").distinct()
    told = told.join(hidden.withColumn("hidden", F.lit(True)), [*FRAME, "stable_id"], "left")
    if tracks is None:
        told = told.withColumn("state", F.lit(None).cast("string"))
    else:
        told = told.join(tracks.select(*FRAME, F.col("track_id").alias("stable_id"), "state"), [*FRAME, "stable_id"], "left")
    kind = F.when(F.col("shown"), "present").otherwise("absent")
    observed = F.when(F.col("entry").isNotNull(), kind).when(F.col("work").isNotNull(), F.concat(kind, F.lit("Pending"))).otherwise("uncovered")
    lost = ~F.col("shown") & F.coalesce(F.col("state") == "lost", F.lit(False))
    occluder = ~F.col("shown") & ~lost & (F.col("hidden").isNotNull() | F.coalesce(F.col("state").isin("tracking", "uncertain"), F.lit(False)))
    return told.select(*FRAME, "stable_id", observed.alias("observed"), occluder.alias("occluder"), lost.alias("lost"), "entry", F.when(F.col("entry").isNull(), F.col("work")).alias("work"), F.coalesce("text", F.lit("")).alias("text"), F.coalesce("label", F.lit("")).alias("label"), *_RECT)


def settled(told: DataFrame, accepted: DataFrame) -> DataFrame:
    """Observations after work was accepted (source_id, seq, idx): what waited for it is known now, what waited for other work is not."""
    done = accepted.select(*FRAME, F.col("idx").alias("work")).distinct().withColumn("done", F.lit(True))
    both = told.join(done, [*FRAME, "work"], "left")
    waits = F.col("observed").endswith("Pending")
    now = F.when(~waits, F.col("observed")).when(F.col("done"), F.regexp_replace("observed", "Pending$", "")).otherwise("uncovered")
    return both.withColumn("observed", now).select(*told.columns)


def coverage_complete(frames: DataFrame, regions: DataFrame, entries: DataFrame) -> DataFrame:
    """``frames`` with complete: there is a coverage entry, and every region lies in one."""
    some = entries.select(*FRAME).distinct().withColumn("some", F.lit(True))
    on = (F.col("r.source_id") == F.col("e.source_id")) & (F.col("r.seq") == F.col("e.seq")) & G.contains(G.Rect.of("e."), G.Rect.of("r."))
    bare = regions.alias("r").join(entries.alias("e"), on, "left_anti").select(*FRAME).distinct().withColumn("bare", F.lit(True))
    both = frames.select(*FRAME).distinct().join(some, FRAME, "left").join(bare, FRAME, "left")
    return both.select(*FRAME, (F.col("some").isNotNull() & F.col("bare").isNull()).alias("complete"))


# -- policies --------------------------------------------------------------------------------------------------------


def policy_digest(conditions: list[dict], max_bytes: int = POLICY_BYTES) -> int:
    """Digest of a policy's conditions in order: roi (four 32-bit floats), space, whether an id is bound, the id, its generation, texts with
    their length."""
    raw = struct.pack("<QQ", len(conditions), max_bytes)
    for c in conditions:
        raw += struct.pack("<4f4Q", *(c.get(f"roi_{k}", 0.0) for k in _RECT), c.get("roi_space", 0), bool(c.get("bind_stable_id")), c.get("stable_id", 0), c.get("bound_generation", 0))
        for k in ("text_equals", "label_equals"):
            text = (c.get(k) or "").encode()
            raw += struct.pack("<Q", len(text)) + text
    return signed(fnv1a(raw))


def policy_revisions(settings: DataFrame) -> DataFrame:
    """``settings`` (source_id, set_at, digest) with revision: one more where the digest differs from the one set before, 1 at first."""
    own = Window.partitionBy("source_id").orderBy("set_at")
    moved = F.coalesce(F.lag("digest").over(own) != F.col("digest"), F.lit(True))
    return settings.withColumn("moved", moved.cast("long")).withColumn("revision", F.sum("moved").over(own.rowsBetween(Window.unboundedPreceding, 0))).drop("moved")


def with_tracks(resolved: DataFrame, conditions: DataFrame, tracks: DataFrame) -> DataFrame:
    """Outcomes of conditions on frames, where an id that a frame doesn't show is looked for among the tracks (source_id, seq, track_id,
    state, x, y, w, h): a living track resolves it with its place, a lost one has no place, others change nothing."""
    bound = F.broadcast(checked_policy(conditions).where("bind_stable_id").select("idx", F.col("stable_id").alias("track_id")))
    t = tracks.select(*FRAME, "track_id", F.col("state").alias("t_state"), F.struct(*_RECT).alias("t"))
    both = resolved.join(bound, "idx", "left").join(t, [*FRAME, "track_id"], "left")
    open_ = (F.col("outcome") == "unknownStableId") & F.col("t_state").isNotNull()
    found = open_ & F.col("t_state").isin("tracking", "uncertain")
    outcome = F.when(found, "resolved").when(open_ & (F.col("t_state") == "lost"), "missingLocalization").otherwise(F.col("outcome"))
    place = [F.when(found, F.col(f"t.{c}")).otherwise(F.col(c)).alias(c) for c in _RECT]
    return both.select(*FRAME, "idx", "priority", outcome.alias("outcome"), F.when(found, F.col("track_id")).otherwise(F.col("focus_id")).alias("focus_id"), *place)


def focus_states(conditions: DataFrame, states: DataFrame) -> DataFrame:
    """Which entities each condition points at, from their confirmed states alone (source_id, stable_id, generation, open, text, label, space,
    x, y, w, h): source_id, idx, outcome and stable_ids. An id must be of its generation; texts, labels and ROIs only count open
    entities."""
    asked = states.select("source_id").distinct().crossJoin(F.broadcast(checked_policy(conditions)))  # at most 64 conditions
    by_id = F.col("bind_stable_id")
    by_words = ~by_id & ((F.col("text_equals") != "") | (F.col("label_equals") != ""))
    s = states.select("source_id", F.struct(*(c for c in states.columns if c != "source_id")).alias("s"))
    words = ((F.col("text_equals") == "") | (F.col("s.text") == F.col("text_equals"))) & ((F.col("label_equals") == "") | (F.col("s.label") == F.col("label_equals")))
    roi = G.Rect(*(F.col(f"roi_{c}") for c in _RECT))
    fits = F.when(by_id, F.col("s.stable_id") == F.col("stable_id")).when(by_words, F.col("s.open") & words).otherwise(F.col("s.open") & (F.col("s.space") == F.col("roi_space")) & G.overlaps(G.Rect.of("s."), roi))
    hits = asked.join(s, "source_id").where(fits).groupBy("source_id", "idx").agg(F.array_sort(F.collect_list("s.stable_id")).alias("ids"), F.max("s.generation").alias("generation"))
    told = asked.join(hits, ["source_id", "idx"], "left")
    stale = by_id & F.col("ids").isNotNull() & (F.col("generation") != F.col("bound_generation"))
    outcome = F.when(stale, "staleGeneration").when(F.col("ids").isNotNull(), "resolved").when(by_id, "unknownStableId").otherwise("notObserved")
    return told.select("source_id", "idx", outcome.alias("outcome"), F.when(outcome == "resolved", F.col("ids")).otherwise(F.array().cast("array<bigint>")).alias("stable_ids"))


# -- bytes -----------------------------------------------------------------------------------------------------------


def coordination_bytes(events: Column, entities: Column, tokens: Column, texts: Column) -> Column:
    """What a source's state counts: events in the queue, entities, tokens handed out, and the bytes of all texts held."""
    return EVENT_BYTES * events + ENTITY_BYTES * entities + TOKEN_BYTES * tokens + texts


def queued_by_bytes(events: DataFrame, most_bytes: int, most: int, size: str = "n_bytes") -> DataFrame:
    """The newest events that fit in ``most_bytes`` and ``most`` of a source, with dropped: how many older ones made room. An event larger than
    the budget is dropped itself, and with it all before it."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("event_sequence")).rowsBetween(Window.unboundedPreceding, 0)
    told = events.withColumn("held", F.sum(size).over(newest)).withColumn("age", F.count(F.lit(1)).over(newest))
    told = told.withColumn("kept", (F.col("held") <= most_bytes) & (F.col("age") <= most))
    return told.withColumn("dropped", F.sum((~F.col("kept")).cast("long")).over(Window.partitionBy("source_id"))).where("kept").drop("held", "age", "kept")
