"""Attention, coverage, work and confirmed semantic events."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import BudgetExceeded, fold_groups

#: Observations in a row that confirm, and the caps of a policy and of the event queue.
CONFIRM, MOST_CONDITIONS, MOST_EVENTS = 2, 64, 256
#: What a change of each axis (text, label, parents) is called, and an observation that says nothing.
CHANGES, NOTHING = ("textChanged", "appearanceChanged", "relationChanged"), ("", "", "")


# -- attention -------------------------------------------------------------------------------------------------------


def valid_condition() -> Column:
    """A criterion at least, a finite ROI without negative sizes, and a non-zero id where one is bound."""
    some = F.col("bind_stable_id") | (F.col("text_equals") != "") | (F.col("label_equals") != "") | ((F.col("roi_w") > 0) & (F.col("roi_h") > 0))
    return some & (F.col("roi_w") >= 0) & (F.col("roi_h") >= 0) & (~F.col("bind_stable_id") | (F.col("stable_id") != 0))


def checked_policy(conditions: DataFrame) -> DataFrame:
    """``conditions`` that are valid, or BudgetExceeded if the policy has more than it may: none is left out."""
    n = conditions.limit(MOST_CONDITIONS + 1).count()
    if n > MOST_CONDITIONS:
        raise BudgetExceeded(f"a policy has {MOST_CONDITIONS} conditions at most")
    return conditions.where(valid_condition())


def resolve(conditions: DataFrame, regions: DataFrame, frames: DataFrame) -> DataFrame:
    """Outcome of each condition (idx, ...) on each frame (source_id, seq, generation): its first criterion that is given decides: a bound
    id, then text and label, then the ROI itself. The first region in stored order (pos) counts."""
    asked = frames.crossJoin(F.broadcast(checked_policy(conditions)))  # at most 64 conditions
    by_id = F.col("bind_stable_id")
    by_words = ~by_id & ((F.col("text_equals") != "") | (F.col("label_equals") != ""))
    r = regions.select("source_id", "seq", F.struct("pos", "stable_id", "x", "y", "w", "h", "text", "label").alias("r"))
    fits = F.when(by_id, (F.col("r.stable_id") == F.col("stable_id")) & (F.col("generation") == F.col("bound_generation"))).when(by_words, ((F.col("text_equals") == "") | (F.col("r.text") == F.col("text_equals"))) & ((F.col("label_equals") == "") | (F.col("r.label") == F.col("label_equals")))).otherwise(F.lit(False))
    hits = asked.join(r, ["source_id", "seq"]).where(fits).groupBy("source_id", "seq", "idx").agg(F.min("r").alias("hit"))
    told = asked.join(hits, ["source_id", "seq", "idx"], "left")
    by_roi = ~by_id & ~by_words
    outcome = F.when(by_roi | F.col("hit").isNotNull(), "resolved").when(by_id & (F.col("generation") != F.col("bound_generation")), "staleGeneration").when(by_id, "unknownStableId").otherwise("notObserved")
    pick = lambda c, roi: F.when(by_roi, F.col(roi)).otherwise(F.col(f"hit.{c}"))
    return told.select("source_id", "seq", "idx", "priority", outcome.alias("outcome"), F.when(by_roi, F.lit(0)).otherwise(F.col("hit.stable_id")).cast("long").alias("focus_id"), *(pick(c, f"roi_{c}").alias(c) for c in "xywh"))


def plan_order(work: DataFrame) -> DataFrame:
    """``work`` (kind focus or bootstrap, priority, idx) with its place in the plan."""
    order = Window.partitionBy("source_id", "seq").orderBy(F.when(F.col("kind") == "focus", 0).otherwise(1), F.desc("priority"), "idx")
    return work.withColumn("place", (F.row_number().over(order) - 1).cast("long"))


def reconsiderations(rois: DataFrame, focuses: DataFrame) -> DataFrame:
    """Changed regions that no focus of their frame overlaps."""
    on = (F.col("c.source_id") == F.col("f.source_id")) & (F.col("c.seq") == F.col("f.seq")) & G.overlaps(G.Rect.of("c."), G.Rect.of("f."))
    return rois.alias("c").join(focuses.alias("f"), on, "left_anti")


# -- coverage --------------------------------------------------------------------------------------------------------


def refresh_coverage(entries: DataFrame, frames: DataFrame, rois: DataFrame) -> DataFrame:
    """``entries`` of a frame's ledger with reason: why each no longer counts, or null. In order: a layout change, another identity, a changed
    region on it, other content."""
    told = entries.join(frames.select("source_id", "seq", "classification", F.col("generation").alias("now_generation"), F.col("content").alias("now_content")), ["source_id", "seq"])
    on = (F.col("e.source_id") == F.col("r.source_id")) & (F.col("e.seq") == F.col("r.seq")) & G.overlaps(G.Rect.of("e."), G.Rect.of("r."))
    touched = told.alias("e").join(rois.alias("r"), on, "left_semi").select("source_id", "seq", "entry_id").withColumn("touched", F.lit(True))
    both = told.join(touched, ["source_id", "seq", "entry_id"], "left")
    reason = F.when(F.col("classification") == "global", "layoutChange").when(F.col("generation") != F.col("now_generation"), "identityChanged").when(F.col("touched"), "regionChanged").when(F.col("content") != F.col("now_content"), "contentMismatch")
    return both.withColumn("reason", reason).drop("touched")


def covered(regions: DataFrame, entries: DataFrame) -> DataFrame:
    """``regions`` with entry: the first ledger entry that holds each, or null."""
    on = (F.col("r.source_id") == F.col("e.source_id")) & (F.col("r.seq") == F.col("e.seq")) & G.contains(G.Rect.of("e."), G.Rect.of("r."))
    first = regions.alias("r").join(entries.alias("e"), on).groupBy("r.source_id", "r.seq", "r.region_id").agg(F.min("e.entry_id").alias("entry"))
    return regions.join(first, ["source_id", "seq", "region_id"], "left")


def upsert(entries: DataFrame, keys: list[str], version: str) -> DataFrame:
    """The latest entry for each key."""
    order = Window.partitionBy(*keys).orderBy(F.desc(version))
    return entries.withColumn("__n", F.row_number().over(order)).where("__n = 1").drop("__n")


# -- work tokens -----------------------------------------------------------------------------------------------------


def stale_reason(source: str, epoch: int, policy: int, generation: int, seq: int) -> Column:
    """Why a token no longer counts, the first reason in this order; null if it does."""
    return F.when(F.col("source_id") != source, "foreignSource").when(F.col("epoch") != epoch, "staleSourceEpoch").when(F.col("policy_revision") != policy, "stalePolicyRevision").when(F.col("generation") != generation, "staleGeneration").when(F.col("seq") != seq, "staleFrameSequence")


def accept(tokens: DataFrame, batch: list[str], **now) -> DataFrame:
    """``tokens`` with reason and accepted: a token that was never handed out counts as one of another frame; what is handed in twice, now
    or before (adopted, where there is such a column), is a duplicate; one whose ROI holds other pixels now (content_digest and
    now_digest) doesn't fit; a batch is accepted as a whole or not at all."""
    again = F.row_number().over(Window.partitionBy(*batch, "token_id").orderBy("token_id")) > 1
    if "adopted" in tokens.columns:
        again = again | F.col("adopted")
    other = F.col("content_digest") != F.col("now_digest") if "now_digest" in tokens.columns else F.lit(False)
    reason = F.coalesce(stale_reason(**now), F.when(~F.col("in_flight"), "staleFrameSequence"), F.when(again, "duplicateSubmission"), F.when(other, "contentMismatch"))
    told = tokens.withColumn("reason", reason)
    return told.withColumn("accepted", F.max(F.col("reason").isNotNull().cast("int")).over(Window.partitionBy(*batch)) == 0)


# -- confirmed state over time ---------------------------------------------------------------------------------------


@dataclass
class Entity:
    """What is known of one entity; used by batch and streaming alike. ``seen`` and ``pending`` are (text, label, parents)."""

    open: bool = False
    instance: int = 0
    present: int = 0
    present_since: int = 0
    absent: int = 0
    absent_since: int = 0
    hidden: int = 0
    hidden_since: int = 0
    occluded: bool = False
    seen: tuple = NOTHING
    pending: tuple = NOTHING
    pending_n: int = 0
    pending_since: int = 0
    last_seq: int = -1
    state: str = "unanalyzed"

    def observe(self, seq: int, observed: str, said: tuple = NOTHING, occluder: bool = False, lost: bool = False, notify: bool = True) -> list[tuple]:
        """One frame: present, absent, uncovered or reset. Returns the events it confirms: (kind, what, from, to, instance), where from is
        the first of the frames in a row that confirm it; a reset's are 0. A frame that is not newer than the last one changes
        nothing. Without ``notify`` the state moves on and only a reset is told."""
        if observed == "reset":
            log = [("end", "sourceReset", 0, 0, self.instance)] if self.open else []
            self.__init__()
            return log
        if seq <= self.last_seq:
            return []
        self.last_seq = seq
        if observed == "uncovered":
            self.present = self.absent = self.hidden = self.pending_n = 0
            self.state = "unanalyzed"
            log = []
        elif observed == "present":
            log = self._present(seq, said)
        else:
            log = self._absent(seq, occluder, lost)
        return [(*what, seq, self.instance) for what in log] if notify else []

    def _run(self, name: str, seq: int) -> int:
        """One more observation of a kind in a row: of the first one the frame is kept."""
        n = getattr(self, name) + 1
        setattr(self, name, n)
        if n == 1:
            setattr(self, f"{name}_since", seq)
        return n

    def _present(self, seq: int, said: tuple) -> list[tuple]:
        n = self._run("present", seq)
        self.absent = self.hidden = 0
        self.state = "observed"
        if not self.open:
            if n < CONFIRM:
                return []
            self.open, self.instance, self.seen, self.pending_n = True, self.instance + 1, said, 0
            return [("begin", "appeared", self.present_since)]
        log = []
        if self.occluded and n >= CONFIRM:
            self.occluded = False
            log.append(("update", "relationChanged", self.present_since))
        if said == self.seen:
            self.pending_n = 0
            return log
        if said != self.pending:
            self.pending_n = 0
        self.pending = said
        self.pending_n += 1
        if self.pending_n == 1:
            self.pending_since = seq
        if self.pending_n >= CONFIRM:
            log += [("update", what, self.pending_since) for what, old, new in zip(CHANGES, self.seen, said, strict=True) if old != new]
            self.seen, self.pending_n = said, 0
        return log

    def _absent(self, seq: int, occluder: bool, lost: bool) -> list[tuple]:
        self.present = self.pending_n = 0
        self.state = "trackingLost" if lost else "occluded"
        if lost:
            self.absent = self.hidden = 0
        elif occluder:
            self.absent = 0
            if self._run("hidden", seq) >= CONFIRM and self.open and not self.occluded:
                self.occluded = True
                return [("update", "relationChanged", self.hidden_since)]
        else:
            self.hidden = 0
            if self._run("absent", seq) >= CONFIRM and self.open:
                self.open = self.occluded = False
                self.state = "unanalyzed"
                return [("end", "disappeared", self.absent_since)]
        return []


EVENTS = "source_id long, stable_id long, seq long, kind string, what string, from_seq long, instance int"


def with_details(observations: DataFrame) -> DataFrame:
    """source_id, stable_id, seq, observed, text, label, parents (ids, as text), occluder, lost and notify, where missing or null: empty,
    false, and true for notify."""
    empty = {"text": "", "label": "", "parents": "", "occluder": False, "lost": False, "notify": True}
    had = lambda c: F.col(c) if c in observations.columns else F.lit(None)
    as_text = lambda c: F.concat_ws(",", F.array_sort(c)) if dict(observations.dtypes).get("parents", "").startswith("array") else had("parents").cast("string")
    details = [F.coalesce(as_text(c) if c == "parents" else had(c).cast("boolean" if isinstance(v, bool) else "string"), F.lit(v)).alias(c) for c, v in empty.items()]
    return observations.select("source_id", "stable_id", "seq", "observed", *details)


def semantic_events(observations: DataFrame) -> DataFrame:
    """Events of every entity from its observations (source_id, stable_id, seq, observed; see :func:`with_details`). A reset's event stands
    at its frame, with from_seq 0. Rows stream through, one entity's state at a time."""

    def run(rows: Iterable[tuple]) -> Iterable[tuple]:
        entity = Entity()
        for source, stable, seq, observed, text, label, parents, occluder, lost, notify in rows:
            for kind, what, since, _, instance in entity.observe(seq, observed, (text, label, parents), occluder, lost, notify):
                yield source, stable, seq, kind, what, since, instance

    return fold_groups(with_details(observations), ["source_id", "stable_id"], ["seq"], run, EVENTS)


def entity_states(observations: DataFrame) -> DataFrame:
    """The state of every entity after its last observation: open, instance, state, confirmed text and label, last_seq. A snapshot that
    queries can be answered from."""

    def run(rows: Iterable[tuple]) -> Iterable[tuple]:
        entity, key = Entity(), (0, 0)
        for source, stable, seq, observed, text, label, parents, occluder, lost, _ in rows:
            key = (source, stable)
            entity.observe(seq, observed, (text, label, parents), occluder, lost)
        yield *key, entity.open, entity.instance, entity.state, entity.seen[0], entity.seen[1], entity.last_seq

    ddl = "source_id long, stable_id long, open boolean, instance int, state string, text string, label string, last_seq long"
    return fold_groups(with_details(observations), ["source_id", "stable_id"], ["seq"], run, ddl)


def numbered(events: DataFrame) -> DataFrame:
    """``events`` with event_sequence: gap-free within a source, in order of frames."""
    order = Window.partitionBy("source_id").orderBy("seq", "stable_id", "kind", "what")
    return events.withColumn("event_sequence", F.row_number().over(order).cast("long"))


def event_violations(events: DataFrame) -> DataFrame:
    """Numbered events that cannot be: a gap in a source's sequence, a window that ends before it begins, an instance below 1, or an update or
    end of an instance that has not begun or is over. Empty if all is well."""
    own, of = Window.partitionBy("source_id").orderBy("event_sequence"), Window.partitionBy("source_id", "stable_id").orderBy("event_sequence")
    gap = F.col("event_sequence") - F.lag("event_sequence").over(own) != 1
    last = F.lag(F.struct("kind", "instance")).over(of)
    open_ = last.isNotNull() & (last["kind"] != "end") & (last["instance"] == F.col("instance"))
    fine = F.when(F.col("kind") == "begin", last.isNull() | (last["kind"] == "end")).otherwise(open_)
    problem = F.when(F.coalesce(gap, F.lit(False)), "gap").when(F.col("from_seq") > F.col("seq"), "window").when(F.col("instance") < 1, "instance").when(~fine, "order")
    return events.withColumn("problem", problem).where("problem is not null")


def undrained(events: DataFrame, drained: DataFrame) -> DataFrame:
    """Events that no drain has handed out yet (``drained``: source_id, event_sequence), in order of sources and sequence."""
    return events.join(drained.select("source_id", "event_sequence"), ["source_id", "event_sequence"], "left_anti").orderBy("source_id", "event_sequence")


def queued(events: DataFrame, most: int = MOST_EVENTS) -> DataFrame:
    """The newest ``most`` events a source holds until they are drained, with dropped: how many older ones made room."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("event_sequence"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    return events.withColumn("age", F.row_number().over(newest)).withColumn("dropped", F.greatest(n - most, F.lit(0))).where(F.col("age") <= most).drop("age")


def runs(observations: DataFrame) -> DataFrame:
    """Without state: first frame of each confirmed run of presence, by gaps and islands."""
    own = Window.partitionBy("source_id", "stable_id").orderBy("seq")
    marked = observations.withColumn("same", F.coalesce(F.lag("observed").over(own) == F.col("observed"), F.lit(False)))
    island = marked.withColumn("island", F.sum((~F.col("same")).cast("long")).over(own.rowsBetween(Window.unboundedPreceding, 0)))
    found = island.where("observed = 'present'").groupBy("source_id", "stable_id", "island").agg(F.min("seq").alias("first_seq"), F.count(F.lit(1)).alias("frames"))
    return found.where(F.col("frames") >= CONFIRM).drop("island")
