"""The same state machines over streams: one keyed state per source or entity, rows of a batch in order of frames.

Each function takes a streaming DataFrame and returns one; the state's rules are those of the batch operators. Frames at or below
the last one seen are replays and change nothing.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import astuple

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from ocellus.operators.continuous import EVENTS, Entity, with_details
from ocellus.operators.ids import IdState, Region
from ocellus.operators.tracker import Track

_ENTITY = "open boolean, instance int, present int, present_since long, absent int, absent_since long, hidden int, hidden_since long, occluded boolean, seen array<string>, pending array<string>, pending_n int, pending_since long, last_seq long, state string"


def semantic_events(observations: DataFrame) -> DataFrame:
    """Events of every entity (source_id, stable_id, seq, observed and details) as they are confirmed."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        e = Entity(*state.get) if state.exists else Entity()
        e.seen, e.pending = tuple(e.seen), tuple(e.pending)
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            out += [(key[0], key[1], int(r.seq), kind, what, since, n) for kind, what, since, _, n in e.observe(int(r.seq), r.observed, (r.text, r.label, r.parents), bool(r.occluder), bool(r.lost), bool(r.notify))]
        state.update(tuple(list(v) if isinstance(v, tuple) else v for v in astuple(e)))
        yield pd.DataFrame(out, columns=["source_id", "stable_id", "seq", "kind", "what", "from_seq", "instance"])

    return with_details(observations).groupBy("source_id", "stable_id").applyInPandasWithState(step, EVENTS, _ENTITY, "append", GroupStateTimeout.NoTimeout)


def track_states(evidence: DataFrame) -> DataFrame:
    """State of every track after each graded observation (source_id, track_id, seq, grade)."""

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        t, last = Track(), -1
        if state.exists:
            t.state, t.streak, t.lost_seq, last = state.get
        out = []
        for r in pd.concat(list(batches)).sort_values("seq").itertuples():
            if r.seq > last:
                last = int(r.seq)
                t.commit(r.grade, last)
                out.append((key[0], key[1], last, t.state, t.streak, t.lost_seq))
        state.update((t.state, t.streak, t.lost_seq, last))
        yield pd.DataFrame(out, columns=["source_id", "track_id", "seq", "state", "streak", "lost_seq"])

    return evidence.groupBy("source_id", "track_id").applyInPandasWithState(step, "source_id long, track_id long, seq long, state string, streak int, lost_seq long", "state string, streak int, lost_seq long, last long", "append", GroupStateTimeout.NoTimeout)


def stable_ids(regions: DataFrame) -> DataFrame:
    """Stable ids of regions (source_id, seq, region_id, x, y, w, h, text) frame by frame; a frame must arrive whole in one batch."""
    kept = "xs array<double>, ys array<double>, ws array<double>, hs array<double>, texts array<string>, ids array<long>, next_id long, generation int, last_seq long"

    def step(key: tuple, batches: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        s, last = IdState(), -1
        if state.exists:
            xs, ys, ws, hs, texts, names, s.next_id, s.generation, last = state.get
            s.previous = [Region(*r) for r in zip(xs, ys, ws, hs, texts, names, strict=True)]
        out = []
        for seq, rows in pd.concat(list(batches)).sort_values(["seq", "region_id"]).groupby("seq"):
            if seq <= last:
                continue
            if last >= 0 and seq != last + 1:
                s.advance([])
            last = int(seq)
            events, _ = s.advance([Region(r.x, r.y, r.w, r.h, r.text or "") for r in rows.itertuples()])
            out += [(key[0], last, int(i), p.stable_id, e, s.generation) for i, p, e in zip(rows.region_id, s.previous, events, strict=True)]
        p = s.previous
        state.update(([r.x for r in p], [r.y for r in p], [r.w for r in p], [r.h for r in p], [r.text for r in p], [r.stable_id for r in p], s.next_id, s.generation, last))
        yield pd.DataFrame(out, columns=["source_id", "seq", "region_id", "stable_id", "event", "generation"])

    return regions.groupBy("source_id").applyInPandasWithState(step, "source_id long, seq long, region_id long, stable_id long, event string, generation int", kept, "append", GroupStateTimeout.NoTimeout)
