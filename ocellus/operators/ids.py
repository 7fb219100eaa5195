"""Stable identities of regions from frame to frame of a source."""

from __future__ import annotations

import math
from collections.abc import Iterable
from dataclasses import dataclass, field
from itertools import groupby

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.functions import text as X
from ocellus.operators.grouping import fold_groups, map_groups

MATCH_IOU, CENTER_GATE, RETENTION = 0.3, 0.5, 0.5
WEIGHT_IOU, WEIGHT_CENTER, WEIGHT_TEXT = 0.5, 0.3, 0.2
MOST_REGIONS = 4096


def match_candidates(regions: DataFrame) -> DataFrame:
    """Pairs of a region and one of the frame before it (source_id, seq; ids prev_id and cur_id) that pass the gate, with cost.

    The frame before is an equi-key of the join, so no candidate crosses sources or skips a frame."""
    text = X.truncated(X.normalize(F.coalesce("text", F.lit(""))))
    rows = regions.select("source_id", "seq", F.struct("region_id", *(F.col(c).cast("double").alias(c) for c in "xywh"), text.alias("text")).alias("r"))
    prev = rows.select("source_id", (F.col("seq") + 1).alias("seq"), F.col("r").alias("p"))
    both = prev.join(rows.withColumnRenamed("r", "c"), ["source_id", "seq"])
    p, c = G.Rect.of("p."), G.Rect.of("c.")
    iou, away, radius = G.iou(p, c), G.center_distance(p, c), CENTER_GATE * p.diagonal
    told = both.withColumn("iou", iou).withColumn("away", away).withColumn("radius", radius).where((F.col("iou") >= MATCH_IOU) | (F.col("away") <= F.col("radius")))
    near = F.when(F.col("radius") > 0, 1 - F.col("away") / F.col("radius")).otherwise(F.lit(0.0))
    spoken = (F.col("p.text") != "") & (F.col("c.text") != "")
    base = WEIGHT_IOU * (1 - F.col("iou")) + WEIGHT_CENTER * (1 - near)
    cost = F.when(spoken, (base + WEIGHT_TEXT * (1 - X.similarity(F.col("p.text"), F.col("c.text")))) / (WEIGHT_IOU + WEIGHT_CENTER + WEIGHT_TEXT)).otherwise(base / (WEIGHT_IOU + WEIGHT_CENTER))
    return told.select("source_id", "seq", F.col("p.region_id").alias("prev_id"), F.col("c.region_id").alias("cur_id"), "iou", cost.alias("cost"))


def greedy(pairs: Iterable[tuple[float, int, int]]) -> dict[int, int]:
    """One-to-one matches cur -> prev, cheapest first; ties by prev, then cur."""
    taken, out = set(), {}
    for _, prev, cur in sorted(pairs):
        if prev not in taken and cur not in out:
            taken.add(prev)
            out[cur] = prev
    return out


def assign(candidates: DataFrame) -> DataFrame:
    """The greedy one-to-one choice among ``candidates`` of each frame."""
    cols = candidates.select("source_id", "seq", "cost", "prev_id", "cur_id")
    fn = lambda rows: [(rows[0][0], rows[0][1], p, c) for c, p in greedy(r[2:] for r in rows).items()]
    return map_groups(cols, ["source_id", "seq"], ["cost", "prev_id", "cur_id"], fn, "source_id long, seq long, prev_id long, cur_id long", most=1 << 22)


@dataclass
class Region:
    x: float
    y: float
    w: float
    h: float
    text: str = ""
    stable_id: int = 0

    def center_in(self, other: Region) -> bool:
        cx, cy = self.x + self.w / 2, self.y + self.h / 2
        return other.x <= cx < other.x + other.w and other.y <= cy < other.y + other.h

    def iou(self, other: Region) -> float:
        w = min(self.x + self.w, other.x + other.w) - max(self.x, other.x)
        h = min(self.y + self.h, other.y + other.h) - max(self.y, other.y)
        both = max(0.0, w) * max(0.0, h)
        union = self.w * self.h + other.w * other.h - both
        return both / union if union > 0 else 0.0


def _distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row[0] = row[0], i
        for j, y in enumerate(b, 1):
            last, row[j] = row[j], min(row[j] + 1, row[j - 1] + 1, last + (x != y))
    return row[-1]


def cost(prev: Region, cur: Region) -> float | None:
    """Cost of a match, or None outside the gate; the same rule as :func:`match_candidates`."""
    iou = prev.iou(cur)
    away = math.sqrt((prev.x + prev.w / 2 - cur.x - cur.w / 2) ** 2 + (prev.y + prev.h / 2 - cur.y - cur.h / 2) ** 2)
    radius = CENTER_GATE * math.sqrt(prev.w**2 + prev.h**2)
    if iou < MATCH_IOU and away > radius:
        return None
    near = 1 - away / radius if radius > 0 else 0.0
    total, weight = WEIGHT_IOU * (1 - iou) + WEIGHT_CENTER * (1 - near), WEIGHT_IOU + WEIGHT_CENTER
    if prev.text and cur.text:
        a, b = prev.text.encode(), cur.text.encode()
        total += WEIGHT_TEXT * (1 - (1.0 - _distance(a, b) / max(len(a), len(b))))
        weight += WEIGHT_TEXT
    return total / weight


@dataclass
class IdState:
    """A source's tracker: what the last frame held, and the next free id. Used by batch and streaming alike."""

    previous: list[Region] = field(default_factory=list)
    next_id: int = 1
    generation: int = 0

    def advance(self, current: list[Region], confirmed: dict[int, int] | None = None) -> tuple[list[str], dict]:
        """Give ids to ``current``. ``confirmed`` (index -> stable id) matches are made first; those naming an unknown id are
        left to the gate. Returns each region's event and the frame's tallies."""
        confirmed = confirmed or {}
        if len(set(confirmed.values())) < len(confirmed) or any(i >= len(current) or s == 0 for i, s in confirmed.items()):
            raise ValueError("confirmed matches must name distinct non-zero ids and regions of the frame")
        place = {r.stable_id: i for i, r in enumerate(self.previous)}
        match = {c: place[s] for c, s in confirmed.items() if s in place}
        used = set(match.values())
        pairs = [(k, p, c) for p, a in enumerate(self.previous) for c, b in enumerate(current) if c not in match and (k := cost(a, b)) is not None]
        match |= greedy(x for x in pairs if x[1] not in used)
        left = [r for i, r in enumerate(self.previous) if i not in set(match.values())]
        events = []
        for i, r in enumerate(current):
            if i in match:
                r.stable_id = self.previous[match[i]].stable_id
                events.append("retained")
            else:
                r.stable_id, self.next_id = self.next_id, self.next_id + 1
                events.append("new")
        merges = splits = 0
        for i, r in enumerate(current):  # merges before splits: only what is still new can be a child
            if events[i] == "new" and sum(p.center_in(r) for p in left) >= 2:
                events[i] = "merged"
                merges += 1
        for p in left:
            children = [i for i, r in enumerate(current) if events[i] == "new" and r.center_in(p)]
            if len(children) >= 2:
                splits += 1
                for i in children:
                    events[i] = "splitChild"
        retained = len(match)
        bump = bool(splits or merges or (self.previous and retained < RETENTION * len(self.previous)))
        self.generation = self.generation + 1 if bump or self.generation == 0 else self.generation
        self.previous = current
        return events, {"retained": retained, "new": len(current) - retained, "merges": merges, "splits": splits, "bump": bump}


def _folded(regions: DataFrame, out, ddl: str) -> DataFrame:
    """``out`` (state, rows of the frame, events, tallies -> rows) of each frame of every source in order; a source's frames stream
    through, one held at a time."""
    text = X.truncated(X.normalize(F.coalesce("text", F.lit(""))))
    cols = regions.select("source_id", "seq", "region_id", *(F.col(c).cast("double").alias(c) for c in "xywh"), text.alias("text"))

    def run(rows: Iterable[tuple]) -> Iterable[tuple]:
        state, last = IdState(), None
        for seq, frame in groupby(rows, key=lambda r: r[1]):
            held = list(frame)
            if last is not None and seq != last + 1:
                state.advance([])  # a frame without regions came between
            last = seq
            events, tallies = state.advance([Region(*r[3:]) for r in held])
            yield from out(state, held, events, tallies)

    return fold_groups(cols, ["source_id"], ["seq", "region_id"], run, ddl)


def track(regions: DataFrame) -> DataFrame:
    """source_id, seq, region_id, stable_id, event and generation of every region (source_id, seq, region_id, x, y, w, h, text)."""
    out = lambda s, rows, events, _: [(*r[:3], p.stable_id, e, s.generation) for r, p, e in zip(rows, s.previous, events, strict=True)]
    return _folded(regions, out, "source_id long, seq long, region_id long, stable_id long, event string, generation int")


def tallied(regions: DataFrame) -> DataFrame:
    """source_id, seq, retained, fresh, merges, splits, bump and generation of every frame that has regions."""
    out = lambda s, rows, _, t: [(*rows[0][:2], t["retained"], t["new"], t["merges"], t["splits"], t["bump"], s.generation)]
    return _folded(regions, out, "source_id long, seq long, retained long, fresh long, merges long, splits long, bump boolean, generation int")


def generations(tallies: DataFrame) -> DataFrame:
    """Generation of each frame from its bump flag: 1 at first, one more at every bump."""
    order = Window.partitionBy("source_id").orderBy("seq")
    step = F.when(F.lag("seq").over(order).isNull() | F.col("bump"), 1).otherwise(0)
    return tallies.withColumn("step", step).withColumn("generation", F.sum("step").over(order.rowsBetween(Window.unboundedPreceding, 0))).drop("step")


def swallowed(fresh: DataFrame, left: DataFrame) -> DataFrame:
    """How many unmatched regions of the frame before (``left``, seq already that of the next frame) have their center in each fresh one."""
    on = (F.col("n.source_id") == F.col("p.source_id")) & (F.col("n.seq") == F.col("p.seq")) & G.center_inside(G.Rect.of("n."), G.Rect.of("p."))
    return fresh.alias("n").join(left.alias("p"), on).groupBy("n.source_id", "n.seq", "n.region_id").agg(F.count(F.lit(1)).alias("swallowed"))
