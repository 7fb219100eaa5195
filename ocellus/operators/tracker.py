"""Tracks: gates, grades and state transitions."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import fold_groups

#: Streak of insufficient evidence that loses a track, lag of generations, backoff and attempts of redetection.
UNCERTAIN_LIMIT, GENERATION_LAG, BACKOFF_BASE, BACKOFF_MOST, ATTEMPTS = 5, 1, 1, 60, 8
LIVE = ("tracking", "uncertain")


def change_gate(tracks: DataFrame, frames: DataFrame, rois: DataFrame) -> DataFrame:
    """``tracks`` (source_id, seq, track_id, state, x, y, w, h) with verdict and roi: on an unchanged frame every track is reused, on a global
    change every one verified; on a partial change those are verified that a changed region overlaps, the first one in order counting.
    Terminated tracks are inactive."""
    told = tracks.join(frames.select("source_id", "seq", "classification"), ["source_id", "seq"])
    on = (F.col("t.source_id") == F.col("r.source_id")) & (F.col("t.seq") == F.col("r.seq")) & G.overlaps(G.Rect.of("t."), G.Rect.of("r."))
    hit = told.alias("t").join(rois.alias("r"), on).groupBy("t.source_id", "t.seq", "t.track_id").agg(F.min("r.roi").alias("roi"))
    both = told.join(hit, ["source_id", "seq", "track_id"], "left")
    verdict = F.when(F.col("state") == "terminated", "inactive").when(F.col("classification") == "none", "reuse").when(F.col("classification") == "global", "verify").when(F.col("roi").isNotNull(), "verify").otherwise("reuse")
    return both.withColumn("verdict", verdict).withColumn("roi", F.when(F.col("classification") == "partial", F.col("roi")))


def grade(level: Column, inside_gate: Column, generation_switch: Column, lost: Column, impostor: Column, conflict: Column) -> Column:
    """vetoed, confirmed, tentative or placeholder. A switch of generation, or a lost track, makes the position gate void."""
    gate = inside_gate | generation_switch | lost
    return F.when(impostor | conflict, "vetoed").when((level == "strong") & gate, "confirmed").when((level == "weak") & gate, "tentative").otherwise("placeholder")


def deep_combined(grade_col: Column, iou: Column, confidence: Column) -> Column:
    """A grade after a second opinion: agreement keeps it, disagreement takes one step off; null means no opinion."""
    agrees = (iou >= 0.5) & (confidence >= 0.5)
    lower = F.when(grade_col == "confirmed", "tentative").when(grade_col == "tentative", "placeholder").otherwise(grade_col)
    return F.when(iou.isNull() | agrees, grade_col).otherwise(lower)


def backoff(failure: Column) -> Column:
    """Frames to wait after the n-th failure in a row."""
    return F.least(F.lit(BACKOFF_BASE) * F.pow(F.lit(2.0), F.least(failure - 1, F.lit(30))), F.lit(float(BACKOFF_MOST))).cast("long")


def redetection_gate(rows: DataFrame) -> DataFrame:
    """``rows`` (state, classification, seq, failures, last_failure_seq) with verdict and wait."""
    due = F.coalesce(F.col("last_failure_seq") + backoff(F.greatest("failures", F.lit(1))), F.lit(0))
    due = F.when(F.col("failures") > 0, due).otherwise(F.lit(0))
    verdict = F.when(F.col("state") == "terminated", "rejected").when(F.col("state") != "lost", "inactive").when(F.col("classification") == "none", "holdStatic").when(F.col("seq") < due, "holdBackoff").otherwise("trigger")
    told = rows.withColumn("verdict", verdict)
    return told.withColumn("wait", F.when(F.col("verdict") == "holdBackoff", due - F.col("seq")).otherwise(F.lit(0)).cast("long"))


@dataclass
class Track:
    """A track's state; used by batch and streaming alike."""

    state: str = "tracking"
    streak: int = 0
    lost_seq: int = 0

    def commit(self, grade_: str, seq: int, limit: int = UNCERTAIN_LIMIT) -> None:
        if self.state == "terminated":
            raise ValueError("a terminated track takes no evidence")
        if grade_ in ("confirmed", "tentative"):
            self.state, self.streak, self.lost_seq = "tracking", 0, 0
        elif self.state != "lost":
            self.streak += 1
            lost = self.streak >= limit
            self.state, self.lost_seq = ("lost", seq) if lost else ("uncertain", self.lost_seq)


def commit(evidence: DataFrame, limit: int = UNCERTAIN_LIMIT) -> DataFrame:
    """source_id, track_id, seq, state, streak and lost_seq after each graded observation (source_id, track_id, seq, grade)."""

    def run(rows: Iterable[tuple]) -> Iterable[tuple]:
        track = Track()
        for source, name, seq, g in rows:
            track.commit(g, seq, limit)
            yield source, name, seq, track.state, track.streak, track.lost_seq

    cols = evidence.select("source_id", "track_id", "seq", "grade")
    return fold_groups(cols, ["source_id", "track_id"], ["seq"], run, "source_id long, track_id long, seq long, state string, streak int, lost_seq long")


def layout_generations(frames: DataFrame) -> DataFrame:
    """``frames`` (source_id, seq, classification) with layout_generation: one more after every global change."""
    order = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    return frames.withColumn("layout_generation", F.sum((F.col("classification") == "global").cast("long")).over(order))


def sweep(tracks: DataFrame, lag: int = GENERATION_LAG) -> DataFrame:
    """Uncertain tracks that lag behind the layout generation by more than ``lag`` are lost."""
    behind = (F.col("state") == "uncertain") & (F.col("layout_generation") - F.col("generation") > lag)
    return tracks.withColumn("state", F.when(behind, "lost").otherwise(F.col("state")))


def compensated(tracks: DataFrame, shifts: DataFrame, min_confidence: float = 0.5) -> DataFrame:
    """``tracks`` moved by all sure enough shifts of their source's frames since the one they were seen in (seq)."""
    sure = F.coalesce(F.col("confidence") >= min_confidence, F.lit(False))
    order = Window.partitionBy("source_id").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)
    path = shifts.select("source_id", "seq", F.sum(F.when(sure, F.col("dx")).otherwise(0)).over(order).alias("sx"), F.sum(F.when(sure, F.col("dy")).otherwise(0)).over(order).alias("sy"))
    now = path.groupBy("source_id").agg(F.max_by(F.struct("sx", "sy"), "seq").alias("now"))
    at = tracks.join(path, ["source_id", "seq"], "left").join(now, "source_id", "left")
    move = F.col("state") != "terminated"
    shift = lambda c, s: F.when(move, F.col(c) + F.coalesce(F.col(f"now.{s}") - F.coalesce(F.col(s), F.lit(0)), F.lit(0))).otherwise(F.col(c))
    return at.withColumn("x", shift("x", "sx")).withColumn("y", shift("y", "sy")).drop("sx", "sy", "now")


def evictions(tracks: DataFrame, most: int) -> DataFrame:
    """``tracks`` (source_id, track_id, state, last_verified) with evicted: beyond ``most`` a source, terminated ones go first, then those verified
    longest ago, then smaller ids."""
    order = Window.partitionBy("source_id").orderBy((F.col("state") != "terminated"), "last_verified", "track_id")
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    return tracks.withColumn("evicted", F.row_number().over(order) <= n - most)


def last_observations(rows: DataFrame, most: int = 32) -> DataFrame:
    """The ring of each track's latest observations."""
    order = Window.partitionBy("source_id", "track_id").orderBy(F.desc("seq"))
    return rows.withColumn("age", F.row_number().over(order)).where(F.col("age") <= most)
