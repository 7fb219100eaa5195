"""A perception session as tables: fused regions with stable identities and generations, lookups in them, and what results weigh."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators import fusion, ids

#: Bytes that a cached result, a text line, a corner of its polygon and a detection count, besides their texts.
RESULT_BYTES, LINE_BYTES, CORNER_BYTES, DETECTION_BYTES = 32, 64, 8, 48


def snapshots(evidence: DataFrame, frames: DataFrame) -> DataFrame:
    """Regions of every frame as a session publishes them: evidence (frame_id, ...) fused, followed from frame to frame (``frames``:
    frame_id, source_id, seq), with stable_id and the generation of the source's identities."""
    fused = fusion.fuse(evidence).join(frames.select("frame_id", "source_id", "seq"), "frame_id")
    return fused.join(ids.track(fused).drop("event"), ["source_id", "seq", "region_id"])


def find_region(snapshot: DataFrame, stable_id: int) -> DataFrame:
    """The region of that identity; none for 0, which is no identity."""
    return snapshot.where((F.col("stable_id") == stable_id) & (F.lit(stable_id) != 0))


def generation_current(generation: Column, snapshot_generation: Column) -> Column:
    """Whether something bound to ``generation`` still holds."""
    return (generation != 0) & (generation == snapshot_generation)


def has_source(mask: Column, kind: str) -> Column:
    """Whether evidence of that kind is part of a region."""
    return mask.bitwiseAND(F.lit(fusion.SOURCE_BITS[kind])) != 0


def payload_bytes(lines: DataFrame, keys: list[str]) -> DataFrame:
    """What each cached result (``keys``) counts, from its rows: kind (text or detection), text, label, corners."""
    row = F.when(F.col("kind") == "text", LINE_BYTES + F.octet_length("text") + CORNER_BYTES * F.col("corners")).otherwise(DETECTION_BYTES + F.octet_length("label"))
    return lines.groupBy(*keys).agg((F.lit(RESULT_BYTES) + F.sum(row)).cast("long").alias("n_bytes"))


def within_budgets(work: DataFrame, keys: list[str], order: list, cost: str, soft: float, reserve: float, hard: float) -> DataFrame:
    """``work`` in order with state: done while what was spent before leaves the reserve of the soft budget untouched; the one that would go
    over the hard budget, and all after it, fail as timeouts; others are deferred. Costs stand in for time, so runs agree."""
    own = Window.partitionBy(*keys).orderBy(*order)
    before = F.coalesce(F.sum(cost).over(own.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0.0))
    told = work.withColumn("before", before)
    late = F.max((F.col("before") + F.col(cost) > hard).cast("int")).over(own.rowsBetween(Window.unboundedPreceding, 0)) == 1
    return told.withColumn("state", F.when(F.col("before") >= soft - reserve, "deferred").when(late, "timeout").otherwise("done")).drop("before")
