"""Verifying tracks against a frame: what their templates look like there, how their structure has changed, and what follows.

Pixels are read once, by :func:`windows`; everything after that is joins and aggregates over small thumbnails. A track has a pool
of templates, the first of which stays for good, and of negative ones; they are tables whose newest rows count.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import image as I
from ocellus.operators.visual_index import ncc

#: Templates kept (the first one is pinned), thumbnail side, thresholds of correlation, of the peak's height over the other
#: responses, of structure and of impostors; how far around a track is searched, by its diagonal, and bytes of work at most.
MOST_TEMPLATES, MOST_NEGATIVE, SIDE = 4, 4, 32
STRONG, WEAK, SIDELOBE, TOLERANCE, IMPOSTOR = 0.8, 0.6, 5.0, 0.2, 0.8
ROI_RATIO, WORK_BYTES = 1.0, 256 << 20
EPSILON = 1e-12
#: Bytes that a track, an observation and a template count in a pool, besides pixels; and records of redetection kept.
TRACK_BYTES, OBSERVATION_BYTES, TEMPLATE_BYTES, MOST_RECORDS = 128, 32, 64, 64


# -- pools -----------------------------------------------------------------------------------------------------------


def kept_templates(templates: DataFrame, most: int = MOST_TEMPLATES, pinned: int = 1) -> DataFrame:
    """Of each track's templates (source_id, track_id, added, px), the first ``pinned`` and the newest others, ``most`` in all, with
    their place from 0."""
    own = Window.partitionBy("source_id", "track_id")
    told = templates.withColumn("first", F.row_number().over(own.orderBy("added"))).withColumn("last", F.row_number().over(own.orderBy(F.desc("added"))))
    kept = told.where((F.col("first") <= pinned) | (F.col("last") <= most - pinned)).drop("first", "last")
    return kept.withColumn("place", F.row_number().over(own.orderBy("added")) - 1)


def baselines(records: DataFrame) -> DataFrame:
    """The structure last recorded of each track (source_id, track_id, seq, closure, rectangularity, edge_support); values outside
    0 to 1 are not recorded."""
    fine = F.lit(True)
    for c in ("closure", "rectangularity", "edge_support"):
        fine = fine & F.col(c).between(0, 1) & ~F.isnan(c)
    newest = F.max_by(F.struct("seq", "closure", "rectangularity", "edge_support"), "seq").alias("b")
    return records.where(fine).groupBy("source_id", "track_id").agg(newest).select("source_id", "track_id", "b.*")


def pool_bytes(observations: Column, templates: Column, side: int = SIDE) -> Column:
    """What a track with so many observations and templates (negative ones too) counts."""
    return F.lit(TRACK_BYTES) + OBSERVATION_BYTES * observations + (TEMPLATE_BYTES + side * side) * templates


def adopted(pool: DataFrame, fresh: DataFrame, most: int, budget: int) -> DataFrame:
    """The pool (source_id, track_id, state, last_verified, n_bytes) after one region a source (``fresh``: source_id, track_id, n_bytes) is
    adopted: with state evicted for those that had to make room, by number or bytes: terminated ones first, then those verified
    longest ago, then smaller ids. A region that is larger than the budget is refused and evicts none."""
    order = Window.partitionBy("source_id").orderBy(F.col("state") != "terminated", "last_verified", "track_id")
    every = Window.partitionBy("source_id")
    new = fresh.select("source_id", F.col("track_id").alias("new_id"), F.col("n_bytes").alias("new_bytes")).where(F.col("n_bytes") <= budget)
    told = pool.join(new, "source_id", "left").withColumn("before", F.row_number().over(order) - 1)
    freed = F.coalesce(F.sum("n_bytes").over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    # A track goes as long as those before it have not made room enough.
    crowded = F.count(F.lit(1)).over(every) - F.col("before") >= most
    heavy = F.sum("n_bytes").over(every) - freed + F.col("new_bytes") > budget
    gone = F.col("new_id").isNotNull() & (crowded | heavy)
    kept = told.select("source_id", "track_id", F.when(gone, "evicted").otherwise(F.col("state")).alias("state"), "last_verified", "n_bytes")
    return kept.unionByName(new.select("source_id", F.col("new_id").alias("track_id"), F.lit("tracking").alias("state"), F.lit(0).cast("long").alias("last_verified"), F.col("new_bytes").alias("n_bytes")))


def archived(tracks: DataFrame, ended: DataFrame) -> DataFrame:
    """``tracks`` where those in ``ended`` (source_id, track_id, seq) are terminated: they count no template or observation any more."""
    at = ended.groupBy("source_id", "track_id").agg(F.min("seq").alias("ended_seq"))
    told = tracks.join(at, ["source_id", "track_id"], "left")
    over = F.col("ended_seq").isNotNull()
    return told.withColumn("state", F.when(over, "terminated").otherwise(F.col("state"))).withColumn("n_bytes", F.when(over, F.lit(TRACK_BYTES)).otherwise(F.col("n_bytes")))


# -- the search in pixels --------------------------------------------------------------------------------------------


def covering(x: float, y: float, w: float, h: float, width: int, height: int) -> tuple[int, int, int, int] | None:
    """The whole pixels that a rectangle touches within an image, as x, y, w, h; None if there are none."""
    left, top = max(0, math.floor(x)), max(0, math.floor(y))
    right, bottom = min(width, math.ceil(x + w)), min(height, math.ceil(y + h))
    return (left, top, right - left, bottom - top) if left < right and top < bottom else None


def search_roi(bounds: tuple, center: tuple, width: int, height: int, ratio: float = ROI_RATIO) -> tuple[int, int, int, int] | None:
    """Where a track is looked for: its size around the predicted ``center``, half its diagonal times ``ratio`` wider to every side."""
    _, _, w, h = bounds
    m = ratio * math.hypot(w, h) / 2
    return covering(center[0] - w / 2 - m, center[1] - h / 2 - m, w + 2 * m, h + 2 * m, width, height)


def offsets(bounds: tuple, roi: tuple) -> list[tuple[int, int]]:
    """Whole steps that keep the window in ``roi``, row by row; only (0, 0) if none does."""
    x, y, w, h = bounds
    steps = [range(math.ceil(a - p), math.floor(a + size - p - q) + 1) for a, size, p, q in ((roi[0], roi[2], x, w), (roi[1], roi[3], y, h))]
    return [(dx, dy) for dy in steps[1] for dx in steps[0]] or [(0, 0)]


def planned_bytes(n_offsets: int, templates: int, bounds: tuple, pixel_bytes: int, side: int = SIDE) -> int:
    """Work of a search: each offset's window is copied and read, its thumbnail compared with each template, each response kept."""
    w, h = (max(1, math.ceil(v)) for v in bounds[2:])
    return n_offsets * (2 * w * h * pixel_bytes + side * side * (1 + 2 * templates) + 8 * templates)


def window_thumbnails(gray: np.ndarray, bounds: tuple, steps: list[tuple[int, int]], side: int = SIDE) -> list[np.ndarray | None]:
    """The thumbnail of the window at each step; None where it touches no pixel."""
    out = []
    for dx, dy in steps:
        spot = covering(bounds[0] + dx, bounds[1] + dy, bounds[2], bounds[3], gray.shape[1], gray.shape[0])
        out.append(None if spot is None else I.resize_area(I.crop(gray, *spot), side, side))
    return out


WINDOWS = "source_id long, track_id long, seq long, status string, dx int, dy int, px array<int>"


def windows(tracks: DataFrame, frames: DataFrame, side: int = SIDE, ratio: float = ROI_RATIO, budget: int = WORK_BYTES) -> DataFrame:
    """Thumbnails of every window in which tracks (source_id, track_id, seq, x, y, w, h, cx, cy: predicted center, templates: how many)
    are looked for in their frames (source_id, seq, data, width, height, stride, format). A track that cannot be looked for has one row
    with a status other than Ok and no window; terminated tracks and those without templates do not belong in ``tracks``."""
    cols = ["source_id", "track_id", "seq", "x", "y", "w", "h", "cx", "cy", "templates"]
    both = tracks.select(*(F.col(c).cast("double" if c in "xywh" or c in ("cx", "cy") else "long").alias(c) for c in cols)).join(frames.select("source_id", "seq", "data", "width", "height", "stride", "format"), ["source_id", "seq"])
    both = both.select(*cols, "data", "width", "height", "stride", "format")

    def look(row: tuple) -> list[tuple]:
        key, bounds, center, templates = row[:3], row[3:7], row[7:9], row[9]
        data, width, height, stride, fmt = row[10:]
        if not all(map(math.isfinite, bounds + center)) or bounds[2] <= 0 or bounds[3] <= 0:
            return [(*key, "InvalidArgument", 0, 0, None)]
        roi = search_roi(bounds, center, width, height, ratio)
        if roi is None:
            return [(*key, "InvalidArgument", 0, 0, None)]
        steps = offsets(bounds, roi)
        if planned_bytes(len(steps), templates, bounds, I.FORMATS[fmt][1], side) > budget:
            return [(*key, "BudgetExceeded", 0, 0, None)]
        thumbs = window_thumbnails(I.to_gray(I.unpack(data, width, height, stride, fmt), fmt), bounds, steps, side)
        if any(t is None for t in thumbs):
            return [(*key, "InvalidArgument", 0, 0, None)]
        return [(*key, "Ok", dx, dy, t.ravel().tolist()) for (dx, dy), t in zip(steps, thumbs, strict=True)]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kinds = [pa.int64()] * 3 + [pa.string(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
        for batch in batches:
            for i in range(batch.num_rows):
                rows = look(tuple(c[i].as_py() for c in batch.columns))
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*rows, strict=True), kinds, strict=True)], [x.split()[0] for x in WINDOWS.split(", ")])

    return both.mapInArrow(run, WINDOWS)


# -- verdicts --------------------------------------------------------------------------------------------------------


def responses(found: DataFrame, templates: DataFrame) -> DataFrame:
    """Correlation of every window (source_id, track_id, seq, dx, dy, px) with each of its track's templates (place, px)."""
    t = templates.select("source_id", "track_id", "place", F.col("px").alias("t_px"))
    return found.join(t, ["source_id", "track_id"]).select("source_id", "track_id", "seq", "place", "dx", "dy", ncc(F.col("px"), F.col("t_px")).alias("ncc"))


def peaks(told: DataFrame) -> DataFrame:
    """Of each template's responses the peak (the highest; of equals the nearest, then topmost, then leftmost) and psr: how many standard
    deviations of all others it stands above their mean."""
    key = ["source_id", "track_id", "seq", "place"]
    order = F.struct((-F.col("ncc")).alias("n"), F.greatest(F.abs("dx"), F.abs("dy")).alias("r"), "dy", "dx")
    best = F.row_number().over(Window.partitionBy(*key).orderBy(order)) == 1
    marked = told.withColumn("best", best)
    rest = F.when(~F.col("best"), F.col("ncc"))
    pick = lambda c: F.max(F.when(F.col("best"), F.col(c))).alias(c)
    found = marked.groupBy(*key).agg(pick("ncc"), pick("dx"), pick("dy"), F.coalesce(F.avg(rest), F.lit(0.0)).alias("mean"), F.coalesce(F.stddev_pop(rest), F.lit(0.0)).alias("spread"))
    return found.select(*key, "ncc", ((F.col("ncc") - F.col("mean")) / (F.col("spread") + EPSILON)).alias("psr"), "dx", "dy")


def appearance(found: DataFrame, strong: float = STRONG, weak: float = WEAK, sidelobe: float = SIDELOBE) -> DataFrame:
    """Each track's best template (by peak, then psr, then place) and its outcome: strong, weak or none; a peak that hardly stands out
    counts for nothing."""
    order = Window.partitionBy("source_id", "track_id", "seq").orderBy(F.desc("ncc"), F.desc("psr"), "place")
    top = found.withColumn("n", F.row_number().over(order)).where("n = 1").drop("n")
    sure = F.col("psr") >= sidelobe
    return top.withColumn("outcome", F.when(sure & (F.col("ncc") >= strong), "strong").when(sure & (F.col("ncc") >= weak), "weak").otherwise("none"))


def structure(now: DataFrame, base: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """``now`` (source_id, track_id, seq, closure, rectangularity, edge_support; nulls: not supplied) against the baselines: the largest of
    the relative deviations, and notSupplied, noBaseline, consistent or deviated."""
    parts = ("closure", "rectangularity", "edge_support")
    b = base.select("source_id", "track_id", *(F.col(c).alias(f"base_{c}") for c in parts))
    off = lambda c: F.abs(F.col(c) - F.col(f"base_{c}")) / F.greatest(F.abs(F.col(f"base_{c}")), F.lit(EPSILON))
    told = now.join(b, ["source_id", "track_id"], "left")
    given = F.col("closure").isNotNull() & F.col("rectangularity").isNotNull() & F.col("edge_support").isNotNull()
    most = F.when(given & F.col("base_closure").isNotNull(), F.greatest(*map(off, parts)))
    outcome = F.when(~given, "notSupplied").when(F.col("base_closure").isNull(), "noBaseline").when(F.col("deviation") <= tolerance, "consistent").otherwise("deviated")
    return told.withColumn("deviation", most).withColumn("structure", outcome).drop(*(f"base_{c}" for c in parts))


def impostors(patches: DataFrame, negatives: DataFrame, threshold: float = IMPOSTOR) -> DataFrame:
    """Of ``patches`` (source_id, track_id, seq, px) those that look like one of their track's negative templates."""
    on = (F.col("p.source_id") == F.col("n.source_id")) & (F.col("p.track_id") == F.col("n.track_id")) & (ncc(F.col("p.px"), F.col("n.px")) >= threshold)
    return patches.alias("p").join(negatives.alias("n"), on, "left_semi")


def level(appearance_outcome: Column, structure_outcome: Column) -> Column:
    """strong, weak or none: a consistent structure is strong evidence on its own."""
    return F.when((appearance_outcome == "strong") | (structure_outcome == "consistent"), "strong").when(appearance_outcome == "weak", "weak").otherwise("none")


def semantics_conflict(track_label: Column, label: Column) -> Column:
    """Both have a label, and not the same."""
    return (track_label != "") & (label != "") & (track_label != label)


# -- redetection -----------------------------------------------------------------------------------------------------


def redetections(attempts: DataFrame, most: int = 8, base: int = 1, longest: int = 60) -> DataFrame:
    """``attempts`` (source_id, track_id, seq, outcome: recaptured, associated or failed) with failures (in a row so far), due (frame of the
    next attempt after a failure, else null) and state: terminated from the ``most``-th failure in a row on, whatever comes later."""
    own = Window.partitionBy("source_id", "track_id").orderBy("seq")
    upto = own.rowsBetween(Window.unboundedPreceding, 0)
    failed = F.col("outcome") == "failed"
    told = attempts.withColumn("episode", F.sum((~failed).cast("int")).over(upto))
    told = told.withColumn("failures", F.sum(failed.cast("int")).over(Window.partitionBy("source_id", "track_id", "episode").orderBy("seq").rowsBetween(Window.unboundedPreceding, 0)).cast("int"))
    over = F.max((F.col("failures") >= most).cast("int")).over(upto) == 1
    wait = F.least(F.lit(base) * F.pow(F.lit(2.0), F.least(F.col("failures") - 1, F.lit(30))), F.lit(float(longest))).cast("long")
    state = F.when(over, "terminated").when(failed, "lost").otherwise("tracking")
    return told.withColumn("state", state).withColumn("due", F.when(failed & (F.col("state") == "lost"), F.col("seq") + wait)).drop("episode")


def record_log(records: DataFrame, most: int = MOST_RECORDS) -> DataFrame:
    """The newest ``most`` records of a source's log, with evicted: how many older ones it no longer holds."""
    newest = Window.partitionBy("source_id").orderBy(F.desc("seq"), F.desc("track_id"))
    n = F.count(F.lit(1)).over(Window.partitionBy("source_id"))
    return records.withColumn("age", F.row_number().over(newest)).withColumn("evicted", F.greatest(n - most, F.lit(0))).where(F.col("age") <= most).drop("age")
