"""Text lines: order of reading and recognition, priorities, budgets, merging."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import map_groups


def reading_keys(lines: DataFrame, score: str = "confidence", id_col: str = "evidence_id") -> list[Column]:
    """A total order: top to bottom, left to right, longer and taller first, surer first, then by id; NaN counts as least."""
    low = lambda c: F.when(F.isnan(c), F.lit(float("-inf"))).otherwise(F.col(c))
    return [low("y"), low("x"), -low("w"), -low("h"), -low(score), F.col(id_col)]


def with_priority(lines: DataFrame, rois: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """``lines`` with priority: the highest of the frame's ``rois`` (with priority) that a line overlaps, 0 if it overlaps none."""
    frame = frame or ["frame_id"]
    left = lines.alias("l")
    right = rois.alias("r")
    on = G.overlaps(G.Rect.of("l."), G.Rect.of("r."))
    for f in frame:
        on = (F.col(f"l.{f}") == F.col(f"r.{f}")) & on
    value = F.max(F.when(F.isnan("r.priority"), F.lit(float("-inf"))).otherwise(F.col("r.priority")))
    best = left.join(right, on).groupBy(*(F.col(f"l.{f}") for f in frame), F.col("l.evidence_id")).agg(value.alias("priority"))
    return lines.join(best, [*frame, "evidence_id"], "left").withColumn("priority", F.coalesce("priority", F.lit(0.0)))


def ordered(lines: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """``lines`` with reading_order and execution_order (by priority first) from 0."""
    frame = frame or ["frame_id"]
    keys = reading_keys(lines)
    reading = F.row_number().over(Window.partitionBy(*frame).orderBy(*keys)) - 1
    execution = F.row_number().over(Window.partitionBy(*frame).orderBy(F.desc("priority"), *keys)) - 1
    return lines.withColumn("reading_order", reading).withColumn("execution_order", execution)


def budgeted(lines: DataFrame, most: int, cost: str | None = None, budget: float | None = None, frame: list[str] | None = None) -> DataFrame:
    """``lines`` with state: the first ``most`` in execution order, as far as their running cost fits the budget, are recognized, all
    others deferred. No line is dropped."""
    frame = frame or ["frame_id"]
    told = ordered(lines, frame)
    fits = F.col("execution_order") < most
    if cost and budget is not None:
        fits = fits & (F.sum(cost).over(Window.partitionBy(*frame).orderBy("execution_order")) <= budget)
    return told.withColumn("state", F.when(fits, "recognized").otherwise("deferred"))


def report(states: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """Counts per frame, and why recognition stopped."""
    frame = frame or ["frame_id"]
    n = states.groupBy(*frame).agg(F.count(F.lit(1)).alias("detected"), F.count_if(F.col("state") == "recognized").alias("recognized"), F.count_if(F.col("state") == "deferred").alias("deferred"))
    return n.withColumn("stop_reason", F.when(F.col("deferred") > 0, "lineBudget").otherwise("none")).withColumn("complete", F.col("deferred") == 0)


def _merge(rows: list[tuple], offset: float, gap: float, separator: str) -> list[tuple]:
    """Each line, from the top left, takes in all lines level with its growing box, until none is left to take."""
    rest = [list(r) for r in rows]
    out = []
    while rest:
        frame, _, x, y, w, h, text, confidence = rest.pop(0)
        taken, grew = 1, True
        while grew:
            grew = False
            keep = []
            for other in rest:
                _, _, ox, oy, ow, oh, t, c = other
                low = min(h, oh)
                level = low > 0 and abs(y + h / 2 - oy - oh / 2) <= offset * low
                if level and max(0.0, max(x, ox) - min(x + w, ox + ow)) <= gap * low:
                    right, bottom = max(x + w, ox + ow), max(y + h, oy + oh)
                    x, y = min(x, ox), min(y, oy)
                    w, h = right - x, bottom - y
                    text, confidence, grew = text + separator + t, min(confidence, c), True
                    taken += 1
                else:
                    keep.append(other)
            rest = keep
        out.append((frame, len(out), x, y, w, h, text, confidence, taken))
    return out


def merge_lines(lines: DataFrame, offset: float = 0.5, gap: float = 1.0, separator: str = " ") -> DataFrame:
    """Lines of a frame merged into visual lines; texts are joined in the order of taking."""
    cols = lines.select("frame_id", "evidence_id", "x", "y", "w", "h", "text", "confidence")
    return map_groups(cols, ["frame_id"], ["y", "x", "evidence_id"], lambda rows: _merge(rows, offset, gap, separator), "frame_id long, line long, x double, y double, w double, h double, text string, confidence double, merged int")


def report_violations(states: DataFrame, reports: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """Frames whose report does not follow from their lines' states: other counts, a stop reason without deferred lines or none with them.
    Empty if all is well."""
    frame = frame or ["frame_id"]
    names = ["detected", "recognized", "deferred", "stop_reason", "complete"]
    again = report(states, frame).select(*frame, F.struct(*names).alias("want"))
    return reports.select(*frame, F.struct(*names).alias("got")).join(again, frame, "full").where(~F.col("got").eqNullSafe(F.col("want"))).select(*frame)
