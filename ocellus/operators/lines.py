"""Line segments: filters, collinear merging, and regions proposed from closed outlines."""

from __future__ import annotations

import math

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import components, map_groups

ENDS = ("x0", "y0", "x1", "y1")
#: Context of a proposal as a share of its extent, and its least and most pixels.
CONTEXT_RATIO, CONTEXT_PIXELS = 0.25, (8.0, 64.0)


def described(segments: DataFrame) -> DataFrame:
    """``segments`` with length and angle (degrees in [0, 180))."""
    e = [F.col(c) for c in ENDS]
    return segments.withColumn("length", G.segment_length(*e)).withColumn("angle", G.segment_angle(*e))


def filter_segments(segments: DataFrame, min_length: float = 0.0, max_length: float = 0.0, min_angle: float = 0.0, max_angle: float = 0.0, min_confidence: float = 0.0) -> DataFrame:
    """Bounds apply if positive; an angle window whose first bound is above the second goes through 180."""
    told = described(segments)
    keep = (F.col("length") >= min_length) & (F.col("confidence") >= min_confidence)
    if max_length > 0:
        keep = keep & (F.col("length") <= max_length)
    if min_angle > 0 or max_angle > 0:
        low, high = F.col("angle") >= min_angle, F.col("angle") <= max_angle
        keep = keep & ((low | high) if min_angle > max_angle else (low & high))
    return told.where(keep)


class Line:
    """A segment with its direction, for merging."""

    def __init__(self, x0: float, y0: float, x1: float, y1: float, confidence: float):
        self.ends, self.confidence = ((x0, y0), (x1, y1)), confidence
        self.length = math.hypot(x1 - x0, y1 - y0)
        self.way = ((x1 - x0) / self.length, (y1 - y0) / self.length) if self.length else (1.0, 0.0)
        self.angle = math.degrees(math.atan2(y1 - y0, x1 - x0)) % 180

    def off(self, p: tuple[float, float]) -> float:
        (x, y), (ux, uy) = self.ends[0], self.way
        return abs((p[0] - x) * uy - (p[1] - y) * ux)

    def span(self, other: Line) -> tuple[float, float]:
        (x, y), (ux, uy) = self.ends[0], self.way
        return tuple(sorted((p[0] - x) * ux + (p[1] - y) * uy for p in other.ends))  # type: ignore[return-value]

    def takes(self, other: Line, angle: float, distance: float, gap: float) -> bool:
        turn = abs(self.angle - other.angle)
        if min(turn, 180 - turn) > angle or any(self.off(p) > distance for p in other.ends) or any(other.off(p) > distance for p in self.ends):
            return False
        (a, b), (c, d) = self.span(self), self.span(other)
        return max(c - b, a - d) <= gap

    def with_(self, other: Line) -> Line:
        (a, b), (c, d) = self.span(self), self.span(other)
        (x, y), (ux, uy) = self.ends[0], self.way
        low, high = min(a, c), max(b, d)
        return Line(x + ux * low, y + uy * low, x + ux * high, y + uy * high, max(self.confidence, other.confidence))


def merge_collinear(segments: DataFrame, angle: float = 2.0, distance: float = 1.5, gap: float = 4.0) -> DataFrame:
    """Each segment, in order, takes in all that continue it, again and again as it grows; segments without length go."""

    def run(rows: list[tuple]) -> list[tuple]:
        rest = [(r[1], Line(*r[2:])) for r in rows]
        rest = [x for x in rest if x[1].length > 0]
        out = []
        while rest:
            name, line = rest.pop(0)
            taken, grew = 1, True
            while grew:
                left = []
                for x in rest:
                    if line.takes(x[1], angle, distance, gap):
                        line, taken = line.with_(x[1]), taken + 1
                    else:
                        left.append(x)
                grew, rest = len(left) < len(rest), left
            (x0, y0), (x1, y1) = line.ends
            out.append((rows[0][0], name, x0, y0, x1, y1, line.confidence, taken))
        return out

    cols = segments.select("frame_id", "segment_id", *ENDS, "confidence")
    return map_groups(cols, ["frame_id"], ["segment_id"], run, "frame_id long, segment_id long, x0 double, y0 double, x1 double, y1 double, confidence double, merged int")


def endpoints(segments: DataFrame) -> DataFrame:
    """One row per end: frame_id, segment_id, slot (0 or 1), px, py."""
    ends = F.posexplode(F.array(F.struct(F.col("x0").alias("px"), F.col("y0").alias("py")), F.struct(F.col("x1").alias("px"), F.col("y1").alias("py")))).alias("slot", "p")
    return segments.select("frame_id", "segment_id", ends).select("frame_id", "segment_id", "slot", "p.px", "p.py")


#: Half of a cell's neighbours, and itself: each pair of near cells meets once.
_FORWARD = ((0, 0), (1, 0), (-1, 1), (0, 1), (1, 1))


def near_ends(segments: DataFrame, radius: float = 2.0) -> DataFrame:
    """Pairs of ends of different segments within ``radius``. Ends meet by grid cells of that size, in their own cell and in half of its
    neighbours, so the join has an equi-key however many segments a frame holds, and no pair is met twice."""
    ends = endpoints(segments).withColumn("cx", F.floor(F.col("px") / radius)).withColumn("cy", F.floor(F.col("py") / radius))
    steps = F.explode(F.array(*(F.struct(F.lit(dx).alias("dx"), F.lit(dy).alias("dy")) for dx, dy in _FORWARD))).alias("d")
    end = F.struct("segment_id", "slot", "px", "py")
    left = ends.select("frame_id", "cx", "cy", end.alias("a"))
    right = ends.select("frame_id", "cx", "cy", steps, end.alias("b")).select("frame_id", (F.col("cx") + F.col("d.dx")).alias("cx"), (F.col("cy") + F.col("d.dy")).alias("cy"), "b", ((F.col("d.dx") == 0) & (F.col("d.dy") == 0)).alias("own"))
    dx, dy = F.col("a.px") - F.col("b.px"), F.col("a.py") - F.col("b.py")
    order = F.col("a.segment_id") < F.col("b.segment_id")
    met = left.join(right, ["frame_id", "cx", "cy"]).where((F.col("a.segment_id") != F.col("b.segment_id")) & (~F.col("own") | order) & (dx * dx + dy * dy <= radius * radius))
    first, second = F.when(order, F.col("a")).otherwise(F.col("b")), F.when(order, F.col("b")).otherwise(F.col("a"))
    return met.select("frame_id", first["segment_id"].alias("first_id"), first["slot"].alias("first_slot"), second["segment_id"].alias("second_id"), second["slot"].alias("second_slot"))


def outlines(segments: DataFrame, radius: float = 2.0) -> DataFrame:
    """``segments`` with cluster: the smallest id of those connected with it by near ends."""
    found = components(near_ends(segments, radius).select("frame_id", "first_id", "second_id").distinct(), ["frame_id"], "first_id", "second_id").withColumnRenamed("id", "segment_id")
    return segments.join(found, ["frame_id", "segment_id"], "left").withColumn("cluster", F.coalesce("root", "segment_id")).drop("root")


def junctions(segments: DataFrame, radius: float = 2.0) -> DataFrame:
    """frame_id, segment_id, slot and junction: the smallest end (2 * segment + slot) of those that meet there."""
    ends = endpoints(segments).withColumn("end", 2 * F.col("segment_id") + F.col("slot"))
    edges = near_ends(segments, radius).select("frame_id", (2 * F.col("first_id") + F.col("first_slot")).alias("a"), (2 * F.col("second_id") + F.col("second_slot")).alias("b"))
    found = components(edges, ["frame_id"], "a", "b").withColumnRenamed("id", "end")
    return ends.join(found, ["frame_id", "end"], "left").withColumn("junction", F.coalesce("root", "end")).select("frame_id", "segment_id", "slot", "px", "py", "junction")


def propose(segments: DataFrame, radius: float = 2.0, min_segments: int = 3, min_closure: float = 0.75) -> DataFrame:
    """Regions from clusters of at least ``min_segments`` segments and three junctions that close well enough, in order of clusters: bounds, with
    and without context, closure, rectangularity and edge_support (the share of segments that meet another one).

    closure is 1 with a cycle (edges - junctions + 1 >= 1); with exactly two loose ends it is 1 - gap / diagonal; else 0.
    rectangularity is the length share along or across the dominant direction, from a mean over doubled angles."""
    told = described(outlines(segments, radius))
    ends = junctions(segments, radius).join(told.select("frame_id", "segment_id", "cluster"), ["frame_id", "segment_id"])
    loose = ends.groupBy("frame_id", "cluster", "junction").agg(F.count(F.lit(1)).alias("degree"), F.min(F.struct("px", "py")).alias("at"))
    shape = loose.groupBy("frame_id", "cluster").agg(F.count(F.lit(1)).alias("junctions"), F.collect_list(F.when(F.col("degree") == 1, F.col("at"))).alias("open"))
    c, s = F.cos(F.radians(2 * F.col("angle"))), F.sin(F.radians(2 * F.col("angle")))
    sums = told.groupBy("frame_id", "cluster").agg(F.count(F.lit(1)).alias("segments"), F.sum("length").alias("total"), F.sum(F.col("length") * c).alias("c"), F.sum(F.col("length") * s).alias("s"), F.min(F.least("x0", "x1")).alias("left"), F.min(F.least("y0", "y1")).alias("top"), F.max(F.greatest("x0", "x1")).alias("right"), F.max(F.greatest("y0", "y1")).alias("bottom"))
    both = sums.join(shape, ["frame_id", "cluster"])
    w, h = F.col("right") - F.col("left"), F.col("bottom") - F.col("top")
    gap = G.segment_length(F.col("open")[0]["px"], F.col("open")[0]["py"], F.col("open")[1]["px"], F.col("open")[1]["py"])
    diagonal = F.sqrt(w * w + h * h)
    closure = F.when(F.col("segments") - F.col("junctions") + 1 >= 1, F.lit(1.0)).when((F.size("open") == 2) & (diagonal > 0), F.greatest(1 - gap / diagonal, F.lit(0.0))).otherwise(F.lit(0.0))
    main = F.degrees(0.5 * F.atan2("s", "c"))
    both = both.withColumn("closure", closure).withColumn("main", main)
    turn = G.angle_difference(F.col("angle"), F.pmod(F.col("main"), F.lit(180.0)))
    aligned = told.join(both.select("frame_id", "cluster", "main", "total"), ["frame_id", "cluster"]).groupBy("frame_id", "cluster").agg((F.sum(F.when((turn <= 10) | (turn >= 80), F.col("length")).otherwise(0.0)) / F.nullif(F.first("total"), F.lit(0.0))).alias("rectangularity"))
    kept = both.where((F.col("segments") >= min_segments) & (F.col("junctions") >= 3) & (F.col("closure") >= min_closure)).join(aligned, ["frame_id", "cluster"])
    # A segment is supported if one of its ends meets an end of another segment.
    met = ends.groupBy("frame_id", "cluster", "junction").agg((F.min("segment_id") < F.max("segment_id")).alias("met"))
    supported = ends.join(met, ["frame_id", "cluster", "junction"]).groupBy("frame_id", "cluster", "segment_id").agg(F.max(F.col("met").cast("int")).alias("met")).groupBy("frame_id", "cluster").agg(F.avg("met").alias("edge_support"))
    kept = kept.join(supported, ["frame_id", "cluster"])
    box = G.enclosing(G.Rect(F.col("left"), F.col("top"), w, h))
    wide = G.context_bounds(box, CONTEXT_RATIO, *CONTEXT_PIXELS)
    shape = lambda r, mark: [v.cast("double").alias(f"{mark}{n}") for n, v in zip("xywh", (r.x, r.y, r.w, r.h), strict=True)]
    return kept.select("frame_id", "cluster", "segments", "junctions", "closure", F.coalesce("rectangularity", F.lit(0.0)).alias("rectangularity"), "edge_support", *shape(box, ""), *shape(wide, "context_"))


def hull(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """Convex hull, from the lowest point on, without points on its edges."""
    pts = sorted(set(points))
    if len(pts) < 3:
        return pts

    def half(seq):
        out: list[tuple[float, float]] = []
        for p in seq:
            while len(out) > 1 and (out[-1][0] - out[-2][0]) * (p[1] - out[-2][1]) <= (out[-1][1] - out[-2][1]) * (p[0] - out[-2][0]):
                out.pop()
            out.append(p)
        return out[:-1]

    return half(pts) + half(pts[::-1])


def oriented_box(points: list[tuple[float, float]]) -> tuple[float, float, float, float, float]:
    """Center, width, height and angle of the smallest rectangle around ``points``: one side lies on a hull edge; the first of equals counts."""
    h = hull(points)
    if not h:
        return 0.0, 0.0, 0.0, 0.0, 0.0
    best = None
    for (ax, ay), (bx, by) in zip(h, h[1:] + h[:1], strict=True):
        d = math.hypot(bx - ax, by - ay) or 1.0
        u = ((bx - ax) / d, (by - ay) / d) if len(h) > 1 else (1.0, 0.0)
        along, across = [x * u[0] + y * u[1] for x, y in h], [y * u[0] - x * u[1] for x, y in h]
        w, t = max(along) - min(along), max(across) - min(across)
        if best is None or w * t < best[0] - 1e-12:
            m, n = (max(along) + min(along)) / 2, (max(across) + min(across)) / 2
            best = (w * t, m * u[0] - n * u[1], m * u[1] + n * u[0], w, t, math.degrees(math.atan2(u[1], u[0])))
    return best[1:]


def oriented_boxes(segments: DataFrame, radius: float = 2.0) -> DataFrame:
    """Smallest oriented rectangle of each cluster of segments."""
    rows = outlines(segments, radius).select("frame_id", "cluster", *ENDS)
    fn = lambda g: [(*g[0][:2], *oriented_box([p for r in g for p in (r[2:4], r[4:6])]))]
    return map_groups(rows, ["frame_id", "cluster"], list(ENDS), fn, "frame_id long, cluster long, cx double, cy double, w double, h double, angle double")
