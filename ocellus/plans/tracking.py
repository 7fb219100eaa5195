"""Queries over segments, tracks, attention, coverage, caches and marks, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ocellus.functions import digest
from ocellus.operators import cache, change, continuous, cycle, lines, render, tracker, verification
from ocellus.plans.perception import SHIFTS as _SHIFTS
from ocellus.runtime import table
from ocellus.sources import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(fn):
        QUERIES[fn.__name__] = fn
        if sql:
            ORACLE_SQL[fn.__name__] = sql
        return fn

    return add


# -- segments --------------------------------------------------------------------------------------------------------

_SEG = f"sg AS ({fx.SEGMENTS}), ds AS (SELECT *, sqrt((x1 - x0) * (x1 - x0) + (y1 - y0) * (y1 - y0)) AS length, degrees(atan2(y1 - y0, x1 - x0)) AS angle FROM sg)"
_ENDS = f"""{_SEG}, en AS (SELECT frame_id, segment_id, 0 AS slot, x0 AS px, y0 AS py FROM sg UNION ALL SELECT frame_id, segment_id, 1, x1, y1 FROM sg),
ne AS (SELECT a.frame_id, a.segment_id AS first_id, a.slot AS first_slot, b.segment_id AS second_id, b.slot AS second_slot FROM en a JOIN en b ON a.frame_id = b.frame_id AND a.segment_id < b.segment_id AND (a.px - b.px) * (a.px - b.px) + (a.py - b.py) * (a.py - b.py) <= 16)"""


@query(f"WITH {_SEG} SELECT frame_id, segment_id, round(length, 9) AS length FROM ds WHERE length >= 4 AND confidence >= 0.25 AND (angle >= 80 OR angle <= 30)")
def filtered_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.filter_segments(fx.segments(spark, sf_dir), 4.0, 0.0, 80.0, 30.0, 0.25).select("frame_id", "segment_id", F.round("length", 9).alias("length"))


@query(f"WITH {_ENDS} SELECT * FROM ne")
def near_ends(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.near_ends(fx.segments(spark, sf_dir), 4.0)


@query(
    f"""WITH RECURSIVE {_ENDS}, lk AS (SELECT DISTINCT frame_id, first_id AS a, second_id AS b FROM ne UNION SELECT DISTINCT frame_id, second_id, first_id FROM ne),
    reach(frame_id, id, other) AS (SELECT frame_id, segment_id, segment_id FROM sg UNION SELECT r.frame_id, r.id, l.b FROM reach r JOIN lk l ON r.frame_id = l.frame_id AND r.other = l.a)
    SELECT frame_id, id AS segment_id, min(other) AS cluster FROM reach GROUP BY ALL"""
)
def segment_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.outlines(fx.segments(spark, sf_dir), 4.0).select("frame_id", "segment_id", "cluster")


@query(
    f"""WITH RECURSIVE {_ENDS}, lk AS (SELECT frame_id, 2 * first_id + first_slot AS a, 2 * second_id + second_slot AS b FROM ne UNION SELECT frame_id, 2 * second_id + second_slot, 2 * first_id + first_slot FROM ne),
    reach(frame_id, id, other) AS (SELECT frame_id, 2 * segment_id + slot, 2 * segment_id + slot FROM en UNION SELECT r.frame_id, r.id, l.b FROM reach r JOIN lk l ON r.frame_id = l.frame_id AND r.other = l.a)
    SELECT frame_id, id // 2 AS segment_id, CAST(id % 2 AS INTEGER) AS slot, min(other) AS junction FROM reach GROUP BY ALL"""
)
def segment_junctions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.junctions(fx.segments(spark, sf_dir), 4.0).select("frame_id", "segment_id", "slot", "junction")


@query()
def merged_segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.merge_collinear(fx.segments(spark, sf_dir))


@query()
def region_proposals(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.propose(fx.segments(spark, sf_dir), 4.0)


@query()
def oriented_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return lines.oriented_boxes(fx.segments(spark, sf_dir), 4.0)


# -- tracks ----------------------------------------------------------------------------------------------------------

# A track per line of an order; seq is the line's number, its grade follows from the part.
_GRADES = """gr AS (SELECT l_suppkey AS source_id, l_partkey % 8 AS track_id, CAST(row_number() OVER (PARTITION BY l_suppkey, l_partkey % 8 ORDER BY l_shipdate, l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS BIGINT) AS seq,
  CASE CAST(l_quantity AS BIGINT) % 3 WHEN 0 THEN 'strong' WHEN 1 THEN 'weak' ELSE 'none' END AS level, l_linenumber % 2 = 0 AS inside, l_linenumber % 5 = 0 AS switched, l_returnflag = 'R' AS impostor, l_linenumber % 7 = 0 AS conflict FROM lineitem)"""
_GRADE = "CASE WHEN impostor OR conflict THEN 'vetoed' WHEN level = 'strong' AND (inside OR switched) THEN 'confirmed' WHEN level = 'weak' AND (inside OR switched) THEN 'tentative' ELSE 'placeholder' END"


def _graded(spark: SparkSession, sf_dir: str) -> DataFrame:
    body = _GRADES[_GRADES.index("(") + 1 : -1]
    rows = fx.view(spark, sf_dir, body, "lineitem")
    g = tracker.grade(F.col("level"), F.col("inside"), F.col("switched"), F.lit(False), F.col("impostor"), F.col("conflict"))
    return rows.select("source_id", "track_id", "seq", g.alias("grade"))


@query(f"WITH {_GRADES} SELECT source_id, track_id, seq, {_GRADE} AS grade FROM gr")
def evidence_grades(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _graded(spark, sf_dir)


@query(
    f"""WITH RECURSIVE {_GRADES}, ob AS (SELECT source_id, track_id, seq, {_GRADE} AS grade FROM gr),
    walk(source_id, track_id, seq, state, streak, lost_seq) AS (
      SELECT source_id, track_id, CAST(0 AS BIGINT), 'tracking', 0, CAST(0 AS BIGINT) FROM ob WHERE seq = 1
      UNION ALL SELECT w.source_id, w.track_id, o.seq,
        CASE WHEN o.grade IN ('confirmed', 'tentative') THEN 'tracking' WHEN w.state = 'lost' OR w.streak + 1 >= 5 THEN 'lost' ELSE 'uncertain' END,
        CASE WHEN o.grade IN ('confirmed', 'tentative') THEN 0 WHEN w.state = 'lost' THEN w.streak ELSE w.streak + 1 END,
        CASE WHEN o.grade IN ('confirmed', 'tentative') THEN 0 WHEN w.state <> 'lost' AND w.streak + 1 >= 5 THEN o.seq ELSE w.lost_seq END
      FROM walk w JOIN ob o ON o.source_id = w.source_id AND o.track_id = w.track_id AND o.seq = w.seq + 1)
    SELECT * FROM walk WHERE seq > 0"""
)
def track_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.commit(_graded(spark, sf_dir))


_TRACKS = "tk AS (SELECT l_suppkey AS source_id, CAST(l_linenumber AS BIGINT) AS seq, l_orderkey AS track_id, CASE l_partkey % 4 WHEN 0 THEN 'terminated' WHEN 1 THEN 'lost' WHEN 2 THEN 'uncertain' ELSE 'tracking' END AS state, CAST(l_partkey % 50 AS DOUBLE) AS x, CAST(l_suppkey % 50 AS DOUBLE) AS y, 10.0 AS w, 10.0 AS h, CAST(l_quantity AS BIGINT) AS last_verified, l_partkey AS pk FROM lineitem)"
_GATE_FRAMES = "fr AS (SELECT DISTINCT source_id, seq, CASE (source_id + seq) % 3 WHEN 0 THEN 'none' WHEN 1 THEN 'partial' ELSE 'global' END AS classification FROM tk), ro AS (SELECT source_id, seq, k AS roi, CAST(k * 12 AS DOUBLE) AS x, CAST((source_id + k) % 40 AS DOUBLE) AS y, 8.0 AS w, 20.0 AS h FROM fr, (SELECT 0 AS k UNION ALL SELECT 1 UNION ALL SELECT 2) t)"


def _tracks(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    rows = fx.view(spark, sf_dir, _TRACKS[_TRACKS.index("(") + 1 : -1], "lineitem").withColumn("w", F.lit(10.0)).withColumn("h", F.lit(10.0))
    frames = rows.select("source_id", "seq").distinct().withColumn("classification", F.element_at(F.array(F.lit("none"), F.lit("partial"), F.lit("global")), (F.pmod(F.col("source_id") + F.col("seq"), F.lit(3)) + 1).cast("int")))
    rois = frames.select("source_id", "seq", F.explode(F.array(F.lit(0), F.lit(1), F.lit(2))).alias("roi"))
    rois = rois.withColumn("x", (F.col("roi") * 12).cast("double")).withColumn("y", ((F.col("source_id") + F.col("roi")) % 40).cast("double")).withColumn("w", F.lit(8.0)).withColumn("h", F.lit(20.0))
    return rows, frames, rois


@query(
    f"""WITH {_TRACKS}, {_GATE_FRAMES}, hit AS (SELECT t.source_id, t.seq, t.track_id, min(r.roi) AS roi FROM tk t JOIN ro r ON t.source_id = r.source_id AND t.seq = r.seq AND t.x < r.x + r.w AND r.x < t.x + t.w AND t.y < r.y + r.h AND r.y < t.y + t.h GROUP BY ALL)
    SELECT t.source_id, t.seq, t.track_id, t.pk, CASE WHEN state = 'terminated' THEN 'inactive' WHEN classification = 'none' THEN 'reuse' WHEN classification = 'global' OR roi IS NOT NULL THEN 'verify' ELSE 'reuse' END AS verdict, CASE WHEN classification = 'partial' THEN roi END AS roi
    FROM tk t JOIN fr USING (source_id, seq) LEFT JOIN hit USING (source_id, seq, track_id)"""
)
def change_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.change_gate(*_tracks(spark, sf_dir)).select("source_id", "seq", "track_id", "pk", "verdict", "roi")


_REDETECT = "rd AS (SELECT o_orderkey AS track_id, CASE o_orderkey % 5 WHEN 0 THEN 'tracking' WHEN 1 THEN 'terminated' ELSE 'lost' END AS state, CASE o_custkey % 3 WHEN 0 THEN 'none' ELSE 'partial' END AS classification, CAST(100 AS BIGINT) AS seq, o_custkey % 9 AS failures, 100 - o_orderkey % 80 AS last_failure_seq FROM orders)"


@query(
    f"""WITH {_REDETECT} SELECT track_id, verdict, CASE WHEN verdict = 'holdBackoff' THEN due - seq ELSE 0 END AS wait FROM (SELECT *, CASE WHEN state = 'terminated' THEN 'rejected' WHEN state <> 'lost' THEN 'inactive' WHEN classification = 'none' THEN 'holdStatic' WHEN seq < due THEN 'holdBackoff' ELSE 'trigger' END AS verdict
    FROM (SELECT *, CASE WHEN failures > 0 THEN last_failure_seq + CAST(least(pow(2, failures - 1), 60) AS BIGINT) ELSE 0 END AS due FROM rd) t) t"""
)
def redetection_gate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.redetection_gate(fx.view(spark, sf_dir, _REDETECT[_REDETECT.index("(") + 1 : -1], "orders")).select("track_id", "verdict", "wait")


@query(f"WITH {_TRACKS} SELECT source_id, track_id, pk, row_number() OVER (PARTITION BY source_id ORDER BY state <> 'terminated', last_verified, track_id, pk) <= count(*) OVER (PARTITION BY source_id) - 20 AS evicted FROM tk")
def track_evictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _tracks(spark, sf_dir)[0].withColumn("order_id", F.col("track_id")).withColumn("track_id", F.struct("track_id", "pk"))
    return tracker.evictions(rows, 20).select("source_id", F.col("order_id").alias("track_id"), "pk", "evicted")


@query(f"WITH {_TRACKS}, {_GATE_FRAMES} SELECT source_id, seq, classification, CAST(sum(CASE WHEN classification = 'global' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY seq) AS BIGINT) AS layout_generation FROM fr")
def layout_generations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return tracker.layout_generations(_tracks(spark, sf_dir)[1])


@query(
    f"""WITH {_SHIFTS}, path AS (SELECT source_id, seq, sum(CASE WHEN confidence >= 0.3 THEN dx ELSE 0 END) OVER w AS sx, sum(CASE WHEN confidence >= 0.3 THEN dy ELSE 0 END) OVER w AS sy FROM gs WINDOW w AS (PARTITION BY source_id ORDER BY seq)),
    now AS (SELECT source_id, arg_max(sx, seq) AS nx, arg_max(sy, seq) AS ny FROM path GROUP BY source_id)
    SELECT px.source_id, px.seq, px.entry_id AS track_id, 'tracking' AS state, CAST(10 + coalesce(nx, 0) - coalesce(sx, 0) AS DOUBLE) AS x, CAST(20 + coalesce(ny, 0) - coalesce(sy, 0) AS DOUBLE) AS y FROM px LEFT JOIN path USING (source_id, seq) LEFT JOIN now USING (source_id)"""
)
def compensated_tracks(spark: SparkSession, sf_dir: str) -> DataFrame:
    shifts = change.global_shift(fx.thumbs(spark, sf_dir))
    tracks = fx.thumbs(spark, sf_dir).select("source_id", "seq", F.col("entry_id").alias("track_id"), F.lit("tracking").alias("state"), F.lit(10.0).alias("x"), F.lit(20.0).alias("y"))
    return tracker.compensated(tracks, shifts, 0.3)


# -- verification ----------------------------------------------------------------------------------------------------

# 25 thumbnails of a source are what a track's window shows at the 25 steps around it; two of its others are templates.
_NCC = "CASE WHEN va = 0 OR vb = 0 THEN (CASE WHEN a = b THEN 1.0 ELSE 0.0 END) ELSE cov / sqrt(CAST(va AS DOUBLE) * CAST(vb AS DOUBLE)) END"
_DOT = "CAST(list_sum(list_transform(list_zip({u}, {v}), lambda p: p[1] * p[2])) AS BIGINT)"
_PARTS = f"64 * {_DOT.format(u='a', v='a')} - list_sum(a) * list_sum(a) AS va, 64 * {_DOT.format(u='b', v='b')} - list_sum(b) * list_sum(b) AS vb, 64 * {_DOT.format(u='a', v='b')} - list_sum(a) * list_sum(b) AS cov"
_RESPONSES = f"""px AS ({fx.THUMBS_PX}), wi AS (SELECT CAST(source_id AS BIGINT) AS source_id, (seq - 1) // 25 AS track_id, CAST((seq - 1) % 25 % 5 - 2 AS INTEGER) AS dx, CAST((seq - 1) % 25 // 5 - 2 AS INTEGER) AS dy, px FROM px),
te AS (SELECT source_id, track_id, CAST(row_number() OVER (PARTITION BY source_id, track_id ORDER BY dy, dx) - 1 AS INTEGER) AS place, px FROM wi WHERE (dx = 0 AND dy = 1) OR (dx = 2 AND dy = -2)),
re AS (SELECT source_id, track_id, place, dx, dy, {_NCC} AS ncc FROM (SELECT *, {_PARTS} FROM (SELECT w.source_id, w.track_id, t.place, w.dx, w.dy, w.px AS a, t.px AS b FROM wi w JOIN te t ON w.source_id = t.source_id AND w.track_id = t.track_id) u) v),
pk AS (SELECT source_id, track_id, place, max(ncc) FILTER (n = 1) AS ncc, max(dx) FILTER (n = 1) AS dx, max(dy) FILTER (n = 1) AS dy, (max(ncc) FILTER (n = 1) - coalesce(avg(ncc) FILTER (n > 1), 0)) / (coalesce(stddev_pop(ncc) FILTER (n > 1), 0) + 1e-12) AS psr
  FROM (SELECT *, row_number() OVER (PARTITION BY source_id, track_id, place ORDER BY ncc DESC, greatest(abs(dx), abs(dy)), dy, dx) AS n FROM re) t GROUP BY ALL)"""


def _windows(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    at = F.col("seq") - 1
    rows = fx.thumbs(spark, sf_dir).select(F.col("source_id").cast("long").alias("source_id"), F.expr("(seq - 1) div 25").alias("track_id"), F.lit(0).cast("long").alias("seq"), (at % 25 % 5 - 2).cast("int").alias("dx"), (F.expr("(seq - 1) % 25 div 5") - 2).cast("int").alias("dy"), "px")
    some = rows.where("(dx = 0 and dy = 1) or (dx = 2 and dy = -2)").withColumn("added", F.col("dy") * 5 + F.col("dx"))
    return rows, verification.kept_templates(some.select("source_id", "track_id", "added", "px"))


@query(f"WITH {_RESPONSES} SELECT source_id, track_id, place, dx, dy, round(ncc, 9) AS ncc, CASE WHEN abs(psr) < 1e6 THEN round(psr, 6) END AS psr FROM pk")
def appearance_peaks(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = verification.peaks(verification.responses(*_windows(spark, sf_dir)))
    return told.select("source_id", "track_id", "place", "dx", "dy", F.round("ncc", 9).alias("ncc"), F.when(F.abs("psr") < 1e6, F.round("psr", 6)).alias("psr"))


@query(f"WITH {_RESPONSES} SELECT source_id, track_id, place, CASE WHEN psr < 3 THEN 'none' WHEN ncc >= 0.8 THEN 'strong' WHEN ncc >= 0.6 THEN 'weak' ELSE 'none' END AS outcome FROM (SELECT *, row_number() OVER (PARTITION BY source_id, track_id ORDER BY ncc DESC, psr DESC, place) AS n FROM pk) t WHERE n = 1")
def appearance_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = verification.appearance(verification.peaks(verification.responses(*_windows(spark, sf_dir))), sidelobe=3.0)
    return told.select("source_id", "track_id", "place", "outcome")


@query(
    f"""WITH {_RESPONSES}, ng AS (SELECT source_id, track_id, px FROM wi WHERE dx = 1 AND dy = 1)
    SELECT DISTINCT source_id, track_id, dx, dy FROM (SELECT *, {_NCC} AS ncc FROM (SELECT *, {_PARTS} FROM (SELECT w.source_id, w.track_id, w.dx, w.dy, w.px AS a, n.px AS b FROM wi w JOIN ng n ON w.source_id = n.source_id AND w.track_id = n.track_id) u) v) t WHERE ncc >= 0.5"""
)
def impostor_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _windows(spark, sf_dir)[0]
    return verification.impostors(rows, rows.where("dx = 1 and dy = 1"), 0.5).select("source_id", "track_id", "dx", "dy")


_STRUCTURE = "st AS (SELECT CAST(l_suppkey AS BIGINT) AS source_id, l_partkey % 8 AS track_id, l_orderkey * 8 + l_linenumber AS seq, (l_quantity % 8) / 8 AS closure, (l_linenumber % 4) / CAST(4 AS DOUBLE) AS rectangularity, CASE WHEN l_partkey % 9 = 0 THEN NULL ELSE (l_partkey % 5) / CAST(4 AS DOUBLE) END AS edge_support, l_linenumber AS line FROM lineitem)"


@query(
    f"""WITH {_STRUCTURE}, bs AS (SELECT source_id, track_id, max_by(closure, seq) AS c, max_by(rectangularity, seq) AS r, max_by(edge_support, seq) AS e, max(seq) AS s FROM st WHERE line = 1 AND edge_support IS NOT NULL GROUP BY ALL)
    SELECT source_id, track_id, seq, CASE WHEN edge_support IS NULL THEN 'notSupplied' WHEN s IS NULL THEN 'noBaseline' WHEN greatest(abs(closure - c) / greatest(c, 1e-12), abs(rectangularity - r) / greatest(r, 1e-12), abs(edge_support - e) / greatest(e, 1e-12)) <= 0.2 THEN 'consistent' ELSE 'deviated' END AS structure FROM st LEFT JOIN bs USING (source_id, track_id)"""
)
def structure_verdicts(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = fx.view(spark, sf_dir, _STRUCTURE[_STRUCTURE.index("(") + 1 : -1], "lineitem")
    return verification.structure(now, verification.baselines(now.where("line = 1"))).select("source_id", "track_id", "seq", "structure")


_ATTEMPTS = "att AS (SELECT l_suppkey AS source_id, l_partkey % 3 AS track_id, row_number() OVER (PARTITION BY l_suppkey, l_partkey % 3 ORDER BY l_orderkey, l_linenumber, l_partkey, l_extendedprice) AS seq, CASE WHEN l_quantity % 12 = 0 THEN 'recaptured' WHEN l_quantity % 12 = 5 THEN 'associated' ELSE 'failed' END AS outcome FROM lineitem)"


@query(
    f"""WITH {_ATTEMPTS}, ep AS (SELECT *, sum(CASE WHEN outcome <> 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, track_id ORDER BY seq) AS e FROM att),
    fl AS (SELECT *, CAST(sum(CASE WHEN outcome = 'failed' THEN 1 ELSE 0 END) OVER (PARTITION BY source_id, track_id, e ORDER BY seq) AS INTEGER) AS failures FROM ep),
    tm AS (SELECT *, max(failures) OVER (PARTITION BY source_id, track_id ORDER BY seq) >= 8 AS over_ FROM fl)
    SELECT source_id, track_id, seq, outcome, failures, CASE WHEN over_ THEN 'terminated' WHEN outcome = 'failed' THEN 'lost' ELSE 'tracking' END AS state, CASE WHEN outcome = 'failed' AND NOT over_ THEN seq + CAST(least(pow(2, failures - 1), 60) AS BIGINT) END AS due FROM tm"""
)
def redetection_episodes(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.view(spark, sf_dir, _ATTEMPTS[_ATTEMPTS.index("(") + 1 : -1], "lineitem").withColumn("seq", F.col("seq").cast("long"))
    return verification.redetections(rows)


@query(f"WITH {_ATTEMPTS} SELECT source_id, track_id, seq, outcome, greatest(n - 64, 0) AS evicted FROM (SELECT *, count(*) OVER (PARTITION BY source_id) AS n, row_number() OVER (PARTITION BY source_id ORDER BY seq DESC, track_id DESC) AS age FROM att) t WHERE age <= 64")
def redetection_log(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = fx.view(spark, sf_dir, _ATTEMPTS[_ATTEMPTS.index("(") + 1 : -1], "lineitem").withColumn("seq", F.col("seq").cast("long"))
    return verification.record_log(rows)


# -- confirmed events ------------------------------------------------------------------------------------------------


# An entity's state after its n-th observation; at most one event is confirmed by each.
_EVENTS = f"""ob AS (SELECT *, row_number() OVER (PARTITION BY source_id, stable_id ORDER BY seq) AS n FROM ({fx.EVENT_ENTITIES}) t),
walk(source_id, stable_id, n, seq, live, instance, here, here_since, gone, gone_since, seen, maybe, maybe_n, maybe_since, kind, what, from_seq) AS (
  SELECT source_id, stable_id, CAST(0 AS BIGINT), CAST(0 AS BIGINT), FALSE, 0, 0, CAST(0 AS BIGINT), 0, CAST(0 AS BIGINT), '', '', 0, CAST(0 AS BIGINT), CAST(NULL AS VARCHAR), CAST(NULL AS VARCHAR), CAST(0 AS BIGINT) FROM ob WHERE n = 1
  UNION ALL
  SELECT source_id, stable_id, n, seq, (live OR opens) AND NOT closes, instance + CAST(opens AS INTEGER), here, here_since, gone, gone_since,
    CASE WHEN opens OR changes THEN text ELSE seen END, CASE WHEN differs THEN text ELSE maybe END, CASE WHEN changes OR NOT differs THEN 0 ELSE maybe_n END, maybe_since,
    CASE WHEN opens THEN 'begin' WHEN changes THEN 'update' WHEN closes THEN 'end' END, CASE WHEN opens THEN 'appeared' WHEN changes THEN 'textChanged' WHEN closes THEN 'disappeared' END,
    CASE WHEN opens THEN here_since WHEN changes THEN maybe_since ELSE gone_since END
  FROM (SELECT *, observed = 'present' AND NOT live AND here >= 2 AS opens, observed = 'absent' AND live AND gone >= 2 AS closes, differs AND maybe_n >= 2 AS changes FROM (
    SELECT *, CASE WHEN NOT differs THEN 0 WHEN again THEN old_n + 1 ELSE 1 END AS maybe_n, CASE WHEN differs AND NOT again THEN seq ELSE old_since END AS maybe_since FROM (
      SELECT o.source_id, o.stable_id, o.n, o.seq, o.observed, o.text, w.live, w.instance, w.seen, w.maybe, w.maybe_n AS old_n, w.maybe_since AS old_since,
        CASE WHEN o.observed = 'present' THEN w.here + 1 ELSE 0 END AS here, CASE WHEN o.observed = 'present' AND w.here = 0 THEN o.seq ELSE w.here_since END AS here_since,
        CASE WHEN o.observed = 'absent' THEN w.gone + 1 ELSE 0 END AS gone, CASE WHEN o.observed = 'absent' AND w.gone = 0 THEN o.seq ELSE w.gone_since END AS gone_since,
        o.observed = 'present' AND w.live AND o.text <> w.seen AS differs, w.maybe_n > 0 AND w.maybe = o.text AS again
      FROM walk w JOIN ob o ON o.source_id = w.source_id AND o.stable_id = w.stable_id AND o.n = w.n + 1) a) b) c),
se AS (SELECT source_id, stable_id, seq, kind, what, from_seq, instance, row_number() OVER (PARTITION BY source_id ORDER BY seq, stable_id, kind, what) AS event_sequence FROM walk WHERE kind IS NOT NULL)"""


@query(f"WITH RECURSIVE {_EVENTS} SELECT * FROM se")
def semantic_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.numbered(continuous.semantic_events(fx.event_entities(spark, sf_dir)))


@query(f"WITH RECURSIVE {_EVENTS} SELECT * EXCLUDE (age) FROM (SELECT *, row_number() OVER (PARTITION BY source_id ORDER BY event_sequence DESC) AS age, greatest(count(*) OVER (PARTITION BY source_id) - 8, 0) AS dropped FROM se) t WHERE age <= 8")
def event_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.queued(continuous.numbered(continuous.semantic_events(fx.event_entities(spark, sf_dir))), 8)


@query(
    f"""WITH RECURSIVE {_EVENTS}, la AS (SELECT *, row_number() OVER (PARTITION BY source_id, stable_id ORDER BY n DESC) AS age FROM walk)
    SELECT la.source_id, la.stable_id, live AS open, instance, CASE WHEN ob.observed = 'present' THEN 'observed' WHEN ob.observed = 'uncovered' OR gone >= 2 AND kind IS NOT NULL THEN 'unanalyzed' ELSE 'occluded' END AS state, seen AS text, la.seq AS last_seq
    FROM la JOIN ob ON ob.source_id = la.source_id AND ob.stable_id = la.stable_id AND ob.n = la.n WHERE age = 1"""
)
def entity_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.entity_states(fx.event_entities(spark, sf_dir)).drop("label")


@query(
    f"""WITH ob AS ({fx.EVENT_ENTITIES}), mk AS (SELECT *, CASE WHEN lag(observed) OVER w = observed THEN 0 ELSE 1 END AS turn FROM ob WINDOW w AS (PARTITION BY source_id, stable_id ORDER BY seq)),
    il AS (SELECT *, sum(turn) OVER (PARTITION BY source_id, stable_id ORDER BY seq) AS island FROM mk)
    SELECT source_id, stable_id, min(seq) AS first_seq, count(*) AS frames FROM il WHERE observed = 'present' GROUP BY source_id, stable_id, island HAVING count(*) >= 2"""
)
def presence_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.runs(fx.event_entities(spark, sf_dir))


_STALE = "CASE WHEN source_id <> 'cam' THEN 'foreignSource' WHEN epoch <> 3 THEN 'staleSourceEpoch' WHEN policy_revision <> 2 THEN 'stalePolicyRevision' WHEN generation <> 1 THEN 'staleGeneration' WHEN seq <> 0 OR NOT in_flight THEN 'staleFrameSequence' END"


@query(f"WITH tk AS ({fx.TOKENS}) SELECT token_id, coalesce(reason, 'none') AS reason, max(CASE WHEN reason IS NULL THEN 0 ELSE 1 END) OVER (PARTITION BY token_id // 8) = 0 AS accepted FROM (SELECT *, {_STALE} AS reason FROM tk) t")
def work_acceptance(spark: SparkSession, sf_dir: str) -> DataFrame:
    tokens = fx.tokens(spark, sf_dir).withColumn("batch", F.expr("token_id div 8"))
    return continuous.accept(tokens, ["batch"], source="cam", epoch=3, policy=2, generation=1, seq=0).select("token_id", F.coalesce("reason", F.lit("none")).alias("reason"), "accepted")


@query(f"WITH tk AS ({fx.TOKENS}) SELECT reason, count(*) AS n FROM (SELECT {_STALE} AS reason FROM tk) t WHERE reason IS NOT NULL GROUP BY reason")
def rejection_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.accept(fx.tokens(spark, sf_dir), ["token_id"], source="cam", epoch=3, policy=2, generation=1, seq=0).where("reason is not null").groupBy("reason").agg(F.count(F.lit(1)).alias("n"))


_CONDITION_DDL = "idx int, priority int, bind_stable_id boolean, stable_id long, bound_generation long, text_equals string, label_equals string, roi_x double, roi_y double, roi_w double, roi_h double"
_CONDITIONS = [(0, 3, True, 2, 5, "", "", 0.0, 0.0, 0.0, 0.0), (1, 1, False, 0, 0, "t1", "", 0.0, 0.0, 0.0, 0.0), (2, 2, False, 0, 0, "t2", "c2", 0.0, 0.0, 0.0, 0.0), (3, 0, False, 0, 0, "", "", 2.0, 2.0, 4.0, 4.0), (4, 9, False, 0, 0, "", "", 0.0, 0.0, 0.0, 0.0)]


@query(
    f"""WITH ev AS ({fx.EVIDENCE}), fr AS (SELECT DISTINCT frame_id, frame_id % 7 AS generation FROM ev),
    c AS (SELECT * FROM (VALUES (0, 3, 2, ''  , ''), (1, 1, 0, 't1', ''), (2, 2, 0, 't2', 'c2'), (3, 0, 0, '', '')) t(idx, priority, sid, txt, lab)),
    h AS (SELECT f.frame_id, f.generation, c.*, (SELECT min(e.evidence_id) FROM ev e WHERE e.frame_id = f.frame_id AND CASE WHEN c.idx = 0 THEN e.evidence_id = 2 AND f.generation = 5 WHEN c.idx = 3 THEN FALSE ELSE (c.txt = '' OR e.text = c.txt) AND (c.lab = '' OR e.label = c.lab) END) AS hit FROM fr f, c)
    SELECT frame_id, idx, priority, CASE WHEN idx = 3 OR hit IS NOT NULL THEN 'resolved' WHEN idx = 0 AND generation <> 5 THEN 'staleGeneration' WHEN idx = 0 THEN 'unknownStableId' ELSE 'notObserved' END AS outcome, CASE WHEN idx = 3 THEN 0 ELSE hit END AS focus_id FROM h"""
)
def attention_focus(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir)
    regions = ev.select(F.lit(0).alias("source_id"), F.col("frame_id").alias("seq"), F.col("evidence_id").alias("pos"), F.col("evidence_id").alias("stable_id"), "x", "y", "w", "h", "text", "label")
    frames = regions.select("source_id", "seq").distinct().withColumn("generation", F.col("seq") % 7)
    conditions = spark.createDataFrame(_CONDITIONS, _CONDITION_DDL)
    told = continuous.resolve(conditions, regions, frames)
    return told.select(F.col("seq").alias("frame_id"), "idx", "priority", "outcome", "focus_id")


_LEDGER = f"ev AS ({fx.EVIDENCE}), fr AS (SELECT DISTINCT frame_id, CASE frame_id % 4 WHEN 0 THEN 'global' ELSE 'partial' END AS classification, frame_id % 3 AS generation, frame_id % 5 AS content FROM ev), ro AS (SELECT frame_id, x, y, w / 4 AS w, h / 4 AS h FROM ev WHERE evidence_id = 1)"


def _ledger(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    ev = fx.evidence(spark, sf_dir).withColumn("seq", F.col("frame_id")).drop("source_id").withColumn("source_id", F.lit(0))
    frames = ev.select("source_id", "seq").distinct().withColumn("classification", F.when(F.col("seq") % 4 == 0, "global").otherwise("partial")).withColumn("generation", F.col("seq") % 3).withColumn("content", F.col("seq") % 5)
    entries = ev.select("source_id", "seq", F.col("evidence_id").alias("entry_id"), "x", "y", "w", "h", F.lit(1).cast("long").alias("generation"), (F.col("class_id")).alias("content"))
    rois = ev.where("evidence_id = 1").select("source_id", "seq", "x", "y", (F.col("w") / 4).alias("w"), (F.col("h") / 4).alias("h"))
    return entries, frames, rois


@query(
    f"""WITH {_LEDGER} SELECT e.frame_id, e.evidence_id AS entry_id, CASE WHEN classification = 'global' THEN 'layoutChange' WHEN generation <> 1 THEN 'identityChanged'
    WHEN EXISTS (SELECT 1 FROM ro r WHERE r.frame_id = e.frame_id AND r.x < e.x + e.w AND e.x < r.x + r.w AND r.y < e.y + e.h AND e.y < r.y + r.h) THEN 'regionChanged' WHEN content <> class_id THEN 'contentMismatch' ELSE 'kept' END AS reason FROM ev e JOIN fr USING (frame_id)"""
)
def coverage_refresh(spark: SparkSession, sf_dir: str) -> DataFrame:
    return continuous.refresh_coverage(*_ledger(spark, sf_dir)).select(F.col("seq").alias("frame_id"), "entry_id", F.coalesce("reason", F.lit("kept")).alias("reason"))


@query(f"WITH {_LEDGER} SELECT r.frame_id, r.evidence_id AS region_id, (SELECT min(e.evidence_id) FROM ev e WHERE e.frame_id = r.frame_id AND e.evidence_id % 2 = 0 AND r.x >= e.x AND r.y >= e.y AND r.x + r.w <= e.x + e.w AND r.y + r.h <= e.y + e.h) AS entry FROM ev r")
def coverage_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = _ledger(spark, sf_dir)[0]
    return continuous.covered(entries.withColumnRenamed("entry_id", "region_id"), entries.where("entry_id % 2 = 0")).select(F.col("seq").alias("frame_id"), "region_id", "entry")


@query(f"WITH {_LEDGER} SELECT r.frame_id, r.evidence_id FROM ev r WHERE NOT EXISTS (SELECT 1 FROM ro WHERE ro.frame_id = r.frame_id AND ro.x < r.x + r.w AND r.x < ro.x + ro.w AND ro.y < r.y + r.h AND r.y < ro.y + ro.h)")
def focus_reconsiderations(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries, _, rois = _ledger(spark, sf_dir)
    return continuous.reconsiderations(entries, rois).select(F.col("seq").alias("frame_id"), F.col("entry_id").alias("evidence_id"))


# -- cycles ----------------------------------------------------------------------------------------------------------

# A source's frames show some of its entities; a frame's first items are covered areas, its last one is being worked on.
_CYCLE = f"""cv AS (SELECT f.source_id, f.seq, e.evidence_id, e.x, e.y, e.w, e.h, e.text, e.label, e.class_id FROM ({fx.EVIDENCE}) e JOIN ({fx.FRAMES}) f USING (frame_id)),
cr AS (SELECT * FROM (SELECT source_id, seq, CASE WHEN evidence_id % 5 = 0 THEN 0 ELSE class_id + 1 END AS stable_id, x, y, w / 2 AS w, h / 2 AS h, text, label, row_number() OVER (PARTITION BY source_id, seq, class_id, evidence_id % 5 = 0 ORDER BY evidence_id) AS n FROM cv) t WHERE n = 1),
ce AS (SELECT source_id, seq, evidence_id AS entry_id, x, y, w, h FROM cv WHERE evidence_id <= 2),
cw AS (SELECT source_id, seq, evidence_id AS idx, x, y, w + 4 AS w, h + 4 AS h FROM cv WHERE evidence_id >= 4),
ct AS (SELECT source_id, seq, CAST(1 + (source_id + seq) % 5 AS BIGINT) AS track_id, CASE seq % 4 WHEN 0 THEN 'lost' WHEN 1 THEN 'tracking' WHEN 2 THEN 'uncertain' ELSE 'terminated' END AS state FROM (SELECT DISTINCT source_id, seq FROM cv) t),
cf AS (SELECT DISTINCT source_id, seq FROM cv)"""
_HOLDS = "{a}.x <= {r}.x AND {a}.y <= {r}.y AND {r}.x + {r}.w <= {a}.x + {a}.w AND {r}.y + {r}.h <= {a}.y + {a}.h"
_OBSERVED = f"""{_CYCLE}, sn AS (SELECT r.*, (SELECT min(entry_id) FROM ce e WHERE e.source_id = r.source_id AND e.seq = r.seq AND {_HOLDS.format(a='e', r='r')}) AS here FROM cr r WHERE stable_id <> 0),
bo AS (SELECT source_id, stable_id, min(seq) AS born FROM sn GROUP BY ALL),
ask AS (SELECT cf.source_id, cf.seq, stable_id FROM cf JOIN bo ON cf.source_id = bo.source_id AND cf.seq >= born),
kn AS (SELECT a.*, s.x, s.y, s.w, s.h, s.text, s.label, s.seq IS NOT NULL AS shown, last_value(CASE WHEN s.here IS NOT NULL THEN {{{{'x': s.x, 'y': s.y, 'w': s.w, 'h': s.h}}}} END IGNORE NULLS) OVER (PARTITION BY a.source_id, a.stable_id ORDER BY a.seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS k
  FROM ask a LEFT JOIN sn s ON s.source_id = a.source_id AND s.seq = a.seq AND s.stable_id = a.stable_id),
pl AS (SELECT source_id, seq, stable_id, shown, text, label, CASE WHEN shown THEN x ELSE coalesce(k.x, 0) END AS x, CASE WHEN shown THEN y ELSE coalesce(k.y, 0) END AS y, CASE WHEN shown THEN w ELSE coalesce(k.w, 0) END AS w, CASE WHEN shown THEN h ELSE coalesce(k.h, 0) END AS h FROM kn),
hd AS (SELECT p.*, ct.state, (SELECT min(entry_id) FROM ce e WHERE e.source_id = p.source_id AND e.seq = p.seq AND {_HOLDS.format(a='e', r='p')}) AS entry, (SELECT min(idx) FROM cw e WHERE e.source_id = p.source_id AND e.seq = p.seq AND {_HOLDS.format(a='e', r='p')}) AS wk,
  EXISTS (SELECT 1 FROM cr r WHERE r.source_id = p.source_id AND r.seq = p.seq AND least(r.x + r.w, p.x + p.w) > greatest(r.x, p.x) AND least(r.y + r.h, p.y + p.h) > greatest(r.y, p.y)) AS hidden
  FROM pl p LEFT JOIN ct ON ct.source_id = p.source_id AND ct.seq = p.seq AND ct.track_id = p.stable_id),
od AS (SELECT source_id, seq, stable_id, CASE WHEN entry IS NOT NULL THEN kind WHEN wk IS NOT NULL THEN kind || 'Pending' ELSE 'uncovered' END AS observed, NOT shown AND state IS DISTINCT FROM 'lost' AND (hidden OR coalesce(state IN ('tracking', 'uncertain'), FALSE)) AS occluder, NOT shown AND state IS NOT DISTINCT FROM 'lost' AS lost, entry, CASE WHEN entry IS NULL THEN wk END AS work, coalesce(text, '') AS text, coalesce(label, '') AS label, x, y, w, h
  FROM (SELECT *, CASE WHEN shown THEN 'present' ELSE 'absent' END AS kind FROM hd) t)""".replace("{{", "{").replace("}}", "}")


def _cycle(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame, DataFrame]:
    ev = fx.evidence(spark, sf_dir).drop("source_id").join(fx.frames(spark, sf_dir), "frame_id").select("source_id", "seq", "evidence_id", "x", "y", "w", "h", "text", "label", "class_id")
    bare = F.col("evidence_id") % 5 == 0
    regions = ev.select("source_id", "seq", F.when(bare, F.lit(0)).otherwise(F.col("class_id") + 1).alias("stable_id"), "x", "y", (F.col("w") / 2).alias("w"), (F.col("h") / 2).alias("h"), "text", "label", F.row_number().over(Window.partitionBy("source_id", "seq", "class_id", bare).orderBy("evidence_id")).alias("n")).where("n = 1")
    entries = ev.where("evidence_id <= 2").select("source_id", "seq", F.col("evidence_id").alias("entry_id"), "x", "y", "w", "h")
    work = ev.where("evidence_id >= 4").select("source_id", "seq", F.col("evidence_id").alias("idx"), "x", "y", (F.col("w") + 4).alias("w"), (F.col("h") + 4).alias("h"))
    frames = ev.select("source_id", "seq").distinct()
    state = F.element_at(F.array(*map(F.lit, ("lost", "tracking", "uncertain", "terminated"))), (F.col("seq") % 4 + 1).cast("int"))
    return frames, regions, entries, work, frames.select("source_id", "seq", (1 + (F.col("source_id") + F.col("seq")) % 5).alias("track_id"), state.alias("state"))


@query(f"WITH {_OBSERVED} SELECT * FROM od")
def cycle_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.observations(*_cycle(spark, sf_dir))


@query(f"WITH {_OBSERVED} SELECT source_id, seq, stable_id, CASE WHEN observed NOT LIKE '%Pending' THEN observed WHEN work % 2 = 0 THEN replace(observed, 'Pending', '') ELSE 'uncovered' END AS observed FROM od")
def settled_observations(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _cycle(spark, sf_dir)
    return cycle.settled(cycle.observations(*parts), parts[3].where("idx % 2 = 0")).select("source_id", "seq", "stable_id", "observed")


@query(f"WITH {_CYCLE} SELECT source_id, seq, EXISTS (SELECT 1 FROM ce e WHERE e.source_id = cf.source_id AND e.seq = cf.seq) AND NOT EXISTS (SELECT 1 FROM cr r WHERE r.source_id = cf.source_id AND r.seq = cf.seq AND NOT EXISTS (SELECT 1 FROM ce e WHERE e.source_id = r.source_id AND e.seq = r.seq AND {_HOLDS.format(a='e', r='r')})) AS complete FROM cf")
def coverage_complete(spark: SparkSession, sf_dir: str) -> DataFrame:
    frames, regions, entries, *_ = _cycle(spark, sf_dir)
    return cycle.coverage_complete(frames, regions, entries)


@query(
    f"""WITH {_OBSERVED}, st AS (SELECT * FROM (SELECT source_id, stable_id, seq % 3 AS generation, observed <> 'uncovered' AS open, text, label, x, y, w, h, row_number() OVER (PARTITION BY source_id, stable_id ORDER BY seq DESC) AS age FROM od) t WHERE age = 1),
    c AS (SELECT * FROM (VALUES (0, 3, 2, '', ''), (1, 1, 0, 't1', ''), (2, 2, 0, 't2', 'c2'), (3, 0, 0, '', '')) t(idx, priority, sid, txt, lab)),
    h AS (SELECT s.source_id, c.idx, list(stable_id ORDER BY stable_id) FILTER (CASE idx WHEN 0 THEN stable_id = 2 WHEN 3 THEN open AND least(x + w, 6) > greatest(x, 2) AND least(y + h, 6) > greatest(y, 2) ELSE open AND (txt = '' OR text = txt) AND (lab = '' OR label = lab) END) AS ids, max(generation) FILTER (stable_id = 2) AS g FROM st s, c GROUP BY ALL)
    SELECT source_id, idx, outcome, CASE WHEN outcome = 'resolved' THEN array_to_string(ids, ',') ELSE '' END AS stable_ids FROM (SELECT *, CASE WHEN idx = 0 AND ids IS NOT NULL AND g <> 5 THEN 'staleGeneration' WHEN ids IS NOT NULL THEN 'resolved' WHEN idx = 0 THEN 'unknownStableId' ELSE 'notObserved' END AS outcome FROM h) t"""
)
def focus_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = cycle.observations(*_cycle(spark, sf_dir))
    last = told.withColumn("age", F.row_number().over(Window.partitionBy("source_id", "stable_id").orderBy(F.desc("seq")))).where("age = 1")
    states = last.select("source_id", "stable_id", (F.col("seq") % 3).alias("generation"), (F.col("observed") != "uncovered").alias("open"), "text", "label", F.lit(0).alias("space"), "x", "y", "w", "h")
    conditions = spark.createDataFrame(_CONDITIONS, _CONDITION_DDL).withColumn("roi_space", F.lit(0))
    return cycle.focus_states(conditions, states).withColumn("stable_ids", F.array_join(F.transform("stable_ids", lambda i: i.cast("string")), ","))


@query(f"WITH s AS (SELECT o_custkey AS source_id, o_orderkey AS set_at, CAST(o_orderkey % 2 AS BIGINT) AS digest FROM orders) SELECT source_id, set_at, digest, CAST(sum(CASE WHEN p IS NULL OR p <> digest THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY set_at) AS BIGINT) AS revision FROM (SELECT *, lag(digest) OVER (PARTITION BY source_id ORDER BY set_at) AS p FROM s) t")
def policy_revisions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cycle.policy_revisions(table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("source_id"), F.col("o_orderkey").alias("set_at"), (F.col("o_orderkey") % 2).cast("long").alias("digest")))


# -- caches ----------------------------------------------------------------------------------------------------------


@query("SELECT l_orderkey, l_linenumber, l_partkey, p_retailprice AS result, p_partkey IS NOT NULL AS hit FROM lineitem LEFT JOIN (SELECT * FROM part WHERE p_size % 2 = 0) p ON l_partkey = p_partkey")
def cache_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = table(spark, sf_dir, "part").where("p_size % 2 = 0").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("result"))
    return cache.lookup(table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey"), kept, ["l_partkey"])


@query("SELECT p_brand, p_partkey, CAST(running AS BIGINT) AS running FROM (SELECT p_brand, p_partkey, sum(p_size * 16 + 64) OVER (PARTITION BY p_brand ORDER BY p_partkey DESC) AS running FROM part WHERE p_size * 16 + 64 <= 2000) t WHERE running <= 2000")
def recency_cache(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = table(spark, sf_dir, "part").select("p_brand", "p_partkey", (F.col("p_size") * 16).alias("n_bytes"))
    return cache.kept_by_recency(entries, 2000, ["p_brand"], "p_partkey").select("p_brand", "p_partkey", "running")


# A scope's cache after each operation: keys from the least to the most recently used, of 164 bytes each, so 2 at most.
_LRU = f"""op AS (SELECT source_id AS scope, seq, CASE WHEN observed = 'absent' THEN 'lookup' ELSE 'insert' END AS op, CAST(stable_id AS BIGINT) AS key FROM ({fx.EVENT_ENTITIES}) t),
walk(scope, seq, held, ok, evicted) AS (
  SELECT scope, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), FALSE, CAST([] AS BIGINT[]) FROM (SELECT DISTINCT scope FROM op) t
  UNION ALL SELECT w.scope, o.seq,
    CASE WHEN o.op = 'lookup' THEN (CASE WHEN list_contains(w.held, o.key) THEN list_append(list_filter(w.held, lambda k: k <> o.key), o.key) ELSE w.held END)
      WHEN list_contains(w.held, o.key) THEN list_append(list_filter(w.held, lambda k: k <> o.key), o.key) ELSE list_append(CASE WHEN len(w.held) >= 2 THEN w.held[2:] ELSE w.held END, o.key) END,
    o.op = 'insert' OR list_contains(w.held, o.key),
    CASE WHEN o.op = 'insert' AND NOT list_contains(w.held, o.key) AND len(w.held) >= 2 THEN [w.held[1]] ELSE CAST([] AS BIGINT[]) END
  FROM walk w JOIN op o ON o.scope = w.scope AND o.seq = w.seq + 1)"""


@query(f"WITH RECURSIVE {_LRU} SELECT scope, seq, ok, evicted, CAST(164 * len(held) AS BIGINT) AS used FROM walk WHERE seq > 0")
def lru_replay(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.event_entities(spark, sf_dir)
    ops = ev.select(F.col("source_id").alias("scope"), "seq", F.when(F.col("observed") == "absent", "lookup").otherwise("insert").alias("op"), F.col("stable_id").alias("key"), F.lit(100).cast("long").alias("n_bytes"))
    return cache.replay(ops, 400)


# 64-bit FNV-1a in wide integers, over a mark of the half, then each field: texts with their length, numbers in 8 bytes.
_U64 = "list_transform(range(0, 8), lambda i: (CAST({v} AS BIGINT) >> i * 8) & 255)"
_TEXT = f"list_concat({_U64.format(v='strlen({c})')}, list_transform(string_split({{c}}, ''), lambda c: ascii(c)))"
_FNV = "list_reduce(list_transform(list_concat([{mark}], raw), lambda b: CAST(b AS HUGEINT)), lambda h, b: (xor(h, b) * 1099511628211) & 18446744073709551615, CAST(14695981039346656037 AS HUGEINT))"
_SIGNED = "CAST(CASE WHEN {h} >= 9223372036854775808 THEN {h} - 18446744073709551616 ELSE {h} END AS BIGINT)"


@query(
    f"""WITH k AS (SELECT DISTINCT p_brand, p_type, CAST(p_size AS BIGINT) AS p_size FROM part), r AS (SELECT *, list_concat({_TEXT.format(c='p_brand')}, {_TEXT.format(c='p_type')}, {_U64.format(v='p_size')}) AS raw FROM k),
    d AS (SELECT *, {_FNV.format(mark=1)} AS hi, {_FNV.format(mark=2)} AS lo FROM r)
    SELECT p_brand, p_type, p_size, {_SIGNED.format(h='hi')} AS key_hi, {_SIGNED.format(h='lo')} AS key_lo FROM d"""
)
def key_digests(spark: SparkSession, sf_dir: str) -> DataFrame:
    keys = table(spark, sf_dir, "part").select("p_brand", "p_type", F.col("p_size").cast("long").alias("p_size")).distinct()
    return digest.with_digest(keys, ["p_brand", "p_type", "p_size"])


# -- marks -----------------------------------------------------------------------------------------------------------


@query(
    f"""WITH ev AS ({fx.EVIDENCE}) SELECT frame_id, evidence_id AS region_id, CAST(x AS BIGINT) AS mx, CAST(y AS BIGINT) AS my, CAST(least(x + w, 40) - x AS BIGINT) AS mw, CAST(least(y + h, 30) - y AS BIGINT) AS mh, evidence_id % 8 AS color, row_number() OVER (PARTITION BY frame_id ORDER BY evidence_id) AS mark
    FROM ev WHERE x < 40 AND y < 30"""
)
def marks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.marks(fx.evidence(spark, sf_dir).withColumnRenamed("evidence_id", "region_id"), 40, 30)


@query()
def mark_chips(spark: SparkSession, sf_dir: str) -> DataFrame:
    return render.chips(render.marks(fx.evidence(spark, sf_dir).withColumnRenamed("evidence_id", "region_id"), 40, 30), 40, 30)
