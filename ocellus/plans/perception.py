"""Queries over evidence, regions, changes and lines, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ocellus.functions import decode, growing
from ocellus.functions import geometry as G
from ocellus.functions import text as X
from ocellus.operators import change, detect, fusion, ids, ocr, relations, session, visual_index
from ocellus.runtime import table, written
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


# -- SQL pieces ------------------------------------------------------------------------------------------------------

_IW = "greatest(0, least(a.x + a.w, b.x + b.w) - greatest(a.x, b.x))"
_IH = "greatest(0, least(a.y + a.h, b.y + b.h) - greatest(a.y, b.y))"
_PAIRS = f"""
ev AS ({fx.EVIDENCE}),
pairs AS (SELECT *, CASE WHEN aa + ba - inter > 0 THEN inter / (aa + ba - inter) ELSE 0.0 END AS iou,
    CASE WHEN least(aa, ba) > 0 THEN inter / least(aa, ba) ELSE 0.0 END AS containment,
    CASE WHEN greatest(aa, ba) > 0 THEN least(aa, ba) / greatest(aa, ba) ELSE 0.0 END AS ratio
  FROM (SELECT a.frame_id, a.evidence_id AS first_id, b.evidence_id AS second_id, {_IW} * {_IH} AS inter, a.w * a.h AS aa, b.w * b.h AS ba,
    sqrt((a.x + a.w / 2 - b.x - b.w / 2) * (a.x + a.w / 2 - b.x - b.w / 2) + (a.y + a.h / 2 - b.y - b.h / 2) * (a.y + a.h / 2 - b.y - b.h / 2)) AS center_distance,
    NOT (a.kind = 'detection' AND b.kind = 'detection') OR (a.class_id = b.class_id AND (a.label = '' OR b.label = '' OR a.label = b.label)) AS fits,
    (a.label = '' OR b.label = '' OR a.label = b.label) AND (a.text = '' OR b.text = '' OR a.text = b.text) AS agree,
    a.confidence >= 0.5 AND b.confidence >= 0.5 AS reliable, a.confidence AS ca, b.confidence AS cb
  FROM ev a JOIN ev b ON a.frame_id = b.frame_id AND a.evidence_id < b.evidence_id) t)"""
_LINKS = f"""{_PAIRS}, links AS (SELECT * FROM pairs WHERE inter > 0 AND fits AND (iou >= 0.5 OR containment >= 0.8))"""
_ROOTS = f"""{_LINKS},
linked AS (SELECT frame_id, first_id AS a, second_id AS b FROM links UNION SELECT frame_id, second_id, first_id FROM links),
reach(frame_id, id, other) AS (SELECT frame_id, evidence_id, evidence_id FROM ev UNION SELECT r.frame_id, r.id, b.b FROM reach r JOIN linked b ON r.frame_id = b.frame_id AND r.other = b.a),
roots AS (SELECT frame_id, id AS evidence_id, min(other) AS root FROM reach GROUP BY ALL)"""
_RELATION = """CASE WHEN inter <= 0 THEN 'none'
  WHEN (iou >= 0.8 OR (containment >= 0.9 AND ratio > 0.5)) AND NOT agree THEN 'conflict'
  WHEN (iou >= 0.8 OR (containment >= 0.9 AND ratio > 0.5)) AND reliable THEN 'duplicate'
  WHEN NOT (iou >= 0.8 OR (containment >= 0.9 AND ratio > 0.5)) AND containment >= 0.6 AND ratio <= 0.5 AND agree THEN 'partOf'
  ELSE 'overlap' END"""


# -- evidence and fusion ---------------------------------------------------------------------------------------------


@query(f"WITH {_LINKS} SELECT frame_id, first_id, second_id, iou, containment, center_distance, CASE WHEN iou >= 0.5 THEN 'iou' ELSE 'containment' END AS rule FROM links")
def evidence_associations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.associate(fx.evidence(spark, sf_dir))


@query(f"WITH RECURSIVE {_ROOTS} SELECT frame_id, evidence_id, root FROM roots")
def evidence_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.clusters(fx.evidence(spark, sf_dir)).select("frame_id", "evidence_id", "root")


_REGIONS = f"""{_ROOTS},
told AS (SELECT ev.*, root, CASE kind WHEN 'external' THEN 10 WHEN 'text' THEN 9 ELSE 8 END AS wt, CASE kind WHEN 'external' THEN 1 WHEN 'text' THEN 2 ELSE 4 END AS bit FROM ev JOIN roots USING (frame_id, evidence_id)),
regions AS (SELECT frame_id, root AS region_id, min(x) AS x, min(y) AS y, max(x + w) - min(x) AS w, max(y + h) - min(y) AS h, bit_or(bit) AS source_mask,
  coalesce(string_agg(text, chr(10) ORDER BY evidence_id) FILTER (kind <> 'detection' AND text <> ''), '') AS text,
  coalesce(arg_min(label, evidence_id) FILTER (kind <> 'text' AND label <> ''), '') AS label, sum(wt * confidence) / sum(wt) AS confidence,
  list(evidence_id ORDER BY evidence_id) AS evidence_ids FROM told GROUP BY frame_id, root)"""


@query(f"WITH RECURSIVE {_REGIONS} SELECT * EXCLUDE (evidence_ids), array_to_string(evidence_ids, ',') AS evidence_ids FROM regions")
def fuse_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fusion.fuse(fx.evidence(spark, sf_dir)).withColumn("evidence_ids", F.array_join(F.transform("evidence_ids", lambda i: i.cast("string")), ","))


@query(f"WITH ev AS ({fx.EVIDENCE}) SELECT kind, count(*) AS n, count(*) FILTER (text <> '') AS with_text, CAST(sum(CAST(confidence * 8 AS BIGINT)) AS BIGINT) AS eighths FROM ev GROUP BY kind")
def evidence_by_kind(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir)
    parts = {k: ev.where(F.col("kind") == k).drop("kind", "evidence_id").withColumn("ingest", F.lit(1)) for k in ("external", "text", "detection")}
    union = fusion.collect_evidence(parts, ["frame_id"], "ingest")
    return union.where("status = 'Ok'").groupBy("kind").agg(F.count(F.lit(1)).alias("n"), F.count_if(F.col("text") != "").alias("with_text"), F.sum((F.col("confidence") * 8).cast("long")).alias("eighths"))


# -- relations -------------------------------------------------------------------------------------------------------


@query(f"WITH {_PAIRS} SELECT frame_id, first_id, second_id, {_RELATION} AS relation, iou, containment, ratio AS size_ratio FROM pairs WHERE inter > 0")
def relation_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir).withColumnRenamed("evidence_id", "region_id")
    return relations.classify_pairs(ev).drop("first_smaller")


def _entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir).withColumnRenamed("evidence_id", "region_id").withColumn("source_mask", fusion.by_kind(F.col("kind"), fusion.SOURCE_BITS))
    # Read several times below, so worked out once.
    return written(ev.withColumn("evidence_ids", F.array("region_id")).withColumn("stable_id", F.col("region_id") % 3), "entities")


# Groups by walking each frame's regions in order: whoever is free becomes an anchor and takes its free direct duplicates.
_STARS = f"""{_PAIRS}, dup AS (SELECT frame_id, first_id, second_id FROM pairs WHERE {_RELATION} = 'duplicate'),
partners AS (SELECT frame_id, first_id, list(second_id) AS seconds FROM dup GROUP BY ALL),
walk(frame_id, step, anchors, held) AS (
  SELECT frame_id, CAST(0 AS BIGINT), CAST(MAP {{}} AS MAP(BIGINT, BIGINT)), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT frame_id FROM ev) f
  UNION ALL
  SELECT w.frame_id, w.step + 1,
    map_concat(CASE WHEN list_contains(w.held, w.step + 1) THEN w.anchors ELSE map_concat(w.anchors, MAP([w.step + 1], [w.step + 1])) END,
      CASE WHEN list_contains(w.held, w.step + 1) THEN CAST(MAP {{}} AS MAP(BIGINT, BIGINT)) ELSE map_from_entries(list_transform(list_filter(coalesce(p.seconds, CAST([] AS BIGINT[])), lambda s: NOT list_contains(w.held, s)), lambda s: (s, w.step + 1))) END),
    CASE WHEN list_contains(w.held, w.step + 1) THEN w.held ELSE list_concat(w.held, list_concat([w.step + 1], coalesce(p.seconds, CAST([] AS BIGINT[])))) END
  FROM walk w LEFT JOIN partners p ON p.frame_id = w.frame_id AND p.first_id = w.step + 1
  WHERE w.step < (SELECT max(evidence_id) FROM ev)),
stars AS (SELECT frame_id, unnest(map_entries(anchors)) AS e FROM walk WHERE step = (SELECT max(evidence_id) FROM ev))"""


@query(f"WITH RECURSIVE {_STARS} SELECT s.frame_id, s.e.key AS region_id, s.e.value AS anchor FROM stars s JOIN ev ON ev.frame_id = s.frame_id AND ev.evidence_id = s.e.key")
def duplicate_groups(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.duplicate_groups(_entities(spark, sf_dir)).select("frame_id", "region_id", "anchor")


@query(
    f"""WITH RECURSIVE {_STARS}, kept AS (SELECT DISTINCT frame_id, e.value AS id FROM stars),
    r AS (SELECT p.frame_id, first_id, second_id, {_RELATION} AS relation FROM pairs p JOIN kept a ON p.frame_id = a.frame_id AND p.first_id = a.id JOIN kept b ON p.frame_id = b.frame_id AND p.second_id = b.id WHERE inter > 0)
    SELECT frame_id, first_id, second_id, relation, row_number() OVER (PARTITION BY frame_id ORDER BY first_id, second_id) AS relation_id FROM r"""
)
def relation_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.relation_view(_entities(spark, sf_dir)).select("frame_id", "first_id", "second_id", "relation", "relation_id")


@query(
    f"""WITH RECURSIVE {_STARS}, kept AS (SELECT DISTINCT frame_id, e.value AS id FROM stars)
    SELECT DISTINCT p.frame_id, CASE WHEN aa <= ba THEN first_id ELSE second_id END AS child, CASE WHEN aa <= ba THEN second_id ELSE first_id END AS parent
    FROM pairs p JOIN kept a ON p.frame_id = a.frame_id AND p.first_id = a.id JOIN kept b ON p.frame_id = b.frame_id AND p.second_id = b.id WHERE {_RELATION} = 'partOf'"""
)
def part_of_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.part_of_edges(relations.relation_view(_entities(spark, sf_dir)))


# Views of some frames are broken on purpose: a relation is missing, or its ends are the wrong way round.
@query(
    f"""WITH RECURSIVE {_STARS}, kept AS (SELECT DISTINCT frame_id, e.value AS id FROM stars),
    r AS (SELECT p.frame_id, count(*) AS n FROM pairs p JOIN kept a ON p.frame_id = a.frame_id AND p.first_id = a.id JOIN kept b ON p.frame_id = b.frame_id AND p.second_id = b.id WHERE inter > 0 GROUP BY ALL)
    SELECT frame_id FROM r WHERE (frame_id % 3 = 0 AND n >= 3) OR frame_id % 5 = 0"""
)
def relation_view_consistent(spark: SparkSession, sf_dir: str) -> DataFrame:
    view = relations.relation_view(_entities(spark, sf_dir)).where("not (frame_id % 3 = 0 and relation_id = 2)")
    turned = (F.col("frame_id") % 5 == 0) & (F.col("relation_id") == 1)
    view = view.withColumns({"first_id": F.when(turned, F.col("second_id")).otherwise(F.col("first_id")), "second_id": F.when(turned, F.col("first_id")).otherwise(F.col("second_id"))})
    return relations.inconsistencies(view).select("frame_id")


@query(
    f"""WITH RECURSIVE {_STARS} SELECT s.frame_id, s.e.value AS anchor, bit_or(CASE kind WHEN 'external' THEN 1 WHEN 'text' THEN 2 ELSE 4 END) AS source_mask, count(*) AS members, coalesce(min(CASE WHEN evidence_id % 3 <> 0 THEN evidence_id % 3 END), 0) AS stable_id, string_agg(CAST(evidence_id AS VARCHAR), ',' ORDER BY evidence_id) AS evidence_ids
    FROM stars s JOIN ev ON ev.frame_id = s.frame_id AND ev.evidence_id = s.e.key GROUP BY ALL"""
)
def relation_entities(spark: SparkSession, sf_dir: str) -> DataFrame:
    return relations.entities(_entities(spark, sf_dir)).select("frame_id", "anchor", "source_mask", "members", "stable_id", F.array_join(F.transform("evidence_ids", lambda i: i.cast("string")), ",").alias("evidence_ids"))


# -- frame to frame --------------------------------------------------------------------------------------------------


def _sequence(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir).drop("source_id")
    return ev.join(fx.frames(spark, sf_dir), "frame_id").withColumn("region_id", F.col("evidence_id"))


_SEQ = f"ev AS ({fx.EVIDENCE}), sq AS (SELECT f.source_id, f.seq, ev.evidence_id AS region_id, x, y, w, h, text FROM ev JOIN ({fx.FRAMES}) f USING (frame_id))"
_CANDIDATES = f"""{_SEQ}, cand AS (SELECT *, CASE WHEN spoken THEN (base + 0.2 * (1 - (1.0 - levenshtein(pt, ct) / greatest(strlen(pt), strlen(ct))))) / (0.5 + 0.3 + 0.2) ELSE base / (0.5 + 0.3) END AS cost FROM (
  SELECT *, 0.5 * (1 - iou) + 0.3 * (1 - CASE WHEN radius > 0 THEN 1 - away / radius ELSE 0.0 END) AS base, pt <> '' AND ct <> '' AS spoken FROM (
  SELECT *, CASE WHEN aa + ba - inter > 0 THEN inter / (aa + ba - inter) ELSE 0.0 END AS iou FROM (
  SELECT b.source_id, b.seq, a.region_id AS prev_id, b.region_id AS cur_id, {_IW} * {_IH} AS inter, a.w * a.h AS aa, b.w * b.h AS ba, a.text AS pt, b.text AS ct, 0.5 * sqrt(a.w * a.w + a.h * a.h) AS radius,
    sqrt((a.x + a.w / 2 - (b.x + b.w / 2)) * (a.x + a.w / 2 - (b.x + b.w / 2)) + (a.y + a.h / 2 - (b.y + b.h / 2)) * (a.y + a.h / 2 - (b.y + b.h / 2))) AS away
  FROM sq a JOIN sq b ON a.source_id = b.source_id AND b.seq = a.seq + 1) t) t) t WHERE iou >= 0.3 OR away <= radius)"""


@query(f"WITH {_CANDIDATES} SELECT source_id, seq, prev_id, cur_id, iou, round(cost, 9) AS cost FROM cand")
def match_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.match_candidates(_sequence(spark, sf_dir)).withColumn("cost", F.round("cost", 9))


# Greedy choice by walking each frame's candidates from the cheapest; the state is what has been matched.
_MATCHES = f"""{_CANDIDATES}, rk AS (SELECT source_id, seq, prev_id, cur_id, row_number() OVER (PARTITION BY source_id, seq ORDER BY cost, prev_id, cur_id) AS r FROM cand),
choice(source_id, seq, r, prevs, curs, prev_id, cur_id) AS (
  SELECT source_id, seq, CAST(0 AS BIGINT), CAST([] AS BIGINT[]), CAST([] AS BIGINT[]), CAST(NULL AS BIGINT), CAST(NULL AS BIGINT) FROM (SELECT DISTINCT source_id, seq FROM rk) t
  UNION ALL SELECT source_id, seq, r, CASE WHEN taken THEN list_append(prevs, p) ELSE prevs END, CASE WHEN taken THEN list_append(curs, c) ELSE curs END, CASE WHEN taken THEN p END, CASE WHEN taken THEN c END
  FROM (SELECT w.source_id, w.seq, k.r, w.prevs, w.curs, k.prev_id AS p, k.cur_id AS c, NOT list_contains(w.prevs, k.prev_id) AND NOT list_contains(w.curs, k.cur_id) AS taken
    FROM choice w JOIN rk k ON k.source_id = w.source_id AND k.seq = w.seq AND k.r = w.r + 1) t),
ma AS (SELECT source_id, seq, prev_id, cur_id FROM choice WHERE cur_id IS NOT NULL)"""


@query(f"WITH RECURSIVE {_MATCHES} SELECT * FROM ma")
def stable_matches(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.assign(ids.match_candidates(_sequence(spark, sf_dir)))


# What is fresh and what is left of a frame; merged and split regions; and when a source's generation moves on.
_FATES = f"""{_MATCHES}, fr AS (SELECT source_id, seq, count(*) AS regions, lag(seq) OVER w AS last_seq, lag(count(*)) OVER w AS last_n FROM sq GROUP BY source_id, seq WINDOW w AS (PARTITION BY source_id ORDER BY seq)),
fresh AS (SELECT s.* FROM sq s LEFT JOIN ma m ON m.source_id = s.source_id AND m.seq = s.seq AND m.cur_id = s.region_id WHERE m.cur_id IS NULL),
remains AS (SELECT s.source_id, s.seq + 1 AS seq, s.region_id, s.x, s.y, s.w, s.h FROM sq s LEFT JOIN ma m ON m.source_id = s.source_id AND m.seq = s.seq + 1 AND m.prev_id = s.region_id WHERE m.prev_id IS NULL),
merged AS (SELECT n.source_id, n.seq, n.region_id FROM fresh n JOIN remains p ON n.source_id = p.source_id AND n.seq = p.seq AND p.x + p.w / 2 >= n.x AND p.x + p.w / 2 < n.x + n.w AND p.y + p.h / 2 >= n.y AND p.y + p.h / 2 < n.y + n.h GROUP BY ALL HAVING count(*) >= 2),
inner_ AS (SELECT n.source_id, n.seq, n.region_id, p.region_id AS parent, count(*) OVER (PARTITION BY p.source_id, p.seq, p.region_id) AS k FROM (SELECT f.* FROM fresh f ANTI JOIN merged m ON m.source_id = f.source_id AND m.seq = f.seq AND m.region_id = f.region_id) n
  JOIN remains p ON n.source_id = p.source_id AND n.seq = p.seq AND n.x + n.w / 2 >= p.x AND n.x + n.w / 2 < p.x + p.w AND n.y + n.h / 2 >= p.y AND n.y + n.h / 2 < p.y + p.h),
ta AS (SELECT fr.*, coalesce(r.n, 0) AS retained, coalesce(g.n, 0) AS merges FROM fr LEFT JOIN (SELECT source_id, seq, count(*) AS n FROM ma GROUP BY ALL) r USING (source_id, seq) LEFT JOIN (SELECT source_id, seq, count(*) AS n FROM merged GROUP BY ALL) g USING (source_id, seq))"""


@query(
    f"""WITH RECURSIVE {_MATCHES}, chain(source_id, seq, region_id, born, first_id) AS (
      SELECT s.source_id, s.seq, s.region_id, s.seq, s.region_id FROM sq s LEFT JOIN ma m ON m.source_id = s.source_id AND m.seq = s.seq AND m.cur_id = s.region_id WHERE m.cur_id IS NULL
      UNION ALL SELECT c.source_id, m.seq, m.cur_id, c.born, c.first_id FROM chain c JOIN ma m ON m.source_id = c.source_id AND m.seq = c.seq + 1 AND m.prev_id = c.region_id)
    SELECT source_id, seq, region_id, dense_rank() OVER (PARTITION BY source_id ORDER BY born, first_id) AS stable_id, born <> seq AS retained FROM chain"""
)
def stable_ids(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ids.track(_sequence(spark, sf_dir)).select("source_id", "seq", "region_id", "stable_id", (F.col("event") == "retained").alias("retained"))


@query(
    f"""WITH RECURSIVE {_FATES}, parents AS (SELECT * FROM inner_ WHERE k >= 2),
    sp AS (SELECT source_id, seq, count(DISTINCT parent) AS n FROM parents GROUP BY ALL)
    SELECT source_id, seq, regions, retained, merges, CAST(sum(CASE WHEN last_seq IS NULL OR seq <> last_seq + 1 OR merges > 0 OR coalesce(sp.n, 0) > 0 OR retained < 0.5 * last_n THEN 1 ELSE 0 END) OVER (PARTITION BY source_id ORDER BY seq) AS INTEGER) AS generation
    FROM ta LEFT JOIN sp USING (source_id, seq)"""
)
def generation_counter(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = ids.tallied(_sequence(spark, sf_dir))
    return told.select("source_id", "seq", (F.col("retained") + F.col("fresh")).alias("regions"), "retained", "merges", "generation")


@query(f"WITH {_SEQ} SELECT n.source_id, n.seq, n.region_id, count(*) AS swallowed FROM sq n JOIN sq p ON n.source_id = p.source_id AND n.seq = p.seq + 1 AND p.x + p.w / 2 >= n.x AND p.x + p.w / 2 < n.x + n.w AND p.y + p.h / 2 >= n.y AND p.y + p.h / 2 < n.y + n.h GROUP BY ALL")
def swallowed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    now = _sequence(spark, sf_dir).select("source_id", "seq", "region_id", "x", "y", "w", "h")
    return ids.swallowed(now, now.withColumn("seq", F.col("seq") + 1))


# -- change ----------------------------------------------------------------------------------------------------------

_BIT = "list_sum(list_transform(range(0, 56), lambda k: CASE WHEN {p}[k // 7 * 8 + k % 7 + 2] > {p}[k // 7 * 8 + k % 7 + 1] THEN (CAST(1 AS HUGEINT) << (k // 7 * 8 + k % 7)) ELSE 0 END))"
_FRAMES_PX = f"px AS ({fx.THUMBS_PX}), hs AS (SELECT *, CAST({_BIT.format(p='px')} AS BIGINT) AS hash FROM px), lagged AS (SELECT *, lag(px) OVER w AS prev_px, lag(hash) OVER w AS prev_hash FROM hs WINDOW w AS (PARTITION BY source_id ORDER BY seq))"
_CHANGE = f"""{_FRAMES_PX}, ch AS (SELECT *, CASE WHEN reason = 'blockDiff' THEN list_filter(range(0, 16), lambda i: list_sum(list_transform(range(0, 4), lambda j: abs(px[(i // 4 * 2 + j // 2) * 8 + i % 4 * 2 + j % 2 + 1] - prev_px[(i // 4 * 2 + j // 2) * 8 + i % 4 * 2 + j % 2 + 1]))) >= 140) ELSE [] END AS changed FROM (
  SELECT *, CASE WHEN prev_hash IS NULL THEN 'firstFrame' WHEN similarity >= 0.98 THEN 'fingerprint' ELSE 'blockDiff' END AS reason FROM (
  SELECT *, CASE WHEN prev_hash IS NULL THEN 1.0 ELSE (64 - bit_count(xor(hash, prev_hash))) / 64.0 END AS similarity FROM lagged) t) t)"""


@query(
    f"""WITH {_CHANGE} SELECT source_id, seq, hash, CAST(similarity AS DOUBLE) AS similarity, reason, array_to_string(changed, ',') AS changed, len(changed) / CAST(16 AS DOUBLE) AS changed_ratio,
    CASE WHEN prev_hash IS NULL THEN 'global' WHEN len(changed) = 0 THEN 'none' WHEN len(changed) / CAST(16 AS DOUBLE) >= 0.5 THEN 'global' ELSE 'partial' END AS classification FROM ch"""
)
def frame_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    told = change.detect(fx.thumbs(spark, sf_dir), threshold=35)
    return told.select("source_id", "seq", "hash", "similarity", "reason", F.array_join(F.transform("changed", lambda i: i.cast("string")), ",").alias("changed"), "changed_ratio", "classification")


_COMPONENTS = f"""{_CHANGE}, cells AS (SELECT source_id, seq, unnest(changed) AS c FROM ch),
near AS (SELECT a.source_id, a.seq, a.c AS a, b.c AS b FROM cells a JOIN cells b ON a.source_id = b.source_id AND a.seq = b.seq AND abs(a.c % 4 - b.c % 4) <= 1 AND abs(a.c // 4 - b.c // 4) <= 1),
reach(source_id, seq, id, other) AS (SELECT source_id, seq, c, c FROM cells UNION SELECT r.source_id, r.seq, r.id, n.b FROM reach r JOIN near n ON r.source_id = n.source_id AND r.seq = n.seq AND r.other = n.a),
comp AS (SELECT source_id, seq, id AS c, min(other) AS root FROM reach GROUP BY ALL)"""


@query(
    f"""WITH RECURSIVE {_COMPONENTS} SELECT source_id, seq, row_number() OVER (PARTITION BY source_id, seq ORDER BY root) - 1 AS roi, x0 * 1280 // 8 AS x, y0 * 720 // 8 AS y, -(-x1 * 1280 // 8) - x0 * 1280 // 8 AS w, -(-y1 * 720 // 8) - y0 * 720 // 8 AS h
    FROM (SELECT CAST(source_id AS BIGINT) AS source_id, seq, root, min(c % 4) * 2 AS x0, min(c // 4) * 2 AS y0, (max(c % 4) + 1) * 2 AS x1, (max(c // 4) + 1) * 2 AS y1 FROM comp GROUP BY ALL) t"""
)
def changed_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.changed_regions(change.detect(fx.thumbs(spark, sf_dir), threshold=35))


SHIFTS = f"""{_FRAMES_PX}, offs AS (SELECT dy, dx FROM range(-2, 3) a(dy), range(-2, 3) b(dx)),
    surf AS (SELECT source_id, seq, dy, dx, CAST(list_sum(list_transform(range(0, 16), lambda k: abs(prev_px[(k // 4 + 2) * 8 + k % 4 + 3] - px[(k // 4 + 2 + dy) * 8 + k % 4 + 2 + dx + 1]))) AS BIGINT) AS sad FROM lagged, offs WHERE prev_px IS NOT NULL),
    tot AS (SELECT source_id, seq, CAST(sum(sad) AS BIGINT) AS total FROM surf GROUP BY ALL),
    best AS (SELECT *, row_number() OVER (PARTITION BY source_id, seq ORDER BY sad, greatest(abs(dx), abs(dy)), dy, dx) AS n FROM surf),
    gs AS (SELECT source_id, seq, CAST(dx AS INTEGER) AS dx, CAST(dy AS INTEGER) AS dy, sad, CASE WHEN total + 23 * sad > 0 THEN (total - 25 * sad) / CAST(total + 23 * sad AS DOUBLE) ELSE 0.0 END AS confidence FROM best JOIN tot USING (source_id, seq) WHERE n = 1)"""


@query(f"WITH {SHIFTS} SELECT * FROM gs")
def global_shift(spark: SparkSession, sf_dir: str) -> DataFrame:
    return change.global_shift(fx.thumbs(spark, sf_dir))


# -- text lines ------------------------------------------------------------------------------------------------------

_LINES = f"ev AS ({fx.EVIDENCE}), roi AS (SELECT frame_id, x, y, w / 2 AS w, h / 2 AS h, class_id - 1.5 AS priority FROM ev WHERE kind = 'external')"
_PRIORITY = f"""{_LINES}, pr AS (SELECT e.*, coalesce((SELECT max(r.priority) FROM roi r WHERE r.frame_id = e.frame_id AND r.x < e.x + e.w AND e.x < r.x + r.w AND r.y < e.y + e.h AND e.y < r.y + r.h), 0.0) AS priority FROM ev e WHERE kind = 'text'),
ord AS (SELECT *, row_number() OVER (PARTITION BY frame_id ORDER BY y, x, w DESC, h DESC, confidence DESC, evidence_id) - 1 AS reading_order,
  row_number() OVER (PARTITION BY frame_id ORDER BY priority DESC, y, x, w DESC, h DESC, confidence DESC, evidence_id) - 1 AS execution_order FROM pr)"""


def _lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev = fx.evidence(spark, sf_dir)
    rois = ev.where("kind = 'external'").select("frame_id", "x", "y", (F.col("w") / 2).alias("w"), (F.col("h") / 2).alias("h"), (F.col("class_id") - 1.5).alias("priority"))
    return ocr.with_priority(ev.where("kind = 'text'"), rois)


@query(f"WITH {_PRIORITY} SELECT frame_id, evidence_id, CAST(priority AS DOUBLE) AS priority, reading_order, execution_order FROM ord")
def line_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.ordered(_lines(spark, sf_dir)).select("frame_id", "evidence_id", "priority", F.col("reading_order").cast("long").alias("reading_order"), F.col("execution_order").cast("long").alias("execution_order"))


@query(f"WITH {_PRIORITY} SELECT frame_id, evidence_id, CASE WHEN execution_order < 2 AND sum(w) OVER (PARTITION BY frame_id ORDER BY execution_order) <= 60 THEN 'recognized' ELSE 'deferred' END AS state FROM ord")
def budgeted_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.budgeted(_lines(spark, sf_dir), 2, "w", 60).select("frame_id", "evidence_id", "state")


@query(f"WITH {_PRIORITY} SELECT frame_id, count(*) AS detected, count(*) FILTER (execution_order < 2) AS recognized, count(*) FILTER (execution_order >= 2) AS deferred, CASE WHEN count(*) > 2 THEN 'lineBudget' ELSE 'none' END AS stop_reason, count(*) <= 2 AS complete FROM ord GROUP BY frame_id")
def budget_report(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.report(ocr.budgeted(_lines(spark, sf_dir), 2))


@query(f"WITH ev AS ({fx.EVIDENCE}) SELECT frame_id, CAST(32 + sum(CASE WHEN kind = 'text' THEN 64 + strlen(text) + 8 * class_id ELSE 48 + strlen(label) END) AS BIGINT) AS n_bytes FROM ev WHERE kind <> 'external' GROUP BY frame_id")
def cache_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.payload_bytes(fx.evidence(spark, sf_dir).where("kind <> 'external'").withColumn("corners", F.col("class_id")), ["frame_id"])


@query(
    f"""WITH {_PRIORITY}, sp AS (SELECT *, coalesce(sum(w) OVER (PARTITION BY frame_id ORDER BY execution_order ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM ord)
    SELECT frame_id, evidence_id, CASE WHEN before >= 50 - 10 THEN 'deferred' WHEN before + w > 60 THEN 'timeout' ELSE 'done' END AS state FROM sp"""
)
def budgeted_work(spark: SparkSession, sf_dir: str) -> DataFrame:
    work = ocr.ordered(_lines(spark, sf_dir))
    return session.within_budgets(work, ["frame_id"], ["execution_order"], "w", 50, 10, 60).select("frame_id", "evidence_id", "state")


_CTC = f"""px AS ({fx.THUMBS_PX}), st AS (SELECT entry_id, t AS step, list_transform(px[t * 8 + 1 : t * 8 + 8], lambda v: v // 32) AS s FROM px, range(0, 8) r(t)),
sc AS (SELECT *, CAST(list_position(s, list_max(s)) - 1 AS INTEGER) AS best, 1 / list_sum(list_transform(s, lambda x: exp(CAST(x - list_max(s) AS DOUBLE)))) AS p FROM st),
fr AS (SELECT *, best <> 0 AND best IS DISTINCT FROM lag(best) OVER (PARTITION BY entry_id ORDER BY step) AS fresh FROM sc)"""


@query(f"WITH {_CTC} SELECT entry_id, coalesce(string_agg(substr('-abcdefg', best + 1, 1), '' ORDER BY step) FILTER (fresh), '') AS text, round(coalesce(avg(p) FILTER (fresh), 0), 9) AS confidence FROM fr GROUP BY entry_id")
def ctc_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    steps = fx.thumbs(spark, sf_dir).select("entry_id", "px", F.explode(F.sequence(F.lit(0), F.lit(7))).alias("step"))
    steps = steps.select("entry_id", "step", F.transform(F.slice("px", F.col("step") * 8 + 1, 8), lambda v: F.floor(v / 32).cast("double")).alias("scores"))
    return decode.ctc(steps, ["entry_id"], list("-abcdefg")).withColumn("confidence", F.round("confidence", 9))


_BOXES = "bx AS (SELECT frame_id, evidence_id, greatest((x - 4) / 0.5, 0) AS x0, greatest((y - 6) / 0.5, 0) AS y0, least((x - 4) / 0.5 + w / 0.5, 64) AS x1, least((y - 6) / 0.5 + h / 0.5, 48) AS y1 FROM ev)"


@query(f"WITH ev AS ({fx.EVIDENCE}), {_BOXES} SELECT frame_id, evidence_id, x0 AS x, y0 AS y, x1 - x0 AS w, y1 - y0 AS h FROM bx WHERE x1 > x0 AND y1 > y0")
def unletterboxed_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    boxes = fx.evidence(spark, sf_dir).withColumns({"scale_x": F.lit(0.5), "scale_y": F.lit(0.5), "pad_x": F.lit(4), "pad_y": F.lit(6)})
    return decode.unletterboxed(boxes, F.lit(64.0), F.lit(48.0)).select("frame_id", "evidence_id", *"xywh")


@query(
    f"""WITH ev AS ({fx.EVIDENCE}), m AS (SELECT frame_id, avg(x) AS mx, avg(y) AS my, var_pop(x) AS xx, var_pop(y) AS yy, covar_pop(x, y) AS xy FROM ev GROUP BY frame_id), l AS (SELECT *, (xx + yy) / 2 + sqrt((xx - yy) * (xx - yy) / 4 + xy * xy) AS big FROM m),
    d AS (SELECT *, CASE WHEN abs(big - yy) < 1e-12 AND abs(xy) < 1e-12 THEN (CASE WHEN xx >= yy THEN 1.0 ELSE 0.0 END) ELSE big - yy END AS dx, CASE WHEN abs(big - yy) < 1e-12 AND abs(xy) < 1e-12 THEN (CASE WHEN xx >= yy THEN 0.0 ELSE 1.0 END) ELSE xy END AS dy FROM l)
    SELECT frame_id, round(mx, 6) AS mx, round(my, 6) AS my, round(abs(dx / sqrt(dx * dx + dy * dy)), 6) AS dx FROM d WHERE abs(xy) > 1e-6"""
)
def principal_axes(spark: SparkSession, sf_dir: str) -> DataFrame:
    x, y = F.col("x"), F.col("y")
    told = fx.evidence(spark, sf_dir).groupBy("frame_id").agg(growing.principal_axis(x, y).alias("a"), F.covar_pop(x, y).alias("xy")).where("abs(xy) > 1e-6")
    return told.select("frame_id", F.round("a.mx", 6).alias("mx"), F.round("a.my", 6).alias("my"), F.round(F.abs("a.dx"), 6).alias("dx"))


@query(f"WITH RECURSIVE {_REGIONS} SELECT frame_id, region_id, source_mask & 2 <> 0 AS has_text, source_mask & 4 <> 0 AS has_detection, region_id % 3 <> 0 AND region_id % 3 = frame_id % 3 AS current FROM regions")
def region_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    fused = fusion.fuse(fx.evidence(spark, sf_dir))
    mask = F.col("source_mask")
    return fused.select("frame_id", "region_id", session.has_source(mask, "text").alias("has_text"), session.has_source(mask, "detection").alias("has_detection"), session.generation_current(F.col("region_id") % 3, F.col("frame_id") % 3).alias("current"))


@query()
def merged_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ocr.merge_lines(fx.evidence(spark, sf_dir).where("kind = 'text'"))


# -- detections ------------------------------------------------------------------------------------------------------

# Greedy suppression by walking ranks; the state is the list of kept ranks.
_NMS = f"""ev AS ({fx.EVIDENCE}), d AS (SELECT *, row_number() OVER (PARTITION BY frame_id, class_id ORDER BY confidence DESC, evidence_id) AS r FROM ev WHERE kind = 'detection'),
hit AS (SELECT a.frame_id, a.class_id, b.r AS r, list(a.r) AS over FROM d a JOIN d b ON a.frame_id = b.frame_id AND a.class_id = b.class_id AND a.r < b.r
  AND a.w * a.h > 0 AND b.w * b.h > 0 AND {_IW} * {_IH} > 0.5 * (a.w * a.h + b.w * b.h - {_IW} * {_IH}) GROUP BY ALL),
walk(frame_id, class_id, r, kept) AS (
  SELECT frame_id, class_id, CAST(0 AS BIGINT), CAST([] AS BIGINT[]) FROM (SELECT DISTINCT frame_id, class_id FROM d) t
  UNION ALL SELECT w.frame_id, w.class_id, w.r + 1, CASE WHEN len(list_intersect(w.kept, coalesce(hit.over, []))) = 0 THEN list_append(w.kept, w.r + 1) ELSE w.kept END
  FROM walk w JOIN d ON d.frame_id = w.frame_id AND d.class_id = w.class_id AND d.r = w.r + 1 LEFT JOIN hit ON hit.frame_id = w.frame_id AND hit.class_id = w.class_id AND hit.r = w.r + 1),
last AS (SELECT frame_id, class_id, arg_max(kept, r) AS kept FROM walk GROUP BY ALL)"""


@query(f"WITH RECURSIVE {_NMS} SELECT d.frame_id, d.evidence_id FROM d JOIN last l ON d.frame_id = l.frame_id AND d.class_id = l.class_id WHERE list_contains(l.kept, d.r)")
def nms(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.nms(fx.evidence(spark, sf_dir).where("kind = 'detection'"))


@query(f"WITH ev AS ({fx.EVIDENCE}) SELECT frame_id, evidence_id FROM ev WHERE kind = 'detection' AND confidence >= 0.5 AND class_id IN (1, 2, 3)")
def filtered_detections(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.filter_detections(fx.evidence(spark, sf_dir).where("kind = 'detection'"), 0.5, [1, 2, 3]).select("frame_id", "evidence_id")


@query(f"WITH ev AS ({fx.EVIDENCE}) SELECT * FROM (SELECT frame_id, evidence_id, CAST(row_number() OVER (PARTITION BY frame_id ORDER BY confidence, evidence_id) AS INTEGER) AS rank FROM ev WHERE kind = 'detection' AND (confidence < 0.5 OR w * h / 4000.0 < 0.1)) WHERE rank <= 3")
def refinement_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.needs_refinement(fx.evidence(spark, sf_dir).where("kind = 'detection'"), 0.5, 0.1, F.lit(4000.0), 3).select("frame_id", "evidence_id", "rank")


_MAPS = f"""px AS ({fx.THUMBS_PX}), cells AS (SELECT entry_id AS map_id, unnest(range(0, 64)) AS c, unnest(px) AS v FROM px), hot AS (SELECT * FROM cells WHERE v >= 150),
    near AS (SELECT a.map_id, a.c AS a, b.c AS b FROM hot a JOIN hot b ON a.map_id = b.map_id AND abs(a.c % 8 - b.c % 8) <= 1 AND abs(a.c // 8 - b.c // 8) <= 1),
    reach(map_id, id, other) AS (SELECT map_id, c, c FROM hot UNION SELECT r.map_id, r.id, n.b FROM reach r JOIN near n ON r.map_id = n.map_id AND r.other = n.a),
    comp AS (SELECT map_id, id AS c, min(other) AS root FROM reach GROUP BY ALL),
    mc AS (SELECT map_id, CAST(row_number() OVER (PARTITION BY map_id ORDER BY root) - 1 AS INTEGER) AS component, CAST(min(c % 8) AS INTEGER) AS x, CAST(min(c // 8) AS INTEGER) AS y, CAST(max(c % 8) - min(c % 8) + 1 AS INTEGER) AS w, CAST(max(c // 8) - min(c // 8) + 1 AS INTEGER) AS h, count(*) AS pixels, CAST(sum(v) AS BIGINT) AS value_sum
    FROM comp JOIN hot USING (map_id, c) GROUP BY map_id, root)"""


@query(f"WITH RECURSIVE {_MAPS} SELECT * FROM mc")
def map_components(spark: SparkSession, sf_dir: str) -> DataFrame:
    return detect.components_of_maps(fx.thumbs(spark, sf_dir).withColumnRenamed("entry_id", "map_id"), 8, 150)


@query(
    f"""WITH RECURSIVE {_MAPS}, bx AS (SELECT map_id, component, x, y, w, h, CASE WHEN w + h > 0 THEN CAST(w * h AS DOUBLE) * 1.5 / (2 * (w + h)) ELSE 0 END AS d, value_sum / pixels / 255.0 AS score FROM mc WHERE pixels >= 3)
    SELECT map_id, component, greatest(x - d, 0) AS x, greatest(y - d, 0) AS y, least(x + w + d, 8) - greatest(x - d, 0) AS w, least(y + h + d, 8) - greatest(y - d, 0) AS h, score FROM bx"""
)
def text_boxes(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = detect.components_of_maps(fx.thumbs(spark, sf_dir).withColumnRenamed("entry_id", "map_id"), 8, 150)
    return detect.text_boxes(found, 8, 8)


# -- visual index ----------------------------------------------------------------------------------------------------


@query(
    f"""WITH px AS ({fx.THUMBS_PX}), hs AS (SELECT *, CAST({_BIT.format(p='px')} AS BIGINT) AS hash, list_sum(px) AS s, list_sum(list_transform(px, lambda v: v * v)) AS ss FROM px),
    m AS (SELECT q.entry_id AS query_id, e.entry_id, q.px = e.px AS same, 1.0 - bit_count(xor(q.hash, e.hash)) / 64.0 AS hsim, 64 * q.ss - q.s * q.s AS va, 64 * e.ss - e.s * e.s AS vb,
      64 * list_sum(list_transform(list_zip(q.px, e.px), lambda p: p[1] * p[2])) - q.s * e.s AS cov FROM hs q JOIN hs e ON q.entry_id % 20 = 0),
    t AS (SELECT query_id, entry_id, CASE WHEN same THEN 0 WHEN hsim >= 0.9 THEN 1 ELSE 2 END AS tier, CASE WHEN same THEN 1.0 WHEN hsim >= 0.9 THEN CAST(hsim AS DOUBLE) WHEN va = 0 OR vb = 0 THEN 0.0 ELSE CAST(cov AS DOUBLE) / sqrt(CAST(va AS DOUBLE) * CAST(vb AS DOUBLE)) END AS similarity FROM m)
    SELECT query_id, entry_id, tier, round(similarity, 9) AS similarity, CAST(rank AS INTEGER) AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY tier, similarity DESC, entry_id) AS rank FROM t WHERE tier < 2 OR similarity >= 0.3) WHERE rank <= 8"""
)
def visual_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    entries = fx.thumbs(spark, sf_dir)
    queries = entries.where("entry_id % 20 = 0").withColumnRenamed("entry_id", "query_id")
    return visual_index.search(queries, entries, 0.9, 0.3).withColumn("similarity", F.round("similarity", 9))


# -- geometry and text -----------------------------------------------------------------------------------------------


@query(f"WITH ev AS ({fx.EVIDENCE}) SELECT frame_id, evidence_id, 100 - y - h AS x, x AS y, h AS w, w AS h, 0.5 * x + 10 AS letter_x, CAST(floor(y / 16) * 4 + floor(x / 16) AS BIGINT) AS cell FROM ev")
def rotated_regions(spark: SparkSession, sf_dir: str) -> DataFrame:
    ev, r = fx.evidence(spark, sf_dir), G.Rect.of()
    m = G.rotation(F.lit(90), F.lit(64.0), F.lit(100.0))
    back = G.map_rect(G.inverse(m), G.Rect(*(F.col(f"t.{c}") for c in "xywh")))
    told = ev.withColumn("t", G.map_rect(m, r)).withColumn("back", back)
    told = told.where((F.col("back.x") == F.col("x")) & (F.col("back.w") == F.col("w")))  # the round trip is exact
    box = G.letterbox(F.lit(64.0), F.lit(100.0), F.lit(52.0), F.lit(50.0))
    return told.select("frame_id", "evidence_id", F.col("t.x").alias("x"), F.col("t.y").alias("y"), F.col("t.w").alias("w"), F.col("t.h").alias("h"), G.map_point(box, F.col("x"), F.col("y"))["x"].alias("letter_x"), G.grid_locate(F.col("x"), F.col("y"), F.lit(64), 16).alias("cell"))


@query(
    f"""WITH ev AS ({fx.EVIDENCE}), g AS (SELECT DISTINCT frame_id, 40 + frame_id % 30 AS width, 20 + frame_id % 20 AS height FROM ev)
    SELECT frame_id, cell, cell % cols AS col, cell // cols AS row, least(16, width - cell % cols * 16) AS w, least(16, height - cell // cols * 16) AS h FROM (SELECT *, unnest(range(0, cols * ((height + 15) // 16))) AS cell FROM (SELECT *, (width + 15) // 16 AS cols FROM g) t) t"""
)
def grid_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    g = table(spark, sf_dir, "lineitem").select(F.col("l_orderkey").alias("frame_id")).distinct().withColumn("width", 40 + F.col("frame_id") % 30).withColumn("height", 20 + F.col("frame_id") % 20)
    return g.select("frame_id", F.inline(G.grid_cells(F.col("width"), F.col("height"), 16))).select("frame_id", "cell", "col", "row", "w", "h")


@query(
    r"""SELECT doc_id, strlen(t) AS n_bytes, md5(t) AS digest FROM (SELECT doc_id, trim(regexp_replace(regexp_replace(coalesce(text, ''), '[\x00-\x08\x0E-\x1F\x7F-\x{9F}]', '', 'g'), '[ \t\n\x0B\f\r]+', ' ', 'g'), ' ') AS t FROM documents) t"""
)
def normalized_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    t = X.normalize(F.coalesce("text", F.lit("")))
    return table(spark, sf_dir, "documents").select("doc_id", F.octet_length(t).cast("long").alias("n_bytes"), F.md5(t).alias("digest"))


@query(
    """SELECT conv_id, turn, CASE WHEN a = '' OR b = '' THEN 0.0 ELSE 1.0 - levenshtein(a, b) / greatest(strlen(a), strlen(b)) END AS similarity
    FROM (SELECT conv_id, turn, coalesce(text, '') AS b, lag(coalesce(text, '')) OVER (PARTITION BY conv_id ORDER BY turn) AS a FROM conversations) t WHERE a IS NOT NULL"""
)
def turn_similarity(spark: SparkSession, sf_dir: str) -> DataFrame:
    from pyspark.sql import Window

    own = F.coalesce("text", F.lit(""))
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", own.alias("b")).withColumn("a", F.lag("b").over(Window.partitionBy("conv_id").orderBy("turn"))).where("a is not null")
    return rows.select("conv_id", "turn", X.similarity(F.col("a"), F.col("b")).alias("similarity"))
