"""How regions of a frame relate: pairs, duplicate groups, and the view built from both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.fusion import frame_pairs
from ocellus.operators.grouping import map_groups

DUPLICATE_IOU, DUPLICATE_INSIDE, PART_INSIDE, PART_RATIO, MIN_MERGE_CONFIDENCE = 0.80, 0.90, 0.60, 0.50, 0.5


def semantics_compatible(a: str, b: str) -> Column:
    """Labels, and texts, contradict each other only where both are given."""
    agree = lambda c: (F.col(f"{a}.{c}") == "") | (F.col(f"{b}.{c}") == "") | (F.col(f"{a}.{c}") == F.col(f"{b}.{c}"))
    return agree("label") & agree("text")


def relation(a: G.Rect, b: G.Rect, agree: Column, reliable: Column) -> Column:
    """none, duplicate, conflict, partOf or overlap."""
    inside, ratio = G.containment(a, b), G.size_ratio(a, b)
    same = (G.iou(a, b) >= DUPLICATE_IOU) | ((inside >= DUPLICATE_INSIDE) & (ratio > PART_RATIO))
    part = (inside >= PART_INSIDE) & (ratio <= PART_RATIO)
    return F.when(G.intersection(a, b).area <= 0, "none").when(same & ~agree, "conflict").when(same & reliable, "duplicate").when(~same & part & agree, "partOf").otherwise("overlap")


def classify_pairs(regions: DataFrame, frame: list[str] | None = None, id_col: str = "region_id") -> DataFrame:
    """Overlapping pairs of regions with their relation and its measures."""
    frame = frame or ["frame_id"]
    a, b = G.Rect.of("a."), G.Rect.of("b.")
    reliable = (F.col("a.confidence") >= MIN_MERGE_CONFIDENCE) & (F.col("b.confidence") >= MIN_MERGE_CONFIDENCE)
    pairs = frame_pairs(regions, frame, id_col, "label", "text", "confidence")
    kind = relation(a, b, semantics_compatible("a", "b"), reliable)
    return pairs.select(*frame, F.col(f"a.{id_col}").alias("first_id"), F.col(f"b.{id_col}").alias("second_id"), kind.alias("relation"), G.iou(a, b).alias("iou"), G.containment(a, b).alias("containment"), G.size_ratio(a, b).alias("size_ratio"), (G.Rect.of("a.").area <= G.Rect.of("b.").area).alias("first_smaller"))


def _stars(rows: list[tuple]) -> list[tuple]:
    """Of duplicate pairs in order: whoever is first and free takes its free partners, not theirs."""
    anchor: dict[int, int] = {}
    for *frame, a, b in rows:
        if anchor.get(a, a) == a and b not in anchor:
            anchor[a] = a
            anchor[b] = a
    return [(*rows[0][:-2], i, x) for i, x in anchor.items()]


def duplicate_groups(regions: DataFrame, frame: list[str] | None = None, id_col: str = "region_id") -> DataFrame:
    """``regions`` with anchor: the first region it is a direct duplicate of, not through others, or itself."""
    frame = frame or ["frame_id"]
    pairs = classify_pairs(regions, frame, id_col).where("relation = 'duplicate'").select(*frame, "first_id", "second_id")
    ddl = ", ".join(f"{k} {t}" for k, t in pairs.select(*frame).dtypes) + f", {id_col} long, anchor long"
    found = map_groups(pairs, frame, ["first_id", "second_id"], _stars, ddl, most=1 << 23)
    return regions.join(found, [*frame, id_col], "left").withColumn("anchor", F.coalesce("anchor", id_col))


def entities(regions: DataFrame, frame: list[str] | None = None, id_col: str = "region_id") -> DataFrame:
    """One entity per duplicate group: the anchor's bounds and semantics, all members' sources and evidence, and the smallest stable id of
    those that have one (not 0), where there is such a column."""
    frame = frame or ["frame_id"]
    told = duplicate_groups(regions, frame, id_col)
    own = F.col(id_col) == F.col("anchor")
    keep = [c for c in ("x", "y", "w", "h", "text", "label", "confidence") if c in regions.columns]
    named = [F.coalesce(F.min(F.nullif(F.col("stable_id"), F.lit(0))), F.lit(0)).alias("stable_id")] if "stable_id" in regions.columns else []
    return told.groupBy(*frame, "anchor").agg(*named, *(F.max(F.when(own, F.col(c))).alias(c) for c in keep), F.bit_or("source_mask").alias("source_mask"), F.array_sort(F.array_distinct(F.flatten(F.collect_list("evidence_ids")))).alias("evidence_ids"), F.count(F.lit(1)).alias("members"))


def relation_view(regions: DataFrame, frame: list[str] | None = None, id_col: str = "region_id") -> DataFrame:
    """Relations between entities, numbered from 1 within a frame in order of their ends."""
    frame = frame or ["frame_id"]
    kept = entities(regions, frame, id_col)
    pairs = classify_pairs(kept, frame, "anchor").where("relation <> 'none'")
    number = F.row_number().over(Window.partitionBy(*frame).orderBy("first_id", "second_id"))
    return pairs.withColumn("relation_id", number.cast("long"))


def part_of_edges(relations: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """child and parent of each partOf relation: the smaller is part of the larger."""
    frame = frame or ["frame_id"]
    child = F.when(F.col("first_smaller"), F.col("first_id")).otherwise(F.col("second_id"))
    parent = F.when(F.col("first_smaller"), F.col("second_id")).otherwise(F.col("first_id"))
    return relations.where("relation = 'partOf'").select(*frame, child.alias("child"), parent.alias("parent")).distinct()


def inconsistencies(relations: DataFrame, frame: list[str] | None = None) -> DataFrame:
    """Frames whose relation ids are not 1..n, or whose relations name an end twice; empty if all is well."""
    frame = frame or ["frame_id"]
    sums = relations.groupBy(*frame).agg(F.count(F.lit(1)).alias("n"), F.max("relation_id").alias("top"), F.countDistinct("relation_id").alias("ids"), F.max((F.col("first_id") >= F.col("second_id")).cast("int")).alias("bad"))
    return sums.where("n <> top OR n <> ids OR bad = 1")
