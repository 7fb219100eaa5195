"""Evidence and its fusion into regions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G
from ocellus.operators.grouping import components

#: Bits of a source mask, and weights of kinds in a fused confidence (tenths).
SOURCE_BITS = {"external": 1, "text": 2, "detection": 4, "cache": 8, "template": 16}
WEIGHTS = {"external": 10, "text": 9, "detection": 8, "template": 7}
MOST_EVIDENCE = 4096
MOST_REGIONS = 1024


def by_kind(kind: Column, values: dict[str, int]) -> Column:
    return reduce(lambda c, kv: c.when(kind == kv[0], kv[1]), list(values.items())[1:], F.when(kind == next(iter(values)), next(iter(values.values()))))


def valid_evidence(df: DataFrame) -> Column:
    """Finite bounds, sizes not negative, and a coordinate space in which evidence may be given."""
    finite = reduce(lambda a, b: a & b, (F.col(c).isNotNull() & ~F.isnan(c) & (F.abs(F.col(c)) < float("inf")) for c in "xywh"))
    space = F.coalesce(F.col("space"), F.lit(0)).isin(0, 1, 4) if "space" in df.columns else F.lit(True)
    return finite & (F.col("w") >= 0) & (F.col("h") >= 0) & space


def collect_evidence(parts: dict[str, DataFrame], frame: list[str], ingest: str) -> DataFrame:
    """One evidence table of several kinds: ids from 1 in order of arrival within a frame, and a status per frame."""
    union = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), (df.withColumn("kind", F.lit(k)) for k, df in parts.items()))
    ids = F.row_number().over(Window.partitionBy(*frame).orderBy(ingest, "kind"))
    counted = union.withColumn("evidence_id", ids.cast("long")).withColumn("n", F.count(F.lit(1)).over(Window.partitionBy(*frame)))
    bad = F.max((~valid_evidence(union)).cast("int")).over(Window.partitionBy(*frame)) > 0
    status = F.when(bad, "InvalidArgument").when(F.col("n") > MOST_EVIDENCE, "BudgetExceeded").otherwise("Ok")
    return counted.withColumn("status", status).drop("n")


def compatible(a: str, b: str) -> Column:
    """Two detections must agree on class, and on label where both have one; all other kinds go together."""
    both = (F.col(f"{a}.kind") == "detection") & (F.col(f"{b}.kind") == "detection")
    la, lb = F.col(f"{a}.label"), F.col(f"{b}.label")
    return ~both | ((F.col(f"{a}.class_id") == F.col(f"{b}.class_id")) & ((la == "") | (lb == "") | (la == lb)))


def frame_pairs(df: DataFrame, frame: list[str], id_col: str, *more: str) -> DataFrame:
    """All pairs a.id < b.id of overlapping rectangles of a frame, as structs a and b of id, rectangle and ``more``. The frame is an equi-key,
    so this is a hash or merge join with a range condition on top, not a nested loop; nothing else travels."""
    cols = F.struct(id_col, *"xywh", *more)
    a, b = df.select(*frame, cols.alias("a")), df.select(*frame, cols.alias("b"))
    return a.join(b, frame).where((F.col(f"a.{id_col}") < F.col(f"b.{id_col}")) & G.overlaps(G.Rect.of("a."), G.Rect.of("b.")))


def associate(evidence: DataFrame, frame: list[str] | None = None, iou_threshold: float = 0.5, containment_threshold: float = 0.8) -> DataFrame:
    """Pairs of evidence that describe the same thing, with their measures and the rule that joined them."""
    frame = frame or ["frame_id"]
    a, b = G.Rect.of("a."), G.Rect.of("b.")
    iou, inside = G.iou(a, b), G.containment(a, b)
    found = frame_pairs(evidence, frame, "evidence_id", "kind", "class_id", "label").where(compatible("a", "b")).select(*frame, F.col("a.evidence_id").alias("first_id"), F.col("b.evidence_id").alias("second_id"), iou.alias("iou"), inside.alias("containment"), G.center_distance(a, b).alias("center_distance"))
    rule = F.when(F.col("iou") >= iou_threshold, "iou").when(F.col("containment") >= containment_threshold, "containment")
    return found.withColumn("rule", rule).where(F.col("rule").isNotNull())


def clusters(evidence: DataFrame, frame: list[str] | None = None, **options: float) -> DataFrame:
    """``evidence`` with root: the smallest id of those connected with it by association."""
    frame = frame or ["frame_id"]
    found = components(associate(evidence, frame, **options), frame, "first_id", "second_id").withColumnRenamed("id", "evidence_id")
    return evidence.join(found, [*frame, "evidence_id"], "left").withColumn("root", F.coalesce("root", "evidence_id"))


def fuse(evidence: DataFrame, frame: list[str] | None = None, **options: float) -> DataFrame:
    """One region per cluster: union of bounds, source mask, joined texts, first label, weighted confidence and evidence ids."""
    frame = frame or ["frame_id"]
    told = clusters(evidence, frame, **options)
    weight = by_kind(F.col("kind"), WEIGHTS)
    says_text = F.col("kind").isin("text", "external") & (F.col("text") != "")
    says_label = F.col("kind").isin("detection", "external") & (F.col("label") != "")
    listed = lambda keep, c: F.array_sort(F.collect_list(F.when(keep, F.struct("evidence_id", F.col(c).alias("v")))))
    confidence = F.least(F.greatest(F.col("confidence").cast("double"), F.lit(0.0)), F.lit(1.0))
    grouped = told.groupBy(*frame, "root").agg(
        F.min("x").alias("x"), F.min("y").alias("y"), F.max(F.col("x") + F.col("w")).alias("right"), F.max(F.col("y") + F.col("h")).alias("bottom"),
        F.bit_or(by_kind(F.col("kind"), SOURCE_BITS)).alias("source_mask"),
        F.array_join(F.transform(listed(says_text, "text"), lambda t: t["v"]), "\n").alias("text"),
        F.coalesce(F.min(F.when(says_label, F.struct("evidence_id", F.col("label").alias("v"))))["v"], F.lit("")).alias("label"),
        (F.sum(weight * confidence) / F.sum(weight)).alias("confidence"),
        F.array_sort(F.collect_list("evidence_id")).alias("evidence_ids"),
    )
    return grouped.select(*frame, F.col("root").alias("region_id"), "x", "y", (F.col("right") - F.col("x")).alias("w"), (F.col("bottom") - F.col("y")).alias("h"), "source_mask", "text", "label", "confidence", "evidence_ids")
