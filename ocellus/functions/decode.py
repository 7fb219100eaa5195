"""Decoding the outputs of recognition and tracking models."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.functions import geometry as G


def sigmoid(x: Column) -> Column:
    return 1 / (1 + F.exp(-x))


def ctc(steps: DataFrame, keys: list[str], charset: list[str], blank: int = 0) -> DataFrame:
    """Text and confidence of each line from its steps (``keys``, step, scores: array): the best class of each step (of equals the first),
    without repeats and blanks; confidence is the mean softmax probability of what is left, 0 if nothing is. ``charset`` names the classes."""
    s = F.col("scores")
    top = F.array_max(s)
    total = F.aggregate(s, F.lit(0.0), lambda a, x: a + F.exp(x.cast("double") - top))
    told = steps.select(*keys, "step", (F.array_position(s, top) - 1).cast("int").alias("best"), (1 / total).alias("p"))
    own = Window.partitionBy(*keys).orderBy("step")
    told = told.withColumn("fresh", (F.col("best") != blank) & F.coalesce(F.lag("best").over(own) != F.col("best"), F.lit(True)))
    names = F.array(*map(F.lit, charset))
    letters = F.array_sort(F.collect_list(F.when(F.col("fresh"), F.struct("step", F.element_at(names, F.col("best") + 1).alias("c")))))
    whole = told.groupBy(*keys).agg(letters.alias("letters"), F.coalesce(F.avg(F.when(F.col("fresh"), F.col("p"))), F.lit(0.0)).alias("confidence"))
    return whole.select(*keys, F.array_join("letters.c", "").alias("text"), "confidence")


def unletterboxed(boxes: DataFrame, width: Column, height: Column) -> DataFrame:
    """Boxes in model space (x, y, w, h) back in their image, given what was carried out (scale_x, scale_y, pad_x, pad_y), clipped to it;
    those without any part in it go."""
    left, top = (F.col("x") - F.col("pad_x")) / F.col("scale_x"), (F.col("y") - F.col("pad_y")) / F.col("scale_y")
    right, bottom = left + F.col("w") / F.col("scale_x"), top + F.col("h") / F.col("scale_y")
    zero = F.lit(0.0)
    x0, y0, x1, y1 = F.greatest(left, zero), F.greatest(top, zero), F.least(right, width), F.least(bottom, height)
    told = boxes.withColumns({"__x": x0, "__y": y0, "__w": x1 - x0, "__h": y1 - y0}).where("__w > 0 and __h > 0")
    return told.withColumns({c: F.col(f"__{c}") for c in "xywh"}).drop("__x", "__y", "__w", "__h")


def transform_segment(matrix: Column, x0: Column, y0: Column, x1: Column, y1: Column, confidence: Column) -> Column:
    """A segment's ends through a transform; its confidence stays."""
    a, b = G.map_point(matrix, x0, y0), G.map_point(matrix, x1, y1)
    return F.struct(a["x"].alias("x0"), a["y"].alias("y0"), b["x"].alias("x1"), b["y"].alias("y1"), confidence.alias("confidence"))


def cosine_window(side: int) -> np.ndarray:
    """Outer product of two Hann windows."""
    one = np.array([0.5 - 0.5 * math.cos(2 * math.pi * i / (side - 1)) for i in range(side)]) if side > 1 else np.ones(1)
    return np.outer(one, one)


def response_peak(scores: np.ndarray, influence: float = 0.455) -> tuple[int, int, float]:
    """Row, column and score of the best place on a response map (square, logits) after a cosine window has its share; of equals the first."""
    p = 1 / (1 + np.exp(-scores.astype(float)))
    held = p * (1 - influence) + cosine_window(len(scores)) * influence
    at = int(held.argmax())
    return at // scores.shape[1], at % scores.shape[1], float(p.flat[at])
