"""Queries run over their whole tables and whole texts."""

import random

import pytest
from pyspark.sql import functions as F

from ocellus.operators import render
from ocellus.plans import catalog
from ocellus.sources import fixtures as fx

def test_compensated_tracks_has_every_frame(spark, sf_dir):
    frames = lambda df: sorted((r.source_id, r.seq) for r in df.select("source_id", "seq").collect())
    assert frames(catalog.QUERIES["compensated_tracks"](spark, sf_dir)) == frames(fx.thumbs(spark, sf_dir))


def distance(a: bytes, b: bytes) -> int:
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        left = [i]
        for j, y in enumerate(b, 1):
            left.append(min(row[j] + 1, left[-1] + 1, row[j - 1] + (x != y)))
        row = left
    return row[-1]


def test_turns_are_compared_whole(spark, tmp_path):
    rng, head = random.Random(3), "same beginning " * 20
    texts = [head + "".join(rng.choices("abcé ", k=rng.randint(1, 120))) for _ in range(8)] + ["", None, head]
    spark.createDataFrame([(1, i, t) for i, t in enumerate(texts)], "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    raw = [(t or "").encode() for t in texts]
    expected = {i: 1 - distance(raw[i - 1], raw[i]) / max(len(raw[i - 1]), len(raw[i])) if raw[i - 1] and raw[i] else 0.0 for i in range(1, len(raw))}
    got = {r.turn: r.similarity for r in catalog.QUERIES["turn_similarity"](spark, str(tmp_path)).collect()}
    assert got == pytest.approx(expected) and max(got.values()) < 1


def test_every_region_gets_a_mark(spark):
    regions = spark.range(300).select(F.lit(1).alias("frame_id"), F.col("id").alias("region_id"), *(F.lit(v).alias(c) for c, v in (("x", 1.0), ("y", 1.0), ("w", 5.0), ("h", 5.0))))
    marked = render.marks(regions, 40, 30)
    assert sorted(r.mark for r in marked.collect()) == list(range(1, 301))
    assert render.chips(marked, 40, 30).count() == 300
