"""Verification of tracks against frames made by hand."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import image
from ocellus.operators import verification as V

FRAMES = "source_id long, seq long, data binary, width int, height int, stride int, format string"
TRACKS = "source_id long, track_id long, seq long, x double, y double, w double, h double, cx double, cy double, templates int"


@pytest.fixture(scope="module")
def scene(spark):
    rng = np.random.default_rng(3)
    pixels = rng.integers(0, 256, (60, 80, 3), np.uint8)
    frames = spark.createDataFrame([(1, 5, bytearray(pixels.tobytes()), 80, 60, 240, "Rgb8")], FRAMES)
    return pixels, frames


def test_windows_are_thumbnails_of_every_whole_step(spark, scene):
    pixels, frames = scene
    tracks = spark.createDataFrame([(1, 7, 5, 20.0, 15.0, 12.0, 9.0, 27.0, 20.5, 1), (1, 8, 5, 200.0, 15.0, 12.0, 9.0, 206.0, 19.5, 1), (1, 9, 5, 0.0, 0.0, float("nan"), 9.0, 5.0, 5.0, 1)], TRACKS)
    got = V.windows(tracks, frames, side=8).collect()
    assert {(r.track_id, r.status) for r in got} == {(7, "Ok"), (8, "InvalidArgument"), (9, "InvalidArgument")}
    found = {(r.dx, r.dy): r.px for r in got if r.track_id == 7}
    # The diagonal is 15: 7.5 more to every side of the predicted place, which is 1 right and 1 below of the last one.
    assert sorted(found) == sorted((dx, dy) for dx in range(-7, 10) for dy in range(-7, 10))
    for (dx, dy), px in found.items():
        part = pixels[15 + dy : 24 + dy, 20 + dx : 32 + dx]
        assert px == image.resize_area(image.to_gray(part, "Rgb8"), 8, 8).ravel().tolist()


def test_a_search_beyond_its_budget_is_refused(spark, scene):
    tracks = spark.createDataFrame([(1, 7, 5, 20.0, 15.0, 12.0, 9.0, 26.0, 19.5, 1)], TRACKS)
    assert [r.status for r in V.windows(tracks, scene[1], budget=1000).collect()] == ["BudgetExceeded"]


def test_a_track_is_found_where_it_went(spark, scene):
    pixels, frames = scene
    own = image.resize_area(image.to_gray(pixels[18:27, 24:36], "Rgb8"), 16, 16).ravel().tolist()
    tracks = spark.createDataFrame([(1, 7, 5, 20.0, 15.0, 12.0, 9.0, 26.0, 19.5, 2)], TRACKS)
    templates = spark.createDataFrame([(1, 7, 0, [7] * 256), (1, 7, 1, own)], "source_id long, track_id long, place int, px array<int>")
    told = V.appearance(V.peaks(V.responses(V.windows(tracks, frames, side=16), templates))).collect()
    assert [(r.place, r.dx, r.dy, r.outcome, round(r.ncc, 9)) for r in told] == [(1, 4, 3, "strong", 1.0)] and told[0].psr > V.SIDELOBE


def test_peaks_of_equal_height_and_of_one_response(spark):
    rows = [(1, 1, 0, 0, dx, dy, 0.5) for dx in (-1, 0, 1) for dy in (-1, 1)] + [(1, 2, 0, 0, 0, 0, 0.25)]
    got = {r.track_id: r for r in V.peaks(spark.createDataFrame(rows, "source_id long, track_id long, seq long, place int, dx int, dy int, ncc double")).collect()}
    assert (got[1].dx, got[1].dy, got[1].psr) == (-1, -1, 0.0) and got[2].psr == pytest.approx(0.25 / V.EPSILON)


def test_the_first_template_stays(spark):
    rows = [(1, 1, i, [i]) for i in range(7)]
    kept = V.kept_templates(spark.createDataFrame(rows, "source_id long, track_id long, added long, px array<int>"))
    assert [(r.place, r.added) for r in sorted(kept.collect())] == [(0, 0), (1, 4), (2, 5), (3, 6)] or sorted((r.place, r.added) for r in kept.collect()) == [(0, 0), (1, 4), (2, 5), (3, 6)]
    assert sorted(r.added for r in V.kept_templates(kept.drop("place"), 2, 0).collect()) == [5, 6]


def test_adoption_makes_room(spark):
    pool = spark.createDataFrame([(1, 1, "tracking", 9, 100), (1, 2, "terminated", 50, 100), (1, 3, "lost", 3, 100), (2, 4, "tracking", 1, 100)], "source_id long, track_id long, state string, last_verified long, n_bytes long")
    fresh = spark.createDataFrame([(1, 10, 100)], "source_id long, track_id long, n_bytes long")
    states = lambda most, budget: {r.track_id: r.state for r in V.adopted(pool, fresh, most, budget).collect()}
    assert states(4, 1000) == {1: "tracking", 2: "terminated", 3: "lost", 10: "tracking", 4: "tracking"}
    assert states(3, 1000)[2] == "evicted" and states(3, 1000)[3] == "lost"
    assert [i for i, s in states(4, 250).items() if s == "evicted"] == [2, 3] and states(4, 250)[1] == "tracking"
    assert 10 not in states(4, 99) and "evicted" not in states(4, 99).values()
    over = V.archived(pool, spark.createDataFrame([(1, 1, 60)], "source_id long, track_id long, seq long")).where("track_id = 1").first()
    assert (over.state, over.ended_seq, over.n_bytes) == ("terminated", 60, V.TRACK_BYTES)


def test_structure_and_semantics(spark):
    now = spark.createDataFrame([(1, i, 9, c, 0.5, 0.5) for i, c in ((1, 0.9), (2, 0.5), (3, None), (4, 0.5))], "source_id long, track_id long, seq long, closure double, rectangularity double, edge_support double")
    base = V.baselines(spark.createDataFrame([(1, i, s, 0.5, 0.5, 0.5) for i in (1, 2, 3) for s in (1, 2)] + [(1, 4, 1, 1.5, 0.5, 0.5)], "source_id long, track_id long, seq long, closure double, rectangularity double, edge_support double"))
    got = {r.track_id: (r.structure, r.deviation) for r in V.structure(now, base).collect()}
    assert got == {1: ("deviated", pytest.approx(0.8)), 2: ("consistent", 0.0), 3: ("notSupplied", None), 4: ("noBaseline", None)}
    told = spark.range(1).select(V.level(F.lit("none"), F.lit("consistent")).alias("a"), V.level(F.lit("weak"), F.lit("deviated")).alias("b"), V.semantics_conflict(F.lit("x"), F.lit("")).alias("c"), V.semantics_conflict(F.lit("x"), F.lit("y")).alias("d")).first()
    assert tuple(told) == ("strong", "weak", False, True)
