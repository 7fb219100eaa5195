"""Operators that no query calls, on rows made by hand."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import image
from ocellus.operators import change, continuous, detect, ocr, render, tracker
from ocellus.sources import frames


def test_tracks_that_lag_are_lost(spark):
    rows = [(1, "uncertain", 5, 3), (2, "uncertain", 5, 4), (3, "tracking", 5, 0)]
    got = tracker.sweep(spark.createDataFrame(rows, "track_id long, state string, layout_generation long, generation long")).collect()
    assert [r.state for r in sorted(got, key=lambda r: r.track_id)] == ["lost", "uncertain", "tracking"]


def test_a_second_opinion(spark):
    rows = [("confirmed", 0.5, 0.5), ("confirmed", 0.4, 0.9), ("tentative", 0.9, 0.4), ("placeholder", 0.0, 0.0), ("vetoed", 0.0, 0.0), ("confirmed", None, None)]
    got = spark.createDataFrame(rows, "g string, iou double, c double").select(tracker.deep_combined(F.col("g"), F.col("iou"), F.col("c")).alias("x")).collect()
    assert [r.x for r in got] == ["confirmed", "tentative", "placeholder", "placeholder", "vetoed", "confirmed"]


def test_rings_and_latest_entries(spark):
    rows = [(1, t, s) for t in (1, 2) for s in range(40)]
    df = spark.createDataFrame(rows, "source_id long, track_id long, seq long")
    assert sorted({r.seq for r in tracker.last_observations(df).collect()}) == list(range(8, 40))
    assert sorted((r.track_id, r.seq) for r in continuous.upsert(df, ["source_id", "track_id"], "seq").collect()) == [(1, 39), (2, 39)]


def test_plan_order(spark):
    rows = [(1, 1, "bootstrap", 9, 0), (1, 1, "focus", 1, 2), (1, 1, "focus", 5, 3), (1, 1, "focus", 5, 1)]
    got = continuous.plan_order(spark.createDataFrame(rows, "source_id long, seq long, kind string, priority int, idx int")).orderBy("place").collect()
    assert [(r.kind, r.idx) for r in got] == [("focus", 1), ("focus", 3), ("focus", 2), ("bootstrap", 0)]


def test_yolo_rows(spark):
    rows = [(1, 10.0, 10.0, 4.0, 6.0, 0.5, [0.2, 0.9, 0.9]), (2, 1.0, 1.0, 1.0, 1.0, 0.1, [0.9, 0.9, 0.9])]
    (r,) = detect.decode_yolo(spark.createDataFrame(rows, "frame_id long, cx double, cy double, w double, h double, objectness double, scores array<double>")).collect()
    assert (r.frame_id, r.x, r.y, r.class_id, r.confidence) == (1, 8.0, 7.0, 1, 0.45)


def test_refined_detections_take_their_place(spark):
    ddl = "frame_id long, evidence_id long, x double"
    df = spark.createDataFrame([(1, 1, 0.0), (1, 2, 0.0), (1, 3, 0.0)], ddl)
    refined = spark.createDataFrame([(1, 2, 5.0, 0), (1, 2, 6.0, 1), (1, 3, None, 0)], f"{ddl}, n int")
    got = detect.replace_refined(df, refined).collect()
    assert sorted((r.evidence_id, r.n, r.x) for r in got) == [(1, 0, 0.0), (2, 0, 5.0), (2, 1, 6.0)]


def test_valid_images(spark):
    rows = [(4, 3, 4, "Gray8", 0, 12), (4, 3, 12, "Rgb8", 90, 36), (4, 3, 11, "Rgb8", 0, 36), (4, 3, 4, "Gray8", 45, 12), (4, 3, 4, "Gray8", 0, 11), (0, 3, 4, "Gray8", 0, 12), (4, 3, 4, "Jpeg", 0, 12)]
    cols = [F.col(c) for c in "whsfrn"]
    got = spark.createDataFrame(rows, "w int, h int, s int, f string, r int, n int").select(image.valid_image(*cols).alias("ok")).collect()
    assert [r.ok for r in got] == [True, True, False, False, False, False, False]


def test_acceptance_and_its_reasons(spark):
    rows = [(1, 0, False, 5, 5), (2, 0, True, 5, 5), (3, 0, False, 5, 6), (4, 9, False, 5, 6)]
    tokens = spark.createDataFrame(rows, "token_id long, seq long, adopted boolean, content_digest long, now_digest long").withColumns({"source_id": F.lit("cam"), "epoch": F.lit(1), "policy_revision": F.lit(1), "generation": F.lit(1), "in_flight": F.lit(True)})
    got = continuous.accept(tokens, ["token_id"], source="cam", epoch=1, policy=1, generation=1, seq=0).orderBy("token_id").collect()
    assert [(r.reason, r.accepted) for r in got] == [(None, True), ("duplicateSubmission", False), ("contentMismatch", False), ("staleFrameSequence", False)]


def test_events_that_cannot_be(spark):
    ddl = "source_id long, stable_id long, seq long, kind string, what string, from_seq long, instance int, event_sequence long"
    good = [(1, 1, 2, "begin", "appeared", 1, 1, 1), (1, 2, 3, "begin", "appeared", 2, 1, 2), (1, 1, 5, "update", "textChanged", 4, 1, 3), (1, 1, 7, "end", "disappeared", 6, 1, 4), (1, 1, 9, "begin", "appeared", 8, 2, 5)]
    assert continuous.event_violations(spark.createDataFrame(good, ddl)).count() == 0
    bad = [(2, 1, 2, "begin", "appeared", 3, 1, 1), (2, 2, 3, "update", "textChanged", 2, 1, 2), (2, 1, 4, "begin", "appeared", 4, 2, 4), (2, 3, 5, "begin", "appeared", 4, 0, 5)]
    got = continuous.event_violations(spark.createDataFrame(bad, ddl)).orderBy("event_sequence").collect()
    assert [r.problem for r in got] == ["window", "order", "gap", "instance"]
    events = spark.createDataFrame(good, ddl)
    assert [r.event_sequence for r in continuous.undrained(events, events.where("event_sequence <= 2")).collect()] == [3, 4, 5]


def test_reports_that_do_not_follow(spark):
    states = spark.createDataFrame([(1, "recognized"), (1, "deferred"), (2, "recognized")], "frame_id long, state string")
    told = ocr.report(states)
    assert ocr.report_violations(states, told).count() == 0
    assert [r.frame_id for r in ocr.report_violations(states, told.withColumn("complete", F.lit(True))).collect()] == [1]


def test_marked_images(spark):
    blank = np.zeros((40, 50), np.uint8)
    pictures = spark.createDataFrame([(f, bytearray(blank.tobytes()), 50, 40, 50, "Gray8") for f in (1, 2)], "frame_id long, data binary, width int, height int, stride int, format string")
    marks = render.marks(spark.createDataFrame([(1, 3, 10.0, 15.0, 20.0, 12.0)], "frame_id long, region_id long, x double, y double, w double, h double"), 50, 40)
    got = {r.frame_id: np.frombuffer(r.data, np.uint8).reshape(r.height, r.width, 3) for r in render.marked(pictures, marks, render.chips(marks, 50, 40)).collect()}
    color = list(render.PALETTE[3])
    assert not got[2].any() and got[1][15, 12].tolist() == color and got[1][26, 29].tolist() == color and not got[1][20, 20].any()
    chip = got[1][6:15, 10:18]
    assert (chip == 255).all(2).sum() == sum(bin(int(b)).count("1") for b in render.DIGITS[1]) and chip[0, 0].tolist() == color


def test_sources(spark, tmp_path):
    scene = tmp_path / "scene1" / "frames"
    scene.mkdir(parents=True)
    (scene / "frame_00012.png").write_bytes(b"pixels")
    (r,) = frames.read_images(spark, str(tmp_path)).collect()
    assert (r.scene_id, r.seq, r.length, bytes(r.content)) == ("scene1", 12, 6, b"pixels")
    (tmp_path / "manifest.json").write_text(json.dumps({"scene_id": "scene1", "platform": "x", "width": 3, "height": 4, "rotation": 0, "frame_count": 1, "fps_hint": 2.5, "notes": ""}))
    assert frames.read_manifests(spark, f"{tmp_path}/manifest.json").first().fps_hint == 2.5
    (tmp_path / "labels.json").write_text(json.dumps({"scene_id": "scene1", "frames": [{"seq": 12, "boxes": [{"x": 1, "y": 2, "w": 3, "h": 4, "label": "a", "text": "t"}]}]}))
    assert frames.read_labels(spark, f"{tmp_path}/labels.json").first().asDict() == {"scene_id": "scene1", "seq": 12, "pos": 0, "x": 1.0, "y": 2.0, "w": 3.0, "h": 4.0, "label": "a", "text": "t"}
    (tmp_path / "charset.txt").write_text("a\nb\n漢\n")
    assert [(r["index"], r.symbol) for r in frames.read_charset(spark, f"{tmp_path}/charset.txt").collect()] == [(1, "a"), (2, "b"), (3, "漢")]
    nodes = spark.createDataFrame([(1, 1, 2, 4, 6, None, "Button", "d", True, False)], "frame_id long, left int, top int, right int, bottom int, text string, class_name string, description string, clickable boolean, enabled boolean")
    r = frames.accessibility_regions(nodes).first()
    assert (r.x, r.y, r.w, r.h, r.text, r.role, r.interactive, r.enabled) == (1.0, 2.0, 3.0, 4.0, "", "Button", True, False)
    events = spark.createDataFrame([(1, 1), (2, 1)], "source_id long, event_sequence long")
    for _ in range(2):
        frames.write_events(events, f"{tmp_path}/events")
    assert spark.read.parquet(f"{tmp_path}/events").count() == 4
    frames.write_marks(events, f"{tmp_path}/marks")
    with pytest.raises(Exception, match="exists"):
        frames.write_marks(events, f"{tmp_path}/marks")


def test_ignored_rectangles_hold_whole_blocks():
    assert change.ignored_blocks([(0, 0, 320, 180)]) == [0] and change.ignored_blocks([(0, 0, 319, 180)]) == []
    assert change.ignored_blocks([(300, 0, 700, 400), (960, 540, 320, 180)]) == [1, 2, 5, 6][:2] + [5, 6][: 2 * (400 >= 360)] + [15]
