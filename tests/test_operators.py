"""Single operators on hand-made inputs, at the boundaries of their rules."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus.functions import digest, image
from ocellus.functions import geometry as G
from ocellus.functions import text as X
from ocellus.operators import cache, change, continuous, detect, fusion, grouping, ids, lines, ocr, relations, tracker, visual_index
from ocellus.operators.grouping import map_groups

EV = "frame_id long, evidence_id long, x double, y double, w double, h double, kind string, class_id long, confidence double, text string, label string"


def ev(spark, *rows):
    full = [(1, i + 1, *r[:4], *(r[4:] if len(r) > 4 else ("text", 0, 0.5, "", ""))) for i, r in enumerate(rows)]
    return spark.createDataFrame(full, EV)


def test_iou_threshold_is_inclusive(spark):
    found = fusion.associate(ev(spark, (0.0, 0.0, 10.0, 10.0), (0.0, 0.0, 10.0, 5.0))).collect()
    assert [(r.rule, r.iou) for r in found] == [("iou", 0.5)]


def test_detections_of_other_classes_stay_apart_unless_a_third_item_joins_them(spark):
    a, b = (0.0, 0.0, 10.0, 10.0, "detection", 1, 0.5, "", "x"), (0.0, 0.0, 10.0, 10.0, "detection", 2, 0.5, "", "y")
    assert fusion.fuse(ev(spark, a, b)).count() == 2
    assert fusion.fuse(ev(spark, a, b, (0.0, 0.0, 10.0, 10.0, "text", 0, 0.5, "t", ""))).count() == 1


def test_fused_fields(spark):
    r = fusion.fuse(ev(spark, (0.0, 0.0, 10.0, 10.0, "external", 0, 1.0, "a", "role"), (0.0, 0.0, 10.0, 10.0, "text", 0, 0.5, "b", ""), (0.0, 0.0, 10.0, 9.0, "detection", 3, 0.25, "", "icon"))).first()
    assert (r.text, r.label, r.source_mask, r.evidence_ids) == ("a\nb", "role", 7, [1, 2, 3])
    assert r.confidence == pytest.approx((1.0 + 0.45 + 0.2) / 2.7)


def test_star_grouping_is_not_transitive(spark):
    rows = [(0.0, 0.0, 100.0, 10.0), (10.0, 0.0, 100.0, 10.0), (20.0, 0.0, 100.0, 10.0)]
    regions = ev(spark, *rows).withColumnRenamed("evidence_id", "region_id")
    got = {r.region_id: r.anchor for r in relations.duplicate_groups(regions).collect()}
    assert got == {1: 1, 2: 1, 3: 3}


def test_nms_keeps_what_overlaps_exactly_by_the_threshold(spark):
    rows = ev(spark, (0.0, 0.0, 10.0, 10.0, "detection", 1, 0.9, "", ""), (0.0, 0.0, 10.0, 5.0, "detection", 1, 0.8, "", ""), (0.0, 0.0, 10.0, 6.0, "detection", 1, 0.7, "", ""))
    assert sorted(r.evidence_id for r in detect.nms(rows).collect()) == [1, 2]


def test_identities_merge_and_split(monkeypatch):
    monkeypatch.setattr(ids, "CENTER_GATE", 0.1)
    state = ids.IdState()
    R = ids.Region
    assert state.advance([R(0, 0, 10, 10), R(20, 0, 10, 10)])[0] == ["new", "new"]
    events, tally = state.advance([R(-200, -200, 500, 500)])
    assert events == ["merged"] and tally["bump"]
    assert state.advance([R(-150, -150, 10, 10), R(150, 150, 10, 10)])[0] == ["splitChild", "splitChild"]
    with pytest.raises(ValueError):
        state.advance([R(0, 0, 1, 1)], {0: 1, 1: 1})


def test_confirmed_match_goes_first():
    state = ids.IdState()
    R = ids.Region
    state.advance([R(0, 0, 10, 10), R(100, 0, 10, 10)])
    state.advance([R(0, 0, 10, 10)], {0: 2})
    assert state.previous[0].stable_id == 2


def test_confirmation_window():
    e = continuous.Entity()
    assert e.observe(1, "present") == []
    assert e.observe(1, "present") == []  # a replay counts once
    assert e.observe(2, "present") == [("begin", "appeared", 1, 2, 1)]
    assert e.observe(3, "absent") == [] and e.observe(4, "uncovered") == [] and e.observe(5, "absent") == []
    assert e.observe(6, "absent") == [("end", "disappeared", 5, 6, 1)]
    assert e.observe(7, "present") + e.observe(8, "present") == [("begin", "appeared", 7, 8, 2)]
    assert e.observe(9, "reset") == [("end", "sourceReset", 0, 0, 2)]
    assert e.observe(1, "present") + e.observe(2, "present", notify=False) == [] and e.open and e.instance == 1


def test_changed_text_is_confirmed_twice():
    e = continuous.Entity()
    e.observe(1, "present", ("a", "", ()))
    e.observe(2, "present", ("a", "", ()))
    assert e.observe(3, "present", ("b", "", ())) == [] and e.observe(4, "present", ("c", "", ())) == []
    assert e.observe(5, "present", ("c", "", ())) == [("update", "textChanged", 4, 5, 1)]
    assert e.observe(6, "present", ("c", "l", "7")) == []
    assert e.observe(7, "present", ("c", "l", "7")) == [("update", "appearanceChanged", 6, 7, 1), ("update", "relationChanged", 6, 7, 1)]


def test_occlusion_starts_where_it_was_first_seen():
    e = continuous.Entity()
    e.observe(1, "present")
    e.observe(2, "present")
    assert e.observe(3, "absent", occluder=True) == [] and e.observe(4, "absent", occluder=True) == [("update", "relationChanged", 3, 4, 1)]
    assert e.observe(5, "absent", lost=True) == [] and e.state == "trackingLost"
    assert e.observe(6, "present") == [] and e.observe(7, "present") == [("update", "relationChanged", 6, 7, 1)]


def test_an_empty_frame_ends_a_generation(spark):
    rows = [(1, s, 1, 0.0, 0.0, 9.0, 9.0, "") for s in (1, 2, 4, 5, 9)]
    got = ids.track(spark.createDataFrame(rows, "source_id long, seq long, region_id long, x double, y double, w double, h double, text string")).collect()
    assert [(r.stable_id, r.generation) for r in sorted(got, key=lambda r: r.seq)] == [(1, 1), (1, 1), (2, 2), (2, 2), (3, 3)]


def test_too_large_a_policy_is_refused(spark):
    rows = [(i, 0, False, 0, 0, "t", "", 0.0, 0.0, 0.0, 0.0) for i in range(65)]
    conditions = spark.createDataFrame(rows, "idx int, priority int, bind_stable_id boolean, stable_id long, bound_generation long, text_equals string, label_equals string, roi_x double, roi_y double, roi_w double, roi_h double")
    with pytest.raises(grouping.BudgetExceeded):
        continuous.checked_policy(conditions)
    assert continuous.checked_policy(conditions.where("idx < 64")).count() == 64


def test_track_is_lost_after_the_limit():
    t = tracker.Track()
    for i in range(5):
        t.commit("placeholder", i)
    assert (t.state, t.streak, t.lost_seq) == ("lost", 5, 4)
    t.commit("vetoed", 9)
    assert t.state == "lost"
    t.commit("tentative", 10)
    assert (t.state, t.streak) == ("tracking", 0)


def test_backoff_doubles_to_its_cap(spark):
    got = [r[0] for r in spark.range(1, 9).select(tracker.backoff(F.col("id"))).collect()]
    assert got == [1, 2, 4, 8, 16, 32, 60, 60]


def test_lru_promotes_on_lookup_only():
    c = cache.Lru(3 * 164)
    for k in (1, 2, 3):
        c.apply("insert", k, 100)
    c.apply("lookup", 1)
    c.apply("contains", 2)
    assert c.apply("insert", 4, 100) == (True, [2])
    assert c.apply("insert", 5, 1000) == (False, [])


def test_memoised_calls_see_each_missing_key_once(spark):
    seen = []
    requests = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    known = spark.createDataFrame([(2, 20)], "k int, v int")

    def compute(df):
        seen.append(df.count())
        return df.withColumn("v", F.col("k") * 10)

    result, fresh = cache.memoised(requests, known, ["k"], compute)
    assert sorted(r.v for r in result.collect()) == [10, 10, 20] and seen == [1] and fresh.count() == 1
    assert cache.memoised(requests, known, ["k"], compute, "readOnly")[1].count() == 0


def test_text_rules(spark):
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(X.normalize(F.lit("  Ａ\x07 b\t\n c　"))) == "A b c"
    assert one(X.similarity(F.lit("é"), F.lit("e"))) == 0.0
    assert one(X.similarity(F.lit("abcd"), F.lit("abce"))) == 0.75
    assert len(one(X.truncated(F.lit("é" * 1000))).encode()) <= 1024
    assert one(X.error_code_name(F.lit(3))) == "CoordinateTransform" and one(X.error_code_name(F.lit(99))) == "Unknown"


def test_transforms_round_trip(spark):
    m = G.compose(G.rotation(F.lit(270), F.lit(640.0), F.lit(480.0)), G.letterbox(F.lit(480.0), F.lit(640.0), F.lit(320.0), F.lit(320.0)))
    p = G.map_point(m, F.lit(12.0), F.lit(34.0))
    back = G.map_point(G.inverse(m), p["x"], p["y"])
    r = spark.range(1).select(back["x"], back["y"], G.inverse(G.scale(0, 1))).first()
    assert (r[0], r[1]) == pytest.approx((12.0, 34.0)) and r[2] is None


def test_images():
    rgb = np.arange(48, dtype=np.uint8).reshape(4, 4, 3)
    assert (image.convert(image.convert(rgb, "Rgb8", "Bgra8"), "Bgra8", "Rgb8") == rgb).all()
    assert image.to_gray(rgb, "Rgb8")[0, 0] == (77 * 0 + 150 * 1 + 29 * 2 + 128) >> 8
    assert (image.resize_area(np.full((7, 5), 9, np.uint8), 3, 2) == 9).all()
    assert image.resize_area(np.array([[0, 1]], np.uint8), 1, 1)[0, 0] == 1  # halves go up
    boxed, (sx, _, x, y) = image.letterbox(rgb, 8, 16)
    assert boxed.shape == (16, 8, 3) and (sx, x, y) == (2.0, 0, 4)
    assert image.nv12_rgb(np.full((2, 2), 100, np.uint8), np.array([128, 128], np.uint8)).tolist() == [[[100] * 3] * 2] * 2
    assert image.fnv1a(b"a") == 0xAF63DC4C8601EC8C
    with pytest.raises(image.UnsupportedFormat):
        image.convert(rgb, "Rgb8", "Nv12")


def test_image_column(spark):
    df = spark.createDataFrame([(1, bytearray([1, 2, 0, 3, 4, 0]), 2, 2, 3, "Gray8")], "id int, data binary, width int, height int, stride long, format string")
    assert image.map_images(df, lambda a, f: int(a.sum()), "id int, result long", ["id"]).first().result == 10


def test_digests_tell_fields_apart():
    assert digest.digest(["ab", "c"]) != digest.digest(["a", "bc"]) and digest.digest([None]) != digest.digest([""])


def test_first_frame_is_a_global_change(spark):
    frames = spark.createDataFrame([(1, 1, [0] * 64), (1, 2, [0] * 64), (1, 3, [255] * 64)], "source_id long, seq long, px array<int>")
    got = [(r.classification, r.similarity) for r in change.detect(frames).orderBy("seq").collect()]
    assert got == [("global", 1.0), ("none", 1.0), ("none", 1.0)]  # flat frames have equal hashes


def test_merged_lines(spark):
    rows = ev(spark, (0.0, 0.0, 10.0, 10.0, "text", 0, 0.9, "a", ""), (15.0, 1.0, 10.0, 10.0, "text", 0, 0.8, "b", ""), (0.0, 50.0, 10.0, 10.0, "text", 0, 0.7, "c", ""))
    assert [(r.text, r.confidence) for r in ocr.merge_lines(rows).orderBy("line").collect()] == [("a b", 0.8), ("c", 0.7)]


def test_closed_rectangle_is_proposed(spark):
    sides = [(0, 0, 10, 0), (10, 0, 10, 8), (10, 8, 0, 8), (0, 8, 0, 0)]
    df = spark.createDataFrame([(1, i, *map(float, s), 1.0) for i, s in enumerate(sides)], "frame_id long, segment_id long, x0 double, y0 double, x1 double, y1 double, confidence double")
    r = lines.propose(df).first()
    assert (r.closure, r.junctions, r.x, r.y, r.w, r.h) == (1.0, 4, 0.0, 0.0, 10.0, 8.0) and r.rectangularity == pytest.approx(1.0)
    assert lines.oriented_box([(0, 0), (4, 0), (4, 2), (0, 2)])[2:4] == (4, 2)


def test_flat_thumbnails_correlate_only_if_equal(spark):
    one = lambda a, b: spark.range(1).select(visual_index.ncc(F.array(*map(F.lit, a)), F.array(*map(F.lit, b)))).first()[0]
    assert one([5, 5], [5, 5]) == 1.0 and one([5, 5], [6, 6]) == 0.0 and one([1, 2], [2, 1]) == -1.0


def test_groups_have_a_budget(spark):
    df = spark.range(10).select(F.lit(1).cast("long").alias("k"), "id")
    with pytest.raises(Exception, match="more than 4 rows"):
        map_groups(df, ["k"], ["id"], lambda rows: rows, "k long, id long", most=4).collect()
