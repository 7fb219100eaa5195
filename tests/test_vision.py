"""Line detection, resizing, decoding and backends against simple versions of the same."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from ocellus import backends
from ocellus.functions import decode, growing, image
from ocellus.operators import cycle, lines, session

FRAMES = "source_id long, seq long, data binary, width int, height int, stride int, format string"


def drawn(rows=60, cols=80):
    gray = np.full((rows, cols), 20, np.uint8)
    gray[20:, :] = 220  # one long edge
    gray[5:15, 10:12] = 200  # a thin stroke: an edge to either side
    return gray


def brute_regions(gray, p):
    """Regions by a plain flood fill with a stack."""
    h, w = gray.shape
    g = gray.astype(int)
    grad = lambda x, y: (g[y, x + 1] - g[y, x - 1], g[y + 1, x] - g[y - 1, x])
    taken, out = set(), []
    sine = math.sin(math.radians(p.degrees)) ** 2
    for y in range(1, h - 1):
        for x in range(1, w - 1):
            gx, gy = grad(x, y)
            if (x, y) in taken or abs(gx) + abs(gy) < p.gradient:
                continue
            region, todo = {(x, y)}, [(x, y)]
            taken.add((x, y))
            while todo:
                cx, cy = todo.pop()
                for nx in range(max(1, cx - 1), min(w - 1, cx + 2)):
                    for ny in range(max(1, cy - 1), min(h - 1, cy + 2)):
                        ox, oy = grad(nx, ny)
                        near = abs(ox) + abs(oy) >= p.gradient and gx * ox + gy * oy >= 0 and (gx * oy - gy * ox) ** 2 <= (gx * gx + gy * gy) * (ox * ox + oy * oy) * sine
                        if near and (nx, ny) not in taken:
                            taken.add((nx, ny))
                            region.add((nx, ny))
                            todo.append((nx, ny))
            out.append(region)
    return out


def test_regions_equal_a_flood_fill():
    rng = np.random.default_rng(2)
    for gray in (drawn(), rng.integers(0, 256, (25, 30), np.uint8), np.zeros((9, 9), np.uint8)):
        p = growing.Growing()
        got = [{tuple(map(int, q)) for q in r} for r in growing.Regions(gray, p)]
        assert got == brute_regions(gray, p)


def test_segments_lie_on_edges(spark):
    found = growing.segments(drawn())
    longest = max(found, key=lambda s: math.hypot(s[2] - s[0], s[3] - s[1]))
    assert abs(longest[1] - 19.5) < 0.6 and abs(longest[3] - 19.5) < 0.6 and abs(longest[2] - longest[0]) > 70
    upright = [s for s in found if abs(s[0] - s[2]) < 0.5]
    assert len(upright) == 2 and all(abs(s[3] - s[1]) >= 8 for s in upright)  # opposite edges stay apart
    frames = spark.createDataFrame([(1, 1, bytearray(drawn().tobytes()), 80, 60, 80, "Gray8"), (1, 2, bytearray(bytes(60 * 240)), 80, 60, 240, "Rgb8")], FRAMES)
    rows = growing.detect(frames).collect()
    assert sorted((r.segment_id, r.x0) for r in rows if r.status == "Ok") == [(i, s[0]) for i, s in enumerate(found)]
    assert [r.status for r in rows if r.seq == 2] == ["UnsupportedFormat"]
    with pytest.raises(growing.BudgetExceeded):
        growing.segments(drawn(), growing.Growing(most=1, shortest=0))
    with pytest.raises(ValueError):
        growing.Growing(gradient=0)


def test_principal_axis_of_rows(spark):
    rng = np.random.default_rng(5)
    points = rng.normal(0, 1, (50, 2)) @ np.array([[3.0, 1.0], [0.0, 0.4]])
    center, way = growing.axis(points)
    r = spark.createDataFrame(points.tolist(), "x double, y double").agg(growing.principal_axis(F.col("x"), F.col("y")).alias("a")).first().a
    assert (r.mx, r.my, r.dx, r.dy) == pytest.approx((*center, *way))
    values, vectors = np.linalg.eigh(np.cov(points.T))
    assert abs(vectors[:, 1] @ way) == pytest.approx(1)


def test_resizing_and_padding():
    rng = np.random.default_rng(1)
    flat = np.full((7, 9, 3), 77, np.uint8)
    assert (image.resize_bilinear(flat, 4, 5) == 77).all()
    ramp = np.repeat(np.arange(0, 160, 10, dtype=np.uint8)[None], 4, 0)
    assert image.resize_bilinear(ramp, 8, 4)[0].tolist() == [5, 25, 45, 65, 85, 105, 125, 145]
    assert (image.resize_bilinear(ramp, 16, 4) == ramp).all()
    box, carried = image.letterbox(rng.integers(0, 256, (30, 60, 3), np.uint8), 32, 32, 114, image.resize_bilinear)
    assert box.shape == (32, 32, 3) and carried == (32 / 60, 16 / 30, 0, 8) and (box[:8] == 114).all()
    part = rng.integers(0, 256, (33, 50), np.uint8)
    wide = image.canvas(part)
    assert wide.shape == (64, 64) and (image.unpadded(wide, 50, 33) == part).all() and not wide[33:].any()
    luma, u, v = np.full((4, 6), 90, np.uint8), np.full((2, 3), 128, np.uint8), np.full((2, 3), 128, np.uint8)
    assert (image.yuv420_rgb(luma, u, v) == 90).all()
    y, pairs = image.nv12_crop(luma, np.arange(12, dtype=np.uint8).reshape(2, 6), 2, 2, 3, 1)
    assert y.shape == (1, 3) and pairs.tolist() == [[8, 9, 10, 11]]


def test_response_peak_prefers_the_middle():
    scores = np.zeros((5, 5))
    assert decode.response_peak(scores) == (2, 2, 0.5)
    scores[0, 0] = 50
    assert decode.response_peak(scores)[:2] == (0, 0) or decode.response_peak(scores, 0.9)[:2] == (2, 2)
    assert decode.cosine_window(3).tolist() == [[0, 0, 0], [0, pytest.approx(1), 0], [0, 0, 0]] or decode.cosine_window(3)[1, 1] == pytest.approx(1)


def test_ctc_of_blanks_and_repeats(spark):
    rows = [(1, t, [5.0 if c == k else 0.0 for c in range(3)]) for t, k in enumerate([1, 1, 0, 1, 2, 2])] + [(2, 0, [9.0, 0.0, 0.0])]
    got = {r.line: (r.text, r.confidence) for r in decode.ctc(spark.createDataFrame(rows, "line long, step int, scores array<double>"), ["line"], ["", "a", "b"]).collect()}
    assert got == {1: ("aab", pytest.approx(1 / (1 + 2 * math.exp(-5)))), 2: ("", 0.0)}


def rows_backend():
    class Rows:  # in here, so that it travels to the workers by value
        info = backends.BackendInfo("rows", "1")

        def __call__(self, picture, context):
            for y in range(picture.shape[0]):
                context.check(y)
                if picture[y, 0] == 255:
                    raise RuntimeError("broken")
                yield (y, int(picture[y].sum()))

    return Rows()


def test_a_backend_fails_frame_by_frame(spark):
    frame = lambda seq, values, fmt="Gray8": (1, seq, bytearray(np.repeat(np.array(values, np.uint8)[:, None], 4, 1).tobytes()), 4, len(values), 4, fmt)
    frames = spark.createDataFrame([frame(1, [1, 2]), frame(2, [3, 255, 5]), frame(3, [1, 1, 1, 1]), frame(4, [1], "Nv12")], FRAMES)
    got = sorted((r.seq, r.status, r.y, r.total) for r in backends.recognize(frames, rows_backend(), "y int, total int", budget=2).collect() if r.y is not None)
    assert got == [(1, "Ok", 0, 4), (1, "Ok", 1, 8), (2, "Ok", 0, 12), (3, "Ok", 0, 4), (3, "Ok", 1, 4), (3, "Ok", 2, 4)]
    assert {(r.seq, r.status) for r in backends.recognize(frames, rows_backend(), "y int, total int", budget=2).collect() if r.y is None} == {(2, "BackendFailure"), (3, "BudgetExceeded"), (4, "UnsupportedFormat")}
    assert {r.status for r in backends.recognize(frames, rows_backend(), "y int, total int", seconds=0.0).collect()} == {"Timeout", "UnsupportedFormat"}
    assert rows_backend().info.key() != backends.BackendInfo("rows", "1", revision="2").key()
    with pytest.raises(backends.Cancelled):
        backends.Context(cancelled=lambda: True).check()


def mover():
    class Mover:
        info = backends.BackendInfo("mover", "1")

        def initialize(self, picture, bounds):
            return bytes(map(int, bounds))

        def update(self, state, picture):
            state = bytes([state[0] + 1, *state[1:]])
            return state, tuple(state), 0.5

    return Mover()


def test_a_tracker_session_is_keyed_state(spark, tmp_path):
    ddl = "track_id long, seq long, x double, y double, w double, h double, " + FRAMES.split(", ", 2)[2]
    blank = (bytearray(16), 4, 4, 4, "Gray8")
    rows = [(7, s, *((3.0, 4.0, 2.0, 2.0) if s in (2, 5) else (None,) * 4), *blank) for s in range(1, 8)]
    for i, part in enumerate((rows[:4], rows[4:])):
        spark.createDataFrame(part, ddl).coalesce(1).write.parquet(f"{tmp_path}/in/{i}")
    source = spark.readStream.schema(spark.createDataFrame(rows, ddl).schema).option("recursiveFileLookup", "true").option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/in")
    q = backends.follow(source, mover()).writeStream.format("memory").queryName("moved").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert sorted((r.seq, r.x, r.confidence) for r in spark.table("moved").collect()) == [(2, 3.0, 1.0), (3, 4.0, 0.5), (4, 5.0, 0.5), (5, 3.0, 1.0), (6, 4.0, 0.5), (7, 5.0, 0.5)]


def test_snapshots_and_lookups(spark, sf_dir):
    from ocellus.operators import fusion, ids
    from ocellus.sources import fixtures as fx

    ev = fx.evidence(spark, sf_dir).where("source_id < 20").drop("source_id")
    frames = fx.frames(spark, sf_dir)
    told = session.snapshots(ev, frames)
    fused = fusion.fuse(ev)
    tracked = {(r.source_id, r.seq, r.region_id): (r.stable_id, r.generation) for r in ids.track(fused.join(frames, "frame_id")).collect()}
    rows = told.collect()
    assert len(rows) == fused.count() and all(tracked[r.source_id, r.seq, r.region_id] == (r.stable_id, r.generation) for r in rows)
    assert session.find_region(told, 1).count() == sum(r.stable_id == 1 for r in rows) and session.find_region(told, 0).count() == 0


def test_policies(spark):
    one = {"bind_stable_id": True, "stable_id": 3}
    digests = [cycle.policy_digest(x) for x in ([], [one], [one | {"stable_id": 4}], [{"text_equals": "a", "label_equals": "b"}], [{"text_equals": "ab"}], [one, one])]
    assert len(set(digests)) == len(digests) and cycle.policy_digest([one]) == digests[1]
    ddl = "idx int, priority int, bind_stable_id boolean, stable_id long, bound_generation long, text_equals string, label_equals string, roi_x double, roi_y double, roi_w double, roi_h double"
    conditions = spark.createDataFrame([(i, 0, True, 10 + i, 1, "", "", 0.0, 0.0, 0.0, 0.0) for i in range(4)], ddl)
    resolved = spark.createDataFrame([(1, 1, i, 0, "unknownStableId" if i < 3 else "staleGeneration", None) + (None,) * 4 for i in range(4)], "source_id long, seq long, idx int, priority int, outcome string, focus_id long, x double, y double, w double, h double")
    tracks = spark.createDataFrame([(1, 1, 10 + i, s, 1.0, 2.0, 3.0, 4.0) for i, s in enumerate(("uncertain", "lost", "terminated", "tracking"))], "source_id long, seq long, track_id long, state string, x double, y double, w double, h double")
    got = {r.idx: (r.outcome, r.focus_id, r.x) for r in cycle.with_tracks(resolved, conditions, tracks).collect()}
    assert got == {0: ("resolved", 10, 1.0), 1: ("missingLocalization", None, None), 2: ("unknownStableId", None, None), 3: ("staleGeneration", None, None)}


def test_events_queue_by_bytes(spark):
    events = spark.createDataFrame([(1, i, n) for i, n in enumerate((50, 10, 20, 30))], "source_id long, event_sequence long, n_bytes long")
    got = sorted((r.event_sequence, r.dropped) for r in cycle.queued_by_bytes(events, 60, 10).collect())
    assert got == [(1, 1), (2, 1), (3, 1)] and sorted(r.event_sequence for r in cycle.queued_by_bytes(events, 60, 2).collect()) == [2, 3]


def test_an_open_square_has_support_and_context(spark):
    rows = [(1, i, *s, 1.0) for i, s in enumerate([(0.0, 0.0, 40.0, 0.0), (40.0, 0.0, 40.0, 40.0), (40.0, 40.0, 0.0, 40.0), (0.0, 40.0, 0.0, 0.0)])]
    (r,) = lines.propose(spark.createDataFrame(rows, "frame_id long, segment_id long, x0 double, y0 double, x1 double, y1 double, confidence double")).collect()
    assert (r.closure, r.edge_support, r.x, r.w, r.context_x, r.context_w) == (1.0, 1.0, 0.0, 40.0, -10.0, 60.0)
