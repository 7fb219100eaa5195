"""Queries that SQL doesn't express, against plain versions of their rules on the frames of a small table."""

import math
from collections import defaultdict

import numpy as np
import pytest

from ocellus.operators import lines
from ocellus.plans import catalog
from ocellus.sources import fixtures as fx


def by_frame(df):
    out = defaultdict(list)
    for r in df.collect():
        out[r.frame_id].append(r)
    return out


def test_merged_lines(spark, sf_dir):
    want = {}
    for frame, rows in by_frame(fx.evidence(spark, sf_dir).where("kind = 'text'")).items():
        free = sorted(rows, key=lambda r: (r.y, r.x, r.evidence_id))
        while free:
            box, texts, sure = [free[0].x, free[0].y, free[0].x + free[0].w, free[0].y + free[0].h], [free[0].text], free[0].confidence
            rest, n = free[1:], 1
            changed = True
            while changed:  # sweep after sweep: whoever is level and near joins at once
                changed = False
                for r in list(rest):
                    low = min(box[3] - box[1], r.h)
                    apart = max(0.0, max(box[0], r.x) - min(box[2], r.x + r.w))
                    if low > 0 and abs((box[1] + box[3]) / 2 - r.y - r.h / 2) <= 0.5 * low and apart <= low:
                        box = [min(box[0], r.x), min(box[1], r.y), max(box[2], r.x + r.w), max(box[3], r.y + r.h)]
                        texts.append(r.text)
                        sure, n, changed = min(sure, r.confidence), n + 1, True
                        rest.remove(r)
            want.setdefault(frame, []).append((box[0], box[1], box[2] - box[0], box[3] - box[1], " ".join(texts), sure, n))
            free = rest
    got = by_frame(catalog.QUERIES["merged_lines"](spark, sf_dir))
    assert {f: [(r.x, r.y, r.w, r.h, r.text, r.confidence, r.merged) for r in sorted(rows, key=lambda r: r.line)] for f, rows in got.items()} == want


def test_merged_segments_cover_theirs(spark, sf_dir):
    """Nothing is lost or made up: each result lies along the segments that it took, from their first to their last end."""
    source = by_frame(fx.segments(spark, sf_dir))
    got = by_frame(catalog.QUERIES["merged_segments"](spark, sf_dir))
    for frame, rows in source.items():
        long = [r for r in rows if (r.x0, r.y0) != (r.x1, r.y1)]
        assert sum(r.merged for r in got.get(frame, [])) == len(long)
        ids = {r.segment_id: r for r in long}
        for r in got.get(frame, []):
            seed = ids[r.segment_id]
            if r.merged == 1:
                ends = lambda s: [v for p in sorted([(round(s.x0, 6), round(s.y0, 6)), (round(s.x1, 6), round(s.y1, 6))]) for v in p]
                assert ends(r) == pytest.approx(ends(seed)) and r.confidence == seed.confidence
            else:
                assert math.hypot(r.x1 - r.x0, r.y1 - r.y0) >= math.hypot(seed.x1 - seed.x0, seed.y1 - seed.y0) - 1e-9 and r.confidence >= seed.confidence
    assert any(r.merged > 1 for rows in got.values() for r in rows)


def clusters(rows, radius):
    parent = {r.segment_id: r.segment_id for r in rows}

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    near = lambda a, b: any(math.hypot(p[0] - q[0], p[1] - q[1]) <= radius for p in ((a.x0, a.y0), (a.x1, a.y1)) for q in ((b.x0, b.y0), (b.x1, b.y1)))
    for a in rows:
        for b in rows:
            if a.segment_id < b.segment_id and near(a, b):
                x, y = find(a.segment_id), find(b.segment_id)
                parent[max(x, y)] = min(x, y)
    out = defaultdict(list)
    for r in rows:
        out[find(r.segment_id)].append(r)
    return out


def test_oriented_boxes(spark, sf_dir):
    """The smallest rectangle around a cluster's ends has a side along two of them: try all pairs."""
    want = {(f, c): rows for f, of in by_frame(fx.segments(spark, sf_dir)).items() for c, rows in clusters(of, 4.0).items()}
    got = {(r.frame_id, r.cluster): r for r in catalog.QUERIES["oriented_boxes"](spark, sf_dir).collect()}
    assert got.keys() == want.keys()
    for key, rows in want.items():
        p = np.array(sorted({q for r in rows for q in ((r.x0, r.y0), (r.x1, r.y1))}))
        areas = [0.0] if len(p) < 2 else []
        for i in range(len(p)):
            for j in range(i):
                u = (p[i] - p[j]) / math.hypot(*(p[i] - p[j]))
                v = np.array([-u[1], u[0]])
                areas.append(float(np.ptp(p @ u) * np.ptp(p @ v)))
        r = got[key]
        assert r.w * r.h == pytest.approx(min(areas), abs=1e-6)
        u = np.array([math.cos(math.radians(r.angle)), math.sin(math.radians(r.angle))])
        off = (p - np.array([r.cx, r.cy])) @ np.array([u, [-u[1], u[0]]]).T
        assert (np.abs(off) <= np.array([r.w, r.h]) / 2 + 1e-6).all()


def test_region_proposals(spark, sf_dir):
    got = {(r.frame_id, r.cluster): r for r in catalog.QUERIES["region_proposals"](spark, sf_dir).collect()}
    count = 0
    for frame, of in by_frame(fx.segments(spark, sf_dir)).items():
        for cluster, rows in clusters(of, 4.0).items():
            ends = [(r.segment_id, slot, p) for r in rows for slot, p in enumerate(((r.x0, r.y0), (r.x1, r.y1)))]
            root = list(range(len(ends)))
            for i, (a, _, p) in enumerate(ends):
                for j, (b, _, q) in enumerate(ends):
                    if a != b and math.hypot(p[0] - q[0], p[1] - q[1]) <= 4.0:
                        x, y = root[i], root[j]
                        root = [min(x, y) if k in (x, y) else k for k in root]
            junctions = len(set(root))
            if len(rows) < 3 or junctions < 3:
                assert (frame, cluster) not in got
                continue
            r = got.get((frame, cluster))
            if len(rows) - junctions + 1 >= 1:
                assert r is not None and r.closure == 1.0
            if r is None:
                continue
            count += 1
            xs, ys = [p[0] for *_, p in ends], [p[1] for *_, p in ends]
            assert (r.segments, r.junctions, r.x, r.y, r.w, r.h) == (len(rows), junctions, min(xs), min(ys), max(xs) - min(xs), max(ys) - min(ys)) and r.closure >= 0.75
            shared = {a for i, (a, *_) in enumerate(ends) if len({b for j, (b, *_) in enumerate(ends) if root[i] == root[j]}) > 1}
            assert r.edge_support == pytest.approx(len(shared) / len(rows))
    assert count == len(got) > 0


def test_mark_chips(spark, sf_dir):
    marks = defaultdict(dict)
    for r in catalog.QUERIES["marks"](spark, sf_dir).collect():
        marks[r.frame_id][r.mark] = (r.mx, r.my, r.mw, r.mh)
    got = by_frame(catalog.QUERIES["mark_chips"](spark, sf_dir))
    inside = lambda x, y, w, h: 0 <= y and y + h <= 30 and x + w <= 40
    meet = lambda a, b: a[0] < b[0] + b[2] and b[0] < a[0] + a[2] and a[1] < b[1] + b[3] and b[1] < a[1] + a[3]
    for frame, own in marks.items():
        placed = []
        for r in sorted(got[frame], key=lambda r: r.mark):
            x, y, _, h = own[r.mark]
            wide = 6 * len(str(r.mark)) + 2
            tops = {"above": y - 9, "below": y + h, "insideTop": y, "insideBottom": y + h - 9}
            free = [n for n, top in tops.items() if inside(x, top, wide, 9) and not any(meet((x, top, wide, 9), p) for p in placed)]
            assert r.place == (free[0] if free else "none")
            if free:
                placed.append((x, tops[r.place], wide, 9))
                assert (r.cx, r.cy, r.cw, r.ch) == placed[-1]
        assert len(got[frame]) == len(own)


def test_hull_of_few_points():
    assert lines.oriented_box([(1.0, 1.0)])[2:4] == (0.0, 0.0) and lines.oriented_box([(0.0, 0.0), (3.0, 4.0)])[2] == pytest.approx(5.0)
