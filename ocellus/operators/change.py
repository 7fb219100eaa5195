"""Change between successive frames of a source, from small gray thumbnails."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ocellus.operators.grouping import map_groups, roots

SIMILARITY, BLOCK_THRESHOLD, GLOBAL_RATIO = 0.98, 8, 0.5


def dhash(px: Column, width: int, rows: int = 8, cols: int = 8) -> Column:
    """64 bits: bit row * 8 + col is set where a pixel is darker than its right neighbour. ``px`` is a row-wise array of gray values;
    the last column of an 8-wide thumbnail has no neighbour and stays unset."""
    pairs = [(r * width + c, r * 8 + c) for r in range(rows) for c in range(min(cols, width - 1))]
    bit = lambda i, n: F.when(px[i + 1] > px[i], F.lit(1 << n if n < 63 else -(1 << 63)).cast("long")).otherwise(F.lit(0).cast("long"))
    out = bit(*pairs[0])
    for p in pairs[1:]:
        out = out.bitwiseOR(bit(*p))
    return out


def hamming(a: Column, b: Column) -> Column:
    return F.bit_count(a.bitwiseXOR(b))


def hash_similarity(a: Column, b: Column) -> Column:
    return (64 - hamming(a, b)) / F.lit(64.0)


def with_previous(frames: DataFrame) -> DataFrame:
    """``frames`` (source_id, seq, px, and others) with the previous frame's px and hash; a source's first frame has none."""
    order = Window.partitionBy("source_id").orderBy("seq")
    hashed = frames.withColumn("hash", dhash(F.col("px"), 8))
    return hashed.withColumn("prev_px", F.lag("px").over(order)).withColumn("prev_hash", F.lag("hash").over(order))


def block_sums(a: Column, b: Column, side: int, block: int) -> Column:
    """Per block, row by row, the sum of absolute differences of two thumbnails."""
    n = -(-side // block)

    def one(by: int, bx: int) -> Column:
        cells = [y * side + x for y in range(by * block, min(side, (by + 1) * block)) for x in range(bx * block, min(side, (bx + 1) * block))]
        total = F.abs(a[cells[0]] - b[cells[0]])
        for i in cells[1:]:
            total = total + F.abs(a[i] - b[i])
        return total

    return F.array(*(one(by, bx) for by in range(n) for bx in range(n)))


def detect(frames: DataFrame, side: int = 8, block: int = 2, threshold: int = BLOCK_THRESHOLD, ratio: float = GLOBAL_RATIO, ignored: list[int] | None = None) -> DataFrame:
    """Per frame: similarity of hashes, changed (indexes of changed blocks), changed_ratio over all blocks, reason and class.

    Frames alike at hash resolution skip the block comparison; ``ignored`` blocks never count as changed but stay in the ratio's
    denominator; a first frame is a global change without a comparison, with a similarity of 1."""
    told = with_previous(frames)
    n = (-(-side // block)) ** 2
    alike = F.coalesce(hash_similarity(F.col("hash"), F.col("prev_hash")), F.lit(1.0))
    first = F.col("prev_hash").isNull()
    told = told.withColumn("similarity", alike).withColumn("reason", F.when(first, "firstFrame").when(alike >= SIMILARITY, "fingerprint").otherwise("blockDiff"))
    sums = F.when(F.col("reason") == "blockDiff", block_sums(F.col("px"), F.col("prev_px"), side, block))
    told = told.withColumn("sums", sums)
    skip = F.array(*(F.lit(i) for i in ignored or [])).cast("array<int>")
    cells = F.filter(F.sequence(F.lit(0), F.lit(n - 1)), lambda i: (F.element_at("sums", i + 1) >= threshold * block * block) & ~F.array_contains(skip, i))
    told = told.withColumn("changed", F.when(F.col("sums").isNotNull(), cells).otherwise(F.array().cast("array<int>")))
    part = F.size("changed") / F.lit(float(n))
    kind = F.when(first, "global").when(F.size("changed") == 0, "none").when(part >= ratio, "global").otherwise("partial")
    return told.withColumn("changed_ratio", part).withColumn("classification", kind).drop("sums")


def ignored_blocks(rects: list[tuple[float, float, float, float]], side: int = 8, block: int = 2, frame_w: int = 1280, frame_h: int = 720) -> list[int]:
    """Numbers of the blocks that lie wholly in one of ``rects`` (x, y, w, h) of a frame, for :func:`detect`."""
    n = -(-side // block)
    out = []
    for i in range(n * n):
        left, top = (k * block for k in (i % n, i // n))
        right, bottom = min(side, left + block), min(side, top + block)
        x0, y0, x1, y1 = left * frame_w / side, top * frame_h / side, right * frame_w / side, bottom * frame_h / side
        if any(x <= x0 and y <= y0 and x1 <= x + w and y1 <= y + h for x, y, w, h in rects):
            out.append(i)
    return out


def changed_regions(detected: DataFrame, side: int = 8, block: int = 2, frame_w: int = 1280, frame_h: int = 720) -> DataFrame:
    """One row per 8-connected component of changed blocks, in order of their first block, as a rectangle of the frame."""
    n = -(-side // block)

    def boxes(rows: list[tuple]) -> list[tuple]:
        out = []
        for source, seq, cells in rows:
            held = set(cells)
            near = [(c, c + dy * n + dx) for c in cells for dy in (-1, 0, 1) for dx in (-1, 0, 1) if 0 <= c % n + dx < n and c + dy * n + dx in held]
            groups: dict[int, list[int]] = {}
            for c, root in roots(near).items():
                groups.setdefault(root, []).append(c)
            for k, root in enumerate(sorted(groups)):
                ys, xs = [c // n for c in groups[root]], [c % n for c in groups[root]]
                x0, y0 = min(xs) * block, min(ys) * block
                x1, y1 = min(side, (max(xs) + 1) * block), min(side, (max(ys) + 1) * block)
                left, top = x0 * frame_w // side, y0 * frame_h // side
                out.append((source, seq, k, left, top, -(-x1 * frame_w // side) - left, -(-y1 * frame_h // side) - top))
        return out

    some = detected.where("size(changed) > 0").select(F.col("source_id").cast("long").alias("source_id"), F.col("seq").cast("long").alias("seq"), "changed")
    return map_groups(some, ["source_id", "seq"], [], boxes, "source_id long, seq long, roi long, x long, y long, w long, h long")


def global_shift(frames: DataFrame, side: int = 8, most: int = 2) -> DataFrame:
    """Per frame with a previous one: the displacement with the smallest sum of absolute differences over the central window; ties
    go to the smallest radius, then dy, then dx. confidence compares the best with the mean of the others."""
    told = with_previous(frames).where("prev_px is not null")
    span = range(-most, most + 1)
    inner = side - 2 * most
    moves = F.array(*(F.struct(F.lit(dy).alias("dy"), F.lit(dx).alias("dx")) for dy in span for dx in span))
    cells = F.sequence(F.lit(0), F.lit(inner * inner - 1))
    place = lambda k: (F.floor(k / inner) + most) * side + F.pmod(k, F.lit(inner)) + most
    # Higher-order functions: written out, the 25 sums make more code than compiling it is worth.
    at = lambda px, i: F.get(F.col(px), i.cast("int"))
    sad = lambda m: F.aggregate(cells, F.lit(0).cast("long"), lambda a, k: a + F.abs(at("prev_px", place(k)) - at("px", place(k) + m["dy"] * side + m["dx"])))
    offsets = F.transform(moves, lambda m: F.struct(sad(m).alias("sad"), F.greatest(F.abs(m["dy"]), F.abs(m["dx"])).alias("radius"), m["dy"].alias("dy"), m["dx"].alias("dx")))
    told = told.withColumn("surface", offsets)
    total, best = F.aggregate("surface", F.lit(0).cast("long"), lambda a, s: a + s["sad"]), F.array_min("surface")
    n = len(span) ** 2
    told = told.withColumn("total", total).withColumn("best", best)
    down = F.col("total") + (n - 2) * F.col("best.sad")
    confidence = F.when(down > 0, (F.col("total") - n * F.col("best.sad")) / down).otherwise(F.lit(0.0))
    return told.select("source_id", "seq", F.col("best.dx").alias("dx"), F.col("best.dy").alias("dy"), F.col("best.sad").alias("sad"), confidence.alias("confidence"))
